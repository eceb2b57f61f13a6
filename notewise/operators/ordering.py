"""Order within a group without letting a hot group into one task.

``ordered_within(df, key, order, value)`` adds, for every row, its 1-based
position in its group by ``order``, the group size, the next row's value and
the group's last value: what ``row_number``, ``count``, ``lead`` and
``last`` over ``Window.partitionBy(key).orderBy(order, value)`` give.

There is one path for all groups. ``order`` is an integer position (a
message index), and ``order div bucket_rows`` cuts every group into buckets;
a window works inside each bucket. One row per bucket (size, first and last
row) then gives each bucket its offset, the first row of the next bucket and
the group's last row, joined back on the bucket. A group shorter than a
bucket is one bucket. Group and bucket form one struct column, so that NULL
keys and NULL orders are groups and buckets like any other and the window's
partitioning serves the join too: the values are shuffled once. Rows are
handed on inside structs, so that a NULL value stays a value.

A bucket holds all rows of a group with the same position (and all with a
NULL position, which come first); ties are ordered by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

U, UF = Window.unboundedPreceding, Window.unboundedFollowing


def ordered_within(df: DataFrame, key: str, order: str, value: str, bucket_rows: int = 100_000) -> DataFrame:
    """df + pos (int), n (long), next_<value>, last_<value>."""
    cols = df.columns
    bucket = F.floor(F.col(order) / F.lit(bucket_rows)).cast("long")
    rows = df.select(*cols, F.struct(F.col(key).alias("k"), bucket.alias("b")).alias("_g"))
    inside = Window.partitionBy("_g").orderBy(order, value)
    one, place = F.struct(F.col(value).alias("v")), F.struct(order, value)
    local = rows.select("*", F.row_number().over(inside).alias("_local"), F.lead(one).over(inside).alias("_after"))

    along = Window.partitionBy("_k").orderBy("_b")
    whole = along.rowsBetween(U, UF)
    buckets = (rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_size"), F.min_by(one, place).alias("_first"),
                                      F.max_by(one, place).alias("_last"))
               .select("_g", F.struct("_g.k").alias("_k"), F.col("_g.b").alias("_b"), "_size", "_first", "_last")
               .select("_g", F.coalesce(F.sum("_size").over(along.rowsBetween(U, -1)), F.lit(0)).alias("_off"),
                       F.sum("_size").over(whole).alias("n"), F.lead("_first").over(along).alias("_succ"),
                       F.last("_last").over(whole).alias("_final")))
    return local.join(buckets, "_g").select(
        *cols, (F.col("_off") + F.col("_local")).cast("int").alias("pos"), "n",
        F.coalesce("_after", "_succ")["v"].alias(f"next_{value}"), F.col("_final.v").alias(f"last_{value}"))
