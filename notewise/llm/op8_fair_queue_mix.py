"""Mixing sources to target weights by weighted fair queueing.

Every document of a source queues in a shuffled order (by a hash of its id),
and behind them all, a second time, for targets above the source's size. Its
virtual finish time is the source's words up to and with it, divided by the
source's target. The mix is the head of the global order by finish time, cut
where the total budget is reached: a document belongs to it while the words
before it are fewer than the budget.

No step needs a source, or the mix, in one task: words before a document are
summed by bins of the shuffled order first (a row for each bin), then inside
each bin; the global cut is found in the same way by bins of finish time.
Text is read once, to count words; the rest moves (id, source, size).

Edge cases: null text has size 0; a null source is a source, the last;
repeated rows queue each; rows of one id (or without one) queue by size, so
that what is taken doesn't hang on how the table is split; documents of size 0 take 0; when all sizes are 0
all targets are 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def word_count(text: str | Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, null as 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total_percent: int = 150,
            most_times: int = 2) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row a
    source. Shares go by weight; a share above ``most_times`` the source's
    size stops there and the rest is dealt again by weight. In the order of
    size per weight the capped sources come first, so one pass of running
    sums finds the level at which the rest is filled."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * most_times
    by_need = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) * total_percent / 100
              - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    return (sizes.select("source", "source_size", w.alias("w"), cap.alias("cap"))
            .withColumn("level", level)
            .withColumn("fits", F.col("cap") > F.col("level") * F.col("w"))
            # the first source that is not capped sets the level of all after
            # it, whose own levels would be lower
            .withColumn("fill", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
            .select("source", "source_size",
                    F.least(F.col("cap").cast("double"),
                            F.coalesce(F.col("fill") * F.col("w"), F.col("cap").cast("double"))).alias("target")))


def _with_sum_before(df: DataFrame, keys: list[str], order: list, bin_col: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys``
    that come earlier, bins first, then ``order`` inside a bin."""
    bins = df.groupBy(*keys, bin_col).agg(F.sum(value).alias("_in_bin"))
    up_to = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(bin_col).alias("_bin"),
                       F.coalesce(F.sum("_in_bin").over(up_to), F.lit(0)).alias("_bins_before"))
    inside = (Window.partitionBy(*keys, bin_col).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    same = F.col(bin_col) == F.col("_bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (df.join(bins, same).drop("_bin", *[f"_{k}" for k in keys])
            .withColumn(out, F.col("_bins_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_bins_before"))


def mix(docs: DataFrame, rows_per_bin: int = 20_000, **shares) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of ``docs``
    (doc_id, source, size); ``shares`` go to ``targets``."""
    spark = docs.sparkSession
    docs = C.cut_lineage(
        docs.select("doc_id", "source", "size",
                    F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("dice"))
        .withColumn("row", F.monotonically_increasing_id()), spark, "mix-sizes")
    goals = C.cut_lineage(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), **shares),
                          spark, "mix-targets")
    n = docs.count()
    bins = 1 + 2 * n // rows_per_bin
    goal_of = goals.withColumnRenamed("source", "_source")
    # the first 8 hex digits of the dice order a source: a bin is a range of them
    place = F.conv(F.substring("dice", 1, 8), 16, 10).cast("long")
    once = _with_sum_before(docs.withColumn("bin", F.floor(place * bins / F.lit(1 << 32))), ["source"],
                            ["dice", "doc_id", "size", "row"], "bin", "size", "before")
    queue = (once.join(goal_of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "bin")
             .where("size > 0 AND target > 0")
             .withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("finish", (F.col("round") * F.col("source_size") + F.col("before") + F.col("size"))
                         / F.col("target")))
    budget = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    # a finish time is at most 2 * size / target: the bins reach beyond all of them
    queue = queue.withColumn("one", F.lit(1)).withColumn("slot", F.floor(F.col("finish") * bins))
    ahead = _with_sum_before(queue, ["one"], ["finish", F.col("source").isNull(), "source", "dice", "doc_id", "size", "row"],
                             "slot", "size", "ahead")
    taken = (ahead.where(F.col("ahead") < F.lit(budget)).groupBy("row").agg(F.sum("size").alias("taken")))
    return (docs.join(taken, "row", "left")
            .join(goal_of, F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", "source", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size) of documents."""
    return documents.select("doc_id", "source", word_count("text").alias("size"))


def op8_fair_queue_mix(spark, sf_dir: str) -> DataFrame:
    """Mix all documents."""
    return (mix(sized(C.table(spark, sf_dir, "documents")))
            .select("doc_id", "size", "source_size", "target", "taken"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS dice
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
              WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 2 * source_size AS cap,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 150 / 100
          - coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / w, source IS NULL, source
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0 * source_size / w, source IS NULL, source
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources),
goals AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE),
               coalesce(max(level) FILTER (WHERE cap > level * w) OVER () * w, CAST(cap AS DOUBLE))) AS target
  FROM levels),
queue AS (
  SELECT d.doc_id, d.source, d.size, d.dice, r.round,
         (r.round * g.source_size
          + sum(d.size) OVER (PARTITION BY d.source, r.round ORDER BY d.dice, d.doc_id ROWS UNBOUNDED PRECEDING)) / g.target AS finish
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source CROSS JOIN (VALUES (0), (1)) r(round)
  WHERE d.size > 0 AND g.target > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, dice, doc_id ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM queue),
mixed AS (
  SELECT doc_id, sum(size) AS taken FROM ordered
  WHERE ahead < (SELECT sum(target) FROM goals) GROUP BY doc_id)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.source_size, CAST(g.target AS DOUBLE) AS target,
       CAST(coalesce(m.taken, 0) AS BIGINT) AS taken
FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN mixed m ON d.doc_id = m.doc_id
"""
