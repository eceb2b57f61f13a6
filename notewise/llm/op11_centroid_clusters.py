"""Centroid clustering with JVM expressions alone.

Vectors become integer arrays, so every distance, sum and centroid is exact
and no order of summation changes a result. A round is one scan: the distance
to each centroid, a literal array, is a ``zip_with`` and an ``aggregate``,
``array_min`` of (distance, number) structs chooses the cluster, and one
aggregate sums every column per cluster. Only those sums, one row a cluster,
reach the driver, which puts the next centroids into the next plan as
literals. No vector is shuffled, and a cluster that holds most vectors costs
its tasks one row like any other.

Edge cases: a vector that is null, has another number of components, a null
or non-finite one, or one beyond ``reach`` (its squared distances would leave
64 bits) takes no part and has no row; fewer vectors than centroids give as
many centroids as vectors; a null id is drawn like the text ''; repeated rows
count each, and may all be first centroids; equal distances go to the smaller
number; an empty cluster keeps its centroid; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ASSIGNED = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def reach(dims: int) -> int:
    """The largest component whose squared distances always fit 64 bits."""
    return math.isqrt((1 << 62) // dims) // 2


def whole_vectors(df: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id",
                  vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that count, each component floor(scale * x)."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * F.lit(float(scale)))
    most = F.lit(float(reach(dims)))
    fits = F.forall("x", lambda c: F.coalesce((c >= -most) & (c <= most), F.lit(False)))   # not NaN: it is the largest
    return (df.select(F.col(id_col).alias("vec_id"), x.alias("x")).where((F.size("x") == dims) & fits)
            .select("vec_id", F.transform("x", lambda c: F.floor(c)).alias("v")))


def first_centroids(vectors: DataFrame, k: int, seed: str = "1") -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:id``, in its order."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r.v for r in vectors.select(drawn.alias("drawn"), "v").orderBy("drawn", "v").limit(k).collect()]


def nearest(v: str, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid."""
    def to(centroid):       # SQL text: literals by the thousand would each cost a call to the JVM
        literal = f"array({', '.join(f'{x}L' for x in centroid)})"
        return f"aggregate(zip_with({v}, {literal}, (a, b) -> (a - b) * (a - b)), 0L, (s, d) -> s + d)"
    return F.expr(f"""array_min(array({', '.join(
        f"named_struct('distance', {to(c)}, 'cluster', {i})" for i, c in enumerate(centroids))}))""")


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    near = vectors.select("v", nearest("v", centroids)["cluster"].alias("cluster"))
    sums = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))])
    out = list(centroids)
    for r in sums.collect():        # one row a cluster
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(len(centroids[0]))]
    return out


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id_col: str = "vec_id",
            vector_col: str = "embedding", seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)
    of every vector that counts."""
    spark = df.sparkSession
    vectors = whole_vectors(df, dims, scale, id_col, vector_col)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in
                                          (x.split() for x in ASSIGNED.split(", "))]).limit(0)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    near = C.cut_lineage(vectors.select("vec_id", nearest("v", centroids).alias("near")), spark, "clusters")
    near = near.select("vec_id", "near.cluster", "near.distance")
    # one row a cluster; sums of many distances may pass 64 bits on the way, not in a result that has them
    inertia = {r.cluster: int(r.total) for r in near.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}

    def of(values, kind) -> Column:
        return F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("cluster") + 1)

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return near.select(
        "vec_id", "cluster", "distance",
        of([inertia.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings."""
    return cluster(C.table(spark, sf_dir, "embeddings"))


def _oracle(rounds: int = 3) -> str:
    """The same rounds as common table expressions."""
    parts = ["""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             """drawn AS (
  SELECT v, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept)""",
             "cent0 AS (SELECT c, v FROM drawn WHERE c < 16)"]

    def near(i):
        return f"""near{i} AS (
  SELECT vec_id, v, min({{'distance': d, 'cluster': c}}) AS m FROM (
    SELECT k.vec_id, k.v, k.r, t.c, CAST(list_sum(list_transform(list_zip(k.v, t.v),
           lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM (SELECT *, row_number() OVER () AS r FROM kept) k, cent{i} t) GROUP BY r, vec_id, v)"""

    for i in range(rounds):
        parts += [near(i), f"""sums{i} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS v FROM (
    SELECT m.cluster AS c, d, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (
      SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near{i}) GROUP BY ALL) GROUP BY c)""",
                  f"cent{i + 1} AS (SELECT t.c, coalesce(s.v, t.v) AS v FROM cent{i} t LEFT JOIN sums{i} s ON t.c = s.c)"]
    parts.append(near(rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m.cluster AS INTEGER) AS cluster, m.distance AS distance,
       CAST(sum(m.distance) OVER (PARTITION BY m.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(t.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN cent{rounds} t ON t.c = m.cluster"""


ORACLE = _oracle()
