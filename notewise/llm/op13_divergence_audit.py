"""Source divergence audit: how far apart the sources of each language write.

Terms carry their language, so that one vocabulary holds those of all
languages, each with its own count of documents. Texts are cut into terms in
Arrow batches, as bytes. The ``minDF`` count is a Spark aggregate over the
distinct terms of every text; ``CountVectorizer`` (no limit
on the vocabulary but the largest integer) is fitted on the terms that reach it
and turns every text into an exact sparse vector. Vectors are summed per
(language, source) the way ``Summarizer`` sums, but as integers over the entries
that occur, with partial sums in every task: no task or driver holds a dense
row, and a source with most of the documents costs its tasks one partial sum a
term.

Why ``minDF`` is counted before the fit: the vocabulary of a ``CountVectorizer``
passes through the driver. Counted first, it is dealt by hash into blocks of
about ``terms_at_once`` terms; each block is fitted, summed and written by
itself, so the driver's share is bounded whatever the corpus holds.

Probabilities are integers: p = 1 + floor(10^9 * (count + 5) / (N + 5 V)), for
terms that a group lacks too. The distance of two sources,
the sum of |p - q| over all V terms, is taken from what occurs: V times the
distance at count 0, plus, for each of the two, what its own terms change
against the other's count 0 (a sum over how many terms have each count), plus
what the terms of both change beyond that (a join on the term).

Edge cases: null text, lang and source are ''; a group without kept terms has
N = 0; with V = 0 every distance is 0; a language with one source has no
pair; repeated rows count each; ranks break ties by the item's bytes; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: A-Z in lower case; everything else in ASCII that is no letter separates terms
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MAX_INT = 2147483647
SCALE, PRIOR = 1_000_000_000, 5
TEXTS_AT_ONCE = 4 << 20     # bytes


def _read(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _marked(batches):
    """(lang, source, terms) of texts, block by block: terms are the hex of
    the language, ':' and the term, as bytes."""
    for block in C.by_bytes(C.rows_of(batches, "lang", "source", "text"), lambda r: len(r[2]), TEXTS_AT_ONCE):
        yield [(lang, source, list(map((lang.encode().hex() + ":").encode().__add__, text.translate(FOLD).split())))
               for lang, source, text in block]


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    C.ship_package(docs.sparkSession)
    return docs.select(_read(lang_col).alias("lang"), _read(source_col).alias("source"),
                       _read(text_col).cast("binary").alias("text"))


def term_lists(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, terms): each text's terms in order, with their language."""
    def run(batches):
        for block in _marked(batches):
            langs, sources, lists = zip(*block)
            flat = pa.array([t for ts in lists for t in ts], pa.binary()).view(pa.string())
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.ListArray.from_arrays(ends, flat)],
                                             names=["lang", "source", "terms"])
    return _texts(docs, text_col, lang_col, source_col).mapInArrow(run, "lang string, source string, terms array<string>")


def kept_terms(docs: DataFrame, min_docs: int, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               held: int = 300_000) -> DataFrame:
    """(key): the terms of all languages that occur in enough texts. A task
    adds up its texts, up to ``held`` terms at a time."""
    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).view(pa.string()),
                                               pa.array(counts.values(), pa.int64())], names=["key", "docs"])
        for block in _marked(batches):
            for _, _, terms in block:
                counts.update(set(terms))
                if len(counts) > held:
                    yield out()
                    counts.clear()
        yield out()
    return (_texts(docs, text_col, lang_col, source_col).mapInArrow(run, "key string, docs bigint")
            .groupBy("key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("key"))


def group_sums(docs: DataFrame, min_docs: int = 30, terms_at_once: int = 1_000_000, text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, count): occurrences of kept terms, where above 0."""
    spark = docs.sparkSession
    lists = term_lists(docs, text_col, lang_col, source_col)
    kept = C.cut_lineage(kept_terms(docs, min_docs, text_col, lang_col, source_col), spark, "kept-terms")
    blocks = -(-kept.count() // terms_at_once)
    out = None
    for b in range(blocks):
        block = kept.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select(F.array("key").alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=1.0, vocabSize=MAX_INT).fit(block)
        v = F.unwrap_udt("vector")
        entries = model.transform(lists).select("lang", "source", F.inline(F.arrays_zip(
            v["indices"].alias("i"), v["values"].alias("n"))))
        sums = entries.groupBy("lang", "source", "i").agg(F.sum(F.col("n").cast("bigint")).alias("count"))
        names = spark.createDataFrame(pd.DataFrame({"term": [w.partition(":")[2] for w in model.vocabulary]})
                                      .reset_index(names="i"), "i bigint, term string")
        part = C.cut_lineage(sums.join(names, "i").select("lang", "source", "term", "count"), spark, "group-sums")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "lang string, source string, term string, count bigint")


def share(count: Column | str, total: Column | str) -> Column:
    """p of a count, exact: the total is N + 5 V."""
    n, d = (F.col(c) if isinstance(c, str) else c for c in (count, total))
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)"),
                           d.cast("decimal(20,0)")) + 1


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, terms_at_once: int = 1_000_000, text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): the distances of every two
    sources of a language, and each source's ``top`` terms above its language."""
    counts = group_sums(docs, min_docs, terms_at_once, text_col, lang_col, source_col)
    in_lang = counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"))
    sizes = in_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_count").alias("lang_n"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("bigint")
    # one row a source and language: sizes, and p of a term that does not occur
    groups = (docs.select(_read(lang_col).alias("lang"), _read(source_col).alias("source")).distinct()
              .join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", F.coalesce("terms", zero).alias("terms"),
                      (F.coalesce("n", zero) + PRIOR * F.coalesce("terms", zero)).alias("total"),
                      (F.coalesce("lang_n", zero) + PRIOR * F.coalesce("terms", zero)).alias("lang_total"))
              .withColumn("p0", F.when(F.col("terms") > 0, share(zero, F.greatest("total", F.lit(1)))).otherwise(zero)))
    groups = C.cut_lineage(groups, counts.sparkSession, "divergence-groups")

    p = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "count", "p0", "lang_total", share("count", "total").alias("p"))
    p = C.cut_lineage(p, counts.sparkSession, "divergence-shares")

    # distances: (a, b) of one language
    a = groups.select("lang", F.col("source").alias("a"), "terms", F.col("p0").alias("a0"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").where("a != b")
    base = pairs.select("lang", "a", "b", (F.col("terms") * F.abs(F.col("a0") - F.col("b0"))).alias("value"))
    how_many = p.groupBy("lang", F.col("source").alias("a"), "p", F.col("p0").alias("a0")).agg(
        F.count(F.lit(1)).alias("n"))
    one = (how_many.join(b, "lang").where("a != b")
           .withColumn("x", F.col("n") * (F.abs(F.col("p") - F.col("b0")) - F.abs(F.col("a0") - F.col("b0"))))
           .groupBy("lang", "a", "b").agg(F.sum("x").alias("value")))
    left = p.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("ap"), F.col("p0").alias("a0"))
    right = p.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("bp"), F.col("p0").alias("b0"))
    d = {x + y: F.abs(F.col(x) - F.col(y)) for x in ("ap", "a0") for y in ("bp", "b0")}
    both = (left.join(right, ["lang", "term"]).where("a < b")
            .groupBy("lang", "a", "b").agg(F.sum(d["apbp"] - d["apb0"] - d["a0bp"] + d["a0b0"]).alias("value")))

    def turned(x: DataFrame) -> DataFrame:
        return x.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    far = (base.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
           .groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value")))

    above = (p.join(in_lang, ["lang", "term"])
             .select("lang", "source", F.col("term").alias("item"),
                     (F.col("p") - share("lang_count", "lang_total")).alias("value")).where("value > 0"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(x: DataFrame, part: str) -> DataFrame:
        return x.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"),
                        F.row_number().over(by).alias("rank"))
    return ranked(far, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= top))


def op13_divergence_audit(spark, sf_dir: str) -> DataFrame:
    """Divergence of the sources of all documents."""
    return audit(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM counts GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN sizes USING (lang)),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c,
         CAST(1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (n + 5 * v) AS BIGINT) AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
q AS (
  SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (c + 5) // (n + 5 * v) AS BIGINT) AS q
  FROM (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM counts GROUP BY ALL)
  JOIN (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM counts GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(s.f, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source != h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS f
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL) s
  ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
tops AS (
  SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM tops)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50"""
