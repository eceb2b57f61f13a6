"""Bindings of the engine's tables to the driver's parquet test tables.

``records``, ``steps``, ``pairs`` come from ``conversations``; ``docs``
from ``documents``. All are lazy DataFrames: the scan is pruned to the
columns used, and grouping is partial (map-side) where it can be. No view
collects a conversation into an array.

Step numbering goes through ``operators.ordering.ordered_within``, which cuts
every conversation into bounded buckets (no window partition holds a hot
conversation whole).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.operators.ordering import ordered_within
from notewise.plans.prompts import DEFAULT_INSTRUCTION

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instruction record per conversation that has an assistant turn.

    instruction = first system text (or the default instruction),
    input = first user text, output = last assistant text.
    record_id = conv_id. One aggregate with partial aggregation on the map
    side (sort-based, as its buffers hold texts), so a hot conversation never
    lands whole in one reducer.
    """
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    agg = conv.groupBy("conv_id").agg(
        F.expr("min_by(text, turn) FILTER (WHERE role = 'system')").alias("sys_text"),
        F.expr("min_by(text, turn) FILTER (WHERE role = 'user')").alias("input"),
        F.expr("max_by(text, turn) FILTER (WHERE role = 'assistant')").alias("output"),
    )
    return (agg.where(F.col("output").isNotNull())
            .select(F.col("conv_id").alias("record_id"),
                    F.coalesce("sys_text", F.lit(DEFAULT_INSTRUCTION)).alias("instruction"),
                    "input", "output"))


def _assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conv.where(F.col("role") == "assistant").select("conv_id", "turn", "text")


def _ordered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with their position, count, next and last text per
    conversation (skew-safe: see ``operators.ordering``)."""
    return ordered_within(_assistant_turns(spark, sf_dir), "conv_id", "turn", "text")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-th assistant turn (step k) scored against the last assistant turn.

    (method, step, record_id, candidate, reference); the last turn itself is
    not a step.
    """
    a = _ordered_turns(spark, sf_dir)
    return (a.where(F.col("pos") < F.col("n"))
            .select(F.lit("to_final").alias("method"), F.col("pos").alias("step"),
                    F.col("conv_id").alias("record_id"), F.col("text").alias("candidate"),
                    F.col("last_text").alias("reference")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-th assistant turn scored against the next assistant turn."""
    a = _ordered_turns(spark, sf_dir)
    return (a.where(F.col("next_text").isNotNull())
            .select(F.lit("to_next").alias("method"), F.col("pos").alias("step"),
                    F.col("conv_id").alias("record_id"), F.col("text").alias("candidate"),
                    F.col("next_text").alias("reference")))


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both bindings stacked: the answers table the scorers run on.

    One ordering pass produces both: each assistant turn that has a later
    turn emits its ``to_final`` row and, if the next turn has a text, its
    ``to_next`` row through one generator.
    """
    a = _ordered_turns(spark, sf_dir).where(F.col("pos") < F.col("n"))
    both = F.filter(F.array(
        F.struct(F.lit("to_final").alias("method"), F.col("last_text").alias("reference")),
        F.struct(F.lit("to_next").alias("method"), F.col("next_text").alias("reference"))),
        lambda x: (x["method"] == "to_final") | x["reference"].isNotNull())
    return a.select(F.col("conv_id").alias("record_id"), F.col("pos").alias("step"),
                    F.col("text").alias("candidate"), F.inline(both)).select(
        "method", "step", "record_id", "candidate", "reference")


def split_of(id_col) -> F.Column:
    """Deterministic split by id: 0-7 train, 8 validation, 9 test."""
    m = F.pmod(id_col, F.lit(10))
    return (F.when(m == 8, F.lit("validation"))
            .when(m == 9, F.lit("test")).otherwise(F.lit("train")))


def docs(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """documents with a split column. ``spread``: tasks to hash-spread the
    rows over first, for CPU-heavy text work on a table of few large files."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if spread:
        d = d.repartition(spread, "doc_id")
    return d.withColumn("split", split_of(F.col("doc_id")))


def doc_records(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """Documents as fine-tuning records: the text is the note, its first line
    the answer. Many are longer than the token budget. ``spread`` as in ``docs``."""
    return docs(spark, sf_dir, spread).select(
        F.col("doc_id").alias("record_id"), "split", F.lit(DEFAULT_INSTRUCTION).alias("instruction"),
        F.col("text").alias("input"), F.substring_index("text", "\n", 1).alias("output"))


def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with a split column: the fine-tuning source."""
    r = records(spark, sf_dir)
    return r.select("record_id", split_of(F.col("record_id")).alias("split"),
                    "instruction", "input", "output")


# DuckDB definitions of the same views, used by the oracle SQL strings.
SQL_VIEWS = {
    "records": f"""
records AS (
  SELECT conv_id AS record_id,
         coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), '{{DEFAULT_INSTRUCTION}}') AS instruction,
         arg_min(text, turn) FILTER (WHERE role = 'user') AS input,
         arg_max(text, turn) FILTER (WHERE role = 'assistant') AS output
  FROM conversations GROUP BY conv_id
  HAVING count(*) FILTER (WHERE role = 'assistant') > 0)""",
    "split_records": """
split_records AS (
  SELECT record_id,
         CASE WHEN record_id % 10 = 8 THEN 'validation' WHEN record_id % 10 = 9 THEN 'test'
              ELSE 'train' END AS split,
         instruction, input, output
  FROM records)""",
    "asst": """
asst AS (
  SELECT conv_id, turn, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step,
         count(*) OVER (PARTITION BY conv_id) AS n,
         last(text) OVER (PARTITION BY conv_id ORDER BY turn
                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_text,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations WHERE role = 'assistant')""",
    "answers": """
answers AS (
  SELECT 'to_final' AS method, CAST(step AS INTEGER) AS step, conv_id AS record_id,
         text AS candidate, last_text AS reference FROM asst WHERE step < n
  UNION ALL
  SELECT 'to_next', CAST(step AS INTEGER), conv_id, text, next_text FROM asst
  WHERE next_text IS NOT NULL)""",
    "doc_records": """
doc_records AS (
  SELECT doc_id AS record_id, split, '{DEFAULT_INSTRUCTION}' AS instruction, text AS input,
         string_split(text, chr(10))[1] AS output FROM docs)""",
    "docs": """
docs AS (
  SELECT doc_id, text, lang, source,
         CASE WHEN doc_id % 10 = 8 THEN 'validation' WHEN doc_id % 10 = 9 THEN 'test'
              ELSE 'train' END AS split
  FROM documents)""",
}

_VIEW_DEPS = {"records": [], "split_records": ["records"], "asst": [],
              "answers": ["asst"], "docs": [], "doc_records": ["docs"]}


def with_views(sql: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of the named views (and their deps)."""
    order: list[str] = []

    def add(v):
        for d in _VIEW_DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    parts = [SQL_VIEWS[v].replace("{DEFAULT_INSTRUCTION}", DEFAULT_INSTRUCTION.replace("'", "''")).strip()
             for v in order]
    if extra:
        parts += [f"{k} AS ({v})" for k, v in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
