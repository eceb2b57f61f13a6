"""Corpus pipeline over `documents`: quality, language, near duplicates,
benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a caller
writes it as Parquet and reads it again as the next stage's ``docs``. All but
the last return the columns of ``documents``.

Every stage works on all rows that it gets: repeated rows, rows with a null
or empty text or a null id included. A text without a word is nobody's near
duplicate and no leak; without a letter it has no language and goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewise.llm import common as C
from notewise.llm import op5_fragment_join as join
from notewise.llm import op6_byte_cnn as cnn
from notewise.llm import op8_fair_queue_mix as queue
from notewise.llm import op9_latent_decontaminate as leaks
from notewise.llm import op10_kneser_ney_langid as langid


def _rows_that(docs: DataFrame, judge, condition: str) -> DataFrame:
    """Rows of ``docs`` for which an operator's verdict meets a condition.
    Columns bear their places as names while the operator adds its own."""
    own = [f"_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    judged = judge(docs.toDF(*own), id_col=at["doc_id"], text_col=at["text"], keep=tuple(own))
    return judged.where(condition).select(*own).toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores 0.3 or more."""
    net = cnn.learn(docs, cnn.training_labels(C.table(spark, sf_dir, "labels")))
    return _rows_that(docs, lambda d, **of: cnn.classify(d, net, **of), "score >= 0.3")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models accept."""
    model = langid.learn(langid.training_rows(docs))
    return _rows_that(docs, lambda d, **of: langid.identify(d, model, **of), "NOT rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 80 percent:
    the one with the smallest id. Texts without a word all stay."""
    return join.keep_one(docs, words=5, percent=80, spare=20)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = C.table(spark, sf_dir, "benchmark")
    return _rows_that(docs, lambda d, **of: leaks.search(d, items, **of), "size(hits) = 0")


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document."""
    return queue.mix(queue.sized(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
]
#: Learned models and hash joins have no SQL form; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.cut_lineage(stage(spark, docs, sf_dir), spark, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
