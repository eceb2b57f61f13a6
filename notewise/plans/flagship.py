"""The flagship question: what is the mean ROUGE-L of each refinement step
against the final answer? (steps view -> tokens -> LCS -> ROUGE-L -> mean)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.operators.evaluate import corpus_rouge
from notewise.operators.rouge import score_pairs
from notewise.session import ship_package
from notewise.sources import testdata as td


def step_rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    scored = score_pairs(td.steps(spark, sf_dir), metrics=("rougeL",),
                         keep=["method", "step", "record_id"])
    c = corpus_rouge(scored, metrics=("rougeL",))
    return c.select("method", "step", "metric",
                    *[F.round(k, 6).alias(k) for k in ("precision", "recall", "fmeasure")],
                    "n_pairs")
