import re

import pytest
from pyspark.sql import functions as F

from notewise.functions.tokens import COUNT_TOKEN_PATTERN
from notewise.operators import sft as S
from notewise.plans.prompts import HDR_END


def test_token_count_matches_python(spark):
    texts = ["<|begin_of_text|>Hello, world!  x_y", "", "é à 12ab", "\t\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(S.token_count("text", extra_bos=False)).collect()]
    assert got == [len(re.findall(COUNT_TOKEN_PATTERN, t)) for t in texts]


def test_labels_last_header_and_none(spark):
    df = spark.createDataFrame([(["a", HDR_END, "b", HDR_END, "c", "d"],), (["x", "y"],)],
                               "tokens array<string>")
    got = [r[0] for r in df.select(S.completion_labels("tokens")).collect()]
    assert got[0] == [-100, -100, -100, -100, 4, 5]
    assert got[1] == [-100, -100]                    # no header marker: nothing supervised


def test_cut_header_is_audited(spark):
    long_note = " ".join(["w"] * 600)
    df = spark.createDataFrame([(1, "train", "ins", long_note, "answer"),
                                (2, "train", "ins", "short", "answer")],
                               "record_id long, split string, instruction string, input string, output string")
    lf = S.label_frame(S.format_training_text(df))
    audit = S.supervision_audit(lf).first()
    assert audit.rows_header_cut == 1
    rows = {r.record_id: r for r in lf.collect()}
    # the answer header was cut: the note is what gets supervised
    assert any(l != -100 for l in rows[1].labels)
    assert rows[2].labels[-3:] != [-100, -100, -100]


def test_length_report_strict_budget(spark):
    df = spark.createDataFrame([("train", 511), ("train", 512), ("test", 10)], "split string, token_count int")
    rep = {r.split: r for r in S.length_report(df).collect()}
    assert rep["train"].n_under == 1 and rep["train"].n_rows == 2
    assert rep["test"].share_under == 1.0


def test_template_trims_padding(spark):
    df = spark.createDataFrame([("ins", "note text", "ans")], "instruction string, input string, output string")
    text = S.format_training_text(df).first().text
    assert "<|start_header_id|>user<|end_header_id|>\n\nnote text<|eot_id|>" in text
    assert text.startswith("<|begin_of_text|><|start_header_id|>system")


def test_tokenizer_hook_counts_and_labels_by_its_ids(spark):
    """A user's tokenizer: whitespace pieces, ids from the length of a piece."""
    df = spark.createDataFrame([("a bb <|end_header_id|> cccc dd",), ("x",), (None,)], "text string")
    count = S.token_count_with(lambda texts: [len((t or "").split()) for t in texts])
    assert [r[0] for r in df.select(count("text")).collect()] == [5, 1, 0]
    toks = df.where("text IS NOT NULL").select(F.split("text", " ").alias("tokens")).withColumn(
        "ids", F.transform("tokens", lambda t: F.length(t)))
    got = [r[0] for r in toks.select(S.completion_labels("tokens", ids="ids")).collect()]
    assert got == [[-100, -100, -100, 4, 2], [-100]]


def test_documents_exercise_the_budget(spark):
    from notewise.plans.catalog import QUERIES
    rows = QUERIES["supervision_audit"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.rows_header_cut for r in rows) > 0


def test_budget_filter_counts_once_after_the_spread(spark):
    from notewise.plans.catalog import QUERIES
    plan = QUERIES["within_token_budget"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_count") + plan.count("regexp_extract_all") == 1
    assert plan.index("Generate") < plan.index("Exchange")       # the plan is printed from the top


def test_null_flags_move_no_text(spark):
    from notewise.plans.catalog import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("null_flags", "null_patterns"):
            plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            above_scan = plan[:plan.index("FileScan")]
            assert "isnull(text" in above_scan
            exchanges = [line for line in above_scan.splitlines() if "Project" in line and "isnull(text" in line]
            assert exchanges and "text#" not in above_scan.split("isnull(text")[0].replace("text_null#", "")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_tokenizer_gets_blocks_of_bounded_bytes(spark):
    def small_blocks(texts):
        if sum(len(t or "") for t in texts) > 2 << 20:
            raise ValueError("too much text at once")
        return texts

    def lengths(texts):
        return [len(t or "") for t in small_blocks(texts)]

    def ids(texts):
        return [[len(t), ord(t[0])] for t in small_blocks(texts)]

    rows = [(i, None if i % 5 == 0 else chr(97 + i % 26) * (300_000 + i)) for i in range(23)] + [(23, "é" * 800_000)]
    df = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    got = df.select("k", S.token_count_with(lengths)("text").alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: len(t or "") for k, t in rows}
    got = df.select("k", S.token_ids_with(ids)("text").alias("ids")).collect()
    assert {r.k: r.ids for r in got} == {k: None if t is None else [len(t), ord(t[0])] for k, t in rows}


def test_a_tokenizer_that_loses_a_text_is_an_error(spark):
    df = spark.createDataFrame([("a b",), (None,), ("c",)], "text string").coalesce(1)
    for udf in (S.token_count_with(lambda texts: [1] * (len(texts) - 1)), S.token_ids_with(lambda texts: [[1]]),
                S.token_ids_with(lambda texts: [[1]] * 3)):
        with pytest.raises(Exception, match="the tokenizer returned"):
            df.select(udf("text").alias("x")).collect()
