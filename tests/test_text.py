import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from notewise.functions import text as X


def py_clean(t):
    t = t.replace("\n", " ")
    t = re.sub(" +", " ", t)
    return t.strip()


def run(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn("t")).collect()]


def test_clean_whitespace_edges(spark):
    texts = ["\ta b\n  c  ", "a\tb", "x\r\ny", "  ", "", " lead", "a  b"]
    got = run(spark, texts, X.clean_text)
    assert got == [py_clean(t) for t in texts]
    assert got[0] == "a b c"
    assert got[1] == "a\tb"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n\t\r  　\x1c.")), max_size=20),
                min_size=1, max_size=20))
def test_clean_matches_python_and_is_idempotent(spark, texts):
    got = run(spark, texts, X.clean_text)
    assert got == [py_clean(t) for t in texts]
    assert run(spark, got, X.clean_text) == got


def test_whitespace_set_is_python_strip():
    assert len(X.PY_WHITESPACE) == 29
    assert all(c.isspace() for c in X.PY_WHITESPACE)
    assert (X.PY_WHITESPACE + "x" + X.PY_WHITESPACE).strip() == "x"


def test_single_prompt_null(spark):
    df = spark.createDataFrame([("i", None), ("i", "n")], "instruction string, input string")
    got = [r[0] for r in df.select(X.single_prompt()).collect()]
    assert got == [None, "i n"]


def test_parse_list_and_terminators(spark):
    df = spark.createDataFrame([("a; b ;; c ", "ans<|eot_id|>junk</s>")], "l string, g string")
    row = df.select(X.parse_list("l").alias("p"), X.cut_at_terminator("g").alias("c")).first()
    assert row.p == ["a", "b", "c"]
    assert row.c == "ans"


def test_strip_prompt(spark):
    df = spark.createDataFrame([("PROMPTnew text", "PROMPT"), ("other", "PROMPT")], "d string, p string")
    assert [r[0] for r in df.select(X.strip_prompt("d", "p")).collect()] == ["new text", "other"]
