import re

from hypothesis import given, settings, strategies as st

import pyrouge
from notewise.functions.tokens import COUNT_TOKEN_PATTERN, count_tokens, ngrams, rouge_tokens, scoring_text
from notewise.operators.rouge import multiset_overlap

PIECES = st.sampled_from(list("aAzZ09 \n\t.,;-éÉßİKΣσ<|>_") + ["<|eot_id|>", "\u00a0", "x1"])
TEXTS = st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=1, max_size=25)


@settings(max_examples=12, deadline=None)
@given(TEXTS)
def test_rouge_tokens_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(rouge_tokens("t")).collect()]
    assert got == [pyrouge.tokenize(t) for t in texts]


@settings(max_examples=12, deadline=None)
@given(TEXTS)
def test_count_tokens_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(count_tokens("t")).collect()]
    assert got == [len(re.findall(COUNT_TOKEN_PATTERN, t)) for t in texts]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=12),
                          st.lists(st.sampled_from("abcd"), max_size=12)), min_size=1, max_size=20))
def test_multiset_overlap_and_bigrams(spark, pairs):
    from collections import Counter
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                               "i int, a array<string>, b array<string>")
    rows = df.orderBy("i").select(ngrams("a", 2).alias("g")).collect()
    for (a, b), r in zip(pairs, rows):
        assert multiset_overlap(a, b) == sum((Counter(a) & Counter(b)).values())
        ga = [f"{x} {y}" for x, y in zip(a, a[1:])]
        assert r.g == ga


@settings(max_examples=12, deadline=None)
@given(TEXTS)
def test_scoring_text_splits_into_the_same_tokens(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(scoring_text("t")).collect()]
    assert [g.split() for g in got] == [pyrouge.tokenize(t) for t in texts]
    assert [g.count("\n") for g in got] == [t.count("\n") for t in texts]


def test_missing_path_raises(spark):
    import pytest
    from pyspark.errors import PySparkException
    from notewise.sources.records import read_records
    with pytest.raises(PySparkException):
        read_records(spark, "/tmp/does-not-exist-nw/records.json").collect()
