import random


import pyrouge
from notewise.operators import rouge as R

METRICS = R.ALL_METRICS


def score_rows(spark, pairs):
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(pairs)],
                               "record_id long, candidate string, reference string")
    out = R.score_pairs(df, metrics=METRICS, keep=["record_id"]).orderBy("record_id").collect()
    return [{m: (row[m].precision, row[m].recall, row[m].fmeasure) for m in METRICS} for row in out]


def close(a, b):
    return all(abs(x - y) < 1e-12 for x, y in zip(a, b))


def test_edge_rows(spark):
    pairs = [
        ("x y z", "x y z"),          # identical
        ("a b", "c d"),              # nothing in common
        ("a", "a"),                  # one token: no bigram
        ("a a a", "a"),              # repeated candidate token
        ("---", "a"),                # no ASCII alphanumerics
        ("a b c d", "b d a d"),      # crossing order
        ("a b c\nd e f", "d e f\na b c"),   # swapped sentence lines
    ]
    s = score_rows(spark, pairs)
    assert all(close(s[0][m], (1, 1, 1)) for m in METRICS)
    assert all(close(s[1][m], (0, 0, 0)) for m in METRICS)
    assert close(s[2]["rouge1"], (1, 1, 1)) and close(s[2]["rouge2"], (0, 0, 0))
    assert close(s[2]["rougeL"], (1, 1, 1))
    assert close(s[3]["rouge1"][:2], (1 / 3, 1.0))
    assert all(close(s[4][m], (0, 0, 0)) for m in METRICS)
    assert R.lcs_length("a b c d".split(), "b d a d".split()) == 2
    assert close(s[5]["rougeL"][:2], (0.5, 0.5))
    assert close(s[6]["rougeLsum"], (1, 1, 1))
    assert s[6]["rougeL"][2] < 1


def _rand_text(rng, vocab, n_lines):
    lines = []
    for _ in range(n_lines):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 12))]
        lines.append(" ".join(words) + rng.choice(["", ".", " !", ", "]))
    return "\n".join(lines)


def test_random_pairs_match_bruteforce(spark):
    rng = random.Random(7)
    vocab = ["a", "b", "c", "d", "e", "Ab", "x1", "é", "--", "z"]
    pairs = [(_rand_text(rng, vocab, rng.randint(0, 4)), _rand_text(rng, vocab, rng.randint(0, 4)))
             for _ in range(300)]
    got = score_rows(spark, pairs)
    for (c, r), g in zip(pairs, got):
        exp = pyrouge.score(r, c)
        for m in METRICS:
            assert close(g[m], exp[m]), (m, c, r, g[m], exp[m])


def test_properties(spark):
    rng = random.Random(3)
    vocab = list("abcdefg")
    pairs = [(_rand_text(rng, vocab, 2), _rand_text(rng, vocab, 2)) for _ in range(100)]
    fwd = score_rows(spark, pairs)
    back = score_rows(spark, [(r, c) for c, r in pairs])
    for f, b in zip(fwd, back):
        for m in METRICS:
            assert all(0 <= v <= 1 for v in f[m])
        for m in R.METRICS:     # the summary-level union LCS is not symmetric
            assert close((f[m][0], f[m][1]), (b[m][1], b[m][0]))   # swap sides swaps P and R
        assert f["rougeL"][2] <= f["rouge1"][2] + 1e-12


def test_lcs_kernel_long_inputs():
    rng = random.Random(1)
    a = [rng.choice("abcd") for _ in range(300)]
    b = [rng.choice("abcd") for _ in range(250)]
    assert R.lcs_length(a, b) == pyrouge.lcs_table(a, b)[-1][-1]
    assert R.lcs_length(a, b) == R.lcs_length(b, a)
    assert R.lcs_length(a, b) <= min(len(a), len(b))


def test_lcs_positions_are_those_of_the_whole_table():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        t = pyrouge.lcs_table(a, b)
        want, i, j = [], len(a), len(b)
        while i > 0 and j > 0:
            if a[i - 1] == b[j - 1]:
                want.append(i - 1)
                i, j = i - 1, j - 1
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
        assert R._lcs_ref_indices(a, b) == want[::-1]


def test_long_single_line_needs_little_memory():
    import tracemalloc
    rng = random.Random(2)
    a, b = ([rng.choice("abcdefgh") for _ in range(6000)] for _ in range(2))
    tracemalloc.start()
    R.summary_lcs_hits([a], [b])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000            # a row per token would be 6000 * 800 bytes


def test_null_texts_score_zero(spark):
    for s in score_rows(spark, [(None, "a b"), ("a b", None), (None, None), ("", "a")]):
        assert all(s[m] == (0, 0, 0) for m in METRICS)


def test_one_python_stage_and_one_pass_over_the_text(spark):
    df = spark.createDataFrame([(1, "a b", "a c")], "record_id long, candidate string, reference string")
    plan = R.score_pairs(df, metrics=METRICS, keep=["record_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(lower(candidate") == 1
    assert plan.count("ArrowEvalPython") == 1
