"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewise.llm import op11_centroid_clusters as km
from notewise.llm import op12_window_packing as pk
from notewise.llm import op13_divergence_audit as dv

SF001 = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- 11

def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cent = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cent))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cent = [[sum(x) // len(own[i]) for x in zip(*own[i])] if own[i] else c for i, c in enumerate(cent)]
    got = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, c in got:
        total[c] += d
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest())
                   for i, d, c in got), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance int")


def test_clusters_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i % 50, [rng.gauss(rng.choice((-1, 1)), 0.3) for _ in range(4)], "x", 0) for i in range(80)]
    rows += [(7, [0.5, -0.5, 0.25, 0.0], "x", 0)] * 3
    got = km.cluster(vectors(spark, rows), k=5, rounds=3, dims=4).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters([r[:2] for r in rows], 5, 3, 4)


def test_cluster_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0], None, 1), (1, [0.0, 1.0], None, 1), (None, [2.0, 2.0], None, 1), (2, None, "a", 1), (3, [], "a", 1),
            (4, [1.0], "a", 1), (5, [1.0, 2.0, 3.0], "a", 1), (6, [nan, 0.0], "a", 1), (7, [inf, 0.0], "a", 1),
            (8, [None, 0.0], "a", 1), (9, [1e300, 0.0], "a", 1)]
    df = vectors(spark, rows)
    got = km.cluster(df, k=16, rounds=2, dims=2).collect()
    assert Counter(r.vec_id for r in got) == {1: 2, None: 1}
    assert all(r.distance == 0 and r.inertia == 0 for r in got)
    # two centroids are the same vector: the smaller number gets both
    assert len({r.cluster for r in got if r.vec_id == 1}) == 1
    assert km.cluster(df.limit(0), dims=2).collect() == []
    assert km.cluster(df, dims=2).dtypes == km.cluster(df.limit(0), dims=2).dtypes


def test_cluster_plan_has_no_python(spark):
    v = km.whole_vectors(vectors(spark, [(1, [0.0, 1.0], "", 0)]), dims=2)
    plan = v.select(km.nearest("v", [[0, 64]]).alias("x"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "array_min" in plan


# ---------------------------------------------------------------- 12

@pytest.fixture(scope="module")
def encoder():
    return pk.Encoder(pk.VOCABULARY)


def whole_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check_pieces(rows, texts, encoder, width):
    """Every id in one piece, sequences gapless; (padding, tokens)."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    pad = total = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= width
        total += at
        pad += 0 if at & (at - 1) == 0 else width - at
    assert Counter({i: sum(p[1] for p in ps) for i, ps in docs.items()}) == Counter(
        {i: len(whole_ids(encoder, t)) for i, t in texts.items()})
    for i, parts in docs.items():
        ids, at = np.array(whole_ids(encoder, texts[i]), "<u4"), 0
        for start, length, crc, n in sorted(parts):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start:start + length].tobytes())
            at += length
        assert at == len(ids)
    return pad, total


def test_packing_over_a_table(spark, encoder):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pad, total = check_pieces(pk.op12_window_packing(spark, SF001).collect(), texts, encoder, 2048)
    assert pad < 0.01 * total


def test_packing_odd_texts(spark, encoder):
    texts = {1: None, 2: "", 3: "one two three. " * 400, 4: "x" * 5000, 5: "a <|endoftext|> b", 6: "\n\n \t\x0b",
             7: "Éa 漢字。次 " * 90, 8: "no end here " * 700}
    df = spark.createDataFrame([(i, t, i, "s") for i, t in texts.items()], "doc_id long, text string, start long, length string")
    for hold in (64, 1 << 20):      # small: many flushes, also inside a document
        rows = pk.pack(df.coalesce(1), width=128, hold=hold).collect()
        check_pieces(rows, texts, encoder, 128)
    same = spark.createDataFrame([(5, "a b")] * 3 + [(None, "c")], "doc_id long, text string")
    assert Counter(r.doc_id for r in pk.pack(same).collect() if r.start == 0) == {5: 3, None: 1}
    assert pk.pack(df.limit(0)).collect() == []
    assert sorted(pk.pack(df, width=128).collect()) == sorted(pk.pack(df, width=128).collect())


def test_fast_encoding_is_the_tokenizers(encoder):
    rng = random.Random(2)
    signs = [" ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'LL", ".", "!", "7", "Ⅷ", "é", "ß", "漢", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) if rng.random() < 0.6 else chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(
            0x250, 0xD800), rng.randrange(0xE000, 0x30000)))) for _ in range(rng.randrange(1, 30)))
        got = [i for ids, _ in encoder.parts(text, chars=5) for i in ids.tolist()]
        assert got + [1] == whole_ids(encoder, text), repr(text)


def brute_cost(places, fees, width):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= width:
                pad = 0 if n & (n - 1) == 0 and n >= width // 8 else width - n
                cost = best[i] + pad + fees[j] + pk.WINDOW
                best[j] = cost if best[j] is None else min(best[j], cost)
    return best[-1]


def test_windows_cost_the_least():
    rng = np.random.default_rng(1)
    for _ in range(60):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 30, size=rng.integers(1, 60)))])
        fees = rng.integers(0, 30, size=len(places))
        cuts = pk.window_ends(places, fees, 64)
        assert cuts[0] == 0 and cuts[-1] == places[-1] and max(np.diff(cuts)) <= 64
        at = {p: i for i, p in enumerate(places.tolist())}
        cost = sum((0 if n & (n - 1) == 0 and n >= 8 else 64 - n) + int(fees[at[b]]) + pk.WINDOW
                   for a, b in zip(cuts, cuts[1:]) for n in (int(b) - int(a),))
        assert cost == brute_cost(places.tolist(), fees.tolist(), 64)


# ---------------------------------------------------------------- 13

def brute_audit(rows, min_docs, top):
    texts = [(lang or "", source or "", (text or "").encode().translate(dv.FOLD).decode().split(" "))
             for text, lang, source in rows]
    texts = [(lang, s, [t for t in ts if t]) for lang, s, ts in texts]
    df, counts, groups = Counter(), Counter(), {(lang, s) for lang, s, _ in texts}
    for lang, s, ts in texts:
        df.update((lang, t) for t in set(ts))
        counts.update((lang, s, t) for t in ts)
    vocab = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= min_docs:
            vocab[lang].append(t)

    def p(lang, sources, t):
        n = sum(counts[lang, s, w] for s in sources for w in vocab[lang])
        return 1 + 10 ** 9 * (sum(counts[lang, s, t] for s in sources) + 5) // (n + 5 * len(vocab[lang]))
    out = []
    for lang, s in groups:
        others = [x for g, x in groups if g == lang]
        part = {"pair": [(sum(abs(p(lang, [s], t) - p(lang, [x], t)) for t in vocab[lang]), x) for x in others if x != s],
                "term": [(p(lang, [s], t) - p(lang, others, t), t) for t in vocab[lang] if counts[lang, s, t]]}
        part["term"] = [x for x in part["term"] if x[0] > 0]
        for name, values in part.items():
            ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, name, item, v, i + 1) for i, (v, item) in enumerate(ranked) if name == "pair" or i < top]
    return sorted(out)


def test_audit_matches_brute_force(spark):
    rng = random.Random(9)
    words = ["Alpha", "beta", "gamma", "Éclair", "éclair", "delta2x", "漢字", "o'neil", "zeta"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 12))), rng.choice(["en", "fr", "a:b", ""]),
             rng.choice(["s1", "s2", "s:3"])) for _ in range(120)]
    rows += [(None, "en", "s1"), ("beta beta", None, None), ("", "xx", "lonely"), ("alpha", "xx", "other")] + [("beta zeta", "en", "s9")] * 5
    df = spark.createDataFrame([(i, *r, "u") for i, r in enumerate(rows)], "value long, text string, lang string, source string, item string")
    want = brute_audit(rows, 8, 3)
    assert sorted(map(tuple, dv.audit(df, min_docs=8, top=3).collect())) == want
    # the same from a vocabulary in blocks
    assert sorted(map(tuple, dv.audit(df, min_docs=8, top=3, terms_at_once=4).collect())) == want


def test_audit_without_terms_or_rows(spark):
    df = spark.createDataFrame([("a b", "en", "x"), (None, "en", "y"), ("c", None, None)], "text string, lang string, source string")
    assert sorted(map(tuple, dv.audit(df).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert dv.audit(df.limit(0)).collect() == []
