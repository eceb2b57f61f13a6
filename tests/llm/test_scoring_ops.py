"""Operators 1, 3, 6 and 10: language model, quality rules, quality
classifier, language ID; against brute force or held-out accuracy."""
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewise.llm import common as C
from notewise.llm import op1_hmm_lm as lm
from notewise.llm import op3_gbt_quality as gbt
from notewise.llm import op6_byte_cnn as cnn
from notewise.llm import op10_kneser_ney_langid as kn
from notewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0D]+")
ROWS = [(1, "The cat sat. The cat sat."), (2, None), (3, ""), (4, " \t\n "), (5, "word " * 3000), (5, "word " * 3000),
        (None, "no id here"), (7, "A B   C\u0085D")]


def frame(spark, rows=ROWS):
    """Rows with further columns of clashing names."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"n": F.lit(1), "word": F.lit("x"), "score": F.lit(2.0), "key": F.lit("k"), "_text": F.lit("t")})


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# ---------------------------------------------------------------- 1

def test_base_score_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    train = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            train.update([*WORD.findall(lower(r.text)), "\n"])
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in QUERIES["op1_hmm_lm"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        toks = [*WORD.findall(lower(r.text)), "\n"]
        g = got[r.doc_id]
        assert (g.n_tokens, g.train_tokens) == (len(toks), n)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert g.n_known == sum(t in train for t in toks)
        assert math.isclose(g.base_score, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in toks), rel_tol=1e-9)
        assert math.isfinite(g.score) and g.score < 0


def test_model_beats_the_base_on_held_out_text(spark):
    g = QUERIES["op1_hmm_lm"](spark, SF01).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert g[1] > g[0]


def test_rare_words_joined_and_broadcast_agree(spark):
    docs = C.id_and_bytes(spark.read.parquet(f"{SF}/documents.parquet"))
    a, b = ({r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(docs, docs, wide=w, passes=1, parts=2).collect()}
            for w in (1 << 20, 50))
    assert a == b


def test_forward_is_the_sum_over_all_paths_and_counts_match(spark):
    rng = np.random.default_rng(0)
    k, m = 3, 5
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = lm.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, m))).T)
    seqs = [rng.integers(0, m, size=n) for n in (4, 1, 6)]
    acc = lm._empty(m, k)
    lm._expected(model, seqs, acc)
    emit = np.zeros((m, k))
    for s, got in zip(seqs, lm._forward(model, seqs)):
        total, own = 0.0, np.zeros((m, k))
        for z in itertools.product(range(k), repeat=len(s)):
            p = model.start[z[0]] * model.emit[s[0], z[0]]
            for t in range(1, len(s)):
                p *= model.trans[z[t - 1], z[t]] * model.emit[s[t], z[t]]
            total += p
            for t, o in enumerate(s):
                own[o, z[t]] += p
        assert math.isclose(got, math.log(total), rel_tol=1e-12)
        emit += own / total
    assert np.allclose(acc["emit"], emit, rtol=1e-4)
    assert math.isclose(acc["trans"].sum(), sum(len(s) - 1 for s in seqs), rel_tol=1e-4)


@pytest.mark.parametrize("block", [1, 3, 7, 50, 1000])
def test_texts_in_blocks_give_the_counts_of_whole_texts(block):
    rng = np.random.default_rng(block)
    k, m = 4, 9
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = lm.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, m))).T)
    seqs = [rng.integers(0, m, size=n) for n in (1, 2, 40, 3, 129, 7, 50, 1)]
    whole, cut = lm._empty(m, k), lm._empty(m, k)
    lm._expected(model, seqs, whole)
    lm._expected_of_all(model, iter(seqs), cut, block, 60)
    for name in whole:
        assert np.allclose(whole[name], cut[name], rtol=1e-4, atol=1e-5)


def test_lm_takes_any_id_type(spark):
    docs = C.id_and_bytes(frame(spark).select(F.concat(F.lit("id-"), "doc_id").alias("doc_id"), "text"))
    out = lm.score(docs, docs, passes=1, parts=2).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted("None" if i is None else f"id-{i}" for i, _ in ROWS)


def test_lm_edge_rows(spark):
    docs = C.id_and_bytes(frame(spark))
    out = lm.score(docs, docs, passes=1, parts=2).collect()
    assert len(out) == len(ROWS)
    assert sorted(r.n_tokens for r in out if r.doc_id in (2, 3, 4)) == [1, 1, 1]
    assert len({(r.base_score, round(r.score, 6)) for r in out if r.doc_id == 5}) == 1
    assert next(r for r in out if r.doc_id == 7).n_tokens == 4      # three words and the end
    assert lm.score(docs.limit(0), docs, passes=1, parts=2).count() == 0
    empty = lm.score(docs, docs.limit(0), passes=1, parts=2).collect()
    assert len(empty) == len(ROWS) and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in empty)


# ---------------------------------------------------------------- 3

def numbers(t):
    t = t or ""
    words = WORD.findall(t)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    earlier, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated))


def test_statistics_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in rows] + [
        (1000 + i, "".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\t", "a b a", " ", "|"]) for _ in range(60)))
        for i in range(200)] + ROWS
    for _, t in rows:
        assert gbt.document_numbers((t or "").encode())[:5] == numbers(t)


def test_quality_query(spark):
    got = QUERIES["op3_gbt_quality"](spark, SF01).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        n, _, _, _, rep = numbers(text[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    judged = [(r.kept, marks[r.doc_id]) for r in got if r.doc_id in marks and not r.base_failed]
    assert sum(k == (m == 1) for k, m in judged) > 0.97 * len(judged)


def test_trees_obey_their_constraints_and_walk_right():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=3000)) > 0).astype(float)
    trees = gbt.boost(x, y, [1, -1, 0, 1], trees=30)
    base = rng.random((200, 4))
    for j, sign in ((0, 1), (1, -1), (3, 1)):
        grid = np.repeat(base, 21, axis=0)
        grid[:, j] = np.tile(np.linspace(-1, 2, 21), len(base))
        steps = np.diff(trees.score(grid).reshape(-1, 21), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8
    one = x[:50]                                    # node arrays walked by hand
    for row, got in zip(one, trees.score(one)):
        z = trees.bias
        for i in trees.roots:
            while trees.feature[i] >= 0:
                i = trees.left[i] if row[trees.feature[i]] <= trees.at[i] else trees.right[i]
            z += trees.value[i]
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_quality_edge_rows(spark):
    stats = gbt.statistics(C.id_and_bytes(frame(spark)))
    none = spark.createDataFrame([], "doc_id long, label int")
    out = gbt.judge(stats, gbt.learn(stats, none)).withColumn("f", gbt.base_failed()).collect()
    assert len(out) == len(ROWS) and all(r.score == 0.5 for r in out)
    assert all(r.f for r in out)                       # short, or one word over and over
    assert gbt.judge(stats.limit(0), gbt.boost(np.zeros((0, 1)), np.zeros(0), [0])).count() == 0


# ---------------------------------------------------------------- 6

def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = bytes((i * 7 + i // 256) % 255 + 1 for i in range(n))
        c = cnn.chunks(text)
        joined = c[0].tobytes() + b"".join(x[cnn.OVERLAP:].tobytes() for x in c[1:])
        assert joined[:n] == text and not any(joined[n:])


def test_pooling_in_blocks_equals_whole_texts():
    net = cnn.Network(1)
    rng = random.Random(1)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (0, 5, 700, 30_000, 512, 3000)]
    one = np.concatenate([net.pooled([t], block=10_000) for t in texts])
    assert np.allclose(net.pooled(texts, block=7), one, atol=1e-5)
    for t, row in zip(texts, one):                     # a plain loop over all windows
        tops = []
        for c in cnn.chunks(t):
            r = [net.embed[c[p:p + cnn.WIDTH]].reshape(-1) @ net.filters
                 for p in range(0, cnn.CHUNK - cnn.WIDTH + 1, cnn.STRIDE)]
            tops.append(np.maximum(np.max(r, axis=0) + net.bias, 0))
        assert np.allclose(row, np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)]), atol=1e-4)
        if len(t) > 1000:
            break


def test_classifier_finds_held_out_junk(spark):
    got = QUERIES["op6_byte_cnn"](spark, SF01)
    marks = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", "quality")
    rows = got.where("held_out").join(marks, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()
    clean = [r.predicted for r in rows if r.quality == 1]
    junk = [r.predicted for r in rows if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.5 * len(junk)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_classifier_edge_rows(spark):
    df = frame(spark)
    net = cnn.learn(df, spark.createDataFrame([], "doc_id long, label int"), epochs=1)
    out = cnn.classify(df, net, keep=("n", "key")).collect()
    assert len(out) == len(ROWS) and all(r.score == 0.5 for r in out) and out[0].key == "k"
    one_kind = cnn.learn(df, spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, label int"), epochs=1)
    assert all(r.score > 0.9 for r in cnn.classify(df, one_kind).collect())
    both = cnn.learn(df, spark.createDataFrame([(1, 1), (5, 0), (9, 1)], "doc_id long, label int"), epochs=2)
    assert all(0 <= r.score <= 1 for r in cnn.classify(df, both).collect())
    assert cnn.classify(df.limit(0), both).count() == 0


# ---------------------------------------------------------------- 10

TEXTS = {"en": ["the cat sat on the mat and the dog ran", "this is the day that the man was here"],
         "de": ["die katze und der hund sind auf dem weg", "das ist der tag und die nacht ist lang"]}


def test_probabilities_sum_to_one_in_every_context():
    model = kn.Model(TEXTS, order=3)
    alphabet = sorted({c for ts in TEXTS.values() for t in ts for c in t})
    for context in ("th", "qq", " d", "x", ""):
        total = np.zeros(2)
        for ch in alphabet:
            a, _, _ = kn.characters([context + ch], 3)
            whole, n, _ = model.cross_entropy([context + ch])
            before, m, _ = model.cross_entropy([context]) if context.strip() or context else (np.zeros((1, 2)), [0], 0)
            total += np.exp(-(whole[0] * n[0] - before[0] * m[0]))
        unseen = model.cross_entropy([context + "一"])
        rest = unseen[0][0] * unseen[1][0] - (before[0] * m[0])
        assert np.allclose(total + np.exp(-rest), 1, atol=2e-3), (context, total)


def test_sorted_table_finds_all_and_only_its_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, size=5000, dtype=np.uint64) * np.uint64(2))
    table = kn.Table(keys.copy(), np.zeros((len(keys), 1)), np.zeros((len(keys), 1)))
    assert (table.keys[table.find(keys)] == keys).all() and (table.find(keys + np.uint64(1)) == -1).all()


def test_language_of_held_out_documents(spark):
    got = QUERIES["op10_kneser_ney_langid"](spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.01 * len(rows)


FOREIGN = [
    "Вчера вечером мы долго гуляли по городу и говорили о том, что будет завтра с нашей страной. " * 3,
    "昨天晚上我们在城里走了很久，谈论着明天会发生什么事情，大家都很高兴。" * 4,
    "Wczoraj wieczorem długo spacerowaliśmy po mieście i rozmawialiśmy o tym, co się jutro wydarzy. " * 3,
    "Eilen illalla kävelimme pitkään kaupungilla ja puhuimme siitä, mitä huomenna tapahtuu meille. " * 3,
    "Dün akşam şehirde uzun süre yürüdük ve yarın ülkemizde neler olacağını konuştuk arkadaşlarla. " * 3,
    "xq zvkj wpfh qqtz bnxr jjkw vzzp hqxw ktrq pzvb xkcd wqjh zzxv bqkp rtxz hjqw vkpz xxqj wzrk " * 3]


@pytest.mark.parametrize("rare", [1, 2, 4])
def test_foreign_text_is_rejected_beside_rare_languages_and_long_texts(spark, rare):
    by: dict = {}
    for r in spark.read.parquet(f"{SF01}/documents.parquet").where("lang IS NOT NULL").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    few, long, *others = sorted(by, key=lambda k: len(by[k]))
    text = " ".join(by[long][1::2])
    rows = [(few, t) for t in by[few][:rare]] + [(long, text * (1 + 1_600_000 // len(text)))]
    rows += [(k, t) for k in others for t in by[k]]
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = kn.learn(df)
    assert model.predict(FOREIGN, 16.0)[2].all()
    for lang, texts in ((few, by[few][rare:]), (long, by[long][::2])):
        best, _, rejected = model.predict(texts, 16.0)
        assert (best == model.langs.index(lang)).mean() >= 0.9 and rejected.mean() <= 0.1


def test_language_edge_rows(spark):
    rows = ROWS + [(8, "123 !!! 456"), (9, "THE DAY AND THE NIGHT")]
    model = kn.Model(TEXTS, order=3)
    model.calibrate(TEXTS)
    out = {(r.doc_id): r for r in kn.identify(frame(spark, rows), model, keep=("key",)).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (2, 3, 4, 8))
    assert out[9].lang_pred == "en" and out[9].key == "k"
    assert kn.identify(frame(spark).limit(0), model).count() == 0
    untaught = kn.identify(frame(spark), None).collect()
    assert len(untaught) == len(ROWS) and {r.lang_pred for r in untaught} == {"und"}
    assert kn.learn(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
                    .where("lang IS NOT NULL")) is None


@pytest.mark.parametrize("name", ["op1_hmm_lm", "op3_gbt_quality", "op6_byte_cnn", "op10_kneser_ney_langid"])
def test_one_row_per_document(spark, name):
    got = QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_words_are_looked_up_once_whatever_the_bound():
    classes, freq = lm.Classes([b"a", b"b"], 7), {b"a": 9, b"b": 5, b"rare1": 1}
    texts = [[b"a", b"rare1", b"a", b"new"], [b"b"], [b"w%d" % i for i in range(20)] + [b"a"], [b"new", b"b"]]
    for bound in (1, 3, 100):
        known = lm.KnownWords(classes, freq, bound)
        for w in texts:
            ids, logs = known.look_up(w)
            assert ids.tolist() == [classes.class_of(x) for x in w]
            assert logs.tolist() == [np.log10(freq[x] + 1) if x in freq else -1.0 for x in w]


def test_layout_is_step_by_step():
    seqs = [np.array(s) for s in ([1, 2], [3], [4, 5, 6], [7, 8, 9])]
    order, by_step, begin, active = lm._layout(seqs)
    assert order.tolist() == [2, 3, 0, 1] and begin.tolist() == [0, 4, 7] and active.tolist() == [4, 3, 2]
    assert by_step.tolist() == [4, 7, 1, 3, 5, 8, 2, 6, 9]
