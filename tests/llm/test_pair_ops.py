"""Operators 5 and 9 and the pipeline: joins against brute force, planted
leaks, stages on small tables."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notewise.llm import common as C
from notewise.llm import op5_fragment_join as join
from notewise.llm import op9_latent_decontaminate as leaks
from notewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- 5

def brute_groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                parent[find(i)] = find(j)
    ids: dict = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    low = {c: min((d for d in ds if d is not None), default=None) for c, ds in ids.items()}
    return [(rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows))]


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for c in range(4):
        base = [rng.choice(words) for _ in range(rng.choice([40, 80, 120]))]
        for _ in range(50 if c < 2 else 12):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
                kind, p = rng.random(), rng.randrange(len(t))
                if kind < 0.5:
                    t[p] = rng.choice([*words, f"zz{rng.randrange(10 ** 6)}"])
                elif kind < 0.75:
                    del t[p]
                else:
                    t.insert(p, rng.choice(words))
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(30)]
    n = len(rows)
    rows += [(n, ""), (n + 1, None), (n + 2, "one"), (n + 3, "One"), (n + 4, "two words"), (n + 5, rows[3][1]),
             (n + 5, rows[3][1]), (None, "alone without an id here"), (n + 6, " \t\n")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent, options", [
    (3, 90, {}), (3, 90, {"small": 4, "small_in_group": 4}), (3, 90, {"small": 2, "small_in_group": 2, "rounds": 3}),
    (5, 80, {"small": 4, "small_in_group": 8, "spare": 20}), (2, 70, {"small": 3, "rounds": 2, "broadcast_rows": 0})])
def test_groups_equal_brute_force(spark, k, percent, options):
    rows = near_copies(k * percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"n": F.lit(1), "key": F.lit("k"), "e": F.lit(2), "rid": F.lit(3)}).repartition(3)
    got = [tuple(r) for r in join.linked_groups(C.id_and_bytes(df), k, percent, **options).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_groups(rows, k, percent)))


def test_groups_in_many_shares_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(join, "SHARE", 5)
    rows = near_copies(31)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in join.linked_groups(C.id_and_bytes(df), 3, 90, small=4, small_in_group=8).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_groups(rows, 3, 90)))


def test_groups_too_many_to_broadcast_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(join, "SHARE", 5)
    rows = near_copies(37)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in join.linked_groups(C.id_and_bytes(df), 3, 90, small=4, small_in_group=8,
                                                broadcast_rows=0).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_groups(rows, 3, 90)))


def heard_tables(monkeypatch):
    tables, cut = {}, C.cut_lineage

    def heard(df, session, what, **options):
        out = cut(df, session, what, **options)
        tables.setdefault(what, []).append(out)
        return out

    monkeypatch.setattr(C, "cut_lineage", heard)
    return tables


def test_whole_sets_are_kept_of_candidates_alone(spark, monkeypatch):
    tables, rng = heard_tables(monkeypatch), random.Random(12)
    rows = [(i, " ".join(f"x{rng.randrange(10 ** 9)}" for _ in range(200))) for i in range(300)]
    rows += [(300 + i, rows[i][1].rsplit(" ", 1)[0]) for i in range(6)]            # near copies of the first six
    rows += [rows[0], rows[0], (0, rows[0][1].upper())]                            # rows that repeat; a set under one id
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in join.linked_groups(C.id_and_bytes(df), 5, 80, spare=20).collect()]
    assert sorted(got) == sorted(brute_groups(rows, 5, 80))
    kept = tables["join-sets"][0]
    assert not any(c in kept.columns for c in ("f0", "f1", "f2", "f3"))
    assert kept.agg(F.sum(F.size("head"))).first()[0] < 0.3 * kept.agg(F.sum("n")).first()[0]
    pieces = tables["join-fragments"][-1]
    assert pieces.groupBy("rid").count().where(f"count <> {join.FRAGMENTS}").isEmpty()
    assert pieces.select("rid").distinct().count() == 12


def test_pairs_are_dropped_at_the_first_fragments(spark):
    sets = {1: range(0, 40), 2: range(0, 39), 3: range(100, 140), 4: [*range(0, 30), *range(200, 210)]}
    fragments = spark.createDataFrame([(r, i, [x for x in s if x % join.FRAGMENTS == i]) for r, s in sets.items()
                                       for i in range(join.FRAGMENTS)], "rid long, fragment int, hashes array<long>")
    pairs = spark.createDataFrame([(a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b],
                                  "a long, b long, na int, nb int")
    for rows in (0, 1000):
        near = {(r.a, r.b) for r in join.near_by_parity(pairs, fragments, 80, rows).collect()}
        assert near == {(1, 2)}
    got = {(r.a, r.b): r.common for r in join.overlaps(pairs, fragments, 80).collect()}
    assert got == {(1, 2): 39}
    assert {(r.a, r.b): r.common for r in join.overlaps(pairs, fragments, 50).collect()} == {(1, 2): 39, (1, 4): 30, (2, 4): 30}


def test_members_of_large_groups_are_not_joined_with_their_buckets(spark):
    crowded = spark.createDataFrame([(0, e, r, 9) for e in range(30) for r in range(40 if e < 20 else 20)],
                                    "grp long, e long, rid long, n int")
    got = join.groups_of(crowded)
    assert sorted(tuple(r) for r in got.collect()) == [(0, r, 9) for r in range(40)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


@pytest.mark.parametrize("share, width, parts", [(1024, 1 << 16, 1), (3, 5, 1), (2, 7, 5)])
def test_shared_elements_equal_brute_force(spark, monkeypatch, share, width, parts):
    monkeypatch.setattr(join, "SHARE", share)
    monkeypatch.setattr(join, "SLICE", width)
    rng = random.Random(share)
    rows = [(g, r, rng.choice([r, r, -9, -10]), g + 1, rng.sample(range(-30, 30), rng.randrange(12)))
            for g in range(4) for r in range(12)]
    rows += [(9, r, -5, 3, [1, 2, 3]) for r in range(12)]              # nobody need meet
    heads = spark.createDataFrame(rows, "grp long, rid long, who long, slices long, head array<long>").repartition(parts)
    got = [tuple(r) for r in join.shared_elements(heads).collect()]
    who = {}
    for g, _, w, _, head in rows:
        for e in head:
            who.setdefault((g, e), set()).add(w)
    assert sorted(got) == sorted((g, r, e) for g, r, _, _, head in rows for e in head if len(who[g, e]) > 1)


def test_members_meet_in_one_of_their_groups(spark):
    groups = {1: range(0, 8), 2: range(0, 5), 3: range(4, 11), 5: [20, 21], 6: [20, 21]}
    crowded = spark.createDataFrame([(g, r, 9) for g, rids in groups.items() for r in rids], "grp long, rid long, n int")
    members: dict = {}
    for m in join.without_repeats(crowded).collect():
        members.setdefault(m.grp, {})[m.rid] = m.who
        assert m.group_size == len(groups[m.grp])
    assert sorted(members) == [1, 3, 6]
    for g, rids in groups.items():
        for a in rids:
            for b in rids:
                met = [h for h, of in members.items() if a in of and b in of and of[a] != of[b]]
                assert a == b or len(met) >= 1
    assert {r for r in groups[3] if members[3][r] == members[3][4]} == {4, 5, 6, 7}


def test_elements_that_one_member_holds_make_no_rows(spark, monkeypatch):
    tables, rows = heard_tables(monkeypatch), near_copies(14)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in join.linked_groups(C.id_and_bytes(df), 3, 90, small=4, small_in_group=8).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_groups(rows, 3, 90)))
    elements = sum(t.agg(F.sum(F.size("head"))).first()[0] or 0 for t in tables["join-heads"])
    assert 0 < sum(t.count() for t in tables["join-shared"]) < elements
    for t in tables["join-shared"]:
        assert t.groupBy("grp", "e").count().where("count = 1").isEmpty()


def test_join_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op5_fragment_join"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_groups(rows, 3, 90))


def test_join_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert join.linked_groups(C.id_and_bytes(df)).count() == 0
    only_empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in join.linked_groups(C.id_and_bytes(only_empty)).collect()) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_one_of_each_group_stays(spark, broadcast_rows):
    rows = near_copies(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.length("text"))
    got = join.keep_one(df, 5, 80, broadcast_rows=broadcast_rows).collect()
    groups = brute_groups(rows, 5, 80)
    with_words = {(g[2] if g[2] is not None else "none") for g, r in zip(groups, rows) if (r[1] or "").split()}
    empty = [r for r in rows if not (r[1] or "").split()]
    assert len(got) == len(with_words) + len(empty)
    assert {r.doc_id for r in got if (r.text or "").split()} == {None if c == "none" else c for c in with_words}


# ---------------------------------------------------------------- 9

def test_lcs_equals_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 15))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leaks.lcs_length(leaks.masks_of(a), len(a), b) == t[-1][-1]


def test_whole_items_are_found_and_clean_documents_left(spark):
    items = {r.item_id: leaks.words_of(r.text.encode()) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()}
    texts = {r.doc_id: leaks.words_of(r.text.encode()) for r in
             spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_latent_decontaminate"](spark, SF01).collect()}
    verbatim = {(d, i) for d, t in texts.items() for i, w in items.items() if b" %s " % b" ".join(w) in b" %s " % b" ".join(t)}
    assert verbatim and verbatim <= got
    for d, i in got - verbatim:                       # anything else shares most of an item
        t, n = texts[d], len(items[i])
        best = max(leaks.lcs_length(leaks.masks_of(items[i]), n, t[k:k + 2 * n]) for k in range(0, len(t), n // 2 + 1))
        assert best >= 0.5 * n


def test_paraphrases_are_found(spark):
    rng = random.Random(6)
    items = spark.read.parquet(f"{SF01}/benchmark.parquet").collect()
    hosts = spark.read.parquet(f"{SF01}/documents.parquet").select("text").limit(60).collect()
    rows, planted = [], set()
    for k, h in enumerate(hosts):
        words, item = h.text.split(), rng.choice(items)
        own = item.text.split()
        if k % 2 and len(own) >= 15:
            for _ in range(len(own) // 7):
                own[rng.randrange(len(own) - 8)] = f"qz{rng.randrange(99)}"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
            planted.add((k, item.item_id))
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(r.item_id, r.text) for r in items], "item_id long, text string")
    for at_once in (2000, 15):                        # the query set in one block, and in several
        got = {(r.doc_id, h.item_id) for r in leaks.search(df, bench, items_at_once=at_once).collect() for h in r.hits}
        assert len(planted & got) >= 0.95 * len(planted)


def test_thousands_of_items_short_and_long(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(6000)]
    odds = [1 / (i + 20) for i in range(6000)]
    lengths = [rng.choice([6, 9, 14, 22, 33, 40, 64, 65, 150, 300]) for _ in range(2200)]
    items = [rng.choices(vocabulary, odds, k=n) for n in lengths]
    rows, whole, near = [], set(), set()
    for d in range(500):
        words = rng.choices(vocabulary, odds, k=rng.randrange(300))
        for which in rng.sample(range(len(items)), 2):
            own = list(items[which])
            if rng.random() < 0.5 and len(own) >= 14:
                for at in rng.sample(range(len(own)), len(own) // 7):
                    own[at] = f"qz{rng.randrange(99)}"
                near.add((d, which))
            at = rng.choice([0, len(words)])
            words[at:at] = own
        rows.append((d, " ".join(words)))
    packed = [f" {' '.join(w)} " for w in items]
    whole = {(d, i) for d, t in rows for i, p in enumerate(packed) if p in f" {t} "}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, h.item_id) for r in leaks.search(df, bench).collect() for h in r.hits}
    assert len(whole) > 500 and whole <= got
    assert len(near & got) >= 0.95 * len(near)
    texts = {d: t.encode().split() for d, t in rows}
    for d, i in got - whole - near:                   # anything else shares most of an item
        item = [w.encode() for w in items[i]]
        assert leaks.lcs_length(leaks.masks_of(item), len(item), texts[d]) >= 0.5 * len(item)


def test_items_made_of_repeated_words_are_found(spark):
    rng = random.Random(9)
    refrain = "row your boat gently down the silver stream".split()
    table = [str(k) for k in range(100, 112)] * 4
    rng.shuffle(table)
    items = [" ".join(refrain * 3), " ".join(refrain * 20), " ".join(table)]
    rows = [(k, " ".join([f"w{rng.randrange(900)}" for _ in range(40 + 11 * k)] + [items[k % 3]] * (k < 30)
                         + [f"w{rng.randrange(900)}" for _ in range(50)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: {h.item_id: h.lcs_share for h in r.hits} for r in leaks.search(df, bench, common=1.0).collect()}
    assert all(got[k].get(k % 3) == 1.0 for k in range(30)) and not any(got[k] for k in range(30, 60))


def test_leak_edge_rows(spark):
    item = "one of the very rare passages that a benchmark holds and nobody else would write"
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, "x y z " * 4000 + item), (5, "clean words only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hits": F.lit(1), "item_id": F.lit(2)})
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id long, text string")
    out = leaks.search(df, bench, common=1.0).collect()
    assert len(out) == len(rows)
    assert [len(r.hits) for r in out] == [0, 0, 2, 2, 2, 0]
    assert leaks.search(df.limit(0), bench).count() == 0
    assert all(r.hits == [] for r in leaks.search(df, bench.limit(0)).collect())


# ---------------------------------------------------------------- pipeline

def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_duplicates",
                                                      "benchmark_decontamination", "source_mixture"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.cut_lineage(stage(spark, docs, SF01), spark, f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
        gone = set(before) - set(after)
        if name == "quality_classifier":
            assert sum(marks.get(i) == 1 for i in gone) <= 0.02 * len(before)
        if name == "near_duplicates":
            groups = brute_groups(list(before.items()), 5, 80)
            assert set(after) == {c for _, n, c in groups if n} | {i for i, n, _ in groups if not n}
        if name == "benchmark_decontamination":
            hits = leaks.search(spark.createDataFrame(list(before.items()), "doc_id long, text string"),
                                spark.read.parquet(f"{SF01}/benchmark.parquet"))
            assert gone == {r.doc_id for r in hits.collect() if r.hits}
        before = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF01).collect()
    assert {r.doc_id for r in mixed} == set(before) and all(r.taken <= 2 * r.size for r in mixed)


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, hits int"
    long_text = "the day and the night were of one kind to all of them . " * 3000
    rows = [(1, None, None, None, None, 0.0, 1), (2, "", "en", "s", 0, 0.0, 1), (None, "some words of a text", "en", "s", 5, 0.0, 1),
            (4, long_text, "en", "s", 9, 0.0, 1), (4, long_text, "en", "s", 9, 0.0, 1), (5, "and now to it", None, None, 1, 0.0, 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= n
            if name != "source_mixture":
                assert out.columns == docs.columns


def test_jobs_inside_get_small_arrow_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, cut = spark.conf.get(name), C.cut_lineage

    def heard(df, session, what, **options):
        seen.append((what, spark.conf.get(name)))
        return cut(df, session, what, **options)

    monkeypatch.setattr(C, "cut_lineage", heard)
    docs = spark.createDataFrame([(i, f"w{i} " * 2000) for i in range(1000)], "doc_id long, text string").coalesce(1)
    leaks.feature_table(docs.select(F.col("text").alias("_text")), {b"w1": 1})
    join.groups(C.id_and_bytes(docs), words=3, percent=90)
    assert {"passage-features": "4m", "join-sets": "4m"}.items() <= dict(seen).items()
    assert spark.conf.get(name) == before

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    with C.small_batches(spark):
        got = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
    assert len(got) > 1 and max(got) < 5 << 20 and sum(got) > 8 << 20


def test_sketch_is_the_same_in_pieces(spark):
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(400)) for i in range(1, 30)]
    df = spark.createDataFrame([(t,) for t in texts], "_text string").coalesce(1)
    table = leaks.feature_table(df, {b"w%d" % i: i for i in range(97)})
    weight = np.where(np.arange(leaks.FEATURES) < 90, 1.0 + np.arange(leaks.FEATURES) % 7, 0.0)
    whole, omega = leaks.sketch(table, weight, 4, 3, pairs_at_once=1 << 30)
    for n in (1, 100):
        some, same = leaks.sketch(table, weight, 4, 3, pairs_at_once=n)
        assert np.array_equal(omega, same) and np.allclose(some, whole, rtol=1e-5, atol=1e-4)
    assert leaks.passage_cuts(np.array([0, 0, 1, 3, 3, 3]), 1) == [0, 2, 3, 6]
    assert leaks.passage_cuts(np.zeros(0, np.int64), 1) == [0]
