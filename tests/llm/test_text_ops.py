"""Operators 2, 4, 7 and 8: extraction, separator scan, chat format, mixing;
against brute force, exact round trips or DuckDB."""
import hashlib
import json
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notewise.llm import op2_block_rules as rules
from notewise.llm import op4_separator_scan as scan
from notewise.llm import op7_chat_format as chat
from notewise.llm import op8_fair_queue_mix as queue
from notewise.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- 2

LONG = ("It was the day on which all of the people of the town had come to the market to see what "
        "there was to be seen, and none of them went home before the night.")
PAGE = f"""<html><head><title>t</title><script>var a = "<p>{LONG}</p>";</script></head><body>
<header><p>{LONG}</p></header><nav><ul><li><a href=/>Home</a></ul></nav>
<article class="post"><h1>A heading</h1><p>{LONG}<p>Short&nbsp;one &amp; done.<div class="ad">{LONG}</div>
<p><a href=x>Read more about the town</a><!-- <p>{LONG}</p> --><p>{LONG}
<form><p>{LONG}</p></form></article>
<div id="comments"><p>{LONG}</p></div><aside>{LONG}</aside><div class="cookie-notice">{LONG}</div>
<p>{LONG}</p><footer><p>{LONG}</p></footer>"""


def test_article_without_what_is_around_it():
    text, _, _ = rules.extract_text(PAGE)
    assert text == "\n\n".join(["A heading", LONG, "Short one & done.", LONG])


def test_page_without_marked_article():
    page = (f"<div class=menu><a href=1>One</a> <a href=2>Two</a></div><h2>Of the day</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p>"
            f"<div><a href=3>{LONG}</a></div><p>Copyright 2020</p><div class='footer'>{LONG}</div>")
    text, _, _ = rules.extract_text(page)
    assert text == "\n\n".join(["Of the day", LONG, "Yes.", LONG])


def test_pages_match_their_articles(spark):
    import html
    got = {r.page_id: r for r in QUERIES["op2_block_rules"](spark, SF01).collect()}
    for r in spark.read.parquet(f"{SF01}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip()
                 for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize("page", [
    "<article class='post comments-open tag-social'>{}</article>",
    "<div class='content-sidebar-wrap'><article>{}</article></div>",
    "<main><div class='content-sidebar-wrap'>{}</div><div class='related-posts'><p>" + LONG + "</p></div></main>",
    "<div class='sidebar'><article>{}<div class='comment-list'><p>" + LONG + "</p></div></article></div>",
    "<div id='correspondence'>{}</div>", "<article><div class='unrelated'>{}</div></article>", "<div class='widget'>{}</div>",
    "<article><svg viewBox='0 0 1 1'/>{}<svg><text>x</text></svg></article>", "<article><iframe src='x'/>{}</article>",
    "<article><button class=a>Press{}<button>b</button></article>", "<article><select><option>One{}</article>",
    "<article>{}<button><div>Press</div></button><video><p>" + LONG + "</p></video></article>"])
def test_names_and_open_elements_do_not_swallow_main_text(page):
    text, _, _ = rules.extract_text("<body>" + page.format(f"<p>{LONG}</p><p>{LONG}</p>") + "</body>")
    assert text == f"{LONG}\n\n{LONG}"


def test_extraction_edge_rows(spark):
    cut = "<article><p>" + LONG + "</p><p>cut &am"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p"), (4, "u", "plain &lt;text&gt;"), (5, "u", cut), (5, "u", cut),
            (None, "u", "<article>" + "<p>" + LONG + "</p>" * 1 + ("<p>" + LONG) * 3000), (7, "u", "<" * 2000 + "a=\"" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"text": F.lit("x"), "n_chars": F.lit(9), "_html": F.lit("h")})
    out = rules.extract(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    by = {r.page_id: r.text for r in out}
    assert by[1] == by[2] == by[3] == "" and by[5] == LONG + "\n\ncut &am" and by[None].count(LONG) == 3001
    assert rules.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 4

def brute_scan(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_equals_a_plain_loop(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(scan, "GROUP", 4)
    rng = random.Random(block)
    want = {}
    for k, n in enumerate((0, 1, 5, 64, 200)):
        for dense in (0.02, 0.4):
            ids = [9 if rng.random() < dense else rng.randrange(9) for _ in range(n)]
            name = f"f{k}-{dense}.tokens"
            np.array(ids, dtype="<u2").tofile(tmp_path / name)
            want[name] = [(i, *d) for i, d in enumerate(brute_scan(ids, 9))]
    np.array([9, 9, 9], dtype="<u2").tofile(tmp_path / "all.tokens")
    want["all.tokens"] = [(i, i, 0, True) for i in range(3)]
    got = {}
    for r in scan.scan(spark, str(tmp_path), end=9, block_tokens=block).collect():
        got.setdefault(r.file, []).append((r.ordinal, r.start, r.n_tokens, r.closed))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_token_counts_of_documents(spark):
    enc = scan.encoder(scan.VOCABULARY)
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in
            spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op4_separator_scan"](spark, SF).collect()} == want


def test_token_file_edge_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> is text"), (4, "word " * 5000), (4, "word " * 5000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"file": F.lit("f"), "ordinal": F.lit(1)})
    folder = str(tmp_path / "tokens")
    manifest = scan.write_token_files(df.repartition(2), folder).cache()
    assert manifest.count() == len(rows)
    out = manifest.join(scan.scan(spark, folder, block_tokens=100), ["file", "ordinal"]).collect()
    manifest.unpersist()
    assert len(out) == len(rows) and all(r.closed for r in out)
    n = {r.doc_id: r.n_tokens for r in out}
    assert n[1] == n[2] == 0 and n[3] > 3 and sum(r.doc_id == 4 and r.n_tokens == n[4] for r in out) == 2
    assert len(os.listdir(folder)) <= 2 + 2                      # one file a task, and its checksum if any
    empty = str(tmp_path / "none")
    assert scan.write_token_files(df.limit(0), empty).count() == 0
    assert scan.scan(spark, empty).count() == 0


# ---------------------------------------------------------------- 7

def test_escapes_round_trip():
    rng = random.Random(1)
    bits = chat.CONTROL + ["\\", "\\-", "\\n", "\n", "a", "<", "|", ">", "[", "-", " é", "</", "s>", "<|im_"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        role = rng.choice(["assistant", "user", "".join(rng.choice(bits) for _ in range(3))])
        piece, lo, hi = chat.format_turn(role, text)
        assert chat.parse_turn(piece) == (role, text)
        assert chat.unescape(piece[lo:hi]) == (text if role == "assistant" else "")
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


@pytest.mark.parametrize("record, turns", [
    ({"role": "human", "text": "x"}, [("human", "x")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "z"}]}, [("user", "q"), ("assistant", "z")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o", "system": "s"}, [("system", "s"), ("user", "i\nn"), ("assistant", "o")]),
    ({"prompt": "p", "response": "r", "id": 3}, [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"turns": [{"author": {"role": "user"}, "content": {"parts": ["a", "b"]}}]}, [("user", "a\nb")]),
    ({"messages": [{"role": "user", "content": [{"text": "a"}, {"text": "b"}]}]}, [("user", "a\nb")]),
    ({"zzz": 1}, [("unknown", '{"zzz": 1}')]),
    ([], [("unknown", "[]")]),
])
def test_layouts(record, turns):
    assert chat.canonical(json.dumps(record), {}) == turns
    assert chat.canonical(None, {}) == [] and chat.canonical("{oops", {}) == [("unknown", "{oops")]


def test_fingerprint_ignores_order_and_positions():
    a = {"messages": [{"role": "u", "content": "x"}], "id": 1}
    b = {"id": 2, "messages": [{"content": "y", "role": "v"}, {"content": "z", "role": "w"}]}
    assert chat.fingerprint(chat.paths(a)) == chat.fingerprint(chat.paths(b)) != chat.fingerprint(chat.paths({"id": 1}))


def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracles(spark, name):
    res = duck(SF01).execute(ORACLE[name])
    cols = [c[0] for c in res.description]
    want = sorted(map(repr, res.fetchall()))
    assert sorted(repr(tuple(r[c] for c in cols)) for r in QUERIES[name](spark, SF01).collect()) == want


def test_deep_and_mixed_records():
    for deep in ('{"a":' * 3000 + "1" + "}" * 3000, "[" * 100_000 + "]" * 100_000,
                 '{"messages": [{"role": "user", "content": ' + "[" * 990 + "]" * 990 + "}]}"):
        assert [r for r, _ in chat.canonical(deep, {})] in (["unknown"], ["user"])
    mixed = {"messages": [{"role": "system", "content": "be kind"},
                          {"role": "user", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]},
                          {"role": "assistant", "content": "three"}, {"role": "user"}]}
    assert chat.canonical(json.dumps(mixed), {}) == [
        ("system", "be kind"), ("user", "one\ntwo"), ("assistant", "three"), ("user", "")]


def test_chat_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "no role"), (1, 1, "assistant", "tie"), (1, None, "assistant", "last"),
            (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, 0, "user", "no id"),
            (3, 0, "assistant", "</s>[INST]" * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"ord": F.lit(1), "record": F.lit("r"), "formatted": F.lit("f")})
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(
        chat.row_records(df.repartition(3), "conv_id", "turn", "role", "text"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None}
    assert got[1].n_turns == 4 and got[1].loss_sha256 == sha("tielast")
    assert got[1].turns_sha256 == sha("user\n\n\nno role\nassistant\ntie\nassistant\nlast\n")
    assert got[2].n_turns == 2 and got[2].loss_chars == 8
    assert got[3].loss_chars == 200_000 and got[3].loss_sha256 == sha("</s>[INST]" * 20_000)
    assert chat.read_back(chat.format_turns(chat.row_records(df.limit(0), "conv_id", "turn", "role", "text"))).count() == 0


# ---------------------------------------------------------------- 8

def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets_match_repeated_resharing(spark):
    rng = random.Random(8)
    for k in range(6):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 50, 500, 5000]) for i in range(rng.randint(1, 9))}
        if k % 2:
            sizes[None] = 40
        sizes["zz"] = 10
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in queue.targets(df).collect()}
        want = brute_targets(sizes)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


@pytest.mark.parametrize("rows_per_bin", [3, 1000])
def test_mix_takes_what_a_sorted_queue_takes(spark, rows_per_bin):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None, "c"]), rng.choice([0, 1, 5, 9, 200])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("bin", F.lit(1))
    got = {r.doc_id: r for r in queue.mix(df, rows_per_bin=rows_per_bin).collect()}
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in {r[1] for r in rows}}
    target = brute_targets(sizes)
    events = []
    for s in sizes:
        line = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, x, n in rows if x == s)
        at = 0
        for _ in range(2):
            for dice, i, n in line:
                at += n
                if n:
                    events.append((at / target[s], s is None, s or "", dice, i, n))
    taken, total = dict.fromkeys((r[0] for r in rows), 0), 0
    for _, _, _, _, i, n in sorted(events):
        if total >= sum(target.values()):
            break
        taken[i] += n
        total += n
    assert {i: r.taken for i, r in got.items()} == taken
    assert all(r.taken <= 2 * r.size for r in got.values())


def test_mix_of_repeated_ids_does_not_follow_the_split(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, None, 1, 2]), rng.choice(["a", "b"]), rng.randrange(1, 8)) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    one, other = (sorted(map(repr, (tuple(r) for r in queue.mix(df.repartition(n), rows_per_bin=20).collect())))
                  for n in (2, 5))
    assert one == other


def test_mix_edge_rows(spark):
    rows = [(1, None, "a b"), (1, None, "a b"), (2, "s", None), (3, "s", ""), (None, "t", "x " * 5000), (5, "t", " \t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns(
        {"target": F.lit(1), "row": F.lit(2), "size": F.lit(3)})
    out = queue.mix(queue.sized(df)).collect()
    assert len(out) == len(rows) and sorted(r.size for r in out) == [0, 0, 0, 2, 2, 5000]
    assert queue.mix(queue.sized(df.limit(0))).count() == 0
    nothing = queue.mix(queue.sized(df.where("text IS NULL OR text = ''"))).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0), (0.0, 0)]
