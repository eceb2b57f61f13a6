"""Batches by token budget, resuming, asking again, replacing runs, bucketed
gold, and labels over token ids."""

import glob
import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.functions.chat import message
from notewise.operators import evaluate as E
from notewise.operators import generate as G
from notewise.operators import sft as S
from notewise.plans.prompts import flow_plan
from notewise.sources import records as SR


def folder() -> str:
    return tempfile.mkdtemp(prefix="nw-runs-", dir="/tmp")


def chats(spark, notes, parts=4):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "record_id long, input string").repartition(parts, "record_id")
    return df.select("record_id", "input", F.array(message("user", "input")).alias("messages"))


# ---------------------------------------------------------------- G1 by budget

@pytest.mark.parametrize("sizes,budget", [([5, 1, 1, 9, 2, 2, 7], 10), ([1] * 30, 7), ([10, 10], 10), ([], 4), ([3], 3)])
def test_calls_hold_the_budget(sizes, budget):
    calls = G.calls_within(sizes, budget)
    assert sorted(i for c in calls for i in c) == list(range(len(sizes)))
    assert all(max(sizes[i] for i in c) * len(c) <= budget for c in calls)


def test_a_prompt_beyond_the_budget_fails():
    with pytest.raises(ValueError, match="exceeds the budget"):
        G.calls_within([3, 11], 10)


def test_budgeted_answers_return_to_their_keys(spark):
    notes = [" ".join(["w"] * (1 + i * 7 % 40)) + f" n{i}" for i in range(200)]
    df = chats(spark, notes)

    def size_of(chat):
        return sum(len(m["content"].split()) for m in chat)

    def fn(asked, settings):
        assert max(map(size_of, asked)) * len(asked) <= 128
        return [m[0]["content"][::-1] for m in asked]
    out = G.generate(df, fn, keep=["record_id"], call_tokens=128, count=size_of).collect()
    assert {r.record_id: r.candidate for r in out} == {i: n[::-1] for i, n in enumerate(notes)}
    share = G.padding_share(spark.createDataFrame(out)).collect()[0]
    assert share.largest_call <= 128 and share.tokens == sum(len(n.split()) for n in notes)
    assert 0 <= share.padding < 0.1 and share.n_calls < 200
    with pytest.raises(ValueError):
        G.generate(df, fn, call_tokens=128)


# ---------------------------------------------------------------- resume

def asking(log: str, fail_on: str | None = None):
    """A responder that notes each note it answers; fails while a file is there."""
    def fn(asked, settings):
        if fail_on and os.path.exists(os.path.join(log, "fail")) and any(fail_on in m["content"] for c in asked for m in c):
            raise RuntimeError("worker lost")
        for c in asked:
            name = hashlib.md5("|".join(m["content"] for m in c).encode()).hexdigest()
            with open(os.path.join(log, f"asked-{name}"), "a") as f:
                f.write("x")
        return [f"{c[0]['content']}/{len(c)}" for c in asked]
    return fn


def times_asked(log: str) -> list[int]:
    return [os.path.getsize(f) for f in glob.glob(os.path.join(log, "asked-*"))]


def test_a_failed_job_goes_on_where_it_stopped(spark):
    log, path = folder(), folder() + "/answers"
    open(os.path.join(log, "fail"), "w").close()
    df = chats(spark, [f"note {i}" for i in range(40)], parts=8)
    fn = asking(log, "note 17")
    with pytest.raises(Exception, match="worker lost"):
        G.generate_resumable(df, fn, path)
    before = len(times_asked(log))
    os.rename(os.path.join(log, "fail"), os.path.join(log, "mended"))
    out = G.generate_resumable(df, fn, path).collect()
    assert sorted(r.record_id for r in out) == list(range(40)) and all(r.candidate.endswith("/1") for r in out)
    kept = {r.record_id for r in out}
    assert len(kept) == 40 and before > 0 and len(times_asked(log)) == 40
    # tasks that had ended before the failure are not asked again
    assert sum(n == 1 for n in times_asked(log)) >= 1
    asked = sum(times_asked(log))
    again = G.generate_resumable(df, fn, path).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out)) and sum(times_asked(log)) == asked


def test_a_flow_killed_in_step_3_asks_no_answered_row_again(spark):
    log, path = folder(), folder()
    recs = spark.createDataFrame([(i, f"note {i}") for i in range(12)], "record_id long, input string").repartition(4, "record_id")
    plan = flow_plan({1: [], 2: ["more"], 3: ["last", "word"]})
    plain = G.generate_flow(spark, recs, asking(folder()), plan=plan).select("step", "record_id", "candidate").collect()
    open(os.path.join(log, "fail"), "w").close()
    with pytest.raises(Exception, match="worker lost"):
        G.generate_flow(spark, recs, asking(log, "last"), plan=plan, resume=path)
    assert len(times_asked(log)) >= 24
    os.rename(os.path.join(log, "fail"), os.path.join(log, "mended"))
    out = G.generate_flow(spark, recs, asking(log, "last"), plan=plan, resume=path).select("step", "record_id", "candidate").collect()
    assert sorted(out) == sorted(plain)
    assert times_asked(log) == [1] * 36


# ---------------------------------------------------------------- asking again

def test_only_rejected_rows_are_asked_again(spark):
    log = folder()
    df = chats(spark, [f"note {i}" for i in range(10)])

    def fn(asked, settings):
        for c in asked:
            with open(os.path.join(log, c[0]["content"]), "a") as f:
                f.write(f"{len(c)} ")
        return [None if c[0]["content"].endswith("3") and len(c) == 1 else "a;b" if len(c) > 2 * (int(c[0]["content"][-1]) % 4) else "no"
                for c in asked]
    out = G.generate_validated(spark, df, fn, F.col("candidate").contains(";"), "again", tries=3, keep=["input"])
    rows = {r.record_id: (r.try_no, r.candidate, r.status) for r in out.collect()}
    assert rows == {i: (min(i % 4, 2) + 1, "a;b" if i % 4 < 3 else "no", "valid" if i % 4 < 3 else "rejected") for i in range(10)}
    asked = {f: open(os.path.join(log, f)).read().split() for f in os.listdir(log)}
    assert asked == {f"note {i}": ["1", "3", "5"][:min(i % 4, 2) + 1] for i in range(10)}
    none = G.generate_validated(spark, df.limit(0), fn, F.col("candidate").contains(";"), "again")
    assert none.collect() == []


# ---------------------------------------------------------------- S8, J1

def digests(path: str) -> dict:
    return {f: hashlib.md5(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/*/*/*.parquet")}


def test_one_run_is_replaced_and_the_others_stay(spark):
    path = folder() + "/out"
    gold = spark.createDataFrame([(1, "g1"), (2, "g2")], "record_id long, output string")
    rows = [(m, s, i, f"{m}{s}{i}") for m in ("a", "b") for s in (1, 2) for i in (1, 2)]
    resp = spark.createDataFrame(rows, "method string, step int, record_id long, candidate string")
    SR.save_outputs(resp, gold, path)
    before = digests(path)
    with pytest.raises(Exception):
        SR.save_outputs(resp, gold, path)
    fresh = resp.where("method = 'a' AND step = 2").withColumn("candidate", F.lit("new"))
    SR.save_outputs(fresh, gold, path, replace=True)
    after = digests(path)
    others = {f: d for f, d in before.items() if "method=a/step=2" not in f}
    assert others == {f: d for f, d in after.items() if "method=a/step=2" not in f}
    got = spark.read.parquet(path).where("method = 'a' AND step = 2").collect()
    assert [r.candidate for r in got] == ["new", "new"] and len(spark.read.parquet(path).collect()) == 8
    # a job that fails leaves every run as it was
    broken = fresh.withColumn("candidate", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        SR.save_outputs(broken, gold, path, replace=True)
    assert digests(path) == after


def test_bucketed_gold_joins_without_an_exchange(spark):
    gold = spark.range(500).select(F.col("id").alias("record_id"), F.concat(F.lit("g"), "id").alias("output"))
    answers = gold.select(F.lit("m").alias("method"), F.lit(1).alias("step"), "record_id", F.lit("c").alias("candidate"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        E.save_bucketed(gold, "nw_gold", 4)
        E.save_bucketed(answers, "nw_answers", 4)
        pairs = E.pair_with_gold(spark.table("nw_answers"), spark.table("nw_gold"), check=False)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        one_side = E.pair_with_gold(answers, spark.table("nw_gold"), check=False)
        assert one_side._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert pairs.count() == 500 and one_side.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE IF EXISTS nw_gold")
        spark.sql("DROP TABLE IF EXISTS nw_answers")


# ---------------------------------------------------------------- T4 over ids

def brute_labels(ids, marker):
    at = [i for i in range(len(ids) - len(marker) + 1) if ids[i:i + len(marker)] == marker]
    end = at[-1] + len(marker) if at else len(ids)
    return [-100] * end + ids[end:]


@pytest.mark.parametrize("marker", [[7], [7, 8], [7, 7], [1, 2, 1]])
def test_labels_after_the_last_whole_marker(spark, marker):
    rows = [[7, 8, 5], [5, 6], [], [7], [8, 7], [7, 8, 1, 7, 8], [7, 8, 7, 8], [7, 7, 7, 3], [1, 2, 1, 2, 1, 9], [3, 7, 8, 4, 7], [1, 2, 1]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k long, ids array<int>")
    got = {r.k: r.labels for r in df.select("k", S.completion_labels_of_ids("ids", marker).alias("labels")).collect()}
    assert got == {i: brute_labels(r, marker) for i, r in enumerate(rows)}


def test_ids_of_a_user_tokenizer(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, None), (3, "")], "k long, text string").coalesce(1)
    ids = S.token_ids_with(lambda texts: [[ord(c) for c in t] for t in texts])
    out = df.select("k", ids("text").alias("ids"))
    assert out.schema["ids"].dataType == T.ArrayType(T.IntegerType())
    assert {r.k: r.ids for r in out.collect()} == {1: [97, 98, 32, 99], 2: None, 3: []}
    labels = out.select("k", S.completion_labels_of_ids("ids", [98, 32]).alias("labels")).collect()
    assert {r.k: r.labels for r in labels} == {1: [-100, -100, -100, 99], 2: None, 3: []}
    with pytest.raises(ValueError):
        S.completion_labels_of_ids("ids", [])
