import os
import tempfile

import pytest

from pyspark.sql import functions as F

from notewise.operators import evaluate as E
from notewise.operators import generate as G
from notewise.operators import rouge as R
from notewise.plans.prompts import SHORT_PLAN, flow_plan, prompt_plan_rows
from notewise.plans.standin import extractive_responder
from notewise.sources import testdata as td

SF = "/root/testdata/sf0.001"


def test_plan_shapes():
    for flow in ("as_reference", "consistent"):
        plan = G.plan_steps(flow)
        assert [len(plan[k]) for k in range(1, 6)] == [2, 4, 6, 8, 10]
    ref, con = G.plan_steps("as_reference"), G.plan_steps("consistent")
    # the history rewrites the second user turn from step 3 on in the reference flow only
    assert ref[3][3][3] != ref[2][3][3] and con[3][3][3] == con[2][3][3]
    # and the reflect prompt changes by one word from step 4 on
    assert ref[4][5][3] != ref[3][5][3] and con[4][5][3] == con[3][5][3]
    assert len(prompt_plan_rows()) == 60


def test_flow_steps_are_materialised(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(chats, settings):
        calls.add(len(chats))
        return extractive_responder(chats, settings)

    recs = td.records(spark, SF)
    n = recs.count()
    resp = G.generate_flow(spark, recs, counting, steps=3)
    assert calls.value == 3 * n
    # later actions read the written step tables, they do not call the model again
    assert resp.count() == 3 * n
    assert resp.where("step = 3").count() == n
    assert calls.value == 3 * n


def test_history_uses_previous_outputs(spark):
    df = spark.createDataFrame([(1, "note one. two", "first answer")],
                               "record_id long, note string, out1 string")
    msgs = df.select(G.step_history(2, "as_reference").alias("m")).first().m
    assert [m.role for m in msgs] == ["system", "user", "assistant", "user"]
    assert msgs[1].content == "note one. two" and msgs[2].content == "first answer"


def test_generate_single_batches(spark):
    recs = td.records(spark, SF).limit(5)
    from notewise.functions.chat import messages_system_user
    out = G.generate(recs.select("record_id", messages_system_user().alias("messages")),
                     extractive_responder, keep=["record_id"])
    rows = out.collect()
    assert len(rows) == 5 and all(r.call_rows >= 1 and r.call_sec >= 0 for r in rows)


def test_user_plan_of_any_length(spark):
    recs = td.records(spark, SF)
    for plan, n in ((SHORT_PLAN, 3), (flow_plan({k: [f"turn {j}" for j in range(1, k)] for k in range(1, 8)}), 7)):
        resp = G.generate_flow(spark, recs, extractive_responder, plan=plan)
        assert resp.count() == n * recs.count() and resp.select("step").distinct().count() == n
    with pytest.raises(ValueError):
        G.plan_steps([(1, 0, "user", "answer1", None)])


def test_rendered_prompts_reach_the_responder(spark):
    from notewise.functions.chat import render_llama3

    def echo(prompts, settings):
        return [p[:17] + p[-6:] for p in prompts]

    resp = G.generate_flow(spark, td.records(spark, SF), echo, plan=SHORT_PLAN,
                           render=lambda m: render_llama3(m, add_generation_prompt=True))
    assert all(r.candidate.startswith("<|begin_of_text|>") and r.candidate.endswith("|>\n\n") for r in resp.collect())


def test_text_stays_out_of_python(spark):
    df = spark.range(3).selectExpr("id AS record_id", "repeat('note', 9) AS note",
                                   "array(struct('user' AS role, 'q' AS content)) AS messages")
    plan = G.generate(df, extractive_responder, keep=["record_id", "note"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan


def test_seconds_of_a_slow_responder_add_up(spark):
    import time as t

    def slow(chats, settings):
        t.sleep(0.002 * len(chats))
        return ["x"] * len(chats)

    df = spark.range(1000).selectExpr("id AS record_id", "array(struct('user' AS role, 'q' AS content)) AS messages")
    resp = G.generate(df.repartition(4), slow, keep=["record_id"]).select(
        F.lit("m").alias("method"), F.lit(1).alias("step"), "*").cache()
    r = E.run_timing(resp).first()
    resp.unpersist()
    assert r.n == 1000 and 2.0 <= r.total_sec <= 2.2 + 0.05 * r.n_calls
    assert r.p50_sec <= r.p95_sec <= r.max_sec <= r.total_sec


def test_bootstrap_draws_pairs_by_integer_weights(spark):
    import hashlib
    scored = R.score_pairs(td.steps(spark, "/root/testdata/sf0.01"), keep=["method", "step", "record_id"]).cache()
    reps = 40
    got = {(r.step, r.metric): (r.low, r.mid, r.high)
           for r in E.corpus_rouge_bootstrap(scored, metrics=R.METRICS, replicates=reps).collect()}
    assert got == {(r.step, r.metric): (r.low, r.mid, r.high) for r in E.corpus_rouge_bootstrap(
        scored.repartition(7), metrics=R.METRICS, replicates=reps).collect()}      # whatever the partitions
    rows, limits = scored.collect(), E.poisson_limits()
    import numpy as np
    for step in {r.step for r in rows}:
        sums = [[0, 0] for _ in range(reps)]
        for r in (r for r in rows if r.step == step):
            d = hashlib.md5(f"17|{r.method}|{r.step}|{r.record_id}".encode()).hexdigest()
            c = [int(d[i:i + 8], 16) % E.PRIME for i in (0, 8, 16, 24)]
            for x in range(1, reps + 1):
                v = (((c[3] * x + c[2]) % E.PRIME * x + c[1]) % E.PRIME * x + c[0]) % E.PRIME
                w = sum(t <= v for t in limits)
                sums[x - 1][0] += w * round(r.rougeL.fmeasure * E.SCALE)
                sums[x - 1][1] += w
        want = np.percentile([a / b / E.SCALE for a, b in sums if b], [2.5, 50, 97.5])
        assert np.allclose(got[step, "rougeL"], want, atol=1e-9)
    scored.unpersist()


def test_poisson_weights_have_the_right_mean():
    limits = E.poisson_limits()
    n = 20_000
    draws = [sum(t <= int(u * E.PRIME) for t in limits) for u in ((i + 0.5) / n for i in range(n))]
    assert abs(sum(draws) / n - 1) < 1e-3


def test_one_evaluation_gives_both_reports(spark):
    pairs = td.steps(spark, SF)
    both = {(r.step, r.metric): r for r in E.evaluate_runs(pairs, replicates=50).collect()}
    means = E.corpus_rouge(R.score_pairs(pairs, metrics=R.ALL_METRICS, keep=["method", "step", "record_id"]),
                           metrics=R.ALL_METRICS).collect()
    assert len(both) == len(means)
    for m in means:
        b = both[m.step, m.metric]
        assert abs(b.fmeasure - m.fmeasure) < 1e-12 and b.low <= b.mid <= b.high


def test_stream_scoring_matches_batch(spark):
    from notewise.streaming.scoring import start_stream_scoring
    base = tempfile.mkdtemp(prefix="nw-stream-", dir="/tmp")
    src = os.path.join(base, "responses")
    ans = td.steps(spark, SF)
    ans.select("method", "step", "record_id", "candidate").write.parquet(src)
    q = start_stream_scoring(spark, src, td.records(spark, SF), os.path.join(base, "sink"),
                             os.path.join(base, "ckpt"), metrics=("rougeL",), available_now=True)
    q.awaitTermination(300)
    got = {(r.step, r.record_id): r.rougeL.fmeasure
           for r in spark.read.parquet(os.path.join(base, "sink")).collect()}
    gold = td.records(spark, SF).select("record_id", "output")
    batch = R.score_pairs(ans.select("method", "step", "record_id", "candidate")
                          .join(gold.withColumnRenamed("output", "reference"), "record_id"),
                          metrics=("rougeL",), keep=["method", "step", "record_id"])
    exp = {(r.step, r.record_id): r.rougeL.fmeasure for r in batch.collect()}
    assert got == exp and len(got) > 0


def test_cached_responder_builds_once_per_worker(spark):
    import os as _os
    folder = tempfile.mkdtemp(prefix="nw-loads-", dir="/tmp")

    def factory():
        open(_os.path.join(folder, f"{_os.getpid()}-{len(_os.listdir(folder))}"), "w").close()
        return extractive_responder

    df = spark.range(64).selectExpr("id AS record_id", "array(struct('user' AS role, 'a. b' AS content)) AS messages")
    out = G.generate(df.repartition(16), G.cached_responder(factory, "test-model"), keep=["record_id"])
    assert len(out.collect()) == 64
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert loads and len(set(loads)) == len(loads)      # 16 tasks; a process loads the model once


def test_inst_template_rejects_system_role(spark):
    from pyspark.errors import PySparkException
    from notewise.functions import chat as C
    df = spark.createDataFrame([("n",)], "input string")
    with pytest.raises(PySparkException):
        df.select(C.render_inst(C.messages_system_user())).collect()
    ok = df.select(C.render_inst(F.array(C.message("user", F.lit("q")), C.message("assistant", F.lit("a")))))
    assert ok.first()[0] == "<s>[INST] q [/INST]a</s>"


def test_settings_reach_the_responder(spark):
    from notewise.functions.chat import messages_system_user
    from notewise.plans.prompts import settings_for

    def echo(chats, settings):
        return [f"{settings['max_new_tokens']}/{settings['temperature']}"] * len(chats)

    recs = td.records(spark, SF)
    out = G.generate(recs.select("record_id", messages_system_user().alias("messages")), echo,
                     settings=settings_for("demo"), keep=["record_id"])
    assert {r.candidate for r in out.collect()} == {"256/0.6"}


def test_readme_flow(spark):
    """The usage example of the README, end to end on test records."""
    from notewise.functions.chat import messages_system_user
    from notewise.functions.text import clean_text
    from notewise.operators import sft as S
    from notewise.sources import records as SR
    base = tempfile.mkdtemp(prefix="nw-readme-", dir="/tmp")
    SR.write_record_arrays(td.records(spark, SF), os.path.join(base, "notes"), chunk=8)
    recs = SR.read_records(spark, os.path.join(base, "notes"), id_key="id")
    msgs = recs.select("record_id", messages_system_user(clean_text("input")).alias("messages"))
    answers = G.generate(msgs, G.cached_responder(lambda: extractive_responder, "readme"),
                         keep=["record_id"], settings={"max_new_tokens": 512})
    pairs = E.pair_with_gold(answers.withColumn("method", F.lit("single"))
                             .withColumn("step", F.lit(1)), recs)
    scored = R.score_pairs(pairs, metrics=R.ALL_METRICS, keep=["method", "step", "record_id"])
    report = E.score_report(E.corpus_rouge(scored)).collect()
    assert [r.metric for r in sorted(report, key=lambda r: r.metric)] == ["rouge1", "rouge2", "rougeL"]
    assert E.corpus_rouge_bootstrap(scored).count() == 4
    sft = S.prepare_sft(recs.withColumn("split", F.lit("train")))
    assert S.length_report(sft).first().n_rows == recs.count()
