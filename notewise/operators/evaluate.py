"""Corpus scores, reports and comparisons.

Every aggregate here is a hash aggregate with map-side partial
aggregation, so a hot method or step never sends its rows to one reducer.
Step-to-step comparisons pair rows through aggregates, not windows over
a record's steps. The only global window (A6) ranks a result-sized table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewise.operators.rouge import ALL_METRICS, METRICS, score_pairs, scores_long
from notewise.session import cut_lineage, ship_package

PRF = ("precision", "recall", "fmeasure")


# ---------------------------------------------------------------- J1 / J2

def unpaired_rows(candidates: DataFrame, gold: DataFrame, key: str = "record_id", run=()) -> DataFrame:
    """Keys present on one side only: (*run, side, key).

    Without ``run`` the two key sets are compared as a whole. With run
    columns (method, step) every run must answer every gold key: a key that
    one run lacks is ``gold_only`` for that run. Both sides are stacked and
    reduced by one partial aggregate per key; the runs of a key are a set no
    larger than the number of runs. NULL keys are keys of their own.
    """
    run = list(run)
    which = F.struct(*run) if run else F.struct(F.lit(0).alias("_all"))
    runs = candidates.select(which.alias("_run")).distinct()
    every = F.array_sort(F.collect_set("_run"))
    tagged = (candidates.select(key, which.alias("_run"), F.lit(0).alias("_g"))
              .unionByName(gold.select(key, F.lit(None).cast(runs.schema["_run"].dataType).alias("_run"),
                                       F.lit(1).alias("_g"))))
    seen = tagged.groupBy(key).agg(every.alias("_have"), F.max("_g").alias("_g"))
    # one row: all runs there are, a result-sized set
    all_runs = runs.agg(F.collect_set("_run").alias("_runs"))
    lacking = F.array_except("_runs", "_have")
    lacking = lacking if run else F.when(F.size("_have") == 0, F.array(which)).otherwise(
        F.array().cast(f"array<{runs.schema['_run'].dataType.simpleString()}>"))
    out = (seen.withColumn("_runs", all_runs.scalar()).select(
        key, F.when(F.col("_g") == 0, F.lit("candidate_only")).otherwise(F.lit("gold_only")).alias("side"),
        F.explode(F.when(F.col("_g") == 0, F.col("_have")).otherwise(lacking)).alias("_run")))
    return out.select(*[F.col(f"_run.{r}").alias(r) for r in run], "side", key)


def _pairing_errors(candidates: DataFrame, gold: DataFrame, key: str, run: list[str]) -> DataFrame:
    """No rows; raises while it runs if the two sides don't pair up. The
    errors stand in filter predicates, so no consumer can prune them away."""
    def fail_on(df: DataFrame, message: Column) -> DataFrame:
        raised = F.raise_error(message).cast("boolean")
        return df.where(F.when(message.isNotNull(), raised).otherwise(F.lit(False))).select(F.lit(1).alias("_none"))

    k = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    tagged = (candidates.select(key, F.lit(1).alias("_c"), F.lit(0).alias("_g"))
              .unionByName(gold.select(key, F.lit(0).alias("_c"), F.lit(1).alias("_g"))))
    seen = tagged.groupBy(key).agg(F.max("_c").alias("_c"), F.sum("_g").alias("_g"))
    by_key = fail_on(seen, F.when(F.col(key).isNull(), F.lit("NULL key"))
                     .when(F.col("_c") == 0, F.concat(F.lit("gold without answer: "), k))
                     .when(F.col("_g") == 0, F.concat(F.lit("answer without gold: "), k))
                     .when(F.col("_g") > 1, F.concat(F.lit("duplicate gold key: "), k)))
    # every run answers every record, once
    total = gold.agg(F.count(F.lit(1)).alias("_records"))
    runs = (candidates.groupBy(*run, key).agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*run).agg(F.count(F.lit(1)).alias("_have"), F.max("_n").alias("_most")))
    name = F.concat_ws(" ", *[F.col(r).cast("string") for r in run]) if run else F.lit("all answers")
    by_run = fail_on(runs.withColumn("_records", total.scalar()),
                     F.when(F.col("_have") != F.col("_records"), F.concat(
                         F.lit("run "), name, F.lit(": "), F.col("_have").cast("string"), F.lit(" of "),
                         F.col("_records").cast("string"), F.lit(" records")))
                     .when(F.col("_most") > 1, F.concat(F.lit("run "), name, F.lit(" answers a record twice"))))
    return by_key.unionByName(by_run)


def pair_with_gold(candidates: DataFrame, gold: DataFrame, key: str = "record_id",
                   gold_col: str = "output", check: bool = True, run=("method", "step")) -> DataFrame:
    """Pair answers with gold text on ``key`` (inner equi-join).

    With ``check`` (J2 enforced) the job fails, whatever columns its consumer
    reads, when a key is NULL, a gold key repeats, a row of either side has
    no partner, or a run (the columns of ``run`` that ``candidates`` has)
    misses a record or answers one twice: a positional zip would silently
    truncate, and the mean would still divide by all candidates. The checks
    are keys-only aggregates unioned into the same job; they yield no rows.
    """
    pairs = candidates.join(gold.select(key, F.col(gold_col).alias("reference")), key)
    if not check:
        return pairs
    nothing = _pairing_errors(candidates, gold, key, [r for r in run if r in candidates.columns])
    return pairs.unionByName(nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in pairs.schema.fields]))


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "record_id") -> None:
    """A table of the session's catalog, dealt by key into ``buckets``
    sorted buckets. Answers and gold saved alike join without an exchange, and
    gold saved once serves every run: only the answers are shuffled. Choose
    buckets of 100-200 MB; each task writes a file a bucket, so rows are dealt
    to the buckets first."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


# ---------------------------------------------------------------- A1-A3

def corpus_rouge(scored: DataFrame, group=("method", "step"), metrics=METRICS) -> DataFrame:
    """A1: mean precision, recall, F per metric over the pairs of a run.

    Aggregated wide (one partial aggregate per task), stacked to long form
    only on the small result: (group..., metric, precision, recall,
    fmeasure, n_pairs).
    """
    aggs = [F.avg(F.col(f"{m}.{k}")).alias(f"{m}__{k}") for m in metrics for k in PRF]
    wide = scored.groupBy(*group).agg(*aggs, F.count(F.lit(1)).alias("n_pairs"))
    stacked = F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}__{k}").alias(k) for k in PRF])
        for m in metrics]))
    return wide.select(*group, stacked, "n_pairs")


#: prime modulus of the weight generator (2^31 - 1), and what scores are scaled by
PRIME, SCALE = 2147483647, 10 ** 9


def poisson_limits(prime: int = PRIME) -> list[int]:
    """Poisson(1) distribution function times ``prime``, rounded down: a
    uniform integer below ``prime`` gets as many draws as limits it reaches."""
    out, p, acc, k = [], math.exp(-1.0), 0.0, 0
    while acc < 1 - 1e-9:
        acc += p
        out.append(int(acc * prime))
        k += 1
        p /= k
    return out


def corpus_rouge_bootstrap(scored: DataFrame, group=("method", "step"), metrics=ALL_METRICS,
                           key: str = "record_id", replicates: int = 1000, seed: int = 17) -> DataFrame:
    """A2: bootstrap low / mid / high (2.5 / 50 / 97.5 percentiles) of the
    mean F per metric.

    Seeded Poisson bootstrap over single pairs: in each replicate a pair
    counts Poisson(1) times. The weights of a pair are integers: a cubic in
    the replicate's number, modulo a prime, whose coefficients are the md5 of
    (seed, run, key), against fixed limits. Any engine with 64-bit integers
    draws the same. Each Arrow batch draws all replicates of its pairs at
    once and returns one partial sum per run and replicate; scores are summed
    as integers (9 decimals), so the order of the sums doesn't matter.
    """
    group, metrics = list(group), list(metrics)
    ship_package(scored.sparkSession)
    limits = poisson_limits()
    dice = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*group, key)]).cast("binary"))
    src = scored.select(*group, dice.alias("_dice"), *[
        F.round(F.col(f"{m}.fmeasure") * SCALE).cast("long").alias(f"_{m}") for m in metrics])
    kinds = src.select(*group).schema

    def draw(batches):
        import numpy as np
        import pyarrow as pa
        reps = np.arange(1, replicates + 1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(g).to_pylist() for g in group)))
            runs = {r: i for i, r in enumerate(dict.fromkeys(names))}
            run_of = np.array([runs[r] for r in names])
            co = np.array([[int(d[i:i + 8], 16) % PRIME for i in (0, 8, 16, 24)]
                           for d in batch.column("_dice").to_pylist()], dtype=np.int64)
            scores = np.stack([np.ones(batch.num_rows, np.int64)]
                              + [batch.column(f"_{m}").to_numpy(zero_copy_only=False) for m in metrics])
            sums = np.zeros((len(runs), len(scores), replicates), np.int64)
            for at in range(0, batch.num_rows, 256):
                c = co[at:at + 256, :, None]
                v = c[:, 3]
                for j in (2, 1, 0):
                    v = (v * reps + c[:, j]) % PRIME
                w = np.searchsorted(limits, v, side="right")
                for r in np.unique(run_of[at:at + 256]):
                    own = run_of[at:at + 256] == r
                    sums[r] += scores[:, at:at + 256][:, own] @ w[own]
            for r, i in runs.items():
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x] * replicates, batch.schema.field(g).type) for g, x in zip(group, r)),
                     pa.array(reps), *(pa.array(s) for s in sums[i])],
                    names=[*group, "rep", "n", *(f"s_{m}" for m in metrics)])

    schema = kinds
    for name in ("rep", "n", *(f"s_{m}" for m in metrics)):
        schema = schema.add(name, "long")
    rep_means = (src.mapInArrow(draw, schema).groupBy(*group, "rep")
                 .agg(F.sum("n").alias("n"), *[F.sum(f"s_{m}").alias(f"s_{m}") for m in metrics])
                 .where("n > 0")
                 .select(*group, *[(F.col(f"s_{m}") / F.col("n") / SCALE).alias(m) for m in metrics]))
    pct = F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))
    q = rep_means.groupBy(*group).agg(*[F.percentile(F.col(m), pct).alias(m) for m in metrics])
    stacked = F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("low"), F.col(m)[1].alias("mid"),
                 F.col(m)[2].alias("high")) for m in metrics]))
    return q.select(*group, stacked)


def evaluate_runs(pairs: DataFrame, group=("method", "step"), key: str = "record_id", metrics=ALL_METRICS,
                  replicates: int = 1000, seed: int = 17) -> DataFrame:
    """A1 and A2 from one scoring pass: (group..., metric, precision, recall,
    fmeasure, n_pairs, low, mid, high). The scores are written once and read
    by both reports."""
    spark = pairs.sparkSession
    scored = cut_lineage(score_pairs(pairs, metrics=metrics, keep=[*group, key]), spark, "scores")
    means = corpus_rouge(scored, group, metrics)
    return means.join(corpus_rouge_bootstrap(scored, group, metrics, key, replicates, seed), [*group, "metric"])


#: fixed value: the line of the printed report
REPORT_LINE = "%s: Precision: %.4f, Recall: %.4f, F1: %.4f"


def score_report(corpus: DataFrame) -> DataFrame:
    """A3: one formatted line per run and metric, four decimals."""
    line = F.format_string(REPORT_LINE, F.col("metric"), F.col("precision"), F.col("recall"), F.col("fmeasure"))
    keys = [c for c in corpus.columns if c in ("method", "step")]
    return corpus.select(*keys, "metric", line.alias("line"))


# ---------------------------------------------------------------- F3

def valid_response(df: DataFrame, answer: str = "candidate", note: str = "input",
                   keys=("record_id",)) -> DataFrame:
    """flags of an unusable answer (empty list, no separator, longer than
    the note, echoes the note) and the routing status valid / rejected."""
    from notewise.functions.text import parse_list
    flags = {
        "is_empty": F.size(parse_list(answer)) == 0,
        "no_separator": ~F.col(answer).contains(";"),
        "too_long": F.length(answer) > F.length(note),
        "echoes_prompt": F.col(answer).contains(F.col(note)),
    }
    bad = flags["is_empty"] | flags["no_separator"] | flags["too_long"] | flags["echoes_prompt"]
    return df.select(*keys, *[v.alias(k) for k, v in flags.items()],
                     F.when(bad, "rejected").otherwise("valid").alias("status"))


# ---------------------------------------------------------------- A4

def null_patterns(df: DataFrame, cols) -> DataFrame:
    """A4: rows per combination of null flags, most frequent first."""
    return flag_patterns(df.select(*[F.isnull(c).alias(f"{c}_null") for c in cols]))


def flag_patterns(flags: DataFrame) -> DataFrame:
    """A4 on flags that are columns already: rows per combination."""
    return (flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), *flags.columns))


# ---------------------------------------------------------------- A6, A7, J3

def method_leaderboard(corpus: DataFrame, run_config: DataFrame, metric: str = "rougeL") -> DataFrame:
    """Runs ranked by mean F of ``metric``, with their settings.

    ``corpus`` has one row per (run, metric): a result-sized table, so the
    global rank is over a few rows.
    """
    # equal to nine decimals is equal: the order of a sum must not rank runs
    w = Window.orderBy(F.round("fmeasure", 9).desc())
    ranked = (corpus.where(F.col("metric") == metric)
              .withColumn("rank", F.rank().over(w)))
    return ranked.join(run_config, "method", "left")


def step_gain(long_scores: DataFrame, measure: str = "fmeasure") -> DataFrame:
    """Change of a record's score from one step to the next, averaged
    per (method, step, metric), with the shares of records that improved
    or got worse.

    Each score row is emitted twice, as the current value of its step and as
    the previous value of step + 1; one partial aggregate on (method,
    record_id, metric, step) pairs them. No window holds a record's steps
    together and the scores are computed once (a self-join would score
    twice).
    """
    keys = ["method", "record_id", "metric"]
    none = F.lit(None).cast("double")
    both = F.inline(F.array(
        F.struct(F.col("step").alias("_s"), F.col(measure).cast("double").alias("_cur"),
                 none.alias("_prev")),
        F.struct((F.col("step") + 1).alias("_s"), none.alias("_cur"),
                 F.col(measure).cast("double").alias("_prev"))))
    d = (long_scores.select(*keys, both).groupBy(*keys, F.col("_s").alias("step"))
         .agg(F.max("_cur").alias("_cur"), F.max("_prev").alias("_prev"))
         .where(F.col("_cur").isNotNull() & F.col("_prev").isNotNull())
         .withColumn("delta", F.col("_cur") - F.col("_prev")))
    return d.groupBy("method", "step", "metric").agg(
        F.avg("delta").alias("mean_delta"),
        F.avg(F.when(F.col("delta") > 0, 1.0).otherwise(0.0)).alias("share_improved"),
        F.avg(F.when(F.col("delta") < 0, 1.0).otherwise(0.0)).alias("share_worse"),
        F.count(F.lit(1)).alias("n_records"))


def compare_steps(long_scores: DataFrame, measure: str = "fmeasure") -> DataFrame:
    """First vs last scored step of each record against the same gold.

    One partial aggregate (min_by / max_by on step), no self-join.
    """
    return (long_scores.groupBy("method", "record_id", "metric").agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.min_by(measure, "step").alias("first_score"),
        F.max_by(measure, "step").alias("last_score"))
        .withColumn("delta", F.col("last_score") - F.col("first_score")))


# ---------------------------------------------------------------- A8

def run_timing(responses: DataFrame) -> DataFrame:
    """Generation time per run and step, over the calls of the model:
    rows, calls, seconds in all, longest, median and 95th percentile call.
    ``responses`` has one row per answer with its call (``generate``)."""
    calls = responses.groupBy("method", "step", "call_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("call_sec").alias("sec"))
    pct = F.percentile("sec", F.array(F.lit(0.5), F.lit(0.95)))
    return (calls.groupBy("method", "step").agg(
        F.sum("rows").alias("n"), F.count(F.lit(1)).alias("n_calls"), F.sum("sec").alias("total_sec"),
        F.max("sec").alias("max_sec"), pct.alias("_pct"))
        .select("method", "step", "n", "n_calls", "total_sec", "max_sec", F.col("_pct")[0].alias("p50_sec"),
                F.col("_pct")[1].alias("p95_sec")))


def to_long(scored: DataFrame, keys=("method", "step", "record_id"), metrics=METRICS) -> DataFrame:
    return scores_long(scored, list(keys), metrics)
