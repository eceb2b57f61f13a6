"""Batch generation around a user model function.

The model runtime is not part of this engine. A *responder* is any
function ``fn(list_of_chats, settings) -> list[str]`` (a chat is a list of
{role, content} dicts, or a rendered prompt). ``generate`` calls it from an
iterator Arrow UDF over the messages alone: one call per batch; all other
columns stay in the JVM.

Generation is nondeterministic: the UDF is marked so, and every step is
written to the shared folder and read back before anything else uses it (a
recomputed partition would otherwise give different answers to different
branches).

A flow is data: a *plan* of (step, msg_idx, role, source, content) rows for
any number of steps. ``source`` is ``lit`` (the content), ``note``, or
``out<k>``, the answer of step k. Each step's answers are one table (key,
answer, call); a step joins the earlier answers that its plan names.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from notewise.functions.chat import message
from notewise.functions.text import clean_text
from notewise.plans.prompts import prompt_plan_rows
from notewise.session import cut_lineage, ship_package

Responder = Callable[[list, dict], list]


# ---------------------------------------------------------------- prompt plan -> history

def plan_steps(plan="as_reference") -> dict[int, list[tuple]]:
    """A plan as {step: [(msg_idx, role, source, content)]}. ``plan``: the
    name of a built-in flow, or rows (step, msg_idx, role, source, content)."""
    rows = [r[1:] for r in prompt_plan_rows((plan,))] if isinstance(plan, str) else [tuple(r) for r in plan]
    out: dict[int, list[tuple]] = {}
    for step, idx, role, source, content in rows:
        if source not in ("lit", "note") and not re.fullmatch(r"out[1-9][0-9]*", source):
            raise ValueError(f"unknown message source: {source}")
        out.setdefault(int(step), []).append((idx, role, source, content))
    return {k: sorted(out[k], key=lambda m: m[0]) for k in sorted(out)}


def needed_outputs(plan, step: int) -> list[int]:
    """Steps whose answers the messages of ``step`` quote."""
    return sorted({int(src[3:]) for _, _, src, _ in plan_steps(plan)[step] if src.startswith("out")})


def step_history(step: int, plan="as_reference", note: str = "note") -> Column:
    """The message list of ``step`` for every row, from the plan.

    The plan is configuration, so it is applied as a projection (no join, no
    shuffle): literals, the note column and the answer columns ``out<k>``.
    """
    def content(source, literal):
        return F.lit(literal) if source == "lit" else F.col(note if source == "note" else source)
    return F.array(*[message(role, content(src, lit)) for _, role, src, lit in plan_steps(plan)[step]])


# ---------------------------------------------------------------- G1: one batch job

ANSWER = "candidate string, call_id string, call_rows int, call_sec double"
#: what a call within a token budget tells besides: tokens of its prompts, and with padding
BUDGET_ANSWER = ANSWER + ", call_tokens int, call_padded int"


def calls_within(sizes: list[int], budget: int) -> list[list[int]]:
    """Rows dealt to calls so that the longest prompt of a call times its rows
    stays within ``budget`` tokens. Rows are taken from the longest to the
    shortest, so a call's prompts are of like length and little is padded."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out: list[list[int]] = []
    for i in order:
        if sizes[i] > budget:
            raise ValueError(f"a prompt of {sizes[i]} tokens exceeds the budget of {budget} a call")
        if out and sizes[out[-1][0]] * (len(out[-1]) + 1) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def budget_answer_udf(fn: Responder, settings: dict, budget: int, count: Callable[[object], int],
                      clock: Callable[[], float] = time.perf_counter):
    """As ``answer_udf``, but each Arrow batch is dealt to calls of at most
    ``budget`` tokens with padding; ``count`` gives a prompt's tokens."""
    def chat(value):
        return value if isinstance(value, str) else [{"role": m["role"], "content": m["content"]} for m in value]

    @pandas_udf(BUDGET_ANSWER)
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chats = [chat(v) for v in batch]
            sizes = [max(1, int(count(c))) for c in chats]
            rows: list = [None] * len(chats)
            for call in calls_within(sizes, budget):
                began = clock()
                answers = list(fn([chats[i] for i in call], settings))
                spent = clock() - began
                if len(answers) != len(call):
                    raise ValueError(f"responder returned {len(answers)} answers for {len(call)} chats")
                about = (uuid.uuid4().hex, len(call), spent, sum(sizes[i] for i in call), sizes[call[0]] * len(call))
                for i, a in zip(call, answers):
                    rows[i] = (a, *about)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BUDGET_ANSWER.split(", ")])

    return answer.asNondeterministic()


def padding_share(responses: DataFrame, by=()) -> DataFrame:
    """Calls, tokens and the share of padding in them, per ``by``, from answers
    given within a token budget: one row a call counts."""
    calls = responses.groupBy(*by, "call_id").agg(F.max("call_tokens").alias("_t"), F.max("call_padded").alias("_p"))
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("_t").alias("tokens"), F.sum("_p").alias("padded"),
        F.max("_p").alias("largest_call")).withColumn("padding", F.try_divide(
            (F.col("padded") - F.col("tokens")).cast("double"), F.col("padded")))


def answer_udf(fn: Responder, settings: dict, clock: Callable[[], float] = time.perf_counter):
    """Iterator Arrow UDF over chats (message arrays) or rendered prompts."""
    def chat(value):
        return value if isinstance(value, str) else [{"role": m["role"], "content": m["content"]} for m in value]

    @pandas_udf(ANSWER)
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chats = [chat(v) for v in batch]
            began = clock()
            answers = list(fn(chats, settings)) if chats else []
            spent = clock() - began
            if len(answers) != len(chats):
                raise ValueError(f"responder returned {len(answers)} answers for {len(chats)} chats")
            yield pd.DataFrame({"candidate": pd.Series(answers, dtype=object), "call_id": uuid.uuid4().hex,
                                "call_rows": len(chats), "call_sec": spent})

    return answer.asNondeterministic()


def generate(df: DataFrame, fn: Responder, messages: str = "messages", settings: dict | None = None,
             keep: list[str] | None = None, spread: int | None = None,
             clock: Callable[[], float] = time.perf_counter, call_tokens: int | None = None,
             count: Callable[[object], int] | None = None) -> DataFrame:
    """G1: one answer per row of ``df``: keep + (candidate, call_id,
    call_rows, call_sec).

    ``messages``: a column of chats, or of rendered prompts. The call columns
    say which call of the responder gave the answer, how many rows it had and
    how many seconds it took (A8 sums calls). ``spread`` hash-spreads rows
    over that many tasks first (few large input files would otherwise give
    few model workers). ``call_tokens``: no call holds more tokens than that,
    padding counted, by ``count`` of a chat or prompt; the columns call_tokens
    and call_padded come with the answers (``padding_share`` sums them up). A
    prompt longer than a call fails the job.
    """
    ship_package(df.sparkSession)
    keep = keep if keep is not None else [c for c in df.columns if c != messages]
    src = df.select(*keep, messages)
    if spread:
        src = src.repartition(spread, *keep[:1])
    if call_tokens:
        if count is None:
            raise ValueError("call_tokens needs count, the tokens of a chat")
        answer = budget_answer_udf(fn, dict(settings or {}), call_tokens, count, clock)
    else:
        answer = answer_udf(fn, dict(settings or {}), clock)
    return src.select(*keep, answer(messages).alias("_a")).select(*keep, "_a.*")


def _answered(spark: SparkSession, path: str, schema) -> DataFrame:
    """The answers a folder holds, one a key: a job that was killed while a
    task committed may have left a key twice."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)      # there, even before the first answer
    key = schema.fields[0].name
    rows = spark.read.schema(schema).parquet(path)
    first = F.min_by(F.struct(*schema.names[1:]), "call_id").alias("_a")
    return rows.groupBy(key).agg(first).select(key, "_a.*")


def generate_resumable(df: DataFrame, fn: Responder, path: str, key: str = "record_id", messages: str = "messages",
                       settings: dict | None = None, spread: int | None = None,
                       clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """G1 that goes on where a killed or failed job stopped: (key, candidate,
    call_id, call_rows, call_sec) of every row of ``df``, kept in ``path``.

    Rows whose key the folder has are not asked again (a left anti join on
    keys). Answers are appended, and every task's file is committed when that
    task ends, not when the job does: what a job answered before it died stays.
    Keys are distinct and not NULL.
    """
    spark = df.sparkSession
    ship_package(spark)
    kind = df.schema[key].dataType.simpleString()
    empty = spark.createDataFrame([], f"`{key}` {kind}, {ANSWER}")
    open_rows = df.join(_answered(spark, path, empty.schema).select(key), key, "left_anti")
    (generate(open_rows, fn, messages, settings, keep=[key], spread=spread, clock=clock)
     .write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path))
    return _answered(spark, path, empty.schema)


def generate_validated(spark: SparkSession, df: DataFrame, fn: Responder, valid: Column, again: str, tries: int = 3,
                       key: str = "record_id", messages: str = "messages", keep=(), settings: dict | None = None,
                       spread: int | None = None) -> DataFrame:
    """F3 into G2: (key, try_no, candidate, status) with status valid or
    rejected, one row per row of ``df``.

    Only rows whose answer fails ``valid`` (a condition over ``candidate`` and
    the columns ``keep``) are asked again, with the rejected answer and the
    request ``again`` appended to their chat, at most ``tries`` times in all.
    The rejected rows of each try are written and are all the next one reads.
    """
    state = df.select(key, *keep, messages)
    settled = []
    for t in range(1, tries + 1):
        answers = generate(state, fn, messages, settings, keep=[key, *keep, messages], spread=spread)
        judged = cut_lineage(answers.withColumn("_ok", F.coalesce(valid, F.lit(False))), spark, f"try-{t}")
        done = judged if t == tries else judged.where("_ok")
        settled.append(done.select(key, F.lit(t).alias("try_no"), "candidate",
                                   F.when(F.col("_ok"), "valid").otherwise("rejected").alias("status")))
        rejected = judged.where("NOT _ok")
        if t == tries or rejected.isEmpty():
            break
        state = rejected.select(key, *keep, F.concat(F.col(messages), F.array(
            message("assistant", F.coalesce("candidate", F.lit(""))), message("user", F.lit(again)))).alias(messages))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- G2: the step flow

def generate_flow(spark: SparkSession, records: DataFrame, fn: Responder, plan="as_reference",
                  method: str = "flow", settings: dict | None = None, clean_note: bool = True,
                  spread: int | None = None, steps: int | None = None, key: str = "record_id",
                  render: Callable[[Column], Column] | None = None, resume: str | None = None) -> DataFrame:
    """Chained answers per record, one batch job per step of ``plan``
    (the first ``steps`` of it). ``render`` turns message arrays into prompt
    texts (``chat.render_llama3``, ``chat.render_inst``) for responders that
    take those.

    Returns responses (method, step, key, candidate, call_id, call_rows,
    call_sec) read back from the written step tables. Records need distinct,
    non-NULL keys. ``resume``: a folder that keeps the steps' answers; the same
    flow started again on it asks only what it doesn't hold yet.
    """
    note = clean_text("input") if clean_note else F.col("input")
    notes = records.select(key, note.alias("note"))
    done: dict[int, DataFrame] = {}
    for k in list(plan_steps(plan))[:steps]:
        state = notes
        for j in needed_outputs(plan, k):
            state = state.join(done[j].select(key, F.col("candidate").alias(f"out{j}")), key)
        chat = step_history(k, plan, "note")
        asked = state.select(key, (render(chat) if render else chat).alias("messages"))
        if resume:
            done[k] = generate_resumable(asked, fn, f"{resume.rstrip('/')}/step-{k}", key, "messages", settings, spread)
        else:
            done[k] = cut_lineage(generate(asked, fn, "messages", settings, keep=[key], spread=spread),
                                  spark, f"flow-{method}-step{k}")
    parts = [t.select(F.lit(method).alias("method"), F.lit(k).alias("step"), *t.columns) for k, t in done.items()]
    resp = parts[0]
    for part in parts[1:]:
        resp = resp.unionByName(part)
    return resp


# ---------------------------------------------------------------- G3-G7 helpers

def scored_step(responses: DataFrame, run_config: DataFrame) -> DataFrame:
    """Keep each method's scored step (run_config.scored_step)."""
    return (responses.join(run_config.select("method", "scored_step"), "method")
            .where(F.col("step") == F.col("scored_step")).drop("scored_step"))


def attach_run_settings(report: DataFrame, run_config: DataFrame) -> DataFrame:
    """Print the settings with the results (one row per method)."""
    return report.join(run_config, "method", "left")


# ---------------------------------------------------------------- model responders

_MODELS: dict = {}


class cached_responder:
    """A responder that builds its model on first use in each Python worker
    and keeps it for later batches and tasks (worker processes are reused),
    instead of loading it per batch. ``factory()`` returns the batch
    function ``fn(chats, settings) -> list[str]``; ``name`` tells models
    apart. Workers import this class by name, so all tasks of a worker share
    one store of models. A process loads a model once. Spark keeps idle workers
    for a minute beside those at work, so plan memory for the models of two
    workers a slot, or set ``spark.executor.cores`` to half."""

    def __init__(self, factory: Callable[[], Responder], name: str = "model"):
        self.factory, self.name = factory, name

    def __call__(self, chats: list, settings: dict) -> list:
        if self.name not in _MODELS:
            _MODELS[self.name] = self.factory()
        return _MODELS[self.name](chats, settings)
