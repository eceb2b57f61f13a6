"""The registered queries: one per operator of the inventory, bound to the
driver's test tables, each with its DuckDB oracle where SQL can express it.

Every query reads whole tables (or data Spark derives from them). Computed
columns are aliased identically on both sides; doubles are rounded to six
places on both sides; integer widths are pinned by casts.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.functions import chat as C
from notewise.functions import text as X
from notewise.functions.tokens import ngrams, rouge_tokens
from notewise.operators import evaluate as E
from notewise.operators import generate as G
from notewise.operators import rouge as R
from notewise.operators import sft as S
from notewise.plans import sqlparts as Q
from notewise.plans.prompts import (EOT, FLOW_TURNS, HDR_END, HDR_START, INST_BOS, INST_CLOSE, INST_EOS, INST_OPEN,
                                    RUN_CONFIG_ROWS, SHORT_PLAN, run_config, settings_for)
from notewise.plans.standin import AGAIN, WorkClock, correcting_responder, extractive_responder, regex_ids
from notewise.session import cut_lineage, shared_path, ship_package
from notewise.sources import array_blocks as AB
from notewise.sources import records as SR
from notewise.sources import testdata as td
from notewise.sources.testdata import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _prf_cols(struct: str):
    return [r6(F.col(f"{struct}.{k}")).alias(k) for k in E.PRF]


KEYS = ["method", "step", "record_id"]
#: tasks that CPU-heavy work on the test documents (one file) is spread over
SPREAD = 16


def _scored(spark, sf, metrics=R.METRICS) -> DataFrame:
    return R.score_pairs(td.scored_answers(spark, sf), metrics=metrics, keep=KEYS)


# SQL: tokens of both sides, computed once.
TOKS = {"toks": f"SELECT method, step, record_id, {Q.tok('candidate')} AS ct, "
                f"{Q.tok('reference')} AS rt FROM answers"}


def _tok_sql(body: str, extra: dict | None = None) -> str:
    return with_views(body, "answers", extra={**TOKS, **(extra or {})})


# ====================================================================== scoring (R*)

@query("rouge_tokens", with_views(
    f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(len({Q.tok('text')}) AS BIGINT) AS n_tokens, "
    f"array_to_string({Q.tok('text')}, ' ') AS tokens FROM conversations"))
def q_rouge_tokens(spark, sf):
    c = td.table(spark, sf, "conversations").select("conv_id", "turn", rouge_tokens("text").alias("t"))
    return c.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                    F.size("t").cast("bigint").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens"))


@query("ngrams", with_views(
    f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(len({Q.ngr('t', 2)}) AS BIGINT) AS n_bigrams, "
    f"array_to_string({Q.ngr('t', 2)}, '|') AS bigrams "
    f"FROM (SELECT conv_id, turn, {Q.tok('text')} AS t FROM conversations)"))
def q_ngrams(spark, sf):
    c = td.table(spark, sf, "conversations").select("conv_id", "turn", rouge_tokens("text").alias("t"))
    g = c.select("conv_id", "turn", ngrams("t", 2).alias("g"))
    return g.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                    F.size("g").cast("bigint").alias("n_bigrams"),
                    F.array_join("g", "|").alias("bigrams"))


@query("ngram_overlap", _tok_sql(
    f"SELECT method, step, record_id, CAST({Q.overlap('ct', 'rt')} AS BIGINT) AS overlap1, "
    f"CAST({Q.overlap(Q.ngr('ct', 2), Q.ngr('rt', 2))} AS BIGINT) AS overlap2 FROM toks"))
def q_ngram_overlap(spark, sf):
    t = R.count_pairs(td.scored_answers(spark, sf), metrics=("rouge1", "rouge2"), keep=KEYS)
    return t.select(*KEYS, F.col("counts.o1").alias("overlap1"), F.col("counts.o2").alias("overlap2"))


def _rn_sql(n: int) -> str:
    o = Q.overlap("ct", "rt") if n == 1 else Q.overlap(Q.ngr("ct", 2), Q.ngr("rt", 2))
    nc = "len(ct)" if n == 1 else "greatest(len(ct) - 1, 0)"
    nr = "len(rt)" if n == 1 else "greatest(len(rt) - 1, 0)"
    p, r = f"(o / greatest({nc}, 1))", f"(o / greatest({nr}, 1))"
    return _tok_sql(
        f"SELECT method, step, record_id, round({p}, 6) AS precision, round({r}, 6) AS recall, "
        f"round({Q.fm(p, r)}, 6) AS fmeasure FROM (SELECT *, CAST({o} AS DOUBLE) AS o FROM toks)")


@query("rouge1", _rn_sql(1))
def q_rouge1(spark, sf):
    return _scored(spark, sf, ("rouge1",)).select(*KEYS, *_prf_cols("rouge1"))


@query("rouge2", _rn_sql(2))
def q_rouge2(spark, sf):
    return _scored(spark, sf, ("rouge2",)).select(*KEYS, *_prf_cols("rouge2"))


LCS_CTE = {
    "dp(method, step, record_id, k, d2, d1, ct, rt) USING KEY (method, step, record_id)": """
  SELECT method, step, record_id, 1, list_transform(range(0, len(ct) + 1), lambda x: 0),
         list_transform(range(0, len(ct) + 1), lambda x: 0), ct, rt
  FROM toks WHERE len(ct) > 0 AND len(rt) > 0
  UNION ALL
  SELECT method, step, record_id, k + 1, d1,
         list_transform(range(0, len(ct) + 1), lambda i: CASE
            WHEN i = 0 OR k + 1 - i <= 0 OR k + 1 - i > len(rt) THEN 0
            WHEN ct[i] = rt[k + 1 - i] THEN d2[i] + 1
            ELSE greatest(d1[i], d1[i + 1]) END),
         ct, rt
  FROM dp WHERE k < len(ct) + len(rt)""",
    "lcs": """
  SELECT t.method, t.step, t.record_id, len(t.ct) AS nc, len(t.rt) AS nr,
         CAST(coalesce(dp.d1[len(dp.ct) + 1], 0) AS BIGINT) AS lcs
  FROM toks t LEFT JOIN dp USING (method, step, record_id)""",
}


def _lcs_sql(body: str) -> str:
    return "WITH RECURSIVE" + _tok_sql(body, LCS_CTE)[len("WITH"):]


@query("lcs_length", _lcs_sql("SELECT method, step, record_id, lcs FROM lcs"))
def q_lcs_length(spark, sf):
    t = R.count_pairs(td.scored_answers(spark, sf), metrics=("rougeL",), keep=KEYS)
    return t.select(*KEYS, "counts.lcs")


_PL = "CASE WHEN nc = 0 OR nr = 0 THEN 0.0 ELSE lcs / nc END"
_RL = "CASE WHEN nc = 0 OR nr = 0 THEN 0.0 ELSE lcs / nr END"
ROUGE_L_SQL_ROW = (f"SELECT method, step, record_id, {_PL} AS precision, {_RL} AS recall, "
                   f"{Q.fm(_PL, _RL)} AS fmeasure FROM lcs")


@query("rouge_l", _lcs_sql(
    f"SELECT method, step, record_id, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    f"round(fmeasure, 6) AS fmeasure FROM ({ROUGE_L_SQL_ROW})"))
def q_rouge_l(spark, sf):
    return _scored(spark, sf, ("rougeL",)).select(*KEYS, *_prf_cols("rougeL"))


# Summary-level LCS in SQL: per sentence pair a DP table (rows by recursion),
# the backtrack by recursion, the union of reference positions per reference
# sentence; a token type t then contributes min(union occurrences of t,
# candidate count of t) hits (the clipped counting, in closed form).
_TOK_S = Q.tok('s')
LSUM_CTE = {
    "sents": f"""SELECT method, step, record_id,
    list_transform(list_filter(string_split(candidate, chr(10)), lambda s: length(s) > 0), lambda s: {_TOK_S}) AS cs,
    list_transform(list_filter(string_split(reference, chr(10)), lambda s: length(s) > 0), lambda s: {_TOK_S}) AS rs
  FROM answers""",
    "sp": """SELECT method, step, record_id, ri, ci, rs[ri] AS r, cs[ci] AS c
  FROM sents CROSS JOIN LATERAL (SELECT unnest(range(1, len(rs) + 1)) AS ri)
             CROSS JOIN LATERAL (SELECT unnest(range(1, len(cs) + 1)) AS ci)
  WHERE len(rs[ri]) > 0 AND len(cs[ci]) > 0""",
    "dp(method, step, record_id, ri, ci, i, r, c, tab) USING KEY (method, step, record_id, ri, ci)": """
  SELECT method, step, record_id, ri, ci, 0, r, c, [list_transform(range(0, len(c) + 1), lambda x: 0)]
  FROM sp
  UNION ALL
  SELECT method, step, record_id, ri, ci, i + 1, r, c,
         list_append(tab, list_reduce(
           list_transform(range(1, len(c) + 1), lambda j:
             greatest(tab[i + 1][j + 1], CASE WHEN r[i + 1] = c[j] THEN tab[i + 1][j] + 1 ELSE 0 END)),
           lambda acc, x: list_append(acc, greatest(acc[-1], x)), [0]))
  FROM dp WHERE i < len(r)""",
    "bt(method, step, record_id, ri, ci, i, j, idx, tab, r, c) USING KEY (method, step, record_id, ri, ci)": """
  SELECT method, step, record_id, ri, ci, len(r), len(c), []::INTEGER[], tab, r, c FROM dp
  UNION ALL
  SELECT method, step, record_id, ri, ci,
         CASE WHEN r[i] = c[j] THEN i - 1 WHEN tab[i + 1][j] > tab[i][j + 1] THEN i ELSE i - 1 END,
         CASE WHEN r[i] = c[j] THEN j - 1 WHEN tab[i + 1][j] > tab[i][j + 1] THEN j - 1 ELSE j END,
         CASE WHEN r[i] = c[j] THEN list_append(idx, CAST(i - 1 AS INTEGER)) ELSE idx END,
         tab, r, c
  FROM bt WHERE i > 0 AND j > 0""",
    "uni": """SELECT method, step, record_id, ri, list_distinct(flatten(list(idx))) AS u FROM bt
  GROUP BY method, step, record_id, ri""",
    "ut": """SELECT u.method, u.step, u.record_id, s.rs[u.ri][x + 1] AS tok, count(*) AS n
  FROM uni u JOIN sents s USING (method, step, record_id), unnest(u.u) AS t(x)
  GROUP BY ALL""",
    "ct": """SELECT method, step, record_id, tok, count(*) AS n
  FROM sents, unnest(flatten(cs)) AS t(tok) GROUP BY ALL""",
    "hits": """SELECT ut.method, ut.step, ut.record_id, sum(least(ut.n, ct.n)) AS hits
  FROM ut JOIN ct USING (method, step, record_id, tok) GROUP BY ALL""",
    "lsum": """SELECT s.method, s.step, s.record_id, CAST(coalesce(h.hits, 0) AS DOUBLE) AS hits,
         list_sum(list_transform(s.rs, lambda x: len(x))) AS m,
         list_sum(list_transform(s.cs, lambda x: len(x))) AS n
  FROM sents s LEFT JOIN hits h USING (method, step, record_id)""",
}
_PS = "CASE WHEN coalesce(n, 0) = 0 OR coalesce(m, 0) = 0 THEN 0.0 ELSE hits / n END"
_RS = "CASE WHEN coalesce(n, 0) = 0 OR coalesce(m, 0) = 0 THEN 0.0 ELSE hits / m END"
LSUM_BODY = (f"SELECT method, step, record_id, round({_PS}, 6) AS precision, "
             f"round({_RS}, 6) AS recall, round({Q.fm(_PS, _RS)}, 6) AS fmeasure FROM lsum")


@query("rouge_lsum", "WITH RECURSIVE" + with_views(LSUM_BODY, "answers", extra=LSUM_CTE)[len("WITH"):])
def q_rouge_lsum(spark, sf):
    return _scored(spark, sf, ("rougeLsum",)).select(*KEYS, *_prf_cols("rougeLsum"))


# ====================================================================== reports (A*)

def _long_sql() -> str:
    parts = []
    for n, name in ((1, "rouge1"), (2, "rouge2")):
        o = Q.overlap("ct", "rt") if n == 1 else Q.overlap(Q.ngr("ct", 2), Q.ngr("rt", 2))
        nc = "len(ct)" if n == 1 else "greatest(len(ct) - 1, 0)"
        nr = "len(rt)" if n == 1 else "greatest(len(rt) - 1, 0)"
        p, r = f"(o / greatest({nc}, 1))", f"(o / greatest({nr}, 1))"
        parts.append(f"SELECT method, step, record_id, '{name}' AS metric, {p} AS precision, "
                     f"{r} AS recall, {Q.fm(p, r)} AS fmeasure "
                     f"FROM (SELECT *, CAST({o} AS DOUBLE) AS o FROM toks)")
    parts.append(f"SELECT method, step, record_id, 'rougeL' AS metric, {_PL} AS precision, "
                 f"{_RL} AS recall, {Q.fm(_PL, _RL)} AS fmeasure FROM lcs")
    return " UNION ALL ".join(parts)


CORPUS_SQL = ("SELECT method, step, metric, avg(precision) AS precision, avg(recall) AS recall, "
              "avg(fmeasure) AS fmeasure, count(*) AS n_pairs FROM long GROUP BY method, step, metric")


def _corpus_query(select: str, more: dict | None = None) -> str:
    """SQL over the per-pair long scores (``long``) and their means (``corpus``)."""
    extra = {**TOKS, **LCS_CTE, "long": _long_sql(), "corpus": CORPUS_SQL, **(more or {})}
    return "WITH RECURSIVE" + with_views(select, "answers", extra=extra)[len("WITH"):]


def _corpus(spark, sf) -> DataFrame:
    return E.corpus_rouge(_scored(spark, sf))


@query("corpus_rouge", _corpus_query(
    "SELECT method, step, metric, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(fmeasure, 6) AS fmeasure, n_pairs FROM corpus"))
def q_corpus_rouge(spark, sf):
    c = _corpus(spark, sf)
    return c.select("method", "step", "metric", *[r6(k).alias(k) for k in E.PRF], "n_pairs")


LSUM_LONG = (f"SELECT method, step, record_id, 'rougeLsum' AS metric, {_PS} AS precision, {_RS} AS recall, "
             f"{Q.fm(_PS, _RS)} AS fmeasure FROM lsum")
#: the two recursive tables of the summary LCS under names of their own
LSUM_CTE_2 = {k.replace("dp(", "sdp(").replace("bt(", "sbt(") if "(" in k else k:
              v.replace("FROM dp", "FROM sdp").replace("FROM bt", "FROM sbt") for k, v in LSUM_CTE.items()}


def _boot_sql(seed: int = 17, replicates: int = 1000) -> dict:
    """The bootstrap's integer weights in SQL: a cubic in the replicate's
    number, coefficients from the md5 of (seed, run, key), fixed limits."""
    p = E.PRIME
    dice = f"md5(concat_ws('|', '{seed}', method, CAST(step AS VARCHAR), CAST(record_id AS VARCHAR)))"
    co = ", ".join(f"CAST(('0x' || substr(d, {i + 1}, 8)) AS BIGINT) % {p} AS c{j}" for j, i in enumerate((0, 8, 16, 24)))
    limits = "[" + ", ".join(map(str, E.poisson_limits())) + "]"
    return {
        "every": f"SELECT * FROM long UNION ALL {LSUM_LONG}",
        "co": f"SELECT method, step, record_id, {co} FROM (SELECT DISTINCT method, step, record_id, {dice} AS d FROM answers)",
        "w": f"""SELECT method, step, record_id, r, len(list_filter({limits}, lambda x: x <= v)) AS w
  FROM (SELECT method, step, record_id, r, ((((c3 * r + c2) % {p}) * r + c1) % {p} * r + c0) % {p} AS v
        FROM co, range(1, {replicates + 1}) AS t(r))""",
        "rep": f"""SELECT method, step, metric, r,
         sum(w * CAST(round(fmeasure * {E.SCALE}) AS BIGINT)) / sum(w) / {E.SCALE} AS f
  FROM every JOIN w USING (method, step, record_id) GROUP BY method, step, metric, r HAVING sum(w) > 0""",
        "boot": """SELECT method, step, metric, quantile_cont(f, 0.025) AS low, quantile_cont(f, 0.5) AS mid,
         quantile_cont(f, 0.975) AS high FROM rep GROUP BY method, step, metric"""}


def _boot_query(select: str) -> str:
    extra = {**TOKS, **LCS_CTE, "long": _long_sql(), **LSUM_CTE_2, **_boot_sql()}
    return "WITH RECURSIVE" + with_views(select, "answers", extra=extra)[len("WITH"):]


_LMH = ("low", "mid", "high")


@query("corpus_rouge_bootstrap", _boot_query(
    "SELECT method, step, metric, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high FROM boot"))
def q_corpus_rouge_bootstrap(spark, sf):
    b = E.corpus_rouge_bootstrap(_scored(spark, sf, R.ALL_METRICS))
    return b.select("method", "step", "metric", *[r6(k).alias(k) for k in _LMH])


@query("evaluate_runs", _boot_query(
    "SELECT method, step, metric, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, "
    "round(avg(fmeasure), 6) AS fmeasure, count(*) AS n_pairs, round(any_value(low), 6) AS low, "
    "round(any_value(mid), 6) AS mid, round(any_value(high), 6) AS high "
    "FROM every JOIN boot USING (method, step, metric) GROUP BY method, step, metric"))
def q_evaluate_runs(spark, sf):
    """Both scorers' reports of every run from one scoring pass."""
    e = E.evaluate_runs(td.scored_answers(spark, sf))
    return e.select("method", "step", "metric", *[r6(k).alias(k) for k in E.PRF], "n_pairs",
                    *[r6(k).alias(k) for k in _LMH])


@query("score_report", _corpus_query(
    "SELECT method, step, metric, printf('%s: Precision: %.4f, Recall: %.4f, F1: %.4f', metric, "
    "precision, recall, fmeasure) AS line FROM corpus"))
def q_score_report(spark, sf):
    return E.score_report(_corpus(spark, sf))


def _docs_label_flags(spark, sf) -> DataFrame:
    """doc_id and the null flags; the text is reduced to its flag before the
    join, so the join moves ids and flags."""
    lab = td.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    doc = td.docs(spark, sf).select("doc_id", *X.null_flags(["text"]))
    return doc.join(lab, "doc_id", "left").select("doc_id", "text_null", *X.null_flags(["quality", "toxic"]))


@query("null_patterns", """
SELECT text IS NULL AS text_null, quality IS NULL AS quality_null, toxic IS NULL AS toxic_null,
       count(*) AS n
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
def q_null_patterns(spark, sf):
    return E.flag_patterns(_docs_label_flags(spark, sf).drop("doc_id"))


SFT_VIEW = {"sft": (
    f"SELECT record_id, split, {Q.clean('instruction')} AS instruction, {Q.clean('input')} AS input, "
    f"{Q.clean('output')} AS output FROM split_records")}
SFT_TEXT = {"sft_text": (
    f"SELECT *, {Q.training_text('input', 'output')} AS text FROM sft")}
SFT_COUNT = {"sft_count": f"SELECT *, CAST({Q.count_tokens('text')} + 1 AS INTEGER) AS token_count "
                          f"FROM sft_text"}


def _sft_sql(body: str, count: bool = True, source: str = "split_records", more: dict | None = None) -> str:
    view = {"sft": SFT_VIEW["sft"].replace("FROM split_records", f"FROM {source}")}
    extra = {**view, **SFT_TEXT, **(SFT_COUNT if count else {}), **(more or {})}
    return with_views(body, source, extra=extra)


def _sft_records(spark, sf) -> DataFrame:
    """The fine-tuning source: all three fields cleaned (the fine-tuning scope)."""
    return X.clean_scope(td.split_records(spark, sf), ("instruction", "input", "output"))


def _sft_docs(spark, sf) -> DataFrame:
    """The same over documents, many of which exceed the token budget."""
    return X.clean_scope(td.doc_records(spark, sf, spread=SPREAD), ("instruction", "input", "output"))


@query("length_report", _sft_sql(
    "SELECT split, count(*) FILTER (WHERE token_count < 512) AS n_under, count(*) AS n_rows, "
    "round(count(*) FILTER (WHERE token_count < 512) / count(*), 6) AS share_under "
    "FROM sft_count GROUP BY split", source="doc_records"))
def q_length_report(spark, sf):
    rep = S.length_report(S.prepare_sft(_sft_docs(spark, sf)))
    return rep.select("split", "n_under", "n_rows", r6("share_under").alias("share_under"))


RUN_CONFIG_SQL = {"run_config": "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {a}, {b}, {c}, {d})" for m, a, b, c, d in RUN_CONFIG_ROWS) +
    ") AS t(method, max_new_tokens, temperature, top_p, scored_step)"}


@query("method_leaderboard", _corpus_query(
    "SELECT c.method, c.step, round(c.fmeasure, 6) AS fmeasure, "
    "CAST(rank() OVER (ORDER BY c.fmeasure DESC) AS INTEGER) AS rank, "
    "CAST(r.max_new_tokens AS INTEGER) AS max_new_tokens, CAST(r.temperature AS DOUBLE) AS temperature, "
    "CAST(r.top_p AS DOUBLE) AS top_p "
    f"FROM corpus c LEFT JOIN ({RUN_CONFIG_SQL['run_config']}) r USING (method) "
    "WHERE c.metric = 'rougeL'"))
def q_method_leaderboard(spark, sf):
    lb = E.method_leaderboard(_corpus(spark, sf), run_config(spark))
    return lb.select("method", "step", r6("fmeasure").alias("fmeasure"), "rank",
                     "max_new_tokens", "temperature", "top_p")


def _long_to_final(spark, sf) -> DataFrame:
    s = R.score_pairs(td.steps(spark, sf), keep=KEYS)
    return E.to_long(s)


@query("step_gain", _corpus_query("""
SELECT method, step, metric, round(avg(delta), 6) AS mean_delta,
       round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_improved,
       round(avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END), 6) AS share_worse,
       count(*) AS n_records
FROM d WHERE delta IS NOT NULL GROUP BY method, step, metric""", {"d": """
  SELECT method, step, metric,
         fmeasure - lag(fmeasure) OVER (PARTITION BY method, record_id, metric ORDER BY step) AS delta
  FROM long WHERE method = 'to_final'"""}))
def q_step_gain(spark, sf):
    g = E.step_gain(_long_to_final(spark, sf))
    return g.select("method", "step", "metric", *[r6(c).alias(c) for c in
                                                  ("mean_delta", "share_improved", "share_worse")],
                    "n_records")


@query("run_timing", with_views(
    "SELECT 'single_prompt' AS method, 1 AS step, count(*) AS n, CAST(round(count(*) * 0.25, 6) AS DOUBLE) AS total_sec, "
    "true AS calls_add_up FROM records", "records"))
def q_run_timing(spark, sf):
    """A8 on a clock that moves a quarter of a second per chat."""
    recs = td.records(spark, sf)
    msgs = recs.select("record_id", C.messages_system_user(X.clean_text("input")).alias("messages"))
    clock = WorkClock(0.25)
    resp = G.generate(msgs, clock.timed(extractive_responder), keep=["record_id"], clock=clock)
    resp = cut_lineage(resp.select(F.lit("single_prompt").alias("method"), F.lit(1).alias("step"),
                                   "*"), spark, "timing")
    t = E.run_timing(resp)
    ok = ((F.col("max_sec") <= F.col("total_sec")) & (F.col("p50_sec") <= F.col("p95_sec"))
          & (F.col("p95_sec") <= F.col("max_sec")) & (F.col("max_sec") * F.col("n_calls") >= F.col("total_sec")))
    return t.select("method", "step", "n", r6("total_sec").alias("total_sec"), ok.alias("calls_add_up"))


# ====================================================================== joins (J*)

FIRST_ANSWER = {"first": "SELECT conv_id AS record_id, arg_min(text, turn) AS candidate "
                         "FROM conversations WHERE role = 'assistant' GROUP BY conv_id"}


@query("pair_with_gold", with_views(
    "SELECT 'first_turn' AS method, 1 AS step, record_id, candidate, output AS reference "
    "FROM first JOIN records USING (record_id)", "records", extra=FIRST_ANSWER))
def q_pair_with_gold(spark, sf):
    """Each conversation's first answer paired with its gold (the last
    answer) by key, with the pairing checks on."""
    conv = td.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    cand = conv.groupBy(F.col("conv_id").alias("record_id")).agg(
        F.min_by("text", "turn").alias("candidate"))
    cand = cand.select(F.lit("first_turn").alias("method"), F.lit(1).alias("step"),
                       "record_id", "candidate")
    return E.pair_with_gold(cand, td.records(spark, sf)).select(*KEYS, "candidate", "reference")


@query("unpaired_rows", with_views(
    "SELECT t.run AS method, 'gold_only' AS side, r.record_id FROM records r, "
    "(SELECT DISTINCT role AS run FROM conversations) t "
    "WHERE NOT EXISTS (FROM conversations c WHERE c.conv_id = r.record_id AND c.role = t.run) "
    "UNION ALL SELECT DISTINCT role, 'candidate_only', conv_id FROM conversations "
    "WHERE conv_id NOT IN (SELECT record_id FROM records)", "records"))
def q_unpaired_rows(spark, sf):
    """J2 for each run: the roles of the conversations stand for runs."""
    cand = td.table(spark, sf, "conversations").select(F.col("role").alias("method"), F.col("conv_id").alias("record_id"))
    return E.unpaired_rows(cand, td.records(spark, sf), run=["method"])


@query("compare_steps", _corpus_query("""
SELECT method, record_id, metric, CAST(min(step) AS INTEGER) AS first_step,
       CAST(max(step) AS INTEGER) AS last_step,
       round(arg_min(fmeasure, step), 6) AS first_score, round(arg_max(fmeasure, step), 6) AS last_score,
       round(arg_max(fmeasure, step) - arg_min(fmeasure, step), 6) AS delta
FROM long WHERE method = 'to_final' GROUP BY method, record_id, metric"""))
def q_compare_steps(spark, sf):
    c = E.compare_steps(_long_to_final(spark, sf))
    return c.select("method", "record_id", "metric", "first_step", "last_step",
                    r6("first_score").alias("first_score"), r6("last_score").alias("last_score"),
                    r6("delta").alias("delta"))


def _plan_msgs_sql(rows, outs: bool) -> str:
    """A plan step's messages as JSON in SQL."""
    def content(src, lit):
        if src == "lit":
            return Q.lit(lit)
        return Q.clean("r.input") if src == "note" else (f"o.{src}" if outs else "CAST(NULL AS VARCHAR)")
    return Q.json_msgs(*[(role, content(src, lit)) for _, role, src, lit in rows])


def _plan_parts_sql(plans: dict, frm: str, outs: bool) -> str:
    """One row per record and step of each plan whose answers exist."""
    parts = []
    for flow, plan in plans.items():
        for step, rows in G.plan_steps(plan).items():
            have = [f"o.out{j} IS NOT NULL" for j in G.needed_outputs(plan, step)] if outs else []
            parts.append(f"SELECT '{flow}' AS flow, {step} AS step, r.record_id, {_plan_msgs_sql(rows, outs)} AS messages "
                         f"FROM {frm}" + (" WHERE " + " AND ".join(have) if have else ""))
    return " UNION ALL ".join(parts)


PLANS = {**{f: f for f in FLOW_TURNS}, "short": SHORT_PLAN}
N_OUTS = max(j for p in PLANS.values() for k in G.plan_steps(p) for j in G.needed_outputs(p, k))


@query("attach_prompt_plan", with_views(_plan_parts_sql(PLANS, "records r", False), "records"))
def q_attach_prompt_plan(spark, sf):
    """Every record with the messages of each step of each plan (model
    answers not yet known: NULL), one message array per record and step."""
    recs = td.records(spark, sf).select("record_id", X.clean_text("input").alias("note"), *[
        F.lit(None).cast("string").alias(f"out{j}") for j in range(1, N_OUTS + 1)])
    parts = [F.struct(F.lit(flow).alias("flow"), F.lit(step).alias("step"), G.step_history(step, plan).alias("m"))
             for flow, plan in PLANS.items() for step in G.plan_steps(plan)]
    plan = recs.select("record_id", F.inline(F.array(*parts)))
    return plan.select("flow", "step", "record_id",
                       F.to_json("m", {"ignoreNullFields": "false"}).alias("messages"))


# ====================================================================== generation (G*)

def _asst_outputs(spark, sf) -> DataFrame:
    """Earlier outputs of each conversation: out_k = k-th assistant turn."""
    a = td.pairs(spark, sf)
    return a.groupBy("record_id").agg(*[
        F.max(F.when(F.col("step") == k, F.col("candidate"))).alias(f"out{k}") for k in range(1, N_OUTS + 1)])


OUTS_SQL = {"outs": "SELECT conv_id AS record_id, " + ", ".join(
    f"max(CASE WHEN step = {k} AND next_text IS NOT NULL THEN text END) AS out{k}"
    for k in range(1, N_OUTS + 1)) + " FROM asst GROUP BY conv_id"}


@query("step_history", with_views(
    _plan_parts_sql(PLANS, "records r JOIN outs o USING (record_id)", True), "records", "asst", extra=OUTS_SQL))
def q_step_history(spark, sf):
    """P10: message lists of all plans' steps where the earlier outputs exist
    (the conversation's assistant turns stand in for the model outputs)."""
    base = td.records(spark, sf).select("record_id", X.clean_text("input").alias("note"))
    state = base.join(_asst_outputs(spark, sf), "record_id", "left")
    parts = []
    for flow, plan in PLANS.items():
        for step in G.plan_steps(plan):
            have = F.lit(True)
            for j in G.needed_outputs(plan, step):
                have = have & F.col(f"out{j}").isNotNull()
            parts.append(F.when(have, F.struct(F.lit(flow).alias("flow"), F.lit(step).alias("step"),
                                               G.step_history(step, plan).alias("m"))))
    h = state.select("record_id", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("h"))
    return h.select("h.flow", "h.step", "record_id", F.to_json("h.m").alias("messages"))


SINGLE_ANSWER = f"replace({Q.clean('input')}, '. ', '; ')"


@query("generate_single", with_views(
    f"SELECT record_id, {SINGLE_ANSWER} AS candidate FROM records", "records"))
def q_generate_single(spark, sf):
    recs = td.records(spark, sf)
    msgs = recs.select("record_id", C.messages_system_user(X.clean_text("input")).alias("messages"))
    out = G.generate(msgs, extractive_responder, settings=settings_for("single_prompt"),
                     keep=["record_id"])
    return cut_lineage(out, spark, "single").select("record_id", "candidate")


@query("generate_within_budget", with_views(
    f"SELECT record_id, {SINGLE_ANSWER} AS candidate, true AS within FROM records", "records"))
def q_generate_within_budget(spark, sf):
    """G1 in calls of at most 16,384 tokens, padding counted."""
    budget = 16_384
    recs = td.records(spark, sf)
    msgs = recs.select("record_id", C.messages_system_user(X.clean_text("input")).alias("messages"))
    out = G.generate(msgs, extractive_responder, settings=settings_for("single_prompt"), keep=["record_id"],
                     call_tokens=budget, count=lambda chat: sum(len(m["content"].split()) + 4 for m in chat))
    return cut_lineage(out, spark, "budgeted").select(
        "record_id", "candidate", ((F.col("call_padded") <= budget) & (F.col("call_tokens") <= F.col("call_padded"))).alias("within"))


@query("generate_resumed", with_views(
    f"SELECT record_id, {SINGLE_ANSWER} AS candidate, record_id % 3 = 0 AS kept FROM records", "records"))
def q_generate_resumed(spark, sf):
    """G1 on a folder that already holds the answers of every third record:
    those keep their calls, the rest is asked."""
    recs = td.records(spark, sf)
    msgs = recs.select("record_id", C.messages_system_user(X.clean_text("input")).alias("messages"))
    path = shared_path(spark, "resumed")
    third = F.pmod("record_id", F.lit(3)) == 0
    before = cut_lineage(G.generate_resumable(msgs.where(third), extractive_responder, path), spark, "before")
    after = G.generate_resumable(msgs, extractive_responder, path)
    calls = before.select("record_id", F.col("call_id").alias("_first"))
    return after.join(calls, "record_id", "left").select(
        "record_id", "candidate", F.coalesce(F.col("_first") == F.col("call_id"), F.lit(False)).alias("kept"))


@query("generate_validated", with_views(f"""
SELECT record_id, CAST(CASE WHEN ok1 THEN 1 WHEN ok2 THEN 2 ELSE 3 END AS INTEGER) AS try_no,
       CASE WHEN ok1 THEN c1 WHEN ok2 THEN c2 ELSE c3 END AS candidate,
       CASE WHEN ok1 OR ok2 OR ok3 THEN 'valid' ELSE 'rejected' END AS status
FROM (SELECT *, strpos(c1, ';') > 0 AND length(c1) < 400 AS ok1, strpos(c2, ';') > 0 AND length(c2) >= 12 AS ok2,
             strpos(c3, ';') > 0 AND length(c3) >= 12 AS ok3
      FROM (SELECT record_id, {SINGLE_ANSWER} AS c1, array_to_string(string_split(note, ' ')[1:2], '; ') AS c2,
                   array_to_string(string_split(note, ' ')[1:3], '; ') AS c3
            FROM (SELECT record_id, input, {Q.clean('input')} AS note FROM records)))""", "records"))
def q_generate_validated(spark, sf):
    """F3 into G2: a list of fewer than 400 characters is asked for; after a
    rejected answer, one of at least 12."""
    recs = td.records(spark, sf).select("record_id", X.clean_text("input").alias("note"))
    msgs = recs.select("record_id", F.array(C.message("user", F.col("note"))).alias("messages"))
    listed = F.col("candidate").contains(";")
    first = F.col("candidate").contains("; ") & (F.size("messages") == 1) & (F.length("candidate") < 400)
    later = (F.size("messages") > 1) & (F.length("candidate") >= 12)
    return G.generate_validated(spark, msgs, correcting_responder, listed & (first | later), AGAIN, tries=3)


@query("generate_flow", with_views(
    f"SELECT 'flow' AS method, CAST(k AS INTEGER) AS step, record_id, "
    f"array_to_string(items[1:greatest(len(items) - (k - 1), 1)], '; ') AS candidate "
    f"FROM (SELECT record_id, string_split({SINGLE_ANSWER}, '; ') AS items FROM records) "
    f"CROSS JOIN range(1, 6) AS s(k)", "records"))
def q_generate_flow(spark, sf):
    resp = G.generate_flow(spark, td.records(spark, sf), extractive_responder, settings=settings_for("flow"))
    return resp.select("method", "step", "record_id", "candidate")


@query("generate_user_flow", with_views(
    f"SELECT 'user' AS method, CAST(k AS INTEGER) AS step, record_id, "
    f"array_to_string(items[1:greatest(len(items) - (k - 1), 1)], '; ') AS candidate "
    f"FROM (SELECT record_id, string_split({SINGLE_ANSWER}, '; ') AS items FROM records) "
    f"CROSS JOIN range(1, 4) AS s(k)", "records"))
def q_generate_user_flow(spark, sf):
    """G2 with a plan of the user's own, of three steps."""
    resp = G.generate_flow(spark, td.records(spark, sf), extractive_responder, plan=SHORT_PLAN, method="user",
                           settings=settings_for("flow"))
    return resp.select("method", "step", "record_id", "candidate")


@query("scored_step", with_views(
    f"SELECT a.method, a.step, a.record_id, a.candidate FROM answers a "
    f"JOIN ({RUN_CONFIG_SQL['run_config']}) c USING (method) WHERE a.step = c.scored_step", "answers"))
def q_scored_step(spark, sf):
    resp = td.scored_answers(spark, sf).select(*KEYS, "candidate")
    return G.scored_step(resp, run_config(spark))


@query("extract_last_message",
       "SELECT conv_id AS record_id, arg_max(text, turn) AS content FROM conversations "
       "WHERE text IS NOT NULL GROUP BY conv_id")
def q_extract_last_message(spark, sf):
    """The answer is the content of the last message of a returned chat.
    The chats are the conversations' first and last messages as they stand,
    whatever their roles: a bounded array, taken apart by position."""
    conv = td.table(spark, sf, "conversations").where("text IS NOT NULL")
    chats = conv.groupBy(F.col("conv_id").alias("record_id")).agg(F.array(
        F.min_by(C.message(F.col("role"), "text"), "turn"), F.max_by(C.message(F.col("role"), "text"), "turn")).alias("m"))
    return chats.select("record_id", X.extract_last_message("m").alias("content"))


DECODED_USER = "r.instruction || ' ' || r.input"
_KEPT = "record_id % 3 <> 0"


@query("extract_decoded", with_views(
    f"SELECT method, step, record_id, CASE WHEN {_KEPT} THEN candidate ELSE 'x' || p || candidate END AS new_text, "
    f"CAST(length(p) AS INTEGER) AS prompt_chars, CASE WHEN {_KEPT} THEN p ELSE 'x' || p END || candidate AS scored_whole "
    f"FROM (SELECT a.method, a.step, a.record_id, a.candidate, {Q.inst_single(DECODED_USER)} AS p "
    "FROM answers a JOIN records r USING (record_id))", "answers", "records"))
def q_extract_decoded(spark, sf):
    """Answers decoded together with their prompt; the new text is what
    follows the rendered prompt. A third of the sequences don't start with
    the prompt and stay whole. ``scored_whole`` is the candidate as a script
    scores it that keeps the prompt."""
    recs = td.records(spark, sf).select("record_id", C.render_inst(C.messages_user()).alias("prompt"))
    a = td.scored_answers(spark, sf).select(*KEYS, "candidate").join(recs, "record_id")
    lead = F.when(F.pmod("record_id", F.lit(3)) == 0, F.lit("x")).otherwise(F.lit(""))
    dec = a.withColumn("decoded", F.concat(lead, "prompt", "candidate"))
    return dec.select(*KEYS, X.strip_prompt("decoded", "prompt").alias("new_text"),
                      F.length("prompt").alias("prompt_chars"), F.col("decoded").alias("scored_whole"))


@query("cut_at_terminator", with_views(
    "SELECT method, step, record_id, CASE record_id % 3 WHEN 2 THEN candidate || ' ' || reference ELSE candidate END "
    "AS answer FROM answers", "answers"))
def q_cut_at_terminator(spark, sf):
    """Answers as a generator returns them, cut at the first terminator:
    both markers in either order, or none at all."""
    a = td.scored_answers(spark, sf)
    first, second = F.lit(EOT), F.lit(INST_EOS)
    kind = F.pmod("record_id", F.lit(3))
    raw = (F.when(kind == 0, F.concat("candidate", first, F.lit("assistant"), second, "reference"))
           .when(kind == 1, F.concat("candidate", second, F.lit(" "), first, "reference"))
           .otherwise(F.concat("candidate", F.lit(" "), "reference")))
    return a.select(*KEYS, X.cut_at_terminator(raw).alias("answer"))


@query("run_settings", _corpus_query(
    "SELECT c.method, c.step, c.metric, round(c.fmeasure, 6) AS fmeasure, "
    "CAST(r.max_new_tokens AS INTEGER) AS max_new_tokens, CAST(r.temperature AS DOUBLE) AS temperature, "
    "CAST(r.top_p AS DOUBLE) AS top_p "
    f"FROM corpus c LEFT JOIN ({RUN_CONFIG_SQL['run_config']}) r USING (method)"))
def q_run_settings(spark, sf):
    rep = G.attach_run_settings(_corpus(spark, sf), run_config(spark))
    return rep.select("method", "step", "metric", r6("fmeasure").alias("fmeasure"),
                      "max_new_tokens", "temperature", "top_p")


# ====================================================================== text and chat (P*)

@query("clean_text", f"SELECT doc_id, {Q.clean('text')} AS text FROM documents")
def q_clean_text(spark, sf):
    return td.docs(spark, sf, spread=SPREAD).select("doc_id", X.clean_text("text").alias("text"))


@query("clean_scope", with_views(
    f"SELECT record_id, {Q.clean('instruction')} AS instruction, {Q.clean('input')} AS input, output "
    f"FROM records", "records"))
def q_clean_scope(spark, sf):
    return X.clean_scope(td.records(spark, sf), ("instruction", "input"))


@query("select_fields", with_views("SELECT instruction, input, output FROM records", "records"))
def q_select_fields(spark, sf):
    return td.records(spark, sf).select("instruction", "input", "output")


@query("single_prompt", with_views(
    "SELECT record_id, instruction || ' ' || input AS prompt FROM records", "records"))
def q_single_prompt(spark, sf):
    return td.records(spark, sf).select("record_id", X.single_prompt().alias("prompt"))


@query("padded_prompt", with_views(
    f"SELECT record_id, {Q.padded('input')} AS prompt FROM records", "records"))
def q_padded_prompt(spark, sf):
    return td.records(spark, sf).select("record_id", X.padded_prompt().alias("prompt"))


@query("messages_user", with_views(
    f"SELECT record_id, {Q.json_msgs(('user', "(instruction || ' ' || input)"))} "
    f"AS messages FROM records", "records"))
def q_messages_user(spark, sf):
    return td.records(spark, sf).select("record_id", C.messages_to_json(C.messages_user()).alias("messages"))


@query("messages_system_user", with_views(
    f"SELECT record_id, {Q.json_msgs(('system', Q.SYS_COVERAGE), ('user', Q.clean('input')))} "
    f"AS messages FROM records", "records"))
def q_messages_system_user(spark, sf):
    r = td.records(spark, sf)
    return r.select("record_id", C.messages_to_json(
        C.messages_system_user(X.clean_text("input"))).alias("messages"))


@query("messages_training", _sft_sql(
    f"SELECT split, record_id, {Q.json_msgs(('system', Q.lit(C.SYSTEM_CONCISE)), ('user', Q.padded('input')), ('assistant', 'output'))} "
    f"AS messages FROM sft", count=False))
def q_messages_training(spark, sf):
    r = _sft_records(spark, sf)
    return r.select("split", "record_id", C.messages_to_json(C.messages_training()).alias("messages"))


@query("messages_generation", _sft_sql(
    f"SELECT split, record_id, {Q.json_msgs(('system', Q.lit(C.SYSTEM_CONCISE)), ('user', Q.padded('input')))} "
    f"AS messages FROM sft", count=False))
def q_messages_generation(spark, sf):
    r = _sft_records(spark, sf)
    return r.select("split", "record_id", C.messages_to_json(C.messages_generation()).alias("messages"))


def _rendered_sql(msg, lead: str, tail: str, drop_system: bool) -> str:
    """Rendered histories of all plans' steps in SQL."""
    def content(src, lit):
        return Q.lit(lit) if src == "lit" else Q.clean("r.input") if src == "note" else f"o.{src}"
    parts = []
    for flow, plan in PLANS.items():
        for step, rows in G.plan_steps(plan).items():
            have = " AND ".join(["true", *[f"o.out{j} IS NOT NULL" for j in G.needed_outputs(plan, step)]])
            body = " || ".join(msg(role, content(src, lit)) for _, role, src, lit in rows
                               if not (drop_system and role == "system"))
            parts.append(f"SELECT '{flow}' AS flow, {step} AS step, r.record_id, {lead} || {body}{tail} AS prompt "
                         f"FROM records r JOIN outs o USING (record_id) WHERE {have}")
    return with_views(" UNION ALL ".join(parts), "records", "asst", extra=OUTS_SQL)


def _histories(spark, sf) -> DataFrame:
    """(flow, step, record_id, m): message arrays of all plans' steps."""
    h = q_step_history(spark, sf)
    return h.select("flow", "step", "record_id", F.from_json("messages", f"array<{C.MESSAGE}>").alias("m"))


@query("render_llama3_chat", _rendered_sql(
    Q.llama_msg, Q.lit(C.BOS), f" || {Q.lit(HDR_START + 'assistant' + HDR_END)} || {Q.NL} || {Q.NL}", False))
def q_render_llama3_chat(spark, sf):
    """P11 on histories of every length, with the generation header."""
    return _histories(spark, sf).select("flow", "step", "record_id",
                                        C.render_llama3("m", add_generation_prompt=True).alias("prompt"))


@query("render_inst_chat", _rendered_sql(
    lambda role, c: f"{Q.lit(INST_OPEN)} || {c} || {Q.lit(INST_CLOSE)}" if role == "user" else f"{c} || {Q.lit(INST_EOS)}",
    Q.lit(INST_BOS), "", True))
def q_render_inst_chat(spark, sf):
    """P12 on histories of every length, without their system prompt, which
    the format doesn't know."""
    h = _histories(spark, sf).withColumn("m", F.filter("m", lambda x: x["role"] != "system"))
    return h.select("flow", "step", "record_id", C.render_inst("m").alias("prompt"))


@query("answer_vs_prediction", with_views(
    f"SELECT method, step, record_id, {Q.NL} || 'answer: ' || reference || {Q.NL} || 'prediction: ' "
    f"|| candidate || {Q.NL} AS block FROM answers", "answers"))
def q_answer_vs_prediction(spark, sf):
    a = td.scored_answers(spark, sf)
    return a.select(*KEYS, X.answer_vs_prediction("reference", "candidate").alias("block"))


# ====================================================================== filters (F*)

@query("within_token_budget",
       f"SELECT doc_id, CAST({Q.count_tokens('text')} AS INTEGER) AS token_count FROM documents "
       f"WHERE {Q.count_tokens('text')} < 512")
def q_within_token_budget(spark, sf):
    return S.within_budget_of_text(td.docs(spark, sf, spread=SPREAD), "text", keep=["doc_id"])


@query("null_flags", """
SELECT doc_id, text IS NULL AS text_null, quality IS NULL AS quality_null, toxic IS NULL AS toxic_null
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_null_flags(spark, sf):
    return _docs_label_flags(spark, sf)


@query("valid_response", with_views("""
SELECT method, step, record_id, is_empty, no_separator, too_long, echoes_prompt,
       CASE WHEN is_empty OR no_separator OR too_long OR echoes_prompt THEN 'rejected' ELSE 'valid' END
         AS status
FROM (SELECT a.method, a.step, a.record_id,
             len(list_filter(list_transform(string_split(a.candidate, ';'), lambda x: trim(x, {WS})),
                             lambda x: x <> '')) = 0 AS is_empty,
             strpos(a.candidate, ';') = 0 AS no_separator,
             length(a.candidate) > length(r.input) AS too_long,
             strpos(a.candidate, r.input) > 0 AS echoes_prompt
      FROM answers a JOIN records r USING (record_id))""".replace("{WS}", Q.WS), "answers", "records"))
def q_valid_response(spark, sf):
    a = td.scored_answers(spark, sf).select(*KEYS, "candidate")
    r = td.records(spark, sf).select("record_id", "input")
    return E.valid_response(a.join(r, "record_id"), keys=KEYS)


@query("parse_diagnosis_list", with_views("""
SELECT method, step, record_id, CAST(item_idx AS INTEGER) AS item_idx, item
FROM (SELECT method, step, record_id,
             list_filter(list_transform(string_split(replace(candidate, '. ', '; '), ';'),
                                        lambda x: trim(x, {WS})), lambda x: x <> '') AS items
      FROM answers), unnest(range(0, len(items))) AS u(item_idx), LATERAL (SELECT items[item_idx + 1] AS item)
""".replace("{WS}", Q.WS), "answers"))
def q_parse_diagnosis_list(spark, sf):
    """answers as a list (the test texts use '. ' where a model answer
    would use '; '), one row per item with its rank."""
    a = td.scored_answers(spark, sf)
    items = X.parse_list(F.replace(F.col("candidate"), F.lit(". "), F.lit("; ")))
    return a.select(*KEYS, F.posexplode(items).alias("item_idx", "item"))


# ====================================================================== fine-tuning (T*)

@query("format_training_text", _sft_sql("SELECT split, record_id, text FROM sft_text", count=False))
def q_format_training_text(spark, sf):
    return S.format_training_text(_sft_records(spark, sf)).select("split", "record_id", "text")


@query("token_count", _sft_sql("SELECT split, record_id, token_count FROM sft_count", source="doc_records"))
def q_token_count(spark, sf):
    return S.prepare_sft(_sft_docs(spark, sf)).select("split", "record_id", "token_count")


TOKS_SFT = {"sft_tok": f"SELECT split, record_id, regexp_extract_all(text, {Q.COUNT_PATTERN}) AS tok "
                       f"FROM sft_text"}


@query("truncate_to_budget", _sft_sql(
    "SELECT split, record_id, CAST(len(tok[1:512]) AS INTEGER) AS n_kept, len(tok) > 512 AS truncated, "
    "array_to_string(tok[1:512], ' ') AS kept FROM sft_tok", False, "doc_records", TOKS_SFT))
def q_truncate_to_budget(spark, sf):
    from notewise.functions.tokens import budget_tokens
    t = S.format_training_text(_sft_docs(spark, sf)).select(
        "split", "record_id", budget_tokens("text").alias("tok"))
    kept = S.truncate("tok")
    return t.select("split", "record_id", F.size(kept).alias("n_kept"),
                    (F.size("tok") > 512).alias("truncated"), F.array_join(kept, " ").alias("kept"))


LABELS_SQL = {
    "lab_pos": ("SELECT split, record_id, tok, kept, "
                "coalesce(len(kept) - list_position(list_reverse(kept), '<|end_header_id|>') + 1, 0) AS hk, "
                "coalesce(len(tok) - list_position(list_reverse(tok), '<|end_header_id|>') + 1, 0) AS hf "
                "FROM (SELECT split, record_id, tok, tok[1:512] AS kept FROM sft_tok)"),
    "lab": ("SELECT split, record_id, hk, hf, list_transform(range(0, len(kept)), lambda i: "
            "CASE WHEN hk = 0 OR i + 1 <= hk THEN -100 ELSE i END) AS labels FROM lab_pos"),
}


@query("completion_labels", _sft_sql(
    "SELECT split, record_id, CAST(to_json(labels) AS VARCHAR) AS labels FROM lab", False, "doc_records",
    {**TOKS_SFT, **LABELS_SQL}))
def q_completion_labels(spark, sf):
    lf = S.label_frame(S.format_training_text(_sft_docs(spark, sf)))
    return lf.select("split", "record_id", F.to_json("labels").alias("labels"))


#: the response header, a marker of three tokens
RESPONSE = HDR_START + "assistant" + HDR_END
_ID_SQL = "len(x) * 65536 + unicode(x) % 65536"
IDS_SQL = {
    "id_text": f"SELECT split, record_id, CASE WHEN record_id % 7 = 0 THEN text || {Q.lit(RESPONSE)} || ' again' "
               f"WHEN record_id % 7 = 1 THEN replace(text, {Q.lit(HDR_START + 'assistant')}, '') ELSE text END AS text FROM sft_text",
    "id_lists": f"SELECT split, record_id, list_transform(regexp_extract_all(text, {Q.COUNT_PATTERN}), "
                f"lambda x: {_ID_SQL})[1:512] AS ids FROM id_text",
    "id_marker": f"SELECT list_transform(regexp_extract_all({Q.lit(RESPONSE)}, {Q.COUNT_PATTERN}), lambda x: {_ID_SQL}) AS m",
    "id_end": "SELECT split, record_id, ids, coalesce(list_max(list_filter(range(1, len(ids) - 1), "
              "lambda i: ids[i:i + 2] = m)) + 2, 0) AS hk FROM id_lists, id_marker",
}


@query("completion_labels_ids", _sft_sql(
    "SELECT split, record_id, CAST(len(ids) AS INTEGER) AS n_ids, CAST(to_json(list_transform(range(0, len(ids)), lambda i: "
    "CASE WHEN hk = 0 OR i < hk THEN -100 ELSE ids[i + 1] END)) AS VARCHAR) AS labels FROM id_end", False, "doc_records",
    IDS_SQL))
def q_completion_labels_ids(spark, sf):
    """T4 over token ids from a batch tokenizer, the response header being a
    marker of three ids: present, written twice, absent, or cut off."""
    rid = F.pmod("record_id", F.lit(7))
    t = S.format_training_text(_sft_docs(spark, sf))
    text = (F.when(rid == 0, F.concat("text", F.lit(RESPONSE + " again")))
            .when(rid == 1, F.replace("text", F.lit(HDR_START + "assistant"), F.lit(""))).otherwise(F.col("text")))
    ids = S.truncate(S.token_ids_with(regex_ids)("text"), 512)
    rows = t.withColumn("text", text).select("split", "record_id", ids.alias("ids"))
    return rows.select("split", "record_id", F.size("ids").alias("n_ids"),
                       F.to_json(S.completion_labels_of_ids("ids", regex_ids([RESPONSE])[0])).alias("labels"))


@query("supervision_audit", _sft_sql(
    "SELECT split, count(*) AS n_rows, "
    "round(avg(len(list_filter(labels, lambda x: x <> -100))), 6) AS avg_supervised, "
    "count(*) FILTER (WHERE len(list_filter(labels, lambda x: x <> -100)) = 0) AS rows_unsupervised, "
    "count(*) FILTER (WHERE hf <> hk) AS rows_header_cut FROM lab GROUP BY split", False, "doc_records",
    {**TOKS_SFT, **LABELS_SQL}))
def q_supervision_audit(spark, sf):
    lf = S.label_frame(S.format_training_text(_sft_docs(spark, sf)))
    a = S.supervision_audit(lf)
    return a.select("split", "n_rows", r6("avg_supervised").alias("avg_supervised"),
                    "rows_unsupervised", "rows_header_cut")


@query("first_eval_prompt", _sft_sql(
    f"SELECT record_id, output, {Q.generation_prompt('input')} AS prompt FROM sft "
    f"WHERE split = 'validation' ORDER BY record_id LIMIT 1", count=False))
def q_first_eval_prompt(spark, sf):
    return S.first_eval_prompt(_sft_records(spark, sf))


EXPORT_SCHEMA = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()), T.StructField("output", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("token_count", T.IntegerType()),
])


def _export(spark, sf) -> str:
    path = shared_path(spark, "sft-export")
    sft = S.prepare_sft(_sft_records(spark, sf))
    SR.write_jsonl_splits(sft.select("split", *[f.name for f in EXPORT_SCHEMA.fields]), path)
    return path


@query("export_sft_dataset", _sft_sql(
    "SELECT split, instruction, input, output, text, token_count FROM sft_count"))
def q_export_sft_dataset(spark, sf):
    path = _export(spark, sf)
    back = SR.reload_splits(spark, path, EXPORT_SCHEMA)
    return back.select("split", "instruction", "input", "output", "text", "token_count")


# ====================================================================== sources and sinks (S*)

def _write_arrays(spark, df, name, **kw) -> str:
    path = shared_path(spark, name)
    SR.write_record_arrays(df, path, **kw)
    return path


@query("read_records", with_views(
    f"SELECT record_id, {Q.clean('instruction')} AS instruction, {Q.clean('input')} AS input, output "
    f"FROM records", "records"))
def q_read_records(spark, sf):
    path = _write_arrays(spark, td.records(spark, sf), "records-json", chunk=1024)
    return SR.read_records(spark, path, id_key="id")


@query("read_array_blocks", with_views(
    f"SELECT record_id, CASE WHEN record_id % 13 = 4 THEN 'malformed' END AS reason, "
    f"CASE WHEN record_id % 13 <> 4 THEN {Q.clean('input')} END AS input, "
    f"CASE WHEN record_id % 13 <> 4 THEN output END AS output FROM records", "records"))
def q_read_array_blocks(spark, sf):
    """S1 from one array file, read in blocks of 64 KB; every thirteenth
    element is broken and rejected alone."""
    recs = td.records(spark, sf)
    line = F.to_json(F.struct(F.col("record_id").alias("id"), "instruction", "input", "output"))
    broken = F.pmod("record_id", F.lit(13)) == 4
    obj = F.when(broken, F.concat(F.lit('{"bad": tru, '), F.substring(line, 2, 1 << 30))).otherwise(line)
    path = _write_arrays(spark, recs.withColumn("obj", obj).coalesce(1), "records-one", chunk=1 << 40, chunk_bytes=1 << 50,
                         obj_col="obj")
    v = SR.validate_records(AB.parse_record_blocks(spark, path, id_key="id", block_bytes=1 << 16))
    rid = F.coalesce("record_id", F.regexp_extract("raw", r'"id":(\d+)', 1).try_cast("bigint"))
    note = F.when(F.col("reason").isNull(), X.clean_text("input"))
    return v.select(rid.alias("record_id"), "reason", note.alias("input"),
                    F.when(F.col("reason").isNull(), F.col("output")).alias("output"))


def _with_edge_rows(recs: DataFrame) -> F.Column:
    """Objects with a missing ``output`` key (id % 7 = 3) or a JSON null
    ``input`` (id % 11 = 5), derived from real records by rule."""
    full = F.to_json(F.struct(F.col("record_id").alias("id"), "instruction", "input", "output"),
                     {"ignoreNullFields": "false"})
    no_out = F.to_json(F.struct(F.col("record_id").alias("id"), "instruction", "input"),
                       {"ignoreNullFields": "false"})
    null_in = F.to_json(F.struct(F.col("record_id").alias("id"), "instruction",
                                 F.lit(None).cast("string").alias("input"), "output"),
                        {"ignoreNullFields": "false"})
    rid = F.col("record_id")
    return (F.when(F.pmod(rid, F.lit(7)) == 3, no_out)
            .when(F.pmod(rid, F.lit(11)) == 5, null_in).otherwise(full))


EDGE_REASON_SQL = ("CASE WHEN record_id % 7 = 3 THEN 'missing_key' "
                   "WHEN record_id % 11 = 5 THEN 'null_field' END")


@query("validate_required_keys", with_views(
    f"SELECT record_id, {EDGE_REASON_SQL} AS reason FROM records", "records"))
def q_validate_required_keys(spark, sf):
    recs = td.records(spark, sf)
    path = _write_arrays(spark, recs.withColumn("obj", _with_edge_rows(recs)), "records-edge",
                         chunk=1024, obj_col="obj")
    v = SR.validate_records(SR.parse_record_files(spark, path, id_key="id"))
    return v.select("record_id", "reason")


@query("reject_malformed", with_views(
    "SELECT CASE WHEN record_id % 13 = 4 THEN 'malformed' ELSE 'ok' END AS status, count(*) AS n_lines "
    "FROM records GROUP BY 1", "records"))
def q_reject_malformed(spark, sf):
    recs = td.records(spark, sf)
    line = F.to_json(F.struct(F.col("record_id").alias("id"), "instruction", "input", "output"))
    bad = F.concat(F.lit("{broken "), line)
    path = shared_path(spark, "records-lines")
    recs.select(F.when(F.pmod("record_id", F.lit(13)) == 4, bad).otherwise(line).alias("value")) \
        .write.text(path)
    lines = SR.read_record_lines(spark, path)
    return lines.groupBy(F.when(F.col("reason") == "malformed", "malformed").otherwise("ok")
                         .alias("status")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("load_splits", with_views(
    f"SELECT split, record_id, {Q.clean('instruction')} AS instruction, {Q.clean('input')} AS input, "
    f"{Q.clean('output')} AS output FROM split_records", "split_records"))
def q_load_splits(spark, sf):
    path = _write_arrays(spark, td.split_records(spark, sf), "splits-json", chunk=1024, by="split")
    paths = {s: f"{path}/split={s}" for s in ("train", "validation", "test")}
    return SR.load_splits(spark, paths, id_key="id").select(
        "split", "record_id", "instruction", "input", "output")


@query("write_jsonl_splits", _sft_sql(
    "SELECT split, count(*) AS n_lines, CAST(sum(token_count) AS BIGINT) AS total_tokens "
    "FROM sft_count GROUP BY split"))
def q_write_jsonl_splits(spark, sf):
    path = _export(spark, sf)
    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), "split=([a-z]+)", 1).alias("split"),
        F.get_json_object("value", "$.token_count").cast("bigint").alias("tc"))
    return lines.groupBy("split").agg(F.count(F.lit(1)).alias("n_lines"),
                                      F.sum("tc").alias("total_tokens"))


@query("reload_splits", _sft_sql(
    "SELECT split, record_id, instruction, input, output, text, token_count FROM sft_count"))
def q_reload_splits(spark, sf):
    back = SR.reload_splits(spark, _export(spark, sf), EXPORT_SCHEMA)
    return back.select("split", "record_id", "instruction", "input", "output", "text", "token_count")


@query("head_records", with_views(
    "SELECT split, record_id, rn, instruction, input, output FROM (SELECT *, "
    "row_number() OVER (PARTITION BY split ORDER BY record_id) AS rn FROM split_records) WHERE rn <= 5",
    "split_records"))
def q_head_records(spark, sf):
    h = SR.head_records(td.split_records(spark, sf), 5)
    return h.select("split", "record_id", F.col("rn").cast("bigint").alias("rn"),
                    "instruction", "input", "output")


@query("save_outputs", with_views(
    "SELECT method, step, a.record_id, candidate, output FROM answers a "
    "LEFT JOIN (FROM records WHERE record_id % 5 <> 0) r ON a.record_id = r.record_id",
    "answers", "records"))
def q_save_outputs(spark, sf):
    """S8; a fifth of the records have lost their gold text."""
    path = shared_path(spark, "outputs")
    resp = td.scored_answers(spark, sf).select(*KEYS, "candidate")
    gold = td.records(spark, sf).where("record_id % 5 <> 0")
    SR.save_outputs(resp, gold, path)
    SR.save_outputs(resp.where("method = 'to_next' AND step = 1"), gold, path, replace=True)     # one run again
    back = spark.read.parquet(path)
    return back.select("method", F.col("step").cast("int").alias("step"), "record_id",
                       "candidate", "output")
