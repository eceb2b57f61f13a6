"""ROUGE-1, ROUGE-2, ROUGE-L and ROUGE-Lsum as one Spark job.

Texts are normalised once per pair, in the JVM, to their tokens with one
blank between them. One Arrow UDF then counts everything the metrics are
made of: n-gram overlaps (R3), a bit-parallel LCS length (R6) and the
summary-level union LCS (R8). Precision, recall and F are column algebra.

Argument order follows the scorer convention score(reference, candidate):
precision is measured on the candidate, recall on the reference.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from notewise.functions.tokens import scoring_text
from notewise.session import ship_package

METRICS = ("rouge1", "rouge2", "rougeL")
ALL_METRICS = METRICS + ("rougeLsum",)


# ---------------------------------------------------------------- kernels (plain Python)

def lcs_length(a, b) -> int:
    """Bit-parallel LCS length (one machine word per 64 tokens of ``a``)."""
    n = len(a)
    if n == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << n) - 1
    v = full
    for tok in b:
        m = masks.get(tok)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _token_masks(seq) -> dict:
    masks: dict = {}
    for j, tok in enumerate(seq):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    return masks


def _lcs_ref_indices(ref, can, masks: dict | None = None) -> list[int]:
    """Indices into ``ref`` of one LCS of ``ref`` and ``can``.

    Rows of the DP table are bit vectors over ``can``:
    t[i][j] = j - popcount(V_i & (2^j - 1)). Backtracking from the end takes
    a match when tokens agree, moves left only when t[i][j-1] > t[i-1][j],
    and up otherwise. Only every k-th row is kept, k the root of the number
    of rows; backtracking computes the rows of one stretch at a time again.
    ``masks``: the per-token bit masks of ``can`` when the caller has them.
    """
    n, m = len(can), len(ref)
    if n == 0 or m == 0:
        return []
    masks = _token_masks(can) if masks is None else masks
    full = (1 << n) - 1
    stretch = max(1, math.isqrt(m))

    def rows_from(v, lo, hi):
        out = [v]
        for tok in ref[lo:hi]:
            bits = masks.get(tok)
            if bits:
                u = v & bits
                v = ((v + u) | (v - u)) & full
            out.append(v)
        return out

    kept, v = [full], full
    for lo in range(0, m, stretch):
        v = rows_from(v, lo, min(m, lo + stretch))[-1]
        kept.append(v)

    out = []
    i, j, lo, rows = m, n, m, []
    while i > 0 and j > 0:
        if i <= lo or not rows:
            lo = (i - 1) // stretch * stretch
            rows = rows_from(kept[lo // stretch], lo, min(m, lo + stretch))
        if ref[i - 1] == can[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
        else:
            low = (1 << (j - 1)) - 1
            # t[i][j-1] > t[i-1][j]  <=>  (j-1) - pc(V_i & low) > j - pc(V_{i-1} & (2low+1))
            left = (j - 1) - (rows[i - lo] & low).bit_count()
            up = j - (rows[i - 1 - lo] & ((low << 1) | 1)).bit_count()
            if left > up:
                j -= 1
            else:
                i -= 1
    out.reverse()
    return out


def summary_lcs_hits(ref_sents, can_sents) -> tuple[int, int, int]:
    """(hits, reference tokens, candidate tokens) of the summary-level LCS.

    For each reference sentence the union of its LCS positions against every
    candidate sentence is taken; a token counts as a hit only while both
    sides still have an unused copy of it. Candidate masks are built once;
    a candidate sentence with no token in common adds nothing and is skipped.
    """
    ref_sents = [list(s) for s in ref_sents]
    can_sents = [list(s) for s in can_sents]
    m = sum(len(s) for s in ref_sents)
    n = sum(len(s) for s in can_sents)
    if not ref_sents or not can_sents or m == 0 or n == 0:
        return 0, m, n
    cands = [(c, _token_masks(c)) for c in can_sents if c]
    left_r = Counter(tok for s in ref_sents for tok in s)
    left_c = Counter(tok for s in can_sents for tok in s)
    hits = 0
    for r in ref_sents:
        if not r:
            continue
        rset = set(r)
        union: set = set()
        for c, masks in cands:
            if rset.isdisjoint(masks):
                continue
            union.update(_lcs_ref_indices(r, c, masks))
        for idx in sorted(union):
            tok = r[idx]
            if left_c[tok] > 0 and left_r[tok] > 0:
                hits += 1
                left_c[tok] -= 1
                left_r[tok] -= 1
    return hits, m, n


def multiset_overlap(a, b) -> int:
    """Size of the multiset intersection."""
    return sum((Counter(a) & Counter(b)).values())


# ---------------------------------------------------------------- the Arrow UDF

PAIR_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in
                            ("cand_len", "ref_len", "o1", "o2", "lcs", "lsum", "lsum_ref", "lsum_cand")])


def pair_counts(metrics=ALL_METRICS):
    """Arrow UDF over two normalised texts (``scoring_text``): the counts
    that the metrics are made of. A NULL text has no token."""
    wanted = set(metrics)

    def one(cand: str | None, ref: str | None) -> tuple:
        c, r = (cand or "").split(), (ref or "").split()
        o1 = multiset_overlap(c, r) if "rouge1" in wanted else 0
        o2 = multiset_overlap(zip(c, c[1:]), zip(r, r[1:])) if "rouge2" in wanted else 0
        lcs = lcs_length(c, r) if "rougeL" in wanted else 0
        lsum = (summary_lcs_hits([x.split() for x in (ref or "").split("\n")],
                                 [x.split() for x in (cand or "").split("\n")])
                if "rougeLsum" in wanted else (0, 0, 0))
        return (len(c), len(r), o1, o2, lcs, *lsum)

    @pandas_udf(PAIR_COUNTS)
    def counts(cand: pd.Series, ref: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(c, r) for c, r in zip(cand, ref)], columns=PAIR_COUNTS.names, dtype="int64")

    return counts


# ---------------------------------------------------------------- column algebra

def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def fmeasure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def prf(overlap: Column, cand_count: Column, ref_count: Column) -> Column:
    """ROUGE-N style: divisors floored at one."""
    p = overlap / F.greatest(cand_count, F.lit(1))
    r = overlap / F.greatest(ref_count, F.lit(1))
    return F.struct(p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                    fmeasure(p, r).cast("double").alias("fmeasure"))


def prf_lcs(lcs: Column, cand_count: Column, ref_count: Column) -> Column:
    """ROUGE-L style: all zero when either side has no token."""
    p = _safe_div(lcs, cand_count)
    r = _safe_div(lcs, ref_count)
    empty = (cand_count == 0) | (ref_count == 0)
    p = F.when(empty, F.lit(0.0)).otherwise(p)
    r = F.when(empty, F.lit(0.0)).otherwise(r)
    return F.struct(p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                    fmeasure(p, r).cast("double").alias("fmeasure"))


def count_pairs(df: DataFrame, cand: str = "candidate", ref: str = "reference", metrics=METRICS, keep=None,
                spread: int | None = None) -> DataFrame:
    """keep + ``counts`` (see ``pair_counts``): the one Python stage of
    scoring. Texts are normalised in the JVM, so Python only splits them."""
    keep = keep if keep is not None else [c for c in df.columns if c not in (cand, ref)]
    ship_package(df.sparkSession)
    if spread:
        df = df.repartition(spread, *keep)
    return df.select(*keep, pair_counts(metrics)(scoring_text(cand), scoring_text(ref)).alias("counts"))


def score_pairs(df: DataFrame, cand: str = "candidate", ref: str = "reference",
                metrics=METRICS, keep=None, spread: int | None = None) -> DataFrame:
    """Per-pair scores, one struct<precision, recall, fmeasure> per metric.

    ``keep``: key columns carried through (default: every column except the
    two texts). ``spread``: optional number of tasks to hash-spread the pairs
    over first (by ``keep``), for inputs that arrive in few large files;
    long pairs dominate the LCS kernels. A NULL text scores 0 everywhere.
    """
    t = count_pairs(df, cand, ref, metrics, keep, spread)
    kept = [c for c in t.columns if c != "counts"]
    c = {n: F.col(f"counts.{n}") for n in PAIR_COUNTS.names}
    zero = F.lit(0).cast("long")
    scores = {
        "rouge1": prf(c["o1"], c["cand_len"], c["ref_len"]),
        "rouge2": prf(c["o2"], F.greatest(c["cand_len"] - 1, zero), F.greatest(c["ref_len"] - 1, zero)),
        "rougeL": prf_lcs(c["lcs"], c["cand_len"], c["ref_len"]),
        "rougeLsum": prf_lcs(c["lsum"], c["lsum_cand"], c["lsum_ref"]),
    }
    return t.select(*kept, *[scores[m].alias(m) for m in metrics])


def scores_long(scored: DataFrame, keys, metrics=METRICS) -> DataFrame:
    """Wide per-pair scores to long rows (keys..., metric, precision, recall, fmeasure)."""
    stacked = F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}.precision").alias("precision"),
                 F.col(f"{m}.recall").alias("recall"), F.col(f"{m}.fmeasure").alias("fmeasure"))
        for m in metrics]))
    return scored.select(*keys, stacked)
