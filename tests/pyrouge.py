"""Brute-force pure-Python ROUGE, written straight from the metric's
published definition (full DP tables, Counters). The test oracle for the
Spark job; slow on purpose, never used by the engine."""

from __future__ import annotations

import re
from collections import Counter


def tokenize(text: str) -> list[str]:
    return [t for t in re.sub(r"[^a-z0-9]+", " ", text.lower()).split(" ") if t]


def _ngrams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def _f(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_n(ref, cand, n):
    rt, ct = _ngrams(tokenize(ref), n), _ngrams(tokenize(cand), n)
    ov = sum(min(c, ct[g]) for g, c in rt.items())
    p = ov / max(sum(ct.values()), 1)
    r = ov / max(sum(rt.values()), 1)
    return p, r, _f(p, r)


def lcs_table(ref, can):
    t = [[0] * (len(can) + 1) for _ in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(can) + 1):
            if ref[i - 1] == can[j - 1]:
                t[i][j] = t[i - 1][j - 1] + 1
            else:
                t[i][j] = max(t[i - 1][j], t[i][j - 1])
    return t


def rouge_l(ref, cand):
    r, c = tokenize(ref), tokenize(cand)
    if not r or not c:
        return 0.0, 0.0, 0.0
    lcs = lcs_table(r, c)[-1][-1]
    p, rr = lcs / len(c), lcs / len(r)
    return p, rr, _f(p, rr)


def _backtrack(t, ref, can):
    i, j, out = len(ref), len(can), []
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.insert(0, i - 1)
            i -= 1
            j -= 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def rouge_lsum(ref, cand):
    rs = [tokenize(s) for s in ref.split("\n") if len(s)]
    cs = [tokenize(s) for s in cand.split("\n") if len(s)]
    if not rs or not cs:
        return 0.0, 0.0, 0.0
    m, n = sum(map(len, rs)), sum(map(len, cs))
    if not m or not n:
        return 0.0, 0.0, 0.0
    cr, cc = Counter(), Counter()
    for s in rs:
        cr.update(s)
    for s in cs:
        cc.update(s)
    hits = 0
    for r in rs:
        union = set()
        for c in cs:
            union |= set(_backtrack(lcs_table(r, c), r, c))
        for i in sorted(union):
            tok = r[i]
            if cc[tok] > 0 and cr[tok] > 0:
                hits += 1
                cc[tok] -= 1
                cr[tok] -= 1
    p, rr = hits / n, hits / m
    return p, rr, _f(p, rr)


def score(ref, cand):
    return {"rouge1": rouge_n(ref, cand, 1), "rouge2": rouge_n(ref, cand, 2),
            "rougeL": rouge_l(ref, cand), "rougeLsum": rouge_lsum(ref, cand)}
