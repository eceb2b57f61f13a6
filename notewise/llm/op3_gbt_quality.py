"""Quality rules by gradient-boosted trees over document statistics.

``statistics`` turns each whole text into numbers in one pass (word, symbol,
line and repetition counts, and the ratios the trees read). The trees are
boosted on a bounded sample of labelled rows (logistic loss, histogram
splits), with monotonic constraints: a larger share of symbols, duplicate
lines, repeated words or capitals can only lower the quality. A fitted
ensemble is flattened into numpy node arrays; scoring walks all rows of an
Arrow batch down each tree together.

Edge cases: a null or empty text has no words and fails the base rule; with
no labelled row every score is 0.5; repeated rows are judged each; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: ratio the trees read -> direction of the constraint (-1: more is never better)
FEATURES = {"log_words": 0, "word_len": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
            "upper_share": -1, "digit_share": 0, "punct_share": 0, "distinct_share": 0, "same_next_share": -1,
            "words_per_line": 0, "shout_share": -1, "capital_word_share": 0}

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_SYMBOL = bytes(set(range(256)) - set(b"#*$%&|<>"))
_NOT_UPPER = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_NOT_DIGIT = bytes(set(range(256)) - set(b"0123456789"))
_NOT_PUNCT = bytes(set(range(256)) - set(b".,;:?!'\"()-"))
_CONTINUES = bytes(range(0x80, 0xC0))          # bytes inside a code point
_CAPITAL = re.compile(r"(?:^|[\x20\x09-\x0d])[A-ZÀ-ÖØ-Þ]")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, covered = 0, 0                      # covered: up to this word
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def document_numbers(text: bytes) -> tuple:
    """COUNTS, then FEATURES, of one text."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE + _CONTINUES))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    m = max(1, n)
    same = sum(a == b for a, b in zip(words, words[1:]))
    return (n, chars, symbols, dup, rep,
            np.log1p(n), chars / m, symbols / m, dup / max(1, len(lines)), rep / m,
            len(text.translate(None, _NOT_UPPER)) / max(1, chars), len(text.translate(None, _NOT_DIGIT)) / max(1, chars),
            len(text.translate(None, _NOT_PUNCT)) / m, len(set(words)) / m, same / m, n / max(1, len(lines)),
            text.count(b"!") / m, len(_CAPITAL.findall(text.decode("utf-8", "replace"))) / m)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS, *FEATURES) of (doc_id, text bytes)."""
    C.ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [document_numbers(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * (len(COUNTS) + len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array(c, pa.int64()) for c in cols[:len(COUNTS)]]
                + [pa.array(c, pa.float64()) for c in cols[len(COUNTS):]],
                names=["doc_id", *COUNTS, *FEATURES])

    schema = docs.select("doc_id").schema
    for n in COUNTS:
        schema = schema.add(n, "long")
    for n in FEATURES:
        schema = schema.add(n, "double")
    return docs.mapInArrow(run, schema)


class Trees:
    """A boosted ensemble as flat node arrays: node i of a tree splits on
    ``feature[i]`` at ``at[i]`` (to the left if not above) or is a leaf
    (feature -1) with ``value[i]``."""

    def __init__(self, bias: float, roots, feature, at, left, right, value):
        self.bias = bias
        self.roots, self.feature, self.at = np.array(roots, np.int32), np.array(feature, np.int32), np.array(at, float)
        self.left, self.right, self.value = np.array(left, np.int32), np.array(right, np.int32), np.array(value, float)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row."""
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= self.at[node]
                node = np.where(inner, np.where(go, self.left[node], self.right[node]), node)
            z += self.value[node]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
          bins: int = 64, l2: float = 1.0, min_hess: float = 2.0) -> Trees:
    """Newton boosting with histogram splits. A split on a constrained
    feature must order its leaves, and both children are held on their side
    of the middle value, so that the constraint holds below it too."""
    if len(y) == 0 or y.min() == y.max():
        return Trees(0.0 if len(y) == 0 else (6.0 if y[0] else -6.0), [], [], [], [], [], [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), bias)
    roots, feature, at, left, right, value = [], [], [], [], [], []

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + l2) * rate, low, high))

    def grow(rows, level, low, high, grad, hess):
        me = len(feature)
        g, h = grad[rows].sum(), hess[rows].sum()
        for a, v in ((feature, -1), (at, 0.0), (left, -1), (right, -1), (value, leaf(g, h, low, high))):
            a.append(v)
        best = (1e-6, None)
        if level < depth and h >= 2 * min_hess:
            for j, c in enumerate(cuts):
                k = len(c) + 1
                gl = np.cumsum(np.bincount(binned[rows, j], weights=grad[rows], minlength=k))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], weights=hess[rows], minlength=k))[:-1]
                gr, hr = g - gl, h - hl
                gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - g ** 2 / (h + l2)
                vl, vr = np.clip(-gl / (hl + l2) * rate, low, high), np.clip(-gr / (hr + l2) * rate, low, high)
                bad = (hl < min_hess) | (hr < min_hess) | (constraints[j] * (vr - vl) < 0)
                gain = np.where(bad, -1, gain)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], (j, i, vl[i], vr[i]))
        if best[1] is None:
            z[rows] += value[me]
            return me
        j, i, vl, vr = best[1]
        mid = (vl + vr) / 2
        go = binned[rows, j] <= i
        side = constraints[j]
        feature[me], at[me] = j, float(cuts[j][i])
        left[me] = grow(rows[go], level + 1, mid if side < 0 else low, mid if side > 0 else high, grad, hess)
        right[me] = grow(rows[~go], level + 1, mid if side > 0 else low, mid if side < 0 else high, grad, hess)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
    return Trees(bias, roots, feature, at, left, right, value)


def learn(stats: DataFrame, labels: DataFrame, sample_docs: int = 20_000) -> Trees:
    """Boost on the statistics of about ``sample_docs`` labelled rows (twice
    that at most), picked by a hash of the id over all rows; ``labels`` is
    (doc_id, label). The join moves numbers alone, no text."""
    n = labels.count()
    one_in = max(1, -(-n // sample_docs))
    rows = (stats.select("doc_id", *FEATURES)
            .join(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0), "doc_id")
            .limit(2 * sample_docs).select("label", *FEATURES).toPandas())
    return boost(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float), list(FEATURES.values()))


def judge(stats: DataFrame, trees: Trees) -> DataFrame:
    """``stats`` (doc_id, COUNTS, FEATURES) with the ensemble's score added
    and the features left out."""
    names = list(FEATURES)
    shared = stats.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ["doc_id", *COUNTS]]
                                             + [pa.array(shared.value.score(x), pa.float64())],
                                             names=["doc_id", *COUNTS, "score"])

    return stats.mapInArrow(run, stats.select("doc_id", *COUNTS).schema.add("score", "double"))


def base_failed() -> Column:
    """Too few words, or more than half of them repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label): each document's quality mark."""
    return (labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id")
            .agg(F.max("quality").cast("int").alias("label")))


def op3_gbt_quality(spark, sf_dir: str, keep_from: float = 0.3) -> DataFrame:
    """Judge all documents; kept from a score of ``keep_from`` on."""
    stats = C.cut_lineage(statistics(C.id_and_bytes(C.table(spark, sf_dir, "documents"))), spark, "doc-stats")
    trees = learn(stats, training_labels(C.table(spark, sf_dir, "labels")))
    return (judge(stats, trees).withColumn("base_failed", base_failed())
            .select("doc_id", *COUNTS, "base_failed",
                    (~F.col("base_failed") & (F.col("score") >= keep_from)).alias("kept"), "score"))
