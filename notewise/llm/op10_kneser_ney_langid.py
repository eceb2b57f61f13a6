"""Language identification by interpolated Kneser-Ney character models.

One model of ``order`` characters per language. All models share one table:
the hashes of every n-gram seen in training, sorted, and beside them, for
each language, the interpolated log probability of the n-gram's last
character after the ones before it, and the back-off weight of the n-gram as
a context. Scoring is a lookup in the sorted hashes (narrowed by the leading
bits), then a sum by document; n-grams that no language knows back off.
Texts count whole: letters, lower-cased; every run of other characters is
one blank.

The language with the lowest cross-entropy per character wins. A held-back
part of the training sample calibrates the score (softmax temperature) and
the rejection limit of each language: mean + ``reject_sd`` deviations, wider
for short texts. Languages with fewer than ``FOLDS`` held-back texts are also
scored by models of their own that leave a part of their texts out, and take
the deviation of the others, less where the model tells less.

Edge cases: null text, or one without a letter: ``und``, score 0, rejected;
no labelled text at all: the same for every row; rows with a null lang teach
nothing; repeated rows are predicted each; ties go to the language that
sorts first; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UND = "und"
PAD = 1                       # stands before each text
FOLDS = 5                     # every fifth text of the sample is held back
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def characters(texts: list[str], order: int):
    """(code points of all texts, start of each, letters of each): letters in
    lower case, other runs one blank, ``order - 1`` pads before each text."""
    lowered = [t.lower() for t in texts]
    head = "\x01" * (order - 1)
    lens = np.fromiter((len(t) + order - 1 for t in lowered), dtype=np.int64, count=len(texts))
    joined = head + head.join(lowered) if texts else ""
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(lens)
    starts = ends - lens
    alpha = _letters()[c]
    c = np.where(alpha, c, np.uint32(32))
    pad = np.zeros(len(c), bool)
    for k in range(order - 1):
        pad[starts + k] = True
    c[pad] = PAD
    keep = np.ones(len(c), bool)
    keep[1:] = ~((c[1:] == 32) & (c[:-1] == 32))
    kept = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(alpha)])
    return c[keep], kept[starts], letters[ends] - letters[starts]


def gram_hashes(c: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n characters that end at each position (the first
    n - 1 positions of the array are meaningless and never used)."""
    h = np.full(len(c), n, dtype=np.uint64)
    for back in range(n - 1, -1, -1):
        h *= _MUL
        h[back:] += c[:len(c) - back] if back else c
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


class Table:
    """Sorted n-gram hashes with one row of numbers each."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, loggamma: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.logp = logp[order].astype(np.float32)
        self.loggamma = loggamma[order].astype(np.float32)
        self.bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        shift = np.uint64(64 - self.bits)
        self.first = np.searchsorted(self.keys[:-1] >> shift, np.arange(1 << self.bits, dtype=np.uint64)
                                     ).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it isn't in the table."""
        pos = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        got = self.keys[pos]
        todo = np.flatnonzero(got < h)
        while len(todo):
            pos[todo] += 1
            got[todo] = now = self.keys[pos[todo]]
            todo = todo[now < h[todo]]
        return np.where((got == h) & (pos < len(self.keys) - 1), pos, -1)


class Model:
    """Kneser-Ney models of some languages in one table."""

    def __init__(self, texts: dict[str, list[str]], order: int = 4, n_chars: int | None = None):
        self.order, self.langs = order, sorted(texts)
        n_lang = len(self.langs)
        per = {}
        for j, lang in enumerate(self.langs):
            c, _, _ = characters(texts[lang], order)
            at = np.flatnonzero(c != PAD)
            h = {n: gram_hashes(c, n) for n in range(1, order + 1)}
            per[j] = {}
            for n in range(1, order + 1):
                u, i, cnt = np.unique(h[n][at], return_index=True, return_counts=True)
                i = at[i]
                per[j][n] = (u, h[n - 1][i - 1] if n > 1 else None, h[n - 1][i] if n > 1 else None, cnt)
        self.n_chars = n_chars or max(1, len(np.unique(np.concatenate([per[j][1][0] for j in per]))) if per else 1) + 1
        keys, logps, gammas = [], [], []
        lower_keys, lower_p = None, None
        ctx_gamma: dict[int, tuple] = {}
        self.gamma0 = np.zeros(n_lang)
        for n in range(1, order + 1):
            union = np.unique(np.concatenate([per[j][n][0] for j in per]))
            p = np.zeros((len(union), n_lang))
            for j in per:
                u, ctx, suf, cnt = per[j][n]
                if n < order:            # kinds of characters before it, not occurrences
                    longer_suf = per[j][n + 1][2]
                    su, sc = np.unique(longer_suf, return_counts=True)
                    cnt = sc[np.minimum(np.searchsorted(su, u), len(su) - 1)] * np.isin(u, su)
                cnt = np.maximum(cnt, 1).astype(float)
                n1, n2 = (cnt == 1).sum(), (cnt == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 else 0.5
                d = min(max(d, 0.1), 0.95)
                if n == 1:
                    total, g = cnt.sum(), d * len(cnt) / cnt.sum()
                    self.gamma0[j] = np.log(g)
                    p[:, j] = g / self.n_chars
                    p[np.searchsorted(union, u), j] += (cnt - d) / total
                else:
                    cu, inv = np.unique(ctx, return_inverse=True)
                    total = np.bincount(inv, weights=cnt)
                    g = d * np.bincount(inv) / total
                    ctx_gamma[j, n] = (cu, np.log(g))
                    p[np.searchsorted(union, u), j] += (cnt - d) / total[inv]
            if n > 1:
                # what every language gives to the union: its own part plus
                # the weight of the context times the shorter n-gram
                first = {}
                for j in per:
                    u, ctx, suf, _ = per[j][n]
                    first[j] = (u, ctx, suf)
                ctx_of = np.zeros(len(union), np.uint64)
                suf_of = np.zeros(len(union), np.uint64)
                for u, ctx, suf in first.values():
                    at = np.searchsorted(union, u)
                    ctx_of[at], suf_of[at] = ctx, suf
                shorter = lower_p[np.searchsorted(lower_keys, suf_of)]
                for j in per:
                    cu, lg = ctx_gamma[j, n]
                    at = np.minimum(np.searchsorted(cu, ctx_of), len(cu) - 1)
                    g = np.where(cu[at] == ctx_of, np.exp(lg[at]), 1.0)
                    p[:, j] += g * shorter[:, j]
            keys.append(union)
            logps.append(np.log(p))
            lower_keys, lower_p = union, p
        for n in range(1, order + 1):        # weight of an n-gram as context of n + 1
            lg = np.zeros((len(keys[n - 1]), n_lang))
            for j in range(n_lang):
                if (j, n + 1) in ctx_gamma:
                    cu, v = ctx_gamma[j, n + 1]
                    at = np.minimum(np.searchsorted(cu, keys[n - 1]), len(cu) - 1)
                    lg[:, j] = np.where(cu[at] == keys[n - 1], v[at], 0.0)
            gammas.append(lg)
        # contexts that hold pads are n-grams too, though never predicted
        for n in range(2, order + 1):
            known = keys[n - 2]
            more = [np.setdiff1d(ctx_gamma[j, n][0], known) for j in range(n_lang) if (j, n) in ctx_gamma]
            extra = np.unique(np.concatenate(more)) if more else np.zeros(0, np.uint64)
            if len(extra):
                lg = np.zeros((len(extra), n_lang))
                for j in range(n_lang):
                    cu, v = ctx_gamma[j, n]
                    at = np.minimum(np.searchsorted(cu, extra), len(cu) - 1)
                    lg[:, j] = np.where(cu[at] == extra, v[at], 0.0)
                keys.append(extra)
                logps.append(np.full((len(extra), n_lang), -np.inf))
                gammas.append(lg)
        self.table = Table(np.concatenate(keys), np.concatenate(logps), np.concatenate(gammas))
        self.temperature, self.mean, self.sd = 0.05, np.zeros(n_lang), np.ones(n_lang)

    def cross_entropy(self, texts: list[str]):
        """(nats per character by text and language, characters, letters)."""
        c, starts, letters = characters(texts, self.order)
        at = np.flatnonzero(c != PAD)
        res = np.zeros((len(c), len(self.langs)), np.float32)
        rem, add = at, None
        for n in range(self.order, 0, -1):
            row = self.table.find(gram_hashes(c, n)[rem] if n == self.order or len(rem) * 8 > len(c)
                                  else self._hash_at(c, rem, n))
            lp = self.table.logp[row]
            ok = (row >= 0) & np.isfinite(lp[:, 0])
            res[rem[ok]] = lp[ok] + (add[ok] if add is not None else 0)
            miss = ~ok
            rem = rem[miss]
            if not len(rem):
                break
            add = add[miss] if add is not None else np.zeros((len(rem), len(self.langs)), np.float32)
            if n > 1:
                ctx = self.table.find(self._hash_at(c, rem - 1, n - 1))
                add = add + np.where((ctx >= 0)[:, None], self.table.loggamma[ctx], 0)
            else:
                res[rem] = add + self.gamma0.astype(np.float32) - np.log(self.n_chars)
        lens = np.diff(np.append(starts, len(c)))
        n_chars = lens - (self.order - 1)
        sums = np.add.reduceat(np.concatenate([res, np.zeros((1, len(self.langs)), np.float32)]),
                               starts, axis=0, dtype=np.float64) if len(starts) else np.zeros((0, len(self.langs)))
        return -sums / np.maximum(n_chars, 1)[:, None], n_chars, letters

    @staticmethod
    def _hash_at(c, pos, n):
        h = np.full(len(pos), n, dtype=np.uint64)
        for back in range(n - 1, -1, -1):
            h *= _MUL
            h += c[pos - back]
            h ^= h >> np.uint64(29)
        h *= _MIX
        return h ^ (h >> np.uint64(32))

    def _left_out(self, lang: str, texts: list[str]) -> np.ndarray:
        """Cross-entropy of a language's texts, each by a model of the others;
        a single text is cut in pieces."""
        texts = [t for t in texts if _has_letter(t)]
        if len(texts) == 1:
            size = -(-len(texts[0]) // FOLDS)
            texts = [t for t in (texts[0][at:at + size] for at in range(0, len(texts[0]), size)) if _has_letter(t)]
        folds = [texts[k::FOLDS] for k in range(min(FOLDS, len(texts)))]
        if len(folds) < 2:
            return np.zeros(0)
        return np.concatenate([
            Model({lang: [t for other in folds if other is not fold for t in other]}, self.order, self.n_chars)
            .cross_entropy(fold)[0][:, 0] for fold in folds])

    def calibrate(self, texts: dict[str, list[str]], fitted: dict[str, list[str]] | None = None) -> None:
        """Temperature by likelihood, rejection limits by mean and deviation
        of the cross-entropy of each language's held-back texts, and where
        these are few, of its ``fitted`` ones, left out in turn."""
        true, ces, few, spread = [], [], [], []
        self.mean[:], self.sd[:] = np.nan, np.nan
        for j, lang in enumerate(self.langs):
            own = np.zeros(0)
            if texts.get(lang):
                ce, _, letters = self.cross_entropy(texts[lang])
                ce = ce[letters > 0]
                own = ce[:, j]
                if len(own):
                    ces.append(ce)
                    true += [j] * len(ce)
            if len(own) < FOLDS:
                few.append(j)
                own = np.append(own, self._left_out(lang, (fitted or {}).get(lang, [])))
            if len(own):
                self.mean[j], self.sd[j] = own.mean(), max(own.std(), 0.02)
                spread += [own - own.mean()]
        many = np.setdiff1d(np.arange(len(self.langs)), few)
        if len(many):
            # the nearer a model is to uniform, the less texts differ under it
            uniform = np.log(self.n_chars)
            told = (uniform - self.mean[few]) / max(uniform - self.mean[many].mean(), 1e-9)
            self.mean[few] = np.minimum(self.mean[few], uniform)
            self.sd[few] = np.median(self.sd[many]) * np.clip(np.nan_to_num(told, nan=1.0), 0, 1)
        else:
            self.sd[few] = max(np.concatenate(spread).std(), 0.02) if spread else 0.02
        # a language without anything to leave out: as the others; alone, it accepts nothing
        known = np.isfinite(self.mean)
        self.mean[~known] = self.mean[known].mean() if known.any() else 0.0
        if ces:
            ce, true = np.concatenate(ces), np.array(true)

            def loss(t):
                z = -ce / t
                z -= z.max(1, keepdims=True)
                return -(z[np.arange(len(z)), true] - np.log(np.exp(z).sum(1))).mean()
            self.temperature = min((0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5), key=loss)

    def predict(self, texts: list[str], reject_sd: float):
        """(language index or -1, score, rejected) of each text."""
        ce, n, letters = self.cross_entropy(texts)
        best = ce.argmin(1)
        z = -ce / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        score = z.max(1) / z.sum(1)
        limit = self.mean[best] + reject_sd * self.sd[best] * np.sqrt(1 + 200 / np.maximum(n, 1))
        none = letters == 0
        rejected = none | (ce[np.arange(len(ce)), best] > limit)
        return np.where(none, -1, best), np.where(none, 0.0, score), rejected


def _has_letter(text: str) -> bool:
    return any(ch.isalpha() for ch in text)


def evenly(text: str, limit: int, pieces: int = 20) -> str:
    """A text, or pieces from all over it if it is longer than ``limit``."""
    if len(text) <= limit:
        return text
    size = max(1, limit // pieces)
    return "\n".join(text[at:at + size] for at in (k * (len(text) - size) // (pieces - 1) for k in range(pieces)))


def learn(labelled: DataFrame, order: int = 4, sample_docs: int = 400, sample_bytes: int = 1_500_000) -> Model | None:
    """Fit on a bounded sample of (doc_id, text, lang): about ``sample_docs``
    rows a language, picked by a hash of the id over all rows, and no more
    than ``sample_bytes`` (and the text that passes it) of each language, of
    one text a fifth of that, from all over it. Every fifth text is held back
    for calibration."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, n // sample_docs))])
    rows = (labelled.where(F.pmod(F.xxhash64("doc_id"), share[F.col("lang")]) == 0)
            .limit(2 * sample_docs * len(counts)).select("lang", "text"))
    fit, held, size, seen = {k: [] for k in counts}, {k: [] for k in counts}, dict.fromkeys(counts, 0), dict.fromkeys(counts, 0)
    for r in rows.toLocalIterator():
        if size[r.lang] < sample_bytes:
            text = evenly(r.text, sample_bytes // 5)
            (held if seen[r.lang] % FOLDS == FOLDS - 1 else fit)[r.lang].append(text)
            size[r.lang] += len(text)
            seen[r.lang] += 1
    fit = {k: v for k, v in fit.items() if any(_has_letter(t) for t in v)}
    if not fit:
        return None
    model = Model(fit, order)
    model.calibrate({k: [t for t in v if t] for k, v in held.items() if k in fit and any(v)}, fit)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = (), reject_sd: float = 16.0) -> DataFrame:
    """(id, *keep, lang_pred, score, rejected), a row per row of ``docs``."""
    spark = docs.sparkSession
    C.ship_package(spark)
    cols = list(dict.fromkeys((id_col, *keep)))
    src, text = C.with_text(docs, text_col, cols)
    added = [("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]
    shared = spark.sparkContext.broadcast(model)

    def predict(batches):
        model = shared.value
        for b in batches:
            for part, texts in C.text_blocks(b, text, 1 << 18):
                if model is None:
                    best, score, rejected = np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), bool)
                else:
                    best, score, rejected = model.predict([t.decode("utf-8", "replace") for t in texts], reject_sd)
                names = [UND if j < 0 else model.langs[j] for j in best.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in cols), *(pa.array(v, t) for v, (_, t) in
                                                        zip((names, score, rejected), added))],
                    names=cols + [n for n, _ in added])
        C.give_back()

    schema = src.select(*cols).schema
    for n, t in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(n, t)
    return src.mapInArrow(predict, schema)


def training_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lang) that may teach: a lang, and fold of 4 not 2."""
    return (documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (C.id_fold("doc_id", 4) != 2))
            .select("doc_id", "text", "lang"))


def op10_kneser_ney_langid(spark, sf_dir: str) -> DataFrame:
    """Predict the language of all documents."""
    documents = C.table(spark, sf_dir, "documents")
    return (identify(documents, learn(training_rows(documents)))
            .select("doc_id", (C.id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected"))
