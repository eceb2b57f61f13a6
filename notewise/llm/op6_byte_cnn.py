"""Quality classifier: a byte-level convolutional network in numpy.

Texts are UTF-8 bytes. A text is cut into chunks of ``CHUNK`` bytes that
overlap by ``OVERLAP``, from its first byte to its last; each byte is
embedded, ``FILTERS`` learned filters of ``WIDTH`` bytes run over each chunk
every ``STRIDE`` bytes, and the largest response of each filter is the
chunk's feature. The mean and the maximum of the features over all chunks of
the text give one probability through a logistic unit.

The network is fitted by Adam on a bounded sample of labelled rows (the
bounds are parameters of ``learn``), and its logits are calibrated on rows
that a network of the other half did not see, so that a score is a probability
whatever the size of the sample; scoring runs over whole texts, a small
block of chunks at a time, so a text of any length needs the same memory.

Edge cases: a null or empty text is one chunk of padding and gets the score
that it gives; with no labelled row every score is 0.5; repeated rows are
scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CHUNK, OVERLAP, WIDTH, STRIDE, EMBED, FILTERS = 512, 64, 16, 4, 8, 24
STEP = CHUNK - OVERLAP
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(text: bytes) -> np.ndarray:
    """All chunks of a text, padded by 0 at its end: (n, CHUNK) bytes."""
    n = 1 if len(text) <= CHUNK else 1 + -(-(len(text) - CHUNK) // STEP)
    buf = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    buf[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = (rng.normal(size=(256, EMBED)) * 0.5).astype(np.float32)
        self.filters = (rng.normal(size=(WIDTH * EMBED, FILTERS)) / 4).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.normal(size=2 * FILTERS + 1) * 0.1).astype(np.float32)
        self.shift = np.zeros(2 * FILTERS, np.float32)
        self.scale = np.ones(2 * FILTERS, np.float32)

    def patches(self, block: np.ndarray) -> np.ndarray:
        """(n * POSITIONS, WIDTH * EMBED) embedded windows of chunks."""
        e = self.embed[block].reshape(len(block), CHUNK * EMBED)
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
        return w.reshape(-1, WIDTH * EMBED)

    def features(self, block: np.ndarray, where: bool = False):
        """Largest response of each filter in each chunk, and its position."""
        r = (self.patches(block) @ self.filters).reshape(len(block), POSITIONS, FILTERS)
        top = np.maximum(r.max(1) + self.bias, 0)
        return (top, r.argmax(1)) if where else top

    def pooled(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        """Mean and maximum over the chunks of each text."""
        total = np.zeros((len(texts), FILTERS))
        most = np.zeros((len(texts), FILTERS), np.float32)
        count = np.zeros(len(texts))
        held, owner, size = [], [], 0

        def flush():
            f = self.features(np.concatenate(held))
            o = np.concatenate(owner)
            first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            total[o[first]] += np.add.reduceat(f, first, axis=0)
            most[o[first]] = np.maximum(most[o[first]], np.maximum.reduceat(f, first, axis=0))
            count[o[first]] += np.diff(np.append(first, len(o)))

        for i, t in enumerate(texts):
            c = chunks(t)
            for at in range(0, len(c), block):
                part = c[at:at + block]
                held.append(part)
                owner.append(np.full(len(part), i))
                size += len(part)
                if size >= block:
                    flush()
                    held, owner, size = [], [], 0
        if held:
            flush()
        return np.concatenate([total / np.maximum(count, 1)[:, None], most], axis=1).astype(np.float32)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return ((pooled - self.shift) / self.scale) @ self.out[:-1] + self.out[-1]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.pooled(texts)), -30, 30).astype(np.float64)))


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(x) for x in params]
        self.v = [np.zeros_like(x) for x in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, m, v, g in zip(self.p, self.m, self.v, grads):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 4e-3,
        seed: int = 5) -> Network:
    """Adam over mini-batches of whole texts; the gradient of a maximum flows
    to the window that gave it. Classes weigh the same in the loss, and the
    share of each is put back into the bias at the end."""
    net, rng = Network(seed), np.random.default_rng(seed)
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        net.out[:] = 0
        net.out[-1] = 0 if not len(labels) else (6 if share else -6)
        return net
    first = net.pooled(texts[:400])
    net.shift[:], net.scale[:] = 0, first.std(0) + 0.5
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    opt = Adam([net.embed, net.filters, net.bias, net.out], rate)
    by_text = [chunks(t) for t in texts]
    for epoch in range(epochs):
        opt.rate = rate * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            block = np.concatenate([by_text[i] for i in pick])
            sizes = np.array([len(by_text[i]) for i in pick])
            starts = np.cumsum(sizes) - sizes
            top, pos = net.features(block, where=True)
            mean = np.add.reduceat(top, starts, axis=0) / sizes[:, None]
            most = np.maximum.reduceat(top, starts, axis=0)
            x = np.concatenate([mean, most], axis=1) / net.scale
            z = x @ net.out[:-1] + net.out[-1]
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g_out = np.append(err @ x, err.sum()).astype(np.float32) + 1e-4 * net.out
            gx = err[:, None] * (net.out[:-1] / net.scale)
            owner = np.repeat(np.arange(len(pick)), sizes)
            g_top = gx[owner, :FILTERS] / sizes[owner][:, None]
            g_top = g_top + np.where(top == most[owner], gx[owner, FILTERS:], 0)
            g_top = np.where(top > 0, g_top, 0).astype(np.float32)
            n, f = np.nonzero(g_top)
            g = g_top[n, f]
            spot = pos[n, f] * STRIDE
            windows = block[n[:, None], spot[:, None] + np.arange(WIDTH)]           # bytes that won
            patch = net.embed[windows].reshape(len(n), WIDTH * EMBED)
            g_filters = np.zeros_like(net.filters)
            for k in range(FILTERS):
                own = f == k
                g_filters[:, k] = g[own] @ patch[own]
            g_patch = (g[:, None] * net.filters.T[f]).reshape(-1, EMBED)
            flat = windows.reshape(-1)
            g_embed = np.stack([np.bincount(flat, weights=g_patch[:, d], minlength=256) for d in range(EMBED)], 1)
            opt.step([g_embed.astype(np.float32), g_filters, g_top.sum(0), g_out])
    net.out[-1] += np.log(share / (1 - share))
    return net


def calibration(logits: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """(slope, shift) of a logistic unit over logits of texts that their
    network was not fitted on; ``ridge`` draws the slope towards 1."""
    a, b = 1.0, 0.0
    for _ in range(30):             # Newton
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        h = p * (1 - p)
        step = np.linalg.solve([[(h * logits ** 2).sum() + ridge, (h * logits).sum()], [(h * logits).sum(), h.sum() + 1e-6]],
                               [((p - labels) * logits).sum() + ridge * (a - 1), (p - labels).sum()])
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.1)), float(b)


def fit_calibrated(texts: list[bytes], labels: np.ndarray, epochs: int, folds: int = 2, seed: int = 5) -> Network:
    """A network fitted on all rows, its logits calibrated on those that each
    fold's rows get from a network fitted on the others."""
    net = fit(texts, labels, epochs, seed=seed)
    fold = np.zeros(len(labels), int)
    for kind in (0, 1):
        own = np.flatnonzero(labels == kind)
        if len(own) < 2 * folds:
            return net
        fold[own] = np.arange(len(own)) % folds
    logits = np.zeros(len(labels))
    for k in range(folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        other = fit([texts[i] for i in rest], labels[rest], epochs, seed=seed)
        logits[own] = other.logit(other.pooled([texts[i] for i in own]))
    slope, shift = calibration(logits, labels)
    net.out[:-1] *= slope
    net.out[-1] = net.out[-1] * slope + shift
    return net


def learn(documents: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_bytes: int = 12_000_000,
          epochs: int | None = None) -> Network:
    """Fit on texts of ``documents`` (doc_id, text) by ``labels`` (doc_id,
    label): about ``sample_docs`` labels, up to half of each kind, picked by
    a hash of the id over all of them, and no more than ``sample_bytes``
    (and the text that passes it) of each. The picked ids, at most twice
    ``sample_docs``, are broadcast; no text is shuffled. ``epochs``: by
    default 12, and up to 30 where the sample is small."""
    counts = {int(r.label): r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], np.zeros(0))
    half = max(1, sample_docs // 2)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, -(-n // half)))])
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), share[F.col("label")]) == 0).limit(2 * sample_docs)
    rows = (documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
            .join(F.broadcast(picked), "doc_id").select("label", "text"))
    texts, kinds, size = [], [], dict.fromkeys(counts, 0)
    for r in rows.toLocalIterator():
        if size[r.label] < sample_bytes // 2:
            texts.append(bytes(r.text))
            kinds.append(int(r.label))
            size[r.label] += len(r.text)
    net = fit_calibrated(texts, np.array(kinds, np.float32), epochs or int(np.clip(10_000 // max(1, len(texts)), 12, 30)))
    # back from the sample's shares to those of all labelled rows
    drawn = {k: kinds.count(k) for k in counts}
    if len(counts) == 2 and all(drawn.values()):
        net.out[-1] += np.log(counts[1] / counts[0]) - np.log(drawn[1] / drawn[0])
    return net


def classify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score), a row per row of ``docs``."""
    spark = docs.sparkSession
    C.ship_package(spark)
    cols = list(dict.fromkeys((id_col, *keep)))
    src, text = C.with_text(docs, text_col, cols)
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for b in batches:
            for part, texts in C.text_blocks(b, text):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in cols), pa.array(net.score(texts), pa.float64())],
                                                 names=[*cols, "score"])
        C.give_back()

    return src.mapInArrow(run, src.select(*cols).schema.add("score", "double"))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) that may teach: a quality mark, and fold of 5 not 0."""
    return (labels.where(F.col("quality").isin(0, 1) & (C.id_fold("doc_id", 5) != 0))
            .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")))


def op6_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """Score all documents for quality."""
    documents = C.table(spark, sf_dir, "documents")
    net = learn(documents, training_labels(C.table(spark, sf_dir, "labels")))
    return (classify(documents, net)
            .select("doc_id", (C.id_fold("doc_id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))
