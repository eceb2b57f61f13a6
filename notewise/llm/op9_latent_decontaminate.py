"""Benchmark decontamination by latent semantic retrieval.

Passages are blocks of ``BLOCK`` words. Their TF-IDF vectors, over the words
that the benchmark uses and that tell items apart, span a latent space found by a randomised SVD: each
task multiplies its passages into a random sketch of the Gram matrix, Spark
adds the sketches up, and the driver factors one (features x rank) matrix
(Nystroem). For each ``own_rank`` passages of the benchmark there is one such
space, with all of them added to its basis: each lies in it whole, however
many items there are, and none vanishes behind frequent words.

Every window of two neighbouring blocks, of every text, is compared with all
passages: near are those by cosine, and those of which the window holds most
(of a short passage ``HELD``, by squared weight; of one longer than a block
half). A copy of a passage of up to ``BLOCK + 1`` words lies whole in some
window, and one of two windows holds half of a longer one, so verbatim items
always are candidates. A candidate is then read word by word: the
longest common subsequence of the item and the part of the text it lines up
with, as a share of the item's words. From ``sure`` on it is a leak; from
``maybe`` on it is one if the item's answer (its last line or sentence) is
there too, which catches paraphrases.

The benchmark is the query set: it is read in blocks of ``items_at_once``
passages, each against all rows.

Edge cases: null or empty texts hold nothing; an item without a word matches
nothing; repeated rows and repeated items are reported each; an empty
benchmark or empty table gives no hits; other columns pass by.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructType

from . import common as C

BLOCK = 32
FEATURES = 1 << 15
HELD = 0.7
#: text that a task compares with the passages at once: each of its pairs of
#: block and feature takes a row of a space's basis
SCAN_BYTES = 1 << 18
_FOLD = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
HIT = (StructType().add("item_id", LongType()).add("cosine", DoubleType()).add("lcs_share", DoubleType())
       .add("answer_found", BooleanType()).add("at_word", LongType()))


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, cut at white space and ASCII signs."""
    t = text.translate(_FOLD)
    return (t if t.isascii() else t.decode("utf-8", "replace").lower().encode()).split()


def lcs_length(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Longest common subsequence of a pattern, given as a bit mask for each
    of its words, and a list of words: one addition a word."""
    full = (1 << size) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def passage_starts(n: int) -> range:
    """Where the passages, of two blocks, of an item of n words begin."""
    return range(0, max(1, n - BLOCK), BLOCK)


class Items:
    """A block of benchmark items, cut into passages."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.masks, self.answers, self.where = [], [], [], [], []
        for item_id, text in rows:
            w = words_of((text or "").encode())
            if not w:
                continue
            last = [words_of(s.encode()) for s in _SENTENCE.split(text)]
            answer = [s for s in last if s][-1]
            self.ids.append(item_id)
            self.words.append(w)
            self.masks.append(masks_of(w))
            self.answers.append((len(answer), masks_of(answer)))
            places: dict[bytes, list[int]] = {}
            for i, x in enumerate(w):
                places.setdefault(x, []).append(i)
            self.where.append(places)
        self.passages = [(i, w[at:at + 2 * BLOCK]) for i, w in enumerate(self.words)
                         for at in passage_starts(len(w))]
        # words of many items tell none of them, but items made of such words
        seen = Counter(w for ws in self.words for w in set(ws))
        self.feature: dict[bytes, int] = {}
        for ws in self.words:
            telling = [w for w in ws if seen[w] <= max(5, len(self.words) / 10)]
            for w in telling if len(set(telling)) >= 3 else ws:
                self.feature[w] = zlib.crc32(w) % FEATURES

    def features_of(self, words: list[bytes]) -> np.ndarray:
        return np.unique(np.array([self.feature[w] for w in words if w in self.feature], dtype=np.int64))


def block_features(texts: list[bytes], feature: dict[bytes, int]):
    """(words of each text, first block of each, block and feature of each
    distinct pair, by block). Blocks are numbered through; a free number
    between two texts keeps them apart."""
    words, first, at, ids, base = [], [], [], [], 0
    for t in texts:
        w = words_of(t)
        f = np.fromiter(map(feature.get, w, repeat(-1)), dtype=np.int64, count=len(w))
        hit = np.flatnonzero(f >= 0)
        words.append(w)
        first.append(base)
        at.append(hit // BLOCK + base)
        ids.append(f[hit])
        base += len(w) // BLOCK + 2
    pairs = np.unique(np.concatenate(at) * FEATURES + np.concatenate(ids)) if texts else np.zeros(0, np.int64)
    return words, np.array(first), pairs // FEATURES, pairs % FEATURES


def feature_table(texts: DataFrame, feature: dict[bytes, int]) -> DataFrame:
    """(blocks, features, passages) of runs of texts, written to the shared
    folder: texts are folded and looked up once for all that is counted over
    passages. The first two are the numbers of ``block_features`` as bytes."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(feature)

    def run(batches):
        for batch in batches:
            for _, part in C.text_blocks(batch, "_text", 1 << 20):
                words, _, b, f = block_features(part, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.astype("<i4").tobytes()], pa.binary()), pa.array([f.astype("<u2").tobytes()], pa.binary()),
                     pa.array([sum(-(-len(w) // BLOCK) for w in words)], pa.int64())],
                    names=["blocks", "features", "passages"])
        C.give_back()

    with C.small_batches(spark):
        return C.cut_lineage(texts.mapInArrow(run, "blocks binary, features binary, passages bigint"), spark, "passage-features")


def _runs(batches):
    """The runs of a feature table one by one, read where they lie in their batch."""
    for batch in batches:
        for blocks, features, passages in zip(*(batch.column(n) for n in ("blocks", "features", "passages"))):
            yield (np.frombuffer(blocks.as_buffer(), "<i4").astype(np.int64),
                   np.frombuffer(features.as_buffer(), "<u2").astype(np.int64), passages.as_py())


def document_frequency(table: DataFrame) -> tuple[np.ndarray, int]:
    """(passages that hold each feature, passages), over all texts."""
    schema = pa.schema([("f", pa.int32()), ("n", pa.int64())])

    def run(batches):
        df = np.zeros(FEATURES + 1, np.int64)
        for _, f, passages in _runs(batches):
            df[:FEATURES] += np.bincount(f, minlength=FEATURES)
            df[FEATURES] += passages
        at = np.flatnonzero(df)
        yield C.record(schema, at.astype(np.int32), df[at])
        C.give_back()

    out = np.zeros(FEATURES + 1, np.int64)
    with C.small_batches(table.sparkSession):
        rows = table.mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()
    for r in rows:
        out[r.f] = r.n
    return out[:FEATURES], int(out[FEATURES])


def passage_cuts(b: np.ndarray, limit: int) -> list[int]:
    """Where to cut pairs in the order of their blocks into pieces of about
    ``limit``, from 0 to the end; no block is cut."""
    cuts = [0]
    while cuts[-1] < len(b):
        last = b[min(cuts[-1] + limit, len(b)) - 1]
        cuts.append(int(np.searchsorted(b, last, side="right")))
    return cuts


def sketch(table: DataFrame, weight: np.ndarray, rank: int, seed: int, pairs_at_once: int = 1 << 13):
    """(G @ R, R) with G the Gram matrix of all normalised TF-IDF passages
    and R a random (features x rank) matrix that every task draws alike. A
    task multiplies about ``pairs_at_once`` pairs of passage and feature at a
    time."""
    shared = table.sparkSession.sparkContext.broadcast(weight)
    names = [f"c{i}" for i in range(rank)]
    schema = pa.schema([("f", pa.int32())] + [(n, pa.float64()) for n in names])

    def random():
        return np.random.default_rng(seed).normal(size=(FEATURES, rank)).astype(np.float32)

    def add(total, omega, weight, b, f):
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        sizes = np.diff(np.append(starts, len(b)))
        v = weight[f]
        v = (v / np.repeat(np.sqrt(np.add.reduceat(v * v, starts)), sizes)).astype(np.float32)[:, None]
        y = np.repeat(np.add.reduceat(omega[f] * v, starts, axis=0), sizes, axis=0) * v
        order = np.argsort(f, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(f[order]) > 0]))
        total[f[order][at]] += np.add.reduceat(y[order], at, axis=0)

    def run(batches):
        weight = shared.value
        omega, total = random(), np.zeros((FEATURES, rank))
        for b, f, _ in _runs(batches):
            telling = weight[f] > 0
            b, f = b[telling], f[telling]
            cuts = passage_cuts(b, pairs_at_once)
            for lo, hi in zip(cuts, cuts[1:]):
                add(total, omega, weight, b[lo:hi], f[lo:hi])
        at = np.flatnonzero(total.any(1))
        yield C.record(schema, at.astype(np.int32), *total[at].T)
        del omega, total
        C.give_back()

    with C.small_batches(table.sparkSession):
        rows = (table.mapInArrow(run, "f int, " + ", ".join(f"{n} double" for n in names))
                .groupBy("f").agg(*[F.sum(n).alias(n) for n in names]).toPandas())
    out = np.zeros((FEATURES, rank))
    out[rows["f"].to_numpy(int)] = rows[names].to_numpy()
    return out, random().astype(float)


def directions(used: np.ndarray, gram: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Latent directions of the texts, a row for every feature."""
    gram, omega = gram[used], omega[used]
    u, s, _ = np.linalg.svd(omega.T @ gram)                          # Nystroem: G ~ S (R'S)^-1 S'
    ok = s > (s[0] if len(s) else 0) * 1e-6
    basis = np.linalg.svd(gram @ (u[:, ok] / np.sqrt(s[ok])), full_matrices=False)[0] if ok.any() else gram[:, :0]
    out = np.zeros((FEATURES, basis.shape[1]))
    out[used] = basis
    return out


class Space:
    """Latent space over the features of some passages, and their places in
    it. The basis spans all of them, so products with them are exact."""

    def __init__(self, items: Items, passages: list[tuple[int, list[bytes]]], weight: np.ndarray, latent: np.ndarray):
        self.owners = [i for i, _ in passages]
        features = [items.features_of(p) for _, p in passages]
        used = np.unique(np.concatenate(features))
        used = used[weight[used] > 0]
        self.row = np.full(FEATURES, -1, np.int32)
        self.row[used] = np.arange(len(used))
        self.weight = weight
        rows = [self.vector_parts(f) for f in features]
        own = np.zeros((len(used), len(rows)))
        for k, (r, v) in enumerate(rows):
            own[r, k] = v
        self.basis = np.linalg.qr(np.concatenate([latent[used], own], axis=1))[0].astype(np.float32)
        self.places = np.stack([v @ self.basis[r] if len(r) else np.zeros(self.basis.shape[1]) for r, v in rows])
        lengths = np.array([np.sqrt((v.astype(float) ** 2).sum()) for _, v in rows])
        self.places = (self.places / np.maximum(lengths, 1e-9)[:, None]).astype(np.float32)
        share = np.array([HELD if len(p) <= BLOCK + 1 else 0.499 for _, p in passages])
        self.enough = np.where(lengths > 0, share * lengths, np.inf).astype(np.float32)
        # windows with fewer features than half of any passage takes are far from all
        halves = [np.cumsum(np.sort(v.astype(float) ** 2)[::-1]) for _, v in rows if len(v)]
        self.least = max(1, min((int(np.searchsorted(h, 0.499 * h[-1])) + 1 for h in halves), default=1))

    def vector_parts(self, features: np.ndarray):
        """(rows of the basis, weights) of a passage's distinct features."""
        f = features[self.row[features] >= 0]
        return self.row[f], self.weight[f].astype(np.float32)


def _read(item: int, items: Items, words: list[bytes], window: int) -> tuple[float, bool, int]:
    """LCS share and answer check of an item against the words it lines up
    with, around a window of a text's words."""
    n, lo, where = len(items.words[item]), window * BLOCK, items.where[item]
    met = [(lo + j, where[w]) for j, w in enumerate(words[lo:lo + 2 * BLOCK]) if w in where]
    # by words that occur once or twice in the item; by all where none of these is there
    shifts = np.sort(np.array([j - i for j, places in met if len(places) <= 2 for i in places]
                              or [j - i for j, places in met for i in places], dtype=np.int64))
    if not len(shifts):
        return 0.0, False, lo
    # half of the shifts lie around the true one; others are chance
    around = np.searchsorted(shifts, shifts + 3, side="right") - np.searchsorted(shifts, shifts - 3)
    start = int(shifts[around.argmax()])
    part = words[max(0, start - n // 4 - 2):max(0, start + n + n // 4 + 2)]
    share = lcs_length(items.masks[item], n, part) / n
    size, masks = items.answers[item]
    return share, share > 0 and lcs_length(masks, size, part) >= 0.8 * size, max(0, start)


def near_passages(space: Space, blocks: np.ndarray, squares: np.ndarray, b: np.ndarray, f: np.ndarray,
                  cosine: float):
    """(first block, passage, cosine) of each window near a passage of a
    space; ``squares``: squared length of each of ``blocks``."""
    mine = space.row[f] >= 0
    b, f = b[mine], f[mine]
    if not len(b):
        return
    # a window is a block and the next one; each block is projected once
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    names, sizes = b[at], np.diff(np.append(at, len(b)))
    two = np.append(names[1:] == names[:-1] + 1, False)
    after = np.minimum(np.arange(len(names)) + 1, len(names) - 1)
    wanted = sizes + two * sizes[after] >= space.least
    used = wanted.copy()
    used[after[wanted & two]] = True
    if not wanted.any():
        return
    pairs = np.repeat(used, sizes)
    r, v = space.vector_parts(f[pairs])
    starts = np.cumsum(sizes[used]) - sizes[used]
    z = np.add.reduceat(space.basis[r] * v[:, None], starts, axis=0)
    norm = squares[np.searchsorted(blocks, names[used])]
    place = np.cumsum(used) - 1
    own, two, after = place[wanted], two[wanted], place[after[wanted]]
    names = names[wanted]
    held = (z[own] + two[:, None] * z[after]) @ space.places.T
    near = held / np.sqrt(norm[own] + two * norm[after])[:, None]
    for k, p in zip(*np.nonzero((near >= cosine) | (held >= space.enough))):
        yield int(names[k]), p, float(near[k, p])


def find_hits(texts: list[bytes], items: Items, spaces: list[Space], feature: dict[bytes, int], cosine: float,
              sure: float, maybe: float) -> list[list[dict]]:
    """Hits of each text: windows near an item in the latent space, then
    checked word by word; the best window for each item."""
    words, base, b, f = block_features(texts, feature)
    out: list[list[dict]] = [[] for _ in texts]
    if not len(b):
        return out
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    squares = np.add.reduceat(spaces[0].weight[f].astype(np.float32) ** 2, at)
    best: dict = {}
    seen: dict = {}
    for space in spaces:
        for name, p, near in near_passages(space, b[at], squares, b, f, cosine):
            item, text = space.owners[p], int(np.searchsorted(base, name, side="right")) - 1
            if (name, item) not in seen:
                seen[name, item] = _read(item, items, words[text], int(name - base[text]))
            share, answer, start = seen[name, item]
            if share >= sure or (share >= maybe and answer):
                key = (text, item)
                if key not in best or share > best[key]["lcs_share"]:
                    best[key] = {"item_id": items.ids[item], "cosine": min(1.0, near), "lcs_share": share,
                                 "answer_found": bool(answer), "at_word": int(start)}
    for (text, item), hit in sorted(best.items()):
        out[text].append(hit)
    return out


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = (), rank: int = 32, own_rank: int = 224, common: float = 0.02,
           cosine: float = 0.3, sure: float = 0.75, maybe: float = 0.5, items_at_once: int = 2000,
           seed: int = 3) -> DataFrame:
    """(id, *keep, hits), a row per row of ``docs``; ``hits`` lists
    (item_id, cosine, lcs_share, answer_found, at_word). Words in more than
    ``common`` of all passages have no weight. ``benchmark`` is (item_id,
    text)."""
    spark = docs.sparkSession
    C.ship_package(spark)
    cols = list(dict.fromkeys((id_col, *keep)))
    texts = docs.select(F.col(text_col).alias("_text"))
    models = []
    rows = benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    for part in C.by_bytes(((r.item_id, r.text) for r in rows),
                           lambda r: len(passage_starts(len(words_of((r[1] or "").encode())))), items_at_once):
        items = Items(part)
        if not items.ids:
            continue
        table = feature_table(texts, items.feature)
        df, n = document_frequency(table)
        # frequent words weigh nothing, but for items that have few others
        weight = np.log((n + 1) / (df + 1.0))
        weight[df > max(5, common * n)] = 0
        for w in items.words:
            f = items.features_of(w)
            if (weight[f] > 0).sum() < 3:
                weight[f] = np.maximum(weight[f], 0.1)
        gram, omega = sketch(table, weight, rank, seed)
        used = np.unique(np.fromiter(items.feature.values(), int))
        latent = directions(used[weight[used] > 0], gram, omega)
        spaces = [Space(items, items.passages[at:at + own_rank], weight, latent)
                  for at in range(0, len(items.passages), own_rank)]
        models.append((items, {w: f for w, f in items.feature.items() if weight[f] > 0}, spaces))
    shared = spark.sparkContext.broadcast(models)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()),
                               ("answer_found", pa.bool_()), ("at_word", pa.int64())]))

    def run(batches):
        for b in batches:
            for part, some in C.text_blocks(b, text, SCAN_BYTES):
                found = [find_hits(some, items, spaces, feature, cosine, sure, maybe)
                         for items, feature, spaces in shared.value]
                hits = [sum(x, []) for x in zip(*found)] if found else [[] for _ in some]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in cols), pa.array(hits, kind)],
                                                 names=[*cols, "hits"])
        C.give_back()

    src, text = C.with_text(docs, text_col, cols)
    return src.mapInArrow(run, src.select(*cols).schema.add("hits", ArrayType(HIT)))


def op9_latent_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All leaks of benchmark items into documents, a row for each document
    and item."""
    found = search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("hits"))
