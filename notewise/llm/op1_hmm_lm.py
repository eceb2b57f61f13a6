"""LM scoring by a hidden Markov language model.

States emit word *classes*: each training word with a count above
sqrt(N) / ``own_share`` is a class of its own (fewer than ``own_share`` x
sqrt(N) words: they grow with the corpus), every other word falls into a hashed
class. Inside a hashed class a word has the add-one probability
``(c + 1) / (N_b + V_b + 1)``, so the model gives every text, unseen words
included, a proper probability:

    P(text) = forward(classes of the text) * product of P(word | its class).

1. Word counts of all training texts (per-task counters, then one sum per
   word). The vocabulary stays a distributed table: it grows with the corpus.
2. Baum-Welch, over whole texts, from seeded noise. The training texts are
   written once as class ids, dealt by hash into ``parts``; a round runs scaled
   forward-backward over one part, every task emits expected counts by class
   and Spark adds them up. A round's model comes from the counts of the latest
   half of the rounds, so after ``passes`` = 2 passes the final one rests on
   each training text exactly once. What reaches the driver is the model:
   classes x states numbers a round. A text longer than ``block_words`` is
   taken in blocks, with the exact state vectors at their boundaries.
3. Scoring: the scaled forward recursion over each whole text, exact. Words
   with a count above N / ``wide`` (fewer than ``wide`` of them, always) are
   broadcast; the others are joined to the vocabulary table.

Edge cases: a null or empty text is the end token alone; repeated rows are
scored each; a null id counts as '' for the fold; with no training text all
counts are 0 and the model is uniform; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

END = b"\n"            # the end token; no word holds white space
LOG10 = np.log(10.0)

WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _count_words(batches, flush: int = 300_000):
    seen: Counter = Counter()
    for (text,) in C.rows_of(batches, "text"):
        seen.update(text.lower().split())
        seen[END] += 1
        if len(seen) >= flush:
            yield C.record(WORDS, list(seen), list(seen.values()))
            seen.clear()
    yield C.record(WORDS, list(seen), list(seen.values()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end token among them."""
    return (docs.select("text").mapInArrow(_count_words, "word binary, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


class Classes:
    """Word -> class: own classes first, then hashed ones."""

    def __init__(self, own: list[bytes], buckets: int):
        self.own = {w: i for i, w in enumerate(own)}
        self.n_own, self.buckets = len(own), buckets
        self.dtype = np.dtype(np.uint16 if len(self) <= 1 << 16 else np.int32)

    def __len__(self):
        return self.n_own + self.buckets

    def class_of(self, word: bytes) -> int:
        own = self.own.get(word)
        return self.n_own + zlib.crc32(word) % self.buckets if own is None else own

    def memo(self) -> C.Memo:
        return C.Memo(self.class_of)


class KnownWords:
    """Class, and log10(count + 1) or -1 if it has no count here, of each
    word of a list. Words are numbered as they come, and all forgotten when
    there are ``bound`` of them; rows of a table hold what belongs to each."""

    def __init__(self, classes: Classes, freq: dict[bytes, int], bound: int = 400_000):
        self.classes, self.freq, self.bound = classes, freq, bound
        self.to_class = classes.class_of
        self.ids, self.logs = np.zeros(bound, np.int32), np.zeros(bound)
        self.number = self._Numbers(self)

    class _Numbers(dict):
        def __init__(self, of):
            super().__init__()
            self.of = of

        def __missing__(self, word):
            at = len(self)
            if at == len(self.of.ids):                      # more distinct words than planned in one list
                self.of.ids = np.append(self.of.ids, np.zeros_like(self.of.ids))
                self.of.logs = np.append(self.of.logs, np.zeros_like(self.of.logs))
            n = self.of.freq.get(word)
            self.of.ids[at] = self.of.to_class(word)
            self.of.logs[at] = -1.0 if n is None else np.log10(n + 1)
            self[word] = at
            return at

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) >= self.bound:
            self.number.clear()
        at = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        return self.ids[at], self.logs[at]


class Model:
    """Start, transition and emission probabilities of the classes."""

    def __init__(self, start, trans, emit):
        self.start, self.trans, self.emit = start, trans, emit     # (K,), (K,K), (M,K)

    @classmethod
    def from_counts(cls, start, trans, emit, unigram):
        """Smoothed by a little of the class unigram, so that no class has
        probability 0 in any state."""
        emit = emit + 0.5 * unigram[:, None] / unigram.sum() * 100
        trans = trans + 0.1
        start = start + 0.1
        return cls(start / start.sum(), trans / trans.sum(1, keepdims=True), emit / emit.sum(0))


def _layout(seqs: list[np.ndarray]):
    """Sequences by length, longest first, and their classes step by step:
    (order, classes, start of each step, sequences at each step)."""
    lens = np.array([len(s) for s in seqs])
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    flat = np.concatenate([seqs[i] for i in order])
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    active = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0]), side="right")
    begin = np.cumsum(active) - active
    by_step = np.empty_like(flat)
    by_step[begin[step] + np.repeat(np.arange(len(lens)), lens)] = flat      # the active ones are a prefix
    return order, by_step, begin, active


def _forward(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural-log likelihood of each whole sequence, by scaled forward
    steps over all sequences at once (the active ones are a prefix)."""
    order, obs, begin, active = _layout(seqs)
    out = np.zeros(len(order))
    ones = np.ones(len(model.start))
    a = model.start[None]
    for t, (at, m) in enumerate(zip(begin, active)):
        e = model.emit.take(obs[at:at + m], axis=0)
        e *= a if t == 0 else a[:m] @ model.trans
        s = e @ ones
        a = np.divide(e, s[:, None], out=e)
        out[:m] += np.log(s)
    back = np.empty_like(out)
    back[order] = out
    return back


def _expected(model: Model, seqs: list[np.ndarray], acc: dict, enter=None, leave=None) -> np.ndarray:
    """Add the expected start, transition and emission counts of the
    sequences to ``acc`` (scaled forward-backward). A sequence that goes on
    from an earlier block has ``enter``, its first states' distribution before
    the first emission; one that a later block continues has ``leave``, the
    backward vector of its last step. Returns the scaled emissions times the
    backward vectors of the first steps."""
    _, obs, begin, active = _layout(seqs)
    k = len(model.start)
    start = (model.start if enter is None else enter).astype(np.float32)
    trans = model.trans.astype(np.float32)
    emit = model.emit.astype(np.float32).take(obs, axis=0)       # becomes emit / scale
    alpha = np.empty_like(emit)
    ones = np.ones(k, np.float32)
    a = start[None]
    for t, (at, m) in enumerate(zip(begin, active)):
        e = emit[at:at + m]
        a = np.multiply(e, a if t == 0 else a[:m] @ trans, out=alpha[at:at + m])
        s = (1 / (a @ ones))[:, None]
        a *= s
        e *= s
    back = trans.T.copy()
    xi = np.zeros((k, k))
    beta = np.ones((active[-1], k), np.float32)
    if leave is not None:
        beta *= leave.astype(np.float32)
    for t in range(len(active) - 1, 0, -1):
        at, m, before = begin[t], active[t], begin[t - 1]
        ahead = emit[at:at + m]
        ahead *= beta
        alpha[at:at + m] *= beta                                 # now the posterior
        xi += alpha[before:before + m].T @ ahead
        beta = np.ones((active[t - 1], k), np.float32)
        np.matmul(ahead, back, out=beta[:m])
    alpha[:active[0]] *= beta
    acc["trans"] += xi * model.trans
    if enter is None:
        acc["start"] += alpha[:active[0]].sum(0)
    for j in range(k):
        acc["emit"][:, j] += np.bincount(obs, weights=alpha[:, j], minlength=len(acc["emit"]))
    return emit[:active[0]] * beta


def _expected_in_blocks(model: Model, seq: np.ndarray, acc: dict, block_words: int) -> None:
    """``_expected`` of one long sequence in memory for one block: a forward
    sweep keeps the states at block ends, a backward sweep visits the blocks
    with the exact vectors at both ends."""
    blocks = [seq[i:i + block_words] for i in range(0, len(seq), block_words)]
    ends, before = [], model.start
    for block in blocks:
        for o in block:
            a = before * model.emit[o]
            a /= a.sum()
            before = a @ model.trans
        ends.append(a)
    leave = None
    for i in range(len(blocks) - 1, -1, -1):
        enter = ends[i - 1] @ model.trans if i else None
        ahead = _expected(model, [blocks[i]], acc, enter, leave)[0]
        if i:
            acc["trans"] += np.outer(ends[i - 1], ahead) * model.trans
            leave = model.trans @ ahead


def _empty(classes: int, k: int) -> dict:
    return {"emit": np.zeros((classes, k)), "trans": np.zeros((k, k)), "start": np.zeros(k)}


def _expected_of_all(model: Model, seqs, acc: dict, block_words: int, ahead_words: int) -> None:
    """``_expected`` of a stream of sequences, whole: those of like length
    step together."""
    for some in C.by_bytes(seqs, len, ahead_words):
        some.sort(key=len)
        for group in C.by_bytes(some, len, block_words):
            if len(group[0]) > block_words:
                _expected_in_blocks(model, group[0], acc, block_words)
            else:
                _expected(model, group, acc)


def class_ids(train: DataFrame, classes_b, parts: int) -> DataFrame:
    """(part, ids): every training text as class ids, dealt into parts by hash."""
    schema = pa.schema([("part", pa.int32()), ("ids", pa.binary())])

    def encode(batches):
        classes = classes_b.value
        to_class = classes.memo()
        for rows in C.by_bytes(C.rows_of(batches, "part", "text"), lambda r: len(r[1]), 4 << 20):
            out = []
            for _, text in rows:
                w = text.lower().split()
                w.append(END)
                out.append(np.fromiter(map(to_class.__getitem__, w), dtype=classes.dtype, count=len(w)).tobytes())
            yield C.record(schema, [p for p, _ in rows], out)
        C.give_back()

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    return train.select(part.alias("part"), "text").mapInArrow(encode, "part int, ids binary")


def baum_welch_round(encoded: DataFrame, model_b, classes_b, k: int, block_words: int, ahead_words: int) -> dict:
    """One round: expected counts of all tasks, added up by Spark."""
    names = [f"s{j}" for j in range(k)]
    schema = pa.schema([("row", pa.int32())] + [(n, pa.float64()) for n in names])

    def counts(batches):
        model, classes = model_b.value, classes_b.value
        acc = _empty(len(classes), k)
        seqs = (np.frombuffer(ids, classes.dtype) for (ids,) in C.rows_of(batches, "ids"))
        _expected_of_all(model, seqs, acc, block_words, ahead_words)
        # rows 0..: classes, then the transition rows, then the start
        every = np.concatenate([acc["emit"], acc["trans"], acc["start"][None]])
        keep = np.flatnonzero(every.sum(1))
        yield C.record(schema, keep.astype(np.int32), *every[keep].T)
        C.give_back()

    total = (encoded.select("ids")
             .mapInArrow(counts, "row int, " + ", ".join(f"{n} double" for n in names))
             .groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas())
    m = len(classes_b.value)
    every = np.zeros((m + k + 1, k))
    every[total["row"].to_numpy(int)] = total[names].to_numpy()
    return {"emit": every[:m], "trans": every[m:m + k], "start": every[m + k]}


def start_model(classes: Classes, unigram, k: int, seed: int) -> Model:
    """Starting point: the corpus's class counts under seeded noise."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.uniform(0.5, 1.5, (len(classes), k))
    trans = np.full((k, k), 0.05 / max(1, k - 1))
    np.fill_diagonal(trans, 0.95)
    return Model.from_counts(np.ones(k), trans * 1000, emit, unigram)


def train_model(train: DataFrame, classes_b, unigram, k: int, parts: int, passes: int, block_words: int,
                ahead_words: int, seed: int) -> Model:
    """Baum-Welch rounds over the parts in turn, ``passes`` times; a round's
    model comes from the latest half of the rounds' counts."""
    spark = train.sparkSession
    path = C.shared_path(spark, "lm-classes")
    class_ids(train, classes_b, parts).write.partitionBy("part").parquet(path)
    encoded = spark.read.schema("ids binary, part int").parquet(path)
    model, latest = start_model(classes_b.value, unigram, k, seed), []
    for r in range(passes * parts):
        model_b = spark.sparkContext.broadcast(model)
        latest.append(baum_welch_round(encoded.where(F.col("part") == r % parts), model_b, classes_b, k,
                                       block_words, ahead_words))
        model_b.unpersist()
        latest = latest[-max(1, min(parts, len(latest) // 2)):]
        model = Model.from_counts(*(sum(c[n] for c in latest) for n in ("start", "trans", "emit")), unigram)
    return model


def score(docs: DataFrame, train: DataFrame, states: int = 8, own_share: int = 32, buckets: int = 1024,
          parts: int = 8, passes: int = 2, block_words: int = 1 << 20, ahead_words: int = 4 << 20,
          wide: int = 1 << 20, seed: int = 7) -> DataFrame:
    """Score ``docs`` (doc_id, text bytes) by a model learnt from ``train``.

    (doc_id, n_tokens, n_known, train_tokens, base_score, score), a row per
    row of ``docs``; scores are log10 probabilities. There are ``buckets``
    hashed classes, or a quarter of the own classes if that is more.
    """
    spark = docs.sparkSession
    C.ship_package(spark)
    vocab = C.cut_lineage(word_counts(train), spark, "lm-vocab")
    n_all, n_kinds = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    # fewer than `wide` words can have more than n_all / wide tokens each
    top = vocab.where(F.col("n") * wide > n_all).toArrow()
    freq = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))
    least = n_all ** 0.5 / own_share
    own_words = sorted((w for w, n in freq.items() if n > least), key=lambda w: (-freq[w], w))
    buckets = max(buckets, len(own_words) // 4)
    classes = Classes(own_words, buckets)
    own_table = spark.createDataFrame([(bytearray(w),) for w in own_words], "word binary")
    of_bucket = {r.b: (r.n, r.v) for r in
                 vocab.join(F.broadcast(own_table), "word", "left_anti")
                 .groupBy(F.pmod(F.crc32("word"), F.lit(buckets)).alias("b"))
                 .agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    bucket_n = np.array([of_bucket.get(b, (0, 0))[0] for b in range(buckets)], float)
    bucket_v = np.array([of_bucket.get(b, (0, 0))[1] for b in range(buckets)], float)
    unigram = np.concatenate([[freq[w] for w in own_words], bucket_n]) + 1.0

    sc = spark.sparkContext
    classes_b = sc.broadcast(classes)
    model = train_model(train, classes_b, unigram, states, parts, passes, block_words, ahead_words, seed)
    model_b = sc.broadcast(model)
    freq_b = sc.broadcast(freq)
    bucket_log = np.log10(bucket_n + bucket_v + 1)
    base_log = float(np.log10(n_all + n_kinds + 1))
    id_type = docs.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)

    def scan(batches):
        model, classes, freq = model_b.value, classes_b.value, freq_b.value
        known_words = KnownWords(classes, freq)
        for part in C.by_bytes(C.rows_of(batches, "doc_id", "text"), lambda r: len(r[1]), 12 << 20):
            seqs, rows, rare, rare_n, ends = [], [], [], [], [0]
            for doc_id, text in part:
                w = text.lower().split()
                w.append(END)
                ids, logs = known_words.look_up(w)
                there = logs >= 0
                known = int(np.count_nonzero(there))
                if known < len(w):
                    few = Counter(itertools.compress(w, ~there))
                    rare.extend(few)
                    rare_n.extend(few.values())
                    logs = np.where(there, logs, 0.0)
                hashed = ids >= classes.n_own
                inside = float(logs[hashed].sum()) - float(bucket_log[ids[hashed] - classes.n_own].sum())
                seqs.append(ids)
                ends.append(len(rare))
                rows.append((doc_id, len(w), known, float(logs.sum()) - len(w) * base_log, inside))
            doc_ids, n_tokens, known, base, inside = zip(*rows)
            words = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(rare_n, pa.int32())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, id_arrow), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(np.array(inside) + _forward(model, seqs) / LOG10),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)],
                names=["doc_id", "n_tokens", "n_known", "base", "hmm", "rare"])

    scanned = C.cut_lineage(
        docs.select("doc_id", "text").mapInArrow(
            scan, f"doc_id {id_type.simpleString()}, n_tokens bigint, n_known bigint, base double, hmm double, "
                  "rare array<struct<word:binary,n:int>>")
        .withColumn("row", F.monotonically_increasing_id()), spark, "lm-scan")
    seen = (scanned.select("row", F.inline("rare"))
            .join(vocab.where(F.col("n") * wide <= n_all).select("word", F.col("n").alias("c")), "word")
            .groupBy("row").agg(F.sum("n").alias("more_known"),
                                F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more")))
    more = F.coalesce("more", F.lit(0.0))
    return (scanned.drop("rare").join(seen, "row", "left")
            .select("doc_id", "n_tokens",
                    (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(int(n_all)).cast("bigint").alias("train_tokens"),
                    (F.col("base") + more).alias("base_score"), (F.col("hmm") + more).alias("score")))


def op1_hmm_lm(spark, sf_dir: str) -> DataFrame:
    """Score all documents; learn from those whose fold of 7 is not 2."""
    docs = C.id_and_bytes(C.table(spark, sf_dir, "documents"))
    held = C.id_fold("doc_id", 7) == 2
    return (score(docs, docs.where(~held))
            .select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                    "base_score", "score"))
