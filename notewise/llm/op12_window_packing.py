"""Packing token streams into training sequences, order kept.

Each task reads its documents in the order of the table and encodes them into
one stream of token ids, every document closed by an end id. Sequences are
windows of that stream, so no document moves and nothing is shuffled. A
dynamic programme chooses where windows end, among document ends, sentence
ends and, where neither comes often enough, places inside a sentence:

    cost(j) = penalty(j) + min over i of cost(i) + padding(j - i)

A window is padded to ``width`` tokens, but not if its length is a power of two;
each window costs a little of its own, so that short ones don't spread. For padded windows the minimum is that of cost(i) + i over the last ``width``
tokens, which a monotone queue holds; the powers of two are a few further
look-ups. Ending a window inside a document costs a truncation penalty
in tokens, more inside a sentence than at its end.

A task holds about ``hold`` tokens at once: it fixes all but the last windows
of the best way so far, emits their pieces and goes on from there. The last
window of a task is cut into powers of two where that is cheaper than padding.

The ids are those of the tokenizer file. They come from the same merges run by
a second public implementation, several times faster; the tests hold the two
equal. A text that spells a special token goes through the tokenizer itself,
which reads it as that token.

Edge cases: null or empty text is the end id alone; repeated rows and null ids
are documents of their own; an endless word is encoded as a whole and cut where
a window needs it; very long texts are encoded and packed in blocks; an empty
table gives no rows; other columns are ignored. A sequence belongs to one task, so
ids of sequences follow from how the table is split, as do the last windows.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "byte_bpe_50k.json"
#: penalties in tokens: a window more, one that ends at a sentence's end, one that ends elsewhere in a document
WINDOW, SENTENCE, INSIDE = 64, 2, 12
#: places inside a sentence are offered where no better one comes for so many tokens
GAP = 16
#: what the vocabulary's authors cut text at before merging bytes; a fixed value
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: a blank between two other characters: the pattern always cuts before it
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
ENDING, CLOSING = (b".", b"!", b"?", "。".encode(), "！".encode(), "？".encode()), b"\"')]"

SCHEMA = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def token_bytes(vocab: dict) -> dict:
    """Bytes of each token -> its id. The file writes every byte as one
    character: itself if it prints, else the next free one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """Token ids of texts and the places where sentences end."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer
        if "/" not in vocabulary:
            import public_tokenizers
            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = token_bytes({t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
                             if t not in self.special})
        self.fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        most = max(self.tokenizer.get_vocab().values()) + 1
        self.ends, self.line, self.blank = (np.zeros(most, bool) for _ in range(3))
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(CLOSING).endswith(ENDING)
            self.line[i] = token.endswith(b"\n")
            self.blank[i] = token[:1].isspace()

    def parts(self, text: str, chars: int = 1 << 20):
        """(ids, places after which a sentence ends) of a text, in blocks of
        about ``chars`` characters."""
        at = 0
        while at < len(text):
            if any(s in text for s in self.special):
                end, ids = len(text), self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                cut = SAFE_CUT.search(text, at + chars) if at + chars < len(text) else None
                end = cut.start() if cut else len(text)
                ids = self.fast.encode_ordinary(text[at:end] if at or cut else text)
            at = end
            ids = np.array(ids, np.uint32)
            after = self.line[ids]
            after[:-1] |= self.ends[ids[:-1]] & self.blank[ids[1:]]
            yield ids, np.flatnonzero(after) + 1


def window_ends(places: np.ndarray, penalties: np.ndarray, width: int) -> list[int]:
    """Places, from the first to the last, between which windows run: the
    cheapest way under the costs above. Neighbours are at most ``width`` apart.
    Unpadded windows are looked for from an eighth of the width on."""
    n = len(places)
    ends, starts = [], []               # pairs of places a power of two apart
    for k in range(width.bit_length()):
        if width // 8 <= 1 << k <= width:
            from_ = np.searchsorted(places, places - (1 << k))
            hit = np.flatnonzero(places[from_] == places - (1 << k))
            ends.append(hit)
            starts.append(from_[hit])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    starts, upto = starts[order].tolist(), np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    x, fee = places.tolist(), (penalties + WINDOW).tolist()
    cost, back = [0] * n, [0] * n
    queue: deque = deque([(x[0], x[0], 0)])         # (cost + place, place, number): costs + places rising
    for j in range(1, n):
        here = x[j]
        while here - queue[0][1] > width:
            queue.popleft()
        best, _, i = queue[0]
        best += width - here
        for k in starts[upto[j]:upto[j + 1]]:
            if cost[k] < best:
                best, i = cost[k], k
        best += fee[j]
        cost[j], back[j] = best, i
        best += here
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, here, j))
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return [x[i] for i in reversed(out)]


def _filled(places: np.ndarray, fees: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates with more of them, inside sentences, where two lie more than
    ``gap`` apart."""
    wide = np.flatnonzero(np.diff(places) > gap)
    if not len(wide):
        return places, fees
    more = np.concatenate([np.arange(places[i] + gap, places[i + 1], gap) for i in wide])
    places, order = np.unique(np.concatenate([places, more]), return_index=True)
    return places, np.concatenate([fees, np.full(len(more), INSIDE)])[order]


class Packer:
    """One task's stream. ``add`` takes a document's ids block by block,
    ``close`` ends it; ``pieces`` hands out finished rows of closed documents."""

    def __init__(self, width: int, hold: int, first_sequence: int):
        self.width, self.hold, self.sequence = width, hold, first_sequence
        self.base, self.end = 0, 0                  # places in the stream: first held token, end
        self.tokens: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.fees: list[np.ndarray] = []
        self.docs: list[list] = []                  # [id, start, tokens], from the first one not emitted on
        self.open: list[tuple] = []                 # pieces of a document that is still open
        self.rows: list[tuple] = []

    def begin(self, doc_id) -> None:
        self.docs.append([doc_id, self.end, None])

    def add(self, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.tokens.append(ids)
        self.places.append(self.end + sentences)
        self.fees.append(np.full(len(sentences), SENTENCE))
        self.end += len(ids)
        if self.end - self.base >= self.hold:
            self._flush(False)

    def close(self, end_id: int) -> None:
        self.tokens.append(np.array([end_id], np.uint32))
        self.end += 1
        self.places.append(np.array([self.end]))
        self.fees.append(np.zeros(1, np.int64))
        doc = self.docs[-1]
        doc[2] = self.end - doc[1]
        self.rows.extend((*p, doc[2]) for p in self.open)
        self.open = []

    def finish(self) -> None:
        if self.end > self.base:
            self._flush(True)

    def _flush(self, last: bool) -> None:
        width = self.width
        places = np.concatenate([[self.base], *self.places]).astype(np.int64)
        fees = np.concatenate([[0], *self.fees]).astype(np.int64)
        order = np.lexsort((fees, places))              # one candidate a place, at the least fee
        places, fees = places[order], fees[order]
        once = np.append(True, np.diff(places) > 0)
        places, fees = places[once], fees[once]
        known = len(places)
        if places[-1] < self.end:                       # what is held ends inside a sentence
            places, fees = np.append(places, self.end), np.append(fees, INSIDE)
        cuts = window_ends(*_filled(places, fees, min(GAP, width)), width)
        if last:
            length = cuts[-1] - cuts[-2]
            parts = bin(length).count("1")
            if parts > 1 and width - length > (parts - 1) * INSIDE:
                cuts[-1:] = [cuts[-1] - length + (length >> k << k) for k in range(width.bit_length(), -1, -1)
                             if length >> k & 1]
        else:
            cuts = cuts[:-8] if len(cuts) > 16 else cuts[:2]
        tokens = np.concatenate(self.tokens)
        self._emit(tokens[:cuts[-1] - self.base], np.array(cuts))
        self.tokens, self.base = [tokens[cuts[-1] - self.base:].copy()], cuts[-1]
        rest = np.flatnonzero(places[:known] > self.base)
        self.places, self.fees = [places[rest]], [fees[rest]]

    def _emit(self, tokens: np.ndarray, cuts: np.ndarray) -> None:
        starts = np.array([d[1] for d in self.docs])
        edges = np.unique(np.concatenate([cuts, starts[(starts > cuts[0]) & (starts < cuts[-1])]]))
        of_doc = np.searchsorted(starts, edges[:-1], side="right") - 1
        of_seq = np.searchsorted(cuts, edges[:-1], side="right") - 1
        raw = tokens.astype("<u4")
        for a, b, d, s in zip(edges[:-1].tolist(), edges[1:].tolist(), of_doc.tolist(), of_seq.tolist()):
            doc_id, start, total = self.docs[d]
            crc = zlib.crc32(raw[a - self.base:b - self.base])
            piece = (doc_id, a - start, b - a, crc, self.sequence + s, a - int(cuts[s]))
            if total is None:
                self.open.append(piece)
            else:
                self.rows.append((*piece, total))
        self.sequence += len(cuts) - 1
        self.docs = [d for d in self.docs if d[2] is None or d[1] + d[2] > cuts[-1]]

    def pieces(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


_ENCODERS: dict = {}


def pack(docs: DataFrame, width: int = 2048, vocabulary: str = VOCABULARY, end_id: int = 1, hold: int = 1 << 20,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``width`` tokens:
    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).
    ``vocabulary``: a file that every executor has, or the name of a public one."""
    C.ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, Encoder(vocabulary))
        packer = Packer(width, hold, TaskContext.get().partitionId() << 40)
        schema = None

        def out():
            cols = list(zip(*packer.pieces()))
            doc, start, length, crc, seq, off, total = cols
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, schema.field(0).type), *(pa.array(c, pa.int64())
                                                        for c in (start, length, crc, total, seq, off))], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("doc_id"), *SCHEMA])
            for doc_id, text in C.rows_of([batch], "doc_id", "text"):
                packer.begin(doc_id)
                for ids, sentences in enc.parts(text):
                    packer.add(ids, sentences)
                packer.close(end_id)
                if len(packer.rows) > 20_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return src.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                               "sequence_id bigint, offset bigint")


def op12_window_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return pack(C.table(spark, sf_dir, "documents"))
