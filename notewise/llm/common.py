"""Helpers shared by the operators of this folder.

Words are `[^\\x20\\x09-\\x0D]+` throughout: ``bytes.split()`` cuts at exactly
those six characters, so texts travel to Python as UTF-8 bytes. Lower-casing
touches A-Z alone (``bytes.lower()``).

An operator reads only the columns it names, so further columns of the input,
whatever they are called, neither disturb it nor come back.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.session import cut_lineage, ship_package, shared_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the two columns an operator works on; null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def id_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def by_bytes(rows: Iterable, size, limit: int) -> Iterator[list]:
    """Cut a stream of rows into lists of at most ``limit`` bytes (one row may
    exceed it alone): whole Arrow batches of long texts never sit in memory
    as intermediate arrays."""
    out, total = [], 0
    for r in rows:
        n = size(r)
        if out and total + n > limit:
            yield out
            out, total = [], 0
        out.append(r)
        total += n
    if out:
        yield out


def with_text(docs: DataFrame, text_col: str, cols: list[str]) -> tuple[DataFrame, str]:
    """``docs`` cut to ``cols`` and the text, and the text's name there: a text
    that is one of ``cols`` is sent once."""
    if text_col in cols:
        return docs.select(*cols), text_col
    return docs.select(*cols, F.col(text_col).alias("_text")), "_text"


def text_blocks(batch: pa.RecordBatch, name: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive slices of a batch with about ``limit`` bytes of text each
    (one text may exceed that), and their texts; null is empty. Only one
    slice's texts are Python objects at a time."""
    texts = batch.column(name).cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, end - at), [t or b"" for t in texts.slice(at, end - at).to_pylist()]
        at = end


@contextlib.contextmanager
def small_batches(spark: SparkSession, limit: str = "4m") -> Iterator[None]:
    """Inside, Spark hands Python tasks Arrow batches of about ``limit``
    instead of up to 64 MB. Both sides hold a batch whole, besides what the
    executor still has from earlier stages. For jobs that run inside only."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return freed memory to the system. Spark keeps a Python worker after
    its task; what it holds then is missing to the executor's other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # not glibc
        pass


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from columns in the order of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t)
         for c, t in zip(columns, schema.types)], schema=schema)


class Memo(dict):
    """A dict that computes and keeps missing values, emptied when it holds
    ``bound`` of them."""

    def __init__(self, fn, bound: int = 400_000):
        super().__init__()
        self.fn, self.bound = fn, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        v = self[key] = self.fn(key)
        return v


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each consecutive segment; empty segments give 0."""
    c = np.concatenate([np.zeros((1,) + values.shape[1:]), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return c[ends] - c[ends - lengths]
