"""JSON array files read in blocks by many tasks (S1-S3 for files of any size).

Spark's text reader splits a file at any separator, so with ``}`` as the line
end a JSON array file is read in blocks of ``spark.sql.files.maxPartitionBytes``
like any text, from any store Spark reads. A block begins anywhere: inside a
string, some levels deep. Three steps find out where:

1. Each block is scanned once for its summary: the parity of its unescaped
   quotes, and how many levels its brackets open in all, once for a block that
   begins outside a string and once for one that begins inside.
2. A prefix sum over a file's blocks turns summaries into the state each block
   begins in: the parity first, which tells which of the two levels counts.
3. The blocks are scanned again from their known states and cut at the commas
   and brackets of the outermost array. Elements inside one block are complete;
   the rest, at most two pieces a block, are put together by file and position.

Only a file whose brackets or quotes don't balance is rejected as a whole. An
element that is no JSON for another reason is rejected alone, with its text.
Elements are taken to be objects: an array without any ``}`` is one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewise.session import cut_lineage, ship_package

CHUNK = 4 << 20         # bytes scanned at once
BLANKS = b" \t\r\n"     # fixed value: white space between JSON tokens
_BLANK = np.isin(np.arange(256), list(BLANKS))
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1


@contextmanager
def _blocks_of(spark: SparkSession, block_bytes: int | None) -> Iterator[None]:
    """Files are split at ``block_bytes`` meanwhile."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if block_bytes:
        spark.conf.set(key, str(block_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _scan(data: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """(is each character inside a string, is the end), quotes included on
    their opening side, from the state at the beginning."""
    place = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != 92, place, -1))      # last character up to here that is no backslash
    quotes = np.flatnonzero(data == 34)
    escaped = ((quotes - 1 - np.where(quotes > 0, other[quotes - 1], -1)) % 2).astype(bool)
    quote = np.zeros(len(data), np.int64)
    quote[quotes[~escaped]] = 1
    state = (np.cumsum(quote) + inside) % 2
    return state.astype(bool) | quote.astype(bool), int(state[-1]) if len(state) else inside


def _chunks(batches, *names: str):
    """(values of the named columns, pieces) of consecutive rows alike in them,
    up to about ``CHUNK`` bytes at a time."""
    now, held, size = None, [], 0
    for batch in batches:
        for *key, value in zip(*(batch.column(n).to_pylist() for n in (*names, "value"))):
            if now != key or size >= CHUNK:
                if now is not None:
                    yield now, held
                now, held, size = key, [], 0
            held.append(value)
            size += len(value or b"")
    if now is not None:
        yield now, held


def _bytes(pieces: list) -> np.ndarray:
    return np.frombuffer(b"".join(p + b"}" for p in pieces), np.uint8)


def _summaries(batches):
    total: dict = {}
    for (file, size, block), pieces in _chunks(batches, "file", "size", "block"):
        t = total.setdefault((file, size, block), [0, 0, 0, 0])
        data = _bytes(pieces)
        inside, t[0] = _scan(data, t[0])
        step = _STEP[data]
        t[1] += int(step[~inside].sum())
        t[2] += int(step[inside].sum())     # what is inside here is outside if the block begins in a string
        t[3] += len(data)
    for key, t in total.items():
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "size", "block", "parity", "out", "inn", "bytes"), (*key, *t)))],
                                         schema=pa.schema([("file", pa.string()), ("size", pa.int64()), ("block", pa.int64()),
                                                           ("parity", pa.int64()), ("out", pa.int64()), ("inn", pa.int64()),
                                                           ("bytes", pa.int64())]))


def _cut(batches):
    """Elements and pieces of elements of blocks that come in order, each led
    by a row with its state."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("no", pa.int64()), ("whole", pa.bool_()),
                        ("text", pa.string()), ("opens", pa.int64()), ("stray", pa.int64()), ("commas", pa.int64())])
    rows: list[tuple] = []
    key, inside, depth, no, begun, parts, opens, stray = None, 0, 0, 0, False, [], 0, 0

    def close():
        if parts:
            rows.append((*key, no, False, b"".join(parts).decode("utf-8", "replace"), None, None, None))
        rows.append((*key, None, None, None, opens, stray, no))

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        rows.clear()
        return batch

    for (file, block, state, levels), pieces in _chunks(batches, "file", "block", "inside", "depth"):
        if state is not None:
            if key is not None:
                close()
            key, inside, depth = (file, block), state, levels
            no, begun, parts, opens, stray = 0, False, [], 0, 0
            continue
        data = _bytes(pieces)
        quoted, inside = _scan(data, inside)
        step = np.where(quoted, 0, _STEP[data])
        after = depth + np.cumsum(step)
        before = after - step
        depth = int(after[-1])
        outer = (before == 0) & ~quoted & ~_BLANK[data]
        opening = outer & (data == ord("["))
        edge = np.flatnonzero(opening | (~quoted & (before == 1) & ((data == ord(",")) | (step == -1))))
        opens += int(opening.sum())
        stray += int((((before == 0) & ~_BLANK[data] & ~opening) | (before < 0)).sum())
        raw, at = data.tobytes(), 0
        for e in edge.tolist():
            if raw[e] != ord("["):
                parts.append(raw[at:e])
                rows.append((*key, no, begun, b"".join(parts).decode("utf-8", "replace"), None, None, None))
                no += raw[e] == ord(",")
            begun, parts, at = raw[e] in b"[,", [], e + 1
        if depth >= 1:
            parts.append(raw[at:])
        if len(rows) >= 10_000:
            yield out()
    if key is not None:
        close()
    if rows:
        yield out()


def array_elements(spark: SparkSession, path, block_bytes: int | None = None) -> DataFrame:
    """(source_file, pos, text, bad_file): the elements of JSON array files in
    order, or one row (pos and text NULL) for each file that is none.
    ``block_bytes``: size of a block, by default Spark's own setting."""
    ship_package(spark)

    def pieces() -> DataFrame:
        return spark.read.option("lineSep", "}").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    with _blocks_of(spark, block_bytes):
        found = cut_lineage(pieces().mapInArrow(
            _summaries, "file string, size bigint, block bigint, parity bigint, out bigint, inn bigint, bytes bigint"),
            spark, "array-summaries")
        along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        states = (found.withColumn("inside", F.coalesce(F.sum("parity").over(along), F.lit(0)) % 2)
                  .withColumn("levels", F.when(F.col("inside") == 1, F.col("inn")).otherwise(F.col("out")))
                  .withColumn("depth", F.coalesce(F.sum("levels").over(along), F.lit(0))))
        states = cut_lineage(states, spark, "array-states")
        none = F.lit(None).cast("bigint")
        rows = pieces().select("file", "block", (F.monotonically_increasing_id() + 1).alias("seq"), "value",
                               none.alias("inside"), none.alias("depth"))
        led = rows.unionByName(states.select("file", "block", F.lit(0).cast("bigint").alias("seq"),
                                             F.lit(None).cast("binary").alias("value"), "inside", "depth"))
        cut = cut_lineage(led.repartition("file", "block").sortWithinPartitions("file", "block", "seq").mapInArrow(
            _cut, "file string, block bigint, no bigint, whole boolean, text string, opens bigint, stray bigint, commas bigint"),
            spark, "array-pieces")

    blocks = cut.where("opens IS NOT NULL").select("file", "block", "opens", "stray", "commas")
    offsets = blocks.select("file", "block", F.coalesce(F.sum("commas").over(along), F.lit(0)).alias("offset"))
    # a file that ends in ']' gets one '}' too many, and so ends a level below 0 with one stray sign
    whole = (states.groupBy("file").agg(
        (F.sum("parity") % 2).alias("parity"), F.sum("levels").alias("depth"),
        (F.sum("bytes") - F.max("size")).alias("more"))
        .join(blocks.groupBy("file").agg(F.sum("opens").alias("opens"), F.sum("stray").alias("stray"),
                                         F.sum("commas").alias("commas")), "file"))
    even = (F.col("parity") == 0) & (F.col("depth") == -F.col("more"))
    reason = (F.when(~even, F.lit("malformed")).when(F.col("opens") == 0, F.lit("not_an_array"))
              .when((F.col("opens") != 1) | (F.col("stray") != F.col("more")), F.lit("malformed")))
    files = whole.select("file", "commas", reason.alias("bad_file"))
    placed = (cut.where("no IS NOT NULL").join(offsets, ["file", "block"])
              .select("file", "block", (F.col("offset") + F.col("no")).cast("int").alias("pos"), "whole", "text"))
    joined = (placed.where("NOT whole").groupBy("file", "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text")))
    elements = (placed.where("whole").select("file", "pos", "text").unionByName(joined)
                .join(files.where("bad_file IS NULL"), "file")
                .where(~((F.col("commas") == 0) & (F.trim(F.col("text"), F.lit(BLANKS.decode())) == ""))))
    bad = files.where("bad_file IS NOT NULL")
    return elements.select(F.col("file").alias("source_file"), "pos", "text", F.lit(None).cast("string").alias("bad_file")) \
        .unionByName(bad.select(F.col("file").alias("source_file"), F.lit(None).cast("int").alias("pos"),
                                F.lit(None).cast("string").alias("text"), "bad_file"))


def parse_record_blocks(spark: SparkSession, path, id_key: str | None = None, block_bytes: int | None = None) -> DataFrame:
    """What ``records.parse_record_files`` gives, read in blocks: (source_file,
    pos, rec, bad_file, record_id), and the text of each element. An element
    that is no JSON is a row of its own with the reason 'malformed'."""
    found = array_elements(spark, path, block_bytes).withColumn("rec", F.try_parse_json("text"))
    place = F.when(F.col("pos").isNotNull(), F.xxhash64("source_file", "pos"))
    key: Column = F.try_variant_get("rec", f"$.{id_key}", "bigint") if id_key else place
    broken = F.when(F.col("pos").isNotNull() & F.col("rec").isNull(), F.lit("malformed"))
    return found.select("source_file", "pos", "rec", F.coalesce("bad_file", broken).alias("bad_file"),
                        key.alias("record_id"), "text")
