"""Token counts by a separator scan over flat token files.

Token files are bare arrays of fixed-width token ids, documents one after the
other, each closed by an end-of-document id; there is no index. They are read
in blocks of ``block_tokens``: each task searches its blocks for the
separator with one vectorised comparison and returns the positions. Where a
document begins in one block and ends in another, a prefix scan stitches it:
for each block, the documents closed before it and the place of the last
separator before it, summed over groups of blocks first, then inside each
group, so no task gets all blocks of a file.

``write_token_files`` makes such files from texts with a public byte-pair
vocabulary (its path is a parameter). Every task attempt writes files of its
own; a manifest, written by Spark, names those that count and says which
document is the how-manieth of its file, and nothing about lengths.

Edge cases: null or empty text is a document of 0 tokens; tokens after the
last separator of a file are a document that isn't ``closed``; an empty file
or table gives no rows; repeated rows count each; texts that spell the
separator are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
END_OF_DOCUMENT = 50256
GROUP = 1024            # blocks whose sums are added up at once
#: how the vocabulary's authors cut text before merging bytes; a fixed value
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def encoder(path: str):
    """Tokenizer of a ranks file."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict = {}


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT,
                      width: str = "<u2") -> DataFrame:
    """Encode (doc_id, text) into flat files below ``folder``, one for each
    task; returns the manifest (file, ordinal, doc_id)."""
    C.ship_package(docs.sparkSession)
    shared, below = _open(folder)
    shared.create_dir(below, recursive=True)         # there even if no task writes

    def run(batches):
        enc = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, encoder(vocabulary))
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tokens"
        target, path = _open(folder)
        done = 0
        with target.open_output_stream(f"{path}/{name}") as out:
            for b in batches:
                ids = b.column("doc_id")
                for text in b.column("text").to_pylist():
                    tokens = np.array([*enc.encode_ordinary(text), end], dtype=width)
                    out.write(tokens.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids), pa.string()), pa.array(range(done, done + len(ids)), pa.int64()), ids],
                    names=["file", "ordinal", "doc_id"])
                done += len(ids)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"file string, ordinal bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def scan(spark: SparkSession, folder: str, end: int = END_OF_DOCUMENT, width: str = "<u2",
         block_tokens: int = 1 << 20) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the token
    files of a folder; ``start`` is its first token's place in the file."""
    C.ship_package(spark)
    size = np.dtype(width).itemsize
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
             .select("path", (F.col("length") / size).cast("long").alias("total")).where("total > 0"))
    blocks = (files.select("path", "total", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_tokens))).alias("block"))
        .repartition("path", "block"))
    schema = pa.schema([("path", pa.string()), ("total", pa.int64()), ("block", pa.int64()),
                        ("ends", pa.list_(pa.int64())), ("runs", pa.list_(pa.int64()))])

    def find(batches):
        for path, total, block in C.rows_of(batches, "path", "total", "block"):
            at = block * block_tokens
            source, name = _open(path)
            with source.open_input_file(name) as f:
                ids = np.frombuffer(f.read_at(min(block_tokens, total - at) * size, at * size), dtype=width)
            ends = np.flatnonzero(ids == end)
            runs = np.diff(ends, prepend=-1) - 1          # tokens before each separator, in this block
            yield C.record(schema, [path], [total], [block], [ends + at], [runs])

    found = C.cut_lineage(blocks.mapInArrow(find, "path string, total bigint, block bigint, ends array<bigint>, "
                                                  "runs array<bigint>"), spark, "token-ends")
    # prefix scan: separators before a block, and the place of the last one
    each = found.select("path", "block", F.floor(F.col("block") / GROUP).alias("g"), F.size("ends").alias("docs"),
                        F.array_max("ends").alias("last"))
    groups = Window.partitionBy("path").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("path", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (each.groupBy("path", "g").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
             .select("path", "g", F.sum("docs").over(groups).alias("docs_g"), F.max("last").over(groups).alias("last_g")))
    before = (each.join(ahead, ["path", "g"])
              .select("path", "block",
                      (F.coalesce("docs_g", F.lit(0)) + F.coalesce(F.sum("docs").over(inside), F.lit(0))).alias("docs"),
                      F.greatest(F.coalesce("last_g", F.lit(-1)), F.coalesce(F.max("last").over(inside), F.lit(-1))).alias("last")))
    stitched = found.join(before, ["path", "block"])
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    # only the first document closed in a block can have begun before it
    carried = F.when(F.col("pos") == 0, F.col("block") * block_tokens - F.col("last") - 1).otherwise(0)
    closed = (stitched.select("path", "block", "docs", "last", F.posexplode(F.arrays_zip("ends", "runs")).alias("pos", "d"))
              .select(file, (F.col("docs") + F.col("pos")).alias("ordinal"), "d.ends", (F.col("d.runs") + carried).alias("n_tokens"))
              .select("file", "ordinal", (F.col("ends") - F.col("n_tokens")).alias("start"), "n_tokens",
                      F.lit(True).alias("closed")))
    tail = (each.groupBy("path").agg(F.sum("docs").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
            .join(files, "path").where("total - 1 > last")
            .select(file, "ordinal", (F.col("last") + 1).alias("start"), (F.col("total") - F.col("last") - 1).alias("n_tokens"),
                    F.lit(False).alias("closed")))
    return closed.unionByName(tail)


def op4_separator_scan(spark, sf_dir: str) -> DataFrame:
    """Tokens of all documents: written as flat token files, then counted by
    the scan of those files."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = C.shared_path(spark, "tokens")
    manifest = C.cut_lineage(write_token_files(docs, folder), spark, "token-manifest")
    counted = scan(spark, folder)
    return (manifest.join(counted, ["file", "ordinal"])
            .select("doc_id", F.col("n_tokens"), "file", "ordinal", "start"))
