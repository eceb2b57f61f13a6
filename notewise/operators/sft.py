"""Fine-tuning dataset preparation.

One lazy plan from records to export: chat text (T1), token counts (T2),
budget filter and truncation (F1, T3), completion-only labels (T4), audit
(T5) and the length report (A5). The default counter is the regex of
``functions.tokens`` (not a sub-word count); a real tokenizer plugs in as an
Arrow UDF through ``token_count_with``.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from notewise.functions.chat import messages_generation, messages_training, render_llama3
from notewise.functions.tokens import budget_tokens, count_tokens, let
from notewise.plans.prompts import HDR_END, LABEL_IGNORE, TOKEN_BUDGET


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_training_text(df: DataFrame, note="input", answer="output") -> DataFrame:
    """Chat text of each row (system, padded note, gold answer)."""
    return df.withColumn("text", render_llama3(messages_training(note, answer)))


def token_count(text="text", extra_bos: bool = True) -> Column:
    """Tokens of the text. ``extra_bos`` counts the start marker a
    tokenizer adds on top of the one the template already wrote (the
    reported counts include it, training does not)."""
    n = count_tokens(text)
    return (n + 1 if extra_bos else n).cast("int")


def _over_blocks(values: Callable[[list], list], kind: pa.DataType, block_bytes: int = 1 << 20):
    """Body of an Arrow UDF over texts: ``values`` maps the texts of a block of
    about ``block_bytes`` (one text may exceed that) to as many values. Only
    one block's texts and values are Python objects at a time."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                done = int(ends[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(ends, done + block_bytes, side="right")))
                out = values(texts.slice(at, end - at).to_pylist())
                if len(out) != end - at:
                    raise ValueError(f"the tokenizer returned {len(out)} values for {end - at} texts")
                yield pa.array(out, kind)
                at = end
    return run


def token_count_with(tokenize: Callable[[list[str]], list[int]]):
    """T2 with a user tokenizer: an Arrow UDF over blocks of texts.
    ``tokenize`` maps a list of texts to their token counts."""
    return arrow_udf(_over_blocks(lambda texts: [int(n) for n in tokenize(texts)], pa.int32()), T.IntegerType())


def token_ids_with(tokenize: Callable[[list[str]], list[list[int]]]):
    """T2/T4 with a user tokenizer: an Arrow UDF over blocks of texts that
    returns each text's token ids. ``tokenize`` maps a list of texts to lists
    of ids; a NULL text has no ids."""
    def ids(texts: list) -> list:
        there = [t for t in texts if t is not None]
        found = list(tokenize(there)) if there else []
        if len(found) != len(there):
            raise ValueError(f"the tokenizer returned {len(found)} lists for {len(there)} texts")
        found = iter(found)
        return [None if t is None else [int(i) for i in next(found)] for t in texts]
    return arrow_udf(_over_blocks(ids, pa.list_(pa.int32())), T.ArrayType(T.IntegerType()))


def within_budget(df: DataFrame, budget: int = TOKEN_BUDGET, col: str = "token_count") -> DataFrame:
    """rows strictly under the budget."""
    return df.where(F.col(col) < budget)


def within_budget_of_text(df: DataFrame, text: str = "text", budget: int = TOKEN_BUDGET, keep=("record_id",)) -> DataFrame:
    """F1 from the text: keep + token_count of the rows under the budget. The
    count is bound before it is compared, so a row is counted once; a filter
    over a counted column would be pushed down and count again."""
    counted = F.array(F.struct(count_tokens(text).cast("int").alias("token_count")))
    return df.select(*keep, F.inline(F.filter(counted, lambda x: x["token_count"] < budget)))


def truncate(tokens="tokens", budget: int = TOKEN_BUDGET) -> Column:
    """The first ``budget`` tokens."""
    return F.slice(_c(tokens), 1, budget)


def last_marker_pos(tokens, marker: str = HDR_END) -> Column:
    """1-based position of the last ``marker`` in the array, 0 if absent."""
    def body(t):
        p = F.array_position(F.reverse(t), F.lit(marker))
        return F.when(p == 0, F.lit(0)).otherwise(F.size(t) - p + 1)
    return let(_c(tokens), body)


def completion_labels(tokens="tokens", ids=None, marker: str = HDR_END) -> Column:
    """T4: per-token labels: ignored (-100) up to and including the last
    response header marker, the token id after it. Without a marker every
    label is ignored. ``ids``: token ids aligned with ``tokens``; by default
    a token's position stands in for its id."""
    idv = _c(ids) if ids is not None else None

    def body(t):
        # the marker position is bound once per row, not recomputed per token
        return let(last_marker_pos(t, marker), lambda last: F.transform(
            t, lambda x, i: F.when((last == 0) | (i + 1 <= last), F.lit(LABEL_IGNORE))
            .otherwise(F.get(idv, i) if idv is not None else i)))
    return let(_c(tokens), body)


def last_run_end(ids, marker: list[int]) -> Column:
    """1-based position of the last id of the last place where ``marker``, a
    run of one or more ids, stands whole in the array; 0 if nowhere. Only
    places that hold the marker's first id are compared with all of it."""
    run = F.lit([int(i) for i in marker]).cast("array<int>")
    m = len(marker)

    def body(t):
        places = F.transform(t, lambda x, i: F.when((x == marker[0]) & (i + m <= F.size(t)), i + 1))
        whole = F.filter(places, lambda i: i.isNotNull() & (F.slice(t, F.coalesce(i, F.lit(1)), m) == run))
        return F.coalesce(F.array_max(whole) + (m - 1), F.lit(0))
    return let(_c(ids), body)


def completion_labels_of_ids(ids="ids", marker: list[int] = ()) -> Column:
    """T4 over real token ids: -100 up to and including the last whole run of
    the marker's ids (a response header is several tokens in most vocabularies),
    the id itself after it. A marker that is absent, or cut off by truncation,
    leaves every label -100. Overlapping runs count: the last one ends it."""
    if not marker:
        raise ValueError("a marker of at least one id is needed")

    def body(t):
        return let(last_run_end(t, list(marker)), lambda last: F.transform(
            t, lambda x, i: F.when((last == 0) | (i < last), F.lit(LABEL_IGNORE)).otherwise(x)))
    return let(_c(ids), body)


def label_frame(df: DataFrame, text: str = "text", budget: int = TOKEN_BUDGET) -> DataFrame:
    """Tokens, truncation and labels for every row (T3 + T4), plus the
    positions the audit needs."""
    full = df.withColumn("_tok", budget_tokens(text))
    return (full.withColumn("tokens", truncate("_tok", budget))
            .withColumn("labels", completion_labels("tokens"))
            .withColumn("header_full", last_marker_pos("_tok"))
            .withColumn("header_kept", last_marker_pos("tokens"))
            .drop("_tok"))


def supervision_audit(labelled: DataFrame, by: str = "split") -> DataFrame:
    """T5: per split: mean supervised tokens, rows with none, rows whose
    answer header fell past the budget (the note then becomes the
    supervised text)."""
    sup = F.size(F.filter("labels", lambda x: x != F.lit(LABEL_IGNORE)))
    return labelled.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(sup).alias("avg_supervised"),
        F.count_if(sup == 0).alias("rows_unsupervised"),
        F.count_if(F.col("header_full") != F.col("header_kept")).alias("rows_header_cut"))


def length_report(df: DataFrame, budget: int = TOKEN_BUDGET, by: str = "split",
                  col: str = "token_count") -> DataFrame:
    """A5: per split: rows under the budget, rows, share (NULL for no rows)."""
    return df.groupBy(by).agg(
        F.count_if(F.col(col) < budget).alias("n_under"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("share_under", F.try_divide(F.col("n_under").cast("double"), F.col("n_rows")))


def first_eval_prompt(records: DataFrame, split: str = "validation") -> DataFrame:
    """Generation prompt of the first row of a split (by record_id).

    A top-1 by key: Spark plans it as a partial take per task, so no task
    sees the whole split.
    """
    first = records.where(F.col("split") == split).orderBy("record_id").limit(1)
    return first.select("record_id", "output",
                        render_llama3(messages_generation("input"), add_generation_prompt=True)
                        .alias("prompt"))


def prepare_sft(records: DataFrame, extra_bos: bool = True) -> DataFrame:
    """T1 + T2: the exported columns."""
    return (format_training_text(records)
            .withColumn("token_count", token_count("text", extra_bos)))
