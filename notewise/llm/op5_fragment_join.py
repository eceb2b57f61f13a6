"""N-gram Jaccard join by vertical partitioning.

Every text becomes its set of word n-grams (64-bit hashes). The hash order is
the global order; it is cut at fixed pivots into ``FRAGMENTS`` fragments, and
a set is stored as its piece in each of them. Two sets link when
``100 * |x & y| >= percent * |x | y|``. The overlap of a candidate pair is
counted fragment by fragment (each a small join of its own) and summed; a pair
that lacks more in its first fragments than whole sets may goes no further, and
one whose sets' 256-bit parity marks differ in more bits than that not even there.

Texts are read twice. The first pass keeps the head of each set (step 2), the
second the whole sets of those that stay after it: whole sets of all texts
would take more room than the texts.

Candidates, none of which can be missed:

1. Equal sets collapse into one representative.
2. Of a set of n, all but ``need = ceil(percent * n / 100)`` elements, and
   ``l = n / spare`` more, form its head in the global order. Linked sets share
   at least ``min(l)`` elements of both heads. So a set whose head holds fewer
   elements known to any other head has no link and leaves.
3. What stays is ordered by (documents with the element, hash), and indexed
   by its rarest head elements only, as many as the same count argument needs.
4. Buckets of that index up to ``small`` members are paired. The members of
   larger ones form groups, and each group has a core V, the elements that
   more than half of it hold. Each member x is compared with V alone: o(x) =
   |x & V| and the difference D(x) = (x - V) + (V - x). For any two members

       |x & y| = o(x) + o(y) - |V| + |D(x) & D(y)|,

   so they link exactly when they share at least m(x, y) elements of their
   differences, m being known from o and n. Where m <= 0 they link whatever
   the differences: one edge to the member nearest to V stands for all those
   pairs. The others are members with small differences and a known least
   overlap of them: they are indexed by their rarest difference elements (3),
   and 4 repeats on that index. After ``rounds`` rounds what is left is paired.
   Two members of several groups meet in one: where the largest group of both
   is the same, nowhere else. Only elements that members with something to find
   in a group share become rows; a group without such members is left out.

So a large group of near copies costs a comparison with its core for each
member, not one for each pair, and components come out exact.

Edge cases: a text with fewer words than n is one n-gram, its whole word
sequence; null text or one without a word has the empty set and links with
nothing, its component is its own id; repeated rows are linked copies; a null
id is the smallest of its component only if all are null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import common as C

FRAGMENTS = 4
#: where the global order is cut: equal ranges of signed 64-bit hashes
PIVOTS = np.array([-(1 << 62), 0, 1 << 62], dtype=np.int64)
#: members of a large group that one task compares with the group's own row
SHARE = 1024
#: elements of a large group's heads that are held against each other at once
SLICE = 1 << 16
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ADD = np.uint64(0xD6E8FEB86659FD93)


def _join_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    m = len(words) - n + 1
    h = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        h = (h ^ words[j:j + m]) * _MUL
        h ^= h >> np.uint64(32)
        h = h * _ADD
        h ^= h >> np.uint64(29)
    return h


def hash_set(text: bytes, n: int, word_hash) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(word_hash, words), dtype=np.uint64, count=len(words))
    return np.unique(_join_hashes(ids, min(n, len(words))).view(np.int64))


def _head_size(n: int, percent: int, spare: int) -> int:
    """Elements in the head of a set of n."""
    return min(n, n - -(-n * percent // 100) + max(1, n // spare))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets), pa.int64()))


def shingle_sets(docs: DataFrame, words: int, head: tuple[int, int] | None = None) -> DataFrame:
    """The columns of ``docs`` but ``text`` (bytes), and n, key, f0..f3: the
    set of each row in its fragments; ``key`` is a digest of the whole set,
    null if empty. With ``head`` (percent, spare) the column head, the head
    of the set, instead of the fragments."""
    C.ship_package(docs.sparkSession)
    names = ["head"] if head else [f"f{i}" for i in range(FRAGMENTS)]
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        memo = C.Memo(xxhash.xxh64_intdigest, 150_000)
        for b in batches:
            for part, texts in C.text_blocks(b, "text", 1 << 20):
                sets = [hash_set(t, words, memo.__getitem__) for t in texts]
                if head:
                    cols = [_lists([s[:_head_size(len(s), *head)] for s in sets])]
                else:
                    cuts = [[0, *np.searchsorted(s, PIVOTS), len(s)] for s in sets]
                    cols = [_lists([s[c[i]:c[i + 1]] for s, c in zip(sets, cuts)]) for i in range(FRAGMENTS)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array(keys, pa.binary()), *cols], names=[*keep, "n", "key", *names])
        memo.clear()
        C.give_back()

    schema = docs.select(*keep).schema.add("n", "integer").add("key", "binary")
    for name in names:
        schema = schema.add(name, ArrayType(LongType()))
    return docs.mapInArrow(run, schema)


def _need(n, percent: int):
    """Least overlap of a set of n with any set that it links to."""
    return F.ceil(n * percent / F.lit(100)).cast("int")


def _likely(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_by_parity(pairs: DataFrame, fragments: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """Of pairs (a, b, na, nb), all that link and few others. A set's mark has
    64 bits a fragment, each turned over by every element that falls on it; two
    marks differ in no more bits than their sets in elements."""
    parity = F.expr("aggregate(hashes, 0L, (s, x) -> s ^ shiftleft(1L, cast(x & 63 as int)))")
    marks = fragments.groupBy("rid").agg(*[F.max(F.when(F.col("fragment") == i, parity)).alias(f"s{i}")
                                           for i in range(FRAGMENTS)])
    # a mark is some times as long as an id
    few = F.broadcast if 4 * fragments.where("fragment = 0").count() <= broadcast_rows else lambda df: df
    for end in ("a", "b"):
        pairs = pairs.join(few(marks.select(F.col("rid").alias(end), *[F.col(f"s{i}").alias(f"{end}{i}")
                                                                       for i in range(FRAGMENTS)])), end)
    apart = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(FRAGMENTS)])
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    return pairs.where(apart <= F.col("na") + F.col("nb") - 2 * least).select("a", "b", "na", "nb")


def overlaps(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, common): overlaps of pairs (a, b, na, nb) of rids, counted
    in each fragment and summed. ``fragments`` is (rid, fragment, hashes). A pair
    goes on to the next fragment only while it can still link."""
    # linked sets share that much, so of each no more than the rest is missing
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    so_far = pairs.select("a", "b", "na", "nb", *[F.lit(0).alias(c) for c in ("common", "only_a", "only_b")])
    for i in range(FRAGMENTS):
        piece = fragments.where(F.col("fragment") == i)
        so_far = (so_far.join(piece.select(F.col("rid").alias("a"), F.col("hashes").alias("ha")), "a")
                  .join(piece.select(F.col("rid").alias("b"), F.col("hashes").alias("hb")), "b")
                  .withColumn("here", F.size(F.array_intersect("ha", "hb")))
                  .select("a", "b", "na", "nb", (F.col("common") + F.col("here")).alias("common"),
                          (F.col("only_a") + F.size("ha") - F.col("here")).alias("only_a"),
                          (F.col("only_b") + F.size("hb") - F.col("here")).alias("only_b"))
                  .where((F.col("only_a") <= F.col("na") - least) & (F.col("only_b") <= F.col("nb") - least)))
    return so_far.drop("only_a", "only_b")


def _linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def with_group(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Join members (grp, rid, group_size, ...) with a table of one row for
    each value of ``keys``, which begin with grp and its group_size. A table of
    ``few`` rows is broadcast. Else the members of a group are salted into
    shares of about ``SHARE`` and its row is repeated once for each share, so
    that no task gets a large group whole."""
    if few:
        return rows.join(F.broadcast(one), keys, how)
    shares = F.ceil(F.col("group_size") / SHARE).cast("int")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), shares).cast("int"))
    repeated = one.withColumn("salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    return salted.join(repeated, [*keys, "salt"], how).drop("salt")


def groups_of(crowded: DataFrame) -> DataFrame:
    """(grp, rid, n): members of large buckets (grp, e, rid, n) by group. A
    bucket goes to its member that is in the most large buckets, so that the
    buckets of one cluster mostly become one group."""
    # a set's buckets are fewer than its elements: a list, not a join
    rows = (crowded.groupBy("rid").agg(F.first("n").alias("n"), F.collect_list(F.struct("grp", "e")).alias("at"))
            .select("rid", "n", F.size("at").alias("seen"), F.inline("at")))
    lead = rows.groupBy("grp", "e").agg(F.max(F.struct(F.col("seen"), (-F.col("rid")).alias("low"))).alias("lead"))
    return (rows.join(lead, ["grp", "e"]).groupBy((-F.col("lead.low")).alias("grp"), "rid")
            .agg(F.first("n").alias("n")))


def without_repeats(crowded: DataFrame) -> DataFrame:
    """(grp, rid, n, group_size, who): ``who`` is alike for members of a group
    that are together in a larger one, which is the largest of each, and need
    not meet here. Groups where nobody need meet are left out."""
    sizes = crowded.groupBy("grp").agg(F.count("*").alias("group_size"))
    largest = F.max(F.struct("group_size", "grp")).over(Window.partitionBy("rid"))["grp"]
    members = (crowded.join(sizes, "grp").withColumn("largest", largest)
               # rids are not negative
               .withColumn("who", F.when(F.col("largest") == F.col("grp"), F.col("rid")).otherwise(F.bitwise_not("largest"))))
    some = members.groupBy("grp").agg(F.min("who").alias("low"), F.max("who").alias("high")).where("low < high")
    return members.join(some.select("grp"), "grp", "left_semi").drop("largest")


def shared_elements(heads: DataFrame) -> DataFrame:
    """(grp, rid, e): of the heads (grp, rid, who, slices, head), the elements
    that members of a group with another ``who`` hold too. A task first looks
    among its own members; of what they share it passes on the element alone,
    so that a frequent one isn't gathered. The rest meets by group and slice."""
    def met(e, rid, who):
        """In the order of elements, and whether two of an element's holders differ."""
        order = np.lexsort((who, e))
        e, rid, who = e[order], rid[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(e))
        differ = who[first] != who[ends - 1] if len(e) else np.zeros(0, bool)
        return e, rid, who, first, np.repeat(differ, ends - first)

    def block(key, rows):
        grp, slices = key
        rids, whos, sets = zip(*rows)
        sizes = [len(x) for x in sets]
        e, rid, who, first, known = met(np.concatenate(sets), np.repeat(rids, sizes), np.repeat(whos, sizes))
        out = [(-1 - rids[0] % SLICE, e[known], rid[known], who[:0])]       # a place that doesn't depend on e
        # of a known element one entry without a holder
        stay = ~known
        stay[first] = True
        e, rid, who = e[stay], np.where(known[stay], -1, rid[stay]), who[stay]
        at = e % slices
        order = np.argsort(at, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(at[order])) + 1), len(at)]
        out += [(at[i[0]], e[i], rid[i], who[i]) for i in (order[x:y] for x, y in zip(cuts, cuts[1:])) if len(i)]
        out = [x for x in out if len(x[1])]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                 *(_lists([x[i] for x in out]) for i in (1, 2, 3))], names=["grp", "slice", "e", "rid", "who"])

    def blocks(batches):
        held: dict = {}
        for b in batches:
            sets = b.column("head")
            for i, (grp, slices, rid, who) in enumerate(C.rows_of([b], "grp", "slices", "rid", "who")):
                mine = held.setdefault((grp, slices), [])
                mine.append((rid, who, sets[i].values.to_numpy(zero_copy_only=False)))
                if len(mine) >= SHARE:
                    yield from block((grp, slices), held.pop((grp, slices)))
        for key, rows in held.items():
            yield from block(key, rows)

    def record(grp, e, rid):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(e), grp), pa.int64()), pa.array(rid, pa.int64()),
                                           pa.array(e, pa.int64())], names=["grp", "rid", "e"])

    def meet(batches):
        held: dict = {}
        for b in batches:
            lists = [b.column(c) for c in ("e", "rid", "who")]
            for i, (grp, at) in enumerate(C.rows_of([b], "grp", "slice")):
                row = [x[i].values.to_numpy(zero_copy_only=False) for x in lists]
                if at < 0:
                    yield record(grp, *row[:2])
                else:
                    held.setdefault((grp, at), []).append(row)
        for (grp, _), rows in held.items():
            e, rid, who, first, known = met(*(np.concatenate(x) for x in zip(*rows)))
            if len(e):
                known |= np.repeat(np.logical_or.reduceat(rid < 0, first), np.diff([*first, len(e)]))
                yield record(grp, e[known & (rid >= 0)], rid[known & (rid >= 0)])

    C.ship_package(heads.sparkSession)
    packed = heads.select("grp", "rid", "who", "slices", "head").mapInArrow(
        blocks, "grp bigint, slice bigint, e array<bigint>, rid array<bigint>, who array<bigint>")
    return packed.repartition("grp", "slice").mapInArrow(meet, "grp bigint, rid bigint, e bigint")


def cores(members: DataFrame, fragments: DataFrame, block: int = 64) -> DataFrame:
    """(grp, group_size, fragment, core): in each fragment, the elements that more than
    half of a group hold. ``members`` is (grp, rid, group_size). Members are
    counted in blocks of about ``block``; an element that half of a block
    doesn't hold counts as absent there, so that what moves on is a row for
    each block and common element, and none for the many that few hold. (Any
    core gives right links; a good one gives small differences.)"""
    def run(batches):
        held: dict = {}
        for b in batches:
            hashes = b.column("hashes")
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in ("grp", "salt", "fragment", "group_size")))):
                held.setdefault(key, []).append(hashes[i].values.to_numpy(zero_copy_only=False))
                if len(held[key]) >= 8 * block:
                    yield common(key, held.pop(key))
        for key, sets in held.items():
            yield common(key, sets)

    def common(key, sets):
        e, n = np.unique(np.concatenate(sets), return_counts=True)
        e, n = e[2 * n > len(sets)], n[2 * n > len(sets)]
        grp, _, fragment, size = key
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(e), grp), pa.int64()), pa.array(np.full(len(e), fragment), pa.int32()),
             pa.array(np.full(len(e), size), pa.int64()), pa.array(e, pa.int64()), pa.array(n, pa.int64())],
            names=["grp", "fragment", "group_size", "e", "n"])

    salt = F.pmod(F.xxhash64("rid"), F.ceil(F.col("group_size") / block))
    rows = (members.withColumn("salt", salt).join(fragments, "rid")
            .select("grp", "salt", "fragment", "group_size", "hashes").repartition("grp", "salt", "fragment"))
    counts = rows.mapInArrow(run, "grp bigint, fragment int, group_size bigint, e bigint, n bigint")
    return (counts.groupBy("grp", "fragment", "group_size", "e").agg(F.sum("n").alias("n"))
            .where("2 * n > group_size").groupBy("grp", "group_size", "fragment")
            .agg(F.sort_array(F.collect_list("e")).alias("core")))


def differences(members: DataFrame, fragments: DataFrame, percent: int, name: str, broadcast_rows: int) -> DataFrame:
    """(grp, group_size, rid, n, who, slack, diff): of each member, its difference to
    the group's core and its slack, in units of 1 / (2 * (100 + percent))
    elements: two members share enough without their differences if their
    slacks add up to 0 or more, and lack that many shared elements if not."""
    spark = members.sparkSession
    core = C.cut_lineage(cores(members, fragments), spark, f"{name}-cores")
    few = (core.agg(F.sum(F.size("core") + 1)).first()[0] or 0) <= broadcast_rows
    size = core.groupBy("grp").agg(F.sum(F.size("core")).alias("core_size"))
    core = core.join(size, "grp")
    none = F.array().cast("array<bigint>")
    q = 100 + percent
    parts = (with_group(members.join(fragments, "rid"), core, ["grp", "group_size", "fragment"], "left", few)
             .withColumn("core", F.coalesce("core", none))
             .select("grp", "group_size", "rid", "n", "who", "core_size", F.size(F.array_intersect("hashes", "core")).alias("common"),
                     F.array_except("hashes", "core").alias("more"),
                     # what is lacking is told from what is there by its bits turned over
                     F.transform(F.array_except("core", "hashes"), lambda x: F.bitwise_not(x)).alias("less")))
    # as many entries as fragments
    return (parts.groupBy("grp", "group_size", "rid", "n", "who").agg(
        F.sum("common").alias("common"), F.max("core_size").alias("core_size"),
        F.flatten(F.collect_list(F.concat("more", "less"))).alias("diff"))
        .select("grp", "group_size", "rid", "n", "who", "diff",
                (2 * q * F.col("common") - 2 * percent * F.col("n") - q * F.coalesce("core_size", F.lit(0)))
                .cast("long").alias("slack")))


def links(sets: DataFrame, of: DataFrame, pieces, percent: int, small: int = 64, small_in_group: int = 512,
          rounds: int = 4, spare: int = 10, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(a, b): links between distinct sets that give the same components as
    all links do. ``sets`` is (rid, n, head), ``of`` the rids to look at,
    one for each distinct set; ``pieces`` gives (rid, fragment, hashes) of the
    rids in a table. Only heads are dealt out, no whole sets."""
    spark = sets.sparkSession
    n = F.col("n")
    least = F.greatest(F.lit(1), F.floor(_need(n, percent) / spare))
    # copies are few, or else heads are dealt out by rid to leave them out
    copies = sets.where("n > 0").select("rid").join(of, "rid", "left_anti")
    n_copies = sets.where("n > 0").count() - of.count()
    heads = sets.where("n > 0").select("rid", "n", "head")
    heads = (heads.join(F.broadcast(copies), "rid", "left_anti") if n_copies <= broadcast_rows
             else heads.join(of, "rid", "left_semi"))
    rows = heads.select("rid", "n", F.explode("head").alias("e"))
    known = rows.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    of_set = Window.partitionBy("rid")
    index = (rows.join(known, "e")
             .withColumn("shared", F.count("*").over(of_set))
             .withColumn("rank", F.row_number().over(of_set.orderBy("df", "e")))
             .where((F.col("shared") >= least) & (F.col("rank") <= F.col("shared") - least + 1))
             .select(F.lit(0).cast("long").alias("grp"), "e", "rid", "n", F.col("rid").alias("who"), F.lit(True).alias("open"),
                     F.lit(0).cast("long").alias("slack"), F.lit(0).cast("long").alias("shared")))
    index = C.cut_lineage(index, spark, "join-index")
    fragments = pieces(C.cut_lineage(index.select("rid").distinct(), spark, "join-stay"))

    found, asked_pairs = [], []
    for turn in range(rounds):
        most = small if turn == 0 else small_in_group
        buckets = (index.groupBy("grp", "e").agg(F.count("*").alias("size"), F.max("open").alias("any_open"))
                   .where("size > 1 AND any_open"))
        crowded = (C.cut_lineage(groups_of(index.join(buckets.where(F.col("size") > most), ["grp", "e"])),
                                 spark, "join-crowded") if turn < rounds - 1 else None)
        last = crowded is None or crowded.isEmpty()
        if not last:
            buckets = buckets.where(F.col("size") <= most)
        some = index.join(buckets.select("grp", "e"), ["grp", "e"])
        a = some.select("grp", "e", *[F.col(c).alias(f"{c}_a") for c in ("rid", "n", "who", "open", "slack", "shared")])
        b = some.select(*[F.col(c).alias(f"{c}_b") for c in ("grp", "e", "rid", "n", "who", "open", "slack", "shared")])
        pairs = (a.join(b, (F.col("grp") == F.col("grp_b")) & (F.col("e") == F.col("e_b"))
                        & (F.col("rid_a") < F.col("rid_b")) & _likely(F.col("n_a"), F.col("n_b"), percent)
                        & (F.col("open_a") | F.col("open_b")) & (F.col("who_a") != F.col("who_b"))
                        # as many shared elements of the differences as they lack
                        & (2 * (100 + percent) * F.least("shared_a", "shared_b") + F.col("slack_a") + F.col("slack_b") >= 0))
                 .groupBy(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))
                 .agg(F.first("n_a").alias("na"), F.first("n_b").alias("nb")))
        asked_pairs.append(C.cut_lineage(pairs, spark, "join-pairs"))
        if last:
            break
        few = 100 * crowded.select("grp").distinct().count() <= broadcast_rows      # a group's levels are some rows' worth
        near = C.cut_lineage(differences(without_repeats(crowded), fragments, percent, "join", broadcast_rows),
                             spark, "join-near")
        of_group = ["grp", "group_size"]
        best = near.groupBy(of_group).agg(F.max(F.struct("slack", "rid")).alias("best"))
        near = with_group(near, best, of_group, few=few).withColumn("open", F.col("slack") + F.col("best.slack") < 0)
        closed = near.where((~F.col("open")) & (F.col("rid") != F.col("best.rid")))
        found.append(closed.select(F.least("rid", "best.rid").alias("a"), F.greatest("rid", "best.rid").alias("b")))
        # y can share as many elements with x as they lack only if its
        # difference is that large; of those partners the nearest to the core
        # says what x lacks at least. Partners of closed members are open.
        unit = 2 * (100 + percent)
        levels = (near.groupBy(*of_group, F.floor((F.size("diff") * unit + F.col("slack")) / unit).alias("level"), "open")
                  .agg(F.max("slack").alias("slack"))
                  .groupBy(of_group).agg(F.collect_list(F.struct("level", "open", "slack")).alias("levels")))
        partner = F.array_max(F.transform(
            F.filter("levels", lambda y: (y["level"] >= F.floor(-F.col("slack") / unit)) & (F.col("open") | y["open"])),
            lambda y: y["slack"]))
        asked = (with_group(near, levels, of_group, few=few)
                 .withColumn("lacks", F.ceil(-(F.col("slack") + partner) / F.lit(unit)).cast("int"))
                 .where("size(diff) >= lacks"))
        # heads of the differences, in the order of hashes, as in step 2
        spared = asked.groupBy(of_group).agg(
            F.least(F.min("lacks"), F.lit(4)).alias("spared"),
            F.ceil((F.sum(F.size("diff") - F.col("lacks")) + 1) / SLICE).cast("long").alias("slices"))
        asked = C.cut_lineage(
            with_group(asked, spared, of_group, few=few)
            .select("grp", "rid", "n", "who", "open", "slack", "lacks", "spared", "slices",
                    F.slice(F.array_sort("diff"), 1, F.size("diff") - F.col("lacks") + F.col("spared")).alias("head")),
            spark, "join-heads")
        with C.small_batches(spark):
            held = C.cut_lineage(shared_elements(asked), spark, "join-shared")
        known = held.groupBy("grp", "e").agg(F.count("*").alias("df"))
        of_set = Window.partitionBy("grp", "rid")
        index = C.cut_lineage(
            held.join(known, ["grp", "e"]).join(asked.drop("head", "slices"), ["grp", "rid"])
            .withColumn("shared", F.count("*").over(of_set))
            .withColumn("rank", F.row_number().over(of_set.orderBy("df", "e")))
            .where("shared >= spared AND rank <= shared - spared + 1")
            # at most: all elements behind the head may be shared
            .select("grp", "e", "rid", "n", "who", "open", "slack",
                    (F.col("shared") + F.col("lacks") - F.col("spared")).alias("shared")), spark, "join-index")
    # the sets of all rounds' pairs are dealt out once; several rounds may ask for a pair
    pairs = functools.reduce(DataFrame.unionByName, asked_pairs).dropDuplicates(["a", "b"])
    pairs = C.cut_lineage(near_by_parity(pairs, fragments, percent, broadcast_rows), spark, "join-near-pairs")
    linked = (overlaps(pairs, fragments, percent)
              .where(_linked(F.col("common"), F.col("na"), F.col("nb"), percent)).select("a", "b"))
    return functools.reduce(DataFrame.unionByName, found, linked).distinct()


def components(pairs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(v, c): for each end of the links (a, b), the smallest v of its
    component. Smallest label of the neighbours, then the label's label, until
    nothing changes; every round is a written table. Labels are broadcast if
    there are few."""
    spark = pairs.sparkSession
    edges = C.cut_lineage(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")),
                                                         F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x"))
                          .select("x.v", "x.u"), spark, "cc-edges")
    now = C.cut_lineage(edges.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c")), spark, "cc")
    few = F.broadcast if now.count() <= broadcast_rows else lambda df: df
    while True:
        # an end's own label counts with those of its neighbours
        seen = (edges.join(few(now.select(F.col("v").alias("u"), F.col("c").alias("m"))), "u")
                .select("v", "m", F.lit(None).cast("long").alias("c"))
                .unionByName(now.select("v", F.col("c").alias("m"), "c")))
        low = seen.groupBy("v").agg(F.max("c").alias("c"), F.min("m").alias("m"))
        up = few(now.select(F.col("v").alias("m"), F.col("c").alias("mm")))
        new = C.cut_lineage(low.join(up, "m").select("v", F.least("m", "mm").alias("c"),
                                                     (F.least("m", "mm") != F.col("c")).alias("moved")), spark, "cc")
        if new.where("moved").isEmpty():
            return new.select("v", "c")
        now = new.select("v", "c")


def pieces_of(docs: DataFrame, words: int, same: DataFrame, broadcast_rows: int):
    """For ``links``: the second pass over ``docs`` (doc_id, text, mark), which
    shingles one row again of each set (key, rid, row) of ``same`` that is asked
    for. A row is told by its id and its text's hash, and the set by its key."""
    spark = docs.sparkSession
    names = [f"f{i}" for i in range(FRAGMENTS)]

    def pieces(rids: DataFrame) -> DataFrame:
        wanted = rids.count()
        few = F.broadcast if wanted <= broadcast_rows else lambda df: df
        # a row of this is some times as long as an id
        few_rows = F.broadcast if 4 * wanted <= broadcast_rows else lambda df: df
        of = same.join(few(rids), "rid", "left_semi").select(
            "rid", F.col("key").alias("of"), F.col("row.mark").alias("of_mark"), F.col("row.doc_id").alias("of_id"))
        texts = docs.join(few_rows(of), (F.col("mark") == F.col("of_mark")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
        with C.small_batches(spark):
            out = C.cut_lineage(
                shingle_sets(texts.select("rid", "of", "text"), words).where("key = of")
                .withColumn("nth", F.monotonically_increasing_id())
                .select("rid", "nth", F.posexplode(F.array(*names)).alias("fragment", "hashes")), spark, "join-fragments")
        ones = out.where("fragment = 0").groupBy("rid").agg(F.min("nth").alias("nth"), F.count("*").alias("rows"))
        got, rows = ones.agg(F.count("*"), F.sum("rows")).first()
        if got != wanted:
            raise RuntimeError(f"{wanted - got} of {wanted} texts were not found again: the input changed between two reads")
        if wanted and rows > wanted:        # rows that repeat, id and text: one of them
            out = C.cut_lineage(out.join(few(ones.select("rid", "nth")), ["rid", "nth"], "left_semi"), spark, "join-fragments")
        return out.drop("nth")

    return pieces


def groups(docs: DataFrame, words: int, percent: int, spare: int = 10, broadcast_rows: int = 1_000_000,
           **options) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): the rows of ``docs`` (doc_id, text bytes) with the hash of
    their text (mark) and the key of their set, and of each key its component
    c. ``docs`` is read twice."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("mark"))
    with C.small_batches(spark):
        rows = C.cut_lineage(shingle_sets(docs, words, (percent, spare))
                             .withColumn("rid", F.monotonically_increasing_id()), spark, "join-sets")
    same = C.cut_lineage(rows.where("key IS NOT NULL").groupBy("key")
                         .agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_doc"),
                              F.min(F.struct("mark", "doc_id")).alias("row")), spark, "join-same")
    found = links(rows.select("rid", "n", "head"), same.select("rid"), pieces_of(docs, words, same, broadcast_rows),
                  percent, spare=spare, broadcast_rows=broadcast_rows, **options)
    whole = components(found, broadcast_rows)
    return rows.drop("head"), (same.drop("row").join(whole.withColumnRenamed("v", "rid"), "rid", "left")
                               .withColumn("c", F.coalesce("c", "rid")))


def linked_groups(docs: DataFrame, words: int = 5, percent: int = 80, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs``
    (doc_id, text bytes); ``options`` go to ``links``."""
    rows, sets = groups(docs.select("doc_id", "text"), words, percent, **options)
    first = sets.groupBy("c").agg(F.min("first_doc").alias("component_id"))
    of_key = sets.join(first, "c").select("key", "component_id")
    return (rows.select("doc_id", "n", "key").join(of_key, "key", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, others), one of each group: the one
    with the smallest id (a null id comes last), one of several alike. Rows
    without a word all stay. Texts aren't dealt out if the rows to drop are
    few enough to broadcast."""
    spark = docs.sparkSession
    rows, sets = groups(C.id_and_bytes(docs), words, percent, broadcast_rows=broadcast_rows, **options)
    each = (rows.where("key IS NOT NULL").join(sets.select("key", "c"), "key")
            .groupBy("c", "doc_id", "mark").agg(F.count("*").alias("rows")))
    first = each.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("lead"))
    judged = each.join(first, "c").select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__of"), "rows",
        (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("mark") == F.col("lead.mark"))).alias("__stays"))
    verdict = C.cut_lineage(judged.where("NOT __stays OR rows > 1").drop("rows"), spark, "join-verdict")
    if verdict.count() <= broadcast_rows:
        verdict = F.broadcast(verdict)
    heard = docs.withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        verdict, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__of")), "left")
    out = heard.where("__stays IS NULL").select(docs.columns)
    if not verdict.where("__stays").isEmpty():          # rows that repeat, id and text: one of them
        alike = Window.partitionBy("doc_id", "__mark").orderBy("__mark")
        out = out.unionByName(heard.where("__stays").withColumn("__nth", F.row_number().over(alike))
                              .where("__nth = 1").select(docs.columns))
    return out


def op5_fragment_join(spark, sf_dir: str) -> DataFrame:
    """Link all documents by 3-word shingles at 90 percent."""
    return linked_groups(C.id_and_bytes(C.table(spark, sf_dir, "documents")), words=3, percent=90)
