"""Exact Jaccard links between documents by word n-grams, and their components.

Sets of n-gram fingerprints are ordered by one global order, rare n-grams first.
Two sets that link share n-grams among their first few, so only those prefixes go
into the index lists.  Equal sets are one class throughout.  Three things keep
the work small without losing a link:

* lists are cut into blocks by set size, a set probes its own block and the ones
  beside it, and a pair is skipped at any place where the positions of the shared
  n-gram leave too little overlap;
* in a star round one set of each list is compared with the others, and those that
  link follow it.  It is the set with the largest part of its prefix in lists, as edits
  make n-grams of their own: the set in the middle of its copies.  A leader's answers hold
  for its followers: by the triangle inequality of the Jaccard distance a follower is only
  compared with sets near enough to its leader;
* two sets that link share some number of n-grams of their prefixes, and all of these are in
  lists that are still open.  So they meet in one that is early enough among the open
  lists of both, and a set whose n-grams are mostly its own meets nobody.
* pairs that are already connected are never compared, as only components are
  asked for, so a group of near copies costs one comparison per member.

What the star round leaves open goes through probe rounds.  A round picks sets,
of every list sixteen times as many at most as the round before, and compares each with
every set of another component that can share enough of its prefix.  A set that has probed
has all its answers and leaves the lists; lists of one component leave as a whole.
The rounds end when no list is left, so every pair is answered, by a comparison, by a
leader or by a connection, and rounds grow with the logarithm of the longest list.

The order counts every n-gram of every text in ``ORDER_SLOTS`` hash slots, and n-grams
of full slots move to the end.  Any order gives the same links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtrack.llm.kernels import in_tasks
from gridtrack.llm.skew import join_groups
from gridtrack.llm.words import mix, shingles, text_slices, words_of
from gridtrack.operators.components import components
from gridtrack.session import extend_stage, stage, stage_scope, unstage

WIDTH = 4
SHARE, WHOLE = 85, 100
ORDER_SLOTS = 1 << 22
ORDER_PARTS = 64
SLOTS = 1 << 21
SLICE_BYTES = 1 << 19
MORE_CENTRES = 16
HAS_WORD = r"[^\x20\x09-\x0D]"

COUNTS = "part int, counts binary"
SETS = "doc_id bigint, text_hash bigint, n int, set_id bigint, prefix array<bigint>"
TOKENS = "set_id bigint, tokens array<bigint>"


# --- sets, in the tasks ----------------------------------------------------------------------

def token_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and fingerprint of the distinct n-grams of every text, in ascending order."""
    token, row = shingles(words_of(texts), width)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    fresh = np.r_[True, (np.diff(row) != 0) | (token[1:] != token[:-1])][:token.size]
    return row[fresh], token[fresh]


def set_ids(row: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
    """A fingerprint of every set, the same for equal sets."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    out = np.zeros(rows, dtype=np.uint64)
    full = np.diff(bounds) > 0
    if full.any():
        starts = bounds[:-1][full]
        with np.errstate(over="ignore"):
            a = np.add.reduceat(mix(token), starts)
            b = np.add.reduceat(mix(token ^ np.uint64(0x6A09E667F3BCC909)), starts)
            out[full] = mix(a * np.uint64(0x9E3779B97F4A7C15) + b + np.diff(bounds)[full].astype(np.uint64))
    return out.view(np.int64)


def _slot(token: np.ndarray) -> np.ndarray:
    return (mix(token) >> np.uint64(64 - (ORDER_SLOTS.bit_length() - 1))).astype(np.int64)


def _packed(part: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
    rows = [zlib.compress(c.astype("<u8").tobytes(), 1) for c in counts]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), dtype="<u8")


def _count(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_SLOTS, dtype=np.uint32)
        for batch in batches:
            texts = batch.column(0)
            for s, e in text_slices(texts, SLICE_BYTES):
                np.add.at(total, _slot(token_sets(texts.slice(s, e - s), width)[1]), np.uint32(1))
        if total.any():
            yield _packed(np.arange(ORDER_PARTS), np.split(total, ORDER_PARTS))

    return count


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[part] = total.get(part, 0) + _unpacked(counts.as_py())
    if total:
        yield _packed(np.array(list(total)), list(total.values()))


def slot_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many n-grams of all sets fall into each slot, rounded to single precision, which keeps their order."""
    packed = in_tasks(texts, _count(width), COUNTS).repartition(ORDER_PARTS, "part")
    found = in_tasks(packed, _add, COUNTS).toArrow()
    out = np.zeros((ORDER_PARTS, ORDER_SLOTS // ORDER_PARTS), dtype=np.float32)
    for part, counts in zip(found.column("part").to_pylist(), found.column("counts"), strict=True):
        out[part] = _unpacked(counts.as_py())
    return out.ravel()


def prefix_length(n: np.ndarray, share: int) -> np.ndarray:
    """How many of a set's first tokens any linked set must share one of."""
    return n - (share * n + WHOLE - 1) // WHOLE + 1


def _build(often: Broadcast, width: int, share: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in text_slices(batch.column(2), SLICE_BYTES):
                row, token = token_sets(batch.column(2).slice(s, e - s), width)
                ids = set_ids(row, token, e - s)
                order = np.lexsort((often.value[_slot(token)], row))
                bounds = np.searchsorted(row, np.arange(e - s + 1))
                n = np.diff(bounds)
                place = np.arange(token.size) - bounds[row]
                head = place < prefix_length(n, share)[row]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(np.bincount(row[head], minlength=e - s))].astype(np.int32)),
                    pa.array(token[order][head].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), pa.array(n.astype(np.int32)), pa.array(ids), lists],
                    names=["doc_id", "text_hash", "n", "set_id", "prefix"])

    return build


def _whole(width: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in text_slices(batch.column(0), SLICE_BYTES):
                row, token = token_sets(batch.column(0).slice(s, e - s), width)
                bounds = np.searchsorted(row, np.arange(e - s + 1)).astype(np.int32)
                ids = set_ids(row, token, e - s)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(token.view(np.int64)))
                once = pa.array(np.unique(ids, return_index=True)[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids).take(once), lists.take(once)], names=["set_id", "tokens"])

    return whole


# --- index lists -----------------------------------------------------------------------------

def size_block(n: Column, share: int) -> Column:
    """Linked sets are in the same block or in neighbours, as a block is a little wider than the size ratio of a link."""
    return F.floor(F.log(n.cast("double")) / (-math.log(share / WHOLE) * 1.001)).cast("int")


def needed(a: Column, b: Column, share: int) -> Column:
    """Overlap that sets of sizes ``a`` and ``b`` need to link."""
    return F.ceil((a + b) * F.lit(share) / F.lit(WHOLE + share))


def kept_whole(n: Column, share: int) -> Column:
    """Tokens of a set behind its prefix."""
    return F.ceil(n * F.lit(share) / F.lit(WHOLE)) - 1


def index_lists(classes: DataFrame) -> DataFrame:
    """``(token, n_list, set_id, n, pos)`` of all lists with at least two sets."""
    rows = classes.select("set_id", "n", F.posexplode("prefix").alias("pos", "token"))
    counts = stage(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n_list")).where("n_list > 1"), "jaccard-tokens")
    total = classes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    return stage(join_groups(rows, counts, ["token"], "n_list", total), "jaccard-lists")


class WholeSets:
    """The sets of the pairs that are compared, built again from their texts.

    Only texts that are asked for are tokenized again.  They are picked by their
    hash: first by a broadcast of hash slots, of which there are ``SLOTS`` at most,
    then exactly, so few other texts are shuffled.
    """

    def __init__(self, rows: DataFrame, classes: DataFrame, width: int) -> None:
        self.rows, self.classes, self.width = rows.select("text_hash", "text"), classes, width
        self.tokens: DataFrame | None = None

    def compare(self, pairs: DataFrame) -> DataFrame:
        """``pairs(a, b, ...)`` with the ``overlap`` and ``union_size`` of their sets."""
        pairs = stage(pairs, "jaccard-pairs")
        if pairs.isEmpty():
            return pairs.withColumn("overlap", F.lit(0)).withColumn("union_size", F.lit(1))
        sets = stage(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "jaccard-asked")
        # the table also holds the sets of earlier rounds, which no join needs to move
        tokens = self._of(sets).join(sets, "set_id", "left_semi")
        left = tokens.select(F.col("set_id").alias("a"), F.col("tokens").alias("tokens_a"))
        right = tokens.select(F.col("set_id").alias("b"), F.col("tokens").alias("tokens_b"))
        both = pairs.join(left, "a").join(right, "b")
        overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
        counted = both.withColumn("overlap", overlap).withColumn(
            "union_size", F.size("tokens_a") + F.size("tokens_b") - F.col("overlap"))
        return counted.drop("tokens_a", "tokens_b")

    def _of(self, sets: DataFrame) -> DataFrame:
        missing = sets if self.tokens is None else sets.join(self.tokens.select("set_id"), "set_id", "left_anti")
        wanted = stage(self.classes.select("set_id", "text_hash").join(missing, "set_id").select("text_hash"), "jaccard-wanted")
        if self.tokens is None or not wanted.isEmpty():
            slot = F.pmod("text_hash", F.lit(SLOTS)).cast("int").alias("slot")
            near = self.rows.withColumn("slot", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi")
            texts = near.join(wanted, "text_hash", "left_semi").select("text")
            fresh = in_tasks(texts, _whole(self.width), TOKENS).dropDuplicates(["set_id"])
            # one table for all rounds: a union of their tables makes ever larger plans
            self.tokens = stage(fresh, "jaccard-whole") if self.tokens is None else extend_stage(self.tokens, fresh)
        return self.tokens


def linked(share: int) -> Column:
    return F.col("overlap") * WHOLE >= F.col("union_size") * share


def distance() -> Column:
    return 1 - F.col("overlap") / F.col("union_size")


def far(share: int) -> float:
    return 1 - share / WHOLE + 1e-9


def shared_least(share: int) -> Column:
    """Prefix tokens that two linked sets share at least: all others of the overlap lie behind the prefix of one of the two."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return needed(n_a, n_b, share) - F.greatest(kept_whole(n_a, share), kept_whole(n_b, share))


def links(lists: DataFrame, whole: WholeSets, share: int) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all links."""
    # the star round: one set of every list is compared with the others
    own = Window.partitionBy("set_id")
    in_lists = F.count(F.lit(1)).over(own) / (F.col("n") - kept_whole(F.col("n"), share))
    open_ = stage(lists.withColumn("block", size_block(F.col("n"), share)).withColumn("root", F.col("set_id")).withColumn(
        "in_lists", in_lists), "jaccard-open")
    centre = open_.groupBy("token", "block").agg(
        F.min(F.struct((-F.col("in_lists")).alias("order"), F.xxhash64("set_id").alias("hash"), "set_id", "n")).alias("centre"))
    stars = open_.drop("in_lists").join(centre, ["token", "block"]).where("centre.set_id <> set_id").select(
        F.col("centre.set_id").alias("a"), F.col("set_id").alias("b"), F.col("centre.n").alias("n_a"), F.col("n").alias("n_b"))
    tried = stars.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= shared_least(share))
    star = stage(whole.compare(tried.select("a", "b")).where(linked(share)).select("a", "b", distance().alias("radius")), "jaccard-stars")
    # a set follows one of the centres that it linked with
    lead = star.groupBy(F.col("b").alias("set_id")).agg(F.min(F.struct("a", "radius")).alias("lead"))
    open_ = _open(_rooted(open_.drop("in_lists"), star)).join(lead, "set_id", "left").select(
        "token", "block", "set_id", "n", "pos", "root", F.coalesce("lead.a", "set_id").alias("leader"),
        F.coalesce("lead.radius", F.lit(0.0)).alias("radius"))
    open_, found = stage(open_, "jaccard-members"), [star.select("a", "b")]
    centres = 1
    while not open_.isEmpty():
        with stage_scope() as made:
            before = open_
            new, answers, open_ = _probe(before, whole, centres, share)
        unstage(before, *made, keep=(new, answers, open_, *([] if whole.tokens is None else [whole.tokens])))
        found += [new, answers.where("link").select("a", F.col("leader_b").alias("b"))]
        centres *= MORE_CENTRES
    return reduce(DataFrame.unionByName, found)


def _probe(open_: DataFrame, whole: WholeSets, centres: int, share: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of up to ``centres`` sets of every list, answers of leaders, and the lists without these sets.

    Sets fall into as many cells as there are centres, and a set probes if it comes
    first of its cell in all of its lists.  So no list has two of one cell, though a
    set that probes does so in all of its lists, and the first set of a cell always does.
    """
    cell = F.pmod(F.xxhash64("set_id", F.lit(centres)), F.lit(centres)).alias("cell")
    first = open_.groupBy("token", "block", cell).agg(F.min(F.struct(F.xxhash64("set_id").alias("order"), "set_id")).alias("first"))
    wins = first.groupBy(F.col("first.set_id").alias("set_id")).agg(F.count(F.lit(1)).alias("wins"))
    places = open_.groupBy("set_id").agg(F.count(F.lit(1)).alias("places"))
    picked = stage(places.join(wins, "set_id").where("wins = places").select("set_id"), "jaccard-centres")
    # of a set's lists that are open: those behind this one
    behind = F.count(F.lit(1)).over(Window.partitionBy("set_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = stage(open_.join(picked.withColumn("picked", F.lit(True)), "set_id", "left").withColumn(
        "picked", F.coalesce("picked", F.lit(False))).withColumn("behind", behind), "jaccard-picked")
    columns = ("set_id", "n", "pos", "root", "leader", "radius", "picked", "behind")
    ours = rows.where("picked").select(
        "token", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), *[F.col(c).alias(f"{c}_a") for c in columns])
    theirs = rows.select("token", "block", *[F.col(c).alias(f"{c}_b") for c in columns])
    # every list that both are in is still open, as their components differ: the first of
    # those that linked sets share has all the others behind it in both
    met = ours.join(theirs, ["token", "block"]).where(
        (F.col("root_a") != F.col("root_b"))
        # two that probe meet once
        & (~F.col("picked_b") | (F.col("set_id_a") < F.col("set_id_b")))
        & (F.col("n_a") * WHOLE >= F.col("n_b") * share) & (F.col("n_b") * WHOLE >= F.col("n_a") * share)
        & (F.least("behind_a", "behind_b") + 1 >= shared_least(share))
        & fits("n_a", "pos_a", "n_b", "pos_b", share))
    tried = stage(met.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"), "leader_b", "radius_b").distinct(), "jaccard-tried")

    # a leader is asked first where several of its followers are to be compared
    asked = tried.groupBy("a", F.col("leader_b").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    answers = stage(whole.compare(asked).select(
        "a", F.col("b").alias("leader_b"), linked(share).alias("link"), distance().alias("apart")), "jaccard-answers")
    known = tried.join(answers, ["a", "leader_b"], "left")
    left = known.where(F.col("link").isNull() | (
        ~F.col("link") & (F.col("b") != F.col("leader_b")) & (F.col("apart") <= F.col("radius_b") + far(share))))
    new = stage(whole.compare(left.select("a", "b")).where(linked(share)).select("a", "b"), "jaccard-probed")
    through = known.where("link").select("a", "b")
    rest = _open(_rooted(rows, new.unionByName(through)).where("not picked").drop("picked", "behind"))
    return new, answers, rest


def _rooted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` with the roots that follow from new links between their sets."""
    roots = rows.select("set_id", "root").distinct()
    joined = new.join(roots.select(F.col("set_id").alias("a"), F.col("root").alias("root_a")), "a").join(
        roots.select(F.col("set_id").alias("b"), F.col("root").alias("root_b")), "b")
    pairs = joined.where("root_a <> root_b").select(F.lit(0).cast("long").alias("scope"), F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    pairs = stage(pairs.distinct(), "jaccard-roots")
    if pairs.isEmpty():
        return rows
    merged = components(pairs).select(F.col("node").alias("root"), F.col("root").alias("merged"))
    return rows.join(merged, "root", "left").withColumn("root", F.coalesce("merged", "root")).drop("merged")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the lists that still hold sets of different components."""
    rows = stage(rows, "jaccard-rooted")
    mixed = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    return stage(rows.join(mixed, "token"), "jaccard-open")


def fits(n_a: str, pos_a: str, n_b: str, pos_b: str, share: int) -> Column:
    """The positions of a shared token leave room for the overlap."""
    a, i, b, j = (F.col(c) for c in (n_a, pos_a, n_b, pos_b))
    return F.least(i, j) + 1 + F.least(a - i - 1, b - j - 1) >= needed(a, b, share)


# --- the operator ----------------------------------------------------------------------------

def similar_groups(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, group_id, component_id)`` for every row of ``docs(doc_id, text)``.

    Two documents link when their distinct ``width``-word n-grams agree in ``share`` of
    100 of their union.  ``doc_id`` is an integer column.  ``component_id`` is the smallest id of the
    documents reachable by links, itself included; null ids are passed over unless
    a component has no other.  A text with fewer words than ``width`` has its whole
    sequence as its only n-gram; a null or empty text has none, no ``group_id``, and
    is linked with nothing.  Repeated rows are in one component.
    """
    with stage_scope() as made:
        spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        often = spark.sparkContext.broadcast(slot_counts(rows.select("text"), width))
        sets = stage(in_tasks(rows, _build(often, width, share), SETS), "jaccard-sets")
        full = sets.where("n > 0")
        classes = stage(
            full.groupBy("set_id").agg(
                F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("text_hash", "n", "prefix")).alias("s"))
            .select("set_id", "smallest", "copies", "s.*"), "jaccard-classes")
        lists = index_lists(classes)
        found = stage(links(lists, WholeSets(rows, classes, width), share), "jaccard-links")
        labels = classes.select("set_id", "smallest", "copies", F.col("set_id").alias("root"))
        if not found.isEmpty():
            roots = components(found.select(F.lit(0).cast("long").alias("scope"), "a", "b")).select(F.col("node").alias("set_id"), "root")
            labels = classes.select("set_id", "smallest", "copies").join(roots, "set_id", "left").withColumn(
                "root", F.coalesce("root", "set_id"))
        labels = stage(labels, "jaccard-labels")
        smallest = labels.groupBy("root").agg(F.min("smallest").alias("component_id"))
        named = stage(labels.join(smallest, "root").select("set_id", "copies", F.col("root").alias("group_id"), "component_id"), "jaccard-named")
        total = full.count()
    unstage(*made, keep=(sets, named))
    grouped = join_groups(full, named, ["set_id"], "copies", total).select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "group_id", "component_id")
    alone = sets.where("n = 0").select(
        "doc_id", "text_hash", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("group_id"), F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)


def one_of_each(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``docs`` with one row of every component left: the one with the smallest id, a null id first, then text hash.

    Texts without words are not linked with anything and all stay.
    """
    with stage_scope() as made:
        groups = stage(similar_groups(docs, width, share), "jaccard-groups-of-rows")
    unstage(*made, keep=(groups,))
    groups = groups.where("n_shingles > 0")
    kept = groups.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*columns, F.col("doc_id").cast("bigint").alias("own_id"), F.xxhash64("text").alias("own_hash"),
                       F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False)).alias("has_word"))
    of_row = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash"))
    left = rows.where("has_word").join(kept, of_row, "left_semi").dropDuplicates(["own_id", "own_hash"])
    return left.unionByName(rows.where("not has_word")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
