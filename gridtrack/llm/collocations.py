r"""Phrase collocations: frequent word n-grams scored by how much their parts attract each other.

Words are runs outside ``[\x20\x09]`` within pieces between ``[.,;:!?\x0A-\x0D]``,
with A-Z lower-cased.  Three passes over the texts find every frequent n-gram
without a shuffle of all n-grams:

1. tasks summarise words and word pairs by hash partition; the summaries of a
   partition are merged into one Misra-Gries summary.  Its capacity exceeds the
   mass of the partition divided by the threshold, so every frequent n-gram keeps
   a counter;
2. longer n-grams are summarised alike, but only where all their words and pairs
   survived: a part is as frequent as the whole at least;
3. n-grams that survived are counted exactly, by their words and not by hashes.

Survivors reach the tasks as bits of a table of ``2 ** BITS`` bits, whatever their
number.  A bit set by another n-gram lets one through that the exact count drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtrack.llm.kernels import in_tasks
from gridtrack.llm.skew import join_groups
from gridtrack.llm.words import mix, span_hashes, text_bytes, text_slices
from gridtrack.session import stage, stage_scope, unstage

LONGEST = 5
THRESHOLD = 100
#: capacity of a summary as a multiple of mass / threshold; more leaves fewer survivors that are not frequent
ROOM = 4
#: bytes of text per hash partition
SLOT_BYTES = 6 << 20
#: counters a task gathers before it hands them on
HELD = 3 << 18
SLICE_BYTES = 1 << 19
HELD_TEXTS = 1 << 19
SLOTS_PER_BATCH = 16
BITS = 26
UNKNOWN = "und"

BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True

#: a row without keys has the mass of a summary, so that all masses of a slot can come before its keys
SUMMARY = "slot int, part int, mass bigint, keys binary, counts binary"
SURVIVORS = "key bigint"
PACKED = "slot int, lang array<string>, phrase array<string>, words array<int>, n array<bigint>"
FREQUENT = "lang string, phrase string, words int, f bigint"


# --- n-grams of a slice of texts -------------------------------------------------------------------

class Grams:
    """Words of some texts, and fingerprints of the n-grams that start at each of them, per language."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        data, offsets = text_bytes(texts)
        solid = ~GAPS[data]
        cut = np.zeros(data.size + 1, dtype=bool)
        cut[offsets] = True
        edge = np.zeros(data.size + 1, dtype=bool)
        edge[1:] = solid
        self.starts = np.flatnonzero(solid & (~edge[:-1] | cut[:-1]))
        edge[:-1], edge[-1] = solid, False
        self.ends = np.flatnonzero(solid & (~edge[1:] | cut[1:])) + 1
        self.data = data
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        breaks = np.zeros(data.size + 1, dtype=np.int32)
        np.cumsum(BREAKS[data], out=breaks[1:])
        self.piece = breaks[self.starts] + self.row
        self.lang, self.langs = _codes(langs)
        self.hashes = span_hashes(data, self.starts, self.ends)
        with np.errstate(over="ignore"):
            self.first = mix(self.hashes + _lang_hashes(self.langs)[self.lang[self.row]]) if self.starts.size else self.hashes

    def each(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, first words and fingerprints of all n-grams within pieces."""
        at, key = np.arange(self.starts.size), self.first
        for length in range(1, longest + 1):
            if length > 1:
                fits = at + length - 1 < self.starts.size
                at, key = at[fits], key[fits]
                fits = self.piece[at + length - 1] == self.piece[at]
                at = at[fits]
                with np.errstate(over="ignore"):
                    key = mix(key[fits] * np.uint64(0x9FB21C651E98DF25) + self.hashes[at + length - 1])
            yield length, at, key

    def phrase(self, at: int, length: int) -> tuple[str | None, str]:
        words = [self.data[self.starts[i]:self.ends[i]].tobytes().lower() for i in range(at, at + length)]
        return self.langs[self.lang[self.row[at]]], b" ".join(words).decode()


def _codes(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = pc.fill_null(pc.cast(langs, pa.string()), UNKNOWN).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _lang_hashes(langs: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(langs, pa.string()))
    return mix(span_hashes(data, offsets[:-1], offsets[1:], fold=False))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    for batch in batches:
        texts, langs = batch.column(0), batch.column(1)
        for s, e in text_slices(texts, SLICE_BYTES):
            yield Grams(texts.slice(s, e - s), langs.slice(s, e - s))


def combine(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their total counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:key.size])
    return key[first], np.add.reduceat(count, first) if key.size else count


# --- summaries ---------------------------------------------------------------------------------------

class Bits:
    """A set of fingerprints as a table of bits; others may be found in it as well."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def hold(self, key: np.ndarray) -> np.ndarray:
        place = key >> np.uint64(64 - BITS)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    @staticmethod
    def of(survivors: DataFrame) -> Bits:
        """At most ``2 ** (BITS - 6)`` rows reach the driver."""
        place = F.shiftrightunsigned("key", 64 - BITS)
        set_ = survivors.select(F.shiftright(place, 6).alias("word"), (place % 64).cast("int").alias("bit")).groupBy("word").agg(
            F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        table = set_.toArrow()
        words = np.zeros(1 << (BITS - 6), dtype=np.uint64)
        words[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        return Bits(words)


def _survive(grams: Grams, bits: Bits, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n-grams all of whose words and pairs are in ``bits``."""
    alive = np.zeros(grams.starts.size + longest, dtype=bool)
    before = None
    for length, at, key in grams.each(longest):
        if length <= 2:
            stay = bits.hold(key)
            at, key = at[stay], key[stay]
            if length == 2:
                alive[at] = True
                before = alive.copy()
        else:
            # all pairs inside: those of the n-gram one word shorter, and the last one
            before = before & np.r_[alive[length - 2:], np.zeros(length - 2, dtype=bool)]
            stay = before[at]
            at, key = at[stay], key[stay]
        yield length, at, key


def _summaries(slots: int, lengths: range, known=None):
    """Counts of the n-grams of a task by hash partition, one row per partition whenever ``HELD`` are at hand."""

    def hand_on(key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        slot = (key % np.uint64(slots)).astype(np.int64)
        # most counts are 1: those keys come last in their slot, without a count
        order = np.lexsort((count == 1, slot))
        key, count, slot = key[order], count[order], slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][:slot.size])
        last = np.r_[first[1:], slot.size]
        for i in range(0, first.size, SLOTS_PER_BATCH):
            part = list(zip(first[i:i + SLOTS_PER_BATCH], last[i:i + SLOTS_PER_BATCH]))
            slots_here, counts = slot[first[i:i + SLOTS_PER_BATCH]].astype(np.int32), [count[s:e] for s, e in part]
            nothing = [None] * len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(slots_here, 2)), pa.array(np.repeat(np.arange(2, dtype=np.int32), len(part))),
                 pa.array([int(c.sum()) for c in counts] + nothing, pa.int64()),
                 pa.array(nothing + [key[s:e].tobytes() for s, e in part], pa.binary()),
                 pa.array(nothing + [c[c > 1].tobytes() for c in counts], pa.binary())],
                names=["slot", "part", "mass", "keys", "counts"])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for grams in _slices(batches):
            found = grams.each(lengths[-1]) if known is None else _survive(grams, known.value, lengths[-1])
            met = [key for length, _, key in found if length in lengths]
            key, count = np.unique(np.concatenate(met), return_counts=True)
            keys.append(key)
            counts.append(count)
            held += key.size
            if held > HELD:
                key, count = combine(keys, counts)
                keys, counts, held = [key], [count], key.size
                if held > HELD // 2:
                    yield from hand_on(key, count)
                    keys, counts, held = [], [], 0
        if keys:
            yield from hand_on(*combine(keys, counts))

    return summaries


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a summary row and their counts."""
    key = np.frombuffer(keys, dtype=np.uint64)
    count = np.ones(key.size, dtype=np.int64)
    several = np.frombuffer(counts, dtype=np.int64)
    count[:several.size] = several
    return key, count


class MisraGries:
    """Counters of one hash partition: a count is too low by ``error`` at most, and that is below ``mass / capacity``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.error = capacity, 0
        self.key, self.count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(count)
        self.held += key.size
        if self.held > 4 * self.capacity:
            self.merge()

    def merge(self) -> None:
        """Merge what was added; the counter after the last that fits is taken off all of them."""
        self.key, self.count = combine([self.key, *self.keys], [self.count, *self.counts])
        self.keys, self.counts, self.held = [], [], 0
        if self.key.size > self.capacity:
            off = int(np.partition(self.count, self.key.size - self.capacity - 1)[self.key.size - self.capacity - 1])
            self.error += off
            stay = self.count > off
            self.key, self.count = self.key[stay], self.count[stay] - off

    def survivors(self, threshold: int) -> np.ndarray:
        self.merge()
        return self.key[self.count + self.error >= threshold]


def _merge(threshold: int):
    """Survivors of every hash partition; its summaries follow each other, their masses first."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, mass, summary = None, 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("slot")[i].as_py() != slot:
                    if summary is not None:
                        yield _keys(summary.survivors(threshold))
                    slot, mass, summary = batch.column("slot")[i].as_py(), 0, None
                if batch.column("part")[i].as_py() == 0:
                    mass += batch.column("mass")[i].as_py()
                    continue
                if summary is None:
                    summary = MisraGries(ROOM * (mass // threshold + 1))
                summary.add(*unpacked(batch.column("keys")[i].as_py(), batch.column("counts")[i].as_py()))
        if summary is not None:
            yield _keys(summary.survivors(threshold))

    return merge


def _keys(key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])


def survivors(texts: DataFrame, slots: int, lengths: range, threshold: int, known=None) -> DataFrame:
    """Fingerprints of all n-grams that may occur ``threshold`` times."""
    parts = in_tasks(texts, _summaries(slots, lengths, known), SUMMARY)
    dealt = parts.repartition(slots, "slot").sortWithinPartitions("slot", "part")
    return stage(in_tasks(dealt, _merge(threshold), SURVIVORS), "phrases-survivors")


# --- exact counts --------------------------------------------------------------------------------------

class Counted:
    """Phrases that a task has met and how often; a phrase takes its bytes and some 20 more."""

    def __init__(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)  # ascending, with the place of each in the columns below
        self.place = np.zeros(0, dtype=np.int64)
        self.total = np.zeros(0, dtype=np.int64)
        self.texts: list[pa.RecordBatch] = []
        self.words: dict[str, int] = {}

    def add(self, grams: Grams, length: int, at: np.ndarray, key: np.ndarray) -> None:
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        spot = np.searchsorted(self.key, key)
        known = np.zeros(key.size, dtype=bool)
        inside = spot < self.key.size
        known[inside] = self.key[spot[inside]] == key[inside]
        self.total[self.place[spot[known]]] += n[known]
        new = ~known
        if new.any():
            found = [grams.phrase(i, length) for i in at[first[new]].tolist()]
            langs, phrases = zip(*found)
            self.texts.append(pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(np.full(len(found), length, dtype=np.int32))], names=["lang", "phrase", "words"]))
            places = self.total.size + np.arange(len(found))
            self.total = np.concatenate([self.total, n[new]])
            self.key, self.place = np.insert(self.key, spot[new], key[new]), np.insert(self.place, spot[new], places)

    def packed(self, slots: int) -> Iterator[pa.RecordBatch]:
        """One row per hash partition; words per language, with a null phrase, are in the first one."""
        slot = np.zeros(self.total.size, dtype=np.int64)
        slot[self.place] = (self.key % np.uint64(slots)).astype(np.int64)
        slot = np.concatenate([slot, np.zeros(len(self.words), dtype=np.int64)])
        words = pa.RecordBatch.from_arrays(
            [pa.array(list(self.words), pa.string()), pa.nulls(len(self.words), pa.string()), pa.array([0] * len(self.words), pa.int32())],
            names=["lang", "phrase", "words"])
        table = pa.Table.from_batches([*self.texts, words]).combine_chunks()
        total = pa.array(np.concatenate([self.total, np.fromiter(self.words.values(), np.int64, len(self.words))]))
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][:slot.size])
        for i in range(0, first.size, SLOTS_PER_BATCH):
            low = first[i:i + SLOTS_PER_BATCH + 1]
            bounds = np.append(low, slot.size) if low.size <= SLOTS_PER_BATCH else low
            rows = pa.array(order[bounds[0]:bounds[-1]])
            offsets = pa.array((bounds - bounds[0]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, _flat(c).take(rows)) for c in (*table.columns, total)]
            yield pa.RecordBatch.from_arrays([pa.array(slot[bounds[:-1]].astype(np.int32)), *columns], names=["slot", "lang", "phrase", "words", "n"])


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def _counts(slots: int, longest: int, pairs, longer):
    """Counts of surviving n-grams by their words, and of all words (a null phrase), per task and hash partition."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counted()
        for grams in _slices(batches):
            for code, n in enumerate(np.bincount(grams.lang[grams.row], minlength=len(grams.langs))):
                held.words[grams.langs[code]] = held.words.get(grams.langs[code], 0) + int(n)
            for length, at, key in _survive(grams, pairs.value, longest):
                if length > 2:
                    stay = longer.value.hold(key)
                    at, key = at[stay], key[stay]
                held.add(grams, length, at, key)
            if held.total.size > HELD_TEXTS:
                yield from held.packed(slots)
                held = Counted()
        yield from held.packed(slots)

    return counts


def _add_up(threshold: int):
    """Phrases of a hash partition that are frequent over all tasks; rows of a partition follow each other."""

    def total(held: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(held).group_by(["lang", "phrase", "words"]).aggregate([("n", "sum")])
        return summed.select(["lang", "phrase", "words", "n_sum"]).rename_columns(["lang", "phrase", "words", "n"])

    def frequent(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        summed = total(held)
        stay = pc.or_(pc.greater_equal(summed.column("n"), threshold), pc.is_null(summed.column("phrase")))
        yield from summed.filter(stay).rename_columns(["lang", "phrase", "words", "f"]).combine_chunks().to_batches()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, rows = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("slot")[i].as_py() != slot:
                    if held:
                        yield from frequent(held)
                    slot, held, rows = batch.column("slot")[i].as_py(), [], 0
                held.append(pa.table({x: batch.column(x)[i].values for x in ("lang", "phrase", "words", "n")}))
                rows += held[-1].num_rows
                if rows > HELD_TEXTS:
                    held = [total(held)]
                    rows = held[0].num_rows
        if held:
            yield from frequent(held)

    return add_up


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Words and phrases of up to ``longest`` words that occur ``threshold`` times in a language, and words per language.

    ``(lang, phrase, words, f)`` with exact counts, and ``(lang, n)``.  Both are
    stage tables.
    """
    spark = docs.sparkSession
    with stage_scope() as made:
        texts = docs.select("text", F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull())
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slots = 1 + size // SLOT_BYTES
        pairs = spark.sparkContext.broadcast(Bits.of(survivors(texts, slots, range(1, 3), threshold)))
        longer = spark.sparkContext.broadcast(Bits.of(survivors(texts, slots, range(3, longest + 1), threshold, pairs)))
        packed = in_tasks(texts, _counts(slots, longest, pairs, longer), PACKED)
        dealt = packed.repartition(slots, "slot").sortWithinPartitions("slot")
        counted = stage(in_tasks(dealt, _add_up(threshold), FREQUENT), "phrases-counted")
    unstage(*made, keep=(counted,))
    return counted.where("phrase IS NOT NULL"), counted.where("phrase IS NULL").select("lang", F.col("f").alias("n"))


# --- scores ----------------------------------------------------------------------------------------------

def _product(a: Column, b: Column) -> Column:
    """Exact product of two 64-bit numbers."""
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")


def score() -> Column:
    """``floor(1000 * a * n / (l * r))``, exact where the products pass 64 bits."""
    return F.call_function("div", (_product(F.col("a"), F.col("n")) * F.lit(1000)).cast("decimal(38,0)"), _product(F.col("l"), F.col("r")))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, most: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``most`` highest scores of every language.

    Null texts are empty, a null language is ``und``.  Of the cuts of a phrase into
    two parts the lowest score ``floor(1000 * a * n / (l * r))`` counts, of equal ones the one with the
    shorter first part.  Phrases inside a longer one of the same count are dropped.
    Equal scores are ranked by count, then by the bytes of the phrase.  Repeated rows
    count as often as they occur; texts without a frequent phrase add to ``n`` alone.
    Other columns are ignored; an empty table gives no rows.
    """
    with stage_scope() as made:
        found, per_lang = frequent_phrases(docs, threshold, longest)
        words = F.split("phrase", " ")
        candidates = found.where("words > 1").withColumnRenamed("f", "a")
        cuts = candidates.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        rest = F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")
        parts = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
            F.struct(F.lit(True).alias("is_first"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part")),
            F.struct(F.lit(False).alias("is_first"), rest.alias("part")))).alias("p")).select("lang", "phrase", "a", "k", "p.*")
        parts = stage(parts, "phrases-parts")
        uses = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
        sizes = stage(uses.join(found.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]), "phrases-sizes")
        both = join_groups(parts, sizes, ["lang", "part"], "uses", parts.count()).groupBy("lang", "phrase", "a", "k").agg(
            F.max(F.when(F.col("is_first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_first"), F.col("f"))).alias("r"))
        scored = both.join(per_lang, "lang").withColumn("score", score()).groupBy("lang", "phrase", "a", "n").agg(
            F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
        inner = candidates.where("words > 2").select("lang", "a", F.explode(F.array(
            F.array_join(F.slice(words, 1, F.col("words") - 1), " "), F.array_join(F.slice(words, 2, F.col("words") - 1), " "))).alias("phrase"))
        left = scored.join(inner, ["lang", "phrase", "a"], "left_anti")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = stage(left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(
            "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases-ranked")
    unstage(*made, keep=(ranked,))
    return ranked
