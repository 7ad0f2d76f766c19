"""Benchmark decontamination: n-gram seeds, then local alignment.

Test items go to the tasks in blocks of bounded size, as fingerprints of their
words.  Every document is read whole: runs of ``SEED`` words that are a seed of an
item open a window around the place, and the item is aligned with the window by
Smith-Waterman, so words may be replaced, left out or added.  Seeds are all
n-grams of an item, common ones too: a document with one of them is aligned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.llm.kernels import in_tasks
from gridtrack.llm.words import Words, shingles, span_hashes, text_bytes, text_slices, word_bounds

SEED = 3
CHUNK = 96
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
ALIGN_CELLS = 4_000_000
SEED_PAIRS = 1_000_000
# of text that a task works on at a time: its arrays are many times as large
SLICE_BYTES = 1 << 19

# fixed values: ASCII marks that are stripped from the ends of words
MARKS = np.zeros(256, dtype=bool)
MARKS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def bare_words(texts: pa.Array) -> Words:
    """Words without marks at their ends; a word of marks only is left as it is."""
    data, offsets = text_bytes(texts)
    starts, ends = word_bounds(data, offsets)
    first = np.searchsorted(starts, offsets)
    for _ in range(4):
        trim = (ends - starts > 1) & MARKS[data[np.maximum(ends - 1, 0)]] if starts.size else np.zeros(0, dtype=bool)
        ends = ends - trim
        trim = (ends - starts > 1) & MARKS[data[starts]] if starts.size else np.zeros(0, dtype=bool)
        starts = starts + trim
    return Words(span_hashes(data, starts, ends), starts, ends, first, data)


@dataclass
class Items:
    """A block of test items, cut into chunks of ``CHUNK`` words."""

    ids: list[int | None]
    chunk_item: np.ndarray
    chunk_words: list[np.ndarray]
    seed: np.ndarray
    seed_chunk: np.ndarray
    seed_at: np.ndarray

    @classmethod
    def of(cls, ids: list[int | None], texts: pa.Array) -> Items:
        words = bare_words(texts)
        chunk_item, chunk_words = [], []
        for i in range(len(ids)):
            h = words.hashes[words.first[i]:words.first[i + 1]]
            # the last chunk is a full one too, so no seed is lost at a cut
            cuts = range(0, max(1, h.size - SEED + 1), CHUNK - SEED + 1)
            for at in cuts:
                chunk_item.append(i)
                chunk_words.append(h[max(0, min(at, h.size - CHUNK)):][:CHUNK] if h.size > CHUNK else h)
        lengths = np.array([w.size for w in chunk_words], dtype=np.int64)
        flat = Words(
            np.concatenate([np.zeros(0, np.uint64), *chunk_words]), np.zeros(0, np.int64), np.zeros(0, np.int64),
            np.r_[0, np.cumsum(lengths)], np.zeros(0, np.uint8))
        seed, chunk = shingles(flat, SEED)
        at = np.arange(chunk.size) - np.searchsorted(chunk, chunk)
        long_enough = lengths[chunk] >= SEED if chunk.size else np.zeros(0, dtype=bool)
        seed, chunk, at = seed[long_enough], chunk[long_enough], at[long_enough]
        order = np.argsort(seed, kind="stable")
        return cls(ids, np.array(chunk_item, dtype=np.int64), chunk_words, seed[order], chunk[order], at[order])


_blocks: dict[str, Items] = {}


def _shared(block: Broadcast, name: str) -> Items:
    if name not in _blocks:
        if len(_blocks) > 4:
            _blocks.clear()
        _blocks[name] = block.value
    return _blocks[name]


def _found(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Places of ``hashes`` that are a seed; a small filter over 16 bits answers most of them."""
    sieve = np.zeros(1 << 16, dtype=bool)
    sieve[(seeds & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    if not seeds.size or not maybe.size:
        return maybe[:0]
    at = np.minimum(np.searchsorted(seeds, hashes[maybe]), seeds.size - 1)
    return maybe[seeds[at] == hashes[maybe]]


def smith_waterman(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row pair, and where in the window it ends (exclusive).

    Rows are padded with 0 in ``items`` and 1 in ``windows``, which match nothing.
    """
    n = windows.shape[1]
    slope = -GAP * np.arange(1, n + 1, dtype=np.int32)
    above = np.zeros((windows.shape[0], n + 1), dtype=np.int32)
    best, end = np.zeros(windows.shape[0], dtype=np.int32), np.zeros(windows.shape[0], dtype=np.int64)
    for i in range(items.shape[1]):
        word = items[:, i:i + 1]
        step = np.where(windows == word, MATCH, MISMATCH)
        cell = np.maximum(0, np.maximum(above[:, :-1] + step, above[:, 1:] + GAP))
        cell = np.maximum(cell, np.maximum.accumulate(cell + slope, axis=1) - slope)
        above = np.concatenate([np.zeros((cell.shape[0], 1), dtype=np.int32), cell], axis=1)
        top = cell.argmax(axis=1)
        value = cell[np.arange(cell.shape[0]), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top + 1, end)
    return best, end


def matches(texts: pa.Array, items: Items) -> tuple[np.ndarray, ...]:
    """Row, item, score, first and last word (exclusive) of every aligned window at or above the threshold."""
    words = bare_words(texts)
    h, row = shingles(words, SEED)
    at_row = np.arange(row.size) - np.searchsorted(row, row)
    hit = _found(h, items.seed)
    lo, hi = np.searchsorted(items.seed, h[hit]), np.searchsorted(items.seed, h[hit], side="right")
    lengths = np.array([w.size for w in items.chunk_words], dtype=np.int64)
    empty = np.zeros(0, dtype=np.int64)
    if not hit.size:
        return empty, empty, np.zeros(0), empty, empty

    # windows: seeds of one row and chunk whose diagonals fall into the same half chunk, from some seed pairs at a time
    slack = np.maximum(lengths // 2, 4)
    piece = np.cumsum(hi - lo) // SEED_PAIRS
    keys = []
    for places in np.split(np.arange(hit.size), np.flatnonzero(np.diff(piece)) + 1):
        times = (hi - lo)[places]
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        seed, where = np.repeat(lo[places], times) + nth, np.repeat(hit[places], times)
        chunk, diagonal = items.seed_chunk[seed], at_row[where] - items.seed_at[seed]
        keys.append(np.unique(np.stack([row[where], chunk, diagonal // slack[chunk]], axis=1), axis=0))
    key = np.unique(np.concatenate(keys), axis=0)
    r, c = key[:, 0], key[:, 1]
    size = words.counts()[r]
    first = np.clip(key[:, 2] * slack[c] - slack[c], 0, size)
    last = np.clip(key[:, 2] * slack[c] + 2 * slack[c] + lengths[c], 0, size)

    score, end = np.zeros(r.size), np.zeros(r.size, dtype=np.int64)
    order = np.argsort(last - first, kind="stable")
    at = 0
    while at < order.size:
        step = max(1, ALIGN_CELLS // (CHUNK * 4))
        some = order[at:at + step]
        at += step
        wide, tall = int((last - first)[some].max()), int(lengths[c[some]].max())
        window = np.ones((some.size, wide), dtype=np.uint64)
        item = np.zeros((some.size, tall), dtype=np.uint64)
        for k, x in enumerate(some):
            begin = words.first[r[x]]
            window[k, :last[x] - first[x]] = words.hashes[begin + first[x]:begin + last[x]]
            item[k, :lengths[c[x]]] = items.chunk_words[c[x]]
        value, stop = smith_waterman(item, window)
        score[some] = value / (MATCH * lengths[c[some]])
        end[some] = first[some] + stop
    good = score >= THRESHOLD
    return r[good], items.chunk_item[c[good]], score[good], first[good], end[good]


def _scanner(block: Broadcast, name: str, text: int):
    kind = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _shared(block, name)
        for batch in batches:
            texts = batch.column(text)
            for s, e in text_slices(texts, SLICE_BYTES):
                row, item, score, first, end = matches(texts.slice(s, e - s), items)
                # the best window of every row and item
                order = np.lexsort((first, -score, item, row))
                row, item, score, first, end = (x[order] for x in (row, item, score, first, end))
                top = np.r_[True, (np.diff(row) != 0) | (np.diff(item) != 0)][:row.size]
                row, item, score, first, end = (x[top] for x in (row, item, score, first, end))
                values = pa.StructArray.from_arrays(
                    [pa.array([items.ids[i] for i in item], pa.int64()), pa.array(score), pa.array(first), pa.array(end)],
                    fields=list(kind))
                bounds = np.searchsorted(row, np.arange(e - s + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), values)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(s, e - s) for i in range(batch.num_columns)), lists],
                    names=[*batch.schema.names, "found"])

    return scan


def contaminated(docs: DataFrame, benchmark: DataFrame, columns: list[str], output: str = "matches") -> DataFrame:
    """``columns`` of every row of ``docs`` and ``output``, an array of ``(item_id, score, first_word, end_word)``.

    A score is the alignment score over that of a full copy, 1 at most; the best
    window of every item at or above ``THRESHOLD`` is reported, with the window's
    first word and the word after the alignment.  Case and marks at the ends of
    words do not count.  Items of fewer than ``SEED`` words, or without a text, match
    nothing; items longer than ``CHUNK`` words are searched as chunks.  A null text
    has no matches.  Repeated items each report their matches.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    held = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    # a text that is returned as well travels once
    sent = columns if "text" in columns else [*columns, "text"]
    schema = docs.select(*sent).schema
    names = [f"c{i}" for i in range(len(schema))]
    rows = docs.select(*sent).toDF(*names)
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema))
    found = "found array<struct<item_id:bigint,score:double,first_word:bigint,end_word:bigint>>"
    for k in range(blocks):
        part = held.where(F.col("block") == k).drop("block").toArrow()
        block = Items.of(part.column("item_id").to_pylist(), part.column("text").combine_chunks())
        shared = spark.sparkContext.broadcast(block)
        scanned = in_tasks(rows, _scanner(shared, uuid.uuid4().hex, sent.index("text")), f"{ddl}, {found}" if k == 0 else f"{ddl}, matches {found[6:]}, {found}")
        rows = scanned.withColumnRenamed("found", "matches") if k == 0 else scanned.select(
            *names, F.concat("matches", "found").alias("matches"))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("matches").alias(output))
