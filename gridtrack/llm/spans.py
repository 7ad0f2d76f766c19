"""Repeated passages by sliding sentence spans.

Every run of consecutive sentences of at least ``SENTENCES`` sentences and
``WORDS`` words, the shortest one from every sentence on, gets a 96-bit fingerprint;
with ``both_edges`` the shortest one up to the end of every sentence too.  Runs that
occur more than once are found by counting; of each the first occurrence stays,
by document and place, and the sentences of all others are removed.

Sentences end at marks or line ends.  Long ones are also cut at commas and at
words whose fingerprint ends in zeros, which depends on the words alone: the
same passage is cut alike wherever it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.llm.kernels import in_tasks
from gridtrack.llm.skew import join_groups
from gridtrack.llm.words import Words, mix, powers, text_slices, words_of
from gridtrack.session import stage, stage_scope, unstage

SENTENCES = 2
WORDS = 15
LONG = 16
CUT_MASK = 7

RUNS = "doc_id bigint, text_hash bigint, first_word int, end_word int, high bigint, low int"
BASES = (0xA24BAED4963EE407 | 1, 0x9FB21C651E98DF25 | 1)

# fixed values: bytes that close a sentence, and those that may follow them
CLOSING, AFTER, PAUSES = (np.zeros(256, dtype=bool) for _ in range(3))
CLOSING[list(b".!?")] = True
AFTER[list(b"\"')]}")] = True
PAUSES[list(b",;:")] = True


def sentences(words: Words) -> np.ndarray:
    """For every word whether a sentence ends with it."""
    n = words.hashes.size
    if not n:
        return np.zeros(0, dtype=bool)
    last = words.data[words.ends - 1]
    before = words.data[np.maximum(words.ends - 2, words.starts)]
    ends = CLOSING[last] | (AFTER[last] & CLOSING[before])
    lines = np.r_[0, np.cumsum(words.data == 10)]
    ends[:-1] |= lines[words.starts[1:]] > lines[words.ends[:-1]]
    tails = words.first[1:] - 1
    ends[tails[words.counts() > 0]] = True
    number = np.r_[0, np.cumsum(ends)[:-1]]
    long = np.bincount(number)[number] > LONG
    return ends | (long & (PAUSES[last] | ((words.hashes & np.uint64(CUT_MASK)) == 0)))


def runs(words: Words, both_edges: bool = False) -> tuple[np.ndarray, ...]:
    """Row, first word, end word (in the row) and the two fingerprints of every run."""
    close = np.flatnonzero(sentences(words)) + 1
    open_ = np.r_[0, close[:-1]] if close.size else close
    row = words.rows()[open_]
    end = np.maximum(np.searchsorted(close, open_ + WORDS), np.arange(close.size) + SENTENCES - 1)
    fits = end < close.size
    fits[fits] &= row[end[fits]] == row[fits]
    a, b = open_[fits], close[end[fits]]
    if both_edges:
        begin = np.minimum(np.searchsorted(open_, close - WORDS, side="right") - 1, np.arange(close.size) - SENTENCES + 1)
        fits = begin >= 0
        fits[fits] &= row[begin[fits]] == row[fits]
        a, b = np.unique(np.stack([np.r_[a, open_[begin[fits]]], np.r_[b, close[fits]]], axis=1), axis=0).T
    row = words.rows()[a]
    prints = []
    with np.errstate(over="ignore"):
        for k, base in enumerate(BASES):
            up, down = powers(base, words.hashes.size + 1), powers(pow(base, -1, 2**64), words.hashes.size + 1)
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum((words.hashes ^ np.uint64(k * 0x5851F42D4C957F2D)) * up[:-1])]
            prints.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
    return row, a - words.first[row], b - words.first[row], prints[0].view(np.int64), prints[1].astype(np.uint32).view(np.int32)


def _emit(both_edges: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in text_slices(batch.column(2)):
                row, first, end, high, low = runs(words_of(batch.column(2).slice(s, e - s)), both_edges)
                at = pa.array(row + s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(first.astype(np.int32)),
                     pa.array(end.astype(np.int32)), pa.array(high), pa.array(low)],
                    names=["doc_id", "text_hash", "first_word", "end_word", "high", "low"])

    return emit


def repeated_spans(docs: DataFrame, both_edges: bool = False) -> DataFrame:
    """``(doc_id, text_hash, first_word, end_word)`` of every run that occurred before, from ``docs(doc_id, text)``.

    Documents are ordered by id, a null id first, then by a hash of the text; rows
    equal in both count as one document.  A run that occurs again further down
    the same document is a repeat as well.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = stage(in_tasks(rows, _emit(both_edges), RUNS), "span-runs")
    counted = found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stage(counted, "span-repeated")
    some = stage(join_groups(found, repeated, ["high", "low"], "n", found.count()), "span-members")
    place = F.struct("doc_id", "text_hash", "first_word")
    first = stage(some.groupBy("high", "low").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("m")), "span-first")
    later = join_groups(some, first, ["high", "low"], "m", some.count()).where(~place.eqNullSafe(F.col("kept")))
    return later.select("doc_id", "text_hash", "first_word", "end_word")


def merged(spans: DataFrame) -> DataFrame:
    """One row per document, ``spans`` joined where they touch and in order.

    A document's array is bounded by its own length.
    """
    lists = spans.distinct().groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("raw"))
    fold = """
      aggregate(raw, CAST(array() AS array<struct<first_word:int,end_word:int>>), (done, s) ->
        if(size(done) > 0 AND element_at(done, -1).end_word >= s.first_word,
           array_append(slice(done, 1, size(done) - 1),
                        named_struct('first_word', element_at(done, -1).first_word,
                                     'end_word', greatest(element_at(done, -1).end_word, s.end_word))),
           array_append(done, s)))
    """
    return lists.select("doc_id", "text_hash", F.expr(fold).alias("spans"))


def _cut(kept: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(kept), batch.column(kept + 1)
            for s, e in text_slices(texts):
                some = texts.slice(s, e - s)
                words = words_of(some)
                out, gone = [], []
                raw = words.data.tobytes()
                lengths = np.array([len(t.encode()) for t in some.fill_null("").to_pylist()], dtype=np.int64)
                begins = np.cumsum(lengths) - lengths
                for i, (text, parts) in enumerate(zip(some.to_pylist(), spans.slice(s, e - s).to_pylist())):
                    pieces, at, last = [], begins[i], words.first[i + 1] - words.first[i]
                    for part in parts or []:
                        a, b = words.first[i] + part["first_word"], part["end_word"]
                        pieces.append(raw[at:words.starts[a]])
                        at = words.starts[words.first[i] + b] if b < last else begins[i] + lengths[i]
                    pieces.append(raw[at:begins[i] + lengths[i]])
                    out.append(None if text is None else b"".join(pieces).decode())
                    gone.append(sum(p["end_word"] - p["first_word"] for p in parts or []))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).slice(s, e - s) for j in range(kept)), pa.array(out, pa.string()),
                     spans.slice(s, e - s), pa.array(gone, pa.int64())],
                    names=[*batch.schema.names[:kept], "text", "spans", "removed_words"])

    return cut


def remove_repeats(docs: DataFrame, columns: list[str], only_changed: bool = False, both_edges: bool = False) -> DataFrame:
    """``columns`` of every row of ``docs``, ``text`` without repeated spans, ``spans`` and ``removed_words``.

    A null text stays null; texts of one sentence, or of fewer than ``WORDS`` words,
    have no run and stay whole.  A text may become empty.  With ``only_changed``
    rows that lose nothing are left out.  With ``both_edges`` the short last
    sentences of a repeated passage are removed too.  ``columns`` must not hold ``text``.
    """
    with stage_scope() as made:
        spans = stage(merged(repeated_spans(docs, both_edges)), "spans")
    unstage(*made, keep=(spans,))
    spans = spans.select(
        F.col("doc_id").alias("span_doc"), F.col("text_hash").alias("span_text"), F.col("spans").alias("span_list"))
    names = [f"c{i}" for i in range(len(columns))]
    schema = docs.select(*columns).schema
    rows = docs.select(
        *[F.col(c).alias(n) for c, n in zip(columns, names)], F.col("doc_id").cast("bigint").alias("span_id"),
        F.xxhash64("text").alias("span_hash"), F.col("text").alias("whole_text"))
    joined = rows.join(
        spans, F.col("span_id").eqNullSafe(F.col("span_doc")) & (F.col("span_hash") == F.col("span_text")),
        "inner" if only_changed else "left")
    ddl = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, schema))
    cut = in_tasks(
        joined.select(*names, "whole_text", "span_list"), _cut(len(columns)), f"{ddl}text string, spans array<struct<first_word:int,end_word:int>>, removed_words bigint")
    return cut.toDF(*columns, "text", "spans", "removed_words")
