"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt by ranges of ``doc_id``; every task encodes its range and
writes files.  A file holds blocks of ``BLOCK`` ids: the block's minimum is
subtracted, the differences are packed at the width that fits ``FITTING`` percent
of them, and the others go to an exception list.  An index keeps where every
block starts.  A manifest row names every finished file, so files of failed task
attempts are never read.

File layout, little-endian: magic, block size u32, documents u64, ids u64,
blocks u64; ids of documents i64; their null flags u8; their lengths u64; block
starts u64 (one more than blocks); blocks: minimum u32, width u8, exceptions
u16, packed differences, exception places u16, exception values u32.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridtrack.llm.kernels import in_tasks
from gridtrack.llm.words import span_hashes, text_bytes, text_slices, word_bounds
from gridtrack.session import shared_dir, stage

MAGIC = b"PFOR0001"
BLOCK = 256
FITTING = 90
END_ID = 2
FILE_IDS = 4_000_000
KNOWN_PIECES = 1_500_000
# of text and of blocks that a task works on at a time: their arrays are many times as large
SLICE_BYTES = 1 << 20
CHUNK_BLOCKS = 256

MANIFEST = "part int, file int, path string, n_docs bigint, n_ids bigint"
DECODED = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


# --- encoding --------------------------------------------------------------------------------

def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges that a byte-level tokenizer encodes independently, and the row of each.

    A piece is a word with the white space before it; white space at the end of a
    text is a piece.  Byte-level pre-tokenizers never join a visible character to
    white space after it, so cutting there changes no id.  A word that ends in a
    Unicode space is not cut off: runs of white space are tokenized as a whole.
    """
    starts, ends = word_bounds(data, offsets)
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(offsets.size - 1), np.diff(first))
    opens = np.zeros(starts.size, dtype=bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    last, second, third = data[ends - 1], data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
    blank = ((second == 0xC2) & ((last == 0x85) | (last == 0xA0))) | (
        np.isin(third, [0xE1, 0xE2, 0xE3]) & np.isin(second, [0x80, 0x81, 0x9A]))
    cut = opens.copy()
    cut[1:] |= ~blank[:-1]
    begin = np.where(opens, offsets[row], 0)
    begin[1:] = np.where(opens[1:], begin[1:], ends[:-1])
    at = np.flatnonzero(cut)
    p_start, p_row = begin[at], row[at]
    p_end = ends[np.r_[at[1:] - 1, starts.size - 1]] if at.size else ends[:0]
    tail_from = offsets[:-1].copy()
    has = np.diff(first) > 0
    tail_from[has] = ends[first[1:][has] - 1]
    tails = np.flatnonzero(tail_from < offsets[1:])
    p_start, p_end = np.r_[p_start, tail_from[tails]], np.r_[p_end, offsets[1:][tails]]
    p_row = np.r_[p_row, tails]
    order = np.argsort(p_start, kind="stable")
    return p_start[order], p_end[order], p_row[order]


class Encoder:
    """Ids of texts; the ids of pieces met before are kept, up to a fixed number."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.where = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by the end id, and the ids per text."""
        data, offsets = text_bytes(texts)
        starts, ends, row = pieces(data, offsets)
        keys, sample, which = np.unique(span_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        if self.keys.size + keys.size > KNOWN_PIECES:
            self.forget()
        new = ~_known(self.keys, keys)
        if new.any():
            self._learn(keys[new], [data[starts[i]:ends[i]].tobytes().decode() for i in sample[new]])
        slot = np.searchsorted(self.keys, keys)
        length = self.length[slot][which]
        per_row = np.bincount(row, weights=length, minlength=offsets.size - 1).astype(np.int64) + 1
        out = np.full(int(per_row.sum()), END_ID, dtype=np.uint32)
        begin = np.cumsum(length) - length
        target = np.arange(int(length.sum())) + np.repeat(row, length)
        source = np.arange(target.size) + np.repeat(self.where[slot][which] - begin, length)
        out[target] = self.pool[source]
        return out, per_row

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        parts, sizes = [], []
        for i in range(0, len(units), 20_000):
            for encoding in self.tokenizer.encode_batch_fast(units[i:i + 20_000], add_special_tokens=False):
                ids = encoding.ids
                parts.extend(ids)
                sizes.append(len(ids))
        size = np.array(sizes, dtype=np.int64)
        where = self.pool.size + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.array(parts, dtype=np.uint32)])
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.where = np.concatenate([self.where, where])[order]
        self.length = np.concatenate([self.length, size])[order]


def _known(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not have.size:
        return np.zeros(keys.size, dtype=bool)
    at = np.minimum(np.searchsorted(have, keys), have.size - 1)
    return have[at] == keys


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- blocks ----------------------------------------------------------------------------------

def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block sizes in bytes, and the blocks; the last block is filled up with its minimum."""
    sizes, out = [], []
    for i in range(0, ids.size, BLOCK * CHUNK_BLOCKS):
        chunk = ids[i:i + BLOCK * CHUNK_BLOCKS].astype(np.int64)
        blocks = np.full((-(-chunk.size // BLOCK), BLOCK), chunk[-1 - (chunk.size - 1) % BLOCK:].min(), dtype=np.int64)
        blocks.reshape(-1)[:chunk.size] = chunk
        low = blocks.min(axis=1)
        delta = blocks - low[:, None]
        fit = np.partition(delta, BLOCK * FITTING // 100, axis=1)[:, BLOCK * FITTING // 100]
        width = np.ceil(np.log2(fit + 1)).astype(np.int64)
        over = delta >= (np.int64(1) << width)[:, None]
        packed: list[bytes] = [b""] * low.size
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            kept = np.where(over[rows], 0, delta[rows])
            bits = ((kept[:, :, None] >> np.arange(w)) & 1).astype(np.uint8).reshape(rows.size, -1)
            raw = np.packbits(bits, axis=1, bitorder="little")
            for r, line in zip(rows, raw):
                packed[r] = line.tobytes()
        for r in range(low.size):
            places = np.flatnonzero(over[r])
            block = b"".join([
                low[r].astype("<u4").tobytes(), bytes([width[r]]), np.uint16(places.size).tobytes(), packed[r],
                places.astype("<u2").tobytes(), delta[r, places].astype("<u4").tobytes()])
            sizes.append(len(block))
            out.append(block)
    return np.array(sizes, dtype=np.int64), b"".join(out)


def unpack(payload: np.ndarray, starts: np.ndarray, count: int, block: int) -> np.ndarray:
    """The first ``count`` ids of the blocks that start at ``starts``."""
    begin = starts[:-1].astype(np.int64)
    if not begin.size:
        return np.zeros(0, dtype=np.uint32)
    head = payload[begin[:, None] + np.arange(7)]
    low = head[:, :4].copy().view("<u4")[:, 0]
    width, n_over = head[:, 4].astype(np.int64), head[:, 5:7].copy().view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((begin.size, block), dtype=np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for k in range(0, rows.size, CHUNK_BLOCKS):
            some = rows[k:k + CHUNK_BLOCKS]
            raw = payload[begin[some][:, None] + 7 + np.arange(block * w // 8)]
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(some.size, block, w)
            value = np.zeros((some.size, block), dtype=np.uint32)
            for bit in range(w):
                value |= bits[:, :, bit].astype(np.uint32) << np.uint32(bit)
            out[some] = value
    if n_over.any():
        row = np.repeat(np.arange(begin.size), n_over)
        nth = np.arange(row.size) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        lists = begin + 7 + block * width // 8
        place = payload[(lists[row] + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
        value = payload[(lists[row] + 2 * n_over[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[row, place] = value
    out += low[:, None]
    return out.reshape(-1)[:count]


def file_bytes(doc_ids: np.ndarray, is_null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    sizes, blocks = pack(ids)
    return b"".join([
        MAGIC, np.uint32(BLOCK).tobytes(), np.array([lengths.size, ids.size, sizes.size], dtype="<u8").tobytes(),
        doc_ids.astype("<i8").tobytes(), is_null.astype("u1").tobytes(), lengths.astype("<u8").tobytes(),
        np.r_[0, np.cumsum(sizes)].astype("<u8").tobytes(), blocks])


def parse_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their null flags, lengths and all ids of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    block = int(np.frombuffer(raw, "<u4", 1, 8)[0])
    n_docs, n_ids, n_blocks = (int(x) for x in np.frombuffer(raw, "<u8", 3, 12))
    at = 36
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    is_null = np.frombuffer(raw, "u1", n_docs, at + 8 * n_docs).astype(bool)
    lengths = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    starts = np.frombuffer(raw, "<u8", n_blocks + 1, at)
    payload = np.frombuffer(raw, np.uint8, offset=at + 8 * (n_blocks + 1))
    return doc_ids, is_null, lengths, unpack(payload, starts, n_ids, block)


# --- files -----------------------------------------------------------------------------------

def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder)


def _writer(folder: str, tokenizer_path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        fs, root = file_system(folder)
        held: list[tuple[np.ndarray, ...]] = []
        total = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, total, number
            columns = [np.concatenate(x) for x in zip(*held)]
            path = f"{root.rstrip('/')}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.pfor"
            with fs.open_output_stream(path) as sink:
                sink.write(file_bytes(*columns))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([path]),
                 pa.array([columns[2].size], pa.int64()), pa.array([columns[3].size], pa.int64())],
                names=["part", "file", "path", "n_docs", "n_ids"])
            held, total, number = [], 0, number + 1
            return row

        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for s, e in text_slices(texts, SLICE_BYTES):
                ids, lengths = encode(texts.slice(s, e - s))
                some = doc_ids.slice(s, e - s)
                held.append((some.fill_null(0).to_numpy(), some.is_null().to_numpy(zero_copy_only=False), lengths, ids))
                total += ids.size
                if total >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    return write


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> tuple[DataFrame, str]:
    """Encode ``docs(doc_id, text)`` into files below ``folder``; returns the manifest and the folder.

    ``doc_id`` is an integer column.  Files follow ascending ids, a null id before
    all others, rows of one id by a hash of their text.  A null text is empty and
    has the end id only.  Other columns are ignored; an empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stage(in_tasks(ordered, _writer(folder, tokenizer_path), MANIFEST), "token-manifest"), folder


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(path) as source:
                    doc_ids, is_null, lengths, ids = parse_file(source.read())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4", copy=False)
                crc = np.array([zlib.crc32(raw[e - n:e]) for e, n in zip(ends, lengths)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=is_null), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files of a manifest.

    ``start`` counts the ids of all documents before it.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    tasks = max(1, min(10_000, manifest.count()))
    return in_tasks(based.repartition(tasks, "path"), _reader(folder), DECODED)


def token_rows(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files of ``docs`` and read them back, one row per document."""
    manifest, folder = write_tokens(docs, tokenizer_path)
    return read_tokens(manifest, folder)
