"""Token files: block round trips, and ids against the tokenizer itself."""

import numpy as np
import pyarrow as pa
import pytest
import tracemalloc
import zlib
from hypothesis import given, settings
from hypothesis import strategies as st
from types import SimpleNamespace

from gridtrack.llm import token_files
from gridtrack.llm.queries import tokenizer_file
from tests.llm import tables

tokenizers = pytest.importorskip("tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    raw = token_files.file_bytes(np.array([5, 6]), np.array([False, True]), np.array([ids.size, 0]), ids)
    doc_ids, is_null, lengths, back = token_files.parse_file(raw)
    assert back.tolist() == ids.tolist() and lengths.tolist() == [ids.size, 0]
    assert doc_ids.tolist() == [5, 6] and is_null.tolist() == [False, True]


def reference(texts):
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file())
    return [[*e.ids, token_files.END_ID] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.é' \n\t  　日1<|>"), max_size=30), min_size=1, max_size=4))
def test_pieces_change_no_id(texts):
    ids, lengths = token_files.encoder(tokenizer_file())(pa.array(texts))
    want = reference(texts)
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("make", [tables.awkward, tables.documents])
def test_files_hold_all_documents(spark, make):
    docs = make(spark)
    got = token_files.token_rows(docs.repartition(3), tokenizer_file()).orderBy("start").collect()
    source = docs.select("doc_id", "text").collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
                  for r, x in zip(source, reference([r["text"] for r in source])))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids) and all(r["doc_id"] is None for r in got[:len(got) - len(ids)])


def test_no_documents_no_files(spark):
    assert token_files.token_rows(tables.nothing(spark), tokenizer_file()).count() == 0


def test_files_are_written_from_small_slices_of_a_batch(tmp_path, monkeypatch):
    place = SimpleNamespace(partitionId=lambda: 0)
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: place))
    texts = [tables.prose(i % 40, 400) for i in range(2400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    write = token_files._writer(f"file://{tmp_path}", tokenizer_file())
    list(write(iter([batch.slice(0, 40)])))
    tracemalloc.start()
    written = list(write(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x.column(3)[0].as_py() for x in written) == len(texts)
    assert batch.nbytes > 4 << 20 and peak < 12 * batch.nbytes
