"""Collocations against a plain count of all n-grams, and the guarantee of the summaries."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridtrack.llm import collocations
from tests.llm import tables


def plainly(rows, threshold, longest=5, most=2000):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", tables.fold(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        counts[lang, tuple(words[i:i + k])] += 1
    frequent = {key: f for key, f in counts.items() if f >= threshold}
    inside = set()
    for (lang, words), f in frequent.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * f >= 100 * frequent[lang, words[i:i + k]]:
                    inside.add((lang, words[i:i + k]))
    out = {}
    for (lang, words), a in frequent.items():
        if len(words) > 1 and (lang, words) not in inside:
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[lang, words[:k]], counts[lang, words[k:]]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            phrase = " ".join(words)
            out.setdefault(lang, []).append((-score, -a, phrase.encode(), (phrase, a, left, right, n[lang], score)))
    return sorted((lang, rank, *row[3]) for lang, rows in out.items() for rank, row in enumerate(sorted(rows)[:most], 1))


def found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("threshold, most", [(2, 2000), (3, 7), (40, 2000)])
def test_awkward_texts(spark, threshold, most):
    docs = tables.awkward(spark)
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    assert found(collocations.collocations(docs, threshold, most=most)) == plainly(rows, threshold, most=most)


def phrases():
    """Pieces that end inside lines, overlaps, case, tabs, phrases inside longer ones, ties and a crowd of copies."""
    base = ["a a a a b. a a\tb c, D d;d\nd d e", "Á b Á b\x0bÁ b", "x y z w v u x y z w v", "née  née\t née!née née", "o.o.o", "q r q r q r"]
    return [(base[i % 6], [None, "und", "en", "xx", ""][i % 5]) for i in range(120)] + [("k l m n o p", "en")] * 60


def test_edges_of_pieces_and_languages(spark):
    rows = phrases()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    for threshold in (1, 4, 24, 60):
        assert found(collocations.collocations(docs, threshold)) == plainly(rows, threshold)


def test_tables_without_phrases(spark):
    assert collocations.collocations(tables.nothing(spark)).collect() == []
    docs = spark.createDataFrame([(None, "en"), ("", None), (". ,;", "en"), ("word", "en")], "text string, lang string")
    assert collocations.collocations(docs, 1).collect() == []


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 9 * 10**12, 8 * 10**15 + 1, 10**13 + 7, 9 * 10**12 + 5
    row = spark.range(1).select(*(F.lit(x).cast("bigint").alias(name) for name, x in (("a", a), ("n", n), ("l", left), ("r", right))))
    assert row.select(collocations.score()).first()[0] == 1000 * a * n // (left * right)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=60), min_size=1, max_size=12), st.integers(2, 12))
def test_no_frequent_key_is_lost(parts, threshold):
    mass = sum(map(len, parts))
    summary = collocations.MisraGries(mass // threshold + 1)
    truth = Counter()
    for part in parts:
        key, count = np.unique(np.array(part, dtype=np.uint64), return_counts=True)
        summary.add(key, count)
        truth.update(part)
    left = set(summary.survivors(threshold).tolist())
    assert {k for k, c in truth.items() if c >= threshold} <= left
    assert summary.key.size <= summary.capacity and summary.error < threshold


def test_texts_longer_than_a_slice(spark):
    text = " ".join(["ab cd ef."] * 40_000)
    rows = [(text, "en"), (text.upper(), "en"), (text, None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = found(collocations.collocations(docs, 50_000))
    assert got == plainly(rows, 50_000)


def test_gathered_counts_are_handed_on(spark, monkeypatch):
    """Kernels run here, with little room, so every summary and text list is handed on early."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "HELD", 50)
    rows = phrases()
    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows[i:i + 10]], pa.string()), pa.array([g for _, g in rows[i:i + 10]], pa.string())], names=["text", "lang"])
               for i in range(0, len(rows), 10)]
    total: Counter = Counter()
    for out in collocations._summaries(3, range(1, 3))(iter(batches)):
        masses = {r["slot"]: r["mass"] for r in out.to_pylist() if r["part"] == 0}
        for r in out.to_pylist():
            if r["part"] == 1:
                key, count = collocations.unpacked(r["keys"], r["counts"])
                assert masses[r["slot"]] == count.sum() and len(set(key.tolist())) == key.size
                total.update(dict(zip(key.tolist(), count.tolist())))
    want = Counter()
    for grams in collocations._slices(iter(batches)):
        for _, _, key in grams.each(2):
            want.update(key.tolist())
    assert total == want
