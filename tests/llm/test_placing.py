"""Sharding, exact duplicates and mixing against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from gridtrack.llm import exact_dedup, mixing, sharding
from tests.llm import tables


@pytest.mark.parametrize("make", [tables.awkward, tables.documents])
def test_shards_are_level_and_gapless(spark, make):
    docs = make(spark)
    rows, stored = sharding.shard_by_bytes(docs, shards=4)
    got, source = rows.collect(), docs.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in source)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    load, heaviest = Counter(), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        heaviest[r["virtual_slot"]] += r["size"]
    assert max(load.values()) <= sum(load.values()) / 4 + max(heaviest.values())
    assert {(r[0], r[1]) for r in stored.groupBy("version").count().collect()} == {(0, sharding.SLOTS), (1, sharding.SLOTS)}


def test_rebalancing_keeps_most_slots(spark):
    """One more shard takes slots from the others, which keep what fits."""
    totals = spark.range(64).selectExpr("cast(id as int) virtual_slot", "1L n", "cast(100 + id % 3 as bigint) bytes")
    before = sharding.first_map(spark, 4, 64)
    after = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(before, totals, 5).collect()}
    moved = [s for s, shard in after.items() if shard != s % 4]
    assert len(after) == 64 and sum(after[s] == 4 for s in moved) >= 12 and len(moved) <= 16


def test_no_rows_no_shards(spark):
    rows, stored = sharding.shard_by_bytes(tables.nothing(spark), shards=3)
    assert rows.count() == 0 and stored.count() == 2 * sharding.SLOTS


@pytest.mark.parametrize("make", [tables.awkward, tables.nothing, tables.documents])
def test_exact_duplicates(spark, make):
    docs = make(spark)
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        groups[hashlib.sha256(tables.fold(r["text"]).encode()).hexdigest()].append(r["doc_id"])
    got = exact_dedup.exact_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got) == Counter((i, d) for d, ids in groups.items() for i in ids)
    for digest, ids in groups.items():
        rows = [r for r in got if r["text_sha256"] == digest]
        keep = max((i for i in ids if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(keep, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [keep]


def test_digest_of_two_contents(spark, monkeypatch):
    """When a digest stands for several contents, content decides."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: exact_dedup.F.lit("same"))
    got = exact_dedup.exact_duplicates(tables.texts(spark, [(1, "a"), (2, "b"), (3, "A"), (4, None)])).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 4, 1)}


def targets_by_rounds(sizes: dict) -> dict:
    """Targets by the rule as it is told: cap, share the excess again, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, fixed = {}, {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = sum(weight[s] for s in open_)
        target = fixed | {s: left * weight[s] / share for s in open_}
        over = {s: 3 * sizes[s] for s in open_ if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        fixed |= over


@pytest.mark.parametrize("make", [tables.awkward, tables.documents])
def test_mix_meets_targets(spark, make):
    docs = make(spark)
    sizes, largest = Counter(), Counter()
    for r in docs.select("source", "text").collect():
        n = len(tables.word_list(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    want = targets_by_rounds(dict(sizes))
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    repeats = 3 if make is tables.awkward else 1  # equal rows are taken alike
    assert all(abs(taken[s] - want[s]) <= repeats * largest[s] for s in sizes)
    again = {(r["doc_id"], r["hash"]): r["copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["hash"]): r["copies"] for r in got}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_nothing_to_mix(spark):
    assert mixing.mix(tables.nothing(spark)).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert {(r["size"], r["target"]) for r in mixing.mix(wordless).collect()} == {(0, 0.0)}
