"""Near copies, repeated passages and benchmark copies against brute force."""

import pytest
import numpy as np
import pyarrow as pa

from gridtrack.llm import decontaminate, jaccard, queries, spans
from gridtrack.llm.words import words_of
from tests.llm import tables


def shingle_set(text, width=4):
    words = tables.word_list(tables.fold(text))
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def components(rows, width=4, share=85):
    sets = [shingle_set(text, width) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= share * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return sorted(((doc_id, len(sets[i]), ids.get(find(i))) for i, (doc_id, _) in enumerate(rows)), key=str)


def edited(seed, words, every):
    """A copy of a text with one word in ``every`` replaced."""
    out = tables.prose(seed, words).split()
    for i in range(seed % every, len(out), every):
        out[i] = f"x{seed}y{i}"
    return " ".join(out)


def families():
    """Chains of near copies around the threshold, in which neighbours link and ends do not."""
    rows, number = [], 0
    for seed in range(6):
        base = tables.prose(100 + seed, 60 + 10 * seed).split()
        for step in range(12):
            copy = list(base)
            for k in range(step):
                copy[(7 * k + 3) % len(copy)] = f"edit{seed}at{k}"
            rows.append((number, " ".join(copy)))
            number += 1
    return rows


@pytest.mark.parametrize("make", [tables.awkward, tables.documents, lambda s: tables.texts(s, families())])
def test_components_equal_brute_force(spark, make):
    docs = make(spark)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs).collect()), key=str)
    assert got == components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_contained_sets_link_at_the_largest_size_ratio(spark):
    """Each text is the beginning of the other, with as many shingles more as a link allows."""
    rows = []
    for seed, sizes in ((900, (437, 514)), (901, (512, 602)), (902, (705, 829)), (903, (1139, 1340))):
        words = tables.prose(seed, 1400).split()
        words = [f"{w}{i}" for i, w in enumerate(words)]
        rows += [(len(rows) + k, " ".join(words[:n + 3])) for k, n in enumerate(sizes)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(tables.texts(spark, rows)).collect()), key=str)
    assert got == components(rows)
    assert [r[2] for r in got] == [0, 0, 2, 2, 4, 4, 6, 6]


def siblings():
    """Copies of one text with edits of their own, around the threshold: few of many similar pairs link."""
    words = tables.prose(77, 150).split()
    return [(i, " ".join(f"own{i}at{k}" if (k * 7 + i * 5) % (22 + i % 30) == 0 else w for k, w in enumerate(words))) for i in range(60)]


@pytest.mark.parametrize("width,share", [(4, 85), (5, 80)])
def test_groups_of_similar_sets_that_mostly_do_not_link(spark, width, share):
    rows = siblings()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"])
                  for r in jaccard.similar_groups(tables.texts(spark, rows), width, share).collect()), key=str)
    want = components(rows, width, share)
    assert got == want and 1 < len({c for _, _, c in want}) < len(rows)


def test_copies_of_one_text_are_compared_with_it(spark, monkeypatch):
    """All copies link with the text in their middle and hardly any with each other: few pairs are worth comparing."""
    words = tables.prose(78, 150).split()
    rows = [(i, " ".join(f"own{i}at{k}" if i and k in (5 + i, 60 + 2 * i) else w for k, w in enumerate(words))) for i in range(40)]
    asked, compare = [], jaccard.WholeSets.compare

    def counted(self, pairs):
        asked.append(pairs.count())
        return compare(self, pairs)

    monkeypatch.setattr(jaccard.WholeSets, "compare", counted)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(tables.texts(spark, rows)).collect()), key=str)
    assert got == components(rows) and {c for _, _, c in got} == {0}
    assert sum(asked) < 2 * len(rows)


def test_sets_of_all_rounds_are_one_table(spark):
    docs = tables.texts(spark, [(i, edited(i, 60, 20 + i)) for i in range(6)])
    rows = docs.selectExpr("xxhash64(text) AS text_hash", "text")
    ids = [r["set_id"] for r in rows.select("text").mapInArrow(jaccard._whole(4), jaccard.TOKENS).collect()]
    classes = spark.createDataFrame([(s, r["text_hash"]) for s, r in zip(ids, rows.collect(), strict=True)], "set_id bigint, text_hash bigint")
    whole = jaccard.WholeSets(rows, classes, 4)
    pairs = lambda *which: spark.createDataFrame([(ids[a], ids[b]) for a, b in which], "a bigint, b bigint")
    assert whole.compare(pairs((0, 1)).limit(0)).count() == 0 and whole.tokens is None
    assert whole.compare(pairs((0, 1), (1, 2))).count() == 2
    first = whole.tokens.stage_path
    got = whole.compare(pairs((0, 1), (2, 3), (4, 5))).collect()
    assert whole.tokens.stage_path == first and whole.tokens.count() == 6
    sets = {s: shingle_set(r["text"]) for s, r in zip(ids, rows.collect(), strict=True)}
    assert len(got) == 3 and all(r["overlap"] == len(sets[r["a"]] & sets[r["b"]]) and r["union_size"] == len(sets[r["a"]] | sets[r["b"]]) for r in got)


def test_one_of_each_component_stays(spark):
    docs = tables.awkward(spark)
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    kept = sorted((r["doc_id"] for r in left.collect()), key=str)
    # 1, 2 and 3 are equal but for case; wordless rows all stay
    assert kept == sorted([1, 4, 5, 5, 6, None, None, 7, 8, 9, 10, 10, 11], key=str)


def test_empty_tables_of_copies(spark):
    empty = tables.nothing(spark)
    assert jaccard.similar_groups(empty).count() == 0
    assert spans.remove_repeats(empty, ["doc_id"]).count() == 0
    assert decontaminate.contaminated(empty, tables.texts(spark, [(1, tables.prose(1, 20))]).withColumnRenamed("doc_id", "item_id"), ["doc_id"]).count() == 0


# --- repeated passages -----------------------------------------------------------------------

def removed(rows):
    """Rows in order with the words that stay, by the same sentences and plain loops."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = words_of(pa.array([text or ""]))
        names = tables.word_list(tables.fold(text))
        ends = (np.flatnonzero(spans.sentences(words)) + 1).tolist()
        starts, gone, mine = [0, *ends[:-1]], set(), []
        for i, s in enumerate(starts):
            j = next((j for j in range(i + spans.SENTENCES - 1, len(ends)) if ends[j] - s >= spans.WORDS), None)
            if j is not None:
                run = tuple(names[s:ends[j]])
                if run in seen:
                    gone |= set(range(s, ends[j]))
                seen.add(run)
        original = tables.word_list(text)
        out.append((doc_id, [w for k, w in enumerate(original) if k not in gone]))
    return sorted(out, key=str)


def test_passages_are_removed_once(spark):
    passage = tables.prose(50, 70)
    rows = [(i, f"{tables.prose(60 + i, 25 + i)} {passage} {tables.prose(80 + i, 20)}") for i in range(5)]
    rows += [(10, tables.prose(99, 90)), (11, f"{passage}\n{tables.prose(98, 30)}\n{passage}"), (12, None), (13, ""), (None, "One. Two.")]
    got = spans.remove_repeats(tables.texts(spark, rows), ["doc_id"]).collect()
    assert sorted(((r["doc_id"], tables.word_list(r["text"])) for r in got), key=str) == removed(rows)
    lost = {r["doc_id"]: r["removed_words"] for r in got}
    assert lost[0] == lost[10] == lost[12] == lost[13] == 0 and all(lost[i] >= 45 for i in (1, 2, 3, 4)) and lost[11] >= 100
    assert next(r["text"] for r in got if r["doc_id"] == 12) is None


def test_repeats_of_the_documents_table(spark):
    docs = tables.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = spans.remove_repeats(docs, ["doc_id"]).collect()
    assert sorted(((r["doc_id"], tables.word_list(r["text"])) for r in got), key=str) == removed(rows)


@pytest.mark.parametrize("lengths", [(20, 3, 3, 3), (12, 12, 12, 12, 5, 5)])
def test_short_last_sentences_of_a_copy_are_removed(spark, tmp_path, lengths):
    words = iter(tables.prose(77, 120).replace(".", "").split())
    text = " ".join(" ".join(f"{next(words)}{k}" for k in range(n)) + "." for n in lengths)
    got = {r["doc_id"]: r["removed_words"] for r in _op6(spark, tmp_path, [(1, text), (2, text)])}
    assert got == {1: 0, 2: sum(lengths)}


def _op6(spark, folder, rows):
    tables.texts(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return queries.op6_substring_dedup(spark, str(folder)).collect()


def test_registered_query_has_every_document(spark):
    docs = tables.documents(spark)
    got = {r["doc_id"]: (r["text"], r["removed_words"]) for r in queries.op6_substring_dedup(spark, tables.DATA).collect()}
    whole = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == whole.keys() and any(lost == 0 for _, lost in got.values())
    assert all(text == whole[i] for i, (text, lost) in got.items() if lost == 0)


def test_odd_rows_keep_their_columns(spark):
    docs = tables.awkward(spark)
    got = spans.remove_repeats(docs, ["doc_id", "spans", "c0", "score"])
    assert got.columns == ["doc_id", "spans", "c0", "score", "text", "spans", "removed_words"] and got.count() == docs.count()


# --- benchmark copies ------------------------------------------------------------------------

def align(item, window):
    """Smith-Waterman, cell by cell."""
    best, above = 0, [0] * (len(window) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(window):
            row.append(max(0, above[j] + (decontaminate.MATCH if a == b else decontaminate.MISMATCH),
                           above[j + 1] + decontaminate.GAP, row[j] + decontaminate.GAP))
        best, above = max(best, *row), row
    return best / (decontaminate.MATCH * len(item))


def bare(text):
    out = []
    for w in tables.word_list(tables.fold(text)):
        out.append(w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w)
    return out


def test_edited_copies_are_found(spark):
    items = [(i, tables.prose(200 + i, 40)) for i in range(8)] + [(20, "too short"), (21, None), (None, tables.prose(300, 30))]
    rows = [(i, f"{tables.prose(400 + i, 60)} {edited(200 + i, 40, 6)} {tables.prose(500 + i, 60)}") for i in range(8)]
    rows += [(30, tables.prose(700, 300)), (31, None), (32, ""), (33, "too short"), (None, tables.prose(300, 30))]
    got = decontaminate.contaminated(
        tables.texts(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), ["doc_id"]).collect()
    found = {(r["doc_id"], m["item_id"]): m["score"] for r in got for m in r["matches"]}
    want = {}
    for doc_id, text in rows:
        for item_id, item in items:
            score = align(bare(item), bare(text)) if len(bare(item)) >= 3 else 0
            if score >= decontaminate.THRESHOLD:
                want[doc_id, item_id] = score
    assert found == pytest.approx(want) and len(found) == 9


def test_an_edited_copy_in_many_documents_is_found_in_each(spark):
    """The seeds that survive the edit are in a third of all documents, the others in one."""
    item = tables.prose(800, 40)
    words = item.split()
    words[2::5] = [f"new{i}" for i in range(len(words[2::5]))]
    rows = [(i, f"{tables.prose(2000 + i, 30)} {' '.join(words)} {tables.prose(2100 + i, 30)}" if i % 3 == 0 else tables.prose(2200 + i, 90)) for i in range(60)]
    rows.append((60, f"{tables.prose(2300, 30)} {item}"))
    got = decontaminate.contaminated(
        tables.texts(spark, rows), spark.createDataFrame([(1, item)], "item_id bigint, text string"), ["doc_id"]).collect()
    assert {r["doc_id"] for r in got if r["matches"]} == {60, *range(0, 60, 3)}
    assert all(m["score"] == pytest.approx(align(bare(item), bare(dict(rows)[r["doc_id"]]))) for r in got for m in r["matches"])


def test_long_items_and_odd_documents(spark):
    items = spark.createDataFrame([(1, " ".join(tables.LONG.split()[500:900])), (1, tables.prose(2, 80))], "item_id bigint, text string")
    docs = tables.awkward(spark)
    got = decontaminate.contaminated(docs, items, docs.columns, output="found here")
    assert got.columns == [*docs.columns, "found here"] and got.count() == docs.count()
    assert sorted((r["doc_id"] for r in got.collect() if r["found here"]), key=str) == [1, 2, 2, 3, 9]


def test_no_items(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert {len(r["matches"]) for r in decontaminate.contaminated(tables.awkward(spark), items, ["doc_id"]).collect()} == {0}
