"""Language, toxicity and licence operators: held-out accuracy, and their numbers against plain Python."""

import math
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from gridtrack.llm import decontaminate, language, licenses, queries, toxicity
from tests.llm import tables


# --- language --------------------------------------------------------------------------------

def kneser_ney(texts):
    """Interpolated Kneser-Ney over character 4-grams, in dictionaries."""
    top = Counter()
    for text in texts:
        codes, begins = language.characters([text])
        line = [int(c) for c in codes[begins[0]:]]
        top.update(tuple(line[i:i + 4]) for i in range(len(line) - 3))
    counts = {4: top}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    kinds = len({g[-1] for g in top})
    discount, totals, types = {}, {}, {}
    for n, c in counts.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
        totals[n], types[n] = Counter(), Counter()
        for g, v in c.items():
            totals[n][g[:-1]] += v
            types[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (kinds + 1)
        below = p(gram[1:])
        if not totals[n][gram[:-1]]:
            return below
        v = counts[n][gram]
        return (max(0, v - discount[n]) if v else 0) / totals[n][gram[:-1]] + discount[n] * types[n][gram[:-1]] / totals[n][gram[:-1]] * below

    return p


def test_entropies_equal_the_textbook(spark):
    texts = {"a": ["abra cadabra abba", "bad cab dab"], "b": ["xylo zoo oz xo", "zoo zyx"]}
    model = language.train(spark.createDataFrame([(k, t) for k, v in texts.items() for t in v], "lang string, text string"))
    arrays = language.Model(model.toPandas())
    probe = "cab zoo abra q"
    got, lengths = language.entropies([probe], arrays)
    codes, begins = language.characters([probe])
    line = [int(c) for c in codes]
    for i, lang in enumerate(arrays.langs):
        p = kneser_ney(texts[lang])
        want = -sum(math.log2(p(tuple(line[k:k + 4]))) for k in range(len(line) - 3)) / (len(line) - 3)
        assert got[0, i] == pytest.approx(want, rel=1e-4)
    assert lengths.tolist() == [len(line) - 3]


def test_languages_of_held_out_documents(spark):
    tables.documents(spark)
    rows = {r["doc_id"]: r for r in queries.op2_language(spark, tables.DATA).collect()}
    truth = {r["doc_id"]: r["lang"] for r in tables.documents(spark).select("doc_id", "lang").collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 40
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) >= 0.95


def test_limits_come_from_all_labelled_rows(spark, monkeypatch):
    seen, calibrate = [], language.calibrate
    monkeypatch.setattr(language, "calibrate", lambda rows, langs: seen.append(rows.count()) or calibrate(rows, langs))
    labelled = spark.range(6000).selectExpr("if(id % 2 = 0, 'a', 'b') AS lang", "concat(if(id % 2 = 0, 'abra cad ', 'xylo zoo '), id, ' ', repeat('x', int(id % 7))) AS text")
    assert language.identify(labelled, labelled, ["lang"]).where("lang <> lang_pred").count() == 0
    assert seen == [6000]


@pytest.mark.parametrize("n", [1, 2, 1001, 5000])
def test_calibration_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    rows = [("ab"[i % 2], 5, [float(x) for x in np.round(rng.normal(3, 0.4, 2), 3)]) for i in range(n)]
    found, limits = language.calibrate(spark.createDataFrame(rows, "lang string, chars bigint, entropies array<double>"), ["a", "b"])
    matrix, right = np.array([r[2] for r in rows]), np.array(["ab".index(r[0]) for r in rows])
    losses = {}
    for temperature in (1, 2, 4, 8):
        chance = np.exp(-matrix * temperature)
        losses[temperature] = -np.log(chance[np.arange(n), right] / chance.sum(axis=1)).mean()
    assert found == min(losses, key=losses.get)
    for i, lang in enumerate("ab"):
        want = np.quantile(matrix[right == i, i], 0.999) if (right == i).any() else math.inf
        assert limits[lang] == pytest.approx(want, rel=1e-12)


def test_undetermined_texts(spark):
    docs = tables.awkward(spark)
    got = language.identify(docs, docs.select("lang", "text"), ["doc_id", "c0", "score"])
    assert got.columns == ["doc_id", "c0", "score", "lang_pred", "score", "bits", "accepted"] and got.count() == docs.count()
    by_id = {r[0]: r[3] for r in got.collect() if r[0] is not None}
    assert {by_id[i] for i in (4, 5, 6, 8)} == {"und"} and {by_id[i] for i in (1, 7, 9)} <= {"xx", "yy"}
    nobody = language.identify(docs, tables.nothing(spark).select("lang", "text"), ["doc_id"])
    assert {(r["lang_pred"], r["score"]) for r in nobody.collect()} == {("und", 0.0)}
    assert language.identify(tables.nothing(spark), docs.select("lang", "text"), ["doc_id"]).count() == 0


# --- toxicity --------------------------------------------------------------------------------

def slow_kernel(a, b):
    """Common gapped subsequences of two words with end marks, by enumeration."""
    def features(word):
        code, _ = toxicity.encode([word])
        line, out = code[0], defaultdict(float)
        for pattern in toxicity.PATTERNS:
            for i in range(len(word) + 2 - pattern[-1]):
                out[(len(pattern), *(int(line[i + k]) for k in pattern))] += toxicity.DECAY ** (pattern[-1] + 1 - len(pattern))
        return out

    x, y = features(a), features(b)
    return sum(v * y[k] for k, v in x.items()) / toxicity.norms(np.array([len(a)]))[0] / toxicity.norms(np.array([len(b)]))[0]


def test_kernel_equals_enumeration():
    words, marks = ["moron", "mxoron", "table", "a", ""], ["moron", "stable"]
    got = toxicity.kernel(words, marks)
    assert got == pytest.approx(np.array([[slow_kernel(w, m) for m in marks] for w in words]), abs=1e-5)
    assert got[0, 0] > got[1, 0] > got[2, 0]


def test_words_of_any_script_are_told_apart():
    """Letters whose code points agree modulo 3 are different letters."""
    word, other = "дурень", "".join(chr(ord(c) + 3) for c in "дурень")
    near, far = toxicity.kernel([word, other], [word])[:, 0]
    assert toxicity.kernel(["馬鹿野郎"], ["馬鹿野郎"])[0, 0] > 3 * toxicity.kernel(["馬鹿野郎"], ["".join(chr(ord(c) + 3) for c in "馬鹿野郎")])[0, 0]
    assert near > 0.9 and far < 0.1 * near


@pytest.fixture(scope="module")
def labelled(spark):
    insults = ["blockhead", "scoundrel", "numskull", "dimwit"]
    rows = []
    for i in range(160):
        text = tables.prose(1000 + i, 60).split()
        if i % 2:
            text.insert(i % 50, insults[(i // 2) % 4])
        rows.append((i % 2, " ".join(text)))
    return spark.createDataFrame(rows, "toxic int, text string")


def test_disguised_insults(spark, labelled):
    clean = [(i, tables.prose(3000 + i, 80)) for i in range(20)]
    worse = {100: "blockhead", 101: "b.l.o.c.k.h.e.a.d", 102: "bloxckhead", 103: "n u m s k u l l", 104: "num5kull", 105: "Scoun-drel!"}
    rows = clean + [(i, f"{tables.prose(4000 + i, 40)} {w} {tables.prose(5000 + i, 40)}") for i, w in worse.items()]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(tables.texts(spark, rows), labelled, ["doc_id"]).collect()}
    assert all(got[i] >= 0.5 for i in worse), got
    assert all(got[i] < 0.5 for i, _ in clean)


def test_odd_texts_have_a_score(spark, labelled):
    docs = tables.awkward(spark)
    got = toxicity.toxicity(docs, labelled, docs.columns, output="toxic score")
    assert got.columns == [*docs.columns, "toxic score"] and got.count() == docs.count()
    assert all(0 <= r["toxic score"] < 0.5 for r in got.collect())
    one_class = labelled.where("toxic = 0").limit(5)
    assert {r["score"] for r in toxicity.toxicity(docs, one_class, ["doc_id"]).collect()} == {0.0}
    assert {r["score"] for r in toxicity.toxicity(docs, labelled.limit(0), ["doc_id"]).collect()} == {0.0}
    assert toxicity.toxicity(tables.nothing(spark), labelled, ["doc_id"]).count() == 0


def test_words_are_read_whole():
    """An insult at the end of a long text or a long word counts."""
    words, spelt = toxicity.tokens(pa.array([tables.LONG + " d i m w i t", "", None]))
    assert words.counts().tolist() == [60_006, 0, 0] and [x[3] for x in spelt] == ["dimwit"]


# --- licences --------------------------------------------------------------------------------

def test_sequences_and_fragments(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (1, f"Hello there.\n{mit}\n\n{notice}\nBye."), (2, f"{notice} {mit}"), (3, "Released under the MIT License. Released under the MIT License."),
        (4, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (5, None), (6, ""), (7, "no licence here"), (None, notice)]
    got = {r["doc_id"]: (r["licenses"], r["fragments"]) for r in licenses.scan_licenses(tables.texts(spark, rows), ["doc_id"]).collect()}
    assert got == {
        1: ({"MIT": 1}, 0), 2: ({}, 2), 3: ({"MIT": 2}, 0), 4: ({"CC-BY-NC-4.0": 1, "Apache-2.0": 1}, 0), None: ({}, 1)}


WRAPPED_MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""

WRAPPED_APACHE = """Licensed under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_wrapped_sentences(spark):
    def led(text, leader):
        return "\n".join(f"{leader} {line}" for line in text.splitlines())

    rows = [(1, WRAPPED_MIT), (2, led(WRAPPED_MIT, "#")), (3, led(WRAPPED_APACHE, " *")), (4, WRAPPED_APACHE.replace("\n", "\r\n")),
            (5, "Licensed under the MIT\n\nlicense"), (6, "Licensed under the MIT. License"), (7, "Licensed\nunder\nthe\nMIT\nlicense")]
    got = {r["doc_id"]: (r["licenses"], r["fragments"], len(r["sentences"])) for r in licenses.scan_licenses(tables.texts(spark, rows), ["doc_id"]).collect()}
    mit, apache = ({"MIT": 1}, 0, 2), ({"Apache-2.0": 1}, 0, 5)
    assert got == {1: mit, 2: mit, 3: apache, 4: apache, 7: ({"MIT": 1}, 0, 1)}


def test_documents_of_fragments_stay_in_the_query(spark, tmp_path):
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    tables.texts(spark, [(1, notice), (2, "Licensed under the MIT license."), (3, "nothing")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op5_licenses(spark, str(tmp_path)).collect())
    assert got == [(1, None, None, 1), (2, "MIT", 1, 0)]


def test_every_sentence_has_a_cue_and_a_rule():
    assert all(any(cue in sentence for cue in licenses.CUES) for sentence in licenses.SENTENCES)
    assert {x for _, ids in licenses.RULES for x in ids} <= set(licenses.SENTENCES.values())


def test_licences_of_odd_rows(spark):
    docs = tables.awkward(spark)
    assert licenses.scan_licenses(docs, ["doc_id", "c0", "score"]).count() == 0
    assert licenses.scan_licenses(tables.nothing(spark), ["doc_id"]).count() == 0


def test_toxicity_works_on_small_slices_of_a_batch():
    codes, _ = toxicity.encode(["idiot", "moron"])
    numbers = np.unique(np.concatenate([x[1] for x in toxicity.subsequences(codes)]))
    machine = toxicity.Machine(numbers, np.ones(numbers.size), -1.0, 1.0, 0.0)
    words = np.array(["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(20_000)])
    picks = np.random.default_rng(1).integers(0, words.size, (1000, 1000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([" ".join(words[p]) for p in picks])], names=["c0", "text"])
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in toxicity._score(SimpleNamespace(value=machine), "small-slices", 1)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 1000 and peak < 30e6


def test_texts_that_are_returned_travel_once(spark, labelled, monkeypatch):
    docs = tables.texts(spark, [(1, tables.prose(1, 30)), (2, tables.prose(2, 30))])
    sent, kind = [], type(docs)
    original = kind.mapInArrow

    def recorded(self, *args, **named):
        sent.append([x for _, x in self.dtypes])
        return original(self, *args, **named)

    monkeypatch.setattr(kind, "mapInArrow", recorded)
    items = tables.texts(spark, [(1, tables.prose(3, 30))]).withColumnRenamed("doc_id", "item_id")
    scored = toxicity.toxicity(docs, labelled, docs.columns).collect()
    found = decontaminate.contaminated(docs, items, docs.columns).collect()
    assert {r["text"] for r in scored} == {r["text"] for r in found} == {r["text"] for r in docs.collect()}
    whole = [x for _, x in docs.dtypes]
    assert sent.count(whole) == 2
