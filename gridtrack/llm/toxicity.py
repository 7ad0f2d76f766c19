"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel counts common subsequences of three and four characters of two
words, gaps inside them weighing less the longer they are, so a word with
inserted or left-out characters stays close to the word it disguises.  The
machine works in the Nyström space of some landmark words.  It learns from the
sentences of labelled documents: in a toxic document only the sentence with the
most suspicious word counts as toxic, found again after every fit.

A landmark machine is linear in explicit subsequences, so the trained model is
one weight per subsequence: scoring a word is a sum of table look-ups, done once
per distinct word of a worker.  A text scores as its worst sentence.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrack.llm.words import Words, span_hashes, text_bytes, text_slices, word_bounds
from gridtrack.session import stage

DECAY = 0.6
GAPS = 2
LONGEST = 24
SAMPLE_ROWS = 4000
LANDMARKS = 224
CANDIDATES = 6
ROUNDS = 6
CALIBRATION = 4
KNOWN_WORDS = 2_000_000
# of text and of words that a task works on at a time: their arrays are many times as large
SLICE_BYTES = 1 << 19
STRETCHES = 4000

# fixed values: digits and marks that stand in for letters
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
OPEN, CLOSE = 0, 27


# --- kernel ----------------------------------------------------------------------------------

def _patterns() -> list[tuple[int, ...]]:
    """Places of a subsequence, counted from its first character; at most GAPS characters are left out."""
    return [(0, *rest) for p in (3, 4) for rest in combinations(range(1, p + GAPS), p - 1)]


PATTERNS = _patterns()
# features are 64-bit hashes of the code points of a subsequence, so every script has all its letters
BASE = np.uint64(0x9E3779B97F4A7C15)
PADDING = -1
SIEVE_BITS = 20


def letters(word: str) -> str:
    """Letters of a word in lower case; stand-ins for letters between letters count as such."""
    core = word.lower().strip("!$@.,;:?\"'()*#%&-_")
    if any(c.isalpha() for c in core):
        core = core.translate(STAND_INS)
    return "".join(c for c in unicodedata.normalize("NFKC", core) if c.isalpha())


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words with their end marks, a row each, padded with PADDING; words are at most LONGEST long."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.full((len(words), int(lengths.max(initial=0)) + 2), PADDING, dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(flat.size) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    codes[:, 0] = OPEN
    codes[row, column] = flat
    codes[np.arange(len(words)), lengths + 1] = CLOSE
    return codes, lengths


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Per pattern: row and feature number of every subsequence, where it begins, and its weight."""
    for pattern in PATTERNS:
        width = codes.shape[1] - pattern[-1]
        if width <= 0:
            continue
        number = np.ones((codes.shape[0], width), dtype=np.uint64)
        for place in pattern:
            number = number * BASE + codes[:, place:place + width].astype(np.uint64)
        inside = codes[:, pattern[-1]:pattern[-1] + width] != PADDING
        row, column = np.nonzero(inside)
        yield row, number[row, column], column, DECAY ** (pattern[-1] + 1 - len(pattern))


class Features:
    """Sorted features; a small filter over the top bits answers most look-ups."""

    def __init__(self, kinds: np.ndarray) -> None:
        self.kinds = kinds
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[(kinds >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def find(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``number`` that are a feature, and which."""
        maybe = np.flatnonzero(self.sieve[(number >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        if not maybe.size:
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.kinds, number[maybe]), self.kinds.size - 1)
        same = self.kinds[at] == number[maybe]
        return maybe[same], at[same]


def norms(lengths: np.ndarray) -> np.ndarray:
    """Length of the feature vector of a word without repeated subsequences."""
    total = np.zeros(lengths.size)
    for pattern in PATTERNS:
        total += np.maximum(lengths + 2 - pattern[-1], 0) * DECAY ** (2 * (pattern[-1] + 1 - len(pattern)))
    return np.sqrt(np.maximum(total, 1e-9))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of every word with every landmark."""
    marked, mark_lengths = encode(landmarks)
    scale = 1 / norms(mark_lengths)
    ids, rows, weights = [], [], []
    for row, number, _, weight in subsequences(marked):
        ids.append(number)
        rows.append(row)
        weights.append(np.full(row.size, weight))
    ids, rows, weights = (np.concatenate(x) for x in (ids, rows, weights))
    kinds, slot = np.unique(ids, return_inverse=True)
    features = Features(kinds)
    table = np.zeros((kinds.size, len(landmarks)), dtype=np.float32)
    np.add.at(table, (slot, rows), (weights * scale[rows]).astype(np.float32))
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for at in range(0, len(words), 2000):
        codes, lengths = encode(words[at:at + 2000])
        part = out[at:at + 2000]
        for row, number, _, weight in subsequences(codes):
            hit, slots = features.find(number)
            np.add.at(part, row[hit], table[slots] * np.float32(weight))
        part /= norms(lengths)[:, None].astype(np.float32)
    return out


# --- training --------------------------------------------------------------------------------

def tokens(texts: pa.Array) -> tuple[Words, list[tuple[int, int, int, str]]]:
    """Words of a column, and the spelt-out ones: runs of three and more single letters, as row, first and last word, letters."""
    data, offsets = text_bytes(texts)
    starts, ends = word_bounds(data, offsets)
    words = Words(span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets), data)
    single = (ends - starts <= 2)
    row = words.rows()
    spelt = []
    edges = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
    for a, b in edges.reshape(-1, 2)[(edges[1::2] - edges[::2]) >= 3]:
        for r in np.unique(row[a:b]):
            s, e = max(a, words.first[r]), min(b, words.first[r + 1])
            for piece in range(s, e, LONGEST):
                last = min(piece + 2 * LONGEST, e)
                some = [letters(data[starts[i]:ends[i]].tobytes().decode()) for i in range(piece, last)]
                joined = "".join(x for x in some if len(x) == 1)
                if len(joined) >= 3:
                    spelt.append((int(r), piece, last, joined))
    return words, spelt


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct spellings of every sample document."""
    for batch in batches:
        texts = batch.column(2)
        for s, e in text_slices(texts, SLICE_BYTES):
            words, spelt = tokens(texts.slice(s, e - s))
            _, sample, which = np.unique(words.hashes, return_index=True, return_inverse=True)
            names = np.array([letters(words.data[words.starts[i]:words.ends[i]].tobytes().decode()) for i in sample] or [""], dtype=object)
            pairs = np.unique(np.stack([words.rows(), which], axis=1), axis=0) if which.size else np.zeros((0, 2), np.int64)
            rows = np.r_[pairs[:, 0], [x[0] for x in spelt]].astype(np.int64)
            values = [*names[pairs[:, 1]], *(x[3] for x in spelt)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s, e - s).take(pa.array(rows)), batch.column(1).slice(s, e - s).take(pa.array(rows)),
                 pa.array(values, pa.string())], names=["no", "toxic", "word"])


def sample_rows(labelled: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of ``labelled(toxic, text)`` and the labelled rows per class.

    It has about ``SAMPLE_ROWS`` rows per class, those with the lowest hashes.
    """
    order = F.xxhash64("text")
    known = labelled.where("toxic is not null and text is not null").select((F.col("toxic") > 0).cast("int").alias("toxic"), "text", order.alias("no"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = None
    for toxic, n in sorted(counts.items()):
        limit = F.lit(min(2**63 - 1, int(min(1.0, SAMPLE_ROWS / n) * 2**64) - 2**63))
        part = known.where((F.col("toxic") == toxic) & (F.col("no") <= limit)).limit(2 * SAMPLE_ROWS)
        parts = part if parts is None else parts.unionByName(part)
    return known.limit(0) if parts is None else parts, counts


class Machine:
    """Weights of subsequences, the offset, and the slope and offset of the calibrated score."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.numbers, self.values, self.bias, self.slope, self.offset = numbers, values, bias, slope, offset
        self._features: Features | None = None

    @property
    def features(self) -> Features:
        if self._features is None:
            self._features = Features(self.numbers)
        return self._features

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_features": None}

    def word_values(self, words: list[str]) -> np.ndarray:
        """Decision values of words; a word longer than LONGEST is its worst stretch."""
        stretches, owner = [], []
        for i, word in enumerate(words):
            for at in range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2):
                stretches.append(word[at:at + LONGEST])
                owner.append(i)
        out = np.full(len(words), -np.inf)
        for at in range(0, len(stretches), STRETCHES):
            codes, lengths = encode(stretches[at:at + STRETCHES])
            total = np.zeros(lengths.size)
            for row, number, _, weight in subsequences(codes):
                hit, slots = self.features.find(number)
                total += np.bincount(row[hit], weights=self.values[slots] * weight, minlength=lengths.size)
            np.maximum.at(out, owner[at:at + STRETCHES], total / norms(lengths) + self.bias)
        return out

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30)))


def fit_machine(bags: pd.DataFrame, odds: float) -> Machine:
    """Train from ``bags(no, toxic, word, gain, pos, neg)``, the most telling words of every sample document.

    ``odds`` is the number of toxic over that of other documents among all labelled rows.
    """
    words = sorted(set(bags["word"]))
    place = {w: i for i, w in enumerate(words)}
    best = bags.groupby("word").agg(gain=("gain", "first"), pos=("pos", "first"), neg=("neg", "first"))
    telling = best[best["gain"] > 0].sort_values(["gain"], ascending=False, kind="stable").index[:LANDMARKS * 3 // 4].tolist()
    usual = best.drop(index=telling).sort_values(["neg"], ascending=False, kind="stable").index[:LANDMARKS - len(telling)].tolist()
    landmarks = [w[:LONGEST] for w in telling + usual] or [""]
    gram = kernel(landmarks, landmarks).astype(np.float64)
    gram = (gram + gram.T) / 2
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(np.where(values > 1e-4, 1 / np.sqrt(np.maximum(values, 1e-4)), 0)) @ vectors.T
    features = (kernel([w[:LONGEST] for w in words], landmarks) @ root).astype(np.float64)

    index = bags["word"].map(place).to_numpy()
    toxic = bags["toxic"].to_numpy() == 1
    doc = pd.factorize(bags["no"])[0]
    held = pd.util.hash_array(bags["no"].to_numpy()) % CALIBRATION == 0 if bags["no"].nunique() >= 8 * CALIBRATION else np.zeros(len(bags), dtype=bool)
    train = ~held
    negative = train & ~toxic
    suspicion = bags["gain"].to_numpy(dtype=np.float64).copy()
    weights, bias = np.zeros(features.shape[1]), 0.0
    for _ in range(ROUNDS):
        frame = pd.DataFrame({"doc": doc, "value": suspicion})[train & toxic]
        witness = frame.groupby("doc")["value"].idxmax().to_numpy(dtype=np.int64)
        rows = np.r_[index[witness], index[negative]]
        sign = np.r_[np.ones(witness.size), -np.ones(int(negative.sum()))]
        if not witness.size or not negative.any():
            break
        weights, bias = _hinge(features[rows], sign, weights, bias)
        suspicion = (features @ weights + bias)[index]
    # one weight per subsequence
    beta = root @ weights
    codes, lengths = encode(landmarks)
    scale = beta / norms(lengths)
    parts = [(number, scale[row] * weight) for row, number, _, weight in subsequences(codes)]
    numbers, slot = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    machine = Machine(numbers, np.bincount(slot, weights=np.concatenate([p[1] for p in parts])), bias, 1.0, 0.0)
    worst = pd.DataFrame({"doc": doc, "value": machine.word_values(words)[index], "toxic": toxic, "held": held}).groupby("doc").max()
    used = worst[worst["held"]] if worst["held"].any() and worst[worst["held"]]["toxic"].nunique() == 2 else worst
    machine.slope, machine.offset = _platt(used["value"].to_numpy(), used["toxic"].to_numpy())
    # the sample has another share of toxic documents than all labelled rows
    machine.offset += np.log(odds * max(1, int((~used["toxic"]).sum())) / max(1, int(used["toxic"].sum())))
    return machine


def _hinge(x: np.ndarray, sign: np.ndarray, weights: np.ndarray, bias: float, strength: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, both classes of equal weight, by Newton steps."""
    cost = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    ones = np.concatenate([x, np.ones((x.shape[0], 1))], axis=1)
    full = np.r_[weights, bias]
    ridge = np.full(full.size, strength)
    ridge[-1] = 1e-6
    for _ in range(20):
        margin = sign * (ones @ full)
        active = margin < 1
        a = ones[active] * cost[active, None]
        gradient = ridge * full - a.T @ (sign[active] * (1 - margin[active]))
        step = np.linalg.solve(a.T @ ones[active] + np.diag(ridge), gradient)
        full = full - step
        if np.abs(step).max() < 1e-6:
            break
    return full[:-1], float(full[-1])


def _platt(value: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic score, with smoothed targets."""
    value = np.where(np.isfinite(value), value, -1.0)
    pos, neg = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    target = np.where(toxic, (pos + 1) / (pos + 2), 1 / (neg + 2))
    slope, offset = 3.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * value + offset, -30, 30)))
        g = np.array([((p - target) * value).sum() + 1e-3 * slope, (p - target).sum()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * value * value).sum() + 1e-3, (w * value).sum()], [(w * value).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
    return (float(slope), float(offset)) if slope > 0 else (1.0, 0.0)


def train(labelled: DataFrame) -> Machine | None:
    """The machine for ``labelled(toxic, text)``; None unless both classes occur.

    Only a sample of about ``SAMPLE_ROWS`` documents per class is used, and of each
    only its ``CANDIDATES`` most telling words, one per sentence that holds them.
    """
    rows, counts = sample_rows(labelled)
    if len(counts) < 2:
        return None
    odds = counts[1] / counts[0]
    sample = stage(rows.select("no", "toxic", "text"), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = stage(sample.mapInArrow(_vocabulary, "no bigint, toxic int, word string").where(F.length("word") >= 2).distinct(), "toxic-words")
    pos, neg = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    counts = seen.groupBy("word").agg(pos.alias("pos"), neg.alias("neg"))
    ratio = F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5) * F.lit(sizes[0] / sizes[1]))
    telling = counts.withColumn("gain", F.when(F.col("pos") >= 2, ratio * F.sqrt("pos")).otherwise(F.least(ratio, F.lit(0.0))))
    top = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("gain", "word", "pos", "neg")))), 1, CANDIDATES)
    bags = seen.join(telling, "word").groupBy("no", "toxic").agg(top.alias("top"))
    rows = bags.select("no", "toxic", F.explode("top").alias("t")).select("no", "toxic", "t.*").toArrow().to_pandas()
    return fit_machine(rows.sort_values(["no", "word"], kind="stable").reset_index(drop=True), odds)


# --- scoring ---------------------------------------------------------------------------------

class Scorer:
    """Values of distinct words, kept by a worker up to a fixed number."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        self.keys, self.values = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Worst value of every text; a text without words has the value of no word."""
        words, spelt = tokens(texts)
        keys, sample, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        if self.keys.size + keys.size > KNOWN_WORDS:
            self.keys, self.values = self.keys[:0], self.values[:0]
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, self.keys.size - 1))
        new = self.keys[at] != keys if self.keys.size else np.ones(keys.size, dtype=bool)
        if new.any():
            raw = [words.data[words.starts[i]:words.ends[i]].tobytes().decode() for i in sample[new]]
            merged, order = np.concatenate([self.keys, keys[new]]), None
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.values = np.concatenate([self.values, self._values(raw).astype(np.float32)])[order]
        value = self.values[np.searchsorted(self.keys, keys)][which] if keys.size else np.zeros(0, np.float32)
        counts = words.counts()
        out = np.full(counts.size, self.machine.bias)
        full = counts > 0
        if full.any():
            out[full] = np.maximum(self.machine.bias, np.maximum.reduceat(value, words.first[:-1][full]))
        if spelt:
            found = self.machine.word_values([x[3] for x in spelt])
            np.maximum.at(out, [x[0] for x in spelt], found)
        return out

    def _values(self, raw: list[str]) -> np.ndarray:
        """A word counts as a whole and by its parts between marks, whichever is worse."""
        names, owner = [], []
        for i, word in enumerate(raw):
            names.append(letters(word))
            owner.append(i)
            if not word.isalnum():
                parts = [p for p in "".join(c if c.isalnum() else " " for c in word).split() if len(p) >= 3]
                if len(parts) > 1:
                    names.extend(letters(p) for p in parts)
                    owner.extend([i] * len(parts))
        out = np.full(len(raw), -np.inf)
        np.maximum.at(out, owner, self.machine.word_values(names))
        return out


_scorers: dict[str, Scorer] = {}


def _score(shared: Broadcast, name: str, kept: int, text: int | None = None):
    """Keeps the first ``kept`` columns; the texts are column ``text``, the next one if not said."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        scorer = _scorers[name]
        for batch in batches:
            texts = batch.column(kept if text is None else text)
            for s, e in text_slices(texts, SLICE_BYTES):
                chance = scorer.machine.probability(scorer(texts.slice(s, e - s)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(s, e - s) for i in range(kept)), pa.array(chance)],
                    names=[*batch.schema.names[:kept], "score"])

    return score


def toxicity(docs: DataFrame, labelled: DataFrame, columns: list[str], output: str = "score") -> DataFrame:
    """``columns`` of every row of ``docs`` and ``output``, the chance that its text is toxic.

    Learns from ``labelled(toxic, text)``, rows with a null in either left out.  A
    null or empty text scores as one without a suspicious word.  If the labelled
    rows lack one of the classes, every score is the share of toxic ones, 0
    without any.
    """
    machine = train(labelled)
    if machine is None:
        share = labelled.where("toxic is not null and text is not null").agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
        return docs.select(*columns, F.lit(share or 0.0).alias(output))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    # a text that is returned as well travels once
    sent = columns if "text" in columns else [*columns, "text"]
    rows = docs.select(*sent)
    names = [f"c{i}" for i in range(len(sent))]
    ddl = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names[:len(columns)], rows.schema))
    score = _score(shared, uuid.uuid4().hex, len(columns), sent.index("text"))
    scored = rows.toDF(*names).mapInArrow(score, f"{ddl}score double")
    return scored.toDF(*columns, output)
