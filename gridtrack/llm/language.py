"""Language identification by interpolated Kneser-Ney character models.

Training counts the character 4-grams of every labelled text inside the tasks and
adds them up in Spark; lower orders, continuation counts, discounts and the
interpolated probabilities follow from that table by joins.  A trained model is
a few sorted arrays per language: hashes of n-grams with their log probability,
hashes of contexts with their back-off weight.  Hashes have ``HASH_BITS`` bits, so
a language never takes more than ``2 ** HASH_BITS`` entries per order, however
large the corpus was.  A text goes to the language with the lowest cross-entropy
per character.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtrack.llm.kernels import in_tasks
from gridtrack.llm.words import text_slices
from gridtrack.session import stage

ORDER = 4
HASH_BITS = 22
CHAR_BITS = 16
ACCEPTED = 0.999
TEMPERATURES = (1, 2, 4, 8)
BINS = 1024
UNDETERMINED = "und"
LETTER = r"\p{L}"

GRAMS = "lang string, gram bigint, n bigint"


# --- characters and n-grams ------------------------------------------------------------------

def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of lower-cased texts, white space as one blank, and where each text begins.

    Every text is led by ``ORDER - 1`` blanks.  Characters outside letters become
    blanks, runs of blanks shrink to one.
    """
    lead = " " * (ORDER - 1)
    joined = "\x00".join(lead + t.lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters(codes)
    mark = codes == 0
    blank = ~letter & ~mark
    lengths = np.array([len(lead) + len(t.lower()) for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    keep = np.ones(codes.size, dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep &= ~mark
    for k in range(ORDER - 1):
        keep[begins + k] = True
    out = np.where(letter, codes, 32)[keep]
    place = np.r_[0, np.cumsum(keep)]
    return out, np.r_[place[begins], out.size]


def _letters(codes: np.ndarray) -> np.ndarray:
    ascii_letter = (codes >= 97) & (codes <= 122)
    other = codes >= 128
    if other.any():
        kinds, which = np.unique(codes[other], return_inverse=True)
        ascii_letter[other] = np.array([chr(k).isalpha() if k < 0xD800 or k > 0xDFFF else False for k in kinds])[which]
    return ascii_letter


def grams(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams, one per character after the lead, 16 bits a character; and the 4-grams of each text's start."""
    folded = (codes & np.uint32((1 << CHAR_BITS) - 1)).astype(np.uint64)
    n = max(0, codes.size - ORDER + 1)
    packed = np.zeros(n, dtype=np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(CHAR_BITS)) | folded[k:k + n]
    lengths = np.maximum(np.diff(begins) - (ORDER - 1), 0)
    at = np.arange(int(lengths.sum())) + np.repeat(begins[:-1] - (np.cumsum(lengths) - lengths), lengths)
    return packed[at], np.r_[0, np.cumsum(lengths)]


# --- training --------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4-gram counts of a task, one language at a time; at most one row per distinct 4-gram."""
    held: dict[str, list[pd.Series]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            texts = batch.column(1).filter(pa.array(langs == lang))
            for s, e in text_slices(texts):
                packed, _ = grams(*characters(texts.slice(s, e - s).to_pylist()))
                kinds, n = np.unique(packed.view(np.int64), return_counts=True)
                held.setdefault(lang, []).append(pd.Series(n, index=kinds))
                if len(held[lang]) > 16:
                    held[lang] = [pd.concat(held[lang]).groupby(level=0).sum()]
    for lang, parts in held.items():
        total = pd.concat(parts).groupby(level=0).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(total), pa.string()), pa.array(total.index.to_numpy()), pa.array(total.to_numpy())],
            names=["lang", "gram", "n"])


def train(texts: DataFrame) -> DataFrame:
    """Model table ``(lang, kind, n, hash, value)`` from ``texts(lang, text)``.

    ``kind`` is ``p`` for log probabilities of n-grams and ``b`` for log back-off
    weights of contexts, ``n`` the order.  Rows with a null language or text are
    left out.  Counts cover every other row whole.
    """
    known = texts.select("lang", "text").where("lang is not null and text is not null")
    top = stage(
        in_tasks(known, _count, GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lm-grams")
    letters = top.groupBy("lang").agg(F.countDistinct(F.col("gram").bitwiseAND((1 << CHAR_BITS) - 1)).alias("kinds"))

    orders = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many contexts an n-gram ends
        tail = F.col("gram").bitwiseAND((1 << (CHAR_BITS * n)) - 1)
        orders[n] = orders[n + 1].select("lang", tail.alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))

    parts, lower = [], None
    for n in range(1, ORDER + 1):
        spread = _discounted(orders[n], n)
        contexts = spread.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), (F.first("discount") * F.count(F.lit(1)) / F.sum("n")).alias("backoff"))
        joined = spread.join(contexts, ["lang", "context"])
        if lower is None:
            joined = joined.join(letters, "lang").withColumn("below", 1.0 / (F.col("kinds") + 1))
        else:
            tail = F.col("gram").bitwiseAND((1 << (CHAR_BITS * (n - 1))) - 1)
            joined = joined.withColumn("tail", tail).join(lower, ["lang", "tail"])
        probability = (F.col("n") - F.col("discount")) / F.col("total") + F.col("backoff") * F.col("below")
        lower = stage(joined.select("lang", F.col("gram").alias("tail"), probability.alias("below")), f"lm-order{n}")
        parts += [
            lower.select("lang", F.lit("p").alias("kind"), F.lit(n).alias("n"), F.col("tail").alias("gram"), F.log("below").alias("value")),
            contexts.select("lang", F.lit("b").alias("kind"), F.lit(n).alias("n"), F.col("context").alias("gram"), F.log("backoff").alias("value")),
        ]
    floor = letters.select("lang", F.lit("u").alias("kind"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("gram"),
                           F.log(1.0 / (F.col("kinds") + 1)).alias("value"))
    table = parts[0]
    for part in [*parts[1:], floor]:
        table = table.unionByName(part)
    hashed = F.pmod(F.xxhash64("gram"), F.lit(1 << HASH_BITS)).alias("hash")
    return stage(table.groupBy("lang", "kind", "n", hashed).agg(F.max("value").alias("value")), "lm-model")


def _discounted(counts: DataFrame, n: int) -> DataFrame:
    """N-grams with their context and the absolute discount of their language and order."""
    ones = counts.groupBy("lang").agg(
        F.sum((F.col("n") == 1).cast("double")).alias("n1"), F.sum((F.col("n") == 2).cast("double")).alias("n2"))
    # an order without rare n-grams keeps a small discount, so unseen ones stay possible
    discount = F.greatest(F.lit(0.1), F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5)))
    context = F.shiftrightunsigned("gram", CHAR_BITS) if n == ORDER else F.shiftright("gram", CHAR_BITS)
    return counts.join(ones.select("lang", F.least(discount, F.lit(0.9)).alias("discount")), "lang").withColumn("context", context)


# --- scoring ---------------------------------------------------------------------------------

class Model:
    """Sorted hash arrays of all languages; the whole is bounded by languages x orders x 2 ** HASH_BITS."""

    def __init__(self, table: pd.DataFrame) -> None:
        self.langs = sorted(set(table["lang"]))
        self.floor, self.arrays = {}, {}
        for (lang, kind, n), part in table.groupby(["lang", "kind", "n"]):
            if kind == "u":
                self.floor[lang] = float(part["value"].iloc[0])
                continue
            part = part.sort_values("hash")
            self.arrays[lang, kind, n] = (part["hash"].to_numpy(np.int32), part["value"].to_numpy(np.float32))

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """Log probability of the last character of every 4-gram, a row per language."""
        keys = [None, *(_hash(packed & np.uint64((1 << (CHAR_BITS * n)) - 1)) for n in range(1, ORDER)), _hash(packed)]
        contexts = [None, *(_hash((packed >> np.uint64(CHAR_BITS)) & np.uint64((1 << (CHAR_BITS * (n - 1))) - 1)) for n in range(1, ORDER + 1))]
        out = np.empty((len(self.langs), packed.size), dtype=np.float32)
        for i, lang in enumerate(self.langs):
            value = np.full(packed.size, self.floor[lang], dtype=np.float32)
            for n in range(1, ORDER + 1):
                weight, known = _look(self.arrays.get((lang, "b", n)), contexts[n])
                value += np.where(known, weight, 0)
                seen, known = _look(self.arrays.get((lang, "p", n)), keys[n])
                value = np.where(known, seen, value)
            out[i] = value
        return out


def _hash(gram: np.ndarray) -> np.ndarray:
    return (_xxhash64(gram) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int32)


def _xxhash64(value: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of bigints."""
    # fixed values: the primes and the seed of the public xxHash64 definition
    p1, p2, p3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    p4, p5, seed = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5), np.uint64(42)
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = (seed + p5 + np.uint64(8)) ^ (turn(value * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _look(arrays: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if arrays is None or not arrays[0].size:
        return np.zeros(keys.size, dtype=np.float32), np.zeros(keys.size, dtype=bool)
    at = np.minimum(np.searchsorted(arrays[0], keys), arrays[0].size - 1)
    return arrays[1][at], arrays[0][at] == keys


def entropies(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in bits per character, a column per language, and the characters of each text."""
    packed, first = grams(*characters(texts))
    which, kinds = pd.factorize(packed.view(np.int64))
    per_kind = -model.log_probabilities(kinds.view(np.uint64)) / np.log(2)
    lengths = np.diff(first)
    out = np.zeros((len(texts), len(model.langs)))
    full = lengths > 0
    for i in range(len(model.langs)):
        if full.any():
            out[full, i] = np.add.reduceat(per_kind[i][which].astype(np.float64), first[:-1][full]) / lengths[full]
    return out, lengths


_models: dict[str, Model] = {}


def _scorer(shared: Broadcast, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:  # one model at a time is kept by a worker
            _models.clear()
            _models[name] = Model(shared.value)
        model = _models[name]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for s, e in text_slices(texts, 2 << 20):
                found, lengths = entropies(texts.slice(s, e - s).fill_null("").to_pylist(), model)
                flat = pa.array(found.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(e - s + 1, dtype=np.int32) * found.shape[1]), flat)
                kept = [batch.column(i).slice(s, e - s) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(lengths), lists], names=[*batch.schema.names[:-1], "chars", "entropies"])

    return score


def cross_entropies(docs: DataFrame, model: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """``columns`` of ``docs`` with ``chars`` and ``entropies``, one per language; and the languages in order.

    The model is collected and broadcast: its size is bounded by ``HASH_BITS``.
    """
    table = model.toArrow().to_pandas()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(*columns, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    schema = f"{schema}, chars bigint, entropies array<double>" if columns else "chars bigint, entropies array<double>"
    return in_tasks(rows, _scorer(shared, uuid.uuid4().hex), schema), sorted(set(table["lang"]))


# --- calibration and prediction --------------------------------------------------------------

def calibrate(scored: DataFrame, langs: list[str]) -> tuple[float, dict[str, float]]:
    """Temperature of the scores, and per language the cross-entropy above which a text is rejected.

    Both come from all rows of ``scored(lang, chars, entropies)``.  The limit is the ``ACCEPTED``
    quantile, between its two neighbours: bins are counted first, then values of the bins
    that hold the two.
    """
    names = F.array(*[F.lit(lang) for lang in langs])
    own = F.element_at("entropies", F.array_position(names, F.col("lang")).cast("int"))
    lowest = F.array_min("entropies")
    losses = []
    for number, temperature in enumerate(TEMPERATURES):
        spread = F.aggregate("entropies", F.lit(0.0), lambda total, x: total + F.exp((lowest - x) * temperature))
        losses.append((-F.log(F.greatest(F.exp((lowest - own) * temperature) / spread, F.lit(1e-9)))).alias(f"loss{number}"))
    rows = stage(scored.where("chars > 0").select("lang", own.alias("own"), *losses), "lm-calibration")
    means = rows.agg(*[F.avg(f"loss{number}") for number in range(len(TEMPERATURES))]).first()
    limits = {lang: float("inf") for lang in langs}
    if means[0] is None:
        return 1.0, limits
    best = float(TEMPERATURES[int(np.argmin(means))])

    rows = rows.select("lang", "own", F.floor(F.col("own") * BINS).alias("bin"))
    by_lang = Window.partitionBy("lang")
    counted = rows.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")).select(
        "lang", "bin", "n", (F.sum("n").over(by_lang.orderBy("bin")) - F.col("n")).alias("before"),
        ((F.sum("n").over(by_lang) - 1) * ACCEPTED).alias("place"))
    wanted = stage(counted.where(_holds("before", "n")).drop("n"), "lm-limits")
    values = rows.join(wanted, ["lang", "bin"]).groupBy("lang", "bin", "before", "place", "own").agg(F.count(F.lit(1)).alias("n"))
    in_bin = Window.partitionBy("lang", "bin").orderBy("own")
    ranked = values.withColumn("before", F.col("before") + F.sum("n").over(in_bin) - F.col("n")).where(_holds("before", "n"))
    ends = ranked.groupBy("lang").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.first("place").alias("place"))
    for row in ends.toLocalIterator():
        limits[row.lang] = row.low + (row.high - row.low) * (row.place - math.floor(row.place))
    return best, limits


def _holds(before: str, n: str) -> Column:
    """Whether one of the two ranks around ``place`` is among the ``n`` after the first ``before``."""
    inside = lambda rank: (rank >= F.col(before)) & (rank < F.col(before) + F.col(n))
    return inside(F.floor("place")) | inside(F.ceil("place"))


def identify(docs: DataFrame, labelled: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` with ``lang_pred``, ``score``, ``bits`` and ``accepted``.

    Learns from ``labelled(lang, text)``; predictions use the text alone.  A text
    that is null or has no letter is ``und`` with score 0.  Otherwise the language
    with the lowest cross-entropy per character wins, of equal ones the first by
    name; ``score`` is its share under a calibrated temperature, and ``accepted``
    is false when the text is less likely under it than all but a thousandth of
    the labelled texts, all of which are scored for that.  Without labelled rows every text is ``und``.
    """
    model = train(labelled)
    known = labelled.where("lang is not null and text is not null")
    labels, langs = cross_entropies(known.where(F.col("text").rlike(LETTER)), model, ["lang"])
    if not langs:
        return docs.select(
            *columns, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("bits"), F.lit(False).alias("accepted"))
    temperature, limits = calibrate(labels, langs)
    scored, _ = cross_entropies(
        docs.withColumn("has_letter", F.coalesce(F.col("text").rlike(LETTER), F.lit(False))), model, [*columns, "has_letter"])
    lowest = F.array_min("entropies")
    place = F.array_position("entropies", lowest)
    names = F.array(*[F.lit(lang) for lang in langs])
    most = F.array(*[F.lit(limits[lang]) for lang in langs])
    spread = F.aggregate("entropies", F.lit(0.0), lambda total, x: total + F.exp((lowest - x) * temperature))
    has = F.col("has_letter")
    return scored.select(
        *columns, F.when(has, F.element_at(names, place.cast("int"))).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(has, 1 / spread).otherwise(0.0).alias("score"), F.when(has, lowest).alias("bits"),
        (has & (lowest <= F.element_at(most, place.cast("int")))).alias("accepted"))
