"""Mixing sources to target weights by hash thresholds.

A source's target is a number of words.  Whole passes over the source are taken
first; the rest of the budget becomes a threshold on a hash of the document, so
a smaller budget always takes a subset of a larger one, and the mix is a filter
without a sort.  The threshold comes from histograms: words per source and hash
bucket, and again inside the one bucket where the budget ends, until that
bucket holds a single document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridtrack.session import stage

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits from id and text; rows equal in both share it."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """Targets of ``sources(source, source_size)``, one row per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  They share all
    words by weight, but none gets more than ``MOST`` times its own: the target is
    ``least(MOST * size, weight * level)`` with the level at which targets add up.
    Adds ``copies``, the whole passes, and ``budget``, the words beyond them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("source_no", F.row_number().over(by_name) - 1).select(
        "source", "source_no", "source_size", (F.col("source_no") % 3 + 1).cast("double").alias("weight"),
        (F.col("source_size") * MOST).cast("double").alias("most"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    levels = weighed.select(
        "*", (F.col("most") / F.col("weight")).alias("full_at"),
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(everything)
    targets = levels.select(
        "source", "source_no", "source_size", "most", F.least("most", F.col("weight") * level["level"]).alias("target"))
    copies = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    return targets.select(
        "source", "source_no", "source_size", "target", copies.cast("int").alias("copies"),
        F.when(copies >= MOST, 0.0).otherwise(F.col("target") - copies * F.col("source_size")).alias("budget"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source_no, threshold)``: hashes up to the threshold add up to the source's budget.

    ``rows`` has ``source_no``, ``size`` and ``hash``.  The document on which the
    budget ends is taken when at least half of it fits.  A source without a
    budget has no row.
    """
    open_ = stage(
        targets.where("budget > 0").select("source_no", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest")),
        "mix-budgets")
    inside = rows.where("size > 0")
    for depth in range(1, LEVELS + 1):
        bucket = F.shiftright("hash", BITS * (LEVELS - depth))
        cells = inside.withColumn("bucket", bucket)
        held = cells.groupBy("source_no", "bucket").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("source_no").orderBy("bucket")
        summed = held.join(open_, "source_no").withColumn("upto", F.sum("held").over(upto))
        ends = summed.where("upto >= rest").groupBy("source_no").agg(
            F.min(F.struct("bucket", "held", "n", (F.col("rest") - F.col("upto") + F.col("held")).alias("rest"))).alias("end"))
        ends = stage(ends.select("source_no", "end.*"), "mix-ends")
        open_ = ends.select("source_no", F.col("bucket").alias("prefix"), "rest")
        if depth == LEVELS or ends.where("n > 1").isEmpty():
            break
        inside = stage(
            cells.join(ends.select("source_no", "bucket"), ["source_no", "bucket"]).drop("bucket"), "mix-boundary")
    width = BITS * (LEVELS - depth)
    low = F.shiftleft(F.col("bucket"), width)
    return ends.select(
        "source_no", F.when(F.col("rest") * 2 >= F.col("held"), low + F.lit(2**width - 1)).otherwise(low - 1).alias("threshold"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, hash)`` of every row, as a stage table."""
    return stage(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id"), F.col("text")).alias("hash")), "mix-rows")


def mix_plan(rows: DataFrame) -> DataFrame:
    """``(mix_source, source_size, target, copies, threshold)``, one row per source of ``rows``."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sources), "mix-targets")
    numbered = rows.join(targets.select("source_no", F.col("source").alias("named")), F.col("source").eqNullSafe(F.col("named")))
    ends = thresholds(numbered.select("source_no", "size", "hash"), targets)
    return stage(targets.join(ends, "source_no", "left").select(
        F.col("source").alias("mix_source"), "source_size", "target", "copies",
        F.coalesce("threshold", F.lit(-1)).alias("threshold")), "mix-plan")


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, hash, source_size, target, copies)`` for every row of ``docs(doc_id, text, source)``.

    ``copies`` says how often the mix takes the document, 0 to ``MOST``.  A null
    text has no words; a null source is a source, the last one.  Rows equal in id
    and text are taken alike.  Documents without words are taken like the others
    of their hash, and count nothing.  Reruns agree, as only contents decide.
    """
    rows = mix_rows(docs)
    taken = rows.join(mix_plan(rows), F.col("source").eqNullSafe(F.col("mix_source")))
    return taken.select(
        "doc_id", "source", "size", "hash", "source_size", "target",
        (F.col("copies") + (F.col("hash") <= F.col("threshold")).cast("int")).alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as the mix takes it."""
    plan = mix_plan(mix_rows(docs)).select("mix_source", F.col("copies").alias("mix_copies"), F.col("threshold").alias("mix_threshold"))
    hashed = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("source").alias("mix_of"),
        mix_hash(F.col("doc_id"), F.col("text")).alias("mix_hash"))
    taken = hashed.join(plan, F.col("mix_of").eqNullSafe(F.col("mix_source"))).withColumn(
        "times", F.col("mix_copies") + (F.col("mix_hash") <= F.col("mix_threshold")).cast("int")).where("times > 0")
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*kept)
