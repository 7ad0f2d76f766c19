"""Exact duplicate removal by skew-safe combining, in DataFrame functions only.

Texts are combined three times, each time by digest *and* full content: inside
a task (the partial aggregate), per salted digest group, and over the salts.  A
group of any size reaches the last step as at most ``salts`` rows.  The winners
then go back to the rows by digest.  A digest that belongs to several contents
would make that join ambiguous; the combined table shows such digests, and
their rows are joined by full content instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridtrack.llm.skew import join_groups
from gridtrack.session import stage

SALTS = 16
# fixed values: the letters whose case is ignored
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null counts as empty; only A-Z are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Of equal texts the row with the largest ``doc_id`` is kept; a null id is
    smaller than any other.  Of several rows with that same id one is kept.  Null
    texts are empty texts.  Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("content"))
    rows = rows.withColumn("text_sha256", F.sha2("content", 256))

    contents = _combine(rows, salts)
    winners = stage(contents.drop("content"), "dedup-winners")
    members = stage(rows.drop("content"), "dedup-members")
    total = members.count()
    shared = winners.groupBy("text_sha256").count().where("count > 1").select("text_sha256")
    ambiguous = not shared.isEmpty()

    if not ambiguous:
        joined = join_groups(members, winners, ["text_sha256"], "group_size", total)
    else:
        clear = winners.join(shared, "text_sha256", "left_anti")
        mixed = rows.join(shared, "text_sha256", "left_semi").join(contents, ["text_sha256", "content"])
        joined = join_groups(members, clear, ["text_sha256"], "group_size", total).unionByName(mixed.drop("content"))

    same = Window.partitionBy("text_sha256", "keep_id", "doc_id").orderBy(F.lit(0))
    return joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1)).alias("kept"),
        "text_sha256",
    )


def _combine(rows: DataFrame, salts: int) -> DataFrame:
    """One row per content, combined per task, per salted group and over the salts."""
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("text_sha256", "content", "salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("text_sha256", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
