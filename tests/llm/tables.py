"""Small documents tables with everything that can be odd about them."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata/sf0.001"

# names that operators use for themselves
CLASHING = "score int, matches string, text_hash string, hash int, size string, group_id string, spans int, slot string, c0 string, mix_hash int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
EXTRA = (7, "m", "t", 7, "s", "g", 7, "v", "c", 7)


def prose(seed: int, words: int) -> str:
    """Sentences of invented words."""
    rng = random.Random(seed)
    out = []
    for i in range(words):
        word = "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "sta", "ver", "tho"]) for _ in range(rng.randint(1, 4)))
        out.append(word + ("." if i % 9 == 8 else ""))
    return " ".join(out)


LONG = prose(1, 60_000)

ROWS = [
    (1, prose(2, 80), "xx", "a", 1), (2, prose(2, 80), "xx", "a", 1), (2, prose(2, 80), "xx", "a", 1),
    (3, prose(2, 80).upper(), "xx", "b", 1), (4, None, None, None, None), (5, "", "yy", "b", 0), (5, "", "yy", "b", 0),
    (6, " \n\t ", "yy", None, 4), (None, prose(3, 40), "yy", "c", 5), (None, None, None, "c", None),
    (7, "word", "yy", "a", 4), (8, "12 34 !?", None, "a", 8), (9, LONG, "xx", "b", len(LONG)),
    (10, prose(4, 30), "yy", "", 3), (10, prose(5, 30), "yy", "", 3), (11, "naïve Ünï€ödé    x 日本語。 テスト", "yy", "c", 9),
]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, *EXTRA) for row in ROWS], SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def texts(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def documents(spark: SparkSession) -> DataFrame:
    if not Path(DATA).exists():
        pytest.skip("driver tables are not here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def word_list(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
