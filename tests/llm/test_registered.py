"""Registered queries against their SQL, and the pipeline against its stages."""

from pathlib import Path

import pytest

import corpus_pipeline
from gridtrack.llm import queries
from tests.llm import tables

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    tables.documents(spark)
    link = duckdb.connect()
    for file in Path(tables.DATA).glob("*.parquet"):
        link.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = link.execute(queries.ORACLE[name])
    names = sorted(x[0] for x in want.description)
    order = [[x[0] for x in want.description].index(n) for n in names]
    rows = sorted((tuple(row[i] for i in order) for row in want.fetchall()), key=str)
    got = queries.registered()[name](spark, tables.DATA)
    assert sorted(got.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == rows


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.registered()) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Every stage takes away what its decision says, and nothing else."""
    docs = tables.documents(spark)
    scores = {r["doc_id"]: r["score"] for r in queries.op3_toxicity(spark, tables.DATA).collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, tables.DATA)
    clean.write.mode("overwrite").parquet(path := _folder(spark, "clean"))
    clean = spark.read.parquet(path)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}

    single = corpus_pipeline.drop_near_duplicates(spark, clean, tables.DATA)
    from gridtrack.llm import jaccard
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(clean, 5, 80).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values()))

    items = spark.read.parquet(f"{tables.DATA}/benchmark.parquet").collect()
    left = corpus_pipeline.drop_contaminated(spark, clean, tables.DATA)
    assert left.columns == docs.columns and left.count() < clean.count()
    folded = {r["doc_id"]: " ".join(tables.word_list(r["text"])) for r in left.collect()}
    passages = [" ".join(tables.word_list(i["text"])) for i in items]
    assert not any(p in text for text in folded.values() for p in passages)

    mixed = corpus_pipeline.mix_sources(spark, left, tables.DATA)
    assert mixed.columns == docs.columns
    final = corpus_pipeline.write_token_files(spark, mixed, tables.DATA)
    assert final.count() == mixed.count()


def _folder(spark, name):
    from gridtrack.session import shared_dir

    return f"{shared_dir(spark)}/test-{name}"
