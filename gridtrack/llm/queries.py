"""The registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrack.llm import (
    collocations, decontaminate, exact_dedup, jaccard, language, licenses, mixing, neighbours, sharding, spans, token_files, toxicity,
    whitening,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def toxic_held_out() -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxic_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(toxic, text)`` of the labelled documents that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return docs.select("doc_id", "text").where(~toxic_held_out()).join(labels, "doc_id").select("toxic", "text")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards of near equal bytes."""
    rows, _ = sharding.shard_by_bytes(documents(spark, sf_dir), shards=16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of those that name theirs."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = language.identify(
        docs.withColumn("held_out", held_out), docs.where(~held_out).select("lang", "text"), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits", "accepted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    docs = documents(spark, sf_dir)
    scored = toxicity.toxicity(
        docs.withColumn("held_out", toxic_held_out()), toxic_labels(spark, docs, sf_dir), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of every group of equal texts, for every document."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence that a document states, and how often; a document of fragments only has one row without a licence."""
    found = licenses.scan_licenses(documents(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.explode_outer("licenses").alias("license", "stated"), "fragments")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that stays after passages which occurred before are removed, and these passages."""
    return spans.remove_repeats(documents(spark, sf_dir), ["doc_id"], both_edges=True)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, over all sources."""
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 85 in 100 shared 4-word shingles."""
    return jaccard.similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_files.token_rows(documents(spark, sf_dir), tokenizer_file())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item of which the document holds a copy, edited ones included."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(documents(spark, sf_dir), items, ["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every fiftieth embedding among all others."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(embeddings, F.col("vec_id") % 50 == 0, k=5)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 4 whitened components of every embedding."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), number=4)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of every language."""
    return collocations.collocations(documents(spark, sf_dir))


Query = Callable[[SparkSession, str], DataFrame]

REGISTERED: list[Query] = [op1_sharding, op2_language, op3_toxicity, op4_exact_dedup, op5_licenses, op6_substring_dedup, op7_mixing, op8_ngram_jaccard, op9_token_files, op10_decontamination,
                           op11_nearest, op12_whitening, op13_collocations]

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256({FOLDED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op5_licenses": licenses.oracle_sql(),
    "op7_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 15))::BIGINT AS hash
          FROM documents),
        s AS (
          SELECT source, source_size, (no % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS most, no
          FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
                FROM d GROUP BY source)),
        l AS (
          SELECT *, most / weight AS full_at,
                 (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
          FROM s WINDOW b AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
          SELECT source, source_size, least(most, weight * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at)) AS target
          FROM l),
        c AS (
          SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS copies FROM t),
        r AS (
          SELECT doc_id, size, source_size, target, copies, hash,
                 CASE WHEN copies >= 3 THEN 0 ELSE target - copies * source_size END AS budget,
                 sum(size) OVER (PARTITION BY d.source ORDER BY hash) AS upto
          FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target,
               (size * (copies + CASE WHEN budget > 0 AND upto - size < budget
                                       AND (upto < budget OR (budget - upto + size) * 2 >= size) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM r
    """,
}

ORACLE["op8_ngram_jaccard"] = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
    r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
    SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(r.y)) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = w.doc_id GROUP BY w.doc_id
"""

ORACLE["op13_collocations"] = rf"""
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({FOLDED}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
      FROM documents),
    s AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p WHERE len(w) > 0),
    f AS (
      SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words, count(*) AS f
      FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
    c AS (
      SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w, unnest(generate_series(1, words - 1)) AS k FROM f WHERE words > 1),
    x AS (
      SELECT c.lang, c.phrase, c.words, c.a, c.k, l.f AS l, r.f AS r, n.n,
             ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM c JOIN n USING (lang)
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
    best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    sub AS (
      SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
      FROM (SELECT lang, w, words, a, m, unnest(generate_series(1, words - m + 1)) AS i
            FROM (SELECT DISTINCT lang, w, words, a, unnest(generate_series(2, words - 1)) AS m FROM c))),
    kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (
      SELECT 1 FROM sub WHERE sub.lang = b.lang AND sub.phrase = b.phrase AND 100 * sub.a >= 100 * b.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a,
           l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
    FROM kept QUALIFY rank <= 2000
"""


def registered() -> dict[str, Query]:
    return {query.__name__: query for query in REGISTERED}
