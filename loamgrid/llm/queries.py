"""The thin queries over the driver's tables, one for each corpus operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import ann, decontamination, jaccard_join, langid, maxent_lm, packing, secrets, sharding, surrogates, toxicity
from loamgrid.llm.common import held_out, remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence; see packing.pack for nulls, repeats and empty tables."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; see jaccard_join.near_duplicates."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document; see decontamination.hits."""
    return decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op9_cross_parsing_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; rows without doc_id are held out. See langid.predict."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op8_weighted_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows without doc_id are held out. See toxicity.score."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = remainder(F.col("doc_id"), 4)
    model = toxicity.fit(docs.where(fold != 2), labels.where(fold != 2))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "hits")


def op7_rotated_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one; see ann.search."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; see sharding.shard."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets of every document; see secrets.Scanner.findings."""
    return secrets.Scanner(spark).findings(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced; see surrogates.replace."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, surrogates.Surrogates(key="corpus-round"))


def op4_hashed_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model score of every document; rows without doc_id are held out. See maxent_lm.fit_and_score."""
    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 10)
    out = maxent_lm.fit_and_score(docs, docs.where(fold != 0))
    return out.select("doc_id", held_out(F.col("doc_id"), 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_cost_balanced_packing,
        op2_ngram_jaccard_join,
        op10_benchmark_decontamination,
        op9_cross_parsing_language_id,
        op8_weighted_lexicon_toxicity,
        op7_rotated_one_bit_search,
        op3_hilbert_sharding,
        op6_forest_secret_scan,
        op5_pii_surrogates,
        op4_hashed_maxent_lm,
    )
}
#: A-Z only; DuckDB's lower() would also fold other letters.
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, least(i + 4, len(ws))), ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
        SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1""",
    "op10_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        bw AS (SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS g
               FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
        dw AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
               FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
        m AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
