"""A corpus from raw documents to packed sequences: five stages, each one operator of loamgrid.llm.

Each stage reads what its predecessor kept and wrote. All but the last return
the columns of ``documents``; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import decontamination, jaccard_join, langid, packing, secrets
from loamgrid.llm.common import aside, ship, small, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is found; those without any letter, null ones included, go.

    The language found takes the place of a null ``lang``. It is learned from
    the labelled documents; if none is labelled, documents are kept as they are.
    """
    ship(spark)
    model = langid.fit(docs)
    if not model.languages:
        return docs
    rows, back = aside(docs, "text", "lang")
    found = langid.annotate(rows, model).where("lang_pred <> 'und'")
    return back(found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest doc_id.

    Rows that repeat a doc_id are told apart by their texts: of those with equal
    texts one is kept, and a text goes only if it is a near duplicate itself.
    Documents without words and those with a null doc_id link with nothing; the
    latter all stay.
    """
    ship(spark)
    repeated = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        found = jaccard_join.near_duplicates(docs)
        gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct())
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    docs, back = aside(docs, "doc_id", "text")
    rows = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = jaccard_join.near_duplicates(rows.select(F.col("__key").alias("doc_id"), "text"))
    of = found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    of = stored(of.join(rows.where("doc_id IS NOT NULL").select("__key", "doc_id").distinct(), "__key"))
    first = of.groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("first")).select(F.col("first.__key").alias("__key"))
    gone = stored(of.join(first, "__key", "left_anti").select("__key"))
    once = rows.where("doc_id IS NOT NULL").dropDuplicates(["__key"]).unionByName(rows.where("doc_id IS NULL"))
    return back(once.join(small(gone), "__key", "left_anti"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of a benchmark item."""
    ship(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in every text; documents stay, and n_chars follows the text."""
    ship(spark)
    out = secrets.Scanner(spark).redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences; a row for each piece."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmarks", benchmarks),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: SQL can neither train the language model or the forest nor tokenize; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what one returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


