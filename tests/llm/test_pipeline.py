"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from loamgrid.llm import packing


#: Names that stages might use themselves.
EXTRA = ("lang_pred", "__tokens", "__between", "__key", "__0", "n_hit", "items", "node", "component_id")


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    body = lambda k: " ".join(f"{'the le der'.split()[k % 3]} word{k}x{i} text{(i * 7 + k) % 50}" for i in range(40))
    token = hashlib.sha1(b"x").hexdigest()
    passage = "one two three four five six seven eight nine ten eleven twelve"
    texts = {1: body(1), 2: body(1) + " end", 3: body(2), 4: f"{body(4)} {passage} {body(5)}", 5: "12345 --- !!!", 6: None, 7: f'{body(6)} token = "{token}" more', 8: "", 9: body(3)}
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in texts.items()] + [(9, texts[9], "en", "s", len(texts[9]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", F.col("doc_id").alias("score"), *[F.concat(F.lit("own "), F.col("doc_id").cast("string")).alias(c) for c in EXTRA])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == docs.columns
            rows = at.collect()
            kept[name] = {r["doc_id"]: r["text"] for r in rows}
            assert all(r["score"] == r["doc_id"] and all(r[c] == f"own {r['doc_id']}" for c in EXTRA) for r in rows)
            assert at.schema["score"].dataType == docs.schema["score"].dataType
    assert set(kept["language"]) == {1, 2, 3, 4, 7, 9}
    a, b = shingles(texts[1]), shingles(texts[2])
    assert len(a & b) / len(a | b) >= 0.8 and set(kept["near_duplicates"]) == {1, 3, 4, 7, 9}
    assert set(kept["benchmarks"]) == {1, 3, 7, 9}
    assert kept["secrets"][7] == re.sub(token, "[SECRET]", texts[7]) and kept["secrets"][1] == texts[1]
    encode = packing.byte_bpe()
    want = {i: len(encode([t])[0]) + 1 for i, t in kept["secrets"].items()}
    assert {r["doc_id"]: r["doc_tokens"] for r in at.collect()} == want
    assert sum(r["length"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sum(want.values())


def test_repeated_ids_keep_their_clean_texts(spark):
    body = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    rows = [(2, body(1)), (5, body(1) + " end"), (5, body(2)), (5, body(2)), (5, body(3)), (6, body(3) + " end"), (7, ""), (None, body(1)), (None, body(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(-1, body(1)), (-1, body(1)), (2, body(1)), (5, body(2)), (5, body(3)), (7, "")]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in got.collect()) == want


def test_empty_input(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
