"""Records of a run: its manifest, the texts it compared, settings it refuses, differences of lines, made-up training lines."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = Sequence[str]


def manifest(results: DataFrame, dataset: str, metrics: Keys, **about: str) -> DataFrame:
    """(manifest): one row of JSON with ``about``, the images of each dataset in order of name, all images and each metric's
    mean to three places. Without results there are no datasets, no images and no means."""
    each = results.groupBy(dataset).agg(F.count(F.lit(1)).alias("images"), *[F.struct(F.sum(m).alias("sum"), F.count(m).alias("n")).alias(f"__{m}") for m in metrics])

    def mean(m: str) -> Column:
        n = F.sum(f"__{m}.n")
        return F.when(n > 0, F.format_string("%.3f", F.sum(f"__{m}.sum").cast("double") / n))

    sets = F.array_sort(F.collect_list(F.struct(F.col(dataset).alias("name"), "images")))
    whole = each.agg(sets.alias("datasets"), F.coalesce(F.sum("images"), F.lit(0)).alias("image_count"), F.struct(*[mean(m).alias(m) for m in metrics]).alias("aggregates"))
    return whole.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in about.items()], "datasets", "image_count", "aggregates")).alias("manifest"))


def compared_text(name: Column, score: Column, truth: Column, found: Column) -> Column:
    """What a person reads of one page of a run: its name and score, the text that was expected and the text that was found."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    # The headings of the format.
    return F.concat(F.lit("=== "), empty(name), F.lit(" ===\nDocument_CER: "), empty(score), F.lit("\n\n--- GROUND TRUTH (pooled) ---\n"), empty(truth), F.lit("\n\n--- OCR PREDICTION (pooled) ---\n"), empty(found), F.lit("\n"))


def refusal(settings: Column, known: Keys, engines: Keys) -> Column:
    """Why ``settings`` (map of strings) is refused, or null: the first of unknown names, an unknown engine, a resolution that
    is neither "auto" nor a positive whole number, and a page range that ends before it starts. What is not given is not refused."""
    unknown = F.array_sort(F.array_except(F.map_keys(settings), F.array(*map(F.lit, known))))
    engine, dpi = settings["ocr_engine_key"], settings["dpi"]
    first, last = settings["page_start"].try_cast("int"), settings["page_end"].try_cast("int")
    return (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown settings: "), F.array_join(unknown, ", ")))
        .when(~engine.isin(*engines), F.concat(F.lit("unknown engine: "), engine))
        .when((dpi != "auto") & ~F.coalesce(dpi.try_cast("int") > 0, F.lit(False)), F.concat(F.lit("invalid dpi: "), dpi))
        .when(last < first, F.lit("page range ends before it starts"))
    )


@F.pandas_udf(T.StringType())
def line_diff(raw: pd.Series, corrected: pd.Series) -> pd.Series:
    """Differences of two texts line by line, "- ", "+ ", "  " and "? " before each line; null counts as empty. Its time grows
    faster than the lines that differ, so it is for pages, not for corpora."""
    lines = lambda t: (t or "").splitlines()
    return pd.Series(["\n".join(difflib.ndiff(lines(a), lines(b))) for a, b in zip(raw, corrected, strict=True)], dtype=object)


def curriculum(spark: SparkSession, n: int, units: Keys, seed: int = 0) -> DataFrame:
    """(id, kind, text): ``n`` lines to train a recogniser on; 30 % units, 25 % percents, 20 % whole numbers of which a fifth are
    small and the others grouped, 15 % long decimals, 10 % Khmer digits. A line follows from its id and the seed alone."""
    draw = lambda what, most: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what)), F.lit(most))
    band = draw("band", 100)
    kind = F.when(band < 30, "unit").when(band < 55, "percent").when(band < 75, "whole").when(band < 90, "decimal").otherwise("khmer")
    digits = lambda c, k: F.lpad(c.cast("string"), k, "0")
    percent = F.concat(F.element_at(F.array(F.lit(""), F.lit("-"), F.lit("+")), draw("sign", 3).cast("int") + 1), draw("a", 100), F.lit("."), digits(draw("b", 100), 2), F.lit("%"))
    whole = F.when(draw("small", 5) == 0, (draw("a", 999) + 1).cast("string")).otherwise(F.format_number(draw("b", 98_999_001) + 1000, 0))
    decimal = F.concat(draw("a", 1000), F.lit("."), digits(draw("b", 100_000), 5))
    khmer = F.translate((draw("a", 9999) + 1).cast("string"), "0123456789", "០១២៣៤៥៦៧៨៩")
    unit = F.element_at(F.array(*map(F.lit, units)), draw("unit", len(units)).cast("int") + 1)
    text = F.when(F.col("kind") == "unit", unit).when(F.col("kind") == "percent", percent).when(F.col("kind") == "whole", whole).when(F.col("kind") == "decimal", decimal).otherwise(khmer)
    return spark.range(n).withColumn("kind", kind).withColumn("text", text)
