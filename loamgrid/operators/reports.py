"""Reports, routing rules and smaller ordered computations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import geometry as geo

Keys = Sequence[str]


def page_scope_expand(kind: Column, first: Column, last: Column, listed: Column, count: Column) -> Column:
    """Page indices from 0 of a scope: all, single, range or list of pages from 1; out of bounds is clamped or dropped."""
    inside = lambda a: F.filter(F.array_sort(F.array_distinct(a)), lambda p: (p >= 0) & (p < count))
    lo, hi = F.greatest(F.least(first, last), F.lit(1)), F.least(F.greatest(first, last), count)
    none = F.array().cast("array<int>")
    span = F.when(lo <= hi, F.sequence(lo - 1, hi - 1)).otherwise(none)
    return F.when(kind == "all", F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(none)).when(kind == "single", inside(F.array(first - 1))).when(kind == "range", span).otherwise(inside(F.transform(listed, lambda p: p - 1)))


def signature(*parts: Column) -> Column:
    """One text for a set of settings: equal settings, equal text; missing parts stay apart from blank ones."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])


def effective_choice(warning: Column) -> Column:
    """What an automatic choice came to, from its warning (fixed value: its form); null if it does not say."""
    got = F.regexp_extract(warning, r"^\[AutoRouter\] (?:re-)?routed to (\w+)", 1)
    return F.when(got != "", got)


def masked(value: Column, metric: str, scope: Column, masks: dict[str, Sequence[str]]) -> Column:
    """A metric, null where the scoring scope does not cover it."""
    out = value
    for name, metrics in masks.items():
        if metric in metrics:
            out = F.when(scope.eqNullSafe(F.lit(name)), F.lit(None)).otherwise(out)
    return out


def circular(rows: DataFrame, by: Keys, drafted_by: str, engine: str) -> DataFrame:
    """(by..., circular, provisional): whether a group scores an engine against truth that the engine drafted, or unchecked truth."""
    return rows.groupBy(*by).agg(F.coalesce(F.bool_or(F.col(drafted_by) == F.col(engine)), F.lit(False)).alias("circular"), F.bool_or(F.col(drafted_by).isNotNull()).alias("provisional"))


def preprocessing(scans: DataFrame, by: Keys, blur: str, contrast: str, skew: str) -> DataFrame:
    """(by..., sharpen, enhance, deskew) from the median blur and contrast and the largest skew of a document's pages."""
    return scans.groupBy(*by).agg((F.median(blur) < 100).alias("sharpen"), (F.median(contrast) < 40).alias("enhance"), (F.max(F.abs(F.col(skew))) > 2.5).alias("deskew"))


def wording_tier(skew: Column, ink: Column, deviation: Column) -> Column:
    """How a scan is described: by its worst trait first."""
    return F.when(F.abs(skew) > 2.5, "tilted").when(ink > 0.05, "stained").when(deviation < 40, "faint").otherwise("clean")


def route_regions(regions: DataFrame, by: Keys, order: str, label: str, text: str) -> DataFrame:
    """Regions without pictures, with ``kind`` and a reading order from 0 over the texts that are not empty."""
    kept = regions.where(F.col(label) != "Picture").withColumn("kind", F.when(F.col(label) == "Table", "table").otherwise("text"))
    counts = (F.col("kind") == "text") & (F.trim(text) != "")
    n = F.sum(counts.cast("int")).over(Window.partitionBy(*by).orderBy(order))
    return kept.withColumn("reading_order", F.when(counts, n - 1))


def document_summary(tables: DataFrame, reviews: DataFrame, by: Keys, key: Keys) -> DataFrame:
    """(by..., tables, reviewed, status): tables of a document and how many were verified."""
    met = tables.join(reviews.where("verified").select(*key).distinct().withColumn("__ok", F.lit(1)), list(key), "left")
    out = met.groupBy(*by).agg(F.count(F.lit(1)).alias("tables"), F.count("__ok").alias("reviewed"))
    return out.withColumn("status", F.when(F.col("reviewed") == 0, "open").when(F.col("reviewed") < F.col("tables"), "partial").otherwise("done"))


def class_report(rows: DataFrame, kind: str, pages: str) -> DataFrame:
    """(kind, documents, pages, rank): counts by class, the most frequent first."""
    n = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("documents"), F.sum(pages).alias("pages"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("documents"), kind)))


def with_mean_row(wide: DataFrame, key: str, columns: Keys, name: str = "MEAN") -> DataFrame:
    """A pivoted table and below it the mean of each column over its measured rows."""
    mean = wide.agg(*[F.avg(c).alias(c) for c in columns]).select(F.lit(name).alias(key), *columns)
    return wide.select(key, *columns).unionByName(mean)


def best_strip(rows: DataFrame, by: Keys, filled: str, order: str) -> DataFrame:
    """The row of each group with the most filled cells; the first of several."""
    w = Window.partitionBy(*by).orderBy(F.desc(filled), order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def band_offsets(bands: DataFrame, by: Keys, order: str, rows: str) -> DataFrame:
    """``offset``: where a band's rows begin when bands are laid one below the other; an empty band takes one row."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return bands.withColumn("offset", F.coalesce(F.sum(F.greatest(F.col(rows), F.lit(1))).over(before), F.lit(0)))


def segment_offsets(segments: DataFrame, by: Keys, order: str, text: str, separator: int = 2) -> DataFrame:
    """``start`` and ``end`` of each segment in the joined text."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + separator).over(before), F.lit(0))
    return segments.withColumn("start", start).withColumn("end", start + F.length(text))


def longest_run(rows: DataFrame, by: Keys, order: str, test: Column) -> DataFrame:
    """(by..., longest, n, runs): the longest stretch of rows that pass, all rows, and the number of stretches."""
    own = Window.partitionBy(*by).orderBy(order)
    flagged = rows.withColumn("__t", F.coalesce(test, F.lit(False))).withColumn("__new", (F.col("__t") & ~F.coalesce(F.lag("__t").over(own), F.lit(False))).cast("int"))
    numbered = flagged.withColumn("__run", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*by, "__run").agg(F.count_if("__t").alias("__len"), F.count(F.lit(1)).alias("__n"), F.max("__new").alias("__real"))
    return runs.groupBy(*by).agg(F.max("__len").alias("longest"), F.sum("__n").alias("n"), F.sum("__real").alias("runs"))


def next_in_band(rows: DataFrame, by: Keys, order: str) -> DataFrame:
    """``next``: the key that follows in the group; after the last the first."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("next", F.coalesce(F.lead(order).over(w), F.min(order).over(Window.partitionBy(*by))))


def covered_as_one(regions: DataFrame, by: Keys, box: str, share: float) -> DataFrame:
    """(by..., cover, one): the largest region's part of the box around all, and whether it stands for all."""
    b = F.col(box)
    g = regions.groupBy(*by).agg(F.max(geo.area(b)).alias("__a"), geo.union_of(b).alias("__u"))
    cover = F.when(geo.area(F.col("__u")) > 0, F.col("__a") / geo.area(F.col("__u"))).otherwise(F.lit(0.0))
    return g.select(*by, cover.alias("cover"), (cover >= share).alias("one"))


def chunk_confidence(chunks: DataFrame, by: Keys, order: str, text: str, confidence: str) -> DataFrame:
    """(by..., text, confidence): chunks joined in order; the weakest decides."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return chunks.groupBy(*by).agg(joined.alias("text"), F.min(confidence).alias("confidence"))


def silent_epochs(rows: DataFrame, by: Keys, failures: str, total: str, score: str) -> DataFrame:
    """(by...): groups without a score in which everything that was tried failed; nothing tried proves nothing."""
    g = rows.groupBy(*by).agg(F.sum(failures).alias("__f"), F.sum(total).alias("__t"), F.count(score).alias("__s"))
    return g.where("__s = 0 AND __f = __t").select(*by)


def spans_merged(proposals: DataFrame, by: Keys, order: str, row: str, first: str, last: str) -> DataFrame:
    """Proposals over consecutive cells of one row, greedily: a proposal goes through if none before it took one of its cells.

    One fold over the proposals of a table, which are few.
    """
    p = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(row).alias("r"), F.col(first).alias("a"), F.col(last).alias("b"))))

    def take(got: Column, x: Column) -> Column:
        clash = F.exists(got, lambda g: (g["r"] == x["r"]) & (g["a"] <= x["b"]) & (x["a"] <= g["b"]))
        return F.when(clash | (x["b"] <= x["a"]), got).otherwise(F.concat(got, F.array(x)))

    kinds = proposals.schema
    empty = F.array().cast("array<struct<" + ",".join(f"{n}:{kinds[c].dataType.simpleString()}" for n, c in (("o", order), ("r", row), ("a", first), ("b", last))) + ">>")
    out = proposals.groupBy(*by).agg(F.aggregate(p, empty, take).alias("x")).select(*by, F.explode("x").alias("x"))
    return out.select(*by, F.col("x.o").alias(order), F.col("x.r").alias(row), F.col("x.a").alias(first), F.col("x.b").alias(last))


def template_filled(template: str, **parts: Column) -> Column:
    """A title with its parts put in; null if a part is missing."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def two_row_header(upper: Column, lower: Column) -> Column:
    """One header of two rows: upper cells hold to the right until the next; both texts where both are."""
    start = F.struct(F.lit("").alias("seen"), F.array().cast("array<string>").alias("out"))
    pairs = F.zip_with(upper, lower, lambda u, v: F.struct(F.coalesce(u, F.lit("")).alias("u"), F.coalesce(v, F.lit("")).alias("v")))

    def step(at: Column, x: Column) -> Column:
        seen = F.when(x["u"] != "", x["u"]).otherwise(at["seen"])
        return F.struct(seen.alias("seen"), F.concat(at["out"], F.array(F.trim(F.concat_ws(" ", F.nullif(seen, F.lit("")), F.nullif(x["v"], F.lit("")))))).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def split_row_number(text: Column) -> Column:
    """struct(number, rest): a leading row number in either script, where words follow it."""
    pattern = r"(?U)^([០-៩0-9]+)\s+(\S.*)$"
    number = F.regexp_extract(text, pattern, 1)
    return F.struct(F.when(number != "", number).alias("number"), F.when(number != "", F.regexp_extract(text, pattern, 2)).otherwise(text).alias("rest"))


def sheet_numbers(sheets: DataFrame, by: Keys, order: str, name: str) -> DataFrame:
    """``sheet``: names made unique by _2, _3, ... within 31 characters."""
    k = F.row_number().over(Window.partitionBy(*by, F.lower(name)).orderBy(order))
    mark = F.concat(F.lit("_"), k.cast("string"))
    return sheets.withColumn("sheet", F.when(k == 1, F.col(name)).otherwise(F.concat(F.substring(F.col(name), F.lit(1), 31 - F.length(mark)), mark)))


def flag_rows(flags: DataFrame, by: Keys, page: str) -> DataFrame:
    """(by..., page, row, col, flag): findings counted from 1 for people; the page of a stitched table is blank."""
    return flags.select(*by, F.coalesce((F.col(page) + 1).cast("string"), F.lit("")).alias("page"), (F.col("row_id") + 1).alias("row"), (F.col("col_id") + 1).alias("col"), "flag")


def page_banner(blocks: DataFrame, tables: DataFrame, by: Keys, confidence: str) -> DataFrame:
    """(by..., low, tables, hint): blocks under 0.5, missing ones included, tables, and whether they look like pieces of one."""
    low = blocks.groupBy(*by).agg(F.count_if(F.coalesce(F.col(confidence), F.lit(0.0)) < 0.5).alias("low"))
    n = tables.groupBy(*by).agg(F.count(F.lit(1)).alias("tables"))
    out = low.join(n, list(by), "left").withColumn("tables", F.coalesce("tables", F.lit(0)))
    return out.withColumn("hint", F.col("tables") > 1)


def crops_checked(crops: DataFrame, box: str, width: str, height: str) -> DataFrame:
    """``sound``: the crop is as large as its box."""
    b = F.col(box)
    return crops.withColumn("sound", (b[2] - b[0] == F.col(width)) & (b[3] - b[1] == F.col(height)))


def text_report(pages: DataFrame, document: str, page: str, text: str, title: str = "Page") -> DataFrame:
    """(document, report): pages in order, each under its heading."""
    part = F.concat(F.lit(f"--- {title} "), (F.col(page) + 1).cast("string"), F.lit(" ---\n"), F.coalesce(F.col(text), F.lit("")))
    return pages.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), part.alias("t")))), lambda x: x["t"]), "\n\n").alias("report"))


def paragraph_kind(text: Column) -> Column:
    """``section`` if it carries a unit mark, ``row`` if it begins with a row number, else ``note``."""
    return F.when(F.contains(text, F.lit("/-")), "section").when(split_row_number(text)["number"].isNotNull(), "row").otherwise("note")


def placed(texts: DataFrame, places: DataFrame, by: Keys, order: str, column: str) -> DataFrame:
    """(by..., column, text): texts of a row in its cells by their own places where the counts agree, else by rank, clamped to the last."""
    own = Window.partitionBy(*by).orderBy(order)
    t = texts.withColumn("__k", F.row_number().over(own) - 1)
    p = places.groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias("__at"))
    met = t.join(p, list(by))
    return met.select(*by, F.get("__at", F.least(F.col("__k"), F.size("__at") - 1)).alias(column), "text")
