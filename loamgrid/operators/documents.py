"""Pages, regions and engines: text of a page, what is kept of what an engine reports, and engines that may fail."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.functions import text as tx

Keys = Sequence[str]


def page_text(blocks: DataFrame, by: Keys, order: Keys, fixes: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """(by..., page_text, foreign): the cleaned blocks of a page in order, a blank line between, and the foreign characters that went."""
    clean = tx.clean_khmer(F.col("text"))
    for wrong, right in fixes.items():
        clean = F.replace(clean, F.lit(wrong), F.lit(right))
    rows = blocks.withColumn("__c", clean).withColumn("__s", tx.strip_foreign(F.col("__c")))
    kept = F.array_sort(F.collect_list(F.struct(*order, "__s")))
    joined = F.array_join(F.filter(F.transform(kept, lambda x: x["__s"]), lambda x: x != ""), "\n\n")
    return rows.groupBy(*by).agg(joined.alias("page_text"), F.sum(tx.foreign_count(F.col("__c"))).alias("foreign"))


def overlay_band(confidence: Column) -> Column:
    """Colours of the text overlay: a missing confidence counts as none at all."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= 0.8, "good").when(c >= 0.5, "fair").otherwise("poor")


def trusted_layout(boxes: DataFrame, least: float) -> DataFrame:
    """Boxes of enough confidence; a missing one, and a zero, count as certain."""
    c = F.coalesce("confidence", F.lit(1.0))
    return boxes.where(F.when(c == 0, 1.0).otherwise(c) >= least)


def nonempty(cells: DataFrame, by: Keys) -> DataFrame:
    """(by...) of the tables with any text."""
    return cells.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(*by).distinct()


def scored_or_skipped(truth: DataFrame, guess: DataFrame, key: Keys) -> DataFrame:
    """(key..., status): pages of the truth that a prediction exists for, and those that are skipped."""
    return truth.select(*key).join(guess.select(*key).distinct().withColumn("__g", F.lit(1)), list(key), "left").select(*key, F.when(F.col("__g").isNotNull(), "scored").otherwise("skipped").alias("status"))


def with_fallback(rows: DataFrame, regions: DataFrame, key: Keys, column: str, default: Column) -> DataFrame:
    """``rows`` with ``column`` from ``regions`` where the key has one, the default elsewhere."""
    return rows.join(regions.select(*key, F.col(column).alias("__found")), list(key), "left").withColumn(column, F.coalesce("__found", default)).drop("__found")


def ctc_confidence(best: Column, blank: Column) -> Column:
    """Mean of the best scores over the steps that are not blank; 0 if all are. ``best``: array of (symbol, score)."""
    kept = F.transform(F.filter(best, lambda x: x["symbol"] != blank), lambda x: x["score"].cast("double"))
    return F.when(F.size(kept) == 0, 0.0).otherwise(F.aggregate(kept, F.lit(0.0), lambda n, x: n + x) / F.size(kept))


def blank_bands(rows: DataFrame, by: Keys, order: Keys, blank: Column) -> DataFrame:
    """(by..., bands): runs of blank lines."""
    before = F.lag(blank).over(Window.partitionBy(*by).orderBy(*order))
    marked = rows.select(*by, (blank & ~F.coalesce(before, F.lit(False))).alias("__b"))
    return marked.groupBy(*by).agg(F.count_if("__b").alias("bands"))


def in_reading_order(boxes: DataFrame, by: Keys, x: str, y: str, tie: str) -> DataFrame:
    """``boxes`` with ``place`` from 0, from top to bottom, then from left to right."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(y, x, tie)) - 1)


def numbered_cells(cells: DataFrame, by: Keys) -> DataFrame:
    """``cells`` with ``cell_id`` from 0, row by row."""
    return cells.withColumn("cell_id", F.row_number().over(Window.partitionBy(*by).orderBy("row_id", "col_id")) - 1)


def largest_table(cells: DataFrame, page: str, table: str, least: int) -> DataFrame:
    """(page, table, n): the table with most cells of each page, the first of several, if it has ``least`` or more."""
    n = cells.groupBy(page, table).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(page).agg(F.max_by(F.struct(table, "n"), F.struct(F.col("n"), -F.col(table))).alias("b"))
    return best.select(page, F.col(f"b.{table}").alias(table), F.col("b.n").alias("n")).where(F.col("n") >= least)


def scan_density(images: DataFrame, page: str, coverage: float = 0.5) -> DataFrame:
    """(page, covered, dpi, scanned) from (page, page_area, width, height, pixels, no): the largest placed image decides.

    Sizes are in points, 72 to an inch; a page is a scan if that image covers enough of it.
    """
    area = F.col("width") * F.col("height")
    top = images.groupBy(page).agg(F.max_by(F.struct((area / F.col("page_area")).alias("covered"), (F.col("pixels") / (F.col("width") / 72)).alias("dpi")), F.struct(area, -F.col("no"))).alias("b"))
    return top.select(page, F.col("b.covered").alias("covered"), F.col("b.dpi").alias("dpi"), (F.col("b.covered") >= coverage).alias("scanned"))


def outcomes(rows: DataFrame, status: Column, of: Sequence[str]) -> DataFrame:
    """(status, n): rows by outcome; outcomes that do not occur count 0."""
    every = rows.sparkSession.createDataFrame([(s,) for s in of], "status string")
    return every.join(rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n")), "status", "left").na.fill(0, ["n"])


Engine = Callable[[pd.DataFrame], pd.Series]
_ENGINES: dict[str, Engine] = {}


def register_engine(name: str, make: Engine) -> None:
    """Makes an engine known by name: a function from a batch of pages to a text for each."""
    _ENGINES[name] = make


def engine(name: str) -> Engine:
    """The engine of that name; an unknown one is an error that tells which there are."""
    if name not in _ENGINES:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(sorted(_ENGINES))}")
    return _ENGINES[name]


def recognised(pages: DataFrame, name: str, batch: int = 64) -> DataFrame:
    """``pages`` with ``text`` and ``warning`` of an engine that gets ``batch`` rows at a time.

    Set-up fails fast: an unknown engine raises at once. A page that the engine
    fails on gets an empty text and the reason as warning; its batch is read
    again page by page, so the others keep theirs. Order and number of rows stay.
    """
    run = engine(name)
    names = [c for c in pages.columns if c not in ("text", "warning")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(part: pd.DataFrame) -> tuple[str, str | None]:
            try:
                return str(run(part).iloc[0]), None
            except Exception as e:  # noqa: BLE001  a page's failure is data
                return "", traceback.format_exception_only(e)[-1].strip()

        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                try:
                    got = [(str(x), None) for x in run(part)]
                    if len(got) != len(part):
                        raise ValueError("not one text for each page")
                except Exception:  # noqa: BLE001
                    got = [one(part.iloc[i : i + 1]) for i in range(len(part))]
                yield part[names].assign(text=[t for t, _ in got], warning=[w for _, w in got])

    kept = [pages.schema[c] for c in names]
    return pages.mapInPandas(each, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("warning", T.StringType())]))
