"""Operators on tables in long form: (keys..., row_id, col_id, text, ...), one row for each cell.

``by`` names the columns that identify a table. Order is carried by ordinals;
nothing depends on the physical order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as tx

Keys = Sequence[str]


def last_write(cells: DataFrame, by: Keys, order: str) -> DataFrame:
    """One cell for each place: of several, the one with the largest ``order``."""
    w = Window.partitionBy(*by, "row_id", "col_id").orderBy(F.desc(order))
    return cells.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def dense(cells: DataFrame, by: Keys) -> DataFrame:
    """Every place up to each table's largest row and column, blank where no cell is."""
    size = cells.groupBy(*by).agg(F.max("row_id").alias("__r"), F.max("col_id").alias("__c"))
    places = size.select(*by, F.explode(F.sequence(F.lit(0), "__r")).alias("row_id"), "__c").select(*by, "row_id", F.explode(F.sequence(F.lit(0), "__c")).alias("col_id"))
    return places.join(cells.select(*by, "row_id", "col_id", "text"), [*by, "row_id", "col_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def grids(cells: DataFrame, by: Keys) -> DataFrame:
    """(by..., grid): each table as an array of rows; a grid is bounded by its own table."""
    rows = cells.groupBy(*by, "row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "text"))), lambda x: x["text"]).alias("r"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "r"))), lambda x: x["r"]).alias("grid"))


def wide(cells: DataFrame, by: Keys, columns: int) -> DataFrame:
    """(by..., row_id, c0, c1, ...): columns beyond ``columns`` are left out, missing cells are blank."""
    picks = [F.coalesce(F.max(F.when(F.col("col_id") == i, F.col("text"))), F.lit("")).alias(f"c{i}") for i in range(columns)]
    return cells.groupBy(*by, "row_id").agg(*picks)


def row_lengths(cells: DataFrame, by: Keys) -> DataFrame:
    return cells.groupBy(*by, "row_id").agg(F.count(F.lit(1)).alias("length"))


def majority_length(cells: DataFrame, by: Keys) -> DataFrame:
    """(by..., majority, n_rows): the most frequent row length; of several, the one met first."""
    n = row_lengths(cells, by).groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    return n.groupBy(*by).agg(F.min_by("length", F.struct(-F.col("n"), F.col("first"))).alias("majority"), F.sum("n").alias("n_rows"))


def ragged(cells: DataFrame, by: Keys, least_rows: int = 3) -> DataFrame:
    """Cells of rows whose length is not the table's majority, in tables of ``least_rows`` rows and more."""
    odd = row_lengths(cells, by).join(majority_length(cells, by), list(by)).where((F.col("n_rows") >= least_rows) & (F.col("length") != F.col("majority")))
    return cells.join(odd.select(*by, "row_id"), [*by, "row_id"], "left_semi")


def repair(cells: DataFrame, by: Keys) -> DataFrame:
    """Adds blank cells to rows shorter than the majority; long rows and odd column numbers stay. ``added`` marks the new ones."""
    short = row_lengths(cells, by).join(majority_length(cells, by), list(by)).where("length < majority")
    missing = short.select(*by, "row_id", F.explode(F.sequence(F.lit(0), (F.col("majority") - 1).cast("int"))).alias("col_id")).join(cells, [*by, "row_id", "col_id"], "left_anti")
    return cells.withColumn("added", F.lit(False)).unionByName(missing.withColumn("text", F.lit("")).withColumn("added", F.lit(True)), allowMissingColumns=True)


def numeric_columns(cells: DataFrame, by: Keys, share: float = 0.70) -> DataFrame:
    """(by..., col_id, parsed, filled): columns of which enough body cells (below row 0) are numbers."""
    body = cells.where((F.col("row_id") > 0) & (F.trim("text") != ""))
    n = body.groupBy(*by, "col_id").agg(F.count(tx.parse_number(F.col("text"))["value"]).alias("parsed"), F.count(F.lit(1)).alias("filled"))
    return n.where(F.col("parsed") / F.col("filled") >= share)


def unparseable(cells: DataFrame, by: Keys) -> DataFrame:
    """Filled body cells of numeric columns that are no numbers."""
    odd = cells.where((F.col("row_id") > 0) & (F.trim("text") != "") & tx.parse_number(F.col("text"))["value"].isNull())
    return odd.join(numeric_columns(cells, by), [*by, "col_id"], "left_semi")


def total_mismatch(cells: DataFrame, by: Keys, is_total: Column, value: Column, is_percent: Column, blank: Column | None = None, tolerance: float = 0.5) -> DataFrame:
    """(by..., row_id, col_id, total, expected): totals that differ from the sum of the rows since the last total.

    Every total row begins a new stretch, whatever stands in it. In a stretch
    blank cells are passed over, percentages do not count towards the sum, and a
    text that is no number (``value`` null) makes the stretch undecidable.
    """
    c = cells.select(*by, "row_id", "col_id", is_total.alias("__t"), value.alias("__v"), F.coalesce(is_percent, F.lit(False)).alias("__p"), (F.lit(False) if blank is None else F.coalesce(blank, F.lit(False))).alias("__b"))
    before = Window.partitionBy(*by, "col_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__part", F.coalesce(F.sum(F.col("__t").cast("int")).over(before), F.lit(0)))
    body = ~F.col("__t") & ~F.col("__b")
    part = c.groupBy(*by, "col_id", "__part").agg(
        F.coalesce(F.sum(F.when(body & ~F.col("__p"), F.col("__v"))), F.lit(0.0)).alias("expected"), F.count_if(body).alias("filled"), F.count_if(body & F.col("__v").isNull()).alias("odd"),
        F.max(F.when(F.col("__t"), F.col("__v"))).alias("total"), F.max(F.when(F.col("__t"), F.col("row_id"))).alias("row_id"),
    )
    return part.where((F.col("filled") > 0) & (F.col("odd") == 0) & (F.abs(F.col("total") - F.col("expected")) > tolerance)).select(*by, "row_id", "col_id", "total", "expected")


def without_title(cells: DataFrame, by: Keys) -> DataFrame:
    """Without row 0 where only its first cell has text, and rows counted anew."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    title = cells.where("row_id = 0").groupBy(*by).agg(F.max(F.when((F.col("col_id") == 0) & ~blank, 1).otherwise(0)).alias("lead"), F.sum(F.when((F.col("col_id") > 0) & ~blank, 1).otherwise(0)).alias("others")).where("lead = 1 AND others = 0").select(*by, F.lit(1).alias("__title"))
    out = cells.join(title, list(by), "left").where("NOT (__title IS NOT NULL AND row_id = 0)")
    return out.withColumn("row_id", F.col("row_id") - F.coalesce("__title", F.lit(0))).drop("__title")


def stitched_groups(widths: DataFrame, document: str, order: str, columns: str, tolerance: int = 1) -> DataFrame:
    """``widths`` with ``part``: consecutive tables of a document join while their width is within ``tolerance`` of the
    part's first table, not of the one before. One fold over each document's table widths."""
    w = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(columns).alias("c"))))
    start = F.struct(F.lit(-1).alias("part"), F.lit(None).cast("long").alias("anchor"), F.array().cast("array<struct<o:bigint,part:int>>").alias("out"))

    def step(at: Column, x: Column) -> Column:
        joins = at["anchor"].isNotNull() & (F.abs(x["c"] - at["anchor"]) <= tolerance)
        part = F.when(joins, at["part"]).otherwise(at["part"] + 1)
        return F.struct(part.alias("part"), F.when(joins, at["anchor"]).otherwise(x["c"].cast("long")).alias("anchor"), F.concat(at["out"], F.array(F.struct(x["o"].cast("long").alias("o"), part.alias("part")))).alias("out"))

    folded = widths.groupBy(document).agg(F.aggregate(w, start, step)["out"].alias("x")).select(document, F.explode("x").alias("x")).select(document, F.col("x.o").alias(order), F.col("x.part").alias("part"))
    return widths.withColumn(order, F.col(order).cast("long")).join(folded, [document, order])


def stitched_rows(rows: DataFrame, group: Keys, table: str) -> DataFrame:
    """``rows`` (group..., table, row_id, signature) of stitched tables without blank rows and repeated headers, and ``new_row`` from 0."""
    ordered = Window.partitionBy(*group).orderBy(table, "row_id")
    header = F.first("signature").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lead = F.row_number().over(Window.partitionBy(*group, table).orderBy("row_id")) == 1
    first_table = F.min(table).over(Window.partitionBy(*group))
    out = rows.withColumn("__h", header).withColumn("__l", lead).withColumn("__f", first_table)
    out = out.where(~(F.col("__l") & (F.col(table) > F.col("__f")) & (F.col("signature") == F.col("__h"))) & (F.trim("signature") != ""))
    return out.drop("__h", "__l", "__f").withColumn("new_row", F.row_number().over(ordered) - 1)


def renumbered(rows: DataFrame, by: Keys, order: Keys) -> DataFrame:
    return rows.withColumn("new_row", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def section_of(rows: DataFrame, by: Keys, order: str, marker: Column, default: str = "(preamble/header)") -> DataFrame:
    """``section``: the latest marker at or before each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last(marker, ignorenulls=True).over(w), F.lit(default)))


def quality_flags(cells: DataFrame, by: Keys, share: float = 0.70, least_rows: int = 3) -> DataFrame:
    """(by..., row_id, col_id, text, flag): all findings of all checks, one row for each cell and flag.

    The cells are read once: what numeric columns and usual row lengths are is
    told by windows over them and a small join on the table, not by further scans.
    """
    place = [*by, "row_id", "col_id"]
    filled = (F.col("row_id") > 0) & (F.trim("text") != "")
    number = tx.parse_number(F.col("text"))["value"].isNotNull()
    column, row = Window.partitionBy(*by, "col_id"), Window.partitionBy(*by, "row_id")
    seen = cells.select(*place, "text", "confidence", filled.alias("__filled"), (filled & number).alias("__number"))
    seen = seen.withColumn("__numeric", F.try_divide(F.count_if("__number").over(column), F.count_if("__filled").over(column)) >= share).withColumn("__n", F.count(F.lit(1)).over(row))
    # A table's rows by length, weighing each row once: its first cell stands for it.
    lead = F.row_number().over(row.orderBy("col_id")) == 1
    seen = seen.withColumn("__lead", lead)
    usual = seen.where("__lead").groupBy(*by, "__n").agg(F.count(F.lit(1)).alias("__rows"), F.min("row_id").alias("__first"))
    usual = usual.groupBy(*by).agg(F.min_by("__n", F.struct(-F.col("__rows"), F.col("__first"))).alias("__usual"), F.sum("__rows").alias("__all"))
    flags = F.concat(
        tx.cell_flags(F.col("text"), F.col("confidence")),
        F.when(F.col("__filled") & ~F.col("__number") & F.col("__numeric"), F.array(F.lit("unparseable_number"))).otherwise(F.array().cast("array<string>")),
        F.when((F.col("__all") >= least_rows) & (F.col("__n") != F.col("__usual")), F.array(F.lit("ragged_row"))).otherwise(F.array().cast("array<string>")),
    )
    return seen.join(usual, list(by)).select(*place, "text", F.explode(flags).alias("flag"))


#: Order in which kinds of findings are reported.
FLAGS = ("low_conf", "sequence_illegal", "digit_mixed", "unparseable_number", "ragged_row", "numeric_mismatch")


def flag_summary(flags: DataFrame, by: Keys) -> DataFrame:
    """(by..., flag, n, place): counts by kind, and the kind's place in the report."""
    place = F.array_position(F.array(*[F.lit(f) for f in FLAGS]), F.col("flag"))
    return flags.groupBy(*by, "flag").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place)


def triage(flags: DataFrame, cells: DataFrame, by: Keys) -> DataFrame:
    """(by..., row_id, col_id, reason, rank): each flagged cell once, by its gravest reason; cells with low confidence alone come last."""
    order = F.array(*[F.lit(f) for f in ("numeric_mismatch", "sequence_illegal", "digit_mixed", "unparseable_number", "ragged_row", "low_conf")])
    place = [*by, "row_id", "col_id"]
    worst = flags.groupBy(*place).agg(F.min_by("flag", F.array_position(order, F.col("flag"))).alias("reason"))
    found = worst.join(cells.select(*place, "confidence"), place)
    by_rank = Window.partitionBy(*by).orderBy((F.col("reason") == "low_conf").cast("int"), F.array_position(order, F.col("reason")), F.coalesce("confidence", F.lit(1.0)), "row_id", "col_id")
    return found.withColumn("rank", F.row_number().over(by_rank)).drop("confidence")


def document_json(cells: DataFrame, document: str, table: str) -> DataFrame:
    """(document, json): tables and cells nested in order; missing confidences leave no key."""
    cell = F.struct(F.col("row_id").alias("row"), F.col("col_id").alias("col"), "text", "confidence")
    tables = cells.groupBy(document, table).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return tables.groupBy(document).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col(table).alias("table_index"), "cells"))).alias("tables"))).alias("json"))
