"""Edits, reviews and keyed overlays on tables, pages and settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as tx


def apply_edits(cells: DataFrame, edits: DataFrame, table: str = "table_id") -> DataFrame:
    """An edited table replaces the original whole, its confidences included; ``edited`` tells which."""
    kept = cells.join(edits.select(table).distinct(), table, "left_anti").withColumn("edited", F.lit(False))
    return kept.unionByName(edits.withColumn("edited", F.lit(True)), allowMissingColumns=True)


def overlay(base: DataFrame, changes: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """``column`` from ``changes`` where the key has one."""
    return base.join(changes.select(*key, F.col(column).alias("__new")), list(key), "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def genuine_changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., old, new): cells on both sides whose texts differ as training labels."""
    both = before.select(*key, F.col("text").alias("old")).join(after.select(*key, F.col("text").alias("new")), list(key))
    return both.where(~tx.training_equivalent(F.col("old"), F.col("new")))


def grid_diff(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., old, new, change): added, removed and changed cells."""
    both = before.select(*key, F.col("text").alias("old")).join(after.select(*key, F.col("text").alias("new")), list(key), "full")
    both = both.where(~F.col("old").eqNullSafe(F.col("new")))
    return both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))


def latest(log: DataFrame, key: Sequence[str], version: str, keep: int = 1) -> DataFrame:
    """The newest ``keep`` versions of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return log.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= keep).drop("__k")


def insert_row(cells: DataFrame, at: int) -> DataFrame:
    return cells.withColumn("row_id", F.when(F.col("row_id") >= at, F.col("row_id") + 1).otherwise(F.col("row_id")))


def delete_row(cells: DataFrame, by: Sequence[str], at: int) -> DataFrame:
    """Without row ``at``, later rows moved up; a table's only row stays."""
    n = cells.groupBy(*by).agg(F.max("row_id").alias("__last"))
    out = cells.join(n, list(by)).where((F.col("row_id") != at) | (F.col("__last") == 0)).drop("__last")
    return out.withColumn("row_id", F.when(F.col("row_id") > at, F.col("row_id") - 1).otherwise(F.col("row_id")))


def replaced(cells: DataFrame, find: str, put: str) -> DataFrame:
    """Cells in which ``find`` occurs, with ``replacements`` and the new text; none for an empty search."""
    out = cells.withColumn("replacements", tx.replace_count(F.col("text"), find)).where("replacements > 0")
    return out.withColumn("text", F.replace(F.col("text"), F.lit(find), F.lit(put)))


def reading_order(blocks: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """Non-blank blocks with ``place`` from 0 in reading order."""
    w = Window.partitionBy(*by).orderBy(order)
    return blocks.where(F.trim("text") != "").withColumn("place", F.row_number().over(w) - 1)


def label_of(region: Column, label: Column, default: str) -> Column:
    """The region's label even if blank, else the block's; the default for what is blank."""
    got = F.trim(F.coalesce(region, label, F.lit("")))
    return F.when(got == "", F.lit(default)).otherwise(got)


def _absent_from(known: Column):
    return lambda k, _: ~F.map_contains_key(known, k)


def settings(default: Column, *layers: Column) -> Column:
    """Maps laid over ``default``, later ones first; keys that the default does not have are dropped."""
    out = default
    for layer in layers:
        known = F.map_filter(F.coalesce(layer, F.create_map().cast("map<string,string>")), lambda k, _: F.map_contains_key(default, k))
        out = F.map_concat(F.map_filter(out, _absent_from(known)), known)
    return out


def overrides(default: Column, used: Column) -> Column:
    return F.size(F.filter(F.map_keys(default), lambda k: ~F.element_at(used, k).eqNullSafe(F.element_at(default, k))))


def queue_counters(documents: DataFrame) -> DataFrame:
    """(pending, unverified) over (status, total, reviewed)."""
    return documents.agg(F.count_if(F.col("status").isin("queued", "error")).alias("pending"), F.coalesce(F.sum(F.when(F.col("status") == "done", F.greatest(F.col("total") - F.col("reviewed"), F.lit(0)))), F.lit(0)).alias("unverified"))


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def resumed(rows: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done, list(key), "left_anti")


def page_scope(pages: DataFrame, by: Sequence[str], page: str, count: str) -> DataFrame:
    """(by..., scope, first, last): the shortest description of a set of pages."""
    g = pages.groupBy(*by).agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count_distinct(page).alias("n"), F.max(count).alias("__all"))
    whole = F.col("n") == F.col("__all")
    one_run = F.col("last") - F.col("first") + 1 == F.col("n")
    return g.select(*by, F.when(whole, "all").when(F.col("n") == 1, "single").when(one_run, "range").otherwise("list").alias("scope"), "first", "last")
