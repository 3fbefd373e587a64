"""Join-shaped operators: nearest, positional, by unique fingerprint, by vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import text as tx

Keys = Sequence[str]


def nearest(left: DataFrame, right: DataFrame, by: Keys, a: Sequence[str], b: Sequence[str], key: str, within: float) -> DataFrame:
    """``left`` with the nearest of ``right`` in the same group by city-block distance, under ``within``; ties to the smaller key.

    Groups (pages) are small; the join is an equi-join on them.
    """
    distance = sum((F.abs(F.col(f"l.{x}") - F.col(f"r.{y}")) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    met = left.alias("l").join(right.alias("r"), list(by)).withColumn("distance", distance).where(F.col("distance") < within)
    return met.groupBy(*by, *[F.col(f"l.{c}").alias(c) for c in left.columns if c not in by]).agg(F.min(F.struct("distance", F.col(f"r.{key}").alias(key))).alias("m")).select(*left.columns, F.col(f"m.{key}").alias(f"nearest_{key}"), "m.distance")


def contested(matched: DataFrame, by: Keys, key: str) -> DataFrame:
    """Matches whose target is claimed more than once."""
    return matched.withColumn("claims", F.count(F.lit(1)).over(Window.partitionBy(*by, key))).where("claims > 1")


def zipped(left: DataFrame, right: DataFrame, by: Keys, left_order: Keys, right_order: Keys, whole: bool = False) -> DataFrame:
    """Rows of the same rank within a group, to the end of the shorter side; ``whole``: only groups of equal length."""
    rank = lambda d, o: d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*o)) - 1)
    a, b = rank(left, left_order), rank(right, right_order)
    if whole:
        n = lambda d, c: d.groupBy(*by).agg(F.count(F.lit(1)).alias(c))
        same = n(left, "x").join(n(right, "y"), list(by)).where("x = y").select(*by)
        a = a.join(same, list(by), "left_semi")
    return a.join(b, [*by, "rank"])


def fingerprints(cells: DataFrame, by: Keys, least: int = 2) -> DataFrame:
    """(by..., row_id, print): a row's numbers, digits folded, in order; rows with fewer than ``least`` have none."""
    n = cells.where(tx.is_plain_number(F.col("text"))).groupBy(*by, "row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", tx.fold_numeric(F.col("text")).alias("v")))), lambda x: x["v"]).alias("p"))
    return n.where(F.size("p") >= least).select(*by, "row_id", F.array_join("p", "|").alias("print"))


def unique_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once on either side."""
    once = lambda d: d.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(key)
    return left.join(once(left), key, "left_semi").join(right.join(once(right), key, "left_semi"), key)


def corrected(cells: DataFrame, lexicon: DataFrame, least: int = 0) -> DataFrame:
    """Texts replaced by the lexicon's (key without white space, label), others kept."""
    key = F.regexp_replace(F.col("text"), r"(?U)\s", "")
    return cells.withColumn("key", key).join(lexicon, "key", "left").withColumn("text", F.coalesce("label", "text")).drop("key", "label")


def column_votes(truth: DataFrame, raw: DataFrame, by: Keys) -> DataFrame:
    """(by..., col_id, raw_col, votes): for each true column the raw column that agrees in most rows; the leftmost of several."""
    t = truth.where("text <> ''").select(*by, "row_id", "col_id", "text")
    r = raw.select(*by, "row_id", F.col("col_id").alias("raw_col"), "text")
    votes = t.join(r, [*by, "row_id", "text"]).groupBy(*by, "col_id", "raw_col").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(*by, "col_id").agg(F.max_by("raw_col", F.struct("votes", -F.col("raw_col"))).alias("raw_col"), F.max("votes").alias("votes"))


def mapped(template: DataFrame, raw: DataFrame, mapping: DataFrame, by: Keys) -> DataFrame:
    """Template labels, with the numbers of the mapped raw columns in their places."""
    moved = mapping.join(raw.select(*by, "row_id", F.col("col_id").alias("raw_col"), F.col("text").alias("seen")), [*by, "raw_col"])
    both = template.join(moved.select(*by, "row_id", "col_id", "seen"), [*by, "row_id", "col_id"], "left")
    return both.withColumn("text", F.when(tx.is_plain_number(F.col("seen")), F.col("seen")).otherwise(F.col("text"))).drop("seen")


def fidelity(truth: DataFrame, made: DataFrame, by: Keys) -> DataFrame:
    """(col_id, n, exact): agreement of numbers by column."""
    place = [*by, "row_id", "col_id"]
    both = truth.where(tx.is_plain_number(F.col("text"))).select(*place, F.col("text").alias("t")).join(made.select(*place, F.col("text").alias("m")), place, "left")
    return both.groupBy("col_id").agg(F.count(F.lit(1)).alias("n"), F.avg(tx.fold_numeric(F.col("t")).eqNullSafe(tx.fold_numeric(F.col("m"))).cast("double")).alias("exact"))


def without_any(rows: DataFrame, column: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` holds none of the given parts."""
    return rows.where(~F.exists(F.array(*[F.lit(p) for p in parts]).cast("array<string>"), lambda p: F.contains(F.col(column), p)))


def overlapping(rows: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    return rows.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted])))


def mapped_label(c: Column, known: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), c), F.lit(default))


def same_order_union(*parts: DataFrame) -> DataFrame:
    """All rows with ``part`` from 0; columns that a part lacks are null."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
