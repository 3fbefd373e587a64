"""Summaries of evaluation runs and other grouped statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.staging import stored

Keys = Sequence[str]


def number(c: Column) -> Column:
    """A measured value: blank or malformed text is missing, "0.000" counts."""
    return F.trim(c).try_cast("double")


def summary_sets(runs: DataFrame, keys: Keys, metrics: Keys, numerator: str, denominator: str) -> DataFrame:
    """(key, value, n, mean_*, ratio): one pass for all groupings, each by one key; a missing key is the group ''.

    Means skip what was not measured and are 0 where nothing was; so is a ratio with nothing below.
    """
    keyed = runs.select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], *[number(F.col(m)).alias(m) for m in metrics], number(F.col(numerator)).alias("__a"), number(F.col(denominator)).alias("__b"))
    aggs = [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}") for m in metrics], F.coalesce(F.sum("__a") / F.nullif(F.sum("__b"), F.lit(0.0)), F.lit(0.0)).alias("ratio")]
    sets = keyed.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("__g"), *aggs)
    key = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, k in enumerate(keys):  # the bit of a key is clear where it groups
        here = F.shiftright("__g", len(keys) - 1 - i).bitwiseAND(1) == 0
        key, value = F.when(here, F.lit(k)).otherwise(key), F.when(here, F.col(k)).otherwise(value)
    return sets.select(key.alias("key"), value.alias("value"), "n", *[f"mean_{m}" for m in metrics], "ratio")


def extremes(rows: DataFrame, by: Keys, metric: str, order: str, pick: str) -> DataFrame:
    """(by..., best, worst): the row with the largest and smallest metric; of several, the first by ``order``."""
    return rows.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.max_by(pick, F.struct(F.col(metric), -F.col(order))).alias("best"), F.min_by(pick, F.struct(F.col(metric), F.col(order))).alias("worst"))


def group_mean(rows: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, mean): blank keys are dropped; null where nothing was measured."""
    return rows.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.avg(number(F.col(metric))).alias("mean"))


def mean_matrix(rows: DataFrame, key: str, across: str, values: Keys, metric: str) -> DataFrame:
    """(key, value...): means pivoted over given values; null where a combination is absent."""
    return rows.where(F.coalesce(key, F.lit("")) != "").groupBy(key).pivot(across, list(values)).agg(F.avg(number(F.col(metric))))


def median_spread(rows: DataFrame, by: Keys, metric: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.median(metric).alias("median"), (F.max(metric) - F.min(metric)).alias("spread"), F.count(metric).alias("n"))


def conditional_counts(rows: DataFrame, by: Keys, **tests: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()])


def stability(rows: DataFrame, by: Keys, dims: str, metric: str) -> DataFrame:
    """(by..., mean, dims, stable): the distinct dims of all runs, and whether they agree."""
    seen = F.sort_array(F.collect_set(dims))
    return rows.groupBy(*by).agg(F.avg(metric).alias("mean"), F.array_join(seen, ",").alias("dims"), (F.count_distinct(dims) == 1).alias("stable"))


def discrete_percentiles(rows: DataFrame, by: Keys, value: str, tenths: Sequence[int] = (1, 9)) -> DataFrame:
    """(by..., n, p10, p90): the element at n * tenth div 10 of the sorted values, counted from 0; no group is gathered."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = rows.select(*by, value, (F.row_number().over(w) - 1).alias("k"), n.alias("n"))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("k") == F.floor(F.col("n") * t / 10), F.col(value))).alias(f"p{t}0") for t in tenths])


def low_share(rows: DataFrame, by: Keys, value: str, least: float, limit: float) -> DataFrame:
    """(by..., share, reroute): pooled share below ``least`` of what has a value, 0 without any, and whether it exceeds ``limit``."""
    g = rows.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(value).isNotNull(), (F.col(value) < least).cast("double"))), F.lit(0.0)).alias("share"))
    return g.withColumn("reroute", F.col("share") > limit)


def without_conflicts(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): keys with one distinct value only."""
    return pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__hi")).where(F.col(value) == F.col("__hi")).drop("__hi")


def repeated(rows: DataFrame, by: Keys) -> DataFrame:
    """(by..., n): groups of several distinct rows."""
    return rows.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def share_table(rows: DataFrame, by: Keys, across: str, values: Keys) -> DataFrame:
    """Counts crossed, with ``total``."""
    return rows.groupBy(*by).pivot(across, list(values)).agg(F.count(F.lit(1))).na.fill(0).withColumn("total", sum((F.col(v) for v in values), F.lit(0)))


def line_blocks(words: DataFrame, by: Keys, left: str, text: str, confidence: str) -> DataFrame:
    """(by..., line, x0, mean_conf): words of a line in order, and their mean confidence without -1."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(left, text))), lambda x: x[text]), " ")
    return words.groupBy(*by).agg(ordered.alias("line"), F.min(left).alias("x0"), F.avg(F.when(F.col(confidence) != -1, F.col(confidence))).alias("mean_conf"))


def jitter(rows: DataFrame, by: Keys, order: Keys, x: str, spread: float) -> DataFrame:
    """``x`` moved apart evenly within each group of equal ones."""
    own = Window.partitionBy(*by, x)
    i = F.row_number().over(own.orderBy(*order)) - 1
    return rows.withColumn("moved", F.col(x) + spread * (i - (F.count(F.lit(1)).over(own) - 1) / 2))


def collisions(rows: DataFrame, by: Keys) -> DataFrame:
    """Rows whose label is not theirs alone."""
    return rows.withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("n_same > 1")


def bounded_empties(rows: DataFrame, by: Keys, empty: Column, share: float, order: Keys) -> DataFrame:
    """All filled rows, and the first empty ones up to ``share`` of what remains."""
    flagged = rows.withColumn("__e", empty)
    group = Window.partitionBy(*by)
    filled = F.count_if(~F.col("__e")).over(group)
    k = F.row_number().over(Window.partitionBy(*by, "__e").orderBy(*order))
    allowed = F.floor(filled * share / (1 - share) + 1e-9)
    return flagged.withColumn("__k", k).withColumn("__a", allowed).where(~F.col("__e") | (F.col("__k") <= F.col("__a"))).drop("__e", "__k", "__a")


def running_ids(rows: DataFrame, order: Keys, name: str = "id") -> DataFrame:
    """A gapless id in the given total order: ranges are sorted apart, then offset by the sizes of those before."""
    at = F.monotonically_increasing_id()
    # Written once: ranges cut anew for the second use could differ.
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__own", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__skip", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__skip")).drop("__part", "__own", "__skip")
