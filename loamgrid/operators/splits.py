"""Leakage-safe data splits and training mixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_clusters(rows: DataFrame, by: Sequence[str], date: str, key: str, gap: int = 1) -> DataFrame:
    """``cluster``: rows whose dates follow within ``gap`` days share one; a row without date stands alone."""
    w = Window.partitionBy(*by, F.col(date).isNull()).orderBy(date, key)
    new = F.col(date).isNull() | F.coalesce(F.datediff(F.col(date), F.lag(date).over(w)) > gap, F.lit(True))
    n = F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cluster", F.concat(F.when(F.col(date).isNull(), "u").otherwise("d"), n.cast("string")))


def clustered_split(rows: DataFrame, stratum: str, cluster: str, order: Column, test: float = 0.10, valid: float = 0.10) -> DataFrame:
    """``split`` of whole clusters within each stratum, in ``order`` (smallest first): test, valid, then train, by
    rounded-down counts; two clusters give one for valid, three one for test as well."""
    c = rows.groupBy(stratum, cluster).agg(F.min(order).alias("__o"))
    n = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    k = F.row_number().over(Window.partitionBy(stratum).orderBy("__o", cluster))
    n_test = F.greatest(F.floor(n * test + 1e-9), F.when(n >= 3, 1).otherwise(0))
    n_valid = F.greatest(F.floor(n * valid + 1e-9), F.when(n >= 2, 1).otherwise(0))
    split = F.when(k <= n_test, "test").when(k <= n_test + n_valid, "valid").otherwise("train")
    return rows.join(c.select(stratum, cluster, split.alias("split")), [stratum, cluster])


def training_mix(sources: dict[str, DataFrame], key: str, order: Column, share: int = 20) -> DataFrame:
    """(source, key, split): all sources; of each, the first ``max(1, n div share)`` in ``order`` are held out."""
    out = None
    for name, d in sources.items():
        part = d.select(F.lit(name).alias("source"), F.col(key).cast("long").alias(key))
        out = part if out is None else out.unionByName(part)
    k = F.row_number().over(Window.partitionBy("source").orderBy(order, key))
    n = F.count(F.lit(1)).over(Window.partitionBy("source"))
    return out.withColumn("split", F.when(k <= F.greatest(F.lit(1), F.floor(n / share)), "val").otherwise("train"))
