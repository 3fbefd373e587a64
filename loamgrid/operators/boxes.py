"""Boxes on pages: which touch, and what they form together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import geometry as geo


def touching(boxes: DataFrame, page: str, key: str, pad: float) -> DataFrame:
    """(page, a, b) with a < b: boxes (page, key, box) of a page that meet once both are inflated by ``pad``."""
    own = boxes.select(page, F.col(key).alias("k"), geo.inflate(F.col("box"), pad).alias("w"))
    met = own.alias("x").join(own.alias("y"), [page]).where((F.col("x.k") < F.col("y.k")) & geo.intersects(F.col("x.w"), F.col("y.w")))
    return met.select(page, F.col("x.k").alias("a"), F.col("y.k").alias("b"))


def components(boxes: DataFrame, page: str, key: str, pad: float) -> DataFrame:
    """(page, component, n, box): connected boxes of a page and the box around them; component is its smallest key.

    Pages are small, so the closure is one fold over a page's links: each joins two sets.
    """
    links = touching(boxes, page, key, pad).groupBy(page).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("links"))
    nodes = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.col(key))).alias("keys"))
    start = F.transform("keys", lambda k: F.struct(k.alias("k"), k.alias("c")))

    def join(labels, link):
        of = lambda k: F.filter(labels, lambda x: x["k"] == k)[0]["c"]
        lo, hi = F.least(of(link["a"]), of(link["b"])), F.greatest(of(link["a"]), of(link["b"]))
        return F.transform(labels, lambda x: F.struct(x["k"].alias("k"), F.when(x["c"] == hi, lo).otherwise(x["c"]).alias("c")))

    whole = nodes.join(links, page, "left").withColumn("links", F.coalesce("links", F.array().cast(links.schema["links"].dataType)))
    labels = whole.select(page, F.explode(F.aggregate("links", start, join)).alias("x")).select(page, F.col("x.k").alias(key), F.col("x.c").alias("component"))
    return boxes.join(labels, [page, key]).groupBy(page, "component").agg(F.count(F.lit(1)).alias("n"), geo.union_of(F.col("box")).alias("box"))


def bands(boxes: DataFrame, page: str, pad: float) -> DataFrame:
    """(page, band, n, box): boxes whose vertical ranges overlap or lie within ``pad``, by a running maximum."""
    by = Window.partitionBy(page).orderBy(F.col("box")[1], F.col("box")[3], F.col("box")[0], F.col("box")[2])
    reach = F.max(F.col("box")[3]).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = boxes.withColumn("__new", F.when(reach.isNull() | (F.col("box")[1] - reach > pad), 1).otherwise(0))
    banded = fresh.withColumn("band", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return banded.groupBy(page, "band").agg(F.count(F.lit(1)).alias("n"), geo.union_of(F.col("box")).alias("box"))
