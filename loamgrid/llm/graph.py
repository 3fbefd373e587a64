"""Connected components: alternating large-star and small-star steps in DataFrames, and small graphs at once in the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import met_by, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: every neighbour above u is tied to u's least; small: every one below."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = met_by(both, least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _print(edges: DataFrame) -> tuple:
    """Number and combined hashes of distinct edges: equal for equal sets, whatever their order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


#: A graph of so many edges at most (16 bytes each) goes to the driver: rounds of shuffles would cost far more than its few megabytes.
_FEW = 1 << 18


def _at_once(edges: pa.Table) -> pa.Table:
    """components() of a table of edges (u, v): least labels of neighbours, with paths to them cut short, until none changes."""
    u, v = (edges.column(c).to_numpy() for c in ("u", "v"))
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root, before = np.arange(len(ids)), None
    while before is None or not np.array_equal(root, before):
        before, x, y = root, root[a], root[b]
        root, low = root.copy(), np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(further := root[root], root):
            root = further
    return pa.table({"node": pa.array(ids, pa.int64()), "component": pa.array(ids[root], pa.int64())})


def components(links: DataFrame, few: int = _FEW) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b), whole numbers; the component is its smallest node.

    Nulls and self-links are left aside; an empty table gives an empty one. More
    than ``few`` edges, copies counted, are joined in rounds, each written to the
    shared folder, so a lost executor costs that round.
    """
    edges = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v AND v IS NOT NULL")
    # No more than one above the bound ever leaves the executors.
    if few and (got := edges.limit(few + 1).toArrow()).num_rows <= few:
        return links.sparkSession.createDataFrame(_at_once(got), "node long, component long")
    edges = stored(edges.distinct())
    before = _print(edges)
    while True:
        edges = stored(_stars(_stars(edges, True), False), [edges])
        after = _print(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
