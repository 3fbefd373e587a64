"""Shards along a Hilbert curve over several metadata dimensions, by built-in functions only.

Each dimension is quantised to a few bits; the cell's place on the curve orders
the rows, ties by the text's checksum and doc_id, and the order is cut into runs
whose row counts differ by one at most. Files written shard by shard then hold
narrow ranges of every dimension at once, which min/max statistics can prune.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import stored


@dataclass(frozen=True)
class Dimension:
    """A column and how it becomes a cell number: ``log`` (sizes), ``linear`` (between the least and largest value) or ``hash``."""

    column: str
    kind: str = "hash"


#: Metadata that readers of a document table filter by.
DOCUMENTS = (Dimension("size", "log"), Dimension("lang"), Dimension("source"), Dimension("doc_id", "linear"))


def _curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """For each state (entry corner, direction) and set of coordinate bits: the curve's digit, and the next state."""
    mask = (1 << dims) - 1
    turn = lambda x, k: ((x << (k % dims)) | (x >> (dims - k % dims))) & mask
    trailing = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  ones at the low end
    digit, then = [], []
    for state in range(dims << dims):
        entry, way = state % (1 << dims), state >> dims
        for bits in range(1 << dims):
            gray = turn(bits ^ entry, dims - (way + 1) % dims)
            w = gray
            shift = 1
            while shift < dims:
                w ^= w >> shift
                shift *= 2
            start = 0 if w == 0 else (lambda i: i ^ (i >> 1))(2 * ((w - 1) // 2))
            go = 0 if w == 0 else trailing(w - 1 if w % 2 == 0 else w) % dims
            digit.append(w)
            then.append(((way + go + 1) % dims << dims) | (entry ^ turn(start, way + 1)))
    return digit, then


def curve_index(cells: Sequence[Column], bits: int) -> Column:
    """The Hilbert index of non-negative integer ``cells`` of so many bits each."""
    dims = len(cells)
    digit, then = (F.array(*[F.lit(x) for x in xs]) for xs in _curve_steps(dims))
    planes = [sum(((F.shiftright(c.cast("int"), k).bitwiseAND(1) * (1 << i)) for i, c in enumerate(cells)), F.lit(0)) for k in reversed(range(bits))]
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def step(at: Column, plane: Column) -> Column:
        place = at["state"] * (1 << dims) + plane + 1
        return F.struct(F.element_at(then, place).alias("state"), (at["index"] * (1 << dims) + F.element_at(digit, place)).alias("index"))

    return F.aggregate(F.array(*planes), start, step)["index"]


def _cell(d: Dimension, bits: int, low: object, high: object) -> Column:
    """Cell number of a dimension; null has cell 0."""
    top, c = (1 << bits) - 1, F.col(d.column)
    if d.kind == "log":
        cell = F.floor(F.log2(F.greatest(c.cast("double"), F.lit(1.0))) * (top / 40.0))
    elif d.kind == "linear":
        width = float(high - low) if low is not None else 0.0
        cell = F.floor((c.cast("double") - F.lit(float(low or 0))) * ((top + 0.999) / width)) if width > 0 else F.lit(0)
    else:
        cell = F.pmod(F.xxhash64(c.cast("string")), F.lit(top + 1))
    return F.least(F.greatest(F.coalesce(cell, F.lit(0)), F.lit(0)), F.lit(top)).cast("int")


def shard(docs: DataFrame, shards: int = 24, dimensions: Sequence[Dimension] = DOCUMENTS, bits: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for each row of ``docs``.

    size: UTF-8 bytes of the text plus 8. Law ``rows``: counts of shards differ
    by one at most; slot counts from 0 in curve order. Null texts have no bytes,
    nulls in a dimension share its first cell, null doc_ids sort first; repeated
    rows get slots of their own in any order. Columns besides doc_id, text and
    the dimensions are left aside; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wanted = [d.column for d in dimensions if d.column not in ("size", "doc_id")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *wanted)
    linear = [d.column for d in dimensions if d.kind == "linear"]
    ends = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in linear for f in (F.min, F.max)]).first() if linear else {}
    cells = [_cell(d, bits, ends[f"min_{d.column}"] if d.kind == "linear" else None, ends[f"max_{d.column}"] if d.kind == "linear" else None) for d in dimensions]
    rows = rows.select("doc_id", "size", "text_crc32", curve_index(cells, bits).alias("curve"))
    order = ["curve", "text_crc32", "doc_id"]
    # Ranges are cut by the whole key, so one crowded cell or one much copied text still spreads over tasks.
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each task of the sort: as many as Spark has shuffle partitions, whatever the input.
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(every).alias("total"))
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("skip") + F.col("at").bitwiseAND((1 << 33) - 1))
    ranked = ranked.withColumn("shard", F.expr(f"int(rank * {shards}L div total)"))
    first = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write(sharded: DataFrame, path: str) -> None:
    """Writes a folder for each shard, in slot order, for readers that prune by file statistics."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
