"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.staging import free, shared_dir, ship, stored

__all__ = ["aside", "free", "held_out", "met_by", "remainder", "shared_dir", "ship", "slices", "small", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df``, a narrow stored table, marked for broadcast if it has ``rows`` rows at most; beyond, joins with it shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def met_by(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, an aggregate over the whole number ``key``, by that key.

    The join compares the key's complement, so that both sides have shuffles of
    their own: Spark can then split a crowded key, which it cannot do where a
    side is still dealt out for its aggregate.
    """
    apart = found.withColumn("~", F.bitwise_not(key)).drop(key)
    return rows.withColumn("~", F.bitwise_not(key)).join(apart, "~", how).drop("~")


def remainder(doc_id, by: int):
    """crc32 of doc_id as text, modulo ``by``: the fixed split into training and held-out rows; null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % F.lit(by)


def held_out(doc_id, by: int, rest: int):
    """Whether a row is held out: its remainder is ``rest``, or it has no doc_id, in which case nothing is learned from it either."""
    return F.coalesce(remainder(doc_id, by) == rest, F.lit(True))


def aside(docs: DataFrame, *keep: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with neutral names for all columns but ``keep``, so that none clashes with what an operator adds, and
    the function that selects these columns, and more by name, from a result and gives them their own names back."""
    names = [c if c in keep else f"__{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out, *more: out.select(*names, *more).toDF(*docs.columns, *more)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` texts hold about ``most_bytes``; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)
