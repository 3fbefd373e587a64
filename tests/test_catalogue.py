"""Each analytics query against its SQL twin, and the streaming variant against the batch one."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import text as tx
from loamgrid.plans import catalogue
from loamgrid.streaming import folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    return sorted(df[columns].astype(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(want) == rows(got)
    else:
        assert len(got)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES


def test_stream_equals_batch(spark, tmp_path):
    names = [c.split()[0] for c in folder.CELLS.split(", ")]
    d = spark.range(200).select(F.lit("d").alias(names[0]), F.lit(0).alias(names[1]), F.lit(0).alias(names[2]), F.col("id").cast("int").alias(names[3]), F.lit(0).alias(names[4]), F.when(F.col("id") % 5 == 0, "1២").otherwise("x").alias(names[5]), (F.col("id") % 100 / 100).alias(names[6]), F.timestamp_seconds(F.col("id") * 60).alias(names[7]))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    flags = lambda b: b.select("row_id", F.explode(tx.cell_flags(F.col("text"), F.col("confidence"))).alias("flag"))
    folder.each_batch(folder.cells(spark, str(tmp_path / "in"), 1), flags, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("row_id", "flag")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, flags(d).collect()))
    counted = folder.flag_counts(folder.cells(spark, str(tmp_path / "in")))
    q = counted.writeStream.format("memory").queryName("flag_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("flag_counts").agg(F.sum("n")).first()[0] == flags(d).count()
