"""Queries on the records of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import records as rc
from loamgrid.plans.registry import Registry
from loamgrid.plans.views import view

here = Registry()
C = F.col


@here("""WITH d AS (SELECT o_orderpriority AS name, count(*) AS images FROM orders GROUP BY 1)
    SELECT concat('{"run_id":"r1","engine":"plain","datasets":[', (SELECT string_agg(concat('{"name":"', name, '","images":', images, '}'), ',' ORDER BY name) FROM d),
    '],"image_count":', (SELECT count(*) FROM orders), ',"aggregates":{"last_digit":"', printf('%.3f', (SELECT avg(o_custkey % 10) FROM orders)), '","length":"', printf('%.3f', (SELECT avg(len(o_orderpriority)) FROM orders)), '"}}') AS manifest""")
def run_manifest(spark, sf):
    d = view(spark, sf, "SELECT o_orderpriority, o_custkey % 10 AS last_digit, length(o_orderpriority) AS length FROM orders")
    return rc.manifest(d, "o_orderpriority", ["last_digit", "length"], run_id="r1", engine="plain")


@here("SELECT o_orderkey AS k, concat('=== ', o_orderpriority, ' ===', chr(10), 'Document_CER: ', o_custkey, chr(10), chr(10), '--- GROUND TRUTH (pooled) ---', chr(10), o_orderdate::DATE::VARCHAR, chr(10), chr(10), '--- OCR PREDICTION (pooled) ---', chr(10), nullif(o_orderstatus, 'P'), chr(10)) AS text FROM orders")
def compared_text(spark, sf):
    found = F.when(C("o_orderstatus") != "P", C("o_orderstatus"))
    return view(spark, sf, "orders").select(C("o_orderkey").alias("k"), rc.compared_text(C("o_orderpriority"), C("o_custkey"), C("o_orderdate").cast("date"), found).alias("text"))


@here("""SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'unknown settings: colour, zoom' WHEN p_type LIKE '%STEEL%' THEN concat('unknown engine: ', p_type)
    WHEN p_size % 5 = 0 THEN concat('invalid dpi: ', -p_size) WHEN p_size % 5 = 1 THEN 'invalid dpi: high' WHEN p_size > 30 THEN 'page range ends before it starts' END AS refusal FROM part""")
def settings_refusal(spark, sf):
    d = view(spark, sf, """SELECT p_partkey AS k, map_concat(map('ocr_engine_key', CASE WHEN p_type LIKE '%STEEL%' THEN p_type ELSE 'plain' END,
        'dpi', CASE p_size % 5 WHEN 0 THEN CAST(-p_size AS STRING) WHEN 1 THEN 'high' WHEN 2 THEN 'auto' ELSE '300' END, 'page_start', '30', 'page_end', CAST(60 - p_size AS STRING)),
        CASE WHEN p_partkey % 7 = 0 THEN map('zoom', '2', 'colour', 'red') ELSE map() END) AS s FROM part""")
    return d.select("k", rc.refusal(C("s"), ["ocr_engine_key", "dpi", "page_start", "page_end"], ["plain", "other"]).alias("refusal"))


@here("SELECT p_partkey AS k, concat('  ', p_name, chr(10), CASE WHEN p_size % 2 = 0 THEN '  12345' ELSE concat('- 12345', chr(10), '+ wxyz') END) AS diff FROM part")
def line_diff(spark, sf):
    d = view(spark, sf, "part")
    return d.select(C("p_partkey").alias("k"), rc.line_diff(F.concat("p_name", F.lit("\n12345")), F.concat("p_name", F.when(C("p_size") % 2 == 0, "\n12345").otherwise("\nwxyz"))).alias("diff"))


@here()
def curriculum(spark, sf):
    return rc.curriculum(spark, 10_000, ["kg", "%"])
