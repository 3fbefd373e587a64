"""Queries through readers, writers and round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.operators import joins, overlays
from loamgrid.plans.registry import Registry
from loamgrid.plans.views import view
from loamgrid.sources import io
from loamgrid.staging import shared_dir

here = Registry()
C = F.col


def _folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


@here("SELECT o_orderkey AS id, 'set' || (o_orderkey % 3) AS name FROM orders")
def append_results(spark, sf) -> DataFrame:
    """Rows appended in two overlapping parts, each once."""
    rows = view(spark, sf, "SELECT o_orderkey AS id, concat('set', CAST(o_orderkey % 3 AS STRING)) AS name, o_orderstatus FROM orders")
    path = _folder(spark)
    io.append(rows.where("o_orderstatus <> 'F'").drop("o_orderstatus"), path, ["id"])
    io.append(rows.drop("o_orderstatus"), path, ["id"])
    return spark.read.parquet(path)


@here("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size < 10 THEN 'test' ELSE 'train' END AS split FROM part")
def split_parquet(spark, sf):
    path = _folder(spark)
    io.write_split(view(spark, sf, "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size < 10 THEN 'test' ELSE 'train' END AS split FROM part"), path)
    return spark.read.parquet(path)


@here("SELECT event_id, event_type, user_id::INT AS page FROM events WHERE event_type IN ('click', 'view')")
def jsonl_flag_filter(spark, sf):
    rows = view(spark, sf, "SELECT event_id, event_type, user_id FROM events")
    path = _folder(spark)
    record = rows.select(C("event_id").cast("string").alias("image"), F.struct(F.array("event_type").alias("flags"), C("user_id").cast("int").alias("page")).alias("provenance"))
    io.write_json_lines(record, path)
    got = io.corrections(spark, path, ["click", "view"])
    return got.select(C("image").cast("long").alias("event_id"), C("provenance.flags")[0].alias("event_type"), "provenance.page")


@here("SELECT event_type AS engine, count(*) AS n, round(avg(CASE WHEN event_id % 9 <> 0 THEN event_id END), 6) AS mean FROM events GROUP BY 1")
def results_read(spark, sf):
    rows = view(spark, sf, "SELECT event_type AS Engine, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS Cell_Accuracy FROM events")
    names = [c.split()[0] for c in io.RESULTS.split(", ")]
    path = _folder(spark)
    rows.select(*[C(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names]).write.option("header", True).csv(path)
    got = io.results(spark, path, path + "-missing")
    return got.groupBy(C("Engine").alias("engine")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(C("Cell_Accuracy").try_cast("double")), 6).alias("mean"))


@here("WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) SELECT item_id, count(*) AS n, md5(string_agg(DISTINCT line, '|' ORDER BY line)) AS lines FROM l WHERE trim(line) <> '' GROUP BY 1")
def gt_lines(spark, sf):
    lines = view(spark, sf, "benchmark").select("item_id", F.explode(io.truth_lines(F.array("text"), F.lit(None).cast("string"))).alias("line"))
    return lines.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_set("line")), "|")).alias("lines"))


@here("SELECT table_id, count(*) AS cells FROM v_grid4 GROUP BY 1")
def gt_select(spark, sf):
    grids = view(spark, sf, "v_grid4").groupBy("table_id").agg(F.array(F.collect_list("text")).alias("g"))
    none = F.lit(None).cast("array<struct<data:array<array<string>>>>")
    tables = F.when(C("table_id") % 2 == 0, F.array(F.struct(C("g").alias("data")))).otherwise(none)
    return grids.select("table_id", F.size(F.flatten(io.truth_grid(tables, C("g")))).cast("long").alias("cells"))


@here("SELECT page, box_id, x0, y0, x1, y1, 'label' || (page % 3) AS label FROM v_boxes")
def coco_unnest(spark, sf):
    """Boxes packed into COCO documents, one for each page, and read back."""
    b = view(spark, sf, "v_boxes")
    ann = F.struct(C("box_id").cast("long").alias("id"), C("page").alias("image_id"), (C("page") % 3).alias("category_id"), F.array(C("x0"), C("y0"), C("x1") - C("x0"), C("y1") - C("y0")).alias("bbox"), F.lit(1.0).alias("area"), F.lit(0).alias("iscrowd"), C("box_id").cast("double").alias("score"))
    doc = b.groupBy("page").agg(F.collect_list(ann).alias("annotations"))
    cats = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(f"label{i}").alias("name")) for i in range(3)])
    image = F.array(F.struct(C("page").alias("id"), C("page").cast("string").alias("file_name"), F.lit(500).cast("long").alias("width"), F.lit(500).cast("long").alias("height")))
    coco = doc.select(F.from_json(F.to_json(F.struct(image.alias("images"), "annotations", cats.alias("categories"))), io.COCO).alias("d")).select("d.*")
    got = io.coco_boxes(coco)
    rows = got.select(C("file_name").cast("long").alias("page"), "label", C("bbox")[0].alias("x0"), C("bbox")[1].alias("y0"), (C("bbox")[0] + C("bbox")[2]).alias("x1"), (C("bbox")[1] + C("bbox")[3]).alias("y1"))
    key = ["page", "x0", "y0", "x1", "y1"]
    rank = lambda d: d.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in d.columns if c not in key])))
    return rank(b.select(*key, "box_id")).join(rank(rows), [*key, "k"]).drop("k")


@here("SELECT page, box_id, (page % 4)::INT AS class, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM v_boxes")
def yolo_unnest(spark, sf):
    b = view(spark, sf, "v_boxes")
    line = F.concat_ws(" ", (C("page") % 4).cast("string"), (C("x0") + C("x1")) / 1000, (C("y0") + C("y1")) / 1000, (C("x1") - C("x0")) / 500, (C("y1") - C("y0")) / 500)
    lines = b.select("page", "box_id", line.alias("value"))
    short = lines.withColumn("value", F.lit("0 0.5"))
    got = io.yolo_boxes(lines.unionByName(short), "value", 500.0, 500.0, keep=["page", "box_id"])
    return got.select("page", "box_id", "class", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@here("SELECT p_partkey, substr(regexp_replace('a/b:' || p_name || '[x]', '[\\[\\]:*?/\\\\]', '_', 'g'), 1, 31) AS sheet, CASE WHEN p_size < 20 THEN 'pdf' ELSE 'image' END AS route FROM part")
def sheet_names(spark, sf):
    p = view(spark, sf, "part")
    file = F.concat("p_name", F.when(C("p_size") < 20, ".PDF").otherwise(".jpeg"))
    return p.select("p_partkey", io.sheet_name(F.concat(F.lit("a/b:"), "p_name", F.lit("[x]"))).alias("sheet"), io.route_by_suffix(file).alias("route"))


@here("SELECT user_id AS engine, ts AS run, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(spark, sf):
    return overlays.first_by(view(spark, sf, "SELECT user_id AS engine, ts AS run, event_id FROM events"), ["engine"], [F.desc("run"), F.desc("event_id")])


@here("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'tool')")
def flag_overlap(spark, sf):
    rows = view(spark, sf, "conversations").withColumn("flags", F.array("role"))
    return joins.overlapping(rows, "flags", ["user", "tool"]).select("conv_id", "turn", "role")
