"""Known answers of readers, writers, rules and reports."""

import json

from pyspark.sql import functions as F

from loamgrid.functions import geometry as geo
from loamgrid.operators import joins, overlays, records, reports, stats
from loamgrid.sources import io


def test_results_skip_missing_paths(spark, tmp_path):
    names = [c.split()[0] for c in io.RESULTS.split(", ")]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(["plain", "True", "d", "i.png"] + ["" for _ in names[4:]]) + "\n")
    got = io.results(spark, str(tmp_path / "a.csv"), str(tmp_path / "none.csv")).collect()
    assert [(r["Engine"], r["Cell_Accuracy"]) for r in got] == [("plain", None)]
    assert io.results(spark, str(tmp_path / "none.csv")).count() == 0


def test_truth(spark, tmp_path):
    (tmp_path / "x_ground_truth.json").write_text(json.dumps({"font_family": "f", "paragraphs": ["a\n\nb"], "tables": [{"data": [["1", "2"]]}], "footer": "end"}))
    (tmp_path / "y.json").write_text(json.dumps({"data": [["3"]], "table_index": 0}))
    got = {r["name"]: r for r in io.truth(spark, str(tmp_path)).select("name", io.truth_grid(F.col("tables"), F.col("data")).alias("g"), io.truth_lines(F.col("paragraphs"), F.col("footer")).alias("l")).collect()}
    assert got["x"]["g"] == [["1", "2"]] and got["x"]["l"] == ["a", "b", "end"] and got["y"]["g"] == [["3"]] and got["y"]["l"] == []


def test_coco_keeps_empty_images(spark, tmp_path):
    page = {"images": [{"id": 1, "file_name": "a", "width": 9, "height": 9}, {"id": 2, "file_name": "b", "width": 9, "height": 9}], "annotations": [{"id": 5, "image_id": 1, "category_id": 7, "bbox": [1.0, 2.0, 3.0, 4.0]}], "categories": [{"id": 7, "name": "Table"}, {"id": 8, "name": "unused"}]}
    (tmp_path / "c.json").write_text(json.dumps(page))
    got = {r["file_name"]: (r["label"], r["bbox"]) for r in io.coco_boxes(spark.read.schema(io.COCO).json(str(tmp_path / "c.json"))).collect()}
    assert got == {"a": ("Table", [1.0, 2.0, 3.0, 4.0]), "b": (None, None)}


def test_rules(spark):
    d = spark.createDataFrame([("a.PDF", 50, 0, 10), ("b.jpeg", 900, 600, 100), ("c.txt", 900, 100, 400), ("d.tiff", 900, 0, 800)], "name string, n int, khmer int, latin int")
    got = d.select(io.route_by_suffix(F.col("name")), io.text_class(F.col("khmer"), F.col("latin"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("pdf", "scanned"), ("image", "khmer"), (None, "mixed"), ("image", "latin")]


def test_scopes(spark):
    d = spark.createDataFrame([("all", 1, 1, []), ("single", 9, 9, []), ("single", 2, 2, []), ("range", 4, 2, []), ("range", 2, 99, []), ("list", 0, 0, [3, 1, 3, 77])], "k string, a int, b int, l array<int>")
    got = [r[0] for r in d.select(reports.page_scope_expand(F.col("k"), F.col("a"), F.col("b"), F.col("l"), F.lit(5))).collect()]
    assert got == [[0, 1, 2, 3, 4], [], [1], [1, 2, 3], [1, 2, 3, 4], [0, 2]]


def test_boxes(spark):
    d = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0], [5.0, 5.0, 15.0, 15.0])], "a array<double>, b array<double>")
    r = d.select(geo.iou(F.col("a"), F.col("b")).alias("iou"), geo.clamp(F.col("b"), F.lit(12), F.lit(12)).alias("clamped"), geo.clamp(F.col("b"), F.lit(7), F.lit(12)).alias("none"), geo.from_thousandths(F.array(F.lit(1.0)), F.lit(1.0), F.lit(1.0)).alias("bad")).first()
    assert abs(r["iou"] - 25 / 175) < 1e-12 and list(map(float, r["clamped"])) == [5, 5, 12, 12] and r["none"] is None and r["bad"] == []


def test_settings_drop_unknown_keys(spark):
    default = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    layer = F.create_map(F.lit("b"), F.lit("9"), F.lit("z"), F.lit("0"))
    used = spark.range(1).select(overlays.settings(default, layer, F.lit(None).cast("map<string,string>")).alias("m")).first()["m"]
    assert used == {"a": "1", "b": "9"}


def test_summary_sets_count_each_row_once_a_key(spark):
    d = spark.createDataFrame([("e1", "f", "0.5", "1", "2"), ("e1", None, "", "1", "2"), ("e2", "f", "0.3", "0", "0")], "e string, f string, m string, a string, b string")
    got = {(r["key"], r["value"]): (r["n"], r["mean_m"], r["ratio"]) for r in stats.summary_sets(d, ["e", "f"], ["m"], "a", "b").collect()}
    assert got == {("e", "e1"): (2, 0.5, 0.5), ("e", "e2"): (1, 0.3, 0.0), ("f", "f"): (2, 0.4, 0.5), ("f", ""): (1, 0.0, 0.5)}


def test_unique_match_needs_both_sides(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3), ("z", 4)], "k string, a int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), ("z", 4)], "k string, b int")
    assert [r["k"] for r in joins.unique_match(a, b, "k").collect()] == ["x"]


def test_append_is_idempotent(spark, tmp_path):
    d = spark.range(10).select(F.col("id"), F.lit("v").alias("v"))
    for _ in range(2):
        io.append(d, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_headers_and_numbers(spark):
    r = spark.range(1).select(reports.two_row_header(F.array(*map(F.lit, ("A", "", "B"))), F.array(*map(F.lit, ("x", "y", "")))).alias("h"), reports.split_row_number(F.lit("១២ rice")).alias("n"), reports.split_row_number(F.lit("12")).alias("m")).first()
    assert r["h"] == ["A x", "A y", "B"] and tuple(r["n"]) == ("១២", "rice") and tuple(r["m"]) == (None, "12")


def test_records_of_a_run(spark):
    none = records.manifest(spark.createDataFrame([], "d string, m double"), "d", ["m"], run_id="r").first()[0]
    assert json.loads(none) == {"run_id": "r", "datasets": [], "image_count": 0, "aggregates": {}}
    some = records.manifest(spark.createDataFrame([("b", 0.5), ("a", None), ("b", 0.25)], "d string, m double"), "d", ["m"], run_id="r").first()[0]
    assert json.loads(some) == {"run_id": "r", "datasets": [{"name": "a", "images": 1}, {"name": "b", "images": 2}], "image_count": 3, "aggregates": {"m": "0.375"}}
    d = spark.createDataFrame([(None, "a\nb"), ("same\nabcdef", "same\nabcdeg")], "a string, b string")
    assert [r[0] for r in d.select(records.line_diff("a", "b")).collect()] == ["+ a\n+ b", "  same\n- abcdef\n?      ^\n\n+ abcdeg\n?      ^\n"]


def test_curriculum_follows_its_shares(spark):
    d = records.curriculum(spark, 20_000, ["kg", "%"], 3)
    n = {r["kind"]: r["count"] / 20_000 for r in d.groupBy("kind").count().collect()}
    want = {"unit": 0.3, "percent": 0.25, "whole": 0.2, "decimal": 0.15, "khmer": 0.1}
    assert n.keys() == want.keys() and all(abs(n[k] - want[k]) < 0.02 for k in want)
    shape = F.expr("CASE kind WHEN 'unit' THEN text IN ('kg', '%') WHEN 'percent' THEN text RLIKE '^[-+]?[0-9]{1,2}[.][0-9]{2}%$' WHEN 'whole' THEN text RLIKE '^[0-9]{1,3}(,[0-9]{3}){0,2}$' WHEN 'decimal' THEN text RLIKE '^[0-9]{1,3}[.][0-9]{5}$' ELSE text RLIKE '^[០-៩]{1,4}$' END")
    assert d.where(~shape).count() == 0
    assert d.exceptAll(records.curriculum(spark, 20_000, ["kg", "%"], 3)).count() == 0
