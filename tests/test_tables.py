"""Known answers of the table operators."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from loamgrid.functions import geometry as geo
from loamgrid.operators import boxes, evaluation, overlays, splits, stats
from loamgrid.operators import tables as tb

BY = ["t"]


def cells(spark, grid, t=1, confidence=None):
    return spark.createDataFrame([(t, r, c, x, confidence) for r, row in enumerate(grid) for c, x in enumerate(row)], "t int, row_id int, col_id int, text string, confidence double")


def test_ragged_and_repair(spark):
    c = cells(spark, [["a", "b"], ["c", "d"], ["e"]])
    assert [(r["row_id"], r["text"]) for r in tb.ragged(c, BY).collect()] == [(2, "e")]
    assert tb.ragged(cells(spark, [["a", "b"], ["c"]]), BY).count() == 0
    added = tb.repair(c, BY).where("added").collect()
    assert [(r["row_id"], r["col_id"], r["text"]) for r in added] == [(2, 1, "")]


def test_numeric_column(spark):
    odd = tb.unparseable(cells(spark, [["h"], ["10"], ["20"], ["30"], ["40"], ["oops"]]), BY)
    assert [r["text"] for r in odd.collect()] == ["oops"]
    assert tb.unparseable(cells(spark, [["h"], ["10"], ["20"], ["a"], ["b"], ["c"]]), BY).count() == 0


def test_totals(spark):
    grid = [(1, 0, 0, False, 10.0), (1, 1, 0, False, 20.0), (1, 2, 0, True, 999.0), (1, 3, 0, False, 5.0), (1, 4, 0, True, 5.0)]
    d = spark.createDataFrame(grid, "t int, row_id int, col_id int, is_total boolean, v double")
    got = tb.total_mismatch(d, BY, F.col("is_total"), F.col("v"), F.lit(False)).collect()
    assert [(r["row_id"], r["total"], r["expected"]) for r in got] == [(2, 999.0, 30.0)]
    # Blanks are passed over, percentages not summed, an odd text taints its stretch, and a total that is no number ends one.
    rows = ["10", "", "50%", "25", "T12", "x", "9", "T1", "3", "Tn/a", "4", "T4", "T7"]
    parsed = [(1, i, 0, r[:1] == "T", None if r in ("", "x", "Tn/a") else float(r.strip("T%")), r[-1:] == "%", r == "") for i, r in enumerate(rows)]
    d = spark.createDataFrame(parsed, "t int, row_id int, col_id int, is_total boolean, v double, p boolean, b boolean")
    got = tb.total_mismatch(d, BY, F.col("is_total"), F.col("v"), F.col("p"), F.col("b")).collect()
    assert [(r["row_id"], r["total"], r["expected"]) for r in got] == [(4, 12.0, 35.0)]


def test_stitch_anchors_on_the_first_table(spark):
    d = spark.createDataFrame([("d", i, w) for i, w in enumerate([3, 4, 5])], "doc string, k long, w long")
    assert [r["part"] for r in tb.stitched_groups(d, "doc", "k", "w").orderBy("k").collect()] == [0, 0, 1]


def test_stitched_rows(spark):
    d = spark.createDataFrame([("d", 0, 0, "h"), ("d", 0, 1, "a"), ("d", 1, 0, "h"), ("d", 1, 1, " "), ("d", 1, 2, "b"), ("d", 2, 0, "c")], "doc string, t int, row_id int, signature string")
    assert [(r["signature"], r["new_row"]) for r in tb.stitched_rows(d, ["doc"], "t").orderBy("new_row").collect()] == [("h", 0), ("a", 1), ("b", 2), ("c", 3)]


def test_title(spark):
    got = tb.without_title(cells(spark, [["Title", ""], ["a", "b"]]), BY).orderBy("col_id").collect()
    assert [(r["row_id"], r["text"]) for r in got] == [(0, "a"), (0, "b")]


def best_total(alike, i=0, j=0):
    """Largest total over all order-preserving pairs, by trying everything."""
    if i == len(alike) or j == len(alike[0]):
        return 0.0
    skip = max(best_total(alike, i + 1, j), best_total(alike, i, j + 1))
    return max(skip, alike[i][j] + best_total(alike, i + 1, j + 1)) if alike[i][j] >= 0.5 else skip


def test_alignment_against_every_other():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1] + [0] * len(b) if not b else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(out[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        return out

    rng = random.Random(21)
    for _ in range(150):
        a, b = ([" ".join(rng.choices(["ab", "cd", "a", ""], k=3)) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        alike = [[1 - edits(x, y) / max(len(x), len(y), 1) for y in b] for x in a]
        got = evaluation.align(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False)) and all(alike[i][j] >= 0.5 for i, j in got)
        assert abs(sum(alike[i][j] for i, j in got) - best_total(alike)) < 1e-9
    # Ties: the earliest lines are paired.
    assert evaluation.align(["x", "x"], ["x"]) == [(0, 0)] and evaluation.align(["x"], ["x", "x"]) == [(0, 0)]
    assert evaluation.align([], ["x"]) == [] == evaluation.align(["x"], [])


def test_tables_side_by_side_align_as_each_alone():
    rng = random.Random(8)
    word = lambda letters, k: "".join(rng.choices(letters, k=rng.randrange(k)))
    for letters in ("ab", "0១ 1é😀"):
        sides = [[[word(letters, rng.choice((4, 90))) for _ in range(rng.randrange(6))] for _ in range(60)] for _ in range(2)]
        grids = [pa.array([[{"row_id": i, "col_id": 0, "text": x} for i, x in enumerate(t)] or None for t in side], pa.list_(pa.struct([("row_id", pa.int32()), ("col_id", pa.int32()), ("text", pa.string())]))) for side in sides]
        n, t, g = evaluation._matched(*grids, 0.5)[0]
        at = [0, *n.cumsum().tolist()]
        assert [list(zip(t[x:y].tolist(), g[x:y].tolist(), strict=True)) for x, y in zip(at, at[1:], strict=False)] == [evaluation.align(a, b) for a, b in zip(*sides, strict=True)]


def test_alignment(spark):
    score = lambda t, g: evaluation.table_metrics(cells(spark, t), cells(spark, g), "t").first()
    base = [["aaaa", "1111", ""], ["bbbb", "2222", "x y"]]
    same = score(base, base)
    assert (same["cell_accuracy"], same["row_alignment_rate"], same["col_alignment_rate"], same["table_cer"], same["numeric_cells_total"], same["empty_cell_precision"]) == (1, 1, 1, 0, 2, 1)
    more = score(base, [["extra row here", "of", "text"], *base])
    assert more["cell_accuracy"] == 1 and not more["grid_shape_match"] and more["col_count_match"] and more["pred_rows"] == 3
    assert score(base, [["A title", "", ""], *base])["grid_shape_match"]
    assert score(base, [[r[0], "zzzzzzzz", *r[1:]] for r in base])["cells_correct"] == 6
    slips = score(base, [["aaaa", "១១១១", "|"], ["bbbb", "2223", "x  y"]])
    assert (slips["numeric_cells_correct"], slips["numeric_cells_khmer_digit_slips"], slips["empty_gt_cells_clean"], slips["cells_correct"], slips["empty_cell_precision"]) == (1, 1, 0, 3, 0)
    assert score([["aaaa", "1111"]], [["1111", "aaaa"]])["cell_accuracy"] < 1
    alone = evaluation.table_metrics(cells(spark, base), cells(spark, base, t=2), "t").first()
    assert (alone["tables_found"], alone["cells_correct"], alone["cells_total"], alone["cell_content_recall"], alone["table_cer"], alone["row_alignment_rate"]) == (0, 0, 6, 0, 1, 0)
    parts = cells(spark, base[:1]).withColumn("k", F.lit(0)).unionByName(cells(spark, base[1:]).withColumn("k", F.lit(1)))
    both = evaluation.table_metrics(cells(spark, base), parts, "t", "k").first()
    assert (both["tables_found"], both["cell_accuracy"], both["pred_rows"]) == (2, 1, 2)



def test_distance_against_the_plain_table():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(0, 90))) for _ in range(2))
        assert evaluation._distance(a, b) == plain(a, b)


def test_leaks_are_told_by_value(spark):
    lines = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, "z"), (2, "a"), (None, "a"), (3, "")], "k long, line string")
    got = evaluation.paragraph_leak(lines, spark.createDataFrame([(1, "xa"), (1, "a"), (2, None), (None, "a"), (3, "")], "k long, text string"), "k")
    assert sorted((r["k"] or 0, r["leaked"]) for r in got.collect()) == [(0, 0), (1, 2), (2, 0), (3, 1)]
    # Row numbers are dealt out anew on each side of a join, and differ there over large tables.
    assert got._jdf.queryExecution().optimizedPlan().deterministic()


def test_boxes(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 12.0, 0.0, 20.0, 10.0), (1, 2, 100.0, 0.0, 110.0, 10.0), (1, 3, 21.0, 5.0, 30.0, 40.0)]
    b = spark.createDataFrame(rows, "page int, k int, x0 double, y0 double, x1 double, y1 double").select("page", "k", geo.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("box"))
    got = {r["component"]: (r["n"], r["box"]) for r in boxes.components(b, "page", "k", 1.0).collect()}
    assert got == {0: (3, [0, 0, 30, 40]), 2: (1, [100, 0, 110, 10])}
    assert boxes.bands(b, "page", 0.0).count() == 1


def test_dates_cluster_transitively(spark):
    d = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03"), (4, "2024-01-09"), (5, None), (6, None)], "k int, d string").select(F.lit(0).alias("s"), "k", F.to_date("d").alias("d"))
    got = {r["k"]: r["cluster"] for r in splits.date_clusters(d, ["s"], "d", "k").collect()}
    assert got[1] == got[2] == got[3] != got[4] and len({got[5], got[6]}) == 2


def test_split_keeps_clusters_whole(spark):
    d = spark.range(300).select(F.lit("a").alias("era"), (F.col("id") % 30).alias("c"), "id")
    out = splits.clustered_split(d, "era", "c", F.col("c"))
    assert out.groupBy("c").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count_distinct("c").alias("n")).collect()} == {"test": 3, "valid": 3, "train": 24}


def test_blank_means(spark):
    d = spark.createDataFrame([("a", "0.1"), ("a", ""), ("a", "0.3"), ("b", ""), ("", "9"), (None, "9")], "k string, m string")
    assert {r["k"]: r["mean"] for r in stats.group_mean(d, "k", "m").collect()} == {"a": 0.2, "b": None}


def test_edits(spark):
    c = cells(spark, [["a", "b"], ["c", "d"]])
    assert overlays.delete_row(cells(spark, [["a"]]), BY, 0).count() == 1
    assert sorted(r["row_id"] for r in overlays.delete_row(c, BY, 0).collect()) == [0, 0]
    assert overlays.replaced(c, "", "x").count() == 0
    edited = overlays.apply_edits(c, cells(spark, [["z"]], t=1).drop("confidence").withColumn("t", F.lit(1)), "t")
    assert [(r["text"], r["confidence"]) for r in edited.collect()] == [("z", None)]


def test_results_do_not_depend_on_partitions(spark):
    c = spark.range(400).selectExpr("CAST(id % 7 AS INT) AS t", "CAST(id DIV 30 AS INT) AS row_id", "CAST(id % 30 DIV 7 AS INT) AS col_id", "CAST(id AS STRING) AS text", "id % 100 / 100D AS confidence").dropDuplicates(["t", "row_id", "col_id"])
    c = spark.createDataFrame(c.orderBy("t", "row_id", "col_id").toPandas())
    want = None
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, tb.quality_flags(c.repartition(5), BY).collect()))
        assert want is None or got == want
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", "8")
