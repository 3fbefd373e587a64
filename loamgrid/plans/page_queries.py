"""Queries on pages, regions, layout boxes and engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import dates, markup
from loamgrid.functions import geometry as geo
from loamgrid.functions import text as tx
from loamgrid.operators import documents as dc
from loamgrid.operators import evaluation as ev
from loamgrid.plans.registry import Registry
from loamgrid.plans.views import view

here = Registry()
C = F.col
#: Parts of a cluster that differ by row: base, subscript base, shifter, vowel, in the order that is right.
_PARTS = "substr('កខគឃងចឆជឈញដឋឌឍណតថទធន', 1 + CAST(p_partkey % 20 AS INT), 1) AS a, substr('បផពភមយរលវស', 1 + CAST(p_size % 10 AS INT), 1) AS b, substr('៉៊', 1 + CAST(p_partkey % 2 AS INT), 1) AS s, substr('ាិីឹឺុូ', 1 + CAST(p_size % 7 AS INT), 1) AS v"
_CLUSTERS = f"SELECT p_partkey AS k, p_name AS name, {_PARTS} FROM part"


@here(f"SELECT k, concat(a, '្', b, s, v, ' ', name, ' ', a, v) AS clean, concat(a, v, s, '្', b, ' ', name, ' ', a, v) AS kept FROM ({_CLUSTERS})")
def khmer_clean(spark, sf):
    d = view(spark, sf, f"SELECT k, concat(' ', a, v, v, s, '្', b, '​  ', name, '﻿\t', a, v, ' ') AS raw FROM ({_CLUSTERS})")
    return d.select("k", tx.clean_khmer(C("raw"), reorder=True).alias("clean"), tx.clean_khmer(C("raw")).alias("kept"))


@here(f"SELECT k, a = b OR k % 3 > 0 AS same FROM (SELECT k, a, b FROM ({_CLUSTERS}))")
def training_equivalent(spark, sf):
    d = view(spark, sf, f"SELECT k, concat(a, v) AS old, CASE WHEN k % 3 > 0 THEN concat(' ', a, '‌', v, v, ' ') ELSE concat(b, v) END AS new FROM ({_CLUSTERS})")
    return d.select("k", tx.training_equivalent(C("old"), C("new")).alias("same"))


_STAGE = "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN concat(' ', p_name, '  ไทย x ') WHEN p_partkey % 4 = 1 THEN concat('អ/គ.ក', ' ') WHEN p_partkey % 4 = 2 THEN ' | -- ' ELSE concat('០.', CAST(p_size AS STRING), '%') END AS raw FROM part"


@here("SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, ' x') WHEN p_partkey % 4 = 1 THEN '៛/គ.ក' WHEN p_partkey % 4 = 2 THEN '' ELSE concat('0.', CAST(p_size AS STRING), '%') END AS staged FROM part")
def stage_text(spark, sf):
    return view(spark, sf, _STAGE).select("k", tx.stage_text(C("raw")).alias("staged"))


_BLOCKS = "SELECT conv_id, turn, role, CASE WHEN turn % 5 = 4 THEN '  ' ELSE concat(' ', text, CASE WHEN turn % 3 = 0 THEN ' ไทย' ELSE '' END) END AS text FROM conversations"


@here(f"""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x{{200B}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g'), '[ \t]+', ' ', 'g')) AS t FROM ({_BLOCKS})),
    f AS (SELECT conv_id, turn, role, replace(t, 'the', 'THE') AS t FROM c),
    s AS (SELECT conv_id, turn, role, CASE WHEN contains(t, 'ไทย') THEN trim(regexp_replace(replace(t, 'ไทย', ''), ' {{2,}}', ' ', 'g'), ' ') ELSE t END AS t, (length(t) - length(replace(t, 'ไทย', '')))::BIGINT AS n FROM f)
    SELECT conv_id, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn, role, t) FILTER (WHERE t <> ''), '')) AS page_text, sum(n)::BIGINT AS "foreign" FROM s GROUP BY 1""")
def page_text(spark, sf):
    return dc.page_text(view(spark, sf, _BLOCKS), ["conv_id"], ["turn", "role"], {"the": "THE"}).withColumn("page_text", F.md5("page_text"))


@here("SELECT o_orderkey AS k, concat_ws(' ', nullif(o_orderstatus, 'P'), nullif(o_orderpriority, '5-LOW')) AS text FROM orders")
def cell_text(spark, sf):
    line = lambda c: F.struct(c.alias("text"))
    lines = F.array(line(F.when(C("o_orderstatus") == "P", "").otherwise(C("o_orderstatus"))), line(F.lit("")), line(F.when(C("o_orderpriority") == "5-LOW", "").otherwise(C("o_orderpriority"))))
    return view(spark, sf, "orders").select(C("o_orderkey").alias("k"), tx.cell_text(lines).alias("text"))


_LEAK = "SELECT l_orderkey AS k, l_returnflag AS line FROM v_lines WHERE line < 2"


@here(f"WITH l AS ({_LEAK}) SELECT l.k, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_pred p WHERE p.table_id = l.k AND contains(p.text, l.line))) AS leaked FROM l GROUP BY 1")
def paragraph_leak(spark, sf):
    return ev.paragraph_leak(view(spark, sf, _LEAK), view(spark, sf, "v_pred").withColumnRenamed("table_id", "k"), "k")


@here("SELECT table_id, CASE WHEN confidence IS NULL THEN 'none' WHEN confidence < 0.8 THEN 'low' WHEN confidence < 0.95 THEN 'medium' ELSE 'high' END AS band, count(*) AS n, string_agg(concat(row_id, '.', col_id), ' ' ORDER BY row_id, col_id) AS cells FROM v_cells GROUP BY 1, 2")
def band_cells(spark, sf):
    d = view(spark, sf, "v_cells").withColumn("band", tx.confidence_band(C("confidence")))
    places = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "col_id"))), lambda x: F.concat(x["row_id"].cast("string"), F.lit("."), x["col_id"].cast("string")))
    return d.groupBy("table_id", "band").agg(F.count(F.lit(1)).alias("n"), F.array_join(places, " ").alias("cells"))


@here("SELECT table_id, row_id, col_id, CASE WHEN coalesce(confidence, 0) >= 0.8 THEN 'good' WHEN coalesce(confidence, 0) >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM v_cells")
def overlay_bands(spark, sf):
    return view(spark, sf, "v_cells").select("table_id", "row_id", "col_id", dc.overlay_band(C("confidence")).alias("band"))


@here("SELECT table_id, row_id, col_id FROM v_cells WHERE confidence IS NULL OR confidence = 0 OR confidence >= 0.6")
def trusted_layout(spark, sf):
    return dc.trusted_layout(view(spark, sf, "v_cells"), 0.6).select("table_id", "row_id", "col_id")


@here("SELECT table_id FROM v_cells GROUP BY 1 HAVING bool_or(trim(text) <> '')")
def nonempty_tables(spark, sf):
    return dc.nonempty(view(spark, sf, "v_cells"), ["table_id"])


@here("SELECT page, box_id, least(x0, x1 - 5, y1) AS a, least(y0, y0 + 3) AS b, greatest(x0, x1, y1) AS c, greatest(y1, y0 + 3) AS d, box_id % 4 < 3 AS known FROM (SELECT page, box_id, x0, x1, y0, y1 FROM v_boxes) WHERE box_id % 4 < 3 UNION ALL SELECT page, box_id, NULL, NULL, NULL, NULL, false FROM v_boxes WHERE box_id % 4 = 3")
def polygon_boxes(spark, sf):
    point = lambda x, y: F.array(x, y)
    full = F.array(point(C("x0"), C("y0")), point(C("x1"), C("y0") + 3), point(C("y1"), C("y1")), point(C("x1") - 5, C("y0")))
    box = geo.from_points(F.when(C("box_id") % 4 < 3, full).otherwise(F.slice(full, 1, 2)))
    return view(spark, sf, "v_boxes").select("page", "box_id", *[box[i].alias(c) for i, c in enumerate("abcd")], box.isNotNull().alias("known"))


@here("WITH b AS (SELECT page, box_id, greatest(floor(x0 - 100), 0) AS a, greatest(floor(y0), 0) AS b, least(ceil(x1 - 100), 200) AS c, least(ceil(y1), 220) AS d FROM v_boxes) SELECT page, box_id, CASE WHEN c - a >= 3 AND d - b >= 3 THEN ((c - a) * (d - b))::DOUBLE END AS area, c - a < 3 OR d - b < 3 AS tiny FROM b")
def crop_filter(spark, sf):
    box = geo.clamp(geo.box(C("x0") - 100, C("y0"), C("x1") - 100, C("y1")), F.lit(200), F.lit(220))
    return view(spark, sf, "v_boxes").select("page", "box_id", F.when(box.isNotNull(), (box[2] - box[0]).cast("double") * (box[3] - box[1])).alias("area"), box.isNull().alias("tiny"))


@here("SELECT o_orderkey AS k, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'scored' ELSE 'skipped' END AS status FROM orders")
def scored_or_skipped(spark, sf):
    return dc.scored_or_skipped(view(spark, sf, "SELECT o_orderkey AS k FROM orders"), view(spark, sf, "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'"), ["k"])


@here("SELECT o_orderkey, o_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'whole page') AS region FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def region_fallback(spark, sf):
    regions = view(spark, sf, "SELECT c_custkey AS o_custkey, c_mktsegment AS region FROM customer WHERE c_acctbal > 0")
    return dc.with_fallback(view(spark, sf, "SELECT o_orderkey, o_custkey FROM orders"), regions, ["o_custkey"], "region", F.lit("whole page"))


@here("SELECT engine, sum(trunc(metric::DOUBLE / 7))::BIGINT AS total, count(DISTINCT font) >= 2 AS comparable FROM v_runs WHERE metric <> '' GROUP BY 1")
def group_totals(spark, sf):
    whole = (C("metric").cast("double") / 7).cast("long")
    return view(spark, sf, "SELECT * FROM v_runs WHERE metric <> ''").groupBy("engine").agg(F.sum(whole).alias("total"), (F.count_distinct("font") >= 2).alias("comparable"))


@here("SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '</p>')) AS paragraphs FROM pages")
def span_counts(spark, sf):
    return view(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_count("html", F.lit("</p>")).cast("long").alias("paragraphs"))


@here("SELECT user_id, round(coalesce(avg(value) FILTER (WHERE event_type <> 'view'), 0), 6) AS confidence FROM events GROUP BY 1")
def ctc_confidence(spark, sf):
    steps = view(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.struct(C("event_type").alias("symbol"), C("value").alias("score"))).alias("s"))
    return steps.select("user_id", F.round(dc.ctc_confidence(C("s"), F.lit("view")), 6).alias("confidence"))


@here("SELECT user_id, count(*) FILTER (WHERE b AND NOT coalesce(p, false)) AS bands FROM (SELECT user_id, event_type = 'view' AS b, lag(event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1")
def blank_bands(spark, sf):
    return dc.blank_bands(view(spark, sf, "events"), ["user_id"], ["event_id"], C("event_type") == "view")


@here("SELECT page, box_id, (row_number() OVER (PARTITION BY page ORDER BY y0, x0, box_id) - 1)::INT AS place FROM v_boxes")
def box_order(spark, sf):
    return dc.in_reading_order(view(spark, sf, "v_boxes"), ["page"], "x0", "y0", "box_id").select("page", "box_id", "place")


@here("SELECT table_id, row_id, col_id, (row_number() OVER (PARTITION BY table_id ORDER BY row_id, col_id) - 1)::INT AS cell_id FROM v_cells")
def numbered_cells(spark, sf):
    return dc.numbered_cells(view(spark, sf, "v_cells"), ["table_id"]).select("table_id", "row_id", "col_id", "cell_id")


@here("WITH n AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT o_custkey, o_orderkey, n FROM n QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderkey) = 1 AND n >= 4")
def largest_table(spark, sf):
    cells = view(spark, sf, "SELECT o_custkey, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
    return dc.largest_table(cells, "o_custkey", "o_orderkey", 4)


_IMAGES = "SELECT page, box_id AS no, 30000.0 AS page_area, x1 - x0 AS width, y1 - y0 AS height, 100.0 + box_id * 50 AS pixels FROM v_boxes"


@here(f"SELECT page, round((width * height / page_area)::DOUBLE, 9) AS covered, round((pixels / (width / 72))::DOUBLE, 6) AS dpi, width * height / page_area >= 0.15 AS scanned FROM ({_IMAGES}) QUALIFY row_number() OVER (PARTITION BY page ORDER BY width * height DESC, no) = 1")
def scan_density(spark, sf):
    d = view(spark, sf, _IMAGES).select("page", "no", *[C(c).cast("double").alias(c) for c in ("page_area", "width", "height", "pixels")])
    return dc.scan_density(d, "page", 0.15).select("page", F.round("covered", 9).alias("covered"), F.round("dpi", 6).alias("dpi"), "scanned")


_STATUS = "CASE WHEN o_orderkey % 7 = 0 THEN 'no_table' WHEN o_orderkey % 5 = 0 THEN 'shape_mismatch' ELSE 'written' END"


@here(f"WITH e AS (SELECT unnest(['written', 'no_table', 'shape_mismatch', 'map_refused']) AS status) SELECT e.status, count(o_orderkey) AS n FROM e LEFT JOIN orders ON {_STATUS} = e.status GROUP BY 1")
def outcome_counts(spark, sf):
    return dc.outcomes(view(spark, sf, "orders"), F.expr(_STATUS), ["written", "no_table", "shape_mismatch", "map_refused"])


@here("SELECT p_partkey AS k, CASE WHEN contains(replace(p_type, ' ', ''), 'DSTEEL') THEN 'late' WHEN contains(replace(p_type, ' ', ''), 'DBRASS') THEN 'early' ELSE 'unknown' END AS era FROM part")
def era_markers(spark, sf):
    return view(spark, sf, "part").select(C("p_partkey").alias("k"), dates.era(C("p_type"), {"late": "DSTEEL", "early": "DBRASS"}).alias("era"))


@here("SELECT s_suppkey AS k, round(1 - levenshtein(s_name, n) / greatest(len(s_name), len(n))::DOUBLE, 9) AS alike, CASE WHEN s_acctbal > 0 THEN printf('%.3f', floor(s_acctbal) / 8) ELSE '' END AS shown FROM (SELECT s_suppkey, s_name, s_acctbal, concat(substr(s_name, 3), 'yy') AS n FROM supplier)")
def likeness(spark, sf):
    d = view(spark, sf, "SELECT s_suppkey, s_name, s_acctbal, concat(substr(s_name, 3), 'yy') AS n FROM supplier")
    return d.select(C("s_suppkey").alias("k"), F.round(tx.similarity(C("s_name"), C("n")), 9).alias("alike"), tx.three_places(F.when(C("s_acctbal") > 0, F.floor("s_acctbal") / 8)).alias("shown"))


@here("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS active, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS fields FROM orders")
def scan_digest(spark, sf):
    on = C("o_orderstatus") == "F"
    return view(spark, sf, "orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(on).alias("active"), F.array_join(F.array_sort(F.collect_set(F.when(on, C("o_orderpriority")))), ",").alias("fields"))


@here("SELECT table_id, row_id, col_id, text FROM v_cells WHERE confidence < 0.8")
def band_segments(spark, sf):
    return view(spark, sf, "v_cells").where(tx.confidence_band(C("confidence")) == "low").select("table_id", "row_id", "col_id", "text")


@here("SELECT p_partkey AS k, concat(p_name, ' & ', p_type, ' <', p_size, '>') AS text FROM part")
def html_text(spark, sf):
    d = view(spark, sf, "SELECT p_partkey AS k, concat('<p> ', p_name, ' <b>&amp;</b>', chr(10), '<i>', p_type, '</i><br/>&lt;', p_size, '&gt; </p>') AS html FROM part")
    return d.select("k", markup.html_text(C("html")).alias("text"))


def _shout(pages):
    """Stands in for an engine: fails on every page that names steel."""
    if pages["p_type"].str.contains("STEEL").any():
        raise RuntimeError("no steel")
    return pages["p_name"].str.upper()


@here("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN '' ELSE upper(p_name) END AS text, CASE WHEN contains(p_type, 'STEEL') THEN 'RuntimeError: no steel' END AS warning FROM part")
def engine_fail_soft(spark, sf):
    dc.register_engine("shout", _shout)
    return dc.recognised(view(spark, sf, "SELECT p_partkey, p_name, p_type FROM part"), "shout", 8).select("p_partkey", "text", "warning")
