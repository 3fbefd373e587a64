"""Queries of reports, routing rules and smaller ordered computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import geometry as geo
from loamgrid.functions import markup
from loamgrid.functions import text as tx
from loamgrid.operators import joins, overlays, reports, stats
from loamgrid.operators import tables as tb
from loamgrid.plans.registry import Registry
from loamgrid.plans.views import view

here = Registry()
C = F.col


@here("SELECT o_orderkey AS k, unnest(CASE o_orderstatus WHEN 'F' THEN range(0, 9) WHEN 'O' THEN range(greatest(least(a, b), 1) - 1, least(greatest(a, b), 9)) ELSE CASE WHEN a BETWEEN 1 AND 9 THEN [a - 1] ELSE [] END END)::INT AS page FROM (SELECT *, o_orderkey % 12 AS a, o_custkey % 12 AS b FROM orders)")
def page_scope_expand(spark, sf):
    d = view(spark, sf, "SELECT o_orderkey AS k, o_orderstatus AS s, CAST(o_orderkey % 12 AS INT) AS a, CAST(o_custkey % 12 AS INT) AS b FROM orders")
    kind = F.when(C("s") == "F", "all").when(C("s") == "O", "range").otherwise("single")
    return d.select("k", F.explode(reports.page_scope_expand(kind, C("a"), C("b"), F.array("a"), F.lit(9))).alias("page"))


@here("SELECT o_orderkey, coalesce(o_orderstatus, '~') || '_' || o_custkey || '_~' AS signature FROM orders")
def settings_signature(spark, sf):
    return view(spark, sf, "orders").select("o_orderkey", reports.signature(C("o_orderstatus"), C("o_custkey"), F.lit(None)).alias("signature"))


@here("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '-' END AS choice FROM events")
def effective_choice(spark, sf):
    warning = F.when(C("event_type").isin("click", "view"), F.concat(F.lit("[AutoRouter] routed to "), "event_type")).otherwise(F.lit("[AutoRouter] pre-flight x"))
    return view(spark, sf, "events").select("event_id", F.coalesce(reports.effective_choice(warning), F.lit("-")).alias("choice"))


@here("SELECT ord, coalesce(CASE WHEN dataset = 'set1' THEN NULL ELSE amount END, -1) AS cer FROM v_runs")
def metric_mask(spark, sf):
    return view(spark, sf, "v_runs").select("ord", F.coalesce(reports.masked(C("amount"), "cer", C("dataset"), {"set1": ["cer"], "set2": ["recall"]}), F.lit(-1)).alias("cer"))


@here("SELECT run, coalesce(bool_or(font = engine), false) AS circular, bool_or(font IS NOT NULL) AS provisional FROM (SELECT run, CASE WHEN found = '0' THEN engine WHEN found = '1' THEN 'hand' END AS font, engine FROM v_runs) GROUP BY 1")
def provenance_circular(spark, sf):
    rows = view(spark, sf, "SELECT run, CASE WHEN found = '0' THEN engine WHEN found = '1' THEN 'hand' END AS drafted, engine FROM v_runs")
    return reports.circular(rows, ["run"], "drafted", "engine")


@here("SELECT l_orderkey, median(l_quantity) < 100 AS sharpen, median(l_extendedprice) < 40 AS enhance, max(abs(l_discount * 30)) > 2.5 AS deskew FROM lineitem GROUP BY 1")
def preprocess_suggestion(spark, sf):
    return reports.preprocessing(view(spark, sf, "lineitem").withColumn("skew", C("l_discount") * 30), ["l_orderkey"], "l_quantity", "l_extendedprice", "skew")


@here("SELECT l_orderkey, line, CASE WHEN abs(l_quantity - 25) > 20 THEN 'tilted' WHEN l_discount > 0.05 THEN 'stained' WHEN l_partkey < 40 THEN 'faint' ELSE 'clean' END AS tier FROM v_lines")
def wording_tier(spark, sf):
    return view(spark, sf, "v_lines").select("l_orderkey", "line", reports.wording_tier((C("l_quantity") - 25) / 8, C("l_discount"), C("l_partkey")).alias("tier"))


_REGIONS = "SELECT page, box_id, CASE WHEN x0 < 100 THEN 'Table' WHEN x0 < 200 THEN 'Picture' ELSE 'Text' END AS label, CASE WHEN y0 < 80 THEN ' ' ELSE 'words' END AS words FROM v_boxes"


@here(f"WITH r AS (SELECT *, CASE WHEN label = 'Table' THEN 'table' ELSE 'text' END AS kind FROM ({_REGIONS}) WHERE label <> 'Picture') SELECT page, box_id, label, words, kind, coalesce(CASE WHEN kind = 'text' AND trim(words) <> '' THEN sum((kind = 'text' AND trim(words) <> '')::INT) OVER (PARTITION BY page ORDER BY box_id) - 1 END, -1)::BIGINT AS reading_order FROM r")
def region_routing(spark, sf):
    return reports.route_regions(view(spark, sf, _REGIONS), ["page"], "box_id", "label", "words").na.fill(-1, ["reading_order"])


@here("WITH t AS (SELECT o_custkey AS doc, o_orderkey AS k FROM orders), v AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT doc, count(*) AS tables, count(v.k) AS reviewed, CASE WHEN count(v.k) = 0 THEN 'open' WHEN count(v.k) < count(*) THEN 'partial' ELSE 'done' END AS status FROM t LEFT JOIN v ON t.k = v.k GROUP BY 1")
def document_summary(spark, sf):
    reviews = view(spark, sf, "SELECT l_orderkey AS k, l_returnflag = 'R' AS verified FROM lineitem")
    return reports.document_summary(view(spark, sf, "SELECT o_custkey AS doc, o_orderkey AS k FROM orders"), reviews, ["doc"], ["k"])


@here("SELECT event_type, count(*) AS documents, sum(user_id)::BIGINT AS pages, row_number() OVER (ORDER BY count(*) DESC, event_type)::INT AS rank FROM events GROUP BY 1")
def class_report(spark, sf):
    return reports.class_report(view(spark, sf, "events"), "event_type", "user_id")


@here("WITH w AS (SELECT engine, round(avg(amount) FILTER (WHERE dataset = 'set0'), 6) AS set0, round(avg(amount) FILTER (WHERE dataset = 'set1'), 6) AS set1 FROM v_runs GROUP BY 1) SELECT * FROM w UNION ALL SELECT 'MEAN', round(avg(set0), 6), round(avg(set1), 6) FROM w")
def recognizer_side_by_side(spark, sf):
    wide = stats.mean_matrix(view(spark, sf, "v_runs"), "engine", "dataset", ["set0", "set1"], "amount").select("engine", F.round("set0", 6).alias("set0"), F.round("set1", 6).alias("set1"))
    return reports.with_mean_row(wide, "engine", ["set0", "set1"]).select("engine", F.round("set0", 6).alias("set0"), F.round("set1", 6).alias("set1"))


@here("SELECT l_orderkey, line, l_linenumber FROM v_lines QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, line) = 1")
def best_strip_row(spark, sf):
    return reports.best_strip(view(spark, sf, "SELECT l_orderkey, line, l_linenumber FROM v_lines"), ["l_orderkey"], "l_linenumber", "line")


@here("SELECT l_orderkey, line, n, coalesce(sum(greatest(n, 1)) OVER (PARTITION BY l_orderkey ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT l_orderkey, line, l_linenumber - 1 AS n FROM v_lines)")
def band_offsets(spark, sf):
    return reports.band_offsets(view(spark, sf, "SELECT l_orderkey, line, l_linenumber - 1 AS n FROM v_lines"), ["l_orderkey"], "line", "n")


@here("SELECT conv_id, turn, coalesce(sum(len(text) + 2) OVER w, 0)::BIGINT AS start, coalesce(sum(len(text) + 2) OVER w, 0)::BIGINT + len(text) AS \"end\" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def segment_offsets(spark, sf):
    return reports.segment_offsets(view(spark, sf, "SELECT conv_id, turn, text FROM conversations"), ["conv_id"], "turn", "text").drop("text")


@here("WITH f AS (SELECT user_id, event_id, event_type = 'view' AS t, coalesce(lag(event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id), false) AS p FROM events), r AS (SELECT *, sum((t AND NOT p)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f), g AS (SELECT user_id, run, count(*) FILTER (WHERE t) AS len, count(*) AS n, max((t AND NOT p)::INT) AS hit FROM r GROUP BY 1, 2) SELECT user_id, max(len) AS longest, sum(n)::BIGINT AS n, sum(hit)::BIGINT AS runs FROM g GROUP BY 1")
def longest_run(spark, sf):
    return reports.longest_run(view(spark, sf, "SELECT user_id, event_id, event_type FROM events"), ["user_id"], "event_id", C("event_type") == "view")


@here("SELECT event_type, event_id, coalesce(lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id), min(event_id) OVER (PARTITION BY event_type)) AS \"next\" FROM events")
def wrap_next(spark, sf):
    return reports.next_in_band(view(spark, sf, "SELECT event_type, event_id FROM events"), ["event_type"], "event_id")


@here("SELECT page, round(max((x1 - x0) * (y1 - y0)) / ((max(x1) - min(x0)) * (max(y1) - min(y0))), 9) AS cover, max((x1 - x0) * (y1 - y0)) / ((max(x1) - min(x0)) * (max(y1) - min(y0))) >= 0.8 AS one FROM v_boxes GROUP BY 1")
def region_cover(spark, sf):
    b = view(spark, sf, "v_boxes").withColumn("box", geo.box(*(C(c) for c in ("x0", "y0", "x1", "y1"))))
    return reports.covered_as_one(b, ["page"], "box", 0.8).withColumn("cover", F.round("cover", 9))


@here("SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) AS text, min(value) AS confidence FROM events GROUP BY 1")
def chunk_confidence(spark, sf):
    return reports.chunk_confidence(view(spark, sf, "events"), ["user_id"], "event_id", "event_type", "value")


@here("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag <> 'N') = 0 AND sum(l_linenumber) = sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END)")
def silent_epochs(spark, sf):
    d = view(spark, sf, "SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END AS f, l_linenumber AS t, CASE WHEN l_returnflag <> 'N' THEN 1 END AS s FROM lineitem")
    return reports.silent_epochs(d, ["l_orderkey"], "f", "t", "s")


_SPANS = "SELECT l_orderkey AS k, line AS o, 0 AS r, l_partkey % 6 AS a, l_partkey % 6 + l_suppkey % 3 AS b FROM v_lines"


@here(f"""WITH RECURSIVE p AS ({_SPANS}), f AS (SELECT k, o, r, a, b, (b > a) AS took, CASE WHEN b > a THEN [struct_pack(a := a, b := b)] ELSE [] END AS got FROM p WHERE o = 0
    UNION ALL SELECT p.k, p.o, p.r, p.a, p.b, p.b > p.a AND len(list_filter(f.got, lambda g: g.a <= p.b AND p.a <= g.b)) = 0, CASE WHEN p.b > p.a AND len(list_filter(f.got, lambda g: g.a <= p.b AND p.a <= g.b)) = 0 THEN list_append(f.got, struct_pack(a := p.a, b := p.b)) ELSE f.got END FROM f JOIN p ON p.k = f.k AND p.o = f.o + 1)
    SELECT k, o, r, a, b FROM f WHERE took""")
def span_merge(spark, sf):
    return reports.spans_merged(view(spark, sf, _SPANS), ["k"], "o", "r", "a", "b")


@here("SELECT o_orderkey, 'Prices of ' || strftime(o_orderdate, '%d.%m') || ' (' || o_orderstatus || ')' AS title, 'Food rice|Food|Food kilo' AS header, (o_orderkey % 100)::VARCHAR AS number, 'Khmer rice' AS rest FROM orders")
def title_and_header(spark, sf):
    d = view(spark, sf, "orders")
    header = reports.two_row_header(F.array(*map(F.lit, ("Food", "", ""))), F.array(*map(F.lit, ("rice", "", "kilo"))))
    row = reports.split_row_number(F.concat((C("o_orderkey") % 100).cast("string"), F.lit(" Khmer rice")))
    return d.select("o_orderkey", reports.template_filled("Prices of {day} ({kind})", day=F.date_format("o_orderdate", "dd.MM"), kind=C("o_orderstatus")).alias("title"), F.array_join(header, "|").alias("header"), row["number"].alias("number"), row["rest"].alias("rest"))


@here("SELECT user_id, event_id, event_type AS name, CASE WHEN k = 1 THEN event_type ELSE event_type || '_' || k END AS sheet FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id) AS k FROM events)")
def sheet_dedupe(spark, sf):
    return reports.sheet_numbers(view(spark, sf, "SELECT user_id, event_id, event_type AS name FROM events"), ["user_id"], "event_id", "name")


@here("WITH m AS (SELECT b.page, a.box_id AS lo, b.box_id, count(*) OVER (PARTITION BY b.page, a.box_id) AS claims FROM v_boxes a JOIN v_boxes b ON a.page = b.page AND a.x0 = b.x0) SELECT * FROM m WHERE claims > 1")
def contested_matches(spark, sf):
    b = view(spark, sf, "SELECT b.page, a.box_id AS lo, b.box_id FROM v_boxes a JOIN v_boxes b ON a.page = b.page AND a.x0 = b.x0")
    return joins.contested(b, ["page"], "lo")


@here("WITH v AS (SELECT g.table_id, g.col_id, p.col_id AS raw_col, count(*) AS votes FROM v_grid4 g JOIN v_pred p ON g.table_id = p.table_id AND g.row_id = p.row_id AND g.text = p.text WHERE g.text <> '' GROUP BY 1, 2, 3), m AS (SELECT table_id, col_id, arg_max(raw_col, votes * 100 - raw_col) AS raw_col FROM v GROUP BY 1, 2), s AS (SELECT m.table_id, m.col_id, p.row_id, p.text AS seen FROM m JOIN v_pred p ON p.table_id = m.table_id AND p.col_id = m.raw_col) SELECT g.table_id, g.row_id, g.col_id, CASE WHEN regexp_full_match(trim(seen), '[0-9]+') THEN seen ELSE g.text END AS text FROM v_grid4 g LEFT JOIN s USING (table_id, row_id, col_id)")
def apply_mapping(spark, sf):
    t, raw = view(spark, sf, "v_grid4"), view(spark, sf, "v_pred")
    return joins.mapped(t, raw, joins.column_votes(t, raw, ["table_id"]), ["table_id"])


@here("SELECT o.o_orderkey, o_orderstatus, coalesce(n, 0) AS n FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def loss_meta_join(spark, sf):
    n = view(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return view(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(n, "o_orderkey", "left").na.fill(0, ["n"])


@here("SELECT doc_id, (regexp_extract(source, 'src([0-9]+)', 1))::INT AS stem, row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS first FROM documents")
def distinct_stems(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.regexp_extract("source", r"src(\d+)", 1).cast("int").alias("stem"))
    lead = overlays.first_by(d, ["stem"], ["doc_id"]).select("doc_id", F.lit(True).alias("first"))
    return d.join(lead, "doc_id", "left").withColumn("first", F.coalesce("first", F.lit(False)))


@here("SELECT l_orderkey AS table_id, line AS row_id, CASE WHEN trim(l_returnflag) = 'R' THEN '' ELSE l_returnflag END AS flag, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT - 1 AS new_row FROM v_lines")
def renumber_rows(spark, sf):
    d = view(spark, sf, "SELECT l_orderkey AS table_id, line AS row_id, l_linenumber, l_returnflag FROM v_lines")
    out = tb.renumbered(d, ["table_id"], ["l_linenumber"])
    return out.select("table_id", "row_id", tx.trim_ws(F.when(C("l_returnflag") == "R", " ").otherwise(C("l_returnflag"))).alias("flag"), "new_row")


@here("WITH c AS (SELECT table_id, row_id, max(col_id) AS w FROM v_cells GROUP BY 1, 2) SELECT o_custkey AS doc, count(*) AS tables, sum(rows)::BIGINT AS rows, max(cols)::INT AS cols FROM (SELECT table_id, count(*) AS rows, max(w) + 1 AS cols FROM c GROUP BY 1) t JOIN orders ON o_orderkey = table_id GROUP BY 1")
def stitch_sanity(spark, sf):
    t = tb.row_lengths(view(spark, sf, "v_cells"), ["table_id"]).groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"), F.max("length").alias("cols"))
    doc = view(spark, sf, "SELECT o_custkey AS doc, o_orderkey AS table_id FROM orders")
    return t.join(doc, "table_id").groupBy("doc").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.max("cols").cast("int").alias("cols"))


@here("SELECT table_id, CASE WHEN table_id % 5 = 0 THEN '' ELSE (table_id % 5)::VARCHAR END AS page, row_id + 1 AS \"row\", col_id + 1 AS col, 'low_conf' AS flag FROM v_cells WHERE confidence < 0.8 AND trim(text) <> ''")
def flags_export(spark, sf):
    own = tb.quality_flags(view(spark, sf, "v_cells"), ["table_id"]).where("flag = 'low_conf'")
    page = F.when(C("table_id") % 5 != 0, C("table_id") % 5 - 1)
    return reports.flag_rows(own.withColumn("page_index", page), ["table_id"], "page_index")


@here("WITH b AS (SELECT o_custkey AS page, count(*) FILTER (WHERE o_orderkey % 10 < 5) AS low FROM orders GROUP BY 1), t AS (SELECT o_custkey AS page, count(*) AS n FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1) SELECT page, low, coalesce(n, 0) AS tables, coalesce(n, 0) > 1 AS hint FROM b LEFT JOIN t USING (page)")
def page_banner(spark, sf):
    blocks = view(spark, sf, "orders").select(C("o_custkey").alias("page"), (C("o_orderkey") % 10 / 10).alias("confidence"))
    tables = view(spark, sf, "SELECT o_custkey AS page FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey")
    return reports.page_banner(blocks, tables, ["page"], "confidence")


@here("SELECT page, box_id, y1 - y0 = 60 AND x1 - x0 = 60 AS sound FROM v_boxes")
def crop_geometry(spark, sf):
    b = view(spark, sf, "v_boxes").withColumn("box", geo.box(*(C(c) for c in ("x0", "y0", "x1", "y1")))).withColumn("side", F.lit(60.0))
    return reports.crops_checked(b, "box", "side", "side").select("page", "box_id", "sound")


@here("SELECT conv_id, md5(string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS report FROM conversations GROUP BY 1")
def text_report(spark, sf):
    return reports.text_report(view(spark, sf, "SELECT conv_id, turn, text FROM conversations"), "conv_id", "turn", "text").withColumn("report", F.md5("report"))


@here("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'section' WHEN 1 THEN 'row' ELSE 'note' END AS kind, 'Text,Table' AS labels FROM part")
def paragraph_kinds(spark, sf):
    p = view(spark, sf, "part")
    text = F.when(C("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" /- kg"))).when(C("p_partkey") % 3 == 1, F.concat(F.lit("១២ "), "p_name")).otherwise(C("p_name"))
    raw = F.concat(F.lit("Here:\n```json\n"), F.lit('[{"label":"Text"},{"label":"Table"}]'), F.lit("\n``` done "), C("p_name"))
    return p.select("p_partkey", reports.paragraph_kind(text).alias("kind"), F.array_join(F.transform(markup.parse_regions(markup.unfenced(raw)), lambda r: r["label"]), ",").alias("labels"))


@here("WITH t AS (SELECT table_id, row_id, text, row_number() OVER (PARTITION BY table_id, row_id ORDER BY col_id) - 1 AS k FROM v_pred), p AS (SELECT table_id, row_id, list(col_id ORDER BY col_id) AS spots FROM v_grid4 WHERE col_id < 3 GROUP BY 1, 2) SELECT table_id, row_id, spots[least(k + 1, len(spots))] AS col_id, text FROM t JOIN p USING (table_id, row_id)")
def place_row(spark, sf):
    places = view(spark, sf, "SELECT table_id, row_id, col_id FROM v_grid4 WHERE col_id < 3")
    return reports.placed(view(spark, sf, "v_pred"), places, ["table_id", "row_id"], "col_id", "col_id")
