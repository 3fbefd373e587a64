"""Queries on single values: text, digits, numbers, boxes, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import dates
from loamgrid.functions import geometry as geo
from loamgrid.functions import markup
from loamgrid.functions import text as tx
from loamgrid.operators import boxes, evaluation, joins
from loamgrid.plans.registry import Registry
from loamgrid.plans.views import view
from loamgrid.sources import io

here = Registry()
C = F.col
KHMER = tx.KHMER_DIGITS

_SPACED = "SELECT doc_id, concat(' ', replace(text, ' ', '  '), '( x )', chr(9)) AS raw FROM documents"


@here(f"WITH d AS ({_SPACED}), n AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(raw), '\\s+', ' ', 'g')) AS t FROM d) SELECT doc_id, md5(t) AS norm, md5(replace(t, ' ', '')) AS folded, md5(regexp_replace(regexp_replace(t, '([(\\[])\\s+', '\\1', 'g'), '\\s+([)\\]])', '\\1', 'g')) AS spaces FROM n")
def cell_text_normalize(spark, sf):
    d = view(spark, sf, _SPACED)
    return d.select("doc_id", F.md5(tx.normalize(C("raw"))).alias("norm"), F.md5(F.replace(tx.collapse_ws(C("raw")), F.lit(" "), F.lit(""))).alias("folded"), F.md5(tx.fold_spaces(C("raw"))).alias("spaces"))


_NUMS = f"SELECT l_orderkey AS k, line, CASE WHEN l_partkey % 6 = 0 THEN concat('(', CAST(l_partkey AS STRING), ')') WHEN l_partkey % 6 = 1 THEN concat('-', CAST(l_partkey AS STRING), ',', CAST(100 + l_suppkey % 900 AS STRING)) WHEN l_partkey % 6 = 2 THEN concat(translate(CAST(l_partkey AS STRING), '0123456789', '{KHMER}'), '.5%') WHEN l_partkey % 6 = 3 THEN concat('+', CAST(l_partkey AS STRING)) WHEN l_partkey % 6 = 4 THEN concat(' ', CAST(l_partkey AS STRING), ' 00 ') ELSE concat(CAST(l_partkey AS STRING), ' kg') END AS raw FROM v_lines"


@here(f"""WITH n AS ({_NUMS}), a AS (SELECT k, line, raw, translate(regexp_replace(raw, '\\s', '', 'g'), '{KHMER}', '0123456789') AS s FROM n),
    b AS (SELECT *, suffix(s, '%') AS is_percent, CASE WHEN suffix(s, '%') THEN s[1:-2] ELSE s END AS p FROM a),
    c AS (SELECT *, prefix(p, '(') AND suffix(p, ')') AS br, CASE WHEN prefix(p, '(') AND suffix(p, ')') THEN p[2:-2] ELSE p END AS q FROM b),
    d AS (SELECT *, replace(CASE WHEN prefix(q, '-') THEN q[2:] ELSE q END, ',', '') AS r FROM c)
    SELECT k, line, raw, CASE WHEN regexp_full_match(r, '[0-9]+(\\.[0-9]+)?') THEN CASE WHEN br OR prefix(q, '-') THEN -(r::DOUBLE) ELSE r::DOUBLE END END AS value, is_percent FROM d""")
def parse_number(spark, sf):
    return view(spark, sf, _NUMS).withColumn("n", tx.parse_number(C("raw"))).select("k", "line", "raw", "n.value", "n.is_percent")


@here(f"SELECT k, line, translate(raw, '{KHMER}', '0123456789') AS folded, regexp_matches(raw, '[{KHMER}]') AS khmer, regexp_matches(raw, '[{KHMER}]') AND regexp_matches(raw, '[0-9]') AS mixed, regexp_full_match(trim(raw), '[+-]?[0-9,{KHMER}]*[0-9{KHMER}]([.,][0-9{KHMER}]+)?%?') AS plain FROM ({_NUMS})")
def khmer_digit_fold(spark, sf):
    return view(spark, sf, _NUMS).select("k", "line", tx.fold_digits(C("raw")).alias("folded"), tx.has_khmer_digit(C("raw")).alias("khmer"), tx.digits_mixed(C("raw")).alias("mixed"), tx.is_plain_number(C("raw")).alias("plain"))


_RULES = "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'អគ.ក' WHEN p_partkey % 7 = 1 THEN '#/គ្រាប់' WHEN p_partkey % 7 = 2 THEN 'អគៈក' WHEN p_partkey % 7 = 3 THEN concat('០.', CAST(p_partkey % 90 + 10 AS STRING), '%') WHEN p_partkey % 7 = 4 THEN '| -- |' WHEN p_partkey % 7 = 5 THEN concat('7,', CAST(8000 + p_partkey % 1000 AS STRING)) ELSE concat(CAST(p_partkey % 9000 + 10 AS STRING), '%') END AS raw, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 100 / 100.0 AS DOUBLE) END AS confidence FROM part"


@here(f"""SELECT k, CASE WHEN raw = 'អគ.ក' THEN '៛/គ.ក' WHEN raw = '#/គ្រាប់' THEN '៛/គ្រាប់' WHEN raw = 'អគៈក' THEN '៛/គ.ក' WHEN suffix(raw, '%') THEN translate(raw, '{KHMER}', '0123456789') ELSE raw END AS ruled,
    CASE WHEN raw = '| -- |' THEN '' ELSE raw END AS quiet, regexp_matches(raw, '[0-9],[0-9]{{4}}') OR regexp_full_match(raw, '[+-]?[0-9]{{2,}}%') AS malformed,
    CASE WHEN regexp_matches(raw, '[0-9],[0-9]{{4}}') OR regexp_full_match(raw, '[+-]?[0-9]{{2,}}%') THEN least(coalesce(confidence, 0.4), 0.4) ELSE confidence END AS capped FROM ({_RULES})""")
def domain_cell_rules(spark, sf):
    return view(spark, sf, _RULES).select("k", tx.cell_rules(C("raw")).alias("ruled"), tx.strip_noise(C("raw")).alias("quiet"), tx.malformed_number(C("raw")).alias("malformed"), tx.capped_confidence(C("raw"), C("confidence")).alias("capped"))


_FOREIGN = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('ไทย ', text, ' 中文 x') ELSE text END AS raw FROM documents"


@here(f"""WITH f AS (SELECT doc_id, raw, regexp_replace(raw, '[\\x{{0D80}}-\\x{{0DFF}}\\x{{0E00}}-\\x{{0EFF}}\\x{{1000}}-\\x{{109F}}\\x{{0600}}-\\x{{06FF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{3040}}-\\x{{30FF}}]', '', 'g') AS bare FROM ({_FOREIGN}))
    SELECT doc_id, md5(CASE WHEN len(bare) = len(raw) THEN raw ELSE trim(regexp_replace(bare, ' {{2,}}', ' ', 'g'), ' ') END) AS scrubbed, (len(raw) - len(bare))::INT AS removed, round((len(raw) - len(bare)) / len(regexp_replace(raw, '\\s', '', 'g'))::DOUBLE, 9) AS score FROM f""")
def foreign_script_scrub(spark, sf):
    return view(spark, sf, _FOREIGN).select("doc_id", F.md5(tx.strip_foreign(C("raw"))).alias("scrubbed"), tx.foreign_count(C("raw")).alias("removed"), F.round(tx.anomaly_score(C("raw")), 9).alias("score"))


_SEQ = "SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'ស្' WHEN p_partkey % 6 = 1 THEN 'ា' WHEN p_partkey % 6 = 2 THEN 'ស្ក' WHEN p_partkey % 6 = 3 THEN 'សាា' WHEN p_partkey % 6 = 4 THEN 'ក ាំ' ELSE p_name END AS raw FROM part"


@here(f"SELECT k, k % 6 IN (0, 1, 3, 4) AS illegal, NOT (k % 6 IN (0, 1, 4)) AS ordered FROM ({_SEQ})")
def sequence_illegal(spark, sf):
    return view(spark, sf, _SEQ).select("k", tx.sequence_illegal(C("raw")).alias("illegal"), tx.order_valid(C("raw")).alias("ordered"))


_LOCAL = "SELECT p_partkey AS k, CASE WHEN p_partkey % 8 = 0 THEN '$1,250' WHEN p_partkey % 8 = 1 THEN '(12.5)' WHEN p_partkey % 8 = 2 THEN '7,8000' WHEN p_partkey % 8 = 3 THEN '7,8000 USD' WHEN p_partkey % 8 = 4 THEN '០,៧១១៧' WHEN p_partkey % 8 = 5 THEN '12 kilogrammes of' WHEN p_partkey % 8 = 6 THEN 'សាច់គោ' ELSE '1.234,56 €' END AS raw FROM part"


@here(f"SELECT k, k % 8 IN (0, 1, 3, 4, 7) AS numeric, k % 8 = 6 AS khmer, k % 8 IN (1, 2, 4, 0, 3, 5, 7) AND k % 8 <> 6 AND (k % 8 <> 4 OR true) AS trusted FROM ({_LOCAL})")
def is_numeric_locale(spark, sf):
    return view(spark, sf, _LOCAL).select("k", tx.is_numeric(C("raw")).alias("numeric"), tx.is_khmer_text(C("raw")).alias("khmer"), tx.is_trusted(C("raw")).alias("trusted"))


@here("SELECT table_id, row_id, col_id, CASE WHEN confidence IS NULL THEN 'none' WHEN confidence < 0.8 THEN 'low' WHEN confidence < 0.95 THEN 'medium' ELSE 'high' END AS band FROM v_cells")
def confidence_bands(spark, sf):
    return view(spark, sf, "v_cells").select("table_id", "row_id", "col_id", tx.confidence_band(C("confidence")).alias("band"))


@here("SELECT doc_id, contains(lower(text), 'tion') AS hit, ((len(text) - len(replace(text, 'the', ''))) / 3)::INT AS n, substr(md5(text), 1, 12) AS id FROM documents")
def word_search(spark, sf):
    return view(spark, sf, "documents").select("doc_id", tx.matches(C("text"), "Tion").alias("hit"), tx.replace_count(C("text"), "the").alias("n"), tx.content_id(C("text")).alias("id"))


@here("SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderdate::DATE + 1 AS second FROM orders")
def bulletin_dates(spark, sf):
    d = view(spark, sf, "orders").withColumn("f", F.concat(F.lit("prices-"), F.date_format("o_orderdate", "dd.MM."), F.lit("xx"), F.lit(".pdf")))
    short = F.concat(F.lit("prices-"), F.date_format("o_orderdate", "dd.MM."), F.lpad(F.pmod(F.year("o_orderdate"), F.lit(100)).cast("string"), 2, "0"), F.lit(".pdf"))
    text = F.concat(F.lit("of "), F.date_format("o_orderdate", "dd-MM-"), F.lit("99 and "), F.date_format(F.date_add("o_orderdate", 1), "dd-MM-"), F.lpad(F.pmod(F.year(F.date_add("o_orderdate", 1)), F.lit(100)).cast("string"), 2, "0"))
    century = F.floor(F.year("o_orderdate") / 100) * 100 - 2000
    moved = lambda c: F.add_months(c, (century * 12).cast("int"))
    return d.select(C("o_orderkey").alias("k"), moved(dates.of_file_name(short)).alias("day"), F.add_months(dates.of_heading(text), ((F.floor(F.year(F.date_add("o_orderdate", 1)) / 100) * 100 - 2000) * 12).cast("int")).alias("second"))


_B = "SELECT page, box_id, x0, y0, x1, y1 FROM v_boxes"


def _boxes(spark, sf):
    return view(spark, sf, _B).withColumn("box", geo.box(*(C(c) for c in ("x0", "y0", "x1", "y1")))).select("page", "box_id", "box")


@here("SELECT a.page, a.box_id AS a, b.box_id AS b FROM v_boxes a JOIN v_boxes b ON a.page = b.page AND a.box_id < b.box_id AND a.x0 - 10 <= b.x1 + 10 AND b.x0 - 10 <= a.x1 + 10 AND a.y0 - 10 <= b.y1 + 10 AND b.y0 - 10 <= a.y1 + 10")
def box_overlap(spark, sf):
    return boxes.touching(_boxes(spark, sf), "page", "box_id", 10.0)


@here("""WITH RECURSIVE e AS (SELECT a.page, a.box_id AS a, b.box_id AS b FROM v_boxes a JOIN v_boxes b ON a.page = b.page AND a.x0 - 10 <= b.x1 + 10 AND b.x0 - 10 <= a.x1 + 10 AND a.y0 - 10 <= b.y1 + 10 AND b.y0 - 10 <= a.y1 + 10),
    r AS (SELECT page, box_id AS k, box_id AS c FROM v_boxes UNION SELECT r.page, r.k, e.b FROM r JOIN e ON r.page = e.page AND r.c = e.a),
    l AS (SELECT page, k, min(c) AS component FROM r GROUP BY 1, 2)
    SELECT l.page, component, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l JOIN v_boxes v ON v.page = l.page AND v.box_id = l.k GROUP BY 1, 2""")
def box_components(spark, sf):
    out = boxes.components(_boxes(spark, sf), "page", "box_id", 10.0)
    return out.select("page", "component", "n", *[C("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@here("""WITH m AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, y1, x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_boxes),
    s AS (SELECT *, sum((reach IS NULL OR y0 - reach > 20)::INT) OVER (PARTITION BY page ORDER BY y0, y1, x0, x1 ROWS UNBOUNDED PRECEDING) - 1 AS band FROM m)
    SELECT page, band::BIGINT AS band, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM s GROUP BY 1, 2""")
def rowband_islands(spark, sf):
    out = boxes.bands(_boxes(spark, sf), "page", 20.0)
    return out.select("page", "band", "n", *[C("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@here("WITH d AS (SELECT a.page, a.box_id AS box_id, b.box_id AS nearest_other, abs(a.x0 - b.x0) + abs(a.y0 - b.y0) AS distance FROM v_boxes a JOIN v_boxes b ON a.page = b.page WHERE b.x1 - b.x0 > 65 AND a.x1 - a.x0 <= 65) SELECT page, box_id, arg_min(nearest_other, distance * 1000 + nearest_other) AS nearest_other, min(distance) AS distance FROM d WHERE distance < 120 GROUP BY 1, 2")
def nearest_box(spark, sf):
    b = view(spark, sf, _B)
    left = b.where("x1 - x0 <= 65").select("page", "box_id", "x0", "y0")
    right = b.where("x1 - x0 > 65").select("page", C("box_id").alias("other"), C("x0").alias("u"), C("y0").alias("v"))
    return joins.nearest(left, right, ["page"], ("x0", "y0"), ("u", "v"), "other", 120.0).select("page", "box_id", "nearest_other", "distance")


@here("SELECT page, box_id, round((x1 - x0) * (y1 - y0), 6) AS area, greatest(0, least(x1, 300) - greatest(x0, 100)) * greatest(0, least(y1, 300) - greatest(y0, 100)) AS common, y0 * 2 AS top, round_even(x0 / 500 * 1000, 0)::INT AS left_thousandth FROM v_boxes")
def box_rescale(spark, sf):
    d = _boxes(spark, sf)
    page = F.array(*(F.lit(v) for v in (100.0, 100.0, 300.0, 300.0)))
    thousandths = F.array(C("box")[1], C("box")[0], C("box")[3], C("box")[2])
    coco = geo.to_thousandths(C("box")[0], C("box")[1], C("box")[2] - C("box")[0], C("box")[3] - C("box")[1], F.lit(500.0), F.lit(500.0))
    return d.select("page", "box_id", F.round(geo.area(C("box")), 6).alias("area"), geo.overlap(C("box"), page).alias("common"), geo.from_thousandths(thousandths, F.lit(2000.0), F.lit(2000.0))[1].alias("top"), coco[1].alias("left_thousandth"))


_JSON = """SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN '[{"label":"Table","text":"a"},{"label":"Text","text":"b"}]' WHEN p_partkey % 4 = 1 THEN '[{"label":"Table","text":"a"},{"label":"Te' WHEN p_partkey % 4 = 2 THEN '{"label":"Table"},{"label":"Text"}' ELSE 'garbage' END AS raw FROM part"""


@here("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Table,Text' WHEN 1 THEN 'Table' WHEN 2 THEN 'Table,Text' END AS labels FROM part")
def json_repair(spark, sf):
    return view(spark, sf, _JSON).select("k", F.array_join(F.transform(markup.parse_regions(C("raw")), lambda r: r["label"]), ",").alias("labels"))


@here("WITH l AS (SELECT item_id AS key, unnest(string_split(text, chr(10))) AS line FROM benchmark), m AS (SELECT l.key, contains(d.text, l.line) AS hit FROM l LEFT JOIN (SELECT doc_id AS key, text FROM documents) d USING (key)) SELECT key, count(*) AS lines, count(*) FILTER (WHERE hit) AS found, round(avg(coalesce(hit, false)::INT), 9) AS recall FROM m GROUP BY 1")
def para_recall(spark, sf):
    lines = view(spark, sf, "benchmark").select(C("item_id").alias("key"), F.explode(F.split("text", "\n")).alias("line"))
    pages = view(spark, sf, "documents").select(C("doc_id").alias("key"), "text")
    return evaluation.paragraph_recall(lines, pages, "key").withColumn("recall", F.round("recall", 9))


@here("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, role, text)) AS pooled FROM conversations GROUP BY 1")
def pooled_text(spark, sf):
    return evaluation.pooled_text(view(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role"]).select("conv_id", F.md5("pooled").alias("pooled"))


@here("SELECT page_id, CASE WHEN len(html) < 100 THEN 'scanned' ELSE 'latin' END AS kind, 'image' AS route FROM pages")
def pdf_class(spark, sf):
    p = view(spark, sf, "pages")
    return p.select("page_id", io.text_class(F.lit(0), F.length("html"), F.length("html")).alias("kind"), io.route_by_suffix(F.concat("page_id", F.lit(".PNG"))).alias("route"))


@here("SELECT o_custkey, CASE WHEN min(d) < 250 THEN 300 ELSE 200 END AS dpi FROM (SELECT o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 400 + 150 END AS d FROM orders) GROUP BY 1")
def auto_dpi(spark, sf):
    return io.auto_dpi(view(spark, sf, "SELECT o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 400 + 150 END AS d FROM orders"), "o_custkey", "d")


@here("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) FILTER (WHERE event_type <> coalesce(p, '') AND event_type <> 'view') AS collapsed FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1")
def run_length_ctc(spark, sf):
    seq = view(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    out = F.array_join(tx.ctc_collapse(C("s"), F.lit("view")), "")
    return seq.select("user_id", F.when(out != "", out).alias("collapsed"))
