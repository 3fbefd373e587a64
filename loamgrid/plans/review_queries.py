"""Queries of the review surface: edits, settings, scopes, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import markup
from loamgrid.operators import joins, overlays
from loamgrid.operators import tables as tb
from loamgrid.plans.registry import Registry
from loamgrid.plans.views import view

here = Registry()
C = F.col
KEY = ["table_id", "row_id", "col_id"]
#: Tables whose first cell was edited, as whole tables.
_EDITS = "SELECT g.table_id, g.row_id, g.col_id, concat(g.text, '!') AS text FROM v_grid4 g JOIN (SELECT table_id FROM v_grid4 WHERE row_id = 0 AND col_id = 3 AND text = 'R') e ON e.table_id = g.table_id"


@here(f"WITH e AS ({_EDITS}) SELECT *, true AS edited FROM e UNION ALL SELECT table_id, row_id, col_id, text, false FROM v_grid4 WHERE table_id NOT IN (SELECT table_id FROM e)")
def apply_edits(spark, sf):
    return overlays.apply_edits(view(spark, sf, "v_grid4"), view(spark, sf, _EDITS))


@here("SELECT table_id, row_id, col_id, g.text AS old, p.text AS new FROM v_grid4 g JOIN v_pred p USING (table_id, row_id, col_id) WHERE trim(g.text) <> trim(p.text)")
def capture_changes(spark, sf):
    return overlays.genuine_changes(view(spark, sf, "v_grid4"), view(spark, sf, "v_pred"), KEY)


@here("SELECT table_id, row_id, col_id, coalesce(g.text, '-') AS old, coalesce(p.text, '-') AS new, CASE WHEN g.text IS NULL THEN 'added' WHEN p.text IS NULL THEN 'removed' ELSE 'changed' END AS change FROM v_grid4 g FULL JOIN v_pred p USING (table_id, row_id, col_id) WHERE g.text IS DISTINCT FROM p.text")
def grid_diff(spark, sf):
    return overlays.grid_diff(view(spark, sf, "v_grid4"), view(spark, sf, "v_pred"), KEY).na.fill("-", ["old", "new"])


@here("SELECT table_id, row_id, col_id, replace(text, '1', 'one') AS text, len(text) - len(replace(text, '1', '')) AS replacements FROM v_grid4 WHERE contains(text, '1')")
def replace_count(spark, sf):
    return overlays.replaced(view(spark, sf, "v_grid4"), "1", "one").withColumn("replacements", C("replacements").cast("long"))


@here("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def edit_log_latest(spark, sf):
    return overlays.latest(view(spark, sf, "SELECT user_id, event_id, event_type FROM events"), ["user_id"], "event_id", keep=3)


@here("SELECT table_id, CASE WHEN row_id >= 1 THEN row_id + 1 ELSE row_id END AS row_id, col_id, text FROM v_grid4")
def row_insert_shift(spark, sf):
    return overlays.insert_row(view(spark, sf, "v_grid4"), 1)


@here("WITH m AS (SELECT *, max(row_id) OVER (PARTITION BY table_id) AS last FROM v_grid4) SELECT table_id, CASE WHEN row_id > 0 THEN row_id - 1 ELSE row_id END AS row_id, col_id, text FROM m WHERE row_id <> 0 OR last = 0")
def row_delete_shift(spark, sf):
    return overlays.delete_row(view(spark, sf, "v_grid4"), ["table_id"], 0)


@here("WITH b AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, unnest(string_split(text, chr(10))) AS text FROM documents) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY len(text), k) - 1)::INT AS place, k::INT AS k, md5(text) AS text FROM b WHERE trim(text) <> ''")
def reading_order_blocks(spark, sf):
    blocks = view(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return overlays.reading_order(blocks, ["doc_id"], F.struct(F.length("text"), "k")).withColumn("text", F.md5("text"))


@here("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_brand WHEN p_size < 20 THEN 'default' ELSE p_type END AS label FROM part")
def block_labels(spark, sf):
    region = F.when(C("p_size") < 10, C("p_brand")).when(C("p_size") < 20, F.lit(" "))
    return view(spark, sf, "part").select("p_partkey", overlays.label_of(region, C("p_type"), "default").alias("label"))


@here("SELECT o_orderkey, 'plain' AS engine, CASE WHEN o_orderstatus = 'F' THEN '300' ELSE 'auto' END AS dpi, (o_orderstatus = 'F')::INT AS changed FROM orders")
def settings_overlay(spark, sf):
    default = F.create_map(F.lit("engine"), F.lit("plain"), F.lit("dpi"), F.lit("auto"))
    draft = F.when(C("o_orderstatus") == "F", F.create_map(F.lit("dpi"), F.lit("300"), F.lit("gone"), F.lit("x")))
    used = overlays.settings(default, draft)
    return view(spark, sf, "orders").select("o_orderkey", used["engine"].alias("engine"), used["dpi"].alias("dpi"), overlays.overrides(default, used).alias("changed"))


@here("SELECT count(*) FILTER (WHERE o_orderstatus IN ('O')) AS pending, coalesce(sum(greatest(o_orderkey % 7 - o_custkey % 5, 0)) FILTER (WHERE o_orderstatus = 'F'), 0)::BIGINT AS unverified FROM orders")
def queue_counters(spark, sf):
    return overlays.queue_counters(view(spark, sf, "SELECT CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'running' END AS status, o_orderkey % 7 AS total, o_custkey % 5 AS reviewed FROM orders"))


@here("WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, 7 AS n FROM lineitem), g AS (SELECT doc, min(page) AS first, max(page) AS last, count(DISTINCT page) AS k, max(n) AS n FROM p GROUP BY 1) SELECT doc, first, last, CASE WHEN k = n THEN 'all' WHEN k = 1 THEN 'single' WHEN last - first + 1 = k THEN 'range' ELSE 'list' END AS scope FROM g")
def page_scope_encode(spark, sf):
    return overlays.page_scope(view(spark, sf, "SELECT l_orderkey AS doc, l_linenumber AS page, 7 AS n FROM lineitem"), ["doc"], "page", "n")


@here("SELECT table_id, row_id, col_id, CASE WHEN contains(text, '1') THEN concat('<', text, '>') ELSE text END AS text FROM v_grid4")
def lexicon_lookup(spark, sf):
    cells = view(spark, sf, "v_grid4")
    lexicon = cells.where("text LIKE '%1%'").select(C("text").alias("key"), F.concat(F.lit("<"), "text", F.lit(">")).alias("label")).distinct()
    return joins.corrected(cells, lexicon)


@here("SELECT table_id, row_id, max(CASE WHEN col_id = 0 THEN text END) AS a, max(CASE WHEN col_id = 1 THEN text END) AS b, 'pad' AS c FROM v_grid4 GROUP BY 1, 2")
def grid_to_rectangular(spark, sf):
    grids = tb.grids(view(spark, sf, "SELECT * FROM v_grid4 WHERE col_id < 2"), ["table_id"])
    rows = grids.select("table_id", F.posexplode(markup.rectangular(C("grid"), 3)).alias("row_id", "r"))
    return rows.select("table_id", "row_id", C("r")[0].alias("a"), C("r")[1].alias("b"), F.when(C("r")[2] == "", "pad").alias("c"))


@here("WITH f AS (SELECT table_id, count(DISTINCT col_id) FILTER (WHERE trim(text) <> '')::INT AS width FROM v_cells GROUP BY 1), n AS (SELECT table_id, row_id, count(*) AS n FROM v_cells GROUP BY 1, 2), v AS (SELECT table_id, min(n) = max(n) AS valid FROM n GROUP BY 1) SELECT * FROM f JOIN v USING (table_id)")
def grid_validity(spark, sf):
    grids = tb.grids(view(spark, sf, "v_cells"), ["table_id"])
    return grids.select("table_id", markup.width(markup.prune_empty_columns(C("grid"))).alias("width"), markup.is_rectangular(C("grid")).alias("valid"))
