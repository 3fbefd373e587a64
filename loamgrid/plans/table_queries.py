"""Queries on tables in long form: quality, repair, stitching, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import markup
from loamgrid.operators import evaluation as ev
from loamgrid.operators import joins, overlays
from loamgrid.operators import tables as tb
from loamgrid.plans.registry import Registry
from loamgrid.plans.views import view

here = Registry()
BY = ["table_id"]
_FLAGS = """
    body AS (SELECT *, try_cast(text AS DOUBLE) IS NOT NULL AS num FROM v_cells WHERE row_id > 0 AND trim(text) <> ''),
    numcol AS (SELECT table_id, col_id FROM body GROUP BY 1, 2 HAVING avg(CASE WHEN regexp_matches(translate(text, '០១២៣៤៥៦៧៨៩', '0123456789'), '^[0-9]+$') THEN 1.0 ELSE 0 END) >= 0.7),
    len AS (SELECT table_id, row_id, count(*) AS n FROM v_cells GROUP BY 1, 2),
    cnt AS (SELECT table_id, n, count(*) AS c, min(row_id) AS f FROM len GROUP BY 1, 2),
    maj AS (SELECT table_id, n FROM cnt QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY c DESC, f) = 1),
    tot AS (SELECT table_id, sum(c) AS rows FROM cnt GROUP BY 1),
    flags AS (
        SELECT table_id, row_id, col_id, text, 'low_conf' AS flag FROM v_cells WHERE confidence < 0.8 AND trim(text) <> ''
        UNION ALL SELECT table_id, row_id, col_id, text, 'digit_mixed' FROM v_cells WHERE regexp_matches(text, '[០-៩]') AND regexp_matches(text, '[0-9]')
        UNION ALL SELECT b.table_id, b.row_id, b.col_id, b.text, 'unparseable_number' FROM body b JOIN numcol USING (table_id, col_id) WHERE NOT regexp_matches(translate(text, '០១២៣៤៥៦៧៨៩', '0123456789'), '^[0-9]+$')
        UNION ALL SELECT c.table_id, c.row_id, c.col_id, c.text, 'ragged_row' FROM v_cells c JOIN len USING (table_id, row_id) JOIN maj ON maj.table_id = c.table_id JOIN tot ON tot.table_id = c.table_id WHERE tot.rows >= 3 AND len.n <> maj.n)
"""


@here(f"WITH {_FLAGS} SELECT * FROM flags")
def dq_flags(spark, sf):
    return tb.quality_flags(view(spark, sf, "v_cells"), BY)


@here(f"WITH {_FLAGS} SELECT flag, count(*) AS n, list_position(['low_conf', 'sequence_illegal', 'digit_mixed', 'unparseable_number', 'ragged_row', 'numeric_mismatch'], flag)::BIGINT AS place FROM flags GROUP BY 1")
def dq_page_summary(spark, sf):
    return tb.flag_summary(tb.quality_flags(view(spark, sf, "v_cells"), BY), [])


@here(f"""WITH {_FLAGS}, r AS (SELECT table_id, row_id, col_id, min(list_position(['numeric_mismatch', 'sequence_illegal', 'digit_mixed', 'unparseable_number', 'ragged_row', 'low_conf'], flag)) AS k FROM flags GROUP BY 1, 2, 3)
    SELECT table_id, row_id, col_id, ['numeric_mismatch', 'sequence_illegal', 'digit_mixed', 'unparseable_number', 'ragged_row', 'low_conf'][k] AS reason,
           row_number() OVER (PARTITION BY table_id ORDER BY (k = 6)::INT, k, coalesce(confidence, 1), row_id, col_id)::INT AS rank FROM r JOIN v_cells USING (table_id, row_id, col_id)""")
def triage(spark, sf):
    cells = view(spark, sf, "v_cells")
    return tb.triage(tb.quality_flags(cells, BY), cells, BY)


@here("WITH len AS (SELECT table_id, row_id, count(*) AS n FROM v_cells GROUP BY 1, 2), cnt AS (SELECT table_id, n, count(*) AS c, min(row_id) AS f FROM len GROUP BY 1, 2), t AS (SELECT table_id, sum(c)::BIGINT AS n_rows FROM cnt GROUP BY 1) SELECT table_id, n AS majority, n_rows FROM cnt JOIN t USING (table_id) QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY c DESC, f) = 1")
def majority_len(spark, sf):
    return tb.majority_length(view(spark, sf, "v_cells"), BY)


@here("""WITH len AS (SELECT table_id, row_id, count(*) AS n FROM v_cells GROUP BY 1, 2), cnt AS (SELECT table_id, n, count(*) AS c, min(row_id) AS f FROM len GROUP BY 1, 2),
    maj AS (SELECT table_id, n AS m FROM cnt QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY c DESC, f) = 1),
    gap AS (SELECT table_id, row_id, unnest(range(0, m)) AS col_id FROM len JOIN maj USING (table_id) WHERE n < m)
    SELECT table_id, row_id, col_id, text, false AS added FROM v_cells UNION ALL SELECT table_id, row_id, col_id::INT, '', true FROM gap WHERE NOT EXISTS (SELECT 1 FROM v_cells c WHERE c.table_id = gap.table_id AND c.row_id = gap.row_id AND c.col_id = gap.col_id)""")
def repair_table(spark, sf):
    return tb.repair(view(spark, sf, "v_cells").drop("confidence"), BY)


@here("WITH s AS (SELECT table_id, max(row_id) AS r, max(col_id) AS c FROM v_cells GROUP BY 1), a AS (SELECT table_id, c, unnest(range(0, r + 1)) AS row_id FROM s), p AS (SELECT table_id, row_id::INT AS row_id, unnest(range(0, c + 1))::INT AS col_id FROM a) SELECT p.*, coalesce(text, '') AS text FROM p LEFT JOIN v_cells USING (table_id, row_id, col_id)")
def grid_dense(spark, sf):
    return tb.dense(view(spark, sf, "v_cells"), BY)


@here("SELECT table_id, row_id, coalesce(max(CASE WHEN col_id = 0 THEN text END), '') AS c0, coalesce(max(CASE WHEN col_id = 1 THEN text END), '') AS c1, coalesce(max(CASE WHEN col_id = 2 THEN text END), '') AS c2, coalesce(max(CASE WHEN col_id = 3 THEN text END), '') AS c3 FROM v_pred GROUP BY 1, 2")
def grid_pivot(spark, sf):
    return tb.wide(view(spark, sf, "v_pred"), BY, 4)


_CSV = "WITH r AS (SELECT table_id, row_id, string_agg(text, ',' ORDER BY col_id) AS l FROM v_grid4 GROUP BY 1, 2) SELECT table_id, chr(65279) || string_agg(l || chr(13) || chr(10), '' ORDER BY row_id) AS csv FROM r GROUP BY 1"


@here(_CSV)
def grid_csv(spark, sf):
    return tb.grids(view(spark, sf, "v_grid4"), BY).select("table_id", markup.to_csv(F.col("grid")).alias("csv"))


@here("WITH r AS (SELECT table_id, row_id, '| ' || string_agg(text, ' | ' ORDER BY col_id) || ' |' AS l FROM v_grid4 GROUP BY 1, 2) SELECT table_id, string_agg(CASE WHEN row_id = 0 THEN l || chr(10) || '| --- | --- | --- | --- |' ELSE l END, chr(10) ORDER BY row_id) AS markdown FROM r GROUP BY 1")
def grid_markdown(spark, sf):
    return tb.grids(view(spark, sf, "v_grid4"), BY).select("table_id", markup.to_markdown(F.col("grid")).alias("markdown"))


@here("SELECT table_id, row_id, col_id, text FROM v_grid4")
def markdown_roundtrip(spark, sf):
    grids = tb.grids(view(spark, sf, "v_grid4"), BY).select("table_id", markup.from_markdown(markup.to_markdown(F.col("grid"))).alias("grid"))
    rows = grids.select("table_id", F.posexplode("grid").alias("row_id", "r"))
    return rows.select("table_id", "row_id", F.posexplode("r").alias("col_id", "text"))


@here("SELECT table_id, row_id, col_id, text, 1 AS col_span FROM v_grid4")
def html_roundtrip(spark, sf):
    grids = tb.grids(view(spark, sf, "v_grid4"), BY).select("table_id", markup.to_html(F.col("grid")).alias("html"))
    return markup.html_cells(grids, "table_id", "html").withColumnsRenamed({"row": "row_id", "col": "col_id"})


@here("WITH t AS (SELECT table_id, string_agg(text, chr(31) ORDER BY row_id, col_id) AS x FROM v_grid4 GROUP BY 1) SELECT table_id, len(x)::INT AS n FROM t")
def doc_json(spark, sf):
    """Length of all texts after a round trip through the document's JSON."""
    cells = view(spark, sf, "v_grid4").withColumn("confidence", F.lit(None).cast("double")).withColumn("doc", F.col("table_id"))
    kind = "tables array<struct<table_index:long,cells:array<struct<row:int,col:int,text:string,confidence:double>>>>"
    back = tb.document_json(cells, "doc", "table_id").select("doc", F.from_json("json", kind).alias("j"))
    texts = F.transform(F.flatten(F.transform(F.col("j.tables"), lambda t: t["cells"])), lambda c: c["text"])
    return back.select(F.col("doc").alias("table_id"), F.length(F.array_join(texts, "\x1f")).alias("n"))


@here("""WITH RECURSIVE o AS (SELECT o_custkey AS document, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey AS page, o_orderkey % 5 + 1 AS width FROM orders),
    f AS (SELECT document, k, page, width, width AS anchor, 0 AS part FROM o WHERE k = 1
          UNION ALL SELECT o.document, o.k, o.page, o.width, CASE WHEN abs(o.width - f.anchor) <= 1 THEN f.anchor ELSE o.width END, CASE WHEN abs(o.width - f.anchor) <= 1 THEN f.part ELSE f.part + 1 END FROM f JOIN o ON o.document = f.document AND o.k = f.k + 1)
    SELECT document, page, width, part::INT AS part FROM f""")
def stitch_tables(spark, sf):
    widths = view(spark, sf, "SELECT o_custkey AS document, o_orderkey AS page, o_orderkey % 5 + 1 AS width FROM orders")
    return tb.stitched_groups(widths, "document", "page", "width")


_SIGNED = "SELECT o_custkey AS document, o_orderkey AS page, line AS row_id, CASE WHEN line = 0 THEN 'head' WHEN l_partkey % 7 = 0 THEN ' ' ELSE l_shipmode END AS signature FROM v_lines JOIN orders ON l_orderkey = o_orderkey"
_SIGNED = _SIGNED.replace("l_shipmode", "concat(l_returnflag, l_linestatus)")


@here(f"""WITH s AS ({_SIGNED}), m AS (SELECT *, min(page) OVER (PARTITION BY document) AS f FROM s), k AS (SELECT document, page, row_id, signature FROM m WHERE NOT (row_id = 0 AND page > f) AND trim(signature) <> '')
    SELECT *, (row_number() OVER (PARTITION BY document ORDER BY page, row_id) - 1)::INT AS new_row FROM k""")
def stitch_rows(spark, sf):
    return tb.stitched_rows(view(spark, sf, _SIGNED), ["document"], "page")


_TOTALS = "SELECT l_orderkey AS table_id, line AS row_id, 0 AS col_id, line % 4 = 3 AS t, l_partkey % 29 = 0 AS pct, l_suppkey % 19 = 0 AS blank, CASE WHEN l_suppkey % 23 = 0 OR l_suppkey % 19 = 0 THEN NULL ELSE CAST(floor(l_quantity) AS DOUBLE) END AS v FROM v_lines"


@here(f"""WITH c AS ({_TOTALS}),
    p AS (SELECT *, coalesce(sum(t::INT) OVER (PARTITION BY table_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM c),
    g AS (SELECT table_id, part, coalesce(sum(v) FILTER (WHERE NOT t AND NOT pct AND NOT blank), 0) AS expected, count(*) FILTER (WHERE NOT t AND NOT blank) AS filled, count(*) FILTER (WHERE NOT t AND NOT blank AND v IS NULL) AS odd, max(v) FILTER (WHERE t) AS total, max(row_id) FILTER (WHERE t) AS row_id FROM p GROUP BY 1, 2)
    SELECT table_id, row_id, 0 AS col_id, total, expected FROM g WHERE filled > 0 AND odd = 0 AND abs(total - expected) > 0.5""")
def segmented_total_check(spark, sf):
    return tb.total_mismatch(view(spark, sf, _TOTALS), BY, F.col("t"), F.col("v"), F.col("pct"), F.col("blank"))


_TITLED = "SELECT table_id, row_id, col_id, CASE WHEN row_id = 0 AND col_id > 0 AND table_id % 3 = 0 THEN '' ELSE text END AS text FROM v_grid4"


@here(f"WITH c AS ({_TITLED}), t AS (SELECT table_id FROM c WHERE row_id = 0 GROUP BY 1 HAVING max(CASE WHEN col_id = 0 AND trim(text) <> '' THEN 1 ELSE 0 END) = 1 AND sum(CASE WHEN col_id > 0 AND trim(text) <> '' THEN 1 ELSE 0 END) = 0) SELECT c.table_id, c.row_id - (t.table_id IS NOT NULL)::INT AS row_id, col_id, text FROM c LEFT JOIN t USING (table_id) WHERE NOT (t.table_id IS NOT NULL AND row_id = 0)")
def strip_title(spark, sf):
    return tb.without_title(view(spark, sf, _TITLED), BY)


@here("WITH g AS (SELECT table_id, text, count(*) AS n FROM v_grid4 WHERE text <> '' GROUP BY 1, 2), p AS (SELECT table_id, text, count(*) AS m FROM v_pred WHERE text <> '' GROUP BY 1, 2) SELECT table_id, sum(least(n, coalesce(m, 0)))::BIGINT AS found, sum(n)::BIGINT AS total, sum(least(n, coalesce(m, 0))) / sum(n)::DOUBLE AS recall FROM g LEFT JOIN p USING (table_id, text) GROUP BY 1")
def multiset_recall(spark, sf):
    return ev.multiset_recall(view(spark, sf, "v_grid4"), view(spark, sf, "v_pred"), BY)


@here("WITH k AS (SELECT *, row_number() OVER (PARTITION BY table_id, text ORDER BY row_id, col_id) AS k FROM v_grid4), p AS (SELECT table_id, text, count(*) AS m FROM v_pred GROUP BY 1, 2) SELECT table_id, row_id, col_id, text, k <= coalesce(m, 0) AS matched FROM k LEFT JOIN p USING (table_id, text)")
def greedy_consumption(spark, sf):
    return ev.consumed(view(spark, sf, "v_grid4"), view(spark, sf, "v_pred"), BY).select("table_id", "row_id", "col_id", "text", "matched")


@here("SELECT CASE WHEN confidence < .5 THEN '[0,.5)' WHEN confidence < .8 THEN '[.5,.8)' WHEN confidence < .95 THEN '[.8,.95)' ELSE '[.95,1]' END AS bucket, count(*) AS n, count(*) FILTER (WHERE truth = guess) AS matched FROM v_scored WHERE truth <> '' GROUP BY 1")
def calibration(spark, sf):
    return ev.calibration(view(spark, sf, "v_scored"))


_MODE = "CASE WHEN truth IS NOT DISTINCT FROM guess THEN 'match' WHEN guess IS NULL THEN 'absent' WHEN trim(guess) = '' THEN 'blank' WHEN replace(truth, ' ', '') = replace(guess, ' ', '') THEN 'spacing' ELSE 'misread' END"


@here(f"WITH m AS (SELECT col_id, {_MODE} AS mode FROM v_scored), n AS (SELECT col_id, mode, count(*) AS n FROM m WHERE mode <> 'match' GROUP BY 1, 2) SELECT col_id, mode, n, n / (sum(n) OVER (PARTITION BY col_id))::DOUBLE AS share FROM n")
def miss_taxonomy(spark, sf):
    return ev.taxonomy(view(spark, sf, "v_scored"), ["col_id"])


@here("WITH m AS (SELECT table_id, row_id, text, last_value(CASE WHEN text = 'R' THEN concat('from ', row_id::STRING) END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_id) AS s FROM v_grid4 WHERE col_id = 3) SELECT table_id, row_id, text, coalesce(s, '(preamble/header)') AS section FROM m")
def section_fill(spark, sf):
    rows = view(spark, sf, "SELECT table_id, row_id, text FROM v_grid4 WHERE col_id = 3")
    return tb.section_of(rows, BY, "row_id", F.when(F.col("text") == "R", F.concat(F.lit("from "), F.col("row_id").cast("string"))))


@here("WITH t AS (SELECT table_id, max(row_id) + 1 AS rows, max(col_id) + 1 AS cols FROM v_grid4 GROUP BY 1), p AS (SELECT table_id, max(row_id) + 1 AS p_rows, max(col_id) + 1 AS p_cols FROM v_pred GROUP BY 1) SELECT table_id, rows, cols, coalesce(p_rows, 0)::INT AS p_rows, coalesce(p_cols, 0)::INT AS p_cols, rows = coalesce(p_rows, 0) AND cols = coalesce(p_cols, 0) AS same_shape, cols = coalesce(p_cols, 0) AS same_cols FROM t LEFT JOIN p USING (table_id)")
def shape_metrics(spark, sf):
    return ev.shapes(view(spark, sf, "v_grid4"), view(spark, sf, "v_pred"), BY)


@here("WITH b AS (SELECT col_id, truth AS t, coalesce(guess, '') AS p FROM v_scored), c AS (SELECT *, regexp_full_match(t, '[0-9]+') AS number, CASE WHEN regexp_full_match(t, '[0-9]+') THEN replace(t, ' ', '') = replace(p, ' ', '') ELSE trim(t) = trim(p) END AS same FROM b) SELECT col_id, count(*) AS cells, count(*) FILTER (WHERE same) AS exact, count(*) FILTER (WHERE number) AS numeric, count(*) FILTER (WHERE number AND same) AS numeric_exact, count(*) FILTER (WHERE t = '') AS empty, count(*) FILTER (WHERE t = '' AND same) AS empty_exact FROM c GROUP BY 1")
def class_accuracy_positional(spark, sf):
    t, p = view(spark, sf, "v_grid4"), view(spark, sf, "v_pred")
    one = ev.class_accuracy(t.withColumn("c", F.col("col_id")), p.withColumn("c", F.col("col_id")), ["table_id", "c"])
    return one.groupBy(F.col("c").alias("col_id")).agg(*[F.sum(x).alias(x) for x in ("cells", "exact", "numeric", "numeric_exact", "empty", "empty_exact")])


#: What an engine read: one letter too many in the last column, spaces where they do not matter, a number misread.
_READ = "SELECT table_id, row_id, col_id, CASE WHEN col_id = 3 AND (table_id * 7 + row_id) % 3 = 0 THEN concat(text, 'x') WHEN col_id = 0 AND row_id % 2 = 1 THEN concat(' ', text, ' ') WHEN col_id = 2 AND text = '' AND row_id = 2 THEN '|' ELSE text END AS text FROM v_grid4"


@here(f"""WITH p AS (SELECT table_id, row_id, col_id, trim(text) AS p FROM ({_READ})), b AS (SELECT table_id, row_id, col_id, text AS t, p, regexp_full_match(text, '[0-9]+') AS num FROM v_grid4 JOIN p USING (table_id, row_id, col_id)),
    tc AS (SELECT table_id, t, count(*) AS n FROM b WHERE t <> '' GROUP BY 1, 2), pc AS (SELECT table_id, p AS t, count(*) AS m FROM b GROUP BY 1, 2),
    rc AS (SELECT table_id, sum(least(n, coalesce(m, 0))) / sum(n)::DOUBLE AS recall FROM tc LEFT JOIN pc USING (table_id, t) GROUP BY 1),
    j AS (SELECT table_id, string_agg(t, ' ' ORDER BY row_id, col_id) FILTER (WHERE t <> '') AS a, string_agg(p, ' ' ORDER BY row_id, col_id) FILTER (WHERE p <> '') AS z FROM b GROUP BY 1),
    c AS (SELECT table_id, max(row_id) + 1 AS r, count(*) AS cells, count(*) FILTER (WHERE t = p) AS ok, count(*) FILTER (WHERE num) AS nt, count(*) FILTER (WHERE num AND t = p) AS nc, count(*) FILTER (WHERE t = '') AS e, count(*) FILTER (WHERE t = '' AND p = '') AS ec FROM b GROUP BY 1)
    SELECT table_id, 1::BIGINT AS tables_found, r::BIGINT AS gt_rows, 4::BIGINT AS gt_cols, r::BIGINT AS pred_rows, 4::BIGINT AS pred_cols, ok / cells::DOUBLE AS cell_accuracy, recall AS cell_content_recall, levenshtein(a, z) / len(a)::DOUBLE AS table_cer,
        cells AS cells_total, ok AS cells_correct, 0::BIGINT AS khmer_cells_total, 0::BIGINT AS khmer_cells_correct, 0.0::DOUBLE AS khmer_cell_accuracy, nt AS numeric_cells_total, nc AS numeric_cells_correct, nc / nt::DOUBLE AS numeric_cell_accuracy, 0::BIGINT AS numeric_cells_khmer_digit_slips,
        e AS empty_gt_cells_total, ec AS empty_gt_cells_clean, CASE WHEN e > 0 THEN ec / e::DOUBLE END AS empty_cell_precision, true AS grid_shape_match, true AS col_count_match, 1.0::DOUBLE AS row_alignment_rate, 1.0::DOUBLE AS col_alignment_rate
    FROM c JOIN rc USING (table_id) JOIN j USING (table_id)""")
def table_metrics(spark, sf):
    """All metrics where rows and columns stay in place, so that SQL can tell them; alignment proper is tested by brute force."""
    return ev.table_metrics(view(spark, sf, "v_grid4"), view(spark, sf, _READ))


@here()
def aligned_table_metrics(spark, sf):
    """All metrics where cells are lost and misread, so that rows and columns must be aligned first."""
    return ev.table_metrics(view(spark, sf, "v_grid4"), view(spark, sf, "v_pred"))


@here("WITH s AS (SELECT l_orderkey AS table_id, l_linenumber AS part, line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, line) - 1 AS row_id, l_returnflag AS text FROM v_lines) SELECT table_id, row_id::INT AS row_id, 0 AS col_id, text FROM s")
def stacked_parts(spark, sf):
    cells = view(spark, sf, "SELECT l_orderkey AS table_id, l_linenumber AS part, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY line) - 1 AS INT) AS row_id, 0 AS col_id, l_returnflag AS text FROM v_lines")
    return ev.stacked(cells, "table_id", "part")


@here("SELECT s_nationkey, round(sum(levenshtein(s_name, concat(s_name, 'x'))) / sum(length(s_name))::DOUBLE, 9) AS micro, round(avg(levenshtein(s_name, concat(s_name, 'x')) / length(s_name)::DOUBLE), 9) AS macro FROM supplier GROUP BY 1")
def cer_micro_macro(spark, sf):
    pairs = view(spark, sf, "SELECT s_nationkey, s_name AS truth, concat(s_name, 'x') AS guess FROM supplier")
    return ev.error_rate(pairs, ["s_nationkey"], "truth", "guess").select("s_nationkey", F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


@here("WITH t AS (SELECT table_id, row_id, col_id, text, unnest([0, 1, 2, 3]) AS o FROM v_grid4), h AS (SELECT t.table_id, o, count(*) AS hits FROM t WHERE EXISTS (SELECT 1 FROM v_pred p WHERE p.table_id = t.table_id AND p.row_id = t.row_id + o AND p.col_id = t.col_id AND p.text = t.text) GROUP BY 1, 2) SELECT table_id, arg_max(o, hits * 10 - o) AS \"offset\", max(hits) AS hits FROM h GROUP BY 1")
def best_offset(spark, sf):
    return ev.offset_votes(view(spark, sf, "v_grid4"), view(spark, sf, "v_pred"), BY)


_PRINTS = "SELECT table_id, row_id, string_agg(trim(text), '|' ORDER BY col_id) AS print FROM {} WHERE regexp_full_match(trim(text), '[0-9]+') GROUP BY 1, 2 HAVING count(*) >= 2"


@here(f"WITH a AS ({_PRINTS.format('v_grid4')}), b AS ({_PRINTS.format('v_pred')}), a1 AS (SELECT print FROM a GROUP BY 1 HAVING count(*) = 1), b1 AS (SELECT print FROM b GROUP BY 1 HAVING count(*) = 1) SELECT print, a.table_id, a.row_id, b.table_id AS p_table, b.row_id AS p_row FROM a JOIN b USING (print) WHERE print IN (FROM a1) AND print IN (FROM b1)")
def fingerprint_join(spark, sf):
    trim = lambda v: view(spark, sf, v).withColumn("text", F.trim("text"))
    right = joins.fingerprints(trim("v_pred"), BY).select(F.col("table_id").alias("p_table"), F.col("row_id").alias("p_row"), "print")
    return joins.unique_match(joins.fingerprints(trim("v_grid4"), BY), right, "print")


@here("WITH v AS (SELECT g.table_id, g.col_id, p.col_id AS raw_col, count(*) AS votes FROM v_grid4 g JOIN v_pred p ON g.table_id = p.table_id AND g.row_id = p.row_id AND g.text = p.text WHERE g.text <> '' GROUP BY 1, 2, 3) SELECT table_id, col_id, arg_max(raw_col, votes * 100 - raw_col) AS raw_col, max(votes) AS votes FROM v GROUP BY 1, 2")
def template_mapping(spark, sf):
    return joins.column_votes(view(spark, sf, "v_grid4"), view(spark, sf, "v_pred"), BY)


@here("WITH b AS (SELECT g.col_id, g.text AS t, p.text AS m FROM v_grid4 g LEFT JOIN v_pred p USING (table_id, row_id, col_id) WHERE regexp_full_match(g.text, '[0-9]+')) SELECT col_id, count(*) AS n, round(avg((replace(t, ' ', '') IS NOT DISTINCT FROM replace(m, ' ', ''))::INT), 9) AS exact FROM b GROUP BY 1")
def numeric_fidelity(spark, sf):
    return joins.fidelity(view(spark, sf, "v_grid4"), view(spark, sf, "v_pred"), BY).withColumn("exact", F.round("exact", 9))


_SEEN = "WITH p AS (SELECT table_id, row_id, string_agg(text, ',' ORDER BY col_id) AS sig FROM v_grid4 WHERE col_id = 3 GROUP BY 1, 2)"


@here(f"{_SEEN} SELECT table_id, count(*)::BIGINT AS n FROM p JOIN (SELECT table_id, sig AS head FROM p WHERE row_id = 0) USING (table_id) WHERE row_id > 0 AND sig = head GROUP BY 1")
def duplicate_headers(spark, sf):
    rows = view(spark, sf, "v_grid4").where("col_id = 3").groupBy("table_id", "row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "text"))), lambda x: x["text"]), ",").alias("sig"))
    head = rows.where("row_id = 0").select("table_id", F.col("sig").alias("head"))
    return rows.where("row_id > 0").join(head, "table_id").where("sig = head").groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))


@here("SELECT table_id, row_id, col_id, coalesce(e.text, g.text) AS text FROM v_grid4 g LEFT JOIN (SELECT table_id, row_id, col_id, 'edited' AS text FROM v_grid4 WHERE text LIKE '%3') e USING (table_id, row_id, col_id)")
def text_overlay(spark, sf):
    base = view(spark, sf, "v_grid4")
    return overlays.overlay(base, base.where("text LIKE '%3'").withColumn("text", F.lit("edited")), ["table_id", "row_id", "col_id"], "text")

