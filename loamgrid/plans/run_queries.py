"""Queries on evaluation runs, splits and mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.operators import joins, overlays, splits, stats
from loamgrid.plans.registry import Registry
from loamgrid.plans.views import view

here = Registry()
C = F.col


@here("""WITH r AS (SELECT engine, coalesce(font, '') AS font, dataset, try_cast(metric AS DOUBLE) AS metric, found::DOUBLE AS found, expected::DOUBLE AS expected FROM v_runs)
    SELECT CASE WHEN grouping(engine) = 0 THEN 'engine' WHEN grouping(font) = 0 THEN 'font' ELSE 'dataset' END AS key, CASE WHEN grouping(engine) = 0 THEN engine WHEN grouping(font) = 0 THEN font ELSE dataset END AS value,
           count(*) AS n, round(coalesce(avg(metric), 0), 6) AS mean_metric, round(coalesce(sum(found) / nullif(sum(expected), 0), 0), 9) AS ratio FROM r GROUP BY GROUPING SETS ((engine), (font), (dataset))""")
def bench_summary_sets(spark, sf):
    out = stats.summary_sets(view(spark, sf, "v_runs"), ["engine", "font", "dataset"], ["metric"], "found", "expected")
    return out.withColumn("mean_metric", F.round("mean_metric", 6)).withColumn("ratio", F.round("ratio", 9))


@here("SELECT engine, arg_max(ord, amount * 10000000 - ord) AS best, arg_min(ord, amount * 10000000 + ord) AS worst FROM v_runs GROUP BY 1")
def bench_best_worst(spark, sf):
    return stats.extremes(view(spark, sf, "v_runs"), ["engine"], "amount", "ord", "ord")


@here("SELECT font, round(avg(try_cast(metric AS DOUBLE)), 6) AS mean FROM v_runs WHERE coalesce(font, '') <> '' GROUP BY 1")
def bench_group_mean(spark, sf):
    return stats.group_mean(view(spark, sf, "v_runs"), "font", "metric").withColumn("mean", F.round("mean", 6))


@here("SELECT engine, round(avg(try_cast(metric AS DOUBLE)) FILTER (WHERE dataset = 'set0'), 6) AS set0, round(avg(try_cast(metric AS DOUBLE)) FILTER (WHERE dataset = 'set1'), 6) AS set1, round(avg(try_cast(metric AS DOUBLE)) FILTER (WHERE dataset = 'none'), 6) AS none FROM v_runs GROUP BY 1")
def bench_pivot(spark, sf):
    out = stats.mean_matrix(view(spark, sf, "v_runs"), "engine", "dataset", ["set0", "set1", "none"], "metric")
    return out.select("engine", *[F.round(c, 6).alias(c) for c in ("set0", "set1", "none")])


@here("SELECT engine, dataset, median(amount) AS median, max(amount) - min(amount) AS spread, count(amount) AS n FROM v_runs GROUP BY 1, 2")
def bench_median_spread(spark, sf):
    return stats.median_spread(view(spark, sf, "v_runs"), ["engine", "dataset"], "amount")


@here("SELECT engine, count(*) AS n, count(*) FILTER (WHERE found = expected) AS all_found, count(*) FILTER (WHERE metric = '') AS unmeasured FROM v_runs GROUP BY 1")
def bench_conditional_counts(spark, sf):
    return stats.conditional_counts(view(spark, sf, "v_runs"), ["engine"], all_found=C("found") == C("expected"), unmeasured=C("metric") == "")


@here("SELECT run, round(avg(amount), 6) AS mean, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS dims, count(DISTINCT dataset) = 1 AS stable FROM v_runs GROUP BY 1")
def bench_stability(spark, sf):
    return stats.stability(view(spark, sf, "v_runs"), ["run"], "dataset", "amount").withColumn("mean", F.round("mean", 6))


@here("WITH k AS (SELECT engine, amount, row_number() OVER (PARTITION BY engine ORDER BY amount) - 1 AS k, count(*) OVER (PARTITION BY engine) AS n FROM v_runs) SELECT engine, max(n) AS n, max(amount) FILTER (WHERE k = n // 10) AS p10, max(amount) FILTER (WHERE k = n * 9 // 10) AS p90 FROM k GROUP BY 1")
def discrete_percentiles(spark, sf):
    return stats.discrete_percentiles(view(spark, sf, "v_runs"), ["engine"], "amount")


@here("SELECT run, round(coalesce(avg((amount < 10000)::INT) FILTER (WHERE metric <> ''), 0), 9) AS share, coalesce(avg((amount < 10000)::INT) FILTER (WHERE metric <> ''), 0) > 0.4 AS reroute FROM v_runs GROUP BY 1")
def auto_route(spark, sf):
    rows = view(spark, sf, "v_runs").withColumn("c", F.when(C("metric") != "", C("amount")))
    return stats.low_share(rows, ["run"], "c", 10000, 0.4).withColumn("share", F.round("share", 9))


@here("SELECT l_orderkey AS key, min(l_returnflag) AS value FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def lexicon_conflicts(spark, sf):
    return stats.without_conflicts(view(spark, sf, "SELECT l_orderkey AS key, l_returnflag AS value FROM lineitem"), "key", "value")


@here("SELECT run, dataset, count(DISTINCT amount) AS n FROM v_runs GROUP BY 1, 2 HAVING count(DISTINCT amount) > 1")
def ambiguous_groups(spark, sf):
    return stats.repeated(view(spark, sf, "v_runs").select("run", "dataset", "amount"), ["run", "dataset"])


@here("SELECT engine, count(*) FILTER (WHERE dataset = 'set0') AS set0, count(*) FILTER (WHERE dataset = 'set1') AS set1, count(*) FILTER (WHERE dataset = 'set2') AS set2, count(*) AS total FROM v_runs GROUP BY 1")
def cross_tab(spark, sf):
    return stats.share_table(view(spark, sf, "v_runs"), ["engine"], "dataset", ["set0", "set1", "set2"])


_WORDS = "SELECT user_id, event_id, event_type, CASE WHEN event_id % 6 = 0 THEN -1 ELSE CAST(floor(value) AS BIGINT) END AS conf FROM events"


@here(f"SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) AS line, min(event_id) AS x0, round(avg(conf) FILTER (WHERE conf <> -1), 6) AS mean_conf FROM ({_WORDS}) GROUP BY 1")
def line_blocks(spark, sf):
    return stats.line_blocks(view(spark, sf, _WORDS), ["user_id"], "event_id", "event_type", "conf").withColumn("mean_conf", F.round("mean_conf", 6))


@here("SELECT ord, run, amount // 5000 AS x, amount // 5000 + 0.5 * (row_number() OVER (PARTITION BY run, amount // 5000 ORDER BY ord) - 1 - (count(*) OVER (PARTITION BY run, amount // 5000) - 1) / 2) AS moved FROM v_runs")
def jitter(spark, sf):
    rows = view(spark, sf, "v_runs").select("ord", "run", F.expr("amount div 5000").alias("x"))
    return stats.jitter(rows, ["run"], ["ord"], "x", 0.5)


@here("SELECT ord, run, dataset, count(*) OVER (PARTITION BY run, dataset) AS n_same FROM v_runs QUALIFY count(*) OVER (PARTITION BY run, dataset) > 1")
def label_collisions(spark, sf):
    return stats.collisions(view(spark, sf, "v_runs").select("ord", "run", "dataset"), ["run", "dataset"])


@here("WITH e AS (SELECT table_id, row_id, col_id, text, text = '' AS e, count(*) FILTER (WHERE text <> '') OVER (PARTITION BY table_id) AS filled, row_number() OVER (PARTITION BY table_id, text = '' ORDER BY row_id, col_id) AS k FROM v_cells) SELECT table_id, row_id, col_id, text FROM e WHERE NOT e OR k <= floor(filled * 0.2 / 0.8 + 1e-9)")
def cap_negatives(spark, sf):
    rows = view(spark, sf, "v_cells").select("table_id", "row_id", "col_id", "text")
    return stats.bounded_empties(rows, ["table_id"], C("text") == "", 0.2, ["row_id", "col_id"])


@here("SELECT page, box_id, row_number() OVER (ORDER BY page, box_id) - 1 AS id FROM v_boxes")
def running_ids(spark, sf):
    return stats.running_ids(view(spark, sf, "SELECT page, box_id FROM v_boxes"), ["page", "box_id"])


@here("""WITH b AS (SELECT *, CASE WHEN day IS NULL THEN 1 WHEN datediff('day', lag(day) OVER (PARTITION BY series, day IS NULL ORDER BY day, doc), day) <= 60 THEN 0 ELSE 1 END AS new FROM v_bulletins)
    SELECT doc, series, era, concat(CASE WHEN day IS NULL THEN 'u' ELSE 'd' END, sum(new) OVER (PARTITION BY series, day IS NULL ORDER BY day, doc ROWS UNBOUNDED PRECEDING)::BIGINT) AS cluster FROM b""")
def date_clusters(spark, sf):
    return splits.date_clusters(view(spark, sf, "v_bulletins"), ["series"], "day", "doc", gap=60).drop("day")


@here("""WITH c AS (SELECT era, series, min(doc * 7919 % 10007) AS o FROM v_bulletins GROUP BY 1, 2), k AS (SELECT era, series, row_number() OVER (PARTITION BY era ORDER BY o, series) AS k, count(*) OVER (PARTITION BY era) AS n FROM c),
    s AS (SELECT era, series, CASE WHEN k <= greatest(n // 10, (n >= 3)::INT) THEN 'test' WHEN k <= greatest(n // 10, (n >= 3)::INT) + greatest(n // 10, (n >= 2)::INT) THEN 'valid' ELSE 'train' END AS split FROM k)
    SELECT b.doc, b.series, b.era, split FROM v_bulletins b JOIN s USING (era, series)""")
def stratified_split(spark, sf):
    return splits.clustered_split(view(spark, sf, "SELECT doc, series, era FROM v_bulletins"), "era", "series", C("doc") * 7919 % 10007)


@here("""WITH u AS (SELECT 'documents' AS source, doc_id AS id FROM documents UNION ALL SELECT 'pages', page_id FROM pages UNION ALL SELECT 'benchmark', item_id FROM benchmark)
    SELECT source, id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY id * 7919 % 10007, id) <= greatest(1, count(*) OVER (PARTITION BY source) // 20) THEN 'val' ELSE 'train' END AS split FROM u""")
def training_mix(spark, sf):
    parts = {"documents": view(spark, sf, "documents").select(C("doc_id").alias("id")), "pages": view(spark, sf, "pages").select(C("page_id").alias("id")), "benchmark": view(spark, sf, "benchmark").select(C("item_id").alias("id"))}
    return splits.training_mix(parts, "id", C("id") * 7919 % 10007)


@here("SELECT md5(text) AS id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def doc_dedup(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.md5("text").alias("id"))
    return overlays.first_by(d, ["id"], ["doc_id"])


@here("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_antijoin(spark, sf):
    orders = view(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return overlays.resumed(orders, view(spark, sf, "lineitem").select(C("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@here("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def gt_semijoin(spark, sf):
    return view(spark, sf, "orders").select("o_orderkey", "o_custkey").join(view(spark, sf, "lineitem").select(C("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@here("SELECT event_id AS id, event_type AS kind, -1 AS turn, 0 AS part FROM events UNION ALL SELECT conv_id, role, turn, 1 FROM conversations")
def union_runs(spark, sf):
    return joins.same_order_union(view(spark, sf, "SELECT event_id AS id, event_type AS kind FROM events"), view(spark, sf, "SELECT conv_id AS id, role AS kind, turn FROM conversations")).na.fill(-1, ["turn"])


@here("SELECT text, least(a, b) AS n FROM (SELECT text, count(*) AS a FROM v_grid4 GROUP BY 1) JOIN (SELECT text, count(*) AS b FROM v_pred GROUP BY 1) USING (text)")
def multiset_intersect(spark, sf):
    both = view(spark, sf, "v_grid4").select("text").intersectAll(view(spark, sf, "v_pred").select("text"))
    return both.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@here("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_per_epoch(spark, sf):
    return overlays.first_by(view(spark, sf, "SELECT user_id, event_id, event_type, ts FROM events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@here("SELECT ord, run, CASE engine WHEN 'view' THEN 'Look' WHEN 'click' THEN 'Press' ELSE 'Text' END AS label, NOT contains(engine, 'ie') AND NOT contains(engine, 'gn') AS kept FROM v_runs")
def label_map(spark, sf):
    rows = view(spark, sf, "v_runs").select("ord", "run", "engine")
    kept = joins.without_any(rows, "engine", ["ie", "gn"]).select("ord", F.lit(True).alias("kept"))
    return rows.select("ord", "run", joins.mapped_label(C("engine"), {"view": "Look", "click": "Press"}, "Text").alias("label")).join(kept, "ord", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@here("WITH a AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank FROM events), b AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rank FROM orders) SELECT k, rank::INT AS rank, event_id, o_orderkey FROM a JOIN b USING (k, rank)")
def positional_join(spark, sf):
    return joins.zipped(view(spark, sf, "SELECT user_id AS k, event_id FROM events"), view(spark, sf, "SELECT o_custkey AS k, o_orderkey FROM orders"), ["k"], ["event_id"], ["o_orderkey"])


@here("WITH a AS (SELECT l_orderkey AS k, line, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) - 1 AS rank, count(*) OVER (PARTITION BY l_orderkey) AS x FROM v_lines), b AS (SELECT table_id AS k, text, row_number() OVER (PARTITION BY table_id ORDER BY row_id) - 1 AS rank, count(*) OVER (PARTITION BY table_id) AS y FROM v_pred WHERE col_id = 1) SELECT k, rank::INT AS rank, line, text FROM a JOIN b USING (k, rank) WHERE x = y")
def zip_label_join(spark, sf):
    right = view(spark, sf, "SELECT table_id AS k, row_id, text FROM v_pred WHERE col_id = 1")
    return joins.zipped(view(spark, sf, "SELECT l_orderkey AS k, line FROM v_lines"), right, ["k"], ["line"], ["row_id"], whole=True).drop("row_id")
