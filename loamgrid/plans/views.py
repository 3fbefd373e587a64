"""Stand-ins for document tables, derived from the driver's star schema.

Each is one SQL text that Spark and DuckDB read alike: integer arithmetic and
floor() where their casts differ, and orders over all columns where keys repeat.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loamgrid.staging import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_LINES = """SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS INT) AS line FROM lineitem"""

VIEWS = {
    # Cells of tables (orders), rows are line numbers; repeated line numbers make rows ragged.
    "v_cells": """
        SELECT l_orderkey AS table_id, CAST(l_linenumber - 1 AS INT) AS row_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS INT) AS col_id,
               CASE WHEN l_partkey % 11 = 0 THEN 'n/a' WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN concat('12៣', CAST(l_suppkey AS STRING)) ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) END AS text,
               CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST((l_partkey % 100) / 100.0 AS DOUBLE) END AS confidence
        FROM lineitem""",
    # Rectangular tables of four columns.
    "v_lines": _LINES,
    "v_grid4": """
        SELECT l_orderkey AS table_id, line AS row_id, 0 AS col_id, CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) AS text FROM v_lines
        UNION ALL SELECT l_orderkey, line, 1, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) FROM v_lines
        UNION ALL SELECT l_orderkey, line, 2, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END FROM v_lines
        UNION ALL SELECT l_orderkey, line, 3, l_returnflag FROM v_lines""",
    # The same, as an engine would read it: cells lost, misread or spaced.
    "v_pred": """
        SELECT table_id, row_id, col_id, CASE WHEN (table_id * 7 + row_id + col_id) % 13 = 0 THEN concat(text, 'x') WHEN (table_id * 5 + row_id + col_id) % 29 = 0 THEN concat(' ', text) ELSE text END AS text
        FROM v_grid4 WHERE NOT (col_id = 1 AND text LIKE '%7')""",
    "v_boxes": """
        SELECT l_orderkey AS page, line AS box_id, CAST(l_partkey * 7 % 400 AS DOUBLE) AS x0, CAST(l_suppkey * 37 % 400 AS DOUBLE) AS y0,
               CAST(l_partkey * 7 % 400 + 40 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey * 37 % 400 + 60 AS DOUBLE) AS y1 FROM v_lines""",
    "v_runs": """
        SELECT event_id AS ord, event_type AS engine, CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('font', CAST(user_id % 4 AS STRING)) END AS font, concat('set', CAST(event_id % 3 AS STRING)) AS dataset,
               CASE WHEN event_id % 9 = 0 THEN '' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) END AS metric, CAST(event_id % 4 AS STRING) AS found, CAST(event_id % 5 AS STRING) AS expected,
               CAST(floor(value * 100) AS BIGINT) AS amount, CAST(user_id AS BIGINT) AS run
        FROM events""",
    "v_bulletins": """SELECT o_orderkey AS doc, o_custkey AS series, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, o_orderstatus AS era FROM orders""",
    "v_scored": """
        SELECT g.table_id, g.row_id, g.col_id, g.text AS truth, p.text AS guess, CAST((g.table_id * 31 + g.row_id * 7 + g.col_id) % 100 / 100.0 AS DOUBLE) AS confidence
        FROM v_grid4 g LEFT JOIN v_pred p ON g.table_id = p.table_id AND g.row_id = p.row_id AND g.col_id = p.col_id""",
}


#: What Spark reads in place of a text above: the same rows from one scan.
_IN_SPARK = {
    "v_grid4": """
        SELECT l_orderkey AS table_id, line AS row_id, stack(4, 0, CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING), 1, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING),
               2, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END, 3, l_returnflag) AS (col_id, text) FROM v_lines""",
}


def _used(sql: str) -> list[str]:
    """Views that a text needs, each after those that it needs itself."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in (*_used(VIEWS[name]), name) if x not in out]
    return out


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view by name, a driver table by name, or any SQL text over both; the session's own views are left alone."""
    ship(spark)
    if sql in TABLES:
        return spark.read.parquet(f"{sf_dir}/{sql}.parquet")
    text = VIEWS.get(sql, sql)
    names = [*_used(text), *([sql] if sql in VIEWS else [])]
    parts = {n: _IN_SPARK.get(n, VIEWS[n]) for n in names}
    tables = [t for t in TABLES if any(re.search(rf"\b{t}\b", x) for x in (text, *parts.values()))]
    heads = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in tables} | parts
    return spark.sql(_headed(f"SELECT * FROM {sql}" if sql in VIEWS else text, heads))


def oracle(sql: str) -> str:
    """The text with the views that it needs in front, for DuckDB."""
    names = _used(sql)
    if not names:
        return sql
    return _headed(sql, {n: VIEWS[n] for n in names})


def _headed(sql: str, heads: dict[str, str]) -> str:
    """The text with named ones in front."""
    front = ", ".join(f"{n} AS ({text})" for n, text in heads.items())
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {front}, {re.sub(r'(?i)^with\s+recursive', '', body)}"
    return f"WITH {front}, {re.sub(r'(?i)^with', '', body)}" if re.match(r"(?i)with\b", body) else f"WITH {front} {body}"
