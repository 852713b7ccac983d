"""Corpus relations derived from the star-schema tables, as SQL that Spark and DuckDB both read.

Each relation covers its whole source tables. ``Views`` gives them as DataFrames,
``with_views`` prefixes an oracle query with the same definitions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import checkpointed

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FIXTURES: dict[str, str] = {
    "grid": """
SELECT CAST(FLOOR(l_orderkey/1500) AS INT) AS wb_id, CAST(FLOOR(l_orderkey/150) AS INT) % 10 AS sheet_idx,
  CAST(l_orderkey % 150 + 1 AS INT) AS row_no, CAST(l_linenumber AS INT) AS col_no,
  MIN(CASE WHEN l_partkey % 11 = 0 THEN 0.0 WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS v_num,
  MIN(CASE WHEN l_partkey % 97 = 0 THEN '#REF!' WHEN l_partkey % 89 = 0 THEN '#N/A' END) AS v_err,
  CAST(MIN(l_partkey % 8) AS INT) AS style_id, MIN(l_suppkey) AS ref_key
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "sheets": """
SELECT wb_id, sheet_idx, 'S' || CAST(sheet_idx AS VARCHAR(10)) AS sheet,
  CASE WHEN (wb_id * 3 + sheet_idx) % 7 = 0 THEN 'hidden' ELSE 'visible' END AS state,
  CASE WHEN (wb_id + sheet_idx * 3) % 4 = 0 THEN 80 ELSE 100 END AS zoom, MAX(row_no) AS max_row, MAX(col_no) AS max_col
FROM grid GROUP BY 1, 2""",
    "formulas": """
SELECT wb_id, sheet_idx, row_no, col_no,
  CASE ref_key % 8
    WHEN 0 THEN 'SUM(A1:A' || CAST(row_no AS VARCHAR(10)) || ')'
    WHEN 1 THEN 'S1!B' || CAST(row_no AS VARCHAR(10))
    WHEN 2 THEN 'S2!C3*B' || CAST(row_no AS VARCHAR(10))
    WHEN 3 THEN 'OFFSET(A1,1,' || CAST(col_no AS VARCHAR(10)) || ')'
    WHEN 4 THEN 'SUM(B:B)/2'
    WHEN 5 THEN '[1]Rates!$B$2*C' || CAST(row_no AS VARCHAR(10))
    WHEN 6 THEN 'TODAY()'
    ELSE 'IF(A1="OFFSET(",ROUND(B2,2),WACC)' END AS text,
  CASE style_id WHEN 0 THEN '000000' WHEN 1 THEN '008000' WHEN 2 THEN 'FF0000' WHEN 3 THEN '0000FF' ELSE '000000' END AS font_rgb
FROM grid""",
    "formats": """
SELECT * FROM (VALUES (0,'General'), (1,'0.00'), (2,'#,##0;(#,##0);"-"'), (3,'#,##0;-#,##0'),
  (4,'0%'), (5,';;;'), (6,'#,##0.00_);(#,##0.00)'), (7,'yyyy-mm-dd')) AS t(style_id, fmt_code)""",
    "colours": """
SELECT DISTINCT LPAD(HEX(CAST(p_partkey * 7919 % 16777216 AS BIGINT)), 6, '0') AS text_rgb,
  CASE p_partkey % 3 WHEN 0 THEN 'FFFFFF' WHEN 1 THEN LPAD(HEX(CAST(p_partkey * 104729 % 16777216 AS BIGINT)), 6, '0') ELSE '1A1A1A' END AS bg_rgb
FROM part""",
    "text_cells": """
SELECT CAST(doc_id % 20 AS INT) AS wb_id, CAST(doc_id % 5 AS INT) AS sheet_idx, doc_id AS row_no, 1 AS col_no, text AS v_text FROM documents
UNION ALL SELECT CAST(p_partkey % 20 AS INT), CAST(p_partkey % 5 AS INT), p_partkey, 2,
  CASE p_partkey % 6 WHEN 0 THEN 'Yellow fill = key outputs' WHEN 1 THEN 'TBD ' || p_name WHEN 2 THEN 'What is the cost of ' || p_name || '?'
    WHEN 3 THEN 'rounded to $0.01' WHEN 4 THEN 'END' ELSE p_name END FROM part""",
    "periods": """
SELECT CAST(o_custkey AS BIGINT) AS sheet_key, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 2 = 0
    THEN 'Q' || CAST(EXTRACT(quarter FROM o_orderdate) AS VARCHAR(4)) || ' ' || CAST(EXTRACT(year FROM o_orderdate) AS VARCHAR(4))
    ELSE 'FY' || CAST(EXTRACT(year FROM o_orderdate) AS VARCHAR(4)) || 'E' END AS label FROM orders""",
    "ranges": """
SELECT wb_id, sheet_idx, row_no AS r1, col_no AS c1, row_no + CAST(ref_key % 4 AS INT) AS r2, col_no + CAST(ref_key % 2 AS INT) AS c2,
  CAST(ref_key % 5 AS INT) AS priority
FROM grid""",
    "refs": """
SELECT wb_id, sheet_idx, row_no, col_no, CAST(ref_key % 10 AS INT) AS ref_sheet, CAST(1 + ref_key % 50 AS INT) AS r1,
  CAST(1 + ref_key % 7 AS INT) AS c1, CAST(1 + ref_key % 50 + (ref_key % 3) * 20 AS INT) AS r2, CAST(1 + ref_key % 7 AS INT) AS c2 FROM grid""",
    "intervals": """
SELECT o_custkey AS sheet_key, o_orderkey AS seq, CAST(o_orderkey % 40 + 1 AS INT) AS lo, CAST(o_orderkey % 40 + 1 + o_orderkey % 6 AS INT) AS hi,
  CAST(o_orderkey % 9 AS DOUBLE) * 4 AS width, o_orderstatus = 'F' AS hidden, CAST(o_orderkey % 3 AS INT) AS outline_level FROM orders""",
    "names": """
SELECT CAST(p_partkey % 50 AS INT) AS wb_id, 'N_' || CAST(p_partkey AS VARCHAR(10)) AS name,
  CASE WHEN p_size % 10 = 0 THEN '#REF!' ELSE 'N_' || CAST((p_partkey + 50 * (p_size % 4)) % 2000 AS VARCHAR(10)) END AS definition,
  p_size % 7 = 0 AS hidden FROM part""",
    "edges": """
SELECT DISTINCT src, dst FROM (SELECT CAST(l_partkey AS BIGINT) AS src,
  CAST(CASE WHEN l_orderkey % 997 = 0 THEN l_partkey - l_partkey % 20 + l_linenumber
            WHEN l_partkey % 20 + l_linenumber <= 19 THEN l_partkey + l_linenumber END AS BIGINT) AS dst
FROM lineitem) e WHERE dst IS NOT NULL""",
    "tasks": "SELECT c_custkey AS task_id, c_name AS task_name, c_mktsegment AS model_type FROM customer",
    "attempts": """
SELECT o_orderkey AS id, o_custkey AS task_id, o_orderpriority AS agent_model_name, CAST(o_orderkey % 3 AS VARCHAR(4)) AS prompt_version,
  o_orderdate AS start_time, o_totalprice / 60000 AS time_taken_min, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 100000 END AS cost,
  o_orderstatus = 'F' AS agent_failed, o_orderkey % 10 = 0 AS deprecated FROM orders""",
    "gradings": """
SELECT DISTINCT l_orderkey AS attempt_id, CASE WHEN l_linestatus = 'O' THEN 'g1' ELSE 'g2' END AS grader_model,
  l_returnflag = 'R' AS failed, l_linenumber = 7 AS deprecated FROM lineitem""",
    "weights": """
SELECT n_nationkey + 1 AS check_no, r_name AS category, n_name AS name, CAST(n_nationkey % 6 + 1 AS DOUBLE) AS weight, CAST(0.2 AS DOUBLE) AS category_weight
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "judgements": """
SELECT l_orderkey AS attempt_id, r_name AS category, n_name AS name, CASE WHEN l_linestatus = 'O' THEN 'llm' ELSE 'code' END AS engine,
  CASE WHEN l_returnflag = 'R' THEN 'fail' ELSE 'pass' END AS decision,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) % 7 ELSE 0 END AS n_mistakes, CAST(l_discount * 100 AS INT) AS claimed
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "answers": """
SELECT l_orderkey AS attempt_id, l_linenumber AS qid, CAST(FLOOR(l_quantity) AS INT) AS seq,
  CASE p_size % 4 WHEN 0 THEN 'cost of ' || p_name WHEN 1 THEN 'growth rate of ' || p_name WHEN 2 THEN 'net income of ' || p_name ELSE p_name END AS label,
  CAST(ROUND(p_retailprice, 2) AS VARCHAR(30)) AS golden,
  CASE l_partkey % 9 WHEN 0 THEN CAST(ROUND(p_retailprice, 2) AS VARCHAR(30)) WHEN 1 THEN '(' || CAST(ROUND(p_retailprice, 2) AS VARCHAR(30)) || ')'
    WHEN 2 THEN CAST(ROUND(p_retailprice * 100, 2) AS VARCHAR(30)) WHEN 3 THEN 'N/A' WHEN 4 THEN NULL WHEN 5 THEN '-'
    WHEN 6 THEN CAST(ROUND(p_retailprice + 0.004, 3) AS VARCHAR(30)) ELSE '$' || CAST(ROUND(p_retailprice + 1, 2) AS VARCHAR(30)) END AS got,
  CAST(ROUND(p_retailprice + 1, 2) AS VARCHAR(30)) AS alternate, l_linestatus = 'O' AS got_formula
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "qa_text": """
SELECT p_partkey AS qid, p_type || ' ' || p_name AS label, 'golden' AS side, p_partkey AS row_no FROM part
UNION ALL SELECT p_partkey, p_type || ' ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '?' ELSE '' END, 'attempt', p_partkey FROM part""",
    "calls": """
SELECT user_id AS attempt_id, event_id AS step, ts, CASE event_type WHEN 'view' THEN 'assistant' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'result' ELSE event_type END AS type,
  CAST(event_id % 5 AS VARCHAR(2)) AS model, CAST(FLOOR(value * 100) AS BIGINT) AS prompt_tokens, CAST(FLOOR(value * 10) AS BIGINT) AS completion_tokens, props FROM events""",
    "prices": """
SELECT * FROM (VALUES ('0', CAST(5.0 AS DOUBLE), CAST(30.0 AS DOUBLE), CAST(0.10 AS DOUBLE), CAST(1.0 AS DOUBLE)),
  ('1', 3.0, 15.0, 0.10, 1.25), ('2', 1.0, 5.0, 0.25, 1.0)) AS t(model, input_price, output_price, cache_read, cache_write)""",
}

_TABLE_REF = re.compile(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b")
_DEPENDS = {"sheets": ("grid",), "formulas": ("grid",), "ranges": ("grid",), "refs": ("grid",)}


def with_views(names: str, sql: str, written: tuple[str, ...] = ()) -> str:
    """``sql`` preceded by the definitions of the named relations (space separated); those in ``written`` are parameters of Spark."""
    ordered: list[str] = []
    for name in names.split():
        for need in (*_DEPENDS.get(name, ()), name):
            if need not in ordered:
                ordered.append(need)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS (SELECT * FROM {{{n}}})" if n in written else f"{n} AS ({FIXTURES[n].strip()})" for n in ordered)
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        rest = body[4:].lstrip()
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {ctes},\n{rest[10:]}"
        return f"WITH {ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"


class Views:
    """The tables below one folder, and the relations derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.tables: dict[str, DataFrame] = {}

    def written(self, name: str) -> Views:
        """The same relations with one of them written to a table, which all that derive from it read."""
        out = Views(self.spark, self.sf_dir)
        out.tables = self.tables | {name: checkpointed(getattr(self, name))}
        return out

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def derived(self, names: str, sql: str) -> DataFrame:
        """A query over the named relations."""
        text = _TABLE_REF.sub(r"\1 {\2}", with_views(names, sql, tuple(self.tables)))
        used = {t: self.spark.read.parquet(self.path(t)) for t in TABLES if "{" + t + "}" in text}
        used |= {t: df for t, df in self.tables.items() if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        if name not in FIXTURES:
            raise AttributeError(name)
        return self.derived(name, f"SELECT * FROM {name}")
