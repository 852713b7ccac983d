"""F1-F14."""

from pyspark.sql import functions as F

from ..operators import selection as L
from . import query

FILES = """files AS (SELECT attempts.*, CASE WHEN agent_model_name = '5-LOW' THEN NULL
  ELSE 'attempts/' || CAST(id AS VARCHAR(20)) || '/model.xlsx' END AS workbook FROM attempts)"""


def with_workbook(v):
    return v.attempts.withColumn("workbook", F.when(F.col("agent_model_name") != "5-LOW",
                                 F.concat(F.lit("attempts/"), F.col("id").cast("string"), F.lit("/model.xlsx"))))


LABELS = ["1-URGENT", "2-HIGH", "5-LOW"]


@query("f1_select_attempts", "attempts tasks", f"""WITH {FILES}
SELECT id, f.task_id, task_name, agent_model_name, prompt_version, workbook FROM files f JOIN tasks t ON t.task_id = f.task_id
WHERE NOT deprecated AND workbook IS NOT NULL AND agent_model_name IN ('1-URGENT', '2-HIGH', '5-LOW') ORDER BY 2, 1""")
def _(v):
    return L.select_attempts(with_workbook(v), v.tasks, labels=LABELS)


@query("f2_selection_note", "attempts", f"""WITH {FILES}
SELECT COUNT(*) AS total_rows, SUM(CASE WHEN m THEN 1 ELSE 0 END) AS matched, SUM(CASE WHEN m AND deprecated THEN 1 ELSE 0 END) AS deprecated,
 SUM(CASE WHEN m AND NOT deprecated AND workbook IS NULL THEN 1 ELSE 0 END) AS no_workbook
FROM (SELECT *, agent_model_name IN ('1-URGENT', '2-HIGH', '5-LOW') AS m FROM files) q""")
def _(v):
    return L.selection_note(with_workbook(v), LABELS)


@query("f3_graded_ids", "gradings", "SELECT DISTINCT attempt_id FROM gradings WHERE NOT failed AND NOT deprecated AND grader_model = 'g1'")
def _(v):
    return L.graded_ids(v.gradings, "g1")


@query("f4_pending_attempts", "attempts gradings", """
SELECT id, task_id, agent_model_name FROM attempts a WHERE NOT EXISTS (
  SELECT 1 FROM gradings g WHERE g.attempt_id = a.id AND NOT failed AND NOT g.deprecated AND grader_model = 'g1')""")
def _(v):
    return L.pending_attempts(v.attempts, v.gradings, "g1").select("id", "task_id", "agent_model_name")


@query("f5_attempted_tasks", "attempts", """
SELECT DISTINCT agent_model_name, task_id FROM attempts WHERE prompt_version = '1' AND NOT agent_failed AND NOT deprecated""")
def _(v):
    return L.attempted_tasks(v.attempts, 1)


@query("f6_pending_tasks", "attempts tasks", """
SELECT l.agent_model_name, t.task_id FROM tasks t CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) l(agent_model_name)
WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.task_id = t.task_id AND a.agent_model_name = l.agent_model_name
  AND prompt_version = '1' AND NOT agent_failed AND NOT deprecated)""")
def _(v):
    return L.pending_tasks(v.tasks, v.attempts, LABELS, 1)


@query("f8_search_cells", "text_cells", """
SELECT wb_id, sheet_idx, row_no, col_no, v_text FROM text_cells WHERE lower(v_text) LIKE '%cost of%'""")
def _(v):
    return L.search_cells(v.text_cells, "Cost of").select("wb_id", "sheet_idx", "row_no", "col_no", "v_text")


@query("f8_search_regex", "text_cells", r"""
SELECT wb_id, sheet_idx, row_no, col_no FROM text_cells WHERE regexp_matches(v_text, '(?i)^tbd [a-z]+ (ring|widget)')""")
def _(v):
    return L.search_cells(v.text_cells, "^tbd [a-z]+ (ring|widget)", "regex").select("wb_id", "sheet_idx", "row_no", "col_no")


@query("f9_cell_range", "grid", """
SELECT wb_id, sheet_idx, row_no, col_no, v_num, chr(CAST(64 + col_no AS INT)) || CAST(row_no AS VARCHAR(10)) AS cell
FROM grid WHERE row_no BETWEEN 1 AND 9 AND col_no BETWEEN 1 AND 3""")
def _(v):
    return L.cell_range(v.grid, 1, 1, 9, 3).select("wb_id", "sheet_idx", "row_no", "col_no", "v_num", "cell")


@query("f10_head_tail", "grid sheets", """
SELECT g.wb_id, g.sheet_idx, row_no, col_no, v_num FROM grid g JOIN sheets s ON s.wb_id = g.wb_id AND s.sheet_idx = g.sheet_idx
WHERE max_row <= 100 OR row_no <= 60 OR row_no > max_row - 40""")
def _(v):
    return L.head_tail(v.grid, v.sheets).select("wb_id", "sheet_idx", "row_no", "col_no", "v_num")


@query("f10_redacted_counts", "sheets", """
SELECT wb_id, sheet_idx, CASE WHEN max_row > 100 THEN max_row - 100 ELSE 0 END AS rows_redacted, CASE WHEN max_col > 5 THEN max_col - 3 ELSE 0 END AS cols_redacted FROM sheets""")
def _(v):
    return L.redacted_counts(v.sheets, first_cols=2, last_cols=1, min_cols=5)


@query("f11_drop_sheets", "grid sheets", """
SELECT g.wb_id, s.sheet, COUNT(*) AS n_cells FROM grid g JOIN sheets s ON s.wb_id = g.wb_id AND s.sheet_idx = g.sheet_idx
WHERE lower(s.sheet) NOT IN ('s0', 's7') GROUP BY g.wb_id, s.sheet""")
def _(v):
    kept = L.drop_sheets(v.sheets, ["S0", "s7"]).select("wb_id", "sheet_idx", "sheet")
    return v.grid.join(kept, ["wb_id", "sheet_idx"]).groupBy("wb_id", "sheet").agg(F.count(F.lit(1)).alias("n_cells"))


@query("f11_graded_sheet_names", "sheets", """
SELECT wb_id, sheet, CASE WHEN state = 'hidden' THEN '_nograde_' || sheet ELSE sheet END AS graded_as FROM sheets""")
def _(v):
    raw = F.when(F.col("state") == "hidden", F.col("sheet")).when(F.col("zoom") == 80, F.concat(F.lit("model_"), "sheet")).otherwise(
        F.concat(F.lit("answers_"), "sheet"))
    return v.sheets.select("wb_id", "sheet", L.graded_sheet_name(raw).alias("graded_as"))


@query("f12_cap_list", "grid", """
SELECT wb_id, sheet_idx, row_no, col_no, rank_no, total, total > 25 AS truncated FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY wb_id ORDER BY sheet_idx, row_no, col_no) AS rank_no, COUNT(*) OVER (PARTITION BY wb_id) AS total
  FROM grid WHERE v_err IS NOT NULL) q WHERE rank_no <= 25""")
def _(v):
    errs = v.grid.filter("v_err is not null").select("wb_id", "sheet_idx", "row_no", "col_no")
    return L.cap_list(errs, ["wb_id"], ["sheet_idx", "row_no", "col_no"], 25)


TASK_NAMES = """named AS (SELECT task_id, CASE WHEN task_id % 2 = 0 THEN replace(task_name, '#', ' ') ELSE task_name END AS task_name FROM tasks),
wanted AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'Customer_' WHEN 1 THEN 'Customer#' ELSE 'Customer ' END || lpad(CAST(o_custkey AS VARCHAR(12)), 9, '0') AS name FROM orders)"""


@query("f14_task_by_name", "tasks", f"""WITH {TASK_NAMES}
SELECT name, COALESCE(x.task_id, y.task_id) AS task_id, x.task_id IS NOT NULL AS exact FROM wanted w
LEFT JOIN named x ON x.task_name = w.name LEFT JOIN named y ON replace(y.task_name, ' ', '_') = replace(w.name, ' ', '_')""")
def _(v):
    t = F.col("task_name")
    named = v.tasks.withColumn("task_name", F.when(F.col("task_id") % 2 == 0, F.replace(t, F.lit("#"), F.lit(" "))).otherwise(t))
    lead = F.when(F.col("o_orderkey") % 3 == 0, "Customer_").when(F.col("o_orderkey") % 3 == 1, "Customer#").otherwise("Customer ")
    wanted = v.orders.select(F.concat(lead, F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name")).distinct()
    return L.task_by_name(wanted, named)
