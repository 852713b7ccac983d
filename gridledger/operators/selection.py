"""Selection, resume and caps over attempts, gradings, tasks and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from .skew import first_n

EXCEL_NAME = r"(?i)\.(xlsx|xlsm|xlsb|xls)$"


def live(attempts: DataFrame) -> Column:
    return ~F.coalesce(F.col("deprecated"), F.lit(False))


def select_attempts(attempts: DataFrame, tasks: DataFrame, task_ids: list | None = None, labels: list | None = None) -> DataFrame:
    """Attempts to grade: narrowed, not deprecated, with a workbook; in (task_id, id) order."""
    a = attempts
    if task_ids is not None:
        a = a.filter(F.col("task_id").isin(task_ids))
    if labels is not None:
        a = a.filter(F.col("agent_model_name").isin(labels))
    return (a.filter(live(a) & F.col("workbook").isNotNull())
            .join(tasks.select("task_id", "task_name"), "task_id")
            .select("id", "task_id", "task_name", "agent_model_name", "prompt_version", "workbook")
            .orderBy("task_id", "id"))


def selection_note(attempts: DataFrame, labels: list | None = None) -> DataFrame:
    """How many rows were seen, matched, and passed over."""
    matched = F.lit(True) if labels is None else F.col("agent_model_name").isin(labels)
    alive = matched & live(attempts)
    return attempts.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(matched).alias("matched"),
                        F.count_if(matched & F.coalesce("deprecated", F.lit(False))).alias("deprecated"),
                        F.count_if(alive & F.col("workbook").isNull()).alias("no_workbook"))


def graded_ids(gradings: DataFrame, grader: str | None = None) -> DataFrame:
    """Attempts with a grading that still stands."""
    g = gradings.filter(~F.coalesce("failed", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False)))
    if grader is not None:
        g = g.filter(F.col("grader_model") == grader)
    return g.select("attempt_id").distinct()


def pending_attempts(attempts: DataFrame, gradings: DataFrame, grader: str) -> DataFrame:
    done = graded_ids(gradings, grader).withColumnRenamed("attempt_id", "id")
    return attempts.join(done, "id", "left_anti")


def same_version(a: Column, b: Column) -> Column:
    """Equality across whole numbers and numeric texts; null equals only null."""
    x, y = a.cast("string"), b.cast("string")
    numeric = x.rlike(r"^\s*-?[0-9]{1,18}\s*$") & y.rlike(r"^\s*-?[0-9]{1,18}\s*$")
    return F.when(numeric, x.try_cast("bigint") == y.try_cast("bigint")).otherwise(x.eqNullSafe(y))


def attempted_tasks(attempts: DataFrame, version) -> DataFrame:
    """(label, task) pairs with an attempt that neither failed nor was withdrawn."""
    good = same_version(F.col("prompt_version"), F.lit(version)) & ~F.col("agent_failed") & live(attempts)
    return attempts.filter(good).select("agent_model_name", "task_id").distinct()


def pending_tasks(tasks: DataFrame, attempts: DataFrame, labels: list[str], version) -> DataFrame:
    """Task and cohort label pairs still to run. The labels are a configured list and are expanded in place."""
    todo = tasks.select("task_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("agent_model_name"))
    return todo.join(attempted_tasks(attempts, version), ["agent_model_name", "task_id"], "left_anti")


def search_cells(cells: DataFrame, text: str, mode: str = "substring", case: bool = False, limit: int | None = None) -> DataFrame:
    """All matches, or the first ``limit`` of each sheet in reading order."""
    v = F.col("v_text")
    if mode == "regex":
        hit = v.rlike(text if case else f"(?i){text}")
    else:
        hay, needle = (v, text) if case else (F.lower(v), text.lower())
        hit = hay == needle if mode == "equals" else F.contains(hay, F.lit(needle))
    return first_n(cells.filter(hit), ["wb_id", "sheet_idx"], ["row_no", "col_no"], limit)


def cell_range(cells: DataFrame, r1: int, c1: int, r2: int, c2: int, cap: int | None = None) -> DataFrame:
    """The cells of one rectangle on every sheet. With ``cap``, a larger rectangle is refused, not cut."""
    area = (r2 - r1 + 1) * (c2 - c1 + 1)
    if cap is not None and area > cap:
        raise ValueError(f"{area} cells asked for, {cap} allowed")
    return cells.filter(F.col("row_no").between(r1, r2) & F.col("col_no").between(c1, c2)).withColumn(
        "cell", a1.to_a1(F.col("row_no"), F.col("col_no")))


def head_tail(cells: DataFrame, extents: DataFrame, first_rows=60, last_rows=40, first_cols=50, last_cols=25,
              min_rows=100, min_cols=75) -> DataFrame:
    """Cells of the first and last rows and columns of sheets too large to show whole."""
    d = cells.join(extents.select("wb_id", "sheet_idx", "max_row", "max_col"), ["wb_id", "sheet_idx"])
    row_ok = (F.col("max_row") <= min_rows) | (F.col("row_no") <= first_rows) | (F.col("row_no") > F.col("max_row") - last_rows)
    col_ok = (F.col("max_col") <= min_cols) | (F.col("col_no") <= first_cols) | (F.col("col_no") > F.col("max_col") - last_cols)
    return d.filter(row_ok & col_ok).drop("max_row", "max_col")


def redacted_counts(extents: DataFrame, first_rows=60, last_rows=40, first_cols=50, last_cols=25,
                    min_rows=100, min_cols=75) -> DataFrame:
    """Rows and columns ``head_tail`` leaves out, per sheet."""
    def cut(total: Column, keep: int, least: int) -> Column:
        return F.when(total > least, F.greatest(total - keep, F.lit(0))).otherwise(0)

    return extents.select("wb_id", "sheet_idx",
                          cut(F.col("max_row"), first_rows + last_rows, min_rows).alias("rows_redacted"),
                          cut(F.col("max_col"), first_cols + last_cols, min_cols).alias("cols_redacted"))


def drop_sheets(df: DataFrame, ignore: list[str]) -> DataFrame:
    return df.filter(~F.lower(F.trim("sheet")).isin([s.lower() for s in ignore]))


def graded_sheet_name(sheet: Column) -> Column:
    """'answers_x' and 'model_x' are graded as 'x'; every other sheet is kept as context only."""
    return (F.when(F.startswith(sheet, F.lit("answers_")), F.substr(sheet, F.lit(9)))
            .when(F.startswith(sheet, F.lit("model_")), F.substr(sheet, F.lit(7)))
            .otherwise(F.concat(F.lit("_nograde_"), sheet)))


def cap_list(df: DataFrame, keys: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """All rows, or the first ``n`` per key with their rank, beside the count of all and a truncated flag."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return first_n(df, keys, order, n).join(totals, keys).withColumn("truncated", F.lit(False) if n is None else F.col("total") > n)


def task_by_name(wanted: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each wanted name with its task: the exact name, else the name with spaces as underscores."""
    def first(column: Column, out: str) -> DataFrame:
        return tasks.groupBy(column.alias("key")).agg(F.min("task_id").alias(out))

    exact = first(F.col("task_name"), "exact_id").withColumnRenamed("key", "name")
    loose = first(F.replace("task_name", F.lit(" "), F.lit("_")), "loose_id")
    return (wanted.join(exact, "name", "left")
            .join(loose, F.replace("name", F.lit(" "), F.lit("_")) == F.col("key"), "left")
            .select("name", F.coalesce("exact_id", "loose_id").alias("task_id"), F.col("exact_id").isNotNull().alias("exact")))
