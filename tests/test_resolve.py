"""References through names, tables and spans of sheets on hand-made rows."""

from pyspark.sql import functions as F

from gridledger.operators import checks, resolve

CELL = "wb_id int, sheet_idx int, row_no int, col_no int"
NAMES = [(1, "Rate", None, "S1!$A$1"), (1, "Rate", 0, "S0!$B$2"), (1, "Deep", None, "Deeper+1"), (1, "Deeper", None, "rate*Sales[qty]"), (1, "Ring", None, "Ring2+S2!C3"), (1, "Ring2", None, "Ring"), (1, "Here", None, "$D$4"), (2, "Rate", None, "S9!A1")]


def _all(spark, formulas):
    sheets = spark.createDataFrame([(1, i, f"S{i}") for i in range(4)] + [(2, 0, "S0")], "wb_id int, sheet_idx int, sheet string")
    f = spark.createDataFrame(formulas, f"{CELL}, text string")
    names = spark.createDataFrame(NAMES, "wb_id int, name string, scope int, definition string")
    tables = spark.createDataFrame([(1, "Sales", "S3", 2, 1, 9, 3)], "wb_id int, table string, sheet string, r1 int, c1 int, r2 int, c2 int")
    columns = spark.createDataFrame([(1, "Sales", n, i) for i, n in enumerate(("Qty", "Unit price", "Total"), 1)], "wb_id int, table string, column string, col_no int")
    return f, sheets, resolve.resolved_references(f, names, tables, columns, sheets)


def test_everything_a_formula_reaches(spark):
    cases = [("Rate", {("S0", 2, 2, 2, 2)}, 0), ("RATE*2", {("S1", 1, 1, 1, 1)}, 1), ("Deep", {("S1", 1, 1, 1, 1), ("S3", 2, 1, 9, 1)}, 1), ("Ring", {("S2", 3, 3, 3, 3)}, 2), ("Here", {("S2", 4, 4, 4, 4)}, 2),
             ("SUM(Sales[Total])", {("S3", 2, 3, 9, 3)}, 0), ("Sales[[#This Row],[Unit price]]", {("S3", 7, 2, 7, 2)}, 3), ("Sales[@Qty]+Sales[@[Unit price]]", {("S3", 7, 1, 7, 1), ("S3", 7, 2, 7, 2)}, 3),
             ("Sales[[Qty]:[Total]]", {("S3", 2, 1, 9, 3)}, 0), ("Sales[#All]", {("S3", 1, 1, 9, 3)}, 0), ("Sales[[#Headers],[Qty]]", {("S3", 1, 1, 1, 1)}, 0), ("Sales[Nope]", set(), 0), ("Other[Qty]", set(), 0),
             ("SUM(S0:S2!A1)", {("S0", 1, 1, 1, 1), ("S1", 1, 1, 1, 1), ("S2", 1, 1, 1, 1)}, 3), ("SUM(s2:s1!A1:B2)", {("S1", 1, 1, 2, 2), ("S2", 1, 1, 2, 2)}, 3), ("SUM(S0:S7!A1)", set(), 0), ("[1]S1!A1", set(), 0), ('"Rate"&A5', {("S0", 5, 1, 5, 1)}, 0)]
    f, sheets, got = _all(spark, [(1, s, 7, 10 + i, t) for i, (t, _, s) in enumerate(cases)])
    found = {i: set() for i in range(len(cases))}
    for r in got.collect():
        found[r.col_no - 10].add((r.ref_sheet, r.r1, r.c1, r.r2, r.c2))
    assert found == {i: want for i, (_, want, _) in enumerate(cases)}
    kinds = {r.col_no - 10: r["class"] for r in resolve.resolved_class(f, got, sheets).collect()}
    assert [kinds[i] for i in (0, 1, 2, 3, 4, 5, 16, 17)] == ["OWN", "OWN", "POINTER", "OWN", "OWN", "CROSS", "EXTERNAL", "OWN"]


def test_cycles_through_names_tables_and_spans(spark):
    rows = [(1, 1, 1, 1, "Deep"), (1, 2, 3, 3, "SUM(S1:S3!C3)"), (1, 3, 4, 2, "Sales[[#This Row],[Total]]"), (1, 3, 4, 3, "B4+1"), (1, 0, 1, 1, "Rate"), (1, 0, 2, 2, "5*2")]
    f, _, resolved = _all(spark, rows)
    got = sorted((r.sheet_key, r.row_no, r.col_no) for r in checks.circular_cells(f, resolved).collect())
    assert got == [("s1", 1, 1), ("s2", 3, 3), ("s3", 4, 2), ("s3", 4, 3)]
    assert checks.circular_cells(f).filter(F.col("sheet_key") == "s1").count() == 0
