"""Banded blocks, two-dimensional tiles, moved formula texts and the fused pass of the checks."""

import random

import pytest
from pyspark.sql import functions as F

from bruteforce import greedy_blocks
from gridledger.fixtures import Views
from gridledger.functions import formula as X
from gridledger.operators import checks, fused, grid
from gridledger.plans import check_queries

from compare import DATA

CELLS = "wb_id int, sheet_idx int, row_no int, col_no int"


def _sheets():
    rng = random.Random(11)
    dense = {(r, c) for r in range(1, 101) for c in range(1, 8)} - {(r, 4) for r in range(30, 34)} - {(60, 1)}
    return {(1, 0): dense, (1, 1): {(r, c) for r in range(5, 95) for c in range(1, 9) if rng.random() < 0.8},
            (2, 0): {(r, c) for r in range(1, 100) for c in ((1, 2, 3) if r % 7 else (1, 3))}, (2, 1): {(r, 2) for r in range(1, 100) if r != 50},
            (3, 0): {(r, c) for r in range(1, 99) for c in range(1 + r // 20, 6 + r // 20)}, (4, 0): {(7, 7)}}


@pytest.mark.parametrize("bands", [1, 3, 50])
def test_blocks_do_not_depend_on_the_bands(spark, bands):
    sheets = _sheets()
    rows = [(w, s, r, c) for (w, s), cells in sheets.items() for r, c in cells]
    got = {}
    for r in grid.contiguous_blocks(spark.createDataFrame(rows, CELLS), band_rows=-(-100 // bands)).collect():
        got.setdefault((r.wb_id, r.sheet_idx), []).append((r.top, r.left, r.bottom, r.right))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(greedy_blocks(c)) for k, c in sheets.items()}


def test_blocks_of_no_cells(spark):
    assert grid.contiguous_blocks(spark.createDataFrame([], CELLS)).count() == 0


def test_whole_column_rules_cost_what_they_give(spark):
    n, columns, rules = 100_000, 1000, 200
    cells = spark.range(n).select(F.lit(1).alias("wb_id"), F.lit(0).alias("sheet_idx"), (F.floor(F.col("id") / columns) + 1).cast("int").alias("row_no"), (F.col("id") % columns + 1).cast("int").alias("col_no"))
    areas = spark.range(rules).select(F.lit(1).alias("wb_id"), F.lit(0).alias("sheet_idx"), F.lit(1).alias("r1"), (F.col("id") * 5 + 1).cast("int").alias("c1"),
                                      F.lit(1_048_576).alias("r2"), (F.col("id") * 5 + 1).cast("int").alias("c2"), F.col("id").alias("rule"))
    met, inside = grid.tile_candidates(cells, areas).count(), grid.range_members(cells, areas).count()
    assert inside == n // columns * rules and met == inside


def test_members_against_all_pairs(spark):
    rng = random.Random(4)
    cells = [(k, s, rng.randrange(1, 60), rng.randrange(1, 60)) for k in range(2) for s in range(2) for _ in range(150)]
    areas = [(rng.randrange(2), rng.randrange(2), r, c, min(1_048_576, r + rng.choice([0, 2, 30, 1_048_575])), min(16_384, c + rng.choice([0, 1, 9, 16_383])), i)
             for i, (r, c) in enumerate((rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(80))]
    got = grid.range_members(spark.createDataFrame(cells, CELLS), spark.createDataFrame(areas, "wb_id int, sheet_idx int, r1 int, c1 int, r2 int, c2 int, rule int")).collect()
    want = sorted((*c, a[6]) for c in cells for a in areas if c[:2] == a[:2] and a[2] <= c[2] <= a[4] and a[3] <= c[3] <= a[5])
    assert sorted((r.wb_id, r.sheet_idx, r.row_no, r.col_no, r.rule) for r in got) == want
    assert grid.range_members(spark.createDataFrame(cells, CELLS), spark.createDataFrame([], "wb_id int, sheet_idx int, r1 int, c1 int, r2 int, c2 int")).count() == 0


def test_cycles_through_rectangles_of_many_columns(spark):
    rows = [(1, 0, 3, 3, "SUM(A1:Z2)"), (1, 0, 1, 26, "C3"), (2, 0, 3, 3, "SUM(A1:Z2)"), (2, 0, 1, 27, "C3"), (3, 0, 9, 1, "SUM($2:$4)"), (3, 0, 3, 900, "A9*2")]
    got = checks.circular_cells(spark.createDataFrame(rows, f"{CELLS}, text string")).collect()
    assert sorted((r.wb_id, r.row_no, r.col_no) for r in got) == [(1, 1, 26), (1, 3, 3), (3, 3, 900), (3, 9, 1)]


SHIFTS = [
    ("A1+$B$2*C$3-$D4", 2, 1, "B3+$B$2*D$3-$D6"), ("SUM(A1:B2)", 1, 1, "SUM(B2:C3)"), ("SUM(A:A,$B:C,3:5,$3:5)", 2, 3, "SUM(D:D,$B:F,5:7,$3:7)"),
    ("'My ''Q1'' A1'!A1&\"A1 \"\"B2\"\"\"", 1, 0, "'My ''Q1'' A1'!A2&\"A1 \"\"B2\"\"\""), ("Data!B2+[1]Rates!$C$1+[Book 1.xlsx]S1!A1", 0, 2, "Data!D2+[1]Rates!$C$1+[Book 1.xlsx]S1!C1"),
    ("LOG10(A1)+ATAN2(B1,C1)", 1, 0, "LOG10(A2)+ATAN2(B2,C2)"), ("Rate2024x*TAX_1+A1B", 5, 5, "Rate2024x*TAX_1+A1B"), ("A1", -1, 0, "#REF!"), ("S1!A1:B2+1", 0, -1, "S1!#REF!+1"),
    ("XFD1+A1048576", 1, 1, "#REF!+#REF!"), ("$XFD1+A$1048576", 1, 1, "$XFD2+B$1048576"), ("Table1[[#This Row],[A1]]*B1", 1, 0, "Table1[[#This Row],[A1]]*B2"), ("Jan:Dec!A1", 1, 1, "Jan:Dec!B2"),
    ("1.5E3+2e10*A1", 1, 1, "1.5E3+2e10*B2"), ("A1#+@B1", 1, 0, "A2#+@B2"), ("IF(A1>=10,\"x\",-B1)%", 0, 1, "IF(B1>=10,\"x\",-C1)%"), ("a1+b$2", 1, 1, "B2+C$2"), ("A1:INDEX(B:B,3)", 1, 1, "B2:INDEX(C:C,3)"), ("TRUE", 3, 3, "TRUE"), ("", 1, 1, "")]


def test_moved_formulas(spark):
    df = spark.createDataFrame([(i, t, r, c) for i, (t, r, c, _) in enumerate(SHIFTS)], "i int, t string, r int, c int")
    got = {x.i: x.m for x in df.select("i", X.shifted(F.col("t"), F.col("r"), F.col("c")).alias("m")).collect()}
    assert [got[i] for i in range(len(SHIFTS))] == [want for *_, want in SHIFTS]
    assert df.select(X.shifted(F.col("t"), F.lit(0), F.lit(0)).alias("m")).collect()[0].m == SHIFTS[0][0]


def test_children_of_shared_formulas_have_text(spark):
    rows = [(1, 0, 2, 3, "A2*$B$1", 0), (1, 0, 3, 3, None, 0), (1, 0, 9, 4, "", 0), (1, 1, 3, 3, None, 0), (1, 0, 5, 5, "SUM(A1)", None), (1, 0, 6, 6, None, None),
            (2, 0, 1, 1, "C1", 0), (2, 0, 1, 2, "D1+1", 0), (2, 0, 2, 2, None, 0)]
    got = grid.shared_texts(spark.createDataFrame(rows, f"{CELLS}, formula string, si int")).collect()
    assert {(r.wb_id, r.sheet_idx, r.row_no, r.col_no): r.text for r in got} == {
        (1, 0, 2, 3): "A2*$B$1", (1, 0, 3, 3): "A3*$B$1", (1, 0, 9, 4): "B9*$B$1", (1, 1, 3, 3): None, (1, 0, 5, 5): "SUM(A1)", (1, 0, 6, 6): None,
        (2, 0, 1, 1): "C1", (2, 0, 1, 2): "D1+1", (2, 0, 2, 2): "D2"}


def test_cell_checks_read_the_cells_once(spark):
    v = Views(spark, f"{DATA}/sf0.001")
    plan = fused.cell_hits(check_queries.wide_cells(v), check_queries.wide_styles(v), ["OFFSET"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_fused_faults_equal_those_of_the_single_checks(spark):
    v = Views(spark, f"{DATA}/sf0.001")
    hits = fused.cell_hits(check_queries.wide_cells(v), check_queries.wide_styles(v), ["OFFSET", "TODAY"]).cache()
    found = fused.cell_mistakes(hits, v.text_cells.limit(0), check_queries.cf_colours(v)).cache()
    single = {22: check_queries.c22(v)[0], 49: checks.colour_check(check_queries.colours_wrong(v), 49), 51: checks.colour_check(check_queries.colours_wrong(v), 51),
              65: check_queries.c65(v), 66: check_queries.c66(v), 80: checks.volatile_cells(v.formulas), 94: check_queries.c94(v)}
    for number, alone in single.items():
        one = found.filter(F.col("check_no") == number).select(*checks.MISTAKE)
        assert one.count() == alone.count() > 0 and one.exceptAll(alone.select(*checks.MISTAKE)).isEmpty(), number
    hits.unpersist()
    found.unpersist()
