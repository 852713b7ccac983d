"""Runs of years against a plain walk, and widths in a cell's own font."""

import random

from pyspark.sql import functions as F

from gridledger.functions import text as T
from gridledger.operators import checks, evidence


def _runs(years):
    """(start, end) positions of the runs, walked one by one; None is another content."""
    out, i = [], 0
    while i < len(years):
        if years[i] is None:
            i += 1
            continue
        j, way = i + 1, 0
        while j < len(years) and years[j] is not None and abs(years[j] - years[j - 1]) <= 1:
            step = years[j] - years[j - 1]
            if step and way and step != way:
                break
            way, j = way or step, j + 1
        if j - i >= 3 and len(set(years[i:j])) > 1:
            out.append((i + 1, j))
        i = j
    return out


def test_zigzag_years_are_cut_where_a_walk_cuts(spark):
    rng = random.Random(8)
    lines = [[2026, 2027, 2026, 2027, 2026, 2027, 2028], [2020, 2021, 2021, 2020, 2019, 2020, 2021, 2022], [2020] * 5, [2024, 2023, 2022, None, 2023, 2024, 2025]]
    for _ in range(150):
        y, line = 2000 + rng.randrange(50), []
        for _ in range(rng.randrange(3, 40)):
            y += rng.choice([-1, 0, 1, 1, -1, 3 if rng.random() < 0.1 else 0])
            line.append(None if rng.random() < 0.03 else y)
        lines.append(line)
    rows = [(k, p, "x" if y is None else None, None if y is None else float(y)) for k, line in enumerate(lines) for p, y in enumerate(line, 1)]
    df = spark.createDataFrame(rows, "k int, pos int, label string, v_num double")
    got = {}
    for r in evidence.period_series(df, ["k"]).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: r for k, line in enumerate(lines) if (r := _runs(line))}


def test_widths_in_own_fonts(spark):
    rows = [("1,234.5", "Calibri", 11.0, False), ("(12%)", "HELVETICA", 10.0, False), ("Jan-24", "Verdana", 9.0, True), ("+5 :/", "no such face", None, None), ("", "Arial", 11.0, True)]
    df = spark.createDataFrame(rows, "t string, face string, size double, bold boolean")
    for r in df.select("*", T.glyph_width(T.glyph_counts(F.col("t")), F.col("face"), F.col("size"), F.col("bold")).alias("w")).collect():
        one = spark.createDataFrame([(r.t,)], "t string").select(T.number_width(F.col("t"), r.face, r.size or 11.0, bool(r.bold)).alias("w")).collect()[0].w
        assert abs(r.w - one) < 1e-9
    cells = spark.createDataFrame([(1, 0, 1, 1, "12345678", "Courier New", 14.0, True, False), (1, 0, 2, 1, "12345678", "Courier New", 14.0, True, True), (1, 0, 3, 1, "1234", "Arial Narrow", 8.0, False, False)],
                                  "wb_id int, sheet_idx int, row_no int, col_no int, shown string, face string, size double, bold boolean, shrink boolean")
    cols = spark.createDataFrame([(1, 0, 1, 8.0)], "wb_id int, sheet_idx int, col_no int, width double")
    assert [r.location for r in checks.narrow_number_cells(cells, cols).collect()] == ["'S0'!A1"]
