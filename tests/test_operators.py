"""Hand-made rows and brute force for what SQL cannot check."""

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from bruteforce import cyclic, greedy_blocks
from gridledger.functions import a1, colour, numfmt, text
from gridledger.functions import answers as A
from gridledger.functions import formula as X
from gridledger.operators import answers, checks, graph, grid, scoring, skew
from gridledger.sources import workbooks


def values(spark, column, rows, name="x"):
    df = spark.createDataFrame([(r,) for r in rows], f"{name} string")
    return [r[0] for r in df.select(column(F.col(name))).collect()]


def test_a1_corner_cases(spark):
    got = values(spark, a1.parse_a1, ["A1", "$XFD$1048576", "C5:A1", "B:D", "7:3", "A1:B", "Rate", "", "#REF!"])
    assert [tuple(g) if g else None for g in got] == [
        (1, 1, 1, 1), (1048576, 16384, 1048576, 16384), (1, 1, 5, 3), (1, 2, 1048576, 4), (3, 1, 7, 16384), None, None, None, None]
    numbers = spark.range(1, 16385).select("id", a1.column_letters(F.col("id")).alias("l"))
    assert numbers.filter(a1.column_number(F.col("l")) != F.col("id")).count() == 0


def test_cycles_against_tarjan(spark):
    rng = random.Random(3)
    for n, m in ((12, 14), (40, 60), (60, 64)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)] + [(130, 100)]
        found = {}
        for r in graph.cyclic_nodes(spark.createDataFrame(edges, "src long, dst long")).collect():
            found.setdefault(r.component, set()).add(r.node)
        assert {frozenset(c) for c in found.values()} == cyclic(edges)


def test_circular_formulas(spark):
    rows = [(1, 0, 1, 1, "A1+1"), (2, 0, 5, 1, "SUM(A1:A10)"), (3, 0, 14, 2, "ROWS($B$14:B14)"), (4, 0, 1, 1, "S1!B2"), (4, 1, 2, 2, "S0!A1"), (5, 0, 1, 1, "SUM(B:B)"), (5, 0, 9, 3, "A1")]
    cells = checks.circular_cells(spark.createDataFrame(rows, "wb_id int, sheet_idx int, row_no int, col_no int, text string"))
    assert sorted(r.wb_id for r in cells.collect()) == [1, 2, 4, 4]


def test_growing_ranges_stay_near_linear(spark):
    n = 3000
    rows = spark.range(1, n + 1).select(F.lit(1).alias("wb_id"), F.lit(0).alias("sheet_idx"), F.col("id").cast("int").alias("row_no"), F.lit(3).alias("col_no"),
                                        F.concat(F.lit("SUM($B$1:B"), F.col("id").cast("string"), F.lit(")")).alias("text"))
    assert checks.dependency_edges(rows).count() < 2 * n * math.log2(n)


def test_greedy_blocks(spark):
    rng = random.Random(5)
    sheets = {(w, 0): {(r, c) for r in range(1, 15) for c in range(1, 9) if rng.random() < 0.75} for w in range(6)}
    rows = [(w, s, r, c) for (w, s), cells in sheets.items() for r, c in cells]
    got = {}
    for r in grid.contiguous_blocks(spark.createDataFrame(rows, "wb_id int, sheet_idx int, row_no int, col_no int")).collect():
        got.setdefault((r.wb_id, r.sheet_idx), []).append((r.top, r.left, r.bottom, r.right))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(greedy_blocks(c)) for k, c in sheets.items()}


def test_rectangles_partition_the_cells(spark):
    rng = random.Random(7)
    cells = {(rng.randrange(1, 30), rng.randrange(1, 12)) for _ in range(200)}
    df = spark.createDataFrame([(1, 0, r, c) for r, c in cells], "wb_id int, sheet_idx int, row_no int, col_no int")
    covered = [(r, c) for b in grid.group_cells(df).collect() for r in range(b.r1, b.r2 + 1) for c in range(b.c1, b.c2 + 1)]
    assert sorted(covered) == sorted(cells)


def test_stab_join_on_tall_ranges(spark):
    rng = random.Random(9)
    points = [(k, rng.randrange(1, 1_048_577)) for k in range(2) for _ in range(80)]
    ranges = [(rng.randrange(2), lo, min(1_048_576, lo + rng.choice([0, 3, 70, 5000, 900_000]))) for lo in (rng.randrange(1, 1_048_577) for _ in range(60))]
    got = grid.stab_join(spark.createDataFrame(points, "k int, p int"), spark.createDataFrame(ranges, "k int, lo int, hi int"), ["k"], "p", "lo", "hi")
    want = [(k, p, lo, hi) for k, p in points for j, lo, hi in ranges if j == k and lo <= p <= hi]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, x long")
    block = F.floor(F.col("o") / 16)
    d = skew.running_sum(df, ["k"], ["o"], F.col("x"), block, "s")
    d = skew.previous(skew.number_rows(d, ["k"], ["o"], block, "n"), ["k"], ["o"], F.col("x"), block, "before")
    seen = {}
    for r in sorted(d.collect(), key=lambda r: r.o):
        total, n, last = seen.get(r.k, (0, 0, None))
        assert (r.s, r.n, r.before) == (total + r.x, n + 1, last)
        seen[r.k] = (total + r.x, n + 1, r.x)


def test_number_formats(spark):
    codes = ["General", '#,##0_);(#,##0);"-"_)', '0.0%;-0.0%', "[Red](0);0", '0;[Red]-(0)', ";;;", "d-mmm-yy", '0;"neg"', "[>100]0;0", '#,##0;#,##0;""']
    assert values(spark, numfmt.negative_class, codes) == ["minus", "parens", "minus", "unsigned", "mixed", "blank", "date", "text", "uncertain", "unsigned"]
    assert values(spark, numfmt.zero_class, codes) == ["digit", "dash", "digit", "digit", "digit", "blank", "date", "digit", "uncertain", "blank"]


def test_formula_classes(spark):
    texts = ["A1*2", "Inputs!B5", "=+'My Sheet'!$B$5", "SUM(Inputs!A1:A9)", "[1]Rates!B2", "'C:\\x\\[B.xlsx]S'!A1", 'IF(A1="Other!B2",1,2)', "S0!A1", "TODAY()", "LOG10(B5)"]
    assert values(spark, lambda c: X.formula_class(c, F.lit("S0")), texts) == [
        "OWN", "POINTER", "POINTER", "CROSS", "EXTERNAL", "EXTERNAL", "OWN", "OWN", "OWN", "OWN"]
    called = values(spark, X.functions_called, ['IF(A1="SUM(",_xlfn._xlws.FILTER(B1:B2,1),max(1))', "'Sum (2)'!A1"])
    assert called == [["FILTER", "IF", "MAX"], []]


def test_contrast_against_plain_python(spark):
    # white text on white, black on white, and a pair whose difference is published
    d = spark.createDataFrame([("FFFFFF", "FFFFFF"), ("000000", "FFFFFF"), ("888888", "FFFFFF"), ("FFFFFF", "000000")], "text_rgb string, bg_rgb string")
    got = {(r.text_rgb, r.bg_rgb): r for r in colour.with_contrast(d).collect()}
    assert got["FFFFFF", "FFFFFF"].conceals and got["FFFFFF", "FFFFFF"].lc == 0
    assert abs(got["000000", "FFFFFF"].lc - 106.04) < 0.1 and abs(got["888888", "FFFFFF"].lc - 63.06) < 0.1 and abs(got["FFFFFF", "000000"].lc + 107.88) < 0.1
    assert got["000000", "FFFFFF"].wcag == 21.0 and abs(got["000000", "FFFFFF"].de2000 - 100) < 0.01


def test_wrap_breaks_long_words(spark):
    assert values(spark, lambda c: text.wrap_lines(c, 10.0), ["aaa bbb ccc ddd", "a" * 25, "", "x\n\ny", "ab " + "c" * 25]) == [2, 3, 1, 3, 4]


def test_tolerance_rules(spark):
    rows = [("100.64", "100.63598", 2, "exactness"), ("0.50", "0.51", 2, "x"), ("101", "100.9", 0, "x"), ("100", "-100", 2, "Cost of goods"), ("100", "-100", 2, "Net change in cost basis"),
            ("0.42", "42%", 2, "share"), ("1234", "1234000", 0, "x"), ("N/A", "Outside model horizon", None, "x"), ("5", "n.a.", None, "x"), ("2027-01-01", "46388", None, "x"), ("yes", "TRUE", None, "x"), ("7", "", None, "x"),
            ("-1890487.51", "(1,890,487.51)", 2, "x")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, golden string, got string, dp int, label string")
    d = d.withColumn("unit", F.lit("")).withColumn("golden_dp", F.lit(None).cast("int")).withColumn("got_dp", F.lit(None).cast("int")).withColumn("pct_format", F.lit(False)).withColumn("percent_directive", F.lit(False))
    got = [(r.verdict, r.rule, r.flags) for r in answers.compare_answers(d).orderBy("i").collect()]
    assert got == [("match", "tolerance", ""), ("mismatch", None, ""), ("match", "tolerance", ""), ("match", "sign_outflow", ""), ("match", "sign_outflow", ""), ("match", "percent_form", "coarse_rounding"),  # half of 0.01 is over 1 % of 0.42
                   ("mismatch", None, "possible_unit_scale_difference"), ("match", "sentinel_synonym", ""), ("mismatch", None, "sentinel_for_numeric"), ("match", "date_form", ""),
                   ("match", "exact", ""), ("missing", None, ""), ("match", "exact", "")]


def test_similar_labels_misses_nothing(spark):
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(15, 60))).strip().ljust(15, "z") for _ in range(60)]

    def edit(s):
        out = list(s)
        for _ in range(rng.randrange(0, 7)):
            i = rng.randrange(len(out))
            rng.choice([lambda: out.pop(i), lambda: out.insert(i, "q"), lambda: out.__setitem__(i, "q")])()
        return "".join(out)

    other = [edit(s) for s in base]
    a, b = (spark.createDataFrame([(x,) for x in sorted(set(side))], "norm_label string") for side in (base, other))
    got = {r.norm_label: r.ratio for r in answers.similar_labels(a, b, []).collect()}
    pairs = a.toDF("x").crossJoin(b.toDF("y")).filter(F.length("y") >= 15).select("x", (1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"))).alias("r"))
    want = {r.x: round(r.m, 6) for r in pairs.filter("r >= 0.9 - 1e-12").groupBy("x").agg(F.max("r").alias("m")).collect()}
    assert got == want and want


def test_verdict_contract(spark):
    books = spark.createDataFrame([(1,), (2,), (3,)], "wb_id int")
    found = spark.createDataFrame([(1, "S", f"S!A{i}", "d", "major") for i in range(30)], "wb_id int, sheet string, location string, description string, severity string")
    opened = spark.createDataFrame([(2,), (1,)], "wb_id int")
    whole = checks.make_verdict(books, found, 22, undecided=opened)
    assert {r.wb_id: (r.n_listed, r.truncated) for r in whole.collect()} == {1: (30, False), 2: (0, False), 3: (0, False)}
    assert checks.broken_contracts(whole).count() == 0 and checks.listed_mistakes(found).count() == 30
    v = checks.make_verdict(books, found, 22, cap=25, undecided=opened)
    rows = {r.wb_id: (r.decision, r.n_mistakes, r.n_listed, r.truncated) for r in v.collect()}
    assert rows == {1: ("fail", 30, 25, True), 2: ("undecided", 0, 0, False), 3: ("pass", 0, 0, False)}
    assert checks.broken_contracts(v).count() == 0
    assert checks.broken_contracts(v.withColumn("decision", F.lit("pass"))).count() == 2
    assert checks.listed_mistakes(found, 25).count() == 25


def test_formula_text_of_any_script(spark):
    texts = ["SUM(Sales[Net])+S1!A1", "Bilané!A1", "Größe+1", "[1]S!A1", "'[Book.xlsx]S 1'!A1", "SUM(A1:A1048576)", "SUM(A:A)"]
    assert values(spark, X.is_external, texts) == [False, False, False, True, True, False, False]
    assert values(spark, lambda t: X.formula_class(t, F.lit("Übersicht")), texts[:3]) == ["CROSS", "POINTER", "OWN"]
    assert values(spark, X.name_tokens, ["Größe+1"]) == [["größe"]]
    assert values(spark, X.has_whole_form, texts[5:]) == [False, True]


def test_shared_children_move_each_corner_by_its_own_flags(spark):
    m = spark.createDataFrame([(1, 0, 7, 5, 3, 1, 2, 5, 2, True, False, False, True)], "wb_id int, sheet_idx int, si int, row_no int, col_no int, r1 int, c1 int, r2 int, c2 int, r1_abs boolean, c1_abs boolean, r2_abs boolean, c2_abs boolean")
    c = spark.createDataFrame([(1, 0, 7, 9, 4)], "wb_id int, sheet_idx int, si int, row_no int, col_no int")
    assert [tuple(r)[4:8] for r in grid.shared_children(m, c).collect()] == [(1, 2, 9, 3)]


def test_names_used_by_formulas_are_not_unused(spark):
    names = spark.createDataFrame([(1, "Rate", "S!A1", False), (1, "Base", "Rate*2", False), (1, "Idle", "S!A2", False), (1, "Größe", "S!A3", False)], "wb_id int, name string, definition string, hidden boolean")
    uses = spark.createDataFrame([(1, "base+größe")], "wb_id int, text string")
    assert {r.location for r in checks.clean_names(names, uses).collect()} == {"Name Manager: Idle"}


def test_workbooks_of_one_name_stay_apart(spark, tmp_path):
    for folder, n in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        with zipfile.ZipFile(tmp_path / folder / "MODEL.XLSX", "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>')
            z.writestr("xl/sharedStrings.xml", f"<sst><si><t>text {n}</t></si></sst>")
    cells = workbooks.cells_from_parts(workbooks.workbook_parts(spark, str(tmp_path)))
    assert sorted(r.v_text for r in cells.collect()) == ["text 1", "text 2"] and cells.select("wb_id").distinct().count() == 2


def test_scores_stay_in_bounds(spark):
    weights = spark.createDataFrame([("c", "a", 2.0, 0.6), ("c", "b", 1.0, 0.6), ("d", "x", 1.0, 0.4)], "category string, name string, weight double, category_weight double")
    counts = spark.createDataFrame([(1, "c", "a", 0), (1, "d", "x", 0), (2, "c", "b", 9), (3, "other", "x", 0)], "attempt_id long, category string, name string, mistakes int")
    got = {r.attempt_id: r.total_score for r in scoring.total_scores(counts, weights).collect()}
    assert got == {1: 80.0, 2: 0.0, 3: 0.0}


def test_registry_refuses_doubles():
    r = checks.Registry()
    r.add(1, lambda v: None)
    with pytest.raises(ValueError):
        r.add(1, lambda v: None)
    with pytest.raises(KeyError):
        r.run(None, [2])


def test_read_a_real_workbook(spark, tmp_path):
    ns = 'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<x:row r="{r}"><x:c r="A{r}" t="s"><x:v>{r % 2}</x:v></x:c><x:c r="B{r}"><x:f t="shared" si="0">A{r}+1</x:f><x:v>{r}.5</x:v></x:c>'
                   f'<x:c r="C{r}" t="inlineStr"><x:is><x:t>#N/A</x:t></x:is></x:c><x:c r="D{r}" t="e"><x:v>#N/A</x:v></x:c></x:row>' for r in range(1, 400))
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<x:worksheet {ns}><x:sheetData>{body}<x:row r=\"500\"/></x:sheetData><x:mergeCells><x:mergeCell ref=\"A1:B2\"/></x:mergeCells></x:worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<x:worksheet {ns}><x:sheetData/></x:worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<x:sst {ns}><x:si><x:t>even</x:t></x:si><x:si><x:t>odd</x:t></x:si></x:sst>")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    parts = workbooks.workbook_parts(spark, str(tmp_path), piece_chars=4096)
    cells = workbooks.cells_from_parts(parts)
    assert cells.count() == 399 * 4
    kinds = {tuple(r) for r in cells.groupBy("col_no", "kind").count().collect()}
    assert kinds == {(1, "text", 399), (2, "number", 399), (3, "text", 399), (4, "error", 399)}
    assert cells.filter("col_no = 1 and v_text <> (case when row_no % 2 = 0 then 'even' else 'odd' end)").count() == 0
    assert cells.filter("col_no = 2 and v_num = row_no + 0.5 and f_kind = 'shared' and si = 0").count() == 399
    assert workbooks.rows_meta(parts).count() == 400
    assert [tuple(r)[3:] for r in workbooks.sheet_tail(parts)["merges"].collect()] == [(1, 1, 2, 2)]
    assert parts.filter("piece = 'broken'").count() == 1


def test_round_digits(spark):
    got = values(spark, A.round_digits, ["ROUND(A1,2)", "IFNA(ROUND(MAX(A1,B2), 3),0)", "ROUNDUP(A1,2)", 'LET(x,"ROUND(1,9)",ROUND(x,1))', "ROUND(A1,n)", "A1"])
    assert got == [2, 3, None, 1, None, None]


def test_legend_texts(spark):
    says = {"Yellow = key inputs": "DEFINES", "Cells shaded yellow are outputs": "DEFINES", "No yellow is used here": "NEGATED", "Yellow: not yet confirmed": "WIP",
            "Yellow - TBD": "WIP", "Light yellow = notes": None, "Updated monthly, yellow when pending": "MENTION", "the yellow one": "MENTION", "blue = x": None,
            "blue = inputs; #FFFF00 = checks": "DEFINES", None: None}
    assert values(spark, checks.legend_class, list(says)) == list(says.values())


def test_round_digits_at_any_depth(spark):
    deep = "(" * 40 + "1" + ")" * 40
    assert values(spark, A.round_digits, [f"ROUND({deep},3)", f"ROUND(MAX({deep},2), 4 )+ROUND(1,1)", f"ROUND({deep})", "ROUND(1,2"]) == [3, 4, None, None]


def test_rows_wrap_at_the_width_of_their_column(spark):
    texts = spark.createDataFrame([(1, 0, r, c, "word " * 11 + "word") for r in (1, 2) for c in (1, 2, 3)], "wb_id int, sheet_idx int, row_no int, col_no int, v_text string")
    cols = spark.createDataFrame([(1, 0, 1, 10.7), (1, 0, 2, 80.7)], "wb_id int, sheet_idx int, col_no int, width double")
    rows = spark.createDataFrame([(1, 0, 1, 30.0, True), (1, 0, 2, 90.0, True)], "wb_id int, sheet_idx int, row_no int, height double, custom boolean")
    short = checks.short_wrapped_rows(texts, rows, cols).collect()
    assert sorted(r["location"].split("!")[-1].strip("'") for r in short) == ["A1", "C1"]
    wide = texts.filter("col_no = 2")
    assert [r["location"].split("!")[-1] for r in checks.tall_rows(rows, wide, cols).collect()] == ["2:2"]
    assert checks.tall_rows(rows, texts, cols).count() == 0
