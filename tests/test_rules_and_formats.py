"""Conditional formats, tints, names, directives and flags on hand-made rows."""

from pyspark.sql import functions as F

from gridledger.functions import answers as A
from gridledger.functions import colour
from gridledger.functions import formula as X
from gridledger.operators import answers, checks, features

CELL = "wb_id int, sheet_idx int, row_no int, col_no int"


def test_tints_of_theme_colours(spark):
    rows = [("4472C4", 0.4, "8EA9DB"), ("4472C4", 0.5999938962981048, "B4C6E7"), ("4472C4", 0.7999816888943144, "D9E1F2"), ("4472C4", -0.25, "305496"), ("4472C4", -0.5, "203764"), ("ED7D31", 0.4, "F4B084"),
            ("ED7D31", -0.25, "C65911"), ("FFFFFF", -0.15, "D9D9D9"), ("000000", 0.5, "808080"), ("70ad47", 0.0, "70AD47"), ("70AD47", None, "70AD47"), ("FFC000", 0.4, "FFD966"), ("A5A5A5", 2.0, "FFFFFF"), ("A5A5A5", -3.0, "000000")]
    got = colour.with_tint(spark.createDataFrame(rows, "rgb string, tint double, want string"), "rgb", "tint").collect()
    assert [(r.rgb, r.tint, r.tinted) for r in got] == rows


RULES = [  # rule_type, operator, a, text, fires on: 5, -2.5, 'Pass it', '', error, empty
    ("cellIs", "greaterThan", 3.0, None, "yn nnnn"), ("cellIs", "equal", 0.0, None, "nn nnny"), ("containsText", None, None, "p*s", "nn ynnn"), ("containsText", None, None, "p?ss", "nn ynnn"),
    ("containsText", None, None, "~*", "nn nnnn"), ("notContainsText", None, None, "pass", "yy nyny"), ("beginsWith", None, None, "-2.", "ny nnnn"), ("endsWith", None, None, "IT", "nn ynnn"),
    ("containsText", None, None, ".", "ny nnnn"), ("containsBlanks", None, None, None, "nn nyny"), ("notContainsBlanks", None, None, None, "yy ynyn"), ("containsErrors", None, None, None, "nn nnyn"),
    ("notContainsErrors", None, None, None, "yy yyny"), ("expression", None, None, None, "nn nnnn"), ("containsText", None, None, None, "nn nnnn"), ("colorScale", None, None, None, "yy nnnn")]


def test_rules_fire_on_the_cell(spark):
    values = [(5.0, None, None), (-2.5, None, None), (None, "Pass it", None), (None, "", None), (None, None, "#N/A"), (None, None, None)]
    rows = [(i, j, *r[:2], r[2], None, r[3], *v) for i, r in enumerate(RULES) for j, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, j int, rule_type string, operator string, a double, b double, text string, v_num double, v_text string, v_err string")
    got = {(r.i, r.j): bool(r.f) for r in df.select("i", "j", features.rule_fires(F.col("v_num"), F.col("v_text"), F.col("v_err")).alias("f")).collect()}
    for i, r in enumerate(RULES):
        assert "".join("ny"[got[i, j]] for j in range(6)) == r[4].replace(" ", ""), r


def test_overlay_stops_and_mixes_properties(spark):
    cells = spark.createDataFrame([(1, 0, r, 1, float(r), None) for r in range(1, 5)], f"{CELL}, v_num double, v_err string")
    rules = [(1, 0, 1, 1, 9, 1, 1, "greaterThan", 2.0, "0.00", None, False), (1, 0, 1, 1, 9, 1, 2, "greaterThan", 1.0, "(0)", "FF0000", True), (1, 0, 1, 1, 9, 1, 3, "greaterThan", 0.0, "0%", "00FF00", False)]
    df = spark.createDataFrame(rules, "wb_id int, sheet_idx int, r1 int, c1 int, r2 int, c2 int, priority int, operator string, a double, fmt_code string, font_rgb string, stop boolean")
    df = df.withColumn("rule_type", F.lit("cellIs")).withColumn("b", F.lit(None).cast("double")).withColumn("text", F.lit(None).cast("string"))
    over = {r.row_no: (r.fmt_code, r.font_rgb) for r in features.cf_overlay(cells, df, ["fmt_code", "font_rgb"]).collect()}
    assert over == {1: ("0%", "00FF00"), 2: ("(0)", "FF0000"), 3: ("0.00", "FF0000"), 4: ("0.00", "FF0000")}
    own = cells.withColumn("fmt_code", F.lit("General")).withColumn("font_rgb", F.lit("000000"))
    assert features.painted_cells(own, df.limit(0), ["fmt_code"]).filter("fmt_code = 'General' AND font_rgb = '000000'").count() == 4
    assert features.painted_cells(own, df, ["fmt_code"]).filter("fmt_code = '(0)'").count() == 1


def test_what_counts_as_a_name(spark):
    texts = {"Sales[amount]*Tax_Rate": ["sales", "tax_rate"], "SUM(Jan:Dec!A1)+sheet1!B2": [], "SUM(B:B)+$C:$D+WACC": ["wacc"], "A1:INDEX(B:B,3)": [], "Rate:Total": ["rate", "total"], "[1]Rates!$B$2+x_1": ["x_1"]}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: sorted(r.n) for r in df.select("t", X.name_tokens(F.col("t")).alias("n")).collect()} == texts
    got = df.filter("t LIKE 'A1:%'").select(X.reference_texts(F.col("t")).alias("r")).collect()[0].r
    assert sorted(got) == ["A1", "B:B"]


def test_names_on_missing_sheets_are_broken(spark):
    names = spark.createDataFrame([(1, "here", "S0!$A$1", False), (1, "gone", "S9!$A$1", False), (1, "span", "S0:S9!A1", False), (1, "book", "[1]S9!A1", False), (2, "other", "S0!A1", False)],
                                  "wb_id int, name string, definition string, hidden boolean")
    sheets = spark.createDataFrame([(1, "s0"), (2, "S1")], "wb_id int, sheet string")
    found = {r.location.split(": ")[1]: r.description for r in checks.clean_names(names, sheets=sheets).collect()}
    assert found == {"here": "unused", "gone": "broken", "span": "broken", "book": "unused", "other": "broken"}


def test_later_rounds_are_tried(spark):
    texts = [("ROUND(A1,B1)+ROUND(C1,2)", 2), ("ROUND(ROUND(A1,3),B2)", 3), ("ROUNDUP(A1,1)", None), ('"ROUND(A,1)"&round(x,-1)', -1), ("ROUND(A1,1)", 1), ("SUM(A1)", None)]
    got = spark.createDataFrame(texts, "t string, want int").select("t", A.round_digits(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == texts


def test_percent_matches_in_a_coarse_band_are_flagged(spark):
    rows = [("0.2", "20", "growth rate", 1), ("0.02", "2", "growth rate", None), ("5.1", "5.1", "growth rate", 1), ("0.2", "0.24", "growth rate", 1)]
    df = spark.createDataFrame(rows, "golden string, got string, label string, dp int")
    df = df.select("*", F.lit("").alias("unit"), *[F.lit(None).cast("int").alias(c) for c in ("golden_dp", "got_dp")], *[F.lit(False).alias(c) for c in ("pct_format", "percent_directive")])
    by = {(r.golden, r.got): (r.rule, r.flags) for r in answers.compare_answers(df).collect()}
    assert by["0.02", "2"] == ("percent_form", "") and by["5.1", "5.1"][0] == "exact" and by["0.2", "0.24"] == ("tolerance", "coarse_rounding")
    coarse = df.filter("got = '20'").withColumn("golden", F.lit("0.23")).withColumn("got", F.lit("20"))
    assert [(r.rule, r.flags) for r in answers.compare_answers(coarse).collect()] == [("percent_form", "coarse_rounding")]
