"""Steps whose cost a text, a book or a folder may not multiply."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import DATA
from gridledger import plans
from gridledger.plans import source_queries
from gridledger.functions import text as T
from gridledger.functions import formula
from gridledger.operators import answers, checks, evidence, fused, resolve
from gridledger.session import checkpointed
from gridledger.sources import logs


def wrapped_by_hand(text, usable):
    """Greedy wrap character by character."""
    width = lambda s: sum(5 if c in T.NARROW else 7 if c in T.SLIM else 13 if c in T.BROAD else 11 if c.isupper() else 10 if c.isdecimal() else 9 for c in s)
    total, limit = 0, 10 * usable + 1e-5
    for p in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        lines, cur = 1, 0
        for word in p.split(" "):
            if cur and cur + 5 + width(word) <= limit:
                cur += 5 + width(word)
            else:
                lines, cur = lines + (cur > 0), 0
                for c in word if width(word) > limit else [word]:
                    if cur and cur + width(c) > limit:
                        lines, cur = lines + 1, 0
                    cur += width(c)
        total += lines
    return total


@pytest.mark.parametrize("usable", [60.0, 9.0, 0.3])
def test_wrap_looks_characters_up(spark, usable):
    rng = random.Random(5)
    texts = ["", " ", "  a  b ", "W" * 70, "a\r\n\nb\rc", "É٣ß " * 40, "\U0001d400b " * 30] + [
        "".join(rng.choice("abcXYZ019 .,%m@\n") for _ in range(rng.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").select("i", T.wrap_lines(F.col("t"), usable).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {-1: None} | {i: wrapped_by_hand(t, usable) for i, t in enumerate(texts)}
    # no fold over the words inside an expression
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_folders_and_of_lines(spark, tmp_path):
    """The number of the folder is the id; a file of many tasks names them."""
    for name, lines in (("task_id=12/task.json", ['{"id": 99, "task_name": "folder"}']), ("more.json", ['{"task_id": 3, "task_name": "line"}', '{"id": 20, "task_name": "by id"}'])):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines))
    (tmp_path / "task_id=12" / "starting_files").mkdir()
    (tmp_path / "task_id=12" / "starting_files" / "a.xlsx").write_bytes(b"PK")
    assert [(r.task_id, r.task_name) for r in logs.read_tasks(spark, str(tmp_path)).collect()] == [(3, "line"), (12, "folder"), (20, "by id")]


def test_tasks_are_written_to_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "fresh_folder", lambda spark, label: f"{tmp_path}/{label}")
    plans.load_all()
    got = plans.QUERIES["s3_read_tasks"](spark, f"{DATA}/sf0.001").count()
    assert got == spark.read.parquet(f"{DATA}/sf0.001/customer.parquet").count()
    assert len(list(tmp_path.rglob("part-*"))) < got / 4


def test_a_formula_text_is_read_once(spark):
    """Equal texts of a corpus meet before they are parsed; sheets of one name share them, others do not."""
    cells = spark.createDataFrame([(w, s, r, 1, t) for w in (1, 2) for s in (0, 1) for r, t in enumerate(["S1!A1", "OFFSET(A3,1,1)", None, "SUM(A1:A9)"], 1)],
                                  "wb_id int, sheet_idx int, row_no int, col_no int, text string")
    got = {(r.wb_id, r.sheet_idx, r.row_no): (r["class"], r.called, len(r.reads), r.at_home and len(r.at_home)) for r in fused._with_formula_features(cells).collect()}
    assert len(got) == 16
    for w in (1, 2):
        assert [got[w, 0, r] for r in (1, 2, 3, 4)] == [("POINTER", [], 1, []), ("OWN", ["OFFSET"], 1, 1), (None, None, 0, None), ("OWN", ["SUM"], 1, 1)]
        assert got[w, 1, 1] == ("OWN", [], 1, 1)


def test_packages_pass_one_at_a_time():
    """Zipping and unzipping share a worker: a package is opened as soon as it is made, and small pieces share a batch."""
    made = []

    def zipped(batches):
        for frame in source_queries._zip_members(batches):
            made.append(frame.path[0])
            yield frame

    row = "<row r='1'><c r='A1'><v>1</v></c></row>"
    sheet = f"<worksheet><sheetData>{row * 2000}</sheetData></worksheet>"
    books = pd.DataFrame({"wb_id": range(40), "names": [["xl/worksheets/sheet0.xml"]] * 40, "bodies": [[sheet]] * 40})
    seen = [(len(made), frame) for frame in source_queries._zipped_parts(zipped)(iter([books]))]
    assert seen[0][0] < 20 and len(seen) < 8
    pieces = pd.concat([f for _, f in seen])
    assert pieces.wb_id.str.split("#").str[0].drop_duplicates().tolist() == [f"wb{i}.xlsx" for i in range(40)]
    assert set(pieces.groupby("wb_id", sort=False).xml.agg("".join)) == {sheet}


ASKED = "i int, golden string, got string, label string, unit string, dp int, golden_dp int, got_dp int, pct_format boolean, percent_directive boolean, alternate string, alternate_label string"


@pytest.fixture()
def written(monkeypatch):
    """How many rows the answer operators write for each comparison."""
    sizes = []
    monkeypatch.setattr(answers, "checkpointed", lambda df: sizes.append(df.count()) or checkpointed(df))
    return sizes


def test_equal_questions_are_compared_once(spark, written):
    """Each combination of inputs is one comparison, nulls included; every row gets its result."""
    asked = [("5", "5.004", "rate", None, 2, None, None, False, False, "x", "y"), ("5", "7", "cost", "%", None, None, None, False, False, "7.0", " COST. "),
             (None, "7", None, None, None, None, None, False, False, None, None), ("5", None, "cost", None, None, 1, None, True, False, "7", "cost")]
    rows = spark.createDataFrame([(i, *asked[i % 4]) for i in range(80)], ASKED)
    got = {r.i: (r.verdict, r.rule, r.flags) for r in answers.compare_answers(rows).collect()}
    want = [("match", "tolerance", ""), ("mismatch", None, ""), ("missing", None, "missing_expected"), ("missing", None, "")]
    assert got == {i: want[i % 4] for i in range(80)} and written == [4]
    both = {r.i: (r.verdict, r.rule, r.matched_alternate, r.golden) for r in answers.compare_with_alternates(rows).collect()}
    want = [("match", "tolerance", False, "5"), ("match", "exact", True, "5"), ("missing", None, False, None), ("missing", None, False, "5")]
    assert both == {i: want[i % 4] for i in range(80)} and written == [4, 4, 4]
    step = {r.i: (r.verdict, r.rule, r.matched_alternate, r.golden) for r in answers.with_alternates(answers.compare_answers(rows)).collect()}
    assert step == both


def test_summary_counts_rules_beside_the_rest(spark):
    rows = [(1, "match", "exact", True, 1.0), (1, "match", "exact", True, 1.0), (1, "mismatch", None, True, 1.0), (2, "missing", None, False, None), (None, "match", "tolerance", True, 1.0)]
    df = spark.createDataFrame([(a, v, r, loc, False, True, "number", "number", True) for a, v, r, loc, _ in rows],
                               "attempt_id int, verdict string, rule string, located boolean, got_formula boolean, golden_formula boolean, expected_kind string, got_kind string, attempt_rounded boolean")
    summed = answers.answer_summary(df)
    got = {r.attempt_id: (r.n_questions, r.n_match, r.n_mismatch, r.n_missing, r.n_unlocated, r.n_hardcoded, r.rules_fired) for r in summed.collect()}
    assert got == {1: (3, 2, 1, 0, 0, 3, "exact=2"), 2: (1, 0, 0, 1, 1, 0, ""), None: (1, 1, 0, 0, 0, 1, "tolerance=1")}
    assert "Join" not in summed._jdf.queryExecution().optimizedPlan().toString()  # the rows are read once


def _rows_read(df):
    """Every (operator, its input) of an optimized plan that reads texts by a pattern; the input tells whether texts were made distinct."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    return [lines[i + 1:next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(lines[i])), len(lines))]
            for i, line in enumerate(lines) if "regexp_extract_all" in line]


def _reads_distinct(df):
    reading = _rows_read(df)
    return bool(reading) and all(any("Aggregate [" in line for line in below) for below in reading)


def test_references_of_a_text_are_read_once(spark):
    rows = spark.createDataFrame([(w, s, t) for w in (1, 2) for s in (0, 1) for t in ("S1!A1+B2", "SUM(B:B)", None, "TODAY()", "'S 2'!$C$3", "S1!A1+B2")], "wb_id int, sheet_idx int, text string")
    refs = formula.references(rows, "text", checks.sheet_name())
    got = sorted((r.wb_id, r.sheet_idx, r.ref, r.ref_sheet, r.external, r.r1, r.c1, r.r2, r.c2) for r in refs.collect())
    assert got == sorted((w, s, *x) for w in (1, 2) for s in (0, 1) for x in
                         [("S1!A1", "S1", False, 1, 1, 1, 1), ("B2", f"S{s}", False, 2, 2, 2, 2)] * 2
                         + [("B:B", f"S{s}", False, 1, 2, 1048576, 2), ("'S 2'!$C$3", "S 2", False, 3, 3, 3, 3)])
    assert _reads_distinct(refs)


def test_labels_and_classes_are_read_once(spark):
    """Equal labels and equal formula texts are read one time each; null texts keep their rows."""
    cells = spark.createDataFrame([(w, 0, 1, p, x, None) for w in (1, 2) for p, x in enumerate(["FY2020", "FY2021", "FY2022", None, "x"], 1)],
                                  "wb_id int, sheet_idx int, col_no int, pos int, label string, v_num double")
    runs = evidence.period_series(cells, ["wb_id", "sheet_idx", "col_no"])
    assert sorted((r.wb_id, r.start, r.end, r.n) for r in runs.collect()) == [(1, 1, 3, 3), (2, 1, 3, 3)]
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_label" in plan
    f = spark.createDataFrame([(w, 0, r, 1, t) for w in (1, 2) for r, t in enumerate(["S1!A1", "S1!A1*2", None, "[1]R!A1"], 1)], "wb_id int, sheet_idx int, row_no int, col_no int, text string")
    sheets = spark.createDataFrame([(w, s, f"S{s}") for w in (1, 2) for s in (0, 1)], "wb_id int, sheet_idx int, sheet string")
    away = f.filter("row_no < 3").withColumn("ref_sheet", F.lit("S1"))
    kinds = resolve.resolved_class(f, away, sheets)
    assert sorted((r.wb_id, r.row_no, r["class"]) for r in kinds.collect()) == [(w, i, k) for w in (1, 2) for i, k in ((1, "POINTER"), (2, "CROSS"), (3, "OWN"), (4, "EXTERNAL"))]
    assert _reads_distinct(kinds)
