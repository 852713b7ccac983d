"""What passes between tasks and stays on disk while the checks of a large corpus run."""

import os
import random
import time

from pyspark.sql import functions as F

from bruteforce import cyclic
from compare import DATA
from gridledger import session
from gridledger.fixtures import Views
from gridledger.operators import checks, fused, graph, grid
from gridledger.plans import source_queries

CELLS = "wb_id int, sheet_idx int, row_no int, col_no int"


def _books(rng):
    """Formulas of several workbooks: growing sums, whole columns and rows, blocks, other sheets and books, repeats and nulls."""
    def ref(r):
        c = lambda: rng.choice("ABCDEFGH")
        return rng.choice([f"{c()}{r}", f"$A$1:A{r}", f"{c()}:{c()}", f"{r}:{r + 1}", f"{c()}{r}:{c()}{r + 9}", f"S{rng.randrange(3)}!{c()}{r}", f"[1]S0!A{r}", "TODAY()", f"ROW(A{r})", "XFD1048576"])
    rows = [(w, s, r, c, f"{ref(rng.randrange(1, 40))}+{ref(rng.randrange(1, 40))}") for w in range(8) for s in range(3) for r in range(1, 40) for c in range(1, 9) if rng.random() < 0.12]
    return rows + rows[:9] + [(1, 0, 3, 3, None), (None, 0, 1, 1, "A1"), (2, None, 1, 1, "A1"), (2, 0, None, 1, "A1"), (9, 0, 2_000_000, 1, "A:A"), (9, 0, 7, 7, "G7")]


def test_cycles_in_one_call_equal_those_over_tables(spark, monkeypatch):
    rows = spark.createDataFrame(_books(random.Random(1)), f"{CELLS}, text string")
    edges = [(r.src, r.dst) for r in checks.dependency_edges(rows).collect()]
    want = {tuple(n.split("!")) for c in cyclic(edges) for n in c if "#" not in n}
    found = lambda: [(str(r.wb_id), r.sheet_key, str(r.row_no), str(r.col_no)) for r in checks.circular_cells(rows).collect()]
    got = found()
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    monkeypatch.setattr(graph, "BUCKET_TILES", 300)
    monkeypatch.setattr(graph, "CALL_TILES", 400)
    called = []
    monkeypatch.setattr(graph, "cyclic_nodes", lambda e, piece: called.append(e) or spark.createDataFrame(
        [n for c in cyclic([(r.src, r.dst) for r in e.collect()]) for n in c], "string").withColumnRenamed("value", "node"))
    assert set(found()) == want
    assert len(called) == 1 and 0 < called[0].select("wb_id").distinct().count() < 9  # some workbooks only


def test_cells_are_not_dealt_to_tiles(spark, monkeypatch):
    """What a formula reads goes to its workbook's bucket in one row; the tiles it is cut into are made there."""
    monkeypatch.setattr(checks, "dependency_edges", None)
    rows = [(w, 0, r, 1, "SUM(B1:C99)") for w in range(3) for r in range(1, 50)] + [(1, 0, 50, 2, "A7")]
    got = checks.circular_cells(spark.createDataFrame(rows, f"{CELLS}, text string"))
    assert sorted((r.wb_id, r.row_no, r.col_no) for r in got.collect()) == [(1, 7, 1), (1, 50, 2)]
    assert checks.circular_cells(spark.createDataFrame([], f"{CELLS}, text string")).count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    """The files of a step's shuffles go as soon as its table stands; the setting is as it was before."""
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: {f for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}
    before = files()
    table = session.checkpointed(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count().groupBy("count").agg(F.sum("k").alias("k")))
    time.sleep(2)
    assert not files() - before
    assert [tuple(r) for r in table.collect()] == [(10, 4950)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_few_texts_are_sent_to_the_cells(spark, monkeypatch):
    """Counted, not estimated: few texts go to all tasks, many stay a table."""
    df = spark.range(100).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("t"))
    sent = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString()
    assert sent(session.texts_table(df, "t")) and sent(session.texts_table(df.limit(0), "t"))
    monkeypatch.setattr(session, "FEW_CHARS", 250)
    assert not sent(session.texts_table(df, "t"))
    monkeypatch.setattr(session, "FEW_CHARS", 10**6)
    monkeypatch.setattr(session, "FEW_TEXTS", 99)
    assert not sent(session.texts_table(df, "t"))


def test_checks_are_counted_one_after_the_other(spark, monkeypatch):
    """What a check shuffles is gone before the next one begins: only its counts are kept, and the verdicts join those."""
    found = [spark.createDataFrame([(n, w, "x") for n, w in rows], "check_no int, wb_id int, location string") for rows in ([(22, 1), (22, 1), (47, 2)], [(22, 1), (61, 2)], [])]
    written = []
    monkeypatch.setattr(fused, "checkpointed", lambda df: written.append(sorted(df.columns)) or session.checkpointed(df))
    books = spark.createDataFrame([(1,), (2,)], "wb_id int")
    got = fused.verdicts(books, found, spark.createDataFrame([(2, 22), (1, 22)], "wb_id int, check_no int"), (22, 47, 61))
    assert written == [["check_no", "n", "wb_id"]] * 3
    assert {(r.wb_id, r.check_no): (r.decision, r.n_mistakes) for r in got.collect()} == {
        (1, 22): ("fail", 3), (2, 22): ("undecided", 0), (1, 47): ("pass", 0), (2, 47): ("fail", 1), (1, 61): ("pass", 0), (2, 61): ("fail", 1)}


def test_a_written_relation_is_read_by_those_derived_from_it(spark):
    v = Views(spark, f"{DATA}/sf0.001")
    kept = v.written("grid")
    for name in ("grid", "sheets", "formulas", "ranges"):
        df = getattr(kept, name)
        assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in df.inputFiles())
        assert df.exceptAll(getattr(v, name)).isEmpty() and df.count() == getattr(v, name).count()


def test_packages_are_made_in_one_deal(spark):
    """Cells are dealt out by workbook once; rows, sheets and packages are put together where they lie."""
    v = Views(spark, f"{DATA}/sf0.001").written("grid")
    plan = source_queries.model_rows(v)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # the cells; the sheets' facts by sheet and by workbook


def test_runs_of_repeated_cells(spark):
    """Equal cells share a place in their run; cells without a row or a column keep their own."""
    cells = [(1, 0, 1, c) for c in (1, 1, 2, 3, 5, 5)] + [(1, 0, 2, c) for c in (1, 2, 2, 3)] + [(1, 0, None, 4), (1, 0, None, 4), (1, 0, 7, None)]
    got = {tuple(r) for r in grid.group_cells(spark.createDataFrame(cells, CELLS)).collect()}
    assert got == {(1, 0, 1, 1, 2, 3), (1, 0, 1, 5, 1, 5), (1, 0, None, 4, None, 4), (1, 0, 7, None, 7, None)}
