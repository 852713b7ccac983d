"""Steps of the scan of sheets and of the calculation graph whose cost may not grow beyond the input."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bruteforce import cyclic, greedy_blocks
from gridledger.operators import checks, evidence, graph, grid
from gridledger.session import checkpointed

CELLS = "wb_id int, sheet_idx int, row_no int, col_no int"


def _random_sheets(seed):
    rng = random.Random(seed)
    return {(w, s): {(r, c) for r in range(1, 40) for c in range(1, 9) if rng.random() < 0.8} for w in (1, 2) for s in (0, 1)}


def test_bands_are_swept_as_they_stream(spark):
    """Many bands pass through one call, rows and bands cut by batches anywhere."""
    sheets = _random_sheets(3)
    lines = []
    for (w, s), cells in sorted(sheets.items()):
        for r in range(1, 40):
            c = 1
            while c <= 8:
                if (r, c) in cells:
                    end = c
                    while (r, end + 1) in cells:
                        end += 1
                    lines.append((w, s, 0, False, r, c, end))
                    c = end
                c += 1
    names = ["wb_id", "sheet_idx", "band", "entered", "row_no", "c1", "c2"]
    cut = [pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in lines[i:i + 7]]) for i in range(0, len(lines), 7)]
    out = [r for b in grid._sweep(iter(cut)) for r in pa.Table.from_batches([b]).rename_columns(grid._SWEPT_NAMES).to_pylist()]
    got = {}
    for r in out:
        if r["kind"] != "rows":
            got.setdefault((r["wb_id"], r["sheet_idx"]), []).append((r["top"], r["left"], r["bottom"], r["right"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(greedy_blocks(c)) for k, c in sheets.items()}


@pytest.mark.parametrize("band_rows", [2, 2048])
def test_blocks_of_repeated_cells_in_small_batches(spark, band_rows):
    sheets = _random_sheets(4)
    rows = [(w, s, r, c) for (w, s), cells in sheets.items() for r, c in cells] * 2
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = grid.contiguous_blocks(spark.createDataFrame(rows, CELLS), band_rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {}
    for r in found:
        got.setdefault((r.wb_id, r.sheet_idx), []).append((r.top, r.left, r.bottom, r.right))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(greedy_blocks(c)) for k, c in sheets.items()}


def test_header_rows_without_pairs(spark):
    """Cells are counted along their row; blocks may have gaps, overlap and nulls."""
    rng = random.Random(6)
    cells = [(1, s, r, c, rng.choice([True, True, False, None])) for s in (0, 1) for r in range(1, 20) for c in range(1, 12) if rng.random() < 0.7]
    blocks = [(1, s, r, c, r + rng.randrange(6), c + rng.randrange(6)) for s in (0, 1, 2) for r, c in {(rng.randrange(1, 20), rng.randrange(1, 12)) for _ in range(40)}]
    want = set()
    for w, s, r1, c1, r2, c2 in blocks:
        for r in range(r1, min(r1 + 2, r2) + 1):
            inside = [t for a, b, i, c, t in cells if (a, b, i) == (w, s, r) and c1 <= c <= c2]
            if inside.count(True) >= max(1, 6 * len(inside) // 10):
                want.add((w, s, r1, c1, r))
                break
    got = evidence.header_row(spark.createDataFrame(cells, CELLS + ", is_text boolean"), spark.createDataFrame(blocks, "wb_id int, sheet_idx int, r1 int, c1 int, r2 int, c2 int"))
    assert {tuple(r) for r in got.collect()} == want and want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_scan_computes_its_cells_once(spark):
    cells = spark.createDataFrame([(1, 0, r, c, r == 1, "number", str(r)) for r in (1, 2) for c in (1, 2)] + [(1, 0, 9, 5, False, "string", "x")],
                                  CELLS + ", is_text boolean, type string, shown string").withColumn("shown", F.concat(F.lit("computed "), "shown"))
    found = evidence.scan_structure(cells)
    assert "computed " not in found._jdf.queryExecution().optimizedPlan().toString()  # read as written, by every part
    assert sorted((r.what, r["where"], r.detail) for r in found.collect()) == [
        ("block", "A1:B2", "1"), ("block", "E9", None), ("column", "A", "number | 2 | computed 1; computed 2"),
        ("column", "B", "number | 2 | computed 1; computed 2"), ("column", "E", "string | 1 | computed x"), ("used_range", "A1:E9", None)]


def _components(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.component, set()).add(r.node)
    assert all(label == min(nodes) for label, nodes in got.items())
    return {frozenset(c) for c in got.values()}


def _parts(rng, node):
    """Edges of several parts of the graph: random ones, loops, a long chain and a long ring."""
    edges = [(p, node(p, rng.randrange(15)), node(p, rng.randrange(15))) for p in range(30) for _ in range(20)] + [(30, node(30, 1), node(30, 1))]
    chain = [(p, node(p, i), node(p, i + 1)) for p in (31, 32) for i in range(3000)]
    return edges + edges[:50] + chain + [(32, node(32, 3000), node(32, 0))]


@pytest.mark.parametrize("node, kind", [(lambda p, i: p * 10_000 + i, "long"), (lambda p, i: f"{p}!é{i}", "string")])
def test_cycles_of_parts_against_tarjan(spark, monkeypatch, node, kind):
    edges = _parts(random.Random(8), node)
    rows = spark.createDataFrame([*edges, (40, None, node(40, 1)), (40, node(40, 1), None), (None, None, None)], f"p long, src {kind}, dst {kind}")
    monkeypatch.setattr(graph, "BUCKET_EDGES", 500)
    assert _components(graph.cyclic_nodes(rows, piece=F.col("p"))) == cyclic([(a, b) for _, a, b in edges])


def test_large_parts_go_through_rounds(spark, monkeypatch):
    """Buckets over the bound take the rounds, the rest is solved in place; no component is lost or named otherwise."""
    rng = random.Random(9)
    edges = [(p, p * 100 + rng.randrange(20), p * 100 + rng.randrange(20)) for p in range(6) for _ in range(25)]
    edges += [(9, 900 + i, 900 + (i + 1) % 60) for i in range(60)]
    rows = spark.createDataFrame(edges, "p long, src long, dst long")
    called = []
    rounds = graph._cyclic_by_rounds
    monkeypatch.setattr(graph, "_cyclic_by_rounds", lambda e, n: called.append({r.src // 100 for r in e.select("src").collect()}) or rounds(e, n))
    monkeypatch.setattr(graph, "BUCKET_EDGES", 10)
    monkeypatch.setattr(graph, "CALL_EDGES", 40)
    found = {}
    for r in graph.cyclic_nodes(rows, piece=F.col("p")).collect():
        found.setdefault(r.component, set()).add(r.node)
    assert {frozenset(c) for c in found.values()} == cyclic([(a, b) for _, a, b in edges])
    assert len(called) == 1 and 9 in called[0] and called[0] != {0, 1, 2, 3, 4, 5, 9}


def test_cycles_of_no_edges(spark):
    rows = spark.createDataFrame([], "p long, src long, dst long")
    assert graph.cyclic_nodes(rows, piece=F.col("p")).collect() == []


def test_circular_cells_write_few_tables(spark, monkeypatch):
    """Books of bounded size cost no rounds, however deep their formulas are nested."""
    written = []
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(1) or checkpointed(df))
    rows = [(w, 0, r, 1, f"A{r + 1}+A{r + 2}") for w in range(20) for r in range(1, 20)] + [(3, 0, 20, 1, "A4"), (5, 0, 21, 1, "A21")]
    cells = checks.circular_cells(spark.createDataFrame(rows, CELLS + ", text string"))
    assert sorted((r.wb_id, r.row_no) for r in cells.collect()) == [(3, r) for r in range(4, 21)] + [(5, 21)]
    assert len(written) <= 2
