"""From workbook files to verdicts and scores: everything the checks read comes out of the packages."""

import re

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import fused
from ..session import checkpointed
from . import query
from .check_queries import C65, C66, C80, C92, CLASS, FONT, GAPS, REFS, cell_rows, rect_rows, verdict_sql
from .source_queries import MOVED, model_views

CELL = C.CELL
NUMBERS = (22, 47, 49, 50, 51, 61, 62, 65, 66, 74, 80, 87, 92, 94, 95)
# formulas stand in cells with an error or a negative value
WRITTEN = MOVED.replace("FROM formulas f)", "FROM formulas f JOIN grid g ON g.wb_id = f.wb_id AND g.sheet_idx = f.sheet_idx AND g.row_no = f.row_no AND g.col_no = f.col_no WHERE v_err IS NOT NULL OR v_num < 0)")
NONE = "SELECT wb_id FROM sheets WHERE FALSE"
ZOOMS = """WITH lv AS (SELECT wb_id, zoom AS z, COUNT(*) AS n, MIN(sheet_idx) AS f FROM sheets GROUP BY 1, 2), md AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY wb_id ORDER BY n DESC, f) AS k FROM lv) q WHERE k = 1)
 SELECT s.wb_id FROM sheets s JOIN md ON md.wb_id = s.wb_id WHERE s.zoom <> md.z"""
_ERR = f"""WITH {GAPS}, err AS (SELECT g.wb_id, g.sheet_idx, g.row_no, g.col_no, v_err FROM grid g WHERE v_err IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM gaps p WHERE p.wb_id = g.wb_id AND p.sheet_idx = g.sheet_idx AND p.row_no = g.row_no AND p.col_no = g.col_no))
{cell_rows('err', "'shows ' || v_err")}"""
FOUND = {
    22: _ERR, 47: "SELECT wb_id FROM grid WHERE style_id IN (1, 5)", 61: ZOOMS, 62: NONE, 65: C65, 66: C66, 74: NONE, 80: C80, 92: C92,
    87: "SELECT wb_id FROM formulas WHERE text LIKE 'SUM(_:_)/2'", 95: "SELECT wb_id FROM formulas WHERE text LIKE '[1]%'",
    94: f"WITH y AS (SELECT *, 'number format prints nothing' AS why FROM grid WHERE style_id = 5) {rect_rows('y')}",
    **{n: f"WITH {REFS}, {CLASS}, {FONT.split(' AND NOT (wanted')[0]}), mine AS (SELECT * FROM wrong WHERE check_no = {n}) {rect_rows('mine')}" for n in (49, 50, 51)}}
OPEN = {22: "SELECT wb_id FROM grid WHERE v_err IS NOT NULL"}
VERDICTS = re.sub(r"\bformulas\b", "moved", " UNION ALL ".join(verdict_sql(n, FOUND[n], OPEN.get(n)) for n in NUMBERS))
FILE = "'wb' || CAST(wb_id AS VARCHAR) || '.xlsx'"


def file_verdicts(v):
    """Verdicts of the checks that a package alone decides, from parts to ``fused.verdicts``."""
    b = model_views(v)
    styles = b["styles"].select(F.concat_ws("#", "wb_id", F.col("style_id").cast("string")).alias("style_key"), "fmt_code", "fill_rgb", "font_rgb",
                                F.col("font_rgb").alias("text_rgb"), F.coalesce("fill_rgb", F.lit("FFFFFF")).alias("bg_rgb"))
    # read three times, so the packages' cells are written once
    written = checkpointed(b["cells"].select(*CELL, "v_num", "v_err", "v_text", "text", "style_id"))
    cells = written.join(b["sheets"].select("wb_id", "sheet_idx", "show_zeros"), ["wb_id", "sheet_idx"])
    cells = cells.select(*CELL, "v_num", "v_err", "v_text", "text", F.concat_ws("#", "wb_id", F.col("style_id").cast("string")).alias("style_key"),
                         F.lit(None).cast("string").alias("shown"), F.lit(None).cast("double").alias("width"), "show_zeros")
    hits = checkpointed(fused.cell_hits(cells, styles, ["OFFSET", "TODAY"]))
    # the files hold no conditional formats of the font
    none = b["cf_rules"].select("wb_id", "sheet_idx", "r1", "c1", "r2", "c2", F.lit("000000").alias("cf_rgb")).limit(0)
    texts = written.filter(F.col("v_text").isNotNull()).select(*CELL, "v_text")
    zoom, zoom_open = C.consistent_zoom(b["sheets"])
    cursors = C.active_cell_a1(b["sheets"], b["selections"].drop("sheet"))
    found = [fused.cell_mistakes(hits, texts, none).filter(F.col("check_no").isin(*NUMBERS))]
    for number, one in ((61, zoom), (62, cursors), (74, C.merged_cells(b["merges"])), (92, C.hidden_sheets(b["sheets"]))):
        found.append(fused.numbered(one, number))
    open_ = fused.undecided_errors(hits).union(zoom_open.select("wb_id", F.lit(61)))
    return fused.verdicts(b["sheets"], found, open_, NUMBERS)


@query("cr1_files_to_verdicts", "grid sheets formulas formats", f"WITH {WRITTEN} SELECT {FILE} AS wb_id, * EXCLUDE (wb_id) FROM ({VERDICTS}) v")
def _(v):
    return file_verdicts(v)


SCORES = f"""WITH {WRITTEN}, vd AS ({VERDICTS}), w AS (SELECT check_no, CAST(check_no % 4 + 1 AS DOUBLE) AS weight FROM vd GROUP BY check_no)
SELECT {FILE} AS wb_id, SUM(CASE WHEN decision = 'pass' THEN weight ELSE 0 END) / SUM(CASE WHEN decision <> 'undecided' THEN weight END) AS score, COUNT(CASE WHEN decision = 'undecided' THEN 1 END) AS n_open
FROM vd JOIN w USING (check_no) GROUP BY vd.wb_id"""


@query("r5_file_scores", "grid sheets formulas formats", SCORES)
def _(v):
    """Share of the weight that a file's decided checks pass."""
    weight = (F.col("check_no") % 4 + 1).cast("double")
    d = file_verdicts(v).withColumn("weight", weight)
    return d.groupBy("wb_id").agg((F.sum(F.when(F.col("decision") == "pass", F.col("weight")).otherwise(0.0)) / F.sum(F.when(F.col("decision") != "undecided", F.col("weight")))).alias("score"),
                                  F.count_if(F.col("decision") == "undecided").alias("n_open"))
