"""E1-E12."""

from pyspark.sql import functions as F

from ..functions import a1
from ..operators import grid as G
from . import query

LETTERS = """CASE WHEN {c} <= 26 THEN chr(CAST(64 + {c} AS INT)) WHEN {c} <= 702
  THEN chr(CAST(64 + FLOOR(({c} - 1) / 26) AS INT)) || chr(CAST(65 + ({c} - 1) % 26 AS INT))
  ELSE chr(CAST(64 + FLOOR(({c} - 703) / 676) + 1 AS INT)) || chr(CAST(65 + FLOOR(({c} - 703) / 26) % 26 AS INT)) || chr(CAST(65 + ({c} - 1) % 26 AS INT)) END"""


def letters(c):
    return LETTERS.format(c=c)


# columns spread over the sheet's whole width, so one-, two- and three-letter names occur
WIDE = "(ref_sheet * 1801 + c1)"
SPREAD = f"""spread AS (SELECT wb_id, sheet_idx, row_no, col_no, r1, {WIDE} AS wc1, r2, {WIDE} + (r2 - r1) AS wc2, ref_sheet FROM refs),
texts AS (SELECT *, CASE ref_sheet WHEN 0 THEN {letters('wc1')} || ':' || {letters('wc2')}
  WHEN 1 THEN CAST(r2 AS VARCHAR(9)) || ':' || CAST(r1 AS VARCHAR(9))
  WHEN 2 THEN 'Rates' || CAST(r1 AS VARCHAR(9)) || '_x'
  WHEN 3 THEN '$' || {letters('wc1')} || '$' || CAST(r1 AS VARCHAR(9))
  ELSE {letters('wc2')} || CAST(r2 AS VARCHAR(9)) || ':' || {letters('wc1')} || CAST(r1 AS VARCHAR(9)) END AS ref FROM spread)"""


def spread(v):
    wc1 = F.col("ref_sheet") * 1801 + F.col("c1")
    s = v.refs.select("wb_id", "sheet_idx", "row_no", "col_no", "r1", wc1.alias("wc1"), "r2",
                      (wc1 + F.col("r2") - F.col("r1")).alias("wc2"), "ref_sheet")
    l1, l2 = a1.column_letters(F.col("wc1")), a1.column_letters(F.col("wc2"))
    r1, r2, k = F.col("r1").cast("string"), F.col("r2").cast("string"), F.col("ref_sheet")
    text = (F.when(k == 0, F.concat(l1, F.lit(":"), l2)).when(k == 1, F.concat(r2, F.lit(":"), r1))
            .when(k == 2, F.concat(F.lit("Rates"), r1, F.lit("_x"))).when(k == 3, F.concat(F.lit("$"), l1, F.lit("$"), r1))
            .otherwise(F.concat(l2, r2, F.lit(":"), l1, r1)))
    return s.withColumn("ref", text)


@query("e1_parse_a1", "refs", f"""WITH {SPREAD}
SELECT wb_id, sheet_idx, row_no, col_no, ref,
  CASE WHEN ref_sheet = 2 THEN NULL WHEN ref_sheet = 0 THEN 1 ELSE r1 END AS p_r1,
  CASE WHEN ref_sheet = 2 THEN NULL WHEN ref_sheet = 1 THEN 1 ELSE wc1 END AS p_c1,
  CASE WHEN ref_sheet = 2 THEN NULL WHEN ref_sheet = 0 THEN 1048576 WHEN ref_sheet = 3 THEN r1 ELSE r2 END AS p_r2,
  CASE WHEN ref_sheet = 2 THEN NULL WHEN ref_sheet = 1 THEN 16384 WHEN ref_sheet = 3 THEN wc1 ELSE wc2 END AS p_c2 FROM texts""")
def _(v):
    p = spread(v).withColumn("p", a1.parse_a1(F.col("ref")))
    return p.select("wb_id", "sheet_idx", "row_no", "col_no", "ref", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("r1", "c1", "r2", "c2")])


@query("e2_to_a1", "refs", f"""WITH {SPREAD}
SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN ref_sheet >= 5 THEN 'S' || CAST(ref_sheet AS VARCHAR(3)) || '_x' ELSE '''Model ' || CAST(ref_sheet AS VARCHAR(3)) || '''''s''' END || '!' ||
  {letters('wc1')} || CAST(r1 AS VARCHAR(9)) || CASE WHEN r1 = r2 THEN '' ELSE ':' || {letters('wc2')} || CAST(r2 AS VARCHAR(9)) END AS location FROM spread""")
def _(v):
    k = F.col("ref_sheet")
    sheet = F.when(k >= 5, F.concat(F.lit("S"), k.cast("string"), F.lit("_x"))).otherwise(F.concat(F.lit("Model "), k.cast("string"), F.lit("'s")))
    ref = a1.to_a1(F.col("r1"), F.col("wc1"), F.col("r2"), F.col("wc2"))
    return spread(v).select("wb_id", "sheet_idx", "row_no", "col_no", a1.location(sheet, ref).alias("location"))


@query("e3_group_cells", "grid", """
SELECT wb_id, sheet_idx, MIN(row_no) AS r1, c1, MAX(row_no) AS r2, c2 FROM (
 SELECT *, row_no - ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, c1, c2 ORDER BY row_no) AS stack FROM (
  SELECT wb_id, sheet_idx, row_no, MIN(col_no) AS c1, MAX(col_no) AS c2 FROM (
   SELECT wb_id, sheet_idx, row_no, col_no, col_no - ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, row_no ORDER BY col_no) AS island FROM grid) a
  GROUP BY wb_id, sheet_idx, row_no, island) b) c GROUP BY wb_id, sheet_idx, c1, c2, stack""")
def _(v):
    return G.group_cells(v.grid)


@query("e4_runs_of_equal", "grid", """
SELECT wb_id, sheet_idx, col_no, style_id, MIN(row_no) AS first, MAX(row_no) AS last FROM (
 SELECT *, SUM(new) OVER (PARTITION BY wb_id, sheet_idx, col_no ORDER BY row_no) AS run FROM (
  SELECT *, CASE WHEN LAG(row_no) OVER w = row_no - 1 AND LAG(style_id) OVER w = style_id THEN 0 ELSE 1 END AS new
  FROM grid WINDOW w AS (PARTITION BY wb_id, sheet_idx, col_no ORDER BY row_no)) a) b GROUP BY wb_id, sheet_idx, col_no, style_id, run""")
def _(v):
    return G.runs_of_equal(v.grid, ["wb_id", "sheet_idx", "col_no"], "row_no", "style_id")


PAINT = """WITH cuts AS (SELECT DISTINCT sheet_key, c FROM (SELECT sheet_key, lo AS c FROM intervals UNION ALL SELECT sheet_key, hi + 1 FROM intervals) a),
segs AS (SELECT sheet_key, c AS seg_lo, LEAD(c) OVER (PARTITION BY sheet_key ORDER BY c) - 1 AS seg_hi FROM cuts),
painted AS (SELECT sheet_key, seg_lo, seg_hi, seq, width, hidden, outline_level FROM (
  SELECT s.sheet_key, seg_lo, seg_hi, i.*, ROW_NUMBER() OVER (PARTITION BY s.sheet_key, seg_lo ORDER BY i.lo DESC, i.seq DESC) AS k
  FROM segs s JOIN (SELECT sheet_key AS sk, seq, lo, hi, width, hidden, outline_level FROM intervals) i ON i.sk = s.sheet_key AND seg_lo BETWEEN lo AND hi
  WHERE seg_hi IS NOT NULL) q WHERE k = 1)"""


@query("e5_paint_cols", "intervals", PAINT + " SELECT * FROM painted")
def _(v):
    return G.paint_cols(v.intervals)


@query("e6_used_range", "grid", """
SELECT wb_id, sheet_idx, MIN(row_no) AS r1, MIN(col_no) AS c1, MAX(row_no) AS r2, MAX(col_no) AS c2 FROM grid GROUP BY wb_id, sheet_idx""")
def _(v):
    return G.used_range(v.grid)


@query("e7_contiguous_blocks")
def _(v):
    return G.contiguous_blocks(v.grid)


@query("e8_range_members", "grid ranges", """
SELECT g.wb_id, g.sheet_idx, g.row_no, g.col_no, r1, c1, r2, c2, priority FROM grid g JOIN ranges r
ON r.wb_id = g.wb_id AND r.sheet_idx = g.sheet_idx AND row_no BETWEEN r1 AND r2 AND col_no BETWEEN c1 AND c2""")
def _(v):
    return G.range_members(v.grid.select("wb_id", "sheet_idx", "row_no", "col_no"), v.ranges)


@query("e9_effective_style", "grid", """
WITH c AS (SELECT wb_id, sheet_idx, row_no, col_no, NULLIF(style_id, 0) AS style_id FROM grid),
r AS (SELECT wb_id, sheet_idx, row_no, MAX(CASE WHEN v_err IS NOT NULL THEN style_id END) AS rs FROM grid GROUP BY 1, 2, 3),
k AS (SELECT wb_id, sheet_idx, col_no, MAX(CASE WHEN v_num > 100000 THEN style_id END) AS cs FROM grid GROUP BY 1, 2, 3)
SELECT c.wb_id, c.sheet_idx, c.row_no, c.col_no, COALESCE(style_id, rs, cs, 0) AS effective_style
FROM c JOIN r ON r.wb_id = c.wb_id AND r.sheet_idx = c.sheet_idx AND r.row_no = c.row_no JOIN k ON k.wb_id = c.wb_id AND k.sheet_idx = c.sheet_idx AND k.col_no = c.col_no""")
def _(v):
    g = v.grid
    cells = g.select("wb_id", "sheet_idx", "row_no", "col_no", F.nullif(F.col("style_id"), F.lit(0)).alias("style_id"))
    rows = g.groupBy("wb_id", "sheet_idx", "row_no").agg(F.max(F.when(F.col("v_err").isNotNull(), F.col("style_id"))).alias("style_id"))
    cols = g.groupBy("wb_id", "sheet_idx", "col_no").agg(F.max(F.when(F.col("v_num") > 100000, F.col("style_id"))).alias("style_id"))
    return G.effective_style(cells, rows, cols).drop("style_id")


@query("e10_next_filled", "grid", """
SELECT wb_id, sheet_idx, row_no, col_no, LAG(col_no) OVER (PARTITION BY wb_id, sheet_idx, row_no ORDER BY col_no) AS left_col,
 LEAD(col_no) OVER (PARTITION BY wb_id, sheet_idx, row_no ORDER BY col_no) AS right_col,
 LEAD(row_no) OVER (PARTITION BY wb_id, sheet_idx, col_no ORDER BY row_no) AS below_row FROM grid""")
def _(v):
    return G.next_filled(v.grid)


@query("e11_shared_children", "refs", """
WITH m AS (SELECT * FROM (SELECT refs.*, ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, col_no ORDER BY row_no DESC) AS k FROM refs) q WHERE k = 1),
y AS (SELECT c.wb_id, c.sheet_idx, c.row_no, c.col_no, m.c1, m.c2, m.r1 + CASE WHEN m.ref_sheet % 2 = 0 THEN 0 ELSE c.row_no - m.row_no END AS a,
  m.r2 + CASE WHEN m.ref_sheet % 3 = 0 THEN 0 ELSE c.row_no - m.row_no END AS b
 FROM refs c JOIN m ON m.wb_id = c.wb_id AND m.sheet_idx = c.sheet_idx AND m.col_no = c.col_no),
x AS (SELECT wb_id, sheet_idx, row_no, col_no, LEAST(a, b) AS r1, c1, GREATEST(a, b) AS r2, c2 FROM y)
SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN r1 >= 1 THEN r1 END AS r1, CASE WHEN r1 >= 1 THEN c1 END AS c1,
  CASE WHEN r1 >= 1 THEN r2 END AS r2, CASE WHEN r1 >= 1 THEN c2 END AS c2, r1 < 1 AS off_grid FROM x""")
def _(v):
    cells = v.refs.withColumn("si", F.col("col_no"))
    everything = F.struct(*[c for c in cells.columns if c not in ("wb_id", "sheet_idx", "si")])
    masters = (cells.groupBy("wb_id", "sheet_idx", "si").agg(F.max_by(everything, "row_no").alias("m"))
               .select("wb_id", "sheet_idx", "si", "m.*")
               .withColumn("r1_abs", F.col("ref_sheet") % 2 == 0).withColumn("r2_abs", F.col("ref_sheet") % 3 == 0)
               .withColumn("c1_abs", F.lit(False)).withColumn("c2_abs", F.lit(True)))
    return G.shared_children(masters, cells)


@query("e12_dyadic_blocks", "refs", """
SELECT wb_id, sheet_idx, row_no, col_no, level, k FROM (
 SELECT *, CAST(CEIL((r1 - 1) / p) AS BIGINT) AS a, CAST(FLOOR(r2 / p) AS BIGINT) AS b
 FROM (SELECT refs.*, l.level, CAST(POW(2, l.level) AS DOUBLE) AS p FROM refs, (SELECT UNNEST(range(0, 21)) AS level) l) x) y,
 LATERAL (SELECT a AS k WHERE a < b AND a % 2 = 1 UNION ALL SELECT b - 1 WHERE a < b AND b % 2 = 1) z""")
def _(v):
    return G.dyadic_blocks(v.refs).select("wb_id", "sheet_idx", "row_no", "col_no", "level", "k")
