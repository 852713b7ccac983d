"""P1-P25."""

from pyspark.sql import functions as F

from ..functions import a1 as A
from ..functions import text as T
from ..operators import evidence as P
from ..operators.grid import paint_cols, used_range
from . import query
from .check_queries import COLS, columns
from .feature_queries import MASK, REFS, own_sheet, ref_rows
from .grid_queries import PAINT

CELL = ["wb_id", "sheet_idx", "row_no", "col_no"]
SHEET = ["wb_id", "sheet_idx"]

KEYED = """k AS (SELECT *, CASE WHEN label LIKE 'Q%' THEN CAST(right(label, 4) AS INT) * 10000 + CAST(substr(label, 2, 1) AS INT) * 300 WHEN label LIKE 'FY%' THEN CAST(substr(label, 3, 4) AS INT) * 10000 + 1231 END AS pk FROM periods WHERE label IS NOT NULL),
n AS (SELECT *, CASE WHEN pos - LAG(pos) OVER (PARTITION BY sheet_key ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT *, SUM(new) OVER (PARTITION BY sheet_key ORDER BY pos) AS run FROM n), o AS (SELECT *, LAG(pk) OVER (PARTITION BY sheet_key, run ORDER BY pos) AS bk, COUNT(*) OVER (PARTITION BY sheet_key, run) AS cnt FROM r),
series AS (SELECT sheet_key, MIN(pos) AS start, MAX(pos) AS "end", COUNT(*) AS n, arg_min(label, pos) AS first, arg_max(label, pos) AS last, FALSE AS numeric, MAX(pos) - MIN(pos) + 1 - COUNT(*) AS n_gaps,
  COUNT(CASE WHEN bk < pk THEN 1 END) > 0 AND COUNT(CASE WHEN bk > pk THEN 1 END) > 0 AS out_of_order FROM o GROUP BY sheet_key, run HAVING COUNT(*) >= 3)"""


def header_cells(v):
    """Filled header cells: blanks hold no row."""
    return v.periods.filter("label is not null").withColumn("v_num", F.lit(None).cast("double"))


@query("p1_period_key", "periods", "SELECT sheet_key, pos, label, CASE WHEN label LIKE 'Q%' THEN CAST(right(label, 4) AS INT) WHEN label IS NOT NULL THEN CAST(substr(label, 3, 4) AS INT) END AS y, CASE WHEN label LIKE 'Q%' THEN CAST(substr(label, 2, 1) AS INT) * 3 WHEN label IS NOT NULL THEN 12 END AS m, CASE WHEN label LIKE 'Q%' THEN 0 WHEN label IS NOT NULL THEN 31 END AS d FROM periods")
def _(v):
    return v.periods.withColumn("k", T.period_key(F.col("label"))).select("sheet_key", "pos", "label", "k.y", "k.m", "k.d")


@query("p1_period_forms", "", """
SELECT o_orderkey, CAST(EXTRACT(year FROM o_orderdate) AS INT) AS y, CAST(CASE o_orderkey % 6 WHEN 0 THEN 12 WHEN 1 THEN EXTRACT(quarter FROM o_orderdate) * 3 WHEN 4 THEN EXTRACT(quarter FROM o_orderdate) * 3 WHEN 5 THEN 12 ELSE EXTRACT(month FROM o_orderdate) END AS INT) AS m FROM orders""")
def _(v):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    q = F.quarter(d).cast("string")
    label = (F.when(k == 0, F.date_format(d, "'FY'yy")).when(k == 1, F.concat(F.lit("Q"), q, F.lit("'"), F.date_format(d, "yy"))).when(k == 2, F.date_format(d, "MMM-yy"))
             .when(k == 3, F.date_format(d, "MMMM yyyy")).when(k == 4, F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), q)).otherwise(F.date_format(d, "yyyy")))
    return v.orders.withColumn("k", T.period_key(label)).select("o_orderkey", "k.y", "k.m")


@query("p2_period_series", "periods", f"WITH {KEYED} SELECT * FROM series")
def _(v):
    return P.period_series(header_cells(v), ["sheet_key"])


@query("p2_numeric_years", "", """
WITH y AS (SELECT o_custkey AS sheet_key, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, CAST(EXTRACT(year FROM o_orderdate) AS INT) AS yr FROM orders),
n AS (SELECT *, CASE WHEN yr - LAG(yr) OVER (PARTITION BY sheet_key ORDER BY pos) <= 1 THEN 0 ELSE 1 END AS new FROM y), r AS (SELECT *, SUM(new) OVER (PARTITION BY sheet_key ORDER BY pos) AS run FROM n)
SELECT sheet_key, MIN(pos) AS start, MAX(pos) AS "end", COUNT(*) AS n, CAST(MIN(yr) AS VARCHAR) AS first, CAST(MAX(yr) AS VARCHAR) AS last FROM r GROUP BY sheet_key, run HAVING COUNT(*) >= 3 AND MIN(yr) < MAX(yr)""")
def _(v):
    from pyspark.sql import Window
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    cells = v.orders.select(F.col("o_custkey").alias("sheet_key"), pos.alias("pos"), F.lit(None).cast("string").alias("label"), F.year("o_orderdate").cast("double").alias("v_num"))
    return P.period_series(cells, ["sheet_key"]).select("sheet_key", "start", "end", "n", "first", "last")


@query("p3_series_out_of_order", "periods", f"WITH {KEYED} SELECT sheet_key, start, n FROM series WHERE out_of_order")
def _(v):
    return P.series_out_of_order(P.period_series(header_cells(v), ["sheet_key"])).select("sheet_key", "start", "n")


@query("p4_series_gaps", "periods", f"""WITH {KEYED}, gp AS (SELECT sheet_key, pos - 1 AS pos FROM (SELECT *, LAG(pos) OVER (PARTITION BY sheet_key, run ORDER BY pos) AS bp FROM o) q WHERE pos - bp = 2 AND cnt >= 3)
SELECT sheet_key, 1 AS row_no, pos FROM gp WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = gp.sheet_key AND x.o_orderkey % 12 + 1 = gp.pos AND x.o_orderkey % 30 + 2 BETWEEN 2 AND 16)""")
def _(v):
    values = v.orders.select(F.col("o_custkey").alias("sheet_key"), (F.col("o_orderkey") % 12 + 1).alias("pos"), (F.col("o_orderkey") % 30 + 2).alias("row_no"))
    return P.series_gaps(header_cells(v).withColumn("row_no", F.lit(1)), values, ["sheet_key", "row_no"])


@query("p5_vertical_series", "grid sheets", """
WITH a AS (SELECT wb_id, sheet_idx, col_no, row_no AS pos, v_err, ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, col_no ORDER BY row_no) AS nth FROM grid), c AS (SELECT * FROM a WHERE v_err IS NULL),
r AS (SELECT *, SUM(new) OVER (PARTITION BY wb_id, sheet_idx, col_no ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos - LAG(pos) OVER w <= 2 AND nth - LAG(nth) OVER w = 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY wb_id, sheet_idx, col_no ORDER BY pos)) q),
s AS (SELECT wb_id, sheet_idx, col_no, MIN(pos) AS start, MAX(pos) AS e, COUNT(*) AS n FROM r GROUP BY wb_id, sheet_idx, col_no, run HAVING COUNT(*) >= 3),
b AS (SELECT s.*, (SELECT COUNT(*) FROM grid g WHERE g.wb_id = s.wb_id AND g.sheet_idx = s.sheet_idx AND g.col_no = s.col_no + 1 AND g.row_no BETWEEN start AND e) AS beside,
  (SELECT COUNT(*) FROM grid g WHERE g.wb_id = s.wb_id AND g.sheet_idx = s.sheet_idx AND g.col_no = s.col_no + 1 AND g.row_no BETWEEN start AND e AND v_num > 45000) AS formulas
  FROM s JOIN sheets t ON t.wb_id = s.wb_id AND t.sheet_idx = s.sheet_idx WHERE state = 'visible')
SELECT wb_id, sheet_idx, col_no, start, e AS "end", n, beside, formulas FROM b WHERE beside > 0 AND formulas * 2 >= beside""")
def _(v):
    # an error stands between the periods as other content
    label = F.coalesce("v_err", F.concat(F.lit("FY"), (F.col("row_no") % 90 + 2000).cast("string")))
    cells = v.grid.select(*SHEET, "col_no", F.col("row_no").alias("pos"), label.alias("label"), F.lit(None).cast("double").alias("v_num"))
    beside = v.grid.select(*CELL, (F.col("v_num") > 45000).alias("is_formula"))
    return P.vertical_series(cells, v.sheets.filter("state = 'visible'"), beside).drop("out_of_order")


@query("p6_content_below_end", "text_cells", """
WITH m AS (SELECT wb_id, sheet_idx, MAX(row_no) AS marker_row FROM text_cells WHERE v_text = 'END' GROUP BY 1, 2)
SELECT m.wb_id, m.sheet_idx, marker_row, 2 AS marker_col, COUNT(DISTINCT t.row_no) AS rows_below, MIN(t.row_no) AS first_below, MAX(t.row_no) AS last_below
FROM m LEFT JOIN text_cells t ON t.wb_id = m.wb_id AND t.sheet_idx = m.sheet_idx AND t.row_no > marker_row GROUP BY 1, 2, 3""")
def _(v):
    return P.content_below_end(v.text_cells, v.text_cells)


@query("p7_date_literal_formulas", "formulas grid", """
SELECT wb_id, sheet_idx, row_no, col_no FROM grid WHERE style_id IN (3, 4)""")
def _(v):
    s, t = F.col("style_id"), F.col("text")
    f = v.formulas.join(v.grid.select(*CELL, "style_id"), CELL)
    text = F.when(s == 3, F.concat(t, F.lit('+DATEVALUE("12.12.2028")'))).when(s == 4, F.concat(t, F.lit('-VALUE("2028-1-02")'))).when(s == 5, F.concat(t, F.lit('&"1.2"'))).otherwise(t)
    return P.date_literal_formulas(f.withColumn("text", text)).select(*CELL)


@query("p8_rounding_claims", "text_cells formulas", """
WITH s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx ORDER BY row_no, col_no) AS k FROM text_cells WHERE regexp_matches(v_text, '(?i)\\bround(ed|s|ing)?\\s+to\\b')),
c AS (SELECT wb_id, sheet_idx, COUNT(*) AS statements, string_agg(chr(CAST(64 + col_no AS INT)) || CAST(row_no AS VARCHAR), ';' ORDER BY row_no, col_no) AS examples FROM s GROUP BY 1, 2),
f AS (SELECT wb_id, sheet_idx, COUNT(*) AS n_formulas, COUNT(CASE WHEN text LIKE '%ROUND(%' THEN 1 END) AS n_round FROM formulas GROUP BY 1, 2)
SELECT * FROM c JOIN f USING (wb_id, sheet_idx)""")
def _(v):
    return P.rounding_claims(v.text_cells, v.formulas)


@query("p9_oversized_range", "grid sheets", """
WITH u AS (SELECT wb_id, sheet_idx, MAX(row_no) AS lr, MAX(col_no) AS lc FROM grid GROUP BY 1, 2)
SELECT wb_id, sheet_idx, CASE WHEN state = 'hidden' THEN 1048576 // lr END AS row_factor, CASE WHEN zoom = 80 THEN 16384 // lc END AS col_factor FROM u JOIN sheets USING (wb_id, sheet_idx) WHERE state = 'hidden' OR zoom = 80""")
def _(v):
    d = v.sheets.select(*SHEET, F.when(F.col("state") == "hidden", 1048576).otherwise(F.col("max_row")).alias("declared_rows"), F.when(F.col("zoom") == 80, 16384).otherwise(F.col("max_col")).alias("declared_cols"))
    return P.oversized_range(d, used_range(v.grid))


@query("p10_freeze_extent", "intervals", f"""{PAINT}, sp AS (SELECT c_custkey AS sheet_key, c_custkey % 30 AS rows, c_nationkey AS cols FROM customer),
rw AS (SELECT o_custkey AS sheet_key, o_orderkey % 50 AS row_no, MAX(o_orderkey % 41) AS height, bool_or(o_orderstatus = 'F') AS hidden FROM orders GROUP BY 1, 2),
x AS (SELECT sp.*, rows * 15 + COALESCE((SELECT SUM(CASE WHEN hidden THEN 0 ELSE height END - 15) FROM rw WHERE rw.sheet_key = sp.sheet_key AND row_no <= rows), 0) AS rp,
  cols * 8.43::DOUBLE + COALESCE((SELECT SUM((LEAST(seg_hi, cols) - seg_lo + 1) * (width - 8.43::DOUBLE)) FROM painted p WHERE p.sheet_key = sp.sheet_key AND seg_lo <= cols), 0) AS cc FROM sp)
SELECT sheet_key, rows, cols, CAST(ROUND(CAST(rp AS DECIMAL(20, 6)), 1) AS DOUBLE) AS rows_pt, CAST(ROUND(CAST(cc AS DECIMAL(20, 6)), 1) AS DOUBLE) AS cols_chars, rp > 300 OR ROUND(CAST(cc AS DECIMAL(20, 6)), 1) > 200 AS excessive FROM x""")
def _(v):
    splits = v.customer.select(F.col("c_custkey").alias("sheet_key"), (F.col("c_custkey") % 30).alias("rows"), F.col("c_nationkey").alias("cols"))
    rows = v.orders.groupBy(F.col("o_custkey").alias("sheet_key"), (F.col("o_orderkey") % 50).alias("row_no")).agg(
        F.max(F.col("o_orderkey") % 41).alias("height"), F.bool_or(F.col("o_orderstatus") == "F").alias("hidden"))
    return P.freeze_extent(splits, rows, paint_cols(v.intervals))


@query("p11_print_pages", "sheets", """
WITH d AS (SELECT wb_id, sheet_idx, max_row * 15.0::DOUBLE AS h, max_col * 12.0::DOUBLE * 5.25 AS w, CASE WHEN zoom = 80 THEN 792.0 ELSE 612.0 END::DOUBLE - 72 * 1.4 AS aw, CASE WHEN zoom = 80 THEN 612.0 ELSE 792.0 END::DOUBLE - 72 * 1.5 AS ah,
  state = 'hidden' AS fit, sheet_idx FROM sheets), s AS (SELECT *, CASE WHEN fit THEN GREATEST(LEAST(1.0, aw * 1 / w), 0.1) ELSE 0.9 END AS sc FROM d)
SELECT wb_id, sheet_idx, ROUND(sc, 4) AS used_scale, ROUND(h * sc / ah, 2) AS pages_tall, ROUND(w * sc / aw, 2) AS pages_wide FROM s""")
def _(v):
    x = F.lit
    s = v.sheets.select(*SHEET, (F.col("max_row") * 15.0).alias("height_pt"), (F.col("max_col") * 12.0).alias("width_chars"), x(612.0).alias("paper_w"), x(792.0).alias("paper_h"), (F.col("zoom") == 80).alias("landscape"),
                        x(1.4).alias("margin_x"), x(1.5).alias("margin_y"), (F.col("state") == "hidden").alias("fit"), x(1).alias("fit_w"), x(None).cast("int").alias("fit_h"), x(90).alias("scale"))
    return P.print_pages(s).select(*SHEET, "used_scale", "pages_tall", "pages_wide")


@query("p12_column_fit", "grid", f"""WITH {COLS}, n AS (SELECT g.wb_id, g.sheet_idx, g.col_no, width, printf('%.2f', v_num) AS s FROM grid g JOIN cols USING (wb_id, sheet_idx, col_no)),
e AS (SELECT *, (0.507 * (length(s) - length(regexp_replace(s, '[0-9]', '', 'g'))) + 0.251 * 1 + 0.306 * (CASE WHEN s LIKE '-%' THEN 1 ELSE 0 END)) * (11 * 96.0 / 72 / 7) AS need FROM n)
SELECT wb_id, sheet_idx, col_no, width, COUNT(*) AS n_cells, ROUND(MAX(need), 4) AS widest FROM e WHERE need > width + 1.5 GROUP BY 1, 2, 3, 4""")
def _(v):
    return P.column_fit(v.grid.withColumn("shown", F.format_string("%.2f", F.col("v_num"))), columns(v))


@query("p13_hidden_ranges", "intervals", f"""{PAINT}, h AS (SELECT *, CASE WHEN LAG(seg_hi) OVER (PARTITION BY sheet_key ORDER BY seg_lo) = seg_lo - 1 THEN 0 ELSE 1 END AS new FROM painted WHERE hidden),
r AS (SELECT *, SUM(new) OVER (PARTITION BY sheet_key ORDER BY seg_lo) AS run FROM h) SELECT sheet_key, MIN(seg_lo) AS first, MAX(seg_hi) AS last, bool_and(outline_level > 0) AS grouped FROM r GROUP BY sheet_key, run""")
def _(v):
    return P.hidden_ranges(paint_cols(v.intervals))


@query("p14_validation_tally", "ranges", """
SELECT wb_id, sheet_idx, COUNT(*) AS n, COUNT(CASE WHEN priority < 2 THEN 1 END) AS n_on, COUNT(CASE WHEN priority IN (2, 3) THEN 1 END) AS n_off, COUNT(CASE WHEN priority = 4 THEN 1 END) AS n_unknown FROM ranges GROUP BY 1, 2""")
def _(v):
    return P.validation_tally(v.ranges.withColumn("alert", F.when(F.col("priority") < 4, F.col("priority") < 2)))


@query("p15_styled_empty_cells", "grid formats", "SELECT wb_id, sheet_idx, COUNT(*) AS n FROM grid JOIN formats USING (style_id) WHERE v_num = 0 AND (fmt_code <> 'General' OR ref_key % 2 = 0) GROUP BY 1, 2")
def _(v):
    cells = v.grid.join(v.formats, "style_id").withColumn("v_num", F.nullif(F.col("v_num"), F.lit(0.0))).withColumn("v_text", F.lit(None).cast("string"))
    cells = cells.withColumn("bold", F.col("ref_key") % 2 == 0).withColumn("fill_rgb", F.lit(None).cast("string")).withColumn("border", F.lit(False))
    return P.styled_empty_cells(cells)


@query("p16_implicit_intersection", "refs", "SELECT wb_id, sheet_idx, row_no, col_no, r1, c1, r2, c2 FROM refs WHERE r2 > r1 AND NOT row_no BETWEEN r1 AND r2")
def _(v):
    return P.implicit_intersection(v.refs).select(*CELL, "r1", "c1", "r2", "c2")


@query("p17_dependents", "refs", """
WITH f AS (SELECT DISTINCT wb_id, sheet_idx, row_no, col_no FROM refs WHERE r2 > r1 AND NOT row_no BETWEEN r1 AND r2),
h AS (SELECT f.*, x.sheet_idx AS by_sheet, x.row_no AS by_row, x.col_no AS by_col FROM f JOIN refs x ON x.wb_id = f.wb_id AND x.ref_sheet = f.sheet_idx AND x.r1 = f.row_no AND x.r2 = f.row_no AND x.c1 = f.col_no AND x.c2 = f.col_no)
SELECT wb_id, sheet_idx, row_no, col_no, by_sheet, by_row, by_col, COUNT(*) OVER (PARTITION BY wb_id, sheet_idx, row_no, col_no) AS total, FALSE AS truncated FROM h""")
def _(v):
    return P.dependents(P.implicit_intersection(v.refs), v.refs)


@query("p18_uncached_ratio", "grid", """
SELECT wb_id, COUNT(CASE WHEN style_id < 6 THEN 1 END) AS formula_cells, COUNT(CASE WHEN style_id < 6 AND (v_num = 0 OR v_num > 60000) THEN 1 END) AS uncached,
 ROUND(COUNT(CASE WHEN style_id < 6 AND (v_num = 0 OR v_num > 60000) THEN 1 END) / COUNT(CASE WHEN style_id < 6 THEN 1 END), 6) AS ratio,
 COUNT(CASE WHEN style_id < 6 AND (v_num = 0 OR v_num > 60000) THEN 1 END) / COUNT(CASE WHEN style_id < 6 THEN 1 END) >= 0.5 AS refused FROM grid GROUP BY wb_id""")
def _(v):
    return P.uncached_ratio(v.grid.withColumn("has_formula", F.col("style_id") < 6).withColumn("raw", F.when(~((F.col("v_num") == 0) | (F.col("v_num") > 60000)), F.col("v_num"))))


TASKS = """t AS (SELECT wb_id, sheet_idx, row_no, col_no, trim(regexp_replace(v_text, '^\\s+|\\s+$', '', 'g')) AS t FROM lt), f AS (SELECT * FROM t WHERE t <> ''),
l AS (SELECT wb_id, sheet_idx, row_no, col_no, t, FALSE AS joined FROM f UNION ALL SELECT wb_id, sheet_idx, row_no, MIN(col_no), string_agg(t, ' ' ORDER BY col_no, t), TRUE FROM f GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2),
h AS (SELECT *, 'label' AS kind FROM l WHERE regexp_matches(t, '(?i)^(task|question|requirements?)\\b') UNION ALL SELECT *, 'question' FROM l WHERE regexp_matches(t, '(?i)^q\\s*[0-9]+\\b')
 UNION ALL SELECT *, 'numbered' FROM l WHERE regexp_matches(t, '^[0-9]+\\s*[.)]\\s+') UNION ALL SELECT *, 'bullet' FROM l WHERE regexp_matches(t, '^[-*]\\s+')),
u AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, col_no, kind, t ORDER BY row_no, joined) AS k FROM h) q WHERE k = 1)"""
LINES = "lt AS (SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN v_text LIKE 'TBD%' THEN 'Task: ' || v_text WHEN v_text LIKE 'What%' THEN 'Q' || CAST(row_no AS VARCHAR) || ' ' || v_text WHEN v_text = 'END' THEN ' 3) finish' WHEN v_text LIKE 'rounded%' THEN '* ' || v_text ELSE v_text END AS v_text FROM text_cells)"


@query("p19_task_like_lines", "text_cells", f"""WITH {LINES}, {TASKS}
SELECT wb_id, sheet_idx, row_no, col_no, kind, joined, t, COUNT(*) OVER (PARTITION BY wb_id, sheet_idx) AS total, FALSE AS truncated FROM u""")
def _(v):
    t = F.col("v_text")
    text = (F.when(F.startswith(t, F.lit("TBD")), F.concat(F.lit("Task: "), t)).when(F.startswith(t, F.lit("What")), F.concat(F.lit("Q"), F.col("row_no").cast("string"), F.lit(" "), t))
            .when(t == "END", " 3) finish").when(F.startswith(t, F.lit("rounded")), F.concat(F.lit("* "), t)).otherwise(t))
    return P.task_like_lines(v.text_cells.withColumn("v_text", text))


# one more sheet with a long name in every workbook, mentioned by some texts
SHEETS20 = "sh AS (SELECT CAST(w.wb AS INT) AS wb_id, CAST(s.i AS INT) AS sheet_idx, CASE s.i WHEN 0 THEN 'Heon' WHEN 1 THEN 'key outputs' WHEN 2 THEN 'ring' WHEN 3 THEN 'TB' ELSE 'Whou thou' END AS sheet FROM (SELECT DISTINCT wb_id AS wb FROM text_cells) w, (SELECT UNNEST(range(0, 5)) AS i) s)"


def corpus_sheets(v):
    names = F.array(*[F.struct(F.lit(i).alias("sheet_idx"), F.lit(n).alias("sheet")) for i, n in enumerate(("Heon", "key outputs", "ring", "TB", "Whou thou"))])
    return v.text_cells.select("wb_id").distinct().select("wb_id", F.inline(names))


@query("p20_text_sheet_refs", "text_cells", f"""WITH {SHEETS20}, m AS (SELECT t.wb_id, t.sheet_idx, t.row_no, t.col_no, sh.sheet AS to_sheet, ROW_NUMBER() OVER (PARTITION BY t.wb_id, t.sheet_idx, t.row_no, t.col_no ORDER BY sh.sheet_idx) AS k
 FROM text_cells t JOIN sh ON sh.wb_id = t.wb_id AND sh.sheet_idx <> t.sheet_idx AND contains(lower(v_text), lower(sh.sheet))) SELECT wb_id, sheet_idx, row_no, col_no, to_sheet FROM m WHERE k = 1""")
def _(v):
    return P.text_sheet_refs(v.text_cells, corpus_sheets(v))


@query("p21_sheet_keywords", "text_cells", f"""WITH {SHEETS20},
src AS (SELECT wb_id, sheet_idx, sheet AS t, 3 AS w FROM sh UNION ALL SELECT wb_id, sheet_idx, v_text, 2 FROM text_cells WHERE col_no = 2 UNION ALL SELECT wb_id, sheet_idx, v_text, 1 FROM text_cells),
tk AS (SELECT wb_id, sheet_idx, w, UNNEST(regexp_split_to_array(lower(t), '[^a-z0-9]+')) AS word FROM src), al AS (SELECT * FROM tk WHERE length(word) >= 2 UNION ALL SELECT wb_id, sheet_idx, w, left(word, length(word) - 1) FROM tk WHERE length(word) > 3 AND word LIKE '%s'),
sm AS (SELECT wb_id, sheet_idx, word, SUM(w) AS weight FROM al GROUP BY 1, 2, 3)
SELECT wb_id, sheet_idx, word, CAST(weight AS BIGINT) AS weight FROM sm""")
def _(v):
    headers = v.text_cells.filter("col_no = 2").withColumnRenamed("v_text", "label")
    return P.sheet_keywords(corpus_sheets(v), headers, v.text_cells)


@query("p22_header_row", "grid", """
WITH u AS (SELECT wb_id, sheet_idx, MIN(row_no) AS r1, MIN(col_no) AS c1, LEAST(MIN(row_no) + 2, MAX(row_no)) AS r2 FROM grid GROUP BY 1, 2),
r AS (SELECT g.wb_id, g.sheet_idx, r1, c1, row_no, COUNT(*) AS n, COUNT(CASE WHEN style_id < 5 THEN 1 END) AS k FROM grid g JOIN u ON u.wb_id = g.wb_id AND u.sheet_idx = g.sheet_idx AND row_no BETWEEN r1 AND r2 GROUP BY 1, 2, 3, 4, 5)
SELECT wb_id, sheet_idx, r1, c1, MIN(row_no) AS header_row FROM r WHERE k >= GREATEST(1, FLOOR(0.6 * n)) GROUP BY 1, 2, 3, 4""")
def _(v):
    cells = v.grid.withColumn("is_text", F.col("style_id") < 5)
    return P.header_row(cells, used_range(cells))


@query("p23_sheet_dependencies", "formulas", f"""WITH {REFS} SELECT wb_id, own AS src, ref_sheet AS dst, COUNT(*) AS n_formulas FROM (SELECT DISTINCT wb_id, own, ref_sheet, sheet_idx, row_no, col_no FROM bounds WHERE NOT external AND ref_sheet <> own) q GROUP BY 1, 2, 3""")
def _(v):
    return P.sheet_dependencies(ref_rows(v), own_sheet())


@query("p24_properties_table", "grid sheets formulas ranges", f"""
WITH u AS (SELECT wb_id, sheet_idx, MIN(row_no) AS r1, MIN(col_no) AS c1, MAX(row_no) AS r2, MAX(col_no) AS c2, COUNT(*) AS n_cells, COUNT(v_err) AS n_errors, COUNT(DISTINCT style_id) AS n_styles FROM grid GROUP BY 1, 2),
f AS (SELECT wb_id, sheet_idx, COUNT(*) AS n_formulas, COUNT(CASE WHEN {MASK} LIKE '%[%]%!%' THEN 1 END) AS n_external FROM formulas GROUP BY 1, 2), m AS (SELECT wb_id, sheet_idx, COUNT(*) AS n_merges FROM ranges GROUP BY 1, 2)
SELECT s.wb_id, s.sheet_idx, sheet, state, zoom, chr(CAST(64 + c1 AS INT)) || CAST(r1 AS VARCHAR) || ':' || chr(CAST(64 + c2 AS INT)) || CAST(r2 AS VARCHAR) AS used, n_cells, n_errors, n_styles, n_formulas, n_external, n_merges
FROM sheets s JOIN u USING (wb_id, sheet_idx) JOIN f USING (wb_id, sheet_idx) JOIN m USING (wb_id, sheet_idx)""")
def _(v):
    return P.properties_table(v.sheets, v.grid, v.formulas, v.ranges)


@query("p25_scan_structure")
def _(v):
    cells = v.grid.withColumn("is_text", F.col("style_id") < 5).withColumn("type", F.when(F.col("v_err").isNotNull(), "string").otherwise("number"))
    return P.scan_structure(cells.withColumn("shown", F.coalesce("v_err", F.format_string("%.2f", F.col("v_num")))))
