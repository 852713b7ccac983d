"""The deterministic checks (C22-C100) and the verdict helpers (CR1-CR5)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import FIXTURES
from ..functions import formula as X
from ..functions import numfmt as N
from ..operators import checks as C
from ..operators import fused, graph
from ..operators.grid import paint_cols
from ..session import checkpointed
from . import query
from ..operators.features import painted_cells
from .feature_queries import CLASS, FAMILY, MASK, MEANING, OVERLAY, REFS, layers, own_sheet
from .grid_queries import PAINT

CELL = ["wb_id", "sheet_idx", "row_no", "col_no"]
SHEET_SQL = "'S' || CAST(sheet_idx AS VARCHAR(10))"
OUT = "wb_id, sheet, location, description, severity"


def a1(row, col):
    return f"chr(CAST(64 + {col} AS INT)) || CAST({row} AS VARCHAR(10))"


def at(ref):
    return f"'''' || {SHEET_SQL} || '''!' || {ref}"


def rects(source, key="why"):
    """Rectangles of the cells in ``source`` per sheet and key."""
    return f"""(SELECT wb_id, sheet_idx, {key}, c1, c2, MIN(row_no) AS r1, MAX(row_no) AS r2 FROM (
   SELECT *, row_no - ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, {key}, c1, c2 ORDER BY row_no) AS stack FROM (
    SELECT wb_id, sheet_idx, {key}, row_no, MIN(col_no) AS c1, MAX(col_no) AS c2 FROM (
     SELECT wb_id, sheet_idx, {key}, row_no, col_no, col_no - ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, {key}, row_no ORDER BY col_no) AS island FROM {source}) i
    GROUP BY wb_id, sheet_idx, {key}, row_no, island) j) l GROUP BY wb_id, sheet_idx, {key}, c1, c2, stack)"""


def rect_rows(source, why="why", severity="major"):
    ref = a1("r1", "c1") + " || CASE WHEN r1 = r2 AND c1 = c2 THEN '' ELSE ':' || " + a1("r2", "c2") + " END"
    return f"SELECT wb_id, {SHEET_SQL} AS sheet, {at(ref)} AS location, {why} AS description, '{severity}' AS severity FROM {rects(source)} rr"


def cell_rows(source, why, severity="major"):
    return f"SELECT wb_id, {SHEET_SQL} AS sheet, {at(a1('row_no', 'col_no'))} AS location, {why} AS description, '{severity}' AS severity FROM {source}"


# ---- 22
GAPS = "gaps AS (SELECT wb_id, sheet_idx, row_no, col_no FROM formulas WHERE text LIKE 'OFFSET(%' OR text LIKE 'TODAY(%')"
C22 = f"""WITH {GAPS}, err AS (SELECT g.wb_id, g.sheet_idx, g.row_no, g.col_no, v_err FROM grid g WHERE v_err IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM gaps p WHERE p.wb_id = g.wb_id AND p.sheet_idx = g.sheet_idx AND p.row_no = g.row_no AND p.col_no = g.col_no))
{cell_rows('err', "'shows ' || v_err")}"""


def c22(v):
    return C.formula_errors(v.grid, C.gap_cells(v.formulas, ["OFFSET", "TODAY"]))


@query("c22_formula_errors", "grid formulas", C22)
def _(v):
    return c22(v)[0]


# ---- 29
C29 = """WITH RECURSIVE e AS (SELECT a.wb_id, a.name AS src, b.name AS dst FROM names a JOIN names b ON b.wb_id = a.wb_id AND b.name = a.definition),
reach AS (SELECT wb_id, name FROM names WHERE hidden OR length(definition) % 3 = 0 UNION SELECT e.wb_id, e.dst FROM reach r JOIN e ON e.wb_id = r.wb_id AND e.src = r.name)
SELECT wb_id, 'Name Manager' AS sheet, 'Name Manager: ' || name AS location, CASE WHEN definition LIKE '%#REF!%' THEN 'broken' ELSE 'unused' END AS description, 'major' AS severity
FROM names n WHERE NOT hidden AND (definition LIKE '%#REF!%' OR NOT EXISTS (SELECT 1 FROM reach r WHERE r.wb_id = n.wb_id AND r.name = n.name))"""


def name_users(v):
    return v.names.filter("length(definition) % 3 = 0").select("wb_id", F.concat(F.lit("1+SUM("), F.upper("name"), F.lit(")")).alias("text"))


@query("c29_clean_names", "names", C29)
def _(v):
    return C.clean_names(v.names, name_users(v))


PLACED = "pl AS (SELECT wb_id, name, hidden, 'S' || CAST(length(definition) * 3 % 14 AS VARCHAR(9)) || '!$A$1' AS definition FROM names)"


@query("c29_missing_sheets", "names sheets", f"""WITH {PLACED}
SELECT wb_id, 'Name Manager' AS sheet, 'Name Manager: ' || name AS location, CASE WHEN EXISTS (SELECT 1 FROM sheets s WHERE s.wb_id = pl.wb_id AND s.sheet || '!$A$1' = pl.definition) THEN 'unused' ELSE 'broken' END AS description,
 'major' AS severity FROM pl WHERE NOT hidden""")
def _(v):
    placed = v.names.withColumn("definition", F.concat(F.lit("S"), (F.length("definition") * 3 % 14).cast("string"), F.lit("!$A$1")))
    return C.clean_names(placed, sheets=v.sheets)


# ---- 47: legends differ by workbook: definition, work in progress, denial
LEGEND = """said AS (SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN v_text = 'Yellow fill = key outputs' AND wb_id % 3 = 1 THEN 'Yellow = TBD items'
  WHEN v_text = 'Yellow fill = key outputs' AND wb_id % 3 = 2 THEN 'No yellow is used here' ELSE v_text END AS v_text FROM text_cells),
leg AS (SELECT wb_id % 10 AS wb_id, COUNT(CASE WHEN v_text = 'Yellow fill = key outputs' THEN 1 END) AS defines, COUNT(CASE WHEN v_text = 'Yellow = TBD items' THEN 1 END) AS wip FROM said GROUP BY 1),
yel AS (SELECT * FROM (SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN style_id >= 5 THEN 'TBD' WHEN v_num = 0 THEN 'Yellow sample' END AS v_text,
   LAG(col_no) OVER w AS lc, LEAD(col_no) OVER w AS rc FROM grid WHERE style_id IN (1, 5) WINDOW w AS (PARTITION BY wb_id, sheet_idx, row_no ORDER BY col_no)) q)"""
C47 = f"""WITH {LEGEND}, bad AS (SELECT y.*, CASE WHEN v_text = 'TBD' THEN 'placeholder under yellow' ELSE 'bright yellow without a legend' END AS why
 FROM yel y LEFT JOIN leg l ON l.wb_id = y.wb_id
 WHERE NOT (COALESCE(lc <> col_no - 1, TRUE) AND COALESCE(rc <> col_no + 1, TRUE) AND COALESCE(v_text = 'Yellow sample' OR EXISTS (SELECT 1 FROM yel z WHERE z.wb_id = y.wb_id AND z.sheet_idx = y.sheet_idx AND z.row_no = y.row_no AND z.v_text = 'Yellow sample' AND z.col_no - y.col_no IN (1, 2)), FALSE))
   AND (v_text = 'TBD' OR NOT (COALESCE(defines, 0) > 0 AND COALESCE(wip, 0) = 0)))
{cell_rows('bad', 'why')}"""


def c47(v):
    s = F.col("style_id")
    own = F.when(s >= 5, "TBD").when(F.col("v_num") == 0, "Yellow sample")
    cells = v.grid.select(*CELL, F.when(s == 1, "FFFF00").when(s == 5, "FFCC00").when(s == 6, "FFC000").when(s == 7, "FFFFCC").alias("fill_rgb"), own.alias("v_text"))
    t, k = F.col("v_text"), F.col("wb_id") % 3
    legend = t == "Yellow fill = key outputs"
    said = v.text_cells.withColumn("v_text", F.when(legend & (k == 1), "Yellow = TBD items").when(legend & (k == 2), "No yellow is used here").otherwise(t))
    said = said.withColumn("wb_id", (F.col("wb_id") % 10).cast("int")).withColumn("sheet_idx", F.lit(-1))
    labels = cells.filter("v_text = 'Yellow sample' and fill_rgb in ('FFFF00', 'FFCC00')").select(*CELL, "v_text")
    return C.yellow_fills(cells, said.select(*CELL, "v_text").unionByName(labels))


@query("c47_bright_yellow", "grid text_cells", C47)
def _(v):
    return c47(v)


@query("c47_legend_class", "text_cells", f"""WITH {LEGEND.split(', leg AS')[0].split(',' + chr(10) + 'leg AS')[0]}
SELECT wb_id, sheet_idx, row_no, col_no, CASE v_text WHEN 'Yellow = TBD items' THEN 'WIP' WHEN 'No yellow is used here' THEN 'NEGATED' WHEN 'Yellow fill = key outputs' THEN 'DEFINES' END AS says
FROM said WHERE v_text IN ('Yellow = TBD items', 'No yellow is used here', 'Yellow fill = key outputs')""")
def _(v):
    t, k = F.col("v_text"), F.col("wb_id") % 3
    legend = t == "Yellow fill = key outputs"
    said = v.text_cells.withColumn("v_text", F.when(legend & (k == 1), "Yellow = TBD items").when(legend & (k == 2), "No yellow is used here").otherwise(t))
    return said.select(*CELL, C.legend_class(F.col("v_text")).alias("says")).filter("says is not null")


# ---- 49-51
FONT = """fam AS (SELECT cls.*, CASE font_rgb WHEN '000000' THEN 'black' WHEN '008000' THEN 'green' WHEN 'FF0000' THEN 'red' ELSE 'other' END AS family,
  CASE class WHEN 'OWN' THEN 'black' WHEN 'EXTERNAL' THEN 'red' ELSE 'green' END AS wanted FROM cls),
wrong AS (SELECT *, CASE wanted WHEN 'black' THEN 49 WHEN 'green' THEN 50 ELSE 51 END AS check_no, class || ' formula in ' || family || ' font, expected ' || wanted AS why FROM fam
 WHERE family <> wanted AND NOT (wanted = 'green' AND EXISTS (SELECT 1 FROM ranges x WHERE x.wb_id = fam.wb_id AND x.sheet_idx = fam.sheet_idx AND x.priority = 0
   AND fam.row_no BETWEEN x.r1 AND x.r2 AND fam.col_no BETWEEN x.c1 AND x.c2)))"""


def cf_colours(v):
    return v.ranges.withColumn("cf_rgb", F.when(F.col("priority") == 0, "00B050").otherwise("0000FF"))


def colours_wrong(v):
    return C.colour_mistakes(v.formulas, cf_colours(v))


for number, name in ((49, "c49_black_font"), (50, "c50_green_font"), (51, "c51_red_font")):
    @query(name, "formulas ranges", f"WITH {REFS}, {CLASS}, {FONT}, mine AS (SELECT * FROM wrong WHERE check_no = {number}) {rect_rows('mine')}")
    def _(v, number=number):
        return C.colour_check(colours_wrong(v), number)


# ---- 61, 62, 92
ZOOM = "zs AS (SELECT *, CASE WHEN sheet_idx = 7 AND wb_id % 2 = 0 THEN NULL WHEN wb_id % 5 = 3 THEN 100 ELSE zoom END AS z FROM sheets)"
C61 = f"""WITH {ZOOM}, lv AS (SELECT wb_id, z, COUNT(*) AS n, MIN(sheet_idx) AS f FROM zs WHERE z IS NOT NULL GROUP BY 1, 2),
md AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY wb_id ORDER BY n DESC, f) AS k FROM lv) q WHERE k = 1)
SELECT s.wb_id, s.sheet, s.sheet AS location, 'opens at ' || CAST(s.z AS VARCHAR(9)) || '%, most sheets at ' || CAST(md.z AS VARCHAR(9)) || '%' AS description, 'minor' AS severity
FROM zs s JOIN md ON md.wb_id = s.wb_id WHERE s.z <> md.z"""


def c61(v):
    zoom = F.when((F.col("sheet_idx") == 7) & (F.col("wb_id") % 2 == 0), None).when(F.col("wb_id") % 5 == 3, 100).otherwise(F.col("zoom"))
    return C.consistent_zoom(v.sheets.withColumn("zoom", zoom))


@query("c61_consistent_zoom", "sheets", C61)
def _(v):
    return c61(v)[0]


C62 = f"""WITH sel AS (SELECT wb_id, sheet_idx, row_no AS pos, CASE WHEN ref_key % 3 = 0 THEN 'topLeft' ELSE 'bottomRight' END AS pane,
   CASE WHEN ref_key % 4 = 0 THEN 'A1' ELSE {a1('col_no', 'col_no')} END AS cell FROM grid),
l AS (SELECT * FROM (SELECT sel.*, ROW_NUMBER() OVER (PARTITION BY sel.wb_id, sel.sheet_idx ORDER BY pos DESC, cell DESC) AS k FROM sel JOIN sheets s ON s.wb_id = sel.wb_id AND s.sheet_idx = sel.sheet_idx
   WHERE pane = CASE WHEN state = 'hidden' THEN 'topLeft' ELSE 'bottomRight' END) q WHERE k = 1)
SELECT wb_id, {SHEET_SQL} AS sheet, {at('cell')} AS location, 'active cell is not A1' AS description, 'minor' AS severity FROM l WHERE cell <> 'A1'"""


def c62(v):
    sel = v.grid.select(
        "wb_id", "sheet_idx", F.when(F.col("ref_key") % 3 == 0, "topLeft").otherwise("bottomRight").alias("pane"),
        F.when(F.col("ref_key") % 4 == 0, "A1").otherwise(C.a1.to_a1(F.col("col_no"), F.col("col_no"))).alias("active_cell"), F.col("row_no"))
    sel = sel.withColumn("pos", F.struct("row_no", "active_cell"))
    sheets = v.sheets.withColumn("active_pane", F.when(F.col("state") == "hidden", "topLeft").otherwise("bottomRight"))
    return C.active_cell_a1(sheets, sel)


@query("c62_active_cell", "grid sheets", C62)
def _(v):
    return c62(v)


C92 = "SELECT wb_id, sheet, sheet AS location, 'sheet is ' || state AS description, 'major' AS severity FROM sheets WHERE state <> 'visible'"


@query("c92_hidden_sheets", "sheets", C92)
def _(v):
    return C.hidden_sheets(v.sheets)


# ---- 65, 66, 94
C65 = f"""WITH {MEANING}, neg AS (SELECT g.*, 'negative shown ' || negative AS why FROM grid g JOIN formats USING (style_id) JOIN meaning USING (fmt_code)
 WHERE v_num <= -1e-6 AND v_err IS NULL AND negative IN ('minus', 'unsigned', 'mixed')) {rect_rows('neg')}"""
C66 = f"""WITH {MEANING}, z AS (SELECT g.*, 'zero shown as ' || zero AS why FROM grid g JOIN formats USING (style_id) JOIN meaning USING (fmt_code)
 JOIN sheets s ON s.wb_id = g.wb_id AND s.sheet_idx = g.sheet_idx
 WHERE v_num = 0 AND v_err IS NULL AND zero IN ('digit', 'text') AND NOT (state = 'hidden' AND n_sections < 3)) {rect_rows('z')}"""


def formatted(v):
    return v.grid.join(v.formats, "style_id")


def c65(v):
    return C.shown_negatives(formatted(v))


def c66(v):
    show = v.sheets.select("wb_id", "sheet_idx", (F.col("state") != "hidden").alias("show_zeros"))
    return C.shown_zeros(formatted(v).join(show, ["wb_id", "sheet_idx"]))


@query("c65_negative_parentheses", "grid formats", C65)
def _(v):
    return c65(v)


@query("c66_zero_dashes", "grid formats sheets", C66)
def _(v):
    return c66(v)


# the format a conditional format paints over a cell decides
for number, name, source in ((65, "c65_under_conditional_formats", C65), (66, "c66_under_conditional_formats", C66)):
    sql = source.replace(f"WITH {MEANING}", f"WITH {OVERLAY}, {MEANING}, own AS (SELECT g.* EXCLUDE (style_id), COALESCE(o.fmt_code, f.fmt_code) AS fmt_code FROM grid g JOIN formats f USING (style_id) "
                         "LEFT JOIN over o ON o.wb_id = g.wb_id AND o.sheet_idx = g.sheet_idx AND o.row_no = g.row_no AND o.col_no = g.col_no)").replace("FROM grid g JOIN formats USING (style_id) JOIN meaning", "FROM own g JOIN meaning")

    @query(name, "grid formats ranges" + (" sheets" if number == 66 else ""), sql)
    def _(v, number=number):
        cells = painted_cells(formatted(v), layers(v), ["fmt_code"])
        if number == 65:
            return C.shown_negatives(cells)
        show = v.sheets.select("wb_id", "sheet_idx", (F.col("state") != "hidden").alias("show_zeros"))
        return C.shown_zeros(cells.join(show, ["wb_id", "sheet_idx"]))


# colour pairs of known outcome: white on white, grey on black and yellow on white conceal
C94 = f"""WITH {MEANING}, pal AS (SELECT * FROM (VALUES (0, 'FFFFFF', 'FFFFFF', TRUE), (1, '000000', 'FFFFFF', FALSE), (2, 'FFFF00', 'FFFFFF', TRUE), (3, 'FF0000', 'FFFFFF', FALSE)) AS t(k, text_rgb, bg_rgb, conceals)),
x AS (SELECT g.*, CASE WHEN conceals THEN 'text the colour of its background' WHEN nothing THEN 'number format prints nothing' END AS why
 FROM grid g JOIN formats USING (style_id) JOIN meaning USING (fmt_code) JOIN pal ON pal.k = g.ref_key % 4), y AS (SELECT * FROM x WHERE why IS NOT NULL) {rect_rows('y')}"""


def c94(v):
    k = F.col("ref_key") % 4
    text = F.when(k == 0, "FFFFFF").when(k == 1, "000000").when(k == 2, "FFFF00").otherwise("FF0000")
    return C.concealed_cells(formatted(v).withColumn("text_rgb", text).withColumn("bg_rgb", F.lit("FFFFFF")))


@query("c94_concealment", "grid formats", C94)
def _(v):
    return c94(v)


# ---- 69, 70, 73, 93
COLS = "cols AS (SELECT wb_id, sheet_idx, col_no, 3.0::DOUBLE + MAX(ref_key) % 12 AS width FROM grid GROUP BY 1, 2, 3)"


def columns(v):
    return v.grid.groupBy("wb_id", "sheet_idx", "col_no").agg((F.max("ref_key") % 12 + 3.0).alias("width"))


PX = "FLOOR((256 * width + 18) / 256 * 7)"
C69N = f"""WITH {COLS}, n AS (SELECT g.wb_id, g.sheet_idx, row_no, col_no, printf('%.2f', v_num) AS s, width, 'x' AS why FROM grid g JOIN cols USING (wb_id, sheet_idx, col_no)),
b AS (SELECT * FROM n WHERE (0.507 * (length(s) - length(regexp_replace(s, '[0-9]', '', 'g'))) + 0.251 * (CASE WHEN s LIKE '%.%' THEN 1 ELSE 0 END) + 0.306 * (CASE WHEN s LIKE '-%' THEN 1 ELSE 0 END)) * (11 * 96.0 / 72) - ({PX} - 5) > 2)
{rect_rows('b', "'column too narrow for its number'")}"""


@query("c69_narrow_numbers", "grid", C69N)
def _(v):
    return C.narrow_number_cells(v.grid.withColumn("shown", F.format_string("%.2f", F.col("v_num"))), columns(v))


FONTS = "VALUES (0, 'Arial', 10.0, FALSE, 0.556, 0.278, 0.333), (1, 'Courier New', 12.0, TRUE, 0.6, 0.6, 0.6), (2, 'Carlito', 11.0, FALSE, 0.507, 0.251, 0.306), (3, 'Verdana', 9.0, FALSE, 0.636, 0.364, 0.454)"
C69F = f"""WITH {COLS}, fonts AS (SELECT * FROM ({FONTS}) AS t(k, face, size, bold, digit, point, dash)),
n AS (SELECT g.wb_id, g.sheet_idx, row_no, col_no, printf('%.2f', v_num) AS s, width, 'x' AS why, size, digit, point, dash FROM grid g JOIN cols USING (wb_id, sheet_idx, col_no) JOIN fonts ON k = style_id % 4 WHERE style_id <> 7),
b AS (SELECT * FROM n WHERE (digit * (length(s) - length(regexp_replace(s, '[0-9]', '', 'g'))) + point * (CASE WHEN s LIKE '%.%' THEN 1 ELSE 0 END) + dash * (CASE WHEN s LIKE '-%' THEN 1 ELSE 0 END)) * (size * 96.0 / 72) - ({PX} - 5) > 2)
{rect_rows('b', "'column too narrow for its number'")}"""


@query("c69_numbers_in_own_fonts", "grid", C69F)
def _(v):
    k = F.col("style_id") % 4
    font = lambda *x: F.element_at(F.array(*[F.lit(i) for i in x]), (k + 1).cast("int"))
    cells = v.grid.select(*CELL, F.format_string("%.2f", F.col("v_num")).alias("shown"), font("Arial", "Courier New", "Carlito", "Verdana").alias("face"), font(10.0, 12.0, 11.0, 9.0).alias("size"),
                          font(False, True, False, False).alias("bold"), (F.col("style_id") == 7).alias("shrink"))
    return C.narrow_number_cells(cells, columns(v))


CHARW = """list_sum(list_transform(string_split(v_text, ''), lambda c: CASE WHEN contains(' .,:;''|!il`', c) THEN 0.5 WHEN contains('$%()-+/\\[]{}"*^tfrjI', c) THEN 0.7 WHEN contains('@#&mwMW', c) THEN 1.3
  WHEN regexp_matches(c, '\\p{Lu}') THEN 1.1 WHEN regexp_matches(c, '\\p{Nd}') THEN 1.0 ELSE 0.9 END))"""
LABELS = """lab AS (SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN v_num > 20000 OR v_num < 0 THEN 'Customer ' || CAST(ref_key AS VARCHAR(9)) || CASE WHEN v_num < 0 THEN ' owed' ELSE '' END ELSE 'ok' END AS v_text FROM grid)"""


def labels(v):
    text = F.concat(F.lit("Customer "), F.col("ref_key").cast("string"), F.when(F.col("v_num") < 0, " owed").otherwise(""))
    return v.grid.select(*CELL, F.when((F.col("v_num") > 20000) | (F.col("v_num") < 0), text).otherwise("ok").alias("v_text"))


C69C = f"""WITH {COLS}, {LABELS}, nx AS (SELECT *, LEAD(col_no) OVER (PARTITION BY wb_id, sheet_idx, row_no ORDER BY col_no) AS stop FROM lab),
u AS (SELECT *, (SELECT SUM({PX}) FROM cols k WHERE k.wb_id = nx.wb_id AND k.sheet_idx = nx.sheet_idx AND k.col_no >= nx.col_no AND k.col_no < nx.stop) AS room FROM nx WHERE stop IS NOT NULL),
b AS (SELECT * FROM u WHERE {CHARW} * 7 - (room - 5) > 2) {cell_rows('b', "'text cut off by its neighbour'")}"""


@query("c69_cut_off_text", "grid", C69C)
def _(v):
    return C.cut_off_text(labels(v), columns(v))


# only one paragraph and no word over the width: the wrap itself is checked in x16
ROWS = "hts AS (SELECT wb_id, sheet_idx, row_no, 15.0::DOUBLE * (1 + MAX(length(v_text)) % 9) AS height, MAX(length(v_text)) % 4 <> 0 AS custom FROM text_cells GROUP BY 1, 2, 3)"


def row_heights(v):
    n = F.max(F.length("v_text"))
    return v.text_cells.groupBy("wb_id", "sheet_idx", "row_no").agg((F.lit(15.0) * (1 + n % 9)).alias("height"), (n % 4 != 0).alias("custom"))


def wrap_columns(v):
    """Columns with room for the 60 digits at which the SQL wraps."""
    return v.text_cells.select("wb_id", "sheet_idx", "col_no").distinct().withColumn("width", F.lit(60.7))


WRAP = """p AS (SELECT wb_id, sheet_idx, row_no, col_no, UNNEST(string_split(v_text, chr(10))) AS para FROM text_cells),
w AS (SELECT *, list_transform(string_split(para, ' '), lambda word: {'l': 0, 'c': CAST(list_sum(list_transform(string_split(word, ''), lambda c: CASE WHEN contains(' .,:;''|!il`', c) THEN 0.5 WHEN contains('$%()-+/\\[]{}"*^tfrjI', c) THEN 0.7 WHEN contains('@#&mwMW', c) THEN 1.3
  WHEN regexp_matches(c, '\\p{Lu}') THEN 1.1 WHEN regexp_matches(c, '\\p{Nd}') THEN 1.0 ELSE 0.9 END)) AS DOUBLE)}) AS ws FROM p),
ln AS (SELECT wb_id, sheet_idx, row_no, col_no, SUM(list_reduce(ws, lambda a, x: CASE WHEN a.c > 0 AND a.c + 0.5 + COALESCE(x.c, 0) <= 60.000001 THEN {'l': a.l, 'c': a.c + 0.5 + COALESCE(x.c, 0)}
   ELSE {'l': a.l + CASE WHEN a.c > 0 THEN 1 ELSE 0 END, 'c': COALESCE(x.c, 0)} END, {'l': 1, 'c': CAST(0 AS DOUBLE)}).l) AS lines FROM w GROUP BY 1, 2, 3, 4)"""


C69W = f"""WITH {ROWS}, {WRAP}, b AS (SELECT ln.* FROM ln JOIN hts USING (wb_id, sheet_idx, row_no) WHERE custom AND lines * 14.3 - height > 7.15)
{cell_rows('b', "'wrapped text taller than its row'")}"""


@query("c69_short_wrapped_rows", "text_cells", C69W)
def _(v):
    return C.short_wrapped_rows(v.text_cells, row_heights(v), wrap_columns(v))


C73 = f"""WITH {ROWS}, {WRAP}
SELECT h.wb_id, 'S' || CAST(h.sheet_idx AS VARCHAR(9)) AS sheet, '''S' || CAST(h.sheet_idx AS VARCHAR(9)) || '''!' || CAST(h.row_no AS VARCHAR(9)) || ':' || CAST(h.row_no AS VARCHAR(9)) AS location,
 'row taller than its content needs' AS description, 'minor' AS severity FROM hts h LEFT JOIN (SELECT wb_id, sheet_idx, row_no, MAX(lines) AS lines FROM ln GROUP BY 1, 2, 3) t USING (wb_id, sheet_idx, row_no) WHERE custom AND height > 60 AND height > 2 * COALESCE(lines, 1) * 14.3"""


@query("c73_row_heights", "text_cells", C73)
def _(v):
    return C.tall_rows(row_heights(v), v.text_cells, wrap_columns(v))


WIDE_PAINT = PAINT.replace("FROM intervals)", "FROM iv)").replace("FROM intervals ", "FROM iv ").replace("WITH cuts", "WITH iv AS (SELECT sheet_key, seq, lo, hi, width * 4 AS width, hidden, outline_level FROM intervals), cuts")
RUNS = """rn AS (SELECT sheet_key, MIN(seg_lo) AS first, MAX(seg_hi) AS last, MAX(width) AS width, MAX(seg_hi) - MIN(seg_lo) + 1 AS n FROM (
  SELECT *, SUM(new) OVER (PARTITION BY sheet_key ORDER BY seg_lo) AS run FROM (SELECT *, CASE WHEN LAG(seg_hi) OVER w = seg_lo - 1 AND LAG(width) OVER w = width THEN 0 ELSE 1 END AS new
   FROM painted WINDOW w AS (PARTITION BY sheet_key ORDER BY seg_lo)) a) b GROUP BY sheet_key, run)"""


C70 = f"""{WIDE_PAINT}, {RUNS},
need AS (SELECT sheet_key, lo AS col, MAX(CAST(seq % 60 AS DOUBLE)) AS need FROM intervals GROUP BY 1, 2),
jn AS (SELECT rn.*, COALESCE((SELECT MAX(need) FROM need k WHERE k.sheet_key = rn.sheet_key AND k.col BETWEEN rn.first AND rn.last), 0) AS need,
  (SELECT l.width FROM rn l WHERE l.sheet_key = rn.sheet_key AND l.first < rn.first AND l.n >= 2 AND l.width >= 4 ORDER BY l.first DESC LIMIT 1) AS lw,
  (SELECT l.n FROM rn l WHERE l.sheet_key = rn.sheet_key AND l.first < rn.first AND l.n >= 2 AND l.width >= 4 ORDER BY l.first DESC LIMIT 1) AS lc,
  (SELECT l.width FROM rn l WHERE l.sheet_key = rn.sheet_key AND l.first > rn.first AND l.n >= 2 AND l.width >= 4 ORDER BY l.first LIMIT 1) AS rw,
  (SELECT l.n FROM rn l WHERE l.sheet_key = rn.sheet_key AND l.first > rn.first AND l.n >= 2 AND l.width >= 4 ORDER BY l.first LIMIT 1) AS rc FROM rn),
wy AS (SELECT sheet_key, first, last, width, need, CASE WHEN width > 80 AND width > 2 * need THEN 'wider than the cap'
  WHEN n >= 2 AND width >= 2.5 * lw AND width >= 2.5 * rw AND n <= GREATEST(lc, rc) AND need < 0.5 * width THEN 'wide outlier' END AS why FROM jn)
SELECT * FROM wy WHERE why IS NOT NULL"""


def wide(v):
    segments = paint_cols(v.intervals.withColumn("width", F.col("width") * 4))
    need = v.intervals.groupBy("sheet_key", F.col("lo").alias("col")).agg(F.max((F.col("seq") % 60).cast("double")).alias("need"))
    return C.wide_columns(segments, need)


@query("c70_column_widths", "intervals", C70)
def _(v):
    return wide(v)


C93 = f"""{PAINT}, lv AS (SELECT p.*, l.level FROM painted p JOIN (VALUES (1), (2)) l(level) ON l.level <= p.outline_level),
gr AS (SELECT *, SUM(new) OVER (PARTITION BY sheet_key, level ORDER BY seg_lo) AS g FROM (SELECT *, CASE WHEN LAG(seg_hi) OVER (PARTITION BY sheet_key, level ORDER BY seg_lo) = seg_lo - 1 THEN 0 ELSE 1 END AS new FROM lv) a),
ok AS (SELECT gr.sheet_key, gr.seg_lo FROM gr JOIN (SELECT sheet_key, level, g FROM gr GROUP BY 1, 2, 3 HAVING bool_and(hidden)) w USING (sheet_key, level, g) WHERE gr.level = gr.outline_level),
bd AS (SELECT * FROM painted p WHERE hidden AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.sheet_key = p.sheet_key AND ok.seg_lo = p.seg_lo))
SELECT sheet_key, MIN(seg_lo) AS first, MAX(seg_hi) AS last FROM (SELECT *, SUM(new) OVER (PARTITION BY sheet_key ORDER BY seg_lo) AS run FROM (
 SELECT *, CASE WHEN LAG(seg_hi) OVER (PARTITION BY sheet_key ORDER BY seg_lo) = seg_lo - 1 THEN 0 ELSE 1 END AS new FROM bd) a) b GROUP BY sheet_key, run"""


def hidden(v):
    return C.hidden_segments(paint_cols(v.intervals))


@query("c93_hidden_columns", "intervals", C93)
def _(v):
    return hidden(v)


# ---- 74, 77
C74 = f"""WITH m AS (SELECT r.*, CASE WHEN sheet_idx = 0 THEN 'Instructions' ELSE {SHEET_SQL} END AS sh FROM ranges r)
SELECT wb_id, sh AS sheet, {at(a1('r1', 'c1') + " || ':' || " + a1('r2', 'c2'))} AS location, 'merged cells' AS description, 'minor' AS severity FROM m WHERE sh <> 'Instructions' AND (r1 <> r2 OR c1 <> c2)"""


def c74(v):
    return C.merged_cells(v.ranges.withColumn("sheet", F.when(F.col("sheet_idx") == 0, "Instructions").otherwise(own_sheet())))


@query("c74_merged_cells", "ranges", C74)
def _(v):
    return c74(v)


C77 = """
WITH f AS (SELECT page_id AS wb_id, 'model_' || CAST(page_id AS VARCHAR(9)) || CASE page_id % 5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xlsm' WHEN 3 THEN '.xls' ELSE '.csv' END AS file_name,
  CASE WHEN length(html) % 3 = 2 THEN 'text' WHEN length(html) % 3 = 1 THEN 'ole2' ELSE 'zip' END AS kind, length(html) % 2 = 0 AS has_macros, page_id % 5 AS e FROM pages),
w AS (SELECT *, CASE WHEN e >= 3 THEN 'not an Excel workbook name' WHEN kind <> 'zip' THEN 'content is ' || kind WHEN e < 2 AND has_macros THEN 'macros in an .xlsx' WHEN e = 2 AND NOT has_macros THEN 'no macros in an .xlsm' END AS why FROM f)
SELECT wb_id, '' AS sheet, file_name AS location, why AS description, 'major' AS severity FROM w WHERE why IS NOT NULL"""


def files(v):
    e, n = F.col("page_id") % 5, F.length("html")
    ext = F.when(e == 0, ".xlsx").when(e == 1, ".XLSX").when(e == 2, ".xlsm").when(e == 3, ".xls").otherwise(".csv")
    head = (F.when(n % 3 == 2, F.encode("html", "UTF-8")).when(n % 3 == 1, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.encode("html", "UTF-8")))
            .otherwise(F.concat(F.unhex(F.lit("504B0304")), F.encode("html", "UTF-8"))))
    return v.pages.select(F.col("page_id").alias("wb_id"), F.concat(F.lit("model_"), F.col("page_id").cast("string"), ext).alias("file_name"),
                           head.alias("head"), (n % 2 == 0).alias("has_macros"))


@query("c77_file_extension", "", C77)
def _(v):
    return C.file_extensions(files(v))


# ---- 80, 87, 95
C80 = f"""WITH {REFS}, prec AS (SELECT DISTINCT wb_id, lower(ref_sheet) AS sk, r1, c1, r2, c2 FROM bounds WHERE NOT external),
st AS (SELECT * FROM formulas WHERE text = 'TODAY()'),
bad AS (SELECT wb_id, sheet_idx, row_no, col_no, 'calls OFFSET' AS why FROM formulas WHERE text LIKE 'OFFSET(%'
 UNION ALL SELECT wb_id, sheet_idx, row_no, col_no, 'calls TODAY' FROM st WHERE EXISTS (SELECT 1 FROM prec p WHERE p.wb_id = st.wb_id AND p.sk = 's' || CAST(st.sheet_idx AS VARCHAR(9)) AND row_no BETWEEN r1 AND r2 AND col_no BETWEEN c1 AND c2))
{rect_rows('bad')}"""


@query("c80_volatile", "formulas", C80)
def _(v):
    return C.volatile_cells(v.formulas)


SITES = f"""site AS (SELECT wb_id, {SHEET_SQL} AS sheet, {a1('row_no', 'col_no')} AS ref, 'cell' AS site, text FROM formulas
 UNION ALL SELECT wb_id, 'Name Manager', name, 'name', CASE WHEN hidden THEN '[2]Book!A1' ELSE definition || ':C:C' END FROM names
 UNION ALL SELECT wb_id, {SHEET_SQL}, {a1('r1', 'c1')} || CASE WHEN r1 = r2 AND c1 = c2 THEN '' ELSE ':' || {a1('r2', 'c2')} END, 'conditional format', CASE priority WHEN 0 THEN 'SUM($D:$D)>0' WHEN 1 THEN '[1]Rates!A1>0' ELSE 'A1>0' END FROM ranges)"""


def sites(v):
    names = v.names.withColumn("definition", F.when(F.col("hidden"), "[2]Book!A1").otherwise(F.concat(F.lit("SUM(C:C)+"), "definition")))
    rules = v.ranges.withColumn("text", F.when(F.col("priority") == 0, "SUM($D:$D)>0").when(F.col("priority") == 1, "[1]Rates!A1>0").otherwise("A1>0"))
    return C.formula_sites(v.formulas, names, rules)


SITE_AT = "CASE WHEN sheet = 'Name Manager' THEN '''Name Manager''!' ELSE '''' || sheet || '''!' END || ref"


REACH = C29.split("SELECT wb_id, 'Name Manager'")[0]


@query("c87_whole_columns", "formulas names ranges", f"""{REACH}, {SITES}
SELECT wb_id, sheet, {SITE_AT} AS location, site || ' reads a whole column or row' AS description, 'minor' AS severity FROM site WHERE (site <> 'name' AND (text LIKE '%B:B%' OR text LIKE '%$D:$D%'))
 OR (site = 'name' AND text LIKE '%:C:C' AND EXISTS (SELECT 1 FROM reach r WHERE r.wb_id = site.wb_id AND r.name = site.ref))""")
def _(v):
    return C.whole_column_sites(sites(v), C.used_names(v.names, name_users(v)))


@query("c95_external_links", "formulas names ranges", f"""WITH {SITES}
SELECT wb_id, sheet, {SITE_AT} AS location, site || ' reads another workbook' AS description, 'major' AS severity FROM site WHERE text LIKE '[%' AND wb_id NOT IN (SELECT wb_id FROM grid WHERE v_num > 104700)
UNION ALL SELECT CAST(s_suppkey % 50 AS INT), '', s_name, 'external link declared', 'major' FROM supplier WHERE s_suppkey % 50 NOT IN (SELECT wb_id FROM grid WHERE v_num > 104700)""")
def _(v):
    links = v.supplier.select((F.col("s_suppkey") % 50).cast("int").alias("wb_id"), F.col("s_name").alias("target"))
    return C.external_sites(sites(v), links, v.grid.filter("v_num > 104700"))


# ---- 100
CLOSURE = """WITH RECURSIVE reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst),
cyc AS (SELECT src AS node FROM reach WHERE src = dst),
comp AS (SELECT a.src AS node, MIN(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src)"""


def cyclic_cells(v):
    """Cells on a cycle; twenty to a workbook, which no edge leaves."""
    return graph.cyclic_nodes(v.edges, piece=F.floor(F.col("src") / 20))


@query("c100_cycles", "edges", CLOSURE + " SELECT node, component FROM comp")
def _(v):
    found = cyclic_cells(v)
    smallest = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(smallest, "component").select("node", F.col("least").alias("component"))


CALC = "books AS (SELECT wb_id, CASE WHEN wb_id % 7 = 0 THEN 'manual' ELSE 'auto' END AS calc_mode, wb_id % 2 = 0 AS iterate FROM (SELECT DISTINCT CAST(FLOOR(l_partkey / 20) AS BIGINT) AS wb_id FROM lineitem) b)"


@query("c100_calculation_mode", "edges", CLOSURE + f""", {CALC}, cw AS (SELECT DISTINCT CAST(FLOOR(node / 20) AS BIGINT) AS wb_id FROM cyc)
SELECT b.wb_id, CASE WHEN calc_mode = 'manual' THEN 'fail' WHEN cw.wb_id IS NULL THEN 'pass' WHEN iterate THEN 'undecided' ELSE 'fail' END AS decision, cw.wb_id IS NOT NULL AS cycle
FROM books b LEFT JOIN cw ON cw.wb_id = b.wb_id""")
def _(v):
    wb = F.floor(F.col("l_partkey") / 20)
    books = v.lineitem.select(wb.alias("wb_id")).distinct().select(
        "wb_id", F.when(F.col("wb_id") % 7 == 0, "manual").otherwise("auto").alias("calc_mode"), (F.col("wb_id") % 2 == 0).alias("iterate"))
    return C.calculation_mode(books, cyclic_cells(v).select(F.floor(F.col("node") / 20).alias("wb_id")))


@query("c100_circular_cells")
def _(v):
    return C.circular_cells(v.formulas)


# ---- CR1-CR5
REGISTRY = C.Registry()
REGISTRY.add(22, lambda v: C.make_verdict(v.sheets, c22(v)[0], 22, undecided=c22(v)[1]))
REGISTRY.add(47, lambda v: C.make_verdict(v.sheets, c47(v), 47))
REGISTRY.add(49, lambda v: C.make_verdict(v.sheets, C.colour_check(colours_wrong(v), 49), 49))
REGISTRY.add(50, lambda v: C.make_verdict(v.sheets, C.colour_check(colours_wrong(v), 50), 50))
REGISTRY.add(51, lambda v: C.make_verdict(v.sheets, C.colour_check(colours_wrong(v), 51), 51))
REGISTRY.add(61, lambda v: C.make_verdict(v.sheets, c61(v)[0], 61, undecided=c61(v)[1]))
REGISTRY.add(62, lambda v: C.make_verdict(v.sheets, c62(v), 62))
REGISTRY.add(65, lambda v: C.make_verdict(v.sheets, c65(v), 65))
REGISTRY.add(66, lambda v: C.make_verdict(v.sheets, c66(v), 66))
REGISTRY.add(74, lambda v: C.make_verdict(v.sheets, c74(v), 74))
REGISTRY.add(80, lambda v: C.make_verdict(v.sheets, C.volatile_cells(v.formulas), 80))
REGISTRY.add(92, lambda v: C.make_verdict(v.sheets, C.hidden_sheets(v.sheets), 92))
REGISTRY.add(94, lambda v: C.make_verdict(v.sheets, c94(v), 94))


def verdict_sql(number, found, open_sql=None):
    und = f"WHEN wb_id IN ({open_sql}) THEN 'undecided'" if open_sql else ""
    return f"""SELECT wb_id, {number} AS check_no, CASE WHEN n > 0 THEN 'fail' {und} ELSE 'pass' END AS decision, n AS n_mistakes, n AS n_listed, FALSE AS truncated,
 CASE WHEN n > 0 THEN NULL {und.replace("'undecided'", "'left to the judge'")} END AS llm_note
 FROM (SELECT b.wb_id, COUNT(m.wb_id) AS n FROM (SELECT DISTINCT wb_id FROM sheets) b LEFT JOIN ({found}) m ON m.wb_id = b.wb_id GROUP BY b.wb_id) q"""


OPEN22 = "SELECT wb_id FROM grid WHERE v_err IS NOT NULL"
OPEN61 = f"WITH {ZOOM} SELECT wb_id FROM zs GROUP BY wb_id HAVING COUNT(*) > 1 AND COUNT(z) < COUNT(*)"

# ---- CR1: what the cells of a workbook hold beside their numbers, in one relation
WIDE = FIXTURES["formulas"].replace("SELECT wb_id,", "SELECT v_num, v_err, style_id, ref_key, wb_id,", 1)
WIDTH = "cols AS (SELECT DISTINCT wb_id, sheet_idx, col_no, 3.0::DOUBLE + (wb_id + sheet_idx * 3 + col_no * 5) % 12 AS width FROM grid)"


def wide_cells(v):
    s = F.col("style_id")
    cells = v.derived("grid", WIDE)
    return cells.select(
        *CELL, "v_num", "v_err", "text", (s * 4 + F.col("ref_key") % 4).cast("int").alias("style_key"), F.when(s >= 5, "TBD").when(F.col("v_num") == 0, "Yellow sample").alias("v_text"),
        F.format_string("%.2f", F.col("v_num")).alias("shown"), ((F.col("wb_id") + F.col("sheet_idx") * 3 + F.col("col_no") * 5) % 12 + 3.0).alias("width"),
        ((F.col("wb_id") * 3 + F.col("sheet_idx")) % 7 != 0).alias("show_zeros"))


def wide_styles(v):
    """One style per format and text colour of the fixture."""
    s, k = F.col("style_id"), F.col("k")
    d = v.formats.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return d.select((s * 4 + k).alias("style_key"), "fmt_code", F.when(s == 1, "FFFF00").when(s == 5, "FFCC00").when(s == 6, "FFC000").when(s == 7, "FFFFCC").alias("fill_rgb"),
                    F.when(s == 1, "008000").when(s == 2, "FF0000").when(s == 3, "0000FF").otherwise("000000").alias("font_rgb"),
                    F.when(k == 0, "FFFFFF").when(k == 1, "000000").when(k == 2, "FFFF00").otherwise("FF0000").alias("text_rgb"), F.lit("FFFFFF").alias("bg_rgb"))


def run_all(v):
    """All 22 checks: cell checks from one pass over the cells, the others from their small relations, one after the other."""
    v = v.written("grid")
    hits = checkpointed(fused.cell_hits(wide_cells(v), wide_styles(v), ["OFFSET", "TODAY"]))
    t, k = F.col("v_text"), F.col("wb_id") % 3
    legend = t == "Yellow fill = key outputs"
    said = v.text_cells.withColumn("v_text", F.when(legend & (k == 1), "Yellow = TBD items").when(legend & (k == 2), "No yellow is used here").otherwise(t))
    said = said.select((F.col("wb_id") % 10).cast("int").alias("wb_id"), F.lit(-1).alias("sheet_idx"), "row_no", "col_no", "v_text")
    books = v.sheets.select("wb_id").distinct()
    sheet_of = lambda df, why: df.select((F.col("sheet_key") / 10).cast("int").alias("wb_id"), F.concat(F.lit("S"), (F.col("sheet_key") % 10).cast("string")).alias("sheet"),
                                         F.concat_ws(":", "first", "last").alias("location"), why.alias("description"), F.lit("minor").alias("severity"))
    used = checkpointed(C.used_names(v.names, name_users(v)))
    names = v.names.withColumn("definition", F.when(F.col("hidden"), "[2]Book!A1").otherwise(F.concat(F.lit("SUM(C:C)+"), "definition")))
    rules = v.ranges.withColumn("text", F.when(F.col("priority") == 0, "SUM($D:$D)>0").when(F.col("priority") == 1, "[1]Rates!A1>0").otherwise("A1>0"))
    other_sites = C.formula_sites(v.formulas.limit(0), names, rules)
    widths = v.grid.select("wb_id", "sheet_idx", "col_no").distinct().withColumn("width", (F.col("wb_id") + F.col("sheet_idx") * 3 + F.col("col_no") * 5) % 12 + 3.0)
    cycles = fused.workbooks_with_cycles(hits, v.formulas)
    modes = C.calculation_mode(books.withColumn("calc_mode", F.when(F.col("wb_id") % 7 == 0, "manual").otherwise("auto")).withColumn("iterate", F.col("wb_id") % 2 == 0), cycles)
    modes = checkpointed(modes)
    waived = books.filter("wb_id % 11 = 5")
    links = v.supplier.select((F.col("s_suppkey") % 50).cast("int").alias("wb_id"), F.col("s_name").alias("target"))
    by_cell = fused.cell_mistakes(hits, said, cf_colours(v)).join(waived.select("wb_id", F.lit(95).alias("check_no")), ["wb_id", "check_no"], "left_anti")
    zoom, zoom_open = c61(v)
    large = [(69, C.cut_off_text(labels(v), widths)), (70, sheet_of(wide(v), F.col("why"))), (93, sheet_of(hidden(v), F.lit("hidden columns")))]
    others = [
        (29, C.clean_names(v.names, name_users(v), used)), (61, zoom), (62, c62(v)),
        (69, C.short_wrapped_rows(v.text_cells, row_heights(v), wrap_columns(v))),
        (73, C.tall_rows(row_heights(v), v.text_cells, wrap_columns(v))), (74, c74(v)), (77, C.file_extensions(files(v))),
        (87, C.whole_column_sites(other_sites, used)), (92, C.hidden_sheets(v.sheets)),
        (95, C.external_sites(other_sites, links, waived)),
        (100, modes.filter("decision = 'fail'").select("wb_id", F.lit("").alias("sheet"), F.lit("").alias("location"), F.lit("calculation").alias("description"), F.lit("major").alias("severity")))]
    numbered = [fused.numbered(d.withColumn("wb_id", F.col("wb_id").cast("int")), n) for n, d in (*large, *others)]
    # those that shuffle all cells or all columns have the disks to themselves, the others share a step
    found = [by_cell.select("check_no", *C.MISTAKE), *numbered[:len(large)], reduce(DataFrame.unionByName, numbered[len(large):])]
    left_open = [fused.undecided_errors(hits), zoom_open.select("wb_id", F.lit(61).alias("check_no")), modes.filter("decision = 'undecided'").select("wb_id", F.lit(100).alias("check_no"))]
    return fused.verdicts(books, found, reduce(DataFrame.unionByName, left_open))


def in_books(sql):
    """SQL over sheet keys, by workbook: ten sheets each."""
    return f"SELECT CAST(FLOOR(sheet_key / 10) AS INT) AS wb_id FROM ({sql}) k"


SELF = "SELECT wb_id FROM formulas WHERE col_no = 1 AND text LIKE 'SUM(A1:A%'"
WAIVED = "wb_id % 11 <> 5"
FOUND = {
    22: C22, 29: C29, 47: C47, 61: C61, 62: C62, 65: C65, 66: C66, 70: in_books(C70), 73: C73, 74: C74, 77: C77, 80: C80, 92: C92, 93: in_books(C93), 94: C94,
    **{n: f"WITH {REFS}, {CLASS}, {FONT}, mine AS (SELECT * FROM wrong WHERE check_no = {n}) {rect_rows('mine')}" for n in (49, 50, 51)},
    69: " UNION ALL ".join(f"SELECT wb_id FROM ({q.replace(COLS, WIDTH)}) q{i}" for i, q in enumerate((C69N, C69C, C69W))),
    87: f"{REACH}, {SITES} SELECT wb_id FROM site WHERE (site <> 'name' AND (text LIKE '%B:B%' OR text LIKE '%$D:$D%')) OR (site = 'name' AND text LIKE '%:C:C' AND EXISTS (SELECT 1 FROM reach r WHERE r.wb_id = site.wb_id AND r.name = site.ref))",
    95: f"WITH {SITES} SELECT wb_id FROM site WHERE text LIKE '[%' AND {WAIVED} UNION ALL SELECT CAST(s_suppkey % 50 AS INT) AS wb_id FROM supplier WHERE s_suppkey % 50 % 11 <> 5",
    100: f"SELECT wb_id FROM (SELECT DISTINCT wb_id FROM sheets) b WHERE wb_id % 7 = 0 OR (wb_id % 2 <> 0 AND wb_id IN ({SELF}))"}
OPEN = {22: OPEN22, 61: OPEN61, 100: f"SELECT wb_id FROM ({SELF}) s WHERE wb_id % 2 = 0"}


@query("cr1_run_checks", "grid sheets formulas formats ranges text_cells names intervals", " UNION ALL ".join(verdict_sql(n, FOUND[n], OPEN.get(n)) for n in fused.NUMBERS))
def _(v):
    return run_all(v)


@query("cr2_make_verdict", "grid sheets formulas", verdict_sql(22, C22, OPEN22))
def _(v):
    return REGISTRY.run(v, [22])


@query("cr2_listed_mistakes", "grid formulas", f"SELECT wb_id, sheet, location, description, severity FROM ({C22}) m")
def _(v):
    return C.listed_mistakes(c22(v)[0])


@query("cr3_defaults_used", "grid formats", """
WITH n AS (SELECT CASE WHEN fmt_code = 'yyyy-mm-dd' THEN 'date_not_judged' WHEN fmt_code = 'General' THEN 'general_format' END AS kind,
  'S' || CAST(sheet_idx AS VARCHAR(9)) || '!' || chr(CAST(64 + col_no AS INT)) || CAST(row_no AS VARCHAR(9)) || '@' || CAST(wb_id AS VARCHAR(9)) AS example FROM grid JOIN formats USING (style_id))
SELECT kind, example, COUNT(*) OVER (PARTITION BY kind) AS n FROM n WHERE kind IS NOT NULL""")
def _(v):
    c = F.col("fmt_code")
    kind = F.when(N.is_date(c), "date_not_judged").when(N.is_general(c), "general_format")
    example = F.concat(own_sheet(), F.lit("!"), C.cell_ref(), F.lit("@"), F.col("wb_id").cast("string"))
    return C.defaults_used(formatted(v).select(kind.alias("kind"), example.alias("example")).filter("kind is not null"))


@query("cr4_gap_cells", "formulas", "SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN text LIKE 'OFFSET%' THEN 'OFFSET' ELSE 'TODAY' END AS lacking FROM formulas WHERE text LIKE 'OFFSET(%' OR text LIKE 'TODAY(%'")
def _(v):
    return C.gap_cells(v.formulas, ["OFFSET", "TODAY"])


@query("cr5_detect_writer", "", """
WITH w AS (SELECT c_custkey AS wb_id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'LibreOffice/7.4' WHEN 'MACHINERY' THEN 'XlsxWriter 3' WHEN 'BUILDING' THEN NULL ELSE 'Microsoft Excel' END AS application,
  CASE WHEN c_nationkey = 3 THEN '12.0000' WHEN c_nationkey = 4 THEN NULL ELSE '16.0300' END AS app_version FROM customer)
SELECT *, writer = 'excel' AS values_trusted FROM (SELECT *, CASE WHEN application LIKE 'Libre%' THEN 'libreoffice' WHEN application LIKE 'Xlsx%' OR (application = 'Microsoft Excel' AND app_version = '12.0000') THEN 'xlsxwriter'
 WHEN application = 'Microsoft Excel' AND app_version LIKE '16%' THEN 'excel' ELSE 'unknown' END AS writer FROM w) q""")
def _(v):
    s, n = F.col("c_mktsegment"), F.col("c_nationkey")
    books = v.customer.select(
        F.col("c_custkey").alias("wb_id"),
        F.when(s == "HOUSEHOLD", "LibreOffice/7.4").when(s == "MACHINERY", "XlsxWriter 3").when(s == "BUILDING", None).otherwise("Microsoft Excel").alias("application"),
        F.when(n == 3, "12.0000").when(n == 4, None).otherwise("16.0300").alias("app_version"))
    return C.detect_writer(books)
