"""X1-X18."""

from pyspark.sql import functions as F

from ..functions import colour as K
from ..functions import formula as X
from ..functions import numfmt as N
from ..functions import text as T
from ..operators import features as O
from ..operators import resolve as R
from . import query

CELL = ["wb_id", "sheet_idx", "row_no", "col_no"]
MASK = """regexp_replace(text, '"[^"]*"', '""', 'g')"""
REFS = f"""m AS (SELECT *, 'S' || CAST(sheet_idx AS VARCHAR(10)) AS own, {MASK} AS masked FROM formulas),
rx AS (SELECT wb_id, sheet_idx, row_no, col_no, own, text, font_rgb,
  UNNEST(list_distinct(regexp_extract_all(masked, '(?:[A-Za-z0-9_\\[\\]]+!)?(?:\\$?[A-Z]{{1,3}}\\$?[0-9]+(?::\\$?[A-Z]{{1,3}}\\$?[0-9]+)?|[A-Z]{{1,3}}:[A-Z]{{1,3}})'))) AS ref FROM m),
r AS (SELECT *, CASE WHEN ref LIKE '%!%' THEN split_part(ref, '!', 1) ELSE own END AS ref_sheet, replace(CASE WHEN ref LIKE '%!%' THEN split_part(ref, '!', 2) ELSE ref END, '$', '') AS body FROM rx),
b AS (SELECT *, split_part(body, ':', 1) AS pa, CASE WHEN body LIKE '%:%' THEN split_part(body, ':', 2) ELSE body END AS pb FROM r),
bounds AS (SELECT wb_id, sheet_idx, row_no, col_no, own, text, ref, ref_sheet, ref_sheet LIKE '%[%' AS external,
  COALESCE(TRY_CAST(regexp_extract(pa, '[0-9]+') AS INT), 1) AS r1, ord(regexp_extract(pa, '[A-Z]')) - 64 AS c1,
  COALESCE(TRY_CAST(regexp_extract(pb, '[0-9]+') AS INT), 1048576) AS r2, ord(regexp_extract(pb, '[A-Z]')) - 64 AS c2 FROM b)"""
CLASS = """cls AS (SELECT m.wb_id, m.sheet_idx, m.row_no, m.col_no, m.own, m.text, m.masked, m.font_rgb, CASE WHEN masked LIKE '%[%' THEN 'EXTERNAL'
  WHEN regexp_full_match(masked, '[A-Za-z0-9_]+![A-Z]+[0-9]+') AND split_part(masked, '!', 1) <> own THEN 'POINTER'
  WHEN regexp_extract(masked, '([A-Za-z0-9_]+)![A-Z]+[0-9]+', 1) NOT IN ('', own) THEN 'CROSS' ELSE 'OWN' END AS class FROM m)"""


def own_sheet():
    return F.concat(F.lit("S"), F.col("sheet_idx").cast("string"))


def ref_rows(v):
    return X.references(v.formulas, "text", own_sheet())


@query("x1_mask_strings", "formulas", f"SELECT wb_id, sheet_idx, row_no, col_no, {MASK} AS masked FROM formulas")
def _(v):
    return v.formulas.select(*CELL, X.mask_strings(F.col("text")).alias("masked"))


@query("x2_functions", "formulas", f"""
SELECT wb_id, sheet_idx, row_no, col_no, array_to_string(list_sort(list_distinct(regexp_extract_all({MASK}, '([A-Z][A-Z0-9_.]*)\\(', 1))), ',') AS functions FROM formulas""")
def _(v):
    return v.formulas.select(*CELL, F.array_join(X.functions_called(F.col("text")), ",").alias("functions"))


@query("x3_references", "formulas", f"WITH {REFS} SELECT wb_id, sheet_idx, row_no, col_no, ref, ref_sheet, external, r1, c1, r2, c2 FROM bounds")
def _(v):
    return ref_rows(v).select(*CELL, "ref", "ref_sheet", "external", "r1", "c1", "r2", "c2")


@query("x4_whole_refs", "formulas", f"SELECT wb_id, sheet_idx, row_no, col_no, regexp_matches({MASK}, '[A-Z]{{1,3}}:[A-Z]{{1,3}}|1048576') AS whole FROM formulas")
def _(v):
    return v.formulas.select(*CELL, X.has_whole_ref(F.col("text")).alias("whole"))


@query("x5_external", "formulas", f"SELECT wb_id, sheet_idx, row_no, col_no, {MASK} LIKE '%[%]%!%' AS external FROM formulas")
def _(v):
    return v.formulas.select(*CELL, X.is_external(F.col("text")).alias("external"))


@query("x6_formula_class", "formulas", f"WITH {REFS}, {CLASS} SELECT wb_id, sheet_idx, row_no, col_no, class FROM cls")
def _(v):
    return v.formulas.select(*CELL, X.formula_class(F.col("text"), own_sheet()).alias("class"))


# every name is defined for its workbook; names of even parts are defined again on one sheet
SCOPED = """sc AS (SELECT wb_id, name, CAST(NULL AS INT) AS scope FROM names
 UNION ALL SELECT wb_id, name, CAST(length(definition) % 5 AS INT) FROM names WHERE hidden),
uses AS (SELECT wb_id, name, CAST(length(name) % 5 AS INT) AS sheet_idx, definition || '+SUM(' || name || ')' AS text FROM names)"""


def scoped_names(v):
    whole = v.names.select("wb_id", "name", F.lit(None).cast("int").alias("scope"))
    local = v.names.filter("hidden").select("wb_id", "name", (F.length("definition") % 5).cast("int").alias("scope"))
    return whole.unionByName(local)


@query("x7_name_uses", "names", f"""WITH {SCOPED},
tok AS (SELECT DISTINCT wb_id, name, sheet_idx, UNNEST(regexp_extract_all(text, 'N_[0-9]+')) AS token FROM uses)
SELECT t.wb_id, t.name, t.sheet_idx, COALESCE(l.name, g.name) AS used_name, CASE WHEN l.name IS NOT NULL THEN t.sheet_idx END AS used_scope
FROM tok t LEFT JOIN sc l ON l.wb_id = t.wb_id AND l.name = t.token AND l.scope = t.sheet_idx LEFT JOIN sc g ON g.wb_id = t.wb_id AND g.name = t.token AND g.scope IS NULL
WHERE COALESCE(l.name, g.name) IS NOT NULL""")
def _(v):
    uses = v.names.select("wb_id", "name", (F.length("name") % 5).cast("int").alias("sheet_idx"),
                          F.concat("definition", F.lit("+SUM("), "name", F.lit(")")).alias("text"))
    return O.name_uses(uses, scoped_names(v), "text", ["wb_id", "name", "sheet_idx"])


BROKEN = "CASE WHEN style_id = 1 THEN text || ')' WHEN style_id = 2 THEN replace(text, 'SUM(', 'SUMM(') ELSE text END"


@query("x8_batch_validate", "formulas grid", f"""
WITH f AS (SELECT g.wb_id, {BROKEN} AS text FROM formulas JOIN grid g USING (wb_id, sheet_idx, row_no, col_no)),
s AS (SELECT wb_id, {MASK} AS t FROM f), q AS (SELECT wb_id, t NOT LIKE '%SUMM(%' AND length(replace(t, '(', '')) = length(replace(t, ')', '')) AS ok FROM s)
SELECT wb_id, COUNT(*) AS total, SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS valid, SUM(CASE WHEN ok THEN 0 ELSE 1 END) AS invalid FROM q GROUP BY wb_id""")
def _(v):
    t, s = F.col("text"), F.col("style_id")
    f = v.formulas.join(v.grid.select(*CELL, "style_id"), CELL).withColumn(
        "text", F.when(s == 1, F.concat(t, F.lit(")"))).when(s == 2, F.replace(t, F.lit("SUM("), F.lit("SUMM("))).otherwise(t))
    return O.batch_validate(f, ["COUNT", "DATEVALUE", "IF", "IFERROR", "INDEX", "INDIRECT", "LEFT", "MAX", "NOW", "OFFSET", "RANK.EQ", "ROUND", "SUM", "TODAY"])


@query("x9_self_reference", "formulas", f"""WITH {REFS}
SELECT wb_id, sheet_idx, row_no, col_no, MIN(ref) AS ref FROM bounds
WHERE NOT external AND ref_sheet = own AND row_no BETWEEN r1 AND r2 AND col_no BETWEEN c1 AND c2 GROUP BY 1, 2, 3, 4""")
def _(v):
    return O.self_references(v.formulas, own_sheet())


# what each code means, written out by hand
MEANING = """meaning AS (SELECT * FROM (VALUES
 ('General', 1, 'minus', 'digit', FALSE, FALSE, NULL, FALSE), ('0.00', 1, 'minus', 'digit', FALSE, FALSE, 2, FALSE),
 ('#,##0;(#,##0);"-"', 3, 'parens', 'dash', FALSE, FALSE, 0, FALSE), ('#,##0;-#,##0', 2, 'minus', 'digit', FALSE, FALSE, 0, FALSE),
 ('0%', 1, 'minus', 'digit', FALSE, TRUE, 0, FALSE), (';;;', 4, 'blank', 'blank', FALSE, FALSE, 0, TRUE),
 ('#,##0.00_);(#,##0.00)', 2, 'parens', 'digit', FALSE, FALSE, 2, FALSE), ('yyyy-mm-dd', 1, 'date', 'date', TRUE, FALSE, 0, FALSE))
 AS t(fmt_code, n_sections, negative, zero, is_date, is_percent, places, nothing))"""


@query("x10_number_formats", "grid formats", f"""WITH {MEANING}
SELECT fmt_code, n_sections, negative, zero, is_date, is_percent, places, nothing, COUNT(*) AS n_cells
FROM grid JOIN formats USING (style_id) JOIN meaning USING (fmt_code) GROUP BY ALL""")
def _(v):
    c = F.col("fmt_code")
    counted = v.grid.groupBy("style_id").agg(F.count(F.lit(1)).alias("n_cells"))
    return counted.join(v.formats, "style_id").select(
        "fmt_code", F.size(N.sections(c)).alias("n_sections"), N.negative_class(c).alias("negative"), N.zero_class(c).alias("zero"),
        N.is_date(c).alias("is_date"), N.is_percent(c).alias("is_percent"), N.decimals(c).alias("places"),
        N.prints_nothing(c).alias("nothing"), "n_cells")


@query("x11_display_zero_tag", "grid formats", f"""WITH {MEANING},
s AS (SELECT *, CASE WHEN v_err IS NOT NULL THEN v_num * 1e-13 WHEN ref_key % 2 = 0 THEN v_num * 1e-7 ELSE v_num END AS v FROM grid JOIN formats USING (style_id) JOIN meaning USING (fmt_code))
SELECT wb_id, sheet_idx, row_no, col_no FROM s WHERE v <> 0 AND ABS(v) < POW(10.0, -COALESCE(places, 9) - CASE WHEN is_percent THEN 2 ELSE 0 END) / 2
  AND (ABS(v) < 1e-6 OR (n_sections >= 3 AND zero = 'dash'))""")
def _(v):
    g = v.grid.join(v.formats, "style_id")
    val = F.when(F.col("v_err").isNotNull(), F.col("v_num") * 1e-13).when(F.col("ref_key") % 2 == 0, F.col("v_num") * 1e-7).otherwise(F.col("v_num"))
    return g.filter(N.zero_like_tag(val, F.col("fmt_code"))).select(*CELL)


HSV = """hx AS (SELECT *, CAST('0x' || substr(text_rgb, 1, 2) AS INT) AS r, CAST('0x' || substr(text_rgb, 3, 2) AS INT) AS g, CAST('0x' || substr(text_rgb, 5, 2) AS INT) AS b FROM colours),
hm AS (SELECT *, GREATEST(r, g, b) AS mx, GREATEST(r, g, b) - LEAST(r, g, b) AS d FROM hx),
hs AS (SELECT text_rgb, bg_rgb, 60 * CASE WHEN d = 0 THEN 0 WHEN mx = r THEN CASE WHEN g >= b THEN (g - b) / d ELSE (g - b) / d + 6 END
   WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS h, CASE WHEN mx = 0 THEN 0 ELSE d / mx END AS s, mx / 255 AS v
 FROM (SELECT text_rgb, bg_rgb, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, CAST(mx AS DOUBLE) AS mx, CAST(d AS DOUBLE) AS d FROM hm) q)"""
FAMILY = """CASE WHEN v <= 0.20 OR (v <= 0.30 AND s <= 0.25) THEN 'black' WHEN h >= 75 AND h < 165 AND s >= 0.35 AND v >= 0.25 THEN 'green'
  WHEN (h < 15 OR h >= 340) AND s >= 0.50 AND v >= 0.35 THEN 'red' ELSE 'other' END"""


@query("x12_hsv_family", "colours", f"""WITH {HSV}
SELECT text_rgb, bg_rgb, ROUND(h, 4) AS h, ROUND(s, 6) AS s, ROUND(v, 6) AS v, {FAMILY} AS family, h BETWEEN 47.5 AND 68.0 AND s >= 0.5 AND v >= 0.85 AS bright_yellow FROM hs""")
def _(v):
    d = K.with_hsv(v.colours, "text_rgb")
    h, s, val = F.col("hue"), F.col("sat"), F.col("val")
    return d.select("text_rgb", "bg_rgb", F.round(h, 4).alias("h"), F.round(s, 6).alias("s"), F.round(val, 6).alias("v"),
                    K.family(h, s, val).alias("family"), K.bright_yellow(h, s, val).alias("bright_yellow"))


@query("x12_colour_names", "colours", f"""WITH {HSV}
SELECT text_rgb, bg_rgb, CASE WHEN s < 0.1 THEN CASE WHEN v < 0.2 THEN 'black' WHEN v > 0.9 THEN 'white' ELSE 'gray' END
 WHEN v < 0.4 THEN CASE WHEN h < 30 OR h >= 330 THEN 'dark_red' WHEN h < 75 THEN 'brown' WHEN h < 150 THEN 'dark_green' WHEN h < 270 THEN 'dark_blue' ELSE 'dark_purple' END
 WHEN s < 0.4 THEN CASE WHEN h < 60 THEN 'beige' WHEN h < 75 AND v > 0.8 THEN 'light_yellow' WHEN h < 150 THEN 'olive' WHEN h < 200 THEN 'slate_blue'
   WHEN h < 260 THEN CASE WHEN v > 0.8 THEN 'light_blue' ELSE 'muted_blue' END ELSE 'muted_purple' END
 WHEN s > 0.7 AND v > 0.7 THEN CASE WHEN h < 15 OR h >= 345 THEN 'bright_red' WHEN h < 45 THEN 'bright_orange' WHEN h < 65 THEN 'bright_yellow' WHEN h < 170 THEN 'bright_green'
   WHEN h < 200 THEN 'bright_cyan' WHEN h < 260 THEN 'bright_blue' WHEN h < 310 THEN 'bright_purple' ELSE 'bright_magenta' END
 WHEN s < 0.7 AND v > 0.7 THEN CASE WHEN h < 15 OR h >= 330 THEN 'pink' WHEN h < 45 THEN 'peach' WHEN h < 65 THEN 'pale_yellow' WHEN h < 170 THEN 'pale_green' WHEN h < 200 THEN 'pale_cyan'
   WHEN h < 260 THEN CASE WHEN s >= 0.55 THEN 'blue' ELSE 'light_blue' END WHEN h < 310 THEN 'lavender' ELSE 'pale_magenta' END
 ELSE CASE WHEN h < 15 OR h >= 345 THEN 'red' WHEN h < 45 THEN 'orange' WHEN h < 65 THEN 'yellow' WHEN h < 170 THEN 'green' WHEN h < 200 THEN 'cyan' WHEN h < 260 THEN 'blue'
   WHEN h < 310 THEN 'purple' ELSE 'magenta' END END AS colour FROM hs""")
def _(v):
    d = K.with_hsv(v.colours, "text_rgb")
    return d.select("text_rgb", "bg_rgb", K.colour_name(F.col("hue"), F.col("sat"), F.col("val")).alias("colour"))


def tint_part(turn):
    h = f"(CASE WHEN h + {turn} < 0 THEN h + {turn} + 240 WHEN h + {turn} > 240 THEN h + {turn} - 240 ELSE h + {turn} END)"
    level = (f"CASE WHEN sat = 0 THEN nl WHEN {h} < 40 THEN m1 + ((m2 - m1) * {h} + 20) // 40 WHEN {h} < 120 THEN m2 "
             f"WHEN {h} < 160 THEN m1 + ((m2 - m1) * (160 - {h}) + 20) // 40 ELSE m1 END")
    return f"LPAD(HEX(GREATEST(0, LEAST(255, (({level}) * 255 + 120) // 240))), 2, '0')"


X13 = f"""
WITH theme AS (SELECT CAST('0x' || substr(text_rgb, 5, 2) AS INT) AS slot, MIN(text_rgb) AS rgb FROM colours GROUP BY 1),
cells AS (SELECT wb_id, sheet_idx, row_no, col_no, CAST(ref_key % 256 AS INT) AS slot, (style_id - 4) / 8 AS tint FROM grid),
x AS (SELECT c.*, rgb, CAST('0x' || substr(rgb, 1, 2) AS INT) AS r, CAST('0x' || substr(rgb, 3, 2) AS INT) AS g, CAST('0x' || substr(rgb, 5, 2) AS INT) AS b FROM cells c JOIN theme USING (slot)),
y AS (SELECT *, GREATEST(r, g, b) AS mx, GREATEST(r, g, b) + LEAST(r, g, b) AS su, GREATEST(r, g, b) - LEAST(r, g, b) AS d FROM x),
l AS (SELECT *, (su * 240 + 255) // 510 AS lum FROM y),
s AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN lum <= 120 THEN (d * 240 + su // 2) // su ELSE (d * 240 + (510 - su) // 2) // (510 - su) END AS sat,
  CASE WHEN d = 0 THEN 160 WHEN mx = r THEN ((mx - b) * 40 + d // 2) // d - ((mx - g) * 40 + d // 2) // d WHEN mx = g THEN 80 + ((mx - r) * 40 + d // 2) // d - ((mx - b) * 40 + d // 2) // d
   ELSE 160 + ((mx - g) * 40 + d // 2) // d - ((mx - r) * 40 + d // 2) // d END AS h,
  CAST(CASE WHEN tint < 0 THEN FLOOR(lum * (1 + tint)) ELSE FLOOR(lum * (1 - tint) + 240 - FLOOR(240 * (1 - tint))) END AS INT) AS nl FROM l),
m AS (SELECT *, CASE WHEN nl <= 120 THEN (nl * (240 + sat) + 120) // 240 ELSE nl + sat - (nl * sat + 120) // 240 END AS m2 FROM s), mm AS (SELECT *, 2 * nl - m2 AS m1 FROM m)
SELECT wb_id, sheet_idx, row_no, col_no, rgb, tint, CASE WHEN tint = 0 THEN rgb ELSE {tint_part(80)} || {tint_part(0)} || {tint_part(-80)} END AS tinted FROM mm"""


@query("x13_apply_tint", "colours grid", X13)
def _(v):
    """Theme colour of a cell by its slot, tinted: slots are looked up in the theme table, then lightened or darkened."""
    theme = v.colours.select(F.conv(F.substring("text_rgb", 5, 2), 16, 10).cast("int").alias("slot"), F.col("text_rgb").alias("rgb"))
    theme = theme.groupBy("slot").agg(F.min("rgb").alias("rgb"))
    cells = v.grid.select(*CELL, (F.col("ref_key") % 256).cast("int").alias("slot"), ((F.col("style_id") - 4) / 8).alias("tint"))
    used = cells.select("slot", "tint").distinct().join(theme, "slot")
    return cells.join(K.with_tint(used, "rgb", "tint").select("slot", "tint", "rgb", "tinted"), ["slot", "tint"]).select(*CELL, "rgb", "tint", "tinted")


@query("x14_contrast", "colours", f"""WITH
p AS (SELECT text_rgb, bg_rgb, CAST('0x' || substr(text_rgb, 1, 2) AS INT) / 255.0::DOUBLE AS r1, CAST('0x' || substr(text_rgb, 3, 2) AS INT) / 255.0::DOUBLE AS g1, CAST('0x' || substr(text_rgb, 5, 2) AS INT) / 255.0::DOUBLE AS b1,
  CAST('0x' || substr(bg_rgb, 1, 2) AS INT) / 255.0::DOUBLE AS r2, CAST('0x' || substr(bg_rgb, 3, 2) AS INT) / 255.0::DOUBLE AS g2, CAST('0x' || substr(bg_rgb, 5, 2) AS INT) / 255.0::DOUBLE AS b2 FROM colours),
y AS (SELECT *, 0.2126729 * pow(r1, 2.4) + 0.7151522 * pow(g1, 2.4) + 0.0721750 * pow(b1, 2.4) AS u1, 0.2126729 * pow(r2, 2.4) + 0.7151522 * pow(g2, 2.4) + 0.0721750 * pow(b2, 2.4) AS u2,
  {"".join(f"CASE WHEN {c}{s} <= 0.04045 THEN {c}{s} / 12.92 ELSE pow(({c}{s} + 0.055) / 1.055, 2.4) END AS l{c}{s}, " for s in "12" for c in "rgb")} 1 AS one FROM p),
k AS (SELECT *, CASE WHEN u1 > 0.022 THEN u1 ELSE u1 + pow(0.022 - u1, 1.414) END AS y1, CASE WHEN u2 > 0.022 THEN u2 ELSE u2 + pow(0.022 - u2, 1.414) END AS y2,
  {"".join(f"0.2126729 * lr{s} + 0.7151522 * lg{s} + 0.0721750 * lb{s} AS w{s}, (0.4124564 * lr{s} + 0.3575761 * lg{s} + 0.1804375 * lb{s}) / 0.95047 AS X{s}, (0.0193339 * lr{s} + 0.1191920 * lg{s} + 0.9503041 * lb{s}) / 1.08883 AS Z{s}, " for s in "12")} 2 AS two FROM y),
f AS (SELECT *, {"".join(f"CASE WHEN {c}{s} > 216.0/24389 THEN pow({c}{s}, 1.0/3) ELSE (24389.0/27 * {c}{s} + 16) / 116 END AS f{c}{s}, " for s in "12" for c in "XwZ")} 3 AS three FROM k),
lab AS (SELECT *, {"".join(f"116 * fw{s} - 16 AS L{s}, 500 * (fX{s} - fw{s}) AS a{s}, 200 * (fw{s} - fZ{s}) AS q{s}, " for s in "12")} 4 AS four FROM f),
ch AS (SELECT *, sqrt(a1 * a1 + q1 * q1) AS c1, sqrt(a2 * a2 + q2 * q2) AS c2 FROM lab),
gg AS (SELECT *, 0.5 * (1 - sqrt(pow((c1 + c2) / 2, 7) / (pow((c1 + c2) / 2, 7) + pow(25.0, 7)))) AS gf FROM ch),
ap AS (SELECT *, sqrt(pow((1 + gf) * a1, 2) + q1 * q1) AS cp1, sqrt(pow((1 + gf) * a2, 2) + q2 * q2) AS cp2, degrees(atan2(q1, (1 + gf) * a1)) AS d1, degrees(atan2(q2, (1 + gf) * a2)) AS d2 FROM gg),
hp AS (SELECT *, CASE WHEN cp1 = 0 THEN 0 WHEN d1 < 0 THEN d1 + 360 ELSE d1 END AS h1, CASE WHEN cp2 = 0 THEN 0 WHEN d2 < 0 THEN d2 + 360 ELSE d2 END AS h2 FROM ap),
dh AS (SELECT *, CASE WHEN cp1 * cp2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dhp,
  CASE WHEN cp1 * cp2 = 0 THEN h1 + h2 WHEN ABS(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hb, (L1 + L2) / 2 AS lb, (cp1 + cp2) / 2 AS cb FROM hp),
tt AS (SELECT *, 1 - 0.17 * cos(radians(hb - 30)) + 0.24 * cos(radians(2 * hb)) + 0.32 * cos(radians(3 * hb + 6)) - 0.20 * cos(radians(4 * hb - 63)) AS t,
  (L2 - L1) / (1 + 0.015 * pow(lb - 50, 2) / sqrt(20 + pow(lb - 50, 2))) AS tl, (cp2 - cp1) / (1 + 0.045 * cb) AS tc,
  -sin(radians(60 * exp(-pow((hb - 275) / 25, 2)))) * 2 * sqrt(pow(cb, 7) / (pow(cb, 7) + pow(25.0, 7))) AS rt FROM dh),
e AS (SELECT *, 2 * sqrt(cp1 * cp2) * sin(radians(dhp / 2)) / (1 + 0.015 * cb * t) AS th FROM tt),
o AS (SELECT *, sqrt(GREATEST(tl * tl + tc * tc + th * th + rt * tc * th, 0)) AS de, (GREATEST(w1, w2) + 0.05) / (LEAST(w1, w2) + 0.05) AS wc,
  100 * CASE WHEN ABS(y2 - y1) < 0.0005 THEN 0 WHEN y2 > y1 THEN CASE WHEN (pow(y2, 0.56) - pow(y1, 0.57)) * 1.14 < 0.1 THEN 0 ELSE (pow(y2, 0.56) - pow(y1, 0.57)) * 1.14 - 0.027 END
    ELSE CASE WHEN (pow(y2, 0.65) - pow(y1, 0.62)) * 1.14 > -0.1 THEN 0 ELSE (pow(y2, 0.65) - pow(y1, 0.62)) * 1.14 + 0.027 END END AS rawlc FROM e)
SELECT text_rgb, bg_rgb, ROUND(rawlc, 2) AS lc, ROUND(wc, 4) AS wcag, ROUND(de, 4) AS de2000,
  wc >= 1.1 AND de >= 20 AND LEAST(L1, L2) >= 40 AND GREATEST(c1, c2) >= 40 AS hue_exempt,
  ABS(ROUND(rawlc, 2)) < 12 AND NOT (wc >= 1.1 AND de >= 20 AND LEAST(L1, L2) >= 40 AND GREATEST(c1, c2) >= 40) AS conceals FROM o""")
def _(v):
    return K.with_contrast(v.colours)


CHAR = """CASE WHEN contains(' .,:;''|!il`', c) THEN 0.5 WHEN contains('$%()-+/\\[]{}"*^tfrjI', c) THEN 0.7 WHEN contains('@#&mwMW', c) THEN 1.3
  WHEN regexp_matches(c, '\\p{Lu}') THEN 1.1 WHEN regexp_matches(c, '\\p{Nd}') THEN 1.0 ELSE 0.9 END"""


@query("x15_text_width", "text_cells", f"""
WITH d AS (SELECT v_text, COUNT(*) AS n FROM text_cells GROUP BY v_text),
ch AS (SELECT v_text, UNNEST(string_split(v_text, '')) AS c FROM d),
per AS (SELECT v_text, c, COUNT(*) AS k FROM ch GROUP BY v_text, c)
SELECT t.wb_id, t.sheet_idx, t.row_no, t.col_no, ROUND(w, 4) AS width FROM text_cells t JOIN (SELECT v_text, SUM(k * {CHAR}) AS w FROM per GROUP BY v_text) q USING (v_text)""")
def _(v):
    # copies of a text are measured once
    texts = v.text_cells.select("v_text").distinct().withColumn("width", F.round(T.text_width(F.col("v_text")), 4))
    return v.text_cells.join(texts, "v_text").select(*CELL, "width")


@query("x15_number_width", "grid", """
WITH t AS (SELECT wb_id, sheet_idx, row_no, col_no, printf('%.2f', v_num) AS s FROM grid),
n AS (SELECT *, length(s) - length(replace(s, '.', '')) AS dots, length(s) - length(replace(s, '-', '')) AS minus FROM t)
SELECT wb_id, sheet_idx, row_no, col_no, s, ROUND((0.556 * (length(s) - dots - minus) + 0.278 * dots + 0.333 * minus) * (10 * 96.0 / 72 / 7), 4) AS width FROM n""")
def _(v):
    shown = F.format_string("%.2f", F.col("v_num"))
    return v.grid.select(*CELL, shown.alias("s"), F.round(T.number_width(shown, "Arial", 10.0), 4).alias("width"))


@query("x16_wrap_lines", "text_cells", f"""
WITH p AS (SELECT wb_id, sheet_idx, row_no, col_no, UNNEST(string_split(v_text, chr(10))) AS para FROM text_cells),
w AS (SELECT *, list_transform(string_split(para, ' '), lambda word: {{'l': 0, 'c': CAST(list_sum(list_transform(string_split(word, ''), lambda c: {CHAR})) AS DOUBLE)}}) AS ws FROM p),
r AS (SELECT *, list_reduce(ws, lambda a, x: CASE WHEN a.c > 0 AND a.c + 0.5 + COALESCE(x.c, 0) <= 60.000001 THEN {{'l': a.l, 'c': a.c + 0.5 + COALESCE(x.c, 0)}}
   ELSE {{'l': a.l + CASE WHEN a.c > 0 THEN 1 ELSE 0 END, 'c': COALESCE(x.c, 0)}} END, {{'l': 1, 'c': CAST(0 AS DOUBLE)}}) AS f FROM w)
SELECT wb_id, sheet_idx, row_no, col_no, SUM(f.l) AS lines FROM r GROUP BY 1, 2, 3, 4""")
def _(v):
    return v.text_cells.select(*CELL, T.wrap_lines(F.col("v_text"), 60.0).alias("lines"))


RULES = """rules AS (SELECT wb_id, sheet_idx, r1, c1, r2, c2, priority, CASE priority WHEN 3 THEN 'notContainsBlanks' WHEN 4 THEN 'expression' ELSE 'cellIs' END AS rule_type,
 CASE priority WHEN 0 THEN 'greaterThan' WHEN 1 THEN 'lessThan' WHEN 2 THEN 'between' END AS operator, CAST(r1 * 500 AS DOUBLE) AS a, CAST(c1 * 1000 AS DOUBLE) AS b FROM ranges)"""


def cf_rules(v):
    p = F.col("priority")
    return (v.ranges.withColumn("rule_type", F.when(p == 3, "notContainsBlanks").when(p == 4, "expression").otherwise("cellIs"))
            .withColumn("operator", F.when(p == 0, "greaterThan").when(p == 1, "lessThan").when(p == 2, "between"))
            .withColumn("a", (F.col("r1") * 500).cast("double")).withColumn("b", (F.col("c1") * 1000).cast("double")))


@query("x17_apply_cf", "grid ranges", f"""WITH {RULES},
h AS (SELECT g.wb_id, g.sheet_idx, g.row_no, g.col_no, priority, rule_type, CASE WHEN rule_type = 'notContainsBlanks' THEN TRUE WHEN operator = 'greaterThan' THEN v_num > a WHEN operator = 'lessThan' THEN v_num < a
   WHEN operator = 'between' THEN v_num BETWEEN LEAST(a, b) AND GREATEST(a, b) END AS fires
 FROM grid g JOIN rules r ON r.wb_id = g.wb_id AND r.sheet_idx = g.sheet_idx AND row_no BETWEEN r1 AND r2 AND col_no BETWEEN c1 AND c2)
SELECT wb_id, sheet_idx, row_no, col_no, MIN(CASE WHEN fires THEN priority END) AS first_priority, SUM(CASE WHEN fires THEN 1 ELSE 0 END) AS n_firing,
 SUM(CASE WHEN fires IS NULL THEN 1 ELSE 0 END) AS n_off FROM h GROUP BY 1, 2, 3, 4""")
def _(v):
    return O.apply_cf(v.grid, cf_rules(v)).select(*CELL, F.col("first.priority").alias("first_priority"), "n_firing", "n_off")


@query("x18_column_profile", "grid", """
WITH c AS (SELECT *, CASE WHEN v_err IS NOT NULL THEN 'string' ELSE 'number' END AS type, COALESCE(v_err, printf('%.2f', v_num)) AS shown FROM grid),
t AS (SELECT wb_id, sheet_idx, col_no, type, COUNT(*) AS n, MIN(row_no) AS f FROM c GROUP BY 1, 2, 3, 4),
m AS (SELECT * FROM (SELECT *, SUM(n) OVER (PARTITION BY wb_id, sheet_idx, col_no) AS non_null, ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, col_no ORDER BY n DESC, f) AS k FROM t) q WHERE k = 1),
e AS (SELECT wb_id, sheet_idx, col_no, string_agg(shown, '; ' ORDER BY row_no) AS examples FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY wb_id, sheet_idx, col_no ORDER BY row_no) AS k FROM c) q WHERE k <= 3 GROUP BY 1, 2, 3)
SELECT m.wb_id, m.sheet_idx, m.col_no, m.type AS inferred_type, non_null, examples FROM m JOIN e USING (wb_id, sheet_idx, col_no)""")
def _(v):
    shown = F.coalesce("v_err", F.format_string("%.2f", F.col("v_num")))
    kind = T.infer_type(F.when(F.col("v_err").isNull(), F.col("v_num")), F.col("v_err"), F.lit(None).cast("boolean"))
    cells = v.grid.withColumn("type", kind).withColumn("shown", shown)
    return O.column_profile(cells)


# ---- X17 as an overlay: each rule brings some properties, the first firing rule that has one gives it
LAYERS = """layers AS (SELECT wb_id, sheet_idx, r1, c1, r2, c2, priority, CASE priority WHEN 3 THEN 'notContainsErrors' WHEN 4 THEN 'beginsWith' ELSE 'cellIs' END AS rule_type,
 CASE priority WHEN 0 THEN 'greaterThan' WHEN 1 THEN 'lessThan' WHEN 2 THEN 'between' END AS operator, CAST(r1 * 500 AS DOUBLE) AS a, CAST(c1 * 1000 AS DOUBLE) AS b,
 CASE priority WHEN 0 THEN '0.00' WHEN 1 THEN '#,##0;(#,##0);"-"' WHEN 4 THEN '#,##0;-#,##0' END AS fmt_code, CASE priority WHEN 2 THEN 'FF0000' WHEN 3 THEN '008000' END AS font_rgb, priority = 3 AS stop FROM ranges)"""
OVERLAY = LAYERS + """, hit AS (SELECT g.wb_id, g.sheet_idx, g.row_no, g.col_no, priority, l.fmt_code, font_rgb, stop FROM grid g JOIN layers l ON l.wb_id = g.wb_id AND l.sheet_idx = g.sheet_idx AND row_no BETWEEN r1 AND r2 AND col_no BETWEEN c1 AND c2
 WHERE CASE rule_type WHEN 'notContainsErrors' THEN v_err IS NULL WHEN 'beginsWith' THEN v_err IS NULL AND v_num < 0 ELSE v_err IS NULL AND CASE operator WHEN 'greaterThan' THEN v_num > a WHEN 'lessThan' THEN v_num < a ELSE v_num BETWEEN LEAST(a, b) AND GREATEST(a, b) END END),
ends AS (SELECT *, MIN(CASE WHEN stop THEN priority END) OVER (PARTITION BY wb_id, sheet_idx, row_no, col_no) AS last FROM hit),
over AS (SELECT wb_id, sheet_idx, row_no, col_no, arg_min(fmt_code, priority) FILTER (fmt_code IS NOT NULL) AS fmt_code, arg_min(font_rgb, priority) FILTER (font_rgb IS NOT NULL) AS font_rgb
 FROM ends WHERE priority <= COALESCE(last, 99) GROUP BY 1, 2, 3, 4)"""


def layers(v):
    p = F.col("priority")
    return (v.ranges.withColumn("rule_type", F.when(p == 3, "notContainsErrors").when(p == 4, "beginsWith").otherwise("cellIs"))
            .withColumn("operator", F.when(p == 0, "greaterThan").when(p == 1, "lessThan").when(p == 2, "between"))
            .withColumn("a", (F.col("r1") * 500).cast("double")).withColumn("b", (F.col("c1") * 1000).cast("double"))
            .withColumn("fmt_code", F.when(p == 0, "0.00").when(p == 1, '#,##0;(#,##0);"-"').when(p == 4, "#,##0;-#,##0"))
            .withColumn("font_rgb", F.when(p == 2, "FF0000").when(p == 3, "008000")).withColumn("stop", p == 3).withColumn("text", F.lit("-")))


@query("x17_cf_overlay", "grid ranges", f"WITH {OVERLAY} SELECT wb_id, sheet_idx, row_no, col_no, fmt_code, font_rgb FROM over WHERE fmt_code IS NOT NULL OR font_rgb IS NOT NULL")
def _(v):
    return O.cf_overlay(v.grid, layers(v), ["fmt_code", "font_rgb"]).filter("fmt_code IS NOT NULL OR font_rgb IS NOT NULL")


# ---- names, tables and spans of sheets: six formulas, five names and one table a workbook
REACHING = """wtext AS (SELECT wb_id, sheet_idx, row_no, col_no, ref_key % 7 AS k, CASE ref_key % 7 WHEN 0 THEN 'N_A*2' WHEN 1 THEN 'SUM(Sales[Amount])' WHEN 2 THEN 'SUM(S1:S3!B2:B4)' WHEN 3 THEN 'Chain' WHEN 4 THEN 'Sales[[#This Row],[Qty]]*$A$1'
  WHEN 5 THEN 'Loop1+1' ELSE 'SUM(Sales[[Qty]:[Amount]],S3:S2!A1)' END AS text FROM grid),
goals AS (SELECT * FROM (VALUES (0, 'S2', 1, 2, 5, 2, 'name'), (1, 'S4', 2, 3, 40, 3, 'table'), (2, 'S1', 2, 2, 4, 2, 'cell'), (2, 'S2', 2, 2, 4, 2, 'cell'), (2, 'S3', 2, 2, 4, 2, 'cell'), (3, 'S2', 1, 2, 5, 2, 'name'), (3, 'S3', 3, 3, 3, 3, 'name'),
  (4, 'S4', NULL, 2, NULL, 2, 'table'), (4, NULL, 1, 1, 1, 1, 'cell'), (5, 'S0', 1, 1, 1, 1, 'name'), (6, 'S4', 2, 2, 40, 3, 'table'), (6, 'S2', 1, 1, 1, 1, 'cell'), (6, 'S3', 1, 1, 1, 1, 'cell')) AS t(k, s, a, b, c, d, via)),
reach AS (SELECT w.wb_id, w.sheet_idx, w.row_no, w.col_no, text, w.k, COALESCE(s, 'S' || CAST(sheet_idx AS VARCHAR)) AS ref_sheet, COALESCE(a, row_no) AS r1, b AS c1, COALESCE(c, row_no) AS r2, d AS c2, via FROM wtext w JOIN goals USING (k)),
there AS (SELECT r.* FROM reach r JOIN sheets s ON s.wb_id = r.wb_id AND s.sheet = r.ref_sheet)"""
_NAMES = [("N_A", None, "S2!$B$1:$B$5"), ("Chain", None, "chain2"), ("Chain2", None, "N_A+S3!$C$3"), ("Loop1", None, "Loop2*2"), ("Loop2", None, "Loop1+S0!$A$1")]


def reaching(v):
    """Formulas through names, tables and spans, and the relations they resolve by."""
    k = F.col("ref_key") % 7
    texts = ["N_A*2", "SUM(Sales[Amount])", "SUM(S1:S3!B2:B4)", "Chain", "Sales[[#This Row],[Qty]]*$A$1", "Loop1+1", "SUM(Sales[[Qty]:[Amount]],S3:S2!A1)"]
    f = v.grid.select(*CELL, F.element_at(F.array(*[F.lit(t) for t in texts]), (k + 1).cast("int")).alias("text"))
    books = v.sheets.select("wb_id").distinct()
    rows = lambda *r: F.explode(F.array(*r))
    names = books.select("wb_id", rows(*[F.struct(F.lit(n).alias("name"), F.lit(s).cast("int").alias("scope"), F.lit(d).alias("definition")) for n, s, d in _NAMES]).alias("n")).select("wb_id", "n.*")
    tables = books.select("wb_id", F.lit("Sales").alias("table"), F.lit("S4").alias("sheet"), *[F.lit(x).alias(c) for c, x in (("r1", 2), ("c1", 2), ("r2", 40), ("c2", 3))])
    columns = books.select("wb_id", F.lit("Sales").alias("table"), rows(*[F.struct(F.lit(n).alias("column"), F.lit(c).alias("col_no")) for n, c in (("Qty", 2), ("Amount", 3))]).alias("c")).select("wb_id", "table", "c.*")
    return f, R.resolved_references(f, names, tables, columns, v.sheets)


@query("x3_resolved_references", "grid sheets", f"WITH {REACHING} SELECT wb_id, sheet_idx, row_no, col_no, ref_sheet, r1, c1, r2, c2, via FROM reach WHERE k NOT IN (2, 6) OR via <> 'cell' OR (k = 2 AND EXISTS (SELECT 1 FROM there a WHERE a.wb_id = reach.wb_id AND a.ref_sheet = reach.ref_sheet) AND (SELECT COUNT(*) FROM sheets s WHERE s.wb_id = reach.wb_id AND s.sheet IN ('S1', 'S3')) = 2) OR (k = 6 AND (SELECT COUNT(*) FROM sheets s WHERE s.wb_id = reach.wb_id AND s.sheet IN ('S2', 'S3')) = 2)")
def _(v):
    return reaching(v)[1]


@query("x6_resolved_class", "grid sheets", f"WITH {REACHING} SELECT wb_id, sheet_idx, row_no, col_no, CASE WHEN NOT bool_or(ref_sheet <> 'S' || CAST(sheet_idx AS VARCHAR)) THEN 'OWN' WHEN any_value(k) = 3 THEN 'POINTER' ELSE 'CROSS' END AS class FROM reach GROUP BY 1, 2, 3, 4")
def _(v):
    f, resolved = reaching(v)
    return R.resolved_class(f, resolved, v.sheets)
