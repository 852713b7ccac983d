"""The rest of a workbook package as tables: sheets, views, columns, names, settings, styles with their theme.

All readers take the parts of ``workbooks.workbook_parts``. Small members are parsed whole by ``from_xml``; of a
sheet only what stands before its rows. ``book_views`` puts everything together in the shape the checks read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import with_tint
from ..operators.grid import shared_texts
from ..session import checkpointed, texts_table
from .workbooks import _XML, _wrapped, cells_from_parts, shared_strings, sheet_tail

# Number formats that a workbook names by number alone.
BUILT_IN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}
# The palette of colours given by number, then window text and window ground.
INDEXED = (
    "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF "
    "800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF "
    "000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99 "
    "3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333 "
    "000000 FFFFFF").split()
# The order in which colours of a theme are numbered, and those of the standard theme.
THEME_SLOTS = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
STANDARD_THEME = ("FFFFFF", "000000", "E7E6E6", "44546A", "4472C4", "ED7D31", "A5A5A5", "FFC000", "5B9BD5", "70AD47", "0563C1", "954F72")


def _on(c: Column, default: bool = False) -> Column:
    return F.coalesce(F.lower(c).isin("1", "true", "on"), F.lit(default))


def _member(parts: DataFrame, pattern: str, schema: str) -> DataFrame:
    """(wb_id, part, x) of whole members."""
    bare = F.regexp_replace(F.regexp_replace("xml", r"^\s*<\?xml[^>]*\?>", ""), r"(</?)\w+:(?=\w+)", "$1")
    return parts.filter(F.col("part").rlike(pattern) & (F.col("piece") == "whole")).select("wb_id", "part", F.from_xml(bare, schema, _XML).alias("x"))


def _fragment(parts: DataFrame, tag: str, schema: str) -> DataFrame:
    """(wb_id, part, x) of one element that stands before the rows of each sheet; sheets without it are left out."""
    sheets = parts.filter(F.col("part").rlike(r"^xl/worksheets/[^/]+\.xml$") & F.col("piece").isin("head", "whole"))
    found = F.regexp_extract("xml", rf"(?s)<(?:\w+:)?{tag}\b[^>]*/>|<(?:\w+:)?{tag}\b.*?</(?:\w+:)?{tag}\s*>", 0)
    return sheets.withColumn("found", found).filter("found <> ''").select("wb_id", "part", F.from_xml(_wrapped(F.col("found"), "head"), f"STRUCT<{tag}: {schema}>", _XML)[tag].alias("x"))


_BOOK = ("STRUCT<sheets: STRUCT<sheet: ARRAY<STRUCT<_name: STRING, _state: STRING, _id: STRING>>>, "
         "definedNames: STRUCT<definedName: ARRAY<STRUCT<_VALUE: STRING, _name: STRING, _localSheetId: INT, _hidden: STRING>>>, "
         "calcPr: STRUCT<_calcMode: STRING, _iterate: STRING>>")


def sheets_of(parts: DataFrame) -> DataFrame:
    """(wb_id, sheet_idx, sheet, state, part) in the workbook's order; part is null where the package lacks it."""
    books = _member(parts, r"^xl/workbook\.xml$", _BOOK).select("wb_id", F.posexplode("x.sheets.sheet").alias("sheet_idx", "s"))
    links = _member(parts, r"^xl/_rels/workbook\.xml\.rels$", "STRUCT<Relationship: ARRAY<STRUCT<_Id: STRING, _Target: STRING>>>")
    links = links.select("wb_id", F.explode("x.Relationship").alias("r")).select(
        "wb_id", F.col("r._Id").alias("rid"), F.when(F.startswith("r._Target", F.lit("/")), F.substring("r._Target", 2, 4000)).otherwise(F.concat(F.lit("xl/"), "r._Target")).alias("part"))
    named = books.select("wb_id", "sheet_idx", F.col("s._name").alias("sheet"), F.coalesce("s._state", F.lit("visible")).alias("state"), F.col("s._id").alias("rid"))
    return named.join(links, ["wb_id", "rid"], "left").drop("rid")


def names_of(parts: DataFrame) -> DataFrame:
    """(wb_id, name, definition, scope, hidden) of the defined names; built-in ones are left out."""
    d = _member(parts, r"^xl/workbook\.xml$", _BOOK).select("wb_id", F.explode("x.definedNames.definedName").alias("n"))
    return (d.select("wb_id", F.col("n._name").alias("name"), F.coalesce("n._VALUE", F.lit("")).alias("definition"), F.col("n._localSheetId").alias("scope"), _on(F.col("n._hidden")).alias("hidden"))
            .filter(~F.startswith(F.lower("name"), F.lit("_xlnm."))))


def workbooks_of(parts: DataFrame) -> DataFrame:
    """(wb_id, calc_mode, iterate, application, app_version)."""
    book = _member(parts, r"^xl/workbook\.xml$", _BOOK).select("wb_id", F.coalesce("x.calcPr._calcMode", F.lit("auto")).alias("calc_mode"), _on(F.col("x.calcPr._iterate")).alias("iterate"))
    app = _member(parts, r"^docProps/app\.xml$", "STRUCT<Application: STRING, AppVersion: STRING>").select("wb_id", F.col("x.Application").alias("application"), F.col("x.AppVersion").alias("app_version"))
    return book.join(app, "wb_id", "left")


_VIEW = ("STRUCT<sheetView: ARRAY<STRUCT<_zoomScale: INT, _showZeros: STRING, pane: STRUCT<_activePane: STRING, _state: STRING, _xSplit: DOUBLE, _ySplit: DOUBLE>, "
         "selection: ARRAY<STRUCT<_pane: STRING, _activeCell: STRING>>>>>")


def views_of(parts: DataFrame) -> DataFrame:
    """(wb_id, part, zoom, show_zeros, active_pane, selections) of the first view of each sheet, with the defaults of the format."""
    v = _fragment(parts, "sheetViews", _VIEW).select("wb_id", "part", F.get("x.sheetView", F.lit(0)).alias("v"))
    return v.select("wb_id", "part", F.coalesce("v._zoomScale", F.lit(100)).alias("zoom"), _on(F.coalesce("v._showZeros", F.lit("1"))).alias("show_zeros"),
                    F.coalesce("v.pane._activePane", F.lit("topLeft")).alias("active_pane"), F.col("v.selection").alias("selections"))


def selections_of(views: DataFrame) -> DataFrame:
    """(wb_id, part, pos, pane, active_cell), one row per selection."""
    return views.select("wb_id", "part", F.posexplode("selections").alias("pos", "s")).select(
        "wb_id", "part", "pos", F.coalesce("s._pane", F.lit("topLeft")).alias("pane"), F.coalesce("s._activeCell", F.lit("A1")).alias("active_cell"))


def columns_of(parts: DataFrame) -> DataFrame:
    """(wb_id, part, seq, lo, hi, width, hidden, outline_level, style_id) of the column entries, in file order."""
    d = _fragment(parts, "cols", "STRUCT<col: ARRAY<STRUCT<_min: INT, _max: INT, _width: DOUBLE, _hidden: STRING, _outlineLevel: INT, _style: INT>>>")
    return d.select("wb_id", "part", F.posexplode("x.col").alias("seq", "c")).select(
        "wb_id", "part", "seq", F.col("c._min").alias("lo"), F.col("c._max").alias("hi"), F.col("c._width").alias("width"), _on(F.col("c._hidden")).alias("hidden"),
        F.coalesce("c._outlineLevel", F.lit(0)).alias("outline_level"), F.coalesce("c._style", F.lit(0)).alias("style_id"))


_COLOUR = "STRUCT<_rgb: STRING, _theme: INT, _indexed: INT, _tint: DOUBLE>"
_STYLES = (f"STRUCT<numFmts: STRUCT<numFmt: ARRAY<STRUCT<_numFmtId: INT, _formatCode: STRING>>>, "
           f"fonts: STRUCT<font: ARRAY<STRUCT<sz: STRUCT<_val: DOUBLE>, name: STRUCT<_val: STRING>, color: {_COLOUR}>>>, "
           f"fills: STRUCT<fill: ARRAY<STRUCT<patternFill: STRUCT<_patternType: STRING, fgColor: {_COLOUR}>>>>, "
           "cellXfs: STRUCT<xf: ARRAY<STRUCT<_numFmtId: INT, _fontId: INT, _fillId: INT, alignment: STRUCT<_wrapText: STRING, _shrinkToFit: STRING, _horizontal: STRING>>>>>")
_SLOT = "STRUCT<srgbClr: STRUCT<_val: STRING>, sysClr: STRUCT<_lastClr: STRING>>"


def themes_of(parts: DataFrame) -> DataFrame:
    """(wb_id, palette): the twelve colours of each workbook's theme in the order in which styles number them."""
    slots = ", ".join(f"{s}: {_SLOT}" for s in THEME_SLOTS)
    t = _member(parts, r"^xl/theme/theme1\.xml$", f"STRUCT<themeElements: STRUCT<clrScheme: STRUCT<{slots}>>>")
    colour = lambda s, own: F.upper(F.coalesce(f"x.themeElements.clrScheme.{s}.srgbClr._val", f"x.themeElements.clrScheme.{s}.sysClr._lastClr", F.lit(own)))
    return t.select("wb_id", F.array(*[colour(s, own) for s, own in zip(THEME_SLOTS, STANDARD_THEME, strict=True)]).alias("palette"))


def styles_of(parts: DataFrame) -> DataFrame:
    """(wb_id, style_id, fmt_code, font_rgb, fill_rgb, size, face, wrap, shrink, horizontal) of every cell format.

    Colours are resolved: by value, by number, or as a slot of the theme with its tint. A font without a colour is
    black, a fill without a pattern is null.
    """
    books = _member(parts, r"^xl/styles\.xml$", _STYLES).join(themes_of(parts), "wb_id", "left")
    standard, indexed = (F.array(*[F.lit(c) for c in t]) for t in (STANDARD_THEME, INDEXED))
    codes = F.create_map(*[F.lit(x) for kv in BUILT_IN_FORMATS.items() for x in kv])
    # codes of the workbook itself come before the built-in ones
    own = F.map_from_entries(F.transform(F.coalesce("x.numFmts.numFmt", F.array().cast("array<struct<_numFmtId:int,_formatCode:string>>")), lambda n: F.struct(n["_numFmtId"], n["_formatCode"])))
    d = books.withColumn("own", own).withColumn("palette", F.coalesce("palette", standard))
    d = d.select("wb_id", "own", "palette", F.col("x.fonts.font").alias("fonts"), F.col("x.fills.fill").alias("fills"), F.posexplode("x.cellXfs.xf").alias("style_id", "xf"))
    d = d.withColumn("font", F.get("fonts", F.coalesce("xf._fontId", F.lit(0)))).withColumn("fill", F.get("fills", F.coalesce("xf._fillId", F.lit(0)))["patternFill"])
    n = F.coalesce("xf._numFmtId", F.lit(0))
    painted = F.coalesce(F.col("fill._patternType"), F.lit("none")) != "none"

    def base(c: str) -> Column:
        return F.upper(F.coalesce(F.right(F.col(f"{c}._rgb"), F.lit(6)), F.get("palette", F.col(f"{c}._theme")), F.get(indexed, F.col(f"{c}._indexed"))))

    flat = d.select("wb_id", "style_id", F.coalesce(F.col("own")[n], codes[n], F.lit("General")).alias("fmt_code"), F.coalesce(base("font.color"), F.lit("000000")).alias("font_base"),
                    F.col("font.color._tint").alias("font_tint"), F.when(painted, base("fill.fgColor")).alias("fill_base"), F.col("fill.fgColor._tint").alias("fill_tint"),
                    F.col("font.sz._val").alias("size"), F.col("font.name._val").alias("face"), _on(F.col("xf.alignment._wrapText")).alias("wrap"),
                    _on(F.col("xf.alignment._shrinkToFit")).alias("shrink"), F.col("xf.alignment._horizontal").alias("horizontal"))
    flat = with_tint(with_tint(flat, "font_base", "font_tint", "font_rgb"), "fill_base", "fill_tint", "fill_rgb")
    return flat.select("wb_id", "style_id", "fmt_code", "font_rgb", "fill_rgb", "size", "face", "wrap", "shrink", "horizontal")


def book_views(parts: DataFrame) -> dict[str, DataFrame]:
    """The relations the checks read, from the files alone: workbooks, sheets, selections, columns, names, styles, cells, merges, cf_rules, validations.

    ``cells`` has the text of every formula, children of shared formulas included, and the number of its style;
    sheets that are no worksheets have no cells. Give ``parts`` as a written table: each relation reads it.
    """
    # written, so that the cells are joined to tables of known size
    sheets = checkpointed(sheets_of(parts))
    views = views_of(parts)
    place = sheets.filter(F.col("part").isNotNull()).select("wb_id", "part", "sheet_idx", "sheet")
    seen = sheets.join(views, ["wb_id", "part"], "left")
    seen = checkpointed(seen.select("wb_id", "sheet_idx", "sheet", "state", F.coalesce("zoom", F.lit(100)).alias("zoom"), F.coalesce("show_zeros", F.lit(True)).alias("show_zeros"),
                       F.coalesce("active_pane", F.lit("topLeft")).alias("active_pane")))
    cells = shared_texts(cells_from_parts(parts, texts_table(shared_strings(parts), "text")).join(place, ["wb_id", "part"]), ["wb_id", "sheet_idx"])
    placed = {name: df.join(place, ["wb_id", "part"]).drop("part") for name, df in (("selections", selections_of(views)), ("columns", columns_of(parts)), *sheet_tail(parts).items())}
    return {"workbooks": workbooks_of(parts), "sheets": seen, "names": names_of(parts), "styles": styles_of(parts), "cells": cells.drop("part"), **placed}
