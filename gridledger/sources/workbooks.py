"""Workbook files to rows: zip members, cells, formulas, sheet tails, inventory, manifest."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import a1

PARTS = "wb_id STRING, part STRING, piece STRING, piece_no INT, first_item INT, xml STRING"
_ITEM_END = {"row": re.compile(r"</(?:\w+:)?row\s*>|<(?:\w+:)?row\b[^>]*/>"), "si": re.compile(r"</(?:\w+:)?si\s*>|<(?:\w+:)?si\s*/>")}


def _pieces(stream, tag: str, size: int) -> Iterator[tuple[str, int, int, str]]:
    """(piece, number, items before it, xml): head, runs of whole items, tail, read in bounded memory."""
    reader = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="")
    opened = re.compile(rf"<(?:\w+:)?{tag}\b")
    text, number, before, in_body = "", 0, 0, False
    while True:
        more = reader.read(size)
        text += more
        if not in_body:
            m = opened.search(text)
            if m and (m.start() + len(tag) + 64 < len(text) or not more):
                yield "head", 0, 0, text[:m.start()]
                text, in_body = text[m.start():], True
        if in_body:
            cut = 0
            for m in _ITEM_END[tag].finditer(text):
                cut = m.end()
            if cut:
                body = text[:cut]
                number += 1
                yield "items", number, before, body
                before += len(_ITEM_END[tag].findall(body))
                text = text[cut:]
        if not more:
            break
    yield ("tail" if in_body else "whole"), 0, before, text


_COLUMNS = ["wb_id", "part", "piece", "piece_no", "first_item", "xml"]


def _members(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple]:
    """The pieces of every XML member of the packages (path, content), one package open at a time."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            wb = f"{path}#{hashlib.sha256(content).hexdigest()[:16]}"
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                yield wb, "", "broken", 0, 0, None
                continue
            for name in archive.namelist():
                if not name.lower().endswith((".xml", ".rels")):
                    continue
                tag = "row" if name.startswith("xl/worksheets/") else "si" if name == "xl/sharedStrings.xml" else None
                with archive.open(name) as stream:
                    found = _pieces(stream, tag, size) if tag else [("whole", 0, 0, stream.read().decode("utf-8-sig", "replace"))]
                    for piece, number, before, xml in found:
                        yield wb, name, piece, number, before, xml


def _unzip(size: int, together: int = 1 << 20):
    """A function of batches of packages to batches of pieces; ``together`` characters of small pieces go in one batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for row in _members(batches, size):
            rows.append(row)
            held += len(row[-1] or "") + 100
            if held >= together:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)
    return run


def workbook_parts(spark: SparkSession, path: str, piece_chars: int = 1 << 20) -> DataFrame:
    """Every XML member of every workbook below ``path``; ``wb_id`` is the path and a digest of the content.

    Sheets and shared strings come in pieces of about a megabyte cut between rows, so one
    huge sheet becomes many rows that later stages read in parallel. Only unzipping is Python.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[xX][lL][sS][xXmM]").load(path)
    return files.select("path", "content").mapInPandas(_unzip(piece_chars), PARTS)


_CELL = ("STRUCT<_r: STRING, _t: STRING, _s: INT, v: STRING, f: STRUCT<_VALUE: STRING, _t: STRING, _si: INT, _ref: STRING>, "
         "is: STRUCT<t: STRING>>")
_ROWS = f"STRUCT<row: ARRAY<STRUCT<_r: INT, _ht: DOUBLE, _hidden: STRING, _customHeight: STRING, _outlineLevel: INT, c: ARRAY<{_CELL}>>>>"
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def _wrapped(column, tag: str):
    """An XML fragment under one root, prefixes removed."""
    bare = F.regexp_replace(column, r"(</?)\w+:(?=\w+)", "$1")
    return F.concat(F.lit(f"<{tag}>"), bare, F.lit(f"</{tag}>"))


def _sheet_rows(parts: DataFrame) -> DataFrame:
    sheets = parts.filter(F.col("part").rlike(r"^xl/worksheets/[^/]+\.xml$") & (F.col("piece") == "items"))
    return sheets.select("wb_id", "part", F.explode(F.from_xml(_wrapped(F.col("xml"), "sheetData"), _ROWS, _XML)["row"]).alias("row"))


def rows_meta(parts: DataFrame) -> DataFrame:
    on = lambda c: F.coalesce(F.lower(c).isin("1", "true"), F.lit(False))
    return _sheet_rows(parts).select("wb_id", "part", F.col("row._r").alias("row_no"), F.col("row._ht").alias("height"), on(F.col("row._hidden")).alias("hidden"),
                                     on(F.col("row._customHeight")).alias("custom"), F.coalesce("row._outlineLevel", F.lit(0)).alias("outline_level"))


def shared_strings(parts: DataFrame) -> DataFrame:
    """Shared strings with their index; pieces know how many came before, so no row is numbered globally."""
    schema = "STRUCT<si: ARRAY<STRUCT<t: STRING, r: ARRAY<STRUCT<t: STRING>>>>>"
    items = parts.filter((F.col("part") == "xl/sharedStrings.xml") & (F.col("piece") == "items"))
    si = items.select("wb_id", "first_item", F.posexplode(F.from_xml(_wrapped(F.col("xml"), "sst"), schema, _XML)["si"]).alias("pos", "si"))
    runs = F.array_join(F.transform("si.r", lambda r: F.coalesce(r["t"], F.lit(""))), "")
    return si.select("wb_id", (F.col("first_item") + F.col("pos")).alias("string_no"), F.coalesce("si.t", runs, F.lit("")).alias("text"))


def cells_from_parts(parts: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """One row per written cell: kind, value columns, style and formula facts. ``strings`` are the shared strings where they are at hand."""
    c = _sheet_rows(parts).select("wb_id", "part", F.explode("row.c").alias("c"))
    at = a1.parse_a1(F.col("c._r"))
    flat = c.select("wb_id", "part", F.inline(F.array(at)), F.col("c._t").alias("t"), F.coalesce("c._s", F.lit(0)).alias("style_id"), F.col("c.v").alias("raw"),
                    F.col("c.is.t").alias("inline_text"), F.col("c.f._VALUE").alias("formula"), F.col("c.f._t").alias("f_kind"), F.col("c.f._si").alias("si"),
                    F.col("c.f._ref").alias("f_ref"), F.col("c.f").isNotNull().alias("has_formula"))
    flat = flat.withColumn("string_no", F.when(F.col("t") == "s", F.col("raw").try_cast("int")))
    if strings is None:
        strings = shared_strings(parts)
    d = flat.join(strings, ["wb_id", "string_no"], "left")
    t, raw = F.col("t"), F.col("raw")
    kind = (F.when(t == "e", "error").when(t == "b", "bool").when(t.isin("s", "str", "inlineStr"), "text").when(raw.isNotNull(), "number").otherwise("empty"))
    return d.select("wb_id", "part", F.col("r1").alias("row_no"), F.col("c1").alias("col_no"), kind.alias("kind"),
                    F.when(kind == "number", raw.try_cast("double")).alias("v_num"),
                    F.when(kind == "text", F.coalesce("text", "inline_text", F.when(t == "str", raw), F.lit(""))).alias("v_text"),
                    F.when(kind == "bool", raw == "1").alias("v_bool"), F.when(kind == "error", raw).alias("v_err"),
                    "style_id", "has_formula", "formula", "f_kind", "si", "f_ref")


def sheet_tail(parts: DataFrame) -> dict[str, DataFrame]:
    """What follows the cells of each sheet: merges, conditional formats, validations, hyperlinks."""
    schema = ("STRUCT<mergeCells: STRUCT<mergeCell: ARRAY<STRUCT<_ref: STRING>>>, "
              "conditionalFormatting: ARRAY<STRUCT<_sqref: STRING, cfRule: ARRAY<STRUCT<_type: STRING, _priority: INT, _operator: STRING, _stopIfTrue: STRING, _text: STRING, _dxfId: INT, formula: ARRAY<STRING>>>>>, "
              "dataValidations: STRUCT<dataValidation: ARRAY<STRUCT<_sqref: STRING, _type: STRING, _operator: STRING, _showErrorMessage: STRING, _errorStyle: STRING, formula1: STRING, formula2: STRING>>>, "
              "hyperlinks: STRUCT<hyperlink: ARRAY<STRUCT<_ref: STRING, _location: STRING, _display: STRING>>>>")
    tails = parts.filter(F.col("part").rlike(r"^xl/worksheets/[^/]+\.xml$") & F.col("piece").isin("tail", "whole"))
    body = F.regexp_replace(F.regexp_replace("xml", r"(?s)^.*</(?:\w+:)?sheetData\s*>", ""), r"</(?:\w+:)?worksheet\s*>\s*$", "")
    x = tails.select("wb_id", "part", F.from_xml(_wrapped(body, "tail"), schema, _XML).alias("x"))

    def ranges(df: DataFrame, ref: str) -> DataFrame:
        return (df.withColumn("range", F.explode(F.split(F.trim(ref), r"\s+"))).withColumn("b", a1.parse_a1(F.col("range")))
                .filter("b is not null").select(*[c for c in df.columns if c != ref], "range", "b.*"))

    merges = x.select("wb_id", "part", F.explode("x.mergeCells.mergeCell").alias("m")).select("wb_id", "part", F.col("m._ref").alias("ref"))
    cf = (x.select("wb_id", "part", F.explode("x.conditionalFormatting").alias("f"))
          .select("wb_id", "part", F.col("f._sqref").alias("ref"), F.explode("f.cfRule").alias("r"))
          .select("wb_id", "part", "ref", F.col("r._type").alias("rule_type"), F.col("r._priority").alias("priority"), F.col("r._operator").alias("operator"),
                  F.coalesce(F.col("r._stopIfTrue") == "1", F.lit(False)).alias("stop"), F.col("r.formula").alias("formulas")))
    dv = (x.select("wb_id", "part", F.explode("x.dataValidations.dataValidation").alias("d"))
          .select("wb_id", "part", F.col("d._sqref").alias("ref"), F.col("d._type").alias("type"), F.col("d._operator").alias("operator"),
                  F.coalesce(F.col("d._showErrorMessage") == "1", F.lit(False)).alias("alert"), F.col("d.formula1").alias("formula1"), F.col("d.formula2").alias("formula2")))
    links = (x.select("wb_id", "part", F.explode("x.hyperlinks.hyperlink").alias("h"))
             .select("wb_id", "part", F.col("h._ref").alias("ref"), F.col("h._location").alias("location"), F.col("h._display").alias("display")))
    return {"merges": ranges(merges, "ref"), "cf_rules": ranges(cf, "ref"), "validations": ranges(dv, "ref"), "hyperlinks": ranges(links, "ref")}


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name, folder, extension, size and time of every file; contents are not read. Folders named ``key=value`` give the value."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^[^=]*=", "")
    return files.select(name.alias("file_name"), folder.alias("folder"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.col("length").alias("size"), "modificationTime")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries that are missing or differ in size or digest. ``files`` carries path and content."""
    have = files.select("path", F.octet_length("content").alias("have_size"), F.sha2("content", 256).alias("have_sha"))
    problem = (F.when(F.col("have_size").isNull(), "MISSING").when((F.col("have_size") != F.col("size")) | (F.col("have_sha") != F.col("sha256")), "DIFFERS"))
    return manifest.join(have, "path", "left").withColumn("problem", problem).filter("problem is not null").select("path", "problem")
