"""What formulas reach through names, tables and spans of sheets, as plain rectangles.

``resolved_references`` gives one row per rectangle a formula reads, directly or through defined names (of its own
sheet before those of the workbook, names inside names followed to the end, cycles included), columns of tables, and
3-D spans of sheets, which are cut into one row per sheet between their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formula as X
from ..session import checkpointed
from .features import name_uses
from .skew import once

CELL = ["wb_id", "sheet_idx", "row_no", "col_no"]
RECT = ["ref_sheet", "r1", "c1", "r2", "c2"]
_TABLE_ITEM = r"[\p{L}_\\][\p{L}\p{N}_.\\]*\[(?:[^\[\]]|\[[^\[\]]*\])*\]"
_WORKBOOK = -1  # scope of a name of the whole workbook


def expand_spans(refs: DataFrame, sheets: DataFrame) -> DataFrame:
    """``refs`` (wb_id, ref_sheet, ...) with every span First:Last replaced by the sheets from one to the other, in either order.

    A span with an end the workbook lacks gives nothing. ``sheets`` has wb_id, sheet_idx and sheet.
    """
    span = F.contains("ref_sheet", F.lit(":")) & ~F.contains("ref_sheet", F.lit("["))
    places = sheets.select("wb_id", F.col("sheet_idx").alias("_idx"), F.col("sheet").alias("_sheet"), F.lower("sheet").alias("_low"))
    ends = refs.filter(span).withColumn("_a", F.lower(F.substring_index("ref_sheet", ":", 1))).withColumn("_b", F.lower(F.substring_index("ref_sheet", ":", -1)))
    first = places.select("wb_id", F.col("_low").alias("_a"), F.col("_idx").alias("_from"))
    last = places.select("wb_id", F.col("_low").alias("_b"), F.col("_idx").alias("_to"))
    between = ends.join(first, ["wb_id", "_a"]).join(last, ["wb_id", "_b"]).withColumn("_idx", F.explode(F.sequence(F.least("_from", "_to"), F.greatest("_from", "_to"))))
    members = between.drop("ref_sheet").join(places.select("wb_id", "_idx", F.col("_sheet").alias("ref_sheet")), ["wb_id", "_idx"])
    return refs.filter(~span).unionByName(members.select(*refs.columns))


def table_references(texts: DataFrame, text: str, tables: DataFrame, columns: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, RECT) of the parts of tables that texts read.

    ``tables`` has wb_id, table, sheet and the data body r1, c1, r2, c2, with its header in the row above; ``columns``
    has wb_id, table, column, col_no. [Column] and [[First]:[Last]] are columns, [#This Row] and @ the formula's own
    row (``row_no`` of ``texts``), [#All] takes the header in, [#Headers] is the header alone, anything else the body.
    """
    item = F.explode(F.array_distinct(F.regexp_extract_all(X.mask_strings(F.col("_text")), F.lit(f"({_TABLE_ITEM})"), 1)))
    # a text is read once, and its items are joined back to the rows that hold it
    d = texts.select(F.col(text).alias("_text")).distinct().filter(F.contains("_text", F.lit("["))).select("_text", item.alias("_item"))
    inner = F.expr("substring(_item, instr(_item, '[') + 1, length(_item) - instr(_item, '[') - 1)")
    d = d.withColumn("_low", F.lower(F.substring_index("_item", "[", 1))).withColumn("_in", inner)
    named = F.filter(F.transform(F.split(F.regexp_replace("_in", "@", ""), r"[\[\],:]+"), lambda p: F.lower(F.trim(p))), lambda p: (p != "") & ~F.startswith(p, F.lit("#")))
    d = once(d, _names=named).withColumn("_first", F.get("_names", F.lit(0))).withColumn("_last", F.get("_names", F.size("_names") - 1)).drop("_names")
    d = texts.select(*{*keep, "wb_id", "row_no", text}).join(d, F.col(text) == F.col("_text"))
    low = F.lower("_in")
    t = tables.select("wb_id", F.lower("table").alias("_low"), F.col("sheet").alias("ref_sheet"), *[F.col(c).alias(f"_{c}") for c in RECT[1:]])
    cols = columns.select("wb_id", F.lower("table").alias("_low"), F.lower("column").alias("_name"), F.col("col_no").alias("_at"))
    d = d.join(t, ["wb_id", "_low"])
    for end in ("first", "last"):
        d = d.join(cols.select("wb_id", "_low", F.col("_name").alias(f"_{end}"), F.col("_at").alias(f"_{end}_at")), ["wb_id", "_low", f"_{end}"], "left")
    # a column the table does not have is an error, not a reference
    d = d.filter(F.col("_first").isNull() | (F.col("_first_at").isNotNull() & F.col("_last_at").isNotNull()))
    own = F.contains(low, F.lit("#this row")) | F.startswith(low, F.lit("@"))
    top = F.when(own, F.col("row_no")).when(F.contains(low, F.lit("#headers")) | F.contains(low, F.lit("#all")), F.col("_r1") - 1).otherwise(F.col("_r1"))
    bottom = F.when(own, F.col("row_no")).when(F.contains(low, F.lit("#headers")), F.col("_r1") - 1).otherwise(F.col("_r2"))
    return d.select(*keep, "ref_sheet", top.alias("r1"), F.least(F.coalesce("_first_at", "_c1"), F.coalesce("_last_at", "_c1")).alias("c1"),
                    bottom.alias("r2"), F.greatest(F.coalesce("_first_at", "_c2"), F.coalesce("_last_at", "_c2")).alias("c2"))


def name_closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(wb_id, src, dst): every name with every name it reaches, itself included; a cycle ends where it meets itself.

    Only newly found pairs are followed, each round from a written table; names of one workbook are few.
    """
    seen = checkpointed(nodes.select("wb_id", F.col("node").alias("src"), F.col("node").alias("dst")).distinct())
    fresh = seen
    step_edges = checkpointed(edges.select("wb_id", F.col("src").alias("dst"), F.col("dst").alias("next")).distinct())
    while True:
        step = fresh.join(step_edges, ["wb_id", "dst"]).select("wb_id", "src", F.col("next").alias("dst")).distinct()
        fresh = checkpointed(step.join(seen, ["wb_id", "src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(fresh))


def _node(name: Column, scope: Column) -> Column:
    return F.concat_ws("!", F.coalesce(scope, F.lit(_WORKBOOK)).cast("string"), F.lower(name))


def resolved_references(formulas: DataFrame, names: DataFrame, tables: DataFrame, columns: DataFrame, sheets: DataFrame) -> DataFrame:
    """(CELL, RECT, via) of every rectangle inside the workbook that a formula reads; ``via`` is cell, name or table.

    ``formulas`` has CELL and text, ``names`` wb_id, name, scope (sheet index, null for the workbook), definition.
    A reference of a name without a sheet is read on the sheet of the formula that uses it, at its written place. Names
    and columns are compared without regard to case; a formula that reads one rectangle in several ways has one row a way.
    """
    f = formulas.select(*CELL, "text")
    place = sheets.select("wb_id", "sheet_idx", F.col("sheet").alias("_own"))
    direct = X.references(f, "text", F.lit("")).filter(~F.col("external")).select(*CELL, *RECT, F.lit("cell").alias("via"))
    of_tables = table_references(f, "text", tables, columns, CELL).withColumn("via", F.lit("table"))
    # what each name reads itself, and which names it uses
    defined = names.select("wb_id", F.col("scope").alias("sheet_idx"), "name", "definition", _node(F.col("name"), F.col("scope")).alias("node"), F.lit(None).cast("int").alias("row_no"))
    inside = name_uses(defined.select("wb_id", "sheet_idx", "node", "definition"), names, "definition", ["wb_id", "sheet_idx", "node"])
    edges = inside.select("wb_id", F.col("node").alias("src"), _node(F.col("used_name"), F.col("used_scope")).alias("dst"))
    reads = X.references(defined.select("wb_id", "node", "definition"), "definition", F.lit("")).filter(~F.col("external")).select("wb_id", "node", *RECT)
    reads = reads.unionByName(table_references(defined, "definition", tables, columns, ["wb_id", "node", "row_no"]).select("wb_id", "node", *RECT))
    reached = name_closure(edges, defined).join(reads.withColumnRenamed("node", "dst"), ["wb_id", "dst"]).select("wb_id", F.col("src").alias("node"), *RECT).distinct()
    used = name_uses(f, names, "text", CELL).select(*CELL, _node(F.col("used_name"), F.col("used_scope")).alias("node"))
    by_name = used.join(reached, ["wb_id", "node"]).select(*CELL, *RECT, F.lit("name").alias("via"))
    # a rectangle without a sheet lies on the formula's own
    every = direct.unionByName(by_name).unionByName(of_tables).join(place, ["wb_id", "sheet_idx"], "left")
    every = every.withColumn("ref_sheet", F.when(F.col("ref_sheet") == "", F.col("_own")).otherwise(F.col("ref_sheet"))).drop("_own")
    return expand_spans(every, sheets).distinct()


def resolved_class(formulas: DataFrame, resolved: DataFrame, sheets: DataFrame) -> DataFrame:
    """(CELL, class): EXTERNAL before POINTER before CROSS before OWN, judged by what a formula reaches.

    A formula that is nothing but one reference or one name, and reaches another sheet, is a pointer.
    """
    place = sheets.select("wb_id", "sheet_idx", F.lower("sheet").alias("_own"))
    away = (resolved.join(place, ["wb_id", "sheet_idx"]).filter(F.lower("ref_sheet") != F.col("_own")).select(*CELL).distinct().withColumn("away", F.lit(True)))
    text_of, text = F.col("text"), F.col("_text")
    lone = X.formula_class(text, F.lit("\u0001")).isin("POINTER") | text.rlike(r"^\s*=?\s*[+@(\s]*[\p{L}_\\][\p{L}\p{N}_.\\]*[)\s]*$")
    # cells repeat texts: each is read once
    said = once(formulas.select(text_of.alias("_text")).distinct(), lone=lone, outside=X.is_external(text))
    d = formulas.select(*CELL, "text").join(away, CELL, "left").join(said, text_of.eqNullSafe(text), "left")
    return d.select(*CELL, F.when(F.col("outside"), "EXTERNAL").when(F.col("away") & F.col("lone"), "POINTER").when(F.col("away"), "CROSS").otherwise("OWN").alias("class"))
