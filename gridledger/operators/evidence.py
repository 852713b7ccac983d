"""Evidence about a workbook's layout and text: period headers, ranges, widths, references, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from ..functions import formula as X
from ..functions import text as T
from ..session import checkpointed
from .features import column_profile
from .grid import SHEET, contiguous_blocks, stab_join, used_range
from .skew import first_n, once
from .selection import cap_list

# ---------------------------------------------------------------- period headers


def _marked_runs(cells: DataFrame, line: list[str]) -> DataFrame:
    """Label cells of each line with the run they belong to.

    ``cells`` are the filled cells of lines (a sheet row or column): position, label text and
    v_num. Labels belong together when no other content lies between them and at most one blank
    does. Numeric years must step by 0 or 1 in one direction.
    """
    # labels repeat over sheets: each wording is read once
    said = once(cells.select(F.col("label").alias("_label")).distinct(), key=T.period_key(F.col("_label")))
    c = cells.join(said, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    w = Window.partitionBy(*line).orderBy("pos")
    year = F.when(F.col("key").isNull() & (F.col("v_num") == F.floor("v_num")) & F.col("v_num").between(1990, 2100), F.col("v_num").cast("int"))
    c = c.withColumn("nth", F.row_number().over(w)).withColumn("year", year).filter("key is not null or year is not null")
    c = c.withColumn("numeric", F.col("key").isNull())
    step = F.col("year") - F.lag("year").over(w)
    near = (F.col("nth") - F.lag("nth").over(w) == 1) & (F.col("pos") - F.lag("pos").over(w) <= 2) & (F.lag("numeric").over(w) == F.col("numeric"))
    c = c.withColumn("step", step).withColumn("hard", (~F.coalesce(near, F.lit(False)) | (F.col("numeric") & (F.abs("step") > 1))).cast("int"))
    c = c.withColumn("part", F.sum("hard").over(w))
    # A run takes the direction of its first step and ends at a step the other way, which gives the next run no
    # direction. Steps of one sign in a row are a block: its first step ends a run, unless the block before was a
    # single step that ended one itself; so behind a longer or the first block, every other single step does.
    upto = Window.partitionBy(*line, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = upto.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("sign", F.when(F.col("numeric") & (F.col("hard") == 0) & (F.col("step") != 0), F.col("step")))
    c = c.withColumn("begins", F.coalesce(F.col("sign") != F.coalesce(F.last("sign", ignorenulls=True).over(inner), F.lit(0)), F.lit(False)))
    c = c.withColumn("block", F.sum(F.col("begins").cast("int")).over(upto))
    c = c.withColumn("size", F.count("sign").over(Window.partitionBy(*line, "part", "block")))
    sure = F.when(F.col("begins") & ((F.col("size") > 1) | (F.col("block") == 1)), F.col("block"))
    turn = F.col("begins") & F.coalesce((F.col("block") - F.last(sure, ignorenulls=True).over(inner)) % 2 == 1, F.lit(False))
    c = c.withColumn("turn", turn.cast("int")).withColumn("run", F.sum(F.col("hard") + F.col("turn")).over(w))
    return c.withColumn("at", F.coalesce("key", F.struct(F.col("year").alias("y"), F.lit(12).alias("m"), F.lit(31).alias("d"))))


def period_series(cells: DataFrame, line: list[str], least: int = 3) -> DataFrame:
    """Runs of at least ``least`` period labels: extent, ends, gaps, and whether they are in order."""
    c = _marked_runs(cells, line)
    within = Window.partitionBy(*line, "run").orderBy("pos")
    before = F.lag("at").over(within)
    c = c.withColumn("up", (before < F.col("at")).cast("int")).withColumn("down", (before > F.col("at")).cast("int"))
    runs = c.groupBy(*line, "run").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n"), F.bool_or("numeric").alias("numeric"),
        F.min_by(F.coalesce("label", F.col("year").cast("string")), "pos").alias("first"), F.max_by(F.coalesce("label", F.col("year").cast("string")), "pos").alias("last"),
        F.min("year").alias("low"), F.max("year").alias("high"), F.coalesce(F.sum("up"), F.lit(0)).alias("ups"), F.coalesce(F.sum("down"), F.lit(0)).alias("downs"))
    runs = runs.filter((F.col("n") >= least) & ~(F.col("numeric") & (F.col("low") == F.col("high"))))
    return runs.select(*line, "start", "end", "n", "first", "last", "numeric", (F.col("end") - F.col("start") + 1 - F.col("n")).alias("n_gaps"),
                       ((F.col("ups") > 0) & (F.col("downs") > 0)).alias("out_of_order"))


def series_out_of_order(series: DataFrame) -> DataFrame:
    return series.filter("out_of_order")


def series_gaps(cells: DataFrame, values: DataFrame, line: list[str], below: int = 15, least: int = 3) -> DataFrame:
    """Blank header cells inside a series over a column that carries values within ``below`` rows.

    ``line`` ends with the header's row (row_no); ``values`` has the other line keys, row_no and pos.
    """
    sheet = [k for k in line if k != "row_no"]
    c = _marked_runs(cells, line)
    within = Window.partitionBy(*line, "run")
    c = c.withColumn("n", F.count(F.lit(1)).over(within)).filter(F.col("n") >= least)
    blank = (c.withColumn("before", F.lag("pos").over(within.orderBy("pos"))).filter(F.col("pos") - F.col("before") == 2)
             .select(*sheet, (F.col("pos") - 1).alias("pos"), F.col("row_no").alias("header_row"),
                     (F.col("row_no") + 1).alias("from_row"), (F.col("row_no") + below).alias("to_row")))
    hit = stab_join(values.select(*sheet, "pos", "row_no").distinct(), blank, [*sheet, "pos"], "row_no", "from_row", "to_row")
    return hit.select(*sheet, F.col("header_row").alias("row_no"), "pos").distinct()


def vertical_series(cells: DataFrame, horizontal: DataFrame, beside: DataFrame) -> DataFrame:
    """Vertical series on sheets with a horizontal one where at least half the filled cells beside are formulas.

    ``beside`` holds the filled cells with is_formula; those one column to the right count.
    """
    runs = period_series(cells, [*SHEET, "col_no"]).join(horizontal.select(*SHEET).distinct(), SHEET, "left_semi")
    right = beside.select(*SHEET, (F.col("col_no") - 1).alias("col_no"), "row_no", "is_formula")
    seen = stab_join(right, runs.select(*SHEET, "col_no", "start", "end"), [*SHEET, "col_no"], "row_no", "start", "end")
    share = seen.groupBy(*SHEET, "col_no", "start").agg(F.count(F.lit(1)).alias("beside"), F.count_if("is_formula").alias("formulas"))
    return (runs.join(share, [*SHEET, "col_no", "start"]).filter(F.col("formulas") * 2 >= F.col("beside"))
            .select(*SHEET, "col_no", "start", "end", "n", "beside", "formulas", "out_of_order"))


# What a marker may say has ended.
_ENDED = ["sheet", "model", "calculation", "calculations", "calc", "calcs", "tab", "worksheet", "section"]
_RULES = "<>-=*_#"  # drawn around a marker


def _is_end_marker(text: Column) -> Column:
    """The words END, OF and what ends, in this order and nothing else, with lines drawn around them at most."""
    low = F.lower(text)
    words = F.array_join(F.filter(F.split(low, "[^a-z]+"), lambda w: w != ""), " ")
    sayings = ["end", "end of", *[f"end {w}" for w in _ENDED], *[f"end of {w}" for w in _ENDED]]
    spaced = F.trim(F.regexp_replace(low, r"\s+", " "))
    around = F.replace(spaced, words, F.lit(""))  # the words stand together
    return words.isin(sayings) & (F.length(around) == F.length(spaced) - F.length(words)) & (F.translate(around, _RULES + " .!", "") == "") & ~F.substring(F.translate(spaced, _RULES + " ", ""), 1, 1).isin(".", "!")


def content_below_end(texts: DataFrame, filled_rows: DataFrame) -> DataFrame:
    """The last end marker of each sheet and the filled rows below it."""
    marks = texts.filter((F.length("v_text") <= 40) & _is_end_marker(F.col("v_text")))
    last = marks.groupBy(*SHEET).agg(F.max(F.struct("row_no", "col_no")).alias("m")).select(*SHEET, F.col("m.row_no").alias("marker_row"), F.col("m.col_no").alias("marker_col"))
    below = (filled_rows.select(*SHEET, "row_no").distinct().join(last, SHEET).filter(F.col("row_no") > F.col("marker_row"))
             .groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows_below"), F.min("row_no").alias("first_below"), F.max("row_no").alias("last_below")))
    return last.join(below, SHEET, "left").withColumn("rows_below", F.coalesce("rows_below", F.lit(0)))


# ---------------------------------------------------------------- formulas and statements

def _is_date_text(text: Column) -> Column:
    """Three numbers parted by points, slashes or dashes, the year first or last."""
    parts = F.split(text, "[./-]")
    digits = F.forall(parts, lambda p: (p != "") & (F.translate(p, "0123456789", "") == ""))
    short = lambda i: F.length(parts[i]) <= 2
    year_last = short(0) & short(1) & F.length(parts[2]).isin(2, 4)
    year_first = (F.length(parts[0]) == 4) & short(1) & short(2)
    return F.when((F.size(parts) == 3) & digits, year_last | year_first).otherwise(F.lit(False))


def date_literal_formulas(formulas: DataFrame) -> DataFrame:
    """Formulas with a date typed as text."""
    literals = F.regexp_extract_all("text", F.lit('"([^"]*)"'), 1)
    return formulas.filter(F.contains("text", F.lit('"')) & F.exists(literals, _is_date_text))


def rounding_claims(texts: DataFrame, formulas: DataFrame, shown: int | None = None) -> DataFrame:
    """Per sheet the typed statements that figures are rounded (all, or the first ``shown``), beside the formulas and those that round."""
    said = texts.filter(F.col("v_text").rlike(r"(?i)\bround(?:ed|s|ing)?\s+to\b")).select(*SHEET, "row_no", "col_no")
    counts = said.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("statements"))
    ref = a1.to_a1(F.col("row_no"), F.col("col_no"))
    few = (first_n(said, SHEET, ["row_no", "col_no"], shown).groupBy(*SHEET)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "col_no", ref.alias("ref")))), lambda x: x["ref"]), ";").alias("examples")))
    f = formulas.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_formulas"),
                                     F.count_if(F.col("text").rlike(r"(?i)\b(?:ROUND|ROUNDUP|ROUNDDOWN|MROUND)\s*\(")).alias("n_round"))
    return counts.join(few, SHEET).join(f, SHEET)


def oversized_range(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Sheets declared to the edge of the grid while their content ends earlier."""
    d = declared.join(used.select(*SHEET, F.col("r2").alias("last_row"), F.col("c2").alias("last_col")), SHEET)
    rows, cols = F.col("declared_rows") >= a1.MAX_ROW, F.col("declared_cols") >= a1.MAX_COL
    return d.filter(rows | cols).select(*SHEET, F.when(rows, F.floor(F.col("declared_rows") / F.col("last_row"))).alias("row_factor"),
                                        F.when(cols, F.floor(F.col("declared_cols") / F.col("last_col"))).alias("col_factor"))


def implicit_intersection(operands: DataFrame) -> DataFrame:
    """Multi-cell ranges used as one value from a cell they do not line up with: Excel shows #VALUE!.

    A column meets the cell's row, a row its column, a block nothing.
    """
    tall, wide = F.col("r2") > F.col("r1"), F.col("c2") > F.col("c1")
    meets = (F.when(tall & wide, F.lit(False)).when(tall, F.col("row_no").between(F.col("r1"), F.col("r2")))
             .when(wide, F.col("col_no").between(F.col("c1"), F.col("c2"))).otherwise(True))
    return operands.filter(~meets)


def dependents(flagged: DataFrame, operands: DataFrame, cap: int | None = None) -> DataFrame:
    """Formulas that read a flagged cell by a single-cell operand, all or the first ``cap``, beside the count."""
    single = operands.filter("r1 = r2 and c1 = c2").select("wb_id", F.col("ref_sheet").alias("sheet_idx"), F.col("r1").alias("row_no"), F.col("c1").alias("col_no"),
                                                          F.col("sheet_idx").alias("by_sheet"), F.col("row_no").alias("by_row"), F.col("col_no").alias("by_col"))
    hit = flagged.select(*SHEET, "row_no", "col_no").distinct().join(single, [*SHEET, "row_no", "col_no"])
    return cap_list(hit, [*SHEET, "row_no", "col_no"], ["by_sheet", "by_row", "by_col"], cap)


def uncached_ratio(cells: DataFrame, refuse: float = 0.5) -> DataFrame:
    """Share of formula cells without a cached value per workbook; half or more is refused."""
    d = cells.groupBy("wb_id").agg(F.count_if("has_formula").alias("formula_cells"), F.count_if(F.col("has_formula") & F.col("raw").isNull()).alias("uncached"))
    ratio = F.when(F.col("formula_cells") > 0, F.col("uncached") / F.col("formula_cells")).otherwise(0.0)
    return d.withColumn("ratio", F.round(ratio, 6)).withColumn("refused", ratio >= refuse)


# ---------------------------------------------------------------- extents and print


def freeze_extent(splits: DataFrame, rows: DataFrame, segments: DataFrame, key: str = "sheet_key", row_pt: float = 15.0, col_chars: float = 8.43) -> DataFrame:
    """Height and width locked by freeze panes; over 300 pt or 200 characters is excessive.

    ``splits`` has the locked rows and cols; ``rows`` the rows of own height (row_no, height,
    hidden); ``segments`` the painted columns. The rest counts with the default size.
    """
    h = (rows.join(splits.select(key, "rows"), key).filter(F.col("row_no") <= F.col("rows"))
         .groupBy(key).agg(F.sum(F.when(F.col("hidden"), 0.0).otherwise(F.col("height")) - row_pt).alias("dh")))
    inside = F.greatest(F.least(F.col("seg_hi"), F.col("cols")) - F.col("seg_lo") + 1, F.lit(0))
    w = (segments.join(splits.select(key, "cols"), key).filter(F.col("seg_lo") <= F.col("cols"))
         .groupBy(key).agg(F.sum(inside * (F.col("width") - col_chars)).alias("dw")))
    d = splits.join(h, key, "left").join(w, key, "left")
    tenth = lambda x: F.round(x.cast("decimal(20,6)"), 1).cast("double")
    d = d.withColumn("rows_pt", tenth(F.col("rows") * row_pt + F.coalesce("dh", F.lit(0.0)))).withColumn("cols_chars", tenth(F.col("cols") * col_chars + F.coalesce("dw", F.lit(0.0))))
    return d.select(key, "rows", "cols", "rows_pt", "cols_chars", ((F.col("rows_pt") > 300) | (F.col("cols_chars") > 200)).alias("excessive"))


def print_pages(sheets: DataFrame) -> DataFrame:
    """Pages tall and wide from content size, paper, margins, scale or fit.

    Reads height_pt, width_chars, paper_w, paper_h, landscape, margin_x, margin_y (inches, both
    sides together), fit_w and fit_h (null: any; both null and fit false: scale percent applies).
    """
    width = F.col("width_chars") * 5.25
    pw = F.when(F.col("landscape"), F.col("paper_h")).otherwise(F.col("paper_w"))
    ph = F.when(F.col("landscape"), F.col("paper_w")).otherwise(F.col("paper_h"))
    aw, ah = pw - 72 * F.col("margin_x"), ph - 72 * F.col("margin_y")
    fit = F.least(F.lit(1.0), F.coalesce(aw * F.col("fit_w") / width, F.lit(1.0)), F.coalesce(ah * F.col("fit_h") / F.col("height_pt"), F.lit(1.0)))
    scale = F.when(F.col("fit"), F.greatest(fit, F.lit(0.10))).otherwise(F.col("scale") / 100)
    d = sheets.filter((aw > 0) & (ah > 0) & (F.col("height_pt") > 0) & (width > 0))
    return d.withColumn("used_scale", F.round(scale, 4)).withColumn("pages_tall", F.round(F.col("height_pt") * scale / ah, 2)).withColumn("pages_wide", F.round(width * scale / aw, 2))


def column_fit(cells: DataFrame, cols: DataFrame, margin: float = 1.5) -> DataFrame:
    """Numbers wider than their column by more than ``margin`` characters, counted per column."""
    need = T.number_width(F.col("shown"))
    d = cells.join(cols.select(*SHEET, "col_no", "width"), [*SHEET, "col_no"]).withColumn("need", need)
    return (d.filter((F.col("width") > 0.5) & (F.col("need") > F.col("width") + margin)).groupBy(*SHEET, "col_no", "width")
            .agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.max("need"), 4).alias("widest")))


def hidden_ranges(segments: DataFrame, key: str = "sheet_key") -> DataFrame:
    """Runs of hidden rows or columns, marked grouped when all of it lies in an outline group."""
    w = Window.partitionBy(key).orderBy("seg_lo")
    h = segments.filter("hidden").withColumn("new", F.coalesce(F.lag("seg_hi").over(w) != F.col("seg_lo") - 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return h.groupBy(key, "run").agg(F.min("seg_lo").alias("first"), F.max("seg_hi").alias("last"), F.bool_and(F.col("outline_level") > 0).alias("grouped")).drop("run")


def validation_tally(validations: DataFrame) -> DataFrame:
    return validations.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n"), F.count_if("alert").alias("n_on"), F.count_if(~F.col("alert")).alias("n_off"),
                                           F.count_if(F.col("alert").isNull()).alias("n_unknown"))


def styled_empty_cells(cells: DataFrame) -> DataFrame:
    """Cells without a value but with visible style, per sheet."""
    empty = F.col("v_num").isNull() & F.col("v_text").isNull()
    styled = F.coalesce("bold", F.lit(False)) | F.col("fill_rgb").isNotNull() | (F.col("fmt_code") != "General") | F.coalesce("border", F.lit(False))
    return cells.filter(empty & styled).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- text


_TASK_WORDS = ["task", "question", "requirement", "requirements"]


def _task_kind(t: Column) -> Column:
    """How a trimmed line begins: with a word for a task, a question's number, a number in a list, or a bullet."""
    first = F.lower(F.substring_index(F.regexp_replace(t, r"\W+", " "), " ", 1))
    second = F.lower(F.get(F.split(F.regexp_replace(t, r"\W+", " "), " "), F.lit(1)))
    digits = lambda w: (w != "") & (F.translate(w, "0123456789", "") == "")
    worded = F.substring(t, 1, 1).rlike(r"\w")
    question = (F.substring(first, 1, 1) == "q") & (digits(F.substring(first, 2, 400)) | ((first == "q") & F.coalesce(digits(second), F.lit(False)) & F.substring(t, 2, 400).rlike(r"^\s")))
    after = F.ltrim(F.ltrim(t, F.lit("0123456789")))
    numbered = F.substring(t, 1, 1).between("0", "9") & F.substring(after, 1, 1).isin(".", ")") & F.substring(after, 2, 1).rlike(r"^\s$")
    bullet = F.substring(t, 1, 1).isin("-", "*") & F.substring(t, 2, 1).rlike(r"^\s$")
    return F.array_compact(F.array(F.when(worded & first.isin(_TASK_WORDS), "label"), F.when(worded & question, "question"), F.when(numbered, "numbered"), F.when(bullet, "bullet")))


def task_like_lines(texts: DataFrame, cap: int | None = None) -> DataFrame:
    """Cells, and rows of several cells read as one line, that look like tasks; repeats of a column dropped.

    All lines of a sheet, or the first ``cap``, are listed beside their count.
    """
    t = texts.withColumn("t", F.trim(F.regexp_replace("v_text", r"^\s+|\s+$", ""))).filter("t <> ''")
    alone = t.select(*SHEET, "row_no", "col_no", "t", F.lit(False).alias("joined"))
    row = t.groupBy(*SHEET, "row_no").agg(F.count(F.lit(1)).alias("n"), F.min("col_no").alias("col_no"), F.array_sort(F.collect_list(F.struct("col_no", "t"))).alias("ts")).filter("n >= 2")
    lines = alone.unionByName(row.select(*SHEET, "row_no", "col_no", F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("t"), F.lit(True).alias("joined")))
    hits = once(lines, kinds=_task_kind(F.col("t"))).select(*SHEET, "row_no", "col_no", "t", "joined", F.explode("kinds").alias("kind"))
    # the same line in the same column is one task: the first by row stands for it
    same = hits.groupBy(*SHEET, "col_no", "kind", "t").agg(F.min(F.struct("row_no", "joined")).alias("f"))
    return cap_list(same.select(*SHEET, "col_no", "kind", "t", "f.row_no", "f.joined"), SHEET, ["row_no", "col_no", "kind", "joined", "t"], cap)


def text_sheet_refs(texts: DataFrame, sheets: DataFrame) -> DataFrame:
    """Text cells that mention another sheet of their workbook, with the first such sheet.

    A workbook's sheet names are one small row, a few hundred names at most; each text is searched for them in
    place and stays one row.
    """
    named = (sheets.filter(F.length("sheet") > 0).groupBy("wb_id")
             .agg(F.sort_array(F.collect_list(F.struct(F.col("sheet_idx").alias("to_idx"), F.col("sheet").alias("to_sheet"), F.lower("sheet").alias("low")))).alias("names")))
    body = texts.select(*SHEET, "row_no", "col_no", F.lower("v_text").alias("_low")).join(named, "wb_id")
    said = F.filter("names", lambda n: (n["to_idx"] != F.col("sheet_idx")) & F.contains(F.col("_low"), n["low"]))
    found = once(body, first=F.get(said, F.lit(0))["to_sheet"])
    return found.filter("first IS NOT NULL").groupBy(*SHEET, "row_no", "col_no").agg(F.min("first").alias("to_sheet"))


def _tokens(text: Column) -> Column:
    """Lower-case words of two letters or more, and beside each long plural its singular."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)
    singular = F.transform(F.filter(words, lambda t: (F.length(t) > 3) & F.endswith(t, F.lit("s"))), lambda t: F.substr(t, F.lit(1), F.length(t) - 1))
    return F.concat(words, singular)


def sheet_keywords(titles: DataFrame, headers: DataFrame, texts: DataFrame, top: int | None = None) -> DataFrame:
    """The words of each sheet by weight, all or the ``top`` heaviest: a title word weighs 3, a header word 2, a text word 1."""
    parts = None
    for df, column, weight in ((titles, "sheet", 3), (headers, "label", 2), (texts, "v_text", 1)):
        one = df.select(*SHEET, F.explode(_tokens(F.col(column))).alias("word"), F.lit(weight).alias("w"))
        parts = one if parts is None else parts.unionByName(one)
    sums = parts.groupBy(*SHEET, "word").agg(F.sum("w").alias("weight"))
    return first_n(sums, SHEET, [F.desc("weight"), "word"], top)


def header_row(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first of a block's three top rows in which at least 60 % of the filled cells are text."""
    top = blocks.select(*SHEET, "r1", "c1", "c2", F.explode(F.sequence(F.col("r1"), F.least(F.col("r1") + 2, F.col("r2")))).alias("row_no"))
    # cells counted along the row: up to a block's last column, less those before its first
    marks = top.select(*SHEET, "row_no", "r1", "c1", F.inline(F.array(F.struct((F.col("c1") - 1).alias("col_no"), F.lit(-1).alias("sign")), F.struct(F.col("c2").alias("col_no"), F.lit(1).alias("sign")))))
    at = cells.select(*SHEET, "row_no", "col_no", F.lit(0).alias("sign"), F.lit(1).alias("filled"), F.coalesce(F.col("is_text"), F.lit(False)).cast("int").alias("text"))
    upto = Window.partitionBy(*SHEET, "row_no").orderBy("col_no", F.col("sign") != 0).rowsBetween(Window.unboundedPreceding, 0)
    along = at.unionByName(marks, allowMissingColumns=True).withColumn("n", F.sum("filled").over(upto)).withColumn("k", F.sum("text").over(upto))
    rows = along.filter("sign <> 0").groupBy(*SHEET, "r1", "c1", "row_no").agg(F.sum(F.col("sign") * F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.col("sign") * F.coalesce("k", F.lit(0))).alias("k"))
    ok = rows.filter(F.col("k") >= F.greatest(F.lit(1), F.floor(0.6 * F.col("n"))))
    return ok.groupBy(*SHEET, "r1", "c1").agg(F.min("row_no").alias("header_row"))


def sheet_dependencies(refs: DataFrame, own_sheet: Column) -> DataFrame:
    """Sheet to sheet edges with the number of formulas that read across."""
    d = refs.withColumn("src", own_sheet).filter(~F.col("external") & (F.lower("src") != F.lower("ref_sheet")))
    return d.select("wb_id", "src", F.col("ref_sheet").alias("dst"), "sheet_idx", "row_no", "col_no").distinct().groupBy("wb_id", "src", "dst").agg(F.count(F.lit(1)).alias("n_formulas"))


def properties_table(sheets: DataFrame, cells: DataFrame, formulas: DataFrame, merges: DataFrame) -> DataFrame:
    """One wide row per sheet; each part is aggregated before the parts meet."""
    used = used_range(cells).withColumn("used", a1.to_a1(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2"))).select(*SHEET, "used")
    counts = cells.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_cells"), F.count("v_err").alias("n_errors"), F.count_distinct("style_id").alias("n_styles"))
    f = formulas.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_formulas"), F.count_if(X.is_external(F.col("text"))).alias("n_external"))
    m = merges.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_merges"))
    out = sheets.select(*SHEET, "sheet", "state", "zoom").join(used, SHEET, "left").join(counts, SHEET, "left").join(f, SHEET, "left").join(m, SHEET, "left")
    return out.fillna(0, ["n_cells", "n_errors", "n_styles", "n_formulas", "n_external", "n_merges"])


def scan_structure(cells: DataFrame) -> DataFrame:
    """Used range, blocks with their header row, and the profile of every column, in one result.

    ``cells`` carries is_text, type and shown. Cells and blocks are read several times, so each is written once.
    """
    cells = checkpointed(cells.select(*SHEET, "row_no", "col_no", "is_text", "type", "shown"))
    used = used_range(cells).select(*SHEET, F.lit("used_range").alias("what"), a1.to_a1(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2")).alias("where"), F.lit(None).cast("string").alias("detail"))
    b = checkpointed(contiguous_blocks(cells).select(F.col("wb_id").cast("int"), F.col("sheet_idx").cast("int"), F.col("top").cast("int").alias("r1"), F.col("left").cast("int").alias("c1"),
                                                     F.col("bottom").cast("int").alias("r2"), F.col("right").cast("int").alias("c2")))
    head = header_row(cells, b)
    blocks = b.join(head, [*SHEET, "r1", "c1"], "left").select(*SHEET, F.lit("block").alias("what"), a1.to_a1(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2")).alias("where"),
                                                               F.col("header_row").cast("string").alias("detail"))
    prof = column_profile(cells).select(*SHEET, F.lit("column").alias("what"), a1.column_letters(F.col("col_no")).alias("where"), F.concat_ws(" | ", "inferred_type", F.col("non_null").cast("string"), "examples").alias("detail"))
    return used.unionByName(blocks).unionByName(prof)
