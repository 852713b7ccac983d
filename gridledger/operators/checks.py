"""Deterministic checks over a whole corpus: each gives mistakes, and mistakes give verdicts.

A mistake is (wb_id, sheet, location, description, severity). Every check is a plan over
workbook relations; none visits one workbook at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from ..functions import colour as K
from ..functions import formula as X
from ..functions import numfmt as N
from ..functions import text as T
from ..session import checkpointed, texts_table
from . import graph
from .features import with_glyph_width
from .grid import SHEET, dyadic_tiles, group_cells, range_members, stab_join
from .skew import first_n, once

CELL = ["wb_id", "sheet_idx", "row_no", "col_no"]
MISTAKE = ["wb_id", "sheet", "location", "description", "severity"]


def sheet_name() -> Column:
    """Sheets of the corpus are called S0, S1, ... where no sheet table is at hand."""
    return F.concat(F.lit("S"), F.col("sheet_idx").cast("string"))


def mistakes(df: DataFrame, ref: Column | None, description: Column, severity: str = "major") -> DataFrame:
    sheet = F.col("sheet") if "sheet" in df.columns else sheet_name()
    return df.select("wb_id", sheet.alias("sheet"), a1.location(sheet, ref).alias("location"),
                     description.alias("description"), F.lit(severity).alias("severity"))


def cell_ref() -> Column:
    return a1.to_a1(F.col("row_no"), F.col("col_no"))


def rect_ref() -> Column:
    return a1.to_a1(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2"))


# ---------------------------------------------------------------- verdicts


def make_verdict(workbooks: DataFrame, found: DataFrame, check_no: int, cap: int | None = None, undecided: DataFrame | None = None) -> DataFrame:
    """One verdict per workbook: fail on any mistake, undecided where the check says so, else pass.

    ``cap`` says how many mistakes a report lists; without it, all.
    """
    listed = F.col("n") if cap is None else F.least(F.col("n"), F.lit(cap))
    counted = found.groupBy("wb_id").agg(F.count(F.lit(1)).alias("n"))
    v = workbooks.select("wb_id").distinct().join(counted, "wb_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if undecided is not None:
        v = v.join(undecided.select("wb_id", F.lit(True).alias("open")).distinct(), "wb_id", "left")
    else:
        v = v.withColumn("open", F.lit(None).cast("boolean"))
    decision = F.when(F.col("n") > 0, "fail").when(F.col("open"), "undecided").otherwise("pass")
    return v.select("wb_id", F.lit(check_no).alias("check_no"), decision.alias("decision"), F.col("n").alias("n_mistakes"),
                    listed.alias("n_listed"), (F.col("n") > listed).alias("truncated"),
                    F.when(decision == "undecided", "left to the judge").alias("llm_note"))


def listed_mistakes(found: DataFrame, cap: int | None = None) -> DataFrame:
    """All mistakes, or the first ``cap`` of each workbook by location, ranked."""
    return first_n(found, ["wb_id"], ["sheet", "location", "description"], cap)


def broken_contracts(verdicts: DataFrame) -> DataFrame:
    """Verdicts that break the contract; an empty result is the expectation."""
    passed, noted = F.col("decision") == "pass", F.col("llm_note").isNotNull()
    ok = (F.col("decision").isin("pass", "fail", "undecided") & ((F.col("n_mistakes") > 0) == (F.col("decision") == "fail"))
          & (~passed | (F.col("n_mistakes") == 0)) & (noted == (F.col("decision") == "undecided"))
          & (F.col("truncated") == (F.col("n_mistakes") > F.col("n_listed"))))
    return verdicts.filter(~F.coalesce(ok, F.lit(False)))


def defaults_used(notes: DataFrame, n: int | None = None) -> DataFrame:
    """Rule defaults applied (columns kind, example), each beside the count of its kind; with ``n``, the first of a kind."""
    count = notes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return first_n(notes.select("kind", "example"), ["kind"], ["example"], n).join(count, "kind")


class Registry:
    """Check number -> function of the corpus views giving a verdict table."""

    def __init__(self):
        self._checks: dict[int, Callable] = {}

    def add(self, number: int, fn: Callable) -> None:
        if number in self._checks:
            raise ValueError(f"check {number} is registered twice")
        self._checks[number] = fn

    def run(self, inputs, numbers: list[int] | None = None) -> DataFrame:
        chosen = sorted(self._checks) if numbers is None else numbers
        unknown = [n for n in chosen if n not in self._checks]
        if unknown:
            raise KeyError(f"no check registered under {unknown}")
        return reduce(DataFrame.unionByName, [self._checks[n](inputs) for n in chosen])


# ---------------------------------------------------------------- errors, names, names' use


def gap_cells(formulas: DataFrame, unsupported: list[str]) -> DataFrame:
    """Cells whose formula calls a function the value engine lacks: their error is not genuine."""
    lacks = F.array_intersect(X.functions_called(F.col("text")), F.array(*[F.lit(u) for u in unsupported]))
    return once(formulas, lacking=lacks).filter(F.size("lacking") > 0).select(*CELL, F.array_join("lacking", ",").alias("lacking"))


def formula_errors(cells: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every displayed error outside gap cells; and the workbooks whose only errors are gaps."""
    errors = cells.filter(F.col("v_err").isNotNull()).join(gaps.select(*CELL, F.lit(True).alias("gap")), CELL, "left")
    genuine = errors.filter(F.col("gap").isNull())
    found = mistakes(genuine, cell_ref(), F.concat(F.lit("shows "), F.col("v_err")))
    only_gaps = (errors.groupBy("wb_id").agg(F.count_if(F.col("gap").isNull()).alias("g")).filter("g = 0").select("wb_id"))
    return found, only_gaps


def used_names(names: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """(wb_id, name) of the names that a formula or a hidden name uses, directly or through other names.

    ``uses`` (wb_id, text) are the formulas of cells, conditional formats and validations.
    """
    tokens = names.select("wb_id", "name", F.explode(X.name_tokens(F.col("definition"))).alias("token"))
    target = names.select("wb_id", F.lower("name").alias("token"), F.col("name").alias("used"))
    key = lambda n: F.concat_ws("!", F.col("wb_id").cast("string"), n)
    edges = tokens.join(target, ["wb_id", "token"]).select(key(F.col("name")).alias("src"), key(F.col("used")).alias("dst"))
    users = names.filter("hidden").select(key(F.col("name")).alias("node"))
    if uses is not None:
        said = uses.select("wb_id", "text").distinct().select("wb_id", F.explode(X.name_tokens(F.col("text"))).alias("token")).distinct()
        users = users.union(said.join(target, ["wb_id", "token"]).select(key(F.col("used")))).distinct()
    used = graph.reachable(users, edges)
    return names.select("wb_id", "name", key(F.col("name")).alias("node")).join(used, "node", "left_semi").select("wb_id", "name").distinct()


def missing_sheets(names: DataFrame, sheets: DataFrame) -> DataFrame:
    """(wb_id, name) of names whose definition reads a sheet that their workbook (sheets: wb_id, sheet) lacks.

    A span of sheets Jan:Dec lacks one if it lacks an end. Other workbooks' sheets are not judged.
    """
    refs = X.references(names.select("wb_id", "name", "definition"), "definition", F.lit("")).filter(~F.col("external") & (F.col("ref_sheet") != ""))
    asked = refs.select("wb_id", "name", F.explode(F.split(F.lower("ref_sheet"), ":")).alias("low")).distinct()
    return asked.join(sheets.select("wb_id", F.lower("sheet").alias("low")).distinct(), ["wb_id", "low"], "left_anti").select("wb_id", "name").distinct()


def clean_names(names: DataFrame, uses: DataFrame | None = None, used: DataFrame | None = None, sheets: DataFrame | None = None) -> DataFrame:
    """Visible names that are broken, or used neither by a formula in ``uses`` nor by a hidden or used name.

    ``used`` is the result of ``used_names`` where it is at hand; with ``sheets`` (wb_id, sheet) a name that reads a
    sheet its workbook does not have is broken.
    """
    if used is None:
        used = used_names(names, uses)
    judged = (names.filter(~F.col("hidden"))
              .join(used.withColumn("is_used", F.lit(True)), ["wb_id", "name"], "left"))
    broken = (F.trim("definition") == "") | F.contains(X.mask_strings(F.col("definition")), F.lit("#REF!"))
    if sheets is not None:
        judged = judged.join(missing_sheets(names, sheets).withColumn("lost", F.lit(True)), ["wb_id", "name"], "left")
        broken = broken | F.coalesce("lost", F.lit(False))
    bad = judged.withColumn("why", F.when(broken, "broken").when(F.col("is_used").isNull(), "unused")).filter("why is not null")
    return bad.select("wb_id", F.lit("Name Manager").alias("sheet"), F.concat(F.lit("Name Manager: "), "name").alias("location"),
                      F.col("why").alias("description"), F.lit("major").alias("severity"))


# ---------------------------------------------------------------- yellow fills and their legend

# Words by what they say of a clause that names the colour. Matched as whole words, in any order.
_COLOUR = ["yellow", "yellows", "yellowish", "ffff00", "ffffff00"]
_FADED = ["light", "pale", "soft", "pastel", "faint", "muted", "cream", "creamy"]
_DENIAL = ["no", "not", "none", "without", "zero", "unused", "removed", "replaced", "cleared"]
_OPEN = ["tbd", "tbc", "tba", "todo", "todos", "placeholder", "placeholders", "wip", "unfinished", "incomplete", "draft", "drafts", "pending", "dummy", "preliminary"]
_OPEN_PAIRS = ["to do", "in progress", "be confirmed", "be determined", "be completed", "be filled", "be reviewed", "not yet", "still to", "needs review", "need review"]
_HABIT = ["annual", "annually", "quarterly", "monthly", "weekly", "regular", "regularly", "periodic", "periodically", "when", "whenever", "if"]
_MEANING = ["=", ":", "→", "–", "—", "is", "are", "means", "mean", "marks", "mark", "shows", "show", "contains", "contain", "denotes", "denote", "indicates", "indicate",
            "represents", "represent", "highlighted", "shaded", "filled", "marked", "coloured", "colored", "shown", "flagged"]


def _has(words: Column, table: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in table]))


def _pairs(words: Column) -> Column:
    """Neighbouring words as one text each."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), F.slice(words, 2, F.greatest(n - 1, F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))).otherwise(
        F.array().cast("array<string>"))


def _is(name: str) -> Callable:
    return lambda x: F.coalesce(x == name, F.lit(False))


def legend_class(text: Column) -> Column:
    """What a text says of yellow: NEGATED, WIP, DEFINES, MENTION, or null.

    Clauses are judged one by one as bags of words. A faded yellow is another colour. A denial
    outranks unfinished work, that a definition, unless the clause speaks of a habit.
    """
    def clause(c: Column) -> Column:
        words = F.regexp_extract_all(c, F.lit("([a-z0-9]+|[=:→–—])"), 1)
        pairs = _pairs(words)
        faded = F.filter(pairs, lambda p: F.substring_index(p, " ", 1).isin(_FADED) & F.substring_index(p, " ", -1).isin(_COLOUR))
        named = F.filter(words, lambda w: w.isin(_COLOUR))
        unfinished = (_has(words, _OPEN) | _has(pairs, _OPEN_PAIRS)) & ~_has(words, _HABIT)
        return (F.when(F.size(named) <= F.size(faded), F.lit(None)).when(_has(words, _DENIAL) & ~_has(pairs, ["not yet"]), "NEGATED")
                .when(unfinished, "WIP").when(_has(words, _MEANING), "DEFINES").otherwise("MENTION"))

    classes = F.transform(F.split(F.lower(text), r"[;\n]|\.\s"), clause)
    out = F.lit(None).cast("string")
    for name in ("MENTION", "NEGATED", "DEFINES", "WIP"):
        out = F.when(F.exists(classes, _is(name)), name).otherwise(out)
    return F.when(F.contains(F.lower(text), F.lit("yellow")) | F.contains(F.lower(text), F.lit("ffff00")), out)


def _unfinished(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    return _has(words, _OPEN) | _has(_pairs(words), _OPEN_PAIRS)


def yellow_fills(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Bright-yellow cells no legend explains; a placeholder under yellow fails despite one.

    ``cells`` carries fill_rgb and v_text. A legend sample - a yellow cell alone in its row
    whose text, or the text within two columns to its right, starts with the colour word - is
    documentation and never counts.
    """
    coloured = K.with_hsv(cells.filter(F.col("fill_rgb").isNotNull()), "fill_rgb")
    yellow = coloured.filter(K.bright_yellow(F.col("hue"), F.col("sat"), F.col("val"))).select(*CELL, "v_text")
    return mistakes(charged_yellow(yellow, texts), cell_ref(), F.col("why"))


def charged_yellow(yellow: DataFrame, texts: DataFrame) -> DataFrame:
    """The cells of ``yellow`` (v_text) that are charged, with the reason ``why``."""
    said = once(texts, says=legend_class(F.col("v_text"))).filter("says is not null")
    legend = said.groupBy("wb_id").agg(F.count_if(F.col("says") == "DEFINES").alias("defines"), F.count_if(F.col("says") == "WIP").alias("wip"))
    along = Window.partitionBy(*SHEET, "row_no").orderBy("col_no")
    alone = (F.coalesce(F.lag("col_no").over(along) != F.col("col_no") - 1, F.lit(True))
             & F.coalesce(F.lead("col_no").over(along) != F.col("col_no") + 1, F.lit(True)))
    label = (texts.filter(F.regexp_extract(F.lower("v_text"), r"^[\s#]*(?:bright[\s-]*)?([a-z0-9]+)", 1).isin(_COLOUR))
             .withColumn("at", F.explode(F.array(F.col("col_no"), F.col("col_no") - 1, F.col("col_no") - 2)))
             .select(*SHEET, "row_no", F.col("at").alias("col_no"), F.lit(True).alias("swatch")).distinct())
    judged = (yellow.withColumn("alone", alone).join(label, CELL, "left").join(legend, "wb_id", "left")
              .filter(~(F.col("alone") & F.coalesce("swatch", F.lit(False)))))
    excused = (F.coalesce("defines", F.lit(0)) > 0) & (F.coalesce("wip", F.lit(0)) == 0)
    placeholder = F.coalesce(_unfinished(F.col("v_text")), F.lit(False))
    why = F.when(placeholder, "placeholder under yellow").when(~excused, "bright yellow without a legend")
    return judged.withColumn("why", why).filter("why is not null")


# ---------------------------------------------------------------- font colours


def colour_mistakes(formulas: DataFrame, cf_colours: DataFrame | None = None) -> DataFrame:
    """Formula cells in the wrong font colour with the check that charges them: 49 black, 50 green, 51 red.

    ``cf_colours`` holds rule rectangles with cf_rgb; a rule that paints an accepted family
    excuses the cell, whether it fires or not.
    """
    # a corpus has few colours: each is judged once, the cells look theirs up
    colours = K.with_hsv(formulas.select("font_rgb").distinct(), "font_rgb")
    colours = once(colours, family=K.family(F.col("hue"), F.col("sat"), F.col("val"))).select(F.col("font_rgb").alias("_rgb"), "family")
    f = formulas.filter(~X.is_navigation(F.col("text"))).join(colours, F.col("font_rgb").eqNullSafe(F.col("_rgb"))).drop("_rgb")
    f = once(f, **{"class": X.formula_class(F.col("text"), sheet_name())})
    wrong = (f.withColumn("wanted", wanted_colour(F.col("class"))).filter("family <> wanted")
             .withColumn("check_no", colour_number(F.col("wanted"))))
    if cf_colours is not None:
        wrong = wrong.join(painted_well(wrong, cf_colours), CELL, "left_anti")
    return wrong.select(*CELL, "check_no", "class", "family", "wanted")


def painted_well(wrong: DataFrame, cf_colours: DataFrame) -> DataFrame:
    """The cells of ``wrong`` (wanted) under a rule that paints the wanted family."""
    # a rule of a family that no class calls for excuses nothing
    rules = once(K.with_hsv(cf_colours, "cf_rgb"), wanted=K.family(F.col("hue"), F.col("sat"), F.col("val"))).filter(F.col("wanted").isin("black", "green", "red"))
    rules = rules.select(*SHEET, "wanted", "r1", "c1", "r2", "c2").distinct()
    return range_members(wrong.select(*CELL, "wanted"), rules, [*SHEET, "wanted"]).select(*CELL).distinct()


def wanted_colour(kind: Column) -> Column:
    """The font colour a formula class calls for."""
    return F.when(kind == "OWN", "black").when(kind == "EXTERNAL", "red").otherwise("green")


def colour_number(wanted: Column) -> Column:
    """The check that charges a cell that should have this colour."""
    return F.when(wanted == "black", 49).when(wanted == "green", 50).otherwise(51)


def colour_check(wrong: DataFrame, check_no: int) -> DataFrame:
    """The mistakes of one colour check, cells of one description grouped to rectangles."""
    mine = wrong.filter(F.col("check_no") == check_no).withColumn(
        "why", F.concat(F.col("class"), F.lit(" formula in "), F.col("family"), F.lit(" font, expected "), F.col("wanted")))
    return mistakes(group_cells(mine, [*SHEET, "why"]), rect_ref(), F.col("why"))


# ---------------------------------------------------------------- views


def consistent_zoom(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sheets off the workbook's most common zoom (ties: the earliest sheet's), and undecided workbooks.

    A zoom that is null could not be read; it decides nothing unless the rest is one level.
    """
    levels = sheets.filter(F.col("zoom").isNotNull()).groupBy("wb_id", "zoom").agg(
        F.count(F.lit(1)).alias("n"), F.min("sheet_idx").alias("first"))
    mode = levels.groupBy("wb_id").agg(F.max_by("zoom", F.struct(F.col("n"), -F.col("first"))).alias("mode"), F.count(F.lit(1)).alias("n_levels"))
    off = sheets.join(mode, "wb_id").filter(F.col("zoom") != F.col("mode"))
    found = off.select("wb_id", "sheet", F.col("sheet").alias("location"),
                       F.concat(F.lit("opens at "), F.col("zoom").cast("string"), F.lit("%, most sheets at "), F.col("mode").cast("string"), F.lit("%")).alias("description"),
                       F.lit("minor").alias("severity"))
    per = sheets.groupBy("wb_id").agg(F.count(F.lit(1)).alias("n_sheets"), F.count_if(F.col("zoom").isNull()).alias("unknown"))
    undecided = per.filter("unknown > 0 and n_sheets > 1").select("wb_id")
    return found, undecided


def active_cell_a1(sheets: DataFrame, selections: DataFrame) -> DataFrame:
    """Sheets whose cursor is not A1: the last selection of the active pane, A1 when it has none."""
    # one selection of each pane is left before panes meet their sheets
    panes = selections.groupBy(*SHEET, "pane").agg(F.max_by("active_cell", "pos").alias("active_cell"), F.max("pos").alias("pos"))
    s = panes.join(sheets.select(*SHEET, "active_pane"), SHEET).filter(F.col("pane") == F.col("active_pane"))
    last = s.groupBy(*SHEET).agg(F.max_by("active_cell", "pos").alias("cursor"))
    d = sheets.join(last, SHEET, "left").withColumn("cursor", F.coalesce("cursor", F.lit("A1"))).filter("cursor <> 'A1'")
    return mistakes(d, F.col("cursor"), F.lit("active cell is not A1"), "minor")


def hidden_sheets(sheets: DataFrame) -> DataFrame:
    d = sheets.filter(F.col("state") != "visible")
    return d.select("wb_id", "sheet", F.col("sheet").alias("location"), F.concat(F.lit("sheet is "), "state").alias("description"), F.lit("major").alias("severity"))


def hidden_segments(segments: DataFrame, key: str = "sheet_key") -> DataFrame:
    """Hidden row or column segments, except those of an outline group hidden as a whole.

    ``segments`` are disjoint (seg_lo, seg_hi, hidden, outline_level). The group of a segment
    at level L is the unbroken run of segments at level L or deeper. Levels stop at 7.
    """
    levels = segments.filter("outline_level > 0").withColumn("level", F.explode(F.sequence(F.lit(1), F.col("outline_level"))))
    w = Window.partitionBy(key, "level").orderBy("seg_lo")
    levels = (levels.withColumn("starts", F.coalesce(F.lag("seg_hi").over(w) != F.col("seg_lo") - 1, F.lit(True)).cast("int"))
              .withColumn("grp", F.sum("starts").over(w)))
    group = Window.partitionBy(key, "level", "grp")
    groups = (levels.withColumn("whole", F.bool_and("hidden").over(group)).filter("whole and level = outline_level")
              .select(key, "outline_level", "seg_lo"))
    bad = segments.filter("hidden").join(groups, [key, "outline_level", "seg_lo"], "left_anti")
    v = Window.partitionBy(key).orderBy("seg_lo")
    return (bad.withColumn("new", F.coalesce(F.lag("seg_hi").over(v) != F.col("seg_lo") - 1, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("new").over(v)).groupBy(key, "run")
            .agg(F.min("seg_lo").alias("first"), F.max("seg_hi").alias("last")).drop("run"))


# ---------------------------------------------------------------- number display


def _by_code(cells: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns of the format code, computed on the distinct codes: a corpus has few."""
    codes = once(cells.select("fmt_code").distinct(), **columns).withColumnRenamed("fmt_code", "_code")
    return cells.join(codes, F.col("fmt_code").eqNullSafe(F.col("_code"))).drop("_code")


def shown_negatives(cells: DataFrame) -> DataFrame:
    """Negatives not in parentheses. ``cells`` carries v_num and fmt_code; what displays as zero is not judged."""
    v, code = F.col("v_num"), F.col("fmt_code")
    d = (_by_code(cells.filter((v <= -1e-6) & F.col("v_err").isNull()), kind=N.negative_class(code))
         .filter(F.col("kind").isin("minus", "unsigned", "mixed") & ~N.rounds_to_zero(v, code)))
    return mistakes(group_cells(d, [*SHEET, "kind"]), rect_ref(), F.concat(F.lit("negative shown "), F.col("kind")))


def shown_zeros(cells: DataFrame) -> DataFrame:
    """Exact zeros shown as a digit or text. Blank and dash pass; a sheet with zeros switched off blanks the rest.

    ``cells`` carries show_zeros; the switch leaves formats with a zero section alone.
    """
    code = F.col("fmt_code")
    hidden = ~F.col("show_zeros") & (F.size(N.numeric_sections(code)) < 3)
    d = (_by_code(cells.filter((F.col("v_num") == 0) & F.col("v_err").isNull()), kind=N.zero_class(code))
         .filter(F.col("kind").isin("digit", "text") & ~hidden))
    return mistakes(group_cells(d, [*SHEET, "kind"]), rect_ref(), F.concat(F.lit("zero shown as "), F.col("kind")))


def concealed_cells(cells: DataFrame) -> DataFrame:
    """Populated cells nobody can read: text the colour of its ground, or a format that prints nothing."""
    pairs = K.with_contrast(cells.select("text_rgb", "bg_rgb").distinct()).select("text_rgb", "bg_rgb", "conceals")
    d = cells.join(pairs, ["text_rgb", "bg_rgb"], "left").withColumn(
        "why", F.when(F.col("conceals"), "text the colour of its background").when(N.prints_nothing(F.col("fmt_code")), "number format prints nothing"))
    return mistakes(group_cells(d.filter("why is not null"), [*SHEET, "why"]), rect_ref(), F.col("why"))


# ---------------------------------------------------------------- widths and heights

_MDW = 7
_MARGIN_PX = 5
_DEFAULT_WIDTH = 9.14  # of a column that lists none, padding included


def column_px(width: Column) -> Column:
    """Stored width in characters to pixels at 96 dpi for a normal font with 7-pixel digits."""
    return F.floor((256 * width + int(128 / _MDW)) / 256 * _MDW).cast("int")


def narrow_number_cells(cells: DataFrame, cols: DataFrame, tolerance_px: float = 2.0) -> DataFrame:
    """Numbers whose text needs more than the column gives: Excel shows ####. ``cells`` carries shown.

    With face, size, bold and shrink beside it, each cell is measured in its own font, and a cell that shrinks its text
    to fit is never too narrow.
    """
    if {"face", "size", "bold", "shrink"} <= set(cells.columns):
        cells = with_glyph_width(cells.filter(~F.coalesce("shrink", F.lit(False))), "shown", "face", "size", "bold", "_need")
    else:
        cells = cells.withColumn("_need", T.number_width(F.col("shown")))
    need = F.col("_need") * _MDW
    d = (cells.join(cols.select(*SHEET, "col_no", "width"), [*SHEET, "col_no"])
         .filter(need - (column_px(F.col("width")) - _MARGIN_PX) > tolerance_px))
    return mistakes(group_cells(d), rect_ref(), F.lit("column too narrow for its number"))


def cut_off_text(texts: DataFrame, cols: DataFrame, tolerance_px: float = 2.0) -> DataFrame:
    """Unwrapped text stopped by a filled neighbour before it ends.

    The room of a text is its own column and the empty ones up to the next filled cell, a
    difference of two running sums over the sheet's columns.
    """
    along = Window.partitionBy(*SHEET, "row_no").orderBy("col_no")
    upto = Window.partitionBy(*SHEET).orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = cols.withColumn("px", column_px(F.col("width"))).withColumn("upto", F.sum("px").over(upto)).select(*SHEET, "col_no", "px", "upto")
    # from here on the width stands for the text
    d = once(texts, need=T.text_width(F.col("v_text")) * _MDW).drop("v_text")
    d = d.withColumn("stop", F.lead("col_no").over(along)).filter("stop is not null")
    right = sums.select(*SHEET, F.col("col_no").alias("stop_at"), F.col("upto").alias("upto_stop"))
    d = (d.withColumn("stop_at", F.col("stop") - 1).join(sums, [*SHEET, "col_no"]).join(right, [*SHEET, "stop_at"])
         .withColumn("room", F.col("upto_stop") - F.col("upto") + F.col("px") - _MARGIN_PX))
    d = d.filter(F.col("need") - F.col("room") > tolerance_px)
    return mistakes(d, cell_ref(), F.lit("text cut off by its neighbour"))


def wrapped(texts: DataFrame, cols: DataFrame) -> DataFrame:
    """``texts`` with ``lines``, wrapped at the room of each text's own column; a column without room shows one line."""
    own = cols.select(*SHEET, "col_no", F.col("width").alias("_width"))
    room = (column_px(F.coalesce("_width", F.lit(_DEFAULT_WIDTH))) - _MARGIN_PX) / _MDW
    d = texts.join(own, [*SHEET, "col_no"], "left").withColumn("_room", room)
    return d.withColumn("lines", F.when(F.col("_room") <= 0, 1).otherwise(T.wrap_lines(F.col("v_text"), F.col("_room")))).drop("_width", "_room")


def short_wrapped_rows(texts: DataFrame, rows: DataFrame, cols: DataFrame, font_pt: float = 11.0) -> DataFrame:
    """Wrapped text with more lines than its row of custom height shows, by over half a line.

    Text wraps at the width of its column in ``cols``, or at Excel's default where the column is not listed.
    """
    line = 1.3 * font_pt
    d = wrapped(texts.join(rows.filter("custom").select(*SHEET, "row_no", "height"), [*SHEET, "row_no"]), cols)
    return mistakes(d.filter(F.col("lines") * line - F.col("height") > 0.5 * line), cell_ref(), F.lit("wrapped text taller than its row"))


def width_runs(segments: DataFrame, key: str = "sheet_key") -> DataFrame:
    """Maximal runs of adjacent columns of one width: (first, last, width, n_cols)."""
    w = Window.partitionBy(key).orderBy("seg_lo")
    new = ~((F.lag("seg_hi").over(w) == F.col("seg_lo") - 1) & (F.round(F.lag("width").over(w), 2) == F.round("width", 2)))
    return (segments.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
            .groupBy(key, "run").agg(F.min("seg_lo").alias("first"), F.max("seg_hi").alias("last"), F.max("width").alias("width"))
            .withColumn("n_cols", F.col("last") - F.col("first") + 1).drop("run"))


def wide_columns(segments: DataFrame, need: DataFrame, key: str = "sheet_key", cap: float = 80.0, ratio: float = 2.5) -> DataFrame:
    """Columns wider than the cap and twice their need; and runs 2.5 times as wide as the runs on both sides.

    A neighbour run has at least two columns and a width of at least four. ``need`` gives the
    widest content per sheet and first column of a segment (col, need).
    """
    runs = width_runs(segments, key)
    before = Window.partitionBy(key).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy("first").rowsBetween(1, Window.unboundedFollowing)
    peer = F.when((F.col("n_cols") >= 2) & (F.col("width") >= 4), F.struct("width", "n_cols"))
    runs = (runs.withColumn("peer", peer).withColumn("left", F.last("peer", ignorenulls=True).over(before))
            .withColumn("right", F.first("peer", ignorenulls=True).over(after)))
    outlier = ((F.col("n_cols") >= 2) & (F.col("width") >= ratio * F.col("left.width")) & (F.col("width") >= ratio * F.col("right.width"))
               & (F.col("n_cols") <= F.greatest("left.n_cols", "right.n_cols")))
    needed = stab_join(need, runs.select(key, "first", "last"), [key], "col", "first", "last")
    needed = needed.groupBy(key, "first", "last").agg(F.max("need").alias("need"))
    judged = runs.join(needed, [key, "first", "last"], "left").withColumn("need", F.coalesce("need", F.lit(0.0)))
    why = (F.when((F.col("width") > cap) & (F.col("width") > 2 * F.col("need")), "wider than the cap")
           .when(F.coalesce(outlier, F.lit(False)) & (F.col("need") < 0.5 * F.col("width")), "wide outlier"))
    return judged.withColumn("why", why).filter("why is not null").select(key, "first", "last", "width", "need", "why")


def tall_rows(rows: DataFrame, texts: DataFrame, cols: DataFrame, cap_pt: float = 60.0, factor: float = 2.0, font_pt: float = 11.0) -> DataFrame:
    """Rows of custom height over the cap and more than twice the lines of their content, wrapped as in ``short_wrapped_rows``."""
    line = 1.3 * font_pt
    tall = rows.filter(F.col("custom") & (F.col("height") > cap_pt))
    lines = (wrapped(texts.join(tall.select(*SHEET, "row_no"), [*SHEET, "row_no"], "left_semi"), cols)
             .groupBy(*SHEET, "row_no").agg(F.max("lines").alias("lines")))
    d = tall.join(lines, [*SHEET, "row_no"], "left").withColumn("need", F.coalesce("lines", F.lit(1)) * line)
    d = d.filter(F.col("height") > factor * F.col("need"))
    ref = F.concat(F.col("row_no").cast("string"), F.lit(":"), F.col("row_no").cast("string"))
    return mistakes(d, ref, F.lit("row taller than its content needs"), "minor")


# ---------------------------------------------------------------- ranges, files, formulas


def merged_cells(merges: DataFrame) -> DataFrame:
    """Merged ranges of more than one cell, outside the Instructions sheet."""
    d = merges.filter(((F.col("r1") != F.col("r2")) | (F.col("c1") != F.col("c2"))) & (F.lower(F.trim("sheet")) != "instructions"))
    return mistakes(d, rect_ref(), F.lit("merged cells"), "minor")


def content_kind(head: Column) -> Column:
    """The container a file's first eight bytes announce."""
    return (F.when(F.startswith(F.hex(head), F.lit("504B0304")), "zip").when(F.hex(F.substring(head, 1, 8)) == "D0CF11E0A1B11AE1", "ole2").otherwise("text"))


def extension_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))


def file_extensions(files: DataFrame) -> DataFrame:
    """Files whose name is not .xlsx / .xlsm, or whose extension disagrees with the content.

    ``files`` carries file_name, head (first bytes) and has_macros (a macro part in the package).
    """
    d = files.withColumn("ext", extension_of(F.col("file_name"))).withColumn("kind", content_kind(F.col("head")))
    why = (F.when(~F.col("ext").isin(".xlsx", ".xlsm"), "not an Excel workbook name")
           .when(F.col("kind") != "zip", F.concat(F.lit("content is "), "kind"))
           .when((F.col("ext") == ".xlsx") & F.col("has_macros"), "macros in an .xlsx")
           .when((F.col("ext") == ".xlsm") & ~F.col("has_macros"), "no macros in an .xlsm"))
    d = d.withColumn("why", why).filter("why is not null")
    return d.select("wb_id", F.lit("").alias("sheet"), F.col("file_name").alias("location"), F.col("why").alias("description"), F.lit("major").alias("severity"))


# Functions that recalculate on every change.
VOLATILE = ("INDIRECT", "OFFSET", "TODAY", "NOW", "RAND", "RANDBETWEEN", "INFO", "CELL")


def precedent_ranges(formulas: DataFrame) -> DataFrame:
    """Distinct rectangles the formulas read, by workbook and sheet name."""
    refs = X.references(formulas.select("wb_id", "sheet_idx", "text"), "text", sheet_name())
    return refs.filter(~F.col("external")).select("wb_id", F.lower("ref_sheet").alias("sheet_key"), "r1", "c1", "r2", "c2").distinct()


def volatile_cells(formulas: DataFrame) -> DataFrame:
    """Calls of volatile functions. A lone TODAY() or NOW() that nothing reads is a date stamp and passes."""
    called = F.array_intersect(X.functions_called(F.col("_text")), F.array(*[F.lit(x) for x in VOLATILE]))
    # cells repeat texts: each is read once
    texts = formulas.select(F.col("text").alias("_text")).distinct().filter(F.col("_text").rlike("(?i)" + "|".join(VOLATILE)))
    said = once(once(texts, called=called).filter(F.size("called") > 0), stamp=X.date_stamp(F.col("_text")))
    d = formulas.join(said, F.col("text") == F.col("_text")).drop("_text").withColumn("sheet_key", F.lower(sheet_name()))
    stamps = d.filter("stamp")
    # only workbooks with a stamp are parsed; written, as the join reads the rectangles for their sizes and for the pairs
    stamped = formulas.join(stamps.select("wb_id").distinct(), "wb_id", "left_semi")
    precedents = checkpointed(precedent_ranges(stamped))
    read = range_members(stamps.select(*CELL, "sheet_key"), precedents, ["wb_id", "sheet_key"]).select(*CELL).distinct()
    bad = d.filter(~F.col("stamp")).select(*CELL, "called").unionByName(stamps.join(read, CELL, "left_semi").select(*CELL, "called"))
    bad = bad.withColumn("why", F.concat(F.lit("calls "), F.array_join("called", ", ")))
    return mistakes(group_cells(bad, [*SHEET, "why"]), rect_ref(), F.col("why"))


def formula_sites(cells: DataFrame, names: DataFrame | None = None, rules: DataFrame | None = None, validations: DataFrame | None = None) -> DataFrame:
    """Every place a formula stands: cells, used names, conditional formats, validations."""
    out = cells.select("wb_id", sheet_name().alias("sheet"), cell_ref().alias("ref"), F.lit("cell").alias("site"), "text")
    if names is not None:
        out = out.unionByName(names.select("wb_id", F.lit("Name Manager").alias("sheet"), F.col("name").alias("ref"), F.lit("name").alias("site"), F.col("definition").alias("text")))
    for table, site in ((rules, "conditional format"), (validations, "validation")):
        if table is not None:
            out = out.unionByName(table.select("wb_id", sheet_name().alias("sheet"), rect_ref().alias("ref"), F.lit(site).alias("site"), "text"))
    return out


def whole_column_sites(sites: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Sites that write A:A or 1:1. With ``used`` (wb_id, name), names that nothing uses are not charged."""
    d = sites.filter(X.has_whole_form(F.col("text")))
    if used is not None:
        named = used.select("wb_id", F.col("name").alias("ref"), F.lit("name").alias("site")).distinct()
        d = d.filter("site <> 'name'").unionByName(d.filter("site = 'name'").join(named, ["wb_id", "ref", "site"], "left_semi").select(*d.columns))
    return mistakes(d, F.col("ref"), F.concat("site", F.lit(" reads a whole column or row")), "minor")


def external_sites(sites: DataFrame, links: DataFrame | None = None, waived: DataFrame | None = None) -> DataFrame:
    """Sites that read another workbook, and declared links; tasks that require links are waived."""
    d = sites.filter(X.is_external(F.col("text")))
    found = mistakes(d, F.col("ref"), F.concat("site", F.lit(" reads another workbook")))
    if links is not None:
        found = found.unionByName(links.select("wb_id", F.lit("").alias("sheet"), F.col("target").alias("location"),
                                               F.lit("external link declared").alias("description"), F.lit("major").alias("severity")))
    return found if waived is None else found.join(waived.select("wb_id").distinct(), "wb_id", "left_anti")


# ---------------------------------------------------------------- calculation mode, writer


def dependency_edges(formulas: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Edges src -> dst of the calculation graph with their wb_id: formula cells and shared tiles as nodes.

    ``resolved`` (cells with ref_sheet and rectangle) takes the place of the references in the texts, so that names,
    tables and spans of sheets count; see ``resolve.resolved_references``.

    A range is not expanded to its cells. It is cut into power-of-two tiles of rows and columns;
    equal tiles of different formulas are one node, so growing ranges SUM(B$1:Bn) stay near
    linear, and a cell finds its tiles by equal keys. Only formula cells can be on a cycle, so
    tiles lead to formula cells alone.
    """
    cell = F.concat_ws("!", F.col("wb_id").cast("string"), F.col("sheet_key"), F.col("row_no").cast("string"), F.col("col_no").cast("string"))
    own = formulas.withColumn("sheet_key", F.lower(sheet_name())).withColumn("node", cell)
    if resolved is None:
        plain = own.withColumn("text", X.without_address_calls(F.col("text")))
        refs = X.references(plain.select("wb_id", "sheet_idx", "node", "text"), "text", sheet_name()).filter(~F.col("external"))
    else:
        refs = resolved.join(own.select(*CELL, "node"), CELL)
    refs = refs.withColumn("ref_key", F.lower("ref_sheet"))
    tile = ["level", "k", "c_level", "c_k"]
    tiles = dyadic_tiles(refs.select("wb_id", "node", "ref_key", "r1", "c1", "r2", "c2"))
    tiles = tiles.withColumn("block", F.concat_ws("#", F.col("wb_id").cast("string"), "ref_key", *[F.col(c).cast("string") for c in tile]))
    into = tiles.select("wb_id", F.col("node").alias("src"), F.col("block").alias("dst")).distinct()
    blocks = tiles.select("wb_id", F.col("ref_key").alias("sheet_key"), *tile, "block").distinct()
    used = blocks.agg(F.collect_set(F.struct("level", "c_level"))).scalar()
    places = own.select("wb_id", "sheet_key", "row_no", "col_no", "node").withColumn("s", F.explode(used)).select("*", "s.*")
    for level, place, at in (("level", "k", "row_no"), ("c_level", "c_k", "col_no")):
        places = places.withColumn(place, F.floor((F.col(at) - 1) / F.pow(F.lit(2.0), level)))
    out = places.join(blocks, ["wb_id", "sheet_key", *tile]).select("wb_id", F.col("block").alias("src"), F.col("node").alias("dst")).distinct()
    return into.unionByName(out)


def _tiles_at_most(lo: str, hi: str) -> Column:
    """An upper bound of the power-of-two blocks that tile lo..hi."""
    n = F.col(hi) - F.col(lo) + 1
    return F.least(n, 2 * F.floor(F.log2(n)) + 1)


def circular_cells(formulas: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Formula cells on a cycle, with wb_id and sheet key; ``resolved`` as in ``dependency_edges``.

    No formula leaves its workbook, and what reads nothing is on no cycle. So the rectangles that formulas read, written
    once, are dealt into buckets of workbooks, and tiles and cycles of a bucket of bounded size are found in one call.
    Workbooks of larger buckets go through edge tables.
    """
    kind = formulas.schema["wb_id"].dataType.simpleString()
    formulas = checkpointed(formulas.select(*CELL, *(["text"] if resolved is None else [])))
    own = formulas.withColumn("sheet_key", F.lower(sheet_name()))
    if resolved is None:
        # each text is read once, whatever number of cells repeats it
        texts = once(formulas.filter(F.col("text").isNotNull()).select("text").distinct(), bare=X.without_address_calls(F.col("text")))
        read = X.references(texts, "bare", F.lit(None).cast("string")).filter(~F.coalesce("external", F.lit(False)))
        read = texts_table(read.select(F.col("text").alias("_text"), F.lower("ref_sheet").alias("there"), "r1", "c1", "r2", "c2").distinct(), "_text")
        refs = own.join(read, F.col("text") == F.col("_text")).withColumn("ref_key", F.coalesce("there", "sheet_key"))
    else:
        refs = resolved.join(own.select(*CELL, "sheet_key"), CELL).withColumn("ref_key", F.lower("ref_sheet"))
    on_grid = F.col("row_no").between(1, a1.MAX_ROW) & F.col("col_no").between(1, a1.MAX_COL) & (F.col("r1") >= 1) & (F.col("c1") >= 1)
    refs = refs.select("wb_id", "sheet_key", F.col("row_no").cast("int"), F.col("col_no").cast("int"), "ref_key", F.col("r1").cast("int"), F.col("c1").cast("int"),
                       F.least("r2", F.lit(a1.MAX_ROW)).cast("int").alias("r2"), F.least("c2", F.lit(a1.MAX_COL)).cast("int").alias("c2"))
    refs = checkpointed(refs.filter(on_grid & F.col("wb_id").isNotNull() & F.col("sheet_key").isNotNull() & F.col("ref_key").isNotNull() & (F.col("r1") <= F.col("r2")) & (F.col("c1") <= F.col("c2"))))
    books = checkpointed(refs.groupBy("wb_id").agg(F.sum(_tiles_at_most("r1", "r2") * _tiles_at_most("c1", "c2")).alias("n")))
    total = books.agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("wb_id"), F.lit(total // graph.BUCKET_TILES + 1))
    crowded = books.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("all")).filter(F.col("all") > graph.CALL_TILES)
    large = checkpointed(books.withColumn("bucket", bucket).join(crowded, "bucket", "left_semi").select("wb_id"))
    out = f"wb_id {kind}, sheet_key string, row_no int, col_no int"
    found = refs.join(large, "wb_id", "left_anti").groupBy(bucket.alias("bucket")).applyInPandas(graph.circular_in_bucket, out)
    if large.isEmpty():
        return found
    few = [df if df is None else df.join(large, "wb_id", "left_semi") for df in (formulas, resolved)]
    nodes = graph.cyclic_nodes(dependency_edges(*few), piece=F.col("wb_id")).filter(~F.contains(F.col("node"), F.lit("#")))
    part = F.split("node", "!")
    return found.unionByName(nodes.select(part[0].cast(kind).alias("wb_id"), part[1].alias("sheet_key"), part[2].cast("int").alias("row_no"), part[3].cast("int").alias("col_no")))


def calculation_mode(workbooks: DataFrame, cycles: DataFrame) -> DataFrame:
    """Manual fails; a cycle with iteration off fails, with iteration on is undecided; else pass."""
    cyc = cycles.select("wb_id").distinct().withColumn("cycle", F.lit(True))
    has = F.coalesce("cycle", F.lit(False))
    return workbooks.join(cyc, "wb_id", "left").select(
        "wb_id", F.when(F.col("calc_mode") == "manual", "fail").when(has & ~F.col("iterate"), "fail")
        .when(has, "undecided").otherwise("pass").alias("decision"), has.alias("cycle"))


def detect_writer(workbooks: DataFrame) -> DataFrame:
    """Who saved the file, from its properties, and whether its cached values can be trusted."""
    app, ver = F.coalesce("application", F.lit("")), F.coalesce("app_version", F.lit(""))
    writer = (F.when(app.rlike("(?i)libreoffice|openoffice"), "libreoffice")
              .when(app.rlike("(?i)xlsxwriter") | ((app == "Microsoft Excel") & (ver == "12.0000")), "xlsxwriter")
              .when(app.rlike("(?i)^microsoft (macintosh )?excel") & ver.rlike(r"^1[4-9]\.|^16"), "excel").otherwise("unknown"))
    return workbooks.withColumn("writer", writer).withColumn("values_trusted", F.col("writer") == "excel")
