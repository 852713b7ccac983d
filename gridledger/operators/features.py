"""Feature operators that need a join or an aggregation on top of the text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formula as X
from ..functions import text as T
from .grid import SHEET, range_members
from .skew import first_n

CELL = ["wb_id", "sheet_idx", "row_no", "col_no"]


def name_uses(texts: DataFrame, names: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Which defined names each text uses. A name of the text's own sheet hides the workbook's name.

    ``names`` has wb_id, name and scope (sheet index, null for the workbook); ``texts`` has
    wb_id and sheet_idx (null outside a sheet).
    """
    tokens = texts.select(*keep, F.explode(X.name_tokens(F.col(text))).alias("token"))
    low = names.select("wb_id", F.lower("name").alias("token"), "name", "scope")
    local = low.filter("scope is not null").select("wb_id", F.col("scope").alias("sheet_idx"), "token", F.col("name").alias("local_name"))
    whole = low.filter("scope is null").select("wb_id", "token", F.col("name").alias("global_name"))
    return (tokens.join(local, ["wb_id", "sheet_idx", "token"], "left").join(whole, ["wb_id", "token"], "left")
            .withColumn("used_name", F.coalesce("local_name", "global_name"))
            .filter(F.col("used_name").isNotNull())
            .withColumn("used_scope", F.when(F.col("local_name").isNotNull(), F.col("sheet_idx")))
            .select(*keep, "used_name", "used_scope"))


def validate_formulas(formulas: DataFrame, known: list[str]) -> DataFrame:
    """Each formula with its unknown functions and parenthesis balance, and whether it passes."""
    t = F.col("text")
    return (formulas.withColumn("unknown", F.array_sort(X.unknown_functions(t, known)))
            .withColumn("balance", X.paren_balance(t))
            .withColumn("valid", (F.size("unknown") == 0) & (F.col("balance") == 0)))


def batch_validate(formulas: DataFrame, known: list[str]) -> DataFrame:
    v = validate_formulas(formulas, known)
    return v.groupBy("wb_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def self_references(formulas: DataFrame, own_sheet: Column) -> DataFrame:
    """Formulas that read their own cell, alone or inside a range; addresses read by ROW and COLUMN do not count."""
    plain = formulas.withColumn("_sheet", own_sheet).withColumn("_t", X.without_address_calls(F.col("text")))
    refs = X.references(plain.select(*CELL, "_sheet", "_t"), "_t", F.col("_sheet"))
    inside = F.col("row_no").between(F.col("r1"), F.col("r2")) & F.col("col_no").between(F.col("c1"), F.col("c2"))
    return (refs.filter(~F.col("external") & (F.lower("ref_sheet") == F.lower("_sheet")) & inside)
            .groupBy(*CELL).agg(F.min("ref").alias("ref")))


def cf_fires(v: Column) -> Column:
    """Whether a literal rule fires on a number; null for a rule that needs evaluating (taken as off)."""
    op, a, b = F.col("operator"), F.col("a"), F.col("b")
    lo, hi = F.least(a, b), F.greatest(a, b)
    cell_is = (F.when(op == "greaterThan", v > a).when(op == "greaterThanOrEqual", v >= a).when(op == "lessThan", v < a)
               .when(op == "lessThanOrEqual", v <= a).when(op == "equal", v == a).when(op == "notEqual", v != a)
               .when(op == "between", v.between(lo, hi)).when(op == "notBetween", ~v.between(lo, hi)))
    return (F.when(F.col("rule_type") == "cellIs", cell_is)
            .when(F.col("rule_type").isin("notContainsBlanks", "notContainsErrors"), F.lit(True))
            .when(F.col("rule_type").isin("containsBlanks", "containsErrors"), F.lit(False)))


def apply_cf(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Per cell under rules: the first firing rule by priority, and how many rules could not be evaluated.

    A firing stopIfTrue rule ends the list, which the first firing rule does anyway for one
    property, so the minimum priority among firing rules is the answer. Partial minima are
    taken before the shuffle.
    """
    hit = range_members(cells.select(*CELL, "v_num"), rules).withColumn("fires", cf_fires(F.col("v_num")))
    return hit.groupBy(*CELL).agg(
        F.min(F.when(F.col("fires"), F.struct("priority", "rule_type"))).alias("first"),
        F.count_if(F.col("fires")).alias("n_firing"),
        F.count_if(F.col("fires").isNull()).alias("n_off"))


def _general(v: Column) -> Column:
    """A number as the General format writes it, short of exponents."""
    text = F.regexp_replace(F.round(v, 9).cast("decimal(38,9)").cast("string"), r"\.?0+$", "")
    return F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(text)


def _search_pattern(needle: Column) -> Column:
    """The needle of a SEARCH as a pattern: '*' any run, '?' one character, '~' before either takes it as it is."""
    mark = "\u0001"
    held = F.replace(F.replace(F.replace(needle, F.lit("~~"), F.lit(mark + "t")), F.lit("~*"), F.lit(mark + "s")), F.lit("~?"), F.lit(mark + "q"))
    plain = F.regexp_replace(held, r"([^\p{L}\p{N}\s*?\x01])", r"\\$1")
    wild = F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?is)"), F.replace(F.replace(F.replace(wild, F.lit(mark + "t"), F.lit("~")), F.lit(mark + "s"), F.lit(r"\*")), F.lit(mark + "q"), F.lit(r"\?")))


def rule_fires(v_num: Column, v_text: Column, v_err: Column) -> Column:
    """Whether the rule of the row fires on the cell of the row; null for a rule that needs evaluating.

    ``text`` is the rule's needle. Comparisons and text rules never fire on an error; a comparison with numbers
    does not fire on a text; a number is searched as General writes it.
    """
    kind, needle = F.col("rule_type"), F.col("text")
    shown = F.coalesce(v_text, _general(v_num), F.lit(""))
    blank = v_err.isNull() & v_num.isNull() & (F.trim(F.coalesce(v_text, F.lit(""))) == "")
    found = F.regexp_like(shown, _search_pattern(needle))
    text = (F.when(kind == "containsText", found).when(kind == "notContainsText", ~found)
            .when(kind == "beginsWith", F.startswith(F.lower(shown), F.lower(needle))).when(kind == "endsWith", F.endswith(F.lower(shown), F.lower(needle))))
    number = F.coalesce(v_num, F.when(v_text.isNull(), 0.0))  # an empty cell compares as zero
    return (F.when(kind == "containsErrors", v_err.isNotNull()).when(kind == "notContainsErrors", v_err.isNull())
            .when(kind == "containsBlanks", blank).when(kind == "notContainsBlanks", ~blank)
            .when(kind.isin("containsText", "notContainsText", "beginsWith", "endsWith") & needle.isNotNull(), v_err.isNull() & text)
            .when(kind.isin("dataBar", "iconSet", "colorScale"), v_num.isNotNull() & v_err.isNull())
            .when(kind == "cellIs", v_err.isNull() & F.coalesce(cf_fires(number), F.lit(False)) & number.isNotNull()))


def cf_overlay(cells: DataFrame, rules: DataFrame, properties: list[str]) -> DataFrame:
    """(CELL, properties): what conditional formats paint over each cell that lies under a rule, null where nothing.

    ``rules`` are rectangles with rule_type, operator, a, b, text, priority, stop and the properties they set (null
    for those they leave). A property comes from the first firing rule that sets it; a firing rule with ``stop`` is the
    last that counts. The first rule with a property decides: if it lies behind the stop, so do all others.
    """
    v_text = F.col("v_text") if "v_text" in cells.columns else F.lit(None).cast("string")
    at = cells.select(*CELL, "v_num", v_text.alias("v_text"), "v_err")
    hit = range_members(at, rules).filter(F.coalesce(rule_fires(F.col("v_num"), F.col("v_text"), F.col("v_err")), F.lit(False)))
    first = [F.min(F.when(F.col(p).isNotNull(), F.struct("priority", F.col(p).alias("value")))).alias(p) for p in properties]
    painted = hit.groupBy(*CELL).agg(F.min(F.when(F.col("stop"), F.col("priority"))).alias("_last"), *first)
    return painted.select(*CELL, *[F.when(F.col("_last").isNull() | (F.col(f"{p}.priority") <= F.col("_last")), F.col(f"{p}.value")).alias(p) for p in properties])


def painted_cells(cells: DataFrame, rules: DataFrame, properties: list[str]) -> DataFrame:
    """``cells`` with the properties that conditional formats paint over them in place of their own."""
    over = cf_overlay(cells, rules, properties).withColumnsRenamed({p: f"_over_{p}" for p in properties})
    joined = cells.join(over, CELL, "left")
    return joined.select(*[F.coalesce(f"_over_{c}", c).alias(c) if c in properties else F.col(c) for c in cells.columns])


def with_glyph_width(df: DataFrame, text: str, face: str, size: str, bold: str, out: str, unit_px: float = 7.0) -> DataFrame:
    """Adds the width of a number as shown, in each row's own font. Every distinct text is counted once, whatever its fonts."""
    counted = df.select(F.col(text).alias("_text")).distinct().withColumn("_counts", T.glyph_counts(F.col("_text")))
    d = df.join(counted, F.col(text).eqNullSafe(F.col("_text")), "left")
    return d.withColumn(out, T.glyph_width(F.col("_counts"), F.col(face), F.col(size), F.col(bold), unit_px)).drop("_text", "_counts")


def column_profile(cells: DataFrame, examples: int = 3) -> DataFrame:
    """Per column the majority type, the number of values and the first examples."""
    keys = [*SHEET, "col_no"]
    types = (cells.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"))
             .groupBy(*keys).agg(F.sum("n").alias("non_null"),
                                 F.max_by("type", F.struct(F.col("n"), -F.col("first_row"))).alias("inferred_type")))
    shown = (first_n(cells.select(*keys, "row_no", "shown"), keys, ["row_no"], examples)
             .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_no", "shown"))).alias("e"))
             .select(*keys, F.array_join(F.transform("e", lambda x: x["shown"]), "; ").alias("examples")))
    return types.join(shown, keys)
