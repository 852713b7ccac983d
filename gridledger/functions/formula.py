"""Formula-text features as column expressions: masks, calls, references, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cut_groups, let
from .a1 import MAX_COL, MAX_ROW, column_letters, column_number, parse_a1

_LITERAL = r'\G((?:[^"\']|\'(?:[^\']|\'\')*\')*)"(?:[^"]|"")*"'
_QUOTED = r"'(?:[^']|'')*'"
_CALL = r"(?<![\p{L}\p{N}_.])([\p{L}_][\p{L}\p{N}_.]*)\("
_STORAGE_PREFIX = r"^(?:_XLFN\.|_XLWS\.)+"
_SHEET = r"(?:'(?:[^']|'')+'|[\p{L}\p{N}_.\[\]:]+)!"
_CELLS = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,7}(?::\$?[A-Za-z]{1,3}\$?[0-9]{1,7})?"
_WHOLE = r"\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}|\$?[0-9]{1,7}:\$?[0-9]{1,7}"
_REFERENCE = rf"(?<![\p{{L}}\p{{N}}_.$!'\]:])(?:{_SHEET})?(?:{_CELLS}|{_WHOLE})(?![\p{{L}}\p{{N}}_.(!])(?!:(?![\p{{L}}_][\p{{L}}\p{{N}}_.]*\())"
# a book stands in brackets at the head of a sheet qualifier; a column of a table follows the table's name
_EXTERNAL = r"'[^']*\[[^\]']+\][^']*'!|(?<![\p{L}\p{N}_.\]\[])\[[^\[\]]+\][\p{L}\p{N}_.:]*!|\\|://|\.(?:xl[a-z]{1,2}|csv)'?!"
_POINTER = rf"^\s*=?\s*[+\-@(\s]*{_SHEET}(?:{_CELLS}|{_WHOLE})#?[)\s]*$"
_ADDRESS_ONLY = r"(?i)(?<![A-Z0-9_.])(?:ROWS?|COLUMNS?)\([^()]*\)"
_NAVIGATION = r'(?i)^\s*=?\s*(?:(?:IFERROR|IFNA|IF)\s*\(\s*)*HYPERLINK\s*\('
_BRACKETS = r"\[(?:[^\[\]]|\[[^\[\]]*\])*\]"
_NO_NAME = r"[\p{L}\p{N}_.]+:[\p{L}\p{N}_.]+!|(?<![\p{L}\p{N}_.$])\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\p{L}\p{N}_.(!])"
_TOKEN = r"(?<![\p{L}\p{N}_.$!'\]#])[\p{L}_\\][\p{L}\p{N}_.\\]*(?![\p{L}\p{N}_.\\(!])"


def mask_strings(text: Column) -> Column:
    """String literals emptied; quoted sheet names, which may hold a double quote, are kept."""
    return F.regexp_replace(text, _LITERAL, '$1""')


def functions_called(text: Column) -> Column:
    """Upper-case names of the functions a formula calls, storage prefixes removed, sorted."""
    bare = F.regexp_replace(mask_strings(text), _QUOTED, "''")
    names = F.regexp_extract_all(bare, F.lit(_CALL), 1)
    return F.array_sort(F.array_distinct(F.transform(names, lambda n: F.regexp_replace(F.upper(n), _STORAGE_PREFIX, ""))))


def reference_texts(text: Column) -> Column:
    """The reference operands of a formula as written, without repeats."""
    return F.array_distinct(F.regexp_extract_all(mask_strings(text), F.lit(_REFERENCE), 0))


def references(df: DataFrame, text: str, own_sheet: Column) -> DataFrame:
    """One row per reference operand: sheet, external flag and bounds r1,c1,r2,c2.

    Cells repeat texts, so each distinct text is read once and its references are joined back.
    """
    ref = F.col("ref")
    bang = F.instr(ref, "!")
    sheet = F.regexp_replace(F.regexp_replace(F.substring_index(ref, "!", 1), r"^'|'$", ""), "''", "'")
    body = F.when(bang > 0, F.substring_index(ref, "!", -1)).otherwise(ref)
    each = df.select(F.col(text).alias("_text")).distinct().withColumn("ref", F.explode(reference_texts(F.col("_text"))))
    # the generator holds the parsed bounds, so that later predicates do not parse again
    bounds = F.filter(F.array(parse_a1(body)), lambda b: b.isNotNull())
    named = each.select("_text", "ref", F.when(bang > 0, sheet).alias("_there"), F.inline(bounds))
    return (df.withColumn("_own", own_sheet).join(named, F.col(text) == F.col("_text"))
            .withColumn("ref_sheet", F.when(F.instr("ref", "!") > 0, F.col("_there")).otherwise(F.col("_own")))
            .select(*df.columns, "ref", "ref_sheet", F.contains(F.col("ref_sheet"), F.lit("[")).alias("external"), "r1", "c1", "r2", "c2"))


def has_whole_ref(text: Column) -> Column:
    """A:A, 1:1, A1:A1048576 or A1:XFD1 anywhere outside string literals."""
    def whole(ref: Column) -> Column:
        b = parse_a1(F.substring_index(ref, "!", -1))
        return ((b["r1"] == 1) & (b["r2"] == 1048576)) | ((b["c1"] == 1) & (b["c2"] == 16384))

    return F.contains(text, F.lit(":")) & F.exists(reference_texts(text), lambda r: F.coalesce(whole(r), F.lit(False)))


def has_whole_form(text: Column) -> Column:
    """A reference written as A:A or 1:1; a bounded range that happens to span the sheet is not one."""
    return F.contains(text, F.lit(":")) & F.exists(reference_texts(text), lambda r: F.substring_index(r, "!", -1).rlike(rf"^(?:{_WHOLE})$"))


def is_external(text: Column) -> Column:
    """Reads another workbook: [1]Sheet!A1, [Book.xlsx]Sheet!A1, or a path before '!'."""
    may = F.contains(text, F.lit("[")) | F.contains(text, F.lit("!"))
    return may & mask_strings(text).rlike(_EXTERNAL)


def formula_class(text: Column, own_sheet: Column) -> Column:
    """EXTERNAL before POINTER before CROSS before OWN."""
    masked = mask_strings(text)
    own = F.lower(own_sheet)

    def elsewhere(ref: Column) -> Column:
        sheet = F.regexp_replace(F.substring_index(ref, "!", 1), r"^'|'$", "")
        return F.contains(ref, F.lit("!")) & (F.lower(sheet) != own)

    cross = F.exists(reference_texts(text), elsewhere)
    # most formulas stay on their sheet, and two cheap searches show it
    home = ~F.contains(text, F.lit("!")) & ~F.contains(text, F.lit("["))
    return (F.when(home, "OWN").when(is_external(text), "EXTERNAL")
            .when(cross & masked.rlike(_POINTER), "POINTER")
            .when(cross, "CROSS").otherwise("OWN"))


def is_navigation(text: Column) -> Column:
    """A HYPERLINK call, alone or inside a guard: may have any font colour."""
    return text.rlike(_NAVIGATION)


def name_tokens(text: Column) -> Column:
    """Lower-case identifiers that could be defined names: no call, no sheet, no cell address."""
    # neither columns of tables and books, nor sheets and spans of sheets, nor whole columns are names
    bare = F.regexp_replace(F.regexp_replace(mask_strings(text), _QUOTED, ""), _BRACKETS, "[]")
    tokens = F.regexp_extract_all(F.regexp_replace(bare, _NO_NAME, "0"), F.lit(_TOKEN), 0)
    kept = F.filter(tokens, lambda t: ~t.rlike(r"(?i)^(?:[a-z]{1,3}[0-9]{1,7}|true|false)$"))
    return F.array_distinct(F.transform(kept, lambda t: F.lower(t)))


def paren_balance(text: Column) -> Column:
    masked = mask_strings(text)
    opened = F.length(masked) - F.length(F.replace(masked, F.lit("("), F.lit("")))
    closed = F.length(masked) - F.length(F.replace(masked, F.lit(")"), F.lit("")))
    return opened - closed


def unknown_functions(text: Column, known: list[str]) -> Column:
    """Functions called that are not in the caller's list (upper case)."""
    return F.array_except(functions_called(text), F.array(*[F.lit(k) for k in known]))


def without_address_calls(text: Column) -> Column:
    """ROW, ROWS, COLUMN and COLUMNS read an address, not a value; their arguments do not count."""
    return F.regexp_replace(mask_strings(text), _ADDRESS_ONLY, "0")


def takes_address(text: Column) -> Column:
    """Does a formula call ROW, ROWS, COLUMN or COLUMNS?"""
    return text.rlike(_ADDRESS_ONLY)


def date_stamp(text: Column) -> Column:
    """The whole formula is TODAY() or NOW(), at most inside unary plus, '@' or parentheses."""
    opened = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    closed = F.length(text) - F.length(F.replace(text, F.lit(")"), F.lit("")))
    return text.rlike(r"(?i)^\s*=?\s*[+@(\s]*(?:TODAY|NOW)\(\s*\)[\s)]*$") & (opened == closed)


# one token of a formula: what must not move whole, then references, then the rest
_PART = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,7}"
_SPAN = rf"{_PART}(?::{_PART})?|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|\$?[0-9]{{1,7}}:\$?[0-9]{{1,7}}"
_ENDS_HERE = r"(?![\p{L}\p{N}_.(!\[])"
_PIECE = (r'"(?:[^"]|"")*"' + rf"|{_QUOTED}!?" + r"|[\p{L}\p{N}_.]*\[(?:[^\[\]]|\[[^\[\]]*\])*\](?:[\p{L}\p{N}_.:]*!)?"
          + r"|[\p{L}\p{N}_.:]+!|[\p{L}_\\][\p{L}\p{N}_.\\]*\(" + rf"|(?:{_SPAN}){_ENDS_HERE}" + r"|[\p{L}\p{N}_.$\\]+|(?s:.)")


def _moved_part(part: Column, rows: Column, cols: Column) -> Column:
    """One end of a reference moved; null off the grid. Parts behind a '$' stay as written."""
    def read(p: Column) -> Column:
        col_abs, col, row_abs, row = p[1], p[2], p[3], p[4]
        row_abs, col_abs = F.when(col == "", F.concat(col_abs, row_abs)).otherwise(row_abs), F.when(col == "", "").otherwise(col_abs)
        to_col = column_number(F.when(col == "", "A").otherwise(col)) + cols
        to_row = F.when(row == "", "1").otherwise(row).cast("long") + rows
        new_col = F.when((col == "") | (col_abs == "$") | (cols == 0), col).when(to_col.between(1, MAX_COL), column_letters(to_col))
        new_row = F.when((row == "") | (row_abs == "$") | (rows == 0), row).when(to_row.between(1, MAX_ROW), to_row.cast("string"))
        return F.concat(col_abs, new_col, row_abs, new_row)

    return let(cut_groups(part, r"^(\$?)([A-Za-z]{0,3})(\$?)([0-9]{0,7})$", ["$1", "$2", "$3", "$4"]), read)


def shifted(text: Column, rows: Column, cols: Column) -> Column:
    """The formula as it reads ``rows`` down and ``cols`` to the right of where it is written, as filling does.

    Relative parts of A1 references move; absolute parts, names, calls, strings, sheet names and columns of tables
    stay. A reference that leaves the grid becomes #REF! behind its sheet.
    """
    def one(token: Column) -> Column:
        moved = F.array_join(F.transform(F.split(token, ":"), lambda p: F.coalesce(_moved_part(p, rows, cols), F.lit("#REF!"))), ":")
        return F.when(token.rlike(rf"^(?:{_SPAN})$"), F.when(F.contains(moved, F.lit("#REF!")), "#REF!").otherwise(moved)).otherwise(token)

    pieces = F.transform(F.regexp_extract_all(text, F.lit(f"({_PIECE})"), 1), one)
    return F.when((rows == 0) & (cols == 0), text).otherwise(F.array_join(pieces, ""))
