"""A1 references as column expressions. All of them compile to JVM code without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cut_groups, let

MAX_ROW = 1_048_576
MAX_COL = 16_384

_RANGE = r"^\$?([A-Za-z]{1,3})?\$?([0-9]{1,7})?(?::\$?([A-Za-z]{1,3})?\$?([0-9]{1,7})?)?$"
_PLAIN_SHEET = r"^[A-Za-z_][A-Za-z0-9_.]*$"
_CELL_LIKE = r"^\$?[A-Za-z]{1,3}\$?[0-9]+$"


def column_number(letters: Column) -> Column:
    """'A' -> 1, 'XFD' -> 16384; null for an empty text."""
    up = F.upper(letters)

    def at(i: int) -> Column:
        return F.ascii(F.substring(up, i, 1)) - 64

    return (F.when(F.length(up) == 1, at(1))
            .when(F.length(up) == 2, at(1) * 26 + at(2))
            .when(F.length(up) == 3, at(1) * 676 + at(2) * 26 + at(3)))


def column_letters(number: Column) -> Column:
    """1 -> 'A', 16384 -> 'XFD'."""
    def letter(n: Column) -> Column:
        return F.char(n + 65)

    n = number.cast("int")
    last = (n - 1) % 26
    two = F.floor((n - 1) / 26).cast("int")
    three = F.floor((n - 703) / 676).cast("int")
    return (F.when(n <= 26, letter(last))
            .when(n <= 702, F.concat(letter(two - 1), letter(last)))
            .otherwise(F.concat(letter(three), letter((two - 1) % 26), letter(last))))


def parse_a1(ref: Column) -> Column:
    """A struct r1,c1,r2,c2 for 'A1', '$A$1:C5', 'A:C' or '3:7'; null when it is none of these."""
    text = F.trim(ref)

    def read(p: Column) -> Column:
        pair = F.contains(text, F.lit(":"))
        ca, ra = p[1], p[2]
        cb, rb = F.when(pair, p[3]).otherwise(ca), F.when(pair, p[4]).otherwise(ra)
        valid = (F.size(p) == 5) & ((ca != "") | (ra != "")) & ((ca == "") == (cb == "")) & ((ra == "") == (rb == ""))
        c1, c2 = F.coalesce(column_number(ca), F.lit(1)), F.coalesce(column_number(cb), F.lit(MAX_COL))
        # a cast that fails is caught as an exception, row by row, so an empty text is never cast
        r1, r2 = F.when(ra != "", ra.cast("int")).otherwise(1), F.when(rb != "", rb.cast("int")).otherwise(MAX_ROW)
        return F.when(F.coalesce(valid, F.lit(False)), F.struct(F.least(r1, r2).alias("r1"), F.least(c1, c2).alias("c1"),
                                                                F.greatest(r1, r2).alias("r2"), F.greatest(c1, c2).alias("c2")))

    return let(cut_groups(text, _RANGE, ["$1", "$2", "$3", "$4"]), read)


def to_a1(r1: Column, c1: Column, r2: Column | None = None, c2: Column | None = None) -> Column:
    """'A1' or 'A1:C5'."""
    first = F.concat(column_letters(c1), r1.cast("string"))
    if r2 is None or c2 is None:
        return first
    return F.when((r1 == r2) & (c1 == c2), first).otherwise(
        F.concat(first, F.lit(":"), column_letters(c2), r2.cast("string")))


def quote_sheet(name: Column) -> Column:
    """The sheet name as it stands before '!': quoted when a formula would need it."""
    return F.when(name.rlike(_PLAIN_SHEET) & ~name.rlike(_CELL_LIKE), name).otherwise(
        F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'")))


def location(sheet: Column, ref: Column | None = None) -> Column:
    return sheet if ref is None else F.concat(quote_sheet(sheet), F.lit("!"), ref)
