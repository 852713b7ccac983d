"""Number-format codes classified by how they show negatives, zeros and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECTION = r'((?:"[^"]*"|\[[^\]]*\]|[\\_*].|[^;"\\_*\[])*);'
_DATE_LETTERS = r"(?i)[ymdhs]"


def sections(code: Column) -> Column:
    """The sections between semicolons that stand outside quotes, brackets and escapes."""
    return F.regexp_extract_all(F.concat(code, F.lit(";")), F.lit(_SECTION), 1)


def shown(section: Column) -> Column:
    """What a section prints besides digits: brackets, padding and fills dropped, quotes opened."""
    s = F.regexp_replace(section, r"\[[^\]]*\]", "")
    s = F.regexp_replace(s, r"[_*].", "")
    return F.regexp_replace(F.regexp_replace(s, r"\\(.)", "$1"), '"', "")


def _placeholders(section: Column) -> Column:
    """The section without literal text of any kind."""
    return F.regexp_replace(section, r'"[^"]*"|\[[^\]]*\]|[\\_*].', "")


def numeric_sections(code: Column) -> Column:
    secs = sections(code)
    last = F.element_at(secs, -1)
    return F.when(F.size(secs) > 3, F.slice(secs, 1, 3)).when(
        F.contains(_placeholders(last), F.lit("@")), F.slice(secs, 1, F.size(secs) - 1)).otherwise(secs)


def is_general(code: Column) -> Column:
    return F.lower(F.trim(code)).isin("general", "@", "")


def is_date(code: Column) -> Column:
    return ~is_general(code) & _placeholders(F.get(sections(code), F.lit(0))).rlike(_DATE_LETTERS)


def is_percent(code: Column) -> Column:
    return F.contains(_placeholders(code), F.lit("%"))


def decimals(code: Column) -> Column:
    """Digits after the point of the first section; null for General."""
    frac = F.regexp_extract(_placeholders(F.get(sections(code), F.lit(0))), r"\.([0#?]+)", 1)
    return F.when(~is_general(code), F.length(frac))


def uncertain(code: Column) -> Column:
    """Conditional sections, or digits mixed with date letters: counted, never judged."""
    first = _placeholders(F.get(sections(code), F.lit(0)))
    return code.rlike(r"\[(?:<|>|=)") | (~is_general(code) & first.rlike("[0#?]") & first.rlike("(?i)[ymd]"))


def negative_class(code: Column) -> Column:
    """parens, minus, unsigned, mixed, blank or text; 'date' and 'uncertain' are not judged."""
    secs = numeric_sections(code)
    own = F.get(secs, F.lit(1))
    text = F.trim(shown(own))
    wrapped, dash = text.rlike(r"^[^(]*\(.*[0#?].*\)"), text.rlike("[-−–]")
    return (F.when(uncertain(code), "uncertain").when(is_date(code), "date")
            .when(is_general(code) | (F.size(secs) < 2), "minus")
            .when(text == "", "blank").when(~text.rlike("[0#?]"), "text")
            .when(wrapped & dash, "mixed").when(wrapped, "parens").when(dash, "minus").otherwise("unsigned"))


def zero_class(code: Column) -> Column:
    """dash, digit, blank or text; 'date' and 'uncertain' are not judged."""
    secs = numeric_sections(code)
    own = F.coalesce(F.get(secs, F.lit(2)), F.get(secs, F.lit(0)))
    text = F.trim(shown(own))
    return (F.when(uncertain(code), "uncertain").when(is_date(code), "date").when(is_general(code), "digit")
            .when(F.contains(_placeholders(own), F.lit("0")), "digit")
            .when(F.regexp_replace(text, "[#?, ]", "") == "", "blank")
            .when(text.rlike("[-−–—]"), "dash").otherwise("text"))


def prints_nothing(code: Column) -> Column:
    """No section shows anything: ';;;' and its like."""
    return F.forall(sections(code), lambda s: F.trim(shown(s)) == "")


def least_shown(code: Column) -> Column:
    """The size below which a format shows a value as zero."""
    places = F.coalesce(decimals(code), F.lit(9)) + F.when(is_percent(code), 2).otherwise(0)
    return F.pow(F.lit(10.0), -places) / 2


def rounds_to_zero(value: Column, code: Column) -> Column:
    return F.abs(value) < least_shown(code)


def zero_like_tag(value: Column, code: Column, leftover: float = 1e-6) -> Column:
    """The cell shows a zero but holds none: a leftover below the limit, or any value under a dash format."""
    dash = (F.size(numeric_sections(code)) >= 3) & (zero_class(code) == "dash")
    return (value != 0) & rounds_to_zero(value, code) & ((F.abs(value) < leftover) | dash)
