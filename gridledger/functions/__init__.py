"""Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# stands between the groups a pattern cuts a text into; no cell text holds it
CUT = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut_groups(text: Column, pattern: str, groups: list[str]) -> Column:
    """The pattern's groups as an array behind an empty first element; one element when it does not match.

    One pass instead of one match per group.
    """
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, "".join(CUT + g for g in groups)), CUT)
