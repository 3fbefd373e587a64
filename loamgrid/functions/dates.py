"""Dates in file names and headings of dated bulletins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_short(day: Column, month: Column, year: Column) -> Column:
    """Date of two-digit parts in this century; null if there is no such day."""
    return F.try_to_date(F.format_string("20%s-%s-%s", year, month, day), "yyyy-MM-dd")


def of_file_name(name: Column) -> Column:
    """The date in ``...-dd.mm.yy.pdf``; null without one."""
    part = lambda i: F.regexp_extract(name, r"-(\d{2})\.(\d{2})\.(\d{2})\.pdf$", i)
    return F.when(part(1) != "", from_short(part(1), part(2), part(3)))


def mentioned(text: Column) -> Column:
    """Distinct ``dd-mm-yy`` in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d{2}-\d{2}-\d{2}"), F.lit(0)))


def of_heading(text: Column) -> Column:
    """The second date of a heading, as a date."""
    d = F.get(mentioned(text), 1)
    return F.when(d.isNotNull(), from_short(F.substring(d, 1, 2), F.substring(d, 4, 2), F.substring(d, 7, 2)))


def era(text: Column, markers: dict[str, str], default: str = "unknown") -> Column:
    """The first era whose marker the text holds, white space aside."""
    bare = F.regexp_replace(text, r"(?U)\s", "")
    out = F.lit(default)
    for name, marker in reversed(list(markers.items())):
        out = F.when(F.contains(bare, F.lit(marker)), F.lit(name)).otherwise(out)
    return out
