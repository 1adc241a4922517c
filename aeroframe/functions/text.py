"""Text parsing as column expressions: names, numbers in titles, log metrics, id ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def column_name(title: Column) -> Column:
    """``"alpha, deg"`` -> ``alpha_deg``: lower case, degree marks, then one underscore per other run."""
    name = F.lower(F.trim(title))
    name = F.regexp_replace(name, r"[\s,]*deg[\s,]*", "_deg")
    name = F.regexp_replace(name, "/", "_")
    name = F.regexp_replace(name, "[^a-z0-9_]+", "_")
    return F.regexp_replace(name, "^_+|_+$", "")


def column_names(raw: Column) -> Column:
    """Array of clean names from a ``variables=`` list, quoted or comma-separated."""
    quoted = F.regexp_extract_all(raw, F.lit(r'"([^"]*)"'), F.lit(1))
    parts = F.when(F.size(quoted) > 0, quoted).otherwise(F.split(raw, ","))
    return F.transform(parts, column_name)


def alpha_in_title(title: Column) -> Column:
    """Angle from ``alpha=...`` in a zone title; NaN if there is none."""
    found = F.regexp_extract(title, rf"alpha\s*=\s*({NUMBER}|-?\.\d+)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(float("nan")))


def numbers(line: Column) -> Column:
    """Whitespace-separated tokens as doubles; a token that is no number gives null in its place."""
    return F.transform(F.split(F.trim(line), r"\s+"), lambda t: t.try_cast("double"))


def all_numeric(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull())


def metric(text: Column, pattern: str) -> Column:
    """First captured number of ``pattern`` as a double, null if absent."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def last_metric(text: Column, pattern: str) -> Column:
    """Last captured number of ``pattern`` in the text."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)).try_cast("double")


def id_range(item: Column) -> Column:
    """``"3"`` or ``"3-7"`` as struct(start, stop, error); a bad or reversed range gives an error text."""
    item = F.trim(item)
    single = F.regexp_extract(item, r"^(\d+)$", 1).try_cast("int")
    start = F.coalesce(single, F.regexp_extract(item, r"^(\d+)-(\d+)$", 1).try_cast("int"))
    stop = F.coalesce(single, F.regexp_extract(item, r"^(\d+)-(\d+)$", 2).try_cast("int"))
    error = (F.when(start.isNull() | stop.isNull(), F.lit("not an id or a range"))
             .when(start > stop, F.lit("start must be <= end")))
    return F.struct(start.alias("start"), stop.alias("stop"), error.alias("error"))


def significant(x: Column, digits: int) -> Column:
    """Text of ``x`` to that many significant digits, for CSV export only."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.format_string(f"%.{digits}g", x))
