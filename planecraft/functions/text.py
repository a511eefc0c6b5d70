"""Text functions: number lists, key=value settings, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_list(text: Column) -> Column:
    """'1-3,7' as [1, 2, 3, 7]: ordered, each number once; parts that are no numbers are left out."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    first = lambda p: F.split(p, "-")[0].cast("int")
    last = lambda p: F.element_at(F.split(p, "-"), -1).cast("int")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(first(p), F.greatest(first(p), last(p)))))))


def settings(text: Column) -> Column:
    """Lines of key=value as a map; the first of equal keys counts."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^=]*=", "")).alias("value")))
    firsts = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(firsts)


def swapped_letters(text: Column, old: str, new: str) -> Column:
    return F.translate(text, old, new)


def number_map(text: Column) -> Column:
    """'488:1.5 561:2' as a map of wavelengths to numbers, parts set off by commas or blanks; a part that is no pair of numbers is left out, the last of equal keys counts."""
    parts = F.filter(F.split(F.trim(text), r"[,\s]+"), lambda p: p.rlike(r"^[-+]?[0-9.]+:[-+]?[0-9.]+$"))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).try_cast("double").alias("key"), F.substring_index(p, ":", -1).try_cast("double").alias("value")))
    known = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    keys = F.transform(known, lambda p: p["key"])
    lasts = F.filter(known, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))
    return F.map_from_entries(lasts)


def number_map_text(numbers: Column, digits: int = 2) -> Column:
    """The map as text, in its order: whole values without a point, others with `digits` digits."""
    value = lambda v: F.when(v % 1 != 0, F.format_string(f"%.{digits}f", v)).otherwise(F.format_string("%d", v.cast("long")))
    return F.array_join(F.transform(F.map_entries(numbers), lambda e: F.concat(F.format_string("%d", e["key"].cast("long")), F.lit(":"), value(e["value"]))), " ")
