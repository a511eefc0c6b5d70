"""Names of image files, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A name's last extension; a leading dot begins none.
_EXTENSION = r"(?<=[^/.])(\.[^./]*)$"


def shortened(name: Column, most: int = 30, lead: str = "...") -> Column:
    """A longer name keeps its beginning and its end, with `lead` between them."""
    first = (most - len(lead)) // 2
    last = most - len(lead) - first
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, first), F.lit(lead), F.right(name, F.lit(last)))).otherwise(name)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, _EXTENSION, "")


def extension(name: Column) -> Column:
    """With its dot; empty where there is none."""
    return F.regexp_extract(name, _EXTENSION, 1)


def _dotted(ending: str) -> str:
    return ending if ending.startswith(".") else "." + ending


def with_extension(name: Column, ending: str) -> Column:
    return F.concat(stem(name), F.lit(_dotted(ending)))


def with_suffix(name: Column, suffix: str, ending: str | None = None) -> Column:
    """The suffix before the extension, which may change too."""
    return F.concat(stem(name), F.lit(suffix), F.lit(_dotted(ending)) if ending else extension(name))


def last_number(name: Column) -> Column:
    """The digits at the end of the stem; empty where there are none."""
    return F.regexp_extract(stem(name), r"(\d+)$", 1)


def next_numbered(name: Column) -> Column:
    """The name with its last number one higher, as wide as before; with 0 where it has none."""
    number, base = last_number(name), F.regexp_replace(stem(name), r"\d+$", "")
    raised = (number.try_cast("decimal(38,0)") + 1).cast("string")
    wide = F.when(F.length(raised) < F.length(number), F.lpad(raised, F.length(number), "0")).otherwise(raised)
    return F.concat(base, F.when(number == "", F.lit("0")).otherwise(wide), extension(name))


def token(name: Column, nth: int = 0, separator: str = "_") -> Column:
    """The nth part of the name without its folders; null where it has fewer."""
    return F.get(F.split(F.regexp_extract(name, r"([^/]*)$", 1), F.lit(f"\\Q{separator}\\E")), F.lit(nth))


def place_in_series(name: Column, axis: str) -> Column:
    """The number that a name of a series gives for axis z, t or w (also marked c): the last of `_z001` or `-z001`, in either case; null where it gives none."""
    letters = {"z": "zZ", "t": "tT", "w": "wWcC"}[axis]
    last = F.regexp_extract(F.substring_index(name, "/", -1), rf"(?s)^.*[_-][{letters}]([0-9]+)", 1)
    return last.try_cast("int")


def common_start(names: Column) -> Column:
    """What all names of an array begin with: that of the least and the greatest."""
    low, high = F.array_min(names), F.array_max(names)
    same = lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i)
    lengths = F.sequence(F.lit(0), F.least(F.length(low), F.length(high)))
    return F.substring(low, F.lit(1), F.array_max(F.filter(lengths, same)))
