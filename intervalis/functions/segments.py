"""Segments: fixed-width ranges of grouping numbers, by which tables are partitioned, and the predicates that prune them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keys as K

_HOUR = 3_600_000
_DAY, _MONTH = 24 * _HOUR, 30 * 24 * _HOUR

# The widths that a collection can have, in grouping numbers.
SIZES = {
    **{f"TIME_{n}": w for n, w in {"1_HOUR": _HOUR, "2_HOURS": 2 * _HOUR, "6_HOURS": 6 * _HOUR, "12_HOURS": 12 * _HOUR, "1_DAY": _DAY, "5_DAYS": 5 * _DAY, "15_DAYS": 15 * _DAY, "1_MONTH": _MONTH, "3_MONTHS": 3 * _MONTH, "6_MONTHS": 6 * _MONTH}.items()},
    **{f"INT_{n}": w for n, w in {"128": 128, "256": 256, "512": 512, "1K": 1024}.items()},
    **{f"LONG_{n}": w // 2 for n, w in {"128": 128, "256": 256, "512": 512, "1K": 1024}.items()},  # two ids share a group
    **{f"HASH_{n}": w for n, w in {"256K": 1 << 18, "512K": 1 << 19, "1M": 1 << 20, "2M": 1 << 21, "4M": 1 << 22, "8M": 1 << 23, "16M": 1 << 24, "32M": 1 << 25}.items()},
}
# Wider ones of our own, for tables of billions of ids: a folder for each thousand ids would be too many.
SIZES |= {"INT_1M": 1 << 20, "INT_16M": 1 << 24, "LONG_1M": 1 << 19, "LONG_16M": 1 << 23}


def default_size(key_type: type) -> str:
    """Wide enough for a partition of a table; narrower ones are an option of the collection."""
    if K.is_time(key_type) or key_type is K.LongTimeKey:
        return "TIME_1_MONTH"
    return {K.IntegerKey: "INT_16M", K.LongKey: "LONG_16M"}.get(key_type, "HASH_32M")


def check_size(name: str, key_type: type) -> int:
    """The width of a named size that fits the key type."""
    family = "TIME" if K.is_time(key_type) or key_type is K.LongTimeKey else {K.IntegerKey: "INT", K.LongKey: "LONG"}.get(key_type, "HASH")
    if name not in SIZES or not name.startswith(family + "_"):
        raise ValueError(f"{name} is no segment size for {key_type.__name__}")
    return SIZES[name]


def floor(value: int, width: int) -> int:
    return value - value % width


def segment_of(group: Column, width: int) -> Column:
    """The first grouping number of the segment; right for negative ones too."""
    return group - F.pmod(group, F.lit(width))


def time_pruning(low: int | None, high: int | None, width: int, span: int | None, by_start: bool) -> Column:
    """Which segments can hold time keys that overlap [low, high]; span is the longest frame of the table, None if unknown."""
    found = F.lit(True)
    if high is not None:
        found = found & (F.col(K.SEGMENT) <= F.lit(floor(high, width)))
    if low is not None and by_start:
        found = found & (F.col(K.SEGMENT) >= F.lit(floor(low, width)))
    elif low is not None and span is not None:
        found = found & (F.col(K.ACTIVE) | (F.col(K.SEGMENT) >= F.lit(floor(max(K.LONG_MIN + width, low - span), width))))
    return found


class Range:
    """A closed range of numbers; one that starts after its end is empty."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end

    def contains(self, value: int) -> bool:
        return self.start <= value <= self.end

    def encloses(self, other: Range) -> bool:
        return self.start <= other.start and self.end >= other.end

    def overlaps(self, other: Range) -> bool:
        return self.start <= other.end and self.end >= other.start

    def __len__(self):
        return max(0, self.end - self.start + 1)
