"""Key types: their order, their placement and their overlap with ranges, for single keys and as columns.

A time key's identity is its id and start alone: a point, a frame and a still-active key of one id and start are the same
key. Its order also looks at the end. Times are epoch milliseconds.
"""

from __future__ import annotations

import uuid as uuid_lib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1

# Names of the key columns of a collection.
ID, START, END, ACTIVE, GROUP, SEGMENT = "k_id", "k_start", "k_end", "k_active", "k_group", "k_segment"


@dataclass(frozen=True, eq=False)
class Key:
    """A key has a grouping number, which decides on its segment, and a total order that starts with it."""

    id: object

    def __post_init__(self):
        pass

    def group(self) -> int:
        raise NotImplementedError

    def rank(self) -> tuple:
        """What orders keys of one class and one grouping number."""
        return (self.id,)

    def order(self) -> tuple:
        return (self.group(), type(self).__name__, self.rank())

    def __eq__(self, other):
        return type(self) is type(other) and self.id == other.id

    def __hash__(self):
        return hash((type(self).__name__, self.id))

    # Order and equality differ by design, so none of these is derived from ==.
    def __lt__(self, other):
        return other is None or self.order() < other.order()

    def __le__(self, other):
        return other is None or self.order() <= other.order()

    def __gt__(self, other):
        return other is not None and self.order() > other.order()

    def __ge__(self, other):
        return other is not None and self.order() >= other.order()

    def overlaps(self, low: int, high: int) -> bool:
        return low <= self.group() <= high

    def is_after(self, low: int, high: int) -> bool:
        return self.group() > high


class ValueKey(Key):
    """A key that can be an id inside a time key, or an index key."""


class IntegerKey(ValueKey):
    def group(self) -> int:
        return self.id + (1 << 31)


class LongKey(ValueKey):
    def group(self) -> int:
        half = abs(self.id) // 2  # division cuts towards zero, so -1, 0 and 1 are in one group
        return (half if self.id >= 0 else -half) + (1 << 62)


class LongTimeKey(ValueKey):
    def group(self) -> int:
        return self.id


class StringKey(ValueKey):
    def group(self) -> int:
        return hashing.wrapped_group(hashing.java_string_hash(self.id) if self.id is not None else 0)

    def rank(self) -> tuple:
        return (self.id is None, (self.id or "").encode("utf-16-be", "surrogatepass"))


class UuidKey(ValueKey):
    def __post_init__(self):
        if isinstance(self.id, str):
            object.__setattr__(self, "id", uuid_lib.UUID(self.id))

    def group(self) -> int:
        return hashing.wrapped_group(hashing.java_uuid_hash(self.id) if self.id is not None else 0)

    def rank(self) -> tuple:
        halves = [(self.id.int >> s) & ((1 << 64) - 1) for s in (64, 0)] if self.id is not None else [0, 0]
        return (self.id is None, *(h - (1 << 64) if h >> 63 else h for h in halves))


def value_key(value) -> ValueKey:
    """The id key for a plain value: int, str or UUID."""
    if isinstance(value, ValueKey):
        return value
    if isinstance(value, uuid_lib.UUID):
        return UuidKey(value)
    return LongKey(value) if isinstance(value, int) else StringKey(value)


@dataclass(frozen=True, eq=False)
class TimeKey(Key):
    """A point in time."""

    id: ValueKey
    start: int

    def __post_init__(self):
        object.__setattr__(self, "id", value_key(self.id))

    @property
    def end(self) -> int:
        return self.start

    active = False

    def group(self) -> int:
        return self.start

    def order(self) -> tuple:
        return (self.start, self.id.order(), self.end)

    def __eq__(self, other):
        return isinstance(other, TimeKey) and (self.id, self.start) == (other.id, other.start)

    def __hash__(self):
        return hash((self.id, self.start))


@dataclass(frozen=True, eq=False)
class TimeFrameKey(TimeKey):
    """A closed interval of time."""

    end: int = field(default=None)

    def __post_init__(self):
        super().__post_init__()
        if self.end is None or self.end < self.start:
            raise ValueError("a frame must not end before it starts")

    def overlaps(self, low: int, high: int) -> bool:
        return self.end >= low and self.start <= high

    def is_after(self, low: int, high: int) -> bool:
        return self.start > high and self.end > high


class ActiveTimeKey(TimeKey):
    """A time that has started and not ended."""

    active = True

    def overlaps(self, low: int, high: int) -> bool:
        return self.start <= high


KEY_TYPES = {c.__name__: c for c in (IntegerKey, LongKey, LongTimeKey, StringKey, UuidKey, TimeKey, TimeFrameKey, ActiveTimeKey)}
ID_TYPES = {IntegerKey: T.IntegerType(), LongKey: T.LongType(), LongTimeKey: T.LongType(), StringKey: T.StringType(), UuidKey: T.StringType()}


def is_time(key_type: type) -> bool:
    return issubclass(key_type, TimeKey)


# -- the same as columns


def group_of(id_type: type, column: Column) -> Column:
    """The grouping number of an id column."""
    if id_type is IntegerKey:
        return column.cast("bigint") + F.lit(1 << 31)
    if id_type is LongKey:
        return F.call_function("div", column, F.lit(2).cast("bigint")) + F.lit(1 << 62)
    if id_type is LongTimeKey:
        return column
    if id_type is StringKey:
        return hashing.hash_group(F.coalesce(hashing.string_hash(column), F.lit(0).cast("bigint")))
    return hashing.hash_group(F.coalesce(hashing.uuid_hash(column), F.lit(0).cast("bigint")))


def id_order(id_type: type, column: Column) -> list[Column]:
    """Columns that sort ids in key order: numbers by value, strings and UUIDs by their hash first."""
    if id_type in (IntegerKey, LongKey, LongTimeKey):
        return [column]
    if id_type is StringKey:
        return [group_of(id_type, column), F.when(column.isNull(), F.lit(1)).otherwise(F.lit(0)), hashing.utf16(column)]
    return [group_of(id_type, column), F.when(column.isNull(), F.lit(1)).otherwise(F.lit(0)), *hashing.uuid_halves(column)]


def effective_end() -> Column:
    """Where a time key ends; a point, or one still active, ends at its start for the order's sake."""
    return F.coalesce(F.col(END), F.col(START))


def key_order(key_type: type, id_type: type) -> list[Column]:
    """Columns that sort a collection in natural key order."""
    if is_time(key_type):
        return [F.col(START), *id_order(id_type, F.col(ID)), effective_end()]
    return id_order(id_type, F.col(ID))


def overlap(low: int | None, high: int | None) -> Column:
    """Whether time keys overlap the closed interval; a bound of None is open. An active key has no end."""
    found = F.lit(True)
    if high is not None:
        found = found & (F.col(START) <= F.lit(high))
    if low is not None:
        found = found & (F.col(ACTIVE) | (effective_end() >= F.lit(low)))
    return found


def key_columns(key_type: type) -> list[str]:
    return [ID, START, END, ACTIVE] if is_time(key_type) else [ID]


def identity(key_type: type) -> list[str]:
    """The columns that make a key unique."""
    return [ID, START] if is_time(key_type) else [ID]


def key_row(key: Key) -> dict:
    """A key as column values."""
    plain = lambda v: str(v) if isinstance(v, uuid_lib.UUID) else v
    if isinstance(key, TimeKey):
        end = key.end if isinstance(key, TimeFrameKey) else None
        return {ID: plain(key.id.id), START: key.start, END: end, ACTIVE: key.active}
    return {ID: plain(key.id)}


def key_from_row(row, key_type: type, id_type: type) -> Key:
    """The key that a row's columns describe."""
    own = id_type(row[ID])
    if not is_time(key_type):
        return own
    if row[ACTIVE]:
        return ActiveTimeKey(own, row[START])
    return TimeKey(own, row[START]) if row[END] is None else TimeFrameKey(own, row[START], row[END])


def matches(key: Key) -> Column:
    """Rows whose key equals the given one."""
    row = key_row(key)
    found = F.col(ID).eqNullSafe(F.lit(row[ID]))
    return found & (F.col(START) == F.lit(row[START])) if isinstance(key, TimeKey) else found
