"""Conditions on secondary indexes, as immutable builders that compile to one Spark predicate.

An index has one or many values for each row. All tests chained on one condition must hold for the same value; two conditions
of a query may be met by different values. Chained tests follow fixed rules, checked when they are called: a value set or a
free test cannot follow an equality, and of two equalities the last one counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedConditionError
from ..functions import keys as K


@dataclass(frozen=True)
class Index:
    """A named derived column of a collection: SQL text that gives a value or an array of values."""

    name: str
    key_type: type
    sql: str
    multi: bool
    collection: str

    def values(self) -> Column:
        """The row's index values as an array without nulls; a null list is an empty one."""
        column = F.expr(self.sql)
        if not self.multi:
            column = F.when(column.isNotNull(), F.array(column)).otherwise(F.array().cast(f"array<{K.ID_TYPES[self.key_type].simpleString()}>"))
            return column
        return F.coalesce(F.filter(column, lambda v: v.isNotNull()), F.array().cast(f"array<{K.ID_TYPES[self.key_type].simpleString()}>"))

    def condition(self, kind: type) -> IndexCondition:
        if kind is not self.key_type:
            raise UnsupportedConditionError(f"index {self.name} has {self.key_type.__name__} values, not {kind.__name__}")
        return (RangeCondition if kind in (K.IntegerKey, K.LongKey) else IndexCondition)(self)

    def integer_condition(self) -> RangeCondition:
        return self.condition(K.IntegerKey)

    def long_condition(self) -> RangeCondition:
        return self.condition(K.LongKey)

    def string_condition(self) -> IndexCondition:
        return self.condition(K.StringKey)

    def uuid_condition(self) -> IndexCondition:
        return self.condition(K.UuidKey)


def _no_null(value):
    if value is None:
        raise ValueError("a condition needs a value")
    return value


@dataclass(frozen=True)
class IndexCondition:
    """Tests on the values of one index."""

    index: Index
    equal: object = None
    tests: tuple[Callable[[Column], Column], ...] = ()

    def _and(self, test: Callable[[Column], Column]):
        return replace(self, tests=(*self.tests, test))

    def is_equal_to(self, value):
        return replace(self, equal=str(_no_null(value)) if self.index.key_type is K.UuidKey else _no_null(value))

    def is_in(self, values: Iterable):
        """Repeated calls intersect; an empty set matches no row."""
        if self.equal is not None:
            raise RuntimeError("a set cannot follow an equality")
        own = [str(v) if self.index.key_type is K.UuidKey else v for v in _no_null(values)]
        return self._and(lambda v: v.isin(own) if own else F.lit(False))

    def meets(self, test: Callable[[Column], Column]):
        if self.equal is not None:
            raise RuntimeError("a free test cannot follow an equality")
        return self._and(_no_null(test))

    def on_value(self, value: Column) -> Column:
        found = F.lit(True) if self.equal is None else value == F.lit(self.equal)
        for test in self.tests:
            found = found & test(value)
        return F.coalesce(found, F.lit(False))

    def predicate(self) -> Column:
        """A scalar index compares its column directly, so the file scan can use statistics."""
        if self.index.multi:
            return F.exists(self.index.values(), self.on_value)
        value = F.expr(self.index.sql)
        found = value.isNotNull()
        if self.equal is not None:
            found = found & (value == F.lit(self.equal))
        for test in self.tests:
            found = found & test(value)
        return found


@dataclass(frozen=True)
class RangeCondition(IndexCondition):
    """Conditions of numeric indexes, which also have ranges; both ends belong to a range."""

    def is_in_range(self, low: int, high: int):
        return self._and(lambda v: v.between(F.lit(low), F.lit(high)))

    def is_less_than(self, value: int):
        return self._and(lambda v: v < F.lit(value))

    def is_at_most(self, value: int):
        return self._and(lambda v: v <= F.lit(value))

    def is_greater_than(self, value: int):
        return self._and(lambda v: v > F.lit(value))

    def is_at_least(self, value: int):
        return self._and(lambda v: v >= F.lit(value))


@dataclass(frozen=True)
class NoMatch(RangeCondition):
    """The condition of an index that does not exist yet: nothing meets it."""

    def on_value(self, value: Column) -> Column:
        return F.lit(False)

    def predicate(self) -> Column:
        return F.lit(False)
