"""The query builder: immutable, and compiled to one conjunction that Catalyst plans."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import segments
from .conditions import Index, IndexCondition

#: Key sets up to this size become literals, which prune files; larger ones are joined.
LITERAL_KEYS = 200


@dataclass(frozen=True)
class Query:
    """A conjunction of conditions on one collection.

    ``frame`` has the key columns and the value columns; ``width`` is the segment width, None if it has no segment column;
    ``span`` is the longest frame, None if unknown.
    """

    frame: DataFrame
    key_type: type
    id_type: type
    name: str = ""
    width: int | None = None
    span: int | None = None
    active_mode_works: bool = True
    low: int | None = None
    high: int | None = None
    start_only: bool = False
    active: bool | None = None
    wheres: tuple[Column, ...] = ()
    #: Reads what the conditions allow of a stored collection; frame then only has its columns.
    scan: Callable[[Query], DataFrame] | None = None
    key_sets: tuple[DataFrame, ...] = ()
    value_sets: tuple[tuple[Index, DataFrame], ...] = ()

    # -- conditions

    def where(self, condition: Column | IndexCondition | Callable | None) -> Query:
        """A column, a condition on an index of this collection, or a Python function of the value (slow: rows leave the JVM)."""
        if condition is None:
            return self
        if isinstance(condition, IndexCondition):
            if condition.index.collection != self.name:
                raise ValueError(f"the index belongs to collection {condition.index.collection}")
            condition = condition.predicate()
        elif not isinstance(condition, Column):
            values = [c for c in self.frame.columns if not c.startswith("k_")]
            condition = F.udf(lambda row, test=condition: bool(test(row)), "boolean")(F.struct(*values))
        return replace(self, wheres=(*self.wheres, condition))

    def where_key_in(self, keys: Iterable[K.Key] | DataFrame | None) -> Query:
        """Keys equal to one of the set. Repeated calls intersect. A DataFrame may be of any size."""
        if keys is None:
            return self
        own = K.identity(self.key_type)
        if isinstance(keys, DataFrame):
            return replace(self, key_sets=(*self.key_sets, keys.select(*own)))
        keys = list(keys)
        if len(keys) <= LITERAL_KEYS:
            found = F.lit(False)
            for key in keys:
                found = found | K.matches(key)
            if keys and self.width:
                groups = sorted({segments.floor(k.group(), self.width) for k in keys})
                found = found & F.col(K.SEGMENT).isin(groups)
            return replace(self, wheres=(*self.wheres, found))
        rows = [tuple(K.key_row(k)[c] for c in own) for k in keys]
        schema = ", ".join(f"{c} {self.frame.schema[c].dataType.simpleString()}" for c in own)
        return replace(self, key_sets=(*self.key_sets, self.frame.sparkSession.createDataFrame(rows, schema)))

    def where_index_in(self, index: Index, values: DataFrame) -> Query:
        """Rows with a value of the index in the only column of ``values``, which may be of any size: a semi-join."""
        if index.collection != self.name:
            raise ValueError(f"the index belongs to collection {index.collection}")
        return replace(self, value_sets=(*self.value_sets, (index, values)))

    def _time(self) -> None:
        if not K.is_time(self.key_type):
            raise TypeError("only time collections have time conditions")

    def _bound(self, low: int | None, high: int | None) -> Query:
        self._time()
        if low is not None:
            low = low if self.low is None else max(self.low, low)
        if high is not None:
            high = high if self.high is None else min(self.high, high)
        return replace(self, low=self.low if low is None else low, high=self.high if high is None else high)

    def before(self, time: int) -> Query:
        return self._bound(None, max(K.LONG_MIN, time - 1))

    def before_or_at(self, time: int) -> Query:
        return self._bound(None, time)

    def after(self, time: int) -> Query:
        return self._bound(min(K.LONG_MAX, time + 1), None)

    def after_or_at(self, time: int) -> Query:
        return self._bound(time, None)

    def by_start_time(self) -> Query:
        """The start itself must be in the bounds, so that neighbouring ranges share no row."""
        self._time()
        return replace(self, start_only=True)

    def _mode(self, active: bool) -> Query:
        self._time()
        if self.active not in (None, active):
            raise RuntimeError("a query is for active keys or for others, not for both")
        return replace(self, active=active)

    def key_is_active(self) -> Query:
        return self._mode(True)

    def key_is_not_active(self) -> Query:
        return self._mode(False)

    # -- compilation

    def predicate(self) -> Column:
        """All conditions but the joined key sets."""
        found = F.lit(True)
        if self.low is not None or self.high is not None:
            if self.start_only:
                if self.low is not None:
                    found = found & (F.col(K.START) >= F.lit(self.low))
                if self.high is not None:
                    found = found & (F.col(K.START) <= F.lit(self.high))
            else:
                found = found & K.overlap(self.low, self.high)
            if self.width:
                found = found & segments.time_pruning(self.low, self.high, self.width, self.span, self.start_only)
        if self.active is not None and self.active_mode_works:
            found = found & (F.col(K.ACTIVE) if self.active else ~F.col(K.ACTIVE))
        for condition in self.wheres:
            found = found & condition
        return found

    def rows(self) -> DataFrame:
        """Matching rows with their keys, in no order."""
        found = (self.scan(self) if self.scan else self.frame).where(self.predicate())
        for keys in self.key_sets:
            found = found.join(keys.distinct(), K.identity(self.key_type), "left_semi")
        for index, values in self.value_sets:
            wanted = values.toDF("_wanted").distinct()
            if index.multi:
                met = found.select(*K.identity(self.key_type), F.explode(index.values()).alias("_value")).join(wanted, F.col("_value") == F.col("_wanted"), "left_semi")
                found = found.join(met.select(*K.identity(self.key_type)).distinct(), K.identity(self.key_type), "left_semi")
            else:
                found = found.withColumn("_value", F.expr(index.sql)).join(wanted, F.col("_value") == F.col("_wanted"), "left_semi").drop("_value")
        return found

    def order(self) -> list[Column]:
        return K.key_order(self.key_type, self.id_type)

    def ordered(self) -> DataFrame:
        return self.rows().orderBy(*self.order())

    def ranked(self, parts: int = 64) -> DataFrame:
        """All matching rows and k_rank, their place in key order from 1. Rows are dealt into ranges of the leading order column,
        numbered within each range, and moved up by the sizes of the ranges before; no task gets all rows."""
        lead, *rest = self.order()
        keyed = self.rows().withColumn("_lead", lead)
        cuts = keyed.agg(F.percentile_approx("_lead", [i / parts for i in range(1, parts)])).first()[0] or []
        part = F.lit(0)
        for cut in sorted(set(cuts)):
            part = part + F.coalesce((F.col("_lead") >= F.lit(cut)).cast("int"), F.lit(0))
        keyed = keyed.withColumn("_part", part)
        before, offsets = 0, [F.lit(0), F.lit(0).cast("bigint")]
        for row in sorted(keyed.groupBy("_part").count().collect()):
            offsets += [F.lit(row["_part"]), F.lit(before).cast("bigint")]
            before += row["count"]
        place = F.row_number().over(Window.partitionBy("_part").orderBy("_lead", *rest))
        ranks = F.create_map(*offsets[2:] or offsets)
        return keyed.withColumn("k_rank", place + ranks[F.col("_part")]).drop("_lead", "_part")

    def _values(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[c for c in rows.columns if not c.startswith("k_")])

    # -- results

    def values(self) -> DataFrame:
        """Values of matching rows in key order."""
        return self._values(self.ordered())

    def count_frame(self) -> DataFrame:
        return self.rows().agg(F.count(F.lit(1)).alias("count"))

    def count(self) -> int:
        return self.rows().count()

    def first_frame(self) -> DataFrame:
        """The first match in key order, or none: a top-1, not a full sort."""
        return self.ordered().limit(1)

    def first(self):
        return next(iter(self._values(self.first_frame()).collect()), None)

    def list(self) -> list:
        return self.values().collect()

    def iterator(self, timeout: float | None = None):
        from ..operators.cursor import Cursor

        return Cursor(self.values(), timeout)

    def last_frame(self) -> DataFrame:
        """The last match in key order."""
        return self.rows().orderBy(*[c.desc() for c in self.order()]).limit(1)
