"""Databases and collections: the library's front door."""

from __future__ import annotations

import contextlib
import json
import threading
import time
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateKeyError, MissingKeyError, NoSuchCollectionError, NoSuchIndexError, StoreError
from ..functions import keys as K
from ..functions import segments
from ..functions.encryption import KeyRing
from ..operators import indexes, mutations
from ..plans.conditions import Index, NoMatch
from ..plans.query import Query
from .files import Files
from .table import Table

V1, V2 = 1, 2
_locks: dict[str, threading.RLock] = {}
_locks_lock = threading.Lock()


def _lock(path: str) -> threading.RLock:
    """One writer at a time for each collection; collections do not wait for each other."""
    with _locks_lock:
        return _locks.setdefault(path, threading.RLock())


class ReadCollection:
    """A collection for reading. Until it is created it is empty; once it is, the same object shows its rows."""

    def __init__(self, table: Table, key_type: type, id_type: type | None = None, values: T.StructType | None = None):
        self.table, self.name, self.spark = table, table.name, table.spark
        self._key_type, self._id_type, self._values = key_type, id_type or (key_type if not K.is_time(key_type) else K.LongKey), values

    @property
    def meta(self) -> dict:
        if self.table.exists():
            return self.table.meta()
        return {"key_type": self._key_type, "id_type": self._id_type, "values": self._values or T.StructType(), "width": None, "version": V2, "sealed": False}

    key_type = property(lambda self: self.meta["key_type"])
    id_type = property(lambda self: self.meta["id_type"])

    def frame(self) -> DataFrame:
        return self.table.rows() if self.table.exists() else self.spark.createDataFrame([], self.table.schema(self.meta))

    def query(self) -> Query:
        """A query over the rows of the moment in which it runs."""
        meta, empty = self.meta, self.spark.createDataFrame([], self.table.schema(self.meta))
        if not self.table.exists():
            return Query(empty, meta["key_type"], meta["id_type"], self.name)
        active_works, timed = meta["version"] == V2, K.is_time(meta["key_type"])

        def scan(query: Query) -> DataFrame:
            return self.table.overlapping(query.low, query.high, query.start_only, query.active if active_works else None) if timed else self.table.rows()

        return Query(empty, meta["key_type"], meta["id_type"], self.name, meta["width"], self.table.longest_span(), active_works, scan=scan)

    def _check(self, key: K.Key) -> None:
        """A collection takes its key type and what derives from it: time keys of all shapes are time keys."""
        if not isinstance(key, self.key_type):
            raise StoreError(f"{self.name} has {self.key_type.__name__} keys, not {type(key).__name__}")

    def _at(self, key: K.Key) -> DataFrame:
        self._check(key)
        width = self.meta["width"]
        return (self.table.rows(only=[segments.floor(key.group(), width)]) if width else self.frame()).where(K.matches(key))

    def _row(self, key: K.Key) -> Row | None:
        return next(iter(self._at(key).limit(1).collect()), None)

    def _value(self, row: Row | None) -> Row | None:
        return None if row is None else Row(**{k: v for k, v in row.asDict().items() if not k.startswith("k_")})

    def get(self, key: K.Key) -> Row | None:
        return self._value(self._row(key))

    def contains(self, key: K.Key) -> bool:
        return self._row(key) is not None

    def last_key(self) -> K.Key | None:
        row = next(iter(self.query().last_frame().collect()), None)
        return None if row is None else K.key_from_row(row, self.key_type, self.id_type)

    def last_value(self) -> Row | None:
        return self._value(next(iter(self.query().last_frame().collect()), None))

    # -- indexes

    def _index_names(self) -> dict[str, Index]:
        found = {}
        for name in self.table.files.names("indexes"):
            own = json.loads(self.table.files.read(f"indexes/{name}"))
            found[own["name"]] = Index(own["name"], K.KEY_TYPES[own["key_type"]], own["sql"], own["multi"], self.name)
        return found

    def get_index(self, name: str, key_type: type) -> Index:
        found = self._index_names().get(name)
        if found is None:
            raise NoSuchIndexError(name)
        if found.key_type is not key_type:
            raise StoreError(f"index {name} has {found.key_type.__name__} keys")
        return found

    def index_condition(self, name: str, key_type: type):
        """A condition on an index; one that nothing meets while the index does not exist."""
        try:
            return self.get_index(name, key_type).condition(key_type)
        except NoSuchIndexError:
            return NoMatch(Index(name, key_type, "null", False, self.name))

    def last_index_key(self, name: str, key_type: type):
        row = indexes.last_index_key(self.frame(), self.get_index(name, key_type), self.key_type).first()
        return None if row is None else row.index_key

    def matching_keys(self, condition) -> DataFrame:
        found = indexes.matching_keys(self.frame(), condition, self.key_type)
        return indexes.in_order(found, condition.index, self.key_type, self.id_type)


class Configuration:
    """Settings that a caller's function gives, asked again after ``POLL`` seconds.

    ``validate`` (true by default): rows of a DataFrame must have the collection's key and value columns with their types, and
    no null in its key. Where the function fails, the last settings stay.
    """

    POLL = 60.0

    def __init__(self, source: Callable[[], Mapping] | None = None):
        self._source, self._settings, self._asked = source, {}, None

    def get(self, name: str, default=None):
        now = time.monotonic()
        if self._source is not None and (self._asked is None or now - self._asked >= self.POLL):
            with contextlib.suppress(Exception):
                self._settings = dict(self._source())
            self._asked = now
        return self._settings.get(name, default)


class Collection(ReadCollection):
    """A collection for reading and writing."""

    def __init__(self, table: Table, key_type: type, configuration: Configuration | None = None):
        super().__init__(table, key_type)
        self.configuration = configuration or Configuration()

    def _validate(self, rows: DataFrame) -> None:
        if not self.configuration.get("validate", True):
            return
        own = K.identity(self.key_type)
        missing = [f.name for f in self.table.schema(self.meta).fields if f.name not in (*rows.columns, K.SEGMENT)]
        if missing:
            raise StoreError(f"columns are missing: {missing}")
        for field in self.meta["values"].fields:
            if rows.schema[field.name].dataType != field.dataType:
                raise StoreError(f"{field.name} is {rows.schema[field.name].dataType.simpleString()}, not {field.dataType.simpleString()}")
        nullable = [c for c in own if rows.schema[c].nullable]
        if nullable and not rows.where(" OR ".join(f"{c} IS NULL" for c in nullable)).isEmpty():
            raise StoreError("a key has a null")

    def _rows(self, pairs: Iterable[tuple[K.Key, Mapping]]) -> DataFrame:
        """Keys and values as rows; the last of equal keys counts."""
        meta, rows = self.meta, {}
        fields = [f.name for f in meta["values"].fields]
        for key, value in pairs:
            self._check(key)
            value = value.asDict() if isinstance(value, Row) else value
            unknown = set(value) - set(fields)
            if unknown:
                raise StoreError(f"{self.name} has no fields {sorted(unknown)}")
            rows[key] = tuple(K.key_row(key).values()) + tuple(value.get(f) for f in fields)
        schema = T.StructType(self.table.schema(meta).fields[:-1])
        return self.spark.createDataFrame(list(rows.values()), schema)

    def _merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Rewrites the segments that changes touch. Changes are evaluated once."""
        with _lock(self.table.path):
            placed, staged = self.table.stage(self.table.placed(changes))
            try:
                touched = [r[0] for r in placed.select(K.SEGMENT).distinct().collect()]  # as many rows as segments
                if touched:
                    self.table.commit(combine(self.table.rows(only=touched), placed), touched)
            finally:
                self.table.files.delete(staged)

    def _rewrite(self, query: Query, change: Callable[[DataFrame, Column], DataFrame]) -> None:
        """Rewrites the segments that hold matches of a query. The query is evaluated once."""
        with _lock(self.table.path):
            matched, staged = self.table.stage(query.rows().select(*K.identity(self.key_type), K.SEGMENT, F.lit(True).alias("_met")))
            try:
                touched = [r[0] for r in matched.select(K.SEGMENT).distinct().collect()]
                if touched:
                    joined = self.table.rows(only=touched).join(matched.drop(K.SEGMENT), K.identity(self.key_type), "left")
                    self.table.commit(change(joined, F.col("_met")).drop("_met"), touched)
            finally:
                self.table.files.delete(staged)

    # -- by key

    def insert(self, key: K.Key, value: Mapping) -> None:
        with _lock(self.table.path):
            if self.contains(key):
                raise DuplicateKeyError(f"{key} is stored already")
            self._merge(self._rows([(key, value)]), lambda stored, new: stored.unionByName(new))

    def insert_all(self, rows: DataFrame) -> None:
        """Inserts key and value columns; if any key is stored already or comes twice, nothing is."""
        self._validate(rows)

        def combine(stored: DataFrame, new: DataFrame) -> DataFrame:
            if not mutations.repeated(new, self.key_type).isEmpty():
                raise DuplicateKeyError("a key comes twice")
            if not mutations.duplicates(stored, new, self.key_type).isEmpty():
                raise DuplicateKeyError("a key is stored already")
            return stored.unionByName(new)

        self._merge(rows, combine)

    def batch_upsert(self, changes: Mapping | Iterable[tuple[K.Key, Mapping]] | DataFrame, replace_keys: bool = False, order: str | None = None) -> None:
        """Inserts or overwrites. A DataFrame has key and value columns and may be of any size; of its rows with equal keys the
        last by the column ``order`` counts, and without one any of them."""
        if isinstance(changes, DataFrame):
            self._validate(changes)
            rows = mutations.last_of_each(changes, self.key_type, order)
        else:
            rows = self._rows(changes.items() if isinstance(changes, Mapping) else changes)
        self._merge(rows, lambda stored, new: mutations.upsert(stored, new, self.key_type, replace_keys))

    def batch_upsert_keys_and_values(self, changes) -> None:
        self.batch_upsert(changes, replace_keys=True)

    def _replace_row(self, key: K.Key, new_key: K.Key, value: Mapping | None) -> None:
        if new_key != key:
            raise StoreError("the new key must equal the old one")
        if value is None:
            return self.delete(key)
        self._merge(self._rows([(new_key, value)]), lambda stored, new: mutations.upsert(stored, new, self.key_type, True))

    def _stored(self, key: K.Key) -> tuple[K.Key, dict]:
        row = self._row(key)
        if row is None:
            raise MissingKeyError(f"{key} is not stored")
        return K.key_from_row(row, self.key_type if not K.is_time(self.key_type) else K.TimeKey, self.id_type), self._value(row).asDict(True)

    def update(self, key: K.Key, updater: Callable[[dict], None]) -> None:
        """The updater changes a copy of the value."""
        with _lock(self.table.path):
            stored, value = self._stored(key)
            updater(value)
            self._replace_row(stored, stored, value)

    def replace(self, key: K.Key, mapper: Callable[[dict], Mapping | None]) -> None:
        """The mapper returns the new value; None deletes."""
        with _lock(self.table.path):
            stored, value = self._stored(key)
            self._replace_row(stored, stored, mapper(value))

    def update_key_and_value(self, key: K.Key, updater: Callable[[dict], K.Key]) -> None:
        """The updater changes a copy of the value and returns an equal key of any shape."""
        with _lock(self.table.path):
            stored, value = self._stored(key)
            self._replace_row(stored, updater(value), value)

    def replace_key_and_value(self, key: K.Key, mapper: Callable[[dict], tuple[K.Key, Mapping]]) -> None:
        with _lock(self.table.path):
            stored, value = self._stored(key)
            self._replace_row(stored, *mapper(value))

    def delete(self, key: K.Key) -> None:
        """A key that is not stored is no error."""
        self._check(key)
        keys = self._rows([(key, {})])
        with _lock(self.table.path):
            if self.contains(key):
                self._merge(keys, lambda stored, new: mutations.delete_keys(stored, new, self.key_type))

    # -- by query

    def _by_function(self, query: Query, function: Callable[[dict], object], returns: str) -> None:
        """Rewrites matches by a Python function over batches of rows; keys stay as they are unless it returns new ones."""
        meta = self.meta
        values = meta["values"]
        timed = K.is_time(meta["key_type"])
        made = T.StructType([T.StructField("gone", T.BooleanType()), T.StructField("end", T.LongType()), T.StructField("active", T.BooleanType()), T.StructField("value", values)])

        def run(ids, starts, ends, actives, rows):
            out = []
            for i in range(len(ids)):
                value = dict(rows[i])
                end, active = (ends[i], actives[i]) if timed else (None, None)
                if returns in ("key", "both"):
                    row = Row(**{K.ID: ids[i], K.START: starts[i], K.END: end, K.ACTIVE: active})
                    old = K.key_from_row(row, K.TimeKey if timed else meta["key_type"], meta["id_type"])
                    result = function(old, value)
                    new, result = (result, value) if returns == "key" else result
                    if new != old:
                        raise StoreError("the new key must equal the old one")
                    own = K.key_row(new)
                    end, active = own.get(K.END), own.get(K.ACTIVE)
                else:
                    result = function(value)
                    result = value if returns == "nothing" else result
                out.append((result is None, end, active, None if result is None else tuple(result.get(f) for f in values.names)))
            return out

        def batches(frames):
            import pandas as pd

            for frame in frames:
                records = frame["value"].tolist()
                plain = [r.asDict(True) if hasattr(r, "asDict") else dict(r) for r in records]
                lists = [frame[c].astype(object).where(frame[c].notna(), None).tolist() if c in frame else [None] * len(frame) for c in (K.ID, K.START, K.END, K.ACTIVE)]
                done = run(*lists, plain)
                own = frame.drop(columns=["value"])
                own["made"] = pd.Series([dict(zip(made.names, d, strict=True)) | {"value": None if d[3] is None else dict(zip(values.names, d[3], strict=True))} for d in done], index=own.index, dtype=object)
                yield own

        def change(rows: DataFrame, met: Column) -> DataFrame:
            names = [c for c in rows.columns if c not in values.names]
            packed = rows.where(F.coalesce(met, F.lit(False))).select(*names, F.struct(*values.names).alias("value"))
            schema = T.StructType([*(f for f in packed.schema.fields if f.name != "value"), T.StructField("made", made)])
            done = packed.mapInPandas(batches, schema).where(~F.col("made.gone"))
            new = {K.END: F.col("made.end"), K.ACTIVE: F.col("made.active")} if timed else {}
            done = done.select(*[new.get(c, F.col(c)).alias(c) for c in names], "made.value.*").select(*rows.columns)
            return rows.where(~F.coalesce(met, F.lit(False))).unionByName(done)

        self._rewrite(query, change)

    def update_each(self, query: Query, updater: Callable[[dict], None]) -> None:
        """For each match the updater changes a copy of the value. Runs on the executors, in batches."""
        self._by_function(query, updater, "nothing")

    def replace_each(self, query: Query, mapper: Callable[[dict], Mapping | None]) -> None:
        """For each match the mapper returns the new value; None deletes."""
        self._by_function(query, mapper, "value")

    def update_each_key_and_value(self, query: Query, updater: Callable[[K.Key, dict], K.Key]) -> None:
        """For each match the updater gets its key, changes a copy of the value and returns an equal key of any shape."""
        self._by_function(query, updater, "key")

    def replace_each_key_and_value(self, query: Query, mapper: Callable[[K.Key, dict], tuple[K.Key, Mapping]]) -> None:
        """For each match the mapper gets its key and value and returns an equal key of any shape and the new value."""
        self._by_function(query, mapper, "both")

    def delete_matches(self, query: Query) -> None:
        self._rewrite(query, lambda rows, met: mutations.delete_where(rows, met))

    def update_matches(self, query: Query, changes: Mapping[str, Column]) -> None:
        """New value columns, or new k_end and k_active, as expressions over the old row."""
        if {K.ID, K.START} & set(changes):
            raise StoreError("id and start of a key cannot change")
        self._rewrite(query, lambda rows, met: mutations.update_where(rows, met, changes))

    def replace_matches(self, query: Query, value: Mapping[str, Column]) -> None:
        self._rewrite(query, lambda rows, met: mutations.replace_where(rows, met, value))

    # -- indexes and upkeep

    def create_index(self, name: str, key_type: type, sql: str, multi: bool = False) -> Index:
        """Creates or returns an index on SQL text over the value columns; multi: the text gives an array."""
        existing = self._index_names().get(name)
        if existing is not None:
            if existing.key_type is not key_type:
                raise StoreError(f"index {name} has {existing.key_type.__name__} keys")
            return existing
        self.frame().select(F.expr(sql))  # fails here if the text is wrong
        self.table.files.write_new(f"indexes/{name}.json", json.dumps({"name": name, "key_type": key_type.__name__, "sql": sql, "multi": multi}))
        return Index(name, key_type, sql, multi, self.name)

    def create_indices(self, infos: Iterable[tuple]) -> list[Index]:
        """Creates several; one that fails does not keep the others from being created, and all failures are reported."""
        made, failed = [], []
        for info in infos:
            try:
                made.append(self.create_index(*info))
            except Exception as error:
                failed.append(f"{info[0]}: {error}")
        if failed:
            raise StoreError("; ".join(failed))
        return made

    def optimize(self) -> None:
        with _lock(self.table.path):
            self.table.optimize()


class CollectionBuilder:
    """Options of a collection to be created or opened; stored options win over requested ones."""

    def __init__(self, database: Database, name: str, key_type: type, values: T.StructType, id_type: type | None = None):
        self._database, self._name, self._key_type, self._values = database, name, key_type, values
        self._id_type = id_type or (key_type if not K.is_time(key_type) else K.LongKey)
        self._size, self._version, self._sealed = None, V1, False

    def with_segment_size(self, size: str) -> CollectionBuilder:
        segments.check_size(size, self._key_type if K.is_time(self._key_type) else self._id_type)
        self._size = size
        return self

    def with_version(self, version: int) -> CollectionBuilder:
        """Rows are stored once in either version; in version 1 a query ignores whether keys are active."""
        if version not in (V1, V2):
            raise ValueError("version is 1 or 2")
        self._version = version
        return self

    def with_encryption(self) -> CollectionBuilder:
        """Values are stored encrypted, with the current key of the database's ring; keys stay readable for pruning."""
        if self._database.ring is None:
            raise ValueError("the database was opened without keys")
        self._sealed = True
        return self

    def build(self) -> Collection:
        table = self._database.table(self._name)
        if not table.exists():
            size = self._size or segments.default_size(self._key_type if K.is_time(self._key_type) else self._id_type)
            table.create(self._key_type, self._id_type, self._values, size, self._version, self._sealed)
        meta = table.meta()
        if not issubclass(meta["key_type"], self._key_type) or meta["id_type"] is not self._id_type:
            raise StoreError(f"{self._name} has {meta['key_type'].__name__} keys")
        if meta["values"] != self._values:
            raise StoreError(f"{self._name} has other values")
        return Collection(table, self._key_type, configuration=self._database.configuration)


class Database:
    """A folder of collections."""

    def __init__(self, spark: SparkSession, root: str = "./intervalis-data", read_only: bool = False, ring: KeyRing | None = None, configuration: Callable[[], Mapping] | None = None, skip_corrupt: bool = False):
        """ring: keys of encrypted collections. configuration: see ``Configuration``. skip_corrupt: damaged files are left out."""
        self.spark, self.root, self.read_only, self._open = spark, root.rstrip("/"), read_only, True
        self.ring, self.configuration, self.skip_corrupt = ring, Configuration(configuration), skip_corrupt

    def table(self, name: str) -> Table:
        return Table(self.spark, self.root, name, self.ring, self.skip_corrupt)

    def _writable(self) -> None:
        if self.read_only:
            raise StoreError("the database is open for reading only")
        if not self._open:
            raise StoreError("the database is shut down")

    def collection_builder(self, name: str, key_type: type, values: T.StructType, id_type: type | None = None) -> CollectionBuilder:
        self._writable()
        return CollectionBuilder(self, name, key_type, values, id_type)

    time_collection_builder = collection_builder

    def names(self) -> list[str]:
        files = Files(self.spark, self.root)
        return [n for n in files.names() if files.exists(f"{n}/meta.json")]

    def get_collection(self, name: str, key_type: type = K.Key, values: T.StructType | None = None):
        """Read-write: the collection, or None. Read-only: always an object, empty until the collection exists."""
        table = self.table(name)
        if not table.exists():
            return ReadCollection(table, key_type, values=values) if self.read_only else None
        meta = table.meta()
        if key_type is not K.Key and not issubclass(meta["key_type"], key_type):
            raise StoreError(f"{name} has {meta['key_type'].__name__} keys")
        return ReadCollection(table, meta["key_type"]) if self.read_only else Collection(table, meta["key_type"], configuration=self.configuration)

    def get_time_collection(self, name: str, values: T.StructType | None = None):
        found = self.get_collection(name, K.TimeKey, values)
        if found is not None and not K.is_time(found.key_type):
            raise StoreError(f"{name} is no time collection")
        return found

    def require(self, name: str):
        found = self.get_collection(name)
        if found is None:
            raise NoSuchCollectionError(name)
        return found

    def backup(self, target: str, low: int | None = None, high: int | None = None) -> None:
        from .backup import backup

        backup(self, target, low, high)

    def shutdown(self) -> None:
        self._open = False

    shutdown_now = shutdown

    def await_termination(self, timeout: float | None = None) -> bool:
        """Changes run on the caller's thread, so nothing is left to wait for."""
        return not self._open


def open_database(spark: SparkSession, root: str = "./intervalis-data", read_only: bool = False, **options) -> Database:
    return Database(spark, root, read_only, **options)
