"""Versioned keyed tables on Parquet.

    <collection>/meta.json                    key types, value schema, segment size, version, indexes
    <collection>/versions/<n>.json            of each segment: which writes hold it, and its longest frame
    <collection>/data/w=<write>/k_active=<a>/k_segment=<s>   rows, sorted by key in each file (no k_active without times)

A change rewrites the segments it touches under a new write and commits by creating the next version file, which readers see
whole or not at all. Old versions stay readable until they are cleaned away. A write that no version names is an orphan of a
failed change or belongs to a change that has not committed yet; ``recover`` removes it once it is old enough.

Rows that are still active lie apart, since they overlap all later times: a query with a lower bound reads them from earlier
segments too, and completed rows only from segments whose longest frame reaches the bound.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StoreError
from ..functions import keys as K
from ..functions import segments
from ..functions.encryption import KeyRing, seal, unseal
from .files import Files

#: Versions kept by default; older ones go with the commits that follow.
KEEP_VERSIONS = 200
#: Seconds after which a write that no version names counts as abandoned.
GRACE = 24 * 3600.0
_PAYLOAD = "payload"


class Table:
    """Rows of one collection."""

    def __init__(self, spark: SparkSession, root: str, name: str, ring: KeyRing | None = None, skip_corrupt: bool = False):
        """ring: the keys of an encrypted table. skip_corrupt: files that cannot be read are left out instead of failing a query."""
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"
        self.ring, self.skip_corrupt = ring, skip_corrupt
        self.files = Files(spark, self.path)

    # -- description

    def exists(self) -> bool:
        return self.files.exists("meta.json")

    def create(self, key_type: type, id_type: type, values: T.StructType, size: str, version: int, sealed: bool = False) -> None:
        width = segments.check_size(size, key_type if K.is_time(key_type) else id_type)
        meta = {"key_type": key_type.__name__, "id_type": id_type.__name__, "values": json.loads(values.json()), "size": size, "width": width, "version": version, "sealed": sealed}
        self.files.write_new("meta.json", json.dumps(meta))
        self.files.write_new("versions/00000000.json", json.dumps({"segments": {}}))

    def meta(self) -> dict:
        meta = json.loads(self.files.read("meta.json"))
        return meta | {"key_type": K.KEY_TYPES[meta["key_type"]], "id_type": K.KEY_TYPES[meta["id_type"]], "values": T.StructType.fromJson(meta["values"])}

    def schema(self, meta: dict | None = None) -> T.StructType:
        meta = meta or self.meta()
        id_field = T.StructField(K.ID, K.ID_TYPES[meta["id_type"]])
        time = [T.StructField(K.START, T.LongType()), T.StructField(K.END, T.LongType()), T.StructField(K.ACTIVE, T.BooleanType())]
        return T.StructType([id_field, *(time if K.is_time(meta["key_type"]) else []), *meta["values"].fields, T.StructField(K.SEGMENT, T.LongType())])

    # -- versions

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        version = max(self.versions()) if version is None else version
        return version, json.loads(self.files.read(f"versions/{version:08d}.json"))

    def _ring(self, meta: dict) -> KeyRing:
        if self.ring is None:
            raise StoreError(f"{self.name} is encrypted; open the database with its keys")
        return self.ring

    def _read(self, held: dict[str, list], meta: dict, active: bool | None = None) -> DataFrame:
        """held: the writes of completed and of active rows of each segment."""
        timed, schema = K.is_time(meta["key_type"]), self.schema(meta)
        paths = []
        for segment, (completed, still_active, _) in sorted(held.items()):
            for write, flag in ((completed, False), (still_active, True)):
                if write and active in (None, flag):
                    kind = f"/{K.ACTIVE}={str(flag).lower()}" if timed else ""
                    paths.append(f"{self.path}/data/w={write}{kind}/{K.SEGMENT}={segment}")
        if not paths:
            return self.spark.createDataFrame([], schema)
        fields = [f for f in schema.fields if f not in meta["values"].fields] if meta["sealed"] else schema.fields
        payload = [T.StructField(_PAYLOAD, T.BinaryType()), T.StructField(f"{_PAYLOAD}_key", T.StringType())] if meta["sealed"] else []
        reader = self.spark.read.schema(T.StructType([*fields, *payload, T.StructField("w", T.StringType())])).option("basePath", f"{self.path}/data")
        rows = reader.option("ignoreCorruptFiles", str(self.skip_corrupt).lower()).parquet(*paths).drop("w")
        if meta["sealed"]:
            rows = unseal(rows, self._ring(meta), meta["values"], _PAYLOAD)
        return rows.select(*schema.names)

    def rows(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table at a version; if only is given, just these segments."""
        _, manifest = self.manifest(version)
        wanted = None if only is None else set(only)
        return self._read({s: w for s, w in manifest["segments"].items() if wanted is None or int(s) in wanted}, self.meta())

    def overlapping(self, low: int | None, high: int | None, start_only: bool = False, active: bool | None = None) -> DataFrame:
        """Rows of all segments that can hold time keys within the bounds; paths of others are not even listed."""
        meta, (_, manifest) = self.meta(), self.manifest()
        held = {}
        for segment, (completed, still_active, span) in manifest["segments"].items():
            first, last = int(segment), int(segment) + meta["width"] - 1
            if high is not None and first > high:
                continue
            begins = low is None or last >= low
            done = completed if begins or (not start_only and last + span >= low) else None
            live = still_active if begins or not start_only else None
            if done or live:
                held[segment] = [done, live, span]
        return self._read(held, meta, active)

    def longest_span(self) -> int:
        return max([0, *(span for _, _, span in self.manifest()[1]["segments"].values())])

    def placed(self, rows: DataFrame, meta: dict | None = None) -> DataFrame:
        """Rows with their segment."""
        meta = meta or self.meta()
        timed = K.is_time(meta["key_type"])
        group = F.col(K.START) if timed else K.group_of(meta["id_type"], F.col(K.ID))
        segment = F.when(group.isNull(), F.raise_error(F.lit("a key has a null")).cast("bigint")).otherwise(segments.segment_of(group, meta["width"]))
        placed = rows.withColumn(K.SEGMENT, segment)
        if timed:  # a row is active or not; both are folders
            placed = placed.withColumn(K.ACTIVE, F.coalesce(F.col(K.ACTIVE).cast("boolean"), F.lit(False)))
        return placed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema(meta).fields])

    def commit(self, rows: DataFrame, touched: list[int], keep: int = KEEP_VERSIONS) -> int:
        """Makes rows the content of the touched segments. Tasks take ranges of segment and key, so a large segment has several files.

        Versions beyond the newest ``keep`` go, with the data only they used.
        """
        meta, (version, manifest) = self.meta(), self.manifest()
        timed = K.is_time(meta["key_type"])
        write = f"{version + 1:08d}-{uuid.uuid4().hex[:8]}"
        order = K.key_order(meta["key_type"], meta["id_type"])
        target = f"{self.path}/data/w={write}"
        parts = [K.ACTIVE, K.SEGMENT] if timed else [K.SEGMENT]
        written: dict[str, list] = {}
        if touched:
            rows = self.placed(rows, meta).repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order)
            if meta["sealed"]:
                rows = seal(rows, self._ring(meta), meta["values"].names, _PAYLOAD)
            rows.write.partitionBy(*parts).parquet(target)
            for flag in (False, True) if timed else (False,):
                folder = f"data/w={write}/{K.ACTIVE}={str(flag).lower()}" if timed else f"data/w={write}"
                for name in self.files.names(folder):
                    if name.startswith(f"{K.SEGMENT}="):
                        written.setdefault(name.partition("=")[2], [None, None, 0])[flag] = write
            if timed and any(w[0] for w in written.values()):
                spans = self._read(written, meta, False).groupBy(K.SEGMENT).agg(F.max(F.col(K.END) - F.col(K.START)).alias("span"))
                for row in spans.collect():  # as many rows as segments
                    written[str(row[K.SEGMENT])][2] = max(0, row.span or 0)
        gone = set(touched)
        held = {s: w for s, w in manifest["segments"].items() if int(s) not in gone} | written
        if not self.files.write_new(f"versions/{version + 1:08d}.json", json.dumps({"segments": held})):
            self.files.delete(f"data/w={write}")
            raise StoreError("another writer has committed in between")
        if len(self.versions()) > keep:
            self.clean(keep)
        return version + 1

    def stage(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """Writes rows aside, so that a change sees the same ones each time it reads them; and the folder, to be deleted."""
        name = f"staging/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}"), name

    # -- upkeep

    def optimize(self) -> int:
        """Rewrites all segments, one sorted file set each."""
        _, manifest = self.manifest()
        return self.commit(self.rows(), [int(s) for s in manifest["segments"]])

    def clean(self, keep: int = KEEP_VERSIONS) -> None:
        """Drops all but the newest versions, and the writes only they used. A write never comes back once no version names it."""
        versions = self.versions()
        old, kept = versions[: max(0, len(versions) - keep)], versions[max(0, len(versions) - keep) :]
        used = {w for v in kept for *writes, _ in self.manifest(v)[1]["segments"].values() for w in writes if w}
        for version in old:
            for write in {w for *writes, _ in self.manifest(version)[1]["segments"].values() for w in writes if w} - used:
                self.files.delete(f"data/w={write}")
            self.files.delete(f"versions/{version:08d}.json")

    def recover(self, grace: float = GRACE) -> list[str]:
        """Removes writes that no version names and that nobody has touched for grace seconds; returns them.

        Younger ones may belong to a change of another session that has not committed yet.
        """
        used = {w for v in self.versions() for *writes, _ in self.manifest(v)[1]["segments"].values() for w in writes if w}
        gone = []
        for folder, known in (("data", used), ("staging", set())):
            for name in self.files.names(folder):
                if name.removeprefix("w=") not in known and self.files.age(f"{folder}/{name}") >= grace:
                    self.files.delete(f"{folder}/{name}")
                    gone.append(name.removeprefix("w="))
        return gone
