"""Backups: whole databases, or only what overlaps a time frame."""

from __future__ import annotations

import shutil

from pyspark.sql import DataFrame

from ..functions import keys as K
from .table import Table


def time_slice(frame: DataFrame, low: int | None, high: int | None, key_type: type) -> DataFrame:
    """Time rows that overlap the frame; rows of other collections all."""
    return frame.where(K.overlap(low, high)) if K.is_time(key_type) and (low is not None or high is not None) else frame


def backup(database, target: str, low: int | None = None, high: int | None = None) -> None:
    """Writes every collection, its description and its indexes to a database folder at target."""
    for name in database.names():
        source, copy = database.table(name), Table(database.spark, target, name, database.ring)
        meta = source.meta()
        copy.create(meta["key_type"], meta["id_type"], meta["values"], meta["size"], meta["version"], meta["sealed"])
        for index in source.files.names("indexes"):
            source.files.copy(f"indexes/{index}", f"{copy.path}/indexes/{index}")
        bounded = K.is_time(meta["key_type"]) and (low is not None or high is not None)
        rows = time_slice(source.overlapping(low, high), low, high, meta["key_type"]) if bounded else source.rows()
        copy.commit(rows, [r[0] for r in rows.select(K.SEGMENT).distinct().collect()])  # as many rows as segments


def zip_folder(folder: str, archive: str) -> str:
    """A zip of a local folder; the name without .zip."""
    return shutil.make_archive(archive, "zip", folder)


def unzip(archive: str, folder: str) -> None:
    shutil.unpack_archive(archive, folder, "zip")
