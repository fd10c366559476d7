"""Lookups in secondary indexes: an index is a derived column, so it is always in step with its table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..plans.conditions import Index, IndexCondition


def entries(frame: DataFrame, index: Index, key_type: type, name: str = "index_key") -> DataFrame:
    """One row for each index value of each row: the value and the row's key columns."""
    return frame.select(F.explode(index.values()).alias(name), *[c for c in K.key_columns(key_type) if c in frame.columns])


def matching_keys(frame: DataFrame, condition: IndexCondition, key_type: type, name: str = "index_key") -> DataFrame:
    """Index values that meet the condition, with their keys; a key comes once for each such value."""
    return entries(frame, condition.index, key_type, name).where(condition.on_value(F.col(name)))


def in_order(found: DataFrame, index: Index, key_type: type, id_type: type, name: str = "index_key") -> DataFrame:
    """By index value in key order, then by key."""
    return found.orderBy(*K.id_order(index.key_type, F.col(name)), *K.key_order(key_type, id_type))


def last_index_key(frame: DataFrame, index: Index, key_type: type) -> DataFrame:
    """The greatest index value in key order; numbers need no sort."""
    found = entries(frame, index, key_type)
    if index.key_type in (K.IntegerKey, K.LongKey):
        return found.agg(F.max("index_key").alias("index_key"))
    return found.orderBy(*[c.desc() for c in K.id_order(index.key_type, F.col("index_key"))]).limit(1).select("index_key")


def extract_all(frame: DataFrame, indexes: list[Index]) -> DataFrame:
    """All indexes' values beside the row, from one scan."""
    return frame.select("*", *[i.values().alias(f"index_{i.name}") for i in indexes])
