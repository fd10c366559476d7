"""Mutations of keyed tables as plans: each takes the stored rows and gives the rows after the change."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K


def last_of_each(changes: DataFrame, key_type: type, order: str | None = None) -> DataFrame:
    """One row for each key: the last by an order column, else any."""
    own = K.identity(key_type)
    if order is None:
        return changes.dropDuplicates(own)
    ranked = changes.withColumn("_rank", F.row_number().over(W.partitionBy(*own).orderBy(F.col(order).desc())))
    return ranked.where("_rank = 1").drop("_rank", order)


def repeated(rows: DataFrame, key_type: type) -> DataFrame:
    """Keys that rows have more than once."""
    return rows.groupBy(*K.identity(key_type)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def duplicates(stored: DataFrame, new: DataFrame, key_type: type) -> DataFrame:
    """New rows whose key is stored already."""
    return new.join(stored.select(*K.identity(key_type)), K.identity(key_type), "left_semi")


def insert_new(stored: DataFrame, new: DataFrame, key_type: type) -> DataFrame:
    """Stored rows and those new rows whose key is not stored."""
    return stored.unionByName(new.join(stored.select(*K.identity(key_type)), K.identity(key_type), "left_anti"))


def upsert(stored: DataFrame, changes: DataFrame, key_type: type, replace_keys: bool = False) -> DataFrame:
    """Changes replace rows with an equal key, others are added; one full outer join on the key.

    A changed row takes the new key's columns. Without replace_keys it stays as active as it was if the ends are equal,
    since then the two keys have one place in the order.
    """
    own = K.identity(key_type)
    columns = stored.columns
    old = stored.select(*own, F.lit(True).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in columns if c not in own])
    new = changes.select(*own, F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in columns if c not in own])
    both = old.join(new, own, "full_outer")

    def pick(c: str) -> Column:
        if c in own:
            return F.col(c)
        chosen = F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}"))
        if c == K.ACTIVE and not replace_keys:
            same_end = F.coalesce(F.col(f"_new_{K.END}"), F.col(K.START)) == F.coalesce(F.col(f"_old_{K.END}"), F.col(K.START))
            chosen = F.when(F.col("_new") & F.col("_old") & same_end, F.col(f"_old_{c}")).otherwise(chosen)
        return chosen.alias(c)

    return both.select(*[pick(c) for c in columns])


def update_where(stored: DataFrame, condition: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Rows that meet the condition get new column values, computed from the old ones."""
    met = F.coalesce(condition, F.lit(False))
    return stored.withColumns({c: F.when(met, v).otherwise(F.col(c)) for c, v in changes.items()})


def replace_where(stored: DataFrame, condition: Column, value: Mapping[str, Column]) -> DataFrame:
    """Rows that meet the condition get a whole new value: columns that it does not name become null."""
    names = [c for c in stored.columns if not c.startswith("k_")]
    return update_where(stored, condition, {c: value.get(c, F.lit(None)) for c in names})


def delete_where(stored: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet the condition; where it is null they stay."""
    return stored.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(stored: DataFrame, keys: DataFrame, key_type: type) -> DataFrame:
    """Rows whose key is not in the set; keys that are not stored are ignored."""
    return stored.join(keys.select(*K.identity(key_type)), K.identity(key_type), "left_anti")


def complete_active(stored: DataFrame, condition: Column, end: Column) -> DataFrame:
    """Active rows that meet the condition become frames that end at the given time."""
    return update_where(stored, condition & F.col(K.ACTIVE), {K.END: end, K.ACTIVE: F.lit(False)})
