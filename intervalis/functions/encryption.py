"""Encryption of value columns with Spark's AES functions; each payload names the key version that wrote it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyRing:
    """Keys of 16, 24 or 32 bytes by version name; the current one writes, all of them read."""

    def __init__(self, keys: Mapping[str, bytes], current: str | None):
        for name in keys:
            if not name.strip() or len(name) > 20:
                raise ValueError("a key version is a name of 1 to 20 characters")
        if current is not None and current not in keys:
            raise ValueError("the current key is not in the ring")
        self.keys, self.current = dict(keys), current

    @property
    def enabled(self) -> bool:
        return self.current is not None


def seal(df: DataFrame, ring: KeyRing, columns: list[str], payload: str = "payload") -> DataFrame:
    """Replaces columns by one encrypted payload and its key version; without a current key the payload is plain JSON."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("{}")
    body: Column = F.aes_encrypt(text, F.lit(ring.keys[ring.current])) if ring.enabled else text.cast("binary")
    return df.withColumns({payload: body, f"{payload}_key": F.lit(ring.current)}).drop(*columns)


def unseal(df: DataFrame, ring: KeyRing, schema: str | T.StructType, payload: str = "payload") -> DataFrame:
    """Gives the columns back, whichever key of the ring wrote them."""
    text = F.when(F.col(f"{payload}_key").isNull(), F.col(payload).cast("string"))
    for name, key in ring.keys.items():
        text = text.when(F.col(f"{payload}_key") == name, F.aes_decrypt(payload, F.lit(key)).cast("string"))
    return df.withColumn("_value", F.from_json(text, schema)).select(*[c for c in df.columns if not c.startswith(payload)], "_value.*")
