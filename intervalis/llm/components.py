"""Connected components by joins and aggregations, after a local union in each task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

#: Edges that one task unites in its memory.
LOCAL_EDGES = 100_000
SALTS = 32
_LABELS = T.StructType([T.StructField("node", T.LongType()), T.StructField("label", T.LongType())])


def union(pairs) -> dict[int, int]:
    """Each node's smallest connected node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _local_stars(batches):
    import pyarrow as pa

    found = union(pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=_LABELS.names)


def by_label(rows: DataFrame, table: DataFrame, spread_by: str, how: str = "inner") -> DataFrame:
    """Joins rows with a table of one row for each label. A label that very many rows have is spread over SALTS tasks."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return dealt.join(salted.hint("merge"), ["label", "_salt"], how).drop("_salt")  # never broadcast: copies would multiply it


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes that have an edge.

    Each task first turns its edges, at most about LOCAL_EDGES, into stars. Where that took one task, it is the result. Else
    each round lets every node take the smallest label around it and then the label of its label, so paths halve; every
    round's labels are written to the shared folder. Labels never meet on the driver, and a hub's edges are aggregated before
    they are shuffled.
    """
    pairs = edges.select(F.col(a).cast("bigint").alias("node"), F.col(b).cast("bigint").alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    tasks = 1 + pairs.count() // LOCAL_EDGES
    stars = materialize(pairs.coalesce(tasks).mapInArrow(_local_stars, _LABELS), "stars")
    if tasks == 1:
        return stars
    one_way = stars.select("node", F.col("label").alias("other")).where("node <> other")
    both = materialize(one_way.union(one_way.select(F.col("other"), F.col("node"))).distinct(), "edges")
    discard(stars)
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        lower, before = materialize(lower, "labels"), labels
        # the label of the label; a label is itself a node
        targets = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        hops = lower.select("label").distinct().join(targets, "label")
        jumped = by_label(lower, hops, "node").select("node", F.least("label", "next").alias("label"), "was")
        labels = materialize(jumped, "labels")
        discard(lower, before)
        if labels.where("label <> was").isEmpty():
            discard(both)
            return labels.select("node", "label")
