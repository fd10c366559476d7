"""A catalogue of queries over the driver's tables, each with the SQL that must give the same rows.

Tables become collections as follows: events are a time collection (errors are still active, other events last some minutes),
orders and suppliers have long keys, nations and parts integer keys, customers string keys.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing, segments
from ..functions import keys as K
from ..operators import indexes, mutations
from .conditions import Index
from .query import Query

A, B = 1704700000000, 1705000000000
DAY = segments.SIZES["TIME_1_DAY"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The longest event but those that are still active.
LONGEST = 239 * 60_000


def _at(time: int):
    """A literal of the table's own time type, so that a comparison reaches the file scan."""
    return F.lit(f"{datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=time)}").cast("timestamp_ntz")


def events_frame(spark: SparkSession, sf_dir: str, query: Query | None = None) -> DataFrame:
    """Events with their keys; of a query's bounds those that the table's own columns can express go down to the scan."""
    table = _table(spark, sf_dir, "events")
    if query is not None and query.high is not None:
        table = table.where(F.col("ts") < _at(query.high + 1))
    if query is not None and query.low is not None:
        long_ago = F.col("ts") >= _at(query.low - (0 if query.start_only else LONGEST))
        table = table.where(long_ago if query.start_only else long_ago | (F.col("event_type") == "error"))
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    active = F.col("event_type") == "error"
    end = F.when(~active, start + (F.col("event_id") % 240) * 60000)
    return table.select(
        F.col("event_id").alias(K.ID), start.alias(K.START), end.alias(K.END), active.alias(K.ACTIVE), "user_id", "event_type", "value"
    )


def events(spark: SparkSession, sf_dir: str) -> Query:
    return Query(events_frame(spark, sf_dir), K.TimeKey, K.LongKey, "events", scan=lambda query: events_frame(spark, sf_dir, query))


EV = """WITH ev AS (SELECT event_id AS k_id, epoch_us(ts) // 1000 AS k_start,
 CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 + (event_id % 240) * 60000 END AS k_end,
 event_type = 'error' AS k_active, user_id, event_type, value FROM events) """
_ALL = "SELECT k_id, k_start, k_end, k_active, user_id, event_type, value FROM ev"
_OVERLAP = f"k_start < {B} AND (k_active OR k_end >= {A})"

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _time(name: str, where: str, build) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(events(spark, sf_dir)).rows()
    ORACLE[name] = f"{EV}{_ALL} WHERE {where}"


# -- time conditions


@_add("time_overlap", f"{EV}{_ALL} WHERE {_OVERLAP}")
def time_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that overlap an interval, in key order."""
    return events(spark, sf_dir).after_or_at(A).before(B).ordered()


_time("time_before", f"k_start < {B}", lambda q: q.before(B))
_time("time_before_or_at", f"k_start <= {B}", lambda q: q.before_or_at(B))
_time("time_after", f"k_active OR k_end > {A}", lambda q: q.after(A))
_time("time_after_or_at", f"k_active OR k_end >= {A}", lambda q: q.after_or_at(A))
_time("time_by_start", f"k_start BETWEEN {A} AND {B - 1}", lambda q: q.after_or_at(A).before(B).by_start_time())
_time("time_active", f"{_OVERLAP} AND k_active", lambda q: q.after_or_at(A).before(B).key_is_active())
_time("time_not_active", f"{_OVERLAP} AND NOT k_active", lambda q: q.after_or_at(A).before(B).key_is_not_active())
_time("time_narrowed", f"k_start < {B} AND (k_active OR k_end >= {A + 3_600_000})", lambda q: q.after_or_at(A).after(A + 3_599_999).before_or_at(B + 5).before(B))
_time("where_object", "value > 100 AND event_type <> 'view'", lambda q: q.where((F.col("value") > 100) & (F.col("event_type") != "view")))
_time("where_object_and_time", f"{_OVERLAP} AND value > 100", lambda q: q.where(F.col("value") > 100).after_or_at(A).before(B))
_time("where_function", f"{_OVERLAP} AND event_type = 'click'", lambda q: q.after_or_at(A).before(B).where(lambda v: v.event_type == "click"))
_time("query_all", "true", lambda q: q)


@_add("segment_pruned_overlap", f"{EV}SELECT k_id, k_start, k_end, k_active FROM ev WHERE {_OVERLAP}")
def segment_pruned_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap with the predicates on segments that prune a partitioned table; the longest event lasts 239 minutes."""
    frame = events_frame(spark, sf_dir).withColumn(K.SEGMENT, segments.segment_of(F.col(K.START), DAY))
    query = Query(frame, K.TimeKey, K.LongKey, "events", DAY, LONGEST, scan=lambda q: events_frame(spark, sf_dir, q).withColumn(K.SEGMENT, segments.segment_of(F.col(K.START), DAY)))
    return query.after_or_at(A).before(B).rows().select(K.ID, K.START, K.END, K.ACTIVE)


# -- keys

_SET = "k_id % 7 = 3"


@_add("where_key_in", f"{EV}SELECT k_id, k_start FROM ev WHERE {_SET}")
def where_key_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key set of any size is a semi-join."""
    keys = events_frame(spark, sf_dir).where(F.col(K.ID) % 7 == 3)
    return events(spark, sf_dir).where_key_in(keys).rows().select(K.ID, K.START)


@_add("key_in_with_bounds", f"{EV}SELECT k_id, k_start FROM ev WHERE {_SET} AND {_OVERLAP}")
def key_in_with_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = events_frame(spark, sf_dir).where(F.col(K.ID) % 7 == 3)
    return events(spark, sf_dir).where_key_in(keys).after_or_at(A).before(B).rows().select(K.ID, K.START)


@_add("key_in_intersection", f"{EV}SELECT k_id, k_start FROM ev WHERE {_SET} AND k_id % 5 = 1")
def key_in_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events_frame(spark, sf_dir)
    found = events(spark, sf_dir).where_key_in(own.where(F.col(K.ID) % 7 == 3)).where_key_in(own.where(F.col(K.ID) % 5 == 1))
    return found.rows().select(K.ID, K.START)


@_add("key_in_literals", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 9, 33, 100000000)")
def key_in_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _table(spark, sf_dir, "orders").withColumn(K.ID, F.col("o_orderkey"))
    return Query(frame, K.LongKey, K.LongKey, "orders").where_key_in([K.LongKey(i) for i in (1, 5, 9, 33, 100000000)]).rows().select("o_orderkey", "o_totalprice")


@_add("get_by_key", f"{EV}{_ALL} WHERE k_id = 42")
def get_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key, as literals that reach the scan."""
    return events(spark, sf_dir).where_key_in([_key_of(spark, sf_dir, 42)]).rows()


def _key_of(spark: SparkSession, sf_dir: str, event: int) -> K.TimeKey:
    return K.TimeKey(event, events_frame(spark, sf_dir).where(F.col(K.ID) == event).first()[K.START])


@_add("contains_key", "SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 7")
def contains_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _table(spark, sf_dir, "orders").withColumn(K.ID, F.col("o_orderkey"))
    return frame.where(K.matches(K.LongKey(7))).agg((F.count(F.lit(1)) > 0).alias("found"))


# -- counts, first and last


@_add("count_all", "SELECT count(*)::BIGINT AS count FROM events")
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).count_frame()


@_add("count_overlap", f"{EV}SELECT count(*)::BIGINT AS count FROM ev WHERE {_OVERLAP}")
def count_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).after_or_at(A).before(B).count_frame()


@_add("first_in_order", f"{EV}{_ALL} WHERE {_OVERLAP} ORDER BY k_start, k_id, coalesce(k_end, k_start) LIMIT 1")
def first_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).after_or_at(A).before(B).first_frame()


@_add("last_key", f"{EV}SELECT k_id, k_start, k_end, k_active FROM ev ORDER BY k_start DESC, k_id DESC, coalesce(k_end, k_start) DESC LIMIT 1")
def last_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).last_frame().select(K.ID, K.START, K.END, K.ACTIVE)


@_add("last_value", f"{EV}SELECT user_id, event_type, value FROM ev ORDER BY k_start DESC, k_id DESC, coalesce(k_end, k_start) DESC LIMIT 1")
def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).last_frame().select("user_id", "event_type", "value")


@_add("values_only", f"{EV}SELECT user_id, event_type, value FROM ev WHERE {_OVERLAP}")
def values_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).after_or_at(A).before(B).values()


# -- scalar indexes


def _keyed(spark: SparkSession, sf_dir: str, name: str, key: str, kind: type) -> Query:
    frame = _table(spark, sf_dir, name).withColumn(K.ID, F.col(key))
    return Query(frame, kind, kind, name)


SIZE = Index("size", K.IntegerKey, "p_size", False, "part")
CUSTOMER = Index("customer", K.LongKey, "o_custkey", False, "orders")
PRIORITY = Index("priority", K.StringKey, "o_orderpriority", False, "orders")
EVENT_UUID = Index("uuid", K.UuidKey, "regexp_replace(md5(cast(event_id as string)), '(.{8})(.{4})(.{4})(.{4})(.{12})', '$1-$2-$3-$4-$5')", False, "event_rows")


def _on_part(name: str, where: str, build) -> None:
    QUERIES[name] = lambda spark, sf_dir: _keyed(spark, sf_dir, "part", "p_partkey", K.LongKey).where(build(SIZE.integer_condition())).rows().select("p_partkey", "p_size")
    ORACLE[name] = f"SELECT p_partkey, p_size FROM part WHERE {where}"


def _on_orders(name: str, where: str, build) -> None:
    QUERIES[name] = lambda spark, sf_dir: _keyed(spark, sf_dir, "orders", "o_orderkey", K.LongKey).where(build()).rows().select("o_orderkey", "o_custkey", "o_orderpriority")
    ORACLE[name] = f"SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE {where}"


_on_part("index_int_eq", "p_size = 15", lambda c: c.is_equal_to(15))
_on_part("index_int_in", "p_size IN (1, 7, 49)", lambda c: c.is_in({1, 7, 49}))
_on_part("index_int_in_intersection", "p_size = 7", lambda c: c.is_in({1, 7, 49}).is_in({7, 8}))
_on_part("index_int_in_empty", "false", lambda c: c.is_in(set()))
_on_part("index_int_range", "p_size BETWEEN 10 AND 20", lambda c: c.is_in_range(10, 20))
_on_part("index_int_range_empty", "false", lambda c: c.is_in_range(20, 10))
_on_part("index_int_lt", "p_size < 5", lambda c: c.is_less_than(5))
_on_part("index_int_le", "p_size <= 5", lambda c: c.is_at_most(5))
_on_part("index_int_gt", "p_size > 45", lambda c: c.is_greater_than(45))
_on_part("index_int_ge", "p_size >= 45", lambda c: c.is_at_least(45))
_on_part("index_int_meets", "p_size % 10 = 3", lambda c: c.meets(lambda v: v % 10 == 3))
_on_part("index_int_chained", "p_size > 5 AND p_size <= 9 AND p_size % 2 = 0", lambda c: c.is_greater_than(5).is_at_most(9).meets(lambda v: v % 2 == 0))
_on_part("index_int_equal_twice", "p_size = 8", lambda c: c.is_equal_to(15).is_equal_to(8))
_on_orders("index_long_eq", "o_custkey = 17", lambda: CUSTOMER.long_condition().is_equal_to(17))
_on_orders("index_long_range", "o_custkey BETWEEN 20 AND 60", lambda: CUSTOMER.long_condition().is_in_range(20, 60))
_on_orders("index_long_bounds", "o_custkey > 30 AND o_custkey < 40", lambda: CUSTOMER.long_condition().is_greater_than(30).is_less_than(40))
_on_orders("index_long_le", "o_custkey <= 12", lambda: CUSTOMER.long_condition().is_at_most(12))
_on_orders("index_long_ge", "o_custkey >= 90", lambda: CUSTOMER.long_condition().is_at_least(90))
_on_orders("index_long_in", "o_custkey IN (3, 17, 88)", lambda: CUSTOMER.long_condition().is_in({3, 17, 88}))
_on_orders("index_string_eq", "o_orderpriority = '1-URGENT'", lambda: PRIORITY.string_condition().is_equal_to("1-URGENT"))
_on_orders("index_string_in", "o_orderpriority IN ('1-URGENT', '5-LOW')", lambda: PRIORITY.string_condition().is_in(["1-URGENT", "5-LOW"]))
_on_orders("index_string_meets", "o_orderpriority LIKE '%E%'", lambda: PRIORITY.string_condition().meets(lambda v: v.like("%E%")))


@_add("index_uuid_eq", "SELECT event_id FROM events WHERE md5(event_id::VARCHAR) = md5('1234')")
def index_uuid_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib
    import uuid

    wanted = uuid.UUID(hashlib.md5(b"1234").hexdigest())
    found = _keyed(spark, sf_dir, "events", "event_id", K.LongKey)
    return Query(found.frame, K.LongKey, K.LongKey, "event_rows").where(EVENT_UUID.uuid_condition().is_equal_to(wanted)).rows().select("event_id")


@_add("index_uuid_in", "SELECT event_id FROM events WHERE event_id IN (7, 99, 1234)")
def index_uuid_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib
    import uuid

    wanted = [uuid.UUID(hashlib.md5(str(i).encode()).hexdigest()) for i in (7, 99, 1234)]
    frame = _keyed(spark, sf_dir, "events", "event_id", K.LongKey).frame
    return Query(frame, K.LongKey, K.LongKey, "event_rows").where(EVENT_UUID.uuid_condition().is_in(wanted)).rows().select("event_id")


@_add("index_in_frame", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def index_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value set of any size is a semi-join."""
    wanted = _table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return _keyed(spark, sf_dir, "orders", "o_orderkey", K.LongKey).where_index_in(CUSTOMER, wanted).rows().select("o_orderkey", "o_custkey")


@_add("index_last_key", "SELECT max(o_custkey) AS index_key FROM orders")
def index_last_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.last_index_key(_keyed(spark, sf_dir, "orders", "o_orderkey", K.LongKey).frame, CUSTOMER, K.LongKey)


# -- multi-valued indexes: the suppliers of an order

SUPPLIERS = Index("suppliers", K.LongKey, "suppliers", True, "order_lines")
_LINES = "WITH o AS (SELECT l_orderkey, list(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey) "


def _order_lines(spark: SparkSession, sf_dir: str) -> Query:
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias(K.ID)).agg(F.collect_list("l_suppkey").alias("suppliers"))
    return Query(lines, K.LongKey, K.LongKey, "order_lines")


@_add("index_multi_same_value", "SELECT DISTINCT l_orderkey AS k_id FROM lineitem WHERE l_suppkey > 50 AND l_suppkey < 52")
def index_multi_same_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests chained on one condition hold for one value."""
    return _order_lines(spark, sf_dir).where(SUPPLIERS.long_condition().is_greater_than(50).is_less_than(52)).rows().select(K.ID)


@_add("index_multi_two_conditions", "SELECT l_orderkey AS k_id FROM lineitem WHERE l_suppkey > 50 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_suppkey < 10")
def index_multi_two_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two conditions may hold for two values."""
    found = _order_lines(spark, sf_dir).where(SUPPLIERS.long_condition().is_greater_than(50))
    return found.where(SUPPLIERS.long_condition().is_less_than(10)).rows().select(K.ID)


@_add("index_matching_keys", "SELECT l_suppkey AS index_key, l_orderkey AS k_id FROM lineitem WHERE l_suppkey BETWEEN 3 AND 5")
def index_matching_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key comes once for each of its values that meets the condition."""
    condition = SUPPLIERS.long_condition().is_in_range(3, 5)
    found = indexes.matching_keys(_order_lines(spark, sf_dir).frame, condition, K.LongKey)
    return indexes.in_order(found, SUPPLIERS, K.LongKey, K.LongKey)


@_add("index_multi_last_key", "SELECT max(l_suppkey) AS index_key FROM lineitem")
def index_multi_last_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.last_index_key(_order_lines(spark, sf_dir).frame, SUPPLIERS, K.LongKey)


@_add("create_indices", "SELECT o_orderkey, [o_custkey] AS index_customer, [o_orderpriority] AS index_priority FROM orders")
def create_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several indexes from one scan."""
    frame = _keyed(spark, sf_dir, "orders", "o_orderkey", K.LongKey).frame
    return indexes.extract_all(frame, [CUSTOMER, PRIORITY]).select("o_orderkey", "index_customer", "index_priority")


# -- order and placement


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296)"
_GROUP = f"((31 + {_HASH}) + 2147483648) % 4294967296"


@_add("rank_int_key", "SELECT n_nationkey, n_name, n_nationkey + 2147483648 AS k_group, row_number() OVER (ORDER BY n_nationkey) AS k_rank FROM nation")
def rank_int_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key order of all rows, as a column."""
    query = _keyed(spark, sf_dir, "nation", "n_nationkey", K.IntegerKey)
    return query.ranked().select("n_nationkey", "n_name", K.group_of(K.IntegerKey, F.col(K.ID)).alias(K.GROUP), "k_rank")


@_add("rank_long_key", "SELECT o_orderkey, o_orderkey // 2 + 4611686018427387904 AS k_group, row_number() OVER (ORDER BY o_orderkey) AS k_rank FROM orders")
def rank_long_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _keyed(spark, sf_dir, "orders", "o_orderkey", K.LongKey)
    return query.ranked().select("o_orderkey", K.group_of(K.LongKey, F.col(K.ID)).alias(K.GROUP), "k_rank")


@_add("rank_string_hash", f"SELECT c_name, k_group, row_number() OVER (ORDER BY k_group, c_name) AS k_rank FROM (SELECT c_name, {_GROUP} AS k_group FROM customer)")
def rank_string_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _keyed(spark, sf_dir, "customer", "c_name", K.StringKey)
    return query.ranked().select("c_name", K.group_of(K.StringKey, F.col(K.ID)).alias(K.GROUP), "k_rank")


@_add("string_hash", f"SELECT c_custkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM (SELECT c_custkey, {_HASH} AS h FROM customer)")
def string_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", hashing.string_hash(F.col("c_name")).alias("hash"))


@_add("segment_of", f"{EV}SELECT k_start - k_start % {DAY} AS k_segment, count(*)::BIGINT AS count FROM ev GROUP BY 1")
def segment_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = events_frame(spark, sf_dir).select(segments.segment_of(F.col(K.START), DAY).alias(K.SEGMENT))
    return placed.groupBy(K.SEGMENT).agg(F.count(F.lit(1)).alias("count"))


# -- mutations, as plans from the stored rows to the rows after the change

_COLUMNS = [K.ID, K.START, K.END, K.ACTIVE, "user_id", "event_type", "value"]


def _changes(frame: DataFrame, value: float) -> DataFrame:
    """Every tenth event with a new value, and for each of these one event with a new key."""
    tenth = frame.where(F.col(K.ID) % 10 == 0).withColumn("value", F.lit(value))
    return tenth.unionByName(tenth.withColumn(K.ID, F.col(K.ID) + 1_000_000_000))


_CHANGED = "c AS (SELECT k_id, k_start, k_end, k_active, user_id, event_type, {v} AS value FROM ev WHERE k_id % 10 = 0 UNION ALL SELECT k_id + 1000000000, k_start, k_end, k_active, user_id, event_type, {v} FROM ev WHERE k_id % 10 = 0)"
_KEPT = "SELECT k_id, k_start, k_end, k_active, user_id, event_type, value FROM ev WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k_id = ev.k_id AND c.k_start = ev.k_start)"


@_add("upsert_values", f"{EV}, {_CHANGED.format(v='-1.5::DOUBLE')} {_KEPT} UNION ALL SELECT * FROM c")
def upsert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = events_frame(spark, sf_dir)
    return mutations.upsert(frame, _changes(frame, -1.5), K.TimeKey).select(*_COLUMNS)


@_add(
    "upsert_keys_and_values",
    f"{EV}, c AS (SELECT k_id, k_start, k_start + 1000 AS k_end, false AS k_active, user_id, event_type, 7.0::DOUBLE AS value FROM ev WHERE k_id % 10 = 0) {_KEPT} UNION ALL SELECT * FROM c",
)
def upsert_keys_and_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = events_frame(spark, sf_dir)
    new = frame.where(F.col(K.ID) % 10 == 0).withColumns({K.END: F.col(K.START) + 1000, K.ACTIVE: F.lit(False), "value": F.lit(7.0)})
    return mutations.upsert(frame, new, K.TimeKey, replace_keys=True).select(*_COLUMNS)


@_add("insert_new", f"{EV}, {_CHANGED.format(v='-2.5::DOUBLE')} {_ALL} UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM ev WHERE c.k_id = ev.k_id AND c.k_start = ev.k_start)")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = events_frame(spark, sf_dir)
    return mutations.insert_new(frame, _changes(frame, -2.5), K.TimeKey).select(*_COLUMNS)


@_add("insert_duplicates", f"{EV}, {_CHANGED.format(v='-2.5::DOUBLE')} SELECT k_id, k_start FROM c WHERE EXISTS (SELECT 1 FROM ev WHERE c.k_id = ev.k_id AND c.k_start = ev.k_start)")
def insert_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that make an insert fail."""
    frame = events_frame(spark, sf_dir)
    return mutations.duplicates(frame, _changes(frame, -2.5), K.TimeKey).select(K.ID, K.START)


@_add("update_where", f"{EV}SELECT k_id, k_start, k_end, k_active, user_id, event_type, CASE WHEN {_OVERLAP} THEN value * 2 ELSE value END AS value FROM ev")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).after_or_at(A).before(B)
    return mutations.update_where(found.frame, found.predicate(), {"value": F.col("value") * 2}).select(*_COLUMNS)


@_add(
    "replace_where",
    f"{EV}SELECT k_id, k_start, k_end, k_active, CASE WHEN {_OVERLAP} THEN NULL ELSE user_id END AS user_id, CASE WHEN {_OVERLAP} THEN 'gone' ELSE event_type END AS event_type, CASE WHEN {_OVERLAP} THEN value + 1 ELSE value END AS value FROM ev",
)
def replace_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).after_or_at(A).before(B)
    return mutations.replace_where(found.frame, found.predicate(), {"event_type": F.lit("gone"), "value": F.col("value") + 1}).select(*_COLUMNS)


@_add(
    "complete_active",
    f"{EV}SELECT k_id, k_start, CASE WHEN k_active AND k_start < {B} THEN k_start + 60000 ELSE k_end END AS k_end, k_active AND k_start >= {B} AS k_active, user_id, event_type, value FROM ev",
)
def complete_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active events become frames."""
    found = events(spark, sf_dir).before(B)
    return mutations.complete_active(found.frame, found.predicate(), F.col(K.START) + 60000).select(*_COLUMNS)


@_add("delete_where", f"{EV}{_ALL} WHERE NOT coalesce({_OVERLAP}, false)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).after_or_at(A).before(B)
    return mutations.delete_where(found.frame, found.predicate()).select(*_COLUMNS)


@_add("delete_key", f"{EV}{_ALL} WHERE NOT ({_SET})")
def delete_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = events_frame(spark, sf_dir)
    gone = frame.where(F.col(K.ID) % 7 == 3).select(K.ID, K.START)
    return mutations.delete_keys(frame, gone, K.TimeKey).select(*_COLUMNS)


# -- storage: the same rows come back


def _stored(spark: SparkSession, sf_dir: str, sealed: bool = False, empty: bool = False, **options):
    """Events in a collection of a fresh database in the shared folder."""
    from ..sources.database import open_database
    from ..sources.scratch import scratch_folder

    frame = events_frame(spark, sf_dir)
    values = T.StructType([f for f in frame.schema.fields if not f.name.startswith("k_")])
    database = open_database(spark, scratch_folder(spark, "events"), **options)
    builder = database.collection_builder("events", K.TimeKey, values, K.LongKey).with_segment_size("TIME_1_DAY").with_version(2)
    collection = (builder.with_encryption() if sealed else builder).build()
    if not empty:
        collection.batch_upsert(frame)
    return database, collection


@_add("stored_overlap", f"{EV}{_ALL} WHERE {_OVERLAP}")
def stored_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap over a partitioned collection: only segments that can hold matches are listed and read."""
    _, collection = _stored(spark, sf_dir)
    return collection.query().after_or_at(A).before(B).rows().select(*_COLUMNS)


@_add("stored_after", f"{EV}{_ALL} WHERE k_active OR k_end >= {B}")
def stored_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower bound alone: of earlier segments only the active rows are read."""
    _, collection = _stored(spark, sf_dir)
    return collection.query().after_or_at(B).rows().select(*_COLUMNS)


@_add("stored_not_active", f"{EV}{_ALL} WHERE {_OVERLAP} AND NOT k_active")
def stored_not_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, collection = _stored(spark, sf_dir)
    return collection.query().after_or_at(A).before(B).key_is_not_active().rows().select(*_COLUMNS)


@_add("stored_get", f"{EV}{_ALL} WHERE k_id = 42")
def stored_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup reads one segment."""
    _, collection = _stored(spark, sf_dir)
    return collection.query().where_key_in([_key_of(spark, sf_dir, 42)]).rows().select(*_COLUMNS)


@_add("stored_read_only", f"{EV}{_ALL} WHERE k_start < {B}")
def stored_read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.database import open_database

    database, _ = _stored(spark, sf_dir)
    return open_database(spark, database.root, read_only=True).get_time_collection("events").query().before(B).rows().select(*_COLUMNS)


@_add("stored_missing_collection", f"{EV}{_ALL} WHERE false")
def stored_missing_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read-only database shows a collection that is not there yet as an empty one."""
    from ..sources.database import open_database

    database, collection = _stored(spark, sf_dir)
    reader = open_database(spark, database.root, read_only=True)
    return reader.get_time_collection("later", collection.meta["values"]).query().after(A).rows().select(*_COLUMNS)


@_add("stored_index", f"{EV}{_ALL} WHERE event_type = 'click' AND {_OVERLAP}")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is created once and fetched by name."""
    _, collection = _stored(spark, sf_dir)
    collection.create_index("kind", K.StringKey, "event_type")
    condition = collection.get_index("kind", K.StringKey).string_condition().is_equal_to("click")
    return collection.query().where(condition).after_or_at(A).before(B).rows().select(*_COLUMNS)


@_add("stored_missing_index", f"{EV}{_ALL} WHERE false")
def stored_missing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, collection = _stored(spark, sf_dir)
    return collection.query().where(collection.index_condition("none", K.LongKey).is_equal_to(1)).rows().select(*_COLUMNS)


@_add("stored_plain_keys", "SELECT o_orderkey AS k_id, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def stored_plain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection without times, with long keys."""
    from ..sources.database import open_database
    from ..sources.scratch import scratch_folder

    frame = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(K.ID), "o_custkey", "o_totalprice")
    database = open_database(spark, scratch_folder(spark, "orders"))
    orders = database.collection_builder("orders", K.LongKey, T.StructType(frame.schema.fields[1:])).build()
    orders.insert_all(frame)
    return orders.query().where(F.col("o_totalprice") > 1000).rows().select(K.ID, "o_custkey", "o_totalprice")


def _by_key(name: str, change, columns: str) -> None:
    """Registers a change of event 42; columns: the SQL of end, active, user, type and value of that event afterwards."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, collection = _stored(spark, sf_dir)
        change(collection, _key_of(spark, sf_dir, 42))
        return collection.frame().select(*_COLUMNS)

    QUERIES[name] = query
    changed = f" UNION ALL SELECT k_id, k_start, {columns} FROM ev WHERE k_id = 42" if columns else ""
    ORACLE[name] = f"{EV}{_ALL} WHERE k_id <> 42{changed}"


def _bump(value: dict) -> None:
    value["value"] = -2.0


_by_key("stored_update_one", lambda c, k: c.update(k, _bump), "k_end, k_active, user_id, event_type, -2.0::DOUBLE")
_by_key("stored_replace_one", lambda c, k: c.replace(k, lambda v: {"event_type": "new"}), "k_end, k_active, NULL, 'new', NULL")
_by_key("stored_update_key_and_value_one", lambda c, k: c.update_key_and_value(k, lambda v: _bump(v) or K.ActiveTimeKey(k.id, k.start)), "NULL, true, user_id, event_type, -2.0::DOUBLE")
_by_key("stored_replace_key_and_value_one", lambda c, k: c.replace_key_and_value(k, lambda v: (K.TimeFrameKey(k.id, k.start, k.start + 9), v | {"value": 1.5})), "k_start + 9, false, user_id, event_type, 1.5::DOUBLE")
_by_key("stored_delete_one", lambda c, k: c.delete(k), "")


@_add("stored_insert", f"{EV}{_ALL} UNION ALL SELECT k_id + 1000000000, k_start, k_end, k_active, user_id, event_type, value FROM ev WHERE k_id % 10 = 0")
def stored_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, collection = _stored(spark, sf_dir)
    collection.insert_all(events_frame(spark, sf_dir).where(F.col(K.ID) % 10 == 0).withColumn(K.ID, F.col(K.ID) + 1_000_000_000))
    return collection.frame().select(*_COLUMNS)


@_add("stored_update_each", f"{EV}SELECT k_id, k_start, k_end, k_active, user_id, event_type, CASE WHEN {_OVERLAP} THEN -2.0 ELSE value END AS value FROM ev")
def stored_update_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mass update by a Python function."""
    _, collection = _stored(spark, sf_dir)
    collection.update_each(collection.query().after_or_at(A).before(B), _bump)
    return collection.frame().select(*_COLUMNS)


@_add("stored_replace_each", f"{EV}SELECT k_id, k_start, k_end, k_active, user_id, CASE WHEN {_OVERLAP} THEN 'new' ELSE event_type END AS event_type, value FROM ev WHERE NOT coalesce({_OVERLAP} AND value > 100, false)")
def stored_replace_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mass replacement by a Python function, which may delete."""
    _, collection = _stored(spark, sf_dir)
    collection.replace_each(collection.query().after_or_at(A).before(B), lambda v: None if v["value"] is not None and v["value"] > 100 else v | {"event_type": "new"})
    return collection.frame().select(*_COLUMNS)


@_add(
    "stored_update_each_key_and_value",
    f"{EV}SELECT k_id, k_start, CASE WHEN {_OVERLAP} AND k_active THEN 1705000000000 ELSE k_end END AS k_end, k_active AND NOT coalesce({_OVERLAP}, false) AS k_active, user_id, event_type, CASE WHEN {_OVERLAP} AND k_active THEN -2.0 ELSE value END AS value FROM ev",
)
def stored_update_each_key_and_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active events become frames by a Python function that sees their keys."""
    _, collection = _stored(spark, sf_dir)
    collection.update_each_key_and_value(collection.query().after_or_at(A).before(B).key_is_active(), lambda key, v: _bump(v) or K.TimeFrameKey(key.id, key.start, B))
    return collection.frame().select(*_COLUMNS)


@_add("stored_encrypted", f"{EV}{_ALL} WHERE {_OVERLAP}")
def stored_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are stored encrypted and come back."""
    from ..functions.encryption import KeyRing

    _, collection = _stored(spark, sf_dir, sealed=True, ring=KeyRing({"first": b"0123456789abcdef"}, "first"))
    return collection.query().after_or_at(A).before(B).rows().select(*_COLUMNS)


@_add("stored_corrupt_file", f"{EV}{_ALL} WHERE {_OVERLAP}")
def stored_corrupt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is no Parquet file among a segment's files is left out."""
    _, collection = _stored(spark, sf_dir, skip_corrupt=True)
    segment, (write, _, _) = sorted(collection.table.manifest()[1]["segments"].items())[0]
    collection.table.files.write_new(f"data/w={write}/{K.ACTIVE}=false/{K.SEGMENT}={segment}/part-damaged.parquet", "no parquet file")
    return collection.query().after_or_at(A).before(B).rows().select(*_COLUMNS)


@_add("stream_upsert", f"{EV}{_ALL}")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events, upserted batch by batch."""
    from ..sources.scratch import scratch_folder
    from ..streaming.ingest import upsert_stream

    _, collection = _stored(spark, sf_dir, empty=True)
    frame = events_frame(spark, sf_dir)
    folder = scratch_folder(spark, "stream")
    frame.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    upsert_stream(stream, collection, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return collection.frame().select(*_COLUMNS)


@_add("stored_update", f"{EV}SELECT k_id, k_start, k_end, k_active, user_id, event_type, CASE WHEN {_OVERLAP} THEN -value ELSE value END AS value FROM ev")
def stored_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mass update rewrites the segments with matches only."""
    _, collection = _stored(spark, sf_dir)
    collection.update_matches(collection.query().after_or_at(A).before(B), {"value": -F.col("value")})
    return collection.frame().select(*_COLUMNS)


@_add("compact", f"{EV}{_ALL}")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, collection = _stored(spark, sf_dir)
    collection.optimize()
    return collection.frame().select(*_COLUMNS)


@_add("backup_time_frame", f"{EV}{_ALL} WHERE {_OVERLAP.replace('<', '<=')}")
def backup_time_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup of a time frame, opened as a database."""
    from ..sources.database import open_database
    from ..sources.scratch import scratch_folder

    database, _ = _stored(spark, sf_dir)
    target = scratch_folder(spark, "backup")
    database.backup(target, A, B)
    return open_database(spark, target, read_only=True).get_collection("events").frame().select(*_COLUMNS)


@_add("backup_restored", f"{EV}{_ALL}")
def backup_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full backup, opened as a database."""
    from ..sources.database import open_database
    from ..sources.scratch import scratch_folder

    database, _ = _stored(spark, sf_dir)
    target = scratch_folder(spark, "backup")
    database.backup(target)
    return open_database(spark, target, read_only=True).get_collection("events").frame().select(*_COLUMNS)
