"""Interval queries over six frames, active and completed keys, key sets and index conditions."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from intervalis.errors import CursorClosedError, UnsupportedConditionError
from intervalis.functions import keys as K
from intervalis.operators.cursor import Cursor
from intervalis.plans import catalogue
from intervalis.plans.conditions import Index, NoMatch
from intervalis.plans.query import Query

H = 3_600_000
NOW = 1_700_000_000_000
FRAMES = [(-8 * H, -6 * H), (-8 * H, -5 * H), (-8 * H + 10, -4 * H), (-7 * H, 0), (-4 * H, -4 * H + 10), (-3 * H, -H + 10)]
SCHEMA = f"{K.ID} bigint, {K.START} bigint, {K.END} bigint, {K.ACTIVE} boolean, name string, cupcakes int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def six(spark):
    rows = [(i, NOW + a, NOW + b, False, str(i), i) for i, (a, b) in enumerate(FRAMES)]
    return Query(frame(spark, rows), K.TimeKey, K.LongKey, "six")


def found(query):
    return [r.cupcakes for r in query.list()]


def key(i):
    return K.TimeFrameKey(i, NOW + FRAMES[i][0], NOW + FRAMES[i][1])


@pytest.mark.parametrize(
    ("build", "expected"),
    [
        (lambda q: q, [0, 1, 2, 3, 4, 5]),
        (lambda q: q.after(NOW - 8 * H - 10).before(NOW + 10), [0, 1, 2, 3, 4, 5]),
        (lambda q: q.after(NOW - 7 * H).before(NOW - 4 * H), [0, 1, 2, 3]),
        (lambda q: q.after(NOW - 5 * H).before(NOW - 3 * H), [2, 3, 4]),
        (lambda q: q.after(NOW - 5 * H).before(NOW - 2 * H), [2, 3, 4, 5]),
        (lambda q: q.after(NOW - 5 * H).before(NOW - 2 * H).by_start_time(), [4, 5]),
        (lambda q: q.where_key_in([key(2), key(3)]).after_or_at(NOW - 7 * H).before(NOW), [2, 3]),
        (lambda q: q.where_key_in([key(2), key(3)]).after_or_at(NOW - 3 * H).before(NOW), [3]),
        (lambda q: q.where_key_in([]), []),
        (lambda q: q.where(None).where(F.col("cupcakes") > 3), [4, 5]),
        (lambda q: q.where(lambda v: v.cupcakes % 2 == 0), [0, 2, 4]),
    ],
)
def test_six_frames(six, build, expected):
    assert found(build(six)) == expected


def test_start_and_end_indexes(spark, six):
    start = Index("start", K.LongKey, K.START, False, "six")
    end = Index("end", K.LongKey, K.END, False, "six")
    both = lambda a, b: six.where(end.long_condition().is_at_least(NOW + a)).where(start.long_condition().is_less_than(NOW + b))
    assert found(both(-8 * H, -7 * H)) == [0, 1, 2]
    assert found(both(-4 * H, -3 * H)) == [2, 3, 4]
    assert found(both(-1 * H, 0)) == [3, 5]


def test_count_first_last_and_large_key_sets(spark, six):
    assert six.count() == 6 and six.first().cupcakes == 0 and six.before(0).first() is None
    assert six.last_frame().first().cupcakes == 5
    many = [key(1)] + [K.TimeKey(i, 5) for i in range(300)]
    assert found(six.where_key_in(many)) == [1]
    assert found(six.where_key_in(many).where_key_in([key(2)])) == []


def test_active_keys(spark):
    rows = [(0, NOW - 8 * H + 10, NOW - 4 * H, False, "a", 0), (1, NOW - 7 * H, NOW, False, "b", 1), (2, NOW - 3 * H, None, True, "c", 2)]
    query = Query(frame(spark, rows), K.TimeKey, K.LongKey, "active").after_or_at(NOW - 5 * H).before_or_at(NOW)
    assert found(query) == [0, 1, 2]
    assert found(query.key_is_active()) == [2] and found(query.key_is_not_active()) == [0, 1]
    with pytest.raises(RuntimeError):
        query.key_is_active().key_is_not_active()
    with pytest.raises(TypeError):
        Query(frame(spark, rows), K.LongKey, K.LongKey).before(3)


def test_tiny_frames_and_extreme_bounds(spark):
    query = Query(frame(spark, [(1, 1, 2, False, "Joe", 1), (2, 2, 3, False, "Bob", 2)]), K.TimeKey, K.LongKey)
    names = lambda q: [r.name for r in q.list()]
    assert [names(query.before(t)) for t in (3, 2, 1)] == [["Joe", "Bob"], ["Joe"], []]
    closed = lambda a, b: names(query.by_start_time().after_or_at(a).before_or_at(b))
    assert [closed(0, 0), closed(1, 2), closed(2, 3), closed(3, 4)] == [[], ["Joe", "Bob"], ["Bob"], []]
    assert names(query.before(K.LONG_MIN)) == [] and names(query.after(K.LONG_MAX)) == []


def test_plan_prunes_partitions_and_pushes_filters(spark, tmp_path):
    from intervalis.functions import segments

    rows = frame(spark, [(i, i * H, i * H + 10, False, str(i), i) for i in range(100)])
    rows.withColumn(K.SEGMENT, segments.segment_of(F.col(K.START), 24 * H)).write.partitionBy(K.SEGMENT).parquet(str(tmp_path / "t"))
    query = Query(spark.read.parquet(str(tmp_path / "t")), K.TimeKey, K.LongKey, "t", 24 * H, 10)
    bounded = query.after_or_at(30 * H).before(60 * H)
    plan = bounded.rows()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k_start), LessThanOrEqual(k_start" in plan
    assert f"{K.SEGMENT}#" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert found(bounded) == list(range(30, 60))


def test_multi_valued_conditions(spark):
    rows = spark.createDataFrame([(1, [2, 9]), (2, [4, None, 4]), (3, None), (4, [])], f"{K.ID} bigint, a array<int>")
    index = Index("a", K.IntegerKey, "a", True, "m")
    query = Query(rows, K.LongKey, K.LongKey, "m")
    ids = lambda q: sorted(r[K.ID] for r in q.rows().collect())
    condition = index.integer_condition
    assert ids(query.where(condition().is_greater_than(5).is_less_than(3))) == []
    assert ids(query.where(condition().is_greater_than(5)).where(condition().is_less_than(3))) == [1]
    assert ids(query.where(condition().is_in_range(4, 4))) == [2]
    assert ids(query.where(NoMatch(index))) == []


def test_condition_rules(spark, six):
    index = Index("n", K.IntegerKey, "cupcakes", False, "six")
    condition = index.integer_condition()
    for call in (condition.is_equal_to, condition.is_in, condition.meets):
        with pytest.raises(ValueError):
            call(None)
    with pytest.raises(RuntimeError):
        condition.is_equal_to(1).is_in({1})
    with pytest.raises(RuntimeError):
        condition.is_equal_to(1).meets(lambda v: v > 0)
    with pytest.raises(UnsupportedConditionError):
        index.long_condition()
    with pytest.raises(ValueError):
        six.where(Index("n", K.IntegerKey, "cupcakes", False, "other").integer_condition())
    assert not hasattr(Index("s", K.StringKey, "name", False, "six").string_condition(), "is_in_range")
    assert found(six.where(condition.is_equal_to(1).is_equal_to(2))) == [2]
    some = uuid.UUID(int=5)
    as_uuid = Index("u", K.UuidKey, f"if(cupcakes = 3, '{some}', null)", False, "six")
    assert found(six.where(as_uuid.uuid_condition().is_equal_to(some))) == [3] == found(six.where(as_uuid.uuid_condition().is_in([some])))


def test_cursor(six):
    with six.iterator() as cursor:
        assert cursor.peek().cupcakes == 0 and cursor.next().cupcakes == 0 and cursor.has_next()
        assert cursor.count_remainder_and_close() == 5
        with pytest.raises(CursorClosedError):
            cursor.has_next()
    now = [0.0]
    cursor = Cursor(six.values(), 10, lambda: now[0])
    now[0] = 9
    cursor.keep_alive()
    now[0] = 18
    assert len(list(cursor)) == 6
    now[0] = 40
    with pytest.raises(CursorClosedError):
        cursor.peek()
    idle = Cursor(six.values(), 0.2)
    assert idle.next().cupcakes == 0 and not idle._closed
    time.sleep(1)
    assert idle._closed and idle._rows is None  # the timer has freed it, without a call
    with pytest.raises(CursorClosedError):
        six.iterator(0).has_next()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables are not here")
@pytest.mark.parametrize(("name", "table", "key"), [("int_key", "nation", "n_nationkey"), ("long_key", "orders", "o_orderkey"), ("string_hash", "customer", "c_name")])
def test_key_order_of_all_rows(spark, name, table, key):
    stored = sorted(r[0] for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(key).collect())
    out = sorted(catalogue.QUERIES[f"rank_{name}"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.k_rank)
    assert [r.k_rank for r in out] == list(range(1, len(stored) + 1)) and sorted(r[key] for r in out) == stored
    assert out == sorted(out, key=lambda r: (r.k_group, r[key]))
    kind = {"int_key": K.IntegerKey, "long_key": K.LongKey, "string_hash": K.StringKey}[name]
    ordered = catalogue._keyed(spark, "/root/testdata/sf0.001", table, key, kind).ordered().collect()
    assert [r[key] for r in ordered] == [r[key] for r in out]


def test_ranks_of_no_rows(spark):
    assert Query(spark.createDataFrame([], "k_id bigint"), K.LongKey, K.LongKey).ranked().collect() == []
