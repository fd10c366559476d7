import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intervalis.functions import hashing, segments
from intervalis.functions import keys as K


def test_grouping_numbers():
    assert K.IntegerKey(-(1 << 31)).group() == 0
    assert {K.LongKey(i).group() for i in (-1, 0, 1)} == {1 << 62}
    assert K.LongKey(-5).group() == (1 << 62) - 2
    assert K.LongTimeKey(-7).group() == -7
    assert hashing.java_string_hash("Hello World") == -862545276
    assert hashing.java_string_hash("polygenelubricants") == -2147483648
    assert hashing.java_uuid_hash(uuid.UUID("123e4567-e89b-12d3-a456-426614174000")) == 1256478162


def test_time_keys_are_equal_by_id_and_start_but_ordered_by_end():
    point, frame, longer, active = K.TimeKey(1, 5), K.TimeFrameKey(1, 5, 9), K.TimeFrameKey(1, 5, 12), K.ActiveTimeKey(1, 5)
    assert point == frame == longer == active and len({point, frame, longer, active}) == 1
    assert point < frame < longer and not frame < point and longer > frame
    assert K.TimeKey(1, 5) != K.TimeKey("1", 5) and K.TimeKey(1, 5) != K.TimeKey(1, 6)
    assert point < None
    with pytest.raises(ValueError):
        K.TimeFrameKey(1, 5, 4)


def test_overlap_of_single_keys():
    assert K.TimeFrameKey(1, 5, 9).overlaps(9, 20) and K.TimeFrameKey(1, 5, 9).overlaps(0, 5) and not K.TimeFrameKey(1, 5, 9).overlaps(10, 20)
    assert K.ActiveTimeKey(1, 5).overlaps(100, 200) and not K.ActiveTimeKey(1, 5).overlaps(0, 4)
    assert K.TimeKey(1, 5).overlaps(5, 5) and K.TimeKey(1, 5).is_after(0, 4) and not K.TimeFrameKey(1, 5, 9).is_after(0, 5)


@given(st.lists(st.text(max_size=8), max_size=8))
def test_string_keys_sort_by_hash_then_utf16(texts):
    keys = sorted(map(K.StringKey, texts))
    assert [k.group() for k in keys] == sorted(k.group() for k in keys)


def test_columns_agree_with_single_keys(spark):
    texts = ["", "a", "Hello World", "polygenelubricants", "Ä€", "\U0001f600x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "id string").select("id", K.group_of(K.StringKey, F.col("id")).alias("g")).collect()
    assert {r.id: r.g for r in rows} == {t: K.StringKey(t).group() for t in texts}
    ids = [uuid.UUID(int=i * 0x1234567890ABCDEF1234567890ABCDEF % (1 << 128)) for i in range(20)]
    frame = spark.createDataFrame([(str(u),) for u in ids], "id string")
    rows = frame.orderBy(*K.id_order(K.UuidKey, F.col("id"))).select("id", K.group_of(K.UuidKey, F.col("id")).alias("g")).collect()
    assert [r.id for r in rows] == [str(k.id) for k in sorted(map(K.UuidKey, ids))]
    assert [r.g for r in rows] == [K.UuidKey(r.id).group() for r in rows]
    rows = spark.createDataFrame([(i,) for i in range(-6, 7)], "id bigint").select("id", K.group_of(K.LongKey, F.col("id")).alias("g")).collect()
    assert all(r.g == K.LongKey(r.id).group() for r in rows)


def test_segments():
    assert segments.floor(-1, 10) == -10 and segments.floor(19, 10) == 10
    assert segments.check_size("LONG_256", K.LongKey) == 128
    with pytest.raises(ValueError):
        segments.check_size("INT_128", K.TimeKey)
    with pytest.raises(ValueError):
        segments.check_size("TIME_7_HOURS", K.TimeKey)
    assert len(segments.Range(3, 2)) == 0 and segments.Range(0, 9).encloses(segments.Range(2, 3)) and segments.Range(0, 3).overlaps(segments.Range(3, 5))
