"""Collections on disk: mutations, versions, indexes, read-only views, backups and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intervalis.errors import DuplicateKeyError, MissingKeyError, NoSuchCollectionError, NoSuchIndexError, StoreError
from intervalis.functions import keys as K
from intervalis.functions.encryption import KeyRing, seal, unseal
from intervalis.sources.backup import unzip, zip_folder
from intervalis.sources.database import open_database
from intervalis.streaming.ingest import completed, upsert_stream

H = 3_600_000
NOW = 1_700_000_000_000
VALUE = T.StructType([T.StructField("name", T.StringType()), T.StructField("cupcakes", T.IntegerType())])


@pytest.fixture
def database(spark, tmp_path):
    return open_database(spark, str(tmp_path / "db"))


def people(database, key_type=K.TimeKey):
    return database.time_collection_builder("people", key_type, VALUE, K.LongKey).with_segment_size("TIME_1_DAY").with_version(2).build()


def names(query):
    return [r.name for r in query.list()]


def value(name, n=0):
    return {"name": name, "cupcakes": n}


def test_equal_keys_of_all_shapes(database):
    collection = people(database)
    shapes = [K.TimeKey(1, NOW), K.TimeFrameKey(1, NOW, NOW + 1), K.TimeFrameKey(1, NOW, NOW + 2), K.ActiveTimeKey(1, NOW)]
    collection.insert(shapes[0], value("x"))
    assert all(collection.get(k).name == "x" and collection.contains(k) for k in shapes)
    for k in shapes:
        with pytest.raises(DuplicateKeyError):
            collection.insert(k, value("y"))
    assert collection.query().count() == 1


@pytest.mark.parametrize("path", ["upsert", "update", "replace"])
def test_transitions_between_active_and_completed(database, path):
    collection = people(database)
    bob = NOW - 7 * H - 20
    collection.batch_upsert([(K.TimeFrameKey(2, NOW - 7 * H, NOW - H), value("Jane")), (K.ActiveTimeKey(3, NOW - 7 * H - 10), value("Charlie")), (K.ActiveTimeKey(1, bob), value("Bob"))])
    shapes = [  # a list, since the keys are equal
        (K.TimeFrameKey(1, bob, NOW - 4 * H), (["Charlie", "Jane"], ["Charlie", "Jane"], ["Charlie"], ["Charlie"], ["Bob", "Jane"])),
        (K.TimeFrameKey(1, bob, NOW - 2 * H), (["Bob", "Charlie", "Jane"], ["Charlie", "Jane"], ["Charlie"], ["Charlie"], ["Bob", "Jane"])),
        (K.ActiveTimeKey(1, bob), (["Bob", "Charlie", "Jane"], ["Bob", "Charlie", "Jane"], ["Bob", "Charlie"], ["Bob", "Charlie"], ["Jane"])),
    ]
    for key, expected in shapes:
        if path == "upsert":
            collection.batch_upsert_keys_and_values({key: value("Bob", 5)})
        elif path == "update":
            collection.update_key_and_value(key, lambda v, key=key: v.update(cupcakes=5) or key)
        else:
            collection.replace_key_and_value(key, lambda v, key=key: (key, v | {"cupcakes": 5}))
        query = collection.query
        assert names(query().after(NOW - 8 * H).before(NOW)) == ["Bob", "Charlie", "Jane"]
        got = (
            names(query().after(NOW - 4 * H).before_or_at(NOW - 4 * H + 1)),
            names(query().after(NOW - 2 * H).before_or_at(NOW - 2 * H + 1)),
            names(query().after(NOW)),
            names(query().after(NOW - 8 * H).key_is_active()),
            names(query().after(NOW - 8 * H).key_is_not_active()),
        )
        assert got == expected
        assert names(query().after(NOW - 8 * H).before(NOW - 8 * H + 10)) == []
        assert collection.get(K.ActiveTimeKey(1, bob)).cupcakes == 5


def test_single_mutations(database):
    collection = people(database)
    a, b = K.TimeFrameKey(1, NOW, NOW + 10), K.TimeKey(2, NOW + 40 * H)
    collection.batch_upsert({a: value("a", 1), b: value("b", 2)})
    collection.update(a, lambda v: v.update(cupcakes=9))
    assert collection.get(a).cupcakes == 9
    collection.replace(b, lambda v: value("c", v["cupcakes"] + 1))
    assert collection.get(b) == collection.last_value() and collection.get(b).name == "c"
    assert collection.last_key() == b
    collection.replace(b, lambda v: None)
    assert not collection.contains(b)
    for change in (collection.update, collection.replace):
        with pytest.raises(MissingKeyError):
            change(b, lambda v: v)
    with pytest.raises(StoreError):
        collection.update_key_and_value(a, lambda v: K.TimeKey(1, NOW + 1))
    with pytest.raises(ZeroDivisionError):
        collection.update(a, lambda v: 1 / 0)
    assert collection.get(a).cupcakes == 9
    collection.delete(b)
    collection.delete(a)
    assert collection.query().count() == 0 and collection.last_key() is None and collection.last_value() is None


def test_plain_upsert_keeps_the_stored_activity_of_equal_ends(database):
    collection = people(database)
    collection.insert(K.ActiveTimeKey(1, NOW), value("a"))
    collection.batch_upsert({K.TimeKey(1, NOW): value("b")})
    assert names(collection.query().key_is_active()) == ["b"]
    collection.batch_upsert({K.TimeFrameKey(1, NOW, NOW + 5): value("c")})
    assert names(collection.query().key_is_active()) == [] and names(collection.query().after_or_at(NOW + 5)) == ["c"]


def test_batches_and_mass_changes(database, spark):
    collection = people(database)
    rows = spark.range(200).select(
        F.col("id").alias(K.ID), (F.lit(NOW) - F.col("id") * H).alias(K.START), (F.lit(NOW) - F.col("id") * H + H).alias(K.END), F.lit(False).alias(K.ACTIVE), F.col("id").cast("string").alias("name"), F.col("id").cast("int").alias("cupcakes")
    )
    collection.batch_upsert(rows)
    collection.batch_upsert({})
    assert collection.query().count() == 200
    with pytest.raises(DuplicateKeyError):
        collection.insert_all(rows.limit(1).union(rows.limit(1).withColumn(K.ID, F.lit(999))))
    index = collection.create_index("n", K.IntegerKey, "cupcakes")
    at = lambda n: names(collection.query().where(index.integer_condition().is_equal_to(n)))
    assert at(7) == ["7"]
    before = collection.table.manifest()[1]["segments"]
    recent = collection.query().after(NOW - 10 * H).by_start_time()
    collection.update_matches(recent, {"cupcakes": F.col("cupcakes") + 1000})
    after = collection.table.manifest()[1]["segments"]
    assert at(7) == [] and at(1007) == ["7"] and at(150) == ["150"]
    assert sum(before[s] != after[s] for s in before) <= 2 < len(before)
    collection.replace_matches(collection.query().where(F.col("cupcakes") == 150), {"name": F.lit("new")})
    assert collection.get(K.TimeKey(150, NOW - 150 * H)).asDict() == {"name": "new", "cupcakes": None}
    collection.update_matches(collection.query().where(F.col("cupcakes") == 20), {K.END: F.lit(None), K.ACTIVE: F.lit(True)})
    assert names(collection.query().key_is_active()) == ["20"]
    collection.delete_matches(collection.query().where(F.col("cupcakes") < 100))
    assert collection.query().count() == 200 - 90 and collection.query().where(F.col("cupcakes").isNull()).count() == 1
    with pytest.raises(StoreError):
        collection.update_matches(collection.query(), {K.START: F.lit(0)})
    rows_before = sorted(map(tuple, collection.frame().collect()), key=str)
    collection.optimize()
    assert sorted(map(tuple, collection.frame().collect()), key=str) == rows_before


def test_negative_times_and_long_frames(database):
    collection = people(database)
    collection.batch_upsert({K.TimeFrameKey(1, -50 * H, 100 * H): value("long"), K.TimeKey(2, -1): value("just before"), K.TimeKey(3, 0): value("zero")})
    assert names(collection.query().after_or_at(90 * H)) == ["long"]
    assert names(collection.query().before(0)) == ["long", "just before"]
    assert names(collection.query().after_or_at(-1).before(1).by_start_time()) == ["just before", "zero"]


def test_key_types(database):
    frames = people(database, K.TimeFrameKey)
    with pytest.raises(StoreError):
        frames.insert(K.TimeKey(1, NOW), value("a"))
    with pytest.raises(StoreError):
        frames.batch_upsert({K.TimeFrameKey(1, NOW, NOW): value("a"), K.ActiveTimeKey(2, NOW): value("b")})
    assert frames.query().count() == 0
    texts = database.collection_builder("texts", K.StringKey, VALUE).build()
    texts.batch_upsert({K.StringKey(t): value(t) for t in ["b", "a", "polygenelubricants", "\U0001f600"]})
    assert names(texts.query()) == [k.id for k in sorted(map(K.StringKey, ["b", "a", "polygenelubricants", "\U0001f600"]))]
    assert texts.get(K.StringKey("\U0001f600")).name == "\U0001f600"
    with pytest.raises(StoreError):
        database.collection_builder("texts", K.LongKey, VALUE).build()
    with pytest.raises(StoreError):
        database.collection_builder("texts", K.StringKey, T.StructType()).build()
    with pytest.raises(ValueError):
        database.collection_builder("other", K.LongKey, VALUE).with_segment_size("TIME_1_DAY")
    with pytest.raises(StoreError):
        texts.insert(K.StringKey("x"), {"unknown": 1})


def test_version_one_ignores_the_active_filter(database):
    collection = database.time_collection_builder("one", K.TimeKey, VALUE, K.LongKey).build()
    collection.batch_upsert({K.ActiveTimeKey(1, NOW): value("a"), K.TimeKey(2, NOW): value("b")})
    assert names(collection.query().key_is_active()) == ["a", "b"]


def test_indexes(database):
    collection = people(database)
    collection.batch_upsert({K.TimeKey(i, NOW + i): value(f"{i}", i) for i in range(6)})
    collection.create_indices([("n", K.IntegerKey, "cupcakes"), ("two", K.IntegerKey, "array(cupcakes, cupcakes + 2)", True)])
    two = collection.get_index("two", K.IntegerKey)
    assert names(collection.query().where(two.integer_condition().is_equal_to(3))) == ["1", "3"]
    got = [(r.index_key, r[K.ID]) for r in collection.matching_keys(two.integer_condition().is_in_range(3, 4)).collect()]
    assert got == [(3, 1), (3, 3), (4, 2), (4, 4)]
    assert collection.last_index_key("two", K.IntegerKey) == 7
    with pytest.raises(StoreError):
        collection.create_index("n", K.LongKey, "cupcakes")
    with pytest.raises(StoreError):
        collection.create_indices([("bad", K.LongKey, "no_such_column"), ("good", K.StringKey, "name")])
    assert collection.get_index("good", K.StringKey).key_type is K.StringKey
    with pytest.raises(NoSuchIndexError):
        collection.get_index("none", K.LongKey)
    assert names(collection.query().where(collection.index_condition("none", K.LongKey).is_equal_to(1))) == []


def test_read_only_views(database, spark):
    reader = open_database(spark, database.root, read_only=True)
    later = reader.get_time_collection("people", VALUE)
    assert later.query().list() == [] and later.get(K.TimeKey(1, 1)) is None and later.last_key() is None
    people(database).insert(K.TimeKey(1, 1), value("here"))
    assert names(later.query()) == ["here"] and not hasattr(later, "insert")
    with pytest.raises(StoreError):
        reader.collection_builder("x", K.LongKey, VALUE)
    assert database.get_collection("missing") is None
    with pytest.raises(NoSuchCollectionError):
        database.require("missing")
    with pytest.raises(StoreError):
        database.get_collection("people", K.LongKey)
    database.shutdown()
    assert database.await_termination()
    with pytest.raises(StoreError):
        people(database)


def test_versions_and_recovery(database):
    collection = people(database)
    for i in range(4):
        collection.insert(K.TimeKey(i, NOW), value(str(i)))
    table = collection.table
    assert table.rows(1).count() == 1 and table.rows().count() == 4
    table.rows().write.parquet(f"{table.path}/data/w=orphan")
    assert table.recover() == [] and table.recover(grace=0) == ["orphan"] and table.rows().count() == 4
    table.clean(keep=1)
    assert table.versions() == [4] and collection.query().count() == 4
    version, manifest = table.manifest()
    table.files.write_new(f"versions/{version + 1:08d}.json", '{"segments": {}}')
    assert not table.files.write_new(f"versions/{version + 1:08d}.json", "{}")


def test_backups(database, spark, tmp_path):
    collection = people(database)
    collection.batch_upsert({K.TimeFrameKey(i, NOW + i * H, NOW + i * H + 10): value(str(i)) for i in range(6)})
    collection.create_index("n", K.IntegerKey, "cupcakes")
    database.collection_builder("plain", K.LongKey, VALUE).build().insert(K.LongKey(1), value("p"))
    database.backup(str(tmp_path / "all"))
    copy = open_database(spark, str(tmp_path / "all"), read_only=True)
    assert sorted(map(tuple, copy.get_collection("people").frame().collect())) == sorted(map(tuple, collection.frame().collect()))
    assert copy.get_collection("people").get_index("n", K.IntegerKey).sql == "cupcakes"
    database.backup(str(tmp_path / "some"), NOW + H, NOW + 3 * H)
    archive = zip_folder(str(tmp_path / "some"), str(tmp_path / "some-zip"))
    unzip(archive, str(tmp_path / "back"))
    sliced = open_database(spark, str(tmp_path / "back"), read_only=True)
    assert names(sliced.get_collection("people").query()) == ["1", "2", "3"] and names(sliced.get_collection("plain").query()) == ["p"]


def test_encryption(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, None, 3)], "k_id int, name string, cupcakes int")
    old, new = KeyRing({"one": b"0" * 16}, "one"), KeyRing({"one": b"0" * 16, "two": b"1" * 32}, "two")
    mixed = seal(rows, old, ["name", "cupcakes"]).union(seal(rows, new, ["name", "cupcakes"])).union(seal(rows, KeyRing({}, None), ["name", "cupcakes"]))
    assert mixed.where("payload_key = 'two'").first().payload != b'{"name":"a","cupcakes":2}'
    assert sorted(map(tuple, unseal(mixed, new, "name string, cupcakes int").collect()), key=str) == sorted(map(tuple, rows.union(rows).union(rows).collect()), key=str)
    for bad in ({" ": b"0" * 16}, {"x" * 21: b"0" * 16}):
        with pytest.raises(ValueError):
            KeyRing(bad, None)


def test_stream_into_a_collection(database, spark, tmp_path):
    collection = people(database)
    source = str(tmp_path / "in")
    schema = f"{K.ID} bigint, {K.START} bigint, {K.END} bigint, {K.ACTIVE} boolean, name string, cupcakes int, seq int"
    spark.createDataFrame([(1, NOW, None, True, "a", 1, 1), (1, NOW, NOW + 5, False, "b", 2, 2), (2, NOW - H, None, True, "late", 0, 3)], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = upsert_stream(stream, collection, str(tmp_path / "check"), order="seq").trigger(availableNow=True).start()
    query.awaitTermination()
    assert names(collection.query()) == ["late", "b"] and names(collection.query().key_is_active()) == ["late"]


def test_completed_pairs(spark):
    events = spark.createDataFrame([(1, 10, "on"), (1, 20, "off"), (1, 30, "on"), (2, 5, "on")], f"{K.ID} int, time bigint, kind string")
    rows = completed(events, "off").select(K.ID, K.START, K.END, K.ACTIVE).orderBy(K.ID, K.START).collect()
    assert [tuple(r) for r in rows] == [(1, 10, 20, False), (1, 30, None, True), (2, 5, None, True)]


def test_time_bounds_prune_segments_with_active_rows_apart(database):
    """A lower bound reads active rows of earlier segments, completed ones only where a frame reaches it."""
    collection = people(database)
    day = 24 * H
    start = NOW - NOW % day
    rows = {K.TimeFrameKey(i, start + i * day, start + i * day + H): value(f"d{i}") for i in range(20)}
    rows[K.ActiveTimeKey(100, start + 2 * day)] = value("active")
    rows[K.TimeFrameKey(101, start + 3 * day, start + 15 * day)] = value("long")
    collection.batch_upsert(rows)
    query = collection.query().after_or_at(start + 14 * day + 2 * H).before(start + 16 * day)
    assert names(query) == ["active", "long", "d15"]
    files = sorted({f.split("/data/")[1].rsplit("/", 1)[0].split("/", 1)[1] for f in query.rows().inputFiles()})
    flat = lambda i, active: f"{K.ACTIVE}={active}/{K.SEGMENT}={start + i * day}"
    assert set(files) <= {flat(2, "true"), flat(3, "false"), flat(14, "false"), flat(15, "false")} and flat(15, "false") in files
    listed = collection.table.overlapping(query.low, query.high)._jdf.queryExecution().toString().count("w=")
    assert listed < 30
    database.spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    filters = query.rows()._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    database.spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"{K.SEGMENT}" in filters and "<=" in filters and ">=" in filters and K.ACTIVE in filters
    assert names(collection.query().after_or_at(start + 18 * day + 2 * H).key_is_not_active()) == ["d19"]
    assert names(collection.query().before(start)) == [] and len(collection.query().before(start).rows().inputFiles()) == 0


def test_insert_all_refuses_repeated_keys_and_wrong_rows(database, spark):
    collection = people(database)
    schema = f"{K.ID} bigint, {K.START} bigint, {K.END} bigint, {K.ACTIVE} boolean, name string, cupcakes int"
    twice = spark.createDataFrame([(100, 5, 5, False, "a", 1), (100, 5, 6, False, "b", 2)], schema)
    with pytest.raises(DuplicateKeyError):
        collection.insert_all(twice)
    with pytest.raises(StoreError):
        collection.insert_all(twice.limit(1).withColumn("cupcakes", F.lit("x")))
    with pytest.raises(StoreError):
        collection.insert_all(twice.limit(1).drop("name"))
    with pytest.raises(StoreError):
        collection.insert_all(twice.limit(1).withColumn(K.ID, F.lit(None).cast("bigint")))
    assert collection.query().count() == 0 and not collection.table.files.names("staging")
    collection.batch_upsert(twice.withColumn("seq", F.col("cupcakes")), order="seq")
    assert names(collection.query()) == ["b"]


def test_a_change_evaluates_its_rows_once(database, spark):
    collection = people(database)
    noisy = spark.range(50).select(F.col("id").alias(K.ID), (F.rand() * 1e12).cast("bigint").alias(K.START)).select(
        K.ID, K.START, F.col(K.START).alias(K.END), F.lit(False).alias(K.ACTIVE), F.lit("n").alias("name"), F.lit(1).alias("cupcakes")
    )
    collection.batch_upsert(noisy)
    assert collection.query().count() == 50 and all(r[K.START] - r[K.START] % (24 * H) == r[K.SEGMENT] for r in collection.frame().collect())


def test_two_sessions(database, spark):
    """A second session neither removes a write that is under way nor overwrites a version."""
    collection = people(database)
    collection.insert(K.TimeKey(1, NOW), value("a"))
    table = collection.table
    version, _ = table.manifest()
    table.rows().write.parquet(f"{table.path}/data/w=underway")
    other = open_database(spark, database.root)
    people(other).insert(K.TimeKey(2, NOW), value("b"))
    assert "w=underway" in table.files.names("data")
    assert not table.files.write_new(f"versions/{version + 1:08d}.json", "{}") and names(collection.query()) == ["a", "b"]


def test_versions_are_dropped_by_later_commits(database):
    table = people(database).table
    collection = people(database)
    for i in range(5):
        collection.insert(K.TimeKey(i, NOW), value(str(i)))
    table.commit(table.rows(), [int(s) for s in table.manifest()[1]["segments"]], keep=2)
    assert table.versions() == [5, 6] and len(table.files.names("data")) == 2 and collection.query().count() == 5


def test_mass_changes_by_functions(database):
    collection = people(database)
    collection.batch_upsert({K.TimeFrameKey(i, NOW + i * H, NOW + i * H + 5): value(f"p{i}", i) for i in range(30)} | {K.ActiveTimeKey(99, NOW): value("active", 50)})
    collection.update_each(collection.query().where(F.col("cupcakes") < 5), lambda v: v.update(cupcakes=v["cupcakes"] + 100))
    assert collection.get(K.TimeKey(3, NOW + 3 * H)).cupcakes == 103
    collection.replace_each(collection.query().where(F.col("cupcakes") >= 100), lambda v: None if v["cupcakes"] == 104 else {"name": "r"})
    assert collection.query().where(F.col("name") == "r").count() == 4 and not collection.contains(K.TimeKey(4, NOW + 4 * H))
    collection.update_each_key_and_value(collection.query().key_is_active(), lambda key, v: v.update(name="done") or K.TimeFrameKey(key.id, key.start, NOW + H))
    assert names(collection.query().key_is_active()) == [] and collection.get(K.TimeKey(99, NOW)).name == "done"
    collection.replace_each_key_and_value(collection.query().where(F.col("name") == "p7"), lambda key, v: (K.ActiveTimeKey(key.id, key.start), v | {"cupcakes": None}))
    assert names(collection.query().key_is_active()) == ["p7"] and collection.get(K.TimeKey(7, NOW + 7 * H)).cupcakes is None
    with pytest.raises(Exception, match="new key"):
        collection.update_each_key_and_value(collection.query(), lambda key, v: K.TimeKey(12345, key.start))
    texts = database.collection_builder("texts", K.StringKey, VALUE).build()
    texts.batch_upsert({K.StringKey("a"): value("x", 1), K.StringKey("b"): value("y", 2)})
    texts.replace_each_key_and_value(texts.query(), lambda key, v: (key, v | {"name": key.id * 2}))
    assert sorted(names(texts.query())) == ["aa", "bb"]


def test_encrypted_collection(spark, tmp_path):
    ring = KeyRing({"one": b"0" * 16}, "one")
    database = open_database(spark, str(tmp_path / "db"), ring=ring)
    collection = database.time_collection_builder("people", K.TimeKey, VALUE, K.LongKey).with_encryption().build()
    collection.batch_upsert({K.TimeKey(1, NOW): value("secret", 3), K.TimeKey(2, NOW): {}})
    collection.update(K.TimeKey(1, NOW), lambda v: v.update(cupcakes=4))
    raw = spark.read.parquet(f"{collection.table.path}/data")
    assert "name" not in raw.columns and all(b"secret" not in bytes(r.payload) for r in raw.collect())
    assert sorted(map(tuple, collection.query().values().collect()), key=str) == [("secret", 4), (None, None)]
    newer = open_database(spark, database.root, ring=KeyRing({"one": b"0" * 16, "two": b"1" * 32}, "two"))
    newer.get_collection("people").insert(K.TimeKey(3, NOW + 1), value("later"))
    assert newer.get_collection("people").query().count() == 3
    newer.backup(str(tmp_path / "copy"))
    assert open_database(spark, str(tmp_path / "copy"), read_only=True, ring=newer.ring).get_collection("people").query().count() == 3
    with pytest.raises(StoreError):
        open_database(spark, database.root).get_collection("people").frame()
    with pytest.raises(ValueError):
        open_database(spark, database.root).collection_builder("x", K.LongKey, VALUE).with_encryption()


def test_damaged_files_are_skipped_on_demand(database, spark):
    collection = people(database)
    collection.batch_upsert({K.TimeKey(i, NOW): value(str(i)) for i in range(3)})
    segment, (write, _, _) = next(iter(collection.table.manifest()[1]["segments"].items()))
    collection.table.files.write_new(f"data/w={write}/{K.ACTIVE}=false/{K.SEGMENT}={segment}/part-bad.parquet", "damaged")
    with pytest.raises(Exception, match="part-bad"):
        collection.query().list()
    assert sorted(names(open_database(spark, database.root, skip_corrupt=True).get_collection("people").query())) == ["0", "1", "2"]


def test_configuration_is_polled(database, spark, monkeypatch):
    from intervalis.sources import database as d

    asked = []
    settings = d.Configuration(lambda: asked.append(1) or ({"validate": False} if len(asked) == 1 else 1 / 0))
    assert settings.get("validate", True) is False and settings.get("other", 5) == 5 and len(asked) == 1
    monkeypatch.setattr(d.Configuration, "POLL", 0.0)
    assert settings.get("validate", True) is False and len(asked) == 2  # a failing source keeps the last settings
    loose = open_database(spark, database.root, configuration=lambda: {"validate": False})
    collection = people(loose)
    schema = f"{K.ID} bigint, {K.START} bigint, {K.END} bigint, {K.ACTIVE} boolean, name string, cupcakes string"
    collection.insert_all(spark.createDataFrame([(1, 5, 5, False, "a", "7")], schema))
    assert collection.get(K.TimeKey(1, 5)).cupcakes == 7


def test_rows_with_nulls_in_their_keys(database, spark):
    """A null k_active counts as false; a null id or start is refused, with or without validation."""
    collection = people(database)
    schema = f"{K.ID} bigint, {K.START} bigint, {K.END} bigint, {K.ACTIVE} boolean, name string, cupcakes int"
    collection.insert_all(spark.createDataFrame([(1, 5, 5, None, "a", 1)], schema))
    assert names(collection.query()) == ["a"] and names(collection.query().key_is_active()) == []
    loose = open_database(spark, database.root, configuration=lambda: {"validate": False}).get_collection("people")
    with pytest.raises(Exception, match="a key has a null"):
        loose.insert_all(spark.createDataFrame([(2, None, 5, False, "b", 1)], schema))
    assert names(collection.query()) == ["a"]


def test_scratch_folders_are_shared(spark, monkeypatch):
    from intervalis.sources import scratch

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        scratch.scratch_folder(Cluster, "x")
