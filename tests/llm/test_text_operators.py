"""Packing, the n-gram join, suffix dedup and quality rules against brute force, with awkward inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalis.llm import ngram_join, packing, quality_rules, suffix_dedup
from intervalis.llm.queries import word_tokenizer

from .helpers import components, cut_repeats, places, quality, shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_bytes string, bucket int, blob string, k1 string, shard int, n int, label string"


def frame(spark, pairs):
    rows = [(i, t, None, "s", len(t) if t is not None else None, "clash", "clash", 1, "clash", "clash", 2, 3, "clash") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def invented(seed, words):
    r = random.Random(seed)
    return [r.choice("the of and to in".split()) if r.random() < 0.3 else "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(words)]


@pytest.fixture(scope="module")
def docs():
    """Texts with exact copies, near copies, shared passages, repeated lines, and awkward ones."""
    r, out = random.Random(5), []
    passage = " ".join(invented(1, 80))
    for i in range(60):
        out.append(" ".join(invented(100 + i, r.randint(20, 200))))
    for i in range(0, 30, 3):
        base = out[i].split()
        out += [out[i], " ".join(base[:-2] + ["changed"]), " ".join(w if r.random() > 0.01 else "x" + w for w in base)]
        out.append(" ".join(base[: len(base) // 2]) + " " + passage + "\n" + passage)
    for i in range(12):  # a chain: each is near its neighbours, not near the ends
        base = invented(7, 100)
        out.append(" ".join(invented(900, 100)[: 3 * i] + base[3 * i :]))
    out += [None, "", " \n\t ", "one", "one", "One two THREE four", "one two three four", "É é", "a" * 900, "ab" * 300, "Shti " * 300, "# * $ % & | < >", "x\x1cy z", "line\nline\n\nline"]
    out.append(" ".join(invented(77, 6000)))
    out.append("é" * 350 + "tail")
    out.append("è" + "é" * 349 + "tail")
    return list(enumerate(out))


def test_join_against_brute_force(spark, docs):
    component, sizes = components(docs)
    rows = ngram_join.link(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (sizes[i], component[i]) for i, _ in docs}


def test_join_with_every_shingle_frequent(spark, docs, monkeypatch):
    """Pairs of frequent shingles alone find the same links."""
    monkeypatch.setattr(ngram_join, "LOCAL_COUNT", 1)
    monkeypatch.setattr(ngram_join, "FREQUENT", 1)
    component, _ = components(docs)
    assert {r.doc_id: r.component_id for r in ngram_join.link(frame(spark, docs)).collect()} == component


def test_join_of_odd_tables(spark):
    assert ngram_join.link(frame(spark, [])).collect() == []
    same = "a b c d e f g h"
    rows = ngram_join.link(frame(spark, [(4, same), (4, same), (None, same), (None, None), (9, None), (7, same.upper())])).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [(4, 4, 4), (4, 4, 4), (None, 4, 4), (None, 0, None), (9, 0, 9), (7, 4, 4)]))


def test_join_through_a_null_id(spark):
    """A near copy without an id links two documents that are not near each other."""
    base = invented(21, 100)
    texts = [" ".join(invented(22, 100)[:n] + base[n:]) for n in (0, 8, 16)]
    assert set(components(list(enumerate(texts)))[0].values()) == {0} and set(components([(0, texts[0]), (2, texts[2])])[0].values()) == {0, 2}
    rows = ngram_join.link(frame(spark, [(5, texts[0]), (None, texts[1]), (8, texts[2]), (None, " ".join(invented(23, 60)))])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 5), (5, 5), (8, 5)]


def test_join_with_colliding_fingerprints(spark, docs, monkeypatch):
    """Different sets may have one 64-bit fingerprint: with fingerprints of 3 bits the result is the same."""
    whole = ngram_join.set_key
    monkeypatch.setattr(ngram_join, "set_key", lambda own: (whole(own)[0] & 7, whole(own)[1]))
    component, sizes = components(docs)
    rows = ngram_join.link(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (sizes[i], component[i]) for i, _ in docs}


@pytest.mark.parametrize("part", [3, 40])
def test_join_of_lists_in_parts(spark, docs, monkeypatch, part):
    """Long lists are dealt into parts, whose leaders meet again; no link is lost."""
    monkeypatch.setattr(ngram_join, "LIST_PART", part)
    base, r = invented(31, 90), random.Random(9)
    near = [(1000 + i, " ".join("w%d" % i if r.random() < 0.008 else w for w in base)) for i in range(150)]
    component, _ = components(docs + near)
    rows = ngram_join.link(frame(spark, docs + near)).collect()
    assert {r.doc_id: r.component_id for r in rows} == component and len({component[i] for i, _ in near}) < 30


def test_components_over_many_tasks(spark, monkeypatch):
    from intervalis.llm import components as c

    r = random.Random(6)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    expected = c.union(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    for limit in (1_000_000, 20):
        monkeypatch.setattr(c, "LOCAL_EDGES", limit)
        got = {r.node: r.label for r in c.connected(df, "a", "b").collect()}
        assert {k: v for k, v in expected.items() if got.get(k, k) != v} == {} and set(got) <= set(expected)
    assert c.connected(df.limit(0), "a", "b").collect() == []


def test_signatures_meet(docs):
    """Any two sets that are similar enough share a signature, whichever shingles count as frequent."""
    r = random.Random(3)
    texts = [t for _, t in docs if shingles(t)]
    sets = ngram_join.shingle_sets(texts)
    tokens = np.unique(np.concatenate(sets))
    for share in (0.0, 0.3, 1.0):
        frequent = np.sort(np.array(r.sample(tokens.tolist(), int(share * len(tokens))), dtype=np.uint64))
        rank = np.array(r.sample(range(len(frequent)), len(frequent)), dtype=np.int32)
        own = [set(ngram_join.signatures(s, frequent, rank).tolist()) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    assert own[i] & own[j] or both == len(sets[i]) == len(sets[j])  # equal sets are one class anyway
                    assert ngram_join._fits(len(sets[i]), len(sets[j]), ngram_join.bits_apart(ngram_join.bitmap(sets[i]), ngram_join.bitmap(sets[j])))


def test_repeats_against_brute_force(spark, docs):
    expected = cut_repeats([t for _, t in docs])
    rows = {r.doc_id: r for r in suffix_dedup.remove(frame(spark, docs)).collect()}
    for (i, text), (size, gone, runs, left, sha) in zip(docs, expected, strict=True):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, gone, runs, sha), i
        assert r.text == (text if not gone else left.decode("utf-8", "ignore")) and r.kept == "clash" and r.source == "s"


@pytest.mark.parametrize(("name", "value"), [("HOT", 2), ("TOGETHER", 3), ("PIECE", 450), ("FILTER_BITS", (1 << 10, 1 << 12)), ("FLUSH_BYTES", 2000), ("REMEMBERED", 2)])
def test_repeats_do_not_depend_on_limits(spark, docs, monkeypatch, name, value):
    monkeypatch.setattr(suffix_dedup, name, value)
    some = docs[::2] + docs[61:100:2]
    some = list(dict(some).items())
    expected = cut_repeats([t for _, t in some])
    rows = {r.doc_id: r for r in suffix_dedup.remove(frame(spark, some)).collect()}
    assert {i: (rows[i].n_removed, rows[i].kept_sha256) for i, _ in some} == {i: (e[1], e[4]) for (i, _), e in zip(some, expected, strict=True)}


def test_repeats_of_odd_tables(spark):
    assert suffix_dedup.remove(frame(spark, [])).collect() == []
    text = "".join(random.Random(1).choices("abcdefgh ", k=300))
    rows = suffix_dedup.remove(frame(spark, [(1, text), (1, text), (None, None), (2, text[:199])])).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.text) for r in rows) == [("1", 300, ""), ("1", 300, ""), ("2", 0, text[:199]), ("None", 0, None)]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    documents = places(packing.pack(frame(spark, docs), word_tokenizer()).collect())
    assert set(documents) == {i for i, _ in docs}
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        at = 0
        for r in sorted(documents[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert at == len(ids) // 4


def test_packing_spreads_equal_rows(spark, monkeypatch):
    """Rows that are equal in all columns go to different shards."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    rows = packing.pack(frame(spark, [(None, "")] * 1000), word_tokenizer()).collect()
    shards = [r.sequence_id >> 40 for r in rows]
    assert len(rows) == 1000 and len(set(shards)) == 10 and max(map(shards.count, set(shards))) < 200
    places(rows)


def test_packing_of_odd_tables_and_whole_sequences(spark):
    assert packing.pack(frame(spark, []), word_tokenizer()).collect() == []
    packed = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]), word_tokenizer(), capacity=4, keep_ids=True)
    rows = packed.collect()
    assert len(rows) == 4 and {str(r.doc_id) for r in rows} == {"1", "2", "None"}
    sequences = {r.sequence_id: np.frombuffer(r.ids, dtype="<u4") for r in packing.sequences(packed, 4).collect()}
    assert all(len(s) == 4 for s in sequences.values())
    for r in rows:
        assert sequences[r.sequence_id][r.offset : r.offset + r.length].tobytes() == r.ids


def test_best_fit_picks_the_tightest_window():
    lengths = np.array(sorted(random.Random(2).choices(range(1, 4097), k=3000), reverse=True))
    windows, offsets = packing.best_fit_decreasing(lengths)
    room: dict[int, int] = {}
    for n, w, o in zip(lengths.tolist(), windows.tolist(), offsets.tolist(), strict=True):
        fitting = [r for r in room.values() if r >= n]
        assert 4096 - o == (min(fitting) if fitting else 4096)
        room[w] = 4096 - o - n
    assert lengths.sum() / (4096 * len(room)) > 0.98


def test_quality_rules(spark, docs):
    rows = {r.doc_id: r for r in quality_rules.judge(frame(spark, docs)).collect()}
    for i, text in docs:
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality(text), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert sum(r.kept for r in rows.values()) > 20
    assert quality_rules.judge(frame(spark, [])).collect() == []


def test_quality_of_very_long_texts_takes_the_wide_form(spark, docs, monkeypatch):
    monkeypatch.setattr(quality_rules, "_POSITION_BITS", 4)
    rows = quality_rules.judge(frame(spark, docs)).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {i: quality(t)[4] for i, t in docs}


def test_quality_runs_no_python(spark, docs):
    plan = quality_rules.judge(frame(spark, docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_a_rule_table_is_compiled(spark):
    rules = (quality_rules.Rule("symbols_per_word", None, 0.0),)
    rows = quality_rules.judge(frame(spark, [(1, "w " * 5 + " ".join(invented(4, 80))), (2, "# " + " ".join(invented(4, 80)))]), rules=rules).orderBy("doc_id").select(F.col("kept")).collect()
    assert [r.kept for r in rows] == [True, False]
