"""Similarity join of documents on word shingles, with token-combination prefixes.

A document's set holds its distinct shingles of five words as 64-bit hashes. Documents with equal sets are one class; the
join runs between classes. All shingles have one global order: rare ones by hash, then frequent ones by rising frequency.
Two sets that overlap enough share their first common shingles inside a prefix of each set. The prefix is extended by one
shingle for each sub-class of frequent shingles; then a pair that qualifies shares a rare shingle, or, by the pigeonhole
principle, two frequent shingles of one sub-class. So rare shingles are indexed alone and frequent ones only as pairs within
a sub-class. The number of sub-classes grows with a document's size, which keeps its pairs linear in its size.

Each class is first compared with one that it shares a signature with, the one whose bitmap is nearest. Of the signatures whose classes are in
one component then, nothing else is compared. Of the others, each class is compared with the nearest across components; and in
the end all pairs that are still apart. Bitmaps of a bit or two for each shingle rule most pairs out; each that they leave is
settled by intersecting whole sets.
Signatures travel as packed arrays, a few rows for millions of entries. A long list of classes with one signature is first
dealt into parts that find their leaders apart; the leaders meet again as a list.

Which shingles are frequent comes from counts over all documents: each task counts what it reads and reports the shingles it
saw in ``LOCAL_COUNT`` documents or more; their sums, thresholded to at most ``FREQUENT_MAX`` entries, are broadcast (that
many times 12 bytes). The choice changes only the order, and so the cost, never the result.

Defined results: a null text or one without words has an empty set, is linked with nothing and keeps its own doc_id as
component. With fewer words than a shingle has, the whole sequence is the one shingle. Repeated rows get the same result each.
Rows of a null doc_id take part through their text and get their component's smallest doc_id, null if there is none. doc_id
is a key: apart from repeated rows, it names one text. A very long text is hashed whole and has as many shingles as it has.
Other columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batch, discard, lean, lean_group, materialize, mix, runs_of, small_batches
from .components import by_label, connected

SHINGLE = 5
#: Similarity threshold as a fraction: intersection / union >= NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
LOCAL_COUNT = 2
FREQUENT = 8
FREQUENT_MAX = 1 << 20
SUBCLASS_SPAN = 32
DOCS_PER_BUCKET = 4096
FLUSH_ENTRIES = 1_000_000
COUNT_SHINGLES = 2_000_000
BLOOM_WORDS = 1 << 18
#: Members of a list that are compared in one task at first.
LIST_PART = 1000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each text's number of words. A-Z count as a-z."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    lengths = ends - starts
    letters = np.flatnonzero(~space)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    parts = (_LOWER[data[letters]].astype(np.uint64) + np.uint64(1)) * _power(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(parts, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, limits), prepend=0)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    if len(hashes) >= size:
        rolled = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
        for j in range(size):
            rolled = rolled * np.uint64(_BASE) + hashes[j : len(hashes) - size + 1 + j]
        rolled = mix(rolled + np.uint64(size))
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            value = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + n]:
                    value = value * np.uint64(_BASE) + h
            out.append(mix(np.array([value], dtype=np.uint64) ^ _M2))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def set_key(own: np.ndarray) -> tuple[int, int]:
    """Two independent fingerprints of a set: its class, and a check that classes are not confused."""
    with np.errstate(over="ignore"):
        a = mix(np.array([mix(own + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(own))], dtype=np.uint64))
        b = np.bitwise_xor.reduce(mix(own ^ _M1)) if len(own) else np.uint64(0)
    return int(a.view(np.int64)[0]), int(np.array([b], dtype=np.uint64).view(np.int64)[0])


def class_id(key: tuple[int, int], collided: frozenset[int]) -> int:
    """The set's class: its first fingerprint, mixed with the second where different sets have the first in common."""
    return key[0] ^ key[1] if key[0] in collided else key[0]


def bitmap(own: np.ndarray) -> bytes:
    """The parities of how many shingles fall on each bit; at least one bit for each shingle, a power of two in all."""
    bits = 1 << max(6, len(own).bit_length())
    place = (mix(own ^ _M2) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap at a smaller size; parities survive folding."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _fits(n, m, apart):
    """False only where two sets of sizes n and m cannot be similar enough, as apart is a lower bound of their difference."""
    shared = (n + m - apart) // 2
    return DENOMINATOR * shared >= NUMERATOR * (n + m - shared)


def bits_apart(x: bytes, y: bytes) -> int:
    """How many bits of two bitmaps differ, at the smaller one's size."""
    x, y = sorted((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)), key=len)
    return int(np.bitwise_count(x ^ _folded(y, len(x))).sum())


def _overlap(n: int) -> int:
    """The least intersection of a set of size n with any partner."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _subclasses(band: int) -> int:
    return max(1, (1 << band) // SUBCLASS_SPAN)


def signatures(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Signatures of one set: rare shingles of its prefix, and pairs of frequent ones within a sub-class.

    Sizes fall into bands of powers of two. Partners lie in the same or in neighbouring bands and meet in the larger's band.
    """
    n = len(own)
    if not n:
        return own
    band = n.bit_length() - 1
    bands = [band] + [band + 1] * (n * DENOMINATOR >= (1 << (band + 1)) * NUMERATOR)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        is_frequent = frequent[at] == own
        rare, common = own[~is_frequent], own[is_frequent][np.argsort(rank[at[is_frequent]], kind="stable")]
    else:
        rare, common = own, own[:0]
    base = n - _overlap(n) + 1
    out = [rare[: base + max(_subclasses(b) for b in bands)]]
    for b in bands:
        groups = _subclasses(b)
        taken = common[: max(0, base + groups - len(rare))]
        if len(taken) < 2:
            continue
        group = mix(taken ^ np.uint64(0x5BD1E995)) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        taken, group = taken[order], group[order]
        for step in range(1, len(taken)):
            same = np.flatnonzero(group[step:] == group[:-step])
            if not len(same):
                break
            out.append(mix(taken[same] * _M1 + taken[same + step] * _M2 + np.uint64(b + 1)))
    return np.concatenate(out)


def _batch_sets(batch, text: str):
    texts = batch.column(text).to_pylist()
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > 400_000 or i == len(texts) - 1:
            for j, own in zip(range(first, i + 1), shingle_sets(texts[first : i + 1]), strict=True):
                yield j, own
            first, size = i + 1, 0


_PROFILE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "cid", "proof", "n", "bucket")] + [T.StructField(c, T.BinaryType()) for c in ("bits", "blob")]
)
_COUNT_BUCKETS = 64


def _profile(docs: DataFrame) -> DataFrame:
    """One pass: each document's class and size; and packed counts of shingles that a task saw in several classes."""

    def run(batches):
        sets: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def flush():
            nonlocal held
            if not sets:
                return None
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            sets.clear()
            seen.clear()
            held = 0
            tokens, counts = tokens[counts >= LOCAL_COUNT], counts[counts >= LOCAL_COUNT]
            bucket = (tokens >> np.uint64(58)).astype(np.int64)
            rows = []
            for b in np.unique(bucket).tolist():
                mine = bucket == b
                rows.append((None, None, None, None, b, None, tokens[mine].tobytes() + counts[mine].astype(np.int64).tobytes()))
            return arrow_batch(zip(*rows, strict=True), _PROFILE) if rows else None

        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for j, own in _batch_sets(batch, "text"):
                cid, proof = set_key(own)
                rows.append((ids[j], cid, proof, len(own), None, bitmap(own), None))
                if cid not in seen:
                    seen.add(cid)
                    sets.append(own)
                    held += len(own)
            if rows:
                yield arrow_batch(zip(*rows, strict=True), _PROFILE)
            if held > COUNT_SHINGLES and (counted := flush()) is not None:
                yield counted
        if (counted := flush()) is not None:
            yield counted

    return materialize(docs.mapInArrow(lean(run), _PROFILE), "shingle-profile")


_SUMS = T.StructType([T.StructField("n", T.LongType()), T.StructField("least", T.LongType()), T.StructField("blob", T.BinaryType())])


def _frequent(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their rank by frequency; at most FREQUENT_MAX of them."""
    import pyarrow as pa

    def add(key, rows):
        tokens, counts = [], []
        for blob in rows["blob"].to_pylist():
            half = len(blob) // 2
            tokens.append(np.frombuffer(blob[:half], dtype=np.uint64))
            counts.append(np.frombuffer(blob[half:], dtype=np.int64))
        token, back = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        out, least = [], FREQUENT
        while True:  # a row for each power of two, so that a higher threshold can be chosen later
            mine = (total >= least) & (total < 2 * least)
            if mine.any():
                out.append((int(mine.sum()), least, token[mine].tobytes() + total[mine].tobytes()))
            if not (total >= 2 * least).any():
                break
            least *= 2
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.Table.from_batches([arrow_batch(columns, _SUMS)])

    sums = materialize(profile.where("bucket IS NOT NULL").select("bucket", "blob").groupBy("bucket").applyInArrow(lean_group(add), _SUMS), "shingle-counts")
    room, least = FREQUENT_MAX, None
    for row in sums.groupBy("least").agg(F.sum("n").alias("n")).orderBy(F.desc("least")).collect():  # one row for each power of two
        if row.n > room:
            break
        room, least = room - row.n, row.least
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    tokens, totals = [], []
    for row in sums.where(F.col("least") >= least).select("blob").toLocalIterator():
        half = len(row.blob) // 2
        tokens.append(np.frombuffer(bytes(row.blob[:half]), dtype=np.uint64))
        totals.append(np.frombuffer(bytes(row.blob[half:]), dtype=np.int64))
    token, total = np.concatenate(tokens), np.concatenate(totals)
    rank = np.empty(len(token), dtype=np.int32)
    rank[np.lexsort((token, total))] = np.arange(len(token), dtype=np.int32)
    order = np.argsort(token)
    return token[order], rank[order]


_ENTRIES = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("blob", T.BinaryType())])
_CANDIDATES = T.StructType(
    [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("list_id", T.LongType()), T.StructField("cids", T.BinaryType())]
)


def _index(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray, buckets: int, collided: frozenset[int]) -> DataFrame:
    """Signatures of all documents, as packed arrays for each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, rank))

    def run(batches):
        tokens, order = shared.value
        found: list[np.ndarray] = []
        owners: list[tuple[int, int, int]] = []
        seen: set[int] = set()
        held = 0

        def flush():
            nonlocal held
            if not found:
                return None
            sig = np.concatenate(found)
            counts = [o[2] for o in owners]
            cid = np.repeat(np.array([o[0] for o in owners], dtype=np.int64), counts)
            size = np.repeat(np.array([o[1] for o in owners], dtype=np.int32), counts)
            found.clear()
            owners.clear()
            seen.clear()
            held = 0
            bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            at = np.argsort(bucket, kind="stable")
            low = sig.astype(np.uint32)
            rows = []
            for first, end in zip(*(x.tolist() for x in runs_of(bucket[at])), strict=True):
                mine = at[first:end]
                rows.append((int(bucket[mine[0]]), low[mine].tobytes() + size[mine].tobytes() + cid[mine].tobytes()))
            return arrow_batch(zip(*rows, strict=True), _ENTRIES)

        for batch in batches:
            for _, own in _batch_sets(batch, "text"):
                cid = class_id(set_key(own), collided)
                if not len(own) or cid in seen:
                    continue
                seen.add(cid)
                sig = signatures(own, tokens, order)
                found.append(sig)
                owners.append((cid, len(own), len(sig)))
                held += len(sig)
                if held >= FLUSH_ENTRIES:
                    yield flush()
        if found:
            yield flush()

    return docs.mapInArrow(lean(run), _ENTRIES)


def _near_size(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return small.astype(np.int64) * DENOMINATOR >= large.astype(np.int64) * NUMERATOR


def _candidates(entries: DataFrame) -> DataFrame:
    import pyarrow as pa

    def match(key, rows):
        sigs, sizes, cids = [], [], []
        for blob in rows["blob"].to_pylist():
            n = len(blob) // 16
            sigs.append(np.frombuffer(blob[: 4 * n], dtype=np.uint32))
            sizes.append(np.frombuffer(blob[4 * n : 8 * n], dtype=np.int32))
            cids.append(np.frombuffer(blob[8 * n :], dtype=np.int64))
        sig, size, cid = np.concatenate(sigs), np.concatenate(sizes), np.concatenate(cids)
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        multiple = np.zeros(len(sig), dtype=bool)
        same = sig[1:] == sig[:-1]
        multiple[1:] |= same
        multiple[:-1] |= same
        order, sig = order[multiple], sig[multiple]
        size, cid = size[order], cid[order]
        order = np.lexsort((cid, size, sig))
        sig, size, cid = sig[order], size[order], cid[order]
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])
        sig, size, cid = sig[fresh], size[fresh], cid[fresh]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(starts, len(sig)))
        pairs = starts[counts == 2]
        pairs = pairs[_near_size(size[pairs], size[np.minimum(pairs + 1, len(size) - 1)])] if len(pairs) else pairs
        a, b = cid[pairs].tolist(), cid[pairs + 1].tolist()
        lists = []
        large = np.flatnonzero(counts > 2)
        if len(large):
            sums = np.add.reduceat(mix(cid.view(np.uint64)), starts)
            _, pick = np.unique(sums[large], return_index=True)  # many signatures have the same list
            for i in large[pick].tolist():
                own = slice(starts[i], starts[i] + counts[i])
                lists.append((int(sums[i : i + 1].view(np.int64)[0]), cid[own].tobytes()))
        unique = sorted(set(zip(a, b, strict=True)))
        none = [None] * len(lists)
        columns = [
            [p[0] for p in unique] + none,
            [p[1] for p in unique] + none,
            [None] * len(unique) + [x[0] for x in lists],
            [None] * len(unique) + [x[1] for x in lists],
        ]
        return pa.Table.from_batches([arrow_batch(columns, _CANDIDATES)])

    return materialize(entries.groupBy("bucket").applyInArrow(lean_group(match), _CANDIDATES), "candidates")


def _bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of doc_ids, BLOOM_WORDS x 64 bits however many ids there are; built by an aggregation."""
    places = F.explode(F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(64 * BLOOM_WORDS)) for i in range(3)]))
    bits = ids.select(places.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    words = np.zeros(BLOOM_WORDS, dtype=np.int64)
    for row in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        words[row.word] = row.bits
    return words


_SETS = T.StructType([T.StructField("cid", T.LongType()), T.StructField("shingles", T.BinaryType())])


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, collided: frozenset[int]) -> DataFrame:
    """The whole sets of all classes in pairs. A filter of bounded size drops most other documents before any shuffle."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    first = materialize(classes.join(wanted, "cid").select("cid", "doc_id"), "compared")
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(first))
    places = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(64 * BLOOM_WORDS)).alias(f"p{i}") for i in range(3)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for i in range(3):
                p = batch.column(f"p{i}").to_numpy()
                keep &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
            batch = batch.filter(pa.array(keep))
            ids, rows = batch.column("doc_id"), []
            for j, own in _batch_sets(batch, "text"):
                rows.append((ids[j].as_py(), class_id(set_key(own), collided), own.tobytes()))
                if sum(len(r[2]) for r in rows[-64:]) > 1 << 23:
                    yield arrow_batch(zip(*rows, strict=True), schema)
                    rows = []
            if rows:
                yield arrow_batch(zip(*rows, strict=True), schema)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *_SETS.fields])
    sets = docs.select("doc_id", "text", *places).mapInArrow(lean(run), schema)
    of = first.withColumnRenamed("doc_id", "of")  # null for a class without any doc_id
    found = materialize(sets.join(of, "cid").where(F.col("doc_id").eqNullSafe(F.col("of"))).select("cid", "shingles").dropDuplicates(["cid"]), "sets")
    discard(first)
    return found


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _maps(profile: DataFrame) -> DataFrame:
    """Size and bitmap of each class."""
    return materialize(profile.where("n > 0").select("cid", "n", "bits").dropDuplicates(["cid"]), "bitmaps")


_NEAR = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "apart")])


def _possible(maps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that their bitmaps do not rule out, and by how many bits they differ."""
    left = maps.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = maps.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def run(batches):
        for batch in batches:
            kept = []
            for a, b, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "xa", "xb")), strict=True):
                if _fits(n, m, apart := bits_apart(x, y)):
                    kept.append((a, b, apart))
            if kept:
                yield arrow_batch(zip(*kept, strict=True), _NEAR)

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb")
    return materialize(joined.mapInArrow(lean(run), _NEAR), "possible")


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, collided: frozenset[int]) -> DataFrame:
    """The pairs whose whole sets are similar enough. Large stars are split by the join's skew handling."""
    sets = _sets(docs, classes, pairs, collided)
    left = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))

    def run(batches):
        for batch in batches:
            links = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sa", "sb")), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if DENOMINATOR * shared >= NUMERATOR * (len(x) + len(y) - shared):
                    links.append((a, b))
            if links:
                yield arrow_batch(zip(*links, strict=True), _LINKS)

    joined = pairs.join(left, "b").join(right, "a").select("a", "b", "sa", "sb")
    links = materialize(joined.mapInArrow(lean(run), _LINKS), "links")
    discard(sets)
    return links


class _Leaders:
    """Bitmaps of one size, growing."""

    def __init__(self, size: int):
        self.rows, self.stack = [], np.zeros((4, size), dtype=np.uint64)

    def add(self, row: int, bits: np.ndarray) -> None:
        if len(self.rows) == len(self.stack):
            self.stack = np.concatenate([self.stack, np.zeros_like(self.stack)])
        self.stack[len(self.rows)] = bits
        self.rows.append(row)

    def apart(self, bits: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.stack[: len(self.rows)] ^ bits).sum(1, dtype=np.int64)


def leader_pairs(n: np.ndarray, cid: np.ndarray, label: np.ndarray, side: np.ndarray, bits: list[bytes]):
    """At most one pair for each member of a list sorted by size: with the leader whose bitmap differs least, if one fits.

    A member that no leader fits becomes one, so near copies gather around few leaders. Leaders come as pairs with themselves.
    """
    leaders: dict[int, _Leaders] = {}
    for j in range(len(n)):
        own, best = np.frombuffer(bits[j], dtype=np.uint64), None
        for size in (len(own) // 2, len(own)):  # partners of smaller size are at most one power of two smaller
            if size not in leaders:
                continue
            rows = np.array(leaders[size].rows)
            apart = leaders[size].apart(_folded(own, size))
            fits = np.flatnonzero(_fits(n[rows], n[j], apart))
            if len(fits):
                k = fits[apart[fits].argmin()]
                best = min(filter(None, (best, (int(apart[k]), int(cid[rows[k]])))))
        if best:
            yield best[1], int(cid[j]), best[0]
        else:
            leaders.setdefault(len(own), _Leaders(len(own))).add(j, own)
            yield int(cid[j]), int(cid[j]), 0


def cross_pairs(n: np.ndarray, cid: np.ndarray, label: np.ndarray, side: np.ndarray, bits: list[bytes], best_only: bool):
    """Pairs of a list, sorted by size, whose labels differ and whose bitmaps do not rule them out. Where members have two sides,
    only pairs of both.

    With best_only, for each member just the nearest larger ones and the nearest smaller one.
    """
    words = [np.frombuffer(x, dtype=np.uint64) for x in bits]
    levels: dict[int, np.ndarray] = {}
    one_sided = len(side) == 0 or side.min() == side.max()
    nearest, smaller = np.full(len(n), 1 << 62), np.full(len(n), -1)
    for i in range(len(n) - 1):
        reach = int(np.searchsorted(n, n[i] * DENOMINATOR // NUMERATOR, side="right"))
        other = np.flatnonzero((label[i + 1 : reach] != label[i]) & (one_sided | (side[i + 1 : reach] != side[i]))) + i + 1
        if not len(other):
            continue
        size = len(words[i])
        if size not in levels:  # all members from here on have at least this many words
            levels[size] = np.stack([_folded(w, size) if len(w) >= size else np.zeros(size, dtype=np.uint64) for w in words])
        apart = np.bitwise_count(levels[size][other] ^ words[i]).sum(1, dtype=np.int64)
        fits = _fits(n[i], n[other], apart)
        other, apart = other[fits], apart[fits]
        if best_only:
            closer = apart < nearest[other]
            nearest[other[closer]], smaller[other[closer]] = apart[closer], i
            some = np.argsort(apart, kind="stable")[:2]
            other, apart = other[some], apart[some]
        for j, d in zip(other.tolist(), apart.tolist(), strict=True):
            yield int(cid[i]), int(cid[j]), d
    if best_only:
        for j in np.flatnonzero(smaller >= 0).tolist():
            yield int(cid[smaller[j]]), int(cid[j]), int(nearest[j])


_MEMBERS = T.StructType([T.StructField(c, T.LongType()) for c in ("list_id", "size", "cid")])
_FOUND = T.StructType([T.StructField("list_id", T.LongType()), *_NEAR.fields])


def _members(lists: DataFrame) -> DataFrame:
    """list_id, size and cid of every member of every list."""

    def run(batches):
        for batch in batches:
            for i, cids in zip(batch.column("list_id").to_pylist(), batch.column("cids").to_pylist(), strict=True):
                own = np.frombuffer(cids, dtype=np.int64)
                yield arrow_batch([np.full(len(own), i), np.full(len(own), len(own)), own], _MEMBERS)

    return lists.select("list_id", "cids").mapInArrow(lean(run), _MEMBERS)


def _grouped(flat: DataFrame, maps: DataFrame, keys: list[str], method) -> DataFrame:
    """method's pairs of each group of keys, whose members are sorted by size; list_id comes with them."""
    full = flat.join(maps, "cid")
    grouped = full.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "cid", "label", "side", "bits"))).alias("m"))

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("n", "cid", "label", "side", "bits")]
            for i in range(batch.num_rows):
                numbers = [np.array(c[i].as_py(), dtype=np.int64) for c in columns[:4]]
                list_id, rows = batch.column("list_id")[i].as_py(), []
                for pair in method(*numbers, columns[4][i].as_py()):
                    rows.append((list_id, *pair))
                    if len(rows) == 100_000:
                        yield arrow_batch(zip(*rows, strict=True), _FOUND)
                        rows = []
                if rows:
                    yield arrow_batch(zip(*rows, strict=True), _FOUND)

    return grouped.select("list_id", "m.n", "m.cid", "m.label", "m.side", "m.bits").mapInArrow(lean(run), _FOUND)


def _list_stars(lists: DataFrame, maps: DataFrame) -> list[DataFrame]:
    """The leader pairs of each list, in one or more tables.

    A list of more than LIST_PART members is dealt into parts by a hash, each with leaders of its own; those meet again as a
    list, until it fits one part or stops shrinking.
    """
    flat, made = _members(lists).withColumn("label", F.col("cid")), []
    while True:
        parts = F.ceil(F.col("size") / F.lit(LIST_PART))
        dealt = flat.withColumn("part", F.pmod(F.xxhash64("cid", "size"), parts)).withColumn("side", F.lit(0))
        made.append(materialize(_grouped(dealt, maps, ["list_id", "part"], leader_pairs), "stars"))
        # lists of several parts whose leaders are less than half of their members
        sizes = flat.where(F.col("size") > LIST_PART).groupBy("list_id").agg(F.first("size").alias("was"))
        leaders = made[-1].where("a = b").select("list_id", F.col("a").alias("cid"))
        sizes = leaders.join(sizes, "list_id").groupBy("list_id", "was").agg(F.count(F.lit(1)).alias("size")).where("2 * size < was")
        flat = materialize(leaders.join(sizes.drop("was"), "list_id").withColumn("label", F.col("cid")), "leaders")
        if flat.isEmpty():
            return made


def _list_rest(lists: DataFrame, maps: DataFrame, labels: DataFrame, best_only: bool) -> DataFrame:
    """Pairs across components, of those lists that have several.

    A list of more than LIST_PART members is dealt into parts by a hash, and each two parts are one block, so that no task
    compares a whole long list. Of a block of two parts the pairs within one part are left to that part's own block.
    """
    flat = _members(lists).join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    unsettled = flat.groupBy("list_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("list_id")
    parts = F.ceil(F.col("size") / F.lit(LIST_PART))
    own = flat.join(unsettled, "list_id", "left_semi").withColumns({"parts": parts, "part": F.pmod(F.xxhash64("cid"), parts)})
    blocks = own.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    blocks = blocks.select("list_id", "cid", "label", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), (F.col("part") > F.col("with")).cast("int").alias("side"))
    return _grouped(blocks, maps, ["list_id", "low", "high"], lambda *columns: cross_pairs(*columns, best_only)).select(*_NEAR.names)


def _differing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "apart")


def link(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest doc_id reachable by links, itself included."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile, collided = _profile(docs), frozenset()
    while True:
        own = profile.where("cid IS NOT NULL").select("doc_id", "cid", "proof", "n")
        classes = own.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min("proof").alias("lo"), F.max("proof").alias("hi"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        classes = materialize(classes, "classes")
        # hash collisions only: of n different sets about n * n / 2**65
        shared = [r.cid for r in classes.where("lo <> hi").select("cid").toLocalIterator()]
        if not shared or collided:
            break
        collided = frozenset(shared)
        rekeyed = F.when(F.col("cid").isin(shared), F.col("cid").bitwiseXOR(F.col("proof"))).otherwise(F.col("cid"))
        profile = materialize(profile.withColumn("cid", rekeyed), "shingle-profile")
    total = classes.agg(F.sum("rows")).first()[0] or 0
    buckets = max(64, -(-total // DOCS_PER_BUCKET))
    found = _candidates(_index(docs, *_frequent(profile), buckets, collided))
    pairs = materialize(found.where("list_id IS NULL").select("a", "b").distinct(), "pairs")
    lists = materialize(found.where("list_id IS NOT NULL").select("list_id", "cids").dropDuplicates(["list_id"]), "lists")
    discard(found)
    # first each class with its likeliest partner; then what is still apart, the nearest across components; then all else
    maps = _maps(profile)
    possible = _possible(maps, pairs)
    discard(pairs)
    likely, stars = possible, _list_stars(lists, maps)
    for some in stars:
        likely = likely.unionAll(some.where("a <> b").select(*_NEAR.names))
    tried = likely.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("least")).select(F.col("least.a").alias("a"), "b")
    tried = materialize(tried, "tried")
    discard(*stars)
    links, done = _verify(docs, classes, tried, collided), [tried]
    labels = connected(links, "a", "b")
    for best_only in (True, False):
        rest = _list_rest(lists, maps, labels, best_only)
        if best_only:
            rest = rest.unionAll(_differing(possible, labels))
        rest = materialize(rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        done.append(rest)
        if rest.isEmpty():
            continue
        links, tried = links.unionAll(_verify(docs, classes, rest, collided)), tried.unionAll(rest)
        labels = connected(links, "a", "b")
    discard(maps, lists, possible, *done)
    named = classes.where("n > 0").select(F.col("cid").alias("node"), "doc_id").join(labels, "node", "left")
    smallest = named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    # a class without links has a label of its own, which no component has
    found = by_label(named.withColumn("label", F.coalesce("label", "node")), smallest, "node", "left")
    of_class = found.select(F.col("node").alias("cid"), F.coalesce("component_id", "doc_id").alias("component_id"))
    result = own.join(of_class, "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
