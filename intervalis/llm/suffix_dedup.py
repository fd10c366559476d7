"""Removal of byte strings that repeat across a corpus, by distributed prefix-free parsing.

Rolling hashes of ``GRAM`` bytes pick triggers: the smallest hash in every stretch of ``SPAN`` bytes. Stretches with the same
trigger form a phrase, so every stretch of the corpus lies in exactly one phrase, neighbouring phrases overlap by SPAN - 1
bytes, and equal stretches lie at equal places of phrases with equal triggers. The distinct phrases, compared byte by byte,
are the dictionary; the phrases of the texts, in order, are the parse.

A phrase that the parse has twice is repeated as a whole. For the others two sorted orders are built among phrases of one
trigger: that of the dictionary, the bytes before the trigger read backwards, and that of the parse, what follows from the
trigger on. A stretch that begins d bytes before its trigger has its place in corpus order by its d dictionary bytes and the
parse's rank of the rest, so two stretches are equal if they are in one class of depth d of the first order and in one class
of depth SPAN - d of the second; common prefixes of neighbours in both orders give the classes. Orders end at SPAN bytes,
since a stretch never reaches beyond its phrase. A first pass over the triggers alone says which recur; phrases of the others
never leave their task.

Both passes send packed arrays keyed by trigger, and each task lets an exact copy through twice at most. A phrase that a task
has several times is repeated for certain; its runs go straight to their texts and one of its occurrences to the dictionary.
Triggers with more than ``HOT`` occurrences are refined by three further triggers of other hash orders, so phrases around one frequent passage
are spread over many keys and tasks. The filter of recurring triggers has about one bit for ten bytes of the corpus, at most
``FILTER_BITS``; where it fills up, more is shuffled and the result stays the same.

Texts are keyed by two independent 64-bit hashes, so exact copies share their spans.

Defined results: a null or empty text has 0 bytes, no spans, and the hash of no bytes. Matches never cross texts. Repeated
rows are copies of each other. Very long texts are parsed in overlapping pieces of ``PIECE`` bytes. Cuts fall on bytes; as
text, a character cut in half is dropped. Extra columns pass through; result columns replace columns of the same name. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batch, gather, lean, lean_group, materialize, mix, runs_of, small_batches

SPAN = 200
GRAM = 32
#: Bytes of a text that are parsed at once; longer texts are parsed in overlapping pieces.
PIECE = 1 << 18
#: The filter's least and largest size.
FILTER_BITS = (1 << 20, 1 << 28)
#: Occurrences from which on a trigger is refined.
HOT = 1 << 13
#: Phrases that are put in order at once, or all of one trigger.
TOGETHER = 8_000
FLUSH_BYTES = 4 << 20
FLUSH_GRAMS = 300_000
BUCKET_BYTES = 8 << 20
#: Bits of the filter of texts that have spans.
TEXT_BITS = 1 << 24
#: Keys of texts that a task remembers.
REMEMBERED = 50_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _tables[base] = np.multiply.accumulate(steps)
    return _tables[base][:n]


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = hash of data[i:j] times the base to the i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=out[1:])
    return out


def _hash_spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _powers(_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def _gram_hashes(prefix: np.ndarray) -> np.ndarray:
    grams = len(prefix) - GRAM
    return mix((prefix[GRAM:] - prefix[:grams]) * _powers(_INVERSE, grams))


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """The least value of each stretch of reach values, by doubling."""
    n, have = len(values) - reach + 1, 1
    while have * 2 <= reach:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[reach - have : reach - have + n])


def phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of at most PIECE bytes: the trigger's hash and place, and the first and last stretch of each."""
    n = len(data)
    if n < SPAN:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    hashed = _gram_hashes(_prefix_hashes(data))
    low = np.uint64((1 << 20) - 1)
    key = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)  # equal hashes: the leftmost
    trigger = (_least(key, SPAN - GRAM + 1) & low).astype(np.int64)
    first, end = runs_of(trigger)
    place = trigger[first]
    return hashed[place] & ~np.uint64(15), place, first, end - 1


def refine(data: np.ndarray, found: tuple, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases with those of hot triggers cut up: stretches of one key also share the least gram of three other orders."""
    trigger, place, first, last = found
    cold = np.flatnonzero(~hot)
    columns = [[trigger[cold]], [place[cold]], [first[cold]], [last[cold]]]
    hashed = _gram_hashes(_prefix_hashes(data))
    for p in np.flatnonzero(hot).tolist():
        a, b = int(first[p]), int(last[p])
        own = hashed[a : b + SPAN - GRAM + 1]
        key = np.full(b - a + 1, trigger[p], dtype=np.uint64)
        for step in (_M1, _M2, _M3):
            key = mix(key * _M1 + _least(mix(own ^ step), SPAN - GRAM + 1))
        begin, end = runs_of(key)
        for column, values in zip(columns, (key[begin] & ~np.uint64(15), np.full(len(begin), place[p]), a + begin, a + end - 1), strict=True):
            column.append(values)
    return tuple(np.concatenate(c) for c in columns)


def _pieces(text: str | None):
    """A text's pieces and where they start. They overlap by SPAN - 1 bytes, so each stretch lies in one piece."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for at in range(0, max(1, len(data) - SPAN + 1), PIECE - SPAN + 1):
        yield at, data[at : at + PIECE]


class _Copies:
    """Lets each text of a task through twice at most: more copies change nothing."""

    def __init__(self):
        self.seen: dict[tuple[int, int], bool] = {}

    def enough(self, key: tuple[int, int]) -> bool:
        if self.seen.get(key):
            return True
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[key] = key in self.seen
        return False


_BLOBS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("blob", T.BinaryType())])


def _bucketed(bucket: np.ndarray, arrays: list[np.ndarray]):
    """(bucket, blob) rows: each array's items of the bucket, one array after the other."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    for a, b in zip(*(x.tolist() for x in runs_of(bucket)), strict=True):
        yield int(bucket[a]), b"".join(x[a:b].tobytes() for x in arrays)


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(blob) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
        at += n * width
    return out


class _Filter:
    """Two sets of triggers, those that recur and the hot ones, as bits; each bucket owns a part."""

    def __init__(self, buckets: int, size: int):
        self.buckets = buckets
        wanted = min(max(8 * 2 ** max(0, size // 80).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
        self.part = max(64, -(-wanted // buckets) + 7 & ~7)
        self.hot_part = max(64, self.part // 16 + 7 & ~7)
        self.bits = None

    def _places(self, trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.bucket(trigger), mix(trigger >> np.uint64(4))

    def bucket(self, trigger: np.ndarray) -> np.ndarray:
        return ((trigger >> np.uint64(4)) % np.uint64(self.buckets)).astype(np.int64)

    def pack(self, recurring: np.ndarray, hot: np.ndarray) -> bytes:
        out = b""
        for trigger, part in ((recurring, self.part), (hot, self.hot_part)):
            bits = np.zeros(part, dtype=bool)
            bits[(self._places(trigger)[1] % np.uint64(part)).astype(np.int64)] = True
            out += np.packbits(bits).tobytes()
        return out

    def load(self, rows) -> None:
        self.bits = np.zeros((self.buckets, (self.part + self.hot_part) // 8), dtype=np.uint8)
        for row in rows:
            self.bits[row.bucket] = np.frombuffer(bytes(row.blob), dtype=np.uint8)

    def holds(self, trigger: np.ndarray, hot: bool) -> np.ndarray:
        bucket, hashed = self._places(trigger)
        place = (hashed % np.uint64(self.hot_part if hot else self.part)).astype(np.int64) + hot * self.part
        return (self.bits[bucket, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _recurring(docs: DataFrame, buckets: int, size: int) -> _Filter:
    """The filter of all triggers of two or more phrases, and of those with HOT or more."""
    found = _Filter(buckets, size)

    def grams(batches):
        held: list[np.ndarray] = []
        copies, waiting = _Copies(), 0

        def flush():
            trigger, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            counted = trigger | np.minimum(np.log2(count).astype(np.uint64), np.uint64(15))  # the low bits: a power of two
            return arrow_batch(zip(*_bucketed(found.bucket(trigger), [counted]), strict=True), _BLOBS)

        for batch in batches:
            for text, *key in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2")), strict=True):
                if copies.enough(tuple(key)):
                    continue
                for _, piece in _pieces(text):
                    own = phrases(piece)[0]
                    if len(own):
                        held.append(own)
                        waiting += len(own)
            if waiting > FLUSH_GRAMS:
                yield flush()
                waiting = 0
        if held:
            yield flush()

    def fold(key, rows):
        import pyarrow as pa

        counted = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in rows["blob"].to_pylist()])
        trigger, back = np.unique(counted & ~np.uint64(15), return_inverse=True)
        count = np.bincount(back, 2.0 ** (counted & np.uint64(15)).astype(np.float64))
        return pa.Table.from_batches([arrow_batch([[key[0].as_py()], [found.pack(trigger[count > 1], trigger[count >= HOT])]], _BLOBS)])

    made = docs.select("text", "k1", "k2").mapInArrow(lean(grams), _BLOBS).groupBy("bucket").applyInArrow(lean_group(fold), _BLOBS)
    made = materialize(made, "recurring-triggers")
    found.load(made.toLocalIterator())  # FILTER_BITS in all at most, however large the corpus
    return found


#: An occurrence of a phrase: trigger, text key (two halves), first byte in the text; bytes before the trigger and length;
#: and whether the task that sends it has the phrase several times.
_KINDS = ["<u8", "<i8", "<i8", "<i8", "<i2", "<i2", "<i1"]
_ENTRIES = T.StructType([*_BLOBS.fields, T.StructField("content", T.BinaryType())])
_SPAN_KINDS = ["<i8", "<i8", "<i8", "<i8"]


def _models(hashed: np.ndarray, length: np.ndarray, content: bytes) -> np.ndarray:
    """Of each phrase the first one with the same content, byte by byte."""
    _, pick, back = np.unique(hashed, return_index=True, return_inverse=True)
    model, begin = pick[back], np.cumsum(length) - length
    again = np.flatnonzero(model != np.arange(len(model)))
    for i, a, m, b, n in zip(*(x.tolist() for x in (again, begin[again], begin[model[again]], length[model[again]], length[again])), strict=True):
        if content[a : a + n] != content[m : m + b]:
            model[i] = i
    return model


def _by_text(k1: np.ndarray, texts: int) -> np.ndarray:
    return ((k1.view(np.uint64) >> np.uint64(3)) % np.uint64(texts)).astype(np.int64)


def _occurrences(docs: DataFrame, recurring: _Filter) -> DataFrame:
    """The phrases whose trigger recurs, with their bytes; and, in buckets behind those and without bytes, runs that are known
    to be repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(recurring)
    buckets = recurring.buckets

    def run(batches):
        triggers, copies = shared.value, _Copies()
        entries: list[tuple] = []
        size = 0

        def flush():
            columns = [np.concatenate([e[i] for e in entries]) for i in range(7)]
            content = np.concatenate([e[7] for e in entries])
            entries.clear()
            trigger, hashed, k1, k2, start, before, length = columns
            begin = np.cumsum(length) - length
            model = _models(hashed, length, content.tobytes())
            times = np.bincount(model, minlength=len(model))
            whole = np.flatnonzero(times[model] > 1)
            rows = [(buckets + b, blob, None) for b, blob in _bucketed(_by_text(k1[whole], buckets), [k1[whole], k2[whole], start[whole], start[whole] + length[whole]])]
            sent = np.flatnonzero(times)
            bucket = triggers.bucket(trigger[sent])
            order = np.argsort(bucket, kind="stable")
            for a, b in zip(*(x.tolist() for x in runs_of(bucket[order])), strict=True):
                mine = sent[order[a:b]]
                blob = b"".join(c[mine].astype(k).tobytes() for c, k in zip([trigger, k1, k2, start, before, length, times > 1], _KINDS, strict=True))
                rows.append((int(bucket[order[a]]), blob, content[gather(begin[mine], length[mine])].tobytes()))
            return arrow_batch(zip(*rows, strict=True), _ENTRIES)

        for batch in batches:
            for text, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2")), strict=True):
                if copies.enough((k1, k2)):
                    continue
                for at, piece in _pieces(text):
                    found = phrases(piece)
                    keep = np.flatnonzero(triggers.holds(found[0], False)) if len(found[0]) else []
                    if not len(keep):
                        continue
                    found = tuple(x[keep] for x in found)
                    if (hot := triggers.holds(found[0], True)).any():
                        found = refine(piece, found, hot)
                    trigger, place, first, last = found
                    end = last + SPAN
                    length, ones = end - first, np.ones(len(first), dtype=np.int64)
                    entries.append((trigger, _hash_spans(_prefix_hashes(piece), first, end), ones * k1, ones * k2, first + at, place - first, length, piece[gather(first, length)]))
                    size += int(length.sum()) + 48 * len(first)
                    if size > FLUSH_BYTES:
                        yield flush()
                        size = 0
        if entries:
            yield flush()

    return docs.select("text", "k1", "k2").mapInArrow(lean(run), _ENTRIES)


def _ordered(trigger: np.ndarray, content: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int):
    """Phrases sorted by trigger and by width bytes from start on, read in the direction of step; zeros fill short ones up.

    Returns each phrase's place in that order, the common prefix of each two neighbours (-1 if triggers differ), and of each
    phrase the longer one of its two.
    """
    rows = np.zeros((len(start), 8 + width), dtype=np.uint8)
    rows[:, :8] = trigger.astype(">u8").view(np.uint8).reshape(-1, 8)
    reach = step * np.arange(width)
    for i in range(0, len(start), 4096):
        inside = np.arange(width) < length[i : i + 4096, None]
        index = np.where(inside, start[i : i + 4096, None] + reach, 0)
        rows[i : i + 4096, 8:] = np.where(inside, content[index], 0)
    order = np.argsort(rows.view(f"S{8 + width}").ravel(), kind="stable")
    common = np.empty(len(start) - 1, dtype=np.int64)
    for i in range(0, len(common), 4096):
        own = rows[order[i : i + 4097]]
        differ = own[1:] != own[:-1]
        common[i : i + 4096] = np.where(differ.any(1), differ.argmax(1), 8 + width)
    common = np.maximum(common - 8, -1)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    most = np.maximum(np.concatenate([[-1], common]), np.concatenate([common, [-1]]))
    return place, common, most[place]


def repeated_runs(trigger: np.ndarray, content: np.ndarray, begin: np.ndarray, before: np.ndarray, length: np.ndarray):
    """Byte runs of distinct phrases that another phrase of the same trigger repeats: phrase, first byte, end."""
    after = length - before
    parse, follows, near = _ordered(trigger, content, begin + before, after, SPAN, 1)
    words, precedes, far = _ordered(trigger, content, begin + before - 1, before, SPAN - GRAM, -1)
    owners, places = [], []
    for d in range(int(before.max()) + 1):
        inside = np.flatnonzero((far >= d) & (near >= SPAN - d) & (before >= d) & (after >= SPAN - d))
        if len(inside) < 2:
            continue
        front = np.concatenate([[0], np.cumsum(precedes < d)])[words[inside]]
        rest = np.concatenate([[0], np.cumsum(follows < SPAN - d)])[parse[inside]]
        _, back, count = np.unique(front * np.int64(len(begin) + 1) + rest, return_inverse=True, return_counts=True)
        hit = inside[count[back] > 1]
        owners.append(hit)
        places.append(before[hit] - d)
    if not owners:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    owner, place = np.concatenate(owners), np.concatenate(places)
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    first, end = runs_of(owner * np.int64(2 * SPAN) + place - np.arange(len(owner)))
    return owner[first], place[first], place[end - 1] + SPAN


def _repeats(occurrences: DataFrame, buckets: int) -> DataFrame:
    """Repeated byte runs of texts (key halves, start, end), packed by text key."""

    def look(key, rows):
        import pyarrow as pa

        if key[0].as_py() >= buckets:
            return pa.table({"bucket": pa.array([key[0].as_py() - buckets] * rows.num_rows, pa.int64()), "blob": rows["blob"]})
        dictionary: dict[bytes, int] = {}
        parts, numbers = [], []
        for blob, content in zip(rows["blob"].to_pylist(), rows["content"].to_pylist(), strict=True):
            parts.append(_unpack(blob, _KINDS))
            at = 0
            for n in parts[-1][5].tolist():
                numbers.append(dictionary.setdefault(content[at : at + n], len(dictionary)))
                at += n
        del rows
        trigger, k1, k2, start, before, length, several = (np.concatenate([p[i] for p in parts]) for i in range(7))
        before, length, parse = before.astype(np.int64), length.astype(np.int64), np.array(numbers)
        del parts, numbers
        _, pick = np.unique(parse, return_index=True)
        count = np.bincount(parse, 1 + several)
        whole = np.flatnonzero((count[parse] > 1) & (several == 0))
        spans = [(k1[whole], k2[whole], start[whole], start[whole] + length[whole])]
        words = list(dictionary)
        del dictionary
        order = np.argsort(trigger[pick], kind="stable")
        waiting: list[np.ndarray] = []

        def settle() -> None:
            group = np.concatenate(waiting)
            waiting.clear()
            content = np.frombuffer(b"".join([words[p] for p in group.tolist()]), dtype=np.uint8)
            size = length[pick[group]]
            owner, a, b = repeated_runs(trigger[pick[group]], content, np.cumsum(size) - size, before[pick[group]], size)
            once = count[group[owner]] == 1
            at = pick[group[owner[once]]]
            spans.append((k1[at], k2[at], start[at] + a[once], start[at] + b[once]))

        for a, b in zip(*(x.tolist() for x in runs_of(trigger[pick][order])), strict=True):
            if b - a > 1 and (count[order[a:b]] == 1).any():
                if sum(map(len, waiting)) + b - a > TOGETHER and waiting:
                    settle()
                waiting.append(order[a:b])
        if waiting:
            settle()
        k1, k2, a, b = (np.concatenate([s[i] for s in spans]).astype(np.int64) for i in range(4))
        packed = list(_bucketed(_by_text(k1, buckets), [k1, k2, a, b]))
        return pa.Table.from_batches([arrow_batch(list(zip(*packed, strict=True)) or [[], []], _BLOBS)])

    return occurrences.groupBy("bucket").applyInArrow(lean_group(look), _BLOBS)


_TEXT_SPANS = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("spans", T.BinaryType())])


def _merge(spans: DataFrame) -> DataFrame:
    """One row for each text that has repeated bytes: the union of its runs, as pairs of 64-bit numbers."""
    def union(key, rows):
        import pyarrow as pa

        parts = [_unpack(b, _SPAN_KINDS) for b in rows["blob"].to_pylist()]
        k1, k2, a, b = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((a, k2, k1))
        k1, k2, a, b = k1[order], k2[order], a[order], b[order]
        text = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        number = np.cumsum(text)
        wide = np.int64(1) << 40  # texts laid out one behind the other, so that one running maximum serves all
        far = np.maximum.accumulate(b + number * wide)
        first = text | np.concatenate([[True], a[1:] + number[1:] * wide > far[:-1]])
        starts = np.flatnonzero(first)
        ends = far[np.append(starts[1:] - 1, len(far) - 1)] - number[starts] * wide
        runs = np.stack([a[starts], ends], 1)
        owner = number[starts]
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        heads = starts[edges]
        blobs = [runs[x:y].tobytes() for x, y in zip(edges, np.append(edges[1:], len(owner)), strict=True)]
        return pa.Table.from_batches([arrow_batch([k1[heads], k2[heads], blobs], _TEXT_SPANS)])

    return spans.groupBy("bucket").applyInArrow(lean_group(union), _TEXT_SPANS)


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the text's two hashes, k1 and k2; what comes before the text seeds the second one."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumns({"k1": F.xxhash64(body), "k2": F.xxhash64(F.lit("second"), body)})


def spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """k1, k2 and the repeated byte runs of every text that has some."""
    small_batches(documents.sparkSession)
    docs = keyed(documents.select(F.col(text).cast("string").alias("text")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(256, -(-size // BUCKET_BYTES))
    found = _repeats(_occurrences(docs, _recurring(docs, buckets, size)), buckets)
    return materialize(_merge(found), "repeated-spans")


def _texts_with_spans(runs: DataFrame) -> np.ndarray:
    """A filter of the texts that have spans, TEXT_BITS bits however many there are; built by an aggregation."""
    place = F.pmod("k1", F.lit(TEXT_BITS))
    bits = runs.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(k1, {TEXT_BITS}) & 63 as int))").alias("bit"))
    words = np.zeros(TEXT_BITS // 64, dtype=np.int64)
    for row in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        words[row.word] = row.bits
    return words


def _may_have(words: np.ndarray, k1: np.ndarray) -> np.ndarray:
    place = np.mod(k1, TEXT_BITS)
    return (words[place >> 6] >> (place & 63)) & 1 == 1


def _cut(data: bytes, runs: bytes | None) -> tuple[bytes, int, int]:
    """What is left, the bytes removed, and the number of maximal runs."""
    if not runs:
        return data, 0, 0
    pairs = np.frombuffer(runs, dtype="<i8").reshape(-1, 2).tolist()
    kept, at = [], 0
    for a, b in pairs:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    left = b"".join(kept)
    return left, len(data) - len(left), len(pairs)


def remove(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept_sha256, and leaves in the text column what is kept.

    Only texts that may have spans meet these in a join; the others keep their text where they are.
    """
    import pyarrow as pa

    own = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    keep = [f for f in documents.schema.fields if f.name not in (text, "k1", "k2", "spans", *(n for n, _ in own))]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(text, T.StringType()), *(T.StructField(n, t) for n, t in own)])
    runs = spans(documents, text)
    docs = keyed(documents.select(*names, text), text)
    shared = documents.sparkSession.sparkContext.broadcast(_texts_with_spans(runs))

    def cut_batch(batch):
        texts, removed = batch.column(text).to_pylist(), batch.column("spans").to_pylist()
        cut = [(t, *_cut((t or "").encode("utf-8", "surrogatepass"), r)) for t, r in zip(texts, removed, strict=True)]
        made = [
            pa.array([t if not n else left.decode("utf-8", "ignore") for t, left, n, _ in cut], pa.string()),
            pa.array([len(left) + n for _, left, n, _ in cut], pa.int64()),
            pa.array([n for _, _, n, _ in cut], pa.int64()),
            pa.array([s for *_, s in cut], pa.int64()),
            pa.array([hashlib.sha256(left).hexdigest() for _, left, _, _ in cut], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=schema.names)

    def whole(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~_may_have(shared.value, batch.column("k1").to_numpy())))
            if batch.num_rows:
                yield cut_batch(batch.append_column("spans", pa.nulls(batch.num_rows, pa.binary())))

    def some(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_may_have(shared.value, batch.column("k1").to_numpy())))
            if batch.num_rows:
                yield batch

    def cut(batches):
        yield from map(cut_batch, batches)

    # written, so that no task runs Python on both sides of the join and needs two workers
    marked = materialize(docs.mapInArrow(lean(some), docs.schema), "texts-with-spans")
    shuffled = marked.join(runs, ["k1", "k2"], "left").select(*names, text, "spans")
    return docs.mapInArrow(lean(whole), schema).unionAll(shuffled.mapInArrow(lean(cut), schema))
