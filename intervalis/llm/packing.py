"""Packing of tokenized documents into fixed sequences by best-fit decreasing.

Each document becomes token ids and an end id. A document longer than a sequence is first cut into full windows; what is left
of it, and each shorter document, is one piece. Pieces are dealt by a hash into shards of about ``SHARD_DOCS`` documents. In
a shard they are placed by length, longest first, each into the open window with the least room that still holds it; a
segment tree over the remaining capacities finds that window. Shards do not depend on each other, so the work is linear in
the data, each task's memory is bounded, and only a shard's last windows stay underfull. Pieces that are equal in all columns
also have a running number, so that many equal rows do not meet in one shard.

Defined results: null and empty texts are the end id alone. A very long text is encoded whole and cut into many pieces.
Repeated rows are packed once each. A null doc_id is packed like
any other and comes back null. Ties of length are broken by doc_id, start and checksum. An empty table has no sequences.
Other columns of the input are dropped.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget_after, lean, lean_group, small_batches

CAPACITY = 4096
SHARD_DOCS = 4096
END_ID = 2
#: Parts of words whose ids a worker remembers; rarer ones are encoded again.
CACHE_PARTS = 300_000
CHUNK_CHARS = 2_000_000
#: Rows of which a task remembers how often it has met them.
REMEMBERED = 200_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)
_SALT = T.StructField("salt", T.LongType())
_caches: dict[str, tuple] = {}
forget_after(__name__, _caches.clear)
#: A word of Latin letters with ASCII punctuation behind it. The tokenizer cuts between the two and lowers the letters itself.
_PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
#: Parts of such words; each is a unit to the tokenizer, whatever stands beside it.
_SIMPLE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[!-&(-/:-@\\[-`{-~]+")
#: Control characters that Arrow takes for white space and the tokenizer does not.
_CONTROL = re.compile("[\x1c-\x1f]")


def _encoder(path: str):
    """The tokenizer, and the ids of word parts met so far (unsigned 32-bit), kept for a worker's life."""
    if path not in _caches:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _caches[path] = (Tokenizer.from_file(path), {"": b""})
    return _caches[path]


def _gather(flat: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat, one behind the other (lengths tells them apart), picked by index; and the picked runs' lengths."""
    starts, picked = np.cumsum(lengths) - lengths, lengths[index]
    shift = starts[index] - np.cumsum(picked) + picked
    return flat[np.repeat(shift, picked) + np.arange(picked.sum())], picked


def _joined_ids(tokenizer, parts: list[str]) -> list[bytes]:
    """The ids of each part, from one text that has a space between them: no token reaches over a space."""
    encoded = tokenizer.encode(" ".join(parts), add_special_tokens=False)
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
    ends = np.searchsorted([a for a, _ in encoded.offsets], begin)
    packed = np.array(encoded.ids, dtype="<u4").tobytes()
    return [packed[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _part_ids(parts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    tokenizer, known = _encoder(path)
    found = list(map(known.get, parts))
    missing = [i for i, f in enumerate(found) if f is None]
    plain = [i for i in missing if _SIMPLE.fullmatch(parts[i])]
    for some in (plain[at : at + 4096] for at in range(0, len(plain), 4096)):  # few at a time: the tokenizer's results are large
        for i, ids in zip(some, _joined_ids(tokenizer, [parts[i] for i in some]), strict=True):
            found[i] = ids
    odd = [i for i in missing if found[i] is None]
    for some in (odd[at : at + 4096] for at in range(0, len(odd), 4096)):
        for i, e in zip(some, tokenizer.encode_batch_fast([parts[i] for i in some], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, dtype="<u4").tobytes()
    known.update((parts[i], found[i]) for i in missing[: max(0, CACHE_PARTS - len(known))])
    return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4


def token_bytes(texts: list[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """Each text's ids and the end id, packed as unsigned 32-bit.

    The tokenizer splits at white space, so each distinct word of a batch is encoded once; letters and punctuation of a plain
    word are encoded apart, since the same parts recur in many words. Arrow does the splitting, numpy puts ids together.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    end = np.array([end_id], dtype="<u4").tobytes()
    odd = {i for i, t in enumerate(texts) if t and _CONTROL.search(t)}
    lists = pc.utf8_split_whitespace(pa.array(["" if not t or i in odd else t for i, t in enumerate(texts)], pa.large_string()))
    words = pc.list_flatten(lists).dictionary_encode()
    split = pc.extract_regex(words.dictionary, _PLAIN)
    letters = pc.if_else(split.is_valid(), pc.utf8_lower(pc.struct_field(split, "letters")), words.dictionary)
    marks = pc.if_else(split.is_valid(), pc.struct_field(split, "marks"), pa.scalar("", pa.large_string()))
    count = len(letters)
    parts = pa.concat_arrays([letters, marks]).dictionary_encode()
    flat, lengths = _part_ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), path)
    # a word is its letters and its marks
    index = parts.indices.to_numpy()
    flat, lengths = _gather(flat, lengths, np.stack([index[:count], index[count:]], 1).ravel())
    lengths = lengths.reshape(-1, 2).sum(1)
    flat, lengths = _gather(flat, lengths, words.indices.to_numpy())
    ends = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy()]
    out = [flat[a:b].tobytes() + end for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    tokenizer, _ = _encoder(path)
    for i in odd:
        out[i] = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes() + end
    return out


def _token_bytes_by_chunk(texts: list[str | None], path: str, end_id: int):
    """token_bytes of at most CHUNK_CHARS at a time, or of one text, to bound a worker's memory."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            yield from token_bytes(texts[first : i + 1], path, end_id)
            first, size = i + 1, 0


def cut(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: full windows of long documents, and what is left; with the ids themselves if keep_ids.

    The column salt counts the pieces of a task that are equal in all the other columns.
    """
    import pyarrow as pa

    small_batches(df.sparkSession, 1024)
    schema = T.StructType([*PIECES.fields, _SALT, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])

    def run(batches):
        met: dict[tuple, int] = {}
        for batch in batches:
            if len(met) > REMEMBERED:
                met.clear()
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for doc_id, ids in zip(doc_ids, _token_bytes_by_chunk(texts, tokenizer_path, end_id), strict=True):
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    crc = zlib.crc32(part)
                    key = doc_id, start, crc
                    met[key] = salt = met.get(key, -1) + 1
                    rows.append((doc_id, start, len(part) // 4, crc, total, salt, *([part] if keep_ids else [])))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.fields]
            types = [pa.int64()] * 6 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


class CapacityTree:
    """A segment tree over remaining capacities; each leaf holds the open windows with that much room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = self.width + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Removes and returns a window with the least room of at least ``need``, and that room."""
        count, node = self.count, self.width + need
        while not count[node]:
            while node & 1:  # a right child: what lies further right is beyond the parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.width:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self.width
        while node:
            count[node] -= 1
            node >>= 1
        return self.windows[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; lengths must not increase."""
    tree, windows, offsets, opened = CapacityTree(capacity), [], [], 0
    for length in lengths.tolist():
        found = tree.take_tightest(length)
        if found is None:
            found = (opened, capacity)
            opened += 1
        window, room = found
        windows.append(window)
        offsets.append(capacity - room)
        if room > length:
            tree.add(room - length, window)
    return np.array(windows, dtype=np.int64), np.array(offsets, dtype=np.int64)


def place(pieces: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces and drops salt. A sequence's id has its shard in the high bits.

    Equal rows, of which one may be a third of all, go to different shards by their salt.
    """
    import pyarrow as pa

    schema = T.StructType([*(f for f in pieces.schema.fields if f != _SALT), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key, rows):
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.drop_columns(["shard", "salt"]).sort_by(order)
        windows, offsets = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        ids = (key[0].as_py() << 40) + windows
        return rows.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(lean_group(pack), schema)


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset."""
    shards = max(1, -(-df.select(F.lit(1)).count() // SHARD_DOCS))  # a count reads no text
    return place(cut(df, tokenizer_path, capacity, end_id, keep_ids), shards, capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, padded with pad_id; needs pieces with their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    joined = F.concat_ws("", F.transform(ordered, lambda p: p["h"]))
    pad = F.lit(int(pad_id).to_bytes(4, "little").hex().upper())
    return packed.groupBy("sequence_id").agg(F.unhex(F.rpad(joined, 8 * capacity, pad)).alias("ids"))
