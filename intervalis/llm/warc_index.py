"""WARC archives with a two-level capture index.

Every page becomes one gzip member of an archive: a response with its payload, or a revisit that refers to the response
with the same payload. The index sorts captures by reversed-host URL key and page_id into compressed blocks of lines; a sparse
directory has the first key and the place of each block. A lookup binary-searches the directory, reads one block by range,
binary-searches its lines, and reads one record by range.

The directory lies beside the blocks in one file for each part of the index, so a task of many sorted lookups holds the
directory of one part at a time. Which part a key is in comes from a broadcast table with one row for each part, that is for
each archive of up to ``ARCHIVE_BYTES`` of pages.

Archives and blocks are written by executors to a folder that all share, under a temporary name first and then renamed.
Rows are sorted before they are written and nothing in a record depends on time or chance, so a repeated task writes the same
bytes, puts its file in the place of the earlier one, and the places in the index stay right.

Defined results: a null html is an empty payload, a null url has the key ``-``. Only payloads of ``REVISIT_BYTES`` or more are
compared. Rows with the same page_id and payload as the response are responses too; a null page_id is always a response.
Repeated rows are captures of their own. A very long page is one record, held whole by the task that writes or reads it.
Other columns are dropped. An empty table gives no archives, an empty directory and no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, shared_dir, small_batches

REVISIT_BYTES = 1000
BLOCK_LINES = 3000
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

CAPTURES = T.StructType(
    [
        T.StructField("surt", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
    ]
)
DIRECTORY = T.StructType(
    [
        T.StructField("first_key", T.StringType()),
        T.StructField("first_page", T.LongType()),
        T.StructField("block_file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("lines", T.LongType()),
        T.StructField("part_file", T.StringType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def surt(url: str | None) -> str:
    """Reversed host, then path and query: http://www.Example.com:80/a?b=1#c gives com,example,www)/a?b=1."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "-" + "".join(url.split())
    head = ",".join(reversed(host.split(".")))
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        head += f":{port}"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return "".join(f"{head}){parts.path or '/'}{query}".split())


def decide(pages: DataFrame, archives: int) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of every page, dealt by page_id into archives.

    The largest page_id of each digest comes from an aggregation that combines before its shuffle; html moves once, keyed by
    page_id, so a payload that a third of all pages share makes no hot task, nor do pages without an id.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = rows.where((F.length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("refers_to > least")
    revisits = keys.join(groups, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    dealt = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("null "), F.sha1(F.coalesce(F.col("url"), F.lit(""))), F.col("digest")))
    revisits = revisits.groupBy(F.col("page_id").cast("string").alias("dealt")).agg(F.map_from_entries(F.collect_list(F.struct("digest", "refers_to"))).alias("referred"))
    joined = rows.withColumn("dealt", dealt).repartition(archives, "dealt").join(revisits, "dealt", "left").withColumn("refers_to", F.col("referred")[F.col("digest")])
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return joined.select("page_id", "url", "payload", "digest", kind.alias("record_type"), "refers_to")


def _header(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Target-URI: {_header(url or '-')}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record; ValueError if it is damaged."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(headers["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if headers["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if headers["WARC-Payload-Digest"] != f"sha1:{digest}" or len(payload) != int(fields["Content-Length"]):
            raise ValueError("the payload's digest or length does not match")
    return headers, fields, payload


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _store(folder: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(folder)


class _Writer:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, base = _store(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temporary = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out, self.at = self.fs.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> tuple[int, int]:
        place = self.at, len(data)
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        import pyarrow.fs as pafs

        self.out.close()
        if self.fs.get_file_info(self.final).type == pafs.FileType.File:  # of an earlier attempt, with the same bytes
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their captures; each holds one partition of the records, sorted."""
    import pyarrow as pa

    small_batches(records.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        name, out = f"archive-{TaskContext.get().partitionId():06d}.warc.gz", None
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                out = out or _Writer(folder, name)
                offset, length = out.write(_member(record(*row)))
                rows.append((surt(row[1]), row[0], row[1], name, offset, length, row[3], row[4]))
            if rows:
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=CAPTURES.names)
        if out:
            out.close()

    dealt = records.sortWithinPartitions("page_id", "digest", "url")
    return materialize(dealt.mapInArrow(lean(run), CAPTURES), "captures")


def _key(surt_key: str, page_id: int | None) -> tuple[str, int]:
    """The order of the index: by key, then by page_id, null first."""
    return surt_key, -(1 << 63) - 1 if page_id is None else page_id


def build_index(captures: DataFrame, folder: str, parts: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures by key into compressed blocks and returns the sparse directory; each part's also lies beside its blocks."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        part = f"index-{TaskContext.get().partitionId():06d}"
        out, lines, entries = None, [], []

        def flush():
            offset, length = out.write(zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass")))
            first = lines[0].split(" ", 2)
            entries.append((first[0], None if first[1] == "-" else int(first[1]), f"{part}.gz", offset, length, len(lines), f"{part}.directory"))
            lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("surt", "page_id", "archive", "offset", "length", "digest", "record_type")), strict=True):
                out = out or _Writer(folder, f"{part}.gz")
                lines.append(" ".join("-" if v is None else str(v) for v in row))
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            beside = _Writer(folder, f"{part}.directory")
            beside.write(zlib.compress(json.dumps([e[:6] for e in entries]).encode()))
            beside.close()
        if entries:
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries, strict=True), types, strict=True)], names=DIRECTORY.names)

    keys = ["surt", "page_id", "archive", "offset"]
    dealt = captures.select(*keys, "length", "digest", "record_type").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return materialize(dealt.mapInArrow(lean(run), DIRECTORY), "directory")


class Reader:
    """Ranges of the files of one folder; a few stay open."""

    def __init__(self, folder: str):
        self.fs, self.base = _store(folder)
        self.files: dict = {}

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.files[name].read_at(length, offset)

    def whole(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            return f.read()

    def close(self) -> None:
        for f in self.files.values():
            f.close()


class Index:
    """Lookups by two binary searches: over the directory of a part, then over the lines of a block.

    parts: first key, first page_id and directory file of each part of the index, in order. One part's directory and one
    block are held at a time, so many lookups in the order of keys read each block once.
    """

    def __init__(self, parts: list[tuple[str, int | None, str]], folder: str):
        self.parts = sorted((_key(k, p), name) for k, p, name in parts)
        self.starts = [start for start, _ in self.parts]
        self.reader = Reader(folder)
        self._part = self._block = (None, None)

    def _directory(self, part: int):
        if self._part[0] != part:
            entries = json.loads(zlib.decompress(self.reader.whole(self.parts[part][1])))
            self._part = part, ([_key(e[0], e[1]) for e in entries], entries)
        return self._part[1]

    def _lines(self, name: str, offset: int, length: int):
        if self._block[0] != (name, offset):
            lines = [line.split(" ") for line in zlib.decompress(self.reader.range(name, offset, length)).decode("utf-8", "surrogatepass").split("\n")]
            self._block = (name, offset), ([_key(x[0], None if x[1] == "-" else int(x[1])) for x in lines], lines)
        return self._block[1]

    def lines(self, low: tuple[str, int], high: tuple[str, int]) -> list[list[str]]:
        """The index's lines from low to high, both included."""
        found = []
        part = max(0, bisect.bisect_left(self.starts, low) - 1)
        while part < len(self.parts) and self.starts[part] <= high:
            firsts, entries = self._directory(part)
            block = max(0, bisect.bisect_left(firsts, low) - 1)
            while block < len(entries) and firsts[block] <= high:
                _, _, name, offset, length, _ = entries[block]
                keys, lines = self._lines(name, offset, length)
                found += lines[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)]
                block += 1
            part += 1
        return found

    def captures(self, url: str) -> list[list[str]]:
        """Lines of all captures of a URL."""
        key = surt(url)
        return self.lines(_key(key, None), (key, 1 << 63))

    def fetch(self, line: list[str]) -> tuple[dict[str, str], dict[str, str], bytes]:
        """WARC headers, HTTP headers and payload (empty for a revisit) of the record that a line of the index points to."""
        return parse(zlib.decompress(self.reader.range(line[2], int(line[3]), int(line[4])), 31))


def index_parts(directory: DataFrame) -> list[tuple[str, int | None, str]]:
    """What Index needs of a directory: a row for each part, however many blocks it has."""
    first = directory.groupBy("part_file").agg(F.min(F.struct("first_key", "first_page")).alias("low"))
    return [(r.low.first_key, r.low.first_page, r.part_file) for r in first.toLocalIterator()]


_WANTED = T.StructType([T.StructField("surt", T.StringType()), T.StructField("page_id", T.LongType())])


def look_up(wanted: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """The records of all captures of the wanted pages (url, page_id): found by binary search, read by range, verified.

    Lookups are dealt out and sorted as the index is, page_id included, so a URL that very many pages have is spread over
    tasks. A page that is asked for several times is looked up once.
    """
    import pyarrow as pa

    parts = index_parts(directory)
    shared = wanted.sparkSession.sparkContext.broadcast(parts)
    tasks = max(1, len(parts), int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], names=_WANTED.names)

    def run(batches):
        index, before = Index(shared.value, folder), None
        number = lambda headers, key: int(headers[key]) if key in headers else None
        for batch in batches:
            lines, rows = [], []
            for key in map(_key, *(batch.column(c).to_pylist() for c in _WANTED.names)):
                if key != before:
                    lines += index.lines(key, key)
                before = key
            for line in sorted(lines, key=lambda x: (x[2], int(x[3]))):  # in the order of the archives
                headers, fields, _ = index.fetch(line)
                found = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                page = number(headers, "X-Page-ID")
                if [found, headers["WARC-Type"], "-" if page is None else str(page)] != [line[5], line[6], line[1]]:
                    raise ValueError("index and archive disagree")
                rows.append((page, int(fields["Content-Length"]), found, line[6], number(headers, "X-Refers-To-Page-ID")))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=RECORDS.names)
        index.reader.close()

    asked = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("bigint").alias("page_id")).mapInArrow(lean(keys), _WANTED)
    dealt = asked.repartitionByRange(tasks, *_WANTED.names).sortWithinPartitions(*_WANTED.names)
    return dealt.mapInArrow(lean(run), RECORDS)


def archive(pages: DataFrame, folder: str | None = None, archives: int | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Writes archives and index of all pages; returns captures, directory and the folder."""
    spark: SparkSession = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    if archives is None:
        size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        archives = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ARCHIVE_BYTES))
    captures = write_archives(decide(pages, archives), folder)
    return captures, build_index(captures, folder, archives), folder


__all__ = ["Index", "archive", "build_index", "decide", "index_parts", "look_up", "parse", "record", "surt", "write_archives"]
