"""WARC archives: a Python data source that writes and reads them.

Writing.  Records are built by SQL expressions.  Of records with equal payloads of
at least ``min_bytes`` bytes the one with the largest id is a response and the
others are revisits that refer to it.  A task writes one archive, each record a
gzip member of its own whose header carries the member's length (an extra field
that other readers pass over).  The commit names the archives of the successful
tasks, with places where a reader may start, in a manifest written last; what a
lost task left behind is never read.

Reading.  ``WarcSource`` plans partitions of about ``maxFilesBytes`` bytes, ranges of
archives between the manifest's places; archives of others, without a manifest,
are planned by file.  It takes equality and IN predicates on record_type and on
header columns from the planner, inflates and parses the header block of a record
first, and seeks to the next member from there when the predicates drop the
record or its payload is not asked for (``payload=false``).  Plain archives are
read the same way by Content-Length; gzip members without a length are inflated
but not kept.

Defined cases: a null html is an empty payload; pages that repeat an id are each
written, and only one record of equal payloads is a response, also of rows equal
in all columns; a null id is written as an empty header and read back as null,
and counts as the smallest; a null url is empty; an empty table gives no records;
other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from glossmill.llm.common import hot_keys, materialize, small_batches, spread_join, table, work_path

CRLF = "\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_of_sha1(value: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8 bytes, as one expression."""
    digest = F.sha1(value)
    letters = []
    for part in range(8):
        bits = F.conv(F.substring(digest, 5 * part + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            index = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(_ALPHABET), index, F.lit(1)))
    return F.concat(*letters)


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every row.

    The winner of each digest comes from partial aggregations and is joined back,
    salted where very many pages share a payload, so no group is ever held.  Rows
    that equal a winner in all columns cannot be told apart: they are reduced to
    one and made anew, one of them the response.
    """
    known = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    known = known.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_of_sha1(F.col("payload"))}
    )
    same = known.groupBy("payload_digest", "page_id", "url").agg(F.count(F.lit(1)).alias("same"))
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "url", "same")
    best = same.groupBy("payload_digest").agg(F.max(order).alias("best"), F.sum("same").alias("rows"))
    best = materialize(best, "warc-best")
    hot = hot_keys(best.where("rows > 1"), "payload_digest", "rows")
    winners = best.select("payload_digest", "best")
    joined = spread_join(known, winners, "payload_digest", hot, ["page_id", "url"], "inner").select(*known.columns, "best")
    first = F.col("page_id").eqNullSafe(F.col("best.page_id")) & (F.col("url") == F.col("best.url"))
    if best.where("best.same > 1").limit(1).count():
        tied = joined.where(first & (F.col("best.same") > 1))
        alone = joined.where(~(first & (F.col("best.same") > 1))).withColumn("nth", F.lit(1).cast("long"))
        one = tied.dropDuplicates(["payload_digest", "page_id", "url"])
        joined = alone.unionByName(one.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("best.same")))))
        first = first & (F.col("nth") == 1)
    again = (F.col("payload_bytes") >= min_bytes) & ~first
    return joined.select(
        *known.columns,
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("best.page_id")).alias("refers_to"),
    )


def record_text(record_type: Column) -> Column:
    """A WARC/1.1 record, from the columns of ``classify``."""

    def line(name: str, value: Column | str) -> list[Column]:
        value = F.lit(value) if isinstance(value, str) else value
        return [F.lit(f"{name}: "), value, F.lit(CRLF)]

    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = record_type == "revisit"
    target = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        *line("WARC-Type", record_type),
        *line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        *line("WARC-Date", "1970-01-01T00:00:00Z"),
        *line("WARC-Target-URI", target),
        *line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        *line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                F.lit(profile + CRLF + "WARC-Refers-To: <urn:page:"),
                F.coalesce(F.col("refers_to").cast("string"), F.lit("")),
                F.lit(f">{CRLF}"),
            ),
        ).otherwise(F.lit("")),
        *line("Content-Type", "text/html; charset=utf-8"),
        *line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF),
        body,
        F.lit(CRLF * 2),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html) below ``path``; compression gzip or none."""
    small_batches(pages.sparkSession, 100)
    pages.sparkSession.dataSource.register(WarcSource)
    records = classify(pages, min_bytes).select(record_text(F.col("record_type")).alias("record"))
    records.write.format(WarcSource.name()).option("compression", compression).mode("append").save(path)


def _store(path: str):
    """(file system, folder) of a path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the archive files below a path, by name."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    plain = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f.path, f.size) for f in plain)


#: A gzip member's header of fixed size: no name or time, and an extra field "GL" with the length of the deflated part.
_MEMBER, _MEMBER_BYTES = "<4s4xBBH2sHQ", 24
_MAGIC, _FIELD = b"\x1f\x8b\x08\x04", b"GL"
MANIFEST = "_manifest"


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member that tells its length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    head = struct.pack(_MEMBER, _MAGIC, 0, 255, 12, _FIELD, 8, len(body))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    """An archive of one task: its name, bytes and places where a record starts."""

    name: str
    bytes: int
    starts: list[int]


class _Writer(DataSourceArrowWriter):
    """Archives of tasks, and the manifest that names them."""

    #: Bytes after which a place is noted where a reader may start.
    STEP = 4 << 20

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.plain = options.get("compression", "gzip") == "none"

    def write(self, iterator) -> _Written:
        store, root = _store(self.path)
        store.create_dir(root)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.warc" + ("" if self.plain else ".gz")
        at, starts = 0, [0]
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for record in batch.column(0):
                    data = record.as_py().encode()
                    if at - starts[-1] >= self.STEP:
                        starts.append(at)
                    at += out.write(data if self.plain else member(data))
        return _Written(name, at, starts)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            for m in messages:
                if m and m.bytes:
                    out.write((json.dumps({"name": m.name, "bytes": m.bytes, "starts": m.starts}) + "\n").encode())

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.name}")


def _ranges(path: str, most: int) -> list[list[tuple[str, int, int]]]:
    """Lists of (file, first byte, last byte) of about ``most`` bytes each."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root))
    manifests = sorted(f.path for f in found if f.base_name.startswith(MANIFEST))
    pieces = []
    for name in manifests:
        with store.open_input_stream(name) as lines:
            for line in lines.read().decode().splitlines():
                m = json.loads(line)
                for start, stop in zip(m["starts"], [*m["starts"][1:], m["bytes"]]):
                    pieces.append((f"{root}/{m['name']}", start, stop))
    if not manifests:
        pieces = [(name, 0, size) for name, size in _files(path)]
    parts: list[list[tuple[str, int, int]]] = []
    size = most
    for name, start, stop in pieces:
        if size + stop - start > most or not parts:
            parts.append([])
            size = 0
        held = parts[-1]
        if held and held[-1][0] == name and held[-1][2] == start:
            held[-1] = (name, held[-1][1], stop)
        else:
            held.append((name, start, stop))
        size += stop - start
    return parts


class _Buffered:
    """Lines, reads and skips over a file object, with one buffer."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.buffer, self.at = raw, size, b"", 0

    def tell(self) -> int:
        return self.raw.tell() - len(self.buffer) + self.at

    def _fill(self) -> bool:
        more = self.raw.read(self.size)
        self.buffer, self.at = self.buffer[self.at :] + more, 0
        return bool(more)

    def header(self) -> bytes | None:
        """The next header block without its blank line; None at the end of the file."""
        while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
            if not self._fill():
                if self.buffer[self.at :].strip():
                    raise ValueError("a WARC header block is cut short")
                return None
        out, self.at = self.buffer[self.at : end], end + 4
        return out

    def peek(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._fill():
            pass
        return self.buffer[self.at : self.at + n]

    def read(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self._fill():
                raise ValueError("a WARC payload is cut short")
        out, self.at = self.buffer[self.at : self.at + n], self.at + n
        return out

    def skip(self, n: int) -> None:
        held = len(self.buffer) - self.at
        if n <= held:
            self.at += n
            return
        self.buffer, self.at = b"", 0
        self.raw.seek(self.raw.tell() + n - held)


class _Plain:
    """Header blocks and payloads of records that lie one after another, up to a place."""

    def __init__(self, source: _Buffered, stop: int | None = None):
        self.source, self.stop = source, stop

    def header(self) -> bytes | None:
        if self.stop is not None and self.source.tell() >= self.stop:
            return None
        return self.source.header()

    def payload(self, n: int) -> bytes:
        body = self.source.read(n)
        self.source.skip(4)
        return body

    def skip(self, n: int) -> None:
        self.source.skip(n + 4)


class _Members:
    """The same of gzip members that tell their length: what is skipped is not inflated."""

    #: Bytes that are read and inflated at a time until the header block is whole.
    FIRST = 1 << 10

    def __init__(self, source: _Buffered, stop: int):
        self.source, self.stop = source, stop
        self.left, self.held, self.crc = 0, b"", 0

    def _more(self, n: int, most: int = 0) -> bytes:
        """What the next ``n`` deflated bytes inflate to, ``most`` bytes of it if that is not 0."""
        data = self.inflate.unconsumed_tail
        if not data or not most:
            fresh = self.source.read(min(n, self.left))
            self.left -= len(fresh)
            data += fresh
        out = self.inflate.decompress(data, most)
        self.crc = zlib.crc32(out, self.crc)
        return out

    def header(self) -> bytes | None:
        if self.source.tell() >= self.stop:
            return None
        magic, _, _, _, field, _, self.left = struct.unpack(_MEMBER, self.source.read(_MEMBER_BYTES))
        if magic != _MAGIC or field != _FIELD:
            raise ValueError("a gzip member without its length follows one with it")
        self.inflate, self.held, self.crc = zlib.decompressobj(-15), b"", 0
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.left and not self.inflate.unconsumed_tail:
                raise ValueError("a WARC header block is cut short")
            self.held += self._more(self.FIRST, self.FIRST)
        out, self.held = self.held[:end], self.held[end + 4 :]
        return out

    def payload(self, n: int) -> bytes:
        body = self.held + self._more(self.left)
        if self.crc != int.from_bytes(self.source.read(8)[:4], "little") or len(body) != n + 4:
            raise ValueError("a gzip member does not match its checksum or length")
        return body[:n]

    def skip(self, n: int) -> None:
        self.source.skip(self.left + 8)


def _opened(raw, name: str, start: int, stop: int):
    """The records of a range of an open archive."""
    raw.seek(start)
    if not name.endswith(".gz"):
        return _Plain(_Buffered(raw), stop)
    source = _Buffered(raw)
    head = source.peek(_MEMBER_BYTES)
    if len(head) == _MEMBER_BYTES and head[:4] == _MAGIC and head[12:14] == _FIELD:
        return _Members(source, stop)
    raw.seek(start)
    return _Plain(_Buffered(gzip.GzipFile(fileobj=raw)))


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def records(source: _Plain | _Members, keep, payload: bool, verify: bool) -> Iterator[tuple]:
    """Rows of one archive; ``keep`` decides on (type, headers) before a payload is touched."""
    while (block := source.header()) is not None:
        first, *lines = block.decode().lstrip("\r\n").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        row = {
            "page_id": _page(headers.get("warc-record-id")),
            "url": headers.get("warc-target-uri"),
            "record_type": headers.get("warc-type"),
            "payload_bytes": int(headers.get("x-payload-length", n)),
            "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:"),
            "refers_to": _page(headers.get("warc-refers-to")),
        }
        check = verify and row["record_type"] == "response"
        if not keep(row) or not (payload or check):
            source.skip(n)
            if keep(row):
                yield (*row.values(), None)
            continue
        body = source.payload(n)
        if check and base64.b32encode(hashlib.sha1(body).digest()).decode() != row["payload_digest"]:
            raise ValueError(f"the payload of page {row['page_id']} does not match its digest")
        yield (*row.values(), body if payload else None)


class _Part(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    COLUMNS = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.bytes = int(options.get("maxfilesbytes", options.get("maxFilesBytes", 64 << 20)))
        self.allowed: dict[str, list] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and IN on header columns; hand the rest back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.COLUMNS and isinstance(f, EqualTo):
                values = [f.value]
            elif name in self.COLUMNS and isinstance(f, In):
                values = list(f.value)
            else:
                yield f
                continue
            held = self.allowed.get(name)
            self.allowed[name] = [v for v in values if held is None or v in held]

    def partitions(self) -> list[InputPartition]:
        return [_Part(r) for r in _ranges(self.path, self.bytes)] or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        allowed = self.allowed

        def keep(row: dict) -> bool:
            return all(row[k] in v for k, v in allowed.items())

        store, _ = _store(self.path)
        for name, start, stop in partition.ranges:
            with store.open_input_file(name) as raw:
                yield from records(_opened(raw, name, start, stop), keep, self.payload, self.verify)


class WarcSource(DataSource):
    """``spark.read.format("glossmill_warc").load(path)``; options payload, verify, maxFilesBytes; on writing, compression."""

    @classmethod
    def name(cls) -> str:
        return "glossmill_warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def read_archives(spark, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records below ``path``; predicates on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("glossmill_warc").option("payload", str(payload)).option("verify", str(verify))
    return reader.load(path)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: write every page, then read the archives back.

    Responses are read with their payloads, which are held against their digests;
    of revisits, the second read, nothing but headers is inflated.
    """
    path = work_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    responses = read_archives(spark, path, payload=False, verify=True).where("record_type = 'response'")
    revisits = read_archives(spark, path, payload=False).where("record_type = 'revisit'")
    back = responses.unionAll(revisits)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hx FROM p),
m AS (SELECT hx, max(page_id) AS best FROM d GROUP BY 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + (((CAST(('0x' || substr(d.hx, 5 * CAST(i // 4 AS INTEGER) + 1, 5)) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)), 1), '' ORDER BY i)
        FROM range(32) AS r(i)) AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d JOIN m ON d.hx = m.hx
"""
