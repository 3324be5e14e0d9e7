"""WARC 1.1 archives as a Python data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans one partition for each group of files. Predicates on the record type and on header columns
are pushed down: a record's WARC header is parsed first, and where it is refused the block is passed over,
in compressed archives of this writer without inflating it (each gzip member carries its own length in an
extra field of this writer's); foreign members are inflated and thrown away. Payloads are only decoded when asked for.

Writing gives one or more archives a task, each record a gzip member of its own. Files of failed or repeated
attempts are never read: the driver's commit writes a manifest that names the files of the attempts that count, one a job;
the files of all manifests are the archive. Overwriting removes what earlier jobs wrote, once its own manifest is there.

Files are opened through pyarrow's file systems, so any URI those know will do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from lattice.llm.common import columns_only, lookup, new_path, ship, staged, text_of

#: Columns of the read schema, and the WARC header each is read from.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"
ROLL_BYTES = 64 << 20  # an archive is closed at this size
_HEAD = 1 << 14
_PAGE = "urn:lattice:page:"
_LENGTHS = b"lt"  # the gzip subfield that holds a member's length and its data's, 64 bits each


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """One gzip member with its whole length and the data's in an extra field."""
    co = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = co.compress(data) + co.flush()
    extra = _LENGTHS + struct.pack("<HQQ", 16, 12 + 20 + len(body) + 8, len(data))
    return struct.pack("<BBBBIBBH", 31, 139, 8, 4, 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return quote(value, safe="".join(map(chr, range(33, 127))))


def record(kind: str, record_id: str, date: str, block: bytes, uri: str | None = None, **more: str) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    head.append(f"Content-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, head_id: int | None, head_url: str | None, date: str) -> bytes:
    """A response, or where head_id is given a revisit of that page's response."""
    me = f"{_PAGE}{'' if page_id is None else page_id}"
    if head_id is None:
        return record("response", me, date, http_head(len(payload)) + payload, url, WARC_Payload_Digest=f"sha1:{digest}", Content_Type="application/http; msgtype=response")
    more = {} if head_url is None else {"WARC_Refers_To_Target_URI": _clean(head_url)}
    return record("revisit", me, date, http_head(len(payload)), url, WARC_Payload_Digest=f"sha1:{digest}", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{_PAGE}{head_id}>", **more, Content_Type="application/http; msgtype=response")


def page_id(record_id: str | None) -> int | None:
    at = (record_id or "").removeprefix(_PAGE)
    return int(at) if re.fullmatch(r"-?\d+", at) else None


def _manifests(fs, base: str) -> dict[str, list[str]]:
    """The archives that each job wrote, by manifest."""
    from pyarrow.fs import FileSelector

    out = {}
    for i in fs.get_file_info(FileSelector(base)):
        if re.fullmatch(r"_manifest(-\w+)?\.json", i.base_name):
            with fs.open_input_stream(f"{base}/{i.base_name}") as f:
                out[i.base_name] = json.loads(f.read())
    return out


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, payload, digest, refers_to, refers_to_url) to archives."""

    def __init__(self, path: str, date: str, roll: int, overwrite: bool = False):
        self.path, self.date, self.roll, self.overwrite = path, date, roll, overwrite

    def write(self, iterator) -> _Files:
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for b in iterator:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_to_url")), strict=True):
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    size += out.write(gzip_member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", self.date, b"software: lattice\r\nformat: WARC File Format 1.1\r\n", Content_Type="application/warc-fields")))
                size += out.write(gzip_member(page_record(*row, self.date)))
        if out is not None:
            out.close()
        return _Files(names)

    def commit(self, messages: list[_Files | None]) -> None:
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        before = _manifests(fs, base) if self.overwrite else {}
        with fs.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        for manifest, names in before.items():
            fs.delete_file(f"{base}/{manifest}")
            for n in names:
                fs.delete_file(f"{base}/{n}")

    def abort(self, messages: list[_Files | None]) -> None:
        fs, base = _filesystem(self.path)
        for m in messages:
            for n in m.names if m else ():
                fs.delete_file(f"{base}/{n}")


@dataclass
class _Archives(InputPartition):
    names: tuple[str, ...]


class _Source:
    """Bytes of an archive, read ahead and skipped."""

    def __init__(self, f, chunk: int = 1 << 20):
        self.f, self.chunk, self.buf, self.at = f, chunk, b"", 0

    def need(self, n: int) -> bool:
        """Whether n bytes are at hand, after reading."""
        while len(self.buf) - self.at < n:
            more = self.f.read(max(self.chunk, n - (len(self.buf) - self.at)))
            if not more:
                return False
            self.buf, self.at = self.buf[self.at :] + more, 0
        return True

    def take(self, n: int) -> bytes:
        self.need(n)
        out = self.buf[self.at : self.at + n]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        have = len(self.buf) - self.at
        if n <= have:
            self.at += n
        else:
            self.f.seek(self.f.tell() + n - have)
            self.buf, self.at = b"", 0


class _Member:
    """The data of one gzip member, inflated as far as it is asked for."""

    def __init__(self, source: _Source):
        self.source, self.length = source, None
        self.used = 0
        if source.need(12) and source.buf[source.at + 3] & 4:
            extra = struct.unpack_from("<H", source.buf, source.at + 10)[0]
            source.need(12 + extra)
            at, end = source.at + 12, min(source.at + 12 + extra, len(source.buf))
            while at + 4 <= end:
                name, size = source.buf[at : at + 2], struct.unpack_from("<H", source.buf, at + 2)[0]
                if name == _LENGTHS and size == 16 and at + 20 <= end:
                    self.length = struct.unpack_from("<Q", source.buf, at + 4)[0]
                at += 4 + size
        self.z, self.data = zlib.decompressobj(31), b""

    def upto(self, n: int) -> bytes:
        while len(self.data) < n and not self.z.eof:
            tail = self.z.unconsumed_tail
            if not tail:
                s = self.source
                if not s.need(1):
                    break
                end = len(s.buf) if self.length is None else min(len(s.buf), s.at + self.length - self.used)
                tail, s.at = s.buf[s.at : end], end
                self.used += len(tail)
            self.data += self.z.decompress(tail, n - len(self.data))
        return self.data

    def close(self) -> None:
        s = self.source
        if self.length is not None:
            s.skip(self.length - self.used)
            return
        while not self.z.eof:
            tail = self.z.unconsumed_tail
            if not tail:
                if not s.need(1):
                    return
                tail, s.at = s.buf[s.at :], len(s.buf)
            self.z.decompress(tail, 1 << 20)
        left = self.z.unused_data
        s.buf, s.at = left + s.buf[s.at :], 0


class _Plain:
    """A record of an archive that isn't compressed."""

    def __init__(self, source: _Source):
        self.source, self.length = source, None

    def upto(self, n: int) -> bytes:
        self.source.need(n)
        return self.source.buf[self.source.at : self.source.at + n]

    def close(self) -> None:
        self.source.skip(self.length or 0)


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).split(b"\n")
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}


def read_records(f, gz: bool, wanted, payload: str) -> Iterator[tuple]:
    """Rows of SCHEMA for the records whose header columns `wanted` accepts. payload: none, verify or bytes."""
    source = _Source(f)
    while source.need(1):
        if not gz:
            while source.need(1) and source.buf[source.at : source.at + 1] in b"\r\n":
                source.skip(1)
            if not source.need(1):
                return
        part = _Member(source) if gz else _Plain(source)
        n = _HEAD
        while (end := (data := part.upto(n)).find(b"\r\n\r\n")) < 0 and len(data) >= n:
            n *= 2
        if end < 0:
            if data.strip():
                raise ValueError("a WARC record without the end of its header")
            return
        fields = _fields(data[:end])
        begin, size = end + 4, int(fields.get("content-length", 0))
        if not gz:
            part.length = begin + size
        row = {c: fields.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
        if wanted(row):
            length, ok, body = size, None, None
            is_http = fields.get("content-type", "").startswith("application/http")
            start = 0
            if is_http:
                n = _HEAD
                while (end := (data := part.upto(min(n, begin + size))).find(b"\r\n\r\n", begin)) < 0 and len(data) < begin + size:
                    n *= 2
                start = end + 4 - begin if end >= 0 else size
                declared = _fields(data[begin : begin + start]).get("content-length")
                length = int(declared) if declared else size - start
            if payload != "none" and row["record_type"] != "revisit":
                body = part.upto(begin + size)[begin + start : begin + size]
                ok = row["payload_digest"] is None or (len(body) == length and sha1_base32(body) == row["payload_digest"])
            yield (*row.values(), length, ok, body if payload == "bytes" else None)
        part.close()


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str, split: int):
        self.path, self.payload, self.split = path, payload, split
        self.filters: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in HEADERS or not isinstance(f, EqualTo | In | IsNotNull | StringStartsWith):
                yield f
            elif isinstance(f, IsNotNull):
                self.filters.append((column, "some", ()))
            elif isinstance(f, StringStartsWith):
                self.filters.append((column, "starts", (f.value,)))
            else:
                self.filters.append((column, "in", tuple(f.value) if isinstance(f, In) else (f.value,)))

    def partitions(self) -> list[_Archives]:
        from pyarrow.fs import FileSelector

        fs, base = _filesystem(self.path)
        there = {i.base_name: i.size or 0 for i in fs.get_file_info(FileSelector(base)) if re.search(r"\.warc(\.gz)?$", i.base_name)}
        if manifests := _manifests(fs, base):
            there = {n: there[n] for names in manifests.values() for n in names}
        out, names, size = [], [], 0
        for n in sorted(there):
            if names and size + there[n] > self.split:
                out.append(_Archives(tuple(names)))
                names, size = [], 0
            names.append(n)
            size += there[n]
        return [*out, _Archives(tuple(names))]

    def _wanted(self, row: dict) -> bool:
        for c, kind, values in self.filters:
            v = row[c]
            if v is None or kind == "in" and v not in values or kind == "starts" and not v.startswith(values[0]):
                return False
        return True

    def read(self, partition: _Archives):
        import pyarrow as pa

        fs, base = _filesystem(self.path)
        types = [pa.string()] * 6 + [pa.int64(), pa.bool_(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(f"{base}/{name}") as f:
                for r in read_records(f, name.endswith(".gz"), self._wanted, self.payload):
                    rows.append(r)
                    size += 200 + len(r[-1] or b"")
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


class WarcDataSource(DataSource):
    """Options: path; payload (none, verify or bytes; none by default); splitBytes; date; rollBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "none"), int(self.options.get("splitBytes", 16 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("rollBytes", ROLL_BYTES)), overwrite)


def _register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_of_hex(hex40):
    """Upper-case base 32 of a SHA-1 in hex: every five hex digits are four of base 32."""
    digits = [F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(spark: SparkSession, pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archive pages (page_id, url, html); equal payloads of at least min_bytes become revisits of one response.

    Of equal payloads the row with the largest page_id is the response; rows that repeat that id with that
    payload are responses too, and so is a row without an id. Null html is an empty payload. The table of
    repeated digests is aggregated first; pages then find theirs by a lookup in which hot digests are broadcast.
    """
    _register(spark)
    rows = columns_only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").cast("binary").alias("payload"))
    rows = rows.withColumn("digest", base32_of_hex(F.sha1("payload")))
    long_enough = F.octet_length("payload") >= min_bytes
    heads = rows.where(long_enough & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("head"), F.count(F.lit(1)).alias("n"))
    heads = staged(spark, heads.where("n > 1").select("digest", F.col("head.page_id").alias("head_id"), F.col("head.url").alias("head_url"), "n"), "warc-heads")
    found = lookup(rows, heads, "digest", "n")
    again = long_enough & (F.col("page_id") != F.col("head_id"))
    found = found.select("page_id", "url", "payload", "digest", F.when(again, F.col("head_id")).alias("refers_to"), F.when(again, F.col("head_url")).alias("refers_to_url"))
    found.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: str = "none") -> DataFrame:
    _register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive the pages and read responses and revisits back; payloads of responses are checked against their digests."""
    path = new_path(spark, "warc")
    write_pages(spark, pages, path)
    number = lambda c: F.regexp_extract(c, rf"^{_PAGE}(-?\d+)$", 1)
    whole = lambda c: F.when(number(c) != "", number(c).cast("long"))
    out = read(spark, path, "verify").where(F.col("record_type").isin("response", "revisit"))
    return out.select(whole("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", whole("refers_to").alias("refers_to"), F.coalesce("digest_ok", F.lit(True)).alias("digest_ok"))


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages
), h AS (SELECT hex, max(page_id) AS head FROM p GROUP BY hex
), d AS (
  SELECT page_id, payload_bytes, head,
         list_aggregate(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(hex, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT + 1, 1)),
           'string_agg', '') AS payload_digest
  FROM p JOIN h USING (hex)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to, TRUE AS digest_ok
FROM d
"""
