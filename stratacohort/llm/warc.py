"""WARC archives as a Python data source, "warc".

Writing: each task writes .warc.gz files of at most `max_file_bytes`, a gzip member per record, whose header's extra field holds the
member's length (subfield "sl"), so that a reader can step over it without inflating it.  File names are unique
to a task attempt; the commit writes a manifest of the files that count, so retried and speculative tasks leave no records.

Reading: one partition per file (files are bounded by the writer).  Predicates on record type and headers are pushed down (=, IN,
starts-with, IS [NOT] NULL on record_type, record_id, target_uri, payload_digest, refers_to).  A record's headers are
parsed first; its payload is inflated only if the record passes and `payload` is among the columns asked for.  A head of HTTP is taken
off records of HTTP messages; of others (conversion, resource, metadata, warcinfo) the payload is the whole block.  A gzip member may hold any number
of records; only one that says that it ends with its record is stepped over.

Files are opened with Arrow's file systems (local, HDFS, S3, GCS), in a folder that driver and executors share.

`dedup` marks, of records with equal payloads of `min_bytes` or more, the one with the smallest id as response and
the others as revisits of it; equal payloads meet by digest, counted before the shuffle.  Digests and ids alone are shuffled: the digests
that occur more than once are broadcast if they have at most `max_bytes`.  Beyond that a bit table of them is, of 2 ** FILTER_BITS bits
whatever their number: records whose bit is not set stay where they are, and only the payloads of the others move, in one join.

Edge cases: a null payload is written as an empty one; a null URL as no header, read as null; a null id as the id "null"; control
characters and spaces in a URL are percent-encoded; repeated rows are records of their own; an empty table gives an archive
without records; a truncated last record raises an error; extra columns are not archived.
"""
from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import written

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, http_length bigint, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that come from headers.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
MANIFEST = "_manifest.json"
#: Bytes of repeated digests that are broadcast, and about what each takes.
MAX_BYTES, MARK_BYTES = 64 << 20, 150
FILTER_BITS = 27
BATCH_BYTES = 4 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _header(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(row: dict, date: str) -> bytes:
    """The bytes of one record, not compressed."""
    payload = row["payload"] or b""
    length = row["http_length"] if row["http_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{_header(row['record_id'] or 'null')}>"), ("WARC-Date", date)]
    if row["target_uri"] is not None:
        head.append(("WARC-Target-URI", _header(row["target_uri"])))
    if row["payload_digest"] is not None:
        head.append(("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"))
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_header(row['refers_to'] or 'null')}>")]
        payload = b""
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose header says how long the member is, compressed and not."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Records:
    """Records of one file, one after the other: headers first, the block on demand."""

    def __init__(self, stream, step: int = 1 << 16):
        self.stream, self.step = stream, step
        self.raw = b""  # read from the file and not yet used

    def _need(self, n: int) -> bool:
        while len(self.raw) < n:
            more = self.stream.read(max(self.step, n - len(self.raw)))
            if not more:
                return False
            self.raw += more
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], "Records"]]:
        self.zipped, self.ended, self.text = False, True, b""
        while True:
            if not self.zipped or self.ended and not self.text.strip(b"\r\n"):  # else a member holds more than one record
                if not self._need(1):
                    break
                self.zipped = self._need(2) and self.raw[:2] == b"\x1f\x8b"
                self.length, self.whole = self._length() if self.zipped else (None, None)
                self.used, self.text, self.ended, self.first = 0, b"", False, True
                self.inflate = zlib.decompressobj(31) if self.zipped else None
            while b"\r\n\r\n" not in self.text.lstrip(b"\r\n") and self._more():
                pass
            before = len(self.text)
            self.text = self.text.lstrip(b"\r\n")
            if not self.text:
                if self.zipped and self.ended:
                    continue
                if self.zipped:
                    raise ValueError("a record is cut off")
                break
            head, found, self.text = self.text.partition(b"\r\n\r\n")
            if not found:
                raise ValueError("a record is cut off")
            lines = head.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            self.left = int(headers["content-length"])
            # The member ends with this record, if it says how long it is.
            self.single = self.first and self.whole == (before - len(self.text) + self.left + 4) & 0xFFFFFFFF
            self.wanted = self.first = False
            yield headers, self
            if not self.wanted:
                self._skip()

    def _length(self) -> tuple[int | None, int | None]:
        """The length of a member, compressed and not, where its header tells."""
        if not self._need(24) or not self.raw[3] & 4 or self.raw[12:14] != b"sl":
            return None, None
        return struct.unpack("<II", self.raw[16:24])

    def _more(self, most: int = 1 << 14) -> bool:
        """Take or inflate another piece of this record, of `most` bytes at most."""
        if self.ended:
            return False
        some = self._need(1)
        piece, rest = self.raw[: self.step], self.raw[self.step :]
        if not self.zipped:
            self.text, self.raw = self.text + piece[:most], piece[most:] + rest
            return some
        found = self.inflate.decompress(piece, most)
        left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.used += len(piece) - len(left)
        self.text, self.raw, self.ended = self.text + found, left + rest, self.inflate.eof
        return some or bool(found)

    def block(self) -> bytes:
        """The record's block; the record is used up then."""
        self.wanted = True
        parts, have = [self.text], len(self.text)
        while have < self.left + 4:
            self.text = b""
            if not self._more(1 << 20):
                break
            parts.append(self.text)
            have += len(self.text)
        whole = b"".join(parts)
        if len(whole) < self.left:
            raise ValueError("a record is cut off")
        self._after(whole[self.left :])
        return whole[: self.left]

    def _after(self, rest: bytes) -> None:
        """Go on with what follows the block."""
        if self.zipped:
            self.text = rest
        else:
            self.text, self.raw = b"", rest + self.raw

    def _skip(self) -> None:
        if self.single and not self.ended:  # step over the rest, still deflated
            left = self.length - self.used
            while left > 0 and self._need(1):
                n = min(left, len(self.raw))
                self.raw, left = self.raw[n:], left - n
            self.text, self.ended = b"", True
            return
        left = self.left - len(self.text)
        if left > 0 and not self.zipped:
            self.text = b""
            while left > 0 and self._need(1):
                n = min(left, len(self.raw))
                self.raw, left = self.raw[n:], left - n
        while left > 0:
            self.text = b""
            if not self._more(1 << 20):
                break
            left -= len(self.text)
        self._after(self.text[len(self.text) + left :] if left < 0 else b"")


def _clean(column: str, value: str | None) -> str | None:
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha256:") if column == "payload_digest" else value


def _payload(headers: dict[str, str], block: bytes) -> tuple[int | None, bytes]:
    """The length that an HTTP head gives, and what follows it; a block that is no HTTP message is the payload as a whole."""
    kind = headers.get("content-type", "").lower()
    if not kind.startswith("application/http") and (kind or not block.startswith(b"HTTP/")):
        return None, block
    head, _, body = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return int(found[1]) if found else None, body


def _passes(filters: list, row: dict) -> bool:
    for kind, column, value in filters:
        x = row[column]
        if kind == "null" and (x is None) != value or kind == "in" and x not in value or kind == "starts" and not (x or "").startswith(value):
            return False
        if kind in ("in", "starts") and x is None:
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.filters = path, names, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.filters.append(("in", column, (f.value,)))
            elif isinstance(f, In):
                self.filters.append(("in", column, tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.filters.append(("starts", column, f.value))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.filters.append(("null", column, isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [InputPartition(path)]
        if system.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{path}/{MANIFEST}") as f:
                names = json.loads(f.read())
            found = [f"{path}/{name}" for name in names]
        else:
            found = sorted(x.path for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if re.search(r"\.warc(\.gz)?$", x.path))
        return [InputPartition(x) for x in found] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        kinds = {"http_length": pa.int64(), "payload": pa.binary()}
        arrow = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        system, _ = _open(self.path)
        rows, size = [], 0
        with system.open_input_stream(partition.value, compression=None) as stream:
            for headers, at in Records(stream):
                row = {c: _clean(c, headers.get(h)) for c, h in HEADERS.items()}
                if not _passes(self.filters, row):
                    continue
                if "payload" in self.names or "http_length" in self.names:
                    length, body = _payload(headers, at.block())
                    row |= {"http_length": length, "payload": None if row["record_type"] == "revisit" else body}
                    size += len(body)
                rows.append(row)
                if size > BATCH_BYTES or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


class Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict):
        self.path, self.date = path, options.get("date", "1970-01-01T00:00:00Z")
        self.most, self.level = int(options.get("max_file_bytes", 128 << 20)), int(options.get("level", 6))

    def write(self, iterator):
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.most:
                        if out:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    data = member(record(row, self.date), self.level)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Files(names)

    def commit(self, messages):
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages):
        system, path = _open(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of an archive file or folder; without `payload` among the columns, payloads are stepped over."""
    register(spark)
    schema = T.StructType.fromDDL(SCHEMA)
    return spark.read.format("warc").schema(T.StructType([schema[c] for c in columns or schema.names])).load(path)


def write(records: DataFrame, path: str, **options) -> None:
    """Archive a DataFrame that has the columns of SCHEMA."""
    register(records.sparkSession)
    schema = T.StructType.fromDDL(SCHEMA)
    cols = [F.col(f.name).cast(f.dataType) for f in schema]
    records.select(*cols).write.format("warc").options(**{k: str(v) for k, v in options.items()}).mode("append").save(path)


def _in_bits(keys: DataFrame, n_bits: int) -> Column:
    """Whether the bit of the column `key` is set in a table of the bits of all keys, which is made on the executors."""
    at = F.shiftrightunsigned(F.xxhash64("key"), 64 - n_bits)
    bits = keys.select(F.shiftright(at, 6).alias("at"), at.alias("b"))
    bits = bits.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits")).toArrow()  # 2 ** (n_bits - 6) rows at most
    table = np.zeros(1 << (n_bits - 6), np.uint64)
    table[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def is_set(at: pd.Series) -> pd.Series:
        x = at.to_numpy().astype(np.uint64)
        return pd.Series((shared.value[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool))

    return is_set(at)


def dedup(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100, max_bytes: int = MAX_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Records of pages: equal payloads of min_bytes or more are kept once, by the smallest id."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("target_uri"), body.alias("body"))
    rows = rows.select("*", F.sha2("body", 256).alias("key"), F.octet_length("body").cast("long").alias("n"))
    firsts = rows.where(F.col("n") >= min_bytes).groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    firsts = written(firsts.where("copies > 1").select("key", "first"), "payloads")  # its join can then be split at a hot payload
    large = F.col("n") >= min_bytes
    if firsts.count() * MARK_BYTES <= max_bytes:
        out = rows.join(F.broadcast(firsts.withColumnRenamed("key", "__key")), large & (F.col("key") == F.col("__key")), "left")
    else:
        marked = rows.withColumn("maybe", large & _in_bits(firsts, filter_bits))
        once = marked.where(~F.col("maybe")).withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
        out = marked.where("maybe").join(firsts, "key", "left").unionByName(once)
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return out.select(
        uri(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.col("key").alias("payload_digest"),
        F.when(again, uri(F.col("first"))).alias("refers_to"), F.col("n").alias("http_length"), F.when(~again, F.encode("body", "UTF-8")).alias("payload"),
    )
