"""WARC archives as a Python data source, read and written by Spark.

Records lie in gzip members of their own. Each member names its packed and unpacked size in the extra
field of its gzip header (subfield ``sl``), so a reader unpacks only the first bytes of a record,
parses the header, and leaves out the rest of records that no predicate wants, or of all records when
payloads are not asked for (option ``payload`` false). Predicates on record type, id, digest and target
URI are pushed down. Files are planned into partitions by size. Writers leave files with temporary
names; only those of tasks that the driver commits get their own.

Columns: record_id, record_type, target_uri, date, digest (bare hex SHA-256 of the full payload),
refers_to, payload_bytes (of the full payload), payload (null for revisits and when not asked for).

Defined results: a null payload is written as empty, null header values are left out and read as null;
URIs are written as they are, but a record with CR or LF in a value has CR, LF and percent signs of its values
percent-encoded and says so in a field of its own; repeated rows are records of their own; an empty table
gives a folder with empty archives. Other writers' archives: field names are read in any case, digests
other than SHA-256 keep their prefix, of HTTP messages the payload is what follows the head, and members
without the extra field are unpacked whole.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from maskframe.llm import common

SCHEMA = "record_id string, record_type string, target_uri string, date string, digest string, refers_to string, payload_bytes long, payload binary"
#: Header fields of the columns.
_FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length",
}
_ESCAPED = "X-Escaped-Values"
_PUSHED = ("record_id", "record_type", "target_uri", "digest", "refers_to")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = 1 << 12
PARTITION_BYTES, FILE_BYTES, BATCH_BYTES = 64 << 20, 512 << 20, 8 << 20


def record(row: dict) -> bytes:
    """One record as a gzip member."""
    payload = row["payload"] or b""
    fields = {**row, "record_id": f"<{row['record_id']}>", "refers_to": row["refers_to"] and f"<{row['refers_to']}>", "digest": row["digest"] and f"sha256:{row['digest']}"}
    lines, values = ["WARC/1.1"], {name: str(fields[column]) for column, name in _FIELDS.items() if fields[column] is not None}
    if any("\r" in value or "\n" in value for value in values.values()):
        values = {name: value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") for name, value in values.items()}
        values[_ESCAPED] = "true"
    lines += [f"{name}: {value}" for name, value in values.items()]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {_REVISIT}")
    lines += [f"Content-Length: {len(payload)}", "", ""]
    raw = "\r\n".join(lines).encode() + payload + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw))
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def header(raw: bytes) -> tuple[dict, int] | None:
    """The columns of a record's header and where its block begins; None if the header goes on."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    found: dict[str, str] = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    row = {column: found.get(name.lower()) for column, name in _FIELDS.items()}
    if _ESCAPED.lower() in found:
        row = {column: value and value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") for column, value in row.items()}
    for column in ("record_id", "refers_to"):
        row[column] = row[column] and row[column].removeprefix("<").removesuffix(">")
    row["digest"] = row["digest"] and row["digest"].removeprefix("sha256:")
    row["length"] = int(found["content-length"])
    row["http"] = found.get("content-type", "").lower().startswith("application/http")
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else row["length"]
    return row, end + 4


def records(data: memoryview, wanted, payloads: bool) -> Iterator[dict]:
    """The records of an archive that ``wanted`` (a test of the header's columns) lets through."""
    at = 0
    while at < len(data):
        size = None
        if data[at + 3] & 4 and bytes(data[at + 12 : at + 14]) == b"sl":
            size = struct.unpack("<I", data[at + 16 : at + 20])[0]
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(data[at : at + size] if size else data[at:], _HEAD)
        while (parsed := header(raw)) is None:
            more = unpack.decompress(unpack.unconsumed_tail, _HEAD)
            if not more:
                raise ValueError("a record without a header")
            raw += more
        row, begin = parsed
        keep = wanted(row)
        if keep and row["http"]:
            while (head := raw.find(b"\r\n\r\n", begin)) < 0 and (more := unpack.decompress(unpack.unconsumed_tail, _HEAD)):
                raw += more
            skip = head + 4 - begin if 0 <= head <= begin + row["length"] - 4 else 0
            begin, row = begin + skip, {**row, "length": row["length"] - skip, "payload_bytes": row["length"] - skip}
        if keep and payloads or size is None:
            raw += unpack.decompress(unpack.unconsumed_tail)
        at = at + size if size else len(data) - len(unpack.unused_data)
        if keep:
            full = payloads and row["record_type"] != "revisit"
            yield {**row, "payload": raw[begin : begin + row["length"]] if full else None}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for test in filters:
            column = test.attribute[0] if hasattr(test, "attribute") and len(test.attribute) == 1 else None
            if column in _PUSHED and isinstance(test, EqualTo | In | StringStartsWith):
                self.tests.append((column, type(test).__name__, tuple(test.value) if isinstance(test, In) else test.value))
            else:
                yield test

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        files = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".warc.gz"))
        out, some, total = [], [], 0
        for path, size in files:
            if some and total + size > PARTITION_BYTES:
                out.append(_Files(tuple(some)))
                some, total = [], 0
            some.append(path)
            total += size
        return [*out, *([_Files(tuple(some))] if some else [])] or [_Files(())]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            found = row[column]
            if found is None or not (found in value if kind == "In" else found.startswith(value) if kind == "StringStartsWith" else found == value):
                return False
        return True

    def read(self, partition):
        store, _ = _store(self.path)
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
        for path in partition.paths:
            with store.open_input_file(path) as file:
                data = memoryview(file.read_buffer())
            rows, size = [], 0
            for row in records(data, self._wanted, self.payloads):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root)
        part, paths, out = TaskContext.get().partitionId(), [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        paths.append(f"{root}/part-{part:06d}-{len(paths):04d}-{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{paths[-1]}.tmp", compression=None)
                    out.write(record(row))
        finally:
            if out is not None:
                out.close()
        return _Written(tuple(paths))

    def commit(self, messages):
        store, root = _store(self.path)
        if self.overwrite:
            from pyarrow import fs

            for file in store.get_file_info(fs.FileSelector(root, recursive=True)):
                if file.is_file and file.path.endswith(".warc.gz"):
                    store.delete_file(file.path)
        for message in messages:
            for path in message.paths:
                store.move(f"{path}.tmp", path)

    def abort(self, messages):
        store, _ = _store(self.path)
        for message in messages:
            for path in message.paths if message else ():
                store.delete_file(f"{path}.tmp")


class WarcDataSource(DataSource):
    """format("warc"): options path, payload."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known, with predicates pushed down."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(pages: DataFrame, folder: str, least: int = 100) -> None:
    """Write a record a page below ``folder``; of equal payloads of ``least`` bytes or more the smallest
    page_id (nulls last) is the response and the others revisit it. Only digests are compared. The repeated ones
    are written first, so that their size is known: payloads are shuffled only if they are too many to
    broadcast, and then short pages and the copies of a frequent one are dealt out."""
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    place = F.concat_ws("|", F.col("page_id").cast("string"), "url")
    rows = rows.withColumn("of", F.when(F.col("payload_bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("short "), F.md5(place))))
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("of").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = common.materialize(firsts, "firsts")
    found = common.join_split(rows, firsts.select("of", "first"), "of", firsts.select("of", "n"), place)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    found.select(
        F.coalesce(name(F.col("page_id")), F.lit("urn:page:")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit("1970-01-01T00:00:00Z").alias("date"), "digest", F.when(again, name(F.col("first"))).alias("refers_to"),
        "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(folder)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from archives written for ``pages``."""
    spark = pages.sparkSession
    folder = common.scratch_path(spark, "warc")
    archive(pages, folder)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    response = F.col("record_type") == "response"
    return spark.read.format("warc").load(folder).select(
        page("record_id").alias("page_id"), F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )


SQL = """
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)"""
