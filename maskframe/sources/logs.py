"""Whole network logs: read as entries, with errors as rows, and written back as one file a log.

Reading is planned from file sizes: a file over the ceiling is refused before any of its content is read. Writing sends a
log's entries, in order, to one task, which streams them between the log's own head and tail; it holds one Arrow batch, not
the log. A file is written beside its name and moved there, so a task that runs again replaces its own file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators.har import size_gate
from maskframe.sources import texts

SILENT, CEILING = 75 << 20, 250 << 20
#: Head and tail of a log that came without its own.
HEAD, TAIL = '{"log":{"version":"1.2","creator":{"name":"maskframe","version":"1"},"entries":[', "]}}"
#: No JSON text holds this character.
_MARK = "\x00"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def read_har(spark: SparkSession, path: str, silent: int = SILENT, ceiling: int = CEILING) -> DataFrame:
    """(har_id, entry, text, error): a row an entry, dealt out at once, since a file is one task before. A file over ``ceiling`` bytes
    or without a list of entries is a row with an error alone; one over ``silent`` bytes keeps its entries, with a warning as error. A log
    with an empty list has no rows."""
    files, none = _files(spark, path), F.lit(None).cast("string")
    gate = size_gate(F.col("length"), silent, ceiling)
    refused = files.where(F.col("length") > ceiling).select(F.col("path").alias("har_id"), F.lit(None).cast("int").alias("entry"), none.alias("text"), F.format_string("refused: %d bytes", "length").alias("error"))
    parsed = files.where(F.col("length") <= ceiling).select(F.col("path").alias("har_id"), gate.alias("gate"), F.from_json(F.col("content").cast("string"), "log struct<entries:array<string>>")["log"]["entries"].alias("entries"))
    listed = parsed.select("har_id", "gate", F.col("entries").isNull().alias("bad"), F.posexplode(F.coalesce("entries", F.array(none))).alias("entry", "text"))
    error = F.when(F.col("bad"), "no list of entries in a log").when(F.col("gate") == "warn", "large file")
    rows = listed.select("har_id", F.when(~F.col("bad"), F.col("entry")).alias("entry"), "text", error.alias("error"))
    return rows.repartition("har_id", "entry").unionByName(refused)


def frames(spark: SparkSession, path: str, ceiling: int = CEILING) -> DataFrame:
    """(har_id, head, tail): what stands before and behind the entries of each log, as compact JSON in its own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = texts.json_tree(content.decode("utf-8", "replace"))
                except (ValueError, RecursionError):
                    continue
                log = tree.get("log") if isinstance(tree, dict) else None
                if isinstance(log, dict) and isinstance(log.get("entries"), list):
                    log["entries"] = texts.Number(_MARK)
                    head, tail = texts.json_text(tree).split(_MARK)
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([f"{head}["]), pa.array([f"]{tail}"])], ["har_id", "head", "tail"])

    files = _files(spark, path).where(F.col("length") <= ceiling).select("path", "content")
    return files.mapInArrow(run, "har_id string, head string, tail string")


def file_name(har_id: str) -> str:
    """The masked name of a log's file; logs of one name in different folders keep apart."""
    name = har_id.rsplit("/", 1)[-1]
    masked = re.sub(r"^(.+)\.([^.]*)$", r"\1.obfuscated.\2", name) if re.match(r".+\.[^.]*$", name) else f"{name}.obfuscated"
    return f"{hashlib.md5(har_id.encode()).hexdigest()[:8]}-{masked}"


def write_har(entries: DataFrame, folder: str, frames: DataFrame | None = None) -> DataFrame:
    """Write each log of ``entries`` (har_id, entry, text) as one file below ``folder``, which executors must share;
    returns (har_id, file, entries, bytes), kept as ``_manifest`` there. An entry without a text, as one that could not be
    redacted, is written as null, so that the others keep their places; rows without har_id or entry (errors of reading) are left out."""
    spark = entries.sparkSession
    rows = entries.where("har_id IS NOT NULL AND entry IS NOT NULL").select("har_id", F.col("entry").cast("long").alias("entry"), F.coalesce("text", F.lit("null")).alias("text"), F.lit(None).cast("string").alias("tail"))
    if frames is not None:
        rows = rows.unionByName(frames.select("har_id", F.lit(-1).cast("long").alias("entry"), F.col("head").alias("text"), "tail"))
    dealt = rows.repartition("har_id").sortWithinPartitions("har_id", "entry")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        made: list[tuple] = []
        state: dict = {}

        def close() -> None:
            if state:
                state["out"].write(state["tail"].encode())
                size = state["out"].tell()
                state["out"].close()
                store.move(state["tmp"], f"{root}/{state['name']}")
                made.append((state["key"], state["name"], state["n"], size))
                state.clear()

        for batch in batches:
            for key, entry, text, tail in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if state.get("key") != key:
                    close()
                    name = file_name(key)
                    tmp = f"{root}/{name}.{uuid.uuid4().hex}.tmp"
                    state.update(key=key, name=name, tmp=tmp, out=store.open_output_stream(tmp), n=0, tail=tail if entry < 0 else TAIL)
                    state["out"].write((text if entry < 0 else HEAD).encode())
                    if entry < 0:
                        continue
                state["out"].write((("," if state["n"] else "") + text).encode())
                state["n"] += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["har_id", "file", "entries", "bytes"])

    dealt.mapInArrow(save, "har_id string, file string, entries long, bytes long").write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")
