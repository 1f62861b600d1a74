"""WARC: monolithic gzip archives, their normaliser to one member per record with an offset index, and a reader.

Archives lie in the shared folder and are written and read through pyarrow's file systems, so any store it
knows will do. Names hold the task attempt; only names that a finished job's manifest lists are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import fresh_path, stable

# Names of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"
READ = 1 << 20
#: Records, or bytes of payload, that a task hands to Spark at once.
BATCH = 2000

MANIFEST = "file string, ord long, page_id long, payload_digest string, payload_bytes long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], payload: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in headers.items()] + [f"Content-Length: {len(payload)}\r\n\r\n"]
    return VERSION + "".join(lines).encode() + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields of a record, names in lower case."""
    out = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an inflated stream, one at a time; memory holds a record and a chunk."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            head = parse_head(bytes(held[:end]))
            stop = end + 4 + int(head["content-length"])
            if len(held) < stop + 4:
                break
            yield head, bytes(held[end + 4 : stop])
            del held[: stop + 4]
    if held:
        raise ValueError("the archive ends inside a record")


def inflated(stream) -> Iterator[bytes]:
    """A gzip file's content, read once from start to end, READ bytes at most at a time; members may follow one another."""
    engine = zlib.decompressobj(31)
    while data := stream.read(READ):
        while data:
            out = engine.decompress(data, READ)
            yield out
            data = engine.unconsumed_tail
            while len(out) == READ and not data and not engine.eof:  # what the window still holds
                out = engine.decompress(b"", READ)
                yield out
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)


def _opened(uri: str):
    return fs.FileSystem.from_uri(uri)


def _name(kind: str) -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{kind}-{task.partitionId() if task else 0:06d}-{task.taskAttemptId() if task else 0}-{uuid.uuid4().hex[:8]}"


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html as one gzip stream per task; returns the manifest, a row for each record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        file, out, engine, n = f"{folder}/{_name('mono')}.warc.gz", None, None, 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                sum_ = digest(payload)
                head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Target-URI": "".join((url or "").split()), "WARC-Payload-Digest": f"sha1:{sum_}", "Content-Type": "text/html; charset=utf-8"}
                if out is None:
                    out, engine = store.open_output_stream(f"{root}/{file.rsplit('/', 1)[1]}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(engine.compress(record(head, payload)))
                rows.append((file, n, page_id, sum_, len(payload)))
                n += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["file", "ord", "page_id", "payload_digest", "payload_bytes"])
        if out is not None:
            out.write(engine.flush())
            out.close()

    return stable(pages.select("page_id", "url", "html").mapInArrow(write, MANIFEST), "warc-manifest")


def revisits(manifest: DataFrame, min_bytes: int) -> DataFrame:
    """For each file, the records that repeat a payload of at least min_bytes: array<struct<ord, refers_to>>.

    Of equal payloads the record with the largest page_id stays a response (null is smallest; of repeated rows, the
    last by file and place). The hot payload's rows are pre-aggregated, and its join is split by Spark.
    """
    big = manifest.where(F.col("payload_bytes") >= min_bytes)
    last = big.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "file", "ord")).alias("r"), F.count("*").alias("n")).where("n > 1")
    again = big.join(last, ["payload_digest", "payload_bytes"]).where((F.col("file") != F.col("r.file")) | (F.col("ord") != F.col("r.ord")))
    return again.groupBy("file").agg(F.collect_list(F.struct("ord", F.col("r.page_id").alias("refers_to"))).alias("again"))


def normalise(manifest: DataFrame, folder: str, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Inflates each monolithic archive once and rewrites every record as a gzip member of its own.

    Beside each archive lies <name>.idx, a JSON line for each record: offset, length, type, record id. Repeated
    payloads become revisit records without payload. Returns the new archives' paths.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                decided = {x["ord"]: x["refers_to"] for x in again or ()}
                store, path = _opened(file)
                target = f"{folder}/{_name('norm')}.warc.gz"
                root = _opened(folder)[1]
                store.create_dir(root, recursive=True)
                at, name = 0, target.rsplit("/", 1)[1]
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(f"{root}/{name}", compression=None) as out, store.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    for n, (head, payload) in enumerate(records(inflated(source))):
                        new = {"WARC-Type": "response", "WARC-Record-ID": head["warc-record-id"], "WARC-Date": head["warc-date"], "WARC-Target-URI": head["warc-target-uri"], "WARC-Payload-Digest": head["warc-payload-digest"], "Content-Type": head["content-type"]}
                        if n in decided:
                            to = "" if decided[n] is None else decided[n]
                            new |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:page:{to}>", "X-Payload-Length": str(len(payload))}
                            payload = b""
                        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = engine.compress(record(new, payload)) + engine.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "type": new["WARC-Type"], "id": new["WARC-Record-ID"]}).encode() + b"\n")
                        at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([target], pa.string())], names=["file"])

    files = manifest.groupBy("file").agg(F.count("*").alias("n"))
    work = stable(files.join(revisits(manifest, min_bytes), "file", "left").select("file", "again"), "warc-work")
    n = max(1, work.count())
    return stable(work.repartitionByRange(n, "file").mapInArrow(rewrite, "file string"), "warc-archives")


def _page(urn: str) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None


def read(archives: DataFrame) -> DataFrame:
    """Reads every record of the archives at its index's offset; a response's digest is computed anew and must match its header."""

    def rows(file: str) -> Iterator[tuple]:
        store, path = _opened(file)
        with store.open_input_stream(f"{path}.idx", compression=None) as held, store.open_input_file(path) as source:
            for line in held.read().splitlines():
                entry = json.loads(line)
                source.seek(entry["offset"])
                ((head, payload),) = records(iter([zlib.decompress(source.read(entry["length"]), 31)]))
                said = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "revisit":
                    yield _page(head["warc-record-id"]), int(head["x-payload-length"]), said, "revisit", _page(head["warc-refers-to"])
                elif digest(payload) != said:
                    raise ValueError(f"{file}, offset {entry['offset']}: the payload does not have the digest {said}")
                else:
                    yield _page(head["warc-record-id"]), len(payload), said, "response", None

    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for row in rows(file):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    n = max(1, archives.count())
    return archives.repartitionByRange(n, "file").mapInArrow(run, RESULT)


def drop(spark, folder: str) -> None:
    """Removes a folder of archives."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) to normalised archives; returns their paths.

    Null html is an empty payload, a null url an empty one, a null page_id a record id without number. Repeated rows
    are records of their own. An empty table gives no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    raw, done = fresh_path(spark, "warc-mono"), fresh_path(spark, "warc")
    archives = normalise(write_monolithic(pages, raw), done, min_bytes)
    drop(spark, raw)
    return archives


def op3(pages: DataFrame) -> DataFrame:
    return read(archive(pages))
