"""Deterministic sharded WARC writer and reader.

Records are sorted by id into shards of about equal bytes; each shard rolls its files by
compressed size. A file is written under a temporary name and renamed when complete, so a task
that is lost or runs twice leaves the same bytes under the same name; only files listed in the
manifest count. File names, headers, dates and compression depend on the records alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges of ids whose bytes are counted at once to cut the shards: about so many rows reach the driver, and at most so many shards come of it.
RANGES = 8_192
#: Leading 48 bits of a record's UUID (version 8); the last bit says whether it has an id.
_MARK = 0x776172630000


def record_uuid(page_id: int | None) -> str:
    """A version-8 UUID that holds the 64-bit id."""
    bits = (page_id or 0) & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=((_MARK | (page_id is not None)) << 80) | (8 << 76) | ((bits >> 62) << 64) | (2 << 62) | (bits & (2**62 - 1)))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    bits = (((n >> 64) & 0xFFF) << 62) | (n & (2**62 - 1))
    return (bits - 2**64 if bits >= 2**63 else bits) if (n >> 80) & 1 else None


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)  # gzip without time or name
    return pack.compress(raw) + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, level: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_uuid(page_id)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    if revisit:
        headers += [("WARC-Refers-To", record_uuid(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    headers += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, block, level)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, also under the names that Hadoop's drivers give it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def _range_of(id_: Column, starts: list[int]) -> Column:
    """The last of the sorted starts that is not above the id, by binary search; -1 below all and for no id."""
    array = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")  # one literal, however long
    steps = [1 << k for k in reversed(range(len(starts).bit_length()))]
    below = lambda at: F.coalesce(F.get(array, at) <= id_, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(below(n + step - 1), n + step).otherwise(n)) - 1


def shard_starts(sized: DataFrame, shard_bytes: int) -> list[int]:
    """The least ids of shards of about equal bytes, from (id, n); the data alone decide.

    Equal ranges between the least and the greatest id are counted; those over a shard's bytes
    are divided on and on, until each holds less or a single id. So ids may lie as unevenly as
    they like: one far from all others costs a few more passes over (id, n).
    """
    low, high, total = sized.agg(F.min("id"), F.max("id"), F.sum("n")).first()
    if low is None:
        return [0]
    share = max(1, math.ceil((total or 0) / max(1, min(RANGES, math.ceil((total or 0) / shard_bytes)))))
    divided = lambda a, b, parts: sorted({a + (b - a) * k // parts for k in range(parts)})  # noqa: E731  of a .. b - 1
    starts = divided(low, high + 1, RANGES)
    while True:
        found = {r[0]: r[1] for r in sized.groupBy(_range_of(F.col("id"), starts).alias("at")).agg(F.sum("n")).collect()}
        merged, heavy, held = [], [], 0
        for k, a in enumerate(starts):
            n, b = found.get(k, 0), starts[k + 1] if k + 1 < len(starts) else high + 1
            if not merged or held + n > share:  # this range begins a shard
                merged.append(a)
                held = 0
            held += n
            if n > share and b - a > 1:
                heavy.append((a, b))
        if not heavy:
            return merged
        # Ranges that one shard holds count as one from now on; heavy ones are divided.
        parts = max(2, RANGES // len(heavy))
        starts = sorted({*merged, *(x for a, b in heavy for x in (*divided(a, b, parts), b) if x <= high)})


class _Roll:
    """The files of one shard, each begun under a temporary name and renamed when complete."""

    def __init__(self, out: str, shard: int, most: int, date: str, level: int):
        self.system, self.root = _store(out)
        self.shard, self.most, self.date, self.level, self.n, self.stream = shard, most, date, level, 0, None

    def add(self, record: bytes) -> dict | None:
        done = None
        if self.stream is not None and self.bytes + len(record) > self.most and self.records:
            done = self.close()
        if self.stream is None:
            self.name = f"shard-{self.shard:05d}-{self.n:05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.stream, self.bytes, self.records, self.sha = self.system.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
            info = f"software: tablequarry\r\nformat: WARC File Format 1.1\r\nisPartOf: shard-{self.shard:05d}\r\n".encode()
            name = uuid.uuid5(uuid.NAMESPACE_URL, self.name)
            self._write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info, self.level))
        self._write(record)
        self.records += 1
        return done

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> dict | None:
        if self.stream is None:
            return None
        self.stream.close()
        done = f"{self.root}/{self.name}"
        if self.system.get_file_info(done).type != fs.FileType.NotFound:
            self.system.delete_file(done)  # of an attempt that was lost: the same bytes; not every store moves onto a file
        self.system.move(self.temporary, done)
        self.stream, self.n = None, self.n + 1
        return {"file": self.name, "shard": self.shard, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def write_warc(pages: DataFrame, out: str, *, least: int = 0, shard_bytes: int = 32_000_000, file_bytes: int = 16_000_000, date: str = "2000-01-01T00:00:00Z", level: int = 6, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per row below `out` (a folder that all executors share) and returns the manifest.

    Of rows with equal payloads of at least `least` bytes, that with the largest id becomes a
    response and the others revisit it; all smaller ones are responses. The manifest
    (file, shard, records, bytes, sha256) is written to out/manifest.

    A null payload is empty, a null url has no header. Rows that repeat the id and payload of the
    response are responses too. Rows without an id go to the first shard. An empty table gives
    an empty manifest; further columns are not read, so none can clash. A payload is held whole
    in memory; rows of one id stay in one shard, however many.
    """
    spark = pages.sparkSession
    system, root = _store(out)
    system.create_dir(root, recursive=True)
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    sized = cut(rows.select("id", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha")))
    starts = shard_starts(sized.select("id", "n"), shard_bytes)
    groups = sized.where(F.col("n") >= least).groupBy("sha").agg(F.max("id").alias("to"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    marks = sized.where(F.col("n") >= least).join(groups, "sha").where(~F.col("id").eqNullSafe(F.col("to")))
    # A revisit's mark travels to the shard as a row of its own, sorted before its record: no join moves payloads.
    both = rows.select("id", F.lit(1).alias("kind"), F.lit("").alias("sha"), F.lit(None).cast("long").alias("to"), "url", "payload").union(
        marks.select("id", F.lit(0), "sha", "to", F.lit(None).cast("string"), F.lit(None).cast("binary")).distinct()
    )
    # Rows without an id are the first shard's.
    placed = both.withColumn("shard", F.greatest(_range_of(F.col("id"), starts), F.lit(0)).cast("int"))
    sorted_ = placed.repartitionById(len(starts), F.col("shard")).sortWithinPartitions("shard", "id", "kind", "url", F.sha2("payload", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, marked, now = None, {}, object()
        listed = lambda x: pa.RecordBatch.from_pylist([x], schema=MANIFEST) if x else None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if roll is None or roll.shard != row["shard"]:
                    if roll and (done := listed(roll.close())):
                        yield done
                    roll = _Roll(out, row["shard"], file_bytes, date, level)
                if row["id"] != now:
                    now, marked = row["id"], {}
                if row["kind"] == 0:
                    marked[row["sha"]] = row["to"]
                    continue
                sha = hashlib.sha256(row["payload"]).hexdigest() if marked else ""
                if done := listed(roll.add(page_record(row["id"], row["url"], row["payload"], marked.get(sha), sha in marked, date, level))):
                    yield done
        if roll and (done := listed(roll.close())):
            yield done

    sorted_.mapInArrow(run, "file string, shard int, records long, bytes long, sha256 string").write.mode("overwrite").json(f"{out}/manifest")
    for left in system.get_file_info(fs.FileSelector(root)):
        if left.base_name.startswith(".shard-"):  # of attempts that were lost
            system.delete_file(left.path)
    return read_manifest(spark, out)


MANIFEST = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("file string, shard int, records long, bytes long, sha256 string").json(f"{out}/manifest")


def remove(out: str) -> None:
    system, root = _store(out)
    system.delete_dir(root)


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(unpack.decompress(chunk))
            chunk = b""
            if unpack.eof:
                chunk = unpack.unused_data
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, block


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The page records of all files in the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Block and payload digests are recomputed; a record that differs raises an error. payload is
    null for revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _store(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        headers, block = parse_record(raw)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = headers["WARC-Type"] == "revisit"
                        if headers["WARC-Block-Digest"] != _sha1(block) or not revisit and headers["WARC-Payload-Digest"] != _sha1(payload):
                            raise ValueError(f"{name}: digests differ in {headers['WARC-Record-ID']}")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        rows.append((page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], page_of(headers["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
                        held += len(raw)
                        if held > 16_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    files = read_manifest(spark, out).select("file")
    return files.repartition(max(1, min(10_000, files.count())), "file").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
