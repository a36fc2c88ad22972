"""WARC archives: a deterministic sharded writer and a reader of what it committed.

Records are ordered by page_id and digest: quantiles of the bytes of a sample that hangs on
the keys alone give the shard limits, so the same rows give the same shards; one task sorts
and writes each shard, and a file is closed once its compressed size passes a limit.
Headers and digests are made anew from the rows, so the same rows give the same bytes.  A
file is written under a temporary name and renamed; the manifest, written by Spark's own
committer after all tasks have ended, names the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMESPACE = uuid.UUID("6f0d6a0e-3c0c-5d5c-9f43-0c3f5b9b7a10")
_MANIFEST = "file string, shard int, number int, records long, bytes long, sha256 string"
_RECORD = "page_id long, record_id string, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: About so many keys, of 60 bytes each, are sampled for the shard limits; there are at most an eighth as many shards.
SAMPLE = 32_768


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else f"file://{uri}")


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest.hex()}')}>"


def _uri(url, page_id) -> str:
    """The url with what can't stand in a header percent-encoded; urn:page:ID if there is none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'' if page_id is None else page_id}"


def record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without payload that names the response it equals."""
    payload, digest = row["payload"], row["digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(row['page_id'], digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(row['url'], row['page_id'])}"]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(row['refers_to'], digest)}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    head += [f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """A file in the making: gzip members, one for each record, under a temporary name."""

    def __init__(self, folder: str, shard: int, number: int, attempt: int):
        self.store, root = _open(folder)
        self.name, self.shard, self.number = f"part-{shard:05d}-{number:05d}.warc.gz", shard, number
        self.path, self.temporary = f"{root}/{self.name}", f"{root}/_temporary/{self.name}.{attempt}"
        self.store.create_dir(f"{root}/_temporary", recursive=True)
        self.out, self.sha, self.size, self.records = self.store.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0

    def add(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def commit(self) -> dict:
        """What an earlier attempt at the same task has left under the final name are the same bytes: it stays, as the manifest may name it already."""
        self.out.close()
        if self.store.get_file_info(self.path).type != fs.FileType.NotFound:
            self.store.delete_file(self.temporary)
        else:
            self.store.move(self.temporary, self.path)
        return {"file": self.name, "shard": self.shard, "number": self.number, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}


def _key(page_id: Column, digest: Column, url: Column) -> Column:
    """Text that sorts as (page_id, digest, hash of the url) does, nulls first."""
    order = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), order), F.lit("0")), F.hex(digest), F.lpad(F.hex(F.xxhash64(url)), 16, "0"))


def _limits(rows: DataFrame, shard_bytes: int) -> list[str]:
    """The keys at which shards begin, but the first: quantiles by bytes of the keys of a sample that hangs on their hashes.

    Rows of one key are one sampled row, however many there are, so that about SAMPLE rows
    reach the driver at most.
    """
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    few = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0).groupBy("key").agg(F.sum("size").alias("size")).orderBy("key").collect()
    shards = min(-(-total // shard_bytes), SAMPLE // 8)
    step, at, out = sum(r["size"] for r in few) / max(1, shards), 0, []
    for r in few:
        if at >= step * (len(out) + 1) and len(out) + 1 < shards:
            out.append(r.key)
        at += r["size"]
    return out


def _shard(key: Column, limits: list[str]) -> Column:
    """How many of the sorted limits are not after the key, by bisection."""
    if not limits:
        return F.lit(0)
    all_ = F.split(F.lit(",".join(limits)), ",")  # folded to one constant array

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        later = F.get(all_, middle) <= key
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(later, middle + 1).otherwise(s["low"]).alias("low"), F.when(later, s["high"]).otherwise(middle).alias("high")))

    first = F.struct(F.lit(0).alias("low"), F.lit(len(limits)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(limits).bit_length())), first, halve, lambda s: s["low"])


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20, date: str = "2000-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """Writes pages(page_id, url, html) to the new folder and returns its manifest.

    Payload is the html in UTF-8, empty for null.  Of records with equal payloads (by
    SHA-1 and length) of at least `least` bytes the one with the largest page_id is a
    response and the others revisit it; all with shorter payloads are responses.  Rows
    repeated under the largest page_id are responses all; a null page_id never is one's
    response, and is itself one only if no equal payload has a page_id.  A null url becomes
    urn:page:ID.  An empty table gives an empty manifest.  Other columns are not read.

    Shards of about shard_bytes are ranges of (page_id, digest, url), so neither outlying
    ids nor many rows of one id or none gather in one; only rows equal in all three do.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("length", F.octet_length("payload"))
    first = rows.where(F.col("length") >= least).groupBy("digest", "length").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1").select("digest", "length", "winner")
    # A record's response is told by a marker row, which sorts just before it: payloads are shuffled once, to their shard, and for nothing else.
    markers = rows.select("page_id", "url", "digest", "length").distinct().join(first, ["digest", "length"]).where(~F.col("page_id").eqNullSafe(F.col("winner")))
    both = rows.withColumn("winner", F.lit(None).cast("long")).unionByName(markers, allowMissingColumns=True)
    key = _key(F.col("page_id"), F.col("digest"), F.col("url"))
    limits = _limits(rows.select(key.alias("key"), (F.col("length") + 512).cast("long").alias("size")), shard_bytes)
    placed = both.withColumn("shard", _shard(key, limits))
    ordered = placed.repartitionById(len(limits) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.xxhash64("url"), "url", F.col("payload").isNotNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, file, done, marker = TaskContext.get().taskAttemptId(), None, [], {}
        for b in batches:
            for row in b.to_pylist():
                if row["payload"] is None:
                    marker = row
                    continue
                told = marker and all(marker[c] == row[c] for c in ("page_id", "digest", "length", "url"))
                row["refers_to"] = marker["winner"] if told else None
                if file and (file.shard != row["shard"] or file.size >= file_bytes):
                    done.append(file.commit())
                    file = _File(folder, row["shard"], file.number + 1 if file.shard == row["shard"] else 0, attempt)
                file = file or _File(folder, row["shard"], 0, attempt)
                file.add(record(row, date))
        if file:
            done.append(file.commit())
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("shard", pa.int32()), ("number", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    ordered.mapInArrow(write, _MANIFEST).write.json(f"{folder}/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).json(f"{folder}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members, read in pieces."""
    data, rest = b"", b""
    unpacker = zlib.decompressobj(31)
    while True:
        piece = rest or stream.read(1 << 20)
        if piece:
            data += unpacker.decompress(piece)
            rest = unpacker.unused_data
        if not piece or unpacker.eof:
            if data:
                head, block = data.split(b"\r\n\r\n", 1)
                headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                n = int(headers["Content-Length"])
                if len(block) != n + 4:
                    raise ValueError("a record is cut short")
                yield headers, block[:n]
            data, unpacker = b"", zlib.decompressobj(31)
        if not piece:
            return


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the folder's manifest: page_id, record_id, target_uri, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload_bytes and payload_digest are of the full payload, for a revisit as its headers
    say; a response's digests are computed again and must agree.  A revisit's payload is
    null, as all are with payloads=False.  Each file is one row of the manifest and is
    read by one task.
    """
    files = spark.read.schema(_MANIFEST).json(f"{folder}/manifest")
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for name in b.column("file").to_pylist():
                out = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                        if "sha1:" + _base32(hashlib.sha1(block).digest()) != h["WARC-Block-Digest"] or kind == "response" and (len(payload), _base32(hashlib.sha1(payload).digest())) != (size, digest):
                            raise ValueError(f"{name}: a digest is wrong")
                        page, to = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        out.append({"page_id": page and int(page), "record_id": h["WARC-Record-ID"], "target_uri": h["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": to and int(to), "payload": payload if payloads and kind == "response" else None})
                        if len(out) >= 500:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("file").repartition(n).mapInArrow(read, _RECORD)
