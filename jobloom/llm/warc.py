"""A deterministic, sharded WARC writer and a reader for what it wrote.

Pages are put into shards by ranges of their id, sized by payload bytes, and sorted inside each.
One task streams one shard at a time into files that roll over by compressed size.  Files are
written under names of their own attempt, listed in a manifest that Spark commits once per
shard, renamed by that manifest, and listed again in the final one; a reader follows only that.
A repeated or lost task leaves at most files that no manifest names.  The same pages give the
same files, byte for byte.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equal ranges of ids whose bytes are counted to find the shards' bounds.
CELLS = 4096
MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
MANIFEST = "shard int, part int, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Headers are regenerated with one fixed date, so that reruns agree.
DATE = "2020-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value) -> str:
    """A header value on one line; a null value is empty."""
    return "" if value is None else str(value).replace("\r", " ").replace("\n", " ")


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {_line(page_id)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _packed(raw: bytes) -> bytes:
    """One gzip member without time stamp or name."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _digest():
    return F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("_digest")


def revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, ``_digest`` and refers_to of the pages (page_id, html) that repeat a payload.

    Of equal payloads of at least ``min_payload`` bytes the smallest page_id is the response.
    Only ids and digests are exchanged, and digests are aggregated before the join, so a hot
    payload is one row on that side.
    """
    rows = pages.select("page_id", _digest(), F.coalesce(F.octet_length("html"), F.lit(0)).alias("_n")).where(F.col("_n") >= min_payload)
    firsts = rows.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = rows.drop("_n").join(firsts.drop("_n"), "_digest").where("page_id is null or page_id > refers_to")
    return again.where("refers_to is not null").select("page_id", "_digest", "refers_to").distinct()


def shard_bounds(pages: DataFrame, target_bytes: int) -> tuple[int, int, list[int], list[int]]:
    """The ids' range and, per equal cell of it, the first shard and the number of shards.

    Neighbouring cells fill a shard; a cell above the target is spread over several.
    """
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = (low or 0, high or 0)
    width = max(1, -(-(high - low + 1) // CELLS))
    cell = F.coalesce(((F.col("page_id") - low) / width).cast("int"), F.lit(CELLS))
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + 500
    sums = {r["c"]: r["s"] for r in pages.groupBy(cell.alias("c")).agg(F.sum(size).alias("s")).collect()}
    first, count, shard, used = [], [], 0, 0
    for c in range(CELLS + 1):
        s = sums.get(c, 0)
        if used and used + s > target_bytes:
            shard, used = shard + 1, 0
        first.append(shard)
        spread = max(1, -(-s // target_bytes))
        count.append(spread)
        used += s
        if spread > 1:
            shard, used = shard + spread, 0
    return low, width, first, count


def _write_shards(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    attempt = uuid.uuid4().hex
    out = None

    def close() -> pa.RecordBatch:
        out["stream"].close()
        row = {k: out[k] for k in ("shard", "part", "temporary", "name", "records", "bytes")} | {"sha256": out["hash"].hexdigest()}
        return pa.RecordBatch.from_pylist([row], MANIFEST_ARROW)

    mark = refers = None
    for batch in batches:
        for shard, page_id, digest, url, html, to in zip(*(batch.column(c).to_pylist() for c in ("_shard", "page_id", "_digest", "url", "html", "refers_to")), strict=True):
            if to is not None:  # says what the pages after it refer to
                mark, refers = (page_id, digest), to
                continue
            part = 0
            if out is not None and (out["shard"] != shard or out["bytes"] >= roll_bytes):
                part = out["part"] + 1 if out["shard"] == shard else 0
                yield close()
                out = None
            if out is None:
                name = f"{shard:06d}-{part:05d}.warc.gz"
                temporary = f".{name}.{attempt}"
                stream = fs.open_output_stream(f"{root}/{temporary}", compression=None)
                out = {"shard": shard, "part": part, "temporary": temporary, "name": name, "records": 0, "bytes": 0, "hash": hashlib.sha256(), "stream": stream}
            data = _packed(record(page_id, url, (html or "").encode(), refers if mark == (page_id, digest) else None))
            out["stream"].write(data)
            out["hash"].update(data)
            out["records"] += 1
            out["bytes"] += len(data)
    if out is not None:
        yield close()


def _commit(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Renames the files of the first manifest; a repeated task finds them already renamed."""
    fs, root = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
            if fs.get_file_info(f"{root}/{temporary}").type != pafs.FileType.NotFound:
                fs.move(f"{root}/{temporary}", f"{root}/{name}")
            elif fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                raise FileNotFoundError(f"{root}/{name}")
        yield batch


def write(pages: DataFrame, folder: str, target_bytes: int = 32 << 20, roll_bytes: int = 8 << 20, min_payload: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as ``folder/*.warc.gz`` and returns the final manifest.

    Null html is an empty payload, a null url an empty target, a null page_id sorts first and
    revisits the smallest id of its payload, if there is one.  Rows that repeat an id get
    records of their own: all rows of the smallest id are responses.  No pages give an empty
    manifest.  Other columns are left out.
    """
    low, width, first, count = shard_bounds(pages, target_bytes)
    cell = F.coalesce(((F.col("page_id") - low) / width).cast("int"), F.lit(CELLS))
    spread = F.pmod(F.xxhash64("page_id", "_digest"), F.element_at(F.lit(np.array(count)), cell + 1)).cast("int")
    shards = first[-1] + count[-1]
    # what a page refers to travels beside it, so payloads are exchanged once
    rows = pages.select("page_id", "url", "html", _digest()).unionByName(revisits(pages, min_payload), allowMissingColumns=True)
    placed = rows.withColumn("_shard", F.element_at(F.lit(np.array(first)), cell + 1).cast("int") + spread)
    placed = placed.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "page_id", "_digest", F.col("refers_to").asc_nulls_last(), "url")
    manifest = placed.mapInArrow(lambda it: _write_shards(it, folder, roll_bytes), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest-1")
    written = placed.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest-1")
    written.mapInArrow(lambda it: _commit(it, folder), MANIFEST).write.parquet(f"{folder}/manifest")
    return placed.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(size)
        if not data:
            if parts:
                raise EOFError("the last record is cut off")
            return
        parts.append(unpack.decompress(data))
        rest = b""
        if unpack.eof:
            yield b"".join(parts)
            rest, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header and payload of one record; digests and lengths are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{payload_digest(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _read_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for name in batch.column("name").to_pylist():
            rows = []
            with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for raw in members(stream):
                    headers, http, payload = parse(raw)
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
                    page, refers = headers["X-Page-Id"], headers.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, size, digest, headers["WARC-Type"], int(refers) if refers else None))
                    if len(rows) == 4096:
                        yield _frame(rows)
                        rows = []
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record of the files in the manifest; files are read whole in any task's order."""
    files = manifest.select("name").repartition(max(1, spark.sparkContext.defaultParallelism * 2), "name")
    return files.mapInArrow(lambda it: _read_files(it, folder), RECORDS)
