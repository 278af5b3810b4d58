"""Helpers that several operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.session import ensure_checkpoint_dir, pin_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The setting by which shuffle files go when the execution that wrote them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The bytes of a batch that is handed to Python, as set while a helper table is written.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Folders of the tables written by ``stored`` in this process, in order.
_FOLDERS: list[str] = []


def stored_folders() -> list[str]:
    return list(_FOLDERS)


def delete_stored(folders: list[str]) -> None:
    """Deletes tables that ``stored`` has written; only for callers that have written their own results."""
    for folder in folders:
        fs, path = pafs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (pafs.LocalFileSystem(), folder)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)
        if folder in _FOLDERS:
            _FOLDERS.remove(folder)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame as a written table: lineage ends there, and a lost executor costs nothing.

    Once it is written nobody reads the shuffle files behind it, so Spark is told to remove them.
    """
    path, conf = shared_folder(df.sparkSession, name), df.sparkSession.conf
    settings = {CLEAN_UP: "true", BATCH_BYTES: str(BATCH)}
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    _FOLDERS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, rows) of a batch whose texts have ``most`` bytes together, or are one longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield start, batch.slice(start, stop - start)
        start = stop


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Odd multipliers of the word and shingle hashes.
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * _M2
    h = h ^ (h >> np.uint64(29))
    h = h * _M3
    return h ^ (h >> np.uint64(32))


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at a time, so that memory stays bounded whatever a batch of texts holds.
_CHUNK = 1 << 18


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased) of all texts.

    Returns the hashes of all texts end to end and the bounds: the words of text i are
    ``hashes[bounds[i]:bounds[i + 1]]``.  A missing text has no words.
    """
    parts, counts = [], []
    chunk, size = [], 0
    for text in texts:
        raw = text.encode() if isinstance(text, str) else b""
        chunk.append(raw)
        size += len(raw) + 1
        if size >= _CHUNK:
            h, c = _hash_chunk(chunk)
            parts.append(h)
            counts.append(c)
            chunk, size = [], 0
    if chunk:
        h, c = _hash_chunk(chunk)
        parts.append(h)
        counts.append(c)
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return hashes, np.concatenate(([0], np.cumsum(counts)))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _M1, dtype=np.uint64))
    return _POWERS


_POWERS = np.ones(1, dtype=np.uint64)


def _hash_chunk(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
    sizes = np.array([len(r) + 1 for r in raws], dtype=np.int64)
    ends_of_text = np.cumsum(sizes)
    space = _SPACES[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    used = ~space
    at = np.flatnonzero(used)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        value = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
        hashes = mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends_of_text))))
    return hashes, counts


WORD = re.compile(r"[^\x20\x09-\x0D]+")
