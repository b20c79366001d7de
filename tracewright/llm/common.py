"""Shared pieces of the training-data operators.

Everything here is vectorised over Arrow buffers: one text column arrives as one
contiguous UTF-8 buffer with offsets, and numpy works on slices of whole documents
(a document longer than a slice forms a slice of its own, so no text is cut).
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C13 | 3  # odd, so that it has an inverse modulo 2**64


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the setting is absent and there is one machine (tests, a laptop) a temporary
    one takes its place; a cluster without the setting is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all executors share")
    return (found or _own_dir()).rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracewright-ckpt-")


_written: list[tuple[SparkSession, str]] = []


def _delete_all() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing can be reached any more
            return


atexit.register(_delete_all)


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there, lost executors don't matter, and the write's shuffle files are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright-{uuid.uuid4().hex}"
    # on a local file system Hadoop starts a process for every mode that it sets; without checksum files there is one a file instead of three
    plain = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression=codec, **plain).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Deletes the tables behind written() frames that nothing reads any more: what was made of them must be written itself."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            p = context._jvm.org.apache.hadoop.fs.Path(f)
            if p.getName().startswith("tracewright-"):
                p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


class lean:
    """For mapInArrow: the function, after which a worker gives back to the system what it has freed, as workers stay for later tasks."""

    def __init__(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.run = run

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from self.run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)


ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows and about ARROW_BYTES: texts are long, and each task holds a batch several times over. Smaller settings of the session stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > ARROW_BYTES:
        spark.conf.set(size, f"{ARROW_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text buffers
def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = BLOCK, most: int = 60_000) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole documents of about limit bytes; a longer document is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + most, n)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < size at least; one table per seed, grown as needed."""
    found = _POWERS.get(seed)
    if found is None or len(found[0]) < size:
        base = (_BASE + 8 * 0x1234567 * seed) & (2**64 - 1)
        made = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, U64(b))
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        found = _POWERS[seed] = (made[0], made[1])
    return found


def _size(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


@lru_cache(maxsize=8)
def byte_codes(seed: int = 0) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 7919))


def prefix_sums(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """H with H[j] - H[i] = the sum of values[t] * B**t for i <= t < j, modulo 2**64."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(_size(len(values) + 1), seed)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the spans [start, end); equal sequences have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(_size(len(sums)), seed)[1][start] + (end - start).astype(U64))


# ---------------------------------------------------------------- words
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True  # of raw bytes: upper case is folded later
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word spans in the slice, and the index of each document's first word (one more at the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    s = m.copy()
    s[1:] &= ~m[:-1] | cut[1:n]
    e = m.copy()
    e[:-1] &= ~m[1:] | cut[1:n]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    codes = byte_codes(0)
    sums = prefix_sums((codes[LOWER] if lower else codes)[data])
    return span_hash(sums, starts, ends)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each word (or other unit) from the firsts."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def concat_ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


# ---------------------------------------------------------------- Bloom filters of bounded size
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def _positions(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    x = ids.astype(np.uint64)
    return [(mix(x * U64(0x9E3779B97F4A7C15) + U64(k * 77 + 1)) & U64(bits - 1)).astype(np.int64) for k in range(3)]


def _bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = np.concatenate(_positions(column(b, "id").to_numpy(zero_copy_only=False).astype(np.int64), bits))
            yield pa.record_batch({"word": pa.array(pos >> 6), "bits": pa.array((U64(1) << (pos & 63).astype(U64)).astype(np.int64))})

    return run


def bloom(ids: DataFrame):
    """A broadcast Bloom filter of the column id (long, not null): some 16 bits an id, from 128 KB to 32 MB whatever the input's size.

    Past some 40 million ids it lets more and more through, so what it passes is always
    joined exactly afterwards: it saves shuffles and never decides. ids is evaluated twice,
    so it should be a written table or cheap.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, ids.count()) - 1).bit_length()))
    words = ids.select(F.col("id").cast("long").alias("id")).mapInArrow(lean(_bits(bits)), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, U64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).astype(U64)
    return ids.sparkSession.sparkContext.broadcast(out)


def likely(filt, name: str):
    """For mapInArrow: the rows whose column name may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filt.value
        for b in batches:
            yield b.filter(pa.array(may_hold(held, column(b, name).to_numpy(zero_copy_only=False).astype(np.int64))))

    return run


def may_hold(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    hit = np.ones(len(ids), bool)
    for pos in _positions(ids, len(table) << 6):
        hit &= (table[pos >> 6] >> (pos & 63).astype(U64)) & U64(1) > 0
    return hit
