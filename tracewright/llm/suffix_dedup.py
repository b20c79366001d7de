"""Exact substring removal: every byte covered by a WINDOW-byte string that occurs elsewhere.

Windows are gathered into paths around content-defined minimisers (repeats.py). A path
that occurs twice as a whole repeats as a whole. Where distinct paths share a minimiser,
each path's windows are split by how far before the minimiser they begin, into ranges of
SPAN places; all windows of a range share a core, and only ranges whose core occurs in
another range too can hold repeated windows. The contexts of those ranges form shards,
all contexts of a core in one, and each shard's suffixes are sorted by external induced
sorting (suffix_array.py), whose disk-backed queues carry positions and common-prefix
values: a window repeats if a neighbouring suffix shares WINDOW bytes with it. Cores that
more than HOT contexts share aren't put into one shard: their windows are counted by
two 64-bit hashes, with partial aggregation.

Texts are UTF-8 bytes; what is left of one may begin or end within a character, so
results are digests and spans of bytes.

Defined cases: null is the empty text; texts shorter than WINDOW keep all; very long texts
are windowed whole; rows with equal ids are separate texts; repeated rows repeat each
other, so all of them lose what they share; matches never cross texts, and windows of one
text that repeat within it count; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, byte_codes, column, drop_written, lean, likely, may_hold, mix, prefix_sums, shared_dir, slices, span_hash, text_buffer, written
from .repeats import _ranges, covered, document_keys, find_paths, repeated_paths
from .suffix_array import suffix_array

WINDOW, GRAM, SPAN = 400, 100, 76
HOT = 5_000
SHARD_BYTES, QUEUE_BYTES = 1 << 20, 4 << 20
PATHS = "doc_id long, key long, start int, n int, anchor long, name long"


def _slices(b: pa.RecordBatch):
    data, offsets = text_buffer(column(b, "text"))
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        yield i, j, part, byte_codes(0)[part], offsets[i : j + 1] - offsets[i]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = column(b, "doc_id")
        for i, j, _, codes, first in _slices(b):
            p = find_paths(codes, first, WINDOW, GRAM)
            if len(p.doc):
                keys = document_keys(p.sums, first)
                yield pa.record_batch(
                    [ids.take(pa.array(p.doc + i)), pa.array(keys[p.doc]), pa.array((p.start - first[p.doc]).astype(np.int32)), pa.array(p.count.astype(np.int32)), pa.array(p.anchor), pa.array(p.name)],
                    names=["doc_id", "key", "start", "n", "anchor", "name"],
                )


_CONTEXTS = "name long, off int, m int, core long, context binary"


def _contexts(filt):
    """The ranges of the paths whose names may be wanted: offset of the first window, number of windows, core, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filt.value
        for b in batches:
            for _, _, raw, codes, first in _slices(b):
                p = find_paths(codes, first, WINDOW, GRAM)
                hit = np.flatnonzero(may_hold(table, p.name)) if len(p.doc) else []
                if not len(hit):
                    continue
                hit = hit[np.unique(p.name[hit], return_index=True)[1]]
                text = raw.tobytes()
                far = (p.at - p.start)[hit]  # distances of the first and the last window to the minimiser
                close = far - p.count[hit] + 1
                lo, hi = close // SPAN, far // SPAN
                k = np.repeat(np.arange(len(hit)), hi - lo + 1)
                r = _ranges(lo, hi - lo + 1)
                path = hit[k]
                big, small = np.minimum(far[k], r * SPAN + SPAN - 1), np.maximum(close[k], r * SPAN)
                at = p.at[path]
                core_lo, core_hi = at - r * SPAN, at - np.minimum(r * SPAN + SPAN - 1, WINDOW - GRAM) + WINDOW
                core = mix(span_hash(p.sums, core_lo, core_hi, 3) + r.astype(np.uint64))
                a, z = at - big, at - small + WINDOW
                cols = (p.name[path], (a - p.start[path]).astype(np.int32), (big - small + 1).astype(np.int32), core.astype(np.int64))
                yield pa.record_batch([*[pa.array(c) for c in cols], pa.array([text[x:y] for x, y in zip(a.tolist(), z.tolist())], pa.binary())], names=["name", "off", "m", "core", "context"])

    return run


def _same(a: str, b: str, *cols: str):
    cond = F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    for c in cols:
        cond = cond & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return cond


def sort_shard(contexts: list[bytes], windows: list[int], folder: str | None = None, budget: int = QUEUE_BYTES) -> list[np.ndarray]:
    """Which of each context's windows occur elsewhere in the shard too, by its suffix array."""
    size = np.array([len(c) + 1 for c in contexts])
    first = np.cumsum(size) - size
    s = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int32) + 2
    s[first + size - 1] = 1  # no byte: separators
    sa, lcp = suffix_array(s, WINDOW, folder, budget)
    same = lcp >= WINDOW
    repeated = np.zeros(len(s), bool)
    repeated[sa[same]] = True
    repeated[sa[np.flatnonzero(same) - 1]] = True
    return [np.flatnonzero(repeated[f : f + m]) for f, m in zip(first.tolist(), windows)]


def _runs(at: np.ndarray) -> list[dict[str, int]]:
    """Runs [a, z) of ascending numbers."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    return [{"a": int(a), "z": int(z) + 1} for a, z in zip(at[cut], at[np.append(cut[1:] - 1, len(at) - 1)])]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
RUNS = "array<struct<a:int,z:int>>"


def _sort(folder: str | None, budget: int):
    """Rows sorted by core come in; whole cores are gathered into shards of about SHARD_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None

        def close() -> pa.RecordBatch:
            found = sort_shard([r[3] for r in rows], [r[2] for r in rows], folder, budget)
            out = [(r[0], _runs(f + r[1])) for r, f in zip(rows, found) if len(f)]
            rows.clear()
            return pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], _RUNS)], names=["name", "runs"])

        for b in batches:
            for core, *row in zip(*(column(b, c).to_pylist() for c in ("core", "name", "off", "m", "context"))):
                if rows and core == last and rows[-1][:2] == tuple(row[:2]):
                    continue
                if held >= SHARD_BYTES and core != last:
                    yield close()
                    held = 0
                rows.append(tuple(row))
                held += len(row[-1])
                last = core
        if rows:
            yield close()

    return run


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of contexts: their offsets and two hashes each."""
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            raws = column(part, "context").to_pylist()
            m = column(part, "m").to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.frombuffer(b"".join(raws), np.uint8)
            size = np.array([len(r) for r in raws])
            at = _ranges(np.cumsum(size) - size, m)
            own = np.repeat(np.arange(len(raws)), m)
            h = [span_hash(prefix_sums(byte_codes(x)[data], 3 + x), at, at + WINDOW, 3 + x).astype(np.int64) for x in (0, 1)]
            off = column(part, "off").to_numpy(zero_copy_only=False)[own] + (at - (np.cumsum(size) - size)[own])
            take = pa.array(own)
            yield pa.record_batch([column(part, "name").take(take), pa.array(off.astype(np.int32)), pa.array(h[0]), pa.array(h[1])], names=["name", "off", "e1", "e2"])


def _queue_folder(documents: DataFrame) -> str:
    """The folder for queues, as a URI within the shared folder; executors make what they need in it."""
    found = shared_dir(documents.sparkSession)
    return f"{found if urlparse(found).scheme else 'file://' + os.path.abspath(found)}/tracewright-queues"


def repeated_windows(documents: DataFrame) -> DataFrame:
    """(doc_id, key, start, runs): for each path with repeated windows its first byte and the runs of such windows."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    paths = written(docs.mapInArrow(lean(_paths), PATHS))
    nodes = repeated_paths(paths)
    every = F.array(F.struct(F.lit(0).alias("a"), F.lit(WINDOW).alias("z")))
    whole = nodes.where("times > 1").select("anchor", "name", every.alias("runs"))
    branching = bloom(nodes.where("kinds > 1").select(F.col("name").alias("id")))
    contexts = written(docs.mapInArrow(lean(_contexts(branching)), _CONTEXTS))
    cores = written(contexts.groupBy("core").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("core", "members"))
    shared = contexts.mapInArrow(lean(likely(bloom(cores.select(F.col("core").alias("id"))), "core")), _CONTEXTS)
    huge = cores.where(F.col("members") > HOT).select("core")
    cold = shared.join(huge, "core", "left_anti").select("core", "name", "off", "m", "context")
    # the same range of the same path may come from several texts
    cold = cold.repartition("core").sortWithinPartitions("core", "name", "off")
    sorted_ = cold.mapInArrow(lean(_sort(_queue_folder(documents), QUEUE_BYTES)), f"name long, runs {RUNS}")
    hot = shared.join(huge, "core", "left_semi").select("name", "off", "m", "context").mapInArrow(lean(_open), "name long, off int, e1 long, e2 long")
    twice = hot.groupBy("e1", "e2").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo <> hi").select("e1", "e2")
    opened = hot.join(twice, ["e1", "e2"]).select("name", "off").distinct().select("name", F.array(F.struct(F.col("off").alias("a"), (F.col("off") + 1).alias("z"))).alias("runs"))
    part = sorted_.unionAll(opened).join(nodes.select("anchor", "name"), "name").select("anchor", "name", "runs")
    repeated = written(whole.unionAll(part).groupBy("anchor", "name").agg(F.flatten(F.collect_set("runs")).alias("runs")))
    drop_written(contexts, cores, nodes)
    near = bloom(repeated.select(F.col("name").alias("id")))
    found = paths.mapInArrow(lean(likely(near, "name")), PATHS).join(repeated, ["anchor", "name"])
    # runs that reach past the path's last window end there
    return found.select("doc_id", "key", "start", F.transform("runs", lambda r: F.struct(r["a"].alias("a"), F.least(r["z"], F.col("n")).alias("z"))).alias("runs"))


def _split(filt):
    """Digests the texts that keep all their bytes, and passes on the others (text is null for the digested)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filt.value
        for b in batches:
            keys = np.zeros(b.num_rows, np.int64)
            for i, j, _, codes, first in _slices(b):
                keys[i:j] = document_keys(prefix_sums(codes, 3), first)
            data, offsets = text_buffer(column(b, "text"))
            maybe = may_hold(table, keys)
            raw = memoryview(data)
            sha = [None if maybe[k] else hashlib.sha256(raw[offsets[k] : offsets[k + 1]]).hexdigest() for k in range(b.num_rows)]
            texts = pc.if_else(pa.array(maybe), column(b, "text").fill_null(""), pa.scalar(None, pa.string()))
            yield pa.record_batch([column(b, "doc_id"), pa.array(keys), pa.array(np.diff(offsets)), pa.array(sha, pa.string()), texts], names=["doc_id", "key", "n_bytes", "kept_sha256", "text"])

    return run


def removed(n: int, starts: list[int], runs: list[list[dict]]) -> np.ndarray:
    """Mask of the bytes that go."""
    at = [np.arange(s + r["a"], s + r["z"]) for s, own in zip(starts, runs) for r in own]
    return covered(n, np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64), WINDOW)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, starts, runs in zip(*(column(b, c).to_pylist() for c in ("text", "starts", "runs"))):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            hit = removed(len(raw), starts or [], runs or [])
            spans = int(np.count_nonzero(np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1))
            out.append((len(raw), int(hit.sum()), spans, hashlib.sha256(raw[~hit].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
        yield pa.record_batch([column(b, "doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans_by_document(documents: DataFrame) -> DataFrame:
    """(doc_id, key, starts, runs), one row per distinct document that loses bytes."""
    spans = repeated_windows(documents).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "runs"))).alias("w"))
    return written(spans.select("doc_id", "key", F.col("w.start").alias("starts"), F.col("w.runs").alias("runs")))


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of documents."""
    spans = spans_by_document(documents)
    filt = bloom(spans.select(F.col("key").alias("id")))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split = docs.mapInArrow(lean(_split(filt)), "doc_id long, key long, n_bytes long, kept_sha256 string, text string")
    zero = F.lit(0).cast("long")
    whole = split.where("text is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256")
    part = split.where("text is not null").select("doc_id", "key", "text")
    joined = part.alias("d").join(spans.alias("s"), _same("d", "s", "key"), "left").select("d.doc_id", "d.text", "s.starts", "s.runs")
    return whole.unionAll(joined.mapInArrow(lean(_apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
