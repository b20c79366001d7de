"""Substring removal by compaction of a token de Bruijn graph.

An edge of the graph is a window of WINDOW words, its nodes are the window without its
last and without its first word. Edges that follow one another around one minimiser form
a nonbranching path; a path is compacted to one row (its name and its multiplicity) by
Spark aggregations, and joins find the minimisers at which distinct paths meet. Only paths at such branching places are opened into their
edges again; an edge is known by two independent 64-bit hashes taken at its source
coordinates. An edge of multiplicity two or more repeats, and the source coordinates of
all occurrences of repeated edges give the spans of words that go.

What is shuffled are paths (two for every 29 words or so), the edges of branching paths,
and the texts that lose words; other texts are digested where they are read.

Defined cases: null and empty texts have no words; texts of fewer than WINDOW words keep
all, very long ones are windowed whole; rows with equal ids are separate texts; repeated
rows repeat each other, so all of them lose what they share; matches never cross texts;
an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, bloom, column, drop_written, lean, likely, may_hold, mix, prefix_sums, slices, span_hash, text_buffer, word_bounds, word_hashes, written
from .repeats import _ranges, covered, document_keys, find_paths, repeated_paths

WINDOW, GRAM = 35, 8


def _slices(b: pa.RecordBatch):
    """(i, j, word hashes, starts, ends, first) of each slice of documents; starts and ends count from the batch's first byte."""
    data, offsets = text_buffer(column(b, "text"))
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        s, e, first = word_bounds(part, offsets[i : j + 1] - offsets[i], SPACE_WORDS)
        yield i, j, word_hashes(part, s, e, lower=False), part, s, e, first


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = column(b, "doc_id")
        for i, j, h, _, _, _, first in _slices(b):
            p = find_paths(h, first, WINDOW, GRAM)
            keys = document_keys(p.sums, first)
            yield pa.record_batch(
                [ids.take(pa.array(p.doc + i)), pa.array(keys[p.doc]), pa.array((p.start - first[p.doc]).astype(np.int32)), pa.array(p.count.astype(np.int32)), pa.array(p.anchor), pa.array(p.name)],
                names=["doc_id", "key", "start", "n", "anchor", "name"],
            )


PATHS = "doc_id long, key long, start int, n int, anchor long, name long"


def _edges(filt):
    """The edges of the paths whose names may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filt.value
        for b in batches:
            for _, _, h, _, _, _, first in _slices(b):
                p = find_paths(h, first, WINDOW, GRAM)
                hit = np.flatnonzero(may_hold(table, p.name))
                if not len(hit):
                    continue
                at = _ranges(p.start[hit], p.count[hit])
                own = np.repeat(hit, p.count[hit])
                other = prefix_sums(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), 5)
                cols = (p.name[own], (at - p.start[own]).astype(np.int32), span_hash(p.sums, at, at + WINDOW, 3).astype(np.int64), span_hash(other, at, at + WINDOW, 5).astype(np.int64))
                yield pa.record_batch([pa.array(c) for c in cols], names=["name", "off", "e1", "e2"])

    return run


EDGES = "name long, off int, e1 long, e2 long"


def _same(a: str, b: str, *cols: str):
    cond = F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    for c in cols:
        cond = cond & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return cond


def repeated_windows(documents: DataFrame) -> DataFrame:
    """(doc_id, key, start, mask): for each path that holds repeated windows, the first word and a bit for each such window."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    paths = written(docs.mapInArrow(lean(_paths), PATHS))
    nodes = repeated_paths(paths)
    whole = nodes.where("times > 1").select("anchor", "name", F.lit(-1).cast("long").alias("mask"))
    branching = nodes.where("kinds > 1").select(F.col("name").alias("id"))
    # an edge of one path with several occurrences is covered by the path; any other repeats
    # exactly if it lies on two paths of different names
    edges = written(docs.mapInArrow(lean(_edges(bloom(branching))), EDGES))
    twice = written(edges.groupBy("e1", "e2").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo <> hi").select("e1", "e2"))
    open_edges = edges.mapInArrow(lean(likely(bloom(twice.select(F.col("e1").alias("id"))), "e1")), EDGES)
    opened = open_edges.join(twice, ["e1", "e2"]).groupBy("name").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"))
    opened = opened.join(nodes.select("anchor", "name"), "name").select("anchor", "name", "mask")
    repeated = written(whole.unionAll(opened).groupBy("anchor", "name").agg(F.bit_or("mask").alias("mask")))
    drop_written(edges, twice, nodes)
    near = bloom(repeated.select(F.col("name").alias("id")))
    found = paths.mapInArrow(lean(likely(near, "name")), PATHS).join(repeated, ["anchor", "name"])
    # bits past the path's last window belong to no window
    return found.select("doc_id", "key", "start", F.expr("mask & (shiftleft(1L, n) - 1)").alias("mask"))


def _digest_one(words: list[bytes], hit: np.ndarray | None) -> tuple[int, int, str]:
    kept = words if hit is None else [w for w, h in zip(words, hit.tolist()) if not h]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _split(filt):
    """Digests the texts that keep all their words, and passes on the others (text is null for the digested)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filt.value
        for b in batches:
            keys = np.zeros(b.num_rows, np.int64)
            for i, j, h, _, _, _, first in _slices(b):
                keys[i:j] = document_keys(prefix_sums(h, 3), first)
            maybe = may_hold(table, keys)
            texts = column(b, "text")
            words, sha, passed = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [None] * b.num_rows
            for k in range(b.num_rows):
                t = texts[k].as_py() or ""
                if maybe[k]:
                    passed[k] = t
                else:
                    words[k], _, sha[k] = _digest_one(t.encode().split(), None)
            yield pa.record_batch([column(b, "doc_id"), pa.array(keys), pa.array(words), pa.array(sha, pa.string()), pa.array(passed, pa.string())], names=["doc_id", "key", "n_words", "kept_sha256", "text"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, starts, masks in zip(*(column(b, c).to_pylist() for c in ("text", "starts", "masks"))):
            words = (t or "").encode().split()
            hit = None
            if starts:
                at = [s + o for s, m in zip(starts, masks) for o in range(m.bit_length()) if m >> o & 1]
                hit = covered(len(words), np.array(at, np.int64), WINDOW)
            out.append(_digest_one(words, hit))
        yield pa.record_batch([column(b, "doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of documents."""
    found = repeated_windows(documents)
    spans = found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "mask"))).alias("w"))
    spans = written(spans.select("doc_id", "key", F.col("w.start").alias("starts"), F.col("w.mask").alias("masks")))
    filt = bloom(spans.select(F.col("key").alias("id")))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split = "doc_id long, key long, n_words long, kept_sha256 string, text string"
    whole = docs.mapInArrow(lean(_split(filt)), split).where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    part = docs.mapInArrow(lean(_split(filt)), split).where("text is not null").select("doc_id", "key", "text")
    joined = part.alias("d").join(spans.alias("s"), _same("d", "s", "key"), "left").select("d.doc_id", "d.text", "s.starts", "s.masks")
    return whole.unionAll(joined.mapInArrow(lean(_apply), "doc_id long, n_words long, n_removed long, kept_sha256 string"))
