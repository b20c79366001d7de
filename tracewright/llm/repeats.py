"""Windows of k units (bytes or words) that occur more than once in a corpus.

A window's minimiser is the leftmost smallest hash among its grams of q units; equal
windows have equal minimisers at equal places. Consecutive windows with one minimiser
are a path. Paths are named by their content, so a path whose name occurs twice repeats
as a whole, and only where one minimiser stands in several distinct paths (a branching
place) must single windows be compared. Both halves of that are left to the callers;
this module finds the paths and turns repeated windows into spans.

A document is known by (doc_id, key), key being a hash of all its units: rows that agree
in both have the same spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, drop_written, lean, likely, mix, prefix_sums, span_hash, written

_POS = np.uint64((1 << 31) - 1)


@dataclass
class Paths:
    doc: np.ndarray  # document in the slice
    start: np.ndarray  # first window's first unit, counted in the slice
    count: np.ndarray  # windows
    at: np.ndarray  # the minimiser's unit in the slice
    anchor: np.ndarray  # int64: the minimiser's hash
    name: np.ndarray  # int64: the content's hash
    sums: np.ndarray


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: block-wise running minima from both sides."""
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of [start, start + count), range after range."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def find_paths(codes: np.ndarray, first: np.ndarray, k: int, q: int) -> Paths:
    """Paths of a slice: codes are one uint64 per unit, first the documents' first units."""
    sums, more = prefix_sums(codes, 3), prefix_sums(codes, 4)
    size = np.diff(first)
    windows = np.maximum(0, size - k + 1)
    if not windows.any():
        z = np.zeros(0, np.int64)
        return Paths(z, z, z, z, z, z, sums)
    grams = np.arange(len(codes) - q + 1)
    packed = (span_hash(sums, grams, grams + q, 3) & ~_POS) | grams.astype(np.uint64)
    least = sliding_min(packed, k - q + 1)
    own = _ranges(first[:-1], windows)
    where = (least[own] & _POS).astype(np.int64)
    new = np.concatenate([[True], (where[1:] != where[:-1]) | (own[1:] != own[:-1] + 1)])
    cut = np.flatnonzero(new)
    start, at = own[cut], where[cut]
    count = np.diff(np.append(cut, len(own)))
    end = start + count + k - 1
    a, b = span_hash(sums, start, end, 3), span_hash(more, start, end, 4)
    name = mix(a ^ (b * np.uint64(0x9E3779B97F4A7C15)))
    doc = np.repeat(np.arange(len(size)), windows)[cut]
    anchor = span_hash(sums, at, at + q, 3).astype(np.int64)
    return Paths(doc, start, count, at, anchor, name.astype(np.int64), sums)


def document_keys(sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    return span_hash(sums, first[:-1], first[1:], 3).astype(np.int64)


def repeated_paths(paths: DataFrame) -> DataFrame:
    """(anchor, name, times, kinds) of the paths whose minimiser occurs more than once.

    Minimisers are counted first, with one number a row; only paths of repeated ones (as a
    filter of bounded size lets them through, then exactly) are grouped by name.
    """
    anchors = written(paths.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1").select("anchor"))
    some = paths.select("anchor", "name").mapInArrow(lean(likely(bloom(anchors.select(F.col("anchor").alias("id"))), "anchor")), "anchor long, name long")
    compact = written(some.groupBy("anchor", "name").agg(F.count("*").alias("times")))
    meeting = compact.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("times").alias("most")).where("kinds > 1 or most > 1").select("anchor", "kinds")
    out = written(compact.join(meeting, "anchor"))
    drop_written(anchors, compact)
    return out


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of n units lie in a window that begins at one of starts."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + k, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0
