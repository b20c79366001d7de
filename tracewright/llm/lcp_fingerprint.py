"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases level by level. At each level, runs of one symbol
become one symbol (with its length in its name), then deterministic coin tossing labels
each symbol by the lowest bit in which it differs from its left neighbour, four times
over, which leaves labels below six; phrases begin at local maxima of the labels. A
phrase's name is a hash of what it holds, and the names are the next level's symbols.
Where a phrase begins depends on a few neighbouring symbols only, so equal substrings
have equal phrases inside, wherever they stand. A fingerprint is a MinHash sketch (SLOTS
values of 16 bits, hexadecimal) of the bag of names of levels 1 to 4 and of the name of the
whole text, whatever the text's length, and the likeness of two is the share of equal slots.

Defined cases: null is the empty text, whose fingerprint is all zeros; texts too short
for a phrase have the name of the whole text; equal texts have equal fingerprints; rows
with equal ids are ordered by a hash of their text, then the text; a null id comes first;
a single row is its own next; repeated rows follow one another; very long texts are parsed
whole; an empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, lean, mix, prefix_sums, slices, span_hash, written
from .minhash_dedup import SLOTS, signatures

LEVELS = 4
_LOW8 = np.array([0] + [(v & -v).bit_length() - 1 for v in range(1, 256)], np.uint8)


def _toss(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """2 * (lowest bit in which x differs from left) + that bit of x."""
    d = x ^ left
    if x.dtype == np.uint8:
        low = _LOW8[d]
        return (2 * low + ((x >> low) & 1)).astype(np.uint8)
    low = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    low = np.minimum(low, np.uint64(63))
    return (np.uint64(2) * low + ((x >> low) & np.uint64(1))).astype(np.uint8)


def parse_level(symbols: np.ndarray, names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names of the phrases, index of each text's first phrase). symbols decide the cuts, names (uint64) what phrases are called."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    head = np.zeros(n + 1, bool)
    head[first] = True
    new = head[:n].copy()
    new[0] = True
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)  # runs
    length = np.diff(np.append(at, n))
    y = symbols[at]
    called = names[at]
    many = length > 1
    called[many] = mix(called[many] + length[many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    run_first = np.searchsorted(at, first)
    starts = np.zeros(len(at) + 1, bool)
    starts[run_first] = True
    begin = starts[: len(at)]
    label = y
    for _ in range(4):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[0] = 0
        left[begin] = ~label[begin]  # a text's first symbol differs from what is before it in bit 0
        label = _toss(label, left)
    up = np.ones(len(at), bool)
    up[1:] = (label[1:] > label[:-1]) | begin[1:]
    down = np.ones(len(at), bool)
    down[:-1] = (label[:-1] > label[1:]) | begin[1:]
    cut = np.flatnonzero((up & down) | begin)
    sums = prefix_sums(called, 7)
    return span_hash(sums, cut, np.append(cut[1:], len(at)), 7), np.searchsorted(cut, run_first)


def sketch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, SLOTS] of a slice of texts."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    byte_names = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
    names, first = parse_level(data, byte_names[data], offsets)
    whole = mix(np.add.reduceat(np.append(mix(names + np.uint64(3)) * (np.arange(len(names), dtype=np.uint64) * np.uint64(2) + np.uint64(1) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64) * np.uint64(2)), np.uint64(0)), np.minimum(first[:-1], len(names)))) if n else np.zeros(0, np.uint64)
    docs, found = [np.flatnonzero(size > 0)], [whole[size > 0]]
    for level in range(1, LEVELS + 1):
        doc = np.repeat(np.arange(n), np.diff(first))
        docs.append(doc)
        found.append(mix(names + np.uint64(level)))
        names, first = parse_level(names, names, first)
    doc, found_ = np.concatenate(docs), np.concatenate(found)
    # the same name again in a text counts as another feature, so likeness is that of bags
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (found_ >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    again = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    h = mix((key & np.uint64((1 << 48) - 1)) + again.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)
    return signatures(h, np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(48)))


def sketch_texts(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    out = [sketch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
    return np.concatenate(out) if out else np.zeros((0, SLOTS), np.uint16)


def fingerprint(text: str | None) -> str:
    return sketch_texts([text or ""])[0].astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal slots of two fingerprints."""
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 4 * SLOTS, 4)) / SLOTS


def fingerprints(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and fingerprint of every document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = sketch_texts([t or "" for t in column(b, "text").to_pylist()])
            names = [c for c in b.schema.names if c != "text"]
            yield pa.record_batch([*[column(b, c) for c in names], pa.array([s.astype(">u2").tobytes().hex() for s in sig], pa.string())], names=[*names, "fingerprint"])

    df = documents.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", fingerprint string"
    return df.mapInArrow(lean(run), schema)


# ------------------------------------------------------------ a text against its edit and the next one
_OUT = "kind int, doc_id long, th long, n_chars long, edited_sha256 string, fp binary, efp binary, near_edited double, near_next double, text string"
_FIELDS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()), ("efp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])


def edited(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q] if q else text


def _compare(ids: list, ths: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    edits = [edited(t, f) for t, f in zip(texts, following)]
    e = sketch_texts(edits)
    m = len(texts)
    return pa.record_batch(
        [
            pa.array(np.zeros(m, np.int32)),
            pa.array(ids, pa.int64()),
            pa.array(ths, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
            pa.array([s.astype(">u2").tobytes() for s in own], pa.binary()),
            pa.array([s.astype(">u2").tobytes() for s in e], pa.binary()),
            pa.array((own == e).mean(1) if m else np.zeros(0)),
            pa.array((own == after).mean(1) if m else np.zeros(0)),
            pa.nulls(m, pa.string()),
        ],
        schema=_FIELDS,
    )


def _edge(kind: int, row: tuple) -> pa.RecordBatch:
    none = [None] * 6
    return pa.record_batch([pa.array([v], f.type) for v, f in zip((kind, row[0], row[1], *none, row[2]), _FIELDS)], schema=_FIELDS)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range come in. Each is compared with the one after it; the range's first (kind 2) and last (kind 1) are passed on for the neighbouring ranges."""
    last: tuple | None = None
    last_sig = None
    for b in batches:
        for k in range(0, b.num_rows, 400):
            part = b.slice(k, 400)
            ids, ths, texts = (column(part, c).to_pylist() for c in ("doc_id", "th", "text"))
            texts = [t or "" for t in texts]
            sig = sketch_texts(texts)
            if last is None:
                yield _edge(2, (ids[0], ths[0], texts[0]))
            else:
                ids, ths, texts, sig = [last[0], *ids], [last[1], *ths], [last[2], *texts], np.concatenate([last_sig[None], sig])
            if len(ids) > 1:
                yield _compare(ids[:-1], ths[:-1], texts[:-1], texts[1:], sig[:-1], sig[1:])
            last, last_sig = (ids[-1], ths[-1], texts[-1]), sig[-1]
    if last is not None:
        yield _edge(1, last)


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, ths, texts, following = (column(b, c).to_pylist() for c in ("doc_id", "th", "text", "following"))
        texts, following = [t or "" for t in texts], [t or "" for t in following]
        yield _compare(ids, ths, texts, following, sketch_texts(texts), sketch_texts(following))


def against_next(documents: DataFrame) -> DataFrame:
    """Every document with its edit (its last quarter replaced by the next document's beginning) and likenesses.

    Texts are shuffled once, by ranges of the id; what a range's last row needs from the
    next range is one row, and those rows (two for each range) are paired by themselves.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(parts, "doc_id", "th").sortWithinPartitions("doc_id", "th", "text")
    out = written(ranged.mapInArrow(lean(_walk), _OUT))
    # one row per range and end: an ordering of them all is an ordering of ranges, not of documents; only ids are ordered
    edges = out.where("kind > 0").select(F.monotonically_increasing_id().alias("row"), "kind", "doc_id", "th", "text")
    order = Window.orderBy("doc_id", "th", F.when(F.col("kind") == 2, 0).otherwise(1))
    places = edges.select("row", F.row_number().over(order).alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))
    ranked = edges.join(places, "row")
    before = F.when(F.col("at") == 1, F.col("n")).otherwise(F.col("at") - 1)  # the first document follows the last
    heads = ranked.where("kind = 2").select(before.alias("at"), F.col("text").alias("following"))
    paired = ranked.where("kind = 1").select("doc_id", "th", "text", "at").join(heads, "at").select("doc_id", "th", "text", "following")
    rest = paired.mapInArrow(lean(_pair), _OUT)
    all_ = out.where("kind = 0").unionByName(rest)
    return all_.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("efp")).alias("edited_fingerprint"), "near_edited", "near_next")
