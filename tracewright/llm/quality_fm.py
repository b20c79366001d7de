"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A document's features are (a) its distinct words, hashed into BUCKETS, with weight
count / sqrt(sum of squared counts), (b) one indicator for the quantile bin of each
structure statistic of the whole text (share of upper case, digits, symbols, repeated
words and lines, word and line lengths, size). score = sigmoid(w0 + sum w_i x_i +
1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)): the sum-of-squares identity makes
scoring linear in the number of features.

The model is fitted on the driver on a sample of labelled rows of at most max_rows
rows (by default 10,000, the lowest hashes of the id), whatever the corpus size.
Neither labels nor id, language or source are inputs of a score.

Defined cases: null and empty texts have only the structure bins of an empty text and
get their score, very long ones are featurised whole; a null id is never held out; labels
that are null are left out, of several labels of one document the lower counts; documents
with equal ids and repeated rows are each scored, and train under their id's label; ties
of scores stay ties (the threshold itself is predicted 1); with no labelled rows of both
classes the model scores the prior (0.5 without any label); an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, column, lean, mix, owner, powers, slices, text_buffer, word_bounds, word_hashes

BUCKETS = 1 << 15
BINS = 24
STATS = ("chars", "words", "upper", "digit", "symbol", "stop", "word_len", "distinct", "lines", "line_len", "same_lines", "bang", "high", "echo")

_UP = np.zeros(256, bool)
_UP[0x41:0x5B] = True
_DIG = np.zeros(256, bool)
_DIG[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:'\""]] = True
_BANG = np.zeros(256, bool)
_BANG[[ord(c) for c in "!?"]] = True
_SYM = np.zeros(256, bool)
_SYM[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_SYM &= ~_STOP & ~_BANG
_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True
_CLASS = np.zeros(256, np.uint8)
for _k, _m in enumerate((_UP, _DIG, _SYM, _STOP, _BANG, _HIGH), 1):
    _CLASS[_m] = _k


def _per_doc_distinct(doc: np.ndarray, h: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, value, count) of the distinct low bits of h in each document."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(bits)) | (h & np.uint64((1 << bits) - 1)))
    if not len(key):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[at] >> np.uint64(bits)).astype(np.int64), (key[at] & np.uint64((1 << bits) - 1)).astype(np.int64), np.diff(np.append(at, len(key)))


def featurize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(structure statistics [docs, STATS], doc, bucket, weight) of a slice of documents."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    cls = _CLASS[data]
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc_of * 8 + cls, minlength=8 * n).reshape(n, 8).astype(np.float64)
    starts, ends, first = word_bounds(data, offsets, SPACE_WORDS)
    words = np.diff(first).astype(np.float64)
    doc = owner(first)
    h = word_hashes(data, starts, ends, lower=True)
    length = np.bincount(doc, weights=(ends - starts), minlength=n)
    d, bucket, c = _per_doc_distinct(doc, h, 15, n)
    distinct = np.bincount(d, minlength=n)
    weight = c / np.sqrt(np.maximum(1, np.bincount(d, weights=c.astype(np.float64) ** 2, minlength=n)))[d]
    # lines: the hash of a line is the sum of its words' hashes times powers of their index
    nl = np.flatnonzero(data == 10)
    lines = np.bincount(doc_of[nl], minlength=n) + (size > 0)
    line_of = np.searchsorted(nl, starts) + doc  # unique up to the document, ascending
    if len(starts):
        cut = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]]))
        pos = np.arange(len(starts)) - np.repeat(cut, np.diff(np.append(cut, len(starts))))
        lh = mix(np.add.reduceat(h * powers(1 << 16, 1)[0][pos & 0xFFFF], cut))
        ld, _, _ = _per_doc_distinct(doc[cut], lh, 40, n)
        filled = np.bincount(doc[cut], minlength=n)
        same = 1 - np.bincount(ld, minlength=n) / np.maximum(1, filled)
    else:
        same = np.zeros(n)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    one, w1 = np.maximum(1, size), np.maximum(1, words)
    stats = np.stack([np.log1p(size), np.log1p(words), counts[:, 1] / one, counts[:, 2] / one, counts[:, 3] / one, counts[:, 4] / w1, length / w1, distinct / np.sqrt(w1), lines / w1, size / np.maximum(1, lines), same, counts[:, 5] / w1, counts[:, 6] / one, np.bincount(doc, weights=again, minlength=n) / w1], axis=1)
    return stats, d, bucket, weight.astype(np.float32)


@dataclass
class Model:
    w0: float
    w: np.ndarray  # [features]
    v: np.ndarray  # [features, rank]
    edges: np.ndarray  # [STATS, BINS - 1]

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """Feature numbers of the structure bins, [docs, STATS]."""
        cols = [np.searchsorted(self.edges[k], stats[:, k]) + BUCKETS + k * BINS for k in range(stats.shape[1])]
        return np.stack(cols, axis=1)

    def score(self, stats: np.ndarray, doc: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
        n = len(stats)
        b = self.bins(stats)
        lin = self.w0 + self.w[b].sum(1)
        vb = self.v[b]
        s, q = vb.sum(1), (vb**2).sum(1)
        if len(doc):
            lin = lin + np.bincount(doc, weights=self.w[bucket] * weight, minlength=n)
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            vx = self.v[bucket] * weight[:, None]
            s[doc[at]] += np.add.reduceat(vx, at, axis=0)
            q[doc[at]] += np.add.reduceat(vx**2, at, axis=0)
        z = lin + 0.5 * (s**2 - q).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(stats: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int = 6, epochs: int = 12, rate: float = 0.05, seed: int = 7) -> Model:
    """Mini-batch AdaGrad on the logistic loss; rows are (buckets, weights) by document."""
    rng = np.random.default_rng(seed)
    f = BUCKETS + len(STATS) * BINS
    if len(y):
        edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
        # thin tails get bins of their own: junk is rarer than one quantile
        edges[:, 0], edges[:, -1] = np.quantile(stats, 0.005, axis=0), np.quantile(stats, 0.995, axis=0)
        edges = np.sort(edges, axis=1)
    else:
        edges = np.zeros((len(STATS), BINS - 1))
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    m = Model(float(np.log(prior / (1 - prior))), np.zeros(f), rng.normal(0, 0.02, (f, rank)), edges)
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        return m
    gw, gv, g0 = np.full(f, 1e-3), np.full((f, rank), 1e-3), 1e-3
    bins = m.bins(stats)
    batch = min(256, max(16, len(y) // 40))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // batch)):
            k = len(part)
            idx = np.concatenate([np.concatenate([bins[i], rows[i][0]]) for i in part])
            x = np.concatenate([np.concatenate([np.ones(bins.shape[1]), rows[i][1]]) for i in part])
            at = np.cumsum([0] + [bins.shape[1] + len(rows[i][0]) for i in part])
            vx = m.v[idx] * x[:, None]
            s = np.add.reduceat(vx, at[:-1], axis=0)
            z = m.w0 + np.add.reduceat(m.w[idx] * x, at[:-1]) + 0.5 * (s**2 - np.add.reduceat(vx**2, at[:-1], axis=0)).sum(1)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / k
            ex = np.repeat(e, np.diff(at)) * x
            used, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, weights=ex) + 1e-6 * m.w[used]
            inner = ex[:, None] * (np.repeat(s, np.diff(at), axis=0) - vx)
            dv = np.stack([np.bincount(back, weights=inner[:, j]) for j in range(rank)], axis=1) + 1e-5 * m.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += e.sum() ** 2
            m.w[used] -= rate * 4 * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.w0 -= rate * e.sum() / np.sqrt(g0)
    return m


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_buffer(column(b, "text"))
        labels = column(b, "quality").to_pylist()
        for i, j in slices(offsets):
            stats, d, bucket, weight = featurize(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = np.searchsorted(d, np.arange(j - i + 1))
            yield pa.record_batch(
                {
                    "quality": pa.array(labels[i:j], pa.int32()),
                    "stats": pa.array([r.astype(np.float64).tobytes() for r in stats], pa.binary()),
                    "buckets": pa.array([bucket[at[k] : at[k + 1]].astype(np.uint16).tobytes() for k in range(j - i)], pa.binary()),
                    "weights": pa.array([weight[at[k] : at[k + 1]].astype(np.float16).tobytes() for k in range(j - i)], pa.binary()),
                }
            )


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 10_000, hold_out: bool = True) -> Model:
    """Fits on at most max_rows labelled documents, never on held-out ones (crc32 of the id, mod 5, is 0). Of several labels of one document the lower counts."""
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    if hold_out:
        sample = sample.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    sample = sample.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample has at most max_rows rows of two numbers
    joined = texts.join(F.broadcast(sample), "doc_id").select("text", "quality")
    got = joined.mapInArrow(lean(_features_of), "quality int, stats binary, buckets binary, weights binary").limit(2 * max_rows).toArrow()
    stats = [np.frombuffer(x, np.float64) for x in got["stats"].to_pylist()]
    rows = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(w, np.float16).astype(np.float64)) for a, w in zip(got["buckets"].to_pylist(), got["weights"].to_pylist())]
    y = np.array(got["quality"].to_pylist(), float)
    # the order of the rows that arrive isn't fixed; the fit's order is
    order = sorted(range(len(y)), key=lambda i: (stats[i].tobytes(), rows[i][0].tobytes(), y[i]))
    return fit(np.stack(stats)[order] if order else np.zeros((0, len(STATS))), [rows[i] for i in order], y[order] if order else y)


def scorer(model: Model, keep: list[str], kinds: list[pa.DataType]):
    model = Model(model.w0, model.w.astype(np.float32), model.v.astype(np.float32), model.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(column(b, "text"))
            out = np.zeros(b.num_rows)
            for i, j in slices(offsets):
                out[i:j] = model.score(*featurize(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            yield pa.record_batch([column(b, c) for c in keep] + [pa.array(out)], names=[*keep, "score"])

    return run


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and score (0 to 1). One pass, no shuffle."""
    cols = list(dict.fromkeys([*keep, "text"]))
    df = documents.select(*[F.col(c) for c in cols])
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", score double"
    return df.mapInArrow(lean(scorer(model, list(keep), [])), schema)


def classify(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
