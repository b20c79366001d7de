"""Benchmark decontamination with an FM-index per training shard.

Benchmark items give windows of WINDOW consecutive words (an item with fewer words is
one window). Each shard of the training data (one Arrow batch of whole documents) is
turned into a word sequence over the vocabulary of the windows; words outside it can't
be part of an occurrence and only separate runs, and runs shorter than the shortest
window can't hold one, so both are left out. Over what remains, an FM-index is built: the
suffix order, the Burrows-Wheeler transform in a wavelet matrix, and every 8th suffix
position sampled. All windows search backwards at once through wavelet ranks; occurrences
are located by walking back through ranks to sampled positions and merged into spans of
words to remove.

The windows of the benchmark are indexed in blocks of at most BLOCK_BYTES of text, and
only one block is held by the driver and sent to the executors at a time. One block is
searched in a single pass. Of several, each is searched in the text as it came, the hits of
all are united per text, and only texts with hits are shuffled, so results don't depend on
the number of blocks.

Defined cases: null and empty texts have no words and no hits; very long texts are
searched whole; items without words have no windows; repeated items (equal id) count
once, and equal texts under several ids count under each id; a null item id is left out;
documents with equal ids and repeated rows are each reported; an empty benchmark leaves
all documents clean, an empty table of documents gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, bloom, column, lean, may_hold, slices, text_buffer, word_bounds, word_hashes, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
SAMPLE = 8
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class FmIndex:
    """An FM-index of an integer sequence (symbols 0 to sigma - 1; 0 is the separator).

    Separators only bound runs, so their suffixes are ordered by place instead of by what
    follows: each is a symbol of its own, in that order. That is a suffix order of the
    sequence with distinct separators, reached by prefix doubling as deep as the longest
    repeated run; a step back from a separator isn't needed, as every run begins after one.
    """

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = np.append(seq, 0)  # the end is a separator
        n = len(seq)
        split = seq == 0
        rank = np.where(split, np.cumsum(split) - 1, seq.astype(np.int64) + int(split.sum()) - 1)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-step or n] = rank[step:] + 1
            key = rank * (n + sigma + 2) + np.where(split, 0, after)
            order = np.argsort(key, kind="stable")
            k = key[order]
            new = np.zeros(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1:
                break
        bwt = seq[order - 1]  # the predecessor of position 0 is the end
        self.n, self.sigma = n, sigma
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.levels = []
        bits = max(1, int(sigma - 1).bit_length())
        cur = bwt.astype(np.int32)
        for b in range(bits - 1, -1, -1):
            bit = (cur >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            self.levels.append((b, ones, n - int(ones[-1])))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        # every 8th position, and those after a separator, from which no step back is taken
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.mark = sampled
        self.mark_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer: the symbol before is read from the wavelet matrix on the way to its rank."""
        at = rows.astype(np.int64)
        lo = np.zeros(len(rows), np.int64)
        symbol = np.zeros(len(rows), np.int64)
        for b, ones, zeros in self.levels:
            one = (ones[at + 1] - ones[at]).astype(bool)
            symbol |= one.astype(np.int64) << b
            x, y = ones[at], ones[lo]
            at = np.where(one, zeros + x, at - x)
            lo = np.where(one, zeros + y, lo - y)
        return self.first[symbol] + at - lo

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the transform before position upto."""
        lo = np.zeros(len(symbol), np.int64)
        hi = upto.astype(np.int64)
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            a, c = ones[lo], ones[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + c, hi - c)
        return hi - lo

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the patterns, rows padded at the right."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for t in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= t) & (hi > lo))
            if not len(live):
                break
            c = patterns[live, lengths[live] - t]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back until a sampled position."""
        out, rows, step = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.mark[rows]
            out[left[done]] = self.samples[self.mark_rank[rows[done]]] + step
            left, rows, step = left[~done], self.back(rows[~done]), step + 1
        return out


class Windows:
    """The distinct windows of some benchmark items, as numbers of words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [vocab.setdefault(w, len(vocab) + 1) for w in _WORD.findall((text or "").encode().lower())]
            if words:
                for i in range(max(1, len(words) - window + 1)):
                    found.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.sigma = len(vocab) + 1
        keys = list(found)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.patterns = np.zeros((len(keys), window), np.int64)
        for i, k in enumerate(keys):
            self.patterns[i, : len(k)] = k
        self.items = [sorted(found[k]) for k in keys]
        self.shortest = int(self.lengths.min()) if keys else 0
        flat = b" ".join(vocab)
        data = np.frombuffer(flat, np.uint8)
        s, e, _ = word_bounds(data, np.array([0, len(data)]), ALNUM_WORDS)
        h = word_hashes(data, s, e, lower=False)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.arange(1, len(vocab) + 1)[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word hashes; 0 outside the vocabulary."""
        out = np.zeros(len(h), np.int64)
        near = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        same = self.hashes[at] == h[near]
        out[near[same]] = self.ids[at[same]]
        return out


def shard_hits(ids: np.ndarray, first: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit words as a mask, document, window) of all occurrences in a shard; ids are word numbers, first the documents' first words."""
    n = len(ids)
    hit = np.zeros(n, bool)
    none = np.zeros(0, np.int64)
    if not n or not len(w.lengths):
        return hit, none, none
    known = ids > 0
    cut = np.zeros(n + 1, bool)
    cut[first] = True
    s = known.copy()
    s[1:] &= ~known[:-1] | cut[1:n]
    e = known.copy()
    e[:-1] &= ~known[1:] | cut[1:n]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    long = ends - starts >= w.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return hit, none, none
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    pos = np.full(int(size.sum() + len(size)), -1, np.int64)
    inside = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    pos[inside] = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    seq = np.where(pos >= 0, ids[pos], 0)
    del to
    index = FmIndex(seq, w.sigma)
    lo, hi = index.search(w.patterns, w.lengths)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return hit, none, none
    count = (hi - lo)[some]
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[some], count)
    which = np.repeat(some, count)
    at = pos[index.locate(rows)]
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + w.lengths[which], minlength=n + 1)
    # windows are at most a few lengths: cover by differences
    hit = np.cumsum(edge)[:n] > 0
    return hit, np.searchsorted(first, at, "right") - 1, which


def _scan(w: Windows, spans: bool):
    """One block over one pass of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(column(b, "text"))
            n = b.num_rows
            hashes, firsts, bounds, total = [], [], [], 0
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]]
                s, e, first = word_bounds(part, offsets[i : j + 1] - offsets[i], ALNUM_WORDS)
                hashes.append(word_hashes(part, s, e, lower=True))
                if spans:
                    bounds.append((s + offsets[i], e + offsets[i]))
                firsts.append(first[:-1] + total)
                total += len(s)
            first = np.concatenate([*firsts, [total]]) if firsts else np.zeros(1, np.int64)
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            hit = np.zeros(len(h), bool)
            found: dict[int, set[str]] = {}
            if len(w.lengths):
                hit, doc, which = shard_hits(w.numbers(h), first, w)
                for d, k in set(zip(doc.tolist(), which.tolist())):
                    found.setdefault(d, set()).update(w.items[k])
            sums = np.concatenate([[0], np.cumsum(hit)])
            cols = {c: column(b, c) for c in b.schema.names if c != "text" or spans}
            cols["n_words"] = pa.array(np.diff(first))
            cols["n_hit"] = pa.array(sums[first[1:]] - sums[first[:-1]])
            cols["items"] = pa.array([sorted(found.get(k, ())) for k in range(n)], pa.list_(pa.string()))
            if spans:
                s, e = (np.concatenate([x[k] for x in bounds]) if bounds else np.zeros(0, np.int64) for k in (0, 1))
                out = []
                for k in range(n):
                    own = []
                    if k in found:
                        a, z = first[k], first[k + 1]
                        m = np.concatenate([[0], hit[a:z].astype(np.int8), [0]])
                        d = np.diff(m)
                        own = [{"start": int(s[a + p] - offsets[k]), "end": int(e[a + q - 1] - offsets[k])} for p, q in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))]
                    out.append(own)
                cols["spans"] = pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch(cols)

    return run


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Windows]:
    """The benchmark's windows in blocks of bounded size (one block unless it is over BLOCK_BYTES), one after another."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).first()[0]
    parts = max(1, -(-2 * int(size) // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    for k in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield Windows([(r.item_id, r.text) for r in mine.toLocalIterator()], window)


_SPANS = "array<struct<start:long,end:long>>"


def find(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """keep, text, n_words, n_hit, items (sorted ids) and spans (byte spans to remove) of every document."""
    return _find(documents, benchmark, keep, window)


def _find(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], window: int, spans: bool = True) -> DataFrame:
    cols = list(dict.fromkeys([*keep, "text"]))
    df = documents.select(*cols)
    kinds = dict(df.dtypes)
    blocks = windows_of(benchmark, window)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        shown = [c for c in cols if c != "text" or spans]
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in shown) + ", n_words long, n_hit long, items array<string>" + f", spans {_SPANS}" * spans
        return df.mapInArrow(lean(_scan(block, spans)), schema)
    # several blocks: hits by text, each block in its own pass, united on the text as it came
    text = df.select("text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.reverse("text"), F.lit(1)).alias("_h2"))
    hits = None
    while block is not None:
        one = text.mapInArrow(lean(_scan(block, True)), f"text string, _h1 long, _h2 long, n_words long, n_hit long, items array<string>, spans {_SPANS}")
        one = written(one.where("n_hit > 0").select("_h1", "_h2", "items", "spans").dropDuplicates(["_h1", "_h2"]))
        hits = one if hits is None else hits.unionAll(one)
        block, more = more, next(blocks, None)
    united = hits.groupBy("_h1", "_h2").agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
    united = written(united.withColumns({"_items": F.array_sort(F.array_distinct("_items")), "_spans": F.array_sort("_spans")}))
    may = bloom(united.select(F.col("_h1").alias("id")))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + f", _h1 long, _h2 long, n_words long, n_hit long, items array<string>, spans {_SPANS}"
    keyed = df.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.reverse("text"), F.lit(1))})
    counted = keyed.mapInArrow(lean(_scan(Windows([]), True)), schema)  # no windows: words are counted, nothing is hit
    clear = counted.mapInArrow(lean(_pick(may, False)), schema)
    some = counted.mapInArrow(lean(_pick(may, True)), schema).join(united.hint("shuffle_hash"), ["_h1", "_h2"], "left").select(*cols, "n_words", "_items", "_spans")
    out = [c for c in cols if c != "text" or spans] + ["n_words", "n_hit", "items"] + ["spans"] * spans
    plain = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + f", n_words long, n_hit long, items array<string>, spans {_SPANS}"
    return clear.select(*out).unionAll(some.mapInArrow(lean(_unite), plain).select(*out))


def _pick(filt, hit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = may_hold(filt.value, column(b, "_h1").to_numpy(zero_copy_only=False).astype(np.int64))
            yield b.filter(pa.array(maybe == hit))

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping spans of several blocks, and those with no word between them, become one; their words are counted."""
    for b in batches:
        hits, items, out = [], [], []
        for text, own, found in zip(*(column(b, c).to_pylist() for c in ("text", "_spans", "_items"))):
            raw, merged = (text or "").encode().lower(), []
            for x in own or []:
                if merged and (x["start"] <= merged[-1]["end"] or not _WORD.search(raw, merged[-1]["end"], x["start"])):
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(dict(x))
            hits.append(sum(len(_WORD.findall(raw[x["start"] : x["end"]])) for x in merged))
            items.append(found or [])
            out.append(merged)
        cols = {c: column(b, c) for c in b.schema.names if c not in ("_spans", "_items")}
        cols |= {"n_hit": pa.array(hits, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        yield pa.record_batch(cols)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, spans = column(b, "text").to_pylist(), column(b, "spans").to_pylist()
        for k, own in enumerate(spans):
            if own:
                raw, at, parts = texts[k].encode(), 0, []
                for x in own:
                    parts.append(raw[at : x["start"]])
                    at = x["end"]
                parts.append(raw[at:])
                texts[k] = b"".join(parts).decode()
        cols = {c: (pa.array(texts, pa.string()) if c == "text" else column(b, c)) for c in b.schema.names if c != "spans"}
        yield pa.record_batch(cols)


def remove_spans(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], window: int = WINDOW) -> DataFrame:
    """Documents without the words that benchmark windows cover (and what stands between such words). All windows are found in the text as it came, which is then cut once."""
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return find(documents, benchmark, keep, window).select(*keep, "spans").mapInArrow(lean(_remove), schema)


def digest(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items, their digest."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _find(docs, benchmark, ("doc_id",), window, spans=False)
    joined = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest_items(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
