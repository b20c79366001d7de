"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are word sequences (lower-cased letters and digits): whole license texts,
standard notices and short references (license_texts.py). The K-word grams of a text or
notice are winnowed (the smallest hash of every W consecutive grams stays), which gives an
inverted index from gram to (template, place). Any K + W - 1 words that a text shares with
a template hold a common selected gram. A text's grams are looked up; each hit proposes a
template on a diagonal, hits on near diagonals are one candidate, and the candidate is
aligned with the template by local alignment within a band around the diagonal. A match
reports the share of the template's words that are matched in order (coverage) and the
span in the text. Templates of fewer than SHORT words stand in the index with their last
gram and count only where they occur word for word, since one word more or less names
another license.

The template set is a parameter; what reaches the executors is its index, of the size of
the templates, which is checked (MAX_TEMPLATE_WORDS).

Defined cases: null and empty texts match nothing, very long ones are scanned whole;
templates without words are refused; of overlapping matches of one license name the one
with the best coverage stays, of equal ones the longest template's, then the first;
matches of different names may overlap (a BSD-2-Clause text lies within BSD-3-Clause's);
what is inserted within a match beyond the band ends it, and the better part counts;
rows with equal ids and repeated rows are each reported; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, column, lean, prefix_sums, slices, span_hash, text_buffer, word_bounds, word_hashes
from .license_texts import REFERENCES, TEXTS
from .repeats import sliding_min

K, W, BAND, MIN_COVERAGE, SHORT = 3, 4, 8, 0.7, 16
MAX_TEMPLATE_WORDS = 1_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: name -> its texts; a match of any is one of the name
TEMPLATES: dict[str, list[str]] = {**{k: [t] for k, t in TEXTS.items()}, **REFERENCES}


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def winnow(h: np.ndarray, w: int = W) -> np.ndarray:
    """Indices of the selected grams: the leftmost smallest of each w consecutive ones (of fewer, the smallest)."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    packed = (h & ~np.uint64((1 << 31) - 1)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(packed, min(w, len(h)))
    return np.unique((least & np.uint64((1 << 31) - 1)).astype(np.int64))


def align(template: list, words: list, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, start, end) of the best local alignment with |j - i - diagonal| <= band; match 2, mismatch and gap -1."""
    m, n = len(template), len(words)
    width = 2 * band + 1
    # cell: score, matches, start
    prev: list[tuple[int, int, int]] = [(0, 0, 0)] * (width + 2)
    best = (0, 0, 0, 0)
    for i in range(m):
        row: list[tuple[int, int, int]] = [(0, 0, 0)] * (width + 2)
        for k in range(1, width + 1):
            j = i + diagonal + k - 1 - band
            if not 0 <= j < n:
                continue
            same = template[i] == words[j]
            d = prev[k]
            if d[0] > 0:
                cell = (d[0] + (2 if same else -1), d[1] + same, d[2])
            else:
                cell = (2, 1, j) if same else (0, 0, 0)
            up, left = prev[k + 1], row[k - 1]
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] > 0:
                row[k] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        prev = row
    return best[1], best[2], best[3]


class Index:
    """The inverted index of a set of templates."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names = sorted(templates)
        found: dict[tuple[int, tuple[bytes, ...]], None] = {}
        for n, name in enumerate(self.names):
            for text in templates[name]:
                found[n, tuple(words_of(text))] = None
        self.name = [n for n, _ in found]
        self.words = [list(w) for _, w in found]
        if not all(self.words):
            raise ValueError("a template has no words")
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError("the templates are too large for one index; scan with parts of them and unite the results")
        hashes, where = [], []
        for t, own in enumerate(self.words):
            data = np.frombuffer(b" ".join(own), np.uint8)
            s, e, _ = word_bounds(data, np.array([0, len(data)]), ALNUM_WORDS)
            g = grams(word_hashes(data, s, e, lower=False), len(own))
            for p in winnow(g) if len(own) >= SHORT else [len(g) - 1]:
                hashes.append(g[p])
                where.append((t, int(p)))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.where = [where[k] for k in order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> list[tuple[int, int, int]]:
        """(gram's place in g, template, place in the template)."""
        near = np.flatnonzero(self.sieve[(g >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, g[near]), np.searchsorted(self.hashes, g[near], "right")
        return [(int(p), *self.where[k]) for p, a, z in zip(near, lo, hi) for k in range(a, z)]


def grams(h: np.ndarray, n: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the K-word grams of a sequence (of fewer words: of the whole)."""
    sums = prefix_sums(h, 2) if sums is None else sums
    size = min(K, n)
    at = np.arange(n - size + 1)
    return span_hash(sums, at, at + size, 2)


def scan_words(words: list[bytes], hits: list[tuple[int, int, int]], index: Index, min_coverage: float = MIN_COVERAGE, band: int = BAND) -> list[tuple[int, float, int, int]]:
    """(name, coverage, first word, end word) of one text's hits."""
    mine: dict[int, list[tuple[float, int, int, int]]] = {}
    places: dict[int, list[int]] = {}
    for p, t, q in hits:
        places.setdefault(t, []).append(p - q)
    for t, own_places in places.items():
        own = index.words[t]
        found = mine.setdefault(index.name[t], [])
        if len(own) < SHORT:
            found += [(1.0, -len(own), d, d + len(own)) for d in own_places if d >= 0 and words[d : d + len(own)] == own]
            continue
        # two occurrences are a template apart at least, so neither the grouping nor the
        # alignment of one reaches the other
        near, wide = max(1, min(band, len(own) // 4)), max(1, min(2 * band, (len(own) - 1) // 2))
        groups: list[list[int]] = []
        for d in sorted(set(own_places)):
            if groups and d - groups[-1][0] <= near:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            d = g[len(g) // 2]
            lo = max(0, d - wide)
            part = words[lo : d + len(own) + wide]
            matched, a, z = align(own, part, d - lo, wide)
            if matched >= min_coverage * len(own):
                found.append((matched / len(own), -len(own), a + lo, z + lo))
    out: list[tuple[int, float, int, int]] = []
    for n, found in mine.items():
        kept: list[tuple[int, int]] = []
        for c, _, a, z in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if all(z <= x or y <= a for x, y in kept):
                kept.append((a, z))
                out.append((n, c, a, z))
    return sorted(out, key=lambda x: (x[2], x[0]))


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(index: Index, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(column(b, "text"))
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]]
                s, e, first = word_bounds(part, offsets[i : j + 1] - offsets[i], ALNUM_WORDS)
                n = len(s)
                if not n:
                    continue
                sums = prefix_sums(word_hashes(part, s, e, lower=True), 2)
                size = np.minimum(K, np.repeat(first[1:], np.diff(first)) - np.arange(n))
                # grams that would leave their text are shorter: they only match templates of so few words
                g = span_hash(sums, np.arange(n), np.arange(n) + size, 2)
                by_doc: dict[int, list[tuple[int, int, int]]] = {}
                for p, t, q in index.hits(g):
                    d = int(np.searchsorted(first, p, "right")) - 1
                    by_doc.setdefault(d, []).append((p - int(first[d]), t, q))
                for d, hits in by_doc.items():
                    a, z = first[d], first[d + 1]
                    raw = part.tobytes() if len(by_doc) < 4 else memoryview(part)
                    words = [bytes(raw[x:y]).lower() for x, y in zip(s[a:z].tolist(), e[a:z].tolist())]
                    base = offsets[i + d] - offsets[i]
                    text = bytes(memoryview(part)[base : offsets[i + d + 1] - offsets[i]])
                    for t, c, x, y in scan_words(words, hits, index, min_coverage):
                        lo, hi = s[a + x] - base, e[a + y - 1] - base
                        start = len(text[:lo].decode())
                        out[i + d].append({"license": index.names[t], "coverage": c, "start": start, "end": start + len(text[lo:hi].decode())})
            names = [c for c in b.schema.names if c != "text"]
            yield pa.record_batch([*[column(b, c) for c in names], pa.array(out, _MATCH)], names=[*names, "matches"])

    return run


def scan(documents: DataFrame, templates: dict[str, list[str]] | None = None, keep: tuple[str, ...] = ("doc_id",), min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """keep and matches (license, coverage, start, end in code points) of every document; one pass, no shuffle.

    All grams of a text are looked up, of which the winnowed ones are a part, so a
    text's own selection can't hide a template's.
    """
    df = documents.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", matches array<struct<license:string,coverage:double,start:long,end:long>>"
    return df.mapInArrow(lean(_scan(Index(TEMPLATES if templates is None else templates), min_coverage)), schema)


def digest(documents: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: number of matches, the matches as text, and the best coverage."""
    m = scan(documents, templates)
    shown = F.transform("matches", lambda x: F.concat_ws(":", x["license"], F.round(x["coverage"], 4).cast("string"), x["start"].cast("string"), x["end"].cast("string")))
    return m.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("matches").cast("long").alias("n_matches"), F.array_join(shown, ",").alias("matches"), F.coalesce(F.array_max(F.transform("matches", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"))
