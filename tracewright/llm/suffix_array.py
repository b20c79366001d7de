"""External induced sorting of suffixes, with common-prefix values.

The suffix array of an integer string is made by induction: left-most S-type (LMS)
suffixes are sorted, L-type suffixes are induced from them in ascending order, S-type
ones in descending order. The queues between buckets are what an external priority queue
would hold: tuples of position and common-prefix value, keyed by first character, popped
bucket by bucket. They are kept in memory up to a budget and in files of a given folder
beyond it. All tuples of a bucket are handled at once by array operations; a bucket that
feeds itself (runs of one character) takes one round per run length.

The common prefix of two induced neighbours is one more than the smallest value between
the suffixes that induced them, so values travel through the queues with the positions.
LMS suffixes are named by a first induction; where names repeat, the string of names is
sorted by a recursive induction if its alphabet is small, and otherwise by doubling.
Order and values are exact up to cap; deeper ties are in no particular order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs

from .common import mix, prefix_sums, span_hash

SMALL_ALPHABET = 1024


class Queues:
    """First-in first-out tuples by character, a priority queue popped in the order of characters.

    What is over the budget goes to a run: all tuples held are written to one file of the
    shared folder, character after character, and only places in it stay in memory. The
    folder is a URI of any file system that pyarrow knows, so a cluster's shared folder
    serves as well as a local one.
    """

    def __init__(self, folder: str | None, budget: int):
        self.budget, self.held, self.runs, self.spilled = budget, 0, [], 0
        self.fs = None
        if folder:
            self.fs, at = pa.fs.FileSystem.from_uri(folder)
            self.folder = f"{at.rstrip('/')}/{uuid.uuid4().hex}"
        self.parts: dict[int, list] = {}

    def empty(self, c: int) -> bool:
        return c not in self.parts

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.held += pos.nbytes + lcp.nbytes
        self.parts.setdefault(c, []).append((pos, lcp))
        if self.fs and self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if not self.runs:
            self.fs.create_dir(self.folder)
        name, at = f"{self.folder}/{len(self.runs)}", 0
        self.runs.append(name)
        with self.fs.open_output_stream(name) as f:
            for c in sorted(self.parts):
                kept: list = []
                mine = [x for x in self.parts[c] if len(x) == 2]
                kept += [x for x in self.parts[c] if len(x) == 3]  # in earlier runs
                if mine:
                    pos, lcp = np.concatenate([x[0] for x in mine]).astype(np.int64), np.concatenate([x[1] for x in mine]).astype(np.int32)
                    f.write(pos.tobytes())
                    f.write(lcp.tobytes())
                    kept.append((name, at, len(pos)))
                    at += 12 * len(pos)
                self.parts[c] = kept
        self.spilled += at
        self.held = 0

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        got = []
        for x in self.parts.pop(c, []):
            if len(x) == 3:
                with self.fs.open_input_file(x[0]) as f:
                    f.seek(x[1])
                    raw = f.read(12 * x[2])
                got.append((np.frombuffer(raw, np.int64, x[2]), np.frombuffer(raw, np.int32, x[2], 8 * x[2])))
            else:
                self.held -= x[0].nbytes + x[1].nbytes
                got.append(x)
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def close(self) -> None:
        if self.runs:
            self.fs.delete_dir(self.folder)


def _range_min(lcp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum of lcp over (at[k], at[k + 1]] for all k."""
    ends = at[1:] + 1
    pairs = np.stack([at[:-1] + 1, ends], axis=1).ravel()
    return np.minimum.reduceat(np.append(lcp, np.iinfo(lcp.dtype).max), pairs)[::2]


class _Sorter:
    def __init__(self, s: np.ndarray, cap: int, folder: str | None, budget: int):
        """s ends with a 0 that occurs nowhere else."""
        self.s, self.cap, self.folder, self.budget = s, cap, folder, budget
        n = len(s)
        turn = np.append(np.flatnonzero(s[:-1] != s[1:]), n - 1)
        nxt = turn[np.searchsorted(turn, np.arange(n))]
        self.run = np.minimum(nxt - np.arange(n) + 1, cap).astype(np.int32)
        self.stype = np.empty(n, bool)
        self.stype[:-1] = s[nxt[:-1]] < s[np.minimum(nxt[:-1] + 1, n - 1)]
        self.stype[-1] = True
        lms = self.stype.copy()
        lms[1:] &= ~self.stype[:-1]
        lms[0] = False
        self.lms = np.flatnonzero(lms)
        self.is_lms = lms
        self.chars = np.unique(s)

    def _bucket(self, c: int, pos: np.ndarray, lcp: np.ndarray, stype: bool) -> tuple[np.ndarray, np.ndarray]:
        """A bucket's L (or S) part: what was queued, and what it induces in itself."""
        ps, ls = [pos], [lcp]
        while len(pos):
            pred = pos - 1
            k = np.flatnonzero((pos > 0) & (self.s[pred] == c) & (self.stype[pred] == stype))
            if not len(k):
                break
            new = pred[k]
            nl = np.empty(len(k), np.int32)
            nl[0] = min(self.run[pos[-1]], self.run[new[0]])
            if len(k) > 1:
                nl[1:] = np.minimum(_range_min(lcp, k) + 1, self.cap)
            ps.append(new)
            ls.append(nl)
            pos, lcp = new, nl
        return np.concatenate(ps), np.concatenate(ls)

    def _spread(self, q: Queues, c: int, scan: np.ndarray, lcp: np.ndarray, larger: bool) -> None:
        """Queues the predecessors of a bucket's scan that begin with other characters."""
        if not len(scan):
            return
        pred = scan - 1
        ch = self.s[pred]
        k = np.flatnonzero((scan > 0) & ((ch > c) if larger else (ch < c)))
        if not len(k):
            return
        ch = ch[k]
        order = np.argsort(ch.astype(np.uint16) if ch.max() < 65536 else ch, kind="stable")
        k, ch = k[order], ch[order]
        cut = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(k)]):
            g, at = int(ch[a]), k[a:z]
            nl = np.empty(z - a, np.int32)
            nl[0] = 0 if q.empty(g) else 1
            if z - a > 1:
                nl[1:] = np.minimum(_range_min(lcp, at) + 1, self.cap)
            q.push(g, scan[at] - 1, nl)

    def induce(self, lms: np.ndarray, lms_lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array and common prefixes from LMS suffixes, grouped by first character in ascending order."""
        s = self.s
        lch = s[lms]
        lo = np.searchsorted(lch, self.chars)
        hi = np.searchsorted(lch, self.chars, "right")
        q = Queues(self.folder, self.budget)
        lpart: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x, c in enumerate(self.chars.tolist()):
            pos, lcp = self._bucket(c, *q.pop(c), False)
            lpart[c] = (pos, lcp)
            m, ml = lms[lo[x] : hi[x]], lms_lcp[lo[x] : hi[x]].copy()
            if len(m):
                ml[0] = min(self.run[pos[-1]], self.run[m[0]]) if len(pos) else 0
            self._spread(q, c, np.concatenate([pos, m]), np.concatenate([lcp, ml]), True)
        q.close()
        q = Queues(self.folder, self.budget)
        sa, out = [], []
        for c in reversed(self.chars.tolist()):
            pos, lcp = (np.array([len(s) - 1]), np.zeros(1, np.int32)) if c == 0 else self._bucket(c, *q.pop(c), True)
            lp, ll = lpart.pop(c)
            down, dl = lp[::-1], np.concatenate([[0], ll[::-1][:-1]]).astype(np.int32) if len(ll) else ll
            both = min(self.run[pos[-1]], self.run[down[0]]) if len(pos) and len(down) else 0
            if len(down):
                dl[0] = both
            self._spread(q, c, np.concatenate([pos, down]), np.concatenate([lcp, dl]), False)
            up = np.concatenate([[both], lcp[::-1][:-1]]).astype(np.int32) if len(pos) else lcp
            sa.append(np.concatenate([lp, pos[::-1]]))
            out.append(np.concatenate([ll, up]))
        q.close()
        return np.concatenate(sa[::-1]), np.concatenate(out[::-1])

    def sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        s, lms, n = self.s, self.lms, len(self.s)
        if len(lms) <= 1:
            return lms, np.zeros(len(lms), np.int32)
        rough = lms[np.argsort(s[lms], kind="stable")]
        sa, _ = self.induce(rough, np.zeros(len(rough), np.int32))
        order = sa[self.is_lms[sa]]
        sums = prefix_sums(mix(s.astype(np.uint64) + np.uint64(1)), 6)
        end = np.empty(n, np.int64)  # one past the next LMS place
        end[lms] = np.minimum(np.append(lms[1:] + 1, n), n)
        h = span_hash(sums, order, end[order], 6)
        name = np.empty(n, np.int64)
        name[order] = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        names = name[lms]
        kinds = int(names.max()) + 1
        if kinds < len(lms):
            if kinds <= SMALL_ALPHABET:
                sub, _ = suffix_array(names + 1, self.cap, self.folder, self.budget)
                order = lms[sub]
            else:
                order = lms[self._doubling(names)]
        lcp = np.zeros(len(order), np.int32)
        a, b = order[:-1], order[1:]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.cap, n - np.maximum(a, b))
        while (lo < hi).any():  # the common prefix of sorted neighbours, by hashes
            mid = (lo + hi + 1) // 2
            same = span_hash(sums, a, a + mid, 6) == span_hash(sums, b, b + mid, 6)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        lcp[1:] = lo
        return order, lcp

    def _doubling(self, names: np.ndarray) -> np.ndarray:
        rank, step, m = names.astype(np.int64), 1, len(names)
        while True:
            after = np.zeros(m, np.int64)
            after[:-step or m] = rank[step:] + 1
            key = rank * (m + 2) + after
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
            step *= 2
            if rank[order[-1]] == m - 1 or step >= m or step > self.cap:
                return order


def suffix_array(s: np.ndarray, cap: int, folder: str | None = None, budget: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it, at most cap) of a string of numbers of at least 1."""
    if len(s) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    t = _Sorter(np.append(s, 0).astype(np.int64 if s.max() > 2**31 - 2 else np.int32), cap, folder, budget)
    sa, lcp = t.induce(*t.sorted_lms())
    return sa[1:], np.concatenate([[0], lcp[2:]]).astype(np.int32)  # without the end
