"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The model (a file path, never copied) is of the pair-merging kind. A sequence of pieces
is a text's encoding exactly if every two neighbours are what their own concatenation
encodes to, so encoding is a search for the one path of weight 0 in a lattice whose
states are (end of the last piece, last piece) and whose transitions weigh 0 or minus
infinity. A text of more than GIANT characters becomes chunk rows of GIANT characters,
spread over the cluster. A chunk's transfer matrix holds, for each state in which it can be
entered and each in which it can be left, the weight of the best path (max-plus). Matrices
are combined associatively: the chunks of each BLOCK to one matrix, blocks along a text,
and back, which fixes every chunk's entry and exit; then each chunk is traced back by
itself. What no chunk boundary touches stands between white-space marks after another
character, over which no piece can stretch; there is one boundary state at such places, so
what stands between them is encoded once per distinct string by the library, as are texts
of at most GIANT characters. Strings of over RUN characters without such a place go
through the lattice themselves. The caches are emptied when full, and never change a
result.

Defined cases: null and empty texts have no tokens; very long texts give what the library
gives on the whole; U+2581 in a text is the model's white-space mark and comes back as a
space; characters without a piece come back through byte pieces; repeated rows and rows
with equal ids are each encoded; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop_written, lean, written

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK, RUN, CACHE = 256, 512, 150_000
GIANT, BLOCK = 16_384, 64
NEG = -np.inf
State = tuple[int, str]  # (end of the last piece, the piece)


class Model:
    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor()
        self.sp.LoadFromSerializedProto(proto)
        n = self.sp.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.raw: list[bytes] = []
        for i in range(n):
            p = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.pieces[p] = i
                self.raw.append(p.replace(MARK, " ").encode())
        self.longest = max(map(len, self.pieces))
        self.inner_mark = any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.sep = next(c for c in ("\n", "", "", "\U000fffff") if all(c not in p for p in self.pieces))
        self.lead = len(self.sp.encode(self.sep))
        self.fits: dict[tuple[str, str], bool] = {}

    # ------------------------------------------------------------ pieces
    def bare(self, s: str) -> list[int]:
        """Ids of s as it stands inside a text (s has marks for spaces, and no mark is put before it)."""
        return self.sp.encode(self.sep + s)[self.lead :]

    def fit(self, a: str, b: str) -> bool:
        """Weight 0 or minus infinity: whether b may follow a."""
        if a not in self.pieces or b not in self.pieces:
            return True  # nothing merges with a character that has no piece
        key = (a, b)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[key] = self.bare(a + b) == [self.pieces[a], self.pieces[b]]
        return known

    def spans_over(self, s: str, b: int) -> list[State]:
        """All states at the boundary b: pieces that begin before b and end at or after it."""
        out = []
        for a in range(max(0, b - self.longest), b):
            for e in range(b, min(len(s), a + self.longest) + 1):
                if s[a:e] in self.pieces or e - a == 1:
                    out.append((e, s[a:e]))
        return out

    # ------------------------------------------------------------ one chunk
    def walk(self, s: str, entry: State | None, stop: int) -> dict[int, tuple[str, int]]:
        """end -> (last piece, its start) for all ends that are reachable from entry by pieces that begin before stop.

        From one entry there is at most one last piece for each end.
        """
        start = entry[0] if entry else 0
        last: dict[int, tuple[str, int]] = {start: (entry[1] if entry else "", -1)}
        for e in range(start + 1, min(len(s), stop + self.longest - 1) + 1):
            for a in range(max(start, e - self.longest), min(e, stop)):
                if a in last:
                    p = s[a:e]
                    if (p in self.pieces or (e - a == 1)) and (not last[a][0] or self.fit(last[a][0], p)):
                        last[e] = (p, a)
                        break
        return last

    def transfer(self, s: str, entries: list[State | None], stop: int, exits: list[State]) -> np.ndarray:
        """The max-plus matrix of one chunk."""
        m = np.full((len(entries), len(exits)), NEG)
        at = {x: j for j, x in enumerate(exits)}
        for i, entry in enumerate(entries):
            if entry and entry[0] >= stop:  # a piece that covers the whole chunk
                if entry in at:
                    m[i, at[entry]] = 0.0
                continue
            for e, (p, a) in self.walk(s, entry, stop).items():
                if e >= stop and a >= 0 and (e, p) in at:
                    m[i, at[(e, p)]] = 0.0
        return m

    def scan(self, s: str, chunk: int = CHUNK) -> list[int]:
        """Ids of a string with marks in which no forced cut is used: chunks, matrices, combination, backtrace."""
        bounds = [*range(chunk, len(s), chunk), len(s)]
        states: list[list] = [[None], *[self.spans_over(s, b) for b in bounds[:-1]]]
        states.append([x for x in self.spans_over(s, len(s)) if x[0] == len(s)])
        mats = [self.transfer(s, states[k], b, states[k + 1]) for k, b in enumerate(bounds)]
        # prefix products: which states are reached, and by them the one path
        reach = [np.zeros(1)]
        for m in mats:
            reach.append(max_plus(reach[-1][None, :], m)[0])
        j = int(np.argmax(reach[-1]))
        chosen: list[State | None] = [states[-1][j]]
        for k in range(len(mats) - 1, -1, -1):
            i = int(np.argmax(reach[k] + mats[k][:, j]))
            chosen.append(states[k][i])
            j = i
        chosen.reverse()
        out: list[int] = []
        for k, b in enumerate(bounds):
            out += self.trace(s, chosen[k], b, chosen[k + 1])
        return out

    def trace(self, s: str, entry: State | None, stop: int, leave: State) -> list[int]:
        """The pieces that one chunk adds between its entry and its exit."""
        if entry and entry[0] >= stop:
            return []
        last = self.walk(s, entry, stop)
        found, e = [], leave[0]
        start = entry[0] if entry else 0
        while e > start:
            p, a = last[e]
            found.append(p)
            e = a
        ids: list[int] = []
        for p in reversed(found):
            ids += [self.pieces[p]] if p in self.pieces else self.bare(p)
        return ids

    # ------------------------------------------------------------ texts
    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of strings that each stand after one mark, as 4-byte little-endian numbers."""
        short = [w for w in words if len(w) <= RUN]
        done = dict(zip(short, self.sp.encode(short, num_threads=1))) if short else {}
        if "" in done:  # a mark alone, at a text's end
            done[""] = self.bare(MARK)
        return [np.array(done[w] if len(w) <= RUN else self.long_word(w), "<i4").tobytes() for w in words]

    def long_word(self, w: str) -> list[int]:
        s = MARK + w.replace(" ", MARK)
        out: list[int] = []
        at = 0
        for k in range(1, len(s) + 1):  # forced cuts: beside characters without a piece
            if k == len(s) or s[k] not in self.pieces or s[k - 1] not in self.pieces or (s[k] == MARK and s[k - 1] != MARK and not self.inner_mark):
                part = s[at:k]
                out += self.scan(part) if len(part) > RUN else self.bare(part)
                at = k
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), NEG)


class Encoder:
    """Encodes batches of texts; distinct words are encoded once while they stay in the cache."""

    def __init__(self, proto: bytes):
        self.model = Model(proto)
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        t = text.replace(MARK, " ")
        if self.model.inner_mark:
            return [t]
        parts = t.split(" ")
        if "" in parts[1:] or (parts and parts[0] == "" and len(parts) > 1):
            out, gap = [], ""  # runs of spaces go with the word that they precede
            for k, p in enumerate(parts):
                if p == "" and k < len(parts) - 1:
                    gap += " "
                else:
                    out.append(gap + p)
                    gap = ""
            return out
        return parts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for t in texts:
            if not t:
                out.append(b"")
                continue
            words = self.words(t)
            fresh = list({w for w in words if w not in cache})
            if fresh:
                cache.update(zip(fresh, self.model.encode_words(fresh)))
            out.append(b"".join(map(cache.__getitem__, words)))
            if len(cache) > 2 * CACHE:
                cache.clear()
        return out


# ------------------------------------------------------------ giant texts as chunk rows
def marked(text: str) -> str:
    """The string that the model works on."""
    return MARK + text.replace(" ", MARK)


@dataclass
class Chunk:
    """A part of a marked string with as much around it as a piece can reach."""

    s: str
    lo: int  # where the part begins and ends in s
    hi: int
    k: int
    last: bool

    def entries(self, m: Model) -> list[State | None]:
        return m.spans_over(self.s, self.lo) if self.k else [None]

    def exits(self, m: Model) -> list[State]:
        return [x for x in m.spans_over(self.s, self.hi) if not self.last or x[0] == self.hi]

    def cuts(self, m: Model, entries: list[State | None]) -> tuple[int, int] | None:
        """The first and the last place that no piece stretches over, behind all entries; none: the lattice is walked throughout."""
        if m.inner_mark:
            return None
        at = max([self.lo + 1, *(x[0] for x in entries if x)])
        while (at := self.s.find(MARK, at, self.hi)) >= 0 and self.s[at - 1] == MARK:
            at += 1
        if at < 0:
            return None
        z = self.s.rfind(MARK, at, self.hi)
        while self.s[z - 1] == MARK:
            z -= 1
        return at, max(z, at)

    def matrix(self, m: Model) -> np.ndarray:
        """Which exits can be reached from which entries: weights 0 and minus infinity."""
        entries, exits = self.entries(m), self.exits(m)
        cuts = self.cuts(m, entries)
        if cuts is None:
            return m.transfer(self.s, entries, self.hi, exits)
        head = np.array([0.0 if self._head(m, x, cuts[0]) else NEG for x in entries])[:, None]
        return max_plus(head, m.transfer(self.s, [(cuts[1], "")], self.hi, exits))

    def _head(self, m: Model, entry: State | None, cut: int) -> bool:
        at = entry[0] if entry else 0
        return at == cut or cut in m.walk(self.s, entry, cut)

    def ids(self, e: "Encoder", enter: int, leave: int) -> tuple[bytes, int, int]:
        """(ids, start, end in s) of the pieces between an entry and an exit."""
        m = e.model
        entries = self.entries(m)
        entry, leaving = entries[enter], self.exits(m)[leave]
        at = entry[0] if entry else 0
        cuts = self.cuts(m, entries)
        if cuts is None:
            return np.array(m.trace(self.s, entry, self.hi, leaving), "<i4").tobytes(), at, leaving[0]
        a, z = cuts
        head = [] if at == a else m.trace(self.s, entry, a, (a, ""))
        middle = e.encode([self.s[a + 1 : z].replace(MARK, " ")])[0] if z > a else b""
        tail = m.trace(self.s, (z, ""), self.hi, leaving)
        return np.array(head, "<i4").tobytes() + middle + np.array(tail, "<i4").tobytes(), at, leaving[0]


def chunks_of(text: str, reach: int, size: int) -> Iterator[Chunk]:
    s = marked(text)
    n = max(1, -(-len(s) // size))
    for k in range(n):
        a, z = k * size, min(len(s), (k + 1) * size)
        lo = max(0, a - reach)
        yield Chunk(s[lo : z + reach], a - lo, z - lo, k, k == n - 1)


def reached(mats: list[np.ndarray], enter: int, leave: int | None) -> list[int]:
    """The states on the best path through a row of matrices, from enter to leave (or to the best)."""
    first = np.full(mats[0].shape[0], NEG)
    first[enter] = 0.0
    reach = [first]
    for m in mats:
        reach.append(max_plus(reach[-1][None, :], m)[0])
    j = int(np.argmax(reach[-1])) if leave is None else leave
    out = [j]
    for k in range(len(mats) - 1, -1, -1):
        j = int(np.argmax(reach[k] + mats[k][:, j]))
        out.append(j)
    return out[::-1]


_CHUNK = "uid long, k int, n_chunks int, lo int, hi int, s string"


def _cut(reach: int, size: int, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                held: list[Chunk] = []
                uid, text = column(row, "uid")[0].as_py(), column(row, "text")[0].as_py()
                n = max(1, -(-(len(text) + 1) // size))

                def batch(held: list[Chunk], row=row, uid=uid, n=n) -> pa.RecordBatch:
                    x = len(held)
                    own = [column(row, c).take(pa.array([0 if h.k == 0 else None for h in held], pa.int32())) for c in keep]
                    cols = [pa.array([uid] * x, pa.int64()), pa.array([h.k for h in held], pa.int32()), pa.array([n] * x, pa.int32()), pa.array([h.lo for h in held], pa.int32()), pa.array([h.hi for h in held], pa.int32()), pa.array([h.s for h in held], pa.string())]
                    return pa.record_batch([*cols, *own], names=["uid", "k", "n_chunks", "lo", "hi", "s", *[f"keep_{j}" for j in range(len(keep))]])

                for c in chunks_of(text, reach, size):
                    held.append(c)
                    if len(held) == 64:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    return run


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
    for uid, k, n, lo, hi, s in zip(*(column(b, c).to_pylist() for c in ("uid", "k", "n_chunks", "lo", "hi", "s"))):
        yield uid, Chunk(s, lo, hi, k, k == n - 1)


def _packed(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    """Rows of (numbers..., matrix)."""
    cols = [pa.array([r[x] for r in rows], pa.int64()) for x in range(len(names))]
    m = [r[-1] for r in rows]
    return pa.record_batch([*cols, pa.array([x.shape[0] for x in m], pa.int32()), pa.array([(x == 0).tobytes() for x in m], pa.binary())], names=[*names, "r", "m"])


def _matrix(r: int, m: bytes) -> np.ndarray:
    return np.where(np.frombuffer(m, bool).reshape(r, -1), 0.0, NEG)


def _matrices(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(proto)
        for b in batches:
            yield _packed([(uid, c.k // BLOCK, c.k, c.matrix(model)) for uid, c in _rows(b)], ("uid", "blk", "k"))

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], *cols: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows that come sorted by key."""
    now, held = None, []
    for b in batches:
        for k, row in zip(zip(*(column(b, c).to_pylist() for c in key)), zip(*(column(b, c).to_pylist() for c in cols))):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(row)
    if held:
        yield now, held


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's matrices become one."""
    for (uid, blk), rows in _grouped(batches, ("uid", "blk"), "r", "m"):
        yield _packed([(uid, blk, reduce(max_plus, [_matrix(r, m) for r, m in rows]))], ("uid", "blk"))


def _along(key: tuple[str, ...], step: str, fixed: bool):
    """The states before and after each matrix of a row of them; fixed: the row's own first and last states are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in _grouped(batches, key, step, "r", "m", *(("enter", "leave") if fixed else ())):
            states = reached([_matrix(x[1], x[2]) for x in rows], *(rows[0][3:5] if fixed else (0, None)))
            yield pa.record_batch([pa.array([k[0]] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int64()), pa.array(states[:-1], pa.int64()), pa.array(states[1:], pa.int64())], names=["uid", step, "enter", "leave"])

    return run


def _traced(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(proto)
        for b in batches:
            ids, back = [], []
            for (_, c), enter, leave in zip(_rows(b), column(b, "enter").to_pylist(), column(b, "leave").to_pylist()):
                raw, a, z = c.ids(e, enter, leave)
                ids.append(raw)
                back.append(b"".join(map(e.model.raw.__getitem__, np.frombuffer(raw, "<i4").tolist())) == c.s[a:z].replace(MARK, " ").encode())
            own = [n for n in b.schema.names if n.startswith("keep_")]
            yield pa.record_batch([column(b, "uid"), column(b, "k"), *[column(b, n) for n in own], pa.array(ids, pa.binary()), pa.array(back)], names=["uid", "k", *own, "raw", "back"])

    return run


def _joined(keep: tuple[str, ...], whole: bool):
    """Chunks of a text, in order, become its row: digests as a stream, or its ids."""
    names = [f"keep_{j}" for j in range(len(keep))]

    def close(first: pa.RecordBatch, n: int, sha, back: bool, parts: list[bytes]) -> pa.RecordBatch:
        own = [column(first, c) for c in names]
        if whole:
            return pa.record_batch([*own, pa.array([np.frombuffer(b"".join(parts), "<i4")], pa.list_(pa.int32()))], names=[*keep, "ids"])
        return pa.record_batch([*own, pa.array([n], pa.int64()), pa.array([sha.hexdigest()]), pa.array([back])], names=[*keep, "n_tokens", "ids_sha256", "round_trip"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for i, (k, raw, back) in enumerate(zip(*(column(b, c).to_pylist() for c in ("k", "raw", "back")))):
                if k == 0:
                    if state:
                        yield close(*state)
                    state = [b.slice(i, 1), 0, hashlib.sha256(), True, []]
                state[1] += len(raw) // 4
                state[2].update(raw)
                state[3] &= back
                if whole:
                    state[4].append(raw)
        if state:
            yield close(*state)

    return run


def _giants(df: DataFrame, keep: tuple[str, ...], proto: bytes, whole: bool, size: int) -> DataFrame | None:
    """The rows of texts of more than size characters, by chunks; None if there are none."""
    kinds = dict(df.dtypes)
    own = ", ".join(f"keep_{j} {kinds[c]}" for j, c in enumerate(keep))
    rows = df.where(F.length("text") > size).select(F.monotonically_increasing_id().alias("uid"), *keep, "text")
    chunks = written(rows.mapInArrow(lean(_cut(Model(proto).longest, size, keep)), f"{_CHUNK}, {own}"))
    if chunks.isEmpty():
        drop_written(chunks)
        return None
    spread = chunks.repartition(F.xxhash64("uid", "k"))
    mats = written(spread.mapInArrow(lean(_matrices(proto)), "uid long, blk long, k long, r int, m binary"))
    by_block = mats.repartition("uid", "blk").sortWithinPartitions("uid", "blk", "k")
    blocks = by_block.mapInArrow(lean(_products), "uid long, blk long, r int, m binary")
    ends = blocks.repartition("uid").sortWithinPartitions("uid", "blk").mapInArrow(lean(_along(("uid",), "blk", False)), "uid long, blk long, enter long, leave long")
    inner = mats.join(ends, ["uid", "blk"]).repartition("uid", "blk").sortWithinPartitions("uid", "blk", "k")
    states = written(inner.mapInArrow(lean(_along(("uid", "blk"), "k", True)), "uid long, k long, enter long, leave long"))
    traced = spread.join(states, ["uid", "k"]).mapInArrow(lean(_traced(proto)), f"uid long, k int, {own}, raw binary, back boolean")
    out = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (", ids array<int>" if whole else ", n_tokens long, ids_sha256 string, round_trip boolean")
    return traced.repartition("uid").sortWithinPartitions("uid", "k").mapInArrow(lean(_joined(keep, whole)), out)


def _proto(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _run(proto: bytes, finish: Callable[[Encoder, pa.RecordBatch, list[bytes], list[str | None]], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(proto)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = column(part, "text").to_pylist()
                yield finish(encoder, part, encoder.encode(texts), texts)

    return run


def _all(documents: DataFrame, keep: tuple[str, ...], model: str, whole: bool, size: int) -> DataFrame:
    proto = _proto(model)
    df = documents.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + (", ids array<int>" if whole else ", n_tokens long, ids_sha256 string, round_trip boolean")
    short = df.where(F.coalesce(F.length("text") <= size, F.lit(True))).mapInArrow(lean(_run(proto, _ids if whole else _digest)), schema)
    giant = _giants(df, keep, proto, whole, size)
    return short if giant is None else short.unionAll(giant)


def _ids(encoder: Encoder, b: pa.RecordBatch, ids: list[bytes], texts: list[str | None]) -> pa.RecordBatch:
    arrays = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
    return pa.record_batch([*[column(b, c) for c in b.schema.names if c != "text"], arrays], names=[*[c for c in b.schema.names if c != "text"], "ids"])


def encode(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = DEFAULT_MODEL, giant: int = GIANT) -> DataFrame:
    """keep and ids (array of piece ids) of every document. Texts of at most giant characters aren't shuffled; longer ones go through chunk rows."""
    return _all(documents, keep, model, True, giant)


def _texts(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(proto)
        for b in batches:
            texts = [m.decode(np.array(x or [], "<i4")) for x in column(b, "ids").to_pylist()]
            yield pa.record_batch([*[column(b, c) for c in b.schema.names if c != "ids"], pa.array(texts, pa.string())], names=[*[c for c in b.schema.names if c != "ids"], "text"])

    return run


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = DEFAULT_MODEL) -> DataFrame:
    """keep and text of rows with ids."""
    df = encoded.select(*keep, "ids")
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", text string"
    return df.mapInArrow(lean(_texts(_proto(model))), schema)


def _digest(encoder: Encoder, b: pa.RecordBatch, ids: list[bytes], texts: list[str | None]) -> pa.RecordBatch:
    back = [encoder.model.decode(np.frombuffer(x, "<i4")) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts)]
    names = [c for c in b.schema.names if c != "text"]
    return pa.record_batch(
        [*[column(b, c) for c in names], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)],
        names=[*names, "n_tokens", "ids_sha256", "round_trip"],
    )


def digest(documents: DataFrame, model: str = DEFAULT_MODEL, keep: tuple[str, ...] = ("doc_id",), giant: int = GIANT) -> DataFrame:
    """Per document: number of tokens, digest of the ids (4-byte little-endian), and whether decoding gives the text back."""
    return _all(documents, keep, model, False, giant)
