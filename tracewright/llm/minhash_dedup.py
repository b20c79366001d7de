"""MinHash near-duplicates by a multi-index Hamming join.

Each text's set of distinct 5-word shingles gives a signature of SLOTS b-bit MinHash
values (b = 16). Signatures are split into CHUNKS chunks of 4 slots. By the pigeonhole
principle two signatures that differ in at most 31 of 64 slots differ in at most one slot
of some chunk, so keys that leave out one slot of a chunk (the allowed chunk errors,
enumerated) make all pairs within that distance meet. A pair of similarity 0.7 misses
all 64 keys with a probability of 5e-8. What meets and agrees in at least MIN_AGREE slots
is confirmed on the full sets.

Nothing is collected per key. Texts with equal sets are one class. In each key's bucket
every class is first compared with the bucket's smallest class (a star: one pair per
member). The confirmed links are contracted to components; only buckets that still hold
several components go on. Buckets of at most BUCKET classes compare their pairs of
different components directly. The classes of larger ones (families that share a passage)
are joined by an exact prefix filter on their shingles instead: with shingles ordered
from rare to common, two sets of similarity 0.7 or more have their first common shingle
early in both, so each class is filed under its early shingles only, by its own and its
partner's size. What all members share comes last and never pairs them, so texts with a
passage in common don't meet unless enough of the rest agrees too; no pair that meets in
a large bucket is lost.

Defined cases: null and empty texts (and texts without words) have the empty set and are
linked with nothing; very long texts are sets of all their shingles, never of a part; a
null id never is a component's id, and such a row is not kept; rows with equal ids are
separate texts that carry the same id; repeated rows are linked; of equally small ids of a
component any row that has the id is kept; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, bloom, column, drop_written, lean, likely, may_hold, mix, powers, prefix_sums, slices, text_buffer, word_bounds, word_hashes, written
from .components import connected_components

SHINGLE, SLOTS, CHUNKS, WIDTH = 5, 64, 16, 4
NUMERATOR, DENOMINATOR = 70, 100
MIN_AGREE = 20
BUCKET = 64
SPLIT = 2000
PASSES = 3  # pairs are confirmed in so many turns, as sets are the bulk of what is shuffled
BAND = 1.05  # sizes within a factor of this share a band
SIG = tuple(f"s{k}" for k in range(SLOTS // 4))  # a signature as columns of 64 bits

_MULTIPLIERS = (mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)).astype(np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hashes of the distinct shingles, sorted in each document; index of each document's first)."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets, SPACE_WORDS)
    words = np.diff(first)
    sums = prefix_sums(word_hashes(data, starts, ends, lower=True), 2)
    count = np.where(words == 0, 0, np.maximum(1, words - SHINGLE + 1))
    doc = np.repeat(np.arange(n), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    size = np.minimum(words, SHINGLE)[doc]
    h = mix((sums[at + size] - sums[at]) * powers(1 << max(16, int(len(sums)).bit_length()), 2)[1][at] + size.astype(np.uint64))
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & np.uint64((1 << 48) - 1), np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(48))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[documents, SLOTS] 16-bit MinHash values; documents without shingles get zeros."""
    n = len(first) - 1
    out = np.zeros((n, SLOTS), np.uint16)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        low = (h >> np.uint64(16)).astype(np.uint32) ^ h.astype(np.uint32)
        tmp = np.empty_like(low)
        for k in range(SLOTS):
            np.multiply(low, _MULTIPLIERS[k], out=tmp)
            m = np.minimum.reduceat(tmp, first[some]).astype(np.uint64)
            out[some, k] = (mix(m) >> np.uint64(40)).astype(np.uint16)
    return out


def class_hash(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's set."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        s = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h * np.uint64(salt) + np.uint64(salt >> 7)), out=s[1:])
        out.append((s[first[1:]] - s[first[:-1]]).astype(np.int64))
    return out[0], out[1]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_buffer(column(b, "text"))
        for i, j in slices(offsets):
            h, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            h1, h2 = class_hash(h, first)
            sig = signatures(h, first).view(np.int64)
            own = [c for c in b.schema.names if c != "text"]
            yield pa.record_batch([*[column(b, c).slice(i, j - i) for c in own], pa.array(np.diff(first)), pa.array(h1), pa.array(h2), *[pa.array(np.ascontiguousarray(sig[:, k])) for k in range(len(SIG))]], names=[*own, "n_shingles", "h1", "h2", *SIG])


def _look():
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("look")


def sketches(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, look, *keep, n_shingles, h1, h2, the signature) of every document; one pass. look is the id, or a hash of the text where that is null."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _look(), *keep, F.col("text").cast("string").alias("text"))
    kept = "".join(f"`{c}` {t}, " for c, t in documents.select(*keep).dtypes)
    return docs.mapInArrow(lean(_sketch), f"doc_id long, look long, {kept}n_shingles long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in SIG))


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """[documents, CHUNKS * WIDTH] keys: each chunk with each one of its slots left out."""
    out = []
    s = sig.astype(np.uint64).reshape(len(sig), CHUNKS, WIDTH)
    for c in range(CHUNKS):
        for gap in range(WIDTH):
            k = np.full(len(sig), c * WIDTH + gap + 1, np.uint64)
            for t in range(WIDTH):
                if t != gap:
                    k = (k << np.uint64(16)) | s[:, c, t]
            out.append(mix(k ^ mix(np.full(len(sig), c * WIDTH + gap, np.uint64))))
    return np.stack(out, axis=1).astype(np.int64)


def _sig(b: pa.RecordBatch, prefix: str = "") -> np.ndarray:
    cols = [column(b, prefix + c).to_numpy(zero_copy_only=False).astype(np.int64) for c in SIG]
    return np.ascontiguousarray(np.stack(cols, axis=1)).view(np.uint16)


def _keys(filt=None):
    """The keys of classes; with a filter, those that may be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = column(b, "cls").to_numpy(zero_copy_only=False)
            k = chunk_keys(_sig(b))
            key, own = k.ravel(), np.repeat(cls, k.shape[1])
            if filt is not None:
                hit = may_hold(filt.value, key)
                key, own = key[hit], own[hit]
            yield pa.record_batch([pa.array(key), pa.array(own)], names=["key", "cls"])

    return run


def keys_of(classes: DataFrame, filt=None) -> DataFrame:
    """(key, cls): 64 keys a class."""
    return classes.where("n > 0").select("cls", *SIG).mapInArrow(lean(_keys(filt)), "key long, cls long")


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = (_sig(b, "a_") == _sig(b, "b_")).sum(1) if b.num_rows else np.zeros(0)
        keep = pa.array(same >= MIN_AGREE)
        yield pa.record_batch([column(b, "a").filter(keep), column(b, "b").filter(keep)], names=["a", "b"])


_FITS = f"{DENOMINATOR} * least(na, nb) >= {NUMERATOR} * greatest(na, nb)"


def _salted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with salt, (a, salt)): the pairs of an a with more than SPLIT of them are spread over salts."""
    parts = pairs.groupBy("a").agg((F.floor((F.count("*") - 1) / SPLIT) + 1).cast("int").alias("parts"))
    heavy = parts.where("parts > 1")
    out = pairs.join(heavy, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    return out, parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in at least MIN_AGREE slots and whose sizes allow the similarity."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{x}_{c}") for c in SIG])
    salted, centres = _salted(pairs)
    both = salted.join(side("b"), "b").join(centres.join(side("a"), "a"), ["a", "salt"])
    return both.where(_FITS).select("a", "b", *[f"a_{c}" for c in SIG], *[f"b_{c}" for c in SIG]).mapInArrow(lean(_agree), "a long, b long")


# ------------------------------------------------------------ confirmation on full sets
def _sets(filt):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filt.value
        for b in batches:
            ids = column(b, "look").to_numpy(zero_copy_only=False).astype(np.int64)
            part = b.filter(pa.array(may_hold(table, ids)))
            data, offsets = text_buffer(column(part, "text"))
            for i, j in slices(offsets):
                h, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h1, h2 = class_hash(h, first)
                six = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]) if len(h) else np.zeros((0, 6), np.uint8)
                raw = six.tobytes()
                yield pa.record_batch([column(part, "look").slice(i, j - i), pa.array(h1), pa.array(h2), pa.array([raw[6 * s : 6 * e] for s, e in zip(first[:-1], first[1:])], pa.binary())], names=["look", "h1", "h2", "set"])

    return run


def full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, set) for the classes wanted (cls, look, h1, h2), a written table: the texts are read again, and a filter lets only likely ones through.

    Rows with equal look (repeated ids or texts) may give a class's set more than once; a
    row's number tells them apart, and the smallest stays, so no set goes through an
    aggregation.
    """
    filt = bloom(wanted.select(F.col("look").alias("id")))
    docs = documents.select(_look(), F.col("text").cast("string").alias("text"))
    got = docs.mapInArrow(lean(_sets(filt)), "look long, h1 long, h2 long, set binary")
    found = written(got.join(wanted.select("cls", "look", "h1", "h2"), ["look", "h1", "h2"]).select("cls", "set").withColumn("r", F.monotonically_increasing_id()))
    twice = found.groupBy("cls").agg(F.min("r").alias("r"), F.count("*").alias("times")).where("times > 1").select("cls", F.col("r").alias("only"))
    if twice.isEmpty():
        return found.select("cls", "set")
    return found.join(twice, "cls", "left").where("only is null or r = only").select("cls", "set")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (a, salt, b is not null): a centre's set, then the members'."""
    centre, own = None, None
    for b in batches:
        a_, s_, b_, sets = (column(b, n).to_pylist() for n in ("a", "salt", "b", "set"))
        out = []
        for a, s, other, raw in zip(a_, s_, b_, sets):
            h = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            wide = np.zeros((len(h), 8), np.uint8)
            wide[:, :6] = h
            mine = wide.view(np.uint64).ravel()
            if other is None:
                centre, own = (a, s), mine
            elif (a, s) == centre:
                at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                inter = int((own[at] == mine).sum())
                if DENOMINATOR * inter >= NUMERATOR * (len(own) + len(mine) - inter):
                    out.append((a, other))
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are similar on full sets. Each pair ships b's set to a; a's with many pairs are spread over salts.

    Both are written tables, and so is the result. Every b has its turn, and a turn shuffles
    only the sets of its own pairs, so that disk holds a part of the shuffled sets at a time.
    """
    done = []
    for k in range(PASSES):
        turn = pairs.where(F.pmod(F.hash("b"), F.lit(PASSES)) == k)
        some = sets.mapInArrow(lean(likely(bloom(_ends(turn).withColumnRenamed("cls", "id")), "cls")), sets.schema)
        salted, centres = _salted(turn)
        members = salted.join(some.select(F.col("cls").alias("b"), "set"), "b").select("a", "salt", "b", "set")
        heads = centres.join(some.select(F.col("cls").alias("a"), "set"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "set")
        rows = members.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        done.append(written(rows.mapInArrow(lean(_confirm), "a long, b long")))
    return reduce(DataFrame.unionAll, done)


# ------------------------------------------------------------ large buckets: prefix filter
def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls = column(b, "cls").to_numpy(zero_copy_only=False)
        sets = column(b, "set").to_pylist()
        size = np.array([len(x) // 6 for x in sets], np.int64)
        cut, at = np.cumsum(size), 0
        while at < len(sets):  # about a million shingles at a time
            to = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + 1_000_000, "right")))
            wide = np.zeros((int(size[at:to].sum()), 8), np.uint8)
            wide[:, :6] = np.frombuffer(b"".join(sets[at:to]), np.uint8).reshape(-1, 6)
            yield pa.record_batch([pa.array(wide.view(np.int64).ravel()), pa.array(np.repeat(cls[at:to], size[at:to]))], names=["tok", "cls"])
            at = to


def _band(n) -> F.Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("int")


def filed(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """(tok, own, partner, cls, comp, n, rest): each class under its early shingles and the bands of sizes that a partner first met there can have.

    comps: (cls, n, comp). rest counts the shingles from this one on, in the order from rare
    to common; a partner of nb shingles first met here needs 7 (n + nb) <= 17 rest. Shingles
    of one class only come first of all, and no partner is met there.
    """
    tokens = sets.mapInArrow(lean(_tokens), "tok long, cls long")
    often = tokens.groupBy("tok").agg(F.count("*").alias("often")).where("often > 1")
    shared = tokens.join(often, "tok")
    place = Window.partitionBy("cls").orderBy(F.col("often").desc(), F.col("tok").desc())
    early = shared.withColumn("rest", F.row_number().over(place)).join(comps, "cls")
    extra = DENOMINATOR + NUMERATOR
    most = F.least((F.col("rest") * extra - F.col("n") * NUMERATOR) / NUMERATOR, F.col("n") * DENOMINATOR / NUMERATOR)
    least = F.greatest(F.col("n") * NUMERATOR / DENOMINATOR, F.lit(1.0))
    early = early.withColumns({"most": most, "least": least, "own": _band(F.col("n"))}).where("most >= least - 1e-6")
    # bands are widened by a hair, so that rounding loses nothing; sizes are compared exactly later
    bands = F.sequence(_band(F.col("least") * (1 - 1e-9)), _band(F.col("most") * (1 + 1e-9)))
    return early.select("tok", "own", F.explode(bands).alias("partner"), "cls", "comp", "n", "rest")


def prefix_pairs(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that may be similar, a superset of the similar ones."""
    rows = written(filed(sets, comps).withColumns({"lo": F.least("own", "partner"), "hi": F.greatest("own", "partner")}))
    key = ["tok", "lo", "hi"]
    by_comp = rows.groupBy(*key, "comp").agg(F.count("*").alias("m"))
    mixed = by_comp.groupBy(*key).agg(F.count("*").alias("kinds"), F.max_by("comp", "m").alias("main")).where("kinds > 1").select(*key, "main")
    several = rows.join(mixed, key)
    # a group's members of its main component never meet one another
    l = several.where(F.col("comp") != F.col("main")).select(*key, "own", F.col("cls").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))  # noqa: E741
    r = several.select(*key, F.col("partner").alias("own"), F.col("cls").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    enough = F.lit(DENOMINATOR + NUMERATOR) * F.least("ra", "rb") >= F.lit(NUMERATOR) * (F.col("na") + F.col("nb"))
    met = l.join(r, [*key, "own"]).where((F.col("ca") != F.col("cb")) & F.expr(_FITS) & enough)
    out = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    drop_written(rows)
    return out


# ------------------------------------------------------------ the join
def _pairs(keys: DataFrame) -> DataFrame:
    """Pairs of different components that share a key."""
    l = keys.select("key", F.col("cls").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"))  # noqa: E741
    r = keys.select("key", F.col("cls").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
    return l.join(r, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & F.expr(_FITS)).select("a", "b").distinct()


def _sets_of(documents: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    return full_sets(documents, written(classes.join(ids.distinct(), "cls", "left_semi").select("cls", "look", "h1", "h2")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls")))


def links(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): confirmed links between classes (cls, rep, look, n, h1, h2, the signature), enough of them that no component is missed; written tables. Those of classes are deleted."""
    centres = written(keys_of(classes).groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("a")).where("size > 1"))
    shared = written(keys_of(classes, bloom(centres.select(F.col("key").alias("id")))).join(centres, "key"))
    drop_written(centres)
    active = written(classes.join(shared.select("cls").distinct(), "cls", "left_semi"))
    drop_written(classes)
    star = written(near(shared.where("a <> cls").select("a", F.col("cls").alias("b")).distinct(), active))
    sets = _sets_of(documents, active, _ends(star))
    found = confirm(star, sets)
    drop_written(sets)
    # buckets that still hold several components
    comps = connected_components(found)
    named = written(active.select("cls", "n").join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", F.coalesce("component", "cls").alias("comp")))
    drop_written(comps)
    labelled = shared.select("key", "cls", "size").join(named, "cls")
    several = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    mixed = written(labelled.join(several, "key"))
    drop_written(shared)
    small = written(near(_pairs(mixed.where(F.col("size") <= BUCKET)).join(star, ["a", "b"], "left_anti"), active))
    large = written(mixed.where(F.col("size") > BUCKET).select("cls").distinct())
    drop_written(mixed)
    if small.isEmpty() and large.isEmpty():
        drop_written(active, star, named, small, large)
        return found
    sets = _sets_of(documents, active, _ends(small).unionAll(large))
    pairs = small
    if not large.isEmpty():
        met = prefix_pairs(sets.join(large, "cls", "left_semi"), named.join(large, "cls", "left_semi"))
        pairs = written(small.unionAll(near(met.join(star, ["a", "b"], "left_anti"), active)).distinct())
        drop_written(met)
    out = found.unionAll(confirm(pairs, sets))
    drop_written(sets, active, star, named, small, large, pairs)
    return out


def linked(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_shingles, component, component_id), one row per row of documents.

    component tells groups apart even where they share component_id, their smallest id
    (rows with equal ids may be of different groups, and a group may have no id at all).
    """
    sk = written(sketches(documents, keep).withColumn("cls", F.xxhash64("h1", "h2", "n_shingles")))
    # equal in all rows of a class but for the ids, so the largest is any
    same = [F.max("n_shingles").alias("n"), *[F.max(c).alias(c) for c in ("h1", "h2", *SIG)]]
    classes = written(sk.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("look").alias("look"), *same))
    # signatures are most of both tables and are needed no longer than that
    rows, reps = written(sk.select("doc_id", *keep, "n_shingles", "cls")), written(classes.select("cls", "rep"))
    drop_written(sk)
    found = links(documents, classes)
    comps = connected_components(found)
    named = reps.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = written(named.join(least, "component").select("cls", "component", "component_id"))
    drop_written(reps, found, comps)
    return rows.join(ids, "cls").select("doc_id", *keep, "n_shingles", "component", "component_id")


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of documents."""
    out = linked(documents)
    # texts without words are linked with nothing, so each such row is its own component
    comp = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))
