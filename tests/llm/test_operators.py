"""The ten operators against brute force, on texts that are null, empty, long, repeated and tied."""

import collections
import hashlib
import json
import os
import random
import re
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("tracewright.llm")
from tracewright.llm import chat_format, debruijn_dedup, decontaminate, lcp_fingerprint, license_scan, minhash_dedup, pii, quality_fm, suffix_dedup  # noqa: E402
from tracewright.llm import sentencepiece_scan as sps  # noqa: E402
from tracewright.llm.components import connected_components  # noqa: E402
from tracewright.llm.suffix_array import suffix_array  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, name string, start long, score double, items string, text_hash long, cls long, spans string"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def frame(spark, rows):
    extra = (7, "x", 3, 0.5, "y", 9, 4, "z")
    return spark.createDataFrame([(i, t, "en", "src0", None, *extra) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, base, long = say(90), say(120), say(9000)
    rows = [(i, say(r.randint(1, 150))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \t\n "), (43, "one two"), (44, "One TWO"), (45, long), (46, long + " tail"), (47, "a" * 3000), (48, "x" * 450 + "y" + "x" * 450)]
    rows += [(50 + k, f"{say(20)} {shared}\n{say(30)}") for k in range(4)]
    words = base.split()
    for k in range(5):  # near copies that form a chain
        words = list(words)
        words[k * 20] = f"new{k}"
        rows.append((60 + k, " ".join(words)))
    rows += [(60, " ".join(words).upper()), (70, base), (70, base), (None, base + " end"), (None, None), (71, base.replace(" ", "  "))]
    rows += [(80, say(300) + " " + shared[:200])]
    return rows


def by_rows(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- 1
def test_near_duplicates(spark, corpus):
    def shingles(t):
        w = SPACES.findall(lower(t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in corpus]
    comp = list(range(len(corpus)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 70 * len(a | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(corpus):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = collections.Counter()
    for i, (d, _) in enumerate(corpus):
        c = least.get(root(i)) if sets[i] else d
        want[(d, len(sets[i]), c, d is not None and d == c)] += 1
    got = by_rows(minhash_dedup.groups(frame(spark, corpus)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == want


def test_disk_is_freed_on_the_way(spark, corpus):
    from tracewright.llm.common import shared_dir, written

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    blocks = lambda: {disk.getAllBlocks().apply(k).name() for k in range(disk.getAllBlocks().size())}
    tables = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("tracewright-")}
    old = blocks()
    written(spark.range(1000).repartition(4))
    for _ in range(50):  # Spark deletes them in the background
        left = {x for x in blocks() - old if x.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.2)
    assert not left
    old = tables()
    minhash_dedup.linked(frame(spark, corpus))
    assert not [x for x in tables() - old if minhash_dedup.SIG[0] in spark.read.parquet(f"{shared_dir(spark)}/{x}").columns]


def test_large_bucket_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BUCKET", 3)
    r = random.Random(2)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    core = say(160)
    rows = [(i, core + " " + say(45 if i % 2 else 100)) for i in range(14)]
    got = {x.doc_id: x.component_id for x in minhash_dedup.groups(frame(spark, rows)).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 70 * len(a | sets[j]):
                assert got[i] == got[j]


def _filed_sets(spark, texts):
    """(sets, comps, python sets) of some texts, each a component of its own."""
    own = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    rows = [(i, b"".join(hash(x).to_bytes(8, "little", signed=True)[:6] for x in o)) for i, o in enumerate(own)]
    return spark.createDataFrame(rows, "cls long, set binary"), spark.createDataFrame([(i, len(o), i) for i, o in enumerate(own)], "cls long, n long, comp long"), own


def test_prefix_filter_pairs_all_similar_sets(spark):
    r = random.Random(21)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = [" ".join(say(r.randint(1, 9))) for _ in range(10)]
    for size in (6, 20, 100, 300):
        core = say(size)
        for k in range(14):  # from nearly equal to barely related, longer and shorter
            w = list(core)
            for _ in range(r.randint(0, size // 50)):
                w[r.randrange(size)] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w[: size - r.randint(0, size // 6)] + say(r.randint(0, size // 8))))
    sets, comps, own = _filed_sets(spark, texts)
    want = {(i, j) for j in range(len(own)) for i in range(j) if 100 * len(own[i] & own[j]) >= 70 * len(own[i] | own[j])}
    got = {(x.a, x.b) for x in minhash_dedup.prefix_pairs(sets, comps).collect()}
    assert len(want) > 60 and want <= got
    one = comps.withColumn("comp", F.lit(5).cast("long"))
    assert minhash_dedup.prefix_pairs(sets, one).count() == 0


def test_a_shared_passage_makes_no_pairs(spark):
    r = random.Random(22)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = say(200)
    for share in (100, 60):  # similarities of about 0.5 and 0.62
        sets, comps, _ = _filed_sets(spark, [f"{say(share // 2)} {passage} {say(share - share // 2)}" for _ in range(150)])
        assert minhash_dedup.prefix_pairs(sets, comps).count() == 0


def test_signature_keys_meet_within_the_distance():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**16, (200, minhash_dedup.SLOTS)).astype(np.uint16)
    b = a.copy()
    for k in range(len(a)):
        b[k, r.choice(minhash_dedup.SLOTS, 31, replace=False)] ^= 1
    assert ((minhash_dedup.chunk_keys(a) == minhash_dedup.chunk_keys(b)).any(1)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


# ---------------------------------------------------------------- 2
@pytest.mark.parametrize("hot, budget", [(5000, None), (5000, 1000), (1, None)])
def test_suffix_dedup(spark, corpus, monkeypatch, hot, budget):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "QUEUE_BYTES", budget or suffix_dedup.QUEUE_BYTES)
    queues = suffix_dedup._queue_folder(frame(spark, [])).removeprefix("file://")
    shutil.rmtree(queues, ignore_errors=True)
    raw = [(d, (t or "").encode()) for d, t in corpus]
    seen = collections.Counter(x[k : k + 400] for _, x in raw for k in range(len(x) - 399))
    want = collections.Counter()
    for d, x in raw:
        m = bytearray(len(x))
        for k in range(len(x) - 399):
            if seen[x[k : k + 400]] > 1:
                m[k : k + 400] = b"\1" * 400
        kept = bytes(c for c, z in zip(x, m) if not z)
        want[(d, len(x), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest())] += 1
    got = by_rows(suffix_dedup.digest(frame(spark, corpus)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want
    if budget:  # the queues went to the shared folder, and are gone from it
        assert os.path.isdir(queues) and not os.listdir(queues)


def test_suffix_array(tmp_path):
    r = random.Random(3)
    for t in range(60):
        n, k = r.choice([1, 2, 9, 60, 150]), r.choice([1, 2, 4, 26])
        s = [r.randint(1, k) for _ in range(n)]
        if t % 2:
            s = (s[: max(1, n // 4)] * 5)[:n]
        sa, lcp = suffix_array(np.array(s), 10**6, f"file://{tmp_path}" if t % 3 else None, 64)
        want = sorted(range(n), key=lambda i: s[i:])
        assert sa.tolist() == want
        for x, (a, b) in enumerate(zip(want, want[1:])):
            c = 0
            while max(a, b) + c < n and s[a + c] == s[b + c]:
                c += 1
            assert lcp[x + 1] == c
    assert not list(tmp_path.iterdir())


# ---------------------------------------------------------------- 3
def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_fm.classify(d, quality_fm.train(d, labels)).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.97 and (got.predicted == got.quality).mean() > 0.93


def test_quality_edges(spark, corpus):
    docs = frame(spark, corpus)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 1), (5, 1), (6, 0)], "doc_id long, quality int")
    got = quality_fm.classify(docs, quality_fm.train(docs, labels)).toPandas()
    assert len(got) == len(corpus) and got.score.between(0, 1).all()
    assert not got[got.doc_id.isna()].held_out.any()
    none = quality_fm.train(docs.limit(0), labels.limit(0))
    assert set(quality_fm.classify(docs, none).toPandas().score) == {0.5}


def test_fm_identity():
    r = np.random.default_rng(1)
    m = quality_fm.Model(0.1, r.normal(size=quality_fm.BUCKETS + 400), r.normal(size=(quality_fm.BUCKETS + 400, 3)) * 0.1, np.sort(r.normal(size=(len(quality_fm.STATS), quality_fm.BINS - 1)), axis=1))
    stats = r.normal(size=(1, len(quality_fm.STATS)))
    bucket, weight = np.array([3, 9, 100]), np.array([0.5, 0.25, 0.8])
    idx, x = np.concatenate([m.bins(stats)[0], bucket]), np.concatenate([np.ones(len(quality_fm.STATS)), weight])
    z = m.w0 + (m.w[idx] * x).sum() + sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(len(idx)) for j in range(i))
    assert m.score(stats, np.zeros(3, int), bucket, weight)[0] == pytest.approx(1 / (1 + np.exp(-z)))


# ---------------------------------------------------------------- 4
def test_sentencepiece(spark, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sps.DEFAULT_MODEL)
    r = random.Random(1)
    odd = ["a  b ", "x▁y", "\n\nhi\tz", "é日本🦄", " " * 700, "=" * 900, "ab" * 600, "".join(r.choice("abcdefgh(){};\ré") for _ in range(1300)), "the" * 300 + "🦄" * 300 + " x" * 300]
    rows = corpus + [(900 + k, t) for k, t in enumerate(odd)]
    docs = frame(spark, rows)
    got = collections.Counter((x.doc_id, tuple(x.ids)) for x in sps.encode(docs).collect())
    assert got == collections.Counter((d, tuple(sp.encode(t or ""))) for d, t in rows)
    back = collections.Counter((x.doc_id, x.text) for x in sps.decode(sps.encode(docs)).collect())
    assert back == collections.Counter((d, (t or "").replace("▁", " ")) for d, t in rows)
    assert all(x.round_trip for x in sps.digest(docs).collect())


@pytest.mark.parametrize("chunk", [7, 64])
def test_scan_over_chunks_is_the_whole(chunk):
    e = sps.Encoder(sps._proto(sps.DEFAULT_MODEL))
    r = random.Random(4)
    for _ in range(6):
        w = "".join(r.choice("abcdeionst(){}\ré🦄") for _ in range(150))
        assert e.model.scan(sps.MARK + w, chunk) == e.model.sp.encode(w)


@pytest.mark.parametrize("giant", [40, 333])
def test_giant_texts_by_chunk_rows(spark, corpus, monkeypatch, giant):
    import sentencepiece

    monkeypatch.setattr(sps, "BLOCK", 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=sps.DEFAULT_MODEL)
    r = random.Random(9)
    odd = [" " * 500, "a  b   c " * 60, "x▁y " * 200, "ab" * 400, "é日本🦄 " * 90, " lead " + "".join(r.choice("abcde  \n()🦄") for _ in range(2500)), "the" * 300 + " end ", "w" * (giant - 1), "w " * (giant // 2), "word " * 400]
    rows = [(d, t if t is None else t[:6000]) for d, t in corpus] + [(900 + k, t) for k, t in enumerate(odd)]
    rows += rows[-3:]
    docs = frame(spark, rows)
    ids = [sp.encode(t or "") for _, t in rows]
    got = collections.Counter((x.doc_id, tuple(x.ids)) for x in sps.encode(docs, giant=giant).collect())
    assert got == collections.Counter((d, tuple(x)) for (d, _), x in zip(rows, ids))
    want = collections.Counter((d, len(x), hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest(), True) for (d, _), x in zip(rows, ids))
    assert by_rows(sps.digest(docs, giant=giant), "doc_id", "n_tokens", "ids_sha256", "round_trip") == want


# ---------------------------------------------------------------- 5
def test_license_scan(spark):
    mit, bsd2, bsd3 = (" ".join(license_scan.TEMPLATES[k][0].split()) for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause"))
    changed = mit.replace("free of charge", "at no cost").replace("modify", "alter")
    rows = [(1, f"héllo intro {mit} outro"), (2, changed), (3, None), (4, ""), (5, "all rights RESERVED!"), (6, "no license here at all"), (7, "word " * 3000 + "released under the GNU General Public License, version 3."), (7, "All rights reserved. x " * 2)]
    rows += [(8, bsd2), (9, bsd3), (10, mit[: len(mit) // 2]), (11, "Released under the BSD License."), (12, "This is licensed under CC BY-SA 4.0"), (13, mit + " " + bsd3 + " " + mit), (13, mit + " " + bsd3 + " " + mit)]
    got = {(x.doc_id, k): x.matches for k, x in enumerate(license_scan.scan(frame(spark, rows)).orderBy("doc_id").collect())}
    found = {k: [(m.license, round(m.coverage, 2)) for m in v] for k, v in got.items()}
    best = {k: max(v, key=lambda m: m[1], default=None) for k, v in found.items()}
    assert ("MIT", 1.0) in found[1, 0] and rows[0][1][got[1, 0][0].start : got[1, 0][0].end] == mit.rstrip(".")
    assert best[2, 1][0] == "MIT" and 0.9 < best[2, 1][1] < 1
    assert found[3, 2] == found[4, 3] == found[6, 5] == [] and found[5, 4] == [("all-rights-reserved", 1.0)]
    assert sorted([found[7, 6], found[7, 7]]) == [[("GPL-3.0-reference", 1.0)], [("all-rights-reserved", 1.0)] * 2]
    assert best[8, 8] == ("BSD-2-Clause", 1.0) and dict(found[8, 8]).get("BSD-3-Clause", 0) < 1 and best[9, 9] == ("BSD-3-Clause", 1.0)
    assert ("MIT", 1.0) not in found[10, 10] and found[11, 11] == [] and found[12, 12] == [("CC-BY-SA-4.0-reference", 1.0)]
    assert [x for x in found[13, 13] if x[1] == 1 and x[0] in ("MIT", "BSD-3-Clause")] == [("MIT", 1.0), ("BSD-3-Clause", 1.0), ("MIT", 1.0)] and found[13, 13] == found[13, 14]


def _aligned(t, w):
    """(matched, start, end) of the best local alignment without a band: every cell, ties as documented (diagonal, then template's gap, then text's; the first best cell)."""
    cell = {}
    best = (0, 0, 0, 0)
    for i in range(len(t)):
        for j in range(len(w)):
            d, up, left = (cell.get(x, (0, 0, 0)) for x in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
            same = t[i] == w[j]
            options = [(d[0] + (2 if same else -1), d[1] + same, d[2] if d[0] else j), (up[0] - 1, up[1], up[2]), (left[0] - 1, left[1], left[2])]
            top = max(o[0] for o in options)
            if top > 0:
                cell[i, j] = next(o for o in options if o[0] == top)
                if top > best[0]:
                    best = (*cell[i, j], j + 1)
    return best[1:]


def test_banded_alignment_is_the_full_one():
    r = random.Random(6)
    for _ in range(300):
        t = [r.choice("abcd") for _ in range(r.randint(1, 12))]
        w = [r.choice("abcd") for _ in range(r.randint(0, 16))]
        if r.random() < 0.5:
            w = w[:3] + t[: r.randint(0, 12)] + w[3:]
        assert license_scan.align(t, w, 0, 40) == _aligned(t, w)


def test_scan_is_the_best_alignment_of_every_template():
    r = random.Random(16)
    vocab = [f"v{k}" for k in range(60)]
    texts = {f"t{k}": [" ".join(r.choice(vocab) for _ in range(r.randint(20, 60)))] for k in range(6)}
    index = license_scan.Index(texts)
    for _ in range(60):
        k = r.randrange(6)
        own = [x.decode() for x in license_scan.words_of(texts[f"t{k}"][0])]
        for _ in range(r.randint(0, 3)):  # substitutions, insertions and losses within the band
            at = r.randrange(len(own))
            own[at : at + r.choice([0, 1, 2])] = [r.choice(vocab) for _ in range(r.choice([0, 1, 2]))]
        words = [x.encode() for x in [r.choice(vocab) for _ in range(r.randint(0, 30))] + own + [r.choice(vocab) for _ in range(r.randint(0, 30))]]
        data = np.frombuffer(b" ".join(words), np.uint8)
        s, e, _ = license_scan.word_bounds(data, np.array([0, len(data)]), license_scan.ALNUM_WORDS)
        hits = index.hits(license_scan.grams(license_scan.word_hashes(data, s, e, lower=True), len(words)))
        got = license_scan.scan_words(words, hits, index)
        want = []
        for t in range(6):
            m, a, z = _aligned(index.words[t], words)
            if m >= license_scan.MIN_COVERAGE * len(index.words[t]):
                want.append((index.name[t], m / len(index.words[t]), a, z))
        assert got == sorted(want, key=lambda x: (x[2], x[0]))


# ---------------------------------------------------------------- 6
def _contamination(docs, items, k=10):
    win = {}
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        for p in range(max(1, len(w) - k + 1) if w else 0):
            win.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = collections.Counter()
    for d, t in docs:
        w = ALNUM.findall(lower(t or ""))
        hit, found = set(), set()
        for n in {len(x) for x in win}:
            for p in range(len(w) - n + 1):
                if (s := win.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= s
        out[(d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


COLS6 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block", [8 << 20, 600])
def test_decontamination(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, corpus[3][1]), (2, "one two"), (10, corpus[3][1]), (3, None), (4, ""), (5, " ".join(corpus[33 + 2][1].split()[40:75]) if corpus[35][1] else "x y z"), (6, "A" * 3000), (7, corpus[45][1] if corpus[45][1] else "q")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    got = by_rows(decontaminate.digest(frame(spark, corpus), bench), *COLS6)
    assert got == _contamination(corpus, items)
    clean = decontaminate.digest(frame(spark, corpus), bench.limit(0)).where("contaminated").count()
    assert clean == 0


def test_removed_spans_are_gone(spark, corpus):
    items = [(1, corpus[3][1]), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.remove_spans(frame(spark, corpus), bench, ("doc_id", "text"))
    assert left.count() == len(corpus)
    by_id = {x.doc_id: x.text for x in left.collect()}
    assert by_id[43] == "" and by_id[0] == corpus[0][1] and by_id[40] is None


def test_blocks_of_a_benchmark_are_found_and_cut_as_one(spark, monkeypatch):
    w = [f"w{k}" for k in range(60)]
    items = [(1, " ".join(w[5:17])), (2, " ".join(w[12:26])), (3, " ".join(w[20:32])), (4, " ".join(w[1:5] + w[32:40])), (5, " ".join(w[38:52]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(1, " ".join(w)), (2, "x " + " ".join(w[3:28])), (3, None), (4, "clean text")])
    cols = ("doc_id", "text", "n_words", "n_hit", "items", "spans")
    rows = lambda df, c: sorted(str([r[x] for x in c]) for r in df.collect())
    seen = []
    for block in (8 << 20, 500, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        seen.append((len(list(decontaminate.windows_of(bench))), rows(decontaminate.find(docs, bench), cols), rows(decontaminate.remove_spans(docs, bench, ("doc_id", "text")), ("doc_id", "text"))))
    assert seen[0][0] == 1 < seen[1][0] < seen[2][0] and seen[0][1:] == seen[1][1:] == seen[2][1:]
    left = {x.doc_id: x.text for x in decontaminate.remove_spans(docs, bench, ("doc_id", "text")).collect()}
    assert left[1].split() == w[:5] + w[32:38] + w[52:] and left[2].split() == ["x", "w3", "w4", "w26", "w27"] and left[3] is None
    assert {x.doc_id: x["items"] for x in decontaminate.find(docs, bench).collect()}[1] == ["1", "2", "3", "5"]


def test_fm_index():
    r = np.random.default_rng(2)
    for _ in range(20):
        seq = r.integers(0, 5, 200)
        ix = decontaminate.FmIndex(seq, 5)
        pats = r.integers(1, 5, (30, 4))
        lens = r.integers(1, 5, 30)
        lo, hi = ix.search(pats, lens)
        for p, n, a, b in zip(pats, lens, lo, hi):
            want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p[:n]).all()]
            assert sorted(ix.locate(np.arange(a, b))) == want


# ---------------------------------------------------------------- 7
def test_fingerprints(spark, corpus):
    rows = [(d, t) for d, t in corpus if d is not None and d not in (60, 70)]
    got = {x.doc_id: x for x in lcp_fingerprint.against_next(frame(spark, rows)).collect()}
    order = sorted(rows)
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        x = got[d]
        f, g = lcp_fingerprint.fingerprint(t), lcp_fingerprint.fingerprint(e)
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), f, g)
        assert x.near_edited == lcp_fingerprint.likeness(f, g) and x.near_next == lcp_fingerprint.likeness(f, lcp_fingerprint.fingerprint(n))
    assert lcp_fingerprint.against_next(frame(spark, corpus)).count() == len(corpus)
    one = lcp_fingerprint.against_next(frame(spark, [(1, "abcdefgh")])).first()
    assert one.near_next == 1.0


def test_phrases_ignore_offsets():
    t = " ".join(f"word{k * 7919 % 1000}" for k in range(400))
    f = lcp_fingerprint.fingerprint
    assert lcp_fingerprint.likeness(f(t), f("some other beginning, " + t)) > 0.8
    assert lcp_fingerprint.likeness(f(t), f(t[::-1])) < 0.2 and f("") == f("") == "0" * 256


def test_near_copies_stay_alike_at_every_length():
    r = random.Random(11)
    f = lcp_fingerprint.fingerprint
    for n in (100, 199, 398, 399, 400, 800, 1600, 5000):
        t = "".join(r.choice("abcdefghij klmnop") for _ in range(n))
        assert lcp_fingerprint.likeness(f(t), f(t + "xyz")) > 0.75, n


# ---------------------------------------------------------------- 8
def test_substring_dedup(spark, corpus):
    words = [(d, SPACES.findall(t or "")) for d, t in corpus]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    want = collections.Counter()
    for d, w in words:
        hit = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = [x for k, x in enumerate(w) if k not in hit]
        want[(d, len(w), len(hit), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    got = by_rows(debruijn_dedup.digest(frame(spark, corpus)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == want


# ---------------------------------------------------------------- 9
BASE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _base(t):
    out = []
    for k, rx in enumerate(BASE):
        for m in rx.finditer(t or ""):
            d = [int(c) for c in m.group() if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
            if (k == 0) or (k == 1 and all(int(p) <= 255 for p in m.group().split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_regular_expressions():
    r = random.Random(8)
    for _ in range(4000):
        t = "".join(r.choice("a@.1+2- (9%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == _base(t), t
    for t in ("a" * 200_000, "1" * 100_000, "1." * 50_000, "a@" * 50_000, "+1" * 50_000):
        pii.base_spans(t)  # linear


def test_bootstrapped_spans(spark):
    rows = [(k, f"héllo password={hashlib.md5(str(k).encode()).hexdigest()[:18]} and a.{k}@mail.example.com") for k in range(20)]
    rows += [(30, "then password=hunter2 here"), (31, None), (32, ""), (33, "note: nothing"), (33, "token"), (34, "card 4000 0000 0000 0002 +1 (988) 555-2485"), (35, "a quiet clean text")]
    got = {x.doc_id: x for x in pii.detect(frame(spark, rows)).collect()}
    assert "secret:14:21" in got[30].spans and got[31].spans == got[32].spans == got[35].spans == "" and got[33].spans == ""
    assert all(got[k].n_email == 1 and got[k].spans.count("secret") == 1 for k in range(20)) and (got[34].n_card, got[34].n_phone) == (1, 1)
    names = ("email", "ip", "card", "phone")
    for d, t in rows:
        want = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in _base(t))
        if d != 33:
            assert got[d].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    red = {x.doc_id: x.text for x in pii.redact(frame(spark, rows), ("doc_id", "text")).collect()}
    assert red[0] == "héllo password=[SECRET] and [EMAIL]" and red[30] == "then password=[SECRET] here" and red[31] is None and red[35] == "a quiet clean text"
    assert pii.detect(frame(spark, [])).count() == 0


def test_long_values_are_whole(spark):
    r = random.Random(12)
    long = "".join(r.choice("abcdefXYZ0123456789-_./+") for _ in range(5000)) + "end"
    rows = [(k, f"say token={hashlib.md5(str(k).encode()).hexdigest()[:18]} now") for k in range(20)] + [(30, f"so token={long} it is"), (31, f"so token={'k' * 201}")]
    got = {x.doc_id: x.spans.split(",") for x in pii.detect(frame(spark, rows)).collect()}
    assert f"secret:9:{9 + len(long)}" in got[30] and got[31] == ["secret:9:210"]
    red = {x.doc_id: x.text for x in pii.redact(frame(spark, rows[:20] + rows[21:]), ("doc_id", "text")).collect()}
    assert red[0] == "say token=[SECRET] now" and red[31] == "so token=[SECRET]"
    pii.candidates("ab:" * 100_000 + "a" * 200_000, [])  # linear


def _added_by_brute_force(rows):
    """Added spans of the texts, the graph scored with dictionaries."""
    found = [(k, pii.base_spans(t or ""), pii.candidates(t or "", pii.base_spans(t or ""))) for k, (_, t) in enumerate(rows)]
    seed, values = {}, collections.defaultdict(set)
    for _, _, cands in found:
        for _, _, p, v, x in cands:
            seed[p, v] = max(seed.get((p, v), 0), x)
            values[p].add(v)
    score = {p: sum(seed[p, v] for v in own) / len(own) for p, own in values.items()}
    good = lambda: {p: s for p, s in score.items() if s >= pii.MIN_SCORE and len(values[p]) >= pii.MIN_SUPPORT}
    for _ in range(pii.ROUNDS - 1):
        now = good()
        best = lambda v, kind: max([0.0, *(s for p, s in now.items() if p[0] == kind and v in values[p])])
        score = {p: sum(best(v, "L") if p[0] == "P" else max(seed[p, v], best(v, "P")) for v in own) / len(own) for p, own in values.items()}
    now, out = good(), []
    for k, base, cands in found:
        kept = []
        for s, e in sorted({(s, e) for s, e, p, _, _ in cands if p in now and not any(a < e and s < z for a, _, z in base)}):
            if not kept or kept[-1][1] <= s:
                kept.append((s, e))
        out.append(kept)
    return out


def test_added_spans_are_those_of_the_graph(spark):
    r = random.Random(31)
    key = lambda head="": head + "".join(r.choice("ABCDEFGHJK0123456789") for _ in range(20))
    rows = [(k, f"{r.choice(['api_key: ', 'password=', 'note: '])}{r.choice([key(), 'hunter2x', 'ab.c@de.fg'])} x {key('WXYZ')}") for k in range(60)]
    keys = [key("QRST") for _ in range(8)]
    rows += [(100 + k, f"é token=\"{v}\" and {v}") for k, v in enumerate(keys)] + [(200 + k, f"seen {key('QRST')} by itself") for k in range(3)]
    rows += [(300 + k, f"build {key('ABCD')} passed") for k in range(9)]  # a shape that no trigger introduces
    rows += [(400, None), (401, ""), (402, "long " * 40_000 + f'token="{keys[0]}"'), (100, rows[60][1]), (100, rows[60][1]), (None, rows[61][1]), (403, "token=secretvalue password=secretvalue")]
    docs = frame(spark, rows)
    got = collections.Counter((x.doc_id, tuple(s for s in x.spans.split(",") if s.startswith("secret"))) for x in pii.detect(docs).collect())
    want = _added_by_brute_force(rows)
    assert got == collections.Counter((d, tuple(f"secret:{s}:{e}" for s, e in own)) for (d, _), own in zip(rows, want))
    by_id = {d: own for (d, _), own in zip(rows, want)}
    assert by_id[200] and not any(by_id[300 + k] for k in range(9)) and len(by_id[402]) == 1


def test_prefilter_lets_every_candidate_through(spark):
    r = random.Random(13)
    found = 0
    for _ in range(20_000):
        t = "".join(r.choice("abcd \"'=:#@+1é.") for _ in range(r.randint(5, 14)))
        c = pii.candidates(t, [])
        found += bool(c)
        assert not (c or pii.base_spans(t)) or pii._ANY.search(t), t
    assert found > 500
    rows = [(k, f'the password "{hashlib.md5(str(k).encode()).hexdigest()[:18]}" was given') for k in range(20)]
    rows += [(30, 'the password "correcthorse" was given'), (31, "the password correcthorse was given")]
    got = {x.doc_id: x.spans for x in pii.detect(frame(spark, rows)).collect()}
    assert got[30] == "secret:14:26" and got[31] == ""
    red = {x.doc_id: x.text for x in pii.redact(frame(spark, rows), ("doc_id", "text")).collect()}
    assert red[30] == 'the password "[SECRET]" was given' and red[31] == rows[-1][1]


# ---------------------------------------------------------------- 10
def test_chat_turns(spark):
    odd = ["\\### Assistant: </turn> ok", "", "a\nb", "###", "<turn>", "\\", "é🦄"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant"] * 4, odd))] + [(2, 0, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 1, "a:b\n#", "q")]
    df = spark.createDataFrame([(*x, 1, "f") for x in rows], "conv_id long, turn long, role string, text string, seq int, formatted string")
    f = chat_format.format_turns(df)
    one = "".join(x.formatted for x in f.where("conv_id = 1").orderBy("turn").collect())
    assert chat_format.parse_conversation(one) == [(r, t) for _, _, r, t in rows[:7]]
    got = {x.conv_id: x for x in chat_format.digest_conversations(f).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:7]).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in rows[:7] if r == "assistant").encode()).hexdigest()
    assert got[2].n_turns == 3 and got[2].loss_chars == 2 and got[None].n_turns == 1 and got[1].formatted_chars == len(one)
    assert chat_format.digest_conversations(chat_format.format_turns(df.limit(0))).count() == 0


def test_ties_of_turns_go_by_the_text_itself(spark):
    odd = ["#b", "$a", "<c", "=d", "\\x", "]y", "a", "a b", "a#", "", "a\nb", "é🦄"]
    rows = [(1, 0, "user", t) for t in odd] + [(1, 1, "assistant", t) for t in odd * 2] + [(2, 0, "assistant", "word " * 60_000)]
    f = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x.conv_id: x for x in chat_format.digest_conversations(f).collect()}
    text = [(r, t) for _, r, t in sorted((k, r, t) for c, k, r, t in rows if c == 1)]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in text).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for r, t in text if r == "assistant").encode()).hexdigest()
    assert got[2].loss_chars == 300_000


def test_layouts(spark):
    cases = {
        "messages": {"messages": [dict(role="user", content="a"), dict(role="assistant", content=None)]},
        "sharegpt": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": ""}]},
        "instruction": {"instruction": "a", "input": "", "output": None},
        "prompt_completion": {"prompt": "a", "completion": ""},
    }
    for name, body in cases.items():
        shape = chat_format.LAYOUTS[name][0]
        ddl = "id long, turn string, " + ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in shape.fields)
        df = spark.createDataFrame([(json.dumps({"id": 1, "turn": "z", **body}),)], "s string").select(F.from_json("s", ddl).alias("r")).select("r.*")
        assert chat_format.detect(df.schema) == name
        assert [(x.role, x.text) for x in chat_format.to_turns(df, "id").orderBy("turn").collect()] == [("user", "a"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat_format.detect(spark.createDataFrame([(1,)], "x int").schema)
    more = spark.createDataFrame([(1, [("user", "a", "bob")])], "id long, messages array<struct<role:string,content:string,name:string>>")
    assert [(x.role, x.text) for x in chat_format.to_turns(more, "id").collect()] == [("user", "a")]
    for turn in ("int", "long"):
        rows = spark.createDataFrame([(1, 3, "user", "a", 0.5)], f"conv_id long, turn {turn}, role string, text string, extra double")
        assert chat_format.detect(rows.schema) == "turn_rows" and chat_format.to_turns(rows).collect()[0].turn == 3


def test_records_of_mixed_layouts(spark):
    pair = [("user", "a"), ("assistant", "b")]
    records = {
        1: ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "name": None}]}, "messages", pair),
        2: ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "odd `key`, x": {"y": [1, 2.5]}}, "sharegpt", pair),
        3: ({"instruction": "a", "input": "", "output": "b"}, "instruction", pair),
        4: ({"prompt": "a", "completion": "b", "score": 1.25}, "prompt_completion", pair),
        5: ({"question": "a", "answer": None}, "question_answer", [("user", "a"), ("assistant", "")]),
        6: ({"nothing": 1}, None, [(None, None)]),
        7: ([1, 2], None, [(None, None)]),
    }
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _, _) in records.items()] + [(8, None), (9, "{not json")], "id long, j string")
    got = collections.defaultdict(list)
    for x in chat_format.record_turns(df, "id", "j").orderBy("conv_id", "turn").collect():
        got[x.conv_id].append((x.layout, x.role, x.text))
    for k, (_, layout, turns) in records.items():
        assert got[k] == [(layout, *t) for t in turns], k
    assert got[8] == got[9] == [(None, None, None)]


# ---------------------------------------------------------------- pipeline and empties
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert out.doc_id.is_unique and out.round_trip.all() and set(out.doc_id) <= {r[0] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "contamination", "personal_data", "tokens"]
    odd = frame(spark, [(1, None), (1, None), (2, ""), (None, "x y z"), (3, "mail a@b.cc now")]).withColumn("n_chars", F.lit(5).cast("long"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, odd, "/root/testdata/sf0.001")
        assert got.count() >= 4
        if name != "tokens":
            assert got.columns == corpus_pipeline.COLUMNS
            odd = got
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    say = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    a, b, c, d = (say(k) for k in range(4))
    rows = [(3, a), (7, a + " tail"), (7, b), (9, c), (9, c), (9, c + " more"), (None, d), (None, d), (None, d + " end"), (None, b + " x"), (7, None), (7, None), (None, ""), (20, say(9)), (20, say(10))]
    got = collections.Counter((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect())
    nines, nulls = [x for x in got if x[0] == 9], [x for x in got if x[0] is None and x[1]]
    assert len(nines) == 1 and nines[0][1] in (c, c + " more") and len(nulls) == 1 and nulls[0][1] in (d, d + " end")
    assert got == collections.Counter([(3, a), (7, b), *nines, *nulls, (7, None), (7, None), (None, ""), (20, say(9)), (20, say(10))])
    same = frame(spark, [(None, d)] * 500 + [(4, d)] * 3)
    assert [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, same, "").collect()] == [(4, d)]


def test_empty_tables(spark):
    e = frame(spark, [])
    for f in (minhash_dedup.groups, suffix_dedup.digest, debruijn_dedup.digest, lcp_fingerprint.against_next, license_scan.digest, sps.digest):
        assert f(e).count() == 0


def _cut_words(text, items, k=10):
    """The text without the stretches of words that windows of items cover, and the number of such words."""
    words = [(m.start(), m.end()) for m in ALNUM.finditer(lower(text))]
    w = [lower(text)[a:z] for a, z in words]
    win = {tuple(own[p : p + k]) for own in (ALNUM.findall(lower(t or "")) for _, t in items) if own for p in range(max(1, len(own) - k + 1))}
    hit = {j for n in {len(x) for x in win} for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in win for j in range(p, p + n)}
    out, at = [], 0
    for j in sorted(hit):
        if j - 1 not in hit:
            out.append(text[at : words[j][0]])
        at = words[j][1]
    return "".join(out) + text[at:]


def test_pipeline_is_its_stages_by_brute_force(spark):
    import sentencepiece

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_fm.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {x.doc_id for x in quality_fm.classify(docs, model).where("predicted = 1").collect()}
    rows = [r for r in docs.orderBy("doc_id").collect() if r.doc_id in kept]

    sets = []
    for r in rows:
        w = SPACES.findall(lower(r.text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x & sets[j] and 100 * len(x & sets[j]) >= 70 * len(x | sets[j]):
                a, z = group[i], group[j]
                group = [min(a, z) if g in (a, z) else g for g in group]
    rows = [r for i, r in enumerate(rows) if group[i] == i]

    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [(r.doc_id, None if r.text is None else _cut_words(r.text, items)) for r in rows]
    names = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]
    clean = []
    for (_, t), added in zip(texts, _added_by_brute_force(texts)):
        spans = sorted([(s, k, e) for s, k, e in _base(t)] + [(s, 4, e) for s, e in added])
        out, at = [], 0
        for s, k, e in spans:
            if e > at:
                if s >= at:
                    out += [t[at:s], [*names, "[SECRET]"][k]]
                at = e
        clean.append("".join(out) + t[at:] if t else t)
    sp = sentencepiece.SentencePieceProcessor(model_file=sps.DEFAULT_MODEL)
    want = collections.Counter()
    for r, t in zip(rows, clean):
        ids = sp.encode(t or "")
        want[(r.doc_id, r.lang, r.source, len(t or ""), len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True)] += 1
    assert by_rows(corpus_pipeline.run(spark, sf), "doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "round_trip") == want
    assert 0 < len(rows) < len(kept) and any("[EMAIL]" in (t or "") for t in clean)


def test_two_labels_of_one_document(spark):
    docs = frame(spark, [(k, f"text {k} " * (k % 7 + 1)) for k in range(40)])
    one = [(k, k % 2) for k in range(40)]
    model = quality_fm.train(docs, spark.createDataFrame(one, "doc_id long, quality int"))
    more = quality_fm.train(docs, spark.createDataFrame(one[::-1] + [(k, 1) for k in range(40)], "doc_id long, quality int"))
    a, b = (sorted((x.doc_id, x.score) for x in quality_fm.classify(docs, m).collect()) for m in (model, more))
    assert a == b
