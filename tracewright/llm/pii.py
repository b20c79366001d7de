"""Personal data: base recognisers and bootstrapped contextual extraction.

Base kinds (email, ip, card, phone) are found by linear-time scans. Bootstrapping then
works on a bipartite graph of lexical patterns and instances (distinct values). A pattern
is a trigger to the left of a value (password=, token = ") or a prefix with a shape (AKIA +
upper case). Seeds are the base entities and key-like strings (16 or more letters and
digits, mixed) where a trigger introduces them. Spark scores the graph in rounds: a
trigger's score is the mean, over its distinct values, of the better of their seed value
and of the trusted prefixes they have; a prefix's score is the mean over its distinct
values of the best trusted trigger that introduces them anywhere, so a shape alone never
vouches for itself. Patterns with MIN_SUPPORT distinct values and a score of at least
MIN_SCORE then label every value they match, seeds or not: those are the added spans.

The graph is aggregated to distinct (pattern, value) edges before any join, and joins on
patterns are salted, so a pattern that a third of all texts hold is not one task's work.

Defined cases: a trigger's value reaches to the next white space or delimiter, however long
it is, and triggers inside it aren't looked for; null and empty texts have no spans, very
long ones are searched whole; offsets are code points; an added span that overlaps a base
span is dropped, as is one that overlaps an earlier added one (of two with one start the
shorter stays); documents with equal ids and repeated rows are each reported, and a value
counts once however often it is repeated; a corpus without seeds adds nothing, an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lean, written

KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
MIN_SUPPORT, MIN_SCORE, ROUNDS, SALT = 3, 0.6, 3, 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"([^\W\d_]{2,24})(\s?[=:#]\s?[\"']?|\s[\"'])([^\s\"'<>,;=]{4,}+)")
_KEY = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+")
#: Every match of a pattern, base or contextual, holds one of these: texts without any are passed over.
ANY = "[0-9@=:#\"']"
_ANY = re.compile(ANY)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, each '@' looked at once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _DIGITS.sub("", m.group())
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _key_like(v: str) -> bool:
    digits = sum("0" <= c <= "9" for c in v)
    return len(v) >= 16 and v.isascii() and v.isalnum() and digits >= 2 and len(v) - digits >= 3


def _shape(v: str) -> str:
    letters = [c for c in v if c.isalpha()]
    case = "U" if all(c.isupper() for c in letters) else "l" if all(c.islower() for c in letters) else "m"
    return f"{case}{len(v) // 8}"


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, float]]:
    """(start, end, pattern, value, seed score) of everything that a pattern could label."""
    out = []
    for m in _TRIGGER.finditer(text):
        s = m.start(3)
        v = m.group(3).rstrip(".!?%$&*#)]}")
        seed = 1.0 if _key_like(v) or any(a < s + len(v) and s < e for a, _, e in base) else 0.0
        if len(v) >= 4:
            out.append((s, s + len(v), "L|" + re.sub(r"\s+", " ", (m.group(1) + m.group(2)).lower()), v.lower(), seed))
    for m in _KEY.finditer(text):
        v = m.group()
        if _key_like(v):
            out.append((m.start(), m.end(), f"P|{v[:4]}|{_shape(v)}", v.lower(), 0.0))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.string()), ("v", pa.string()), ("seed", pa.float64())])
SPAN_DDL = "array<struct<start:long,rank:int,end:long>>"
CANDIDATE_DDL = "array<struct<start:long,end:long,p:string,v:string,seed:double>>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, cands = [], []
        for t in column(b, "text").to_pylist():
            if t and _ANY.search(t):
                base = base_spans(t)
                spans.append([{"start": s, "rank": k, "end": e} for s, k, e in base])
                cands.append([{"start": s, "end": e, "p": p, "v": v, "seed": x} for s, e, p, v, x in candidates(t, base)])
            else:
                spans.append([])
                cands.append([])
        cols = {c: column(b, c) for c in b.schema.names if c != "text"}
        cols["base"] = pa.array(spans, pa.list_(_SPAN))
        cols["cands"] = pa.array(cands, pa.list_(_CANDIDATE))
        yield pa.record_batch(cols)


def extract(documents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, base (spans) and cands (candidates) of every document; one pass."""
    df = documents.select(*keys, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes) + f", base {SPAN_DDL}, cands {CANDIDATE_DDL}"
    return df.mapInArrow(lean(_extract), schema)


def _salted(patterns: DataFrame) -> DataFrame:
    return patterns.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))


def score_patterns(extracted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(p, score, support) of all patterns, by iteration over the pattern-instance graph."""
    edges = extracted.select(F.explode("cands").alias("c")).groupBy("c.p", "c.v").agg(F.max("c.seed").alias("seed"))
    edges = written(edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")))
    prefix = F.col("p").startswith("P|")

    def means(scored: DataFrame) -> DataFrame:
        return scored.groupBy("p").agg(F.avg("x").alias("score"), F.count("*").alias("support"))

    patterns = means(edges.withColumn("x", F.col("seed")))
    for _ in range(rounds - 1):
        trusted = _salted(patterns.where((F.col("support") >= MIN_SUPPORT) & (F.col("score") >= MIN_SCORE)).select("p", "score"))
        known = edges.join(trusted, ["p", "salt"], "left")
        score = F.coalesce("score", F.lit(0.0))
        # what a value's trusted triggers say of it, and what its trusted prefixes say
        values = known.groupBy("v").agg(F.max(F.when(prefix, 0.0).otherwise(score)).alias("by_trigger"), F.max(F.when(prefix, score).otherwise(0.0)).alias("by_prefix"))
        x = F.when(prefix, F.col("by_trigger")).otherwise(F.greatest("seed", "by_prefix"))
        patterns = written(means(edges.select("p", "v", "seed").join(values, "v").withColumn("x", x)))
    return patterns


def trusted_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.where((F.col("support") >= MIN_SUPPORT) & (F.col("score") >= MIN_SCORE)).select("p")


def added_spans(extracted: DataFrame, patterns: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys and added (array of spans) for the documents that trusted patterns label."""
    found = extracted.where(F.size("cands") > 0).select(*keys, "base", F.explode("cands").alias("c"))
    found = found.where(~F.exists("base", lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"])))
    found = found.select(*keys, "c.p", "c.start", "c.end", F.pmod(F.xxhash64("c.v"), F.lit(SALT)).cast("int").alias("salt"))
    found = found.join(_salted(trusted_patterns(patterns)), ["p", "salt"], "left_semi")
    span = F.struct("start", F.lit(len(KINDS)).cast("int").alias("rank"), "end")
    grouped = found.groupBy(*keys).agg(F.array_sort(F.collect_set(span)).alias("all"))
    # one text's spans: keep those that begin at or after the end of what is kept
    kept = F.aggregate(
        "all",
        F.expr(f"cast(array() as {SPAN_DDL})"),
        lambda acc, s: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= s["start"]), F.concat(acc, F.array(s))).otherwise(acc),
    )
    return grouped.select(*keys, kept.alias("added"))


def _named(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in (*KINDS, ADDED))
    return f"array_join(transform(array_sort({spans}), s -> concat(element_at(array({kinds}), s.rank + 1), ':', s.start, ':', s.end)), ',')"


def detect(documents: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    docs = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    extracted = written(extract(docs, ("uid", "doc_id")))
    added = added_spans(extracted, score_patterns(extracted), ("uid",))
    out = extracted.select("uid", "doc_id", "base").join(added, "uid", "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(F.expr(_named("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_named(f"concat(base, coalesce(added, cast(array() as {SPAN_DDL})))")).alias("spans"),
    )


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f"[{k.upper()}]" for k in (*KINDS, ADDED)]
    for b in batches:
        texts, spans = column(b, "text").to_pylist(), column(b, "spans").to_pylist()
        for k, own in enumerate(spans):
            if own:
                parts, at = [], 0
                for s in sorted(own, key=lambda s: (s["start"], s["rank"])):
                    if s["end"] > at:
                        if s["start"] >= at:
                            parts += [texts[k][at : s["start"]], names[s["rank"]]]
                        at = s["end"]  # overlapping spans go as one
                texts[k] = "".join(parts) + texts[k][at:]
        yield pa.record_batch({c: (pa.array(texts, pa.string()) if c == "text" else column(b, c)) for c in b.schema.names if c != "spans"})


def redact(documents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Documents with every span replaced by the name of its kind in brackets. Texts that can't hold any span aren't shuffled."""
    key = documents.select(*keep).withColumn("text_hash", F.xxhash64("text"))
    can = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    keys = ("doc_id", "text_hash")
    extracted = written(extract(key.where(can), keys).where((F.size("base") > 0) | (F.size("cands") > 0)).dropDuplicates(list(keys)))
    added = added_spans(extracted, score_patterns(extracted), keys)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    spans = extracted.alias("a").join(added.alias("b"), same(extracted, added), "left").select("a.doc_id", "a.text_hash", F.expr(f"concat(a.base, coalesce(b.added, cast(array() as {SPAN_DDL})))").alias("spans")).where(F.size("spans") > 0)
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    inside = key.where(can)
    changed = inside.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left").select(*[F.col(f"d.{c}") for c in keep], "s.spans").mapInArrow(lean(_mask), schema)
    return changed.unionByName(key.where(~can).select(*keep))


def digest(parts: list[str]) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()
