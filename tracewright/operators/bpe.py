"""Procedure vocabularies by byte-pair merging, and fingerprints under them.

Each token has one private-use character, so a trajectory is a plain string and a merge
is a string replacement (greedy, left to right, without overlaps). Equal strings are
counted once with their multiplicity.
"""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import entropy, normalize, total

SEPARATOR = "▁"
_PLANE = 0xF0000  # 65,000 private-use characters


def token_char(i: int) -> str:
    return chr(_PLANE + i)


@dataclass(frozen=True)
class Vocabulary:
    """Sorted atoms, then merges in the order learned."""

    atoms: tuple[str, ...]
    #: pairs of tokens in the order in which they were learned
    merges: tuple[tuple[str, str], ...] = ()
    seed: int = 0
    min_pair_frequency: int = 2
    fit_corpus: str | None = None
    _index: dict[str, int] = field(default_factory=dict, compare=False, repr=False)

    def tokens(self) -> tuple[str, ...]:
        """All names by place."""
        return (*self.atoms, *(f"{a}{SEPARATOR}{b}" for a, b in self.merges))

    def index(self) -> dict[str, int]:
        """Token to place; where a name occurs twice, the last place."""
        return dict(zip(self.tokens(), range(self.size)))

    @property
    def size(self) -> int:
        return sum(map(len, (self.atoms, self.merges)))

    @property
    def content_hash(self) -> str:
        compact = json.dumps((self.atoms, self.merges), separators=(",", ":"))
        return hashlib.sha256(compact.encode()).hexdigest()[:12]

    @property
    def spec(self) -> str:
        """The compact key that fingerprints carry."""
        return ":".join([self.content_hash, str(self.size)])

    def save(self, path: str | Path) -> None:
        body = {"merges": self.merges, "atoms": self.atoms, "min_pair_frequency": self.min_pair_frequency, "seed": self.seed}
        if self.fit_corpus is not None:
            body["fit_corpus"] = self.fit_corpus
        Path(path).write_text(json.dumps(body, ensure_ascii=False, indent=2))

    @classmethod
    def load(cls, path: str | Path) -> Vocabulary:
        d = json.loads(Path(path).read_text())
        return cls(tuple(d["atoms"]), tuple((a, b) for a, b in d["merges"]), int(d.get("seed", 0)), int(d.get("min_pair_frequency", 2)), d.get("fit_corpus"))

    def frame(self, spark) -> DataFrame:
        rows = [(i, t, *(self.merges[i - len(self.atoms)] if i >= len(self.atoms) else (None, None))) for i, t in enumerate(self.tokens())]
        return spark.createDataFrame(rows, "token_id int, token string, left string, right string")

    def tree(self) -> str:
        """The merges as an indented tree; roots are tokens that no later merge uses."""
        parts = {f"{a}{SEPARATOR}{b}": (a, b) for a, b in self.merges}
        used = {x for m in self.merges for x in m}
        lines: list[str] = []

        def show(t: str, depth: int) -> None:
            lines.append("  " * depth + t.replace(SEPARATOR, " + "))
            for x in parts.get(t, ()):
                show(x, depth + 1)

        for t in parts:
            if t not in used:
                show(t, 0)
        return "\n".join(lines)


def _chars(atoms: Column, vocab: Vocabulary) -> Column:
    """Atoms as characters; unknown atoms become a character that no merge has."""
    table = F.create_map(*[F.lit(x) for i, a in enumerate(vocab.atoms) for x in (a, token_char(i))]) if vocab.atoms else None
    other = F.lit(token_char(65_000))
    one = (lambda a: F.coalesce(F.try_element_at(table, a), other)) if table is not None else (lambda a: other)
    return F.array_join(F.transform(atoms, one), "")


def _merged(enc: Column, vocab: Vocabulary, start: int = 0) -> Column:
    at = vocab.index()
    for k in range(start, len(vocab.merges)):
        a, b = vocab.merges[k]
        enc = F.replace(enc, F.lit(token_char(at[a]) + token_char(at[b])), F.lit(token_char(at[f"{a}{SEPARATOR}{b}"])))
    return enc


def pair_counts(enc: DataFrame) -> DataFrame:
    """(pair, n): adjacent pairs of (enc, mult) rows, overlapping ones counted."""
    places = F.when(F.length("enc") >= 2, F.sequence(F.lit(1), F.greatest(F.length("enc") - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    pairs = enc.select(F.explode(F.transform(places, lambda i: F.substring(F.col("enc"), i, 2))).alias("pair"), "mult")
    return pairs.groupBy("pair").agg(F.sum("mult").alias("n"))


def fit_bpe(traces: DataFrame, vocab_size: int, *, fit_corpus: str | None = None, min_pair_frequency: int = 2, seed: int = 0) -> Vocabulary:
    """Learns merges until the vocabulary has vocab_size tokens or no pair is frequent enough.

    Ties go to the smallest (left, right) by token. seed is kept with the result and has
    no effect. One aggregation per merge, over distinct strings; what the driver gets is
    one pair count per distinct pair, at most vocab_size squared.
    """
    found = [r[0] for r in traces.select(F.explode("atoms").alias("a")).where("a is not null").distinct().orderBy("a").limit(vocab_size + 1).collect()]
    if len(found) > vocab_size:
        raise ValueError(f"vocab_size {vocab_size} is smaller than the alphabet")
    if any(SEPARATOR in a for a in found):
        warnings.warn("an atom contains the separator of merged tokens", stacklevel=2)
    vocab = Vocabulary(tuple(found), (), seed, min_pair_frequency, fit_corpus)
    if not found:
        return vocab
    enc = traces.select(_chars(F.col("atoms"), vocab).alias("enc")).where("length(enc) > 1").groupBy("enc").agg(F.count("*").alias("mult"))
    base = enc.persist(StorageLevel.MEMORY_AND_DISK_2)
    done = 0  # merges that base has applied
    held = [base]
    try:
        while vocab.size < vocab_size:
            now = base.select(_merged(F.col("enc"), vocab, done).alias("enc"), "mult")
            if len(vocab.merges) - done >= 16:
                base = now.persist(StorageLevel.MEMORY_AND_DISK_2)
                held.append(base)
                now, done = base, len(vocab.merges)
            names = vocab.tokens()
            counts = [(names[ord(r.pair[0]) - _PLANE], names[ord(r.pair[1]) - _PLANE], r.n) for r in pair_counts(now).where(F.col("n") >= min_pair_frequency).collect()]
            if not counts:
                break
            a, b, _ = min(counts, key=lambda c: (-c[2], c[0], c[1]))
            vocab = Vocabulary(vocab.atoms, (*vocab.merges, (a, b)), seed, min_pair_frequency, fit_corpus)
    finally:
        for x in held:
            x.unpersist()
    return vocab


def tokenize(traces: DataFrame, vocab: Vocabulary, out: str = "tokens") -> DataFrame:
    """traces with their tokens under the vocabulary (unknown atoms left out)."""
    chars = [token_char(i) for i in range(vocab.size)]
    names = F.create_map(*[F.lit(x) for c, t in zip(chars, vocab.tokens()) for x in (c, t)])
    parts = F.filter(F.split(_merged(_chars(F.col("atoms"), vocab), vocab), ""), lambda c: F.array_contains(F.map_keys(names), c))
    return traces.withColumn(out, F.transform(parts, lambda c: F.element_at(names, c)))


def encode(traces: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Fingerprints: (trace_id, agent, group, counts, vocab_spec); one projection, no shuffle."""
    at = vocab.index()
    live = [i == at[t] for i, t in enumerate(vocab.tokens())]
    enc = traces.select("trace_id", "agent", "group", *(["metadata"] if "metadata" in traces.columns else []), _merged(_chars(F.col("atoms"), vocab), vocab).alias("enc"))
    one = [(F.length("enc") - F.length(F.replace(F.col("enc"), F.lit(token_char(i)), F.lit("")))).cast("long") if live[i] else F.lit(0).cast("long") for i in range(vocab.size)]
    return enc.withColumn("counts", F.array(*one)).withColumn("vocab_spec", F.lit(vocab.spec)).drop("enc")


def with_distribution(fps: DataFrame, uniform_if_empty: bool = True) -> DataFrame:
    v = F.transform("counts", lambda c: c.cast("double"))
    return fps.withColumn("distribution", normalize(v, uniform_if_empty))


def with_entropy(fps: DataFrame) -> DataFrame:
    """Adds total (tokens) and entropy (nats)."""
    d = with_distribution(fps)
    return d.withColumn("total", total(F.transform("counts", lambda c: c.cast("double"))).cast("long")).withColumn("entropy", entropy(F.col("distribution")))


def long_form(fps: DataFrame) -> DataFrame:
    """(trace_id, agent, group, token_id, n) of the tokens that occur."""
    return fps.select("trace_id", "agent", "group", F.posexplode("counts").alias("token_id", "n")).where("n > 0")
