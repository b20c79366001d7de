"""Column expressions over atom sequences (arrays of strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spine(atoms: Column) -> Column:
    """The string that patterns see: atoms joined by spaces, and a space at the end."""
    return F.concat(F.array_join(atoms, " "), F.lit(" "))


def count_of(atoms: Column, atom: str) -> Column:
    return F.size(F.filter(atoms, lambda a: a == atom))


def first_index(atoms: Column, atom: str) -> Column:
    """0-based place of the first occurrence; the length where there is none."""
    at = F.array_position(atoms, F.lit(atom))
    return F.when(at > 0, at.cast("int") - 1).otherwise(F.size(atoms))


def before_first(atoms: Column, atom: str) -> Column:
    return F.slice(atoms, F.lit(1), first_index(atoms, atom))


def after_first(atoms: Column, atom: str) -> Column:
    """What follows the first occurrence; empty where there is none."""
    return F.slice(atoms, first_index(atoms, atom) + 2, F.size(atoms))


def max_run(atoms: Column, atom: str) -> Column:
    """Length of the longest run of one atom."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, a: Column) -> Column:
        run = F.when(a == atom, s["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(atoms, start, step, lambda s: s["best"])


def trailing_run(atoms: Column, atom: str) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(True).alias("open"))

    def step(s: Column, a: Column) -> Column:
        more = s["open"] & (a == atom)
        return F.struct(F.when(more, s["run"] + 1).otherwise(s["run"]).alias("run"), more.alias("open"))

    return F.aggregate(F.reverse(atoms), start, step, lambda s: s["run"])


def ends_with(atoms: Column, seq: list[str]) -> Column:
    if not seq:
        return F.lit(True)
    k = len(seq)
    return (F.size(atoms) >= k) & (F.slice(atoms, F.greatest(F.size(atoms) - k + 1, F.lit(1)), F.lit(k)) == F.array(*map(F.lit, seq)))


def contains_seq(atoms: Column, seq: list[str]) -> Column:
    """Whether seq stands in atoms without gaps; an empty seq never does."""
    if not seq:
        return F.lit(False)
    k = len(seq)
    want = F.array(*map(F.lit, seq))
    places = F.when(F.size(atoms) >= k, F.sequence(F.lit(1), F.greatest(F.size(atoms) - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: F.slice(atoms, i, F.lit(k)) == want)


def count_seq(atoms: Column, seq: list[str]) -> Column:
    """Places at which seq stands without gaps, overlaps counted."""
    if not seq:
        return F.lit(0)
    k = len(seq)
    want = F.array(*map(F.lit, seq))
    places = F.when(F.size(atoms) >= k, F.sequence(F.lit(1), F.greatest(F.size(atoms) - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.slice(atoms, i, F.lit(k)) == want))


def matches_with_gaps(atoms: Column, seq: list[str], max_gap: int | None) -> Column:
    """Whether seq stands in atoms in order, with at most max_gap steps from one to the next (any number if None)."""
    skip = r"(?:\S+ )*?" if max_gap is None else rf"(?:\S+ ){{0,{max(0, max_gap - 1)}}}?"
    import re

    body = skip.join(re.escape(a) + " " for a in seq)
    return spine(atoms).rlike(rf"(?:^| ){body}")


def segments(atoms: Column, separator: str) -> Column:
    """Lengths of the runs between separators, empty ones left out; without any separator the whole is one run."""
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("done"))

    def step(s: Column, a: Column) -> Column:
        closed = F.when(s["run"] > 0, F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"])
        return F.when(a == separator, F.struct(F.lit(0).alias("run"), closed.alias("done"))).otherwise(F.struct((s["run"] + 1).alias("run"), s["done"].alias("done")))

    return F.aggregate(atoms, start, step, lambda s: F.when(s["run"] > 0, F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"]))


def bigrams(atoms: Column) -> Column:
    """Adjacent pairs as left|right."""
    places = F.when(F.size(atoms) >= 2, F.sequence(F.lit(1), F.greatest(F.size(atoms) - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.get(atoms, i - 1), F.lit("|"), F.get(atoms, i)))


def thirds(atoms: Column, part: int) -> Column:
    """The first (0), middle (1) or last (2) third, with bounds rounded down."""
    n = F.size(atoms)
    lo, hi = F.floor(n * part / 3).cast("int"), F.floor(n * (part + 1) / 3).cast("int")
    return F.slice(atoms, lo + 1, hi - lo)
