"""Same-condition noise floor: how far two random groups of one condition diverge.

The draws are those of numpy's seeded generator per cell and group size, so reports can
be reproduced. A row meets the list of draws that picked it once for each group size, and
every partition adds up what it holds to one vector a draw and side, so no cell is
gathered anywhere and picks aren't exploded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import jsd_term
from .bpe import Vocabulary, encode, fit_bpe, with_distribution
from .divergence import grouping

MIN_GROUP_SIZE = 5
DELTAS = (0.2, 0.1, 0.05, 0.02)


def size_grid(most: int) -> list[int]:
    """5, 10, 25, 50, 100, 250, ... up to and ending with most."""
    out, scale = [], 1
    while True:
        for base in (5, 10, 25):
            if base * scale >= most:
                return [*out, most]
            out.append(base * scale)
        scale *= 10


def cell_key(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")


_AT_ONCE = 2_000_000


def _draws(seed: int, n_draws: int):
    """For each row of a cell the draws and sides (draw * 2 + side) in which it was picked, some draws at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cell, total, n in f.itertuples(index=False):
                rng = np.random.default_rng([seed, cell_key(cell), int(n)])
                step = max(1, _AT_ONCE // (2 * int(n)))
                for first in range(0, n_draws, step):
                    count = min(step, n_draws - first)
                    rows = np.concatenate([rng.choice(int(total), size=2 * int(n), replace=False) for _ in range(count)])
                    codes = np.repeat(np.arange(2 * first, 2 * (first + count)), int(n)).astype(np.int32)
                    order = np.argsort(rows, kind="stable")
                    rows, codes = rows[order], codes[order]
                    cut = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                    yield pd.DataFrame({"cell": cell, "n": int(n), "row": rows[cut], "codes": np.split(codes, cut[1:])})

    return run


def _sums(n_draws: int, size: int):
    """Sums of the picked rows' distributions per draw and side, one partial sum a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for f in frames:
            for key, g in f.groupby(["cell", "n"], sort=False):
                p = np.array(g["distribution"].tolist()).reshape(len(g), size)
                codes = np.concatenate(g["codes"].to_numpy())
                own = np.repeat(np.arange(len(g)), g["codes"].map(len).to_numpy())
                held = total.setdefault(key, np.zeros((2 * n_draws, size)))
                for t in range(size):
                    held[:, t] += np.bincount(codes, weights=p[own, t], minlength=2 * n_draws)
        for (cell, n), held in total.items():
            code, token = np.nonzero(held)
            yield pd.DataFrame({"cell": cell, "n": n, "code": code.astype(np.int32), "token_id": token.astype(np.int32), "p": held[code, token]})

    return run


def floor_points(traces: DataFrame, condition: str, vocab: Vocabulary, seed: int = 0, n_draws: int = 200) -> DataFrame:
    """(cell, n, mean, p2_5, p97_5) for each cell with at least two groups of the smallest size."""
    rows = traces.where(F.size("atoms") > 0).withColumn("cell", grouping(traces, condition)).where("cell is not null")
    fps = encode(rows, vocab).select("trace_id", "counts")
    order = rows.select("cell", "trace_id", F.row_number().over(Window.partitionBy("cell").orderBy("_ord", "trace_id")).alias("r"))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("total")).where(F.col("total") >= 2 * MIN_GROUP_SIZE)
    grid = F.udf(lambda m: size_grid(int(m)), "array<int>")  # one call per cell
    plan = sizes.select("cell", "total", F.explode(grid(F.floor(F.col("total") / 2))).alias("n"))
    picks = plan.repartition("cell", "n").mapInPandas(_draws(seed, n_draws), "cell string, n int, row long, codes array<int>")
    numbered = order.select("cell", "trace_id", (F.col("r") - 1).cast("long").alias("row")).join(with_distribution(fps).select("trace_id", "distribution"), "trace_id")
    chosen = picks.join(numbered, ["cell", "row"]).select("cell", "n", "codes", "distribution")
    part = chosen.mapInPandas(_sums(n_draws, vocab.size), "cell string, n int, code int, token_id int, p double")
    side = lambda k: (F.sum(F.when(F.col("code") % 2 == k, F.col("p")).otherwise(0.0)) / F.col("n"))
    means = part.groupBy("cell", "n", F.floor(F.col("code") / 2).alias("draw"), "token_id").agg(side(0).alias("a"), side(1).alias("b"))
    draws = means.groupBy("cell", "n", "draw").agg(F.greatest(F.lit(0.0), F.sum(jsd_term(F.col("a"), F.col("b"))) / math.log(2)).alias("d"))
    return draws.groupBy("cell", "n").agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("p2_5"), F.percentile("d", F.lit(0.975)).alias("p97_5"))


def measure_floor(traces: DataFrame, condition: str, *, n_draws: int = 200, deltas: Sequence[float] = DELTAS, vocab_size: int = 64, seed: int = 0, source: str = "traces") -> dict:
    """The report: curves per cell, seeds needed per delta, refused cells."""
    parsed = traces.where(F.size("atoms") > 0)
    cells = {r.cell: r.n for r in parsed.groupBy(grouping(parsed, condition).alias("cell")).agg(F.count("*").alias("n")).collect() if r.cell is not None}
    if not cells:
        raise ValueError(f"no trajectory has the condition {condition!r}")
    refused = {c: n for c, n in cells.items() if n < 2 * MIN_GROUP_SIZE}
    if len(refused) == len(cells):
        raise ValueError(f"no cell has {2 * MIN_GROUP_SIZE} trajectories: {cells}")
    vocab = fit_bpe(parsed, vocab_size, seed=seed, fit_corpus=source)
    curves: dict[str, list] = {}
    for r in floor_points(parsed, condition, vocab, seed, n_draws).orderBy("cell", "n").collect():
        curves.setdefault(r.cell, []).append({"n": r.n, "mean": r["mean"], "p2_5": r.p2_5, "p97_5": r.p97_5})
    needed = {c: {d: next((p["n"] for p in curve if p["p97_5"] < d), None) for d in deltas} for c, curve in curves.items()}
    return {"source": source, "condition": condition, "seed": seed, "n_draws": n_draws, "vocab_spec": vocab.spec, "cells": curves, "seeds_needed": needed, "refused": refused}
