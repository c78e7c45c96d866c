"""Logistic models of factors from counts of cells, and what draws from the fitted model say of them.

Rows are counted by the levels of their factors; a fit sees cells, not rows. Draws are binomial numbers of
the cells, and all fits of a task go through Newton's steps together, as stacks of small systems.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 160
TOLERANCE = 1e-6
STACK = 250  #: fits that go together


@dataclass
class Design:
    """A constant and a column for each level of each factor but its reference, over cells."""

    names: list[str]
    columns: dict[str, list[int]]  #: of each factor
    x: np.ndarray
    n: np.ndarray
    hits: np.ndarray

    def without(self, factor: str) -> np.ndarray:
        return self.x[:, [i for i in range(self.x.shape[1]) if i not in self.columns[factor]]]


def cells(rows: DataFrame, y: str, references: dict[str, str]) -> Design:
    """Counts of rows and of hits for each combination of the factors' levels. Levels are fixed lists, so that
    cells are few however many rows there are; null is a level of its own."""
    level = {f: F.coalesce(F.col(f).cast("string"), F.lit("(none)")) for f in references}
    found = rows.groupBy(*[level[f].alias(f) for f in references]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("hits")).orderBy(*references).collect()
    names, columns, parts = ["(constant)"], {}, [np.ones(len(found))]
    for f, reference in references.items():
        levels = sorted({r[f] for r in found})
        if reference not in levels:
            raise ValueError(f"{f} has no rows of its reference {reference}")
        columns[f] = []
        for v in levels:
            if v != reference:
                columns[f].append(len(names))
                names.append(f"{f}={v}")
                parts.append(np.array([float(r[f] == v) for r in found]))
    return Design(names, columns, np.stack(parts, axis=1), np.array([r.n for r in found], float), np.array([r.hits or 0 for r in found], float))


def shares(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fitted share of hits in each cell (across), for each fit (down)."""
    return 1.0 / (1.0 + np.exp(-np.clip(b @ x.T, -35.0, 35.0)))


def log_likelihood(p: np.ndarray, n: np.ndarray, hits: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return (hits * np.log(p) + (n - hits) * np.log1p(-p)).sum(-1)


def fitted(x: np.ndarray, n: np.ndarray, hits: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of each fit (a row of hits each) under Firth's penalty, and whether it settled. A step that
    would lower the penalised likelihood is halved until it doesn't; fits that have settled are left alone."""
    b = np.zeros((len(hits), x.shape[1])) if start is None else np.tile(start, (len(hits), 1))
    settled, open_ = np.zeros(len(hits), bool), np.arange(len(hits))
    outer = x[:, :, None] * x[:, None, :]

    def information(p: np.ndarray) -> np.ndarray:
        return np.einsum("fc,cij->fij", np.maximum(p * (1 - p), 1e-10) * n, outer)

    def value(beta: np.ndarray, own: np.ndarray) -> np.ndarray:
        p = shares(x, beta)
        return log_likelihood(p, n, own) + 0.5 * np.linalg.slogdet(information(p))[1]

    best = value(b, hits)
    for _ in range(STEPS):
        if not len(open_):
            break
        own, beta = hits[open_], b[open_]
        p = shares(x, beta)
        inverse = np.linalg.pinv(information(p), rcond=1e-12)
        lever = np.maximum(p * (1 - p), 1e-10) * np.einsum("ci,fij,cj->fc", x, inverse, x)
        score = (own - n * p + n * lever * (0.5 - p)) @ x
        step = np.einsum("fij,fj->fi", inverse, score)
        scale, left = np.ones(len(open_)), np.arange(len(open_))
        accepted = np.zeros(len(open_), bool)
        while len(left):
            new = value(beta[left] + scale[left, None] * step[left], own[left])
            good = new >= best[open_[left]] - 1e-10
            accepted[left[good]] = True
            best[open_[left[good]]] = new[good]
            left = left[~good]
            scale[left] /= 2
            left = left[scale[left] >= 2.0**-20]
        b[open_[accepted]] += (scale[:, None] * step)[accepted]
        done = ~accepted | (np.abs(scale[:, None] * step).max(1) < TOLERANCE)
        settled[open_[done]] = accepted[done] | (np.abs(score[done]).max(1) < 1e-4)
        open_ = open_[~done]
    return b, settled


def drawn(p: np.ndarray, n: np.ndarray, draws: np.ndarray, kind: int) -> np.ndarray:
    """Hits of each cell, a row for each draw: the same for one draw in every run."""
    return np.array([np.random.default_rng([29, kind, int(d)]).binomial(n.astype(np.int64), p) for d in draws], float)


def deviances(spark, d: Design, draws: int) -> DataFrame:
    """factor, deviance, p, settled: what the fit loses without each factor, against what draws from the fit
    without it lose. Draws are dealt to tasks; a task fits STACK of them at once."""
    full, _ = fitted(d.x, d.n, d.hits[None, :])
    best = log_likelihood(shares(d.x, full), d.n, d.hits)[0]
    reduced = {f: fitted(d.without(f), d.n, d.hits[None, :])[0] for f in d.columns}
    observed = {f: max(0.0, 2 * (best - log_likelihood(shares(d.without(f), b), d.n, d.hits)[0])) for f, b in reduced.items()}
    order = list(d.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column("id").to_numpy()
            for k, f in enumerate(order):
                less = d.without(f)
                for lo in range(0, len(numbers), STACK):
                    hits = drawn(shares(less, reduced[f])[0], d.n, numbers[lo : lo + STACK], k)
                    a, ok_a = fitted(d.x, d.n, hits, full[0])
                    c, ok_c = fitted(less, d.n, hits, reduced[f][0])
                    x = np.maximum(0.0, 2 * (log_likelihood(shares(d.x, a), d.n, hits) - log_likelihood(shares(less, c), d.n, hits)))
                    ok = ok_a & ok_c
                    yield pa.RecordBatch.from_arrays([pa.array([f] * int(ok.sum()), pa.string()), pa.array(x[ok])], names=["factor", "x"])

    made = spark.range(draws).mapInArrow(run, "factor string, x double")
    own = F.broadcast(spark.createDataFrame([(f, float(observed[f]), len(d.columns[f])) for f in order], "factor string, deviance double, dof int"))
    return made.join(own, "factor").groupBy("factor", "deviance", "dof").agg(((F.count_if(F.col("x") >= F.col("deviance") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.count(F.lit(1)).alias("settled"))


def coefficients(spark, d: Design, draws: int, level: float = 0.05) -> DataFrame:
    """term, coef, low, high, settled: the fit, and the share of `level` of the draws' coefficients left out."""
    full, _ = fitted(d.x, d.n, d.hits[None, :])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column("id").to_numpy()
            for lo in range(0, len(numbers), STACK):
                found, ok = fitted(d.x, d.n, drawn(shares(d.x, full)[0], d.n, numbers[lo : lo + STACK], 99), full[0])
                yield pa.RecordBatch.from_arrays([pa.array(found[ok].tolist(), pa.list_(pa.float64()))], names=["b"])

    made = spark.range(draws).mapInArrow(run, "b array<double>").select(F.posexplode("b").alias("k", "b"))
    own = F.broadcast(spark.createDataFrame([(k, t, float(c)) for k, (t, c) in enumerate(zip(d.names, full[0], strict=True))], "k int, term string, coef double"))
    # a number for each draw and term, whatever the table's size
    return made.join(own, "k").groupBy("k", "term", "coef").agg(F.percentile("b", F.lit(level / 2)).alias("low"), F.percentile("b", F.lit(1 - level / 2)).alias("high"), F.count(F.lit(1)).alias("settled")).drop("k")
