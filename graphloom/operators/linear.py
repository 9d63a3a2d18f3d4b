"""Linear models by L-BFGS over one copy of the rows: the folds of a cross-validation, and both losses, are columns of one weight matrix.

All models take their steps together: an evaluation is one pass over the rows, whose tasks add up losses and gradients of all models, and the solver's
state, of the models' size, stays with whoever asks: a task of its own if the rows fit one, else the driver, with a job for each evaluation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_order
from ..functions.vectors import as_matrix
from . import models
from .groups import stash
from .ordered import running

LOSSES = ("logistic", "svm")
#: Bytes of the rows up to which a task solves by itself: all models take up to hundreds of passes over them.
SOLVE_BYTES = 4 << 20
Evaluate = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def folds(labels: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, y, fold): in each class, the rows in the order of a hash of seed and id are dealt out in turn, so folds differ by one row a class at most."""
    rows = labels.select("id", "y").withColumn("h", hash_order(F.lit(seed), F.col("id")))
    return running(rows, [F.col("h"), F.col("id")], {"place": ("sum", F.lit(1))}, ["y"]).select("id", "y", ((F.col("place") - 1) % k).cast("int").alias("fold"))


def losses(z: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and model, and its derivative by z: logistic, or the squared hinge of a linear SVM. ``y`` (rows, 1) is 0 or 1."""
    sign = 2 * y - 1
    m = sign * z
    gap = np.maximum(0, 1 - m)
    value = np.where(kinds == 0, np.logaddexp(0, -m), gap * gap)
    return value, np.where(kinds == 0, -sign / (1 + np.exp(np.clip(m, -500, 500))), -2 * sign * gap)


def part_sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, w: np.ndarray, kinds: np.ndarray, out: np.ndarray) -> np.ndarray:
    """(d + 2, models): gradient by weights and bias, and loss, over the rows that aren't in the model's fold. ``w`` (d + 1, models)."""
    use = fold[:, None] != out[None, :]
    value, slope = losses(x @ w[:-1] + w[-1], y[:, None], kinds[None, :])
    slope = slope * use
    return np.vstack([x.T @ slope, slope.sum(0)[None, :], (value * use).sum(0)[None, :]])


def minimise(evaluate: Evaluate, start: np.ndarray, tolerance: float = 1e-8, most: int = 200, memory: int = 10) -> np.ndarray:
    """Columns that each minimise their own function. ``evaluate`` takes a matrix and gives the values (models) and gradients of all columns.

    A limited-memory quasi-Newton step with halving until the value falls enough; columns whose largest derivative is within ``tolerance`` stay as they are.
    """
    w = start.copy()
    value, g = evaluate(w)
    steps: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(w.shape[1])]
    going = np.abs(g).max(0) > tolerance
    for _ in range(most):
        if not going.any():
            break
        way = np.zeros_like(w)
        for j in np.flatnonzero(going):
            q, kept = g[:, j].copy(), []
            for s, r in reversed(steps[j]):
                a = s @ q / (r @ s)
                kept.append(a)
                q -= a * r
            if steps[j]:
                s, r = steps[j][-1]
                q *= (s @ r) / (r @ r)
            for (s, r), a in zip(steps[j], reversed(kept)):
                q += s * (a - r @ q / (r @ s))
            way[:, j] = -q
        slope = (way * g).sum(0)
        t = np.where(going, 1.0, 0.0)
        for _ in range(40):
            new = w + t * way
            now, h = evaluate(new)
            bad = going & ~(now <= value + 1e-4 * t * slope + 1e-15 * np.abs(value))
            if not bad.any():
                break
            t = np.where(bad, t / 2, t)
        for j in np.flatnonzero(going):
            s, r = new[:, j] - w[:, j], h[:, j] - g[:, j]
            if s @ r > 1e-18:
                steps[j] = [*steps[j], (s, r)][-memory:]
        moved = np.abs(new - w).max(0) > 0
        w, value, g = new, now, h
        going &= (np.abs(g).max(0) > tolerance) & moved
    return w


def _objective(sums: Callable[[np.ndarray], np.ndarray], n: np.ndarray, l2: float) -> Evaluate:
    """Mean loss with the penalty l2 / 2 * |w|^2, which leaves the bias out."""

    def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = sums(w) / n
        free = np.vstack([w[:-1], np.zeros((1, w.shape[1]))])
        return s[-1] + 0.5 * l2 * (free * free).sum(0), s[:-1] + l2 * free

    return evaluate


def cross_validated(vectors: DataFrame, folded: DataFrame, k: int, l2: float, kinds: tuple[str, ...] = LOSSES) -> tuple[np.ndarray, DataFrame]:
    """The weights (d + 1, models), and (loss, fold, id, y, score): each row scored by the models that didn't see it. ``vectors``: (id, v); ``folded``: ``folds``.

    Models are ordered by loss, then fold. Columns are centred and scaled by all rows, which the weights are for.
    """
    rows = vectors.join(folded, "id").select("id", "y", "fold", F.col("v").alias("x"))
    rows = stash(rows, "rows")
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no rows to train on")
    kind, out = np.repeat(np.arange(len(kinds)), k), np.tile(np.arange(k), len(kinds))
    kind = np.array([LOSSES.index(kinds[i]) for i in kind])

    def added(of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if len(b):
                    s = of(as_matrix(b["x"]), b["y"].to_numpy(zero_copy_only=False).astype(np.float64), b["fold"].to_numpy(zero_copy_only=False))
                    total = s if total is None else total + s
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "g"])

        cells = rows.select("x", "y", "fold").mapInArrow(add, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "g"))
        sums = cells.groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()  # as large as the models
        m = np.zeros((sums["i"].max() + 1, sums["j"].max() + 1))
        m[sums["i"], sums["j"]] = sums["g"]
        return m

    first = added(lambda x, y, fold: np.vstack([x.sum(0), (x * x).sum(0)]))
    mean = first[0] / n
    sd = np.sqrt(np.maximum(first[1] / n - mean**2, 0))
    sd[sd < 1e-12] = 1.0
    size = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = np.maximum(np.array([n - size.get(int(f), 0) for f in out], dtype=float), 1)
    start = np.zeros((d + 1, len(kind)))
    if n * d * 8 <= min(models.FIT_BYTES, SOLVE_BYTES):

        def solve(own: pd.DataFrame) -> pd.DataFrame:
            x, y, fold = (np.stack(own["x"].to_numpy()) - mean) / sd, own["y"].to_numpy(np.float64), own["fold"].to_numpy()
            w = minimise(_objective(lambda w: part_sums(x, y, fold, w, kind, out), seen, l2), start)
            return pd.DataFrame({"i": range(len(w)), "w": list(w)})

        got = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "i int, w array<double>").collect()
        w = np.array([r["w"] for r in sorted(got, key=lambda r: r["i"])])
    else:
        w = minimise(_objective(lambda w: added(lambda x, y, fold: part_sums((x - mean) / sd, y, fold, w, kind, out)), seen, l2), start)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = (np.stack(b["x"].to_numpy()) - mean) / sd @ w[:-1] + w[-1]
                for i, name in enumerate(kinds):
                    own = z[np.arange(len(b)), i * k + b["fold"].to_numpy()]
                    yield pd.DataFrame({"loss": name, "fold": b["fold"], "id": b["id"], "y": b["y"], "score": own})

    id_kind, y_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "y"))
    return w, rows.mapInPandas(score, f"loss string, fold int, id {id_kind}, y {y_kind}, score double")


def fold_scores(scored: DataFrame) -> DataFrame:
    """(loss, fold, n, accuracy, auroc, auprc) of ``cross_validated``; a score above 0 is a positive."""
    scored = stash(scored, "scored")
    acc = scored.groupBy("loss", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("score") > 0) == (F.col("y") == 1)).cast("int")).alias("accuracy"))
    return acc.join(models.scores_by(scored, ["loss", "fold"], "score", "y", "id"), ["loss", "fold"])
