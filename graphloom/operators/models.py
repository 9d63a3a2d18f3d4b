"""Probes: stratified splits, ablations, and full-batch gradient descent for many runs at a time.

Rows stay dealt out over the tasks. In each epoch every task adds up the gradients of its rows for all runs, and the sums, whose
size depends on the models only, come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_order
from ..functions.vectors import as_matrix
from .groups import stash
from .ordered import running_sums


def n_test(n: Column, share: float) -> Column:
    """At least one, and halves rounded to even."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("long"))


def split(labels: DataFrame, seeds: list[int], share: float = 0.2) -> DataFrame:
    """(seed, node, y, is_test): in each class, the first by a hash of seed and id are for testing."""
    seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    rows = labels.select(seed, "node", "y").withColumn("h", hash_order(F.col("seed"), F.col("node")))
    k = running_sums(rows, [F.col("seed"), F.col("y"), F.col("h"), F.col("node")], {"k": F.lit(1)})
    sizes = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    starts = k.groupBy("seed", "y").agg((F.min("k") - 1).alias("base"))
    wide = k.join(F.broadcast(starts), ["seed", "y"]).join(F.broadcast(sizes), "y")  # a row for each seed and class
    return wide.select("seed", "node", "y", (F.col("k") - F.col("base") <= n_test(F.col("n"), share)).alias("is_test"))


ABLATIONS = ("embedding", "random_embedding", "label_shuffle", "validation_oracle")


def runs_of(vectors: DataFrame, splits: DataFrame, ablations: tuple[str, ...] = ABLATIONS) -> DataFrame:
    """(run, id, x, y, fit_y, is_test): a copy of the rows for each seed and ablation. ``vectors``: (id, v).

    random_embedding draws normal values by id and seed; label_shuffle permutes labels of training rows, on which training accuracy is then
    measured; validation_oracle appends the label, so a probe must find it.
    """
    rows = vectors.join(splits.withColumnRenamed("node", "id"), "id")
    train = rows.where("not is_test").select("seed", "id", "y")
    by_id = running_sums(train, [F.col("seed"), F.col("id")], {"k": F.lit(1)}).select("k", "seed", "id")
    mixed = running_sums(train.withColumn("h", hash_order(F.lit("shuffle"), F.col("seed"), F.col("id"))), [F.col("seed"), F.col("h"), F.col("id")], {"k": F.lit(1)}).select("k", F.col("y").alias("shuffled"))
    rows = rows.join(by_id.join(mixed, "k").select("seed", "id", "shuffled"), ["seed", "id"], "left")
    out = None
    for a in ablations:
        x = ablated(F.col("v"), a, F.col("id"), F.col("seed"), F.col("y"))
        fit = F.coalesce("shuffled", "y") if a == "label_shuffle" else F.col("y")
        one = rows.select(F.concat_ws(":", F.lit(a), "seed").alias("run"), "id", x.alias("x"), "y", fit.alias("fit_y"), "is_test")
        out = one if out is None else out.union(one)
    return out


def ablated(v: Column, ablation: str, id: Column, seed: Column, y: Column | None = None) -> Column:
    """The input of a probe: the vector, normal values by id and seed in its place, or the vector with the label."""
    if ablation == "random_embedding":
        u = lambda k, i: (F.pmod(F.xxhash64(id, seed, i, F.lit(k)), F.lit(1 << 40)) + 1) / ((1 << 40) + 1.0)
        return F.transform(v, lambda _, i: F.sqrt(-2 * F.log(u(1, i))) * F.cos(2 * np.pi * u(2, i)))
    return F.concat(v, F.array(y.cast("double"))) if ablation == "validation_oracle" else v


def scaled(runs: DataFrame) -> DataFrame:
    """``runs`` with x standardised by the mean and population deviation of the run's training rows; a deviation of 0 counts as 1."""
    cells = runs.where("not is_test").select("run", F.posexplode("x").alias("pos", "c")).groupBy("run", "pos").agg(F.avg("c").alias("m"), F.stddev_pop("c").alias("s"))
    stats = cells.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("pos", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("st"))
    wide = runs.join(F.broadcast(stats), "run")  # a row for each run
    return wide.withColumn("x", F.zip_with("x", "st", lambda x, t: (x - t["m"]) / t["s"])).drop("st")


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Logistic:
    """One weight for each input and a bias that is not regularised; starts from zeros."""

    def start(self, d: int) -> np.ndarray:
        return np.zeros(d + 1)

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _sig(x @ w[:-1] + w[-1])

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        e = self.predict(w, x) - y
        return np.append(x.T @ e, e.sum())

    def decay(self, w: np.ndarray) -> np.ndarray:
        return np.append(w[:-1], 0)


class FeedForward:
    """One hidden layer of rectified units; weights start from normal values over the root of the fan-in, by a fixed seed."""

    def __init__(self, hidden: int = 16, seed: int = 42):
        self.hidden, self.seed = hidden, seed

    def start(self, d: int) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w1, w2 = rng.normal(0, d**-0.5, (d, self.hidden)), rng.normal(0, self.hidden**-0.5, self.hidden)
        return np.concatenate([w1.ravel(), np.zeros(self.hidden), w2, [0.0]])

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        h = self.hidden
        d = (len(w) - 2 * h - 1) // h
        return w[: d * h].reshape(d, h), w[d * h : d * h + h], w[d * h + h : -1], w[-1]

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(w)
        return _sig(np.maximum(x @ w1 + b1, 0) @ w2 + b2)

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(w)
        a = np.maximum(x @ w1 + b1, 0)
        e = _sig(a @ w2 + b2) - y
        back = np.outer(e, w2) * (a > 0)
        return np.concatenate([(x.T @ back).ravel(), back.sum(0), a.T @ e, [e.sum()]])

    def decay(self, w: np.ndarray) -> np.ndarray:
        w1, b1, w2, _ = self.parts(w)
        return np.concatenate([w1.ravel(), 0 * b1, w2, [0.0]])


#: Bytes of a run's rows up to which one task trains it by itself. Beyond it, rows stay dealt out and each epoch adds up gradients.
FIT_BYTES = 64 << 20
#: Rows whose activations are held at a time.
ROWS = 8192


def _gradient(model: Logistic | FeedForward, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sum(model.gradient(w, x[at : at + ROWS], y[at : at + ROWS]) for at in range(0, len(x), ROWS))


def _small(runs: DataFrame) -> bool:
    most = runs.groupBy("run").agg(F.sum(F.size("x").cast("long") * 8).alias("b")).agg(F.max("b")).first()[0]
    return (most or 0) <= FIT_BYTES


def _loss(model: Logistic | FeedForward, w: np.ndarray, x: np.ndarray, y: np.ndarray, l2: float) -> float | None:
    if not len(x):
        return None
    total = 0.0
    for at in range(0, len(x), ROWS):
        p, own = model.predict(w, x[at : at + ROWS]), y[at : at + ROWS]
        total -= (own * np.log(p + 1e-12) + (1 - own) * np.log(1 - p + 1e-12)).sum()
    return float(total / len(x) + 0.5 * l2 * (model.decay(w) ** 2).sum())


def trained(runs: DataFrame, model: Logistic | FeedForward, epochs: int, rate: float, l2: float, every: int = 0) -> DataFrame:
    """(run, w, history) of runs that fit in a task each: weights after the last epoch, and both losses after each ``every`` epochs (0: none)."""

    schema = "run string, w array<double>, history array<struct<epoch int, train_loss double, test_loss double>>"
    point = pa.struct([("epoch", pa.int32()), ("train_loss", pa.float64()), ("test_loss", pa.float64())])

    def fit(own: pa.Table) -> pa.Table:
        x, test = as_matrix(own["x"]), own["is_test"].to_numpy()
        a, ya, b, yb = x[~test], own["fit_y"].to_numpy().astype(np.float64)[~test], x[test], own["y"].to_numpy().astype(np.float64)[test]
        run, w, history = own["run"][0].as_py(), model.start(x.shape[1]), []
        del x, own
        for epoch in range(1, epochs + 1):
            if len(a):
                w = w - rate * (_gradient(model, w, a, ya) / len(a) + l2 * model.decay(w))
            if every and epoch % every == 0:
                history.append({"epoch": epoch, "train_loss": _loss(model, w, a, ya, l2), "test_loss": _loss(model, w, b, yb, l2)})
        return pa.table({"run": [run], "w": pa.array([w], pa.list_(pa.float64())), "history": pa.array([history], pa.list_(point))})

    return runs.select("run", "x", "y", "fit_y", "is_test").groupBy("run").applyInArrow(fit, schema)


def _by_run(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each run of a batch, with its x and the places of its rows. Runs may differ in the length of x."""
    code = batch["run"].dictionary_encode()
    place, x = code.indices.to_numpy(), batch["x"]
    for i, run in enumerate(code.dictionary.to_pylist()):
        at = np.flatnonzero(place == i)
        yield run, as_matrix(x if len(at) == len(batch) else x.take(pa.array(at))), at


def descend(runs: DataFrame, model: Logistic | FeedForward, epochs: int, rate: float, l2: float, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Weights of each run after full-batch gradient descent on its training rows, from ``start`` if given."""
    if start is None and _small(runs):
        return {r["run"]: np.array(r["w"]) for r in trained(runs, model, epochs, rate, l2).select("run", "w").collect()}  # as large as the models
    train = runs.where("not is_test").select("run", "x", F.col("fit_y").cast("double").alias("y")).persist()
    shape = {r["run"]: (r["d"], r["n"]) for r in train.groupBy("run").agg(F.first(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n")).collect()}
    weights = dict(start) if start else {run: model.start(d) for run, (d, _) in shape.items()}
    for _ in range(epochs):
        now = dict(weights)

        def add(batches: Iterator[pa.RecordBatch], now: dict = now) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for run, x, at in _by_run(batch):
                    g = _gradient(model, now[run], x, batch["y"].to_numpy(zero_copy_only=False)[at])
                    total[run] = total[run] + g if run in total else g
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["run", "g"])

        cells = train.mapInArrow(add, "run string, g array<double>").select("run", F.posexplode("g").alias("pos", "g"))
        sums = cells.groupBy("run", "pos").agg(F.sum("g").alias("g")).toPandas().sort_values("pos")
        for run, own in sums.groupby("run"):
            weights[run] = weights[run] - rate * (own["g"].to_numpy() / shape[run][1] + l2 * model.decay(weights[run]))
    train.unpersist()
    return weights


def predictions(runs: DataFrame, model: Logistic | FeedForward, weights: dict[str, np.ndarray]) -> DataFrame:
    """(run, id, y, fit_y, is_test, prob, pred)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prob = np.zeros(len(batch))
            for name, x, at in _by_run(batch):
                prob[at] = model.predict(weights[name], x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prob), pa.array((prob >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "prob", "pred"])

    return runs.select("run", "id", "y", "fit_y", "is_test", "x").mapInArrow(run, f"run string, id {runs.schema['id'].dataType.simpleString()}, y int, fit_y int, is_test boolean, prob double, pred int")


def bce(p: Column, y: Column) -> Column:
    return -(y * F.log(p + 1e-12) + (1 - y) * F.log(1 - p + 1e-12))


def scores_by(rows: DataFrame, by: str | list[str], score: str, y: str, tie: str) -> DataFrame:
    """(by, auroc, auprc): as in ``ordered``, for every value of ``by``, by running sums over all, so that no task sees all of one."""
    by = [by] if isinstance(by, str) else by
    keys = [F.col(c) for c in by]
    counts = rows.groupBy(*by, score).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    up = running_sums(counts, [*keys, F.col(score)], {"upto": F.col("n")})
    total = up.groupBy(*by).agg(F.min(F.col("upto") - F.col("n")).alias("base"), F.sum("p").alias("pos"), F.sum("n").alias("all"))
    mid = F.col("upto") - F.col("base") - (F.col("n") - 1) / 2
    ranks = up.join(total, by).groupBy(*by).agg(F.sum(mid * F.col("p")).alias("r"))
    down = running_sums(rows.select(*by, score, tie, F.col(y).cast("long").alias("y")), [*keys, F.col(score).desc(), F.col(tie).asc()], {"tp": F.col("y"), "k": F.lit(1)})
    base = down.groupBy(*by).agg(F.min(F.col("tp") - F.col("y")).alias("tp0"), F.min(F.col("k") - 1).alias("k0"))
    tp, k = F.col("tp") - F.col("tp0"), F.col("k") - F.col("k0")
    prev = F.when(k > 1, (tp - 1) / (k - 1)).otherwise(1.0)
    areas = down.join(base, by).where("y = 1").groupBy(*by).agg(F.sum((tp / k + prev) / 2).alias("area"))
    p, n = F.col("pos"), F.col("all")
    out = total.join(ranks, by).join(areas, by, "left")
    return out.select(*by, F.when((p > 0) & (n > p), (F.col("r") - p * (p + 1) / 2) / (p * (n - p))).alias("auroc"), F.when(p > 0, F.col("area") / p).alias("auprc"))


def probe(vectors: DataFrame, labels: DataFrame, seeds: list[int], ablations: tuple[str, ...], model: Logistic | FeedForward, epochs: int, rate: float, l2: float) -> DataFrame:
    """(ablation, seed, train_accuracy, test_accuracy, test_auroc, test_auprc)."""
    runs = stash(scaled(runs_of(vectors, split(labels, seeds), ablations)), "runs")
    out = stash(predictions(runs, model, descend(runs, model, epochs, rate, l2)), "predictions")
    acc = out.groupBy("run").agg(
        F.avg(F.when(~F.col("is_test"), (F.col("pred") == F.col("fit_y")).cast("int"))).alias("train_accuracy"),
        F.avg(F.when(F.col("is_test"), (F.col("pred") == F.col("y")).cast("int"))).alias("test_accuracy"),
    )
    sc = scores_by(out.where("is_test"), "run", "prob", "y", "id").withColumnsRenamed({"auroc": "test_auroc", "auprc": "test_auprc"})
    parts = F.split("run", ":")
    return acc.join(sc, "run").select(parts[0].alias("ablation"), parts[1].cast("int").alias("seed"), "train_accuracy", "test_accuracy", "test_auroc", "test_auprc")


def held_out_predictions(predicted: DataFrame, genes: DataFrame) -> DataFrame:
    """(run, the columns of ``genes`` but id, y_true, y_prob, y_pred) of test rows. ``predicted``: ``predictions``; ``genes`` has an id."""
    rows = predicted.where("is_test").select("run", "id", F.col("y").alias("y_true"), F.col("prob").alias("y_prob"), F.col("pred").alias("y_pred"))
    return rows.join(genes, "id").select("run", *[c for c in genes.columns if c != "id"], "y_true", "y_prob", "y_pred")


def loss_history(runs: DataFrame, model: Logistic | FeedForward, epochs: int, every: int, rate: float, l2: float) -> DataFrame:
    """(epoch, train_loss, test_loss), averaged over runs, after each ``every`` epochs; the penalty counts in both."""
    if _small(runs):
        points = trained(runs, model, epochs, rate, l2, every).select(F.explode("history").alias("h")).select("h.*")
        return points.groupBy("epoch").agg(F.avg("train_loss").alias("train_loss"), F.avg("test_loss").alias("test_loss")).orderBy("epoch")  # a row per epoch
    rows, weights = [], {r["run"]: model.start(r["d"]) for r in runs.groupBy("run").agg(F.first(F.size("x")).alias("d")).collect()}
    for epoch in range(every, epochs + 1, every):
        weights = descend(runs, model, every, rate, l2, weights)
        penalty = float(np.mean([0.5 * l2 * (model.decay(w) ** 2).sum() for w in weights.values()]))
        p = predictions(runs, model, weights).groupBy("run", "is_test").agg(F.avg(bce(F.col("prob"), F.when(F.col("is_test"), F.col("y")).otherwise(F.col("fit_y")))).alias("l"))
        got = {r["is_test"]: r["l"] + penalty for r in p.groupBy("is_test").agg(F.avg("l").alias("l")).collect()}
        rows.append((epoch, got.get(False), got.get(True)))
    return runs.sparkSession.createDataFrame(rows, "epoch int, train_loss double, test_loss double")
