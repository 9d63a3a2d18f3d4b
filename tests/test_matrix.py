"""The experiment matrix in keyed jobs against its entries one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import bits, experiment, graph, linear, matrix, models, permute

from .test_operators import frame, reference_logistic

SEEDS = [7, 8]
BASELINES = [("observed_ad", 1), ("permute_labels", 2), ("random_matched_set", 2), (experiment.ANNOTATED, 2)]


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(1)
    runs = experiment.matrix(spark, ["c"], ["embedding", "label_shuffle"], BASELINES, SEEDS)
    sets, seeds, per = matrix.number_sets(runs)
    labels = frame(spark, [(f"n{i:02d}", int(i % 3 == 0)) for i in range(60)], "node string, y int")
    counts = frame(spark, [(f"n{i:02d}", int(rng.integers(0, 9))) for i in range(55)], "node string, annotation_count int")
    nodes = matrix.labelled(sets, seeds, per, labels, counts)
    return sets, seeds, per, labels, counts, nodes


def members(nodes, sets):
    found = bits.listed(nodes).join(sets, "idx").collect()
    out = {}
    for r in found:
        out.setdefault((r["baseline"], r["replicate"], r["seed"]), set()).add(r["node"])
    return out


def test_label_sets_are_those_made_one_by_one(spark, case):
    sets, _, _, labels, counts, nodes = case
    got = members(nodes, sets)
    assert len(got) == 14 and all(len(x) == 20 for x in got.values())
    for baseline, replicate, seed in [("observed_ad", 0, 7), ("permute_labels", 1, 8), ("random_matched_set", 0, 7), (experiment.ANNOTATED, 1, 8)]:
        one = experiment.baseline_labels(labels, baseline, seed, replicate, counts)
        assert got[baseline, replicate, seed] == {r["node"] for r in one.where("y = 1").collect()}


def test_without_known_counts_a_matched_set_is_filled_up(spark, case):
    sets, seeds, per, labels, _, _ = case
    unknown = frame(spark, [("other", 3)], "node string, annotation_count int")
    got = members(matrix.labelled(sets, seeds, per, labels, unknown), sets)
    want = experiment.baseline_labels(labels, "random_matched_set", 7, 1)
    assert got[experiment.ANNOTATED, 1, 7] == {r["node"] for r in want.where("y = 1").collect()}
    assert got[experiment.ANNOTATED, 1, 7] == members(matrix.labelled(sets, seeds, per, labels), sets)[experiment.ANNOTATED, 1, 7]


def test_splits_are_those_of_each_set(spark, case):
    sets, seeds, per, labels, _, nodes = case
    n = len(seeds) * per * bits.WORD
    split = matrix.splits(sets, nodes, n)
    test = members(split.withColumnRenamed("test", "bits").select("node", "bits"), sets)
    moved = members(split.withColumnRenamed("shuffled", "bits").select("node", "bits"), sets)
    assert test["observed_ad", 0, 8] == {r["node"] for r in models.split(labels, [8]).where("is_test").collect()}
    vectors = labels.select(F.col("node").alias("id"), F.array(F.lit(1.0)).alias("v"))
    run = models.runs_of(vectors, models.split(labels, [8]), ("label_shuffle",))
    assert moved["observed_ad", 0, 8] == {r["id"] for r in run.where("not is_test and fit_y = 1").collect()}


@pytest.fixture(scope="module")
def probed(spark, case):
    sets, seeds, per, labels, _, nodes = case
    rng = np.random.default_rng(2)
    x = {f"n{i:02d}": [*(rng.normal(size=3) + i % 3), 4.0] for i in range(60)}
    v = frame(spark, [(n, [float(a) for a in own]) for n, own in x.items()], "node string, v array<double>")
    split = matrix.splits(sets, nodes, len(seeds) * per * bits.WORD)
    rows = matrix.copies(v, nodes, split, seeds, per, ["embedding", "random_embedding", "label_shuffle"])
    return x, v, rows, matrix.probes(rows, sets, seeds, per, 30, 0.05, 1e-3).collect()


def test_probes_are_those_of_single_runs(spark, case, probed):
    sets, _, _, labels, _, _ = case
    _, v, _, got = probed
    assert len(got) == 3 * 14
    own = {r["idx"]: r["seed"] for r in sets.where("baseline = 'observed_ad'").collect()}
    for ablation in ("embedding", "label_shuffle"):
        want = {r["seed"]: [r[c] for c in matrix.SCORES] for r in models.probe(v.withColumnRenamed("node", "id"), labels, SEEDS, (ablation,), models.Logistic(), 30, 0.05, 1e-3).collect()}
        for r in got:
            if r["ablation"] == ablation and r["idx"] in own:
                assert [r[c] for c in matrix.SCORES] == pytest.approx(want[own[r["idx"]]], abs=1e-9)


def test_rows_that_stay_dealt_out_give_the_same(spark, case, probed, monkeypatch):
    sets, seeds, per, _, _, _ = case
    _, _, rows, want = probed
    monkeypatch.setattr(matrix, "FIT_BYTES", 0)
    want = {(r["ablation"], r["idx"]): [r[c] for c in matrix.SCORES] for r in matrix.probes(rows, sets, seeds, per, 3, 0.05, 1e-3).collect()}
    monkeypatch.setattr(matrix, "FIT_BYTES", 1 << 20)
    got = {(r["ablation"], r["idx"]): [r[c] for c in matrix.SCORES] for r in matrix.probes(rows, sets, seeds, per, 3, 0.05, 1e-3).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_probes_train_no_bits_without_a_set(spark, case, probed, monkeypatch):
    """Seven sets of a seed made 64 probes, as many as a word has bits; and steps in pieces are those of all rows."""
    sets, seeds, per, _, _, _ = case
    seen, scored = [], matrix._scored
    monkeypatch.setattr(matrix, "FIT_BYTES", 0)
    monkeypatch.setattr(matrix, "_scored", lambda rows, fits, *rest: seen.extend(f.w.shape[1] for f in fits.values()) or scored(rows, fits, *rest))
    got = matrix.probes(probed[2], sets, seeds, per, 1, 0.05, 1e-3)
    assert seen and set(seen) == {7} and got.select("ablation", "idx").distinct().count() == 3 * 14

    rng = np.random.default_rng(3)
    x, y, train = rng.normal(size=(50, 4)), rng.integers(0, 2, (50, 5)).astype(float), (rng.random((50, 5)) < 0.8).astype(float)
    f = matrix.Fits(4, 5)
    f.standardise(f.sums(x, train))
    whole = f.gradient(x, y, train)
    monkeypatch.setattr(matrix, "STEP_ROWS", 7)
    assert f.gradient(x, y, train) == pytest.approx(whole, abs=1e-12)


def test_folded_standardising_is_that_of_numpy():
    """Weights of 200 epochs of several sets over one copy of x against each trained by itself on standardised rows; one column is constant."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(50, 3)) * [1, 9, 0.1], np.full(50, 2.0)])
    y, train = rng.integers(0, 2, (50, 4)).astype(float), (rng.random((50, 4)) < 0.8).astype(float)
    f = matrix.Fits(4, 4)
    f.standardise(f.sums(x - x.mean(0), train))
    for _ in range(200):
        f.step(f.gradient(x - x.mean(0), y, train), 0.05, 1e-3)
    for j in range(4):
        own = x[train[:, j] == 1]
        sd = own.std(0)
        z = (own - own.mean(0)) / np.where(sd == 0, 1, sd)
        assert np.append(f.w[:, j], f.b[j]) == pytest.approx(reference_logistic(z, y[train[:, j] == 1, j], 200, 0.05, 1e-3), abs=1e-9)


def test_oracle_vectors_are_refused(spark, case):
    _, seeds, per, _, _, nodes = case
    with pytest.raises(ValueError):
        matrix.copies(nodes, nodes, nodes, seeds, per, ["validation_oracle"])


def test_hop_tests_are_those_of_each_set(spark, case):
    sets, seeds, per, labels, _, nodes = case
    rng = np.random.default_rng(6)
    rows = [(f"n{i:02d}", f"n{j:02d}", k) for i in range(60) for k, j in enumerate(rng.choice([j for j in range(60) if j != i], 4, replace=False), 1)]
    nn = frame(spark, rows, "id string, neighbour string, rank int")
    edges = frame(spark, sorted({tuple(sorted(f"n{int(a):02d}" for a in rng.choice(60, 2, replace=False))) for _ in range(90)}), "src string, dst string")
    binned = nodes.join(graph.degree_bins(labels, edges, 4).select("node", "bin"), "node")
    got = matrix.hop_tests(nn, binned, edges, [1, 4], seeds, per, 20).join(sets, "idx").where("baseline = 'permute_labels' and replicate = 1 and seed = 8")
    lab = experiment.permuted(labels, 8, 1)
    perms = bits.shuffled(lab.join(binned.select("node", "bin"), "node"), 20, 8, "bin")
    want = permute.hop_significance(permute.hop_rows(nn, lab, edges, [1, 4]), perms, 20)
    key = lambda df: {(r["k"], r["metric"]): (pytest.approx(r["delta"], abs=2e-9), pytest.approx(r["pvalue_right"])) for r in df.collect()}
    want = {(r["k"], r["metric"]): (r["delta"], r["pvalue_right"]) for r in want.collect()}
    assert len(want) == 6 and key(got) == want


@pytest.mark.parametrize("small", [True, False])
def test_losses_and_weights_of_the_hidden_layer(spark, monkeypatch, small):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 3)), rng.integers(0, 2, 30)
    rows = [("r", i, a.tolist(), int(b), int(b), i >= 24) for i, (a, b) in enumerate(zip(x, y))]
    runs = frame(spark, rows, "run string, id long, x array<double>, y int, fit_y int, is_test boolean")
    if not small:
        monkeypatch.setattr(models, "FIT_BYTES", 0)
    m = models.FeedForward(4)
    w, want = m.start(3), []
    for _ in range(3):
        w = w - 0.1 * (m.gradient(w, x[:24], y[:24]) / 24 + 0.01 * m.decay(w))
        loss = lambda a, b: -np.mean(b * np.log(m.predict(w, a) + 1e-12) + (1 - b) * np.log(1 - m.predict(w, a) + 1e-12)) + 0.005 * (m.decay(w) ** 2).sum()  # noqa: B023, E731
        want.append((loss(x[:24], y[:24]), loss(x[24:], y[24:])))
    got = models.loss_history(runs, m, 3, 1, 0.1, 0.01).orderBy("epoch").collect()
    assert [(r["train_loss"], r["test_loss"]) for r in got] == [pytest.approx(p) for p in want]
    assert models.descend(runs, m, 3, 0.1, 0.01)["r"] == pytest.approx(w)


def test_probe_with_ids_of_text(spark):
    rng = np.random.default_rng(3)
    v = frame(spark, [(f"GENE{i}", rng.normal(size=4).tolist()) for i in range(60)], "id string, v array<double>")
    lab = frame(spark, [(f"GENE{i}", i % 2) for i in range(60)], "node string, y int")
    p = models.probe(v, lab, [1], ("validation_oracle",), models.Logistic(), 12, 1.0, 0.0).first()
    assert p["test_auroc"] == pytest.approx(1) and p["test_accuracy"] == 1


@pytest.mark.parametrize("small", [True, False])
def test_folds_of_both_losses_are_at_their_minimum(spark, monkeypatch, small):
    """Weights of all folds against a plain Newton solver for each, and held-out scores against those weights."""
    if not small:
        monkeypatch.setattr(models, "FIT_BYTES", 0)
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=(80, 2)) * [1, 30], np.full(80, 3.0)])
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(int)
    k, l2 = (3 if small else 2), 0.05
    v = frame(spark, [(f"g{i:02d}", r.tolist()) for i, r in enumerate(x)], "id string, v array<double>")
    folded = linear.folds(frame(spark, [(f"g{i:02d}", int(c)) for i, c in enumerate(y)], "id string, y int"), k, 1)
    fold = {r["id"]: r["fold"] for r in folded.collect()}
    f = np.array([fold[f"g{i:02d}"] for i in range(80)])
    for c in (0, 1):
        n = np.bincount(f[y == c], minlength=k)
        assert n.max() - n.min() <= 1
    kinds = linear.LOSSES if small else ("svm",)
    w, scored = linear.cross_validated(v, folded, k, l2, kinds)
    sd = x.std(0)
    z = np.column_stack([(x - x.mean(0)) / np.where(sd == 0, 1, sd), np.ones(80)])
    free = np.diag([1.0, 1, 1, 0])
    for i, kind in enumerate(kinds):
        for j in range(k):
            a, s = z[f != j], 2.0 * y[f != j] - 1
            u = np.zeros(4)
            for _ in range(60):
                m = s * (a @ u)
                if kind == "logistic":
                    p = 1 / (1 + np.exp(m))
                    g, h = a.T @ (-s * p), (a * (p * (1 - p))[:, None]).T @ a
                else:
                    on = m < 1
                    g, h = a.T @ (-2 * s * np.maximum(0, 1 - m)), 2 * a[on].T @ a[on]
                u -= np.linalg.pinv(h / len(a) + l2 * free) @ (g / len(a) + l2 * free @ u)
            assert w[:, i * k + j] == pytest.approx(u, abs=1e-6)
    got = {(r["loss"], r["id"]): r["score"] for r in scored.collect()}
    assert len(got) == 80 * len(kinds)
    for (kind, g), score in got.items():
        r = int(g[1:])
        assert score == pytest.approx(z[r] @ w[:, kinds.index(kind) * k + f[r]])
    table = linear.fold_scores(scored).collect()
    assert len(table) == k * len(kinds) and all(r["auroc"] > 0.7 and r["n"] == (f == r["fold"]).sum() for r in table)


def test_gradients_and_losses_in_pieces_are_those_of_all_rows(spark, monkeypatch):
    """A task holds activations of a few rows at a time."""
    rng = np.random.default_rng(3)
    rows = [("r", k, rng.normal(size=3).tolist(), k % 2, k % 2, k % 5 == 0) for k in range(40)]
    runs = frame(spark, rows, "run string, id long, x array<double>, y int, fit_y int, is_test boolean")
    m, x, y = models.FeedForward(), np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    w, seen = m.start(3), []
    monkeypatch.setattr(models, "ROWS", 7)
    own = m.predict
    monkeypatch.setattr(m, "predict", lambda w, x: seen.append(len(x)) or own(w, x))
    loss, p = models._loss(m, w, x, y, 0.1), own(w, x)
    assert max(seen) == 7 and sum(seen) == 40
    assert loss == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.05 * (m.decay(w) ** 2).sum())
    assert models._gradient(m, w, x, y) == pytest.approx(m.gradient(w, x, y))
    assert models.trained(runs, models.FeedForward(), 2, 0.1, 0.1).first()["w"]


def test_folds_of_more_rows_than_a_task_solves_stay_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = frame(spark, [(i, rng.normal(size=2).tolist(), i % 2) for i in range(40)], "id long, v array<double>, y int")
    folded = linear.folds(v, 2, 1)
    want, _ = linear.cross_validated(v.select("id", "v"), folded, 2, 0.1)
    asked, own = [], linear.minimise
    monkeypatch.setattr(linear, "SOLVE_BYTES", 40 * 2 * 8 - 1)
    monkeypatch.setattr(linear, "minimise", lambda *a: asked.append(a) or own(*a))
    got, _ = linear.cross_validated(v.select("id", "v"), folded, 2, 0.1)
    assert len(asked) == 1 and got == pytest.approx(want, abs=1e-6)
