"""Small cases: traps of nulls, NaN, ties and empty sides, and numpy derivations of what SQL can't say."""

import gzip
import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text, vectors as fv
from graphloom.operators import cohort, experiment, graph, models, ordered, permute, vectors
from graphloom.operators.groups import components
from graphloom.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_edges_are_cleaned(spark):
    e = frame(spark, [("a", "B", 700.0), ("b ", "a", 900.0), ("a", "a", 999.0), ("", "c", 999.0), (None, "c", 999.0), ("c", "d", float("nan")), ("c", "e", 699.9)], "s string, t string, w double")
    assert graph.build(e, score="w", least=700).collect() == [("A", "B")]
    assert graph.build(e).count() == 3
    with pytest.raises(ValueError):
        graph.build(e, least=1)
    with pytest.raises(ValueError):
        graph.build(e, score="x")


def test_lenient_score(spark):
    e = frame(spark, [("a", "b", "x"), ("a", "c", "701"), ("a", "d", None)], "s string, t string, w string")
    assert graph.build(e, score="w", least=700, strict=False).collect() == [("A", "C")]


def test_accessions(spark):
    d = frame(spark, [("p1|q2",), (" a;b",), ("|",), (None,), ("x,y z",)], "a string")
    assert [r[0] for r in d.select(text.first_accession(F.col("a"))).collect()] == ["P1", "A", None, None, "X"]
    n = frame(spark, [("x/AF-Q8NH85-F1-model_v4",), ("none",)], "a string")
    assert [r[0] for r in n.select(text.accession_of_name(F.col("a"))).collect()] == ["Q8NH85", None]


def test_region_keeps_the_effective_rule(spark):
    d = frame(spark, [("TL", "x", "V1C"), ("FL", "x", "ca-hc"), ("TL", "x", "PHG"), ("FL", "hippocampus", "x"), (None, None, None), ("FL", "parahippocampal", "x")], "m string, s string, a string")
    own = [r[0] for r in d.select(text.region(F.col("m"), F.col("s"), F.col("a"))).collect()]
    assert own == ["temporal", "hippocampus", "entorhinal", None, None, None]
    fixed = [r[0] for r in d.select(text.region(F.col("m"), F.col("s"), F.col("a"), fix_case=True)).collect()]
    assert fixed[3] == "hippocampus" and fixed[5] == "entorhinal"


@pytest.mark.parametrize("values,q", [([1, 1, 1], 4), ([1, 2, 2, 2, 3, 9, 9, 10], 4), (list(range(30)) + [5] * 20, 10), ([4, 7], 10)])
def test_qcut_is_that_of_pandas(spark, values, q):
    d = frame(spark, list(enumerate(values)), "i int, x int")
    got = [r["bin"] for r in ordered.qcut(d, "x", q).orderBy("i").collect()]
    n = min(max(2, q), len(set(values)))
    want = [0] * len(values) if n <= 1 else pd.qcut(pd.Series(values), n, labels=False, duplicates="drop").tolist()
    assert got == want


def test_quantiles(spark):
    d = frame(spark, [(float(x),) for x in (5, 1, 4, 4)] + [(None,), (float("nan"),)], "x double")
    assert ordered.quantiles(d, "x", [0, 0.5, 0.9, 1]) == pytest.approx(np.quantile([1, 4, 4, 5], [0, 0.5, 0.9, 1]).tolist())
    assert ordered.quantiles(d.where("false"), "x", [0.5]) == [None]


def test_scores_of_one_class_and_ties(spark):
    d = frame(spark, [(0.5, 1, 1), (0.5, 0, 2)], "s double, y int, id int")
    assert ordered.auroc(d, "s", "y").first()[0] == 0.5
    assert ordered.auroc(d.where("y = 1"), "s", "y").first()[0] is None
    assert ordered.auprc(d.where("y = 0"), "s", "y", "id").first()[0] is None
    assert ordered.auprc(d, "s", "y", "id").first()[0] == 1.0


def test_zscore_of_a_constant(spark):
    d = frame(spark, [(2.0,), (2.0,)], "x double")
    assert {r["z"] for r in ordered.zscore(d, "x", "z").collect()} == {0.0}


def test_average_ranks(spark):
    d = frame(spark, [(1.0,), (3.0,), (3.0,), (7.0,)], "x double")
    assert sorted(r["rank"] for r in ordered.average_ranks(d, "x").collect()) == [1, 2.5, 2.5, 4]


def test_nearest_handles_ties_zero_vectors_and_large_k(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 0)]
    v = frame(spark, rows, "id long, v array<double>, y int")
    got = vectors.nearest(v, 9, block=2).where("id = 1").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [2, 3, 4]
    one = vectors.distance_summary(vectors.distance_counts(v.where("y = 1"), block=2)).orderBy("pair_type").collect()
    assert [r["n_pairs"] for r in one] == [1, 0, 0] and one[0]["median_cosine_distance"] == 0 and one[1]["mean_cosine_distance"] is None


def test_spectrum_is_that_of_numpy(spark):
    m = np.random.default_rng(1).normal(size=(40, 5))
    v = frame(spark, [(i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>")
    s = np.linalg.svd(m - m.mean(0), compute_uv=False) ** 2
    got = vectors.pca(v).orderBy("component").collect()
    assert [r["variance_ratio"] for r in got] == pytest.approx((s / s.sum()).tolist())
    assert got[0]["effective_rank"] == pytest.approx(s.sum() ** 2 / (s**2).sum())
    u = np.linalg.svd(m - m.mean(0), full_matrices=False)
    want = np.abs(u[0][:, 0] * u[1][0])
    assert [abs(r["score"]) for r in vectors.project(v, 1).orderBy("id").collect()] == pytest.approx(want.tolist())


def test_mean_vectors_and_expressions(spark):
    v = frame(spark, [("a", [1.0, 3.0]), ("a", [3.0, 5.0])], "g string, v array<double>")
    assert vectors.mean_vectors(v, "g").first()["v"] == [2.0, 4.0]
    d = v.select(fv.dot(F.col("v"), F.col("v")).alias("d"), fv.norm(fv.unit(F.col("v"))).alias("n")).first()
    assert d["d"] == 10 and d["n"] == pytest.approx(1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components(spark, pairs):
    seen = {r["node"]: r["component"] for r in components(frame(spark, pairs, "a int, b int")).collect()}
    group = {x: {x} for p in pairs if p[0] != p[1] for x in p}
    for a, b in pairs:
        if a != b:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    assert seen == {x: min(g) for x, g in group.items()}


def path_graph(spark):
    return frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")


def test_components_of_labels(spark):
    lab = frame(spark, [("a", 1), ("b", 1), ("c", 0), ("d", 1), ("z", 1)], "node string, y int")
    assert graph.largest_component(path_graph(spark), lab).first()["lcc"] == 2
    assert graph.largest_component(path_graph(spark), lab.where("y = 0")).first()["lcc"] == 0
    assert graph.largest_component(path_graph(spark), lab.where("node = 'z'")).first()["lcc"] == 1


def test_paths(spark):
    lab = frame(spark, [("a", 1), ("b", 0), ("c", 1), ("x", 1)], "node string, y int")
    assert graph.mean_shortest_path(path_graph(spark), lab).first()[0] == 2
    assert graph.mean_shortest_path(path_graph(spark), lab.where("node in ('a', 'x')")).first()[0] == math.inf
    assert graph.mean_shortest_path(path_graph(spark), lab.where("node = 'a'")).first()[0] is None


def test_complete_graph_has_enrichment_one(spark):
    nodes = "abcd"
    e = frame(spark, [(a, b) for a in nodes for b in nodes if a < b], "src string, dst string")
    lab = frame(spark, [(n, int(n in "ab")) for n in nodes], "node string, y int")
    m = graph.metrics(e, lab).first()
    assert m["enrichment"] == pytest.approx(1) and m["lcc"] == 2


def test_neighbour_fraction_of_a_lonely_node(spark):
    lab = frame(spark, [("a", 1), ("b", 0), ("q", 1)], "node string, y int")
    got = {r["node"]: (r["degree_labeled"], r["ad_neighbor_fraction"]) for r in graph.neighbour_fraction(path_graph(spark), lab).collect()}
    assert got == {"a": (1, 0.0), "b": (1, 1.0), "q": (0, None)}


def test_shuffles_keep_counts_by_bin(spark):
    lab = frame(spark, [(str(i), int(i % 3 == 0), i % 4) for i in range(41)] + [("only", 1, 9)], "node string, y int, bin int")
    out = permute.shuffle(lab, 3, 1, "bin").join(lab.select("node", "bin"), "node")
    want = {r["bin"]: r["s"] for r in lab.groupBy("bin").agg(F.sum("y").alias("s")).collect()}
    assert all(want[r["bin"]] == r["s"] for r in out.groupBy("perm_idx", "bin").agg(F.sum("y").alias("s")).collect())
    assert out.where("node = 'only' and y = 1").count() == 3


def test_a_shuffle_broadcasts_no_repeated_table(spark):
    """A table repeated for all permutations keeps the size of its file in the planner's eyes; broadcast, it went through the driver whole."""
    lab = frame(spark, [(str(i), int(i % 3 == 0)) for i in range(20)], "node string, y int")
    plan = permute.shuffle(lab, 50, 1)._jdf.queryExecution().optimizedPlan()
    assert "Generate" not in plan.toString()


def test_p_values(spark):
    d = frame(spark, [(1.0,), (2.0,), (3.0,)], "x double")
    r = d.agg(permute.p_right("x", F.lit(2.0)).alias("r"), permute.p_left("x", F.lit(0.0)).alias("l")).first()
    assert r["r"] == 0.75 and r["l"] == 0.25


def test_greedy_matching_takes_turns(spark):
    rows = [(1, 0, 5.0, 1), (2, 0, 5.0, 1), (3, 0, 5.1, 0), (4, 0, 4.9, 0), (5, 0, 9.0, 0), (6, 1, 1.0, 1)]
    f = frame(spark, rows, "id long, stratum int, value double, is_case int")
    got = sorted((r["case_id"], r["control_id"]) for r in cohort.matched_greedy(f, 2).collect())
    assert got == [(1, 3), (1, 4), (2, 5)]


def test_specificity_of_one_region_is_unknown(spark):
    r = frame(spark, [("g", "a", 1.0, 1.0), ("h", "a", 3.0, 3.0)], "gene string, region string, expr double, global_mean double")
    assert {x["gene"]: x["integrated_score"] for x in cohort.integrated_scores(r).collect()} == pytest.approx({"g": -0.7, "h": 0.7})


def test_crosswalk_keeps_the_first(spark):
    m = frame(spark, [(2, "g1 ", "Q2"), (1, "G1", "p1|p2"), (3, None, "z")], "o int, s string, u string")
    w = frame(spark, [("G1",), ("G9",)], "gene_symbol string")
    assert {r[0]: r[1] for r in cohort.crosswalk(w, m, "s", "u", "o").collect()} == {"G1": "P1", "G9": None}


def test_split_rounds_half_to_even_with_one_at_least(spark):
    lab = frame(spark, [(i, int(i < 25)) for i in range(27)], "node int, y int")
    got = {r["y"]: r["n"] for r in models.split(lab, [7], 0.1).groupBy("y").agg(F.count_if("is_test").alias("n")).collect()}
    assert got == {1: 2, 0: 1}


def reference_logistic(x, y, epochs, rate, l2):
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - rate * (x.T @ e / len(y) + l2 * w), b - rate * e.mean()
    return np.append(w, b)


def test_descent_is_that_of_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 3)), rng.integers(0, 2, 30)
    runs = frame(spark, [("r", i, a.tolist(), int(b), int(b), False) for i, (a, b) in enumerate(zip(x, y))], "run string, id long, x array<double>, y int, fit_y int, is_test boolean")
    got = models.descend(runs, models.Logistic(), 8, 0.3, 0.01)["r"]
    assert got == pytest.approx(reference_logistic(x, y, 8, 0.3, 0.01))


def test_gradient_of_the_hidden_layer():
    rng = np.random.default_rng(0)
    m, x, y = models.FeedForward(4), rng.normal(size=(9, 3)), rng.integers(0, 2, 9)
    w = m.start(3)
    loss = lambda w: float(-(y * np.log(m.predict(w, x)) + (1 - y) * np.log(1 - m.predict(w, x))).sum())
    want = [(loss(w + d) - loss(w - d)) / 2e-5 for d in np.eye(len(w)) * 1e-5]
    assert m.gradient(w, x, y) == pytest.approx(want, abs=1e-4)


def test_oracle_ablation_finds_the_label(spark):
    rng = np.random.default_rng(3)
    v = frame(spark, [(i, rng.normal(size=4).tolist()) for i in range(60)], "id long, v array<double>")
    lab = frame(spark, [(i, i % 2) for i in range(60)], "node long, y int")
    p = models.probe(v, lab, [1], ("validation_oracle",), models.Logistic(), 12, 1.0, 0.0).first()
    assert p["test_auroc"] == pytest.approx(1) and p["test_accuracy"] == 1


def test_baselines_keep_the_number_of_positives(spark):
    lab = frame(spark, [(str(i), int(i < 9)) for i in range(40)], "node string, y int")
    counts = frame(spark, [(str(i), i % 7) for i in range(35)], "node string, annotation_count int")
    for out in (experiment.permuted(lab, 1, 0), experiment.random_set(lab, 1, 0), experiment.bias_matched_set(lab, counts, 1, 0, 4)):
        assert out.agg(F.sum("y")).first()[0] == 9
    assert experiment.stable_hash({"b": 1, "a": 2}) == experiment.stable_hash({"a": 2, "b": 1})


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("g1,1.5,2\ng2,x,3\n")
    got = sorted(map(tuple, tables.read_wide(spark, str(tmp_path / "m.csv"), ["s1", "s2"]).collect()), key=str)
    assert got == [("g1", "s1", 1.5), ("g1", "s2", 2.0), ("g2", "s1", None), ("g2", "s2", 3.0)]
    with pytest.raises(ValueError):
        tables.read_wide(spark, str(tmp_path / "m.csv"), ["s1"])
    with gzip.open(tmp_path / "e.tsv.gz", "wt") as f:
        f.write("a\tb\nx\tNA\n")
    assert tables.read_edges(spark, str(tmp_path / "e.tsv.gz")).collect() == [("x", None)]
    (tmp_path / "e.csv").write_text("a;b\nx;y\n")
    assert tables.read_edges(spark, str(tmp_path / "e.csv")).collect() == [("x", "y")]
    (tmp_path / "l.csv").write_text("gene_symbol,y,more\nA,1,z\nnull,0,z\n")
    assert tables.read_text_table(spark, str(tmp_path / "l.csv"), "y int, gene_symbol string").collect() == [(1, "A"), (0, None)]
    with pytest.raises(ValueError):
        tables.read_text_table(spark, str(tmp_path / "l.csv"), "label string")
    np.save(tmp_path / "v.npy", np.arange(10, dtype=np.float32).reshape(5, 2))
    rows = tables.read_vectors(spark, str(tmp_path / "v.npy"), list("abcde"), rows=2).orderBy("row_idx").collect()
    assert [(r["name"], r["v"]) for r in rows][-1] == ("e", [8.0, 9.0])
    with pytest.raises(ValueError):
        tables.read_vectors(spark, str(tmp_path / "v.npy"), ["a"])


def test_writers_and_configuration(spark, tmp_path):
    d = frame(spark, [(float("nan"), "a")], "x double, s string")
    tables.write_json(d, str(tmp_path / "j"))
    assert [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()] == [{"s": "a"}]
    tables.write_csv(d, str(tmp_path / "c"))
    assert tables.read_text_table(spark, str(tmp_path / "c"), "s string").collect() == [("a",)]
    (tmp_path / "c.json").write_text(json.dumps({"cohorts": ["a"], "ablations": ["b"], "baselines": ["c"], "seeds": []}))
    with pytest.raises(ValueError):
        tables.read_config(str(tmp_path / "c.json"))
    assert tables.parse_ints("5,1,1") == [1, 5] and tables.missing_inputs([str(tmp_path / "no")])
    with pytest.raises(ValueError):
        tables.parse_ints("")


def test_gene_vectors_and_node_labels(spark):
    genes = frame(spark, [(" a", "AD", 1, 1), ("A ", "control", 0, 2), ("b", None, 0, 3), ("c", "AD", 1, 4)], "gene_symbol string, label string, y int, pos int")
    mapping = frame(spark, [("A", "p2", 1), ("a", "p1", 2), ("B", "p1", 3), ("b", "", 4), ("c", None, 5)], "gene_symbol string, uniprot_accession string, pos int")
    named = frame(spark, [("AF-P1-F1", [1.0, 3.0]), ("AF-P2-F1", [3.0, 5.0]), ("AF-P2-F1", [5.0, 7.0]), ("other", [9.0, 9.0])], "name string, v array<double>")
    got = {r["gene_symbol"]: tuple(r)[1:] for r in cohort.gene_vectors(genes, mapping, named).collect()}
    assert got == {"A": ("AD", 1, "P2", [3.0, 5.0]), "B": (None, 0, "P1", [1.0, 3.0])}
    with pytest.raises(ValueError):
        cohort.gene_vectors(genes, mapping, named.where("name = 'other'"))
    assert {tuple(r) for r in cohort.node_labels(genes).collect()} == {("A", 1, "A"), ("B", 0, "B"), ("C", 1, "C")}
    assert {tuple(r) for r in cohort.node_labels(genes, mapping).collect()} == {("A", 1, "P2"), ("A", 1, "P1")}


def test_schema_and_counts(spark):
    d = frame(spark, [("1", "a", "7"), ("x", "A", "3"), (None, "b", "nan"), ("2.0", "c", None)], "y string, gene_symbol string, annotation_count string").withColumn("gene_id", F.lit(1)).withColumn("pos", F.col("annotation_count"))
    assert [r["y"] for r in cohort.label_schema(d).collect()] == [1, None, None, 2] and "gene_id" not in cohort.label_schema(d).columns
    assert [tuple(r) for r in cohort.annotation_counts(d, "pos").collect()] == [("A", 3.0)]


def test_paths_of_several_label_sets(spark):
    """For each set as by itself; none with one positive, infinite where none is reached; a guard against graphs without the labelled nodes."""
    edges = frame(spark, [("A", "B"), ("B", "C"), ("C", "D"), ("E", "F")], "src string, dst string")
    sets = {0: "AD", 1: "ABC", 2: "A", 3: "AE"}
    rows = [(p, n, int(n in own)) for p, own in sets.items() for n in "ABCDEF"]
    got = {r[0]: r[1] for r in graph.shortest_paths_by(edges, frame(spark, rows, "perm_idx int, node string, y int"), ["perm_idx"]).collect()}
    assert got == {0: 3.0, 1: pytest.approx(4 / 3), 2: None, 3: float("inf")}
    lab = frame(spark, [("A", 1), ("X", 0)], "node string, y int")
    assert graph.within_graph(lab, edges, 1).collect() == [("A", 1)]
    with pytest.raises(ValueError):
        graph.within_graph(lab, edges, 2)


def test_baseline_without_counts_falls_back(spark):
    lab = frame(spark, [(str(k), int(k < 3)) for k in range(9)], "node string, y int")
    a, b = (experiment.baseline_labels(lab, n, 1, 2).orderBy("node").collect() for n in ("random_matched_set", "random_matched_set_plus_bias"))
    assert [r[:3] for r in a] == [r[:3] for r in b] and sum(r["y"] for r in b) == 3
    assert {r["fallback_used"] for r in a} == {False} and {r["fallback_used"] for r in b} == {True}
    with pytest.raises(ValueError):
        experiment.baseline_labels(lab, "other", 1, 2)


def test_loss_history_goes_on_from_its_weights(spark):
    rng = np.random.default_rng(0)
    rows = [("r", k, rng.normal(size=3).tolist(), k % 2, k % 2, k % 5 == 0) for k in range(40)]
    runs = frame(spark, rows, "run string, id long, x array<double>, y int, fit_y int, is_test boolean")
    last = models.loss_history(runs, models.Logistic(), 6, 2, 0.5, 1e-3).collect()[-1]
    once = models.loss_history(runs, models.Logistic(), 6, 6, 0.5, 1e-3).collect()[-1]
    assert tuple(last) == pytest.approx(tuple(once))


def test_distances_are_exact(spark):
    """Mean, median and bins of all pairs against numpy; three blocks, equal rows, and fine bins few enough to need several passes."""
    rng = np.random.default_rng(8)
    m = np.vstack([rng.normal(size=(30, 3)), np.ones((6, 3)), np.zeros((2, 3))])
    y = rng.integers(0, 2, len(m))
    v = frame(spark, [(f"g{i:02d}", r.tolist(), int(k)) for i, (r, k) in enumerate(zip(m, y))], "id string, v array<double>, y int")
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    i, j = np.triu_indices(len(m), 1)
    d, kind = (1 - u @ u.T)[i, j], y[i] + y[j]
    pairs = vectors.distance_counts(v, block=15)
    got = {r["pair_type"]: r for r in vectors.distance_summary(pairs).collect()}
    bins = {(r["pair_type"], r["bin"]): (r["n"], r["density"]) for r in vectors.histogram(pairs, 7).collect()}
    for k, name in enumerate(vectors.KINDS):
        x = d[kind == k]
        assert got[name]["n_pairs"] == len(x)
        assert (got[name]["mean_cosine_distance"], got[name]["median_cosine_distance"]) == pytest.approx((x.mean(), np.median(x)), abs=1e-12)
        n, density = np.histogram(x, 7)[0], np.histogram(x, 7, density=True)[0]
        assert {b: bins[name, b][0] for b in range(7) if (name, b) in bins} == {b: c for b, c in enumerate(n) if c}
        assert all(bins[name, b][1] == pytest.approx(density[b]) for b, c in enumerate(n) if c)


def test_order_statistics_by_few_bins(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FINE", 3)
    v = frame(spark, [(i, [1.0, float(i)], 0) for i in range(9)], "id long, v array<double>, y int")
    m = np.array([[1.0, i] for i in range(9)])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.triu_indices(9, 1)
    d = np.sort((1 - u @ u.T)[i, j])
    got = vectors.Distances(v, 4).at_ranks([(0, r) for r in (0, 17, 35)])
    assert [got[0, r] for r in (0, 17, 35)] == pytest.approx([d[0], d[17], d[35]], abs=1e-15)


def test_nearest_of_text_ids(spark):
    v = frame(spark, [("BRCA1", [1.0, 0.0]), ("APP", [1.0, 0.1]), ("APOE", [0.0, 1.0])], "id string, v array<double>")
    assert [(r["neighbour"], r["rank"]) for r in vectors.nearest(v, 2, block=2).where("id = 'BRCA1'").orderBy("rank").collect()] == [("APP", 1), ("APOE", 2)]


def test_adjusted_p_values_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2] if i % 7 else None, float(rng.choice([rng.random(), 0.01, 0.5]))) for i in range(120)] + [(200, "a", None), (201, "b", float("nan")), (202, "c", 1.0)]
    got = {r["id"]: (r["rank"], r["n_tests"], r["q"]) for r in ordered.fdr(frame(spark, rows, "id int, fam string, p double"), "p", "id", ["fam"]).collect()}
    want = {200: (None, None, None), 201: (None, None, None)}
    for fam in ("a", "b", "c", None):
        own = sorted((p, i) for i, f, p in rows if f == fam and p is not None and p == p)
        least = 1.0
        for k in range(len(own), 0, -1):
            least = min(least, own[k - 1][0] * len(own) / k)
            want[own[k - 1][1]] = (k, len(own), pytest.approx(least))
    assert got == want
    assert ordered.fdr(frame(spark, [(i, p) for i, _, p in rows[:9]], "id int, p double"), "p", "id").count() == 9


def test_running_aggregates_within_keys(spark):
    rows = [(k, i, float((i * 7) % 11)) for k in ("a", None, "b") for i in range(40)]
    got = ordered.running(frame(spark, rows, "k string, i int, x double"), [F.col("i")], {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))}, ["k"])
    for r in got.collect():
        own = [float((i * 7) % 11) for i in range(r["i"] + 1)]
        assert (r["s"], r["lo"], r["hi"]) == (sum(own), min(own), max(own))


def test_spanning_forest_and_sweep(spark):
    """Weight of the forest against Kruskal's, and components at every threshold against a search; equal scores, repeated edges, loops."""
    rng = np.random.default_rng(3)
    rows = [(f"n{a}", f"n{b}", int(s)) for a, b, s in zip(rng.integers(0, 30, 70), rng.integers(0, 30, 70), rng.integers(1, 5, 70))] + [("n1", "n1", 9), ("n2", None, 3), ("x", "y", 2)]
    edges = frame(spark, rows, "src string, dst string, score int")
    root = {n: n for r in rows for n in r[:2] if n}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    want = []
    for a, b, s in sorted((r for r in rows if r[1] and r[0] != r[1]), key=lambda r: -r[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append(s)
    forest = graph.spanning_forest(edges).collect()
    assert sorted(r["score"] for r in forest) == sorted(want)
    labels = frame(spark, [(f"n{i}", int(i % 5 > 0)) for i in range(30)], "node string, y int")
    got = {r["threshold"]: (r["n_components"], r["lcc"]) for r in graph.threshold_sweep(edges, labels, [1, 2, 3, 4, 9]).collect()}
    for t in (1, 2, 3, 4, 9):
        kept = edges.where(F.col("score") >= t).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        assert got[t][1] == graph.largest_component(kept, labels).first()["lcc"]
    assert got[9] == (24, 1)
    none = graph.threshold_sweep(edges.where("score > 99"), labels.where("y = 0"), [1]).first()
    assert (none["n_components"], none["lcc"]) == (0, 0)


def test_nearest_is_that_of_a_plain_search(spark, monkeypatch):
    """Ties across blocks and at the k-th place, a few cells at a time."""
    monkeypatch.setattr(vectors, "CELLS", 40)
    rng = np.random.default_rng(5)
    m = np.vstack([rng.integers(-1, 2, (50, 3)), rng.normal(size=(20, 3))]).astype(float)
    v = frame(spark, [(i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>")
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sims = np.round(u @ u.T, 9)
    want = {(i, j, r) for i in range(70) for r, j in enumerate(sorted((j for j in range(70) if j != i), key=lambda j: (-sims[i, j], j))[:4], 1)}
    for block in (None, 9):
        assert {(r["id"], r["neighbour"], r["rank"]) for r in vectors.nearest(v, 4, block).collect()} == want


def test_medians_of_many_pairs_are_listed_after_bins(spark, monkeypatch):
    """A guess from some rows, a wrong one, and none: the order statistics are those of numpy, and a class takes two passes where the guess holds."""
    monkeypatch.setattr(vectors, "LISTED", 40)
    rng = np.random.default_rng(4)
    m, y = np.vstack([rng.normal(size=(150, 4)), np.ones((20, 4))]), rng.integers(0, 2, 170)
    v = frame(spark, [(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(m, y))], "id long, v array<double>, y int")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.triu_indices(len(m), 1)
    d, kind = (1 - u @ u.T)[i, j], y[i] + y[j]
    passes = []
    monkeypatch.setattr(vectors.Distances, "_pass", lambda self, *a, own=vectors.Distances._pass: passes.append(a) or own(self, *a))
    for guess in (None, {0: (0.0, 1e-9), 1: (1.9, 2.0)}, {}):
        if guess is not None:
            monkeypatch.setattr(vectors.Distances, "_guess", staticmethod(lambda v, guess=guess: guess))
        passes.clear()
        got = [r["median_cosine_distance"] for r in vectors.distance_summary(vectors.distance_counts(v, block=60)).collect()]
        assert got == pytest.approx([np.median(d[kind == k]) for k in range(3)], abs=1e-12)
        assert len(passes) == (2 if guess is None else 3)


def test_a_block_of_vectors_is_read_without_an_object_a_row(spark):
    """Vectors stay in Arrow's memory: no list of arrays or numbers is made of a block; nulls and ragged rows are refused."""
    column = pa.chunked_array([[[3.0, 4.0]], [[0.0, 0.0]]])
    assert vectors._unit(column).tolist() == [[0.6, 0.8], [0.0, 0.0]]
    for bad in ([[1.0], [1.0, 2.0]], [[1.0], None]):
        with pytest.raises(ValueError):
            vectors._unit(pa.chunked_array([bad]))
