"""The store of artefacts, greedy coverage, and small readers and expressions."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import cohort, coverage, experiment, graph, vectors
from graphloom.sources import tables
from graphloom.sources.store import Store, cohort_tables, kept_split, run_manifests

from .test_operators import frame


def test_an_artefact_is_made_once_for_its_keys(spark, tmp_path):
    store, calls = Store(spark, f"{tmp_path}/s"), []

    def make():
        calls.append(1)
        return frame(spark, [(len(calls),)], "x int")

    keys = {"cohort": "a/b c", "seed": 1}
    assert not store.has("t", keys) and store.manifest().count() == 0
    assert store.get("t", keys, make).first()["x"] == 1 and store.has("t", keys)
    assert store.get("t", dict(reversed(keys.items())), make).first()["x"] == 1  # the order of keys is of no account
    assert store.get("t", {**keys, "seed": 2}, make).first()["x"] == 2
    assert Store(spark, f"{tmp_path}/s").get("t", keys, make).first()["x"] == 1
    assert len(calls) == 2 == store.made
    notes = {json.loads(r["keys"])["seed"]: r for r in store.manifest().collect()}
    assert notes.keys() == {1, 2} and notes[1]["artefact"] == experiment.stable_hash({"name": "t", "keys": keys}) and notes[1]["n_rows"] == 1


def test_a_split_is_kept_for_its_seed_and_share(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    lab = frame(spark, [(f"n{i}", i % 2) for i in range(40)], "node string, y int")
    first = {tuple(r) for r in kept_split(store, "c", lab, [1, 2]).collect()}
    assert store.made == 2 and len(first) == 80
    fewer = lab.where("node < 'n3'").union(frame(spark, [("new", 1)], "node string, y int"))
    again = {tuple(r) for r in kept_split(store, "c", fewer, [1, 2]).collect()}
    assert store.made == 2 and again == {r for r in first if r[1] < "n3"}
    share = kept_split(store, "c", lab, [1], 0.5)
    assert store.made == 3 and share.where("is_test").count() == 20
    kept_split(store, "d", lab, [1])
    assert store.made == 4


def test_tables_of_a_cohort(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    regions = frame(spark, [(g, "a", float(i), float(i)) for i, g in enumerate(["g0", "G1", "g2", "g3"])], "gene string, region string, expr double, global_mean double")
    cases = frame(spark, [("G1",)], "gene string")
    mapping = frame(spark, [("g1", "P1;P2", 0), ("g2", None, 1)], "symbol string, accessions string, pos int")
    settings = {"name": "c", "controls_per_ad": 1, "min_global_expression": 1.0}
    got = cohort_tables(store, settings, regions, cases, mapping)
    assert {(r["gene_symbol"], r["y"]) for r in got["labels"].collect()} == {("G1", 1), ("G2", 0)}
    assert {tuple(r) for r in got["mapping"].collect()} == {("G1", "P1"), ("G2", None)}
    assert got["annotation_counts"].count() == 0 and store.made == 3
    cohort_tables(store, settings, regions.limit(0), cases, mapping)
    assert store.made == 3
    cohort_tables(store, {**settings, "controls_per_ad": 2}, regions, cases, mapping)
    assert store.made == 6


def test_manifests_tell_inputs_apart(spark):
    entries = frame(spark, [("r1", "a", 1), ("r2", "b", 2)], "run_id string, ablation string, seed int")
    files = lambda folder, sha: frame(spark, [(f"{folder}/x.csv", sha), (f"{folder}/a.csv", "0")], "path string, sha256 string")
    one, moved, other = ({r["run_id"]: r for r in run_manifests(entries, {"epochs": 2}, files(*f)).collect()} for f in (("p", "1"), ("q", "1"), ("p", "2")))
    assert json.loads(one["r1"]["entry"]) == {"ablation": "a", "seed": 1} and json.loads(one["r2"]["settings"]) == {"epochs": 2}
    assert one["r1"]["inputs"] == one["r2"]["inputs"] == moved["r1"]["inputs"] != other["r1"]["inputs"]


def test_signatures_are_those_of_json(spark):
    rows = [("a\"b", 1, 0.5, None, True), ("", -3, 2.0, "x\\y", False)]
    got = experiment.signature_id(frame(spark, rows, "b string, a int, d double, n string, t boolean"))
    for r in got.collect():
        own = r.asDict()
        assert own.pop("run_id") == experiment.stable_hash(own)


# --- coverage


def plain_greedy(pairs, most):
    left, out, covered = {}, [], 0
    for c, i in pairs:
        left.setdefault(c, set()).add(i)
    while len(out) < most and any(left.values()):
        c = min(left, key=lambda c: (-len(left[c]), c))
        items = set(left[c])
        covered += len(items)
        out.append((len(out) + 1, c, len(items), covered))
        left = {k: v - items for k, v in left.items()}
    return out


def test_coverage_is_plain_greedy(spark):
    rng = random.Random(2)
    for most in (3, 50):
        pairs = [(f"c{rng.randrange(14)}", int(rng.triangular(0, 60, 0))) for _ in range(150)]
        got = coverage.coverage(frame(spark, [*pairs, (None, 1), ("z", None)], "candidate string, item int"), most)
        assert sorted(map(tuple, got.collect())) == plain_greedy(pairs, most)


def test_coverage_with_a_loss_stays_within_it(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(120)) for _ in range(500)]
    got = sorted(map(tuple, coverage.coverage(frame(spark, pairs, "candidate int, item int"), 12, 0.3).collect()))
    left = {}
    for c, i in pairs:
        left.setdefault(c, set()).add(i)
    assert len(got) == 12
    for k, (rank, c, gain, covered) in enumerate(got, 1):
        best = max(map(len, left.values()))
        items = set(left[c])
        assert rank == k and len(items) == gain >= 0.7 * best
        left = {k: v - items for k, v in left.items()}
    assert got[-1][3] == sum(g for _, _, g, _ in got) >= 0.7 * plain_greedy(pairs, 12)[-1][3]
    assert coverage.coverage(frame(spark, [], "candidate int, item int"), 3).count() == 0


# --- small things


def test_wide_matrix_with_quotes_and_a_short_row(spark, tmp_path):
    (tmp_path / "m.csv").write_text('"g,1",1.5,"2"\n g2 ,"x ""y""",\n')
    got = {tuple(r) for r in tables.read_wide(spark, str(tmp_path / "m.csv"), ["s1", "s2"]).collect()}
    assert got == {("g,1", "s1", 1.5), ("g,1", "s2", 2.0), ("g2", "s1", None), ("g2", "s2", None)}
    for bad in ("g2,1\n", "g2,1,2,3\n"):
        (tmp_path / "bad.csv").write_text("g1,1,2\n" + bad)
        with pytest.raises(Exception, match="(?i)malformed"):
            tables.read_wide(spark, str(tmp_path / "bad.csv"), ["s1", "s2"]).collect()


def test_paths_and_snapshots(spark, tmp_path):
    (tmp_path / "b.txt").write_text("x")
    assert tables.first_existing([f"{tmp_path}/a.txt", f"file://{tmp_path}/b.txt"]) == f"file://{tmp_path}/b.txt"
    with pytest.raises(FileNotFoundError):
        tables.first_existing([f"{tmp_path}/a.txt"])
    assert tables.missing_inputs([f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"]) == [f"{tmp_path}/a.txt"]
    cfg = {"cohorts": [1], "ablations": ["b"], "baselines": ["c"], "seeds": [4], "analysis": {"epochs": 200}}
    tables.snapshot_config(spark, cfg, f"{tmp_path}/c/config.json")
    assert tables.read_config(f"{tmp_path}/c/config.json") == cfg
    with gzip.open(tmp_path / "e.tsv.gz", "wt") as f:
        f.write("a\tb\n" + "x\ty\n" * 9)
    e = tables.read_edges(spark, str(tmp_path / "e.tsv.gz"))
    assert e.count() == 9 and e.rdd.getNumPartitions() > 1


def test_guards_and_parts(spark):
    with pytest.raises(ValueError):
        cohort.region_expression(frame(spark, [("g", None, 1.0)], "gene string, region string, tpm double"))
    d = frame(spark, [("x/y/a.tar.gz",), ("b",), (".c",), ("d/",), (None,)], "p string")
    assert [tuple(r) for r in d.select(text.file_name(F.col("p")), text.file_stem(F.col("p"))).collect()] == [("a.tar.gz", "a.tar"), ("b", "b"), (".c", ".c"), ("", ""), (None, None)]
    assert [r["g"] for r in cohort.gene_set(frame(spark, [(" a",), ("A",), ("",), (None,)], "s string"), "s").selectExpr("gene_symbol AS g").collect()] == ["A"]
    lab = frame(spark, [("b", 1), ("a", 1), ("c", 0)], "node string, y int")
    assert {tuple(r) for r in graph.nodes_by_class(lab).select("y", "rank", "node").collect()} == {(1, 1, "a"), (1, 2, "b"), (0, 1, "c")}


def test_purity_for_several_numbers_of_neighbours(spark):
    nn = frame(spark, [(1, 2, 1), (1, 3, 2), (2, 1, 1)], "id int, neighbour int, rank int")
    lab = frame(spark, [(1, 1), (2, 1), (3, 0)], "id int, y int")
    got = {(r["k"], r["id"]): (r["knn_purity"], r["knn_entropy"]) for r in vectors.purity_sweep(nn, lab, [1, 2]).collect()}
    assert got == {(1, 1): (1, 0), (1, 2): (1, 0), (2, 1): (0.5, 1), (2, 2): (1, 0)}


def test_network_term_of_the_score(spark):
    r = frame(spark, [("g", "a", 1.0, 1.0), ("h", "a", 3.0, 3.0), ("i", "a", 2.0, 2.0)], "gene string, region string, expr double, global_mean double")
    net = frame(spark, [("g", 1.0), ("h", 3.0), ("other", 99.0), ("i", None)], "gene string, value double")
    z = 1.5**0.5
    got = {x["gene"]: x["integrated_score"] for x in cohort.integrated_scores(r, net).collect()}
    assert got == pytest.approx({"g": -0.4 * z - 0.3, "h": 0.4 * z + 0.3, "i": 0})


def test_large_files_are_hashed_in_splits(spark, tmp_path, monkeypatch):
    """A file's hash is that of its content whatever the splits; a swap of two lines changes it; a small file's is the plain one."""
    lines = [bytes([i % 256, 255, 13]) * (i % 7) for i in range(300)]
    (tmp_path / "a.bin").write_bytes(b"\n".join(lines))
    (tmp_path / "b.bin").write_bytes(b"\n".join([lines[2], *lines[1:2], lines[0], *lines[3:]]))
    paths = [str(tmp_path / n) for n in ("a.bin", "b.bin")]
    found = lambda: {r["path"].rsplit("/", 1)[-1]: (r["size"], r["sha256"]) for r in experiment.content_hashes(spark, paths).collect()}
    plain = found()
    assert plain["a.bin"][1] == hashlib.sha256((tmp_path / "a.bin").read_bytes()).hexdigest()
    monkeypatch.setattr(experiment, "WHOLE", 100)
    monkeypatch.setattr(experiment, "LINES", 16)
    once = found()
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert found() == once
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert once["a.bin"][0] == plain["a.bin"][0] and once["a.bin"][1] not in (once["b.bin"][1], plain["a.bin"][1])
