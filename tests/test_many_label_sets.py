"""Many label sets at once and greedy matching, against doing them one by one."""

import random

import numpy as np
import pytest


from graphloom.operators import bits, cohort, graph, groups, matching, neighbourhoods, permute, pieces

from .test_operators import frame


def random_graph(rng, n, edges):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(edges)}
    return sorted((f"n{a:03d}", f"n{b:03d}") for a, b in pairs)


def plain_paths(pairs, allowed):
    near = {}
    for a, b in pairs:
        if a in allowed and b in allowed:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for s in allowed:
        front, hop = {s}, 0
        seen = {s}
        while front:
            for t in front:
                out[s, t] = hop
            front, hop = {v for u in front for v in near.get(u, ())} - seen, hop + 1
            seen |= front
    return out


@pytest.fixture(scope="module")
def case(spark):
    """A graph of 60 nodes, of which 50 are labelled by 70 sets: two words, some sets empty, of one node, or of all."""
    rng = random.Random(4)
    pairs = random_graph(rng, 60, 75)
    nodes = [f"n{i:03d}" for i in range(50)]
    share = [0, 1, *[rng.random() for _ in range(67)]]
    sets = [{n for n in nodes if rng.random() < p} for p in share] + [{"n003"}]
    rows = [(i, n, int(n in own)) for i, own in enumerate(sets) for n in nodes]
    labels = frame(spark, rows, "idx int, node string, y int")
    edges = frame(spark, pairs, "src string, dst string")
    packed = bits.for_all(frame(spark, [(n,) for n in nodes], "node string"), bits.pack(labels.where("y = 1"), len(sets)), len(sets))
    return pairs, nodes, sets, labels, edges, packed


def test_bits_of_several_words(case):
    _, nodes, sets, _, _, packed = case
    got = {r["node"]: r["bits"] for r in packed.collect()}
    assert all(len(x) == 2 for x in got.values())
    assert {n: [int(n in s) for s in sets] for n in nodes} == {n: [x[i // 64] >> i % 64 & 1 for i in range(len(sets))] for n, x in got.items()}


def test_metrics_of_many_sets_are_those_of_each(case):
    _, _, sets, labels, edges, packed = case
    names = ["n", "n_ad", "n_control", *graph.CLASSES, "labelled_edges", "expected", "observed", "enrichment", "mean_ad_neighbor_fraction", "lcc"]
    got = {r["idx"]: [r[c] for c in names] for r in bits.metrics(edges, packed, len(sets)).collect()}
    want = {r["idx"]: [r[c] for c in names] for r in graph.metrics(edges, labels, ["idx"]).collect()}
    assert got.keys() == want.keys() == set(range(len(sets)))
    for i in got:
        assert got[i] == pytest.approx(want[i], abs=1e-12)


@pytest.mark.parametrize("sources", [64, 1024])
def test_paths_of_many_sets_are_those_of_a_plain_search(case, monkeypatch, sources):
    monkeypatch.setattr(bits, "SOURCES", sources)
    monkeypatch.setattr(bits, "NODES", 20)
    pairs, nodes, sets, _, edges, packed = case
    far = plain_paths(pairs, set(nodes))
    got = {r["idx"]: r["mean_shortest_path"] for r in bits.mean_paths(edges, packed, len(sets)).collect()}
    for i, own in enumerate(sets):
        between = [d for (s, t), d in far.items() if s < t and s in own and t in own]
        assert got[i] == (None if len(own) < 2 else pytest.approx(np.mean(between)) if between else np.inf)


def test_no_edges_and_no_nodes(spark):
    edges = frame(spark, [], "src string, dst string")
    one = frame(spark, [("a", [1]), ("b", [3])], "node string, bits array<long>")
    assert {r["idx"]: (r["enrichment"], r["mean_ad_neighbor_fraction"], r["lcc"], r["mean_ad_shortest_path"]) for r in bits.metrics(edges, one, 2, paths=True).collect()} == {0: (0, None, 1, np.inf), 1: (0, None, 1, None)}
    assert bits.metrics(edges, one.where("node = 'c'"), 2).count() == 0


def test_bits_of_permutations_are_the_permutations(spark):
    lab = frame(spark, [(f"n{i}", int(i % 3 == 0), i % 4) for i in range(41)], "node string, y int, bin int")
    got = {r["node"]: r["bits"] for r in bits.shuffled(lab, 70, 5, "bin").collect()}
    want = {(r["perm_idx"], r["node"]): r["y"] for r in permute.shuffle(lab, 70, 5, "bin").collect()}
    assert {(p, n): x[p // 64] >> p % 64 & 1 for n, x in got.items() for p in range(70)} == want


def test_hop_deltas_skip_sets_with_an_empty_side(spark):
    rows = frame(spark, [("a", 1, 0.5), ("b", 1, 0.25), ("c", 1, 1.0), ("a", 2, 1.0)], "seed string, k int, rate double")
    lab = frame(spark, [("a", [0b001]), ("b", [0b001]), ("c", [0b100])], "node string, bits array<long>")
    got = {(r["k"], r["idx"]): r["delta_rate"] for r in bits.hop_deltas(rows, lab, 3, ["rate"]).collect()}
    assert got == {(1, 0): 0.375 - 1.0, (1, 2): 1.0 - 0.375}


# --- matching


def taking_turns(rows, k, again=False):
    taken, out = set(), []
    for i, s, v, c in sorted(r for r in rows if r[3] == 1 and r[2] is not None and r[2] == r[2]):
        pool = sorted((abs(x[2] - v), x[0]) for x in rows if x[3] == 0 and x[1] == s and x[2] is not None and x[2] == x[2] and (again or x[0] not in taken))[:k]
        taken |= {b for _, b in pool}
        out += [(i, b, n + 1) for n, (_, b) in enumerate(pool)]
    return sorted(out)


@pytest.mark.parametrize("cell, share, strata, text", [(5, 0.1, 1, False), (4, 0.4, 2, True), (20_000, 0.3, 2, True)])
def test_matching_is_taking_turns(spark, monkeypatch, cell, share, strata, text):
    """Ties in value and distance, missing values, cells of a few controls, more cases than controls, ids of text."""
    monkeypatch.setattr(matching, "CELL", cell)
    rng = random.Random(cell)
    value = lambda: rng.choice([None, float("nan"), float(rng.randint(0, 30)), float(rng.randint(0, 30)), rng.random() * 30])
    rows = [(f"g{j}" if text else j, rng.randrange(strata), value(), int(rng.random() < share)) for j in rng.sample(range(10**4), 200)]
    f = frame(spark, rows, f"id {'string' if text else 'long'}, stratum int, value double, is_case int")
    for again in (False, True):
        assert sorted(map(tuple, matching.matched(f, 2, "stratum", again).collect())) == taking_turns(rows, 2, again)


def test_matching_with_too_few_controls(spark):
    f = frame(spark, [("a", 1.0, 1), ("b", 1.0, 1), ("c", 5.0, 0)], "id string, value double, is_case int")
    assert [tuple(r) for r in cohort.matched_greedy(f, 2, None).collect()] == [("a", "c", 1)]
    assert cohort.matched_greedy(f.where("is_case = 1"), 2, None).count() == 0
    assert cohort.matched_greedy(f.where("is_case = 0"), 2, None).count() == 0


def test_label_table_without_cases_is_an_error(spark):
    r = frame(spark, [("g", "a", 1.0, 1.0)], "gene string, region string, expr double, global_mean double")
    with pytest.raises(ValueError):
        cohort.label_table(r, frame(spark, [("h",)], "gene string"), 1, 0.0)


# --- neighbourhoods


@pytest.mark.parametrize("hub_rows", [1000, 3])
def test_two_steps_with_and_without_hubs(spark, monkeypatch, hub_rows):
    monkeypatch.setattr(neighbourhoods, "HUB_ROWS", hub_rows)
    rng = random.Random(6)
    own = {i: rng.sample([j for j in range(30) if j != i and (j < 4 or rng.random() < 0.3)], 3) for i in range(30)}
    sim = {(i, j): rng.choice([0.25, 0.5, 1.0]) for i in own for j in own[i]}
    d = frame(spark, [(f"n{i:02d}", f"n{j:02d}", s) for (i, j), s in sim.items()], "id string, neighbour string, sim double")
    want = set()
    for i in own:
        far = {}
        for m in own[i]:
            for j in own[m]:
                if j != i and j not in own[i]:
                    far.setdefault(j, []).append(sim[i, m] * sim[m, j])
        best = sorted((-len(x), -max(x), j) for j, x in far.items())[:4]
        want |= {(f"n{i:02d}", f"n{j:02d}", -n, -x, r) for r, (n, x, j) in enumerate(best, 1)}
    assert {tuple(r) for r in neighbourhoods.two_hop(d, 4).select("id", "node", "paths", "best", "rank").collect()} == want


def test_samples_match_degrees_and_leave_the_node_out(spark, case):
    _, nodes, sets, labels, edges, _ = case
    lab = labels.where("idx = 20").select("node", "y")
    bins = graph.degree_bins(lab, edges, 3).select("node", "bin")
    bin_of = {r["node"]: r["bin"] for r in bins.collect()}
    ad = {n for n in sets[20]}
    near = {}
    for r in graph.adjacency(edges).collect():
        if r["u"] in ad and r["v"] in bin_of:
            near.setdefault(r["u"], []).append(bin_of[r["v"]])
    got = {}
    for r in neighbourhoods.matched_samples(edges, lab, bins, 6, 1).collect():
        got.setdefault((r["node"], r["draw"]), []).append(r["other"])
    assert got.keys() == {(u, d) for u in near for d in range(6)}
    for (u, _), others in got.items():
        assert u not in others and len(set(others)) == len(others)
        assert sorted(bin_of[o] for o in others) == sorted(near[u])
    assert len({tuple(sorted(x)) for (u, _), x in got.items() if u == max(near, key=lambda n: len(near[n]))}) > 1


def test_label_table_with_gene_ids(spark):
    r = frame(spark, [(g, "a", x, x) for g, x in (("g", 2.0), ("h", 2.5), ("i", 9.0), ("j", 0.5))], "gene string, region string, expr double, global_mean double")
    ids = frame(spark, [("g", 7), ("g", 5), ("i", 3)], "gene string, gene_id long")
    got = cohort.label_table(r, frame(spark, [("g",), ("j",)], "gene string"), 1, 1.0, ids)
    assert [tuple(x)[:4] for x in got.orderBy("gene").collect()] == [(5, "g", "AD", 1), (None, "h", "control", 0)]


@pytest.mark.parametrize("most", [0, 3, pieces.MOST_EDGES])
def test_pieces_of_any_size_give_the_same_paths(spark, monkeypatch, most):
    """Held by tasks, left to joins, or both; sources stay in their pieces, in blocks of fewer sources than a piece has."""
    monkeypatch.setattr(pieces, "MOST_EDGES", most)
    monkeypatch.setattr(pieces, "LISTED", 4)
    pairs = random_graph(random.Random(7), 40, 26)
    nodes = [f"n{i:03d}" for i in range(36)]
    edges, allowed = frame(spark, pairs, "src string, dst string"), frame(spark, [(n,) for n in nodes], "node string")
    plain = plain_paths(pairs, set(nodes))
    got = graph.bfs(edges, allowed.where("node < 'n020' or node = 'n039'"), allowed).collect()
    assert len(got) == len({(r["source"], r["node"]) for r in got})
    assert {(r["source"], r["node"]): r["dist"] for r in got} == {k: d for k, d in plain.items() if k[0] < "n020"}
    labels = frame(spark, [(n, int(i % 3 > 0)) for i, n in enumerate(nodes)], "node string, y int")
    want = [d for (s, t), d in plain.items() if s < t and nodes.index(s) % 3 and nodes.index(t) % 3]
    assert graph.mean_shortest_path(edges, labels).first()[0] == pytest.approx(np.mean(want), abs=1e-12)
    inside = bits.ends(edges, bits.of_labels(labels))
    assert bits.largest_components(inside).first()["lcc"] == graph.largest_component(edges, labels).first()["lcc"]


def test_a_search_joins_no_frontier(spark, monkeypatch):
    """All sources of all pieces advanced by joins, a written table and an anti join with all found so far at each hop."""
    monkeypatch.setattr(graph, "_open_bfs", None)
    edges = frame(spark, [("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    allowed = frame(spark, [(n,) for n in "abcxyz"], "node string")
    got = sorted(tuple(r) for r in graph.bfs(edges, allowed.where("node in ('a', 'z')"), allowed).collect())
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("z", "z", 0)]


@pytest.mark.parametrize("n, m, hub, seed", [(300, 900, 1024, 1), (300, 320, 5, 2), (130, 200, 3, 3), (2, 1, 1024, 4)])
def test_bits_of_distances_are_those_of_a_plain_search(monkeypatch, n, m, hub, seed):
    """Nodes whose neighbours are taken rank by rank, and hubs by themselves; distances of several bits, nodes out of reach."""
    monkeypatch.setattr(pieces, "HUB", hub)
    monkeypatch.setattr(pieces, "CACHED", 1 << 12)
    rng = random.Random(seed)
    ends = [rng.sample(range(n), 2) for _ in range(m)]
    at = sorted(rng.sample(range(n), max(1, n // 2)))
    plain = plain_paths(ends, set(range(n)))
    a, b = np.array(ends).T
    got = pieces._lengths(pieces._planes(a, b, n, np.array(at)), slice(0, n), len(at), np.int32)
    assert got.tolist() == [[plain.get((s, t), 0) for s in at] for t in range(n)]


def test_distances_are_given_out_a_few_at_a_time(spark, monkeypatch):
    """All pairs of a block of sources were one table in Python and one batch in the JVM, and edges were dealt row by row."""
    monkeypatch.setattr(pieces, "CELLS", 8)
    monkeypatch.setattr(pieces, "LISTED", 5)
    monkeypatch.setattr(pieces, "PACKED", 3)
    pairs = random_graph(random.Random(3), 30, 40)
    nodes, held, open_ = pieces.pieces(frame(spark, pairs, "src string, dst string"))
    packed = pieces.packed(held)
    assert open_.isEmpty() and held.count() == len(pairs) == packed.selectExpr("sum(length(a)) / 8").first()[0]
    plain = plain_paths(pairs, {x for p in pairs for x in p})
    got = pieces.distances(nodes, packed, nodes.where("node < 'n020'")).collect()
    assert {(r["source"], r["node"]): r["dist"] for r in got} == {k: d for k, d in plain.items() if d and k[0] < "n020"}
    assert len(got) == len({(r["source"], r["node"]) for r in got})


def test_groups_of_many_edges_a_node_are_those_of_rounds_over_edges(spark):
    """Of a dense part, a path whose numbers fall and rise, a star, and loops and ends that are null."""
    rng = random.Random(9)
    dense = [tuple(rng.sample(range(100, 130), 2)) for _ in range(200)]
    path = [(x, y) for x, y in zip([7, 3, 9, 1, 8, 2, 6], [3, 9, 1, 8, 2, 6, 4])]
    star = [(900, x) for x in range(200, 220)]
    edges = groups.stash(frame(spark, [*dense, *path, *star, (5, 5), (None, 3), (31, 30)], "a long, b long"))
    want = {tuple(r) for r in groups.components(edges).select("node", "component").collect()}
    got = [tuple(r) for r in groups.dense_components(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {c for n, c in got if n < 100 or n >= 200} == {1, 30, 200}


@pytest.mark.parametrize("most", [4, pieces.MOST_EDGES])
def test_groups_of_sets_are_found_without_bits_of_edges(spark, monkeypatch, most):
    """Sets of three words, two to a task; pieces held by tasks, or left to joins."""
    monkeypatch.setattr(pieces, "MOST_EDGES", most)
    rng = random.Random(11)
    pairs = random_graph(rng, 40, 30)
    sets = [{f"n{i:03d}" for i in range(40) if rng.random() < p} for p in [0.0, 1.0, *[rng.random() for _ in range(140)]]]
    rows = [(f"n{i:03d}", k) for i in range(40) for k, own in enumerate(sets) if f"n{i:03d}" in own]
    labelled = bits.pack(frame(spark, rows, "node string, idx int"), len(sets))
    got = {r["idx"]: (r["lcc"], r["ad_ad_edges"]) for r in bits._groups(bits._split(frame(spark, pairs, "src string, dst string"), labelled), labelled, len(sets)).collect()}
    want = {}
    for k, own in enumerate(sets):
        reached = [s for s, _ in plain_paths(pairs, own)]
        inside = sum(a in own and b in own for a, b in pairs)
        if inside:
            want[k] = (max(reached.count(s) for s in set(reached)), inside)
    assert got == want
