"""Queries that put several operators together: gene vectors, node labels, the graph bundle with its nulls, summaries of runs.

Parts stand for genes; the first two words of a part's name are its symbol, and its accession is that of an entity with a vector.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bits, cohort, experiment, graph, linear, matrix, models, neighbourhoods, ordered, permute, vectors
from ..operators.groups import shared_dir, stash
from ..sources import npy
from ..sources.store import Store, cohort_tables, run_manifests
from .signal import BINS, ENR, HOPS, NN, PERMS, SEED, G, edges, emb, labels, matched, perm, scored_edges, table
from .tabular import EPOCHS, L2, RATE, SEEDS, expression
from .tabular import SQL as TABULAR_SQL

QUERIES, SQL = {}, {}
#: Number of accessions that parts are mapped to; more than there are vectors in the smallest tables, so that some have none.
ACCESSIONS = 700


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def genes(spark, sf) -> DataFrame:
    """(gene_symbol, label, y, uniprot_accession, pos)"""
    words = F.split("p_name", " ")
    case = F.col("p_brand") == "Brand#13"
    return table(spark, sf, "part").select(
        F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("gene_symbol"),
        F.when(case, "ad").otherwise("control").alias("label"),
        case.cast("int").alias("y"),
        F.concat(F.lit("P"), (F.col("p_partkey") % ACCESSIONS).cast("string")).alias("uniprot_accession"),
        F.col("p_partkey").alias("pos"),
    )


GENES = f"""ge AS (SELECT upper(trim(array_to_string(string_split(p_name, ' ')[1:2], ' '))) AS gene_symbol, CASE WHEN p_brand = 'Brand#13' THEN 'ad' ELSE 'control' END AS label,
(p_brand = 'Brand#13')::INT AS y, 'P' || (p_partkey % {ACCESSIONS}) AS acc, p_partkey AS pos FROM part)"""


@query(
    f"WITH {GENES}, f AS (SELECT gene_symbol, arg_min(label, pos) AS label, arg_min(y, pos) AS y FROM ge GROUP BY gene_symbol), r AS (SELECT gene_symbol, acc, pos, embedding FROM ge JOIN embeddings ON 'P' || vec_id = acc), "
    "a AS (SELECT gene_symbol, arg_min(acc, pos) AS uniprot_accession FROM r GROUP BY gene_symbol), c AS (SELECT gene_symbol, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM r) "
    "SELECT gene_symbol, label, y, uniprot_accession, pos, round(avg(x), 9) AS mean FROM c JOIN a USING (gene_symbol) JOIN f USING (gene_symbol) GROUP BY 1, 2, 3, 4, 5"
)
def gene_embedding_table(spark, sf):
    g = genes(spark, sf)
    named = emb(spark, sf).select(F.concat(F.lit("AF-P"), F.col("id").cast("string"), F.lit("-F1")).alias("name"), "v")
    t = cohort.gene_vectors(g.select("gene_symbol", "label", "pos"), g.select("gene_symbol", "uniprot_accession", "pos"), named)
    return t.select("gene_symbol", "label", "y", "uniprot_accession", F.posexplode("v").alias("pos", "mean")).withColumn("mean", F.round("mean", 9))


@query(f"WITH {GENES} SELECT gene_symbol, arg_min(y, pos) AS y, gene_symbol AS node FROM ge GROUP BY gene_symbol")
def labels_by_symbol(spark, sf):
    return cohort.node_labels(genes(spark, sf))


@query(f"WITH {GENES}, j AS (SELECT l.gene_symbol, l.y, m.acc AS node, row_number() OVER (PARTITION BY m.acc ORDER BY l.pos, m.pos) AS r FROM ge l JOIN ge m USING (gene_symbol)) SELECT gene_symbol, y, node FROM j WHERE r = 1")
def labels_by_accession(spark, sf):
    g = genes(spark, sf)
    return cohort.node_labels(g.select("gene_symbol", "y", "pos"), g.select("gene_symbol", "uniprot_accession", "pos"))


@query("SELECT doc_id AS gene_symbol, CASE WHEN toxic = 0 THEN quality END::INT AS y FROM labels")
def label_schema(spark, sf):
    y = F.when(F.col("toxic") == 0, F.col("quality").cast("string")).otherwise("unknown")
    return cohort.label_schema(table(spark, sf, "labels").select(F.col("doc_id").alias("gene_id"), F.col("doc_id").alias("gene_symbol"), y.alias("y")))


@query("WITH c AS (SELECT upper(trim(split_part(p_name, ' ', 1))) AS gene_symbol, p_size::DOUBLE AS n, row_number() OVER (PARTITION BY upper(trim(split_part(p_name, ' ', 1))) ORDER BY p_partkey) AS r FROM part WHERE p_size % 2 = 0) SELECT gene_symbol, n AS annotation_count FROM c WHERE r = 1")
def annotation_counts(spark, sf):
    count = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return cohort.annotation_counts(table(spark, sf, "part").select(F.split("p_name", " ")[0].alias("gene_symbol"), count.alias("annotation_count"), "p_partkey"), "p_partkey")


@query(f"WITH {G} SELECT node, (row_number() OVER (ORDER BY md5('4200001:' || node), node) <= (SELECT sum(y) FROM lab))::INT AS y, CASE WHEN (row_number() OVER (ORDER BY md5('4200001:' || node), node)) <= (SELECT sum(y) FROM lab) THEN 'AD' ELSE 'control' END AS label, true AS fallback_used FROM lab")
def baseline_fallback(spark, sf):
    return experiment.baseline_labels(labels(spark, sf), "random_matched_set_plus_bias", 42, 1)


PATHS = "rp(s, t, d) AS (SELECT node, node, 0 FROM lab{ad} UNION SELECT s, v, d + 1 FROM rp JOIN adj ON u = t WHERE d < 8), pd AS (SELECT s, t, min(d) AS d FROM rp GROUP BY s, t)"
BUNDLE = ["expected", "observed", "enrichment", "mean_ad_neighbor_fraction", "mean_ad_shortest_path"]


@query(
    f"WITH RECURSIVE {ENR}, aa AS (SELECT u, v FROM adj JOIN lab a ON a.node = u JOIN lab b ON b.node = v WHERE a.y = 1 AND b.y = 1), rc(s, t) AS (SELECT node, node FROM lab WHERE y = 1 UNION SELECT s, v FROM rc JOIN aa ON u = t), "
    + PATHS.format(ad=" WHERE y = 1")
    + ", nf AS (SELECT avg(f) AS f FROM (SELECT avg(b.y) AS f FROM adj JOIN lab a ON a.node = u JOIN lab b ON b.node = v GROUP BY u)) "
    "SELECT n, n_ad::BIGINT AS n_ad, (n - n_ad)::BIGINT AS n_control, ad_ad_edges, ad_control_edges, control_control_edges, labelled_edges, round(expected, 9) AS expected, round(observed, 9) AS observed, round(observed / expected, 9) AS enrichment, "
    "(SELECT max(c) FROM (SELECT count(*) AS c FROM rc GROUP BY s)) AS lcc, round((SELECT f FROM nf), 9) AS mean_ad_neighbor_fraction, (SELECT round(avg(d), 9) FROM pd JOIN lab ON t = node AND y = 1 WHERE s < t) AS mean_ad_shortest_path FROM en"
)
def graph_metric_bundle(spark, sf):
    g = edges(spark, sf)
    return graph.metrics(g, labels(spark, sf), paths=True).withColumns({c: F.round(c, 9) for c in BUNDLE})


@query(
    f"WITH RECURSIVE {BINS}{perm('bins')}, al AS (SELECT perm_idx, node, y FROM pl UNION ALL SELECT -1, node, y FROM lab), a2 AS (SELECT src AS u, dst AS v FROM g WHERE score >= 2 UNION ALL SELECT dst, src FROM g WHERE score >= 2), "
    "pos AS (SELECT perm_idx, node FROM al WHERE y = 1), rc(p, s, t) AS (SELECT perm_idx, node, node FROM pos UNION SELECT p, s, v FROM rc JOIN a2 ON u = t JOIN pos ON perm_idx = p AND node = v), "
    + PATHS.format(ad="")
    + ", lc AS (SELECT p AS perm_idx, max(c)::DOUBLE AS x FROM (SELECT p, s, count(*) AS c FROM rc GROUP BY p, s) GROUP BY p), "
    "ps AS (SELECT a.perm_idx, round(avg(d), 12) AS x FROM pd JOIN pos a ON a.node = s JOIN pos b ON b.node = t AND b.perm_idx = a.perm_idx WHERE s < t GROUP BY 1), "
    "m AS (SELECT 'lcc' AS metric, perm_idx, x, 1 AS side FROM lc UNION ALL SELECT 'mean_ad_shortest_path', perm_idx, x, -1 FROM ps) "
    "SELECT metric, round(o.x, 9) AS observed, round(avg(n.x), 9) AS perm_mean, round(stddev_pop(n.x), 9) AS perm_std, round((count(*) FILTER (n.x * n.side >= o.x * o.side) + 1) / (count(*) + 1)::DOUBLE, 9) AS pvalue "
    "FROM m n JOIN m o USING (metric) WHERE n.perm_idx >= 0 AND o.perm_idx < 0 GROUP BY metric, o.x"
)
def graph_perm_components_paths(spark, sf):
    """Nulls of the largest component, right-tailed, over pairs of a score of 2, and of the shortest path, left-tailed, over all pairs."""
    g, strong = edges(spark, sf), edges(spark, sf, 2)
    both, own = bits.with_labels(bits.shuffled(matched(spark, sf, g), PERMS, SEED, "bin"), PERMS, labels(spark, sf))
    both = stash(both, "sets")
    number = F.when(F.col("idx") == own, -1).otherwise(F.col("idx")).alias("perm_idx")
    lcc = bits.component_sizes(strong, both, own + 1).where(f"idx < {PERMS} or idx = {own}").select(number, "lcc")
    paths = bits.mean_paths(g, both, own + 1).where(f"idx < {PERMS} or idx = {own}").select(number, F.round("mean_shortest_path", 12).alias("mean_ad_shortest_path"))
    out = None
    for name, df, tail in (("lcc", lcc, "right"), ("mean_ad_shortest_path", paths, "left")):
        df = stash(df, name)
        one = permute.null_summary(df.where("perm_idx >= 0"), df.where("perm_idx < 0"), [name], tail)
        out = one if out is None else out.union(one)
    return out.withColumns({c: F.round(c, 9) for c in ("observed", "perm_mean", "perm_std", "pvalue")})


@query()
def prediction_table(spark, sf):
    """Scores of the held-out rows of a feed-forward probe, with what is known of each."""
    rows = emb(spark, sf)
    runs = stash(models.scaled(models.runs_of(rows.select("id", "v"), models.split(rows.select(F.col("id").alias("node"), "y"), SEEDS), ("embedding",))), "runs")
    p = models.predictions(runs, models.FeedForward(), models.descend(runs, models.FeedForward(), EPOCHS, RATE, L2))
    scores = cohort.integrated_scores(expression(spark, sf)).withColumnRenamed("gene", "id")
    return models.held_out_predictions(p, rows.select("id", F.concat(F.lit("P"), F.col("id").cast("string")).alias("uniprot_accession"), "label").join(scores, "id", "left"))


@query(
    "WITH t AS (SELECT event_type, event_id, exp(-value / 20) AS p FROM events WHERE event_id % 11 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM t), "
    "f AS (SELECT event_type, event_id, k, n, least(1, min(p * n / k) OVER (PARTITION BY event_type ORDER BY k DESC)) AS q FROM r) "
    "SELECT event_type, event_id, k::BIGINT AS rank, n AS n_tests, round(q, 9) AS q FROM f UNION ALL SELECT event_type, event_id, NULL, NULL, NULL FROM events WHERE event_id % 11 = 0"
)
def fdr_qvalues(spark, sf):
    """Adjusted p-values of one test for each event, by type; values are exponential under the null, and an eleventh has no test."""
    p = F.when(F.col("event_id") % 11 != 0, F.exp(-F.col("value") / 20)).alias("p")
    tests = table(spark, sf, "events").select("event_type", "event_id", p)
    return ordered.fdr(tests, "p", "event_id", ["event_type"]).select("event_type", "event_id", "rank", "n_tests", F.round("q", 9).alias("q"))


COHORT = {"name": "default", "controls_per_ad": 2, "min_global_expression": 10.0}


def cohort_of(spark, sf, kept: Store) -> dict[str, DataFrame]:
    p = table(spark, sf, "part")
    cases = p.where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("gene"))
    mapping = p.select(F.col("p_partkey").cast("string").alias("symbol"), F.concat_ws("; ", "p_type", "p_name").alias("accessions"), F.col("p_partkey").alias("pos"))
    counts = p.select(F.col("p_partkey").cast("string").alias("gene_symbol"), F.col("p_size").alias("annotation_count"), F.col("p_partkey").alias("pos"))
    return cohort_tables(kept, COHORT, stash(expression(spark, sf), "expression"), cases, mapping, counts)


@query(
    TABULAR_SQL["label_table"][: TABULAR_SQL["label_table"].index(" SELECT gene, CASE")]
    + r", lt AS (SELECT gene, y, s FROM ch JOIN iscore USING (gene)) SELECT gene::VARCHAR AS gene_symbol, y::INT AS y, upper(string_split(trim(regexp_replace(p_type || '; ' || p_name, '[|;,\s]+', ' ', 'g')), ' ')[1]) AS uniprot_accession, p_size::DOUBLE AS annotation_count "
    "FROM lt JOIN part ON p_partkey = gene"
)
def cohort_store(spark, sf):
    """A cohort's tables, made once and kept; read back by a second call, and joined."""
    kept = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    cohort_of(spark, sf, kept)
    t = cohort_of(spark, sf, kept)
    if kept.made != 3 or kept.manifest().count() != 3:
        raise RuntimeError("a kept table was made again")
    return t["labels"].select("gene_symbol", "y").join(t["mapping"], "gene_symbol").join(t["annotation_counts"], "gene_symbol", "left")


BUDGET, DRAWS, FOLDS = 25, 50, 5


@query(
    f"WITH {NN}, k AS (SELECT id, nb, round(list_cosine_similarity(x.v, z.v), 9) AS sim FROM nn JOIN e x USING (id) JOIN e z ON z.id = nb WHERE rk <= 10), "
    "t AS (SELECT a.id, b.nb AS node, count(*) AS paths, round(max(a.sim * b.sim), 9) AS best FROM k a JOIN k b ON b.id = a.nb WHERE b.nb <> a.id GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY paths DESC, best DESC, node) AS rank FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = t.id AND k.nb = t.node)) "
    f"SELECT id, node, paths, rank FROM r WHERE rank <= {BUDGET}"
)
def two_hop_neighbours(spark, sf):
    return neighbourhoods.two_hop(vectors.nearest(emb(spark, sf), 10), BUDGET).select("id", "node", "paths", "rank")


@query(
    f"WITH {BINS}, dr AS (SELECT k AS draw, node, bin, row_number() OVER (PARTITION BY k, bin ORDER BY md5('{SEED}:' || k || ':' || node), node) - 1 AS place FROM bins, range(0, {DRAWS}) t(k)), "
    "sz AS (SELECT bin, count(*) AS size FROM bins GROUP BY bin), wa AS (SELECT u, b.bin, count(*) AS m FROM adj JOIN lab ON lab.node = u AND y = 1 JOIN bins b ON b.node = v GROUP BY ALL), "
    f"wd AS (SELECT wa.*, size, draw, ('0x' || substr(md5('{SEED}:' || draw || ':' || bin || ':' || u), 1, 8))::BIGINT % size AS f FROM wa JOIN sz USING (bin), range(0, {DRAWS}) t(draw)), "
    "wo AS (SELECT wd.*, (place - f + size) % size AS own FROM wd LEFT JOIN dr ON dr.draw = wd.draw AND dr.bin = wd.bin AND dr.node = u), "
    "st AS (SELECT u, wo.draw, wo.bin, (f + i) % size AS place FROM wo, LATERAL (SELECT unnest(range(0, m + 1)) AS i) x WHERE (i < m OR own < m) AND (own IS NULL OR i <> own)), "
    "sm AS (SELECT u AS node, st.draw, round(avg(y), 9) AS x FROM st JOIN dr USING (draw, bin, place) JOIN lab ON lab.node = dr.node GROUP BY ALL), "
    "ob AS (SELECT a.node, count(*) AS degree, round(avg(b.y), 9) AS observed FROM lab a JOIN adj ON u = a.node JOIN lab b ON b.node = v WHERE a.y = 1 GROUP BY a.node) "
    f"SELECT node, degree, observed, round(avg(x), 9) AS null_mean, round((count(*) FILTER (x >= observed) + 1) / {DRAWS + 1}::DOUBLE, 9) AS pvalue_right FROM ob JOIN sm USING (node) GROUP BY ALL"
)
def neighbourhood_tests(spark, sf):
    """Positives around each positive, against random neighbourhoods of nodes of like degrees."""
    g, lab = edges(spark, sf), labels(spark, sf)
    t = neighbourhoods.neighbourhood_tests(g, lab, stash(graph.degree_bins(lab, g).select("node", "bin"), "bins"), DRAWS, SEED)
    return t.withColumns({c: F.round(c, 9) for c in ("null_mean", "pvalue_right")})


@query(f"WITH {G} SELECT node, y, ((row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || node), node) - 1) % {FOLDS})::INT AS fold FROM lab")
def stratified_folds(spark, sf):
    return linear.folds(labels(spark, sf).withColumnRenamed("node", "id"), FOLDS, SEED).withColumnRenamed("id", "node")


@query()
def cross_validation(spark, sf):
    """Held-out scores of logistic regression and of a linear SVM, fold by fold."""
    rows = emb(spark, sf).select(F.col("id").cast("string").alias("id"), "v", "y")
    _, scored = linear.cross_validated(rows.select("id", "v"), linear.folds(rows, FOLDS, SEED), FOLDS, L2)
    return linear.fold_scores(scored)


THRESHOLDS = [1, 2, 3, 4, 5]


@query(
    f"WITH RECURSIVE {G}, ad AS (SELECT node FROM lab WHERE y = 1), x AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold), e2 AS (SELECT threshold, src AS u, dst AS v FROM g, x WHERE score >= threshold AND src IN (FROM ad) AND dst IN (FROM ad)), "
    "e3 AS (SELECT * FROM e2 UNION ALL SELECT threshold, v, u FROM e2), rc(h, s, t) AS (SELECT threshold, node, node FROM ad, x UNION SELECT h, s, v FROM rc JOIN e3 ON h = threshold AND t = u), "
    "r AS (SELECT h AS threshold, s, min(t) AS root, count(*) AS size FROM rc GROUP BY ALL) SELECT threshold, count(DISTINCT root) AS n_components, max(size) AS lcc FROM r GROUP BY threshold"
)
def threshold_sweep(spark, sf):
    """Components of the positives at every threshold of the score, from one spanning forest."""
    return graph.threshold_sweep(scored_edges(spark, sf), labels(spark, sf), THRESHOLDS)


@query("SELECT vec_id AS id, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings")
def npy_vectors(spark, sf):
    """Vectors written as parts of .npy arrays, with their ids in front, and read back by ranges of rows."""
    path = f"{shared_dir(spark)}/npy-{uuid.uuid4().hex}"
    npy.write_npy(emb(spark, sf).select(F.concat(F.array(F.col("id").cast("double")), "v").alias("v")), path)
    back = npy.read_npy(spark, path)
    return back.select(F.col("v")[0].cast("long").alias("id"), F.posexplode(F.slice("v", 2, 1 << 30)).alias("pos", "x"))


# --- The experiment matrix: 3 ablations, 41 baseline replicates and 10 seeds

MATRIX_SEEDS = list(range(42, 52))
BASELINES = [("observed_ad", 1), ("permute_labels", 20), ("random_matched_set", 10), (experiment.ANNOTATED, 10)]
MATRIX_ABLATIONS = ["embedding", "random_embedding", "label_shuffle"]


def matrix_parts(spark, sf) -> tuple:
    """Entries, their label sets, the labelled nodes with bits and degree bins, the graph, and how bits are laid out."""
    entries = stash(experiment.run_id(experiment.matrix(spark, ["default"], MATRIX_ABLATIONS, BASELINES, MATRIX_SEEDS)), "entries")
    sets, seeds, per = matrix.number_sets(entries)
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("node")).agg(F.count(F.lit(1)).alias("annotation_count"))
    nodes = matrix.labelled(sets, seeds, per, labels(spark, sf), counts)
    return entries, sets, seeds, per, nodes


SETS = (
    BINS
    + f""", st AS (SELECT baseline, replicate, seed, seed * 100000 + replicate AS s FROM (VALUES {", ".join(f"('{b}', {n})" for b, n in BASELINES)}) b(baseline, n), range(0, 20) r(replicate), (SELECT unnest({MATRIX_SEEDS}) AS seed) WHERE replicate < n),
ct AS (SELECT l_partkey::VARCHAR AS node, count(*) AS c FROM lineitem GROUP BY 1), ck AS (SELECT node, y, coalesce(c, (SELECT median(ct.c) FROM lab JOIN ct USING (node)))::DOUBLE AS c FROM lab LEFT JOIN ct USING (node)),
cq AS (SELECT list_sort(list_distinct(quantile_cont(c, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS x FROM ck), cb AS (SELECT node, y, len(list_filter(x[2:len(x) - 1], lambda t: t < c)) AS cbin FROM ck, cq),
dr AS (SELECT baseline, replicate, seed, node, y, CASE WHEN baseline = '{experiment.ANNOTATED}' THEN cbin ELSE 0 END AS grp, CASE baseline WHEN 'permute_labels' THEN md5(s || ':0:' || node) ELSE md5(s || ':' || node) END AS h FROM st, cb WHERE baseline <> 'observed_ad'),
rk AS (SELECT *, row_number() OVER (PARTITION BY baseline, replicate, seed, grp ORDER BY h, node) AS k, sum(y) OVER (PARTITION BY baseline, replicate, seed, grp) AS want FROM dr),
ni AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM lab),
ls AS (SELECT baseline, replicate, seed, node, y FROM st, lab WHERE baseline = 'observed_ad' UNION ALL SELECT baseline, replicate, seed, ni.node, y FROM rk JOIN ni USING (k) WHERE baseline = 'permute_labels'
  UNION ALL SELECT baseline, replicate, seed, node, (k <= want)::INT FROM rk WHERE baseline NOT IN ('observed_ad', 'permute_labels'))"""
)


@query(f"WITH {SETS} SELECT baseline, replicate::INT AS replicate, seed::INT AS seed, node FROM ls WHERE y = 1")
def matrix_label_sets(spark, sf):
    """The positives of every label set of the matrix."""
    _, sets, _, _, nodes = matrix_parts(spark, sf)
    return bits.listed(nodes).join(sets, "idx").select("baseline", "replicate", "seed", "node")


def matrix_graph(spark, sf, sets, nodes, g) -> DataFrame:
    n = len(nodes.select("bits").first()[0]) * bits.WORD
    return sets.join(bits.metrics(g, nodes, n, paths=True), "idx")


TOPOLOGY = ["ad_ad_edges", "enrichment", "mean_ad_neighbor_fraction", "lcc", "mean_ad_shortest_path"]


@query(
    f"WITH RECURSIVE {SETS}, pos AS (SELECT baseline, replicate, seed, node FROM ls WHERE y = 1), "
    "aa AS (SELECT a.baseline, a.replicate, a.seed, u, v FROM adj JOIN pos a ON a.node = u JOIN pos b ON b.node = v AND b.baseline = a.baseline AND b.replicate = a.replicate AND b.seed = a.seed), "
    "rc(b, r, z, s, t) AS (SELECT baseline, replicate, seed, node, node FROM pos UNION SELECT b, r, z, s, v FROM rc JOIN aa ON u = t AND baseline = b AND replicate = r AND seed = z), "
    + PATHS.format(ad="")
    + ", lc AS (SELECT b AS baseline, r AS replicate, z AS seed, max(c) AS lcc FROM (SELECT b, r, z, s, count(*) AS c FROM rc GROUP BY ALL) GROUP BY ALL), "
    "ps AS (SELECT a.baseline, a.replicate, a.seed, avg(d) AS d FROM pd JOIN pos a ON a.node = s JOIN pos b ON b.node = t AND b.baseline = a.baseline AND b.replicate = a.replicate AND b.seed = a.seed WHERE s < t GROUP BY ALL), "
    "ec AS (SELECT baseline, replicate, seed, count(*) / 2 AS aa FROM aa GROUP BY ALL), nf AS (SELECT baseline, replicate, seed, avg(f) AS f FROM (SELECT baseline, replicate, seed, u, avg(y) AS f FROM adj JOIN ls ON ls.node = v GROUP BY ALL) GROUP BY ALL), "
    "sz AS (SELECT count(*) AS n, (SELECT count(*) FROM g) AS m FROM lab), ad AS (SELECT baseline, replicate, seed, count(*) AS k FROM pos GROUP BY ALL) "
    "SELECT baseline, replicate::INT AS replicate, seed::INT AS seed, coalesce(aa, 0)::BIGINT AS ad_ad_edges, round(coalesce(aa, 0) / m / (k * (k - 1) / (n * (n - 1))::DOUBLE), 9) AS enrichment, round(f, 9) AS mean_ad_neighbor_fraction, "
    "lcc, round(d, 9) AS mean_ad_shortest_path FROM ad JOIN lc USING (baseline, replicate, seed) JOIN nf USING (baseline, replicate, seed) LEFT JOIN ec USING (baseline, replicate, seed) LEFT JOIN ps USING (baseline, replicate, seed), sz"
)
def matrix_topology(spark, sf):
    """Graph metrics of every label set of the matrix, over pairs ordered together twice."""
    _, sets, _, _, nodes = matrix_parts(spark, sf)
    found = matrix_graph(spark, sf, sets, nodes, edges(spark, sf))
    return found.select("baseline", "replicate", "seed", *TOPOLOGY).withColumns({c: F.round(c, 9) for c in TOPOLOGY if c not in ("ad_ad_edges", "lcc")})


def matrix_hop_tests(spark, sf, seeds, per, nodes, g) -> DataFrame:
    lab = labels(spark, sf)
    binned = stash(nodes.join(graph.degree_bins(lab, g).select("node", "bin"), "node"), "binned")
    nn = vectors.nearest(emb(spark, sf), max(HOPS)).select(F.col("id").cast("string").alias("id"), F.col("neighbour").cast("string").alias("neighbour"), "rank")
    return matrix.hop_tests(nn, binned, g, HOPS, seeds, per, PERMS)


@query(
    f"WITH {NN}, {SETS}, gs AS (SELECT DISTINCT seed FROM st), pr AS (SELECT seed, k AS perm_idx, node, bin, md5(seed || ':' || k || ':' || node) AS h FROM bins, gs, range(0, {PERMS}) t(k)), "
    "ph AS (SELECT seed, perm_idx, bin, node AS src_node, row_number() OVER (PARTITION BY seed, perm_idx, bin ORDER BY h, node) AS r FROM pr), bi AS (SELECT node, bin, row_number() OVER (PARTITION BY bin ORDER BY node) AS r FROM bins), "
    "mv AS (SELECT seed, perm_idx, bi.node, src_node FROM ph JOIN bi USING (bin, r)), n5 AS (SELECT id::VARCHAR AS node, nb::VARCHAR AS nb, rk FROM nn WHERE rk <= 5), "
    "oa AS (SELECT DISTINCT baseline, replicate, seed, u FROM adj JOIN ls ON node = v AND y = 1), "
    "hk AS (SELECT l.baseline, l.replicate, l.seed, n5.node, k, avg((adj.u IS NOT NULL)::INT) AS r1, avg(l.y) AS r2, avg((oa.u IS NOT NULL)::INT) AS r3 FROM n5 JOIN (VALUES (1), (2), (5)) t(k) ON rk <= k JOIN ls l ON l.node = nb "
    "LEFT JOIN adj ON adj.u = n5.node AND adj.v = nb LEFT JOIN oa ON oa.u = nb AND oa.baseline = l.baseline AND oa.replicate = l.replicate AND oa.seed = l.seed GROUP BY ALL), "
    "pl AS (SELECT baseline, replicate, seed, perm_idx, mv.node, y FROM mv JOIN ls USING (seed) WHERE ls.node = src_node UNION ALL SELECT baseline, replicate, seed, -1, node, y FROM ls), "
    "dd AS (SELECT baseline, replicate, seed, perm_idx, k, " + ", ".join(f"round(avg(r{i}) FILTER (y = 1) - avg(r{i}) FILTER (y = 0), {matrix.DECIMALS}) AS {m}" for i, m in enumerate(permute.HOP_METRICS, 1)) + " FROM pl JOIN hk USING (baseline, replicate, seed, node) GROUP BY ALL), "
    f"ul AS (UNPIVOT dd ON {', '.join(permute.HOP_METRICS)} INTO NAME metric VALUE d) "
    f"SELECT o.baseline, o.replicate::INT AS replicate, o.seed::INT AS seed, o.k, o.metric, round(o.d, 9) AS delta, round((count(*) FILTER (p.d >= o.d) + 1) / {PERMS + 1}::DOUBLE, 9) AS pvalue_right "
    "FROM ul o JOIN ul p USING (baseline, replicate, seed, k, metric) WHERE o.perm_idx = -1 AND p.perm_idx >= 0 GROUP BY o.baseline, o.replicate, o.seed, o.k, o.metric, o.d"
)
def matrix_hops(spark, sf):
    """Hop deltas and p-values of every label set of the matrix."""
    _, sets, seeds, per, nodes = matrix_parts(spark, sf)
    found = matrix_hop_tests(spark, sf, seeds, per, nodes, edges(spark, sf)).join(sets, "idx")
    return found.select("baseline", "replicate", "seed", "k", "metric", F.round("delta", 9).alias("delta"), F.round("pvalue_right", 9).alias("pvalue_right"))


@query()
def run_manifest(spark, sf):
    """What each run of the matrix is made from: its entry, the settings, and a hash over the input files."""
    entries = experiment.signature_id(experiment.matrix(spark, ["default"], MATRIX_ABLATIONS, BASELINES, MATRIX_SEEDS))
    files = experiment.content_hashes(spark, [f"{sf}/{t}.parquet" for t in ("embeddings", "lineitem")])
    return run_manifests(entries, {"epochs": EPOCHS, "rate": RATE, "l2": L2, "permutations": PERMS, "hops": HOPS}, files)


@query()
def run_summary(spark, sf):
    """One row for each of the 1,230 runs of the matrix: probe, graph and hop results."""
    entries, sets, seeds, per, nodes = matrix_parts(spark, sf)
    g = edges(spark, sf)
    v = emb(spark, sf).select(F.col("id").cast("string").alias("node"), "v")
    split = stash(matrix.splits(sets, nodes, len(seeds) * per * bits.WORD), "splits")
    probes = matrix.probes(matrix.copies(v, nodes, split, seeds, per, MATRIX_ABLATIONS), sets, seeds, per, EPOCHS, RATE, L2)
    known = entries.join(sets, ["baseline", "replicate", "seed"])
    part = lambda df, keys: known.select("run_id", *keys).join(df, keys).drop(*keys)
    topology = part(matrix_graph(spark, sf, sets, nodes, g).select("idx", "enrichment", "mean_ad_neighbor_fraction", "lcc", "mean_ad_shortest_path"), ["idx"])
    tests = part(matrix_hop_tests(spark, sf, seeds, per, nodes, g), ["idx"])
    return experiment.summary_rows(entries.withColumn("fallback_used", F.lit(False)), part(probes, ["ablation", "idx"]), topology, tests)
