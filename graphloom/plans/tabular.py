"""Queries on cohorts, tables, probes and the experiment matrix, over stand-in tables, with their SQL.

Parts stand for genes, line items for expression samples (supplier, quantity), a supplier's nation for the sampled region.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cohort, coverage, experiment, graph, models, ordered
from ..operators.groups import shared_dir, stash
from ..sources.store import Store, kept_split
from .signal import E, G, edges, emb, labels, table

QUERIES, SQL = {}, {}
SEEDS = [42, 43]
#: Seeds, epochs, rate and penalty of the probes.
PROBE_SEEDS, EPOCHS, RATE, L2 = list(range(42, 52)), 200, 0.05, 1e-3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def samples(spark, sf) -> DataFrame:
    """(s_suppkey, region) of suppliers."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    acronym = F.element_at(F.array(*[F.lit(x) for x in ("ca-HC", "PHGl", "MTG", "V1C", "itgx")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    main = F.when(F.col("n_regionkey") == 3, "tl").otherwise("FL")
    return s.select("s_suppkey", text.region(main, F.col("n_name"), acronym).alias("region"))


REG = """sm AS (SELECT s_suppkey, CASE n_nationkey % 5 WHEN 0 THEN 'hippocampus' WHEN 1 THEN 'entorhinal' ELSE CASE WHEN n_nationkey % 5 IN (2, 4) OR n_regionkey = 3 THEN 'temporal' END END AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
EXPR = REG + """, re AS (SELECT l_partkey AS gene, region, avg(l_quantity) AS expr FROM lineitem JOIN sm ON s_suppkey = l_suppkey WHERE region IS NOT NULL GROUP BY 1, 2),
gm AS (SELECT *, avg(expr) OVER (PARTITION BY gene) AS global_mean FROM re)"""


@query(f"WITH {REG} SELECT s_suppkey, region FROM sm")
def region_tag(spark, sf):
    return samples(spark, sf)


def expression(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("tpm"), "l_suppkey")
    return cohort.region_expression(li.join(samples(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")))


@query(f"WITH {EXPR} SELECT gene, region, round(expr, 9) AS expr, round(global_mean, 9) AS global_mean FROM gm")
def region_expression(spark, sf):
    return expression(spark, sf).select("gene", "region", F.round("expr", 9).alias("expr"), F.round("global_mean", 9).alias("global_mean"))


SCORE = EXPR + """, sp AS (SELECT gene, region, expr, CASE WHEN count(*) OVER w > 1 THEN expr - (sum(expr) OVER w - expr) / (count(*) OVER w - 1) END AS spec FROM gm WINDOW w AS (PARTITION BY gene)),
zz AS (SELECT gene, (expr - avg(expr) OVER r) / stddev_pop(expr) OVER r AS ze, coalesce((spec - avg(spec) OVER r) / stddev_pop(spec) OVER r, 0) AS zs FROM sp WINDOW r AS (PARTITION BY region)),
iscore AS (SELECT gene, avg(0.7 * ze + 0.3 * zs) AS s FROM zz GROUP BY gene)"""


@query(f"WITH {SCORE} SELECT gene, round(s, 7) AS integrated_score FROM iscore")
def integrated_score(spark, sf):
    return cohort.integrated_scores(expression(spark, sf)).select("gene", F.round("integrated_score", 7).alias("integrated_score"))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 7) AS z FROM part")
def zscore(spark, sf):
    return ordered.zscore(table(spark, sf, "part"), "p_retailprice", "z").select("p_partkey", F.round("z", 7).alias("z"))


def features(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("stratum"), F.col("p_retailprice").alias("value"), (F.col("p_brand") == "Brand#13").cast("int").alias("is_case"))


def greedy(ids: str, values: str) -> str:
    """Taking turns in SQL: (case_id, control_id, rank), a step for each case. ``ids``: (id, turn) of cases in their order, ``values``: (id, v, is_case)."""
    pick = f"(SELECT list(id ORDER BY far, id)[1:2] FROM (SELECT p.id, abs(p.v - q.v) AS far FROM {values} p, {values} q WHERE NOT p.is_case AND q.id = {{case}} AND NOT list_contains({{took}}, p.id)))"
    return f"""turns(turn, case_id, took, own) AS (
  SELECT 0::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT t.turn + 1, c.id, list_concat(t.took, t.own), {pick.format(case="c.id", took="list_concat(t.took, t.own)")} FROM turns t JOIN {ids} c ON c.turn = t.turn + 1),
mg AS (SELECT case_id, unnest(own) AS control_id, unnest(range(1, len(own) + 1))::INT AS rank FROM turns)"""


@query(
    "WITH RECURSIVE f AS (SELECT p_partkey AS id, p_retailprice AS v, p_brand = 'Brand#13' AS is_case FROM part), o AS (SELECT id, row_number() OVER (ORDER BY id) AS turn FROM f WHERE is_case), "
    + greedy("o", "f")
    + " SELECT case_id, control_id, rank FROM mg"
)
def matched_controls_greedy(spark, sf):
    return cohort.matched_greedy(features(spark, sf), 2, None)


@query(
    "WITH f AS (SELECT p_partkey AS id, p_size AS s, p_retailprice AS v, p_brand = 'Brand#13' AS c FROM part), r AS (SELECT a.id AS case_id, b.id AS control_id, "
    "row_number() OVER (PARTITION BY a.id ORDER BY abs(b.v - a.v), b.id) AS rank FROM f a JOIN f b ON a.s = b.s WHERE a.c AND NOT b.c) SELECT * FROM r WHERE rank <= 2"
)
def matched_controls_nearest(spark, sf):
    return cohort.matched_nearest(features(spark, sf), 2)


@query(
    "WITH RECURSIVE "
    + EXPR
    + ", f AS (SELECT gene AS id, any_value(global_mean) AS v, any_value(p_brand) = 'Brand#13' AS is_case FROM gm JOIN part ON p_partkey = gene GROUP BY gene HAVING any_value(global_mean) >= 10), "
    "o AS (SELECT id, row_number() OVER (ORDER BY id) AS turn FROM f WHERE is_case), "
    + greedy("o", "f")
    + ", ch AS (SELECT id AS gene, 1 AS y FROM f WHERE is_case UNION ALL SELECT control_id, 0 FROM mg), own AS (SELECT gm.* FROM gm WHERE gene IN (SELECT gene FROM ch)), "
    + SCORE[len(EXPR) + 2 :].replace("FROM gm ", "FROM own ")
    + " SELECT gene, CASE y WHEN 1 THEN 'AD' ELSE 'control' END AS label, y, round(s, 7) AS integrated_score FROM ch JOIN iscore USING (gene)"
)
def label_table(spark, sf):
    """The whole cohort build: region means, matched controls, integrated scores."""
    cases = table(spark, sf, "part").where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("gene"))
    return cohort.label_table(stash(expression(spark, sf), "expression"), cases, 2, 10.0).withColumn("integrated_score", F.round("integrated_score", 7))


@query(
    "WITH m AS (SELECT upper(trim(split_part(p_name, ' ', 1))) AS gene_symbol, upper(p_type) AS acc, row_number() OVER (PARTITION BY upper(trim(split_part(p_name, ' ', 1))) ORDER BY p_partkey) AS r FROM part), "
    "s AS (SELECT DISTINCT upper(trim(split_part(p_name, ' ', 1))) AS gene_symbol FROM part UNION SELECT upper(n_name) FROM nation) SELECT s.gene_symbol, string_split(trim(regexp_replace(acc, '[|;,\\s]+', ' ', 'g')), ' ')[1] AS uniprot_accession FROM s LEFT JOIN m ON m.gene_symbol = s.gene_symbol AND r = 1"
)
def crosswalk_left_join(spark, sf):
    p = table(spark, sf, "part").withColumn("symbol", F.split("p_name", " ")[0])
    wanted = p.select(text.normal_id(F.col("symbol")).alias("gene_symbol")).union(table(spark, sf, "nation").select(F.upper("n_name")))
    return cohort.crosswalk(wanted, p, "symbol", "p_type", "p_partkey")


@query(r"SELECT p_partkey, nullif(upper(string_split(trim(regexp_replace(p_type || '; ' || p_name, '[|;,\s]+', ' ', 'g')), ' ')[1]), '') AS accession FROM part")
def first_accession(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.first_accession(F.concat_ws("; ", "p_type", "p_name")).alias("accession"))


@query(r"SELECT c_custkey, nullif(regexp_extract(c_name, 'Customer#0*(\d+)', 1), '') AS k FROM customer UNION ALL SELECT page_id, nullif(upper(regexp_extract(url, '/([a-z]+)/\d+', 1)), '') FROM pages")
def regex_key_extract(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", text.accession_of_name(F.col("c_name"), r"Customer#0*(\d+)").alias("k"))
    return a.union(table(spark, sf, "pages").select("page_id", text.accession_of_name(F.col("url"), r"/([a-z]+)/\d+")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def dedup_keep_first(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordered.keep_first(o, ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"WITH {G} SELECT node, y FROM lab WHERE node IN (SELECT u FROM adj)")
def semi_join_nodes(spark, sf):
    return labels(spark, sf).join(graph.adjacency(edges(spark, sf)).select(F.col("u").alias("node")), "node", "left_semi")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE label <= 2)")
def anti_join_candidates(spark, sf):
    pos = table(spark, sf, "embeddings").where("label <= 2").select(F.col("vec_id").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").join(pos, "p_partkey", "left_anti")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT vec_id FROM embeddings")
def set_intersect(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf, "embeddings").select("vec_id"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice >= 300000")
def set_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf, "orders").where("o_totalprice >= 300000").select("o_custkey").distinct())


@query("WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), k AS (SELECT c_custkey, CASE WHEN n > 0 THEN n END AS n FROM c) SELECT c_custkey, coalesce(n, (SELECT median(n) FROM k))::DOUBLE AS n FROM k")
def fill_median(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    k = stash(table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left"), "counts")
    (median,) = ordered.quantiles(k, "n", [0.5])
    return k.select("c_custkey", F.coalesce(F.col("n").cast("double"), F.lit(median)).alias("n"))


@query("SELECT l_orderkey, arg_min(l_returnflag, l_linenumber || l_returnflag) AS first_flag, round(avg(l_quantity), 9) AS mean_quantity FROM lineitem GROUP BY l_orderkey")
def group_first_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("first_flag"), F.round(F.avg("l_quantity"), 9).alias("mean_quantity"))


@query("SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS line_numbers FROM lineitem GROUP BY l_orderkey")
def group_collect_list(spark, sf):
    lines = F.array_sort(F.collect_list("l_linenumber")).cast("array<string>")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(lines, ",").alias("line_numbers"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def group_nunique_mean(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT event_type, round(stddev_pop(value), 6) AS pop, round(stddev_samp(value), 6) AS samp FROM events GROUP BY event_type")
def std_pop_samp(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.stddev_pop("value"), 6).alias("pop"), F.round(F.stddev_samp("value"), 6).alias("samp"))


@query("SELECT label, count(*) FILTER (embedding[1] > 0) AS n_pos, count(*) AS n FROM embeddings GROUP BY label")
def count_if_by_group(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count_if(F.col("embedding")[0] > 0).alias("n_pos"), F.count(F.lit(1)).alias("n"))


RANKED = "SELECT value AS s, (event_type = 'purchase')::INT AS y, event_id FROM events"


def scored(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("value").alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"), "event_id")


@query(f"WITH r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM ({RANKED})) SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auroc FROM r")
def auroc(spark, sf):
    return ordered.auroc(scored(spark, sf), "s", "y").select(F.round("auroc", 9).alias("auroc"))


@query(
    f"WITH r AS (SELECT y, sum(y) OVER w AS tp, count(*) OVER w AS k FROM ({RANKED}) WINDOW w AS (ORDER BY s DESC, event_id ROWS UNBOUNDED PRECEDING)), "
    "p AS (SELECT tp, k, y, tp / k AS prec, lag(tp / k, 1, 1) OVER (ORDER BY k) AS prev FROM r) SELECT round(sum((prec + prev) / 2) FILTER (y = 1) / (SELECT sum(y) FROM r), 9) AS auprc FROM p"
)
def auprc(spark, sf):
    return ordered.auprc(scored(spark, sf), "s", "y", "event_id").select(F.round("auprc", 9).alias("auprc"))


@query("SELECT round(avg(((n_chars >= 1000)::INT = quality)::INT), 9) AS accuracy FROM labels JOIN documents USING (doc_id)")
def accuracy_at_half(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.agg(F.round(F.avg((((F.col("n_chars") / 2000 >= 0.5).cast("int")) == F.col("quality")).cast("int")), 9).alias("accuracy"))


@query("WITH t AS (SELECT quality AS y, 1 / (1 + exp(-greatest(-40, least(40, ln(n_chars + 1.0) - 6)))) AS p FROM labels JOIN documents USING (doc_id)) SELECT round(-avg(y * ln(p + 1e-12) + (1 - y) * ln(1 - p + 1e-12)), 8) AS loss FROM t")
def bce_loss(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    p = text.sigmoid(F.log(F.col("n_chars") + 1.0) - 6)
    return j.agg(F.round(F.avg(models.bce(p, F.col("quality"))), 8).alias("loss"))


SPLIT = E + """, sd AS (SELECT unnest([42, 43]) AS seed), sr AS (SELECT seed, id::VARCHAR AS node, y, row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed || ':' || id), id::VARCHAR) AS k, count(*) OVER (PARTITION BY seed, y) AS n FROM e, sd),
sp AS (SELECT seed, node, y, k <= greatest(1, round_even(n * 0.2, 0)) AS is_test FROM sr)"""


@query(f"WITH {SPLIT} SELECT seed, node, y, is_test FROM sp")
def stratified_split(spark, sf):
    return models.split(labels(spark, sf), SEEDS)


@query(f"WITH {SPLIT} SELECT seed, node FROM sp WHERE is_test AND node::INT IN (SELECT l_partkey FROM lineitem)")
def split_reuse(spark, sf):
    """A kept split, restricted to the nodes at hand: made at the first call, read back at the second."""
    kept = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    kept_split(kept, "default", labels(spark, sf), SEEDS)
    here = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("node")).distinct()
    again = kept_split(kept, "default", labels(spark, sf).join(here, "node", "left_semi"), SEEDS)
    if kept.made != len(SEEDS):
        raise RuntimeError("a kept split was made again")
    return again.where("is_test").select("seed", "node")


def run_probe(spark, sf, ablations, model) -> DataFrame:
    lab = emb(spark, sf).select(F.col("id").alias("node"), "y")
    return models.probe(emb(spark, sf).select("id", "v"), lab, PROBE_SEEDS, ablations, model, EPOCHS, RATE, L2)


@query()
def logistic_probe(spark, sf):
    return run_probe(spark, sf, ("embedding",), models.Logistic())


@query()
def ffn_probe(spark, sf):
    return run_probe(spark, sf, ("embedding",), models.FeedForward())


@query()
def ablation_compare(spark, sf):
    return run_probe(spark, sf, models.ABLATIONS, models.Logistic())


@query()
def probe_multi_seed(spark, sf):
    p = run_probe(spark, sf, ("embedding", "random_embedding"), models.Logistic())
    names = ["test_accuracy", "test_auroc", "test_auprc"]
    return p.groupBy("ablation").agg(*[F.avg(n).alias(f"mean_{n}") for n in names], *[F.stddev_samp(n).alias(f"std_{n}") for n in names])


@query()
def loss_history(spark, sf):
    """Losses after each epoch."""
    lab = emb(spark, sf).select(F.col("id").alias("node"), "y")
    runs = stash(models.scaled(models.runs_of(emb(spark, sf).select("id", "v"), models.split(lab, PROBE_SEEDS), ("embedding",))), "runs")
    return models.loss_history(runs, models.FeedForward(), EPOCHS, 1, RATE, L2)


MATRIX = """SELECT cohort, ablation, b.baseline AS baseline, replicate::INT AS replicate, seed FROM (SELECT r_name AS cohort FROM region), (SELECT unnest(['embedding', 'random_embedding', 'label_shuffle']) AS ablation),
(VALUES ('observed_ad', 1), ('permute_labels', 20), ('random_matched_set', 20)) b(baseline, n), range(0, 20) r(replicate), (SELECT unnest([42, 43, 44, 45, 46, 47, 48, 49, 50, 51])::INT AS seed) WHERE replicate < n"""


def runs(spark, sf) -> DataFrame:
    """The matrix of a cohort for each region."""
    cohorts = sorted(r["r_name"] for r in table(spark, sf, "region").select("r_name").distinct().collect())  # a configuration's
    return experiment.matrix(spark, cohorts, ["embedding", "random_embedding", "label_shuffle"], [("observed_ad", 5), ("permute_labels", 20), ("random_matched_set", 20)], list(range(42, 52)))


@query(MATRIX)
def experiment_matrix(spark, sf):
    return runs(spark, sf)


@query(f"SELECT *, substr(sha256(cohort || '|' || ablation || '|' || baseline || '|' || replicate || '|' || seed), 1, 12) AS run_id FROM ({MATRIX})")
def run_ids(spark, sf):
    return experiment.run_id(runs(spark, sf))


@query(
    "SELECT n_nationkey, n_name, n_regionkey, substr(sha256(concat('{\"n_name\": \"', n_name, '\", \"n_nationkey\": ', n_nationkey, ', \"n_regionkey\": ', n_regionkey, '}')), 1, 12) AS run_id FROM nation"
)
def signature_ids(spark, sf):
    return experiment.signature_id(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query(f"SELECT DISTINCT cohort, baseline, replicate, seed FROM ({MATRIX})")
def distinct_label_sets(spark, sf):
    return experiment.label_sets(runs(spark, sf))


@query(f"WITH {G}, h AS (SELECT node, y, md5('4200001:0:' || node) AS h FROM lab), a AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM h), b AS (SELECT y, row_number() OVER (ORDER BY h, node) AS k FROM h) SELECT node, y FROM a JOIN b USING (k)")
def baseline_labels_permute(spark, sf):
    return experiment.permuted(labels(spark, sf), 42, 1)


@query(f"WITH {G} SELECT node, (row_number() OVER (ORDER BY md5('4200001:' || node), node) <= (SELECT sum(y) FROM lab))::INT AS y FROM lab")
def baseline_random_set(spark, sf):
    return experiment.random_set(labels(spark, sf), 42, 1)


@query(
    f"WITH {G}, c AS (SELECT l_partkey::VARCHAR AS node, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT node, y, coalesce(n, (SELECT median(c.n) FROM lab JOIN c USING (node)))::DOUBLE AS degree FROM lab LEFT JOIN c USING (node)), "
    "q AS (SELECT least(10, greatest(2, count(DISTINCT degree))) AS q FROM k), ed AS (SELECT list_sort(list_distinct(quantile_cont(degree, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS x FROM k), "
    "bb AS (SELECT node, y, len(list_filter(x[2:len(x) - 1], lambda t: t < degree)) AS bin FROM k, ed), r AS (SELECT node, row_number() OVER (PARTITION BY bin ORDER BY md5('4200001:' || node), node) AS r, sum(y) OVER (PARTITION BY bin) AS want FROM bb) SELECT node, (r <= want)::INT AS y FROM r"
)
def baseline_bias_matched(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("node")).agg(F.count(F.lit(1)).alias("annotation_count"))
    return experiment.bias_matched_set(labels(spark, sf), counts, 42, 1)


@query("SELECT event_type AS baseline, count(*) AS n_runs, round(avg(value), 6) AS mean_auroc, round(avg(value / 2), 6) AS mean_auprc, round(avg((value >= 50)::INT), 6) AS mean_acc FROM events GROUP BY event_type")
def sort_desc_rollup(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("baseline"), F.col("value").alias("auroc"), (F.col("value") / 2).alias("auprc"), (F.col("value") >= 50).cast("int").alias("accuracy"))
    r = experiment.roll_up(e).withColumns({c: F.round(c, 6) for c in ("mean_auroc", "mean_auprc", "mean_acc")})
    return r.orderBy(F.col("mean_auroc").desc())


@query(
    "SELECT event_type AS run, round(avg(value) FILTER (user_id % 2 = 0), 6) AS hops_m_k0_delta, round(avg(value) FILTER (user_id % 2 = 1), 6) AS hops_m_k1_delta, count(*) FILTER (user_id % 2 = 0)::DOUBLE AS hops_m_k0_pvalue_right, "
    "count(*) FILTER (user_id % 2 = 1)::DOUBLE AS hops_m_k1_pvalue_right FROM events GROUP BY event_type"
)
def summary_pivot(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 2).alias("k"))
    s = e.agg(F.round(F.avg("value"), 6).alias("delta"), F.count(F.lit(1)).cast("double").alias("pvalue_right")).withColumn("metric", F.lit("m"))
    return experiment.wide_hops(s, "run")


@query()
def file_manifest(spark, sf):
    return experiment.file_manifest(spark, [f"{sf}/nation.parquet", f"{sf}/region.parquet"]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "size", "sha256")


@query("SELECT DISTINCT upper(trim(split_part(p_name, ' ', 1))) AS gene_symbol FROM part WHERE p_size % 5 > 0")
def gene_set(spark, sf):
    """Distinct symbols, some rows being empty or missing."""
    word = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit(" "), F.split("p_name", " ")[0])).when(F.col("p_size") % 2 > 0, F.lit("  "))
    return cohort.gene_set(table(spark, sf, "part").select(word.alias("symbol")), "symbol")


@query("SELECT event_id, greatest(value - 50, 0) AS x FROM events")
def relu_values(spark, sf):
    return table(spark, sf, "events").select("event_id", text.relu(F.col("value") - 50).alias("x"))


@query(r"SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem FROM pages WHERE url IS NOT NULL")
def path_parts(spark, sf):
    p = table(spark, sf, "pages").where("url is not null")
    return p.select("page_id", text.file_name(F.col("url")).alias("name"), text.file_stem(F.col("url")).alias("stem"))


@query(f"WITH {G} SELECT y, row_number() OVER (PARTITION BY y ORDER BY node) AS rank, node FROM lab")
def nodes_by_class(spark, sf):
    return graph.nodes_by_class(labels(spark, sf))


SCORE3 = SCORE.replace("avg(0.7 * ze + 0.3 * zs)", "avg(0.4 * ze + 0.3 * zs)")


@query(
    f"WITH {SCORE3}, net AS (SELECT l_partkey AS gene, count(*)::DOUBLE AS v FROM lineitem WHERE l_partkey IN (SELECT gene FROM iscore) AND l_partkey % 7 > 0 GROUP BY 1), "
    "nz AS (SELECT gene, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM net) SELECT gene, round(s + 0.3 * coalesce(z, 0), 7) AS integrated_score FROM iscore LEFT JOIN nz USING (gene)"
)
def integrated_score_network(spark, sf):
    """The score of three terms; a seventh of the genes has no place in the network."""
    net = table(spark, sf, "lineitem").where("l_partkey % 7 > 0").groupBy(F.col("l_partkey").alias("gene")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return cohort.integrated_scores(expression(spark, sf), net).select("gene", F.round("integrated_score", 7).alias("integrated_score"))


COVER = 20


@query(
    "WITH RECURSIVE pr AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS i FROM lineitem WHERE l_quantity >= 30 AND l_discount <= 0.05), "
    "pick(rank, candidate, gain, own) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, []::BIGINT[] UNION ALL "
    "SELECT p.rank + 1, b.c, b.n, list_concat(p.own, b.items) FROM pick p, LATERAL (SELECT c, count(*) AS n, list(i) AS items FROM pr WHERE NOT list_contains(p.own, i) GROUP BY c ORDER BY n DESC, c LIMIT 1) b "
    f"WHERE p.rank < {COVER}) SELECT rank, candidate, gain, len(own)::BIGINT AS covered FROM pick WHERE rank > 0"
)
def coverage_ranking(spark, sf):
    """The suppliers that cover most parts, with items of a large quantity and small discount."""
    li = table(spark, sf, "lineitem").where("l_quantity >= 30 and l_discount <= 0.05")
    return coverage.coverage(li.select(F.col("l_suppkey").alias("candidate"), F.col("l_partkey").alias("item")), COVER)
