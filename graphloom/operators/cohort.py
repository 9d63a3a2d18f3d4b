"""Cohorts: region expression, integrated scores, matched controls, crosswalks and the label table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import accession_of_name, first_accession, is_positive, nan_to_null, normal_id
from ..sources.tables import require_rows
from .matching import matched
from .ordered import keep_first, zscore
from .vectors import mean_vectors


def gene_set(genes: DataFrame, column: str) -> DataFrame:
    """(gene_symbol): trimmed, upper-cased, distinct, not empty."""
    return genes.select(normal_id(F.col(column)).alias("gene_symbol")).where("gene_symbol <> ''").distinct()


def region_expression(samples: DataFrame) -> DataFrame:
    """(gene, region, expr, global_mean): mean of a gene's samples in each region; the mean of its region means, equally weighted.
    It is an error if no sample has a region."""
    per = require_rows(samples.where("region is not null"), "sample has a region").groupBy("gene", "region").agg(F.avg(F.nanvl("tpm", F.lit(None).cast("double"))).alias("expr"))
    return per.withColumn("global_mean", F.avg("expr").over(Window.partitionBy("gene")))  # a gene has a row per region


def integrated_scores(regions: DataFrame, network: DataFrame | None = None) -> DataFrame:
    """(gene, integrated_score): 0.7 of the z-score of expression and 0.3 of that of specificity, by region, averaged over regions.

    Specificity is expression less the mean of the gene's other regions; with a single region it is unknown, and its z-score 0.
    With ``network`` (gene, value) it is 0.4 and 0.3, and 0.3 of the z-score of the value over the genes that have one; that of the others is 0.
    """
    g = Window.partitionBy("gene")
    n = F.count("expr").over(g)
    spec = F.when(n > 1, F.col("expr") - (F.sum("expr").over(g) - F.col("expr")) / (n - 1))
    z = zscore(zscore(regions.withColumn("spec", spec), "expr", "z_expr", ["region"]), "spec", "z_spec", ["region"])
    expr, other = F.col("z_expr"), F.coalesce("z_spec", F.lit(0.0))
    if network is None:
        return z.groupBy("gene").agg(F.avg(0.7 * expr + 0.3 * other).alias("integrated_score"))
    own = z.groupBy("gene").agg(F.avg(0.4 * expr + 0.3 * other).alias("own"))
    known = zscore(network.where("value is not null").join(own.select("gene"), "gene", "left_semi"), "value", "z")
    return own.join(known.select("gene", "z"), "gene", "left").select("gene", (F.col("own") + 0.3 * F.coalesce("z", F.lit(0.0))).alias("integrated_score"))


def matched_greedy(features: DataFrame, per_case: int, stratum: str | None = "stratum") -> DataFrame:
    """(case_id, control_id, rank): cases in the order of their ids take their ``per_case`` nearest controls by ``value`` that no case before took; equal
    distances go by id. ``features``: (id, value, is_case), and a stratum if cases and controls have to agree in one (None: they need not)."""
    return matched(features, per_case, stratum)


def matched_nearest(features: DataFrame, per_case: int, stratum: str | None = "stratum") -> DataFrame:
    """As ``matched_greedy``, but a control may serve several cases."""
    return matched(features, per_case, stratum, again=True)


def crosswalk(symbols: DataFrame, mapping: DataFrame, symbol: str, accessions: str, order: str) -> DataFrame:
    """(gene_symbol, uniprot_accession): the first accession of the first row of each symbol; null for symbols without one."""
    own = mapping.select(normal_id(F.col(symbol)).alias("gene_symbol"), first_accession(F.col(accessions)).alias("uniprot_accession"), F.col(order).alias("o"))
    own = keep_first(own.where("gene_symbol is not null"), ["gene_symbol"], [F.col("o")]).drop("o")
    return symbols.select("gene_symbol").distinct().join(own, "gene_symbol", "left")


def label_table(regions: DataFrame, cases: DataFrame, per_case: int, least_mean: float, ids: DataFrame | None = None) -> DataFrame:
    """(gene, label, y, integrated_score) of cases and their matched controls, of all genes of a mean of at least ``least_mean``. ``regions``: ``region_expression``;
    ``cases``: (gene). It is an error if none of them is among those genes. With ``ids`` (gene, gene_id), the smallest gene_id of each gene is in front."""
    genes = regions.groupBy("gene").agg(F.first("global_mean").alias("value")).where(F.col("value") >= least_mean)
    marked = genes.join(cases.withColumn("is_case", F.lit(1)), "gene", "left").withColumn("is_case", F.coalesce("is_case", F.lit(0)))
    if marked.where("is_case = 1").isEmpty():
        raise ValueError("none of the cases has an expression of the least mean")
    controls = matched_greedy(marked.withColumnRenamed("gene", "id"), per_case, None).select(F.col("control_id").alias("gene"), F.lit(0).alias("y")).distinct()
    chosen = marked.where("is_case = 1").select("gene", F.lit(1).alias("y")).union(controls)
    scores = integrated_scores(regions.join(chosen, "gene", "left_semi"))
    out = chosen.join(scores, "gene").select("gene", F.when(F.col("y") == 1, "AD").otherwise("control").alias("label"), "y", "integrated_score")
    if ids is None:
        return out
    return out.join(ids.groupBy("gene").agg(F.min("gene_id").alias("gene_id")), "gene", "left").select("gene_id", *out.columns)


def label_schema(labels: DataFrame) -> DataFrame:
    """``labels`` without gene_id, and y as a whole number; null where it isn't a number."""
    out = labels.drop("gene_id")
    return out.withColumn("y", F.col("y").cast("string").try_cast("double").try_cast("int")) if "y" in out.columns else out


def annotation_counts(counts: DataFrame, order: str) -> DataFrame:
    """(gene_symbol, annotation_count): of each symbol the first row, by ``order``, whose count is a number."""
    own = counts.select(normal_id(F.col("gene_symbol")).alias("gene_symbol"), nan_to_null(F.col("annotation_count").cast("string").try_cast("double")).alias("annotation_count"), F.col(order).alias("o"))
    return keep_first(own.where("annotation_count is not null"), ["gene_symbol"], [F.col("o")]).select("gene_symbol", "annotation_count")


def _mapped(mapping: DataFrame, order: str) -> DataFrame:
    return mapping.select(normal_id(F.col("gene_symbol")).alias("gene_symbol"), normal_id(F.col("uniprot_accession")).alias("uniprot_accession"), F.col(order).alias("__m"))


def node_labels(labels: DataFrame, mapping: DataFrame | None = None, order: str = "pos") -> DataFrame:
    """(gene_symbol, y, node): nodes are gene symbols, or with a ``mapping`` the accessions of each symbol. Of rows of one node the first by ``order`` stays,
    a column of both tables. Symbols without an accession go."""
    own = labels.select(normal_id(F.col("gene_symbol")).alias("gene_symbol"), F.col("y").cast("int").alias("y"), F.col(order).alias("__l"))
    if mapping is None:
        nodes = own.select("*", F.col("gene_symbol").alias("node"), F.lit(0).alias("__m"))
    else:
        known = _mapped(mapping, order).where("uniprot_accession <> ''").groupBy("gene_symbol", "uniprot_accession").agg(F.min("__m").alias("__m"))
        first = keep_first(own, ["gene_symbol"], [F.col("__l")])  # a symbol's other rows can't be a node's first, so the join needn't repeat them
        nodes = first.select("gene_symbol", "y", "__l").join(known, "gene_symbol").withColumnRenamed("uniprot_accession", "node")
    return keep_first(nodes, ["node"], [F.col("__l"), F.col("__m")]).select("gene_symbol", "y", "node")


def gene_vectors(labels: DataFrame, mapping: DataFrame, vectors: DataFrame, order: str = "pos") -> DataFrame:
    """(gene_symbol, label, y, uniprot_accession, v): the mean of the vectors of all of a gene's accessions.

    ``labels`` (gene_symbol, label), of which a symbol's first row counts, and ``mapping`` (gene_symbol, uniprot_accession) have an ``order``; ``vectors``
    (name, v) name their accessions. The accession shown is the first that has a vector. Genes without a vector go; if all do, it is an error.
    """
    own = keep_first(labels.select(normal_id(F.col("gene_symbol")).alias("gene_symbol"), "label", F.col(order).alias("o")), ["gene_symbol"], [F.col("o")])
    own = own.select("gene_symbol", "label", F.coalesce(is_positive(F.col("label")), F.lit(0)).alias("y"))
    named = vectors.select(accession_of_name(F.col("name")).alias("uniprot_accession"), "v")
    rows = own.join(_mapped(mapping, order), "gene_symbol").join(named, "uniprot_accession")
    if rows.isEmpty():
        raise ValueError("no gene has an accession with a vector")
    first = rows.groupBy("gene_symbol").agg(F.first("label").alias("label"), F.first("y").alias("y"), F.min_by("uniprot_accession", F.struct("__m", "uniprot_accession")).alias("uniprot_accession"))
    return first.join(mean_vectors(rows, "gene_symbol"), "gene_symbol")
