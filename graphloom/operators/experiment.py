"""Experiment matrix, baseline labels, run identifiers, manifests and roll-ups."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_order
from .ordered import qcut, quantiles, running, running_sums
from .permute import shuffle


#: The baseline that draws from bins of annotation counts.
ANNOTATED = "random_matched_set_plus_bias"


def matrix(spark: SparkSession, cohorts: list[str], ablations: list[str], baselines: list[tuple[str, int]], seeds: list[int]) -> DataFrame:
    """(cohort, ablation, baseline, replicate, seed): every combination; observed_ad has one replicate."""
    rows = spark.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in cohorts])).alias("cohort"),
    )
    rows = rows.withColumn("ablation", F.explode(F.array(*[F.lit(a) for a in ablations])))
    rows = rows.withColumn("b", F.explode(F.array(*[F.struct(F.lit(b).alias("baseline"), F.lit(1 if b == "observed_ad" else n).alias("n")) for b, n in baselines])))
    rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.col("b.n") - 1))).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return rows.select("cohort", "ablation", "b.baseline", "replicate", "seed")


def label_sets(runs: DataFrame) -> DataFrame:
    """The distinct label sets of a matrix: graph and hop metrics don't depend on the ablation, so they are needed once for each."""
    return runs.select("cohort", "baseline", "replicate", "seed").distinct()


def seed_of(seed: int, replicate: int) -> int:
    return seed * 100_000 + replicate


def permuted(labels: DataFrame, seed: int, replicate: int) -> DataFrame:
    return shuffle(labels, 1, seed_of(seed, replicate)).select("node", "y")


def random_set(labels: DataFrame, seed: int, replicate: int) -> DataFrame:
    """(node, y): as many positives as observed, drawn from all nodes."""
    n = labels.agg(F.sum("y")).first()[0] or 0
    rows = labels.select("node", hash_order(F.lit(seed_of(seed, replicate)), F.col("node")).alias("h"))
    return running_sums(rows, [F.col("h"), F.col("node")], {"k": F.lit(1)}).select("node", (F.col("k") <= n).cast("int").alias("y"))


def bias_matched_set(labels: DataFrame, counts: DataFrame, seed: int, replicate: int, bins: int = 10) -> DataFrame:
    """(node, y): from each bin of annotation counts as many nodes as it has positives. Unknown counts take the median."""
    known = labels.join(counts, "node", "left")
    (median,) = quantiles(known, "annotation_count", [0.5])
    binned = qcut(known.withColumn("annotation_count", F.coalesce("annotation_count", F.lit(median))), "annotation_count", bins)
    want = binned.groupBy("bin").agg(F.sum("y").alias("want"))
    rows = binned.select("bin", "node", hash_order(F.lit(seed_of(seed, replicate)), F.col("node")).alias("h"))
    k = running_sums(rows, [F.col("bin"), F.col("h"), F.col("node")], {"k": F.lit(1)})
    first = k.groupBy("bin").agg((F.min("k") - 1).alias("base"))
    wide = k.join(F.broadcast(first), "bin").join(F.broadcast(want), "bin")  # a row for each bin
    return wide.select("node", (F.col("k") - F.col("base") <= F.col("want")).cast("int").alias("y"))


def baseline_labels(labels: DataFrame, baseline: str, seed: int, replicate: int, counts: DataFrame | None = None) -> DataFrame:
    """(node, y, label, fallback_used): labels of one entry of the matrix. Without annotation counts the matched set is a random one, which fallback_used tells."""
    fallback = baseline == ANNOTATED and counts is None
    if baseline == "observed_ad":
        out = labels.select("node", "y")
    elif baseline == "permute_labels":
        out = permuted(labels, seed, replicate)
    elif baseline == "random_matched_set" or fallback:
        out = random_set(labels, seed, replicate)
    elif baseline == ANNOTATED:
        out = bias_matched_set(labels, counts, seed, replicate)
    else:
        raise ValueError(f"no baseline {baseline}")
    return out.select("node", "y", F.when(F.col("y") == 1, "AD").otherwise("control").alias("label"), F.lit(fallback).alias("fallback_used"))


def summary_rows(entries: DataFrame, probes: DataFrame, graph: DataFrame, significance: DataFrame, key: str = "run_id") -> DataFrame:
    """One row for each entry of the matrix: its probe's test scores, graph metrics and hop deltas with p-values; nulls where a part is missing."""
    scores = probes.select(key, *[F.col(f"test_{c}").alias(f"probe_test_{c}") for c in ("accuracy", "auroc", "auprc")])
    names = {"enrichment": "ad_ad_edge_enrichment", "mean_ad_neighbor_fraction": "mean_ad_neighbor_fraction", "lcc": "ad_lcc_size", "mean_ad_shortest_path": "mean_ad_shortest_path"}
    topology = graph.select(key, *[F.col(c).cast("double").alias(f"ppi_{n}") for c, n in names.items()])
    return entries.join(scores, key, "left").join(topology, key, "left").join(wide_hops(significance, key), key, "left")


def stable_hash(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:12]


def run_id(runs: DataFrame) -> DataFrame:
    """Add run_id: the first 12 digits of a hash of the row."""
    return runs.withColumn("run_id", F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in runs.columns]), 256), 1, 12))


def canonical(columns: list[str]) -> Column:
    """The row's columns as JSON with sorted names and the separators of ``json.dumps``, of which ``stable_hash`` is the hash; texts of ASCII."""
    parts = [F.concat(F.lit(json.dumps(c) + ": "), F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", "")) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def signature_id(runs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add run_id: ``stable_hash`` of each row as a dictionary of its columns."""
    return runs.withColumn("run_id", F.substring(F.sha2(canonical(columns or runs.columns), 256), 1, 12))


def wide_hops(significance: DataFrame, key: str) -> DataFrame:
    """One row for each key: hops_<metric>_k<k>_delta and _pvalue_right."""
    name = lambda end: F.concat(F.lit("hops_"), "metric", F.lit("_k"), F.col("k").cast("string"), F.lit(end))
    cells = significance.select(key, F.explode(F.array(F.struct(name("_delta").alias("n"), F.col("delta").alias("x")), F.struct(name("_pvalue_right").alias("n"), F.col("pvalue_right").alias("x")))).alias("c"))
    return cells.groupBy(key).pivot("c.n").agg(F.first("c.x"))


def roll_up(summary: DataFrame, key: str = "baseline") -> DataFrame:
    return summary.groupBy(key).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("auroc").alias("mean_auroc"), F.avg("auprc").alias("mean_auprc"), F.avg("accuracy").alias("mean_acc"))


def file_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, modified, sha256) of files in any store that Spark reads."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), F.sha2("content", 256).alias("sha256"))


#: Bytes of a file that one task hashes as a whole, and lines of a larger one that are hashed together.
WHOLE, LINES = 256 << 20, 4096


def content_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, modified, sha256) as ``file_manifest``, but of a file beyond WHOLE bytes the hash is one over hashes, since a plain one is read by one task.

    Such a file is read in splits, as bytes between line feeds. Each line has a hash, each LINES lines in a row have one over theirs, and the file has one over
    those and its size; so it hangs on the content and its order, not on the splits.
    """
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias("modified")
    files = spark.read.format("binaryFile").load(paths)  # contents are read only where asked for
    large = [r["path"] for r in files.where(F.col("length") > WHOLE).select("path").collect()]
    out = files.where(F.col("length") <= WHOLE).select("path", F.col("length").alias("size"), time("modificationTime"), F.sha2("content", 256).alias("sha256"))
    if not large:
        return out
    meta = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), time("_metadata.file_modification_time"))
    lines = spark.read.option("lineSep", "\n").text(large).select(meta.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.sha2(F.col("value").cast("binary"), 256).alias("h"))
    lines = running(lines.select("file.*", "start", "at", "h"), [F.col("start"), F.col("at")], {"k": ("sum", F.lit(1))}, ["path"])
    joined = lambda key, h: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, h))), lambda x: x[h]), ""), 256).alias("h")
    groups = lines.groupBy("path", "size", "modified", F.floor((F.col("k") - 1) / LINES).alias("g")).agg(joined("k", "h"))
    whole = groups.groupBy("path", "size", "modified").agg(joined("g", "h"))  # a row for each LINES lines
    return out.unionByName(whole.select("path", "size", "modified", F.sha2(F.concat_ws(":", "size", "h"), 256).alias("sha256")))
