"""A keyed store of artefacts: tables that are made once for their keys, and read back from then on.

An artefact lies in a folder of its own, named by its keys, in any store that Spark reads. It is written aside and renamed into its place, so a reader
sees all of it or nothing, and of two writers the first counts. A manifest, one JSON file beside each artefact, says what it was made from.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, models
from ..operators.experiment import stable_hash

MANIFEST = "artefact string, name string, keys string, columns string, n_rows long"


class Store:
    """Artefacts under ``root``. ``made`` counts those that this object had to make."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.made = spark, root.rstrip("/"), 0
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str, keys: dict) -> str:
        """Where an artefact lies: keys in the order of their names, values quoted; so equal keys are equal paths."""
        parts = [f"{k}={quote(json.dumps(keys[k], sort_keys=True), safe='')}" for k in sorted(keys)]
        return "/".join([self.root, quote(name, safe=""), *(parts or ["all"]), "table"])

    def has(self, name: str, keys: dict) -> bool:
        return self._fs.exists(self._path(self.path(name, keys)))

    def get(self, name: str, keys: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The artefact, from the store if it is there; else what ``make`` gives, written first."""
        path = self.path(name, keys)
        if not self._fs.exists(self._path(path)):
            aside = f"{self.root}/_aside/{uuid.uuid4().hex}"
            df = make()
            df.write.parquet(aside)
            rows = self.spark.read.parquet(aside).count()
            self._fs.mkdirs(self._path(path).getParent())
            # A rename onto a folder would move into it, so it is looked at again; another writer of the same keys has written the same rows.
            if not self._fs.exists(self._path(path)) and self._fs.rename(self._path(aside), self._path(path)):
                self.made += 1
                self._note(path, name, keys, df, rows)
            else:
                self._fs.delete(self._path(aside), True)
        return self.spark.read.parquet(path)

    def _note(self, path: str, name: str, keys: dict, df: DataFrame, rows: int) -> None:
        row = {"artefact": stable_hash({"name": name, "keys": keys}), "name": name, "keys": json.dumps(keys, sort_keys=True), "columns": df.schema.simpleString(), "n_rows": rows}
        out = self._fs.create(self._path(f"{self.root}/_manifest/{row['artefact']}.json"), True)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()

    def manifest(self) -> DataFrame:
        """(artefact, name, keys, columns, n_rows), a row for each artefact."""
        if not self._fs.exists(self._path(f"{self.root}/_manifest")):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/_manifest")


def kept_split(store: Store, cohort_name: str, labels: DataFrame, seeds: list[int], share: float = 0.2) -> DataFrame:
    """(seed, node, y, is_test): the split of each seed as it was first made for the cohort and share, restricted to the nodes at hand.

    A split is made for each seed that has none; labels that came later have no place in a kept split, and are left out.
    """
    out = None
    for seed in seeds:
        own = store.get("split", {"cohort": cohort_name, "seed": seed, "share": share}, lambda seed=seed: models.split(labels, [seed], share))
        out = own if out is None else out.unionByName(own)
    return out.join(labels.select("node").distinct(), "node", "left_semi").select("seed", "node", "y", "is_test")


def cohort_tables(store: Store, settings: dict, regions: DataFrame, cases: DataFrame, mapping: DataFrame, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The inputs that all runs of a cohort share: labels, the accessions of its genes, and annotation counts; made once for its settings.

    ``settings``: name, controls_per_ad, min_global_expression. ``regions``: ``cohort.region_expression``; ``cases``: (gene); ``mapping``: (symbol, accessions,
    pos); ``counts``: (gene_symbol, annotation_count, pos), or none, which gives an empty table.
    """
    keys = {k: settings[k] for k in ("name", "controls_per_ad", "min_global_expression")}
    labels = store.get("labels", keys, lambda: cohort.label_schema(cohort.label_table(regions, cases, keys["controls_per_ad"], keys["min_global_expression"]).withColumn("gene_symbol", F.upper(F.trim(F.col("gene").cast("string"))))))
    symbols = labels.select("gene_symbol")
    known = store.get("mapping", keys, lambda: cohort.crosswalk(symbols, mapping, "symbol", "accessions", "pos"))
    empty = store.spark.createDataFrame([], "gene_symbol string, annotation_count double")
    found = store.get("annotation_counts", keys, lambda: empty if counts is None else cohort.annotation_counts(counts, "pos").join(symbols, "gene_symbol", "left_semi"))
    return {"labels": labels, "mapping": known, "annotation_counts": found}


def run_manifests(entries: DataFrame, settings: dict, dependencies: DataFrame) -> DataFrame:
    """(run_id, entry, settings, inputs): of each run of the matrix, what it was made from. ``entries`` has a run_id; ``dependencies``: (path, size, modified, sha256).

    ``inputs`` is a hash over the files' names and contents in the order of names, so that it doesn't change with the folder or the time of a copy.
    """
    own = dependencies.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256").agg(F.sort_array(F.collect_list(F.struct("name", "sha256"))).alias("files"))  # a row per input file
    digest = own.select(F.sha2(F.to_json("files"), 256).alias("inputs"))
    entry = F.to_json(F.struct(*[c for c in sorted(entries.columns) if c != "run_id"]))
    return entries.select("run_id", entry.alias("entry")).withColumn("settings", F.lit(json.dumps(settings, sort_keys=True))).crossJoin(F.broadcast(digest))  # one row
