"""Readers with explicit schemas, checks of their columns, and writers."""

from __future__ import annotations

import csv
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import na_to_null
from .npy import BYTES, headers, read_named, read_npy


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean(df: DataFrame) -> DataFrame:
    """Texts that stand for missing values become null."""
    return df.withColumns({f.name: na_to_null(F.col(f.name)) for f in df.schema if f.dataType.simpleString() == "string"})


def read_text_table(spark: SparkSession, path: str, schema: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """A file with a header line. ``schema`` names the file's columns in any order; others are ignored. Gzip is told by the suffix."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    want = spark.createDataFrame([], schema).schema
    require_columns(raw, want.names)
    out = clean(raw.select(*want.names))
    out = out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])
    return out.select(*columns) if columns else out


def read_wide(spark: SparkSession, path: str, names: list[str], key: str = "gene_symbol") -> DataFrame:
    """A headerless matrix, a row for each key and a column for each of ``names``, as (key, sample_name, tpm). Cells may be quoted; cells that are no numbers
    are null. The width of the first row is checked at once, that of the others when they are read; a row of another width is an error."""
    first = spark.read.text(path).first()
    if first is not None and len(next(csv.reader([first[0]]))) != len(names) + 1:
        raise ValueError(f"expected {len(names) + 1} columns")
    columns = [f"c{k}" for k in range(len(names) + 1)]
    rows = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("mode", "FAILFAST").option("escape", '"').csv(path)
    # All columns are asked for, as widths are only checked of rows that are parsed whole.
    cells = rows.select(F.trim("c0").alias(key), F.posexplode(F.array(*columns[1:])).alias("pos", "tpm"))
    samples = F.array(*[F.lit(n) for n in names])
    return cells.select(key, F.get(samples, F.col("pos")).alias("sample_name"), F.col("tpm").try_cast("double").alias("tpm"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge table: tabs for .tsv and .txt (and .gz of them), else the delimiter that the header line shows. All columns are text."""
    stem = path.removesuffix(".gz")
    sep = "\t"
    if not stem.endswith((".tsv", ".txt")):
        head = spark.read.text(path).first()
        sep = csv.Sniffer().sniff(head[0], delimiters=",;\t |").delimiter if head else ","
    out = clean(spark.read.option("header", True).option("sep", sep).csv(path))
    return out.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else out  # one task reads a compressed file


def read_vectors(spark: SparkSession, matrix: str, names: list[str] | str | None = None, rows: int | None = None) -> DataFrame:
    """(row_idx, v, name) from a .npy matrix, by ranges of ``rows``. ``names``: a short list, or the path of a .npy list; without it there is no name."""
    found = headers(matrix)
    most = BYTES if rows is None else rows * max([h.row_bytes for h in found], default=1)
    if isinstance(names, str):
        return read_named(spark, matrix, names, most).select("row_idx", "v", "name")
    out, n = read_npy(spark, matrix, most), sum(h.rows for h in found)
    if names is None:
        return out
    if len(names) != n:
        raise ValueError(f"{len(names)} names for {n} rows")
    return out.join(spark.createDataFrame(list(enumerate(names)), "row_idx long, name string"), "row_idx")


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NaN becomes null, so that any reader can parse them."""
    plain = df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.simpleString() in ("double", "float")})
    plain.write.mode("overwrite").json(path)


def read_config(path: str) -> dict:
    """An experiment's configuration from YAML or JSON, with its guards."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        cfg = json.loads(text)
    else:
        import yaml

        cfg = yaml.safe_load(text)
    for name in ("cohorts", "ablations", "baselines", "seeds"):
        if not cfg.get(name):
            raise ValueError(f"configuration has no {name}")
    return cfg


def _exists(path: str) -> bool:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return os.path.exists(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def missing_inputs(paths: list[str]) -> list[str]:
    """Those of the paths, in any store that Spark reads, where nothing is."""
    return [p for p in paths if not _exists(p)]


def first_existing(paths: list[str]) -> str:
    """The first path where something is; an error that names all of them if nothing is anywhere."""
    for p in paths:
        if _exists(p):
            return p
    raise FileNotFoundError("none of these exists: " + ", ".join(paths))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def snapshot_config(spark: SparkSession, cfg: dict, path: str) -> None:
    """Write a configuration as it was used: JSON, which YAML readers take too, in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(bytearray((json.dumps(cfg, indent=2) + "\n").encode()))
    finally:
        out.close()


def parse_ints(text: str) -> list[int]:
    """"1,2,5" as sorted distinct numbers; at least one."""
    out = sorted({int(x) for x in text.split(",") if x.strip()})
    if not out:
        raise ValueError("no numbers")
    return out
