"""Exact deduplication by a tree merge of sorted digest runs.

Every document has a digest (SHA-256 of its text after white space is normalised) and belongs to one of ``fan ** levels``
runs. A run holds each text once, with the smallest identifier and the number of rows behind it, and is written in pieces
sorted by digest. In each round, groups of ``fan`` runs exchange their entries lane by lane (a lane is a range of digests, so
that one round's merge is spread over all tasks); the sort within a task is the merge of the pieces that meet in it, and a
scan keeps the smallest identifier of equal entries: after the last round every text has one entry. The answers then
descend the same tree. A text that makes up a third of all rows is never gathered: a
round brings together at most ``fan`` entries of it for every parent run.

Entries count as equal only if digest, length and a second hash agree at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stash, text_or_empty

KEY = ["run", "digest", "length", "check"]
ENTRY = "run long, digest binary, length long, check long, keep_id long, rows long"


def normalised(name: str = "text") -> Column:
    """The text with every stretch of white space turned into one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(name), f"[{SPACE}]+", " ")


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each key of a task's sorted rows; smallest keep_id (nulls last) and sum of rows.

    Only the last, still open entry is carried from batch to batch.
    """
    schema, open_ = None, None

    def heads(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), dtype=bool)
        new[0] = True
        for name in KEY:
            col = t.column(name).combine_chunks()
            new[1:] |= np.asarray(pc.not_equal(col[1:], col[:-1]))
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        t = pa.Table.from_batches([batch])
        if open_ is not None:
            t = pa.concat_tables([open_, t]).combine_chunks()
        at = heads(t)
        rows = np.add.reduceat(t.column("rows").to_numpy(), at)
        merged = t.take(pa.array(at))  # rows of a key are sorted by keep_id, so the first has the smallest
        merged = merged.set_column(merged.schema.get_field_index("rows"), "rows", pa.array(rows, pa.int64()))
        open_ = merged.slice(len(merged) - 1)
        yield from merged.slice(0, len(merged) - 1).cast(schema).to_batches()
    if open_ is not None:
        yield from open_.cast(schema).to_batches()


def _merge_runs(entries: DataFrame, tasks: int) -> DataFrame:
    """Exchange entries by run and lane, merge what meets, keep the smallest identifier of each text."""
    high = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long")
    lanes = F.floor(high * max(16, tasks) / (1 << 24))
    return (
        entries.withColumn("lane", lanes)
        .repartition(tasks, "run", "lane")
        .sortWithinPartitions(*KEY, F.col("keep_id").asc_nulls_last())
        .drop("lane")
        .mapInArrow(_merge_sorted, ENTRY)
    )


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", fan: int = 16) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    ``kept`` holds for the row with the group's smallest id. Nulls: a null text equals the empty one; a null id is
    never the smallest unless the whole group has none, and such a row is kept only then. Repeated ids: rows that
    share the smallest id are all marked as kept (they cannot be told apart). Texts of any length are read whole. An
    empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = 2
    while fan**levels < tasks:
        levels += 1
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text).alias("t"))
    marked = norm.select(
        "doc_id",
        F.unhex(F.sha2(F.encode("t", "utf-8"), 256)).alias("digest"),
        F.length("t").cast("long").alias("length"),
        F.xxhash64("t").alias("check"),
        F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(fan**levels)).alias("run"),
    )
    marked = stash(marked, "digests")
    runs = marked.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("rows"))
    tree = [stash(runs.sortWithinPartitions(*KEY), "run")]
    for _ in range(levels):
        up = tree[-1].withColumn("run", F.floor(F.col("run") / fan))
        tree.append(stash(_merge_runs(up, tasks), "run"))
    answer = tree[-1].select("run", "digest", "length", "check", "keep_id", F.col("rows").alias("group_size"))
    for level in reversed(tree[:-1]):
        below = level.select("digest", "length", "check", F.col("run").alias("child"), F.floor(F.col("run") / fan).alias("run"))
        answer = below.join(answer, KEY).drop("run").withColumnRenamed("child", "run")
    out = marked.join(answer, KEY)
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
