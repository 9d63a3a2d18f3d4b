"""Registered queries against their SQL, and the pipeline against its operators one by one."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import queries

TABLES = "documents pages conversations embeddings".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf).select(*columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.fetchall()))


def test_pipeline_is_its_stages_done_plainly(spark, tmp_path):
    """run() over a small table: what the first three stages keep is that of plain versions; the mix is packed token by token."""
    import numpy as np

    from graphloom.llm import mixing, packing, quality_rules

    from .test_operators import DOCS, fixture_rows, near_copies, plain_groups, plain_lines, plain_quality

    rows = [r for r in fixture_rows() if r[0] not in (None, 7)] + [(*r[:2], "en", "abc"[r[0] % 3], len(r[1])) for r in near_copies()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = {k[0] for k in plain_quality(rows, quality_rules.MIN_DOCS, quality_rules.SHARE) if k[-1]}
    docs = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    rows = [tuple(r) for r in docs.collect()]
    assert {r[0] for r in rows} == kept

    gone, have, code = plain_lines(rows)
    want = {}
    for i, t, *_ in rows:
        lines = t.split("\n")
        drop = gone[i, code(t)]
        if len(drop) < have[i, code(t)]:
            want[i] = "\n".join(x for k, x in enumerate(lines) if k not in drop)
    docs = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    rows = [tuple(r) for r in docs.collect()]
    assert {r[0]: r[1] for r in rows} == want

    docs = corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path))
    assert {r[0] for r in docs.collect()} == {i for i, _, c in plain_groups(rows, 5, 80) if i == c}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words, found = packing._WordIds(queries.tokenizer_path()), Counter()
    pieces = {}
    for r in sorted(out, key=lambda r: (r["doc_row"], r["start"])):
        pieces.setdefault((r["doc_row"], r["doc_id"]), []).append(bytes(r["ids"]))
    for (_, i), parts in pieces.items():
        ids = np.frombuffer(packing.token_ids(words, [texts[i]])[0], "<u2").astype("<u4").tobytes()
        assert b"".join(parts) == ids
        found[i] += 1
    assert found == copies


def test_pipeline_keeps_one_of_a_large_group_of_copies(spark, tmp_path):
    """Copies of a clean document are a third of a source's rows: the quality stage leaves them, and the join keeps one."""
    from .test_operators import DOCS

    word = lambda *at: "w" + "".join(chr(97 + x) for x in at)  # noqa: E731  (digits are all one to the rules)
    text = lambda k: "\n".join(" ".join(word(k % 26, k // 26, i, j) for j in range(12)) for i in range(4))
    rows = [(k, text(0 if k < 20 else k), "en", "a", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    docs = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert docs.count() == 60
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in docs.collect()} == {0, *range(20, 60)}


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    """Clean rows without an id come through the first three stages; equal rows become one; an empty table gives an empty result."""
    from .test_operators import DOCS

    word = lambda *at: "w" + "".join(chr(97 + x) for x in at)
    text = lambda k: "\n".join(" ".join(word(k, i, j) for j in range(12)) for i in range(4))
    rows = [(None, text(0)), (None, text(1)), (3, text(2)), (3, text(3)), (4, text(4)), (4, text(4)), (5, None), (6, "")]
    rows = [(i, t, "en", None, 1) for i, t in rows]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == [(0, text(0)), (0, text(1)), (3, text(2)), (3, text(3)), (4, text(4))]
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
