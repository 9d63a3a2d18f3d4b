"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from graphloom.plans import composites, signal, tabular

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = signal.QUERIES | tabular.QUERIES | composites.QUERIES, signal.SQL | tabular.SQL | composites.SQL


def plain(value):
    if isinstance(value, float):
        return f"{value:.8g}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", ["pca_spectrum", "pca_scores", "graph_perm_lcc", "matched_controls_greedy", "label_table", "file_manifest", "prediction_table", "run_summary", "run_manifest", "cross_validation"])
def test_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
