"""The .npy source: ranges, names, several files, and what it refuses."""

import pickle

import numpy as np
import pytest

from graphloom.operators import cohort
from graphloom.sources import npy, tables

from .test_operators import frame


def test_ranges_of_rows(spark, tmp_path):
    m = np.arange(70, dtype=np.float32).reshape(10, 7)
    np.save(tmp_path / "m.npy", m)
    d = npy.read_npy(spark, str(tmp_path / "m.npy"), most=4 * 28)
    assert d.rdd.getNumPartitions() == 3
    assert [(r["row_idx"], r["v"]) for r in d.orderBy("row_idx").collect()] == [(i, x) for i, x in enumerate(m.tolist())]
    assert npy.read_npy(spark, f"file://{tmp_path}/m.npy").count() == 10


@pytest.mark.parametrize("kind", ["f2", "f8", "i4", ">f4"])
def test_kinds_of_numbers(spark, tmp_path, kind):
    m = np.array([[1, -2], [3, 100]], dtype=kind)
    np.save(tmp_path / "m.npy", m)
    d = npy.read_npy(spark, str(tmp_path / "m.npy"))
    assert d.schema["v"].dataType.simpleString() == ("array<double>" if kind == "f8" else "array<float>")
    assert [r["v"] for r in d.orderBy("row_idx").collect()] == m.tolist()


@pytest.mark.parametrize("kind", ["U", "S", "O"])
def test_names_join_by_place(spark, tmp_path, kind):
    names = [f"x/AF-P{i}-F1-model" for i in range(5)]
    np.save(tmp_path / "n.npy", np.array(names, dtype=kind))
    np.save(tmp_path / "m.npy", np.eye(5, dtype=np.float32))
    d = npy.read_named(spark, str(tmp_path / "m.npy"), str(tmp_path / "n.npy"), most=40)
    assert [(r["row_idx"], r["name"], r["v"]) for r in d.orderBy("row_idx").collect()] == [(i, n, np.eye(5)[i].tolist()) for i, n in enumerate(names)]
    genes = frame(spark, [("G", "AD", 1)], "gene_symbol string, label string, pos int")
    mapping = frame(spark, [("G", "P1", 1), ("G", "P3", 2)], "gene_symbol string, uniprot_accession string, pos int")
    assert cohort.gene_vectors(genes, mapping, d).first()["v"] == [0, 0.5, 0, 0.5, 0]


def test_wrong_lengths_and_files(spark, tmp_path):
    np.save(tmp_path / "n.npy", np.array(["a", "b"]))
    np.save(tmp_path / "m.npy", np.eye(3))
    np.save(tmp_path / "f.npy", np.asfortranarray(np.arange(6.0).reshape(2, 3)))
    np.save(tmp_path / "3.npy", np.zeros((2, 2, 2)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "m.npy").read_bytes()[:-1])
    with pytest.raises(ValueError):
        npy.read_named(spark, str(tmp_path / "m.npy"), str(tmp_path / "n.npy"))
    for bad in ("f.npy", "3.npy", "cut.npy", "none.npy"):
        with pytest.raises((ValueError, FileNotFoundError)):
            npy.headers(str(tmp_path / bad))
    with pytest.raises(ValueError):
        npy.headers(str(tmp_path))  # files of several kinds


def test_empty_arrays(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.zeros((0, 4), np.float32))
    np.save(tmp_path / "n.npy", np.array([], dtype="U3"))
    assert npy.read_npy(spark, str(tmp_path / "m.npy")).collect() == []
    assert npy.read_named(spark, str(tmp_path / "m.npy"), str(tmp_path / "n.npy")).count() == 0


class Bad:
    def __reduce__(self):
        return (print, ("run",))


def test_pickles_are_not_run(tmp_path):
    np.save(tmp_path / "n.npy", np.array([Bad()], dtype=object))
    with (tmp_path / "n.npy").open("rb") as f:
        np.lib.format.read_magic(f)
        np.lib.format.read_array_header_1_0(f)
        with pytest.raises((ValueError, pickle.UnpicklingError)):
            npy._Texts(f).load()


def test_parts_keep_the_order_of_rows(spark, tmp_path):
    v = spark.range(1000).selectExpr("id", "array(cast(id as double), -1.5D) AS v").repartitionByRange(4, "id").sortWithinPartitions("id")
    npy.write_npy(v, f"{tmp_path}/out", most=16 * 60)
    assert len(list((tmp_path / "out").glob("*.npy"))) >= 17
    got = npy.read_npy(spark, f"{tmp_path}/out").orderBy("row_idx").collect()
    assert [r["v"] for r in got] == [[float(i), -1.5] for i in range(1000)] and [r["row_idx"] for r in got] == list(range(1000))


def test_names_of_a_list_or_a_file(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.save(tmp_path / "n.npy", np.array(["a", "b", "c"]))
    own = tables.read_vectors(spark, str(tmp_path / "m.npy"), ["a", "b", "c"], rows=2).orderBy("row_idx").collect()
    assert own == tables.read_vectors(spark, str(tmp_path / "m.npy"), str(tmp_path / "n.npy")).select(*own[0].__fields__).orderBy("row_idx").collect()
