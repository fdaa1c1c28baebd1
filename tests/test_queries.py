"""Every query of the catalogue runs; its rows are those of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, plain.values.tolist()))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE:
        want = con.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "lang", "cls", "score", "n_defects", "place"]


def test_empty_tables(spark, tmp_path, sf_dir):
    """All queries of the catalogue give an empty or all-zero result on empty tables."""
    for t in ("documents", "pages", "labels", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in catalog.QUERIES.items():
        if name != "stream_audit":
            assert query(spark, str(tmp_path)).count() == 0, name


def test_nothing_outside_llm_imports_it():
    base = os.path.dirname(catalog.__file__)
    for folder, _, files in os.walk(base):
        for f in files:
            if f.endswith(".py") and "llm" not in os.path.relpath(folder, base).split(os.sep):
                assert "quillspark.llm" not in open(os.path.join(folder, f)).read(), f
