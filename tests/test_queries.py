"""Every registered query of the library's own operators against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from helixframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())


def test_folds_keep_groups_together(spark):
    rows = catalogue.QUERIES["group_kfold"](spark, SF).collect()
    folds = {}
    for r in rows:
        folds.setdefault(r["source"], set()).add(r["fold"])
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(len(f) == 1 for f in folds.values())


def test_geometry_adds_up(spark):
    rows = catalogue.QUERIES["pca_geometry"](spark, SF).collect()
    variance = [r["variance"] for r in rows]
    assert variance == sorted(variance, reverse=True)
    eta = catalogue.QUERIES["eta_scatter"](spark, SF).first()
    assert abs(sum(variance) - eta["trace_total"]) < 1e-3
    assert abs(rows[0]["eta"] - eta["eta"]) < 1e-5


def test_logistic_folds(spark):
    rows = catalogue.QUERIES["logreg_cv"](spark, SF).collect()
    assert rows and all(0 <= r["auc"] <= 1 for r in rows)
