"""Every registered query against DuckDB on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from tilewright.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return f"{float(v) + 0.0:.5f}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).values.tolist())


# What SQL cannot say, with the test that holds it against plain loops.
BY_LOOPS = {
    "field_bootstrap_ci": "test_operators.py::test_bootstrap",
    "prototype_support_split": "test_operators.py::test_support_groups",
    "view_draws": "test_artifacts.py::test_view_draws_are_the_generator_s",
    "paired_views": "test_artifacts.py::test_view_draws_are_the_generator_s",
    "corpus_embedding_run": "test_artifacts.py::test_convolutional_encoder_against_loops",
}


def test_every_query_is_held_against_something():
    here = os.path.dirname(__file__)
    assert set(plans.QUERIES) - set(plans.SQL) == set(BY_LOOPS)
    for where in BY_LOOPS.values():
        file, name = where.split("::")
        assert f"def {name}(" in open(os.path.join(here, file)).read(), where


@pytest.mark.parametrize("module", ["queries", "more", "files", "wide", "registry"])
def test_modules_of_queries_can_be_imported_in_any_order(module):
    """A worker imports the module of the function it runs first; all queries are registered whichever that is."""
    said = f"import tilewright.plans.{module}; from tilewright.plans import queries; print(len(queries.QUERIES))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", said], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[-1:] == [str(len(plans.QUERIES))], done.stderr


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_matches_sql(spark, con, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.SQL:
        assert len(got) > 0
        return
    want = con.sql(plans.SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert plain(got, columns) == plain(want, columns)
