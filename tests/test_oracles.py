"""Every registered query against its SQL, run by DuckDB on the same tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry_points  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    """Only operators of the optional part may have none: learned models, bins and tokens are tested with it."""
    without = set(entry_points.queries()) - set(entry_points.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert all(name == "pipeline" or name.startswith("op") for name in without)


def test_entry_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    result = duck.execute(entry_points.oracle_sql()[name])
    kinds = {column[0]: str(column[1]) for column in result.description}
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    order = sorted(df.columns)
    position = {c: i for i, c in enumerate(kinds)}

    def rows(values):
        tidy = [tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)
                for row in values]
        return sorted(tidy, key=lambda row: tuple((v is None, str(v)) for v in row))

    got = rows(tuple(r[c] for c in order) for r in df.collect())
    want = rows(tuple(r[position[c]] for c in order) for r in result.fetchall())
    assert got == want
