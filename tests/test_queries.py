"""Every query of the library against its SQL in DuckDB, on the driver's tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from windrose.plans.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(frame, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("nan", "<NA>", "None"):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return round(float(v), 5) + 0.0 if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(map(plain, row)) for row in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got)
    a, b = comparable(got, columns), comparable(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-6, abs=2e-5) if all(isinstance(v, float) for v in x + y) else all(
            p == pytest.approx(q, rel=1e-6, abs=2e-5) if isinstance(p, float) and isinstance(q, float) else p == q for p, q in zip(x, y, strict=True)
        )


def test_every_query_but_the_invented_study_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"q42_study_losses"}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
