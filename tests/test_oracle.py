"""Every registered query with an oracle matches DuckDB on sf0.01."""

import math

import duckdb
import pytest

from slotwise.plans.registry import ORACLE, QUERIES, load_all
from slotwise.sources.testdata import TABLES
from tests.conftest import SF01

load_all()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SF01)
    scols = sdf.columns
    srows = sorted((tuple(_norm(r[c]) for c in sorted(scols)) for r in sdf.collect()), key=repr)
    rel = duck.sql(ORACLE[name])
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    assert stypes == dtypes
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == sorted(scols)
    idx = [dcols.index(c) for c in sorted(scols)]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert srows == drows
