"""Queries with SQL against DuckDB on the small driver tables."""

import duckdb
import pytest

from slotwise.llm.queries import ORACLE, QUERIES

SF01 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    got = QUERIES[name](spark, SF01).toPandas()
    want = con.execute(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda df: sorted(tuple("" if v is None or v != v else str(int(v) if isinstance(v, float) else v) for v in r) for r in df[cols].itertuples(index=False))
    assert norm(got) == norm(want)


def test_the_driver_entry_registers_every_query():
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found)
    assert {n.split("_")[0] for n in found if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
