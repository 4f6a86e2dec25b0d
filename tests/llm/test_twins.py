"""Training-data queries with a SQL twin, side by side with DuckDB on the smallest tables."""
import pytest

duckdb = pytest.importorskip("duckdb")
from lexmill.llm import queries as llm  # noqa: E402


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = llm.queries()[name](spark, sf)
    got = con.execute(llm.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want
