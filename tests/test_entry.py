import duckdb
import pytest

import __spark_entry__ as entry
from notewise.sources.testdata import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["method", "step", "metric", "precision", "recall", "fmeasure", "n_pairs"]
    assert len(rows) > 0 and all(0 <= r.fmeasure <= 1 for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 59


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return f"{v:.6f}"
        return "NULL" if v is None else str(v)
    return sorted(tuple(n(r[i]) for i in order) for r in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle_parity_sf0001(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString()) for f in sdf.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert _norm([tuple(r) for r in sdf.collect()], sdf.columns) == _norm(rel.fetchall(), rel.columns)
