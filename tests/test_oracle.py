"""Every query with oracle SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

from quillmesh.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 5) + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf, name):
    got = catalogue.queries()[name](spark, sf)
    rows = got.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert canonical(got.columns, [tuple(r) for r in rows]) == canonical(names, want.fetchall())
