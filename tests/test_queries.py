"""Every core query against its SQL twin on the small tables."""

import os

import duckdb
import pytest

from trackweave.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return None if v is None or v != v else (round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))


def content(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert content(df.columns, rows) == content(rel.columns, rel.fetchall())
    else:
        assert rows


def test_known_persistence(spark):
    sf = SF.replace("0.001", "0.01")
    got = [tuple(r) for r in QUERIES["persistence_prob"](spark, sf).orderBy("c").collect()]
    assert got == [(1, 918, 10661, 0.079281), (2, 100, 818, 0.108932), (3, 3, 97, 0.03)]
