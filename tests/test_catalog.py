"""Every registered query at the smallest scale: against its SQL where there is one, else that it runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        rel = duck.execute(SQL[name])
        assert got == rows_of([c[0] for c in rel.description], rel.fetchall())


def test_every_query_has_a_survey_id():
    ids = {n.split("_")[0] for n in QUERIES} - {"minimum"}
    want = ([f"s{i}" for i in range(1, 13)] + [f"k{i}" for i in range(1, 12)] + [f"p{i}" for i in range(1, 23)]
            + [f"j{i}" for i in range(1, 21)] + [f"a{i}" for i in range(1, 23)] + [f"w{i}" for i in range(1, 18)]
            + [f"l{i}" for i in range(1, 6)] + [f"x{i}" for i in range(1, 5)] + [f"f{i}" for i in range(1, 67)]
            + [f"t{i}" for i in range(1, 12)] + [f"u{i}" for i in range(1, 24)])
    assert sorted(set(want) - ids) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
