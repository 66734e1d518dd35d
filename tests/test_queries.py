"""Every query with SQL against that SQL in another engine, over whole small tables."""

import datetime
import decimal
import math
from pathlib import Path

import pytest

from veridoc.plans import queries as own
from veridoc.plans.relations import TABLES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        path = Path(SF, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)[:10] if isinstance(v, datetime.date) else repr(v)


def same(frame, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    assert got == sorted(tuple(map(plain, r)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_says_what_sql_says(spark, other, name):
    same(own.QUERIES[name](spark, SF), other.execute(own.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(own.QUERIES.keys() - own.ORACLES.keys()))
def test_query_without_sql_has_rows(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0


def test_fragments_are_judged_over_all_marks(spark):
    marks = own._marks(spark, SF)
    sure = {r.mark_id for r in marks.where("confidence >= 0.1").select("mark_id").collect()}
    assert sure & {r.hit_id for r in own.QUERIES["i7_unfragmented"](spark, SF).select("hit_id").collect()}
