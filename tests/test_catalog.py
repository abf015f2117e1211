import duckdb
import pytest

from quarrylane.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages embeddings".split()


def rows(names, records):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted([tuple(clean(r[i]) for i in order) for r in records], key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_payout_dates_takes_all_orders_from_50(spark):
    """Each order has a payout date: none of the tables' totals is under 50."""
    got = catalog.QUERIES["payout_dates"](spark, DIR).select("o_orderkey").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in spark.read.parquet(f"{DIR}/orders.parquet").select("o_orderkey").collect())
