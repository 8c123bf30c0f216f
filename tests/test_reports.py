"""Every query with an SQL twin gives the twin's rows."""

import duckdb
import pytest

from verdance.plans import reports

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(v):
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, (int, float)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(reports.ORACLE))
def test_same_rows(spark, db, name):
    ours = reports.QUERIES[name](spark, SF)
    theirs = db.execute(reports.ORACLE[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(reports.QUERIES) - set(reports.ORACLE)))
def test_runs(spark, name):
    assert reports.QUERIES[name](spark, SF).columns


#: Queries whose rule must let some rows through and stop others: SQL over the query's result q and the table it chooses from.
BOTH_WAYS = {
    "partner_fallback": "SELECT count(partner), count(*)-count(partner) FROM q",
    "tile_pairing": "SELECT count(*) FILTER (WHERE pan IS NOT NULL AND ndvi IS NOT NULL), count(*) FILTER (WHERE pan IS NULL OR ndvi IS NULL) FROM q",
    "prefer_ndvi": "SELECT count(*) FILTER (WHERE filename LIKE '%ndvi%'), (SELECT count(*) FROM supplier)-count(*) FROM q",
    "coverage_semi": "SELECT count(*), 25-count(*) FROM q",
    "median_crown_unit": "SELECT count(*), 20-count(*) FROM q",
    "strata_defaults": "SELECT count(*) FILTER (WHERE n>0), count(*) FILTER (WHERE n=0) FROM q",
    "polygon_semi": "SELECT count(*), (SELECT count(*) FROM customer)-count(*) FROM q",
    "model_density": "SELECT count(*) FILTER (WHERE tree_count>0 AND covered), count(*) FILTER (WHERE tree_count=0 OR tree_density IS NULL) FROM q",
}


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", sorted(BOTH_WAYS))
def test_rules_act(name, sf):
    """By the twin, which the query equals."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf{sf}/{t}.parquet'")
    con.execute(f"CREATE TABLE q AS {reports.ORACLE[name]}")
    acts, stops = con.execute(BOTH_WAYS[name]).fetchone()
    assert acts > 0 and (stops > 0 or (name == "strata_defaults" and sf == "0.1"))
