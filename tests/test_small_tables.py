"""Queries on a few rows of their own, written as the supplied tables are."""

import datetime as dt

import pytest

from check import compare, connect
from faresight.plans import catalog

DAY = dt.datetime(1998, 1, 5)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Four fares of three routes, one of them from an airport with a high number, and an alert on each route."""
    path = str(tmp_path_factory.mktemp("tables"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    put("supplier", [(1, 3), (2, 20)], "s_suppkey bigint, s_nationkey int")
    put("customer", [(1, "Customer#1", 4, "BUILDING", 1.0), (2, "Customer#2", 5, "FURNITURE", 1.0)], "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double")
    put("part", [(1, "large ring", "Brand#7", "LARGE"), (2, "hot bolt", "Brand#16", "ECONOMY")], "p_partkey bigint, p_name string, p_brand string, p_type string")
    orders = [(3, 1, "O", 900000.0, "1-URGENT"), (20, 2, "O", 5000.0, "5-LOW"), (45, 1, "O", 700000.0, "2-HIGH"), (28, 2, "F", 700000.0, "2-HIGH")]
    put("orders", [(*o[:4], DAY, o[4]) for o in orders], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    lines = [(3, 1, 1, 1, 2000.0), (20, 1, 2, 2, 900.0), (45, 1, 1, 2, 1500.0), (45, 2, 2, 2, 4000.0)]
    put(
        "lineitem", [(o, n, p, s, price, 20.0, 0.05, "R", DAY + dt.timedelta(days=30 * n)) for o, n, p, s, price in lines],
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string, l_shipdate timestamp",
    )
    return path


def equal(spark, path, name):
    con = connect("")
    for t in ("supplier", "customer", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    verdict, count, note = compare(con, catalog.QUERIES[name](spark, path), catalog.ORACLES[name])
    assert verdict == "ok", note
    return count


def test_fare_estimate_looks_airlines_up(spark, tables):
    assert equal(spark, tables, "fare_estimate") == 4


def test_alerts_of_every_route_meet_its_fares(spark, tables):
    """Alerts 20 and 45 leave N20, whose lowest fares are 900 and 1,500; neither may fall back to the fare of an unknown route."""
    assert equal(spark, tables, "evaluate_alerts") == 4
    fares = {r.id: r.last_price for r in catalog.QUERIES["evaluate_alerts"](spark, tables).collect()}
    assert fares[20] == 3900.0 and fares[45] == 4700.0
