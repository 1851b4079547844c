"""The price history of large tables: joined share by share, read in parts of whole routes."""

import functools
import time

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from faresight.operators.ordered import input_bytes
from faresight.plans import answer, catalog, model, queries_scoring
from faresight.session import is_folder
from faresight.sources import star

TABLES = ("supplier", "customer", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """1,500 fares of a few routes; some have no departure, some no origin, and many share flight and time with another route's."""
    path = str(tmp_path_factory.mktemp("tables"))

    def put(name, n, *columns):
        spark.range(1, n + 1).selectExpr(*columns).coalesce(1).write.parquet(f"{path}/{name}.parquet")

    put("supplier", 6, "id AS s_suppkey", "CAST(if(id < 3, NULL, id % 4) AS INT) AS s_nationkey")
    put("customer", 8, "id AS c_custkey", "CAST(id % 5 AS INT) AS c_nationkey")
    put("part", 10, "id AS p_partkey", "concat('Brand#', id % 3) AS p_brand", "if(id % 4 = 0, 'PROMO', 'LARGE') AS p_type")
    put(
        "orders", 300, "if(id > 290, NULL, id) AS o_orderkey", "id % 8 + 1 AS o_custkey", "if(id % 3 = 0, 'F', 'O') AS o_orderstatus", "id * 1000D AS o_totalprice",
        "TIMESTAMP '1998-01-05' + make_dt_interval(CAST(id % 40 AS INT)) AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    put(
        "lineitem", 1500, "if(id % 50 = 0, NULL, id % 300 + 1) AS l_orderkey", "CAST(id % 2 + 1 AS INT) AS l_linenumber", "id % 10 + 1 AS l_partkey", "id % 6 + 1 AS l_suppkey",
        "700D + id * 37 % 6000 AS l_extendedprice", "CAST(id % 50 + 1 AS DOUBLE) AS l_quantity", "(id % 10) / 100D AS l_discount", "if(id % 2 = 0, 'R', 'N') AS l_returnflag",
        "if(id % 40 = 0, NULL, TIMESTAMP '1998-06-05' + make_dt_interval(CAST(id % 9 AS INT))) AS l_shipdate",
    )
    return path


@pytest.fixture
def shares(spark, tables):
    """Three shares of the tables' bytes."""
    spark.conf.set(star.SHARE_SETTING, str(-(-input_bytes(star.price_history(spark, tables)) // 3)))
    yield 3
    spark.conf.unset(star.SHARE_SETTING)


@pytest.fixture
def no_trees(monkeypatch):
    """No model: every fare is predicted at 6,000."""
    stub = lambda df, fitted, out="predicted": df.withColumn(out, F.lit(6000.0))
    monkeypatch.setattr(queries_scoring, "_fitted", lambda spark, sf: (None, None))
    for module in (model, answer, queries_scoring.finding):
        monkeypatch.setattr(module, "predict_fares", stub)


def shuffle_files(spark):
    kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (kept.apply(i).getName() for i in range(kept.size())) if n.startswith("shuffle_")}


def left_over(spark, before):
    """Shuffle files since ``before`` that don't go within some seconds."""
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def rows(df):
    return sorted(map(str, df.collect()))


def equal(spark, path, df, name):
    con = connect("")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    verdict, count, note = compare(con, df, catalog.ORACLES[name])
    assert verdict == "ok", note
    return count


def test_parts_hold_every_fare_and_whole_routes(spark, tables, shares):
    want = rows(star.price_history(spark, tables))
    before = shuffle_files(spark)
    with star.kept_history(spark, tables) as kept:
        assert kept.stored and not left_over(spark, before)
        path = kept.whole.inputFiles()[0].rpartition("/_part=")[0]
        assert rows(kept.whole) == want and len(kept.parts) > 2
        assert sorted(x for p in kept.parts for x in rows(p)) == want
        routes = [set(map(tuple, p.select(*star.ROUTE).distinct().collect())) for p in kept.parts]
        assert sum(map(len, routes)) == len(set().union(*routes)) > 20
    assert not is_folder(spark, path)


def test_small_tables_are_not_stored(spark, tables):
    with star.kept_history(spark, tables) as kept:
        assert not kept.stored and len(kept.parts) == 1


def test_features_of_large_tables_are_made_in_parts(spark, tables, shares, monkeypatch):
    """No shuffle of the joins is left when the features begin, and all features are as from the whole history."""
    whole = rows(model.fare_features(star.price_history(spark, tables), star.AS_OF, star.ORDER, keep=queries_scoring._KEYS))
    before, left, make = shuffle_files(spark), [], model.fare_features

    def features(*args, **kwargs):
        left.append(left_over(spark, before))
        return make(*args, **kwargs)

    monkeypatch.setattr(model, "fare_features", features)
    monkeypatch.setattr(model, "train_fare_model", functools.partial(model.train_fare_model, rounds=2, depth=3))
    out = catalog.QUERIES["train_model_invariants"](spark, tables)
    assert len(left) > 2 and not any(left)
    assert rows(queries_scoring._fitted(spark, tables)[0]) == whole
    assert equal(spark, tables, out, "train_model_invariants") == 1


def test_answers_read_the_stored_history(spark, tables, shares, no_trees):
    """The snapshots are there before the result is asked for, and what made them has gone."""
    before = shuffle_files(spark)
    out = catalog.QUERIES["answer_invariants"](spark, tables)
    assert not left_over(spark, before)
    assert equal(spark, tables, out, "answer_invariants") > 20


def test_offers_are_searched_part_by_part(spark, tables, shares, no_trees):
    """Offers without a search id compete across routes, whichever part those are in; the rows are those of one search of all."""
    offers = star.offers(spark, tables).filter("search_id IS NULL AND flight_number IS NOT NULL AND departure_time IS NOT NULL")
    assert offers.groupBy("flight_number", "departure_time").agg(F.count_distinct("destination_code").alias("n")).filter("n > 1").count() > 5
    before = shuffle_files(spark)
    out = catalog.QUERIES["search_enrichment"](spark, tables)
    assert not left_over(spark, before) and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = rows(queries_scoring._advised(star.offers(spark, tables), None))
    assert rows(out) == found and len(found) > 100
