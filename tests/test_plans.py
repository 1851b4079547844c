"""Physical plans: pushdown, pruning, partial aggregation, early top-k."""

import contextlib
import io

from pyspark.sql import functions as F

from faresight.functions import pricing
from faresight.operators import aggregates as agg, filters, joins, offers, signals
from faresight.sources import star


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_price_bounds_reach_the_scan(spark, sf):
    scan = filters.within_price_bounds(star.raw(spark, sf, "lineitem"), price="l_extendedprice").select("l_orderkey")
    text = plan(scan)
    assert "GreaterThanOrEqual(l_extendedprice,800.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in text


def test_departure_range_reaches_the_scan(spark, tmp_path):
    flights = spark.createDataFrame([(1, "A", "B", "SCHEDULED")], "id int, origin_code string, destination_code string, status string")
    flights.withColumn("departure_time", F.to_timestamp(F.lit("2026-01-01 10:00:00"))).write.parquet(str(tmp_path / "f"))
    found = filters.departures_on(spark.read.parquet(str(tmp_path / "f")), "A", "B", "2026-01-01")
    text = formatted(found)
    assert found.count() == 1
    for pushed in ("EqualTo(origin_code,A)", "GreaterThanOrEqual(departure_time", "LessThan(departure_time", "EqualTo(status,SCHEDULED)"):
        assert pushed in text, pushed
    assert "TakeOrderedAndProject" in text


def test_decision_reads_the_forecast_once(spark):
    fc = spark.createDataFrame([("A", "B", 1, 1.0)], "origin_code string, destination_code string, day int, price double")
    snap = spark.createDataFrame([("A", "B", 1.0, 1, 1, 0.1)], "origin_code string, destination_code string, current_price double, days_until_departure int, seats_available int, demand_score double")
    text = plan(signals.booking_decision(snap, fc))
    assert text.count("Window ") == 1 and text.count("SortMergeJoin") + text.count("BroadcastHashJoin") <= 1


def test_matches_aggregate_fares_before_the_join(spark, sf):
    alerts = star.alerts(spark, sf)
    ticks = star.fare_ticks(star.events(spark, sf))
    text = plan(joins.match_alerts(alerts, ticks))
    assert "partial_min(price" in text


def test_aggregates_combine_before_the_shuffle(spark, sf):
    text = plan(agg.market_snapshot(star.raw(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("airline_code")), ["k"]))
    # Fares are hashed per key and airline; only what is left of them is sorted for the lowest text.
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert "HashAggregate" in below and "partial_min(price" in below and "SortAggregate" not in below and text.count("Exchange hashpartitioning") == 2


def test_top_k_search_trims_first(spark, sf):
    text = plan(offers.cheapest_offers(star.offers(spark, sf), 5))
    assert "WindowGroupLimit" in text


def test_scoring_stays_in_generated_code(spark, sf):
    df = star.raw(spark, sf, "lineitem").select(
        pricing.demand_score(F.col("l_linenumber"), F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")).alias("d")
    )
    assert "*(1) Project" in plan(df)


def test_search_shuffles_only_pieces_that_are_asked_for(spark):
    """Pieces of the airports meet those of the queries where they are cut, before any exchange."""
    places = spark.range(300).select(F.format_string("%05d", "id").alias("iata_code"), F.lit("gear box").alias("city"), F.lit("x").alias("name"))
    found = offers.search_airports(places, spark.createDataFrame([("ear",), ("02",)], "query string"))
    got = found.groupBy("query").count().collect()
    assert {r["query"]: r["count"] for r in got} == {"ear": 300, "02": 112}
    text = plan(found)
    cut = [i for i, line in enumerate(text.splitlines()) if "Generate explode(array_distinct" in line]
    assert len(cut) >= 2
    for i in cut:
        above = text.splitlines()[:i][::-1]
        assert next(j for j, line in enumerate(above) if "LeftSemi" in line) < next(j for j, line in enumerate(above) if "Exchange" in line)
