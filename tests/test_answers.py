"""Requests that ask the same are answered once, and every one of them gets the answer."""

import datetime

from pyspark.sql import functions as F

from faresight.plans import answer, catalog, model, queries_scoring
from faresight.sources import star


def test_distinct_requests(spark):
    """Null dates are equal, and rows of a repeated or null id are left as they are."""
    rows = [(1, "N01", "N02", "1998-01-01"), (2, "N01", "N02", "1998-01-01"), (3, "N01", "N02", None), (4, "N01", "N02", None)]
    odd = [(5, "N01", "N02", "1998-01-01"), (5, "N01", "N03", "1998-01-01"), (None, "N01", "N02", "1998-01-01"), (None, "N01", "N02", "1998-01-01")]
    requests = spark.createDataFrame(rows + odd, "request_id long, origin string, destination string, departure_date string")
    distinct, links = answer.distinct_requests(requests)
    assert sorted(map(str, map(tuple, distinct.collect()))) == sorted(map(str, [rows[0], rows[2], *odd]))
    assert sorted(map(str, map(tuple, links.collect()))) == sorted(map(str, [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (None, None)]))
    given = answer.of_all(links, distinct.select("request_id", "destination")).collect()
    assert sorted(map(str, map(tuple, given))) == sorted(map(str, [*((i, "N02") for i in (1, 2, 3, 4, 5, None, None)), (5, "N03")]))


def test_alerts_that_ask_the_same_are_scored_once(spark, monkeypatch):
    """Sixty alerts on two routes and one day: the model scores two requests' days, and all sixty are answered."""
    day = datetime.date(1998, 7, 1)
    target = F.format_string("N%02d", 2 + F.col("id") % 2).alias("destination_code")
    alerts = spark.range(60).select("id", F.lit("N01").alias("origin_code"), target, F.lit(day).alias("departure_date"), F.lit(True).alias("is_active"))
    fares = spark.createDataFrame([("N01", "N02", "BRAND#1", 5000.0, 9), ("N01", "N03", "BRAND#2", 7000.0, 40)], "origin_code string, destination_code string, airline_code string, price double, seats_available int")
    scored = []

    def predict(df, fitted, out="predicted"):
        scored.append(df.count())
        return df.withColumn(out, F.lit(6000.0))

    monkeypatch.setattr(star, "alerts", lambda spark, sf: alerts)
    monkeypatch.setattr(star, "price_history", lambda spark, sf: fares)
    monkeypatch.setattr(queries_scoring, "_fitted", lambda spark, sf: (None, None))
    monkeypatch.setattr(model, "predict_fares", predict)
    monkeypatch.setattr(answer, "predict_fares", predict)
    out = catalog.QUERIES["answer_invariants"](spark, "").collect()
    assert sorted(r.request_id for r in out) == list(range(60))
    assert {(r.points, r.banded, r.lifted, r.dated, r.decided) for r in out} == {(30, True, True, True, True)}
    assert {(r.request_id % 2, r.destination_code) for r in out} == {(0, "N02"), (1, "N03")}
    assert max(scored) == 30 * 2
    answers = catalog.QUERIES["answer_requests"](spark, "")
    assert answers.count() == 60 and answers.distinct().count() == 60
