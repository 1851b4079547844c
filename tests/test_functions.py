"""Column functions against hand-computed values and small Python formulas."""

import datetime as dt
import hashlib
import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from faresight.columns import round_even
from faresight.functions import dates, nested, pricing, scores, text


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, kind, fn):
    df = column(spark, values, kind)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_round_even_equals_python(spark, values):
    ties = [round(v, 4) + 0.00005 for v in values] + [1.34875, 1.00155, 0.575, 2.675, 0.125, -0.125, 2.5]
    everything = values + ties
    for digits in (2, 4):
        got = apply(spark, everything, "double", lambda c: round_even(c, digits))
        assert [g + 0.0 for g in got] == [round(v, digits) + 0.0 for v in everything]


def test_messy_text(spark):
    assert apply(spark, [" del ", "New Delhi (DEL)", "bombay", "", "Atlantis", "(AB) x"], "string", text.resolve_code) == [
        "DEL", "DEL", "BOM", "", "ATL", "(AB"
    ]
    assert apply(spark, [" delhi ", "dxb", "Port Blair"], "string", text.resolve_city) == ["DEL", "DXB", "IXZ"]
    assert apply(spark, ["5,183.35", "87%", "", None, "abc", " -4.5e2x", ".5", "NaN"], "string", text.safe_number) == [
        5183.35, 87.0, 0.0, 0.0, 0.0, -450.0, 0.5, 0.0
    ]
    assert apply(spark, ["+91 98765-43210", "9876543210", "12345"], "string", text.norm_phone) == [
        "9876543210", "9876543210", "12345"
    ]
    assert apply(spark, ["+91 1", "9876543210", "12345"], "string", text.is_indian_phone) == [True, True, False]
    assert apply(spark, ["buy now", "BOOK-IT", "Wait", "neutral", None], "string", text.canon_recommendation) == [
        "BOOK_NOW", "BOOK_NOW", "WAIT", "MONITOR", "MONITOR"
    ]


def test_durations(spark):
    values = ["PT2H15M", "PT10H5M", "PT45M", "PT3H", "PT", "n/a", "", None]
    assert apply(spark, values, "string", text.duration_minutes) == [135, 605, 45, 180, 0, None, None, None]
    assert apply(spark, values, "string", text.format_duration) == ["2h 15m", "10h 5m", "45m", "3h", "PT", "n/a", "--", "--"]
    assert apply(spark, [135, 60], "int", text.iso_duration) == ["PT2H15M", "PT1H0M"]


def test_amounts(spark):
    assert apply(spark, [Decimal("13049.00")], "decimal(10,2)", text.format_amount) == ["INR 13,049.00"]
    assert apply(spark, [5.0, 999.5, 123456.0, 12345678.0], "double", text.format_lakh) == ["₹5", "₹1,000", "₹1,23,456", "₹1,23,45,678"]


def test_hashes(spark):
    df = spark.createDataFrame([("DEL", "BOM", dt.date(2026, 5, 3))], "o string, d string, day date")
    seed, bucket = df.select(text.stable_seed("o", "d", "day"), text.hash_bucket_estimate("o", "d")).first()
    assert seed == int(hashlib.sha256(b"DEL|BOM|2026-05-03").hexdigest()[:12], 16) == 41037762788645
    assert bucket == 3000 + int(hashlib.md5(b"DELBOM").hexdigest(), 16) % 10000
    assert df.select(text.hash_equals(F.lit("123456"), F.lit(hashlib.sha256(b"123456").hexdigest()))).first()[0]


def test_names_and_messages(spark):
    rows = [("Ann Li", None, "a@x.com", "u1"), (None, "ann", "a@x.com", "u1"), (None, None, "a.b@x.com", "u1"), (None, None, None, "abcdefghij")]
    df = spark.createDataFrame(rows, "f string, n string, e string, i string")
    assert [r[0] for r in df.select(text.display_name("f", "n", "e", "i")).collect()] == ["Ann Li", "ann", "a.b", "User abcdefgh"]
    long = spark.range(1).select(text.confirmation_sms(F.lit("R" * 300), F.lit(Decimal("5.00")), "Fares")).first()[0]
    assert len(long) == 160 and long.startswith("Fares: Bkg R")


def test_calendar(spark):
    days = [dt.date(2026, 5, 3), dt.date(2027, 1, 1), dt.date(2026, 12, 31), dt.date(2026, 1, 2), dt.date(2026, 1, 3)]
    f = dates.calendar_features("x")
    df = column(spark, days, "date")
    got = [tuple(r) for r in df.orderBy("i").select(f["day_of_week"], f["week_of_year"], dates.is_holiday("x"), pricing.holiday_factor("x")).collect()]
    assert got == [(6, 18, False, 1.0), (4, 53, True, 1.24), (3, 53, True, 1.1), (4, 1, True, 1.1), (5, 1, False, 1.0)]
    assert apply(spark, [dt.date(2026, 5, 8)], "date", dates.is_weekend) == [False]
    assert apply(spark, [dt.date(2026, 5, 8)], "date", lambda c: dates.is_weekend(c, 4)) == [True]
    assert apply(spark, [6, 7, 9, 10, 18, 21, 22], "int", dates.is_peak_hour) == [False, True, True, False, True, True, False]
    assert apply(spark, ["2026-05-03", None, "", "03/05/2026"], "string", lambda c: dates.parse_date_default(c, "2026-01-01")) == [
        dt.date(2026, 5, 3), dt.date(2026, 1, 15), dt.date(2026, 1, 15), None
    ]
    assert apply(spark, [dt.date(2026, 1, 11), dt.date(2025, 1, 1), None], "date", lambda c: dates.days_until(c, "2026-01-01")) == [10, 0, 7]
    assert apply(spark, ["2026-05-03T10:00:00Z", "soon", None], "string", dates.parse_iso_ts) == [dt.datetime(2026, 5, 3, 10), None, None]


HOLIDAYS = {(1, 1), (1, 26), (8, 15), (10, 2), (12, 25)}


def py_demand(days, day, seats):
    pull = min(1.0, 0.72 / (1 + math.exp(-(14 - days) / 5.5)))
    season = {1: 0.26, 5: 0.26, 6: 0.26, 10: 0.26, 12: 0.26, 4: 0.12, 7: 0.12, 11: 0.12}.get(day.month, 0.0)
    s = max(1, min(60, seats))
    stock = round(1 + ((60 - s) / 60) ** 2 * 0.62, 4) - 1
    return min(1.0, pull * 0.58 + season * 1.05 + stock * 0.72)


def test_demand_score(spark):
    rows = [(d, dt.date(2026, m, 15), s) for d in (0, 2, 3, 14, 30, 31, 90) for m in (1, 2, 4) for s in (0, 1, 15, 57, 60, 99)]
    df = spark.createDataFrame(rows, "d int, day date, s int")
    for got, row in zip(df.select(pricing.demand_score("d", "day", "s")).collect(), rows):
        assert got[0] == pytest.approx(py_demand(*row), abs=1.01e-4)


def py_fare(base, air, days, day, cabin):
    if days > 30:
        adv = 0.7 + 0.1 * math.sin(days / 10)
    elif days < 3:
        adv = 1.8 + 0.2 * math.cos(days)
    else:
        adv = 1 + 0.5 * math.exp(-days / 12)
    season = {1: 1.26, 5: 1.26, 6: 1.26, 10: 1.26, 12: 1.26, 4: 1.12, 7: 1.12, 11: 1.12}.get(day.month, 1.0)
    raw = int(base * air * adv * (1.15 if day.weekday() >= 4 else 1.0) * season * {"ECONOMY": 1.0, "BUSINESS": 2.8}.get(cabin, 1.0))
    return raw // 100 * 100 + (99 if raw % 100 > 50 else 49) if raw > 1000 else raw


def test_fare_estimate(spark):
    rows = [
        (b, a, d, dt.date(2026, m, 10 + w), c)
        for b in (400.0, 4200.0) for a in (0.88, 1.28) for d in (0, 2, 3, 30, 31) for m in (2, 4, 5) for w in range(7) for c in ("ECONOMY", "BUSINESS", "?")
    ]
    df = spark.createDataFrame(rows, "b double, a double, d int, day date, c string")
    got = [r[0] for r in df.select(pricing.fare_estimate("b", "a", "d", "day", "c")).collect()]
    assert got == [py_fare(*r) for r in rows]
    assert spark.sql("select cast(null as double) b, cast(null as double) a, 10 d, date '2026-02-10' day, 'x' c").select(
        pricing.fare_estimate("b", "a", "d", "day", "c")
    ).first()[0] == py_fare(4500, 1.0, 10, dt.date(2026, 2, 10), "x")


def test_charm_rounding(spark):
    assert apply(spark, [999, 1000, 1001, 1050, 1051, 1100], "int", pricing.charm_round) == [999, 1000, 1049, 1049, 1099, 1149]


def test_alert_fare(spark):
    assert apply(spark, [0, 6, 7, 30, None], "int", lambda d: pricing.alert_fare(F.lit(4325.0), d)) == [
        round(4325 * 1.35 / 50) * 50, round(4325 * (1 + 1 / 7 * 0.35) / 50) * 50, 4300.0, 4300.0, 4300.0
    ]
    assert apply(spark, [None], "double", lambda b: pricing.alert_fare(b, F.lit(30))) == [5000.0]


def test_decision_thresholds(spark):
    assert apply(spark, [4.0, 3.999, -4.0, -3.999, None], "double", scores.pricing_trend) == ["RISING", "STABLE", "FALLING", "STABLE", "STABLE"]
    assert apply(spark, [4.0, 32.0, -8.0, -40.0, 1.0, None], "double", scores.pricing_score) == [0.25, 1.0, -0.5, -1.0, 0.0, 0.0]
    assert apply(spark, [0.62, 0.6199, 0.34, 0.3399], "double", scores.demand_level) == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert apply(spark, [0.5, 0.4999, 0.24, 0.2399], "double", scores.risk_level) == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert apply(spark, [3.0, 3.001, -3.001, 50.0, -50.0], "double", scores.change_trend) == ["STABLE", "RISING", "FALLING", "RISING", "FALLING"]
    got = apply(spark, [3.0, 10.0, 50.0, -10.0, -50.0], "double", scores.rise_probability)
    assert got == pytest.approx([0.8, 0.85, 0.95, 0.15, 0.05])
    got = apply(spark, [5.0, None], "double", scores.pricing_reason)
    assert got == ["Forecast average is 5.0% above the current fare.", "No forecast movement detected."]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(0, 1), st.floats(0, 1)), min_size=1, max_size=30))
def test_decision_in_range(spark, rows):
    df = spark.createDataFrame(rows, "p double, d double, r double")
    buy, wait = scores.buy_score("p", "d", "r"), scores.wait_score("p", "d")
    for (p, d, r), row in zip(rows, df.select(buy, wait, scores.decision(buy, wait), scores.decision_confidence(buy, wait)).collect()):
        b, w = max(0, p) * 0.44 + d * 0.36 + r * 0.2, max(0, -p) * 0.58 + (1 - d) * 0.28
        assert row[0] == pytest.approx(b) and row[1] == pytest.approx(w)
        assert row[2] == ("BOOK NOW" if row[0] >= row[1] else "WAIT")
        assert 0.52 <= row[3] <= 0.94


def test_nested_offers(spark):
    bodies = [
        '{"price":{"total":"100","base":"80"},"itineraries":[{"duration":"PT2H","segments":[{"origin":"DEL","departure_time":"t1"},{"destination":"BOM","arrival_time":"t2"}]}]}',
        '{"price":{"grandTotal":"1,200.5"},"itineraries":[{"segments":[{"departure":{"iataCode":"GOI","at":"t3"},"arrival":{"iataCode":"MAA","at":"t4"},"carrierCode":"6E"}]}]}',
        '{"itineraries":[{"segments":[]}]}', '{"itineraries":[]}', "not json", None,
    ]
    df = column(spark, bodies, "string").withColumn("offer", nested.parse_offer("x"))
    card, price = nested.trip_card("offer"), nested.offer_price("offer")
    got = df.orderBy("i").select(card["origin"], card["destination"], card["departure_time"], card["airline"], price["total_price"], price["base_fare"], nested.stops(nested.segments("offer"))).collect()
    assert tuple(got[0]) == ("DEL", "BOM", "t1", None, 100.0, 80.0, 1)
    assert tuple(got[1])[:5] == ("GOI", "MAA", "t3", "6E", 1200.5) and got[1][5] == pytest.approx(1020.425)
    for row in got[2:]:
        assert tuple(row) == (None, None, None, None, 0.0, 0.0, 0)


def test_passengers_get_defaults(spark):
    df = spark.createDataFrame(
        [(1, [("Asha", "Rao", None, 20), ("Kid", "Rao", "CHILD", None)]), (2, [])],
        "booking_id int, passengers array<struct<first_name:string,last_name:string,type:string,baggage_allowance:int>>",
    )
    rows = nested.explode_passengers(df).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["passenger_type"], r["baggage_kg"], r["seat_preference"], r["meal_preference"]) for r in rows] == [
        (1, "ADULT", 20, "WINDOW", "VEG"), (2, "CHILD", 15, "WINDOW", "VEG")
    ]
