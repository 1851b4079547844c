"""Relational operators, merges and ledgers on small frames with boundary rows."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from faresight.operators import aggregates as agg, alerts, filters, joins, ledger, merges, observations, offers, quality, signals, views
from faresight.plans import model, settlement
from faresight.sources import tables

relaxed = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
D = Decimal
NOW = "2026-05-01 12:00:00"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- quality -----------------------------------------------------------------------------------------------------------


@relaxed
@given(st.lists(st.tuples(st.sampled_from(["DEL", "del ", "BOM", "XX", None]), st.sampled_from(["DEL", "BOM", "", None]),
                          st.sampled_from(["2026-05-01", "soon", "", None])), min_size=1, max_size=25))
def test_valid_and_rejects_are_the_input(spark, requests):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "id int, origin string, destination string, departure_date string")
    valid, rejects = quality.validate(df, quality.request_rules())
    good, bad = {r["id"] for r in valid.collect()}, {r["id"]: r["reject_reasons"] for r in rejects.collect()}
    assert good | set(bad) == set(range(len(requests))) and not good & set(bad)
    for i, (o, d, day) in enumerate(requests):
        broken = []
        if not o or len(o.strip()) != 3:
            broken.append("origin_code")
        if not d or len(d.strip()) != 3:
            broken.append("destination_code")
        if o is None or d is None or o.strip().upper() == d.strip().upper():
            broken.append("same_place")
        if day == "soon":
            broken.append("departure_date")
        assert bad.get(i, []) == broken


def test_fill_defaults(spark):
    df = spark.createDataFrame([("7", 1.0, None), ("x", float("nan"), True), (None, None, False)], "a string, b double, c boolean")
    out = quality.fill_defaults(df, {"a": 50, "b": 0.5, "c": False, "d": 12})
    assert [tuple(r) for r in out.select("a", "b", "c", "d").collect()] == [(7.0, 1.0, False, 12), (50.0, 0.5, True, 12), (50.0, 0.5, False, 12)]


def test_aliases(spark):
    df = spark.createDataFrame([("", "b"), ("a", "b"), (None, " ")], "origin_code string, origin string")
    out = quality.coalesce_aliases(df, {"origin_code": ["origin_code", "origin"], "email": ["email"]})
    assert [tuple(r) for r in out.select("origin_code", "email").collect()] == [("b", None), ("a", None), (None, None)]


def test_reject_existing(spark):
    schema = "id int, user_id int, day string"
    old = spark.createDataFrame([(1, 7, "d1"), (2, 7, "d1")], schema)
    new = spark.createDataFrame([(10, 7, "d1"), (11, 7, "d2"), (12, 7, "d2"), (13, None, "d1"), (14, None, "d1")], schema)
    accepted, rejected = quality.reject_existing(new, old, ["user_id", "day"])
    assert rows(accepted, "id") == [(11,), (13,), (14,)]
    assert rows(rejected, "id", "existing_id") == [(10, 1), (12, 11)]


# -- filters -----------------------------------------------------------------------------------------------------------


def test_alert_lifecycle(spark):
    t = dt.datetime(2026, 5, 1, 12)
    d = dt.date(2026, 5, 1)
    data = [
        (1, True, None, d), (2, True, t + dt.timedelta(seconds=1), d), (3, True, t, d), (4, True, t - dt.timedelta(seconds=1), d),
        (5, True, None, d - dt.timedelta(days=1)), (6, False, None, d), (7, True, None, None),
    ]
    df = spark.createDataFrame(data, "id int, is_active boolean, expires_at timestamp, departure_date date")
    assert rows(filters.live_alerts(df, NOW), "id") == [(1,), (2,)]
    assert rows(filters.expire_alerts(df, NOW).filter("is_active"), "id") == [(1,), (2,), (3,), (7,)]


def test_price_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (799.99, 800.0, 60000.0, 60000.01, None)], "price double")
    assert filters.within_price_bounds(df).count() == 2
    assert filters.within_price_bounds(df, inclusive=False).count() == 0


def test_time_of_day(spark):
    df = spark.createDataFrame([(h, dt.datetime(2026, 1, 1, h)) for h in (0, 5, 6, 11, 12, 17, 18, 23)] + [(99, None)], "h int, departure_time timestamp")
    assert rows(filters.time_of_day(df, "MORNING"), "h") == [(11,), (6,)]
    assert rows(filters.time_of_day(df, "EVENING"), "h") == [(18,), (23,)]
    assert filters.time_of_day(df).count() == 9


def test_departures_on(spark):
    data = [(i, "DEL", "BOM", dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), "SCHEDULED") for i in range(-1, 30)]
    df = spark.createDataFrame(data, "id int, origin_code string, destination_code string, departure_time timestamp, status string")
    assert rows(filters.departures_on(df, "DEL", "BOM", "2026-01-01", limit=None), "id") == sorted([(i,) for i in range(24)], key=str)
    assert filters.departures_on(df, "DEL", "BOM", "2026-01-01").count() == 20


def test_masking(spark):
    df = spark.createDataFrame([(True, 0, 0.9), (True, 300, 0.1), (False, 3, 0.9), (True, 40, 0.2)], "is_live boolean, seats_available int, demand_score double")
    assert [tuple(r) for r in filters.mask_unobserved(df).select("seats_available", "demand_score").collect()] == [(1, 0.9), (100, 0.1), (50, 0.5), (40, 0.2)]
    assert [r[0] for r in filters.mask_unobserved(df, live_value=False).select("seats_available").collect()] == [50, 50, 3, 50]


def test_alert_records(spark):
    df = spark.createDataFrame(
        [(1, "u", "A", "B", D("100.00"), None, None, 0, None), (2, "u", "A", "B", D("100.00"), None, None, 2, D("90.00")), (3, "u", "A", "B", D("100.00"), None, None, None, D("0.00"))],
        "id int, user_id string, origin_code string, destination_code string, target_price decimal(10,2), departure_date date, created_at timestamp, triggered_count int, last_price decimal(10,2)",
    )
    assert [tuple(r) for r in filters.alert_records(df).select("triggered", "savings").collect()] == [(False, None), (True, 10.0), (False, None)]


# -- search ------------------------------------------------------------------------------------------------------------

AIRPORTS = [
    ("DEL", "New Delhi", "Indira Airport", "India", True, True), ("BOM", "Mumbai", "Shivaji Airport", "India", True, True),
    ("DXB", "Dubai", "Dubai Airport", "UAE", True, True), ("IXD", "Prayagraj", "Bamrauli", "India", False, True),
    ("ORD", "Chicago", "O'Hare del Airport", "USA", True, True), ("ZZZ", "Closed del", None, "India", True, False),
]


def places(spark):
    return spark.createDataFrame(AIRPORTS, "iata_code string, city string, name string, country string, is_international boolean, is_active boolean")


def test_search_equals_brute_force(spark):
    asked = ["del", "DEL", " del ", "d", "xb", "airport", "port", "zz", "q", "", "new delhi", "delhi india", "o'h"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    want = {
        (q, a[0]) for q in asked for a in AIRPORTS
        if q.strip() and any(q.strip().lower() in (f or "").lower() for f in a[:3])
    }
    assert set(rows(offers.search_airports(places(spark), queries), "query", "iata_code")) == want
    prefix = {
        (q, a[0]) for q in asked for a in AIRPORTS
        if q.strip() and a[5] and (a[0].lower().startswith(q.strip().lower()) or any(q.strip().lower() in (f or "").lower() for f in a[1:3]))
    }
    got = offers.search_airports(places(spark), queries, code_prefix_only=True)
    assert set(rows(got, "query", "iata_code")) == prefix


def test_airport_ranking(spark):
    hits = offers.search_airports(places(spark), spark.createDataFrame([("del",)], "query string"))
    ranked = offers.rank_airports(hits).orderBy("position")
    assert [r["iata_code"] for r in ranked.collect()] == ["DEL", "ZZZ", "ORD"]


def test_dedupe_keeps_keyless(spark):
    data = [("s", "o1", "F1", "t", 10.0), ("s", "o2", "F1", "t", 9.0), ("s", "o3", None, "t", 1.0), ("s", "o4", None, "t", 1.0), ("s", "o5", "F1", None, 2.0), ("z", "o6", "F1", "t", 50.0)]
    df = spark.createDataFrame(data, "search_id string, offer_id string, flight_number string, departure_time string, total double")
    assert rows(offers.dedupe_offers(df), "offer_id") == [("o2",), ("o3",), ("o4",), ("o5",), ("o6",)]
    assert rows(offers.mark_best_offer(df).filter("is_best"), "offer_id") == [("o3",), ("o6",)]


def test_duration_sort_is_numeric(spark):
    df = spark.createDataFrame([("a", "PT10H"), ("b", "PT2H"), ("c", "PT2H5M")], "offer_id string, duration string")
    assert [r[0] for r in offers.sort_offers(df, "duration").orderBy("position").select("offer_id").collect()] == ["b", "c", "a"]


def test_enrichment_edges(spark):
    df = spark.createDataFrame([("a", 1000.0, 1000.0), ("b", 5000.0, 5600.0), ("c", 5000.0, 5601.0), ("d", 5000.0, 4399.0), ("e", 5000.0, None), ("f", 90000.0, 99999.0)], "offer_id string, total double, predicted double")
    got = {r["offer_id"]: (r["ai_price"], r["recommendation"], r["trend"]) for r in offers.enrich_offers(df).collect()}
    assert got["a"] == (2800.0, "BOOK NOW", "INCREASING")
    assert got["b"][1] == ("BOOK NOW" if 5600.0 > 5000.0 * 1.12 else "FAIR PRICE")
    assert got["c"][1] == "BOOK NOW" and got["d"][1] == "WAIT"
    assert got["e"] == (5000.0, "MONITOR", "STABLE") and got["f"][0] == 55000.0


def test_downsample(spark):
    df = spark.createDataFrame([("A", "B", d) for d in range(1, 31)], "origin_code string, destination_code string, day int")
    ticks = offers.downsample_series(df, 7)
    dots = offers.downsample_series(df, 5, anchor=1)
    assert sorted(r["day"] for r in ticks.collect()) == [1, 7, 14, 21, 28, 30]
    assert sorted(r["day"] for r in dots.collect()) == [1, 6, 11, 16, 21, 26, 30]


# -- joins -------------------------------------------------------------------------------------------------------------


def test_connections_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    codes = "ABCDEF"
    fares = [(o, d, float(rnd.randrange(100, 900))) for o in codes for d in codes for _ in range(2) if rnd.random() < 0.8]
    low = {}
    for o, d, p in fares:
        if o != d:
            low[o, d] = min(p, low.get((o, d), 9e9))
    want = {(o, v, d, low[o, v] + low[v, d]) for (o, d) in low for v in codes if (o, v) in low and (v, d) in low and v not in (o, d) and low[o, v] + low[v, d] < low[o, d]}
    df = spark.createDataFrame(fares, "origin_code string, destination_code string, price double")
    assert set(rows(joins.connecting_routes(df), "origin_code", "via", "destination_code", "total_price")) == want and want


def test_connections_of_a_star_form_few_candidates(spark):
    """Spokes to and from one hub, and a few routes between spokes: candidates grow with the routes, not with their square."""
    n = 200
    hub = [("HUB", f"s{i}", 1000.0) for i in range(n)] + [(f"s{i}", "HUB", 10.0) for i in range(n)]
    df = spark.createDataFrame(hub + [(f"s{i}", f"s{i + 1}", 2000.0) for i in range(0, n, 2)], "origin_code string, destination_code string, price double")
    found = joins.connecting_routes(df)
    assert set(rows(found, "origin_code", "via", "destination_code")) == {(f"s{i}", "HUB", f"s{i + 1}") for i in range(0, n, 2)}
    found.collect()
    steps, made = [found._jdf.queryExecution().executedPlan()], []
    while steps:
        step = steps.pop()
        if step.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            step = step.executedPlan()
        if step.getClass().getSimpleName().endswith("QueryStageExec"):
            step = step.plan()
        if "Join" in step.nodeName() and step.metrics().contains("numOutputRows"):
            made.append(step.metrics().apply("numOutputRows").value())
        children = step.children()
        steps += [children.apply(i) for i in range(children.size())]
    assert made and max(made) <= 2 * (2 * n + n // 2)


def test_matches_with_hot_route(spark):
    alerts_ = spark.createDataFrame([(i, "A", "B", D(i % 7), i % 5 != 0) for i in range(300)] + [(1000, "A", "C", D(100), True)], "id int, origin_code string, destination_code string, target_price decimal(10,2), is_active boolean")
    fares = spark.createDataFrame([("A", "B", float(3 + i % 50)) for i in range(400)], "origin_code string, destination_code string, price double")
    got = joins.match_alerts(alerts_, fares)
    assert rows(got, "id") == sorted([(i,) for i in range(300) if i % 5 and i % 7 >= 3], key=str)


def test_dimensions_are_neither_counted_nor_hinted(spark):
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    df = spark.range(5).withColumn("k", F.col("id").cast("string"))
    out = joins.lookup_default(df, spark.range(3).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")), "k", {"v": 0})
    flagged = joins.known_routes(df.withColumn("d", F.lit("x")), df.select(F.col("k").alias("origin_code"), F.lit("x").alias("destination_code")), ["k", "d"])
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() == before
    assert "hint" not in (out._jdf.queryExecution().toString() + flagged._jdf.queryExecution().toString()).lower()
    assert sorted(r.v for r in out.collect()) == [0, 0, 1, 1, 1]


def test_payments_settle_once(spark):
    events = spark.createDataFrame([(2, "payment.captured", "o1", "p2"), (1, "order.paid", "o1", "p1"), (1, "payment.failed", "o2", "p3"), (1, "payment.captured", "o3", "p4"), (1, "payment.captured", None, "p5")], "ts int, event string, order_id string, payment_id string")
    booked = spark.createDataFrame([(1, "o1", "UNPAID"), (2, "o2", "UNPAID"), (3, "o3", "PAID"), (4, None, None)], "id int, order_id string, payment_status string")
    assert rows(joins.match_payments(events, booked), "id", "new_payment_id") == [(1, "p1")]


def test_lookup_default(spark):
    df = spark.createDataFrame([("6E",), ("ZZ",), (None,)], "airline_code string")
    dim = spark.createDataFrame([("6E", 0.91, "IndiGo")], "airline_code string, factor double, name string")
    out = joins.lookup_default(df, dim, "airline_code", {"factor": 1.0, "name": F.col("airline_code")})
    assert rows(out, "airline_code", "factor", "name") == [("6E", 0.91, "IndiGo"), ("ZZ", 1.0, "ZZ"), (None, 1.0, None)]


def test_visibility(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id int, auth_user_id string")
    booked = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, user_id int")
    pax = spark.createDataFrame([(10, "x"), (10, "y"), (11, "z")], "booking_id int, first_name string")
    own = joins.own_profiles(people, spark.createDataFrame([("a",)], "auth_user_id string"))
    assert rows(joins.visible_rows(booked, own), "id") == [(10,)]
    assert rows(joins.visible_through(pax, booked, own), "first_name") == [("x",), ("y",)]


# -- forecasts and decisions -------------------------------------------------------------------------------------------


def series(spark, points):
    return spark.createDataFrame([("A", k, i + 1, float(p)) for k, ps in points.items() for i, p in enumerate(ps)], "origin_code string, destination_code string, day int, price double")


def test_decision_matches_python(spark):
    import statistics

    points = {"none": [], "one": [900], "two": [1000, 1100], "flat": [1000] * 30, "up": list(range(1000, 1600, 20)), "down": list(range(2000, 1400, -20)), "long": [1000 + (i * 37) % 90 for i in range(40)]}
    current = {k: 1000.0 for k in points}
    snap = spark.createDataFrame([("A", k, current[k], i * 3, i * 7, i / 10) for i, k in enumerate(points)], "origin_code string, destination_code string, current_price double, days_until_departure int, seats_available int, demand_score double")
    got = {r["destination_code"]: r for r in signals.intelligence(snap, series(spark, points)).collect()}
    for i, (k, ps) in enumerate(points.items()):
        c = current[k]
        delta = (sum(ps[:14]) / len(ps[:14]) - c) / c * 100 if ps else 0
        pr = round(min(1, delta / 16), 4) if delta >= 4 else round(max(-1, delta / 16), 4) if delta <= -4 else 0
        dem = round(min(1, 1 / (i * 3 + 1) * 2.4 + max(0, min(1, (32 - i * 7) / 32)) * 0.55 + i / 10 * 0.35), 4)
        far = ps[:30]
        risk = round(min(1, statistics.pstdev(far) / c * 4 + (max(far) - min(far)) / c * 0.8), 4) if len(far) >= 2 else 0
        buy, wait = max(0, pr) * 0.44 + dem * 0.36 + risk * 0.2, max(0, -pr) * 0.58 + (1 - dem) * 0.28
        r = got[k]
        assert (r["pricing_score"], r["demand_points"], r["risk_score"]) == pytest.approx((pr, dem, risk), abs=1e-9)
        assert r["decision"] == ("BOOK NOW" if buy >= wait else "WAIT") and len(r["reasons"]) == 4
        assert r["confidence"] == pytest.approx(round(min(0.94, max(0.52, 0.56 + abs(buy - wait) * 0.55)), 2))
    assert got["one"]["change_percent"] == 0 and got["none"]["trend"] == "STABLE"


def test_best_day_takes_the_earliest_tie(spark):
    got = agg.best_worst_day(series(spark, {"t": [5, 3, 9, 3, 9]})).first()
    assert (got["best_day"], got["worst_day"]) == (2, 3)


def test_extent_of_a_flat_series(spark):
    df = series(spark, {"t": [10, 10]}).withColumns({"lower": F.col("price"), "upper": F.col("price")})
    assert tuple(agg.forecast_extent(df).select("axis_low", "axis_high").first()) == (9.92, 10.08)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 8.0), (20.0, 23.0)], "price double, prediction double")
    got = agg.regression_metrics(df).first()
    assert got["mae"] == 2.0 and got["rmse"] == pytest.approx((14 / 3) ** 0.5) and got["r2"] == pytest.approx(1 - 14 / 200)
    assert got["accuracy"] == pytest.approx((100 - (1 + 0.2 + 0.15) / 3 * 100) / 100)
    constant = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0)], "price double, prediction double")
    assert agg.regression_metrics(constant).first()["r2"] == 1.0


def test_fallback_forecast(spark):
    import math

    bases = spark.createDataFrame([("A", "B", 5000.0, "RISING"), ("A", "C", 500.0, "FALLING"), ("A", "D", 0.0, "STABLE")], "origin_code string, destination_code string, base_price double, trend string")
    got = model.fallback_forecast(bases, "2026-01-01").collect()
    assert len(got) == 90
    slopes = {"RISING": 0.006, "FALLING": -0.004, "STABLE": 0.001}
    for r in got:
        b, i = r["base_price"] or 5000.0, r["day"] - 1
        p = max(800, b + b * slopes[r["trend"]] * i + b * 0.025 * math.sin(2 * math.pi * (i + 3) / 7))
        assert (r["price"], r["lower"], r["upper"]) == (math.floor(p + 0.5), math.floor(p - b * 0.04 + 0.5), math.floor(p + b * 0.04 + 0.5))
        assert r["date"] == dt.date(2026, 1, 1) + dt.timedelta(days=r["day"])


# -- merges ------------------------------------------------------------------------------------------------------------

key = st.tuples(st.sampled_from("ABCD"), st.sampled_from("ABCD"))


@relaxed
@given(st.dictionaries(key, st.integers(0, 9), min_size=1, max_size=10))
def test_reverse_routes_close_the_table(spark, table):
    df = spark.createDataFrame([(o, d, v) for (o, d), v in table.items()], "origin_code string, destination_code string, n int")
    got = {(r[0], r[1]): r[2] for r in merges.with_reverse_routes(df).collect()}
    want = {**{(d, o): v for (o, d), v in table.items()}, **table}
    assert got == want


@relaxed
@given(st.dictionaries(st.integers(0, 5), st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1), st.dictionaries(st.integers(0, 9), st.tuples(st.one_of(st.none(), st.integers(10, 19)), st.integers(10, 19)), min_size=1))
def test_upsert(spark, old, new):
    base = spark.createDataFrame([(k, *v) for k, v in old.items()], "id int, a int, b int")
    incoming = spark.createDataFrame([(k, *v) for k, v in new.items()], "id int, a int, b int")

    def run(df):
        return merges.upsert(df, incoming, "id", update=["a"], keep_when_null=["a"])

    want = dict(old)
    for k, (a, b) in new.items():
        want[k] = (a, b) if k not in old else (old[k][0] if a is None else a, old[k][1])
    once = run(base)
    assert {r["id"]: (r["a"], r["b"]) for r in once.collect()} == want
    twice = run(spark.createDataFrame([tuple(r) for r in once.collect()], "id int, a int, b int"))
    assert {r["id"]: (r["a"], r["b"]) for r in twice.collect()} == want


def test_patch_and_touch(spark):
    t0 = dt.datetime(2020, 1, 1)
    base = spark.createDataFrame([(1, "a", "x", t0), (2, "b", "y", t0)], "id int, name string, tier string, updated_at timestamp")
    changes = spark.createDataFrame([(1, None, "z", ["name"])], "id int, name string, tier string, supplied array<string>")
    got = rows(merges.patch(base, changes, "id", "supplied", NOW), "id", "name", "tier", "updated_at")
    assert got == [(1, None, "x", dt.datetime(2026, 5, 1, 12)), (2, "b", "y", t0)]
    assert rows(merges.patch(base, changes.drop("supplied"), "id"), "id", "name", "tier") == [(1, "a", "z"), (2, "b", "y")]


def test_split_trips(spark):
    df = spark.createDataFrame([(1, "2026-05-01T12:00:01Z"), (2, "2026-05-01T12:00:00Z"), (3, None), (4, "soon"), (5, "2026-05-01T13:30:00+02:00")], "id int, departure_time string")
    assert rows(merges.split_trips(df, NOW).filter("is_upcoming"), "id") == [(1,)]


# -- ledgers -----------------------------------------------------------------------------------------------------------

VERSIONS = [  # id, user, total, old status, new status
    (1, "u1", "49999.99", "UNPAID", "PAID"), (2, "u2", "50000.00", "UNPAID", "PAID"), (3, "u3", "150000.00", None, "PAID"),
    (4, "u4", "500000.00", "UNPAID", "PAID"), (5, "u5", "99.99", "PAID", "PAID"), (6, "u5", "100.00", "UNPAID", "PAID"),
    (7, None, "700.00", "UNPAID", "PAID"), (8, "u6", "900.00", "PAID", "VOID"), (9, "u6", "0.00", "UNPAID", "PAID"),
]


def versions(spark):
    schema = "id int, user_id string, total_price decimal(10,2), status string, payment_status string, booking_reference string, contact_email string, contact_phone string"
    make = lambda at: [(v[0], v[1], D(v[2]), "PENDING", v[at], f"R{v[0]}", None if v[0] == 2 else "a@x", "98" if v[0] != 3 else None) for v in VERSIONS]
    people = spark.createDataFrame(
        [(f"u{i}", 0, "BLUE", 0, D("0.00"), i != 4, i != 1) for i in range(1, 8)],
        "id string, loyalty_points int, tier string, total_bookings int, total_spent decimal(12,2), notify_email boolean, notify_sms boolean",
    )
    return spark.createDataFrame(make(3), schema), spark.createDataFrame(make(4), schema), people


def test_loyalty(spark):
    old, new, people = versions(spark)
    got = {r["id"]: (r["loyalty_points"], r["total_bookings"], r["tier"]) for r in ledger.award_loyalty(old, new, people).collect()}
    assert got == {"u1": (499, 1, "BLUE"), "u2": (500, 1, "SILVER"), "u3": (1500, 1, "GOLD"), "u4": (5000, 1, "PLATINUM"),
                   "u5": (1, 1, "BLUE"), "u6": (0, 1, "BLUE"), "u7": (0, 0, "BLUE")}


def test_confirmations(spark):
    old, new, people = versions(spark)
    booked, notes = ledger.confirm_bookings(old, new, people, "Fares")
    assert {r["id"] for r in booked.filter("status = 'CONFIRMED'").collect()} == {1, 2, 3, 4, 6, 7, 9}
    assert rows(notes, "booking_id", "channel") == [(1, "EMAIL"), (2, "SMS"), (3, "EMAIL"), (4, "SMS"), (6, "EMAIL"), (6, "SMS"), (9, "EMAIL"), (9, "SMS")]
    assert notes.filter("booking_id = 1").first()["message"] == "Your Fares booking is confirmed. Amount: Rs.49999.99"


def test_cancellation(spark):
    df = spark.createDataFrame([(1, "CONFIRMED", "PAID"), (2, "PENDING", "UNPAID"), (3, "CANCELLED", "PAID"), (4, "PENDING", None), (5, "CONFIRMED", "PAID")], "id int, status string, payment_status string")
    out = ledger.cancel_bookings(df, spark.createDataFrame([(1,), (2,), (3,), (4,), (1,)], "id int"), NOW)
    assert rows(out, "id", "status", "payment_status", "refund_status") == [
        (1, "CANCELLED", "REFUND_PENDING", "PROCESSING"), (2, "CANCELLED", "VOID", "NONE"), (3, "CANCELLED", "PAID", None), (4, "CANCELLED", "VOID", "NONE"), (5, "CONFIRMED", "PAID", None)
    ]


def test_coupons(spark):
    t = dt.datetime(2026, 1, 1)
    coupons = spark.createDataFrame(
        [("CAP", "PERCENT", D(10), D(50), D(0), None, 0, None, None, None, True), ("FLAT", "FLAT", D(500), None, D(100), None, 0, None, None, None, True),
         ("LIM", "FLAT", D(1), None, None, 3, 1, 1, None, None, True), ("OLD", "FLAT", D(1), None, None, None, 0, None, None, t, True), ("OFF", "FLAT", D(1), None, None, None, 0, None, None, None, False)],
        "code string, discount_type string, discount_value decimal(10,2), max_discount decimal(10,2), min_booking_amt decimal(10,2), usage_limit int, used_count int, per_user_limit int, valid_from timestamp, valid_until timestamp, is_active boolean",
    )
    data = [(1, "a", "1000.00", "CAP"), (2, "a", "100.00", "CAP"), (3, "a", "99.99", "FLAT"), (4, "a", "300.00", "FLAT"), (5, "a", "10.00", "LIM"), (6, "a", "10.00", "LIM"), (7, "b", "10.00", "LIM"), (8, "c", "10.00", "LIM"), (9, "a", "10.00", "OLD"), (10, "a", "10.00", "OFF"), (11, "a", "10.00", None), (12, "a", "10.00", "NONE")]
    booked = spark.createDataFrame([(i, u, D(p), c, t + dt.timedelta(hours=i)) for i, u, p, c in data], "id int, user_id string, total_price decimal(10,2), coupon_code string, created_at timestamp")
    got = {r["id"]: float(r["discount_amount"]) for r in ledger.apply_coupon(booked, coupons, NOW).collect()}
    assert got == {1: 50.0, 2: 10.0, 3: 0.0, 4: 300.0, 5: 1.0, 6: 0.0, 7: 1.0, 8: 0.0, 9: 0.0, 10: 0.0, 11: 0.0, 12: 0.0}


def test_coupon_limits_are_not_shared_by_unknown_customers(spark):
    booked = spark.createDataFrame([(i, None, "C", D(100), NOW) for i in range(4)], "id int, user_id string, coupon_code string, total_price decimal(10,2), created_at string")
    shape = "code string, discount_type string, discount_value decimal(10,2), max_discount decimal(10,2), min_booking_amt decimal(10,2), usage_limit int, used_count int, per_user_limit int, valid_from timestamp, valid_until timestamp, is_active boolean"
    coupons = spark.createDataFrame([("C", "FLAT", D(10), None, D(0), 3, 0, 1, None, None, True)], shape)
    out = ledger.apply_coupon(booked, coupons, NOW)
    assert sorted(float(r.discount_amount) for r in out.collect()) == [0.0, 10.0, 10.0, 10.0]


def test_booking_refs_read_each_table_once(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "new"))
    spark.range(9).selectExpr("concat('R', id) as booking_reference").write.parquet(str(tmp_path / "old"))
    out = ledger.assign_booking_refs(spark.read.parquet(str(tmp_path / "new")), spark.read.parquet(str(tmp_path / "old")), NOW)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2 and out.count() == 50


def test_settlement_changes_only_what_was_paid(spark):
    shape = "id int, user_id string, order_id string, total_price decimal(10,2), status string, payment_status string, booking_reference string, contact_email string, contact_phone string"
    booked = spark.createDataFrame([
        (1, "u", "o1", D(1250), "PENDING", "UNPAID", "B1", "a@b", "1"), (2, "u", "o2", D(900), "CONFIRMED", "PAID", "B2", "a@b", "1"), (3, "v", "o3", D(100), "PENDING", None, "B3", None, "2"),
        (4, None, "o4", D(77), "PENDING", "UNPAID", "B4", "c@d", None), (5, "v", "o5", D(9), "PENDING", "UNPAID", "B5", None, "2"),
    ], shape)
    people = spark.createDataFrame([("u", 5, 1, D(50), "BLUE", True, True), ("v", 0, 0, D(0), "BLUE", True, False)], "id string, loyalty_points long, total_bookings long, total_spent decimal(12,2), tier string, notify_email boolean, notify_sms boolean")
    events = spark.createDataFrame([(2, "payment.captured", "o1", "p2"), (1, "order.paid", "o1", "p1"), (1, "payment.captured", "o2", "p3"), (1, "payment.failed", "o5", "p4"), (3, "payment.captured", "o3", "p5"), (3, "payment.captured", "o4", "p6"), (3, "payment.captured", "ox", "p7")], "ts int, event string, order_id string, payment_id string")
    out = settlement.settle_payments(events, booked, people)
    got = {r.id: (r.status, r.payment_status, r.payment_id, r.points_earned) for r in out.bookings.collect()}
    assert got == {1: ("CONFIRMED", "PAID", "p1", 12), 2: ("CONFIRMED", "PAID", None, None), 3: ("CONFIRMED", "PAID", "p5", 1), 4: ("CONFIRMED", "PAID", "p6", 0), 5: ("PENDING", "UNPAID", None, None)}
    assert {r.id: (r.loyalty_points, r.total_bookings, float(r.total_spent)) for r in out.profiles.collect()} == {"u": (17, 2, 1300.0), "v": (1, 1, 100.0)}
    assert rows(out.notifications, "booking_id", "channel") == [(1, "EMAIL"), (1, "SMS")]
    again = settlement.settle_payments(events, out.bookings, people)
    assert again.notifications.isEmpty() and rows(again.bookings, "id", "payment_id", "points_earned") == rows(out.bookings, "id", "payment_id", "points_earned")


def test_records_follow_from_the_fare(spark):
    rows_ = [(1, dt.date(2026, 1, 2), dt.datetime(2025, 12, 30, 8), 60), (2, dt.date(2025, 12, 1), dt.datetime(2025, 12, 30, 22), 1), (3, None, dt.datetime(2026, 1, 1), 5), (4, dt.date(2026, 5, 3), None, 5)]
    df = spark.createDataFrame(rows_, "id int, departure_date date, recorded_at timestamp, seats_available int")
    got = {r.id: r for r in observations.record_fares(df).collect()}
    assert (got[1].days_until_dep, got[1].urgency, got[1].day_of_week, got[1].month, got[1].week_of_year, got[1].hour_of_day, got[1].is_peak_hour, got[1].is_holiday, got[1].is_weekend) == (3, 0.25, 4, 1, 1, 8, 1, True, False)
    assert got[2].days_until_dep == 0 and got[2].urgency == 1.0 and got[2].is_peak_hour == 0 and got[2].demand_score > got[1].demand_score - 1
    assert got[3].month is None and got[4].is_weekend is True and got[4].days_until_dep in (0, None)
    assert observations.record_fares(df.withColumn("month", F.lit(99))).first().month == 99


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    import os

    path = str(tmp_path / "table")
    base = spark.range(100).selectExpr("id", "cast(id % 10 as int) as part", "cast(null as string) as name")
    base.write.partitionBy("part").parquet(path)
    stamp = lambda: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}
    before, read = stamp(), []

    def merge(old, new):
        read.append(sorted(str(r[0]) for r in old.select("part").distinct().collect()))
        return merges.patch(old, new, ["id", "part"])

    changes = base.filter("id in (3, 13, 7)").withColumn("name", F.lit("new"))
    for _ in range(2):
        tables.rewrite_partitions(spark, path, changes, merge, "part")
    after = stamp()
    kept = {f for f in before if f in after}
    assert len(kept) >= 1 and all(after[f] == before[f] for f in kept) and read == [["3", "7"]] * 2
    now = spark.read.parquet(path)
    assert now.count() == 100 and sorted(r.id for r in now.filter("name = 'new'").collect()) == [3, 7, 13]
    tables.rewrite_partitions(spark, path, changes.filter("false"), merge, "part")
    assert stamp() == after


def test_booking_refs_are_unique(spark):
    # One-digit references collide at once, so every fallback is used.
    new = spark.range(400).withColumnRenamed("id", "id")
    from faresight.functions import text

    first = new.select(text.booking_ref("id", NOW).alias("booking_reference")).limit(50)
    taken = spark.createDataFrame(first.collect(), "booking_reference string")
    out = ledger.assign_booking_refs(new, taken, NOW)
    refs = [r["booking_reference"] for r in out.collect()]
    assert len(refs) == 400 == len(set(refs)) and not set(refs) & {r[0] for r in taken.collect()}
    assert all(r.startswith("SKY26") for r in refs)


def test_welcome(spark):
    schema = "id string, email string, phone string, full_name string, name string, email_confirmed_at timestamp, phone_confirmed_at timestamp"
    users = spark.createDataFrame([("abcdefghijk", None, "1", None, None, None, None), ("u2", "b.c@x", None, None, None, dt.datetime(2026, 1, 1), None)], schema)
    people = spark.createDataFrame([("p2", "u2")], "id string, auth_user_id string")
    profile_rows, notes = ledger.welcome_rows(people, users, "Fares")
    assert rows(profile_rows, "auth_user_id", "display_name", "email_verified") == [("abcdefghijk", "User abcdefgh", False), ("u2", "b.c", True)]
    assert rows(notes, "user_id", "subject") == [("p2", "Welcome to Fares!")]


def test_channels(spark):
    df = spark.createDataFrame([(1, True, True, True, "e", "p"), (2, False, True, True, "e", "p"), (3, True, False, True, None, "p"), (4, True, True, True, " ", None)], "id int, notify_email boolean, notify_sms boolean, notify_whatsapp boolean, email string, phone string")
    assert rows(alerts.route_channel(df), "id", "channel", "recipient") == [(1, "EMAIL", "e"), (2, "SMS", "p"), (3, "WHATSAPP", "p"), (4, None, None)]
    assert rows(alerts.notify_channels(df, "email", "phone"), "id", "channel") == [(1, "EMAIL"), (1, "SMS"), (1, "WHATSAPP"), (2, "SMS"), (2, "WHATSAPP"), (3, "WHATSAPP")]


def test_alert_evaluation(spark):
    df = spark.createDataFrame([(1, "A", "B", dt.date(2026, 5, 1), D("6750.00"), True, 1, None), (2, "A", "B", dt.date(2026, 5, 1), D("6749.99"), True, None, None), (3, "A", "C", None, D("5000.00"), True, 0, None), (4, "A", "B", dt.date(2026, 5, 1), D("9999.00"), False, 0, D("7.00")), (5, "", "B", None, D("9999.00"), True, 0, D("8.00"))], "id int, origin_code string, destination_code string, departure_date date, target_price decimal(10,2), is_active boolean, triggered_count int, last_price decimal(10,2)")
    bases = spark.createDataFrame([("A", "B", 5000.0)], "origin_code string, destination_code string, base double")
    updated, triggers = alerts.evaluate_alerts(alerts.price_alerts_now(df, bases, NOW))
    assert rows(updated, "id", "last_price", "triggered_count") == [(1, 6750.0, 2), (2, 6750.0, 0), (3, 5000.0, 1), (4, 7.0, 0), (5, 8.0, 0)]
    assert rows(triggers, "id") == [(1,), (3,)]


def test_latest_challenge(spark):
    t = dt.datetime(2026, 5, 1, 12)
    data = [(1, "u", "A", True, 0, t, t), (2, "u", "A", False, 0, t + dt.timedelta(hours=1), t - dt.timedelta(hours=1)), (3, "u", "B", False, 5, t + dt.timedelta(hours=1), t), (4, "v", "A", False, 0, t - dt.timedelta(seconds=1), t)]
    df = spark.createDataFrame([(i, u, p, used, a, 5, e, c) for i, u, p, used, a, e, c in data], "id int, user_id string, purpose string, is_used boolean, attempts int, max_attempts int, expires_at timestamp, created_at timestamp")
    assert rows(ledger.latest_challenge(df, NOW), "id", "is_valid") == [(2, True), (3, False), (4, False)]


def test_first_passenger(spark):
    booked = spark.createDataFrame([(1,), (2,)], "id int")
    pax = spark.createDataFrame([(1, 2, "B"), (1, 1, "A")], "booking_id int, ordinal int, first_name string")
    assert rows(views.first_passenger_name(booked, pax), "id", "passenger_name") == [(1, "A"), (2, "Traveller")]
