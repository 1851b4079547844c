"""Registered queries: ordered features, calendar, text and nested helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, nested, pricing, text
from ..operators import aggregates as agg, alerts as alerting, ledger, offers as search
from ..sources import star
from . import model

from .oracle_tables import even
from .registry import query

ROUTE = list(agg.ROUTE)
R = "origin_code, destination_code"
_ORDER = "recorded_at, l_orderkey, l_linenumber, departure_date, l_partkey, l_suppkey"


# -- ordered operators ------------------------------------------------------------------------------------------------


@query(
    "price_changes", "W1", "bounded_history",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, departure_date, price,
              round(coalesce(price - lag(price, 1) OVER w, 0), 4) AS price_change_1d,
              round(coalesce(price - lag(price, 3) OVER w, 0), 4) AS price_change_3d
            FROM bounded_history WINDOW w AS (PARTITION BY {R} ORDER BY {_ORDER})""",
)
def price_changes(spark, sf):
    history = star.bounded_history(spark, sf).select(*ROUTE, *star.ORDER, "price")
    out = model.price_changes(history, star.ORDER)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "departure_date", "price",
        F.round("price_change_1d", 4).alias("price_change_1d"), F.round("price_change_3d", 4).alias("price_change_3d"),
    )


@query(
    "dedupe_offers", "W2", "offers",
    sql="""SELECT search_id, offer_id, total FROM offers QUALIFY flight_number IS NULL OR
             row_number() OVER (PARTITION BY search_id, flight_number, departure_time ORDER BY total, offer_id) = 1""",
)
def dedupe_offers(spark, sf):
    return search.dedupe_offers(star.offers(spark, sf)).select("search_id", "offer_id", "total")


@query(
    "latest_challenge", "W3", "challenges",
    sql=f"""SELECT id, user_id, purpose, expires_at >= TIMESTAMP '{star.EVENT_AS_OF}' AND attempts < max_attempts AS is_valid
            FROM challenges WHERE NOT is_used
            QUALIFY row_number() OVER (PARTITION BY user_id, purpose ORDER BY created_at DESC, id DESC) = 1""",
)
def latest_challenge(spark, sf):
    return ledger.latest_challenge(star.challenges(star.events(spark, sf)), star.EVENT_AS_OF).select(
        "id", "user_id", "purpose", "is_valid"
    )


@query(
    "first_last_change", "W4", "forecast",
    sql=f"""SELECT {R}, count(*) AS points, round(CASE WHEN count(*) >= 2 AND arg_min(price, day) > 0
              THEN (arg_max(price, day) - arg_min(price, day)) / arg_min(price, day) * 100 ELSE 0 END, 6) AS change_percent
            FROM forecast GROUP BY 1, 2""",
)
def first_last_change(spark, sf):
    return agg.first_last_change(star.forecast(spark, sf)).select(
        *ROUTE, "points", F.round("change_percent", 6).alias("change_percent")
    )


@query(
    "lowest_seen", "W5", "bounded_history",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, departure_date, min(price) OVER
              (PARTITION BY {R} ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS lowest_seen FROM bounded_history""",
)
def lowest_seen(spark, sf):
    seen = star.bounded_history(spark, sf).select(*ROUTE, *star.ORDER, "price")
    out = alerting.lowest_seen(seen, star.ORDER, keys=ROUTE)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "departure_date", "lowest_seen")


@query(
    "label_index", "W6 M2", "price_history",
    sql=f"""SELECT 'airline_code' AS column, value, row_number() OVER (ORDER BY value) AS label
              FROM (SELECT DISTINCT upper(airline_code) AS value FROM price_history)
            UNION ALL SELECT 'part_name', value, row_number() OVER (ORDER BY value)
              FROM (SELECT DISTINCT upper(p_name) AS value FROM part)""",
)
def label_index(spark, sf):
    carriers = model.label_index(star.price_history(spark, sf), "airline_code").withColumn("column", F.lit("airline_code"))
    names = model.label_index(star.raw(spark, sf, "part"), "p_name").withColumn("column", F.lit("part_name"))
    return carriers.unionByName(names)


@query(
    "encode_categories", "M2 W6", "bounded_history",
    sql=f"""SELECT o.label AS origin_label, coalesce(a.label, 0) AS airline_label, count(*) AS fares FROM bounded_history h
              JOIN (SELECT value, row_number() OVER (ORDER BY value) AS label FROM (SELECT DISTINCT origin_code AS value FROM bounded_history)) o
                ON h.origin_code = o.value
              LEFT JOIN (SELECT value, row_number() OVER (ORDER BY value) AS label FROM
                          (SELECT DISTINCT airline_code AS value FROM bounded_history WHERE cabin_class = 'FIRST' AND airline_code < 'BRAND#3')) a
                ON h.airline_code = a.value GROUP BY 1, 2""",
)
def encode_categories(spark, sf):
    history = star.bounded_history(spark, sf).select(*ROUTE, "airline_code", "cabin_class")
    known = history.filter("cabin_class = 'FIRST' and airline_code < 'BRAND#3'")
    encoders = model.fit_encoders(history, ["origin_code"]).unionByName(model.fit_encoders(known, ["airline_code"]))
    coded = model.apply_encoders(history, encoders, ["origin_code", "airline_code"])
    return coded.groupBy(F.col("origin_code").alias("origin_label"), F.col("airline_code").alias("airline_label")).agg(
        F.count(F.lit(1)).alias("fares")
    )


@query(
    "leading_points", "W7", "forecast",
    sql=f"SELECT {R}, day, round(price, 6) AS price, day AS point FROM forecast WHERE day <= 7",
)
def leading_points(spark, sf):
    return agg.leading_points(star.forecast(spark, sf), 7).select(*ROUTE, "day", F.round("price", 6).alias("price"), "point")


@query(
    "mark_best_offer", "W8", "offers",
    sql="""SELECT offer_id, row_number() OVER (PARTITION BY search_id ORDER BY total, offer_id) = 1 AS is_best FROM offers""",
)
def mark_best_offer(spark, sf):
    return search.mark_best_offer(star.offers(spark, sf)).select("offer_id", "is_best")


@query(
    "recent_per_user", "W9", "bookings",
    sql="""SELECT id, user_id, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position
           FROM bookings) WHERE position <= 10""",
)
def recent_per_user(spark, sf):
    return search.recent_per_user(star.bookings(spark, sf), 10).select("id", "user_id", "position")


_TIER = """CASE WHEN {0} >= 500000 THEN 'PLATINUM' WHEN {0} >= 150000 THEN 'GOLD' WHEN {0} >= 50000 THEN 'SILVER' ELSE 'BLUE' END"""


@query(
    "tier_progress", "W10", "bookings",
    sql=f"""SELECT id, CAST(spend AS DOUBLE) AS running_spend, {_TIER.format('spend')} AS tier FROM
              (SELECT id, sum(total_price) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS spend
               FROM bookings WHERE payment_status = 'PAID')""",
)
def tier_progress(spark, sf):
    return ledger.tier_progress(star.bookings(spark, sf)).select(
        "id", F.col("running_spend").cast("double").alias("running_spend"), "tier"
    )


@query(
    "downsample_series", "W11", "bounded_history",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, departure_date, position FROM
              (SELECT *, row_number() OVER (PARTITION BY {R} ORDER BY {_ORDER}) AS position,
                      count(*) OVER (PARTITION BY {R}) AS total FROM bounded_history)
            WHERE position % 7 = 0 OR position = 1 OR position = total""",
)
def downsample_series(spark, sf):
    series = star.bounded_history(spark, sf).select(*ROUTE, *star.ORDER)
    one = F.struct(*star.ORDER).alias("at")
    out = search.downsample_series(series.withColumn("at", one), 7, order="at")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "departure_date", "position")


# -- text -------------------------------------------------------------------------------------------------------------


@query(
    "resolve_code", "F1 F2",
    sql="""SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS plain, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'RED'
             WHEN 'blue' THEN 'B01' ELSE upper(substr(p_name, 1, 3)) END AS code,
             CASE WHEN p_type = 'PROMO' THEN 'DEL' ELSE upper(p_name) END AS city FROM part""",
)
def resolve_code(spark, sf):
    part = star.raw(spark, sf, "part")
    color = F.split_part("p_name", F.lit(" "), F.lit(1))
    typed = F.when(color == "red", F.lit(" red ")).when(color == "blue", F.concat("p_name", F.lit(" (b01)"))).otherwise(F.col("p_name"))
    place = F.when(F.col("p_type") == "PROMO", F.lit(" New Delhi ")).otherwise(F.col("p_name"))
    return part.select(
        "p_partkey", text.norm_code(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("plain"),
        text.resolve_code(typed).alias("code"), text.resolve_city(place).alias("city"),
    )


@query(
    "stable_seed", "F3", "price_history",
    sql=f"""SELECT {R}, departure_date, CAST('0x' || substr(sha256(origin_code || '|' || destination_code || '|' || departure_date), 1, 12) AS BIGINT) AS seed
            FROM (SELECT DISTINCT {R}, departure_date FROM price_history)""",
)
def stable_seed(spark, sf):
    days = star.price_history(spark, sf).select(*ROUTE, "departure_date").distinct()
    return days.withColumn("seed", text.stable_seed(*ROUTE, "departure_date"))


_MD5_MOD = """CAST((((CAST('0x' || substr(m, 1, 8) AS BIGINT) % 10000 * 7296 + CAST('0x' || substr(m, 9, 8) AS BIGINT)) % 10000 * 7296
   + CAST('0x' || substr(m, 17, 8) AS BIGINT)) % 10000 * 7296 + CAST('0x' || substr(m, 25, 8) AS BIGINT)) % 10000 AS BIGINT)"""


@query(
    "hash_bucket_estimate", "F4", "alerts",
    sql=f"SELECT id, CAST(3000 + {_MD5_MOD} AS DOUBLE) AS estimate FROM (SELECT id, md5(origin_code || destination_code) AS m FROM alerts)",
)
def hash_bucket_estimate(spark, sf):
    return star.alerts(spark, sf).select("id", text.hash_bucket_estimate(*ROUTE).alias("estimate"))


def _ref(key: str, salt: int, digits: int) -> str:
    return f"'SKY98' || upper(substr(md5({key} || '#{salt}'), 1, {digits}))"


@query(
    "booking_refs", "F5", "bookings",
    sql=f"""SELECT id, CASE WHEN row_number() OVER (PARTITION BY r0 ORDER BY id) = 1 THEN r0 ELSE r1 END AS booking_reference FROM
              (SELECT id, {_ref('id', 0, 6)} AS r0, {_ref('id', 1, 6)} AS r1 FROM bookings)""",
)
def booking_refs(spark, sf):
    booked = star.bookings(spark, sf)
    return ledger.assign_booking_refs(booked.select("id"), booked.select("booking_reference"), star.AS_OF)


@query(
    "display_name", "F6", "users",
    sql="SELECT id, coalesce(full_name, name, split_part(email, '@', 1), 'User ' || substr(id, 1, 8)) AS display_name FROM users",
)
def display_name(spark, sf):
    return star.users(spark, sf).select("id", text.display_name("full_name", "name", "email", "id").alias("display_name"))


@query(
    "message_text", "F7", "bookings",
    sql="""SELECT id, 'Booking ' || booking_reference || ' Confirmed!' AS subject,
              'Your Faresight booking is confirmed. Amount: Rs.' || total_price AS mail,
              substr('Faresight: Bkg ' || booking_reference || ' confirmed! Rs.' || total_price, 1, 40) AS sms FROM bookings""",
)
def message_text(spark, sf):
    return star.bookings(spark, sf).select(
        "id", text.confirmation_subject("booking_reference").alias("subject"),
        text.confirmation_email("total_price", "Faresight").alias("mail"),
        text.confirmation_sms("booking_reference", "total_price", "Faresight", limit=40).alias("sms"),
    )


@query(
    "format_amount", "F8", "bookings",
    sql="""SELECT id, 'INR ' || format('{:,.2f}', CAST(total_price AS DOUBLE)) AS amount, '₹' || CASE WHEN n < 1000 THEN '' || n
              WHEN n < 100000 THEN n // 1000 || ',' || lpad('' || n % 1000, 3, '0')
              ELSE n // 100000 || ',' || lpad('' || n // 1000 % 100, 2, '0') || ',' || lpad('' || n % 1000, 3, '0') END AS lakh
           FROM (SELECT id, total_price, CAST(floor(CAST(total_price AS DOUBLE) + 0.5) AS BIGINT) AS n FROM bookings)""",
)
def format_amount(spark, sf):
    return star.bookings(spark, sf).select(
        "id", text.format_amount("total_price").alias("amount"),
        text.format_lakh(F.col("total_price").cast("double")).alias("lakh"),
    )


@query(
    "durations", "F9", "offers",
    sql="""SELECT offer_id, seats_available * 13 AS minutes, (seats_available * 13) // 60 || 'h ' || (seats_available * 13) % 60 || 'm' AS shown,
              duration AS iso FROM offers""",
)
def durations(spark, sf):
    minutes = text.duration_minutes("duration")
    return star.offers(spark, sf).select(
        "offer_id", minutes.alias("minutes"), text.format_duration("duration").alias("shown"), text.iso_duration(minutes).alias("iso")
    )


@query(
    "safe_number", "F10", "bookings",
    sql="""SELECT id, CASE booking_source WHEN 'APP' THEN 0 ELSE CAST(total_price AS DOUBLE) END AS money,
              CAST(user_id AS DOUBLE) AS share FROM bookings""",
)
def safe_number(spark, sf):
    shown = F.when(F.col("booking_source") == "APP", "n/a").otherwise(F.format_number("total_price", 2))
    return star.bookings(spark, sf).select(
        "id", text.safe_number(shown).alias("money"),
        text.safe_number(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("% "))).alias("share"),
    )


@query(
    "canon_recommendation", "F11", "bookings",
    sql="""SELECT id, CASE status WHEN 'CONFIRMED' THEN 'BOOK_NOW' WHEN 'PENDING' THEN 'WAIT' ELSE 'MONITOR' END AS recommendation FROM bookings""",
)
def canon_recommendation(spark, sf):
    said = F.when(F.col("status") == "CONFIRMED", "buy-now").when(F.col("status") == "PENDING", "please wait")
    return star.bookings(spark, sf).select("id", text.canon_recommendation(said).alias("recommendation"))


@query(
    "norm_phone", "F12", "profiles",
    sql="SELECT id, right('98' || lpad(CAST(id AS VARCHAR), 8, '0'), 10) AS phone, TRUE AS is_indian, id >= 0 AS bare_is_indian FROM profiles",
)
def norm_phone(spark, sf):
    return star.profiles(spark, sf).select(
        "id", text.norm_phone("phone").alias("phone"), text.is_indian_phone("phone").alias("is_indian"),
        text.is_indian_phone(text.norm_phone("phone")).alias("bare_is_indian"),
    )


@query(
    "hash_equals", "F13", "challenges",
    sql="SELECT id, sha256('' || id) = sha256('' || user_id) AS is_match FROM challenges",
)
def hash_equals(spark, sf):
    stored = F.sha2(F.col("user_id").cast("string"), 256)
    return star.challenges(star.events(spark, sf)).select("id", text.hash_equals("id", stored).alias("is_match"))


@query(
    "reason_text", "F14", "snapshots",
    sql=f"""SELECT {R}, CASE WHEN days_until_departure < 10 THEN p || '% probability of price increase detected. Model confidence: ' || c || '%.' || k || ' Lock in this fare now.'
              WHEN days_until_departure < 25 THEN 'Prices may soften — only ' || p || '% chance of an increase. Model confidence: ' || c || '%.' || k || ' Consider waiting a few days.'
              ELSE 'Market is stable with ' || p || '% probability of increase. Model confidence: ' || c || '%.' || k || ' Monitor and book when ready.' END AS reason
            FROM (SELECT *, CAST(floor(demand_score * 100 + 0.5) AS BIGINT) AS p, CAST(floor(days_until_departure / 40.0::DOUBLE * 100 + 0.5) AS BIGINT) AS c,
                    CASE WHEN seats_available < 20 THEN ' Peak season demand is elevated.' ELSE '' END AS k FROM snapshots)""",
)
def reason_text(spark, sf):
    days = F.col("days_until_departure")
    rec = F.when(days < 10, "BOOK_NOW").when(days < 25, "WAIT").otherwise("MONITOR")
    return star.snapshots(spark, sf).select(
        *ROUTE, text.reason_text(rec, "demand_score", days / 40, F.col("seats_available") < 20).alias("reason")
    )


@query(
    "offer_ids", "F15", "offers",
    sql=f"""SELECT offer_id, concat_ws('-', 'SKY', {R}, airline_code, days_until_dep, seats_available) AS composed,
              airline_code || (100 + seats_available * 10 + 3 + days_until_dep) AS flight FROM offers""",
)
def offer_ids(spark, sf):
    return star.offers(spark, sf).select(
        "offer_id", text.offer_id(*ROUTE, "airline_code", "days_until_dep", "seats_available").alias("composed"),
        text.flight_number("airline_code", "seats_available", F.lit(3), "days_until_dep").alias("flight"),
    )


# -- calendar ---------------------------------------------------------------------------------------------------------


@query(
    "parse_dates", "F16 F22", "bookings",
    sql=f"""SELECT id, CASE status WHEN 'CONFIRMED' THEN strftime(created_at, '%Y-%m-%d') WHEN 'PENDING' THEN '1998-06-15' ELSE 'bad' END AS day,
              strftime(created_at + INTERVAL 90 DAY, '%Y-%m-%d') AS expires,
              CASE status WHEN 'CANCELLED' THEN 'bad' ELSE strftime(created_at, '%Y-%m-%d %H:%M') END AS stamp FROM bookings""",
)
def parse_dates(spark, sf):
    status = F.col("status")
    given = F.when(status == "CONFIRMED", F.date_format("created_at", "yyyy-MM-dd")).when(status == "PENDING", "").otherwise("31/12/98")
    iso = F.when(status == "CANCELLED", "tomorrow").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return star.bookings(spark, sf).select(
        "id", F.coalesce(F.date_format(dates.parse_date_default(given, star.AS_OF), "yyyy-MM-dd"), F.lit("bad")).alias("day"),
        F.date_format(dates.expiry("created_at", "90 days"), "yyyy-MM-dd").alias("expires"),
        F.coalesce(F.date_format(dates.parse_iso_ts(iso), "yyyy-MM-dd HH:mm"), F.lit("bad")).alias("stamp"),
    )


@query(
    "calendar_features", "F17 F18 F19 F20", "price_history",
    sql=f"""SELECT departure_date, greatest(date_diff('day', DATE '{star.AS_OF}', departure_date), 0) AS days_left,
              isodow(departure_date) - 1 AS day_of_week, month(departure_date) AS month, week(departure_date) AS week_of_year,
              isodow(departure_date) >= 6 AS is_weekend, isodow(departure_date) >= 5 AS is_pricing_weekend,
              strftime(departure_date, '%m%d') IN ('0101','0126','0815','1002','1225','0102','1231','0125','0127','0814','0816','1001','1003','1224','1226') AS is_holiday,
              count(*) AS fares, round(max(1.0 / (days_until_dep + 1)), 6) AS urgency
            FROM price_history GROUP BY 1""",
)
def calendar_features(spark, sf):
    daily = star.price_history(spark, sf).groupBy("departure_date").agg(
        F.count(F.lit(1)).alias("fares"), F.round(F.max(dates.urgency("days_until_dep")), 6).alias("urgency")
    )
    c = dates.calendar_features("departure_date")
    return daily.select(
        "departure_date", dates.days_until("departure_date", star.AS_OF).alias("days_left"),
        *[c[k].alias(k) for k in ("day_of_week", "month", "week_of_year")],
        dates.is_weekend("departure_date").alias("is_weekend"), dates.is_weekend("departure_date", 4).alias("is_pricing_weekend"),
        dates.is_holiday("departure_date").alias("is_holiday"), "fares", "urgency",
    )


@query(
    "peak_hours", "F18 F19", "ticks",
    sql="""SELECT event_id, hour(ts) AS hour_of_day, hour(ts) IN (7,8,9,18,19,20,21) AS is_peak_hour FROM ticks""",
)
def peak_hours(spark, sf):
    hour = dates.calendar_features("ts")["hour_of_day"]
    return star.fare_ticks(star.events(spark, sf)).select(
        "event_id", hour.alias("hour_of_day"), dates.is_peak_hour(hour).alias("is_peak_hour")
    )


@query(
    "arrival_time", "F21", "offers",
    sql="SELECT offer_id, strftime(departure_time + to_minutes(seats_available * 13), '%Y-%m-%d %H:%M') AS arrival FROM offers",
)
def arrival_time(spark, sf):
    arrival = dates.add_minutes("departure_time", text.duration_minutes("duration"))
    return star.offers(spark, sf).select("offer_id", F.date_format(arrival, "yyyy-MM-dd HH:mm").alias("arrival"))


# -- money and nested offers ------------------------------------------------------------------------------------------


@query(
    "fare_split", "F23", "offers",
    sql="""SELECT offer_id, round(CASE cabin_class WHEN 'FIRST' THEN total * 0.5 ELSE total * 0.85 END, 4) AS base,
              round(total - CASE cabin_class WHEN 'FIRST' THEN total * 0.5 ELSE total * 0.85 END, 4) AS taxes FROM offers""",
)
def fare_split(spark, sf):
    given = F.when(F.col("cabin_class") == "FIRST", F.col("total") * 0.5).otherwise(F.lit(0.0))
    parts = pricing.fare_split("total", given)
    return star.offers(spark, sf).select(
        "offer_id", F.round(parts["base"], 4).alias("base"), F.round(parts["taxes"], 4).alias("taxes")
    )


def _booking_offers(spark, sf):
    """One raw offer per booking, its passengers' legs chained as segments in either spelling."""
    line = star.raw(spark, sf, "lineitem")
    stop = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"),
        F.col("l_shipdate").cast("string").alias("at"),
    )
    # A journey's legs: at most one per line number, so a list never exceeds seven entries.
    legs = line.groupBy("l_orderkey", "l_linenumber").agg(F.min(stop).alias("leg"))
    chained = legs.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("leg")).alias("legs"))
    even = F.col("l_orderkey") % 2 == 0

    def segment(x):
        place, to = F.concat(F.lit("S"), x["s"].cast("string")), F.concat(F.lit("P"), x["p"].cast("string"))
        return F.struct(
            F.when(even, place).alias("origin"), F.when(even, to).alias("destination"),
            F.when(even, x["at"]).alias("departure_time"),
            F.struct(F.when(~even, place).alias("iataCode"), F.when(~even, x["at"]).alias("at")).alias("departure"),
            F.struct(F.when(~even, to).alias("iataCode")).alias("arrival"),
        )

    itinerary = F.struct(F.lit("PT2H").alias("duration"), F.transform("legs", segment).alias("segments"))
    orders = star.raw(spark, sf, "orders")
    joined = orders.join(chained, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    total = F.col("o_totalprice").cast("string")
    price = F.when(F.col("o_orderkey") % 2 == 0, F.struct(total.alias("grandTotal"), F.lit(None).cast("string").alias("total")))
    price = price.otherwise(F.struct(F.lit(None).cast("string").alias("grandTotal"), total.alias("total")))
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.to_json(F.struct(price.alias("price"), F.when(F.col("legs").isNotNull(), F.array(itinerary)).alias("itineraries"))).alias("body"),
    )


_LEGS = """SELECT l_orderkey, l_linenumber, arg_min(l_suppkey, (l_suppkey, l_partkey, l_shipdate)) AS s,
    arg_min(l_partkey, (l_suppkey, l_partkey, l_shipdate)) AS p FROM lineitem GROUP BY 1, 2"""


@query(
    "offer_routes", "F24 F25 S5",
    sql=f"""SELECT o_orderkey AS id, coalesce('S' || arg_min(s, l_linenumber), '-') AS origin, coalesce('P' || arg_max(p, l_linenumber), '-') AS destination,
              CAST(greatest(count(l_linenumber) - 1, 0) AS INTEGER) AS stops, any_value(o_totalprice) AS total_price,
              round(any_value(o_totalprice) * 0.85, 4) AS base_fare
            FROM orders LEFT JOIN ({_LEGS}) ON o_orderkey = l_orderkey GROUP BY 1""",
)
def offer_routes(spark, sf):
    parsed = _booking_offers(spark, sf).withColumn("offer", nested.parse_offer("body"))
    card, price = nested.trip_card("offer"), nested.offer_price("offer")
    return parsed.select(
        "id", F.coalesce(card["origin"], F.lit("-")).alias("origin"), F.coalesce(card["destination"], F.lit("-")).alias("destination"),
        nested.stops(nested.segments("offer")).alias("stops"), price["total_price"].alias("total_price"),
        F.round(price["base_fare"], 4).alias("base_fare"),
    )


@query(
    "explode_passengers", "F26", "passengers",
    sql="""SELECT booking_id, row_number() OVER (PARTITION BY booking_id ORDER BY ordinal, first_name, last_name) AS ordinal,
              CASE WHEN first_name = 'red' THEN 'CHILD' ELSE 'ADULT' END AS passenger_type, first_name, last_name, 'WINDOW' AS seat_preference,
              15 AS baggage_kg
           FROM (SELECT booking_id, ordinal, min(first_name) AS first_name, arg_min(last_name, (first_name, last_name)) AS last_name
                 FROM passengers GROUP BY 1, 2)""",
)
def explode_passengers(spark, sf):
    one = star.passengers(spark, sf).groupBy("booking_id", "ordinal").agg(
        F.min(F.struct("first_name", "last_name")).alias("p")
    )
    entry = F.struct(
        F.col("ordinal").alias("at"), F.when(F.col("p.first_name") == "red", "CHILD").alias("type"),
        F.col("p.first_name").alias("first_name"), F.col("p.last_name").alias("last_name"),
    )
    listed = one.groupBy("booking_id").agg(F.array_sort(F.collect_list(entry)).alias("passengers"))
    return nested.explode_passengers(listed).select(
        "booking_id", "ordinal", "passenger_type", "first_name", "last_name", "seat_preference", "baggage_kg"
    )


@query(
    "json_text", "F27",
    sql="""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS next_k FROM events""",
)
def json_text(spark, sf):
    known = F.try_variant_get(nested.offer_variant("props"), "$.k", "bigint")
    return star.events(spark, sf).select("event_id", nested.json_text("props", "$.k").alias("k"), (known + 1).alias("next_k"))


@query(
    "route_airlines", "F28", "routes",
    sql=f"SELECT {R}, list_contains(airlines, 'BRAND#7') AS flies_seven, unnest(airlines) AS airline_code FROM routes",
)
def route_airlines(spark, sf):
    listed = star.routes(spark, sf).withColumn("flies_seven", nested.carries("airlines", "BRAND#7"))
    return nested.explode_airlines(listed).select(*ROUTE, "flies_seven", "airline_code")


@query(
    "assemble_offers", "F29", "price_history",
    sql=f"""SELECT offer_id, count(DISTINCT itinerary) AS itineraries, count(*) AS legs, max(price) AS total,
              {even('max(price) * 0.82::DOUBLE', 2)} AS base, arg_min(airline_code, l_linenumber) AS carrier,
              string_agg(origin_code || '>' || destination_code, ' ' ORDER BY l_linenumber) AS path
           FROM (SELECT l_orderkey AS offer_id, l_linenumber, CASE WHEN l_linenumber <= 4 THEN 0 ELSE 1 END AS itinerary,
                        min(price) AS price, min(airline_code) AS airline_code, min(origin_code) AS origin_code,
                        min(destination_code) AS destination_code FROM price_history GROUP BY 1, 2, 3) GROUP BY 1""",
)
def assemble_offers(spark, sf):
    legs = star.price_history(spark, sf).groupBy(F.col("l_orderkey").alias("offer_id"), F.col("l_linenumber").alias("ordinal")).agg(
        F.min("price").alias("total"), F.min("airline_code").alias("airline_code"), F.min("origin_code").alias("origin_code"),
        F.min("destination_code").alias("destination_code"),
    )
    flat = legs.select(
        "offer_id", "ordinal", "total", "airline_code", F.col("origin_code").alias("origin"),
        F.col("destination_code").alias("destination"), F.when(F.col("ordinal") <= 4, 0).otherwise(1).alias("itinerary"),
        F.lit("AB1").alias("flight_number"), F.lit("").alias("departure_time"), F.lit("").alias("arrival_time"),
        F.lit("PT2H").alias("duration"), F.lit("PT4H").alias("itinerary_duration"), F.lit("ECONOMY").alias("cabin"),
    )
    offers = nested.assemble_offers(flat)
    segments = F.flatten(F.col("itineraries.segments"))
    steps = F.transform(segments, lambda s: F.concat(s["origin"], F.lit(">"), s["destination"]))
    return offers.select(
        "offer_id", F.size("itineraries").alias("itineraries"), F.size(segments).alias("legs"),
        F.col("price.total").alias("total"), F.col("price.base").alias("base"), F.col("primary_airline").alias("carrier"),
        F.array_join(steps, " ").alias("path"),
    )
