"""Registered queries: scans, filters, joins, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested
from ..operators import aggregates as agg, alerts as alerting, filters, joins, ledger, merges, offers as search, ordered, quality, views
from ..schemas import ALLOWED
from ..session import work_dir
from ..sources import star, tables
from ..streaming.jobs import parse_payments
from .registry import query

ROUTE = list(agg.ROUTE)
R = "origin_code, destination_code"


# -- scans, sources, sinks --------------------------------------------------------------------------------------------


@query(
    "history_roundtrip", "S1 S4", "price_history",
    sql=f"""SELECT {R}, cabin_class, count(*) AS records, CAST(sum(CAST(price AS DECIMAL(10,2))) AS DOUBLE) AS total
            FROM price_history GROUP BY 1, 2, 3""",
)
def history_roundtrip(spark, sf):
    path = work_dir(spark, "history")
    tables.append_history(star.price_history(spark, sf).withColumn("price", F.col("price").cast("decimal(10,2)")), path, ["cabin_class"])
    stored = tables.read_table(spark, "price_history", path)
    return stored.groupBy(*ROUTE, "cabin_class").agg(
        F.count(F.lit(1)).alias("records"), F.sum("price").cast("double").alias("total")
    )


@query(
    "fare_history", "S2", "bounded_history",
    sql="""SELECT cabin_class, airline_code, count(*) AS fares, min(price) AS low, max(price) AS high,
                  strftime(min(recorded_at), '%Y-%m-%d') AS first_seen FROM bounded_history GROUP BY 1, 2""",
)
def fare_history(spark, sf):
    return tables.fare_history(star.price_history(spark, sf)).groupBy("cabin_class", "airline_code").agg(
        F.count(F.lit(1)).alias("fares"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.date_format(F.min("recorded_at"), "yyyy-MM-dd").alias("first_seen"),
    )


@query(
    "offer_json", "S5", "offers",
    sql=f"""SELECT {R}, count(*) AS offers, round(sum(total), 2) AS total,
                   count(*) FILTER (flight_number IS NULL) AS unnumbered FROM offers GROUP BY 1, 2""",
)
def offer_json(spark, sf):
    price = F.struct(F.col("total").cast("string").alias("total"))
    segment = F.struct("flight_number", F.col("origin_code").alias("origin"), F.col("destination_code").alias("destination"))
    itinerary = F.struct("duration", F.array(segment).alias("segments"))
    offer = F.struct(F.col("offer_id").alias("id"), price.alias("price"), F.array(itinerary).alias("itineraries"))
    sent = star.offers(spark, sf).select(nested.offer_json(offer).alias("value"))
    read = sent.select(nested.parse_offer("value").alias("offer"))
    first = nested.first_segment("offer")
    return read.groupBy(first["origin"].alias("origin_code"), first["destination"].alias("destination_code")).agg(
        F.count(F.lit(1)).alias("offers"),
        F.round(F.sum(nested.offer_price("offer")["total_price"]), 2).alias("total"),
        F.count_if(first["flight_number"].isNull()).alias("unnumbered"),
    )


@query(
    "enough_rows", "S7", "bounded_history",
    sql=f"""SELECT cabin_class, count(*) AS fares, count(*) >= 50 AS usable, count(*) >= 200 AS trainable
            FROM bounded_history GROUP BY 1""",
)
def enough_rows(spark, sf):
    return tables.row_gates(star.bounded_history(spark, sf), ["cabin_class"], {"usable": 50, "trainable": 200}, out="fares")


@query(
    "row_counts", "S8", "airports", "airlines", "routes", "coupons",
    sql="""SELECT 'airports' AS table_name, count(*) AS rows FROM airports WHERE country_code = 'ASIA'
           UNION ALL SELECT 'airlines', count(*) FROM airlines UNION ALL SELECT 'routes', count(*) FROM routes
           UNION ALL SELECT 'coupons', count(*) FROM coupons""",
)
def row_counts(spark, sf):
    return agg.row_counts(
        {
            "airports": star.airports(spark, sf).filter("country_code = 'ASIA'"),
            "airlines": star.airlines(spark, sf),
            "routes": star.routes(spark, sf),
            "coupons": star.coupons(spark, sf),
        }
    )


# -- projections, filters, predicates ---------------------------------------------------------------------------------

_ALERT = "id, user_id, origin_code, destination_code, departure_date, CAST(target_price AS DOUBLE) AS target_price"


def _alert_columns(df):
    return df.select("id", "user_id", *ROUTE, "departure_date", F.col("target_price").cast("double").alias("target_price"))


@query("active_alerts", "P1", "alerts", sql=f"SELECT {_ALERT} FROM alerts WHERE is_active")
def active_alerts(spark, sf):
    return _alert_columns(filters.active_alerts(star.alerts(spark, sf)))


@query(
    "price_bounds", "P2", "price_history",
    sql=f"""SELECT {R}, count(*) FILTER (price >= 800 AND price <= 60000) AS inside,
                   count(*) FILTER (price > 800 AND price < 60000) AS strictly_inside
            FROM price_history GROUP BY 1, 2 HAVING inside > 0""",
)
def price_bounds(spark, sf):
    inside = filters.within_price_bounds(star.price_history(spark, sf))
    return inside.groupBy(*ROUTE).agg(
        F.count(F.lit(1)).alias("inside"), F.count_if(filters.in_price_bounds(inclusive=False)).alias("strictly_inside")
    )


@query(
    "departures", "P3", "offers", "alerts",
    sql=f"""SELECT {R}, departure_date, id, position FROM (
              SELECT o.origin_code, o.destination_code, o.departure_date, offer_id AS id,
                     row_number() OVER (PARTITION BY o.origin_code, o.destination_code, o.departure_date
                                        ORDER BY departure_time, offer_id) AS position
              FROM offers o JOIN (SELECT DISTINCT {R}, departure_date FROM alerts) a
                ON o.origin_code = a.origin_code AND o.destination_code = a.destination_code
                   AND o.departure_date = a.departure_date
              WHERE o.cabin_class <> 'FIRST') WHERE position <= 20""",
)
def departures(spark, sf):
    status = F.when(F.col("cabin_class") == "FIRST", "CANCELLED").otherwise("SCHEDULED")
    flights = star.offers(spark, sf).select(F.col("offer_id").alias("id"), *ROUTE, "departure_time", status.alias("status"))
    return filters.departures_for(flights, star.alerts(spark, sf)).select(*ROUTE, "departure_date", "id", "position")


@query(
    "live_alerts", "P4", "alerts",
    sql=f"""SELECT {_ALERT} FROM alerts WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '{star.AS_OF}')
              AND departure_date >= DATE '{star.AS_OF}'""",
)
def live_alerts(spark, sf):
    return _alert_columns(filters.live_alerts(star.alerts(spark, sf), star.AS_OF))


@query(
    "expire_alerts", "P5", "alerts",
    sql=f"""SELECT id, is_active AND NOT (expires_at < TIMESTAMP '{star.AS_OF}' OR departure_date < DATE '{star.AS_OF}')
              AS is_active FROM alerts""",
)
def expire_alerts(spark, sf):
    return filters.expire_alerts(star.alerts(spark, sf), star.AS_OF).select("id", "is_active")


@query(
    "pending_notifications", "P6", "queue",
    sql=f"""SELECT id, user_id, retry_count FROM queue WHERE status = 'PENDING'
              AND scheduled_at <= TIMESTAMP '{star.EVENT_AS_OF}' AND retry_count < max_retries
            ORDER BY scheduled_at, id LIMIT 200""",
)
def pending_notifications(spark, sf):
    queue = star.notification_queue(star.events(spark, sf))
    return filters.pending_notifications(queue, star.EVENT_AS_OF).select("id", "user_id", "retry_count")


@query(
    "time_of_day", "P7", "offers",
    sql="""SELECT offer_id, CASE WHEN hour(departure_time) < 6 THEN 'NIGHT' WHEN hour(departure_time) < 12 THEN 'MORNING'
             WHEN hour(departure_time) < 18 THEN 'AFTERNOON' ELSE 'EVENING' END AS part FROM offers
           WHERE hour(departure_time) < 18""",
)
def time_of_day(spark, sf):
    offers = star.offers(spark, sf)
    part = filters.day_part(F.hour("departure_time"))
    return filters.time_of_day(offers, "NIGHT", "MORNING", "AFTERNOON").select("offer_id", part.alias("part"))


def _airport_queries(spark, sf):
    """Every prefix of the place names and codes."""
    places = star.airports(spark, sf)
    text = F.explode(F.array(F.lower("city"), F.lower("iata_code"), F.lower("country")))
    whole = places.select(text.alias("t"))
    cut = whole.select("t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("n"))
    return cut.select(F.substring("t", F.lit(1), F.col("n")).alias("query")).distinct()


_AIRPORT_QUERIES = """SELECT DISTINCT substr(t, 1, n) AS query FROM (
      SELECT t, unnest(range(1, length(t) + 1)) AS n FROM (
        SELECT unnest([lower(city), lower(iata_code), lower(country)]) AS t FROM airports))"""
_AIRPORT_HITS = f"""SELECT query, iata_code, country, is_international FROM ({_AIRPORT_QUERIES}) q JOIN airports a
      ON contains(lower(iata_code), query) OR contains(lower(city), query) OR contains(lower(name), query)"""


@query("search_airports", "P8", "airports", sql=f"SELECT query, iata_code FROM ({_AIRPORT_HITS})")
def search_airports(spark, sf):
    return search.search_airports(star.airports(spark, sf), _airport_queries(spark, sf)).select("query", "iata_code")


@query(
    "search_names", "P8",
    sql="""SELECT q.query, CAST(p_partkey AS VARCHAR) AS iata_code FROM
             (SELECT DISTINCT split_part(p_name, ' ', 2) AS query FROM part) q JOIN part ON contains(lower(p_name), q.query)
               OR starts_with(CAST(p_partkey AS VARCHAR), q.query) OR contains(lower(p_brand), q.query)""",
)
def search_names(spark, sf):
    part = star.raw(spark, sf, "part")
    words = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("query")).distinct()
    dim = part.select(F.col("p_partkey").cast("string").alias("iata_code"), F.col("p_name").alias("city"),
                      F.col("p_brand").alias("name"), F.lit(True).alias("is_active"))
    return search.search_airports(dim, words, code_prefix_only=True).select("query", "iata_code")


@query(
    "validate_rejects", "P9", "price_history",
    sql=f"""SELECT reasons, count(*) AS fares FROM (SELECT concat_ws(',',
              CASE WHEN origin_code = destination_code THEN 'same_place' END,
              CASE WHEN NOT (price BETWEEN 800 AND 60000) THEN 'price' END,
              CASE WHEN NOT (training_weight > 0) THEN 'weight' END) AS reasons FROM price_history) GROUP BY 1""",
)
def validate_rejects(spark, sf):
    rules = {
        "origin_code": quality.code_rule("origin_code"),
        "destination_code": quality.code_rule("destination_code"),
        "same_place": quality.differ_rule(*ROUTE),
        "price": quality.range_rule("price", 800, 60000),
        "weight": quality.positive_rule("training_weight"),
    }
    checked = quality.check(star.price_history(spark, sf), rules)
    return checked.groupBy(F.concat_ws(",", "reject_reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("fares"))


@query(
    "allowed_values", "P10", "price_history",
    sql="""SELECT cabin_class, cabin_class IN ('ECONOMY','PREMIUM_ECONOMY','BUSINESS','FIRST') AS is_allowed,
                  count(*) AS fares FROM price_history GROUP BY 1, 2""",
)
def allowed_values(spark, sf):
    checked = quality.check(star.price_history(spark, sf), quality.allowed_rules("cabin_class", ALLOWED["cabin_class"]))
    allowed = (F.size("reject_reasons") == 0).alias("is_allowed")
    return checked.groupBy("cabin_class", allowed).agg(F.count(F.lit(1)).alias("fares"))


@query(
    "coalesce_aliases", "P11", "profiles",
    sql="SELECT id, coalesce(email, full_name) AS email, coalesce(meal_preference, preferred_cabin, 'none') AS choice FROM profiles",
)
def coalesce_aliases(spark, sf):
    spelled = star.profiles(spark, sf).select(
        "id", F.col("email").alias("notify_mail"), F.col("full_name").alias("contact"),
        F.coalesce("meal_preference", F.lit("  ")).alias("choice_a"), "preferred_cabin", F.lit("none").alias("choice_c"),
    )
    out = quality.coalesce_aliases(
        spelled, {"email": ["mail", "notify_mail", "contact"], "choice": ["choice_a", "preferred_cabin", "choice_c"]}
    )
    return out.select("id", "email", "choice")


@query(
    "fill_defaults", "P12", "price_history",
    sql=f"""SELECT {R}, CAST(sum(CASE WHEN seats_available = 7 THEN 50 ELSE seats_available END) AS DOUBLE) AS seats,
              CAST(sum(12) AS DOUBLE) AS hours,
              CAST(sum(CASE WHEN cabin_class = 'FIRST' THEN 0 ELSE days_until_dep END) AS DOUBLE) AS days
            FROM price_history GROUP BY 1, 2""",
)
def fill_defaults(spark, sf):
    holed = star.price_history(spark, sf).select(
        *ROUTE,
        F.nullif("seats_available", F.lit(7)).alias("seats_available"),
        F.when(F.col("cabin_class") == "FIRST", "n/a").otherwise(F.col("days_until_dep").cast("string")).alias("days_until_dep"),
    )
    filled = quality.fill_defaults(holed, {"seats_available": 50, "hour_of_day": 12, "days_until_dep": 0})
    return filled.groupBy(*ROUTE).agg(
        F.sum("seats_available").alias("seats"), F.sum("hour_of_day").cast("double").alias("hours"),
        F.sum("days_until_dep").alias("days"),
    )


@query(
    "profile_card", "P13", "profiles",
    sql="""SELECT id, FALSE AS phone_verified, notify_sms, coalesce(preferred_cabin, 'ECONOMY') AS cabin,
                  coalesce(meal_preference, '-') AS meal, tier FROM profiles""",
)
def profile_card(spark, sf):
    return views.profile_card(star.profiles(spark, sf)).select(
        "id", "phone_verified", "preferences.notify_sms", "preferences.cabin",
        F.coalesce("preferences.meal", F.lit("-")).alias("meal"), "loyalty.tier",
    )


@query(
    "alert_records", "P14", "alerts",
    sql="""SELECT id, origin_code AS origin, triggered_count > 0 AS triggered,
              coalesce(CAST(last_price AS DOUBLE), -1) AS current_price,
              round(coalesce(CAST(target_price AS DOUBLE) - nullif(CAST(last_price AS DOUBLE), 0), -1), 4) AS savings
           FROM alerts""",
)
def alert_records(spark, sf):
    return filters.alert_records(star.alerts(spark, sf)).select(
        "id", "origin", "triggered", F.coalesce("current_price", F.lit(-1.0)).alias("current_price"),
        F.round(F.coalesce("savings", F.lit(-1.0)), 4).alias("savings"),
    )


@query(
    "payment_mismatch", "P15", "bookings",
    sql="""SELECT id AS booking_id, CAST(round_even(amount * 100, 0) AS BIGINT) AS amount_minor,
              abs(CAST(total_price AS DOUBLE) - amount) > 1 AS is_mismatch, payment_status = 'PAID' AS already_paid
           FROM (SELECT *, CAST(total_price AS DOUBLE)
                   + CASE booking_source WHEN 'APP' THEN 2.5 ELSE 0.5 END AS amount FROM bookings)""",
)
def payment_mismatch(spark, sf):
    booked = star.bookings(spark, sf)
    extra = F.when(F.col("booking_source") == "APP", 2.5).otherwise(0.5)
    orders = booked.select(F.col("id").alias("booking_id"), (F.col("total_price").cast("double") + extra).alias("amount"))
    return ledger.payment_mismatch(booked, orders).select("booking_id", "amount_minor", "is_mismatch", "already_paid")


@query(
    "mask_unobserved", "P16", "price_history",
    sql=f"""SELECT {R}, CAST(sum(CASE WHEN is_live THEN least(greatest(seats_available, 1), 100) ELSE 50 END) AS BIGINT) AS seats,
              round(sum(CASE WHEN is_live THEN training_weight ELSE 0.5 END), 6) AS demand
            FROM price_history GROUP BY 1, 2""",
)
def mask_unobserved(spark, sf):
    seen = star.price_history(spark, sf).withColumn("demand_score", F.col("training_weight"))
    return filters.mask_unobserved(seen).groupBy(*ROUTE).agg(
        F.sum("seats_available").alias("seats"), F.round(F.sum("demand_score"), 6).alias("demand")
    )


@query(
    "visible_coupons", "P17", "coupons", "bookings",
    sql=f"""SELECT code, count(b.id) AS bookings FROM coupons LEFT JOIN bookings b ON coupon_code = code
            WHERE is_active AND (valid_until IS NULL OR valid_until >= TIMESTAMP '{star.AS_OF}'::TIMESTAMP + INTERVAL 9 DAY)
            GROUP BY 1""",
)
def visible_coupons(spark, sf):
    shown = filters.visible_coupons(star.coupons(spark, sf), "1998-06-10")
    booked = star.bookings(spark, sf).groupBy(F.col("coupon_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return shown.join(booked, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("bookings"))


# -- joins ------------------------------------------------------------------------------------------------------------


@query(
    "booking_details", "J1", "bookings", "profiles",
    sql="""SELECT b.id, booking_reference, status, payment_status, CAST(total_price AS DOUBLE) AS total_price, cabin_class,
              full_name AS user_name, coalesce(email, '-') AS user_email, phone AS user_phone, notify_email, tier
           FROM bookings b JOIN profiles p ON b.user_id = p.id""",
)
def booking_details(spark, sf):
    return views.booking_details(star.bookings(spark, sf), star.profiles(spark, sf)).select(
        "id", "booking_reference", "status", "payment_status", F.col("total_price").cast("double").alias("total_price"),
        "cabin_class", "user_name", F.coalesce("user_email", F.lit("-")).alias("user_email"), "user_phone",
        "notify_email", "tier",
    )


@query(
    "active_alert_details", "J2", "alerts", "profiles", "airports",
    sql=f"""SELECT a.id, a.user_id, origin_code, destination_code, full_name, ao.city AS origin_city,
              ao.name AS origin_airport, ad.city AS dest_city, ad.name AS dest_airport
            FROM alerts a JOIN profiles p ON a.user_id = p.id JOIN airports ao ON origin_code = ao.iata_code
              JOIN airports ad ON destination_code = ad.iata_code
            WHERE a.is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '{star.AS_OF}')
              AND departure_date >= DATE '{star.AS_OF}'""",
)
def active_alert_details(spark, sf):
    out = views.active_alert_details(star.alerts(spark, sf), star.profiles(spark, sf), star.airports(spark, sf), star.AS_OF)
    return out.select("id", "user_id", *ROUTE, "full_name", "origin_city", "origin_airport", "dest_city", "dest_airport")


@query(
    "route_airports", "J3", "routes", "airports",
    sql="""SELECT origin_code, ao.city AS origin_city, ao.region AS origin_region, destination_code, ad.name AS dest_airport,
              min_price, max_price, flights_per_day
           FROM routes r JOIN airports ao ON origin_code = ao.iata_code JOIN airports ad ON destination_code = ad.iata_code
           WHERE ao.country_code = 'ASIA' AND ad.country_code = 'ASIA' AND r.is_active""",
)
def route_airports(spark, sf):
    return views.domestic_routes(star.routes(spark, sf), star.airports(spark, sf), "ASIA").select(
        "origin_code", "origin_city", "origin_region", "destination_code", "dest_airport", "min_price", "max_price",
        "flights_per_day",
    )


@query(
    "alerts_with_profile", "J4", "alerts", "profiles",
    sql="""SELECT a.id, full_name, coalesce(email, '-') AS email, notify_whatsapp FROM alerts a
           LEFT JOIN profiles p ON a.user_id = p.id WHERE is_active""",
)
def alerts_with_profile(spark, sf):
    out = views.alerts_with_profile(filters.active_alerts(star.alerts(spark, sf)), star.profiles(spark, sf))
    return out.select("id", "profile.full_name", F.coalesce("profile.email", F.lit("-")).alias("email"), "profile.notify_whatsapp")


@query(
    "visible_rows", "J5", "bookings", "profiles", "passengers",
    sql="""SELECT b.id, (SELECT count(*) FROM passengers WHERE booking_id = b.id) AS passengers FROM bookings b
           WHERE user_id IN (SELECT id FROM profiles WHERE notify_sms)""",
)
def visible_rows(spark, sf):
    people, booked = star.profiles(spark, sf), star.bookings(spark, sf)
    identities = people.filter("notify_sms").select("auth_user_id")
    own = joins.own_profiles(people, identities)
    mine = joins.visible_through(star.passengers(spark, sf), booked, own)
    counted = mine.groupBy(F.col("booking_id").alias("id")).agg(F.count(F.lit(1)).alias("passengers"))
    return joins.visible_rows(booked, own).join(counted, "id", "left").select(
        "id", F.coalesce("passengers", F.lit(0)).alias("passengers")
    )


@query(
    "first_passenger", "J6", "bookings", "passengers",
    sql="""SELECT b.id, coalesce(first_name, 'Traveller') AS passenger_name FROM bookings b LEFT JOIN
           (SELECT booking_id, first_name FROM passengers
            QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY ordinal, first_name) = 1) p ON b.id = p.booking_id""",
)
def first_passenger(spark, sf):
    return views.first_passenger_name(star.bookings(spark, sf), star.passengers(spark, sf)).select("id", "passenger_name")


_PAID_EVENTS = """SELECT user_id AS order_id, 'pay_' || event_id AS payment_id, ts FROM events WHERE event_type = 'purchase'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, 'pay_' || event_id) = 1"""


@query(
    "match_payments", "J7", "bookings",
    sql=f"""SELECT id, payment_id AS new_payment_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS paid_at
            FROM bookings JOIN ({_PAID_EVENTS}) e ON id = order_id WHERE payment_status <> 'PAID'""",
)
def match_payments(spark, sf):
    paid = parse_payments(star.payment_bodies(star.events(spark, sf)))
    booked = star.bookings(spark, sf).withColumn("order_id", F.col("id").cast("string"))
    return joins.match_payments(paid, booked).select(
        "id", "new_payment_id", F.date_format("paid_at", "yyyy-MM-dd HH:mm:ss").alias("paid_at")
    )


@query(
    "expand_grid", "J8", "routes",
    sql=f"""SELECT {R}, days_out, DATE '{star.AS_OF}' + CAST(days_out AS INTEGER) AS departure_date, airline_code
            FROM (SELECT *, unnest([1,2,3,5,7,10,14,21,28,30]) AS days_out FROM
                   (SELECT {R}, unnest(airlines) AS airline_code FROM routes))""",
)
def expand_grid(spark, sf):
    listed = star.routes(spark, sf).select(*ROUTE, "airlines")
    return joins.expand_grid(listed, [1, 2, 3, 5, 7, 10, 14, 21, 28, 30], star.AS_OF)


@query(
    "lookup_default", "J9", "price_history", "airlines",
    sql="""SELECT p.airline_code, round(coalesce(factor, 1.0), 6) AS factor, coalesce(name, p.airline_code) AS name, count(*) AS fares
           FROM price_history p LEFT JOIN (SELECT * FROM airlines WHERE factor < 1.2) a ON p.airline_code = a.airline_code
           GROUP BY ALL""",
)
def lookup_default(spark, sf):
    dim = star.airlines(spark, sf).filter("factor < 1.2")
    looked = joins.lookup_default(
        star.price_history(spark, sf).select("airline_code"), dim, "airline_code",
        {"factor": 1.0, "name": F.col("airline_code")},
    )
    return looked.groupBy("airline_code", F.round("factor", 6).alias("factor"), "name").agg(F.count(F.lit(1)).alias("fares"))


_ALERT_KEY = ["user_id", "origin_code", "destination_code", "departure_date"]


@query(
    "reject_existing", "J10", "alerts",
    sql="""SELECT n.id, coalesce(known, nullif(mine, n.id), -1) AS existing_id FROM
             (SELECT *, min(id) OVER (PARTITION BY user_id, destination_code, cabin_class) AS mine FROM alerts WHERE is_active) n
             LEFT JOIN (SELECT user_id, destination_code, cabin_class, min(id) AS known FROM alerts WHERE NOT is_active GROUP BY ALL) k
             USING (user_id, destination_code, cabin_class)""",
)
def reject_existing(spark, sf):
    all_alerts = star.alerts(spark, sf)
    accepted, rejected = quality.reject_existing(
        all_alerts.filter("is_active"), all_alerts.filter("not is_active"), ["user_id", "destination_code", "cabin_class"]
    )
    return accepted.select("id", F.lit(-1).cast("bigint").alias("existing_id")).unionByName(rejected.select("id", "existing_id"))


@query(
    "orphans", "J11", "bookings", "coupons",
    sql="SELECT id, coupon_code FROM bookings WHERE coupon_code NOT IN (SELECT code FROM coupons)",
)
def orphans(spark, sf):
    return quality.orphans(star.bookings(spark, sf), star.coupons(spark, sf), "coupon_code", "code").select("id", "coupon_code")


@query(
    "connecting_routes", "J12", "bounded_history",
    sql=f"""SELECT d.origin_code, a.destination_code AS via, d.destination_code, round(a.fare + b.fare, 4) AS total_price,
              d.fare AS direct_fare, round(d.fare - (a.fare + b.fare), 4) AS savings,
              round((d.fare - (a.fare + b.fare)) / d.fare * 100, 6) AS savings_percent
            FROM low d JOIN low a ON a.origin_code = d.origin_code
              JOIN low b ON b.origin_code = a.destination_code AND b.destination_code = d.destination_code
            WHERE d.fare - (a.fare + b.fare) > 0""".replace(
        "FROM low", f"FROM (SELECT {R}, min(price) AS fare FROM bounded_history WHERE origin_code <> destination_code GROUP BY 1,2)"
    ).replace("JOIN low", f"JOIN (SELECT {R}, min(price) AS fare FROM bounded_history WHERE origin_code <> destination_code GROUP BY 1,2)"),
)
def connecting_routes(spark, sf):
    return joins.connecting_routes(star.bounded_history(spark, sf)).select(
        "origin_code", "via", "destination_code", F.round("total_price", 4).alias("total_price"), "direct_fare",
        F.round("savings", 4).alias("savings"), F.round("savings_percent", 6).alias("savings_percent"),
    )


@query(
    "supported_routes", "J13", "alerts", "routes",
    sql=f"""SELECT id, EXISTS (SELECT 1 FROM routes r WHERE r.origin_code = a.origin_code
              AND r.destination_code = a.destination_code AND r.origin_code < r.destination_code) AS is_known FROM alerts a""",
)
def supported_routes(spark, sf):
    asked = star.alerts(spark, sf).select("id", *ROUTE)
    half = star.routes(spark, sf).filter("origin_code < destination_code")
    return joins.known_routes(asked, half, ROUTE).select("id", "is_known")


@query(
    "alert_matches", "J14", "alerts", "bounded_history",
    sql=f"""SELECT id, a.origin_code, a.destination_code, current_price FROM alerts a
            JOIN (SELECT {R}, min(price) AS current_price FROM bounded_history GROUP BY 1, 2) f
              ON a.origin_code = f.origin_code AND a.destination_code = f.destination_code
            WHERE is_active AND current_price <= CAST(target_price AS DOUBLE)""",
)
def alert_matches(spark, sf):
    hits = joins.match_alerts(star.alerts(spark, sf), star.bounded_history(spark, sf))
    return hits.select("id", *ROUTE, "current_price")


# -- aggregates -------------------------------------------------------------------------------------------------------


@query(
    "market_snapshot", "A1", "bounded_history",
    sql=f"""SELECT {R}, departure_date, cabin_class, min(price) AS market_low, max(price) AS market_high,
              min(price) AS current_price, min(airline_code) AS airline, count(*) AS fares
            FROM bounded_history GROUP BY 1, 2, 3, 4""",
)
def market_snapshot(spark, sf):
    return agg.market_snapshot(star.bounded_history(spark, sf))


@query(
    "market_listing", "A1", "bounded_history",
    sql=f"""SELECT {R}, min(price) AS market_low, max(price) AS market_high, min(seats_available) AS seats_available,
              arg_min(airline_code, (l_linenumber, airline_code)) AS airline, count(*) AS fares FROM bounded_history GROUP BY 1, 2""",
)
def market_listing(spark, sf):
    """The same per route, with the airlines listed by another column than their name."""
    out = agg.market_snapshot(star.bounded_history(spark, sf), ROUTE, listing="l_linenumber", seats="seats_available")
    return out.select(*ROUTE, "market_low", "market_high", "seats_available", "airline", "fares")


@query(
    "forecast_mean", "A2", "forecast", "snapshots",
    sql=f"""SELECT {R}, round(forecast_mean, 6) AS forecast_mean,
              round((forecast_mean - current_price) / greatest(current_price, 1) * 100, 6) AS delta_percent
            FROM snapshots JOIN (SELECT {R}, avg(price) AS forecast_mean FROM forecast WHERE day <= 14 GROUP BY 1, 2) USING ({R})""",
)
def forecast_mean(spark, sf):
    return agg.forecast_mean(star.forecast(spark, sf), star.snapshots(spark, sf)).select(
        *ROUTE, F.round("forecast_mean", 6).alias("forecast_mean"), F.round("delta_percent", 6).alias("delta_percent")
    )


@query(
    "forecast_risk", "A3", "forecast", "snapshots",
    sql=f"""SELECT {R}, points, round(dev / greatest(current_price, 1), 6) AS volatility,
              round(width / greatest(current_price, 1), 6) AS spread
            FROM snapshots JOIN (SELECT {R}, count(*) AS points, stddev_pop(price) AS dev, max(price) - min(price) AS width
                                 FROM forecast GROUP BY 1, 2) USING ({R})""",
)
def forecast_risk(spark, sf):
    return agg.forecast_risk_stats(star.forecast(spark, sf), star.snapshots(spark, sf)).select(
        *ROUTE, "points", F.round("volatility", 6).alias("volatility"), F.round("spread", 6).alias("spread")
    )


@query(
    "customer_kpis", "A4", "bookings", "alerts",
    sql="""SELECT user_id, bookings, total_spent, confirmed, coalesce(n, 0) AS active_alerts, confirmed * 1200 AS display_points
           FROM (SELECT user_id, count(*) AS bookings, CAST(sum(total_price) AS DOUBLE) AS total_spent,
                        count(*) FILTER (status = 'CONFIRMED') AS confirmed FROM bookings GROUP BY 1)
           LEFT JOIN (SELECT user_id, count(*) AS n FROM alerts WHERE is_active GROUP BY 1) USING (user_id)""",
)
def customer_kpis(spark, sf):
    out = agg.customer_kpis(star.bookings(spark, sf), star.alerts(spark, sf))
    return out.withColumn("total_spent", F.col("total_spent").cast("double"))


@query(
    "alert_summary", "A5", "alerts",
    sql="SELECT user_id, count(*) AS alerts, count(*) FILTER (triggered_count > 0) AS triggered_alerts FROM alerts WHERE is_active GROUP BY 1",
)
def alert_summary(spark, sf):
    return agg.alert_summary(filters.active_alerts(star.alerts(spark, sf)))


@query(
    "trip_counts", "A6", "bookings",
    sql=f"""SELECT user_id, count(*) FILTER (created_at > TIMESTAMP '{star.AS_OF}') AS upcoming,
              count(*) FILTER (created_at <= TIMESTAMP '{star.AS_OF}') AS past, count(*) AS total FROM bookings GROUP BY 1""",
)
def trip_counts(spark, sf):
    trips = star.bookings(spark, sf).withColumn("departure_time", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return agg.trip_counts(merges.split_trips(trips, star.AS_OF))


@query(
    "best_worst_day", "A7", "forecast",
    sql=f"""SELECT {R}, CAST(arg_min(day, (price, day)) AS INTEGER) AS best_day, round(min(price), 6) AS best_price,
              CAST(arg_max(day, (price, -day)) AS INTEGER) AS worst_day, round(max(price), 6) AS worst_price
            FROM forecast GROUP BY 1, 2""",
)
def best_worst_day(spark, sf):
    return agg.best_worst_day(star.forecast(spark, sf)).select(
        *ROUTE, "best_day", F.round("best_price", 6).alias("best_price"), "worst_day", F.round("worst_price", 6).alias("worst_price")
    )


@query(
    "regression_metrics", "A8", "bounded_history",
    sql="""SELECT cabin_class, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
              round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
              round((100 - avg(abs(y - p) / greatest(y, 1)) * 100) / 100, 6) AS accuracy, count(*) AS samples
           FROM (SELECT cabin_class, price AS y, price * (0.9 + 0.004 * seats_available) AS p FROM bounded_history) GROUP BY 1""",
)
def regression_metrics(spark, sf):
    scored = star.bounded_history(spark, sf).withColumn("prediction", F.col("price") * (0.9 + 0.004 * F.col("seats_available")))
    out = agg.regression_metrics(scored, keys=["cabin_class"])
    return out.select(
        "cabin_class", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"),
        F.round("accuracy", 6).alias("accuracy"), "samples",
    )


@query(
    "loyalty_totals", "A9", "bookings",
    sql="""SELECT user_id, CAST(sum(greatest(0, floor(total_price / 100))) AS BIGINT) AS points, count(*) AS trips,
              CAST(sum(total_price) AS DOUBLE) AS spent FROM bookings WHERE payment_status = 'PAID' GROUP BY 1""",
)
def loyalty_totals(spark, sf):
    return agg.loyalty_totals(star.bookings(spark, sf)).withColumn("spent", F.col("spent").cast("double"))


@query(
    "forecast_extent", "A10", "forecast",
    sql=f"""SELECT {R}, round(lo - w * 0.08, 4) AS axis_low, round(hi + w * 0.08, 4) AS axis_high FROM
              (SELECT {R}, lo, hi, CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS w FROM
                (SELECT {R}, min(least(lower, price, upper)) AS lo, max(greatest(lower, price, upper)) AS hi FROM forecast GROUP BY 1, 2))""",
)
def forecast_extent(spark, sf):
    return agg.forecast_extent(star.forecast(spark, sf)).select(
        *ROUTE, F.round("axis_low", 4).alias("axis_low"), F.round("axis_high", 4).alias("axis_high")
    )


@query(
    "coupon_usage", "A11", "bookings", "coupons",
    sql="""SELECT code, coalesce(uses, 0) AS uses, coalesce(most, 0) AS most_by_user, coalesce(users, 0) AS users,
              coalesce(uses >= usage_limit, FALSE) AS exhausted, coalesce(most > per_user_limit, FALSE) AS user_limit_passed
           FROM coupons LEFT JOIN (SELECT coupon_code, CAST(sum(n) AS BIGINT) AS uses, max(n) AS most, count(*) AS users FROM
             (SELECT coupon_code, user_id, count(*) AS n FROM bookings GROUP BY 1, 2) GROUP BY 1) ON code = coupon_code""",
)
def coupon_usage(spark, sf):
    return agg.coupon_usage(star.bookings(spark, sf), star.coupons(spark, sf)).select(
        "code", "uses", "most_by_user", "users", "exhausted", "user_limit_passed"
    )


@query(
    "ingest_counts", "A12", "price_history",
    sql=f"""SELECT coalesce(origin_code, '*') AS origin_code, coalesce(destination_code, '*') AS destination_code,
              coalesce(days_until_dep, -1) AS days_until_dep, count(*) AS records, grouping(origin_code) = 1 AS is_total
            FROM price_history GROUP BY GROUPING SETS (({R}, days_until_dep), ())""",
)
def ingest_counts(spark, sf):
    return agg.ingest_counts(star.price_history(spark, sf)).select(
        *[F.coalesce(c, F.lit("*")).alias(c) for c in ROUTE], F.coalesce("days_until_dep", F.lit(-1)).alias("days_until_dep"),
        "records", "is_total",
    )


# -- sorts, top-k ------------------------------------------------------------------------------------------------------


@query(
    "offers_top_k", "T1", "offers",
    sql="""SELECT search_id, offer_id, total, position FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY total, offer_id) AS position
           FROM offers) WHERE position <= 3""",
)
def offers_top_k(spark, sf):
    return search.cheapest_offers(star.offers(spark, sf), 3).select("search_id", "offer_id", "total", "position")


@query(
    "sort_offers", "T2", "offers",
    sql="""SELECT offer_id, duration, row_number() OVER (ORDER BY seats_available * 13, offer_id) AS position FROM offers""",
)
def sort_offers(spark, sf):
    return search.sort_offers(star.offers(spark, sf), "duration").select("offer_id", "duration", "position")


@query(
    "trips_recent_first", "T3", "bookings",
    sql="SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position FROM bookings",
)
def trips_recent_first(spark, sf):
    return search.trips_recent_first(star.bookings(spark, sf)).select("id", "user_id", "position")


@query(
    "alerts_by_departure", "T4", "alerts",
    sql="""SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY departure_date, id) AS position FROM alerts
           WHERE is_active""",
)
def alerts_by_departure(spark, sf):
    return alerting.alerts_by_departure(star.alerts(spark, sf)).select("id", "user_id", "position")


@query(
    "rank_airports", "T5", "airports",
    sql=f"""SELECT query, iata_code, position FROM (SELECT *, row_number() OVER (PARTITION BY query
              ORDER BY country <> 'ASIA', lower(iata_code) <> query, iata_code) AS position FROM ({_AIRPORT_HITS}))
            WHERE position <= 10""",
)
def rank_airports(spark, sf):
    hits = search.search_airports(star.airports(spark, sf), _airport_queries(spark, sf))
    return search.rank_airports(hits, home="ASIA").select("query", "iata_code", "position")


@query(
    "rank_airports_international", "T5", "airports",
    sql=f"""SELECT query, iata_code, position FROM (SELECT *, row_number() OVER (PARTITION BY query
              ORDER BY is_international DESC, iata_code) AS position FROM ({_AIRPORT_HITS})) WHERE position <= 10""",
)
def rank_airports_international(spark, sf):
    hits = search.search_airports(star.airports(spark, sf), _airport_queries(spark, sf))
    return search.rank_airports_international(hits).select("query", "iata_code", "position")


@query(
    "top_routes", "T6", "routes",
    sql="""SELECT origin_code, destination_code, flights_per_day, position FROM (SELECT *, row_number() OVER (PARTITION BY origin_code
           ORDER BY flights_per_day DESC, destination_code) AS position FROM routes) WHERE position <= 3""",
)
def top_routes(spark, sf):
    return search.top_routes(star.routes(spark, sf)).select(*ROUTE, "flights_per_day", "position")


@query(
    "training_order", "T7", "bounded_history",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY {R}
              ORDER BY recorded_at, l_orderkey, l_linenumber, departure_date, l_partkey, l_suppkey) AS position FROM bounded_history""",
)
def training_order(spark, sf):
    return ordered.row_index(
        star.bounded_history(spark, sf), ROUTE, star.ORDER, out="position"
    ).select("l_orderkey", "l_linenumber", "l_partkey", "position")


# -- merges -----------------------------------------------------------------------------------------------------------


@query(
    "upsert_routes", "U1 U7", "routes", "bounded_history",
    sql=f"""SELECT coalesce(r.origin_code, n.origin_code) AS origin_code, coalesce(r.destination_code, n.destination_code) AS destination_code,
              coalesce(n.low, r.min_price, 0) AS min_price,
              CASE WHEN r.origin_code IS NULL THEN n.high ELSE r.max_price END AS max_price,
              CASE WHEN r.origin_code IS NOT NULL AND n.origin_code IS NOT NULL THEN '{star.AS_OF}' ELSE '1995-01-01' END AS updated
            FROM (SELECT * FROM routes WHERE destination_code < 'N20') r FULL JOIN
              (SELECT {R}, CASE WHEN origin_code < 'N15' THEN min(price) END AS low, max(price) AS high FROM bounded_history GROUP BY 1, 2) n
              ON r.origin_code = n.origin_code AND r.destination_code = n.destination_code""",
)
def upsert_routes(spark, sf):
    stamp = F.to_timestamp(F.lit("1995-01-01"))
    base = star.routes(spark, sf).filter("destination_code < 'N20'").select(*ROUTE, "min_price", "max_price").withColumn("updated_at", stamp)
    new = star.bounded_history(spark, sf).groupBy(*ROUTE).agg(
        F.when(F.col("origin_code") < "N15", F.min("price")).alias("min_price"), F.max("price").alias("max_price")
    ).withColumn("updated_at", stamp)
    out = merges.upsert(base, new, ROUTE, update=["min_price"], keep_when_null=["min_price"], as_of=star.AS_OF)
    return out.select(
        *ROUTE, F.coalesce("min_price", F.lit(0.0)).alias("min_price"), "max_price",
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query(
    "reverse_routes", "U2", "routes",
    sql=f"""SELECT origin_code, destination_code, flights_per_day, min_price FROM big UNION ALL
            SELECT destination_code, origin_code, flights_per_day, min_price FROM big b WHERE NOT EXISTS
              (SELECT 1 FROM big x WHERE x.origin_code = b.destination_code AND x.destination_code = b.origin_code)""".replace(
        "FROM big", "FROM (SELECT * FROM routes WHERE origin_code >= destination_code OR origin_code < 'N08')"
    ),
)
def reverse_routes(spark, sf):
    listed = star.routes(spark, sf).filter("origin_code >= destination_code or origin_code < 'N08'")
    return merges.with_reverse_routes(listed.select(*ROUTE, "flights_per_day", "min_price"))


@query(
    "patch_profiles", "U3 U7", "profiles", "users",
    sql=f"""SELECT p.id, coalesce(u.name, p.full_name) AS full_name, CASE WHEN u.name IS NULL THEN tier ELSE 'none' END AS tier,
              CASE WHEN u.id IS NULL THEN '1995-01-01' ELSE '{star.AS_OF}' END AS updated
            FROM profiles p LEFT JOIN (SELECT * FROM users WHERE name IS NOT NULL) u ON p.auth_user_id = u.id""",
)
def patch_profiles(spark, sf):
    base = star.profiles(spark, sf).withColumn("updated_at", F.to_timestamp(F.lit("1995-01-01")))
    fields = F.array(F.lit("full_name"), F.lit("tier"))
    changes = star.users(spark, sf).filter("name is not null").select(
        F.col("id").alias("auth_user_id"), F.col("name").alias("full_name"), F.lit(None).cast("string").alias("tier"),
        F.lit(None).cast("string").alias("phone"), fields.alias("supplied"),
    )
    out = merges.patch(base, changes, "auth_user_id", supplied="supplied", as_of=star.AS_OF)
    return out.select("id", "full_name", F.coalesce("tier", F.lit("none")).alias("tier"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(
    "rewrite_partitions", "U1 U3 U7", "profiles",
    sql=f"""SELECT id, CAST(id % 40 AS INTEGER) AS part, CASE WHEN id % 40 = 7 THEN 'renamed' ELSE full_name END AS full_name,
              CASE WHEN id % 40 = 7 THEN '{star.AS_OF}' ELSE '1995-01-01' END AS updated FROM profiles""",
)
def rewrite_partitions(spark, sf):
    """A stored profile table of 40 partitions after one of them was patched, twice."""
    path = work_dir(spark, "profiles")
    table = star.profiles(spark, sf).select("id", "full_name", F.to_timestamp(F.lit("1995-01-01")).alias("updated_at"), (F.col("id") % 40).cast("int").alias("part"))
    table.write.partitionBy("part").parquet(path)
    changes = table.filter("part = 7").select("id", "part", F.lit("renamed").alias("full_name"))
    for _ in range(2):
        tables.rewrite_partitions(spark, path, changes, lambda base, new: merges.patch(base, new, ["id", "part"], as_of=star.AS_OF), "part")
    return spark.read.parquet(path).select("id", "part", "full_name", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(
    "soft_delete", "U4", "alerts", "bookings",
    sql="SELECT id, is_active AND id NOT IN (SELECT id FROM bookings WHERE status = 'CANCELLED') AS is_active FROM alerts",
)
def soft_delete(spark, sf):
    gone = star.bookings(spark, sf).filter("status = 'CANCELLED'").select("id")
    return merges.soft_delete(star.alerts(spark, sf), gone).select("id", "is_active")


@query(
    "union_horizons", "U5", "routes",
    sql=f"""SELECT {R}, DATE '{star.AS_OF}' + CAST(d AS INTEGER) AS date FROM
              (SELECT {R}, unnest([-6,-4,-2,1,3,5,7]) AS d FROM routes)""",
)
def union_horizons(spark, sf):
    return merges.union_horizons(star.routes(spark, sf).select(*ROUTE), star.AS_OF, past=6, future=7, step=2)


@query(
    "split_trips", "U6", "bookings",
    sql=f"SELECT id, status <> 'CANCELLED' AND created_at > TIMESTAMP '{star.AS_OF}' AS is_upcoming FROM bookings",
)
def split_trips(spark, sf):
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(F.col("status") == "CANCELLED", "soon").otherwise(stamp)
    trips = star.bookings(spark, sf).withColumn("departure_time", text)
    return merges.split_trips(trips, star.AS_OF).select("id", "is_upcoming")


@query(
    "touch_updated", "U7", "bookings",
    sql=f"SELECT id, CASE WHEN status = 'CONFIRMED' THEN '{star.AS_OF}' ELSE strftime(created_at, '%Y-%m-%d') END AS updated FROM bookings",
)
def touch_updated(spark, sf):
    stamped = star.bookings(spark, sf).withColumn("updated_at", F.col("created_at"))
    return merges.touch_updated(stamped, F.col("status") == "CONFIRMED", star.AS_OF).select(
        "id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated")
    )
