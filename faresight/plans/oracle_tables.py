"""The logical tables of ``sources.star`` as SQL, for side-by-side checks on the same files."""

from __future__ import annotations

_DEPENDS = {
    "bounded_history": ["price_history"],
    "routes": ["price_history"],
    "old_bookings": ["bookings"],
    "forecast": ["price_history", "bounded_history"],
    "snapshots": ["price_history", "bounded_history"],
    "profile_stats": ["price_history", "bounded_history", "forecast"],
    "offers": ["price_history"],
}


def code(expr: str) -> str:
    return f"'N' || lpad(CAST({expr} AS VARCHAR), 2, '0')"


def even(x: str, digits: int) -> str:
    """Half-even rounding of the exact binary value."""
    s = f"{10**digits}::DOUBLE"
    head = "CAST(CAST(x AS FLOAT) AS DOUBLE)"
    rest = f"(x * {s} - floor(x * {s}) - 0.5::DOUBLE) + (({head} * {s} - x * {s}) + (x - {head}) * {s})"
    return (
        f"list_transform([CAST({x} AS DOUBLE)], lambda x: (floor(x * {s}) + CASE WHEN {rest} > 0 THEN 1 "
        f"WHEN {rest} < 0 THEN 0 ELSE floor(x * {s}) % 2 END) / {s})[1]"
    )


def season(d: str) -> str:
    return (
        f"CASE WHEN month({d}) IN (1,5,6,10,12) THEN 1.26::DOUBLE WHEN month({d}) IN (4,7,11) THEN 1.12::DOUBLE "
        "ELSE 1.0::DOUBLE END"
    )


def pressure(seats: str) -> str:
    empty = f"((60 - greatest(1, least(60, {seats}))) / 60.0::DOUBLE)"
    return even(f"1.0::DOUBLE + {empty} * {empty} * 0.62::DOUBLE", 4)


def sigmoid(days: str) -> str:
    return f"(1.0::DOUBLE + 0.72::DOUBLE / (1.0::DOUBLE + exp(-((14 - {days}) / 5.5::DOUBLE))))"


def demand(days: str, d: str, seats: str) -> str:
    return even(
        f"least(1.0::DOUBLE, least(1.0::DOUBLE, {sigmoid(days)} - 1.0::DOUBLE) * 0.58::DOUBLE"
        f" + (({season(d)}) - 1.0::DOUBLE) * 1.05::DOUBLE + ({pressure(seats)} - 1.0::DOUBLE) * 0.72::DOUBLE)",
        4,
    )


_MEAN = "CAST(sum(CAST(floor(price * 100 + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / 100 / count(*)"

_CABIN_OF_PRIORITY = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'FIRST' WHEN '2-HIGH' THEN 'BUSINESS' "
    "WHEN '3-MEDIUM' THEN 'PREMIUM_ECONOMY' ELSE 'ECONOMY' END"
)
_MAIL = "lower(replace(c_name, '#', '')) || '@example.com'"

TABLES = {
    "price_history": f"""
        SELECT {code('s_nationkey')} AS origin_code, {code('c_nationkey')} AS destination_code,
               upper(p_brand) AS airline_code,
               CASE p_type WHEN 'STANDARD' THEN 'PREMIUM_ECONOMY' WHEN 'LARGE' THEN 'BUSINESS'
                    WHEN 'PROMO' THEN 'FIRST' ELSE p_type END AS cabin_class,
               l_extendedprice AS price, CAST(l_shipdate AS DATE) AS departure_date, o_orderdate AS recorded_at,
               greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 0) AS days_until_dep,
               CAST(l_quantity AS INTEGER) AS seats_available, l_returnflag = 'R' AS is_live,
               1 - l_discount * 10 AS training_weight, l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "bounded_history": "SELECT * FROM price_history WHERE price BETWEEN 800 AND 60000",
    "airports": f"""
        SELECT {code('n_nationkey')} AS iata_code, n_name AS city, n_name || ' airport' AS name, r_name AS country,
               r_name AS country_code, r_name AS region, TRUE AS is_active, n_regionkey >= 2 AS is_international
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "routes": """
        SELECT origin_code, destination_code, min(price) AS min_price, max(price) AS max_price,
               count(*) AS flights_per_day, list_sort(list(DISTINCT airline_code)) AS airlines, TRUE AS is_active
        FROM price_history GROUP BY 1, 2""",
    "airlines": """
        SELECT DISTINCT upper(p_brand) AS airline_code, p_brand AS name,
               0.88::DOUBLE + 0.02::DOUBLE * CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS factor
        FROM part""",
    "bookings": f"""
        SELECT o_orderkey AS id, 'B' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS booking_reference,
               o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(10,2)) AS total_price, o_orderdate AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'PENDING' ELSE 'CANCELLED' END AS status,
               CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'UNPAID' ELSE 'VOID' END AS payment_status,
               {_CABIN_OF_PRIORITY} AS cabin_class,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'APP' ELSE 'WEB' END AS booking_source,
               CASE WHEN o_orderpriority <> '5-LOW' THEN 'c' || o_custkey || '@example.com' END AS contact_email,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
                    THEN '+91 98' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS contact_phone,
               'C' || lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') AS coupon_code
        FROM orders""",
    "old_bookings": """
        SELECT * REPLACE (
            CASE WHEN payment_status = 'PAID' AND cabin_class = 'FIRST' THEN 'PAID' ELSE 'UNPAID' END AS payment_status,
            CASE WHEN payment_status = 'PAID' AND cabin_class = 'FIRST' THEN 'CONFIRMED' ELSE 'PENDING' END AS status)
        FROM bookings""",
    "profiles": f"""
        SELECT c_custkey AS id, 'u' || c_custkey AS auth_user_id, c_name AS full_name,
               CASE WHEN c_mktsegment <> 'MACHINERY' THEN {_MAIL} END AS email,
               '+91-98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone,
               c_mktsegment IN ('BUILDING','AUTOMOBILE','MACHINERY') AS notify_email,
               c_mktsegment IN ('BUILDING','FURNITURE') AS notify_sms,
               c_mktsegment IN ('HOUSEHOLD','FURNITURE') AS notify_whatsapp,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'VEG' END AS meal_preference,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN 'BUSINESS' END AS preferred_cabin,
               CAST(0 AS BIGINT) AS loyalty_points, 'BLUE' AS tier, CAST(0 AS BIGINT) AS total_bookings,
               CAST(0 AS DECIMAL(12,2)) AS total_spent, TIMESTAMP '1995-01-01' AS created_at
        FROM customer""",
    "passengers": """
        SELECT l_orderkey AS booking_id, l_linenumber AS ordinal, split_part(p_name, ' ', 1) AS first_name,
               split_part(p_name, ' ', 2) AS last_name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "alerts": f"""
        SELECT o_orderkey AS id, o_custkey AS user_id, {code('o_orderkey % 25')} AS origin_code,
               {code('c_nationkey')} AS destination_code, CAST(o_orderdate AS DATE) AS departure_date,
               CAST(floor(o_totalprice) / 100 AS DECIMAL(10,2)) AS target_price, o_orderstatus <> 'F' AS is_active,
               CAST(CAST(o_orderdate AS DATE) + 90 AS TIMESTAMP) AS expires_at, o_orderkey % 3 AS triggered_count,
               CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice) / 125 AS DECIMAL(10,2)) END AS last_price,
               o_orderdate AS created_at, {_CABIN_OF_PRIORITY} AS cabin_class
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "forecast": f"""
        SELECT *, greatest(800.0::DOUBLE, price - greatest(120.0::DOUBLE, price * 0.06::DOUBLE)) AS lower,
               price + greatest(120.0::DOUBLE, price * 0.06::DOUBLE) AS upper
        FROM (SELECT origin_code, destination_code, CAST(recorded_at AS DATE) AS date, {_MEAN} AS price,
                     row_number() OVER (PARTITION BY origin_code, destination_code ORDER BY CAST(recorded_at AS DATE)) AS day
              FROM bounded_history GROUP BY 1, 2, 3) WHERE day <= 30""",
    "snapshots": f"""
        SELECT *, {demand('days_until_departure', 'departure_date', 'seats_available')} AS demand_score,
               {season('departure_date')} AS seasonality_factor
        FROM (SELECT origin_code, destination_code, {_MEAN} AS current_price, max(departure_date) AS departure_date,
                     CAST(count(*) % 40 AS INTEGER) AS days_until_departure,
                     CAST(count(*) % 60 AS INTEGER) AS seats_available
              FROM bounded_history GROUP BY 1, 2)""",
    "profile_stats": """
        SELECT origin_code, destination_code, avg(price) FILTER (day <= 14) AS near_mean, stddev_pop(price) AS stdev,
               max(price) - min(price) AS spread, count(*) AS points, arg_min(price, day) AS first_price,
               arg_max(price, day) AS last_price
        FROM forecast GROUP BY 1, 2""",
    "offers": """
        SELECT origin_code || destination_code || strftime(departure_date, '%Y%m') AS search_id,
               concat_ws('-', l_orderkey, l_linenumber, departure_date, l_partkey, l_suppkey) AS offer_id,
               origin_code, destination_code, airline_code, cabin_class,
               CASE WHEN cabin_class <> 'FIRST' THEN airline_code || '-' || l_linenumber END AS flight_number,
               departure_date, CAST(departure_date AS TIMESTAMP) + to_hours(l_linenumber * 3) AS departure_time,
               price AS total,
               'PT' || (seats_available * 13) // 60 || 'H' || (seats_available * 13) % 60 || 'M' AS duration,
               days_until_dep, seats_available
        FROM price_history""",
    "coupons": """
        SELECT 'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code,
               CASE WHEN n_nationkey % 2 = 0 THEN 'PERCENT' ELSE 'FLAT' END AS discount_type,
               CAST(CASE WHEN n_nationkey % 2 = 0 THEN 5 + n_nationkey ELSE n_nationkey * 1000 + 500 END AS DECIMAL(10,2))
                   AS discount_value,
               CAST(CASE WHEN n_nationkey % 4 = 0 THEN 5000 END AS DECIMAL(10,2)) AS max_discount,
               CAST(n_nationkey * 4000 AS DECIMAL(10,2)) AS min_booking_amt,
               CASE WHEN n_nationkey <> 24 THEN 100 + n_nationkey * 20 END AS usage_limit, n_nationkey AS used_count,
               CASE WHEN n_nationkey <> 23 THEN 1 + n_nationkey % 5 END AS per_user_limit,
               CASE WHEN n_nationkey <> 22 THEN CAST('1998-06-' || lpad(CAST(1 + n_nationkey AS VARCHAR), 2, '0') AS TIMESTAMP)
                    END AS valid_until,
               n_nationkey <> 21 AS is_active
        FROM nation""",
    "users": f"""
        SELECT 'u' || c_custkey AS id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN {_MAIL} END AS email,
               CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS full_name,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN substr(c_name, 1, 8) END AS name,
               c_acctbal > 0 AS email_verified
        FROM customer""",
    "ticks": f"""
        SELECT ts, event_id, {code('user_id % 25')} AS origin_code, {code('event_id % 25')} AS destination_code,
               800 + value * 100 AS price FROM events""",
    "queue": """
        SELECT event_id AS id, user_id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'PENDING' END AS status,
               CAST(event_id % 5 AS INTEGER) AS retry_count, 3 AS max_retries, ts AS scheduled_at FROM events""",
    "outcomes": """
        SELECT ts, user_id AS notification_id,
               CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 100 THEN 'SENT' ELSE 'FAILED' END
                    WHEN event_type = 'error' THEN 'FAILED' ELSE 'DELAYED' END AS outcome FROM events""",
    "challenges": """
        SELECT event_id AS id, user_id, event_type AS purpose, value > 50 AS is_used,
               CAST(event_id % 7 AS INTEGER) AS attempts, 5 AS max_attempts, ts + INTERVAL 10 DAY AS expires_at,
               ts AS created_at FROM events""",
    "attempts": """
        SELECT user_id AS challenge_id, ts, event_id AS attempt_id, event_type = 'purchase' AND value > 30 AS is_match,
               TIMESTAMP '2024-01-15 00:00:00' AS expires_at FROM events""",
}


def with_tables(sql: str, *tables: str) -> str:
    """``sql`` preceded by the named tables and what they are built from."""
    needed: list[str] = []
    for t in tables:
        for part in [*_DEPENDS.get(t, []), t]:
            if part not in needed:
                needed.append(part)
    if not needed:
        return sql.strip()
    return "WITH " + ",\n".join(f"{t} AS ({TABLES[t]})" for t in needed) + "\n" + sql.strip()
