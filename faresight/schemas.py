"""Declared schemas of the logical tables and the allowed values of their enumerations."""

from __future__ import annotations

_MONEY = "decimal(10,2)"

# DDL of every logical table; Spark readers take it as a schema.
SCHEMAS: dict[str, str] = {
    "airports": "iata_code string, icao_code string, name string, city string, state string, region string, "
    "country string, country_code string, latitude decimal(9,6), longitude decimal(9,6), timezone string, "
    "elevation_ft int, is_domestic boolean, is_international boolean, is_active boolean, terminal_count int, "
    "runway_count int, longest_runway_m int, category string, created_at timestamp",
    "airlines": "iata_code string, icao_code string, name string, short_name string, country string, "
    "is_domestic boolean, is_lowcost boolean, hub_airport string, website string, contact_phone string, "
    "is_active boolean, created_at timestamp",
    "profiles": "id string, auth_user_id string, email string, full_name string, display_name string, phone string, "
    "phone_verified boolean, email_verified boolean, date_of_birth date, gender string, nationality string, "
    "passport_number string, passport_expiry date, id_last4 string, preferred_currency string, "
    "preferred_cabin string, preferred_language string, avatar_url string, notify_email boolean, "
    "notify_sms boolean, notify_whatsapp boolean, notify_push boolean, preferred_airlines array<string>, "
    "preferred_seat string, meal_preference string, frequent_flyer map<string,string>, loyalty_points int, "
    "tier string, total_bookings int, total_spent decimal(12,2), last_login timestamp, login_count int, "
    "is_active boolean, created_at timestamp, updated_at timestamp",
    "user_sessions": "id string, user_id string, ip_address string, user_agent string, device_type string, "
    "city string, country string, is_active boolean, created_at timestamp, last_seen_at timestamp, "
    "expires_at timestamp",
    "otp_verifications": "id string, user_id string, identifier string, otp_hash string, purpose string, "
    "channel string, is_used boolean, attempts int, max_attempts int, expires_at timestamp, used_at timestamp, "
    "created_at timestamp",
    "routes": "id string, origin_code string, destination_code string, distance_km int, avg_duration_min int, "
    f"is_active boolean, airlines array<string>, min_price {_MONEY}, avg_price {_MONEY}, max_price {_MONEY}, "
    "flights_per_day int, is_popular boolean, created_at timestamp, updated_at timestamp",
    "flights": "id string, flight_number string, airline_code string, origin_code string, destination_code string, "
    "departure_time timestamp, arrival_time timestamp, duration_min int, stops int, cabin_class string, "
    f"aircraft_type string, total_seats int, available_seats int, base_price {_MONEY}, current_price {_MONEY}, "
    "currency string, status string, terminal string, gate string, baggage_kg int, raw_offer string, "
    "created_at timestamp, updated_at timestamp",
    "price_history": "id string, origin_code string, destination_code string, airline_code string, "
    f"flight_number string, cabin_class string, price {_MONEY}, currency string, departure_date date, "
    "days_until_dep int, day_of_week int, month int, week_of_year int, is_holiday boolean, is_weekend boolean, "
    "seats_available int, urgency double, is_live boolean, training_weight double, recorded_at timestamp",
    "coupons": f"id string, code string, description string, discount_type string, discount_value {_MONEY}, "
    f"max_discount {_MONEY}, min_booking_amt {_MONEY}, usage_limit int, used_count int, per_user_limit int, "
    "applicable_for string, valid_from timestamp, valid_until timestamp, is_active boolean, created_at timestamp",
    "bookings": "id string, booking_reference string, user_id string, flight_id string, pnr string, status string, "
    f"payment_status string, total_price {_MONEY}, base_fare {_MONEY}, taxes {_MONEY}, baggage_charges {_MONEY}, "
    f"meal_charges {_MONEY}, seat_charges {_MONEY}, discount_amount {_MONEY}, currency string, "
    "cabin_class string, num_passengers int, contact_email string, contact_phone string, coupon_code string, "
    "payment_method string, payment_id string, order_id string, payment_signature string, points_used int, "
    "points_earned int, booking_source string, origin_code string, destination_code string, "
    "supplier_booking_id string, flight_offer_data string, confirmation_sent boolean, reminder_sent boolean, "
    "checkin_notif_sent boolean, status_notif_sent boolean, cancelled_at timestamp, cancellation_reason string, "
    f"refund_amount {_MONEY}, refund_id string, refund_status string, created_at timestamp, updated_at timestamp",
    "passengers": "id string, booking_id string, ordinal int, passenger_type string, title string, "
    "first_name string, last_name string, date_of_birth date, gender string, nationality string, "
    "passport_number string, passport_expiry date, passport_country string, national_id string, "
    "seat_number string, seat_preference string, meal_preference string, baggage_kg int, ff_number string, "
    "ff_airline string, special_request string, created_at timestamp",
    "notifications": "id string, user_id string, booking_id string, type string, channel string, recipient string, "
    "subject string, message string, template_id string, status string, provider string, provider_id string, "
    "error_message string, retry_count int, max_retries int, scheduled_at timestamp, sent_at timestamp, "
    "delivered_at timestamp, opened_at timestamp, created_at timestamp",
    "price_alerts": "id string, user_id string, origin_code string, destination_code string, departure_date date, "
    f"return_date date, cabin_class string, adults int, children int, target_price {_MONEY}, currency string, "
    "preferred_airline string, is_active boolean, email string, phone string, notify_email boolean, "
    f"notify_sms boolean, notify_whatsapp boolean, last_checked timestamp, last_price {_MONEY}, "
    f"lowest_seen {_MONEY}, triggered_count int, triggered_at timestamp, expires_at timestamp, "
    "created_at timestamp",
    "saved_searches": "id string, user_id string, search_name string, origin_code string, destination_code string, "
    "departure_date date, return_date date, adults int, children int, infants int, cabin_class string, "
    "is_round_trip boolean, search_params string, search_count int, last_searched timestamp, "
    "created_at timestamp",
}

# Allowed members of each enumeration.
ALLOWED = {
    "cabin_class": ["ECONOMY", "PREMIUM_ECONOMY", "BUSINESS", "FIRST"],
    "booking_status": ["PENDING", "CONFIRMED", "CANCELLED", "REFUND_PENDING"],
    "payment_status": ["UNPAID", "PAID", "REFUND_PENDING", "REFUNDED", "VOID"],
    "passenger_type": ["ADULT", "CHILD", "INFANT"],
    "trend": ["RISING", "FALLING", "STABLE"],
    "recommendation": ["BOOK_NOW", "WAIT", "MONITOR"],
    "market_status": ["VOLATILE", "STABLE"],
    "channel": ["EMAIL", "SMS", "WHATSAPP"],
    "tier": ["BLUE", "SILVER", "GOLD", "PLATINUM"],
}

# Declared references: child table, column, parent table, parent column.
FOREIGN_KEYS = [
    ("airlines", "hub_airport", "airports", "iata_code"),
    ("user_sessions", "user_id", "profiles", "id"),
    ("otp_verifications", "user_id", "profiles", "id"),
    ("routes", "origin_code", "airports", "iata_code"),
    ("routes", "destination_code", "airports", "iata_code"),
    ("flights", "airline_code", "airlines", "iata_code"),
    ("flights", "origin_code", "airports", "iata_code"),
    ("flights", "destination_code", "airports", "iata_code"),
    ("price_history", "origin_code", "airports", "iata_code"),
    ("price_history", "destination_code", "airports", "iata_code"),
    ("price_history", "airline_code", "airlines", "iata_code"),
    ("bookings", "user_id", "profiles", "id"),
    ("bookings", "flight_id", "flights", "id"),
    ("bookings", "coupon_code", "coupons", "code"),
    ("passengers", "booking_id", "bookings", "id"),
    ("notifications", "user_id", "profiles", "id"),
    ("notifications", "booking_id", "bookings", "id"),
    ("price_alerts", "user_id", "profiles", "id"),
    ("price_alerts", "origin_code", "airports", "iata_code"),
    ("price_alerts", "destination_code", "airports", "iata_code"),
    ("price_alerts", "preferred_airline", "airlines", "iata_code"),
    ("saved_searches", "user_id", "profiles", "id"),
    ("saved_searches", "origin_code", "airports", "iata_code"),
    ("saved_searches", "destination_code", "airports", "iata_code"),
]

# Nested shape of one bookable offer.
SEGMENT = (
    "struct<flight_number:string,airline_code:string,airline_name:string,origin:string,destination:string,"
    "departure_time:string,arrival_time:string,duration:string,cabin:string,stops:int>"
)
OFFER = (
    "struct<id:string,source:string,price:struct<total:double,base:double,currency:string>,"
    f"itineraries:array<struct<duration:string,segments:array<{SEGMENT}>>>,"
    "primary_airline:string,primary_airline_name:string,seats_available:int>"
)
# Shape accepted from outside, with both spellings of place and time.
RAW_SEGMENT = (
    "struct<flight_number:string,airline_code:string,carrierCode:string,origin:string,destination:string,"
    "departure_time:string,arrival_time:string,departure:struct<iataCode:string,at:string>,"
    "arrival:struct<iataCode:string,at:string>,duration:string>"
)
RAW_OFFER = (
    "struct<id:string,price:struct<grandTotal:string,grand_total:string,total:string,base:string,currency:string>,"
    f"itineraries:array<struct<duration:string,segments:array<{RAW_SEGMENT}>>>,seats_available:int>"
)
