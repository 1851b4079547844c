"""Text, code and hash helpers. All of them are Column expressions for whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..columns import col, half_up, non_blank, value

# City spellings and the airport code each one stands for.
CITY_CODES = {
    "delhi": "DEL", "new delhi": "DEL", "mumbai": "BOM", "bombay": "BOM", "bangalore": "BLR", "bengaluru": "BLR",
    "hyderabad": "HYD", "chennai": "MAA", "madras": "MAA", "kolkata": "CCU", "calcutta": "CCU", "kochi": "COK",
    "cochin": "COK", "goa": "GOI", "ahmedabad": "AMD", "jaipur": "JAI", "lucknow": "LKO", "pune": "PNQ",
    "amritsar": "ATQ", "guwahati": "GAU", "varanasi": "VNS", "patna": "PAT", "bhubaneswar": "BBI", "ranchi": "IXR",
    "srinagar": "SXR", "jammu": "IXJ", "leh": "IXL", "port blair": "IXZ", "mangalore": "IXE", "coimbatore": "CJB",
    "madurai": "IXM", "tiruchirappalli": "TRZ", "trichy": "TRZ", "thiruvananthapuram": "TRV", "trivandrum": "TRV",
    "kozhikode": "CCJ", "calicut": "CCJ", "indore": "IDR", "bhopal": "BHO", "chandigarh": "IXC", "dubai": "DXB",
    "london": "LHR", "singapore": "SIN", "doha": "DOH", "bangkok": "BKK", "istanbul": "IST", "tokyo": "NRT",
    "abu dhabi": "AUH", "kuala lumpur": "KUL", "new york": "JFK",
}

# Prefix of offers and booking references.
REFERENCE_PREFIX = "SKY"


def norm_code(c: str | Column) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def _city_code(c: Column, cities: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in cities.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(c)))


def resolve_code(c: str | Column, cities: dict[str, str] = CITY_CODES) -> Column:
    """Three letters pass through, then ``City (XXX)``, then the city table, then the first three letters."""
    text = F.trim(col(c))
    bracketed = F.regexp_extract(text, r"\(([^)]+)\)", 1)
    return (
        F.when(text == "", "")
        .when(text.rlike("^[A-Za-z]{3}$"), F.upper(text))
        .when(F.length(bracketed) == 3, F.upper(bracketed))
        .otherwise(F.coalesce(_city_code(text, cities), F.upper(F.substring(text, 1, 3))))
    )


def resolve_city(c: str | Column, cities: dict[str, str] = CITY_CODES) -> Column:
    """City table, else the upper-cased input as it is."""
    text = col(c)
    return F.coalesce(_city_code(text, cities), norm_code(text))


def _hex_number(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def stable_seed(*parts: str | Column, sep: str = "|") -> Column:
    """48-bit integer from the SHA-256 of the joined parts."""
    joined = F.concat_ws(sep, *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return _hex_number(F.sha2(joined, 256), 1, 12)


def md5_mod(text: Column, modulus: int) -> Column:
    """The 128-bit MD5 number modulo ``modulus``, folded 32 bits at a time so that it stays in a long."""
    digest = F.md5(text)
    shift = 2**32 % modulus
    out = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        out = (out * shift + _hex_number(digest, start, 8)) % modulus
    return out


def hash_bucket_estimate(origin: str | Column, destination: str | Column) -> Column:
    """Fallback fare of a route no model knows: 3000 plus a stable four-digit hash."""
    blank = F.lit("")
    route = F.concat(F.coalesce(col(origin), blank), F.coalesce(col(destination), blank))
    return (md5_mod(route, 10000) + 3000).cast("double")


def hash_percent(*parts: str | Column, seed: int = 42) -> Column:
    """Stable 0..99 bucket of a row key; independent of partitioning and of the engine."""
    return md5_mod(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]), 100)


def booking_ref(key: str | Column, as_of, salt: int = 0, digits: int = 6) -> Column:
    """Prefix, two-digit year and hex digits derived from the row key (a stable stand-in for random digits)."""
    year = F.date_format(value(as_of).cast("date"), "yy")
    digest = F.md5(F.concat_ws("#", col(key).cast("string"), F.lit(str(salt))))
    return F.concat(F.lit(REFERENCE_PREFIX), year, F.upper(F.substring(digest, 1, digits)))


def display_name(full_name, name, email, user_id) -> Column:
    return F.coalesce(
        col(full_name),
        col(name),
        F.split_part(col(email), F.lit("@"), F.lit(1)),
        F.concat(F.lit("User "), F.substring(col(user_id).cast("string"), 1, 8)),
    )


# Message formats. ``brand`` is the sender's name.
def confirmation_subject(ref: str | Column) -> Column:
    return F.concat(F.lit("Booking "), col(ref), F.lit(" Confirmed!"))


def confirmation_email(total: str | Column, brand: str) -> Column:
    return F.concat(F.lit(f"Your {brand} booking is confirmed. Amount: Rs."), col(total).cast("string"))


def confirmation_sms(ref, total, brand: str, limit: int = 160) -> Column:
    text = F.concat(F.lit(f"{brand}: Bkg "), col(ref), F.lit(" confirmed! Rs."), col(total).cast("string"))
    return F.substring(text, 1, limit)


def welcome_text(name: str | Column) -> Column:
    return F.concat(F.lit("Hi "), col(name), F.lit("! Your flight companion is ready."))


def alert_text(origin, destination, current, target, limit: int = 160) -> Column:
    return F.substring(
        F.concat(
            col(origin), F.lit(" to "), col(destination), F.lit(": now Rs."), F.format_number(col(current), 0),
            F.lit(", target Rs."), F.format_number(col(target), 0),
        ),
        1,
        limit,
    )


def format_amount(amount: str | Column, currency: str | Column | None = None) -> Column:
    unit = F.lit("INR") if currency is None else col(currency)
    return F.concat(unit, F.lit(" "), F.format_number(col(amount), 2))


def format_lakh(amount: str | Column, symbol: str = "₹") -> Column:
    """Whole amount with Indian digit grouping: the last three digits, then pairs."""
    whole = half_up(col(amount)).cast("string")
    return F.concat(F.lit(symbol), F.regexp_replace(whole, r"(\d)(?=(\d\d)+\d$)", "$1,"))


def duration_minutes(c: str | Column) -> Column:
    """``PT#H#M`` to minutes; null for any other text."""
    pattern = r"PT(?:(\d+)H)?(?:(\d+)M)?"
    hours = F.coalesce(F.regexp_extract(col(c), pattern, 1).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.regexp_extract(col(c), pattern, 2).try_cast("int"), F.lit(0))
    return F.when(col(c).contains("PT"), hours * 60 + minutes)


def iso_duration(minutes: str | Column) -> Column:
    m = col(minutes).cast("int")
    return F.concat(F.lit("PT"), F.floor(m / 60).cast("string"), F.lit("H"), (m % 60).cast("string"), F.lit("M"))


def format_duration(c: str | Column) -> Column:
    pattern = r"PT(?:(\d+)H)?(?:(\d+)M)?"
    hours = F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit(""))
    minutes = F.nullif(F.regexp_extract(col(c), pattern, 2), F.lit(""))
    text = F.concat_ws(" ", F.concat(hours, F.lit("h")), F.concat(minutes, F.lit("m")))
    return F.when(F.coalesce(col(c), F.lit("")) == "", "--").otherwise(F.when(text == "", col(c)).otherwise(text))


def safe_number(c: str | Column) -> Column:
    """Leading number of messy text without ``,`` and ``%``; anything else is 0."""
    cleaned = F.trim(F.regexp_replace(col(c).cast("string"), "[,%]", ""))
    lead = F.regexp_extract(cleaned, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    number = lead.try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def canon_recommendation(c: str | Column) -> Column:
    text = F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), r"[\s-]", "_")
    return (
        F.when(text.contains("BUY") | text.contains("BOOK"), "BOOK_NOW")
        .when(text.contains("WAIT"), "WAIT")
        .otherwise("MONITOR")
    )


def norm_phone(c: str | Column) -> Column:
    text = F.regexp_replace(F.replace(col(c), F.lit("+91"), F.lit("")), "[ -]", "")
    return F.right(F.trim(text), F.lit(10))


def is_indian_phone(c: str | Column) -> Column:
    return col(c).startswith("+91") | col(c).rlike(r"^\d{10}$")


def hash_equals(code: str | Column, stored: str | Column) -> Column:
    return F.sha2(col(code).cast("string"), 256) == col(stored)


def reason_text(recommendation, probability, confidence, peak=None) -> Column:
    """One-line explanation of a canonical recommendation, percentages rounded half up."""
    pct = half_up(col(probability) * 100).cast("string")
    conf = half_up(col(confidence) * 100).cast("string")
    season = F.when(F.lit(False) if peak is None else col(peak), " Peak season demand is elevated.").otherwise("")
    book = F.concat(pct, F.lit("% probability of price increase detected. Model confidence: "), conf, F.lit("%."),
                    season, F.lit(" Lock in this fare now."))
    wait = F.concat(F.lit("Prices may soften — only "), pct, F.lit("% chance of an increase. Model confidence: "),
                    conf, F.lit("%."), season, F.lit(" Consider waiting a few days."))
    hold = F.concat(F.lit("Market is stable with "), pct, F.lit("% probability of increase. Model confidence: "),
                    conf, F.lit("%."), season, F.lit(" Monitor and book when ready."))
    rec = col(recommendation)
    return F.when(rec == "BOOK_NOW", book).when(rec == "WAIT", wait).otherwise(hold)


def offer_id(origin, destination, airline, airline_idx, slot_idx) -> Column:
    parts: Sequence[Column] = [col(c).cast("string") for c in (origin, destination, airline, airline_idx, slot_idx)]
    return F.concat_ws("-", F.lit(REFERENCE_PREFIX), *parts)


def flight_number(airline, airline_idx, slot_idx, draw, base: int = 100) -> Column:
    number = F.lit(base) + col(airline_idx) * 10 + col(slot_idx) + col(draw)
    return F.concat(col(airline), number.cast("int").cast("string"))


def coalesce_text(*spellings: str | Column) -> Column:
    """First spelling that is present and not blank."""
    return F.coalesce(*[non_blank(c) for c in spellings])
