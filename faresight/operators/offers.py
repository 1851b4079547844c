"""Airport search, offer ranking and de-duplication, chart sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import clip, col, names
from ..functions.text import duration_minutes
from .ordered import row_index, top_k

_GRAM = 3


def _grams(text: Column, size: int = _GRAM) -> Column:
    """Distinct substrings of ``size`` characters."""
    last = F.length(text) - size + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _contains_any(fields: Sequence[Column], q: Column) -> Column:
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), q), F.lit(False))
    return hit


def search_airports(
    airports: DataFrame,
    queries: DataFrame,
    query: str = "query",
    code: str = "iata_code",
    fields: Sequence[str] = ("city", "name"),
    code_prefix_only: bool = False,
) -> DataFrame:
    """(query, airport) pairs where the query occurs, ignoring case, in the code or a text field.

    A match must share every three-letter piece of the query, so queries meet airports through an
    equi join on the query's rarest piece and the exact test runs on those candidates only. Queries
    shorter than three letters join on their one or two letters the same way. Only pieces that some
    query asks for leave the airports, so what is shuffled are candidates and not all pieces of all texts.
    ``code_prefix_only`` restricts the code to prefix matches and the airports to active ones.
    """
    dim = airports.filter("is_active") if code_prefix_only else airports
    texts = [F.col(code), *[F.col(f) for f in fields]]
    cut = lambda t, n: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    pieces = F.flatten(F.array(*[cut(t, n) for t in texts for n in (1, 2, 3)]))
    # Many airports can lie in one small file; cutting them up is work for all tasks.
    spread = dim.select(F.col(code), *[F.col(f) for f in fields]).repartition(int(dim.sparkSession.conf.get("spark.sql.shuffle.partitions")), code)

    def index(wanted: DataFrame) -> DataFrame:
        """Airports by those of their pieces that are wanted: a set that the alphabet bounds, so it goes to the airports."""
        held = spread.select(F.col(code), F.explode(F.array_distinct(pieces)).alias("_piece"))
        return held.join(F.broadcast(wanted.select("_piece").distinct()), "_piece", "left_semi")

    asked = queries.select(F.col(query), F.lower(F.trim(F.col(query))).alias("_q")).distinct()
    asked = asked.filter(F.length("_q") > 0)
    own = F.when(F.length("_q") < _GRAM, F.array("_q")).otherwise(_grams(F.col("_q")))
    each = asked.withColumn("_piece", F.explode(own))
    frequency = index(each).groupBy("_piece").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (
        each.join(frequency, "_piece", "left")
        .groupBy(query, "_q")
        .agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_piece"))).alias("_r"))
        .filter(F.col("_r.df") > 0)
        .select(query, "_q", F.col("_r._piece").alias("_piece"))
    )
    pairs = rarest.join(index(rarest), "_piece").join(dim, code)
    in_code = F.lower(F.col(code)).startswith(F.col("_q")) if code_prefix_only else F.contains(F.lower(F.col(code)), F.col("_q"))
    hit = in_code | _contains_any([F.col(f) for f in fields], F.col("_q"))
    return pairs.filter(hit).drop("_piece", "_q")


def rank_airports(
    matches: DataFrame, home: str = "India", limit: int = 10, query: str = "query", code: str = "iata_code"
) -> DataFrame:
    """Best ``limit`` airports per query: home country first, an exact code first within it."""
    away = F.col("country") != home
    inexact = F.lower(F.col(code)) != F.lower(F.trim(F.col(query)))
    return top_k(matches, query, [away, inexact, code], limit, rank="position")


def rank_airports_international(
    matches: DataFrame, limit: int = 10, query: str = "query", code: str = "iata_code"
) -> DataFrame:
    """Variant that lists international airports first."""
    return top_k(matches, query, [F.desc("is_international"), F.col(code)], limit, rank="position")


def dedupe_offers(
    offers: DataFrame,
    search: str | Sequence[str] = "search_id",
    price: str = "total",
    offer: str = "offer_id",
    key: Sequence[str] = ("flight_number", "departure_time"),
) -> DataFrame:
    """Cheapest offer per flight number and departure time of a search; offers without a key all stay."""
    keyless = F.lit(False)
    for c in key:
        keyless = keyless | F.col(c).isNull()
    tagged = offers.withColumn("_own", F.when(keyless, F.col(offer).cast("string")).otherwise(F.lit("")))
    return top_k(tagged, [*names(search), *key, "_own"], [price, offer], 1).drop("_own")


def cheapest_offers(
    offers: DataFrame, max_results: int = 20, search: str | Sequence[str] = "search_id", price: str = "total",
    offer: str = "offer_id",
) -> DataFrame:
    return top_k(offers, search, [price, offer], max_results, rank="position")


def sort_offers(offers: DataFrame, by: str = "price", offer: str = "offer_id") -> DataFrame:
    """Offers with their 1-based ``position`` by price, by duration in minutes, or by departure; ties by offer."""
    key = {
        "price": F.coalesce(F.col("total"), F.lit(0.0)) if "total" in offers.columns else F.lit(0.0),
        "duration": duration_minutes("duration") if "duration" in offers.columns else F.lit(0),
        "departure": F.col("departure_time") if "departure_time" in offers.columns else F.lit(0),
    }[by]
    return row_index(offers, [], [key, offer], out="position")


def trips_recent_first(bookings: DataFrame, user: str = "user_id", at: str = "created_at") -> DataFrame:
    """Bookings with their 1-based ``position`` among those of the same customer, newest first; ties by id."""
    return row_index(bookings, user, [F.desc(at), "id"], out="position")


def mark_best_offer(
    offers: DataFrame, search: str | Sequence[str] = "search_id", price: str = "total", offer: str = "offer_id"
) -> DataFrame:
    """Flags the cheapest offer of every search; the winner is aggregated, so no search is sorted whole."""
    k = names(search)
    best = offers.groupBy(*k).agg(F.min(F.struct(price, offer)).getField(offer).alias("_best"))
    return offers.join(best, k, "left").withColumn("is_best", F.col(offer) == F.col("_best")).drop("_best")


def enrich_offers(offers: DataFrame, predicted: str = "predicted", price: str = "total") -> DataFrame:
    """Advice per offer from the model's fare; offers without a prediction are only to be monitored."""
    fare = clip(col(predicted), 2800.0, 55000.0)
    up = fare > F.col(price) * 1.12
    down = fare < F.col(price) * 0.88

    def advise(missing: str | None, rise: str, fall: str, else_: str) -> Column:
        return F.when(F.col(predicted).isNull(), missing).when(up, rise).when(down, fall).otherwise(else_)

    return offers.withColumns(
        {
            "ai_price": F.coalesce(F.bround(F.when(F.col(predicted).isNotNull(), fare), 0), F.col(price)),
            "recommendation": advise("MONITOR", "BOOK NOW", "WAIT", "FAIR PRICE"),
            "trend": advise("STABLE", "INCREASING", "DECREASING", "STABLE"),
            "decision": advise(None, "BUY NOW", "WAIT", "FAIR"),
            "advice": advise(
                None,
                "Prices expected to rise — lock in this fare.",
                "Model predicts a price drop soon.",
                "Current price is within normal range.",
            ),
        }
    )


def top_routes(routes: DataFrame, k: int = 3) -> DataFrame:
    """Busiest k routes of every origin."""
    return top_k(routes, "origin_code", [F.desc("flights_per_day"), F.col("destination_code")], k, rank="position")


def recent_per_user(df: DataFrame, n: int, newest: str = "created_at", id_col: str = "id") -> DataFrame:
    return top_k(df, "user_id", [F.desc(newest), F.desc(id_col)], n, rank="position")


def downsample_series(
    forecast: DataFrame, every: int, keys: str | Sequence[str] = ("origin_code", "destination_code"),
    order: str = "day", anchor: int = 0, first: bool = True,
) -> DataFrame:
    """Every ``every``-th point (1-based position congruent to ``anchor``) plus the ends of each series.

    ``anchor=0`` gives positions 7, 14, … for weekly ticks, ``anchor=1`` positions 1, 6, … for dots.
    """
    placed = row_index(forecast, keys, [order], out="position", total="_total")
    pos = F.col("position")
    keep = (pos % every == anchor % every) | (pos == F.col("_total"))
    return placed.filter(keep | (pos == 1) if first else keep).drop("_total")
