"""Two-sided matches as one row per competitor, and the joins around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw_bucket, points_type, won

CARRIED = ("id", "tour", "date", "round", "surface", "score", "best_of", "tournament_api_id", "tournament_name", "tournament_id", "event_name", "event_type", "draw_size", "active", "winner_id")


def sides(matches: DataFrame) -> DataFrame:
    """(mid, opp_id, we_p1, won, own, opp) for each side of each match, in one scan. won is null for an unknown winner."""
    have = [c for c in CARRIED if c in matches.columns]
    stats = "stat_p1" in matches.columns

    def side(me: str, them: str, first: bool):  # noqa: ANN202
        cols = [F.col(me).alias("mid"), F.col(them).alias("opp_id"), F.lit(first).alias("we_p1"), won(F.col("winner_id"), F.col(me), None).alias("won")]
        if stats:
            cols += [F.col("stat_p1" if first else "stat_p2").alias("own"), F.col("stat_p2" if first else "stat_p1").alias("opp")]
        return F.struct(*cols)

    return matches.select(*have, F.inline(F.array(side("p1_id", "p2_id", True), side("p2_id", "p1_id", False))))


def event_keys(events: DataFrame) -> DataFrame:
    """tour, api_id and the event's columns: one row for each provider id, so that joins stay equi-joins; the smallest id owns a key."""
    stacked = events.select("*", F.inline(F.array(F.struct(F.lit("atp").alias("key_tour"), F.col("api_id_atp").alias("api_id")), F.struct(F.lit("wta").alias("key_tour"), F.col("api_id_wta").alias("api_id")))))
    stacked = stacked.where("api_id is not null")
    first = stacked.groupBy("key_tour", "api_id").agg(F.min("id").alias("id"))
    return stacked.join(first, ["key_tour", "api_id", "id"])


def resolve_event(matches: DataFrame, events: DataFrame) -> DataFrame:
    """matches with tournament_id, event_name, event_type, draw_size and active; null where the catalog has no such event."""
    keys = event_keys(events).select("key_tour", "api_id", F.col("id").alias("tournament_id"), F.col("name").alias("event_name"), F.col("type").alias("event_type"), "draw_size", "active")
    return matches.join(keys, (matches.tour == keys.key_tour) & (matches.tournament_api_id == keys.api_id), "left").drop("key_tour", "api_id")


def reresolve(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Fills tournament_id where it is null and the catalog has grown; set ids stay."""
    keys = event_keys(events).select("key_tour", "api_id", F.col("id").alias("found"))
    joined = matches.join(keys, (matches.tour == keys.key_tour) & (matches.tournament_api_id == keys.api_id), "left")
    return joined.withColumn("tournament_id", F.coalesce("tournament_id", "found")).drop("key_tour", "api_id", "found")


def unresolved(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Matches whose event the catalog lacks."""
    keys = event_keys(events)
    return matches.join(keys, (matches.tour == keys.key_tour) & (matches.tournament_api_id == keys.api_id), "left_anti")


def top_n(players: DataFrame, n: int) -> DataFrame:
    return players.where(F.col("bio_id") <= n)


def tracked(rows: DataFrame, players: DataFrame) -> DataFrame:
    """Sides of known competitors of the same tour, with bio_id and name."""
    return rows.join(players.select("tour", "mid", "bio_id", "name", "country"), ["tour", "mid"])


def with_opponent(rows: DataFrame, players: DataFrame) -> DataFrame:
    known = players.select(F.col("tour").alias("o_tour"), F.col("mid").alias("o_mid"), F.col("name").alias("o_name"), F.col("country").alias("o_country"))
    joined = rows.join(known, (rows.tour == known.o_tour) & (rows.opp_id == known.o_mid), "left")
    return joined.withColumn("opponent", F.coalesce("o_name", F.lit("?"))).withColumn("opp_country", F.coalesce("o_country", F.lit(""))).drop("o_tour", "o_mid", "o_name", "o_country")


def with_stage(rows: DataFrame, semantics: DataFrame) -> DataFrame:
    """Adds played and next by draw and round; rounds without a meaning in their draw go. semantics is a lookup of fixed size."""
    keyed = rows.withColumn("draw_bucket", draw_bucket(F.col("draw_size")))
    return keyed.join(F.broadcast(semantics), ["draw_bucket", "round"])


def with_points(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Adds pts by event type, draw and stage; 0 where the table has none. points is a lookup of fixed size."""
    keyed = rows.withColumn("points_type", points_type(F.col("event_type"), F.col("draw_size")))
    return keyed.join(F.broadcast(points), ["points_type", "stage"], "left").withColumn("pts", F.coalesce("pts", F.lit(0)))


def active_coverage(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Active events with their number of matches, zero included, and the newest date."""
    counted = matches.where("tournament_id is not null").groupBy("tournament_id").agg(F.count(F.lit(1)).alias("n_matches"), F.max("date").alias("last_date"))
    joined = events.where("active").join(counted, F.col("id") == F.col("tournament_id"), "left")
    return joined.select("id", "name", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "last_date")
