"""Landed JSON payloads and catalogs as DataFrames, without inferred schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.columns import first_truthy, points_type, surface_of

_RAW = "array<string>"


def page_body(page: Column) -> Column:
    """The text of a page's list, which is the page or its data; null for any other body."""
    body = F.when(F.ltrim(page).startswith("["), page).otherwise(F.get_json_object(page, "$.data"))
    return F.when(F.ltrim(body).startswith("["), body)


def page_items(page: Column) -> Column:
    """The items of a page body that is {data: [...]} or a bare array, as JSON text; other bodies have none."""
    # objects are kept as text, so that fields with unstable types can be read apart
    return F.coalesce(F.from_json(page_body(page), _RAW), F.array().cast(_RAW))


def payload_items(pages: DataFrame, column: str = "value") -> DataFrame:
    """item: the JSON text of each item of each page; the other columns of pages stay."""
    rest = [c for c in pages.columns if c != column]
    return pages.select(*rest, F.explode_outer(page_items(F.col(column))).alias("item")).where("item is not null")


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """value, file, bytes, landed_at and the folder names' columns: a row for each file under path, in one scan."""
    pages = spark.read.option("basePath", path).text(path, wholetext=True)
    meta = {"file": "file_path", "bytes": "file_size", "landed_at": "file_modification_time"}
    return pages.select("*", *(F.col(f"_metadata.{field}").alias(name) for name, field in meta.items()))


def rejected_pages(pages: DataFrame) -> DataFrame:
    """Pages whose body is no list, or no JSON, with the start of it: what a reader of the items would not see."""
    return pages.where(F.from_json(page_body(F.col("value")), _RAW).isNull()).withColumn("starts", F.substring("value", 1, 80)).drop("value")


def read_match_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Items of the files of a directory and its folders, whose names may give columns (tour=…)."""
    return payload_items(landed_pages(spark, path).drop("bytes", "landed_at"))


def read_ranking_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The same with a race column (true for the race list) from the folder names race=true and race=false."""
    items = read_match_payloads(spark, path)
    return items.withColumn("race", F.col("race").cast("boolean")) if "race" in items.columns else items


def _field(name: str) -> Column:
    return F.get_json_object("item", f"$.{name}")


def round_of(whole: Column) -> Column:
    """A round is a string or an object with a shortName or a name."""
    return F.coalesce(F.get_json_object(whole, "$.shortName"), F.get_json_object(whole, "$.name"), F.when(~whole.startswith("{"), whole))


_SIDES = {"stat_p1": ("stat1", "p1", "1", "player1"), "stat_p2": ("stat2", "p2", "2", "player2")}
_STAT = "struct<" + ",".join(f"`{n}`:string" for names in _SIDES.values() for n in names) + ">"
#: All fields as text, as their types are not stable; objects among them are kept as text.
_MATCH = f"""id string, matchId string, tournament struct<id:string,name:string,tournamentName:string,courtId:string>, `date` string, matchDate string, round string,
player1Id string, p1Id string, player2Id string, p2Id string, match_winner string, winnerId string, winner_id string, result string, score string, bestOf string, best_of string, stat {_STAT}, stats {_STAT}"""


def to_matches(items: DataFrame, tour: str | Column) -> DataFrame:
    """The canonical projection of match items, each parsed once. Rows without an id, a player or a whole date go."""
    of = lambda name: F.col(f"_m.{name}")
    filled = lambda blob: F.nullif(blob, F.lit("{}"))
    # the stats object is the whole of stat or, without one, of stats
    blob = lambda names: F.from_json(F.when(of("stat").isNotNull(), F.coalesce(*(filled(of("stat")[n]) for n in names))).otherwise(F.coalesce(*(filled(of("stats")[n]) for n in names))), schema.STATS)
    day = first_truthy(of("date"), of("matchDate"))
    parsed = items.select("*", F.explode_outer(F.array(F.from_json("item", _MATCH))).alias("_m"))  # else the filter below would parse an item again for each of its columns
    out = parsed.select(
        first_truthy(of("id"), of("matchId")).alias("id"),
        of("tournament.id").try_cast("int").alias("tournament_api_id"),
        first_truthy(of("tournament.name"), of("tournament.tournamentName")).alias("tournament_name"),
        F.when(F.length(day) >= 10, F.substring(day, 1, 10).try_cast("date")).alias("date"),
        round_of(of("round")).alias("round"),
        surface_of(of("tournament.courtId").try_cast("int")).alias("surface"),
        (F.lit(tour) if isinstance(tour, str) else tour).alias("tour"),
        first_truthy(of("player1Id"), of("p1Id")).try_cast("long").alias("p1_id"),
        first_truthy(of("player2Id"), of("p2Id")).try_cast("long").alias("p2_id"),
        first_truthy(of("match_winner"), of("winnerId"), of("winner_id")).try_cast("long").alias("winner_id"),
        first_truthy(of("result"), of("score")).alias("score"),
        first_truthy(of("bestOf"), of("best_of")).try_cast("int").alias("best_of"),
        blob(_SIDES["stat_p1"]).alias("stat_p1"),
        blob(_SIDES["stat_p2"]).alias("stat_p2"),
        F.col("item").alias("raw"),
    )
    return out.where("id is not null and p1_id is not null and p2_id is not null and date is not null")


def to_rankings(items: DataFrame, *keep: str) -> DataFrame:
    """rank, points, race_points, player_id, player_name, country of ranking items, after the columns to keep."""
    return items.select(
        *keep,
        first_truthy(_field("position"), _field("currentRank")).try_cast("int").alias("rank"),
        F.coalesce(first_truthy(_field("point"), _field("points")).try_cast("int"), F.lit(0)).alias("points"),
        F.coalesce(first_truthy(_field("racePoints"), _field("points")).try_cast("int"), F.lit(0)).alias("race_points"),
        first_truthy(_field("player.id"), _field("playerId"), _field("player_id")).try_cast("long").alias("player_id"),
        first_truthy(_field("player.name"), _field("playerName"), _field("name")).alias("player_name"),
        _field("player.countryAcr").alias("country"),
    )


def load_players(raw: DataFrame) -> DataFrame:
    """Player catalog rows: those without a mid go, nat and id are renamed, surf, form and inj nest in meta."""
    return raw.where("mid is not null and mid <> 0").select(
        F.col("mid").cast("long"), F.lower("tour").alias("tour"), F.col("id").cast("int").alias("bio_id"), "sid", "name", "ab", F.col("nat").alias("country"), F.col("age").cast("int"),
        F.struct("surf", "form", F.coalesce("inj", F.lit(False)).alias("inj")).alias("meta"),
    )


def load_events(raw: DataFrame, points: DataFrame) -> DataFrame:
    """Event catalog rows with their points table (null for an unknown type)."""
    tables = points.groupBy("points_type").agg(F.map_from_entries(F.collect_list(F.struct("stage", "pts"))).alias("points_table"))
    rows = raw.select(
        "id", "name", "short", F.lower("tour").alias("tour"), "type", F.col("surf").alias("surface"), F.col("draw").cast("int").alias("draw_size"), F.col("startDate").try_cast("date").alias("start_date"),
        F.col("endDate").try_cast("date").alias("end_date"), F.col("apiId.atp").cast("int").alias("api_id_atp"), F.col("apiId.wta").cast("int").alias("api_id_wta"), F.coalesce("active", F.lit(False)).alias("active"),
    )
    keyed = rows.withColumn("points_type", points_type(F.col("type"), F.col("draw_size")))
    return keyed.join(tables, "points_type", "left").drop("points_type")


def points_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """points_type, stage, pts from {type: {round: points}} texts."""
    nested = raw.select(F.explode(F.from_json(F.col(column), "map<string,map<string,int>>")).alias("points_type", "row"))
    return nested.select("points_type", F.explode("row").alias("stage", "pts"))


#: Counters of the winner/loser files.
WL = {"ace": "aces", "df": "doubleFaults", "svpt": "svpt", "1stIn": "firstServeIn", "1stWon": "firstServeWon", "2ndWon": "secondServeWon", "bpSaved": "breakPointSaved", "bpFaced": "breakPointFaced"}
WL_SCHEMA = "date string, tourney_name string, surface string, round string, winner_id long, loser_id long, score string, best_of int, " + ", ".join(f"{s}_{c} string" for s in "wl" for c in WL)


def read_wl_csv(spark: SparkSession, path: str, tour: str) -> DataFrame:
    return wl_to_matches(spark.read.csv(path, schema=WL_SCHEMA, header=True), tour)


def wl_to_matches(rows: DataFrame, tour: str) -> DataFrame:
    """Winner/loser history as matches with p1 the winner, counters under the common names."""
    blob = lambda side: F.create_map(*(x for c, name in WL.items() for x in (F.lit(name), F.coalesce(F.col(f"{side}_{c}"), F.lit("")))))
    day = F.coalesce(F.col("date").try_cast("date"), F.try_to_timestamp("date", F.lit("yyyyMMdd")).cast("date"))
    return rows.select(
        F.concat_ws("-", F.lit("wl"), day.cast("string"), "winner_id", "loser_id").alias("id"), day.alias("date"), F.col("tourney_name").alias("tournament_name"), "round", F.upper(F.substring("surface", 1, 1)).alias("surface"), F.lit(tour).alias("tour"),
        F.col("winner_id").alias("p1_id"), F.col("loser_id").alias("p2_id"), F.col("winner_id").alias("winner_id"), "score", "best_of", blob("w").alias("stat_p1"), blob("l").alias("stat_p2"),
    )


def read_snapshot(spark: SparkSession, path: str, tables: list[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}
