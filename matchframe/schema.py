"""Schemas and lookup relations of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Schemas as DDL.
STATS = "map<string,string>"
PLAYERS = "mid long, tour string, bio_id int, sid string, name string, ab string, country string, age int, meta struct<surf:struct<H:double,C:double,G:double>,form:string,inj:boolean>"
EVENTS = "id string, name string, short string, tour string, type string, surface string, draw_size int, start_date date, end_date date, api_id_atp int, api_id_wta int, active boolean, points_table map<string,int>"
MATCHES = (
    "id string, tournament_id string, tournament_api_id int, tournament_name string, date date, round string, surface string, tour string, p1_id long, p2_id long, winner_id long, score string, best_of int, "
    "stat_p1 map<string,string>, stat_p2 map<string,string>, fetched_at timestamp, raw string"
)
RANKINGS = "tour string, snapshot_date date, bio_id int, rank int, pts int, ytd_pts int"
FETCH_LOG = "id long, fetched_at timestamp, endpoint string, params string, http_status int, rows_returned int, rows_inserted int, ms_elapsed int, error string"

#: Stages from shallow to deep, and the depth of raw round names.
STAGES = ("R128", "R64", "R32", "R16", "QF", "SF", "F", "W")
ROUND_DEPTHS = {"First": 1, "Second": 2, "Third": 3, "Fourth": 4, "1/8": 4, "1/4": 5, "1/2": 6, "Final": 7}
#: Draw, round, stage played and stage reached by winning. The first round of a 96 draw has byes and leads nowhere new.
ROUNDS = (
    (128, "First", "R128", "R64"),
    (128, "Second", "R64", "R32"),
    (128, "Third", "R32", "R16"),
    (128, "Fourth", "R16", "QF"),
    (128, "1/8", "R16", "QF"),
    (128, "1/4", "QF", "SF"),
    (128, "1/2", "SF", "F"),
    (128, "Final", "F", "W"),
    (96, "First", "R64", "R64"),
    (96, "Second", "R64", "R32"),
    (96, "Third", "R32", "R16"),
    (96, "Fourth", "R16", "QF"),
    (96, "1/4", "QF", "SF"),
    (96, "1/2", "SF", "F"),
    (96, "Final", "F", "W"),
    (64, "First", "R64", "R32"),
    (64, "Second", "R32", "R16"),
    (64, "Third", "R16", "QF"),
    (64, "1/4", "QF", "SF"),
    (64, "1/2", "SF", "F"),
    (64, "Final", "F", "W"),
    (32, "First", "R32", "R16"),
    (32, "Second", "R16", "QF"),
    (32, "1/4", "QF", "SF"),
    (32, "1/2", "SF", "F"),
    (32, "Final", "F", "W"),
)
#: Event types that count as tour level.
TOUR_TIERS = ("GS", "M1000", "W1000", "M500", "W500", "M250", "W250", "ATPFinals", "WTAFinals")
#: Ranking points by type and stage.
POINTS = {
    "GS": {"W": 2000, "F": 1300, "SF": 800, "QF": 400, "R16": 200, "R32": 100, "R64": 50, "R128": 10},
    "M1000_128": {"W": 1000, "F": 650, "SF": 390, "QF": 215, "R16": 120, "R32": 65, "R64": 35, "R128": 10},
    "M1000_96": {"W": 1000, "F": 650, "SF": 390, "QF": 215, "R16": 120, "R32": 65, "R64": 10},
    "W1000": {"W": 1000, "F": 650, "SF": 390, "QF": 215, "R16": 120, "R32": 65, "R64": 10},
    "M500": {"W": 500, "F": 330, "SF": 200, "QF": 100, "R16": 50, "R32": 20, "R64": 5},
    "W500": {"W": 500, "F": 325, "SF": 195, "QF": 108, "R16": 60, "R32": 30, "R64": 5},
    "M250": {"W": 250, "F": 150, "SF": 90, "QF": 45, "R16": 20, "R32": 5},
    "W250": {"W": 250, "F": 165, "SF": 100, "QF": 55, "R16": 28, "R32": 14},
    "WTAFinals": {"W": 1500, "F": 1000, "SF": 500, "RR": 125},
    "ATPFinals": {"W": 1500, "F": 1000, "SF": 500, "RR": 200},
}
#: The points of the projection model; a type not listed counts as M1000.
MODEL_POINTS = {
    "GS": {"W": 2000, "F": 1300, "SF": 780, "QF": 430, "R16": 240, "R32": 130, "R64": 10},
    "M1000": {"W": 1000, "F": 650, "SF": 390, "QF": 215, "R16": 120, "R32": 65, "R64": 10},
    "W500": {"W": 500, "F": 325, "SF": 195, "QF": 108, "R16": 60, "R32": 30, "R64": 5},
    "W250": {"W": 250, "F": 163, "SF": 98, "QF": 54, "R16": 30, "R32": 17, "R64": 3},
}
#: Lowest and highest rank of a band and its chances in percent to end at each stage.
BANDS = (
    (-2147483648, 1, {"W": 35, "F": 25, "SF": 20, "QF": 12, "R16": 5, "R32": 2, "R64": 1}),
    (2, 2, {"W": 22, "F": 28, "SF": 25, "QF": 16, "R16": 6, "R32": 2, "R64": 1}),
    (3, 4, {"W": 14, "F": 22, "SF": 28, "QF": 22, "R16": 9, "R32": 3, "R64": 2}),
    (5, 8, {"W": 8, "F": 15, "SF": 25, "QF": 28, "R16": 14, "R32": 7, "R64": 3}),
    (9, 16, {"W": 4, "F": 9, "SF": 18, "QF": 27, "R16": 24, "R32": 13, "R64": 5}),
    (17, 32, {"W": 2, "F": 5, "SF": 10, "QF": 20, "R16": 28, "R32": 22, "R64": 13}),
    (33, 2147483647, {"W": 0, "F": 1, "SF": 3, "QF": 10, "R16": 22, "R32": 32, "R64": 32}),
)
MODEL_STAGES = ("W", "F", "SF", "QF", "R16", "R32", "R64")
#: Rolling periods in days.
WINDOWS = {"T12M": 365, "T6M": 180, "T3M": 90}
#: Court code -> surface, and country codes that also stand for another.
COURTS = {1: "H", 2: "H", 3: "C", 4: "C", 5: "G", 6: "C", 7: "C"}
COUNTRY_ALIASES = {"CRO": ("HRV",), "GBR": ("UK",), "USA": ("US",), "CHN": ("TPE",)}


def round_semantics(spark: SparkSession) -> DataFrame:
    """draw_bucket, round, played, next."""
    return spark.createDataFrame(list(ROUNDS), "draw_bucket int, round string, played string, next string")


def stage_depths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k) for k, s in enumerate(STAGES, 1)], "stage string, depth int")


def round_depths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROUND_DEPTHS.items()), "round string, depth int")


def points_long(spark: SparkSession, points: dict[str, dict[str, int]] = POINTS) -> DataFrame:
    return spark.createDataFrame([(t, s, p) for t, row in points.items() for s, p in row.items()], "points_type string, stage string, pts int")


def rank_bands(spark: SparkSession) -> DataFrame:
    """rank_lo, rank_hi, stage, prob_pct."""
    rows = [(low, high, stage, chance) for low, high, chances in BANDS for stage, chance in chances.items()]
    return spark.createDataFrame(rows, "rank_lo int, rank_hi int, stage string, prob_pct int")


def periods(spark: SparkSession, as_of: str) -> DataFrame:
    return spark.createDataFrame(list(WINDOWS.items()), "tag string, days int").selectExpr("tag", f"date_sub(date'{as_of}', days) as cutoff")
