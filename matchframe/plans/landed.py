"""Registered queries of what is landed and what is exported: catalogs, ranking payloads, winner/loser files, snapshots, nested exports."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from .. import schema
from ..fixtures import table
from ..functions import columns as C
from ..operators import catalog, profile, project, quality, sides
from ..sinks import publish
from ..sources import payloads
from .core import FORM, PTS, _plain, _players, history_form, query
from .more import LIVE, _live_rows, shared_folder


@query("SELECT mid, tour, bio_id, name, substr(name, 1, 3) AS ab, country, age, surf_h AS surf, inj FROM fx_players WHERE age <> 18")
def catalog_players(spark, d):
    """The player catalog under the field names of the feed; players aged 18 have no provider id there."""
    raw = _players(spark, d).select(
        F.when(F.col("age") != 18, F.col("mid")).alias("mid"), F.upper("tour").alias("tour"), F.col("bio_id").cast("string").alias("id"), F.lit(None).cast("string").alias("sid"), "name", F.substring("name", 1, 3).alias("ab"),
        F.col("country").alias("nat"), F.col("age").cast("string").alias("age"), F.col("surf_h").alias("surf"), F.lit("WL").alias("form"), F.when(F.col("inj"), True).alias("inj"),
    )
    return payloads.load_players(raw).select("mid", "tour", "bio_id", "name", "ab", "country", "age", "meta.surf", "meta.inj")


@query("WITH " + PTS + """, ev AS (SELECT *, CASE WHEN type = 'M1000' THEN CASE WHEN draw_size = 128 THEN 'M1000_128' ELSE 'M1000_96' END ELSE type END AS points_type FROM fx_events)
SELECT id, tour, type, draw_size, active, api_id_atp, api_id_wta, w.pts AS w_pts, f.pts AS f_pts FROM ev LEFT JOIN ptab w ON w.points_type = ev.points_type AND w.stage = 'W' LEFT JOIN ptab f ON f.points_type = ev.points_type AND f.stage = 'F'""")
def catalog_events(spark, d):
    """The event catalog under the field names of the feed, with the points of the winner and the finalist."""
    raw = table(spark, d, "fx_events").select(
        "id", "name", F.col("name").alias("short"), F.upper("tour").alias("tour"), "type", F.lit("H").alias("surf"), F.col("draw_size").cast("string").alias("draw"), F.lit("soon").alias("startDate"), F.lit("2001-07-01").alias("endDate"),
        F.struct(F.col("api_id_atp").alias("atp"), F.col("api_id_wta").alias("wta")).alias("apiId"), F.when(F.col("active"), True).alias("active"),
    )
    rows = payloads.load_events(raw, schema.points_long(spark))
    return rows.select("id", "tour", "type", "draw_size", "active", "api_id_atp", "api_id_wta", F.col("points_table")["W"].alias("w_pts"), F.col("points_table")["F"].alias("f_pts"))


@query("SELECT tour AS points_type, CAST(snapshot_date AS VARCHAR) AS stage, pts FROM fx_rankings")
def points_from_texts(spark, d):
    """Nested point tables as JSON, one text a competitor, read back as rows."""
    row = F.map_from_entries(F.collect_list(F.struct(F.col("snapshot_date").cast("string"), "pts")))
    texts = table(spark, d, "fx_rankings").groupBy("tour", "bio_id").agg(row.alias("row"))
    return payloads.points_from_json(texts.select(F.to_json(F.create_map("tour", "row")).alias("value")))


@query("""SELECT tour, snapshot_date, rank, pts AS points, CASE WHEN rank % 2 = 0 THEN ytd_pts ELSE pts END AS race_points, CAST(100000 + bio_id AS BIGINT) AS player_id,
  'P' || CAST(bio_id AS VARCHAR) AS player_name, CASE WHEN rank % 2 = 0 THEN 'XX' END AS country FROM fx_rankings""")
def ingest_rankings(spark, d):
    """Ranking payload pages of 500 rows of both shapes, read back by the ingest path."""
    r = table(spark, d, "fx_rankings")
    number, name = F.lit(100000) + F.col("bio_id"), F.concat(F.lit("P"), F.col("bio_id").cast("string"))
    player = F.struct(number.alias("id"), name.alias("name"), F.lit("XX").alias("countryAcr")).alias("player")
    one = F.to_json(F.struct(F.col("rank").alias("position"), F.col("pts").alias("point"), F.col("ytd_pts").alias("racePoints"), player))
    two = F.to_json(F.struct(F.col("rank").alias("currentRank"), F.col("pts").alias("points"), number.alias("playerId"), name.alias("playerName")))
    items = r.select("tour", "snapshot_date", F.floor(F.col("rank") / 500).alias("page"), F.when(F.col("rank") % 2 == 0, one).otherwise(two).alias("item"))
    joined = F.concat(F.lit('{"data":['), F.array_join(F.collect_list("item"), ","), F.lit("]}"))
    pages = items.groupBy("tour", "snapshot_date", "page").agg(joined.alias("value")).drop("page")
    return payloads.to_rankings(payloads.payload_items(pages), "tour", "snapshot_date")


@query("""SELECT 'wl-' || CAST(date AS VARCHAR) || '-' || CAST(winner_id AS VARCHAR) || '-' || CAST(CASE WHEN winner_id = p1_id THEN p2_id ELSE p1_id END AS VARCHAR) AS id, tour, date, tournament_name, round, surface,
  winner_id AS p1_id, CASE WHEN winner_id = p1_id THEN p2_id ELSE p1_id END AS p2_id, winner_id, score, best_of, coalesce(CAST(best_of AS VARCHAR), '') AS aces, 'l' AS lost_aces FROM fx_matches WHERE winner_id IS NOT NULL""")
def ingest_history(spark, d):
    """Decided matches as winner/loser rows of both tours, half of them with dates without hyphens."""
    m = _plain(spark, d).where("winner_id is not null")
    loser = F.when(F.col("winner_id") == F.col("p1_id"), F.col("p2_id")).otherwise(F.col("p1_id"))
    day = F.when(F.col("p1_id") < F.col("p2_id"), F.date_format("date", "yyyyMMdd")).otherwise(F.col("date").cast("string"))
    counters = [(F.col("best_of").cast("string") if s == "w" else F.lit("l")).alias(f"{s}_{c}") for s in "wl" for c in payloads.WL]
    raw = m.select("tour", day.alias("date"), F.col("tournament_name").alias("tourney_name"), F.lower("surface").alias("surface"), "round", "winner_id", loser.alias("loser_id"), "score", "best_of", *counters)
    rows = payloads.wl_to_matches(raw.where("tour = 'atp'"), "atp").unionByName(payloads.wl_to_matches(raw.where("tour = 'wta'"), "wta"))
    return rows.withColumn("aces", F.col("stat_p1")["aces"]).withColumn("lost_aces", F.col("stat_p2")["aces"]).drop("stat_p1", "stat_p2")


@query("SELECT * FROM fx_rankings")
def snapshot_round_trip(spark, d):
    """The rankings written as a snapshot, parted by tour, and restored."""
    path = f"{shared_folder(spark)}/snapshot-{uuid4().hex}"
    publish.write_snapshot({"rankings": table(spark, d, "fx_rankings")}, path, {"rankings": ["tour"]})
    return payloads.read_snapshot(spark, path, ["rankings"])["rankings"]


@query("""SELECT tour, bio_id, '[' || string_agg('{"snapshot_date":"' || CAST(snapshot_date AS VARCHAR) || '","rank":' || CAST(rank AS VARCHAR) || ',"pts":' || CAST(pts AS VARCHAR) || ',"ytd_pts":' || CAST(ytd_pts AS VARCHAR) || '}', ',' ORDER BY snapshot_date) || ']' AS items,
  count(*) AS n_items FROM fx_rankings GROUP BY tour, bio_id""")
def publish_ranks(spark, d):
    """A row per competitor: the ranking history as JSON."""
    return publish.export_nested(table(spark, d, "fx_rankings"), ["tour", "bio_id"], ["snapshot_date"])


@query("SELECT tour, bio_id, mid, name FROM fx_players WHERE bio_id <= 50")
def players_top(spark, d):
    return sides.top_n(_players(spark, d), 50).select("tour", "bio_id", "mid", "name")


@query("WITH " + FORM + " SELECT tour, bio_id, len(right(form, 5)) AS n, len(replace(right(form, 5), 'L', '')) AS wins FROM fo")
def history_form_recent(spark, d):
    """Of the last five results: how many there are and how many were won."""
    last = C.form_recent(F.col("form"), 5)
    return history_form(spark, d).select("tour", "bio_id", F.size(last).cast("long").alias("n"), F.aggregate(last, F.lit(0), lambda a, x: a + x).cast("long").alias("wins"))


@query("SELECT tour, mid, CAST(year(first) AS VARCHAR) AS tag FROM (SELECT tour, 100000 + bio_id AS mid, min(snapshot_date) AS first FROM fx_rankings GROUP BY 1, 2) t")
def profile_registry(spark, d):
    """Every ranked competitor once, with the first period there is of them."""
    rows = table(spark, d, "fx_rankings").select("tour", (F.lit(100000) + F.col("bio_id")).alias("mid"), F.year("snapshot_date").cast("string").alias("tag"))
    return profile.registry(rows.distinct())


@query("WITH " + LIVE + " SELECT id, tour, CAST(row_number() OVER (ORDER BY floor(p / 1000.0 - defending + 0.5) DESC, id) AS INTEGER) AS place FROM pj QUALIFY place <= 50")
def project_live_sorted(spark, d):
    """The 50 with most to gain, in the order of the table."""
    best = project.live_sorted(project.live_table(_live_rows(spark, d)), "net").limit(50)
    rows = best.agg(F.collect_list(F.struct("id", "tour")).alias("rows"))  # 50 rows
    return rows.select(F.posexplode("rows").alias("k", "row")).select("row.id", "row.tour", (F.col("k") + 1).alias("place"))


@query("WITH al AS (SELECT tour, tournament_api_id AS api_id, min(date) AS start_date, count(*) AS n FROM fx_matches GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY start_date, api_id, tour) AS place FROM al WHERE NOT EXISTS (SELECT 1 FROM fx_events e WHERE CASE WHEN al.tour = 'atp' THEN e.api_id_atp ELSE e.api_id_wta END = api_id)")
def catalog_new(spark, d):
    """Events of matches that no catalog row has, in the order of the catalog."""
    seen = _plain(spark, d).groupBy("tour", F.col("tournament_api_id").alias("api_id")).agg(F.min("date").alias("start_date"), F.count(F.lit(1)).alias("n"))
    lost = catalog.exclude_known(seen, table(spark, d, "fx_events"))
    return catalog.catalog_places(lost.withColumn("id", F.struct("api_id", "tour"))).select("tour", "api_id", "start_date", "n", "place")


@query("SELECT 'players' AS table_name, count(*) AS rows FROM fx_players UNION ALL SELECT 'events', count(*) FROM fx_events UNION ALL SELECT 'matches', count(*) FROM fx_matches UNION ALL SELECT 'rankings', count(*) FROM fx_rankings UNION ALL SELECT 'log', count(*) FROM fx_log")
def quality_tables(spark, d):
    return quality.table_status({"players": _players(spark, d), "events": table(spark, d, "fx_events"), "matches": _plain(spark, d), "rankings": table(spark, d, "fx_rankings"), "log": table(spark, d, "fx_log")})
