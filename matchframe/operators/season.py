"""Season results, live status and the season table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from .sides import sides, tracked, with_points, with_stage


def season_results(resolved: DataFrame, players: DataFrame) -> DataFrame:
    """tour, bio_id, event_id, stage, pts: the deepest stage at each finished event."""
    spark = resolved.sparkSession
    rows = with_stage(tracked(sides(resolved.where(~F.col("active"))), players), schema.round_semantics(spark))
    rows = rows.withColumn("stage", F.when(F.coalesce("won", F.lit(False)), F.col("next")).otherwise(F.col("played")))
    rows = rows.join(F.broadcast(schema.stage_depths(spark)), "stage")
    best = rows.groupBy("tour", "bio_id", F.col("tournament_id").alias("event_id")).agg(F.max_by("stage", "depth").alias("stage"), F.max("event_type").alias("event_type"), F.max("draw_size").alias("draw_size"))
    return with_points(best, schema.points_long(spark)).select("tour", "bio_id", "event_id", "stage", "pts")


def active_status(resolved: DataFrame, players: DataFrame, as_of: str) -> DataFrame:
    """tour, event_id, event_stage, bio_id, stage, eliminated, by the latest match of each competitor at each active event.

    Whoever is alive but behind the event's stage is out.
    """
    spark = resolved.sparkSession
    rows = tracked(sides(resolved.where(F.col("active") & (F.col("date") <= F.lit(as_of).cast("date")))), players)
    rows = rows.join(F.broadcast(schema.round_depths(spark)), "round", "left")
    latest = rows.groupBy("tour", "bio_id", "tournament_id").agg(F.max_by(F.struct("round", "won", "draw_size"), F.struct("date", F.coalesce("depth", F.lit(0)), "id")).alias("m"))
    staged = with_stage(latest.select("tour", "bio_id", F.col("tournament_id").alias("event_id"), "m.*"), schema.round_semantics(spark))
    alive = F.coalesce("won", F.lit(False))
    staged = staged.select("tour", "bio_id", "event_id", F.when(alive, F.col("next")).otherwise(F.col("played")).alias("stage"), (~alive).alias("out"))
    staged = staged.join(F.broadcast(schema.stage_depths(spark)), "stage")
    event = staged.groupBy("event_id").agg(F.max_by("stage", "depth").alias("event_stage"), F.max("depth").alias("event_depth"))
    return staged.join(event, "event_id").select("tour", "event_id", "event_stage", "bio_id", "stage", (F.col("out") | (F.col("depth") < F.col("event_depth"))).alias("eliminated"))


def latest_snapshot(rankings: DataFrame, as_of: str, days_before: int = 0) -> DataFrame:
    """The newest whole snapshot of each tour on or before as_of less some days. The join's other side has a row per tour."""
    upto = rankings.where(F.col("snapshot_date") <= F.date_sub(F.lit(as_of).cast("date"), days_before))
    newest = upto.groupBy("tour").agg(F.max("snapshot_date").alias("snapshot_date"))
    return rankings.join(F.broadcast(newest), ["tour", "snapshot_date"])


def season_table(players: DataFrame, rankings: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """tour, bio_id, rank (the own id without a ranking), pts, ytd, rank_move against a week before, n_results, result_pts."""
    now = latest_snapshot(rankings, as_of).select("tour", "bio_id", "rank", "pts", F.col("ytd_pts").alias("ytd"))
    before = latest_snapshot(rankings, as_of, 7).select("tour", "bio_id", F.col("rank").alias("old"))
    done = results.groupBy("tour", "bio_id").agg(F.count(F.lit(1)).alias("n_results"), F.sum("pts").alias("result_pts"))
    joined = players.select("tour", "bio_id").join(now, ["tour", "bio_id"], "left").join(before, ["tour", "bio_id"], "left").join(done, ["tour", "bio_id"], "left")
    return joined.select(
        "tour", "bio_id", F.coalesce("rank", "bio_id").alias("rank"), F.coalesce("pts", F.lit(0)).alias("pts"), F.coalesce("ytd", F.lit(0)).alias("ytd"),
        F.coalesce(F.col("old") - F.col("rank"), F.lit(0)).alias("rank_move"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("result_pts", F.lit(0)).alias("result_pts"),
    )


def freeze_results(results: DataFrame, resolved: DataFrame, players: DataFrame, flipped: DataFrame) -> DataFrame:
    """results with the final stages of events that have just finished (flipped: id) added or replaced."""
    closed = resolved.join(flipped.select(F.col("id").alias("tournament_id")), "tournament_id", "left_semi").withColumn("active", F.lit(False))
    fresh = season_results(closed, players)
    return results.join(fresh.select("tour", "bio_id", "event_id"), ["tour", "bio_id", "event_id"], "left_anti").unionByName(fresh)


def rolling_points(dated: DataFrame, as_of: str, days: int = 364) -> DataFrame:
    """Points of results (tour, bio_id, date, pts) inside the trailing days."""
    day = F.lit(as_of).cast("date")
    return dated.where(F.col("date").between(F.date_sub(day, days), day)).groupBy("tour", "bio_id").agg(F.sum("pts").alias("points"), F.count(F.lit(1)).alias("n_events"))


def rolling_points_series(dated: DataFrame, days: int = 364) -> DataFrame:
    """The same at the date of every result."""
    frame = Window.partitionBy("tour", "bio_id").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    return dated.withColumn("points", F.sum("pts").over(frame))
