"""Ranking lists and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import rescaled_points


def merge_rankings(t12m: DataFrame, race: DataFrame) -> DataFrame:
    """tour, bio_id, rank, pts (rescaled), ytd_pts from the twelve-month and the race list; either may lack a competitor."""
    long_ = t12m.select("tour", "bio_id", "rank", rescaled_points(F.col("tour"), F.col("points")).alias("pts"))
    return long_.join(race.select("tour", "bio_id", F.col("race_points").alias("ytd_pts")), ["tour", "bio_id"], "full_outer")


def rank_asof(moments: DataFrame, rankings: DataFrame) -> DataFrame:
    """moments (tour, bio_id, at, …) with the competitor's rank and points in the newest snapshot on or before that date.

    Both sides meet in one sorted window per competitor; no pair of moment and snapshot is built.
    """
    extra = [c for c in moments.columns if c not in ("tour", "bio_id", "at")]
    left = moments.select("tour", "bio_id", "at", F.lit(1).alias("_side"), F.lit(None).cast("struct<rank:int,pts:int,snapshot_date:date>").alias("_r"), *extra)
    kinds = dict(moments.dtypes)
    right = rankings.select("tour", "bio_id", F.col("snapshot_date").alias("at"), F.lit(0).alias("_side"), F.struct("rank", "pts", "snapshot_date").alias("_r"), *(F.lit(None).cast(kinds[c]).alias(c) for c in extra))
    upto = Window.partitionBy("tour", "bio_id").orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = left.unionByName(right).withColumn("_r", F.last("_r", ignorenulls=True).over(upto)).where("_side = 1")
    return seen.select(*moments.columns, "_r.rank", "_r.pts", "_r.snapshot_date")


def movers(season: DataFrame, k: int = 10) -> DataFrame:
    """The k largest moves of each tour. Ranks are limited per task before they meet."""
    order = Window.partitionBy("tour").orderBy(F.desc(F.abs("rank_move")), "bio_id")
    return season.where("rank_move <> 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("tour", "place", "bio_id", "rank", "rank_move")


def rank_trend(rankings: DataFrame) -> DataFrame:
    """Rank and points of each snapshot with the changes from the competitor's previous one."""
    order = Window.partitionBy("tour", "bio_id").orderBy("snapshot_date")
    return rankings.withColumn("rank_change", F.lag("rank").over(order) - F.col("rank")).withColumn("pts_change", F.col("pts") - F.lag("pts").over(order))
