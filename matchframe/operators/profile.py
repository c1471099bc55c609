"""Nine-metric profiles over years, rolling periods and surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..functions import columns as C
from .sides import sides, tracked

METRICS = ("match_win_pct", "serve_pts_won_pct", "return_pts_won_pct", "total_pts_won_pct", "aces_per_sv_gm", "bp_saved_pct", "tb_win_pct", "dec_set_win_pct")
COUNTERS = ("svpt", "serve_won", "aces", "bp_faced", "bp_saved", "opp_svpt", "opp_lost", "tb_played", "tb_won", "dec_played", "dec_won", "win")


def measured(matches: DataFrame, players: DataFrame) -> DataFrame:
    """Sides of tracked competitors with their counters, decoded once for all periods."""
    # each blob is decoded once, before the sides double the rows
    counters = lambda stats: F.when(F.col(stats).isNotNull(), F.struct(*(C.stat_int(F.col(stats), *names).alias(n) for n, names in C.STAT_ALIASES.items())))
    rows = tracked(sides(matches.withColumn("stat_p1", counters("stat_p1")).withColumn("stat_p2", counters("stat_p2"))), players)
    own, opp, both = F.col("own"), F.col("opp"), F.col("own").isNotNull() & F.col("opp").isNotNull()
    count = lambda stats, name: F.when(both, stats[name]).otherwise(0)
    rows = rows.withColumn("win", F.coalesce("won", F.lit(False))).withColumn("sets", C.sets_of(F.col("score")))
    rows = rows.withColumn("faced", count(own, "bp_faced")).withColumn("saved", count(own, "bp_saved"))
    attempts, converted = count(opp, "bp_attempts"), count(opp, "bp_converted")
    # break points that our blob lacks are those the opponent's blob has against our serve
    rows = rows.withColumn("bp_faced", F.when((F.col("faced") == 0) & (attempts != 0), attempts).otherwise(F.col("faced")))
    rows = rows.withColumn("bp_saved", F.when((F.col("saved") == 0) & (F.col("bp_faced") != 0), F.col("bp_faced") - converted).otherwise(F.col("saved")))
    far = C.went_the_distance(F.col("sets"), F.col("best_of"))
    return rows.select(
        "tour", "mid", "bio_id", "name", "date", "round", "surface", "event_type", C.completed(F.col("score")).alias("done"), "bp_faced", "bp_saved",
        count(own, "svpt").alias("svpt"), (count(own, "first_won") + count(own, "second_won")).alias("serve_won"), count(own, "aces").alias("aces"),
        count(opp, "opp_svpt").alias("opp_svpt"), (count(opp, "opp_svpt") - count(opp, "first_won") - count(opp, "second_won")).alias("opp_lost"),
        C.tiebreaks_played(F.col("sets")).alias("tb_played"), C.tiebreaks_won(F.col("sets"), F.col("win")).alias("tb_won"),
        far.cast("int").alias("dec_played"), (far & F.col("win")).cast("int").alias("dec_won"), F.col("win").cast("int").alias("win"),
    )


def at_tour_level(rows: DataFrame) -> DataFrame:
    return rows.where(C.tour_level(F.col("event_type")) & C.main_draw(F.col("round")))


def summed() -> list:
    """Aggregates over measured rows; only completed matches count, seen counts all."""
    return [F.count(F.lit(1)).alias("seen"), F.count_if("done").alias("matches"), *(F.sum(F.when(F.col("done"), F.col(c)).otherwise(0)).alias(c) for c in COUNTERS)]


def ratios(groups: DataFrame, keys: list[str], min_tb: int = 3, min_dec: int = 3) -> DataFrame:
    groups = groups.withColumn("sv_gms", F.round(F.col("svpt") / 6.5).cast("long"))
    return groups.select(
        *keys, "matches", C.ratio("win", "matches", 1).alias("match_win_pct"), C.ratio("serve_won", "svpt", 1).alias("serve_pts_won_pct"), C.ratio("opp_lost", "opp_svpt", 1).alias("return_pts_won_pct"),
        C.ratio("(serve_won + opp_lost)", "(svpt + opp_svpt)", 1).alias("total_pts_won_pct"), C.ratio("aces", "sv_gms", 2, percent=False).alias("aces_per_sv_gm"), C.ratio("bp_saved", "bp_faced", 1).alias("bp_saved_pct"),
        F.when(F.col("tb_played") >= min_tb, C.ratio("tb_won", "tb_played", 1)).alias("tb_win_pct"), F.when(F.col("dec_played") >= min_dec, C.ratio("dec_won", "dec_played", 1)).alias("dec_set_win_pct"),
    )


def profile(rows: DataFrame, keys: list[str], min_matches: int = 5, min_tb: int = 3, min_dec: int = 3) -> DataFrame:
    return ratios(rows.groupBy(*keys).agg(*summed()).where(F.col("matches") >= min_matches), keys, min_tb, min_dec)


def profile_by_year(rows: DataFrame, frozen: int | None = None, **limits: int) -> DataFrame:
    rows = at_tour_level(rows).withColumn("tag", F.year("date").cast("string"))
    return profile(rows if frozen is None else rows.where(F.year("date") != frozen), ["tour", "bio_id", "tag"], **limits)


def profile_rolling(rows: DataFrame, as_of: str, min_matches: int = 5) -> DataFrame:
    """Profiles of the rolling periods over all surfaces and each. A surface needs min_matches rows before and after the completed filter.

    The date filter stands before the rows are multiplied by the (three) periods.
    """
    day = F.lit(as_of).cast("date")
    recent = at_tour_level(rows).where((F.col("date") <= day) & (F.col("date") >= F.date_sub(day, max(schema.WINDOWS.values()))))
    tags = F.filter(F.array(*(F.when(F.col("date") >= F.date_sub(day, n), F.lit(t)) for t, n in schema.WINDOWS.items())), lambda t: t.isNotNull())
    tagged = recent.withColumn("tag", F.explode(tags)).withColumn("surf", C.or_hard(F.col("surface")))
    groups = tagged.groupingSets([["tour", "bio_id", "tag"], ["tour", "bio_id", "tag", "surf"]], "tour", "bio_id", "tag", "surf").agg(*summed())
    groups = groups.where((F.col("matches") >= min_matches) & (F.col("seen") >= min_matches)).withColumn("surf", F.coalesce("surf", F.lit("All")))
    return ratios(groups, ["tour", "bio_id", "tag", "surf"])


def profile_current(rows: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """What competitors do right now: any tier and round, lowest thresholds."""
    day = F.lit(as_of).cast("date")
    now = rows.where(F.col("date").between(F.date_sub(day, days), day)).withColumn("tag", F.lit("CURR"))
    return profile(now, ["tour", "bio_id", "tag"], 1, 1, 1)


def composite_z(metrics: DataFrame, over: list[str], cols: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean of the z-scores (population deviation) that a row has, within each group of `over`. Means are joined back, so a big group is no single task."""
    stats = metrics.groupBy(*over).agg(*(F.avg(c).alias(f"{c}_m") for c in cols), *(F.stddev_pop(c).alias(f"{c}_s") for c in cols))
    z = F.array(*(F.when(F.col(f"{c}_s") > 0, (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")) for c in cols))
    have = F.filter(z, lambda x: x.isNotNull())
    mean = F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(have), F.lit(0))
    return metrics.join(stats, over).withColumn("composite_z", mean).select(*metrics.columns, "composite_z")


def period_delta(metrics: DataFrame, new: str, old: str, keys: list[str], cols: tuple[str, ...] = METRICS) -> DataFrame:
    """Metrics of period new less those of period old, where a group has both."""
    before = metrics.where(F.col("tag") == old).select(*keys, *(F.col(c).alias(f"{c}_old") for c in cols))
    return metrics.where(F.col("tag") == new).join(before, keys).select(*keys, *(F.round(F.col(c) - F.col(f"{c}_old"), 2).alias(f"{c}_delta") for c in cols))


def filter_metrics(metrics: DataFrame, tour: str | None = None, tag: str | None = None, surface: str | None = None, min_matches: int = 0) -> DataFrame:
    for name, value in (("tour", tour), ("tag", tag), ("surf", surface)):
        if value is not None:
            metrics = metrics.where(F.col(name) == value)
    return metrics.where(F.col("matches") >= min_matches)


def period_index(metrics: DataFrame) -> DataFrame:
    """tag, place: calendar years from new to old, then the others by name."""
    year = F.col("tag").try_cast("int")
    tags = metrics.select("tag").distinct()
    order = Window.orderBy(F.when(year.isNotNull(), -year).otherwise(F.lit(1)), "tag")  # a few tags
    return tags.withColumn("place", F.row_number().over(order))


def registry(metrics: DataFrame) -> DataFrame:
    """Competitors of metric rows, the first row of each id by period."""
    order = Window.partitionBy("tour", "mid").orderBy("tag")
    return metrics.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
