"""Checks before publishing, refresh decisions and the fetch log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _check(name: str, hard: bool, df: DataFrame, value: Column, ok: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), F.lit(hard).alias("hard"), value.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))


def check_counts(tables: dict[str, DataFrame], minimums: dict[str, int]) -> DataFrame:
    parts = [_check(f"count_{t}", True, tables[t].agg(F.count(F.lit(1)).alias("n")), F.col("n"), F.col("n") >= least) for t, least in minimums.items()]
    return reduce(DataFrame.unionByName, parts)


def check_recency(df: DataFrame, day: str, as_of: str, most: int, name: str, hard: bool) -> DataFrame:
    """Age of the newest row in days; no row at all is a hard failure."""
    age = df.where(F.col(day) <= F.lit(as_of).cast("date")).agg(F.datediff(F.lit(as_of).cast("date"), F.max(day)).alias("age"))
    out = _check(name, hard, age, F.col("age"), F.col("age") <= most)
    return out.withColumn("hard", F.col("hard") | F.col("value").isNull())


def check_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    return _check(name, True, twice, F.col("n"), F.col("n") == 0)


def check_coverage(df: DataFrame, column: str, least_pct: int, name: str) -> DataFrame:
    share = df.agg((100 * F.count(column)).alias("have"), F.count(F.lit(1)).alias("n"))
    return _check(name, False, share, F.col("have") / F.col("n"), F.col("have") >= least_pct * F.col("n"))


def check_active(coverage: DataFrame) -> DataFrame:
    return _check("active_events", False, coverage.agg(F.count_if(F.col("n_matches") == 0).alias("n")), F.col("n"), F.col("n") == 0)


def check_domain(df: DataFrame, column: str, allowed: list[str], nullable: bool, name: str) -> DataFrame:
    bad = F.when(F.col(column).isNull(), F.lit(not nullable)).otherwise(~F.col(column).isin(*allowed))
    return _check(name, True, df.agg(F.count_if(bad).alias("n")), F.col("n"), F.col("n") == 0)


def verdict(checks: DataFrame, strict: bool = False) -> DataFrame:
    """One row: failures and warnings, and whether the data may be published."""
    counts = checks.agg(F.count_if(F.col("hard") & ~F.col("ok")).alias("failures"), F.count_if(~F.col("hard") & ~F.col("ok")).alias("warnings"))
    return counts.withColumn("passed", (F.col("failures") == 0) & (F.lit(not strict) | (F.col("warnings") == 0)))


def freshness(matches: DataFrame, events: DataFrame, as_of: str, most: int = 9) -> DataFrame:
    """Events (id, start_date, end_date) under way at as_of with the age of their newest match, and alarm beyond `most` days."""
    day = F.lit(as_of).cast("date")
    newest = matches.where(F.col("date") <= day).groupBy("tournament_id").agg(F.max("date").alias("newest"))
    live = events.where((F.col("start_date") <= day) & (F.col("end_date") >= day)).join(newest, F.col("id") == F.col("tournament_id"), "left")
    age = F.datediff(day, F.col("newest"))
    return live.select("id", age.alias("age"), (F.coalesce(age, F.lit(most + 1)) > most).alias("alarm"))


def deviation(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance_pct: float = 2.0) -> DataFrame:
    """Keys on which two sources differ by more than the tolerance, or that one of them lacks."""
    joined = a.select(*keys, F.col(value).alias("a_value")).join(b.select(*keys, F.col(value).alias("b_value")), keys, "full_outer")
    far = F.abs(F.col("a_value") - F.col("b_value")) * 100 > tolerance_pct * F.abs(F.col("a_value"))
    return joined.where(F.coalesce(far, F.lit(True)) & ~(F.col("a_value").isNull() & F.col("b_value").isNull()))


def table_status(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t, df in tables.items()])


def refresh_plan(players: DataFrame, sides: DataFrame, as_of: str) -> DataFrame:
    """tour, bio_id, reason: cold_start, active (a match of the last 14 days at an active event), stale or skip. sides has tour, mid, date, active."""
    day = F.lit(as_of).cast("date")
    seen = sides.where(F.col("date") <= day).groupBy("tour", "mid").agg(F.max("date").alias("latest"), F.bool_or(F.coalesce("active", F.lit(False)) & (F.col("date") >= F.date_sub(day, 14))).alias("in_play"))
    reason = F.when(F.col("latest").isNull(), "cold_start").when(F.col("in_play"), "active").when(F.col("latest") < F.date_sub(day, 1), "stale").otherwise("skip")
    return players.join(seen, ["tour", "mid"], "left").select("tour", "bio_id", reason.alias("reason"))


def fetch_budget(log: DataFrame, monthly: int = 10_000) -> DataFrame:
    """Calls, errors, rows and latency per endpoint and month, with the share of the monthly budget in use."""
    month = F.date_trunc("month", "fetched_at").cast("date")
    grouped = log.groupBy("endpoint", month.alias("month")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("http_status") >= 400).alias("errors"), F.sum("rows_returned").alias("rows"), F.max("ms_elapsed").alias("max_ms"), F.max("fetched_at").alias("newest"),
    )
    return grouped.withColumn("budget_pct", F.round(100 * F.col("calls") / monthly, 4))


def log_batches(batches: DataFrame) -> DataFrame:
    """batches (batch, page, inserted, …): the first page of a fetch gets the credit for what was inserted, the others 0."""
    order = Window.partitionBy("batch").orderBy("page")
    return batches.withColumn("rows_inserted", F.when(F.row_number().over(order) == 1, F.col("inserted")).otherwise(0)).drop("inserted")
