"""Audit of events that the catalog lacks, and rows that would fill it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import iso_week, slug
from .sides import event_keys, unresolved


def audit_unresolved(matches: DataFrame, events: DataFrame, min_count: int = 1) -> DataFrame:
    """A row for each (tour, provider id) without a catalog entry."""
    rows = unresolved(matches, events).groupBy("tour", "tournament_api_id").agg(
        F.max("tournament_name").alias("name"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"),
        F.max("surface").alias("surface"), F.count_distinct("surface").alias("n_surfaces"), F.count_distinct("date").alias("n_dates"),
    )
    return rows.where(F.col("n") >= min_count)


def band_of(n: Column) -> Column:
    return F.when(n >= 120, "120+").when(n >= 60, "60-119").when(n >= 25, "25-59").when(n >= 10, "10-24").otherwise("1-9")


def band_events(audit: DataFrame) -> DataFrame:
    return audit.groupBy(band_of(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("events"), F.sum("n").alias("matches"))


def suggest_catalog(audit: DataFrame, as_of: str, active_days: int = 7) -> DataFrame:
    """Catalog rows proposed for unresolved events."""
    active = F.col("last_date") >= F.date_sub(F.lit(as_of).cast("date"), active_days)
    return audit.select(slug(F.col("name"), F.year("first_date")).alias("id"), "tour", "tournament_api_id", "name", iso_week(F.col("first_date")).alias("week"), F.month("first_date").alias("month"), "first_date", "last_date", active.alias("active"), (~active).alias("complete"))


def _grams(text: Column) -> Column:
    """The different runs of one, two and three characters of a text, and the empty one."""
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(0), F.length(text) - n), lambda i: F.substring(text, i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), runs(1), runs(2), runs(3)))


def classify_events(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """names (name, tour) with the first pattern (ordinal, substring, atp_tier, wta_tier, …) that its name contains, in any case, and that has a tier for its tour.

    An inverted index: each pattern stands under the rarest of its longest runs of characters (three at most), names
    meet it there, and contains() decides. So both lists may be long.
    """
    tier = F.when(F.col("tour") == "atp", F.col("atp_tier")).otherwise(F.col("wta_tier"))
    asked = names.select("name").distinct().select("name", F.lower("name").alias("low")).select("name", "low", F.explode(_grams(F.col("low"))).alias("gram"))
    often = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    wanted = patterns.withColumn("sought", F.lower("substring"))
    long = F.least(F.length("sought"), F.lit(3))
    under = wanted.select("ordinal", "substring", "sought", F.explode(F.filter(_grams(F.col("sought")), lambda g: F.length(g) == long)).alias("gram")).join(often, "gram")
    index = under.groupBy("ordinal", "substring", "sought").agg(F.min_by("gram", F.struct("held", "gram")).alias("gram"))
    met = asked.join(index, "gram").where(F.contains("low", "sought")).select("name", "ordinal", "substring")
    rows = names.select("name", "tour").distinct().join(met, "name").join(patterns, ["ordinal", "substring"]).where(tier.isNotNull())
    best = rows.groupBy("name", "tour").agg(F.min_by(F.struct(tier.alias("tier"), F.col("slug").alias("event_slug"), "substring"), "ordinal").alias("p"))
    return names.join(best, ["name", "tour"], "left").select(*names.columns, "p.tier", "p.event_slug", F.col("p.substring").alias("pattern"))


def generate_catalog(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Catalog rows from candidates (slug, year, tour, tier, api_id, first_date, last_date, n), known provider ids (tour, api_id) left out.

    Candidates of one slug, year and tier class (W tiers count as M) that both tours have become one row for both;
    others one row per tour, with the tour's letter added where the slug splits.
    """
    fresh = candidates.join(known, ["tour", "api_id"], "left_anti").withColumn("tier_class", F.regexp_replace("tier", "^W(?=[0-9])", "M"))
    classes = fresh.groupBy("slug", "year", "tier_class").agg(F.count_distinct("tour").alias("tours"))
    splits = classes.groupBy("slug", "year").agg(F.count(F.lit(1)).alias("n_classes"))
    shaped = fresh.join(classes, ["slug", "year", "tier_class"]).join(splits, ["slug", "year"])
    both = F.col("tours") > 1
    owner = F.when(both, "both").otherwise(F.col("tour"))
    suffix = F.when(~both & (F.col("n_classes") > 1), F.concat(F.lit("_"), F.substring("tour", 1, 1))).otherwise("")
    api = lambda t: F.min(F.when(F.col("tour") == t, F.col("api_id"))).alias(f"api_id_{t}")
    out = shaped.groupBy("slug", "year", "tier_class", owner.alias("owner"), suffix.alias("suffix")).agg(
        F.min("first_date").alias("start_date"), F.max("last_date").alias("end_date"), F.sum("n").alias("n"), F.min("tier").alias("tier"), api("atp"), api("wta"),
    )
    kind = F.when(F.col("owner") == "both", F.col("tier_class")).otherwise(F.col("tier"))
    return out.select(F.concat("slug", F.lpad((F.col("year") % 100).cast("string"), 2, "0"), "suffix").alias("id"), F.col("owner").alias("tour"), kind.alias("type"), "start_date", "end_date", "n", "api_id_atp", "api_id_wta")


def exclude_known(df: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (tour, api_id, …) whose provider id no catalog row has."""
    return df.join(event_keys(events).select(F.col("key_tour").alias("tour"), "api_id"), ["tour", "api_id"], "left_anti")


def ordered_catalog(df: DataFrame) -> DataFrame:
    return df.orderBy("start_date", "id")


def catalog_places(df: DataFrame) -> DataFrame:
    """df with place, from 1 in the order of the catalog: rows of a day are counted first, so that only days are put in one order."""
    days = df.groupBy("start_date").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(F.asc_nulls_first("start_date")).rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(F.col("start_date").alias("_day"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("start_date").orderBy("id"))
    return df.withColumn("_within", within).join(before, F.col("start_date").eqNullSafe(F.col("_day"))).select(*df.columns, (F.col("_before") + F.col("_within")).alias("place"))
