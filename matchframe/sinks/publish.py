"""Publishing: change detection, snapshots, summaries and nested exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, ignore: tuple[str, ...] = ("fetched_at", "generated_at")) -> DataFrame:
    """rows, total and mix: one row that is the same for the same rows in any order; timestamps of the run are left out."""
    cols = sorted(c for c in df.columns if c not in ignore)
    hashed = df.select(F.xxhash64(*(F.to_json(F.struct(c)) for c in cols)).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mix"))


def publish_if_changed(df: DataFrame, path: str, manifest: str, name: str) -> bool:
    """Writes df unless the manifest's newest entry for name has its fingerprint. Whether it was written."""
    spark = df.sparkSession
    now = fingerprint(df).first()
    row = spark.createDataFrame([(name, now["rows"], now["total"], now["mix"])], "name string, rows long, total string, mix long")
    there = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        known = spark.read.schema("name string, rows long, total string, mix long, at timestamp").parquet(manifest).where(F.col("name") == name)
        last = known.orderBy(F.desc("at")).first()
        if last and (last["rows"], last["total"], last["mix"]) == (now["rows"], now["total"], now["mix"]):
            return False
    df.write.mode("overwrite").parquet(path)
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(manifest)
    return True


def partition_fingerprints(df: DataFrame, keys: list[str], ignore: tuple[str, ...] = ("fetched_at", "generated_at")) -> DataFrame:
    """keys, rows, total, mix: the fingerprint of each partition."""
    cols = sorted(c for c in df.columns if c not in ignore and c not in keys)
    hashed = df.select(*keys, F.xxhash64(*(F.to_json(F.struct(c)) for c in cols)).alias("h"))
    return hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor("h").alias("mix"))


def _newest(spark: SparkSession, manifest: str, keys: list[str], kinds: str) -> DataFrame:
    """The manifest's newest entry of each partition that is there."""
    known = spark.read.schema(f"{kinds}, rows long, total string, mix long, version long").option("ignoreMissingFiles", "true").parquet(manifest)
    return known.groupBy(*keys).agg(F.max_by(F.struct("rows", "total", "mix"), "version").alias("was"), F.max("version").alias("version")).where("was.rows > 0")


def publish_changed(df: DataFrame, path: str, manifest: str, keys: list[str]) -> DataFrame:
    """Writes the partitions of df that are new or changed since the manifest's entries, and no others; keys and state (new, changed, same, gone).

    The entries come after the data: a run that is lost in between writes the same partitions again. A partition
    that has gone gets an entry without rows, and readers leave its files out.
    """
    spark = df.sparkSession
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    entry = [*keys, "rows", "total", "mix"]
    if not _exists(spark, manifest):
        spark.createDataFrame([], f"{kinds}, rows long, total string, mix long, version long").write.parquet(manifest)
    known = _newest(spark, manifest, keys, kinds)
    last = known.agg(F.max("version")).first()[0] or 0
    both = partition_fingerprints(df, keys).withColumn("now", F.struct("rows", "total", "mix")).select(*keys, "now").join(known.drop("version"), keys, "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("was"), "same").otherwise("changed")
    # one row a partition, kept beside the manifest, as the manifest is about to change
    both.select(*keys, "now", state.alias("state")).write.mode("overwrite").parquet(f"{manifest}-states/{last + 1}")
    states = spark.read.parquet(f"{manifest}-states/{last + 1}").select(*(F.col(k).cast(df.schema[k].dataType) for k in keys), "now", "state")
    due = states.where("state in ('new', 'changed')").select(*keys)
    df.join(due, keys, "left_semi").repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    gone = F.when(F.col("now").isNull(), F.struct(F.lit(0).cast("long").alias("rows"), F.lit("0").alias("total"), F.lit(0).cast("long").alias("mix"))).otherwise(F.col("now"))
    states.where("state <> 'same'").select(*keys, gone.alias("now")).select(*keys, "now.*").select(*entry, F.lit(last + 1).cast("long").alias("version")).write.mode("append").parquet(manifest)
    return states.select(*keys, "state")


def published(spark: SparkSession, path: str, manifest: str, keys: list[str]) -> DataFrame:
    """The published rows: those of partitions that the manifest has."""
    rows = spark.read.parquet(path)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.join(_newest(spark, manifest, keys, kinds).select(*keys), keys, "left_semi")


def append_batches(rows: DataFrame, path: str, batch: str) -> None:
    """Appends rows whose batch is not there yet. A batch is one folder, written whole, so a batch that comes again, or again after a lost run, stands there once."""
    spark = rows.sparkSession
    if _exists(spark, path):
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        there = spark.read.schema(kinds).parquet(path).select(batch).distinct()
        rows = rows.join(there, batch, "left_anti")
    rows.repartition(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def write_snapshot(tables: dict[str, DataFrame], path: str, partition: dict[str, list[str]] | None = None) -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition and name in partition:
            writer = writer.partitionBy(*partition[name])
        writer.parquet(f"{path}/{name}")


def snapshot_summary(tables: dict[str, DataFrame], rankings: DataFrame, coverage: DataFrame, matches: DataFrame) -> DataFrame:
    """section, key, value: row counts, newest ranking snapshot, active events, the five newest matches."""
    line = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    out = line(rankings.agg(F.max("snapshot_date").alias("d")), "newest_ranking", F.lit("snapshot_date"), F.col("d"))
    for name, df in tables.items():
        out = out.unionByName(line(df.agg(F.count(F.lit(1)).alias("n")), "rows", F.lit(name), F.col("n")))
    out = out.unionByName(line(coverage, "active_event", F.col("id"), F.concat_ws(" ", F.col("n_matches").cast("string"), F.coalesce(F.col("last_date").cast("string"), F.lit("-")))))
    return out.unionByName(line(newest(matches, 5), "newest_match", F.col("id"), F.col("date")))


def newest(matches: DataFrame, n: int = 5) -> DataFrame:
    return matches.orderBy(F.desc("date"), F.desc("round"), F.desc("id")).limit(n)


def export_nested(df: DataFrame, keys: list[str], order: list[str], limit_col: str | None = None) -> DataFrame:
    """keys and items, the JSON text of each group's rows sorted by `order`. Groups are those of a key of the report, ranked to a bounded size before."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    items = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    return df.groupBy(*keys).agg(F.to_json(items).alias("items"), F.count(F.lit(1)).alias("n_items"))


def export_active(status: DataFrame) -> DataFrame:
    """tour, n_events, n_players, active: the active events of each tour as JSON, in order, each with its stage and its players (id, stage, eliminated) in order.

    status: tour, event_id, event_stage, bio_id, stage, eliminated. Players of an event are those of its draw, and active events those of a week.
    """
    players = F.array_sort(F.collect_list(F.struct("bio_id", "stage", "eliminated")))
    events = status.groupBy("tour", "event_id", "event_stage").agg(players.alias("players"), F.count(F.lit(1)).alias("n"))
    active = F.array_sort(F.collect_list(F.struct("event_id", "event_stage", "players")))
    return events.groupBy("tour").agg(F.count(F.lit(1)).alias("n_events"), F.sum("n").alias("n_players"), F.to_json(active).alias("active"))


def export_season(season: DataFrame, results: DataFrame) -> DataFrame:
    """A row per player with a map of event to stage as JSON, in order of event."""
    stages = results.groupBy("tour", "bio_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_id", "stage"))))).alias("results"))
    return season.join(stages, ["tour", "bio_id"], "left").select("tour", "bio_id", "rank", "pts", "ytd", "rank_move", F.coalesce("results", F.lit("{}")).alias("results"))
