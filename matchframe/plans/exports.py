"""Registered queries of landed files, appended logs, partition-wise publishing, nested season exports and folded names."""

from __future__ import annotations

import unicodedata
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import columns as C
from ..operators import link, merge, quality
from ..sinks import publish
from ..sources import payloads
from .core import ORACLE_SQL, _plain, _players, query, season_active_status
from .more import SPLIT, _checks, _split, match_pages, shared_folder, CHECKS

#: Bodies that are no list of items: an error, an object under data, a bare text, no JSON.
BROKEN = ('{"error":"quota"}', '{"data":{"id":1}}', '"later"', "<html>503</html>")


def _landed(spark: SparkSession, pages: DataFrame, keys: list[str], name: str) -> str:
    """A folder with one packed file for each page, under the folder names of its keys. A page is one row, so pages are written where they are."""
    out = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    pages.write.partitionBy(*keys).option("maxRecordsPerFile", 1).option("compression", "gzip").text(out)
    return out


def _broken(pages: DataFrame, keys: dict) -> DataFrame:
    """A page of each broken body; keys give the other columns. pages: any rows, of which one is made."""
    bodies = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(b).alias("value")) for k, b in enumerate(BROKEN))))
    one = pages.agg(F.count(F.lit(1)).alias("n")).select(bodies.alias("b")).select("b.value", "b.k")
    return one.select("value", *(value(F.col("k")).alias(name) for name, value in keys.items()))


@query("""SELECT id, tournament_api_id, date, round, surface, tour, p1_id, p2_id, winner_id, score, best_of, json_extract_string(stat_p1, '$.aces') AS aces FROM fx_matches""")
def ingest_match_files(spark, d):
    """Match pages as landed files, one a page, broken ones among them, read by the ingest path; the tour is a folder's name."""
    pages = match_pages(spark, d).select("tour", "value")
    pages = pages.unionByName(_broken(_players(spark, d), {"tour": lambda k: F.lit("atp")}))
    found = payloads.read_match_payloads(spark, _landed(spark, pages, ["tour"], "match-pages"))
    rows = payloads.to_matches(found, F.col("tour"))
    return rows.select("id", "tournament_api_id", "date", "round", "surface", "tour", "p1_id", "p2_id", "winner_id", "score", "best_of", F.col("stat_p1")["aces"].alias("aces"))


def _ranking_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of both lists of each snapshot, and the broken ones."""
    r = table(spark, d, "fx_rankings")
    player = F.struct((F.lit(100000) + F.col("bio_id")).alias("id"), F.concat(F.lit("P"), F.col("bio_id").cast("string")).alias("name")).alias("player")
    lists = [F.struct(F.lit(race).alias("race"), F.to_json(F.struct(F.col("rank").alias("position"), F.col(points).alias("point"), player)).alias("item")) for race, points in ((False, "pts"), (True, "ytd_pts"))]
    items = r.select("tour", F.year("snapshot_date").alias("year"), "snapshot_date", F.explode(F.array(*lists)).alias("x")).select("tour", "year", "snapshot_date", "x.*")
    joined = F.concat(F.lit('{"data":['), F.array_join(F.collect_list("item"), ","), F.lit("]}"))  # a snapshot's list is a page
    pages = items.groupBy("race", "tour", F.col("snapshot_date").cast("string").alias("day")).agg(joined.alias("value"))
    return pages.unionByName(_broken(pages, {"race": lambda k: k % 2 == 0, "tour": lambda k: F.when(k < 2, "atp").otherwise("wta"), "day": lambda k: F.lit("1990-01-01")}))


@query("""SELECT tour, snapshot_date, false AS race, rank, pts AS points, CAST(100000 + bio_id AS BIGINT) AS player_id FROM fx_rankings
UNION ALL SELECT tour, snapshot_date, true, rank, ytd_pts, CAST(100000 + bio_id AS BIGINT) FROM fx_rankings""")
def ingest_ranking_files(spark, d):
    """Ranking pages of both lists as landed files; list, tour and day are folder names."""
    found = payloads.read_ranking_payloads(spark, _landed(spark, _ranking_pages(spark, d), ["race", "tour", "day"], "ranking-pages"))
    rows = payloads.to_rankings(found.withColumn("snapshot_date", F.col("day").cast("date")), "tour", "snapshot_date", "race")
    return rows.select("tour", "snapshot_date", F.col("race").cast("boolean").alias("race"), "rank", "points", "player_id")


@query("""SELECT tour, race, count(*) AS pages, count(*) FILTER (bad) AS rejected FROM (
  SELECT DISTINCT tour, race, snapshot_date, 0 AS k, false AS bad FROM fx_rankings CROSS JOIN (VALUES (true), (false)) v(race)
  UNION ALL SELECT CASE WHEN k < 2 THEN 'atp' ELSE 'wta' END, k % 2 = 0, DATE '1990-01-01', k, true FROM range(0, 4) b(k)) t GROUP BY 1, 2""")
def ingest_rejects(spark, d):
    """Landed pages and those whose body is no list, which give no items."""
    path = _landed(spark, _ranking_pages(spark, d), ["race", "tour", "day"], "ranking-pages")
    pages = payloads.landed_pages(spark, path)
    bad = payloads.rejected_pages(pages).select("file").withColumn("bad", F.lit(True))
    rows = pages.select("tour", F.col("race").cast("boolean").alias("race"), "file").join(bad, "file", "left")
    return rows.groupBy("tour", "race").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("rejected"))


@query("""SELECT id, endpoint, strftime(fetched_at, '%Y-%m') AS batch, CASE WHEN row_number() OVER (PARTITION BY endpoint, strftime(fetched_at, '%Y-%m-%d') ORDER BY id) = 1 THEN rows_returned ELSE 0 END AS rows_inserted FROM fx_log""")
def log_append(spark, d):
    """The log appended by months: first every other one, then all, then all once more. Each month's rows stand there once."""
    log = table(spark, d, "fx_log")
    fetches = log.select("id", "endpoint", F.date_format("fetched_at", "yyyy-MM").alias("month"), F.concat_ws("/", "endpoint", F.to_date("fetched_at").cast("string")).alias("batch"), F.col("id").alias("page"), F.col("rows_returned").alias("inserted"))
    rows = quality.log_batches(fetches).select("id", "endpoint", "rows_inserted", F.col("month").alias("batch"))
    path = f"{shared_folder(spark)}/log-{uuid4().hex}"
    for some in (rows.where(F.substring("batch", 6, 2).cast("int") % 2 == 0), rows, rows):
        publish.append_batches(some, path, "batch")
    return spark.read.schema("id long, endpoint string, rows_inserted int, batch string").parquet(path)


#: A second version of the rankings: points of some in one year changed, one year of a tour gone, one year of the other new.
_V1 = "SELECT tour, CAST(year(snapshot_date) AS INTEGER) AS yr, CAST(snapshot_date AS DATE) AS day, bio_id, rank, pts FROM fx_rankings WHERE NOT (tour = 'atp' AND year(snapshot_date) = 1995)"
_V2 = "SELECT tour, CAST(year(snapshot_date) AS INTEGER) AS yr, CAST(snapshot_date AS DATE) AS day, bio_id, rank, pts + CASE WHEN year(snapshot_date) = 1996 AND bio_id % 10 = 3 THEN 1 ELSE 0 END AS pts FROM fx_rankings WHERE NOT (tour = 'wta' AND year(snapshot_date) = 1997)"


def _versions(spark: SparkSession, d: str) -> list[DataFrame]:
    r = table(spark, d, "fx_rankings").withColumn("yr", F.year("snapshot_date")).select("tour", "yr", F.col("snapshot_date").alias("day"), "bio_id", "rank", "pts")
    more = F.when((F.col("yr") == 1996) & (F.col("bio_id") % 10 == 3), 1).otherwise(0)
    return [r.where("not (tour = 'atp' and yr = 1995)"), r.where("not (tour = 'wta' and yr = 1997)").withColumn("pts", F.col("pts") + more)]


@query(f"""WITH a AS ({_V1}), b AS ({_V2}), odd AS (SELECT DISTINCT tour, yr FROM (SELECT * FROM a EXCEPT SELECT * FROM b UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) t),
pa AS (SELECT DISTINCT tour, yr, 1 AS x FROM a), pb AS (SELECT DISTINCT tour, yr, 1 AS y FROM b)
SELECT coalesce(pa.tour, pb.tour) AS tour, coalesce(pa.yr, pb.yr) AS yr, CASE WHEN x IS NULL THEN 'new' WHEN y IS NULL THEN 'gone' WHEN (coalesce(pa.tour, pb.tour), coalesce(pa.yr, pb.yr)) IN (SELECT (tour, yr) FROM odd) THEN 'changed' ELSE 'same' END AS state
FROM pa FULL JOIN pb ON pa.tour = pb.tour AND pa.yr = pb.yr""")
def publish_partitions(spark, d):
    """Two versions published after one another: which partitions the second one has to write."""
    out = f"{shared_folder(spark)}/published-{uuid4().hex}"
    states = [publish.publish_changed(v, f"{out}/rows", f"{out}/manifest", ["tour", "yr"]) for v in _versions(spark, d)]
    return states[1]


@query(f"SELECT * FROM ({_V2}) t")
def publish_partitions_rows(spark, d):
    """What a reader sees after the second version: its rows, those of unchanged partitions from the first one's files."""
    out = f"{shared_folder(spark)}/published-{uuid4().hex}"
    for v in _versions(spark, d):
        publish.publish_changed(v, f"{out}/rows", f"{out}/manifest", ["tour", "yr"])
    return publish.published(spark, f"{out}/rows", f"{out}/manifest", ["tour", "yr"]).select("tour", "yr", "day", "bio_id", "rank", "pts")


@query("""WITH a AS (SELECT * FROM fx_rankings), b AS (SELECT tour, snapshot_date, bio_id, rank, pts + CASE WHEN bio_id % 10 = 3 THEN 1 ELSE 0 END AS pts, ytd_pts FROM fx_rankings)
SELECT name, NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b) OR NOT moved AS same FROM (VALUES ('again', false), ('changed', true)) v(name, moved)""")
def publish_fingerprint_compare(spark, d):
    """A table's fingerprint against that of the same rows in another order and of rows with other points."""
    r = table(spark, d, "fx_rankings")
    moved = r.withColumn("pts", F.col("pts") + F.when(F.col("bio_id") % 10 == 3, 1).otherwise(0))
    first = publish.fingerprint(r).withColumnsRenamed({"rows": "n", "total": "t", "mix": "m"})
    others = publish.fingerprint(r.repartition(7, "bio_id")).withColumn("name", F.lit("again")).unionByName(publish.fingerprint(moved).withColumn("name", F.lit("changed")))
    return others.crossJoin(F.broadcast(first)).select("name", ((F.col("rows") == F.col("n")) & (F.col("total") == F.col("t")) & (F.col("mix") == F.col("m"))).alias("same"))  # one row each


STATUS = f"SELECT * FROM ({ORACLE_SQL['season_active_status']}) s"


@query(f"""WITH st AS ({STATUS}), ev AS (SELECT tour, event_id, event_stage, count(*) AS n, string_agg('{{"bio_id":' || bio_id || ',"stage":"' || stage || '","eliminated":' || CAST(eliminated AS VARCHAR) || '}}', ',' ORDER BY bio_id) AS players FROM st GROUP BY 1, 2, 3)
SELECT tour, count(*) AS n_events, CAST(sum(n) AS BIGINT) AS n_players, '[' || string_agg('{{"event_id":"' || event_id || '","event_stage":"' || event_stage || '","players":[' || players || ']}}', ',' ORDER BY event_id) || ']' AS active FROM ev GROUP BY tour""")
def publish_active(spark, d):
    """The active events of each tour's season object: events in order, and in each its players with their stage and whether they are out."""
    return publish.export_active(season_active_status(spark, d))


#: First names as they are composed, of several scripts.
GIVEN = [unicodedata.normalize("NFC", n) for n in ("Gaël", "Ñandú", "Ångela", "Ζωή", "Йован", "Łukasz", "Ệm", "Søren", "İpek", "Anna")]
_LIST = "[" + ", ".join(f"'{n}'" for n in GIVEN) + "]"
_APART = "[" + ", ".join(f"'{unicodedata.normalize('NFD', n)}'" for n in GIVEN) + "]"
_FOLD = lambda x: f"trim(regexp_replace(lower(strip_accents({x})), '\\s+', ' ', 'g'))"


def _given(spark: SparkSession, d: str, form: str):
    names = F.array(*(F.lit(unicodedata.normalize(form, n)) for n in GIVEN))
    return _players(spark, d).select("mid", F.concat(F.element_at(names, (F.col("mid") % len(GIVEN) + 1).cast("int")), F.lit("  SUR-"), F.col("mid").cast("string")).alias("name"))


@query(f"SELECT mid, {_FOLD(f'''{_APART}[mid % {len(GIVEN)} + 1] || '  SUR-' || mid''')} AS key, replace({_FOLD(f'''{_APART}[mid % {len(GIVEN)} + 1] || '  SUR-' || mid''')}, '-', ' ') AS link_key FROM fx_players")
def link_name_keys(spark, d):
    """Keys of names with letters and marks apart, of several scripts, as rankings and as links use them."""
    return _given(spark, d, "NFD").select("mid", C.name_key(F.col("name")).alias("key"), C.name_key(F.col("name"), hyphens=True).alias("link_key"))


@query(f"WITH a AS (SELECT mid, {_FOLD(f'''{_LIST}[mid % {len(GIVEN)} + 1] || '  SUR-' || mid''')} AS k FROM fx_players) SELECT x.mid + 7000000 AS pid, y.mid FROM a x LEFT JOIN a y ON x.k = y.k")
def link_accents(spark, d):
    """Composed names against the same names with marks apart: each is found."""
    players = _given(spark, d, "NFC").withColumns({"ab": F.lit(None).cast("string"), "ordinal": F.col("mid")})
    rows = _given(spark, d, "NFD").select((F.col("mid") + 7000000).alias("pid"), F.lit(None).cast("long").alias("player_id"), F.col("name").alias("player_name"))
    return link.resolve_by_name(rows, players).select("pid", "mid")


@query("WITH " + SPLIT + ", al AS (SELECT id, date, 0 AS o FROM ba UNION ALL SELECT id, date, ord AS o FROM bt) SELECT id, arg_min(date, o) AS date, arg_max(date, o) AS fetched_at FROM al GROUP BY id")
def merge_patch_touched(spark, d):
    """A late merge renews when a match was fetched, here the day of the newest row, and nothing else that is set."""
    base, batch = (rows.select("id", "date", F.col("date").alias("fetched_at"), "score", *more) for rows, more in zip(_split(spark, d), ([], ["ord"])))
    return merge.patch_late(base, batch, "ord", late=()).select("id", "date", "fetched_at")


@query("WITH " + CHECKS + " SELECT count(*) FILTER (hard AND NOT ok) AS failures, count(*) FILTER (NOT hard AND NOT ok) AS warnings, count(*) FILTER (NOT ok) = 0 AS passed FROM ck")
def quality_verdict_strict(spark, d):
    """Warnings count as failures for the verdict."""
    return quality.verdict(_checks(spark, d), strict=True)
