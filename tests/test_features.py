"""Streams, landed files, publishing, links and projections on small tables with literal results, and against plain ways."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from matchframe.functions import columns as C
from matchframe.operators import catalog, link, project, quality
from matchframe.sinks import publish
from matchframe.sources import payloads
from matchframe.streaming import streams

MATCH = "id string, round string, winner_id long, score string, fetched_at string, stat_p1 string, stat_p2 string"


def part():
    return F.pmod(F.col("id").cast("long"), F.lit(4)).cast("long")


def test_ingest_touches_only_its_partitions_and_runs_once(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(str(i), "F", None, "", "t0", None, None) for i in ids], MATCH)
    table, ledger = str(tmp_path / "table"), str(tmp_path / "ledger")
    streams.create_table(rows(0, 1, 2, 3), table, part, ledger)
    before = {r.part: r.file for r in streams.partition_files(spark, table).collect()}
    batch = spark.createDataFrame([("1", "SF", 7, "6-1", "t1", "a", None, 1), ("1", "QF", 8, "6-2", "t2", None, "b", 2), ("5", "R1", None, "", "t3", None, None, 3)], MATCH + ", ord long")
    columns = batch.columns[:-1]
    assert streams.merge_batch(batch, 0, columns, table, "ord", part, ledger)
    now = {r.id: tuple(r) for r in spark.read.parquet(table).drop("part").collect()}
    assert now["1"] == ("1", "F", 7, "6-1", "t2", "a", "b") and now["5"] == ("5", "R1", None, "", "t3", None, None) and len(now) == 5
    after = {r.part: r.file for r in streams.partition_files(spark, table).collect()}
    assert {p for p in before if before[p] != after[p]} == {1}
    # the same batch again: the ledger stops it; merged without an entry, it changes no row
    assert not streams.merge_batch(batch, 0, columns, table, "ord", part, ledger)
    assert streams.partition_files(spark, table).count() == 4
    assert streams.merge_batch(batch, 1, columns, table, "ord", part, ledger)
    assert {r.id: tuple(r) for r in spark.read.parquet(table).drop("part").collect()} == now
    assert sorted(tuple(r) for r in streams.merged_batches(spark, ledger).collect()) == [(0, 3), (1, 3)]


def drained(spark, tmp_path, schema, goes, shape):
    """Each go lands and is taken in by a run of its own."""
    landed, out, state = (str(tmp_path / name) for name in ("landed", "out", "state"))
    for go in goes:
        spark.createDataFrame(go, schema).selectExpr("timestamp_seconds(t) AS t", "* EXCEPT (t)").write.mode("append").parquet(landed)
        streams.run_once(shape(spark.readStream.schema("t timestamp, k string").parquet(landed)), out, state)
    return spark.read.parquet(out), state


def test_dedup_forgets_keys(spark, tmp_path):
    """Within the delay a repeat is known, beyond it a new row of the id is new, and rows older than the watermark are late."""
    goes = [[(100, "a"), (100, "b")], [(105, "a"), (110, "c")], [(200, "d")], [(201, "a"), (120, "b"), (100, "c")]]
    rows, state = drained(spark, tmp_path, "t long, k string", goes, lambda s: streams.stream_dedup(s, "t", "20 seconds", ["k"]))
    assert sorted((r.t, r.k) for r in rows.selectExpr("unix_seconds(t) AS t", "k").collect()) == [(100, "a"), (100, "b"), (110, "c"), (200, "d"), (201, "a")]
    assert streams.state_rows(spark, state).count() == 2  # d and the new a


def test_windows_are_given_once_when_closed(spark, tmp_path):
    log = lambda s: streams.stream_log_rates(s.select(F.col("t").alias("fetched_at"), F.col("k").alias("endpoint"), F.lit(500).alias("http_status"), F.lit(2).alias("rows_returned")), "1 minute", "30 seconds", "10 seconds")
    goes = [[(0, "x"), (40, "x")], [(100, "x")], [(50, "x"), (20, "x")], [(1000, "y")]]
    rows, _ = drained(spark, tmp_path, "t long, k string", goes, log)
    got = sorted((r.s, r.calls, r.errors, r.rows) for r in rows.where("endpoint = 'x'").selectExpr("unix_seconds(start) AS s", "calls", "errors", "rows").collect())
    # at 90 s the windows up to then are closed: the late row of 50 s counts for none, as both of its windows have ended
    assert got == [(-30, 1, 1, 2), (0, 2, 2, 4), (30, 1, 1, 2), (60, 1, 1, 2), (90, 1, 1, 2)]


def test_landed_files(spark, tmp_path):
    bodies = {"race=false/a.json": '[{"position":1,"playerId":5}]', "race=true/b.json": '{"data":[{"position":2,"playerId":6},{"position":3,"playerId":7}]}', "race=true/c.json": '{"data":{"x":1}}', "race=false/d.json": "oops", "race=false/e.json": "[]"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    rows = payloads.to_rankings(payloads.read_ranking_payloads(spark, str(tmp_path)), "race")
    assert sorted((r.race, r["rank"], r.player_id) for r in rows.collect()) == [(False, 1, 5), (True, 2, 6), (True, 3, 7)]
    bad = payloads.rejected_pages(payloads.landed_pages(spark, str(tmp_path))).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.bytes, r.race) for r in bad) == [("c.json", 16, "true"), ("d.json", 4, "false")]


def test_publish_writes_changed_partitions(spark, tmp_path):
    out, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v int, fetched_at int")
    states = lambda df: {r.k: r.state for r in publish.publish_changed(df, out, manifest, ["k"]).collect()}
    files = lambda: {r.k: r.f for r in spark.read.parquet(out).select("k", F.col("_metadata.file_name").alias("f")).distinct().collect()}
    assert states(frame(("a", 1, 0), ("b", 1, 0), ("c", 1, 0))) == {"a": "new", "b": "new", "c": "new"}
    first = files()
    assert states(frame(("a", 1, 9), ("b", 2, 0), ("d", 1, 0))) == {"a": "same", "b": "changed", "c": "gone", "d": "new"}
    second = files()
    assert second["a"] == first["a"] and second["b"] != first["b"]
    assert sorted((r.k, r.v) for r in publish.published(spark, out, manifest, ["k"]).collect()) == [("a", 1), ("b", 2), ("d", 1)]
    assert states(frame(("a", 1, 0), ("b", 2, 0), ("c", 1, 0), ("d", 1, 0))) == {"a": "same", "b": "same", "c": "new", "d": "same"}
    assert files()["a"] == first["a"]


def test_log_batches_are_appended_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = quality.log_batches(spark.createDataFrame([("x", "f1", 2, 30), ("y", "f1", 1, 30), ("z", "f2", 1, 4)], "id string, batch string, page int, inserted int"))
    for some in (rows.where("batch = 'f1'"), rows, rows):
        publish.append_batches(some, log, "batch")
    assert sorted((r.id, r.batch, r.rows_inserted) for r in spark.read.parquet(log).collect()) == [("x", "f1", 0), ("y", "f1", 30), ("z", "f2", 4)]


def test_active_events_nest_players(spark):
    status = spark.createDataFrame([("wta", "e2", "SF", 9, "QF", True), ("wta", "e2", "SF", 3, "SF", False), ("wta", "e1", "F", 3, "F", False)], "tour string, event_id string, event_stage string, bio_id int, stage string, eliminated boolean")
    row = publish.export_active(status).first()
    assert (row.n_events, row.n_players) == (2, 3)
    assert row.active == '[{"event_id":"e1","event_stage":"F","players":[{"bio_id":3,"stage":"F","eliminated":false}]},{"event_id":"e2","event_stage":"SF","players":[{"bio_id":3,"stage":"SF","eliminated":false},{"bio_id":9,"stage":"QF","eliminated":true}]}]'


def test_names_are_folded(spark):
    names = ["Gaël  MONFILS", "Ζωή", "Йован", "Ệm", "Søren", "ﬁn", "plain", None]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", C.name_key(F.col("n")).alias("n")).collect()
    assert [r.n for r in sorted(rows)] == ["gael monfils", "ζωη", "иован", "em", "søren", "fin", "plain", None]


LEFT, RIGHT = "bid long, name string, ab string, country string", "pid long, ordinal long, name string, country string"


def cascade(spark, bios, regs):
    return {r.bid: (r.pid, r.kind) for r in link.link(spark.createDataFrame(bios, LEFT), spark.createDataFrame(regs, RIGHT)).collect()}


def test_links_of_namesakes(spark):
    regs = [(1, 1, "Ana Lee", "USA"), (2, 2, "Bo Lee", "GBR"), (3, 3, "Cy Lee", "USA"), (4, 4, "Dan Kim", "KOR"), (5, 5, "Eva Maria Ott", "GER"), (6, 6, "Eva Karl Ott", "GER"), (7, 7, "Ann Zu", ""), (8, 8, "Al Noor Bey", "TUR")]
    bios = [
        (10, "Xo Lee", None, "GBR"), (11, "Xo Lee", None, "USA"), (12, "Xo Lee", None, None), (13, "Da Kim", None, "KOR"), (14, "Da Kim", None, "JPN"), (15, "Zed Kim", None, "KOR"), (16, "Zed Kim", None, "JPN"),
        (17, "Dan Park", "D.Kim", "KOR"), (18, "Eva Ott", None, "GER"), (19, "Ann Zu", None, ""), (20, "Lee Ana", None, "USA"), (21, "Noor Al", None, "TUR"), (22, "Nobody Here", None, "USA"), (23, "Noor Al", None, "USA"),
    ]
    assert cascade(spark, bios, regs) == {
        10: (2, "exact_last+country"), 11: (None, "ambiguous"), 12: (None, "ambiguous"), 13: (4, "exact_last+country"), 14: (4, "last+first"), 15: (None, "rejected_diff_first"), 16: (None, "rejected_diff_first+country"),
        17: (4, "exact_last+country"), 18: (None, "ambiguous"), 19: (7, "last+first"), 20: (1, "word_order"), 21: (8, "subset_match+country"), 22: (None, "unmatched"), 23: (8, "subset_match_country_diff"),
    }


def test_a_hot_surname_builds_no_pairs(spark):
    """A thousand namesakes on both sides: no join gives more rows than a few for each name."""
    left = spark.range(1000).select(F.col("id").alias("bid"), F.concat(F.lit("N"), "id", F.lit(" Smith")).alias("name"), F.lit(None).cast("string").alias("ab"), F.lit("USA").alias("country"))
    right = spark.range(1000).select((F.col("id") + 5000).alias("pid"), F.col("id").alias("ordinal"), F.concat(F.lit("M"), "id", F.lit(" Smith")).alias("name"), F.lit("USA").alias("country"))
    out = link.link(left, right)
    rows = out.collect()
    assert {r.kind for r in rows} == {"ambiguous"} and len(rows) == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_patterns_against_all_pairs(spark):
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abAé ") for _ in range(n))
    names = [(word(draw.randrange(0, 9)), draw.choice(["atp", "wta"])) for _ in range(60)]
    patterns = [(k, word(draw.randrange(0, 5)), draw.choice([None, "M250"]), draw.choice([None, "W250"]), f"s{k}") for k in range(25)]
    frame = catalog.classify_events(spark.createDataFrame(names, "name string, tour string"), spark.createDataFrame(patterns, "ordinal int, substring string, atp_tier string, wta_tier string, slug string"))
    assert "NestedLoop" not in frame._jdf.queryExecution().executedPlan().toString()
    want = sorted((n, t, next((p[4] for p in patterns if p[1].lower() in n.lower() and p[2 if t == "atp" else 3]), None)) for n, t in names)
    assert sorted(((r.name, r.tour, r.event_slug) for r in frame.collect()), key=str) == sorted(want, key=str)


def test_top_stakes_without_all_pairs(spark):
    draw = random.Random(2)
    players = spark.createDataFrame([(k, draw.randrange(1, 120), draw.choice(["W", "F", "SF", "R32", "none", None])) for k in range(300)], "id long, rank int, last_result string")
    events = spark.createDataFrame([(f"e{k}", draw.choice(["GS", "M1000", "W250", None]), draw.random() < 0.5) for k in range(20)], "event_id string, type string, live boolean")
    plain = project.stakes_top(project.points_at_stake(players, events)).drop("_")
    got = project.top_stakes(players, events)
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, plain.select(*sorted(got.columns)).collect()))


def test_places_of_new_rows(spark):
    rows = spark.createDataFrame([("b", "2001-01-02"), ("a", "2001-01-02"), ("c", "2000-05-01"), ("d", None)], "id string, start_date string")
    assert {r.id: r.place for r in catalog.catalog_places(rows).collect()} == {"d": 1, "c": 2, "a": 3, "b": 4}


def test_no_view_is_left(spark):
    from matchframe.plans import core

    core.QUERIES["season_table"](spark, "/root/testdata/sf0.001").count()
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]
