"""Hand-made rows for the edge semantics of single operators."""

from __future__ import annotations

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchframe import schema
from matchframe.functions import columns as C
from matchframe.operators import catalog, h2h, link, merge, profile, project, quality, season, sides
from matchframe.sinks import publish
from matchframe.sources import payloads

MATCH = "id string, tour string, p1_id long, p2_id long, winner_id long, date date, round string, surface string, score string, best_of int, tournament_id string, event_type string, draw_size int, active boolean, tournament_name string, stat_p1 map<string,string>, stat_p2 map<string,string>"


def match(id, p1, p2, winner, round_="First", score="6-4 6-3", best_of=None, day=1, draw=32, active=False, s1=None, s2=None, kind="GS"):
    return (id, "atp", p1, p2, winner, date(2001, 6, day), round_, "H", score, best_of, "ev", kind, draw, active, "Event", s1, s2)


PLAYERS = [("atp", 1, 1, "A", "USA"), ("atp", 2, 2, "B", "FRA"), ("atp", 3, 3, "C", "GER")]


@pytest.fixture
def players(spark):
    return spark.createDataFrame(PLAYERS, "tour string, mid long, bio_id int, name string, country string")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("stats", "names", "want"), [
    ({"firstServeOf": "0", "svpt": "50"}, "svpt", 0), ({"aces": "NA", "ace": "4"}, "aces", 4), ({"aces": "3.9"}, "aces", 3), ({"aces": "x"}, "aces", 0), ({}, "aces", 0),
])
def test_stat_aliases(spark, stats, names, want):
    df = spark.createDataFrame([(stats,)], "m map<string,string>")
    assert df.select(C.stat_int(F.col("m"), *C.STAT_ALIASES[names]).alias("v")).first()["v"] == want


@pytest.mark.parametrize(("score", "want"), [("6-2 2-1 RET", False), ("W/O", False), ("", False), (None, False), ("6-4 6-3", True), ("6-4 def", False)])
def test_completed(spark, score, want):
    assert value(spark, C.completed(F.lit(score).cast("string"))) is want


@pytest.mark.parametrize(("score", "won", "n", "played", "taken"), [("7-6(5) 4-6 6-3", True, 3, 1, 1), ("6-2 2-1", True, 1, 0, 0), ("6-7(3) 7-5 7-6(8)", False, 3, 2, 1), (None, True, 0, 0, 0)])
def test_sets_and_tiebreaks(spark, score, won, n, played, taken):
    sets = C.sets_of(F.lit(score).cast("string"))
    row = spark.range(1).select(F.size(sets).alias("n"), C.tiebreaks_played(sets).alias("p"), C.tiebreaks_won(sets, F.lit(won)).alias("w")).first()
    assert tuple(row) == (n, played, taken)


def test_rounding_is_half_even_in_integers(spark):
    rows = spark.createDataFrame([(49, 400), (1, 3), (-49, 400), (1, 0), (51, 400)], "a long, b long")
    assert [r["v"] for r in rows.select(C.ratio("a", "b", 1).alias("v")).collect()] == [12.2, 33.3, -12.2, None, 12.8]


def test_form(spark):
    assert value(spark, C.form_pct(F.lit("LLWWWWWWWWWL"))) == 90
    assert value(spark, C.form_recent(F.lit("WLW"), 2)) == [0, 1]
    assert value(spark, C.form_pct(F.lit(""))) is None


def test_names_and_slugs(spark):
    assert value(spark, C.name_key(F.lit("  Gaël  MONFILS "))) == "gael monfils"
    assert value(spark, C.name_key(F.lit("O'Neil Smith-Ray"), hyphens=True)) == "o neil smith ray"
    assert value(spark, C.slug(F.lit("Cup - São 2!"), F.lit(2003))) == "so203"
    assert value(spark, C.slug(F.lit("- "), F.lit(2024))) == "event24"


def test_points_rescale(spark):
    assert value(spark, C.rescaled_points(F.lit("wta"), F.lit(12350))) == 124
    assert value(spark, C.rescaled_points(F.lit("atp"), F.lit(12350))) == 12350


def test_round_semantics(spark):
    rows = {(r.draw_bucket, r["round"]): (r.played, r["next"]) for r in schema.round_semantics(spark).collect()}
    assert rows[96, "First"] == ("R64", "R64") and rows[128, "1/8"] == ("R16", "QF") and rows[32, "Second"] == ("R16", "QF")
    assert rows[64, "Third"] == ("R16", "QF") and (32, "Third") not in rows and (64, "Fourth") not in rows and len(rows) == 27 - 1


def test_breakpoint_backfill_and_decider(spark, players):
    stats = {"svpt": "60", "1stWon": "20", "2ndWon": "10"}
    df = spark.createDataFrame([match("a", 1, 2, 1, score="7-6(5) 4-6 6-3", s1=stats, s2={"breakPointsConverted": "2", "breakPointsConvertedOf": "7"})], MATCH)
    row = profile.measured(df, players).where("mid = 1").first()
    assert (row.bp_faced, row.bp_saved, row.svpt, row.serve_won, row.dec_played, row.dec_won, row.tb_won) == (7, 5, 60, 30, 1, 1, 1)


def test_profile_needs_five_completed(spark, players):
    rows = [match(str(k), 1, 2, 1, day=k + 1) for k in range(4)] + [match("x", 1, 2, 1, score="6-2 2-1 RET", day=9)]
    assert profile.profile_by_year(profile.measured(spark.createDataFrame(rows, MATCH), players)).count() == 0
    full = profile.profile_by_year(profile.measured(spark.createDataFrame([*rows, match("y", 1, 2, 2, day=10)], MATCH), players))
    assert sorted((r.bio_id, r.matches, r.match_win_pct) for r in full.collect()) == [(1, 5, 80.0), (2, 5, 20.0)]


def test_h2h_order_recents_and_unknown_winner(spark, players):
    outcomes = [3, 1, 3, 3, 1, 3]  # bio 3 as p1; the low id is 1
    rows = [match(str(k), 3, 1, w, day=k + 1) for k, w in enumerate(outcomes)] + [match("n", 3, 1, None, day=20)]
    row = h2h.h2h(spark.createDataFrame(rows, MATCH), players).first()
    assert (row.a, row.b, row.a_wins, row.b_wins, row.recent, row.h_a, row.last_date) == (1, 3, 2, 4, "1,2,2,1,2", 2, date(2001, 6, 6))
    views = {(r.me, r.my_wins, r.recent) for r in h2h.h2h_view(h2h.h2h(spark.createDataFrame(rows, MATCH), players)).collect()}
    assert views == {(1, 2, "1,2,2,1,2"), (3, 4, "2,1,1,2,1")}


def test_active_status(spark, players):
    rows = [match("1", 1, 2, 1, "First", day=1, active=True), match("2", 1, 3, 1, "Second", day=2, active=True), match("3", 2, 3, 2, "First", day=3, active=True)]
    got = {r.bio_id: (r.stage, r.eliminated) for r in season.active_status(spark.createDataFrame(rows, MATCH), players, "2001-07-01").collect()}
    assert got[1] == ("QF", False) and got[2] == ("R16", True) and got[3] == ("R32", True)
    later = [*rows, match("4", 1, 2, None, "1/4", day=4, active=True), match("5", 3, 2, 3, "Q1", day=5, active=True)]
    got = {r.bio_id: (r.stage, r.eliminated) for r in season.active_status(spark.createDataFrame(later, MATCH), players, "2001-07-01").collect()}
    assert got == {1: ("QF", True)}  # an unknown winner is out; a latest round without meaning drops the player


def test_results_of_small_draws(spark, players):
    got = {r.bio_id: r.stage for r in season.season_results(spark.createDataFrame([match("1", 1, 2, 1, "Third", draw=56), match("2", 1, 3, 3, "First", draw=96)], MATCH), players).collect()}
    assert got == {1: "R64", 3: "R64"}


def test_season_rank_fallback(spark, players):
    ranks = spark.createDataFrame([("atp", date(2001, 6, 1), 1, 5, 900, 400), ("atp", date(2001, 7, 1), 1, 3, 1000, 500)], schema.RANKINGS)
    none = season.season_results(spark.createDataFrame([], MATCH), players)
    got = {r.bio_id: (r.rank, r.pts, r.rank_move) for r in season.season_table(players, ranks, none, "2001-07-03").collect()}
    assert got == {1: (3, 1000, 2), 2: (2, 0, 0), 3: (3, 0, 0)}


CORE = "id string, round string, winner_id long, score string, stat_p1 map<string,string>, stat_p2 map<string,string>, fetched_at timestamp"


def test_late_patch_and_idempotence(spark):
    base = spark.createDataFrame([("m", "First", None, "", None, None, None)], CORE)
    batch = spark.createDataFrame([("m", "Second", 5, "6-1 6-1", {"a": "1"}, None, None, 1), ("n", "First", None, None, None, None, None, 2), ("n", "Final", 7, "6-0 6-0", None, None, None, 3)], CORE + ", ord long")
    once = merge.patch_late(base, batch, "ord")
    got = {r.id: (r["round"], r.winner_id, r.score, r.stat_p1) for r in once.collect()}
    assert got == {"m": ("First", 5, "6-1 6-1", {"a": "1"}), "n": ("First", 7, "6-0 6-0", None)}
    assert {r.id: r["round"] for r in merge.patch_late(once, batch, "ord").collect()} == {"m": "First", "n": "First"}
    assert merge.insert_ignore(base, batch, ["id"], "ord").count() == 2
    assert {r.id: r["round"] for r in merge.upsert(base, batch, ["id"], "ord").collect()} == {"m": "Second", "n": "Final"}


@pytest.mark.parametrize(("bio", "reg", "kind", "linked"), [
    (("Elias X", "SWE"), ("Mikael X", "SWE"), "rejected_diff_first", False), (("Zhang Wei", "CHN"), ("Wei Zhang", "CHN"), "word_order", True), (("Dan Kas", "RUS"), ("Dan Kas", "AUS"), "last+first", True),
    (("Ana Ruiz", "ESP"), ("Maria Ana Ruiz Serra", "ESP"), "subset_match+country", True), (("Ivan Čo", "CRO"), ("Ivan Co", "HRV"), "exact_full", True), (("Nob Ody", "USA"), ("Some One", "USA"), "unmatched", False),
])
def test_linking(spark, bio, reg, kind, linked):
    left = spark.createDataFrame([(1, bio[0], None, bio[1])], "bid long, name string, ab string, country string")
    right = spark.createDataFrame([(9, 1, *reg)], "pid long, ordinal long, name string, country string")
    row = link.link(left, right).first()
    assert (row.kind, row.pid is not None) == (kind, linked)


def test_catalog_split_and_merge(spark):
    rows = [("cup", 2024, "atp", "M250", 1, date(2024, 1, 1), date(2024, 1, 7), 5), ("cup", 2024, "wta", "W500", 2, date(2024, 1, 2), date(2024, 1, 8), 6), ("big", 2024, "atp", "M1000", 3, date(2024, 2, 1), date(2024, 2, 9), 7), ("big", 2024, "wta", "W1000", 4, date(2024, 2, 2), date(2024, 2, 10), 8)]
    cands = spark.createDataFrame(rows, "slug string, year int, tour string, tier string, api_id int, first_date date, last_date date, n long")
    got = {r.id: (r.tour, r.type, r.n) for r in catalog.generate_catalog(cands, cands.limit(0).select("tour", "api_id")).collect()}
    assert got == {"cup24_a": ("atp", "M250", 5), "cup24_w": ("wta", "W500", 6), "big24": ("both", "M1000", 15)}


def test_expected_points_and_symmetry(spark):
    row = project.expected_points(spark.createDataFrame([(1, "GS")], "rank int, type string")).first()
    assert row.expected100 == 124730
    cols = "tour string, bio_id int, rank int, surf_h int, surf_c int, surf_g int, form_pct long"
    a, b = ("atp", 1, 4, 60, 0, 55, 70), ("atp", 2, 4, 60, 0, 55, 70)
    none = spark.createDataFrame([], "tour string, a int, b int, a_wins long, b_wins long")
    got = project.win_probability(project.matchups(spark.createDataFrame([a, b], cols)), none).collect()
    assert {(r.prob, r.confidence) for r in got} == {(0.5, "Toss-up")}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 60), st.integers(0, 100)), min_size=2, max_size=2, unique_by=lambda x: x[0]))
def test_probabilities_of_a_pair_add_to_one(spark, pair):
    cols = "tour string, bio_id int, rank int, surf_h int, surf_c int, surf_g int, form_pct long"
    none = spark.createDataFrame([], "tour string, a int, b int, a_wins long, b_wins long")

    def prob(x, y):
        rows = [("atp", k, p[0], p[1], p[1], p[1], p[2]) for k, p in ((1, x), (2, y))]
        return project.win_probability(project.matchups(spark.createDataFrame(rows, cols)), none).first().prob

    assert prob(*pair) + prob(*pair[::-1]) == pytest.approx(1, abs=2e-6)


def test_payload_shapes(spark):
    one = '{"data":[{"id":7,"player1Id":1,"player2Id":2,"date":"2001-06-01T10:00","round":{"name":"Final"},"tournament":{"id":3,"courtId":3},"stat":{"p1":{"aces":"1"}},"winnerId":0,"result":""}]}'
    two = '[{"matchId":"8","p1Id":1,"p2Id":2,"matchDate":"2001-06-02","round":"First","match_winner":2,"score":"6-0 6-0"},{"id":9,"player1Id":1,"date":"2001-06-02"},{"id":10,"player1Id":1,"player2Id":2,"date":"2001"}]'
    pages = spark.createDataFrame([(one,), (two,), ('{"error":1}',), ("",)], "value string")
    got = {r.id: (r["round"], r.winner_id, r.surface, r.score, r.stat_p1) for r in payloads.to_matches(payloads.payload_items(pages), "atp").collect()}
    assert got == {"7": ("Final", None, "C", None, {"aces": "1"}), "8": ("First", 2, None, "6-0 6-0", None)}


def test_catalog_sources(spark):
    raw = spark.createDataFrame([(5, "ATP", 1, "s", "N", "n.", "USA", 20, (0.5, 0.4, 0.3), "WL", None), (None, "ATP", 2, "s", "M", "m.", "USA", 20, None, "W", True)], "mid long, tour string, id int, sid string, name string, ab string, nat string, age int, surf struct<H:double,C:double,G:double>, form string, inj boolean")
    row = payloads.load_players(raw).first()
    assert payloads.load_players(raw).count() == 1 and (row.bio_id, row.country, row.meta.inj, row.tour) == (1, "USA", False, "atp")
    events = spark.createDataFrame([("e", "E", "E", "Both", "M1000", "H", 128, "2001-01-01", "2001-01-09", (3, None), True), ("f", "F", "F", "atp", "XX", "H", 32, None, None, None, None)], "id string, name string, short string, tour string, type string, surf string, draw int, startDate string, endDate string, apiId struct<atp:int,wta:int>, active boolean")
    got = {r.id: r for r in payloads.load_events(events, schema.points_long(spark)).collect()}
    assert got["e"].points_table["R64"] == 35 and got["f"].points_table is None and got["e"].api_id_atp == 3
    assert payloads.points_from_json(spark.createDataFrame([('{"GS":{"W":2000}}',)], "value string")).first()["pts"] == 2000


def test_winner_loser_files(spark, tmp_path):
    names = [c.split()[0] for c in payloads.WL_SCHEMA.split(", ")]
    (tmp_path / "x.csv").write_text(",".join(names) + "\n" + ",".join(["20010601", "Cup", "Hard", "F", "4", "5", "6-1 6-1", "3", *["1"] * (len(names) - 8)]) + "\n")
    row = payloads.read_wl_csv(spark, str(tmp_path), "atp").first()
    assert (row.p1_id, row.winner_id, row.surface, row.date, row.stat_p2["aces"]) == (4, 4, "H", date(2001, 6, 1), "1")


def test_publish_only_what_changed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    assert publish.publish_if_changed(df, out, manifest, "t")
    assert not publish.publish_if_changed(df.orderBy(F.desc("k")), out, manifest, "t")
    assert publish.publish_if_changed(df.union(df.limit(1)), out, manifest, "t")
    publish.write_snapshot({"t": df}, str(tmp_path / "snap"), {"t": ["v"]})
    assert payloads.read_snapshot(spark, str(tmp_path / "snap"), ["t"])["t"].count() == 2


def test_empty_tables(spark, players):
    none = spark.createDataFrame([], MATCH)
    assert sides.sides(none).count() == 0 and h2h.h2h(none, players).count() == 0
    assert profile.profile_rolling(profile.measured(none, players), "2001-07-03").count() == 0
    assert quality.check_recency(none, "date", "2001-07-03", 14, "r", False).first()["hard"] is True
