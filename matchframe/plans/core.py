"""Registered queries over the derived tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..fixtures import AS_OF, table, with_tables
from ..functions import columns as C
from ..operators import h2h, history, profile, project, ranks, season, sides
from ..sinks import publish

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query and, with the tables it needs, its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return add


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return parsed_stats(table(spark, d, "fx_matches"))


def parsed_stats(m: DataFrame) -> DataFrame:
    return m.withColumn("stat_p1", F.from_json("stat_p1", schema.STATS)).withColumn("stat_p2", F.from_json("stat_p2", schema.STATS))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """Matches without their statistics, for what does not use them."""
    return table(spark, d, "fx_matches").drop("stat_p1", "stat_p2", "l_linestatus")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return sides.resolve_event(_plain(spark, d), table(spark, d, "fx_events"))


def _players(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fx_players")


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    """A lookup as a common table expression."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


SEM = _values("sem", "draw_bucket, round, played, nxt", list(schema.ROUNDS))
DEPTH = _values("dep", "stage, depth", [(s, k) for k, s in enumerate(schema.STAGES, 1)])
RDEPTH = _values("rdep", "round, depth", list(schema.ROUND_DEPTHS.items()))
PTS = _values("ptab", "points_type, stage, pts", [(t, s, p) for t, row in schema.POINTS.items() for s, p in row.items()])
BUCKET = "CASE WHEN draw_size >= 128 THEN 128 WHEN draw_size >= 96 THEN 96 WHEN draw_size >= 64 THEN 64 ELSE 32 END"
SIDES = """sd AS (
  SELECT id, tour, date, round, surface, score, best_of, tournament_api_id, tournament_name, tournament_id, event_name, event_type, draw_size, active, p1_id AS mid, p2_id AS opp_id, winner_id,
    CASE WHEN winner_id IS NOT NULL THEN winner_id = p1_id END AS won, stat_p1 AS own, stat_p2 AS opp FROM fx_resolved
  UNION ALL
  SELECT id, tour, date, round, surface, score, best_of, tournament_api_id, tournament_name, tournament_id, event_name, event_type, draw_size, active, p2_id, p1_id, winner_id,
    CASE WHEN winner_id IS NOT NULL THEN winner_id = p2_id END, stat_p2, stat_p1 FROM fx_resolved),
tr AS (SELECT sd.*, p.bio_id, p.name FROM sd JOIN fx_players p ON sd.tour = p.tour AND sd.mid = p.mid)"""
H2H = """met AS (
  SELECT m.tour, least(p.bio_id, q.bio_id) AS a, greatest(p.bio_id, q.bio_id) AS b,
    CASE WHEN (p.bio_id < q.bio_id) = (winner_id = p1_id) THEN 1 ELSE 2 END AS code, coalesce(surface, 'H') AS surface, date, id
  FROM fx_matches m JOIN fx_players p ON m.tour = p.tour AND m.p1_id = p.mid JOIN fx_players q ON m.tour = q.tour AND m.p2_id = q.mid
  WHERE winner_id IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY tour, a, b ORDER BY date DESC, id DESC) AS rn FROM met),
hh AS (SELECT tour, a, b, count(*) FILTER (code = 1) AS a_wins, count(*) FILTER (code = 2) AS b_wins,
  count(*) FILTER (code = 1 AND surface = 'H') AS h_a, count(*) FILTER (code = 2 AND surface = 'H') AS h_b,
  count(*) FILTER (code = 1 AND surface = 'C') AS c_a, count(*) FILTER (code = 2 AND surface = 'C') AS c_b,
  count(*) FILTER (code = 1 AND surface = 'G') AS g_a, count(*) FILTER (code = 2 AND surface = 'G') AS g_b,
  string_agg(CAST(code AS VARCHAR), ',' ORDER BY date, id) FILTER (rn <= 5) AS recent, max(date) AS last_date
  FROM rk GROUP BY tour, a, b)"""


@query("WITH " + H2H + " SELECT * FROM hh")
def h2h_pairs(spark, d):
    return h2h.h2h(_plain(spark, d), _players(spark, d))


@query("WITH " + H2H + """
SELECT tour, a AS me, b AS them, a_wins AS my_wins, b_wins AS their_wins, recent FROM hh
UNION ALL SELECT tour, b, a, b_wins, a_wins, translate(recent, '12', '21') FROM hh""")
def h2h_views(spark, d):
    return h2h.h2h_view(h2h_pairs(spark, d))


@query("SELECT id, p1_id AS mid, p2_id AS opp_id, true AS we_p1, CASE WHEN winner_id IS NOT NULL THEN winner_id = p1_id END AS won FROM fx_matches UNION ALL SELECT id, p2_id, p1_id, false, CASE WHEN winner_id IS NOT NULL THEN winner_id = p2_id END FROM fx_matches")
def sides_all(spark, d):
    return sides.sides(_plain(spark, d)).select("id", "mid", "opp_id", "we_p1", "won")


@query("SELECT id, tour, tournament_api_id, tournament_id, event_type, draw_size, active FROM fx_resolved")
def sides_resolve_event(spark, d):
    return _resolved(spark, d).select("id", "tour", "tournament_api_id", "tournament_id", "event_type", "draw_size", "active")


RESULTS = SEM + ", " + DEPTH + ", " + PTS + ", " + SIDES + f""",
st AS (SELECT tr.tour, bio_id, tournament_id AS event_id, event_type, draw_size, CASE WHEN coalesce(won, false) THEN nxt ELSE played END AS stage
  FROM tr JOIN sem ON sem.draw_bucket = {BUCKET} AND sem.round = tr.round WHERE NOT active),
bs AS (SELECT tour, bio_id, event_id, max(event_type) AS event_type, max(draw_size) AS draw_size, max(depth) AS depth FROM st JOIN dep USING (stage) GROUP BY ALL),
res AS (SELECT tour, bio_id, event_id, dep.stage, CAST(coalesce(pts, 0) AS INTEGER) AS pts FROM bs JOIN dep USING (depth)
  LEFT JOIN ptab ON ptab.stage = dep.stage AND points_type = CASE WHEN event_type = 'M1000' THEN CASE WHEN draw_size = 128 THEN 'M1000_128' ELSE 'M1000_96' END ELSE event_type END)"""
RESULTS = RESULTS.replace("GROUP BY ALL", "GROUP BY tour, bio_id, event_id")


@query("WITH " + RESULTS + " SELECT * FROM res")
def season_results(spark, d):
    return season.season_results(_resolved(spark, d), _players(spark, d))


@query("WITH " + SEM + ", " + DEPTH + ", " + RDEPTH + ", " + SIDES + f""",
lt AS (SELECT tr.*, row_number() OVER (PARTITION BY tr.tour, bio_id, tournament_id ORDER BY date DESC, coalesce(rdep.depth, 0) DESC, id DESC) AS rn
  FROM tr LEFT JOIN rdep ON rdep.round = tr.round WHERE active AND date <= DATE '{AS_OF}'),
st AS (SELECT lt.tour, bio_id, tournament_id AS event_id, CASE WHEN coalesce(won, false) THEN nxt ELSE played END AS stage, NOT coalesce(won, false) AS gone
  FROM lt JOIN sem ON sem.draw_bucket = {BUCKET} AND sem.round = lt.round WHERE rn = 1),
sg AS (SELECT st.*, depth, max(depth) OVER (PARTITION BY event_id) AS ed FROM st JOIN dep USING (stage))
SELECT tour, event_id, e.stage AS event_stage, bio_id, sg.stage, gone OR sg.depth < ed AS eliminated FROM sg JOIN dep e ON e.depth = ed""")
def season_active_status(spark, d):
    return season.active_status(_resolved(spark, d), _players(spark, d), AS_OF)


SNAP = f"""now AS (SELECT * FROM fx_rankings r WHERE snapshot_date = (SELECT max(snapshot_date) FROM fx_rankings x WHERE x.tour = r.tour AND x.snapshot_date <= DATE '{AS_OF}')),
bef AS (SELECT * FROM fx_rankings r WHERE snapshot_date = (SELECT max(snapshot_date) FROM fx_rankings x WHERE x.tour = r.tour AND x.snapshot_date <= DATE '{AS_OF}' - INTERVAL 7 DAY))"""
TABLE = RESULTS + ", " + SNAP + """,
ag AS (SELECT tour, bio_id, count(*) AS n, sum(pts) AS s FROM res GROUP BY tour, bio_id),
stab AS (SELECT p.tour, p.bio_id, coalesce(now.rank, p.bio_id) AS rank, coalesce(now.pts, 0) AS pts, coalesce(now.ytd_pts, 0) AS ytd, coalesce(bef.rank - now.rank, 0) AS rank_move,
  coalesce(n, 0) AS n_results, CAST(coalesce(s, 0) AS BIGINT) AS result_pts
  FROM fx_players p LEFT JOIN now ON now.tour = p.tour AND now.bio_id = p.bio_id LEFT JOIN bef ON bef.tour = p.tour AND bef.bio_id = p.bio_id LEFT JOIN ag ON ag.tour = p.tour AND ag.bio_id = p.bio_id)"""


@query("WITH " + TABLE + " SELECT * FROM stab")
def season_table(spark, d):
    return season.season_table(_players(spark, d), table(spark, d, "fx_rankings"), season_results(spark, d), AS_OF)


@query("WITH " + TABLE + """, mv AS (SELECT *, row_number() OVER (PARTITION BY tour ORDER BY abs(rank_move) DESC, bio_id) AS place FROM stab WHERE rank_move <> 0)
SELECT tour, CAST(place AS INTEGER) AS place, bio_id, rank, rank_move FROM mv WHERE place <= 10""")
def rank_movers(spark, d):
    return ranks.movers(season_table(spark, d))


@query("WITH " + TABLE + """, js AS (SELECT tour, bio_id, string_agg('"' || event_id || '":"' || stage || '"', ',' ORDER BY event_id) AS r FROM res GROUP BY tour, bio_id)
SELECT stab.tour, stab.bio_id, rank, pts, ytd, rank_move, '{' || coalesce(r, '') || '}' AS results FROM stab LEFT JOIN js ON js.tour = stab.tour AND js.bio_id = stab.bio_id""")
def publish_season(spark, d):
    return publish.export_season(season_table(spark, d), season_results(spark, d))


@query("WITH " + RESULTS + f""", clo AS (SELECT tour, bio_id, tournament_id AS event_id, event_type, draw_size, CASE WHEN coalesce(won, false) THEN nxt ELSE played END AS stage
  FROM tr JOIN sem ON sem.draw_bucket = {BUCKET} AND sem.round = tr.round WHERE active),
cb AS (SELECT tour, bio_id, event_id, max(event_type) AS event_type, max(draw_size) AS draw_size, max(depth) AS depth FROM clo JOIN dep USING (stage) GROUP BY tour, bio_id, event_id)
SELECT * FROM res UNION ALL
SELECT tour, bio_id, event_id, dep.stage, CAST(coalesce(pts, 0) AS INTEGER) FROM cb JOIN dep USING (depth)
  LEFT JOIN ptab ON ptab.stage = dep.stage AND points_type = CASE WHEN event_type = 'M1000' THEN CASE WHEN draw_size = 128 THEN 'M1000_128' ELSE 'M1000_96' END ELSE event_type END""")
def season_freeze(spark, d):
    flipped = table(spark, d, "fx_events").where("active").select("id")
    return season.freeze_results(season_results(spark, d), _resolved(spark, d), _players(spark, d), flipped)


@query("WITH " + SIDES + """, o AS (SELECT tr.*, row_number() OVER (PARTITION BY tour, mid ORDER BY date DESC, round DESC NULLS LAST, id DESC) AS rn FROM tr)
SELECT o.tour, o.bio_id, CAST(rn AS INTEGER) AS rn, id, date, tournament_name AS event_name, round, coalesce(p.name, '?') AS opponent, coalesce(p.country, '') AS opp_country, score, won
FROM o LEFT JOIN fx_players p ON p.tour = o.tour AND p.mid = o.opp_id WHERE rn <= 30""")
def history_recent(spark, d):
    return history.recent_matches(_plain(spark, d), _players(spark, d))


HIST = RDEPTH + ", " + SIDES + """, ev AS (SELECT tr.tour, bio_id, tournament_name AS event_name, CAST(year(date) AS INTEGER) AS year, tr.round, coalesce(won, false) AS won,
  row_number() OVER (PARTITION BY tr.tour, bio_id, tournament_name, year(date) ORDER BY depth DESC, date DESC, id DESC) AS rn FROM tr JOIN rdep ON rdep.round = tr.round),
hi AS MATERIALIZED (SELECT tour, bio_id, event_name, year, round, won FROM ev WHERE rn = 1)"""


@query("WITH " + HIST + " SELECT * FROM hi")
def history_events(spark, d):
    return history.event_history(_plain(spark, d), _players(spark, d))


@query("WITH " + HIST + """ SELECT hi.*, CASE WHEN lag(year) OVER w = year - 1 THEN lag(round) OVER w END AS last_round, CASE WHEN lag(year) OVER w = year - 1 THEN lag(won) OVER w END AS last_won
FROM hi WINDOW w AS (PARTITION BY tour, bio_id, event_name ORDER BY year)""")
def project_defending(spark, d):
    return project.defending(history_events(spark, d))


FORM = SIDES + """, fr AS (SELECT *, row_number() OVER (PARTITION BY tour, bio_id ORDER BY date DESC, id DESC) AS rn FROM tr WHERE winner_id IS NOT NULL),
fo AS (SELECT tour, bio_id, string_agg(CASE WHEN won THEN 'W' ELSE 'L' END, '' ORDER BY date, id) AS form, CAST(floor(100.0 * count(*) FILTER (won) / count(*) + 0.5) AS BIGINT) AS form_pct FROM fr WHERE rn <= 10 GROUP BY tour, bio_id)"""


@query("WITH " + FORM + " SELECT * FROM fo")
def history_form(spark, d):
    return history.form_from_sides(_plain(spark, d), _players(spark, d))


@query("WITH " + SIDES + """, o AS (SELECT tr.*, row_number() OVER (PARTITION BY tour, mid ORDER BY date DESC, round DESC NULLS LAST, id DESC) AS rn FROM tr)
SELECT o.tour, o.bio_id, CAST(rn AS INTEGER) AS rn, strftime(date, '%b %-d') || ' · ' || tournament_name || coalesce(' ' || round, '') || ' · ' || CASE WHEN won IS NULL THEN 'vs' WHEN won THEN 'def.' ELSE 'lost to' END || ' ' || coalesce(p.name, '?') || ' ' || score AS caption
FROM o LEFT JOIN fx_players p ON p.tour = o.tour AND p.mid = o.opp_id WHERE rn <= 10""")
def history_captions(spark, d):
    return history.match_captions(history_recent(spark, d))


@query("WITH " + SIDES + """, o AS (SELECT tr.*, row_number() OVER (PARTITION BY tour, mid ORDER BY date DESC, round DESC NULLS LAST, id DESC) AS rn FROM tr),
la AS (SELECT tour, bio_id, count(*) AS last_matches, count(*) FILTER (won) AS last_wins FROM o WHERE rn <= 15 GROUP BY tour, bio_id), """ + H2H + """,
vw AS (SELECT tour, a AS me, b AS them, a_wins AS mine, a_wins + b_wins AS meetings FROM hh UNION ALL SELECT tour, b, a, b_wins, a_wins + b_wins FROM hh),
pl AS (SELECT *, row_number() OVER (PARTITION BY tour, me ORDER BY meetings DESC, them) AS place FROM vw)
SELECT pl.tour, me AS bio_id, CAST(place AS INTEGER) AS place, them, meetings, mine AS my_wins, last_matches, last_wins FROM pl JOIN la ON la.tour = pl.tour AND la.bio_id = pl.me WHERE place <= 5""")
def history_drilldown(spark, d):
    return history.drilldown(history.last_sides(_plain(spark, d), _players(spark, d), 15), h2h_views(spark, d))


@query("WITH " + SIDES + " SELECT tour, bio_id, CAST(year(date) AS INTEGER) AS year, coalesce(surface, 'H') AS surface, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM tr WHERE winner_id IS NOT NULL GROUP BY ALL")
def history_surface_record(spark, d):
    return history.surface_record(_plain(spark, d), _players(spark, d))


def _stat(blob: str, name: str) -> str:
    found = "coalesce(" + ", ".join(f"CASE WHEN json_extract_string({blob}, '$.\"{k}\"') NOT IN ('', 'NA') THEN json_extract_string({blob}, '$.\"{k}\"') END" for k in C.STAT_ALIASES[name]) + ")"
    return f"CASE WHEN own IS NOT NULL AND opp IS NOT NULL THEN CAST(coalesce(trunc(try_cast({found} AS DOUBLE)), 0) AS BIGINT) ELSE 0 END"


_SETS = "list_filter(list_transform(regexp_extract_all(coalesce(score, ''), '\\d+-\\d+(?:\\(\\d+\\))?'), lambda s: {'a': CAST(regexp_extract(s, '(\\d+)-', 1) AS INTEGER), 'b': CAST(regexp_extract(s, '-(\\d+)', 1) AS INTEGER), 'tb': contains(s, '(')}), lambda x: greatest(x.a, x.b) >= 6)"
MEASURED = SIDES + f""",
m0 AS (SELECT tr.*, coalesce(won, false) AS win, {_SETS} AS sets, {_stat('own', 'bp_faced')} AS faced, {_stat('own', 'bp_saved')} AS saved, {_stat('opp', 'bp_attempts')} AS att, {_stat('opp', 'bp_converted')} AS conv,
  {_stat('own', 'svpt')} AS svpt, {_stat('own', 'first_won')} + {_stat('own', 'second_won')} AS serve_won, {_stat('own', 'aces')} AS aces, {_stat('opp', 'opp_svpt')} AS opp_svpt,
  {_stat('opp', 'first_won')} + {_stat('opp', 'second_won')} AS opp_won FROM tr),
m1 AS (SELECT *, CASE WHEN faced = 0 AND att <> 0 THEN att ELSE faced END AS bp_faced FROM m0),
ms AS (SELECT tour, bio_id, date, round, coalesce(surface, 'H') AS surf, event_type, coalesce(score <> '' AND NOT regexp_matches(upper(score), 'RET|W/O|DEF'), false) AS done,
  bp_faced, CASE WHEN saved = 0 AND bp_faced <> 0 THEN bp_faced - conv ELSE saved END AS bp_saved, svpt, serve_won, aces, opp_svpt, opp_svpt - opp_won AS opp_lost,
  len(list_filter(sets, lambda x: x.tb)) AS tb_played, len(list_filter(sets, lambda x: x.tb AND ((win AND x.a > x.b) OR (NOT win AND x.a < x.b)))) AS tb_won,
  CASE WHEN len(sets) >= coalesce(nullif(best_of, 0), CASE WHEN len(sets) >= 4 THEN 5 ELSE 3 END) THEN 1 ELSE 0 END AS dec_played, CASE WHEN win THEN 1 ELSE 0 END AS w,
  coalesce(event_type IN ({', '.join(f"'{t}'" for t in schema.TOUR_TIERS)}), false) AND NOT starts_with(coalesce(round, ''), 'Q') AS tl FROM m1)"""


def _profile_sql(source: str, keys: str, where: str, least: int = 5, tb: int = 3, dec: int = 3, surfaces: bool = False) -> str:
    r = lambda n, x, p=1, pct=True: C.ratio_sql(n, x, p, pct, "//")
    groups = f"GROUPING SETS (({keys}), ({keys}, surf))" if surfaces else keys
    also = ", coalesce(surf, 'All') AS surf" if surfaces else ""
    return f"""
gs AS (SELECT {keys}{', surf' if surfaces else ''}, count(*) AS seen, count(*) FILTER (done) AS matches, """ + ", ".join(f"CAST(sum(CASE WHEN done THEN {e} ELSE 0 END) AS BIGINT) AS {n}" for n, e in {**{c: c for c in ("svpt", "serve_won", "aces", "bp_faced", "bp_saved", "opp_svpt", "opp_lost", "tb_played", "tb_won", "dec_played")}, "dec_won": "dec_played * w", "win": "w"}.items()) + f"""
  FROM {source} WHERE {where} GROUP BY {groups}),
g2 AS (SELECT *, CAST(round(svpt / 6.5) AS BIGINT) AS sv_gms FROM gs WHERE matches >= {least} AND seen >= {least}),
pf AS (SELECT {keys}{also}, matches, {r('win', 'matches')} AS match_win_pct, {r('serve_won', 'svpt')} AS serve_pts_won_pct, {r('opp_lost', 'opp_svpt')} AS return_pts_won_pct,
  {r('(serve_won + opp_lost)', '(svpt + opp_svpt)')} AS total_pts_won_pct, {r('aces', 'sv_gms', 2, False)} AS aces_per_sv_gm, {r('bp_saved', 'bp_faced')} AS bp_saved_pct,
  CASE WHEN tb_played >= {tb} THEN {r('tb_won', 'tb_played')} END AS tb_win_pct, CASE WHEN dec_played >= {dec} THEN {r('dec_won', 'dec_played')} END AS dec_set_win_pct FROM g2)"""


def _measured(spark, d):
    return profile.measured(sides.resolve_event(_matches(spark, d), table(spark, d, "fx_events")), _players(spark, d))


YEARS = MEASURED + ", yr AS (SELECT *, CAST(year(date) AS VARCHAR) AS tag FROM ms), " + _profile_sql("yr", "tour, bio_id, tag", "tl")
ROLLING = MEASURED + ", " + _values("win", "tag, days", list(schema.WINDOWS.items())) + f", rl AS (SELECT ms.*, tag FROM ms JOIN win ON date >= DATE '{AS_OF}' - CAST(days AS INTEGER) AND date <= DATE '{AS_OF}'), " + _profile_sql("rl", "tour, bio_id, tag", "tl", surfaces=True)


@query("WITH " + YEARS + " SELECT * FROM pf")
def profile_by_year(spark, d):
    return profile.profile_by_year(_measured(spark, d))


@query("WITH " + ROLLING + " SELECT * FROM pf")
def profile_rolling_surface(spark, d):
    return profile.profile_rolling(_measured(spark, d), AS_OF)


@query("WITH " + MEASURED + ", cu AS (SELECT *, 'CURR' AS tag FROM ms), " + _profile_sql("cu", "tour, bio_id, tag", f"date BETWEEN DATE '{AS_OF}' - 14 AND DATE '{AS_OF}'", 1, 1, 1) + " SELECT * FROM pf")
def profile_current(spark, d):
    return profile.profile_current(_measured(spark, d), AS_OF)


@query("WITH " + YEARS + ", z AS (SELECT *, " + ", ".join(f"CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END AS z{k}" for k, c in enumerate(profile.METRICS)) + " FROM pf WINDOW w AS (PARTITION BY tour, tag)) SELECT tour, bio_id, tag, round((" + " + ".join(f"coalesce(z{k}, 0)" for k in range(8)) + ") / nullif(" + " + ".join(f"(CASE WHEN z{k} IS NULL THEN 0 ELSE 1 END)" for k in range(8)) + ", 0), 4) AS composite_z FROM z")
def profile_composite_z(spark, d):
    return profile.composite_z(profile_by_year(spark, d), ["tour", "tag"]).select("tour", "bio_id", "tag", F.round("composite_z", 4).alias("composite_z"))


@query("WITH " + YEARS + " SELECT a.tour, a.bio_id, " + ", ".join(f"round(a.{c} - b.{c}, 2) AS {c}_delta" for c in profile.METRICS) + " FROM pf a JOIN pf b ON a.tour = b.tour AND a.bio_id = b.bio_id WHERE a.tag = '1997' AND b.tag = '1996'")
def profile_period_delta(spark, d):
    return profile.period_delta(profile_by_year(spark, d), "1997", "1996", ["tour", "bio_id"])


@query("WITH " + YEARS + " SELECT tag, CAST(row_number() OVER (ORDER BY CASE WHEN try_cast(tag AS INTEGER) IS NOT NULL THEN -try_cast(tag AS INTEGER) ELSE 1 END, tag) AS INTEGER) AS place FROM (SELECT DISTINCT tag FROM pf) t")
def profile_periods(spark, d):
    return profile.period_index(profile_by_year(spark, d))


@query("WITH " + ROLLING + " SELECT * FROM pf WHERE tour = 'atp' AND tag = 'T12M' AND surf = 'H' AND matches >= 6")
def profile_filtered(spark, d):
    return profile.filter_metrics(profile_rolling_surface(spark, d), "atp", "T12M", "H", 6)
