"""Domain tables derived from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-07-03"
BASE = ("customer", "nation", "supplier", "orders", "lineitem", "events")


def _blob(k: str) -> str:
    """JSON text of one side's counters; key sets differ by l_partkey, as feeds differ."""
    n = {
        "svpt": f"(40 + q + {k} % 20)", "fi": f"(25 + {k} % 15)", "fw": f"(15 + {k} % 11)", "sw": f"(8 + {k} % 7)", "df": f"({k} % 4)",
        "bf": f"({k} % 8)", "bs": f"(CASE WHEN {k} % 8 > 2 THEN {k} % 8 - {k} % 3 ELSE {k} % 8 END)",
    }
    ace = f"CASE WHEN l_partkey % 19 = 0 THEN 'NA' ELSE CAST({k} % 9 AS STRING) END"
    text = lambda x: f"CAST({x} AS STRING)"

    def keys(*names: str) -> str:
        values = [text(n["svpt"]), text(n["fi"]), text(n["fw"]), text(n["sw"]), ace, text(n["df"]), text(n["bf"]), text(n["bs"])]
        return "'{' || " + " || ',' || ".join(f"'\"{name}\":\"' || {value} || '\"'" for name, value in zip(names, values)) + " || '}'"

    first = keys("firstServeOf", "firstServe", "winningOnFirstServe", "winningOnSecondServe", "aces", "doubleFaults", "breakPointFaced", "breakPointSaved")
    second = keys("svpt", "1stIn", "1stWon", "2ndWon", "ace", "df", "bpFaced", "bpSaved")
    third = keys("totalServePointsAttempted", "firstServeIn", "firstServeWon", "secondServeWon", "aces", "doubleFaults")
    third = third[: -len(" || '}'")] + f" || ',\"breakPointsConverted\":\"' || {text(f'{k} % 3')} || '\",\"breakPointsConvertedOf\":\"' || {text(f'{k} % 6 + 2')} || '\"}}'"
    return f"CASE l_partkey % 3 WHEN 0 THEN {first} WHEN 1 THEN {second} ELSE {third} END"


#: A row of fx_raw without its statistics, and the statistics, which need l_partkey, l_suppkey and q of it.
_ROW = """CAST(l_orderkey * 10 + l_linenumber AS STRING) AS id, CASE WHEN o_custkey % 2 = 0 THEN 'atp' ELSE 'wta' END AS tour,
    CAST(CASE WHEN o_custkey % 2 = 0 THEN 20000 ELSE 30000 END + l_suppkey AS INT) AS tournament_api_id,
    'Event ' || CAST(l_suppkey AS STRING) AS tournament_name, CAST(l_shipdate AS DATE) AS date,
    CAST(100000 + o_custkey AS BIGINT) AS p1_id,
    CASE WHEN l_partkey % 50 = 49 THEN CAST(900000000 + o_custkey AS BIGINT)  -- a competitor that no catalog row has
      ELSE CAST(100000 + (o_custkey + 2 * (1 + l_partkey % 7)) % (SELECT count(*) FROM customer) AS BIGINT) END AS p2_id,
    CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_quantity = 50 THEN 'Q1' WHEN l_linenumber = 1 THEN 'First' WHEN l_linenumber = 2 THEN 'Second'
      WHEN l_linenumber = 3 THEN 'Third' WHEN l_linenumber = 4 THEN 'Fourth' WHEN l_linenumber = 5 THEN '1/4' WHEN l_linenumber = 6 THEN '1/2' ELSE 'Final' END AS round,
    CASE l_partkey % 5 WHEN 2 THEN 'C' WHEN 3 THEN 'G' WHEN 4 THEN NULL ELSE 'H' END AS surface,
    CASE CAST(floor(l_quantity) AS BIGINT) % 6 WHEN 0 THEN '6-4 6-3' WHEN 1 THEN '7-6(5) 4-6 6-3' WHEN 2 THEN '6-7(3) 7-5 7-6(8)' WHEN 3 THEN '6-3 3-6 7-5'
      WHEN 4 THEN '4-6 6-4 6-7(4) 7-6(2) 6-4' ELSE CASE WHEN l_partkey % 2 = 0 THEN '6-2 2-1 RET' ELSE 'W/O' END END AS score,
    CAST(CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 6 = 4 THEN 5 WHEN l_partkey % 2 = 0 THEN 3 END AS INT) AS best_of,
    l_returnflag, l_linestatus, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT) AS q, l_extendedprice"""
_STATS = (
    f"CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE {_blob('l_partkey')} END AS stat_p1",
    f"CASE WHEN l_partkey % 13 = 0 OR l_partkey % 17 = 0 THEN NULL ELSE {_blob('(l_partkey + 3 * l_suppkey + 11)')} END AS stat_p2",
)
_WINNER = "CASE WHEN l_returnflag = 'A' THEN p1_id WHEN l_returnflag = 'R' THEN p2_id WHEN l_linestatus = 'F' THEN p1_id WHEN q % 10 = 0 THEN NULL ELSE p2_id END AS winner_id"
#: Of rows with one id the first counts.
_FIRST = "ORDER BY date, l_partkey, l_suppkey, q, l_extendedprice"

SQL = {
    "fx_players": """
SELECT CAST(100000 + c_custkey AS BIGINT) AS mid, CASE WHEN c_custkey % 2 = 0 THEN 'atp' ELSE 'wta' END AS tour,
  CAST(floor(c_custkey / 2) AS INT) + 1 AS bio_id, c_name AS name, n_name AS country, CAST(18 + c_custkey % 20 AS INT) AS age,
  CAST(50 + c_custkey % 40 AS INT) AS surf_h, CAST(45 + c_custkey % 45 AS INT) AS surf_c, CAST(48 + c_custkey % 35 AS INT) AS surf_g,
  c_custkey % 23 = 0 AS inj
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fx_events": """
SELECT 'ev' || CAST(s_suppkey AS STRING) AS id, s_name AS name,
  CASE s_suppkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'atp' ELSE 'wta' END AS tour,
  CASE s_suppkey % 10 WHEN 0 THEN 'GS' WHEN 1 THEN 'M1000' WHEN 2 THEN 'W1000' WHEN 3 THEN 'M500' WHEN 4 THEN 'W500'
    WHEN 5 THEN 'M250' WHEN 6 THEN 'W250' WHEN 7 THEN 'ATPFinals' WHEN 8 THEN 'W125' ELSE NULL END AS type,
  CASE s_suppkey % 5 WHEN 0 THEN 128 WHEN 1 THEN 96 WHEN 2 THEN 64 WHEN 3 THEN 32 ELSE 56 END AS draw_size,
  s_suppkey % 8 = 3 AS active,
  CASE WHEN s_suppkey % 3 <> 2 AND s_suppkey % 7 <> 6 THEN CAST(20000 + s_suppkey AS INT) END AS api_id_atp,
  CASE WHEN s_suppkey % 3 <> 1 AND s_suppkey % 7 <> 6 THEN CAST(30000 + s_suppkey AS INT) END AS api_id_wta
FROM supplier""",
    "fx_raw": f"""
SELECT *, {_STATS[0]},
  {_STATS[1]}
FROM (
  SELECT {_ROW}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS r""",
    "fx_matches": f"""
SELECT id, tour, tournament_api_id, tournament_name, date, p1_id, p2_id, round, surface, score, best_of, stat_p1, stat_p2, l_linestatus,
  {_WINNER}
FROM (SELECT *, row_number() OVER (PARTITION BY id {_FIRST}) AS rn FROM fx_raw) AS d WHERE rn = 1""",
    "fx_resolved": """
SELECT m.*, e.id AS tournament_id, e.name AS event_name, e.type AS event_type, e.draw_size, e.active
FROM fx_matches m LEFT JOIN (
  SELECT 'atp' AS et, api_id_atp AS api, id, name, type, draw_size, active FROM fx_events WHERE api_id_atp IS NOT NULL
  UNION ALL SELECT 'wta', api_id_wta, id, name, type, draw_size, active FROM fx_events WHERE api_id_wta IS NOT NULL) e
ON m.tour = e.et AND m.tournament_api_id = e.api""",
    "fx_rankings": """
SELECT tour, snapshot_date, bio_id, CAST(row_number() OVER (PARTITION BY tour, snapshot_date ORDER BY pts DESC, bio_id) AS INT) AS rank, pts, CAST(floor(pts / 2) AS INT) AS ytd_pts
FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'atp' ELSE 'wta' END AS tour, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date,
    CAST(floor(o_custkey / 2) AS INT) + 1 AS bio_id, CAST(max(floor(o_totalprice / 100)) AS INT) AS pts
  FROM orders GROUP BY 1, 2, 3) AS r""",
    "fx_log": """
SELECT CAST(event_id AS BIGINT) AS id, ts AS fetched_at, event_type || '/' || CAST(user_id % 10 AS STRING) AS endpoint,
  CAST(CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 429 ELSE 500 END AS INT) AS http_status,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) % 50 END AS INT) AS rows_returned, CAST(floor(value * 10) AS INT) AS ms_elapsed
FROM events""",
}
#: What stands after a table is built from it.
_NEEDS = {name: [t for t in SQL if t != name and re.search(rf"\b{t}\b", sql)] for name, sql in SQL.items()}


def needed(sql: str) -> list[str]:
    """Derived tables that a statement needs, in an order in which they can be made."""
    out: list[str] = []

    def add(name: str) -> None:
        for t in _NEEDS[name]:
            add(t)
        if name not in out:
            out.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    return out


def with_tables(sql: str) -> str:
    """The statement with the derived tables it needs as common table expressions, for the oracle."""
    sql = sql.strip()
    ctes = [f"{t} AS ({SQL[t]})" for t in needed(sql)]
    if not ctes:
        return sql
    if sql[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    if name == "fx_matches":
        columns = "id, tour, tournament_api_id, tournament_name, date, p1_id, p2_id, round, surface, score, best_of, stat_p1, stat_p2, l_linestatus, winner_id"
        return with_stats(match_rows(spark, sf_dir)).select(*columns.split(", "))
    return _run(spark, sf_dir, with_tables(f"SELECT * FROM {name}"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_raw without its statistics, and with l_orderkey."""
    return _run(spark, sf_dir, f"SELECT l_orderkey, {_ROW} FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_matches without its statistics, but with what they need, so that narrow rows can be dealt out before with_stats.

    Where line numbers have one digit, an id is of one order: its rows lie together after the join with the orders and
    are not dealt out again.
    """
    odd = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber IS NULL OR l_linenumber NOT BETWEEN 0 AND 9")  # told by the files' statistics
    own = "l_orderkey, id" if odd.isEmpty() else "id"
    ranked = spark.sql(f"SELECT *, row_number() OVER (PARTITION BY {own} {_FIRST}) AS rn FROM {{rows}}", rows=raw_rows(spark, sf_dir))
    return ranked.where("rn = 1").selectExpr("* EXCEPT (rn, l_orderkey, l_returnflag, l_extendedprice)", _WINNER)


def with_stats(rows: DataFrame) -> DataFrame:
    """rows with stat_p1 and stat_p2, the JSON texts of their counters."""
    return rows.selectExpr("*", *_STATS)


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement. The given tables are handed to it as frames, so no view stays in the session."""
    sql, frames = sql.replace("{", "{{").replace("}", "}}"), {}
    for t in BASE:
        if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)
