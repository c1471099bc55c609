"""What is shuffled and landed: narrow rows instead of texts, once instead of again, on the small tables."""

from __future__ import annotations

import os
import random
import re
from pathlib import Path

import pytest
from conftest import SF, compare
from pyspark.sql import functions as F

from matchframe.operators import merge, project
from matchframe.plans import core, exports, more
from matchframe.streaming import streams


def plan(df) -> list[str]:
    """The lines of the plan as it would run, from the result down."""
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def shuffles(df) -> int:
    return sum("Exchange hashpartitioning" in line for line in plan(df))


def test_pages_are_made_where_their_narrow_rows_meet(spark):
    lines = plan(more.match_pages(spark, SF))
    exchanges = [k for k, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert max(k for k, line in enumerate(lines) if "collect_list" in line) < min(exchanges)
    assert len(exchanges) <= 3  # lineitem, orders, and the rows by page


def test_pages_land_packed_one_a_file(spark):
    pages = more.match_pages(spark, SF).select("tour", "value")
    folder = exports._landed(spark, pages, ["tour"], "test-pages")
    files = list(Path(folder.removeprefix("file:")).rglob("part-*"))
    assert len(files) == pages.count() and all(f.name.endswith(".gz") for f in files)


def test_matches_of_line_numbers_of_two_digits(spark, tmp_path):
    """An id may then be of two orders, and of its rows only one counts."""
    for f in os.listdir(SF):
        if f != "lineitem.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn("l_linenumber", F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linenumber") + 10).otherwise(F.col("l_linenumber"))).coalesce(1).write.parquet(str(tmp_path / "written"))
    os.symlink(next((tmp_path / "written").glob("part-*")), tmp_path / "lineitem.parquet")
    sql = {"sides_all": core.ORACLE_SQL["sides_all"]}
    compare(spark, core.QUERIES, sql, ["sides_all"], str(tmp_path))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["history_recent", "history_captions", "publish_recent"])
def test_opponents_are_looked_up_for_the_last_matches_alone(spark, no_broadcast, name):
    lines = plan(core.QUERIES[name](spark, SF))
    lookup = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line and "o_mid" in line)
    assert any("Window [row_number" in line and "mid#" in line for line in lines[lookup:])
    # sides and players are dealt out by competitor; the ranks need no other shuffle
    assert sum(bool(re.search(r"Exchange hashpartitioning\(tour#\d+, mid#", line)) for line in lines) == 2


def test_drilldown_needs_no_opponents(spark, no_broadcast):
    assert not any("o_mid" in line for line in plan(core.QUERIES["history_drilldown"](spark, SF)))


def test_chart_without_all_pairs(spark):
    draw = random.Random(3)
    players = spark.createDataFrame([(k, draw.randrange(1, 60), draw.choice(["W", "F", "R32", "none", None])) for k in range(400)], "id long, rank int, last_result string")
    events = spark.createDataFrame([(f"e{k}", draw.choice(["GS", "M1000", "W250", None]), draw.random() < 0.5) for k in range(30)], "event_id string, type string, live boolean")
    plain = project.chart_rows(project.points_at_stake(players, events))
    assert sorted(map(str, project.top_chart(players, events).collect())) == sorted(map(str, plain.collect()))
    # the events are joined last, to the best of each kind
    lines = plan(core.QUERIES["project_chart"](spark, SF))
    assert any("Window" in line for line in lines[next(k for k, line in enumerate(lines) if "Join" in line) :])


@pytest.mark.parametrize("name", ["project_expected_points", "project_stakes"])
def test_players_meet_events_by_slices(spark, no_broadcast, name):
    """The join of players and events is dealt out by kind and slice, not by some ten kinds alone, and stakes are worked out before it."""
    lines = plan(core.QUERIES[name](spark, SF))
    join = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)
    assert "_slice" in lines[join] and not any("CASE WHEN" in line for line in lines[:join])


@pytest.mark.parametrize("name", ["merge_insert_ignore", "merge_patch_late", "merge_upsert"])
def test_merges_shuffle_rows_by_id_once(spark, no_broadcast, name):
    """Lines and orders of base and batch, and both by id before any statistics; the merge itself needs none."""
    df = core.QUERIES[name](spark, SF)
    lines = [line for line in plan(df) if "Exchange hashpartitioning" in line]
    assert sum("hashpartitioning(id#" in line for line in lines) == 2 and len(lines) == 6


def test_first_of_new_keys_with_null_keys(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "id string, v int, ord long")
    base, batch = frame(("a", 1, 0), ("a", 2, 0), (None, 3, 0)), frame(("a", 4, 1), ("b", 6, 2), ("b", 5, 1), (None, 8, 2), (None, 7, 1))
    got = merge.insert_ignore(base.drop("ord"), batch, ["id"], "ord")
    assert sorted(map(str, got.collect())) == sorted(map(str, frame(("a", 1, 0), ("a", 2, 0), (None, 3, 0), ("b", 5, 0), (None, 7, 0)).drop("ord").collect()))


def test_a_merge_by_part_is_one_shuffle_and_leaves_nothing_staged(spark, tmp_path):
    kind = "id string, round string, winner_id long, score string, fetched_at string, stat_p1 string, stat_p2 string"
    rows = spark.createDataFrame([(str(i), "F", None, "", "t0", None, None) for i in range(8)], kind)
    part = lambda: F.pmod(F.col("id").cast("long"), F.lit(4)).cast("long")
    table, ledger = str(tmp_path / "table"), str(tmp_path / "ledger")
    streams.create_table(rows, table, part, ledger)
    batch = spark.createDataFrame([("1", "SF", 7, "6-1", "t1", "a", None, 1), ("9", "R1", None, "", "t3", None, None, 3)], kind + ", ord long")
    assert streams.merge_batch(batch, 0, batch.columns[:-1], table, "ord", part, ledger)
    assert not (tmp_path / "ledger-staged" / "0").exists()
    held, landed = (df.withColumn("part", part()) for df in (rows, batch))
    lines = [line for line in plan(merge.patch_late(held, landed, "ord", by="part")) if "Exchange" in line]
    assert len(lines) == 1 and "rangepartitioning" in lines[0]
    assert {r.id: r.winner_id for r in spark.read.parquet(table).collect()} == {str(i): 7 if i == 1 else None for i in [*range(8), 9]}
