"""One small session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def compare(spark, queries, oracle, names, sf=SF):
    """Spark rows against the rows of DuckDB, without order."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

    def text(v):
        if v is None:
            return "~"
        return f"{float(v):.6g}" if type(v).__name__ in ("float", "Decimal") else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") and hasattr(v, "hour") else str(v)

    def canon(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)

    for name in names:
        df = queries[name](spark, sf)
        cursor = con.execute(oracle[name])
        want = canon(cursor.fetchall(), [c[0] for c in cursor.description])
        assert canon([tuple(r) for r in df.collect()], df.columns) == want, name
