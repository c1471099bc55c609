"""Shared pieces of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster. A folder of the driver's machine is taken only where that is the whole cluster and the session names none, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return there or _own_folder()


@cache
def _own_folder() -> str:
    there = tempfile.mkdtemp(prefix="spark-checkpoint-")
    atexit.register(shutil.rmtree, there, ignore_errors=True)
    return there


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs one stage.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> str:
    """Have path deleted when the driver's JVM ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.getParent())
    files.deleteOnExit(hadoop)
    return path


def bounded_batches(spark: SparkSession) -> None:
    """Batches of whole texts go to Python by at most 4 MB, whatever the length of a text, so that neither side of the pipe fills.

    A session that has a bound of its own keeps it. The bound is one for all operators, so it does not matter which set it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64MB"):
        spark.conf.set(key, "4m")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text has the remainder; a null id is held out, so nothing is learned from it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == F.lit(remainder), F.lit(True))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Column lists of each batch."""
    for batch in batches:
        yield [column.to_pylist() for column in batch.columns]


def parts_of(batches: Iterator[pa.RecordBatch], text: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts whose texts (column `text`) have about `size` bytes, one row at least, so that lists made of them stay small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) // size
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers live on from stage to stage


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """Rows whose hash of key falls under a share that leaves about `bound` of them; all rows where there are fewer."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(1_000_000 * bound / total))
