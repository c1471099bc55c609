"""Sharding through fixed virtual slots, by DataFrame functions only.

Records hash into a fixed number of slots. Bytes and rows are summed per slot, and a small versioned map, one row
per slot, leads slots to shards. The map is a table, one folder a version; old versions stay. The first version is
made from nothing: largest slots first, each to the lightest shard. Later runs read the newest version and edit it:
slots move from the heaviest shard to the lightest only while sizes are too far apart, all others stay where they
are. Growth moves only slots that go to the new shard. The map has as many rows as there are slots (a parameter),
whatever the size of the corpus, so the driver may hold it and joins may broadcast it.

Null text has no bytes; null ids hash like a value of their own. Repeated rows fall in one slot and keep places of
their own. An empty table gives an empty result and a map over empty slots.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left, bisect_right, insort

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import delete_at_end, materialise, scratch

SLOTS = 8192
OVERHEAD = 16
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long"


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot."""
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
    )
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def balanced_map(sizes: list[tuple[int, int, int]], shards: int, slots: int = SLOTS, version: int = 1) -> list[tuple[int, int, int, int, int]]:
    """Map rows from (slot, bytes, rows): the largest slots first, each to the shard with the fewest bytes."""
    held = {slot: (size, rows) for slot, size, rows in sizes}
    heap = [(0, shard) for shard in range(shards)]
    out = []
    for slot in sorted(range(slots), key=lambda s: (-held.get(s, (0, 0))[0], s)):
        size, rows = held.get(slot, (0, 0))
        total, shard = heapq.heappop(heap)
        heapq.heappush(heap, (total + size, shard))
        out.append((version, slot, shard, size, rows))
    return out


def grown_map(rows: list[tuple[int, int, int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """The next version, with shard number `shards` added: heaviest shards give it slots until it has its share."""
    share = sum(r[3] for r in rows) / (shards + 1)
    totals = [0] * (shards + 1)
    for r in rows:
        totals[r[2]] += r[3]
    moved = {}
    for _, slot, shard, size, _ in sorted(rows, key=lambda r: (-r[3], r[1])):
        if size and totals[shard] - size >= share * 0.995 and totals[shards] + size <= share * 1.005:
            totals[shard] -= size
            totals[shards] += size
            moved[slot] = shards
    return [(version + 1, slot, moved.get(slot, shard), size, n) for version, slot, shard, size, n in rows]


def edited_map(
    rows: list[tuple[int, int, int, int, int]], sizes: list[tuple[int, int, int]], shards: int, apart: float = 0.005
) -> list[tuple[int, int, int, int, int]]:
    """The next version for the sizes of now; the same rows where neither sizes nor shards changed.

    Slots of shards that are no more go to the lightest ones. Then one slot at a time goes from the heaviest shard to
    the lightest, until all are within the share `apart` of the mean or no move brings them closer.
    """
    held = {slot: (size, n) for slot, size, n in sizes}
    place = {slot: shard for _, slot, shard, _, _ in rows}
    totals = [0] * shards
    inside: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in place.items():
        size = held.get(slot, (0, 0))[0]
        if shard < shards:
            totals[shard] += size
            insort(inside[shard], (size, slot))
        else:
            homeless.append((size, slot))

    def put(size: int, slot: int, shard: int) -> None:
        place[slot] = shard
        totals[shard] += size
        insort(inside[shard], (size, slot))

    for size, slot in sorted(homeless, reverse=True):
        put(size, slot, min(range(shards), key=totals.__getitem__))
    mean = sum(totals) / shards
    while True:
        heavy, light = max(range(shards), key=totals.__getitem__), min(range(shards), key=totals.__getitem__)
        gap = totals[heavy] - totals[light]
        if totals[heavy] <= mean * (1 + apart) and totals[light] >= mean * (1 - apart):
            break
        # the largest slot of at most half the gap, or else the smallest above: any below the gap brings the two closer
        k = bisect_right(inside[heavy], (gap // 2, len(place))) - 1
        if k < 0 or not inside[heavy][k][0]:
            k += 1
            k = max(k, bisect_left(inside[heavy], (1, -1)))
        if k >= len(inside[heavy]) or inside[heavy][k][0] >= gap:
            break
        size, slot = inside[heavy].pop(k)
        totals[heavy] -= size
        put(size, slot, light)
    out = [(version, slot, place[slot], *held.get(slot, (0, 0))) for version, slot, _, _, _ in rows]
    return rows if out == rows else [(version + 1, *rest) for version, *rest in out]


def map_frame(spark: SparkSession, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, MAP_SCHEMA)


def new_map_path(spark: SparkSession) -> str:
    """A location of its own in the shared folder, for a map that is not to outlive the session."""
    return delete_at_end(spark, f"{scratch(spark)}/slot-map-{uuid.uuid4().hex}")


def slot_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map in path, the newest if none is named; no rows where there is none."""
    try:
        versions = spark.read.schema(MAP_SCHEMA).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return map_frame(spark, [])
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "rows")


def store_map(spark: SparkSession, path: str, rows: list[tuple[int, int, int, int, int]]) -> None:
    """Write rows as a version of the map. One file is renamed into place, so readers see all of a version or none; a version that is there is never replaced."""
    map_frame(spark, rows).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={rows[0][0]}")


def _rows(df: DataFrame) -> list[tuple[int, int, int, int, int]]:
    return [tuple(r) for r in df.orderBy("virtual_slot").collect()]


def keep_map(spark: SparkSession, path: str, sizes: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> int:
    """The version of the map in path that is right for the sizes; it is made or edited where there is none or it is not."""
    old = _rows(slot_map(spark, path))
    if old and len(old) != slots:
        raise ValueError(f"the map in {path} has {len(old)} slots, not {slots}")
    rows = edited_map(old, sizes, shards) if old else balanced_map(sizes, shards, slots)
    if rows != old:
        store_map(spark, path, rows)
    return rows[0][0]


def grow(spark: SparkSession, path: str, shards: int) -> int:
    """Add shard number `shards` to the newest map in path; the version that has it."""
    rows = grown_map(_rows(slot_map(spark, path)), shards)
    store_map(spark, path, rows)
    return rows[0][0]


def shard(
    docs: DataFrame, shards: int = 40, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (place in the shard, gapless from 0), grown_shard (null), virtual_slot, map_version.

    map_path: where the versions of the map are kept; a new location where none is given.
    """
    spark = docs.sparkSession
    map_path = map_path or new_map_path(spark)
    placed = materialise(with_slots(docs, id_col, text_col, slots), "slots")
    version = keep_map(spark, map_path, [tuple(r) for r in slot_sizes(placed).collect()], shards, slots)
    upto = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    lookup = slot_map(spark, map_path, version).withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
    lookup = lookup.select(F.col("virtual_slot").alias("vs"), "shard", "before", F.col("version").alias("map_version"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    placed = placed.withColumn("inside", F.row_number().over(inside) - 1)
    # one row per slot: at most `slots` rows
    joined = placed.join(F.broadcast(lookup), placed.virtual_slot == lookup.vs)
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
