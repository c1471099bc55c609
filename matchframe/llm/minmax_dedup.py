"""Near-duplicates by min-max hashing.

Every permutation of the shingles' hashes gives two values of a signature, its minimum and its maximum, so 128
permutations make 256 values, at half the hash evaluations of minima alone; the share of equal values is an unbiased
estimate of the Jaccard similarity, of lower variance than that of as many independent minima. 51 bands of 5 values
put two sets of similarity 0.8 in one bucket with probability 1 - (1 - 0.8^5)^51, all but 2 in 10^9; pairs that meet
are compared by all values of their signatures, then by popcounts of parity bitmaps, which never exceed what the sets
differ by and so rule out no link, and those that may be similar by their whole sets.

Equal sets are one node, and rows of one id are one node. First neighbours by hash in the buckets of a few bands are
compared, which joins most of a large group of near copies; then neighbours of different components in all buckets;
then, in buckets with several components left, all sets of different components, inside the task: pairs leave it only where signatures agree
and bitmaps do not rule them out, first for each set the most alike in a bucket, then, once these are linked, all. Of such buckets those with more than `crowd`
rows are split by every other band (a pair of similarity 0.8 shares 17 of the 51 on average, and only its own with
2 in 10^9).

Null and empty texts have no shingles and are linked with nothing. A text of fewer words than a shingle is one shingle.
A null id is never a node: its row gets the component of its set and is kept. An empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, parts_of
from .simhash_dedup import ParityMaps, components, confirmed, meeting, pairs_of, parity_map, set_key, shared_rows, shingle_sets, text_hash, whole_groups, whole_tables

WIDTH, PERMUTATIONS, BANDS, ROWS = 4, 128, 51, 5
#: Equal values of the 256 below which a pair is not looked at further: a pair of similarity 0.8 has 205 on average with a deviation of 6.4 at most.
LEAST_EQUAL = 165
#: Bands whose neighbours are compared first; what they join is left out of later comparisons.
FIRST_BANDS = 6
#: Rows of a bucket beyond which it is split: up to there a task compares all sets of different components, beyond it the rows go to 50 smaller buckets each.
CROWD = 20_000
_DRAW = np.random.Generator(np.random.PCG64(20))
_TIMES = _DRAW.integers(1 << 62, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_SLICE = 1 << 15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum and maximum of each set under each permutation, a row of 256 values for each set; zeros for an empty one."""
    out = np.zeros((len(sets), 2 * PERMUTATIONS), np.uint64)
    sizes = np.array(list(map(len, sets)), np.int64)
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[full])
    # sets in slices that stay near the processor; one large set is a slice of its own
    part = ends // _SLICE
    for low, high in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right"))):
        some = full[low:high]
        hashes = np.concatenate([sets[k] for k in some])
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        for k in range(PERMUTATIONS):
            moved = hashes * _TIMES[k] + _PLUS[k]
            out[some, 2 * k] = np.minimum.reduceat(moved, starts)
            out[some, 2 * k + 1] = np.maximum.reduceat(moved, starts)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """One hash for each band of a signature; minimum and maximum of a permutation are in different bands."""
    spread = np.concatenate([values[:, 0::2], values[:, 1::2]], axis=1)
    out = np.empty((len(values), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(values), b + 1, np.uint64)
        for k in range(ROWS):
            h = _mix(h * np.uint64(0xBF58476D1CE4E5B9) + spread[:, b * ROWS + k])
        out[:, b] = h
    return out.view(np.int64)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), key (of the set), n (its size), sig (a byte of each value of the signature), bits (the set's parity map), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 2):
            sets = shingle_sets(batch.column(2), WIDTH)
            values = signatures(sets)
            short = (_mix(values) >> np.uint64(56)).astype(np.uint8)
            hashes = pa.array(bands(values).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(set_key, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([row.tobytes() for row in short], pa.binary()), pa.array(map(parity_map, sets), pa.binary()), lists],
                ["doc_id", "th", "key", "n", "sig", "bits", "bands"],
            )

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return columns.select("doc_id", text_hash(), "text").mapInArrow(run, "doc_id long, th long, key long, n long, sig binary, bits binary, bands array<long>")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of different components next to one another in a bucket."""
    for h, key, n, label in whole_groups(batches):
        low, high = np.minimum(n[1:], n[:-1]), np.maximum(n[1:], n[:-1])
        at = np.flatnonzero((h[1:] == h[:-1]) & (5 * low >= 4 * high) & (label[1:] != label[:-1]))
        pairs = np.unique(np.stack([key[at], key[at + 1]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=0)), pa.array(pairs.max(axis=0))], ["u", "v"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v, equal: the pairs whose signatures have LEAST_EQUAL equal values."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for k in (2, 3))
        equal = (x == y).sum(axis=1)
        pairs = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal.astype(np.int64))], ["u", "v", "equal"])
        yield pairs.filter(pa.array(equal >= LEAST_EQUAL))


def _across(nearest: bool):
    """Pairs of different components in a bucket whose signatures agree and whose parity maps do not rule them out: all, or for each set the most alike in each bucket. Rows come by bucket and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_tables(batches):
            h, n, key, label = (rows.column(k).to_numpy() for k in range(4))
            sig = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)
            maps, left, right = ParityMaps(rows.column(5)), [], []
            best, who = np.full(len(h), -1), np.full(len(h), -1)
            for i, j in meeting(h, n, label):
                equal = (sig[i] == sig[j]).sum(axis=1)
                i, j, equal = (x[equal >= LEAST_EQUAL] for x in (i, j, equal))
                able = 9 * maps.differences(i, j) <= n[i] + n[j]  # sets of similarity 0.8 or more differ in a ninth of their shingles at most
                i, j, equal = i[able], j[able], equal[able]
                if not nearest:
                    left.append(key[i])
                    right.append(key[j])
                    continue
                for a, b in ((i, j), (j, i)):
                    more = equal > best[a]
                    best[a[more]], who[a[more]] = equal[more], b[more]
            if nearest:
                at = np.flatnonzero(who >= 0)
                left, right = [key[at]], [key[who[at]]]
            yield pairs_of(left, right)

    return run


def _merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """labels (key, label) with the groups of each pair of keys made one. The graph is one of labels, so it is as small as what is new."""
    end = lambda name: labels.select(F.col("key").alias(name), F.col("label").alias(f"{name}l"))
    edges = pairs.join(end("u"), "u").join(end("v"), "v").select(F.col("ul").alias("u"), F.col("vl").alias("v"))
    named = components(edges.where("u <> v")).select(F.col("u").alias("old"), "component")
    return materialise(labels.join(named, F.col("label") == F.col("old"), "left").select("key", F.coalesce("component", "label").alias("label")), "labels")


def _mixed(rows: DataFrame) -> DataFrame:
    """h, n, key, label, size: the rows of buckets that hold sets of several components."""
    several = rows.groupBy(F.col("h").alias("hm")).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    return rows.join(several, F.col("h") == F.col("hm")).select("h", "n", "key", "label", "size")


def _near(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """u, v, equal: neighbours in the buckets of rows (h, n, key, label) whose signatures agree."""
    sig = lambda name: distinct.select(F.col("key").alias(name), F.col("sig").alias(f"{name}s"))
    near = rows.select("h", "key", "n", "label").repartition("h").sortWithinPartitions("h", "key").mapInArrow(_neighbours, "u long, v long").distinct()
    near = near.join(sig("u"), "u").join(sig("v"), "v").select("u", "v", "us", "vs").mapInArrow(_alike, "u long, v long, equal long")
    return materialise(near, "pairs")


def groups(docs: DataFrame, distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """key, label: the same label for keys that pairs of similarity 0.8 or more lead to from one another."""
    every = distinct.select("n", "key", F.explode("bands").alias("h")).select("h", "n", "key")
    shared = every.repartition("h").sortWithinPartitions("h").mapInArrow(shared_rows, "h long, n long, key long")
    shared = materialise(shared, "shared-buckets")
    # neighbours of a few bands first, and of each set the most similar one, so that few sets are moved for a large group
    some = distinct.select(F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("h"), "n", "key", F.col("key").alias("label"))
    near = _near(some, distinct)
    ends = near.select(F.col("u").alias("key"), F.struct("equal", "u", "v").alias("p")).union(near.select("v", F.struct("equal", "u", "v")))
    best = materialise(ends.groupBy("key").agg(F.max("p").alias("p")).select("p.u", "p.v").distinct(), "best-pairs")
    labels = _merged(distinct.select("key", F.col("key").alias("label")), confirmed(docs, best, distinct, WIDTH))
    # then neighbours in all buckets that are still apart
    mix = lambda labels: materialise(_mixed(shared.join(labels, "key").select("h", "n", "key", "label")), "mixed-buckets")
    rest = _near(mix(labels), distinct)
    tried = materialise(best.union(rest.select("u", "v")), "tried")
    fresh = rest.join(best, ["u", "v"], "left_anti").select("u", "v")
    labels = _merged(labels, confirmed(docs, materialise(fresh, "pairs"), distinct, WIDTH))
    # then all that is still apart in a bucket: for each set the most alike first, so that a large group does not give pairs by the square of its size
    for nearest in (True, False):
        mixed = mix(labels)
        full = mixed.where(F.col("size") > crowd)
        if not full.isEmpty():
            again = full.join(distinct.select("key", "bands"), "key").select(F.explode(F.filter("bands", lambda b: b != F.col("h"))).alias("b"), "h", "n", "key", "label")
            parts = materialise(again.select(F.xxhash64("h", "b").alias("h"), "n", "key", "label"), "split-buckets")
            mixed = mixed.where(F.col("size") <= crowd).union(_mixed(parts))
        met = mixed.join(distinct.select("key", "sig", "bits"), "key").select("h", "n", "key", "label", "sig", "bits")
        late = materialise(met.repartition("h").sortWithinPartitions("h", "n", "key").mapInArrow(_across(nearest), "u long, v long").distinct(), "pairs")
        fresh = materialise(late.join(tried, ["u", "v"], "left_anti"), "pairs")
        if late.isEmpty():  # no two sets of different groups are alike enough
            break
        tried = tried.union(fresh)
        labels = _merged(labels, confirmed(docs, fresh, distinct, WIDTH))
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialise(signed(texts), "signatures")
    full = prints.where("n > 0 and doc_id is not null")
    firsts = full.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    distinct = materialise(firsts.select("key", "first.*", "n", "sig", "bits", "bands"), "distinct-sets")
    labels = groups(texts, distinct, crowd)
    # rows of one id are one document: its sets' groups are one
    held = full.select("doc_id", "key").join(labels, "key").select("doc_id", "key", "label")
    several = held.groupBy("doc_id").agg(F.min_by("key", "label").alias("u"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    also = several.join(held, "doc_id").where("label <> low").select("u", F.col("key").alias("v")).distinct()
    labels = _merged(labels, also)
    first = distinct.join(labels, "key").groupBy("label").agg(F.min("doc_id").alias("component"))
    named = labels.join(first, "label").select(F.col("key").alias("key2"), "component")
    rows = prints.join(named, F.when(F.col("n") > 0, F.col("key")) == F.col("key2"), "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
