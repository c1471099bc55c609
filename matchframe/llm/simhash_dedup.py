"""SimHash near-duplicates through a segment-popcount grid.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the vector of their bit counts is an embedding whose
Manhattan distance never exceeds the Hamming distance of two fingerprints. Two vectors at distance 2 or less
share a vector within distance 1 of both, so each distinct fingerprint is put in the 33 grid cells within
distance 1 of its own and meets every possible partner in a cell. Pairs that meet are verified by exact Hamming
distance. A cell with more fingerprints than `cell_limit` is refined to segments of one bit: 65 cells a
fingerprint, at most 65 fingerprints a cell, and any two that share one are within 2 bits. So no group grows
with the data, and no cell gives pairs by the square of its size: each gives a spanning forest of its links.

The training set's near copies (`keep_one`) are those of 5-word Jaccard similarity 0.8 or more. The grid finds them
first, on fingerprints of the sets of 5-word shingles, and what it links is verified by the whole sets. At similarity
0.8 fingerprints are some 10 bits apart, and 16 at times; at that radius the grid rules nothing out, so an exact check
of what is still apart follows: such sets share a shingle among the first fifth of each in one order of all shingles.
As in the grid, a popcount is the lower bound: that of two parity bitmaps' difference never exceeds the sets'
difference. It is taken where the sets meet, so only pairs that it does not rule out leave a task; they are verified by
the whole sets.

Null text counts as empty; empty texts have fingerprint zero and link like any other. Rows with one id twice
stay separate rows of one node of the graph and get the same component. A null id gets its fingerprint's component.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, materialise, parts_of

SEGMENTS, SEGMENT_BITS = 16, 4
RADIUS = 2
#: Near copies of the training set: words a shingle, documents sampled for common shingles, and the share that makes one common.
WIDTH, SAMPLE, COMMON = 5, 20_000, 0.001
BROADCAST_ROWS = 1_000_000
_CHUNK = 1 << 16
#: Bytes of parity maps that are gathered at a time, bytes of the tables in which tasks hold groups, and pairs after which they are given out.
_GATHERED, _TABLE, _PAIRS = 2 << 20, 8 << 20, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """Unsigned SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k : k + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 1):
            fps = np.fromiter((fingerprint_of(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def _grid(fps: np.ndarray) -> np.ndarray:
    """The 33 cells of each fingerprint: its bit counts packed 4 bits each (0 to 5, moved by one), and all one step away."""
    f = fps.view(np.uint64)
    own = np.zeros(len(f), np.uint64)
    counts = np.empty((SEGMENTS, len(f)), np.int64)
    for s in range(SEGMENTS):
        counts[s] = np.bitwise_count((f >> np.uint64(SEGMENT_BITS * s)) & np.uint64(15))
        own |= (counts[s] + 1).astype(np.uint64) << np.uint64(4 * s)
    cells = np.empty((len(f), 1 + 2 * SEGMENTS), np.uint64)
    cells[:, 0] = own
    for s in range(SEGMENTS):
        step = np.uint64(1) << np.uint64(4 * s)
        cells[:, 1 + 2 * s] = own + step
        cells[:, 2 + 2 * s] = own - step
    return cells.view(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Smallest index reachable from each node over the given links."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _cell_links(cells: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between representatives of fingerprints that share a cell; rows come sorted by cell."""
    left, right, live, lag = [], [], np.arange(len(cells)), 1
    while True:
        live = live[live + lag < len(cells)]
        live = live[cells[live] == cells[live + lag]]
        if not len(live):
            break
        near = live[np.bitwise_count(fps[live].view(np.uint64) ^ fps[live + lag].view(np.uint64)) <= RADIUS]
        left.append(reps[near])
        right.append(reps[near + lag])
        lag += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    names, both = np.unique(np.concatenate(left + right), return_inverse=True)
    roots = _forest(both[: len(both) // 2], both[len(both) // 2 :], len(names))
    keep = roots != np.arange(len(names))
    return names[keep], names[roots[keep]]


def links(distinct: DataFrame, cell_limit: int = 2000) -> DataFrame:
    """u, v: links whose components are those of all fingerprints (fp, rep) within 2 bits of one another."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, reps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            cells = _grid(np.ascontiguousarray(fps))
            n = cells.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(np.repeat(fps, n)), pa.array(np.repeat(reps, n))], ["cell", "fp", "rep"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(rows: np.ndarray) -> pa.RecordBatch:
            u, v = _cell_links(rows[0], rows[1], rows[2])
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += held[-1].shape[1]
            if size >= 200_000:
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last cell may go on in the next batch
                if whole:
                    yield out(rows[:, :whole])
                held, size = [rows[:, whole:]], rows.shape[1] - whole
        if size:
            yield out(np.concatenate(held, axis=1))

    cells = materialise(distinct.mapInArrow(spread, "cell long, fp long, rep long"), "simhash-cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = sizes.where(F.col("n") > cell_limit).select("cell")
    shared = sizes.where(F.col("n") <= cell_limit).select("cell")
    plain = (
        cells.join(shared, "cell", "left_semi").repartition("cell").sortWithinPartitions("cell").select("cell", "fp", "rep")
        .mapInArrow(meet, "u long, v long")
    )
    dense = cells.join(crowded, "cell", "left_semi").select("fp", "rep").distinct()
    balls = dense.select("rep", F.explode(F.array(F.col("fp"), *[F.expr(f"fp ^ shiftleft(1L, {b})") for b in range(64)])).alias("ball"))
    roots = balls.groupBy("ball").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fine = balls.join(roots, "ball").where("rep > v").select(F.col("rep").alias("u"), "v").distinct()
    return plain.union(fine)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """u, component: the smallest node reachable, by alternating large-star and small-star steps over tables in the shared folder."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.*").where("u > v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select("u", F.col("v").alias("component"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, cell_limit: int = 2000) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    bounded_batches(docs.sparkSession)
    prints = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    distinct = materialise(distinct, "distinct-fingerprints")
    # rows of one id are one document: their fingerprints are linked
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    held = prints.join(several, "doc_id").join(distinct, "fp").groupBy("doc_id", "rep").agg(F.lit(1)).select("doc_id", "rep")
    owned = held.where("rep <> doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    joined = components(links(distinct, cell_limit).union(owned))
    # a rep is the smallest id of its fingerprint, so the smallest rep or id of a component is its smallest id
    named = distinct.join(joined, distinct.rep == joined.u, "left").select(F.col("fp").alias("fp2"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, prints.fp == named.fp2, "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted 63-bit hashes of each text's different word shingles; a shorter text is one shingle, an empty one has none.

    Each different word of the batch is hashed once, and windows are combined from the words' hashes.
    """
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    words = np.fromiter(map(xxhash.xxh64_intdigest, names, repeat(42)), np.uint64, len(names))[coded.indices.to_numpy()]
    runs = np.zeros(len(words), np.uint64)
    for k in range(width):
        ends = max(len(words) - k, 0)
        runs[:ends] = runs[:ends] * _ODD + words[k:]
    runs = _mixed(runs)
    blank = pc.equal(pc.list_value_length(split), 1).to_numpy(zero_copy_only=False)
    out, offsets = [], split.offsets.to_numpy() - split.offsets[0].as_py()
    for at, end, single in zip(offsets[:-1].tolist(), offsets[1:].tolist(), blank.tolist()):
        if end == at or single and not names[coded.indices[at].as_py()]:
            out.append(np.empty(0, np.uint64))
        elif end - at >= width:
            out.append(np.unique(runs[at : end - width + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(words[at:end].tobytes()) >> 1], np.uint64))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the combined hashes over 63 bits, so that low bits and order are as good as random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(1)


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes()) - (1 << 63)


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set, as signed longs; the hashes have 63 bits, which a factor spreads over 64."""
    return np.fromiter((majority(s * _ODD) for s in sets), np.uint64, len(sets)).view(np.int64)


def parity_map(hashes: np.ndarray) -> bytes:
    """For each place of a bitmap twice as large as the set, whether an odd number of its hashes fall there."""
    size = max(512, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 512
    return np.packbits((np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """The popcount of two parity maps' exclusive or: never more than the sets' symmetric difference. A larger map folds onto the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class ParityMaps:
    """The parity maps of many rows, for popcounts of many pairs at once; maps of each size, and larger ones folded to it, are one matrix."""

    def __init__(self, maps: list[bytes] | pa.ChunkedArray):
        self.maps = maps if isinstance(maps, pa.ChunkedArray) else pa.chunked_array([maps], pa.binary())
        self.sizes, self.folded = pc.binary_length(self.maps).to_numpy().astype(np.int64), {}

    def _of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.folded:
            rows = np.flatnonzero(self.sizes >= size)
            place, maps = np.zeros(len(self.sizes), np.int64), np.empty((len(rows), size // 8), np.uint64)
            place[rows] = np.arange(len(rows))
            for own in np.unique(self.sizes[rows]).tolist():
                same, step = np.flatnonzero(self.sizes == own), max(1, _GATHERED // own)
                for k in range(0, len(same), step):
                    some = same[k : k + step]
                    whole = np.frombuffer(self.maps.take(pa.array(some)).combine_chunks().buffers()[2], np.uint64, len(some) * own // 8)
                    maps[place[some]] = np.bitwise_xor.reduce(whole.reshape(len(some), own // size, size // 8), axis=1)
            self.folded[size] = place, maps
        return self.folded[size]

    def differences(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """least_difference of the maps at i and j, pair by pair."""
        out = np.zeros(len(i), np.int64)
        least = np.minimum(self.sizes[i], self.sizes[j])
        for size in np.unique(least).tolist():
            place, maps = self._of(size)
            at, step = np.flatnonzero(least == size), max(1, _GATHERED // size)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                out[some] = np.bitwise_count(maps[place[i[some]]] ^ maps[place[j[some]]]).sum(axis=1, dtype=np.int64)
        return out


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles in more than COMMON of a bounded sample of documents, sorted; their number is bounded by the words of a document over COMMON.

    They come last in the order of all shingles; any order finds every pair, so the sample decides costs alone.
    """
    sample = bounded_sample(docs.select("doc_id", "text"), "doc_id", SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(batch.column(1))).view(np.int64))], ["h"])

    counted = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON * SAMPLE)
    return np.sort(np.array([r.h for r in counted.select("h").collect()], np.int64).view(np.uint64))


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), key (of the set of shingles), fp (its fingerprint), n (its size), bits (its parity map), prefix: the first shingles in one order of all shingles, common ones last.

    Two sets of Jaccard similarity 0.8 or more share a shingle within these prefixes, whatever the order.
    """
    common = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 2):
            sets, heads = shingle_sets(batch.column(2)), []
            for s in sets:
                size = len(s) - (4 * len(s) + 4) // 5 + 1
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                    s = np.concatenate([s[~last], s[last]])
                heads.append(s[:size].view(np.int64))
            ends = np.cumsum([0] + [len(h) for h in heads]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(set_prints(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(parity_map, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads)))],
                ["doc_id", "th", "key", "fp", "n", "bits", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_hash(), "text").mapInArrow(run, "doc_id long, th long, key long, fp long, n long, bits binary, prefix array<long>")


def text_hash() -> Column:
    """Tells rows of one id apart by their texts; a null text has a hash of its own."""
    return F.xxhash64("text", F.col("text").isNull())


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns as rows of a matrix, in parts that do not cut a run of equal values of the first column."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        size += held[-1].shape[1]
        if size >= 200_000:
            rows = np.concatenate(held, axis=1)
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on in the next batch
            if whole:
                yield rows[:, :whole]
            held, size = [rows[:, whole:]], rows.shape[1] - whole
    if size:
        yield np.concatenate(held, axis=1)


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose shingle is in the prefix of more than one set."""
    for rows in whole_groups(batches):
        same = rows[0][1:] == rows[0][:-1]
        kept = rows[:, np.append(same, False) | np.append(False, same)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], ["h", "n", "key"])


def whole_tables(batches: Iterator[pa.RecordBatch], size: int = _TABLE) -> Iterator[pa.Table]:
    """As whole_groups, with columns of any type: tables of about `size` bytes that do not cut a run of equal values of the first column, so only such a run makes a table larger."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) >= size and held[0].column(0)[0] != batch.column(0)[-1]:
            h = batch.column(0).to_numpy()
            rest = int(np.searchsorted(h, h[-1]))  # the last group may go on in the next batch
            if rest:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, rest)]).combine_chunks()
                held = [batch.slice(rest)]
            else:  # it began in an earlier batch
                rows = pa.Table.from_batches(held).combine_chunks()
                whole = int(np.searchsorted(rows.column(0).to_numpy(), h[-1]))
                held = rows.slice(whole).to_batches()
                yield rows.slice(0, whole)
                del rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    pa.default_memory_pool().release_unused()  # workers live on from stage to stage


def meeting(h: np.ndarray, n: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of one group h, different labels and sizes that allow similarity 0.8; rows come by h and n."""
    live, lag = np.arange(len(h)), 1
    while len(live):
        live = live[live + lag < len(h)]
        live = live[(h[live] == h[live + lag]) & (5 * n[live] >= 4 * n[live + lag])]  # sorted by size: further ones are larger
        for k in range(0, len(live), _CHUNK):
            some = live[k : k + _CHUNK]
            some = some[label[some] != label[some + lag]]
            if len(some):
                yield some, some + lag
        lag += 1


def pairs_of(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    """u, v: the different pairs, the smaller key first."""
    none = [np.empty(0, np.int64)]
    pairs = np.stack([np.concatenate(left or none), np.concatenate(right or none)])
    pairs = np.unique(np.stack([pairs.min(axis=0), pairs.max(axis=0)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that share a shingle of their prefixes and are next to one another by size."""
    for h, n, key in whole_groups(batches):
        at = np.flatnonzero((h[1:] == h[:-1]) & (5 * n[:-1] >= 4 * n[1:]))
        yield pairs_of([key[at]], [key[at + 1]])


def _apart(nearest: bool):
    """Pairs of sets of different components that share a shingle of their prefixes and that their parity maps do not rule out: all, or for each set the most alike in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_tables(batches):
            h, n, key, label = (rows.column(k).to_numpy() for k in range(4))
            maps, left, right, met = ParityMaps(rows.column(4)), [], [], 0
            best, who = np.full(len(h), np.inf), np.full(len(h), -1)
            for i, j in meeting(h, n, label):
                apart, both = maps.differences(i, j), n[i] + n[j]
                able = 9 * apart <= both  # sets of similarity 0.8 or more differ in a ninth of their shingles at most
                i, j, share = i[able], j[able], apart[able] / both[able]
                if not nearest:
                    left.append(key[i])
                    right.append(key[j])
                    met += len(i)
                    if met >= _PAIRS:
                        yield pairs_of(left, right)
                        left, right, met = [], [], 0
                    continue
                for a, b in ((i, j), (j, i)):
                    more = share < best[a]
                    best[a[more]], who[a[more]] = share[more], b[more]
            if nearest:
                at = np.flatnonzero(who >= 0)
                left, right = [key[at]], [key[who[at]]]
            yield pairs_of(left, right)

    return run


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their parity maps do not rule out: sets of similarity 0.8 or more differ in a ninth of their shingles at most."""
    for batch in batches:
        u, v, un, vn, ub, vb = batch.columns
        most = un.to_numpy() + vn.to_numpy()
        keep = [9 * least_difference(a, b) <= m for a, b, m in zip(ub.to_pylist(), vb.to_pylist(), most.tolist())]
        yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verified(docs: DataFrame, pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs of keys whose sets have Jaccard similarity 0.8 or more, by the sets themselves. Most others are ruled out by their parity maps before any set is moved."""
    side = lambda name: distinct.select(F.col("key").alias(name), F.col("n").alias(f"{name}n"), F.col("bits").alias(f"{name}b"))
    met = pairs.distinct().join(side("u"), "u").join(side("v"), "v").select("u", "v", "un", "vn", "ub", "vb")
    return confirmed(docs, materialise(met.mapInArrow(_able, "u long, v long"), "pairs"), distinct)


def _undecided(rows: DataFrame) -> DataFrame:
    """The rows of shingles that sets of different components share."""
    several = rows.groupBy(F.col("h").alias("hm")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return rows.join(several, F.col("h") == F.col("hm"), "left_semi")


def grid_pairs(distinct: DataFrame) -> DataFrame:
    """u, v: keys of sets of one fingerprint, and of fingerprints that the grid links."""
    reps = materialise(distinct.groupBy("fp").agg(F.min("key").alias("rep")), "distinct-fingerprints")
    same = distinct.select("key", "fp").join(reps, "fp").where("key <> rep").select(F.col("key").alias("u"), F.col("rep").alias("v"))
    return links(reps).union(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, distinct: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs of keys whose whole sets of shingles have Jaccard similarity 0.8 or more. Only texts of such keys are read again; distinct has key, doc_id, th."""
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    wanted = materialise(distinct.join(keys, "key", "left_semi").select("doc_id", "th"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:  # of checked size
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 0):
            sets = shingle_sets(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long"), text_hash().alias("th"), "text").join(wanted, ["doc_id", "th"], "left_semi").select("text")
    sets = materialise(texts.mapInArrow(run, "key long, hashes array<long>").dropDuplicates(["key"]), "sets")
    both = pairs.join(sets.select(F.col("key").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("hashes").alias("b")), "v")
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, th, kept: groups of texts linked by 5-word Jaccard similarity of 0.8 or more; kept where the row has the group's smallest (doc_id, key). No row for null ids.

    First the grid's links are verified. Of what is still apart, neighbours by size are compared for each shared shingle,
    then each set with the most alike of another group, then all pairs that are not yet in one group, so that a large
    group of near copies does not give pairs by the square of its size.
    """
    bounded_batches(docs.sparkSession)
    prints = materialise(prefixes(docs).where("doc_id is not null"), "prefixes")
    distinct = prints.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"))
    distinct = materialise(distinct.select("key", "first.*", "n", "fp", "bits"), "distinct-sets")
    grouped = lambda found: components(found).select(F.col("u").alias("key"), "component")
    found = materialise(_verified(docs, grid_pairs(distinct), distinct), "links")
    named = grouped(found)
    firsts = distinct.select("key", F.col("doc_id").alias("d1"), F.col("th").alias("t1"))
    copies = prints.select("doc_id", "th", "key").join(firsts, "key").where("doc_id <> d1 or th <> t1").select("doc_id", "th").distinct()
    copies = materialise(copies, "exact-copies")
    if copies.count() <= BROADCAST_ROWS:  # of checked size; beyond it the prefixes are shuffled
        copies = F.broadcast(copies)
    once = prints.join(copies, ["doc_id", "th"], "left_anti").select("n", "key", F.explode_outer("prefix").alias("h")).where("h is not null")
    by_shingle = lambda rows: rows.repartition("h").sortWithinPartitions("h", "n", "key")
    shared = materialise(by_shingle(once.select("h", "n", "key")).mapInArrow(shared_rows, "h long, n long, key long"), "shared-shingles")
    end = lambda name: named.select(F.col("key").alias(name), F.col("component").alias(f"{name}c"))
    near = by_shingle(shared).mapInArrow(_neighbours, "u long, v long").distinct().join(end("u"), "u", "left").join(end("v"), "v", "left")
    near = near.where(F.coalesce("uc", "u") != F.coalesce("vc", "v")).select("u", "v")
    later = materialise(_verified(docs, near, distinct), "links")
    for nearest in (True, False):
        if not later.isEmpty():
            found = found.union(later)
            named = grouped(found)
        labels = distinct.select("key", "bits").join(named, "key", "left").select("key", F.coalesce("component", "key").alias("label"), "bits")
        labels = materialise(labels, "labels")
        shared = materialise(_undecided(shared.join(labels.drop("bits"), "key")).select("h", "n", "key"), "mixed-shingles")
        rows = by_shingle(shared.join(labels, "key").select("h", "n", "key", "label", "bits"))
        apart = materialise(rows.mapInArrow(_apart(nearest), "u long, v long").distinct(), "pairs")
        if apart.isEmpty():  # no two sets of different groups are alike enough
            break
        later = materialise(confirmed(docs, apart, distinct), "links")
    else:
        named = grouped(found.union(later))
    groups = distinct.join(named, "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    smallest = groups.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("kept"))
    groups = groups.join(smallest, "component").select("key", "kept")
    return prints.select("doc_id", "th", "key").join(groups, "key").select("doc_id", "th", (F.struct("doc_id", "key") == F.col("kept")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without those of a larger (doc_id, text) in their group of near copies; columns and order of columns stay.

    The decision is one of rows: a text that stands under an id of another group's copy stays. Repeated rows are one
    document and stay or go together; a null doc_id is never dropped.
    """
    gone = materialise(similar(docs).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct(), "copies")
    few = gone.count() <= BROADCAST_ROWS  # of checked size; beyond it the texts are shuffled
    row = (docs["doc_id"].cast("long") == gone["_gone_id"]) & (F.xxhash64(docs["text"], docs["text"].isNull()) == gone["_gone_th"])
    return docs.join(F.broadcast(gone) if few else gone, row, "left_anti")
