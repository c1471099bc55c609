"""Best-fit-decreasing packing of token sequences.

The plan needs only how many pieces there are of each length: 2048 numbers, whatever the size of the corpus.
Pieces of one length are interchangeable, so best-fit decreasing runs on runs of equal bins: a segment tree over
remaining capacities finds the tightest open bins in logarithmic time, and a run of bins takes a run of pieces.
The result is bin for bin that of the usual algorithm. Ranks of the pieces within their length then lead every
piece to its place; ranks are counted in salted parts, so a length that a third of all pieces have is no hot key.

Null text counts as empty: one piece that holds the end id alone. Repeated rows are packed each. An empty table
gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialise, parts_of

CAPACITY = 2048
PART_ROWS = 200_000
_CACHE_LIMIT = 400_000
#: Lower-case letters whose runs are one unit for the tokenizer, and marks that are never part of such a unit.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
_MARKS = ".,;:!?()[]{}*#%&$/"
_PLAIN = re.compile(f"[{_LETTERS}{_LETTERS.replace('ß', '').upper()}]+").fullmatch


class WordEncoder:
    """Ids of texts, as little-endian uint32 bytes. The tokenizer drops white space, so words are encoded apart and kept; the store is emptied when large."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        written = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): written.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def core(self, core: str) -> bytes:
        """Ids of a run of plain lower-case letters: one unit of the merges, which needs no other step of the tokenizer."""
        ids = self.cores.get(core)
        if ids is None:
            ids = self.cores[core] = array("I", [t.id for t in self.model.tokenize(core if core.isascii() else core.translate(self.letters))]).tobytes()
        return ids

    def word(self, word: str) -> bytes:
        """Punctuation behind letters is a token apart, and the tokenizer lower-cases: words that differ so share their ids."""
        if word.isascii():
            if word.isalpha():
                return self.core(word.lower())
            stem = word.rstrip(_MARKS)
            plain = stem.isalpha()
        else:
            stem = word.rstrip(_MARKS)
            plain = _PLAIN(stem)
        if not plain:
            return self.whole(word)
        tail = word[len(stem) :]
        mark = self.tails.get(tail)
        if mark is None:
            mark = self.tails[tail] = self.whole(tail)
        return self.core(stem.lower()) + mark

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and the last ends. Null texts have none. Each different word of the batch is looked up once."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > _CACHE_LIMIT:
            self.known.clear()
            self.cores.clear()
            self.tails.clear()
        known, held = self.known, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self.word(word)
            held.append(ids)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        table = np.frombuffer(b"".join(held), "<u4")
        codes = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        first = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        return table[np.repeat(first, sizes[codes]) + np.arange(ends[-1])], ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


@cache
def encoder_of(tokenizer: str) -> WordEncoder:
    """One for each worker process, so that its words are kept from task to task. A bare file name is looked up where the worker runs."""
    if os.path.dirname(tokenizer):
        return WordEncoder(tokenizer)
    import public_tokenizers

    return WordEncoder(public_tokenizers.path(tokenizer))


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, then id 0, cut only where longer than capacity. tokenizer: a path, or the name of a public tokenizer's file."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in parts_of(batches, 1):
            out = []
            ids, ends = encoder.encode(batch.column(1))
            for doc_id, start, end in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                held = ids[start:end].tobytes() + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(held), 4 * capacity)):
                    part = held[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over the remaining capacities 0 to `top`; a leaf holds runs (first bin, bins) of equal bins."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.open = [False] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, leaf: int) -> None:
        at = leaf + self.size
        self.open[at] = bool(self.runs[leaf])
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def put(self, capacity: int, first: int, bins: int) -> None:
        if bins:
            self.runs[capacity].append((first, bins))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, least: int) -> int | None:
        """Smallest capacity of at least `least` with an open bin."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first bin, pieces a bin, offset) of each run of placements, by length and rank."""
    tree, bins, plan = CapacityTree(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, fit = capacity, capacity // length
                first, many = bins, -(-left // fit)
                bins += many
            else:
                fit = room // length
                first, many = tree.take(room)
            full = min(many, left // fit)
            if full:
                plan.append((length, rank, first, fit, capacity - room))
                tree.put(room - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if full < many:
                rest = left if left < fit else 0
                if rest:
                    plan.append((length, rank, first + full, rest, capacity - room))
                    tree.put(room - rest * length, first + full, 1)
                    rank, left = rank + rest, 0
                tree.put(room, first + full + bool(rest), many - full - bool(rest))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. The driver sees a count per length, and nothing that grows with the corpus.

    Ranks within a length are counted in parts of about part_rows, however many pieces have that length.
    """
    pieces = materialise(pieces, "pieces")
    salts = max(16, pieces.count() // part_rows)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialise(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(best_fit_decreasing(counts, capacity) or [(1, 0, 0, 1, 0)], np.int64)
    span = int(max(counts.values(), default=0)) + 1
    starts = plan[:, 0] * span + plan[:, 1]
    order = np.argsort(starts, kind="stable")
    plan = pieces.sparkSession.sparkContext.broadcast((starts[order], plan[order]))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, rows = plan.value
        row = rows[np.searchsorted(starts, length.to_numpy() * span + rank.to_numpy(), "right") - 1]
        k = rank.to_numpy() - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + k // row[:, 3], "offset": row[:, 4] + k % row[:, 3] * length.to_numpy()})

    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("inside", F.row_number().over(inside) - 1)
    at = parts.select(F.col("length").alias("l2"), F.col("salt").alias("s2"), "before")
    ranked = ranked.join(at, (F.col("length") == F.col("l2")) & (F.col("salt") == F.col("s2")))
    return ranked.withColumn("at", place("length", F.col("before") + F.col("inside"))).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
