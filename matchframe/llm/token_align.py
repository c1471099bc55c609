"""Alignment of two tokenizers through inverted pair bitmaps.

Both tokenizers cut a text's bytes; offsets where tokens of both end cut it into groups, and every token of the one
is linked to every token of the other in its group. For each linked pair of ids an inverted list is kept over all
documents: documents are numbered in blocks of at most 2^15, and a pair has one compressed container for each block
that holds it, with the documents' places (16-bit numbers or a bitmap, whichever is smaller) and multiplicity planes
(plane k has bit k of each document's number of links). Blocks share no document, so the OR of a pair's containers
is their union: its document count is the sum of their popcounts, and its link count that of the planes' popcounts
times 2^k. Counts then go back along the same containers, which add each pair's score to the documents it names,
so texts are read and tokenised once.

Neither tokenizer has tokens over a space that follows another character, so texts are cut there and each different
piece of a batch is tokenised and aligned once.

Null and empty texts, and texts that a tokenizer does not give back byte by byte (those with U+2581), have no tokens:
zeros and an empty hash. Rows are documents: repeated rows and ids count each, a null id stays null. A tie for the
highest count of an id counts for every pair that has it. Columns other than the id and the text are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, parts_of

#: Documents of a block, and (document, pair) entries after which a block is closed, so that a task's memory is bounded.
BLOCK_DOCS, BLOCK_ENTRIES = 1 << 15, 3_000_000
#: Links listed at once; a single group with more is counted by its different ids.
_LISTED = 1 << 21
#: A space may be cut off only after a character that is no white space; texts with other spaces go the long way.
_CUT = re.compile(r"(?<=\S)(?= )")
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
#: Pieces in one call of a tokenizer.
_TOGETHER = 2048
ENTRIES = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, docs long, links long, bits binary"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PairAligner:
    """Tokens of both tokenizers for pieces of text that start with a space, and what they link."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        written = {}  # how the byte-level form writes each byte
        for code in range(256):
            if code < 128:
                written[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]] = code
        for lead, follow in [(lead, 0x80) for lead in range(0xC2, 0xF5)] + [(0xC2, follow) for follow in range(0x80, 0xC0)]:
            size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            raw = bytes([lead, {0xE0: 0xA0, 0xF0: 0x90}.get(lead, follow), *[0x80] * (size - 2)])
            for char, code in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(raw.decode())[0][0], raw):
                written[char] = code
        size = self.a.get_vocab_size()
        bytes_a = [b""] * size
        for token, k in self.a.get_vocab().items():
            bytes_a[k] = bytes(written[c] for c in token) if all(c in written for c in token) else b""
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.span = len(bytes_a) * len(bytes_b)
        self.space = self.b.piece_to_id("▁")
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.binary()), pa.array(bytes_b, pa.binary())
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (bytes_a, bytes_b))
        self.name_a, self.name_b = (pa.array(list(map(str, range(len(x))))) for x in (bytes_a, bytes_b))

    def tokens(self, pieces: list[str], plain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces after one another, and how many each has, for both tokenizers. The first `plain` pieces may stand side by side in a text, so many go in one call."""
        texts = ["".join(pieces[k : min(k + _TOGETHER, plain)]) for k in range(0, plain, _TOGETHER)] + pieces[plain:]
        ends, out = np.cumsum(np.fromiter((len(p.encode()) for p in pieces[:plain]), np.int64, plain)), []
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = [ids or [self.space] for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]  # it adds the space itself
        runs = len(texts) - (len(pieces) - plain)
        for ids, size in ((ids_a, self.size_a), (ids_b, self.size_b)):
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            several = sum(map(len, ids[:runs]))
            upto = np.searchsorted(np.cumsum(size[flat[:several]]), ends, "right")
            out += [flat, np.concatenate([np.diff(upto, prepend=0), np.fromiter(map(len, ids[runs:]), np.int64, len(pieces) - plain)])]
        return tuple(out)


@cache
def aligner(path_a: str, path_b: str) -> PairAligner:
    return PairAligner(path_a, path_b)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _joined(offsets: np.ndarray, values: pa.Array, mark: str) -> pa.Array:
    return pc.binary_join(_lists(offsets, values), mark)


def _restored(names: pa.Array, ids: np.ndarray, sizes: np.ndarray, pieces: pa.Array) -> np.ndarray:
    """Which pieces the tokens' bytes give back."""
    whole = _joined(_offsets(sizes), names.take(pa.array(ids)), b"")
    return pc.equal(whole, pieces.cast(pa.binary())).to_numpy(zero_copy_only=False)


def _links(group: np.ndarray, a: np.ndarray, start_a: np.ndarray, n_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, n_b: np.ndarray, tools: PairAligner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, pair (one number for both ids), links: all pairs of ids of each group, added up for its owner in parts."""
    n, base = n_a * n_b, len(tools.size_b)
    out = []
    for g in np.flatnonzero(n > _LISTED):  # one group with a great many links: its different ids and how often they stand there
        (x, kx), (y, ky) = (np.unique(ids[s : s + k], return_counts=True) for ids, s, k in ((a, start_a[g], n_a[g]), (b, start_b[g], n_b[g])))
        out.append((np.full(len(x) * len(y), group[g]), (x[:, None] * base + y[None]).ravel(), (kx[:, None] * ky[None]).ravel()))
    rest = np.flatnonzero(n <= _LISTED)
    part = np.cumsum(n[rest]) // _LISTED
    for low, high in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right"))):
        g = rest[low:high]
        each = np.repeat(g, n[g])
        at = np.arange(len(each)) - np.repeat(_offsets(n[g])[:-1], n[g])
        pair = a[start_a[each] + at // n_b[each]] * base + b[start_b[each] + at % n_b[each]]
        out.append((group[each], pair, np.ones(len(each), np.int64)))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    return _added(*map(np.concatenate, zip(*out)), tools.span)


def _added(owner: np.ndarray, pair: np.ndarray, n: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n added up for each (owner, pair), in that order; pairs are below span."""
    if not len(owner):
        return owner, pair, n
    key = owner * span + pair
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] // span, key[first] % span, np.add.reduceat(n[order], first)


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, int]:
    """offsets by text, the different pieces, the number of each piece in its place, and how many pieces from the first may stand side by side: space + text cut before each single space."""
    texts = pc.fill_null(texts, "")
    uneven = pc.match_substring_regex(texts, f"(?:^|{_BLANK}) ")
    split = pc.split_pattern(texts, " ")
    if pc.any(uneven).as_py():
        # pieces lose the space before them, as those of the short way do
        lists = [[p[1:] for p in _CUT.split(" " + t)] if odd else plain for t, odd, plain in zip(texts.to_pylist(), uneven.to_pylist(), split.to_pylist())]
        split = pa.array(lists, pa.list_(pa.string()))
    coded = split.flatten().dictionary_encode()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    pieces = pc.binary_join_element_wise(pa.scalar(" "), coded.dictionary, "")
    alone = pc.match_substring_regex(pieces, f"{_BLANK}$|\u2581").to_numpy(zero_copy_only=False)
    order, place = np.argsort(alone, kind="stable"), np.empty(len(pieces), np.int64)
    place[order] = np.arange(len(pieces))
    return _offsets(sizes), pieces.take(pa.array(order)), place[coded.indices.to_numpy()], int((~alone).sum())


def align(texts: pa.Array, tools: PairAligner) -> tuple[list[np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text n_a, n_b, n_groups, n_links and the hash of its groups; and (row, pair, links) of all texts."""
    ends, pieces, codes, plain = pieces_of(texts)
    a, n_a, b, n_b = tools.tokens(pieces.to_pylist(), plain)
    good = _restored(tools.bytes_a, a, n_a, pieces) & _restored(tools.bytes_b, b, n_b, pieces)
    a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
    n_a, n_b = n_a * good, n_b * good
    # groups of all good pieces at once: byte offsets go on from piece to piece
    at_a, at_b = np.cumsum(tools.size_a[a]), np.cumsum(tools.size_b[b])
    common = np.intersect1d(at_a, at_b, assume_unique=True)
    to_a, to_b = (_offsets(np.diff(np.searchsorted(x, common, "right"), prepend=0)) for x in (at_a, at_b))
    in_a, in_b = np.diff(to_a), np.diff(to_b)
    n_groups = np.diff(np.searchsorted(to_a, _offsets(n_a)))
    piece_of = np.repeat(np.arange(len(pieces)), n_groups)
    written = pc.binary_join_element_wise(*(_joined(to, names.take(pa.array(ids)), ",") for to, names, ids in ((to_a, tools.name_a, a), (to_b, tools.name_b, b))), "|")
    written = _joined(_offsets(n_groups), written, ";")
    n_links = np.bincount(piece_of, in_a * in_b, len(pieces)).astype(np.int64)
    # back to the texts
    rows = np.repeat(np.arange(len(texts)), np.diff(ends))
    blank = pc.equal(pc.fill_null(texts, ""), "").to_numpy(zero_copy_only=False)
    sound = ~blank & (np.bincount(rows, ~good[codes], len(texts)) == 0)
    numbers = [np.bincount(rows, x[codes], len(texts)).astype(np.int64) * sound for x in (n_a, n_b, n_groups, n_links)]
    joined = _joined(ends, written.take(pa.array(codes)), ";")
    hashes = [hashlib.sha256(x.as_buffer()).hexdigest() if ok else "" for x, ok in zip(joined, sound.tolist())]
    kept = sound[rows]
    held, times = np.unique(rows[kept] * len(pieces) + codes[kept], return_counts=True)
    owner, pair, n = _links(piece_of, a, to_a[:-1], in_a, b, to_b[:-1], in_b, tools)
    row, piece = held // len(pieces), held % len(pieces)
    first, last = np.searchsorted(owner, piece, "left"), np.searchsorted(owner, piece, "right")
    size = last - first
    at = np.repeat(first - _offsets(size)[:-1], size) + np.arange(size.sum())
    return numbers, hashes, _added(np.repeat(row, size), pair[at], n[at] * np.repeat(times, size), tools.span)


def container(places: np.ndarray, links: np.ndarray) -> bytes:
    """Sorted places below 2^15 and their numbers of links: the smaller of 16-bit numbers and a bitmap, then the multiplicity planes over the places."""
    short = len(places) * 2 <= BLOCK_DOCS // 8
    where = places.astype("<u2").tobytes() if short else np.packbits(np.bincount(places, minlength=BLOCK_DOCS).astype(bool)).tobytes()
    planes = int(links.max()).bit_length()
    bits = [np.packbits((links >> k & 1).astype(bool)).tobytes() for k in range(planes)]
    return bytes([short, planes]) + len(places).to_bytes(2, "little") + where + b"".join(bits)


def contents(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """places, links of a container."""
    short, planes, n = raw[0], raw[1], int.from_bytes(raw[2:4], "little")
    end = 4 + (2 * n if short else BLOCK_DOCS // 8)
    places = np.frombuffer(raw, "<u2", n, 4) if short else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, BLOCK_DOCS // 8, 4)))
    width, links = -(-n // 8), np.zeros(n, np.int64)
    for k in range(planes):
        links += np.unpackbits(np.frombuffer(raw, np.uint8, width, end + k * width), count=n).astype(np.int64) << k
    return places.astype(np.int64), links


def entries(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two kinds of rows: one for each document (block, place and its own columns), one for each block's container of a pair (block, a, b, docs, links, bits)."""
    names = [field.split()[0] for field in ENTRIES.split(", ")]

    def rows(n: int, **columns) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        fields = [field.split() for field in ENTRIES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields], names)

    def closed(block: int, held: list, base: int) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        place, pair, n = map(np.concatenate, zip(*held))
        order = np.argsort(pair * BLOCK_DOCS + place)
        place, pair, n = place[order], pair[order], n[order]
        cuts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]])) if len(pair) else np.zeros(1, np.int64)
        for k in range(0, len(cuts) - 1, 4096):
            some = cuts[k : k + 4097]
            bits = [container(place[x:y], n[x:y]) for x, y in zip(some, some[1:])]
            ids = pair[some[:-1]]
            links = np.add.reduceat(n[some[0] : some[-1]], some[:-1] - some[0])
            yield rows(len(bits), block=np.full(len(bits), block), a=ids // base, b=ids % base, docs=np.diff(some), links=links, bits=bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(path_a, path_b)
        base = len(tools.size_b)
        block, taken, size, held = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in parts_of(batches, 1):
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                if taken + part.num_rows > BLOCK_DOCS or size > BLOCK_ENTRIES:
                    yield from closed(block, held, base)
                    block, taken, size, held = block + 1, 0, 0, []
                (n_a, n_b, n_groups, n_links), hashes, (row, pair, n) = align(part.column(1), tools)
                places = np.arange(taken, taken + part.num_rows)
                yield rows(part.num_rows, block=np.full(part.num_rows, block), place=places, doc_id=part.column(0), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=hashes)
                held.append((row + taken, pair, n))
                taken, size = taken + part.num_rows, size + len(row)
        yield from closed(block, held, base)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ENTRIES)


def pair_scores(made: DataFrame) -> DataFrame:
    """a, b, documents, links, best: how many documents link the two ids, how many links there are, and whether no other pair of the first id has more documents."""
    counts = made.where("place is null").groupBy("a", "b").agg(F.sum("docs").alias("documents"), F.sum("links").alias("links"))
    counts = materialise(counts, "pair-counts")
    highest = counts.groupBy(F.col("a").alias("of")).agg(F.max("documents").alias("most"))
    return counts.join(highest, F.col("a") == F.col("of")).select("a", "b", "documents", "links", (F.col("documents") == F.col("most")).alias("best"))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of containers by block, with the documents and the best mark of their pair: sums for each place."""
    now, sums = None, np.zeros((2, BLOCK_DOCS), np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        if now is not None:
            places = np.flatnonzero(sums[0])  # a linked pair stands in one document at least
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), now)), pa.array(places.astype(np.int32)), pa.array(sums[0][places]), pa.array(sums[1][places])], ["block", "place", "count_sum", "n_best"])

    for batch in batches:
        for block, documents, best, bits in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now:
                yield from out()
                now, sums = block, np.zeros((2, BLOCK_DOCS), np.int64)
            places, links = contents(bits)
            sums[0][places] += links * documents
            if best:
                sums[1][places] += links
    yield from out()


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs."""
    made = materialise(entries(docs, path_a, path_b, id_col, text_col), "pair-bitmaps")
    scores = pair_scores(made).select("a", "b", "documents", "best")
    posted = made.where("place is null").select("block", "a", "b", "bits").join(scores, ["a", "b"]).select("block", "documents", "best", "bits")
    sums = posted.repartition("block").sortWithinPartitions("block").mapInArrow(_returned, "block long, place int, count_sum long, n_best long")
    rows = made.where("place is not null").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, ["block", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
