"""Subword lattice likelihood under unigram piece scores.

Pieces of an existing vocabulary are the edges of a lattice over each word (with the vocabulary's word-start
mark); its ranks give the first scores, p(piece) ~ 1 / (rank + 2.7), which two rounds of forward-backward counts
over all training words adjust. A word's probability is the sum over all its segmentations, by forward recursion
in log space. A whole word seen in training is one more edge, discounted, as long as the corpus holds it:
p(word) = (c - d) / N + d V / N * lattice(word). Characters outside the vocabulary have byte edges, so every text
has a probability. No piece crosses a word's end, so the text's lattice is the product of its words' lattices and
each distinct word is worked out once.

Words above a share of all tokens (at most 1 / share of them) go to the workers as a table of proven size; all
others are joined by themselves, none of which is frequent. Null text counts as empty: one end token. Null ids
are held out. Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, materialise, parts_of, rows_of

END = b" "  # holds a space, so no word equals it
MARK = "▁"
HEAD_SHARE = 2e-6
WHOLE, CORE, MARGIN = 400, 320, 40
BYTE_LOG = np.log(1e-4 / 256)
_FLUSH = 250_000
_HALF = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, in order of rank, lower-cased ones only (texts are lower-cased)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return [p for p in dict.fromkeys(pieces) if p == p.encode().lower().decode()]


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Rolling hash of every prefix, for rows of equal length."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _HALF + (codes[:, k].astype(np.uint64) + np.uint64(1))
    return out


class Lattice:
    """Log probabilities of words over all segmentations into pieces; vectorised over words of one length."""

    def __init__(self, pieces: list[str], logs: np.ndarray) -> None:
        keys = np.array([int(_prefix_hashes(np.array([[ord(c) for c in p]], np.uint32))[0, -1]) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys, self.logs = keys[self.order], logs[self.order]
        self.longest = max(map(len, pieces))
        self.powers = np.array([pow(int(_HALF), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.table: dict[int, float] = {}

    def edges(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, end) -> place among the pieces, or -1, and the log probability of each word's edge: the piece, and for single characters their bytes beside it."""
        prefix, n, out = _prefix_hashes(codes), codes.shape[1], {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = prefix[:, j] - prefix[:, i] * self.powers[j - i]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                found = self.keys[at] == h
                log = np.where(found, self.logs[at], -np.inf)
                if j == i + 1:
                    c = codes[:, i]
                    size = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                    log = np.logaddexp(log, size * BYTE_LOG)
                elif not found.any():
                    continue
                out[i, j] = (np.where(found, at, -1), log)
        return out

    def forward(self, codes: np.ndarray, edges: dict) -> np.ndarray:
        alpha = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
        alpha[0] = 0
        for (i, j), (_, log) in sorted(edges.items(), key=lambda e: e[0][1]):
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + log)
        return alpha

    def backward(self, codes: np.ndarray, edges: dict) -> np.ndarray:
        beta = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
        beta[-1] = 0
        for (i, j), (_, log) in sorted(edges.items(), key=lambda e: -e[0][0]):
            beta[i] = np.logaddexp(beta[i], beta[j] + log)
        return beta

    def batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indices, code points) of words of equal length, few enough at a time to bound memory."""
        lengths = np.array([len(w) + 1 for w in words])
        for n in np.unique(lengths):
            where, most = np.flatnonzero(lengths == n), max(1, 400_000 // int(n))
            for k in range(0, len(where), most):
                part = where[k : k + most]
                codes = np.frombuffer("".join(MARK + words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n)
                yield part, codes

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for part, codes in self.batches(words):
            if codes.shape[1] > WHOLE:
                out[part] = [self.long_word(c) for c in codes]
            else:
                out[part] = self.forward(codes, self.edges(codes))[-1]
        return out

    def long_word(self, codes: np.ndarray) -> float:
        """The same recursion with a window of the last states only, for words of any length."""
        if not self.table:
            self.table.update(zip(self.keys.tolist(), self.logs.tolist()))
        table, prefix, alpha, n, full = self.table, _prefix_hashes(codes[None])[0].tolist(), [0.0], len(codes), (1 << 64) - 1
        powers = self.powers.tolist()
        for j in range(1, n + 1):
            c = int(codes[j - 1])
            paths = [alpha[-1] + BYTE_LOG * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))]
            for i in range(max(0, j - self.longest), j):
                log = table.get((prefix[j] - prefix[i] * powers[j - i]) & full)
                if log is not None:
                    paths.append(alpha[i - j] + log)
            alpha = [*alpha[-self.longest :], float(np.logaddexp.reduce(paths))]
        return alpha[-1]

    def expected(self, words: list[str], weights: np.ndarray, into: np.ndarray) -> None:
        """Adds each piece's expected count over the weighted words. Long words are counted in windows that overlap, each edge in the window whose core it starts in."""
        for part, codes in self.batches(words):
            n = codes.shape[1]
            if n <= WHOLE:
                self._count(codes, weights[part], into, 0, n)
                continue
            for core in range(0, n, CORE):
                low, high = max(0, core - MARGIN), min(n, core + CORE + MARGIN)
                self._count(codes[:, low:high], weights[part], into, core - low, min(core + CORE, n) - low)

    def _count(self, codes: np.ndarray, weights: np.ndarray, into: np.ndarray, first: int, last: int) -> None:
        edges = self.edges(codes)
        alpha, beta = self.forward(codes, edges), self.backward(codes, edges)
        for (i, j), (at, _) in edges.items():
            hit = at >= 0
            if first <= i < last and hit.any():
                log = self.logs[at[hit]]  # of the piece alone, without the bytes beside it
                np.add.at(into, at[hit], weights[hit] * np.exp(alpha[i][hit] + log + beta[j][hit] - alpha[-1][hit]))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 40_000) -> Iterator[list]:
    """Column lists of some batches at a time, as words of one length are worked out together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield [c.to_pylist() for c in pa.Table.from_batches(held).columns]
            held = []
    if held:
        yield [c.to_pylist() for c in pa.Table.from_batches(held).columns]


def _tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c (in training rows), seen (in all rows); docs has text and held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn: Counter = Counter()
        other: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(learn.keys() | other.keys())
            c = [learn[w] for w in words]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([n + other[w] for n, w in zip(c, words)], pa.int64())], ["word", "c", "seen"])

        for texts, held in rows_of(parts_of(batches, 0)):
            for text, h in zip(texts, held):
                (other if h else learn).update(_tokens(text))
                if len(learn) + len(other) > _FLUSH:
                    yield out()
                    learn.clear()
                    other.clear()
        yield out()

    raw = docs.mapInArrow(run, "word binary, c long, seen long")
    return raw.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def fit_pieces(counts: DataFrame, vocabulary: list[str], rounds: int = 2) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces after `rounds` of expected counts. The driver sees one number per piece."""
    spark = counts.sparkSession
    prior = 1 / (np.arange(len(vocabulary)) + 2.7)
    logs = np.log(prior / prior.sum())
    shared = spark.sparkContext.broadcast(vocabulary)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(logs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(shared.value, now.value), np.zeros(len(shared.value))
            for words, c in _gathered(batches):
                lattice.expected([w.decode("utf-8", "surrogatepass") for w in words], np.array(c, float), total)
            back = np.zeros(len(total))
            back[lattice.order] = total
            at = np.flatnonzero(back > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(back[at])], ["piece", "n"])

        learned = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c").mapInArrow(run, "piece int, n double")
        n = np.zeros(len(vocabulary))
        for row in learned.groupBy("piece").agg(F.sum("n").alias("n")).collect():
            n[row["piece"]] = row["n"]
        n = n + 100 * np.exp(logs)  # what the vocabulary itself says keeps the weight of a hundred pieces
        logs = np.log(n / n.sum() * (1 - 1e-4))
    return logs


def score(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, head_share: float = HEAD_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    score is the whole model's: words seen in training are edges of the lattice too. lattice_score is the marginal over
    segmentations into the vocabulary's pieces alone.
    """
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    bounded_batches(spark)
    counts = materialise(word_counts(docs.select("text", "held_out")), "word-counts")
    known = F.col("c") > 0
    ends = F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))
    total = counts.agg(F.sum("c"), F.count(F.when(known, 1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1)), F.sum("seen"), ends).first()
    n, v, once, twice, seen, n_ends = (int(x or 0) for x in total)
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    vocabulary = read_vocabulary(vocabulary_path)
    logs = fit_pieces(counts, vocabulary)
    model = spark.sparkContext.broadcast((vocabulary, logs))
    spare = np.log(discount * v / n) if n else 0.0
    stop = (n_ends + 1) / (n + 2)  # chance of an end where the pieces alone speak

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for words, c, seen in _gathered(batches):
            c = np.array(c, float)
            spelled = lattice.log_probabilities([w.decode("utf-8", "surrogatepass") for w in words])
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0) / n) if n else np.full(len(c), -np.inf)
            log = np.logaddexp(whole, spare + spelled) / np.log(10)
            pure = np.where([w == END for w in words], np.log(stop), np.log1p(-stop) + spelled) / np.log(10)
            base = np.log10((c + 1) / (n + v + 1))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c > 0), pa.array(base), pa.array(log), pa.array(pure), pa.array(seen, pa.int64())], ["word", "known", "base", "log", "pure", "seen"])

    weighed = materialise(counts.mapInArrow(weigh, "word binary, known boolean, base double, log double, pure double, seen long"), "word-scores")
    # at most 1 / head_share words have so large a share of all tokens
    few = F.lit(seen <= 1 / head_share)
    frequent = few | (F.col("seen") >= F.lit(head_share * seen))
    head = spark.sparkContext.broadcast({bytes(r["word"]): (r["known"], r["base"], r["log"], r["pure"]) for r in weighed.where(frequent).select("word", "known", "base", "log", "pure").toLocalIterator()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = head.value
        fields = ["row", "word", "tf", "doc_id", "held_out", "n_tokens", "n_known", "base", "log", "pure"]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for rows, ids, texts, held in rows_of(parts_of(batches, 2)):
            out = []
            for row, doc_id, text, h in zip(rows, ids, texts, held):
                tokens = Counter(_tokens(text))
                size = hits = 0
                base = log = pure = 0.0
                rare = []
                for w, tf in tokens.items():
                    size += tf
                    got = table.get(w)
                    if got is None:
                        rare.append((w, tf))
                    else:
                        hits += tf * got[0]
                        base += tf * got[1]
                        log += tf * got[2]
                        pure += tf * got[3]
                own = (doc_id, h, size, hits, base, log, pure)
                if not rare:  # a key that no word has, as it holds a space, and no other document shares
                    out.append((row, b" %d" % row, 0, *own))
                for w, tf in rare:
                    out.append((row, w, tf, *own))
                    own = (None,) * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], fields)

    parts = docs.select("row", "doc_id", "text", "held_out").mapInArrow(count, "row long, word binary, tf int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double, pure double")
    rare = weighed.where(~frequent).select("word", F.col("known").alias("k2"), F.col("base").alias("b2"), F.col("log").alias("l2"), F.col("pure").alias("p2"))
    joined = parts.join(rare, "word", "left")
    add = lambda own, other: F.sum(F.coalesce(F.col(own), F.lit(0)) + F.col("tf") * F.coalesce(F.col(other).cast("double"), F.lit(0.0)))
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        add("n_known", "k2").cast("long").alias("n_known"), add("base", "b2").alias("base_score"), add("log", "l2").alias("score"), add("pure", "p2").alias("lattice_score"),
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def scored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score(docs, vocabulary_path())
