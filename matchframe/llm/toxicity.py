"""Toxic passages by maximum-scoring segments.

A token is a run of letters; its units are the word and its prefixes of 4 to 8 letters. Each unit's log-odds
between toxic and clean documents carry an informative Dirichlet prior (the unit's share over both classes), and
only units whose log-likelihood ratio is significant count. A token scores by its most certain unit, less a small
drift for every token, so clean text drifts down. One linear scan finds all maximal segments. Under the
extreme-value law a clean text of n tokens has a segment of score S or more with expectation k n exp(-S); k is
fitted on clean documents whose units were counted on the other half of the sample, several segments add up by
the sum statistic, and a logistic curve fitted on the same half turns the statistic into a probability.

The sample of labelled rows is bounded by `sample`; scoring covers all rows. Null text counts as empty and gets
the score of a text without a toxic segment. Null ids are never learned from. Several labels of one id: the
largest holds. With no labelled rows of either class every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, held_out, materialise, parts_of, rows_of

#: Fixed values of the method.
SAMPLE = 20_000
DRIFT, PRIOR_DOCS, LEAST_G2, LEAST_DOCS = 0.1, 10.0, 15.0, 4
PREFIXES = (4, 5, 6, 7, 8)
NO_SEGMENT, TOP = -8.0, 60.0
_LETTERS = re.compile(r"[^\W\d_]+")


def tokens_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def units_of(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


class TokenScores(dict):
    """Score of each word, worked out when first met; emptied when large."""

    def __init__(self, units: dict[str, tuple[float, float]]) -> None:
        super().__init__()
        self.units = units

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        best = max((self.units[u] for u in units_of(word) if u in self.units), default=(0.0, 0.0))
        self[word] = best[1]
        return best[1]


def maximal_segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first token, end) of tokens that score -drift each, but those listed (place, score)."""
    items: list[tuple[int, float]] = []
    last = -1
    for at, s in scores:
        if at > last + 1:
            items.append((last + 1, -drift * (at - last - 1)))
        items.append((at, s - drift))
        last = at
    total, found = 0.0, []  # found: left sum, right sum, first item, end item
    for k, (_, s) in enumerate(items):
        before, total = total, total + s
        if s <= 0:
            continue
        left, right, first = before, total, k
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
        found.append((left, right, first, k))
    return [(right - left, items[first][0], items[end][0] + 1) for left, right, first, end in found]


def segments_of(words: list[str], scores: TokenScores) -> list[tuple[float, int, int]]:
    values = np.fromiter(map(scores.__getitem__, words), float, len(words))
    return maximal_segments([(int(k), float(values[k])) for k in np.flatnonzero(values)])


def statistic(segments: list[float], tokens: int, k: float) -> float:
    """The best sum of the r highest normalised scores, less log r!; NO_SEGMENT where there is none."""
    best, total = NO_SEGMENT, 0.0
    shift = math.log(max(tokens, 1) * k)
    for r, s in enumerate(sorted(segments, reverse=True), 1):
        total += s - shift
        best = max(best, total - math.lgamma(r + 1))
    return best if segments else NO_SEGMENT


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, modulus: int, remainder: int, sample: int) -> DataFrame:
    """y, half, text of a bounded sample of the labelled rows outside the held-out ones; kept in the shared folder."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("lid")).agg(F.max(label).cast("int").alias("y"))
    known = bounded_sample(materialise(known.where(~held_out(F.col("lid"), modulus, remainder)), "labels"), "lid", sample)
    known = known.withColumn("half", F.pmod(F.xxhash64("lid", F.lit(1)), F.lit(2)).cast("int"))
    # about `sample` rows of three numbers
    joined = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("did") == F.col("lid"))
    return materialise(joined.select("y", "half", "text"), "labelled")


def count_units(rows: DataFrame) -> DataFrame:
    """unit and, for each label and half, the number of documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(4)]

        def out() -> pa.RecordBatch:
            units = list(set().union(*held))
            return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *(pa.array([c[u] for u in units], pa.int64()) for c in held)], ["unit", "c0", "c1", "t0", "t1"])

        for ys, halves, texts in rows_of(parts_of(batches, 2)):
            for y, half, text in zip(ys, halves, texts):
                held[2 * y + half].update({u for w in set(tokens_of(text)) for u in units_of(w)})
            if sum(map(len, held)) > 400_000:
                yield out()
                for c in held:
                    c.clear()
        yield out()

    raw = rows.mapInArrow(run, "unit string, c0 long, c1 long, t0 long, t1 long")
    return raw.groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "t0", "t1"))).where(F.col("c0") + F.col("c1") + F.col("t0") + F.col("t1") >= LEAST_DOCS)


def log_odds(counts: DataFrame, toxic: str, clean: str, toxic_docs: int, clean_docs: int) -> dict[str, tuple[float, float]]:
    """unit -> (certainty, log-odds) of the significant units. Their number is bounded by the sample's: each is in LEAST_DOCS of its documents at least."""
    t, c = F.expr(toxic), F.expr(clean)
    both, docs = t + c, toxic_docs + clean_docs
    prior = PRIOR_DOCS * both / docs
    odds = F.log((t + prior) / (toxic_docs + PRIOR_DOCS - t - prior + 0.5)) - F.log((c + prior) / (clean_docs + PRIOR_DOCS - c - prior + 0.5))
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (both * F.lit(share)))).otherwise(0.0)
    g2 = 2 * (part(t, toxic_docs / docs) + part(c, clean_docs / docs))
    rows = counts.select("unit", odds.alias("odds"), g2.alias("g2")).where(F.col("g2") >= LEAST_G2)
    return {r["unit"]: (r["g2"], r["odds"]) for r in rows.collect()}


def logistic_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with targets drawn in from 0 and 1 as Platt does; the slope stays above 0."""
    ones, zeros = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 0.1, math.log((ones + 1) / (zeros + 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - target) * x).sum() + 1e-3 * a, (weight * (p - target)).sum()])
        h = weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -3, 3))
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0, sample: int = SAMPLE) -> dict | None:
    """The model: units, k, slope and intercept; None where a class is missing."""
    bounded_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, id_col, text_col, modulus, remainder, sample)
    sizes = {(r["y"], r["half"]): r["n"] for r in rows.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda y, *halves: sum(sizes.get((y, h), 0) for h in halves)
    if not all(size(y, h) for y in (0, 1) for h in (0, 1)):
        return None
    counts = materialise(count_units(rows), "units")
    context = rows.sparkSession.sparkContext
    half = context.broadcast(log_odds(counts, "t0", "c0", size(1, 0), size(0, 0)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = TokenScores(half.value)
        for ys, _, texts in rows_of(parts_of(batches, 2)):
            words = [tokens_of(t) for t in texts]
            found = [[s for s, _, _ in segments_of(w, scores)] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([max(len(w), 1) for w in words], pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["y", "n", "found"])

    scanned = materialise(rows.where("half = 1").mapInArrow(scan, "y int, n long, found array<double>"), "segments")
    top = F.coalesce(F.array_max("found"), F.lit(0.0))
    hits, mass = scanned.where("y = 0").agg(F.count(F.when(F.size("found") > 0, 1)), F.sum(F.col("n") * F.exp(-top))).first()
    k = (hits + 1) / max(float(mass or 0), 1.0)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ys, ns, found in rows_of(batches):
            x = [int(round(2 * min(statistic(f, n, k), TOP))) for f, n in zip(found, ns)]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(x, pa.int32())], ["y", "x"])

    table = np.array([tuple(r) for r in scanned.mapInArrow(bins, "y int, x int").groupBy("x", "y").count().collect()], float)
    slope, intercept = logistic_curve(table[:, 0] / 2, table[:, 1], table[:, 2])
    units = log_odds(counts, "t0 + t1", "c0 + c1", size(1, 0, 1), size(0, 0, 1))
    return {"units": units, "k": k, "slope": slope, "intercept": intercept}


def judge(text: str | None, model: dict | None, scores: TokenScores | None) -> tuple[float, list[tuple[float, int, int]], int]:
    """Probability, maximal segments and tokens of a text. One rule for scoring and for dropping."""
    if not model:
        return 0.0, [], 0
    words = tokens_of(text)
    found = segments_of(words, scores)
    x = min(statistic([s for s, _, _ in found], len(words), model["k"]), TOP)
    return 1 / (1 + math.exp(-min(max(model["slope"] * x + model["intercept"], -30), 30))), found, len(words)


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and passages (first and end token of each segment that few clean texts have)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = TokenScores(m["units"]) if m else None
        for batch in parts_of(batches, 2):
            values, passages = [], []
            for text in batch.column(2).to_pylist():
                value, found, n = judge(text, m, scores)
                values.append(value)
                passages.append([f"{i}:{j}" for s, i, j in found if m["k"] * n * math.exp(-s) < 0.05])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values), pa.array([int(v >= 0.5) for v in values], pa.int32()), pa.array(map(len, passages), pa.int32()), pa.array(map(",".join, passages), pa.string())],
                ["doc_id", "held_out", "score", "predicted", "n_passages", "passages"],
            )

    did = F.col(id_col).cast("long")
    return docs.select(did.alias("doc_id"), held_out(did, modulus, remainder).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages int, passages string")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; same columns. The decision is taken where the text is, so no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = TokenScores(m["units"]) if m else None
        for batch in parts_of(batches, at):
            yield batch.filter(pa.array([judge(text, m, scores)[0] < 0.5 for text in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
