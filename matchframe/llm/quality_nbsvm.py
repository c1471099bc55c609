"""Quality by naive-Bayes support vectors.

Indicators of word unigrams and of 1- to 4-grams over word shapes are scaled by the log ratio of their smoothed
class counts; a linear model with hinge loss is fitted on them by dual coordinate descent, and a logistic curve
fitted on a fifth of the sample that the model has not seen gives probabilities. Indicators are told apart exactly, by
the n-grams themselves: the vocabulary is that of the sample.

The fit takes a bounded sample of labelled rows (`sample`) in one task; scoring covers all rows where they are.
Null text counts as empty and gets the score of a text without indicators. Null ids are never learned from.
Several labels of one id: the largest holds. Where a class is missing every score is the share of the label 1
(0.5 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, parts_of, rows_of
from .toxicity import labelled_sample, logistic_curve

#: Fixed values of the method.
SAMPLE, LEAST_DOCS, EPOCHS, COST = 8_000, 3, 12, 1.0
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


class Shapes(dict):
    """Word -> one character for its shape."""

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        if token[0].isalpha():
            shape = "X" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "x"
        else:
            shape = "9" if token[0].isdigit() else token
        self[token] = shape
        return shape


def indicators(text: str | None, shapes: Shapes) -> set[str]:
    """The text's different words and, behind a NUL, its different n-grams of shapes."""
    tokens = _TOKEN.findall(text or "")
    line = "".join(map(shapes.__getitem__, tokens))
    if len(tokens) > 1:
        again = {i for i, (a, b) in enumerate(zip(tokens, tokens[1:]), 1) if a == b and a[0].isalpha()}
        if again:
            line = "".join("=" if i in again else c for i, c in enumerate(line))
    grams = set()
    for parts in ((line,), (line, line[1:]), (line, line[1:], line[2:]), (line, line[1:], line[2:], line[3:])):
        grams.update("\0" + "".join(g) for g in set(zip(*parts)))
    return grams.union(tokens)


def train(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 42) -> tuple[np.ndarray, float]:
    """Weights and class log-count ratios of the indicators (numbers from 0), and bias. y is -1 or 1."""
    size = 1 + max((int(x.max()) for x in rows if len(x)), default=-1)
    ones, zeros, seen = np.ones(size), np.ones(size), np.zeros(size)
    for x, side in zip(rows, y):
        (ones if side > 0 else zeros)[x] += 1
        seen[x] += 1
    ratio = np.log((ones / ones[seen > 0].sum()) / (zeros / zeros[seen > 0].sum()))
    ratio[seen < LEAST_DOCS] = 0
    data = []
    for x in rows:
        x = x[ratio[x] != 0]
        v = ratio[x]
        data.append((x, v / max(np.sqrt((v * v).sum()), 1e-9)))
    w, bias, alpha, draw = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            x, v = data[i]
            slope = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / (v @ v + 1), 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.stack([w, ratio]), bias


def decision(x: np.ndarray, weights: np.ndarray, bias: float) -> float:
    v = weights[1][x]
    return float(weights[0][x] @ v / max(np.sqrt((v * v).sum()), 1e-9) + bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0, sample: int = SAMPLE) -> dict:
    """The model; its size is that of the sample's vocabulary, whatever the corpus."""
    bounded_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, id_col, text_col, modulus, remainder, sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for ys, _, texts in rows_of(parts_of(batches, 2)):
            found = [sorted(indicators(t, shapes)) for t in texts]
            fold = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % 5 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(fold, pa.int32()), pa.array(found, pa.list_(pa.string()))], ["y", "fold", "x"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, folds, sizes, grams = [], [], [], []
        for batch in batches:
            ys += batch.column(0).to_pylist()
            folds += batch.column(1).to_pylist()
            sizes += pc.list_value_length(batch.column(2)).to_pylist()
            grams.append(batch.column(2).flatten())
        names = ["what", "gram", "w", "ratio"]
        if len(set(ys)) < 2:
            yield pa.RecordBatch.from_arrays([pa.array(["constant"]), pa.array([""]), pa.array([float(np.mean(ys)) if ys else 0.5]), pa.array([0.0])], names)
            return
        coded = pa.chunked_array(grams).dictionary_encode().combine_chunks()
        in_order = pc.sort_indices(coded.dictionary)
        vocabulary, number = coded.dictionary.take(in_order), np.argsort(in_order.to_numpy())
        xs = [np.sort(x) for x in np.split(number[coded.indices.to_numpy()], np.cumsum(sizes)[:-1])]
        order = sorted(range(len(ys)), key=lambda i: (folds[i], ys[i], xs[i].tolist()))  # the fit must not hang on the order rows arrive in
        y, fold, xs = np.array(ys)[order], np.array(folds)[order], [xs[i] for i in order]
        side = np.where(y == 1, 1.0, -1.0)
        inner, outer = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
        if len(set(y[inner].tolist())) < 2 or len(set(y[outer].tolist())) < 2:
            inner = outer = np.arange(len(y))
        weights, bias = train([xs[i] for i in inner], side[inner])
        known = weights.shape[1]
        seen = np.array([decision(xs[i][xs[i] < known], weights, bias) for i in outer])
        slope, intercept = logistic_curve(seen, y[outer], np.ones(len(outer)))
        at = np.flatnonzero(weights[1])
        yield pa.RecordBatch.from_arrays([pa.array(["bias", "curve"]), pa.array(["", ""]), pa.array([bias, slope]), pa.array([0.0, intercept])], names)
        yield pa.RecordBatch.from_arrays([pa.array(["gram"] * len(at), pa.string()), vocabulary.take(pa.array(at)), pa.array(weights[0][at]), pa.array(weights[1][at])], names)

    # a bounded sample, so one task can hold it; the indicators are made by many
    held = rows.mapInArrow(features, "y int, fold int, x array<string>").repartition(1).mapInArrow(solve, "what string, gram string, w double, ratio double").collect()
    model = {"bias": 0.0, "slope": 1.0, "intercept": 0.0, "constant": None}
    for r in held:
        if r["what"] == "curve":
            model["slope"], model["intercept"] = r["w"], r["ratio"]
        elif r["what"] != "gram":
            model[r["what"]] = r["w"]
    grams = [r for r in held if r["what"] == "gram"]
    return model | {"number": {r["gram"]: k for k, r in enumerate(grams)}, "weights": np.array([[r["w"] for r in grams], [r["ratio"] for r in grams]])}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shapes = shared.value, Shapes()
        number = m.get("number", {})
        known = lambda t: np.array(sorted(number[g] for g in indicators(t, shapes) if g in number), np.int64)
        for ids, held, texts in rows_of(parts_of(batches, 2)):
            if m["constant"] is not None:
                values = np.full(len(ids), m["constant"])
            else:
                raw = np.array([decision(known(t), m["weights"], m["bias"]) for t in texts])
                values = 1 / (1 + np.exp(-np.clip(m["slope"] * raw + m["intercept"], -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    did = F.col(id_col).cast("long")
    return docs.select(did.alias("doc_id"), held_out(did, modulus, remainder).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
