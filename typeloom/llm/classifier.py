"""Quality classifier: naive Bayes support vectors.

N-gram indicators of a whole text (words, and word shapes that mark repeats) are scaled by the log-count
ratio of the two classes; a linear hinge-loss model is then fitted by dual coordinate descent, and its
margin is mapped to a probability on rows kept out of the fit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.llm.common import WORD, drop_scratch, hold_cache, staged, unused_name

BITS = 18
#: The fit sees at most so many labelled documents, those of smallest hash, and of these so many indicators.
SAMPLE, INDICATORS = 4000, 20_000_000
THRESHOLD = 0.7
_WORD = re.compile(WORD)
_CACHE_WORDS = 400_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_REPEAT = np.uint64(0x2545F4914F6CDD1D)


def _mix(text: str, seed: int) -> int:
    """A 32-bit hash of a string that is the same in every process."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), seed)


def shape(word: str) -> str:
    """A whole word's shape: runs of capitals, small letters and digits as A, a, 9; other characters as they are, runs once."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = _mix(word.lower(), 1) << 32 | _mix(shape(word), 2)
        return found


_WORDS = _Words()


def _forget() -> None:
    global _WORDS
    _WORDS = _Words()


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct indices of the n-grams in a whole text; the last index is always there."""
    global _WORDS
    bias = np.array([(1 << bits) - 1], dtype=np.int32)
    words = _WORD.findall(text) if text else []
    if not words:
        return bias
    if len(_WORDS) > _CACHE_WORDS:
        _WORDS = _Words()
    both = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    form[1:][word[1:] == word[:-1]] ^= _REPEAT  # a word that repeats the one before
    grams = [word * _M1, word[:-1] * _M2 + word[1:] * _M1, form * _M3, form[:-1] * _M3 + form[1:] * _M2]
    grams.append(form[:-2] * _M1 + form[1:-1] * _M2 + form[2:] * _M3)
    hashed = np.concatenate(grams)
    hashed ^= hashed >> np.uint64(29)
    hashed *= _M2
    index = np.unique((hashed >> np.uint64(64 - bits)).astype(np.int32))
    return index if index[-1] == bias[0] else np.append(index, bias)


@dataclass
class Model:
    """Weights of the indicators (scaled by the log-count ratios) and the map from margin to probability."""

    weights: np.ndarray
    slope: float
    intercept: float

    def margin(self, index: np.ndarray) -> float:
        return float(self.weights[index].sum() / np.sqrt(len(index)))

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.intercept
        return float(1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(size, alpha) for _ in range(2)]
    for index, label in zip(rows, labels):
        counts[int(label)][index] += 1
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum cost_i max(0, 1 - y_i w x_i); classes weigh the same in all.

    One dual variable at a time is set to its best value in [0, cost_i], in an order drawn anew each
    epoch, until no variable moves much.
    """
    sign = np.where(labels > 0, 1.0, -1.0)
    share = {s: max(1, int((sign == s).sum())) for s in (1.0, -1.0)}
    most = np.array([cost * len(rows) / (2 * share[s]) for s in sign])
    norms = np.array([max(float(v @ v), 1e-12) for v in values])
    alpha, w, rng = np.zeros(len(rows)), np.zeros(size), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * float(w[rows[i]] @ values[i]) - 1.0
            after = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            step = after - alpha[i]
            if step:
                alpha[i] = after
                w[rows[i]] += step * sign[i] * values[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability, by Newton steps on smoothed targets."""
    n1, n0 = float((labels > 0).sum()), float((labels <= 0).sum())
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        gradient = x @ (p - target) + 1e-3 * theta
        hessian = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    """A model from indicator rows and 0/1 labels; with one class or none it gives the smoothed share of 1."""
    size, labels = 1 << bits, np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        share = (float(labels.sum()) + 1) / (len(labels) + 2)
        return Model(np.zeros(size, np.float32), 0.0, float(np.log(share / (1 - share))))
    out = np.arange(len(rows)) % 5 == 4
    if len(set(labels[~out].tolist())) < 2 or len(set(labels[out].tolist())) < 2:
        out = np.zeros(len(rows), bool)
    inner = [r for r, o in zip(rows, out) if not o]
    ratios = log_count_ratios(inner, labels[~out], size)
    values = [ratios[r] / np.sqrt(len(r)) for r in inner]
    w = dual_coordinate_descent(inner, values, labels[~out], size)
    model = Model((w * ratios).astype(np.float32), 1.0, 0.0)
    judged = range(len(rows)) if not out.any() else np.flatnonzero(out)
    margins = np.array([model.margin(rows[i]) for i in judged])
    model.slope, model.intercept = _sigmoid_fit(margins, labels[list(judged)])
    return model


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _indicator_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hold_cache("words", _forget)
    for batch in batches:
        found = [features(t if isinstance(t, str) else None) for t in batch["_text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "n": [len(g) for g in found], "grams": [g.tobytes() for g in found]})


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, indicators: int = INDICATORS) -> Model:
    """Fit on labelled documents that are not held out: at most ``sample`` of them, those of smallest hash.

    Labels other than 0 and 1 are left out; of several labels of a document the smallest counts; of
    several rows with its id the one whose text has the smallest hash is used. If the sample has more than
    ``indicators`` indicators in all, it ends where it reaches them (80 MB on the driver).
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).join(F.broadcast(taken), "doc_id")  # at most sample rows
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    found = rows.mapInPandas(_indicator_rows, "doc_id long, label int, n int, grams binary")
    found, path = staged(found.withColumn("place", F.xxhash64("doc_id")), "labelled")
    before = Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = found.select("doc_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).filter(F.col("before") < indicators)  # at most sample rows
    held = found.join(F.broadcast(chosen), "doc_id").orderBy("place", "doc_id").toPandas()
    drop_scratch(path)
    return fit([np.frombuffer(g, dtype=np.int32) for g in held["grams"]], held["label"].to_numpy())


def score_udf(model: Model):
    """A pandas UDF from a whole text to its score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold_cache("words", _forget)
        for texts in batches:
            yield pd.Series([model.score(t if isinstance(t, str) else None) for t in texts], dtype="float64")

    return score


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score in [0, 1] in column ``out``.

    Null and empty texts get the score of a text without n-grams; each row is scored alone from its
    text, so rows that repeat agree; other columns pass through. An empty table stays empty.
    """
    return docs.withColumn(out, score_udf(model)(F.col(text)))


def keep_predicted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs of predicted quality, with the columns of docs."""
    score = unused_name(docs, "score")
    return score_documents(docs, model, text, score).filter(F.col(score) >= threshold).drop(score)
