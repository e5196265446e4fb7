"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Indicators of a text, each hashed to one of 2^18 numbers:
- its distinct words, lower-cased
- n-grams (n = 1 .. 3) of character classes (lower, upper, digit, break, line end, other letter, each punctuation
  character by itself) with runs collapsed, each also at every level 2^-j (j = 1 .. 8) that its share of the text exceeds
- the share of repeated words, of words equal to the one before, and of repeated lines, in such levels

Each indicator is scaled by its naive Bayes log-count ratio r = log((p + a) / |p|) - log((q + a) / |q|), the vectors
have length one, and a linear hinge-loss model is fitted to them by dual coordinate descent. A logistic curve through
the training margins turns margins into scores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnledger.llm import common

BITS = 18
ORDERS = 3
LEVELS = 8
PER_CLASS = 1500  # training texts of each class
MAX_TRAINING_CHARS = 20_000  # longer texts are not trained on; every text is scored whole
SMOOTHING = 1.0
COST = 1.0
SWEEPS = 30
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_CLASSES = 48

_class_of: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of each code point: 0 break, 1 line end, 2 lower, 3 upper, 4 digit, 5 other letter, 6 other, 7 .. ASCII punctuation."""
    global _class_of
    if _class_of is None:
        table = np.full(0x110000, 6, np.uint8)
        for i in range(0x3000):
            c = chr(i)
            table[i] = 1 if c == "\n" else 0 if c.isspace() else 2 if c.islower() else 3 if c.isupper() else \
                4 if c.isdigit() else 5 if c.isalpha() else 6
        table[0x3000:] = 5
        signs = [i for i in range(33, 127) if not chr(i).isalnum()]
        table[signs] = np.arange(7, 7 + len(signs))
        _class_of = table
    return _class_of


def _levels(name: str, share: float) -> list[str]:
    return [f"{name}>{j}" for j in range(1, LEVELS + 1) if share > 2.0**-j]


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct indicator numbers of a text; null and empty texts have the one for "no text"."""
    if not text:
        return np.array([zlib.crc32(b"no text") >> (32 - BITS)], np.int64)
    words = text.lower().split()
    found = {zlib.crc32(w.encode("utf-8", "replace")) for w in set(words)}
    n = max(1, len(words))
    lines = [line for line in text.split("\n") if line]
    names = _levels("repeated", 1 - len(set(words)) / n) + _levels("again", sum(map(eq, words, words[1:])) / n)
    names += _levels("lines", 1 - len(set(lines)) / max(1, len(lines)))
    found.update(zlib.crc32(x.encode(), 7) for x in names)
    kinds = _classes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
    kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])]
    parts, gram = [np.fromiter((h >> (32 - BITS) for h in found), np.int64, len(found))], kinds + 1
    for order in range(1, ORDERS + 1):
        if len(gram) == 0:
            break
        codes, counts = np.unique(gram, return_counts=True)
        level = np.minimum(LEVELS + 1, np.floor(-np.log2(counts / len(gram))).astype(np.int64) + 1)
        for j in range(LEVELS + 2):
            reached = codes[level <= j] if j <= LEVELS else codes
            mixed = (reached * 16 + j).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            parts.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        gram = gram[:-1] * (_CLASSES + 1) + kinds[order:] + 1
    return np.unique(np.concatenate(parts))


@dataclass
class Model:
    """Weight of each indicator in the margin, its scale, and the curve (slope, shift) from margins to scores."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        scale = np.sqrt(np.square(self.ratio[found]).sum()) or 1.0
        return float((self.weight[found] * self.ratio[found]).sum() / scale + self.bias)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.shift, -35, 35))))


def fit(rows: list[tuple[str | None, int]], cost: float = COST, sweeps: int = SWEEPS) -> Model:
    """Fits on (text, 0 or 1) pairs. Without both classes every score is the share of class 1 (0.5 without rows)."""
    size = 1 << BITS
    sets = [indicators(t) for t, _ in rows]
    y = np.array([1.0 if label else -1.0 for _, label in rows])
    n_pos, n_neg = int((y > 0).sum()), int((y < 0).sum())
    if not n_pos or not n_neg:
        share = min(max((n_pos / len(rows)) if rows else 0.5, 0.001), 0.999)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    p, q = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    for found, sign in zip(sets, y, strict=True):
        (p if sign > 0 else q)[found] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [ratio[s] for s in sets]
    values = [v / (np.sqrt(np.square(v).sum()) or 1.0) for v in values]
    # Both classes carry the same total cost.
    upper = np.where(y > 0, cost * len(y) / (2 * n_pos), cost * len(y) / (2 * n_neg))
    weight, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(sweeps):
        moved = 0.0
        for i in order.permutation(len(y)):
            found, v = sets[i], values[i]
            slack = y[i] * (weight[found] @ v + bias) - 1
            new = min(max(alpha[i] - slack / 2.0, 0.0), upper[i])  # the vector and the constant have length one each
            step = (new - alpha[i]) * y[i]
            if step:
                weight[found] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    model = Model(ratio, weight, bias, 1.0, 0.0)
    margins = np.array([weight[s] @ v + bias for s, v in zip(sets, values, strict=True)])
    # Logistic curve, with targets kept off 0 and 1; a weak pull on the slope keeps separable samples finite.
    target = np.where(y > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -35, 35)))
        d, h = s - target, np.maximum(s * (1 - s), 1e-9)
        grad = np.array([d @ margins + 1e-2 * (slope - 1), d.sum()])
        hess = np.array([[h @ np.square(margins) + 1e-2, h @ margins], [h @ margins, h.sum() + 1e-6]])
        change = np.linalg.solve(hess, grad)
        slope, shift = slope - change[0], shift - change[1]
        if np.abs(change).max() < 1e-8:
            break
    return Model(ratio, weight, bias, float(slope), float(shift)) if slope > 0 else model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fits on at most per_class labelled rows of each class outside the held-out fold."""
    rows = labels.where((common.fold(F.col(f"`{id_col}`").cast("long")) != 0) & F.col(f"`{label_col}`").isin(0, 1))
    picked = common.bounded_sample(rows, id_col, label_col, per_class).collect()  # at most per_class ids a class
    if not picked:
        return fit([])
    named = docs.sparkSession.createDataFrame([(r["id"], int(r["label"])) for r in picked], "doc_id long, label int")
    texts = (common.keyed(docs, id_col, text_col).join(F.broadcast(named), "doc_id")
             .where(F.length(F.coalesce("text", F.lit(""))) <= MAX_TRAINING_CHARS)
             .groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect())
    return fit([(r["text"], r["label"]) for r in sorted(texts, key=lambda r: r["doc_id"])])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """Score of every whole text, null and empty ones included; rows with null or repeated ids get a row each.

    A null id counts as held out. Extra columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        score = np.array([model.score(t) for t in batch.column(2).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score, pa.float64()),
             pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = common.keyed(docs, id_col, text_col).select("doc_id", (common.fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return common.per_slice(rows, run, SCHEMA)


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score reaches the threshold; each row is judged by its own text."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [shared.value.score(t) >= threshold for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array(keep, pa.bool_()))

    return common.per_slice(docs, run, docs.schema)
