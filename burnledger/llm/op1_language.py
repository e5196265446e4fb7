"""Language identification by a string kernel, Nystroem landmarks and kernel ridge regression.

Kernel: the blended spectrum of character n-grams (n = 1 .. 3) by presence, k(x, y) = shared n-grams / sqrt(|x| |y|),
over lower-cased letters with one break sign for each run of other characters.

Training (a bounded sample, on the driver): of PER_LANGUAGE sampled texts a language, LANDMARKS serve as landmarks L.
With K the kernel, the Nystroem features of x are K(x, L) K(L, L)^(-1/2), and one ridge regression on 0/1 targets a
language (one versus the rest) gives weights W.

Scoring: with P the presence matrix of a batch over the landmarks' n-grams and B that of the landmarks, the outputs
are diag(1/sqrt|x|) P [B^T diag(1/sqrt|l|) K(L, L)^(-1/2) W]. The bracket is multiplied out once; each batch is one
sparse-dense product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnledger.llm import common

ORDERS = 3
PER_LANGUAGE = 300  # training texts of each language
LANDMARKS = 50  # of them
MAX_TRAINING_CHARS = 20_000  # longer texts are not trained on; every text is scored whole
RIDGE = 1e-3
SHARPNESS = 6.0  # of the softmax over the regressions' outputs
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_BITS = 21  # of a code point

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def grams(text: str | None) -> np.ndarray:
    """The distinct n-grams of a text as sorted numbers; none if it has no letter."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _is_letter()[codes]
    if not letters.any():
        return np.zeros(0, np.uint64)
    signs = np.where(letters, codes, 1).astype(np.uint64)
    signs = signs[letters | np.append(True, letters[:-1])]  # one sign for each run of others
    inner = signs[int(signs[0] == 1) : len(signs) - int(signs[-1] == 1)]
    signs = np.concatenate([[np.uint64(1)], inner, [np.uint64(1)]])
    out, gram = [signs], signs
    for _ in range(1, ORDERS):
        gram = (gram[:-1] << np.uint64(_BITS)) | signs[len(signs) - len(gram) + 1 :]
        out.append(gram)
    return np.unique(np.concatenate(out))


@dataclass
class Model:
    """Learned languages, the landmarks' n-grams and the multiplied-out weights (n-grams by languages)."""

    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray

    def outputs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of a batch (texts by languages) and which texts have a letter."""
        sets = [grams(t) for t in texts]
        sizes = np.array([len(s) for s in sets])
        known = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        out = np.zeros((len(sets), len(self.languages)))
        if len(self.vocabulary) and len(known):
            at = np.searchsorted(self.vocabulary, known)
            at[at == len(self.vocabulary)] = 0
            hit = self.vocabulary[at] == known
            for k in range(out.shape[1]):
                out[:, k] = np.bincount(owner[hit], self.weights[at[hit], k], len(sets))
        return out / np.sqrt(np.maximum(sizes, 1))[:, None], sizes > 0


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fits on (text, language) pairs; the first `landmarks` texts of each language are the landmarks."""
    languages = sorted({lang for _, lang in rows})
    data = [(grams(text), lang) for text, lang in rows]
    data = [(g, lang) for g, lang in data if len(g)]
    marks = [g for name in languages for g in [g for g, lang in data if lang == name][:landmarks]]
    if not marks:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    vocabulary = np.unique(np.concatenate(marks))
    base = np.zeros((len(marks), len(vocabulary)), np.float32)
    for i, g in enumerate(marks):
        base[i, np.searchsorted(vocabulary, g)] = 1 / np.sqrt(len(g))

    def kernel(sets: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(sets), len(marks)))
        for i, g in enumerate(sets):
            at = np.searchsorted(vocabulary, g)
            at[at == len(vocabulary)] = 0
            rows[i] = base[:, at[vocabulary[at] == g]].sum(axis=1) / np.sqrt(len(g))
        return rows

    values, vectors = np.linalg.eigh(kernel(marks))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K(L, L)^(-1/2), without directions that carry nothing
    features = kernel([g for g, _ in data]) @ root
    targets = np.array([[float(lang == name) for name in languages] for _, lang in data])
    # Every language weighs the same, whatever its share of the sample.
    weight = np.sqrt((1 / targets.sum(axis=0))[targets.argmax(axis=1)])[:, None]
    a, b = features * weight, targets * weight
    solved = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b)
    return Model(languages, vocabulary, base.T.astype(np.float64) @ (root @ solved))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Fits on at most per_language rows of each language outside the held-out fold; null languages teach nothing."""
    rows = docs.where(common.fold(F.col(f"`{id_col}`").cast("long")) != 0)
    sample = common.bounded_sample(rows, id_col, lang_col, per_language)
    picked = sample.collect()  # at most per_language ids a language
    if not picked:
        return fit([])
    named = docs.sparkSession.createDataFrame([(r["id"], str(r["label"])) for r in picked], "doc_id long, label string")
    texts = (common.keyed(docs, id_col, text_col).join(F.broadcast(named), "doc_id")
             .where(F.length("text") <= MAX_TRAINING_CHARS).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
             .collect())
    return fit([(r["text"], r["label"]) for r in sorted(texts, key=lambda r: r["doc_id"])])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and score of every whole text.

    Null, empty and letterless texts are `und` with score 0, as are all if nothing was learned. The score is a softmax
    over the languages' outputs. Rows with null or repeated ids get a row each (a null id counts as held out).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        out, lettered = model.outputs(batch.column(2).to_pylist())
        if not model.languages:
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([UNKNOWN] * batch.num_rows, pa.string()),
                 pa.array(np.zeros(batch.num_rows))], ["doc_id", "held_out", "lang_pred", "score"])
        soft = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
        best = out.argmax(axis=1)
        sure = soft.max(axis=1) / soft.sum(axis=1)
        names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(lettered, sure, 0.0))],
            ["doc_id", "held_out", "lang_pred", "score"])

    rows = common.keyed(docs, id_col, text_col).select("doc_id", (common.fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return common.per_slice(rows, score, SCHEMA)


def identify(docs: DataFrame, **columns: str) -> DataFrame:
    """Trains on the table's own labelled rows and predicts every row."""
    return predict(docs, train(docs, **columns), **{k: v for k, v in columns.items() if k != "lang_col"})
