"""Document quality by Bradley-Terry pairwise ranking.

Each document has a strength ``s = w . f(text)``; that one is preferred to
another has probability ``sigmoid(s_i - s_j)``. The weights minimise the
logistic loss on feature differences of preference pairs, which labels give: any
document marked good is preferred to any marked bad. The strengths of the
labelled sample then turn a strength into a quantile, and the quantile at which
the share of bad documents ends is put at ``cut``, so that keeping scores of
``cut`` and above drops that share from the bottom of the ranking.

The features are shape statistics of the whole text (lengths, character
classes, repetition of words, lines and characters), none of a language or of
words by name. Fitting uses at most ``max_labelled`` labelled documents of the
training folds (crc32 of the id modulo 5 not 0), chosen by a hash of the id.

Defined cases: a null text is an empty one, whose features are 0 and which is
scored like any other; null ids are scored (held out); repeated rows get equal
scores; empty tables give an empty result; if labels lack either class every
score is 1. Extra columns are not looked at by ``score_documents`` and kept by
``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of, held_out, labelled_sample, slices, utf8

MAX_LABELLED = 20_000
PAIRS = 200_000
CUT = 0.3
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".", "comma": b",;:", "loud": b"!?", "bar": b"|", "sign": b"#$%&*@^~=+", "bracket": b"<>{}[]()", "slash": b"/\\_-", "quote": b"'\"`"}
_ORDER = list(_CLASSES)
_CLASS_OF = np.full(256, len(_ORDER), np.int64)
for _k, _name in enumerate(_ORDER):
    _CLASS_OF[list(_CLASSES[_name])] = _k
_CLASS_OF[128:] = len(_ORDER) + 1
N_FEATURES = len(_ORDER) + 1 + 15


def features(text: str | None) -> np.ndarray:
    """Shape statistics of a text."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    out = np.zeros(N_FEATURES)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(_CLASS_OF, weights=counts, minlength=len(_ORDER) + 2)
    solid = max(1, len(raw) - int(counts[[32, 9, 10, 11, 12, 13]].sum()))
    out[: len(_ORDER)] = np.sqrt(classes[: len(_ORDER)] / solid)
    out[len(_ORDER)] = np.sqrt(classes[len(_ORDER) + 1] / solid)
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = counts[counts > 0] / len(raw)
    bare = raw.count(b"|") / n
    out[len(_ORDER) + 1 :] = [
        np.log1p(n) / 10, np.log1p(lengths.mean()), np.log1p(lengths.max()) / 5, (lengths <= 3).mean(), distinct / n, np.log(n / distinct), pairs / max(1, n - 1), np.sqrt(repeats / n),
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))) / 5, np.log1p(n / (1 + classes[_ORDER.index("stop")])) / 5, float(-(share * np.log2(share)).sum()) / 8, min(1.0, bare), min(2.0, (classes[_ORDER.index("loud")] + classes[_ORDER.index("sign")]) / n), float(lengths.std()) / 10,
    ]
    return out


def expand(f: np.ndarray) -> np.ndarray:
    """Features with their squares, so that a strength can have its best value in the middle."""
    return np.hstack([f, f * f])


@dataclass
class Model:
    """Weights of standardised features, and the labelled sample's strengths as a quantile scale."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(2 * N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(2 * N_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * N_FEATURES))
    strengths: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def strength(self, f: np.ndarray) -> np.ndarray:
        return np.clip((expand(f) - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        if not len(self.strengths):
            return np.ones(len(f))
        return np.clip(np.interp(self.strength(f), self.strengths, self.scores), 0, 1)


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Bradley-Terry weights: logistic loss on differences x_i - x_j with i good, j bad (Adam on random pair batches)."""
    rng = np.random.default_rng(seed)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    i, j = rng.choice(a, pairs), rng.choice(b, pairs)
    w, first, second = np.zeros(x.shape[1]), 0.0, 0.0
    batch = max(1, min(pairs, 8192))
    for step in range(1, steps + 1):
        at = rng.integers(0, pairs, batch)
        d = x[i[at]] - x[j[at]]
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        grad = -(d * p[:, None]).mean(axis=0) + decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def fit_model(f: np.ndarray, good: np.ndarray, cut: float = CUT, knots: int = 2000) -> Model:
    """The model from features and labels of a sample."""
    if not good.any() or good.all():
        return Model()
    x = expand(f)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model = Model(mean, scale, fit_pairs(np.clip((x - mean) / scale, -8, 8), good))
    s = np.sort(model.strength(f))
    # Quantiles of the ranking; the share of bad documents is the part below ``cut``.
    bad = int((~good).sum())
    middle = (s[bad - 1] + s[bad]) / 2
    below = np.linspace(0, cut, bad + 1)[:-1]
    above = np.linspace(cut, 1, len(s) - bad + 1)[1:]
    points, values = np.concatenate([s[:bad], [middle], s[bad:]]), np.concatenate([below, [cut], above])
    if len(points) > knots:
        at = np.unique(np.concatenate([np.linspace(0, len(points) - 1, knots).astype(int), [bad - 1, bad, bad + 1]]))
        points, values = points[at], values[at]
    keep = np.concatenate([[True], np.diff(points) > 0])
    model.strengths, model.scores = points[keep], values[keep]
    return model


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t).tolist() for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "label", "f"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, cut: float = CUT) -> Model:
    """The model, from at most ``max_labelled`` labelled documents."""
    known = labelled_sample(docs, labels, label_col, max_labelled, id_col, text_col).select(F.col("doc_id").cast("bigint"), "label", "text")
    got = known.mapInArrow(_features_of, "doc_id bigint, label int, f array<double>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    if not got.num_rows:
        return Model()
    return fit_model(np.stack([np.array(v) for v in got.column("f").to_pylist()]), np.array(got.column("label").to_pylist()) == 1, cut)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(shared.value.score(np.stack([features(t) for t in texts])))

    return score(docs[text_col])


def score_documents(docs: DataFrame, model: Model, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    own = columns_of(docs, id_col, text_col)
    out = own.select(F.col(id_col).alias("doc_id"), held_out(own[id_col]).alias("held_out"), scored(own, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """Rows whose score reaches ``cut``, with their columns as they were."""
    return docs.where(scored(docs, model, text_col) >= cut)
