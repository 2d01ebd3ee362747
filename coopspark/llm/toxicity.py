"""Toxicity by non-negative positive-unlabelled learning.

Known are documents confirmed as toxic (P) and documents of which nothing is
known (U); confirmed clean ones aren't used as such. With class prior ``pi``, the
risk of a scorer is ``pi R_P+ + max(0, R_U- - pi R_P-)``: the unlabelled text's
negative risk, corrected by the share that positives have in it. Where the
corrected part turns negative, which only overfitting can cause, the step goes
back on it. The scorer is logistic on the presence of words and of word
beginnings (``PREFIXES`` letters, for languages that inflect and compound);
those are kept whose document frequencies in P and U differ beyond chance (a
likelihood-ratio statistic above ``FLOOR``; documents of U that are confirmed don't
count there), the strongest of them: ``MAX_FEATURES`` and one more for every four
confirmed documents of the sample. Weak ones are left to the weight decay.

Fitting uses bounded samples: ``max_positive`` confirmed and ``max_unlabelled``
other documents of the training folds (crc32 of the id modulo 5 not 0), chosen
by a hash of the id. The prior is the share of toxic among labelled rows of
those folds, counted over all of them. Scoring is one map over whole texts.

Defined cases: a null or empty text has no words and gets the score of the bias;
null ids are scored (and count as held out, as the empty id's crc32 is 0);
repeated rows get equal scores; empty tables give an empty result; without any
confirmed example every score is 0. Extra columns are not looked at by
``score_documents`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of, held_out, labelled_sample, one_text, slices
from coopspark.plans.stage import split_count, written

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 10_000
MAX_FEATURES = 600
PREFIXES = (3, 4, 5, 6, 7, 8)
FLOOR = 15.0  # of the likelihood ratio, at every size
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")
_seen: dict[str, tuple[str, ...]] = {}
_seen_by: list = [None]


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters."""
    return set(_WORD.findall((text or "").lower()))


def keys_of(word: str) -> list[str]:
    """The features that a word shows: itself, marked with $, and its beginnings, marked with *."""
    return [f"{word}$", *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Feature weights and a bias; bounded by MAX_FEATURES and the sample's bound, whatever the corpus."""

    bias: float = -np.inf
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        # The worker's cache serves one model at a time: broadcast models outlive their job in a worker.
        if _seen_by[0] is not self or len(_seen) > CACHE_WORDS:
            _seen.clear()
            _seen_by[0] = self
        found: set[str] = set()
        for w in words_of(text) if self.weights else ():
            keys = _seen.get(w)
            if keys is None:
                keys = _seen[w] = tuple(k for k in keys_of(w) if k in self.weights)
            if keys:
                found.update(keys)
        z = self.bias + sum(self.weights[k] for k in sorted(found))
        if z == -np.inf:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document counts of features among positives and others."""
    for batch in slices(batches, 128):
        in_p, in_u = Counter(), Counter()
        for positive, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (in_p if positive else in_u).update({k for w in words_of(text) for k in keys_of(w)})
        keys = list(in_p.keys() | in_u.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([in_p[k] for k in keys], pa.int64()), pa.array([in_u[k] for k in keys], pa.int64())], names=["key", "in_p", "in_u"])


def choose_features(sample: DataFrame, p: int, u: int, most: int = MAX_FEATURES) -> list[str]:
    """Features whose document counts among p positives and u others differ beyond chance, the strongest first.

    The statistic is the likelihood ratio of independence; the features must
    occur in two positives at least. Where none passes, the strongest 64 do.
    """
    counts = written(sample.mapInArrow(_counted, "key string, in_p bigint, in_u bigint").groupBy("key").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    a, b = F.col("in_p").cast("double"), F.col("in_u").cast("double")
    both = (a + b) / F.lit(float(p + u))
    g = part(a, both * p) + part(b, both * u) + part(p - a, (1 - both) * p) + part(u - b, (1 - both) * u)
    strong = counts.where("in_p >= 2").select("key", F.round(2 * g, 9).alias("g")).where("g > 0")
    best = strong.orderBy(F.desc("g"), F.length("key"), "key").limit(3 * most).collect()  # bounded by the parameter
    passing = [r.key for r in best if r.g > FLOOR]
    return passing or [r.key for r in best[:64]]


def presence(sample: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which documents are positive, and which features each shows (float32); features that say the same are left to the first."""
    place = sample.sparkSession.sparkContext.broadcast({k: i for i, k in enumerate(features)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            bits = []
            for text in batch.column(1).to_pylist():
                row = np.zeros(len(place.value), np.uint8)
                row[[place.value[k] for w in words_of(text) for k in keys_of(w) if k in place.value]] = 1
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["positive", "bits"])

    rows = sorted((r.positive, bytes(r.bits)) for r in sample.mapInArrow(run, "positive boolean, bits binary").collect())  # a few hundred bytes for each sampled document
    x = np.unpackbits(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1), axis=1, count=len(features))
    return np.array([r[0] for r in rows], bool), x


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias minimising the non-negative risk (logistic loss, Adam on the whole sample)."""
    xp, xu = x[positive], x[~positive]
    theta = np.zeros(x.shape[1] + 1, x.dtype)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    one = lambda m: np.hstack([m, np.ones((len(m), 1), m.dtype)])
    xp, xu = one(xp), one(xu)
    for step in range(1, steps + 1):
        zp, zu = np.clip(xp @ theta, -40, 40), np.clip(xu @ theta, -40, 40)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        grad_negative = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        if negative < -slack:
            grad = -grad_negative
        else:
            grad = prior * (xp.T @ (sp - 1)) / len(xp) + grad_negative
        grad[:-1] += decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """The model, from at most ``max_positive`` + ``max_unlabelled`` documents."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label_col) == 1).cast("int")).alias("toxic")).first()
    if not known.toxic:
        return Model()
    prior = min(max(known.toxic / known.n, 1e-4), 0.5)
    toxic = labelled_sample(docs, labels, label_col, max_positive, id_col, text_col, where=F.col("label") == 1)
    others = columns_of(docs, id_col).select(F.col(id_col).alias("doc_id")).where("doc_id is not null").where(~held_out(F.col("doc_id")))
    others = others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_unlabelled).distinct()
    unlabelled = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(others), "doc_id")
    unlabelled = one_text(unlabelled, "doc_id")
    confirmed = labels.where(F.col(label_col).cast("int") == 1).select(F.col(id_col).alias("doc_id")).distinct().withColumn("confirmed", F.lit(True))
    marked = unlabelled.join(confirmed, "doc_id", "left").select(F.lit(False).alias("positive"), "text", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    both = toxic.select(F.lit(True).alias("positive"), "text", F.lit(False).alias("confirmed")).unionByName(marked)
    sample = written(both.repartition(split_count(docs)))
    sizes = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    counted = sample.where(~F.col("confirmed")).select("positive", "text")
    most = MAX_FEATURES + sizes[True] // 4
    names = choose_features(counted, sizes[True], counted.where(~F.col("positive")).count(), most)
    if not names:
        return Model(bias=float(np.log(prior / (1 - prior))))
    positive, shown = presence(sample.select("positive", "text"), names)
    distinct = list({shown[:, k].tobytes(): k for k in reversed(range(len(names)))}.values())
    kept = sorted(distinct)[:most]
    weights, bias = fit_nnpu(shown[:, kept].astype(np.float32), positive, prior)
    return Model(bias, {names[k]: float(w) for k, w in zip(kept, weights, strict=True)})


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return score(docs[text_col])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    own = columns_of(docs, id_col, text_col)
    out = own.select(F.col(id_col).alias("doc_id"), held_out(own[id_col]).alias("held_out"), scored(own, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows whose score is below the threshold, with their columns as they were."""
    return docs.where(scored(docs, model, text_col) < threshold)
