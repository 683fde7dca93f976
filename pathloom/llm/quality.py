"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fold, private, raw

_PUNCT = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
SAMPLE = 8000


def features(text: bytes) -> np.ndarray:
    """Language-independent counts and ratios of one whole text."""
    n = len(text)
    if not n:
        return np.zeros(len(_PUNCT) + 20)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    share = hist / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    kinds = len(set(words))
    line_kinds = set(lines)
    line_sizes = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1)
    seen = share[share > 0]
    own = np.array([
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        share[48:58].sum(), share[65:91].sum(), share[97:123].sum(), share[128:].sum(), share[10], share[9] + share[13], share[32], share[:9].sum(),
        -(seen * np.log(seen)).sum(), sizes.mean(), sizes.std(), sizes.max() / n,
        kinds / max(1, len(words)), kinds / max(1.0, len(words)) ** 0.7, len(line_kinds) / max(1, len(lines)), np.log1p(line_sizes.mean()), np.log1p(line_sizes.std()),
    ])
    return np.concatenate([own, np.sqrt(share[_PUNCT])])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 600, seed: int = 0) -> Model:
    """Minimise prior*R_p(+) + max(0, R_u(-) - prior*R_p(-)) with the sigmoid loss.

    Where the bracket is negative, the step goes against its gradient, as the non-negative estimator has it.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p = [rng.normal(0, 1 / np.sqrt(xp.shape[1]), (xp.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]

    def back(x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(dz, p[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]

    for t in range(1, steps + 1):
        hp, hu = np.tanh(xp @ p[0] + p[1]), np.tanh(xu @ p[0] + p[1])
        sp, su = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) for h in (hp, hu))
        dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        rest = su.mean() - prior * sp.mean()
        if rest >= 0:
            grads = [a + b for a, b in zip(back(xp, hp, -2 * prior * dp), back(xu, hu, du), strict=True)]
        else:
            grads = [a + b for a, b in zip(back(xp, hp, prior * dp), back(xu, hu, -du), strict=True)]
        for i, g in enumerate(grads):
            g = g + 1e-4 * p[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p[0], p[1], p[2], float(p[3][0]), prior)


def separate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (bias last) of a logistic model of y by Newton's steps."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 5, doubt: float = 0.1) -> float:
    """Share of positives among the unlabelled, from these two samples alone.

    A model of positive against unlabelled ranks rows that it was not fitted on. Above any rank the share of
    unlabelled rows over the share of positives is at least the prior, and near it where the negatives are
    left behind; the rank is chosen where that ratio and its Hoeffding bound at `doubt` are least together.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    fp, fu = np.arange(len(xp)) % folds, np.arange(len(xu)) % folds
    sp, su = np.zeros(len(xp)), np.zeros(len(xu))
    for k in range(folds):
        rows = np.concatenate([xp[fp != k], xu[fu != k]])
        if not len(rows) or not len(xp[fp != k]) or not len(xu[fu != k]):
            return 0.5
        w = separate(rows, np.r_[np.ones((fp != k).sum()), np.zeros((fu != k).sum())])
        sp[fp == k], su[fu == k] = xp[fp == k] @ w[:-1] + w[-1], xu[fu == k] @ w[:-1] + w[-1]
    cuts = np.unique(sp)
    qp = 1 - np.searchsorted(np.sort(sp), cuts, "left") / len(sp)
    qu = 1 - np.searchsorted(np.sort(su), cuts, "left") / len(su)
    slack = np.sqrt(np.log(4 / doubt) / 2 / len(su)) + np.sqrt(np.log(4 / doubt) / 2 / len(sp))
    at = int((qu / qp + slack / qp).argmin())
    return float(np.clip(qu[at] / qp[at], 0.01, 0.99))


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = [features(t) for t in raw(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("kind"), pa.array(x, pa.list_(pa.float64()))], ["kind", "x"])

    return docs.select("kind", "text").mapInArrow(run, "kind int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` trusted positives and `sample` unlabelled documents of the learning folds.

    `sample` bounds what the driver holds; both samples are the least hashes of doc_id, so any size of
    input gives an even draw. Of the labels only the positive ones are read: the class prior is class_prior()
    of the two samples. None where there is no positive or no document to learn from. Null texts are empty;
    rows that repeat a doc_id are drawn together, and may exceed `sample` by their number.
    """
    by_hash = F.xxhash64("doc_id")
    plus = labels.where((F.col("quality") == 1) & (fold("doc_id", 3) != 1)).select("doc_id").distinct().orderBy(by_hash, "doc_id").limit(sample).withColumn("kind", F.lit(1))
    rest = docs.where(fold("doc_id", 3) != 1).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample).withColumn("kind", F.lit(0))
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(plus.unionByName(rest)), "doc_id")  # at most 2 * sample ids
    rows = _featured(picked).collect()
    x = {k: np.array([r["x"] for r in rows if r["kind"] == k]) for k in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return None
    order = {k: np.lexsort(v.T) for k, v in x.items()}  # the order of collected rows must not matter
    plus_x, rest_x = (x[k][np.random.default_rng(5).permutation(order[k])] for k in (1, 0))
    return fit(plus_x, rest_x, class_prior(plus_x, rest_x))


def scores(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with a column `name`, the chance that a whole text is of quality 1; null and empty texts get one as well.

    Without a model every score is 0.5. All columns of docs stay as they are; ValueError if `name` is one of them.
    """
    if name in docs.columns:
        raise ValueError(f"docs has a column {name} of its own")
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = np.array([features(t) for t in raw(part, "text")])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x), pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that score below the threshold; columns, also one named `score`, stay as they are."""
    name = private(docs, "_quality")
    return scores(docs, train(docs, labels, sample), name).where(F.col(name) >= threshold).drop(name)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; see train() and scores().

    Null and empty texts are scored like any other; rows that repeat a doc_id each have a row; a null doc_id
    is not held out and not learned from; an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs, labels, sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return scores(texts, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
