"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; the rest of the web text is unlabelled. A logistic model over a fixed set of
text statistics minimises the non-negative unbiased risk: prior * R(positive as +) + max(0, R(unlabelled as -) - prior *
R(positive as -)). The class prior is estimated from positives and unlabelled rows alone: a first model is fitted on half
of the rows, and on the other half the share of unlabelled rows above a score is divided by the share of positives above
it; where hardly any other row scores that high, this quotient is the prior. Negative labels are never used. The fit uses
bounded samples (parameters below); scores are computed for every whole text.

Defined results: null and empty texts get a score from their (zero) statistics; repeated rows are each scored; labels that
are null are not used; without positives every score is 1 (nothing is rejected); a null id is never used to learn; with
fewer than two positives or unlabelled rows in a half the prior is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, freeing, hex_crc32_fold, slices, texts_of

#: Bounds of what the fit gathers: rows of trusted positives and of unlabelled text, with the smallest hashed ids.
MAX_POSITIVE, MAX_UNLABELLED = 6000, 6000
THRESHOLD = 0.3
N_FEATURES = 16


def statistics(text: str) -> list[float]:
    """Statistics of a text's characters, words, lines and repetition."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, wide = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
    space = c[9:14].sum() + c[32]
    mark = n - upper - lower - digit - wide - space
    plain = c[44] + c[46] + c[39] + c[45]
    words = text.split()
    k = max(1, len(words))
    kinds = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    longest = max(map(len, words), default=0)
    packed = len(zlib.compress(raw[: 1 << 20], 1)) / min(n, 1 << 20) if n <= 1 << 20 else np.mean([len(zlib.compress(raw[a : a + (1 << 20)], 1)) / len(raw[a : a + (1 << 20)]) for a in range(0, n, 1 << 20)])
    return [
        upper / n, (mark - plain) / n, plain / n, digit / n, space / n, wide / n, c[33] / n, c[124] / n, (c[35] + c[36] + c[37] + c[38] + c[42]) / n,
        kinds / k, same / k, 1 - len(set(lines)) / len(lines), np.log1p(k) / 10, n / k / 20, min(1.0, longest / 100), packed,
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """Statistics with saturating and squared copies, so that a linear model can bend."""
    return np.concatenate([x, np.minimum(1, x * 8), np.minimum(1, x * 40), x * x, (x[:, 9] * x[:, 12])[:, None], (x[:, 15] * x[:, 12])[:, None]], 1)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((expanded(x) - self.centre) / self.scale, -6, 6) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Both parts of the risk (positives as positive; unlabelled as negative without the positives among them) and the
    gradient to follow: that of their sum, or away from the second part where it is negative."""
    p, u = _sigmoid(xp @ w), _sigmoid(xu @ w)
    negatives = lambda s: -np.log1p(-np.minimum(s, 1 - 1e-12)).mean()  # noqa: E731  # loss as negatives
    positive = prior * -np.log(np.maximum(p, 1e-18)).mean()
    negative = negatives(u) - prior * negatives(p)
    as_positive = prior * (xp.T @ (p - 1)) / len(xp)
    as_negative = xu.T @ u / len(xu) - prior * (xp.T @ p) / len(xp)
    return positive, negative, as_positive + as_negative if negative >= 0 else -as_negative


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Gradient descent (Adam, all rows) on the non-negative risk with logistic loss."""
    xp, xu = expanded(positive), expanded(unlabelled)
    centre, scale = xu.mean(0), xu.std(0) + 1e-6
    xp, xu = (np.clip((x - centre) / scale, -6, 6) for x in (xp, xu))
    xp, xu = (np.concatenate([x, np.ones((len(x), 1))], 1) for x in (xp, xu))
    w, m, v = np.zeros(xp.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        g = risk(w, xp, xu, prior)[2]
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(centre, scale, w[:-1], float(w[-1]), prior)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Class prior from scores of both: the quotient of the shares at or above a score, at the score whose upper confidence
    bound (with probability 1 - delta) is least."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    share = lambda x: 1 - np.searchsorted(np.sort(x), at) / len(x)
    p, u = share(positive), share(unlabelled)
    p, u = p[p > 0], u[p > 0]
    slack = (np.log(4 / delta) / 2 / len(unlabelled)) ** 0.5 + (np.log(4 / delta) / 2 / len(positive)) ** 0.5
    best = ((u + slack) / p).argmin()
    return float(u[best] / p[best])


def estimated_prior(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from the statistics x of rows that are positive, unlabelled or both: mean of two estimates, each on one half
    of the rows with a model of the other half."""
    odd = np.arange(len(x)) % 2 == 1
    parts = [(positive & h, unlabelled & h) for h in (odd, ~odd)]
    if min(part.sum() for half in parts for part in half) < 2:
        return 0.5
    found = []
    for (p, u), (q, v) in (parts, parts[::-1]):
        model = fit(x[p], x[u], 0.5, steps=400)
        found.append(best_bin(model.scores(x[q]), model.scores(x[v])))
    return min(1.0, max(0.01, sum(found) / 2))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, f): statistics of (doc_id, text)."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))], names=["doc_id", "f"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f array<double>")


def trained(docs: DataFrame, labels: DataFrame, learn: Column, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Model from (doc_id, text) and (doc_id, quality); learn says which ids may be used.

    Only labels of good rows are used. Samples are the rows with the smallest hashed ids, so they do not depend on how the
    input is partitioned.
    """
    good = labels.where(learn & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    positive = good.distinct().orderBy(*order).limit(max_positive)
    other = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    unlabelled = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id").orderBy(*other).limit(max_unlabelled)
    ids = positive.withColumn("p", F.lit(1)).unionByName(unlabelled.withColumn("p", F.lit(0))).groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    some = docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")  # at most max_positive + max_unlabelled ids
    rows = features(some).join(ids, "doc_id").orderBy("doc_id").collect()
    f = np.array([r["f"] for r in rows]).reshape(len(rows), N_FEATURES)
    p, u = np.array([r["p"] == 1 for r in rows], bool), np.array([r["u"] == 0 for r in rows], bool)
    if not p.any() or not u.any():
        return None
    return fit(f[p], f[u], estimated_prior(f, p, u))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """Input rows of (doc_id, text) as (doc_id, score)."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            x = np.array([statistics(t) for t in texts_of(batch)]).reshape(-1, N_FEATURES)
            s = model.scores(x) if model is not None else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold; all columns stay as they are."""
    at = docs.columns.index("text")

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            x = np.array([statistics("" if t is None else t) for t in batch.column(at).to_pylist()]).reshape(-1, N_FEATURES)
            s = model.scores(x) if model is not None else np.ones(len(x))
            yield batch.filter(pa.array(s >= threshold))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def learnable(id_col: str = "doc_id") -> Column:
    return hex_crc32_fold(id_col) != 0
