"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Texts become a fixed vector of transformed statistics.  Class sizes, sums and second moments are additive and
summed map-side over all training rows, so fitting needs one pass and no sample.  Each class covariance is
shrunk towards the pooled one and its diagonal; its Cholesky factor is computed once and sent with the
scorer, which takes Mahalanobis log-density differences.

Defined results: a null or empty text has the statistics of no words and is scored, a very long one has those of all its words; equal
texts score equally; other columns are ignored, whatever their names; a null id counts as held out and
meets no label; rows that repeat an id are scored each, and each counts in training if labelled; labels other
than 0 and 1 are ignored; with a class missing from training the score is the share of the other (0.5 without any).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

FOLDS, HELD_OUT, CUT = 5, 0, 0.3
#: Weights of a class's own covariance, of the pooled one, and of the pooled diagonal; and a floor of the variance.
OWN, POOLED, DIAGONAL, FLOOR = 0.6, 0.3, 0.1, 1e-3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@{}[]^~_=+\\/"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
N_FEATURES = 14


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = raw.split()
    n, size = len(w), len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    share = lambda mask: float(count[mask].sum()) / max(size, 1)
    kinds: dict[bytes, int] = {}
    for x in w:
        kinds[x] = kinds.get(x, 0) + 1
    pairs = len({*zip(w, w[1:])})
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = count[count > 0] / max(size, 1)
    letters = float(count[_LETTER].sum())
    root = lambda x: math.sqrt(max(x, 0.0))
    return [
        math.log1p(n),
        math.log1p(sum(map(len, w)) / max(n, 1)),
        root(len(kinds) / math.sqrt(n) if n else 0.0),
        root(pairs / (n - 1) if n > 1 else 1.0),
        root(max(kinds.values()) / n if n else 0.0),
        root(float(count[_UPPER].sum()) / max(letters, 1.0)),
        root(share(_DIGIT)),
        root(share(_SYMBOL)),
        root(count[ord("|")] / max(n, 1)),
        root(count[ord("!")] / max(n, 1)),
        root(share(_STOP)),
        math.log1p(n / max(len(lines), 1)),
        root(1 - len({*lines}) / len(lines) if lines else 0.0),
        float(-(p * np.log2(p)).sum()) if size else 0.0,
    ]


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, x): the statistics of every text."""
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t.as_py()) for t in b.column("text")], kind)], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, x array<double>")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))


class Discriminant:
    """Fitted classes: means, Cholesky factors and log determinants."""

    def __init__(self, n: dict[int, float], sums: dict[int, np.ndarray], squares: dict[int, np.ndarray]):
        self.share = (n[1] + 1e-12) / (n[0] + n[1] + 2e-12)
        self.ready = n[0] > 1 and n[1] > 1
        if not self.ready:
            return
        mean = {k: sums[k] / n[k] for k in (0, 1)}
        cov = {k: squares[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        self.scale = np.sqrt(np.diag(pooled) + FLOOR)
        unit = np.outer(self.scale, self.scale)
        self.mean = mean
        self.factor, self.logdet = {}, {}
        for k in (0, 1):
            s = (OWN * cov[k] + POOLED * pooled) / unit + DIAGONAL * np.diag(np.diag(pooled) / np.diag(unit)) + FLOOR * np.eye(len(pooled))
            lower = np.linalg.cholesky(s)
            self.factor[k], self.logdet[k] = np.linalg.inv(lower), 2 * float(np.log(np.diag(lower)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.ready:
            return np.full(len(x), self.share)
        density = {k: -0.5 * ((((x - self.mean[k]) / self.scale) @ self.factor[k].T) ** 2).sum(axis=1) - 0.5 * self.logdet[k] for k in (0, 1)}
        z = density[1] - density[0] + math.log(self.share / (1 - self.share))
        return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant:
    """From the moments of all labelled rows outside the held-out fold."""
    truth = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("doc_id"))
    p = N_FEATURES

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, p)
            y = b.column("y").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "v"])

    summed = features.join(truth, "doc_id").select("x", "y").mapInArrow(moments, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v"))
    flat = np.zeros((2, 1 + p + p * p))
    for r in summed.collect():  # 2 * (1 + p + p * p) rows at any size
        flat.ravel()[r["at"]] = r["v"]
    return Discriminant({k: flat[k, 0] for k in (0, 1)}, {k: flat[k, 1 : p + 1] for k in (0, 1)}, {k: flat[k, p + 1 :].reshape(p, p) for k in (0, 1)})


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (score at or over ``CUT``)."""
    with Scratch(docs.sparkSession) as scratch:
        features = scratch.table(featurise(docs), "features")
        model = fit(features, labels, label_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

        scored = features.mapInArrow(run, "doc_id bigint, score double")
        return scratch.result(scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")))
