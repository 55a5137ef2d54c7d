"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

One weight vector is shared by ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x).  Features are
log counts of the words, and of the word beginnings of ``PREFIXES`` bytes, most associated with toxic labels.  Labels say only whether a document is toxic; grades
1 to 3 of toxic ones follow from how many of its words are marked by a strong association (one, two or three,
more), grade 0 is the rest.  The fit uses a bounded sample of labelled ids outside the held-out fold (``FIT_ROWS``, by hash of the
id), one text each, and at most ``TERMS`` terms found in ``MIN_DOCS`` of them or more; every document is scored.

Defined results: a null or empty text has no features and the severity of the baseline; a very long text is scored whole; a null id
meets no label; of rows that repeat an id the text of smallest digest is fitted, an id labelled twice counts as toxic if one label
says so, and all its rows are scored; of equally associated terms the smaller come first; without toxic labels every severity is 0;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.decontam import words

FIT_ROWS, TERMS, MIN_DOCS, GRADES = 20_000, 512, 3, 4
FOLDS, HELD_OUT = 5, 0
PREFIXES = (4, 6)
MARKED = 5.0  # a term's association, in standard errors, from which it counts for grades
STEPS, RATE, PENALTY = 400, 0.1, 1e-4
CUT = 0.5


def held_out(id_col: str = "doc_id"):
    """The fold that no fit sees."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Rows (doc_id, y, text) of at most ``rows`` labelled ids, the smallest by hash."""
    truth = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = truth.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.join(F.broadcast(chosen), "doc_id")  # ``rows`` narrow rows at most
    one = found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("d"), "text")).alias("best"))
    return one.select("doc_id", "y", "best.text")


def _terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """For whole words and each prefix length: row and term number of every word, and the terms (a tag byte, then the bytes)."""
    flat, counts = words(texts)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    kinds = coded.dictionary.cast(pa.binary())
    for size in (0, *PREFIXES):
        cut = pc.binary_slice(kinds, 0, size) if size else kinds
        tagged = pc.binary_join_element_wise(pa.scalar(bytes([48 + size]), pa.binary()), cut, pa.scalar(b"", pa.binary())).dictionary_encode()
        of = tagged.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keep = np.ones(len(ids), bool)
        if size:
            keep = pc.binary_length(kinds).to_numpy(zero_copy_only=False)[ids] > size
        yield row[keep], of[ids[keep]], tagged.dictionary


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (word, y, n): the documents of the batch with the term."""
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            label = part.column("y").to_numpy()
            for row, term, terms in _terms(part.column("text")):
                k = max(1, len(terms))
                seen = np.unique(row * k + term)
                key, n = np.unique((seen % k) * 2 + label[seen // k], return_counts=True)
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(key // 2)), pa.array((key % 2).astype(np.int32)), pa.array(n)], names=["word", "y", "n"])


def vocabulary(sample: DataFrame, terms: int) -> tuple[list[bytes], np.ndarray]:
    """The terms most associated with toxic documents and their association (log odds over its standard error)."""
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(size.get(1, 0)), float(size.get(0, 0))
    if not n1:
        return [], np.zeros(0)
    counts = sample.select("text", "y").mapInArrow(_words_of, "word binary, y int, n bigint").groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    counts = counts.where(F.col("a") + F.col("b") >= MIN_DOCS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n1 - F.col("a") + 0.5)) - F.log(b / (n0 - F.col("b") + 0.5))
    error = F.sqrt(1 / a + 1 / b)
    best = counts.select("word", (odds / error).alias("z")).orderBy(F.desc("z"), "word").limit(terms).collect()
    return [bytes(r.word) for r in best], np.array([r.z for r in best])


def features(texts: pa.Array, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse log counts: row, term and value of each."""
    k = max(1, len(vocab))
    keys = []
    for row, term, terms in _terms(texts):
        found = pc.fill_null(pc.index_in(terms, value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)[term]
        keys.append(row[found >= 0] * k + found[found >= 0])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // k, key % k, np.log1p(n)


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, terms: int, grades: int = GRADES):
        self.w, self.first, self.gaps, self.grades = np.zeros(terms), 1.0, np.zeros(grades - 2), grades

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(z), 1)), upto, np.ones((len(z), 1))], axis=1), axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> "Ordinal":
        """Adam on the mean log-likelihood with an L2 penalty; the order of thresholds is kept by their gaps."""
        n, theta = len(y), np.concatenate([self.w, [self.first], self.gaps])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            self.w, self.first, self.gaps = theta[: len(self.w)], theta[len(self.w)], theta[len(self.w) + 1 :]
            z, cut = x @ self.w, self.thresholds
            s = lambda u: 1 / (1 + np.exp(-np.clip(u, -500, 500)))
            hi = np.where(y < self.grades - 1, s(cut[np.minimum(y, self.grades - 2)] - z), 1.0)
            lo = np.where(y > 0, s(cut[np.maximum(y - 1, 0)] - z), 0.0)
            p = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of the log-likelihood, by each threshold
            g_z = -(d_hi - d_lo)
            g_cut = np.bincount(np.minimum(y, self.grades - 2), np.where(y < self.grades - 1, d_hi, 0), self.grades - 1) - np.bincount(np.maximum(y - 1, 0), np.where(y > 0, d_lo, 0), self.grades - 1)
            tail = np.cumsum(g_cut[::-1])[::-1]
            grad = np.concatenate([x.T @ g_z, [tail[0]], tail[1:] * np.exp(self.gaps)]) / n
            grad[: len(self.w)] -= PENALTY * self.w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.w, self.first, self.gaps = theta[: len(self.w)], theta[len(self.w)], theta[len(self.w) + 1 :]
        return self


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = FIT_ROWS, terms: int = TERMS) -> tuple[list[bytes], Ordinal | None]:
    sample = scratch.table(_sample(docs, labels, rows), "sample")
    vocab, z = vocabulary(sample, terms)
    if not vocab:
        return [], None
    kind = pa.array(vocab, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, value = features(b.column("text"), kind)
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.ListArray.from_arrays(pa.array(at), pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(value))], names=["doc_id", "y", "t", "v"])

    got = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y int, t array<int>, v array<double>").orderBy("doc_id").toArrow()  # at most ``rows`` rows
    x = np.zeros((got.num_rows, len(vocab)))
    for i, (t, v) in enumerate(zip(got["t"].to_pylist(), got["v"].to_pylist())):
        x[i, t] = v
    size = np.array([t[0] for t in vocab])  # a word and its beginnings are marked once
    times = np.rint(np.expm1(x))
    hits = np.max([times[:, (z >= MARKED) & (size == s)].sum(axis=1) for s in np.unique(size)], axis=0)
    grade = np.where(hits >= 4, 3, np.where(hits >= 2, 2, 1))
    y = np.where(got["y"].to_numpy() == 1, grade, 0).astype(np.int64)
    return vocab, Ordinal(len(vocab)).fit(x, y)


def severity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, terms: int = TERMS) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), grade (likeliest), p_toxic (grade over 0) and toxic (p_toxic at or over ``CUT``)."""
    with Scratch(docs.sparkSession) as scratch:
        vocab, model = train(docs, labels, scratch, rows, terms)
    kind = pa.array(vocab, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                p = np.zeros((part.num_rows, GRADES))
                p[:, 0] = 1
                if model:
                    row, term, value = features(part.column("text"), kind)
                    p = model.probabilities(np.bincount(row, value * model.w[term], part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(1 - p[:, 0])], names=["doc_id", "severity", "grade", "p_toxic"])

    rows_ = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(run, "doc_id bigint, severity double, grade int, p_toxic double").select("*", (F.col("p_toxic") >= CUT).alias("toxic"))
