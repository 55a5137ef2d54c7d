"""Nearest neighbours, and estimators of pyspark.ml behind one interface."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a packed block of queries, and of training rows.
QUERY_BLOCK, TRAIN_BLOCK = 1024, 4096


def _packed(df: DataFrame, key: str, vector: str, carry: tuple[str, ...], rows: int, names: str) -> DataFrame:
    """Blocks of up to ``rows`` rows: their keys and carried columns as arrays, their vectors as the bytes of one matrix."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                x = np.array(part.column(vector).to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), *[pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in (key, *carry)]], names=fields)

    fields = names.split()
    kinds = [f"{n} array<{df.schema[c].dataType.simpleString()}>" for n, c in zip(fields[1:], (key, *carry))]
    return df.where(F.col(vector).isNotNull()).select(key, vector, *carry).mapInArrow(run, f"{fields[0]} binary, " + ", ".join(kinds))


def nearest(train: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", *carry: str) -> DataFrame:
    """The k nearest training rows of each query (squared Euclidean; ties to the smaller key): q, key, dist, carried columns and rank.

    A blocked nested loop in one plan at any number of queries: every block of queries meets every block of training rows once, as two
    matrices, and gives k rows per query, of which k per task are shuffled; the driver sees neither side.  Candidates come from a matrix
    product; those within its rounding error of the k-th are measured again term by term, so that ties are ties.
    """
    q = _packed(queries, key, vector, (), QUERY_BLOCK, "qm qk")
    t = _packed(train, key, vector, carry, TRAIN_BLOCK, "tm tk " + " ".join(f"t_{c}" for c in carry))
    types = [pa.int64(), pa.int64(), pa.float64()]
    fields = f"q bigint, {key} bigint, dist double" + "".join(f", {c} {train.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                qk, tk = (row[n].values.to_numpy().astype(np.int64) for n in ("qk", "tk"))
                a, b = (np.frombuffer(row[m].as_buffer(), np.float64).reshape(len(ids), -1) for m, ids in (("qm", qk), ("tm", tk)))
                aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
                d = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
                kth = np.partition(d, min(k, len(tk)) - 1, axis=1)[:, min(k, len(tk)) - 1]
                near = np.argwhere(d <= (kth + 1e-9 * (1 + aa + bb.max(initial=0)))[:, None])
                exact = ((a[near[:, 0]] - b[near[:, 1]]) ** 2).sum(axis=1)
                order = np.lexsort((tk[near[:, 1]], exact, near[:, 0]))
                near, exact = near[order], exact[order]
                first = np.searchsorted(near[:, 0], near[:, 0])
                keep = np.arange(len(near)) - first < k
                near, exact = near[keep], exact[keep]
                at = pa.array(near[:, 1])
                cols = [pa.array(qk[near[:, 0]]), pa.array(tk[near[:, 1]]), pa.array(exact)]
                yield pa.RecordBatch.from_arrays([*[c.cast(x) for c, x in zip(cols, types)], *[row[f"t_{c}"].values.take(at) for c in carry]], names=["q", key, "dist", *carry])

    out = t.crossJoin(q).mapInArrow(run, fields)  # packed blocks, never rows
    w = Window.partitionBy("q").orderBy("dist", key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def assembled(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)


def as_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


ESTIMATORS = {
    "logreg": lambda y: LogisticRegression(labelCol=y, maxIter=50, regParam=1e-3),
    "logreg_weighted": lambda y: LogisticRegression(labelCol=y, weightCol="weight", maxIter=50, regParam=1e-3),
    "gaussian_nb": lambda y: NaiveBayes(labelCol=y, modelType="gaussian"),
    "linear_svc": lambda y: LinearSVC(labelCol=y, maxIter=50, regParam=1e-3),
    "random_forest": lambda y, trees=40: RandomForestRegressor(labelCol=y, numTrees=trees, maxDepth=6, seed=7),
    "linear_regression": lambda y: LinearRegression(labelCol=y),
    "kmeans": lambda y: KMeans(k=5, seed=7),
}


def fit_predict(kind: str, train: DataFrame, test: DataFrame, label: str = "label", **kw) -> DataFrame:
    return Pipeline(stages=[ESTIMATORS[kind](label, **kw)]).fit(train).transform(test)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows over twice the rows of the class."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    return df.join(n.crossJoin(F.broadcast(total)), label).withColumn("weight", F.col("__t") / (F.col("__k") * F.col("__n"))).drop("__n", "__t", "__k")
