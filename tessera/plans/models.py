"""Nearest neighbours and estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import models as M
from tessera.sources.tables import table

_KNN = """WITH q AS (SELECT vec_id AS q, embedding AS v, label AS y FROM embeddings WHERE vec_id % 20 = 0), t AS (SELECT * FROM embeddings WHERE vec_id % 20 <> 0),
 n AS (SELECT q, vec_id, label, row_number() OVER (PARTITION BY q ORDER BY list_sum(list_transform(list_zip(v, embedding), lambda p: pow(p[1]::double - p[2]::double, 2))), vec_id) AS r FROM q, t)"""


def _sides(s, d):
    """Queries are the rows whose id is divisible by 20, the others train."""
    e = table(s, d, "embeddings")
    return e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0")


@query(f"{_KNN}, c AS (SELECT q, label, count(*) AS n FROM n WHERE r <= 5 GROUP BY 1, 2) SELECT q, arg_max(label, n * 1000 - label) AS pred FROM c GROUP BY 1")
def knn_classify_5(s, d):
    """Most frequent label of the five nearest, the smaller on a tie."""
    train, queries = _sides(s, d)
    near = M.nearest(train, queries, 5, "vec_id", "embedding", "label")
    votes = near.groupBy("q", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("q").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("pred"))


@query(f"{_KNN} SELECT k::bigint AS k, q, round(avg(label), 6) AS pred FROM n JOIN (VALUES (1), (7), (15)) p(k) ON r <= k GROUP BY 1, 2")
def knn_regress_sweep(s, d):
    """Every k of the sweep from one search."""
    train, queries = _sides(s, d)
    near = M.nearest(train, queries, 15, "vec_id", "embedding", "label")
    rows = near.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 7, 15)]))).where("rank <= k")
    return rows.groupBy("k", "q").agg(F.round(F.avg("label"), 6).alias("pred"))


_ODD = tuple(range(1, 30, 2))


@query(f"""{_KNN}, c AS (SELECT k, q, label, count(*) AS n FROM n JOIN (SELECT unnest(range(1, 30, 2)) AS k) ON r <= k GROUP BY 1, 2, 3), p AS (SELECT k, c.q, arg_max(label, n * 1000 - label) AS pred FROM c GROUP BY 1, 2),
 e AS (SELECT k, round(avg((pred <> y)::int), 6) AS error FROM p JOIN q USING (q) GROUP BY 1) SELECT k::bigint AS k, error, k = (SELECT arg_min(k, error * 1000000 + k / 1000) FROM e) AS best FROM e""")
def knn_sweep(s, d):
    """Error of the classifier for each odd k from one search; the first k of least error is best."""
    train, queries = _sides(s, d)
    near = M.nearest(train, queries, _ODD[-1], "vec_id", "embedding", "label")
    rows = near.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in _ODD]))).where("rank <= k")
    votes = rows.groupBy("k", "q", "label").agg(F.count("*").alias("n"))
    pred = votes.groupBy("k", "q").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("pred"))
    error = pred.join(queries.select(F.col("vec_id").alias("q"), "label"), "q").groupBy("k").agg(F.round(F.avg((F.col("pred") != F.col("label")).cast("int")), 6).alias("error"))
    best = error.agg(F.min_by("k", F.struct("error", "k")).alias("k0"))
    return error.crossJoin(F.broadcast(best)).select("k", "error", (F.col("k") == F.col("k0")).alias("best"))


def _binary(s, d):
    e = M.as_vector(table(s, d, "embeddings").withColumn("label", (F.col("label") >= 5).cast("double")), "embedding")
    return e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0")


def _accuracy(pred):
    return pred.agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


@query()
def logreg(s, d):
    return _accuracy(M.fit_predict("logreg", *_binary(s, d)))


@query()
def logreg_balanced(s, d):
    train, test = _binary(s, d)
    return _accuracy(M.fit_predict("logreg_weighted", M.balanced(train, "label"), test.withColumn("weight", F.lit(1.0))))


@query("""WITH x AS (SELECT vec_id, (label >= 5)::int AS y, vec_id % 4 = 0 AS test, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS j FROM embeddings),
 m AS (SELECT y, j, avg(v) AS m, var_pop(v) + 1e-9::double AS s FROM x WHERE NOT test GROUP BY 1, 2), p AS (SELECT (label >= 5)::int AS y, ln(count(*)::double) AS p FROM embeddings WHERE vec_id % 4 <> 0 GROUP BY 1),
 l AS (SELECT vec_id, x.y, m.y AS c, sum(-0.5::double * ln(2 * pi() * s) - pow(v - m, 2) / (2 * s)) AS l FROM x JOIN m USING (j) WHERE test GROUP BY 1, 2, 3), b AS (SELECT vec_id, l.y, arg_max(c, l + p) AS pred FROM l JOIN p ON c = p.y GROUP BY 1, 2)
 SELECT round(avg((pred = y)::int), 6) AS accuracy, count(*) AS n FROM b""")
def gaussian_nb(s, d):
    return _accuracy(M.fit_predict("gaussian_nb", *_binary(s, d)))


@query()
def linear_svc(s, d):
    return _accuracy(M.fit_predict("linear_svc", *_binary(s, d)))


def _numeric(s, d):
    rows = M.assembled(table(s, d, "lineitem").withColumn("label", F.col("l_extendedprice")), ["l_quantity", "l_discount", "l_tax"])
    return rows.where("l_orderkey % 4 <> 0"), rows.where("l_orderkey % 4 = 0")


def _error(pred):
    return pred.agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("label"))), 4).alias("mae"), F.count("*").alias("n"))


@query()
def random_forest(s, d):
    return _error(M.fit_predict("random_forest", *_numeric(s, d), trees=10))


@query()
def random_forest_sweep(s, d):
    """Error by number of trees; the rows stay where they are, the driver fits one forest after another."""
    train, test = _numeric(s, d)
    out = None
    for trees in (2, 5, 10):
        row = _error(M.fit_predict("random_forest", train, test, trees=trees)).withColumn("trees", F.lit(trees))
        out = row if out is None else out.unionByName(row)
    return out


_SUMS = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("qq", "qd", "qt", "dd", "dt", "tt", "qy", "dy", "ty"))


@query(f"""WITH r AS (SELECT l_quantity::double AS q, l_discount::double AS d, l_tax::double AS t, l_extendedprice::double AS y, l_orderkey % 4 = 0 AS test FROM lineitem), s AS (SELECT avg(q) AS mq, avg(d) AS md, avg(t) AS mt, avg(y) AS my, {_SUMS} FROM r WHERE NOT test),
 w AS (SELECT *, qq*(dd*tt-dt*dt) - qd*(qd*tt-dt*qt) + qt*(qd*dt-dd*qt) AS det FROM s), b AS (SELECT *, (qy*(dd*tt-dt*dt) - qd*(dy*tt-dt*ty) + qt*(dy*dt-dd*ty))/det AS bq, (qq*(dy*tt-dt*ty) - qy*(qd*tt-dt*qt) + qt*(qd*ty-dy*qt))/det AS bd, (qq*(dd*ty-dy*dt) - qd*(qd*ty-dy*qt) + qy*(qd*dt-dd*qt))/det AS bt FROM w)
 SELECT round(avg(abs(my + bq*(q-mq) + bd*(d-md) + bt*(t-mt) - y)), 4) AS mae, count(*) AS n FROM r, b WHERE test""")
def linear_regression(s, d):
    """Least squares of three features; the SQL solves the normal equations by Cramer's rule."""
    return _error(M.fit_predict("linear_regression", *_numeric(s, d)))


@query()
def kmeans(s, d):
    rows = M.as_vector(table(s, d, "embeddings"), "embedding")
    return M.fit_predict("kmeans", rows, rows).groupBy("prediction").agg(F.count("*").alias("n"))


@query()
def model_comparison(s, d):
    """One row per model; they are fitted by the driver one after another, data stays where it is."""
    train, test = _binary(s, d)
    out = None
    for kind in ("logreg", "gaussian_nb", "linear_svc"):
        row = _accuracy(M.fit_predict(kind, train, test)).withColumn("model", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out

