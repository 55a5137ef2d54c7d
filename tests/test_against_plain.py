"""What SQL does not check: stemming, packing, estimators, sources and sinks, order statistics at the edges."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import arrays as A
from tessera.operators import models as M
from tessera.operators import shape as H
from tessera.operators import udfs as U
from tessera.operators.preferences import rank_paired
from tessera.sources import sinks
from tessera.sources import tables as T

D = "/root/testdata/sf0.001"

# Words and stems printed with Porter's rules.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize("word, stem", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, stem):
    assert U.stem(word) == stem


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_rouge_of_every_pair(spark):
    from tessera.plans import views as V

    texts = {r.conv_id: (r.chosen, r.rejected) for r in V.pref_text(spark, D).collect()}
    cut = lambda t: [U.stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", t.lower())]
    got = {r.conv_id: r.rouge_l for r in catalog.queries()["rouge_l_pairs"](spark, D).collect()}
    assert got.keys() == texts.keys() and got
    for k, (x, y) in texts.items():
        a, b = cut(x), cut(y)
        n = plain_lcs(a, b)
        p, q = (n / len(a), n / len(b)) if a and b else (0, 0)
        assert got[k] == pytest.approx(2 * p * q / (p + q) if n else 0, abs=1e-6)


@pytest.mark.parametrize("rows", [40, 1 << 16])
def test_packing_is_best_fit(spark, rows):
    draw = random.Random(1)
    items = [(k, draw.randrange(0, 14)) for k in range(200)]
    got = U.pack(spark.createDataFrame(items, "k bigint, n bigint"), "k", "n", 10, rows).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert len(got) == 200 and len(shards) <= -(-200 // rows)
    for own in shards.values():
        room, want = [], {}
        for k, n in sorted(((r.k, r.n) for r in own), key=lambda x: (-x[1], x[0])):
            fit = [i for i, left in enumerate(room) if left >= n]
            i = min(fit, key=lambda i: (room[i], i)) if fit else len(room)
            room += [10] * (i == len(room))
            room[i] -= n
            want[k] = i
        assert {r.k: r.bin for r in own} == want


def test_draws_follow_their_keys(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    a, b = ({r.k: r["count"] for r in H.with_replacement(x, "k", 0.5, 9).groupBy("k").count().collect()} for x in (df, df.repartition(7)))
    assert a == b and 1700 < sum(a.values()) < 2300 and max(a.values()) > 2
    parts = {r.part: r.n for r in catalog.queries()["random_split"](spark, D).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert 0.7 < parts["train"] / sum(parts.values()) < 0.8


# estimators against NumPy


@pytest.fixture(scope="module")
def classes(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 4)) * [1, 5, 0.2, 2]
    y = (x @ [1.0, 0.3, -2.0, 0.5] + draw.logistic(size=400) > 1).astype(float)
    df = M.as_vector(spark.createDataFrame([(int(i), v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id bigint, v array<double>, label double"), "v")
    return x, y, df


def newton(x, y, weight, penalty):
    weight = weight / weight.sum()
    mean = weight @ x
    n = len(y)
    scale = np.sqrt(weight @ (x - mean) ** 2 * n / (n - 1)) if np.allclose(weight, 1 / n) else np.sqrt(weight @ (x - mean) ** 2)
    z = np.column_stack([(x - mean) / scale, np.ones(n)])
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ w)
    return 1 / (1 + np.exp(-z @ w))


def test_logistic_regression_is_the_penalised_optimum(classes):
    x, y, df = classes
    got = M.fit_predict("logreg", df, df).orderBy("id").collect()
    assert np.abs(np.array([r.probability[1] for r in got]) - newton(x, y, np.ones(len(y)), 1e-3)).max() < 2e-3


def test_balanced_weights_and_their_regression(classes):
    x, y, df = classes
    rows = M.balanced(df, "label")
    weights = {r.label: r.weight for r in rows.select("label", "weight").distinct().collect()}
    assert weights == {k: pytest.approx(len(y) / (2 * (y == k).sum())) for k in (0.0, 1.0)}
    got = M.fit_predict("logreg_weighted", rows, rows).orderBy("id").collect()
    want = newton(x, y, np.array([weights[t] for t in y]), 1e-3)
    assert np.abs(np.array([r.probability[1] for r in got]) - want).max() < 5e-3


def test_support_vectors_are_at_a_minimum(classes):
    x, y, df = classes
    model = M.ESTIMATORS["linear_svc"]("label").fit(df)
    scale = x.std(axis=0, ddof=1)
    z = x / scale
    loss = lambda w, b: np.maximum(0, 1 - (2 * y - 1) * (z @ w + b)).mean() + 0.5e-3 * w @ w
    w, b = model.coefficients.toArray() * scale, model.intercept
    draw = np.random.default_rng(0)
    near = [loss(w + draw.normal(size=4) * 0.05, b + draw.normal() * 0.05) for _ in range(200)]
    assert loss(w, b) < min(near) + 2e-3 and loss(w, b) < 0.8 * loss(w * 0, 0)


def test_clusters_are_a_fixed_point(classes):
    x, _, df = classes
    model = M.ESTIMATORS["kmeans"](None).setMaxIter(100).setTol(0.0).fit(df)
    centres = np.array(model.clusterCenters())
    own = np.array([r.prediction for r in model.transform(df).orderBy("id").collect()])
    assert (own == ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert np.allclose(centres, [x[own == k].mean(axis=0) for k in range(len(centres))], atol=1e-6)


def test_forest_learns_and_model_is_saved(spark, tmp_path):
    rows = M.assembled(spark.range(300).select(F.col("id"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("label", F.col("a") * 2 + F.col("b")), ["a", "b"])
    error = lambda trees: M.fit_predict("random_forest", rows, rows, trees=trees).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    spread = float(np.mean([abs(k % 17 * 2 + k % 5 - 18) for k in range(300)]))
    assert error(10) < 0.3 * spread
    from pyspark.ml.regression import LinearRegressionModel

    model = M.ESTIMATORS["linear_regression"]("label").fit(rows)
    sinks.save_model(model, str(tmp_path / "m"))
    assert LinearRegressionModel.load(str(tmp_path / "m")).coefficients.toArray() == pytest.approx([2, 1])


@pytest.mark.parametrize("blocks", [(3, 5), (1024, 4096)])
def test_nearest_in_blocks(spark, monkeypatch, blocks):
    draw = np.random.default_rng(5)
    x = draw.integers(0, 3, (60, 3)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, v.tolist(), int(i % 4)) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").repartition(3)
    monkeypatch.setattr(M, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(M, "TRAIN_BLOCK", blocks[1])
    got = M.nearest(rows.where("vec_id >= 20"), rows.where("vec_id < 20"), 4, "vec_id", "embedding", "label").orderBy("q", "rank").collect()
    want = [(q, k, k % 4) for q in range(20) for k in sorted(range(20, 60), key=lambda k: (((x[q] - x[k]) ** 2).sum(), k))[:4]]
    assert [(r.q, r.vec_id, r.label) for r in got] == want
    assert M.nearest(rows.limit(0), rows, 3, "vec_id", "embedding").count() == 0 and M.nearest(rows, rows.limit(0), 3, "vec_id", "embedding").count() == 0


# order statistics, by the plans for relations of any size


@pytest.fixture
def any_size(monkeypatch):
    monkeypatch.setattr(H, "SMALL", -1)
    monkeypatch.setattr(H, "SORTED", 2)


@pytest.mark.parametrize("name", ["describe_exact", "profile_numeric", "boxplot_summary", "boxplot_outliers", "median_fill", "conditional_aggregates", "high_entropy_mask", "chrono_split_80", "dpo_aot", "dpo_aot_pair", "label_encode", "running_moments"])
def test_queries_at_any_size(spark, any_size, name):
    from tests.test_library import test_same_as_sql

    test_same_as_sql(spark, name)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50 + [1.0], list(range(700)), [None, None], []])
def test_quantiles(spark, any_size, values):
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double").repartition(3)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = H.quantiles(df, "v", qs).collect()
    known = [v for v in values if v is not None]
    assert len(got) == 1 and got[0].q == (pytest.approx([float(np.quantile(known, q)) for q in qs]) if known else None)


def test_quantiles_of_groups(spark, any_size):
    df = spark.createDataFrame([(k % 3 or None, float(k * 37 % 101)) for k in range(300)], "g int, v double")
    got = {r.g: r.q for r in H.quantiles(df.where("g IS NOT NULL"), "v", [0.5, 0.8], "g").collect()}
    assert got == {g: pytest.approx([float(np.quantile([k * 37 % 101 for k in range(300) if k % 3 == g], q)) for q in (0.5, 0.8)]) for g in (1, 2)}


def test_ranks_of_equal_values_spread_over_tasks(spark):
    values = [7.0] * 500 + [float(v) for v in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.v for r in H.value_ranks(df, "v").orderBy("rank").collect()] == sorted(values)
    rows = H.spread(H.ranked_values(df, "v"), "v", chunk=64).orderBy("rank").collect()
    assert [r.v for r in rows] == sorted(values) and [r.rank for r in rows] == list(range(1, 601))


def test_running_sums(spark):
    df = spark.createDataFrame([(k, k % 4, float(k)) for k in range(50)], "k bigint, a bigint, b double").repartition(5)
    rows = H.running_sums(df, F.floor(F.col("k") / 7), "k", ["a", "b"]).orderBy("k").collect()
    assert [r.run_a for r in rows] == np.cumsum([k % 4 for k in range(50)]).tolist() and [r.run_b for r in rows] == np.cumsum(np.arange(50.0)).tolist()


def test_codes_of_numbers_and_texts(spark):
    df = spark.createDataFrame([(k * 31 % 97, f"name{k * 31 % 97:03d}") for k in range(97)] + [(None, None)], "n int, t string")
    for c in ("n", "t"):
        got = {r[c]: r.code for r in H.label_encode(df, c, "code").collect()}
        assert got == {v: i for i, v in enumerate(sorted(x for x in got if x is not None))} | {None: None}


# sources and sinks


def test_images_are_labelled_by_folder(spark, tmp_path):
    for label in ("anna", "ben"):
        (tmp_path / label).mkdir()
        (tmp_path / label / "1.png").write_bytes(label.encode())
    (tmp_path / "ben" / "notes.txt").write_text("no image")
    assert sorted((r.label, bytes(r.content)) for r in T.images(spark, str(tmp_path)).collect()) == [("anna", b"anna"), ("ben", b"ben")]


def test_small_sources(spark, tmp_path):
    assert [tuple(r) for r in T.from_columns(spark, {"a": [1, 2], "b": ["x", None]}, "a int, b string").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        T.from_columns(spark, {"a": [1, 2], "b": ["x"]}, "a int, b string")
    (tmp_path / "d.json").write_text('{"log_history": [{"step": 1,\n "loss": 0.5}]}')
    assert T.json_document(spark, str(tmp_path / "d.json"), T.TRAINER_STATE).select("log_history.loss").first().loss == [0.5]
    assert sinks.report(spark.createDataFrame([(1, 0.5)], "n int, share double")) == '{"n":1,"share":0.5}'


def test_spreadsheet_has_a_mark_and_a_bound(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("é", 1)], "name string, n int")
    sinks.write_excel_csv(df, str(tmp_path / "x"))
    assert next((tmp_path / "x").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfname,n")
    monkeypatch.setattr(sinks, "SHEET_ROWS", 2)
    with pytest.raises(ValueError):
        sinks.write_excel_csv(spark.range(2), str(tmp_path / "y"))


# user functions and checks


def test_arrays_of_different_lengths_end_the_run(spark):
    df = spark.createDataFrame([([1, 2], [1, 1]), ([1], [1, 1])], "a array<int>, b array<int>")
    assert H.same_length(df.limit(1), "a", "b").count() == 1
    with pytest.raises(Exception, match="differ in length: 1, 2"):
        H.same_length(df, "a", "b").collect()


def test_user_functions(spark):
    df = spark.createDataFrame([(1, "ab", "c"), (2, "", "dd"), (None, "x", "y")], "g int, t string, u string")
    assert [r.v for r in df.select(U.embedded(lambda ts: [[len(t), 1] for t in ts], 2)("t").alias("v")).collect()] == [[2, 1], [0, 1], [1, 1]]
    with pytest.raises(Exception, match="a vector for each text"):
        df.select(U.embedded(lambda ts: [])("t")).collect()
    judge = U.judged(lambda prompt, answers: None if not answers[0] else int(len(answers[1]) > len(answers[0])))
    assert [r.w for r in df.select(judge("g", "t", "u").alias("w")).collect()] == [0, -1, 0]
    got = U.metric(df, "g", lambda t: {"n": t.num_rows}, "n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert {r.g: r.n for r in got} == {1: 1, 2: 1, None: 1}
    t = spark.createDataFrame([(["a"], "x")], "messages array<string>, text string")
    pick = lambda f: f.select(H.by_column(f, "messages", lambda: F.lit("chat"), lambda: F.lit("plain")).alias("k")).first().k
    assert pick(t) == "chat" and pick(t.drop("messages")) == "plain"


def test_entropy_of_softmax(spark):
    x = [0.5, -1.0, 3.0]
    p = np.exp(x) / np.exp(x).sum()
    got = spark.createDataFrame([(x,)], "a array<double>").select(A.softmax_entropy("a").alias("e")).first().e
    assert got == pytest.approx(-(p * np.log(p)).sum())


def test_settings_from_arguments(tmp_path):
    (tmp_path / "c.json").write_text('{"lr": "2e-4", "data": {"path": "a", "n": 3}}')
    s = T.Settings.from_arguments(["--config", str(tmp_path / "c.json"), "--data.path", "b", "--ckpt", "last"])
    assert s.number("lr", 1) == 2e-4 and s.get("data.path") == "b" and s.get("data.n") == 3 and s.get("ckpt") == "last"
    with pytest.raises(ValueError):
        T.Settings.from_arguments(["--config"])


def test_byte_level_tokens_round_trip(spark):
    import base64

    merges = [bytes([b]) for b in range(256)] + [b"th", b"the", b" the", b"in", b"ing"]
    vocabulary = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(merges))
    texts = ["the thing is in the ring", "", None, "naïve é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.x for r in df.select("id", U.tokenised(spark, vocabulary, r" ?\S+|\s+")("t").alias("x")).collect()}
    assert [b"".join(merges[k] for k in got[i]).decode() for i in range(4)] == ["the thing is in the ring", "", "", "naïve é"]
    assert got[0][:2] == [257, 32] and 258 in got[0]


# sizes and odd values of the second review


def broadcast_rows(plan):
    """Rows of every relation that a finished plan sent to all tasks."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcast_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcast_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchangeExec" else []
    return sum((broadcast_rows(plan.children().apply(i)) for i in range(plan.children().size())), own)


def test_frequent_values_are_paired_without_sending_a_side(spark, any_size):
    df = spark.range(0, 150_000, 1, 3).select((F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    out = rank_paired(df, F.col("x"), F.col("y")).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("apart"))
    row = out.collect()[0]
    assert row.n == 150_000 and row.apart == np.abs(np.sort(np.arange(150_000) % 3) - np.sort(np.arange(150_000) % 5)).sum()
    assert max(broadcast_rows(out._jdf.queryExecution().executedPlan()), default=0) <= 1000


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_pairs_by_rank(spark, block):
    left, right = [2.0, None, 1.0, 1.0, 5.0, 2.0, 1.0, None], [0.5, 0.5, 9.0, -1.0, 0.5, 0.5, 0.5, 3.0]
    df = spark.createDataFrame(list(zip(left, right)), "l double, r double")
    got = sorted(map(tuple, H.paired_by_rank(df, "l", "r", block).select("rank", "l", "r").collect()))
    assert got == [(k + 1, x, y) for k, (x, y) in enumerate(zip(sorted(v for v in left if v is not None), sorted(right)))]
    assert H.paired_by_rank(df.where("l IS NULL"), "l", "r", block).count() == 0


def test_a_narrow_part_of_a_large_table_is_not_small(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "wide")
    spark.range(2000).select((F.col("id") % 2).alias("x"), *[F.md5(F.concat(F.lit(k), F.col("id").cast("string"))).alias(f"c{k}") for k in range(8)]).write.parquet(path)
    monkeypatch.setattr(H, "SMALL", 100_000)
    assert not H.small(spark.read.parquet(path).select("x"))
    monkeypatch.setattr(H, "SMALL", 32 << 20)
    assert H.small(spark.read.parquet(path).select("x"))


@pytest.mark.parametrize("name", ["pct_change", "pct_change_filled"])
def test_changes_from_zero_and_near_ties(spark, tmp_path, name):
    values = [0.0, 0.0, 3.5, 0.0, -2.0, None, 1.0, -0.0, 4.0, 6.4, 57.63, 6.4, 0.64, 25.0, 40.0, 7.0]
    rows = [(k, k // 14, float("nan") if v is None else v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").select("*", F.timestamp_seconds("event_id").alias("ts"))
    df.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = {e: repr(c) for e, c in con.execute(catalog.oracle_sql()[name]).fetchall()}
    assert {r.event_id: repr(r.change) for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == wanted


@pytest.mark.parametrize("name", ["pct_change", "pct_change_filled"])
def test_changes_with_null_times_and_signed_zeros(spark, tmp_path, name):
    rows = [(0, 7, 30.0), (1, None, 40.0), (2, None, 41.0), (3, 5, 25.0), (4, 9, 99.99999999), (5, 10, 100.0), (6, 11, 99.99999999), (None, 9, 50.0)]
    df = spark.createDataFrame(rows, "event_id bigint, s bigint, value double")
    df.select("event_id", F.lit(1).alias("user_id"), "value", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = {e: repr(c) for e, c in con.execute(catalog.oracle_sql()[name]).fetchall()}
    assert "-0.0" in wanted.values()
    assert {r.event_id: repr(r.change) for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == wanted
