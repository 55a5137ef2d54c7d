"""Algebraic properties, unit behaviour and a comparison with SQL on the smallest tables."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import arrays as A
from tessera.functions import objectives as O
from tessera.functions import strings as S
from tessera.operators import policy as P
from tessera.operators import profile as PR
from tessera.operators import shape as H
from tessera.operators import udfs as U
from tessera.sources import sinks
from tessera.sources import tables as T

D = "/root/testdata/sf0.001"
SAME = ["impute_group_median", "describe_exact", "skewness_g1", "corr_matrix", "histogram_bins", "one_hot", "rolling_mean_10_20_50", "chrono_split_80", "chat_render", "sft_format", "unpair_preferences", "dpo_sigmoid", "dpo_aot", "kto", "grpo_advantage", "rloo_advantage", "ppo_gae", "gkd_jsd", "knn_classify_5", "confusion_matrix"]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("name", SAME)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    ours = catalog.queries()[name](spark, D)
    cols = sorted(ours.columns)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    key = lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (False, "f", round(v, 5)) for v in r)
    a = sorted((tuple(r[c] for c in cols) for r in ours.collect()), key=key)
    b = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for v, w in zip(x, y):
            assert v == w or (isinstance(v, float) and w is not None and abs(v - float(w)) <= 1e-5 * max(1, abs(v)))


def test_marker_and_folds_over_all_rows(spark):
    test_same_as_sql(spark, "marker_extract_documents")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    answers = {r.doc_id: r.answer for r in catalog.queries()["marker_extract_documents"](spark, D).collect()}
    assert answers.keys() == texts.keys() and sum(map(bool, answers.values())) > 100
    keys = [r.o_orderkey for r in spark.read.parquet(f"{D}/orders.parquet").collect()]
    folds = [(r.o_orderkey, r.fold) for r in catalog.queries()["split_fold"](spark, D).collect()]
    assert sorted(folds) == sorted((k, int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 4) for k in keys) and {f for _, f in folds} == {0, 1, 2, 3}


def test_flags_and_templates(spark):
    assert one(spark, S.safety_flag(F.lit("I hate this"))) and not one(spark, S.safety_flag(F.lit("I like this")))
    assert one(spark, S.safety_flag(F.lit("whatever")))
    assert one(spark, S.looks_like_refusal(F.lit("Sorry, I can't help with that.")))
    p = one(spark, S.sft_prompt(F.lit("Do it"), F.lit("")))
    assert p.endswith("[RESPONSE]\n") and "[INPUT]" not in p and "[INSTRUCTION]\nDo it" in p
    assert one(spark, S.verdict(F.lit("x\nwin: b \n"), F.lit("A"))) == "B"


def test_losses_at_zero_margin(spark):
    z = [F.lit(-1.0)] * 4
    assert one(spark, O.dpo("sigmoid", *z)) == pytest.approx(math.log(2))
    assert one(spark, O.dpo("robust", *z)) == pytest.approx(math.log(2))
    assert one(spark, O.dpo("hinge", *z)) == 1
    assert one(spark, O.apo_zero_unpaired(F.lit(True), F.lit(0.0))) == 0.5
    with pytest.raises(ValueError):
        O.dpo("nothing")


def test_advantages_sum_to_zero(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 6.0), (2, 4.0)], "g int, r double")
    rows = P.group_advantages(df, "g", "r", scale=False).groupBy("g").agg(F.sum("advantage").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in rows)
    alone = {r.g: r.advantage for r in P.leave_one_out(df, "g", "r").where("g = 2").collect()}
    assert alone == {2: None}


def test_gae_is_a_suffix_sum_without_discount(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0])], "r array<double>, v array<double>")
    adv, ret = P.gae("r", "v", 1.0, 1.0)
    assert df.select(adv.alias("a"), ret.alias("g")).first().a == [6.0, 5.0, 3.0]


def test_arrays(spark):
    a = F.array(*[F.lit(x) for x in (1, 2, 3)])
    assert one(spark, A.keep_end(a, 5)) == [1, 2, 3] and one(spark, A.keep_end(a, 2)) == [2, 3]
    assert one(spark, A.until_first(a, F.lit(2))) == [1, 2] and one(spark, A.until_first(a, F.lit(9))) == [1, 2, 3]
    assert one(spark, A.pad(a, 4, 0, left=True)) == [0, 1, 2, 3]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, b double")
    assert df.agg(PR.correlation("a", "b").alias("c")).first().c is None


def test_global_rank_is_row_number(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("v"))
    rows = H.global_rank(df, F.floor(F.col("v") / 10), ["v"], "rn").collect()
    assert [r.rn for r in sorted(rows, key=lambda r: r.v)] == list(range(1, 101))


def test_pack_fills_bins(spark):
    df = spark.createDataFrame([(i, 1 + i % 9) for i in range(200)], "k bigint, n bigint")
    rows = U.pack(df, "k", "n", 10, 70).groupBy("shard", "bin").agg(F.sum("n").alias("s")).collect()
    assert max(r.s for r in rows) <= 10 and sum(r.s for r in rows) == sum(1 + i % 9 for i in range(200))


def test_rouge(spark):
    df = spark.createDataFrame([("the cats sat", "a cat sat"), ("", "x"), ("same words", "same words")], "a string, b string")
    assert [round(r.s, 4) for r in df.select(U.rouge_l(F.col("a"), F.col("b")).alias("s")).collect()] == [0.6667, 0.0, 1.0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿G,x\nCharcoal,1.5\nPropane,\n", encoding="utf-8")
    df = T.csv(spark, str(tmp_path / "a.csv"), "kind string, v double")
    assert [(r.kind, r.v) for r in df.collect()] == [("Charcoal", 1.5), ("Propane", None)]
    sinks.write_csv(df, str(tmp_path / "out"), single=True)
    assert T.csv(spark, str(tmp_path / "out"), "kind string, v double").count() == 2
    sinks.write_report(df.agg(F.sum("v").alias("s")), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).first().s == 1.5
    for n, t in (("train", '{"prompt": "p", "chosen": "c", "rejected": "r"}\n'), ("val", "")):
        (tmp_path / f"{n}.jsonl").write_text(t)
    assert T.jsonl_splits(spark, {n: str(tmp_path / f"{n}.jsonl") for n in ("train", "val")}, T.PREFERENCES).collect()[0].split == "train"
    assert T.nan_to_null(spark.createDataFrame([(float("nan"),)], "v double")).first().v is None
    (tmp_path / "c.json").write_text('{"lr": "2e-4", "a": {"b": 3}}')
    s = T.Settings.read(str(tmp_path / "c.json"))
    assert s.number("lr", 1) == 2e-4 and s.get("a.b") == 3 and s.get("a.c", 7) == 7


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 150


def test_custom_functions(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    assert [r.x for r in df.select(U.reward_function(lambda t: None if t == "c" else float(len(t)))("t").alias("x")).collect()] == [2.0, None]
    assert sorted(r.text for r in U.formatted(df, lambda r: [r["t"], r["t"] + "!"], ["t"]).collect()) == ["ab", "ab!", "c", "c!"]
    assert np.isclose(U.lcs(list("abcbdab"), list("bdcaba")), 4)
