"""Profiling, cleaning, filters, set operations and encoders over the tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import strings as S
from tessera.operators import profile as P
from tessera.operators import shape as H
from tessera.sources import tables as T
from tessera.sources.tables import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


@query("WITH donors AS (SELECT c_nationkey, c_mktsegment, median(c_acctbal) AS med FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2) SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN med ELSE c_acctbal END, 4) AS c_acctbal_imputed FROM customer LEFT JOIN donors USING (c_nationkey, c_mktsegment)")
def impute_group_median(s, d):
    c = F.col("c_acctbal")
    out = H.impute_group_median(table(s, d, "customer"), "c_acctbal", ["c_nationkey", "c_mktsegment"], c < 0, c > 0, "v")
    return out.select("c_custkey", F.round("v", 4).alias("c_acctbal_imputed"))


@query(_union([f"SELECT '{c}' AS col, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std FROM lineitem" for c in NUM]))
def profile_numeric(s, d):
    return P.moments(table(s, d, "lineitem"), NUM)


@query(_union([f"SELECT '{c}' AS col, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS low, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS high FROM lineitem" for c in NUM]))
def describe_exact(s, d):
    return P.describe(table(s, d, "lineitem"), NUM)


@query(_union([f"SELECT '{c}' AS col, round(skewness({c}), 6) AS skew FROM lineitem" for c in NUM]))
def skewness_g1(s, d):
    return P.long_form(table(s, d, "lineitem"), {c: {"skew": F.round(P.skewness_g1(c), 6)} for c in NUM})


@query(_union([f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1 :]]))
def corr_matrix(s, d):
    return P.correlations(table(s, d, "lineitem"), NUM)


@query("SELECT NULL::double AS corr, count(*) AS n FROM orders")
def corr_constant(s, d):
    """A constant column has no correlation, and does not raise."""
    return table(s, d, "orders").withColumn("k", F.lit(1.0)).agg(P.correlation("o_totalprice", "k").alias("corr"), F.count("*").alias("n"))


@query(_union([f"SELECT '{c}' AS col, count(*) - count({c}) AS n_null, count(*) > count({c}) AS any_null FROM orders" for c in ORD]))
def null_audit(s, d):
    return P.null_audit(table(s, d, "orders"), ORD)


@query(_union([f"SELECT '{c}' AS col, (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::bigint AS n_unique FROM orders" for c in ORD]))
def nunique_all(s, d):
    return P.distinct_counts(table(s, d, "orders"), ORD)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(s, d):
    return P.value_counts(table(s, d, "orders"), "o_orderpriority")


@query("SELECT o_orderpriority, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def value_counts_norm(s, d):
    return P.shares(table(s, d, "orders"), "o_orderpriority")


@query("SELECT l_returnflag, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1")
def group_sum(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 4).alias("total"))


@query("SELECT l_linestatus, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1")
def group_mean(s, d):
    return table(s, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg("l_discount"), 6).alias("mean"))


@query("SELECT l_returnflag, round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY 1")
def group_multi_agg(s, d):
    c = "l_quantity"
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(c), 4).alias("total"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.stddev_samp(c), 6).alias("std"))


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 30)) + 1, 30)::int AS bin, count(*) AS n FROM events, e GROUP BY 1")
def histogram_bins(s, d):
    return P.histogram(table(s, d, "events"), "value", 30)


_BOX = "SELECT event_type, min(value) AS low, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, max(value) AS high FROM events GROUP BY 1"


@query(f"SELECT event_type, low, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, high, round(q1 - 1.5::double*(q3-q1), 6) AS fence_low, round(q3 + 1.5::double*(q3-q1), 6) AS fence_high FROM ({_BOX})")
def boxplot_summary(s, d):
    return P.box(table(s, d, "events"), "value", "event_type")


@query(f"SELECT e.event_type, count(*) FILTER (value < round(q1 - 1.5::double*(q3-q1), 6) OR value > round(q3 + 1.5::double*(q3-q1), 6)) AS n_out, count(*) AS n FROM events e JOIN ({_BOX}) b USING (event_type) GROUP BY 1")
def boxplot_outliers(s, d):
    return P.box_outliers(table(s, d, "events"), "value", "event_type")


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def count_plot(s, d):
    return P.value_counts(table(s, d, "part"), "p_brand", "p_type")


_GRID = [0.0, 50.0, 100.0, 150.0, 200.0, 300.0, 400.0]


@query(_union([f"SELECT {g}::double AS x, round(avg(exp(-0.5::double*pow(({g}::double - value)/20::double, 2))) / (20::double*2.5066282746310002::double), 9) AS density FROM events" for g in _GRID]))
def kde_density(s, d):
    return P.density(table(s, d, "events"), "value", _GRID, 20.0)


@query("SELECT p_partkey, round(p_retailprice * 3285 + p_size, 4) AS total_cost, 'part' AS kind FROM part")
def total_cost(s, d):
    return table(s, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 3285 + F.col("p_size"), 4).alias("total_cost"), F.lit("part").alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN NULL ELSE o_totalprice END IS NULL AS missing FROM orders")
def null_split(s, d):
    """Two relations by whether a value is there, stacked again with their side."""
    rows = table(s, d, "orders").withColumn("v", F.when(~(F.col("o_totalprice") > 250000), F.col("o_totalprice")))
    sides = rows.where(F.col("v").isNull()).withColumn("missing", F.lit(True)).unionByName(rows.where(F.col("v").isNotNull()).withColumn("missing", F.lit(False)))
    return sides.select("o_orderkey", "missing")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice > 300000)")
def outlier_filter(s, d):
    return table(s, d, "orders").where(~(F.col("o_totalprice") > 300000)).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 'tion[a-z]*ing')")
def regex_anti_filter(s, d):
    return table(s, d, "documents").where(~F.col("text").rlike("tion[a-z]*ing")).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def conjunction_filter(s, d):
    return table(s, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def dropna_any(s, d):
    return table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal")).na.drop("any")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def anti_filter(s, d):
    bad = table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(bad, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE contains(p_type, 'S')")
def contains_filter(s, d):
    return table(s, d, "part").where(F.col("p_type").contains("S")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 2 <> 0")
def odd_filter(s, d):
    return table(s, d, "part").where(F.col("p_size") % 2 != 0).select("p_partkey")


@query("""WITH f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM (SELECT l_extendedprice/1000::double AS y, l_quantity::double AS x FROM lineitem)),
 g AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2)) AS s FROM f), h AS (SELECT *, s / sqrt(sxx) AS sb, s * sqrt(1::double / n + mx * mx / sxx) AS sa FROM g)
 SELECT round(b, 6) AS slope, round(a, 6) AS intercept, round(r2, 6) AS r2, n::bigint AS n, round(sb, 6) AS slope_se, round(sa, 6) AS intercept_se, round(b / sb, 3) AS slope_t, round(a / sa, 3) AS intercept_t, round(s, 6) AS sigma, (n - 2)::bigint AS df FROM h""")
def ols_simple(s, d):
    return P.simple_regression(table(s, d, "lineitem"), F.col("l_extendedprice") / 1000, F.col("l_quantity"))


@query("SELECT l_shipmode AS k, l_code FROM (SELECT 1 AS l_shipmode, 2 AS l_code) WHERE false UNION ALL SELECT dense_rank() OVER (ORDER BY l_returnflag)::int - 1, count(*)::int FROM lineitem GROUP BY l_returnflag")
def label_encode(s, d):
    coded = H.label_encode(table(s, d, "lineitem").select("l_returnflag"), "l_returnflag", "k")
    return coded.groupBy("k").agg(F.count("*").cast("int").alias("l_code"))


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::int AS cat_{v}" for v in _SEG) + " FROM customer")
def one_hot(s, d):
    return table(s, d, "customer").select("c_custkey", *H.one_hot("c_mktsegment", _SEG))


@query("SELECT o_orderkey, (o_orderstatus = 'F')::int AS first FROM orders")
def first_dummy(s, d):
    return table(s, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("first"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END::double AS level FROM orders")
def ordinal_factor(s, d):
    return table(s, d, "orders").select("o_orderkey", H.ordinal("o_orderpriority", ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]).cast("double").alias("level"))


@query("WITH m AS (SELECT avg(c_acctbal) FILTER (c_acctbal > 0) AS mean FROM customer) SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE mean END, 4) AS v FROM customer, m")
def mean_fill(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return H.fill_mean(rows, "v").select("c_custkey", F.round("v", 4).alias("v"))


@query("WITH m AS (SELECT median(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS med FROM customer) SELECT c_custkey, round(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, med), 4) AS v FROM customer, m")
def median_fill(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return H.fill_median(rows, "v").select("c_custkey", F.round("v", 4).alias("v"))


def _written(s, d):
    """Prices, counts, sizes and versions as people write them, made of the numbers of parts."""
    n, z = F.col("p_partkey"), F.col("p_size")
    text = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    version = [text(z.cast("string"), ".", (n % 7).cast("string"), ".", (n % 3).cast("string")), F.lit("Varies with device"), text(z.cast("string"), ".0-beta ", (n % 5).cast("string")), text("v", z.cast("string"), ".", (n % 9).cast("string"), ".1 [3]")]
    size = [text(z.cast("string"), "M"), text((n % 900 + 100).cast("string"), "k"), F.lit("Varies with device")]
    return table(s, d, "part").select(
        "p_partkey",
        F.when(n % 10 == 0, F.lit("x")).otherwise(text("$", F.format_number(F.round("p_retailprice", 2), 2))).alias("price"),
        text(F.format_number(n * 1000, 0), "+").alias("installs"),
        F.get(F.array(*version), (n % 4).cast("int")).alias("version"),
        F.get(F.array(*size), (n % 3).cast("int")).alias("size"),
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN round(p_retailprice, 2) END AS price, (p_partkey * 1000)::double AS installs FROM part")
def clean_price(s, d):
    return _written(s, d).select("p_partkey", S.price("price").alias("price"), S.price("installs").alias("installs"))


_VERSION = "CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || p_partkey % 7 || '.' || p_partkey % 3 WHEN 1 THEN 'Varies with device' WHEN 2 THEN p_size || '.0-beta ' || p_partkey % 5 ELSE 'v' || p_size || '.' || p_partkey % 9 || '.1 [3]' END"


@query(rf"WITH a AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_VERSION}, '[\[\]]', '', 'g'), '[-+|/:;(_)@]', '0', 'g'), '\s+', '0', 'g'), '[A-Za-z]+', '0', 'g') AS x FROM part) SELECT p_partkey, round(try_cast(CASE WHEN strpos(x, '.') = 0 THEN x ELSE substr(x, 1, strpos(x, '.')) || replace(substr(x, strpos(x, '.') + 1), '.', '') END AS double), 9) AS version FROM a")
def version_normalize(s, d):
    return _written(s, d).select("p_partkey", F.round(S.version_number("version"), 9).alias("version"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::double WHEN 1 THEN round_even((p_partkey % 900 + 100)::double / 1024, 3) END AS size_mb FROM part")
def kb_to_mb(s, d):
    return _written(s, d).select("p_partkey", S.size_mb("size").alias("size_mb"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN epoch(date_trunc('day', o_orderdate))::double END AS epoch FROM orders")
def date_to_epoch(s, d):
    """Dates as people write them; what isn't one is null."""
    written = F.when(F.col("o_orderkey") % 11 == 0, F.lit("not a date")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return table(s, d, "orders").select("o_orderkey", S.epoch(written).cast("double").alias("epoch"))


@query("SELECT event_id, json_extract_string(props, '$.k')::int AS k FROM events")
def props_flatten(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "struct<k: int>")["k"].alias("k"))


@query("SELECT c_custkey, c_custkey::varchar AS id, c_nationkey::int AS sample_item_index, c_mktsegment AS item, c_acctbal AS score FROM customer UNION ALL SELECT c_custkey, 'x' || c_custkey, c_nationkey::int + 1, 'tofu', 0.5::double FROM customer")
def nested_flatten(s, d):
    """A map of structs written as text with single quotes, to rows: two of each customer."""
    kind = "map<string, struct<meta_data: map<string, string>, survey_result: map<string, string>, sample_item_index: int>>"
    one = lambda key, item, score, n: F.concat(F.lit("'"), key, F.lit("': {'meta_data': {'item': '"), item, F.lit("', 'frozen': 'true'}, 'survey_result': {'score': '"), score, F.lit("'}, 'sample_item_index': "), n.cast("string"), F.lit("}"))
    key, n = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    doc = F.concat(F.lit("{"), one(key, F.col("c_mktsegment"), F.col("c_acctbal").cast("string"), n), F.lit(", "), one(F.concat(F.lit("x"), key), F.lit("tofu"), F.lit("0.5"), n + 1), F.lit("}"))
    rows = table(s, d, "customer").select("c_custkey", F.explode(F.from_json(doc, kind)).alias("id", "v"))
    return rows.select("c_custkey", "id", "v.sample_item_index", F.col("v.meta_data")["item"].alias("item"), F.col("v.survey_result")["score"].cast("double").alias("score"))


@query("SELECT o_custkey AS run, o_orderkey AS step, o_totalprice AS loss FROM orders")
def log_history_flatten(s, d):
    """The history inside a trainer's state, a document for each run, to rows."""
    states = table(s, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"))).alias("log_history"))).alias("doc"))
    rows = states.select("run", F.explode(F.from_json("doc", "struct<log_history: array<struct<step: bigint, loss: double>>>")["log_history"]).alias("x"))
    return rows.select("run", "x.step", "x.loss")


@query("SELECT o_orderkey, o_totalprice, o_orderdate::date::varchar AS day FROM orders")
def positional_zip(s, d):
    """Two relations of the same rows side by side: matched by the key they carry, there being no order to match by."""
    o = table(s, d, "orders")
    return H.zip_by_key(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day")), ["o_orderkey"])


@query("SELECT c_custkey AS key, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def union_by_name(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    b = table(s, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return a.unionByName(b)


@query("SELECT t AS threshold, count(*) FILTER (l_discount > t) AS n FROM lineitem, (VALUES (0.02::double), (0.05), (0.08)) v(t) GROUP BY 1")
def param_sweep(s, d):
    """All parameters in one pass over the rows."""
    ts = [0.02, 0.05, 0.08]
    flat = table(s, d, "lineitem").agg(*[F.count_if(F.col("l_discount") > t).alias(f"n{i}") for i, t in enumerate(ts)])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(ts)])).alias("r")).select("r.*")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_10(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT * FROM (SELECT o_orderkey, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL SELECT * FROM (SELECT o_orderkey, 'tail' FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def head_tail(s, d):
    o = table(s, d, "orders").select("o_orderkey")
    return o.orderBy("o_orderkey").limit(5).withColumn("part", F.lit("head")).unionByName(o.orderBy(F.desc("o_orderkey")).limit(5).withColumn("part", F.lit("tail")))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'")
def date_range_scan(s, d):
    return table(s, d, "orders").where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey")


@query("SELECT o_orderkey, (o_orderdate::date - INTERVAL 1 YEAR)::date::varchar AS back FROM orders")
def year_back(s, d):
    """The same day a year before; February 29 becomes the 28th."""
    return table(s, d, "orders").select("o_orderkey", T.year_back(F.to_date("o_orderdate")).cast("string").alias("back"))


@query("SELECT o_orderkey, o_orderdate::date::varchar AS day FROM orders")
def weekly_series(s, d):
    """Days that a file holds as numbers, year first."""
    days = table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date"))
    return days.select("o_orderkey", F.to_date(F.col("date").cast("string"), "yyyyMMdd").cast("string").alias("day"))


@query("SELECT o_orderpriority AS symbol, o_orderdate::date AS date, o_totalprice AS close FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def quotes_scan(s, d):
    """A market-data scan between two dates, over the orders."""
    return T.quotes(table(s, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", date(1995, 1, 1), date(1995, 12, 31))


@query("SELECT column_name AS col, (row_number() OVER () - 1)::int AS pos, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type FROM (DESCRIBE SELECT * FROM part) x(column_name, data_type, a, b, c, e)")
def schema_introspect(s, d):
    return P.introspect(table(s, d, "part"))


@query("SELECT r_name AS name, r_regionkey AS id FROM region")
def rename_reorder(s, d):
    """Positional slice, rename of all columns, reorder, drop of a constant."""
    r = table(s, d, "region")
    return r.select(*r.columns[0:2]).toDF("id", "name").withColumn("k", F.lit(1)).drop("k").select("name", "id")


@query("SELECT count(*) FILTER (c_acctbal < 0) AS n_negative, round(median(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 4) AS med_building, count(*) AS n FROM customer")
def conditional_aggregates(s, d):
    c = table(s, d, "customer")
    med = H.quantiles(c.where("c_mktsegment = 'BUILDING'"), "c_acctbal", [0.5]).select(F.round(F.col("q")[0], 4).alias("med_building"))
    return c.agg(F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.count("*").alias("n")).crossJoin(F.broadcast(med)).select("n_negative", "med_building", "n")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_nationkey = 1 THEN c_acctbal * 2 ELSE c_acctbal END AS v FROM customer")
def conditional_update(s, d):
    b = F.col("c_acctbal")
    return table(s, d, "customer").select("c_custkey", F.when(b < 0, 0.0).when(F.col("c_nationkey") == 1, b * 2).otherwise(b).alias("v"))


@query("SELECT o_orderkey, (('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 4)::int AS fold FROM orders")
def split_fold(s, d):
    """The fold of every order."""
    return table(s, d, "orders").select("o_orderkey", H.hash_fold("o_orderkey", 4).alias("fold"))
