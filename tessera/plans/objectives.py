"""Preference objectives over derived log-probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import objectives as O
from tessera.operators import preferences as R
from tessera.plans import views as V
from tessera.sources.tables import table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _d(x: float) -> str:
    return f"{x}::double"


def _ls(x: str) -> str:
    return f"(-(greatest(-({x}), 0::double) + ln(1 + exp(-abs({x})))))"


def _sg(x: str) -> str:
    return f"(1/(1+exp(-({x}))))"


_X, _Y, _Z = "(pc-rc)", "(pr-rr)", "((pc-pr)-(rc-rr))"
_BX, _BY, _BZ = (f"(0.1::double*{v})" for v in (_X, _Y, _Z))
_E = 0.1


def _means(s, d, loss):
    """By line number: single hinge values end in a five that engines round either way."""
    return V.pref_pairs(s, d).groupBy("l_linenumber").agg(F.round(F.avg(loss), 6).alias("loss"))


def _means_sql(loss: str) -> str:
    return f"WITH {V.PREF_PAIRS} SELECT l_linenumber, round(avg({loss}), 6) AS loss FROM pref_pairs GROUP BY 1"


_DPO = {
    "sigmoid": (f"-{_ls(_BZ)}", {}),
    "sigmoid_smoothed": (f"-{_ls(_BZ)}*0.9::double - {_ls('-' + _BZ)}*0.1::double", {"smoothing": 0.1}),
    "robust": (f"(-{_ls(_BZ)}*0.9::double + {_ls('-' + _BZ)}*0.1::double)/0.8::double", {"smoothing": 0.1}),
    "exo_pair": (f"{_sg(_BZ)}*({_ls(_BZ)} - ln(0.999::double)) + {_sg('-' + _BZ)}*({_ls('-' + _BZ)} - ln(0.001::double))", {}),
    "hinge": (f"greatest(1-{_BZ}, 0::double)", {}),
    "ipo": (f"pow({_Z}-5::double, 2)", {}),
    "sppo_hard": (f"pow({_X}-5::double, 2) + pow({_Y}+5::double, 2)", {}),
    "nca_pair": (f"-{_ls(_BX)} - 0.5::double*{_ls('-' + _BX)} - 0.5::double*{_ls('-' + _BY)}", {}),
    "apo_zero": (f"1-{_sg(_BX)}+{_sg(_BY)}", {}),
    "apo_down": (f"{_sg(_BX)}+1-{_sg(f'0.1::double*({_X}-{_Y})')}", {}),
    "discopop": (f"-{_ls(_BZ)}*(1-{_sg(_BZ + '/0.05::double')}) + exp(-{_BZ})*{_sg(_BZ + '/0.05::double')}", {}),
    "sft": ("-pc", {}),
}

for _name, (_sql, _kw) in _DPO.items():

    def _run(s, d, kind=_name.removesuffix("_smoothed"), kw=_kw):
        return V.pref_pairs(s, d).select(*_ID, F.round(O.dpo(kind, **kw), 6).alias("loss")) if kind != "hinge" else _means(s, d, O.dpo(kind, **kw))

    query(_means_sql(_sql) if _name == "hinge" else f"WITH {V.PREF_PAIRS} SELECT {_KEY}, round({_sql}, 6) AS loss FROM pref_pairs", name=f"dpo_{_name}")(_run)


@query(f"WITH {V.PREF_PAIRS}, m AS (SELECT l_linenumber, sum(0.1::double*({_X}+{_Y})/2) AS s, count(*) AS n FROM pref_pairs GROUP BY 1), r AS (SELECT l_linenumber, sum(s) OVER (ORDER BY l_linenumber) / sum(n) OVER (ORDER BY l_linenumber) AS delta FROM m) SELECT l_linenumber, round(avg(-{_ls(_BX + '-delta')} - {_ls('-(' + _BY + '-delta)')}), 6) AS loss FROM pref_pairs JOIN r USING (l_linenumber) GROUP BY 1")
def dpo_bco_pair(s, d):
    """Batches are line numbers; delta is the running reward mean."""
    rows = R.running_delta(V.pref_pairs(s, d), "l_linenumber", 0.1 * ((F.col("pc") - F.col("rc")) + (F.col("pr") - F.col("rr"))) / 2)
    return rows.groupBy("l_linenumber").agg(F.round(F.avg(O.dpo("bco_pair", delta=F.col("delta"))), 6).alias("loss"))


@query(f"WITH {V.PREF_PAIRS}, a AS (SELECT pc-pr AS a, row_number() OVER (ORDER BY pc-pr) AS r FROM pref_pairs), b AS (SELECT rc-rr AS b, row_number() OVER (ORDER BY rc-rr) AS r FROM pref_pairs) SELECT round(avg(-{_ls('0.1::double*(a-b)')}), 6) AS loss, count(*) AS n FROM a JOIN b USING (r)")
def dpo_aot_pair(s, d):
    """Log-ratios of policy and reference sorted and paired."""
    p = V.pref_pairs(s, d)
    return R.rank_paired(p, F.col("pc") - F.col("pr"), F.col("rc") - F.col("rr")).agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n"))


@query(f"WITH {V.PREF_PAIRS}, a AS (SELECT pc-rc AS a, row_number() OVER (ORDER BY pc-rc) AS r FROM pref_pairs), b AS (SELECT pr-rr AS b, row_number() OVER (ORDER BY pr-rr) AS r FROM pref_pairs) SELECT round(avg(-{_ls('0.1::double*(a-b)')}), 6) AS loss, count(*) AS n FROM a JOIN b USING (r)")
def dpo_aot(s, d):
    p = V.pref_pairs(s, d)
    return R.rank_paired(p, F.col("pc") - F.col("rc"), F.col("pr") - F.col("rr")).agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n"))


@query(f"WITH {V.PREF_PAIRS} SELECT {_KEY}, round(exp(least(-({_Y}), 88)) - exp(least(-({_X}), 88)), 5) AS alpha, round({_X}-{_Y}-(-{_ls('-' + _X)} + {_ls('-' + _Y)}), 6) AS js FROM pref_pairs")
def dpo_divergences(s, d):
    return V.pref_pairs(s, d).select(*_ID, F.round(O.divergence_margin("alpha"), 5).alias("alpha"), F.round(O.divergence_margin("js"), 6).alias("js"))


@query(f"WITH {V.PREF_PAIRS} SELECT l_linenumber, round(avg(0.7::double*(-{_ls(_BZ)}) + 0.3::double*greatest(1-{_BZ}, 0::double) + 0.5::double*(-pc)), 6) AS loss FROM pref_pairs GROUP BY 1")
def dpo_multi_loss(s, d):
    """Weighted losses plus the negative log-likelihood of the chosen side."""
    loss = 0.7 * O.dpo("sigmoid") + 0.3 * O.dpo("hinge") + 0.5 * -F.col("pc")
    return V.pref_pairs(s, d).groupBy("l_linenumber").agg(F.round(F.avg(loss), 6).alias("loss"))


@query(f"WITH {V.PREF_PAIRS} SELECT l_linenumber, round(avg(-{_ls(_BZ)} * least(exp(pc/100::double + pr/100::double), 1)), 6) AS loss FROM pref_pairs GROUP BY 1")
def dpo_wpo(s, d):
    """Weighted by the policy's own probability, at most 1."""
    w = F.least(F.exp(F.col("pc") / 100 + F.col("pr") / 100), F.lit(1.0))
    return V.pref_pairs(s, d).groupBy("l_linenumber").agg(F.round(F.avg(O.dpo("sigmoid") * w), 6).alias("loss"))


@query("WITH " + V.TOKEN_LOGPS + " SELECT seq_id, round(sum(CASE WHEN pos < 16 THEN new_lp ELSE 0 END) + 0.5::double*sum(CASE WHEN pos >= 16 THEN new_lp ELSE 0 END), 6) AS lp FROM token_logps WHERE m = 1 GROUP BY 1")
def ld_dpo_logps(s, d):
    """Log-probability with the part behind the shared length weighed down."""
    front = F.col("pos") < 16
    lp = F.sum(F.when(front, F.col("new_lp")).otherwise(0.0)) + 0.5 * F.sum(F.when(front, 0.0).otherwise(F.col("new_lp")))
    return V.token_logps(s, d).where("m = 1").groupBy("seq_id").agg(F.round(lp, 6).alias("lp"))


@query(f"WITH {V.PREF_PAIRS} SELECT round(avg(({_BX} > {_BY})::int), 6) AS accuracy, round(avg({_BX}), 6) AS chosen, round(avg({_BY}), 6) AS rejected, round(avg({_BX}-{_BY}), 6) AS margin FROM pref_pairs")
def pref_accuracy_margin(s, d):
    x, y = 0.1 * (F.col("pc") - F.col("rc")), 0.1 * (F.col("pr") - F.col("rr"))
    return V.pref_pairs(s, d).agg(F.round(F.avg((x > y).cast("int")), 6).alias("accuracy"), F.round(F.avg(x), 6).alias("chosen"), F.round(F.avg(y), 6).alias("rejected"), F.round(F.avg(x - y), 6).alias("margin"))


_KL = "k AS (SELECT doc_id % 8 AS batch, greatest(avg(lr), 0) AS kl FROM unpaired GROUP BY 1)"


@query(f"WITH {V.UNPAIRED}, {_KL} SELECT doc_id, round(CASE WHEN label THEN 1-{_sg('0.1::double*(lr-kl)')} ELSE 1-{_sg('0.1::double*(kl-lr)')} END, 6) AS loss, round(CASE WHEN label THEN 1-{_sg('0.1::double*lr')} ELSE {_sg('0.1::double*lr')} END, 6) AS apo FROM unpaired JOIN k ON doc_id % 8 = batch")
def kto(s, d):
    rows = R.batch_mean(V.unpaired(s, d).withColumn("batch", F.col("doc_id") % 8), "batch", F.col("lr"), "kl", 0.0)
    return rows.select("doc_id", F.round(O.kto("label", "lr", "kl"), 6).alias("loss"), F.round(O.apo_zero_unpaired("label", "lr"), 6).alias("apo"))


@query(f"WITH {V.UNPAIRED}, m AS (SELECT doc_id % 8 AS batch, sum(0.1::double*lr) AS s, count(*) AS n FROM unpaired GROUP BY 1), r AS (SELECT batch, sum(s) OVER (ORDER BY batch) / sum(n) OVER (ORDER BY batch) AS delta FROM m) SELECT doc_id, round(CASE WHEN label THEN -{_ls('0.1::double*lr-delta')} ELSE -{_ls('-(0.1::double*lr-delta)')}*greatest(least({_sg('lr')}/(1-{_sg('lr')}+0.00000001::double), 10), 0.5::double) END, 6) AS loss FROM unpaired JOIN r ON doc_id % 8 = batch")
def bco(s, d):
    rows = R.running_delta(V.unpaired(s, d).withColumn("batch", F.col("doc_id") % 8), "batch", 0.1 * F.col("lr"))
    z = 0.1 * F.col("lr") - F.col("delta")
    loss = F.when(F.col("label"), -O.log_sigmoid(z)).otherwise(-O.log_sigmoid(-z) * O.density_ratio(O.sigmoid("lr")))
    return rows.select("doc_id", F.round(loss, 6).alias("loss"))


_PZ = "(pc-pr)"
_CPO = {
    "sigmoid": f"-{_ls('0.1::double*' + _PZ)}",
    "hinge": f"greatest(1-0.1::double*{_PZ}, 0::double)",
    "ipo": f"pow({_PZ}-5::double, 2)",
    "simpo": f"-{_ls('0.1::double*(' + _PZ + '-5::double)')}",
}

for _name, _sql in _CPO.items():

    def _run(s, d, kind=_name):
        return V.pref_pairs(s, d).select(*_ID, F.round(O.cpo(kind), 6).alias("loss")) if kind != "hinge" else _means(s, d, O.cpo(kind))

    query(_means_sql(_sql) if _name == "hinge" else f"WITH {V.PREF_PAIRS} SELECT {_KEY}, round({_sql}, 6) AS loss FROM pref_pairs", name="simpo" if _name == "simpo" else f"cpo_{_name}")(_run)

_LO = "((pc-pr)-(ln(1-exp(pc))-ln(1-exp(pr))))"


@query(f"WITH {V.PREF_PAIRS} SELECT {_KEY}, round(-pc - 0.1::double*{_ls(_LO)}, 5) AS loss, round({_LO}, 4) AS log_odds FROM pref_pairs")
def orpo(s, d):
    return V.pref_pairs(s, d).select(*_ID, F.round(-F.col("pc") - O.orpo("pc", "pr"), 5).alias("loss"), F.round(O.log_odds("pc", "pr"), 4).alias("log_odds"))


@query(f"WITH {V.PREF_PAIRS} SELECT l_linenumber, round(avg(-{_ls('pc-pr-0.5::double')} + 0.01::double*pow(pc+pr, 2)), 6) AS loss FROM pref_pairs GROUP BY 1")
def reward_bt(s, d):
    return V.pref_pairs(s, d).groupBy("l_linenumber").agg(F.round(F.avg(O.bradley_terry("pc", "pr", 0.5, 0.01)), 6).alias("loss"))


@query(f"WITH {V.PREF_PAIRS}, m AS (SELECT l_linenumber, avg(pc) AS c, avg(pr) AS r FROM pref_pairs GROUP BY 1) SELECT l_linenumber, round(exp(c)/(exp(c)+exp(r)), 6) AS p_chosen FROM m")
def reward_softmax(s, d):
    m = V.pref_pairs(s, d).groupBy("l_linenumber").agg(F.avg("pc").alias("c"), F.avg("pr").alias("r"))
    return m.select("l_linenumber", F.round(F.exp("c") / (F.exp("c") + F.exp("r")), 6).alias("p_chosen"))


@query(f"WITH {V.PREF_PAIRS} SELECT {_KEY}, pc >= pr AS first_wins, round(-{_ls('0.1::double*(CASE WHEN pc >= pr THEN 1 ELSE -1 END)*' + _Z)}, 6) AS loss, round(greatest(pc, pr) - least(pc, pr), 6) AS margin FROM pref_pairs")
def online_dpo_pick(s, d):
    """The better of two completions is chosen, a tie goes to the first."""
    wins = F.col("pc") >= F.col("pr")
    z = F.when(wins, O.margin()).otherwise(-O.margin())
    return V.pref_pairs(s, d).select(*_ID, wins.alias("first_wins"), F.round(-O.log_sigmoid(0.1 * z), 6).alias("loss"), F.round(F.greatest("pc", "pr") - F.least("pc", "pr"), 6).alias("margin"))


@query(f"WITH {V.TOKEN_LOGPS}, q AS (SELECT seq_id, sum(new_lp-ref_lp) AS kl, -sum(new_lp) AS entropy, max(adv) AS score FROM token_logps WHERE m=1 GROUP BY 1) SELECT round(avg(kl), 6) AS kl, round(avg(-0.1::double*kl), 6) AS non_score, round(avg(score-0.1::double*kl), 6) AS rlhf, round(avg(entropy), 6) AS entropy FROM q")
def online_dpo_stats(s, d):
    q = V.token_logps(s, d).where("m = 1").groupBy("seq_id").agg(F.sum(F.col("new_lp") - F.col("ref_lp")).alias("kl"), (-F.sum("new_lp")).alias("entropy"), F.max("adv").alias("score"))
    r = lambda x, n: F.round(F.avg(x), 6).alias(n)
    return q.agg(r(F.col("kl"), "kl"), r(-0.1 * F.col("kl"), "non_score"), r(F.col("score") - 0.1 * F.col("kl"), "rlhf"), r(F.col("entropy"), "entropy"))


@query(f"WITH {V.PREF_PAIRS} SELECT l_linenumber, round(avg(-{_ls(_BZ)} + 0.00001::double*rr), 6) AS loss FROM pref_pairs GROUP BY 1")
def xpo(s, d):
    """Pairwise loss plus a bonus on the reference sample's log-probability."""
    return V.pref_pairs(s, d).groupBy("l_linenumber").agg(F.round(F.avg(O.dpo("sigmoid") + 1e-5 * F.col("rr")), 6).alias("loss"))


@query(f"WITH {V.TOKEN_LOGPS}, q AS (SELECT seq_id, sum(new_lp) AS lp, sum((new_lp-ref_lp)*new_lp) AS k, {_sg('max(adv)')} AS p FROM token_logps WHERE m=1 GROUP BY 1) SELECT round(avg(0.1::double*k - (p-0.5::double)*lp), 6) AS loss FROM q")
def nash_md(s, d):
    q = V.token_logps(s, d).where("m = 1").groupBy("seq_id").agg(F.sum("new_lp").alias("lp"), F.sum((F.col("new_lp") - F.col("ref_lp")) * F.col("new_lp")).alias("k"), O.sigmoid(F.max("adv")).alias("p"))
    return q.agg(F.round(F.avg(0.1 * F.col("k") - (F.col("p") - 0.5) * F.col("lp")), 6).alias("loss"))


@query("SELECT conv_id, turn, turn % 3 = 0 AS first_wins FROM conversations")
def judge_mask(s, d):
    """Rank 0 means that the first completion wins."""
    rank = F.col("turn") % 3
    return table(s, d, "conversations").select("conv_id", "turn", (rank == 0).alias("first_wins"))


@query("SELECT conv_id, turn, CASE WHEN turn = 0 THEN 0.1::double WHEN turn = 1 THEN 0.2 ELSE 0.3 END AS beta FROM conversations")
def scheduled_beta(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", O.scheduled([0.1, 0.2, 0.3], "turn").alias("beta"))
