"""Losses, divergences and rollout correction over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brindle.functions import tokens as T
from brindle.operators import correction as C
from brindle.operators import losses as L
from brindle.operators.advantages import whiten
from brindle.plans.base import TOK, query, r, rr, spread, trajectories

MM = "sum({0} * m) / (sum(m) + 1e-8)"
D = "least(greatest(lp - olp, -20), 20)"
Q = f"exp({D})"


def _rounded(df):
    return df.select(*[r(c).alias(c) for c in df.columns])


def _wide(spark, sf, *drop):
    return trajectories(spark, sf).drop("r", "v", "ref", "spi", *drop)


def _loss_sql(loss: str, mode: str = "token-mean", raw_kl: bool = False, **metrics: str) -> str:
    metrics = {k: MM.format(f"({v})") for k, v in metrics.items()}
    metrics["ppo_kl"] = MM.format("(olp - lp)" if raw_kl else f"-({D})")
    rows = f"SELECT row_id, sum(({loss}) * m) AS s, sum(m) AS n, count(*) AS c FROM tok GROUP BY row_id"
    value = {
        "token-mean": "sum(s) / sum(n)", "seq-mean-token-sum": "sum(CASE WHEN n > 0 THEN s END) / sum((n > 0)::INT)",
        "seq-mean-token-sum-norm": "sum(CASE WHEN n > 0 THEN s END) / sum((n > 0)::INT) / max(c)", "seq-mean-token-mean": "sum(CASE WHEN n > 0 THEN s / (n + 1e-8) END) / sum((n > 0)::INT)",
    }[mode]
    return f"WITH {TOK}, rws AS ({rows}) SELECT (SELECT {rr(value)} FROM rws) AS loss, " + ", ".join(f"{rr(v)} AS {k}" for k, v in metrics.items()) + " FROM tok"


FIRST, SECOND = f"-a * {Q}", f"greatest(-a * {Q}, -a * least(greatest({Q}, 0.8e0), 1.2e0))"
VANILLA = f"CASE WHEN a < 0 THEN least(-a * 3, {SECOND}) ELSE {SECOND} END"
VANILLA_METRICS = {"pg_clipfrac": f"CASE WHEN {SECOND} > {FIRST} THEN 1 ELSE 0 END", "pg_clipfrac_lower": f"CASE WHEN {SECOND} > -a * 3 AND a < 0 THEN 1 ELSE 0 END"}

for _mode in L.MODES:

    @query(f"loss_vanilla_{_mode.replace('-', '_')}", _loss_sql(f"({VANILLA}) * w", _mode, **VANILLA_METRICS))
    def loss_vanilla(spark, sf, mode=_mode):
        return _rounded(L.vanilla(_wide(spark, sf), L.Options(mode=mode)))


TV = "CASE WHEN CASE WHEN a > 0 THEN exp(lp) - exp(olp) <= 0.2e0 ELSE exp(lp) - exp(olp) >= -0.2e0 END THEN 1 ELSE 0 END"
BKL = "(exp(olp) * (olp - lp) + (1 - exp(olp)) * ln((1 - exp(olp) + 1e-8) / (1 - exp(lp) + 1e-8)))"
BK = f"CASE WHEN CASE WHEN a > 0 THEN {BKL} <= 0.05e0 OR exp(lp) <= exp(olp) ELSE {BKL} <= 0.05e0 OR exp(lp) >= exp(olp) END THEN 1 ELSE 0 END"


def _dppo_sql(valid: str) -> str:
    return _loss_sql(f"-a * least({Q}, 20) * lp * ({valid}) * w", pg_clipfrac=f"1 - ({valid})", pg_clipfrac_lower=f"CASE WHEN {Q} > 20 THEN ({valid}) ELSE 0 END")


@query("loss_dppo_tv", _dppo_sql(TV))
def loss_dppo_tv(spark, sf):
    return _rounded(L.dppo_tv(_wide(spark, sf)))


@query("loss_dppo_kl", _dppo_sql(BK))
def loss_dppo_kl(spark, sf):
    return _rounded(L.dppo_kl(_wide(spark, sf), L.Options(clip=0.05)))


@query("loss_gspo", f"""WITH {TOK}, sq AS (SELECT *, exp(least(sum((lp - olp) * m) OVER (PARTITION BY row_id) / greatest(sum(m) OVER (PARTITION BY row_id), 1), 10)) AS q FROM tok),
  x AS (SELECT *, -a * q AS l1, -a * least(greatest(q, 0.8e0), 1.2e0) AS l2 FROM sq), rws AS (SELECT row_id, sum(greatest(l1, l2) * w * m) AS s, sum(m) AS n FROM x GROUP BY row_id)
  SELECT (SELECT {rr("sum(CASE WHEN n > 0 THEN s / (n + 1e-8) END) / sum((n > 0)::INT)")} FROM rws) AS loss, {rr(MM.format("(CASE WHEN l2 > l1 THEN 1 ELSE 0 END)"))} AS pg_clipfrac, {rr(MM.format("(olp - lp)"))} AS ppo_kl FROM x""")
def loss_gspo(spark, sf):
    return _rounded(L.gspo(_wide(spark, sf)))


TAU = "(CASE WHEN a > 0 THEN 1e0 ELSE 1.05e0 END)"


@query("loss_sapo", _loss_sql(f"-(1 / (1 + exp(-{TAU} * ({Q} - 1))) * (4 / {TAU})) * a * w", "seq-mean-token-mean"))
def loss_sapo(spark, sf):
    return _rounded(L.sapo(_wide(spark, sf)))


@query("loss_gpg", f"WITH {TOK} SELECT {rr('sum(-lp * a * w * m) / sum(m)')} AS loss FROM tok")
def loss_gpg(spark, sf):
    return _rounded(L.gpg(_wide(spark, sf)))


#: 500 of 60,000 tokens, so that a few of them are chosen.
COV = f"mu AS (SELECT {MM.format('a')} AS ma, {MM.format('lp')} AS ml, sum(m) AS n FROM tok), cov AS (SELECT tok.*, (a - ma) * (lp - ml) AS cov, n FROM tok, mu)"


@query("loss_kl_cov", f"""WITH {TOK}, {COV}, o AS (SELECT *, row_number() OVER (ORDER BY m DESC, cov DESC, row_id, t) <= greatest(floor(n * 0.008e0), 1) AS top FROM cov)
  SELECT {rr("sum((-a * exp(lp - olp) + CASE WHEN top THEN abs(lp - olp) ELSE 0 END) * w * m) / sum(m)")} AS loss, {rr(MM.format("abs(lp - olp)"))} AS ppo_kl FROM o""")
def loss_kl_cov(spark, sf):
    return _rounded(L.kl_cov(_wide(spark, sf), L.Options(cov_ratio=0.008)))


@query("loss_clip_cov", f"""WITH {TOK}, {COV}, f AS (SELECT *, m > 0 AND cov > 0.2e0 AND cov < 5 AND NOT (-a * least(greatest(exp(lp - olp), 0.8e0), 1.2e0) > -a * exp(lp - olp)) AS able FROM cov),
  k AS (SELECT least(greatest(floor(any_value(n) * 0.8e0), 1), sum(able::INT)) AS k FROM f)
  SELECT {rr("k / (sum(m) + 1e-8)")} AS pg_clipfrac, {rr(MM.format("(olp - lp)"))} AS ppo_kl FROM f, k GROUP BY k""")
def loss_clip_cov(spark, sf):
    """The random few can't be named in SQL; how many they are can."""
    return _rounded(L.clip_cov(_wide(spark, sf), L.Options(cov_ratio=0.8, cov_low=0.2)).select("pg_clipfrac", "ppo_kl"))


GD = "least(greatest(lp - olp, -0.2e0), 0.2e0)"
GM = f"sign(a) * least(sign(a) * (lp - olp), sign(a) * {GD})"


@query("loss_geo_mean", f"""WITH {TOK}, rws AS (SELECT row_id, exp(sum({GM} * m) / (sum(m) + 1e-8)) AS q, sum(a * m) / (sum(m) + 1e-8) AS a, exp(sum(ln(w + 1e-10) * m) / (sum(m) + 1e-8)) AS w FROM tok GROUP BY row_id)
  SELECT (SELECT {rr("avg(-a * q * w)")} FROM rws) AS loss, {rr(MM.format(f"(CASE WHEN lp - olp != {GD} AND a > 0 THEN 1 ELSE 0 END)"))} AS pg_clipfrac, {rr(MM.format("(olp - lp)"))} AS ppo_kl,
  {rr(MM.format(f"(CASE WHEN lp - olp != {GD} AND a < 0 THEN 1 ELSE 0 END)"))} AS pg_clipfrac_lower FROM tok""")
def loss_geo_mean(spark, sf):
    return _rounded(L.geo_mean(_wide(spark, sf)))


CLIP = f"least(greatest({Q}, 0.8e0), 1.2e0)"


@query("loss_cispo", _loss_sql(f"-{CLIP} * a * lp * w", pg_clipfrac=f"CASE WHEN {Q} != {CLIP} THEN 1 ELSE 0 END"))
def loss_cispo(spark, sf):
    return _rounded(L.cispo(_wide(spark, sf)))


@query("loss_reinforce", _loss_sql("-a * lp * w", raw_kl=True))
def loss_reinforce(spark, sf):
    return _rounded(L.reinforce(_wide(spark, sf)))


@query("loss_bypass_reinforce", _loss_sql("-a * lp * least(exp(lp - olp), 2) * (CASE WHEN olp - lp BETWEEN ln(0.9e0) AND ln(1.3e0) THEN 1 ELSE 0 END)", raw_kl=True).replace(
    " FROM lineitem)", " FROM lineitem), all_tok AS (SELECT * FROM tok)").replace("FROM tok", "FROM kept").replace("all_tok AS (SELECT * FROM kept)", "kept AS (SELECT * REPLACE (m * CASE WHEN olp - lp BETWEEN ln(0.9e0) AND ln(1.3e0) THEN 1 ELSE 0 END AS m) FROM tok)"))
def loss_bypass_reinforce(spark, sf):
    return _rounded(L.bypass_mode(_wide(spark, sf), kind="reinforce", rejection={"token_k1": (0.9, 1.3)}))


@query("loss_bypass_ppo_clip", _loss_sql(VANILLA, **VANILLA_METRICS).replace(
    " FROM lineitem)", " FROM lineitem), all_tok AS (SELECT * FROM tok)").replace("FROM tok", "FROM kept").replace("all_tok AS (SELECT * FROM kept)", "kept AS (SELECT * REPLACE (m * CASE WHEN olp - lp BETWEEN ln(0.9e0) AND ln(1.3e0) THEN 1 ELSE 0 END AS m) FROM tok)"))
def loss_bypass_ppo_clip(spark, sf):
    """Clipped ratios to the rollout's policy, without weights, on what isn't rejected."""
    return _rounded(L.bypass_mode(_wide(spark, sf), kind="ppo_clip", rejection={"token_k1": (0.9, 1.3)}))


VC = "least(greatest(lp, v - 0.5e0), v + 0.5e0)"


@query("loss_value", f"WITH {TOK} SELECT {rr(f'0.5e0 * sum(greatest((lp - r) * (lp - r), ({VC} - r) * ({VC} - r)) * m) / sum(m)')} AS loss, {rr(MM.format(f'(CASE WHEN ({VC} - r) * ({VC} - r) > (lp - r) * (lp - r) THEN 1 ELSE 0 END)'))} AS vf_clipfrac FROM tok")
def loss_value(spark, sf):
    rows = trajectories(spark, sf).selectExpr("lp AS vpred", "v AS values", "r AS ret", "m")
    return _rounded(L.value_loss(rows, 0.5))


@query("loss_entropy", f"WITH {TOK} SELECT {rr('sum(-lp * exp(lp) * m) / sum(m)')} AS loss FROM tok")
def loss_entropy(spark, sf):
    rows = trajectories(spark, sf).withColumn("e", F.transform("lp", lambda x: -x * F.exp(x)))
    return _rounded(rows.agg(L.agg_loss(F.col("e"), "token-mean").alias("loss")))


KL_SQL = {
    "k1": "lp - ref", "abs": "abs(lp - ref)", "k2": "0.5e0 * (lp - ref) * (lp - ref)",
    "k3": "least(greatest(exp(least(greatest(ref - lp, -20), 20)) - least(greatest(ref - lp, -20), 20) - 1, -10), 10)",
}


@query("kl_penalty", f"WITH {TOK} SELECT row_id, t, " + ", ".join(f"{rr(e)} AS {k}" for k, e in KL_SQL.items()) + " FROM tok")
def kl_penalty(spark, sf):
    rows = trajectories(spark, sf)
    return spread(rows.withColumns({k: T.per_token(lambda a, b, k=k: T.kl(k, a, b), "lp", "ref") for k in KL_SQL}), *KL_SQL)


@query("kl_apply_penalty", f"""WITH {TOK}, k AS (SELECT *, 0.1e0 * ({KL_SQL['k3']}) * m AS p FROM tok)
  SELECT row_id, {rr("sum(r - p)")} AS reward, {rr("sum(p * 10 * m) / (sum(m) + 1e-8)")} AS kl FROM k GROUP BY row_id""")
def kl_apply_penalty(spark, sf):
    rows = trajectories(spark, sf).withColumn("kld", T.per_token(lambda a, b, m: T.kl("low_var_kl", a, b) * m, "lp", "ref", "m"))
    rows = rows.withColumn("rewards", T.per_token(lambda x, k: x - 0.1 * k, "r", "kld"))
    return rows.select("row_id", r(T.total(F.col("rewards"))).alias("reward"), r(T.masked_mean("kld", "m")).alias("kl"))


@query("kl_compute_rewards", f"WITH {TOK} SELECT row_id, t, {rr('r - 0.2e0 * (olp - ref)')} AS reward FROM tok")
def kl_compute_rewards(spark, sf):
    rows = trajectories(spark, sf)
    return spread(rows.withColumn("reward", T.per_token(lambda x, o, f: x - 0.2 * (o - f), "r", "olp", "ref")), "reward")


@query("masked_reductions", f"""WITH {TOK} SELECT row_id, {rr("sum(v * m)")} AS total, {rr("sum(v * m) / (sum(m) + 1e-8)")} AS mean, {rr("coalesce(max(CASE WHEN m > 0 THEN v END), 0)")} AS most, sum(m) AS n FROM tok GROUP BY row_id""")
def masked_reductions(spark, sf):
    rows = trajectories(spark, sf)
    return rows.select("row_id", r(T.masked_sum("v", "m")).alias("total"), r(T.masked_mean("v", "m")).alias("mean"), r(T.masked_max("v", "m")).alias("most"), T.mask_count("m").alias("n"))


WHITE = """mu AS (SELECT sum(r * m) / (sum(m) + 1e-8) AS mu FROM tok), va AS (SELECT sum((r - mu) * (r - mu) * m) / (sum(m) + 1e-8) * (sum(m) / (sum(m) - 1)) AS va FROM tok, mu)"""


@query("masked_whiten", f"WITH {TOK}, {WHITE} SELECT row_id, t, {rr('(r - mu) / sqrt(va + 1e-8)')} AS white, {rr('(r - mu) / sqrt(va + 1e-8) + mu')} AS kept_mean FROM tok, mu, va")
def masked_whiten(spark, sf):
    rows = trajectories(spark, sf).withColumns({"white": F.col("r"), "kept_mean": F.col("r")})
    return spread(whiten(whiten(rows, "white", "m"), "kept_mean", "m", shift_mean=False), "white", "kept_mean")


@query("masked_variance", f"WITH {TOK}, {WHITE} SELECT {rr('mu')} AS mean, {rr('va')} AS var FROM mu, va")
def masked_variance(spark, sf):
    rows = trajectories(spark, sf)
    mean = rows.agg(L.mean_of(F.col("r")).alias("mean"), F.sum(T.mask_count("m")).alias("n"))
    rows = rows.join(F.broadcast(mean)).groupBy("mean", "n").agg(L.mean_of(F.transform("r", lambda x: (x - F.col("mean")) * (x - F.col("mean")))).alias("v"))
    return rows.select(r("mean").alias("mean"), r(F.col("v") * (F.col("n") / (F.col("n") - 1))).alias("var"))


@query("response_mask", f"""WITH {TOK}, e AS (SELECT *, (l_q % 7)::INT AS id FROM (SELECT *, (v * 10)::INT AS l_q FROM tok)), f AS (SELECT *, min(CASE WHEN id = 3 THEN t END) OVER (PARTITION BY row_id) AS eos FROM e)
  SELECT row_id, count(*) AS n, sum((eos IS NULL OR t <= eos)::INT)::BIGINT AS kept FROM f GROUP BY row_id""")
def response_mask(spark, sf):
    rows = trajectories(spark, sf).withColumn("ids", F.transform("v", lambda v: F.round(v * 10).cast("int") % 7))
    return rows.select("row_id", F.size("ids").cast("long").alias("n"), T.total(T.response_mask("ids", 3)).cast("long").alias("kept"))


@query("pad_truncate", f"""WITH {TOK}, l AS (SELECT row_id, list(v ORDER BY t) AS x FROM tok GROUP BY row_id)
  SELECT row_id, array_to_string(list_transform(x[1:3], lambda q: round(q * 10)::INT), ',') AS right_cut, array_to_string(list_transform(x[greatest(len(x) - 2, 1):], lambda q: round(q * 10)::INT), ',') AS left_cut,
  array_to_string(list_transform(CASE WHEN len(x) > 3 THEN list_concat(x[1:1], x[len(x) - 1:]) ELSE x END, lambda q: round(q * 10)::INT), ',') AS middle_cut, greatest(len(x), 5)::BIGINT AS padded FROM l""")
def pad_truncate(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda q: F.round(q * 10).cast("int").cast("string")), ",")
    rows = trajectories(spark, sf)
    return rows.select("row_id", text(T.truncate("v", 3)).alias("right_cut"), text(T.truncate("v", 3, "left")).alias("left_cut"), text(T.truncate("v", 3, "middle")).alias("middle_cut"), F.size(T.pad_to("v", 5, F.lit(0.0))).cast("long").alias("padded"))


@query("unpad_rows", f"WITH {TOK} SELECT row_id, t - 1 AS place, {rr('v')} AS v FROM (SELECT row_id, v, row_number() OVER (PARTITION BY row_id ORDER BY t) AS t FROM tok WHERE m > 0)")
def unpad_rows(spark, sf):
    rows = trajectories(spark, sf).withColumn("kept", T.unpad("v", "m"))
    return rows.select("row_id", F.posexplode("kept").alias("place", "v")).select("row_id", F.col("place").cast("long").alias("place"), r("v").alias("v"))


# Rollout correction.

LR = "(lp - olp)"
K3 = f"(exp({LR}) - 1 - {LR})"
RAWT, RAWS = f"(exp({LR}) * m)", "(exp(least(greatest(sum((lp - olp) * m) OVER (PARTITION BY row_id), -20), 20)) * m)"


def _lr(spark, sf):
    return trajectories(spark, sf).withColumn("lr", T.per_token(lambda a, b: a - b, "lp", "olp"))


@query("correction_is_weights", f"""WITH {TOK} SELECT row_id, t, {rr(f"least({RAWT}, 1.2e0)")} AS token, {rr(f"least({RAWS}, 2)")} AS sequence,
  {rr(f"CASE WHEN {RAWT} BETWEEN 0.9e0 AND 1.2e0 THEN {RAWT} ELSE 0 END")} AS icepop FROM tok""")
def correction_is_weights(spark, sf):
    rows = _lr(spark, sf).withColumns({"token": C.is_weights("lr", "m", "token", 1.2), "sequence": C.is_weights("lr", "m", "sequence", 2.0), "icepop": C.is_weights("lr", "m", "token", "0.9_1.2")})
    return spread(rows, "token", "sequence", "icepop")


@query("correction_normalised", f"WITH {TOK}, x AS (SELECT *, least({RAWT}, 1.2e0) AS wt FROM tok) SELECT row_id, t, {rr('wt / (SELECT sum(wt * m) / (sum(m) + 1e-8) FROM x)')} AS wt FROM x")
def correction_normalised(spark, sf):
    rows = _lr(spark, sf).withColumn("wt", C.is_weights("lr", "m", "token", 1.2))
    return spread(C.normalise_weights(rows, "wt", "m", "token"), "wt")


STAT = {"k1": f"-{LR}", "k2": f"0.5e0 * {LR} * {LR}", "k3": K3}
TEST = {"k1": ("0.95_1.1", f"BETWEEN {math.log(0.95)!r}::DOUBLE AND {math.log(1.1)!r}::DOUBLE"), "k2": ("0.01", "<= 0.01e0"), "k3": ("0.01", "<= 0.01e0")}


def _reject_sql() -> str:
    cols = []
    for o in C.OPTIONS:
        k = o[-2:]
        if o in C.TOKEN_OPTIONS:
            cond = f"{STAT[k]} {TEST[k][1]}"
        else:
            over = "OVER (PARTITION BY row_id)"
            how = o.split("_")[1]
            stat = f"coalesce(max(CASE WHEN m > 0 THEN {STAT[k]} END) {over}, 0)" if how == "max" else f"sum({STAT[k]} * m) {over}" + (f" / (sum(m) {over} + 1e-8)" if how == "mean" else "")
            cond = f"{stat} {TEST[k][1]}"
        cols.append(f"CASE WHEN {cond} THEN m ELSE 0 END AS {o}")
    return f"WITH {TOK}, x AS (SELECT row_id, {', '.join(cols)} FROM tok) SELECT row_id, " + ", ".join(f"sum({o})::BIGINT AS {o}" for o in C.OPTIONS) + " FROM x GROUP BY row_id"


@query("correction_rejection", _reject_sql())
def correction_rejection(spark, sf):
    rows = _lr(spark, sf)
    masks = {o: C.rejection_mask("lr", "m", o, *C.parse_rejection(o, TEST[o[-2:]][0])[o]) for o in C.OPTIONS}
    return rows.select("row_id", *[T.total(m).cast("long").alias(o) for o, m in masks.items()])


@query("correction_combined", f"""WITH {TOK}, x AS (SELECT *, CASE WHEN {LR} * -1 BETWEEN {math.log(0.9)!r}::DOUBLE AND {math.log(1.1)!r}::DOUBLE AND sum({K3} * m) OVER (PARTITION BY row_id) / (sum(m) OVER (PARTITION BY row_id) + 1e-8) <= 0.02e0 THEN m ELSE 0 END AS kept FROM tok),
  g AS (SELECT row_id, max(CASE WHEN m > 0 AND kept <= 0 THEN 1 ELSE 0 END) AS gone FROM x GROUP BY row_id)
  SELECT {rr("sum(CASE WHEN m > 0 AND kept <= 0 THEN 1 ELSE 0 END) / (sum(m) + 1e-8)")} AS masked_fraction, (SELECT {rr("avg(gone)")} FROM g) AS seq_masked_fraction FROM x""")
def correction_combined(spark, sf):
    rows = C.correct(_lr(spark, sf), "lr", "m", "token", 2.0, "token_k1,seq_mean_k3", "0.9_1.1,0.02")
    return _rounded(C.rejection_metrics(rows))


def _is_sql(level: str, high: float) -> str:
    raw = RAWT if level == "token" else RAWS
    ends = (f"max(CASE WHEN m > 0 THEN wt END) AS is_max, min(CASE WHEN m > 0 THEN wt END) AS is_min, {MM.format(f'(CASE WHEN raw > {high} THEN 1 ELSE 0 END)')} AS fraction_high, {MM.format(f'(CASE WHEN raw < {1 / high} THEN 1 ELSE 0 END)')} AS fraction_low"
            if level == "token" else f"exp(least(max(ls), 20)) AS is_max, exp(min(ls)) AS is_min, (SELECT avg((ls > ln({high}))::INT) FROM rws) AS fraction_high, (SELECT avg((ls < ln({1 / high}))::INT) FROM rws) AS fraction_low")
    names = ["is_mean", "is_max", "is_min", "fraction_high", "fraction_low", "is_std", "ess", "seq_mean", "seq_std", "seq_max", "seq_min", "seq_max_deviation", "seq_fraction_high", "seq_fraction_low"]
    return f"""WITH {TOK}, x AS (SELECT *, {raw} AS raw, least({raw}, {high}) AS wt, sum((lp - olp) * m) OVER (PARTITION BY row_id) AS ls FROM tok),
  rws AS (SELECT row_id, {MM.format("wt")} AS q, any_value(ls) AS ls FROM x GROUP BY row_id),
  g AS (SELECT {MM.format("wt")} AS is_mean, {ends}, {MM.format("wt * wt")} AS w2 FROM x),
  s AS (SELECT avg(q) AS seq_mean, stddev_samp(q) AS seq_std, max(q) AS seq_max, min(q) AS seq_min, max(abs(q - 1)) AS seq_max_deviation, avg((q > {high})::INT) AS seq_fraction_high, avg((q < {1 / high})::INT) AS seq_fraction_low FROM rws),
  z AS (SELECT *, sqrt(greatest(w2 - is_mean * is_mean, 0)) AS is_std, (is_mean + 1e-8) * (is_mean + 1e-8) / w2 AS ess FROM g, s) SELECT {", ".join(f"{rr(n)} AS {n}" for n in names)} FROM z"""


@query("correction_is_metrics_token", _is_sql("token", 1.25))
def correction_is_metrics_token(spark, sf):
    return _rounded(C.is_metrics(_lr(spark, sf), "lr", "m", "token", 1.25))


@query("correction_is_metrics_sequence", _is_sql("sequence", 2.0))
def correction_is_metrics_sequence(spark, sf):
    return _rounded(C.is_metrics(_lr(spark, sf), "lr", "m", "sequence", 2.0))


OFF = {
    "training_ppl": "avg(exp(-tr))", "training_log_ppl": "avg(-tr)", "rollout_ppl": "avg(exp(-ro))", "rollout_log_ppl": "avg(-ro)", "log_ppl_diff": "avg(ro - tr)", "log_ppl_abs_diff": "avg(abs(ro - tr))",
    "log_ppl_diff_max": "max(ro - tr)", "log_ppl_diff_min": "min(ro - tr)", "ppl_ratio": "avg(exp(ro - tr))", "chi2_seq": "avg(exp(2 * least(greatest(ls, -20), 20))) - 1",
}
OFF_TOK = {"kl": f"-{LR}", "k3_kl": K3, "chi2_token": f"exp(2 * {LR})"}


@query("correction_offpolicy", f"""WITH {TOK}, rws AS (SELECT row_id, {MM.format("lp")} AS tr, {MM.format("olp")} AS ro, sum((lp - olp) * m) AS ls FROM tok GROUP BY row_id)
  SELECT {", ".join(f"(SELECT {rr(e)} FROM rws) AS {k}" for k, e in OFF.items())}, {", ".join(f"{rr(MM.format(e) + (' - 1' if k == 'chi2_token' else ''))} AS {k}" for k, e in OFF_TOK.items())} FROM tok""")
def correction_offpolicy(spark, sf):
    return _rounded(C.offpolicy_metrics(trajectories(spark, sf), "lp", "olp", "m"))
