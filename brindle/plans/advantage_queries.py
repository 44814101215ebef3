"""Advantage estimators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import tokens as T
from brindle.operators import advantages as A
from brindle.plans.base import SAMPLE, TOK, TRAJ, long_tokens, query, r, rr, samples, spread, trajectories

GAMMA, LAM = 0.9, 0.8


def _scored(df: DataFrame) -> DataFrame:
    return df.select("uid", "row_id", r("adv").alias("adv"))


def _sample_sql(expr: str, more: str = "") -> str:
    return f"WITH {SAMPLE}{more} SELECT uid, row_id, {rr(expr)} AS adv FROM sample"


W = "OVER (PARTITION BY uid)"
MEAN = f"CASE WHEN count(*) {W} = 1 THEN 0 ELSE avg(score) {W} END"
STD = f"CASE WHEN count(*) {W} = 1 THEN 1 ELSE stddev_samp(score) {W} END"
FLOORED = f"CASE WHEN count(*) {W} = 1 THEN 1 ELSE sqrt(greatest(var_samp(score) {W}, 1e-6)) END"


@query("adv_grpo", _sample_sql(f"(score - {MEAN}) / ({STD} + 1e-6)"))
def adv_grpo(spark, sf):
    return _scored(A.grpo(samples(spark, sf)))


@query("adv_grpo_unscaled", _sample_sql(f"score - {MEAN}"))
def adv_grpo_unscaled(spark, sf):
    return _scored(A.grpo(samples(spark, sf), by_std=False))


@query("adv_grpo_vectorized", _sample_sql(f"(score - {MEAN}) / ({FLOORED} + 1e-6)"))
def adv_grpo_vectorized(spark, sf):
    return _scored(A.grpo_vectorized(samples(spark, sf)))


@query("group_mean_std", f"""WITH {SAMPLE} SELECT uid, {rr("CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END")} AS mean,
  {rr("CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(score), 1e-6)) END")} AS std, count(*) AS count FROM sample GROUP BY uid""")
def group_mean_std(spark, sf):
    g = A.group_mean_std(samples(spark, sf))
    return g.select("uid", r("mean").alias("mean"), r("std").alias("std"), "count")


@query("group_index", """WITH d AS (SELECT DISTINCT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS gidx FROM events)
  SELECT gidx, event_type, count(*) AS n FROM events JOIN d USING (event_type) GROUP BY ALL""")
def group_index(spark, sf):
    rows = A.group_index(spark.read.parquet(f"{sf}/events.parquet").select("event_type"), "event_type")
    return rows.groupBy(F.col("gidx").cast("long").alias("gidx"), "event_type").agg(F.count("*").alias("n"))


# Longs above 2^53 that a double can't tell apart, numbers near integers or not, and nulls.
LABELS = {
    "long": "9007199254740992 + user_id % 7", "near": "user_id % 5 + 0.0000004e0", "mixed": "user_id % 5 + 0.4e0 * (user_id % 2)",
    "text": "CASE WHEN user_id % 3 = 0 THEN 'x' ELSE concat('0', user_id % 4) END", "digits": "concat('0', user_id % 4)", "none": "CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END",
}
_AS = {"near": "round({})", "digits": "CAST({} AS BIGINT)"}


def _labels_sql() -> str:
    parts = [f"SELECT '{k}' AS kind, event_id, dense_rank() OVER (ORDER BY {_AS.get(k, '{}').format(e)} NULLS LAST) - 1 AS gidx FROM events" for k, e in LABELS.items()]
    return f"SELECT kind, gidx, count(*) AS n, min(event_id) AS first FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query("group_index_kinds", _labels_sql())
def group_index_kinds(spark, sf):
    out = None
    for kind, label in LABELS.items():
        rows = A.group_index(spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.expr(label).alias("uid")))
        rows = rows.groupBy(F.lit(kind).alias("kind"), F.col("gidx").cast("long").alias("gidx")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("adv_grpo_passk", f"""WITH {SAMPLE}, big AS (SELECT * FROM sample QUALIFY count(*) {W} > 1),
  o AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS p FROM big)
  SELECT uid, row_id, {rr(f"CASE WHEN p = 1 THEN (score - min(CASE WHEN p = 2 THEN score END) {W}) / (stddev_samp(score) {W} + 1e-6) ELSE 0 END")} AS adv FROM o""")
def adv_grpo_passk(spark, sf):
    rows = samples(spark, sf).withColumn("_n", F.count("*").over(A.group())).where("_n > 1").drop("_n")
    return _scored(A.grpo_passk(rows))


@query("adv_rloo", _sample_sql(f"CASE WHEN count(*) {W} > 1 THEN (score - avg(score) {W}) * count(*) {W} / (count(*) {W} - 1) ELSE score END"))
def adv_rloo(spark, sf):
    return _scored(A.rloo(samples(spark, sf)))


@query("adv_rloo_vectorized", _sample_sql(f"CASE WHEN count(*) {W} > 1 THEN (count(*) {W} * score - sum(score) {W}) / (count(*) {W} - 1) ELSE 0 END"))
def adv_rloo_vectorized(spark, sf):
    return _scored(A.rloo_vectorized(samples(spark, sf)))


@query("adv_opo", _sample_sql(f"score - CASE WHEN count(*) {W} > 1 THEN sum(length * score) {W} / sum(length) {W} ELSE 0 END"))
def adv_opo(spark, sf):
    return _scored(A.opo(samples(spark, sf)))


@query("adv_gpg", _sample_sql(f"(SELECT count(*) / greatest(sum((score != 0)::INT), 1) FROM sample) * (score - {MEAN})"))
def adv_gpg(spark, sf):
    return _scored(A.gpg(samples(spark, sf)))


WHITEN = """, mu AS (SELECT sum(adv * m) / (sum(m) + 1e-8) AS mu FROM raw),
  va AS (SELECT sum((adv - mu) * (adv - mu) * m) / (sum(m) + 1e-8) * (sum(m) / (sum(m) - 1)) AS va FROM raw, mu)"""


def _white_sql(raw: str, masked: bool = True, extra: str = "") -> str:
    out = "(adv - mu) / sqrt(va + 1e-8)" + (" * m" if masked else "")
    return f"WITH {TOK}, {TRAJ}, raw AS ({raw}){WHITEN} SELECT row_id, t, {rr(out)} AS adv{extra} FROM raw, mu, va"


def _wide(spark, sf) -> DataFrame:
    return trajectories(spark, sf).withColumns({"score": T.total(F.col("r")), "length": T.mask_count("m")})


@query("adv_reinforce_pp_baseline", _white_sql(f"SELECT tok.row_id, t, m, (score - mean) * m AS adv FROM tok JOIN (SELECT row_id, score, {MEAN} AS mean FROM traj) USING (row_id)"))
def adv_reinforce_pp_baseline(spark, sf):
    return spread(A.reinforce_plus_plus_baseline(_wide(spark, sf), "m"), "adv")


@query("adv_gdpo", _white_sql(f"""SELECT tok.row_id, t, m, (1.0 * a1 + 0.5 * a2) * m AS adv FROM tok JOIN (SELECT row_id, (score - {MEAN}) / ({STD} + 1e-6) AS a1,
  (length - {MEAN.replace('score', 'length')}) / ({STD.replace('score', 'length')} + 1e-6) AS a2 FROM traj) USING (row_id)"""))
def adv_gdpo(spark, sf):
    rows = _wide(spark, sf).withColumn("accuracy", F.col("score"))
    return spread(A.gdpo(rows, {"accuracy": 1.0, "length": 0.5}, "m"), "adv")


#: A recurrence over tokens from the last to the first; columns of each step as given.
def _backward(first: str, nexts: str) -> str:
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY t DESC) AS b FROM tok),
  scan AS (SELECT *, {first} FROM ordered WHERE b = 1 UNION ALL SELECT o.*, {nexts} FROM scan s JOIN ordered o ON o.row_id = s.row_id AND o.b = s.b + 1)"""


DISCOUNT = _backward("r AS now, r * m AS run", f"o.r + {GAMMA}e0 * s.run, (o.r + {GAMMA}e0 * s.run) * o.m")


@query("scan_discounted_return", f"WITH RECURSIVE {TOK}, {DISCOUNT} SELECT row_id, t, {rr('now')} AS ret FROM scan")
def scan_discounted_return(spark, sf):
    return spread(trajectories(spark, sf).withColumn("ret", A.discounted_return("r", "m", GAMMA)), "ret")


@query("adv_reinforce_pp", f"WITH RECURSIVE {TOK}, {DISCOUNT}, raw AS (SELECT row_id, t, m, now AS adv FROM scan){WHITEN} SELECT row_id, t, {rr('(adv - mu) / sqrt(va + 1e-8) * m')} AS adv, {rr('adv', 6)} AS returns FROM raw, mu, va")
def adv_reinforce_pp(spark, sf):
    return spread(A.reinforce_plus_plus(trajectories(spark, sf), "r", "m", GAMMA), "adv", "returns")


TO_GO = "sum(r * m) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("scan_reward_to_go", f"WITH {TOK} SELECT row_id, t, {rr(TO_GO)} AS ret FROM tok")
def scan_reward_to_go(spark, sf):
    return spread(trajectories(spark, sf).withColumn("ret", A.reward_to_go("r", "m")), "ret")


@query("adv_remax", f"WITH {TOK}, {TRAJ} SELECT row_id, t, {rr(f'{TO_GO} - score * 0.5e0 * m')} AS adv FROM tok JOIN (SELECT row_id, score FROM traj) USING (row_id)")
def adv_remax(spark, sf):
    rows = _wide(spark, sf).withColumn("base", F.col("score") * 0.5)
    return spread(A.remax(rows, "r", "m", "base"), "adv")


FRESH = f"(o.r + {GAMMA}e0 * s.nextv - o.v + {GAMMA * LAM}e0 * s.run)"
GAE = _backward("v * m AS nextv, (r - v) * m AS run", f"o.v * o.m + (1 - o.m) * s.nextv, {FRESH} * o.m + (1 - o.m) * s.run")


@query("adv_gae", f"WITH RECURSIVE {TOK}, {GAE}, raw AS (SELECT row_id, t, m, v, run AS adv FROM scan){WHITEN} SELECT row_id, t, {rr('(adv - mu) / sqrt(va + 1e-8)')} AS adv, {rr('adv + v')} AS returns FROM raw, mu, va")
def adv_gae(spark, sf):
    return spread(A.gae(trajectories(spark, sf), "r", "v", "m", GAMMA, LAM), "adv", "returns")


def _otb_sql(step: str, some: str, weight: str = "") -> str:
    return f"""WITH {TOK}, a AS (SELECT *, {TO_GO} AS ret, sum((1 - 2 * exp(olp) + spi){weight} * m) OVER f AS cw, sum(m) OVER (PARTITION BY row_id) AS len, {step} AS step FROM tok
    WINDOW f AS (PARTITION BY row_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  l AS (SELECT uid, row_id, len, row_number() OVER (PARTITION BY uid ORDER BY len DESC, row_id) AS p FROM (SELECT DISTINCT uid, row_id, len FROM a {some})),
  g AS (SELECT uid, count(*) AS n, max(CASE WHEN p = 1 THEN len END) AS l1, max(CASE WHEN p = 2 THEN len END) AS l2 FROM l GROUP BY uid),
  b AS (SELECT a.*, coalesce(n, 0) AS n, l1, l2, sum(ret * cw * m) OVER s / (sum(cw * m) OVER s + 1e-8) AS base FROM a LEFT JOIN g USING (uid) WINDOW s AS (PARTITION BY uid, step))
  SELECT row_id, t, {rr("(ret - CASE WHEN n < 2 OR (len = l1 AND l1 > l2 AND step > l2) THEN 0 ELSE base END) * m", 5)} AS adv, {rr("ret", 5)} AS returns FROM b"""


@query("adv_optimal_token_baseline", _otb_sql("t", ""))
def adv_otb(spark, sf):
    out = A.optimal_token_baseline(long_tokens(spark, sf).drop("w"))
    return out.select("row_id", "t", r("adv", 5).alias("adv"), r("returns", 5).alias("returns"))


@query("adv_optimal_token_baseline_is", _otb_sql("t", "", " * w * w"))
def adv_otb_is(spark, sf):
    out = A.optimal_token_baseline(long_tokens(spark, sf))
    return out.select("row_id", "t", r("adv", 5).alias("adv"), r("returns", 5).alias("returns"))


@query("adv_tir_optimal_token_baseline", _otb_sql("sum(m) OVER f", "WHERE len > 0"))
def adv_tir_otb(spark, sf):
    out = A.optimal_token_baseline(long_tokens(spark, sf).drop("w"), compact=True)
    return out.select("row_id", "t", r("adv", 5).alias("adv"), r("returns", 5).alias("returns"))


@query("adv_multi_trajectory", f"""WITH {SAMPLE}, s AS (SELECT uid, row_id % 2 AS session, row_id, score FROM sample),
  last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY uid, session ORDER BY row_id DESC) = 1),
  adv AS (SELECT uid, session, (score - {MEAN}) / ({STD} + 1e-6) AS adv FROM last)
  SELECT uid, row_id, {rr("adv")} AS adv FROM s JOIN adv USING (uid, session)""")
def adv_multi_trajectory(spark, sf):
    rows = samples(spark, sf).withColumns({"session": F.col("row_id") % 2, "index": F.col("row_id")})
    return _scored(A.final_session(rows, A.grpo))
