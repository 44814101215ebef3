"""Metric rollups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import tokens as T
from brindle.operators import metrics as M
from brindle.operators import selection as SE
from brindle.plans.base import TOK, query, r, rr, table, trajectories


def _rounded(df, digits=6):
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


N = "n > 0"


@query("metrics_data", f"""WITH {TOK}, rws AS (SELECT row_id, sum(r) AS score, sum(r * 0.5e0) AS reward, sum(v) AS p, sum(m) AS n, count(*) AS c FROM tok GROUP BY row_id)
  SELECT {", ".join(f"(SELECT {rr(f'{g}(CASE WHEN n > 0 THEN {c} END)')} FROM rws) AS {c}_{k}" for c in ("score", "reward") for k, g in (("mean", "avg"), ("max", "max"), ("min", "min")))},
  {", ".join(f"{rr(f'{g}({c}) FILTER (m > 0)')} AS {o}_{k}" for o, c in (("adv", "a"), ("ret", "r"), ("values", "v")) for k, g in (("mean", "avg"), ("max", "max"), ("min", "min")))},
  {", ".join(f"(SELECT {rr(e)} FROM rws) AS {k}" for k, e in (("response_length_mean", "avg(n)"), ("response_length_max", "max(n)"), ("response_length_min", "min(n)"), ("aborted_ratio", "avg((n = 0)::INT)"), ("non_aborted_length_mean", "avg(CASE WHEN n > 0 THEN n END)"), ("prompt_length_mean", "avg(p)"), ("prompt_length_max", "max(p)"), ("prompt_length_min", "min(p)")))},
  {rr("1 - var_samp(r - v) FILTER (m > 0) / (var_samp(r) FILTER (m > 0) + 1e-5)")} AS explained_var, (SELECT max(c)::INT FROM rws) AS longest FROM tok""")
def metrics_data(spark, sf):
    rows = trajectories(spark, sf).withColumnsRenamed({"a": "adv", "r": "ret", "v": "values"})
    rows = rows.withColumns({"score": T.total(F.col("ret")), "reward": T.total(F.col("ret")) * 0.5, "prompt_length": T.total(F.col("values"))})
    return _rounded(M.data_metrics(rows))


KV = "kv AS (SELECT 'm/' || event_type || CASE WHEN user_id % 3 = 0 THEN '/max' WHEN user_id % 3 = 1 THEN '/min' ELSE '' END AS key, value, event_id AS step, user_id + 1 AS weight FROM events)"


def _kv(spark, sf):
    e = table(spark, sf, "events")
    part = F.when(F.col("user_id") % 3 == 0, "/max").when(F.col("user_id") % 3 == 1, "/min").otherwise("")
    return e.select(F.concat(F.lit("m/"), "event_type", part).alias("key"), "value", F.col("event_id").alias("step"), (F.col("user_id") + 1).alias("weight"))


@query("metrics_reduce", f"WITH {KV} SELECT key, {rr('CASE WHEN contains(key, $$max$$) THEN max(value) WHEN contains(key, $$min$$) THEN min(value) ELSE avg(value) END')} AS value FROM kv GROUP BY key")
def metrics_reduce(spark, sf):
    return _rounded(M.reduce_by_name(_kv(spark, sf)))


@query("metrics_aggregate_steps", """WITH kv AS (SELECT unnest(['timing_s/', 'mean/', 'max/', 'min/', 'total/', 'last/', 'plain/']) || event_type AS key, value, event_id AS step FROM events)
  SELECT key, CASE WHEN starts_with(key, 'timing_s') OR starts_with(key, 'total') THEN 'sum' WHEN starts_with(key, 'max') THEN 'max' WHEN starts_with(key, 'min') THEN 'min' WHEN starts_with(key, 'last') THEN 'last' ELSE 'avg' END AS rule,
  round(CASE WHEN starts_with(key, 'timing_s') OR starts_with(key, 'total') THEN sum(value) WHEN starts_with(key, 'max') THEN max(value) WHEN starts_with(key, 'min') THEN min(value) WHEN starts_with(key, 'last') THEN max_by(value, step) ELSE avg(value) END, 4) + 0e0 AS value FROM kv GROUP BY key""")
def metrics_aggregate_steps(spark, sf):
    e = table(spark, sf, "events")
    names = F.array(*[F.lit(f"{n}/") for n in ("timing_s", "mean", "max", "min", "total", "last", "plain")])
    rows = e.select(F.explode(names).alias("n"), "event_type", "value", F.col("event_id").alias("step")).select(F.concat("n", "event_type").alias("key"), "value", "step", F.lit(1.0).alias("weight"))
    return _rounded(M.aggregate_steps(rows), 4)


@query("metrics_aggregate_ranks", f"WITH p AS (SELECT event_id // 7 AS position, avg(value) AS v FROM events GROUP BY 1) SELECT {rr('avg(v)')} AS value FROM p")
def metrics_aggregate_ranks(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id % 7 AS rank", "event_id div 7 AS position", "value")
    return _rounded(M.aggregate_ranks(rows, "avg"))


@query("metrics_timing_per_token", f"""WITH t AS (SELECT event_type AS name, sum(value) AS seconds FROM events GROUP BY 1 UNION ALL SELECT 'gen', sum(value) FROM events), n AS (SELECT count(*) AS p, sum(user_id) AS q FROM events)
  SELECT name, {rr("seconds * 1000 / CASE WHEN name = 'gen' THEN q ELSE p + q END")} AS ms_per_token FROM t, n""")
def metrics_timing_per_token(spark, sf):
    e = table(spark, sf, "events")
    times = e.groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("seconds"))
    times = times.unionByName(e.agg(F.sum("value").alias("seconds")).withColumn("name", F.lit("gen")))
    return _rounded(M.timing_per_token(times, e.agg(F.count("*").alias("prompt_tokens"), F.sum("user_id").alias("response_tokens"))))


@query("metrics_throughput", f"SELECT event_type, {rr('count(*) / (sum(value) * 8)', 8)} AS per_gpu FROM events GROUP BY 1")
def metrics_throughput(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return g.select("event_type", r(M.throughput(F.col("n"), F.col("s"), 8), 8).alias("per_gpu"))


@query("metrics_processing_stats", f"SELECT {', '.join(f'{rr(e)} AS {k}' for k, e in (('avg', 'avg(value)'), ('max', 'max(value)'), ('min', 'min(value)'), ('tp50', 'quantile_cont(value, 0.5)'), ('tp95', 'quantile_cont(value, 0.95)'), ('tp99', 'quantile_cont(value, 0.99)')))} FROM events")
def metrics_processing_stats(spark, sf):
    return _rounded(M.processing_stats(table(spark, sf, "events"), "value"))


@query("metrics_slowest", f"SELECT {rr('min(value)')} AS min, {rr('max(value)')} AS max, {rr('avg(value)')} AS mean, (SELECT event_id FROM events ORDER BY value DESC, event_id DESC LIMIT 1) AS slowest FROM events")
def metrics_slowest(spark, sf):
    return _rounded(M.slowest(table(spark, sf, "events"), "value", "event_id"))


@query("metrics_partial_rollout", f"WITH s AS (SELECT conv_id, abs(max(turn) - min(turn)) AS span FROM conversations GROUP BY 1) SELECT avg((span > 0)::INT)::DOUBLE AS partial_ratio, max(span) AS max_span, {rr('avg(span)')} AS mean_span FROM s")
def metrics_partial_rollout(spark, sf):
    s = table(spark, sf, "conversations").groupBy("conv_id").agg(F.abs(F.max("turn") - F.min("turn")).alias("span"))
    return s.agg(F.avg(F.when(F.col("span") > 0, 1.0).otherwise(0.0)).alias("partial_ratio"), F.max("span").alias("max_span"), r(F.avg("span")).alias("mean_span"))


@query("metrics_majority", """WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f, min_by(value, event_id) AS x FROM events GROUP BY ALL)
  SELECT user_id, x AS majority, event_type AS vote, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def metrics_majority(spark, sf):
    return M.majority(table(spark, sf, "events"), ["user_id"], "event_type", "value", "event_id")


@query("metrics_validation", None)
def metrics_validation(spark, sf):
    """Seeded draws have no SQL form; a test compares them with the same draws in numpy."""
    e = table(spark, sf, "events")
    rows = e.selectExpr("event_type AS source", "CAST(user_id AS STRING) AS uid", "event_id AS row_id", "value", "CAST(value AS INT) % 3 AS vote")
    return _rounded(M.validation_metrics(rows, "vote", draws=200))


@query("metrics_validation_means", f"""WITH u AS (SELECT event_type AS source, user_id AS uid, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS best, min(value) AS worst FROM events GROUP BY 1, 2)
  SELECT source, {rr('avg(mean)')} AS mean, {rr('avg(std)')} AS std, {rr('avg(best)')} AS best, {rr('avg(worst)')} AS worst FROM u GROUP BY 1""")
def metrics_validation_means(spark, sf):
    u = table(spark, sf, "events").groupBy(F.col("event_type").alias("source"), "user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("best"), F.min("value").alias("worst"))
    return _rounded(u.groupBy("source").agg(*[F.avg(c).alias(c) for c in ("mean", "std", "best", "worst")]))


@query("metrics_bootstrap", None)
def metrics_bootstrap(spark, sf):
    return _rounded(M.bootstrap_by(table(spark, sf, "events"), ["event_type"], "event_id", "value", 8, draws=200))


@query("metrics_section", """SELECT DISTINCT CASE WHEN role = 'user' THEN 'val-core' ELSE 'val-aux' END || '/' || role || '/' || CASE WHEN role = 'user' THEN 'acc' ELSE 'len' END || '/mean@' || (turn % 4) AS name FROM conversations""")
def metrics_section(spark, sf):
    c = table(spark, sf, "conversations")
    var = F.when(F.col("role") == "user", "acc").otherwise("len")
    return c.select(M.metric_section(F.col("role"), var, F.concat(F.lit("mean@"), (F.col("turn") % 4).cast("string"))).alias("name")).distinct()


@query("metrics_variance_proxy", f"""WITH {TOK}, rws AS (SELECT sum(a * m) / (sum(m) + 1e-8) AS a, sum((1 - 2 * exp(olp) + spi) * m) AS w FROM tok GROUP BY row_id), g AS (SELECT avg(a * a * greatest(w, 0)) AS tp, count(*) AS n, avg(a * a) AS aa, avg(w) AS ww FROM rws)
  SELECT 0.04e0 AS signal_strength, {rr("tp")} AS total_power, {rr("greatest((tp - 0.04e0) / (n - 1), 0)")} AS pure_noise, {rr("aa")} AS expected_a_squared, {rr("ww")} AS expected_w FROM g""")
def metrics_variance_proxy(spark, sf):
    return _rounded(M.variance_proxy(trajectories(spark, sf), 0.2))


@query("metrics_token_diff", f"WITH {TOK} SELECT row_id, sum((m > 0 AND floor(v) != floor(r))::INT)::BIGINT AS n FROM tok GROUP BY row_id")
def metrics_token_diff(spark, sf):
    rows = trajectories(spark, sf).withColumns({"x": F.transform("v", lambda x: F.floor(x)), "y": F.transform("r", lambda x: F.floor(x))})
    return rows.select("row_id", M.token_diff(rows, "x", "y", "m").cast("long").alias("n"))


@query("metrics_probability_diff", f"WITH {TOK}, p AS (SELECT exp(lp) AS p, exp(olp) AS q FROM tok WHERE m > 0) SELECT {rr('max(abs(p - q))')} AS max, {rr('avg(abs(p - q))')} AS mean, {rr('stddev_samp(abs(p - q))')} AS std, {rr('corr(p, q)')} AS pearson, 1 AS valid FROM p")
def metrics_probability_diff(spark, sf):
    return _rounded(M.probability_diff(trajectories(spark, sf), "lp", "olp", "m"))


@query("eval_by_source", f"""WITH {TOK}, rws AS (SELECT row_id, avg(r) AS x FROM tok GROUP BY row_id) SELECT row_id % 5 AS source, {rr('avg(x)')} AS score FROM rws GROUP BY 1""")
def eval_by_source(spark, sf):
    rows = trajectories(spark, sf).select((F.col("row_id") % 5).alias("source"), F.col("r").alias("scores"))
    return _rounded(M.eval_by_source(rows))


@query("metrics_flatten", "SELECT event_id, user_id AS \"actor/user\", event_type AS \"actor/kind/name\", value FROM events")
def metrics_flatten(spark, sf):
    e = table(spark, sf, "events")
    return M.flatten(e.select("event_id", F.struct(F.col("user_id").alias("user"), F.struct(F.col("event_type").alias("name")).alias("kind")).alias("actor"), "value"))


@query("metrics_tail_ratio", f"WITH q AS (SELECT *, quantile_cont(value, 0.9) OVER (PARTITION BY event_type) AS q FROM events) SELECT event_type, {rr('avg(CASE WHEN value >= q THEN value END) / avg(value)')} AS ratio FROM q GROUP BY 1")
def metrics_tail_ratio(spark, sf):
    return _rounded(M.tail_ratio(table(spark, sf, "events"), "value", ["event_type"]))


@query("selection_quantiles", "SELECT event_type, unnest([0.25e0, 0.5e0, 0.99e0]) AS share, round(unnest(quantile_cont(value, [0.25, 0.5, 0.99])), 6) + 0e0 AS value FROM events GROUP BY event_type")
def selection_quantiles(spark, sf):
    """Small bins, so that refinement has work to do at any size."""
    return _rounded(SE.quantiles(table(spark, sf, "events"), "value", [0.25, 0.5, 0.99], ["event_type"], bin_rows=64))


@query("selection_places", "SELECT l_returnflag, place, value FROM (SELECT l_returnflag, l_quantity AS value, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS place FROM lineitem) WHERE place IN (0, 10, 500, 1000)")
def selection_places(spark, sf):
    """Values of many ties at given places of each group."""
    li = table(spark, sf, "lineitem")
    places = li.select("l_returnflag").distinct().withColumn("place", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 10, 500, 1000)])))
    return SE.at_places(li, "l_quantity", places, ["l_returnflag"], bin_rows=50)


@query("selection_first_rows", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem QUALIFY row_number() OVER (ORDER BY l_discount DESC, l_partkey, l_orderkey, l_linenumber, l_suppkey) <= 1500")
def selection_first_rows(spark, sf):
    order = [-F.col("l_discount"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return SE.first_rows(table(spark, sf, "lineitem"), order, 1500, bin_rows=100).select("l_orderkey", "l_linenumber", "l_discount")


@query("metrics_validation_exact", f"""WITH u AS (SELECT event_type AS source, user_id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY ALL)
  SELECT source, metric, {rr("avg(value)")} AS value FROM (SELECT source, 'mean@' || n AS metric, mean AS value FROM u UNION ALL SELECT source, 'std@' || n, std FROM u WHERE n > 1) GROUP BY source, metric""")
def metrics_validation_exact(spark, sf):
    """Those figures of ``validation_metrics`` that aren't drawn."""
    rows = table(spark, sf, "events").selectExpr("event_type AS source", "CAST(user_id AS STRING) AS uid", "event_id AS row_id", "value")
    found = M.validation_metrics(rows, draws=2)
    return _rounded(found.where(F.col("metric").startswith("mean@") | F.col("metric").startswith("std@")))
