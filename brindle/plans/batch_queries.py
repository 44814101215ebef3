"""Distillation, balance inside batches and rate limits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import balance as K
from brindle.operators import batches as BA
from brindle.operators import distillation as D
from brindle.operators import limits as LM
from brindle.plans.base import TOK, query, r, rr, table, trajectories
from brindle.sources.order import with_row_id

# Distillation. A token's teacher has 4 ids from l_partkey on, its student 5 from l_suppkey on.
LISTS = """x AS (SELECT l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS t, CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE 1e0 END AS m, l_partkey, l_suppkey, l_tax, l_discount FROM lineitem),
  te AS (SELECT row_id, t, m, l_partkey % 6 + j AS id, -(j + 1) * (0.9e0 + l_tax) AS lp FROM x, (SELECT unnest(range(4)) AS j)), st AS (SELECT row_id, t, l_suppkey % 6 + j AS id, -(j + 1) * (1.1e0 + l_discount) AS lp FROM x, (SELECT unnest(range(5)) AS j))"""


def _lists(spark, sf):
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    entries = lambda first, n, lp: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct((first % 6 + j).alias("id"), (-(j + 1) * lp).alias("lp")))
    each = F.struct(*order, entries(F.col("l_partkey"), 4, 0.9 + F.col("l_tax")).alias("teacher"), entries(F.col("l_suppkey"), 5, 1.1 + F.col("l_discount")).alias("student"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("m"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(each)).alias("x"))
    return rows.select(F.col("l_orderkey").alias("row_id"), *[F.col(f"x.{c}").alias(c) for c in ("teacher", "student", "m")])


def _kl_sql(base: str, other: str) -> str:
    return f"""k AS (SELECT a.row_id, a.t, sum(exp(greatest(a.lp, -4)) * (greatest(a.lp, -4) - greatest(coalesce(b.lp, -10), -4))) AS kl, sum(exp(a.lp)) AS own, sum(coalesce(exp(b.lp), 0)) AS covered, count(b.lp) AS shared
      FROM {base} a LEFT JOIN {other} b ON a.row_id = b.row_id AND a.t = b.t AND a.id = b.id GROUP BY 1, 2)"""


def _tokens(df):
    x = df.select("row_id", F.posexplode(F.arrays_zip("kl", "teacher_mass", "student_mass", "shared")).alias("p", "x"))
    return x.select("row_id", (F.col("p") + 1).cast("long").alias("t"), *[r(F.col(f"x.{c}")).alias(c) for c in ("kl", "teacher_mass", "student_mass")], F.col("x.shared").cast("long").alias("shared"))


@query("distillation_forward", f"WITH {LISTS}, {_kl_sql('te', 'st')} SELECT row_id, t, {rr('kl')} AS kl, {rr('own')} AS teacher_mass, {rr('covered')} AS student_mass, shared FROM k")
def distillation_forward(spark, sf):
    return _tokens(D.with_divergence(_lists(spark, sf), clamp=-4.0))


@query("distillation_reverse", f"WITH {LISTS}, {_kl_sql('st', 'te')} SELECT row_id, t, {rr('kl')} AS kl, {rr('covered')} AS teacher_mass, {rr('own')} AS student_mass, shared FROM k")
def distillation_reverse(spark, sf):
    return _tokens(D.with_divergence(_lists(spark, sf), direction="reverse", clamp=-4.0))


@query("distillation_loss", f"""WITH {LISTS}, {_kl_sql('te', 'st')}, z AS (SELECT k.*, greatest(kl, 0) AS v, x.m FROM k JOIN x USING (row_id, t))
  SELECT {rr("sum(least(v, 0.25) * m) / sum(m)")} AS loss, {rr("sum(v * m) / sum(m)")} AS kl_mean, {rr("min(v) FILTER (m > 0)")} AS kl_min, {rr("max(v) FILTER (m > 0)")} AS kl_max, {rr("avg(own) FILTER (m > 0)")} AS teacher_mass, {rr("min(own) FILTER (m > 0)")} AS teacher_mass_min,
  {rr("max(own) FILTER (m > 0)")} AS teacher_mass_max, {rr("avg(covered) FILTER (m > 0)")} AS student_mass, {rr("min(covered) FILTER (m > 0)")} AS student_mass_min, {rr("max(covered) FILTER (m > 0)")} AS student_mass_max FROM z""")
def distillation_loss(spark, sf):
    row = D.distillation_loss(D.with_divergence(_lists(spark, sf), clamp=-4.0), most=0.25)
    return row.select(*[r(c).alias(c) for c in row.columns])


@query("distillation_estimated", f"WITH {TOK} SELECT {rr('sum(0.5e0 * (lp - ref) * (lp - ref) * m) / sum(m)')} AS loss, {rr('sum(abs(0.5e0 * (lp - ref) * (lp - ref)) * m) / sum(m)')} AS abs_loss FROM tok")
def distillation_estimated(spark, sf):
    row = D.estimated_loss(trajectories(spark, sf), "k2")
    return row.select(r("loss").alias("loss"), r("abs_loss").alias("abs_loss"))


# Balance inside batches of documents in order of doc_id.


def _documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source", K.workload(F.col("n_chars")).alias("load"))
    return with_row_id(docs, "doc_id")


def _greedy_sql(size: int, parts: int) -> str:
    """Items of each batch, in order, to the part of the least sum with room (ties: the first)."""
    room = size // parts
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, 24576 * n_chars + n_chars * n_chars AS load FROM documents),
      w AS (SELECT row_id, row_id // {size} AS batch, row_id % {size} AS i, load FROM d WHERE row_id < (SELECT count(*) // {size} * {size} FROM d)),
      g AS (SELECT batch, -1::BIGINT AS i, -1::BIGINT AS row_id, -1::BIGINT AS part, [0::HUGEINT FOR _ IN range({parts})] AS sums, [0::BIGINT FOR _ IN range({parts})] AS used FROM w WHERE i = 0
        UNION ALL SELECT batch, i, row_id, part, [CASE WHEN p - 1 = part THEN sums[p] + load ELSE sums[p] END FOR p IN range(1, {parts} + 1)], [CASE WHEN p - 1 = part THEN used[p] + 1 ELSE used[p] END FOR p IN range(1, {parts} + 1)]
        FROM (SELECT g.batch, w.i, w.row_id, w.load, g.sums, g.used, list_position(g.sums, list_min([g.sums[p] FOR p IN range(1, {parts} + 1) IF g.used[p] < {room}])) AS _, list_sort([struct_pack(s := g.sums[p], p := p - 1) FOR p IN range(1, {parts} + 1) IF g.used[p] < {room}])[1].p AS part FROM g JOIN w ON w.batch = g.batch AND w.i = g.i + 1))
      SELECT row_id, batch, part::INT AS part FROM g WHERE i >= 0"""


@query("balance_batches_greedy", _greedy_sql(20, 4))
def balance_batches_greedy(spark, sf):
    docs = _documents(spark, sf)
    n = docs.count() // 20 * 20
    return BA.balance_batches(docs.where(F.col("row_id") < n), 20, 4, method="greedy").select("row_id", "batch", "part")


@query("balance_batches")
def balance_batches(spark, sf):
    """Which part an item lands in has no SQL form; a test compares every item with a plain
    reading of the method."""
    docs = _documents(spark, sf)
    n = docs.count() // 40 * 40
    return BA.balance_batches(docs.where(F.col("row_id") < n), 40, 8, minibatch=8 * 2)


@query("balance_micro_batches")
def balance_micro_batches(spark, sf):
    docs = _documents(spark, sf)
    most = docs.agg(F.max("n_chars")).first()[0] or 1
    return BA.micro_batches(docs, 50, most, "n_chars", multiple=2)


# Rate limits: events of a second each, in order of event_id.


@query("rate_limit", f"""WITH RECURSIVE q AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i, (event_id * 1e0) AS a, (user_id % 7) * 0.5e0 AS c FROM events),
  s AS (SELECT 0::BIGINT AS i, 0::BIGINT AS event_id, 0e0 AS started, -1e300 AS v, 0e0 AS a UNION ALL
    SELECT q.i, q.event_id, greatest(q.a, greatest(s.v, q.a) - (2.5e0 - q.c) / 1.5e0), greatest(s.v, q.a) + q.c / 1.5e0, q.a FROM s JOIN q ON q.i = s.i + 1)
  SELECT event_id, {rr("started")} AS started, {rr("started - a")} AS waited FROM s WHERE i > 0""")
def rate_limit(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") * 1.0).alias("a"), ((F.col("user_id") % 7) * 0.5).alias("c"))
    found = LM.token_bucket(e, "a", "c", 1.5, 2.5, ["event_id"], range_rows=64)
    return found.select("event_id", r("started").alias("started"), r("waited").alias("waited"))
