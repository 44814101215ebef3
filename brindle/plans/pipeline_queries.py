"""Scores, text maps, balance, files and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import scoring as S
from brindle.functions import text as X
from brindle.functions import tokens as T
from brindle.operators import balance as K
from brindle.plans.base import query, r, rr, table
from brindle.sources import files as IO
from brindle.streaming import queues as Q

# Solutions made from events: some right, some wrong, some in another form.
SOLUTION = "'So 3, 14.\\n' || CASE WHEN event_id % 5 = 0 THEN 'no answer' WHEN event_id % 5 = 1 THEN '#### ' || user_id || ',000' ELSE '#### ' || user_id END"
SQL_SOL = f"s AS (SELECT event_id, replace({SOLUTION}, '\\n', chr(10)) AS sol, CASE WHEN event_id % 5 = 1 THEN user_id || '000' WHEN event_id % 7 = 0 THEN 'x' ELSE user_id::VARCHAR END AS truth FROM events)"


def _solutions(spark, sf):
    e = table(spark, sf, "events")
    truth = F.expr("CASE WHEN event_id % 5 = 1 THEN user_id || '000' WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(user_id AS STRING) END")
    return e.select("event_id", F.expr(SOLUTION).alias("sol"), truth.alias("truth"))


@query("score_grade_school", f"WITH {SQL_SOL} SELECT event_id, CASE WHEN NOT contains(sol, '####') THEN 0e0 WHEN replace(regexp_extract(sol, '#### (-?[0-9.,]+)', 1), ',', '') = truth THEN 1e0 ELSE 0.1e0 END AS score FROM s")
def score_grade_school(spark, sf):
    return _solutions(spark, sf).select("event_id", S.grade_school(F.col("sol"), F.col("truth"), format_score=0.1).alias("score"))


@query("score_grade_school_flexible", f"WITH {SQL_SOL}, l AS (SELECT *, list_filter(regexp_extract_all(sol, '-?[0-9.,]+'), lambda x: x != '.')[-1] AS a FROM s) SELECT event_id, CASE WHEN a = truth THEN 1e0 ELSE 0e0 END AS score FROM l")
def score_grade_school_flexible(spark, sf):
    return _solutions(spark, sf).select("event_id", S.grade_school(F.col("sol"), F.col("truth"), "flexible").alias("score"))


@query("score_question_answer", r"""SELECT conv_id, turn, CASE WHEN trim(regexp_replace(regexp_replace(translate(lower(a), '.,!?''"', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) = trim(regexp_replace(regexp_replace(translate(lower(role), '.,!?''"', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) THEN 1e0 ELSE 0e0 END AS score
  FROM (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'The ' || upper(role) || '!' ELSE 'other' END AS a FROM conversations)""")
def score_question_answer(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("The "), F.upper("role"), F.lit("!"))).otherwise("other")
    solution = F.concat(F.lit("<answer>first</answer> then <answer>\n"), said, F.lit("</answer>"))
    return c.select("conv_id", "turn", S.question_answer(solution, F.array("role")).alias("score"))


@query("score_question_answer_part", "SELECT conv_id, turn, CASE WHEN contains('so it is ' || role || ' indeed', CASE WHEN turn % 3 = 0 THEN 'nobody' ELSE role END) THEN 1e0 ELSE 0e0 END AS score FROM conversations")
def score_question_answer_part(spark, sf):
    c = table(spark, sf, "conversations")
    solution = F.concat(F.lit("<answer>So it is the "), "role", F.lit(", indeed.</answer>"))
    target = F.when(F.col("turn") % 3 == 0, "nobody").otherwise(F.col("role"))
    return c.select("conv_id", "turn", S.question_answer(solution, F.array(target), part=True).alias("score"))


@query("score_math", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0e0 ELSE 1e0 END AS score FROM events")
def score_math(spark, sf):
    form = F.when(F.col("event_id") % 3 == 0, "\\dfrac{1}{2}").when(F.col("event_id") % 3 == 1, "0.5").otherwise("\\frac13")
    e = table(spark, sf, "events")
    return e.select("event_id", S.math_score(F.concat(F.lit("thus \\boxed{"), form, F.lit("}")), F.lit("1/2")).alias("score"))


@query("score_contest", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1e0 ELSE -1e0 END AS score, event_id % 2 = 0 AS acc, user_id::VARCHAR AS pred FROM events")
def score_contest(spark, sf):
    e = table(spark, sf, "events")
    truth = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("none")
    rows = e.select("event_id", S.contest_score(F.concat(F.lit("Thinking.\nAnswer: $"), "user_id", F.lit("$ dollars\n")), truth).alias("s"))
    return rows.select("event_id", "s.score", "s.acc", "s.pred")


@query("score_geometry", f"SELECT event_id, {rr('CASE WHEN event_id % 2 = 0 THEN 1e0 ELSE 0.9e0 END')} AS score FROM events")
def score_geometry(spark, sf):
    e = table(spark, sf, "events")
    head = F.when(F.col("event_id") % 2 == 0, "<think>so</think> ").otherwise("")
    sol = F.concat(head, F.lit("\\boxed{"), F.col("user_id").cast("string"), F.lit("}"))
    return e.select("event_id", r(S.geometry_score(sol, F.col("user_id").cast("string"))).alias("score"))


@query("score_dispatch", f"WITH {SQL_SOL} SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 1e0 WHEN NOT contains(sol, '####') THEN 0e0 WHEN replace(regexp_extract(sol, '#### (-?[0-9.,]+)', 1), ',', '') = truth THEN 1e0 ELSE 0e0 END AS score FROM s")
def score_dispatch(spark, sf):
    rows = _solutions(spark, sf)
    odd = F.col("event_id") % 2 == 1
    source = F.when(odd, "aime2024").otherwise("openai/gsm8k")
    sol = F.when(odd, "Answer: 12").otherwise(F.col("sol"))
    truth = F.when(odd, "12").otherwise(F.col("truth"))
    return rows.select("event_id", S.dispatch(source, sol, truth, ["openai/gsm8k"]).alias("score"))


@query("score_overlong_penalty", f"SELECT doc_id, {rr('least(-(n_chars - 800) / 200 * 0.5e0, 0)')} AS penalty FROM documents")
def score_overlong_penalty(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r(T.overlong_penalty(F.col("n_chars"), 1000, 200, 0.5)).alias("penalty"))


@query("text_tool_calls", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS name FROM events""")
def text_tool_calls(spark, sf):
    e = table(spark, sf, "events")
    body = F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("name"), F.struct("user_id").alias("arguments"))))
    rows = e.select("event_id", X.tool_calls(F.concat(F.lit("I call <tool_call>\n"), body, F.lit("\n</tool_call>"))).alias("c"))
    return rows.select("event_id", F.size("c").cast("long").alias("n"), F.try_element_at("c", F.lit(1))["name"].alias("name"))


@query("text_segments", "SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN 3 ELSE 2 END::BIGINT AS n, 'image' AS kind FROM conversations")
def text_segments(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.checked_segments(F.concat(F.lit("look <image>"), F.coalesce("text", F.lit(""))), F.lit(1)).alias("s"))
    return c.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.col("s")[1]["type"].alias("kind"))


@query("text_title_cleanup", r"SELECT page_id, md5(replace(regexp_replace(replace(trim(coalesce(url, '') || ' [title] x  y [note] z'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ')) AS h FROM pages")
def text_title_cleanup(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.md5(X.title_cleanup(F.concat(F.coalesce("url", F.lit("")), F.lit(" [title] x  y [note] z"))).cast("binary")).alias("h"))


@query("text_prompt_rows", "SELECT 'bench' AS data_source, 'user' AS role, md5(text || ' Think.') AS h, item_id AS index, item_id::VARCHAR AS truth FROM benchmark")
def text_prompt_rows(spark, sf):
    b = table(spark, sf, "benchmark")
    rows = b.select(*X.prompt_row("bench", F.col("text"), F.col("item_id").cast("string"), "math", "train", F.col("item_id"), " Think."))
    return rows.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.md5(F.col("prompt")[0]["content"].cast("binary")).alias("h"), F.col("extra_info.index").alias("index"), F.col("reward_model.ground_truth").alias("truth"))


@query("text_preference_rows", "SELECT conv_id AS prompt, turn::VARCHAR AS response, true AS chosen FROM conversations UNION ALL SELECT conv_id, role, false FROM conversations")
def text_preference_rows(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("string").alias("yes"), F.col("role").alias("no"))
    return X.preference_rows(c, "conv_id", "yes", "no")


@query("text_loss_mask", "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN greatest(turn % 5 + 2 - 1, 0) ELSE 0 END)::BIGINT AS ones, sum(turn % 5 + 2)::BIGINT AS n FROM conversations GROUP BY 1")
def text_loss_mask(spark, sf):
    c = table(spark, sf, "conversations")
    each = F.array_sort(F.collect_list(F.struct("turn", "role", (F.col("turn") % 5 + 2).cast("int").alias("len"))))
    rows = c.groupBy("conv_id").agg(each.alias("x")).select("conv_id", F.col("x.role").alias("role"), F.col("x.len").alias("len"))
    rows = rows.withColumn("mask", X.loss_mask("role", "len", prefix=1))
    return rows.select("conv_id", T.total(F.col("mask")).cast("long").alias("ones"), F.size("mask").cast("long").alias("n"))


@query("fn_ceildiv", "SELECT event_id, (event_id + 6) // 7 AS up, ((event_id + 15) // 16) * 16 AS round FROM events")
def fn_ceildiv(spark, sf):
    return table(spark, sf, "events").select("event_id", T.ceildiv(F.col("event_id"), 7).alias("up"), T.roundup_divisible(F.col("event_id"), 16).alias("round"))


# Balance.


@query("balance_workload", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS load FROM documents")
def balance_workload(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.workload(F.col("n_chars")).alias("load"))


def _loads(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.workload(F.col("n_chars")).alias("load"))


@query("balance_differencing", "SELECT count(*) AS n, sum(24576 * n_chars + n_chars * n_chars)::DOUBLE AS load, 8::BIGINT AS parts, true AS even FROM documents")
def balance_differencing(spark, sf):
    """Which part an item lands in has no SQL form; that parts are even and whole has."""
    rows = K.assign(_loads(spark, sf), "doc_id", "load", 8)
    g = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("load").cast("double").alias("load"))
    return g.agg(F.sum("n").alias("n"), F.sum("load").alias("load"), F.count("*").alias("parts"), (F.max("load") < 1.001 * F.min("load")).alias("even"))


@query("balance_greedy", "SELECT count(*) AS n, 5::BIGINT AS parts, true AS even FROM documents")
def balance_greedy(spark, sf):
    rows = K.assign(_loads(spark, sf), "doc_id", "load", 5, method=K.greedy)
    g = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    return g.agg(F.sum("n").alias("n"), F.count("*").alias("parts"), (F.max("load") < 1.5 * F.min("load")).alias("even"))


@query("balance_imbalance", f"WITH g AS (SELECT doc_id % 6 AS part, sum(24576 * n_chars + n_chars * n_chars) AS load FROM documents GROUP BY 1) SELECT min(load)::BIGINT AS min, max(load)::BIGINT AS max, {rr('avg(load)', 2)} AS mean, {rr('max(load) / avg(load)')} AS ratio FROM g")
def balance_imbalance(spark, sf):
    d = K.imbalance(_loads(spark, sf).withColumn("part", F.col("doc_id") % 6), "part", "load")
    return d.select("min", "max", r("mean", 2).alias("mean"), r("ratio").alias("ratio"))


@query("balance_groups", "SELECT count(*) AS n, true AS whole FROM documents")
def balance_groups(spark, sf):
    rows = _loads(spark, sf).withColumn("uid", (F.col("doc_id") / 4).cast("long"))
    out = K.assign_groups(rows, "doc_id", "uid", "load", 4)
    g = out.groupBy("uid").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("n"), (F.max("parts") == 1).alias("whole"))


@query("balance_inverse", "SELECT doc_id AS pos, (SELECT max(doc_id) FROM documents) - doc_id AS row_id FROM documents")
def balance_inverse(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))
    top = d.agg(F.max("row_id").alias("top"))
    return K.inverse(d.join(F.broadcast(top)).select("row_id", (F.col("top") - F.col("row_id")).alias("pos"))).select("pos", "row_id")


@query("multiset_overlap", "WITH l AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT a.user_id, sum(least(a.c, coalesce(b.c, 0))) AS i FROM l a LEFT JOIN l b ON b.user_id = a.user_id + 1 AND b.event_type = a.event_type GROUP BY 1) SELECT user_id, i::BIGINT AS common FROM p")
def multiset_overlap(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    b = c.select((F.col("user_id") - 1).alias("user_id"), "event_type", F.col("c").alias("d"))
    return c.join(b, ["user_id", "event_type"], "left").groupBy("user_id").agg(F.sum(F.least("c", F.coalesce("d", F.lit(0)))).alias("common"))


# Files.


@query("io_parquet_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def io_parquet_roundtrip(spark, sf):
    path = IO.scratch(spark, "batch") + ".parquet"
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.parquet(path)
    return IO.read_any(spark, [path])


@query("io_mixed_scan", "SELECT item_id, md5(text) AS h FROM benchmark UNION ALL SELECT item_id, md5(text) FROM benchmark")
def io_mixed_scan(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", "text")
    base = IO.scratch(spark, "scan")
    b.write.parquet(f"{base}.parquet")
    b.write.json(f"{base}.jsonl")
    return IO.read_any(spark, [f"{base}.parquet", f"{base}.jsonl"], "item_id long, text string").select("item_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("io_jsonl_steps", "SELECT event_id, user_id % 4 AS step, regexp_replace(event_type, '[aeiou]', '*', 'g') AS event_type FROM events")
def io_jsonl_steps(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("step"), "event_type")
    return IO.load_steps(spark, IO.dump_steps(e, IO.scratch(spark, "dump")), "event_id long, step long, event_type string", "[aeiou]", ["event_type"])


@query("io_generations", "SELECT conv_id AS row_id, count(*) AS n, md5(string_agg(coalesce(text, ''), '|' ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def io_generations(spark, sf):
    c = table(spark, sf, "conversations")
    answers = c.select(F.col("conv_id").alias("row_id"), F.col("turn").alias("n"), F.coalesce("text", F.lit("")).alias("response"))
    path = IO.sink_generations(answers.select("row_id").distinct(), answers, IO.scratch(spark, "generations"))
    return spark.read.parquet(path).select("row_id", F.size("responses").cast("long").alias("n"), F.md5(F.array_join("responses", "|").cast("binary")).alias("h"))


@query("io_metric_log", "SELECT event_id AS step, event_type AS key, value FROM events")
def io_metric_log(spark, sf):
    path = IO.scratch(spark, "metrics")
    e = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("key"), "value")
    return spark.read.schema("step long, key string, value double").json(IO.log_metrics(e, path))


@query("io_step_cache", "SELECT event_id, value FROM events WHERE user_id % 3 = 1")
def io_step_cache(spark, sf):
    cache = IO.StepCache(spark, IO.scratch(spark, "rollouts"))
    e = table(spark, sf, "events")
    for step in range(2):
        cache.record(e.where(F.col("user_id") % 3 == step).select("event_id", "value"), step)
    return cache.replay(9, repeat_last=True).select("event_id", "value")


# Streams.


@query("stream_bounded_queue", "WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id AS key, any_value(n) AS produced, greatest(any_value(n) - 4, 0) AS dropped, least(any_value(n), 4) AS size, min(event_id) AS oldest, max(event_id) AS newest FROM o WHERE p <= 4 GROUP BY 1")
def stream_bounded_queue(spark, sf):
    base = IO.scratch(spark, "queue")
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    reports = Q.queue_reports(source.select("user_id", "event_id"), "user_id", "event_id", 4)
    run = reports.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return Q.last_reports(spark.read.schema(Q.REPORT).parquet(f"{base}/out"))


@query("stream_staleness", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS produced, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 6 AS paused FROM events")
def stream_staleness(spark, sf):
    return Q.staleness(table(spark, sf, "events"), "user_id", "event_id", 2, 0.5, 2).select("event_id", "produced", "paused")


@query("stream_batches", "WITH o AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, p // 32 AS batch, count(*) AS n FROM o WHERE p < n - n % 32 GROUP BY 1, 2")
def stream_batches(spark, sf):
    rows = Q.collect_batches(table(spark, sf, "events"), "event_type", "event_id", 32)
    return rows.groupBy("event_type", "batch").agg(F.count("*").alias("n"))


STATUS = "CASE WHEN user_id % 9 = 0 AND event_id % 3 = 0 THEN 'running' WHEN event_id % 4 = 0 THEN 'failed' ELSE 'success' END"


@query("stream_replay_buffer", f"WITH t AS (SELECT user_id AS step, event_type AS key, max_by({STATUS}, event_id) AS status FROM events GROUP BY 1, 2) SELECT step, key, status FROM t WHERE status = 'success' AND step NOT IN (SELECT step FROM t WHERE status = 'running')")
def stream_replay_buffer(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id AS step", "event_type AS key", f"{STATUS} AS status", "event_id")
    return Q.replay_buffer(e, ["key"], "step", "status", "event_id").select("step", "key", "status")


@query("stream_kl_controller", f"SELECT event_id, {rr('0.1e0 * exp(sum(ln(1 + least(greatest(value / 50 - 1, -0.2e0), 0.2e0) * 64 / 10000)) OVER (PARTITION BY user_id ORDER BY event_id))', 8)} AS coefficient FROM events")
def stream_kl_controller(spark, sf):
    e = table(spark, sf, "events").withColumn("n", F.lit(64))
    return Q.adaptive_coefficient(e, "user_id", "event_id", "value", 0.1, 50.0, 10000, "n").select("event_id", r("coefficient", 8).alias("coefficient"))


@query("io_steps_indexed", "SELECT event_id, user_id % 4 AS step, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS place FROM events")
def io_steps_indexed(spark, sf):
    """Files of steps in order of event_id, read back with the place of each line."""
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("step")).orderBy("event_id")
    return IO.load_steps(spark, IO.dump_steps(e, IO.scratch(spark, "dump")), "event_id long, step long", index="place").select("event_id", "step", "place")


@query("io_first_samples", "SELECT conv_id::VARCHAR AS prompt, turn::VARCHAR AS chosen, role AS rejected FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS k FROM conversations) WHERE k <= 150")
def io_first_samples(spark, sf):
    """The first rows of files in order of their names."""
    path = IO.scratch(spark, "ordered")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("a"), F.col("turn").alias("b"), F.col("role").alias("c"))
    c.orderBy("a", "b").write.parquet(f"{path}/p.parquet")
    return IO.read_preferences(spark, [f"{path}/p.parquet"], ("a", "b", "c"), max_samples=150)


@query("io_whole_lists", "WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v, list(event_id ORDER BY event_id) FILTER (user_id % 2 = 0 OR event_id % 2 = 0) AS i FROM events GROUP BY user_id) SELECT user_id, k - 1 AS place, v[k] AS value, CASE WHEN len(i) = len(v) THEN i[k] ELSE -1 END AS id FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM l)")
def io_whole_lists(spark, sf):
    """Lists of a step as rows; one of another length is left out."""
    e = table(spark, sf, "events")
    some = F.array_sort(F.collect_list(F.when((F.col("user_id") % 2 == 0) | (F.col("event_id") % 2 == 0), F.col("event_id")))).alias("id")
    lists = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("value"), some)
    rows = IO.whole_lists(lists, "value", ["id"], "user_id")
    return rows.select("user_id", "place", "value", F.coalesce("id", F.lit(-1)).alias("id"))


@query("io_step_repeat", "SELECT event_id, value FROM events WHERE user_id % 3 = 1")
def io_step_repeat(spark, sf):
    """Three recorded steps played again and again: the fifth is the second."""
    cache = IO.StepCache(spark, IO.scratch(spark, "rollouts"))
    e = table(spark, sf, "events")
    for step in range(3):
        cache.record(e.where(F.col("user_id") % 3 == step).select("event_id", "value"), step + 10)
    return cache.replay(5, repeat=True).select("event_id", "value")


@query("io_sized", "SELECT event_id, octet_length(encode('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}')) AS bytes FROM events")
def io_sized(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return e.select("event_id", IO.sized(e).cast("long").alias("bytes"))


@query("fn_clip_by_value", "SELECT event_id, greatest(least(value, user_id * 2e0), 20e0) AS clipped FROM events")
def fn_clip_by_value(spark, sf):
    return table(spark, sf, "events").select("event_id", T.clip_by_value(F.col("value"), F.lit(20.0), F.col("user_id") * 2.0).alias("clipped"))
