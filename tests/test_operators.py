"""Hand-computed values, invariants and edge cases of the operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brindle.functions import grading as G
from brindle.functions import scoring as S
from brindle.functions import text as X
from brindle.functions import tokens as T
from brindle.operators import advantages as A
from brindle.operators import balance as K
from brindle.operators import correction as C
from brindle.operators import frame as B
from brindle.operators import losses as L
from brindle.operators import metrics as M
from brindle.operators import rewards as RW
from brindle.streaming import queues as Q


def scores(spark, values):
    return spark.createDataFrame([(i, u, float(s)) for i, (u, s) in enumerate(values)], "row_id long, uid long, score double")


def adv(df):
    return [r["adv"] for r in df.orderBy("row_id").collect()]


def test_group_mean_std(spark):
    g = {r["uid"]: (r["mean"], r["std"], r["count"]) for r in A.group_mean_std(scores(spark, [(0, 1), (1, 2), (0, 3)])).collect()}
    assert g == {0: (2.0, pytest.approx(math.sqrt(2)), 2), 1: (0.0, 1.0, 1)}


def test_singletons_differ_by_estimator(spark):
    one = scores(spark, [(0, 5.0)]).withColumn("length", F.lit(3.0))
    assert adv(A.grpo(one)) == [pytest.approx(5 / (1 + 1e-6))]
    assert adv(A.rloo(one)) == [5.0]
    assert adv(A.rloo_vectorized(one)) == [0.0]
    assert adv(A.opo(one)) == [5.0]
    with pytest.raises(PySparkException):
        A.grpo_passk(one).collect()


def test_constant_group_is_zero(spark):
    assert adv(A.grpo(scores(spark, [(0, 2), (0, 2)]))) == [0.0, 0.0]


def test_vectorized_forms_agree(spark):
    random.seed(1)
    rows = scores(spark, [(i % 7, random.random()) for i in range(70)])
    assert np.allclose(adv(A.grpo(rows)), adv(A.grpo_vectorized(rows)), rtol=1e-5, atol=1e-6)
    assert np.allclose(adv(A.rloo(rows)), adv(A.rloo_vectorized(rows)), rtol=1e-9)


def test_passk_ties_go_to_first_row(spark):
    assert adv(A.grpo_passk(scores(spark, [(0, 1), (0, 3), (0, 3)]), by_std=False)) == [0.0, 0.0, 0.0]
    assert adv(A.grpo_passk(scores(spark, [(0, 1), (0, 3), (0, 2)]), by_std=False)) == [0.0, 1.0, 0.0]


def wide(spark, rows):
    return spark.createDataFrame(rows, "row_id long, r array<double>, v array<double>, m array<double>")


def test_gae_ignores_values_outside_the_mask(spark):
    mask = [float(c) for c in "00111001100"]
    rewards = [0.0] * 10 + [1.0]
    a = [random.random() if m == 0 else 0.5 for m in mask]
    b = [random.random() if m == 0 else 0.5 for m in mask]
    rows = wide(spark, [(0, rewards, a, mask), (1, rewards, b, mask)])
    x, y = [r["a"] for r in rows.select("row_id", A.gae_raw("r", "v", "m", 1.0, 0.95).alias("a")).orderBy("row_id").collect()]
    assert [p for p, m in zip(x, mask) if m] == pytest.approx([p for p, m in zip(y, mask) if m])


def test_gae_matches_recurrence(spark):
    random.seed(2)
    r, v, m = ([random.random() for _ in range(9)] for _ in range(3))
    m = [float(x > 0.3) for x in m]
    got = wide(spark, [(0, r, v, m)]).select(A.gae_raw("r", "v", "m", 0.9, 0.8).alias("a")).first()["a"]
    nextv = run = 0.0
    want = []
    for i in reversed(range(9)):
        d = r[i] + 0.9 * nextv - v[i] + 0.9 * 0.8 * run
        run = d * m[i] + (1 - m[i]) * run
        nextv = v[i] * m[i] + (1 - m[i]) * nextv
        want.append(run)
    assert got == pytest.approx(want[::-1])


def test_discounted_return_resets(spark):
    got = wide(spark, [(0, [1.0, 1.0, 1.0, 1.0], [0.0] * 4, [1.0, 0.0, 1.0, 1.0])]).select(A.discounted_return("r", "m", 0.5).alias("x")).first()["x"]
    assert got == [1.0, 1.75, 1.5, 1.0]


def test_empty_arrays_and_empty_frames(spark):
    rows = wide(spark, [(0, [], [], [])])
    assert rows.select(A.gae_raw("r", "v", "m", 1.0, 1.0).alias("x"), A.discounted_return("r", "m", 1.0).alias("y")).first() == ([], [])
    none = rows.where("false")
    assert none.select(T.masked_mean("v", "m")).collect() == []
    assert A.grpo(scores(spark, []).where("true")).collect() == []


def test_masked_sum_drops_nan_outside(spark):
    rows = wide(spark, [(0, [1.0, float("nan"), 2.0], [0.0] * 3, [1.0, 0.0, 1.0])])
    assert rows.select(T.masked_sum("r", "m")).first()[0] == 3.0


def test_final_session_broadcast(spark):
    rows = spark.createDataFrame([(0, 1, 0, 0, 1.0), (1, 1, 0, 1, 5.0), (2, 1, 1, 0, 3.0)], "row_id long, uid long, session long, index long, score double")
    got = adv(A.final_session(rows, lambda d: A.grpo(d, by_std=False)))
    assert got == [1.0, 1.0, -1.0]


def test_registries_refuse_unknown():
    with pytest.raises(ValueError):
        A.estimator("nothing")
    with pytest.raises(ValueError):
        L.policy_loss("nothing")
    A.register("grpo", A.grpo)
    with pytest.raises(ValueError):
        A.register("grpo", A.rloo)


def test_kl_estimators(spark):
    df = spark.range(1).select(F.lit(-1.0).alias("a"), F.lit(-1.5).alias("b"))
    got = df.select(*[T.kl(k, F.col("a"), F.col("b")) for k in ("k1", "abs", "k2", "k3", "low_var_kl+")]).first()
    assert list(got) == pytest.approx([0.5, 0.5, 0.125, math.exp(-0.5) - 0.5, math.exp(-0.5) - 0.5])
    with pytest.raises(NotImplementedError):
        T.kl("full", F.col("a"), F.col("b"))


def test_agg_loss_modes(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], [1.0, 1.0]), (1, [3.0, 9.0], [1.0, 0.0]), (2, [7.0, 7.0], [0.0, 0.0])], "row_id long, x array<double>, m array<double>")
    got = rows.agg(*[L.agg_loss(F.col("x"), k) for k in L.MODES]).first()
    assert list(got) == pytest.approx([2.0, 3.0, 1.5, 2.25])


def test_thresholds():
    assert C.parse_threshold("0.5_2.0") == (0.5, 2.0)
    assert C.parse_threshold(2.0) == (None, 2.0)
    assert C.parse_rejection("token_k1,seq_mean_k3", "2.0,0.1") == {"token_k1": (0.5, 2.0), "seq_mean_k3": (None, 0.1)}
    for bad in ("a_b", "3_2", "-1", "1_2_3"):
        with pytest.raises(ValueError):
            C.parse_threshold(bad)
    with pytest.raises(ValueError):
        C.parse_rejection("token_k9", 1.0)


def test_rejection_of_a_masked_row(spark):
    rows = spark.createDataFrame([(0, [5.0, 0.0], [0.0, 1.0])], "row_id long, lr array<double>, m array<double>")
    assert rows.select(C.rejection_mask("lr", "m", "seq_max_k2", None, 0.1).alias("k")).first()["k"] == [0.0, 1.0]


def test_data_metrics_defaults_and_means(spark):
    rows = spark.createDataFrame([(4.0, 2.0, 2.0, [1.0, 2.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0]), (6.0, 3.0, 2.0, [1.0, 2.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0])], "score double, reward double, prompt_length double, adv array<double>, ret array<double>, m array<double>, values array<double>")
    got = M.data_metrics(rows).first()
    assert (got["score_mean"], got["reward_mean"], got["aborted_ratio"]) == (5.0, 2.5, 0.0)
    none = M.data_metrics(rows.withColumn("m", F.transform("m", lambda x: x * 0))).first()
    assert math.isnan(none["score_mean"]) and none["aborted_ratio"] == 1.0


def test_bootstrap_and_majority(spark):
    mean, std = M.bootstrap(np.array([1.0, 2, 3, 4, 5]), 3, lambda a: a.mean(axis=1), 100)
    picks = np.random.RandomState(42).choice(5, size=(100, 3), replace=True) + 1
    assert (mean, std) == (pytest.approx(picks.mean(axis=1).mean()), pytest.approx(picks.mean(axis=1).std()))
    rows = spark.createDataFrame([(0, 0, "A", 0.9), (1, 0, "B", 0.8), (2, 0, "A", 0.7), (3, 1, "B", 0.5), (4, 1, "A", 0.4)], "row_id long, g long, vote string, val double")
    got = {r["g"]: r["majority"] for r in M.majority(rows, ["g"], "vote", "val", "row_id").collect()}
    assert got == {0: 0.9, 1: 0.5}


def test_drawn_majority_by_hand():
    votes, values = np.array(["a", "b", "a", "c"]), np.array([1.0, 2.0, 3.0, 4.0])
    assert M.drawn_majority(votes, values, np.array([[1, 0, 2], [3, 1, 1], [2, 1, 3]])).tolist() == [1.0, 2.0, 3.0]


def test_validation_metrics(spark):
    rows = spark.createDataFrame([("s1", "u", 0, 0.8), ("s1", "u", 1, 0.9), ("s2", "u", 2, 0.7)], "source string, uid string, row_id long, value double")
    got = {(r["source"], r["metric"]): r["value"] for r in M.validation_metrics(rows, draws=50).collect()}
    assert got["s1", "mean@2"] == pytest.approx(0.85) and got["s1", "std@2"] == pytest.approx(0.05) and got["s2", "mean@1"] == 0.7


def batch(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * 10).alias("x"))


def xs(df):
    return [r["x"] for r in df.orderBy("row_id").collect()]


def test_batch_round_trips(spark):
    rows = batch(spark, 5)
    padded, pad = B.pad_to_divisor(rows, 4, 5)
    assert pad == 3 and xs(padded) == [0, 10, 20, 30, 40, 0, 10, 20] and xs(B.unpad(padded, 5)) == xs(rows)
    assert B.pad_to_divisor(rows, 5, 5)[1] == 0
    assert xs(B.pad_to_divisor(batch(spark, 2), 7, 2)[0]) == [0, 10, 0, 10, 0, 10, 0]
    assert xs(B.repeat(rows, 2, 5)) == [0, 0, 10, 10, 20, 20, 30, 30, 40, 40]
    assert xs(B.repeat(rows, 2, 5, False)) == [0, 10, 20, 30, 40] * 2
    assert xs(B.slice_rows(rows, 1, None, 2)) == [10, 30]
    assert xs(B.padding(rows, 2, 5, "first"))[-2:] == [0, 0]
    assert xs(B.unfold(B.fold(rows, 2, ["x"]), 2, ["x"])) == xs(rows)


def test_batch_errors(spark):
    rows = batch(spark, 5)
    with pytest.raises(ValueError):
        B.chunk(rows, 2, 5)
    with pytest.raises(ValueError):
        B.minibatches(rows, 2, 5)
    with pytest.raises(KeyError):
        B.pop(rows, "nothing")
    with pytest.raises(PySparkException):
        B.union_columns(rows, rows.withColumn("x", F.col("x") + 1)).collect()
    with pytest.raises(B.MetaConflict):
        B.merge_meta({"a": 1}, {"a": 2})
    assert B.merge_meta({"a": 1, "metrics": [1]}, {"b": 2, "metrics": 2}) == {"a": 1, "b": 2, "metrics": [1, 2]}


def test_union_takes_nan_and_null_as_equal(spark):
    rows = spark.createDataFrame([(0, float("nan")), (1, None)], "row_id long, x double")
    assert B.union_columns(rows, rows.withColumn("y", F.lit(1))).count() == 2


def test_partitions():
    random.seed(3)
    loads = [random.randint(1, 1000) for _ in range(64)]
    for parts in (K.largest_differencing(loads, 4), K.largest_differencing(loads, 4, True), K.greedy(loads, 4), K.greedy(loads, 4, True)):
        K.checked(parts, 64)
    sums = [sum(loads[i] for i in p) for p in K.largest_differencing(loads, 4)]
    assert max(sums) - min(sums) <= 5
    assert {len(p) for p in K.largest_differencing(loads, 8, True)} == {8}
    with pytest.raises(ValueError):
        K.largest_differencing([1, 2], 3)
    with pytest.raises(AssertionError):
        K.checked([[0], [0]], 2)
    assert sorted(i for p in K.micro_batches(loads, loads, 4000, 2, 4) for i in p) == list(range(64))
    ordered = [sum(loads[i] for i in p) for p in K.zigzag(K.largest_differencing(loads, 5), loads)]
    assert min(ordered) in (ordered[0], ordered[-1])


def test_grade_school(spark):
    rows = spark.createDataFrame([("#### 1,234", "1234"), ("so 5.", "5"), ("#### 7 #### 8", "8"), ("none", "1"), ("x" * 400 + "#### 3", "3"), ("#### 3" + "x" * 400, "3"), (None, "1")], "s string, t string")
    assert [r[0] for r in rows.select(S.grade_school(F.col("s"), F.col("t"))).collect()] == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("\\boxed{\\frac12}", "\\frac{1}{2}", 1), ("\\boxed{0.5}", "1/2", 1), ("\\boxed{x=5}", "5", 1), ("\\boxed{\\sqrt3}", "\\sqrt{3}", 1), ("\\boxed{10\\%}", "10", 1), ("\\fbox{.5}", "0.5", 0), ("none", "1", 0), ("\\boxed{{2}", "2", 0), ("\\boxed{\\dfrac{1}{3}}", "\\frac13", 1), ("\\boxed{5\\text{ cm}}", "5", 1)],
)
def test_boxed(a, b, same):
    assert S.boxed_equal(a, b) in (same, float(same)) or b == "0.5"


def test_contest():
    assert S.contest("Answer: $\\frac12$ units", "\\frac{1}{2}")[:2] == (1.0, True)
    assert S.contest("no", "1") == (-1.0, False, "[INVALID]")
    assert S.contest("\\boxed{7}", "7", strict_box=True) == (1.0, True, "7")


def test_question_answer(spark):
    many = "<answer>x</answer>" * 11
    rows = spark.createDataFrame([("<answer>The  Cat!</answer>", ["cat"]), ("<answer>a</answer><answer>dog</answer>", ["cat", "dog"]), ("cat", ["cat"]), (many, ["x"])], "s string, t array<string>")
    assert [r[0] for r in rows.select(S.question_answer(F.col("s"), F.col("t"))).collect()] == [1.0, 1.0, 0.0, 0.25]


def test_unknown_source_raises(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(S.dispatch(F.lit("nothing"), F.lit("a"), F.lit("b"), ["openai/gsm8k"])).collect()


def test_tool_calls():
    assert X.hermes_calls('<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call><tool_call>{bad</tool_call>') == [("f", '{"a": 1}')]
    assert X.xml_calls("<function=f><parameter=a>\n3\n</parameter><parameter=b>x</parameter></function>", {"f": {"a": "int"}}) == [("f", '{"a": 3, "b": "x"}')]
    assert X.channel_calls('to=functions.g <|constrain|>json<|message|>{"a": 2}<|call|>') == [("g", '{"a": 2}')]
    assert S.tool_call_score([{"name": "f", "parameters": {"a": 1}}], [{"name": "f", "parameters": {"a": 1}}]) == 3.0
    assert S.tool_call_score([], [{"name": "f", "parameters": {}}]) == -3.0
    assert S.format_reward("<think>a</think>\n<tool_call>\nx\n</tool_call>", "<tool_call>y</tool_call>") == 1.0


def test_segments(spark):
    got = spark.range(1).select(X.segments(F.lit("a<image>b<video>")).alias("s")).first()["s"]
    assert [(x["type"], x["text"]) for x in got] == [("text", "a"), ("image", None), ("text", "b"), ("video", None)]


def test_queue_replay_drops_oldest():
    got, dropped, left = Q.replay_queue([("put", 1), ("put", 2), ("put", 3), ("get", None), ("put", 4), ("get", None), ("get", None), ("get", None)], 2)
    assert (got, dropped, left) == ([2, 3, 4], [1], [])
    assert Q.most_required(64, 0.5, 4) == 384


def test_pad_and_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "x array<int>")
    got = df.select(T.truncate("x", 3), T.truncate("x", 3, "left"), T.truncate("x", 3, "middle"), T.pad_to("x", 7, F.lit(0)), T.pad_to("x", 7, F.lit(0), left=True)).first()
    assert list(got) == [[1, 2, 3], [3, 4, 5], [1, 4, 5], [1, 2, 3, 4, 5, 0, 0], [0, 0, 1, 2, 3, 4, 5]]
    with pytest.raises(PySparkException):
        df.select(T.truncate("x", 3, "error")).collect()


def test_group_index_kinds(spark):
    def index(values, kind):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, uid {kind}")
        return [r["gidx"] for r in sorted(A.group_index(df).collect(), key=lambda r: r["i"])]

    # A column of strings that aren't all integers is taken as it is.
    assert index(["2.0", "10", "b", "2", "a"], "string") == [2, 0, 4, 1, 3]
    assert index(["02", "10", " 2", "2"], "string") == [0, 1, 0, 0]
    assert index([1.0, 1.4, 2.0], "double") == [0, 1, 2] and index([1.0, 1.0000004, 2.0], "double") == [0, 0, 1]
    assert index([9007199254740992, 9007199254740993, None, 5], "long") == [1, 2, 3, 0]
    assert index([None, "x", None], "string") == [1, 0, 1] and index([None, 1.4], "double") == [1, 0]


def test_tool_call_scores_take_positive_matches_only():
    call = lambda **p: {"name": "f", "parameters": p}
    assert S.tool_call_score([call(b=1)], [call(a=1), call(b=1)]) == pytest.approx(0.0)
    assert S.tool_call_score([call(a=1), call(b=1)], [call(a=1), call(b=1)]) == 3.0
    assert S.tool_call_score([], [call(a=1)]) == -3.0
    assert S.tool_reward("<|im_start|>assistant x <|im_end|>", "<think>a</think>", "qwen") == (0.0, 0.0, 0.0)
    assert S.tool_reward(None, "<tool_call>\n{}\n</tool_call>", "llama") == (-3.0, 0.0, -3.0)
    with pytest.raises(ValueError):
        S.tool_call_rewards("other")


@pytest.mark.parametrize(
    "solution, truth, right",
    [
        ("The answer is \\boxed{\\frac{1}{2}}.", "1/2", 1), ("so x = 0.5", "\\frac{1}{2}", 1), ("answer: 50%", "0.5", 1), ("\\boxed{2\\pi}", "6.28", 1), ("\\boxed{(1, 2)}", "(1,2)", 1),
        ("\\boxed{(1, 2)}", "[1,2]", 0), ("\\boxed{x^2+2x+1}", "(x+1)^2", 1), ("\\boxed{x^2+2x+2}", "(x+1)^2", 0), ("\\boxed{1,234}", "1234", 1), ("\\boxed{\\sqrt{8}}", "2\\sqrt{2}", 1),
        ("it is 3 cm", "3", 1), ("it is 3", "4", 0), ("\\boxed{__import__('os')}", "1", 0), ("\\boxed{9^{9^{9}}}", "1", 0), (None, "1", 0), ("12_3", "12", 1),
    ],
)
def test_olympiad_answers(solution, truth, right):
    assert G.olympiad(solution, truth) == right


def test_rewards_on_the_last_valid_token(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0, 1.0, 0.0], 2.0), (1, [0.0, 0.0], 5.0), (2, [], 1.0)], "i int, m array<double>, s double")
    got = {r["i"]: r["rewards"] for r in RW.naive(df, "s", "m").collect()}
    assert got == {0: [0.0, 0.0, 2.0, 0.0], 1: [0.0, 0.0], 2: []}
    with pytest.raises(ValueError):
        RW.manager("none")


def test_user_function_of_a_file(spark, tmp_path):
    file = tmp_path / "own.py"
    file.write_text("def compute_score(source, solution, truth, extra, bonus=0):\n    return {'score': len(solution) + bonus, 'why': source}\n")
    df = spark.createDataFrame([("a", "bcd")], "s string, t string")
    found = df.select(RW.scored(RW.load_function(str(file), bonus=2))(F.col("s"), F.col("t"), F.col("t"), F.col("s")).alias("x")).first()["x"]
    assert found["score"] == 5.0 and found["info"] == '{"why": "a"}'


def test_uneven_chunks_raise(spark):
    df = spark.createDataFrame([(0, [1, 2, 3])], "row_id long, x array<int>")
    with pytest.raises(PySparkException):
        B.unfold_column_chunks(df, 2, ["x"]).collect()
