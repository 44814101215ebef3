"""Balance inside batches, rate limits and aligned distributions, item by item."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import balance as K
from brindle.operators import batches as BA
from brindle.operators import distillation as D
from brindle.operators import limits as LM


def differencing(loads, k, equal):
    """The method as it is defined: lists of (sum, items), joined widest spread first, the
    earlier made first in ties; subsets by (sum, count, items), largest first."""
    rank = lambda s: sorted(s, key=lambda x: (x[0], len(x[1]), x[1]), reverse=True)
    order = sorted((x, i) for i, x in enumerate(loads))
    if equal:
        states = [rank([(x, [i]) for x, i in order[a : a + k]]) for a in range(0, len(order), k)]
    else:
        states = [rank([(x, [i])] + [(0, [])] * (k - 1)) for x, i in order]
    made = list(enumerate(states))
    while len(made) > 1:
        made.sort(key=lambda s: (-(s[1][0][0] - s[1][-1][0]), s[0]))
        (_, a), (_, b) = made[:2]
        new = rank([(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))])
        made = [*made[2:], (max(n for n, _ in made) + len(loads), new)]
    return [sorted(p) for _, p in made[0][1]]


def at_ends(part, loads):
    part = sorted(part, key=lambda x: (loads[x], x))
    return part[::2] + part[1::2][::-1]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, rng.choice([1, 5, 5, 7, 100, rng.randrange(1, 999)]), f"u{i // 3}", rng.choice([10, 20, 70])) for i in range(144)]


def test_every_item_of_every_batch(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, load long, uid string, length long").repartition(5)
    for minibatch in (None, 8):
        got = {r["row_id"]: r for r in BA.balance_batches(df, 24, 4, minibatch=minibatch).collect()}
        assert len(got) == 144
        for batch in range(6):
            loads = [r[1] for r in rows[batch * 24 : batch * 24 + 24]]
            step, parts = minibatch or 24, [[] for _ in range(4)]
            for a in range(0, 24, step):
                for p, items in enumerate(differencing(loads[a : a + step], 4, True)):
                    parts[p] += [a + i for i in items]
            place = 0
            for p, items in enumerate(at_ends(x, loads) for x in parts):
                for k, i in enumerate(items):
                    r = got[batch * 24 + i]
                    assert (r["batch"], r["part"], r["place"], r["new_row_id"]) == (batch, p, k, batch * 24 + place)
                    place += 1


def test_groups_stay_together(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, load long, uid string, length long")
    got = BA.balance_groups(df, 24, 4, "uid").collect()
    uid = {r[0]: r[2] for r in rows}
    where = {}
    for r in got:
        where.setdefault(uid[r["row_id"]], set()).add((r["batch"], r["part"]))
    assert len(got) == 144 and all(len(x) == 1 for x in where.values())
    for batch in range(6):
        loads = [sum(r[1] for r in rows[a : a + 3]) for a in range(batch * 24, batch * 24 + 24, 3)]
        order = [batch * 24 + 3 * g + j for p in differencing(loads, 4, True) for g in p for j in range(3)]
        assert [r["row_id"] for r in sorted(got, key=lambda r: r["new_row_id"]) if r["batch"] == batch] == order
    with pytest.raises(Exception, match="equal parts"):
        BA.balance_groups(df, 24, 5, "uid").collect()


@pytest.mark.parametrize("group, multiple, least", [(1, 1, 1), (1, 4, 3), (3, 2, 1)])
def test_micro_batches(spark, rows, group, multiple, least):
    df = spark.createDataFrame(rows, "row_id long, load long, uid string, length long")
    got = sorted(BA.micro_batches(df, 36, 200, "length", multiple=multiple, least=least, group=group).collect(), key=lambda r: r["new_row_id"])
    for batch in range(4):
        mine = rows[batch * 36 : batch * 36 + 36]
        sums = [sum(r[1] for r in mine[a : a + group]) for a in range(0, 36, group)]
        bins = max(least, min(len(sums), math.ceil(sum(r[3] for r in mine) / 200)))
        bins = math.ceil(bins / multiple) * multiple
        parts = differencing(sums, bins, False)
        parts.sort(key=lambda p: (sum(sums[i] for i in p), p[0]), reverse=True)
        parts = parts[::2][::-1] + parts[1::2]
        want = [(p, batch * 36 + i * group + j) for p, items in enumerate(parts) for i in items for j in range(group)]
        assert [(r["part"], r["row_id"]) for r in got if r["batch"] == batch] == want
    with pytest.raises(Exception, match="at most 60"):
        BA.micro_batches(df, 36, 60, "length").collect()


def test_methods_on_ties():
    rng = random.Random(8)
    for _ in range(60):
        loads = [rng.choice([0, 1, 1, 2, 9]) for _ in range(12)]
        assert K.largest_differencing(loads, 3, True) == differencing(loads, 3, True)
        assert K.largest_differencing(loads, 4) == differencing(loads, 4, False)
        assert BA.ends_small([3, 1, 2, 0], [5, 5, 1, 9]) == [2, 1, 3, 0]


@pytest.mark.parametrize("range_rows", [3, 50, 1 << 16])
def test_rate_limit_against_a_loop(spark, range_rows):
    rng = random.Random(5)
    at, requests = 0.0, []
    for i in range(400):
        at += rng.choice([0, 0, 0.01, 0.5, 3.0])
        requests.append((i, at, rng.choice([None, 0.0, 0.5, 1.0, 2.0, 9.0])))
    rate, most, tokens, last, want = 1.5, 2.5, 2.5, None, {}
    for i, a, c in requests:
        c = c or 0.0
        now = a if last is None else max(a, last)
        tokens = min(most, tokens + (0 if last is None else now - last) * rate)
        # Later ones wait until the bucket is out of debt, so a larger one may take at once.
        wait = max(0.0, (c - tokens) / rate)
        want[i] = now + wait
        if c > most:
            tokens, last = tokens - c, now
        else:
            tokens, last = min(most, tokens + wait * rate) - c, now + wait
    df = spark.createDataFrame(requests, "i long, a double, c double").repartition(4)
    got = {r["i"]: (r["started"], r["waited"], r["a"]) for r in LM.token_bucket(df, "a", "c", rate, most, ["i"], range_rows).collect()}
    assert {i: s for i, (s, _, _) in got.items()} == pytest.approx(want) and all(w == pytest.approx(s - a) and w >= -1e-9 for s, w, a in got.values())
    assert LM.token_bucket(df.where("false"), "a", "c", rate).count() == 0
    with pytest.raises(ValueError):
        LM.token_bucket(df, "a", "c", 0)


def test_aligned_distributions(spark):
    lists = "array<array<struct<id:int,lp:double>>>"
    rows = [(1, [[(5, -0.1), (7, -3.0)], [], [(1, -20.0)]], [[(7, -1.0), (9, -0.5)], [(2, -0.3)], None], [1.0, 1.0, 0.0]), (2, None, None, []), (3, [[(1, -0.2)]], [[(1, -0.2)]], [1.0])]
    df = spark.createDataFrame(rows, f"row_id int, teacher {lists}, student {lists}, m array<double>")
    got = {r["row_id"]: r for r in D.with_divergence(df).collect()}
    e = math.exp
    assert got[1]["kl"] == pytest.approx([e(-0.1) * (-0.1 + 10) + e(-3) * (-3 + 1), 0.0, 0.0]) and got[1]["shared"] == [1, 0, 0]
    assert got[1]["teacher_mass"] == pytest.approx([e(-0.1) + e(-3), 0, e(-20)]) and got[1]["student_mass"] == pytest.approx([e(-1), 0, 0])
    assert got[2]["kl"] == [] and got[3]["kl"] == pytest.approx([0.0])
    back = {r["row_id"]: r for r in D.with_divergence(df, direction="reverse").collect()}
    assert back[1]["kl"] == pytest.approx([e(-1) * (-1 + 3) + e(-0.5) * (-0.5 + 10), e(-0.3) * (-0.3 + 10), 0.0]) and back[1]["student_mass"] == pytest.approx([e(-1) + e(-0.5), e(-0.3), 0])
    loss = D.distillation_loss(D.with_divergence(df)).first()
    assert loss["kl_max"] == pytest.approx(got[1]["kl"][0]) and loss["kl_min"] == 0 and loss["loss"] == pytest.approx(got[1]["kl"][0] / 3)
    three = F.expr("array(named_struct('id', 3, 'lp', -1D), named_struct('id', 1, 'lp', -1D), named_struct('id', 2, 'lp', -0.5D))")
    assert [x["id"] for x in spark.range(1).select(D.top_k(three, 2).alias("t")).first()["t"]] == [2, 1]
    with pytest.raises(ValueError):
        D.with_divergence(df, direction="both")
