"""Differing dicts, draws by splitting, and datasets of the user's own."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from brindle.operators import draws as DR
from brindle.operators import records as RC
from brindle.operators import rewards as R
from brindle.sources import custom
from brindle.sources import files as IO

DICTS = [
    (0, "s", '{"a": 1, "b": "x"}'), (1, "s", '{"a": 2.5, "c": [1, 2]}'), (2, "t", '{"b": null, "d": {"e": {"f": true}}}'), (3, "t", "not json"), (4, "t", None), (5, "t", "[1, 2]"), (6, "t", "{}"), (7, "s", '{"log/a": 9, "it\'s": "q"}'),
]


@pytest.fixture(scope="module")
def dicts(spark):
    return spark.createDataFrame(DICTS, "id int, g string, d string").repartition(3)


def test_keys_become_columns(spark, dicts):
    rows = {r["id"]: r.asDict(True) for r in RC.opened(dicts, "d").collect()}
    assert list(rows[0]) == ["id", "g", "a", "b", "c", "d", "it's", "log/a"] and len(rows) == 8
    assert (float(rows[0]["a"]), float(rows[1]["a"]), rows[2]["a"]) == (1.0, 2.5, None) and rows[1]["c"] == [1, 2] and rows[2]["d"] == {"e": {"f": True}}
    assert (rows[7]["log/a"], rows[7]["it's"]) == (9, "q") and all(v is None for k, v in rows[3].items() if k not in ("id", "g"))
    with pytest.raises(ValueError):
        RC.opened(dicts.withColumn("a", F.lit(1)), "d")
    assert RC.opened(dicts.where("id IN (3, 4)"), "d").columns == ["id", "g"] and RC.schema_of(dicts.where("false"), "d") == StructType()


def test_list_of_dicts_to_dict_of_lists(dicts):
    got = {r["g"]: r.asDict(True) for r in RC.dict_of_lists(dicts.where("id != 7"), ["g"], "id", "d").collect()}
    assert [None if x is None else float(x) for x in got["s"]["a"]] == [1.0, 2.5] and got["s"]["b"] == ["x", None] and got["t"]["b"] == [None] * 5


def test_appended_values(dicts):
    got = {r["key"]: [json.loads(x) for x in r["values"]] for r in RC.appended(dicts, "id", "d", "log/").collect()}
    assert got["log/a"] == [1, 2.5, 9] and got["log/c"] == [1, 2] and got["log/b"] == ["x", None] and got["log/d"] == [{"e": {"f": True}}]


def test_assigned_columns(spark, dicts):
    base = spark.createDataFrame([(i, "old") for i in range(9)], "id int, b string")
    got = {r["id"]: r for r in RC.assigned(base, "id", dicts.select("id", "d"), "d").collect()}
    assert len(got) == 9 and got[0]["b"] == "x" and got[8]["b"] is None and got[1]["c"] == [1, 2]
    twice = dicts.select("id", "d").unionByName(dicts.select("id", "d").where("id = 0"))
    with pytest.raises(Exception, match="several dicts"):
        RC.assigned(base, "id", twice, "d").collect()


@pytest.mark.parametrize("range_rows", [7, 1 << 16])
def test_multinomial_shares_and_totals(spark, range_rows):
    weights = [0.0, 1.0, 2.0, 7.0] * 30
    df = spark.createDataFrame(list(enumerate(weights)), "i long, w double").repartition(5)
    total = sum(weights)
    got, seeds, n = [0] * 120, 6, 12000
    for seed in range(seeds):
        rows = DR.multinomial(df, "w", ["i"], n, seed, range_rows).collect()
        assert sum(r["draws"] for r in rows) == n
        for r in rows:
            got[r["i"]] += r["draws"]
    for i, w in enumerate(weights):
        share = w / total
        assert abs(got[i] - seeds * n * share) <= 6 * (seeds * n * share * (1 - share)) ** 0.5
    # The variance of a draw is the multinomial one, not that of a systematic draw.
    chi = sum((got[i] - seeds * n * w / total) ** 2 / (seeds * n * w / total) for i, w in enumerate(weights) if w)
    assert 40 < chi < 160
    again = DR.multinomial(df.repartition(2), "w", ["i"], n, 0, range_rows)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, DR.multinomial(df, "w", ["i"], n, 0, range_rows).collect()))
    assert DR.resampled(again).count() == n


def test_multinomial_of_bad_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, -1.0)], "i long, w double")
    with pytest.raises(Exception, match="negative"):
        DR.multinomial(df, "w", ["i"])
    with pytest.raises(ValueError, match="no row"):
        DR.multinomial(df.withColumn("w", F.lit(0.0)), "w", ["i"])
    assert DR.multinomial(df.where("false"), "w", ["i"]).count() == 0


class Squares:
    def __init__(self, options):
        self.n = int(options.get("n", 10))

    def schema(self):
        return StructType([StructField("i", LongType()), StructField("text", StringType()), StructField("square", LongType())])

    def partitions(self):
        return [(a, min(self.n, a + 4)) for a in range(0, self.n, 4)]

    def read(self, partition, columns, filters):
        least = max([v for c, sign, v in filters if (c, sign) == ("i", ">=")], default=0)
        for i in range(*partition):
            if i >= least:
                row = {"i": i, "text": f"n{i}", "square": i * i}
                yield tuple(row[c] for c in columns)


def test_datasets_as_sources(spark, tmp_path):
    custom.register(spark, "squares", Squares)
    df = spark.read.format("squares").option("n", 11).load()
    assert df.rdd.getNumPartitions() == 3 and sorted(map(tuple, df.collect())) == [(i, f"n{i}", i * i) for i in range(11)]
    some = spark.read.format("squares").option("columns", "square, i").load().where("i >= 7 AND square != 64")
    assert some.columns == ["i", "square"] and sorted(map(tuple, some.collect())) == [(7, 49), (9, 81)]
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("squares").option("columns", "x").load()
    with pytest.raises(TypeError):
        custom.register(spark, "nothing", dict)
    path = tmp_path / "mine.py"
    path.write_text("from pyspark.sql.types import *\nclass Mine:\n    def __init__(self, options): pass\n    def schema(self): return StructType([StructField('x', LongType())])\n    def partitions(self): return [1, 2]\n    def read(self, part, columns, filters): yield (part * 10,)\n")
    custom.register(spark, "mine", custom.load(str(path), "Mine"))
    assert sorted(r["x"] for r in spark.read.format("mine").load().collect()) == [10, 20]
    with pytest.raises(AttributeError):
        custom.load(str(path), "Other")


def test_files_by_step(spark, tmp_path):
    for step in (2, 10, 9):
        (tmp_path / f"{step}.jsonl").write_text("".join(json.dumps({"s": f"{step}-{i}"}) + "\n" for i in range(3)))
    got = IO.load_files(spark, str(tmp_path), "s string").collect()
    assert sorted((r["step"], r["index"], r["s"]) for r in got) == [(s, i, f"{s}-{i}") for s in (2, 9, 10) for i in range(3)]
    (tmp_path / "x.jsonl").write_text("{}\n")
    with pytest.raises(Exception, match="no step"):
        IO.load_files(spark, str(tmp_path), "s string").collect()


def test_named_rewards(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 1.0], {"score": 2.0, "f": 1.0}), ("a", 2, [1.0, 0.0], {"score": 3.0})], "u string, k int, m array<double>, s map<string,double>")
    got = R.manager("gdpo")(df, "s", "m", sequence=("u", "k")).collect()
    assert [(r["rewards"], r["info"]) for r in got] == [([3.0, 0.0], {"score": 3.0})]
    number = R.manager("gdpo")(df.withColumn("s", F.lit(0.5)), "s", "m").where("k = 1").first()
    assert number["rewards"] == [0.0, 0.5] and number["info"] == {"acc": 0.5}
    with pytest.raises(Exception, match="without score"):
        R.manager("gdpo")(df.withColumn("s", F.create_map(F.lit("f"), F.lit(1.0))), "s", "m").collect()
