"""Rejection by language ID: what is unlike all learned languages goes, what is like them stays."""

from __future__ import annotations

import random

import numpy as np
import pytest

from brindle.llm import language as LG
from brindle.llm.common import held_out

UNKNOWN = [
    "xqzv kjwq pppf zzxk qwv jjk vvbx", "asdkjh qwelkj zxmcnb poiqwe lkjasd mnbzxc qpwoei",
    "Tämä on suomenkielinen lause jota malli ei ole koskaan nähnyt eikä sen pitäisi tuntea sitä lainkaan",
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Все люди рождаются свободными и равными",
    "SELECT a, b FROM t WHERE x = 1 AND y > 3 GROUP BY a, b ORDER BY 2 DESC LIMIT 10",
]


@pytest.fixture(scope="module")
def taught(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, LG.train(*LG.sample(docs))


def test_unlike_texts_are_rejected(spark, taught):
    docs, model = taught
    rows = [(i, t) for i, t in enumerate(UNKNOWN)]
    got = LG.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert all(r["rejected"] for r in got)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    mixed = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], schema).unionByName(docs.limit(50))
    assert LG.keep_identified(mixed, model).where("lang IS NULL").count() == 0


def test_held_out_texts_stay(taught):
    docs, model = taught
    got = LG.identify(docs.where(held_out("doc_id")), model).collect()
    assert len(got) > 200 and sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_noise_of_the_same_letters_is_rejected(taught):
    docs, model = taught
    rng = random.Random(1)
    texts = [LG.shuffled(r["text"][:1000], rng) for r in docs.where(held_out("doc_id") & (docs.n_chars > 300)).limit(100).collect()]
    assert model.rejects(*model.scores(texts)).mean() > 0.9


def test_words_of_letters():
    data = np.frombuffer("abc a1 --- é x- 42".encode() + bytes(16), np.uint8)
    starts, ends = np.array([0, 4, 7, 11, 14, 17]), np.array([3, 6, 10, 13, 16, 19])
    assert LG.words_of_letters(data, starts, ends).tolist() == [True, False, False, True, True, False]


def test_too_few_texts_to_calibrate():
    model = LG.train([b"the of and", b"der und ich"] * 20, ["aa", "bb"] * 20)
    assert not model.rejects(*model.scores([b"zzqx", b"42", b""])).any()
