"""Credentials go whole from a redacted text."""

from __future__ import annotations

import random
import string

from brindle.llm import pii as P
from tests.llm.test_llm_operators import SCHEMA


def test_long_dotted_and_padded_credentials(spark):
    rng = random.Random(31)
    value = lambda n: "".join(rng.choices(string.ascii_letters + string.digits + "_-", k=n))
    secrets = [value(40), value(513), value(5000), f"{value(36)}.{value(900)}.{value(43)}", value(62) + "==", "A1b2" * 8 + ".x9" * 4000]
    rows = [(i, f'see token="{x}" here. Next', "en", "s", 0) for i, x in enumerate(secrets)]
    rows.append((99, "token=" + value(30) + ". Next", "en", "s", 0))
    got = {r["doc_id"]: r["text"] for r in P.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.pop(99) == "[SECRET]. Next"
    assert set(got.values()) == {'see [SECRET]" here. Next'} and len(got) == len(secrets)
