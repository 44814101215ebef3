"""The queries of this subpackage, by name, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.bpe import op9_bpe
from brindle.llm.divergence import divergence_sql, op11_divergence
from brindle.llm.fingerprint import op5_fingerprint
from brindle.llm.jaccard import op3_jaccard
from brindle.llm.language import op8_language
from brindle.llm.license import license_sql, op10_license
from brindle.llm.minmax import op13_minmax
from brindle.llm.mixing import op1_mixing
from brindle.llm.pii import op6_pii
from brindle.llm.quality import op4_quality
from brindle.llm.repetition import op7_repetition
from brindle.llm.runs import op12_runs
from brindle.llm.tokens import op2_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_tokens": op2_tokens,
    "op3_jaccard": op3_jaccard,
    "op4_quality": op4_quality,
    "op5_fingerprint": op5_fingerprint,
    "op6_pii": op6_pii,
    "op7_repetition": op7_repetition,
    "op8_language": op8_language,
    "op9_bpe": op9_bpe,
    "op10_license": op10_license,
    "op11_divergence": op11_divergence,
    "op12_runs": op12_runs,
    "op13_minmax": op13_minmax,
}

ORACLES: dict[str, str] = {"op10_license": license_sql(), "op11_divergence": divergence_sql()}
