"""Operator 7: quality rules on repetition, from suffix arrays of words.

All texts of a slice share one suffix array, built by prefix doubling over word ranks
that include the text, so that suffixes are only compared within their text. The
longest common prefix of neighbours in it comes from the ranks of every doubling
level. A suffix whose longest common prefix with a neighbour is at least ``least``
words starts a maximal repeated substring; the union of those spans and the longest
of them are limited.

Nulls and empty texts have no words and fail the base rule. Equal texts get equal
figures. Rows don't influence each other and nothing shuffles; memory is bounded by a
slice of text (a single long text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import _SPACE, byte_list, hash_words, map_batches, slices, table, word_ids

#: Base rule (given): at least 20 words, at most 30 of 100 in repeated 8-word windows.
FEWEST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Verdict of the method: repeats count from so many words; share of words in them at
#: most; longest repeat at most that share of the words, or so many words if more.
LEAST_REPEAT, MOST_COVERED, MOST_LONGEST, LONGEST_FREE = 4, 0.30, 0.25, 60
#: Symbols for each word at most.
MOST_SYMBOLS = 0.25

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_ranks(words: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """words: a number for each word. Ranks of the suffixes by their first 1, 2, 4, ... words; the last level tells all
    suffixes of a text apart. Level 3 (8 words) is always there."""
    n = len(words)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    end = firsts[1:][text]
    _, rank = np.unique(words * (len(firsts) + 1) + text, return_inverse=True)
    levels, span, most = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1, int(rank.max()) + 1 if n else 0
    while n and (len(levels) <= 3 or most < n):
        follow = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(np.arange(n) + span < end)
        follow[inside] = levels[-1][inside + span] + 1
        _, rank = np.unique(levels[-1].astype(np.int64) * (n + 1) + follow, return_inverse=True)
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        span, most = 2 * span, int(rank.max()) + 1
    return levels


def repeat_lengths(levels: list[np.ndarray], firsts: np.ndarray) -> np.ndarray:
    """For each suffix the longest prefix, in words, that another suffix of its text has."""
    n = len(levels[0]) if levels else 0
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    order = np.argsort(levels[-1], kind="stable")
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    end = firsts[1:][text]
    a, b = order[:-1], order[1:]
    live = text[a] == text[b]
    a, b = a[live], b[live]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        fits = np.flatnonzero((i + (1 << k) <= end[a]) & (j + (1 << k) <= end[b]))
        same = fits[levels[k][i[fits]] == levels[k][j[fits]]]
        common[same] += 1 << k
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in the union of spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length, -1)
    return np.cumsum(edge[:-1]) > 0


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[firsts[1:]] - total[firsts[:-1]]


def measure(texts: list[bytes], least: int = LEAST_REPEAT) -> dict[str, np.ndarray]:
    """The figures of each text."""
    h, firsts, starts, ends, data = hash_words(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    n_words = np.diff(firsts)
    levels = suffix_ranks(word_ids(h, starts, ends, data), firsts)
    n = len(h)
    repeat = repeat_lengths(levels, firsts)
    # Windows of 8 words that are found twice are the suffixes with that long a repeat.
    at = np.flatnonzero(repeat >= WINDOW)
    in_window = covered(at, np.full(len(at), WINDOW), n)
    at = np.flatnonzero(repeat >= least)
    in_repeat = covered(at, repeat[at], n)
    longest = np.zeros(len(texts), dtype=np.int64)
    if n:
        some = n_words > 0
        longest[some] = np.maximum.reduceat(repeat, firsts[:-1][some])
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": sums(((data & 0xC0) != 0x80) & ~_SPACE[data], bounds),
        "n_symbols": sums(_SYMBOL[data], bounds),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": sums(in_window, firsts),
        "covered_words": sums(in_repeat, firsts),
        "longest_repeat": longest,
    }


def repetition_rules(docs: DataFrame, least: int = LEAST_REPEAT, most_covered: float = MOST_COVERED, most_longest: float = MOST_LONGEST, longest_free: int = LONGEST_FREE, most_symbols: float = MOST_SYMBOLS) -> DataFrame:
    """doc_id, the base figures, covered_words, longest_repeat, base_failed, kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                m = measure(byte_list(part), least)
                n = m["n_words"]
                failed = (n < FEWEST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * n)
                good = (m["covered_words"] <= most_covered * n) & (m["longest_repeat"] <= np.maximum(longest_free, most_longest * n)) & (m["n_symbols"] <= most_symbols * n)
                cols = [part.column(0), *[pa.array(m[k].astype(np.int64)) for k in names], pa.array(failed), pa.array(~failed & good)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean"
    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, schema)


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every text of documents."""
    return repetition_rules(table(spark, sf_dir, "documents"))
