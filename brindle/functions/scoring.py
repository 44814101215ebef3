"""Rule-based scores of answers, dispatched by data source.

Plain rules are column expressions. Rules that walk braces or rewrite LaTeX run in Arrow
batches (pandas UDFs). Nothing here evaluates model text: numbers are compared as text or
as literals."""

from __future__ import annotations

import json
import re
import string
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from brindle.functions.grading import boxed_equal, contest, olympiad, verified

CLIP = 300


def tail(text: Column, n: int = CLIP) -> Column:
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def grade_school(solution: Column, truth: Column, method: str = "strict", score: float = 1.0, format_score: float = 0.0) -> Column:
    """The number after the last "####", or, flexibly, the last number at all."""
    clipped = tail(solution)
    if method == "strict":
        found = F.regexp_extract_all(clipped, F.lit(r"#### (\-?[0-9\.\,]+)"), F.lit(1))
        answer = F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"[,$]", "")
    elif method == "flexible":
        found = F.regexp_extract_all(clipped, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
        good = F.filter(found, lambda x: (x != "") & (x != "."))
        answer = F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(found, F.lit(1)))
    else:
        raise ValueError(method)
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


PUNCTUATION = string.punctuation


def normalise_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    plain = F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def question_answer(solution: Column, targets: Column, part: bool = False, score: float = 1.0, format_score: float = 0.0) -> Column:
    """The last <answer> against any target, whole or (part) as a substring; whole
    matches of texts with over 10 answer tags count a quarter."""
    found = F.regexp_extract_all(solution, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    answer = normalise_answer(F.trim(F.try_element_at(found, F.lit(-1))))
    if part:
        hit = F.exists(targets, lambda t: answer.contains(normalise_answer(t)))
        return F.when(F.size(found) < 1, 0.0).when(hit, score).otherwise(format_score)
    hit = F.exists(targets, lambda t: normalise_answer(t) == answer)
    many = (F.regexp_count(solution, F.lit("<answer>")) > 10) | (F.regexp_count(solution, F.lit("</answer>")) > 10)
    return F.when(F.size(found) < 1, 0.0).when(hit & many, score / 4).when(hit, score).otherwise(format_score)


@F.pandas_udf(DoubleType())
def math_score(solution: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([boxed_equal(s, t) for s, t in zip(solution, truth)], dtype=float)


@F.pandas_udf(StructType([StructField("score", DoubleType()), StructField("acc", BooleanType()), StructField("pred", StringType())]))
def contest_score(solution: pd.Series, truth: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([contest(s, t) for s, t in zip(solution, truth)], columns=["score", "acc", "pred"])


@F.pandas_udf(DoubleType())
def geometry_score(solution: pd.Series, truth: pd.Series) -> pd.Series:
    """0.9 for the boxed answer, 0.1 for the form."""
    return pd.Series([geometry(s, t) for s, t in zip(solution, truth)], dtype=float)


@F.pandas_udf(DoubleType())
def verified_score(solution: pd.Series, truth: pd.Series) -> pd.Series:
    """1 where the last formula is exactly the truth's."""
    return pd.Series([verified(s, t) for s, t in zip(solution, truth)], dtype=float)


@F.pandas_udf(DoubleType())
def olympiad_score(solution: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([olympiad(s, t) for s, t in zip(solution, truth)], dtype=float)


def overlap(a: list[str], b: list[str]) -> float:
    """Multiset intersection over union; two empty ones are alike."""
    x, y = Counter(a), Counter(b)
    whole = sum((x | y).values())
    return sum((x & y).values()) / whole if whole else 1.0


def tool_call_score(predicted: list[dict], truth: list[dict], low: float = -3.0, high: float = 3.0) -> float:
    """Overlap of names, of parameter names and of values. Each true call, in order, takes
    the unused predicted call of its name that agrees most, if any agrees at all."""
    if predicted == truth:
        return high
    total = overlap([c["name"] for c in truth], [c["name"] for c in predicted])
    free = list(predicted)
    for call in truth:
        wanted = call["parameters"]

        def agreement(other: dict, call: dict = call, wanted: dict = wanted) -> float:
            given = other["parameters"]
            return overlap(list(wanted), list(given)) + sum(k in given and given[k] == v for k, v in wanted.items()) if other["name"] == call["name"] else 0.0

        best = max(free, key=agreement, default=None)  # the first of equals
        if best is not None and agreement(best) > 0:
            total += agreement(best)
            free = [x for x in free if x is not best]
    most = 1.0 + sum(1.0 + len(c["parameters"]) for c in truth)
    return (high - low) * total / most + low


#: Fixed forms of an answer: the sections that the truth has decide which one is asked for.
SHAPES = {
    (False, False): r"^<think>.*?</think>$",
    (True, False): r"^<think>.*?</think>\n<response>.*?</response>$",
    (False, True): r"^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>$",
    (True, True): r"^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>$",
}


def format_reward(text: str, truth: str) -> float:
    """1 if the answer has the sections of the truth, in order, once and nothing else."""
    wanted = {p: f"<{p}>" in truth for p in ("response", "tool_call")}
    once = all(text.count(f"<{p}>") == 1 == text.count(f"</{p}>") for p, asked in wanted.items() if asked)
    return float(once and re.search(SHAPES[wanted["response"], wanted["tool_call"]], text, re.DOTALL) is not None)


def parse_calls(text: str) -> list[dict]:
    """JSON objects, one a line, inside the first <tool_call>; raises if there is none."""
    body = text.split("<tool_call>")[1].split("</tool_call>")[0].strip()
    return [json.loads(line) for line in body.split("\n")]


#: Fixed marks around the last answer in a chat template.
TEMPLATES = {"llama": ("<|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>"), "qwen": ("<|im_start|>assistant", "<|im_end|>")}


def tool_reward(solution: str | None, truth: str | None, template: str) -> tuple[float, float, float]:
    """(score, format, accuracy) of an answer with tool calls: format 0 or 1, accuracy -3
    to 3, and 0 where the truth has no call."""
    begin, end = TEMPLATES[template]
    text, truth = (solution or "").split(begin)[-1].split(end)[0].strip(), truth or ""
    shape, accuracy = format_reward(text, truth), 0.0
    if "<tool_call>" in truth:
        try:
            accuracy = tool_call_score(parse_calls(text), parse_calls(truth)) if "</tool_call>" in text else -3.0
        except (ValueError, IndexError, KeyError, TypeError, AttributeError):
            accuracy = -3.0
    return shape + accuracy, shape, accuracy


def tool_call_rewards(template: str) -> Callable[[Column, Column], Column]:
    """A column function of (solution, truth): struct(score, format_reward, accuracy_reward)."""
    if template not in TEMPLATES:
        raise ValueError(f"template {template!r}; known: {sorted(TEMPLATES)}")

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("score", "format_reward", "accuracy_reward")]))
    def run(solution: pd.Series, truth: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tool_reward(x, t, template) for x, t in zip(solution, truth)], columns=["score", "format_reward", "accuracy_reward"])

    return run


#: Rules in Python, by data source, (solution, truth) -> score; "aime" by prefix.
MATH_SOURCES = ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500")
CONTEST_SOURCES = ("math_dapo", "math", "math_dapo_reasoning")
OLYMPIAD_SOURCES = ("numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads")
SEARCH_SOURCES = tuple(f"searchR1_{x}" for x in ("nq", "triviaqa", "popqa", "hotpotqa", "2wikimultihopqa", "musique", "bamboogle"))
FORM = re.compile(r"<think>.*</think>.*\\boxed\{.*\}.*", re.DOTALL)


def geometry(solution: str | None, truth: str | None) -> float:
    return 0.9 * boxed_equal(solution, truth) + 0.1 * bool(FORM.fullmatch(solution or ""))


def contest_value(solution: str | None, truth: str | None) -> float:
    return contest(solution, truth)[0]


Rule = Callable[[str | None, str | None], float]
PYTHON: dict[str, Rule] = {n: boxed_equal for n in MATH_SOURCES} | {n: contest_value for n in CONTEST_SOURCES} | {n: olympiad for n in OLYMPIAD_SOURCES} | {"hiyouga/geometry3k": geometry}
PREFIXES: dict[str, Rule] = {"aime": contest_value}
#: Rules as column expressions, by data source.
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {"openai/gsm8k": grade_school} | {n: lambda s, t: question_answer(s, F.array(t)) for n in SEARCH_SOURCES}


def rule_of(source: str | None) -> Rule | None:
    return PYTHON.get(source) or next((f for p, f in PREFIXES.items() if (source or "").startswith(p)), None)


@F.pandas_udf(DoubleType())
def python_rules(source: pd.Series, solution: pd.Series, truth: pd.Series) -> pd.Series:
    """The Python rule of each row's source; nothing is done for a null source."""
    rules = {x: rule_of(x) for x in source.dropna().unique()}
    return pd.Series([None if x is None or rules[x] is None else float(rules[x](s, t)) for x, s, t in zip(source, solution, truth)], dtype=float)


def dispatch(source: Column, solution: Column, truth: Column, names: list[str] | None = None) -> Column:
    """The score of the rule of each row's source (of ``names``, or all); another raises.
    Python rules run in one function, which gets only the rows of their sources."""
    columns = [n for n in names or REGISTRY if n in REGISTRY]
    python = [n for n in names or PYTHON if n in PYTHON]
    unknown = [n for n in names or [] if n not in REGISTRY and n not in PYTHON]
    if unknown:
        raise ValueError(f"no rule for {unknown}")
    out = F.raise_error(F.concat(F.lit("no score for source "), F.coalesce(source, F.lit("null")))).cast("double")
    mine = source.isin(python) if python else F.lit(False)
    for prefix in PREFIXES:
        mine = mine | source.startswith(prefix)
    only = lambda x: F.when(mine, x)
    out = F.when(mine, python_rules(only(source), only(solution), only(truth))).otherwise(out)
    by_rule: dict[int, list[str]] = {}
    for name in columns:
        by_rule.setdefault(id(REGISTRY[name]) if name not in SEARCH_SOURCES else 0, []).append(name)
    for group in by_rule.values():
        out = F.when(source.isin(group), REGISTRY[group[0]](solution, truth)).otherwise(out)
    return out
