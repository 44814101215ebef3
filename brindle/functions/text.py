"""Text maps of dataset preparation and parsers of tool calls."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def title_cleanup(text: Column) -> Column:
    """Wiki-how remains: the title tag, bracketed notes, double spaces."""
    text = F.regexp_replace(F.trim(text), r" \[title\]", ". ")
    return F.regexp_replace(F.regexp_replace(text, r"\[.*?\]", ""), "  ", " ")


def segments(text: Column, marks: tuple[str, ...] = ("<image>", "<video>")) -> Column:
    """array of struct(type, text): a text cut at placeholders, empty pieces left out."""
    border = "(?=" + "|".join(marks) + ")|(?<=" + "|".join(marks) + ")"
    pieces = F.filter(F.split(text, border), lambda p: p != "")
    kind = lambda p: F.when(p.isin(*marks), F.regexp_replace(p, "[<>]", "")).otherwise("text")
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("type"), F.when(~p.isin(*marks), p).alias("text")))


def checked_segments(text: Column, n_images: Column) -> Column:
    """As many <image> as images, else an error."""
    found = F.regexp_count(text, F.lit("<image>"))
    return F.when(found == n_images, segments(text)).otherwise(F.raise_error(F.concat(F.lit("images: "), found.cast("string"))))


def prompt_row(source: str, question: Column, answer: Column, ability: str, split: str, index: Column, suffix: str = "") -> list[Column]:
    """The columns of a prompt dataset row."""
    return [
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.concat(question, F.lit(suffix)).alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), answer.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index"), answer.alias("answer"), question.alias("question")).alias("extra_info"),
    ]


def preference_rows(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Each preference pair as two prompt/response rows."""
    each = F.explode(F.array(F.struct(F.col(chosen).alias("response"), F.lit(True).alias("chosen")), F.struct(F.col(rejected).alias("response"), F.lit(False).alias("chosen")))).alias("x")
    return df.select(F.col(prompt).alias("prompt"), each).select("prompt", "x.response", "x.chosen")


def loss_mask(roles: str, counts: str, prefix: int = 0) -> Column:
    """A token mask over messages: 1 on an assistant's tokens but for its first
    ``prefix`` ones (the generation prompt)."""
    one = lambda s: F.transform(F.sequence(F.lit(1), s[counts]), lambda i: F.when((s[roles] == "assistant") & (i > prefix), 1).otherwise(0))
    return F.flatten(F.transform(F.filter(F.arrays_zip(roles, counts), lambda s: s[counts] > 0), one))


def position_ids(mask: str) -> Column:
    """Running count of the attention mask, from 0. Tokens are counted in runs of 64 first,
    so work grows little faster than the mask."""
    ones = F.transform(F.col(mask), lambda m: m.cast("int"))
    count = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(mask) - 1) / 64).cast("int"), F.lit(0))), lambda j: count(F.slice(ones, j * 64 + 1, 64)))
    bound = F.transform(F.array(F.struct(ones.alias("ones"), runs.alias("runs"))), lambda s: F.transform(s["ones"], lambda m, i: F.greatest(count(F.slice(s["runs"], 1, F.floor(i / 64).cast("int"))) + count(F.slice(s["ones"], F.floor(i / 64).cast("int") * 64 + 1, i % 64 + 1)) - 1, F.lit(0))))
    return F.get(bound, 0)


def hermes_calls(text: str | None) -> list[tuple[str, str]]:
    """(name, JSON of arguments) of <tool_call> blocks that hold valid JSON."""
    out = []
    for body in re.findall(r"<tool_call>(.*?)</tool_call>", text or "", re.DOTALL):
        try:
            call = json.loads(body)
            out.append((str(call["name"]), json.dumps(call["arguments"], ensure_ascii=False)))
        except (ValueError, KeyError, TypeError):
            continue
    return out


def channel_calls(text: str | None) -> list[tuple[str, str]]:
    """Calls of the form ``to=functions.name ... <|message|>{json}<|call|>``."""
    found = re.findall(r"to=functions\.([\w.-]+)[^<]*(?:<\|constrain\|>json)?\s*<\|message\|>(.*?)<\|call\|>", text or "", re.DOTALL)
    out = []
    for name, body in found:
        try:
            json.loads(body)
            out.append((name, body.strip()))
        except ValueError:
            continue
    return out


def _typed(text: str, kind: str) -> object:
    text = text.strip("\n")
    if text.lower() == "null":
        return None
    kind = kind.lower()
    if kind.startswith(("str", "text", "enum")):
        return text
    try:
        if kind.startswith(("int", "uint", "long")):
            return int(text)
        if kind.startswith(("num", "float")):
            x = float(text)
            return int(x) if x.is_integer() else x
        if kind.startswith("bool"):
            return text.lower() == "true"
        return json.loads(text)
    except ValueError:
        try:
            return ast.literal_eval(text)  # literals only; nothing is run
        except (ValueError, SyntaxError):
            return text


def xml_calls(text: str | None, types: dict[str, dict[str, str]] | None = None) -> list[tuple[str, str]]:
    """<function=name><parameter=key>value</parameter></function>, values by type."""
    out = []
    for name, body in re.findall(r"<function=([^>\n]+)>(.*?)(?:</function>|$)", text or "", re.DOTALL):
        kinds = (types or {}).get(name, {})
        args = {k: _typed(v, kinds.get(k, "string")) for k, v in re.findall(r"<parameter=([^>\n]+)>(.*?)(?:</parameter>|$)", body, re.DOTALL)}
        out.append((name, json.dumps(args, ensure_ascii=False)))
    return out


@F.pandas_udf(ArrayType(StructType([StructField("name", StringType()), StructField("arguments", StringType())])))
def tool_calls(text: pd.Series) -> pd.Series:
    return pd.Series([[{"name": n, "arguments": a} for n, a in hermes_calls(t)] for t in text])


CALLS = ArrayType(StructType([StructField("name", StringType()), StructField("arguments", StringType())]))


def _named(calls: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"name": n, "arguments": a} for n, a in calls]


@F.pandas_udf(CALLS)
def channel_tool_calls(text: pd.Series) -> pd.Series:
    return pd.Series([_named(channel_calls(t)) for t in text])


def xml_tool_calls(types: dict[str, dict[str, str]] | None = None) -> Callable[[Column], Column]:
    """A column function; types: function -> parameter -> type name."""

    @F.pandas_udf(CALLS)
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([_named(xml_calls(t, types)) for t in text])

    return run
