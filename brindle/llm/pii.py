"""Operator 6: personal data by weak supervision. DataFrame functions only.

Base spans come from four patterns with checks (email, ip, card, phone). Those and
looser candidates (numbers that failed a check, spelled-out addresses, national ids,
credentials) are put to labelers: the shape check, a gazetteer, cue words before the
span, variety of characters, and what touches the span. Votes are counted by pattern
over all documents; the number of patterns is bounded by the labelers, not by the data.
Expectation-maximisation on those counts estimates how reliable each labeler is, and a
logistic classifier is trained on its posteriors. Candidates that the classifier accepts
are added; base spans always stay.

The patterns are written so that Java's engine neither recurses nor backtracks: a run of
characters is taken possessively and only from its start, which finds the same leftmost
matches. A credential is taken whole, however long, with parts joined by dots and with
trailing '='. Places come from the gaps between matches, in code points, end exclusive.

Null and empty texts have no spans. Repeated rows and long texts need nothing special:
rows are handled one by one and only vote counts shuffle. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import stage, table

#: Base kinds, in the order that breaks ties, and the others.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "national_id")
#: Fixed patterns of the base kinds in possessive form.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates of further kinds; a capital needle in the text is looked for first.
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,64}+\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z]{2,24}", r"(?i)[\[(]at[\])]"),
    "secret": (r"(?i)(?<![A-Za-z0-9])(?:token|secret|passw(?:or)?d|api[_-]?key)[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{16,}+=*+(?:\.[A-Za-z0-9+/_-]++=*+)*+", r"(?i)token|secret|passw|api[_-]?key"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
}
LABELERS = ("shape", "gazetteer", "context", "variety", "edges")
CUES = {
    "email": r"e-?mail|contact|write|courriel|correo|mailto",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|credit|karte|carte|tarjeta|account",
    "phone": r"phone|call|tel|mobile|fax|telefon|telefono",
    "secret": r"token|secret|passw|key|bearer|auth",
    "national_id": r"ssn|social|security|national|tax",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)^(?:token|secret|passw|api)",
    "national_id": r"^(?!000|666|9)",
}
#: A check digit or range is arithmetic, whatever the other votes agree on.
LEAST_RIGHT = {"shape": 0.95}
CONTEXT, ACCEPT, ROUNDS, STEPS = 32, 0.5, 40, 400
#: Elements of a run in running sums, characters of a piece of a text that is put together.
RUN, PIECE = 64, 1024


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = _chars(F.reverse(digits))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(back, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _check(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(x))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _worth(kind: str, x: Column) -> Column:
    """Failed base matches that are worth a vote; the rest are plain numbers."""
    n = F.length(_digits(x))
    return {"card": (n >= 14) & (n <= 19), "phone": (n >= 9) & (n <= 16), "ip": F.lit(True)}.get(kind, F.lit(False))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def prefixes(x: Column, zero: Column, add: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each place of an array what ``add`` makes of all elements before it. Runs of
    RUN elements are folded first, and runs of those, so that the work is in proportion
    to the array (and to the square of one RUN^levels-th of it)."""
    fold = lambda part: F.aggregate(part, zero, add)
    if not levels:
        return F.transform(x, lambda v, i: fold(F.slice(x, 1, i)))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda j: fold(F.slice(x, j * RUN + 1, RUN)))
    run_of = lambda i: F.floor(i / RUN).cast("int")
    scanned = let(runs, lambda r: let(prefixes(r, zero, add, levels - 1), lambda before: F.transform(x, lambda v, i: add(F.get(before, run_of(i)), fold(F.slice(x, run_of(i) * RUN + 1, i % RUN))))))
    return F.when(F.size(x) > 0, scanned).otherwise(F.slice(x, 1, 0))


def _votes(kind: str, x: Column, before: Column, after: Column, good: Column) -> list[Column]:
    """Votes on a match; before: at most CONTEXT characters, after: at most one."""
    yes, no, abstain = F.lit(1), F.lit(-1), F.lit(0)
    touch = F.concat(F.right(before, F.lit(1)), F.lit(" "), after)
    distinct = F.size(F.array_distinct(_chars(F.lower(x))))
    return [
        good,
        F.when(x.rlike(GAZETTEER[kind]), yes).otherwise(no),
        F.when(F.lower(before).rlike(CUES[kind]), yes).otherwise(abstain) if kind != "secret" else yes,
        F.when(distinct >= 5, abstain).otherwise(no),
        F.when(touch.rlike(r"[\p{L}\p{N}_]"), no).otherwise(abstain),
    ]


def _spans(kind: str, shape: int, keep: Callable[[Column], Column], found: Column, gaps: Column, starts: Column) -> Column:
    """The spans of those matches that ``keep`` keeps, with votes. gaps: the text between
    matches; starts: characters before each gap."""
    text_at = lambda x, i: F.coalesce(F.get(x, i), F.lit(""))

    def span(i: Column) -> Column:
        x = F.get(found, i)
        before = F.right(F.concat(text_at(gaps, i - 1), text_at(found, i - 1), F.get(gaps, i)), F.lit(CONTEXT))
        after = F.left(F.concat(F.left(text_at(gaps, i + 1), F.lit(1)), text_at(found, i + 1)), F.lit(1))
        start = (F.get(starts, i) + F.length(F.get(gaps, i))).cast("int")
        named = [v.cast("int").alias(n) for n, v in zip(LABELERS, _votes(kind, x, before, after, F.lit(shape)))]
        bucket = F.least(F.floor(F.length(x) / 8), F.lit(7)).cast("int")
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(x)).alias("end"), F.lit(kind).alias("kind"), *named, bucket.alias("bucket"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: keep(F.get(found, i))), span)


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string," + ",".join(f"{n}:int" for n in LABELERS) + ",bucket:int>>"


def annotate(docs: DataFrame, *columns: Column, text: str = "text") -> DataFrame:
    """``columns``, base (array of struct(start, rank, end, kind) with votes and length)
    and more, the other candidates, likewise. Work is in proportion to the text and its
    matches."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    digit = whole.rlike("[0-9]")
    near = {"email": whole.contains("@"), "phone": whole.contains("+") & digit, "ip": digit, "card": digit}
    sources = [(f"_b{k}", k, PATTERNS[k], near[k]) for k in BASE] + [(f"_l{k}", k, p, whole.rlike(need)) for k, (p, need) in LOOSE.items()]
    empty = F.array().cast("array<string>")
    names = [f"_c{i}" for i in range(len(columns))]
    rows = docs.select(*[c.alias(n) for c, n in zip(columns, names)], docs[text].cast("string").alias("_text"))
    rows = rows.withColumns({f"{c}_m": F.when(need, F.regexp_extract_all(whole, F.lit(p), F.lit(0))).otherwise(empty) for c, _, p, need in sources})
    rows = rows.withColumns({f"{c}_g": F.when(F.size(f"{c}_m") > 0, F.split(whole, p, -1)).otherwise(empty) for c, _, p, _ in sources})
    add = lambda a, b: a + b
    base, more = [], []
    for c, kind, _, _ in sources:
        found, gaps = F.col(f"{c}_m"), F.col(f"{c}_g")
        lengths = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.length(g) + F.length(m))

        def spans(keep: Callable[[Column], Column], shape: int, kind=kind, found=found, gaps=gaps, lengths=lengths) -> Column:
            starts = let(lengths, lambda x: prefixes(x, F.lit(0), add))
            return F.when(F.size(found) > 0, let(starts, lambda s: _spans(kind, shape, keep, found, gaps, s))).otherwise(F.array().cast(_SPAN))

        if c.startswith("_b"):
            base.append(spans(lambda x, kind=kind: _check(kind, x), 1))
            if kind != "email":
                more.append(spans(lambda x, kind=kind: _worth(kind, x) & ~_check(kind, x), -1))
        else:
            more.append(spans(lambda x: F.lit(True), 0))
    return rows.select(*names, F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*more)).alias("more"))


@dataclass
class Model:
    reliability: dict[str, float]
    prior: dict[str, float]
    weights: dict[str, float]


def patterns(rows: DataFrame) -> list[tuple[tuple, int]]:
    """How often each (kind, votes, bucket) occurs: at most kinds x 3^labelers x 8 rows."""
    keys = ["kind", *LABELERS, "bucket"]
    seen = rows.select(F.explode(F.concat("base", "more")).alias("c")).groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).count()
    return [(tuple(r[k] for k in keys), r["count"]) for r in seen.orderBy(*keys).collect()]


def fit(counts: list[tuple[tuple, int]]) -> Model:
    """Reliabilities by expectation-maximisation, then weights of the span classifier."""
    right = {(name, c): 0.75 for name in LABELERS for c in (0, 1)}  # P(vote agrees | class, votes)
    prior = dict.fromkeys(KINDS, 0.5)
    # The checks are what is trusted at first; the others start a little better than chance.
    right |= {("shape", 0): 0.95, ("shape", 1): 0.95}

    def posterior(key: tuple) -> float:
        z = math.log(prior[key[0]] / (1 - prior[key[0]]))
        for name, v in zip(LABELERS, key[1:]):
            if v:
                yes, no = right[name, 1], right[name, 0]
                z += math.log(yes / (1 - no)) if v > 0 else math.log((1 - yes) / no)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    post = {}
    for _ in range(ROUNDS):
        post = {key: posterior(key) for key, _ in counts}
        for kind in KINDS:
            n = sum(c for key, c in counts if key[0] == kind)
            p = sum(c * post[key] for key, c in counts if key[0] == kind)
            prior[kind] = (p + 1) / (n + 2)
        for i, name in enumerate(LABELERS):
            for c in (0, 1):
                weigh = [(n * (post[k] if c else 1 - post[k]), k[1 + i]) for k, n in counts if k[1 + i]]
                hit = sum(w for w, v in weigh if (v > 0) == bool(c))
                # A labeler is never taken to be worse than chance, nor to be perfect.
                right[name, c] = min(0.98, max(LEAST_RIGHT.get(name, 0.52), (hit + 3) / (sum(w for w, _ in weigh) + 4)))
    names = lambda key: ["one", f"kind={key[0]}", f"bucket={key[-1]}", *[f"{n}={v}" for n, v in zip(LABELERS, key[1:])]]
    weights = {n: 0.0 for key, _ in counts for n in names(key)}
    total = sum(c for _, c in counts) or 1
    for _ in range(STEPS):
        step = dict.fromkeys(weights, 0.0)
        for key, c in counts:
            z = sum(weights[n] for n in names(key))
            error = post[key] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for n in names(key):
                step[n] += c / total * error
        for n, s in step.items():
            weights[n] += 2.0 * s - 1e-4 * weights[n]
    return Model({n: (right[n, 0] + right[n, 1]) / 2 for n in LABELERS}, prior, weights)


def accept(rows: DataFrame, model: Model) -> Column:
    """The base spans and the candidates that the classifier accepts, sorted."""
    if model.weights:
        weight = F.create_map(*[F.lit(x) for kv in sorted(model.weights.items()) for x in kv])
        of = lambda name: F.coalesce(F.try_element_at(weight, name), F.lit(0.0))

        def good(c: Column) -> Column:
            z = of(F.lit("one")) + of(F.concat(F.lit("kind="), c["kind"])) + of(F.concat(F.lit("bucket="), c["bucket"].cast("string")))
            for n in LABELERS:
                z = z + of(F.concat(F.lit(f"{n}="), c[n].cast("string")))
            return 1 / (1 + F.exp(-z)) >= ACCEPT

        more = F.filter(rows["more"], good)
    else:
        more = F.slice(rows["more"], 1, 0)
    return F.array_sort(F.concat(rows["base"], more))


def shown(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of each row; texts are scanned once."""
    rows = stage(annotate(docs, F.col("doc_id").cast("long")).withColumnRenamed("_c0", "doc_id"), "spans")
    return rows.select("doc_id", "base", accept(rows, fit(patterns(rows))).alias("spans"))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text in pieces of PIECE characters."""
    first = F.floor(start / PIECE).cast("int")
    part = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(part, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))


def redacted(text: Column, spans: Column) -> Column:
    """A text with each of its sorted spans replaced by its kind in brackets; overlapping
    spans are one, named after the first, that ends where the furthest ends."""

    def build(pieces: Column, reach: Column, opens: Column) -> Column:
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        # What is open ends where all before the next open one end.
        stop = lambda k: F.coalesce(F.get(reach, F.get(opens, k + 1)), last)
        begin = lambda k: F.when(k > 0, F.get(reach, F.get(opens, k))).otherwise(F.lit(0))
        head = F.transform(opens, lambda o, k: F.concat(_cut(pieces, begin(k), F.get(spans, o)["start"]), F.lit("["), F.upper(F.get(spans, o)["kind"]), F.lit("]")))
        return F.concat(F.array_join(head, ""), _cut(pieces, stop(F.size(opens) - 1), F.length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    reach = let(ends, lambda e: prefixes(e, F.lit(0), lambda a, b: F.greatest(a, b)))
    opens = lambda reach: F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= F.get(reach, i))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = let(pieces, lambda p: let(reach, lambda r: let(opens(r), lambda o: build(p, r, o))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(whole)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; columns, whatever their
    names, as they were. Overlapping spans are one, named after the first. A null text
    stays null. Texts are scanned once: rows are written with their candidates, and read
    again when the classifier is trained."""
    rows = stage(annotate(docs, F.struct("*"), text=text).withColumnRenamed("_c0", "row"), "annotated")
    spans = accept(rows, fit(patterns(rows)))
    rows = rows.select("row", spans.alias("spans"))
    clean = redacted(F.col("row").getField(text), F.col("spans"))
    return rows.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text of documents."""
    rows = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
