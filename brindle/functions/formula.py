r"""Formulas of answers: tokens, a tree, and exact values that can be compared.

``read`` turns LaTeX or plain text into a tree of tuples. ``Exact`` evaluates a tree without
rounding to a quotient of polynomials over the rationals in names, pi, e, the imaginary unit,
powers of primes with exponents below one (so roots of numbers have one form), and, as names of
their own, what has no such form: roots of sums, functions, powers by formulas. Two values
are equal if their cross products are. Lists, sets, matrices and relations are compared part
by part; an equation is what its sides differ by, up to a factor.

Nothing is evaluated as code. What a grammar of a few rules doesn't cover, and what would
grow over the limits below, raises ``Unreadable``.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import cached_property, lru_cache

#: A run of three letters or more is a word, and one name.
TOKEN = re.compile(r"\\(?:begin|end)\{[a-zA-Z*]+\}|\\[a-zA-Z]+|\\.|\d+(?:\.\d+)?|\.\d+|[a-zA-Z]{3,}|[a-zA-Z]|\S")
#: Limits: tokens, terms of a polynomial, bits of a number, depth of a tree, steps to a factor.
MOST_TOKENS, MOST_TERMS, MOST_BITS, MOST_DEPTH, MOST_DIVISOR = 400, 300, 4000, 60, 100_000
#: Divisors that are tried in turn, before larger factors are looked for.
TRIED = 1000
#: Values of trees, of parts of trees too, that a worker remembers.
REMEMBERED = 512

#: Commands that only place or style, and other names of the same sign.
PLAIN = {"\\left", "\\right", "\\!", "\\,", "\\;", "\\:", "\\ ", "\\displaystyle", "\\limits", "\\quad", "\\qquad", "$", "\\$", "\\(", "\\)", "\\%", "%", "\\big", "\\Big", "\\bigl", "\\bigr"}
SAME = {"\\cdot": "*", "\\times": "*", "\\ast": "*", "\\div": "/", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cfrac": "\\frac", "\\leq": "\\le", "\\geq": "\\ge", "\\neq": "\\ne", "−": "-", "–": "-", "π": "\\pi", "√": "\\sqrt", "≤": "\\le", "≥": "\\ge", "∞": "\\infty", "\\lbrace": "\\{", "\\rbrace": "\\}", "×": "*", "·": "*"}
RELATIONS = {"=": "=", "<": "<", ">": ">", "\\lt": "<", "\\gt": ">", "\\le": "\\le", "\\ge": "\\ge", "\\ne": "\\ne", "\\in": "\\in"}
CALLS = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "cot": lambda x: 1 / math.tan(x), "sec": lambda x: 1 / math.cos(x), "csc": lambda x: 1 / math.sin(x), "ln": math.log, "log": math.log10, "exp": math.exp, "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan, "abs": abs}
WRAPPERS = {"\\text", "\\mathrm", "\\mathbf", "\\textbf", "\\mathit", "\\operatorname", "\\mbox", "\\boldsymbol", "\\overline"}
CLOSING = {"(": ")", "[": "]", "{": "}", "\\{": "\\}"}


class Unreadable(ValueError):
    """The text is no formula that the grammar covers."""


class _Tree:
    """Recursive descent; each method reads one rule and returns its tree."""

    def __init__(self, text: str):
        text = re.sub(r"(?<=\d)(?:,|\{,\}|,\\!)(?=\d{3}(?!\d))", "", text)
        text = re.sub(r"(?<![a-zA-Z\\])(sqrt|pi|sin|cos|tan|cot|sec|csc|ln|log|exp|arcsin|arccos|arctan)(?![a-zA-Z])", r"\\\1 ", text)
        text = text.replace("**", "^")
        self.rest = [SAME.get(t, t) for t in TOKEN.findall(text) if t not in PLAIN]
        self.rest.reverse()
        if len(self.rest) > MOST_TOKENS:
            raise Unreadable("too long")
        self.depth = 0

    @property
    def next(self) -> str:
        return self.rest[-1] if self.rest else ""

    def take(self, wanted: str | None = None) -> str:
        if not self.rest or wanted is not None and self.rest[-1] != wanted:
            raise Unreadable(f"{wanted or 'more'} expected, not {self.next or 'the end'}")
        return self.rest.pop()

    def whole(self):
        tree = self.items()
        if self.rest:
            raise Unreadable(f"left over: {self.next}")
        return tree

    def items(self):
        """relation (, relation)*"""
        found = [self.relation()]
        while self.next in (",", ";"):
            self.take()
            found.append(self.relation())
        return found[0] if len(found) == 1 else ("list", "", "", found)

    def relation(self):
        sides, signs = [self.sum()], []
        while self.next in RELATIONS:
            signs.append(RELATIONS[self.take()])
            sides.append(self.sum())
        return ("relation", signs, sides) if signs else sides[0]

    def sum(self):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise Unreadable("too deep")
        tree = None
        while tree is None or self.next in ("+", "-"):
            sign = self.take() if self.next in ("+", "-") else "+"
            term = self.product()
            term = ("-", term) if sign == "-" else term
            tree = term if tree is None else ("+", tree, term)
        self.depth -= 1
        return tree

    def product(self):
        tree = self.power()
        while True:
            if self.next in ("*", "/"):
                sign = self.take()
                negative = self.next == "-" and bool(self.take())
                by = self.power()
                tree = (sign, tree, ("-", by) if negative else by)
            elif self.next == "\\frac" and tree[0] == "number" and "." not in tree[1]:
                part = self.power()  # a whole number and a fraction: a mixed number
                plain = part[0] == "/" and part[1][0] == part[2][0] == "number"
                tree = ("+" if plain else "*", tree, part)
            elif self.next and (self.next[0].isalnum() or self.next in ("(", "[", "{", "|") or self.next[0] == "\\" and self.next not in RELATIONS and self.next not in ("\\}", "\\\\", "\\pm") and not self.next.startswith("\\end")):
                if self.next == "|" and self.bar:
                    return tree
                tree = ("*", tree, self.power())
            else:
                return tree

    bar = 0

    def power(self):
        base = self.atom()
        while self.next in ("^", "_", "!"):
            sign = self.take()
            if sign == "!":
                base = ("call", "factorial", base)
            elif sign == "_":
                index = self.argument()  # the base of a number, or the index of a name
                base = base if base[0] == "number" else ("name", f"{base[1]}_{index!r}") if base[0] == "name" else base
            elif self.next == "\\circ":
                self.take()  # degrees
            elif self.next == "{" and self.rest[-2:-4:-1] == ["\\circ", "}"]:
                del self.rest[-3:]
            else:
                base = ("^", base, self.argument())
        return base

    def argument(self):
        """What a command or a sign takes: a group, or one digit, letter or command."""
        if self.next == "{":
            return self.atom()
        if self.next == "-":
            self.take()
            return ("-", self.argument())
        if self.next[:1].isdigit() and len(self.next) > 1:
            token = self.take()
            self.rest += [token[1:], token[0]]
        return self.atom()

    def atom(self):
        token = self.take()
        if token[0].isdigit() or token[0] == "." and len(token) > 1:
            return ("number", token)
        if token in ("(", "[", "{", "\\{"):
            return self.group(token)
        if token == "|":
            self.bar += 1
            inner = self.sum()
            self.bar -= 1
            self.take("|")
            return ("call", "abs", inner)
        if token == "\\frac":
            above = self.argument()
            return ("/", above, self.argument())
        if token == "\\sqrt":
            order = ("number", "2")
            if self.next == "[":
                self.take()
                order = self.sum()
                self.take("]")
            return ("^", self.argument(), ("/", ("number", "1"), order))
        if token in WRAPPERS:
            self.take("{")
            letters = []
            while self.next != "}":
                letters.append(self.take())
            self.take("}")
            return ("name", "".join(letters))
        if token.startswith("\\begin"):
            return self.matrix(token[6:])
        if token[1:] in CALLS and token[0] == "\\":
            order = self.argument() if self.next == "^" and self.take() else None
            inner = self.power()
            call = ("call", token[1:], inner)
            return call if order is None else ("^", call, order)
        if token[0].isalpha() or token[0] == "\\" and token[1:].isalpha():
            return ("name", token)
        if token == "-":
            return ("-", self.power())
        raise Unreadable(f"{token} begins nothing")

    def group(self, opening: str):
        if self.next == CLOSING[opening]:
            self.take()
            return ("list", opening, CLOSING[opening], [])
        self.depth += 1
        outer, self.bar = self.bar, 0
        inner = self.items()
        self.bar = outer
        self.depth -= 1
        # An interval may close otherwise than it opens.
        closing = self.take()
        if closing != CLOSING[opening] and (opening not in "([" or closing not in (")", "]")):
            raise Unreadable(f"{opening} closed by {closing}")
        if inner[0] == "list" and not inner[1]:
            return ("list", opening, closing, inner[3]) if opening != "{" else inner
        return inner if opening != "\\{" and CLOSING[opening] == closing else ("list", opening, closing, [inner])

    def matrix(self, kind: str):
        rows, row = [], [self.sum()]
        while not self.next.startswith("\\end"):
            if self.take() == "&":
                row.append(self.sum())
            else:
                rows.append(row)
                if self.next.startswith("\\end"):  # a break after the last row
                    row = []
                    break
                row = [self.sum()]
        self.take("\\end" + kind)
        return ("matrix", rows + [row] if row else rows)


def read(text: str):
    """The tree of a text."""
    return _Tree(text).whole()


Monomial = tuple[tuple[object, Fraction], ...]
Poly = dict[Monomial, Fraction]
ONE: Poly = {(): Fraction(1)}


def _key(poly: Poly) -> tuple:
    return tuple(sorted(poly.items(), key=repr))


def _checked(poly: Poly) -> Poly:
    poly = {m: c for m, c in poly.items() if c}
    if len(poly) > MOST_TERMS or any(max(c.numerator.bit_length(), c.denominator.bit_length()) > MOST_BITS for c in poly.values()):
        raise Unreadable("too large")
    return poly


def _plus(p: Poly, q: Poly, sign: int = 1) -> Poly:
    out = dict(p)
    for m, c in q.items():
        out[m] = out.get(m, Fraction(0)) + sign * c
    return _checked(out)


def _times(p: Poly, q: Poly) -> Poly:
    if len(p) * len(q) > MOST_TERMS**2 // 4:
        raise Unreadable("too large")
    if p == ONE or q == ONE:
        return q if p == ONE else p
    out: Poly = {}
    for m, c in p.items():
        for n, d in q.items():
            # Terms of polynomials are resolved already; one without names changes nothing.
            for k, v in (_term(c * d, m, n) if m and n else {m or n: c * d}).items():
                out[k] = out.get(k, Fraction(0)) + v
    return _checked(out)


def _term(c: Fraction, m: Monomial, n: Monomial) -> Poly:
    """c m n with whole powers of primes, of the imaginary unit and of roots resolved."""
    powers: dict[object, Fraction] = dict(m)
    for s, e in n:
        powers[s] = powers.get(s, Fraction(0)) + e
    whole = ONE
    for s, e in list(powers.items()):
        times = math.floor(e)
        if isinstance(s, int):
            c, e = c * Fraction(s) ** times, e - times
        elif s == "i":
            c, e = (-c, e % 2) if e % 4 >= 2 else (c, e % 2)
        elif isinstance(s, tuple) and s[0] == "root" and times:
            whole, e = _times(whole, _raised(dict(s[1]), times)), e - times
        powers[s] = e
    left = tuple(sorted(((s, e) for s, e in powers.items() if e), key=repr))
    return _checked({left: c}) if whole is ONE else _times({left: c}, whole)


def _raised(p: Poly, n: int) -> Poly:
    if n > 64 and len(p) > 1 or n > MOST_BITS:
        raise Unreadable("too large a power")
    out = ONE
    while n:
        if n & 1:
            out = _times(out, p)
        n >>= 1
        if n:
            p = _times(p, p)
    return out


def _prime(n: int) -> bool:
    """By strong tests to thirteen bases: certain below 3e24, and no other number is known."""
    odd = n - 1
    twos = (odd & -odd).bit_length() - 1
    odd >>= twos
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41):
        x = pow(a, odd, n)
        if x in (1, n - 1, 0):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _divisor(n: int) -> int:
    """A divisor of a composite number without small ones, by Pollard's rho."""
    root = math.isqrt(n)
    if root * root == n:
        return root
    steps = 0
    for c in range(1, 20):
        x = y = 2
        d = 1
        while d == 1:
            x = (x * x + c) % n
            y = (y * y + c) % n
            y = (y * y + c) % n
            d = math.gcd(x - y, n)
            steps += 1
            if steps > MOST_DIVISOR:
                raise Unreadable("a number with large prime factors under a root")
        if d != n:
            return d
    raise Unreadable("a number with large prime factors under a root")


def _factors(n: int) -> dict[int, int]:
    out: dict[int, int] = {}
    d = 2
    while d * d <= n and d < TRIED:
        while n % d == 0:
            out[d] = out.get(d, 0) + 1
            n //= d
        d += 1
    left = [n] if n > 1 else []
    while left:
        n = left.pop()
        if n < TRIED**2 or _prime(n):
            out[n] = out.get(n, 0) + 1
        else:
            d = _divisor(n)
            left += [d, n // d]
    return out


class Exact:
    """A quotient of polynomials."""

    def __init__(self, above: Poly, below: Poly = ONE):
        if not below:
            raise Unreadable("division by zero")
        if len(below) == 1:  # by one term: only its factor is divided by
            (m, c), = below.items()
            if not m:
                above, below = {k: v / c for k, v in above.items()}, ONE
        self.above, self.below = above, below

    @staticmethod
    def number(x: Fraction | int) -> Exact:
        return Exact(_checked({(): Fraction(x)}))

    @staticmethod
    def symbol(s: object) -> Exact:
        return Exact({((s, Fraction(1)),): Fraction(1)})

    def __add__(self, o: Exact) -> Exact:
        if self.below == o.below == ONE:
            return Exact(_plus(self.above, o.above))
        return Exact(_plus(_times(self.above, o.below), _times(o.above, self.below)), _times(self.below, o.below))

    def __neg__(self) -> Exact:
        return Exact({m: -c for m, c in self.above.items()}, self.below)

    def __mul__(self, o: Exact) -> Exact:
        return Exact(_times(self.above, o.above), _times(self.below, o.below))

    def __truediv__(self, o: Exact) -> Exact:
        return Exact(_times(self.above, o.below), _times(self.below, o.above))

    def __eq__(self, o: object) -> bool:
        return isinstance(o, Exact) and _times(self.above, o.below) == _times(o.above, self.below)

    __hash__ = None  # type: ignore[assignment]

    @property
    def rational(self) -> Fraction | None:
        if not self.above:
            return Fraction(0)
        return self.above[()] if self.below == ONE and set(self.above) == {()} else None

    @cached_property
    def key(self) -> tuple:
        """Equal for quotients of equal parts, up to a common factor."""
        lead = self.below[min(self.below, key=repr)]
        return _key({m: c / lead for m, c in self.above.items()}), _key({m: c / lead for m, c in self.below.items()})

    def __pow__(self, o: Exact) -> Exact:
        by = o.rational
        if by is None:
            return Exact.symbol(("power", self.key, o.key, self.about(), o.about()))
        if by < 0:
            return Exact(self.below, self.above) ** Exact.number(-by)
        if by.denominator == 1:
            return Exact(_raised(self.above, by.numerator), _raised(self.below, by.numerator))
        return _root(self.above, by) / _root(self.below, by)

    def about(self) -> float | None:
        """The value as a double, if no name is free."""

        def of(poly: Poly) -> float | None:
            total = 0.0
            for m, c in poly.items():
                x = float(c)
                for s, e in m:
                    v = _about(s)
                    if v is None or v < 0 and e.denominator > 1:
                        return None
                    x *= v ** float(e)
                total += x
            return total

        try:
            above, below = of(self.above), of(self.below)
            return None if above is None or below is None else above / below
        except (OverflowError, ZeroDivisionError):
            return None


def _about(s: object) -> float | None:
    if isinstance(s, int):
        return float(s)
    if s in ("\\pi", "e"):
        return math.pi if s == "\\pi" else math.e
    if isinstance(s, tuple) and s[0] == "root":
        return Exact(dict(s[1])).about()
    if isinstance(s, tuple) and s[0] == "power" and None not in s[3:]:
        return s[3] ** s[4] if s[3] > 0 else None
    if isinstance(s, tuple) and s[0] == "call":
        return s[3]
    return None


def _root(poly: Poly, by: Fraction) -> Exact:
    """A polynomial to a power that is not whole."""
    if not poly:
        return Exact({})
    if len(poly) == 1:
        (m, c), = poly.items()
        plain = all(s != "i" and not (by.denominator % 2 == 0 and isinstance(s, str) and e.denominator == 1 and e % 2 == 0 and s not in ("\\pi", "e")) for s, e in m)
        if plain and (c > 0 or by.denominator == 2 or by.denominator % 2):
            out = Exact.number(1)
            if c < 0:
                out = Exact.symbol("i") ** Exact.number(by.numerator) if by.denominator == 2 else Exact.number((-1) ** by.numerator)
            terms: Poly = ONE
            for n, sign in ((abs(c.numerator), 1), (c.denominator, -1)):
                if by.denominator == 2 and (root := math.isqrt(n)) ** 2 == n:
                    terms = _times(terms, {(): Fraction(root) ** (sign * by.numerator)})  # whole, so no factor is looked for
                    continue
                for p, k in _factors(n).items():
                    terms = _times(terms, _term(Fraction(1), ((p, sign * k * by),), ()))
            for s, e in m:
                terms = _times(terms, _term(Fraction(1), ((s, e * by),), ()))
            return out * Exact(terms)
    # A sum: what is common to its numbers comes out, the rest is a name of its own.
    common = Fraction(math.gcd(*[c.numerator for c in poly.values()]), math.lcm(*[c.denominator for c in poly.values()]))
    rest = {m: c / common for m, c in poly.items()}
    name = ("root", _key(rest))
    return (_root({(): common}, by) if common != 1 else Exact.number(1)) * Exact(_term(Fraction(1), ((name, by),), ()))


def exact(tree) -> Exact:
    """The value of a tree that is one formula."""
    try:
        return _remembered(tree)
    except TypeError:  # lists are no keys
        return _value(tree)


def _value(tree) -> Exact:
    kind = tree[0]
    if kind == "number":
        return Exact.number(Fraction(tree[1]))
    if kind == "name":
        return Exact.symbol(tree[1])
    if kind == "-":
        return -exact(tree[1])
    if kind in ("+", "*", "/", "^"):
        a, b = exact(tree[1]), exact(tree[2])
        return a + b if kind == "+" else a * b if kind == "*" else a / b if kind == "/" else a**b
    if kind == "call":
        return _called(tree[1], exact(tree[2]))
    raise Unreadable(f"a {kind} is no number")


_remembered = lru_cache(REMEMBERED)(_value)


def _called(name: str, x: Exact) -> Exact:
    n = x.rational
    if name == "factorial":
        if n is None or n.denominator != 1 or not 0 <= n <= 300:
            raise Unreadable("factorial")
        return Exact.number(math.factorial(n.numerator))
    if name == "abs" and n is not None:
        return Exact.number(abs(n))
    try:
        value = x.about()
        about = CALLS[name](value) if value is not None else None
    except (ValueError, OverflowError, ZeroDivisionError):
        about = None
    return Exact.symbol(("call", name, x.key, about))


def equal(a, b, number=None) -> bool:
    """Whether two trees are equal. ``number`` says so of two values that aren't exactly."""
    kinds = {a[0], b[0]}
    if "list" in kinds:
        if len(kinds) == 2:
            return False
        (_, open_a, close_a, x), (_, open_b, close_b, y) = a, b
        if len(x) != len(y) or (open_a or open_b) and open_a and (open_a, close_a) != (open_b, close_b):
            return False
        if open_a != "\\{":
            return all(equal(p, q, number) for p, q in zip(x, y))
        rest = list(y)
        for p in x:  # a set: in any order
            at = next((i for i, q in enumerate(rest) if equal(p, q, number)), None)
            if at is None:
                return False
            rest.pop(at)
        return True
    if "matrix" in kinds:
        if len(kinds) == 2 or [len(r) for r in a[1]] != [len(r) for r in b[1]]:
            return False
        return all(equal(p, q, number) for r, s in zip(a[1], b[1]) for p, q in zip(r, s))
    if "relation" in kinds:
        if len(kinds) == 2:  # a value that is only named: x = 5
            named, other = (a, b) if a[0] == "relation" else (b, a)
            return named[1] == ["="] and named[2][0][0] == "name" and equal(named[2][1], other, number)
        if a[1] == b[1] == ["="]:
            return _same_equation(a[2], b[2], number)
        return a[1] == b[1] and all(equal(p, q, number) for p, q in zip(a[2], b[2]))
    x, y = exact(a), exact(b)
    return x == y or number is not None and number(x, y)


def _same_equation(one: list, other: list, number) -> bool:
    if any(t[0] in ("list", "matrix") for t in one + other):
        return all(equal(p, q, number) for p, q in zip(one, other))
    x, y = (exact(s[0]) + -exact(s[1]) for s in (one, other))
    if not x.above or not y.above:
        return x.above == y.above
    # Zero where the other is: numerators that are multiples of each other.
    p, q = x.above, y.above
    lead = min(p, key=repr)
    if lead not in q or p.keys() != q.keys():
        return False
    return all(p[m] * q[lead] == q[m] * p[lead] for m in p)
