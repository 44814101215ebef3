"""Exact formulas: forms that are equal, near misses that aren't, and random trees."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest

from brindle.functions import formula as FM
from brindle.functions import grading as G

EQUAL = [
    ("1/2", "\\frac12"), ("0.5", "\\dfrac{1}{2}"), ("\\sqrt{8}", "2\\sqrt2"), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt{2}}{2}"), ("\\frac{1}{1+\\sqrt2}", "\\sqrt2-1"), ("\\sqrt{2}\\sqrt{3}", "\\sqrt{6}"),
    ("\\sqrt[3]{16}", "2\\sqrt[3]{2}"), ("2^{1/2}", "\\sqrt 2"), ("8^{-2/3}", "1/4"), ("(x+1)^2", "x^2+2x+1"), ("\\frac{x^2-1}{x-1}", "x+1"), ("a(b+c)", "ab + ac"), ("i^2", "-1"), ("\\sqrt{-4}", "2i"),
    ("(1+i)(1-i)", "2"), ("2\\pi r", "r\\cdot 2\\pi"), ("3 \\frac{1}{2}", "\\frac{7}{2}"), ("\\sin^2(x)", "(\\sin x)(\\sin x)"), ("\\ln 2 + \\ln 2", "2\\ln 2"), ("|-3|", "3"), ("5!", "120"), ("30^\\circ", "30"),
    ("\\begin{pmatrix} 1 & 2 \\\\ \\frac{6}{2} & 4 \\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&2^2\\\\\\end{pmatrix}"), ("(1, \\sqrt{4}]", "(1,2]"), ("\\{1,2,3\\}", "\\{3,2,1\\}"), ("x=5", "5"), ("y = 2x+1", "2x - y + 1 = 0"),
    ("x+y=2", "2x+2y=4"), ("x \\le \\frac{4}{2}", "x \\leq 2"), ("\\sqrt{12+\\sqrt{3}}\\cdot\\sqrt{12+\\sqrt{3}}", "12+\\sqrt{3}"), ("1{,}000", "1000"), ("\\frac{\\sqrt{x}}{x}", "\\frac{1}{\\sqrt x}"), ("x_{1}+x_2", "x_2 + x_1"),
]
DIFFERENT = [
    ("1/2", "1/3"), ("\\sqrt{8}", "2\\sqrt3"), ("\\sqrt{2}+\\sqrt{3}", "\\sqrt{5}"), ("3.14", "\\pi"), ("1.41421356", "\\sqrt2"), ("(x+1)^2", "x^2+2x+2"), ("x^2", "x^3"), ("\\sqrt{x^2}", "x"), ("(1,2)", "[1,2]"), ("(1,2)", "(2,1)"),
    ("\\{1,2\\}", "\\{1,3\\}"), ("\\{1,1,2\\}", "\\{1,2,2\\}"), ("x=5", "6"), ("y=2x+1", "y=2x-1"), ("x+y=2", "x-y=2"), ("x \\le 2", "x < 2"), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2\\end{pmatrix}"),
    ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&5\\end{pmatrix}"), ("\\sin x", "\\cos x"), ("ab", "a+b"), ("cat", "act"), ("2^{100}", "2^{100}+1"),
]
UNREADABLE = ["", "1+", "\\frac{1}", "(1", "1)", "{", "\\begin{pmatrix}1", "9^{9^{9}}", "1/0", "\\frac{1}{x-x}", "(" * 100 + "1" + ")" * 100, "1+" * 500 + "1", "(a+b+c+d+f+g+h)^{40}", "#", "400!", "__import__('os')"]


@pytest.mark.parametrize("a, b", EQUAL)
def test_equal(a, b):
    assert FM.equal(FM.read(a), FM.read(b)) and FM.equal(FM.read(b), FM.read(a))


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert not FM.equal(FM.read(a), FM.read(b)) and not FM.equal(FM.read(b), FM.read(a))


@pytest.mark.parametrize("text", UNREADABLE)
def test_unreadable(text):
    with pytest.raises(FM.Unreadable):
        FM.exact(FM.read(text))


def test_random_trees_against_fractions():
    """The same random formula, written in LaTeX and in Python, at rational points."""
    rng = random.Random(12)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            x = rng.choice(["x", "y", str(rng.randint(0, 9))])
            return x, f"Fraction({x})"
        (a, p), (b, q) = made(depth - 1), made(depth - 1)
        kind = rng.randrange(5)
        if kind == 4:
            n = rng.randint(0, 3)
            return f"({a})^{{{n}}}", f"({p})**{n}"
        return [
            (f"({a}+{b})", f"({p}+{q})"), (f"(({a})-({b}))", f"(({p})-({q}))"), (f"({a})({b})", f"({p})*({q})"), (f"\\frac{{{a}}}{{{b}}}", f"({p})/({q})")
        ][kind]

    checked = 0
    for _ in range(400):
        latex, python = made(4)
        x, y = Fraction(rng.randint(1, 50), rng.randint(1, 50)), Fraction(rng.randint(-50, -1), rng.randint(1, 50))
        try:
            want = eval(python, {"Fraction": Fraction, "x": x, "y": y})  # text made above
            value = FM.exact(FM.read(latex.replace("x", f"({x.numerator}/{x.denominator})").replace("y", f"({y.numerator}/{y.denominator})")))
            free = FM.exact(FM.read(latex))
        except (FM.Unreadable, ZeroDivisionError):
            continue
        assert value.rational == want
        put = lambda poly: sum(c * math.prod((x if s == "x" else y) ** int(e) for s, e in m) for m, c in poly.items())
        if put(free.below):
            assert Fraction(put(free.above)) / Fraction(put(free.below)) == want
            checked += 1
    assert checked > 100


@pytest.mark.parametrize(
    "solution, truth, right",
    [("so $\\frac{2}{4}$", "\\frac12", 1), ("\\boxed{0.50}", "1/2", 1), ("it is 3.14", "\\pi", 0), ("\\boxed{x^2-1}", "\\boxed{(x-1)(x+1)}", 1), ("50%", "0.5", 0), ("about 1,200 of them", "1200", 1), ("", "1", 0), (None, "1", 0), ("\\boxed{a and b}", "a and b", 1)],
)
def test_verified(solution, truth, right):
    assert G.verified(solution, truth) == right


@pytest.mark.parametrize(
    "solution, truth, right",
    [
        ("\\boxed{\\begin{pmatrix} 0.5 \\\\ 2 \\end{pmatrix}}", "\\begin{pmatrix} 1/2 \\\\ 2 \\end{pmatrix}", 1), ("\\boxed{y=2x+1}", "2x-y+1=0", 1), ("The answer is 2 million", "2000000", 1), ("answer: $12 \\text{ dollars}$", "12", 0),
        ("the answer is 5 meters", "5", 1), ("\\boxed{1 1/2}", "3/2", 1), ("\\boxed{\\sqrt{2}}", "1.4142", 1), ("\\boxed{\\sqrt{2}}", "1.42", 0), ("\\boxed{\\text{east}}", "\\text{East}", 1), ("\\boxed{\\text{east}}", "west", 0),
    ],
)
def test_stated_answers(solution, truth, right):
    assert G.olympiad(solution, truth) == right


def test_boxes_and_plain_text():
    assert G.boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}} c") == "\\frac{1}{2}" and G.boxed("\\boxed 7$ x") == "7" and G.boxed("\\boxed{1") is None and G.boxed("\\fbox{3}") == "3"
    assert G.plain_latex("\\dfrac  1 2") == G.plain_latex("1/2") == G.plain_latex("0.5") == "\\frac{1}{2}"
    assert G.plain_latex("x = .5\\%") == "0.5" or G.plain_latex("x = .5\\%") == "\\frac{1}{2}"
    assert G.final_answer("so x = $12\\text{ cm}$, fine") == "12" and G.final_answer("1,234 dollars") == "1234"
