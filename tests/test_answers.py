import random
from fractions import Fraction

import pytest

from trajectra.functions.answers import MOST_CHARS, canonical
from trajectra.functions.text import accuracy_score, answer_form, grade

SAME = [
    ["2x+1", "1+2*x", r"\frac{4x^2-1}{2x-1}", "(4x**2 - 1)/(2x - 1)", "x + x + 1", r"2\left(x+\frac12\right)", "y = 2x+1"],
    ["1/2", "0.5", r"\frac{1}{2}", r"\dfrac12", "50%", r"50\%", ".5", r"$\frac{2}{4}$", "x=0.50", "2^{-1}", "2^-1"],
    ["1200", "1,200", "1200.0", r"1200\text{ cm}", r"1200\text{ m}^2", "1200."],
    [r"\sqrt{8}", r"2\sqrt2", r"\frac{4}{\sqrt{2}}", "2*sqrt(2)", "8^{1/2}", "√8"],
    [r"\frac{1}{\sqrt{2}+\sqrt{3}}", r"\sqrt{3}-\sqrt{2}"],
    [r"\sqrt{6}", r"\sqrt2\cdot\sqrt3", r"\sqrt{\frac{12}{2}}"],
    ["(1, 2)", r"\left(1,\frac{4}{2}\right)", "( 1.0 , 2 )"],
    [r"\{1,2,3\}", r"\{3, 2, 1\}", r"\{1,1,2,3\}"],
    [r"3\frac{1}{2}", "3.5", r"\frac{7}{2}"],
    ["x^2+y^2=1", "1 - x^2 = y^2", "2x^2+2y^2=2"],
    ["B", r"\text{B}", "(B)", r"\textbf{B}"],
    [r"2\pi r", "2*pi*r", "r*2π"],
    ["x_1+x_2", "x_{2} + x_{1}"],
    [r"\sin(2x)+1", r"1+\sin{(x+x)}"],
    ["0", "x-x", r"\frac{0}{5}", "-0"],
    ["90", "90^\\circ", "90°"],
]
OTHER = ["2x-1", "1/3", "1201", r"\sqrt{7}", r"\sqrt{3}+\sqrt{2}", r"\sqrt{5}", "(2,1)", "[1,2]", r"\{1,2\}", "3.6", "x^2+y^2=2", "A", r"\pi r", "x_1-x_2", r"\sin(x)+1", "1", "Paris", "sirap", "no", "on", "1/0", "5!", r"\log_2 8", "", "(", "1 2 +", "x^", r"\frac{1}", "2..5", "a=b=c"]


@pytest.mark.parametrize("group", SAME, ids=lambda g: g[0])
def test_equal_answers_have_one_form(group):
    assert len({canonical(x) for x in group}) == 1, {x: canonical(x) for x in group}


def test_other_answers_have_others():
    forms = [canonical(g[0]) for g in SAME] + [canonical(x) for x in OTHER]
    assert len(set(forms)) == len(forms)
    assert canonical(None) is None


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice("xyz") if rng.random() < 0.6 else Fraction(rng.randint(-6, 6), rng.choice([1, 1, 2, 3]))
    op = rng.choice("+-*/^") if depth > 1 else rng.choice("+-*")
    return (op, tree(rng, depth - 1), rng.randint(0, 3) if op == "^" else tree(rng, depth - 1))


def value(t, at):
    if isinstance(t, str):
        return at[t]
    if not isinstance(t, tuple):
        return Fraction(t)
    a, b = value(t[1], at), value(t[2], at)
    if t[0] == "+":
        return a + b
    if t[0] == "-":
        return a - b
    if t[0] == "*":
        return a * b
    return a / b if t[0] == "/" else a ** int(b)


def shown(t, rng):
    if isinstance(t, str):
        return t
    if not isinstance(t, tuple):
        t = Fraction(t)
        return str(t) if t.denominator == 1 and t >= 0 else f"({t.numerator}/{t.denominator})" if rng.random() < 0.5 else rf"\left(\frac{{{t.numerator}}}{{{t.denominator}}}\right)"
    a, b = shown(t[1], rng), shown(t[2], rng)
    if t[0] == "/":
        return rf"\frac{{{a}}}{{{b}}}" if rng.random() < 0.5 else f"(({a})/({b}))"
    if t[0] == "^":
        return f"({a})^{b}" if rng.random() < 0.5 else f"({a})^{{{b}}}"
    if t[0] == "*":
        return rng.choice([f"({a})({b})", f"({a})*({b})", rf"({a})\cdot({b})"])
    return f"({a}){t[0]}({b})"


def varied(t, rng):
    """The same value in another form."""
    if not isinstance(t, tuple):
        return ("+", t, 0) if rng.random() < 0.1 else t
    a, b = varied(t[1], rng), varied(t[2], rng) if t[0] != "^" else t[2]
    if t[0] in "+*" and rng.random() < 0.5:
        return (t[0], b, a)
    if t[0] == "^" and b == 2:
        return ("*", a, a)
    if t[0] == "*" and isinstance(b, tuple) and b[0] in "+-" and rng.random() < 0.6:
        return (b[0], ("*", a, b[1]), ("*", a, b[2]))
    if t[0] == "-" and rng.random() < 0.5:
        return ("+", a, ("*", -1, b))
    return (t[0], a, b)


@pytest.mark.parametrize("seed", range(8))
def test_against_values_at_random_points(seed):
    """Forms are equal exactly where the values at random rational points are."""
    rng = random.Random(seed)
    points = [{v: Fraction(rng.randint(-10**6, 10**6), rng.randint(1, 10**4)) for v in "xyz"} for _ in range(3)]
    made = []
    while len(made) < 60:
        t = tree(rng, 3)
        for form in (t, varied(t, rng), varied(varied(t, rng), rng)):
            try:
                values = tuple(value(form, at) for at in points)
            except ZeroDivisionError:
                break
            made.append((values, canonical(f"({shown(form, rng)})+0")))
    read = [x for x in made if x[1].startswith("value ")]
    assert len(read) >= 0.95 * len(made)
    for values, form in read:
        for other, its in read:
            assert (values == other) == (form == its)


def test_large_and_deep_answers_are_compared_as_text():
    for text in ("(" * 500 + "x" + ")" * 500, "9" * 300, "(x+1)^99999", "(a+b+c+d+e+f)^60", "2^" * 200 + "2", "x+" * MOST_CHARS + "x", "√" * 30 + "2"):
        assert canonical(text) == canonical(" " + text + " ")
        assert grade(rf"\boxed{{{text}}}", text) == 1.0


def test_columns(spark):
    rows = [(r"\boxed{x+1}", "1+x"), (r"a \boxed{3} b \boxed{4}", "3"), ("no box", "1"), (None, "B"), (r"\boxed{2}", None), (r"\boxed{\{1,2\}}", r"\boxed{\{2,1\}}"), (r"\boxed{", "1"), ("", "")]
    df = spark.createDataFrame(rows, "response string, truth string")
    got = df.select(accuracy_score("response", "truth").alias("a"), answer_form("truth").alias("form")).collect()
    assert [r["a"] for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    assert [r["form"] for r in got][3:6] == ["value 1*B", None, canonical(r"\{1,2\}")]
    assert df.limit(0).select(accuracy_score("response", "truth")).count() == 0
