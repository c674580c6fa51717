"""When two short mathematical answers are the same: a reader of plain and LaTeX notation and a canonical form of what it reads.

An expression is a rational function of its variables over exact fractions, with square roots of rational numbers. Numerator and
denominator are polynomials: a dict from a monomial (sorted pairs of name and exponent) to a Fraction. The canonical form has no
root in the denominator, no common factor, and 1 as the denominator's leading coefficient, so two expressions are equal
exactly if their forms are; roots and functions of anything but numbers count as variables of their own.
What is no expression, or becomes too large, is compared as text.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce

Poly = dict[tuple[tuple[str, int], ...], Fraction]

#: An exponent, the terms of a polynomial, the digits of a number, the characters and the nesting of an answer, at most.
MOST_POWER, MOST_TERMS, MOST_DIGITS, MOST_CHARS, MOST_DEPTH = 64, 400, 200, 1000, 40
ONE: Poly = {(): Fraction(1)}


class NoExpression(ValueError):
    """The text isn't an expression, or its form would be too large."""


# ---- polynomials


def _checked(p: dict) -> Poly:
    out = {m: c for m, c in p.items() if c}
    if len(out) > MOST_TERMS or any(max(abs(c.numerator), c.denominator).bit_length() > 4 * MOST_DIGITS for c in out.values()):
        raise NoExpression("too large")
    return out


def add(a: Poly, b: Poly, sign: int = 1) -> Poly:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + sign * c
    return _checked(out)


def _is_root(name: str) -> bool:
    return name.startswith("√")


def multiply(a: Poly, b: Poly) -> Poly:
    out: dict = {}
    for m, c in a.items():
        for n, d in b.items():
            powers, scale = dict(m), c * d
            for name, k in n:
                powers[name] = powers.get(name, 0) + k
                if _is_root(name) and powers[name] == 2:  # the square of a prime's root is the prime
                    scale *= int(name[1:])
                    del powers[name]
            key = tuple(sorted(powers.items()))
            out[key] = out.get(key, Fraction(0)) + scale
    return _checked(out)


def _names(p: Poly) -> set[str]:
    return {name for m in p for name, _ in m}


def _leading(p: Poly) -> Fraction:
    """The coefficient of the greatest monomial, by total degree and then by name."""
    return p[max(p, key=lambda m: (sum(k for _, k in m), m))]


def _scaled(p: Poly, by: Fraction) -> Poly:
    return {m: c * by for m, c in p.items()}


def _by_power(p: Poly, name: str) -> dict[int, Poly]:
    """p as a polynomial in name: its coefficients by power."""
    out: dict[int, Poly] = {}
    for m, c in p.items():
        k = dict(m).get(name, 0)
        out.setdefault(k, {})[tuple(x for x in m if x[0] != name)] = c
    return out


def _power_of(name: str, k: int) -> Poly:
    return {((name, k),): Fraction(1)} if k else ONE


def divide(p: Poly, q: Poly) -> Poly | None:
    """p / q if q divides p, else None."""
    if not p:
        return {}
    names = _names(p) | _names(q)
    if not names:
        return _scaled(p, 1 / q[()])
    name = max(names)
    top, low = _by_power(p, name), _by_power(q, name)
    high = max(low)
    out: Poly = {}
    while top:
        k = max(top)
        part = divide(top[k], low[high]) if k >= high else None
        if part is None:
            return None
        part = multiply(part, _power_of(name, k - high))
        out = add(out, part)
        p = add(p, multiply(part, q), -1)
        top = _by_power(p, name) if p else {}
    return out


def gcd(p: Poly, q: Poly) -> Poly:
    """A greatest common divisor, by primitive remainders in one variable after another; numbers have 1."""
    if not p or not q:
        return p or q
    both = _names(p) & _names(q)
    if not both:
        return ONE if not _names(p) or not _names(q) else _of_coefficients(p, q)
    name = max(_names(p) | _names(q))
    if name not in both:
        return _of_coefficients(p, q)
    parts = []
    for x in (p, q):
        content = reduce(gcd, _by_power(x, name).values())
        parts.append((content, divide(x, content)))
    (c, a), (d, b) = parts
    while b:
        a, b = b, _remainder(a, b, name)
        if b:
            b = divide(b, reduce(gcd, _by_power(b, name).values()))
    if name not in _names(a):
        a = ONE
    out = multiply(a, gcd(c, d))
    return _scaled(out, 1 / _leading(out))


def _of_coefficients(p: Poly, q: Poly) -> Poly:
    """The gcd of polynomials whose greatest variable isn't in both: that of one with the other's coefficients."""
    name = max(_names(p) | _names(q))
    return reduce(gcd, [*(_by_power(p, name).values()), *(_by_power(q, name).values())])


def _remainder(a: Poly, b: Poly, name: str) -> Poly:
    low = _by_power(b, name)
    high = max(low)
    while a and (top := _by_power(a, name)) and (k := max(top)) >= high:
        a = add(multiply(a, low[high]), multiply(multiply(top[k], _power_of(name, k - high)), b), -1)
        if high == 0:
            return {}
    return a


# ---- rational functions


class Ratio:
    """A quotient of polynomials in its canonical form."""

    def __init__(self, top: Poly, low: Poly = ONE):
        if not low:
            raise NoExpression("division by zero")
        while roots := sorted(x for x in _names(low) if _is_root(x)):
            parts = _by_power(low, roots[-1])
            other = add(parts.get(0, {}), multiply(parts[1], _power_of(roots[-1], 1)), -1)
            top, low = multiply(top, other), multiply(low, other)
        # The roots that the numerator has are independent, so what divides it divides the factor of each.
        by_root: dict[tuple, Poly] = {}
        for m, c in top.items():
            own = tuple(x for x in m if _is_root(x[0]))
            by_root.setdefault(own, {})[tuple(x for x in m if not _is_root(x[0]))] = c
        common = reduce(gcd, by_root.values(), low)
        top = {}
        for own, p in by_root.items():
            top = add(top, multiply({own: Fraction(1)}, divide(p, common)))
        low = divide(low, common)
        first = _leading(low)
        self.top, self.low = _scaled(top, 1 / first), _scaled(low, 1 / first)

    def __add__(self, other: Ratio) -> Ratio:
        return Ratio(add(multiply(self.top, other.low), multiply(other.top, self.low)), multiply(self.low, other.low))

    def __neg__(self) -> Ratio:
        return Ratio(_scaled(self.top, Fraction(-1)), self.low)

    def __mul__(self, other: Ratio) -> Ratio:
        return Ratio(multiply(self.top, other.top), multiply(self.low, other.low))

    def __truediv__(self, other: Ratio) -> Ratio:
        return Ratio(multiply(self.top, other.low), multiply(self.low, other.top))

    def number(self) -> Fraction | None:
        return None if _names(self.top) or self.low != ONE else self.top.get((), Fraction(0))

    def power(self, exponent: Ratio) -> Ratio:
        n = exponent.number()
        if n is not None and n.denominator == 2 and abs(n) < MOST_POWER:
            root = square_root(self)
            return Ratio(ONE) / root.power(_ratio(-2 * n)) if n < 0 else root.power(_ratio(2 * n))
        if n is None or n.denominator != 1 or abs(n) > MOST_POWER:
            return _named(f"({self})^({exponent})")
        if n < 0:
            return (Ratio(ONE) / self).power(_ratio(-n))
        out = Ratio(ONE)
        for _ in range(int(n)):
            out = out * self
        return out

    def __str__(self) -> str:
        def shown(p: Poly) -> str:
            return " + ".join("*".join([str(p[m]), *(f"{name}^{k}" if k > 1 else name for name, k in m)]) for m in sorted(p)) or "0"

        return shown(self.top) if self.low == ONE else f"({shown(self.top)})/({shown(self.low)})"


def _ratio(x: Fraction | int) -> Ratio:
    return Ratio(_checked({(): Fraction(x)}))


def _named(name: str) -> Ratio:
    return Ratio({((name, 1),): Fraction(1)})


def square_root(x: Ratio) -> Ratio:
    n = x.number()
    if n is None or n < 0:
        return _named(f"sqrt({x})")
    # sqrt(a/b) = sqrt(a b)/b, and a number's root is that of its primes.
    rest, outside, inside, p = n.numerator * n.denominator, 1, [], 2
    while p * p <= rest:
        while rest % (p * p) == 0:
            rest //= p * p
            outside *= p
        if rest % p == 0:
            rest //= p
            inside.append(p)
        p += 1
        if p > 10_000:
            return _named(f"sqrt({x})")
    inside += [rest] if rest > 1 else []
    roots = tuple(sorted((f"√{q}", 1) for q in inside))
    return Ratio({roots: Fraction(outside, n.denominator)} if n else {})


# ---- reading

#: Names of functions and of constants that are written out.
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "log", "ln", "exp")
GREEK = ("alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "pi", "rho", "sigma", "tau", "phi", "omega")

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?|\.\d+)|\\(?P<command>[a-zA-Z]+)|(?P<word>[A-Za-z]+)|(?P<sign>\*\*|[-+*/^(){}\[\]_!|πθ%]))")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise NoExpression(text[at : at + 10])
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Reader:
    """Sums of products of powers; products may lack their sign. An expression that isn't read to its end is none."""

    def __init__(self, text: str):
        self.tokens = _tokens(text) + [("end", "")]
        self.at = self.depth = 0

    def whole(self) -> Ratio:
        out = self.sum()
        if self.tokens[self.at][0] != "end":
            raise NoExpression(self.tokens[self.at][1])
        return out

    def _next(self, *wanted: str) -> str | None:
        kind, value = self.tokens[self.at]
        if (kind in ("sign", "command", "word")) and value in wanted:
            self.at += 1
            return value
        return None

    def _need(self, wanted: str) -> None:
        if not self._next(wanted):
            raise NoExpression(f"{wanted} is missing")

    def sum(self) -> Ratio:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise NoExpression("too deep")
        sign = self._next("+", "-")
        out = -self.product() if sign == "-" else self.product()
        while sign := self._next("+", "-"):
            right = self.product()
            out = out + (-right if sign == "-" else right)
        self.depth -= 1
        return out

    def product(self) -> Ratio:
        out = self.signed()
        while True:
            kind, value = self.tokens[self.at]
            if self._next("*", "cdot", "times"):
                out = out * self.signed()
            elif self._next("/", "div"):
                out = out / self.signed()
            elif kind == "number" or kind == "word" or kind == "command" or value in ("(", "[", "{", "π", "θ"):
                out = out * self.power()
            else:
                return out

    def signed(self) -> Ratio:
        sign = self._next("-", "+")
        if not sign:
            return self.power()
        return -self.signed() if sign == "-" else self.signed()

    def power(self) -> Ratio:
        out = self.atom()
        while self._next("%"):
            out = out / _ratio(100)
        if self._next("^", "**"):
            out = out.power(self.exponent())
        return out

    def exponent(self) -> Ratio:
        if sign := self._next("-", "+"):
            return -self.exponent() if sign == "-" else self.exponent()
        # Without braces LaTeX takes one digit, plain notation all of them, which is what answers mean.
        return self.power()

    def _bracket(self, opening: str, closing: str) -> Ratio:
        self._need(opening)
        out = self.sum()
        self._need(closing)
        return out

    def _argument(self) -> Ratio:
        """Of a command: in braces, or one token, of whose digits the first only."""
        if self.tokens[self.at] == ("sign", "{"):
            return self._bracket("{", "}")
        kind, value = self.tokens[self.at]
        if kind == "number" and value.isdigit():
            self.tokens[self.at : self.at + 1] = [("number", value[0])] + ([("number", value[1:])] if value[1:] else [])
        elif kind == "word":
            self.tokens[self.at : self.at + 1] = [("word", c) for c in value]
        return self.atom()

    def atom(self) -> Ratio:
        kind, value = self.tokens[self.at]
        if kind == "number":
            if len(value) > MOST_DIGITS:
                raise NoExpression("too many digits")
            self.at += 1
            return self._mixed(_ratio(Fraction(value)))
        if value in ("(", "[", "{"):
            return self._bracket(value, {"(": ")", "[": "]", "{": "}"}[value])
        if value == "|":
            raise NoExpression("an absolute value")
        if self._next("frac", "dfrac", "tfrac"):
            top = self._argument()
            return top / self._argument()
        if self._next("sqrt"):
            if self.tokens[self.at] == ("sign", "["):
                raise NoExpression("a root of higher degree")
            written_out = kind == "word" or self.tokens[self.at] == ("sign", "(")
            return square_root(self.atom() if written_out else self._argument())
        if self._next("π", "pi"):
            return _named("pi")
        if self._next("θ", "theta"):
            return _named("theta")
        if kind in ("word", "command") and value in FUNCTIONS:
            self.at += 1
            exponent = self.exponent() if self._next("^", "**") else None
            out = _named(f"{value}({self.power()})")
            return out.power(exponent) if exponent is not None else out
        if kind == "command":
            if value not in GREEK:
                raise NoExpression(value)
            self.at += 1
            return self._indexed(value)
        if kind == "word":
            if value in GREEK:
                self.at += 1
                return self._indexed(value)
            if len(value) > 3:
                raise NoExpression(value)
            # Several letters are as many variables.
            self.tokens[self.at : self.at + 1] = [("word", c) for c in value]
            self.at += 1
            return self._indexed(value[0])
        raise NoExpression(value or "an early end")

    def _indexed(self, name: str) -> Ratio:
        if not self._next("_"):
            return _named(name)
        braces = self._next("{")
        kind, value = self.tokens[self.at]
        if kind not in ("number", "word"):
            raise NoExpression("an index")
        self.at += 1
        if braces:
            self._need("}")
        return _named(f"{name}_{value}")

    def _mixed(self, whole: Ratio) -> Ratio:
        """An integer right before a \\frac of smaller over greater integer is the whole part of a mixed number."""
        if self.tokens[self.at][1] not in ("frac", "dfrac", "tfrac") or whole.number().denominator != 1:
            return whole
        before, tokens = self.at, list(self.tokens)
        part = self.atom().number()
        if part is not None and 0 < part < 1:
            return whole + _ratio(part)
        self.at, self.tokens = before, tokens
        return whole


# ---- answers

_SPACING = re.compile(r"\\left|\\right|\\displaystyle|\\[,;!: ]|~|\$|\\\$")
_WRAPPED = re.compile(r"\\(?:text|textbf|mathrm|mathbf|mbox|rm)\s*\{([^{}]*)\}")
_UNIT = re.compile(r"(?<=[\d)}])\s*\\(?:text|mathrm|mbox)\s*\{[^{}]*\}\s*(?:\^\s*\{?[23]\}?)?\s*$")
_SIGNS = str.maketrans({"−": "-", "–": "-", "×": "*", "·": "*", "⋅": "*", "÷": "/", "⁄": "/", "²": "^2", "³": "^3", "√": "\\sqrt"})


def _clean(text: str) -> str:
    out = re.sub(r"^\s*\\boxed\s*\{(.*)\}\s*$", r"\1", text, flags=re.S)
    out = _UNIT.sub("", _SPACING.sub(" ", out))
    out = re.sub(r"\^\s*\{?\s*\\circ\s*\}?|°|\\degree", "", _WRAPPED.sub(r"\1", out))
    out = re.sub(r"(?<!\d)\d{1,3}(?:,\d{3})+(?!\d)", lambda m: m[0].replace(",", ""), out)
    return out.replace("\\%", "%").translate(_SIGNS).strip().rstrip(".").strip()


def _elements(text: str) -> list[str]:
    """text cut at the commas outside all brackets."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def _plain(text: str) -> str:
    return "text " + re.sub(r"\s", "", text)


def _single(text: str) -> str:
    text = re.sub(r"^\(\s*([A-Za-z])\s*\)$", r"\1", text)
    if re.fullmatch(r"[A-Za-z\s]*", text) and len(text) != 1:
        # Several letters alone are a name, not a product.
        return _plain(text)
    try:
        sides = text.split("=")
        if len(sides) > 2:
            raise NoExpression("several equations")
        if len(sides) == 2 and re.fullmatch(r"\s*[A-Za-z](_\w|\([a-z]\))?\s*", sides[0]):
            return _single(sides[1].strip())
        if len(sides) == 2:
            # An equation is what is zero, up to a factor.
            zero = (_Reader(sides[0]).whole() + -_Reader(sides[1]).whole()).top
            return f"zero {Ratio(_scaled(zero, 1 / _leading(zero)) if zero else {})}"
        return f"value {_Reader(text).whole()}"
    except (NoExpression, RecursionError, ZeroDivisionError):
        return _plain(text)


def canonical(text: str | None) -> str | None:
    """A text that two answers share exactly if they are the same; None for none.

    Values of rational functions and square roots are exact. Tuples and intervals are the same if they have the same brackets and
    elements in order, sets \\{...\\} in any order; of `x = ...` the right side counts, of other equations what they set to zero.
    Units in \\text{} behind a number, degree signs, dollars, spacing commands, thousands' commas and a final full stop are left out; a percentage is
    a hundredth. Several letters alone, what can't be read and what is longer than MOST_CHARS are compared as text without white space.
    """
    if text is None:
        return None
    if len(text) > MOST_CHARS:
        return _plain(text)
    out = _clean(text)
    if m := re.fullmatch(r"\\\{(.*)\\\}", out, flags=re.S):
        return "set " + "; ".join(sorted({_single(x.strip()) for x in _elements(m[1])}))
    inner = out[1:-1]
    if len(out) > 2 and out[0] in "([" and out[-1] in ")]" and len(parts := _elements(inner)) > 1:
        return f"{out[0]}{'; '.join(_single(x.strip()) for x in parts)}{out[-1]}"
    parts = _elements(out)
    return "; ".join(_single(x.strip()) for x in parts)
