"""Prompt templates as column expressions: {{ name | filter }}, {% if %}, {% for %}, compiled against a schema."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE

Typed = tuple[Column, T.DataType]

_CUT = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_WORD = re.compile(r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\d+|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|==|!=|\||\(|\)|,)""")


class TemplateError(ValueError):
    """The template can't be read, or asks for what the table hasn't."""


def _text(x: Typed) -> Column:
    """As it is printed: null as nothing, numbers and truth values as Spark casts them."""
    if isinstance(x[1], (T.ArrayType, T.MapType, T.StructType)):
        raise TemplateError("a nested value can't be printed; join it or name a field")
    return F.coalesce(x[0].cast("string"), F.lit(""))


def _true(x: Typed) -> Column:
    """Null, an empty text or list, zero and false don't hold."""
    c, kind = x
    if isinstance(kind, T.BooleanType):
        held = c
    elif isinstance(kind, T.StringType):
        held = c != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        held = F.size(c) > 0
    elif isinstance(kind, T.NumericType):
        held = c != 0
    else:
        held = c.isNotNull()
    return F.coalesce(held, F.lit(False))


def _listed(x: Typed) -> Column:
    if not isinstance(x[1], T.ArrayType):
        raise TemplateError("a list is needed here")
    return x[0]


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\A{SPACE}", ""), rf"{SPACE}\z", "")


def _length(x: Typed) -> Typed:
    size = F.size(x[0]) if isinstance(x[1], (T.ArrayType, T.MapType)) else F.length(_text(x))
    return F.when(x[0].isNotNull(), size).otherwise(0), T.IntegerType()


def _join(x: Typed, by: str = "") -> Typed:
    kind = _listed(x) is not None and x[1].elementType
    return F.array_join(F.transform(x[0], lambda e: _text((e, kind))), by), T.StringType()


#: Filters by name: a typed value and literal arguments to a typed value.
FILTERS: dict[str, Callable[..., Typed]] = {
    "trim": lambda x: (_trim(_text(x)), T.StringType()),
    "upper": lambda x: (F.upper(_text(x)), T.StringType()),
    "lower": lambda x: (F.lower(_text(x)), T.StringType()),
    "length": _length,
    "join": _join,
    "first": lambda x: (F.get(_listed(x), F.lit(0)), x[1].elementType),
    "last": lambda x: (F.get(_listed(x), F.size(x[0]) - 1), x[1].elementType),
    "default": lambda x, other: (F.coalesce(x[0].cast("string"), F.lit(other)), T.StringType()),
    "replace": lambda x, old, new: (F.replace(_text(x), F.lit(old), F.lit(new)), T.StringType()),
}


class _Expression:
    """not, and, or, ==, != over values with filters; arguments of filters are literals."""

    def __init__(self, source: str, names: dict[str, Typed]):
        self.words, self.at, self.names, at = [], 0, names, 0
        source = source.rstrip()
        while at < len(source):
            found = _WORD.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.words.append(found[1])
            at = found.end()

    def _next(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def _take(self, word: str) -> bool:
        if self._next() == word:
            self.at += 1
            return True
        return False

    def _need(self, word: str) -> None:
        if not self._take(word):
            raise TemplateError(f"{word!r} is missing in {' '.join(self.words)!r}")

    def whole(self) -> Typed:
        out = self._either()
        if self._next() is not None:
            raise TemplateError(f"can't read {self._next()!r} in {' '.join(self.words)!r}")
        return out

    def _either(self) -> Typed:
        out = self._both()
        while self._take("or"):
            out = _true(out) | _true(self._both()), T.BooleanType()
        return out

    def _both(self) -> Typed:
        out = self._negated()
        while self._take("and"):
            out = _true(out) & _true(self._negated()), T.BooleanType()
        return out

    def _negated(self) -> Typed:
        if self._take("not"):
            return ~_true(self._negated()), T.BooleanType()
        left = self._value()
        for sign in ("==", "!="):
            if self._take(sign):
                right = self._value()
                alike = isinstance(left[1], T.NumericType) and isinstance(right[1], T.NumericType)
                same = left[0].eqNullSafe(right[0]) if alike or left[1] == right[1] else F.lit(False)
                return (same if sign == "==" else ~same), T.BooleanType()
        return left

    def _value(self) -> Typed:
        if self._take("("):
            out = self._either()
            self._need(")")
        else:
            out = self._atom()
        while self._take("|"):
            name, given = self._next(), []
            self.at += 1
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            if self._take("("):
                while not self._take(")"):
                    given.append(self._literal())
                    self._take(",")
            try:
                out = FILTERS[name](out, *given)
            except TypeError as e:
                raise TemplateError(f"filter {name} doesn't take {len(given)} arguments") from e
        return out

    def _literal(self) -> str | int:
        word = self._next()
        if word is None or not (word[0] in "'\"" or word.isdigit()):
            raise TemplateError(f"a literal is needed, not {word!r}")
        self.at += 1
        return int(word) if word.isdigit() else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1])

    def _atom(self) -> Typed:
        word = self._next()
        if word is None or word in ("|", ")", ",", "==", "!=", "and", "or"):
            raise TemplateError(f"a value is missing in {' '.join(self.words)!r}")
        if word[0] in "'\"" or word.isdigit():
            value = self._literal()
            return F.lit(value), T.StringType() if isinstance(value, str) else T.IntegerType()
        self.at += 1
        head, *path = word.split(".")
        if head not in self.names:
            raise TemplateError(f"unknown name {head}")
        c, kind = self.names[head]
        for field in path:
            if not isinstance(kind, T.StructType) or field not in kind.names:
                raise TemplateError(f"unknown field {field} of {head}")
            c, kind = c[field], kind[field].dataType
        return c, kind


def _pieces(template: str) -> list[tuple[str, str]]:
    """(text | value | tag, content). A dash takes the white space on its side away; so does the end of the template with one line feed."""
    out: list[tuple[str, str]] = []
    strip = False
    for piece in _CUT.split(template.removesuffix("\n")):
        if not _CUT.fullmatch(piece):
            if opened := re.search(r"\{[{%#]", piece):
                raise TemplateError(f"{piece[opened.start():]!r} isn't closed")
            out.append(("text", piece.lstrip() if strip else piece))
            strip = False
            continue
        if piece.startswith("{#"):
            continue
        body = piece[2:-2]
        if body.startswith("-"):
            body = body[1:]
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1].rstrip())
        if strip := body.endswith("-"):
            body = body[:-1]
        out.append(("value" if piece.startswith("{{") else "tag", body.strip()))
    return out


class _Compiler:
    def __init__(self, template: str):
        self.pieces, self.at = _pieces(template), 0

    def body(self, names: dict[str, Typed], until: tuple[str, ...]) -> tuple[Column, str]:
        """The text up to one of the tags of until, and that tag; until empty: to the end."""
        parts: list[Column] = []
        while self.at < len(self.pieces):
            kind, content = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                parts.append(F.lit(content))
            elif kind == "value":
                parts.append(_text(_Expression(content, names).whole()))
            else:
                word, _, rest = content.partition(" ")
                if word in until:
                    return F.concat(F.lit(""), *parts), content
                if word == "if":
                    parts.append(self._choice(rest, names))
                elif word == "for":
                    parts.append(self._loop(rest, names))
                else:
                    raise TemplateError(f"unknown or misplaced tag {content!r}")
        if until:
            raise TemplateError(f"{until[-1]} is missing")
        return F.concat(F.lit(""), *parts), ""

    def _choice(self, condition: str, names: dict[str, Typed]) -> Column:
        held = _true(_Expression(condition, names).whole())
        then, end = self.body(names, ("elif", "else", "endif"))
        if end.startswith("elif"):
            other = self._choice(end[4:], names)
        elif end == "else":
            other, _ = self.body(names, ("endif",))
        else:
            other = F.lit("")
        return F.when(held, then).otherwise(other)

    def _loop(self, head: str, names: dict[str, Typed]) -> Column:
        found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", head, re.S)
        if not found:
            raise TemplateError(f"can't read for {head!r}")
        items = _Expression(found[2], names).whole()
        listed, start, ends = _listed(items), self.at, []

        def each(x: Column, i: Column) -> Column:
            self.at = start
            place = T.StructType([T.StructField(n, T.BooleanType() if n in ("first", "last") else T.IntegerType()) for n in ("index", "index0", "first", "last", "length")])
            loop = F.struct((i + 1).alias("index"), i.alias("index0"), (i == 0).alias("first"), (i + 1 == F.size(listed)).alias("last"), F.size(listed).alias("length"))
            text, _ = self.body({**names, found[1]: (x, items[1].elementType), "loop": (loop, place)}, ("endfor",))
            ends.append(self.at)
            return text

        out = F.coalesce(F.array_join(F.transform(listed, each), ""), F.lit(""))
        self.at = ends[-1]
        return out


def compile_template(template: str, schema: T.StructType) -> Column:
    """The template as one expression over columns of schema. Unknown names, fields, filters and tags raise TemplateError here, before any
    row is read. Nulls are printed as nothing and don't hold in conditions; a null list is an empty one."""
    names: dict[str, Typed] = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in schema}
    return _Compiler(template).body(names, ())[0]


def render(df: DataFrame, template: str, into: str = "prompt") -> DataFrame:
    return df.withColumn(into, compile_template(template, df.schema))
