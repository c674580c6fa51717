"""Templates against values that are worked out beside them, in plain Python, for random templates and rows."""

import random

import pytest
from pyspark.sql import functions as F

from trajectra.functions.template import TemplateError, compile_template, render

ROWS = [
    ("  a b ", 3, ["x", "", "y"], {"name": "N", "size": 0}, True),
    ("", 0, [], {"name": None, "size": 7}, False),
    (None, None, None, None, None),
    ("É{{no}}%", -12, ["é", None], {"name": "", "size": None}, True),
]
SCHEMA = "s string, n long, l array<string>, r struct<name:string,size:int>, b boolean"


def text(x):
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def field(row, name):
    return None if row["r"] is None else row["r"][name]


#: Value expressions with what they are for a row.
VALUES = [
    ("s", lambda r: r["s"]),
    ("n", lambda r: r["n"]),
    ("b", lambda r: r["b"]),
    ("r.name", lambda r: field(r, "name")),
    ("r.size", lambda r: field(r, "size")),
    ("s | trim", lambda r: text(r["s"]).strip()),
    ("s|trim|upper", lambda r: text(r["s"]).strip().upper()),
    ("s | lower | replace('a', \"--\")", lambda r: text(r["s"]).lower().replace("a", "--")),
    ("s | default('none')", lambda r: "none" if r["s"] is None else r["s"]),
    ("s | length", lambda r: len(r["s"] or "")),
    ("l | length", lambda r: len(r["l"] or [])),
    ("l | join('+')", lambda r: None if r["l"] is None else "+".join(text(x) for x in r["l"])),
    ("l | first", lambda r: r["l"][0] if r["l"] else None),
    ("l | last | default('?')", lambda r: "?" if not r["l"] or r["l"][-1] is None else r["l"][-1]),
    ("'it\\'s'", lambda r: "it's"),
    ("12", lambda r: 12),
    ("n == 3", lambda r: r["n"] == 3),
    ("s != ''", lambda r: r["s"] != ""),
    ("l", None),
]


def condition(rng, depth=0):
    kind = rng.randrange(5 if depth < 2 else 2)
    if kind < 2:
        source, value = rng.choice([("l", lambda r: r["l"]) if v is None else (s, v) for s, v in VALUES])
        return (f"({source})" if rng.random() < 0.3 else source), lambda r: bool(value(r))
    a, f = condition(rng, depth + 1)
    if kind == 2:
        return f"not ({a})", lambda r: not f(r)
    b, g = condition(rng, depth + 1)
    if kind == 3:
        return f"({a}) and ({b})", lambda r: f(r) and g(r)
    return f"({a}) or ({b})", lambda r: f(r) or g(r)


def body(rng, depth=0):
    parts, makers = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.randrange(5 if depth < 2 else 2)
        if kind == 0:
            words = rng.choice(["x", " \n", "{ % }", "$1 \\n", "é"])
            parts.append(words)
            makers.append(lambda r, w=words: w)
        elif kind == 1:
            source, value = rng.choice(VALUES[:-1])
            parts.append("{{ " + source + " }}")
            makers.append(lambda r, v=value: text(v(r)))
        elif kind == 2:
            (c, held), (a, f), (b, g) = condition(rng), body(rng, depth + 1), body(rng, depth + 1)
            parts.append("{% if " + c + " %}" + a + "{% else %}" + b + "{% endif %}")
            makers.append(lambda r, held=held, f=f, g=g: f(r) if held(r) else g(r))
        elif kind == 3:
            (c, h), (e, k), (a, f), (b, g) = condition(rng), condition(rng), body(rng, depth + 1), body(rng, depth + 1)
            parts.append("{% if " + c + " %}" + a + "{% elif " + e + " %}" + b + "{% endif %}")
            makers.append(lambda r, h=h, k=k, f=f, g=g: f(r) if h(r) else g(r) if k(r) else "")
        else:
            a, f = body(rng, depth + 1)
            parts.append("{% for s in l %}{{ loop.index }}" + a + "{% if not loop.last %},{% endif %}{% endfor %}")
            makers.append(lambda r, f=f: ",".join(f"{i + 1}{f({**r, 's': x})}" for i, x in enumerate(r["l"] or [])))
    return "".join(parts), lambda r: "".join(m(r) for m in makers)


def test_random_templates_give_what_plain_python_gives(spark):
    rng = random.Random(5)
    made = [body(rng) for _ in range(60)]
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    got = df.select(*[compile_template(t + "|", df.schema).alias(f"t{i}") for i, (t, _) in enumerate(made)]).collect()
    names = ("s", "n", "l", "r", "b")
    for row, out in zip(ROWS, got):
        for i, (source, want) in enumerate(made):
            assert out[f"t{i}"] == want(dict(zip(names, row))) + "|", source


def test_white_space_control_and_comments(spark):
    df = spark.range(1).withColumn("s", F.lit("v"))
    for source, want in (("a {{- s -}} b\n", "avb"), ("{# no #}a\n\n", "a\n"), ("{%- if s -%} x {%- endif -%}\n", "x"), ("", "")):
        assert render(df, source).first()["prompt"] == want


@pytest.mark.parametrize("source", ["{{ q }}", "{{ r.q }}", "{{ s.q }}", "{{ s | q }}", "{{ l }}", "{{ s", "{% if s %}", "{% for x in s %}{% endfor %}", "{% endif %}", "{{ s s }}", "{{ }}", "{% if %}x{% endif %}", "{{ s | replace('a') }}", "{{ s + 1 }}", "{% set x = 1 %}"])
def test_what_cannot_be_read_raises_before_any_row(spark, source):
    with pytest.raises(TemplateError):
        compile_template(source, spark.createDataFrame([], SCHEMA).schema)
