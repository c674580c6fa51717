"""Text features of responses and prompts, as column expressions; the answer grader is the one Python function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .answers import canonical

#: Fixed value: what Unicode-aware engines count as white space, with the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]*"


def normalise_tags(text: Column) -> Column:
    """Without white space around <, > and /."""
    return F.regexp_replace(text, rf"{SPACE}(<|>|/){SPACE}", "$1")


def format_score(text: Column) -> Column:
    """1.0 if the whole text is <think>...</think>...\\boxed{...}..., else 0.0; null counts as no match."""
    return F.coalesce(text.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double"), F.lit(0.0))


def last_boxed(text: str | None) -> str | None:
    """The content of the last \\boxed{...} whose braces balance."""
    for m in reversed(list(re.finditer(r"\\boxed\s*\{", text or ""))):
        depth = 1
        for i in range(m.end(), len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                return text[m.end() : i]
    return None


def grade(response: str | None, truth: str | None) -> float:
    """1.0 if the response's last boxed answer is the truth, which may be boxed itself, by the rules of answers.canonical."""
    got, want = canonical(last_boxed(response)), canonical(last_boxed(truth) or truth)
    return float(got is not None and got == want)


@F.pandas_udf(T.StringType())
def answer_form(answers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The form that equal answers share: a key to group or join answers by. Of a text with a box the box counts; null stays null."""
    for texts in answers:
        yield pd.Series([canonical(last_boxed(t) or t) for t in texts], dtype="object")


@F.pandas_udf(T.DoubleType())
def accuracy_score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for responses, truths in pairs:
        yield pd.Series([grade(r, t) for r, t in zip(responses, truths)], dtype="float64")


def render_prompt(question: Column, suffix: str) -> Column:
    return F.concat(F.trim(question), F.lit(suffix))


def content_parts(prompt: Column, marker: str, kind: str) -> Column:
    """array<struct<type, text>>: the prompt cut at every marker, a part of that kind between the pieces, empty texts left out."""
    pieces = F.split(prompt, re.escape(marker))
    mark = F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text"))
    each = F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, F.array(mark)).otherwise(F.array().cast("array<struct<type:string,text:string>>")), F.when(p != "", F.array(F.struct(F.lit("text").alias("type"), p.alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))))
    return F.flatten(each)


def resolve_path(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
