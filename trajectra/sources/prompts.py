"""Prompt tables: reading by extension, splits, several validation sets, normalisation, the overlong filter, images."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_parts, render_prompt, resolve_path

#: Fixed value: the letters of answer options.
LETTERS = "ABCDEFGH"
FORMATS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "orc": "orc", "txt": "text"}


def _listing(spark: SparkSession, path: str) -> list[str] | None:
    """Names of the files of a folder in order; None if path is a file; raises if there is nothing there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(f"{path}: no such file or folder; tables of a remote hub aren't read")
    if fs.getFileStatus(at).isFile():
        return None
    return sorted(n for s in fs.listStatus(at) if not (n := s.getPath().getName()).startswith(("_", ".")))


#: Fixed value: the split that is read if a path names none.
DEFAULT_SPLIT = "train"


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """path, or path@split; without a split, train. A file's or folder's format is told by its extension; a folder
    with several formats raises. A split is the sub-folder or file of that name, or else the rows whose column split
    names it (null: train). A table without either is all train; any other split of it raises."""
    path, _, split = path.rpartition("@") if "@" in path.rsplit("/", 1)[-1] else (path, "", "")
    wanted = split or DEFAULT_SPLIT
    names = _listing(spark, path)
    if names is not None and (own := [n for n in names if n == wanted or n.rsplit(".", 1)[0] == wanted]):
        return _read(spark, f"{path}/{own[0]}", schema)
    df = _read(spark, path, schema)
    if "split" in df.columns:
        return df.where(F.coalesce("split", F.lit(DEFAULT_SPLIT)) == wanted)
    if wanted != DEFAULT_SPLIT:
        raise ValueError(f"{path} has no split {wanted}")
    return df


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    names = _listing(spark, path)
    kinds = {PurePosixPath(n).suffix.lstrip(".") for n in (names if names is not None else [path])}
    if len(kinds) != 1 or not kinds <= set(FORMATS):
        raise ValueError(f"{path}: one known format is needed, found {sorted(kinds)}")
    kind = kinds.pop()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "json":
        reader = reader.option("multiLine", True)
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.format(FORMATS[kind]).load(path)


def validation_sets(spark: SparkSession, paths: list[str], names: list[str] | None = None, read: Callable[[SparkSession, str], DataFrame] = read_table) -> DataFrame:
    """The sets of all non-empty paths in one table with val_name; without names val_set_0, val_set_1, ..."""
    out = None
    for i, path in enumerate(paths):
        if path:
            part = read(spark, path).withColumn("val_name", F.lit(names[i] if names and i < len(names) else f"val_set_{i}"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no validation set")
    return out


def read_template(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def training_prompts(df: DataFrame, marker: str = "<image>") -> DataFrame:
    """question with the marker in front where it lacks it (and lacked_marker), answer, image, and what there is of
    category, source and qid; null ones are left out when written as JSON."""
    lacks = ~F.col("question").contains(marker)
    meta = [c for c in ("category", "source", "qid") if c in df.columns]
    question = F.when(lacks, F.concat(F.lit(marker + "\n"), F.col("question"))).otherwise(F.col("question"))
    return df.select(question.alias("question"), "answer", "image", *meta, lacks.alias("lacked_marker"))


def lettered_options(options: Column) -> Column:
    """'A. first' and so on, eight at most, a line each."""
    return F.array_join(F.transform(F.slice(options, 1, len(LETTERS)), lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), o)), "\n")


def validation_prompts(df: DataFrame, marker: str = "<image>") -> DataFrame:
    """question with marker and options, answer in \\boxed{}."""
    asked = F.when(F.col("question").contains(marker), F.col("question")).otherwise(F.concat(F.lit(marker + "\n"), F.col("question")))
    listed = F.when(F.size("options") > 0, F.concat(asked, F.lit("\n"), lettered_options(F.col("options")))).otherwise(asked)
    boxed = F.when(F.col("answer").contains("\\boxed"), F.col("answer")).otherwise(F.concat(F.lit("\\boxed{"), F.col("answer"), F.lit("}")))
    return df.withColumns({"question": listed, "answer": boxed})


def chat_messages(df: DataFrame, suffix: str = "", base: str = "", question: str = "question") -> DataFrame:
    """messages: one user message whose content is cut at <image> if the row has images, at <video> if it has videos, and plain otherwise; image paths resolved."""
    prompt = render_prompt(F.col(question), suffix)
    plain = F.array(F.struct(F.lit("text").alias("type"), prompt.alias("text")))
    content = F.when(F.size("image") > 0, content_parts(prompt, "<image>", "image")).when(F.size("videos") > 0, content_parts(prompt, "<video>", "video")).otherwise(plain)
    df = df.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))))
    return df.withColumn("image", F.transform("image", lambda p: resolve_path(p, base))).withColumnRenamed("answer", "ground_truth")


#: What opens and closes a turn in a chat prompt.
TURN, TURN_END = "<|im_start|>", "<|im_end|>"


def chat_prompt(messages: Column, answer_next: bool = True) -> Column:
    """The text that a model gets for messages (array of role and content parts): a turn each, image and video parts as
    their marker, and the opening of the assistant's turn."""
    body = lambda m: F.array_join(F.transform(m["content"], lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("<"), p["type"], F.lit(">")))), "")
    turns = F.transform(messages, lambda m: F.concat(F.lit(TURN), m["role"], F.lit("\n"), body(m), F.lit(TURN_END + "\n")))
    return F.concat(F.array_join(turns, ""), F.lit(f"{TURN}assistant\n" if answer_next else ""))


def white_space_tokens(text: Column) -> Column:
    """The default tokenizer, for want of a model's: words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


#: Texts that are encoded at once: an encoding holds pieces, places and masks, many times the text.
ENCODED = 64


def encoded(tokenizer, texts: list[str | None]) -> list[np.ndarray]:
    """The ids of each text, ENCODED texts at a time; only ids are kept."""
    out: list[np.ndarray] = []
    for k in range(0, len(texts), ENCODED):
        out += [np.array(x.ids, np.int64) for x in tokenizer.encode_batch([t or "" for t in texts[k : k + ENCODED]], add_special_tokens=False)]
    return out


def file_tokenizer(path: str) -> Callable[[Column], Column]:
    """A tokenizer for without_overlong from a file of the tokenizers library, which the driver reads and the workers
    get with their code. No special tokens are added; a null text has no ids."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(spec)
        for texts in batches:
            yield pd.Series(encoded(made, texts.tolist()), dtype=object)

    return lambda text: ids(text)


def without_overlong(df: DataFrame, most: int, text: str | Column = "question", tokenize: Callable[[Column], Column] = white_space_tokens) -> DataFrame:
    """Rows of at most most tokens. tokenize may be a pandas UDF; its result is made once, as n_tokens."""
    return df.withColumn("n_tokens", F.size(tokenize(F.col(text) if isinstance(text, str) else text))).where(F.col("n_tokens") <= most)


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_size(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Width and height from the header of PNG, GIF and JPEG bytes; nulls for others."""
    for batch in contents:
        yield pd.DataFrame([_size(bytes(c or b"")) for c in batch], columns=["width", "height"], dtype="Int32")


def _size(data: bytes) -> tuple[int | None, int | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8":
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    f = io.BytesIO(data)
    if f.read(2) == b"\xff\xd8":
        while len(mark := f.read(4)) == 4 and mark[0] == 255:
            size = int.from_bytes(mark[2:], "big")
            body = f.read(size - 2)
            if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
    return None, None


def image_bytes(df: DataFrame, column: str, base: str, files: DataFrame | None = None) -> DataFrame:
    """content of images that are given as a path; files is a binaryFile table of path and content. Bytes and
    struct<bytes> columns pass as they are."""
    kind = dict(df.dtypes)[column]
    if kind == "binary":
        return df.withColumn("content", F.col(column))
    if kind.startswith("struct"):
        return df.withColumn("content", F.col(f"{column}.bytes"))
    at = F.regexp_replace(F.col("path"), "^file:/+", "/")
    return df.withColumn("__p", resolve_path(F.col(column), base)).join(files.select(at.alias("__p"), "content"), "__p", "left").drop("__p")
