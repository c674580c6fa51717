"""A log of numbered commits in a folder of any file system that Spark reads.

A commit is a file that is written whole under another name and then gets its number, if nobody has that number yet. A
reader takes the highest number whose record is whole and whose data is there, so whoever dies at whatever step
leaves the commit before in force, and of two who commit after the same one, one wins.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: Digits of a commit's number, so that names stand in the order of numbers.
DIGITS = 20


class Conflict(RuntimeError):
    """Somebody else has made the commit of that number."""


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(spark: SparkSession, at: str, text: str) -> None:
    path, fs = _path(spark, at)
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _publish(spark: SparkSession, made: str, name: str) -> None:
    """Give the file made its name, unless there is one of that name."""
    source, fs = _path(spark, made)
    target, _ = _path(spark, name)
    if fs.getUri().getScheme() == "file":
        # A local file system renames over what is there; a second link to a file can't be made under a name that is taken.
        local = [unquote(urlparse(x).path) if "://" in x or x.startswith("file:") else x for x in (made, name)]
        try:
            os.link(*local)
        except FileExistsError as e:
            raise Conflict(name) from e
        fs.delete(source, False)
        return
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(source, target, none)
    except Exception as e:  # noqa: BLE001  a Java error of one of several kinds
        if fs.exists(target):
            raise Conflict(name) from e
        raise


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the commits there are, highest first."""
    path, fs = _path(spark, f"{folder}/commits")
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return sorted((int(x[:DIGITS]) for x in names if x.endswith(".json") and x[:DIGITS].isdigit()), reverse=True)


def _record(spark: SparkSession, folder: str, number: int) -> dict | None:
    """The record of a commit, or None where it isn't whole or its data isn't there."""
    path, fs = _path(spark, f"{folder}/commits/{number:0{DIGITS}}.json")
    stream = fs.open(path)
    try:
        raw = bytes(stream.readAllBytes())
    finally:
        stream.close()
    try:
        found = json.loads(raw)
    except ValueError:
        return None
    data, fs = _path(spark, f"{folder}/{found['data']}/_SUCCESS")
    return found if fs.exists(data) else None


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The record in force, with its number and data, a folder below this one; None if there is none."""
    return next((found for n in numbers(spark, folder) if (found := _record(spark, folder, n))), None)


def commit(state: DataFrame, folder: str, name: str, record: dict, after: int | None = None) -> dict:
    """Write state to a folder of that name in a new folder below folder/attempts, and make a commit of it with the fields of record.

    after: the number of the commit that this one follows, as the writer knows it, -1 for none; by default the highest there is. Raises
    Conflict if another has followed it. Data of attempts that weren't committed stays until retention removes its folder.
    """
    spark = state.sparkSession
    after = next(iter(numbers(spark, folder)), -1) if after is None else after
    data = f"attempts/{uuid.uuid4().hex}/{name}"
    state.write.parquet(f"{folder}/{data}")
    made = {**record, "number": after + 1, "data": data}
    temporary = f"{folder}/commits/.{uuid.uuid4().hex}"
    _write(spark, temporary, json.dumps(made))
    _publish(spark, temporary, f"{folder}/commits/{after + 1:0{DIGITS}}.json")
    return made
