"""What the corpus operators share: tables, materialised intermediate results, heavy keys."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: A key with more than 1/HEAVY_SHARE of the rows, or more than HEAVY_ROWS, is heavy: there are fewer than HEAVY_SHARE
#: such keys, or than one for each HEAVY_ROWS rows, and none of the others gives a task more than HEAVY_ROWS.
HEAVY_SHARE, HEAVY_ROWS = 1000, 1_000_000

_written: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Workers find this package, and get whole texts in small batches, so that their memory doesn't grow with long ones."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        # The session's own bound stays if it is lower.
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where spark.checkpoint.dir is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir()
    if found and not isinstance(found, str):
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trajectra-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/trajectra/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _busy, _before = threading.Lock(), Counter(), {}


@contextlib.contextmanager
def _shuffles_end_with_their_job(spark: SparkSession):
    """What the jobs inside shuffle isn't needed once their result is written. The session's setting is back when the last of several threads leaves."""
    session = id(spark._jsparkSession)
    with _lock:
        if not _busy[session]:
            _before[session] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _busy[session] += 1
    try:
        yield
    finally:
        with _lock:
            _busy[session] -= 1
            if not _busy[session]:
                spark.conf.set(_CLEANUP, _before.pop(session))


_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_few = threading.Lock()


@contextlib.contextmanager
def _batches_of(spark: SparkSession, records: int | None):
    """Arrow batches of at most so many rows for the jobs inside, one such job at a time."""
    if records is None:
        yield
        return
    with _few:
        before = spark.conf.get(_RECORDS)
        spark.conf.set(_RECORDS, str(records))
        try:
            yield
        finally:
            spark.conf.set(_RECORDS, before)


def materialise(df: DataFrame, name: str, path: str | None = None, records: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it from there: later jobs neither recompute it nor lose it with an executor.
    records: rows of an Arrow batch at most, where rows are large."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession, name)
    prepare(spark)
    with _shuffles_end_with_their_job(spark), _batches_of(spark, records):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what materialise returned and nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows left-joined to classes (unique by keys). The heavy classes (see HEAVY_SHARE) are broadcast, so that their
    rows stay where they are; the others are joined by an ordinary shuffle join in which no key is hot."""
    limit = max(1, min(total // HEAVY_SHARE, HEAVY_ROWS))
    wide = [c for c in classes.columns if c not in keys]
    heavy = classes.where(F.col(size) > limit)
    light = classes.where(F.col(size) <= limit)
    renamed = heavy.select([F.col(k).alias(f"__h_{k}") for k in keys] + [F.col(c).alias(f"__h_{c}") for c in wide])
    same = _and([F.col(k) == F.col(f"__h_{k}") for k in keys])
    marked = rows.join(F.broadcast(renamed), same, "left").drop(*[f"__h_{k}" for k in keys])
    hot = F.col(f"__h_{size}").isNotNull()
    # A row that has its class already gets a key that joins nothing, spread by the row's own values.
    lone = {f"__k_{k}": F.when(~hot, F.col(k)) for k in keys}
    spread = F.when(hot, F.xxhash64(*[F.col(c) for c in rows.columns if not dict(rows.dtypes)[c].startswith(("map", "binary"))][:3]))
    marked = marked.withColumns(lone | {"__k_spread": spread})
    light = light.select([F.col(k).alias(f"__l_{k}") for k in keys] + [F.col(c).alias(f"__l_{c}") for c in wide] + [F.lit(None).cast("long").alias("__l_spread")])
    same = _and([F.col(f"__k_{k}").eqNullSafe(F.col(f"__l_{k}")) for k in keys] + [F.col("__k_spread").eqNullSafe(F.col("__l_spread"))])
    joined = marked.join(light, same, "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__l_{c}")).alias(c) for c in wide])


def _and(terms: list[Column]) -> Column:
    out = terms[0]
    for x in terms[1:]:
        out = out & x
    return out
