"""Makes this package importable by Python workers wherever the driver was started, and keeps intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
import zipfile
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of spark's application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="trajectra-code-")) / "trajectra.zip"
    with zipfile.ZipFile(at, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def new_folder(spark: SparkSession) -> str:
    """A new path that driver and executors share, below spark.checkpoint.dir, or a local one in local mode where that is unset. What
    is there is removed when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    shared = shared or "file://" + tempfile.mkdtemp(prefix="trajectra-")
    path = f"{shared.rstrip('/')}/trajectra-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return


#: Bytes of files that a task reads where rows are dealt to very many tasks: a writer to more than 200 keeps all its rows in memory.
SPLIT_BYTES = 16 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"
_split, _readers, _before = threading.Lock(), Counter(), {}


@contextlib.contextmanager
def small_splits(spark: SparkSession):
    """Files are read in splits of at most SPLIT_BYTES by the jobs inside. The session's setting is back when the last of several threads leaves."""
    session = id(spark._jsparkSession)
    with _split:
        if not _readers[session]:
            _before[session] = spark.conf.get(_SPLIT)
            spark.conf.set(_SPLIT, str(SPLIT_BYTES))
        _readers[session] += 1
    try:
        yield
    finally:
        with _split:
            _readers[session] -= 1
            if not _readers[session]:
                spark.conf.set(_SPLIT, _before.pop(session))


def written(df: DataFrame) -> DataFrame:
    """df as a table that was written once: what reads it neither computes it again nor loses it with an executor."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
