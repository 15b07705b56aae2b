"""Session helpers: where shared intermediate tables go and how they are cut.

Lineage is cut by writing Parquet into the folder that ``spark.checkpoint.dir``
names (all executors share it).  Only where that setting is missing and the
master is local, as in tests, a local folder is created and set.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("threadloom")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; set to a fresh one only where unset and everything runs on one machine."""
    at = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set(_KEY, at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder, removed when Python ends."""
    path = f"{shared_dir(spark)}/threadloom-{os.getpid()}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor costs nothing, as the files outlive it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file system API (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the intermediate tables written inside the block when it is left, so a long session doesn't fill the shared folder.

    Results must have been written or collected by then.
    """
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            delete_path(*_written.pop())


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone by now
            pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
