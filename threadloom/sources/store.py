"""Where results go and come back from: reports, the file index, mined artefacts, donations."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import delete_path

_ID = "^[A-Za-z0-9_-]{8,32}$"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_report(report: DataFrame, root: str, report_id: str) -> str:
    """Write a one-row report as JSON below ``root``; a report of that id must not be there yet."""
    if not re.match(_ID, report_id):
        raise ValueError(f"not an id of a report: {report_id!r}")
    path = f"{root}/{report_id}.json"
    report.coalesce(1).write.mode("errorifexists").json(path)
    return path


def list_reports(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All reports of the schema (with id and createdAt), newest first; files that are no JSON object or bear a bad id are passed over."""
    p, fs = _path(spark, root)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("recursiveFileLookup", "true").text(root).where(F.try_parse_json("value").isNotNull())
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*").where(F.col("id").rlike(_ID)).orderBy(F.desc("createdAt"), "id")


def load_report(spark: SparkSession, root: str, report_id: str, schema: str) -> DataFrame:
    """The report of an id, no row if there is none or the id is none."""
    return list_reports(spark, root, schema).where((F.col("id") == report_id) & F.lit(report_id).rlike(_ID))


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The saved index of files already read, empty if there is none."""
    p, fs = _path(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def write_index(index: DataFrame, path: str) -> None:
    """Put an index in the place of the saved one; readers see the old or the new one, never half of one."""
    spark = index.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex[:12]}.tmp"
    index.write.parquet(fresh)
    old, fs = _path(spark, path)
    new, _ = _path(spark, fresh)
    if fs.exists(old):
        delete_path(spark, path)
    if not fs.rename(new, old):
        raise OSError(f"could not put {fresh} in the place of {path}")


def write_artifact(found: DataFrame, path: str) -> None:
    """A mined result, small by its limit, as one JSON file."""
    found.coalesce(1).write.mode("overwrite").json(path)


def write_donation(sealed: DataFrame, root: str, report_id: str) -> str:
    """Write a sealed donation of its own; it must not be there yet."""
    return save_report(sealed, root, report_id)
