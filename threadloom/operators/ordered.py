"""Order inside sessions without a task per session.

A session may hold a third of all rows.  ``ranked`` numbers its rows in two
levels (inside chunks, then over one row per chunk); ``with_halo`` copies the few
rows a bounded frame needs into the neighbouring chunk, so that windows are
partitioned by (session_id, chunk) and no group has more than CHUNK + halo rows;
``running`` computes running sums and last values the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.session import materialize

CHUNK = 4096
_KEY = ["session_id", "chunk"]


def session_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def canonical(records: DataFrame, with_blocks: bool = True, in_order: bool = True) -> DataFrame:
    """Transcript records as rows, one per message, in order unless only sums are asked for.

    Rows without a session are left out, of one uuid the row with the least
    rec_id stays (a null uuid is a message of its own); ``i`` numbers a session's
    rows from 0 by record index, rows without one last, by time and arrival.
    """
    rows = records.where("session_id is not null")
    repeated = rows.where("uuid is not null").groupBy("uuid").agg(F.min("rec_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(repeated, "uuid", "left").where("first_id is null or first_id = rec_id")
    cols = [
        session_key(F.col("session_id")).alias("session_id"), "rec_id", "uuid", "agent", F.col("rec_type").alias("type"), "ts",
        F.col("record_index").cast("long").alias("record_index"), F.coalesce("is_meta", F.lit(False)).alias("is_meta"),
        F.coalesce("is_api_error", F.lit(False)).alias("is_api_error"), F.coalesce("is_replay", F.lit(False)).alias("is_replay"),
        "cwd", "subtype", F.col("content").alias("sys_content"), F.col("message.model").alias("model"), F.col("message.id").alias("message_id"),
        F.col("message.usage").alias("usage"), T.visible_text().alias("text"),
    ]
    if with_blocks:
        cols.append(F.col("message.content").alias("blocks"))
    return ranked(rows.select(*cols)) if in_order else rows.select(*cols)


def ranked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows with ``i``, their exact rank in the session from 0."""
    part = F.when(F.col("record_index").isNotNull(), F.expr(f"record_index div {chunk}")).otherwise(
        F.lit(1 << 40) + F.coalesce(F.expr("unix_seconds(cast(ts as timestamp)) div 600"), F.lit(1 << 40))
    )
    rows = rows.withColumn("__part", part)
    inside = Window.partitionBy("session_id", "__part").orderBy(F.col("record_index").asc_nulls_last(), F.col("ts").asc_nulls_last(), "rec_id")
    before = Window.partitionBy("session_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy("session_id", "__part").agg(F.count("*").alias("n")).select("session_id", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return rows.withColumn("__rn", F.row_number().over(inside)).join(start, ["session_id", "__part"]).withColumn(
        "i", F.col("__start") + F.col("__rn") - 1
    ).drop("__part", "__rn", "__start")


def with_halo(rows: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """rows(session_id, i, ...) with ``chunk`` and ``own``; a chunk also holds the ``before`` rows ahead of it and the ``after`` rows behind."""
    c, r = F.expr(f"i div {chunk}"), F.expr(f"i % {chunk}")
    copies = F.array_compact(F.array(
        F.struct(c.alias("chunk"), F.lit(True).alias("own")),
        F.when(r >= chunk - before, F.struct((c + 1).alias("chunk"), F.lit(False).alias("own"))),
        F.when((r < after) & (c > 0), F.struct((c - 1).alias("chunk"), F.lit(False).alias("own"))),
    ))
    return rows.select("*", F.inline(copies))


def frame(first: int, last: int):
    """The rows from ``first`` to ``last`` around a row, inside a chunk with halo."""
    return Window.partitionBy(*_KEY).orderBy("i").rowsBetween(first, last)


def running(rows: DataFrame, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, chunk: int = CHUNK) -> DataFrame:
    """rows(session_id, i, ...) with running sums and last non-null values, up to and with the row."""
    rows = rows.withColumn("chunk", F.expr(f"i div {chunk}"))
    inside = Window.partitionBy(*_KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("session_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums, lasts = sums or {}, lasts or {}
    for k, v in (sums | lasts).items():
        rows = rows.withColumn(k, v)
    ends = rows.groupBy(*_KEY).agg(
        *(F.sum(k).alias(k) for k in sums), *(F.max(F.when(F.col(k).isNotNull(), F.struct("i", k)))[k].alias(k) for k in lasts)
    )
    carried = ends.select(*_KEY, *(F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"__{k}") for k in sums), *(F.last(k, True).over(over).alias(f"__{k}") for k in lasts))
    out = rows.withColumns({k: F.sum(k).over(inside) for k in sums} | {k: F.last(k, True).over(inside) for k in lasts})
    return out.join(carried, _KEY).withColumns(
        {k: F.coalesce(k, F.lit(0)) + F.col(f"__{k}") for k in sums} | {k: F.coalesce(k, f"__{k}") for k in lasts}
    ).drop("chunk", *(f"__{k}" for k in sums | lasts))


def cumulative(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """counts(*by, value, n), one row per value -> with ``upto``, the sum of n over the group's values not above it.

    Values are range-partitioned and written; each range is summed by itself and
    only one row per group and range is carried over, so continuous values need no
    task that sees them all.
    """
    spread = counts.repartitionByRange(*by, value).withColumn("__cell", F.spark_partition_id())
    spread = materialize(spread, "values")
    inside = Window.partitionBy(*by, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.groupBy(*by, "__cell").agg(F.sum(n).alias("__n")).select(*by, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = spread.withColumn("upto", F.sum(n).over(inside)).join(carried, [*by, "__cell"])
    return out.withColumn("upto", F.col("upto") + F.col("__before")).drop("__cell", "__before")
