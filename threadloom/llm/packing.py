"""Filling fixed-capacity containers (problem 7) by bounded-space online packing.

Each partition keeps a fixed number of open windows, places every item where it
leaves the least room, and emits the fullest window when none fits.  The windows
still open at the end are merged across partitions in a tree: a group merges the
windows of MERGE_FAN_IN partitions and hands on its emptiest OPEN_WINDOWS ones, so
no group of any level has more than MERGE_FAN_IN x OPEN_WINDOWS windows.  Pieces
that fill a container by themselves need no packing and meet no group.

Defined results: an item above the capacity is split into full pieces and one
rest, no other item is split; items without tokens (null, empty texts) need no
room and are left out; equal items go by ``doc_id``; a null or non-positive
capacity packs nothing; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialize

OPEN_WINDOWS = 64
ITEMS_PER_PARTITION = 100_000
#: Partitions whose leftovers meet in one task of the merging tree.
MERGE_FAN_IN = 32
#: Kinds of containers are parameters; more than this is refused.
MAX_KINDS = 1000
_GROUP = ["container_kind", "part"]


def pack_online(sizes: list[int], capacity: int, open_windows: int = OPEN_WINDOWS) -> tuple[list[int], dict[int, int]]:
    """(window of each item, used room of the windows left open)."""
    free: list[tuple[int, int]] = []  # (room left, window), ascending
    out, n = [], 0
    for size in sizes:
        i = bisect_left(free, (size, -1))
        if i < len(free):
            room, w = free.pop(i)
        else:
            if len(free) >= open_windows:
                free.pop(0)  # the fullest
            room, w = capacity, n
            n += 1
        out.append(w)
        if room - size:
            insort(free, (room - size, w))
    return out, {w: capacity - room for room, w in free}


def pack_offline(sizes: list[int], capacity: int) -> list[int]:
    """Window of each item by best fit, largest items first (ties in order)."""
    free: list[tuple[int, int]] = []
    out, n = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(free, (sizes[i], -1))
        if k < len(free):
            room, w = free.pop(k)
        else:
            room, w, n = capacity, n, n + 1
        out[i] = w
        insort(free, (room - sizes[i], w))
    return out


def pack(sizes: DataFrame, containers: DataFrame, open_windows: int = OPEN_WINDOWS, per_partition: int = ITEMS_PER_PARTITION, fan_in: int = MERGE_FAN_IN) -> DataFrame:
    """sizes(doc_id, n_tokens), containers(container_kind, capacity_tokens) ->
    (container_kind, container_id, doc_id, piece_no, start_token, n_tokens, capacity_tokens)."""
    kinds = containers.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long")).limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    sizes = materialize(sizes.where("n_tokens > 0").select("doc_id", "n_tokens"), "pack-sizes")
    parts = max(1, -(-sizes.count() // per_partition))
    if not kinds:
        kinds_col = F.expr("cast(array() as array<struct<container_kind:string,capacity_tokens:bigint>>)")
    else:
        kinds_col = F.array(*(F.struct(F.lit(k[0]).alias("container_kind"), F.lit(k[1]).alias("capacity_tokens")) for k in kinds))
    items = sizes.select("doc_id", F.col("n_tokens").alias("whole"), F.inline(kinds_col))
    full = items.where("whole >= capacity_tokens").select(
        "container_kind", "doc_id", F.explode(F.expr("sequence(0L, whole div capacity_tokens - 1)")).alias("piece_no"), F.col("capacity_tokens").alias("n_tokens"), "capacity_tokens"
    ).withColumn("container_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece_no"))
    rests = items.where("whole % capacity_tokens > 0").select(
        "container_kind", "capacity_tokens", F.expr(f"cast(pmod(xxhash64(doc_id), {parts}) as int)").alias("part"), "doc_id",
        F.expr("whole div capacity_tokens").alias("piece_no"), F.expr("whole % capacity_tokens").alias("n_tokens"),
    )

    def online(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable")
        where, left = pack_online(pdf.n_tokens.tolist(), int(pdf.capacity_tokens.iloc[0]), open_windows)
        pdf["win"] = pd.array(where, dtype="int64")
        pdf["is_open"] = [w in left for w in where]
        return pdf[["container_kind", "capacity_tokens", "part", "win", "is_open", "doc_id", "piece_no", "n_tokens"]]

    id_type = sizes.schema["doc_id"].dataType.simpleString()
    placed = materialize(
        rests.groupBy(*_GROUP).applyInPandas(
            online, f"container_kind string, capacity_tokens long, part int, win long, is_open boolean, doc_id {id_type}, piece_no long, n_tokens long"
        ), "pack-placed",
    ).withColumn("win_id", F.concat_ws("-", "part", "win"))
    left = placed.where("is_open").groupBy(*_GROUP, "capacity_tokens", "win_id").agg(F.sum("n_tokens").alias("used"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("win_id")
        where = pack_offline(pdf.used.tolist(), int(pdf.capacity_tokens.iloc[0]))
        first: dict[int, str] = {}
        pdf["into"] = [first.setdefault(w, i) for w, i in zip(where, pdf.win_id)]
        total = pdf.groupby("into", sort=True).used.sum()
        # The emptiest windows stay open for the next level, the others are done.
        still = set(total.sort_values(kind="stable").index[:open_windows])
        pdf["total"] = pdf.into.map(total)
        pdf["is_open"] = pdf.into.isin(still) & (pdf.total < pdf.capacity_tokens)
        return pdf[["container_kind", "capacity_tokens", "part", "win_id", "into", "total", "is_open"]]

    to, groups = None, parts
    while groups > 1 or to is None:
        groups = -(-groups // fan_in)
        left = left.withColumn("part", F.expr(f"cast(part div {fan_in} as int)"))
        step = materialize(
            left.groupBy(*_GROUP).applyInPandas(merge, "container_kind string, capacity_tokens long, part int, win_id string, into string, total long, is_open boolean"), "pack-merge"
        )
        left = step.where("is_open").select("container_kind", "capacity_tokens", "part", F.col("into").alias("win_id"), F.col("total").alias("used")).distinct()
        moved = step.select("container_kind", "win_id", "into")
        to = moved if to is None else to.join(moved.toDF("container_kind", "into", "later"), ["container_kind", "into"], "left").select("container_kind", "win_id", F.coalesce("later", "into").alias("into"))
    packed = placed.join(to, ["container_kind", "win_id"], "left").withColumn("container_id", F.coalesce("into", "win_id"))
    cols = ["container_kind", "container_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity_tokens")).alias("start_token"), "n_tokens", "capacity_tokens"]
    return packed.select(*cols).unionByName(full.select(*cols))


def invariants(packed: DataFrame, sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind what must not be: containers above their capacity, items cut though they fit, items with tokens lost, doubled or out of place."""
    kinds = containers.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long"))
    over = packed.groupBy("container_kind", "container_id").agg((F.sum("n_tokens") > F.first("capacity_tokens")).cast("long").alias("x")).groupBy("container_kind").agg(F.sum("x").alias("overfull"))
    per = packed.groupBy("container_kind", "doc_id").agg(
        F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("start_token").alias("starts"), F.first("capacity_tokens").alias("cap"),
    ).join(sizes.select("doc_id", F.col("n_tokens").alias("whole")), "doc_id", "left")
    bad = per.groupBy("container_kind").agg(
        F.count("*").alias("n_items"), F.count_if((F.col("pieces") > 1) & (F.col("whole") <= F.col("cap"))).alias("cut"),
        F.count_if(F.coalesce((F.col("got") != F.col("whole")) | (F.col("end") != F.col("whole")) | (F.col("starts") != F.col("pieces")), F.lit(True))).alias("misplaced"),
    )
    missing = sizes.agg(F.count_if(F.col("n_tokens") > 0).alias("n"))
    return kinds.join(over, "container_kind", "left").join(bad, "container_kind", "left").crossJoin(missing).select(
        "container_kind", F.coalesce("overfull", F.lit(0)).alias("overfull"), F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("misplaced", F.lit(0)).alias("misplaced"),
        (F.col("n") - F.coalesce("n_items", F.lit(0))).alias("missing"),
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers used, the least possible number by volume, and the filled share."""
    each = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("volume_bound"),
        F.round(F.sum("used") / (F.count("*") * F.first("capacity_tokens")), 4).alias("fill"),
    )
