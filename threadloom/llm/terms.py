"""How often every distinct term occurs (problem 4), by recursive radix spilling.

Terms are counted inside each task first; the counts are spilled to the shared
folder in partitions by the top hash bits of the term, as many bits as the size
of the input asks for.  Partitions above ``max_bytes`` are split by the next
bits, all of one level in one job, and so on; each leaf is then summed
out-of-core by DuckDB in a task of its own.

Defined results: rows with one ``uuid`` count once (the one with the least
``rec_id``), rows with a null uuid count each; null and blank texts have no
terms; a record counts once for a term however often it holds it; a table
without terms gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import fresh_path, materialize

#: Longest runs of letters and digits of any script.
TERM = re.compile(r"[^\W_]+")
#: Hash bits of one level: at least and at most.
MIN_BITS, MAX_BITS = 2, 12
#: A leaf of so many compressed bytes is summed by one DuckDB in DUCKDB_MEMORY.
MAX_LEAF_BYTES = 48 << 20
DUCKDB_MEMORY = "384MB"
#: A task hands on its counts when it holds so many distinct terms.
FLUSH_TERMS = 200_000
_COUNTS = "term string, occurrences long, records long"


def first_copies(rows: DataFrame) -> DataFrame:
    """rows(rec_id, uuid, ...) without the later copies of a uuid.

    Only uuids that occur twice or more are joined, a narrow table.
    """
    repeated = (
        rows.where("uuid is not null").groupBy("uuid").agg(F.min("rec_id").alias("__first"), F.count("*").alias("__n"))
        .where("__n > 1").drop("__n")
    )
    return rows.join(repeated, "uuid", "left").where("__first is null or rec_id = __first").drop("__first")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occ: Counter = Counter()
    rec: Counter = Counter()

    def flush() -> pa.RecordBatch:
        terms = list(occ)
        out = pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([occ[t] for t in terms], pa.int64()), pa.array([rec[t] for t in terms], pa.int64())],
            ["term", "occurrences", "records"],
        )
        occ.clear()
        rec.clear()
        return out

    for b in batches:
        for texts in b.column(0).to_pylist():
            own = Counter(t for x in texts or () if x for t in TERM.findall(x.lower()))
            if own:
                occ.update(own)
                rec.update(own.keys())
                occ[None] += 1  # the row of the null term counts the records that hold any term
                rec[None] += 1
            if len(occ) >= FLUSH_TERMS:
                yield flush()
    if occ:
        yield flush()


def _radix(first: int, bits: int) -> Column:
    """The ``bits`` bits of a term's hash behind its ``first`` ones."""
    h = F.xxhash64(F.coalesce("term", F.lit("")), F.col("term").isNull())
    return F.shiftrightunsigned(F.shiftleft(h, first), 64 - bits)


def _spill(counts: DataFrame, path: str, used: int, bits: int) -> None:
    """Write the partitions of one level below ``path``, named by all hash bits used so far.

    Rows of one partition go through as many tasks as the session shuffles with:
    further bits of the hash spread a partition that many others would share.
    """
    spread = F.shiftrightunsigned(F.shiftleft(F.xxhash64("term"), used + bits if used + bits < 64 else 0), 61)
    counts.withColumn("radix", _radix(0, used + bits)).repartition("radix", spread).write.partitionBy("radix").option("compression", "zstd").parquet(path)


def _partitions(spark: SparkSession, path: str) -> DataFrame:
    """(radix, paths, bytes) of the partitions written below ``path``, from the listing of files; no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"/radix=(-?\d+)/", 1).cast("long").alias("radix")).agg(F.collect_list("path").alias("paths"), F.sum("length").alias("bytes"))


def _bits_for(size: int, max_bytes: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, (max(1, size) // max_bytes).bit_length()))


def _leaves(counts: DataFrame, max_bytes: int, bits: int | None, size: int) -> list[DataFrame]:
    """(paths, bytes) of the leaves of every level."""
    spark = counts.sparkSession
    out: list[DataFrame] = []
    used, level_bits = 0, bits or _bits_for(size, max_bytes)
    while True:
        path = fresh_path(spark, f"terms-{len(out)}")
        _spill(counts, path, used, level_bits)
        used += level_bits
        if not _has_files(spark, path):
            return out
        parts = materialize(_partitions(spark, path), "terms-parts")
        big = parts.where(F.col("bytes") > max_bytes)
        largest = big.agg(F.max("bytes")).first()[0]
        if largest is None or used >= 63:
            return [*out, parts.select("paths", "bytes")]
        out.append(parts.where(F.col("bytes") <= max_bytes).select("paths", "bytes"))
        # Counts of one term from many tasks are combined on the way down.
        counts = spark.read.schema(_COUNTS + ", radix long").parquet(path).join(big.select("radix"), "radix", "left_semi").groupBy("term").agg(
            F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
        )
        level_bits = min(63 - used, bits or _bits_for(largest, max_bytes))


def _has_files(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return any(s.isDirectory() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def _megabytes(memory: str) -> float:
    n, unit = re.fullmatch(r"(\d+)\s*([KMG])B", memory).groups()
    return int(n) * {"K": 1 / 1024, "M": 1, "G": 1024}[unit]


def _sum_leaf(paths: list[str], size: int, spill: str, memory: str) -> Iterator[pa.RecordBatch]:
    """Sum one leaf in at most ``memory``.

    On a shared file system DuckDB spills into the shared folder.  An object
    store can't take its spill; there the leaf is read in as many passes as it
    needs, each over one slice of the terms' hashes, so no local disk is used.
    """
    import duckdb
    import pyarrow.dataset as ds
    from pyarrow import fs

    where = fs.FileSystem.from_uri(paths[0])[0]
    data = ds.dataset([fs.FileSystem.from_uri(p)[1] for p in paths], filesystem=where, format="parquet", partitioning=None)
    # Unpacked, a leaf takes some ten times its compressed bytes.
    passes = 1 if spill else max(1, -(-size * 20 // int(_megabytes(memory) * (1 << 20))))
    con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False} | ({"temp_directory": spill} if spill else {}))
    try:
        for k in range(passes):
            rows = data.scanner(columns=["term", "occurrences", "records"], batch_size=8_192).to_reader()  # noqa: F841
            own = "" if passes == 1 else f"where hash(term) % {passes} = {k}"
            yield from con.sql(f"select term, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from rows {own} group by term").to_arrow_reader(8_192)
    finally:
        con.close()


def _input_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of a table, from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def term_counts(
    records: DataFrame, bits: int | None = None, max_bytes: int = MAX_LEAF_BYTES, memory: str = DUCKDB_MEMORY, spill: bool | None = None
) -> DataFrame:
    """records(rec_id, uuid, texts array<string>) -> (term, occurrences, records).

    The row of the null term holds the number of records with any term.  ``bits``
    sets the hash bits of a level, else the sizes do; ``spill`` whether DuckDB may
    spill into the shared folder, else whether that is a file system.
    """
    spark = records.sparkSession
    counts = first_copies(records.select("rec_id", "uuid", "texts")).select("texts").mapInArrow(_count, _COUNTS)
    leaves = None
    for part in _leaves(counts, max_bytes, bits, min(_input_bytes(records), 1 << 62)):
        leaves = part if leaves is None else leaves.unionByName(part)
    if leaves is None:
        return spark.createDataFrame([], _COUNTS)
    leaves = materialize(leaves, "terms-leaves")
    n = leaves.count()
    root = fresh_path(spark, "duckdb")
    local = root.startswith(("file:", "/")) if spill is None else spill
    folder = re.sub(r"^file:/*", "/", root) if local else ""

    def sum_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for b in batches:
            for paths, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _sum_leaf(paths, size, f"{folder}/{uuid.uuid4().hex}" if folder else "", memory)

    # Each task gets the rows of its own leaves and nothing of the others.
    return leaves.repartition(max(1, min(n, 1 << 17))).mapInArrow(sum_leaves, _COUNTS)


def term_frequencies(records: DataFrame, rare_below: int = 3, common_percent: int = 4, **spilling) -> DataFrame:
    """(term, occurrences, records, mark): mark is 'rare', 'common' or '' for useful terms."""
    counts = materialize(term_counts(records, **spilling), "term-counts")
    total = counts.where("term is null").agg(F.coalesce(F.max("records"), F.lit(0))).first()[0]
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 > F.lit(total) * common_percent, "common").otherwise("")
    return counts.where("term is not null").withColumn("mark", mark)


def block_texts(records: DataFrame) -> DataFrame:
    """The text blocks of transcript records as (rec_id, uuid, texts)."""
    texts = F.expr("transform(filter(message.content, b -> b.type = 'text'), b -> b.text)")
    return records.select("rec_id", "uuid", texts.alias("texts"))
