"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of all operators.
SPACE = r"\x20\x09-\x0D"


#: Rows in an Arrow batch at most: texts and sets are long, and a batch is in memory twice.
BATCH_ROWS = 1000
#: In a worker, arrays of more bytes get pages of their own; so many free bytes stay with it during a task.
MMAP_BYTES, TRIM_BYTES = 1 << 23, 1 << 25


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, in a worker that gives memory back: workers outlive their tasks.

    Very large arrays get pages of their own, which go with them; smaller ones reuse pages, since getting
    them anew for each array is a sixth of an array kernel's CPU. What is free goes at the task's end.
    """

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, MMAP_BYTES)  # M_MMAP_THRESHOLD; set by hand, it stays
            libc.mallopt(-1, TRIM_BYTES)  # M_TRIM_THRESHOLD
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return lean_run


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares. Only a local session may name none; it gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kairn-"))
        named = sc.getCheckpointDir()
    return named


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not what came before. The shuffle
    files of the job go with it; the table goes when it is discarded, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kairn-{what}-{uuid.uuid4().hex}"
    schema, cleanup = df.schema, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    file_system, target = _located(spark, path)
    file_system.deleteOnExit(target)
    table = spark.read.schema(schema).parquet(path)
    table._stash = path
    return table


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables; nothing that is still to run may read them."""
    for table in tables:
        file_system, target = _located(table.sparkSession, table._stash)
        file_system.delete(target, True)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, lang and all columns of docs as the struct `row`; a missing one is null.

    Operators work on these fixed names, so that other columns of docs can have any name. The session's
    Arrow batches are limited to BATCH_ROWS rows from here on.
    """
    spark, rows = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    have = set(docs.columns)

    def pick(name: str, kind: str) -> Column:
        return (docs[f"`{name}`"] if name in have else F.lit(None)).cast(kind).alias(name)

    return docs.select(
        pick("doc_id", "long"), pick("text", "string"), pick("source", "string"), pick("lang", "string"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    )


def core(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of packed(docs)."""
    return packed(docs).select(*names)


def group_back(
    rows: DataFrame,
    keys: list[str],
    aggs: dict[str, tuple[Column, str]],
    spread: Column,
    salts: int = 64,
    having: Column | None = None,
) -> DataFrame:
    """rows with aggregates of their key group beside them, also where one key holds a third of all rows.

    aggs: name -> (partial aggregate, name of the SQL function that merges partials). Groups are
    aggregated by key and salt first; then by key, which sees at most `salts` rows a key; and each
    (key, salt) that exists takes the result back to its rows. So no task holds a hot key's rows.
    having: drops groups (and their rows) by their aggregates. Null keys form no group and are dropped.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit(77)), F.lit(salts)).cast("int"))
    partial = salted.groupBy(*keys, "_salt").agg(*[a.alias(n) for n, (a, _) in aggs.items()])
    total = partial.groupBy(*keys).agg(
        *[F.expr(f"{merge}({n})").alias(n) for n, (_, merge) in aggs.items()],
        F.collect_list("_salt").alias("_salts"),
    )
    if having is not None:
        total = total.where(having)
    back = total.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


#: Bits of a sieve, and in one row of it while it is built.
SIEVE_BITS, SIEVE_ROW = 1 << 25, 1 << 19
#: What tasks count is merged in so many groups first, each of every MERGED-th task.
MERGED = 16


class Sieve:
    """A test whether longs may be among some keys, all columns of a table, from a bit array of fixed size.

    It never says no to a key that is there. What passes is joined with the keys afterwards, so wrong
    yeses cost time only; it keeps rows from being shuffled that the join would drop. The bits, 4 MB
    however many keys there are, are the only thing that reaches the driver and the executors.
    """

    def __init__(self, keys: DataFrame):
        kind = "slot int, part int, bits binary"

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(SIEVE_BITS // 8, np.uint8)
            for batch in batches:
                for column in batch.columns:
                    for place in _places(column.drop_null().to_numpy()):
                        np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
            rows = bits.reshape(-1, SIEVE_ROW // 8)
            used = np.flatnonzero(rows.any(axis=1))
            part = [TaskContext.get().partitionId() % MERGED] * len(used)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(part, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["slot", "part", "bits"])

        rows = keys.mapInArrow(lean(mark), kind).groupBy("slot", "part").applyInArrow(_either, kind).groupBy("slot").applyInArrow(_either, kind).collect()
        bits = np.zeros((SIEVE_BITS // SIEVE_ROW, SIEVE_ROW // 8), np.uint8)
        for r in rows:
            bits[r["slot"]] = np.frombuffer(r["bits"], np.uint8)
        self._bits = keys.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def __enter__(self) -> Sieve:
        return self

    def __exit__(self, *_: object) -> None:
        """Frees the bits everywhere; whatever uses the sieve has to have run."""
        self._bits.destroy()

    def has(self, keys: np.ndarray) -> np.ndarray:
        table, out = self._bits.value, np.ones(len(keys), bool)
        for place in _places(keys):
            out &= (table[place >> 3] >> (place & 7)) & 1 == 1
        return out

    def __call__(self, key: Column) -> Column:
        @F.arrow_udf("boolean")
        def passes(values: pa.Array) -> pa.Array:
            return pa.array(self.has(values.fill_null(0).to_numpy(zero_copy_only=False)))

        return passes(key)


def _places(keys: np.ndarray) -> list[np.ndarray]:
    k = keys.astype(np.int64, copy=False).view(np.uint64)
    return [((k * np.uint64(odd)) >> np.uint64(64 - 25)).astype(np.int64) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _either(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in table.column("bits")])
    return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})


#: Slots of a Repeats filter, and in one row of it.
REPEAT_SLOTS, REPEAT_ROW = 1 << 22, 1 << 14


class Repeats:
    """A test whether a 64-bit hash may occur twice or more in a table, from counts of fixed size.

    It never says no to a hash that occurs twice. hashes: from a batch to an array of hashes.
    """

    def __init__(self, df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]):
        kind = "slot int, part int, bits binary"

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(REPEAT_SLOTS, np.uint8)
            for batch in batches:
                slot, n = np.unique(self._slots(hashes(batch)), return_counts=True)
                seen[slot] = np.minimum(2, seen[slot] + np.minimum(2, n))
            rows = seen.reshape(-1, REPEAT_ROW)
            used = np.flatnonzero(rows.any(axis=1))
            part = [TaskContext.get().partitionId() % 256] * len(used)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(part, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["slot", "part", "bits"])

        rows = df.mapInArrow(lean(count), kind).groupBy("slot", "part").applyInArrow(_capped_sum, kind).groupBy("slot").applyInArrow(_capped_sum, kind).collect()
        twice = np.zeros((REPEAT_SLOTS // REPEAT_ROW, REPEAT_ROW), bool)
        for r in rows:
            twice[r["slot"]] = np.frombuffer(r["bits"], np.uint8) > 1
        self._twice = df.sparkSession.sparkContext.broadcast(np.packbits(twice.reshape(-1), bitorder="little"))

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(42)).astype(np.int64)

    def may(self, hashes: np.ndarray) -> np.ndarray:
        slot = self._slots(hashes)
        return (self._twice.value[slot >> 3] >> (slot & 7)) & 1 == 1


def _capped_sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros(REPEAT_ROW, np.uint8)
    for b in table.column("bits"):
        total = np.minimum(2, total + np.frombuffer(b.as_py(), np.uint8))
    return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})
