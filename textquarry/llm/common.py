"""What several operators of this subpackage share: the shared folder, id-ordered shards, carried rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.sources.tables import clean_up, fresh_path, shared_dir  # noqa: F401

#: Shards of a layout at most. The driver holds 16 bytes for each.
MAX_SHARDS = 1 << 17
#: Stands for a null key in a layout; a row with this very id is taken for one without.
FIRST = -(1 << 63)
#: Rows of a range in which keys are sorted for a layout.
RANGE_ROWS = 1 << 22
#: Bytes of rows after which a worker gives back the memory that it no longer uses.
RELEASE = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path behind a URI, as a Python worker opens it."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def commit(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Gives a complete file its final name. Attempts write equal bytes, so the last one may replace the first."""
    try:
        fs.move(temporary, final)
    except OSError:
        fs.delete_file(final)
        fs.move(temporary, final)


def carried(docs: DataFrame, **needed: Column) -> DataFrame:
    """Rows for an Arrow function: the whole input row as ``_row`` beside the columns that the function reads."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in needed.items()])


def uncarried(df: DataFrame, columns: list[str], outputs: list[str]) -> DataFrame:
    """The input columns again, followed by the operator's; where names clash, the operator's stand."""
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns if c not in outputs], *outputs)


def layout(df: DataFrame, key: str, tie: str, rows: int) -> list[tuple[int, int]]:
    """Where shards of ``rows`` rows begin, as (key, tie), both longs: contiguous ranges, the same on every run.

    Keys and ties are sorted alone, in as many ranges as needed, and numbered by the ranges' exact counts; every
    ``rows``-th opens a shard. So neither outliers nor keys that many rows share can fill a shard. Null keys come first, as
    FIRST. Shards are longer than ``rows`` where there would be more than MAX_SHARDS, as one shuffle deals to no more
    partitions: what reads a shard streams it.
    """
    spark = df.sparkSession
    # equal keys and ties are dealt to several ranges by their places in the input
    narrow = stash(df.select(F.coalesce(F.col(key), F.lit(FIRST)).alias("k"), F.col(tie).alias("t"), F.monotonically_increasing_id().alias("salt")), "shard-keys")
    n = narrow.count()
    size = max(rows, -(-n // MAX_SHARDS))
    if n <= size:
        return [tuple(r) for r in narrow.select("k", "t").orderBy("k", "t").take(1)] or [(FIRST, FIRST)]
    parts = max(min(n // size, int(spark.conf.get("spark.sql.shuffle.partitions"))), n // RANGE_ROWS + 1)
    # the place of a row: its range in the upper bits, its number there in the lower 33
    placed = narrow.repartitionByRange(parts, "k", "t", "salt").sortWithinPartitions("k", "t", "salt").select("k", "t", F.monotonically_increasing_id().alias("at"))
    placed = stash(placed, "shard-order").select("k", "t", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    before, counted = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):
        counted.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(counted, "part long, before long"))
    found = placed.join(offsets, "part").select("k", "t", (F.col("before") + F.col("at")).alias("rank")).where(F.pmod("rank", F.lit(size)) == 0)
    return [(r["k"], r["t"]) for r in sorted(found.collect(), key=lambda r: r["rank"])]


def placed(df: DataFrame, key: str, tie: str, opens: list[tuple[int, int]]) -> DataFrame:
    """``df`` with _shard, the last shard that the row can lie in; _opens, whether key and tie are those of its first row;
    and _twins, how many shards begin so: rows that agree in both are interchangeable, and may fill several."""
    if len(opens) == 1:
        k, t = opens[0]
        return df.withColumns({"_shard": F.lit(0), "_opens": (F.coalesce(F.col(key), F.lit(FIRST)) == k) & (F.col(tie) == t), "_twins": F.lit(1)})
    sent = df.sparkSession.sparkContext.broadcast((np.array([k for k, _ in opens]), np.array([t for _, t in opens])))

    # one number, in Arrow: workers that import this module need no pandas, which takes memory
    @F.arrow_udf("long")
    def place(keys: pa.Array, ties: pa.Array) -> pa.Array:
        shard, first, twins = places(*sent.value, keys.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False))
        return pa.array(twins.astype(np.int64) << 32 | first.astype(np.int64) << 31 | shard)

    df = df.withColumn("_place", place(F.coalesce(F.col(key), F.lit(FIRST)), F.col(tie)))
    of = {"_shard": F.col("_place").bitwiseAND(F.lit((1 << 31) - 1)), "_twins": F.shiftright("_place", 32)}
    df = df.withColumns({c: v.cast("int") for c, v in of.items()} | {"_opens": F.getbit("_place", F.lit(31)) == 1})
    return df.drop("_place")


def places(of_key: np.ndarray, of_tie: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last shard that begins at or before each row, whether with its very key and tie, and how many do (1 at least)."""
    low, high = np.searchsorted(of_key, keys, "left"), np.searchsorted(of_key, keys, "right")
    shared = np.flatnonzero(low < high)
    # shards that begin with the same key are told apart by their ties
    by = shared[np.argsort(keys[shared], kind="stable")]
    for group in np.split(by, np.flatnonzero(np.diff(keys[by])) + 1):
        if len(group):
            a, b = low[group[0]], high[group[0]]
            low[group], high[group] = a + np.searchsorted(of_tie[a:b], ties[group], "left"), a + np.searchsorted(of_tie[a:b], ties[group], "right")
    return np.maximum(high - 1, 0).astype(np.int32), low < high, np.maximum(high - low, 1).astype(np.int32)


def spread(df: DataFrame) -> DataFrame:
    """Rows of :func:`placed`, those that fill several shards dealt out evenly among them."""
    among = F.pmod(F.monotonically_increasing_id(), F.col("_twins").cast("long")).cast("int")
    return df.withColumn("_shard", F.when(F.col("_twins") > 1, F.col("_shard") - among).otherwise(F.col("_shard")))


def by_shard(df: DataFrame, shards: int, *order: str) -> DataFrame:
    """Shards dealt out whole, one to a partition, the rows of each in order."""
    return df.repartitionById(max(1, shards), F.col("_shard")).sortWithinPartitions("_shard", *order)


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Slices of batches in which ``column`` has one value."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pa.compute.run_end_encode(batch.column(column))
        start = 0
        for end, value in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
            yield value, batch.slice(start, end - start)
            start = end


def mix64(z: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_kept: dict = {}


def kept(key: tuple, make):
    """What a worker builds once and uses in many tasks: the last one only, so that stages do not add up in its memory."""
    if key not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


def release(keeps: bool = True) -> None:
    """Gives the system back what the allocators hold free, and unless the worker ``keeps`` it, what was kept."""
    if not keeps:
        _kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def lean(run: Callable, keeps: bool = False) -> Callable:
    """An Arrow function whose worker gives unused memory back every RELEASE bytes and at its end, as workers live on beside
    those of later stages, and the executor's heap beside them. Unless it ``keeps``, what other functions have kept goes too."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for batch in batches:
            passed += batch.nbytes
            yield batch
            if passed >= RELEASE:
                del batch
                passed = 0
                release()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        try:
            yield from run(fed(batches))
        finally:
            release()

    return go
