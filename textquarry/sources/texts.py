"""Text files as documents. A huge text becomes chunks at record boundaries, with their global base positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): each file one document, its id a hash of its path."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): each line one document; the file is split among tasks, so its size does not matter."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def chunk_text(docs: DataFrame, records: int, doc_id: str = "doc_id", text: str = "text", boundary: str = "\n") -> DataFrame:
    """(doc_id, chunk, base_pos, text): ``records`` records to a chunk, each ending with its boundary.

    A match in a chunk stands at base_pos + pos in the document; patterns without the boundary lose nothing.
    """
    pieces = F.split(F.col("t"), F.lit(f"(?<=\\Q{boundary}\\E)"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).select("doc_id", F.posexplode(pieces).alias("k", "piece"))
    chunks = rows.groupBy("doc_id", F.floor(F.col("k") / records).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("text"))
    before = W.partitionBy("doc_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return chunks.select("doc_id", "chunk", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long").alias("base_pos"), "text")


#: Blocks of files whose first positions are broadcast; more are joined by shuffle.
MAX_BROADCAST = 100_000


def read_chunks(spark: SparkSession, path: str, records: int = 10_000) -> DataFrame:
    """(path, block, chunk, base_pos, text): text files of any size as chunks of ``records`` lines, split among tasks.

    No file passes through one row or one task: each of Spark's blocks of a file is cut on its own, and base_pos, the
    chunk's first position in its file, is the symbols of the blocks before plus those of the chunks before. Every line
    ends with a line feed here, the last one too.
    """
    if records < 1:
        raise ValueError("at least one record to a chunk")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    held = lines.groupBy("path", "block").agg(F.sum(F.length("text").cast("long") + 1).alias("n"))
    begins = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    begins = held.select(F.col("path").alias("_path"), F.col("block").alias("_block"), begins.alias("_begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[str] = []
        at, chunk, base = None, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal some, chunk, base
            text = "".join(some)
            made = pa.RecordBatch.from_pydict({"path": pa.array([at[0]], pa.string()), "block": pa.array([at[1]], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "base_pos": pa.array([base], pa.int64()), "text": pa.array([text], pa.string())})
            some, chunk, base = [], chunk + 1, base + len(text)
            return made

        for batch in batches:
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "text")), strict=True):
                if (file, block) != at:
                    if some:
                        yield out()
                    at, chunk, base = (file, block), 0, 0
                some.append(line + "\n")
                if len(some) == records:
                    yield out()
        if some:
            yield out()

    chunks = lines.mapInArrow(run, "path string, block long, chunk long, base_pos long, text string")
    few = begins.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    found = chunks.join(F.broadcast(begins) if few else begins, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    return found.select("path", "block", "chunk", (F.col("base_pos") + F.col("_begin")).alias("base_pos"), "text")
