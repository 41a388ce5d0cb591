"""What functions over Arrow batches share: parts of bounded size, memory given back, small tables dealt out."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Bytes of a part, by the mean row of its batch.
PART = 1 << 20
#: Bytes of rows after which a worker gives back the memory that it no longer uses.
RELEASE = 16 << 20


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some PART bytes, a row at least, so that a worker opens no more at a time, however many rows
    Spark sends together."""
    passed = 0
    for batch in batches:
        step = max(1, batch.num_rows * PART // max(1, batch.nbytes))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)
        passed += batch.nbytes
        del batch
        if passed >= RELEASE:
            passed = 0
            release()
    release()


def spread(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Rows dealt out anew where they are read in fewer parts than there are cores. A larger table stays where it is read: no
    text is shuffled."""
    scan = rows._jdf.queryExecution().executedPlan().toString()
    if "Exchange" not in scan and rows.rdd.getNumPartitions() >= rows.sparkSession.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(*by)
