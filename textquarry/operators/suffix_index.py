"""Suffix arrays that are stored with their texts, versioned, and searched by bisection.

One row per document: the text and its suffixes in symbol order, the empty one left out. Suffixes that begin with the same
two symbols stand together, so each is stored as its number among those by position: mostly one byte that compresses well,
instead of a position of four. Opening a row takes one sort of symbol pairs by digits. A pattern of m symbols costs 2 log n
comparisons of m symbols. Documents whose text is NULL have no row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import rows as R
from textquarry.operators import suffixes
from textquarry.sources import tables

FORMAT_VERSION = 1


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, format_version, numbers)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in R.parts(batches):
            made = [numbered(suffixes.code_points(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array([FORMAT_VERSION] * len(made), pa.int32()), pa.array(made, pa.binary())], names=["doc_id", "text", "format_version", "numbers"])

    return R.spread(rows, F.xxhash64(F.lit("suffixes"), "doc_id", "text")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, format_version int, numbers binary")


def _by_pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions by their first two symbols, and for each where its pair begins."""
    codes, sigma = suffixes.dense(points)
    pair = codes * (sigma + 1) + np.append(codes[1:], 0)
    by = suffixes.by_symbol(pair, (sigma + 1) ** 2)
    ordered = pair[by]
    return by, np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1]), np.arange(len(by)), 0))


def numbered(points: np.ndarray) -> bytes:
    """The suffixes in order, each by its number among those that begin with the same two symbols."""
    if not len(points):
        return b""
    by, start = _by_pairs(points)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    out = place[suffixes.suffix_array(points)[1:]] - start
    top = int(out.max())
    return out.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def positions(points: np.ndarray, numbers: bytes) -> np.ndarray:
    """The suffix array of what :func:`numbered` gave."""
    if not len(points):
        return np.zeros(1, np.int64)
    by, start = _by_pairs(points)
    return np.append(len(points), by[start + np.frombuffer(numbers, f"<u{len(numbers) // len(points)}")])


def save(stored: DataFrame, path: str) -> None:
    tables.save(stored, path, FORMAT_VERSION, compression="zstd")


def load(spark: SparkSession, path: str) -> DataFrame:
    return tables.load(spark, path, FORMAT_VERSION)


def matches(text: str, order: np.ndarray, pattern: str) -> tuple[int, int]:
    """First and last (exclusive) row of the suffixes that begin with the pattern."""
    m = len(pattern)
    head = lambda at: text[at : at + m]
    return bisect_left(order, pattern, key=head), bisect_right(order, pattern, key=head)


def _found(stored: DataFrame, pattern: str, columns: str, make) -> DataFrame:
    if not pattern:
        raise ValueError("the pattern is empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in R.parts(batches):
            which, made = [], []
            for k, (text, numbers) in enumerate(zip(batch.column("text").to_pylist(), batch.column("numbers").to_pylist(), strict=True)):
                order = positions(suffixes.code_points(text), numbers)
                rows = make(order, *matches(text, order, pattern))
                which += [k] * len(rows)
                made += rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which, pa.int64())), *[pa.array([m[j] for m in made], pa.int64()) for j in range(columns.count(",") + 1)]], names=["doc_id", *[c.split()[0] for c in columns.split(", ")]])

    rows = stored.select("doc_id", "text", "numbers")
    return rows.mapInArrow(run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {columns}")


def count(stored: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, n), a row for each document."""
    return _found(stored, pattern, "n long", lambda order, low, high: [(high - low,)])


def locate(stored: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """(doc_id, pos, match_no): the matches, or the first ``limit``, in suffix order."""
    if limit is not None and limit < 1:
        raise ValueError("the limit is at least 1, or None")

    def make(order: np.ndarray, low: int, high: int) -> list[tuple]:
        high = high if limit is None else min(high, low + limit)
        return [(p, k) for k, p in enumerate(order[low:high].tolist())]

    return _found(stored, pattern, "pos long, match_no long", make)
