"""Suffix arrays, the Burrows-Wheeler transform and what follows from them, a document at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators import rows as R
from textquarry.operators import suffixes


def _joined(columns: list, kind: pa.DataType) -> pa.Array:
    if isinstance(columns[0], pa.Array):
        return pa.concat_arrays(columns)
    return pa.array(np.concatenate(columns) if isinstance(columns[0], np.ndarray) else [x for y in columns for x in y], kind)


def per_document(docs: DataFrame, seq_id: str, text: str, make: Callable, columns: list[tuple[str, str, pa.DataType]], deal: bool = False) -> DataFrame:
    """Rows that ``make(text)`` gives as columns. ``deal`` shares documents out by id, where the work outweighs the move."""
    rows = docs.select(F.col(seq_id).alias("seq_id"), F.col(text).alias("text")).where("text is not null")
    rows = rows.repartition("seq_id") if deal else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seq_id", *[c for c, _, _ in columns]]
        for batch in R.parts(batches):
            ids, index, held, n = batch.column("seq_id"), [], [], 0
            texts = batch.column("text").to_pylist()
            for k, t in enumerate(texts):
                made = make(t)
                index.append(np.full(len(made[0]), k))
                held.append(made)
                n += len(made[0])
                if n > 100_000 or k == len(texts) - 1:
                    parts = [[m[j] for m in held] for j in range(len(columns))]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(index))), *[_joined(p, kind) for p, (_, _, kind) in zip(parts, columns, strict=True)]], names=names)
                    index, held, n = [], [], 0

    return rows.mapInArrow(run, ", ".join([f"seq_id {rows.schema['seq_id'].dataType.simpleString()}", *[f"{c} {kind}" for c, kind, _ in columns]]))


_RANK, _POS = ("sa_rank", "long", pa.int64()), ("pos", "long", pa.int64())


def suffix_array(docs: DataFrame, seq_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seq_id, sa_rank, pos) over symbol order; the empty suffix has rank 0."""

    def make(t: str):
        order = suffixes.suffix_array(suffixes.code_points(t))
        return np.arange(len(order)), order

    return per_document(docs, seq_id, text, make, [_RANK, _POS], deal=True)


def suffix_samples(docs: DataFrame, rate: int, seq_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seq_id, sa_rank, pos, slot): the rows of the suffix array whose position is a multiple of ``rate``, with the slot by
    position. The others never leave the function."""
    if rate < 1:
        raise ValueError("the sample rate is at least 1")

    def make(t: str):
        order = suffixes.suffix_array(suffixes.code_points(t))
        rows = np.flatnonzero(order % rate == 0)
        return rows, order[rows], order[rows] // rate

    return per_document(docs, seq_id, text, make, [_RANK, _POS, ("slot", "long", pa.int64())], deal=True)


def bwt(docs: DataFrame, seq_id: str = "doc_id", text: str = "text", mark: str = "\0") -> DataFrame:
    """(seq_id, bwt)."""
    return per_document(docs, seq_id, text, lambda t: ([suffixes.bwt(t, mark)],), [("bwt", "string", pa.string())], deal=True)


def bwt_redundancy(docs: DataFrame, seq_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seq_id, text_redundancy, bwt_redundancy): length over runs, before and after; empty texts have none."""

    def make(t: str):
        points = suffixes.code_points(t)
        if not len(points):
            return [], []
        after = suffixes.bwt_codes(suffixes.first_appearance(points)[0], suffixes.suffix_array(points))
        return [len(points) / suffixes.runs(points)], [len(after) / suffixes.runs(after)]

    return per_document(docs, seq_id, text, make, [("text_redundancy", "double", pa.float64()), ("bwt_redundancy", "double", pa.float64())], deal=True)


def lf_mapping(docs: DataFrame, seq_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seq_id, sa_rank, lf): the row of the suffix one symbol longer, over symbol order."""

    def make(t: str):
        points = suffixes.code_points(t)
        lf = suffixes.last_to_first(np.concatenate((points.astype(np.int64) + 1, [0]))[suffixes.suffix_array(points) - 1])
        return np.arange(len(lf)), lf

    return per_document(docs, seq_id, text, make, [_RANK, ("lf", "long", pa.int64())], deal=True)
