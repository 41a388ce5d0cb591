"""Locating literal patterns, and what stands around the matches.

A match list is made in one pass over the text and without a shuffle: Arrow hands the texts to Python, whose substring
search runs in C, and only ids and positions come back. ``contains`` goes first, so the scan can skip.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import suffixes

#: Bytes of patterns that are searched for in one pass; their automaton takes some fifty times as much in each worker.
SLICE_BYTES = 4 << 20


def find_all(text: str, pattern: str) -> list[int]:
    """All positions, overlapping matches included."""
    out, i = [], text.find(pattern)
    while i >= 0:
        out.append(i)
        i = text.find(pattern, i + 1)
    return out


def _limited(limit: int | None) -> int | None:
    if limit is not None and limit < 1:
        raise ValueError("the limit is at least 1, or None")
    return limit


def locate_all(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text", limit: int | None = None, order: str = "position") -> DataFrame:
    """(doc_id, pos) of every match, or of the first ``limit`` of each document.

    ``order``: ``position``; ``suffix``, by the suffixes that begin at the matches; or ``code``, by those suffixes over
    symbol codes in order of first appearance.
    """
    T.checked_pattern(pattern)
    _limited(limit)
    if order not in ("position", "suffix", "code"):
        raise ValueError(f"no such order: {order}")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").contains(pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, pos, rank = [], [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                found = find_all(t, pattern)
                if order != "position" and len(found) > 1:
                    points = suffixes.code_points(t)
                    found = suffixes.in_order(suffixes.first_appearance(points)[0] if order == "code" else points, found)
                found = found[:limit]
                index += [k] * len(found)
                pos += found
                rank += range(len(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(index, pa.int64())), pa.array(pos, pa.int64()), pa.array(rank, pa.int64())], names=["doc_id", "pos", "match_no"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pos long, match_no long")


def _with_each_match(docs: DataFrame, pattern: str, doc_id: str, text: str, limit: int | None, column: str, take: Callable[[str, int], str]) -> DataFrame:
    """(doc_id, pos, ``column``): what ``take`` cuts out around each match. Only the cuttings leave the pass, not the texts."""
    T.checked_pattern(pattern)
    _limited(limit)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").contains(pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, pos, cut = [], [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                found = find_all(t, pattern)[:limit]
                index += [k] * len(found)
                pos += found
                cut += [take(t, i) for i in found]
                if len(cut) > 20_000:
                    yield batch_of(batch, index, pos, cut)
                    index, pos, cut = [], [], []
            yield batch_of(batch, index, pos, cut)

    def batch_of(batch, index, pos, cut) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(index, pa.int64())), pa.array(pos, pa.int64()), pa.array(cut, pa.string())], names=["doc_id", "pos", column])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pos long, {column} string")


def _until(t: str, boundary: str, i: int) -> int:
    found = t.find(boundary, i)
    return len(t) if found < 0 else found


def locate_and_extract(docs: DataFrame, pattern: str, chars: int = 64, limit: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, extract): up to ``chars`` symbols from each match on."""
    return _with_each_match(docs, pattern, doc_id, text, limit, "extract", lambda t, i: t[i : i + chars])


def grep_records(docs: DataFrame, pattern: str, boundary: str = "\n", limit: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, record): the record around each match; empty where the match begins with the boundary."""
    return _with_each_match(docs, pattern, doc_id, text, limit, "record", lambda t, i: t[t.rfind(boundary, 0, i + 1) + 1 : _until(t, boundary, i)])


def extract_key_value(docs: DataFrame, key: str, boundary: str = ",", limit: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, fragment): from each match of ``key`` up to the boundary."""
    return _with_each_match(docs, key, doc_id, text, limit, "fragment", lambda t, i: t[i : _until(t, boundary, i)])


def _counter(patterns: list[tuple[object, str]]):
    """A function text -> {pattern index: count}, overlapping matches included."""
    try:
        import ahocorasick
    except ImportError:
        return lambda t: {k: n for k, (_, p) in enumerate(patterns) if (n := len(find_all(t, p)))}
    built, owners = ahocorasick.Automaton(), {}
    for k, (_, p) in enumerate(patterns):
        owners.setdefault(p, []).append(k)
    for p, ks in owners.items():
        built.add_word(p, tuple(ks))
    built.make_automaton()

    def count(t: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for _, ks in built.iter(t):
            for k in ks:
                out[k] = out.get(k, 0) + 1
        return out

    return count


def sliced(patterns: DataFrame, pattern_id: str, pattern: str, slice_bytes: int = SLICE_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The pattern table in slices of bounded size, one at a time; one empty slice if there is no pattern."""
    some, held, any_ = [], 0, False
    for r in patterns.select(F.col(pattern_id).alias("i"), F.col(pattern).alias("p")).where("length(p) > 0").toLocalIterator():
        size = len(r["p"].encode())
        if some and held + size > slice_bytes:
            yield some
            some, held, any_ = [], 0, True
        some.append((r["i"], r["p"]))
        held += size
    if some or not any_:
        yield some


_built: dict[str, Callable] = {}


def _kept(key: str, make: Callable[[], Callable]) -> Callable:
    """What a worker has built last; it is used by the tasks that follow."""
    if key not in _built:
        _built.clear()
        _built[key] = make()
    return _built[key]


def multi_pattern_count(docs: DataFrame, patterns: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern_id: str = "pattern_id", pattern: str = "pattern", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, pattern_id, n) where n > 0: each text is scanned once for all patterns of a slice of the pattern table."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    out = None
    id_type, pattern_type = rows.schema["doc_id"].dataType.simpleString(), patterns.schema[pattern_id].dataType.simpleString()
    for some in sliced(patterns, pattern_id, pattern, slice_bytes):
        sent = spark.sparkContext.broadcast(some)  # at most slice_bytes, or one pattern

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            count = _kept(key, lambda: _counter(sent.value) if sent.value else lambda t: {})
            ids = pa.array([i for i, _ in sent.value])
            for batch in batches:
                index, which, n = [], [], []
                for k, t in enumerate(batch.column("text").to_pylist()):
                    for p, c in count(t).items():
                        index.append(k)
                        which.append(p)
                        n.append(c)
                if n:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(index)), ids.take(pa.array(which)), pa.array(n, pa.int64())], names=["doc_id", "pattern_id", "n"])

        part = rows.mapInArrow(run, f"doc_id {id_type}, pattern_id {pattern_type}, n long")
        out = part if out is None else out.unionByName(part)
    return out
