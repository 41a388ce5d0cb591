"""Sequences stored for rank, access and inverse select without a scan: codes, and counts of each code at checkpoints.

A row per sequence. ``codes`` has one number for each symbol, from 1 in order of first appearance; ``checkpoints`` has, for
every ``step`` symbols, how often each code stands before. The step grows with the alphabet, so checkpoints take no more
bytes than there are symbols. A rank reads one checkpoint and less than a step of codes; opening a row copies nothing.

Texts that are NULL are not stored. Positions outside a sequence and symbols that it lacks have the results that their
functions state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import rows as R
from textquarry.operators import suffixes
from textquarry.sources import tables

FORMAT_VERSION = 1
STEP = 512
#: Codes that a rank of many places compares at once.
COMPARED = 1 << 22


class Ranks:
    """A stored sequence, opened. Code 0 may occur: in a transform it is the end mark."""

    def __init__(self, codes: bytes, checkpoints: bytes, length: int):
        self.n, self.raw = length, codes
        self.codes = np.frombuffer(codes, f"<u{len(codes) // length}") if length else np.zeros(0, np.uint8)
        self.narrow = self.codes.itemsize == 1
        head = np.frombuffer(checkpoints, "<u4", 2)
        self.step, self.sigma = int(head[0]), int(head[1])
        self.before = np.frombuffer(checkpoints, "<u4", offset=8).reshape(-1, self.sigma)

    @staticmethod
    def stored(codes: np.ndarray, sigma: int) -> tuple[bytes, bytes]:
        """codes below ``sigma`` -> the two binaries."""
        step = max(STEP, 4 * sigma)
        kind = np.uint8 if sigma <= 256 else np.uint16 if sigma <= 65536 else np.uint32
        packed = codes.astype(kind)
        blocks = -(-len(packed) // step)
        before = np.zeros((blocks + 1, sigma), np.uint32)
        if blocks:
            counts = np.bincount(np.arange(len(packed)) // step * sigma + codes, minlength=blocks * sigma)
            before[1:] = np.cumsum(counts.reshape(blocks, sigma), axis=0)
        return packed.astype(packed.dtype.newbyteorder("<")).tobytes(), np.array([step, sigma], "<u4").tobytes() + before.astype("<u4").tobytes()

    def rank(self, code: int, place: int) -> int:
        """Occurrences of ``code`` before ``place``; 0 for codes that the sequence lacks, places beyond its ends are its ends."""
        if not 0 <= code < self.sigma or place <= 0:
            return 0
        place = min(place, self.n)
        k = place // self.step
        start = k * self.step
        inside = self.raw.count(code, start, place) if self.narrow else int(np.count_nonzero(self.codes[start:place] == code))
        return int(self.before[k, code]) + inside

    def rank_many(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """rank() of pairs; codes occur, places are within 0 and the length."""
        out = np.empty(len(places), np.int64)
        for a in range(0, len(places), max(1, COMPARED // self.step)):
            c, p = codes[a : a + COMPARED // self.step], places[a : a + COMPARED // self.step]
            k = p // self.step
            start = k * self.step
            width = int((p - start).max(initial=0))
            near = np.minimum(start[:, None] + np.arange(width), self.n - 1)
            inside = (self.codes[near] == c[:, None]) & (np.arange(width) < (p - start)[:, None])
            out[a : a + len(p)] = self.before[k, c] + inside.sum(axis=1)
        return out

    def select(self, code: int, i: int) -> int | None:
        """Place of the i-th occurrence, from 1."""
        if not 0 <= code < self.sigma or not 1 <= i <= self.before[-1, code]:
            return None
        k = int(np.searchsorted(self.before[:, code], i, "left")) - 1
        start = k * self.step
        return start + int(np.flatnonzero(self.codes[start : start + self.step] == code)[i - int(self.before[k, code]) - 1])


_SCHEMA = "format_version int, length long, alphabet string, codes binary, checkpoints binary"


def build_ranks(docs: DataFrame, seq_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seq_id, format_version, length, alphabet, codes, checkpoints), without a shuffle."""
    rows = docs.select(F.col(seq_id).alias("seq_id"), F.col(text).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["seq_id", *[c.split()[0] for c in _SCHEMA.split(", ")]], [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        for part in R.parts(batches):
            made = []
            for t in part.column("text").to_pylist():
                codes, symbols = suffixes.first_appearance(suffixes.code_points(t))
                made.append((FORMAT_VERSION, len(codes), suffixes.to_text(symbols), *Ranks.stored(codes, len(symbols) + 1)))
            yield pa.RecordBatch.from_arrays([part.column("seq_id"), *[pa.array(v, kind) for v, kind in zip(zip(*made, strict=True), kinds, strict=True)]], names=names)

    return rows.mapInArrow(run, f"seq_id {rows.schema['seq_id'].dataType.simpleString()}, {_SCHEMA}")


def save_ranks(ranks: DataFrame, path: str) -> None:
    tables.save(ranks, path, FORMAT_VERSION)


def load_ranks(spark: SparkSession, path: str) -> DataFrame:
    return tables.load(spark, path, FORMAT_VERSION)


#: Questions to one stored row that are answered together.
TOGETHER = 1 << 16
#: Answers after which a batch of them goes out.
MADE = 20_000


def asked(stored: DataFrame, at: DataFrame, key: str, given: list[str], answer: Callable[[dict, list[tuple]], list[tuple]], columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """``at`` (key, given...) with ``columns``: the answers of the stored rows. Questions go to the rows they concern, some
    TOGETHER at a time; those to keys that are not stored have none. ``given`` and answers hold no nulls but as stated."""
    names = [c.split()[0] for c in columns.split(", ")]
    # keys with more questions than that are dealt to several groups; there is one row here for TOGETHER questions at most
    crowded = at.groupBy(F.col(key).alias("_key")).count().where(F.col("count") > TOGETHER).select("_key", F.ceil(F.col("count") / TOGETHER).alias("_parts"))
    dealt = at.select(key, *given).join(F.broadcast(crowded), F.col(key) == F.col("_key"), "left")
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)))
    asks = dealt.withColumn("_part", part).groupBy(key, "_part").agg(F.collect_list(F.struct(*given)).alias("_asked")).drop("_part")
    both = stored.join(asks, key)
    types = {c: at.schema[c].dataType.simpleString() for c in (key, *given)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in R.parts(batches):
            lists, needed = part.column("_asked"), [c for c in part.schema.names if c != "_asked"]
            found, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
            questions = list(zip(*[found.field(c).to_pylist() for c in given], strict=True))
            made, done = [], 0
            for k, row in enumerate(zip(*[part.column(c).to_pylist() for c in needed], strict=True)):
                made += answer(dict(zip(needed, row, strict=True)), questions[len(made) + done : ends[k]])
                if len(made) > MADE or k == part.num_rows - 1:
                    asked_here = found.slice(done, len(made))
                    which = pa.array(np.searchsorted(ends, np.arange(done, done + len(made)), "right"))
                    yield pa.RecordBatch.from_arrays([part.column(key).take(which), *[asked_here.field(c) for c in given], *[pa.array([m[j] for m in made], kind) for j, kind in enumerate(kinds)]], names=[key, *given, *names])
                    made, done = [], done + len(made)

    return both.mapInArrow(run, ", ".join([*[f"{c} {t}" for c, t in types.items()], columns]))


def _opened(row: dict) -> Ranks:
    return Ranks(row["codes"], row["checkpoints"], row["length"])


def rank_at(ranks: DataFrame, at: DataFrame) -> DataFrame:
    """at(seq_id, pos, symbol) with rank: the symbol's occurrences before the position; beyond the ends, up to the end."""

    def answer(row: dict, questions: list[tuple]) -> list[tuple]:
        opened, alphabet = _opened(row), row["alphabet"]
        return [(opened.rank(code, pos) if (code := alphabet.find(symbol) + 1) and len(symbol) == 1 else 0,) for pos, symbol in questions]

    return asked(ranks, at, "seq_id", ["pos", "symbol"], answer, "rank long", [pa.int64()])


def inverse_select_at(ranks: DataFrame, at: DataFrame) -> DataFrame:
    """at(seq_id, pos) with the symbol at the position and its rank there; NULLs outside the sequence."""

    def answer(row: dict, questions: list[tuple]) -> list[tuple]:
        opened, out = _opened(row), []
        for (pos,) in questions:
            if 0 <= pos < opened.n:
                code = int(opened.codes[pos])
                out.append((row["alphabet"][code - 1], opened.rank(code, pos)))
            else:
                out.append((None, None))
        return out

    return asked(ranks, at, "seq_id", ["pos"], answer, "symbol string, rank long", [pa.string(), pa.int64()])


def select_at(ranks: DataFrame, at: DataFrame) -> DataFrame:
    """at(seq_id, symbol, i) with pos: that of the i-th occurrence, from 1; NULL where there are fewer."""

    def answer(row: dict, questions: list[tuple]) -> list[tuple]:
        opened, alphabet = _opened(row), row["alphabet"]
        return [(opened.select(code, i) if (code := alphabet.find(symbol) + 1) and len(symbol) == 1 else None,) for symbol, i in questions]

    return asked(ranks, at, "seq_id", ["symbol", "i"], answer, "pos long", [pa.int64()])
