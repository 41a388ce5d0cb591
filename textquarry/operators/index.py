"""A compressed, versioned index for each document that answers count, locate and extract without the text.

One row per document: the Burrows-Wheeler transform as codes in order of first appearance (0 is the end mark), with how
often each code stands before every checkpoint (:mod:`ranks`), the alphabet, and samples of the suffix array. Opening a row
copies and sorts nothing: a pattern of m symbols costs 2 m ranks, a location at most ``sample_rate`` steps, a slice as many
for all its stretches together. Rows are independent, so indexes are built, stored and searched as any other table; a
query reads only the columns that it needs. Documents whose text is NULL have no index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import rows as R
from textquarry.operators import suffixes
from textquarry.operators.ranks import Ranks, asked
from textquarry.operators.search import sliced
from textquarry.sources import tables
from textquarry.sources.tables import check_version  # noqa: F401

FORMAT_VERSION = 2
SAMPLE_RATE = 32
_SCHEMA = (
    "format_version int, sample_rate int, extraction boolean, input_length long, alphabet_length long, alphabet string, "
    "bwt binary, checkpoints binary, sampled_rows binary, sampled_positions binary, position_rows binary, content_hash long"
)
_TYPES = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
#: Columns that a count reads; a location reads the samples as well, an extraction the rows of sampled positions.
COUNTED = ["input_length", "alphabet", "bwt", "checkpoints"]
LOCATED = [*COUNTED, "sample_rate", "sampled_rows", "sampled_positions"]
EXTRACTED = [*COUNTED, "sample_rate", "extraction", "position_rows"]
#: Symbols that an extraction up to a boundary first looks at; twice as many each time after.
LOOK = 64
#: Symbols of a text for which all positions take no longer than some: a round of steps costs more than its rows.
UNFOLDED = 1 << 14


def build_row(text: str, rate: int, extraction: bool) -> tuple:
    codes, alphabet = suffixes.first_appearance(suffixes.code_points(text))
    order = suffixes.suffix_array(codes)
    column = suffixes.bwt_codes(codes, order)
    stored, checkpoints = Ranks.stored(column, len(alphabet) + 1)
    rows = np.flatnonzero(order % rate == 0)
    at = np.empty(len(rows), np.int64)
    at[order[rows] // rate] = rows
    symbols = suffixes.to_text(alphabet)
    digest = zlib.crc32(stored, zlib.crc32(symbols.encode("utf-8", "surrogatepass")))
    return FORMAT_VERSION, rate, extraction, len(codes) + 1, len(set(symbols) | {"\0"}), symbols, stored, checkpoints, rows.astype("<u4").tobytes(), order[rows].astype("<u4").tobytes(), at.astype("<u4").tobytes() if extraction else None, digest


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rate: int = SAMPLE_RATE, extraction: bool = True) -> DataFrame:
    """The index table; the sample rate trades size for the steps of a location and never changes an answer."""
    if sample_rate < 1:
        raise ValueError("the sample rate is at least 1")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *[c.split()[0] for c in _SCHEMA.split(", ")]]
        for part in R.parts(batches):
            made = [build_row(t, sample_rate, extraction) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(v, kind) for v, kind in zip(zip(*made, strict=True), _TYPES, strict=True)]], names=names)

    return R.spread(rows, F.xxhash64("doc_id", "text")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def save_index(index: DataFrame, path: str) -> None:
    tables.save(index, path, FORMAT_VERSION)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Refuses an index of another format version."""
    return tables.load(spark, path, FORMAT_VERSION)


class Patterns:
    """Patterns for :meth:`Index.ranges`: one array of numbers of their symbols, and where each pattern ends."""

    def __init__(self, patterns: list[str]):
        points = suffixes.code_points("".join(patterns))
        symbols, codes = np.unique(points, return_inverse=True)
        self.symbols, self.codes = suffixes.to_text(symbols), codes
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.ends = np.cumsum(self.lengths)


class Index:
    """One document's index, opened."""

    def __init__(self, row: dict):
        self.alphabet, n = row["alphabet"], row["input_length"]
        self.ranks = Ranks(row["bwt"], row["checkpoints"], n)
        self.column, self.n = self.ranks.codes, n - 1
        totals = self.ranks.before[-1].astype(np.int64)
        self.first = np.cumsum(totals) - totals
        self.rate, self.extraction = row.get("sample_rate"), row.get("extraction", False)
        self.rows, self.positions, self.position_rows = (np.frombuffer(row[c], "<u4").astype(np.int64) if row.get(c) is not None else None for c in ("sampled_rows", "sampled_positions", "position_rows"))
        self._lf, self._spent, self._text, self._slices, self._keys, self._array = None, 0, None, 0, None, None

    def before(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer."""
        if self._lf is not None:
            return self._lf[rows]
        codes = self.column[rows]
        return self.first[codes] + self.ranks.rank_many(codes, rows)

    def _prepare(self, rows: int) -> None:
        """Once the steps asked for have cost what a sort of the transform does, all rows are taken from one. In
        microseconds, a round of steps takes some twenty and half of one for each row, the sort a hundredth for each symbol."""
        self._spent += 20 * self.rate + rows // 2
        if self._lf is None and 100 * self._spent > len(self.column):
            self._lf = suffixes.last_to_first(self.column)

    def _unfolded(self) -> np.ndarray:
        """The suffix array: from each sampled position, and from the text's end, back to the sample before, side by side."""
        if self._array is None:
            self._array = np.empty(len(self.column), np.int64)
            rows, at = np.append(self.rows, 0), np.append(self.positions, self.n)
            self._array[rows] = at
            rows, at = rows[at > 0], at[at > 0]
            for _ in range(min(self.rate - 1, self.n)):
                rows, at = self._lf[rows], at - 1
                self._array[rows] = at
        return self._array

    def range(self, pattern: str) -> tuple[int, int]:
        """Rows of the suffixes that begin with the pattern: backward search."""
        if not pattern:
            raise ValueError("the pattern is empty")
        low, high = 0, len(self.column)
        for c in reversed(pattern):
            code = self.alphabet.find(c) + 1
            if not code:
                return 0, 0
            start = int(self.first[code])
            low, high = start + self.ranks.rank(code, low), start + self.ranks.rank(code, high)
            if low >= high:
                return 0, 0
        return low, high

    def ranges(self, patterns: Patterns) -> Iterator[tuple[int, int, int]]:
        """(number, first row, row after the last) of the patterns that occur: backward search for all of them side by side. In
        the transform sorted by code and row, a row's place is where its longer suffix stands."""
        if self._keys is None:
            order = suffixes.by_symbol(self.column, self.ranks.sigma)
            self._keys = self.column[order] * np.int64(len(order) + 1) + order
        code = np.array([self.alphabet.find(c) + 1 for c in patterns.symbols], np.int64)
        open_, ends = np.arange(len(patterns.ends)), patterns.ends
        low, high, step = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.column)), 0
        while len(open_):
            at = code[patterns.codes[ends - step - 1]]
            low, high = (np.searchsorted(self._keys, at * (len(self.column) + 1) + x) for x in (low, high))
            live = (at > 0) & (low < high)
            open_, ends, low, high = open_[live], ends[live], low[live], high[live]
            step += 1
            full = patterns.lengths[open_] == step
            if full.any():
                yield from zip(open_[full].tolist(), low[full].tolist(), high[full].tolist(), strict=True)
                open_, ends, low, high = open_[~full], ends[~full], low[~full], high[~full]

    def count(self, pattern: str) -> int:
        low, high = self.range(pattern)
        return high - low

    def locate(self, pattern: str, limit: int | None = None, order: str = "position") -> list[int]:
        """Positions; with ``order="code"`` in suffix order, as the rows come."""
        return self.places(*self.range(pattern), limit, order)

    def places(self, low: int, high: int, limit: int | None = None, order: str = "position") -> list[int]:
        """Positions of the rows from ``low`` to ``high``."""
        if low >= high:
            return []
        if order == "code" and limit is not None:
            high = min(high, low + limit)
        self._prepare((high - low) * self.rate // 2)
        if self._lf is not None and len(self.column) < UNFOLDED + 8 * (high - low) * self.rate:
            out = self._unfolded()[low:high].tolist()
            return out if order == "code" else sorted(out)[:limit]
        at, out = np.arange(low, high), np.full(high - low, -1)
        open_, steps = np.arange(high - low), 0
        while len(open_):
            here = at[open_]
            place = np.minimum(np.searchsorted(self.rows, here), len(self.rows) - 1)
            known = self.rows[place] == here
            out[open_[known]] = self.positions[place[known]] + steps
            open_ = open_[~known]
            at[open_] = self.before(at[open_])
            steps += 1
        out = out.tolist()
        return out if order == "code" else sorted(out)[:limit]

    def extract(self, start: int, stop: int) -> str:
        """``text[start:stop)``: the stretches between sampled positions are decoded side by side. Many slices of one text
        take the whole of it from the index once."""
        # fixed values: the messages that callers match
        if not self.extraction:
            raise ValueError("Text recovery not enabled at build time")
        if start < 0:
            raise ValueError("Requested position less than 0")
        if stop > self.n:
            raise ValueError("Stop position longer than index string")
        if stop <= start:
            return ""
        if self._text is None:
            # a slice takes rate rounds however short it is, so after so many of them the whole text costs no more
            self._slices += 1
            if self._slices * 512 * self.rate < self.n:
                return self._decoded(start, stop)
            self._text = self._decoded(0, self.n)
        return self._text[start:stop]

    def _decoded(self, start: int, stop: int) -> str:
        begins = np.arange(start // self.rate * self.rate, stop, self.rate)
        ends = np.minimum(begins + self.rate, self.n)
        self._prepare(stop - start)
        # row 0 is the empty suffix
        rows = np.where(ends == self.n, 0, self.position_rows[np.minimum(ends // self.rate, len(self.position_rows) - 1)])
        width = int((ends - begins).max())
        out = np.empty((width, len(begins)), self.column.dtype)
        for j in range(width - 1, -1, -1):
            out[j] = self.column[rows]
            rows = self.before(rows) if j else rows
        codes = out.T.ravel()
        short = width - int(ends[-1] - begins[-1])
        if short:  # the last stretch, which ends with the text, went on beyond its begin
            codes = np.delete(codes, slice(len(codes) - width, len(codes) - width + short))
        codes = codes[start - begins[0] : stop - begins[0]]
        return suffixes.to_text(suffixes.code_points(self.alphabet)[codes.astype(np.int64) - 1])

    def until(self, position: int, boundary: str, side: str = "both", strict: bool = False) -> str | None:
        """What stands around a position up to the boundary symbol or the text's ends; ``left`` up to and with the position,
        ``right`` from the next on. Empty where the boundary stands there itself; None outside the text, or an error."""
        if strict and not 0 <= position < self.n:
            raise ValueError("Requested position less than 0" if position < 0 else "Requested position longer than index string")
        if strict and boundary not in self.alphabet:
            raise ValueError("Boundary does not exist")
        if not 0 <= position < self.n:
            return None
        here = self.extract(position, position + 1)
        if here == boundary:
            return ""
        left = right = ""
        if side != "right":
            stop, look, left = position, LOOK, here
            while stop > 0:
                part = self.extract(max(0, stop - look), stop)
                cut = part.rfind(boundary)
                left = part[cut + 1 :] + left
                stop, look = (0 if cut >= 0 else max(0, stop - look)), 2 * look
        if side != "left":
            start, look = position + 1, LOOK
            while start < self.n:
                part = self.extract(start, min(self.n, start + look))
                cut = part.find(boundary)
                right += part if cut < 0 else part[:cut]
                start, look = (self.n if cut >= 0 else start + look), 2 * look
        return left + right


def _answers(index: DataFrame, ask, needed: list[str], columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """doc_id and the rows that ``ask`` gives for each opened index."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in R.parts(batches):
            which, held = [], []
            for k, row in enumerate(zip(*[batch.column(c).to_pylist() for c in needed], strict=True)):
                made = ask(Index(dict(zip(needed, row, strict=True))))
                which += [k] * len(made)
                held += made
                if len(held) > 20_000:
                    yield batch_of(batch, which, held)
                    which, held = [], []
            yield batch_of(batch, which, held)

    def batch_of(batch, which, held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which, pa.int64())), *[pa.array([m[j] for m in held], kind) for j, kind in enumerate(kinds)]], names=["doc_id", *names])

    return index.select("doc_id", *needed).mapInArrow(run, f"doc_id {index.schema['doc_id'].dataType.simpleString()}, {columns}")


def count(index: DataFrame, patterns: list[str]) -> DataFrame:
    """(doc_id, pattern, n) of patterns that occur."""
    return _answers(index, lambda i: [(p, n) for p in patterns if (n := i.count(p))], COUNTED, "pattern string, n long", [pa.string(), pa.int64()])


def locate(index: DataFrame, pattern: str, limit: int | None = None, order: str = "position") -> DataFrame:
    return _answers(index, lambda i: [(x,) for x in i.locate(pattern, limit, order)], LOCATED, "pos long", [pa.int64()])


def extract(index: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """(doc_id, text) of the slice, up to the end where ``stop`` is None or beyond."""
    return _answers(index, lambda i: [(i.extract(min(start, i.n), i.n if stop is None else min(stop, i.n)),)], EXTRACTED, "text string", [pa.string()])


def _of_table(index: DataFrame, patterns: DataFrame, pattern_id: str, pattern: str, needed: list[str], ask, columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """What ``ask(index, first row, row after the last)`` gives for each pattern of a table that has rows; it is broadcast in slices of bounded size."""
    spark, out = index.sparkSession, None
    kind = patterns.schema[pattern_id].dataType.simpleString()
    ids = pa.array([], pa.int64()) if kind == "bigint" else pa.array([], pa.int32()) if kind == "int" else pa.array([], pa.string())
    for some in sliced(patterns, pattern_id, pattern):
        sent = spark.sparkContext.broadcast(([k for k, _ in some], Patterns([p for _, p in some])))
        part = _answers(index, lambda i, sent=sent: [(sent.value[0][k], *m) for k, low, high in i.ranges(sent.value[1]) for m in ask(i, low, high)], needed, f"pattern_id {kind}, {columns}", [ids.type, *kinds])
        out = part if out is None else out.unionByName(part)
    return out


def count_table(index: DataFrame, patterns: DataFrame, pattern_id: str = "pattern_id", pattern: str = "pattern") -> DataFrame:
    """(doc_id, pattern_id, n) of the patterns that occur; ids are integers or strings, empty and null patterns are passed over."""
    return _of_table(index, patterns, pattern_id, pattern, COUNTED, lambda i, low, high: [(high - low,)], "n long", [pa.int64()])


def locate_table(index: DataFrame, patterns: DataFrame, limit: int | None = None, chars: int | None = None, pattern_id: str = "pattern_id", pattern: str = "pattern") -> DataFrame:
    """(doc_id, pattern_id, pos) of the first ``limit`` matches of each pattern; with ``chars`` also extract, so many symbols from there on."""
    if chars is None:
        return _of_table(index, patterns, pattern_id, pattern, LOCATED, lambda i, low, high: [(x,) for x in i.places(low, high, limit)], "pos long", [pa.int64()])
    ask = lambda i, low, high: [(x, i.extract(x, min(i.n, x + chars))) for x in i.places(low, high, limit)]
    return _of_table(index, patterns, pattern_id, pattern, list(dict.fromkeys(LOCATED + EXTRACTED)), ask, "pos long, extract string", [pa.int64(), pa.string()])


def grep(index: DataFrame, pattern: str, boundary: str = "\n", side: str = "both", limit: int | None = None) -> DataFrame:
    """(doc_id, pos, record): what stands around each match up to the boundary. ``right`` gives the text from the match on,
    as a value after its key."""
    def ask(i: Index) -> list[tuple]:
        found = i.locate(pattern, limit)
        if side != "right":
            return [(x, i.until(x, boundary, side)) for x in found]
        return [(x, "" if (c := i.extract(x, x + 1)) == boundary else c + i.until(x, boundary, side)) for x in found]

    return _answers(index, ask, list(dict.fromkeys(LOCATED + EXTRACTED)), "pos long, record string", [pa.int64(), pa.string()])


def extract_at(index: DataFrame, at: DataFrame) -> DataFrame:
    """at(doc_id, start, stop) with the text of each slice; NULL where it is not within the text."""

    def answer(row: dict, questions: list[tuple]) -> list[tuple]:
        i = Index(row)
        return [(i.extract(a, b) if a is not None and b is not None and 0 <= a <= b <= i.n else None,) for a, b in questions]

    return asked(index.select("doc_id", *EXTRACTED), at, "doc_id", ["start", "stop"], answer, "text string", [pa.string()])


def until_at(index: DataFrame, at: DataFrame, boundary: str, side: str = "both", strict: bool = False) -> DataFrame:
    """at(doc_id, pos) with the record around each position; see :meth:`Index.until`."""

    def answer(row: dict, questions: list[tuple]) -> list[tuple]:
        i = Index(row)
        return [(i.until(p, boundary, side, strict),) for (p,) in questions]

    return asked(index.select("doc_id", *EXTRACTED), at.where("pos is not null"), "doc_id", ["pos"], answer, "record string", [pa.string()])


def describe(index: DataFrame) -> DataFrame:
    return index.select("doc_id", F.concat(F.lit("Index-sampleRate:"), "sample_rate", F.lit("-extract:"), F.col("extraction").cast("string")).alias("description"))


def serialized_size(index: DataFrame) -> DataFrame:
    """Bytes of each index before the file format's compression."""
    columns = ("bwt", "checkpoints", "sampled_rows", "sampled_positions", "position_rows", "alphabet")
    return index.select("doc_id", sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in columns).cast("long").alias("bytes"))
