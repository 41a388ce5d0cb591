"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows of words.

A word is a run of ``0-9``, ``a-z`` (after lower-casing ``A-Z``) and non-ASCII characters. Normalisation keeps one
byte for each byte of the text, so the words' offsets are those of the original. The automaton reads two symbols a word
instead of its letters, which keeps it small; a benchmark beyond ``NODES`` is cut into slices, one pass over the text each.

Null texts have no words. Benchmark rows without an id or without words have no windows; rows that repeat an id add
to the same item. Empty tables give empty results, or documents without hits. Columns of the documents are kept; where
a name clashes with an output column, the output stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import carried, kept, lean, uncarried, utf8

WINDOW = 10
#: Nodes of one automaton at most, about 51 bytes each; a larger benchmark is scanned for in several passes. A window of ten
#: words takes up to twenty.
NODES = 4_000_000
#: Distinct words of a slice at most.
VOCABULARY = (1 << 16) - 1

_BLANKS = bytes(c if c >= 0x80 or chr(c).isascii() and chr(c).isalnum() and not chr(c).isupper() else 0x20 for c in range(256))
_OUT = "n_words long, hit_runs array<struct<first:long,last:long>>, hit_spans array<struct<start:long,stop:long>>, item_ids array<string>"
_OUTPUTS = ["n_words", "hit_runs", "hit_spans", "item_ids"]


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_BLANKS).split()


class Windows:
    """One automaton over the windows of a few items, in symbols for words.

    A word of the items is a number below VOCABULARY, spelt as two symbols from ranges of 256 that do not meet, so no match
    begins within a word and no node has many children; all other words are number 0.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[str, tuple[int, set[str]]] = {}
        for item, w in items:
            line = spelt([self.numbers.setdefault(x, len(self.numbers) + 1) for x in w])
            for i in range(max(1, len(w) - width + 1) if w else 0):
                owners.setdefault(line[2 * i : 2 * (i + width)], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, found in owners.items():
            self.automaton.add_word(window, (len(window) // 2, tuple(found)))
        if owners:
            self.automaton.make_automaton()

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words as half-open ranges, and the items found."""
        if not w or not len(self.automaton):
            return [], set()
        number = self.numbers.get
        found = list(self.automaton.iter(spelt([number(x, 0) for x in w])))
        return merged([(end // 2 + 1 - n, end // 2 + 1) for end, (n, _) in found]), {i for _, (_, items) in found for i in items}


def spelt(numbers: list[int]) -> str:
    n = np.array(numbers, np.uint16)
    return np.stack((n >> 8, 256 + (n & 255)), axis=1).astype("<u2").tobytes().decode("utf-16-le")


def slices(items: Iterator[tuple[str, bytes]], width: int, nodes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups whose automata have ``nodes`` nodes and VOCABULARY words at most; a long item is cut into overlapping pieces."""
    most = max(1, nodes // (2 * width))  # windows
    held, n, vocabulary = [], 0, set()
    for item, text in items:
        w = words(text)
        for a in range(0, max(1, len(w) - width + 1) if w else 0, min(most, VOCABULARY // 2)):
            piece = w[a : a + min(most, VOCABULARY // 2) + width - 1]
            new = set(piece) - vocabulary
            if held and (n + max(1, len(piece) - width + 1) > most or len(vocabulary) + len(new) > VOCABULARY):
                yield held
                held, n, vocabulary, new = [], 0, set(), set(piece)
            held.append((item, piece))
            n += max(1, len(piece) - width + 1)
            vocabulary |= new
    yield held


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the text of runs of words."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(text.lower().translate(_BLANKS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(point[edges[2 * a]]), int(point[edges[2 * b - 1]])) for a, b in runs]


def _pass(items, width: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = kept(("automaton", items.id, width), lambda: Windows(items.value, width))
        for batch in batches:
            texts = utf8(batch.column("_text"))
            n, runs, spans, ids = [], [], [], []
            old = zip(*([None] * len(texts), [None] * len(texts)) if first else (batch.column(c).to_pylist() for c in ("hit_runs", "item_ids")), strict=True)
            for text, (old_runs, old_ids) in zip(texts, old, strict=True):
                w = words(text)
                r, found = built.find(w)
                r = merged(r + [(x["first"], x["last"] + 1) for x in old_runs or ()])
                n.append(len(w))
                runs.append([{"first": a, "last": b - 1} for a, b in r])
                spans.append([{"start": a, "stop": b} for a, b in original_spans(text, r)] if r else [])
                ids.append(sorted(found | set(old_ids or ())))
            two = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_text"), pa.array(n, pa.int64()), pa.array(runs, two("first", "last")), pa.array(spans, two("start", "stop")), pa.array(ids, pa.list_(pa.string()))],
                names=["_row", "_text", *_OUTPUTS],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, nodes: int = NODES) -> DataFrame:
    """``docs`` with n_words, hit_runs (word ranges), hit_spans (code-point ranges of the original) and item_ids.

    The benchmark streams through the driver in slices whose automata have ``nodes`` nodes at most; each is broadcast, and
    takes one pass over the text, so neither the driver's memory nor a worker's grows with the benchmark.
    """
    spark = docs.sparkSession
    df = carried(docs, _text=F.col(text))
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    items = ((r["i"], r["t"].encode()) for r in rows.toLocalIterator(prefetchPartitions=False))
    schema = f"_row {df.schema['_row'].dataType.simpleString()}, _text string, {_OUT}"
    for k, some in enumerate(slices(items, window, nodes)):
        sent = spark.sparkContext.broadcast(some)
        df = df.mapInArrow(lean(_pass(_Sent(sent, k), window, k == 0), keeps=True), _schema(df, schema))
    return uncarried(df, docs.columns, _OUTPUTS)


def _schema(df: DataFrame, text: str):
    """The DDL's types with the carried row's own type, whose names may need quoting."""
    from pyspark.sql import types as T

    rest = T.StructType.fromDDL(text.partition("_text")[1] + text.partition("_text")[2])
    return T.StructType([df.schema["_row"], *rest.fields])


class _Sent:
    """A broadcast with a name by which a worker keeps what it has built from it."""

    def __init__(self, sent, k: int):
        self.sent, self.id = sent, f"{sent._jbroadcast.id() if sent._jbroadcast else 0}-{k}"

    @property
    def value(self):
        return self.sent.value


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from what :func:`decontaminate` found."""
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return docs.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "hit_spans",
    )
