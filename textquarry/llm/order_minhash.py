"""Order MinHash document fingerprints.

The k-mers of a text (code points) carry the number of their occurrence, so a repeated k-mer is several elements. For
each of ``SLOTS`` hash functions the ``TUPLE`` elements of least hash are selected, put back into text order, and hashed
as a tuple: two signatures agree in a slot where the texts share the elements *and* their order, which edits disturb as
they disturb edit distance.

Every slot's function is applied to every element, in blocks of ``BLOCK``. A text shorter than
``K`` is one k-mer. Null texts are empty; an empty text has zeros, which are like only zeros.

Neighbours: the next document is that of the next greater id; after the last comes the first. Rows that repeat an id
follow each other in the order of XXH64 of their texts (equal rows lie in one shard, which is streamed); rows without an id
come first. One document is its own next. Shards of
neighbouring ids are streamed in order, each with the first document of the shard that follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import by_shard, carried, layout, mix64, placed, runs_of, uncarried

K = 6
SLOTS = 64
TUPLE = 2
#: Elements that are ranked at once.
BLOCK = 4096
ROWS_PER_SHARD = 4096
_U = np.uint64
_SEEDS = (np.arange(1, SLOTS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))[:, None]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def kmer_hashes(points: np.ndarray) -> np.ndarray:
    """One hash for each k-mer; of a shorter text, one for the whole."""
    if not len(points):
        return np.zeros(0, _U)
    if len(points) < K:
        return mix64(np.frombuffer(hashlib.blake2b(points.tobytes(), digest_size=8).digest(), _U))
    h = mix64(points.astype(_U))
    two = h[:-1] * _U(0xC2B2AE3D27D4EB4F) + h[1:]
    four = two[:-2] * _U(0x165667B19E3779F9) + two[2:]
    return mix64(four[:-2] * _U(0xD6E8FEB86659FD93) + two[4:])


#: Elements are mixed already, so a slot ranks them by a product with an odd number of its own.
_FACTORS = mix64(_SEEDS) | _U(1)


def elements(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of every k-mer with its occurrence number."""
    n = len(h)
    at = np.argsort(h, kind="stable")
    values = h[at]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    number = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return mix64(values * _U(0x9FB21C651E98DF25) + number.astype(_U)), at


def signature(h: np.ndarray) -> np.ndarray:
    """SLOTS 16-bit values from k-mer hashes in text order."""
    n = len(h)
    if not n:
        return np.zeros(SLOTS, np.uint16)
    element, at = elements(h)
    rows, most = np.arange(SLOTS), np.iinfo(_U).max
    ranks, places = np.full((SLOTS, 4), most), np.zeros((SLOTS, 4), np.int64)
    for i in range(0, n, BLOCK):
        found = element[None, i : i + BLOCK] * _FACTORS
        # the two least so far, then the block's two least
        for k in (2, 3):
            least = found.argmin(axis=1)
            ranks[:, k], places[:, k] = found[rows, least], least + i
            found[rows, least] = most
        by = np.argsort(ranks, axis=1, kind="stable")[:, :2]
        ranks[:, :2], places[:, :2] = np.take_along_axis(ranks, by, 1), np.take_along_axis(places, by, 1)
    one, two = places[:, 0], places[:, 1]
    if n == 1:
        picked = element[one]
    else:
        swap = at[one] > at[two]  # text order
        a, b = np.where(swap, two, one), np.where(swap, one, two)
        picked = mix64(element[a]) * _U(3) + element[b]
    out = (mix64(picked ^ _SEEDS[:, 0]) >> _U(48)).astype(np.uint16)
    return np.maximum(out, 1)


def fingerprint(text: str) -> str:
    return to_text(signature(kmer_hashes(code_points(text))))


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with fingerprint."""
    df = carried(docs, _text=F.coalesce(F.col(text), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array([fingerprint(t) for t in batch["_text"].to_pylist()], pa.string())], names=["_row", "fingerprint"])

    from pyspark.sql import types as T

    return uncarried(df.mapInArrow(run, T.StructType([df.schema["_row"], T.StructField("fingerprint", T.StringType())])), docs.columns, ["fingerprint"])


class _Document:
    def __init__(self, doc_id, text: str):
        self.id, self.points = doc_id, code_points(text)
        self.hashes = kmer_hashes(self.points)
        self.sig = signature(self.hashes)

    def edited(self, other: "_Document") -> tuple[str, np.ndarray]:
        """SHA-256 and signature of this text with its last quarter replaced by the other's first characters."""
        n = len(self.points)
        cut = n // 4
        start, tail = self.points[: n - cut], other.points[:cut]
        text = np.concatenate((start, tail))
        digest = hashlib.sha256(text.tobytes().decode("utf-32-le").encode()).hexdigest()
        if len(start) < K or len(tail) < K:
            return digest, signature(kmer_hashes(text))
        seam = kmer_hashes(text[len(start) - K + 1 : len(start) + K - 1])
        return digest, signature(np.concatenate((self.hashes[: len(start) - K + 1], seam, other.hashes[: len(tail) - K + 1])))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    shard, held, closed = None, None, False

    def out() -> pa.RecordBatch:
        nonlocal rows
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _OUT.split(", ")])
        rows = []
        return made

    for at, part in runs_of(batches, "_shard"):
        if at != shard:
            shard, held, closed = at, None, False
        for doc_id, text, after in zip(*(part[c].to_pylist() for c in ("doc_id", "text", "_after")), strict=True):
            if closed:  # further rows with the id of the next shard's first document
                continue
            new = _Document(doc_id, text)
            if held is not None:
                digest, sig = held.edited(new)
                rows.append((held.id, len(held.points), digest, to_text(held.sig), to_text(sig), likeness(held.sig, sig), likeness(held.sig, new.sig)))
            held, closed = new, after
            if len(rows) >= 500:
                yield out()
    yield out()


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    opens = layout(rows, "doc_id", "_tie", ROWS_PER_SHARD)
    n = len(opens)
    shaped = placed(rows, "doc_id", "_tie", opens)
    # The first row of each shard also ends the shard before it.
    own = F.struct(F.col("_shard").alias("_shard"), F.lit(False).alias("_after"))
    before = F.when(F.col("_opens"), F.struct(F.pmod(F.col("_shard") - F.col("_twins"), F.lit(n)).alias("_shard"), F.lit(True).alias("_after")))
    both = shaped.withColumn("k", F.explode(F.array_compact(F.array(own, before)))).select("k._shard", "k._after", "doc_id", "_tie", "text")
    return by_shard(both, n, "_after", "doc_id", "_tie").mapInArrow(_stream, _OUT)
