"""SimHash near-duplicates: 64-bit fingerprints, compared exactly in tiles.

Words are runs of bytes other than space and \\t-\\r after lower-casing A-Z; shingles of ``width`` words, repeats
included, are hashed by XXH64 (seed 42). A bit is set where over half of the hashes have it.

Distinct fingerprints are put into tiles by the population counts of their four 16-bit quarters. Fingerprints within
``radius`` bits lie in tiles whose counts differ by ``radius`` in sum at most, so a tile meets itself and those
neighbours only; within, numpy compares blocks by exclusive-or and bit counts. A tile with more fingerprints, or more to
meet, than ``TILE`` is divided into blocks and groups of guests, so a task's work is bounded. Copies never multiply the
work: a fingerprint counts once. Links go through :mod:`components`.

Null texts and texts without words have fingerprint zero and link like any other. Null ids are never a component's name
unless it has no other; rows that repeat an id each keep their row. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import carried, stash, uncarried, utf8
from textquarry.llm.components import components

WIDTH = 3
RADIUS = 2
SEED = 42
#: Hashes whose bits are counted at once.
CHUNK = 1 << 17
#: Sides of the blocks that are compared at once.
BLOCK = (256, 4096)
#: Fingerprints of a tile that one task holds, and guests that pass by them; larger tiles are divided.
TILE = (1 << 15, 1 << 20)
_BLOCKS = _GROUPS = 1 << 20


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, SEED)]
    stops = list(itertools.accumulate([len(w) + 1 for w in words], initial=0))
    return [digest(line[a : b - 1], SEED) for a, b in zip(stops, stops[width:])]


def fingerprints_of(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """uint64 fingerprints."""
    out, pending, counts, first = np.zeros(len(texts), np.uint64), [], [], 0

    def bits(flat: list[int]) -> np.ndarray:
        # most significant bit first
        return np.unpackbits(np.array(flat, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)

    def flush(last: int) -> None:
        nonlocal pending, counts, first
        n = np.array(counts)
        full = np.flatnonzero(n)
        if len(full):
            sums = np.add.reduceat(bits(pending), (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
            out[first + full] = np.packbits(2 * sums > n[full, None], axis=1).view(">u8").ravel()
        pending, counts, first = [], [], last

    for i, t in enumerate(texts):
        h = shingle_hashes(t, width)
        if len(h) > CHUNK:
            flush(i)
            sums = sum(bits(h[k : k + CHUNK]).sum(axis=0, dtype=np.int64) for k in range(0, len(h), CHUNK))
            out[i] = np.packbits(2 * sums > len(h)).view(">u8")[0]
            first = i + 1
            continue
        pending += h
        counts.append(len(h))
        if len(pending) > CHUNK:
            flush(i + 1)
    flush(len(texts))
    return out


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with fp, the fingerprint as a signed long."""
    df = carried(docs, _text=F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(fingerprints_of(utf8(batch.column("_text")), width).view(np.int64))], names=["_row", "fp"])

    return uncarried(df.mapInArrow(run, T.StructType([df.schema["_row"], T.StructField("fp", T.LongType())])), docs.columns, ["fp"])


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of the four counts, up to sign, that sum to ``radius`` at most; not all zero."""
    return [v for v in itertools.product(range(-radius, radius + 1), repeat=4) if 0 < sum(map(abs, v)) <= radius and next(x for x in v if x) > 0]


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``radius`` bits of a x b, or of unequal places of a."""
    left, right = [], []
    own = b is None
    b = a if own else b
    for i in range(0, len(a), BLOCK[0]):
        for j in range(i // BLOCK[1] * BLOCK[1] if own else 0, len(b), BLOCK[1]):
            x, y = np.nonzero(np.bitwise_count(a[i : i + BLOCK[0], None] ^ b[None, j : j + BLOCK[1]]) <= radius)
            x, y = x + i, y + j
            if own:
                x, y = x[x < y], y[x < y]
            left.append(a[x])
            right.append(b[y])
    return (np.concatenate(left), np.concatenate(right)) if left else (a[:0], a[:0])


def _compare(radius: int):
    """Rows come by unit: first the base block, then its guests, which are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, base, own, within = None, [], np.zeros(0, np.uint64), False

        def links(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal own, base
            own, base = np.concatenate(base) if base else np.zeros(0, np.uint64), None
            if within and len(own) > 1:
                yield links(*close_pairs(own, None, radius))

        for batch in batches:
            units, guest, fps = (batch[c].to_numpy(zero_copy_only=False) for c in ("unit", "guest", "fp"))
            fps = fps.view(np.uint64)
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fps)], strict=True):
                if units[a] != unit:
                    if base is not None:
                        yield from closed()
                    # pairs of the base block itself are compared once, where the first group of guests is
                    unit, base, within = units[a], [], units[a] % _GROUPS == 0
                if not guest[a]:
                    base.append(fps[a:b])
                    continue
                if base is not None:
                    yield from closed()
                if len(own):
                    yield links(*close_pairs(fps[a:b], own, radius))
        if base:
            yield from closed()

    return run


def _divided(rows: DataFrame, radius: int, side: int) -> DataFrame | None:
    """(t, blocks, groups) of the tiles with more than BASE fingerprints or GUESTS guests; None if there are none.

    There are 17^4 tiles, so their counts are bounded.
    """
    counts = dict(rows.groupBy("home").count().collect())
    crowd = []
    if max(counts.values(), default=0) > min(TILE[0], TILE[1] // (2 * len(_neighbours(radius)) + 1)):
        steps = [sum(x * side**k for k, x in enumerate(v)) for v in _neighbours(radius)]
        for t, n in counts.items():
            # guests of a tile come from one side only: each pair of tiles meets once
            guests = n + sum(counts.get(t - d, 0) for d in steps)
            if n > TILE[0] or guests > TILE[1]:
                crowd.append((t, -(-n // TILE[0]), -(-guests // TILE[1])))
    assert all(blocks < _BLOCKS and groups < _GROUPS for _, blocks, groups in crowd)
    return rows.sparkSession.createDataFrame(crowd, "t int, blocks int, groups int") if crowd else None


def links_between(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps(fp), distinct -> links(a, b) between all fingerprints within ``radius`` bits."""
    counts = [F.bit_count(F.expr(f"shiftrightunsigned(fp, {16 * k}) & 65535")) for k in range(4)]
    rows = fps.select("fp", *[c.cast("int").alias(f"c{k}") for k, c in enumerate(counts)])
    side = 17 + radius
    code = lambda v: sum((F.col(f"c{k}") + v[k]) * side**k for k in range(4))
    crowded = _divided(rows.select(code((0,) * 4).alias("home")), radius, side)
    spots = [F.struct(code((0,) * 4).alias("tile"), F.lit(False).alias("guest"))]
    for v in _neighbours(radius):
        fits = F.lit(True)
        for k in range(4):
            if v[k]:
                fits = fits & (F.col(f"c{k}") + v[k]).between(0, 16)
        spots.append(F.when(fits, F.struct(code(v).alias("tile"), F.lit(True).alias("guest"))))
    rows = rows.select("fp", F.explode(F.array_compact(F.array(*spots))).alias("s")).select("s.tile", "s.guest", "fp")
    if crowded is None:
        rows = rows.select((F.col("tile").cast("long") * _BLOCKS * _GROUPS).alias("unit"), "guest", "fp")
    else:
        rows = rows.join(F.broadcast(crowded), F.col("tile") == F.col("t"), "left")
        blocks, groups = F.coalesce("blocks", F.lit(1)), F.coalesce("groups", F.lit(1))
        block, group = F.pmod(F.xxhash64("fp"), blocks).cast("int"), F.pmod(F.xxhash64("fp", F.lit("guest")), groups).cast("int")
        unit = lambda b, g, guest: F.struct((F.col("tile").cast("long") * _BLOCKS * _GROUPS + b.cast("long") * _GROUPS + g).alias("unit"), F.lit(guest).alias("guest"))
        home = F.concat(
            F.transform(F.sequence(F.lit(0), groups - 1), lambda g: unit(block, g, False)),
            # within a tile, a block is the guest of those before it
            F.when(block > 0, F.transform(F.sequence(F.lit(0), block - 1), lambda b: unit(b, group, True))).otherwise(F.array().cast("array<struct<unit:bigint,guest:boolean>>")),
        )
        away = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: unit(b, group, True))
        rows = rows.select("fp", F.explode(F.when(F.col("guest"), away).otherwise(home)).alias("u")).select("u.unit", "u.guest", "fp")
    return rows.repartition("unit").sortWithinPartitions("unit", "guest").mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the least id reachable) of every row."""
    rows = stash(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", width).select("doc_id", "fp"), "fingerprints")
    least = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links_between(least.select("fp"), radius)).withColumnRenamed("node", "fp")
    groups = least.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(groups.join(names, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
