"""Near-duplicates of a stated similarity: texts that share a rare shingle meet, SimHash chooses among them, exact Jaccard similarity decides each link.

Two texts are linked when their sets of ``width``-word shingles have Jaccard similarity ``similarity`` or more. Words
are those of ``simhash``; each distinct shingle counts once, a text of fewer words is one shingle, and a text without
words links only to its like. Texts with equal sets are one node, so copies never multiply the work.

Meetings: let all shingles stand in one order. Sets of that similarity share ``similarity`` of either set at least, so the
first n - ceil(similarity * n) + 1 shingles of the one and of the other have a shingle in common; nodes meet where they share
one of those, and nothing is lost, whatever the order. The order only saves work: shingles that a bounded sample of the
texts repeats come last, the more frequent the later, the others by hash. A bucket is the nodes that share such a shingle; one of more than
BLOCK nodes is divided into blocks, and each pair of blocks is a tile.

Candidates: texts of similarity J differ in about ``acos(2J / (1 + J)) / pi`` of the bits of 256-bit fingerprints, less
if their sizes differ. The search radius is that share plus SEARCH standard deviations, so by the normal model three in
100,000 pairs at exactly J are missed, and fewer above. (Ties of bits make that share 3/16 for sets of four and five
shingles, which the radius of tiles with so small sets covers.) Pairs of small buckets are compared many buckets at once.
In larger ones, rows are ordered by population count, strips whose counts
differ beyond the radius are skipped, and numpy compares the rest by exclusive-or and bit counts: the first 128 bits, and
where those are within the radius, all. Such a tile gives a forest of its candidates, so that a large group costs as many rows as it has members.

Verification: every true link lies within one component of the candidates. A component's nodes meet with their whole
sets, large ones again in tiles of blocks, and a candidate becomes a link only by its exact similarity. Pairs that links
already join are not looked at again, so a tile gives a forest of true links; components of those are the groups.

The rows that are sent grow with the texts, the comparisons with the square of a bucket's nodes and of those within a component.
Where only fingerprints are at hand, ``links_between`` compares all nodes of the sizes in question, with the square of those.

Null texts are empty. Null ids come last, so one names a group only if the group has no other. Rows that repeat an id
each count. An empty table gives empty results. Input columns named node are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import carried, lean, mix64, stash, uncarried, utf8
from textquarry.llm.components import components
from textquarry.llm.simhash import shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
PARTS = 4
#: Nodes of a block, blocks of a bin at least (where it has some thousands of nodes), partitions at most, and the sides of
#: the strips that are compared at once.
BLOCK = 1 << 15
BLOCKS = 4
MAX_PARTITIONS = 10_000
STRIP = (64, 4096)
#: Standard deviations beyond the mean in the search for candidates.
SEARCH = 4
#: Sets of up to so many shingles have the share of bits that ties give.
SMALL = (8, 3 / 16)
#: Nodes and shingles of a block that is verified.
VERIFIED = (4096, 1 << 21)
#: Texts of the sample that orders shingles, shingles of each, and shingles that it may put last.
SAMPLE = (4096, 1024, 1 << 18)
#: Rows of (shingle, node) of a partition, as far as MAX_PARTITIONS go.
SHARED_ROWS = 1 << 20
#: Nodes of a bucket whose pairs are listed, and pairs that are compared at once.
SMALL_BUCKET = (256, 1 << 18)
_WORDS = [f"w{k}" for k in range(PARTS)]


def radius_of(similarity: float, least: int = SMALL[0] + 1) -> int:
    """Bits in which candidates may differ: the mean and SEARCH deviations, for sets of ``least`` shingles or more."""
    p, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * PARTS
    p = max(p, SMALL[1]) if least <= SMALL[0] else p
    return int(bits * p + SEARCH * math.sqrt(bits * p * (1 - p)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash from the first, by the finalizer of SplitMix64."""
    if not k:
        return h
    return mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes in order."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def set_fingerprint(h: np.ndarray) -> np.ndarray:
    sums = np.zeros(64 * PARTS, np.int64)
    # 255 rows are the most that eight bits can sum
    for i in range(0, len(h), 255):
        part = h[i : i + 255]
        spread = np.stack([_mixed(part, k) for k in range(PARTS)], axis=1)
        sums += np.unpackbits(spread.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * sums > len(h)).view(np.uint64)


def fingerprint(text: bytes, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """The number of distinct shingles, and PARTS words of bits that are set in over half of their hashes."""
    h = shingle_set(text, width)
    return len(h), set_fingerprint(h)


def common_shingles(docs: DataFrame, text: str = "text", width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, that a bounded sample of the texts has more than once, and in how many of its sets. It bears on the work alone."""
    n = docs.count()
    some = docs.select(F.col(text).alias("_text"))
    some = some.sample(SAMPLE[0] / n, seed=0) if n > SAMPLE[0] else some

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingle_set(t, width)[: SAMPLE[1]].tobytes() for t in utf8(batch.column("_text"))], pa.binary())], names=["shingles"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = {x for batch in batches for x in batch.column("shingles").to_pylist()}
        h, times = np.unique(np.frombuffer(b"".join(distinct), np.uint64), return_counts=True)
        last = np.flatnonzero(times > 1)
        last = np.sort(last[np.argsort(-times[last], kind="stable")[: SAMPLE[2]]])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (h[last], times[last])], names=["h", "times"])

    # one task: its sets are bounded by the sample
    found = some.mapInArrow(lean(sets), "shingles binary").repartition(1).mapInArrow(lean(count), "h binary, times binary").collect()
    return tuple(np.concatenate([np.zeros(0, t), *[np.frombuffer(r[k], t) for r in found]]) for k, t in enumerate((np.uint64, np.int64)))


def first_shingles(h: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of a set in order, the shingles of which a set of that similarity has one among its own first ones."""
    known, times = common
    # less by a trifle, so that rounding never shortens it
    n = min(len(h), len(h) - math.ceil(similarity * len(h) * (1 - 1e-9)) + 1)
    if not len(known):
        return h[:n]
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return h[np.argsort(np.where(known[at] == h, times[at], 0), kind="stable")[:n]]


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, first: tuple | None = None) -> DataFrame:
    """``docs`` with node (a digest of the set of shingles), n_shingles, w0, w1, ...: the fingerprint as signed longs; where
    ``first`` has a similarity and common shingles, also _first, the :func:`first_shingles`."""
    df = carried(docs, _text=F.col(text))
    outputs = ["node", "n_shingles", *_WORDS]
    schema = [df.schema["_row"], *[T.StructField(c, T.LongType()) for c in outputs], *([T.StructField("_first", T.ArrayType(T.LongType(), False))] if first else [])]
    similarity, sent = (first[0], docs.sparkSession.sparkContext.broadcast(first[1])) if first else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, firsts = [], []
            for t in utf8(batch.column("_text")):
                h = shingle_set(t, width)
                found.append((xxhash.xxh3_64_intdigest(h.tobytes()), len(h), *set_fingerprint(h)))
                if first:
                    firsts.append(first_shingles(h, similarity, sent.value))
            numbers = np.array(found, np.uint64).reshape(-1, len(outputs)).view(np.int64)
            columns = [batch.column("_row"), *[pa.array(numbers[:, k]) for k in range(len(outputs))]]
            if first:
                flat = np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64)
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return uncarried(df.mapInArrow(lean(run), T.StructType(schema)), docs.columns, [f.name for f in schema[1:]])


def forest(fp: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the near pairs of left x right (or within left) join, one fewer than members for each group."""
    radius = radius_of(similarity, int(n.min(initial=1 << 62)))
    counts = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    left = left[np.argsort(counts[left], kind="stable")]
    own = right is None
    right = left if own else right[np.argsort(counts[right], kind="stable")]
    (a, b), (c, d) = (fp[left, :2].T.copy(), fp[right, :2].T.copy())
    of_left, of_right = counts[left], counts[right]
    label, froms, tos = np.arange(len(fp)), [], []
    for i in range(0, len(left), STRIP[0]):
        last = min(i + STRIP[0], len(left)) - 1
        for j in range(i if own else 0, len(right), STRIP[1]):
            end = min(j + STRIP[1], len(right))
            if of_right[j] - of_left[last] > radius or of_left[i] - of_right[end - 1] > radius:
                continue
            apart = np.bitwise_count(a[i : last + 1, None] ^ c[None, j:end])
            apart += np.bitwise_count(b[i : last + 1, None] ^ d[None, j:end])
            flat = np.flatnonzero(apart <= radius)
            if not len(flat):
                continue
            x, y = left[i + flat // (end - j)], right[j + flat % (end - j)]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            most, least = np.maximum(n[x], n[y]), np.minimum(n[x], n[y])
            near = (least >= similarity * most) & (np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) <= radius)
            x, y = x[near], y[near]
            while len(x):
                low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
                high, one = np.unique(high, return_index=True)
                froms.append(x[one])
                tos.append(y[one])
                to = np.arange(len(fp))
                to[high] = low[one]
                # each points to a lower one, so this ends
                while (to[to] != to).any():
                    to = to[to]
                label = to[label]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *froms]), np.concatenate([none, *tos])


def _compare(similarity: float):
    columns = ["pair", "side", "node", "n_shingles", *_WORDS]

    def links(parts: list[np.ndarray]) -> pa.RecordBatch:
        _, side, node, n, *words = np.concatenate(parts, axis=1)
        fp = np.stack(words, axis=1).view(np.uint64)
        own = (side == 2).any()
        x, y = forest(fp, n, np.flatnonzero(side != 1), None if own else np.flatnonzero(side == 1), similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in columns])
            for part in np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1):
                if held and held[0][0, 0] != part[0, 0]:
                    yield links(held)
                    held = []
                held.append(part)
        if held:
            yield links(held)

    return run


def links_between(nodes: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """nodes(node, n_shingles, w0, ...), distinct and written -> links(a, b) that join all candidates."""
    # neighbouring bins hold every size down to the similarity, with room for rounding
    step = math.log(1.01 / similarity)
    rows = nodes.withColumn("bin", F.floor(F.log(F.greatest("n_shingles", F.lit(1)).cast("double")) / F.lit(step)).cast("int"))
    # one row for each size bin, some hundred at most
    counted = {r["bin"]: max(-(-r["count"] // block), min(BLOCKS, -(-r["count"] // 1024))) for r in rows.groupBy("bin").count().collect()}
    blocks = [counted.get(t, 0) for t in range(max(counted, default=-1) + 1)] + [0]
    own, across, pairs = [], [], 0
    for k, following in zip(blocks, [*blocks[1:], 0], strict=True):
        own.append(pairs)
        pairs += k * (k + 1) // 2
        across.append(pairs)
        pairs += k * following
    of = lambda values, shift=0: F.coalesce(F.get(F.lit(values).cast("array<bigint>"), F.col("bin") + shift), F.lit(0))
    rows = rows.withColumns({"k": of(blocks), "k_next": of(blocks, 1), "k_last": of(blocks, -1), "own": of(own), "to_next": of(across), "to_last": of(across, -1)})
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "k"))
    place = lambda pair, side: F.struct(pair.alias("pair"), F.lit(side).cast("long").alias("side") if isinstance(side, int) else side.cast("long").alias("side"))
    upto = lambda k: F.when(F.col(k) > 0, F.sequence(F.lit(0).cast("long"), F.col(k) - 1)).otherwise(F.array().cast("array<bigint>"))
    me = F.col("block")

    def within(j):
        high, low = F.greatest(me, j), F.least(me, j)
        return place(F.col("own") + (high * (high + 1) / 2).cast("long") + low, F.when(j == me, 2).when(me < j, 0).otherwise(1))

    tiles = F.concat(
        F.transform(upto("k"), within),
        F.transform(upto("k_next"), lambda j: place(F.col("to_next") + me * F.col("k_next") + j, 0)),
        F.transform(upto("k_last"), lambda j: place(F.col("to_last") + j * F.col("k") + me, 1)),
    )
    rows = rows.select(F.explode(tiles).alias("t"), "node", "n_shingles", *_WORDS).select("t.pair", "t.side", "node", "n_shingles", *_WORDS)
    parts = max(1, min(pairs, MAX_PARTITIONS))
    rows = rows.repartitionById(parts, F.pmod("pair", F.lit(parts)).cast("int")).sortWithinPartitions("pair", "side")
    return rows.mapInArrow(lean(_compare(similarity)), "a long, b long")


def _shared(block: int):
    """Rows of (shingle, node) in that order -> those of shingles with several nodes, each once, numbered by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row is held back: whether its shingle has another node, and how many before it
        shingle, node, joined, before = np.zeros(0, np.int64), np.zeros(0, np.int64), False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, node = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in ((shingle, "shingle"), (node, "node")))
            fresh = np.ones(len(node), bool)
            fresh[1:] = (np.diff(shingle) != 0) | (np.diff(node) != 0)
            shingle, node = shingle[fresh], node[fresh]
            same = np.diff(shingle) == 0
            alike = np.concatenate(([joined], same))
            place = np.arange(len(node))
            opens = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), place, 0))
            number = place - opens + np.where(opens == 0, before, 0)
            out = np.flatnonzero(alike[:-1] | same)
            yield pa.RecordBatch.from_arrays([pa.array(shingle[out]), pa.array(node[out]), pa.array(number[out] // block)], names=["shingle", "node", "block"])
            shingle, node, joined, before = shingle[-1:], node[-1:], bool(alike[-1]), int(number[-1])
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(node), pa.array([before // block], pa.int64())], names=["shingle", "node", "block"])

    return run


def listed_pairs(fp: np.ndarray, n: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near pairs of rows that lie in buckets of these sizes."""
    radius, small = radius_of(similarity), radius_of(similarity, 1)
    # how many rows of its bucket follow each row
    later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(n)) - 1
    stops = np.cumsum(later)
    cuts = np.unique([0, *np.searchsorted(stops, np.arange(0, int(later.sum()), SMALL_BUCKET[1]), "right")])
    for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True):
        m = later[a:b]
        x = np.repeat(np.arange(a, b), m)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        most, least = np.maximum(n[x], n[y]), np.minimum(n[x], n[y])
        fits = least >= similarity * most
        x, y, least = x[fits], y[fits], least[fits]
        near = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) <= np.where(least <= SMALL[0], small, radius)
        yield x[near], y[near]


def _meet(similarity: float):
    columns = ["shingle", "high", "low", "side", "node", "n_shingles", *_WORDS]

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole tiles, one after another."""
        side, node, n = rows[3:6]
        fp = np.stack(rows[6:], axis=1).view(np.uint64)
        cuts = np.flatnonzero((np.diff(rows[:3]) != 0).any(axis=0)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(node)]))
        sizes = ends - starts
        listed = (sizes <= SMALL_BUCKET[0]) & (side[starts] == 2)
        found = []
        if listed.any():
            own = np.flatnonzero(np.repeat(listed, sizes))
            found += [(own[x], own[y]) for x, y in listed_pairs(fp[own], n[own], sizes[listed], similarity)]
        for a, b in zip(starts[~listed], ends[~listed], strict=True):
            own = (side[a:b] == 2).any()
            x, y = forest(fp[a:b], n[a:b], np.flatnonzero(side[a:b] != 1), None if own else np.flatnonzero(side[a:b] == 1), similarity)
            found.append((a + x, a + y))
        for x, y in found:
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the tile that may go on in the next batch
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in columns])
            opens = np.flatnonzero((np.diff(rows[:3]) != 0).any(axis=0)) + 1
            if held and (held[-1][:3, -1] != rows[:3, 0]).any():
                yield from links(np.concatenate(held, axis=1))
                held = []
            if not len(opens):
                held.append(rows)
                continue
            yield from links(np.concatenate([*held, rows[:, : opens[-1]]], axis=1))
            held = [rows[:, opens[-1] :]]
        if held:
            yield from links(np.concatenate(held, axis=1))

    return run


def buckets(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows(node, _first), written -> shingle, node, block of each node where it shares a first shingle with another."""
    spread = rows.select("node", F.explode("_first").alias("shingle"))
    n = rows.agg(F.sum(F.size("_first"))).first()[0] or 0
    parts = min(MAX_PARTITIONS, max(n // SHARED_ROWS + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = spread.repartition(parts, "shingle").sortWithinPartitions("shingle", "node")
    return spread.mapInArrow(lean(_shared(block)), "shingle long, node long, block long")


def links_sharing(rows: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """rows(node, _first) and nodes(node, n_shingles, w0, ...), both written -> links(a, b) that join all candidates."""
    shared = stash(buckets(rows, block), "similar-shared")
    # buckets of several blocks
    divided = stash(shared.where("block > 0").groupBy("shingle").agg((F.max("block") + 1).alias("k")), "similar-divided")
    met = shared.join(nodes, "node")
    if divided.isEmpty():
        zero = F.lit(0).cast("long")
        dealt = met.withColumns({"high": zero, "low": zero, "side": zero + 2})
    else:
        me = F.col("block")
        # 2: meets its own block, 0 and 1: the lower and the higher of two blocks
        spot = lambda j: F.struct(F.greatest(me, j).alias("high"), F.least(me, j).alias("low"), F.when(j == me, 2).when(me < j, 0).otherwise(1).cast("long").alias("side"))
        met = met.join(divided, "shingle", "left").withColumn("t", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1)) - 1), spot)))
        dealt = met.select("shingle", "t.high", "t.low", "t.side", "node", "n_shingles", *_WORDS)
    dealt = dealt.repartition("shingle", "high", "low").sortWithinPartitions("shingle", "high", "low")
    return dealt.select("shingle", "high", "low", "side", "node", "n_shingles", *_WORDS).mapInArrow(lean(_meet(similarity)), "a long, b long")


def true_forest(sets: list[np.ndarray], fp: np.ndarray, left: np.ndarray, right: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs of left x right (or within left) join that are candidates and of that exact similarity."""
    n = np.array([len(s) for s in sets], np.int64)
    radius = radius_of(similarity, int(n.min(initial=1 << 62)))
    own = right is None
    right = left if own else right
    known, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    stops = np.cumsum(n)
    ids = [ids[a:b] for a, b in zip(stops - n, stops, strict=True)]
    has, label, froms, tos = np.zeros(len(known), bool), np.arange(len(sets)), [], []
    of_right, size = fp[right], n[right]
    for place, i in enumerate(left):
        later = slice(place + 1, None) if own else slice(None)
        near = (label[right[later]] != label[i]) & (np.minimum(size[later], n[i]) >= similarity * np.maximum(size[later], n[i]))
        near &= np.bitwise_count(of_right[later] ^ fp[i]).sum(axis=1, dtype=np.int64) <= radius
        others = right[later][near]
        if not len(others):
            continue
        has[ids[i]] = True
        # one text's set at a time beside the tile's
        both = np.array([np.count_nonzero(has[ids[y]]) for y in others])
        has[ids[i]] = False
        others = others[both >= similarity * (n[i] + n[others] - both)]
        if not len(others):
            continue
        _, one = np.unique(label[others], return_index=True)
        froms.append(np.full(len(one), i))
        tos.append(others[one])
        label[np.isin(label, label[others])] = label[i]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *froms]), np.concatenate([none, *tos])


def _verify(similarity: float):
    tile = ["component", "high", "low"]

    def links(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(batches)
        side, node = held["side"].to_numpy(), held["node"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in held["shingles"].to_pylist()]
        fp = np.stack([held[c].to_numpy() for c in _WORDS], axis=1).view(np.uint64)
        own = (side == 2).any()
        x, y = true_forest(sets, fp, np.flatnonzero(side != 1), None if own else np.flatnonzero(side == 1), similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in tile])
            cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = tuple(keys[:, a])
                if held and of != key:
                    yield links(held)
                    held = []
                of = key
                held.append(batch.slice(a, b - a))
        if held:
            yield links(held)

    return run


def verified(rows: DataFrame, nodes: DataFrame, candidates: DataFrame, text: str, width: int, similarity: float, block: tuple[int, int] = VERIFIED) -> DataFrame:
    """candidates(node, component) -> links(a, b) of exact similarity that join all that such pairs of a component join."""
    of = stash(candidates.join(nodes.drop("least"), "node"), "similar-candidates")
    sizes = of.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block[0]), F.ceil(F.sum("n_shingles") / block[1])).alias("k"))
    of = stash(of.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), "k")), "similar-blocks")
    texts = rows.select("node", F.col(text).alias("_text")).join(of.select("node"), "node", "left_semi").dropDuplicates(["node"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [shingle_set(t, width).tobytes() for t in utf8(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(shingles, pa.binary())], names=["node", "shingles"])

    whole = of.join(texts.mapInArrow(lean(sets), "node long, shingles binary"), "node")
    me = F.col("block")
    # 2: meets its own block, 0 and 1: the lower and the higher of two blocks
    spot = lambda j: F.struct(F.greatest(me, j).alias("high"), F.least(me, j).alias("low"), F.when(j == me, 2).when(me < j, 0).otherwise(1).alias("side"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), spot)
    dealt = whole.withColumn("t", F.explode(tiles)).select("component", "t.high", "t.low", "t.side", "node", *_WORDS, "shingles")
    dealt = dealt.repartition("component", "high", "low").sortWithinPartitions("component", "high", "low")
    return dealt.mapInArrow(lean(_verify(similarity)), "a long, b long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``docs`` with node, written; and node, least (the least id of its rows), component of each node."""
    rows = stash(fingerprints(docs, text, width, (similarity, common_shingles(docs, text, width))), "similar-rows")
    nodes = stash(rows.groupBy("node", "n_shingles", *_WORDS).agg(F.min(doc_id).alias("least")), "similar-nodes")
    candidates = components(links_sharing(rows, nodes.drop("least"), similarity))
    joined = components(verified(rows, nodes, candidates, text, width, similarity))
    named = nodes.select("node", "least").join(joined, "node", "left")
    return rows.drop("n_shingles", "_first", *_WORDS), named.select("node", "least", F.coalesce("component", "node").alias("component"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group: that of least id, nulls last; of rows that repeat id and fingerprint, the first by all columns."""
    columns = docs.columns
    rows, named = groups(docs, doc_id, text, width, similarity)
    # min() of structs takes nulls first
    best = named.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "node")).alias("best"))
    # structs, in which nulls are equal: the join and the window then deal rows alike, and texts move once
    best = best.select(F.struct(F.col("best.least").alias("id")).alias("_key"), F.col("best.node").alias("node"))
    kept = rows.withColumn("_key", F.struct(F.col(doc_id).alias("id"))).join(best, ["_key", "node"], "left_semi")
    one = F.row_number().over(W.partitionBy("_key", "node").orderBy(*columns))
    return kept.withColumn("_one", one).where("_one = 1").select(*columns)
