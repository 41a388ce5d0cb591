"""Removal of repeated byte strings with suffix arrays, exact over the whole corpus.

A byte goes when some string of ``WINDOW`` bytes that covers it also starts earlier: in a document of smaller id, or
earlier in the same one. Strings never cross documents and are judged on the input.

1. Each window has a minimizer, the least-hashed ``ANCHOR``-byte string in it, so equal windows share it. Documents are
   dealt by a hash of id and text to shards of about ``SHARD_BYTES``, as many as the text needs. A shard sends each distinct
   minimizer with its count; those that occur twice come back to their shards.
2. A shard builds the suffix array of the text around such minimizers (Larsson-Sadakane refinement) and the common
   prefixes (Kasai). Runs of equal windows are classes; of each class all but the earliest are removed here, and the
   earliest go on, as runs of text around their minimizer.
3. Shards are merged by minimizer: the distinct windows are put in order and every window is found among them by binary
   search, by a 64-bit code whose equality is then checked byte by byte. All but the earliest are removed.
4. Each document's removed windows are united.

A window that many documents share is sent once by each shard, so a hot passage costs shards, not copies. Text is
shuffled once. Documents longer than ``SEGMENT`` are worked on in overlapping segments.

Null texts are empty; documents shorter than a window lose nothing. Rows that repeat an id are judged by (id, start)
alone, so that neither is earlier than its twin. Null ids come first. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import FIRST as _FIRST
from textquarry.llm.suffix_arrays import _BLOCK, _packed, anchors, gram_hashes, window_classes

WINDOW = 100
ANCHOR = 32
SEGMENT = 1 << 20
#: Bytes of text in a shard, and in a piece of it that has one suffix array.
SHARD_BYTES = 4 << 20
#: Shards of a partition where there are many; each is a group of its own, so they never meet in memory.
SHARDS_PER_TASK = 16
#: Bytes of text that are merged at once.
MERGE_BYTES = 2 << 20
#: Bits of an order key for the place in a document.
_PLACE = 41


def segments(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"), raw.alias("raw"))
    held = rows.agg(F.sum(F.octet_length("raw").cast("long"))).first()[0] or 0
    shards = held // SHARD_BYTES + 1
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("id", "h"), F.lit(shards)).cast("int"))
    n = F.octet_length("raw").cast("long")
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(n - WINDOW, F.lit(0).cast("long")), F.lit(SEGMENT).cast("long"))
    rows = rows.select("_shard", F.coalesce("id", F.lit(_FIRST)).alias("d"), "h", n.alias("n"), "raw", F.explode(begins).alias("start"))
    rows = rows.select("_shard", "d", "h", "n", "start", F.substring("raw", F.col("start").cast("int") + 1, F.lit(SEGMENT + WINDOW - 1)).alias("part"))
    return rows, shards


def _pieces(parts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of parts with about SHARD_BYTES each."""
    start = held = 0
    for i, p in enumerate(parts):
        if held and held + len(p) > 2 * SHARD_BYTES:
            yield start, i
            start, held = i, 0
        held += len(p)
    if held:
        yield start, len(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shards, parts = batch["_shard"].to_numpy(), batch["part"].to_pylist()
        for a, b in _pieces(parts):
            buf, ends = _joined(parts[a:b])
            at, which, hashes = anchors(buf, ends, WINDOW, ANCHOR)
            first = np.flatnonzero(np.diff(which, prepend=-1))
            keys, of = hashes[which[first]], shards[a:b][np.searchsorted(ends, at[first], side="right")]
            by = np.lexsort((of, keys))
            keys, of = keys[by], of[by]
            one = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))) if len(keys) else by
            n = np.diff(np.append(one, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[one].view(np.int64)), pa.array(of[one].astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["hash", "_shard", "n"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the minimizers that occur twice. All rows of a hash are here; there are as many partitions as shards need."""
    parts = [[b[c].to_numpy() for c in ("hash", "_shard", "n")] for b in batches]
    if not parts:
        return
    hashes, shards, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(hashes)
    ordered = hashes[by]
    first = np.append(True, ordered[1:] != ordered[:-1])
    alone = first & np.append(first[1:], True) & (n[by] < 2)
    keep = by[~alone]
    yield pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array(shards[keep])], names=["hash", "_shard"])


_ROWS = "key long, _shard int, d long, h long, start long, stop long, part binary"
_NAMES = ["key", "_shard", "d", "h", "start", "stop", "part"]


def _runs(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs that begin where ``breaks`` is true."""
    first = np.flatnonzero(breaks)
    return first, np.append(first[1:], n) - 1


def _table(key, shard: int, d, h, start, stop, part) -> pa.Table:
    n = len(d)
    return pa.table([pa.array(key, pa.int64()), pa.array(np.full(n, shard, np.int32)), pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), part if part is not None else pa.nulls(n, pa.binary())], names=_NAMES)


def local_classes(shard: int, d: np.ndarray, h: np.ndarray, start: np.ndarray, parts: list[bytes], shared: np.ndarray) -> list[pa.Table]:
    """A piece's removed ranges, and its earliest windows as runs of text; rows are in order of (d, start)."""
    buf, ends = _joined(parts)
    begin = ends - [len(p) for p in parts]
    at, which, hashes = anchors(buf, ends, WINDOW, ANCHOR)
    if not len(at) or not len(shared):
        return []
    place = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
    wanted = (shared[place] == hashes)[which]
    at, which = at[wanted], which[wanted]
    if not len(at):
        return []
    # the text that the wanted windows cover, closed up
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    source, place = np.flatnonzero(covered), np.cumsum(covered, dtype=np.int32) - 1
    valid = np.zeros(len(source), bool)
    valid[place[at]] = True
    order, begins = window_classes(buf[source], valid, WINDOW)
    order = source[order]
    rank = np.unique(d, return_inverse=True)[1]
    of = np.searchsorted(ends, order, side="right")
    keys = (rank[of].astype(np.int64) << _PLACE) | (order - begin[of] + start[of])
    dup = keys > np.repeat(np.minimum.reduceat(keys, begins), np.diff(np.append(begins, len(keys))))
    out = []
    gone = np.sort(order[dup])
    if len(gone):
        of = np.searchsorted(ends, gone, side="right")
        a, b = _runs(np.append(True, (np.diff(gone) != 1) | (np.diff(of) != 0)), len(gone))
        of, move = of[a], start[of[a]] - begin[of[a]]
        out.append(_table(hashes[which[np.searchsorted(at, gone[a])]].view(np.int64), shard, d[of], h[of], gone[a] + move, gone[b] + move + WINDOW, None))
    kept = np.sort(order[~dup])
    number = which[np.searchsorted(at, kept)]
    a, b = _runs(np.append(True, (np.diff(kept) != 1) | (np.diff(number) != 0)), len(kept))
    of = np.searchsorted(ends, kept[a], side="right")
    move, whole = start[of] - begin[of], buf.tobytes()
    texts = pa.array([whole[x : y + WINDOW] for x, y in zip(kept[a].tolist(), kept[b].tolist(), strict=True)], pa.binary())
    out.append(_table(hashes[number[a]].view(np.int64), shard, d[of], h[of], kept[a] + move, kept[b] + move + WINDOW, texts))
    return out


def _sorted(table: pa.Table, *by: str) -> pa.Table:
    return table.take(pa.compute.sort_indices(table, [(c, "ascending") for c in by]))


def _within(segs: pa.Table, shared: pa.Table) -> pa.Table:
    out = [pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary())], names=_NAMES)]
    if segs.num_rows and shared.num_rows:
        segs = _sorted(segs, "d", "h", "start")
        parts = segs["part"].to_pylist()
        d, h, start = (segs[c].to_numpy() for c in ("d", "h", "start"))
        wanted = np.unique(shared["hash"].to_numpy().view(np.uint64))
        for a, b in _pieces(parts):
            out += local_classes(segs["_shard"][0].as_py(), d[a:b], h[a:b], start[a:b], parts[a:b], wanted)
    return pa.concat_tables(out)


def _codes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start at ``at``, which ascends."""
    out, lo = np.empty(len(at), np.uint64), 0
    while lo < len(at):
        base = at[lo]
        hi = int(np.searchsorted(at, base + _BLOCK))
        out[lo:hi] = gram_hashes(buf[base : base + _BLOCK + WINDOW - 1], WINDOW)[at[lo:hi] - base]
        lo = hi
    return out


def merge_windows(d: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of all texts: the text, the offset in it, and whether an equal one is earlier by (d, start + offset)."""
    buf, ends = _joined(texts)
    size = np.array([len(t) for t in texts])
    n = size - WINDOW + 1
    owner = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = (ends - size)[owner] + offset
    codes = _codes(buf, at)
    gone = np.zeros(len(at), bool)
    ordered = np.sort(codes)
    distinct = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])  # codes of more than one window
    if not len(distinct):
        return owner, offset, gone
    cls = np.minimum(np.searchsorted(distinct, codes), len(distinct) - 1)
    several = np.flatnonzero(distinct[cls] == codes)
    cls, at = cls[several], at[several]
    stands_for = np.empty(len(distinct), np.int64)
    stands_for[cls[::-1]] = at[::-1]
    words = _packed(buf)
    same = np.ones(len(at), bool)
    for k in (*range(0, WINDOW - 7, 8), WINDOW - 8):
        same &= words[at + k] == words[stands_for[cls] + k]
    n_classes = len(distinct)
    if not same.all():  # equal codes of unequal windows: told apart by their bytes
        whole, names = buf.tobytes(), {}
        for i in np.flatnonzero(np.isin(cls, cls[~same])).tolist():
            cls[i] = names.setdefault(whole[at[i] : at[i] + WINDOW], n_classes + len(names))
        n_classes += len(names)
    mine = owner[several]
    keys = (np.unique(d, return_inverse=True)[1].astype(np.int64)[mine] << _PLACE) | (start[mine] + offset[several])
    least = np.full(n_classes, np.iinfo(np.int64).max)
    np.minimum.at(least, cls, keys)
    gone[several] = keys > least[cls]
    return owner, offset, gone


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key. Passes removed ranges through, and adds those of windows that other shards have earlier."""
    held: pa.Table | None = None  # rows not yet merged; of a key with more than a block's, the earliest windows so far
    blank = pa.RecordBatch.from_pydict({"_shard": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("d", "h", "start", "stop")}})

    def work(t: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
        t = t.combine_chunks()
        d, h, start, shard, key = (t[c].to_numpy() for c in ("d", "h", "start", "_shard", "key"))
        texts = t["part"].to_pylist()
        owner, offset, gone = merge_windows(d, start, texts)
        begins = np.append(True, (np.diff(owner) != 0) | (np.diff(gone) != 0))
        a, b = _runs(begins, len(owner))
        o, lost = owner[a], gone[a]
        x, y = offset[a], offset[b] + WINDOW
        removed = pa.RecordBatch.from_arrays([pa.array(v[o][lost]) for v in (shard, d, h)] + [pa.array((start[o] + v)[lost]) for v in (x, y)], names=["_shard", "d", "h", "start", "stop"])
        left = pa.table([pa.array(key[o][~lost]), pa.array(shard[o][~lost]), pa.array(d[o][~lost]), pa.array(h[o][~lost]), pa.array((start[o] + x)[~lost]), pa.array((start[o] + y)[~lost]), pa.array([texts[i][u:v] for i, u, v in zip(o[~lost].tolist(), x[~lost].tolist(), y[~lost].tolist(), strict=True)], pa.binary())], names=_NAMES)
        return removed, left

    limit = MERGE_BYTES
    for batch in batches:
        t = pa.Table.from_batches([batch])
        text = pa.compute.is_valid(t["part"])
        done = t.filter(pa.compute.invert(text)).select(blank.schema.names)
        yield from done.to_batches()
        t = t.filter(text)
        if not t.num_rows:
            continue
        held = t if held is None else pa.concat_tables([held, t])
        while held is not None and held["part"].nbytes >= limit:
            held = held.combine_chunks()
            keys, sizes = held["key"].to_numpy(), np.cumsum(pa.compute.binary_length(held["part"]).to_numpy())
            upto = int(np.searchsorted(sizes, limit)) + 1
            cut = int(np.flatnonzero(np.append(True, np.diff(keys[:upto]) != 0))[-1]) if upto <= len(keys) else 0
            if upto >= len(keys) and cut == 0 or cut == 0:
                if upto < len(keys) and keys[upto] != keys[0]:
                    cut = upto
                else:  # one key fills the block: merge it, keep what is left of it
                    removed, left = work(held.slice(0, upto))
                    yield removed
                    rest = held.slice(upto)
                    held = pa.concat_tables([left, rest])
                    limit = max(MERGE_BYTES, 2 * left["part"].nbytes)
                    if not rest.num_rows:
                        break
                    continue
            removed, _ = work(held.slice(0, cut))
            yield removed
            held, limit = held.slice(cut), MERGE_BYTES
    if held is not None and held.num_rows:
        yield work(held)[0]
    yield blank


def union_of(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _finish(with_text: bool):
    def run(segs: pa.Table, gone: pa.Table) -> pa.Table:
        ranges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, h, a, b in zip(*(gone[c].to_pylist() for c in ("d", "h", "start", "stop")), strict=True):
            ranges.setdefault((d, h), []).append((a, b))
        segs = _sorted(segs, "d", "h", "start")
        docs: dict[tuple[int, int], list] = {}
        for d, h, n, start, part in zip(*(segs[c].to_pylist() for c in ("d", "h", "n", "start", "part")), strict=True):
            docs.setdefault((d, h), []).append((start, n, part))
        rows = []
        for (d, h), parts in docs.items():
            spans, digest, kept = union_of(ranges.get((d, h), [])), hashlib.sha256(), []
            copies, last = sum(s == 0 for s, _, _ in parts), -1
            for start, n, part in parts:
                if start == last:
                    continue
                last, stop, at = start, min(n, start + SEGMENT) if start + SEGMENT <= n - WINDOW else n, start
                for a, b in spans:
                    if b > at and a < stop:
                        if a > at:
                            digest.update(part[at - start : a - start])
                            kept.append(part[at - start : a - start])
                        at = max(at, min(b, stop))
                digest.update(part[at - start : stop - start])
                kept.append(part[at - start : stop - start])
            row = (None if d == _FIRST else d, n, sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "stop": b} for a, b in spans], b"".join(kept) if with_text else None)
            rows += [row] * copies
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges), and kept (the remaining bytes) if asked for."""
    spark = docs.sparkSession
    segs, shards = segments(docs, doc_id, text)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // SHARDS_PER_TASK)
    found = segs.select("_shard", "part").mapInArrow(_minimizers, "hash long, _shard int, n int").repartition(parts, "hash")
    shared = found.mapInArrow(_shared, "hash long, _shard int")
    dealt = segs.repartition(parts, "_shard")
    mine = dealt.groupBy("_shard").cogroup(shared.groupBy("_shard")).applyInArrow(_within, _ROWS)
    gone = mine.repartition(parts, "key").sortWithinPartitions("key", "d", "start").mapInArrow(_across, "_shard int, d long, h long, start long, stop long")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary"
    out = dealt.groupBy("_shard").cogroup(gone.groupBy("_shard")).applyInArrow(_finish(with_text), schema)
    return out if with_text else out.drop("kept")
