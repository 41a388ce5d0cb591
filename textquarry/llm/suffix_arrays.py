"""Suffix arrays, common prefixes and minimizers of byte buffers, in numpy."""

from __future__ import annotations

import numpy as np

#: Multiplier of the rolling hash, and its inverse modulo 2^64.
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


#: Positions that are hashed at once, so that the work stays in the processor's cache.
_BLOCK = 1 << 17


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_B, _BLOCK + 4096), _powers(_B_INV, _BLOCK + 4096)


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k-byte string of at most _BLOCK + 4096 bytes; equal strings have equal hashes wherever they stand."""
    n = len(buf)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = sums[k:] - sums[:-k]
    h *= _DOWN[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each full window, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])


def anchors(buf: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window that lies within one part of ``buf``: its start, and the number of its minimizer; their hashes' array.

    ``ends`` are the parts' ends. The minimizer is the leftmost k-byte string of least (truncated) hash, so equal
    windows have it at the same offset. Minimizers are numbered in text order. At most 2^24 bytes.
    """
    n = len(buf) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    assert len(buf) <= 1 << 24
    low = np.uint64(0xFFFFFF)
    places, values, at = [], [], np.empty(n, np.int32)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        hashes = gram_hashes(buf[lo : hi + window - 1], k)
        keys = (hashes & ~low) | np.arange(lo, lo + len(hashes), dtype=np.uint64)
        at[lo:hi] = (sliding_min(keys, window - k + 1) & low).astype(np.int32)
        new = at[lo:hi][np.flatnonzero(np.diff(at[lo:hi], prepend=-1))]
        places.append(new)
        values.append(hashes[new - lo])
    place, value = np.concatenate(places), np.concatenate(values)
    place, which = np.unique(place, return_index=True)
    inside = np.ones(n, bool)
    for end in ends[:-1]:
        inside[max(0, end - window + 1) : end] = False
    starts = np.flatnonzero(inside)
    return starts, np.searchsorted(place, at[starts]), value[which]


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """Positions in suffix order.

    Larsson-Sadakane refinement: suffixes are first sorted by eight packed bytes; each round sorts only the groups that
    are not yet single, by the rank of the suffix that starts ``h`` further on, and doubles ``h``. Past the end all
    bytes count as absent, below any byte.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    packed = _packed(buf)[:n]
    order = np.argsort(packed)
    sorted_packed = packed[order]
    first = np.ones(n, bool)
    first[1:] = sorted_packed[1:] != sorted_packed[:-1]
    # Suffixes shorter than eight bytes stand before longer ones with the same packed bytes.
    if not buf[max(0, n - 15) :].all():
        order = np.lexsort((np.minimum(n - np.arange(n), 8), packed))
        sorted_packed, size = packed[order], np.minimum(n - order, 8)
        first[1:] = (sorted_packed[1:] != sorted_packed[:-1]) | (size[1:] != size[:-1])
    del packed, sorted_packed
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_, h = np.flatnonzero(~(first & np.append(first[1:], True))), 8
    while len(open_):
        at = order[open_]
        # absent suffixes (-1) and ranks are below 2^32 for any buffer that fits here
        keys = (rank[at].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(at + h, n)] + 1).astype(np.uint64)
        by = np.argsort(keys)
        at, keys = at[by], keys[by]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def _packed(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, and from eight positions past the end, as big-endian numbers."""
    n = len(buf)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = buf
    out = np.zeros(n + 8, np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out |= padded[j : j + n + 8]
    return out


def kasai(buf: np.ndarray, order: np.ndarray, most: int, lanes: int = 1 << 15) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix in ``order`` with the one before it.

    Kasai's walk goes through the text keeping one byte less than the last prefix. Here many lanes walk stretches of
    the text at once; each step compares eight packed bytes in every lane. A lane ends early at ``most`` and then keeps
    ``most - 1`` for its next position.
    """
    n = len(buf)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    packed = _packed(buf)
    length = -(-n // min(lanes, n))
    at = np.arange(0, n, length)
    stop = np.minimum(at + length, n)
    held = np.zeros(len(at), np.int64)
    got = np.zeros(n, np.int32)
    while len(at):
        other = before[at]
        i, j = at + held, other + held
        limit = np.minimum(np.minimum(most - held, n - i), n - j)
        differ = packed[np.minimum(i, n)] ^ packed[np.clip(j, 0, n)]
        same = np.where(differ == 0, 8, 0)
        odd = np.flatnonzero(differ)
        # equal leading bytes
        d = differ[odd]
        lead = np.zeros(len(odd), np.int64)
        for shift in (56, 48, 40, 32, 24, 16, 8):
            lead += (d >> np.uint64(shift)) == 0
        same[odd] = lead
        none = other < 0
        step = np.where(none, 0, np.minimum(same, limit))
        held = np.where(none, 0, held + step)
        done = none | (same < 8) | (step >= limit)
        got[at[done]] = held[done]
        at = at + done
        held = np.where(done, np.maximum(held - 1, 0), held)
        live = at < stop
        if not live.all():
            at, stop, held = at[live], stop[live], held[live]
    out[place] = got
    return out


def window_classes(buf: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the valid windows in suffix order, and where each class of equal windows begins among them."""
    order = suffix_array(buf)
    common = kasai(buf, order, window)
    keep = valid[order]
    # the common prefix with the last kept suffix is the least since then
    joined = np.cumsum(common < window)
    order, joined = order[keep], joined[keep]
    begins = np.ones(len(order), bool)
    begins[1:] = joined[1:] != joined[:-1]
    return order, np.flatnonzero(begins)
