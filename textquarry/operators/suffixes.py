"""Suffix arrays and the Burrows-Wheeler transform of one sequence, in numpy."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def to_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def dense(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes as numbers from 1 in their order, and how many there are."""
    top = int(codes.max(initial=0))
    if top > 4 * len(codes) + 65536:
        symbols, which = np.unique(codes, return_inverse=True)
        return which + 1, len(symbols)
    seen = np.zeros(top + 1, bool)
    seen[codes] = True
    number = np.cumsum(seen)
    return number[codes], int(number[-1]) if len(codes) else 0


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Positions 0..n in suffix order; the empty suffix is first. One sort by as many symbols as a word holds; then prefix
    doubling among the suffixes that still tie."""
    n = len(codes)
    ranked, sigma = dense(codes)
    bits = max(1, sigma.bit_length())
    key, width, most = np.zeros(n + 1, np.int64), 1, 62 // bits
    key[:n] = ranked
    while width < most:  # 0 stands beyond the end, so no two suffixes that reach it tie
        more = min(width, most - width)
        next_ = np.zeros(n + 1, np.int64)
        next_[: max(0, n + 1 - width)] = key[width:]
        key = (key << (more * bits)) | (next_ >> ((width - more) * bits))
        width += more
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    place = np.arange(n + 1)
    first = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = first
    tied = place[~(new & np.append(new[1:], True))]
    while len(tied):
        at = order[tied]
        pair = rank[at] * (n + 1) + rank[at + width]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        new = np.append(True, pair[1:] != pair[:-1])
        order[tied] = at
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def in_order(codes: np.ndarray, places: list[int]) -> list[int]:
    """The places in the order of the suffixes that begin there. Few are told apart by windows that double while any tie;
    beyond an eighth of the sequence its suffix array is as cheap."""
    n, at = len(codes), np.array(places)
    if 8 * len(at) > n:
        place = np.empty(n + 1, np.int64)
        place[suffix_array(codes)] = np.arange(n + 1)
        return at[np.argsort(place[at])].tolist()
    rank, open_, look, skip = np.zeros(len(at), np.int64), np.arange(len(at)), 16, 0
    while len(open_):
        if look * len(open_) > 8 * n:  # long repeats
            place = np.empty(n + 1, np.int64)
            place[suffix_array(codes)] = np.arange(n + 1)
            return at[np.argsort(place[at])].tolist()
        spot = at[open_, None] + skip + np.arange(look)
        window = np.where(spot < n, codes[np.minimum(spot, n - 1)].astype(np.int64), -1)
        # groups that tie so far are divided by their windows; a rank is the group's first place
        by = np.lexsort((*window.T[::-1], rank[open_]))
        ordered, group = window[by], rank[open_][by]
        new = np.append(True, (group[1:] != group[:-1]) | (ordered[1:] != ordered[:-1]).any(axis=1))
        first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        opened = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(len(by)), 0))
        rank[open_[by]] = group + first - opened
        size = np.diff(np.append(np.flatnonzero(new), len(by)))
        open_ = open_[by][np.repeat(size, size) > 1]
        skip, look = skip + look, 2 * look
    return at[np.argsort(rank)].tolist()


def first_appearance(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1.. in order of first appearance, and the symbols in that order."""
    ranked, sigma = dense(points)
    first = np.full(sigma + 1, len(points))
    np.minimum.at(first, ranked, np.arange(len(points)))
    by = np.argsort(first[1:])
    code = np.zeros(sigma + 1, np.int64)
    code[by + 1] = np.arange(1, sigma + 1)
    return code[ranked], points[first[1:][by]]


def bwt_codes(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The transform over codes from 1; 0 is the end mark."""
    return np.concatenate((codes, [0]))[order - 1]


def bwt(text: str, mark: str = "\0") -> str:
    """The transform in symbol order, with ``mark`` where the end mark stands."""
    points = code_points(text)
    order = suffix_array(points)
    return to_text(np.concatenate((points, [ord(mark)]))[order - 1])


def by_symbol(column: np.ndarray, sigma: int) -> np.ndarray:
    """Places in the order of their codes, which are below ``sigma``; equal ones in order of place. Narrow codes are sorted by digits."""
    return np.argsort(column.astype(np.uint8 if sigma <= 256 else np.uint16 if sigma <= 65536 else np.int64), kind="stable")


def last_to_first(column: np.ndarray) -> np.ndarray:
    """For each row of the transform, the row of the suffix one symbol longer."""
    order = by_symbol(column, int(column.max(initial=0)) + 1)
    lf = np.empty(len(column), np.int64)
    lf[order] = np.arange(len(column))
    return lf


def runs(sequence: np.ndarray) -> int:
    return int(len(sequence) > 0) + int((sequence[1:] != sequence[:-1]).sum())
