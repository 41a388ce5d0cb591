"""Columns over one text: counts, slices, records around a position, ranks, statistics.

Positions are 0-based code points. Lenient columns give NULL where a position is outside the text; with ``strict`` they
raise. NULL text gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The messages of strict mode in this module are fixed values that callers match.


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _at(n: Column | int) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def checked_pattern(pattern: str) -> str:
    if not pattern:
        raise ValueError("the pattern is empty")
    return pattern


def has_border(pattern: str) -> bool:
    """Whether matches of ``pattern`` can overlap: some proper prefix of it is also a suffix."""
    return any(pattern.startswith(pattern[i:]) for i in range(1, len(pattern)))


def quoted(pattern: str) -> str:
    """A Java regular expression for the literal."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def count_overlapping(text: Column | str, pattern: str) -> Column:
    """Number of occurrences, overlapping ones included."""
    text, pattern = _column(text), checked_pattern(pattern)
    if has_border(pattern):
        n = F.regexp_count(text, F.lit(f"(?={quoted(pattern)})"))
    else:  # occurrences are apart, so removing them all shows their number
        n = F.floor((F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))) / len(pattern))
    return F.when(text.contains(pattern), n.cast("long")).when(text.isNotNull(), F.lit(0).cast("long"))


def count_sliced_pattern(text: Column | str, pattern: str, offset: int, length: int) -> Column:
    """Occurrences of ``pattern[offset : offset + length]``; an empty slice is an error."""
    if offset < 0 or length < 1 or offset + length > len(pattern):
        raise ValueError("the slice is empty or outside the pattern")
    return count_overlapping(text, pattern[offset : offset + length])


def utf8_pattern(pattern: bytes, strict: bool = False) -> str:
    """A pattern given as UTF-8; ``strict`` refuses what lies outside the basic plane."""
    decoded = pattern.decode("utf-8")
    for c in decoded:
        if strict and ord(c) > 0xFFFF:
            raise ValueError(f"Found a character that exceeds (65535): it was {ord(c)}")
    return decoded


def _guard(ok: Column, value: Column, strict: bool, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)) if strict else F.lit(None).cast("string"))


def extract_range(text: Column | str, start: Column | int, stop: Column | int, strict: bool = False, max_chars: int | None = None) -> Column:
    """``text[start:stop)``."""
    text, start, stop = _column(text), _at(start), _at(stop)
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    checks = [(start >= 0, "Requested position less than 0"), (stop >= start, "Start position after stop position"), (stop <= F.length(text), "Stop position longer than index string")]
    if max_chars is not None:
        checks.append((stop - start <= max_chars, "Extraction does not fit"))
    for ok, message in checks:
        out = out.when(~ok, F.raise_error(F.lit(message)) if strict else F.lit(None).cast("string"))
    return out.otherwise(F.substring(text, (start + 1).cast("int"), (stop - start).cast("int")))


def _around(text: Column | str, at: Column | int, boundary: str, strict: bool, value) -> Column:
    if len(boundary) != 1:
        raise ValueError("the boundary is one character")
    text, at = _column(text), _at(at).cast("int")
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    outside = (at < 0) | (at >= F.length(text))
    if strict:
        out = out.when(at < 0, F.raise_error(F.lit("Requested position less than 0"))).when(outside, F.raise_error(F.lit("Requested position longer than index string"))).when(~text.contains(boundary), F.raise_error(F.lit("Boundary does not exist")))
    return out.when(outside, F.lit(None).cast("string")).when(F.substring(text, at + 1, F.lit(1)) == boundary, "").otherwise(value(text, at))


def extract_until_boundary(text: Column | str, at: Column | int, boundary: str = "\n", strict: bool = False) -> Column:
    """The run without ``boundary`` that holds position ``at``; empty where the boundary itself stands there."""
    return _around(text, at, boundary, strict, lambda t, i: F.concat(F.substring_index(F.left(t, i), boundary, -1), F.substring_index(F.substr(t, i + 1), boundary, 1)))


def extract_boundary_left(text: Column | str, at: Column | int, boundary: str = "\n", strict: bool = False) -> Column:
    """That run up to and including ``at``."""
    return _around(text, at, boundary, strict, lambda t, i: F.substring_index(F.left(t, i + 1), boundary, -1))


def extract_boundary_right(text: Column | str, at: Column | int, boundary: str = "\n", strict: bool = False) -> Column:
    """That run after ``at``."""
    return _around(text, at, boundary, strict, lambda t, i: F.substring_index(F.substr(t, i + 2), boundary, 1))


def symbol_rank(text: Column | str, position: Column | int, symbol: str) -> Column:
    """Occurrences of ``symbol`` before ``position``, which is held within the text."""
    head = F.left(_column(text), F.greatest(F.lit(0), _at(position).cast("int")))
    return (F.length(head) - F.length(F.replace(head, F.lit(symbol), F.lit("")))).cast("long")


def symbol_rank_range(text: Column | str, start: Column | int, stop: Column | int, symbol: str) -> Column:
    return symbol_rank(text, stop, symbol) - symbol_rank(text, start, symbol)


def symbol_access(text: Column | str, position: Column | int) -> Column:
    """The symbol at ``position``; NULL outside the text."""
    text, position = _column(text), _at(position).cast("int")
    return F.when((position >= 0) & (position < F.length(text)), F.substring(text, position + 1, F.lit(1)))


def symbol_select(text: Column | str, symbol: str, i: int) -> Column:
    """Position of the i-th ``symbol``, from 1; NULL if there are fewer."""
    if i < 1:
        raise ValueError("occurrences are counted from 1")
    text = _column(text)
    head = F.length(F.substring_index(text, symbol, i))
    return F.when(head < F.length(text), head.cast("long"))


def _run_starts(text: Column) -> Column:
    """The first symbol of each run. Java's back-references miss pairs of supplementary symbols, which arrays do not."""
    every = _symbols(text)
    return F.filter(F.arrays_zip(every.alias("s"), F.concat(F.array(F.lit("")), every).alias("p")), lambda x: (x["s"] != x["p"]) & x["s"].isNotNull())


def _supplementary(text: Column) -> Column:
    return text.rlike(r"[\x{10000}-\x{10FFFF}]")


def redundancy(text: Column | str) -> Column:
    """Length over number of runs of equal symbols; NULL for an empty text."""
    text = _column(text)
    return F.when(F.length(text) > 0, F.length(text) / F.length(collapsed_runs(text)))


def collapsed_runs(text: Column | str) -> Column:
    text = _column(text)
    return F.when(_supplementary(text), F.array_join(F.transform(_run_starts(text), lambda x: x["s"]), "")).otherwise(F.regexp_replace(text, r"(?s)(.)\1+", "$1"))


def _symbols(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def symbols(text: Column | str) -> Column:
    """The symbols of a text, one by one; none of an empty text."""
    return _symbols(_column(text))


def alphabet_size(text: Column | str) -> Column:
    """Distinct symbols, with the end mark NUL counted once."""
    text = _column(text)
    return F.when(text.isNotNull(), F.size(F.array_union(F.array_distinct(_symbols(text)), F.array(F.lit("\0")))).cast("long"))


def input_length(text: Column | str) -> Column:
    """Length with the end mark."""
    return (F.length(_column(text)) + 1).cast("long")


def min_bits(value: Column | str) -> Column:
    """Bits that hold the value: 1 for 0, 64 for negative values."""
    return F.length(F.bin(_column(value))).cast("int")


def floor_log2(value: Column | str) -> Column:
    """NULL for 0."""
    return F.when(_column(value) != 0, min_bits(value) - 1)


def low_bits(k: int) -> int:
    """A mask of the ``k`` lowest bits, as a signed 64-bit value."""
    if not 0 <= k <= 64:
        raise ValueError("0 to 64 bits")
    return -1 if k == 64 else (1 << k) - 1


def utf16_position(text: Column | str, position: Column | int) -> Column:
    """The position counted in UTF-16 code units."""
    return (F.octet_length(F.encode(F.left(_column(text), _at(position).cast("int")), "UTF-16BE")) / 2).cast("long")
