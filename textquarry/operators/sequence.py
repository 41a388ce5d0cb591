"""Symbol and bit sequences as tables: codes, counts, rank, select, inverse select."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import suffixes
from textquarry.operators.transform import per_document


def symbol_table(docs: DataFrame, seq_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seq_id, pos, symbol), a row for each symbol."""
    return docs.select(F.col(seq_id).alias("seq_id"), F.posexplode(T.symbols(text)).alias("pos", "symbol")).withColumn("pos", F.col("pos").cast("long"))


def cumulative_counts(docs: DataFrame, seq_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seq_id, symbol, code, freq, cum): codes from 1 in order of first appearance, and the rows of the transform before
    the symbol's, the end mark's included. A row for each symbol of each text, without a shuffle."""

    def make(t: str):
        symbols, first, freq = np.unique(suffixes.code_points(t), return_index=True, return_counts=True)
        by = np.argsort(first)
        freq = freq[by]
        return list(suffixes.to_text(symbols[by])), np.arange(1, len(by) + 1), freq, np.cumsum(freq) - freq + 1

    columns = [("symbol", "string", pa.string()), ("code", "int", pa.int32()), ("freq", "long", pa.int64()), ("cum", "long", pa.int64())]
    return per_document(docs, seq_id, text, make, columns)


def alphabet_codes(docs: DataFrame, seq_id: str = "doc_id", text: str = "text") -> DataFrame:
    return cumulative_counts(docs, seq_id, text).drop("cum")


def inverse_select(symbols: DataFrame) -> DataFrame:
    """Adds rank: equal symbols before each position."""
    return symbols.withColumn("rank", (F.row_number().over(W.partitionBy("seq_id", "symbol").orderBy("pos")) - 1).cast("long"))


def inverse_select_all(docs: DataFrame, seq_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seq_id, pos, symbol, rank) of every position, a document at a time, without a shuffle."""

    def make(t: str):
        codes, symbols = suffixes.first_appearance(suffixes.code_points(t))
        by = suffixes.by_symbol(codes, len(symbols) + 1)
        ordered = codes[by]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(by) else by
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        return np.arange(len(by)), pa.array(list(suffixes.to_text(symbols)), pa.string()).take(pa.array(codes - 1)), rank

    return per_document(docs, seq_id, text, make, [("pos", "long", pa.int64()), ("symbol", "string", pa.string()), ("rank", "long", pa.int64())])


def symbol_histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(T.symbols(text)).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def bits_from_ints(ints: DataFrame, seq_id: str, pos: str, value: str, width: int = 32) -> DataFrame:
    """(seq_id, pos, bit): the bits of each integer, least significant first."""
    each = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j")
    rows = ints.select(F.col(seq_id).alias("seq_id"), F.col(pos).cast("long").alias("p"), F.col(value).cast("long").alias("v"), each)
    return rows.select("seq_id", (F.col("p") * width + F.col("j")).alias("pos"), (F.getbit("v", F.col("j")) == 1).alias("bit"))


def bit_rank(bits: DataFrame) -> DataFrame:
    """Adds ones and zeros: set and unset bits before each position; bits(seq_id, pos, bit)."""
    before = W.partitionBy("seq_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    ones = F.coalesce(F.sum(F.col("bit").cast("long")).over(before), F.lit(0))
    return bits.withColumn("ones", ones).withColumn("zeros", F.col("pos") - F.col("ones"))


def bit_select(bits: DataFrame) -> DataFrame:
    """(seq_id, i, pos): position of the i-th set bit, from 1."""
    i = F.row_number().over(W.partitionBy("seq_id").orderBy("pos")).cast("long")
    return bits.where("bit").select("seq_id", i.alias("i"), "pos")


def bit_access(bits: DataFrame, at: DataFrame, strict: bool = False) -> DataFrame:
    """The bits at the positions at(seq_id, pos); outside a sequence NULL, or an error with ``strict``."""
    found = at.join(bits, ["seq_id", "pos"], "left")
    if not strict:
        return found
    size = bits.groupBy("seq_id").agg((F.max("pos") + 1).alias("n"))
    message = F.concat(F.lit("Out of range access. Requested "), F.col("pos"), F.lit(" when range is [0, "), F.coalesce("n", F.lit(0)), F.lit(")"))
    return found.join(size, "seq_id", "left").select("seq_id", "pos", F.when(F.col("bit").isNotNull(), F.col("bit")).otherwise(F.raise_error(message).cast("boolean")).alias("bit"))
