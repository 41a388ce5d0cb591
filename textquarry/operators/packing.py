"""Integers packed into 64-bit words, least significant bit first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.functions.text import low_bits, min_bits
from textquarry.sources import tables

FORMAT_VERSION = 1


def _words(placed: DataFrame) -> DataFrame:
    """placed(seq_id, v, first_bit, width) -> (seq_id, word_no, word). A value gives at most two words a part."""
    shift = F.pmod(F.col("first_bit"), F.lit(64)).cast("int")
    word = F.floor(F.col("first_bit") / 64)
    both = F.array(
        F.struct(word.alias("word_no"), F.expr("shiftleft(v, cast(pmod(first_bit, 64) as int))").alias("part")),
        F.when(shift + F.col("width") > 64, F.struct((word + 1).alias("word_no"), F.expr("shiftrightunsigned(v, cast(64 - pmod(first_bit, 64) as int))").alias("part"))),
    )
    rows = placed.select("seq_id", F.explode(F.array_compact(both)).alias("w")).select("seq_id", "w.word_no", "w.part")
    return rows.groupBy("seq_id", "word_no").agg(F.bit_or("part").alias("word"))


def pack(ints: DataFrame, width: int) -> DataFrame:
    """ints(seq_id, pos, value) -> words of elements ``width`` bits wide; values are cut to the width."""
    if not 1 <= width <= 64:
        raise ValueError("1 to 64 bits")
    return _words(ints.select("seq_id", F.col("value").cast("long").bitwiseAND(F.lit(low_bits(width))).alias("v"), (F.col("pos").cast("long") * width).alias("first_bit"), F.lit(width).alias("width")))


def pack_variable(ints: DataFrame, width: Column | None = None) -> DataFrame:
    """Elements of their own widths, one after the other; by default each takes its least number of bits."""
    before = W.partitionBy("seq_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = ints.withColumn("width", (min_bits("value") if width is None else width).cast("int"))
    mask = F.when(F.col("width") >= 64, F.lit(-1).cast("long")).otherwise(F.expr("shiftleft(1L, width) - 1"))
    return _words(rows.select("seq_id", F.col("value").cast("long").bitwiseAND(mask).alias("v"), F.coalesce(F.sum("width").over(before), F.lit(0)).cast("long").alias("first_bit"), "width"))


def unpack(words: DataFrame, lengths: DataFrame, width: int) -> DataFrame:
    """words and lengths(seq_id, n) -> (seq_id, pos, value). Each word sends its parts of the elements that touch it."""
    first = F.floor(F.col("word_no") * 64 / width)
    last = F.floor((F.col("word_no") * 64 + 63) / width)
    rows = words.select("seq_id", "word_no", "word", F.explode(F.sequence(first, last)).alias("pos"))
    begin = F.col("pos") * width - F.col("word_no") * 64
    rows = rows.withColumn("b", begin.cast("int"))
    part = F.when(F.col("b") >= 0, F.expr("shiftrightunsigned(word, b)")).otherwise(F.expr("shiftleft(word, -b)")).bitwiseAND(F.lit(low_bits(width)))
    found = rows.groupBy("seq_id", "pos").agg(F.bit_or(part).alias("value"))
    return found.join(lengths, "seq_id").where("pos < n").select("seq_id", "pos", "value")


def get_values(words: DataFrame, at: DataFrame, width: int, bits: int | None = None) -> DataFrame:
    """at(seq_id, pos) with value: ``bits`` bits (by default the width) from the start of each element, over two words at most."""
    bits = width if bits is None else bits
    if not 1 <= bits <= 64:
        raise ValueError("1 to 64 bits")
    first = F.col("pos") * width
    each = F.explode(F.sequence(F.floor(first / 64), F.floor((first + bits - 1) / 64))).alias("word_no")
    rows = at.select("seq_id", "pos", each).join(words, ["seq_id", "word_no"]).withColumn("b", (first - F.col("word_no") * 64).cast("int"))
    part = F.when(F.col("b") >= 0, F.expr("shiftrightunsigned(word, b)")).otherwise(F.expr("shiftleft(word, -b)")).bitwiseAND(F.lit(low_bits(bits)))
    return rows.groupBy("seq_id", "pos").agg(F.bit_or(part).alias("value"))


def set_values(words: DataFrame, new: DataFrame, width: int) -> DataFrame:
    """words with the elements new(seq_id, pos, value) replaced."""
    fresh = pack(new, width).withColumnRenamed("word", "put")
    cleared = pack(new.withColumn("value", F.lit(low_bits(width))), width).withColumnRenamed("word", "mask")
    both = words.join(fresh, ["seq_id", "word_no"], "left").join(cleared, ["seq_id", "word_no"], "left")
    kept = F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0).cast("long"))))
    return both.select("seq_id", "word_no", kept.bitwiseOR(F.coalesce("put", F.lit(0).cast("long"))).alias("word"))


def packed_bit_rank(words: DataFrame, at: DataFrame) -> DataFrame:
    """at(seq_id, pos) with ones: set bits before each position of packed words; whole words count by ``bit_count``."""
    before = W.partitionBy("seq_id").orderBy("word_no").rowsBetween(W.unboundedPreceding, -1)
    sums = words.withColumn("before", F.coalesce(F.sum(F.bit_count("word")).over(before), F.lit(0)))
    rows = at.withColumn("word_no", F.floor(F.col("pos") / 64)).join(sums, ["seq_id", "word_no"])
    inside = F.bit_count(F.col("word").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, cast(pos % 64 as int))"))))
    return rows.select("seq_id", "pos", (F.col("before") + inside).cast("long").alias("ones"))


def packed_size(words: DataFrame) -> DataFrame:
    return words.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_words"), (F.count(F.lit(1)) * 8).alias("size_in_bytes"))


def save_words(words: DataFrame, path: str) -> None:
    """Words with their format version."""
    tables.save(words, path, FORMAT_VERSION)


def load_words(spark: SparkSession, path: str) -> DataFrame:
    return tables.load(spark, path, FORMAT_VERSION).drop("format_version")
