"""Language identification by compression: the language whose raw-content zstandard dictionary packs a text best.

Training takes, for each language, documents in the order of a hash of id and text until ``dictionary_bytes`` are full
(of a range of hashes that holds about four times as much; equal rows count once). Of a document of more than
``dictionary_bytes`` / 32 characters it takes so many, from a place that the hash gives, so a language of long documents alone
is learned as well. The sample is bounded by ``dictionary_bytes`` for each language; more than ``max_languages`` are an error.

Text and dictionaries are lower-cased, and what is not a letter becomes a blank: case, digits and marks say nothing of
the language. A text is encoded whole, in blocks of ``BLOCK`` bytes, each against every dictionary, and the sizes are
summed. The smallest sum wins; ties go to the language that is more frequent in training. ``rejected`` is true where the best is not smaller than the
second by ``margin`` of itself. The score is the winner's share when sizes are read as code lengths in bytes (0.5 and
less: as good as a tie). Texts that are null or without a letter are ``und`` with score 0; so is everything when nothing
was learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.llm.common import carried, kept, uncarried, utf8

DICTIONARY_BYTES = 96 << 10
MAX_LANGUAGES = 1000
LEVEL = 6
BLOCK = 1024
MARGIN = 0.01


def letters(text: str) -> Column:
    """The text's letters in lower case, with single blanks for all else."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " ")


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES, max_languages: int = MAX_LANGUAGES) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the most frequent language first."""
    most_chars = dictionary_bytes // 32  # of four bytes at most
    spot = F.xxhash64(F.lit("dictionary"), F.col(doc_id), F.col(text))
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), spot.alias("h")).where("l is not null and t <> ''")
    begin = F.pmod("h", F.greatest(F.length("t") - most_chars + 1, F.lit(1))).cast("int") + 1
    rows = rows.select("l", "h", F.substring("t", begin, F.lit(most_chars)).alias("t")).withColumn("n", F.octet_length("t"))
    at = F.shiftrightunsigned("h", 1) / float(1 << 63)
    most = rows.groupBy("l").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("b"), F.min(at).alias("first")).orderBy(F.desc("c"), "l").limit(max_languages + 1).collect()
    if len(most) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages, or merge rare ones")
    if not most:
        return []
    # A range of hashes that holds a few dictionaries' worth of each language, so that no more than that is sorted.
    shares = [(r["l"], max(r["first"], min(1.0, 4 * dictionary_bytes / r["b"]))) for r in most]
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "l string, share double"))
    few = rows.join(share, "l").where(at <= F.col("share")).groupBy("l", "h").agg(F.min("t").alias("t"), F.min("n").alias("n"))
    order = W.partitionBy("l").orderBy("h")
    upto = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    picked = few.withColumn("upto", upto).withColumn("r", F.row_number().over(order)).where(F.col("upto") <= dictionary_bytes)
    held: dict[str, list] = {}
    for r in picked.select("l", "r", letters("t").alias("t")).collect():
        held.setdefault(r["l"], []).append((-r["r"], r["t"].encode()))
    return [(x, b"\n".join(t for _, t in sorted(held.get(x, [])))) for x in (m["l"] for m in most)]


def packers(dictionaries: list[tuple[str, bytes]], level: int = LEVEL) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, raw in dictionaries:
        # fewer than eight bytes are no dictionary
        held = zstandard.ZstdCompressionDict(raw.ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def sizes(text: bytes, made: list[zstandard.ZstdCompressor]) -> list[int]:
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in made]


def predict(text: bytes, languages: list[str], made: list[zstandard.ZstdCompressor], margin: float = MARGIN) -> tuple[str, float, bool]:
    """Of normalised text: language, score, rejected."""
    if not languages or not text.strip():
        return "und", 0.0, True
    n = sizes(text, made)
    best = min(range(len(n)), key=lambda k: n[k])
    share = 1 / sum(2.0 ** max(-1000, n[best] - x) for x in n)
    second = min((x for k, x in enumerate(n) if k != best), default=n[best] * 2)
    return languages[best], share, second - n[best] < margin * n[best]


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    df = carried(docs, _text=letters(text))
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: MAX_LANGUAGES x DICTIONARY_BYTES
    languages = [x for x, _ in dictionaries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = kept(("packers", *map(hash, sent.value)), lambda: packers(sent.value))
        for batch in batches:
            found = [predict(t, languages, made, margin) for t in utf8(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["_row", "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    schema = T.StructType([df.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return uncarried(df.mapInArrow(run, schema), docs.columns, ["lang_pred", "score", "rejected"])


def accuracy(predicted: DataFrame) -> float:
    """Share of held-out documents of known language with the right prediction; ``und`` counts as wrong."""
    r = predicted.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    return float(r["a"]) if r["a"] is not None else float("nan")


