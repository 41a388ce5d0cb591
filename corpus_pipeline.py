"""A training-data pipeline from five of the operators; each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontaminate, mixing, quality, similar, token_output
from textquarry.llm.common import stash, table
from textquarry.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    priced, bounds, _ = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(quality.score(docs.select(COLUMNS), priced), bounds).where("keep").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document of least id; rows that repeat it: one of them."""
    return similar.representatives(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_runs") == 0).select(COLUMNS)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; labels weigh the keys."""
    # counted before the join, so that only its last use moves texts
    counted = docs.select(*COLUMNS, mixing.n_words("text").alias("words"), F.xxhash64("text").alias("digest"))
    weighed = mixing.with_quality(counted, table(spark, sf_dir, "labels"))
    mixed = mixing.mix(weighed, quality="quality_weight", size="words", digest="digest").where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the token files, read back from them."""
    out, manifest = token_output.write_tokens(docs, tokenizer_path())
    return token_output.read_back(spark, out, manifest)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_to_targets),
    ("token-ID output", token_ids),
]

#: Tokenizer, language model and fingerprint tiles are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
