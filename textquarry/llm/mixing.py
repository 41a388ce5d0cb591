"""Mixing sources to target weights, by DataFrame functions alone.

Targets: sources in code-point order (null last) take the weights in turn and share the budget; a target stops at
``cap`` times its source's size, and the excess is shared out again by weight until none is above. That fixed point is a
water level, found in one pass over the sources sorted by cap over weight.

Selection: Efraimidis-Spirakis keys -ln(u) / w, u a hash of seed, id and text, w the document's quality weight. A source's
target is first met by complete epochs; of the rest, documents are taken in key order while the middle of a document
lies within the budget, so the miss is at most half a document. Keys, sources and sizes alone are written once; prefix
sums run over ranges of keys, and the one range of a source that its budget cuts is divided again until ``SORTED`` rows or
fewer are left to sort, whatever the weights: no task holds a source. What comes out is one key for each source.

Null texts have size 0 and are taken as often as complete epochs say (0 words). Null or non-positive weights: null
counts as 1, others come last. Rows that repeat an id are separate documents; if they also share their text they are
interchangeable. Empty tables give empty results. Clashing column names give way to the outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.llm.common import stash

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Ranges that a cut range is divided into, and rows of a source that are sorted at most unless their keys are equal.
RANGES = 4096
SORTED = 100_000
#: Quality weights of documents that are labelled good, not labelled, and labelled bad or toxic.
GOOD, UNKNOWN, BAD = 1.0, 0.5, 0.1
SEED = 20240
#: Sources up to which their targets are broadcast; more are joined by shuffle.
MAX_BROADCAST = 100_000
OUTPUTS = ["size", "source_size", "target", "epochs", "copies", "taken"]


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """(source, source_size) with target: one row for each source, few enough for one task."""
    all_rows, turn = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("w"))
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("level", (F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)).withColumn("at", F.row_number().over(up))
    held = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(all_rows)["level"]
    return df.withColumn("held", held).select("source", "source_size", F.coalesce(F.least(F.col("most"), F.col("held") * F.col("w")), F.col("most")).alias("target"))


def with_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", name: str = "quality_weight") -> DataFrame:
    """``docs`` with a quality weight from labels(doc_id, quality, toxic); of several labels of an id the worst counts."""
    bad = F.coalesce(F.col("quality") <= 0, F.lit(False)) | F.coalesce(F.col("toxic") > 0, F.lit(False))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("_label")).agg(F.min(F.when(bad, BAD).otherwise(GOOD)).alias("_weight"))
    # labels grow with the documents, so they are never broadcast
    found = docs.drop(name).join(known.hint("merge"), F.col(doc_id) == F.col("_label"), "left")
    return found.withColumn(name, F.coalesce("_weight", F.lit(UNKNOWN))).drop("_label", "_weight")


def _cut(bins: DataFrame, goal: DataFrame) -> DataFrame:
    """bins(s, b, in_bin, n, low, high), in order, and goal(source, rest, before): how the budget ends in them, a row for
    each source: whole, the largest key of the bins within it; and low, high, n, before of the bin that it cuts."""
    rows = bins.join(goal.select("source", "rest", "before"), F.col("s").eqNullSafe(F.col("source"))).withColumn("upto", F.col("before") + F.sum("in_bin").over(W.partitionBy("s").orderBy("b")))
    within = (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))
    cut = (F.col("upto") - F.col("in_bin") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    found = rows.groupBy("s").agg(F.max(F.when(within, F.col("high"))).alias("whole"), F.max(F.when(cut, F.struct("low", "high", "n", (F.col("upto") - F.col("in_bin")).alias("before")))).alias("c"))
    return found.select("s", "whole", "c.low", "c.high", "c.n", "c.before")


def _thresholds(keys: DataFrame, goal: DataFrame) -> DataFrame:
    """keys(s, key, size), goal(source, rest) -> (s, whole, some, some_n): keys up to ``whole`` are taken, and some_n of the
    rows whose key is ``some``."""
    measures = (F.sum("size").alias("in_bin"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    # keys of any weights: ranges of equal ratio; infinite ones together
    octave = F.when(F.col("key") < float("inf"), F.floor(F.log2("key") * 256)).otherwise(F.lit(1 << 40))
    at = stash(_cut(keys.groupBy("s", octave.alias("b")).agg(*measures), goal.withColumn("before", F.lit(0).cast("long"))), "mix-cut")
    whole = F.col("whole")
    while at.where((F.col("n") > SORTED) & (F.col("low") < F.col("high"))).limit(1).count():
        mine = keys.join(at.select(F.col("s").alias("source"), "low", "high"), F.col("s").eqNullSafe(F.col("source")) & F.col("key").between(F.col("low"), F.col("high")))
        part = F.when(F.col("low") < F.col("high"), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES)).otherwise(F.lit(0))
        bins = mine.select("s", part.alias("b"), "size", "key").groupBy("s", "b").agg(*measures)
        left = goal.select("source", "rest").join(at.select(F.col("s").alias("s0"), "before"), F.col("source").eqNullSafe(F.col("s0"))).where("before is not null").drop("s0")
        finer = _cut(bins, left).select(F.col("s").alias("s1"), F.col("whole").alias("whole1"), *[F.col(c).alias(f"{c}1") for c in ("low", "high", "n", "before")])
        joined = at.join(finer, F.col("s").eqNullSafe(F.col("s1")), "left")
        at = stash(joined.select("s", F.coalesce("whole1", whole).alias("whole"), *[F.col(f"{c}1").alias(c) for c in ("low", "high", "n", "before")]), "mix-cut")
    ends = at.select(F.col("s").alias("source"), "low", "high", "before").join(goal.select(F.col("source").alias("g"), "rest"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    rows = keys.join(ends, F.col("s").eqNullSafe(F.col("source")) & F.col("key").between(F.col("low"), F.col("high")))
    # rows of one key are alike
    rows = rows.groupBy("s", "key", "before", "rest").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(W.partitionBy("s").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = F.when(F.col("size") > 0, F.least(F.col("n"), F.floor(F.col("room") / F.col("size") + 0.5))).when(F.col("room") >= 0, F.col("n")).otherwise(F.lit(0))
    rows = rows.withColumn("room", room).withColumn("taken", taken)
    last = rows.groupBy(F.col("s").alias("s1")).agg(F.max(F.when(F.col("taken") == F.col("n"), F.col("key"))).alias("last"), F.max(F.when((F.col("taken") > 0) & (F.col("taken") < F.col("n")), F.struct("key", "taken"))).alias("p"))
    return at.join(last, F.col("s").eqNullSafe(F.col("s1")), "left").select("s", F.greatest(whole, F.col("last")).alias("whole"), F.col("p.key").alias("some"), F.col("p.taken").alias("some_n"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = SEED, size: str | None = None, digest: str | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, epochs, copies (how often it is taken) and taken (words, repeats counted).

    ``quality`` names the column of weights. Where ``size`` and ``digest`` name columns with the number of words and
    XXH64 of the text, the text itself is not needed.
    """
    w = F.coalesce(F.col(quality).cast("double"), F.lit(1.0)) if quality else F.lit(1.0)
    words, hashed = F.col(size) if size else n_words(text), F.col(digest) if digest else F.xxhash64(text)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), hashed), 11).cast("double") + 0.5) / float(1 << 53)
    key = F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf")))
    kept = [c for c in docs.columns if c not in OUTPUTS]
    shaped = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(source).alias("s"), words.cast("long").alias("size"), key.alias("key"))
    keys = stash(shaped.select("s", "key", "size"), "mix-keys")
    goal = targets(keys.groupBy(F.col("s").alias("source")).agg(F.sum("size").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = stash(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    plan = stash(goal.drop("rest").join(_thresholds(keys, goal), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-plan")
    few = plan.count() <= MAX_BROADCAST
    joined = shaped.join(F.broadcast(plan) if few else plan, F.col("s").eqNullSafe(F.col("source")))
    first = F.coalesce(F.col("key") <= F.col("whole"), F.lit(False)).cast("long")
    out = lambda df, more: df.withColumn("copies", F.col("epochs") + more).select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "size", "source_size", "target", "epochs", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    if not plan.where("some is not null").limit(1).count():
        return out(joined, first)
    # equal rows of which the budget takes some
    alike = F.coalesce(F.col("key") == F.col("some"), F.lit(False))
    some = joined.where(alike).withColumn("number", F.row_number().over(W.partitionBy("s").orderBy("size")))
    return out(joined.where(~alike), first).unionByName(out(some, (F.col("number") <= F.col("some_n")).cast("long")))
