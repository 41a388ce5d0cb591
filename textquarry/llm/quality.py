"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Every task counts the distinct n-grams of a chunk of documents (``CHUNK_BYTES`` of text), and how often trusted documents
have them. Counts, continuation counts, count-of-count discounts, and the conditional probability of every n-gram that
occurs anywhere are then joins and aggregates of count tables, sharded by n-gram or context, whose size grows with the
corpus. The cost of an n-gram goes back to the chunks that have it, and a document's perplexity is the sum over its own:
no worker holds the model, and no text is shuffled.

A chunk is a run of rows of one task, known by the task's number, its own and a hash of its first text. So the documents
must come in the same order in the same partitions each time they are read, as a table in files does; where they do not, an
error says so (``stash`` such a table first).

A document's score is its mean negative log-likelihood in nats a byte, drawn towards the mean of its language as if
``prior`` further bytes had that mean: a short text alone proves little. One trusted document in ``HELD_OUT``, by a hash of
its id, is not trained on, and gives means and limits: documents above the stated quantile of those of their language
are rejected. A language (or null) with fewer than ``MIN_TRUSTED`` of them takes the quantile of all.

Null and empty texts have the mean score of their language and are kept. Without trusted text that is held out nothing is
rejected. Rows that repeat an id are scored row by row. Clashing column names give way to the outputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textquarry.llm.common import carried, filesystem, fresh_path, lean, stash, uncarried, utf8

#: Bytes of an n-gram; eight at most.
ORDER = 5
#: Opens and closes a text; never a byte of UTF-8.
EDGE = b"\xff"
PRIOR = 300.0
QUANTILE = 0.995
MIN_TRUSTED = 100
#: One trusted document in so many is kept from training.
HELD_OUT = 4
#: Scores are binned this finely for the quantiles, which are then the same on every run.
BIN = 1e-3
#: Languages up to which their means and limits are broadcast; more are joined by shuffle.
MAX_BROADCAST = 100_000
#: Bytes of text in a chunk, in the pieces of it that are unpacked, and that are handled at once.
CHUNK_BYTES = 128 << 20
PIECE_BYTES = 4 << 20
BLOCK = 1 << 19


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Chunk, number of the first row in it, and rows; ``_text`` is their text. Pieces of a chunk follow each other."""
    task, number, held, at, key = TaskContext.get().partitionId(), 0, 0, 0, None
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            if key is None:
                first = batch.column("_text")[start].as_py() or ""
                key, held, at = xxhash.xxh64_intdigest(f"{task} {number} {first}") - (1 << 63), 0, 0
            before = size[start - 1] if start else 0
            stop = min(batch.num_rows, int(np.searchsorted(size, before + min(PIECE_BYTES, CHUNK_BYTES - held))) + 1)
            yield key, at, batch.slice(start, stop - start)
            held, at, start = held + size[stop - 1] - before, at + stop - start, stop
            if held >= CHUNK_BYTES:
                key, number = None, number + 1


def blocks(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, places of their first n-grams, and n-grams as numbers, about ``BLOCK`` at a time; a long text takes several."""
    pieces: list[tuple[int, bytes]] = []
    held, edges = 0, EDGE * (order - 1)

    def codes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
        n = np.array([len(p) - order + 1 for _, p in pieces])
        found = np.zeros(len(joined) - order + 1, np.uint64)
        for k in range(order):
            found = found << np.uint64(8) | joined[k : len(joined) - order + 1 + k]
        inside, ends = np.ones(len(found), bool), np.cumsum(n + order - 1)[:-1]
        for k in range(1, order):
            inside[ends - k] = False
        return np.array([i for i, _ in pieces]), np.cumsum(n) - n, found[inside].view(np.int64)

    for i, t in enumerate(texts):
        whole = edges + t + EDGE
        for a in range(0, len(t) + 1, BLOCK):
            pieces.append((i, whole[a : a + BLOCK + order - 1]))
            held += len(pieces[-1][1])
            if held >= BLOCK:
                yield codes()
                pieces, held = [], 0
    if pieces:
        yield codes()


def _side_table(path: str, chunk: int, columns: list[str]) -> pa.Table:
    """A chunk's rows of a table that is written by chunk."""
    fs, base = filesystem(f"{path}/chunk={chunk}")
    try:
        return pq.read_table(base, filesystem=fs, columns=columns, partitioning=None)
    except FileNotFoundError as e:
        raise ValueError("the documents changed between two readings: write them to a table first") from e


def _by_chunk(df: DataFrame, name: str, *order: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.repartition("chunk").sortWithinPartitions("chunk", *order).write.partitionBy("chunk").parquet(path)
    return path


def trained_rows(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> str:
    """For each chunk, the numbers of the rows whose id is among ``ids``. Ids alone are shuffled."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, at, part in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, key)), pa.array(np.arange(at, at + part.num_rows)), part.column("id")], names=["chunk", "at", "id"])

    rows = stash(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("_text")).mapInArrow(lean(run), f"chunk long, at long, id {kind}"), "chunk-rows")
    wanted = rows.where("id is not null").join(ids.select(F.col("doc_id").alias("id")), "id", "left_semi").select("chunk", "at")
    every = rows.select("chunk").distinct().withColumn("at", F.lit(None).cast("long"))
    return _by_chunk(wanted.unionByName(every), "trained-rows", "at")


def gram_table(docs: DataFrame, trained: str | None, text: str = "text", order: int = ORDER) -> DataFrame:
    """(chunk, gram, n): the distinct n-grams of each chunk and how often its ``trained`` rows have them."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(grams)
        grams = grams[by]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        return grams[first], np.add.reduceat(n[by], first)

    def counted(grams: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, and how often each is taught: plain sorts, which are some times faster than sorting places."""
        ordered = np.sort(grams)
        distinct = ordered[np.append(True, ordered[1:] != ordered[:-1])]
        n, ordered = np.zeros(len(distinct), np.int64), np.sort(grams[taught])
        if len(ordered):
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            n[np.searchsorted(distinct, ordered[first])] = np.diff(np.append(first, len(ordered)))
        return distinct, n

    def made(key: int, parts: list) -> Iterator[pa.RecordBatch]:
        if parts:
            grams, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), key)), pa.array(grams), pa.array(n)], names=["chunk", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, rows = None, [], np.zeros(0, np.int64)
        for chunk, at, batch in chunks(batches):
            if chunk != key:
                yield from made(key, parts)
                key, parts = chunk, []
                rows = _side_table(trained, key, ["at"])["at"].drop_null().to_numpy() if trained else rows
            texts = utf8(batch.column("_text"))
            taught = np.isin(np.arange(at, at + len(texts)), rows)
            for which, first, grams in blocks(texts, order):
                parts.append(counted(grams, np.repeat(taught[which], np.diff(np.append(first, len(grams))))))
            if len(parts) > 16:
                parts = [summed(parts)]
        yield from made(key, parts)

    return stash(docs.select(F.col(text).alias("_text")).mapInArrow(lean(run), "chunk long, gram long, n long"), "grams")


def _low(k: int) -> int:
    """A mask of the last k bytes."""
    return (1 << 8 * k) - 1 if k < 8 else -1


def _discounted(counts: DataFrame, context) -> DataFrame:
    """counts(gram, n) with ``context``, ``own`` (the discounted share) and ``back`` (the context's weight for the lower order)."""
    n = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    y = n[0] / max(1, n[0] + 2 * n[1])
    d = [max(0.0, min(float(k), k - (k + 1) * y * n[k] / max(1, n[k - 1]))) for k in (1, 2, 3)]
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    rows = counts.withColumn("context", context).withColumn("cut", F.least(cut, F.col("n").cast("double")))
    sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("off"))
    return rows.join(sums, "context").select("gram", "context", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), (F.col("off") / F.col("total")).alias("back"))


def train(grams: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """The model from the trusted counts of :func:`gram_table`: for k = 1 to ``order``, (gram, context, own, back) of the
    k-grams, written."""
    counts = stash(grams.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    model = []
    for k in range(order, 0, -1):
        context = F.shiftrightunsigned("gram", 8) if k > 1 else F.lit(0).cast("long")
        model.append(stash(_discounted(counts, context), "model"))
        if k > 1:
            counts = stash(counts.groupBy(F.col("gram").bitwiseAND(F.lit(_low(k - 1))).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "counts")
    return model[::-1]


def probabilities(asked: DataFrame, model: list[DataFrame]) -> DataFrame:
    """asked(gram), distinct -> (gram, p) of each. Of every order, only the k-grams that are asked for are looked up."""
    wanted = [asked]
    for k in range(len(model) - 1, 0, -1):
        wanted.append(stash(wanted[-1].select(F.col("gram").bitwiseAND(F.lit(_low(k))).alias("gram")).distinct(), "asked"))
    found = None
    for k, (rows, level) in enumerate(zip(reversed(wanted), model, strict=True), 1):
        own = rows.join(level.select("gram", "own"), "gram", "left")
        if found is None:
            one = level.select("back").first()
            lower = (one["back"] if one else 1.0) / 256
            found = own.select("gram", (F.coalesce("own", F.lit(0.0)) + lower).alias("p"))
        else:
            back = level.select(F.col("context").alias("c"), "back").distinct()
            own = own.withColumn("c", F.shiftrightunsigned("gram", 8)).join(back, "c", "left")
            lower = found.select(F.col("gram").alias("low"), F.col("p").alias("q"))
            own = own.withColumn("low", F.col("gram").bitwiseAND(F.lit(_low(k - 1)))).join(lower, "low")
            found = own.select("gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("q")).alias("p"))
        found = stash(found, "probabilities")
    return found


def costs(grams: DataFrame, model: list[DataFrame]) -> str:
    """What each n-gram of each chunk costs, written by chunk."""
    asked = stash(grams.select("gram").distinct(), "asked")
    found = probabilities(asked, model).select("gram", (-F.log(F.greatest("p", F.lit(1e-12)))).cast("float").alias("cost"))
    return _by_chunk(grams.select("chunk", "gram").join(found, "gram"), "costs", "gram")


def score(docs: DataFrame, priced: str, text: str = "text", order: int = ORDER) -> DataFrame:
    """``docs`` with nll (nats of the whole text, its end included) and n_scored (bytes and the end), by their :func:`costs`."""
    df = carried(docs)

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_row")
            yield pa.RecordBatch.from_arrays([row, pc.struct_field(row, text)], names=["_row", "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for chunk, _, part in chunks(with_text(batches)):
            if chunk != key:
                key, found = chunk, _side_table(priced, chunk, ["gram", "cost"])
                grams, cost = found["gram"].to_numpy(), found["cost"].to_numpy().astype(np.float64)
            texts = utf8(part.column("_text"))
            nll, n = np.zeros(len(texts)), np.array([len(t) + 1 for t in texts], np.int64)
            for which, first, codes in blocks(texts, order):
                place = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
                if (grams[place] != codes).any():
                    raise ValueError("the documents changed between two readings: write them to a table first")
                np.add.at(nll, which, np.add.reduceat(cost[place], first))
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(nll), pa.array(n)], names=["_row", "nll", "n_scored"])

    from pyspark.sql import types as T

    schema = T.StructType([df.schema["_row"], T.StructField("nll", T.DoubleType()), T.StructField("n_scored", T.LongType())])
    return uncarried(df.mapInArrow(lean(run), schema), docs.columns, ["nll", "n_scored"])


def limits(scored: DataFrame, quantile: float = QUANTILE, prior: float = PRIOR) -> DataFrame:
    """(lang, mean, limit) from the scores (lang, nll, n_scored) of trusted documents; lang null also stands for the rest."""
    both = scored.select(F.explode(F.array(F.struct(F.lit(False).alias("any"), "lang"), F.struct(F.lit(True).alias("any"), F.lit(None).cast("string").alias("lang")))).alias("k"), "nll", "n_scored").select("k.*", "nll", "n_scored").where("any or lang is not null")
    # sums over bins of fixed point, so that the order of addition cannot show
    sums = both.groupBy("any", "lang").agg((F.sum((F.col("nll") * 1024).cast("long")) / 1024 / F.sum("n_scored")).alias("mean"), F.count(F.lit(1)).alias("docs"))
    sums = stash(sums, "language-means")
    sums = F.broadcast(sums) if sums.count() <= MAX_BROADCAST else sums
    z = F.round((F.col("nll") + prior * F.col("mean")) / (F.col("n_scored") + prior) / BIN).cast("long")
    bins = both.alias("b").join(sums.alias("s"), (F.col("b.lang").eqNullSafe(F.col("s.lang"))) & (F.col("b.any") == F.col("s.any"))).groupBy("b.any", "b.lang", "mean", "docs", z.alias("z")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("any", "lang").orderBy("z"))
    return bins.withColumn("upto", upto).where(F.col("upto") >= F.col("docs") * quantile).groupBy("any", "lang", "mean", "docs").agg(((F.min("z") + 1) * BIN).alias("limit"))


def classify(scored: DataFrame, bounds: DataFrame, prior: float = PRIOR, min_trusted: int = MIN_TRUSTED) -> DataFrame:
    """``scored`` with score, perplexity, limit and keep."""
    rest = bounds.where("any").select(F.col("mean").alias("_mean0"), F.col("limit").alias("_limit0"))
    own = bounds.where(~F.col("any") & (F.col("docs") >= min_trusted)).select(F.col("lang").alias("_lang"), F.col("mean").alias("_mean"), F.col("limit").alias("_limit"))
    one = rest.first()
    mean0, limit0 = (one["_mean0"], one["_limit0"]) if one else (0.0, float("inf"))
    df = scored.join(F.broadcast(own), F.col("lang") == F.col("_lang"), "left") if own.count() <= MAX_BROADCAST else scored.join(own, F.col("lang") == F.col("_lang"), "left")
    mean, limit = F.coalesce("_mean", F.lit(mean0)), F.coalesce("_limit", F.lit(limit0))
    z = F.when(F.col("n_scored") <= 1, mean).otherwise((F.col("nll") + prior * mean) / (F.col("n_scored") + prior))
    return df.withColumns({"score": z, "perplexity": F.exp(z), "limit": limit, "keep": z <= limit}).drop("_lang", "_mean", "_limit")


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that are labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").where("doc_id is not null").distinct()


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.xxhash64(F.lit("held out"), doc_id), F.lit(HELD_OUT)) == 0


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior: float = PRIOR, order: int = ORDER) -> tuple[str, DataFrame, DataFrame]:
    """The documents' costs, limits, and the narrow scores (doc_id, lang, nll, n_scored) of all documents. Labels grow with
    the documents, so they are never broadcast."""
    good = good_ids(labels)
    grams = gram_table(docs, trained_rows(docs, good.where(~held_out()).hint("merge")), order=order)
    priced = costs(grams, train(grams, order))
    scored = stash(score(docs.select("doc_id", "lang", "text"), priced, order=order).drop("text"), "scores")
    bounds = stash(limits(scored.join(good.where(held_out()).hint("merge"), "doc_id", "left_semi"), quantile, prior), "limits")
    return priced, bounds, scored


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, score, perplexity, limit, keep."""
    _, bounds, scored = fit(docs, labels)
    return classify(scored, bounds).select("doc_id", "lang", (F.col("n_scored") - 1).alias("n_bytes"), "score", "perplexity", "limit", "keep")
