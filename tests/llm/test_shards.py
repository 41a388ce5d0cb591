"""Layouts of shards: outliers, one key for all rows, no keys at all, equal rows."""

import os
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.llm import common, token_output
from textquarry.llm.queries import tokenizer_path

BIG = 1 << 62


@pytest.mark.parametrize(
    "ids",
    [
        list(range(1000)) + [BIG], [-BIG, *range(1000)], [7] * 1001, [None] * 1001, [None] * 400 + [7] * 400 + list(range(201)), [3, 3, 5], [], [-(1 << 63) + 1, None, (1 << 63) - 1],
    ],
)
@pytest.mark.parametrize("same", [False, True])
def test_no_shard_is_crowded(spark, ids, same, monkeypatch):
    monkeypatch.setattr(common, "RANGE_ROWS", 100)
    rows = [(i, "same" if same else f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3).withColumn("_tie", F.xxhash64("text"))
    opens = common.layout(df, "id", "_tie", 50)
    assert opens == common.layout(df.repartition(5), "id", "_tie", 50) == sorted(opens) and len(opens) == max(1, -(-len(ids) // 50))
    df = common.stash(df, "t")  # the rows' places must not change between actions
    placed = common.placed(df, "id", "_tie", opens)
    dealt = common.spread(placed).collect()
    assert len(dealt) == len(ids)
    assert max(Counter(r._shard for r in dealt).values(), default=0) <= 100
    key = lambda r: (r.id is not None, r.id or 0, r._tie)
    assert [key(r) for r in sorted(dealt, key=lambda r: (r._shard, *key(r)))] == sorted(key(r) for r in dealt)
    at = [((common.FIRST if r.id is None else r.id), r._tie) for r in placed.collect()]
    assert all(r._opens == (a in opens) and opens[r._shard] <= a for r, a in zip(placed.collect(), at, strict=True))


@pytest.mark.parametrize("ids", [list(range(300)) + [BIG], [7] * 301, [None] * 301])
def test_tokens_of_hot_ids(spark, ids, tmp_path):
    df = spark.createDataFrame([(i, "two words" if k % 3 else f"number {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    out, manifest = token_output.write_tokens(df, tokenizer_path(), str(tmp_path / "t"), rows_per_shard=20)
    assert manifest.agg(F.max("n_docs")).first()[0] <= 130 and manifest.count() > 5
    got = token_output.read_back(spark, out, manifest).orderBy("start").collect()
    assert len(got) == 301 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert Counter(r.doc_id for r in got) == Counter(ids)


def test_clean_up(spark):
    path = common.fresh_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert common.clean_up(spark) >= 1
    assert not spark._jvm.java.io.File(path.removeprefix("file:")).exists()


def test_workers_give_memory_back(spark):
    """A worker that has used much memory, and one that kept an object, hold neither when another stage's function begins."""

    def anonymous():
        return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Anonymous:")) >> 10

    def use(batches):
        common.kept(("big",), lambda: bytearray(b"x" * (64 << 20)))
        for batch in batches:
            some = [pa.array(range(1 << 12)) for _ in range(4000)]  # 128 MB
            del some
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [anonymous()]})

    def look(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [anonymous()]})

    df = spark.range(1).coalesce(1)
    before = df.mapInArrow(common.lean(use, keeps=True), "pid long, mb long").collect()[0]
    rows = [df.mapInArrow(common.lean(look), "pid long, mb long").collect()[0] for _ in range(60)]
    after = [r.mb for r in rows if r.pid == before.pid]
    assert before.mb > 64 and after and max(after) < before.mb - 64
