"""SQL functions, streams, and the driver's contract."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import transform
from textquarry.plans import catalog
from textquarry.plans.sql import register
from textquarry.streaming import search as streams

SF = "/root/testdata/sf0.001"


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "aaaa\nb.a"), (2, ""), (3, None)], "id long, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT count_literal(t, 'aa') c, count_literal(t, '.') d, extract_range(t, 1, 3) x, extract_around(t, 2, '\n') b, extract_left(t, 2, '\n') l, extract_right(t, 2, '\n') r, symbol_rank(t, 3, 'a') k, redundancy(t) n FROM texts ORDER BY id").collect()
    assert tuple(got[0]) == (3, 1, "aa", "aaaa", "aaa", "a", 3, 8 / 5) and tuple(got[2]) == (None,) * 8
    assert tuple(got[1])[:7] == (0, 0, None, None, None, None, 0)
    assert spark.sql("SELECT min_bits(5) b").first().b == 3
    assert [r.pos for r in spark.sql("SELECT pos FROM texts, LATERAL locate_all(t, 'a') WHERE id = 1 ORDER BY pos").collect()] == [0, 1, 2, 3, 7]


def test_streams(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for name, make in (("counts", lambda s: streams.count_stream(s, "tion")), ("records", lambda s: streams.record_stream(s, "tion"))):
        q = make(stream).writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    want = docs.where(F.col("text").contains("tion")).select("doc_id", T.count_overlapping("text", "tion"))
    assert Counter(map(tuple, spark.table("counts").select("doc_id", "n").collect())) == Counter(map(tuple, want.collect()))
    records = Counter((r.doc_id, x) for r in docs.collect() for x in r.text.split("\n") if "tion" in x)
    assert Counter(map(tuple, spark.table("records").select("doc_id", "record").collect())) == records


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "props")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed_counts(stream, "1", "ts", "props", "1 day").writeStream.format("memory").outputMode("complete").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = streams.windowed_counts(events, "1", "ts", "props", "1 day")
    assert Counter(map(tuple, spark.table("windows").collect())) == Counter(map(tuple, batch.collect()))


def test_whole_documents_beyond_sql(spark):
    """Transforms invert to the texts, sampled suffixes ascend and are complete, redundancies are those of the runs."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}
    runs = lambda t: sum(a != b for a, b in zip(t, t[1:])) + 1
    bwt = {r.seq_id: r.bwt.replace("$", "\0") for r in transform.bwt(spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string"), mark="$").collect() if "$" not in texts[r.seq_id]}
    assert bwt == {r.seq_id: r.bwt.replace("$", "\0") for r in catalog.QUERIES["bwt_documents"](spark, SF).collect() if "$" not in texts[r.seq_id]} and len(bwt) > 100
    for d, column in bwt.items():
        order = sorted(range(len(column)), key=column.__getitem__)  # stable
        row, out = order[0], []
        for _ in range(len(column) - 1):
            row = order[row]
            out.append(column[row])
        assert "".join(out) == texts[d]
    got = {r.seq_id: (r.text_redundancy, r.bwt_redundancy) for r in catalog.QUERIES["bwt_redundancy_documents"](spark, SF).collect()}
    assert set(got) == {d for d, t in texts.items() if t}
    assert all(got[d] == (len(texts[d]) / runs(texts[d]), len(c) / runs(c)) for d, c in bwt.items() if texts[d])
    samples = {}
    for r in sorted(catalog.QUERIES["sampled_suffixes_documents"](spark, SF).collect(), key=lambda r: (r.seq_id, r.sa_rank)):
        samples.setdefault(r.seq_id, []).append(r.pos)
    for d, t in texts.items():
        assert sorted(samples[d]) == list(range(0, len(t) + 1, 32)) and all(t[a:] < t[b:] for a, b in zip(samples[d], samples[d][1:]))


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    found = c.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(names).collect())) == Counter(found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "pos", "record"]
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports and answers when the training-data operators are taken away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "textquarry", tmp_path / "textquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    r = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert r.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))], r.stderr
