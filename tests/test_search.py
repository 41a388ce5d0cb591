"""Search and extraction against naive Python, on fixed examples and seeded random ones."""

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import search

BOUNDED = "What a string!\nNow this is long, indeed\nBut others could be longer."
LOG = "\n".join(f"08:{i % 60:02d} INFO worker-{i % 7}: block blk_{i * 7919 % 1000} č中 size={i}" for i in range(400))
TEXTS = ["This is a long string\0", "This \0is a \0long string\0", BOUNDED, BOUNDED + "\n", LOG, "", "x", "aaaa", "\n", "a.b\\E(a.b", "a\U0001f600b\U0001f600", None, LOG, "ab" * 500]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("pos", F.lit("clash")).repartition(3).cache()


def positions(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]


def around(text, i, boundary):
    if not 0 <= i < len(text):
        return None, None, None
    if text[i] == boundary:
        return "", "", ""
    left, right = text[: i + 1].rpartition(boundary)[2], text[i + 1 :].partition(boundary)[0]
    return left + right, left, right


PATTERNS = ["is", "a long", "\0", "aa", "abab", "INFO", "baaa", "a.b", "\\E", "\U0001f600", "中 s", "\n", "this is not here at all"]


def test_count_and_locate(docs):
    r = random.Random(42)
    cut = [LOG[i : i + n] for i, n in ((r.randrange(len(LOG) - 40), r.randrange(1, 32)) for _ in range(12))]
    patterns = PATTERNS + cut
    got = docs.select("doc_id", *[T.count_overlapping("text", p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for row in got:
        t = TEXTS[row.doc_id]
        assert list(row)[1:] == [None if t is None else len(positions(t, p)) for p in patterns]
    for p in patterns[:14]:
        want = Counter((d, i) for d, t in enumerate(TEXTS) if t for i in positions(t, p))
        assert Counter((x.doc_id, x.pos) for x in search.locate_all(docs, p).collect()) == want
        some = search.locate_all(docs, p, limit=3).collect()
        assert Counter((x.doc_id, x.pos) for x in some) == Counter((d, i) for d, t in enumerate(TEXTS) if t for i in positions(t, p)[:3])


def test_orders(docs):
    for p in ("is", "a", "INFO"):
        for order, key in (("suffix", lambda t: lambda i: t[i:]), ("code", lambda t: lambda i: [list(dict.fromkeys(t)).index(c) for c in t[i:]])):
            got = search.locate_all(docs.where("length(text) < 100 or doc_id = 4" if order == "suffix" else "length(text) < 100"), p, limit=2, order=order).orderBy("doc_id", "match_no").collect()
            want = [(d, i) for d, t in enumerate(TEXTS) if t and (len(t) < 100 or order == "suffix" and d == 4) for i in sorted(positions(t, p), key=key(t))[:2]]
            assert [(x.doc_id, x.pos) for x in got] == want


def test_pattern_arguments(docs):
    for call in (lambda: T.count_overlapping("text", ""), lambda: search.locate_all(docs, ""), lambda: search.locate_all(docs, "a", limit=0), lambda: search.locate_all(docs, "a", order="no"), lambda: T.count_sliced_pattern("text", "abc", 1, 0), lambda: T.utf8_pattern(b"\xf0\x9f\x98\x80", strict=True)):
        with pytest.raises(ValueError):
            call()
    assert T.utf8_pattern("a中\U0001f600".encode()) == "a中\U0001f600"
    n = docs.where("doc_id = 0").select(T.count_sliced_pattern("text", "is a long", 0, 2).alias("n")).first().n
    assert n == 2


@pytest.mark.parametrize("text", [BOUNDED, BOUNDED + "\n", "a", "\n", "ab\n\ncd", "no boundary"])
def test_boundaries(spark, text):
    df = spark.range(-1, len(text) + 2).select(F.lit(text).alias("text"), F.col("id"))
    got = df.select("id", *[f("text", F.col("id"), "\n").alias(f.__name__) for f in (T.extract_until_boundary, T.extract_boundary_left, T.extract_boundary_right)]).collect()
    assert [tuple(r)[1:] for r in got] == [around(text, r.id, "\n") for r in got]


def test_extract(docs):
    for a, b in ((0, 0), (0, 5), (3, 3), (10, 21), (60, 67), (5, 2), (-1, 3), (0, 10**6)):
        got = docs.select("doc_id", T.extract_range("text", a, b).alias("x")).collect()
        assert all(r.x == (TEXTS[r.doc_id][a:b] if TEXTS[r.doc_id] is not None and 0 <= a <= b <= len(TEXTS[r.doc_id]) else None) for r in got)


def test_strict_messages(docs):
    one = docs.where("doc_id = 2")
    cases = [
        (T.extract_range("text", -1, 3, strict=True), "Requested position less than 0"), (T.extract_range("text", 0, 99, strict=True), "Stop position longer than index string"),
        (T.extract_range("text", 0, 9, strict=True, max_chars=5), "Extraction does not fit"), (T.extract_until_boundary("text", 68, strict=True), "Requested position longer than index string"),
        (T.extract_boundary_left("text", -1, strict=True), "Requested position less than 0"), (T.extract_boundary_right("text", 3, "#", strict=True), "Boundary does not exist"),
    ]
    for column, message in cases:
        with pytest.raises(PySparkException, match=message):
            one.select(column).collect()
    with pytest.raises(ValueError):
        T.extract_until_boundary("text", 0, "ab")


def test_composites(docs):
    got = Counter((r.doc_id, r.pos, r.record) for r in search.grep_records(docs, "INFO").collect())
    assert got == Counter((d, i, around(t, i, "\n")[0]) for d, t in enumerate(TEXTS) if t for i in positions(t, "INFO"))
    got = Counter((r.doc_id, r.pos, r.extract) for r in search.locate_and_extract(docs, "s", 5, limit=4).collect())
    assert got == Counter((d, i, t[i : i + 5]) for d, t in enumerate(TEXTS) if t for i in positions(t, "s")[:4])
    got = Counter((r.doc_id, r.fragment) for r in search.extract_key_value(docs, "size=", "\n").collect())
    assert got == Counter((d, t[i:].partition("\n")[0]) for d, t in enumerate(TEXTS) if t for i in positions(t, "size="))


@pytest.mark.parametrize("size", [1 << 20, 8])
def test_many_patterns(spark, docs, size):
    made = [(k, p) for k, p in enumerate([*PATTERNS, "is", "", None])]
    got = search.multi_pattern_count(docs, spark.createDataFrame(made, "pattern_id long, pattern string"), slice_bytes=size).collect()
    assert Counter(map(tuple, got)) == Counter((d, k, n) for d, t in enumerate(TEXTS) if t for k, p in made if p and (n := len(positions(t, p))))


def test_pushdown(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = search.locate_all(docs, "tion")._jdf.queryExecution().toString()
    assert "StringContains(text,tion)" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
