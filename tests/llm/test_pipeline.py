"""The pipeline, stage by stage and as a whole, against brute force."""

import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
from tests.llm.test_operators import brute_targets
from tests.llm.test_similar import brute_groups
from textquarry.llm import quality
from textquarry.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, steps = docs, []
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        steps.append([tuple(r) for r in kept.collect()])
    first, second, third, fourth = steps
    good = {r.doc_id for r in quality.quality(spark, docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
    assert Counter(first) == Counter(tuple(r) for r in docs.collect() if r.doc_id in good)

    least = brute_groups(first)
    assert Counter(second) == Counter(min(x) for x in least) and len(second) < len(first)

    grams = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(item.text)
        grams |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = lambda t: not any(f" {g} " in f" {' '.join(words(t))} " for g in grams)
    assert Counter(third) == Counter(r for r in second if clean(r[1])) and len(third) < len(second)

    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in third:
        sizes[r[3]] += n(r[1])
        largest[r[3]] = max(largest[r[3]], n(r[1]))
    for r in fourth:
        taken[r[3]] += n(r[1])
    want = brute_targets(sizes)
    assert set(fourth) <= set(third) and max(Counter(fourth).values()) <= 3
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)

    import numpy as np
    from tokenizers import Tokenizer

    t, start, tokens = Tokenizer.from_file(tokenizer_path()), 0, Counter()
    for r in sorted(fourth, key=lambda r: (r[0], r[1])):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        tokens[r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    last = pipeline.STAGES[-1][1](spark, kept, SF)
    assert Counter(map(tuple, last.collect())) == tokens
    assert Counter(map(tuple, pipeline.run(spark, SF).collect())) == tokens


def test_awkward_tables(spark, tmp_path):
    """Empty tables, and rows of nulls with repeated ids and clashing further columns: each stage returns the documents' columns."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "a", 0), (1, None, None, "a", None), (1, "some words here", None, None, 3), (1, "some words here", None, None, 3)], docs.schema)
    for k, df in enumerate((docs.limit(0), nulls)):
        base = str(tmp_path / str(k))
        df.withColumns({c: F.lit("clash") for c in ("node", "size", "keep", "quality_weight", "copies")}).write.parquet(f"{base}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").limit(0 if k == 0 else 1000).write.parquet(f"{base}/{t}.parquet")
        kept = spark.read.parquet(f"{base}/documents.parquet")
        for _, stage in pipeline.STAGES[:-1]:
            kept = stage(spark, kept, base).cache()
            assert kept.columns == docs.columns
        last = pipeline.run(spark, base)
        assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == kept.count() and (kept.count() > 0) == (k == 1)
