"""Near-duplicates of a stated similarity: links against brute force, recall and precision against exact Jaccard similarity."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from tests.llm.test_operators import DOCS, brute_components, docs, empty, rows  # noqa: F401
from textquarry.llm import similar

MASK = 2**64 - 1


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def mixed(h, k):
    if not k:
        return h
    z = (h + k * 0x9E3779B97F4A7C15) & MASK
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
    return z ^ z >> 31


def brute_similar(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    out = [len(hashes)]
    for k in range(4):
        own = [mixed(h, k) for h in hashes]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    return tuple(out)


def near(a, b, similarity):
    """A candidate: all bits within the radius, sizes that can reach the similarity."""
    apart = sum((x ^ y).bit_count() for x, y in zip(a[1:], b[1:]))
    return apart <= similar.radius_of(similarity) and min(a[0], b[0]) >= similarity * max(a[0], b[0])


def test_fingerprint():
    for text in ("", "one", "a b c d e", " ".join(str(i % 700) for i in range(3000)), "Ab cd EF gh ij kl mn"):
        n, words = similar.fingerprint(text.encode())
        want = brute_similar(text)
        # unpacking and packing reverse each other's order of bits
        assert n == want[0] and [int(w) for w in words] == list(want[1:]), text


def test_radius():
    p = math.acos(0.8 * 2 / 1.8) / math.pi
    assert similar.radius_of(0.8) == int(256 * p + 4 * math.sqrt(256 * p * (1 - p))) < similar.radius_of(0.8, 8) == int(48 + 4 * math.sqrt(48 * 13 / 16))


def edited(r, words, share):
    return [f"x{r.randrange(10**9)}" if r.random() < share else w for w in words]


def test_links_join_what_brute_force_joins(spark):
    r = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((16, 20, 80, 300)))]  # small sets have another radius
        texts += [" ".join(edited(r, words, s)) for s in (0, 0.01, 0.02, 0.03, 0.06)] + [" ".join(words[: len(words) * 9 // 10])]
    nodes = sorted({brute_similar(t) for t in texts})
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(i, n[0], *map(signed, n[1:])) for i, n in enumerate(nodes)], "node long, n_shingles long, w0 long, w1 long, w2 long, w3 long")
    want = brute_components(list(range(len(nodes))), lambda a, b: near(nodes[a], nodes[b], 0.8))
    for block in (7, 1 << 15):
        links = [tuple(x) for x in similar.links_between(df, block=block).collect()]
        assert all(near(nodes[a], nodes[b], 0.8) for a, b in links)
        pairs = set(links)
        got = brute_components(list(range(len(nodes))), lambda a, b: (a, b) in pairs or (b, a) in pairs)
        as_sets = lambda c: {frozenset(k for k in c if c[k] == v) for v in c.values()}
        assert as_sets(got) == as_sets(want)


def test_large_group_gives_a_forest():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 4, dtype=np.uint64)
    fp = np.array([base ^ (np.uint64(1) << r.integers(0, 63, 4, dtype=np.uint64)) for _ in range(5000)])
    n = np.full(5000, 90)
    for left, right in ((np.arange(5000), None), (np.arange(2000), np.arange(2000, 5000))):
        x, _ = similar.forest(fp, n, left, right, 0.8)
        assert len(x) == 4999


def test_candidates_hold_what_is_similar():
    r = random.Random(9)
    near_pairs = found = 0
    for _ in range(400):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        a, b = " ".join(words), " ".join(edited(r, words, r.random() * 0.08))
        x, y = shingles(a), shingles(b)
        if len(x & y) / len(x | y) >= 0.8:
            near_pairs, found = near_pairs + 1, found + near(brute_similar(a), brute_similar(b), 0.8)
    assert found == near_pairs > 30


def brute_groups(rows):
    """Lists of rows that exact similarity joins; the text is in the second column."""
    sets = sorted({frozenset(shingles(r[1])) for r in rows}, key=sorted)
    comp = brute_components(list(range(len(sets))), lambda a, b: bool(sets[a] and sets[b]) and jaccard(sets[a], sets[b]) >= 0.8)
    of, out = {s: comp[k] for k, s in enumerate(sets)}, defaultdict(list)
    for r in rows:
        out[of[frozenset(shingles(r[1]))]].append(r)
    return list(out.values())


def test_representatives(spark, docs, rows, empty):  # noqa: F811
    want = Counter(min((r[0] for r in x if r[0] is not None), default=None) for x in brute_groups(rows))
    got = [tuple(r) for r in similar.representatives(docs).collect()]
    assert set(got) <= set(rows) and Counter(r[0] for r in got) == want
    assert similar.representatives(docs).columns == docs.columns and similar.representatives(empty).count() == 0
    nulls = spark.createDataFrame([(None, "same words are here today"), (None, "same words are here today"), (None, None)], "doc_id long, text string")
    assert Counter(map(tuple, similar.representatives(nulls).collect())) == {(None, "same words are here today"): 1, (None, None): 1}


def test_clashing_names_and_many_null_texts(spark):
    made = [(None, None, 1)] * 300 + [(5, None, 2), (6, "", 3), (None, "a b c d e f", 4)] + [(None, "a b c d e f", 5)] * 200
    got = similar.representatives(spark.createDataFrame(made, "doc_id long, text string, node long").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == {(5, None): 1, (None, "a b c d e f"): 1}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_family_below_the_similarity_stays(spark):
    r = random.Random(3)
    common = [f"c{i}" for i in range(154)]
    texts = [" ".join(common + [f"t{k}x{i}" for i in range(50)]) for k in range(400)]
    assert all(0.59 < jaccard(shingles(texts[0]), shingles(t)) < 0.61 for t in texts[1:])
    # pairs around the similarity, short ones too, each far from all others
    pairs = []
    for k in range(300):
        words = [f"p{k}w{i}" for i in range(r.choice((8, 9, 30, 200)))]
        pairs.append((" ".join(words), " ".join(words + [f"e{k}x{i}" for i in range(r.randrange(1, len(words) // 3 + 2))])))
    docs = spark.createDataFrame(list(enumerate(texts + [t for p in pairs for t in p])), "doc_id long, text string")
    far = [k for k, (a, b) in enumerate(pairs) if jaccard(shingles(a), shingles(b)) < 0.8]
    assert 50 < len(far) < 250
    want = {*range(400), *range(400, 1000, 2), *(401 + 2 * k for k in far)}
    assert {x.doc_id for x in similar.representatives(docs).collect()} == want


def test_verification_in_blocks(spark):
    r = random.Random(4)
    texts = []
    for k in range(8):
        words = [f"k{k}w{i}" for i in range(60)]
        texts += [" ".join(edited(r, words, s)) for s in (0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1)]
    texts = sorted(set(texts))
    sets = [shingles(t) for t in texts]
    rows = similar.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).cache()
    of = {x.doc_id: x.node for x in rows.collect()}
    nodes = rows.select("node", "n_shingles", "w0", "w1", "w2", "w3").distinct()
    want = brute_components(list(range(len(texts))), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    as_sets = lambda c: {frozenset(k for k in c if c[k] == v) for v in c.values()}
    for block in ((7, 1 << 21), (4096, 300), similar.VERIFIED):
        links = similar.verified(rows, nodes, nodes.selectExpr("node", "1L AS component"), "text", 5, 0.8, block).collect()
        pairs = {(x.a, x.b) for x in links}
        got = brute_components(list(range(len(texts))), lambda a, b: (of[a], of[b]) in pairs or (of[b], of[a]) in pairs)
        assert as_sets(got) == as_sets(want)


def test_representatives_of_real_documents(spark):
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").distinct().collect()]
    got = Counter(r.doc_id for r in similar.representatives(spark.createDataFrame(real, "doc_id long, text string")).collect())
    assert got == Counter(min(r[0] for r in x) for x in brute_groups(real))


def test_similar_sets_have_a_first_shingle_in_common():
    r, none = np.random.default_rng(6), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    met = 0
    for _ in range(4000):
        pool = r.integers(0, 2**64, int(r.choice((5, 6, 9, 10, 40, 300))), np.uint64)
        gone = int(len(pool) * 0.2 * r.random() + 0.5)
        a, b = (np.unique(x) for x in (pool, pool[gone:]))
        if r.random() < 0.5 and gone > 1:
            a, b = np.unique(pool[gone // 2 :]), np.unique(pool[: len(pool) - gone + gone // 2])
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        known = np.unique(r.choice(pool, len(pool) // 2))
        for common in (none, (known, r.integers(2, 9, len(known)))):
            x, y = (similar.first_shingles(s, 0.8, common) for s in (a, b))
            assert len(np.intersect1d(x, y)) and len(x) <= 0.2 * len(a) + 1
        met += 1
    assert met > 2000
    assert len(similar.first_shingles(np.zeros(0, np.uint64), 0.8, none)) == 0


def with_first(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return similar.stash(similar.fingerprints(docs, first=(0.8, similar.common_shingles(docs))), "t")


def test_unrelated_texts_never_meet(spark):
    """All of one size, so that they were all compared with each other; a line that they share makes no difference."""
    r = random.Random(8)
    line = " ".join(f"line{i}" for i in range(60))
    texts = [" ".join(f"t{k}x{i}" for i in range(140)) + " " + line for k in range(1500)]
    twins = [" ".join(edited(r, t.split(), 0.01)) for t in texts[:20]]
    rows = with_first(spark, texts + twins)
    own = {x.node for x in rows.where("doc_id < 20 or doc_id >= 1500").collect()}
    met = similar.buckets(rows).groupBy("shingle").count().collect()
    assert {x.node for x in similar.buckets(rows).select("node").distinct().collect()} <= own
    assert met and max(x["count"] for x in met) == 2


def test_links_of_buckets_join_all_that_is_similar(spark):
    r = random.Random(11)
    texts = [""]
    for k in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((8, 9, 16, 80, 300)))]
        texts += [" ".join(edited(r, words, s)) for s in (0, 0.01, 0.02, 0.03, 0.06)] + [" ".join(words[: len(words) * 9 // 10])]
    texts = sorted(set(texts))
    rows = with_first(spark, texts + texts[:50])
    of = {x.doc_id: x.node for x in rows.collect()}
    nodes = rows.select("node", "n_shingles", "w0", "w1", "w2", "w3").distinct()
    sets, sims = [shingles(t) for t in texts], [brute_similar(t) for t in texts]
    pairs = {(of[a], of[b]) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8}
    assert len(pairs) > 50
    by_node = {of[k]: s for k, s in enumerate(sims)}
    for block in (2, 1 << 15):
        links = {(x.a, x.b) for x in similar.links_sharing(rows, nodes, block=block).collect()}
        small = lambda x, y: min(x[0], y[0]) <= similar.SMALL[0]
        assert all(small(by_node[a], by_node[b]) or near(by_node[a], by_node[b], 0.8) for a, b in links if a != b)
        ids = sorted(set(of.values()))
        got = brute_components(ids, lambda a, b: (a, b) in links or (b, a) in links)
        assert all(got[a] == got[b] for a, b in pairs)


def cut(columns, names, sizes):
    at = 0
    for n in sizes:
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + n], pa.int64()) for c in columns], names=names)
        at += n


def test_buckets_across_batches():
    r = random.Random(12)
    for _ in range(300):
        rows = sorted((r.randrange(12), r.randrange(5)) for _ in range(r.randrange(40)))
        sizes = []
        while sum(sizes) < len(rows):
            sizes.append(r.randrange(0, 5))
        got = [tuple(x.values()) for b in similar._shared(2)(cut(list(zip(*rows)) or [[], []], ["shingle", "node"], sizes)) for x in b.to_pylist()]
        of = defaultdict(list)
        for s, n in sorted(set(rows)):
            of[s].append(n)
        assert got == [(s, n, k // 2) for s, ns in of.items() if len(ns) > 1 for k, n in enumerate(ns)]


def test_tiles_across_batches(monkeypatch):
    """Listed pairs and large buckets, whatever the cuts between batches and between the pairs listed at once."""
    r = np.random.default_rng(13)
    base = r.integers(0, 2**63, (6, 4), dtype=np.int64)
    names = ["shingle", "high", "low", "side", "node", "n_shingles", "w0", "w1", "w2", "w3"]
    rows = []
    for bucket in range(30):
        for _ in range(int(r.integers(2, 14))):
            rows.append([bucket, 0, 0, 2, len(rows), int(r.choice((7, 90, 100, 200))), *(base[r.integers(6)] ^ (1 << r.integers(0, 62, 4)))])
    near_ = lambda x, y: sum((int(p) ^ int(q)).bit_count() for p, q in zip(x[6:], y[6:])) <= similar.radius_of(0.8, min(x[5], y[5])) and min(x[5], y[5]) >= 0.8 * max(x[5], y[5])
    want = brute_components(list(range(len(rows))), lambda a, b: rows[a][0] == rows[b][0] and near_(rows[a], rows[b]))
    for small in ((256, 1 << 18), (256, 7), (5, 9), (0, 1)):
        monkeypatch.setattr(similar, "SMALL_BUCKET", small)
        for size in (1, 3, 17, 1000):
            links = {(x["a"], x["b"]) for b in similar._meet(0.8)(cut(list(zip(*rows)), names, [size] * (len(rows) // size + 1))) for x in b.to_pylist()}
            assert brute_components(list(range(len(rows))), lambda a, b: (a, b) in links or (b, a) in links) == want
