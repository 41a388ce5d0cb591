"""Each operator against a brute-force version, over real rows and the awkward ones."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from textquarry.llm import chat, decontaminate, langid, mixing, order_minhash, quality, simhash, suffix_dedup, token_output, warc
from textquarry.llm.components import components
from textquarry.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, n_words string, keep string, score string"


@pytest.fixture(scope="module")
def rows(spark):
    """Real documents, then nulls, empties, repeats, ties, a long text, and control characters."""
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    long_ = "Long words repeat, " * 4000 + "".join(chr(97 + i * i % 26) for i in range(9000))
    extra = [
        (1000, None, None, None, None), (1001, "", "en", "src1", 0), (1002, "   \n\t ", "en", None, 5), (1003, "one", None, "src2", 3),
        (1004, "two words", "en", "src2", 9), (1005, "two words", "en", "src2", 9), (1005, "two words", "en", "src2", 9), (1006, long_, "en", "src3", len(long_)),
        (1007, long_[50:], "en", "src3", 5), (None, "no id here at all", "en", "src3", 3), (1008, "a\x00b \x85   c d É é <|endoftext|>x İ Σς", "fr", "src4", 3),
        (1009, real[3][1] + " " + real[5][1], "en", "src4", 3), (1010, "ab" * 300, "en", "src4", 600), (1011, real[3][1], None, "", 3), (1012, "!!! ... 123", "de", "src5", 3),
    ]
    return [(*r[:5], 7, 8, "clash", "clash", "clash") for r in real + extra]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tie(text):
    """Rows that repeat an id are in this order."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# -- chat ---------------------------------------------------------------------------------------------------------


def test_chat_digest(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = {
        -1: [("user", said), ("assistant", said)], 1: [("system", ""), ("user", None), ("assistant", "x<|im_end|>\n␛e<|␛p"), ("assistant", "<"), ("assistant", "|")],
        2: [("us\ner<|", "é\U0001f600")], 3: [(None, "a")] * 9, None: [("assistant", "null id")], 5: [("assistant", "y" * 100_000)],
    }
    made = [(c, t, r, x) for c, ts in turns.items() for t, (r, x) in enumerate(ts)]
    got = chat.digest(chat.format_trees(chat.as_tree(spark.createDataFrame(made, "conv_id long, turn long, role string, text string"))))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(c, len(ts), sha("".join(f"{r or ''}\n{x or ''}\n" for r, x in ts)), len(loss := "".join(x or "" for r, x in ts if r == "assistant")), sha(loss)) for c, ts in turns.items()}
    assert {tuple(r)[:5] for r in got.collect()} == want


def test_chat_trees(spark):
    rows = [
        (1, 1, None, 1.0, "user", "q"), (1, 2, 1, 5.0, "assistant", "good"), (1, 3, 1, 1.0, "assistant", "bad"), (1, 4, 3, 2.0, "user", "why"), (1, 5, 2, None, "user", "thanks"),
        (2, 1, 99, 1.0, "user", "lost parent"), (3, 1, 2, 1.0, "user", "cycle"), (3, 2, 1, 1.0, "user", "cycle"), (3, 3, 2, 1.0, "user", "tail"),
    ]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, score double, role string, text string")
    got = {(r.tree, r.branch_rank): [t.text for t in r.t] for r in chat.format_trees(df, best=2).withColumn("t", chat.read_turns(F.col("formatted"))).collect()}
    assert got == {(1, 1): ["q", "good", "thanks"], (1, 2): ["q", "bad", "why"], (2, 1): ["lost parent"]}
    assert chat.format_trees(df.where("tree > 9")).count() == 0


def brute_branches(rows, best):
    """(tree, rank, ids of the path) of the best branches; of rows that repeat an id the one with the least parent."""
    nodes = {}
    for t, i, p, score, *_ in rows:
        new = (p is not None, p or 0, score is not None, score or 0.0)
        nodes[t, i] = min(nodes.get((t, i), new), new)
    parent = {(t, i): v[1] if v[0] and (t, v[1]) in nodes else None for (t, i), v in nodes.items()}
    inner, out, trees = {(t, p) for (t, _), p in parent.items() if p is not None}, {}, defaultdict(list)
    for t, i in nodes:
        path, at = [], i
        while at is not None and at not in path:
            path.append(at)
            at = parent[t, at]
        if at is None and (t, i) not in inner:
            trees[t].append((-sum(nodes[t, k][3] for k in path), i, path[::-1]))
    for t, found in trees.items():
        for rank, (_, _, path) in enumerate(sorted(found)[:best], 1):
            out[t, rank] = path
    return out


def test_chat_trees_against_brute_force(spark):
    """Random trees with long chains, cycles, lost parents, repeated ids, equal scores, null trees and further columns."""
    import random

    r = random.Random(11)
    rows = [(t, i, r.choice([None, 0, i - 1, i - 1, i - 1, r.randrange(40), i]), r.choice([None, 0.0, 1.0, 2.0]), "user", f"{t} {i}", "clash") for t in (None, 1, 2, 3) for i in range(30)]
    rows += [(9, i, i - 1 if i else None, 1.0, "assistant", f"9 {i}", "clash") for i in range(70)]
    rows += [(t, i, p, s, "user", f"{t} {i}", "clash") for t, i, p, s, *_ in r.sample(rows, 20)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, score double, role string, text string, leaf string").repartition(3)
    got = chat.format_trees(df, best=3).withColumn("t", chat.read_turns(F.col("formatted"))).collect()
    assert {(x.tree, x.branch_rank): [int(t.text.split()[1]) for t in x.t] for x in got} == brute_branches(rows, 3)


# -- SimHash ------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_simhash(docs, rows, empty):
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for r, f in zip(rows, fps, strict=True):
        least[comp[f]].append(r[0] if r[0] is not None else float("inf"))
    want = Counter((r[0], f"{f:016x}", min(least[comp[f]])) for r, f in zip(rows, fps, strict=True))
    want = Counter({(a, b, None if c == float("inf") else c): n for (a, b, c), n in want.items()})
    assert bag(simhash.digest(simhash.near_duplicates(docs)), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [(1 << 15, 1 << 20), (3, 7), (1, 1)])
def test_simhash_links(spark, monkeypatch, tile):
    import random

    monkeypatch.setattr(simhash, "TILE", tile)

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(150)]
    near = [b ^ sum(1 << r.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in (1, 2, 3)]
    fps = sorted(set(base + near + [0, 1, 2, 2**63, 2**64 - 1, 2**64 - 2]))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2}
    got = simhash.links_between(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    assert len(got) == len(want) and {frozenset(x) for x in got} == want


def test_long_text_fingerprint(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(3000)).encode()
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    assert simhash.fingerprints_of([b"a b c d", text, b"", b"x"]).tolist() == [brute_fingerprint(t.decode()) for t in (b"a b c d", text, b"", b"x")]


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 380)] + [(5, 5), (None, 3), (1, 0)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.component].add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(201)), list(range(300, 380))]


# -- WARC ---------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    html = "<p>" + "é" * 600 + "</p>"
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(9001, "http://a/ b\r\nX: y", html), (9002, None, html), (9003, "u", html), (9004, "u", None), (9005, "u", ""), (9006, "u", "small"), (9007, "u", "small"), (None, "n", html), (9008, "d", "dup" * 400), (9008, "d", "dup" * 400), (9009, "long", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    a, files = warc.write_archives(df, str(tmp_path / "a"), max_file_bytes=40_000, rows_per_shard=50)
    got = bag(warc.read_archives(spark, a, files), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    last = defaultdict(list)
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    for p, h in raw:
        last[h].append(p)
    want = Counter()
    for p, h in raw:
        ids = [x for x in last[h] if x is not None]
        to = max(ids) if len(h) >= 1000 and len(last[h]) > 1 and ids and (p is None or p < max(ids)) else None
        want[p, len(h), hashlib.sha1(h).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert got == want
    names = sorted(p.name for p in (tmp_path / "a").glob("*.warc.gz"))
    assert names == sorted(r.name for r in files.collect()) and not list((tmp_path / "a").glob(".pages-*"))
    b, _ = warc.write_archives(df.repartition(7), str(tmp_path / "b"), max_file_bytes=40_000, rows_per_shard=50)
    assert [(tmp_path / "a" / n).read_bytes() for n in names] == [(tmp_path / "b" / n).read_bytes() for n in names]
    payloads = Counter()
    for n in names:
        with (tmp_path / "a" / n).open("rb") as f:
            for h, block in warc.records(f):
                assert h["WARC-Type"] == "warcinfo" or h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
                if h["WARC-Type"] == "response":
                    payloads[block.partition(b"\r\n\r\n")[2]] += 1
    assert set(payloads) == {h for _, h in raw}
    c, none = warc.write_archives(df.limit(0), str(tmp_path / "c"))
    assert warc.read_archives(spark, c, none).count() == 0


# -- quality ------------------------------------------------------------------------------------------------------


def brute_kneser_ney(texts, order):
    """p(last | those before) by dictionaries."""
    edges = b"\xff" * (order - 1)
    counts = [Counter(t[i : i + order] for t in (edges + x + b"\xff" for x in texts) for i in range(len(t) - order + 1))]
    for _ in range(order - 1):
        counts.append(Counter(g[1:] for g in counts[-1]))
    counts = counts[::-1]

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        return [0] + [max(0, min(k, k - (k + 1) * y * n[k] / max(1, n[k - 1]))) for k in (1, 2, 3)]

    tables = []
    for c in counts:
        cut, totals, off = discounts(c), Counter(), Counter()
        for g, n in c.items():
            totals[g[:-1]] += n
            off[g[:-1]] += min(n, cut[min(n, 3)])
        tables.append((c, cut, totals, off))
    known = {}

    def p(gram):
        if gram not in known:
            low = p(gram[1:]) if len(gram) > 1 else 1 / 256
            c, cut, totals, off = tables[len(gram) - 1]
            n, context = c[gram], gram[:-1]
            known[gram] = (n - min(n, cut[min(n, 3)]) + off[context] * low) / totals[context] if totals[context] else low
        return known[gram]

    return p


def brute_scores(rows, good, order=5):
    """(row, nll, n) by the model of the good rows that are not held out."""
    import math

    p = brute_kneser_ney([(r[1] or "").encode() for r in rows if r[0] in good], order)
    out = []
    for r in rows:
        t = b"\xff" * (order - 1) + (r[1] or "").encode() + b"\xff"
        grams = [t[i : i + order] for i in range(len(t) - order + 1)]
        out.append((r, sum(-math.log(p(g)) for g in grams), len(grams)))
    return out


@pytest.mark.parametrize(("order", "chunk", "block"), [(5, 32 << 20, 2 << 20), (3, 30, 7), (8, 30, 1 << 20)])
def test_kneser_ney(spark, monkeypatch, order, chunk, block):
    monkeypatch.setattr(quality, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(quality, "BLOCK", block)
    texts = ["the cat sat on the mat", "a cat and the other cat", "", None, "thé", "aaaa aaaa", "the mat", "zéz", "xyz", "aaaa"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, nll string").repartition(2).cache()
    good = {0, 1, 2, 3, 4, 5}
    grams = quality.gram_table(df, quality.trained_rows(df, spark.createDataFrame([(i,) for i in good], "doc_id long")), order=order)
    scored = quality.score(df, quality.costs(grams, quality.train(grams, order)), order=order)
    assert scored.columns == ["doc_id", "text", "nll", "n_scored"]
    want = {r[0]: (nll, n) for r, nll, n in brute_scores(rows, good, order)}
    for r in scored.collect():
        assert (pytest.approx(r.nll, rel=1e-5), r.n_scored) == want[r.doc_id]


def test_documents_must_not_change(spark):
    df = spark.createDataFrame([(1, "one text"), (2, "another")], "doc_id long, text string").coalesce(1)
    grams = quality.gram_table(df, None)
    priced = quality.costs(grams, quality.train(grams))
    assert quality.score(df, priced).count() == 2
    with pytest.raises(Exception, match="changed between two readings"):
        quality.score(df.orderBy(F.desc("doc_id")).coalesce(1), priced).collect()


def test_quality_against_brute_force(spark, docs, rows):
    """Scores, means, limits and decisions of every row, with few and with enough held-out documents of a language."""
    import math

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.good_ids(labels).collect()}
    out = {r.doc_id for r in quality.good_ids(labels).where(quality.held_out()).collect()}
    scored = brute_scores(rows, good - out)
    bounds = {}
    for lang in {r[2] for r in rows} | {"any"}:
        held = [(nll, n) for r, nll, n in scored if r[0] in out and lang in ("any", r[2])]
        if held:
            mean = sum(int(nll * 1024) for nll, _ in held) / 1024 / sum(n for _, n in held)
            z = sorted(int((nll + quality.PRIOR * mean) / (n + quality.PRIOR) / quality.BIN + 0.5) for nll, n in held)
            bounds[lang] = mean, (z[math.ceil(len(z) * quality.QUANTILE) - 1] + 1) * quality.BIN, len(held)
    assert any(b[2] >= 4 for b in bounds.values())
    want = []
    for r, nll, n in scored:
        mean, limit, _ = bounds[r[2]] if r[2] is not None and bounds.get(r[2], (0, 0, 0))[2] >= 4 else bounds["any"]
        z = mean if n <= 1 else (nll + quality.PRIOR * mean) / (n + quality.PRIOR)
        want.append((r[0] is not None, r[0] or 0, n - 1, z, limit, z <= limit))
    _, limits, found = quality.fit(docs, labels)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_scored - 1, r.score, r.limit, r.keep) for r in quality.classify(found, limits, min_trusted=4).collect())
    assert any(not x[-1] for x in want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3:5] == pytest.approx(b[3:5], rel=2e-4) and (a[5] == b[5] or abs(b[3] - b[4]) < 2e-3)


def test_quality(spark, docs, rows, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality(spark, docs, labels)
    assert got.count() == len(rows) and got.where("keep is null or score is null").count() == 0
    assert got.where("n_bytes = 0 and not keep").count() == 0
    assert quality.quality(spark, docs, labels.limit(0)).where("not keep").count() == 0
    assert quality.quality(spark, empty, labels).count() == 0


def test_quality_separates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    r = quality.quality(spark, docs, labels).join(labels, "doc_id").where("toxic = 0").groupBy("quality").agg(F.avg((~F.col("keep")).cast("int")).alias("rejected")).collect()
    share = {x.quality: x.rejected for x in r}
    assert share[0] > 0.85 and share[1] < 0.02


# -- suffix arrays ------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    """doc_id, bytes, removed, spans, sha of each row."""
    raw = [(-1 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for d, t in raw:
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] < (d, i):
                gone[i : i + 100] = b"\x01" * 100
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((None if d == -1 else d, len(t), sum(gone), len(re.findall(b"\x01+", gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("sizes", [None, (3000, 20_000, 500)])
def test_suffix_dedup(docs, rows, empty, monkeypatch, sizes):
    if sizes:  # many segments, shards and merges
        for name, n in zip(("SEGMENT", "SHARD_BYTES", "MERGE_BYTES"), sizes, strict=True):
            monkeypatch.setattr(suffix_dedup, name, n)
    got = suffix_dedup.remove_repeats(docs, with_text=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_merge_in_blocks(monkeypatch):
    """A key with more text than a block, and codes that collide."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 1000)
    bodies = [bytes([97 + k % 5]) * 60 + b"0123456789" * 6 + bytes([110 + k % 3]) * 20 for k in range(60)]
    t = pa.table([[1] * 60, pa.array([0] * 60, pa.int32()), list(range(60)), [0] * 60, [10] * 60, [150] * 60, pa.array(bodies, pa.binary())], names=suffix_dedup._NAMES)
    for codes in (suffix_dedup._codes, lambda buf, at: np.zeros(len(at), np.uint64)):
        monkeypatch.setattr(suffix_dedup, "_codes", codes)
        got = set()
        for b in suffix_dedup._across(iter(t.to_batches(max_chunksize=7))):
            got |= {(d, x) for d, a, z in zip(b["d"].to_pylist(), b["start"].to_pylist(), b["stop"].to_pylist(), strict=True) for x in range(a, z - 99)}
        first, want = {}, set()
        for d, body in enumerate(bodies):
            for i in range(len(body) - 99):
                if first.setdefault(body[i : i + 100], (d, i)) != (d, i):
                    want.add((d, 10 + i))
        assert got == want


# -- decontamination ----------------------------------------------------------------------------------------------


def brute_hits(text, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        q = split(t)
        for i in range(max(1, len(q) - width + 1)) if q else ():
            g = q[i : i + width]
            for j in range(len(w) - len(g) + 1):
                if w[j] == g[0] and w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("nodes", [4_000_000, 400])
def test_decontamination(spark, docs, rows, empty, nodes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12]
    items += [(500, "two words"), (501, None), (502, "..."), (503, "long WORDS repeat"), (10, "no id here"), (503, "é e")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = decontaminate.decontaminate(docs, bench, nodes=nodes)
    want = Counter((r[0], *brute_hits(r[1], items)) for r in rows)
    assert bag(decontaminate.digest(got), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    for r in got.where("size(hit_spans) > 0").collect():
        words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        assert [len(words(r.text[s.start : s.stop])) for s in r.hit_spans] == [x.last - x.first + 1 for x in r.hit_runs]
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("size(hit_runs) > 0").count() == 0


def test_slices_are_bounded(monkeypatch):
    import random

    monkeypatch.setattr(decontaminate, "VOCABULARY", 90)
    r = random.Random(2)
    items = [(str(k), " ".join(f"w{r.randrange(300)}" for _ in range(r.choice((0, 3, 9, 10, 40, 500)))).encode()) for k in range(60)]
    built = [decontaminate.Windows(x, 10) for x in decontaminate.slices(iter(items), 10, 1000)]
    assert len(built) > 20 and all(len(b.numbers) <= 90 and b.automaton.get_stats()["nodes_count"] <= 1001 for b in built if b.numbers)
    for k in range(60):
        text = b"x " + items[k][1] + b" w1"
        hit = {i for b in built for i in b.find(decontaminate.words(text))[1]}
        assert hit == {i for i, t in items if brute_hits(text.decode(), [(i, t.decode())])[4]}


# -- mixing -------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mixing(docs, rows, empty):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += n(r[1])
    want, got = brute_targets(sizes), mixing.mix(docs).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.size) for r in got) == Counter((r[0], n(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r.size for r in got if r.source == s) / 2 + 1e-6
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert Counter((r.doc_id, r.copies) for r in got) == brute_mix(rows, lambda r: 1.0)
    assert mixing.mix(empty).count() == 0


def brute_mix(rows, weight, weights=(5, 2, 1)):
    """(id, copies): each source's rows in the order of their keys, while the middle of a row is within the budget."""
    import math

    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    signed = lambda h: h.to_bytes(8, "little")

    def key(r):
        w = 1.0 if weight(r) is None else weight(r)
        # XXH64 of a row goes on from column to column; nulls leave it as it is
        h = xxhash.xxh64_intdigest((mixing.SEED).to_bytes(4, "little"), 42)
        h = h if r[0] is None else xxhash.xxh64_intdigest(signed(r[0] % 2**64), h)
        h = xxhash.xxh64_intdigest(signed(42 if r[1] is None else xxhash.xxh64_intdigest(r[1].encode(), 42)), h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / w if w > 0 else math.inf

    sizes, out = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += n(r[1])
    for s, target in brute_targets(sizes, weights).items():
        epochs = math.floor(target / sizes[s]) if sizes[s] else 0
        rest, upto = target - epochs * sizes[s], 0
        for r in sorted((r for r in rows if r[3] == s), key=key):
            k = n(r[1])
            out[r[0], epochs + int(rest > 0 and upto + k / 2 <= rest)] += 1
            upto += k
    return out


@pytest.mark.parametrize(("ranges", "most"), [(4096, 100_000), (3, 4)])
def test_mixing_against_key_sort(spark, monkeypatch, ranges, most):
    """Weights null, zero, negative, tiny and huge; equal rows; one source with most rows; keys divided many times."""
    import random

    monkeypatch.setattr(mixing, "RANGES", ranges)
    monkeypatch.setattr(mixing, "SORTED", most)
    r = random.Random(6)
    rows = [(i, "word " * r.randrange(12), None, r.choice(["a", "a", "a", "b", "c", None, ""]), r.choice([None, 0.0, -1.0, 1e-9, 0.5, 1.0, 1e5, 1e300])) for i in range(700)]
    rows += [(5000, "same words here", None, "a", 1.0)] * 200 + [(None, None, None, "b", 1.0)] * 20 + [(None, "no id", None, "d", 0.0)] * 30
    df = spark.createDataFrame([(*x[:2], x[3], x[4]) for x in rows], "doc_id long, text string, source string, q double").repartition(3)
    got = mixing.mix(df, quality="q").collect()
    size = Counter((x.doc_id, x.copies) for x in got)
    want = brute_mix(rows, lambda x: x[4])
    # of empty texts at the very border either may be taken
    empty = {x[0] for x in rows if not (x[1] or "").strip()}
    assert {k: n for k, n in size.items() if k[0] not in empty} == {k: n for k, n in want.items() if k[0] not in empty}
    assert max(x.copies for x in got) <= 3 and len(got) == len(rows)


def test_quality_weights(spark):
    docs = spark.createDataFrame([(1, "x", "clash"), (2, "x", "clash"), (3, "x", "clash"), (4, "x", "clash"), (None, "x", "clash"), (1, "y", "clash")], "doc_id long, text string, quality_weight string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (1, 1, None), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.with_quality(docs, labels)
    assert Counter((r.doc_id, r.quality_weight) for r in got.collect()) == {(1, mixing.GOOD): 2, (2, mixing.BAD): 1, (3, mixing.BAD): 1, (4, mixing.UNKNOWN): 1, (None, mixing.UNKNOWN): 1}


def test_mixing_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("q"))
    r = mixing.mix(df, quality="q", weights=(1, 1), share=0.5).where("source = 'a'").groupBy("q").agg(F.avg("copies").alias("c")).collect()
    share = {x.q: x.c for x in r}
    assert share[4.0] > 1.8 * share[1.0] > 0


# -- tokens -------------------------------------------------------------------------------------------------------


def test_tokens(spark, docs, rows, empty, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in order]
    start, want = 0, Counter()
    for r, i in zip(order, ids, strict=True):
        want[r[0], start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())] += 1
        start += len(i)
    out, manifest = token_output.write_tokens(docs, tokenizer_path(), str(tmp_path / "t"), length=64, rows_per_shard=40)
    assert bag(token_output.read_back(spark, out, manifest), "doc_id", "start", "n_tokens", "ids_crc32") == want
    flat = []
    for f in sorted((tmp_path / "t").glob("tokens-*.arrow")):
        r = token_output.open_sequences(str(f))
        for k in range(r.num_record_batches):
            b = r.get_batch(k)
            assert b["ids"].type.list_size == b["mask"].type.list_size == 64
            flat += b["ids"].flatten().filter(b["mask"].flatten()).to_pylist()
    assert flat == [x for i in ids for x in i]
    out, manifest = token_output.write_tokens(empty, tokenizer_path(), str(tmp_path / "e"))
    assert token_output.read_back(spark, out, manifest).count() == 0


def test_word_encoder_matches_whole_texts(monkeypatch):
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    monkeypatch.setattr(token_output, "MAX_WORDS", 50)
    enc = token_output.WordEncoder(tokenizer_path())
    piece = st.one_of(st.text(max_size=8), st.sampled_from([" ", "\n", "\x0b", "\x85", " ", " ", "\x1c", "'s", "'", "<|endoftext|>", "é", "́", "Σ", "ΑΣ", "İ", "가", "1", "!!"]))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(piece, max_size=12).map("".join), min_size=1, max_size=4))
    def check(texts):
        texts = [x.encode("utf-8", "ignore").decode() for x in texts]
        ids, n = enc.encode(pa.array(texts, pa.string()), 2)
        whole = [enc.tokenizer.encode(x, add_special_tokens=False).ids + [2] for x in texts]
        assert ids.tolist() == [i for w in whole for i in w] and n.tolist() == [len(w) for w in whole]

    check()


def test_words_that_share_ids_are_learned_once():
    import pyarrow as pa

    enc = token_output.WordEncoder(tokenizer_path())
    texts = ["Word word. WORD, word", "", "word,, Word.. wörd. Wörd x. X, . , 3. 4,"]
    ids, n = enc.encode(pa.array(texts, pa.string()), 2)
    whole = [enc.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [i for w in whole for i in w] and n.tolist() == [len(w) for w in whole]
    assert set(enc.known) == {w.encode() for w in ("", ".", ",", "word", "word,,", "Word..", "wörd", "Wörd", "x", "3.", "4,")}
    words, tails = token_output.cores_of(pa.array([b"", b"skipped", b"Ab.", b".", b"a1,", b"\xc3\xa9.", b"A1b,"], pa.binary())[1:])
    assert words.to_pylist() == [b"skipped", b"ab", b".", b"a1,", b"\xc3\xa9.", b"A1b"] and tails.tolist() == [0, 1, 0, 0, 0, 2]
    assert token_output.cores_of(pa.array([], pa.binary()))[0].to_pylist() == []


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["Hello World, how are  you?\nFine.", "", "  x\t\n É ΑΣ 3.14", "a" * 5000, "it's <|endoftext|> there"]
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        enc, whole = token_output.WordEncoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
        want = [whole.encode(t, add_special_tokens=False).ids + [7] for t in texts]
        ids, n = enc.encode(pa.array(texts, pa.string()), 7)
        assert enc.words == words and n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# -- fingerprints -------------------------------------------------------------------------------------------------


def brute_signature(text):
    """Order MinHash in plain integers: for each slot, all elements ranked, the least two in text order."""
    mask, k = 2**64 - 1, order_minhash.K

    def mix(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31

    def kmer(points):
        if len(points) < k:
            return mix(int.from_bytes(hashlib.blake2b(b"".join(p.to_bytes(4, "little") for p in points), digest_size=8).digest(), "little"))
        m = [mix(p) for p in points]
        two = [m[i] * 0xC2B2AE3D27D4EB4F + m[i + 1] & mask for i in range(5)]
        four = [two[0] * 0x165667B19E3779F9 + two[2] & mask]
        return mix(four[0] * 0xD6E8FEB86659FD93 + two[4] & mask)

    points = [ord(c) for c in text]
    if not points:
        return "0" * 256
    seen, elements = Counter(), []
    for h in [kmer(points[i : i + k]) for i in range(max(1, len(points) - k + 1))]:
        elements.append(mix(h * 0x9FB21C651E98DF25 + seen[h] & mask))
        seen[h] += 1
    out = ""
    for slot in range(1, order_minhash.SLOTS + 1):
        seed = slot * 0x9E3779B97F4A7C15 & mask
        factor = mix(seed) | 1
        least = sorted(sorted(range(len(elements)), key=lambda i: (elements[i] * factor & mask, i))[:2])
        picked = elements[least[0]] if len(elements) == 1 else mix(elements[least[0]]) * 3 + elements[least[1]] & mask
        out += f"{max(1, mix(picked ^ seed) >> 48):04x}"
    return out


def test_order_minhash_selects_from_all_elements(monkeypatch):
    import random

    r = random.Random(8)
    texts = ["", "a", "abc", "a" * 40, "é\U0001f600" * 9] + ["".join(r.choice("abcd é") for _ in range(n)) for n in (5, 6, 7, 8, 200, 262, 1029, 3000)]
    for block in (4096, 7):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        assert [order_minhash.fingerprint(t) for t in texts] == [brute_signature(t) for t in texts]


@pytest.mark.parametrize("size", [4096, 9])
def test_order_minhash(docs, rows, empty, monkeypatch, size):
    monkeypatch.setattr(order_minhash, "ROWS_PER_SHARD", size)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1] or "")))
    texts, want = [r[1] or "" for r in order], Counter()
    for k, t in enumerate(texts):
        other = texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + other[:cut]
        sig = [order_minhash.signature(order_minhash.kmer_hashes(order_minhash.code_points(x))) for x in (t, edited, other)]
        want[order[k][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), *map(order_minhash.to_text, sig[:2]), float((sig[0] == sig[1]).mean()), float((sig[0] == sig[2]).mean())] += 1
    got = order_minhash.compare_with_next(docs)
    assert bag(got, *got.columns) == want
    assert order_minhash.compare_with_next(empty).count() == 0
    one = order_minhash.compare_with_next(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_order_matters():
    import random

    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=14)) for _ in range(60)]
    like = lambda a, b: order_minhash.likeness(*(order_minhash.signature(order_minhash.kmer_hashes(order_minhash.code_points(x))) for x in (a, b)))
    text, turned = " ".join(words), " ".join(words[30:] + words[:30])
    assert like(text, text) == 1.0 and like(text, turned) < 0.75 < 0.8 < like(text, " ".join(words[:58]))


# -- language -----------------------------------------------------------------------------------------------------


def test_language(spark, docs, rows, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    learned = langid.learn(real.where(~held))
    assert all(len(x) <= langid.DICTIONARY_BYTES + 4096 for _, x in learned)
    got = langid.identify(real, learned).withColumn("held_out", held)
    assert langid.accuracy(got) > 0.97
    few = {r.doc_id: r for r in langid.identify(docs, learned).where("doc_id >= 1000").collect()}
    assert all(few[k].lang_pred == "und" and few[k].score == "0.0" or few[k].score == 0.0 for k in (1000, 1001, 1002, 1012))
    assert few[1004].lang_pred in dict(learned) and 0 <= few[1004].score <= 1
    assert langid.identify(docs, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, learned).count() == 0


def test_language_by_plain_compression(spark, docs, rows):
    """Every prediction and score against zstandard called block by block; ties go to the language learned first."""
    import zstandard

    learned = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    learned = [*learned, ("tie", learned[0][1])]
    packs = [zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for _, raw in learned]
    plain = {r.doc_id: r.t for r in docs.select("doc_id", langid.letters("text").alias("t")).collect()}
    got = langid.identify(docs, learned).collect()
    assert len(got) == len(rows)
    for r in got:
        t = plain[r.doc_id].encode()
        if not t.strip():
            assert (r.lang_pred, float(r.score), r.rejected) == ("und", 0.0, True)
            continue
        n = [sum(len(p.compress(t[i : i + 1024])) for i in range(0, len(t), 1024)) for p in packs]
        assert r.lang_pred == learned[n.index(min(n))][0] and r.rejected == (sorted(n)[1] - min(n) < 0.01 * min(n))
        assert float(r.score) == pytest.approx(1 / sum(2.0 ** max(-1000, min(n) - x) for x in n))


def test_languages_of_long_or_equal_documents(spark):
    long_, same = "langer text hier " * 4000, "the very same words"
    made = [(i, long_ + str(i), "xx") for i in range(6)] + [(None, same, "yy")] * 3000 + [(100 + i, f"petit texte {i}", "zz") for i in range(50)] + [(None, None, "yy"), (None, "", "none"), (7, "no language", None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    learned = dict(langid.learn(df))
    assert set(learned) == {"xx", "yy", "zz"} and all(0 < len(x) <= langid.DICTIONARY_BYTES + 4096 for x in learned.values())
    assert {(r.lang, r.lang_pred) for r in langid.identify(df, list(learned.items())).where("lang <> 'none' and text is not null").collect()} == {("xx", "xx"), ("yy", "yy"), ("zz", "zz")}
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.learn(df, max_languages=2)
