"""Symbols, bits, suffix arrays, indexes and packing against naive Python and fixed values."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import index, packing, ranks, rows, sequence, suffix_index, suffixes, transform
from textquarry.sources import texts as sources

SMALLER = "aloha what a string this is string is eh"
TEXTS = [SMALLER, "BANANA", "the_fm_index_is_a_great_data_structure", "", "a", "aaaa", "Chodzą jeże 中国 \U0001f600\U0001f600", "b\0a\0", "ab" * 300, None, "".join(random.Random(5).choices("acgt\n", k=900))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2).cache()


def test_bwt_goldens():
    assert suffixes.bwt("BANANA") == "ANNB\0AA" and suffixes.bwt("BANANA\0") == "\0ANNB\0AA"
    assert suffixes.bwt("the_fm_index_is_a_great_data_structure") == "esteamxa_tedu_nrhrd__t__fiugti_aa\0scrte"


def test_suffix_array(docs):
    got = defaultdict(list)
    for r in transform.suffix_array(docs).orderBy("seq_id", "sa_rank").collect():
        got[r.seq_id].append(r.pos)
    assert got == {d: sorted(range(len(t) + 1), key=lambda i: t[i:]) for d, t in enumerate(TEXTS) if t is not None}
    with pytest.raises(ValueError):
        transform.suffix_samples(docs, 0)


def test_statistics(docs):
    runs = lambda t: 1 + sum(a != b for a, b in zip(t, t[1:], strict=False))
    for r in docs.select("doc_id", T.redundancy("text").alias("r"), T.alphabet_size("text").alias("a"), T.input_length("text").alias("n"), T.collapsed_runs("text").alias("c")).collect():
        t = TEXTS[r.doc_id]
        if t is None:
            assert (r.r, r.a, r.n, r.c) == (None,) * 4
            continue
        assert r.r == (pytest.approx(len(t) / runs(t)) if t else None) and r.a == len(set(t) | {"\0"}) and r.n == len(t) + 1
        assert r.c == "".join(c for i, c in enumerate(t) if not i or t[i - 1] != c)
    for r in transform.bwt_redundancy(docs).collect():
        t = TEXTS[r.seq_id]
        b = suffixes.bwt(t, "\U0010ffff")
        assert r.text_redundancy == pytest.approx(len(t) / runs(t)) and r.bwt_redundancy == pytest.approx(len(b) / runs(b))


def test_rank_access_select(spark):
    df = spark.range(-2, 45).select(F.col("id"), F.lit(SMALLER).alias("t"))
    for r in df.select("id", T.symbol_rank("t", F.col("id"), "a").alias("a"), T.symbol_rank("t", F.col("id"), "Z").alias("z"), T.symbol_access("t", F.col("id")).alias("s")).collect():
        assert r.a == SMALLER[: max(0, r.id)].count("a") and r.z == 0 and r.s == (SMALLER[r.id] if 0 <= r.id < len(SMALLER) else None)
    one = df.limit(1)
    assert [one.select(T.symbol_rank("t", k, c).alias("r")).first().r for k, c in ((6, "a"), (99, "a"), (99, "h"), (19, "i"), (-1, "i"))] == [2, 4, 4, 1, 0]
    where = [i for i, c in enumerate(SMALLER) if c == "i"]
    assert [one.select(T.symbol_select("t", "i", k).alias("p")).first().p for k in (1, 2, 4, 9)] == [where[0], where[1], where[3], None]
    assert one.select(T.symbol_rank_range("t", 3, 20, "i").alias("r")).first().r == SMALLER[3:20].count("i")
    assert one.select(T.utf16_position(F.lit("a\U0001f600b"), 2).alias("u")).first().u == 3


def test_symbol_tables(docs):
    got = Counter(tuple(r) for r in sequence.inverse_select(sequence.symbol_table(docs)).collect())
    assert got == Counter((d, i, c, t[:i].count(c)) for d, t in enumerate(TEXTS) if t for i, c in enumerate(t))
    got = Counter((r.seq_id, r.symbol, r.code, r.freq, r.cum) for r in sequence.cumulative_counts(docs).collect())
    want = Counter()
    for d, t in enumerate(TEXTS):
        before = 1
        for k, c in enumerate(dict.fromkeys(t or ""), 1):
            want[d, c, k, t.count(c), before] += 1
            before += t.count(c)
    assert got == want
    assert {r.symbol: r.n for r in sequence.symbol_histogram(docs).collect()} == Counter("".join(t or "" for t in TEXTS))


def test_bits(spark):
    ones = {0, 2, 11, 18, 19, 20, 199, 512}
    bits = spark.createDataFrame([(1, i, i in ones) for i in range(1024)], "seq_id long, pos long, bit boolean")
    for r in sequence.bit_rank(bits).collect():
        assert r.ones == sum(o < r.pos for o in ones) and r.zeros == r.pos - r.ones
    assert {r.i: r.pos for r in sequence.bit_select(bits).collect()} == dict(enumerate(sorted(ones), 1))
    at = spark.createDataFrame([(1, 11), (1, 12), (1, 1024)], "seq_id long, pos long")
    assert {r.pos: r.bit for r in sequence.bit_access(bits, at).collect()} == {11: True, 12: False, 1024: None}
    with pytest.raises(PySparkException, match="Out of range access. Requested 1024"):
        sequence.bit_access(bits, at, strict=True).collect()
    ints = sequence.bits_from_ints(spark.createDataFrame([(1, 0, 5), (1, 1, 1)], "s long, p long, v int"), "s", "p", "v")
    assert {r.pos for r in ints.where("bit").collect()} == {0, 2, 32} and ints.count() == 64
    none = spark.createDataFrame([], bits.schema)
    assert sequence.bit_rank(none).count() == sequence.bit_select(none).count() == 0


@pytest.mark.parametrize("rate", [1, 4, 32, 2000])
def test_index(docs, rate, tmp_path):
    index.save_index(index.build_index(docs, sample_rate=rate), str(tmp_path / "i"))
    ix = index.load_index(docs.sparkSession, str(tmp_path / "i"))
    assert {r.doc_id: r.text for r in index.extract(ix, 0).collect()} == {d: t for d, t in enumerate(TEXTS) if t is not None}
    assert {r.doc_id: r.text for r in index.extract(ix, 5, 37).collect()} == {d: t[5:37] for d, t in enumerate(TEXTS) if t is not None}
    at = lambda t, p: [i for i in range(len(t)) if t.startswith(p, i)]
    patterns = ["a", "is", "ANA", "aa", "\U0001f600", "\0", "abab", "zz", "acg", "string is"]
    assert {(r.doc_id, r.pattern): r.n for r in index.count(ix, patterns).collect()} == {(d, p): len(at(t, p)) for d, t in enumerate(TEXTS) if t for p in patterns if p in t}
    for p in patterns:
        assert Counter(map(tuple, index.locate(ix, p).collect())) == Counter((d, i) for d, t in enumerate(TEXTS) if t for i in at(t, p))
    key = lambda t: lambda i: [list(dict.fromkeys(t)).index(c) for c in t[i:]]
    got = defaultdict(list)
    for r in index.locate(ix.where("doc_id in (0, 1, 2)"), "a", 2, "code").collect():
        got[r.doc_id].append(r.pos)
    assert got == {d: sorted(at(TEXTS[d], "a"), key=key(TEXTS[d]))[:2] for d in (0, 2)}
    assert ix.where("doc_id = 0").select("input_length", "alphabet_length").first() == (len(SMALLER) + 1, len(set(SMALLER)) + 1)
    assert index.describe(ix).first().description == f"Index-sampleRate:{rate}-extract:true" and index.serialized_size(ix).where("bytes <= 0").count() == 0


@pytest.mark.parametrize("rate", [1, 32])
def test_index_boundaries_and_tables(docs, rate, spark, monkeypatch):
    """Records, slices at positions of a table, pattern tables: all from the index, against naive Python."""
    monkeypatch.setattr(index, "LOOK", 3)
    ix = index.build_index(docs, sample_rate=rate).cache()
    asks = [(d, p) for d, t in enumerate(TEXTS) if t is not None for p in sorted({-1, 0, 1, 7, len(t) // 2, len(t) - 1, len(t)})]
    at = spark.createDataFrame(asks + [(999, 0)], "doc_id long, pos long")
    for b in ("a", " "):
        for side in ("both", "left", "right"):
            want = {}
            for d, p in asks:
                t = TEXTS[d]
                if not 0 <= p < len(t):
                    want[d, p] = None
                elif t[p] == b:
                    want[d, p] = ""
                else:
                    left, right = t[: p + 1].rpartition(b)[2], t[p + 1 :].partition(b)[0]
                    want[d, p] = (left if side != "right" else "") + (right if side != "left" else "")
            assert {(r.doc_id, r.pos): r.record for r in index.until_at(ix, at, b, side).collect()} == want
    with pytest.raises(PySparkException, match="Requested position longer than index string"):
        index.until_at(ix, at.where("pos > 0"), "a", strict=True).collect()
    with pytest.raises(PySparkException, match="Boundary does not exist"):
        index.until_at(ix, at.where("doc_id = 0 and pos = 0"), "\u2603", strict=True).collect()
    cut = spark.createDataFrame([(d, p, p + 5) for d, p in asks] + [(0, None, 3), (0, 3, 2)], "doc_id long, start long, stop long")
    for r in index.extract_at(ix, cut).collect():
        t = TEXTS[r.doc_id]
        assert r.text == (t[r.start : r.stop] if r.start is not None and 0 <= r.start <= r.stop <= len(t) else None)
    places = lambda t, p: [i for i in range(len(t)) if t.startswith(p, i)]
    made = [(1, "a"), (2, "ana"), (3, "ana"), (4, ""), (5, None), (6, "nowhere at all"), (7, " ")]
    patterns = spark.createDataFrame(made, "pattern_id int, pattern string")
    want = {(d, k): places(t, p) for d, t in enumerate(TEXTS) if t for k, p in made if p and p in t}
    assert {(r.doc_id, r.pattern_id): r.n for r in index.count_table(ix, patterns).collect()} == {k: len(v) for k, v in want.items()}
    got = index.locate_table(ix, patterns, limit=2, chars=4).collect()
    assert Counter((r.doc_id, r.pattern_id, r.pos, r.extract) for r in got) == Counter((d, k, i, TEXTS[d][i : i + 4]) for (d, k), v in want.items() for i in v[:2])
    assert index.locate_table(ix, patterns).count() == sum(map(len, want.values()))
    assert index.count_table(ix, patterns.limit(0)).count() == 0
    for side in ("both", "right"):
        for r in index.grep(ix, "a", " ", side).collect():
            t = TEXTS[r.doc_id]
            start = r.pos if side == "right" else t.rfind(" ", 0, r.pos) + 1
            assert r.record == t[start:].partition(" ")[0]


def test_ranks(docs, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranks, "STEP", 5)
    monkeypatch.setattr(ranks, "TOGETHER", 3)
    ranks.save_ranks(ranks.build_ranks(docs), str(tmp_path / "r"))
    stored = ranks.load_ranks(spark, str(tmp_path / "r"))
    asks = [(d, p, c) for d, t in enumerate(TEXTS) if t is not None for p in (-3, 0, 1, 4, 5, 6, len(t) // 2, len(t), len(t) + 9) for c in ("a", "zz", "\u2603", (t or "a")[-1])]
    got = ranks.rank_at(stored, spark.createDataFrame(asks, "seq_id long, pos long, symbol string"))
    assert Counter(map(tuple, got.collect())) == Counter((d, p, c, TEXTS[d][: max(0, p)].count(c) if len(c) == 1 else 0) for d, p, c in asks)
    got = ranks.inverse_select_at(stored, spark.createDataFrame([x[:2] for x in asks], "seq_id long, pos long"))
    inside = lambda d, p: 0 <= p < len(TEXTS[d])
    assert Counter(map(tuple, got.collect())) == Counter((d, p, TEXTS[d][p] if inside(d, p) else None, TEXTS[d][:p].count(TEXTS[d][p]) if inside(d, p) else None) for d, p, _ in asks)
    asks = [(d, c, i) for d, t in enumerate(TEXTS) if t is not None for c in ("a", "\u2603") for i in (0, 1, 2, t.count("a"), t.count("a") + 1)]
    for r in ranks.select_at(stored, spark.createDataFrame(asks, "seq_id long, symbol string, i long")).collect():
        found = [k for k, c in enumerate(TEXTS[r.seq_id]) if c == r.symbol]
        assert r.pos == (found[r.i - 1] if 1 <= r.i <= len(found) else None)
    whole = sequence.inverse_select_all(docs).collect()
    assert Counter(map(tuple, whole)) == Counter((d, p, c, t[:p].count(c)) for d, t in enumerate(TEXTS) if t for p, c in enumerate(t))


def test_stored_suffix_array(docs, spark, tmp_path):
    suffix_index.save(suffix_index.build(docs), str(tmp_path / "s"))
    stored = suffix_index.load(spark, str(tmp_path / "s"))
    places = lambda t, p: sorted((i for i in range(len(t)) if t.startswith(p, i)), key=lambda i: t[i:])
    for p in ("a", "ana", "\U0001f600", "\0", "not there"):
        assert {r.doc_id: r.n for r in suffix_index.count(stored, p).collect()} == {d: len(places(t, p)) for d, t in enumerate(TEXTS) if t is not None}
        assert Counter(map(tuple, suffix_index.locate(stored, p, 2).collect())) == Counter((d, i, k) for d, t in enumerate(TEXTS) if t for k, i in enumerate(places(t, p)[:2]))
    with pytest.raises(ValueError):
        suffix_index.count(stored, "")
    stored.drop("format_version").withColumn("format_version", F.lit(7)).write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="Expected version 1 but was 7"):
        suffix_index.load(spark, str(tmp_path / "old"))


def test_stored_suffix_array_is_small(spark, tmp_path):
    """Less than two bytes a symbol are written and no text is shuffled where the scan has parts enough; ties, wide alphabets and long texts."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=900)) for _ in range(80)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    built = suffix_index.build(spark.read.parquet(str(tmp_path / "docs")))
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    suffix_index.save(built, str(tmp_path / "s"))
    assert sum(p.stat().st_size for p in (tmp_path / "s").glob("*.parquet")) < 2 * sum(map(len, texts))
    for t in [*[x for x in TEXTS if x is not None], texts[0], "a" * 70_000, "".join(chr(r.randrange(1, 0xD800)) for _ in range(3000)), "\U0010ffff", "ab\0a\0" * 99]:
        points = suffixes.code_points(t)
        got, n = suffix_index.positions(points, suffix_index.numbered(points)).tolist(), len(t)
        assert got == (list(range(n, -1, -1)) if set(t) == {"a"} else sorted(range(n + 1), key=lambda i: t[i:]))


def test_parts_are_bounded(spark, monkeypatch):
    """However many rows come together, a worker opens some PART bytes of them; answers over several parts and batches stay whole."""
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "t": ["x" * 10_000] * 1000})
    some = list(rows.parts(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
    assert [k for p in some for k in p.column("k").to_pylist()] == [*range(1000), 0] and max(p.num_rows for p in some) <= 110
    monkeypatch.setattr(ranks, "MADE", 3)
    texts = spark.createDataFrame([(d, f"{d} banana" * 40_000 if d < 4 else str(d)) for d in range(40)], "doc_id long, text string").coalesce(1)
    asks = [(d, p, "a") for d in range(41) for p in range(0, 30, 3)]
    got = ranks.rank_at(ranks.build_ranks(texts), spark.createDataFrame(asks, "seq_id long, pos long, symbol string")).collect()
    assert Counter(map(tuple, got)) == Counter((d, p, c, (f"{d} banana" * 9)[:p].count(c) if d < 4 else 0) for d, p, c in asks if d < 40)


def test_index_is_built_where_texts_are_read(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "repeat('so it is. ', 20) AS text").repartition(8).write.parquet(str(tmp_path / "docs"))
    for built in (index.build_index(spark.read.parquet(str(tmp_path / "docs"))), index.build_index(spark.read.parquet(str(tmp_path / "docs")), extraction=False)):
        assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString() and built.where("input_length = 201").count() == 4000
    few = index.build_index(spark.read.parquet(str(tmp_path / "docs")).coalesce(1))
    assert "Exchange" in few._jdf.queryExecution().executedPlan().toString()


def test_index_steps_and_patterns():
    """A slice of a text of middling length is taken from one sort by digits; patterns are searched for side by side."""
    r = random.Random(8)
    for t in ["", "a", "abab", *["".join(r.choices("ab \n\U0001f600", k=n)) for n in (31, 32, 33, 700, 60_000)]]:
        opened = index.Index(dict(zip([c.split()[0] for c in index._SCHEMA.split(", ")], index.build_row(t, 32, True), strict=True)))
        asks = ["a", "ab", "zz", "\U0001f600", "b a", t[:40] or "q", t[-3:] or "q", "a" * 900, "a"]
        got = {k: (low, high) for k, low, high in opened.ranges(index.Patterns(asks))}
        assert got == {k: found for k, p in enumerate(asks) if (found := opened.range(p)) != (0, 0)} and all(high - low == sum(t.startswith(asks[k], i) for i in range(len(t))) for k, (low, high) in got.items())
        assert not list(opened.ranges(index.Patterns([])))
        if len(t) > 700:
            assert opened.extract(300, 301) == t[300] and opened._lf is not None
        assert opened.extract(0, len(t)) == t and opened.extract(len(t) // 3, len(t)) == t[len(t) // 3 :]


@pytest.mark.parametrize("rate", [1, 4, 32, 2000])
def test_positions_are_unfolded(rate, monkeypatch):
    """All positions of a text at once are the suffix array, without a search among the samples; few matches of a long text still step."""
    r = random.Random(9)
    for t in ["", "a", "aaaa", *["".join(r.choices("ab \n", k=n)) for n in (31, 32, 33, 64, 3000)]]:
        opened = index.Index(dict(zip([c.split()[0] for c in index._SCHEMA.split(", ")], index.build_row(t, rate, False), strict=True)))
        opened._prepare(len(t) + 1)
        assert opened._lf is not None and opened._unfolded().tolist() == suffixes.suffix_array(suffixes.first_appearance(suffixes.code_points(t))[0]).tolist()
        found = [i for i in range(len(t)) if t.startswith("ab", i)]
        assert opened.locate("ab") == found
        monkeypatch.setattr(index, "UNFOLDED", -(1 << 40))
        assert opened.locate("ab") == found and opened.locate("ab", 2) == found[:2]
        monkeypatch.setattr(index, "UNFOLDED", 1 << 14)


def test_ranks_of_all_positions(spark):
    """Symbols come from the alphabet's table, whatever their width, over several texts of a batch."""
    texts = ["", "ba\0b", "\U0001f600a\U0001f600\ud7ff", "".join(chr(0x4E00 + k % 700) for k in range(2000)), "xyx"]
    got = sequence.inverse_select_all(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert Counter(map(tuple, got)) == Counter((d, p, c, t[:p].count(c)) for d, t in enumerate(texts) for p, c in enumerate(t))


def test_places_in_suffix_order():
    import random

    import numpy as np

    r = random.Random(5)
    for text in ("a" * 300, "ab" * 200, "".join(r.choice("ab") for _ in range(500)), "x" + "abcdefgh" * 40, "mississippi"):
        codes = np.array([ord(c) for c in text], np.uint32)
        for n in (1, 2, 5, 30, len(text) // 2):
            places = r.sample(range(len(text)), min(n, len(text)))
            assert suffixes.in_order(codes, places) == sorted(places, key=lambda i: text[i:])


def test_transform_of_long_texts(docs):
    naive = lambda t: sorted(range(len(t) + 1), key=lambda i: t[i:])
    want = {d: naive(t) for d, t in enumerate(TEXTS) if t is not None}
    assert {r.seq_id: r.bwt for r in transform.bwt(docs, mark="$").collect()} == {d: "".join("$" if i == 0 else TEXTS[d][i - 1] for i in order) for d, order in want.items()}
    got = Counter((r.seq_id, r.sa_rank, r.pos, r.slot) for r in transform.suffix_samples(docs, 8).collect())
    assert got == Counter((d, k, i, i // 8) for d, order in want.items() for k, i in enumerate(order) if i % 8 == 0)


def test_saved_words(spark, tmp_path):
    words = packing.pack(spark.createDataFrame([(1, k, k * k) for k in range(50)], "seq_id long, pos long, value long"), 13)
    packing.save_words(words, str(tmp_path / "w"))
    assert Counter(map(tuple, packing.load_words(spark, str(tmp_path / "w")).collect())) == Counter(map(tuple, words.collect()))


def test_read_chunks(spark, tmp_path):
    """Files larger than a block: chunks join to the text, and positions are those of the file."""
    from textquarry.sources import texts

    made = {"a.log": "".join(f"line {i} é\U0001f600 {'x' * (i % 50)}\n" for i in range(3000)), "b.log": "only\n", "c.log": "\n\n"}
    for name, text in made.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = texts.read_chunks(spark, str(tmp_path), 40).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({(r.path, r.block) for r in rows}) > 4
    for name, text in made.items():
        mine = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.base_pos)
        assert "".join(r.text for r in mine) == text and all(text[r.base_pos :].startswith(r.text) and r.text.count("\n") <= 40 for r in mine)


def test_index_refusals(docs, tmp_path):
    index.save_index(index.build_index(docs, extraction=False).withColumn("format_version", F.lit(9)), str(tmp_path / "i"))
    with pytest.raises(ValueError, match="Incompatible serial versions! Expected version 2 but was 9."):
        index.load_index(docs.sparkSession, str(tmp_path / "i"))
    with pytest.raises(PySparkException, match="Text recovery not enabled at build time"):
        index.extract(index.build_index(docs, extraction=False), 0).collect()
    with pytest.raises(ValueError):
        index.build_index(docs, sample_rate=0)


def test_min_bits(spark):
    values = [0, 1, 2, 3, 255, 256, 2**62, 2**63 - 1, -1]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(T.min_bits("v").alias("b"), T.floor_log2("v").alias("l")).collect()
    assert [r.b for r in got] == [max(1, v.bit_length()) if v >= 0 else 64 for v in values] and got[0].l is None and got[4].l == 7
    assert T.low_bits(64) == -1 and T.low_bits(0) == 0 and T.low_bits(5) == 31


@pytest.mark.parametrize("width", [1, 13, 31, 63, 64])
def test_packing(spark, width):
    r = random.Random(width)
    rows = [(s, i, r.getrandbits(width) - (2**64 if width == 64 and r.random() < 0 else 0)) for s, n in ((1, 100), (2, 1), (3, 64)) for i in range(n)]
    rows = [(s, i, v - 2**64 if v >= 2**63 else v) for s, i, v in rows]
    ints = spark.createDataFrame(rows, "seq_id long, pos long, value long")
    words = packing.pack(ints, width)
    whole = defaultdict(int)
    for s, i, v in rows:
        whole[s] |= (v & (2**width - 1)) << i * width
    got = {(x.seq_id, x.word_no): x.word % 2**64 for x in words.collect()}
    assert got == {(s, k): v >> 64 * k & (2**64 - 1) for s, v in whole.items() for k in range(-(-width * sum(x[0] == s for x in rows) // 64))}
    back = packing.unpack(words, ints.groupBy("seq_id").agg(F.count("*").alias("n")), width)
    assert Counter((s, p, v % 2**64) for s, p, v in back.collect()) == Counter((s, p, v % 2**width) for s, p, v in rows)
    at = ints.where("pos % 7 = 0").select("seq_id", "pos")
    assert Counter((s, p, v % 2**64) for s, p, v in packing.get_values(words, at, width).collect()) == Counter((s, p, v % 2**width) for s, p, v in rows if p % 7 == 0)
    new = at.withColumn("value", F.lit(5).cast("long"))
    changed = packing.get_values(packing.set_values(words, new, width), ints.select("seq_id", "pos"), width)
    assert Counter((s, p, v % 2**64) for s, p, v in changed.collect()) == Counter((s, p, (5 if p % 7 == 0 else v) % 2**width) for s, p, v in rows)
    with pytest.raises(ValueError):
        packing.pack(ints, 65)


def test_packed_bit_rank(spark):
    r = random.Random(8)
    bits = [r.random() < 0.4 for _ in range(300)]
    words = packing.pack(spark.createDataFrame([(1, i, int(b)) for i, b in enumerate(bits)], "seq_id long, pos long, value long"), 1)
    got = packing.packed_bit_rank(words, spark.range(300).select(F.lit(1).cast("long").alias("seq_id"), F.col("id").alias("pos"))).collect()
    assert len(got) == 300 and all(x.ones == sum(bits[: x.pos]) for x in got)


def test_arrays(spark):
    from textquarry.functions.arrays import count_equal, max_of_array

    df = spark.createDataFrame([([3, 1, 3],), ([],), (None,)], "a array<int>")
    assert [tuple(r) for r in df.select(max_of_array("a"), count_equal("a", 3)).collect()][:2] == [(3, 2), (None, 0)]


def test_variable_packing(spark):
    rows = [(1, 0, 1), (1, 1, 2)] + [(2, i, 3**i % 2**40) for i in range(60)]
    got = {(x.seq_id, x.word_no): x.word % 2**64 for x in packing.pack_variable(spark.createDataFrame(rows, "seq_id long, pos long, value long")).collect()}
    whole, at = defaultdict(int), defaultdict(int)
    for s, _, v in rows:
        whole[s] |= v << at[s]
        at[s] += max(1, v.bit_length())
    assert got[1, 0] == 5 and got == {(s, k): v >> 64 * k & (2**64 - 1) for s, v in whole.items() for k in range(-(-at[s] // 64))}


def test_last_to_first():
    codes, alphabet = suffixes.first_appearance(suffixes.code_points(SMALLER))
    column = suffixes.bwt_codes(codes, suffixes.suffix_array(codes))
    lf, row, out = suffixes.last_to_first(column), 0, []
    while column[row]:
        out.append(chr(alphabet[column[row] - 1]))
        row = lf[row]
    assert "".join(reversed(out)) == SMALLER and np.array_equal(np.sort(lf), np.arange(len(lf)))


def test_sources_and_cli(spark, tmp_path, capsys):
    from textquarry.__main__ import main

    text = "".join(f"line {i} INFO\n" for i in range(50)) + "tail"
    (tmp_path / "a.log").write_text(text)
    docs = sources.read_texts(spark, str(tmp_path / "a.log"))
    assert docs.first().text == text and sources.read_lines(spark, str(tmp_path / "a.log")).count() == 51
    chunks = sources.chunk_text(docs, 7).orderBy("chunk").collect()
    assert "".join(c.text for c in chunks) == text and all(text[c.base_pos :].startswith(c.text) for c in chunks)
    assert main([str(tmp_path / "a.log"), "16"]) == 0
    assert capsys.readouterr().out == f"alphabet size: {len(set(text)) + 1}\nlength: {len(text) + 1}\ncount('INFO'): 50\n"
    with pytest.raises(ValueError, match="Error: Please use parameters:\n<input file> <sample rate>"):
        main(["x"])
