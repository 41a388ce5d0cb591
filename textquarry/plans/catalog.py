"""Registered queries, each over its whole table, and the SQL that DuckDB runs for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import index, packing, ranks, search, sequence, suffix_index, transform
from textquarry.sources import tables
from textquarry.sources.tables import fresh_path

#: A pattern whose matches may overlap, and one whose matches cannot.
OVERLAPPING, LITERAL = "anan", "tion"
PACKED_WIDTH = 21
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


#: Stored forms by application, table and kind: written once, then read by every query over them.
_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf: str, kind: str, build: Callable[[], DataFrame], save, load) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _STORED or _STORED[key] not in tables._written:  # not yet, or cleaned up
        path = fresh_path(spark, kind)
        save(build(), path)
        _STORED[key] = path
    return load(spark, _STORED[key])


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "index", lambda: index.build_index(_docs(spark, sf)), index.save_index, index.load_index)


def _suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "suffixes", lambda: suffix_index.build(_docs(spark, sf)), suffix_index.save, suffix_index.load)


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "ranks", lambda: ranks.build_ranks(_docs(spark, sf)), ranks.save_ranks, ranks.load_ranks)


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")


def _clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as a bit sequence: whether the event was a click."""
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "event_type")
    return rows.select(F.col("user_id").alias("seq_id"), pos.cast("long").alias("pos"), (F.col("event_type") == "click").alias("bit"))


def _supplied(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's part keys as an integer sequence."""
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return rows.select(F.col("l_suppkey").alias("seq_id"), pos.cast("long").alias("pos"), F.col("l_partkey").alias("value"))


#: SQL: a row for each match of the literal, with its number and 0-based position. Matches cannot overlap, so the pieces
#: between them add up to the positions.
_MATCHES = f"""
WITH s AS (SELECT doc_id, text, string_split(text, '{LITERAL}') AS a FROM documents WHERE contains(text, '{LITERAL}')),
e AS (SELECT doc_id, text, unnest(a) AS piece, generate_subscripts(a, 1) AS k, len(a) AS n FROM s),
m AS (SELECT doc_id, text, k, n, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) + (k - 1) * {len(LITERAL)} AS BIGINT) AS pos FROM e),
hit AS (SELECT doc_id, text, pos, CAST(k - 1 AS BIGINT) AS match_no FROM m WHERE k < n)"""
#: SQL: the suffixes of each part's name; the empty one is first.
_SUFFIXES = """
WITH x AS (SELECT p_partkey AS seq_id, p_name AS t, unnest(range(0, length(p_name) + 1)) AS pos FROM part),
sa AS (SELECT seq_id, t, pos, row_number() OVER (PARTITION BY seq_id ORDER BY substr(t, pos + 1)) - 1 AS sa_rank FROM x)"""
#: SQL: the last column of the sorted rotations; the end mark sorts first.
_BWT = _SUFFIXES + ", b AS (SELECT seq_id, t, sa_rank, CASE WHEN pos = 0 THEN chr(1) ELSE substr(t, pos, 1) END AS c FROM sa)"
_SYMBOLS = "SELECT doc_id AS seq_id, unnest(string_split(text, '')) AS symbol, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents WHERE length(text) > 0"
_PART_SYMBOLS = "SELECT p_partkey AS seq_id, unnest(string_split(p_name, '')) AS symbol, CAST(generate_subscripts(string_split(p_name, ''), 1) - 1 AS BIGINT) AS pos FROM part"
_CLICKS = "SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type = 'click' AS bit FROM events"
_SUPPLIED = "SELECT l_suppkey AS seq_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos, l_partkey AS value FROM lineitem"
#: SQL: words from (seq_id, v, f, w), f the first bit; HUGEINT holds a value shifted within two words.
_TO_WORDS = """
h AS (SELECT seq_id, f // 64 AS word_no, (v::HUGEINT) * (1::HUGEINT << CAST(f % 64 AS INT)) AS x, f % 64 + w > 64 AS two FROM placed),
q AS (SELECT seq_id, word_no, x % 18446744073709551616 AS u FROM h UNION ALL SELECT seq_id, word_no + 1, x // 18446744073709551616 FROM h WHERE two),
z AS (SELECT seq_id, word_no, bit_or(u) AS u FROM q GROUP BY seq_id, word_no)
SELECT seq_id, CAST(word_no AS BIGINT) AS word_no, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS word FROM z"""


# -- search -------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, CAST(len(list_filter(a[2:len(a) - 1], lambda x: x = '')) AS BIGINT) AS n
FROM (SELECT doc_id, string_split(text, 'an') AS a FROM documents WHERE contains(text, '{OVERLAPPING}'))""")  # an empty piece lies between two neighbouring matches of the half
def count_overlapping(spark, sf):
    docs = _docs(spark, sf)
    return docs.where(F.col("text").contains(OVERLAPPING)).select("doc_id", T.count_overlapping("text", OVERLAPPING).alias("n"))


@query(f"SELECT doc_id, CAST(len(string_split(text, '{LITERAL}')) - 1 AS BIGINT) AS n FROM documents")
def count_sliced_pattern(spark, sf):
    return _docs(spark, sf).select("doc_id", T.count_sliced_pattern("text", f"x{LITERAL}y", 1, len(LITERAL)).alias("n"))


@query(_MATCHES + " SELECT doc_id, pos, match_no FROM hit")
def locate_all(spark, sf):
    return search.locate_all(_docs(spark, sf), LITERAL)


@query(_MATCHES + " SELECT doc_id, pos FROM hit WHERE match_no < 2")
def locate_limit(spark, sf):
    return search.locate_all(_docs(spark, sf), LITERAL, limit=2).select("doc_id", "pos")


#: SQL: a text over codes in order of first appearance; no code is a surrogate.
_CODED = "array_to_string(list_transform(string_split(text, ''), lambda c: chr(CAST(CASE WHEN instr(text, c) < 55000 THEN 64 + instr(text, c) ELSE 3000 + instr(text, c) END AS INT))), '')"


@query(f"""{_MATCHES}, c AS (SELECT doc_id, {_CODED} AS code FROM documents WHERE contains(text, '{LITERAL}')),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY substr(code, pos + 1)) - 1 AS k FROM hit JOIN c USING (doc_id))
SELECT doc_id, pos, CAST(k AS BIGINT) AS match_no FROM r WHERE k < 2""")
def locate_topk(spark, sf):
    return search.locate_all(_docs(spark, sf), LITERAL, limit=2, order="code")


@query(f"SELECT doc_id, CAST(len(string_split(text, '{LITERAL}')) - 1 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def sa_count(spark, sf):
    return suffix_index.count(_suffixes(spark, sf), LITERAL)


_BY_SUFFIX = _MATCHES + ", r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY substr(text, pos + 1)) - 1 AS k FROM hit)"


@query(_BY_SUFFIX + " SELECT doc_id, pos, CAST(k AS BIGINT) AS match_no FROM r WHERE k < 2")
def sa_locate_topk(spark, sf):
    return suffix_index.locate(_suffixes(spark, sf), LITERAL, limit=2)


@query(_BY_SUFFIX + " SELECT doc_id, pos, CAST(k AS BIGINT) AS match_no FROM r")
def locate_suffix_order(spark, sf):
    return search.locate_all(_docs(spark, sf), LITERAL, order="suffix")


@query("SELECT doc_id, CAST(len(string_split(text, 'é')) - 1 AS BIGINT) AS n FROM documents")
def utf8_pattern(spark, sf):
    return _docs(spark, sf).select("doc_id", T.count_overlapping("text", T.utf8_pattern(b"\xc3\xa9", strict=True)).alias("n"))


@query("""SELECT doc_id, item_id AS pattern_id, CAST(len(string_split(d.text, b.text)) - 1 AS BIGINT) AS n
FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def multi_pattern_count(spark, sf):
    patterns = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    return search.multi_pattern_count(_docs(spark, sf), patterns)


# -- extraction ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN length(text) >= 164 THEN substr(text, 101, 64) END AS extract FROM documents")
def extract_range(spark, sf):
    return _docs(spark, sf).select("doc_id", T.extract_range("text", 100, 164).alias("extract"))


_PIECES = "SELECT doc_id, text, string_split(substr(text, 1, 300), chr(10)) AS l, string_split(substr(text, 302), chr(10)) AS r, substr(text, 301, 1) AS c FROM documents"


@query(f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN NULL WHEN c = chr(10) THEN '' ELSE l[-1] || c || r[1] END AS record FROM ({_PIECES})")
def extract_until_boundary(spark, sf):
    return _docs(spark, sf).select("doc_id", T.extract_until_boundary("text", 300).alias("record"))


@query(f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN NULL WHEN c = chr(10) THEN '' ELSE l[-1] || c END AS record FROM ({_PIECES})")
def extract_boundary_left(spark, sf):
    return _docs(spark, sf).select("doc_id", T.extract_boundary_left("text", 300).alias("record"))


@query(f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN NULL WHEN c = chr(10) THEN '' ELSE r[1] END AS record FROM ({_PIECES})")
def extract_boundary_right(spark, sf):
    return _docs(spark, sf).select("doc_id", T.extract_boundary_right("text", 300).alias("record"))


@query(_MATCHES + " SELECT doc_id, pos, substr(text, pos + 1, 64) AS extract FROM hit WHERE match_no < 10")
def locate_and_extract(spark, sf):
    return search.locate_and_extract(_docs(spark, sf), LITERAL, 64, limit=10)


@query(_MATCHES + " SELECT doc_id, pos, string_split(substr(text, 1, pos), chr(10))[-1] || string_split(substr(text, pos + 1), chr(10))[1] AS record FROM hit")
def grep_records(spark, sf):
    return search.grep_records(_docs(spark, sf), LITERAL)


@query("SELECT event_id AS doc_id, CAST(instr(props, '\"k\"') - 1 AS BIGINT) AS pos, string_split(substr(props, instr(props, '\"k\"')), '}')[1] AS fragment FROM events WHERE contains(props, '\"k\"')")
def extract_key_value(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props")
    return search.extract_key_value(rows, '"k"', "}", doc_id="event_id", text="props")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def roundtrip_text(spark, sf):
    return index.extract(_index(spark, sf), 0)


# -- index --------------------------------------------------------------------------------------------------------


_ALPHABET = "CASE WHEN text = '' THEN 1 ELSE CAST(len(list_distinct(string_split(text, ''))) + 1 AS BIGINT) END"


@query(f"""SELECT doc_id, 2 AS format_version, 32 AS sample_rate, CAST(length(text) + 1 AS BIGINT) AS input_length,
{_ALPHABET} AS alphabet_length, CAST(length(text) // 32 + 1 AS BIGINT) AS n_samples FROM documents WHERE text IS NOT NULL""")
def index_meta(spark, sf):
    built = index.build_index(_docs(spark, sf))
    return built.select("doc_id", "format_version", "sample_rate", "input_length", "alphabet_length", (F.octet_length("sampled_rows") / 4).cast("long").alias("n_samples"))


@query(f"SELECT doc_id, CAST(len(string_split(text, '{LITERAL}')) - 1 AS BIGINT) AS n FROM documents WHERE contains(text, '{LITERAL}')")
def saved_index_count(spark, sf):
    return index.count(_index(spark, sf), [LITERAL]).select("doc_id", "n")


@query(_MATCHES + " SELECT doc_id, pos FROM hit")
def saved_index_locate(spark, sf):
    return index.locate(_index(spark, sf), LITERAL)


@query("SELECT doc_id, CAST(100 AS BIGINT) AS start, CAST(164 AS BIGINT) AS stop, CASE WHEN length(text) >= 164 THEN substr(text, 101, 64) END AS text FROM documents WHERE text IS NOT NULL")
def index_extract_range(spark, sf):
    at = _docs(spark, sf).select("doc_id", F.lit(100).cast("long").alias("start"), F.lit(164).cast("long").alias("stop"))
    return index.extract_at(_index(spark, sf), at)


def _until(spark, sf, side):
    at = _docs(spark, sf).select("doc_id", F.lit(300).cast("long").alias("pos"))
    return index.until_at(_index(spark, sf), at, "\n", side).select("doc_id", "record")


@query(f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN NULL WHEN c = chr(10) THEN '' ELSE l[-1] || c || r[1] END AS record FROM ({_PIECES}) WHERE text IS NOT NULL")
def index_extract_until_boundary(spark, sf):
    return _until(spark, sf, "both")


@query(f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN NULL WHEN c = chr(10) THEN '' ELSE l[-1] || c END AS record FROM ({_PIECES}) WHERE text IS NOT NULL")
def index_extract_boundary_left(spark, sf):
    return _until(spark, sf, "left")


@query(f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN NULL WHEN c = chr(10) THEN '' ELSE r[1] END AS record FROM ({_PIECES}) WHERE text IS NOT NULL")
def index_extract_boundary_right(spark, sf):
    return _until(spark, sf, "right")


@query(_MATCHES + " SELECT doc_id, pos, string_split(substr(text, 1, pos), chr(10))[-1] || string_split(substr(text, pos + 1), chr(10))[1] AS record FROM hit")
def index_grep_records(spark, sf):
    return index.grep(_index(spark, sf), LITERAL)


def _items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))


@query("SELECT doc_id, item_id AS pattern_id, CAST(len(string_split(d.text, b.text)) - 1 AS BIGINT) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def index_pattern_table_count(spark, sf):
    return index.count_table(_index(spark, sf), _items(spark, sf))


@query("SELECT doc_id, item_id AS pattern_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS pos, substr(d.text, instr(d.text, b.text), 64) AS extract FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def index_pattern_table_extract(spark, sf):
    return index.locate_table(_index(spark, sf), _items(spark, sf), limit=1, chars=64)


@query(f"SELECT doc_id, CAST(len(string_split(text, '{LITERAL}')) - 1 AS BIGINT) AS n FROM documents WHERE contains(text, '{LITERAL}')")
def index_count(spark, sf):
    return index.count(index.build_index(_docs(spark, sf), extraction=False), [LITERAL]).select("doc_id", "n")


@query(_MATCHES + " SELECT doc_id, pos FROM hit")
def index_locate(spark, sf):
    return index.locate(index.build_index(_docs(spark, sf)), LITERAL)


@query(f"""WITH s AS ({_SYMBOLS}), g AS (SELECT seq_id, symbol, min(pos) AS first, count(*) AS freq FROM s GROUP BY seq_id, symbol)
SELECT seq_id, symbol, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY first) AS INT) AS code, freq FROM g""")
def alphabet_codes(spark, sf):
    return sequence.alphabet_codes(_docs(spark, sf))


@query(f"""WITH s AS ({_SYMBOLS}), g AS (SELECT seq_id, symbol, min(pos) AS first, count(*) AS freq FROM s GROUP BY seq_id, symbol)
SELECT seq_id, symbol, CAST(1 + sum(freq) OVER (PARTITION BY seq_id ORDER BY first) - freq AS BIGINT) AS cum FROM g""")
def cumulative_counts(spark, sf):
    return sequence.cumulative_counts(_docs(spark, sf)).select("seq_id", "symbol", "cum")


@query(_SUFFIXES + " SELECT seq_id, CAST(sa_rank AS BIGINT) AS sa_rank, pos FROM sa")
def suffix_array(spark, sf):
    return transform.suffix_array(_parts(spark, sf), "p_partkey", "p_name")


@query(_SUFFIXES + " SELECT seq_id, CAST(sa_rank AS BIGINT) AS sa_rank, pos FROM sa WHERE pos % 4 = 0")
def sampled_suffixes(spark, sf):
    return transform.suffix_samples(_parts(spark, sf), 4, "p_partkey", "p_name").select("seq_id", "sa_rank", "pos")


@query(_SUFFIXES + " SELECT seq_id, CAST(pos // 4 AS BIGINT) AS slot, CAST(sa_rank AS BIGINT) AS sa_rank FROM sa WHERE pos % 4 = 0")
def sampled_positions(spark, sf):
    return transform.suffix_samples(_parts(spark, sf), 4, "p_partkey", "p_name").select("seq_id", "slot", "sa_rank")


@query(_BWT + " SELECT seq_id, replace(string_agg(c, '' ORDER BY sa_rank), chr(1), '$') AS bwt FROM b GROUP BY seq_id")
def bwt(spark, sf):
    return transform.bwt(_parts(spark, sf), "p_partkey", "p_name", mark="$")


@query(_BWT + """, n AS (SELECT seq_id, t, c, sa_rank, lag(c) OVER (PARTITION BY seq_id ORDER BY sa_rank) AS p FROM b),
k AS (SELECT seq_id, t, count(*) / sum(CASE WHEN p = c THEN 0 ELSE 1 END) AS after FROM n GROUP BY seq_id, t)
SELECT seq_id, length(t) / (1 + len(list_filter(range(2, length(t) + 1), lambda i: substr(t, i, 1) <> substr(t, i - 1, 1)))) AS text_redundancy, after AS bwt_redundancy FROM k""")
def bwt_redundancy(spark, sf):
    return transform.bwt_redundancy(_parts(spark, sf), "p_partkey", "p_name")


@query(_BWT + " SELECT seq_id, CAST(sa_rank AS BIGINT) AS sa_rank, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY c, sa_rank) - 1 AS BIGINT) AS lf FROM b")
def lf_mapping(spark, sf):
    return transform.lf_mapping(_parts(spark, sf), "p_partkey", "p_name")


# -- symbol and bit sequences -------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), 'a', '')) AS BIGINT) AS rank FROM documents")
def symbol_rank(spark, sf):
    return _docs(spark, sf).select("doc_id", T.symbol_rank("text", 500, "a").alias("rank"))


@query("SELECT doc_id, CAST(len(string_split(substr(text, 101, 400), 'a')) - 1 AS BIGINT) AS rank FROM documents")
def symbol_rank_range(spark, sf):
    return _docs(spark, sf).select("doc_id", T.symbol_rank_range("text", 100, 500, "a").alias("rank"))


@query("SELECT doc_id, nullif(substr(text, 101, 1), '') AS symbol FROM documents")
def symbol_access(spark, sf):
    return _docs(spark, sf).select("doc_id", T.symbol_access("text", 100).alias("symbol"))


@query("SELECT doc_id, CASE WHEN len(a) > 3 THEN CAST(length(a[1]) + length(a[2]) + length(a[3]) + 2 AS BIGINT) END AS pos FROM (SELECT doc_id, string_split(text, 'a') AS a FROM documents)")
def symbol_select(spark, sf):
    return _docs(spark, sf).select("doc_id", T.symbol_select("text", "a", 3).alias("pos"))


@query("SELECT doc_id AS seq_id, CAST(500 AS BIGINT) AS pos, 'a' AS symbol, CAST(length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), 'a', '')) AS BIGINT) AS rank FROM documents WHERE text IS NOT NULL")
def saved_symbol_rank(spark, sf):
    at = _docs(spark, sf).select(F.col("doc_id").alias("seq_id"), F.lit(500).cast("long").alias("pos"), F.lit("a").alias("symbol"))
    return ranks.rank_at(_ranks(spark, sf), at)


@query("""SELECT doc_id AS seq_id, CAST(100 AS BIGINT) AS pos, nullif(substr(text, 101, 1), '') AS symbol,
CASE WHEN length(text) > 100 THEN CAST(100 - length(replace(substr(text, 1, 100), substr(text, 101, 1), '')) AS BIGINT) END AS rank FROM documents WHERE text IS NOT NULL""")
def saved_inverse_select(spark, sf):
    at = _docs(spark, sf).select(F.col("doc_id").alias("seq_id"), F.lit(100).cast("long").alias("pos"))
    return ranks.inverse_select_at(_ranks(spark, sf), at)


@query(f"WITH s AS ({_SYMBOLS}), r AS (SELECT seq_id, symbol, pos, row_number() OVER (PARTITION BY seq_id, symbol ORDER BY pos) - 1 AS rank FROM s) SELECT seq_id, CAST(pos AS BIGINT) AS pos, symbol, CAST(rank AS BIGINT) AS rank FROM r")
def inverse_select_documents(spark, sf):
    return sequence.inverse_select_all(_docs(spark, sf))


@query(f"WITH s AS ({_PART_SYMBOLS}) SELECT seq_id, pos, symbol, CAST(row_number() OVER (PARTITION BY seq_id, symbol ORDER BY pos) - 1 AS BIGINT) AS rank FROM s")
def inverse_select(spark, sf):
    return sequence.inverse_select(sequence.symbol_table(_parts(spark, sf), "p_partkey", "p_name"))


@query("SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS symbol FROM documents WHERE length(text) > 0) GROUP BY symbol")
def symbol_histogram(spark, sf):
    return sequence.symbol_histogram(_docs(spark, sf))


@query("""WITH s AS (SELECT s_nationkey AS seq_id, s_suppkey AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS p FROM supplier)
SELECT seq_id, CAST(p * 32 + j AS BIGINT) AS pos, (v >> j) & 1 = 1 AS bit FROM s, (SELECT CAST(unnest(range(0, 32)) AS INT) AS j)""")
def bits_from_ints(spark, sf):
    from pyspark.sql import Window as W

    rows = spark.read.parquet(f"{sf}/supplier.parquet").select("s_nationkey", "s_suppkey").withColumn("p", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    return sequence.bits_from_ints(rows, "s_nationkey", "p", "s_suppkey")


@query(f"WITH b AS ({_CLICKS}), a AS (SELECT DISTINCT user_id AS seq_id, unnest([0, 10, 100000]) AS pos FROM events) SELECT a.seq_id, CAST(a.pos AS BIGINT) AS pos, bit FROM a LEFT JOIN b ON a.seq_id = b.seq_id AND a.pos = b.pos")
def bit_access(spark, sf):
    at = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("seq_id")).distinct().select("seq_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 10, 100000)])).alias("pos"))
    return sequence.bit_access(_clicks(spark, sf), at)


@query(f"""WITH b AS ({_CLICKS}), r AS (SELECT seq_id, pos, CAST(coalesce(sum(CAST(bit AS INT)) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ones FROM b)
SELECT seq_id, CAST(pos AS BIGINT) AS pos, ones, CAST(pos - ones AS BIGINT) AS zeros FROM r""")
def bit_rank(spark, sf):
    return sequence.bit_rank(_clicks(spark, sf)).select("seq_id", "pos", "ones", "zeros")


@query(f"WITH b AS ({_CLICKS}) SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS BIGINT) AS i, CAST(pos AS BIGINT) AS pos FROM b WHERE bit")
def bit_select(spark, sf):
    return sequence.bit_select(_clicks(spark, sf))


# -- statistics ---------------------------------------------------------------------------------------------------


@query(f"""WITH s AS ({_SYMBOLS}), n AS (SELECT seq_id, symbol, lag(symbol) OVER (PARTITION BY seq_id ORDER BY pos) AS p FROM s),
r AS (SELECT seq_id, count(*) / sum(CASE WHEN p = symbol THEN 0 ELSE 1 END) AS redundancy FROM n GROUP BY seq_id)
SELECT doc_id, redundancy FROM documents LEFT JOIN r ON doc_id = seq_id""")
def redundancy(spark, sf):
    return _docs(spark, sf).select("doc_id", T.redundancy("text").alias("redundancy"))


@query(f"SELECT doc_id, {_ALPHABET} AS alphabet_size FROM documents")
def alphabet_size(spark, sf):
    return _docs(spark, sf).select("doc_id", T.alphabet_size("text").alias("alphabet_size"))


@query(r"""SELECT doc_id, CAST(length(substr(text, 1, 300)) + len(regexp_extract_all(substr(text, 1, 300), '[\x{10000}-\x{10FFFF}]')) AS BIGINT) AS units FROM documents""")
def utf16_position(spark, sf):
    return _docs(spark, sf).select("doc_id", T.utf16_position("text", 300).alias("units"))


@query("SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS input_length FROM documents")
def input_length(spark, sf):
    return _docs(spark, sf).select("doc_id", T.input_length("text").alias("input_length"))


# -- packing ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_partkey = 0 THEN 1 ELSE floor(log2(l_partkey)) + 1 END AS INT) AS min_bits FROM lineitem")
def min_bits(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", T.min_bits("l_partkey").alias("min_bits"))


@query(f"WITH s AS ({_SUPPLIED}), placed AS (SELECT seq_id, value AS v, pos * {PACKED_WIDTH} AS f, {PACKED_WIDTH} AS w FROM s), {_TO_WORDS}")
def pack_int_vector(spark, sf):
    return packing.pack(_supplied(spark, sf), PACKED_WIDTH)


@query(f"""WITH s AS ({_SUPPLIED}), g AS (SELECT seq_id, pos, value AS v, CASE WHEN value = 0 THEN 1 ELSE CAST(floor(log2(value)) AS BIGINT) + 1 END AS w FROM s),
placed AS (SELECT seq_id, v, CAST(sum(w) OVER (PARTITION BY seq_id ORDER BY pos) - w AS BIGINT) AS f, w FROM g), {_TO_WORDS}""")
def pack_variable_width(spark, sf):
    return packing.pack_variable(_supplied(spark, sf))


@query(f"SELECT seq_id, CAST(pos AS BIGINT) AS pos, value FROM ({_SUPPLIED})")
def unpack_int_vector(spark, sf):
    ints = _supplied(spark, sf)
    return packing.unpack(packing.pack(ints, PACKED_WIDTH), ints.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")), PACKED_WIDTH)


@query(f"SELECT l_suppkey AS seq_id, CAST((count(*) * {PACKED_WIDTH} + 63) // 64 AS BIGINT) AS n_words, CAST((count(*) * {PACKED_WIDTH} + 63) // 64 * 8 AS BIGINT) AS size_in_bytes FROM lineitem GROUP BY l_suppkey")
def packed_size(spark, sf):
    return packing.packed_size(packing.pack(_supplied(spark, sf), PACKED_WIDTH))


@query(f"SELECT seq_id, CAST(pos AS BIGINT) AS pos, value FROM ({_SUPPLIED})")
def unpack_saved_vector(spark, sf):
    ints, path = _supplied(spark, sf), fresh_path(spark, "words")
    packing.save_words(packing.pack(ints, PACKED_WIDTH), path)
    return packing.unpack(packing.load_words(spark, path), ints.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")), PACKED_WIDTH)


@query(f"SELECT seq_id, CAST(pos AS BIGINT) AS pos, value FROM ({_SUPPLIED}) WHERE pos % 7 = 3")
def get_packed_values(spark, sf):
    ints = _supplied(spark, sf)
    return packing.get_values(packing.pack(ints, PACKED_WIDTH), ints.where("pos % 7 = 3").select("seq_id", "pos"), PACKED_WIDTH)


@query(f"WITH s AS ({_SUPPLIED}), placed AS (SELECT seq_id, CASE WHEN pos % 5 = 2 THEN pos + 1 ELSE value END AS v, pos * {PACKED_WIDTH} AS f, {PACKED_WIDTH} AS w FROM s), {_TO_WORDS}")
def set_packed_values(spark, sf):
    ints = _supplied(spark, sf)
    return packing.set_values(packing.pack(ints, PACKED_WIDTH), ints.where("pos % 5 = 2").select("seq_id", "pos", (F.col("pos") + 1).alias("value")), PACKED_WIDTH)


@query(f"""WITH b AS ({_CLICKS}), r AS (SELECT seq_id, pos, CAST(coalesce(sum(CAST(bit AS INT)) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ones FROM b)
SELECT seq_id, CAST(pos AS BIGINT) AS pos, ones FROM r WHERE pos % 10 = 0""")
def packed_bit_rank(spark, sf):
    bits = _clicks(spark, sf)
    words = packing.pack(bits.select("seq_id", "pos", F.col("bit").cast("long").alias("value")), 1)
    return packing.packed_bit_rank(words, bits.where("pos % 10 = 0").select("seq_id", "pos"))


# -- whole documents, beyond SQL: the tests hold these operators against brute force ------------------------------


@query()
def bwt_documents(spark, sf):
    return transform.bwt(_docs(spark, sf), mark="$")


@query()
def bwt_redundancy_documents(spark, sf):
    return transform.bwt_redundancy(_docs(spark, sf))


@query()
def sampled_suffixes_documents(spark, sf):
    return transform.suffix_samples(_docs(spark, sf), 32)
