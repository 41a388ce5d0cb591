"""Token ids in Arrow's file format: record batches of fixed-size lists, with a mask, that open by memory map.

Documents are laid out in ascending id order, in shards of contiguous ids. Each shard is one file of equal-length
sequences (``ids``, and ``mask``: true where an id is real) and one small file of document offsets. A file is written
under a temporary name and renamed when complete, so a repeated task replaces it by equal bytes.

Null and empty texts encode to the end id alone. Documents without an id come first; rows that repeat an id are written
once for each row, in the order of XXH64 of their texts. An empty table gives no files. Further columns are not written.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import by_shard, commit, filesystem, fresh_path, kept, layout, lean, placed, runs_of, spread

END = 2
LENGTH = 2048
ROWS_PER_SHARD = 4096
#: Sequences in a record batch.
BATCH = 512
#: Words whose ids a worker keeps; it then starts anew.
MAX_WORDS = 500_000
#: Bytes of text that are encoded at once; the encodings of their new words take many times that.
CHUNK = 1 << 20


#: The rules under which a text's ids are those of its words in a row.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def by_words(rules: dict) -> bool:
    """Whether the rules never look across ASCII white space, fold case, and end each word with its own tokens."""
    model, added = rules["model"], [t["content"] for t in rules.get("added_tokens") or []]
    return all(rules.get(k) == v for k, v in BY_WORDS.items()) and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not any(c.isspace() for t in added for c in t)


#: A full stop or comma after an ASCII letter is a token of its own.
TAILS = (b".", b",")
_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def cores_of(words: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words without such a tail, those of ASCII letters alone in lower case, as they have the same ids; and which of TAILS
    each has, from 1, or 0."""
    words = pa.concat_arrays([words])  # no offset
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
    first = int(offsets[0])
    data = np.frombuffer(data, np.uint8, int(offsets[-1]) - first, first) if offsets[-1] > first else np.zeros(0, np.uint8)
    start, end = offsets[:-1] - first, offsets[1:] - first
    size, tails = end - start, np.zeros(len(words), np.int64)
    long = np.flatnonzero(size > 1)
    long = long[_LETTER[data[end[long] - 2]]]
    for k, t in enumerate(TAILS, 1):
        tails[long[data[end[long] - 1] == t[0]]] = k
    stays = np.ones(len(data), bool)
    stays[end[tails > 0] - 1] = False
    others = np.concatenate(([0], np.cumsum(~_LETTER[data] & stays)))
    folded = np.repeat(others[end] == others[start], size) & (data >= 65) & (data <= 90)
    data = (data | (folded.astype(np.uint8) << 5))[stays]
    offsets = np.concatenate(([0], np.cumsum(size - (tails > 0)))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), tails


class WordEncoder:
    """Encodes texts word by word, each distinct word once, where the vocabulary's rules allow it (``by_words``): white space
    is dropped, and no pattern, composition or case rule spans it. The tests hold this against whole texts. With any
    other rules whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.words = by_words(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab(True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}  # what stands before white space that opens a text
        self.at, self.n, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, self.dtype)
        self.learn_cores(list(TAILS))

    def add(self, words: list[bytes], at: np.ndarray, n: np.ndarray) -> None:
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.at, self.n = np.concatenate((self.at, at)), np.concatenate((self.n, n))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words; new ones are learned."""
        which = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(which < 0)
        if len(new):
            learned = [words[k] for k in new]
            self.learn_cores(learned)
            which[new] = np.fromiter(map(self.known.__getitem__, learned), np.int64, len(new))
        return which

    def learn_cores(self, words: list[bytes]) -> None:
        """Words of letters alone are encoded many at once; each ends with a token that ends a word."""
        texts = [w.decode() for w in words]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        rest = [k for k, t in enumerate(texts) if not t.isalpha()]
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([" ".join(texts[k] for k in g) for g in groups], add_special_tokens=False)]
        order, flat, sizes = [], [], []
        for g, found in zip(groups, ids, strict=True):
            found = np.array(found, self.dtype)
            ends = np.flatnonzero(self.ends[found])
            if len(ends) == len(g):
                order += g
                flat.append(found)
                sizes.append(np.diff(ends, prepend=-1))
            else:
                rest += g
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)]
        order += rest
        flat.append(np.fromiter(itertools.chain.from_iterable(ids), self.dtype))
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        n = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.add([words[k] for k in order], len(self.flat) + np.cumsum(n) - n, n)
        self.flat = np.concatenate([self.flat, *flat])

    def encode(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and the number of ids of each text. No nulls."""
        if not self.words:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable((*i, end) for i in ids), self.dtype), np.array([len(i) + 1 for i in ids], np.int64)
        if len(self.known) > MAX_WORDS:
            self.reset()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        cores, tails = cores_of(coded.dictionary.cast(pa.binary()))
        cores = cores.dictionary_encode()
        core = self.look_up(cores.dictionary.to_pylist())[cores.indices.to_numpy()]
        word = coded.indices.to_numpy()
        tail = tails[word]
        n = (self.n[core] + (tails > 0))[word]
        stops = np.concatenate(([0], np.cumsum(n)))
        offsets = split.offsets.to_numpy()
        doc_ids = np.diff(stops[offsets - offsets[0]])
        # source position of each id: where its word begins in flat, plus its place in the word
        source = np.repeat(self.at[core][word] - stops[:-1], n)
        source += np.arange(stops[-1])
        tailed = np.flatnonzero(tail)
        source[stops[1:][tailed] - 1] = self.at[[0, *[self.known[t] for t in TAILS]]][tail[tailed]]
        out = np.full(len(source) + len(texts), end, self.dtype)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(doc_ids + 1) - 1] = False
        out[keep] = self.flat[source]
        return out, doc_ids + 1


def encoder(path: str) -> WordEncoder:
    return kept(("encoder", path), lambda: WordEncoder(path))


class _ShardFile:
    """One shard's two files, written batch by batch."""

    def __init__(self, out: str, shard: int, length: int, dtype):
        self.fs, base = filesystem(out)
        self.final = [f"{base}/{kind}-{shard:07d}.arrow" for kind in ("tokens", "documents")]
        self.temporary = [f"{base}/.{kind}-{shard:07d}-{uuid.uuid4().hex}" for kind in ("tokens", "documents")]
        self.fs.create_dir(base, recursive=True)
        self.length, self.type = length, pa.from_numpy_dtype(dtype)
        schemas = [
            pa.schema([("ids", pa.list_(self.type, length)), ("mask", pa.list_(pa.bool_(), length))]),
            pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]),
        ]
        self.sinks = [self.fs.open_output_stream(t) for t in self.temporary]
        self.writers = [pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, schemas, strict=True)]
        self.pending, self.held, self.tokens, self.docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        start = self.tokens + np.cumsum(n) - n
        self.writers[1].write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(start), pa.array(n)], schema=self.writers_schema(1)))
        self.pending.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        self.docs += len(n)
        if self.held >= self.length * BATCH:
            self.flush(False)

    def writers_schema(self, k: int) -> pa.Schema:
        return pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]) if k else pa.schema([("ids", pa.list_(self.type, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, self.type.to_pandas_dtype())
        step, done = self.length * BATCH, 0
        while len(ids) - done >= step or last and done < len(ids):
            part = ids[done : done + step]
            real = len(part)
            full = np.zeros(-(-real // self.length) * self.length, part.dtype)
            full[:real] = part
            self.writers[0].write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), self.length), pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(full)) < real), self.length)], schema=self.writers_schema(0)))
            done += real
        self.pending, self.held = [ids[done:]], len(ids) - done

    def close(self) -> None:
        self.flush(True)
        for writer, sink, temporary, final in zip(self.writers, self.sinks, self.temporary, self.final, strict=True):
            writer.close()
            sink.close()
            commit(self.fs, temporary, final)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.StringArray]]:
    ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "")
    held = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = held[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(held, before + CHUNK)))
        yield ids.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, doc_id: str = "doc_id", text: str = "text", end: int = END, length: int = LENGTH, rows_per_shard: int = ROWS_PER_SHARD) -> tuple[str, DataFrame]:
    """Encodes ``docs`` and writes the files; returns their folder and the manifest (shard, n_docs, n_tokens, base)."""
    spark = docs.sparkSession
    out = out or fresh_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("_tie", F.xxhash64("text"))
    opens = layout(rows, "doc_id", "_tie", rows_per_shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, open_shard, file = encoder(tokenizer), None, None
        row = lambda: pa.RecordBatch.from_pydict({"shard": pa.array([open_shard], pa.int32()), "n_docs": [file.docs], "n_tokens": [file.tokens]})
        for shard, part in runs_of(batches, "_shard"):
            if shard != open_shard:
                if file:
                    file.close()
                    yield row()
                open_shard, file = shard, _ShardFile(out, shard, length, enc.dtype)
            for ids, texts in _chunks(part):
                file.add(ids, *enc.encode(texts, end))
        if file:
            file.close()
            yield row()

    # Bounded: a row for each shard.
    rows = by_shard(spread(placed(rows, "doc_id", "_tie", opens)), len(opens), "doc_id", "_tie", "text").mapInArrow(lean(run, keeps=True), "shard int, n_docs long, n_tokens long").collect()
    base, listed = 0, []
    for r in sorted(rows):
        listed.append((r["shard"], r["n_docs"], r["n_tokens"], base))
        base += r["n_tokens"]
    manifest = spark.createDataFrame(listed, "shard int, n_docs long, n_tokens long, base long")
    manifest.coalesce(1).write.parquet(f"{out}/_manifest")
    return out, manifest


def open_sequences(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A file of sequences; memory-mapped where the file system is local."""
    fs, path = filesystem(uri)
    return pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))


def read_documents(out: str, shard: int) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Documents of a shard, and the crc32 of their ids as little-endian uint32, from the files."""
    tokens, documents = (open_sequences(f"{out}/{kind}-{shard:07d}.arrow") for kind in ("tokens", "documents"))
    k, lo, view = -1, 0, memoryview(b"")
    for j in range(documents.num_record_batches):
        batch, crcs = documents.get_batch(j), []
        for start, n in zip(batch["start"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True):
            crc, stop = 0, start + n
            while start < stop:
                while start >= lo + len(view) // 4:
                    lo += len(view) // 4
                    k += 1
                    view = memoryview(tokens.get_batch(k)["ids"].values.to_numpy(zero_copy_only=True).astype("<u4").tobytes())
                upto = min(stop, lo + len(view) // 4)
                crc = zlib.crc32(view[4 * (start - lo) : 4 * (upto - lo)], crc)
                start = upto
            crcs.append(crc)
        yield batch, crcs


def read_back(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch["shard"].to_pylist(), batch["base"].to_pylist(), strict=True):
                for docs, crcs in read_documents(out, shard):
                    yield pa.RecordBatch.from_arrays([docs["doc_id"], pc.add(docs["start"], base), docs["n_tokens"], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    return manifest.repartition(min(shards, 4096), "shard").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
