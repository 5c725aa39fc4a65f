"""Token-ID / binary output: Arrow IPC files of fixed-size-list batches.

A shard is one Arrow file with the columns `tokens`, fixed_size_list<uint16 or uint32>[seq_len] (the narrower one where
the vocabulary fits), and `mask`, fixed_size_list<bool>[seq_len], false for padding. Every sequence has the same length, so batch k, row r and offset o are found by arithmetic from the footer, and a memory-mapped file gives
arrays without a copy. A shard's sequences are full but for the last, which is padded. Beside it lies an index file
(doc_id, start, n_tokens; start counts the shard's tokens).

Writing: documents are dealt by range of doc_id (ties by text hash, so one repeated id can spread), sorted within a
task and encoded as they stream by; a task writes its own shard, under a name of its attempt, and renames it when whole,
so a repeated attempt leaves the same file. A task holds a batch of documents and of sequences. The manifest, a
row per shard, gives the tokens before each shard; shards ascend with doc_id. Files lie in the folder that driver and
executors share, through pyarrow's file systems.

Encoding is the tokenizers library's own, add_special_tokens=False. Where the tokenizer's file says that pre-tokens never
hold white space (`cuts_at_space`), words between ASCII white space never share a token, so each distinct word goes through
the library's whole pipeline once per worker and its ids are kept, at most CACHE words; for any other tokenizer whole texts
go through it.

Null text counts as empty: only the end token. Null ids come first. Equal ids are ordered by text hash and text. An
empty table gives no shard and an empty result. Extra columns are ignored. Ids must be
integers; others raise ValueError.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import before_each
from .common import column, fresh_path, giving_back, hash_words, integer_id, materialize, pieces, slices, text_bytes

SEQ_LEN = 2048
SEQS_PER_BATCH = 64
END_ID = 1
CACHE = 2_000_000
#: Text hashed and encoded at once; a worker takes some 25 times as much for it.
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 16 << 20
TOKENIZER = "word_bpe_49k.json"

#: Steps of a tokenizer's file that keep white space where it is.
_KEEP_SPACE = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}


#: The first byte of any code point from U+0300 on, where combining marks begin.
_COMBINING = re.compile(rb"[\xcc-\xff]")


def _steps(part: dict | None, inner: str) -> list[dict]:
    return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]


def cuts_at_space(spec: dict) -> bool:
    """Whether a tokenizer (its file's JSON) certainly treats words between ASCII white space one by one: the normaliser
    leaves white space white, and the first pre-tokenizer drops it."""
    for step in _steps(spec.get("normalizer"), "normalizers"):
        to_space = step["type"] == "Replace" and step["pattern"].get("Regex") == r"\s+" and step["content"] == " "
        if step["type"] not in _KEEP_SPACE and not to_space:
            return False
    if any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or []):
        return False
    first = next(iter(_steps(spec.get("pre_tokenizer"), "pretokenizers")), None)
    if first is None or spec.get("post_processor") is not None:
        return False
    if first["type"] == "Split":
        # Only what the pattern matches is kept, and no alternative of it can match white space.
        kept = first["behavior"] == "Removed" and first["invert"]
        parts = [r"\[\^\\s[^\]]*\]\+?", r"\[?\\p\{[LN]\}\]?\+?", r"'[a-z]+"]
        return kept and re.fullmatch("|".join([f"(?:(?:{'|'.join(parts)})\\|?)+"]), first["pattern"].get("Regex", "")) is not None
    return first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")


class WordEncoder:
    """ids of texts as little-endian uint32; the same as tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = cuts_at_space(spec)
        # A special token between words parts them for the library, so that one call does for many words.
        marks = [t for t in spec.get("added_tokens") or [] if t["special"] and not t["normalized"]]
        # Where nothing can combine, A-Z may be lowered before the library lowers all: fewer distinct words.
        self.lowers = self.by_word and any(t["type"] == "Lowercase" for t in _steps(spec["normalizer"], "normalizers")) and not any(t["content"] != t["content"].lower() for t in marks)
        self.mark = (marks[0]["content"], marks[0]["id"]) if marks and self.by_word else None
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = cache
        # Known words as sorted arrays, some 20 bytes each: hash, a second hash, and where their ids lie in the pool.
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.offsets, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.pool = np.zeros(0, self.kind)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        texts = b"\n".join(words).decode().split("\n")
        if self.mark is not None and not any(self.mark[0] in t for t in texts):
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join(texts)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark[1]).tolist()
            if len(cuts) == len(texts) - 1:
                data = ids.tobytes()
                return [data[4 * a + 4 : 4 * b] for a, b in zip([-1, *cuts], [*cuts, len(ids)])]
        return self._library(texts)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. Words are told apart by a 64-bit hash within a block of texts, and by a CRC besides from block
        to block."""
        if not self.by_word:
            return [np.frombuffer(x, "<u4") for x in self._library([t.decode() for t in texts])]
        if self.lowers:
            texts = [t if _COMBINING.search(t) else t.lower() for t in texts]
        out, held, size = [], [], 0
        for t in texts:
            if len(t) > 2 * BLOCK_BYTES:
                out += self._block(held)
                out.append(np.concatenate([ids for part in pieces(t, BLOCK_BYTES) for ids in self._block([part])]))
                held, size = [], 0
                continue
            held.append(t)
            size += len(t)
            if size >= BLOCK_BYTES:
                out += self._block(held)
                held, size = [], 0
        return out + self._block(held)

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        joined = b"\n".join(texts)
        hashes, starts, ends = hash_words(joined)
        order = np.argsort(hashes)
        ordered = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.zeros(0, np.int64)
        places = order[first]
        words = [joined[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist())]
        keys = hashes[places]
        checks = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        at = np.minimum(np.searchsorted(self.hashes, keys), max(len(self.hashes) - 1, 0))
        held = self.hashes[at] == keys if len(self.hashes) else np.zeros(len(keys), bool)
        known = held & (self.checks[at] == checks) if len(self.hashes) else held
        fresh = np.flatnonzero(~known)
        values: list[bytes] = []
        for n in range(0, len(fresh), 2048):
            values += self._words([words[i] for i in fresh[n : n + 2048].tolist()])
        new_sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
        pool = np.concatenate((self.pool, np.frombuffer(b"".join(values), "<u4").astype(self.kind)))
        new_offsets = len(self.pool) + np.cumsum(new_sizes, dtype=np.int64) - new_sizes
        sizes, offsets_of = np.empty(len(keys), np.int32), np.empty(len(keys), np.int64)
        sizes[fresh], offsets_of[fresh] = new_sizes, new_offsets
        some = np.flatnonzero(known)
        sizes[some], offsets_of[some] = self.sizes[at[some]], self.offsets[at[some]]
        if len(self.hashes) + len(fresh) <= self.cache:  # once it is full its words stay: they came first, so they are the common ones
            add = fresh[~held[fresh]]
            merged = np.concatenate((self.hashes, keys[add]))
            by_hash = np.argsort(merged, kind="stable")  # two sorted runs, merged
            self.hashes = merged[by_hash]
            for name, more in (("checks", checks[add]), ("offsets", offsets_of[add]), ("sizes", sizes[add])):
                setattr(self, name, np.concatenate((getattr(self, name), more))[by_hash])
            self.pool = pool
        group = np.empty(len(order), np.int32)
        group[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(order))))
        each = sizes[group]
        after = np.cumsum(each, dtype=np.int64)
        offsets = offsets_of[group] - (after - each)
        ids = pool[np.repeat(offsets, each) + np.arange(after[-1] if len(after) else 0)].astype("<u4")
        bounds = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.concatenate(([0], after))[np.searchsorted(starts, bounds[:-1])]
        return np.split(ids, cuts)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder; Spark reuses workers, and so the words of earlier tasks are known."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def shard_schema(seq_len: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


INDEX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Cuts a stream of documents' ids into sequences and writes a shard and its index."""

    def __init__(self, tokens_sink, index_sink, seq_len: int = SEQ_LEN, seqs_per_batch: int = SEQS_PER_BATCH, vocabulary: int = 1 << 32):
        self.seq_len, self.room = seq_len, seq_len * seqs_per_batch
        self.kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
        self.schema = shard_schema(seq_len, self.kind)
        self.tokens = pa.ipc.new_file(tokens_sink, self.schema)
        self.index = pa.ipc.new_file(index_sink, INDEX_SCHEMA)
        self.ids: list[np.ndarray] = []
        self.held, self.total = 0, 0
        self.rows: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.room:
            self._flush(self.held // self.room * self.room)
        if len(self.rows) >= 4096:
            self._flush_index()

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.ids)
        for at in range(0, n, self.room):
            self._batch(ids[at : min(n, at + self.room)])
        self.ids, self.held = [ids[n:]], len(ids) - n

    def _batch(self, ids: np.ndarray) -> None:
        pad = -len(ids) % self.seq_len
        mask = np.arange(len(ids) + pad) < len(ids)
        ids = np.pad(ids, (0, pad)).astype(self.kind.to_pandas_dtype())
        make = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a), self.seq_len)
        self.tokens.write_batch(pa.record_batch([make(ids), make(mask)], schema=self.schema))

    def _flush_index(self) -> None:
        if self.rows:
            self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows)], schema=INDEX_SCHEMA))
            self.rows = []

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        self._flush_index()
        self.tokens.close()
        self.index.close()


class ShardReader:
    """A shard by random access; on a local file system it is memory-mapped and slices are views."""

    def __init__(self, path: str):
        fs, at = _file_system(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self._open = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.file = pa.ipc.open_file(self._open(at))
        self.seq_len = self.file.schema.field("tokens").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self._index = at.removesuffix(".arrow") + ".index.arrow"

    def index(self) -> Iterator[pa.RecordBatch]:
        file = pa.ipc.open_file(self._open(self._index))
        for k in range(file.num_record_batches):
            yield file.get_batch(k)

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, mask) of sequence n."""
        batch = self.file.get_batch(n // self.per_batch)
        at = slice(n % self.per_batch * self.seq_len, (n % self.per_batch + 1) * self.seq_len)
        return batch.column(0).values.to_numpy(zero_copy_only=True)[at], batch.column(1).values.to_numpy(zero_copy_only=False)[at]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n tokens of the shard from `start` on; a view where they lie in one batch."""
        room, parts = self.per_batch * self.seq_len, []
        while n > 0:
            batch, at = divmod(start, room)
            take = min(n, room - at)
            parts.append(self.file.get_batch(batch).column(0).values.to_numpy(zero_copy_only=True)[at : at + take])
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    seq_len: int = SEQ_LEN,
    directory: str | None = None,
) -> DataFrame:
    """Writes docs as shards; gives the manifest (shard, path, n_docs, n_tokens), a row per shard."""
    spark = docs.sparkSession
    out = directory or fresh_path(spark, "tokens")
    size = docs.agg(F.sum(F.octet_length(column(text)))).first()[0] or 0
    shards = int(max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES)))
    tie = F.xxhash64(F.col("t"))
    dealt = (
        docs.select(integer_id(docs, doc_id).alias("id"), column(text).alias("t"))
        .withColumn("tie", tie)
        .repartitionByRange(shards, "id", "tie")
        .sortWithinPartitions("id", "tie", "t")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        name, attempt = f"{out}/shard-{shard:06d}", context.taskAttemptId()
        encoder, writer, n = None, None, 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, "t"):
                if writer is None and part.num_rows:
                    encoder = encoder_of(tokenizer)
                    fs, at = _file_system(name)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    sinks = [fs.open_output_stream(f"{at}.{attempt}{x}") for x in (".arrow", ".index.arrow")]
                    writer = ShardWriter(*sinks, seq_len, vocabulary=max(end_id + 1, encoder.tokenizer.get_vocab_size()))
                texts = [t or b"" for t in text_bytes(part.column("t"))]
                for i, ids in zip(part.column("id").to_pylist(), encoder.encode(texts)):
                    writer.add(i, np.concatenate((ids, end)))
                    n += 1
        if writer is None:
            return
        writer.close()
        for sink, x in zip(sinks, (".arrow", ".index.arrow")):
            sink.close()
            try:
                fs.move(f"{at}.{attempt}{x}", at + x)
            except OSError:  # another attempt has put the same file there
                if fs.get_file_info(at + x).type != pa.fs.FileType.File:
                    raise
                fs.delete_file(f"{at}.{attempt}{x}")
        columns = [[shard], [name + ".arrow"], [n], [writer.total]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "path", "n_docs", "n_tokens"])

    return materialize(dealt.mapInArrow(giving_back(write), "shard long, path string, n_docs long, n_tokens long"), "manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, digest: bool = True) -> DataFrame:
    """The documents of the shards, read back: doc_id, start (tokens before it), n_tokens, ids_crc32 and, without
    `digest`, ids (array of long)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest else ", ids array<long>")
    shards = manifest.count()
    if not shards:
        return spark.createDataFrame([], schema)
    # The tokens before each shard, as a running sum over ranges of shards: the manifest grows with the corpus too.
    based = before_each(manifest.withColumn("every", F.lit(0)), "every", ("shard",), F.col("n_tokens"), "sum", "base")
    listed = based.select("path", F.coalesce("base", F.lit(0)).alias("base")).repartition(shards, "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                shard = ShardReader(path)
                for index in shard.index():
                    starts, sizes = index.column("start").to_pylist(), index.column("n_tokens").to_pylist()
                    ids = [shard.tokens(s, n) for s, n in zip(starts, sizes)]
                    arrays = [
                        index.column("doc_id"),
                        pa.array([base + s for s in starts], pa.int64()),
                        index.column("n_tokens"),
                        pa.array([zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in ids], pa.int64()),
                    ]
                    if not digest:
                        arrays.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ([] if digest else ["ids"]))

    return listed.mapInArrow(giving_back(read), schema)
