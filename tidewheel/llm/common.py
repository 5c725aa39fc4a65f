"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import column, free_name, shared_path as fresh_path, table  # noqa: F401

#: White space of the word contracts: \x20 and \x09-\x0D, which is also what bytes.split() splits on.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor loses nothing of it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def integer_id(docs: DataFrame, doc_id: str) -> Column:
    """The id column as long; ids of another type than integers are an error, not cast in silence."""
    kind = next(f.dataType for f in docs.schema.fields if f.name.lower() == doc_id.lower())
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{doc_id} is {kind.simpleString()}; this operator takes integer ids")
    return column(doc_id).cast("long")


def fold_of(doc_id: Column, buckets: int) -> Column:
    """crc32 of doc_id as text, modulo buckets; null ids hash as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets


def others(docs: DataFrame, outputs: list[str], keep: list[str] | None = None) -> list[T.StructField]:
    """The fields of docs (or those named in keep) that no output replaces; names are compared without case, as Spark does."""
    gone, kept = {o.lower() for o in outputs}, None if keep is None else {k.lower() for k in keep}
    return [f for f in docs.schema.fields if f.name.lower() not in gone and (kept is None or f.name.lower() in kept)]


def columns_of(fields: list[T.StructField]) -> list[Column]:
    return [column(f.name) for f in fields]


def carried(docs: DataFrame, text: str, fields: list[T.StructField], *more: Column) -> tuple[DataFrame, list[int]]:
    """(text, the fields, each column once, and more, under plain names; the fields' places in that)."""
    names = [text, *[f.name for f in fields if f.name != text]]
    columns = [*map(column, names), *more]  # maps over Arrow take no names with dots
    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), [names.index(f.name) for f in fields]


def text_bytes(texts: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, without decoding them."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.binary())
    elif pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_binary())
    yield from texts.to_pylist()


def slices(batch: pa.RecordBatch, text: str | int = 0, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batch in pieces of about `most` bytes of text (one row at least), so that memory is bounded
    by that and the longest text."""
    texts = batch.column(text)
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts.cast(kind)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Returns memory that is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a map over Arrow batches, which gives back what its task has freed: workers live on between tasks, and what they
    hold counts beside their executor's heap."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix64(h: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finalizer (multiply and xor-shift), elementwise on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_RANDOM = np.random.default_rng(20240131)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STRETCH = 1 << 18


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end) of each word of text, words being what bytes.split() gives. Fixed tables: every worker
    and run gives the same hashes."""
    b = np.frombuffer(text, np.uint8)
    inside = ~_IS_SPACE[b]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    # In stretches of words, so that the eight bytes that each byte takes here stay few.
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(b), _STRETCH)), len(starts)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        lengths = ends[i:j] - starts[i:j]
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
        at = slice(starts[i], ends[j - 1])
        value = _BYTE[b[at][inside[at]]] * _PLACE[place & 255]
        if lengths.max() > 256:
            value *= (place >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1)
        out[i:j] = np.add.reduceat(value, first) + lengths.astype(np.uint64)
    return mix64(out), starts, ends


def hash_texts(texts: list[bytes], block: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, word hashes of each text) for runs of texts of about `block` bytes; a longer text is
    hashed in pieces cut at white space."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= block):
            size += len(texts[stop]) + 1
            stop += 1
        if stop == at + 1 and size > 2 * block:
            yield at, [np.concatenate([hash_words(p)[0] for p in pieces(texts[at], block)])]
        else:
            hashes, starts, _ = hash_words(b"\n".join(texts[at:stop]))
            ends = np.cumsum([len(t) + 1 for t in texts[at:stop]])
            yield at, np.split(hashes, np.searchsorted(starts, ends[:-1]))
        at = stop


def pieces(text: bytes, block: int) -> Iterator[bytes]:
    """A text in pieces of about `block` bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = min(len(text), at + block)
        while end < len(text) and not _IS_SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def discard(df: DataFrame) -> None:
    """Deletes a materialized table whose rows are no longer needed by any other."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
