r"""Benchmark decontamination: a generalised suffix automaton of the normalised test items.

Texts and items are lower-cased (A-Z) and cut in words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. The automaton holds every
contiguous word sequence of the items. A document's words stream through it; after each word its state has the longest
suffix of the stream that occurs in an item, and that match's length. Where the length reaches WINDOW, the last WINDOW
words are an occurring window; items of fewer words count as a whole, and are found among the state's suffixes. Words in
any occurring window are hit. A word that no item has resets the automaton, so only runs of item words, at least as long
as the shortest window, are walked; all other words cost one dictionary lookup.

The operator then removes the hit spans of at least `min_span` words from the text, and every whole item of fewer words,
however short; and drops documents of which more than `max_coverage` of the words are hit.

Items are dealt in shards of at most SHARD_WORDS words (one item at least) and each shard has an automaton of at most
twice as many states, built once per worker. A benchmark of at most `pass_words` words is one pass: one batched map,
without a shuffle. A larger one is read in several passes over the texts, each with its own broadcast, which is dropped
before the next; a pass gives the spans and items of the texts that have any, once per distinct text (by a 128-bit hash),
and a last map unites them with the rows. Both ways give the same result. Repeated windows in a document cost nothing more.

Null and empty texts have no words and are kept. Repeated items are one item each, by id; items with a null id are ignored.
An empty benchmark hits nothing; an empty table gives an empty result. Extra columns stay; one named like the output, in
whatever case, is replaced by it.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, column, free_name, giving_back, materialize, others, slices, text_bytes

WINDOW = 10
SHARD_WORDS = 1 << 20
PASS_WORDS = 4 << 20
MIN_SPAN = 10
MAX_COVERAGE = 0.6
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class SuffixAutomaton:
    """A generalised suffix automaton over word numbers, with the items of each window. Items of fewer than
    `min_span` words are also found as a whole."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, min_span: int = MIN_SPAN):
        self.window = window
        self.limit = max(window, min_span)
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[tuple[str, list[int]]] = []
        for name, words in items:
            if words:
                self.items.append((name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        for _, words in self.items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(w) for _, w in self.items)])
        self._mark()

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        state = self._add(self.length[last] + 1, {}, 0)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = state
            last = self.link[last]
        if last >= 0:
            target = self.next[last][w]
            self.link[state] = target if self.length[target] == self.length[last] + 1 else self._split(last, w, target)
        return state

    def _add(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, last: int, w: int, target: int) -> int:
        clone = self._add(self.length[last] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while last >= 0 and self.next[last].get(w) == target:
            self.next[last][w] = clone
            last = self.link[last]
        return clone

    def _mark(self) -> None:
        """at[s]: for a state whose longest string has a window's length or more, the state of its last `window` words;
        owners of such states; short[s]: (length, item) of the short items among the state's suffixes, longest last."""
        window, n = self.window, len(self.next)
        self.at = [-1] * n
        self.owners: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.items):
            state, length = 0, 0
            for w in words:
                state, length = self._step(state, length, w)
                if length >= window:
                    self.owners.setdefault(self._window_state(state), set()).add(k)
            if len(words) < self.limit:
                whole.setdefault(state, []).append((len(words), k))
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            up = self.short[self.link[s]] if s else ()
            self.short[s] = up + tuple(whole[s]) if s in whole else up

    def _window_state(self, state: int) -> int:
        found = self.at[state]
        if found < 0:
            found = state
            while self.length[self.link[found]] >= self.window:
                found = self.link[found]
            self.at[state] = found
        return found

    def _step(self, state: int, length: int, w: int) -> tuple[int, int]:
        edges = self.next
        while state and w not in edges[state]:
            state = self.link[state]
            length = self.length[state]
        state = edges[state].get(w, -1)
        return (state, length + 1) if state >= 0 else (0, 0)

    def scan(self, words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """(hit words, words of whole short items, numbers of the items with occurring windows) of a text, given its
        words' numbers."""
        hit, short, found = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64), set()
        inside = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(inside))
        for a, b in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= self.shortest]:
            state, length = 0, 0
            for pos in range(a, b):
                state, length = self._step(state, length, int(ids[pos]))
                if length >= self.window:
                    hit[pos + 1 - self.window] += 1
                    hit[pos + 1] -= 1
                    found |= self.owners.get(self._window_state(state), set())
                for size, k in self.short[state]:
                    if size <= length:
                        short[pos + 1 - size] += 1
                        short[pos + 1] -= 1
                        found.add(k)
        whole = np.cumsum(short[:-1]) > 0
        return (np.cumsum(hit[:-1]) > 0) | whole, whole, found

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words], np.int64)


def automata(rows: list[tuple[str, bytes | None]], window: int = WINDOW, shard_words: int = SHARD_WORDS, min_span: int = MIN_SPAN) -> list[SuffixAutomaton]:
    out, held, size = [], [], 0
    for name, text in rows:
        words = words_of(text or b"")
        if held and size + len(words) > shard_words:
            out.append(SuffixAutomaton(held, window, min_span))
            held, size = [], 0
        held.append((name, words))
        size += len(words)
    return [*out, SuffixAutomaton(held, window, min_span)] if held else out


Hits = tuple[list[bytes], np.ndarray, np.ndarray, set[str]]


def hits_of(text: bytes, parts: list[SuffixAutomaton]) -> Hits:
    """(words, hit, words of whole short items, ids of the items with occurring windows) of a text."""
    words = words_of(text)
    hit, whole, items = np.zeros(len(words), bool), np.zeros(len(words), bool), set()
    for automaton in parts:
        if len(words) >= automaton.shortest:
            ids = automaton.numbers(words)
            if (ids >= 0).any():
                more, short, found = automaton.scan(words, ids)
                hit |= more
                whole |= short
                items.update(automaton.items[k][0] for k in found)
    return words, hit, whole, items


def _spans(marks: np.ndarray) -> list[list[int]]:
    return np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))).reshape(-1, 2).tolist()


_built: dict[str, list[SuffixAutomaton]] = {}


def built(shared, window: int, min_span: int) -> list[SuffixAutomaton]:
    """The automata of a broadcast pass, kept by the worker until it meets another pass."""
    name, rows = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = automata(rows, window, min_span=min_span)
    return _built[name]


def remove_spans(text: str, words: list[bytes], hit: np.ndarray, whole: np.ndarray, min_span: int = MIN_SPAN) -> str:
    """text without its hit spans of at least min_span words and the words of whole short items (and the gap up to the
    next word)."""
    if not hit.any():
        return text
    gone, edges = whole.copy(), np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2)
    for a, b in edges:
        gone[a:b] |= b - a >= min_span
    raw = text.encode()
    clean = raw.translate(_WORD)
    starts, at = [], 0
    for w in words:
        at = clean.index(w, at)
        starts.append(at)
        at += len(w)
    starts.append(len(raw))
    kept, at = [], 0
    for a, b in np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2):
        kept.append(raw[at : starts[a]])
        at = starts[b]
    return b"".join([*kept, raw[at:]]).decode()


def benchmark_passes(benchmark: DataFrame, item_id: str, text: str, words: int = PASS_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The items in passes of at most `words` words together (one item at least), streamed to the driver."""
    held, size = [], 0
    for r in benchmark.select(column(item_id).cast("string").alias("i"), column(text).alias("t")).where("i is not null").orderBy("i", "t").toLocalIterator():
        t = (r["t"] or "").encode()
        n = len(words_of(t))
        if held and size + n > words:
            yield held
            held, size = [], 0
        held.append((r["i"], t))
        size += n
    yield held


_KIND = "n_words long, n_hit long, items array<string>, clean string"
_FOUND = "hit array<array<int>>, whole array<array<int>>, items array<string>"


def _report(texts: list[bytes | None], found: list[Hits], min_span: int, with_clean: bool) -> pa.Array:
    rows = [
        {
            "n_words": len(words),
            "n_hit": int(hit.sum()),
            "items": sorted(items),
            "clean": None if t is None or not with_clean else t.decode() if not items else remove_spans(t.decode(), words, hit, whole, min_span),
        }
        for t, (words, hit, whole, items) in zip(texts, found)
    ]
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("clean", pa.string())]))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_span: int = MIN_SPAN,
    out: str = "contamination",
    keep: list[str] | None = None,
    with_clean: bool = True,
    pass_words: int = PASS_WORDS,
) -> DataFrame:
    """docs (or its columns `keep`) with a struct column `out`: n_words, n_hit, items (sorted ids) and clean (the text
    without its hit spans and whole short items; null without with_clean)."""
    spark = docs.sparkSession
    passes = benchmark_passes(benchmark, item_id, item_text, pass_words)
    first, second = next(passes), next(passes, None)
    share = lambda rows: spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
    fields = others(docs, [out], keep)
    schema = T.StructType([*fields, T.StructField(out, T.StructType.fromDDL(_KIND))])
    if second is None:
        shared = share(first)
        frame, places = carried(docs, text, fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    texts = list(text_bytes(part.column(0)))
                    parts = built(shared, window, min_span)
                    struct = _report(texts, [hits_of(t or b"", parts) for t in texts], min_span, with_clean)
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + [struct], names=schema.fieldNames())

        return frame.mapInArrow(giving_back(run), schema)

    # Several passes: what each finds, by text.
    key = lambda t: [F.xxhash64(t), F.xxhash64(F.lit("second"), t)]
    texts_only = docs.select(column(text).alias("t"), *[c.alias(n) for c, n in zip(key(column(text)), "ab")]).where("t is not null")
    tables = []
    for rows in itertools.chain([first, second], passes):
        shared = share(rows)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    parts = built(shared, window, min_span)
                    found = [hits_of(t, parts) for t in text_bytes(part.column(0))]
                    some = [i for i, f in enumerate(found) if f[3]]
                    columns = [pa.array([x(found[i]) for i in some], k) for x, k in (
                        (lambda f: _spans(f[1]), pa.list_(pa.list_(pa.int32()))), (lambda f: _spans(f[2]), pa.list_(pa.list_(pa.int32()))), (lambda f: sorted(f[3]), pa.list_(pa.string())),
                    )]
                    yield pa.RecordBatch.from_arrays([part.column(i).take(pa.array(some, pa.int64())) for i in (1, 2)] + columns, names=["a", "b", "hit", "whole", "items"])

        found = texts_only.mapInArrow(giving_back(find), f"a long, b long, {_FOUND}").groupBy("a", "b").agg(*[F.any_value(c).alias(c) for c in ("hit", "whole", "items")])
        tables.append(materialize(found, "pass"))
        shared.unpersist(blocking=True)
    united = reduce(DataFrame.unionByName, tables).groupBy("a", "b").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hit", "whole", "items")])
    names = [free_name(n, [*docs.columns, out]) for n in ("key_a", "key_b", "found_spans")]
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(key(column(text)), names)])
    packed = united.select(F.col("a").alias(names[0]), F.col("b").alias(names[1]), F.struct("hit", "whole", "items").alias(names[2]))
    joined = keyed.join(packed, names[:2], "left")
    frame, places = carried(joined, text, fields, column(names[2]))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = list(text_bytes(part.column(0)))
                found = []
                for t, f in zip(texts, part.column(part.num_columns - 1).to_pylist()):
                    words = words_of(t or b"")
                    marks = np.zeros((2, len(words)), bool)
                    for row, spans in zip(marks, (f["hit"], f["whole"]) if f else ()):
                        for a, b in spans:
                            row[a:b] = True
                    found.append((words, marks[0], marks[1], set(f["items"]) if f else set()))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + [_report(texts, found, min_span, with_clean)], names=schema.fieldNames())

    return frame.mapInArrow(giving_back(unite), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE, **given) -> DataFrame:
    """docs without hit spans, and without the documents of which more than max_coverage of the words are hit."""
    name = free_name("contamination", docs.columns)
    marked = scan(docs, benchmark, text, out=name, **given)
    kept = marked.where(column(name)["n_hit"] <= max_coverage * column(name)["n_words"])
    return kept.select(*[column(name)["clean"].alias(c) if c == text else column(c) for c in docs.columns])
