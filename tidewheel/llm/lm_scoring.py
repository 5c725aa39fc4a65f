"""LM scoring: online logistic context mixing over bits, for the total log-probability (bits per byte) of a text.

Tokens are the words of a text (runs of `[^\\x20\\x09-\\x0D]`, A-Z lower-cased) and one end. Every token is coded bit by bit:

1. Repeat bit: has the token followed the two words before it in another training place? Coded wherever the context was
   seen and its last word isn't one of the commonest. Two predictors, one by whether the last repeat bit was set and one by
   how often the context was seen, adapt within the text; their log-odds are mixed. A set bit leaves the choice among the
   context's continuations, by their counts.
2. Else a known bit: is the token one of the training texts' words? (Share of words seen once, by class.)
3. A known word is coded by the bits of its hash, down to the one where it is the only word left. Predictors give a bit's
   odds from the tokens under the two branches: of the whole corpus, of the class, and from the distinct words there. A
   mixer combines their log-odds with weights picked by a gate (how often the branch was seen in the class and at all).
4. An unknown word is spelled, byte by byte with a terminator (frequent bytes by five bits, others by thirteen), by
   hashed-context predictors of several orders, one of them by class, mixed with weights gated by how often the contexts of
   two of the orders were seen. A text moves these weights while it is coded: its own part of them, 0 at its start and the
   same at every gate, takes a gradient step after each spelled word.

The class of a token depends on the words before it in the text: the commonest words of the corpus are clustered by which of
them follow each other (languages and genres come out as clusters), and the class is the cluster with most of the last
HISTORY common words. The weights that texts start with are learned online, a step after every block of words, on each word as
if one occurrence of it had not been counted; each task learns on its part of the vocabulary and the weights are averaged by
tokens. A text of the
training part is scored in the same way: its tokens' own occurrences don't count, so that training texts and others compare,
and a text that occurs twice stands out.

What is gathered grows with the corpus and is never broadcast: words by class, and (two words, next word) counts. Both are
exchanged: each run of about RUN_BYTES of text sends its distinct keys, sorted and packed, to the shards of the key space; a
shard adds up and answers every run in the run's order, so that answers need no keys. Shards are sized by the corpus's
tokens. Only these are broadcast: the class table, a row of counts a shard (SHARDS at most), the spelling counters (at
most MAX_SLOTS slots a predictor, sized by the vocabulary) and the mixers' weights.

The texts are scanned three times (common words; keys; scores) and never shuffled. Runs are cut by the bytes of texts in scan
order, so both last scans see the same ones; a run whose answers don't fit stops the job. A frame that isn't a plain scan is
first written to the shared folder.

base_score is the sum over tokens of log10((c+1)/(N+V+1)). A null or empty text is its end token. Without training rows
all counts are 0, everything is spelled and mixers stay at their start. Repeated rows are scored one by one. An empty table
gives an empty result. Extra columns are ignored. Ids must be integers; others raise ValueError.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain, groupby, starmap

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, fresh_path, give_back, giving_back, hash_words, integer_id, materialize, mix64, pieces, slices, text_bytes

RUN_BYTES = 10 << 20
#: Common words: a run offers its TOP most frequent ones, the corpus keeps COMMON; clusters of them, and the common words a
#: class looks back on.
TOP, COMMON, CLASSES, HISTORY = 96, 128, 15, 16
#: Tokens of the corpus for each shard of the key space, and the most shards there are.
SHARD_TOKENS, SHARDS = 4 << 20, 1 << 14
#: Spelling: context lengths in bytes; the last predictor sees three bytes and the class. Slots by vocabulary up to a bound.
ORDERS = (2, 3, 4, 5)
MIN_SLOTS, MAX_SLOTS = 16, 20
BLOCK_WORDS = 5_000
PRIOR = 0.4
RATE = 0.05
#: Step of a text's own weights after a spelled word, on the sum over its bits.
TEXT_RATE = 0.005
#: Weight of the repeat bit's first guess, and the chance of a repeat after none and after one.
GUESS, AFTER_NONE, AFTER_ONE = 2.0, 0.05, 0.9
_BLOCK = 1 << 16
#: Tokens whose working arrays are held at once.
_PART = 1 << 17
#: Spelled words whose bits are held at once.
_SPELLED = 2_000
_PATH_GATES = 16 * 6
_SPELL_GATES = 16 * 16
#: Bits of a context's next token.
NEXT_BITS = 14
#: Bytes with a five-bit symbol, fixed: the terminator, letters, two stops and the two commonest UTF-8 bytes here.
SYMBOLS = b" etaoinshrdlucmfwypvbgkjqxz,.\xc3\xa9"
ESCAPE = 31
_LN10 = math.log(10)
_MIX = np.random.default_rng(77).integers(0, 1 << 64, 300, np.uint64) | np.uint64(1)
_END_HASH = np.uint64(0x9E3779B97F4A7C10)
_END_FLAG = 0x80
_U = np.uint64


def file_system(path: str):
    return pa.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def packed(values: np.ndarray) -> bytes:
    """Compressed by byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T if len(values) else np.zeros((1, 0), np.uint8)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n) if n else np.zeros((size, 0), np.uint8)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def rounded(values: np.ndarray) -> np.ndarray:
    """float32 with eleven bits of fraction, which pack well."""
    return ((values.astype(np.float32).view(np.uint32) + np.uint32(0x800)) & np.uint32(0xFFFFF000)).view(np.float32)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=_U(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, np.uint64), dtype=np.uint64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts keys, first place of each distinct key in it, distinct keys)."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return order, starts, ordered[starts]


# Runs


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], np.ndarray]]:
    """(run, ids, lower-cased texts, training flags): a run ends with the text that reaches RUN_BYTES. What its work has freed
    is given back before the next one is gathered, so the work shall hold nothing of a run when it asks for another."""
    run, size, ids, texts, learns = 0, 0, [], [], []
    for batch in batches:
        for part in slices(batch, "t"):
            for i, t, x in zip(part.column("id").to_pylist(), text_bytes(part.column("t")), part.column("learn").to_pylist()):
                ids.append(i)
                texts.append((t or b"").lower())
                learns.append(bool(x))
                size += len(texts[-1]) + 1
                if size >= RUN_BYTES:
                    yield run, ids, texts, np.array(learns, bool)
                    run, size, ids, texts, learns = run + 1, 0, [], [], []
                    give_back()
    if ids:
        yield run, ids, texts, np.array(learns, bool)


def _chunk(run: int) -> int:
    return TaskContext.get().partitionId() * 100_000 + run


class Tokens:
    """The tokens of a run in order: hash, text number, and where the word stands."""

    def __init__(self, texts: list[bytes], block: int = 1 << 20):
        hashes, owners, self.starts, self.ends, self.blocks, at = [], [], [], [], [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < block):
                size += len(texts[stop]) + 1
                stop += 1
            # A text far beyond a block is hashed in pieces, so that memory follows the block.
            longer = stop == at + 1 and size > 2 * block
            for joined in pieces(texts[at], block) if longer else [b"\n".join(texts[at:stop])]:
                h, starts, ends = hash_words(joined)
                bounds = np.cumsum([len(t) + 1 for t in texts[at:stop]])
                owner = np.zeros(len(starts), np.int64) if longer else np.repeat(np.arange(len(bounds)), np.diff(np.searchsorted(starts, bounds), prepend=0))
                hashes.append(h)
                owners.append((owner + at).astype(np.int32))
                self.starts.append(starts.astype(np.int32))
                self.ends.append(ends.astype(np.int32))
                self.blocks.append(joined)
            at = stop
        self.n_words = np.zeros(len(texts), np.int64)
        for owner in owners:
            if len(owner):
                found = np.bincount(owner - owner[0])
                self.n_words[owner[0] : owner[0] + len(found)] += found
        self.last = np.cumsum(self.n_words + 1) - 1  # the place of each text's end
        self.first = self.last - self.n_words
        self.hash = np.empty(int(self.last[-1]) + 1 if len(texts) else 0, np.uint64)
        self.owner = np.empty(len(self.hash), np.int32)
        at = 0
        for h, owner in zip(hashes, owners):
            places = np.arange(at, at + len(h)) + owner
            self.hash[places], self.owner[places] = h, owner
            at += len(h)
        self.hash[self.last], self.owner[self.last] = _END_HASH, np.arange(len(texts))

    def words(self, places: np.ndarray) -> list[bytes]:
        """The bytes of the tokens at these places; an end is no bytes."""
        out: list[bytes] = []
        bounds = np.cumsum([0, *map(len, self.starts)])
        for n in range(0, len(places), _PART):
            part = places[n : n + _PART]
            number = part - self.owner[part]  # among the words
            ends = self.hash[part] == _END_HASH
            block = np.searchsorted(bounds[1:], number, side="right")
            block[ends] = 0
            starts, stops = np.zeros((2, len(part)), np.int32)
            for b in range(len(self.blocks)):
                mine = np.flatnonzero((block == b) & ~ends)
                k = number[mine] - bounds[b]
                starts[mine], stops[mine] = self.starts[b][k], self.ends[b][k]
            out += [self.blocks[b][i:j] for b, i, j in zip(block.tolist(), starts.tolist(), stops.tolist())]
        return out


class Classes:
    """The clusters of the common words."""

    def __init__(self, words: list[bytes], clusters: list[int]):
        hashes = hash_words(b" ".join(words))[0] if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.clusters = hashes[order], np.array(clusters, np.uint8)[order] if words else np.zeros(0, np.uint8)
        self.n = int(self.clusters.max()) + 1 if words else 1  # 0: no common word yet

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        """The cluster of each word, 0 if it isn't common."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.uint8)
        out = np.empty(len(hashes), np.uint8)
        for n in range(0, len(hashes), _PART):
            part = hashes[n : n + _PART]
            at = np.minimum(np.searchsorted(self.hashes, part), len(self.hashes) - 1)
            out[n : n + _PART] = np.where(self.hashes[at] == part, self.clusters[at], np.uint8(0))
        return out

    def histories(self, tokens: Tokens, own: np.ndarray) -> np.ndarray:
        """The class of each token, by the words before it; own: of_words of the tokens."""
        out = np.zeros(len(tokens.hash), np.uint8)
        common = np.flatnonzero(own)
        if not len(common):
            return out
        text = tokens.owner[common]
        first = np.searchsorted(text, text)  # the text's first common word
        start = np.maximum(first, np.arange(len(common)) - HISTORY + 1)
        best, state = np.full(len(common), -1, np.int32), np.zeros(len(common), np.uint8)
        for c in range(1, self.n):
            seen = np.concatenate(([0], np.cumsum(own[common] == c, dtype=np.int32)))
            votes = seen[1:] - seen[start]
            state = np.where(votes > best, np.uint8(c), state)
            best = np.maximum(best, votes)
        before = np.cumsum(own > 0, dtype=np.int32) - (own > 0) - 1  # the last common word before each token
        at = np.maximum(before, 0)
        return np.where((before >= 0) & (text[at] == tokens.owner), state[at], np.uint8(0))


def clusters_of(pairs: dict[tuple[bytes, bytes], int], most: int = CLASSES) -> tuple[list[bytes], list[int]]:
    """(common words, their clusters from 1 on): words are merged by average link, as long as two clusters follow each other
    more often than by chance, or there are more than `most`."""
    total: dict[bytes, int] = {}
    for (a, b), n in pairs.items():
        total[a] = total.get(a, 0) + n
        total[b] = total.get(b, 0) + n
    words = sorted(sorted(total), key=lambda w: -total[w])[:COMMON]
    at = {w: i for i, w in enumerate(words)}
    count = np.zeros((len(words), len(words)))
    for (a, b), n in pairs.items():
        if a in at and b in at:
            count[at[a], at[b]] += n
            count[at[b], at[a]] += n
    groups = [[i] for i in range(len(words))]
    merged = count.copy()
    while len(groups) > 1:
        mass = merged.sum(axis=1)
        lift = merged * mass.sum() / np.maximum(np.outer(mass, mass), 1e-9)
        np.fill_diagonal(lift, -1)
        i, j = sorted(np.unravel_index(lift.argmax(), lift.shape))
        if lift[i, j] < 1 and len(groups) <= most:
            break
        groups[i] += groups[j]
        merged[i] += merged[j]
        merged[:, i] += merged[:, j]
        merged = np.delete(np.delete(merged, j, 0), j, 1)
        del groups[j]
    number = {i: n + 1 for n, g in enumerate(groups) for i in g}
    return words, [number[i] for i in range(len(words))]


def common_words(source: DataFrame) -> tuple[Classes, int]:
    """(classes, tokens of all texts). Every run gives how often its own most frequent words follow each other in its training
    texts, other words left out."""

    def pairs(_run: int, _ids: list, texts: list[bytes], learns: np.ndarray) -> pa.RecordBatch:
        tokens = Tokens(texts)
        texts.clear()
        words = np.flatnonzero(learns[tokens.owner] & (tokens.hash != _END_HASH))
        order, starts, keys = grouped(tokens.hash[words])
        counts = np.diff(np.append(starts, len(order)))
        top = np.sort(np.lexsort((keys, -counts))[:TOP])
        names = tokens.words(words[order[starts[top]]])
        at = np.minimum(np.searchsorted(keys[top], tokens.hash[words]), max(len(top) - 1, 0))
        hit = np.flatnonzero(keys[top][at] == tokens.hash[words]) if len(top) else np.zeros(0, np.int64)
        near = tokens.owner[words[hit[1:]]] == tokens.owner[words[hit[:-1]]]
        code = (at[hit[:-1]] * TOP + at[hit[1:]])[near] if len(hit) else np.zeros(0, np.int64)
        found, n = np.unique(code, return_counts=True)
        columns = [[names[c // TOP] for c in found], [names[c % TOP] for c in found], n.tolist()]
        columns = [c + [x] for c, x in zip(columns, (b"", b"", len(tokens.hash)))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return starmap(pairs, _runs(batches))

    found = materialize(source.mapInArrow(giving_back(scan), "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "common")
    plain = found.where(F.length("a") > 0)
    most = plain.select(F.explode(F.array("a", "b")).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(COMMON)
    words = [bytes(r["w"]) for r in most.collect()]
    kept = plain.where(F.col("a").isin(words) & F.col("b").isin(words)).collect() if words else []  # COMMON * COMMON rows at most
    total = found.where(F.length("a") == 0).first()
    return Classes(*clusters_of({(bytes(r["a"]), bytes(r["b"])): r["n"] for r in kept})), total["n"] if total else 0


def item_keys(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Word and class in one number that sorts by word: 60 bits of hash, 4 of class."""
    return (hashes & ~_U(15)) | classes.astype(np.uint64)


def context_places(tokens: Tokens, own: np.ndarray) -> np.ndarray:
    """Tokens with two words before them in their text, the nearer of which isn't common."""
    return np.flatnonzero((tokens.owner[:-2] == tokens.owner[2:]) & (own[1:-1] == 0)) + 2


def context_keys(tokens: Tokens, at: np.ndarray, bits: int) -> np.ndarray:
    """The context's hash in the upper `bits`, NEXT_BITS of the next token's below; the rest is zero, which packs well."""
    out, low = np.empty(len(at), np.uint64), _U(64 - bits)
    for n in range(0, len(at), _PART):
        part = at[n : n + _PART]
        context = mix64(tokens.hash[part - 2] * _MIX[1] + tokens.hash[part - 1] * _MIX[2])
        next_ = mix64(tokens.hash[part] + _MIX[3]) >> _U(64 - NEXT_BITS)
        out[n : n + _PART] = ((context >> low) << low) | (next_ << _U(64 - bits - NEXT_BITS))
    return out


def text_parts(text: np.ndarray) -> Iterator[slice]:
    """Rows in order of their texts in parts of about _PART, cut between texts."""
    first = np.flatnonzero(np.diff(text, prepend=-1))
    cuts = np.unique(np.append(first[np.searchsorted(first, np.arange(0, len(text), _PART), side="right") - 1], len(text)))
    yield from (slice(i, j) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def run_keys(source: DataFrame, classes, shard_bits: int, context_bits: int) -> DataFrame:
    """(kind, shard, chunk, n, keys, words, c): kind 0, the run's items (words and class bytes); kind 1, its contexts with
    next tokens (packed keys); c: packed counts in its training texts, for items twice that, plus 1 if other texts have them.
    Rows are sorted by key within a run."""

    def keys_of(run: int, _: list, texts: list[bytes], learns: np.ndarray) -> Iterator[pa.RecordBatch]:
        tokens, chunk = Tokens(texts), _chunk(run)
        texts.clear()  # the tokens' blocks have their bytes
        weight = learns[tokens.owner].astype(np.int32)
        own = classes.value.of_words(tokens.hash)
        history = classes.value.histories(tokens, own)
        at = context_places(tokens, own)
        for kind in (0, 1):
            keys = item_keys(tokens.hash, history) if kind == 0 else context_keys(tokens, at, context_bits)
            if not len(keys):
                continue
            order, starts, distinct = grouped(keys)
            counts = np.add.reduceat((weight if kind == 0 else weight[at])[order], starts)
            if kind == 0:
                counts = 2 * counts + (counts < np.diff(np.append(starts, len(order))))
            counts = counts.astype(np.uint32)
            shards = (distinct >> _U(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(distinct), np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(distinct)]))
            words = tokens.words(order[starts]) if kind == 0 else []
            if kind == 0:
                tags = (distinct & _U(15)).astype(np.uint8) | np.where(distinct >> _U(4) == _END_HASH >> _U(4), _END_FLAG, 0).astype(np.uint8)
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                data = tags[a:b].tobytes() if kind == 0 else packed_keys(distinct[a:b])
                joined = b" ".join([w or b"." for w in words[a:b]]) if kind == 0 else b""
                rows.append((kind, int(shards[a]), chunk, b - a, data, pa.compress(joined, codec="zstd", asbytes=True), len(joined), packed(counts[a:b])))
            del keys, order, distinct, counts, words
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            for i in range(0, len(rows), 512):
                part = list(zip(*rows[i : i + 512]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], names=["kind", "shard", "chunk", "n", "keys", "words", "size", "c"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chain.from_iterable(starmap(keys_of, _runs(batches)))

    return source.mapInArrow(giving_back(scan), "kind int, shard int, chunk long, n int, keys binary, words binary, size int, c binary")


def _words_of_row(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, keys, c) of a row of items."""
    text = pa.decompress(row["words"], row["size"], codec="zstd", asbytes=True)
    words = text.split(b" ")
    tags = np.frombuffer(row["keys"], np.uint8)
    hashes = hash_words(text)[0]
    hashes[tags >= _END_FLAG] = _END_HASH
    return words, item_keys(hashes, tags & 15), unpacked(row["c"], row["n"], np.uint32).astype(np.int64)


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """rows dealt by shard and sorted, so that a task streams through one shard after the other."""
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "chunk")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """(shard, its rows) of a sorted stream."""

    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}

    yield from groupby(rows(), key=lambda r: r["shard"])


# The vocabulary of a shard


class Vocabulary:
    """A shard's items, sorted by key: words by class with their training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_classes: int, elsewhere: np.ndarray | None = None):
        self.keys, self.counts = keys, counts.astype(np.int64)
        self.elsewhere = np.ones(len(keys), bool) if elsewhere is None else elsewhere  # whether other than training texts have it
        self.cls = (keys & _U(15)).astype(np.int64)
        self.word_keys, self.word = np.unique(keys >> _U(4), return_inverse=True)
        self.total = np.bincount(self.word, self.counts, len(self.word_keys)).astype(np.int64)
        known = np.flatnonzero(self.total > 0)
        self.known_keys = self.word_keys[known]
        self.known_at = np.full(len(self.word_keys), -1, np.int64)
        self.known_at[known] = np.arange(len(known))
        by_class = np.zeros((len(known), n_classes), np.int64)
        at = self.known_at[self.word]
        np.add.at(by_class, (at[at >= 0], self.cls[at >= 0]), self.counts[at >= 0])
        zero = np.zeros((1, n_classes), np.int64)
        self.sums = np.concatenate((zero, np.cumsum(by_class, axis=0)))
        self.all = self.sums.sum(axis=1)

    def row(self) -> tuple[list[int], list[int], int, int]:
        """(tokens by class, tokens of words seen once by class, known words, words seen once)."""
        once = self.total[self.word] == 1
        n = self.sums.shape[1]
        return self.sums[-1].tolist(), np.bincount(self.cls[once], self.counts[once], n).astype(int).tolist(), len(self.known_keys), int((self.total == 1).sum())


def gate_of(class_mass: np.ndarray, mass: np.ndarray) -> np.ndarray:
    level = np.minimum(np.log2(class_mass + 1), 15).astype(np.int64)
    return level * 6 + np.minimum(np.log2(mass + 1) / 4, 5).astype(np.int64)


def _odds(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    return np.log((one + PRIOR) / (zero + PRIOR))


Bits = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def path_bits(vocabulary: Vocabulary, items: np.ndarray, shard: int, shard_bits: int, tops: np.ndarray, left_out: int) -> Bits:
    """(items, bit, inputs, gate) for every bit of known words' hashes. tops[shard]: tokens by class, and known words.
    left_out: occurrences of each word, of its item's class, that don't count."""
    cls, n_classes = vocabulary.cls[items], tops.shape[1] - 1
    sums = np.concatenate((np.zeros((1, n_classes + 1), np.int64), np.cumsum(tops, axis=0)))
    everything = np.arange(len(items))

    def inputs(bit, class_one, class_zero, one, zero, words_one, words_zero):
        class_one, class_zero = class_one - left_out * bit, class_zero - left_out * (1 - bit)
        one, zero = one - left_out * bit, zero - left_out * (1 - bit)
        # A class that never held the word can't lose an occurrence of it.
        class_one, class_zero = np.maximum(class_one, 0), np.maximum(class_zero, 0)
        x = np.stack([_odds(one, zero), _odds(class_one, class_zero), _odds(words_one, words_zero), np.full(len(bit), 0.3)], 1)
        return x.astype(np.float32), gate_of(class_one + class_zero, one + zero)

    a, b = 0, 1 << shard_bits
    for level in range(shard_bits):
        m = (a + b) // 2
        bit = (shard >> (shard_bits - 1 - level)) & 1
        low, high = sums[m] - sums[a], sums[b] - sums[m]
        if low.any() and high.any():
            full = np.full(len(items), 1)
            x, gate = inputs(full * bit, high[cls], low[cls], full * high[:-1].sum(), full * low[:-1].sum(), full * high[-1], full * low[-1])
            yield everything, full * bit, x, gate
        a, b = (m, b) if bit else (a, m)
    at = vocabulary.known_at[vocabulary.word[items]]
    keys = vocabulary.known_keys[at]
    start, stop = np.zeros(len(items), np.int64), np.full(len(items), len(vocabulary.known_keys))
    rows = everything
    for level in range(shard_bits, 60):
        rows = rows[stop[rows] - start[rows] > 1]
        if not len(rows):
            return
        shift = _U(59 - level)
        zeros = np.concatenate(([0], np.cumsum((vocabulary.known_keys >> shift) & _U(1) == 0)))
        lo, hi = start[rows], stop[rows]
        mid = lo + zeros[hi] - zeros[lo]
        bit = ((keys[rows] >> shift) & _U(1)).astype(np.int64)
        both = np.flatnonzero((mid > lo) & (mid < hi))
        if len(both):
            l, m, h, g = lo[both], mid[both], hi[both], cls[rows[both]]
            s, t = vocabulary.sums, vocabulary.all
            x, gate = inputs(bit[both], s[h, g] - s[m, g], s[m, g] - s[l, g], t[h] - t[m], t[m] - t[l], h - m, m - l)
            yield rows[both], bit[both], x, gate
        start[rows], stop[rows] = np.where(bit == 1, mid, lo), np.where(bit == 1, hi, mid)


# Spelling


def _code() -> np.ndarray:
    """The symbol (0 to 31) of every byte; ESCAPE for bytes that take eight more bits."""
    symbol = np.full(256, ESCAPE, np.int64)
    symbol[list(SYMBOLS)] = np.arange(len(SYMBOLS))
    return symbol


_SYMBOL = _code()


class Contexts:
    """The bytes of a block of words, each with a terminator, and the hashed contexts of every byte."""

    def __init__(self, words: list[bytes], classes: np.ndarray, slots: int):
        self.slots = slots
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        first = np.cumsum(lengths) - lengths
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        self.place = np.arange(len(data)) - first[self.word]
        self.byte = data
        self.hashes = []
        h, k = np.zeros(len(data), np.uint64), 0
        for n, order in enumerate(ORDERS):
            while k < order:
                k += 1
                back = np.concatenate((np.zeros(min(k, len(data)), np.uint8), data[:-k]))[: len(data)]
                h = h + _MIX[np.where(self.place >= k, back, 32)] * _MIX[256 + k]
            self.hashes.append(mix64(h + _MIX[n]))
            if order == 3:
                by_class = mix64(h + _MIX[30] + _MIX[32 + classes[self.word]])
        self.hashes.append(by_class)

    def bits(self) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(which bytes, tree node, bit, slots of every predictor): five bits of each byte's symbol, then the eight of each
        byte that has none."""
        for rows, value, width, base in ((slice(None), _SYMBOL[self.byte], 5, 0), (np.flatnonzero(_SYMBOL[self.byte] == ESCAPE), self.byte.astype(np.int64), 8, 32)):
            value = value if width == 5 else value[rows]
            if not len(value):
                continue
            hashes = [h[rows] for h in self.hashes]
            node = np.ones(len(value), np.int64)
            for k in range(width):
                bit = (value >> (width - 1 - k)) & 1
                salt = _MIX[node + base]
                slots = [((h ^ salt) * _MIX[299] >> _U(64 - self.slots)).astype(np.int64) + (n << self.slots) for n, h in enumerate(hashes)]
                yield rows, node + base, bit, slots
                node = node * 2 + bit


PREDICTORS = len(ORDERS) + 1


def _level(counts: np.ndarray) -> np.ndarray:
    """The whole part of log2(counts + 1), 15 at most, of whole float32 counts: the exponent of the number's form."""
    return np.minimum(((counts + np.float32(1)).view(np.int32) >> 23) - 127, 15)


def count_bits(words: list[bytes], classes: np.ndarray, table: np.ndarray, slots: int) -> None:
    """Adds every word once to table[slot, bit]."""
    flat = table.reshape(-1)
    for _, _, bit, at in Contexts(words, classes, slots).bits():
        for a in at:
            np.add.at(flat, a * 2 + bit, np.float32(1))


def spell_bits(words: list[bytes], classes: np.ndarray, table: np.ndarray, slots: int, left_out: int | np.ndarray) -> Bits:
    """(words, bit, inputs, gate) for every bit of words' spellings; left_out, of all or of each word: 1 if the words were
    counted and shall not be."""
    c, pairs, prior = Contexts(words, classes, slots), table.view(np.uint64).reshape(-1), np.float32(PRIOR)
    for rows, _, bit, at in c.bits():
        x = np.empty((len(bit), PREDICTORS + 1), np.float32)
        seen = []
        out = left_out if np.ndim(left_out) == 0 else left_out[c.word[rows]]
        out_one = (out * bit).astype(np.float32)
        out_zero = out - out_one if np.ndim(out) == 0 else out.astype(np.float32) - out_one
        for n, a in enumerate(at):
            pair = pairs.take(a).view(np.float32)  # both counts of a slot lie side by side
            one, zero = np.maximum(pair[1::2] - out_one, 0), np.maximum(pair[::2] - out_zero, 0)
            if n in (1, len(ORDERS) - 1):
                seen.append(_level(one + zero))
            x[:, n] = np.log((one + prior) / (zero + prior))
        x[:, -1] = 0.3
        yield c.word[rows], bit, x, seen[1] * 16 + seen[0]


# Mixers


class Mixer:
    """Gated weights of log-odds, learned by AdaGrad steps on the coding cost."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.squares = weights.astype(np.float32), np.zeros(weights.shape)
        self._clear()

    def _clear(self) -> None:
        self.grad, self.mass = np.zeros(self.weights.shape), np.zeros(len(self.weights))

    def odds(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", x, self.weights.take(gate, axis=0))

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        err = (bit - 1 / (1 + np.exp(-self.odds(x, gate)))) * weight
        for j in range(x.shape[1]):
            self.grad[:, j] += np.bincount(gate, err * x[:, j], len(self.mass))
        self.mass += np.bincount(gate, weight, len(self.mass))

    def step(self) -> None:
        g = self.grad / np.maximum(self.mass, 1e-9)[:, None]
        self.squares += g * g
        self.weights += (RATE * g / np.sqrt(self.squares + 1e-4)).astype(np.float32)
        self._clear()

    def costs(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """-ln probability of each bit."""
        z = self.odds(x, gate) * (1 - 2 * bit).astype(np.float32)
        return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def start_mixers() -> list[Mixer]:
    """The path's mixer and the spelling's."""
    level = np.arange(_PATH_GATES) // 6
    share = np.minimum(0.1 + 0.08 * level, 0.9)
    path = np.stack([1 - share, share, np.zeros(_PATH_GATES), np.zeros(_PATH_GATES)], 1)
    return [Mixer(path), Mixer(np.tile(np.array([0.1, 0.2, 0.25, 0.25, 0.2, 0.0]), (_SPELL_GATES, 1)))]


def load_mixers(flat: np.ndarray | None) -> list[Mixer]:
    mixers, at = start_mixers(), 0
    for m in mixers if flat is not None else ():
        m.weights = flat[at : at + m.weights.size].reshape(m.weights.shape).astype(np.float32)
        at += m.weights.size
    return mixers


class Model:
    """What is broadcast: class count, shard rows, spelling counters and weights."""

    def __init__(self, n_classes: int, shard_bits: int, tops: np.ndarray, once: np.ndarray, slots: int, table: np.ndarray | None, flat: np.ndarray | None = None):
        self.n_classes, self.shard_bits, self.tops, self.slots, self.table, self.flat = n_classes, shard_bits, tops, slots, table, flat
        mass = tops[:, :-1].sum(axis=0)
        self.unknown = (once + (once.sum() + 1) / (mass.sum() + 2)) / (mass + 1)  # by class, backed off to all
        self.mixers: list[Mixer] | None = None

    def ready(self) -> list[Mixer]:
        if self.mixers is None:
            self.mixers = load_mixers(self.flat)
        return self.mixers

    def known_scores(self, v: Vocabulary, shard: int, items: np.ndarray, left_out: int) -> np.ndarray:
        """ln probability of known words."""
        out = np.log1p(-self.unknown[v.cls[items]])
        for rows, bit, x, gate in path_bits(v, items, shard, self.shard_bits, self.tops, left_out):
            out[rows] -= self.ready()[0].costs(x, gate, bit)
        return out

    def spelled_scores(self, words: list[bytes], classes: np.ndarray, texts: np.ndarray, left_out: np.ndarray) -> np.ndarray:
        """ln probability of unknown words, given in the order of their texts. The mixer goes on learning in each text: a
        text's own weights, added to the gates', take a step after every word. Texts go side by side, word by word."""
        out = np.log(self.unknown[classes])
        if not len(words):
            return out
        first = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1])))
        sizes = np.diff(np.append(first, len(texts)))
        turn = np.arange(len(texts)) - np.repeat(first, sizes)  # a word's number in its text
        number = np.repeat(np.arange(len(first)), sizes)
        own = np.zeros((len(first), PREDICTORS + 1), np.float32)
        order = np.argsort(turn, kind="stable")
        for at in range(0, len(order), _SPELLED):
            part = order[at : at + _SPELLED]
            rows, bit, x, gate = map(np.concatenate, zip(*spell_bits([words[i] for i in part], classes[part], self.table, self.slots, left_out[part])))
            by_word = np.argsort(rows.astype(np.uint16), kind="stable")  # numbers below _SPELLED; 16 bits are sorted by radix
            rows, bit, x, gate = rows[by_word], bit[by_word].astype(np.float32), x[by_word], gate[by_word]
            odds, text = self.ready()[1].odds(x, gate), number[part]
            starts = np.searchsorted(rows, np.arange(len(part) + 1))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(turn[part])) + 1, [len(part)]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                a, b = starts[i], starts[j]
                odds[a:b] += np.einsum("ij,ij->i", x[a:b], own[text[rows[a:b]]])
                err = bit[a:b] - 1 / (1 + np.exp(-odds[a:b]))
                own[text[i:j]] += TEXT_RATE * np.add.reduceat(err[:, None] * x[a:b], starts[i:j] - a, axis=0)
            z = odds * (1 - 2 * bit)
            out[part] -= np.add.reduceat(np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))), starts[:-1])
        return out

    def scores(self, v: Vocabulary, shard: int) -> np.ndarray:
        """ln probability of every known word's items: as counted (of those that other than training texts have), and with
        one occurrence left out (of those that training texts have). Words that are spelled have none here."""
        out, total = np.zeros((2, len(v.keys))), v.total[v.word]
        for left_out, wanted in enumerate((v.elsewhere, v.counts > 0)):
            some = np.flatnonzero((total > left_out) & wanted)
            for at in range(0, len(some), 4 * BLOCK_WORDS):
                part = some[at : at + 4 * BLOCK_WORDS]
                out[left_out, part] = self.known_scores(v, shard, part, left_out)
        return out


# Exchanges


def vocabulary_of(items: DataFrame, shards: int, n_classes: int) -> DataFrame:
    """A row for each shard: its items like those of a run (chunk -1), and the figures of Vocabulary.row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            held: list[tuple[list[bytes], np.ndarray, np.ndarray]] = []
            size = 0
            for row in rows:
                held.append(_words_of_row(row))
                size += row["n"]
                if size > 1 << 20:
                    held = [_united(held)]
                    size = 0
            words, keys, counts = _united(held)
            tags = (keys & _U(15)).astype(np.uint8) | np.where(keys >> _U(4) == _END_HASH >> _U(4), _END_FLAG, 0).astype(np.uint8)
            text = b" ".join(words)
            row = (shard, -1, len(words), tags.tobytes(), pa.compress(text, codec="zstd", asbytes=True), len(text), packed(counts.astype(np.uint32)))
            figures = Vocabulary(keys, counts >> 1, n_classes).row()
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
            names = ["shard", "chunk", "n", "keys", "words", "size", "c", "mass", "once", "known", "single"]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*row, *figures), kinds)], names=names)

    schema = "shard int, chunk long, n int, keys binary, words binary, size int, c binary, mass array<long>, once array<long>, known long, single long"
    return by_shard(items, shards).mapInArrow(giving_back(add), schema)


def _united(held: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
    words = [w for h in held for w in h[0]]
    order, starts, distinct = grouped(keys)
    counts = counts[order]
    return [words[i] for i in order[starts]], distinct, 2 * np.add.reduceat(counts >> 1, starts) + np.maximum.reduceat(counts & 1, starts)


def _vocabulary_rows(batches: Iterator[pa.RecordBatch], n_classes: int) -> Iterator[tuple[int, list[bytes], Vocabulary]]:
    for shard, rows in _shards(batches):
        for row in rows:
            words, keys, counts = _words_of_row(row)
            yield shard, *_opened(words, keys, counts, n_classes)


def _opened(words: list[bytes], keys: np.ndarray, c: np.ndarray, n_classes: int) -> tuple[list[bytes], Vocabulary]:
    end = np.flatnonzero(keys >> _U(4) == _END_HASH >> _U(4))
    for i in end.tolist():
        words[i] = b""
    return words, Vocabulary(keys, c >> 1, n_classes, (c & 1).astype(bool))


def spelling_table(vocabulary: DataFrame, n_classes: int, slots: int) -> np.ndarray:
    """(slots, 2) counts of zeros and ones over the spellings of the distinct words by class, summed in blocks."""
    size = PREDICTORS << slots

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros((size, 2), np.float32), False
        for _, words, v in _vocabulary_rows(batches, n_classes):
            seen = np.flatnonzero(v.counts > 0)
            for at in range(0, len(seen), 4 * BLOCK_WORDS):
                part = seen[at : at + 4 * BLOCK_WORDS]
                count_bits([words[i] for i in part], v.cls[part], table, slots)
                some = True
        for at in range(0, size, _BLOCK) if some else ():
            piece = table[at : at + _BLOCK]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // _BLOCK], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["block", "data"])

    def add(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in groups:
            for data in batch.column("data").to_pylist():
                total = total + np.frombuffer(zlib.decompress(data), np.float32).astype(np.float64)
        data = zlib.compress(total.astype(np.float32).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    schema = "block int, data binary"
    table = np.zeros((size, 2), np.float32)
    for r in vocabulary.mapInArrow(giving_back(count), schema).groupBy("block").applyInArrow(add, schema).collect():  # half a MB a block, `size` / _BLOCK of them
        piece = np.frombuffer(zlib.decompress(bytes(r["data"])), np.float32).reshape(-1, 2)
        table[r["block"] * _BLOCK : r["block"] * _BLOCK + len(piece)] = piece
    return table


def learn_shard(model: Model, mixers: list[Mixer], words: list[bytes], v: Vocabulary, shard: int) -> None:
    """Online steps on a shard's words, each as if one occurrence of it had not been counted: known ones by the path, words
    seen once by their spelling."""
    total = v.total[v.word]
    known, once = np.flatnonzero((total > 1) & (v.counts > 0)), np.flatnonzero((total == 1) & (v.counts > 0))
    for at in range(0, len(known), BLOCK_WORDS):
        part = known[at : at + BLOCK_WORDS]
        weight = v.counts[part].astype(np.float64) ** 0.75  # the commonest words alone don't decide a step
        for rows, bit, x, gate in path_bits(v, part, shard, model.shard_bits, model.tops, 1):
            mixers[0].learn(x, gate, bit, weight[rows])
        mixers[0].step()
    for at in range(0, len(once), BLOCK_WORDS):
        part = once[at : at + BLOCK_WORDS]
        for _, bit, x, gate in spell_bits([words[i] for i in part], v.cls[part], model.table, model.slots, 1):
            mixers[1].learn(x, gate, bit, np.ones(len(bit)))
        mixers[1].step()


def mixer_weights(vocabulary: DataFrame, shared) -> np.ndarray | None:
    """Both mixers' weights, learned by each task and averaged by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers, mass, model = start_mixers(), 0, shared.value
        for shard, words, v in _vocabulary_rows(batches, model.n_classes):
            learn_shard(model, mixers, words, v, shard)
            mass += int(v.counts.sum())
        if mass:
            flat = np.concatenate([m.weights.ravel() for m in mixers]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([mass], pa.int64()), pa.array([flat], pa.list_(pa.float64()))], names=["mass", "w"])

    rows = vocabulary.mapInArrow(giving_back(run), "mass long, w array<double>").select("mass", F.posexplode("w").alias("at", "w"))
    rows = rows.groupBy("at").agg((F.sum(F.col("w") * F.col("mass")) / F.sum("mass")).alias("w")).collect()  # a row per weight
    return np.array([r["w"] for r in sorted(rows)]) if rows else None


_ANSWER = "kind int, shard int, chunk long, n int, a binary, b binary, c binary"


def _answer(kind: int, row: dict, *arrays: np.ndarray) -> pa.RecordBatch:
    data = [packed(x) for x in arrays] + [None] * (3 - len(arrays))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((kind, row["shard"], row["chunk"], row["n"], *data), kinds)], names=["kind", "shard", "chunk", "n", "a", "b", "c"])


def item_answers(items: DataFrame, vocabulary: DataFrame, shards: int, shared) -> DataFrame:
    """For every run's items, in the run's order: training count of the word, and both scores of known words."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for shard, rows in _shards(batches):
            for row in rows:
                words, keys, counts = _words_of_row(row)
                if row["chunk"] < 0:  # the vocabulary, first of its shard
                    _, v = _opened(words, keys, counts, model.n_classes)
                    scores = rounded(model.scores(v, shard))
                    total = v.total[v.word].astype(np.uint32)
                else:
                    at = np.searchsorted(v.keys, keys)
                    yield _answer(0, row, total[at], scores[0][at], scores[1][at])

    columns = ["shard", "chunk", "n", "keys", "words", "size", "c"]
    return by_shard(vocabulary.select(*columns).unionByName(items.select(*columns)), shards).mapInArrow(giving_back(answer), _ANSWER)


def context_answers(contexts: DataFrame, shards: int, bits: int) -> DataFrame:
    """For every run's contexts with next tokens, in the run's order: how often training texts have both, and the context."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _shards(batches):
            held = list(rows)  # packed, some bytes a key
            keys = np.concatenate([unpacked_keys(r["keys"], r["n"]) for r in held])
            counts = np.concatenate([unpacked(r["c"], r["n"], np.uint32) for r in held]).astype(np.int64)
            order, starts, distinct = grouped(keys)
            del keys
            both = np.add.reduceat(counts[order], starts)
            context = distinct >> _U(64 - bits)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            sizes = np.diff(np.append(first, len(distinct)))
            alone = np.repeat(np.add.reduceat(both, first), sizes)
            group = np.empty(len(order), np.int32)
            group[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(order))))
            del order, counts
            at = 0
            for r in held:
                mine = group[at : at + r["n"]]
                at += r["n"]
                yield _answer(1, r, both[mine].astype(np.uint32), alone[mine].astype(np.uint32))

    return by_shard(contexts.select("shard", "chunk", "n", "keys", "c"), shards).mapInArrow(giving_back(answer), _ANSWER)


_FILE = ("count", "score", "score_without", "both", "context")


def write_answers(answers: DataFrame, out: str) -> DataFrame:
    """A file for every run: its answers, shard after shard; the result counts their rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        now = None

        def close() -> pa.RecordBatch:
            fs, at = file_system(f"{out}/chunk-{now}.arrow")
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            temp = f"{at}.{TaskContext.get().taskAttemptId()}"
            table = pa.table({n: pa.array([np.concatenate(held[n]) if held.get(n) else []], pa.large_list(k)) for n, k in zip(_FILE, (pa.uint32(), pa.float32(), pa.float32(), pa.uint32(), pa.uint32()))})
            with fs.open_output_stream(temp) as sink, pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            try:
                fs.move(temp, at)
            except OSError:  # another attempt was first
                fs.delete_file(temp)
            n = sum(map(len, held.get("count", [])))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                kind, _, chunk, n, *data = (c[i].as_py() for c in batch.columns)
                if chunk != now and now is not None:
                    yield close()
                if chunk != now:
                    held, now = {}, chunk
                names, kinds = (_FILE[:3], (np.uint32, np.float32, np.float32)) if kind == 0 else (_FILE[3:], (np.uint32, np.uint32))
                for name, k, d in zip(names, kinds, data):
                    held.setdefault(name, []).append(unpacked(d, n, k))
        if now is not None:
            yield close()

    return answers.repartition("chunk").sortWithinPartitions("chunk", "kind", "shard").mapInArrow(giving_back(write), "chunk long, n long")


def repeat_costs(text: np.ndarray, both: np.ndarray, context: np.ndarray) -> np.ndarray:
    """ln probability of each repeat bit, in order, `both` > 0 being a set one. Two predictors adapt within a text: one by its
    last repeat bit, one by how often the context was seen; their log-odds are mixed."""
    bit = (both > 0).astype(np.int64)
    same = np.concatenate(([False], text[1:] == text[:-1]))
    state = np.where(same, 1 + np.concatenate(([0], bit[:-1])), 0)
    level = np.minimum(np.log2(np.maximum(context, 1)), 7).astype(np.int64)

    def adapted(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        order = np.argsort(text.astype(np.int64) * 8 + kind, kind="stable")
        key, b = (text.astype(np.int64) * 8 + kind)[order], bit[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(start, len(key)))
        n = np.arange(len(key)) - np.repeat(start, sizes)
        ones = np.cumsum(b) - b
        ones -= np.repeat(ones[start], sizes)
        p = np.empty(len(key))
        p[order] = (ones + GUESS * first[order]) / (n + GUESS)
        return np.log(p / (1 - p))

    if not len(bit):
        return np.zeros(0)
    z = 0.7 * adapted(state, np.where(state == 2, AFTER_ONE, AFTER_NONE)) + 0.3 * adapted(level, np.full(len(bit), AFTER_NONE))
    return -np.logaddexp(0, np.where(bit == 1, -z, z))


def score(
    docs: DataFrame,
    learn_from: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    plain_scan: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of docs; learns from the
    rows for which learn_from holds. plain_scan: docs is a scan of files, which every job cuts in the same parts."""
    spark = docs.sparkSession
    source = docs.select(integer_id(docs, doc_id).alias("id"), column(text).alias("t"), learn_from.alias("learn"))
    if not plain_scan:
        source = materialize(source, "texts")
    found, tokens = common_words(source)
    classes = spark.sparkContext.broadcast(found)
    context_shards = max(1, math.ceil(tokens / SHARD_TOKENS))
    shard_bits = min(int(math.log2(SHARDS)), (context_shards - 1).bit_length())
    context_bits = min(44, max(24, tokens.bit_length() + 4))
    # Contexts are dealt by the same upper bits of their own key space, as finely as the corpus needs.
    keys = materialize(run_keys(source, classes, shard_bits, context_bits), "keys")
    items, contexts = keys.where("kind = 0"), keys.where("kind = 1")
    vocabulary = materialize(vocabulary_of(items, 1 << shard_bits, found.n), "vocabulary")
    tops, once, single = np.zeros((1 << shard_bits, found.n + 1), np.int64), np.zeros(found.n, np.int64), 0
    for r in vocabulary.select("shard", "mass", "once", "known", "single").collect():  # SHARDS rows at most
        tops[r["shard"]] = [*r["mass"], r["known"]]
        once += np.array(r["once"])
        single += r["single"]
    n, v = int(tops[:, :-1].sum()), int(tops[:, -1].sum())
    slots = min(MAX_SLOTS, max(MIN_SLOTS, (4 * v).bit_length()))
    model = Model(found.n, shard_bits, tops, once, slots, spelling_table(vocabulary, found.n, slots))
    model.flat = mixer_weights(vocabulary, spark.sparkContext.broadcast(model))
    model.mixers = None
    shared = spark.sparkContext.broadcast(model)
    answers = item_answers(items, vocabulary, 1 << shard_bits, shared).unionByName(context_answers(contexts, 1 << shard_bits, context_bits))
    out = fresh_path(spark, "answers")
    materialize(write_answers(answers, out), "chunks")
    for t in (keys, vocabulary):
        discard(t)
    scale = float(np.log10(n + v + 1.0))

    def scored(number: int, ids: list, texts: list[bytes], learns: np.ndarray) -> pa.RecordBatch:
        fs, path = file_system(f"{out}/chunk-{_chunk(number)}.arrow")
        with fs.open_input_file(path) as f:
            held = pa.ipc.open_file(f).read_all()
        answer = {c: held[c].combine_chunks().flatten().to_numpy() for c in _FILE}
        del held
        size, one = np.array([max(1, len(t)) for t in texts]), Tokens(texts)
        texts.clear()
        own = classes.value.of_words(one.hash)
        learnt = learns[one.owner]

        def spread(keys: np.ndarray, size: int) -> np.ndarray:
            """The place of each key's answer."""
            order = np.argsort(keys)
            keys = keys[order]
            rank = np.zeros(len(keys), np.int32)
            np.cumsum(keys[1:] != keys[:-1], out=rank[1:])
            if rank[-1] + 1 != size:
                raise RuntimeError("the scans of the texts were cut differently; pass a materialized table")
            at = np.empty(len(keys), np.int32)
            at[order] = rank
            return at

        history = classes.value.histories(one, own)
        at = spread(item_keys(one.hash, history), len(answer["count"]))
        count = answer["count"][at]
        value = np.where(learnt, answer["score_without"][at], answer["score"][at]).astype(np.float64)
        del at
        spelled = count <= learnt
        places = context_places(one, own)
        if len(places):
            at = spread(context_keys(one, places, context_bits), len(answer["both"]))
            mine = learnt[places].astype(np.uint32)  # both counts have a training text's own occurrence
            context = answer["context"][at] - mine
            seen = context > 0
            both, context, places = (answer["both"][at] - mine)[seen], context[seen], places[seen]
            del at, mine, seen
            spelled[places[both > 0]] = False
        del answer
        some = np.flatnonzero(spelled)
        value[some] = shared.value.spelled_scores(one.words(some), history[some], one.owner[some], learnt[some].astype(np.int64))
        if len(places):
            owner = one.owner[places]
            for part in text_parts(owner):
                cost, b, at = repeat_costs(owner[part], both[part], context[part]), both[part], places[part]
                value[at] = cost + np.where(b > 0, np.log(np.maximum(b, 1) / context[part]), value[at])
        total = np.bincount(one.owner, value, len(ids))
        base = np.bincount(one.owner, np.log10(count + 1.0), len(ids)) - (one.n_words + 1) * scale
        known = np.bincount(one.owner, count > 0, len(ids)).astype(np.int64)
        arrays = [
            pa.array(ids, pa.int64()), pa.array(one.n_words + 1, pa.int64()), pa.array(known), pa.array(np.full(len(ids), n)),
            pa.array(base), pa.array(total / _LN10), pa.array(-total / np.log(2) / size),
        ]
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return starmap(scored, _runs(batches))

    return source.mapInArrow(giving_back(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
