"""Toxicity: class-conditional Kneser-Ney models over the letters of words, and over whole words and pairs of words.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary text, give every word a log-likelihood; a text is
judged by the difference of the two, normalised by its length in words. Letter contexts stay inside a word, so insults are
found in inflections that were never seen. Orders up to SHARED use counts pooled over both classes: a rare expression
falls back to the same shared distribution in both, and so says nothing. Letters alone miss insults made of common letter
sequences; so whole words give a second difference and pairs of neighbouring words a third, from the shares of each class's
texts that hold them, discounted by one and backed off to the shared share. A logistic curve, fitted on texts that the
counts don't hold, turns the length-normalised differences into a score.

Noise of rare letters and words adds up in long texts, so a word counts only beyond a margin, and neutral words are added
to a text's length, so that one odd word doesn't decide a very short text. Both are learned: of the grid MARGINS x
WORD_MARGINS x PRIORS the point with the least cross-validated log loss on the calibration texts is taken.

Training texts: at most SAMPLE different (id, text) rows of each class, first in hash order among the labelled ones for
which `learn` holds, whole, however long. That row bound is the only one; it also bounds the model that is broadcast.
Their words are counted where they lie, so no text reaches the driver; every fifth text calibrates. Scoring is one scan and
a batched map over whole texts, without a shuffle; a worker keeps at most CACHE word scores.

Words are the runs of ASCII letters, digits and all other code points beyond ASCII, in lower case (A-Z). A null or empty
text, or one without words, has differences of 0 and gets the score of that. Without labelled rows of both classes in the
counted and in the calibrating part the score is 0 everywhere. Repeated rows are scored one by one; of repeated labels the
greatest counts; extra columns stay, but one named like the output, in whatever case, is replaced by it.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, column, hash_words, materialize, others, pieces, slices, text_bytes

ORDER = 6
SHARED = 2
#: Log-likelihoods (nats) by which a word's letters, and a whole word or pair, may have to favour a class to count.
MARGINS = (0.0, 1.0, 2.0, 3.0, 4.0)
WORD_MARGINS = (0.0, 0.5, 1.0, 2.0)
#: Neutral words that may be added to a text's length.
PRIORS = (1, 5, 20, 50)
#: The texts that a whole word or pair needs, and the part of all texts that its share of both classes weighs.
WORD_TEXTS = 3
BACKOFF = 0.3
SAMPLE = 3000
CACHE = 1 << 21
BLOCK_BYTES = 4 << 20
THRESHOLD = 0.3
_ALNUM = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_ALNUM).split()


class Grams:
    """The grams of padded words, order by order. A gram of up to 7 bytes is a number: its bytes, the last one lowest."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8)
        lengths = np.fromiter((len(w) + 2 for w in words), np.int32, len(words))
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        self.place = np.arange(len(self.data), dtype=np.int32) - np.repeat(np.cumsum(lengths, dtype=np.int32) - lengths, lengths)

    def at(self, order: int) -> np.ndarray:
        """Places with a gram of that order: not before the word's pad, and not the pad itself."""
        return np.flatnonzero(self.place >= max(1, order - 1))

    def keys(self, order: int, at: np.ndarray) -> np.ndarray:
        """The `order` bytes that end at each place; places before the first byte count as zero bytes."""
        out = np.zeros(len(at), np.uint64)
        for n in range(order):
            out |= np.where(at >= n, self.data[np.maximum(at - n, 0)], 0).astype(np.uint64) << np.uint64(8 * n)
        return out


class Sorted:
    """Sums of weights by key."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray | None = None):
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.sums = np.bincount(inverse, weights, len(self.keys)).astype(np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.sums[at], 0).astype(np.float64)


class KneserNey:
    """Interpolated Kneser-Ney over bytes: raw counts at the highest order, continuation counts below, one discount an
    order. `shared` has the words of both classes; orders up to SHARED are counted in it."""

    def __init__(self, words: Counter, shared: Counter):
        self.grams: list[Sorted] = []
        self.total: list[Sorted] = []
        self.kinds: list[Sorted] = []
        self.discount: list[float] = []
        own, pooled = Grams(list(words)), Grams(list(shared))
        counts = np.fromiter(words.values(), np.float64, len(words))
        for order in range(1, ORDER + 1):
            g = pooled if order <= SHARED else own
            at = g.at(order)
            if order == ORDER:
                grams = Sorted(g.keys(order, at), counts[g.word[at]])
            else:
                # Distinct left neighbours; the start of a word is one of its own, which the top bit marks.
                first = (g.place[at] == order - 1).astype(np.uint64)
                left = np.where(first > 0, g.keys(order, at), g.keys(order + 1, at)) | (first << np.uint64(63))
                grams = Sorted(np.unique(left) & np.uint64((1 << 8 * order) - 1))
            once, twice = int((grams.sums == 1).sum()), int((grams.sums == 2).sum())
            self.grams.append(grams)
            self.total.append(Sorted(grams.keys >> np.uint64(8), grams.sums))
            self.kinds.append(Sorted(grams.keys >> np.uint64(8)))
            self.discount.append(min(0.95, max(0.3, once / (once + 2 * twice))) if once else 0.5)

    def probabilities(self, keys: list[np.ndarray], longest: np.ndarray) -> np.ndarray:
        """Of the last byte of grams, given the bytes before: keys[n] are their last n bytes, longest how many there are."""
        p = np.full(len(longest), 1 / 256)
        open_ = np.ones(len(longest), bool)
        for order in range(1, ORDER + 1):
            context = keys[order] >> np.uint64(8)
            total = self.total[order - 1](context)
            open_ &= (longest >= order) & (total > 0)
            d = self.discount[order - 1]
            top = np.maximum(self.grams[order - 1](keys[order]) - d, 0) + d * self.kinds[order - 1](context) * p
            p = np.where(open_, top / np.maximum(total, 1e-9), p)
        return p

    def probability(self, context: bytes, byte: bytes) -> float:
        """Of one byte after a context that starts with a word's pad."""
        g = (context + byte)[-ORDER:]
        keys = [np.array([int.from_bytes(g[len(g) - min(n, len(g)) :], "big")], np.uint64) for n in range(ORDER + 1)]
        return float(self.probabilities(keys, np.array([len(g)]))[0])


def differences_by_share(toxic: Counter, ordinary: Counter, texts: tuple[int, int]) -> dict:
    """What a word or pair adds to its difference: the log-ratio of its shares of the toxic and the ordinary texts (of
    which there are `texts`), each discounted by one and backed off to its share of both. What fewer than WORD_TEXTS texts
    hold says nothing."""
    out, (n_toxic, n_ordinary) = {}, texts
    weight = BACKOFF * (n_toxic + n_ordinary)
    for key in toxic.keys() | ordinary.keys():
        t, c = toxic[key], ordinary[key]
        if t + c >= WORD_TEXTS:
            prior = BACKOFF * (t + c)
            out[key] = math.log((max(t - 1, 0) + prior) / (n_toxic + weight)) - math.log((max(c - 1, 0) + prior) / (n_ordinary + weight))
    return out


def beyond(x: np.ndarray | float, margin: float):
    return np.sign(x) * np.maximum(np.abs(x) - margin, 0.0)


class ToxicityModel:
    """Letters, whole words and pairs of words; margins, prior and curve are set by calibrate."""

    def __init__(self, toxic: Counter, ordinary: Counter, words: dict[bytes, float] | None = None, pairs: dict[bytes, float] | None = None):
        shared = toxic + ordinary
        self.models = (KneserNey(toxic, shared), KneserNey(ordinary, shared))
        self.words, self.pairs = words or {}, pairs or {}
        self.margin, self.word_margin, self.prior = 0.0, 0.0, 1
        self.slopes, self.offset = np.ones(3), 0.0
        self._reset()

    def _reset(self) -> None:
        self._known = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0)
        self._whole: tuple[dict, dict, set] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_known": (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0)), "_whole": None}

    def letters(self, words: list[bytes]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word by its letters."""
        g = Grams(words)
        at = g.at(1)
        longest = np.minimum(g.place[at] + 1, ORDER).astype(np.uint64)
        full = g.keys(ORDER, at) & ((np.uint64(1) << longest * np.uint64(8)) - np.uint64(1))
        distinct, inverse = np.unique(full | (longest << np.uint64(56)), return_inverse=True)
        sizes = (distinct >> np.uint64(56)).astype(np.int64)
        keys = [distinct & np.uint64((1 << 8 * n) - 1) for n in range(ORDER + 1)]
        toxic, ordinary = (m.probabilities(keys, sizes) for m in self.models)
        return np.bincount(g.word[at], np.log(toxic / ordinary)[inverse], len(words))

    def _ready(self) -> tuple[dict, dict, set]:
        """Words and pairs that count at the margin chosen."""
        if self._whole is None:
            words, pairs = ({k: float(beyond(v, self.word_margin)) for k, v in d.items() if abs(v) > self.word_margin} for d in (self.words, self.pairs))
            self._whole = words, pairs, {p.split(b" ")[0] for p in pairs}
        return self._whole

    def differences(self, texts: list[bytes | None]) -> np.ndarray:
        """(letters, words, pairs) by length in words, of each text."""
        sums, at, size = np.zeros((len(texts), 4)), 0, 0
        for n, t in enumerate(texts):
            size += len(t or b"")
            if len(t or b"") > 2 * BLOCK_BYTES:
                parts = list(pieces(t.translate(_ALNUM), BLOCK_BYTES))
                sums[at:n] = self._block([(t or b"").translate(_ALNUM) for t in texts[at:n]]) if n > at else 0
                sums[n] = sum(self._block([p])[0] for p in parts)
                seams = [(a.split()[-1:], b.split()[:1]) for a, b in zip(parts, parts[1:])]
                sums[n, 2] += sum(self._ready()[1].get(a[0] + b" " + b[0], 0.0) for a, b in seams if a and b)
                at, size = n + 1, 0
            elif size >= BLOCK_BYTES or n == len(texts) - 1:
                sums[at : n + 1] = self._block([(t or b"").translate(_ALNUM) for t in texts[at : n + 1]])
                at, size = n + 1, 0
        return sums[:, :3] / (sums[:, 3] + self.prior)[:, None]

    def _block(self, texts: list[bytes]) -> np.ndarray:
        """(letters, words, pairs, length) of each text, not normalised."""
        whole, pairs, starts = self._ready()
        joined = b"\n".join(texts)
        hashes, begins, ends = hash_words(joined)
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, side="right")
        order = np.argsort(hashes)
        ordered = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.zeros(0, np.int64)
        keys = ordered[first]
        words = [joined[a:b] for a, b in zip(begins[order[first]].tolist(), ends[order[first]].tolist())]
        group = np.empty(len(order), np.int32)
        group[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(order))))
        letters = self._letters_of(keys, words)
        plain = np.array([whole.get(w, 0.0) for w in words])
        sums = [np.bincount(owner, x[group], len(texts)) if len(group) else np.zeros(len(texts)) for x in (letters, plain)]
        both = np.zeros(len(texts))
        opens = np.array([w in starts for w in words], bool)
        for i in np.flatnonzero(opens[group][:-1]).tolist() if len(group) else ():
            if owner[i] == owner[i + 1]:
                both[owner[i]] += pairs.get(words[group[i]] + b" " + words[group[i + 1]], 0.0)
        return np.stack([*sums, both, np.bincount(owner, minlength=len(texts))], 1)

    def _letters_of(self, keys: np.ndarray, words: list[bytes]) -> np.ndarray:
        """What each word's letters add at the margin chosen; keys: the words' hashes, ascending. Known words are kept as sorted
        arrays (hash, a second hash, value), at most CACHE of them."""
        checks = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        known, known_checks, values = self._known
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        held = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        same = held & (known_checks[at] == checks) if len(known) else held
        out, fresh = np.zeros(len(keys)), np.flatnonzero(~same)
        out[same] = values[at[same]]
        for n in range(0, len(fresh), 20_000):
            part = fresh[n : n + 20_000]
            out[part] = beyond(self.letters([words[i] for i in part.tolist()]), self.margin)
        if len(known) + len(fresh) <= CACHE:  # the words that came first are the common ones, and stay
            add = fresh[~held[fresh]]
            merged = np.concatenate((known, keys[add]))
            by_hash = np.argsort(merged)
            self._known = merged[by_hash], np.concatenate((known_checks, checks[add]))[by_hash], np.concatenate((values, out[add]))[by_hash]
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        z = self.differences(texts) @ self.slopes + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def grid(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[float], list[float], list[float]]]:
        """(words, letters by MARGINS, whole words and pairs by WORD_MARGINS) of each text, not normalised."""
        for t in texts:
            words = words_of(t or b"")
            counts = Counter(words)
            x, c = self.letters(list(counts)) if counts else np.zeros(0), np.fromiter(counts.values(), float, len(counts))
            sums = [[float((beyond(x, m) * c).sum()) for m in MARGINS]]
            for d, keys in ((self.words, words), (self.pairs, [a + b" " + b for a, b in zip(words, words[1:])])):
                v = np.array([d[k] for k in keys if k in d])
                sums.append([float(beyond(v, m).sum()) for m in WORD_MARGINS])
            yield len(words), *sums

    def calibrate(self, rows: list[tuple[int, list[float], list[float], list[float]]], labels: list[int], weights: list[float]) -> None:
        """Picks margins and prior by three-fold cross-validated log loss, and fits the curve there."""
        y, w = np.array(labels, float), np.array(weights)
        size = np.array([r[0] for r in rows], float)
        tables = [np.array([r[k] for r in rows]) for k in (1, 2, 3)]
        part = np.arange(len(y)) % 3
        best = None
        for (a, _), (b, _), prior in itertools.product(enumerate(MARGINS), enumerate(WORD_MARGINS), PRIORS):
            x = np.stack([tables[0][:, a], tables[1][:, b], tables[2][:, b]], 1) / (size + prior)[:, None]
            loss = 0.0
            for k in range(3):
                inside = part != k
                z = np.clip(_curve_values(x[~inside], *_curve(x[inside], y[inside], w[inside])), -30, 30)
                loss += float((w[~inside] * (np.log1p(np.exp(z)) - y[~inside] * z)).sum())
            if best is None or loss < best[0] - 1e-12:
                best = loss, MARGINS[a], WORD_MARGINS[b], prior, x
        _, self.margin, self.word_margin, self.prior, x = best
        self.slopes, self.offset = _curve(x, y, w)
        self._reset()


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """(slopes, offset) of a weighted logistic regression, by Newton's method with a small ridge. Slopes aren't negative,
    as a difference that favours a class can't speak against it: a column that would have one is left out."""
    spread = x.std(axis=0)
    use = np.flatnonzero(spread > 1e-4)
    while True:
        a = np.concatenate((x[:, use] / spread[use], np.ones((len(x), 1))), axis=1)
        beta = np.zeros(a.shape[1])
        beta[-1] = math.log(max(1e-9, (w * y).sum()) / max(1e-9, (w * (1 - y)).sum()))
        ridge = np.diag([1e-3] * len(use) + [1e-6]) * w.sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (y - p)) - ridge @ beta)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-7:
                break
        if not len(use) or beta[:-1].min() >= 0:
            slopes = np.zeros(x.shape[1])
            slopes[use] = beta[:-1] / spread[use]
            return slopes, float(beta[-1])
        use = np.delete(use, beta[:-1].argmin())


def _curve_values(x: np.ndarray, slopes: np.ndarray, offset: float) -> np.ndarray:
    return x @ slopes + offset


def sampled_rows(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str, text: str, label: str, sample: int) -> tuple[DataFrame | None, dict[int, int]]:
    """((t, y, held) of the training rows, labelled ids of each class). The rows are chosen by slim keys, at most `sample` of
    a class; a top-k per class keeps that many rows of each task, so the larger class never meets in one."""
    known = labels.where(learn & column(label).isin(0, 1) & column(doc_id).isNotNull())
    known = known.groupBy(column(doc_id).alias("id")).agg(F.max(column(label)).cast("int").alias("y")).withColumn("h", F.xxhash64("id"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = [known.where(F.col("y") == y).orderBy("h", "id").limit(sample) for y in (0, 1)]
    texts = docs.select(column(doc_id).alias("id"), column(text).alias("t")).withColumn("key", F.xxhash64("t"))
    keys = texts.drop("t").join(F.broadcast(ids[0].unionByName(ids[1])), "id").distinct()  # at most 2 * sample ids
    chosen = []
    for y in (0, 1):
        rows = keys.where(F.col("y") == y).orderBy("h", "id", "key").limit(sample).collect()
        chosen += [(r["id"], r["key"], y, n % 5 == 4) for n, r in enumerate(rows)]
    if not chosen:
        return None, counts
    kind = T.StructType([T.StructField("id", known.schema["id"].dataType), *T.StructType.fromDDL("key long, y int, held boolean").fields])
    picked = docs.sparkSession.createDataFrame(chosen, kind)
    return texts.join(F.broadcast(picked), ["id", "key"]).select("t", "y", "held"), counts


def counted(rows: DataFrame) -> tuple[list, list, dict]:
    """((word, y, held, occurrences, texts), the same of pairs in WORD_TEXTS texts or more, texts by (y, held)).
    As many words as `sample` texts hold reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                seen: dict = {}
                for t, y, held in zip(text_bytes(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = words_of(t or b"")
                    for kind, counts in ((0, Counter(words)), (1, Counter(a + b" " + b for a, b in zip(words, words[1:]))), (2, Counter([b""]))):
                        for k, c in counts.items():
                            got = seen.setdefault((kind, k, y, held), [0, 0])
                            got[0] += c
                            got[1] += 1
                keys, sums = zip(*seen) if seen else ((),) * 4, zip(*seen.values()) if seen else ((),) * 2
                arrays = [pa.array(c, k) for c, k in zip([*keys, *sums], (pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "k", "y", "held", "c", "n"])

    found = rows.mapInArrow(run, "kind int, k binary, y int, held boolean, c long, n long")
    found = materialize(found.groupBy("kind", "k", "y", "held").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "counts")
    several = found.where("kind = 1").groupBy("k").agg(F.collect_list(F.struct("y", "held", "n")).alias("g"), F.sum("n").alias("n"))
    pairs = several.where(F.col("n") >= WORD_TEXTS).select("k", F.inline("g"))
    found = materialize(found.where("kind <> 1").unionByName(pairs.selectExpr("1 as kind", "k", "y", "held", "0L as c", "n")), "counts")
    rows = [found.where(F.col("kind") == kind).select("k", "y", "held", "c", "n").toArrow().to_pydict() for kind in range(3)]
    words, several = (sorted(zip(*r.values())) for r in rows[:2])
    return words, several, {(y, held): n for _, y, held, _, n in zip(*rows[2].values())}


def fit(rows: DataFrame | None, counts: dict[int, int], sample: int = SAMPLE) -> ToxicityModel | None:
    """A model of training rows (t, y, held); counts: labelled rows of each class in the corpus."""
    if rows is None:
        return None
    words, pairs, texts = counted(rows)

    def shares(found: list, all_texts: bool) -> dict:
        per: tuple[Counter, Counter] = (Counter(), Counter())
        for k, y, held, *_, n in found:
            if all_texts or not held:
                per[y][k] += n
        seen = [sum(n for (y, held), n in texts.items() if y == label and (all_texts or not held)) for label in (1, 0)]
        return differences_by_share(per[1], per[0], tuple(seen))

    own: tuple[Counter, Counter] = (Counter(), Counter())
    for k, y, held, c, _ in words:
        if not held:
            own[y][k] += c
    if not own[0] or not own[1] or not all(texts.get((y, True)) for y in (0, 1)):
        return None
    model = ToxicityModel(own[1], own[0], shares(words, False), shares(pairs, False))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = zip(*shared.value.grid(list(text_bytes(part.column(0)))))
                kinds = (pa.int64(), *[pa.list_(pa.float64())] * 3)
                arrays = [part.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)], part.column(2)]
                yield pa.RecordBatch.from_arrays(arrays, names=["y", "size", "letters", "words", "pairs", "h"])

    kind = "y int, size long, letters array<double>, words array<double>, pairs array<double>, h long"
    held = rows.where("held").select("t", "y", F.xxhash64("t").alias("h")).mapInArrow(run, kind).distinct()
    held = held.orderBy("h", "y", "size").limit(2 * sample).collect()
    taken = Counter(r["y"] for r in held)
    if len(taken) == 2:
        weights = [counts[r["y"]] / taken[r["y"]] / sum(counts.values()) for r in held]
        model.calibrate([(r["size"], r["letters"], r["words"], r["pairs"]) for r in held], [r["y"] for r in held], weights)
    # With the curve fitted, the calibration texts' words count too: a rare language has no texts to spare.
    model.words, model.pairs = shares(words, True), shares(pairs, True)
    model._reset()
    return model


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    out: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns `keep`) with the column `out`; learns from the labels for which `learn` (of the labels' columns) holds."""
    model = fit(*sampled_rows(docs, labels, learn, doc_id, text, label, sample), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = others(docs, [out], keep)
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])
    frame, places = carried(docs, text, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                scores = np.zeros(part.num_rows) if model is None else model.scores(list(text_bytes(part.column(0))))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + [pa.array(scores, pa.float64())], names=schema.fieldNames())

    return frame.mapInArrow(run, schema)
