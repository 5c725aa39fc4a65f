"""Language ID: a byte convolutional network, trained in numpy on labelled text.

The network reads windows of WINDOW bytes of the lower-cased (A-Z) UTF-8 text. Filters of several widths slide over
the bytes; a filter is a table of a weight per offset and byte, so a convolution is a sum of looked-up rows. Each
filter is max-pooled over the window, rectified, and a softmax layer maps the pooled values to languages. A text's
probabilities are the mean of its windows' weighted by their bytes; consecutive windows overlap by the widest filter
less one, so every position of a whole text is seen, once.

Training rows: at most SAMPLE_PER_LANG documents of each of the MAX_LANGS languages with the most rows, first by hash;
of each a piece of PIECE characters at a hashed position anywhere in the text. That sample is bounded by these three
parameters and taken without a window: counts by language, a hash threshold for each, and a cut of the few rows left.
Prediction covers all rows and whole texts.
Inference is a scan and a batched map, without a shuffle. Memory: a slice of texts (4 MB or one text) and blocks of
windows.

Null text, or text without a letter, is `und` with score 0. An empty table, or one without labelled rows, gives `und`
everywhere. Repeated rows are predicted one by one (in training, rows of one id and piece are one); ties go to the
language first in code point order. Extra columns stay; one named like an output, in whatever case, is replaced by it.
Ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, column, giving_back, others, slices, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_PER_LANG = 600
MAX_LANGS = 64
PIECE = 2 * WINDOW
UNKNOWN = "und"
BLOCK = 64
_STEP = WINDOW - max(WIDTHS) + 1


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, owner, bytes) over all texts; shorter ones are padded with zero bytes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    per = np.maximum(1, -(-(lengths - (WINDOW - _STEP)) // _STEP))
    owner = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    joined = np.frombuffer(b"".join(t + bytes(WINDOW) for t in texts), np.uint8)
    starts = np.repeat(np.cumsum(lengths + WINDOW) - lengths - WINDOW, per) + nth * _STEP
    windows = np.lib.stride_tricks.sliding_window_view(joined, WINDOW)[starts]
    sizes = np.clip(lengths[owner] - nth * _STEP, 0, WINDOW)
    windows = np.where(np.arange(WINDOW) < sizes[:, None], windows, 0).astype(np.uint8)
    return windows, owner, np.maximum(sizes, 1)


class ByteConvNet:
    def __init__(self, langs: list[str], filters: int = FILTERS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.3, (len(WIDTHS) * filters, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.tables, self.dense, self.bias]

    def _convolve(self, windows: np.ndarray, table: np.ndarray) -> np.ndarray:
        width, length = len(table), windows.shape[1] - len(table) + 1
        total = table[0][windows[:, :length]]
        for k in range(1, width):
            total += table[k][windows[:, k : k + length]]
        return total

    def _pairs(self) -> list[list[np.ndarray]]:
        """For each width, tables of the sums of two neighbouring offsets: half as many lookups."""
        return [
            [(t[k][:, None] + t[k + 1][None]).reshape(65536, -1) if k + 1 < len(t) else t[k] for k in range(0, len(t), 2)]
            for t in self.tables
        ]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pairs = getattr(self, "_cached", None) or self._pairs()
        self._cached = pairs
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for at in range(0, len(windows), BLOCK):
            block = windows[at : at + BLOCK].astype(np.int32)
            double = (block[:, :-1] << 8) | block[:, 1:]
            pooled = []
            for width, tables in zip(WIDTHS, pairs):
                length = WINDOW - width + 1
                total = np.take(tables[0], double[:, :length], axis=0)
                for j, t in enumerate(tables[1:], 1):
                    index = double if t.shape[0] == 65536 else block
                    total += np.take(t, index[:, 2 * j : 2 * j + length], axis=0)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            out[at : at + BLOCK] = _softmax(hidden @ self.dense + self.bias)
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 10, rate: float = 0.02, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), 64):
                rows = order[at : at + 64]
                x, y = windows[rows], labels[rows]
                pooled, places = [], []
                for t in self.tables:
                    total = self._convolve(x, t)
                    best = total.argmax(axis=1)
                    places.append(best)
                    pooled.append(np.take_along_axis(total, best[:, None], axis=1)[:, 0])
                raw = np.concatenate(pooled, axis=1)
                hidden = np.maximum(raw, 0)
                error = _softmax(hidden @ self.dense + self.bias)
                error[np.arange(len(y)), y] -= 1
                error /= len(y)
                back = (error @ self.dense.T) * (raw > 0)
                grads = []
                for n, (t, best) in enumerate(zip(self.tables, places)):
                    g, part = np.zeros_like(t), back[:, n * t.shape[2] : (n + 1) * t.shape[2]]
                    for k in range(len(t)):
                        np.add.at(g[k], (np.take_along_axis(x, best + k, axis=1), np.arange(t.shape[2])), part)
                    grads.append(g)
                grads += [hidden.T @ error + 1e-4 * self.dense, error.sum(axis=0)]
                step += 1
                for p, g, (m, v) in zip(self.params(), grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self._cached = None

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, its probability) of each text."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0)
        windows, owner, sizes = windows_of([t.lower() for t in texts])
        weighted = self.probabilities(windows) * sizes[:, None]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        total = np.add.reduceat(weighted, first, axis=0, dtype=np.float64)
        mean = total / np.add.reduceat(sizes, first)[:, None]
        best = mean.argmax(axis=1)
        return best, np.clip(mean[np.arange(len(best)), best], 0, 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_sample(docs: DataFrame, learn: Column, doc_id: str, text: str, lang: str, per_lang: int, max_langs: int) -> list[tuple[str, str]]:
    """(language, piece), in hash order within a language. A language's rows pass if their hash lies under a threshold that
    lets somewhat more than per_lang through; these, a bounded number, are cut on the driver."""
    known = docs.select(column(lang).alias("lang"), column(text).alias("t"), column(doc_id).alias("id"), learn.alias("learn"))
    known = known.where("learn and lang is not null and t is not null").where(F.col("t").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not counts:
        return []
    share = {r["lang"]: min(1.0, (per_lang + 6 * per_lang**0.5 + 20) / r["n"]) for r in counts}
    names, shares = F.array(*map(F.lit, share)), F.array(*map(F.lit, share.values()))
    under = F.coalesce(F.get(shares, (F.array_position(names, F.col("lang")) - 1).cast("int")), F.lit(0.0))
    piece = F.expr(f"substring(t, cast(pmod(xxhash64(1, id), greatest(char_length(t) - {WINDOW}, 1)) as int) + 1, {PIECE})")
    hashed = known.withColumn("h", F.xxhash64(F.lit(2), F.col("id")))
    few = hashed.where(F.pmod("h", F.lit(1 << 30)) < under * (1 << 30)).select("lang", "h", piece.alias("piece"))
    few = few.where(F.col("piece").rlike(r"\p{L}")).groupBy("lang", "h").agg(F.min("piece").alias("piece"))  # a repeated id is one
    taken: dict[str, int] = {}
    out = []
    for r in sorted(few.collect(), key=lambda r: (r["lang"], r["h"] % (1 << 30), r["h"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_lang:
            out.append((r["lang"], r["piece"]))
    return out


def fit(rows: list[tuple[str, str]]) -> ByteConvNet | None:
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    net = ByteConvNet(langs)
    windows, owner, sizes = windows_of([piece.encode().lower() for _, piece in rows])
    labels = np.array([langs.index(lang) for lang, _ in rows])[owner]
    keep = (sizes >= WINDOW // 2) | (np.diff(owner, prepend=-1) > 0)
    net.train(windows[keep], labels[keep])
    return net


def detect(
    docs: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    train_docs: DataFrame | None = None,
    per_lang: int = SAMPLE_PER_LANG,
    max_langs: int = MAX_LANGS,
    pred: str = "lang_pred",
    score: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns `keep`) with the columns `pred` and `score`; learns from the rows of train_docs (or docs) for
    which `learn` holds."""
    net = fit(training_sample(docs if train_docs is None else train_docs, learn, doc_id, text, lang, per_lang, max_langs))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    fields = others(docs, [pred, score], keep)
    schema = T.StructType([*fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    frame, places = carried(docs, text, fields, F.coalesce(column(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                rows = [i for i, x in enumerate(part.column(part.num_columns - 1).to_pylist()) if x and model is not None]
                if rows:
                    best, value = model.predict(list(text_bytes(part.column(0).take(pa.array(rows)))))
                    for i, b in zip(rows, best):
                        names[i] = model.langs[b]
                    scores[rows] = value
                arrays = [part.column(i) for i in places] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return frame.mapInArrow(giving_back(run), schema)
