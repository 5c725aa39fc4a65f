"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the distinct shingles of SHINGLE consecutive words (runs of `[^\\x20\\x09-\\x0D]`, A-Z
lower-cased); with fewer words, the whole sequence as one; without words, nothing. Two documents link when
100 * |intersection| >= percent * |union|. The operator gives each document its set size and the least doc_id that it
reaches by links.

1. Documents with equal sets form a class (one aggregation on a 128-bit set hash, partly done before the shuffle, so
   thousands of copies cost one row a task). All else runs on classes.
2. Shingles are ordered rare first: by how common their words are, from the WORDS most frequent words; the FREQUENT
   most frequent shingles, counted within tasks and merged, come last; then by hash. Any fixed order gives exact
   results; only the cost depends on it.
3. A class's prefix is so long that linked classes share a prefix shingle. Prefix shingles of one class only are dropped
   after counting; what is left, the index, is small. The FREQUENT shingles aren't counted by one key each in one task:
   they are known to be shared, and their buckets' sizes are summed within tasks first.
4. A bucket holds the classes that share a prefix shingle. In buckets of at most SMALL classes all pairs are formed,
   made distinct, and held against what their whole prefixes allow; few but true near copies pass. They are verified once
   each: length and suffix filters, then the exact intersection.
5. In larger buckets all members are paired with one pivot, the class with the fewest shingles of its own in its prefix:
   the centre of a group of near copies. Pairs in one component already are skipped, the others pass the length and
   positional filters and are verified. So a group of g near copies costs g pairs, not g * g. A second round takes the
   best pivot outside the first's component.
6. What is then left to do exactly: members of one bucket that are in different components. They alone are joined, under
   the same filters, and verified. Pairs within one component can't change the result.

No bucket meets in one task. What a bucket's members must know of it (its size, its pivot) is one row per bucket, summed
within tasks first; for the HOT largest buckets these rows are broadcast, so their members stay where they are, and every
other bucket holds at most 1/HOT of the index. In step 6 the members of the largest buckets are salted.

Components are found by alternating large-star and small-star rounds over edge tables in the shared folder. Sets of
index classes only are kept, 6 bytes a shingle (48 of the 64 hash bits).

Null or empty texts have n_shingles 0 and are their own component; rows with equal id and text are one class. A
null doc_id takes the least other id of its component, or null. An empty table gives an empty result. Extra columns are
ignored by near_duplicates and kept by one_of_each. Ids must be integers; others raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, columns_of, discard, giving_back, hash_texts, integer_id, materialize, mix64, slices, text_bytes

SHINGLE = 4
PERCENT = 85
#: Shingles and words that the rare-first order knows by frequency: 16 bytes each in a broadcast.
FREQUENT = 200_000
WORDS = 65_536
#: Class ids up to which they are broadcast to pick the texts whose sets are kept; beyond it, a join does it.
BROADCAST_IDS = 2_000_000
#: Pairs up to which they are broadcast to the sets to be verified: 16 bytes each.
BROADCAST_PAIRS = 1_000_000
#: Classes in a bucket up to which all its pairs are formed, so at most SMALL - 1 for a row of the index; larger buckets
#: take the way over pivots.
SMALL = 16
#: Buckets, the largest first, whose row is broadcast: at most some 100 bytes each. And salts of their members in step 6.
HOT = 50_000
SALTS = 16
_LOCAL = 1_500_000
_FREQUENT_RANK = 1000
_NO_BUCKET = 1 << 62
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE, words: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, their commonness by words) of each text. The latter sums the levels of a shingle's
    words in the table `words` (hashes, ascending; level), 0 for words that it lacks."""
    factors = [mix64(np.arange(1, k + 1, dtype=np.uint64))[i] | np.uint64(1) for i in range(k)]
    for _, parts in hash_texts([(t or b"").lower() for t in texts]):
        for h in parts:
            if len(h) >= k:
                n = len(h) - k + 1
                s = h[:n] * factors[0]
                for i in range(1, k):
                    s = s + h[i : n + i] * factors[i]
                s, first = np.unique(mix64(s), return_index=True)
                level = _looked_up(h, words)
                yield s, sum(level[i : n + i] for i in range(k))[first]
            elif len(h):
                one = mix64(np.array([sum(int(x) * int(f) for x, f in zip(h, factors)) % (1 << 64)], np.uint64) ^ np.uint64(len(h)))
                yield one, np.zeros(1, np.int64)
            else:
                yield h, np.zeros(0, np.int64)


def _looked_up(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    if known is None or not len(known[0]):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
    return np.where(known[0][at] == keys, known[1][at], 0)


def needed(n_a: int, n_b: int, percent: int) -> int:
    """The least intersection with which sets of these sizes link."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def prefix_length(n: np.ndarray | int, percent: int):
    return n - -(-percent * n // 100) + 1


def frequencies(docs: DataFrame, text: str, k: int, shingles: int, words: int):
    """((frequent shingles, level), (frequent words, level)), hashes ascending and levels as logarithms of counts. A task
    counts over runs of _LOCAL shingles and gives those that a run has twice or more, and words found 8 times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heard, size = [], [], 0

        def flush():
            out = []
            for kind, parts, least in ((0, held, 2), (1, heard, 8)):
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                many = counts >= least
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(many.sum(), kind, np.int32)), pa.array(values[many].view(np.int64)), pa.array(counts[many])], names=["kind", "s", "c"]))
            return out

        for batch in batches:
            for part in slices(batch):
                texts = [(t or b"").lower() for t in text_bytes(part.column(0))]
                for _, hashes in hash_texts(texts):
                    heard += hashes
                for s, _ in shingle_sets(texts, k):
                    held.append(s)
                    size += len(s)
                if size >= _LOCAL:
                    yield from flush()
                    held, heard, size = [], [], 0
        if held:
            yield from flush()

    counted = docs.select(column(text)).mapInArrow(giving_back(count), "kind int, s long, c long").groupBy("kind", "s").agg(F.sum("c").alias("c"))
    counted = materialize(counted, "frequencies")
    # The most frequent ones by a histogram of counts (sixteen bins a power of two), so that no more rows than asked for reach
    # the driver; the bin that would go beyond is left out.
    bin_ = F.floor(F.log2("c") * 16).cast("int")
    heights: dict[int, list[tuple[int, int]]] = {0: [], 1: []}
    for r in counted.groupBy("kind", bin_.alias("bin")).agg(F.count("*").alias("n")).collect():
        heights[r["kind"]].append((r["bin"], r["n"]))
    out = []
    for kind, most in ((0, shingles), (1, words)):
        least, taken = 1 << 30, 0
        for at, n in sorted(heights[kind], reverse=True):
            taken += n
            if taken > most:
                break
            least = at
        rows = counted.where((F.col("kind") == kind) & (bin_ >= least)).select("s", "c").toArrow()
        keys = rows["s"].to_numpy().view(np.uint64)
        levels = np.log2(rows["c"].to_numpy().astype(np.float64)).astype(np.int64)
        order = np.argsort(keys)
        out.append((keys[order], levels[order]))
    return tuple(out)


def _rank(s: np.ndarray, common: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rare-first rank: by commonness of words, and the shingles known as frequent after all others."""
    level = _looked_up(s, known)
    return np.where(level > 0, _FREQUENT_RANK + level, common)


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mix64(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (0x5BD1E995, 0xC2B2AE3D27D4EB4F))


def _text_key(text: str) -> list[Column]:
    """96 bits of a text; with doc_id, the key of a row."""
    return [F.xxhash64(column(text)).alias("text_a"), F.hash(column(text)).alias("text_b")]


def document_sets(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, shared) -> DataFrame:
    """(doc_id, text_a, text_b, n, sig_a, sig_b, last_f, last_h, rare, prefix): the text's hashes, prefix in rare-first order, how
    many of it come before the frequent shingles, and the rank of its last shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = shared.value
        for batch in batches:
            for part in slices(batch, "t"):
                sizes, one, two, prefixes, last_f, last_h, rare = ([] for _ in range(7))
                for s, common in shingle_sets(list(text_bytes(part.column("t"))), k, words):
                    a, b = _signature(s)
                    sizes.append(len(s))
                    one.append(a)
                    two.append(b)
                    f = _rank(s, common, known)
                    order = np.lexsort((s, f))[: prefix_length(len(s), percent)] if len(s) else np.zeros(0, np.int64)
                    prefixes.append(s[order].view(np.int64))
                    rare.append(int((f[order] < _FREQUENT_RANK).sum()))
                    last_f.append(int(f[order[-1]]) if len(s) else 0)
                    last_h.append(int((s[order[-1]] ^ np.uint64(1 << 63)).view(np.int64)) if len(s) else 0)
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64()))
                arrays = [*(part.column(c) for c in ("id", "text_a", "text_b")), pa.array(sizes, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(last_f, pa.int64()), pa.array(last_h, pa.int64()), pa.array(rare, pa.int32()), flat]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_a", "text_b", "n", "sig_a", "sig_b", "last_f", "last_h", "rare", "prefix"])

    source = docs.select(integer_id(docs, doc_id).alias("id"), column(text).alias("t"), *_text_key(text))
    return source.mapInArrow(giving_back(run), "doc_id long, text_a long, text_b int, n int, sig_a long, sig_b long, last_f long, last_h long, rare int, prefix array<long>")


def wanted_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(cls, s): the sets of the wanted classes (cls, doc_id, sig_a, sig_b), a row for each document with that id and set."""
    spark = docs.sparkSession
    source = docs.select(integer_id(docs, doc_id).alias("id"), column(text).alias("t"))
    few = wanted.count() <= BROADCAST_IDS
    if few:
        rows = wanted.select("cls", "doc_id", "sig_a", "sig_b").toArrow()
        order = np.lexsort((rows["sig_b"].to_numpy(), rows["sig_a"].to_numpy()))
        table = [rows[c].to_numpy()[order] for c in ("sig_a", "sig_b", "cls")]
        shared = spark.sparkContext.broadcast((np.unique(rows["doc_id"].drop_null().to_numpy()), *table))
    else:
        shared = None
        ids = wanted.select(F.col("doc_id").alias("id")).distinct()
        source = source.join(ids.hint("shuffle_hash"), "id", "left_semi").unionByName(source.where("id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                ids, sig_a, sig_b, cls = shared.value
                row_ids = batch.column("id")
                batch = batch.filter(pa.compute.or_(pa.compute.is_null(row_ids), pa.compute.is_in(row_ids, value_set=pa.array(ids))))
            for part in slices(batch, "t"):
                found = []
                for s, _ in shingle_sets(list(text_bytes(part.column("t"))), k):
                    a, b = _signature(s)
                    at = -1
                    if shared is not None:
                        at = int(np.searchsorted(sig_a, a))
                        while at < len(sig_a) and sig_a[at] == a and sig_b[at] != b:
                            at += 1
                        if at == len(sig_a) or sig_a[at] != a:
                            continue
                    low = (s & _LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    found.append((int(cls[at]) if at >= 0 else None, a, b, low))
                columns = zip(*found) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.binary(),))], names=["cls", "sig_a", "sig_b", "s"])

    sets = source.mapInArrow(giving_back(run), "cls long, sig_a long, sig_b long, s binary")
    if few:
        return sets.select("cls", "s")
    return sets.drop("cls").join(wanted.select("cls", "sig_a", "sig_b"), ["sig_a", "sig_b"]).select("cls", "s")


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets link. The suffix filter splits both by a middle shingle's hash: what
    the halves could share at most must reach the bound before they are intersected."""
    need = needed(len(a), len(b), percent)
    if min(len(a), len(b)) < need:
        return False
    if len(a) > 16:
        pivot = np.partition(a, len(a) // 2)[len(a) // 2]
        left_a, left_b = int((a < pivot).sum()), int((b < pivot).sum())
        if min(left_a, left_b) + min(len(a) - left_a, len(b) - left_b) < need:
            return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of distinct pairs (a, b) of classes, a written table. Pairs that are few are broadcast to the sets, so only
    the pairs' own sets move; otherwise both meet by class."""
    if pairs.count() <= BROADCAST_PAIRS:
        few = F.broadcast(pairs)
        one = few.join(sets.withColumnsRenamed({"cls": "a", "s": "s_a"}), "a")
        two = few.join(sets.withColumnsRenamed({"cls": "b", "s": "s_b"}), "b")
        both = one.join(two.hint("shuffle_hash"), ["a", "b"]).select("a", "b", "s_a", "s_b")
    else:
        one = pairs.join(sets.withColumnsRenamed({"cls": "b", "s": "s_b"}), "b")
        both = one.join(sets.withColumnsRenamed({"cls": "a", "s": "s_a"}), "a").select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("s_a", "s_b"))
            keep = pa.array([links(unpack48(p), unpack48(q), percent) for p, q in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(giving_back(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of the component. Alternates large-star and small-star rounds until the
    edge table, then stars around the least nodes, no longer changes."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "edges")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(edges)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")


def _possible(p: int):
    """The length and positional filters on columns n, pos (0-based) of both sides of a common prefix shingle."""
    return F.expr(
        f"100 * least(n_a, n_b) >= {p} * greatest(n_a, n_b)"
        f" and (1 + least(n_a - pos_a, n_b - pos_b) - 1) * {100 + p} >= {p} * (n_a + n_b)"
    )


def _with_labels(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return index.withColumn("label", F.col("cls"))
    return index.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _of_bucket(index: DataFrame, rows: DataFrame) -> DataFrame:
    """index with a table of a row per bucket (token, hot, ..); both have the column hot."""
    hot = index.where("hot").join(F.broadcast(rows.where("hot").drop("hot")), "token")  # HOT rows at most
    return hot.unionByName(index.where("not hot").join(rows.where("not hot").drop("hot"), "token"))


def _index(full: DataFrame) -> DataFrame:
    """(token, cls, pos, g, hot): the prefix shingles that several classes have, with their number. A shingle that isn't
    frequent has few classes, and they meet in a window; those of the frequent ones stay where they are."""
    entries = full.select("cls", "rare", F.posexplode("prefix").alias("pos", "token")).select("token", "cls", "pos", (F.col("pos") >= F.col("rare")).alias("frequent"))
    alone = entries.where("not frequent").drop("frequent").withColumn("g", F.count("*").over(Window.partitionBy("token"))).where("g > 1")
    common = materialize(entries.where("frequent").drop("frequent"), "common")
    sizes = materialize(common.groupBy("token").agg(F.count("*").alias("g")).where("g > 1"), "sizes")
    hot = F.broadcast(sizes.where(F.col("g") > SMALL).orderBy(F.desc("g"), "token").limit(HOT).withColumnRenamed("g", "hot_g"))
    marked = common.join(hot, "token", "left")
    rest = marked.where("hot_g is null").drop("hot_g").join(sizes, "token").withColumn("hot", F.lit(False))
    return (
        marked.where("hot_g is not null").withColumnRenamed("hot_g", "g").withColumn("hot", F.lit(True))
        .unionByName(rest)
        .unionByName(alone.withColumn("hot", F.lit(False)))
    )


def _small_pairs(index: DataFrame, percent: int, most: int) -> DataFrame:
    """Distinct pairs that share a prefix shingle of a bucket of at most `most` classes, as far as their prefixes allow a
    link. Of the prefix that ends first in the shingle order, every shingle that the other prefix lacks is missing from the
    other set, so the intersection is at most the set less those. Shared shingles of larger buckets count as common."""
    small = index.where(F.col("g") <= most)
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "big", "last_f", "last_h")]
    both = small.select("token", *side("a")).join(small.select("token", *side("b")), "token").where("cls_a < cls_b")
    both = both.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    per = both.groupBy("cls_a", "cls_b").agg(
        F.count("*").alias("c"), *[F.first(f"{c}_{s}").alias(f"{c}_{s}") for c in ("n", "big", "last_f", "last_h") for s in "ab"]
    )
    missing = lambda s: f"(n_{s} - ceil({percent} * n_{s} / 100) + 1 - c - least(big_a, big_b))"
    first = "(last_f_a < last_f_b or (last_f_a = last_f_b and last_h_a <= last_h_b))"
    most = f"least(n_a, n_b, if({first}, n_a - {missing('a')}, n_b - {missing('b')}))"
    return per.where(f"{most} * {100 + percent} >= {percent} * (n_a + n_b)").select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))


def _star(index: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of each bucket's members with the bucket's pivot among the members outside `seen` components."""
    pivot = index.groupBy("token", "hot").agg(
        F.min(F.when(~F.col("seen"), F.struct("own", "cls", "n", "pos", "label"))).alias("p"),
        F.min("label").alias("lo"),
        F.max("label").alias("hi"),
    ).where("p is not null and lo <> hi")
    both = _of_bucket(index, pivot).where("label <> p.label").select(
        F.col("cls").alias("x"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"),
        F.col("p.cls").alias("y"), F.col("p.n").alias("n_b"), F.col("p.pos").alias("pos_b"),
    )
    return both.where(_possible(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rest(index: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of members of one bucket that are in different components. In a bucket, the members outside the
    component of its pivot are joined with all others, so a bucket's one large component isn't paired with itself."""
    stats = index.groupBy("token", "hot").agg(
        F.min(F.struct("own", "cls", "label")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least_n")
    ).where("lo <> hi").select("token", "hot", F.col("p.label").alias("main"), "least_n")
    mixed = _of_bucket(index, stats).withColumn("outside", F.col("label") != F.col("main"))
    # An outside member that no partner of the bucket's sizes could pass the positional filter with needs no pairs.
    able = F.expr(f"(n - pos) * {100 + percent} >= {percent} * (n + greatest(least_n, {percent} * n div 100))")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "pos", "label", "outside")]
    mixed = mixed.where(able)
    # Members of the largest buckets are dealt by salt, and the outside ones of these copied to every salt.
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = mixed.where("outside").select("token", F.explode(salts).alias("salt"), *side("a"))
    right = mixed.select("token", F.when(F.col("hot"), F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"), *side("b"))
    pairs = left.join(right, ["token", "salt"]).where("label_a <> label_b and (not outside_b or cls_a < cls_b)").where(_possible(percent))
    return pairs.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **given) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs."""
    members, of_class = labelled_classes(docs, doc_id, text, **given)
    least = of_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(least, "label").select("sig_a", "sig_b", F.col("n").alias("n_set"), "component_id")
    joined = members.join(of_class, (members.sig_a == of_class.sig_a) & (members.sig_b == of_class.sig_b) & (members.n == of_class.n_set), "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _prepared(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, frequent: int, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, index): a row per row of docs, per class with its least doc_id, and per shared prefix shingle of a
    class; buckets of more than `small` classes count as large."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, text, k, frequent, WORDS))
    sets = materialize(document_sets(docs, doc_id, text, k, percent, shared), "sets")
    same = [F.first(c).alias(c) for c in ("last_f", "last_h", "rare", "prefix")]
    classes = sets.where("n > 0").groupBy("sig_a", "sig_b", "n").agg(F.min("doc_id").alias("doc_id"), *same)
    full = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = materialize(sets.select("doc_id", "text_a", "text_b", "n", "sig_a", "sig_b"), "members")
    classes = materialize(full.drop("prefix", "rare"), "classes")
    discard(sets)
    index = materialize(_index(full), "index")
    discard(full)
    # big: a class's prefix shingles in large buckets; own: those that no other class has in its prefix.
    per = index.groupBy("cls").agg(F.count_if(F.col("g") > small).alias("big"), F.count("*").alias("common")).join(classes.select("cls", "n", "last_f", "last_h"), "cls")
    per = per.withColumn("own", (F.expr(f"n - ceil({percent} * n / 100) + 1") - F.col("common")).cast("int")).drop("common")
    return members, classes, materialize(index.join(per, "cls"), "index")


def _sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(cls, s) of the classes in ids (cls)."""
    wanted = materialize(classes.join(ids.distinct(), "cls", "left_semi").select("cls", "doc_id", "sig_a", "sig_b"), "wanted")
    return materialize(wanted_sets(docs, wanted, doc_id, text, k).groupBy("cls").agg(F.first("s").alias("s")), "kept")


def labelled_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = SHINGLE,
    percent: int = PERCENT,
    frequent: int = FREQUENT,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_a, text_b, n, sig_a, sig_b), a row per row of docs, and (sig_a, sig_b, n, doc_id, label), a row per
    class with its least doc_id; classes of one component have one label. Rows without shingles have no class."""
    members, classes, index = _prepared(docs, doc_id, text, k, percent, frequent, SMALL)
    small = materialize(_small_pairs(index, percent, SMALL), "pairs")
    large = materialize(index.where(F.col("g") > SMALL).select("token", "hot", "cls", "n", "pos", "own"), "large")
    ids = small.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(large.select("cls"))
    kept = _sets_of(docs, classes, ids, doc_id, text, k)
    edges = materialize(verify(small, kept, percent), "links")
    labels = materialize(components(edges), "labels")
    some = large.limit(1).count() > 0
    for step in range(3 if some else 0):
        labelled = _with_labels(large, labels)
        if step == 0:
            pairs = _star(labelled.withColumn("seen", F.lit(False)), percent)
        elif step == 1:
            main = labelled.groupBy("token", "hot").agg(F.min(F.struct("own", "cls", "label")).alias("p")).select("token", "hot", F.col("p.label").alias("main"))
            pairs = _star(_of_bucket(labelled, main).withColumn("seen", F.col("label") == F.col("main")), percent)
        else:
            pairs = _rest(labelled, percent)
        edges = edges.unionByName(materialize(verify(materialize(pairs, "pairs"), kept, percent), "links"))
        labels = materialize(components(edges), "labels")

    of_class = classes.select("cls", "sig_a", "sig_b", "n", "doc_id").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    return members, of_class.select("sig_a", "sig_b", "n", "doc_id", F.coalesce("label", "cls").alias("label"))


def class_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cls), a row per row of docs (cls null without shingles), and (a, b), a < b, all pairs of classes
    that link. Nothing is skipped here, so a group of g different near copies costs its g * g pairs; near_duplicates, which needs
    components only, costs g."""
    members, classes, index = _prepared(docs, doc_id, text, k, percent, frequent, _NO_BUCKET)
    pairs = materialize(_small_pairs(index, percent, _NO_BUCKET), "pairs")
    kept = _sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")), doc_id, text, k)
    links = materialize(verify(pairs, kept, percent), "links")
    joined = members.join(classes.select("sig_a", "sig_b", F.col("n").alias("n_set"), "cls"), ["sig_a", "sig_b"], "left").where("n_set is null or n = n_set")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "cls"), links


def link_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **given) -> DataFrame:
    """(doc_id, n_shingles, n_links), a row per row of docs: how many other rows it links with, copies included."""
    members, links = class_links(docs, doc_id, text, **given)
    sizes = members.where("cls is not null").groupBy("cls").agg(F.count("*").alias("size"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, F.col("b") == F.col("cls")).groupBy(F.col("a").alias("of")).agg(F.sum("size").alias("others"))
    per = sizes.join(others, F.col("cls") == F.col("of"), "left").select("cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(per, "cls", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **given) -> DataFrame:
    """docs without the rows that another of their component stands for: the row with the least doc_id stays (null is the
    last), of equal ids the first by the text's hashes. Components are those of texts, so unlinked texts all stay, whether
    their ids are null, repeated or neither. Of rows without shingles one of equal id and text stays."""
    members, of_class = labelled_classes(docs, doc_id, text, **given)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b")
    firsts = members.where("n > 0").groupBy("sig_a", "sig_b", "n").agg(F.min(key).alias("key"))
    firsts = firsts.join(of_class.drop("doc_id"), ["sig_a", "sig_b", "n"]).groupBy("label").agg(F.min("key").alias("key"))
    kept = firsts.select("key.*").unionByName(members.where("n = 0").select(key.alias("key")).select("key.*"))
    names = ["__none", "__id", "__text_a", "__text_b"]
    keys = lambda i: [i.isNull().alias(names[0]), F.coalesce(i, F.lit(0)).alias(names[1])]
    kept = kept.select(*keys(F.col("doc_id")), F.col("text_a").alias(names[2]), F.col("text_b").alias(names[3])).distinct()
    # Rows of one key become one within their tasks, before the shuffle. docs' own columns lie inside a struct, so no name clashes.
    whole = F.struct(*columns_of(docs.schema.fields)).alias("__row")
    rows = docs.select(*keys(integer_id(docs, doc_id)), *[c.alias(n) for c, n in zip(_text_key(text), names[2:])], whole)
    sortable = not any(x in rows.schema["__row"].dataType.simpleString() for x in ("map<", "variant"))
    rows = rows.groupBy(*names).agg((F.min if sortable else F.any_value)("__row").alias("__row"))
    return rows.join(kept, names, "left_semi").select("__row.*")
