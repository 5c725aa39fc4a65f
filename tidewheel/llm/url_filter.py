"""URL filters: rules by host and path, and exact block-list membership by a Bloom filter cascade.

A cascade holds a set exactly with respect to a known universe of keys. Level 0 is a Bloom filter of the listed keys;
level 1 one of the universe's other keys that level 0 accepts; level 2 one of the listed keys that level 1 accepts,
and so on until a level has no false positives. A key is listed if the first level that rejects it is odd, or, if none
does, if the number of levels is odd. Every key of the universe is answered exactly, without a join.

Here keys are hosts, and the list is a table: `listed` has a host a row, which stands for itself and all its subdomains.
The universe is every distinct host of the corpus, by one aggregation (a hot host is one row per task). It is marked by the
list at the scale of distinct hosts, where each host meets the list with its parent domains, and cut in shards by key hash,
sized so that one has about SHARD_KEYS keys; each shard's cascade is built in its own group. A cascade takes about ten bits
per listed key and a few per falsely accepted one.
The packed cascades are broadcast only after their total size was summed and found at most `broadcast_limit` bytes. Beyond
it, each shard's distinct hosts meet their cascade in a cogroup, and the listed ones among them are joined to the pages, of
which only host and key columns are wide; a hot host's pages are split by adaptive execution.

Null urls, or urls without `://`, have an empty host and path; the empty host is listed only if the list has it. Null rows
of the list are ignored, and its hosts compare in lower case (A-Z). An empty list blocks nothing by membership. Repeated
rows are judged one by one; an empty table gives an empty result. Extra columns stay; one named like the output, in
whatever case, is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, materialize, others

SHARD_KEYS = 1 << 18
BROADCAST_LIMIT = 64 << 20


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[UrlRule] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) by the longest fitting rule; longer host first, then longer path. Null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


class Bloom:
    """Bits for n keys at a false positive rate; hashing is salted by the level."""

    def __init__(self, bits: np.ndarray, hashes: int, level: int):
        self.bits, self.hashes, self.level = bits, hashes, level

    @classmethod
    def of(cls, keys: list[bytes], rate: float, level: int) -> Bloom:
        size = max(64, int(math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2)))
        made = cls(np.zeros((size + 7) // 8, np.uint8), max(1, round(-math.log2(rate))), level)
        at = made._places(keys)
        np.bitwise_or.at(made.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return made

    def _places(self, keys: list[bytes]) -> np.ndarray:
        one = np.array([xxhash.xxh3_64_intdigest(k, self.level) for k in keys], np.uint64).reshape(-1, 1)
        two = (one >> np.uint64(32)) | np.uint64(1)
        return ((one + np.arange(self.hashes, dtype=np.uint64) * two) % np.uint64(len(self.bits) * 8)).astype(np.int64)

    def accepts(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = self._places(keys)
        return ((self.bits[at >> 3] >> (at & 7)) & 1).all(axis=1)


def build_cascade(listed: list[bytes], others: list[bytes]) -> list[Bloom]:
    """Levels until one has no false positives. The first has the rate that is best for the ratio of the two sets."""
    levels: list[Bloom] = []
    inside, outside = listed, others
    while inside:
        rate = min(0.5, max(1e-4, math.sqrt(0.5) * len(inside) / max(1, len(outside)))) if not levels else 0.5
        level = Bloom.of(inside, rate, len(levels))
        levels.append(level)
        passed = level.accepts(outside)
        inside, outside = [k for k, x in zip(outside, passed) if x], inside
    return levels


def in_cascade(levels: list[Bloom], keys: list[bytes]) -> np.ndarray:
    found = np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    for n, level in enumerate(levels):
        passed = level.accepts([keys[i] for i in left])
        found[left[~passed]] = n % 2 == 1
        left = left[passed]
    found[left] = len(levels) % 2 == 1
    return found


def pack(levels: list[Bloom]) -> list[dict]:
    return [{"level": x.level, "hashes": x.hashes, "bits": x.bits.tobytes()} for x in levels]


def unpack(rows: Iterable) -> list[Bloom]:
    return [Bloom(np.frombuffer(r["bits"], np.uint8), r["hashes"], r["level"]) for r in sorted(rows, key=lambda r: r["level"])]


def cascades(universe: DataFrame, shards: int) -> DataFrame:
    """(shard, level, hashes, bits) of a frame of distinct (key, listed)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [k.encode() for k in pdf["key"]]
        levels = pack(build_cascade([k for k, x in zip(keys, pdf["listed"]) if x], [k for k, x in zip(keys, pdf["listed"]) if not x]))
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0])} | x for x in levels], columns=["shard", "level", "hashes", "bits"])

    dealt = universe.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, level int, hashes int, bits binary")


def marked_hosts(hosts: DataFrame, listed: DataFrame, host: str = "host") -> DataFrame:
    """(key, listed) of distinct keys: listed if the key or a parent domain of it is a row of the list."""
    labels = F.split("key", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = listed.select(lower(column(host)).alias("name")).where("name is not null").distinct()
    found = hosts.select("key", F.explode(parents).alias("name")).join(names, "name", "left_semi").select("key")
    return hosts.withColumn("listed", F.lit(False)).unionByName(found.withColumn("listed", F.lit(True))).groupBy("key").agg(F.max("listed").alias("listed"))


def url_filter(
    pages: DataFrame,
    listed: DataFrame,
    url: str = "url",
    host: str = "host",
    rules: Iterable[UrlRule] = RULES,
    out: str = "filter",
    broadcast_limit: int = BROADCAST_LIMIT,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """pages with a struct column `out`: host, path, rule, listed and verdict (allow or block). listed: the block list, its
    hosts in the column `host`."""
    spark = pages.sparkSession
    universe = materialize(marked_hosts(pages.select(host_of(column(url)).alias("key")).distinct(), listed, host), "hosts")
    shards = max(1, math.ceil(universe.count() / shard_keys))
    tables = materialize(cascades(universe, shards), "cascades")
    total = tables.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    fields = [f.name for f in others(pages, [out])]
    key, shard, member_of = (free_name(n, [*pages.columns, out]) for n in ("host_key", "host_shard", "host_listed"))
    dealt = pages.withColumn(key, host_of(column(url)))

    if total <= broadcast_limit:
        held: dict[int, list] = {}
        for r in tables.collect():
            held.setdefault(r["shard"], []).append(r.asDict())
        shared = spark.sparkContext.broadcast(held)

        @F.pandas_udf("boolean")
        def member(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            levels = {k: unpack(v) for k, v in shared.value.items()}
            for hosts, places in parts:
                names, inverse = np.unique(hosts.to_numpy(), return_inverse=True)
                place = np.zeros(len(names), np.int64)
                place[inverse] = places.to_numpy()
                found = np.zeros(len(names), bool)
                for s in np.unique(place):
                    at = np.flatnonzero(place == s)
                    found[at] = in_cascade(levels.get(int(s), []), [names[i].encode() for i in at])
                yield pd.Series(found[inverse])

        dealt = dealt.withColumn(shard, F.pmod(F.xxhash64(column(key)), F.lit(shards)).cast("int"))
        marked = dealt.withColumn(member_of, member(column(key), column(shard)))
    else:

        def judge(left: pa.Table, right: pa.Table) -> pa.Table:
            keys = left["key"].combine_chunks()
            found = in_cascade(unpack(right.select(["level", "hashes", "bits"]).to_pylist()), [k.encode() for k in keys.to_pylist()])
            return pa.table({key: keys.filter(pa.array(found, pa.bool_()))})

        sharded = universe.select("key", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
        blocked = sharded.groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(judge, f"`{key}` string")
        marked = dealt.join(blocked.withColumn(member_of, F.lit(True)), key, "left")

    path = path_of(column(url))
    rule, ruled = rule_of(column(key), path, rules)
    on_list = F.coalesce(column(member_of), F.lit(False))
    return marked.select(
        *map(column, fields),
        F.struct(
            column(key).alias("host"),
            path.alias("path"),
            rule.alias("rule"),
            on_list.alias("listed"),
            F.coalesce(ruled, F.when(on_list, "block").otherwise("allow")).alias("verdict"),
        ).alias(out),
    )
