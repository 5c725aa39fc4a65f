"""Mixing sources to target weights [native]: entropy balancing of document rates, rounded into whole copies.

Each document i gets a rate w_i that minimises the relative entropy sum p_i log(p_i / q_i) of the mix's token mass
p_i = w_i * size_i against the corpus mass q_i = size_i, under token constraints by family: for every value v of a family of
columns (the source; beside it, say, the language), the p_i of v's documents sum to target_v. The convex dual is
sum_i q_i exp(l_i) - sum_v target_v l_v, where l_i sums the multipliers of the document's values; its solution tilts
every document exponentially, w_i = exp(l_i).

Documents with equal values share a tilt, so the dual needs only the mass of each stratum (one distributed aggregation,
partly summed before the shuffle: a hot source is a row per task). It is solved by Newton's method, a family at a time: with
the other families fixed, the Hessian of a family's block is diagonal, and its Newton steps need the values' masses, one
distributed aggregation over the strata. Rounds over the families go on until every constraint is met within TOLERANCE,
ROUNDS at most (constraints may contradict each other); a single family, as in the registered query, takes one round.

Targets of sources: in code point order, null last, they weigh `weights`, repeated; each gets its weight's share of all
tokens, cut at `cap` times its own size, the excess reshared by weight among the others until none is above (water filling,
one running sum over the table of sources, which has a row per source). `also` gives further families: shares of the mix's
tokens for the values of a column; values without a share, and nulls, get none, and their documents no copies.

Rounding: a document gets floor(w) or floor(w) + 1 copies. Within a stratum, documents fall in size classes (powers of
two) and, by a hash of their id, in `BINS` bins; the extra copies go to the first bins of each class until the
class's share of the stratum's remainder is reached, and what a class could not place exactly is carried to the next
smaller one. The error of a stratum is so at most about one bin of its smallest class, without any order over all
documents. Rates are cut at `cap`, so no document gets more copies. Reruns agree: only sums of integers and hashes enter.

Null text has size 0; rows of size 0 take 0 words but keep floor(w) copies. Repeated rows with one id share a bin.
An empty table gives an empty result. Ids may be of any type; a null id hashes as empty text. Extra columns stay; one named
like the output, in whatever case, is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, column, columns_of, free_name, materialize, others

WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 4096
NEWTON_STEPS = 40
ROUNDS = 50
TOLERANCE = 1e-6
#: Strata up to which their table (a few numbers for each) is broadcast; beyond it, the join is Spark's to plan.
BROADCAST_STRATA = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _bin(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def _size_class(size: Column) -> Column:
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of a frame with columns source and size. One row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)) + 1))
    # Sources meet their cap in the order of cap over weight. Before a source: what capped ones hold, and the
    # weight still open. It is capped itself if its share of what is left reaches the cap.
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("held", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
        .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", (F.col("total") - F.col("held")) * F.col("w") >= cap * F.col("source_size") * F.col("open"))
    )
    # `capped` holds for a prefix of the fill order; the first open source fixes the level of all open ones.
    opened = F.max(F.when(~F.col("capped"), F.struct(F.col("open"), F.col("held")))).over(everything)
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(
        (F.col("total") - opened["held"]).cast("double") * F.col("w") / opened["open"]
    )
    return level.withColumn("target", target).select("source", "source_size", "target")


def share_targets(totals: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(value, target) of a family that is given by shares of all tokens of the mix (totals: one row, total)."""
    pairs = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(float(s)).alias("share")) for v, s in shares.items()])
    norm = float(sum(shares.values()))
    return totals.select("total", F.inline(pairs)).select("value", (F.col("total") * F.col("share") / norm).alias("target"))


def _newton(mass: Column, goal: Column) -> Column:
    """The step of a multiplier that brings its mass to the goal: Newton on mass * exp(d) - goal * d, each step held to
    [-1, 1]. Null where mass or goal is 0."""
    solved = F.aggregate(
        F.sequence(F.lit(1), F.lit(NEWTON_STEPS)),
        F.lit(0.0),
        lambda d, _: d + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), goal / (mass * F.exp(d)) - 1)),
    )
    return F.when((mass > 0) & (goal > 0), solved)


def balanced(strata: DataFrame, targets: dict[str, DataFrame], cap: int) -> DataFrame:
    """strata (the families' columns and mass) with the column rate. targets: (value, target) for each family's column."""
    now = strata.withColumn("tilt", F.lit(0.0))
    for _ in range(ROUNDS):
        off = []
        for name, goals in targets.items():
            goals = goals.select(F.col("value").alias("v"), F.col("target").alias("goal"))
            moved = F.sum(F.col("mass") * F.exp(F.coalesce("tilt", F.lit(float("-inf")))))
            per = now.groupBy(name).agg(moved.alias("m")).join(goals, F.col(name).eqNullSafe(F.col("v")), "left")
            step = per.select(F.col(name).alias("v"), _newton(F.col("m"), F.col("goal")).alias("d"))
            now = now.join(step, F.col(name).eqNullSafe(F.col("v")), "left").withColumn("tilt", F.col("tilt") + F.col("d")).drop("v", "d")
            if len(targets) > 1:
                now = materialize(now, "tilts")
                off.append(per.select(F.max(F.when(F.col("m") > 0, F.abs(F.col("m") / F.col("goal") - 1)))).first()[0] or 0.0)
        if len(targets) == 1 or max(off) <= TOLERANCE:
            break
    rate = F.when(F.col("tilt").isNull(), 0.0).otherwise(F.least(F.round(F.exp("tilt"), 12), F.lit(float(cap))))
    return now.withColumn("rate", rate).drop("tilt")


def _quotas(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """(stratum, cls, below): documents of the class in bins under `below` get one copy more."""
    bins = cells.groupBy("stratum", "cls", "bin").agg(F.sum("size").alias("mass")).join(plan.select("stratum", "rate"), "stratum")
    # What is still to place, over classes from large to small: target minus the whole copies, class by class.
    part = F.col("rate") - F.floor("rate")
    per = (
        bins.groupBy("stratum", "cls")
        .agg(F.sum("mass").alias("class_mass"), F.first(part).alias("part"), F.sort_array(F.collect_list(F.struct("bin", "mass"))).alias("bins"))
        .groupBy("stratum")
        .agg(F.first("part").alias("part"), F.sort_array(F.collect_list(F.struct("cls", "class_mass", "bins")), asc=False).alias("classes"))
    )

    def place(want: Column, cell: Column) -> Column:
        """The bins of a class from the first on, each while that brings the sum nearer to what is wanted."""
        return F.aggregate(
            cell["bins"],
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("below"), F.lit(True).alias("on")),
            lambda acc, b: F.when(
                acc["on"] & ((acc["sum"] + b["mass"] - want) <= (want - acc["sum"])),
                F.struct((acc["sum"] + b["mass"]).alias("sum"), (b["bin"] + 1).cast("int").alias("below"), F.lit(True).alias("on")),
            ).otherwise(F.struct(acc["sum"].alias("sum"), acc["below"].alias("below"), F.lit(False).alias("on"))),
        )

    entry = "array<struct<cls:int,below:int>>"
    placed = F.aggregate(
        F.col("classes"),
        F.struct(F.lit(0.0).alias("carry"), F.array().cast(entry).alias("cells")),
        lambda acc, cell: F.element_at(
            F.transform(
                F.array(place(acc["carry"] + F.col("part") * cell["class_mass"], cell)),
                lambda p: F.struct(
                    (acc["carry"] + F.col("part") * cell["class_mass"] - p["sum"]).alias("carry"),
                    F.concat(acc["cells"], F.array(F.struct(cell["cls"].alias("cls"), p["below"].alias("below"))).cast(entry)).alias("cells"),
                ),
            ),
            1,
        ),
        lambda acc: acc["cells"],
    )
    return per.select("stratum", F.inline(placed))


def _stratum(values: list[Column]) -> Column:
    """One text for a row's values; null differs from every text."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    also: dict[str, dict[str, float]] | None = None,
    out: str = "mix",
) -> DataFrame:
    """docs with a struct column `out`: size, source_size, target (its source's), rate, copies and taken (= copies * size)."""
    families = {"source": column(source)} | {f"family{n}": column(c).cast("string") for n, c in enumerate(also or {})}
    sized = docs.select(
        *[c.alias(n) for n, c in families.items()],
        _stratum(list(families.values())).alias("stratum"),
        word_count(column(text)).alias("size"),
        _bin(column(doc_id)).alias("bin"),
    ).withColumn("cls", _size_class(F.col("size")))
    # The table of (stratum, class, bin) masses has at most strata * classes * BINS rows, whatever the corpus.
    cells = materialize(sized.groupBy("stratum", *families, "cls", "bin").agg(F.sum("size").alias("size")), "cells")
    sources = source_targets(cells, weights, cap)
    strata = cells.groupBy("stratum", *families).agg(F.sum("size").alias("mass"))
    targets = {"source": sources.select(F.col("source").alias("value"), "target")}
    if also:
        sources, strata = materialize(sources, "targets"), materialize(strata, "strata")
        totals = sources.agg(F.sum("target").alias("total"))
        targets = {"source": sources.select(F.col("source").alias("value"), "target")}
        targets |= {f"family{n}": share_targets(totals, shares) for n, shares in enumerate(also.values())}
    # Sources come last in a round, so that their constraints hold exactly where families contradict each other.
    rates = balanced(strata, dict(reversed(targets.items())), cap)
    named = sources.withColumnRenamed("source", "s")
    plan = materialize(rates.join(named, F.col("source").eqNullSafe(F.col("s"))).select("stratum", "source_size", "target", "rate"), "plan")
    quotas = _quotas(cells, plan).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("cls", "below"))).alias("below"))
    held, key, words = (free_name(n, [*docs.columns, out]) for n in ("mix_plan", "mix_stratum", "mix_size"))
    packed = plan.join(quotas, "stratum", "left").select(F.col("stratum").alias(key), F.struct("source_size", "target", "rate", "below").alias(held))
    packed = materialize(packed, "plan")
    if packed.count() <= BROADCAST_STRATA:
        packed = F.broadcast(packed)
    joined = docs.withColumns({words: word_count(column(text)), key: _stratum([column(source), *[column(c) for c in also or {}]])}).join(packed, key, "left")
    p, size = column(held), column(words)
    extra = F.when(p["rate"] == F.floor(p["rate"]), 0).when(_bin(column(doc_id)) < F.coalesce(F.try_element_at(p["below"], _size_class(size)), F.lit(0)), 1).otherwise(0)
    copies = (F.floor(p["rate"]) + extra).cast("int")
    return joined.select(
        *columns_of(others(docs, [out])),
        F.struct(
            size.alias("size"),
            p["source_size"].alias("source_size"),
            p["target"].alias("target"),
            p["rate"].alias("rate"),
            copies.alias("copies"),
            (copies * size).cast("long").alias("taken"),
        ).alias(out),
    )
