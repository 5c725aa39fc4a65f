r"""Quality rules [native]: a table of thresholds compiled into one projection, without user functions.

Words are the runs of `[^\x20\x09-\x0D]`. Base counts per text: n_words; word_chars, the code points in words;
n_symbols, the characters of `[#*$%&|<>]`; n_dup_lines, the \n-split lines with a word that equal an earlier line;
n_repeat_words, the words in 3-word windows found twice or more in the text, the first occurrence included.

Every count is an array expression within the row, so the plan is one scan and one projection: no shuffle, and a
row's cost is n log n in its words (one sort of primitive longs). A null text has no words and fails. An empty table
gives an empty result; repeated rows are judged one by one. Extra columns stay; one named like the output, in whatever case, is
replaced by it.

Windows are compared by 64-bit hashes of three 64-bit word hashes. Sorting needs hash and position together; they are
packed in one long (40 bits of hash, 23 of position), and every pair of neighbours with equal 40 bits is compared by
its full hash. Where that finds a difference, or a text has 2^23 words or more, the row takes a sort of
(full hash, position) structs instead, so the counts don't depend on the packing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, columns_of, free_name, others

#: Frequent function words of the four languages that the rules know.
STOP_WORDS = (
    "the of and to in is it that for on with as was at by be this from are have "
    "der die und in den von zu das mit sich des auf ist im nicht ein eine "
    "de la le et les des en un une du que est pour qui dans "
    "el los y a se las por con para no una su lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio and the closed range that a kept text has it in; texts under min_words words skip it."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    min_words: int = 0


#: The thresholds. Integer counts are compared crosswise (numerator >= low * denominator), so no rounding enters.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2, 12),
    Rule("symbol_ratio", "n_symbols", "n_words", 0, 0.4),
    Rule("line_repeat_ratio", "n_dup_lines", "n_lines", 0, 0.3),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, 1),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
_BITS = 23


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, whatever the optimizer merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda third, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), third),
        )
        return _let(windows, of_windows)

    def covered(starts: Column) -> Column:
        """Words in the windows that begin at the ascending starts."""
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
            lambda acc, s: F.struct(
                (acc["n"] + F.lit(3) - F.greatest(acc["end"] - s + 1, F.lit(0))).alias("n"), (s + 2).alias("end")
            ),
            lambda acc: acc["n"],
        )

    def exact(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        hit = lambda s: F.filter(
            s,
            lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
        )
        return _let(pairs, lambda s: covered(F.sort_array(F.transform(hit(s), lambda x: x["i"]))))

    def of_windows(w: Column) -> Column:
        packed = F.sort_array(F.transform(w, lambda x, i: F.shiftleft(x, _BITS).bitwiseOR(i.cast("long"))))
        same = lambda a, b: F.coalesce(F.shiftright(a, _BITS) == F.shiftright(b, _BITS), F.lit(False))
        full = lambda a: F.get(w, a.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int"))

        def of_packed(s: Column) -> Column:
            hits = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))

            def of_hits(t: Column) -> Column:
                clash = F.exists(
                    F.transform(t, lambda x, k: same(x, F.get(t, k + 1)) & (full(x) != full(F.get(t, k + 1)))), lambda b: b
                )
                quick = covered(F.sort_array(F.transform(t, lambda x: x.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int"))))
                return F.when(F.size(t) == 0, F.lit(0)).when(clash, exact(w)).otherwise(quick)

            return _let(hits, of_hits)

        return F.when(F.size(w) < 2, F.lit(0)).when(F.size(w) >= (1 << _BITS), exact(w)).otherwise(_let(packed, of_packed))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes))


def counts(text: Column) -> Column:
    """A struct of the base counts, n_lines and n_stop_words of a text column (null: none)."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return _let(
            lines,
            lambda found: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).cast("long").alias("n_repeat_words"),
                F.size(found).cast("long").alias("n_lines"),
                F.size(F.filter(words, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            ),
        )

    return _let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), of_words)


def verdict(c: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, names of the failed rules) of a struct of counts."""
    base = (c["n_words"] < BASE_MIN_WORDS) | (100 * c["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * c["n_words"])
    failed = [
        F.when(
            (c["n_words"] >= r.min_words)
            & ((c[r.numerator] < r.low * c[r.denominator]) | (c[r.numerator] > r.high * c[r.denominator])),
            F.lit(r.name),
        )
        for r in rules
    ]
    return base, F.array_compact(F.array(*failed))


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "quality") -> DataFrame:
    """docs with a struct column `out`: the counts, base_failed, failed_rules and kept."""
    held = free_name("counts", [*docs.columns, out])
    c = column(held)
    base, failed = verdict(c, rules)
    judged = F.struct(*[c[f].alias(f) for f in COUNTS], base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))
    return docs.withColumn(held, counts(column(text))).select(*columns_of(others(docs, [out])), judged.alias(out))
