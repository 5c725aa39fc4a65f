"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, lm_scoring, mixture, ngram_jaccard, quality_rules, token_binary, token_counts, toxicity, url_filter
from .common import fold_of, table


#: The block list of the registered query: hosts, each with its subdomains.
LISTED_HOSTS = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.detect(docs, fold_of(F.col("doc_id"), 4) != 2, keep=["doc_id"])
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of(F.col("doc_id"), 4)
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 2, keep=["doc_id"])
    return found.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "host string")
    found = url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return found.select("page_id", *[F.col(f"filter.{n}").alias(n) for n in ("host", "path", "rule", "verdict")])


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_binary.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(token_binary.TOKENIZER))
    return token_binary.read_tokens(spark, manifest)


def counted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = token_counts.edit_counts(docs, tokenizer_path(token_counts.RANKS), public_tokenizers.PATTERN, keep=["doc_id"])
    return found.select("doc_id", "token_counts.*")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of(F.col("doc_id"), 7)
    found = lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold != 2, plain_scan=True)
    return found.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    found = decontamination.scan(table(spark, sf_dir, "documents"), benchmark, keep=["doc_id"], with_clean=False)
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", *[F.col(f"mix.{n}").alias(n) for n in ("size", "source_size", "target", "taken")])


QUERIES = {
    "op1_language_id": language,
    "op2_quality_rules": quality,
    "op3_toxicity": toxic,
    "op4_url_filter": urls,
    "op5_token_binary": token_files,
    "op6_token_counts": counted_tokens,
    "op7_lm_scoring": lm_scores,
    "op8_decontamination": contamination,
    "op9_ngram_jaccard": near_duplicates,
    "op10_mixture": mixed,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_FAILED = " OR ".join(
    f"{r.numerator} < {r.low} * {r.denominator} OR {r.numerator} > {r.high} * {r.denominator}" for r in quality_rules.RULES
)
_RULES = sorted(url_filter.RULES, key=lambda r: (-len(r.name), -len(r.host)))


def _rule_case(value: str) -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'" for r in _RULES
    )
    return f"CASE {fits} END"


_LIST = ", ".join(f"('{h}')" for h in LISTED_HOSTS)

ORACLE_SQL = {
    "op2_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT *, len(ws)::BIGINT AS n_words,
             list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS gs FROM w),
r AS (SELECT *, map_keys(map_from_entries(list_transform(list_distinct(gs), lambda x: (x, 1)))) AS ds FROM g),
u AS (SELECT doc_id, unnest(gs) AS x, generate_subscripts(gs, 1) AS i FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM u),
m AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d WHERE c > 1) GROUP BY 1),
k AS (SELECT g.doc_id, n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(m.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: list_contains([{_STOP}], lower(x))))::BIGINT AS n_stop_words
      FROM g LEFT JOIN m ON g.doc_id = m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR {_FAILED}) AS kept FROM k
""".replace("r AS (SELECT *, map_keys(map_from_entries(list_transform(list_distinct(gs), lambda x: (x, 1)))) AS ds FROM g),\n", ""),
    "op4_url_filter": rf"""
WITH h AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b(name) AS (VALUES {_LIST}),
l AS (SELECT DISTINCT host AS listed FROM h JOIN b ON host = name OR ends_with(host, '.' || name)),
r AS (SELECT *, {_rule_case("name")} AS rule, {_rule_case("verdict")} AS ruled FROM h)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN l ON host = listed
""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM
        (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM
        (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM w) WHERE len(ws) >= k)),
o AS (SELECT doc_id, item_id, p.k, i FROM p JOIN w ON p.win = w.win AND p.k = w.k),
n AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM
        (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op9_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
e AS (SELECT a.doc_id AS p, b.doc_id AS q FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c AS (SELECT doc_id AS p, doc_id AS q FROM d UNION SELECT c.p, e.q FROM c JOIN e ON c.q = e.p)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, m AS component_id
FROM s JOIN (SELECT p, min(q) AS m FROM c GROUP BY p) ON s.doc_id = p
""",
}
