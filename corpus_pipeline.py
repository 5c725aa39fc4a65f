"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing and token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import decontamination, language_id, mixture, ngram_jaccard, token_binary
from tidewheel.llm.common import column, fold_of, free_name, materialize, table
from tidewheel.llm.queries import tokenizer_path

#: Least probability of the predicted language with which a document stays.
MIN_LANGUAGE_SCORE = 0.3
#: Near duplicates of the stage: shingles of five words, linked from a similarity of 0.8 on.
SHINGLE, PERCENT = 5, 80

#: Rows of an Arrow batch in this pipeline: texts are long, and every task holds a batch on both sides.
BATCH_ROWS = 2000


def _batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go (so also null and empty texts, and those without a letter); lang becomes
    the predicted one."""
    _batches(spark)
    pred, score = (free_name(n, docs.columns) for n in ("lang_found", "lang_score"))
    found = language_id.detect(docs, fold_of(F.col("doc_id"), 4) != 2, pred=pred, score=score)
    kept = found.where((F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col(pred).alias(c) if c == "lang" else column(c) for c in docs.columns])


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays."""
    _batches(spark)
    return ngram_jaccard.one_of_each(docs, k=SHINGLE, percent=PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go. n_chars follows the text."""
    _batches(spark)
    kept = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    size = F.char_length("text").cast("long")
    return kept.select(*[size.alias(c) if c == "n_chars" else column(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the mix as often as it has copies."""
    plan, copy = (free_name(n, docs.columns) for n in ("mix_of", "mix_copy"))
    found = mixture.mix(docs, out=plan).where(F.col(plan)["copies"] > 0)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(plan)["copies"]))).select(*map(column, docs.columns))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; a row per document as read back from them."""
    _batches(spark)
    return token_binary.read_tokens(spark, token_binary.write_tokens(docs, tokenizer_path(token_binary.TOKENIZER)))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", duplicates),
    ("decontamination", decontaminated),
    ("mixture", mixed),
    ("token_binary", token_files),
]

#: SQL can't express a trained network or the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
