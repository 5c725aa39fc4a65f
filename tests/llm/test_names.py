"""Columns of the input that are named like an operator's own and output columns, and ids of other types."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import decontamination, language_id, lm_scoring, mixture, ngram_jaccard, quality_rules, token_binary, token_counts, toxicity, url_filter

#: Names that operators use inside, and outputs in another case.
NAMES = (
    "Score Lang_Pred letters __letters counts __counts Quality Mix mix_plan mix_stratum mix_size mix_of mix_copy __rate __source Token_Counts token_tree edits Contamination "
    "key_a key_b found_spans key t id tie h y held learn cls n sig_a token __row __id __none __kept lang_found lang_score __lang host_key host_shard host_listed __host shard listed Filter "
    "stratum bin size rate target copies a.b"
).split()
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def crowded(df):
    return df.select("*", *[F.lit(n).alias(n) for n in NAMES if n.lower() not in {c.lower() for c in df.columns}])


@pytest.fixture(scope="module")
def plain(edge_docs):
    return edge_docs.drop("score", "label", "rate").where("doc_id is null or doc_id <> 6")


def rows(df, key):
    return sorted((r["doc_id"] is None, r["doc_id"], r["text"] is None, r["text"], repr(r[key])) for r in df.collect())


def same(plain, run, out):
    """run gives the same on a crowded frame, keeps every column, and replaces those named like its outputs."""
    want, full = run(plain), crowded(plain)
    got = run(full)
    taken = {o.lower() for o in out}
    assert [c for c in got.columns if c not in out] == [c for c in full.columns if c.lower() not in taken]
    assert rows(got, out[0]) == rows(want, out[0])
    kept = [c for c in full.columns if c in NAMES and c.lower() not in taken]
    for r in got.collect():
        assert all(r[c] == c for c in kept)


def test_document_operators(spark, plain):
    learn = F.col("doc_id") != 2
    labels = crowded(spark.createDataFrame([(1, 1), (2, 0), (8, 1)], "doc_id bigint, toxic int"))
    benchmark = crowded(spark.createDataFrame([("a", "the quick brown fox jumps over the lazy dog and runs home"), ("b", "one two")], "item_id string, text string"))
    same(plain, lambda d: language_id.detect(d, learn), ["lang_pred", "score"])
    same(plain, quality_rules.quality_rules, ["quality"])
    same(plain, lambda d: toxicity.score_toxicity(d, labels, F.lit(True)), ["score"])
    same(plain, lambda d: decontamination.scan(d, benchmark), ["contamination"])
    same(plain, lambda d: decontamination.scan(d, benchmark, pass_words=1), ["contamination"])
    same(plain, mixture.mix, ["mix"])
    same(plain, lambda d: mixture.mix(d, also={"lang": {"en": 1.0}}), ["mix"])
    same(plain, lambda d: token_counts.build_trees(d, RANKS, public_tokenizers.PATTERN), ["token_tree"])
    same(plain, lambda d: token_counts.edit_counts(d, RANKS, public_tokenizers.PATTERN), ["token_counts"])


def test_whole_row_operators(spark, plain):
    full = crowded(plain)
    benchmark = spark.createDataFrame([("a", "the quick brown fox jumps over the lazy dog and runs home")], "item_id string, text string")
    for run in (ngram_jaccard.one_of_each, lambda d: decontamination.decontaminate(d, benchmark)):
        got = run(full)
        assert got.columns == full.columns and rows(got, "text") == rows(run(plain), "text")
    for run in (ngram_jaccard.near_duplicates, lambda d: lm_scoring.score(d, F.lit(True))):
        assert sorted(map(repr, run(full).collect())) == sorted(map(repr, run(plain).collect()))
    read = [token_binary.read_tokens(spark, token_binary.write_tokens(d, TOKENIZER)) for d in (plain, full)]
    assert len({repr(sorted(map(repr, r.collect()))) for r in read}) == 1


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "x"), (2, None, "y"), (3, "http://c/", None)], "doc_id bigint, url string, text string")
    listed = spark.createDataFrame([("b",)], "host string")
    for limit in (1 << 20, 0):
        same(pages, lambda d: url_filter.url_filter(d, listed, broadcast_limit=limit), ["filter"])


def test_pipeline_stages(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, extra columns and an empty table through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (1, "short", "en", "src0", 5), (1, "short", "en", "src0", 5), (900, "word " * 40_000, "en", "src1", 200_000), (901, "12 34", "de", "x", 5)]
    full = crowded(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    empty = full.limit(0)
    for frame in (full, empty):
        for _, stage in pipeline.STAGES[:-1]:
            frame = stage(spark, frame, sf_dir)
            assert frame.columns == full.columns
            frame = spark.createDataFrame(frame.collect(), frame.schema)
        out = pipeline.STAGES[-1][1](spark, frame, sf_dir)
        assert out.count() == frame.count()


def test_ids_of_other_types(spark):
    """Text ids: operators that only hash them take them; those that number or compare them say so."""
    docs = spark.createDataFrame([("a", "some english words are here and there", "en", "s"), ("b", "noch ein deutscher text steht hier", "de", "s")], "doc_id string, text string, lang string, source string")
    assert language_id.detect(docs, F.lit(True)).count() == 2 and mixture.mix(docs).count() == 2
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, toxic int")
    assert toxicity.score_toxicity(docs, labels, F.lit(True)).count() == 2
    for run in (ngram_jaccard.near_duplicates, ngram_jaccard.one_of_each, lambda d: lm_scoring.score(d, F.lit(True)), lambda d: token_binary.write_tokens(d, TOKENIZER)):
        with pytest.raises(ValueError, match="integer"):
            run(docs)
