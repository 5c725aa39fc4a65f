"""Cases where operators once did less than the whole job."""

from collections import Counter

from tidewheel.llm import decontamination, ngram_jaccard
from tidewheel.llm.common import table
from tidewheel.llm.queries import QUERIES


def test_one_of_each_keeps_unlinked_texts_without_own_id(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (7, text("c") + " more"), (7, text("d")), (7, text("e")), (8, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = ngram_jaccard.one_of_each(docs)
    want = [(None, text("a")), (None, text("b")), (7, text("c") + " more"), (7, text("d")), (7, text("e"))]
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(want)


def test_short_items_are_removed_as_a_whole(spark):
    long = " ".join(f"t{i}" for i in range(14))
    benchmark = spark.createDataFrame([("a", "who wrote the lost book"), ("b", long)], "item_id string, text string")
    rest = " ".join(f"w{i}" for i in range(20))
    part = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{rest} Who wrote the lost book? {rest}"), (2, f"{rest} who wrote the {rest}"), (3, f"{rest} {long} {rest}"), (4, f"{rest} {part} {rest}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, benchmark).collect()}
    assert kept == {1: f"{rest} {rest}", 2: rows[1][1], 3: f"{rest} {rest}", 4: f"{rest} {rest}"}
    # A longer min_span leaves parts of items, but no whole item.
    kept = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, benchmark, min_span=20).collect()}
    assert kept == {1: f"{rest} {rest}", 2: rows[1][1], 3: f"{rest} {rest}", 4: rows[3][1]}


def test_toxicity_finds_other_languages(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = QUERIES["op3_toxicity"](spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").join(docs, "doc_id").collect()
    for lang in ("de", "fr", "es"):
        found = [r["predicted"] for r in rows if r["lang"] == lang and r["toxic"] == 1]
        assert sum(found) > 0.6 * len(found), lang
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(clean) < 0.01 * len(clean)
