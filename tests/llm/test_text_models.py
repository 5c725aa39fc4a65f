"""Language ID, quality rules, toxicity, URL filters and token counts."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import language_id, quality_rules, token_counts, toxicity, url_filter
from tidewheel.llm.common import fold_of, hash_words, table
from tidewheel.llm.queries import ORACLE_SQL, QUERIES



def learnable():
    return fold_of(F.col("doc_id"), 4) != 2


def test_word_hashes_follow_bytes_split():
    text = "a b\tc\u00a0d\n\n \x0bée  longer\x1cword ".encode()
    h, starts, ends = hash_words(text)
    words = text.split()
    assert [text[a:b] for a, b in zip(starts, ends)] == words and len(set(h.tolist())) == len(words)
    assert hash_words(b"ab " + b"x" * 700)[0][1] != hash_words(b"ab " + b"x" * 699 + b"y")[0][1]


def test_language_held_out(spark, sf_dir):
    rows = QUERIES["op1_language_id"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95


def test_language_edges(edge_docs, empty_docs):
    rows = language_id.detect(edge_docs, learnable()).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language_id.detect(empty_docs, learnable()).count() == 0
    assert {r["lang_pred"] for r in language_id.detect(edge_docs, F.lit(False)).collect()} == {"und"}


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 509, 1000):
        windows, owner, sizes = language_id.windows_of([b"x" * n, b"y"])
        assert (owner == 0).sum() >= 1 and sizes[owner == 0].sum() >= n


def plain_probabilities(net, windows):
    """The network by plain loops over windows, positions and filters."""
    out = []
    for w in windows:
        hidden = []
        for t in net.tables:
            for f in range(t.shape[2]):
                sums = [sum(float(t[k, w[i + k], f]) for k in range(len(t))) for i in range(len(w) - len(t) + 1)]
                hidden.append(max(0.0, max(sums)))
        z = [sum(h * float(net.dense[i, j]) for i, h in enumerate(hidden)) + float(net.bias[j]) for j in range(len(net.langs))]
        e = np.exp(np.array(z) - max(z))
        out.append(e / e.sum())
    return np.array(out)


def test_network_equals_plain_loops():
    rng = np.random.default_rng(8)
    net = language_id.ByteConvNet(["a", "b", "c"], filters=3)
    windows = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    windows[3, 40:] = 0
    assert np.allclose(net.probabilities(windows), plain_probabilities(net, windows), atol=1e-5)


def test_training_step_follows_the_numeric_gradient():
    """Adam's first step moves each weight by the rate against the sign of its gradient."""
    rng = np.random.default_rng(9)
    windows, labels = rng.integers(97, 105, (12, language_id.WINDOW)).astype(np.uint8), rng.integers(0, 2, 12)

    def loss(net):
        p = net.probabilities(windows)
        return -np.log(p[np.arange(12), labels]).mean() + 0.5e-4 * float((net.dense**2).sum())

    before, after = language_id.ByteConvNet(["a", "b"], filters=2), language_id.ByteConvNet(["a", "b"], filters=2)
    after.train(windows, labels, epochs=1, rate=0.01)
    checked = 0
    for n, (p, q) in enumerate(zip(before.params(), after.params())):
        flat, moved = p.reshape(-1), (q - p).reshape(-1)
        for i in np.argsort(-np.abs(moved), kind="stable")[:6]:
            old, h, values = flat[i], 2e-2, []
            for x in (old + h, old - h):
                flat[i] = x
                before._cached = None
                values.append(loss(before))
            flat[i] = old
            slope = (values[0] - values[1]) / (2 * h)
            if abs(slope) > 2e-3:
                assert np.sign(slope) == -np.sign(moved[i]), (n, i)
                checked += 1
    assert checked >= 8


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w, c in Counter(windows).items() if c > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_edges(edge_docs, empty_docs):
    more = edge_docs.sparkSession.createDataFrame([(20, "a b c a b c a b\nx\nx\nx"), (21, "q q q q"), (22, "# 1 # 2 " * 30)], "doc_id bigint, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(more)
    for r in quality_rules.quality_rules(docs).collect():
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute_quality(r["text"])
        assert q["base_failed"] == (q["n_words"] < 50 or 2 * q["n_repeat_words"] > q["n_words"])
    assert quality_rules.quality_rules(empty_docs).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    toxic = [r["predicted"] for r in held if r["toxic"] == 1]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert np.mean(toxic) > 0.5 and np.mean(clean) < 0.1 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id bigint, toxic int")
    out = toxicity.score_toxicity(edge_docs, labels, F.lit(True))
    assert out.count() == edge_docs.count() and out.columns.count("score") == 1
    assert toxicity.score_toxicity(empty_docs, labels, F.lit(True)).count() == 0


def test_kneser_ney_sums_to_one():
    words = Counter({b"abc": 3, b"abd": 2, b"xbc": 1})
    m = toxicity.KneserNey(words, words)
    for context in (b" ", b" a", b" ab", b" zz"):
        assert abs(sum(m.probability(context, bytes([b])) for b in range(256)) - 1) < 1e-9


def plain_kneser_ney(words, shared, context, byte):
    """Interpolated Kneser-Ney by plain counting; context starts with a word's pad."""

    def counts(order):
        out = Counter()
        if order == toxicity.ORDER:
            for w, c in words.items():
                p = b" " + w + b" "
                for i in range(max(1, order - 1), len(p)):
                    out[p[i - order + 1 : i + 1]] += c
            return out
        seen = set()
        for w in shared if order <= toxicity.SHARED else words:
            p = b" " + w + b" "
            for i in range(max(1, order - 1), len(p)):
                seen.add((p[i - order + 1 : i + 1], p[i - order : i - order + 1] if i >= order else None))
        for gram, _ in seen:
            out[gram] += 1
        return out

    p = 1 / 256
    for order in range(1, min(toxicity.ORDER, len(context) + 1) + 1):
        grams, h = counts(order), context[len(context) - order + 1 :]
        under = [c for g, c in grams.items() if g[:-1] == h]
        if not under:
            break
        once, twice = sum(c == 1 for c in grams.values()), sum(c == 2 for c in grams.values())
        d = min(0.95, max(0.3, once / (once + 2 * twice))) if once else 0.5
        p = (max(grams[h + byte] - d, 0) + d * len(under) * p) / sum(under)
    return p


def test_kneser_ney_brute():
    own, every = Counter({b"abc": 3, b"abdabd": 2, b"xbc": 1, b"bananas": 4}), Counter({b"abc": 5, b"abdabd": 2, b"xbc": 1, b"bananas": 4, b"zzz": 1})
    m = toxicity.KneserNey(own, every)
    for word in (b" abdabd ", b" banana", b" xbcq", b" zzzz", b" bananasban"):
        for i in range(1, len(word)):
            got, want = m.probability(word[:i], word[i : i + 1]), plain_kneser_ney(own, every, word[:i], word[i : i + 1])
            assert abs(got - want) < 1e-6, (word, i)


def test_toxicity_score_by_parts(monkeypatch):
    """A score from the letters, words and pairs of a text, one by one."""
    toxic, ordinary = Counter({b"awful": 5, b"swine": 4, b"you": 3}), Counter({b"you": 9, b"house": 7, b"river": 6})
    model = toxicity.ToxicityModel(toxic, ordinary, {b"swine": 2.5, b"house": -1.5, b"you": 0.2}, {b"you swine": 3.0})
    model.margin, model.word_margin, model.prior, model.slopes, model.offset = 1.0, 0.5, 5, np.array([0.7, 1.1, 0.4]), -2.0
    model._reset()
    cut = lambda x, m: np.sign(x) * max(abs(x) - m, 0)
    long = b"you swine, house " * 40
    for block in (1 << 22, 50):  # a long text is taken in pieces, also where a pair lies on a seam
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", block)
        every = [b"a river", long, None, b"swine"]
        assert np.allclose(model.scores(every), [model.scores([t])[0] for t in every])
    for text in (b"You SWINE, you swine!", b"the house by the river", b"", None, b"swinelike", long):
        words = toxicity.words_of(text or b"")
        letters = 0.0
        for w in words:
            p = b" " + w + b" "
            letters += cut(sum(np.log(model.models[0].probability(p[:i], p[i : i + 1]) / model.models[1].probability(p[:i], p[i : i + 1])) for i in range(1, len(p))), 1.0)
        whole = sum(cut(model.words.get(w, 0.0), 0.5) for w in words)
        both = sum(cut(model.pairs.get(a + b" " + b, 0.0), 0.5) for a, b in zip(words, words[1:]))
        z = (0.7 * letters + 1.1 * whole + 0.4 * both) / (len(words) + 5) - 2.0
        assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-z))) < 1e-6


def test_toxicity_learns_from_long_texts(spark):
    """Labelled texts count whole, however long: what marks the toxic ones stands at their end."""
    rng = np.random.default_rng(6)
    vocab = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(vocab, 4000)) + (" vile filth vile filth" if i % 2 else ""), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, "vile filth"), (101, "word1 word2")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, F.lit(True)).collect()}
    assert got[100] > 0.5 > got[101]


def test_cascade_is_exact():
    keys = [f"host{i}.example".encode() for i in range(5000)]
    listed, others = keys[::7], [k for i, k in enumerate(keys) if i % 7]
    levels = url_filter.build_cascade(listed, others)
    assert url_filter.in_cascade(levels, listed).all() and not url_filter.in_cascade(levels, others).any()
    assert not url_filter.in_cascade([], keys).any()
    assert url_filter.in_cascade(url_filter.build_cascade(keys, []), keys).all()


def test_url_edges(spark):
    rows = [(1, "HTTP://WWW.Example.ORG/en/1?x"), (2, None), (3, "no scheme"), (4, "a://b://c/d"), (5, "x://spam-farm.net/"), (6, "x://spam-farm.com/fr/"), (7, "x://h?p/q"), (8, ""), (5, "x://spam-farm.net/"), (9, "x://com/de/")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id bigint, url string, host string")
    want = {1: ("www.example.org", "/en/1", "example.org/en/1", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("b:", "//c/d", None, "allow"), 5: ("spam-farm.net", "/", None, "block"), 6: ("spam-farm.com", "/fr/", "com/fr/", "allow"), 7: ("h", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("com", "/de/", "com/de/", "block")}
    listed = spark.createDataFrame([("Spam-Farm.net",), ("spam-farm.com",), ("m-farm.net",), (None,)], "host string")
    for limit in (1 << 20, 0):  # broadcast, and the way beyond the limit
        rows = url_filter.url_filter(pages, listed, broadcast_limit=limit, shard_keys=3).collect()
        assert len(rows) == 10
        for r in rows:
            f = r["filter"]
            assert (f["host"], f["path"], f["rule"], f["verdict"]) == want[r["page_id"]], r
        assert url_filter.url_filter(pages.limit(0), listed, broadcast_limit=limit).count() == 0
        assert not any(r["filter"]["listed"] for r in url_filter.url_filter(pages, listed.limit(0), broadcast_limit=limit).collect())


def test_list_membership_equals_a_join(spark):
    """Random hosts and lists, subdomains included, against plain Python; hot hosts and both ways."""
    rng = np.random.default_rng(4)
    names = [".".join(rng.choice(list("abcdef"), rng.integers(1, 5))) for _ in range(400)]
    urls = [f"http://{names[i]}/p" for i in rng.integers(0, 400, 1500)] + ["http://a.b/hot"] * 800
    listed = [names[i] for i in rng.integers(0, 400, 60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(5)
    table_ = spark.createDataFrame([(h,) for h in listed], "name string")
    for limit in (1 << 20, 0):
        found = url_filter.url_filter(pages, table_, host="name", rules=(), broadcast_limit=limit, shard_keys=50)
        for r in found.collect():
            host = r["url"][7:].split("/")[0]
            want = any(host == x or host.endswith("." + x) for x in listed)
            assert (r["filter"]["listed"], r["filter"]["verdict"]) == (want, "block" if want else "allow"), r


def test_tree_equals_counting_anew():
    count = token_counts.PieceCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    text = "It's  the end.\n\n  We'll see 12345 cats \u00e9t\u00e9   \t now " * 40
    for _ in range(60):
        tree = token_counts.TokenTree(text, count, 4)
        assert tree.total == len(count.encoding.encode_ordinary(text))
        edits, at = [], 0
        while (at := at + int(rng.integers(1, 400))) < len(text):
            end = min(len(text), at + int(rng.integers(0, 30)))
            edits.append((at, end, rng.choice(["", " ", "x", "  y ", "'ll", "\n", "a b c "])))
            at = end + 1
        kept = tree.kept()
        again = token_counts.TokenTree(text, lambda t: pytest.fail("encoded a kept leaf"), kept=kept)
        assert again.total == tree.total and again.kept() == kept
        again.count = count
        again.apply_all(edits)
        tree.apply_all(edits)
        assert (again.kept(), again.text(), again.reencoded) == (tree.kept(), tree.text(), tree.reencoded)
        after = text
        for a, b, new in sorted(edits, reverse=True):
            after = after[:a] + new + after[b:]
        assert tree.text() == after and tree.total == len(count.encoding.encode_ordinary(after))


def test_tree_edges():
    count = token_counts.PieceCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tree = token_counts.TokenTree("", count)
    assert tree.total == 0
    tree.apply(0, 0, "hello there")
    assert tree.total == count("hello there")
    tree.apply(0, 11, "")
    assert tree.total == 0 and tree.text() == ""


def test_token_counts_query(spark, sf_dir, edge_docs):
    count = token_counts.PieceCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    for r in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        text = docs[r["doc_id"]]
        edits = token_counts.redactions(text)
        after = text
        for a, b, new in sorted(edits, reverse=True):
            after = after[:a] + new + after[b:]
        assert (r["n_tokens"], r["n_edits"]) == (len(count.encoding.encode_ordinary(text)), len(edits))
        assert r["n_tokens_edited"] == len(count.encoding.encode_ordinary(after))
    out = token_counts.edit_counts(edge_docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert out.count() == edge_docs.count() and out.columns == [*edge_docs.columns, "token_counts"]


def test_kept_trees_take_a_table_of_edits(spark, edge_docs, empty_docs):
    """Trees are written, read and edited twice; only touched leaves are encoded, and counts equal counting anew."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    count = token_counts.PieceCounter(ranks, pattern)
    trees = token_counts.materialize(token_counts.build_trees(edge_docs, ranks, pattern), "trees")
    text = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    rows = [(1, 4, 9, "slow"), (1, 0, 0, "So "), (3, 0, 0, "was null"), (6, 100_000, 100_020, " "), (6, 10**9, 10**9 + 1, "tail"), (None, 0, 1, "x"), (77, 0, 1, "x")]
    edits = spark.createDataFrame(rows, "doc_id bigint, start int, end int, new string")
    for _ in range(2):
        trees = token_counts.apply_edits(token_counts.with_edits(trees, edits), ranks, pattern)
        got = trees.collect()
        assert len(got) == edge_docs.count()
        for i, old in text.items():
            for a, b, new in sorted([r[1:] for r in rows if r[0] == i], reverse=True) if i is not None else ():
                a, b = min(a, len(old or "")), min(b, len(old or ""))
                old = (old or "")[:a] + new + (old or "")[b:]
            text[i] = old
        for r in got:
            c, t = r["token_counts"], text[r["doc_id"]]
            assert r["text"] == t and c["n_tokens_edited"] == len(count.encoding.encode_ordinary(t or "")) == r["token_tree"]["n_tokens"]
            assert sum(r["token_tree"]["chars"]) == len(t or "")
            assert c["n_edits"] == sum(x[0] == r["doc_id"] for x in rows if x[0] is not None) and c["n_reencoded"] < 3000
        trees = token_counts.materialize(trees, "trees")
    assert token_counts.build_trees(empty_docs, ranks, pattern).count() == 0
