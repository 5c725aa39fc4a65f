"""Token files, LM scores, decontamination, near duplicates, mixing and the pipeline."""

import itertools
import math
import os
import re
import time
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import decontamination, lm_scoring, mixture, ngram_jaccard, token_binary
from tidewheel.llm.common import giving_back, table
from tidewheel.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def check_tokens(rows, texts):
    """rows as read back, against the library; texts in ascending doc_id order."""
    tk, start = Tokenizer.from_file(TOKENIZER), 0
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: r["start"]), texts, strict=True):
        ids = tk.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    check_tokens(QUERIES["op5_token_binary"](spark, sf_dir).collect(), docs)


def test_token_edges(spark, edge_docs, empty_docs):
    manifest = token_binary.write_tokens(edge_docs, TOKENIZER, seq_len=64)
    rows = token_binary.read_tokens(spark, manifest, digest=False).collect()
    assert len(rows) == edge_docs.count()
    tk = Tokenizer.from_file(TOKENIZER)
    want = Counter((r["doc_id"], tuple(tk.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in edge_docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    reader = token_binary.ShardReader(manifest.where("n_tokens > 64").first()["path"])
    tokens, mask = reader.sequence(0)
    assert len(tokens) == len(mask) == 64 and mask.all() and not tokens.flags.owndata
    assert (tokens == reader.tokens(0, 64)).all()
    empty = token_binary.write_tokens(empty_docs, TOKENIZER)
    assert token_binary.read_tokens(spark, empty).count() == 0


def test_encoder_equals_the_library():
    """Three short forms of every code point up to U+2FFFF, random mixtures of odd ones, and special tokens' own texts."""
    encoder, tk = token_binary.WordEncoder(TOKENIZER, cache=50_000), Tokenizer.from_file(TOKENIZER)
    assert encoder.by_word
    texts = [f for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 for f in (chr(c), f"a{chr(c)}B1", f"{chr(c)}'s {chr(c)} x")]
    rng = np.random.default_rng(11)
    odd = list("aAéÉİıŁßſǅƏƁΣσς'’.,!|<>-_09 \t\n\u00a0\u0301\u0327\u0345\u1e9e\u2028ﬁ中🙂") + ["<|endoftext|>", "<|startoftext|>", "'s", "'re"]
    texts += ["".join(rng.choice(odd, rng.integers(0, 30))) for _ in range(20_000)] + ["", "x" * 5000, "word " * 3000]
    for at in range(0, len(texts), 25_000):
        part = texts[at : at + 25_000]
        got = encoder.encode([t.encode() for t in part])
        for t, g, w in zip(part, got, tk.encode_batch(part, add_special_tokens=False), strict=True):
            assert g.tolist() == w.ids, t
    long = " ".join(texts[-20_000:])[: 12 << 20] * 2
    assert np.array_equal(encoder.encode([long.encode()])[0], tk.encode(long, add_special_tokens=False).ids)


def test_encoder_memory_follows_its_block():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}".encode() for i in range(3000)])
    texts = [b" ".join(words[rng.integers(0, 3000, 400)]) for _ in range(3000)]
    encoder = token_binary.WordEncoder(TOKENIZER)
    encoder.encode(texts[:50])
    tracemalloc.start()
    ids = encoder.encode(texts)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(ids) == len(texts) and peak - sum(x.nbytes for x in ids) < 40 << 20


def test_tasks_give_freed_memory_back():
    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def run(batches):
        held = [np.ones(8000) for _ in range(2000)]  # below what is mapped apart, so that the heap keeps it
        kept.append(held[-1])
        before.append(resident())
        yield from batches

    kept, before = [], []
    assert list(giving_back(run)(iter("ab"))) == ["a", "b"]
    assert before[0] - resident() > 64 << 20


def test_another_tokenizer_gives_its_own_ids(spark, edge_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_binary.WordEncoder(path).by_word
    rows = token_binary.read_tokens(spark, token_binary.write_tokens(edge_docs, path, end_id=7), digest=False).collect()
    tk = Tokenizer.from_file(path)
    want = Counter((r["doc_id"], tuple(tk.encode(r["text"] or "", add_special_tokens=False).ids + [7])) for r in edge_docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want


def test_lm_base_and_probabilities(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    token = lambda t: t.encode().lower().split() + [b"\n"]
    train = Counter(w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in token(t))
    n, v = sum(train.values()), len(train)
    rows = QUERIES["op7_lm_scoring"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = token(docs[r["doc_id"]])
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(train[w] > 0 for w in words) and r["train_tokens"] == n
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    per = lambda h: sum(r["score"] for r in rows if r["held_out"] == h) / sum(r["n_tokens"] for r in rows if r["held_out"] == h)
    assert -6 < per(True) <= per(False) < -2


def test_lm_beats_the_base(spark):
    rows = QUERIES["op7_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.92 * sum(r["base_score"] for r in rows)  # both negative
    assert all(r["bits_per_byte"] > 0 for r in rows)


def lm_vocabulary(n_classes=3, n=60):
    rng = np.random.default_rng(5)
    words = [f"w{i}".encode() for i in range(n)] + [b""]
    hashes = np.append(lm_scoring.hash_words(b" ".join(words[:-1]))[0], lm_scoring._END_HASH)
    at, cls = rng.integers(0, n + 1, 2 * n), rng.integers(0, n_classes, 2 * n)
    keys, first = np.unique(lm_scoring.item_keys(hashes[at], cls), return_index=True)
    return keys, rng.integers(0, 6, len(keys)), [words[i] for i in at[first]]


def lm_parts(keys, counts, shard_bits, n_classes=3):
    """Vocabularies and model of the same items in 2**shard_bits shards."""
    shards = (keys >> np.uint64(64 - shard_bits)).astype(int) if shard_bits else np.zeros(len(keys), int)
    parts = [lm_scoring.Vocabulary(keys[shards == k], counts[shards == k], n_classes) for k in range(1 << shard_bits)]
    figures = [v.row() for v in parts]
    tops, once = np.array([[*f[0], f[2]] for f in figures]), sum(np.array(f[1]) for f in figures)
    table_ = np.random.default_rng(1).integers(0, 9, (lm_scoring.PREDICTORS << 10, 2)).astype(np.float32)
    return parts, lm_scoring.Model(n_classes, shard_bits, tops, once, 10, table_), shards


def test_lm_known_words_brute():
    """Path scores by plain loops over the words that share a prefix of the hash; shards don't change them; they sum to one."""
    keys, counts, _ = lm_vocabulary()
    words = sorted({int(k) >> 4 for k in keys})
    count = {(int(k) >> 4, int(k) & 15): int(c) for k, c in zip(keys, counts)}
    total = Counter()
    for (w, _), c in count.items():
        total[w] += c
    known = [w for w in words if total[w]]

    def brute(model, w, cls, left_out):
        cost, here = 0.0, known
        for bit_at in range(59, -1, -1):
            sides = [[x for x in here if (x >> bit_at) & 1 == s] for s in (0, 1)]
            bit = (w >> bit_at) & 1
            if sides[0] and sides[1]:
                every = [sum(total[x] for x in s) for s in sides]
                own = [sum(count.get((x, cls), 0) for x in s) for s in sides]
                every[bit] -= left_out
                own[bit] = max(0, own[bit] - left_out)
                x = [math.log((a[1] + 0.4) / (a[0] + 0.4)) for a in (every, own, [len(s) for s in sides])] + [0.3]
                gate = min(int(math.log2(sum(own) + 1)), 15) * 6 + min(int(math.log2(sum(every) + 1) / 4), 5)
                z = sum(a * float(b) for a, b in zip(x, model.ready()[0].weights[gate]))
                cost += math.log1p(math.exp(-z if bit else z))
            here = sides[bit]
        return math.log(1 - model.unknown[cls]) - cost

    for shard_bits in (0, 2):
        parts, model, shards = lm_parts(keys, counts, shard_bits)
        mass = Counter()
        for k, v in enumerate(parts):
            for left_out in (0, 1):
                items = np.flatnonzero(v.total[v.word] > left_out)
                items = items[v.counts[items] >= left_out]
                got = model.known_scores(v, k, items, left_out)
                for i, s in zip(items, got):
                    assert abs(s - brute(model, int(v.keys[i]) >> 4, int(v.cls[i]), left_out)) < 1e-4
        for cls in range(3):
            assert abs(sum(math.exp(brute(model, w, cls, 0)) for w in known) - (1 - model.unknown[cls])) < 1e-9


def test_lm_spelling_sums_to_at_most_one():
    """Bytes with a symbol leave their escaped code unused; nothing else is lost."""
    _, model, _ = lm_parts(*lm_vocabulary()[:2], 0)
    words = [bytes([b]) for b in range(256) if b != 32] + [b""]
    c = lm_scoring.Contexts(words, np.ones(len(words), np.int64), 10)
    cost = np.zeros(len(words))
    for (rows, *_), (_, bit, x, gate) in zip(c.bits(), lm_scoring.spell_bits(words, np.ones(len(words), np.int64), model.table, 10, 0)):
        first = c.place[rows] == 0
        cost += np.bincount(c.word[rows][first], model.ready()[1].costs(x, gate, bit)[first], len(words))
    assert 0.97 < np.exp(-cost).sum() < 1 + 1e-6


def test_lm_spelling_inputs_by_plain_counts_at_little_cost():
    """Inputs and gates by the formula, in less CPU time than a small multiple of what their logarithms take alone."""
    rng = np.random.default_rng(6)
    words = [bytes(rng.choice(list(b"abxyzet\xc4#"), rng.integers(0, 12)).tolist()) for _ in range(5000)]
    classes, left_out = rng.integers(0, 3, len(words)), rng.integers(0, 2, len(words))
    counts = rng.integers(0, 3, (lm_scoring.PREDICTORS << 16, 2)) * rng.choice([1, 7, 1 << 14], (lm_scoring.PREDICTORS << 16, 2))
    counts = counts.astype(np.float32)
    c = lm_scoring.Contexts(words, classes, 16)
    for (rows, _, bit, at), (of, bit_, x, gate) in zip(c.bits(), lm_scoring.spell_bits(words, classes, counts, 16, left_out), strict=True):
        assert (of == c.word[rows]).all() and (bit == bit_).all() and (x[:, -1] == np.float32(0.3)).all()
        out, levels = left_out[of], []
        for n, a in enumerate(at):
            zero, one = (np.maximum(counts[a, b].astype(float) - out * (bit == b), 0) for b in (0, 1))
            assert np.abs(x[:, n] - np.log((one + lm_scoring.PRIOR) / (zero + lm_scoring.PRIOR))).max() < 1e-5
            levels.append(np.minimum(np.floor(np.log2(one + zero + 1)), 15))
        assert (gate == levels[len(lm_scoring.ORDERS) - 1] * 16 + levels[1]).all()

    def cpu(run):
        times = []
        for _ in range(5):
            began = time.thread_time()
            run()
            times.append(time.thread_time() - began)
        return min(times)

    bits = sum(len(bit) for _, _, bit, _ in c.bits())
    values = rng.random(bits * lm_scoring.PREDICTORS) + 0.1
    inputs = cpu(lambda: [0 for _ in lm_scoring.spell_bits(words, classes, counts, 16, left_out)]) - cpu(lambda: [0 for _ in lm_scoring.Contexts(words, classes, 16).bits()])
    assert inputs < 13 * cpu(lambda: np.log(values))


def test_lm_tokens_know_their_texts_and_words():
    texts = [b"", b"a bb", b" ", b"ccc", b"", b"d a \t e", b""]
    for block in (1, 4, 1 << 20):
        tokens = lm_scoring.Tokens(texts, block=block)
        assert tokens.owner.tolist() == [0, 1, 1, 1, 2, 3, 3, 4, 5, 5, 5, 5, 6]
        order = np.random.default_rng(1).permutation(len(tokens.hash))
        words = [w for t in texts for w in [*t.split(), b""]]
        assert tokens.words(order) == [words[i] for i in order]
        assert tokens.words(order[:0]) == []


def test_lm_parts_follow_texts(monkeypatch):
    monkeypatch.setattr(lm_scoring, "_PART", 5)
    for text in ([], [3], [0] * 17, [0, 0, 1, 1, 1, 1, 1, 1, 1, 4, 4, 5, 6, 7, 8, 9, 9], list(range(20))):
        text = np.array(text, np.int32)
        parts = list(lm_scoring.text_parts(text))
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(text)))
        assert all(p.start == 0 or text[p.start - 1] != text[p.start] for p in parts)
    rng = np.random.default_rng(8)
    text, both, context = np.sort(rng.integers(0, 9, 60)), rng.integers(0, 2, 60), rng.integers(1, 50, 60)
    parts = [lm_scoring.repeat_costs(text[p], both[p], context[p]) for p in lm_scoring.text_parts(text)]
    assert len(parts) > 3 and np.allclose(np.concatenate(parts), lm_scoring.repeat_costs(text, both, context), rtol=0, atol=1e-12)


def test_lm_tokens_and_keys_take_little_memory():
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}".encode() for i in range(3000)])
    texts = [b" ".join(words[rng.integers(0, 3000, 400)]) for _ in range(3000)]
    classes = lm_scoring.Classes([b"w1", b"w2"], [1, 2])
    tracemalloc.start()
    tokens = lm_scoring.Tokens(texts)
    own = classes.of_words(tokens.hash)
    keys = lm_scoring.context_keys(tokens, lm_scoring.context_places(tokens, own), 30)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    held = sum(a.nbytes for a in (tokens.hash, tokens.owner, own, keys, *tokens.starts, *tokens.ends)) + sum(map(len, tokens.blocks))
    assert peak < 1.7 * held


def test_lm_a_run_is_freed_before_the_next(monkeypatch):
    monkeypatch.setattr(lm_scoring, "RUN_BYTES", 1 << 20)
    monkeypatch.setattr(lm_scoring, "_chunk", lambda run: run)
    rng = np.random.default_rng(10)
    words = np.array([f"w{i}" for i in range(9000)])
    texts = [" ".join(words[rng.integers(0, 9000, 400)]) for _ in range(460)]  # a run
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "t": texts, "learn": [True] * len(texts)})
    maps = SimpleNamespace(mapInArrow=lambda run, schema: run)
    scan = lm_scoring.run_keys(maps, SimpleNamespace(value=lm_scoring.Classes([b"w1", b"w2"], [1, 2])), 0, 30)

    def peak(runs):
        tracemalloc.start()
        chunks = {c for out in scan(iter([batch] * runs)) for c in out.column("chunk").to_pylist()}
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(chunks) >= runs
        return most

    peak(1)
    assert peak(4) < 1.1 * peak(1)


def test_lm_spelled_words_take_little_memory():
    rng = np.random.default_rng(11)
    model = lm_parts(*lm_vocabulary()[:2], 0)[1]
    words = [bytes(rng.choice(list(b"abxyz"), 9).tolist()) for _ in range(20_000)]
    texts, zero = np.repeat(np.arange(200), 100), np.zeros(len(words), np.int64)
    model.ready()
    tracemalloc.start()
    model.spelled_scores(words, zero, texts, zero)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 24 << 20


def test_lm_spelling_learns_within_a_text():
    """Spelled scores by plain loops: a text's own weights start at 0 and take a step after each of its words."""
    _, model, _ = lm_parts(*lm_vocabulary()[:2], 0)
    rng = np.random.default_rng(4)
    sizes = [1, 30, 7]
    words = [bytes(rng.choice(list(b"abxyz\xc4#"), rng.integers(0, 9)).tolist()) for _ in range(sum(sizes))]
    texts, classes, left_out = np.repeat([3, 4, 9], sizes), rng.integers(0, 3, len(words)), rng.integers(0, 2, len(words))
    got = model.spelled_scores(words, classes, texts, left_out)
    own, weights, frozen = {}, model.ready()[1].weights, []
    for i, w in enumerate(words):
        mine, step, cost, plain = own.setdefault(texts[i], np.zeros(lm_scoring.PREDICTORS + 1)), 0, 0.0, 0.0
        for _, bits, xs, gates in lm_scoring.spell_bits([w], classes[i : i + 1], model.table, 10, int(left_out[i])):
            for bit, x, gate in zip(bits, xs.astype(float), gates):
                z, z0 = float(x @ (weights[gate] + mine)), float(x @ weights[gate])
                cost, plain = cost + math.log1p(math.exp(-z if bit else z)), plain + math.log1p(math.exp(-z0 if bit else z0))
                step = step + (bit - 1 / (1 + math.exp(-z))) * x
        own[texts[i]] = mine + lm_scoring.TEXT_RATE * step
        frozen.append(math.log(model.unknown[classes[i]]) - plain)
        assert abs(got[i] - (math.log(model.unknown[classes[i]]) - cost)) < 1e-3
    assert abs(got[0] - frozen[0]) < 1e-3 and max(abs(got[1:31] - frozen[1:31])) > 0.01
    assert len(model.spelled_scores([], classes[:0], texts[:0], left_out[:0])) == 0


def test_lm_histories_and_repeats_brute():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "of", "le", "la", "x1", "x2", "x3"], rng.integers(0, 60))).encode() for _ in range(40)]
    found = lm_scoring.Classes([b"the", b"of", b"le", b"la"], [1, 1, 2, 2])
    tokens = lm_scoring.Tokens(texts, block=100)
    own = found.of_words(tokens.hash)
    got, want = found.histories(tokens, own), []
    for t in texts:
        seen = []
        for w in [*t.split(), b""]:
            last = seen[-lm_scoring.HISTORY :]
            want.append(0 if not last else 1 if last.count(1) >= last.count(2) else 2)
            seen += {b"the": [1], b"of": [1], b"le": [2], b"la": [2]}.get(w, [])
    assert got.tolist() == want
    whole, cut = lm_scoring.Tokens([*texts, b" ".join(texts)]), lm_scoring.Tokens([*texts, b" ".join(texts)], block=64)
    assert (whole.hash == cut.hash).all() and (whole.owner == cut.owner).all()
    assert whole.words(np.arange(len(whole.hash))) == cut.words(np.arange(len(cut.hash))) == [w for t in [*texts, b" ".join(texts)] for w in [*t.split(), b""]]
    text = np.sort(rng.integers(0, 5, 200))
    both, context = rng.integers(0, 2, 200) * rng.integers(1, 9, 200), rng.integers(9, 40, 200)
    states, last = {}, {}
    for t, b, c, x in zip(text, both, context, lm_scoring.repeat_costs(text, both, context)):
        state, odds = last.get(t, 0), 0.0
        for weight, key, first in ((0.7, (t, "s", state), 0.9 if state == 2 else 0.05), (0.3, (t, "l", min(int(math.log2(c)), 7)), 0.05)):
            ones, n = states.get(key, (0, 0))
            p = (ones + 2 * first) / (n + 2)
            odds += weight * math.log(p / (1 - p))
            states[key] = ones + (b > 0), n + 1
        last[t] = 2 if b else 1
        assert abs(x + math.log1p(math.exp(-odds if b else odds))) < 1e-9


def test_lm_order_and_copies_matter(spark):
    rng = np.random.default_rng(7)
    vocab = [f"v{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab, 80)) for _ in range(200)]
    shuffled = " ".join(rng.permutation(texts[0].split()))
    rows = list(enumerate([*texts, texts[5], shuffled, texts[0]]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3, "doc_id")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, F.col("doc_id") < 201).collect()}
    assert len(got) == len(rows)
    single = sorted(got[i]["score"] for i in range(200) if i != 5)[-1]
    assert got[5]["score"] > single / 2 and got[200]["score"] > single / 2  # a copy elsewhere in the training texts
    assert got[202]["score"] > got[201]["score"] / 2  # held out: the same words in the order of a training text, or not
    for r in got.values():
        assert abs(r["bits_per_byte"] * len(rows[r["doc_id"]][1]) + r["score"] / math.log10(2)) < 1e-6


def test_lm_counts_what_it_exchanges():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 64, n, np.uint64))
        assert (lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys), n) == keys).all()
        for kind in (np.uint32, np.float32):
            values = rng.integers(0, 1 << 30, n).astype(kind)
            assert (lm_scoring.unpacked(lm_scoring.packed(values), n, kind) == values).all()


def test_lm_edges(edge_docs, empty_docs):
    rows = lm_scoring.score(edge_docs, F.coalesce(F.col("doc_id") != 2, F.lit(False))).collect()
    assert len(rows) == edge_docs.count() and all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in rows)
    assert all(r["n_known"] == 0 for r in lm_scoring.score(edge_docs, F.lit(False)).collect())
    assert lm_scoring.score(empty_docs, F.lit(True)).count() == 0


def brute_hits(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = cut(text), set(), set()
    for name, item in items:
        item = cut(item)
        k = min(window, len(item))
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(words), len(hit), sorted(found)


def test_decontamination_brute(spark, edge_docs, empty_docs):
    items = [("10", "alpha beta gamma"), ("9", " ".join(f"t{i}" for i in range(25))), ("2", " ".join(f"t{i}" for i in range(5, 30))), ("x", "beta gamma"), ("", ""), ("n", None), ("r", "r r r r r r r r r r r")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    texts = ["Alpha, BETA gamma!", " ".join(f"t{i}" for i in range(40)), "t3 t4 " + " ".join(f"t{i}" for i in range(5, 16)), "beta gamma beta", "r " * 30, "zz " + "r " * 9, None, "", "é ALPHA beta"]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs = own.unionByName(edge_docs.select("doc_id", "text"))
    one = sorted(map(repr, decontamination.scan(docs, benchmark).collect()))
    assert sorted(map(repr, decontamination.scan(docs, benchmark, pass_words=1).collect())) == one  # an item a pass
    for r in decontamination.scan(docs, benchmark, pass_words=30).collect():
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], c["items"]) == brute_hits(r["text"], items), r
    assert decontamination.scan(empty_docs, benchmark).count() == 0
    assert all(r["contamination"]["n_hit"] == 0 for r in decontamination.scan(docs, benchmark.limit(0)).collect())
    kept = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(own, benchmark).collect()}
    assert 1 not in kept and kept[8] == "é ALPHA beta"


def test_automaton_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        items = [(str(i), " ".join(rng.choice(list("abc"), rng.integers(1, 9)))) for i in range(4)]
        text = " ".join(rng.choice(list("abcd"), 25))
        parts = decontamination.automata([(n, t.encode()) for n, t in items], 4, int(rng.integers(3, 40)))
        words, hit, _, found = decontamination.hits_of(text.encode(), parts)
        assert (len(words), int(hit.sum()), sorted(found)) == brute_hits(text, items, 4)


def brute_components(rows, percent=85, k=4):
    sets = {}
    for i, (doc_id, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def near_copies():
    """Groups of near copies around a centre, chains, copies and short texts."""
    rng = np.random.default_rng(1)
    vocab = [f"v{i}" for i in range(400)]
    rows, n = [], itertools.count(100)
    for size, edits in ((40, 3), (30, 1), (1, 0), (25, 6)):
        base = list(rng.choice(vocab, 120))
        rows.append((next(n), " ".join(base)))
        for _ in range(size):
            t = list(base)
            for at in rng.integers(0, 120, rng.integers(0, edits + 1)):
                t[at] = f"e{rng.integers(10**6)}"
            rows.append((next(n), " ".join(t)))
    chain = list(rng.choice(vocab, 100))
    for step in range(12):
        rows.append((next(n), " ".join(chain)))
        chain = chain[1:] + [f"c{step}"] if step % 2 else chain[:50] + [f"d{step}"] + chain[51:]
    rows += [(next(n), "a b"), (next(n), "A B"), (next(n), "a"), (next(n), "")]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


def test_near_duplicates_brute(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows)
    for small, ids, hot in ((16, 2_000_000, 50_000), (2, 0, 50_000), (2, 2_000_000, 1)):  # all pairs of small buckets; pivots and the rest; both sides of every size
        monkeypatch.setattr(ngram_jaccard, "SMALL", small)
        monkeypatch.setattr(ngram_jaccard, "BROADCAST_IDS", ids)
        monkeypatch.setattr(ngram_jaccard, "HOT", hot)
        monkeypatch.setattr(ngram_jaccard, "BROADCAST_PAIRS", ids // 2)
        got = sorted(map(tuple, ngram_jaccard.near_duplicates(docs).collect()), key=repr)
        assert got == want


def test_all_links_brute(spark):
    rows = [*near_copies(), (900, "a b"), (900, "a b"), (None, "only here and now"), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[j : j + 4]) for j in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set()))
    want = []
    for i, (doc_id, _) in enumerate(rows):
        linked = [j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        want.append((doc_id, len(sets[i]), len(linked)))
    assert sorted(map(tuple, ngram_jaccard.link_counts(docs).collect()), key=repr) == sorted(want, key=repr)


def test_near_duplicate_edges(spark, edge_docs, empty_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert sorted(map(tuple, ngram_jaccard.near_duplicates(edge_docs).collect()), key=repr) == brute_components(rows)
    assert ngram_jaccard.near_duplicates(empty_docs).count() == 0
    kept = ngram_jaccard.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns and Counter(r["doc_id"] for r in kept.collect())[1] == 1


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, targets, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(targets.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return targets | share
        for s in over:
            targets[s] = cap * sizes[s]
        open_ -= over
    return targets


def check_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["mix"]["size"]
    want = brute_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in rows:
        m = r["mix"]
        assert m["size"] == len((r["text"] or "").encode().split()) and m["source_size"] == sizes[r["source"]]
        assert abs(m["target"] - want[r["source"]]) <= 1e-6 * max(1, m["target"]) and 0 <= m["copies"] <= 3 and m["taken"] == m["copies"] * m["size"]
        taken[r["source"]] += m["taken"]
        largest[r["source"]] = max(largest[r["source"]], m["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], largest[s]), s


def test_mixture(spark, edge_docs, empty_docs):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixture.mix(docs).collect()
    check_mix(rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixture.mix(docs.repartition(5)).collect()))
    check_mix(mixture.mix(edge_docs.where("doc_id is null or doc_id <> 6")).collect())
    assert mixture.mix(empty_docs).count() == 0


def test_mixture_caps(spark):
    texts = [(i, "w " * (50 if i % 10 == 0 else 5), "tiny" if i < 4 else "big" if i < 900 else None) for i in range(1000)]
    rows = mixture.mix(spark.createDataFrame(texts, "doc_id bigint, text string, source string")).collect()
    check_mix(rows)
    assert {r["mix"]["copies"] for r in rows if r["source"] == "tiny"} == {3}


def brute_balance(mass, goals):
    """Rates of (a, b) strata by plain proportional fitting."""
    rate = {k: 1.0 for k in mass}
    for _ in range(2000):
        for axis, goal in enumerate(goals):
            for v, want in goal.items():
                have = sum(mass[k] * rate[k] for k in mass if k[axis] == v)
                for k in mass:
                    if k[axis] == v:
                        rate[k] = rate[k] * want / have if have else 0.0
    return rate


def test_two_families(spark, edge_docs):
    """Source and language constraints together, against proportional fitting; both plans of the last join."""
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 40)), f"s{i % 3}" if i % 50 else None, "en" if rng.random() < 0.2 + 0.3 * (i % 3) else "de") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = mixture.mix(docs, cap=50, also={"lang": {"en": 1.0, "de": 3.0}}).collect()
    mass, sizes = Counter(), Counter()
    for r in got:
        mass[r["source"], r["lang"]] += r["mix"]["size"]
        sizes[r["source"]] += r["mix"]["size"]
    targets = brute_targets(dict(sizes), cap=50)
    total = sum(targets.values())
    want = brute_balance(mass, [{"en": total / 4, "de": total * 3 / 4}, targets][::-1])
    taken = Counter()
    for r in got:
        assert abs(r["mix"]["rate"] - want[r["source"], r["lang"]]) < 1e-4 * max(1, r["mix"]["rate"])
        taken[r["lang"]] += r["mix"]["taken"]
    assert abs(taken["en"] - total / 4) < 0.01 * total
    some = mixture.mix(edge_docs, also={"lang": {"en": 1.0}}).collect()
    assert len(some) == edge_docs.count() and all(r["mix"]["copies"] == 0 for r in some if r["lang"] != "en")


def test_mixture_without_broadcast(spark, edge_docs, monkeypatch):
    want = sorted(map(repr, mixture.mix(edge_docs).collect()))
    monkeypatch.setattr(mixture, "BROADCAST_STRATA", 0)
    assert sorted(map(repr, mixture.mix(edge_docs).collect())) == want


def test_pipeline_brute(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    after = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after.append([r.asDict() for r in docs.collect()])
    before = table(spark, sf_dir, "documents").collect()
    language, single, clean, mixed = after
    assert len(language) >= 0.98 * len(before)
    groups = {d: c for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in language], 80, 5)}
    assert sorted(r["doc_id"] for r in single) == sorted(set(groups.values()))
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    hits = {r["doc_id"]: brute_hits(r["text"], items) for r in single}
    assert {r["doc_id"] for r in clean} == {d for d, (n, h, _) in hits.items() if h <= 0.6 * n}
    for r in clean:
        n, h, _ = hits[r["doc_id"]]
        assert len(decontamination.words_of(r["text"].encode())) == n - h and r["n_chars"] == len(r["text"])
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in clean} and max(copies.values()) <= 3
    out = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    tk = Tokenizer.from_file(TOKENIZER)
    want = Counter((r["doc_id"], len(tk.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == want
