import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import ngram_trie as lm


def brute(rows):
    """rows: (text, train)."""
    tokens = [[*(t or "").encode().translate(lm.LOWER).split(), b" end"] for t, _ in rows]
    train = [x for x, (_, use) in zip(tokens, rows) if use]
    count = Counter(w for t in train for w in t)
    pair = Counter(p for t in train for p in zip([b" start", *t], t))
    n, v = sum(count.values()), len(count)
    count_before = Counter(count)
    count_before[b" start"] = len(train)
    out = []
    for t in tokens:
        p1 = [(count[w] + 1) / (n + v + 1) for w in t]
        p2 = [(pair[b, w] + lm.PRIOR * p) / (count_before[b] + lm.PRIOR) for b, w, p in zip([b" start", *t], t, p1)]
        out.append((len(t), sum(count[w] > 0 for w in t), n, sum(map(math.log10, p1)), sum(map(math.log10, p2))))
    return out


def check(df, rows):
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=lambda x: (x[0], x[3]))
    for g, w in zip(got, sorted(brute(rows), key=lambda x: (x[0], x[3])), strict=True):
        assert g[:3] == w[:3]
        assert g[3] == pytest.approx(w[3], rel=1e-9) and abs(g[4] - w[4]) < 0.02 * g[0] + 1e-6


@pytest.mark.parametrize("size", [300, 10**9])
def test_against_counters(frame, monkeypatch, size):
    monkeypatch.setattr(lm, "CHUNK_BYTES", size)
    monkeypatch.setattr(lm, "PART", 5)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "B", "b", "c,", "É", "dd d"], rng.integers(0, 30))) for _ in range(60)] + [None, "", "unseen words", texts_long()]
    rows = [(t, i % 7 != 2 and t != "unseen words") for i, t in enumerate(texts)]
    data = frame(*[(i, t) for i, t in enumerate(texts)])
    data = data.withColumn("train", (F.col("doc_id") % 7 != 2) & (F.coalesce("text", F.lit("")) != "unseen words")).withColumn("score", F.lit("clash"))
    check(lm.score_texts(data, "train"), rows)


def texts_long():
    return "a b " * 20_000


def brute3(rows):
    """Scores of the trigram model, rows: (text, train)."""
    tokens = [[b" start", *(t or "").encode().translate(lm.LOWER).split(), b" end"] for t, _ in rows]
    train = [x for x, (_, use) in zip(tokens, rows) if use]
    count = [Counter(tuple(t[i : i + n]) for t in train for i in range(len(t) - n + 1)) for n in (1, 2, 3)]
    words = {w: k for w, k in count[0].items() if w != (b" start",)}
    n, v, out = sum(words.values()), len(words), []
    for t in tokens:
        total = 0
        for i in range(1, len(t)):
            p = (words.get((t[i],), 0) + 1) / (n + v + 1)
            for k in (1, 2)[: i]:
                before = tuple(t[i - k : i])
                p = (count[k][*before, t[i]] + lm.PRIOR * p) / (count[k - 1][before] + lm.PRIOR)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("size, part", [(300, 5), (300, 1), (10**9, 200_000)])
def test_trigrams_against_counters(frame, monkeypatch, size, part):
    monkeypatch.setattr(lm, "CHUNK_BYTES", size)
    monkeypatch.setattr(lm, "PART", part)
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "B", "b", "c,", "É", "dd d"], rng.integers(0, 30))) for _ in range(60)] + [None, "", "unseen words here", "a b c, " * 500]
    data = frame(*[(i, t) for i, t in enumerate(texts)]).withColumn("train", (F.col("doc_id") % 7 != 2) & (F.col("doc_id") != 62))
    got = {r.doc_id: r for r in lm.score_texts(data, "train", order=3).collect()}
    want = brute3([(t, i % 7 != 2 and i != 62) for i, t in enumerate(texts)])
    assert len(got) == len(want) and all(abs(got[i].score - w) < 0.02 * got[i].n_tokens + 1e-6 for i, w in enumerate(want))
    low = {r.doc_id: r.score for r in lm.score_texts(data, "train").collect()}
    assert got[63].score > low[63] + 50


def test_trie_follows_pointers():
    u = lambda *x: np.array(x, np.uint64)
    trie = lm.Trie(u(5, 9), np.array([2, 1]), u(1, 3, 1), np.array([0.5, 0.25, 0.125]), np.array([1, 0, 2]), u(7, 3, 7), np.array([0.5, 0.25, 0.125]))
    pair, last = trie.codes(u(4, 5, 9), np.array([1, 3, 2]), u(1, 1, 2, 3, 1, 3), np.array([1, 2, 1, 1, 2, 1]), u(7, 3, 7, 7, 7, 3, 7, 7))
    assert (pair == lm.quantise(np.array([0, 0.5, 0, 0.25, 0.125, 0]))).all() and (last == lm.quantise(np.array([0, 0, 0.5, 0, 0, 0.25, 0.125, 0]))).all()
    ef = lm.EliasFano(*lm.EliasFano.encode(u(1, 4, 6, 8), 10))
    assert not ef.successor(u(4), np.array([2]), np.array([4]))[1][0] and ef.successor(u(6), np.array([2]), np.array([3]))[1][0]


def test_nothing_to_learn_from(frame):
    data = frame((1, "a b"), (None, "a"), (1, "a b")).withColumn("train", F.lit(False))
    check(lm.score_texts(data, "train"), [("a b", False), ("a", False), ("a b", False)])
    assert lm.score_texts(frame().withColumn("train", F.lit(True)), "train").collect() == []


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1 << 64), (1, 1), (500, 700), (500, 1 << 40), (300, 1 << 64), (1000, 64)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True)) if n else np.zeros(0, np.uint64)
    ef = lm.EliasFano(*lm.EliasFano.encode(values, universe))
    if n:
        assert (ef.at(np.arange(n)) == values).all()
    asked = np.concatenate([values, rng.integers(0, universe - 1, 300, dtype=np.uint64, endpoint=True)])
    at, equal = ef.successor(asked)
    assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()
    if n == 500:
        assert (ef.low.nbytes + ef.high.nbytes) * 8 <= n * (2 + max(0, math.log2(universe / n)) + 1) + 256


def test_packed():
    for values in ([], [0], [1, 2, 1 << 63], list(range(1000))):
        a = np.array(values, np.uint64)
        assert (lm.unpacked(lm.packed(a)) == a).all()
        assert (np.cumsum(lm.unpacked(lm.packed(lm.deltas(np.sort(a))))) == np.sort(a)).all()


def test_quantised():
    p = 10.0 ** -np.linspace(0, 8.9, 200)
    assert np.abs(np.log10(lm.LEVELS[lm.quantise(p)] / p)).max() < 0.018 and lm.quantise(np.array([0.0]))[0] == 0


def test_query_splits_by_crc(spark):
    from tagloom.llm.queries import QUERIES

    out = QUERIES["op5_language_model"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in out) and len(out) == 200
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_chunk_holds_few_texts_as_strings(monkeypatch):
    """The texts of a chunk are cut into words a few at a time, with the same numbers."""
    column, train = pa.array(["a b a", None, "", "B c", "d a b"]), np.array([True, False, True, True, False])
    whole = lm.Chunk(column, train)
    monkeypatch.setattr(lm, "HELD_TEXTS", 2)
    some = lm.Chunk(column, train)
    assert all(np.array_equal(getattr(whole, n), getattr(some, n)) for n in ("sizes", "starts", "words", "word", "word_counts"))
    assert whole.sizes.tolist() == [4, 1, 1, 3, 4]


def test_texts_are_cut_into_words_once(frame, monkeypatch):
    """A chunk is read from its numbers, with the same words and tokens, and texts are cut only to make them."""
    column, train = pa.array(["a b a", None, "", "B c", "d a b"]), np.array([True, False, True, True, False])
    whole = lm.Chunk(column, train)
    again = lm.Chunk.load(whole.saved())
    assert all(np.array_equal(getattr(whole, n), getattr(again, n)) for n in ("sizes", "starts", "words", "word", "word_counts", "train"))
    rows = frame(*[(i, f"a b w{i} a b") for i in range(20)]).withColumn("train", F.col("doc_id") > 4)
    plan = lm.score_texts(rows, "train", order=3)._jdf.queryExecution().toString()
    assert "text" not in plan


def test_ngrams_name_a_word_once():
    """What is sent for each shard lists its words once; bigrams and trigrams hold places in the list."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    texts = pa.array([" ".join(rng.choice(words, 300)) for _ in range(5)])
    rows = pa.array([{"doc_id": i} for i in range(5)])
    chunk = lm._read(pa.table({"text": texts, "train": pa.array([True] * 5), "chunk": pa.array([0] * 5, pa.int32()), "row": rows}))
    sent = pa.Table.from_batches(list(lm._send_words(2)(iter(chunk.select(["chunk", "data"]).to_batches()))))
    counts = pa.concat_tables([lm._count_words(sent.slice(i, 1)) for i in range(sent.num_rows)])
    counts = counts.filter(pa.array([c >= 0 for c in counts["chunk"].to_pylist()]))
    seen = set()
    for data in lm._send_ngrams(2, 5, 3)(chunk, counts)["data"].to_pylist():
        names, successors, last = np.cumsum(lm.unpacked(data[3])), lm.unpacked(data[4]), lm.unpacked(data[7])
        assert len(set(names.tolist())) == len(names) <= 41 and max(successors.max(), last.max()) < len(names)
        seen |= set(names.tolist())
    assert len(seen) == 41
