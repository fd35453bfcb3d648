import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [0]


ODD = ["Don't  STOP\tnow\x1c\x85 İstanbul ΣΑΣ é <|endoftext|> ١٢3  x y​", "a\x00b \x7f̀x 'LL 'ſ ǅ ß K", "\n\n ", "日本語 12 \r\n x'S", "é" * 300 + " ª²½µ", "Ÿ ÿß"]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aA'sS tT1.\n\tÉß´̂Σé", max_size=40)))
def test_ids_are_those_of_the_whole_tokenizer(text):
    ids, sizes = K.part_ids(PATH, 0).of([text, None, "", text + " a"])
    want = [ids_of(text), [0], [0], ids_of(text + " a")]
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_ids_of_odd_texts():
    for text in ODD:
        assert list(K.part_ids(PATH, 0).of([text])[0]) == ids_of(text)


def test_forgetting_changes_no_ids(monkeypatch):
    monkeypatch.setattr(K, "CACHED_PARTS", 3)
    parts = K.PartIds(PATH, 0)
    for text in ODD + ["one two three four", "one two " * 3, "x" * 100]:
        assert list(parts.of([text])[0]) == ids_of(text)


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(K, "BATCH_CHARS", 7)
    monkeypatch.setattr(K, "HELD_PARTS", 3)
    whole = "a word, andoneverylongword é日本\n\n12 it's  over\n" * 5
    for text in [whole, " " * 30, "x" * 40, whole + "y" * 20, "\n".join(ODD)]:
        assert "".join(K.slices(text)) == text
        ids, sizes = K.PartIds(PATH, 0).of([text, "b", text])
        assert list(ids) == ids_of(text) + ids_of("b") + ids_of(text) and list(sizes) == [len(ids_of(text)), len(ids_of("b")), len(ids_of(text))]


def test_texts_in_batches(monkeypatch):
    monkeypatch.setattr(K, "BATCH_CHARS", 5)
    texts = ["abc", None, "a long text of its own", "", "ab", "abcd", "x"]
    cuts = list(K._some(texts))
    assert [t for c in cuts for t in texts[c]] == texts and len(cuts) > 2 and list(K._some([])) == []


def brute_fit(columns, b):
    """Least squares over x >= 0 by small steps down the slope."""
    x = np.zeros(columns.shape[1])
    rate = 1.0 / np.linalg.norm(columns, 2) ** 2
    for _ in range(60_000):
        x = np.maximum(x + rate * (columns.T @ (b - columns @ x)), 0)
    return np.linalg.norm(columns @ x - b)


def test_fit():
    rng = np.random.default_rng(1)
    for _ in range(10):
        a, b = rng.integers(0, 3, (6, 12)).astype(float), rng.normal(1, 2, 6)
        x = K.non_negative_fit(a, b)
        assert x.min() >= 0 and np.linalg.norm(a @ x - b) == pytest.approx(brute_fit(a, b), abs=1e-4)


def test_patterns():
    found = {tuple(p[p > 0]) for p in K.patterns(6, 3)}
    assert found == {(6,), (5, 1), (4, 2), (3, 3), (4, 1, 1), (3, 2, 1), (2, 2, 2)}


def best_fit_decreasing(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        at = min((k for k, f in enumerate(free) if f >= n), key=lambda k: free[k], default=None)
        if at is None:
            free.append(size - n)
        else:
            free[at] -= n
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    """Every piece has one place, sequences are gapless and at most full, and few: about those of best fit decreasing."""
    rng = np.random.default_rng(seed)
    size = int(rng.choice([7, 64, 100, 256]))
    lengths = np.clip(rng.lognormal(np.log(size / rng.choice([2, 3, 8])), 0.8, 700).astype(int), 1, size)
    lengths[: 200 * (seed % 3)] = size // 3  # a third alike
    counts = np.bincount(lengths, minlength=size + 1)
    plan = K.best_plan(counts, size, classes=16)
    length = np.repeat(np.arange(size + 1), counts)
    sequence, offset = plan.find(length, np.concatenate([np.arange(c) for c in counts]))
    order = np.lexsort((offset, sequence))
    end = (offset + length)[order]
    first = np.append(True, sequence[order][1:] != sequence[order][:-1])
    assert end.max() <= size and (offset[order][first] == 0).all() and (offset[order][1:][~first[1:]] == end[:-1][~first[1:]]).all()
    assert len(set(sequence)) == plan.n_sequences <= best_fit_decreasing(lengths, size) * 1.02 + 1


def test_plan_edges():
    assert K.best_plan(np.zeros(9, np.int64), 8).n_sequences == 0
    one = np.zeros(9, np.int64)
    one[1] = 17
    assert K.best_plan(one, 8).n_sequences == 3


def test_packed_sequences(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "Ring", "señor", "x9", "zq,", "unpack", "I'm"])
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 9, 40, 200])))) for i in range(60)]
    docs += [(None, "no id"), (None, "no id"), (7, docs[7][1]), (100, None), (101, ""), *((200 + i, t) for i, t in enumerate(ODD)), (300, "long " * 5000)]
    rows = [(d, t, "x", 5) for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(4)
    out = K.packed(df, PATH, max_len=64, classes=16).collect()
    want = defaultdict(int)
    for d, t in docs:
        ids = ids_of(t)
        for k in range(0, len(ids), 64):
            want[d, k // 64, k, tuple(ids[k : k + 64])] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got[r["id"], r["piece"], r["start"], tuple(r["ids"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert K.packed(df.limit(0), PATH, max_len=64).count() == 0


def test_a_word_is_looked_up_once():
    """A word of several pre-tokens is one key, with the ids of its parts."""
    for text in ["don't it's 12.5% (a.b),", "'s'sx d'll12é!? don't", "Ünder\t12.5% İx.y don't\x0b12.5%"]:
        parts = K.PartIds(PATH, 0)
        ids, sizes = parts.of([text])
        assert list(ids) == ids_of(text) and list(sizes) == [len(ids)]
    parts = K.PartIds(PATH, 0)
    parts.of(["don't 12.5%"])
    before = len(parts.ends)
    assert list(parts.of(["12.5% Don't"])[0]) == ids_of("12.5% Don't")
    assert {"don't", "12.5%"} <= parts.keys() and len(parts.ends) == before
