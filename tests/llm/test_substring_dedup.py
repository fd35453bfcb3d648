import random

import pytest
from pyspark.sql import functions as F

from tagloom.llm import substring_dedup as sd


def brute(rows, window):
    """rows: (id, text); per row (n_words, n_removed, kept words)."""
    top = (1 << 63) - 1
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - window + 1):
            seq = tuple(w[a : a + window])
            first[seq] = min(first.get(seq, top), top if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < (top if i is None else i):
                gone |= set(range(a, a + window))
        out.append((i, len(w), len(gone), " ".join(x.decode() for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=repr)


def test_against_brute_force(frame):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é x", " "]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(180)
            words += base[a : a + rng.randrange(1, 40)] + [rng.choice(vocabulary) for _ in range(rng.randrange(8))]
        rows.append((rng.randrange(50) if i % 9 else None, rng.choice([" ", "\n", "\t "]).join(words) if i % 11 else None))
    rows += [rows[5], rows[5], (99, ""), (100, " ".join(base * 30))]
    assert got(sd.substring_dedup(frame(*rows))) == brute(rows, 13)
    assert got(sd.substring_dedup(frame(*rows), window=5, period=3, cover=(0, 1))) == brute(rows, 5)


def test_chunks_give_the_same(frame, monkeypatch):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(i, f"x{i} " * (i % 5) + text) for i in range(30)]
    data = frame(*rows)
    monkeypatch.setattr(sd, "CHUNK", 10)
    assert got(sd.substring_dedup(data)) == brute(rows, 13)


def test_edges(frame):
    assert sd.substring_dedup(frame()).collect() == []
    text = " ".join("abcdefghijklm")
    out = sd.substring_dedup(frame((2, text), (1, text), (2, text)).withColumn("kept_text", F.lit("clash")).withColumn("k", F.lit(7)))
    assert got(out) == [(1, 13, 0, text), (2, 13, 13, ""), (2, 13, 13, "")]
    assert "k" in out.columns and {r.k for r in out.collect()} == {7}
    with pytest.raises(ValueError):
        sd.substring_dedup(frame(), cover=(0, 1))


def test_cover():
    assert sd.is_cover(sd.COVER, sd.PERIOD) and not sd.is_cover((0, 1), 7)
