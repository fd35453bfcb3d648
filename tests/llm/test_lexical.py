import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, math.inf if d is None else d))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k):
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, id int, term string").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, uid int")
    return sorted((tuple(r) for r in X.ranked_search(df, asked, k).collect()), key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "ring", "Éclair", "éclair", "x9", "日本", "a_b", "of", "one", "two", "three", "four", "five"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ".", ",", "-"]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 30]))) for i in range(70)] + [(None, "ring of one"), (None, "ring of one"), (3, "ring x9"), (900, None), (901, ""), (902, "--- !"), (903, "three " * 3000 + "ring")]
    shared = "one two three four five"
    items = [(i, shared + " " + text(4)) for i in range(9)] + [(50, None), (51, ""), (52, "unheard words"), (53, "ring"), (53, "ring"), (None, "RING ring x9"), (54, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("k, block, room", [(10, 1024, 4_000_000), (3, 4, 100), (500, 1, 1)])
def test_against_brute_force(spark, monkeypatch, k, block, room):
    monkeypatch.setattr(X, "QUERY_BLOCK", block)
    monkeypatch.setattr(X, "ACCUMULATORS", room)
    docs, items = corpus()
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = corpus()
    assert run(spark, [], items, 10) == [] and run(spark, docs, [], 10) == [] and run(spark, [(1, None)], items, 10) == []


def test_shared_sums():
    """Sums are shared, and each query's root still adds every term of its set once."""
    rng = np.random.default_rng(2)
    queries = [set(map(int, rng.choice(40, rng.integers(1, 14), replace=False))) | {0, 1, 2, 3} for _ in range(30)]
    sums = X.SharedSums(queries, 40)
    leaves = np.zeros((sums.n_nodes, 40), np.int64)
    leaves[:40] = np.eye(40, dtype=np.int64)
    got = sums.evaluate(leaves)
    assert [set(np.flatnonzero(r)) for r in got] == queries and got.max() == 1
    assert sums.n_nodes - 40 < sum(len(q) - 1 for q in queries) * 0.75
    once = X.SharedSums([{0, 1, 2}] * 50, 3)
    assert once.n_nodes == 5 and set(once.roots) == {4}
