import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import near_dedup as nd
from tagloom.llm.base import WordHashes
from tagloom.llm.components import components


def words(rng, n):
    return [f"v{rng.randrange(5000)}" for _ in range(n)]


def classes_by_brute_force(rows, threshold=nd.THRESHOLD):
    """Weighted Jaccard of all pairs with the operator's sketch, then union-find."""
    hashes, sets = WordHashes(), {}
    counts = np.zeros((nd.SKETCH_ROWS, nd.SKETCH_WIDTH), np.int64)
    for i, t in rows:
        sets[i] = nd.shingles(hashes.of((t or "").encode().split()), nd.SHINGLE)
        for row, at in zip(counts, nd.Sketch.places(sets[i][0])):
            np.add.at(row, at, 1)
    sketch = nd.Sketch(counts, len(rows))
    weights = {i: dict(zip(h.tolist(), sketch.weights(h, n).tolist())) for i, (h, n) in sets.items()}
    label = {i: i for i, _ in rows}
    for a, b in itertools.combinations(sorted(weights), 2):
        x, y = weights[a], weights[b]
        if not x or not y:
            continue
        low = sum(min(x.get(s, 0), y.get(s, 0)) for s in x.keys() | y.keys())
        high = sum(max(x.get(s, 0), y.get(s, 0)) for s in x.keys() | y.keys())
        if low / high >= threshold:
            keep, drop = sorted((label[a], label[b]))
            label = {k: keep if v == drop else v for k, v in label.items()}
    return label


def test_classes(frame):
    rng = random.Random(1)
    rows, n = [], 0
    for group in range(12):
        base = words(rng, rng.choice([30, 200, 600]))
        for copy in range(rng.choice([1, 2, 9])):
            text = list(base)
            for _ in range(len(text) // 150 if copy % 3 else 0):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, None), (n + 1, None), (n + 2, ""), (n + 3, "one two"), (n + 4, "one  two"), (n + 5, "one three")]
    out = {r.doc_id: r.class_id for r in nd.near_duplicates(frame(*rows)).collect()}
    assert out == classes_by_brute_force(rows)
    assert out[n] == n and out[n + 1] == n + 1 and out[n + 4] == n + 3


def test_every_pair_of_a_bucket_is_compared_or_in_one_class(frame):
    """With bands of one key, unlike texts meet in buckets; links between members that are not the first must be found."""
    rng = random.Random(2)
    shared = words(rng, 60)
    rows = [(i, " ".join(shared + words(rng, 60))) for i in range(0, 40, 2)]
    rows += [(i + 1, t + " tail") for i, t in rows[5:]]
    out = {r.doc_id: r.class_id for r in nd.near_duplicates(frame(*rows), bands=6, rows=1).collect()}
    assert out == classes_by_brute_force(rows)


def test_pairs_of_a_large_bucket_make_no_rows(frame, monkeypatch):
    """Texts that are 0.7 to 0.9 alike share buckets without being one class: rows go with the members, not with the pairs."""
    rng = random.Random(5)
    base, rows = words(rng, 120), []
    for i in range(70):
        text = rows[-1][1].split() if i % 5 == 4 else list(base)
        for _ in range(1 if i % 3 == 0 or i % 5 == 4 else 2):
            text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    made, across = [], nd._across_classes
    monkeypatch.setattr(nd, "SMALL_BUCKET", 6, raising=False)
    monkeypatch.setattr(nd, "BLOCK", 8, raising=False)

    def counted(*args):
        pairs = across(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(nd, "_across_classes", counted)
    out = {r.doc_id: r.class_id for r in nd.near_duplicates(frame(*rows)).collect()}
    assert out == classes_by_brute_force(rows)
    assert 5 < len(set(out.values())) < 70
    assert max(made) < 70 * 6


def test_edges(frame):
    assert nd.near_duplicates(frame()).collect() == []
    a, b = "a b c d e f g", "h i j k l m n"
    out = [(r.doc_id, r.class_id, r.first) for r in nd.near_duplicates(frame((3, a), (3, a), (None, a), (None, b), (5, "x" * 300_000)).withColumn("class_id", F.lit(0))).collect()]
    assert sorted(out, key=repr) == sorted([(3, 3, True), (3, 3, True), (None, 3, False), (None, None, True), (5, 5, True)], key=repr)
    kept = nd.first_of_each_class(frame((3, a), (3, a), (None, a), (None, b), (4, a), (3, b + " o p q r"))).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(3, a), (None, b), (3, b + " o p q r")], key=repr)


def test_keys_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    w = rng.uniform(1, 3, 3000)
    v = w * rng.uniform(0.6, 1.4, 3000)
    sampler = nd.Sampler(300, 1)
    a, b = (sampler.keys(h, x, np.array([0]))[1] for x in (w, v))
    assert abs((a == b).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (200, 150), (150, 175)]
    out = {r.k: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 150: 150, 175: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_many_partitions_leave_few_files(frame, monkeypatch, tmp_path):
    """Stored tables have files for their documents, not for the partitions of a shuffle."""
    from tagloom.llm import base

    monkeypatch.setattr(base, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    monkeypatch.setattr(nd, "SMALL_BUCKET", 4)
    rng = random.Random(8)
    texts = [words(rng, 60) for _ in range(12)]
    rows = [(10 * i + j, " ".join([*t[: 60 - 5 * j], *words(rng, 5 * j)])) for i, t in enumerate(texts) for j in range(4)]
    data = frame(*rows)
    old = {k: data.sparkSession.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("40", "false")):
            data.sparkSession.conf.set(k, v)
        out = {r.doc_id: r.class_id for r in nd.near_duplicates(data).collect()}
    finally:
        for k, v in old.items():
            data.sparkSession.conf.set(k, v)
    assert out == classes_by_brute_force(rows)
    files = {d.name: len(list(d.glob("part-*"))) for d in tmp_path.iterdir()}
    assert len(files) > 8 and max(files.values()) <= 1, files
