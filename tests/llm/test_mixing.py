from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.llm.mixing import mixed_sources, source_targets


def fill(sizes):
    """Shares by weight; what is above three times a size is shared again, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 1, None: 5}, {"a": 0, "b": 7}, {"x": 0}, {"a": 1000, "B": 1, "é": 1, "": 3, "z": 2}, {f"s{i:03}": i * i for i in range(200)},
])
def test_targets(spark, sizes):
    out = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert out.keys() == sizes.keys() and all(out[s] == pytest.approx(t) for s, t in fill(sizes).items())


def test_mix(frame):
    rows = [(i, "w " * (i % 7), f"s{i % 4}" if i % 5 else None) for i in range(4000)] + [(None, "a b", "s1"), (None, None, "empty"), (7, "x " * 50_000, "long")]
    data = frame(*rows).withColumn("size", F.lit("clash"))
    out = mixed_sources(data).collect()
    assert len(out) == len(rows)
    again = mixed_sources(data.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.source or "", r.copies)
    assert sorted(map(key, out), key=repr) == sorted(map(key, again), key=repr)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in out:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        size[r.source] += r.size
        target[r.source] = r.target
    for s, t in target.items():
        assert t == pytest.approx(fill(size)[s])
        assert s == "long" or abs(taken[s] - t) <= 0.1 * t + 5


def test_empty(frame):
    assert mixed_sources(frame()).collect() == []
