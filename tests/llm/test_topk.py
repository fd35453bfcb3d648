import math

import numpy as np
import pytest

from tagloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256.0 * float(np.float32(x))) for x in v]

    rows = [(i, whole(v)) for i, v in rows]
    out = []
    for q, v in [(i, whole(v)) for i, v in asked]:
        if v is not None:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), math.inf if i is None else i) for i, w in rows if w is not None and (i != q)))
            out += [(q, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def run(spark, rows, asked, k):
    data = lambda x: spark.createDataFrame(x, SCHEMA)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(data(rows), data(asked), k).collect()), key=repr)


@pytest.mark.parametrize("bins, block", [(1024, 4096), (2, 3), (7, 1)])
def test_against_brute_force(spark, monkeypatch, bins, block):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.2, 4), 1)]) for i in range(80)]
    rows += [(90, None), (91, [None, 1.0]), (92, [math.nan]), (93, [math.inf]), (94, []), (95, [0.5]), (None, [0.3] * 4), (-7, [0.1] * 4), (10, [0.25] * 4), (96, [1000.0] * 4)]
    asked = [r for r in rows if r[0] in (0, 10, 50, 94, 95, 92)]
    assert run(spark, rows, asked, 5) == brute(rows, asked, 5)


def test_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in (5, 3, 9, 1)]
    assert run(spark, rows, rows[:1], 2) == [(5, 1, 1, 65536), (5, 2, 3, 65536)]
    assert run(spark, rows, rows[:1], 50) == [(5, 1, 1, 65536), (5, 2, 3, 65536), (5, 3, 9, 65536)]
    assert run(spark, [], [], 5) == [] and run(spark, rows, [], 5) == [] and run(spark, rows[:1], rows[:1], 5) == []
