"""Text, vector, distribution and run-log operators against plain Python."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.operators import alignment as AL
from tagloom.operators import concepts as C
from tagloom.operators import distributions as D
from tagloom.operators import models as MO
from tagloom.operators import moments as MM
from tagloom.operators import runs as R
from tagloom.operators import stats as S
from tagloom.operators import textmetrics as M
from tagloom.operators import vectors as O
from tagloom.operators.ordered import with_value_range

PAIRS = [
    (1, "the cat sat on the mat", "the cat is on the mat"), (2, "a b c d", "a b c d"), (3, "", "x y"), (4, "x", ""),
    (5, "one two\nthree four", "three four\none five two"), (6, "b a b a c", "a b a b"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id int, prediction string, reference string")


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def kept(a, b):
    """Places in a of the subsequence read backwards from the end of the table."""
    t = lambda i, j: lcs(a[:i], b[:j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif t(i, j - 1) > t(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out


def brute_hits(ps, rs):
    left, hits = Counter(t for s in ps for t in s), 0
    for s in rs:
        for at in sorted(set().union(*[kept(s, c) for c in ps])) if ps else []:
            if left[s[at]] > 0:
                left[s[at]] -= 1
                hits += 1
    return hits


def brute_matches(p, r):
    free = {t: [j for j, x in enumerate(r) if x == t] for t in r}
    found = [(i, free[t].pop()) for i, t in reversed(list(enumerate(p))) if free.get(t)][::-1]
    return len(found), sum(1 for k, (i, j) in enumerate(found) if not k or found[k - 1] != (i - 1, j - 1))


@pytest.mark.parametrize("cells", [1 << 23, 40, 1])
def test_alignments_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(AL, "CELLS", cells)
    rng = np.random.default_rng(0)
    sentence = lambda: [str(x) for x in rng.integers(0, 4, rng.integers(1, 9))]
    text = lambda: [sentence() for _ in range(rng.integers(0, 4))]
    p, r = [text() for _ in range(60)] + [[], [["x"]]], [text() for _ in range(60)] + [[], []]
    kind = pa.list_(pa.list_(pa.string()))
    whole, hits, n_p, n_r = AL.summary_hits(pa.array(p, kind), pa.array(r, kind))
    flat = lambda text: [t for s in text for t in s]
    for k, (a, b) in enumerate(zip(p, r)):
        assert (whole[k], hits[k], n_p[k], n_r[k]) == (lcs(flat(a), flat(b)), brute_hits(a, b), len(flat(a)), len(flat(b)))
    words = [pa.array([flat(t) for t in x], pa.list_(pa.string())) for x in (p, r)]
    m, chunks, _, _ = AL.matched_words(*words)
    assert [(a, b) for a, b in zip(m, chunks)] == [brute_matches(flat(a), flat(b)) for a, b in zip(p, r)]


def test_portions_hold_few_words(monkeypatch):
    """Batches are matched a bounded number of words at a time, with the same result."""
    rng = np.random.default_rng(1)
    p, r = (pa.array([[str(x) for x in rng.integers(0, 5, n)] for n in rng.integers(0, 12, 80)], pa.list_(pa.string())) for _ in range(2))
    sizes, whole = AL.sizes_of(p) + AL.sizes_of(r), AL.matched_words(p, r)
    for words in (1, 30, 10_000):
        monkeypatch.setattr(AL, "WORDS", words)
        parts = list(AL.portions(sizes))
        assert [i for s in parts for i in range(s.start, s.stop)] == list(range(80))
        assert all(sizes[s].sum() <= words or s.stop == s.start + 1 for s in parts)
        found = zip(*[AL.matched_words(p[s.start : s.stop], r[s.start : s.stop]) for s in parts])
        assert all(np.array_equal(np.concatenate(x), y) for x, y in zip(found, whole))
    assert list(AL.portions(sizes[:0])) == [slice(0, 0)]


def test_null_texts_score_nothing(spark):
    d = spark.createDataFrame([(1, None, "a b"), (2, "a", None), (3, None, None), (4, "", ""), (5, "a b", "a b")], "id int, prediction string, reference string")
    assert {r["id"]: (r["rouge_l"], r["rouge_lsum"]) for r in M.rouge_l_rows(d).collect()} == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (1, 1)}
    assert {r["id"]: r["meteor"] for r in M.meteor_rows(d).where("id < 5").collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert M.rouge_l_rows(d.limit(0)).count() == 0 and M.meteor_rows(d.limit(0)).count() == 0


def test_rouge_l(pairs):
    got = {r["id"]: (r["rouge_l"], r["rouge_lsum"]) for r in M.rouge_l_rows(pairs).collect()}
    for i, p, r in PAIRS:
        p, r = p.split(), r.split()
        h = lcs(p, r)
        want = 2 * h / (len(p) + len(r)) if h else 0.0
        assert got[i][0] == pytest.approx(want)
    assert got[2] == (1.0, 1.0) and got[5][1] == pytest.approx(2 * 4 / (4 + 5))


def test_bleu(spark, pairs):
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id int, prediction string, reference string")
    assert M.corpus_bleu(same).first()["bleu"] == pytest.approx(1.0)
    counts = {r["n"]: (r["matches"], r["possible"]) for r in M.bleu_precisions(pairs).collect()}
    for n in (1, 2, 3, 4):
        m = c = 0
        for _, p, r in PAIRS:
            p, r = p.split(), r.split()
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, r))
            m, c = m + sum((a & b).values()), c + max(len(p) - n + 1, 0)
        assert counts[n] == (m, c)


def test_bleu_tokens(spark):
    from tagloom.functions.text import tokens_mteval, tokens_rouge

    text = 'Hello, world! 3.5 costs $2,000 - x-y 7-8 &quot;ok&quot;'
    got = spark.range(1).select(tokens_mteval(F.lit(text)).alias("t"), tokens_rouge(F.lit("It's 2nd-hand É!")).alias("r")).first()
    assert got["t"] == ["Hello", ",", "world", "!", "3.5", "costs", "$", "2,000", "-", "x-y", "7", "-", "8", '"', "ok", '"']
    assert got["r"] == ["it", "s", "2nd", "hand"]


def test_meteor(pairs):
    got = {r["id"]: r["meteor"] for r in M.meteor_rows(pairs).collect()}
    assert got[3] == got[4] == 0.0
    assert got[2] == pytest.approx(1 - 0.5 * (1 / 4) ** 3)
    p = r = 5 / 6
    assert got[1] == pytest.approx((1 - 0.5 * (2 / 5) ** 3) * (p * r / (0.9 * p + 0.1 * r)))


def test_bertscore(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(3, 4)), rng.normal(size=(2, 4))
    n_a, n_b = [1, 2, 1], [3, 1]
    rows = [(7, "p", n, [float(x) for x in v]) for n, v in zip(n_a, a)] + [(7, "r", n, [float(x) for x in v]) for n, v in zip(n_b, b)]
    rows.append((8, "p", 1, [1.0, 0.0, 0.0, 0.0]))
    d = spark.createDataFrame(rows, "id int, side string, n long, vec array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit(a) @ unit(b).T
    p, r = np.average(sims.max(axis=1), weights=n_a), np.average(sims.max(axis=0), weights=n_b)
    for block in (1, 1024):
        got = {x["id"]: x for x in M.bertscore_rows(d, block).collect()}
        assert got[7]["precision"] == pytest.approx(p) and got[7]["recall"] == pytest.approx(r) and got[7]["f1"] == pytest.approx(2 * p * r / (p + r))
        assert got[8]["f1"] == 0.0


def test_mauve_extremes(spark):
    same = spark.createDataFrame([(c, s) for c in range(3) for s in "pq"], "c int, side string")
    apart = spark.createDataFrame([(0, "p"), (1, "q")], "c int, side string")
    area = lambda d: M.mauve_from_curve(M.mauve_curve(d, "c", "side")).first()[0]
    assert area(same) == pytest.approx(1.0, abs=1e-6) and 0 <= area(apart) < 0.05


def test_perplexity(spark):
    d = spark.createDataFrame([("a", 0, -9.0), ("a", 1, -1.0), ("a", 2, -3.0)], "s string, pos int, lp double")
    assert M.perplexity(d, "s", "pos", "lp").first()["perplexity"] == pytest.approx(math.exp(2.0))
    scores = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9)] + [(math.inf,)], "p double")
    r = M.perplexity_stats(scores, "p").first()
    assert (r["mean"], r["median"], r["max"]) == (4.0, 3.0, 9.0) and r["std"] == pytest.approx(np.std([1, 2, 4, 9]))
    none = M.judge_stats(scores.where("p < 0"), "p").first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("ranges", [100_000, 300, 1])
def test_two_samples(spark, ranges):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(size=700), 1), np.round(rng.normal(0.4, 2, size=400), 1)
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b]
    rows += [("a", None), ("b", math.nan), (None, 3.0), ("c", 2.0)]  # no values, no sides
    d = spark.createDataFrame(rows, "side string, v double")
    v = np.unique(np.concatenate([a, b]))
    fa, fb = np.searchsorted(np.sort(a), v, "right") / len(a), np.searchsorted(np.sort(b), v, "right") / len(b)
    assert D.ks_statistic(d, "v", "side", ranges).first()[0] == pytest.approx(np.abs(fa - fb).max())
    u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    assert D.mann_whitney_u(d, "v", "side", ranges).first()[0] == pytest.approx(u)
    assert D.wasserstein_1d(d, "v", "side", ranges).first()[0] == pytest.approx(np.sum(np.abs(fa - fb)[:-1] * np.diff(v)))


def test_two_samples_of_many_values(spark):
    d = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("side"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    assert D._cumulative(d, "v", "side", 1000).select(F.count_distinct("v"), F.max("ca"), F.max("cb")).first() == (100_000, 33_334, 66_666)
    sizes = [r["count"] for r in with_value_range(d, "v", range_rows=1000).groupBy("range").count().collect()]
    assert 90 <= len(sizes) <= 110 and max(sizes) < 2500
    a = np.array([r["v"] for r in d.where("side = 'a'").collect()])
    b = np.array([r["v"] for r in d.where("side = 'b'").collect()])
    v = np.sort(np.concatenate([a, b]))
    fa, fb = np.searchsorted(np.sort(a), v, "right") / len(a), np.searchsorted(np.sort(b), v, "right") / len(b)
    assert D.ks_statistic(d, "v", "side", 1000).first()[0] == pytest.approx(np.abs(fa - fb).max())
    assert D.ks_statistic(d.where("side = 'a'"), "v", "side").first()[0] is None
    assert D.wasserstein_1d(d.limit(0), "v", "side").first()[0] is None
    same = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "side string, v double")
    assert D.wasserstein_1d(same, "v", "side").first()[0] == 0.0 and D.ks_statistic(same, "v", "side").first()[0] == 0.0


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(8)
    groups = {"x": rng.exponential(size=501), "y": np.repeat([1.0, 5.0], 40), "z": np.array([3.0])}
    d = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in S.exact_quantiles(d, "v", probs, ["g"], accuracy).collect()}
    for g, vs in groups.items():
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(vs, p)), (g, p)


def test_describe(spark):
    x = [1, 1, 2, 7, 3]
    r = S.describe(spark.createDataFrame([(v,) for v in x], "v int"), "v", probs=(0.25, 0.5, 0.9)).first()
    assert r["mean"] == pytest.approx(np.mean(x)) and r["std"] == pytest.approx(np.std(x, ddof=1)) and r["q90"] == pytest.approx(np.quantile(x, 0.9))


def test_kde_integrates_to_one(spark):
    d = spark.range(200).select((F.col("id") % 13).cast("double").alias("v"))
    rows = sorted((r["x"], r["density"]) for r in S.kde_grid(d, "v").collect())
    x, y = np.array(rows).T
    assert len(rows) == 200 and np.trapezoid(y, x) == pytest.approx(1.0, abs=0.01)


def test_density_of_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"x": list(rng.normal(size=300)), "flat": [4.0] * 5, "one": [7.0], "none": [None, math.nan], None: list(rng.exponential(size=50)) + [None, math.nan]}
    d = spark.createDataFrame([(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(3)
    for name, tolerance in (("kde_grid", 1e-12), ("kde_binned", 1e-4)):
        rows = getattr(S, name)(d, "v", ["g"], points=50).collect()
        got = {g: sorted((r["i"], r["x"], r["density"]) for r in rows if r["g"] == g) for g in groups}
        assert all(len(v) == 50 for v in got.values())
        for g in ("x", None):
            v = np.array([a for a in groups[g] if a is not None and not math.isnan(a)])
            h = v.std(ddof=1) * len(v) ** -0.2
            x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 50)
            want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
            assert np.allclose([r[1] for r in got[g]], x) and np.allclose([r[2] for r in got[g]], want, atol=tolerance)
        assert {r[1:] for r in got["flat"]} == {(4.0, None)} and {r[1:] for r in got["one"]} == {(7.0, None)} and {r[1:] for r in got["none"]} == {(None, None)}
        assert getattr(S, name)(d.limit(0), "v").count() == 0


def test_histogram_leaves_out_nulls(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (None,), (None,), (math.nan,)], "v double")
    got = {r["bin"]: (r["n"], r["density"]) for r in S.histogram(d, "v", 2).collect()}
    assert got == {0: (1, 1.0), 1: (1, 1.0)}
    assert [(r["bin"], r["n"], r["density"]) for r in S.histogram(d.where("v = 1"), "v", 2).collect()] == [(0, 1, None)]
    assert S.histogram(d.where("v is null"), "v", 2).count() == 0


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5)) + np.repeat(np.arange(3), 30)[:, None]
    label = np.repeat([0, 1, 2], 30)
    label[-1] = 9
    d = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(90)], "id long, vec array<double>, label long")
    return d.repartition(4).cache(), x, label


def brute_silhouette(x, label, exclude_self):
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i in range(len(x)):
        mean = {}
        for l in np.unique(label):
            mask = label == l
            n = mask.sum() - (1 if exclude_self and l == label[i] else 0)
            mean[l] = dist[i, mask].sum() / n if mask.sum() > 1 or l != label[i] else 0.0
        a = mean.pop(label[i])
        b = min(mean.values())
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("block", [1024, 16])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_silhouette(vecs, block, exclude_self):
    d, x, label = vecs
    got = O.silhouette(d, "id", "vec", "label", block, exclude_self).first()[0]
    assert got == pytest.approx(brute_silhouette(x, label, exclude_self), abs=1e-7)


@pytest.mark.parametrize("rows", [7, 64])
def test_silhouette_leaves_one_row_per_strip(rows):
    """Labels go on over batches; a task sends one sum, whatever the numbers of rows and labels."""
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(60, 3)), np.sort(rng.integers(0, 20, 60))
    names = ["strip", "own", "label", "uid", "v"]
    some = lambda strip, own, at: [(strip, own, int(label[i]), int(i), x[i].tolist()) for i in at]
    strips = [rng.permutation(60)[:25], np.arange(60), np.arange(0)]
    table = [r for k, own in enumerate(strips) for r in some(k, True, own) + some(k, False, np.arange(60))]
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table[i : i + rows]), kinds)], names=names) for i in range(0, len(table), rows)]
    got = pa.Table.from_batches(O._strip_scores(False)(iter(batches))).to_pylist()
    assert [r["n"] for r in got] == [25, 60]
    assert got[1]["s"] / 60 == pytest.approx(brute_silhouette(x, label, False), abs=1e-9)


def test_strip_keeps_one_sum_per_row():
    """What the task of a strip holds goes with its own rows, not with the rows and labels that it reads."""
    rng = np.random.default_rng(5)
    strip = O.Strip([(rng.normal(size=(10, 2)), np.arange(10), np.arange(10))], False)
    held = lambda: sum(v.nbytes for v in vars(strip).values() if isinstance(v, np.ndarray))
    before = held()
    for k in range(50):
        strip.read(rng.normal(size=(40, 2)), np.repeat(np.arange(20 * k, 20 * k + 20), 2), np.arange(40 * k, 40 * k + 40))
    assert held() == before


def test_strip_reads_labels_in_any_order():
    """A label that is in several blocks is averaged once all of them were read, whatever comes between."""
    rng = np.random.default_rng(7)
    x, label, uid = rng.normal(size=(60, 3)), np.sort(rng.integers(0, 9, 60)), np.arange(60)
    label[20:45] = label[20]  # over several blocks of 7
    label[45:] = np.maximum(label[45:], label[20])
    cuts = [slice(lo, lo + 7) for lo in range(0, 60, 7)]
    batch = pa.RecordBatch.from_pydict({"label": label, "uid": uid, "v": x.tolist()})
    packed = list(O._blocks(7)(iter([batch.slice(0, 25), batch.slice(25)])))
    shared = O._shared_labels([[(e["label"], e["n"]) for e in b.column(0)[0].as_py()] for b in packed])
    assert len(packed) == len(cuts) and shared.items() <= {int(k): int((label == k).sum()) for k in label}.items()
    for exclude_self in (False, True):
        strip = O.Strip([(x, label, uid)], exclude_self, shared)
        for k in rng.permutation(len(cuts)):
            strip.read(x[cuts[k]], label[cuts[k]], uid[cuts[k]])
        assert not strip.sums
        assert strip.score() / 60 == pytest.approx(brute_silhouette(x, label, exclude_self), abs=1e-9)
    half = O.Strip([(x, label, uid)], False, shared)
    half.read(x[cuts[3]], label[cuts[3]], uid[cuts[3]])
    with pytest.raises(RuntimeError):
        half.score()


def test_silhouette_disk_goes_with_the_rows(spark):
    """A row is stored and shuffled once, however many strips read it."""
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(2000, 8)), rng.integers(0, 5, 2000)
    d = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(2000)], "id long, vec array<double>, label long")

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (found.apply(i) for i in range(found.size()))}

    before = files()
    got = O.silhouette(d, "id", "vec", "label", 40).first()[0]
    assert got == pytest.approx(brute_silhouette(x, label, False), abs=1e-9)
    assert sum(n for k, n in files().items() if k not in before) < 10 * x.nbytes  # 50 strips


def test_silhouette_of_one_cluster(vecs):
    assert O.silhouette(vecs[0].where("label = 0"), "id", "vec", "label").first()[0] == 0.0


def test_silhouette_counts_rows(spark, vecs):
    """Rows that share an id count apart; rows without a label or a vector are left out."""
    d, x, label = vecs
    want = O.silhouette(d, "id", "vec", "label", 16).first()[0]
    more = d.withColumn("id", F.lit(1)).unionByName(spark.createDataFrame([(1, [9.0] * 5, None), (2, None, 0)], d.schema))
    assert O.silhouette(more, "id", "vec", "label", 16).first()[0] == pytest.approx(want)
    assert O.silhouette(d.limit(0), "id", "vec", "label").first()[0] == 0.0


@pytest.mark.parametrize("fan_in, held", [(256, 1 << 23), (2, 8)])
def test_moments_in_a_tree(spark, monkeypatch, fan_in, held):
    monkeypatch.setattr(MM, "FAN_IN", fan_in)
    rng = np.random.default_rng(11)
    rows = [("a" if i % 3 else None, [float(v) for v in rng.normal(size=3) + 1e5]) for i in range(200)]
    x = {k: np.array([v for g, v in rows if g == k]) for k in ("a", None)}
    more = [("a", None), ("short", [1.0, None]), ("short", [3.0]), ("short", [])]
    d = spark.createDataFrame(rows + more, "g string, v array<double>").repartition(11)
    got = {r["g"]: r for r in MM.vector_moments(d, "v", ["g"]).collect()}
    for k, v in x.items():
        assert got[k]["n"] == [len(v)] * 3 and np.allclose(got[k]["mean"], v.mean(axis=0)) and np.allclose(got[k]["m2"], v.var(axis=0) * len(v))
    assert (got["short"]["n"], got["short"]["mean"], got["short"]["m2"]) == ([2.0, 0.0], [2.0, 0.0], [2.0, 0.0])
    assert {r["g"]: r["mean"] for r in O.mean_vector(d, "v", ["g"]).collect()}["short"] == [2.0, None]
    monkeypatch.setattr(MM, "BLOCK_CELLS", held)
    whole = d.where("g is null or g = 'a'")
    cov = {(r["g"], r["i"]): r["cov"] for r in O.covariance(whole, "v", ["g"]).collect()}
    for k, v in x.items():
        assert np.allclose([cov[k, i] for i in range(3)], np.cov(v, rowvar=False))
    plan = O.covariance(whole, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" not in plan and "FlatMapGroups" not in plan
    assert MM.vector_moments(d.limit(0), "v").count() == 0 and O.covariance(d.limit(0), "v").count() == 0


def test_covariance_and_frechet(spark, vecs):
    d, x, _ = vecs
    rows = sorted(O.covariance(d, "vec").collect(), key=lambda r: r["i"])
    assert np.allclose([r["cov"] for r in rows], np.cov(x, rowvar=False)) and np.allclose(rows[0]["mean"], x.mean(axis=0))
    far = d.select("id", F.transform("vec", lambda v: v + 1e6).alias("vec"))
    assert np.allclose([r["cov"] for r in sorted(O.covariance(far, "vec").collect(), key=lambda r: r["i"])], np.cov(x, rowvar=False), atol=1e-5)
    assert O.frechet_distance(d, d).first()[0] == pytest.approx(0, abs=1e-6)
    assert O.frechet_distance(d, d.where("id < 0")).first()[0] == math.inf
    a, b = x[:45], x[45:]
    s1, s2 = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    root = np.sqrt(np.maximum(np.linalg.eigvals(s1 @ s2).real, 0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * root
    assert O.frechet_distance(d.where("id < 45"), d.where("id >= 45")).first()[0] == pytest.approx(want)
    got = O.per_sample_frechet(d.where("id = 3"), d.where("id >= 45")).first()["score"]
    assert got == pytest.approx(((x[3] - b.mean(0)) ** 2).sum() + np.trace(s2))


def test_robust_scale_and_projection(spark, vecs):
    d, x, _ = vecs
    q1, m, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    got = {r["id"]: r["scaled"] for r in O.robust_scale(d, "id", "vec").collect()}
    assert np.allclose([got[i] for i in range(90)], (x - m) / (q3 - q1))
    flat = spark.createDataFrame([(1, [2.0]), (2, [2.0])], "id int, vec array<double>")
    assert {tuple(r["scaled"]) for r in O.robust_scale(flat, "id", "vec").collect()} == {(0.0,)}
    p = {r["id"]: (r["x"], r["y"]) for r in O.project_2d(d, "id", "vec").collect()}
    got = np.array([p[i] for i in range(90)])
    w = np.linalg.eigh(np.cov(x, rowvar=False))[0]
    assert np.allclose(np.sort(got.var(axis=0, ddof=1)), w[-2:], rtol=1e-6)


@pytest.mark.parametrize("accuracy", [2_000, 10])
def test_vector_quantiles(spark, accuracy):
    rng = np.random.default_rng(12)
    x = np.round(rng.exponential(size=(300, 3)), 1)
    rows = [[float(v) for v in r] for r in x] + [None, [None, math.nan, 5.0], [7.0], []]
    d = spark.createDataFrame([(v,) for v in rows], "v array<double>").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    columns = [np.append(x[:, 0], 7.0), x[:, 1], np.append(x[:, 2], 5.0)]
    got = {(r["dim"], r["p"]): r["value"] for r in S.vector_quantiles(d, "v", probs, accuracy).collect()}
    assert len(got) == 15 and all(got[k, p] == pytest.approx(np.quantile(columns[k], p)) for k in range(3) for p in probs)
    plan = S.vector_quantiles(d, "v", probs)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan
    assert S.vector_quantiles(d.limit(0), "v", probs).count() == 0 and S.vector_quantiles(d.where("size(v) = 0"), "v", probs).count() == 0


def test_concept_vectors(spark):
    rng = np.random.default_rng(4)
    side = lambda n, shift: [[float(v) for v in rng.normal(size=6) + np.eye(6)[0] * shift] for _ in range(n)]
    concept = spark.createDataFrame([("c", i, v) for i, v in enumerate(side(40, 3))], "concept string, id long, vec array<double>")
    random = spark.createDataFrame([(1000 + i, v) for i, v in enumerate(side(80, -3))], "id long, vec array<double>")
    runs = C.train_cavs(concept, random, runs=3)
    rows = runs.collect()
    assert len(rows) == 3 and all(r["accuracy"] > 0.8 for r in rows)
    assert all(np.linalg.norm(r["cav"]) == pytest.approx(1, abs=1e-6) and r["cav"][0] > 0.7 for r in rows)
    agg = C.aggregate_cavs(runs).first()
    assert agg["num_successful_runs"] == 3 and np.linalg.norm(agg["cav"]) == pytest.approx(1, abs=1e-6)
    both = concept.select("vec", F.lit(1).alias("y")).unionByName(random.select("vec", F.lit(0).alias("y")))
    whole = C.train_cav(both, "vec", "y").first()
    assert whole["accuracy"] > 0.9 and whole["cav"][0] > 0.7
    failed = C.aggregate_cavs(spark.createDataFrame([("d", 0, [1.0], 0.5)], "concept string, run int, cav array<double>, accuracy double")).first()
    assert (failed["accuracy"], failed["num_successful_runs"], failed["cav"]) == (0.0, 0, [0.0])
    acts = concept.select(F.lit("k").alias("cls"), "vec")
    score = C.tcav_scores(acts, C.aggregate_cavs(runs).select("concept", "cav"), "vec", "cls").first()
    assert score["n"] == 40 and score["score"] > 0.9


@pytest.mark.parametrize("blocks", [1, 4])
def test_concept_scores_in_blocks(spark, blocks):
    rng = np.random.default_rng(14)
    x, c = rng.normal(size=(60, 4)), rng.normal(size=(8, 4))
    acts = spark.createDataFrame([(i, "ab"[i % 2], [float(v) for v in x[i]]) for i in range(60)], "id int, cls string, vec array<double>").repartition(5)
    cavs = spark.createDataFrame([(f"c{k}", [float(v) for v in c[k]]) for k in range(8)] + [("none", None)], "concept string, cav array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = unit(x) @ unit(c).T > 0.1
    spark.sparkContext.setJobGroup("lazy", "")
    scores, slopes = C.tcav_scores(acts, cavs, "vec", "cls", blocks=blocks), C.directional_derivative(acts, cavs, "id", "vec", blocks=blocks)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r["concept"], r["class"]): (r["n"], r["score"]) for r in scores.collect()}
    assert got == {(f"c{k}", "ab"[s]): (30, pytest.approx(want[s::2, k].mean())) for k in range(8) for s in (0, 1)}
    found = {(r["id"], r["concept"]): r["derivative"] for r in slopes.collect()}
    assert len(found) == 480 and all(found[i, f"c{k}"] == pytest.approx(x[i] @ c[k]) for i in range(60) for k in range(8))
    assert C.tcav_scores(acts, cavs.limit(0), "vec", "cls").count() == 0
    with pytest.raises(Exception, match="ask for more blocks"):
        C.tcav_scores(acts, cavs, "vec", "cls", max_concepts=5).collect()


def test_one_class_has_no_plane(spark):
    d = spark.createDataFrame([([1.0, 0.0], 1), ([0.5, 0.1], 1), (None, 0), ([1.0, 1.0], None)], "vec array<double>, y int")
    assert tuple(C.train_cav(d, "vec", "y").first()) == (None, None, None, None)


def test_decoder(spark):
    rng = np.random.default_rng(6)
    w = {"w3": rng.normal(size=(3, 4)), "b3": rng.normal(size=4), "w4": rng.normal(size=(4, 5)), "b4": rng.normal(size=5)}
    w.update({"bn2_mean": rng.normal(size=4), "bn2_var": np.full(4, 2.0), "bn2_weight": rng.normal(size=4), "bn2_bias": rng.normal(size=4)})
    z = rng.normal(size=(4, 3))
    h = (np.maximum(z @ w["w3"] + w["b3"], 0) - w["bn2_mean"]) / np.sqrt(2 + 1e-5) * w["bn2_weight"] + w["bn2_bias"]
    want = 1 / (1 + np.exp(-(h @ w["w4"] + w["b4"]) / 0.5))
    d = spark.createDataFrame([(i, [float(v) for v in z[i]]) for i in range(4)], "id int, z array<double>")
    got = {r["id"]: r["probs"] for r in MO.score_decoder(d, ["id"], "z", w, 0.5).collect()}
    assert np.allclose([got[i] for i in range(4)], want)


def stop(values, patience):
    best, wait = math.inf, 0
    for i, v in enumerate(values):
        if not math.isfinite(v):
            return i
        if v < best:
            best, wait = v, 0
        else:
            wait += 1
            if wait >= patience:
                return i
    return None


@pytest.mark.parametrize("size", [1_000_000, 10])
def test_early_stop(spark, size):
    rng = np.random.default_rng(9)
    runs = {k: list(rng.random(60) + 3 * np.exp(-np.arange(60) / 8)) for k in range(6)}
    runs[6] = [float(60 - i) for i in range(60)]
    runs[7] = [5.0, math.nan, 4.0]
    d = spark.createDataFrame([(k, i, float(v)) for k, vs in runs.items() for i, v in enumerate(vs)], "run int, step int, value double")
    got = {r["run"]: r["stop_step"] for r in R.early_stop_step(d, patience=5, per_range=size).collect()}
    assert got == {k: stop(vs, 5) for k, vs in runs.items()}
    null = d.withColumn("run", F.when(F.col("run") != 6, F.col("run")))
    assert {r["run"]: r["stop_step"] for r in R.early_stop_step(null, patience=5, per_range=size).collect()} == {**{k: v for k, v in got.items() if k != 6}, None: got[6]}


def stop_with(values, patience, delta):
    best, last = None, 0
    for i, v in enumerate(values):
        if best is None or (v is not None and v < best - delta):
            best, last = v, i + 1
        if (v is not None and not math.isfinite(v)) or i + 1 - last >= patience:
            return i
    return None


@pytest.mark.parametrize("size", [1_000_000, 7, 1])
def test_early_stop_with_least_improvement(spark, size):
    rng = np.random.default_rng(10)
    runs = {k: [float(x) for x in rng.random(40) + 4 * np.exp(-np.arange(40) / 9)] for k in range(8)}
    runs[8] = [float(50 - 0.03 * i) for i in range(100)]
    runs[9], runs[10], runs[11] = [5.0, math.nan, 1.0], [None, None, 3.0, None, 2.99, None, None, None], [7.0] * 3
    d = spark.createDataFrame([(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs)], "run int, step int, value double")
    for patience, delta in ((4, 0.1), (3, 0.02), (6, 0.5)):
        got = {r["run"]: r["stop_step"] for r in R.early_stop_step(d, patience=patience, min_delta=delta, per_range=size).collect()}
        assert got == {k: stop_with(vs, patience, delta) for k, vs in runs.items()}


def test_early_stop_limits(spark):
    values = [5.0, 4.9, 4.85, 4.0, 3.99, 3.98, 3.97, 2.0, 9.0, 0.5]
    d = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, step int, value double")
    at = lambda **kw: R.early_stop_step(d, **kw).first()["stop_step"]
    assert at(patience=3) is None and at(patience=3, min_delta=0.1) == 6 and at(patience=2, min_delta=0.2) == 2
    assert at(patience=9, stopping=2.5) == 7 and at(patience=9, divergence=8.0) == 8 and at(patience=9, min_delta=0.1, divergence=8.0) == 8
    assert at(patience=3, mode="max", min_delta=0.01) == 3


def test_run_logs(spark):
    d = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("b", 1, 1.0)], "run string, step int, value double")
    assert R.best_run(d).first()["run"] == "a" and R.best_run(d, mode="max").first()["run"] == "a"
    assert {(r["run"], r["value"]) for r in R.latest_metrics(d, ["run"]).collect()} == {("a", 1.0), ("b", 1.0)}
    assert [r["step"] for r in R.best_checkpoints(d, ["run"], 1).orderBy("run").collect()] == [2, 1]
    text = '{"bleu": 0.5, "p": [1, 2], "rouge": {"r1": 0.25, "note": "x", "all": [1, 3]}, "name": "y", "empty": []}'
    flat = R.flatten_metrics(spark.createDataFrame([(1, text)], "id int, j string"), ["id"], "j")
    odd = R.flatten_metrics(spark.createDataFrame([(1, '{"p": [1, null, 3], "q": [null], "r": {"s": [2, null]}}')], "id int, j string"), ["id"], "j")
    assert {r["name"]: r["value"] for r in odd.collect()} == {"p": 2.0, "r_s": 2.0}
    assert {r["name"]: r["value"] for r in flat.collect()} == {"bleu": 0.5, "p": 1.5, "rouge_r1": 0.25, "rouge_all": 2.0}
