"""Taxonomy, categories, pair counts and multi-label metrics against plain Python."""

import itertools
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import cooccurrence as co
from tagloom.operators import multilabel as M
from tagloom.operators import stats as S
from tagloom.operators import tags as T
from tagloom.operators.taxonomy import Taxonomy, taxonomy_summary
from tagloom.sources import documents as JS


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """Four categories of fifty tags, in an order that is not alphabetical."""
    path = tmp_path_factory.mktemp("taxonomy") / "tags.json"
    data = {c: [f"{c} {49 - i}" for i in range(50)] for c in ("tempo", "genre", "mood", "instrument")}
    path.write_text(json.dumps(data))
    return Taxonomy.from_json(spark, str(path)), data


@pytest.fixture(scope="module")
def small(spark):
    rows = [("genre", 0, "pop"), ("genre", 0, "slow rock"), ("mood", 1, "sad"), ("instrument", 2, "guitar"), ("instrument", 2, "no percussion"), ("instrument", 2, "no voices"), ("tempo", 3, "slow tempo")]
    return Taxonomy.from_frame(spark.createDataFrame(rows, "category string, cat_pos int, tag string"))


def test_json_keeps_order(big):
    tax, data = big
    assert tax.size == 200 and tax.categories == list(data) and tax.tags("tempo") == data["tempo"]
    got = {r["category"]: (r["start"], r["end_excl"]) for r in tax.ranges().collect()}
    assert got == {"tempo": (0, 50), "genre": (50, 100), "mood": (100, 150), "instrument": (150, 200)}
    assert {r["category"]: r["examples"] for r in taxonomy_summary(tax.frame).collect()}["mood"] == "mood 49, mood 48, mood 47"


def test_taxonomy_size_is_checked(spark):
    tags = spark.range(20).select(F.lit("c").alias("category"), F.lit(0).alias("cat_pos"), F.col("id").cast("string").alias("tag"))
    with pytest.raises(ValueError):
        Taxonomy.from_frame(tags, max_tags=19)


def test_example_record(spark, small):
    df = spark.createDataFrame([(1, ["guitar", "no percussion", "no voices", "pop", "slow rock", "slow tempo", "Pop", "noise"])], "id int, tags array<string>")
    r = T.categorize_tags(df, small, suffix="_aspects", on_unknown="collect").first()
    assert r.genre_aspects == ["pop", "slow rock"] and r.mood_aspects == [] and r.tempo_aspects == ["slow tempo"]
    assert r.instrument_aspects == ["guitar", "no percussion", "no voices"] and r.None_aspects == ["Pop", "noise"]
    folded = T.categorize_tags(df, small, normalize_case=True).first()
    assert folded.genre_tags == ["pop", "slow rock", "pop"]
    assert T.extract_tags(df, small).first().instrument_tags == ["guitar", "no percussion", "no voices"]


def test_min_categories_and_parse_errors(spark, small):
    df = spark.createDataFrame([(1, "['pop', 'sad', 'guitar']"), (2, "['pop', 'sad']"), (3, "['pop'"), (4, "[]")], "id int, tags string")
    parsed = T.parse_tag_lists(df, "tags")
    assert sorted(r["id"] for r in parsed.collect()) == [1, 2, 4]
    assert T.parse_tag_lists(df, "tags", "empty").where("id = 3").first()["tags"] == []
    wide = T.categorize_tags(parsed, small)
    cols = [c + "_tags" for c in small.categories]
    assert [r["id"] for r in T.min_categories(wide, cols).collect()] == [1]


def test_join_form_agrees(spark, small):
    df = spark.createDataFrame([(1, ["sad", "pop", "x"]), (2, []), (3, ["x"])], "id int, tags array<string>")
    a = {r["id"]: r for r in T.categorize_by_join(df, small.frame, small.categories, "id", "tags").collect()}
    assert a[1]["genre_tags"] == ["pop"] and a[2]["mood_tags"] == [] and a[3]["tempo_tags"] == []


def test_seed_needs_two_tags(spark):
    df = spark.createDataFrame([(1, ["a"], ["b", "c"])], "id int, g array<string>, m array<string>")
    assert df.select(T.seed_tags(["g", "m"], "id", 1).alias("s")).first()["s"][0] in ("b", "c")
    assert len(df.select(T.seed_tags(["g", "m"], "id", 1).alias("s")).first()["s"]) == 1


def test_top_per_group_salted(spark):
    df = spark.range(6000).select((F.col("id") % 3 == 0).alias("g"), "id")
    got = T.top_per_group(df, ["g"], [F.col("id")], 1500)
    assert got.groupBy("g").count().collect()[0]["count"] == 1500
    assert got.where("g").agg(F.max("id")).first()[0] == 3 * 1499
    assert got.where("g").agg(F.max("rnk")).first()[0] == 1500


SETS = [[0, 1], [1], [0, 1, 2], [], [2, 0], [0, 1]]


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(3)
    p = rng.random((len(SETS), 4))
    rows = [(i, [float(x) for x in p[i]], s) for i, s in enumerate(SETS)]
    return spark.createDataFrame(rows, "id int, probs array<double>, tag_idx array<int>"), p


def test_cooccurrence_two_ways(spark, preds, monkeypatch):
    df, _ = preds
    want = Counter((a, b) for s in SETS for a in s for b in s)
    got = {(r["a"], r["b"]): r["n"] for r in co.cooccurrence(df, 4).collect()}
    assert got == want
    monkeypatch.setattr(co, "DENSE_LIMIT", 2)
    assert {(r["a"], r["b"]): r["n"] for r in co.cooccurrence(df, 4).collect()} == want
    assert all(want[a, b] == want[b, a] for a, b in want)


def dense(sets, n=4):
    x = np.zeros((len(sets), n))
    for i, s in enumerate(sets):
        x[i, s] = 1
    return x


def test_compare_cooccurrence(spark, preds):
    df, p = preds
    x, y = (p > 0.5).astype(float), dense(SETS)
    a, b = (x.T @ x).ravel(), (y.T @ y).ravel()
    u, v = a / (a.sum() + 1e-10), b / (b.sum() + 1e-10)
    guess = df.withColumn("g", M.predicted("probs", 0.5))
    r = co.compare_cooccurrence(co.cooccurrence_of(guess, 4, {"p": "g", "o": "tag_idx"}), 4, "p", "o").first()
    assert r.cosine_similarity == pytest.approx(u @ v / (np.linalg.norm(u) * np.linalg.norm(v) + 1e-10))
    assert r.kl_divergence == pytest.approx(np.sum(v * np.log((v + 1e-10) / (u + 1e-10))))
    assert r.hellinger_distance == pytest.approx(np.sqrt(0.5 * np.sum((np.sqrt(u) - np.sqrt(v)) ** 2)))
    assert r.pearson_correlation == pytest.approx(np.corrcoef(a, b)[0, 1])
    same = co.compare_cooccurrence(co.cooccurrence_of(df, 4, {"p": "tag_idx", "o": "tag_idx"}), 4, "p", "o").first()
    assert same.kl_divergence == pytest.approx(0, abs=1e-9) and same.cosine_similarity == pytest.approx(1)
    constant = spark.createDataFrame([([0, 1],)], "t array<int>")
    flat = co.compare_cooccurrence(co.cooccurrence_of(constant, 2, {"p": "t", "o": "t"}), 2, "p", "o").first()
    assert flat.pearson_correlation == 0.0


def test_agreement(spark, preds):
    df, p = preds
    x, y = p > 0.5, dense(SETS) > 0
    assert M.hamming_loss(df).first()[0] == pytest.approx((x != y).mean())
    assert M.jaccard_micro(df).first()[0] == pytest.approx((x & y).sum() / (x | y).sum())
    perfect = spark.createDataFrame([([1.0, 0.0], [0])], "probs array<double>, tag_idx array<int>")
    assert M.hamming_loss(perfect).first()[0] == 0.0 and M.jaccard_micro(perfect).first()[0] == 1.0
    nothing = spark.createDataFrame([([0.0, 0.0], [])], "probs array<double>, tag_idx array<int>")
    assert M.jaccard_micro(nothing).first()[0] == 1.0


def test_diversity(spark):
    counts = [1, 1, 2, 5, 5, 9]
    combos = spark.createDataFrame([(str(i), c) for i, c in enumerate(counts)], "combo string, n long")
    r = M.combination_diversity(combos).first()
    n, total, p = len(counts), sum(counts), np.array(counts) / sum(counts)
    gini = 2 * sum((i + 1) * c for i, c in enumerate(sorted(counts))) / (n * total) - (n + 1) / n
    assert r.gini_coefficient == pytest.approx(gini) and r.unique_combinations == n
    assert r.entropy == pytest.approx(-np.sum(p * np.log(p + 1e-10))) and r.entropy <= math.log(n) + 1e-9


def test_sampling_stats(preds):
    df, p = preds
    r = M.sampling_stats(df).first()
    on = (p > 0.5).sum(axis=1)
    h = -(p * np.log(p + 1e-8) + (1 - p) * np.log(1 - p + 1e-8))
    assert r.avg_tags_per_sample == pytest.approx(on.mean()) and r.std_tags_per_sample == pytest.approx(on.std(ddof=1))
    assert r.mean_probability == pytest.approx(p.mean()) and r.std_probability == pytest.approx(p.std(ddof=1))
    assert r.avg_entropy == pytest.approx(h.sum(axis=1).mean()) and r.unique_combinations == len({tuple(x) for x in p > 0.5})


def test_loss_terms(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.3], [0, 1], [0.1, -0.2], [0.0, 0.5])], "probs array<double>, tag_idx array<int>, mu array<double>, lv array<double>")
    r = M.vae_loss_terms(df, "mu", "lv", beta=2.0).first()
    bce = 100.0 - math.log(0.7)
    kld = -0.5 * sum(1 + lv - m * m - math.exp(lv) for m, lv in ((0.1, 0.0), (-0.2, 0.5)))
    assert r.bce == pytest.approx(bce) and r.kld == pytest.approx(kld) and r.loss == pytest.approx(bce + 2 * kld)
    assert M.vae_loss_terms(df, "mu", "lv", squared=True).first().bce == pytest.approx(0 + 1 + 0.09)


def test_vae_loss_terms_of_odd_rows(spark):
    """Nulls, unequal lengths, tags out of range and tags that come twice; the terms are summed per batch, not in lambdas."""
    rows = [
        (1, [0.5, 0.25], [1, 1, 7, -1, None], [1.0], [0.0]), (2, None, [0], [1.0, 2.0], [0.0]), (3, [0.5], None, None, [0.0]),
        (4, [], [0], [], []), (5, [None, 0.0, 1.5], [1], [None], [0.0]),
    ]
    d = spark.createDataFrame(rows, "id int, probs array<double>, tag_idx array<int>, mu array<double>, lv array<double>").coalesce(1)
    out = M.vae_loss_terms(d, "mu", "lv")
    got = out.first()
    assert got.bce == pytest.approx(math.log(2) + math.log(4) + math.log(2) + 100 + 100 + 100)
    assert got.kld == pytest.approx(0.5)
    assert M.vae_loss_terms(d, "mu", "lv", squared=True).first().bce == pytest.approx(0.25 + 0.75**2 + 0.25)
    assert M.vae_loss_terms(d.limit(0), "mu", "lv").first().loss is None
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_conditional_model(spark, preds):
    df, _ = preds
    model = {(r["a"], r["b"]): r["prob"] for r in co.conditional_tag_model(co.cooccurrence(df, 4)).collect()}
    assert model[0, 1] == pytest.approx(3 / 4) and model[2, 0] == pytest.approx(1.0)


def test_tag_share_fills_zero(spark):
    rows = [("a", "g", "x", 3), ("a", "g", "y", 1), ("b", "g", "x", 2), ("b", "m", "z", 5)]
    freq = spark.createDataFrame(rows, "dataset string, category string, tag string, n long")
    got = {r["tag"]: (r["a_count"], r["b_count"], r["a_pct"], r["b_pct"]) for r in S.tag_share(freq, "a", "b").collect()}
    assert got == {"x": (3, 2, 75.0, 100.0), "y": (1, 0, 25.0, 0.0), "z": (0, 5, 0.0, 100.0)}


def test_results_json(spark):
    cats = {"tempo": 6, "instrument": 14}
    doc = {c: {f"{c}{i}": {"cav_accuracy": 0.65, "genre_scores": {f"g{j}": j / 10 for j in range(10)}} for i in range(n)} for c, n in cats.items()}
    long = JS.results_long(spark.createDataFrame([(json.dumps(doc),)], "j string"), "j")
    assert long.count() == 200
    assert long.where("concept = 'tempo3' AND genre = 'g4'").first()["score"] == 0.4


def test_pairs_of_a_hot_sample(spark):
    """A third of the rows in one sample: its set stays as small as the vocabulary."""
    raw = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"), (F.col("id") % 7).cast("int").alias("t"))
    sets = raw.groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("t"))
    got = {(r["a"], r["b"]): r["n"] for r in co.cooccurrence(sets, 7, "t").collect()}
    rows = {}
    for i in range(9000):
        rows.setdefault(0 if i % 3 == 0 else i, set()).add(i % 7)
    assert got == Counter(p for s in rows.values() for p in itertools.product(s, s))


def test_encode_by_buckets(spark):
    """Quotes, backslashes and unknown or NULL tags; the plan holds the dimension as one constant."""
    from tagloom.operators.taxonomy import Taxonomy

    names = ["it's", "back\\slash", 'dou"ble', "plain", "é", ""]
    dim = spark.createDataFrame([("c", 0, t, i) for i, t in enumerate(names)], "category string, cat_pos int, tag string, tag_pos int")
    tax = Taxonomy.from_frame(dim)
    rows = [(1, names[::-1]), (2, ["plain", "plain", "none", None]), (3, []), (4, None), (5, ["É", "PLAIN"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    assert {r["id"]: r["tag_idx"] for r in tax.encode(df, "t").collect()} == {1: [0, 1, 2, 3, 4, 5], 2: [3], 3: [], 4: None, 5: []}
    assert {r["id"]: r["tag_idx"] for r in tax.encode(df, "t", normalize_case=True).collect()}[5] == [3, 4]
    assert spark.range(1).select(tax.tags_column().alias("x")).first()["x"] == names
