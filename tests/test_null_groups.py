"""Groups without a name, vectors and concepts beyond former bounds, and inputs that used to fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import concepts as C
from tagloom.operators import cooccurrence as co
from tagloom.operators import stats as S
from tagloom.operators import vectors as V
from tagloom.operators.multilabel import silhouette_multi_hot
from tagloom.operators.prompts import extract_prompt


def test_statistics_keep_the_null_group(spark):
    d = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").alias("g"), F.rand(1).alias("v"))
    assert {r["g"] for r in S.kde_grid(d, "v", ["g"], points=5).collect()} == {"a", None}
    assert {r["g"] for r in S.exact_quantiles(d, "v", [0.5], ["g"]).collect()} == {"a", None}


def test_prompt_mask_is_the_given_one(spark):
    rows = [(None, [0, 0, 5, 7, 3], [0, 0, 1, 1, 1]), (None, [4, 7, 3], [1, 1, 1])]
    d = spark.createDataFrame(rows, "b string, ids array<int>, mask array<int>")
    out = {tuple(r["prompt"]): r["attention_mask"] for r in extract_prompt(d, "b", "ids", [7, 3], 9, "mask").collect()}
    assert len(out) == 2 and all(len(k) == len(v) for k, v in out.items())
    long = next(v for k, v in out.items() if k[:2] == (0, 0))
    assert long[:3] == [0, 0, 1]


def test_wide_vectors_are_scaled_whole(spark):
    d = spark.createDataFrame([(i, [float(i * (j + 1)) for j in range(5000)]) for i in range(3)], "id int, vec array<double>")
    out = {r["id"]: r["scaled"] for r in V.robust_scale(d, "id", "vec").collect()}
    assert out[1] == [0.0] * 5000 and out[0] == pytest.approx([-1.0] * 5000)


def test_one_row_has_no_spread(spark):
    side = lambda *v: spark.createDataFrame([(list(x),) for x in v], "vec array<double>")
    got = V.frechet_distance(side([1.0, 2.0]), side([0.0, 0.0], [2.0, 0.0])).first()[0]
    assert got == pytest.approx(0 + 4 + 2.0)


def test_failed_concept_has_a_zero_vector(spark):
    d = spark.createDataFrame([("a", [3.0, 4.0], 0.9), ("b", [1.0, 0.0], 0.1)], "concept string, cav array<double>, accuracy double")
    assert {r["concept"]: r["cav"] for r in C.aggregate_cavs(d).collect()} == {"a": pytest.approx([0.6, 0.8]), "b": [0.0, 0.0]}


def test_every_concept_meets_the_random_set(spark):
    rng = np.random.default_rng(1)
    concepts = [(f"c{k}", i, [float(x) for x in rng.normal(k % 3, 1, 4)]) for k in range(12) for i in range(6)]
    random = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(10)]
    out = C.train_cavs(spark.createDataFrame(concepts, "concept string, id int, vec array<double>"), spark.createDataFrame(random, "id int, vec array<double>"), 2).collect()
    assert len(out) == 24 and all(abs(np.linalg.norm(r["cav"]) - 1) < 1e-6 for r in out)


def test_rows_without_a_draw_stay(spark):
    model = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.0)], "a long, b long, prob double")
    rows = spark.createDataFrame([(1, 1), (2, 7), (3, None)], "id long, s long")
    assert {(r["id"], r["a"]): r["tag_idx"] for r in co.sample_conditional(rows, model, "id", "s", 1).collect()} == {(1, 1): [2], (2, 7): [], (3, None): []}


@pytest.mark.parametrize("text, want", [
    ("['a', 'b',]", ["a", "b"]), ("['a' 'b']", ["ab"]), ("('a','b')", ["a", "b"]), ("('a',)", ["a"]), ("('a')", None), ("[]", []), ("()", []), (r"['caf\xe9', 'é', 'it\'s']", ["café", "é", "it's"]),
    (r"""["a, 'b'", 'c\\xe9']""", ["a, 'b'", r"c\xe9"]), ("['a',, 'b']", None), ("[,]", None), ("['a'", None), ("[1]", None), ("[None]", None), ("", None), (None, None),
])
def test_literals(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.parse_tag_literal("t")).first()[0] == want


def test_rendered_as_python_prints(spark):
    tags = ["a\nb", "tab\t", "nul\x00", "é", "\x85", "​", "it's", 'say "hi"', "\\", " ", "\U000e0001", "日本"]
    got = spark.createDataFrame([(tags,)], "t array<string>").select(X.render_tag_literal("t")).first()[0]
    assert got == repr(tags)


def test_templates(spark):
    assert spark.range(1).select(X.fill_template("{{x}} {x} {{{x}}}", x=F.lit("q"))).first()[0] == "{x} q {q}"
    X.check_template("{a} ### {b}", ["a", "b"], "###")
    for bad in (("{a}", ["a", "b"], ""), ("{{a}}", ["a"], ""), ("{a}", ["a"], "###")):
        with pytest.raises(ValueError):
            X.check_template(*bad)


def test_silhouette_of_tag_sets(spark):
    d = spark.createDataFrame([(1, [0.0], [3, 5]), (2, [0.1], [3]), (3, [9.0], [4]), (4, [9.1], [4]), (5, [50.0], [])], "id int, vec array<double>, tag_idx array<int>")
    assert silhouette_multi_hot(d, "id", "vec").first()[0] > 0.98
