"""Edge rows of the column functions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import hashing as H
from tagloom.functions import text as X
from tagloom.functions import tokens as K
from tagloom.functions import vectors as V


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.mark.parametrize("tags", [[], ["a"], ["children's choir"], ["a, b", 'say "hi"'], ["it's \"both\""], ["back\\slash"], ["ünï", "日本"]])
def test_literal_round_trip(spark, tags):
    df = spark.createDataFrame([(tags,)], "t array<string>")
    text = df.select(X.render_tag_literal("t")).first()[0]
    assert text == repr(tags)
    assert df.select(X.parse_tag_literal(X.render_tag_literal("t"))).first()[0] == tags


@pytest.mark.parametrize("text", ["", "['open", "not a list", None])
def test_malformed_literal_is_null(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.parse_tag_literal("t")).first()[0] is None


def test_split_tags(spark):
    r = one(spark, a=X.split_tags(F.lit(""), ", "), b=X.split_tags(F.lit(""), ", ", legacy_empty=True), c=X.split_tags(F.lit("x | y|z "), "|"), d=X.split_tags(F.lit("x, y"), ",", trim=False))
    assert (r.a, r.b, r.c, r.d) == ([], [""], ["x", "y", "z"], ["x", " y"])


def test_remove_phrase_is_literal(spark):
    r = one(spark, a=X.remove_phrase(F.lit("A Low Quality song, low  quality"), "low quality"), b=X.remove_phrase(F.lit("a.b axb"), "a.b"))
    assert r.a == "A  song, low  quality" and r.b == " axb"


def test_template_values_are_not_refilled(spark):
    r = one(spark, a=X.fill_template("<{x}|{y}>", x=F.lit("{y}"), y=F.lit("1")))
    assert r.a == "<{y}|1>"


JUDGED = {
    "Score: 8/10": 8.0, "Score: 8": 8.0, "Score: 42": 10.0, "Score: 0": 1.0, "Score: -3": 1.0, "Score: abc": 5.0, "Score:": 5.0, "": 5.0,
    "no score": 5.0, "  Score: 7.5 of 10": 7.5, "Score: 2\nScore: 9": 9.0, "Score: 8d": 5.0, "Score:\t6\nReasoning: x": 6.0, "Score: /10": 5.0,
}


@pytest.mark.parametrize("reply,score", JUDGED.items())
def test_judge_score(spark, reply, score):
    assert one(spark, s=X.parse_judge_score(F.lit(reply))).s == score


def test_judge_reasoning(spark):
    r = one(spark, a=X.parse_judge_reasoning(F.lit("Score: 1\n Reasoning: good tune ")), b=X.parse_judge_reasoning(F.lit("Reasoning:")))
    assert (r.a, r.b) == ("good tune", "No reasoning provided")


def test_strip_prefix(spark):
    r = one(spark, a=X.strip_prefix(F.lit("PROMPT  text \n"), F.lit("PROMPT")), b=X.strip_prefix(F.lit(" text "), F.lit("PROMPT")))
    assert (r.a, r.b) == ("text", " text ")


def test_words_split_like_python(spark):
    text = "a\tb c d\x0be\x1ff\u0085g  \n h"
    assert one(spark, w=X.words(F.lit(text))).w == text.split()


def test_multiset_overlap(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    r = one(spark, a=X.multiset_overlap(arr("x", "y", "x", "x"), arr("x", "x", "z")), b=X.multiset_overlap(F.array().cast("array<string>"), arr("x")), c=X.multiset_overlap(arr("b", "a"), arr("a", "b")))
    assert (r.a, r.b, r.c) == (2, 0, 2)


def test_ngrams(spark):
    a = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    r = one(spark, two=X.ngrams(a, 2), three=X.ngrams(a, 3), four=X.ngrams(a, 4))
    assert (r.two, r.three, r.four) == (["x y", "y z"], ["x y z"], [])


def test_mask_labels(spark):
    ids = lambda *v: F.array(*[F.lit(x) for x in v])
    r = one(spark, a=K.mask_labels(ids(1, 7, 3, 5, 7, 3), [7, 3]), b=K.mask_labels(ids(1, 7, 4), [7, 3]), c=K.mask_labels(ids(7), [7, 3]), d=K.mask_labels(ids(7, 3), [7, 3]), e=K.mask_labels(ids(4, 5), [4]))
    assert r.a == [-100, -100, -100, 5, 7, 3]
    assert (r.b, r.c, r.d, r.e) == ([-100] * 3, [-100], [-100] * 2, [-100, 5])


def test_padding(spark):
    ids = F.array(F.lit(5), F.lit(6))
    r = one(spark, a=K.pad(ids, 4, 0), b=K.pad(ids, 4, 0, "left"), c=K.attention_mask(ids, 4), d=K.with_end_token(ids, 6), e=K.with_end_token(ids, 9), f=K.truncate(ids, 1), g=K.pad(ids, 1, 0))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ([5, 6, 0, 0], [0, 0, 5, 6], [1, 1, 0, 0], [5, 6], [5, 6, 9], [5], [5, 6])


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    r = one(
        spark, unit=V.l2_normalize(v(3, 4)), zero=V.l2_normalize(v(0, 0)), cos=V.cosine(v(1, 0), v(0, 0)), clip=V.clip(v(-2, 0.5, 3)),
        silent=V.peak_normalize(v(0, 0)), peak=V.peak_normalize(v(-4, 2)), short=V.fix_length(v(1, 2), 3), long=V.fix_length(v(1, 2, 3), 2),
        arg=V.argmax(v(1, 5, 5)), rep=V.reparameterize(v(1), v(2), v(0.5)),
    )
    assert r.unit == [0.6, 0.8] and r.zero == [0.0, 0.0] and r.cos is None and r.clip == [-1.0, 0.5, 1.0]
    assert r.silent == [0.0, 0.0] and r.peak == [-1.0, 0.5] and r.short == [1.0, 2.0, 0.0] and r.long == [1.0, 2.0] and r.arg == 1
    assert r.rep[0] == pytest.approx(1 + 0.5 * math.exp(1.0))


def test_hashes_match_python(spark):
    digest = hashlib.md5(b"7:42").hexdigest()
    r = one(spark, k=H.hash_key(7, F.lit(42)), u=H.hash_uniform(F.lit(7), F.lit(42)))
    assert r.k == digest and r.u == int(digest[:8], 16) / 2**32


def test_hash_normal_is_standard(spark):
    x = np.array([r[0] for r in spark.range(4000).select(H.hash_normal(F.lit(1), F.col("id"))).collect()])
    assert abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.05
