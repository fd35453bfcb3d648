"""Queries for captions, prompts, judge replies, token arrays and text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.functions import tokens as K
from tagloom.functions.hashing import hash_uniform
from tagloom.operators import runs as R
from tagloom.operators import sets as J
from tagloom.operators import textmetrics as M
from tagloom.plans.registry import ORACLES, query
from tagloom.plans.stat_queries import rounded
from tagloom.session import scratch_path
from tagloom.sources import documents as JS
from tagloom.plans.views import (
    captions, doc_tokens, embeddings, judge_replies, sql_words, table, text_pairs, with_views, WS,
)

LF = "chr(10)"


@query("remove_phrase", "SELECT doc_id AS id, md5(regexp_replace(text, 'the', '', 'gi')) AS digest, length(regexp_replace(text, 'the', '', 'gi'))::BIGINT AS n_chars FROM documents")
def remove_phrase(spark, sf):
    d = captions(spark, sf).withColumn("caption", X.remove_phrase("caption", "the"))
    return d.select("id", F.md5("caption").alias("digest"), X.char_count("caption").alias("n_chars"))


# A chat template in the shape the captioning runs use.
TRAIN_TEMPLATE = "<|system|>{system_prompt}<|end|>\n<|user|>{user_prompt}<|end|>\n<|assistant|>{assistant_response}<|end|>\n"
EVAL_TEMPLATE = "<|system|>{system_prompt}<|end|>\n<|user|>{user_prompt}<|end|>\n<|assistant|>\n"
SYSTEM_PROMPT = "You describe songs from their characteristics."
USER_TEMPLATE = "Write a short description of a song with these tags:{tags}"


def user_prompt(tags):
    return X.fill_template(USER_TEMPLATE, tags=tags)


@query("format_train_prompt", f"""SELECT doc_id AS id, md5(p) AS digest, length(p)::BIGINT AS n_chars FROM (SELECT doc_id,
    rtrim('<|system|>{SYSTEM_PROMPT}<|end|>' || {LF} || '<|user|>Write a short description of a song with these tags:' || lang || ', ' || source || '<|end|>' || {LF} || '<|assistant|>' || text || '<|end|>' || {LF}, {LF}) AS p FROM documents)""")
def format_train_prompt(spark, sf):
    tags = F.concat_ws(", ", "lang", "source")
    prompt = X.strip(X.fill_template(TRAIN_TEMPLATE, system_prompt=SYSTEM_PROMPT, user_prompt=user_prompt(tags), assistant_response=F.col("text")))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), prompt.alias("p"))
    return d.select("id", F.md5("p").alias("digest"), X.char_count("p").alias("n_chars"))


@query("format_eval_prompt", f"""SELECT doc_id AS id, lang || ', ' || source AS aspect_list,
    '<|system|>{SYSTEM_PROMPT}<|end|>' || {LF} || '<|user|>Write a short description of a song with these tags:' || lang || ', ' || source || '<|end|>' || {LF} || '<|assistant|>' AS text FROM documents""")
def format_eval_prompt(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(", ", "lang", "source").alias("aspect_list"))
    prompt = X.fill_template(EVAL_TEMPLATE, system_prompt=SYSTEM_PROMPT, user_prompt=user_prompt(F.col("aspect_list")))
    return d.select("id", "aspect_list", X.strip(prompt).alias("text"))


JUDGE_TEMPLATE = "Rate the description from 1 to 10.\nTags: {prompt}\nDescription: {caption}\nScore:"


@query("judge_prompt", with_views("pairs", f"SELECT id, md5('Rate the description from 1 to 10.' || {LF} || 'Tags: ' || reference || {LF} || 'Description: ' || prediction || {LF} || 'Score:') AS digest FROM pairs"))
def judge_prompt(spark, sf):
    d = text_pairs(spark, sf)
    return d.select("id", F.md5(X.fill_template(JUDGE_TEMPLATE, prompt=F.col("reference"), caption=F.col("prediction"))).alias("digest"))


@query("strip_prefix", with_views("pairs", rf"""SELECT id, md5(regexp_replace(CASE WHEN length(prediction) % 2 = 0 THEN prediction ELSE 'no prompt ' || prediction END, '^{WS}|{WS}$', '', 'g')) AS digest FROM pairs"""))
def strip_prefix(spark, sf):
    d = text_pairs(spark, sf)
    echoed = F.char_length("prediction") % 2 == 0
    out = F.when(echoed, F.concat("reference", F.lit(" \n"), "prediction")).otherwise(F.concat(F.lit("no prompt "), "prediction"))
    d = d.select("id", "reference", out.alias("output"))
    return d.select("id", F.md5(X.strip(X.strip_prefix("output", "reference"))).alias("digest"))


JUDGE_SQL = r"""SELECT id, CASE id % 7 WHEN 0 THEN greatest(1, least(10, id % 14)) WHEN 1 THEN greatest(1, least(10, id % 14 + 0.5)) WHEN 4 THEN greatest(1, least(10, id % 14)) ELSE 5 END::DOUBLE AS score,
    CASE id % 7 WHEN 0 THEN 'text of ' || lang WHEN 2 THEN 'from ' || source WHEN 4 THEN 'last one wins' WHEN 6 THEN 'no line starts with it' ELSE 'No reasoning provided' END AS reasoning
    FROM (SELECT doc_id AS id, lang, source FROM documents)"""


@query("parse_judge", JUDGE_SQL)
def parse_judge(spark, sf):
    d = judge_replies(spark, sf)
    return d.select("id", X.parse_judge_score("reply").alias("score"), X.parse_judge_reasoning("reply").alias("reasoning"))


@query("judge_stats", f"SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max FROM ({JUDGE_SQL})")
def judge_stats(spark, sf):
    return rounded(M.judge_stats(judge_replies(spark, sf).select(X.parse_judge_score("reply").alias("s")), "s"), "mean", "std")


END_ID, PAD_ID, MAX_LEN = 99, 0, 256


def ids_text(c):
    return F.array_join(c.cast("array<string>"), ",")


@query("pad_tokens", with_views("doc_tokens", f"""SELECT id, len(t)::BIGINT AS n, md5(array_to_string(list_concat(t, list_transform(range({MAX_LEN} - len(t)), lambda x: {PAD_ID})), ',')) AS right_padded,
    md5(array_to_string(list_concat(list_transform(range({MAX_LEN} - len(t)), lambda x: {PAD_ID}), t), ',')) AS left_padded
    FROM (SELECT id, list_slice(list_append(ids, {END_ID}), 1, {MAX_LEN}) AS t FROM doc_tokens)"""))
def pad_tokens(spark, sf):
    d = doc_tokens(spark, sf).select("id", K.truncate(K.with_end_token("ids", END_ID), MAX_LEN).alias("t"))
    n = F.aggregate(K.attention_mask("t", MAX_LEN), F.lit(0), lambda s, x: s + x).cast("bigint")
    right, left = K.pad("t", MAX_LEN, PAD_ID), K.pad("t", MAX_LEN, PAD_ID, "left")
    return d.select("id", n.alias("n"), F.md5(ids_text(right)).alias("right_padded"), F.md5(ids_text(left)).alias("left_padded"))


DELIM = [7, 3]
DELIM_END = "coalesce(list_filter(range(1, len(ids)), lambda j: ids[j] = 7 AND ids[j + 1] = 3)[1] + 1, 0)"


@query("mask_labels", with_views("doc_tokens", f"""SELECT id, list_sum(list_transform(l, lambda x: (x = -100)::INT))::BIGINT AS n_masked, md5(array_to_string(l, ',')) AS digest FROM (
    SELECT id, list_transform(ids, lambda x, i: CASE WHEN e = 0 OR i <= e THEN -100 ELSE x END) AS l FROM (SELECT id, ids, {DELIM_END} AS e FROM doc_tokens))"""))
def mask_labels(spark, sf):
    d = doc_tokens(spark, sf).select("id", K.mask_labels("ids", DELIM).alias("l"))
    n = F.size(F.filter("l", lambda x: x == K.IGNORED)).cast("bigint")
    return d.select("id", n.alias("n_masked"), F.md5(ids_text(F.col("l"))).alias("digest"))


@query("extract_prompt", with_views("doc_tokens", f"""SELECT id, e::BIGINT AS prompt_len, md5(array_to_string(list_concat(list_slice(ids, 1, e), list_transform(range(longest - e), lambda x: {PAD_ID})), ',')) AS digest,
    md5(array_to_string(list_concat(list_transform(list_slice(ids, 1, e), lambda x: (x % 5 > 0)::INT), list_transform(range(longest - e), lambda x: 0)), ',')) AS mask FROM (
    SELECT id, ids, e, max(e) OVER (PARTITION BY source) AS longest FROM (SELECT id, source, ids, {DELIM_END} AS e FROM doc_tokens) WHERE e > 0)"""))
def extract_prompt(spark, sf):
    from tagloom.operators.prompts import extract_prompt as cut

    masked = doc_tokens(spark, sf).withColumn("mask", F.transform("ids", lambda x: (x % 5 > 0).cast("int")))
    d = cut(masked, "source", "ids", DELIM, PAD_ID, "mask")
    return d.select("id", "prompt_len", F.md5(ids_text(F.col("prompt"))).alias("digest"), F.md5(ids_text(F.col("attention_mask"))).alias("mask"))


WAVE = "SELECT page_id AS id, list_transform(range(1, length(url) + 1), lambda j: (ascii(substr(url, j, 1)) - 90) / 20.0::DOUBLE) AS w FROM pages"


def waves(spark, sf):
    sample = lambda j: (F.ascii(F.substring(F.col("url"), j, F.lit(1))) - 90) / 20.0
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.transform(F.sequence(F.lit(1), F.char_length("url")), sample).alias("w"))


@query("fix_length", f"""SELECT id, 40::BIGINT AS n, round(list_sum(list_slice(w, 1, 40)), 6) AS total, round(CASE WHEN len(w) >= 40 THEN w[40] ELSE 0 END, 6) AS last FROM ({WAVE})""")
def fix_length(spark, sf):
    from tagloom.functions.vectors import fix_length as fix, total

    d = waves(spark, sf).select("id", fix("w", 40).alias("w"))
    return d.select("id", F.size("w").cast("bigint").alias("n"), F.round(total("w"), 6).alias("total"), F.round(F.get("w", F.lit(39)), 6).alias("last"))


@query("clip_signal", f"SELECT id, round(list_sum(list_transform(w, lambda x: greatest(-1, least(1, x)))), 6) AS total, round(list_max(list_transform(w, lambda x: greatest(-1, least(1, x)))), 6) AS top FROM ({WAVE})")
def clip_signal(spark, sf):
    from tagloom.functions.vectors import clip, total

    d = waves(spark, sf).select("id", clip("w").alias("w"))
    return d.select("id", F.round(total("w"), 6).alias("total"), F.round(F.array_max("w"), 6).alias("top"))


@query("peak_normalize", f"SELECT id, round(list_sum(w) / list_max(list_transform(w, lambda x: abs(x))), 6) AS total, 1.0::DOUBLE AS peak FROM ({WAVE})")
def peak_normalize(spark, sf):
    from tagloom.functions.vectors import peak_normalize as peak, total

    d = waves(spark, sf).select("id", peak("w").alias("w"))
    return d.select("id", F.round(total("w"), 6).alias("total"), F.array_max(F.transform("w", F.abs)).alias("peak"))


def _mteval_sql(c: str) -> str:
    t = f"replace(replace(replace({c}, '<skipped>', ''), '-' || {LF}, ''), {LF}, ' ')"
    for entity, plain in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{entity}', '{plain}')"
    t = f"(' ' || {t} || ' ')"
    for pattern, repl in X.MTEVAL_RULES:
        t = f"regexp_replace({t}, '{pattern}', '{repl.replace('$', chr(92))}', 'g')"
    return sql_words(t)


def _ngram_ctes(tokens_sql, orders) -> str:
    grams = " UNION ALL ".join(
        f"SELECT id, side, {n} AS n, array_to_string(list_slice(t, i, i + {n - 1}), ' ') AS g FROM (SELECT id, side, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM tok)" for n in orders
    )
    return f"""tok AS (SELECT id, 'p' AS side, {tokens_sql('prediction')} AS t FROM pairs UNION ALL SELECT id, 'r', {tokens_sql('reference')} FROM pairs),
    grams AS ({grams}), cnt AS (SELECT id, n, g, count(*) FILTER (side = 'p') AS c, count(*) FILTER (side = 'r') AS r FROM grams GROUP BY 1, 2, 3),
    lens AS (SELECT id, max(len(t)) FILTER (side = 'p') AS lp, max(len(t)) FILTER (side = 'r') AS lr FROM tok GROUP BY 1)"""


BLEU_CTES = _ngram_ctes(_mteval_sql, range(1, 5)) + """, prec AS (SELECT n::BIGINT AS n, sum(least(c, r))::BIGINT AS matches, sum(c)::BIGINT AS possible, (SELECT sum(lp)::BIGINT FROM lens) AS pred_len, (SELECT sum(lr)::BIGINT FROM lens) AS ref_len FROM cnt GROUP BY 1)"""


@query("bleu_precisions", with_views("pairs", "SELECT n, matches, possible, pred_len, ref_len FROM prec", BLEU_CTES))
def bleu_precisions(spark, sf):
    return M.bleu_precisions(text_pairs(spark, sf))


@query("corpus_bleu", with_views("pairs", """SELECT round(CASE WHEN min(matches) > 0 THEN exp(avg(ln(matches / possible::DOUBLE))) ELSE 0 END * any_value(bp), 6) AS bleu, round(any_value(bp), 6) AS brevity_penalty,
    round(any_value(ratio), 6) AS length_ratio, any_value(pred_len) AS translation_length, any_value(ref_len) AS reference_length
    FROM (SELECT *, pred_len / ref_len::DOUBLE AS ratio, CASE WHEN pred_len > ref_len THEN 1.0::DOUBLE ELSE exp(1 - ref_len / pred_len::DOUBLE) END AS bp FROM prec)""", BLEU_CTES))
def corpus_bleu(spark, sf):
    return rounded(M.corpus_bleu(text_pairs(spark, sf)), "bleu", "brevity_penalty", "length_ratio")


ROUGE_TOKENS = lambda c: f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"


@query("rouge_n", with_views("pairs", """SELECT 'rouge' || n AS metric, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f1 FROM (
    SELECT l.id, o.n, coalesce(m.m, 0) / greatest(l.lp - o.n + 1, 1)::DOUBLE AS p, coalesce(m.m, 0) / greatest(l.lr - o.n + 1, 1)::DOUBLE AS r
    FROM lens l CROSS JOIN (SELECT unnest([1, 2]) AS n) o LEFT JOIN (SELECT id, n, sum(least(c, r)) AS m FROM cnt GROUP BY 1, 2) m ON m.id = l.id AND m.n = o.n) GROUP BY n""", _ngram_ctes(ROUGE_TOKENS, (1, 2))))
def rouge_n(spark, sf):
    return rounded(M.rouge_n(text_pairs(spark, sf)), "f1")


# Whole texts: rows of the table one token of the reference after the other, the running maximum by a window. Sentences:
# the whole table as a list of rows, then the way back from its end; places are counted from 1.
LCS_ROW = "[0] || list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[-1][k + 1], acc[-1][k] + (b[k] = e[1][1])::INT))))"
LCS_SQL = f"""sent AS (SELECT id, [t FOR t IN list_transform(string_split(prediction, {LF}), lambda x: {ROUGE_TOKENS('x')}) IF len(t) > 0] AS ps,
      [t FOR t IN list_transform(string_split(reference, {LF}), lambda x: {ROUGE_TOKENS('x')}) IF len(t) > 0] AS rs FROM pairs),
    flat AS (SELECT id, flatten(ps) AS p, flatten(rs) AS r FROM sent),
    code AS (SELECT id, list_transform(p, lambda x: list_position(p, x)) AS p, list_transform(r, lambda x: coalesce(list_position(p, x), 0)) AS r FROM flat),
    steps AS (SELECT id, 0 AS i, unnest(range(len(p) + 1)) AS j, 0 AS v FROM code
      UNION ALL SELECT s.id, s.i + 1, s.j, max(greatest(s.v, coalesce(s.pv, 0) + (s.j > 0 AND c.p[s.j] = c.r[s.i + 1])::INT)) OVER (PARTITION BY s.id ORDER BY s.j)
      FROM (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY j) AS pv FROM steps) s JOIN code c ON c.id = s.id WHERE s.i < len(c.r)),
    whole AS (SELECT s.id, s.v AS lcs FROM steps s JOIN code c ON c.id = s.id WHERE s.i = len(c.r) AND s.j = len(c.p)),
    cut AS (SELECT id, si, list_transform(a, lambda x: list_position(w, x)) AS a, list_transform(b, lambda x: list_position(w, x)) AS b FROM (
      SELECT s.id, x.si, f.r || f.p AS w, s.rs[x.si] AS a, s.ps[y.sj] AS b FROM sent s JOIN flat f ON f.id = s.id, LATERAL (SELECT unnest(range(1, len(s.rs) + 1)) AS si) x, LATERAL (SELECT unnest(range(1, len(s.ps) + 1)) AS sj) y)),
    tables AS (SELECT id, si, a, b, list_reduce(list_transform(a, lambda x: [[x]]), lambda acc, e: list_append(acc, {LCS_ROW}), [list_transform(range(len(b) + 1), lambda z: 0::BIGINT)]) AS t FROM cut),
    back AS (SELECT id, si, a, list_reduce(list_transform(range(len(a) + len(b)), lambda z: [z]), lambda w, e: CASE WHEN w[1] = 0 OR w[2] = 0 THEN w
      WHEN a[w[1]] = b[w[2]] THEN [w[1] - 1, w[2] - 1] || w[3:] || [w[1]] WHEN t[w[1] + 1][w[2]] > t[w[1]][w[2] + 1] THEN [w[1], w[2] - 1] || w[3:] ELSE [w[1] - 1, w[2]] || w[3:] END, [len(a), len(b)])[3:] AS pos FROM tables),
    marked AS (SELECT id, tok, count(*) AS c FROM (SELECT DISTINCT b.id, b.si, u.pos, f.w[b.a[u.pos]] AS tok FROM back b JOIN (SELECT id, r || p AS w FROM flat) f ON f.id = b.id, LATERAL (SELECT unnest(b.pos) AS pos) u) GROUP BY 1, 2),
    held AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(p) AS tok FROM flat) GROUP BY 1, 2),
    hits AS (SELECT m.id, sum(least(m.c, h.c)) AS h FROM marked m JOIN held h ON h.id = m.id AND h.tok = m.tok GROUP BY 1)"""


@query("rouge_l", with_views("pairs", """SELECT round(avg(coalesce(2 * w.lcs / nullif(len(f.p) + len(f.r), 0)::DOUBLE, 0)), 6) AS rouge_l, round(avg(coalesce(2 * h.h / nullif(len(f.p) + len(f.r), 0)::DOUBLE, 0)), 6) AS rouge_lsum
    FROM flat f LEFT JOIN whole w ON w.id = f.id LEFT JOIN hits h ON h.id = f.id""", LCS_SQL, recursive=True))
def rouge_l(spark, sf):
    return rounded(M.rouge_l(text_pairs(spark, sf)), "rouge_l", "rouge_lsum")


@query("meteor_exact", with_views("pairs", """SELECT id, round(CASE WHEN m = 0 THEN 0 ELSE (1 - 0.5::DOUBLE * (chunks / m::DOUBLE) ** 3) * (p * r / (0.9::DOUBLE * p + 0.1::DOUBLE * r)) END, 9) AS meteor FROM (
    SELECT l.id, coalesce(m, 0) AS m, chunks, coalesce(m, 0) / l.lp::DOUBLE AS p, coalesce(m, 0) / l.lr::DOUBLE AS r FROM lens l LEFT JOIN (
      SELECT id, count(*) AS m, 1 + count(*) FILTER (ph IS NOT NULL AND (h <> ph + 1 OR r <> pr + 1)) AS chunks FROM (
        SELECT id, h, r, lag(h) OVER (PARTITION BY id ORDER BY h) AS ph, lag(r) OVER (PARTITION BY id ORDER BY h) AS pr FROM (
          SELECT a.id, a.i AS h, b.i AS r FROM occ a JOIN occ b ON a.id = b.id AND a.w = b.w AND a.k = b.k AND a.side = 'p' AND b.side = 'r')) GROUP BY id) x ON x.id = l.id)""",
    f"""tok AS (SELECT id, 'p' AS side, {sql_words('lower(prediction)')} AS t FROM pairs UNION ALL SELECT id, 'r', {sql_words('lower(reference)')} FROM pairs),
    lens AS (SELECT id, max(len(t)) FILTER (side = 'p') AS lp, max(len(t)) FILTER (side = 'r') AS lr FROM tok GROUP BY 1),
    occ AS (SELECT id, side, w, i, row_number() OVER (PARTITION BY id, side, w ORDER BY i DESC) AS k FROM (SELECT id, side, unnest(t) AS w, unnest(range(len(t))) AS i FROM tok))"""))
def meteor_exact(spark, sf):
    return M.meteor_rows(text_pairs(spark, sf)).withColumn("meteor", F.round("meteor", 9))


@query("text_metric_report", f"""SELECT name, round(value, 5) AS value FROM (
    SELECT unnest(['bleu_bleu', 'bleu_brevity_penalty', 'bleu_length_ratio', 'bleu_translation_length', 'bleu_reference_length']) AS name,
      unnest([bleu, brevity_penalty, length_ratio, translation_length, reference_length]::DOUBLE[]) AS value FROM ({ORACLES['corpus_bleu']})
    UNION ALL SELECT 'bleu_precisions', avg(matches / possible::DOUBLE) FROM ({ORACLES['bleu_precisions']})
    UNION ALL SELECT 'rouge_' || metric, f1 FROM ({ORACLES['rouge_n']}) UNION ALL SELECT 'meteor_meteor', avg(meteor) FROM ({ORACLES['meteor_exact']}))""")
def text_metric_report(spark, sf):
    from tagloom.operators.reports import text_metric_report as report

    metrics = [{"name": "bleu"}, {"name": "rouge", "kwargs": {"orders": (1, 2), "lcs": False}}, {"name": "meteor", "kwargs": {}}]
    return report(text_pairs(spark, sf), metrics).withColumn("value", F.round("value", 5))


def token_vectors(spark, sf):
    """Distinct words of both sides of each pair, each with the vector its hash selects."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), X.words(F.lower(c)).alias("t")) for s, c in (("p", "prediction"), ("r", "reference"))])
    d = text_pairs(spark, sf).select("id", F.inline(sides)).select("id", "side", F.explode("t").alias("w"))
    d = d.groupBy("id", "side", "w").agg(F.count("*").alias("n"))
    vocab = embeddings(spark, sf).select(F.col("id").alias("slot"), "vec")
    slot = F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("bigint") % vocab.agg(F.count("*")).scalar()
    return d.withColumn("slot", slot).join(vocab, "slot").select("id", "side", "n", "vec")


@query("bertscore", with_views("pairs vecs", """SELECT p.id, round(p.s, 6) AS precision, round(r.s, 6) AS recall, round(2 * p.s * r.s / (p.s + r.s), 6) AS f1
    FROM (SELECT id, sum(best * n) / sum(n) AS s FROM (SELECT id, pw, any_value(pn) AS n, max(c) AS best FROM sim GROUP BY 1, 2) GROUP BY 1) p
    JOIN (SELECT id, sum(best * n) / sum(n) AS s FROM (SELECT id, rw, any_value(rn) AS n, max(c) AS best FROM sim GROUP BY 1, 2) GROUP BY 1) r ON r.id = p.id""",
    f"""tok AS (SELECT id, side, w, count(*) AS n FROM (SELECT id, 'p' AS side, unnest({sql_words('lower(prediction)')}) AS w FROM pairs UNION ALL SELECT id, 'r', unnest({sql_words('lower(reference)')}) FROM pairs) GROUP BY 1, 2, 3),
    tv AS (SELECT t.id, t.side, t.w, t.n, v.vec FROM tok t JOIN vecs v ON v.id = ('0x' || substr(md5(t.w), 1, 6))::BIGINT % (SELECT count(*) FROM vecs)),
    sim AS (SELECT p.id, p.w AS pw, p.n AS pn, r.w AS rw, r.n AS rn, list_dot_product(p.vec, r.vec) / sqrt(list_dot_product(p.vec, p.vec) * list_dot_product(r.vec, r.vec)) AS c
      FROM tv p JOIN tv r ON p.id = r.id AND p.side = 'p' AND r.side = 'r')"""))
def bertscore(spark, sf):
    return rounded(M.bertscore_rows(token_vectors(spark, sf)), "precision", "recall", "f1")


@query("mauve_curve", with_views("vecs", """SELECT i, round(x, 6) AS x, round(y, 6) AS y FROM (
    SELECT i::BIGINT AS i, exp(-5 * sum(CASE WHEN q > 0 THEN q * ln(q / (w * p + (1 - w) * q)) ELSE 0 END)) AS x, exp(-5 * sum(CASE WHEN p > 0 THEN p * ln(p / (w * p + (1 - w) * q)) ELSE 0 END)) AS y
    FROM (SELECT count(*) FILTER (id % 2 = 0) / sum(count(*) FILTER (id % 2 = 0)) OVER ()::DOUBLE AS p, count(*) FILTER (id % 2 = 1) / sum(count(*) FILTER (id % 2 = 1)) OVER ()::DOUBLE AS q FROM vecs GROUP BY label),
      (SELECT i, 1e-6::DOUBLE + (i - 1) * ((1 - 2e-6::DOUBLE) / 24) AS w FROM (SELECT unnest(range(1, 26)) AS i)) GROUP BY i
    UNION ALL SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT 26, 0.0::DOUBLE, 1.0::DOUBLE)"""))
def mauve_curve(spark, sf):
    d = embeddings(spark, sf).select("label", F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("side"))
    return rounded(M.mauve_curve(d, "label", "side"), "x", "y")


MAUVE_CURVE = ORACLES["mauve_curve"]


@query("mauve_area", f"""SELECT round(0.5::DOUBLE * (sum(ax) + sum(ay)), 5) AS mauve FROM (
    SELECT (x - lag(x) OVER (ORDER BY x, y DESC)) * (y + lag(y) OVER (ORDER BY x, y DESC)) / 2 AS ax, (y - lag(y) OVER (ORDER BY y, x DESC)) * (x + lag(x) OVER (ORDER BY y, x DESC)) / 2 AS ay FROM ({MAUVE_CURVE}))""")
def mauve_area(spark, sf):
    """MAUVE on given clusters."""
    d = embeddings(spark, sf).select("label", F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("side"))
    return M.mauve_from_curve(M.mauve_curve(d, "label", "side")).select(F.round("mauve", 5).alias("mauve"))


@query("mauve")
def mauve(spark, sf):
    d = embeddings(spark, sf).select("vec", F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("side"))
    return rounded(M.mauve(d, "vec", "side", clusters=16), "mauve")


LOGP = "ln((('0x' || substr(md5(id || ':' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE) + 1e-3::DOUBLE)"
PPL = f"SELECT id, exp(-avg({LOGP})) AS perplexity FROM (SELECT id, unnest(range(len(ids))) AS pos FROM doc_tokens) WHERE pos > 0 GROUP BY id"


def token_logp(spark, sf):
    d = doc_tokens(spark, sf).select("id", F.posexplode("ids").alias("pos", "token"))
    return d.select("id", "pos", F.ln(hash_uniform(F.col("id"), F.col("pos")) + 1e-3).alias("logp"))


@query("perplexity", with_views("doc_tokens", f"SELECT id, round(perplexity, 6) AS perplexity FROM ({PPL})"))
def perplexity(spark, sf):
    return rounded(M.perplexity(token_logp(spark, sf), "id", "pos", "logp"), "perplexity")


@query("perplexity_stats", with_views("model_scores", """SELECT round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(min(p), 6) AS min, round(max(p), 6) AS max, round(median(p), 6) AS median
    FROM (SELECT exp(score) AS p FROM model_scores WHERE score <= 0.5)"""))
def perplexity_stats(spark, sf):
    from tagloom.plans.views import model_scores

    failed = F.when(F.col("score") > 0.5, F.lit(float("inf"))).otherwise(F.exp("score"))
    out = M.perplexity_stats(model_scores(spark, sf).select(failed.alias("p")), "p")
    return rounded(out, *out.columns)


def judged(spark, sf):
    """Captions with the judge's score and reasoning and their perplexity, joined by id."""
    d = captions(spark, sf).select("id", "split", "caption")
    verdicts = judge_replies(spark, sf).select("id", X.parse_judge_score("reply").alias("score"), X.parse_judge_reasoning("reply").alias("reasoning"))
    surprise = M.perplexity(token_logp(spark, sf), "id", "pos", "logp").select("id", "perplexity")
    return J.zip_by_id(d, verdicts, surprise)


JUDGED = with_views("doc_tokens", f"""SELECT d.doc_id AS id, d.lang AS split, md5(d.text) AS caption, j.score, j.reasoning, p.perplexity
    FROM documents d LEFT JOIN ({JUDGE_SQL}) j ON j.id = d.doc_id LEFT JOIN ({PPL}) p ON p.id = d.doc_id""")


@query("judged_predictions", f"SELECT id, split, caption, score, reasoning, round(perplexity, 6) AS perplexity FROM ({JUDGED})")
def judged_predictions(spark, sf):
    path = scratch_path(spark, "judged")
    rows = judged(spark, sf)
    rows.write.json(path)
    back = spark.read.schema(rows.schema).json(path)
    return back.withColumns({"caption": F.md5("caption"), "perplexity": F.round("perplexity", 6)})


@query("quality_metrics", f"""SELECT split, split || '/' || name AS name, round(value, 5) AS value FROM (
    SELECT split, unnest(['score_mean', 'score_std', 'score_min', 'score_max', 'perplexity_mean', 'perplexity_std', 'perplexity_min', 'perplexity_max']) AS name,
      unnest([avg(score), stddev_pop(score), min(score), max(score), avg(perplexity), stddev_pop(perplexity), min(perplexity), max(perplexity)]) AS value FROM ({JUDGED}) GROUP BY split) WHERE value IS NOT NULL""")
def quality_metrics(spark, sf):
    """A metrics file for each split, written and read back."""
    from tagloom.operators.reports import quality_metrics as summary

    path = scratch_path(spark, "quality")
    found = summary(judged(spark, sf), "split", ["score", "perplexity"])
    files = JS.metrics_json(found, "split", "name", "value")
    files.write.partitionBy("split").text(path)
    back = R.flatten_metrics(spark.read.option("wholetext", True).text(path), ["split"], "value")
    return back.withColumn("value", F.round("value", 5))
