"""The ready-made queries of this package, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
import public_tokenizers

from tagloom.llm.base import held_back, table
from tagloom.llm.decontaminate import decontaminate
from tagloom.llm.html_layout import extract_text
from tagloom.llm.language_id import identify_language
from tagloom.llm.lexical import ranked_search
from tagloom.llm.manifest import manifest
from tagloom.llm.mixing import mixed_sources
from tagloom.llm.near_dedup import near_duplicates
from tagloom.llm.ngram_trie import score_texts
from tagloom.llm.packing import packed
from tagloom.llm.secrets import MOST_TEXTS, scan_secrets
from tagloom.llm.substring_dedup import substring_dedup
from tagloom.llm.topk import exact_topk
from tagloom.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query("""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
s AS (SELECT doc_id, i, list_aggregate(words[i:i + 12], 'string_agg', ' ') AS seq
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
f AS (SELECT seq, min(doc_id) AS first FROM s GROUP BY seq),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM s JOIN f USING (seq), range(13) r(d) WHERE first < doc_id),
pos AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _joined(parts) -> F.Column:
    """kind:start:end of spans, by start and then kind, joined by commas."""
    return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS sha, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(sha, (j // 4 * 5 + 1)::INT, 5))::BIGINT >> (5 * (3 - j % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    out = round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(number("name").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"), most_texts=MOST_TEXTS)
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


@query()
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


@query()
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_back("doc_id", 7, 2)).withColumn("train", ~F.col("held_out"))
    return score_texts(docs, "train", order=3).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_back("doc_id", 4, 2))
    labelled = docs.filter("not held_out and lang is not null and text is not null").select("text", "lang")
    return identify_language(docs.select("doc_id", "text", "held_out"), labelled).select("doc_id", "held_out", "lang_pred", "score")


@query("""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS seq
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS seq
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, seq)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
""")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
      FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
l AS (SELECT *, (SELECT sum(source_size)::DOUBLE FROM s) AS all_size, (SELECT sum(weight) FROM s) AS all_weight,
             coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
      FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (all_size - cap_before) * weight > cap * (all_weight - weight_before) AS stops FROM l),
f AS (SELECT max(all_size) - coalesce(sum(cap) FILTER (stops), 0) AS free_size, max(all_weight) - coalesce(sum(weight) FILTER (stops), 0) AS free_weight FROM c),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE free_size * weight / free_weight END AS target FROM c, f),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
             ('0x' || substr(md5(concat_ws(':', 'mix', '10', coalesce(doc_id::VARCHAR, ''))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""")
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query()
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


@query("""
WITH RECURSIVE d AS (
    SELECT doc_id, lang, n_chars, h.*, doc_id IS NOT NULL AND n_chars IS NOT NULL AND crc % 7 = 0 AS tampered FROM (
        SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
               || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
               xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(8 * strlen(doc_id::VARCHAR)),
                   lambda i: (CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8)::INT + 1, 1)) ELSE 0 END)::UBIGINT)),
                   lambda c, x: xor(xor(c, x) >> 1, 3988292384::UBIGINT * (xor(c, x) & 1)))) AS crc
        FROM documents),
    LATERAL (SELECT sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                    sha256(head || octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1) || tail) AS other) h),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
             dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d),
t AS (SELECT g, 0 AS lvl, pos, leaf AS h, n FROM p
      UNION ALL SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lvl, pos // 2, n),
s AS (SELECT g, h AS subroot, lvl AS depth FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, g AS pos, subroot AS h, (SELECT count(*) FROM s) AS n FROM s
      UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
step AS (SELECT p.g, p.pos, t.lvl, (p.pos >> t.lvl) & 1 AS odd, t.h FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.pos = xor(p.pos >> t.lvl, 1)
         UNION ALL SELECT p.g, p.pos, s.depth + u.lvl, (p.g >> u.lvl) & 1, u.h FROM p JOIN s ON s.g = p.g JOIN u ON u.n > 1 AND u.pos = xor(p.g >> u.lvl, 1)),
proof AS (SELECT g, pos, string_agg(h, '' ORDER BY lvl) AS siblings FROM step GROUP BY g, pos),
f AS (SELECT p.g, p.pos, 0 AS lvl, CASE WHEN tampered THEN other ELSE leaf END AS h, s.depth + (SELECT max(lvl) FROM u) AS height FROM p JOIN s ON s.g = p.g
      UNION ALL SELECT f.g, f.pos, f.lvl + 1, sha256(CASE WHEN step.h IS NULL THEN f.h WHEN odd = 1 THEN step.h || f.h ELSE f.h || step.h END), height
      FROM f LEFT JOIN step ON step.g = f.g AND step.pos = f.pos AND step.lvl = f.lvl WHERE f.lvl < height),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM p JOIN s ON s.g = p.g JOIN f ON f.g = p.g AND f.pos = p.pos AND f.lvl = f.height LEFT JOIN proof ON proof.g = p.g AND proof.pos = p.pos, r
""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return manifest(docs, changed=tampered, changed_leaf={"n_chars": F.col("n_chars") + 1}).withColumnRenamed("id", "doc_id")


@query("""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark WHERE text IS NOT NULL),
a AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS all_terms FROM d WHERE len(w) > 0),
q AS (SELECT i, item_id, unnest(w) AS term FROM b),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, term),
wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, a GROUP BY term, n_docs),
c AS (SELECT r, term, doc_id, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * n_docs) // all_terms))) AS part FROM tf JOIN wt USING (term) JOIN d USING (r), a),
s AS (SELECT i, item_id, r, doc_id, sum(part)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY i, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.withColumnRenamed("item", "item_id")
