import re

from pyspark.sql import functions as F

from tagloom.llm import decontaminate as dc

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items, n):
    spots = [m.span() for m in WORDS.finditer(lower(text))]
    words = WORDS.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORDS.findall(lower(t))
        size = min(n, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1) if w else ():
            if tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found), hit, spots


def test_against_brute_force(spark, frame, monkeypatch):
    items = [(1, "What is the capital of France? It's Paris, of course, as everyone knows."), (2, "short one"), (10, "Short  ONE"), (3, None), (4, "?!"), (None, "null item here"), (5, "Éa éb ec")]
    docs = [
        "so: WHAT is the-capital of france it s paris of course as everyone knows, ok", "a short one, short one!", "shortone", "nothing", None, "", "null item here éa Éa éb ec",
        "what is the capital of france it s paris", "short " * 40_000 + "one", "x É what is the capital of france it s paris OF 🙂 course as",
    ]
    rows = [(i, t) for i, t in enumerate(docs)] + [(1, docs[1])]
    bank = spark.createDataFrame(items, "item_id long, text string")
    for chars in (1_000_000, 30):
        monkeypatch.setattr(dc, "AUTOMATON_CHARS", chars)
        out = dc.decontaminate(frame(*rows).withColumn("spans", F.lit(0)), bank, window=10).collect()
        assert len(out) == len(rows)
        for r in out:
            n_words, n_hit, found, hit, spots = brute(docs[r.doc_id], items, 10)
            assert (r.n_words, r.n_hit, r["items"]) == (n_words, n_hit, found), r.doc_id
            assert {i for i, (a, b) in enumerate(spots) if any(s.start <= a and b <= s.end for s in r.spans)} == hit
            for s in r.spans:
                assert s.start in {a for a, _ in spots} and s.end in {b for _, b in spots}


def test_empty(spark, frame):
    bank = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in dc.decontaminate(frame((1, "a b")), bank).collect()] == [(2, 0)]
    assert dc.decontaminate(frame(), bank).collect() == []
