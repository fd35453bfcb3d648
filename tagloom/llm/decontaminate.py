"""Test questions and answers found in documents by one Aho-Corasick automaton over their word windows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.base import texts

WINDOW = 10
#: Most characters of item text in one automaton (some 50 bytes of memory each). More items make more passes
#: over the text, each with an automaton of its own.
AUTOMATON_CHARS = 1_000_000
#: Each byte as the normal form has it: digits, letters in lower case, bytes of other letters; all else parts words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BUILT: dict[str, tuple] = {}


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def windows(words: list[bytes], n: int) -> list[bytes]:
    """The runs of n words, as the automaton has them; fewer words are one run, none make none."""
    last = max(len(words) - n, 0) if words else -1
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(last + 1)]


def _automaton(token: str, items: list[tuple[str, bytes]], n: int) -> tuple:
    """Built once in a worker: the automaton, and for each pattern its number of words and its items."""
    if token not in _BUILT:
        _BUILT.clear()
        found: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(normal_words(text), n):
                found.setdefault(w, set()).add(item)
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(found):
            automaton.add_word(w.decode("latin-1"), i)
        automaton.make_automaton()
        _BUILT[token] = automaton if found else None, [w.count(b" ") - 1 for w in found], list(found.values())
    return _BUILT[token]


def matches(built: tuple, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges that are windows of an item, and those items."""
    automaton, lengths, owners = built
    if automaton is None or not words:
        return [], set()
    found = list(automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")))
    if not found:
        return [], set()
    ends = np.cumsum([len(w) + 1 for w in words])
    last = np.searchsorted(ends, [e for e, _ in found])
    return [(j - lengths[i] + 1, j + 1) for j, (_, i) in zip(last.tolist(), found, strict=True)], set().union(*(owners[i] for _, i in found))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the text of word ranges; the normal form has every byte where the text has it."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [(int(points[at[a][0]]) - 1, int(points[at[b - 1][1] - 1])) for a, b in ranges]


_RESULT = ("n_words", "n_hit", "items", "spans")


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Each row with ``n_words``, ``n_hit`` (words inside an item's window), ``items`` (their ids as text, sorted) and
    ``spans`` (the hit stretches, as code-point offsets in the text).

    A window is ``window`` consecutive words of an item in normal form; a shorter item is one window. Null and
    empty texts have no words, items without words never occur, items of equal text all count, and rows of equal
    item id count once; a null item id is the id ''. Repeated rows stay. Input columns of the result's names are
    replaced.
    """
    keep = [c for c in docs.columns if c not in _RESULT]
    out = docs.select(F.struct(*keep).alias("row"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<int>").alias("hits"))
    row_type = out.schema["row"].dataType.simpleString()
    bank = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("binary").alias("t")).filter("t is not null")
    chars = bank.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = int(chars // AUTOMATON_CHARS) + 1
    for p in range(passes):
        # a bounded part of the items: all of them as a rule, or those of one hash class
        part = bank.filter(F.pmod(F.xxhash64("item", "t"), F.lit(passes)) == p)
        shared = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.t)) for r in part.collect()])
        out = out.mapInArrow(_pass(shared, uuid.uuid4().hex, text_col, window, p + 1 == passes), f"row {row_type}, items array<string>, hits array<int>" + ", n_words long, n_hit long, spans array<struct<start:int,end:int>>" * (p + 1 == passes))
    return out.select("row.*", *_RESULT)


def _pass(shared, token: str, text_col: str, window: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _automaton(token, shared.value, window)
        for b in batches:
            row = b.column("row")
            n_words, n_hit, items, hits, spans = [], [], [], [], []
            for text, known, old in zip(texts(row.field(text_col)), b.column("items").to_pylist(), b.column("hits").to_pylist(), strict=True):
                words = normal_words(text)
                ranges, owners = matches(built, words)
                ranges = merged(ranges + list(zip((old or [])[::2], (old or [])[1::2], strict=True)))
                items.append(sorted(owners.union(known or ())))
                hits.append([x for r in ranges for x in r])
                n_words.append(len(words))
                n_hit.append(sum(e - a for a, e in ranges))
                spans.append([{"start": a, "end": e} for a, e in original_spans(text, ranges)] if last and ranges else [])
            columns = {"row": row, "items": pa.array(items, pa.list_(pa.string())), "hits": pa.array(hits, pa.list_(pa.int32()))}
            if last:
                columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run
