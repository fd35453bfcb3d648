"""Secrets in texts, and by how many owners, documents and distinct texts each candidate value is shared.

A value in many unequal texts is an example that was copied around; one in few of them looks live, however many
owners hold copies of those texts. Candidates are counted over the whole corpus by a hash of their value, so values never leave a task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.base import id_key, stored

#: The patterns, the least lengths, and the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "token")
ASSIGN_LEAST = 12
KEYWORD = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.ASCII)
#: Other candidates: runs of these characters with letters and digits in them that look random.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_BITS = 3.5
#: A value of at most so many owners looks live unless it is in more than HOT_TEXTS unequal texts.
MOST_OWNERS = 1
#: So does a value of more owners in at most so many unequal texts; what the queries and the pipeline go by.
MOST_TEXTS = 10
HOT_TEXTS = 100
#: A value with this word in it says itself that it is an example; of more than MOST_OWNERS owners it is believed.
EXAMPLE = "example"

SPAN = "struct<start:int,rank:int,end:int,h:bigint,named:boolean>"


def bits(value: str) -> float:
    """Entropy of its characters."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value), the base matches of each kind and other random-looking runs outside them."""
    found = []
    # the plain search in lower case is much faster than the pattern and misses none of its matches
    if KEYWORD.search(text.lower()):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = list(found)
    for m in TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and bits(v) >= LEAST_BITS and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            found.append((m.start(), 3, m.end(), v))
    return sorted(found)


def _scan(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("h", pa.int64()), ("named", pa.bool_())])
        for b in batches:
            out = []
            for text in b.column("t").to_pylist():
                spans = candidates(text) if text else []
                out.append([{"start": s, "rank": k, "end": e, "h": xxhash.xxh3_64_intdigest(v) - (1 << 63), "named": EXAMPLE in v.lower()} for s, k, e, v in spans])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), b.column("text_key"), b.column("owner"), pa.array(out, pa.list_(kind))], ["row", "k", "text_key", "owner", "found"])

    return run


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", keep: tuple[str, ...] = ("doc_id",), most_owners: int = MOST_OWNERS,
    most_texts: int = 1, hot_texts: int = HOT_TEXTS,
) -> DataFrame:
    """One row for each document, with the columns ``keep`` and ``text_key`` (a hash of the text), ``spans``.

    ``spans`` holds start and end (code points, end exclusive), kind, and owners, documents and texts (how many
    distinct ones have the value anywhere; copies of one text are one) with ``live``. Not live are values of more
    than ``most_owners`` owners that are in more than ``most_texts`` texts or have EXAMPLE in them, and values in
    more than ``hot_texts`` texts, be it of one owner. Base kinds are always there.
    Runs of kind ``token`` are added only where live. A null text is empty; null owners are one owner, null ids
    one document; rows that share an id and text have equal spans. Repeated rows stay. Texts are read once and
    not shuffled; only spans are.
    """
    data = docs.select(
        F.struct(*keep).alias("row"), id_key(id_col).alias("k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"), F.col(text_col).alias("t"),
    )
    row_type = data.schema["row"].dataType.simpleString()
    seen = stored(data.mapInArrow(_scan(text_col), f"row {row_type}, k long, text_key long, owner string, found array<{SPAN}>"), "secrets")
    each = seen.filter(F.size("found") > 0).select("k", "text_key", "owner", F.explode("found").alias("span"))
    # one row for each value and owner or document of a task before anything is shuffled, so copies don't pile up
    having = lambda by, name: each.groupBy(F.col("span.h").alias("h"), by).agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias(name))
    shared = having("owner", "owners").join(having("k", "documents"), "h").join(having("text_key", "texts"), "h")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("span.rank") + 1)
    judged = (
        each.select("k", "text_key", "span").distinct().withColumn("h", F.col("span.h")).join(shared, "h")
        .withColumn("live", (F.col("texts") <= hot_texts) & ((F.col("owners") <= most_owners) | ((F.col("texts") <= most_texts) & ~F.col("span.named"))))
        .filter(F.col("live") | (F.col("span.rank") < 3))
        .select("k", "text_key", F.struct(
            F.col("span.start").alias("start"), F.col("span.rank").alias("rank"), F.col("span.end").alias("end"), kind.alias("kind"), "owners", "documents", "texts", "live",
        ).alias("span"))
        .groupBy("k", "text_key").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    )
    out = seen.drop("found").join(judged, ["k", "text_key"], "left")
    empty = F.array().cast(judged.schema["spans"].dataType)
    return out.select("row.*", "text_key", F.coalesce("spans", empty).alias("spans"))
