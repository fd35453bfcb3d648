"""Packing tokenised documents into sequences of a fixed length, by a fit of length patterns to the histogram.

Documents are tokenised once and cut into pieces that fit a sequence. What decides the packing is only how many
pieces there are of each length, a histogram of at most ``max_len`` numbers whatever the size of the corpus.
Patterns of a few length classes that fill a sequence are enumerated, non-negative least squares gives how often
each is repeated, the counts are rounded down and dealt out to real lengths, and the pieces left over go by best
fit into the free space of the patterns and into new sequences. The plan is a short list of runs; every piece finds
its place from its rank among the pieces of its length, so no piece is shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tagloom.llm.base import bounded, lists, stored

#: Length classes of a full sequence, and most pieces of a pattern; the rest is filled up by best fit.
CLASSES = 128
MOST_PIECES = 3
CACHED_PARTS = 400_000
#: Characters of the texts that a task tokenises at a time.
BATCH_CHARS = 1_000_000
#: Words held as strings at a time.
HELD_PARTS = 500_000
END = " "  # no other word is empty after its blank
#: Offsets of (task, length) up to this number are broadcast, more are joined by shuffle.
BROADCAST_OFFSETS = 500_000
#: Fixed values of the vocabulary file: its pre-tokens, for text of ASCII and Latin-1 letters in lower case. Such
#: text is its own NFC form and each letter has one lower-case letter.
SIMPLE = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\t\n\r\x20a-z0-9ß-öø-ÿ]+")


def slices(text: str) -> Iterator[str]:
    """A text cut at blanks or line ends into pieces of about BATCH_CHARS characters; a longer word is not cut."""
    first = 0
    while len(text) - first > BATCH_CHARS:
        end = first + BATCH_CHARS
        cut = max(text.rfind(" ", first + 1, end), text.rfind("\n", first + 1, end))
        if cut < 0:
            after = [at for at in (text.find(" ", end), text.find("\n", end)) if at >= 0]
            cut = min(after, default=len(text))
        yield text[first:cut]
        first = cut
    if first < len(text):
        yield text[first:]


class PartIds(dict):
    """Words to their places in one growing list of token ids, by the parts of a tokenizer file that drops white space.

    Nothing in such a file looks across white space, so a text has the ids of its words in a row. A word of SIMPLE
    characters that is new is cut by PARTS; of other text only the words with other characters go through the file's own
    normaliser and cutter, which are slow; such a word is a key after a blank. Words end at spaces and line ends; any
    other white space is left to the file.
    """

    def __init__(self, path: str, end_id: int):
        super().__init__()
        whole = Tokenizer.from_file(path)
        self.model, self.normalise, self.cut = whole.model, whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.mapped = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.end_id, self.ids, self.ends = end_id, array("i"), array("q", [0])

    def __missing__(self, part: str) -> int:
        if part == END:
            self.ids.append(self.end_id)
        elif part[0] == " ":
            for piece, _ in self.cut(self.normalise(part[1:])):
                self.ids.extend([t.id for t in self.model.tokenize(piece)])
        elif len(found := PARTS.findall(part)) > 1:
            for code in [self[p] for p in found]:
                self.ids.extend(self.ids[self.ends[code] : self.ends[code + 1]])
        else:
            self.ids.extend([t.id for t in self.model.tokenize(part if part.isascii() else self.mapped(part)[0][0])])
        self.ends.append(len(self.ids))
        code = len(self.ends) - 2
        if len(part) <= 64:
            self[part] = code
        return code

    @staticmethod
    def words(text: str) -> list[str]:
        if SIMPLE.fullmatch(text):
            return text.lower().split()
        out: list[str] = []
        for word in text.replace("\n", " ").split(" "):
            if SIMPLE.fullmatch(word):
                out += word.lower().split()  # a tab may be in it
            else:
                out.append(" " + word)
        return out

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, with an end after each; their number for each text)."""
        if len(self) >= CACHED_PARTS:
            self.clear()
            self.ids, self.ends = array("i"), array("q", [0])
        parts, counts, codes = [], [], [np.zeros(0, np.int64)]
        for text in texts:
            n = 1
            for some in slices(text or ""):
                found = self.words(some)
                parts += found
                n += len(found)
                if len(parts) > HELD_PARTS:
                    codes.append(np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)))
                    parts = []
            parts.append(END)
            counts.append(n)
        codes = np.concatenate([*codes, np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))])
        ends = np.array(self.ends)
        sizes = ends[codes + 1] - ends[codes]
        last = np.cumsum(sizes)
        ids = np.array(self.ids, np.int32)[np.repeat(ends[codes] - last + sizes, sizes) + np.arange(last[-1] if len(last) else 0)]
        return ids.astype("<i4", copy=False), np.diff(last[np.cumsum(counts) - 1], prepend=0) if counts else np.zeros(0, np.int64)


@cache
def part_ids(path: str, end_id: int) -> PartIds:
    """One for each Python worker, kept from task to task."""
    return PartIds(path, end_id)


def _some(texts: list[str | None]) -> Iterator[slice]:
    """Consecutive texts of about BATCH_CHARS characters, or one longer text."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > BATCH_CHARS:
            yield slice(first, i)
            first, size = i, 0
        size += len(text or "") + 1
    if first < len(texts):
        yield slice(first, len(texts))


def _pieces(path: str, max_len: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = part_ids(path, end_id), TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            for some in _some(texts):
                ids, total = words.of(texts[some])
                n = -(-total // max_len)
                doc = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(total[doc] - piece * max_len, max_len)
                order = np.argsort(length, kind="stable")  # how many of its length come before a piece
                met = np.bincount(length, minlength=max_len + 1)
                at = np.empty(len(doc), np.int64)
                at[order] = np.arange(len(doc)) - np.repeat(np.cumsum(met) - met, met)
                at += seen[length]
                seen += met
                stop = np.cumsum(length)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((stop - length).tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id")[some.start : some.stop].take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (piece, piece * max_len, length, crc)),
                     lists(ids, length), pa.array(np.full(len(doc), task, np.int32)), pa.array(at)],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids", "part", "at"],
                )

    return run


def tokenised(docs: DataFrame, tokenizer_path: str, max_len: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, part, at), stored: the pieces of each document in token ids.

    ``at`` counts the pieces of the same length before it in the task ``part``, which makes a rank without a sort.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece long, start long, length long, ids_crc32 long, ids array<int>, part int, at long"
    return stored(rows.mapInArrow(_pieces(tokenizer_path, max_len, end_id), schema), "pieces")


def patterns(total: int, most: int) -> np.ndarray:
    """All multisets of up to ``most`` classes 1..total that add up to ``total``: one row each, descending, zeros last."""
    found = []

    def extend(head: list[int], left: int, top: int) -> None:
        if left == 0:
            found.append(head + [0] * (most - len(head)))
        elif len(head) < most:
            for c in range(min(left, top), 0, -1):
                if c * (most - len(head)) < left:
                    break
                extend([*head, c], left - c, c)

    extend([], total, total)
    return np.array(found, np.int64).reshape(-1, most)


def non_negative_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets: grow the set of used columns, step back where one turns negative."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(6 * a.shape[0]):
        slope = np.where(used, -np.inf, a.T @ (b - a @ x))
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0.0
                x[at] = z
                break
            low = z <= 0
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            gone = at[low & (x[at] <= 1e-9 * max(1.0, x.max()))]
            gone = gone if len(gone) else at[low][:1]
            used[gone] = False
            x[~used] = 0.0
            if not used.any():
                break
    return x


class Plan:
    """Runs of pieces: those of ``length`` with ranks from ``low`` on go to sequences from ``first`` on, ``per`` to
    each, the first of them at ``offset``."""

    def __init__(self, counts: np.ndarray, max_len: int, classes: int = CLASSES, most: int = MOST_PIECES):
        self.max_len, self.left, self.next = max_len, counts.astype(np.int64).copy(), np.zeros(max_len + 1, np.int64)
        self.n_sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, low, first, per, offset
        self.free: list[tuple[int, int, int]] = []  # space left, first sequence, number of sequences; by space
        self.fit_patterns(classes, most)
        self.best_fit()
        table = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        self.length, self.low, self.first, self.per, self.offset = table.T

    def place(self, length: int, n: int, first: int, per: int, offset: int) -> None:
        """The next n pieces of a length go to the sequences from ``first`` on."""
        self.runs.append((length, int(self.next[length]), first, per, offset))
        self.next[length] += n
        self.left[length] -= n

    def open(self, space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            insort(self.free, (space, first, n))

    def fit_patterns(self, classes: int, most: int) -> None:
        width = -(-self.max_len // classes)
        total = self.max_len // width
        shapes = patterns(total, most)
        size = np.arange(self.max_len + 1)
        klass = -(-size // width)
        counts = np.bincount(klass, weights=self.left, minlength=total + 1)[1 : total + 1]
        if not counts.any():
            return
        used = np.zeros((total + 1, len(shapes)))
        np.add.at(used, (shapes, np.arange(len(shapes))[:, None]), 1.0)
        repeats = non_negative_fit(used[1:], counts)
        for p in np.argsort(-repeats, kind="stable"):
            shape = shapes[p][shapes[p] > 0]
            have = {c: int(self.left[klass == c].sum()) // int((shape == c).sum()) for c in set(shape.tolist())}
            self.deal(shape.tolist(), min(int(repeats[p] + 1e-6), *have.values()), width)

    def deal(self, shape: list[int], n: int, width: int) -> None:
        """n sequences of a pattern, in runs as long as all their lengths last: each place takes the longest length of
        its class, but the last one the longest length that fits, so that rounding to classes costs no space."""
        while n > 0:
            taken: dict[int, int] = {}
            lengths: list[int] = []
            for j, c in enumerate(shape):
                top = self.max_len - sum(lengths) if j == len(shape) - 1 else min(c * width, self.max_len)
                length = top
                while length and self.left[length] <= taken.get(length, 0):
                    length -= 1
                if not length:
                    return  # nothing is left that fits
                taken[length] = taken.get(length, 0) + 1
                lengths.append(length)
            run = min(n, *(int(self.left[k]) // t for k, t in taken.items()))
            offset = 0
            for length in lengths:
                self.place(length, run, self.n_sequences, 1, offset)
                offset += length
            self.open(self.max_len - offset, self.n_sequences, run)
            self.n_sequences += run
            n -= run

    def best_fit(self) -> None:
        """The pieces left over, longest first: each into the least space that holds it, else into new sequences."""
        for length in range(self.max_len, 0, -1):
            while n := int(self.left[length]):
                at = bisect_left(self.free, (length,))
                if at == len(self.free):
                    space, first = self.max_len, self.n_sequences
                    per = space // length
                    many = -(-n // per)
                    self.n_sequences += many
                else:
                    space, first, many = self.free.pop(at)
                    per = space // length
                full, rest = divmod(min(n, many * per), per)
                offset = self.max_len - space
                self.place(length, full * per + rest, first, per, offset)
                self.open(space - per * length, first, full)
                if rest:
                    self.open(space - rest * length, first + full, 1)
                self.open(space, first + full + (rest > 0), many - full - (rest > 0))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces from their length and their rank in it."""
        begin = np.searchsorted(self.length, np.arange(self.max_len + 2))
        out = np.zeros((2, len(length)), np.int64)
        for k in np.unique(length):
            rows, a, b = length == k, begin[k], begin[k + 1]
            run = a + np.searchsorted(self.low[a:b], rank[rows], "right") - 1
            past = rank[rows] - self.low[run]
            out[0, rows] = self.first[run] + past // self.per[run]
            out[1, rows] = self.offset[run] + past % self.per[run] * k
        return out[0], out[1]


def best_plan(counts: np.ndarray, max_len: int, classes: int = CLASSES, most: int = MOST_PIECES) -> Plan:
    """The plan with the fewest sequences of those with patterns of up to 2, 3, ... ``most`` pieces."""
    return min((Plan(counts, max_len, classes, k) for k in range(2, max(most, 2) + 1)), key=lambda p: p.n_sequences)


def packed(
    docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    classes: int = CLASSES, most: int = MOST_PIECES,
) -> DataFrame:
    """(id, piece, start, length, ids, ids_crc32, sequence_id, offset): one row for each piece of each document.

    A document is its token ids and ``end_id``; only a document longer than ``max_len`` is cut, into pieces of
    ``max_len`` and a last one that may be shorter. A null or empty text is ``end_id`` alone. The tokenizer file
    must drop white space; strings of special tokens in a text are ordinary text. Rows that repeat an id, and rows
    without one, are documents of their own. Other columns of the input are not read. An empty table gives no rows.
    Offsets in a sequence are gapless from 0.
    """
    spark = docs.sparkSession
    pieces = tokenised(docs, tokenizer_path, max_len, end_id, id_col, text_col)
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    found = counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most max_len rows
    histogram = np.zeros(max_len + 1, np.int64)
    histogram[found["length"].to_numpy()] = found["n"].to_numpy()
    plan = spark.sparkContext.broadcast(best_plan(histogram, max_len, classes, most))

    @F.pandas_udf("sequence_id long, offset long")
    def spot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # a row per task and length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = bounded(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), BROADCAST_OFFSETS, "offsets")
    out = pieces.join(offsets, ["part", "length"]).withColumn("spot", spot("length", F.col("before") + F.col("at")))
    return out.select("id", "piece", "start", "length", "ids", "ids_crc32", "spot.sequence_id", "spot.offset")
