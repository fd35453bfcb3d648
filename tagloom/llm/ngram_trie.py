"""A bigram or trigram language model in Elias-Fano tries, one of each shard of the contexts.

Documents are dealt into chunks of bounded size, contexts into shards. A chunk is cut into words once and stored as
numbers. It sends each shard its distinct bigrams, and the trigrams below them, once, packed, with their training counts;
their words are places in a list of numbers that goes with them. The shard adds the counts of all chunks, builds its trie in a
memory-mapped file and answers every chunk with one byte for each n-gram asked for. Word counts take the same
way first. So what travels is the distinct n-grams of a chunk, not the tokens, and nothing of the model is ever
on the driver or broadcast. A frequent context is cut into parts by its successors, so no shard grows hot;
a bigram that may be frequent is known to several shards, each with a part of its trigrams.

The trie: a vocabulary level, a context level, monotone pointers into the successor level, and there, relative
to their context, the ranks of the successors, each with a quantised probability. The places of the bigrams are
the contexts of one more such pair of levels, the trigrams. All levels but the probabilities are Elias-Fano
sequences; an n-gram is found by successor search within its context.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.base import WordHashes, mixed, nullable, stored, texts

#: Text bytes of a chunk; a task needs some ten times that memory.
CHUNK_BYTES = 10_000_000
#: Weight of the word probability in that of a bigram (a Dirichlet prior).
PRIOR = 20.0
#: Occurrences of a context for each part that it is cut into.
PART = 200_000
#: Occurrences of a bigram for each part of its trigrams, in PART; its words bound how often it occurs.
BIGRAM_PARTS = 5
#: Bits that tell successors of one context apart.
WORD_BITS = 40
#: Probabilities are kept as 1 + 254 steps of their logarithm down to this; 0 is none.
LOWEST = -9.0
#: No word has a blank in it.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" start"))
END_TOKEN = np.array([END])
#: Texts of a chunk that are held as strings at a time.
HELD_TEXTS = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        steps = np.clip(np.rint(np.log10(p) / LOWEST * 254), 0, 254)
    return np.where(p > 0, 1 + steps, 0).astype(np.uint8)


LEVELS = np.concatenate([[0.0], 10.0 ** (np.arange(255) / 254 * LOWEST)])


# -- packed integers ------------------------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, byte plane by byte plane."""
    planes = np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
    used = max((i + 1 for i in range(8) if planes[:, i].any()), default=1)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:, :used].T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel()


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


# -- Elias-Fano -----------------------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence of whole numbers: low bits packed one after the other, high parts as unary gaps."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        # where the values of each high part begin: the zeros of the unary code, less those before them
        zeros = np.flatnonzero(np.unpackbits(high, bitorder="little") == 0)
        self.begin = np.concatenate([[0], zeros - np.arange(len(zeros))])

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        low_bits = min(63, max(0, int(universe // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(int(universe >> low_bits) + n + 2, np.uint8)
        bits[high + np.arange(n)] = 1
        at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
        low = np.zeros(int(n * low_bits) // 64 + 2, np.uint64)
        part = values & np.uint64((1 << low_bits) - 1)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(low, word, part << shift)
        over = (shift + np.uint64(low_bits)) > np.uint64(64)
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return n, low_bits, low, np.packbits(bits, bitorder="little")

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        rest = np.where(shift == 0, np.uint64(0), self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)))
        return ((self.low[word] >> shift) | rest) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first element that is not smaller, whether it is equal), for each value.

        Given places from ``first`` on and before ``last``, only those are searched; others are never equal.
        """
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = high < len(self.begin) - 1
        high = np.minimum(high, len(self.begin) - 2)
        at, end = self.begin[high].copy(), self.begin[high + 1]
        at[~inside] = end[~inside] = self.n
        if first is not None:
            at, end = np.maximum(at, first), np.minimum(end, last)
        wanted = values & np.uint64((1 << self.low_bits) - 1)
        left, right = at, end
        while (open_ := left < right).any():  # halving, all queries at once
            middle = (left + right) // 2
            less = np.zeros(len(values), bool)
            less[open_] = self._low(middle[open_]) < wanted[open_]
            left, right = np.where(open_ & less, middle + 1, left), np.where(open_ & ~less, middle, right)
        found = left < end
        equal = np.zeros(len(values), bool)
        equal[found] = self._low(left[found]) == wanted[found]
        return left, equal

    def at(self, i: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.begin, i, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)


class Trie:
    """Levels of one shard, in a memory-mapped file that goes with the object."""

    def __init__(
        self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, probability: np.ndarray, below: np.ndarray, last: np.ndarray, last_probability: np.ndarray,
        vocabulary: np.ndarray | None = None,
    ):
        """``words`` are the successors, in order within each of the ``contexts``, of which it has ``sizes``; ``last``
        those of the bigrams so made, of which each has ``below``. Given a ``vocabulary``, both are places in it."""
        rank = np.concatenate([words, last])
        if vocabulary is None:
            vocabulary, rank = np.unique(rank, return_inverse=True)
        self.width = max(1, len(vocabulary))
        parts = [EliasFano.encode(vocabulary, 1 << WORD_BITS), EliasFano.encode(contexts, 1 << 64)]
        for n, r in ((sizes, rank[: len(words)]), (below, rank[len(words) :])):
            relative = np.repeat(np.arange(len(n), dtype=np.uint64), n) * np.uint64(self.width) + r.astype(np.uint64)
            pointers = np.concatenate([[0], np.cumsum(n)]).astype(np.uint64)
            parts += [EliasFano.encode(pointers, len(r) + 1), EliasFano.encode(relative, max(1, len(n)) * self.width)]
        self.file = tempfile.TemporaryFile()
        for _, _, low, high in parts:
            self.file.write(low.tobytes() + high.tobytes())
        self.file.write(quantise(probability).tobytes() + quantise(last_probability).tobytes() + b"\0")
        self.file.flush()
        self.bytes = self.file.tell()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        offset, levels = 0, []
        for n, low_bits, low, high in parts:
            levels.append(EliasFano(n, low_bits, np.frombuffer(self.map, np.uint64, len(low), offset), np.frombuffer(self.map, np.uint8, len(high), offset + low.nbytes)))
            offset += low.nbytes + high.nbytes
        code = np.frombuffer(self.map, np.uint8, len(words) + len(last), offset)
        self.vocabulary, self.contexts, *rest = levels
        self.bigrams, self.trigrams = (*rest[:2], code[: len(words)]), (*rest[2:], code[len(words) :])

    def _below(
        self, level: tuple, above: np.ndarray, known: np.ndarray, sizes: np.ndarray, rank: np.ndarray, met: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, whether it is there, code) of each word, given by its rank, searched between the pointers of what is above."""
        pointers, successors, code = level
        asked, n, above = np.repeat(known, sizes), sizes[known], above[known]
        begin, end = (np.repeat(pointers.at(above + i).astype(np.int64), n) for i in (0, 1))
        at, equal = successors.successor(np.repeat(above.astype(np.uint64), n) * np.uint64(self.width) + rank[asked].astype(np.uint64), begin, end)
        place, hit, out = np.zeros(len(rank), np.int64), np.zeros(len(rank), bool), np.zeros(len(rank), np.uint8)
        place[asked], hit[asked] = at, equal & met[asked]
        out[hit] = code[place[hit]]
        return place, hit, out

    def codes(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, below: np.ndarray, last: np.ndarray, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The quantised probability of each bigram and each trigram asked for, 0 if it is not there.

        Given ``names``, the words are places among them, and each name is looked up once.
        """
        context, known = self.contexts.successor(contexts)
        if names is None:
            names, (words, last) = np.concatenate([words, last]), np.split(np.arange(len(words) + len(last)), [len(words)])
        rank, met = self.vocabulary.successor(names)
        place, hit, out = self._below(self.bigrams, context, known, sizes, rank[words], met[words])
        return out, self._below(self.trigrams, place, hit, below, rank[last], met[last])[2]


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values in order, which of them each is), in less memory than ``np.unique``."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(order)]
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], which


# -- chunks ---------------------------------------------------------------------------------------------------


class Chunk:
    """The documents of a chunk as numbers: its distinct words and bigrams, each with its count in training."""

    def __init__(self, column: pa.Array, train: np.ndarray):
        hashes = WordHashes()
        parts, sizes = [], []
        for at in range(0, len(column), HELD_TEXTS):
            for text in texts(column.slice(at, HELD_TEXTS)):
                words = text.translate(LOWER).split() if text else []
                parts += [hashes.of(words), END_TOKEN]
                sizes.append(len(words) + 1)
        joined = np.concatenate(parts)
        del parts, hashes
        self._hold(*_ranked(joined), np.array(sizes), train)

    def _hold(self, words: np.ndarray, word: np.ndarray, sizes: np.ndarray, train: np.ndarray) -> None:
        self.words, self.word, self.sizes, self.learned = words, word, sizes, train
        self.starts = np.cumsum(sizes) - sizes
        self.train = np.repeat(train, sizes)
        self.word_counts = np.bincount(self.word[self.train], minlength=len(self.words))

    def saved(self) -> list[bytes]:
        """What ``load`` makes the same chunk of; frequent words have small numbers there."""
        order = np.argsort(-np.bincount(self.word, minlength=len(self.words)), kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        return [packed(self.words[order]), packed(number[self.word]), packed(self.sizes), packed(self.learned)]

    @classmethod
    def load(cls, data: list[bytes]) -> Chunk:
        hashes, number, sizes, train = map(unpacked, data)
        words, which = _ranked(hashes)
        chunk = cls.__new__(cls)
        chunk._hold(words, which[number], sizes.astype(np.int64), train.astype(bool))
        return chunk

    def bigrams(self) -> None:
        before = np.roll(self.word, 1)
        before[self.starts] = len(self.words)  # the start of a document, after all words
        n = len(self.words) + 1
        pairs, self.pair = _ranked(before.astype(np.int64) * n + self.word)
        self.context, self.next = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        self.pair_counts = np.bincount(self.pair[self.train], minlength=len(pairs))

    def deal(self, shards: int, counts: np.ndarray, numbers: np.ndarray, order: int) -> None:
        """Places of the bigrams in shards, by shard and context, and of the trigrams below them. Successors are places in
        ``names``, the ``numbers`` of the words in order.

        A bigram has one place for each part of its trigrams, at most one in a shard.
        """
        hashes, n = np.append(self.words, START), len(self.context)
        short = mixed(hashes) >> np.uint64(64 - WORD_BITS)
        context, successor = hashes[self.context], short[self.next]
        parts = (counts // PART + 1)[self.context].astype(np.uint64)
        splits = np.ones(n, np.int64)
        if order > 2:
            splits += np.where(hashes[self.next] == END, 0, np.minimum(counts[self.context], counts[self.next]) // (BIGRAM_PARTS * PART))
        offset = np.cumsum(splits) - splits
        pair = np.repeat(np.arange(n), splits)
        part = (np.arange(len(pair)) - offset[pair]).astype(np.uint64)
        shard = mixed((context + successor % parts * END)[pair] + part * mixed(successor + np.uint64(1))[pair]) % np.uint64(shards)
        places, at = _ranked(shard.astype(np.int64) * n + pair)
        del context, successor, parts, pair, part, shard
        self.place_pair, self.pair_place = (places % n).astype(np.int32), at[offset]
        self.cuts, below = np.searchsorted(places, np.arange(shards + 1) * n), len(places)
        del places
        # tokens with a bigram before them
        self.later = np.flatnonzero(np.bincount(self.starts, minlength=len(self.word)) == 0) if order > 2 else np.zeros(0, np.int64)
        self.later = self.later.astype(np.int32)
        self.before, word = self.pair[self.later - 1], self.word[self.later]
        by_number, n = np.argsort(numbers), len(self.words)
        rank = np.empty(n, np.int32)
        rank[by_number] = np.arange(n)
        self.names, self.successor = numbers[by_number], rank[self.next]
        place = at[offset[self.before] + (short[word] % splits[self.before].astype(np.uint64)).astype(np.int64)]
        del at, offset, splits
        place = place * np.int64(n) + rank[word]
        del word
        triples, self.triple = _ranked(place)
        del place
        self.below = np.bincount(triples // n, minlength=below)
        self.last = (triples % n).astype(np.int32)
        self.triple_counts = np.bincount(self.triple[self.train[self.later]], minlength=len(triples))
        self.triple_cuts = np.searchsorted(triples, self.cuts * n)

    def dealt(self) -> Iterator[tuple[int, slice, slice]]:
        """(shard, its places of bigrams, its trigrams) of each shard that has any."""
        for s, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            if a < b:
                yield s, slice(a, b), slice(self.triple_cuts[s], self.triple_cuts[s + 1])

    def named(self) -> Callable:
        """Turns two arrays of words into (the names of those that occur, in order, and the arrays as places among them)."""
        place, used = np.empty(len(self.names), np.int32), np.zeros(len(self.names), bool)

        def run(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            used[a] = used[b] = True
            found = np.flatnonzero(used)
            used[found] = False
            place[found] = np.arange(len(found))
            return self.names[found], place[a], place[b]

        return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(values)))


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, fields, strict=True)})


_BLOB = [("chunk", pa.int32()), ("shard", pa.int32()), ("data", pa.list_(pa.binary()))]
_BLOB_DDL = "chunk int, shard int, data array<binary>"


def _train(table: pa.Table) -> np.ndarray:
    return table["train"].combine_chunks().to_numpy(zero_copy_only=False)


def _read(table: pa.Table) -> pa.Table:
    """The chunk as numbers, and its rows, in one row."""
    rows, chunk = table["row"].cast(nullable(table["row"].type)).combine_chunks(), Chunk(table["text"].combine_chunks(), _train(table))
    rows = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
    return pa.table({"chunk": table["chunk"][:1], "data": pa.array([chunk.saved()], pa.list_(pa.binary())), "rows": rows})


def _loaded(table: pa.Table) -> Chunk:
    return Chunk.load(table["data"][0].as_py())


def _send_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, data in ((n, d) for b in batches for n, d in zip(b.column("chunk").to_pylist(), b.column("data"), strict=True)):
            c = Chunk.load(data.as_py())
            shard = mixed(c.words) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")  # by hash within a shard
            start, size = _runs(shard[order])
            at = [order[s : s + n] for s, n in zip(start, size, strict=True)]
            yield from _table([(number, int(shard[a[0]]), [packed(deltas(c.words[a])), packed(c.word_counts[a])]) for a in at], _BLOB).to_batches()

    return run


def _count_words(table: pa.Table) -> pa.Table:
    """Answers each chunk with the counts over all chunks and the words' ranks in the shard; one more row holds the
    tokens and the distinct words."""
    asked = [(np.cumsum(unpacked(d[0])), unpacked(d[1])) for d in table["data"].to_pylist()]
    words, place = np.unique(np.concatenate([a for a, _ in asked]), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, place, np.concatenate([n for _, n in asked]).astype(np.int64))
    cuts = np.cumsum([len(a) for a, _ in asked])[:-1]
    shard = table["shard"][0].as_py()
    rows = [(c, shard, [packed(total[p]), packed(deltas(p.astype(np.uint64)))]) for c, p in zip(table["chunk"].to_pylist(), np.split(place, cuts), strict=True)]
    return _table([*rows, (-1, shard, [packed(np.array([total.sum(), (total > 0).sum()]))])], _BLOB)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [unpacked(d[0]).astype(np.int64) for d in b.column("data").to_pylist()]
        yield pa.RecordBatch.from_pydict({"tokens": pa.array([int(r[0]) for r in rows], pa.int64()), "distinct_": pa.array([int(r[1]) for r in rows], pa.int64())})


def _word_totals(c: Chunk, answers: dict[int, list[bytes]], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Count of each word over all chunks, and a number that no other word has."""
    order = np.argsort(mixed(c.words) % np.uint64(shards), kind="stable")
    total, number = np.zeros(len(c.words), np.int64), np.zeros(len(c.words), np.uint64)
    total[order] = np.concatenate([unpacked(answers[s][0]) for s in sorted(answers)]).astype(np.int64)
    number[order] = np.concatenate([np.cumsum(unpacked(answers[s][1])) * np.uint64(shards) + np.uint64(s) for s in sorted(answers)])
    return total, number


def _answers(table: pa.Table) -> dict[int, list[bytes]]:
    return dict(zip(table["shard"].to_pylist(), table["data"].to_pylist(), strict=True))


def _send_ngrams(shards: int, training_docs: int, order: int):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], _BLOB)
        c = _loaded(docs)
        c.bigrams()
        total, numbers = _word_totals(c, _answers(counts), shards)
        total = np.append(total, training_docs)
        c.deal(shards, total, numbers, order)
        hashes, named, rows = np.append(c.words, START), c.named(), []
        for s, places, triples in c.dealt():
            at = c.place_pair[places]
            start, size = _runs(c.context[at])
            first = c.context[at[start]]
            names, words, last = named(c.successor[at], c.last[triples])
            rows.append((docs["chunk"][0].as_py(), s, [
                packed(deltas(hashes[first])), packed(size), packed(total[first]), packed(deltas(names)), packed(words), packed(c.pair_counts[at]),
                packed(c.below[places]), packed(last), packed(c.triple_counts[triples]),
            ]))
        return _table(rows, _BLOB)

    return run


def _merged(high: np.ndarray, low: np.ndarray, width: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(high and low of each distinct pair, in order; which of them each row is; their summed counts); low is below the width."""
    pairs, which = _ranked(high * np.int64(width) + low)
    return *np.divmod(pairs, max(width, 1)), which, np.bincount(which, counts, len(pairs))


def _answer_ngrams(table: pa.Table) -> pa.Table:
    asked = []
    for d in table["data"].to_pylist():
        contexts, sizes, totals, names, words, counts, below, last, last_counts = map(unpacked, d)
        sizes, words, below, last = (x.astype(np.int64) for x in (sizes, words, below, last))
        asked.append((np.cumsum(contexts), sizes, totals, np.cumsum(names), words, counts, below, last, last_counts))
    (contexts, context), (vocabulary, name) = (_ranked(np.concatenate([a[i] for a in asked])) for i in (0, 3))
    total = np.empty(len(contexts), np.int64)
    total[context] = np.concatenate([a[2] for a in asked])  # the same in all chunks
    each, triples, n, at = [], [], 0, np.zeros(2, np.int64)
    for c, s, _, v, w, k, b, x, m in asked:
        own, known = context[at[0] :][: len(c)], name[at[1] :][: len(v)]
        seen, met = k > 0, m > 0
        each.append((np.repeat(own, s)[seen], known[w[seen]], k[seen]))
        triples.append((np.repeat(np.cumsum(seen) - 1 + n, b)[met], known[x[met]], m[met]))
        n += int(seen.sum())
        at += len(c), len(v)
    context, word, count = (np.concatenate([e[i] for e in each]) for i in range(3))
    row, last, last_count = (np.concatenate([e[i] for e in triples]) for i in range(3))
    del each, triples
    context, word, which, count = _merged(context, word, len(vocabulary), count)
    pair, last, _, last_count = _merged(which[row], last, len(vocabulary), last_count)
    start, size = _runs(context)
    trie = Trie(
        contexts[context[start]], size, word, count / (total[context] + PRIOR),
        np.bincount(pair, minlength=len(word)), last, last_count / (count[pair] + PRIOR), vocabulary,
    )
    shard = table["shard"][0].as_py()
    return _table([(c, shard, [packed(x) for x in trie.codes(a[0], a[1], a[4], a[6], a[7], a[3])]) for c, a in zip(table["chunk"].to_pylist(), asked, strict=True)], _BLOB)


def _score(shards: int, tokens: int, distinct: int, training_docs: int, order: int):
    fields = [("row", None), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = docs["rows"].combine_chunks().flatten()
        rows = rows.cast(nullable(rows.type))
        if not docs.num_rows:
            return pa.table({"row": rows, **{n: pa.array([], t) for n, t in fields[1:]}})
        c = _loaded(docs)
        c.bigrams()
        of_words = answers["of_words"].to_numpy()
        total, numbers = _word_totals(c, _answers(answers.filter(pa.array(of_words))), shards)
        contexts = np.append(total, training_docs)
        c.deal(shards, contexts, numbers, order)
        parts = _answers(answers.filter(pa.array(~of_words)))
        codes, last = (np.concatenate([unpacked(parts[s][i]) for s, _, _ in c.dealt()]) for i in (0, 1))
        share, before = LEVELS[codes[c.pair_place]], contexts[c.context] + PRIOR
        word = (total + 1.0) / (tokens + distinct + 1.0)
        p = (share + PRIOR / before * word[c.next])[c.pair]
        # how often a bigram was met follows from its share, exactly while the steps of shares are finer than one
        p[c.later] = LEVELS[last][c.triple] + (PRIOR / (np.rint(share * before) + PRIOR))[c.before] * p[c.later]
        add = lambda x: np.add.reduceat(x, c.starts)
        return pa.table({
            "row": rows, "n_tokens": pa.array(c.sizes, pa.int64()), "n_known": pa.array(add((total > 0).astype(np.int64)[c.word])),
            "base_score": pa.array(add(np.log10(word)[c.word])), "score": pa.array(add(np.log10(p))),
        })

    return run


def score_texts(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Each row with n_tokens, n_known, train_tokens, base_score and score, log10 probabilities of its text.

    Learns from the rows whose ``train_col`` is true. Tokens are words in lower case (ASCII) and one end for each
    text; a null or empty text is an end alone. ``base_score`` is the word model with one added to each count;
    ``score`` mixes in, for each token after the one before it, its share c(before, token) / (c(before) + PRIOR)
    with weight PRIOR / (c(before) + PRIOR) left to the word model; shares are quantised. With
    ``order`` 3 that bigram model is in turn what a trigram model of the same form backs off to, with the share
    c(first, before, token) / (c(first, before) + PRIOR); a first token has no trigram. Without training rows
    all tokens are unknown. Repeated rows are scored, and learned from, as often as they come. Input columns of
    the result's names are replaced.
    """
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in docs.columns if c not in results]
    text, train = F.col(text_col), F.coalesce(F.col(train_col), F.lit(False))
    size, training_docs = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count_if(train)).first()
    n = int(size // CHUNK_BYTES) + 1
    carried = F.struct(*[c for c in keep if c != text_col])
    data = docs.select(carried.alias("row"), text.alias("text"), train.alias("train"), F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int").alias("chunk"))

    row_type = data.schema["row"].dataType.simpleString()
    chunks = stored(data.groupBy("chunk").applyInArrow(_read, f"chunk int, data array<binary>, rows array<{row_type}>"), "chunks")
    words = stored(chunks.select("chunk", "data").mapInArrow(_send_words(n), _BLOB_DDL).groupBy("shard").applyInArrow(_count_words, _BLOB_DDL), "words")
    sums = words.filter("chunk = -1").mapInArrow(_numbers, "tokens long, distinct_ long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct_"), F.lit(0)))
    tokens, distinct = sums.first()
    words = words.filter("chunk >= 0")
    by_chunk = chunks.groupBy("chunk")
    sent = by_chunk.cogroup(words.groupBy("chunk")).applyInArrow(_send_ngrams(n, training_docs, order), _BLOB_DDL)
    answered = sent.groupBy("shard").applyInArrow(_answer_ngrams, _BLOB_DDL)
    answers = words.withColumn("of_words", F.lit(True)).union(answered.withColumn("of_words", F.lit(False)))
    out = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_score(n, tokens, distinct, training_docs, order), f"row {row_type}, n_tokens long, n_known long, base_score double, score double")
    return out.select("row.*", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
