"""Alignments of token lists for a whole Arrow batch at once: common subsequences and matched words.

Tokens become numbers; every step below works on all pairs of a chunk of the batch, so the Python work goes with the
length of the longest text of a chunk and not with its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of the tables of a chunk of pairs; a pair that needs more is a chunk of its own.
CELLS = 1 << 23
#: Words of the rows that are taken at a time; a row of more is taken alone.
WORDS = 1 << 17


def ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive runs of these sizes: the run of each element and its place in it."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def numbered(*columns: pa.Array) -> tuple[list[np.ndarray], int]:
    """The strings of several arrays as numbers, equal ones alike, and how many there are."""
    some = [c.cast(pa.string()) for c in columns if len(c)]
    if not some:
        return [np.zeros(0, np.int64) for _ in columns], 0
    codes = pa.concat_arrays(some).dictionary_encode()
    flat = codes.indices.to_numpy().astype(np.int64)
    return np.split(flat, np.cumsum([len(c) for c in columns])[:-1]), len(codes.dictionary)


def sizes_of(column: pa.ListArray) -> np.ndarray:
    return np.diff(column.offsets.to_numpy()).astype(np.int64)


def portions(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive rows of these numbers of words, at most WORDS of them at a time; no rows are one portion."""
    total, begin = np.cumsum(sizes), 0
    while begin < len(sizes) or not begin:
        before = total[begin - 1] if begin else 0
        end = max(int(np.searchsorted(total, before + WORDS, side="right")), begin + 1)
        yield slice(begin, min(end, len(sizes)))
        begin = end


def gathered(codes: np.ndarray, start: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """Runs of codes as the rows of a matrix, filled up at the end."""
    out = np.full((len(start), int(size.max(initial=0))), fill, np.int64)
    row, place = ragged(size)
    out[row, place] = codes[np.repeat(start, size) + place]
    return out


def chunks(a: np.ndarray, b: np.ndarray, tables: bool) -> Iterator[np.ndarray]:
    """The pairs of sizes a and b, alike ones together, in chunks of at most CELLS cells; without ``tables`` a pair
    needs only a row of its table."""
    order = np.lexsort((a, b))
    begin = 0
    for at in range(1, len(order) + 1):
        some = order[begin : at + 1]
        cells = len(some) * (int(b[some].max()) + 1) * (int(a[some].max()) + 1 if tables else 1)
        if at == len(order) or cells > CELLS:
            yield order[begin:at]
            begin = at


def lcs_lengths(codes_a: np.ndarray, start_a: np.ndarray, size_a: np.ndarray, codes_b: np.ndarray, start_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of runs, by the rows of the usual table."""
    out = np.zeros(len(size_a), np.int64)
    for some in chunks(size_a, size_b, False):
        a, b = gathered(codes_a, start_a[some], size_a[some], -1), gathered(codes_b, start_b[some], size_b[some], -2)
        row = np.zeros((len(some), b.shape[1] + 1), np.int32)
        for i in range(a.shape[1]):
            step = np.maximum(row[:, 1:], row[:, :-1] + (b == a[:, i, None]))
            np.maximum.accumulate(step, axis=1, out=row[:, 1:])
        out[some] = row[:, -1]
    return out


def lcs_marks(codes_a: np.ndarray, start_a: np.ndarray, size_a: np.ndarray, codes_b: np.ndarray, start_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which elements of ``codes_a`` lie in a longest common subsequence of some pair that holds them, each read
    backwards from the end of both runs: along equal tokens, else to the longer rest, in ``a`` if they are alike."""
    marks = np.zeros(len(codes_a), bool)
    for some in chunks(size_a, size_b, True):
        a, b = gathered(codes_a, start_a[some], size_a[some], -1), gathered(codes_b, start_b[some], size_b[some], -2)
        table = np.zeros((a.shape[1] + 1, len(some), b.shape[1] + 1), np.int16 if min(a.shape[1], b.shape[1]) < 1 << 15 else np.int32)
        for i in range(a.shape[1]):
            step = np.maximum(table[i, :, 1:], table[i, :, :-1] + (b == a[:, i, None]).astype(table.dtype))
            np.maximum.accumulate(step, axis=1, out=table[i + 1, :, 1:])
        r, i, j = np.arange(len(some)), size_a[some].copy(), size_b[some].copy()
        while True:
            on = (i[r] > 0) & (j[r] > 0)
            r = r[on]
            if not len(r):
                break
            x, y = i[r], j[r]
            equal = a[r, x - 1] == b[r, y - 1]
            left = ~equal & (table[x, r, y - 1] > table[x - 1, r, y])
            marks[start_a[some][r[equal]] + x[equal] - 1] = True
            i[r] -= ~left
            j[r] -= equal | left
    return marks


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def summary_hits(p: pa.ListArray, r: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lcs, hits, tokens of p, tokens of r) of rows of sentences, ``list<list<string>>``.

    ``lcs`` is that of the whole texts. For ``hits`` every sentence of r marks its tokens in a longest common
    subsequence with any sentence of p; a token counts as often as it is marked, but no more often than p holds it.
    """
    n = len(p)
    (ps, rs), (pt, rt) = (p.flatten(), r.flatten()), (p.flatten().flatten(), r.flatten().flatten())
    (cp, cr), kinds = numbered(pt, rt)
    p_sent, r_sent, p_size, r_size = sizes_of(p), sizes_of(r), sizes_of(ps), sizes_of(rs)
    p_start, r_start = np.cumsum(p_size) - p_size, np.cumsum(r_size) - r_size
    p_row, r_row = np.repeat(np.arange(n), p_sent), np.repeat(np.arange(n), r_sent)
    p_tokens, r_tokens = per_row(p_size, p_row, n), per_row(r_size, r_row, n)
    whole = lcs_lengths(cp, np.cumsum(p_tokens) - p_tokens, p_tokens, cr, np.cumsum(r_tokens) - r_tokens, r_tokens)
    row, place = ragged(p_sent * r_sent)  # every sentence of r with every one of p, row by row
    of_r, of_p = place // np.maximum(p_sent[row], 1), place % np.maximum(p_sent[row], 1)
    i, j = (np.cumsum(r_sent) - r_sent)[row] + of_r, (np.cumsum(p_sent) - p_sent)[row] + of_p
    marks = lcs_marks(cr, r_start[i], r_size[i], cp, p_start[j], p_size[j])
    marked = np.repeat(r_row, r_size)[marks] * kinds + cr[marks]
    key, times = np.unique(marked, return_counts=True)
    held, often = np.unique(np.repeat(p_row, p_size) * kinds + cp, return_counts=True)
    at = np.searchsorted(held, key)
    hits = per_row(np.minimum(times, often[at]), key // max(kinds, 1), n) if len(key) else np.zeros(n, np.int64)
    return whole, hits, p_tokens, r_tokens


def matched_words(p: pa.ListArray, r: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(matches, chunks, words of p, words of r) of rows of words: words are matched from the end, the last of p to the
    last equal one of r; a chunk is a run of matches that follow each other on both sides."""
    n, ((cp, cr), kinds), sizes = len(p), numbered(p.flatten(), r.flatten()), (sizes_of(p), sizes_of(r))
    sides, most = [], int(max(x.max(initial=0) for x in sizes)) + 1
    for codes, size in zip((cp, cr), sizes):
        row, place = ragged(size)
        word = row * kinds + codes
        order = np.lexsort((-place, word))
        word = word[order]
        first = np.append(True, word[1:] != word[:-1])[: len(order)]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        sides.append((word * most + nth, row[order], place[order]))
    _, a, b = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    row, i, j = sides[0][1][a], sides[0][2][a], sides[1][2][b]
    order = np.lexsort((i, row))
    row, i, j = row[order], i[order], j[order]
    follows = (row[1:] == row[:-1]) & (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1)
    new = np.append(True, ~follows)[: len(row)]
    return np.bincount(row, minlength=n), np.bincount(row[new], minlength=n), *sizes
