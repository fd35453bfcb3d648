"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
SLOTS = 1 << 16
#: Bound of the broadcast matrix; so many languages that it would be passed need fewer slots.
MATRIX_BYTES = 64_000_000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters handled at once, so that memory does not follow the batch.
PIECE = 1_000_000
_LETTERS: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0][points]


def features(group: list[str], slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of every n-gram of the texts, where each text starts in them, and whether it has a letter.

    All that is not a letter is a space. Slot 0 is for n-grams without a letter and counts for nothing.
    """
    pad = " " * (max(ORDERS) - 1)  # at both ends, so that no n-gram has letters of two texts
    parts = [pad + t.lower() + pad for t in group]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    letter = is_letter(points)
    code = np.where(letter, points, 32).astype(np.uint32)
    out, gram, some = [], np.zeros(len(code), np.uint32), np.zeros(len(code), bool)
    for n in range(1, max(ORDERS) + 1):
        end = len(code) - n + 1
        gram = (gram[:end] * np.uint32(0x01000193)) ^ (code[n - 1 :] + np.uint32(n << 24))
        some = some[:end] | letter[n - 1 :]
        if n in ORDERS:
            h = gram * np.uint32(0x9E3779B1)
            slot = np.where(some, ((h ^ (h >> np.uint32(15))) % np.uint32(slots - 1)) + 1, 0)
            out.append(np.concatenate([slot, np.zeros(n - 1, slot.dtype)]))
    return np.stack(out), starts, np.logical_or.reduceat(letter, starts)


def pieces(column: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Rows with a text, in groups of about PIECE characters."""
    rows, group, size = [], [], 0
    for i, t in enumerate(column.to_pylist()):
        if t:
            rows.append(i)
            group.append(t)
            size += len(t)
        if size >= PIECE:
            yield rows, group
            rows, group, size = [], [], 0
    if rows:
        yield rows, group


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # slots x languages, row 0 zero


def slots_for(languages: int) -> int:
    slots = SLOTS
    while slots * languages * 4 > MATRIX_BYTES and slots > 1024:
        slots //= 2
    return slots


def train(labelled: DataFrame, text_col: str, lang_col: str) -> Model:
    """Counts over all labelled rows; only the languages and their slots reach the driver."""
    languages = sorted(r[0] for r in labelled.filter(F.col(lang_col).isNotNull()).select(lang_col).distinct().collect())
    slots = slots_for(len(languages))
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), slots), np.int64)
        docs = np.zeros(len(languages), np.int64)
        for b in batches:
            lang = b.column("lang").to_pylist()
            for rows, group in pieces(b.column("t")):
                slot, starts, has_letter = features(group, slots)
                known = np.array([place[lang[i]] for i in rows])
                at = np.repeat(known, np.diff(np.append(starts, slot.shape[1])))
                total += np.bincount((slot + at * slots).ravel(), minlength=total.size).reshape(total.shape)
                docs += np.bincount(known[has_letter], minlength=len(languages))
        total[:, 0] = docs
        at, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[at, slot])], ["lang", "slot", "n"])

    total = np.zeros((slots, len(languages)))
    if languages:
        rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).mapInArrow(count, "lang int, slot int, n long")
        found = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
        total[found["slot"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    docs, total[0] = total[0].copy(), 0
    smooth = total + SMOOTHING
    log_prob = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    log_prob[0] = 0
    return Model(languages, np.log(docs + 1.0), log_prob)


def predict(model: Model, group: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    slot, starts, has_letter = features(group, len(model.log_prob))
    score = np.zeros((len(group), len(model.languages)))
    for j in range(len(model.languages)):
        column = np.ascontiguousarray(model.log_prob[:, j])
        score[:, j] = np.add.reduceat(column[slot].sum(axis=0, dtype=np.float64), starts) + model.log_prior[j]
    best = score.argmax(axis=1)
    odds = np.exp(score - score.max(axis=1, keepdims=True))
    sure = np.where(has_letter, 1 / odds.sum(axis=1), 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter.tolist(), strict=True)], sure, has_letter


def identify_language(docs: DataFrame, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each row of ``docs`` with ``lang_pred``, ``score``, the posterior probability of that language, and ``has_letter``.

    The model is fitted on all rows of ``labelled`` with a language. A null text, a text without a letter and
    every text when nothing was learned get ``und`` with score 0; ``has_letter`` does not depend on what was learned. Equal texts get equal results, up to rounding of the score; ties go to the
    language that sorts first. Input columns of the result's names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled, text_col, lang_col))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "has_letter")]
    data = docs.select(F.struct(*keep).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, letter = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for rows, group in pieces(b.column("row").field(text_col)):
                if model.value.languages:
                    found, score[rows], letter[rows] = predict(model.value, group)
                    for i, x in zip(rows, found, strict=True):
                        lang[i] = x
                else:
                    letter[rows] = [any(map(str.isalpha, t.lower())) for t in group]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(lang, pa.string()), pa.array(score), pa.array(letter)], ["row", "lang_pred", "score", "has_letter"])

    row_type = data.schema["row"].dataType.simpleString()
    return data.mapInArrow(run, f"row {row_type}, lang_pred string, score double, has_letter boolean").select("row.*", "lang_pred", "score", "has_letter")
