"""Column expressions over token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.bind import let

IGNORED = -100  # fixed value: label of a position the loss skips


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def with_end_token(ids, end_id: int) -> Column:
    a = _c(ids)
    last = F.get(a, F.size(a) - 1)
    return F.when(last == end_id, a).otherwise(F.concat(a, F.array(F.lit(end_id))))


def truncate(ids, max_length) -> Column:
    return F.slice(_c(ids), F.lit(1), max_length if isinstance(max_length, Column) else F.lit(max_length))


def pad(ids, length, pad_id: int, side: str = "right") -> Column:
    a = _c(ids)
    n = length if isinstance(length, Column) else F.lit(length)
    fill = F.array_repeat(F.lit(pad_id), F.greatest(n - F.size(a), F.lit(0)))
    return F.concat(a, fill) if side == "right" else F.concat(fill, a)


def attention_mask(ids, length, side: str = "right") -> Column:
    return pad(F.transform(_c(ids), lambda _: F.lit(1)), length, 0, side)


def prompt_end(ids, delimiter: list[int]) -> Column:
    """Number of tokens up to and including the first delimiter; 0 when there is none."""
    m = len(delimiter)

    def first_end(v: Column) -> Column:
        a = v["a"]

        def matches(j: Column) -> Column:
            hit = F.get(a, j - 1) == delimiter[0]
            for k, token in enumerate(delimiter[1:], start=1):
                hit = hit & (F.get(a, j - 1 + k) == token)
            return F.coalesce(hit, F.lit(False))

        starts = F.sequence(F.lit(1), F.greatest(F.size(a) - (m - 1), F.lit(1)))
        return F.coalesce(F.get(F.filter(starts, matches), F.lit(0)) + (m - 1), F.lit(0))

    return let(first_end, a=_c(ids))


def mask_labels(ids, delimiter: list[int]) -> Column:
    """Labels for causal training: the prompt is ignored, and so is a row without a delimiter."""

    def masked(p: Column) -> Column:
        return F.transform(p["a"], lambda x, i: F.when((p["e"] == 0) | (i < p["e"]), F.lit(IGNORED)).otherwise(x))

    return let(masked, a=_c(ids), e=prompt_end(ids, delimiter))
