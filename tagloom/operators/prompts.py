"""Prompt cutting inside batches of token rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import tokens as K
from tagloom.operators.ordered import join_null_safe, small_side


def extract_prompt(df: DataFrame, batch: str, ids: str, delimiter: Sequence[int], pad_id: int, mask: str | None = None) -> DataFrame:
    """Keep the tokens up to the first delimiter and pad them to the longest prompt of the batch.

    Rows without a delimiter have no prompt and leave the batch; a NULL batch is a batch. ``mask`` names the
    attention mask that came with the tokens, which is cut and padded like them; without one every token counts.
    The longest prompt per batch is an aggregate joined back, so the token rows themselves are not shuffled.
    """
    cut = df.withColumn("prompt_len", K.prompt_end(ids, list(delimiter)).cast("bigint")).where("prompt_len > 0")
    longest = cut.groupBy(batch).agg(F.max("prompt_len").alias("_longest"))
    joined = join_null_safe(cut, small_side(longest), [batch])
    head = F.slice(F.col(ids), F.lit(1), F.col("prompt_len").cast("int"))
    longest_len = F.col("_longest").cast("int")
    kept = K.attention_mask(head, longest_len) if mask is None else K.pad(F.slice(F.col(mask), F.lit(1), F.col("prompt_len").cast("int")), longest_len, 0)
    prompt = K.pad(head, F.col("_longest").cast("int"), pad_id)
    return joined.withColumns({"prompt": prompt, "attention_mask": kept}).drop("_longest")
