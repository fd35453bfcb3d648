"""The tag taxonomy as a small dimension table."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_TAGS = 100_000  # a taxonomy is configuration; beyond this it is data and must be joined as a table


@dataclass(frozen=True)
class Taxonomy:
    """``frame`` holds ``category, cat_pos, tag, tag_pos, tag_idx``; its size was counted when it was read."""

    frame: DataFrame
    rows: tuple[tuple[str, int, str, int, int], ...]

    @classmethod
    def from_frame(cls, tags: DataFrame, max_tags: int = MAX_TAGS) -> Taxonomy:
        """From ``(category, cat_pos, tag[, tag_pos])``; tags go by name where no position is given."""
        order = "tag_pos" if "tag_pos" in tags.columns else "tag"
        found = sorted(
            ((r["category"], r["cat_pos"], r["tag"], r[order]) for r in tags.limit(max_tags + 1).collect()),
            key=lambda r: (r[1], r[3]),
        )
        if len(found) > max_tags:
            raise ValueError(f"more than {max_tags} tags: join them with categorize_by_join instead")
        rows, seen = [], {}
        for idx, (category, cat_pos, tag, _) in enumerate(found):
            rows.append((category, cat_pos, tag, seen.get(category, 0), idx))
            seen[category] = seen.get(category, 0) + 1
        names = ("category", "cat_pos", "tag", "tag_pos", "tag_idx")
        types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
        columns = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))}
        return cls(tags.sparkSession.createDataFrame(pa.table(columns)), tuple(rows))

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> Taxonomy:
        """From a JSON object ``{category: [tag, ...]}``, keeping the order of keys and of tags."""
        return cls.from_frame(explode_taxonomy_json(spark.read.text(path, wholetext=True), "value"))

    @property
    def categories(self) -> list[str]:
        return list(dict.fromkeys(r[0] for r in self.rows))

    @property
    def size(self) -> int:
        return len(self.rows)

    def tags(self, category: str | None = None) -> list[str]:
        return [r[2] for r in self.rows if category is None or r[0] == category]

    def tags_column(self, category: str | None = None) -> Column:
        return _constant([_quoted(t) for t in self.tags(category)], "string")

    def ranges(self) -> DataFrame:
        """Half-open index range of every category."""
        return self.frame.groupBy("category").agg(
            F.min("tag_idx").cast("bigint").alias("start"), (F.max("tag_idx") + 1).cast("bigint").alias("end_excl")
        )

    def join_long(self, df: DataFrame, tag_col: str, how: str = "inner") -> DataFrame:
        """Look up category and index of a tag column by a hash join with the counted dimension."""
        dim = self.frame.select("category", "cat_pos", F.col("tag").alias(tag_col), "tag_idx")
        return df.join(F.broadcast(dim), tag_col, how)

    def encode(self, df: DataFrame, tags_col: str, normalize_case: bool = False) -> DataFrame:
        """Add ``tag_idx``: the sorted taxonomy positions of the row's known tags, without a shuffle.

        The dimension is one constant, tags dealt to buckets by their CRC; a tag is compared with those of its bucket.
        """
        buckets: list[list[str]] = [[] for _ in range(max(1, self.size))]
        for _, _, tag, _, idx in self.rows:
            buckets[zlib.crc32(tag.encode()) % len(buckets)].append(f"named_struct('t', {_quoted(tag)}, 'i', {int(idx)})")
        kind = "struct<t:string,i:int>"
        index = F.expr("array(" + ", ".join(f"CAST(array({', '.join(b)}) AS array<{kind}>)" for b in buckets) + ")")
        own = (lambda t: F.lower(t)) if normalize_case else (lambda t: t)
        near = lambda t: F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(len(buckets))).cast("int"))
        found = lambda t: F.transform(F.filter(F.coalesce(near(own(t)), F.array().cast(f"array<{kind}>")), lambda e: e["t"] == own(t)), lambda e: e["i"])
        return df.withColumn("tag_idx", F.array_sort(F.array_distinct(F.flatten(F.transform(F.col(tags_col), found)))))

    def decode(self, idx_col) -> Column:
        names = self.tags_column()
        return F.transform(F.col(idx_col) if isinstance(idx_col, str) else idx_col, lambda i: F.get(names, i))

    def dense(self, idx_col: str = "tag_idx") -> Column:
        """The 0/1 vector over the whole taxonomy."""
        return F.transform(
            F.sequence(F.lit(0), F.lit(self.size - 1)),
            lambda j: F.when(F.array_contains(F.col(idx_col), j), F.lit(1.0)).otherwise(F.lit(0.0)),
        )


def _quoted(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _constant(items: Sequence[str], kind: str) -> Column:
    """An array of SQL literals as one expression, which the optimizer folds to one constant."""
    return F.expr(f"CAST(array({', '.join(items)}) AS array<{kind}>)")


def explode_taxonomy_json(df: DataFrame, json_col: str) -> DataFrame:
    """``(category, cat_pos, tag, tag_pos)`` of a JSON object column, in the order of the text."""
    parsed = F.from_json(F.col(json_col), "map<string,array<string>>")
    cats = df.select(F.posexplode(F.map_entries(parsed)).alias("cat_pos", "e"))
    return cats.select(F.col("e.key").alias("category"), "cat_pos", F.posexplode("e.value").alias("tag_pos", "tag"))


def taxonomy_summary(tags: DataFrame, first: int = 3) -> DataFrame:
    """Number of tags per category and the first few of them."""
    w = W.partitionBy("category").orderBy("tag_pos")
    head = (
        tags.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= first)
        .groupBy("category")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "tag"))).alias("h"))
    )
    counts = tags.groupBy("category").agg(F.count("*").alias("n_tags"))
    return counts.join(head, "category").select(
        "category", "n_tags", F.array_join(F.transform("h", lambda x: x["tag"]), ", ").alias("examples")
    )
