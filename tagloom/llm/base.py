"""What the operators of this package share: tables, words as 64-bit hashes, and scratch tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import scratch_path

#: A word is a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
LAST_ID = (1 << 63) - 1
CACHED_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    At most so many ``files``, if given. Where Spark does not merge small partitions, each of them would be a file, and
    for each file an executor starts commands, which for a moment count as large as the executor itself.
    """
    path = scratch_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_key(name: str) -> Column:
    """An id by which rows can be ordered; a null id counts as larger than all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def held_back(name: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def words_of(text: bytes | None) -> list[bytes]:
    """``bytes.split`` cuts at exactly the six ASCII white-space characters of WORD."""
    return text.split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash, remembered for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit (xor-shifts and odd factors)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A hash of every n consecutive words, given the hashes of the words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k, factor in enumerate(odd_multipliers(n, seed)):
        out += h[k : k + m] * factor
    return mixed(out)


def batch(**columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})


def texts(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with nulls allowed in all its parts, which is how Spark reads a schema from text."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    return pa.list_(nullable(kind.value_type)) if pa.types.is_list(kind) else kind


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Consecutive runs of the values, as a list column."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))


def bounded(df: DataFrame, rows: int, name: str, files: int | None = None) -> DataFrame:
    """The table, stored; marked for broadcast only if it has at most so many rows, else joined by shuffle."""
    kept = stored(df, name, files)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept
