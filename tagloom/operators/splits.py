"""Seeded exact splits and samples without a global sort.

Rows are ranked by ``(md5(seed:group:id), id)``. A split is then nothing but a comparison with a *cut key*, the key
at the split's last rank. Cut keys are found by radix descent over the digits of the hash, for all cuts at once: rows
are counted per first digits, the buckets that hold a wanted rank are counted by the next digits, and the cell that
holds it, some hundred keys of 10^11 rows, is read out. Only tables of counts are put in order. The rows themselves
are not shuffled, and nothing runs before the result is asked for. Copies of one id share a key and stay together, so
sizes are exact when ids are unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from tagloom.functions.bind import let
from tagloom.functions.hashing import hash_key, hash_normal, hash_uniform
from tagloom.operators.ordered import checked_small, join_null_safe
from tagloom.operators.taxonomy import Taxonomy

#: Hex digits of the two steps of the descent: 4,096 buckets, 65,536 cells in each that is entered.
STEPS = (3, 4)
#: Groups whose cuts are broadcast; more are refused unless ``many_groups`` asks for a join by shuffle.
BROADCAST_GROUPS = 20_000
BELOW = ""  # sorts before every hex digest

Ranks = Callable[[Column], Sequence[Column]]


def _key(id_col: str, seed, by: Sequence[str]) -> Column:
    return F.struct(hash_key(seed, *[F.col(b) for b in by], F.col(id_col)).alias("m"), F.col(id_col).alias("id"))


def cut_keys(
    df: DataFrame, id_col: str, seed, ranks: Ranks, by: Sequence[str] = (), sizes: DataFrame | None = None, many_groups: bool = False
) -> DataFrame:
    """``(by..., key)``: for every wanted rank up to the row count the key of the last row at or below it.

    ``ranks`` maps the row count n to increasing ranks. Ranks below 1 get a key below all rows. ``sizes`` adds columns for ``ranks`` to each
    group. A NULL in ``by`` is a group like any other.
    """
    by, (first, second) = list(by), STEPS
    key, bucket = _key(id_col, seed, by), lambda k: F.substring(k["m"], 1, first)
    counts = df.groupBy(*by, bucket(key).alias("bucket")).agg(F.count("*").alias("c"))
    tables = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "c"))).alias("table"), F.sum("c").alias("n"))
    if sizes is not None:
        tables = join_null_safe(tables, sizes, by)
    none = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("string").alias("bucket"), F.lit(None).cast("bigint").alias("need"))

    def enter(r: Column, part: Column) -> Column:
        """The bucket of rank r and the rank in it, both NULL outside 1..n."""

        def step(a: Column, b: Column) -> Column:
            here = (a["seen"] < r) & (r <= a["seen"] + b["c"])
            return F.struct(
                (a["seen"] + b["c"]).alias("seen"), F.when(here, b["bucket"]).otherwise(a["bucket"]).alias("bucket"),
                F.when(here, r - a["seen"]).otherwise(a["need"]).alias("need"),
            )

        return F.aggregate("table", none, step, lambda a: F.struct(part.alias("part"), r.alias("r"), a["bucket"].alias("bucket"), a["need"].alias("need")))

    wanted = tables.select(*by, F.transform(F.array(*[r.cast("bigint") for r in ranks(F.col("n"))]), enter).alias("w"))
    if by:
        entered = wanted.select(*by, F.inline("w")).where("bucket is not null")
        entered = entered if many_groups else F.broadcast(checked_small(entered, len(ranks(F.lit(1))) * BROADCAST_GROUPS, "split groups"))
        near = join_null_safe(df.select(*by, key.alias("key"), bucket(key).alias("bucket")), entered, [*by, "bucket"])
    else:
        here = F.filter("_w", lambda w: w["bucket"] == F.col("_bucket"))
        near = df.select(key.alias("key"), bucket(key).alias("_bucket"), wanted.select("w").scalar().alias("_w")).select("key", F.inline(here))
    ties = near.groupBy(*by, "part", "need", "key").agg(F.count("*").alias("c"))
    cells = ties.groupBy(*by, "part", "need", F.substring("key.m", first + 1, second).alias("cell")).agg(
        F.sum("c").alias("c"), F.sort_array(F.collect_list(F.struct("key", "c"))).alias("keys")
    )
    still = F.col("need") - (F.sum("c").over(W.partitionBy(*by, "part").orderBy("cell")) - F.col("c"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast(ties.schema["key"].dataType).alias("key"))
    step = lambda a, k: F.struct((a["seen"] + k["c"]).alias("seen"), F.when(a["seen"] < F.col("still"), k["key"]).otherwise(a["key"]).alias("key"))
    found = cells.select(*by, "c", "keys", still.alias("still")).where("still > 0 and still <= c").select(*by, F.aggregate("keys", start, step, lambda a: a["key"]).alias("key"))
    below = F.transform(F.filter("w", lambda w: w["r"] <= 0), lambda w: F.struct(F.lit(BELOW).alias("m"), F.lit(None).cast(df.schema[id_col].dataType).alias("id")))
    return found.unionByName(wanted.select(*by, F.explode(below).alias("key")))


def with_part(
    df: DataFrame, id_col: str, seed, ranks: Ranks, by: Sequence[str] = (), name: str = "part", sizes: DataFrame | None = None,
    many_groups: bool = False,
) -> DataFrame:
    """Add the 0-based part a row falls into: how many of the wanted ranks its own rank exceeds.

    The cuts of up to ``BROADCAST_GROUPS`` groups go to the rows by broadcast, a number that is checked when the query
    runs; with ``many_groups`` they are joined by shuffle, whatever their number.
    """
    by = list(by)
    cuts = cut_keys(df, id_col, seed, ranks, by, sizes, many_groups)
    lists = cuts.groupBy(*by).agg(F.collect_list("key").alias("_cuts"))
    if not by:
        joined = df.withColumn("_cuts", lists.scalar())
    elif many_groups:
        joined = join_null_safe(df, lists, by, "left")
    else:
        joined = join_null_safe(df, F.broadcast(checked_small(lists, BROADCAST_GROUPS, "split groups")), by, "left")
    below = let(lambda v: F.size(F.filter(F.coalesce("_cuts", F.array().cast(lists.schema["_cuts"].dataType)), lambda c: c < v["key"])), key=_key(id_col, seed, by))
    return joined.withColumn(name, below).drop("_cuts")


def assign_splits(
    df: DataFrame, id_col: str, seed, ranks: Ranks, names: Sequence[str] = ("train", "validation", "test"),
    by: Sequence[str] = (), name: str = "split", sizes: DataFrame | None = None, many_groups: bool = False,
) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in names])
    return with_part(df, id_col, seed, ranks, by, "_part", sizes, many_groups).withColumn(name, F.get(labels, F.col("_part"))).drop("_part")


def keep_first(df: DataFrame, id_col: str, seed, size: Callable[[Column], Column], by: Sequence[str] = (), many_groups: bool = False) -> DataFrame:
    """Exactly ``size(n)`` rows of every group, drawn without replacement."""
    return with_part(df, id_col, seed, lambda n: [size(n)], by, "_part", None, many_groups).where("_part = 0").drop("_part")


def ranks_hold_out(test: float, second: float) -> Ranks:
    """Hold out ``ceil(test * n)`` rows, then cut those again at ``ceil(second * held)`` for the last split."""

    def ranks(n: Column) -> list[Column]:
        held = F.ceil(F.lit(test) * n)
        return [n - held, n - F.ceil(F.lit(second) * held)]

    return ranks


def ranks_balanced(train: float, valid: float, test: float) -> Ranks:
    """``floor(train * n)`` rows, then the rest shared in the ratio of the other two fractions."""
    ratio = valid / (valid + test)

    def ranks(n: Column) -> list[Column]:
        first = F.floor(F.lit(train) * n)
        return [first, first + F.floor(F.lit(ratio) * (n - first))]

    return ranks


def ranks_truncated(test: float, valid: float) -> Ranks:
    """``int(n * test)`` and ``int((n - n_test) * valid)``; the remainder trains."""

    def ranks(n: Column) -> list[Column]:
        n_test = F.floor(n * F.lit(test))
        n_valid = F.floor((n - n_test) * F.lit(valid))
        return [n - n_valid - n_test, n - n_test]

    return ranks


def held_per_stratum(df: DataFrame, test: float, by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``(within..., by..., held)``: the ``ceil(test * n)`` test rows of each table of strata, dealt out by largest remainder.

    Only the table of strata is put in order. Among equal remainders the larger stratum comes first, then by name.
    """
    strata = df.groupBy(*within, *by).agg(F.count("*").alias("c"))
    each = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    quota = F.col("total") * F.col("c") / F.col("n")
    strata = strata.withColumn("n", F.sum("c").over(each)).withColumn("total", F.ceil(F.lit(test) * F.col("n")))
    strata = strata.withColumn("whole", F.floor(quota)).withColumn("rest", F.round(quota - F.col("whole"), 9))
    place = F.row_number().over(each.orderBy(F.desc("rest"), F.desc("c"), *[F.col(b).asc_nulls_first() for b in by]))
    more = place <= F.col("total") - F.sum("whole").over(each)
    return strata.select(*within, *by, (F.col("whole") + more.cast("bigint")).alias("held"))


def stratified_split(df: DataFrame, id_col: str, seed, test: float, by: Sequence[str], within: Sequence[str] = (), many_groups: bool = False) -> DataFrame:
    """Train/test split with ``ceil(test * n)`` test rows in all, every stratum as near to its share as that allows."""
    sizes = held_per_stratum(df, test, by, within)
    return assign_splits(df, id_col, seed, lambda n: [n - F.col("held")], ("train", "test"), [*within, *by], sizes=sizes, many_groups=many_groups)


def repeated_splits(df: DataFrame, id_col: str, runs: int, test: float, by: Sequence[str] = ()) -> DataFrame:
    """``runs`` independent train/test splits, each stratified by ``by``."""
    many = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return stratified_split(many, id_col, "run", test, by, ["run"])


def sample_fraction(df: DataFrame, id_col: str, fraction: float, seed, exact: bool = True) -> DataFrame:
    """A share of the rows: exactly ``round(fraction * n)`` of them, or each with that chance in one pass."""
    if exact:
        return keep_first(df, id_col, seed, lambda n: F.bround(F.lit(fraction) * n, 0))
    return df.where(hash_uniform(F.lit(seed), F.col(id_col)) < fraction)


def sample_n(df: DataFrame, id_col: str, n: int, seed) -> DataFrame:
    """``n`` rows drawn by seeded rank. Rows that repeat an id stay together, so the last id can make it a few more."""
    return keep_first(df, id_col, seed, lambda _: F.lit(n))


def latent_normal(df: DataFrame, id_col: str, dim: int, seed, name: str = "z") -> DataFrame:
    """A standard normal vector per row."""
    draw = lambda j: hash_normal(F.lit(seed), F.col(id_col), j)
    return df.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), draw))


def random_tag_sets(df: DataFrame, tax: Taxonomy, id_col: str, per_category: int, seed) -> DataFrame:
    """A baseline without structure: the same number of hashed picks from every category, row by row."""
    parts = []
    for category in tax.categories:
        keyed = F.transform(
            tax.tags_column(category), lambda t: F.struct(hash_key(seed, F.col(id_col), t).alias("m"), t.alias("t"))
        )
        parts.append(F.transform(F.slice(F.array_sort(keyed), 1, per_category), lambda s: s["t"]))
    return df.withColumn("tags", F.concat(*parts))
