"""A Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups, and a proof per row.

Where a leaf stands in its group is a rank query, not a sort. Tasks turn the ids of a group into words of 64 bits,
which merge by a bitwise or; running popcounts over four levels of 2^10, 2^16, 2^16 and 2^16 entries are the
directories. A row looks up its word alone: its rank is the directory entry and the popcount of the bits below its
own. Rows then go to slot arrays by (group, rank div 4096); a block of slots is reduced by twelve levels at once, and
the roots of the blocks are the leaves of the next, 4096 times smaller, round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.base import bounded, id_key, stored

#: Levels of the tree that one block of slots covers.
BLOCK_LEVELS = 12
#: Bits of an id below each directory: a word, a container of words, and two levels of containers.
DIRECTORIES = (6, 16, 32, 48)
#: Parts that rows of one id and one leaf are dealt to.
SALTS = 64
#: A table of groups up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_GROUPS = 10_000


def part(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` for null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def shifted(value: int) -> Column:
    """The value, shifted left by the place of an id in its word."""
    return F.call_function("shiftleft", F.lit(value).cast("long"), F.col("key").bitwiseAND(63).cast("int"))


def own_bit() -> Column:
    return shifted(1)


def lower_bits() -> Column:
    return F.bitwise_not(shifted(-1))


def running(amount: str, by: list[str], at: str) -> Column:
    """The sum of what stands before a row among those with the same ``by``."""
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(before), F.lit(0))


def word_index(rows: DataFrame) -> DataFrame:
    """(grp, at0, bits, n, base, total): for each word of 64 ids of a group its bitmap, its rows, the rows of the
    group before it and all of them.

    ``rows`` has (grp, key). No window holds more than 2^16 entries, whatever the size of a group.
    """
    level = [stored(rows.groupBy("grp", F.shiftright("key", DIRECTORIES[0]).alias("at0")).agg(F.bit_or(own_bit()).alias("bits"), F.count("*").alias("n0")), "words")]
    for k in range(1, len(DIRECTORIES) + 1):
        up = F.shiftright(f"at{k - 1}", DIRECTORIES[k] - DIRECTORIES[k - 1]) if k < len(DIRECTORIES) else F.lit(0).cast("long")
        level[-1] = level[-1].withColumn(f"at{k}", up).withColumn(f"before{k - 1}", running(f"n{k - 1}", ["grp", f"at{k}"], f"at{k - 1}"))
        if k < len(DIRECTORIES):
            level.append(level[-1].groupBy("grp", f"at{k}").agg(F.sum(f"n{k - 1}").alias(f"n{k}")))
    last = len(DIRECTORIES) - 1
    top = level[-1].withColumn("base", F.col(f"before{last}")).withColumn("total", F.sum(f"n{last}").over(Window.partitionBy("grp")))
    for k in range(last - 1, -1, -1):
        up = top.select("grp", f"at{k + 1}", F.col("base").alias("base_up"), "total")
        top = level[k].join(up, ["grp", f"at{k + 1}"]).withColumn("base", F.col("base_up") + F.col(f"before{k}"))
    return top.select("grp", "at0", "bits", F.col("n0").alias("n"), "base", "total")


def with_rank(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of a row in its group by (key, leaf) from 0, and ``n``, the rows of the group.

    ``rows`` has (grp, key, leaf, uid).

    Words with more rows than bits hold a repeated id. Only their rows are counted further: by id and the first
    digits of the leaf, then inside those by leaf and salt, so that one id with a third of all rows, of unequal or
    equal leaves, is never ordered in one task.
    """
    index = stored(word_index(rows), "index")
    found = rows.withColumn("at0", F.shiftright("key", DIRECTORIES[0])).join(index, ["grp", "at0"])
    single = F.col("n") == F.bit_count("bits")
    plain = found.filter(single).withColumn("pos", F.col("base") + F.bit_count(F.col("bits").bitwiseAND(lower_bits())))
    tied = found.filter(~single)
    tied = tied.withColumn("digits", F.substring("leaf", 1, 4)).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
    word, group = ["grp", "at0"], ["grp", "at0", "key", "digits"]
    cell = [*group, "leaf", "salt"]
    cells = tied.groupBy(*cell).agg(F.count("*").alias("m"))
    ordered = Window.partitionBy(*group).orderBy("leaf", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before_cell", F.coalesce(F.sum("m").over(ordered), F.lit(0)))
    groups = cells.groupBy(*group).agg(F.sum("m").alias("m"))
    by_id = groups.groupBy(*word, "key").agg(F.sum("m").alias("m"))
    by_id = by_id.select(*word, "key", running("m", word, "key").alias("before_id"))
    groups = groups.select(*group, running("m", [*word, "key"], "digits").alias("before_group")).join(by_id, [*word, "key"])
    cells = cells.drop("m").join(groups, group)
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("uid")) - 1
    tied = tied.withColumn("inside", inside).join(cells, cell)
    tied = tied.withColumn("pos", F.col("base") + F.col("before_id") + F.col("before_group") + F.col("before_cell") + F.col("inside"))
    out = [*rows.columns, "pos", F.col("total").alias("n")]
    return plain.select(*out).unionByName(tied.select(*out))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: list[str], n: int, depth: int) -> list[list[str]]:
    """The nodes of each level of a block, the given ones first: to a single node if the n nodes of the group are one
    block, else ``depth`` times, where a single node is hashed on its own."""
    out = [nodes]
    while len(out[-1]) > 1 if n <= 1 << depth else len(out) <= depth:
        last = out[-1]
        out.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def _roots(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns = b.column("n").to_pylist()
            roots = [levels(b.column("nodes")[r].as_py(), n, depth)[-1][0] for r, n in enumerate(ns)]
            up = pa.array([-(-n >> depth) for n in ns], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("grp"), up, b.column("block"), pa.array(roots, pa.string())], names=["grp", "n", "pos", "node"])

    return run


def ways(nodes: list[str], n: int, depth: int, above: list[str]) -> list[list[str]]:
    """For each slot its siblings from the bottom up: ``L`` or ``R`` and the digest, ``-`` where it has none.

    ``above`` is the way of the block's root.
    """
    out = [above]
    for level in reversed(levels(nodes, n, depth)[:-1]):
        out = [["L" + level[i - 1] if i % 2 else "R" + level[i + 1] if i + 1 < len(level) else "-", *out[i // 2]] for i in range(len(level))]
    return out


def folded(node: str, way: list[str]) -> str:
    """The root that a node and its siblings give."""
    for step in way:
        node = digest(step[1:] + node if step[0] == "L" else node + step[1:] if step[0] == "R" else node)
    return node


def _ways(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                grp, n, block, nodes, above = (b.column(c)[r].as_py() for c in ("grp", "n", "block", "nodes", "way"))
                down = ways(nodes, n, depth, above)
                first = block << depth
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * len(down), pa.string()), pa.array(range(first, first + len(down)), pa.int64()), pa.array(down, pa.list_(pa.string()))],
                    names=["grp", "pos", "way"],
                )

    return run


def _proofs(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                n, nodes, above, changed, subroot, root = (b.column(c)[r].as_py() for c in ("n", "nodes", "way", "changed", "subroot", "root"))
                down = ways(nodes, n, depth, above)
                proof = [digest("".join(step[1:] for step in way)) for way in down]
                again = [folded(new or old, way) for old, new, way in zip(nodes, changed, down)]
                size = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[r].values, pa.array(nodes), pa.array([subroot] * size), pa.array([root] * size), pa.array(proof), pa.array(again), pa.array([x == root for x in again])],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return run


NODE = "grp string, n long, pos long, node string"
WAY = "grp string, pos long, way array<string>"


def in_blocks(nodes: DataFrame, depth: int, *more: str) -> DataFrame:
    """The nodes (grp, n, pos, node and more) in slot arrays of 2^depth: (grp, n, block, nodes, more)."""
    slots = F.array_sort(F.collect_list(F.struct("pos", "node", *more)))
    out = nodes.groupBy("grp", "n", F.shiftright("pos", depth).alias("block")).agg(slots.alias("slots"))
    return out.select("grp", "n", "block", F.col("slots.node").alias("nodes"), *[F.col(f"slots.{c}").alias(c) for c in more])


def reduced(blocks: DataFrame, depth: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks of each round, from the given one up, and the last nodes: one of each group."""
    rounds = [blocks]
    while True:
        nodes = stored(rounds[-1].select("grp", "n", "block", "nodes").mapInArrow(_roots(depth), NODE), name)
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds, nodes
        rounds.append(stored(in_blocks(nodes, depth), name))


def descended(rounds: list[DataFrame], top: DataFrame, depth: int, name: str) -> DataFrame:
    """The blocks of the first round with the way of their root, from that of each group's last node (grp, pos, way)."""
    for blocks in reversed(rounds[1:]):
        top = stored(blocks.join(top.select("grp", F.col("pos").alias("block"), "way"), ["grp", "block"]).select("grp", "n", "block", "nodes", "way").mapInArrow(_ways(depth), WAY), name)
    return rounds[0].join(top.select("grp", F.col("pos").alias("block"), "way"), ["grp", "block"])


def numbered(groups: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of a group in the order of ``grp``, from 0: ranges are counted, each is ordered apart."""
    dealt = stored(groups.repartitionByRange("grp").withColumn("range", F.spark_partition_id()), "groups")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("m"), F.lit(0).alias("all"))
    starts = sizes.select("range", running("m", ["all"], "range").alias("start"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("range").orderBy("grp")) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(starts), "range").withColumn("pos", F.col("start") + F.col("inside"))


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang",
    changed: Column | None = None, changed_leaf: dict[str, Column] | None = None, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): a row for each row of ``docs``.

    A leaf is the sha256 of the fields, ``-`` for null, else length, colon and value. The leaves of a group ascend by
    id, null ids last, rows that repeat an id by their leaf; equal rows take consecutive places. Every two consecutive
    nodes become the hash of their digests, a last odd one its own hash, until one remains, the subroot. The subroots,
    null group first and then by UTF-8 bytes, give the root likewise. ``proof_sha256`` is the hash of a leaf's siblings
    from the bottom up. Where ``changed`` holds, ``folded_root`` starts from the leaf of a row whose columns are replaced
    as ``changed_leaf`` says, elsewhere from the leaf itself; ``verified`` compares it with the root. Columns that are
    not fields are not read, whatever their names; an empty table gives no rows.
    """
    row = {f: F.col(f) for f in fields}
    new = leaf_hash(*[(changed_leaf or {}).get(f, row[f]) for f in fields])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit("")).alias("grp"), id_key(id_col).alias("key"), F.col(id_col).alias("id"),
        leaf_hash(*row.values()).alias("leaf"), F.when(F.lit(False) if changed is None else changed, new).alias("changed"),
    )
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "leaves")
    kind = rows.schema["id"].dataType.simpleString()
    placed = with_rank(rows).withColumnsRenamed({"leaf": "node", "id": "ids"})
    rounds, subroots = reduced(stored(in_blocks(placed, block_levels, "ids", "changed"), "slots"), block_levels, "nodes")
    groups = stored(numbered(subroots.select("grp", F.col("node").alias("subroot"))), "groups")
    over = groups.select(F.lit("").alias("grp"), F.lit(groups.count()).cast("long").alias("n"), "pos", F.col("subroot").alias("node"))
    tops, last = reduced(stored(in_blocks(over, block_levels), "top"), block_levels, "top")
    root = (last.select("node").first() or [None])[0]  # a single node
    none = last.select("grp", "pos", F.array().cast("array<string>").alias("way"))
    top = descended(tops, none, block_levels, "top").select("grp", "n", "block", "nodes", "way").mapInArrow(_ways(block_levels), WAY).select("pos", "way")
    top = groups.join(top, "pos").select("grp", F.lit(0).cast("long").alias("pos"), "subroot", "way")
    top = bounded(top, BROADCAST_GROUPS, "top")
    found = descended(rounds, top, block_levels, "ways").join(top.select("grp", "subroot"), "grp").withColumn("root", F.lit(root))
    out = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return found.select("n", "nodes", "ids", "changed", "way", "subroot", "root").mapInArrow(_proofs(block_levels), out)
