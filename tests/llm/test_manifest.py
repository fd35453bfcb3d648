import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
INF = 1 << 64


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, way of each node): the siblings of its runs from the bottom up, None where it has none."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            ways[i].append((p % 2, nodes[other] if other < len(nodes) else None))
            at[i] = p // 2
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return (nodes[0] if nodes else None), ways


def brute(rows):
    tampered = lambda r: r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (INF if r[0] is None else r[0], leaf(r))) for lang in langs]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, over = tree([t[0] for t in trees])
    out = []
    for g, (subroot, ways), top in zip(groups, trees, over):
        for r, way in zip(g, ways):
            node = leaf((*r[:3], r[3] + 1, r[4])) if tampered(r) else leaf(r)
            for odd, other in [*way, *top]:
                node = h(node) if other is None else h(other, node) if odd else h(node, other)
            out.append((r[0], leaf(r), subroot, root, h(*[s for _, s in [*way, *top] if s]), node, node == root))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA + ", node string, pos int").repartition(3)
    got = M.manifest(df, changed=changed, changed_leaf={"n_chars": F.col("n_chars") + 1}, **options)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def row(i, lang="en", text=None, n_chars=3):
    return (i, f"s{(i or 0) % 3}", lang, n_chars, text if text is not None else f"text {i} é")


MIXED = (
    [row(i * 37 - 400) for i in range(45)] + [row(i, None) for i in (1, 2, 3)] + [row(9, "solo")] + [row(i, "ж") for i in range(70)]
    + [row(5, "fr", f"t{i % 9}") for i in range(30)] + [row(None, "fr", f"n{i % 7}") for i in range(25)] + [row(1 << 40, "fr"), row(-(1 << 50), "fr"), row(6, "fr")]
    + [(14, None, "de", None, None), (14, None, "de", 5, ""), (14, None, "de", None, None), (63, "s", "de", 2, "x" * 100_000), (64, "s", "", 2, "")]
)


@pytest.mark.parametrize("depth", [12, 2, 1])
def test_against_brute_force(spark, depth):
    got = run(spark, MIXED, block_levels=depth)
    assert got == brute(MIXED) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_sizes(spark, n):
    rows = [row(i) for i in range(n)]
    assert run(spark, rows, block_levels=2) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_ranks(spark):
    """Places over all four directories, with repeated ids of equal and unequal leaves."""
    keys = [0, 63, 64, 65, 1 << 16, (1 << 16) + 5, 1 << 33, (1 << 48) + 1, -1, -(1 << 40), (1 << 63) - 1, 7, 7, 7]
    rows = [("g", k, "%064x" % (k % 977 + i // 13), i) for i, k in enumerate(keys)] + [("h", 7, "0" * 64, 100 + i) for i in range(50)]
    got = M.with_rank(spark.createDataFrame(rows, "grp string, key long, leaf string, uid long")).collect()
    for grp, n in (("g", 14), ("h", 50)):
        found = sorted((r["pos"], r["key"], r["leaf"]) for r in got if r["grp"] == grp)
        assert [p for p, _, _ in found] == list(range(n)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        assert {r["n"] for r in got if r["grp"] == grp} == {n}
