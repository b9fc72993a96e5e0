"""Merkle manifest of a dataset: one root for all groups of rows, and a proof for every row.

Leaves are range-sorted by group and id into an RDD with one block a partition. Only partition counts reach the driver:
how many leaves the first and the last group of each partition have, from which every leaf gets its place in its group.
Each task builds the complete aligned subtrees of its own leaves. What stays open at a partition's ragged edges, a few
nodes a level, is shuffled by its coordinate and joined upwards; then the roots of the groups are leaves of a last tree.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import RDD, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from litquarry.llm.common import Workspace, shared_dir

#: Partitions, as a power of two, whose ragged nodes meet in one task: at most about forty nodes each.
TOGETHER = 10
#: Partitions that ragged nodes are dealt to at most: there are some hundred of them for each partition of leaves.
DEALT = 256
#: Group roots in one partition of the last tree.
ROOTS = 100_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """sha256 of the fields one after the other: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in shown]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the steps of ``proof`` lead to: l and r say on which side the sibling stands, - that there is none."""
    sibling = lambda step: F.substr(step, F.lit(2))
    both = lambda node, step: F.when(F.left(step, F.lit(1)) == "l", F.concat(sibling(step), node)).otherwise(F.concat(node, sibling(step)))
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(both(node, step), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof one after the other."""
    return F.array_join(F.transform(proof, lambda step: F.substr(step, F.lit(2))), "")


@dataclass
class Block:
    """The leaves of one partition in order: (group, count) of each group, and of each leaf its digest and the row to carry."""

    number: int
    groups: list[tuple]
    leaves: list[str]
    rows: list[tuple]


def _blocks(sorted_rows: RDD) -> RDD:
    """One block of each partition of (group, leaf, row), which are sorted by group."""

    def block(number: int, rows: Iterator) -> Iterator[Block]:
        found = Block(number, [], [], [])
        for group, leaf, row in rows:
            if found.groups and found.groups[-1][0] == group:
                found.groups[-1] = (group, found.groups[-1][1] + 1)
            else:
                found.groups.append((group, 1))
            found.leaves.append(leaf)
            found.rows.append(row)
        yield found

    blocks = sorted_rows.mapPartitionsWithIndex(block)
    blocks.checkpoint()
    return blocks


def _width(total: int, level: int) -> int:
    return -(-total >> level)


@dataclass
class Segment:
    """Leaves of one group in one partition, from place ``start`` of ``total``, with the nodes above them that need no other leaf."""

    group: tuple
    start: int
    total: int
    at: int
    levels: list[tuple[int, list[str]]]
    ragged: list[tuple[int, int, str]]
    top: str | None


def _segments(block: Block, layout: list[tuple[int, int, int]]) -> Iterator[Segment]:
    before, total_first, total_last = layout[block.number]
    at = 0
    for k, (group, count) in enumerate(block.groups):
        start = before if k == 0 else 0
        total = total_first if k == 0 else total_last if k == len(block.groups) - 1 else count
        first, nodes = start, block.leaves[at : at + count]
        levels, ragged, top = [(first, nodes)], [], None
        while nodes:
            level, width = len(levels) - 1, _width(total, len(levels) - 1)
            if width == 1:
                top = nodes[0]
                break
            end = first + len(nodes)
            if first % 2:
                ragged.append((level, first, nodes[0]))
            if end % 2 and end < width and end - 1 >= first:
                ragged.append((level, end - 1, nodes[-1]))
            low, high = first + first % 2, end if end == width else end - end % 2
            nodes = [digest("".join(nodes[i - first : min(i + 2, high) - first])) for i in range(low, high, 2)]
            first = low // 2
            if nodes:
                levels.append((first, nodes))
        yield Segment(group, start, total, at, levels, ragged, top)
        at += count


def _layout(blocks: RDD) -> tuple[list[tuple[int, int, int]], dict]:
    """For each partition: leaves of its first group in partitions before, and totals of its first and last group; and all these totals.

    A few numbers a partition come to the driver. Groups within one partition are counted there.
    """
    summary = lambda b: (b.number, b.groups[0], b.groups[-1], len(b.groups))
    found = sorted(blocks.filter(lambda b: b.groups).map(summary).collect())
    totals: dict = defaultdict(int)
    before = {}
    for number, first, last, groups in found:
        before[number] = totals[first[0]]
        totals[first[0]] += first[1]
        if groups > 1:
            totals[last[0]] += last[1]
    layout = [(0, 0, 0)] * blocks.getNumPartitions()
    for number, first, last, _ in found:
        layout[number] = (before[number], totals[first[0]], totals[last[0]])
    return layout, dict(totals)


def _climb(nodes: list[tuple[int, int, str]], total: int, most: int) -> Iterator[tuple]:
    """Join nodes upwards to level ``most`` or their tree's top: (level, index, steps, (level, index, digest) above) of each."""
    levels: dict[int, dict[int, str]] = defaultdict(dict)
    for level, index, node in nodes:
        levels[level][index] = node
    step: dict[tuple[int, int], str] = {}
    for level in range(min(levels), most):
        width = _width(total, level)
        if width == 1:
            break
        for index, node in levels[level].items():
            if index ^ 1 >= width:
                step[level, index] = "-"
                levels[level + 1][index // 2] = digest(node)
            else:
                other = levels[level][index ^ 1]
                step[level, index] = ("l" if index % 2 else "r") + other
                if index % 2:
                    levels[level + 1][index // 2] = digest(other + node)
    for level, index, _ in nodes:
        steps, at, place = [], level, index
        while (at, place) in step:
            steps.append(step[at, place])
            at, place = at + 1, place // 2
        yield level, index, steps, (at, place, levels[at][place])


def _finish(ragged: RDD, totals: dict, leaves_each: int, sc: SparkContext) -> tuple[RDD, RDD]:
    """From (group, level, index, digest): ((group, level, index), steps to the group's root), and (group, root).

    Rounds deal nodes by the block of leaves that they are over. A block is over about a thousand partitions at first,
    and a thousand times as many each round, so that a task meets a bounded number of nodes however large a group is.
    """
    known = sc.broadcast(totals)
    highest = max(totals.values(), default=1).bit_length()
    shift = min(highest, max(1, leaves_each).bit_length() + TOGETHER)
    parts = max(1, min(DEALT, ragged.getNumPartitions()))
    paths = None
    nodes = ragged.map(lambda x: (x[0], x[1:]))
    while True:

        def climbed(item, shift=shift) -> Iterator[tuple]:
            (group, _), held = item
            yield from ((group, *x) for x in _climb(list(held), known.value[group], shift))

        high = nodes.filter(lambda x, shift=shift: x[1][0] >= shift).map(lambda x: (x[0], x[1][0], x[1][1], [], x[1]))
        low = nodes.filter(lambda x, shift=shift: x[1][0] < shift).map(lambda x, shift=shift: ((x[0], x[1][1] << x[1][0] >> shift), x[1]))
        done = low.groupByKey(parts).flatMap(climbed).union(high).coalesce(parts)
        done.checkpoint()
        over = done.map(lambda x: ((x[0], x[4][0], x[4][1]), x[4][2])).reduceByKey(lambda a, b: a, parts)
        if paths is None:
            paths = done.map(lambda x: ((x[0], x[4][0], x[4][1]), ((x[0], x[1], x[2]), x[3])))
        else:
            above = done.map(lambda x: ((x[0], x[1], x[2]), (x[3], (x[0], x[4][0], x[4][1]))))
            paths = paths.join(above, parts).map(lambda x: (x[1][1][1], (x[1][0][0], x[1][0][1] + x[1][1][0])))
        if shift >= highest:
            return paths.values(), over.map(lambda x: (x[0][0], x[1]))
        nodes = over.map(lambda x: (x[0][0], (x[0][1], x[0][2], x[1])))
        shift = min(highest, shift + TOGETHER)


def _tree(blocks: RDD, sc: SparkContext) -> tuple[RDD, RDD, RDD, list]:
    """(group, root) of each group; (partition, group, level, index, steps) of open nodes; (group, partition) that meet; the layout."""
    layout, totals = _layout(blocks)
    placed = sc.broadcast(layout)
    segments = blocks.flatMap(lambda b: [(b.number, s.group, s.ragged, s.top) for s in _segments(b, placed.value)])
    segments.checkpoint()
    spread = segments.filter(lambda s: s[3] is None)
    owner = spread.flatMap(lambda s: [((s[1], level, index), s[0]) for level, index, _ in s[2]])
    ragged = spread.flatMap(lambda s: [(s[1], level, index, node) for level, index, node in s[2]])
    paths, tops = _finish(ragged, totals, sum(totals.values()) // max(1, len(layout)), sc)
    edges = owner.join(paths, max(1, min(DEALT, blocks.getNumPartitions()))).map(lambda x: (x[1][0], (*x[0], x[1][1])))
    roots = segments.filter(lambda s: s[3] is not None).map(lambda s: (s[1], s[3])).union(tops)
    return roots, edges, segments.map(lambda s: (s[1], s[0])), layout


def _proofs(blocks: RDD, edges: RDD, above: RDD, layout: list, sc: SparkContext) -> RDD:
    """(row, group, place, steps, root of the group) of each leaf; ``above`` is (partition, (group, (root, steps above it)))."""
    placed = sc.broadcast(layout)

    def proven(item) -> Iterator[tuple]:
        _, (held, told) = item
        told = list(told)
        path = {x[:3]: x[3] for is_edge, x in told if is_edge}
        top = dict(x for is_edge, x in told if not is_edge)
        for block in held:
            for s in _segments(block, placed.value):
                root, last = top[s.group]
                for k, row in enumerate(block.rows[s.at : s.at + len(s.levels[0][1])]):
                    steps, index = [], s.start + k
                    for level in range(s.total.bit_length() + 1):
                        width = _width(s.total, level)
                        if width == 1:
                            break
                        first, nodes = s.levels[level]
                        if index ^ 1 >= width:
                            steps.append("-")
                        elif 0 <= (index ^ 1) - first < len(nodes):
                            steps.append(("l" if index % 2 else "r") + nodes[(index ^ 1) - first])
                        else:
                            steps += path[s.group, level, index]
                            break
                        index //= 2
                    yield row, s.group, s.start + k, steps + last, root

    routed = edges.mapValues(lambda x: (True, x)).union(above.mapValues(lambda x: (False, x)))
    return blocks.map(lambda b: (b.number, b)).cogroup(routed, max(1, blocks.getNumPartitions())).flatMap(proven)


@dataclass
class Manifest:
    """``root`` (none for an empty table), ``roots`` (group, subroot) and ``proofs``: the carried columns, place, subroot and proof of each row."""

    root: str | None
    roots: DataFrame
    proofs: DataFrame


def merkle_manifest(leaves: DataFrame, *, group_col: str, id_col: str, leaf_col: str) -> Manifest:
    """The manifest of ``leaves``, whose columns are all carried: the group (a string), the id and a digest as 64 hex digits.

    Groups are in order of their UTF-8 bytes, null first, and so are the leaves of each by id, null first; those of one
    id by digest. Every two nodes in a row, and a last single one, become the sha256 of their digits, until one is left;
    the roots of the groups are joined likewise. A proof lists its steps upwards: ``r`` or ``l`` and the sibling on that
    side, or ``-`` where there is none. Rows that repeat are leaves each, and are dealt out by a number of their own, so
    that copies of one row don't meet in one partition. An empty table has no root and no proofs.
    """
    spark = leaves.sparkSession
    sc = spark.sparkContext
    shared_dir(spark)
    work = Workspace(spark, "merkle")
    kept = work.written(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    order = [group_col, id_col, leaf_col, "_row"]
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    schema, at, leaf_at = leaves.schema, leaves.columns.index(group_col), leaves.columns.index(leaf_col)
    key = lambda g: (g is not None, (g or "").encode())
    blocks = _blocks(ordered.select(*leaves.columns).rdd.map(lambda r: (key(r[at]), r[leaf_at], tuple(r))))
    roots, edges, meets, layout = _tree(blocks, sc)
    roots.checkpoint()
    sizes = roots.count() // ROOTS + 1
    high = _blocks(roots.sortByKey(numPartitions=sizes).map(lambda x: ((), x[1], x)))
    top, high_edges, high_meets, high_layout = _tree(high, sc)
    root = top.values().take(1)
    found = _proofs(high, high_edges, high_meets.map(lambda x: (x[1], (x[0], ("", [])))), high_layout, sc)
    over = found.map(lambda x: (x[0][0], (x[0][1], x[3])))
    above = meets.join(over, max(1, min(DEALT, blocks.getNumPartitions()))).map(lambda x: (x[1][0], (x[0], x[1][1])))
    proofs = _proofs(blocks, edges, above, layout, sc).map(lambda x: (*x[0], x[2], x[4], x[3]))
    with_proof = StructType([*schema.fields]).add("place", LongType()).add("subroot", StringType()).add("proof", ArrayType(StringType()))
    name = lambda k: k[1].decode() if k[0] else None
    return Manifest(
        root[0] if root else None, spark.createDataFrame(roots.map(lambda x: (name(x[0]), x[1])), StructType().add(group_col, StringType()).add("subroot", StringType())),
        spark.createDataFrame(proofs, with_proof, verifySchema=False),
    )
