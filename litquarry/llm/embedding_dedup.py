"""Embedding near-dedup by spherical-cap filters from structured random product codes.

A filter is a direction put together from one code word for each block of coordinates. A vector belongs to all filters
that it exceeds a threshold on; they are list-decoded block by block, without looking at the others. Vectors that share
a filter are verified. Very close vectors are one group first, by a leader that is within half of the angle of a link:
two such vectors are linked for certain, so that a group of any size needs no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litquarry.llm.common import giving_back, written
from litquarry.llm.components import connected_components
from litquarry.llm.fingerprints import dealt

#: Room for rounding where angles decide without a product of the two vectors, in radians.
SLACK = 1e-6
#: Groups of a filter that one task meets at a time; a filter with more is cut into blocks, and pairs of blocks meet.
BLOCK = 2048


class CapFilters:
    """Filters for ``count`` vectors of ``size`` coordinates: ``codes`` product codes, each in a random rotation of its own.

    The threshold is such that about ``shared`` of so many random vectors exceed it on a filter, and the number of
    filters of a code such that about ``each`` of them take a random vector. Where fewer than ``least`` filters of a
    code take a vector, for it lies far from their directions, the threshold is lowered for it until they do.
    """

    def __init__(self, size: int, count: int, *, shared: float = 4.0, each: float = 6.0, least: int = 3, codes: int = 3, blocks: int = 3, seed: int = 7):
        rng = np.random.default_rng(seed)
        blocks = min(blocks, size)
        cap = min(0.05, shared / max(count, 1))
        self.words = max(2, round((each / cap) ** (1 / blocks)))
        self.level = NormalDist().inv_cdf(1 - cap) / size**0.5 * blocks**0.5
        self.least = min(least, self.words**blocks)
        self.codes = []
        for _ in range(codes):
            turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
            words = []
            for own in np.array_split(np.arange(size), blocks):
                code = rng.standard_normal((self.words, len(own)))
                words.append(turn[:, own] @ (code / np.linalg.norm(code, axis=1, keepdims=True)).T)
            self.codes.append(words)

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the numbers of all filters that it exceeds, of all codes; the first is the one it exceeds most."""
        found: list[list[np.ndarray]] = [[] for _ in vectors]
        best = np.full(len(vectors), -np.inf)
        for k, words in enumerate(self.codes):
            scores = [vectors @ w for w in words]
            tops = np.stack([s.max(axis=1) for s in scores], axis=1)
            rest = np.concatenate([tops[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(vectors), 1))], axis=1)
            for i in range(len(vectors)):
                level = min(self.level, rest[i, 0] - 0.02)
                while True:
                    number, total = self._list([s[i] for s in scores], rest[i], level)
                    if len(number) >= self.least:
                        break
                    if level < -2 * len(words):  # a unit vector exceeds this on every filter
                        raise ValueError("a vector is not of unit length")
                    level -= 0.06
                order = np.argsort(-total, kind="stable")
                number = number[order] + k * self.words ** len(words)
                if total[order[0]] > best[i]:
                    best[i] = total[order[0]]
                    found[i].insert(0, number)
                else:
                    found[i].append(number)
        return [np.concatenate(x) for x in found]

    def _list(self, scores: list[np.ndarray], rest: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
        """Filters of one code that a vector exceeds ``level`` on: block by block, beginnings that can still reach it are kept."""
        number, sofar = np.zeros(1, np.int64), np.zeros(1)
        for b, s in enumerate(scores):
            need = level - rest[b + 1]
            some = np.flatnonzero(s >= need - sofar.max())
            total = sofar[:, None] + s[some]
            at, word = np.nonzero(total >= need)
            if not len(at):
                return np.zeros(0, np.int64), np.zeros(0)
            number, sofar = number[at] * self.words + some[word], total[at, word]
        return number, sofar


def _unit(rows) -> np.ndarray:
    """Unit vectors in double precision of a list column without nulls, all of one size.

    Components are brought near 1 first, by powers of two, so that no square is too large or too small for a double.
    """
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    flat = np.ldexp(flat, -np.frexp(np.abs(flat).max(axis=1, keepdims=True))[1])
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _by_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _decoded(vectors: DataFrame, counts: dict[int, int], **filters) -> DataFrame:
    """(id, size, filters) of usable vectors."""

    def decode(batches) -> Iterator:
        import pyarrow as pa

        made: dict[int, CapFilters] = {}
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            for at in _by_size(sizes):
                size = int(sizes[at[0]])
                if size not in made:
                    made[size] = CapFilters(size, counts[size], **filters)
                for k in range(0, len(at), 256):
                    part = batch.take(pa.array(at[k : k + 256]))
                    found = made[size].decode(_unit(part.column(2)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "size", "filters"])

    return vectors.select("id", "size", "vector").mapInArrow(giving_back(decode), "id long, size int, filters array<long>")


def _near(pairs: DataFrame, most: float) -> DataFrame:
    """(id, leader, angle) of pairs (id, leader, vector, leads) at an angle of ``most`` at most."""

    def near(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column(4).to_numpy(zero_copy_only=False)
            for at in _by_size(sizes):
                part = batch.take(pa.array(at))
                cosine = np.einsum("ij,ij->i", _unit(part.column(2)), _unit(part.column(3)))
                angle = np.arccos(np.clip(cosine, -1, 1))
                keep = pa.array(angle <= most)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(angle)], names=["id", "leader", "angle"]).filter(keep)

    return pairs.select("id", "leader", "vector", "leads", "size").mapInArrow(giving_back(near), "id long, leader long, angle double")


def _groups(vectors: DataFrame, decoded: DataFrame, link: float, rounds: int = 4) -> DataFrame:
    """(id, leader, angle): every usable vector with its leader, the smallest id of its group, at half a link's angle at most.

    In a round the vectors that have the same best filter and aren't placed yet meet the smallest one of them.
    """
    left = written(decoded.select("id", "size", F.get("filters", F.lit(0)).alias("best")).where("best IS NOT NULL").join(vectors.select("id", "vector"), "id"), "ungrouped")
    placed: DataFrame | None = None
    for _ in range(rounds):
        least = left.groupBy("size", "best").agg(F.min("id").alias("leader"), F.count("*").alias("n"))
        leads = least.where("n > 1").join(left.select(F.col("id").alias("leader"), F.col("vector").alias("leads")).dropDuplicates(["leader"]), "leader").drop("n")
        leads = written(leads, "leaders")
        if not leads.take(1):
            break
        near = written(_near(left.join(leads, ["size", "best"]), link / 2 - SLACK), "near")
        placed = near if placed is None else placed.unionByName(near)
        left = written(left.join(near.select("id"), "id", "left_anti"), "ungrouped")
    every = vectors.select("id")
    if placed is None:
        return every.select("id", F.col("id").alias("leader"), F.lit(0.0).alias("angle"))
    return every.join(placed.dropDuplicates(["id"]), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"), F.coalesce("angle", F.lit(0.0)).alias("angle"))


def _in_cells(taken: DataFrame, block: int = BLOCK) -> DataFrame:
    """(filter, leader): the groups of a filter with more than ``block`` of them are dealt to blocks, and each pair of blocks
    is a cell of its own, which stands as another filter. Two groups of one filter meet in one cell at least.
    """
    large = taken.groupBy("filter").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")
    n = F.coalesce("blocks", F.lit(1))
    dealt_ = taken.join(large, "filter", "left").withColumn("own", F.pmod(F.xxhash64("leader"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    cell = F.when(n == 1, F.col("filter")).otherwise(F.xxhash64("filter", F.least("own", "other"), F.greatest("own", "other")))
    return dealt_.select(cell.alias("filter"), "leader")


def _met(groups: DataFrame, link: float, cosine: float) -> DataFrame:
    """(a, b, sure) of groups that share a filter: all of their vectors link (sure), or some may.

    Rows are (filter, size, leader, radius, vector). Within a filter each group meets the ones after it.
    """

    def meet(batches) -> Iterator:
        import pyarrow as pa

        held = None
        source = iter(batches)
        while True:
            batch = next(source, None)
            table = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks() if batch is not None or held is not None else None
            if table is None:
                return
            filters = table.column("filter").to_numpy()
            end = len(filters) if batch is None else int(np.flatnonzero(filters != filters[-1])[-1]) + 1 if (filters != filters[-1]).any() else 0
            tail = table.slice(end).combine_chunks().to_batches()
            held = tail[0] if tail and batch is not None else None
            if end:
                yield from pairs_of(table.slice(0, end).combine_chunks(), pa)
            if batch is None:
                return

    def pairs_of(table, pa) -> Iterator:
        filters, sizes, leader, radius = (table.column(n).to_numpy() for n in ("filter", "size", "leader", "radius"))
        vectors = table.column("vector").combine_chunks()
        vectors = vectors.chunk(0) if hasattr(vectors, "chunk") else vectors
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            f, who, r, unit = filters[own], leader[own], radius[own], _unit(vectors.take(pa.array(own)))
            for k in range(1, len(own)):
                at = np.flatnonzero(f[k:] == f[:-k])
                if not len(at):
                    break
                for some in np.array_split(at, -(-len(at) // 65536)):
                    dot = np.einsum("ij,ij->i", unit[some], unit[some + k])
                    angle, reach = np.arccos(np.clip(dot, -1, 1)), r[some] + r[some + k]
                    sure = np.where(reach == 0, dot >= cosine, angle + reach <= link - SLACK)
                    keep = sure | ((reach > 0) & (angle - reach <= link + SLACK))
                    a, b = who[some][keep], who[some + k][keep]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure[keep])], names=["a", "b", "sure"])

    return dealt(groups, "filter", "leader").mapInArrow(giving_back(meet), "a long, b long, sure boolean")


def _counted(maybe: DataFrame, members: DataFrame, cosine: float, block: int = 512) -> DataFrame:
    """(id, other, n): for groups (a, b) that may link, how many vectors of the other one each vector links with."""

    def count(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b, ids, theirs, mine, others in zip(*batch.columns, strict=True):
                linked = _unit(mine.values) @ _unit(others.values).T >= cosine
                for who, other, n in ((ids, b, linked.sum(axis=1)), (theirs, a, linked.sum(axis=0))):
                    some = np.flatnonzero(n)
                    if len(some):
                        yield pa.RecordBatch.from_arrays([who.values.take(pa.array(some)), pa.array([other.as_py()] * len(some), pa.int64()), pa.array(n[some].astype(np.int64))], names=["id", "other", "n"])

    needed = members.join(maybe.select(F.col("a").alias("leader")).unionByName(maybe.select(F.col("b").alias("leader"))).distinct(), "leader", "left_semi")
    blocks = needed.withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / block))))
    blocks = written(blocks.groupBy("leader", "block").agg(F.collect_list(F.struct("id", "vector")).alias("x")).select("leader", "x.id", "x.vector"), "blocks")
    side = lambda key, ids, vectors: blocks.select(F.col("leader").alias(key), F.col("id").alias(ids), F.col("vector").alias(vectors))
    met = maybe.select("a", "b").join(side("a", "ids", "mine"), "a").join(side("b", "theirs", "others"), "b")
    return met.select("a", "b", "ids", "theirs", "mine", "others").mapInArrow(giving_back(count), "id long, other long, n long").groupBy("id", "other").agg(F.sum("n").alias("n"))


def embedding_links(table: DataFrame, *, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", **filters) -> DataFrame:
    """Per row: the id, ``n_links`` (other vectors at ``cosine`` or more, in double precision) and ``component_id``.

    A component is named by the smallest id that links reach. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, and so do vectors of another size and rows with a null id. Rows that
    repeat an id are each answered with the links of one of them, the smallest vector, as one vector: another one under
    the same id is not compared. Very large and very small components are as good as any. Other columns are ignored.
    Ids are integral. ``filters``: see ``CapFilters``.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    sound = F.col("id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    vectors = written(rows.where(sound).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector")), "vectors")
    counts = {r["size"]: r["n"] for r in vectors.groupBy("size").agg(F.count("*").alias("n")).collect()}
    link = acos(cosine)
    decoded = written(_decoded(vectors, counts, **filters), "filters")
    grouped = written(_groups(vectors, decoded, link), "groups")
    sizes = written(grouped.groupBy("leader").agg(F.count("*").alias("n"), F.max("angle").alias("radius")), "group-sizes")
    leads = sizes.join(vectors.select(F.col("id").alias("leader"), "size", "vector"), "leader")
    taken = decoded.select("id", F.explode("filters").alias("filter")).join(grouped.select("id", "leader"), "id").select("filter", "leader").distinct()
    met = _met(_in_cells(written(taken, "filter-groups")).join(leads, "leader").select("filter", "size", "leader", "radius", "vector"), link, cosine)
    pairs = written(met.groupBy("a", "b").agg(F.max("sure").alias("sure")), "group-pairs")

    sure = pairs.where("sure").select("a", "b")
    both = sure.unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole = both.join(sizes.select(F.col("leader").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("more"))
    maybe = pairs.where("NOT sure").select("a", "b")
    members = grouped.join(sizes, "leader").join(vectors.select("id", "vector"), "id").select("leader", "id", "n", "vector")
    parts = written(_counted(maybe, members, cosine), "partial-links")
    met_by_part = parts.join(grouped.select("id", "leader"), "id").select(F.col("leader").alias("a"), F.col("other").alias("b")).distinct()
    roots = connected_components(sure.unionByName(met_by_part))
    per_group = sizes.join(whole.withColumnRenamed("a", "leader"), "leader", "left").join(roots.withColumnRenamed("node", "leader"), "leader", "left")
    per_group = written(per_group.select("leader", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("more"), F.coalesce("root", "leader").alias("root")), "group-links")
    alone = parts.groupBy("id").agg(F.sum("n").alias("part"))
    found = grouped.join(per_group, "leader").join(alone, "id", "left").select("id", (F.col("more") + F.coalesce("part", F.lit(0))).alias("n_links"), "root")
    every = rows.select("id").join(found, "id", "left")
    return every.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
