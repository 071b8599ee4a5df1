"""Most similar vectors by vantage-point trees.

Distances are Euclidean between vectors scaled to length one, so that cosine c is distance sqrt(2 - 2c) and the triangle
inequality holds. A node holds a vantage point and the median distance to it; a search within radius r enters the far side
only if the median is nearer to the query's distance than factor * r. With factor 1 nothing within r can be lost; smaller
factors prune more and lose some.

The top of the tree is fitted on a sample and decides shards: every vector is indexed in exactly one shard, and is
sent as a query to the shards that the relaxed rule leaves. Each shard builds its own tree over all its vectors. A pair
found from either end counts for both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import cut

SAMPLED = 16  # rows of the sample for each shard, at least
SLACK = 8  # candidates kept beyond k until exact similarities decide


@dataclass
class Tree:
    """A complete tree in heap order: children of node i are 2i + 1 and 2i + 2."""

    points: np.ndarray
    medians: np.ndarray
    depth: int
    members: list[np.ndarray] = field(default_factory=list)  # of each leaf


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * similarity, 0.0))


def grow(x: np.ndarray, depth: int, rng: np.random.Generator, tries: int = 8, looked_at: int = 512, reach: float = 0.0, band: float = 0.4) -> Tree:
    """A tree over the rows of x, of length one. Of `tries` candidates the point with the widest spread of distances becomes
    the vantage point; the median halves the node, ties included. With a reach, the border lies where fewest of the rows
    looked at are within reach of it, over all candidates and all quantiles from `band` to 1 - band: a node may get up to
    1 - band of its rows on one side, and fewer rows need both."""
    nodes = (1 << depth) - 1
    points, medians = np.zeros((nodes, x.shape[1]), np.float32), np.zeros(nodes, np.float32)
    level = [np.arange(len(x))]
    for _ in range(depth):
        lower = []
        for rows in level:
            i = len(lower) // 2 + len(level) - 1
            if not len(rows):
                medians[i] = -1.0
                lower += [rows, rows]
                continue
            some = x[rows if len(rows) <= looked_at else rng.choice(rows, looked_at, replace=False)]
            tried = x[rng.choice(rows, min(tries, len(rows)), replace=False)]
            if reach > 0:
                points[i], medians[i] = _border(some, tried, reach, band)
                far = _distance(x[rows] @ points[i]) >= medians[i]
                lower += [rows[~far], rows[far]]
                continue
            points[i] = tried[_distance(some @ tried.T).var(0).argmax()]
            d = _distance(x[rows] @ points[i])
            order = np.argpartition(d, len(rows) // 2)
            half = len(rows) // 2
            medians[i] = d[order[half]]
            lower += [rows[order[:half]], rows[order[half:]]]
        level = lower
    return Tree(points, medians, depth, level)


def _border(some: np.ndarray, tried: np.ndarray, reach: float, band: float) -> tuple[np.ndarray, float]:
    """The candidate and the distance to it within reach of which fewest rows lie."""
    d = np.sort(_distance(some @ tried.T), axis=0)
    at = np.unique(np.linspace(band * (len(d) - 1), (1 - band) * (len(d) - 1), 21).astype(int))
    best = (len(d) + 1, 0, 0.0)
    for c in range(d.shape[1]):
        borders = d[at, c]
        near = np.searchsorted(d[:, c], borders + reach, "right") - np.searchsorted(d[:, c], borders - reach, "left")
        k = int(near.argmin())
        best = min(best, (int(near[k]), c, float(borders[k])))
    return tried[best[1]], best[2]


def route(tree: Tree, x: np.ndarray, reach: float, visits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): for each row of x its own leaf, and the leaves within reach of a border; with `visits`, of these the so
    many, the own among them, whose borders are nearest in sum. Each level looks at the nodes reached and no others."""
    n = len(x)
    row, node, cost = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.float32)
    home = np.ones(n, bool)
    for _ in range(tree.depth):
        gap = np.empty(len(row), np.float32)
        for a in range(0, len(row), 65536):
            r = slice(a, a + 65536)
            gap[r] = _distance(np.einsum("ij,ij->i", x[row[r]], tree.points[node[r]])) - tree.medians[node[r]]
        right = gap >= 0
        far = np.abs(gap) <= reach
        child = 2 * node + 1 + right
        other = 2 * node + 2 - right
        row, node, home, cost = np.concatenate([row, row[far]]), np.concatenate([child, other[far]]), np.concatenate([home, np.zeros(far.sum(), bool)]), np.concatenate([cost, cost[far] + np.abs(gap[far])])
        if visits is not None:
            order = np.lexsort((cost, ~home, row))
            row, node, home, cost = row[order], node[order], home[order], cost[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < visits
            row, node, home, cost = row[keep], node[keep], home[keep], cost[keep]
    return row, node - ((1 << tree.depth) - 1), home


def search(tree: Tree, x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, radius: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k rows of x (-1: none) with the highest similarity within radius, best first not guaranteed, and the
    similarities. own: each query's own row in x, or -1."""
    n = len(q)
    least = np.float32(1.0 - radius * radius / 2.0 - 1e-6)
    best, at = np.full((n, k), -2.0, np.float32), np.full((n, k), -1, np.int64)
    floor = np.full(n, least, np.float32)

    def look(leaf: int, rows: np.ndarray) -> None:
        inside = tree.members[leaf]
        if not len(inside):
            return
        for a in range(0, len(rows), 4096):
            r = rows[a : a + 4096]
            s = q[r] @ x[inside].T
            s[own[r][:, None] == inside[None, :]] = -2.0
            hit = np.flatnonzero(s.max(1) >= floor[r])
            if not len(hit):
                continue
            h = r[hit]
            values = np.concatenate([best[h], s[hit]], 1)
            where = np.concatenate([at[h], np.broadcast_to(inside, (len(h), len(inside)))], 1)
            top = np.argpartition(-values, k - 1, 1)[:, :k] if values.shape[1] > k else np.broadcast_to(np.arange(k), (len(h), k))
            best[h], at[h] = np.take_along_axis(values, top, 1), np.take_along_axis(where, top, 1)
            floor[h] = np.maximum(least, best[h].min(1))

    first = np.zeros(n, np.int64)
    for level in range(tree.depth):  # every query's own leaf, for a first radius
        for node in range((1 << level) - 1, (1 << level + 1) - 1):
            rows = np.flatnonzero(first == node)
            if len(rows):
                first[rows] = 2 * node + 1 + (_distance(q[rows] @ tree.points[node]) >= tree.medians[node])
    first -= (1 << tree.depth) - 1
    for leaf in range(1 << tree.depth):
        look(leaf, np.flatnonzero(first == leaf))

    def visit(node: int, level: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if level == tree.depth:
            leaf = node - ((1 << tree.depth) - 1)
            look(leaf, rows[first[rows] != leaf])
            return
        gap = _distance(q[rows] @ tree.points[node]) - tree.medians[node]
        reach = factor * _distance(floor[rows])
        visit(2 * node + 1, level + 1, rows[gap <= reach])
        visit(2 * node + 2, level + 1, rows[gap >= -reach])

    visit(0, 0, np.arange(n))
    at[best < least] = -1
    return at, best


def _usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows that can be compared, and their vectors as given."""
    column = batch.column("vec")
    lengths = pc.list_value_length(column)
    ok = pc.fill_null(pc.equal(lengths, dim), False).to_numpy(zero_copy_only=False)
    kept = column.filter(pa.array(ok)).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.filter(pa.array(ok))
    x = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    norm = np.linalg.norm(x.astype(np.float64), axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return np.flatnonzero(ok)[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def nearest(
    vectors: DataFrame,
    key: str,
    vec: str,
    k: int = 10,
    min_similarity: float = 0.0,
    factor: float = 0.15,
    shard_factor: float | None = None,
    queries: Column | None = None,
    shard_rows: int = 32768,
    leaf_rows: int = 64,
    sample_rows: int = 20_000,
    visits: int | None = None,
    seed: int = 1,
) -> DataFrame:
    """(key, neighbour, similarity): for each vector the up to k others with the highest cosine of at least min_similarity;
    of equal cosines the smaller key comes first. queries: only rows for which it is true get neighbours (all rows are
    searched). key must be a whole number.

    Null, all-zero and non-finite vectors, and those of another length than most, take no part, however many keys carry them
    (a vector counts for at most k + 1 keys in the choice of the length). Rows with one key are one record (of different
    vectors that take part, the one with the least hash). A vector given under more than k + 1 keys is
    indexed under its k + 1 smallest; the others can have no nearer neighbour than those and get them, so that a group
    of copies, however large, costs its own size. The sample, of about sample_rows rows and at least SAMPLED for each shard,
    only decides where borders run; every row is indexed. An empty table gives no rows.

    Scale: what is shuffled is each vector once per shard it visits. A shard holds about shard_rows vectors. Borders run
    where few vectors are near; still, with each doubling of the shards a vector visits about 1.2 to 1.3 times as many.
    visits bounds the shards that a vector is sent to, those over the nearest borders first, for some recall; None is the
    rule of the factor alone.
    """
    shard_factor = factor if shard_factor is None else shard_factor
    radius = math.sqrt(max(2.0 - 2.0 * min_similarity, 0.0))
    flag = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec"), flag.alias("asks")).where("id IS NOT NULL AND vec IS NOT NULL")
    square = F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    hashed = rows.where((square > 0) & (square < math.inf)).withColumn("h", F.xxhash64("vec"))  # NaN is above all numbers here
    each = hashed.groupBy("h", F.size("vec").alias("dim")).agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("n"))
    common = each.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 0
    hashed = hashed.where(F.size("vec") == dim)
    ids = cut(hashed.groupBy("id").agg(F.min("h").alias("h"), F.max("h").alias("h2"), F.max("asks").alias("asks")))
    total, mixed = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("h") != F.col("h2")).cast("long")), F.lit(0))).first()
    shape = "id long, neighbour long, similarity double"
    if not total:
        return vectors.sparkSession.createDataFrame([], shape).withColumnRenamed("id", key)
    if mixed:  # ids with two vectors: the chosen one, by a join on the id
        hashed = hashed.join(ids.where("h <> h2").select("id", F.col("h").alias("kept")), "id", "left").where("kept IS NULL OR h = kept").drop("kept")
    crowd = ids.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h")
    crowded = None
    if not crowd.isEmpty():
        firsts = ids.join(crowd, "h").withColumn("place", F.row_number().over(W.partitionBy("h").orderBy("id"))).where(F.col("place") <= k + 1)
        firsts = cut(firsts.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("firsts"), F.max("id").alias("last")))
        held = hashed.join(firsts, "h", "left")
        crowded = held.where("asks AND id > last").select("id", "firsts").distinct()
        hashed = held.where("last IS NULL OR id <= last").select("id", "vec", "asks", "h")
    search_rows = hashed.select("id", "vec", "asks")

    # the sample that decides the borders
    depth = max(0, math.ceil(math.log2(max(1, total / shard_rows))))
    sample_rows = max(sample_rows, SAMPLED << depth)
    spread = max(1, total // sample_rows)
    sample = search_rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(spread)) == 0).select("vec").limit(2 * sample_rows).toArrow()
    if not sample.num_rows:
        sample = search_rows.select("vec").limit(sample_rows).toArrow()
    _, x = _usable(sample.combine_chunks().to_batches()[0], dim)
    reach = shard_factor * radius
    depth = depth if len(x) else 0
    top = grow(_unit(x), depth, np.random.default_rng(seed), 32, 2048, reach)
    top.members = []
    size = 1 << depth

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = _usable(batch, dim)
            if not len(at):
                continue
            ids_, asks = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("id", "asks"))
            row, leaf, home = route(top, _unit(raw), reach, visits)
            go = home | asks[row]
            row, leaf, home = row[go], leaf[go], home[go]
            data = pa.Array.from_buffers(pa.binary(4 * dim), len(row), [None, pa.py_buffer(np.ascontiguousarray(raw[row]).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(home), pa.array(asks[row]), pa.array(ids_[row]), data], names=["shard", "home", "asks", "id", "data"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        which = t.column("shard").to_numpy()
        home, asks, id_ = (t.column(c).to_numpy() for c in ("home", "asks", "id"))
        raw = np.frombuffer(b"".join(b for c in t.column("data").chunks for b in [_bytes(c)]), np.float32).reshape(-1, dim)
        for s in np.unique(which):
            mine = np.flatnonzero(which == s)
            _, keep = np.unique(id_[mine], return_index=True)  # repeated rows
            mine = mine[keep]
            inside = mine[home[mine]]
            if not len(inside):
                continue
            ask = mine[asks[mine]]
            x, q = _unit(raw[inside]), _unit(raw[ask])
            own = np.full(len(ask), -1, np.int64)
            spot = np.searchsorted(id_[inside], id_[ask])
            fits = spot < len(inside)
            fits[fits] = id_[inside][spot[fits]] == id_[ask][fits]
            own[fits] = spot[fits]
            tree = grow(x, max(0, math.ceil(math.log2(max(1, len(inside) / leaf_rows)))), np.random.default_rng(seed))
            at, _ = search(tree, x, q, own, k + SLACK, radius, factor)
            a, b = np.nonzero(at >= 0)
            if not len(a):
                continue
            one, two = ask[a], inside[at[a, b]]
            sim = np.empty(len(a))
            for lo in range(0, len(a), 65536):
                u, v = raw[one[lo : lo + 65536]].astype(np.float64), raw[two[lo : lo + 65536]].astype(np.float64)
                sim[lo : lo + 65536] = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
            fine = sim >= min_similarity
            one, two, sim = one[fine], two[fine], sim[fine]
            back = asks[two]
            ends = np.unique(np.stack([np.concatenate([id_[one], id_[two[back]]]), np.concatenate([id_[two], id_[one[back]]])], 1), axis=0, return_index=True)
            pairs, first = ends
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.concatenate([sim, sim[back]])[first])], names=["id", "neighbour", "similarity"])

    sent = search_rows.mapInArrow(send, "shard int, home boolean, asks boolean, id long, data binary")
    found = sent.repartitionById(size, "shard").mapInArrow(shard, shape)
    once = found.repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = once.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("place") <= k)
    result = best.select("id", "neighbour", "similarity")
    if crowded is not None:
        copies = crowded.select("id", F.explode(F.slice("firsts", 1, k)).alias("neighbour"), F.lit(1.0).alias("similarity"))
        result = result.union(copies)
    return result.withColumnRenamed("id", key)


def _bytes(column: pa.Array) -> bytes:
    """The bytes of a binary array without nulls, one after the other."""
    if not len(column):
        return b""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)
    a, b = offsets[column.offset], offsets[column.offset + len(column)]
    return column.buffers()[2][int(a) : int(b)].to_pybytes()
