"""Dense vectors: exact range pairs in blocks, hyperplane signatures, bucketed search, thresholds and density clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.components import components
from tallyloom.operators.records import numbered
from tallyloom.session import cut


def unit(vectors: DataFrame, key: str, vec: str, scaled: bool = True) -> DataFrame:
    """(id, v): one row per key with a vector of length one (scaled=False: as given, in single precision); null, empty and
    all-zero vectors are left out."""
    norm = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("norm", norm).where("norm > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v") if scaled else F.col("v").cast("array<float>").alias("v"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    c = t.column(column).combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _above(t: pa.Table, p: int, q: int, threshold: float, strict: bool) -> pa.Table:
    """(a, b, similarity), a < b: pairs of the parts p and q (column own) of t, or within p if they are one, above the threshold."""
    own = t.column("own").to_numpy()
    x, ids = _matrix(t, "v"), t.column("id").combine_chunks()
    one = np.flatnonzero(own == p)
    two = one if p == q else np.flatnonzero(own == q)
    left, right, sims = [], [], []
    for lo in range(0, len(one), 512):
        s = x[one[lo : lo + 512]] @ x[two].T
        i, j = np.nonzero(s > threshold if strict else s >= threshold)
        left.append(one[lo + i])
        right.append(two[j])
        sims.append(s[i, j])
    left, right, sims = (np.concatenate(z) if z else np.zeros(0, int) for z in (left, right, sims))
    a, b = ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))
    lower = pc.less(a, b)
    if p != q:
        a, b = pc.if_else(lower, a, b), pc.if_else(lower, b, a)
        keep = pc.not_equal(a, b)
    else:
        keep = lower
    return pa.table({"a": a, "b": b, "similarity": pa.array(sims, pa.float64())}).filter(keep)


def range_pairs(vectors: DataFrame, threshold: float, strict: bool = False, block: int = 4096) -> DataFrame:
    """(a, b, similarity) with a < b: all pairs of unit vectors (id, v) with a dot product of at least (strict: above) threshold.

    Exact, and so quadratic in the number of vectors: every block of about `block` vectors meets every other as a matrix
    product in a task of its own; only the pairs found leave a task."""
    n = vectors.count()
    blocks = max(1, -(-n // block))
    rows = vectors.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "v")
    kind = vectors.schema["id"].dataType.simpleString()

    def run(key: tuple, t: pa.Table) -> pa.Table:
        return _above(t, key[0].as_py(), key[1].as_py(), threshold, strict)

    return rows.groupBy("p", "q").applyInArrow(run, f"a {kind}, b {kind}, similarity double")


def sampled_threshold(vectors: DataFrame, pairs: int, quantile: float, seed: int = 42) -> float:
    """The quantile (linear) of the similarity of `pairs` random pairs of different vectors. Numbers of pairs are bounded by the
    parameter; vectors are numbered by hash order and met by two joins."""
    n = vectors.count()
    if n < 2:
        return 1.0
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, n, pairs), rng.integers(0, n - 1, pairs)
    j = j + (j >= i)
    drawn = vectors.sparkSession.createDataFrame(pd.DataFrame({"i": i, "j": j}))
    numbered = cut(numbered_by_hash(vectors, seed))
    both = drawn.join(numbered.select(F.col("k").alias("i"), F.col("v").alias("x")), "i").join(numbered.select(F.col("k").alias("j"), F.col("v").alias("y")), "j")
    return float(both.agg(F.percentile(dot("x", "y"), F.lit(quantile))).first()[0])


def numbered_by_hash(rows: DataFrame, seed: int = 42, key: str = "id", ranges: int = 4096) -> DataFrame:
    """rows with k from 0 on, in the order of a hash of the key, found from counts per range of the hash."""
    h = rows.withColumn("h", F.xxhash64(key, F.lit(seed))).withColumn("range", F.shiftright("h", 52))
    counts = h.groupBy("range").agg(F.count(F.lit(1)).alias("m"))
    before = counts.withColumn("before", F.sum("m").over(W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("m"))
    inside = F.row_number().over(W.partitionBy("range").orderBy("h", key)) - 1
    return h.withColumn("i", inside).join(F.broadcast(before.select("range", "before")), "range").withColumn("k", F.col("before") + F.col("i")).drop("h", "range", "i", "before")  # at most 4096 rows


def sample_by_hash(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same whatever the partitioning: those of least hash."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def planes(dim: int, bits: int, tables: int, seed: int = 42) -> list[np.ndarray]:
    """Hyperplanes of each table, all from one stream of random numbers."""
    rng = np.random.default_rng(seed)
    return [rng.standard_normal((bits, dim), dtype=np.float32) for _ in range(tables)]


def signatures(vectors: DataFrame, dim: int, bits: int = 16, tables: int = 4, seed: int = 42) -> DataFrame:
    """(id, table, signature): bit i of a signature says on which side of plane i the vector lies; up to 63 bits."""
    p = planes(dim, bits, tables, seed)
    kind = vectors.schema["id"].dataType.simpleString()
    power = (1 << np.arange(bits, dtype=np.int64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float32)
            for t, plane in enumerate(p):
                s = ((x @ plane.T) >= 0).astype(np.int64) @ power
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.full(len(x), t, np.int32)), pa.array(s)], names=["id", "table", "signature"])

    return vectors.select("id", "v").mapInArrow(run, f"id {kind}, table int, signature long")


def bucket_pairs(vectors: DataFrame, signs: DataFrame, threshold: float, top_k: int | None = None, split: int = 4096) -> DataFrame:
    """(a, b, similarity), a < b: pairs of unit vectors that share a bucket of some table and have at least the threshold; with top_k only
    those among the top_k of one of the two within a bucket. Buckets are met as matrix products; one larger than `split` in
    parts, each part with each other, by keys of their own."""
    sizes = signs.groupBy("table", "signature").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = signs.join(sizes, ["table", "signature"]).join(vectors, "id")
    rows = rows.withColumn("parts", F.ceil(F.col("n") / split).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("table", "signature", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "v")
    kind = vectors.schema["id"].dataType.simpleString()

    def run(key: tuple, t: pa.Table) -> pa.Table:
        table, _, p, q = (k.as_py() for k in key)
        found = _above(t, p, q, threshold, False)
        return found.add_column(0, "table", pa.array(np.full(found.num_rows, table, np.int32)))

    met = rows.groupBy("table", "signature", "p", "q").applyInArrow(run, f"table int, a {kind}, b {kind}, similarity double")
    if top_k:
        met = _best_of_each(met, top_k)
    return met.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _best_of_each(met: DataFrame, top_k: int) -> DataFrame:
    """Of pairs (table, a, b, similarity) those among the top_k of one of their ends in a table."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("one"), F.col("b").alias("two")), F.struct(F.col("b").alias("one"), F.col("a").alias("two")))).alias("e")
    w = W.partitionBy("table", "e.one").orderBy(F.desc("similarity"), "e.two")
    return met.select("table", "a", "b", "similarity", ends).withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_k)


def probed_pairs(vectors: DataFrame, signs: DataFrame, bits: int, threshold: float, top_k: int | None = None, block: int = 4096) -> DataFrame:
    """bucket_pairs that looks into the neighbouring buckets as well: pairs of at least the threshold whose signatures of some
    table differ in at most one of the `bits` bits; with top_k only those among the top_k of one of the two within a table.
    Vectors may have any length but zero, as single precision halves what is shuffled and loses nothing of single input.

    Such signatures agree in their upper or in their lower half, so every vector goes to two groups of each table, where
    buckets meet as matrix products. Groups larger than `block` are met in parts, each part with each other."""
    low = bits // 2
    kind = vectors.schema["id"].dataType.simpleString()
    upper, lower = F.shiftright("signature", low), F.col("signature").bitwiseAND((1 << low) - 1)
    halves = F.array(F.struct(F.lit(0).alias("half"), upper.alias("same"), lower.alias("rest")), F.struct(F.lit(1).alias("half"), lower.alias("same"), upper.alias("rest")))
    keyed = signs.select("id", "table", F.explode(halves).alias("h")).select("id", "table", "h.*")
    sizes = keyed.groupBy("table", "half", "same").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    rows = keyed.join(sizes, ["table", "half", "same"]).join(vectors, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("table", "half", "same", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rest", "id", "v")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        table, half, _, p, q = (k.as_py() for k in key)
        own, rest = t.column("own").to_numpy(), t.column("rest").to_numpy()
        x, ids = _matrix(t, "v").astype(np.float64), t.column("id").combine_chunks()
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        one = np.flatnonzero(own == p)
        two = one if p == q else np.flatnonzero(own == q)
        buckets = {int(r): two[rest[two] == r] for r in np.unique(rest[two])}
        left, right, sims = [], [], []
        for r in np.unique(rest[one]):
            near = [int(r) ^ (1 << i) for i in range(bits - low if half else low)]
            near = [n for n in near if n in buckets and (p != q or n > r)]  # within one part each two buckets meet once
            mine = one[rest[one] == r]
            for n in near if half else [int(r), *near]:
                for lo in range(0, len(mine) if n in buckets else 0, 512):
                    s = x[mine[lo : lo + 512]] @ x[buckets[n]].T
                    i, j = np.nonzero(s >= threshold)
                    left.append(mine[lo + i])
                    right.append(buckets[n][j])
                    sims.append(s[i, j])
        left, right, sims = (np.concatenate(z) if z else np.zeros(0, d) for z, d in ((left, int), (right, int), (sims, float)))
        once = (rest[left] != rest[right]) | (left < right) | (p != q)
        a, b = ids.take(pa.array(left[once], pa.int64())), ids.take(pa.array(right[once], pa.int64()))
        first = pc.less(a, b)
        return pa.table({"table": pa.array(np.full(len(a), table, np.int32)), "a": pc.if_else(first, a, b), "b": pc.if_else(first, b, a), "similarity": pa.array(sims[once], pa.float64())})

    met = rows.groupBy("table", "half", "same", "p", "q").applyInArrow(run, f"table int, a {kind}, b {kind}, similarity double")
    if top_k:
        met = _best_of_each(met, top_k)
    return met.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def hamming_pairs(vectors: DataFrame, signs: DataFrame, threshold: float, candidates: int, ids: Column | None = None, bits: int = 32, blocks: int = 4) -> DataFrame:
    """(query, id, similarity): for each query row the `candidates` rows of nearest signature (of one table) by differing bits,
    ties by id, rescored by cosine, of which those of at least the threshold stay.

    Different signatures are found through an index on `blocks` blocks of their bits: two that differ in fewer than
    blocks * (s + 1) bits differ in at most s bits of some block, so looking up each block with up to s bits turned finds
    them all. s grows from 0 for the signatures that don't have their candidates yet, and with s the width of a block all
    are found. Of rows with one signature at most candidates + 1, those of least id, can be among the nearest."""
    one = signs.where("table = 0").select("id", "signature")
    levels = cut(one.groupBy("signature").agg(F.count(F.lit(1)).alias("n")))
    asked = cut(one if ids is None else one.where(ids))
    left = cut(asked.select(F.col("signature").alias("s")).distinct())
    width = -(-bits // blocks)
    part = lambda c, j: F.shiftright(c, j * width).bitwiseAND((1 << width) - 1)
    spread = lambda c: F.explode(F.array(*[F.struct(F.lit(j).alias("block"), part(F.col(c), j).alias("at")) for j in range(blocks)])).alias("x")
    index = cut(levels.select("signature", "n", spread("signature")).select("x.block", "x.at", "signature", "n"))
    near = None
    for s in range(width + 1):
        turned = F.array(*[F.lit(m) for m in range(1 << width) if m.bit_count() <= s])
        probes = left.select("s", spread("s")).select("s", "x.block", F.explode(F.transform(turned, lambda m: F.col("x.at").bitwiseXOR(m.cast("long")))).alias("at"))
        met = probes.join(index, ["block", "at"]).select("s", "signature", "n").distinct().withColumn("d", F.bit_count(F.col("s").bitwiseXOR(F.col("signature"))))
        met = met if s == width else met.where(F.col("d") < blocks * (s + 1))
        w = W.partitionBy("s").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
        per = met.groupBy("s", "d").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
        reach = per.groupBy("s").agg(F.min(F.when(F.col("upto") > candidates, F.col("d"))).alias("r"), F.max("d").alias("all"))
        reach = reach.select("s", F.coalesce("r", "all") if s == width else F.col("r")).toDF("s", "r").where("r IS NOT NULL")
        found = cut(met.join(reach, "s").where(F.col("d") <= F.col("r")).select("s", "signature", "d"))
        near = found if near is None else near.union(found)
        left = cut(left.join(found.select("s").distinct(), "s", "left_anti"))
        if left.isEmpty():
            break
    least = one.withColumn("k", F.row_number().over(W.partitionBy("signature").orderBy("id"))).where(F.col("k") <= candidates + 1).drop("k")
    pairs = asked.select(F.col("id").alias("query"), F.col("signature").alias("s")).join(near, "s").join(least, "signature").where("id <> query")
    top = pairs.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy("d", "id"))).where(F.col("k") <= candidates)
    both = top.join(vectors, "id").join(vectors.select(F.col("id").alias("query"), F.col("v").alias("x")), "query")
    return both.select("query", "id", dot("x", "v").alias("similarity")).where(F.col("similarity") >= threshold)


def compare_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, left_similarity, right_similarity, side) of two sets of pairs: side is overlap, only_left or only_right."""
    both = left.select("a", "b", F.col("similarity").alias("left_similarity")).join(right.select("a", "b", F.col("similarity").alias("right_similarity")), ["a", "b"], "full")
    side = F.when(F.col("right_similarity").isNull(), "only_left").when(F.col("left_similarity").isNull(), "only_right").otherwise("overlap")
    return both.withColumn("side", side)


def recall_precision(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: true, found, common pairs, recall (1 if there is nothing to find) and precision (1 if nothing is found and
    nothing is there, 0 if nothing is found though something is)."""
    counts = compare_pairs(exact, found).agg(F.count_if(F.col("side") != "only_right").alias("n_true"), F.count_if(F.col("side") != "only_left").alias("n_found"), F.count_if(F.col("side") == "overlap").alias("n_common"))
    recall = F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("n_common") / F.col("n_true"))
    precision = F.when(F.col("n_found") > 0, F.col("n_common") / F.col("n_found")).when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    return counts.withColumn("recall", recall).withColumn("precision", precision)


def account_rollup(pairs: DataFrame, least: int = 1, digits: int = 6) -> DataFrame:
    """(author, cross_account_matches, max_similarity, avg_similarity): each pair (author_a, author_b, similarity) counts for both;
    the mean is that of similarities rounded to six digits. They are added as decimals and the mean is rounded once, to `digits`
    digits, half up, so it doesn't depend on the order of the pairs."""
    ends = pairs.select(F.explode(F.array("author_a", "author_b")).alias("author"), F.col("similarity").cast("decimal(18,6)").alias("s"))
    mean = F.round(F.sum("s") / F.count("s"), digits).cast("double")
    by = ends.groupBy("author").agg(F.count(F.lit(1)).alias("cross_account_matches"), F.max("s").cast("double").alias("max_similarity"), mean.alias("avg_similarity"))
    return by.where(F.col("cross_account_matches") >= least)


def density_clusters(ids: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """(id, label): density clusters from the pairs (a, b) within the radius. Points with at least min_samples neighbours, itself
    included, are cores; linked cores share a cluster; another point near a core joins the cluster of least label; the rest
    is noise, -1. Labels count clusters by their least core."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg((F.count(F.lit(1)) + 1).alias("n"))
    lonely = ids.select("id").join(degree, "id", "left").select("id", F.coalesce("n", F.lit(1)).alias("n"))
    cores = cut(lonely.where(F.col("n") >= min_samples).select("id"))
    core_pairs = pairs.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(cores.withColumnRenamed("id", "b"), "b", "left_semi")
    linked = components(core_pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("root"))
    roots = cores.join(linked, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    order = numbered(roots.select("root").distinct(), [F.col("root")]).select("root", (F.col("place") - 1).cast("int").alias("label"))
    labelled = cut(roots.join(order, "root").select("id", "label"))
    touch = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    border = touch.join(labelled.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
    return ids.select("id").join(labelled, "id", "left").join(border, "id", "left").select("id", F.coalesce("label", "near", F.lit(-1)).alias("label"))


def pooled_chunks(chunks: DataFrame) -> DataFrame:
    """(id, v): mean of the vectors (id, v) of a text's chunks, scaled to length one; null vectors count for nothing. One scan
    of the chunks in the order of their texts, which holds one sum."""
    kind = chunks.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, n = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("id"), b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            new = np.ones(len(ids), bool)
            if len(ids) > 1:
                new[1:] = ~pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            sums, counts = np.add.reduceat(x, starts), np.diff(np.append(starts, len(ids)))
            names = ids.take(pa.array(starts))
            if held is not None and names[0].equals(held[0]):
                sums[0] += total
                counts[0] += n
            elif held is not None:
                yield pa.RecordBatch.from_arrays([held, pa.array([list(total / n)], pa.list_(pa.float64()))], names=["id", "v"])
            if len(starts) > 1:
                yield pa.RecordBatch.from_arrays([names.slice(0, len(starts) - 1), pa.array(list(sums[:-1] / counts[:-1, None]), pa.list_(pa.float64()))], names=["id", "v"])
            held, total, n = names.slice(len(starts) - 1), sums[-1], int(counts[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([held, pa.array([list(total / n)], pa.list_(pa.float64()))], names=["id", "v"])

    rows = chunks.select("id", F.col("v").cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    return unit(rows.repartition("id").sortWithinPartitions("id").mapInArrow(run, f"id {kind}, v array<double>"), "id", "v")


def unique_texts(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """(text): the different non-null texts of two columns."""
    return pairs.select(F.col(a).alias("text")).union(pairs.select(F.col(b).alias("text"))).where("text IS NOT NULL").distinct()


def score_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (text_a, text_b, ...) with similarity, the product of the unit vectors (text, v) of both texts; pairs without either
    vector fall away. Each text has one vector, so a text in many pairs is joined, not encoded again."""
    side = lambda t, v: vectors.select(F.col("text").alias(t), F.col("v").alias(v))
    both = pairs.join(side("text_a", "x_"), "text_a").join(side("text_b", "y_"), "text_b")
    return both.withColumn("similarity", dot("x_", "y_")).drop("x_", "y_")


def embed(texts: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], size: int = 256) -> DataFrame:
    """texts with v, the encoder's vector of the text, in batches. The encoder is any function from texts to rows of numbers."""
    shape = ", ".join([*(f"`{c}` {t}" for c, t in texts.dtypes), "v array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, size):
                b = whole.slice(lo, size)
                x = np.asarray(encode([t or "" for t in b.column(text).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(x), pa.list_(pa.float32()))], names=[*b.schema.names, "v"])

    return texts.mapInArrow(run, shape)


def hashed_words(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in encoder for tests and machines without a model: signed hashes of words."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode
