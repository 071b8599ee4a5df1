"""Near-duplicate texts: universal hash minima with banding, signature check, exact check, star-step components.

Texts of equal words form a class, and only one member of a class is hashed and compared. A class's word shingles are
hashed to 32 bits; `bands` x `rows` universal hash functions (a x + b modulo 2^32, a odd) give its minima. Two classes are
candidates if all minima of a band agree; 64 four-bit pieces of minima estimate the similarity of a candidate pair, and
those near the threshold or above are decided by the shingle sets themselves.

A pair of similarity s is a candidate with probability 1 - (1 - s^rows)^bands: for 5 and 90 that is 0.94 at 0.5, 0.99 at
0.55, 0.999 at 0.6 and above 0.99999 from 0.7 on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.components import components
from tallyloom.session import cut

WORD = re.compile(r"[^\W_]+")
PIECES = 64  # four-bit pieces of a signature
RUN = 256  # a bucket of at most so many classes is paired as it is, a larger one is divided by further minima
THREE = PIECES // 3  # groups of three pieces that divide a large bucket
FEW = 1_000_000  # so many numbers may be broadcast


class _Hashes(dict):
    """A word's hash; it forgets all when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list[str], words: int, least: int, cache: _Hashes) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Of the texts with at least `least` words: their positions, a hash of their words, the number of distinct shingles of
    each, and all these shingles' hashes, one text after the other, sorted within a text."""
    at, names, sizes, flat = [], [], [], []
    for i, t in enumerate(texts):
        if t is None:
            continue
        w = WORD.findall(t.lower())
        if len(w) >= least:
            at.append(i)
            sizes.append(len(w))
            flat += w
            names.append(xxhash.xxh3_64_intdigest(" ".join(w)))
    if not at:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.uint32)
    h = np.fromiter(map(cache.__getitem__, flat), np.uint64, len(flat))
    size = np.array(sizes)
    owner = np.repeat(np.arange(len(size)), size)
    n = len(h) - words + 1
    spins = np.random.default_rng(3).integers(0, 1 << 62, words, np.uint64) * np.uint64(2) + np.uint64(1)
    x = np.zeros(max(n, 0), np.uint64)
    for j in range(words):
        x += h[j : j + n] * spins[j]
    inside = owner[:n] == owner[words - 1 :]
    x = _mixed(x[inside]) >> np.uint64(32)
    key = np.unique((owner[:n][inside].astype(np.uint64) << np.uint64(32)) | x)
    return np.array(at), names, np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(size)), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def minima(x: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 2048) -> np.ndarray:
    """The least value of each function over each text's shingles; texts lie one after the other in x, none is empty."""
    out = np.empty((len(sizes), len(a)), np.uint32)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        start = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, start + block, "right")))
        if ends[j - 1] - start <= 4 * block:
            h = x[start : ends[j - 1], None] * a
            h += b
            np.minimum.reduceat(h, ends[i:j] - sizes[i:j] - start, axis=0, out=out[i:j])
        else:  # one long text
            out[i] = np.iinfo(np.uint32).max
            for s in range(start, ends[i], block):
                np.minimum(out[i], (x[s : min(s + block, ends[i]), None] * a + b).min(0), out=out[i])
        i = j
    return out


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _read(texts: DataFrame, words: int, least: int, seed: int) -> DataFrame:
    """(name, class, idx, grams, pieces): one row per text that takes part; grams and pieces only at the first member of a
    class in each partition, which idx numbers."""
    a, b = functions(PIECES, seed + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = _Hashes(), set()
        idx = TaskContext.get().partitionId() << 33
        for whole in batches:
            lengths = pc.fill_null(pc.utf8_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(lengths) // 2_000_000  # about two million characters at a time
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(lengths)]
            for lo, hi in zip(cuts, cuts[1:]):
                batch = whole.slice(lo, hi - lo)
                at, names, sizes, x = shingles(batch.column(1).to_pylist(), words, least, cache)
                if not len(at):
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                fresh = np.zeros(len(at), bool)
                for i, c in enumerate(names):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                ends = np.cumsum(sizes)
                least_of = minima(x[np.repeat(fresh, sizes)], sizes[fresh], a, b) if fresh.any() else np.zeros((0, PIECES), np.uint32)
                bits = (least_of >> np.uint32(14)).astype(np.uint8) & 15
                packed = bits[:, ::2] | bits[:, 1::2] << 4
                rank = np.cumsum(fresh) - 1
                grams = [x[ends[i] - sizes[i] : ends[i]].tobytes() if f else None for i, f in enumerate(fresh)]
                pieces = [packed[rank[i]].tobytes() if f else None for i, f in enumerate(fresh)]
                number = pa.array(idx + rank, mask=~fresh)
                idx += int(fresh.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.array(names, np.uint64).view(np.int64)), number, _binary(grams), _binary(pieces)], names=["name", "class", "idx", "grams", "pieces"])

    return texts.mapInArrow(run, "name string, class long, idx long, grams binary, pieces binary")


def _candidates(hashed: DataFrame, count: int, bands: int, rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (i, j) with i < j, and the members (bucket, idx, place, n) of buckets too large for one task."""
    a, b = functions(bands * rows, seed)
    spins = np.random.default_rng(seed + 2).integers(0, 1 << 62, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
    salt = np.random.default_rng(seed + 3).integers(0, 1 << 63, bands, np.uint64)
    size = max(1, -(-count * bands * 8 // (24 << 20)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 20_000):
                batch = whole.slice(lo, 20_000)
                idx = batch.column("idx").to_numpy()
                grams = batch.column("grams").to_pylist()
                sizes = np.fromiter(map(len, grams), np.int64, len(grams)) // 4
                low = minima(np.frombuffer(b"".join(grams), np.uint32), sizes, a, b).reshape(len(idx), bands, rows)
                h = np.broadcast_to(salt, (len(idx), bands)).copy()
                for r in range(rows):
                    h += low[:, :, r] * spins[:, r]
                h = _mixed(h).ravel()
                where = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int32)
                order = np.argsort(where, kind="stable")
                key, doc = (h >> np.uint64(32)).astype(np.uint32)[order], (np.arange(len(h)) // bands)[order]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=size))])
                # a row for each task: the documents as steps from one to the next, and the hashes
                base, offset = int(idx[0]), idx - idx[0]
                out = [[], [], [], []]
                for p in np.flatnonzero(np.diff(cuts)):
                    d = offset[doc[cuts[p] : cuts[p + 1]]]
                    out[0].append(int(p))
                    out[1].append(base)
                    out[2].append(np.diff(d, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())
                    out[3].append(key[cuts[p] : cuts[p + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), _binary(out[2]), _binary(out[3])], names=["p", "base", "steps", "keys"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, here = [], [], 0
        for batch in batches:
            for p, base, steps, k in zip(*(batch.column(c).to_pylist() for c in ("p", "base", "steps", "keys"))):
                here = p
                keys.append(np.frombuffer(k, np.uint32))
                step = np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                docs.append(np.cumsum(step.astype(np.int64)) + base)
        if not keys:
            return
        key, doc = np.concatenate(keys), np.concatenate(docs)
        del keys, docs
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(starts, len(key)))
        pairs = []
        for n in np.unique(length[(length > 1) & (length <= RUN)]):
            at = starts[length == n][:, None]
            i, j = np.triu_indices(n, 1)
            for lo in range(0, len(at), max(1, 2_000_000 // len(i))):
                part = at[lo : lo + max(1, 2_000_000 // len(i))]
                u, v = doc[part + i].ravel(), doc[part + j].ravel()
                pairs.append(np.stack([np.minimum(u, v), np.maximum(u, v)], 1)[u != v])
        if pairs:
            u = np.concatenate(pairs)
            u = u[np.lexsort((u[:, 1], u[:, 0]))]
            u = u[np.concatenate([[True], (u[1:] != u[:-1]).any(1)])] if len(u) else u
            yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64())], names=["i", "j", "place", "n"])
        for s in np.flatnonzero(length > RUN):
            d = np.unique(doc[starts[s] : starts[s] + length[s]])
            name = (here << 32) | int(key[starts[s]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), name)), pa.array(d), pa.array(np.arange(len(d))), pa.array(np.full(len(d), len(d)))], names=["i", "j", "place", "n"])

    sent = hashed.select("idx", "grams").mapInArrow(spread, "p int, base long, steps binary, keys binary").repartitionById(size, "p")
    met = cut(sent.mapInArrow(meet, "i long, j long, place long, n long"))
    return met.where("place IS NULL").select("i", "j").distinct(), met.where("place IS NOT NULL").select(F.col("i").alias("bucket"), F.col("j").alias("idx"), "place", "n")


def _agreeing(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Equal four-bit pieces in two packed signatures, over the last axis."""
    x = p ^ q
    return ((x & 15) == 0).sum(-1) + ((x >> 4) == 0).sum(-1)


def _least_agreeing(threshold: float) -> int:
    """Pieces that agree at the threshold, less 3.5 standard deviations."""
    p = threshold + (1 - threshold) / 16
    return int(PIECES * p - 3.5 * (PIECES * p * (1 - p)) ** 0.5)


def _divided(crowded: DataFrame, pieces: DataFrame, least: int) -> DataFrame:
    """Pairs (i, j) of like signature within the large buckets. Members of such a bucket are met where three further minima agree
    as well, in any of THREE groups of pieces: of pairs of similarity 0.5 that share the bucket 0.966 do, of 0.6 0.997, and
    most share other buckets, too. So a bucket's cost is THREE times its members and the pairs that agree in eight minima; a
    group that is still larger than RUN is cut into parts that meet by keys of their own."""
    rows = crowded.join(pieces, "idx")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                s = _nibbles(b.column("pieces"))
                at = np.tile(np.arange(THREE, dtype=np.int32), b.num_rows)
                three = s[:, : 3 * THREE].reshape(-1, 3).astype(np.int32)
                value = three[:, 0] << 8 | three[:, 1] << 4 | three[:, 2]
                row = pa.array(np.repeat(np.arange(b.num_rows), THREE))
                yield pa.RecordBatch.from_arrays([b.column("bucket").take(row), pa.array(at << 12 | value), b.column("idx").take(row), b.column("pieces").take(row)], names=["bucket", "part", "idx", "pieces"])

    each = rows.select("bucket", "idx", "pieces").mapInArrow(spread, "bucket long, part int, idx long, pieces binary")
    sizes = each.groupBy("bucket", "part").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("n"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    each = each.join(sizes, ["bucket", "part"]).withColumn("own", F.pmod(F.xxhash64("idx"), F.col("n")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = F.xxhash64("bucket", "part", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    keyed = each.select(key, F.shiftright("part", 12).alias("at"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "idx", "pieces")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            k = t.column("key").to_numpy()
            if not len(k):
                continue
            last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
            held = t.slice(last).combine_chunks().to_batches()[0]
            if last:
                yield from pairs(t.slice(0, last))
        if held is not None:
            yield from pairs(pa.Table.from_batches([held]))

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k, at, p, q, own, idx = (t.column(c).to_numpy() for c in ("key", "at", "p", "q", "own", "idx"))
        s = _nibbles(t.column("pieces").combine_chunks())
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        for a, n in zip(starts, np.diff(np.append(starts, len(k)))):
            if n < 2:
                continue
            i, j = np.triu_indices(n, 1)
            i, j = i + a, j + a
            if p[a] != q[a]:
                cross = own[i] != own[j]
                i, j = i[cross], j[cross]
            for lo in range(0, len(i), 200_000):
                u, v = i[lo : lo + 200_000], j[lo : lo + 200_000]
                same = s[u] == s[v]
                good = (same.sum(1) >= least) & (idx[u] != idx[v])
                if at[a]:  # a pair belongs to the first group of pieces in which it agrees
                    good &= ~same[:, : 3 * at[a]].reshape(len(u), -1, 3).all(2).any(1)
                u, v = idx[u[good]], idx[v[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["i", "j"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "i long, j long").distinct()


def _nibbles(packed: pa.Array) -> np.ndarray:
    """The four-bit pieces of packed signatures, one row each."""
    b = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    out = np.empty((len(b), 2 * b.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = b & 15, b >> 4
    return out


def _only(df: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """Rows of df whose idx is in ids: by broadcast if these are few, else by a shuffled join."""
    return df.join(F.broadcast(ids) if count <= FEW else ids, "idx", "left_semi")


def near_copies(texts: DataFrame, name: str, text: str, threshold: float = 0.8, words: int = 5, least_words: int = 10, bands: int = 90, rows: int = 5, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: (class_1, class_2, similarity), pairs of classes of different texts that agree to at least
    threshold, the smaller class first; members: (name, class), each text that takes part and the class of its exact words.
    Similarity is the number of distinct shingles (of `words` consecutive words) in both by that in either, words being
    unbroken runs of letters and digits of the lower-cased text.

    Null texts and texts of fewer than least_words words take no part; an empty table gives empty tables. Rows of one name
    are one text (of different ones, that of the least class). Texts of any length are hashed whole.

    Scale: texts are read once; between tasks go the names, 32-byte signatures and, for each class, `bands` hashes of 4
    bytes in blocks. Copies are collapsed before hashing. Buckets of more than RUN classes are divided by further minima and
    spread over tasks; none is cut.
    """
    if least_words < words:
        raise ValueError("a text needs at least one shingle")
    read = cut(_read(texts.select(F.col(name).alias("name"), F.col(text).alias("text")).where("name IS NOT NULL AND text IS NOT NULL"), words, least_words, seed))
    members = read.groupBy("name").agg(F.min("class").alias("class"))
    hashed = read.where("idx IS NOT NULL")
    doubled = hashed.groupBy("class").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "first")
    again = cut(hashed.select("class", "idx").join(doubled, "class").where("idx <> first").select("idx"))
    count, twice = hashed.count(), again.count()
    if twice:
        hashed = hashed.join(F.broadcast(again) if twice <= FEW else again, "idx", "left_anti")
    pairs, crowded = _candidates(hashed, count, bands, rows, seed)
    least = _least_agreeing(threshold)
    pieces = hashed.select("idx", "pieces")
    like = pairs.join(pieces.select(F.col("idx").alias("i"), F.col("pieces").alias("p")), "i").join(pieces.select(F.col("idx").alias("j"), F.col("pieces").alias("q")), "j")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                p, q = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in "pq")
                yield t.select(["i", "j"]).filter(pa.array(_agreeing(p, q) >= least))

    alike = like.mapInArrow(check, "i long, j long")
    if not crowded.isEmpty():
        alike = alike.union(_divided(crowded, pieces, least)).distinct()
    alike = cut(alike)
    ends = alike.select(F.col("i").alias("idx")).union(alike.select(F.col("j").alias("idx"))).distinct()
    some = _only(hashed.select("idx", "class", "grams"), ends, ends.count())
    both = alike.join(some.select(F.col("idx").alias("i"), F.col("class").alias("c1"), F.col("grams").alias("g1")), "i").join(some.select(F.col("idx").alias("j"), F.col("class").alias("c2"), F.col("grams").alias("g2")), "j")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            s = np.empty(t.num_rows)
            for k, (g, h) in enumerate(zip(t.column("g1").to_pylist(), t.column("g2").to_pylist())):
                g, h = np.frombuffer(g, np.uint32), np.frombuffer(h, np.uint32)
                common = len(np.intersect1d(g, h, assume_unique=True))
                s[k] = common / (len(g) + len(h) - common)
            c1, c2 = (t.column(c).to_numpy() for c in ("c1", "c2"))
            keep = s >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c1, c2)[keep]), pa.array(np.maximum(c1, c2)[keep]), pa.array(s[keep])], names=["class_1", "class_2", "similarity"])

    return cut(both.mapInArrow(exact, "class_1 long, class_2 long, similarity double")), members


def copy_pairs(links: DataFrame, members: DataFrame, expand: int | None = 1) -> DataFrame:
    """(name_1, name_2) with name_1 < name_2: pairs between the classes' representatives, their least names, and membership, each
    representative with each other name of its class. So no link between different texts is lost, and a group of copies costs
    its own size. That is the form for classes of every size; with expand, classes of at most so many copies have all their
    pairs given instead, within the class and across links, and with None every class has, at the cost of the square of its
    size."""
    wanted = links.select(F.col("class_1").alias("class")).union(links.select(F.col("class_2").alias("class"))).distinct()
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
    used = sizes.join(wanted.withColumn("linked", F.lit(True)), "class", "left").where("linked OR n > 1").drop("linked")
    known = cut(members.join(used, "class"))
    full = F.lit(True) if expand is None else F.col("n") <= expand
    faces = known.where(full | (F.col("name") == F.col("first"))).select("class", "name")
    across = links.join(faces.select(F.col("class").alias("class_1"), F.col("name").alias("a")), "class_1").join(faces.select(F.col("class").alias("class_2"), F.col("name").alias("b")), "class_2").select("a", "b")
    every = across.union(known.where(~full & (F.col("name") != F.col("first"))).select(F.col("first").alias("a"), F.col("name").alias("b")))
    if expand is None or expand > 1:
        few = known.where(full & (F.col("n") > 1)).select("class", "name")
        every = every.union(few.withColumnRenamed("name", "a").join(few.withColumnRenamed("name", "b"), "class").where("a < b").select("a", "b"))
    return every.select(F.least("a", "b").alias("name_1"), F.greatest("a", "b").alias("name_2"))


def copy_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(name, class_name, group_name, n_links): one row per text that takes part. class_name is the least name with the same
    words, group_name the least name of all texts linked to it directly or through others, n_links the number of other
    classes that its class is linked to."""
    first = members.groupBy("class").agg(F.min("name").alias("class_name"))
    joined = components(links, "class_1", "class_2").withColumnRenamed("node", "class")
    ends = links.select(F.col("class_1").alias("class")).union(links.select(F.col("class_2").alias("class")))
    linked = cut(joined.join(ends.groupBy("class").agg(F.count(F.lit(1)).alias("n_links")), "class").join(first, "class"))
    groups = linked.groupBy("component").agg(F.min("class_name").alias("group_name"))
    about = linked.join(groups, "component").select("class", "group_name", "n_links")
    every = first.join(about, "class", "left").select("class", "class_name", F.coalesce("group_name", "class_name").alias("group_name"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(every, "class").select("name", "class_name", "group_name", "n_links")
