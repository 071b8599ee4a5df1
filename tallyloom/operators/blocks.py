"""All pairs of sparse rows, in blocks of authors: the products of a block stay in the task that makes them, and only counts or
the pairs asked for leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyloom.session import cut

PART = 16_384  # authors in a part; each row is copied once per part
FINE = 512  # with fewer authors there are up to SPLIT parts of this size, for tasks enough
SPLIT = 8
PRODUCTS = 2_000_000  # products made at once in a task
CELLS = 4_000_000  # cells of a dense tile
DENSE_TOKENS = 8192
BINS = 100_000


class Blocks:
    """weights (by?, author, token, w) as blocks: each part of authors meets each other part, and itself, as a group of its own.
    Rows with a weight of 0 are tokens that are listed and don't count. total: the number of pairs, within each value of `by`."""

    def __init__(self, weights: DataFrame, by: str | None = None, part: int | None = None) -> None:
        self.keys = [by] if by else []
        rows = cut(weights.groupBy(*self.keys, "author").agg(F.collect_list(F.struct("token", "w")).alias("x")).select(*self.keys, "author", F.col("x.token").alias("tokens"), F.col("x.w").alias("ws")))
        sizes = rows.where("exists(ws, w -> w <> 0)").groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per value of by
        self.total = sum(r["n"] * (r["n"] - 1) // 2 for r in sizes)
        self.authors = sum(r["n"] for r in sizes)
        parts = {r[by] if by else 0: max(-(-r["n"] // (part or PART)), 0 if part else min(SPLIT // min(SPLIT, len(sizes)), -(-r["n"] // FINE)), 1) for r in sizes}
        n = sum(x * (x + 1) // 2 for x in parts.values())
        if by:
            named = rows.sparkSession.createDataFrame(list(parts.items()), rows.select(by).schema.add("parts", IntegerType())) if parts else rows.limit(0).select(by, F.lit(1).alias("parts"))
            rows = rows.join(F.broadcast(named), by)
        else:
            rows = rows.withColumn("parts", F.lit(parts.get(0, 1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("author"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select(*self.keys, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "author", "tokens", "ws")
        self.rows = rows.repartition(max(1, min(2 * n, 2000)), *self.keys, "p", "q").groupBy(*self.keys, "p", "q")

    def _counted(self, pick: Callable[[np.ndarray], np.ndarray], digits: int, zeros: bool = False, few: int | None = None) -> DataFrame:
        """(v, n): how many pairs have each value of pick() of their level, which is the similarity in units of the last digit. Pairs of
        level 0 count only with zeros. few: values are below it and are counted in place, without sorting."""

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(batches, key[-2].as_py(), key[-1].as_py())
            found, n, known = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            for s in block.similarities():
                level = np.rint(s * 10**digits).astype(np.int64)
                level = level[level != 0]
                known += len(level)
                if few:
                    m = np.bincount(pick(level), minlength=few)
                    n = n + m if len(n) else m
                    continue
                v, m = np.unique(pick(level), return_counts=True)
                found, at = np.unique(np.concatenate([found, v]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, m]), len(found)).astype(np.int64)
            if few:
                found = np.flatnonzero(n)
                n = n[found]
            if zeros and block.pairs > known:
                found, n = np.append(found, 0), np.append(n, block.pairs - known)
            yield pa.record_batch({"v": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})

        return self.rows.applyInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))

    def levels(self, digits: int) -> DataFrame:
        """(v, n) of all levels, zeros among them."""
        return self._counted(lambda x: x, digits, zeros=True)

    def bins(self, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """The bins of 10 ** digits / BINS levels that have pairs, in order, and their numbers of pairs; at most BINS and the last."""
        width = max(1, 10**digits // BINS)
        return _sorted(self._counted(lambda x: x // width, digits, few=10**digits // width + 2))

    def within(self, some: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """The levels in some bins, in order, and their numbers of pairs."""
        width = max(1, 10**digits // BINS)
        wanted = np.zeros(10**digits // width + 2, bool)
        wanted[some] = True
        return _sorted(self._counted(lambda x: x[wanted[x // width]], digits))

    def percentile(self, percent: float, digits: int, bins: tuple[np.ndarray, np.ndarray] | None = None) -> float:
        """The percentile (linear between ranks) of the similarities of all pairs, zeros among them. Counts per bin come first, then the
        levels in the one or two bins that hold it."""
        if not self.total:
            return 0.0
        v, n = bins or self.bins(digits)
        upto, zeros = np.cumsum(n), self.total - int(n.sum())
        at = percent / 100 * (self.total - 1)
        ranks = [int(at)] + [int(at) + 1] * (at != int(at) and int(at) + 1 < self.total)
        held = {k: int(np.searchsorted(upto, k - zeros, "right")) for k in ranks if k >= zeros}
        level, m = self.within(v[sorted(set(held.values()))], digits) if held else (v, n)

        def value(k: int) -> float:
            if k not in held:
                return 0.0
            width, b = max(1, 10**digits // BINS), held[k]
            first = int(np.searchsorted(level, v[b] * width))
            return float(level[first + np.searchsorted(np.cumsum(m[first:]), k - zeros - (int(upto[b - 1]) if b else 0), "right")] / 10**digits)

        low = value(ranks[0])
        return low if len(ranks) == 1 else low + (value(ranks[1]) - low) * (at - int(at))

    def ranks(self, bins: tuple[np.ndarray, np.ndarray], above: float, digits: int, full_matrix: bool = False) -> Callable[[np.ndarray], np.ndarray]:
        """A function from levels above `above` to percentile ranks, rounded to two places, half up: the mean of the percentages of
        similarities below and at most their own (plus one place), over the upper triangle or over the full matrix with each pair
        twice and the diagonal of ones. A bin whose levels all round alike needs no levels; of the others, about one for each
        different rounded rank, the levels are counted."""
        each, total, one = 1 + full_matrix, self.authors**2 if full_matrix else self.total, 10**digits
        diagonal, width = self.authors if full_matrix else 0, max(1, 10**digits // BINS)
        some = bins[0] >= int(above * one) // width
        v, n = bins[0][some], bins[1][some]
        after = np.cumsum(n[::-1])[::-1] - n  # pairs in later bins
        rounded = lambda twice: (10_000 * twice + total) // (2 * total)
        lowest, highest = 2 * (total - each * (after + n) - diagonal) + each + 1, 2 * (total - each * after - diagonal) - each + 1
        by_bin = np.where((rounded(lowest) == rounded(highest)) & (v < one // width), rounded(highest), -1) if len(v) else v
        level, m = self.within(v[by_bin < 0], digits) if (by_bin < 0).any() else (v[:0], n[:0])
        held, upto = np.searchsorted(v, level // width), np.cumsum(m)
        last = np.searchsorted(level // width, level // width, "right") - 1
        greater = after[held] + upto[last] - upto
        by_level = rounded(2 * (total - each * greater - np.where(level < one, diagonal, 0)) - each * m + 1) if len(level) else level

        def of(levels: np.ndarray) -> np.ndarray:
            out = by_bin[np.minimum(np.searchsorted(v, levels // width), len(v) - 1)]
            open_ = out < 0
            if open_.any():
                out = out.copy()
                out[open_] = by_level[np.minimum(np.searchsorted(level, levels[open_]), len(level) - 1)]
            return out / 100

        return of

    def pairs(self, least: float, digits: int | None = None, listed: int | None = None, separator: str = "; ", ranks: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """(a, b, similarity, shared, percentile_rank, shared_tokens): pairs a < b with a similarity, possibly rounded, above (without
        digits: of at least) `least`, the number of tokens they share, what ranks() gave for their levels, and the first `listed`
        of the tokens in order, joined; None: null."""
        if least < 0 or (digits is None and least <= 0):
            raise ValueError("least must leave out pairs that share nothing")

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(batches, key[-2].as_py(), key[-1].as_py())
            keep = (lambda s: s >= least) if digits is None else lambda s: np.rint(s * 10**digits) / 10**digits > least
            for t in block.found(keep, listed, separator):
                rank = pa.nulls(len(t), pa.float64())
                if digits is not None:
                    level = np.rint(t.column("similarity").to_numpy() * 10**digits).astype(np.int64)
                    t = t.set_column(2, "similarity", pa.array(level / 10**digits))
                    rank = pa.array(ranks(level)) if ranks else rank
                yield from t.add_column(4, "percentile_rank", rank).to_batches(max_chunksize=50_000)

        return self.rows.applyInArrow(run, "a string, b string, similarity double, shared long, percentile_rank double, shared_tokens string")


def _sorted(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = counts.toArrow()
    v, n = (t.column(c).to_numpy() for c in ("v", "n"))
    order = np.argsort(v)
    return v[order], n[order]


class _Block:
    """The rows of one block: side one are the authors of part p, side two those of part q, both in order of name."""

    def __init__(self, batches: Iterator[pa.RecordBatch], p: int, q: int) -> None:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        t = t.take(pc.sort_indices(t.column("author")))
        self.names = t.column("author").combine_chunks()
        lists = t.column("tokens").combine_chunks()
        code = lists.flatten().dictionary_encode()
        words = pc.sort_indices(code.dictionary).to_numpy()
        self.words = code.dictionary.take(pa.array(words))
        place = np.empty(len(words), np.int64)
        place[words] = np.arange(len(words))
        token = place[code.indices.to_numpy()]
        row = np.repeat(np.arange(len(t)), pc.list_value_length(lists).to_numpy())
        w = t.column("ws").combine_chunks().flatten().to_numpy()
        own = t.column("own").to_numpy()
        self.same = p == q
        self.sides = [np.flatnonzero(own == p), np.flatnonzero(own == q)]
        at = np.empty(len(t), np.int64)
        at[self.sides[0]] = np.arange(len(self.sides[0]))
        at[self.sides[1]] = np.arange(len(self.sides[1]))
        counts = w != 0
        self.listed = [(h, np.isin(np.arange(len(t)), row[~counts & (token == h)])) for h in np.unique(token[~counts])]
        self.cells = []
        for part in (p, q):  # entries by token, rows of a token in order
            mine = counts & (own[row] == part)
            r, k, x = at[row[mine]], token[mine], w[mine]
            order = np.lexsort((r, k))
            self.cells.append((r[order], k[order], x[order]))
        self.start = np.searchsorted(self.cells[1][1], np.arange(len(self.words) + 1))
        real = [len(np.unique(c[0])) for c in self.cells]
        self.pairs = real[0] * (real[0] - 1) // 2 if self.same else real[0] * real[1]
        r, k, _ = self.cells[0]
        first = np.arange(len(k)) + 1 if self.same else self.start[k]  # a row of one part meets the rows after it
        self.first, self.many = first, self.start[k + 1] - first
        products, cells = int(self.many.sum()), max(1, len(self.sides[0]) * len(self.sides[1])) / (1 + self.same)
        used = len(np.intersect1d(*[np.unique(c[1]) for c in self.cells]))
        self.dense = products > 20_000 and used <= DENSE_TOKENS and products * 20 > cells * (5 + used / 8)
        self.full = products > cells / 8

    def _rows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, entries): ranges of rows of side one with about PRODUCTS products."""
        r, n, width = self.cells[0][0], len(self.sides[0]), len(self.sides[1])
        order = np.argsort(r, kind="stable")
        upto = np.cumsum(np.bincount(r, self.many, n))
        edge, lo = np.searchsorted(r[order], np.arange(n + 1)), 0
        while lo < n:
            hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PRODUCTS, "right"))
            hi = min(n, max(hi, lo + 1), lo + max(1, CELLS // max(1, width)) if self.full else n)
            yield lo, hi, order[edge[lo] : edge[hi]]
            lo = hi

    def _products(self, lo: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, entry, product): key is row * width + column."""
        (r, _, x), (c, _, y) = self.cells
        many = self.many[entries]
        e = np.repeat(entries, many)
        at = np.arange(len(e)) + np.repeat(self.first[entries] - (np.cumsum(many) - many), many)
        return (r[e] - lo) * len(self.sides[1]) + c[at], e, x[e] * y[at]

    def _sums(self, rows: int, key: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, sums, of): the different keys in order, their sums, and the place among them of each product."""
        if self.full:
            size = rows * len(self.sides[1])
            s = np.bincount(key, product, size)
            there = s != 0
            return (cells := np.flatnonzero(there)), s[cells], np.cumsum(there)[key] - 1
        cells, of = np.unique(key, return_inverse=True)
        return cells, np.bincount(of, product, len(cells)), of

    def _tiles(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, products, x, y): dense tiles, x and y being their rows."""
        used = np.intersect1d(*[np.unique(c[1]) for c in self.cells])
        step = max(64, min(2048, CELLS // max(1, len(used))))

        def made(side: int, lo: int) -> np.ndarray:
            r, k, w = self.cells[side]
            mine = (r >= lo) & (r < lo + step) & np.isin(k, used)
            x = np.zeros((min(step, len(self.sides[side]) - lo), len(used)))
            x[r[mine] - lo, np.searchsorted(used, k[mine])] = w[mine]
            return x

        for lo in range(0, len(self.sides[0]), step):
            x = made(0, lo)
            for at in range(lo if self.same else 0, len(self.sides[1]), step):
                y = x if self.same and at == lo else made(1, at)
                yield lo, at, x @ y.T, x, y

    def similarities(self) -> Iterator[np.ndarray]:
        """The similarities of pairs that share a token, each pair once, possibly with zeros of others."""
        if self.dense:
            for lo, at, s, _, _ in self._tiles():
                yield s[np.triu_indices(len(s), 1)] if self.same and lo == at else s.ravel()
            return
        for lo, hi, entries in self._rows():
            key, _, product = self._products(lo, entries)
            if self.full:
                s = np.bincount(key, product, 0)
                yield s[s != 0]
            else:
                yield self._sums(hi - lo, key, product)[1]

    def found(self, keep: Callable[[np.ndarray], np.ndarray], listed: int | None, separator: str) -> Iterator[pa.Table]:
        """Tables of the pairs that keep() takes by their similarities."""
        width = len(self.sides[1])
        if self.dense and listed is None:
            for lo, at, s, x, y in self._tiles():
                took = keep(s)
                if self.same and lo == at:
                    took = np.triu(took, 1)
                i, j = np.nonzero(took)
                if len(i):
                    shared = (x != 0).astype(np.float32) @ (y != 0).astype(np.float32).T
                    yield self._table(i + lo, j + at, s[i, j], shared[i, j].astype(np.int64), pa.nulls(len(i), pa.string()))
            return
        for lo, hi, entries in self._rows():
            key, e, product = self._products(lo, entries)
            cells, s, of = self._sums(hi - lo, key, product)
            took = keep(s)
            if not took.any():
                continue
            mine = took[of]
            pair, token = (np.cumsum(took) - 1)[of[mine]], self.cells[0][1][e[mine]]
            i, j, s = cells[took] // width + lo, cells[took] % width, s[took]
            shared, lists = np.bincount(pair, minlength=len(i)), pa.nulls(len(i), pa.string())
            if listed is not None:
                for h, has in self.listed:
                    both = np.flatnonzero(has[self.sides[0][i]] & has[self.sides[1][j]])
                    pair, token = np.append(pair, both), np.append(token, np.full(len(both), h))
                order = np.lexsort((token, pair))
                pair, token = pair[order], token[order]
                first = np.searchsorted(pair, np.arange(len(i) + 1))
                some = np.arange(len(pair)) - first[pair] < listed
                upto = np.concatenate([[0], np.cumsum(np.minimum(np.diff(first), listed))])
                lists = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), self.words.take(pa.array(token[some]))), separator)
            yield self._table(i, j, s, shared, lists)

    def _table(self, i: np.ndarray, j: np.ndarray, s: np.ndarray, shared: np.ndarray, lists: pa.Array) -> pa.Table:
        a, b = self.sides[0][i], self.sides[1][j]
        names = [self.names.take(pa.array(x)) for x in (np.minimum(a, b), np.maximum(a, b))]
        return pa.table({"a": names[0], "b": names[1], "similarity": pa.array(s), "shared": pa.array(shared, pa.int64()), "shared_tokens": lists})
