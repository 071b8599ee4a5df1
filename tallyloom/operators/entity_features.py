"""One feature row per entity from a table of events.

The events are combined to one cell per entity and type before anything is placed by entity, so an entity with a third
of all events costs no more than the number of its types. Cells are placed by a hash bucket of the entity, sorted by
entity within the bucket, and scattered with numpy into dense blocks of `block_entities` x types: counts and totals by
bincount, the latest time by a maximum scatter. A block's memory is bounded by `block_cells` whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import partitions


def event_cells(events: DataFrame, entity: str, kind: str, time: str, value: str | None = None) -> DataFrame:
    """(entity, kind, n, last, total): one row per entity and type. Rows whose entity, kind or time is null count for
    nothing; a null value counts as 0 in total."""
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(1.0)
    rows = events.select(F.col(entity).alias("entity"), F.col(kind).alias("kind"), F.col(time).cast("double").alias("time"), amount.alias("value"))
    return (
        rows.where(F.col("entity").isNotNull() & F.col("kind").isNotNull() & F.col("time").isNotNull())
        .groupBy("entity", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("last"), F.sum("value").alias("total"))
    )


def vocabulary(cells: DataFrame, limit: int) -> list[str]:
    """The types in order. They become columns, hence the limit: more than that is an error, not a truncation."""
    found = [r[0] for r in cells.select("kind").distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} event types; raise max_types, or use layout='list'")
    return sorted(found)


def _runs(names: pa.Array) -> np.ndarray:
    """Positions at which the value differs from the one before."""
    if len(names) < 2:
        return np.zeros(0, np.int64)
    same = pc.equal(names.slice(1), names.slice(0, len(names) - 1))
    return np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1


def _whole(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows in which no entity is cut; the input is sorted by entity."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        names = t.column("entity").chunk(0)
        cuts = _runs(names)
        if len(cuts):
            yield t.slice(0, cuts[-1])
            rest = t.slice(cuts[-1]).to_batches()
        else:
            rest = t.to_batches()
        held, n = rest, sum(x.num_rows for x in rest)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def entity_features(
    cells: DataFrame,
    as_of: float | None = None,
    layout: str = "wide",
    kinds: list[str] | None = None,
    max_types: int = 5000,
    block_cells: int = 4_000_000,
) -> DataFrame:
    """One row per entity from event_cells().

    layout "wide": entity, n_events, total, last, n_types, and for each type i of the vocabulary n_i, recency_i (seconds
    from the last such event to as_of, null if there is none) and total_i; the field's metadata names the type.
    layout "list": entity, n_events, total, last, n_types and arrays kinds, n, last_each, total_each of the types that
    the entity has, in the order of their names. It needs no vocabulary, so there is no limit on the number of types.
    as_of is by default the latest time in the cells. An empty table gives no rows.
    """
    spark = cells.sparkSession
    shown = cells.where(F.col("kind").isNotNull() & F.col("entity").isNotNull())
    entity_type = cells.schema["entity"].dataType
    head = [T.StructField("entity", entity_type), T.StructField("n_events", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("last", T.DoubleType()), T.StructField("n_types", T.IntegerType())]
    wide = layout == "wide"
    if wide:
        names = vocabulary(cells, max_types) if kinds is None else list(kinds)
        if as_of is None:
            as_of = cells.agg(F.max("last")).first()[0]
        fields = [T.StructField(f"{what}_{i}", kind, True, {"type": str(k)}) for what, kind in (("n", T.LongType()), ("recency", T.DoubleType()), ("total", T.DoubleType())) for i, k in enumerate(names)]
    else:
        names = None
        fields = [T.StructField("kinds", T.ArrayType(cells.schema["kind"].dataType)), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("last_each", T.ArrayType(T.DoubleType())), T.StructField("total_each", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(head + fields)
    now = as_of

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches, 20_000):
            ids, kind_col = part.column("entity").chunk(0), part.column("kind").chunk(0)
            starts = np.concatenate([[0], _runs(ids)])
            row = np.zeros(len(ids), np.int64)
            row[starts[1:]] = 1
            row = np.cumsum(row)
            code, local = _encode(kind_col, names)
            n, last, total = (part.column(c).to_numpy() for c in ("n", "last", "total"))
            width = max(len(local), 1)
            step = max(1, block_cells // width)
            for a in range(0, len(starts), step):
                b = min(a + step, len(starts))
                size, lo, hi = (b - a) * width, starts[a], (starts[b] if b < len(starts) else len(ids))
                ok = np.flatnonzero(code[lo:hi] >= 0) + lo
                flat = (row[ok] - a) * width + code[ok]
                counts = np.bincount(flat, n[ok], size).astype(np.int64).reshape(b - a, width)
                totals = np.bincount(flat, total[ok], size).reshape(b - a, width)
                latest = np.full(size, -np.inf)
                np.maximum.at(latest, flat, last[ok])
                latest = latest.reshape(b - a, width)
                top = latest.max(1)
                front = [ids.take(pa.array(starts[a:b])), pa.array(counts.sum(1)), pa.array(totals.sum(1)), pa.array(top, mask=np.isneginf(top)), pa.array((counts > 0).sum(1).astype(np.int32))]
                if wide:
                    age = now - latest
                    columns = [pa.array(counts[:, i]) for i in range(len(local))] + [pa.array(age[:, i], mask=counts[:, i] == 0) for i in range(len(local))] + [pa.array(totals[:, i]) for i in range(len(local))]
                else:
                    r, c = np.nonzero(counts)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=b - a))]).astype(np.int32))
                    columns = [pa.ListArray.from_arrays(offsets, x) for x in (local.take(pa.array(c)), pa.array(counts[r, c]), pa.array(latest[r, c]), pa.array(totals[r, c]))]
                yield pa.RecordBatch.from_arrays(front + columns, names=schema.names)

    placed = shown.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(4 * partitions(spark)))).repartition("bucket").sortWithinPartitions("entity")
    return placed.select("entity", "kind", "n", "last", "total").mapInArrow(blocks, schema)


def _encode(kind: pa.Array, names: list[str] | None) -> tuple[np.ndarray, pa.Array]:
    """A code for each row, and what the codes stand for, in order of name; -1 for a type outside a given vocabulary."""
    if names is not None:
        known = pa.array(names, kind.type)
        return pc.fill_null(pc.index_in(kind, known), -1).to_numpy(zero_copy_only=False), known
    seen = kind.dictionary_encode()
    order = pc.sort_indices(seen.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[seen.indices.to_numpy(zero_copy_only=False)], seen.dictionary.take(order)


def feature_cells(features: DataFrame) -> DataFrame:
    """The cells (entity, kind, n, last, total) of a feature table in layout "list"."""
    each = F.explode(F.arrays_zip("kinds", "n", "last_each", "total_each")).alias("x")
    return features.select("entity", each).select("entity", F.col("x.kinds").alias("kind"), F.col("x.n").alias("n"), F.col("x.last_each").alias("last"), F.col("x.total_each").alias("total"))
