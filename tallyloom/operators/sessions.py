"""Activity sessions: a secondary sort by entity and time, then one linear scan per partition.

An entity's events are first cut into stretches of `slot` seconds, and (entity, slot) is what rows are placed by, so an
entity with a third of all events is spread over as many tasks as it has slots. The scan emits each session once it is
over and holds one open session, whatever the length of the input. A session that comes within `gap` of its slot's edge
may go on in the next slot; only such pieces take part in a second, equal scan that joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _scan(key: list[str], gap: float, schema: T.StructType):
    """A function for mapInArrow over rows (*key, a, b, n) sorted by key and a: a row whose a is within gap of the b of the row
    before, of the same key, is joined to it. Rows of one key don't overlap, so the b before is the latest so far, and times
    are compared as they are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the open session, one row
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)  # all columns nullable, as in held
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            a, b, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n"))
            new = np.zeros(len(a), bool)
            new[0] = True
            for k in key:
                c = batch.column(k)
                if len(c) > 1:
                    new[1:] |= ~pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            new[1:] |= a[1:] - b[:-1] > gap
            starts = np.flatnonzero(new)
            out = [batch.column(k).take(pa.array(starts)) for k in key] + [pa.array(a[starts]), pa.array(b[np.append(starts[1:], len(b)) - 1]), pa.array(np.add.reduceat(n, starts))]
            done = pa.RecordBatch.from_arrays(out, names=[*key, "a", "b", "n"])
            held = done.slice(len(starts) - 1)
            if len(starts) > 1:
                yield done.slice(0, len(starts) - 1)
        if held is not None:
            yield held

    return scan


def sessions(events: DataFrame, entity: str, time: str, gap: float = 1800.0, slot: float = 86400.0) -> DataFrame:
    """(entity, start, end, duration, n): one row per session. A new session starts when more than gap seconds passed
    since the entity's previous event; events exactly gap apart share one. Rows with a null entity, or a time that is null
    or no finite number, are no events. Events at one time count each. slot must be at least gap; the result doesn't depend on it."""
    if slot < gap:
        raise ValueError("slot must be at least gap")
    kind = events.schema[entity].dataType
    fields = [T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType()), T.StructField("n", T.LongType())]
    first = T.StructType([T.StructField("entity", kind), T.StructField("slot", T.LongType()), *fields])
    rows = events.select(F.col(entity).alias("entity"), F.col(time).cast("double").alias("a")).where(F.col("entity").isNotNull() & (F.abs("a") < float("inf")))  # NaN is above all numbers
    rows = rows.select("entity", F.floor(F.col("a") / slot).cast("long").alias("slot"), "a", F.col("a").alias("b"), F.lit(1).cast("long").alias("n"))
    pieces = rows.repartition("entity", "slot").sortWithinPartitions("entity", "slot", "a").mapInArrow(_scan(["entity", "slot"], gap, first), first)
    begins, ends = F.col("slot") * F.lit(float(slot)), (F.col("slot") + 1) * F.lit(float(slot))
    # a second more than gap, as a time within rounding of an edge may lie in the slot beyond it
    open_ = (F.col("a") - begins <= gap + 1) | (ends - F.col("b") <= gap + 1)
    # one pass over the events: the key of a piece that can't go on elsewhere is its own start, so the second
    # scan leaves it alone, and only open pieces meet
    second = T.StructType([T.StructField("entity", kind), T.StructField("era", T.DoubleType()), *fields])
    keyed = pieces.select("entity", F.when(open_, F.lit(0.0)).otherwise(F.col("a")).alias("era"), "a", "b", "n")
    whole = keyed.repartition("entity", "era").sortWithinPartitions("entity", "era", "a").mapInArrow(_scan(["entity", "era"], gap, second), second)
    return whole.select("entity", F.col("a").alias("start"), F.col("b").alias("end"), (F.col("b") - F.col("a")).alias("duration"), "n")
