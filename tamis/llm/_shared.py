"""What the operators share: sorted runs, blocks of large groups, forests of links."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators.components import connected_components, local_roots
from tamis.tables import drop, save

__all__ = ["connected_components", "drop", "fresh", "give_back", "in_blocks", "local_roots", "save", "sorted_runs", "tidied"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tidied(run: Callable) -> Callable:
    """``run``, for ``mapInArrow``; after each task the worker, which stays for later ones, gives back the memory that it no longer uses."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def give_back() -> None:
    """Return freed memory, which Arrow and the C library keep, to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of equal keys from batches sorted by them: (rows, start of each run and the end).

    Only the rows of the batch at hand and of the run that is open are held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        new = np.zeros(rows.num_rows, dtype=bool)
        for k in keys:
            v = rows.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        last = int(starts[-1])
        yield rows.slice(0, last), np.concatenate([[0], starts])
        held = rows.slice(last).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, np.array([0, rows.num_rows])


def in_blocks(rows: DataFrame, keys: list[str], member: str, chunk: int, payload: DataFrame | None = None, singles: bool = False, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Rows dealt by their group, for comparing all members of a group without gathering a large one.

    A group of over ``chunk`` rows is cut into n chunks by a hash of ``member``, and each row goes
    to the n blocks of two chunks that hold its own; any two members meet in a block of about
    two chunks at most. Adds block_i, block_j and the row's own chunk, block_own; sorted by the
    keys and the first two within partitions. Groups of one row are dropped (they have nothing to
    compare) unless ``singles``, which looks up large groups only: cheaper where nearly all rows
    are narrow. ``payload``, joined by ``member`` to what is left, spares wide rows the dealing.
    ``part`` (k, n) deals the k-th of n parts of the blocks, for what is too much to deal at once.
    """
    sizes = save(rows.groupBy(*keys).count().where(F.col("count") > (chunk if singles else 1)).select(*keys, F.ceil(F.col("count") / F.lit(chunk)).cast("int").alias("block_n")))
    own = F.pmod(F.xxhash64(F.col(member)), F.col("block_n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("block_n") - 1))
    dealt = (
        rows.join(sizes, keys, "left" if singles else "inner")
        .withColumn("block_n", F.coalesce("block_n", F.lit(1)))
        .withColumn("block_own", own)
        .withColumn("block_other", other)
        .withColumn("block_i", F.least("block_own", "block_other"))
        .withColumn("block_j", F.greatest("block_own", "block_other"))
        .drop("block_n", "block_other")
    )
    at = [*keys, "block_i", "block_j"]
    if part[1] > 1:
        dealt = dealt.where(F.pmod(F.xxhash64(*at), F.lit(part[1])) == part[0])
    if payload is not None:
        dealt = dealt.join(payload, member)
    return dealt.repartition(*at).sortWithinPartitions(*at)
