"""Connected components and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.session import ship
from tamis.tables import drop, save

AT_ONCE = 1 << 20  # links of integers that one task settles (16 MB); more go in rounds


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a[i]-b[i] as (node, root) with one row for each node that is no root: a forest in place of all pairs."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        links = pa.Table.from_batches(held)
        node, root = local_roots(links.column(0).to_numpy(), links.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable, by alternating large-star and small-star rounds.

    ``edges``: two columns of one type that has an order, a link each. Returns (node, root) for
    every node whose root is another node. Joins are on a pre-aggregated minimum, so no hub is
    gathered; the rounds grow with the logarithm of the longest path. Nulls must not occur.
    Up to ``AT_ONCE`` links of long integers, a counted bound, are settled by one task instead.
    """
    a, b = edges.columns
    pair = lambda df, x, y: df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct()
    cur = save(pair(edges, F.col(a), F.col(b)))
    mark = _mark(cur)
    if mark[0] <= AT_ONCE and isinstance(cur.schema["u"].dataType, T.LongType):
        ship(cur.sparkSession)
        return save(cur.coalesce(1).mapInArrow(_settled, "node long, root long"))
    while mark[0]:
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pair(both.join(low, "u").where("v > u"), F.col("v"), F.col("m"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        was, cur = cur, save(pair(large.join(least, "u").select("v", "m").unionAll(least.select("u", "m")), F.col("v"), F.col("m")))
        drop(was)
        now = _mark(cur)
        if now == mark:
            break
        mark = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def group_by_shared_fields(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, component): rows that share a value of any of the fields, directly or in a chain; named by the smallest id.

    Null values join nothing. Each row is linked with the first row of each value that it has, so
    a value that many rows share adds one link a row.
    """
    ids = rows.select(F.col(id_col).alias("id"), *fields)
    edges = None
    for f in fields:
        firsts = ids.where(F.col(f).isNotNull()).groupBy(f).agg(F.min("id").alias("first"))
        part = ids.join(firsts, f).select("id", "first")
        edges = part if edges is None else edges.unionAll(part)
    roots = connected_components(edges)
    return ids.join(roots, ids["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("component"))
