"""Embedding near-dedup: random-hyperplane sign hashing, exact cosines, components.

A vector's signature in a table is the signs of its products with some random hyperplanes: four
more than the logarithm of the number of vectors, so that buckets of vectors that have nothing in
common do not grow with the table. Vectors at angle t agree on one plane with probability
1 - t / pi, and there are as many tables as let a pair at the least cosine miss all of them about
once in a million (closer pairs far more seldom).
Vectors of the same label that share a bucket are compared exactly in double precision. Equal
vectors are one member with a weight, buckets of many members are compared in blocks, a pair is
counted in the first table that it shares, and a block answers with sums and a forest of links,
never with all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm._shared import connected_components, in_blocks, local_roots, save, sorted_runs
from tamis.session import ship

SEED = 20_240_607
PAIRS = 1 << 18  # links held before they are reduced to a forest


def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    """The normals of all hyperplanes for vectors of ``dim`` components, the same everywhere."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """For each row of ``x`` and each table, the signs as a number of ``bits`` bits (62 at most)."""
    normals, weight = planes(x.shape[1], tables, bits), 1 << np.arange(bits, dtype=np.int64)
    out = np.zeros((len(x), tables), dtype=np.int64)
    for lo in range(0, len(x), 1024):
        out[lo : lo + 1024] = (x[lo : lo + 1024] @ normals > 0).reshape(-1, tables, bits) @ weight
    return out


def layout(n: int, least: float, miss: float = 1e-6) -> tuple[int, int]:
    """(tables, bits) for ``n`` vectors: a pair at cosine ``least`` shares no bucket with probability ``miss`` at most."""
    bits = min(62, max(16, n.bit_length() + 4))
    agree = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits
    return (1, bits) if agree >= 1 else (math.ceil(math.log(miss) / math.log1p(-agree)), bits)


def usable(vectors: pa.Array) -> list[bytes | None]:
    """Each vector as the bytes of its doubles, scaled to a largest component of 1; None if it is null or empty, all zero, or holds null or non-finite components."""
    out: list[bytes | None] = []
    for v in vectors:
        if not v.is_valid or not len(v.values) or v.values.null_count:
            out.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
        top = np.abs(x).max()
        out.append((x / top).tobytes() if np.isfinite(top) and top > 0 else None)
    return out


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(usable(batch.column("vector")), pa.binary())], names=["id", "label", "vector"])


def _signed(tables: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _by_length(batch.column("vector"), lambda x: signatures(x, tables, bits), tables)
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(made)], names=["node", "marks"])

    return run


def _lists(made: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))


def _by_length(vectors: pa.Array, f, width: int) -> np.ndarray:
    """``f`` over the vectors as a matrix, those of each length together."""
    rows = vectors.to_pylist()
    size = np.array([len(v) for v in rows])
    out = np.zeros((len(rows), width), dtype=np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = f(np.frombuffer(b"".join(rows[i] for i in at), "<f8").reshape(len(at), n // 8))
    return out


def _compared(least: float):
    """A block's links: for each member the weight of those it links with, and a forest (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in sorted_runs(batches, ["bucket", "block_i", "block_j"]):
            raw = rows.column("vector").to_pylist()
            width = max(map(len, raw)) // 8
            x = np.frombuffer(b"".join(v.ljust(8 * width, b"\0") for v in raw), "<f8").reshape(len(raw), width)
            norm = np.sqrt((x * x).sum(axis=1))
            col = {c: rows.column(c).to_numpy() for c in ("node", "place", "turn", "copies", "block_i", "block_j", "block_own")}
            marks = np.concatenate([np.asarray(c.flatten()).reshape(len(c), -1) for c in rows.column("marks").chunks])
            weight = np.zeros(len(raw), dtype=np.int64)
            links, held = [], 0
            rest = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(raw)) - 1
            live, step = np.flatnonzero(rest), 0
            while len(live):
                step += 1
                live = live[rest[live] >= step]
                for lo in range(0, len(live), 1 << 14):
                    a = live[lo : lo + (1 << 14)]
                    b = a + step
                    own = (np.minimum(col["block_own"][a], col["block_own"][b]) == col["block_i"][a]) & (np.maximum(col["block_own"][a], col["block_own"][b]) == col["block_j"][a])
                    near = own & (col["place"][a] == col["place"][b]) & (np.einsum("ij,ij->i", x[a], x[b]) >= least * norm[a] * norm[b])
                    a, b = a[near], b[near]
                    if len(a):
                        first = (marks[a] == marks[b]).argmax(axis=1) == col["turn"][a]
                        a, b = a[first], b[first]
                        np.add.at(weight, a, col["copies"][b])
                        np.add.at(weight, b, col["copies"][a])
                        links.append(np.stack([col["node"][a], col["node"][b]]))
                        held += len(a)
                        if held >= PAIRS:
                            links, held = [np.stack(local_roots(*np.concatenate(links, axis=1)))], 0
            if links:
                node, root = local_roots(*np.concatenate(links, axis=1))
                some = np.flatnonzero(weight)
                nothing = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(col["node"][some]), nothing, pa.array(weight[some])], names=["a", "b", "weight"])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.nulls(len(node), pa.int64())], names=["a", "b", "weight"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, tables: int | None = None, bits: int | None = None, chunk: int = 512) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Two rows link if their labels are equal (not null), their vectors have as many components, and
    the cosine is ``least`` or more. Null, empty and zero vectors and those with null or
    non-finite components link with nothing. ``n_links`` counts the other rows linked directly (copies each),
    ``component_id`` is the smallest id reachable, itself included; ``kept`` marks the row that
    has it. Null ids link like any other and never name a component that holds another id.
    Other columns aren't read; an empty table gives no rows. Tables and planes follow from the
    number of different vectors (``layout``) where they aren't given.
    """
    ship(vectors.sparkSession)
    doubles = F.col(vector_col).cast("array<double>")
    id_kind = vectors.schema[id_col].dataType
    label_kind = vectors.schema[label_col].dataType
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), doubles.alias("vector"))
    prepared = rows.mapInArrow(_prepared, T.StructType([T.StructField("id", id_kind), T.StructField("label", label_kind), T.StructField("vector", T.BinaryType())]))
    usable_row = F.col("vector").isNotNull() & F.col("label").isNotNull()
    prepared = save(prepared.withColumn("node", F.when(usable_row, F.xxhash64("label", "vector"))).withColumn("place", F.when(usable_row, F.xxhash64("label", F.length("vector")))))
    members = save(prepared.where("node IS NOT NULL").groupBy("node", "place", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("first")))
    wanted = layout(members.count(), least)
    tables, bits = tables or wanted[0], bits or wanted[1]
    marks = members.select("node", "vector").mapInArrow(_signed(tables, bits), "node long, marks array<long>")
    marked = save(marks)
    named = members.select("node", "place")
    turns = marked.join(named, "node").select("node", F.posexplode("marks").alias("turn", "mark"), "place").select("node", F.xxhash64("place", "turn", "mark").alias("bucket"), "turn")
    payload = members.select("node", "place", "copies", "vector").join(marked, "node")
    found = save(in_blocks(turns, ["bucket"], "node", chunk, payload).mapInArrow(_compared(least), "a long, b long, weight long"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    sums = found.where("b IS NULL").groupBy("a").agg(F.sum("weight").alias("more"))
    joined = members.select("node", "copies", "first").join(roots, "node", "left").join(sums, F.col("node") == F.col("a"), "left")
    rooted = joined.select("node", "first", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    names = rooted.groupBy("root").agg(F.min("first").alias("name"))
    answers = save(rooted.join(names, "root").select(F.col("node").alias("own"), "name", "n_links"))
    out = prepared.select("id", "node").join(answers, F.col("node") == F.col("own"), "left")
    component = F.when(F.col("own").isNull(), F.col("id")).otherwise(F.col("name"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
