"""SimHash near-dedup: a grid join on per-segment bit counts, exact checks, components.

A 64-bit fingerprint is embedded as the vector of its segments' bit counts. The Manhattan
distance of two vectors never exceeds the Hamming distance of the fingerprints, so links at
``max_bits`` or fewer lie within that range of each other. Cut into g groups of dimensions,
such a pair is within r = max_bits // g in one group at least; its grid cells there meet:

* r = 0: both emit their own cell;
* r = 1: also the cells one step up in a dimension (of two neighbours, one steps up to the other);
* r = 2: also those one step down (two vectors at distance 2 share a lattice point between them).

That loses no link. Pairs that meet are then verified exactly by one XOR and bit count. Only
distinct fingerprints take part (copies share theirs), cells of many fingerprints are compared
in blocks, and each block answers with a forest over the fingerprints that it links, never
with all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm._shared import connected_components, drop, fresh, in_blocks, local_roots, save, sorted_runs, tidied
from tamis.session import ship

SEED = 42
STEP = 1 << 16  # shingles hashed at a time, which bounds memory for long texts
PAIRS = 1 << 20  # links held before they are reduced to a forest
SAMPLE = 16  # one text of so many is looked at for common shingles
WIDE = 32  # texts of a shingle from which on pairs are tried where they meet, and only a forest of those that may pass is given out
MARK = 1024  # bits of a mark at least; four a hash or more
COMMON = 1 << 17  # common shingles known by name at most; the rest are ordered by hash
SLICES = 4  # prefixes' shingles are shuffled so many times a part, which bounds the disk at once
DEALT = 1 << 13  # texts dealt to blocks at once at least; more than a quarter of all texts go in passes, so that large groups cost time and no disk
DEALT_BYTES = 1 << 25  # the same for what is dealt of them; more than a quarter of all texts' bytes go in passes
SIEVED = 1 << 24  # keys in a sieve at most (64 MB for as many); for more, all rows are shuffled


def shingle_hashes(text: bytes | None, n: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of the n-word shingles (fewer words: of all together), in slices."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and white space \x20 \x09-\x0D
    if not words:
        return
    if len(words) < n:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    for i in range(0, len(words) - n + 1, STEP):
        part = words[i : i + STEP + n - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(n)), strict=False))
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(part) - n + 1)


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """Each bit is 1 if it is set in over half the shingles' hashes; 0 for a text without words."""
    total, ones = 0, np.zeros(64, dtype=np.int64)
    for h in shingle_hashes(text, n):
        total += len(h)
        ones += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def with_fingerprint(docs: DataFrame, text_col: str, out_col: str, shingle: int = 3) -> DataFrame:
    """Replace the text by its fingerprint (the 64 bits as a long); other columns stay."""
    fields = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*fields, T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=batch.num_rows)
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != text_col]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], names=[f.name for f in schema])

    return docs.mapInArrow(tidied(run), schema)


def lattice_cells(fps: np.ndarray, max_bits: int, groups: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, cell) for each cell that it takes in each group of segments."""
    reach = max_bits // groups
    segments = 64 // segment_bits
    each = segments // groups
    if reach > 2 or 64 % segment_bits or segments % groups:
        raise ValueError("groups and segment_bits must divide 64, and max_bits // groups be 2 at most")
    width = segment_bits.bit_length()
    if each * width + groups.bit_length() > 63:
        raise ValueError("too many segments in a group for one cell number")
    at, cells = [], []
    index = np.arange(len(fps))
    for g in range(groups):
        counts = [np.bitwise_count((fps >> np.uint64((g * each + s) * segment_bits)) & np.uint64((1 << segment_bits) - 1)).astype(np.int64) for s in range(each)]
        home = np.full(len(fps), g << (each * width), dtype=np.int64)
        for s, c in enumerate(counts):
            home += c << (s * width)
        at.append(index)
        cells.append(home)
        for s, c in enumerate(counts) if reach else ():
            up = np.flatnonzero(c < segment_bits)
            at.append(up)
            cells.append(home[up] + (1 << (s * width)))
            if reach == 2:
                down = np.flatnonzero(c > 0)
                at.append(down)
                cells.append(home[down] - (1 << (s * width)))
    return np.concatenate(at), np.concatenate(cells)


def fingerprint_links(fps: DataFrame, max_bits: int = 3, groups: int = 2, segment_bits: int = 2, chunk: int = 1024) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints reachable by steps of ``max_bits`` or fewer.

    ``fps``: one long column, distinct, no nulls. Each block gives a forest of its links.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 8192):
                fp = batch.column(0).slice(part, 8192).to_numpy()
                at, cell = lattice_cells(fp.view(np.uint64), max_bits, groups, segment_bits)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[at])], names=["cell", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def forest() -> pa.RecordBatch:
            node, root = local_roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

        for rows, edges in sorted_runs(batches, ["cell", "block_i", "block_j"]):
            fp = rows.column("fp").to_numpy()
            rest = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(fp)) - 1  # rows of its run that come later
            live, step = np.flatnonzero(rest), 0
            while len(live):
                step += 1
                live = live[rest[live] >= step]
                a, b = fp[live], fp[live + step]
                near = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
                if near.any():
                    held.append((a[near], b[near]))
                    n += len(held[-1][0])
                    if n >= PAIRS:
                        yield forest()
                        n = 0
        if held:
            yield forest()

    cells = fps.mapInArrow(tidied(spread), "cell long, fp long")
    return in_blocks(cells, ["cell"], "fp", chunk, singles=True).mapInArrow(tidied(link), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id among the documents whose fingerprints can be reached
    by steps of ``max_bits`` or fewer bits. Null and empty texts have fingerprint 0 and link like
    any other. A repeated id keeps all its rows; null ids take part, and are never a component's
    name unless it holds nothing else (then null). Other columns of ``docs`` are not read. An
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    prints = save(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", shingle))
    own = save(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(fingerprint_links(own.select("fp"), max_bits))
    rooted = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("name"))
    moved = save(rooted.join(names, "root").where(~F.col("first").eqNullSafe(F.col("name"))).select(F.col("fp").alias("moved"), "name"))
    named = prints.join(moved, prints["fp"] == moved["moved"], "left")
    own = own.select(F.col("fp").alias("own"), "first")
    found = named.join(own, named["fp"] == own["own"], "left")
    return found.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("moved").isNotNull(), F.col("name")).otherwise(F.col("first")).alias("component_id"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, max_bits: int = 3, chunk: int = 512) -> DataFrame:
    """One document of each group of near copies, whole rows: that of the smallest id.

    Two texts are near copies if their sets of ``words``-word shingles (case of A-Z and white
    space aside; texts of fewer words are one shingle) have a Jaccard similarity of
    ``similarity`` or more; groups are the components of these links. The grid proposes those whose
    SimHash fingerprints are joined by steps of ``max_bits`` bits or fewer; a join on the shingles'
    prefixes then finds every other pair that isn't yet in one group (``_prefix_links``), so
    the bits decide how early a pair is found, never whether.
    Null texts count as empty, and all empty texts are one group; of rows with the same smallest
    id (or, where all are null, of those) one stays. Columns of any name pass through. An empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    key_at, of_id, of_key = fresh(docs, "key", "of_id", "of_key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    here = docs.withColumn(key_at, F.xxhash64(text))
    prints = with_fingerprint(here.select(F.col(key_at).alias("key"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.octet_length(text).alias("bytes"), text.alias("text")), "text", "fp", 3)
    texts = save(prints.groupBy("key").agg(F.min(F.struct("none", "id", "fp", "bytes")).alias("one"), F.count("*").alias("rows")).select("key", "one.*", "rows"))
    share = _share(texts)
    near = connected_components(fingerprint_links(texts.select("fp").distinct(), max_bits))
    placed = texts.join(near, texts["fp"] == near["node"], "left").select("key", F.coalesce("root", "fp").alias("place"))
    sizes = placed.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    wanted = save(placed.join(sizes, "place").select("key", "place"))
    every = here.select(F.col(key_at).alias("of"), text.alias("text"))
    links = _compared(wanted.withColumn("root", F.col("key")), every, share, similarity, words, chunk)
    roots = connected_components(links.union(_prefix_links(every, connected_components(links), share, similarity, words, chunk)))
    grouped = texts.join(roots, texts["key"] == roots["node"], "left").select("none", "id", "key", F.coalesce("root", "key").alias("root"))
    kept = grouped.groupBy("root").agg(F.min(F.struct("none", "id", "key")).alias("one"))
    kept = save(kept.select(F.col("one.id").alias(of_id), F.col("one.key").alias(of_key)))
    exact = lambda rows: rows.join(kept, (F.col(key_at) == F.col(of_key)) & F.col(id_col).eqNullSafe(F.col(of_id)), "left_semi").dropDuplicates([id_col, key_at]).select(*docs.columns)
    # a row alone with its text, in no group, stays as it is and needs no shuffle
    grouped = texts.where("rows > 1").select("key").union(roots.select("node")).union(roots.select("root"))
    if (may := _sieve(save(grouped.distinct()))) is None:
        return exact(here)
    return here.where(~may(key_at)).select(*docs.columns).union(exact(here.where(may(key_at))))


def _sieve(keys: DataFrame) -> Callable[[str], Column] | None:
    """A test of a column of 64-bit hashes: true for all of ``keys``, and for about one in 16 of the others. None if there are too many keys."""
    may = _sieve_of_arrays(keys)
    return may and F.arrow_udf(may, "boolean")


def _sieve_of_arrays(keys: DataFrame) -> Callable[[pa.Array], pa.Array] | None:
    """The same test, for use within a Python task: a column's test before it would keep a second worker a core."""
    n = keys.count()
    if n > SIEVED:
        return None
    last = (1 << max(10, (16 * n).bit_length() - 1)) - 1
    place = keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit(last)).cast("int")).toArrow().column(0).to_numpy()
    bits = np.zeros(last + 1, dtype=bool)
    bits[place] = True
    known = keys.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def may(key: pa.Array) -> pa.Array:
        at = key.to_numpy(zero_copy_only=False) & last
        return pa.array((known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return may


def _bodies(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` with the ``text`` of their ``key``, once each; few other texts are shuffled."""
    may = _sieve(asked.select("key"))
    few = texts.where(may("of")) if may else texts
    return asked.join(few, F.col("key") == F.col("of")).dropDuplicates(["key"]).drop("of")


def _with_shingles(texts: DataFrame, words: int) -> DataFrame:
    """Replace the text by ``shingles``, the sorted distinct hashes of its shingles, as bytes; other columns stay."""
    fields = [f for f in texts.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t.as_py(), words)])).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(made, pa.binary())], names=[f.name for f in schema])

    return texts.mapInArrow(tidied(run), schema)


class Share(NamedTuple):
    """How much is dealt to blocks at once."""

    rows: int
    bytes: int


def _share(texts: DataFrame) -> Share:
    """Of a saved table with the texts' ``bytes``."""
    rows, size = texts.agg(F.count("*"), F.sum("bytes")).first()
    return Share(max(DEALT, rows // 4), max(DEALT_BYTES, (size or 0) // 4))


def _passes(n: int | None, at_once: int) -> int:
    return max(1, -(-(n or 0) // at_once))


def _dealt(rows: DataFrame, body: str, run: Callable, share: Share) -> list[DataFrame]:
    """The links (a, b) that ``run`` finds in the blocks of ``rows``, in passes of about a share of rows and of bytes of ``body``."""
    at = ["place", "block_i", "block_j"]
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length(body))).first()
    n = max(_passes(count, share.rows), _passes(size, share.bytes))
    parts = [rows.where(F.pmod(F.xxhash64(*at), F.lit(n)) == k) if n > 1 else rows for k in range(n)]
    return [save(part.repartition(*at).sortWithinPartitions(*at).mapInArrow(tidied(run), "a long, b long")) for part in parts]


def _sifted(asked: DataFrame, texts: DataFrame, share: Share, similarity: float, words: int, chunk: int) -> DataFrame:
    """Links (a, b) that join all of a place's texts under different roots that may be of that similarity by marks of all their shingles; ``asked`` as for ``_compared``.

    A mark is a byte a shingle at most, of a shingle's eight. Most texts that common prefixes or a
    chain of them brought to one place part here, before their shingles are dealt.
    """
    may = _sieve_of_arrays(asked.select("key"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(may(batch.column("of"))) if may else batch
            if batch.num_rows:
                sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t.as_py(), words)])) for t in batch.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(mark, sets)), pa.binary())], names=["of", "size", "mark"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in sorted_runs(batches, ["place", "block_i", "block_j"]):
            keys, roots, size, own, i, j = (rows.column(c).to_numpy() for c in ("key", "root", "size", "block_own", "block_i", "block_j"))
            own = np.where(i == j, np.arange(len(own)), own)
            found = [_may_links(keys[lo:hi], roots[lo:hi], own[lo:hi], size[lo:hi], rows.column("mark").slice(lo, hi - lo).to_pylist(), similarity) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            node, of = local_roots(*map(np.concatenate, zip(*found, strict=True)))
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(of)], names=["a", "b"])

    sizes = asked.groupBy("place").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("block_n"))
    few = texts.mapInArrow(tidied(marked), "of long, size long, mark binary")
    marks = save(asked.join(sizes, "place").join(few, F.col("key") == F.col("of")).dropDuplicates(["key"]).drop("of"))
    own = F.pmod(F.xxhash64("key"), F.col("block_n")).cast("int")
    other = marks.select("*", own.alias("block_own"), F.explode(F.sequence(F.lit(0), F.col("block_n") - 1)).alias("other"))
    links = _dealt(other.select("key", "place", "root", "size", "block_own", F.least("block_own", "other").alias("block_i"), F.greatest("block_own", "other").alias("block_j"), "mark"), "mark", sift, share)
    drop(marks)
    return reduce(DataFrame.union, links)


def _may_links(keys: np.ndarray, roots: np.ndarray, own: np.ndarray, size: np.ndarray, packed: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join a block's pairs under different roots and of different ``own`` that may be of the similarity; pairs that earlier links have joined aren't looked at."""
    out = [(keys[:0], keys[:0])]
    if len(np.unique(roots)) > 1:
        marks, label = Marks(packed, size), np.arange(len(keys))
        for i in range(len(keys) - 1):
            rest = np.arange(i + 1, len(keys))
            rest = rest[(label[rest] != label[i]) & (roots[rest] != roots[i]) & (own[rest] != own[i])]
            rest = rest[np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i]) - 1e-9]
            rest = rest[marks.most(np.full(len(rest), i), rest) >= np.ceil(similarity / (1 + similarity) * (size[rest] + size[i]) - 1e-9)]
            if len(rest):
                label[np.isin(label, label[rest])] = label[i]
                out.append((np.full(len(rest), keys[i]), keys[rest]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _compared(asked: DataFrame, texts: DataFrame, share: Share, similarity: float, words: int, chunk: int) -> DataFrame:
    """Links (a, b) that join all pairs of that similarity of a place's texts under different roots; ``asked`` has key, place and root.

    Chunks of a place are compared with their neighbours first, which joins most of a large group
    of near copies. Then those under other roots than a place's largest are compared among
    themselves and with all others: two under that one need no link. Either is dealt in passes of
    about a share of the texts, whose shuffles go before the next.
    """
    sizes = asked.groupBy("place").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("block_n"))
    sets = save(_with_shingles(_bodies(texts, asked.join(sizes, "place")), words))

    def dealt(rows: DataFrame) -> list[DataFrame]:
        return _dealt(rows, "shingles", _verified(similarity), share)

    own = F.pmod(F.xxhash64("key"), F.col("block_n")).cast("int")
    pairs = F.sequence(F.greatest(own - 1, F.lit(0)), F.least(own, F.greatest(F.col("block_n") - 2, F.lit(0))))  # of a chunk and the next, by the first
    links = reduce(DataFrame.union, dealt(sets.select("*", F.explode(pairs).alias("block_i")).select("*", F.col("block_i").alias("block_j"), F.col("block_i").alias("block_own"))))
    large = sets.where("block_n > 2")
    if large.isEmpty():
        drop(sets)
        return links
    known = connected_components(links.union(large.where("key <> root").select("key", "root"))).withColumnRenamed("root", "now")
    now = save(large.join(known, large["key"] == known["node"], "left").select("key", "place", F.coalesce("now", "key").alias("root")))
    groups = now.groupBy("place", "root").agg(F.count("*").alias("n"))
    chief = groups.groupBy("place").agg(F.max_by("root", F.struct("n", "root")).alias("chief"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
    chief = chief.select("place", "chief", F.ceil((F.col("n") - F.col("most")) / F.lit(chunk)).cast("int").alias("others"), F.ceil(F.col("most") / F.lit(chunk)).cast("int").alias("chiefs"))
    mine = F.col("root") == F.col("chief")
    own = F.when(mine, F.col("others") + F.pmod(F.xxhash64("key"), F.col("chiefs"))).otherwise(F.pmod(F.xxhash64("key"), F.col("others"))).cast("int")
    laid = now.join(chief, "place").select("key", "place", "root", own.alias("block_own"), (F.col("others") + F.when(mine, 0).otherwise(F.col("chiefs"))).alias("meets"))
    rest = save(large.select("key", "shingles").join(laid, "key"))
    drop(sets, now)
    other = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other"))
    links = reduce(DataFrame.union, dealt(other.select("key", "place", "root", "block_own", F.least("block_own", "other").alias("block_i"), F.greatest("block_own", "other").alias("block_j"), "shingles")), links)
    drop(rest)
    return links


def _verified(similarity: float):
    """A block's links between texts of that similarity under different roots, as a forest; those of one chunk in the block of it alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in sorted_runs(batches, ["place", "block_i", "block_j"]):
            keys, roots, own, i, j = (rows.column(c).to_numpy() for c in ("key", "root", "block_own", "block_i", "block_j"))
            own = np.where(i == j, np.arange(len(own)), own)
            packed = rows.column("shingles")
            links: list[tuple[int, int]] = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                links += _block_links(keys[lo:hi], roots[lo:hi], own[lo:hi], [np.frombuffer(packed[int(k)].as_py(), np.uint64) for k in range(lo, hi)], similarity)
            if links:
                a, b = np.array(links, dtype=np.int64).T
                node, root = local_roots(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    return run


def _block_links(keys: np.ndarray, roots: np.ndarray, own: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span the block's groups; pairs that roots or earlier links have joined aren't looked at, nor those of one ``own``, nor those whose marks rule them out."""
    size = np.array([len(s) for s in sets])
    label, out = np.unique(roots, return_inverse=True)[1], []
    if not label.any():
        return out
    marks = Marks([mark(s) for s in sets], size)
    for i in range(len(keys) - 1):
        rest = np.arange(i + 1, len(keys))
        rest = rest[(label[rest] != label[i]) & (own[rest] != own[i])]
        rest = rest[np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i]) - 1e-9]
        if len(rest):
            rest = rest[marks.most(np.full(len(rest), i), rest) >= np.ceil(similarity / (1 + similarity) * (size[rest] + size[i]) - 1e-9)]
        for j in rest:
            if label[j] == label[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (size[i] + size[j] - both):
                label[label == label[j]] = label[i]
                out.append((int(keys[i]), int(keys[j])))
    return out


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles of several texts of a sample, the commonest last. They set the order of prefixes, hence the cost; never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()):
                for h in shingle_hashes(t.as_py(), words):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], names=["shingle"])

    some = texts.where(F.pmod(F.xxhash64("of"), F.lit(SAMPLE)) == 0).mapInArrow(tidied(run), "shingle long")
    known = some.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON).select("shingle").toArrow()
    return known.column(0).to_numpy()[::-1].view(np.uint64)


def prefix(shingles: np.ndarray, similarity: float, names: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rarest of a set's distinct hashes, so many that two sets of that similarity share one of them.

    ``names`` are the common hashes, sorted, and ``ranks`` their places among them by count.
    """
    rank = np.zeros(len(shingles), dtype=np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        rank = np.where(names[at] == shingles, ranks[at] + 1, 0)
    return shingles[np.lexsort((shingles, rank))][: _prefix_size(len(shingles), similarity)]


def _prefix_size(size, similarity: float):
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def mark(head: np.ndarray) -> bytes:
    """A bit set for each hash, of ``MARK`` bits or the power of two that gives each hash four: a longer mark, folded, is the shorter one."""
    n = max(MARK, 1 << (4 * len(head) - 1).bit_length() if len(head) else 0)
    bits = np.zeros(n, dtype=bool)
    bits[(head % np.uint64(n)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


class Marks:
    """Marks of sets of these sizes, each at its own length and folded to half of it."""

    def __init__(self, marks: list[bytes], size: np.ndarray) -> None:
        self.length = np.array([len(m) for m in marks])
        self.place = np.zeros((2, len(marks)), dtype=np.int64)  # rows of the own and of the half length
        self.bits: dict[int, np.ndarray] = {}
        self.spare: dict[int, np.ndarray] = {}
        for n in np.unique(self.length):
            own, longer = np.flatnonzero(self.length == n), np.flatnonzero(self.length == 2 * n)
            made = np.frombuffer(b"".join(marks[i] for i in (*own, *longer)), np.uint64)
            folded = made[len(own) * n // 8 :].reshape(-1, 2, n // 8)
            made = np.concatenate([made[: len(own) * n // 8].reshape(-1, n // 8), folded[:, 0] | folded[:, 1]])
            self.place[0, own], self.place[1, longer] = np.arange(len(own)), np.arange(len(own), len(made))
            self.bits[n], self.spare[n] = made, size[np.concatenate([own, longer])] - np.bitwise_count(made).sum(axis=1, dtype=np.int64)

    def most(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many hashes x[i] and y[i] share at most, whose lengths differ once at most.

        They share no more than the bits that both have, and those hashes of the one with fewer such that fell on
        a bit already set.
        """
        out, at = np.zeros(len(x), dtype=np.int64), np.minimum(self.length[x], self.length[y])
        for n in np.unique(at):
            here = np.flatnonzero(at == n)
            a, b = (self.place[(self.length[v[here]] > n).astype(np.int64), v[here]] for v in (x, y))
            bits, spare = self.bits[n], self.spare[n]
            step = max(1, (STEP * MARK) // int(n))  # bounds memory
            for lo in range(0, len(here), step):
                p, q = a[lo : lo + step], b[lo : lo + step]
                out[here[lo : lo + step]] = np.bitwise_count(bits[p] & bits[q]).sum(axis=1, dtype=np.int64) + np.minimum(spare[p], spare[q])
        return out


def _marked(similarity: float):
    """A forest over the texts of a block that its pairs under different roots join, of those that may be of the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in sorted_runs(batches, ["shingle", "block_i", "block_j"]):
            key, root, size, own, i, j = (rows.column(c).to_numpy() for c in ("key", "root", "size", "block_own", "block_i", "block_j"))
            marks = Marks(rows.column("mark").to_pylist(), _prefix_size(size, similarity))
            rest = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(key)) - 1  # rows of its run that come later
            live, step, found = np.flatnonzero(rest), 0, []
            while len(live):
                step += 1
                live = live[rest[live] >= step]
                x, y = live, live + step
                small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                near = (root[x] != root[y]) & (small >= similarity * large - 1e-9) & ((own[x] != own[y]) | (i[x] == j[x]))
                x, y, small, large = x[near], y[near], small[near], large[near]
                need = np.ceil(similarity / (1 + similarity) * (small + large) - 1e-9).astype(np.int64) - np.maximum(small - _prefix_size(small, similarity), large - _prefix_size(large, similarity))
                may = marks.most(x, y) >= need
                found.append((key[x[may]], key[y[may]]))
                if sum(len(a) for a, _ in found) >= PAIRS:
                    found = [local_roots(*map(np.concatenate, zip(*found, strict=True)))]
            if found:
                node, of = local_roots(*map(np.concatenate, zip(*found, strict=True)))
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(of)], names=["a", "b"])

    return run


def _least_shared(small: Column, large: Column, similarity: float) -> Column:
    """How many shingles the prefixes of two sets of these sizes share at least, if they are of that similarity."""
    rest = lambda size: F.ceil(F.lit(similarity) * size - F.lit(1e-9)) - 1
    return F.ceil(F.lit(similarity / (1 + similarity)) * (small + large) - F.lit(1e-9)) - F.greatest(rest(small), rest(large))


def _prefix_links(texts: DataFrame, roots: DataFrame, share: Share, similarity: float, words: int, chunk: int) -> DataFrame:
    """Links (a, b) that join all pairs of ``texts`` (of, text; copies repeat) with that Jaccard similarity under different ``roots``.

    Sets x and y of that similarity have sizes within it and share alpha = similarity / (1 +
    similarity) * (|x| + |y|) shingles at least, of which all but |x| - |prefix of x| (or the
    same of y, whichever prefix ends first) lie in both prefixes. Pairs that share that many
    there may be alike. Where over ``WIDE`` texts of a shingle meet, their prefixes' marks bound what
    two of them share, and a block answers with a forest of what may be alike (``_marked``): a
    group of near copies, or of texts with a passage in common, costs its size and not its square.

    A shingle that stands in one text's prefix only is nearly all of them, so entries are
    shuffled once, in ``SLICES``, to be rid of those; the common ones, which a task shouldn't
    gather, are known beforehand and spared that.

    The components of what may be alike are sifted by marks of all shingles (``_sifted``), and
    those of what still may be are compared whole (``_compared``). Pairs, marks and
    texts that would be more at once than in proportion to the texts go in passes.
    """
    common = _common(texts, words)
    order = np.argsort(common)
    known = texts.sparkSession.sparkContext.broadcast((common[order], order))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks = known.value
        for batch in batches:
            batch = batch.take(pa.array(np.unique(batch.column("of").to_numpy(), return_index=True)[1]))  # copies elsewhere go with their entries
            sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t.as_py(), words)])) for t in batch.column("text").cast(pa.binary())]
            made = [prefix(s, similarity, names, ranks) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array([len(s) for s in sets], pa.int64()), pa.array([h.tobytes() for h in made], pa.binary()), pa.array(list(map(mark, made)), pa.binary())], names=["of", "size", "head", "mark"])

    def entries(part: int | None):
        """The entries of a slice without common shingles, or (None) those with."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, _ = known.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    b = batch.slice(lo, 256)
                    found = [np.frombuffer(h.as_py(), np.uint64) for h in b.column("head")]
                    shingle = np.concatenate(found)
                    at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                    common = np.isin(shingle, names)
                    mine = np.flatnonzero(common if part is None else ~common & (shingle % np.uint64(SLICES) == part))
                    yield pa.RecordBatch.from_arrays([pa.array(shingle[mine].view(np.int64)), *(b.column(c).take(pa.array(at[mine])) for c in ("of", "size"))], names=["shingle", "key", "size"])

        return run

    def meet(part: int, parts: int):
        """The pairs of a part."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, edges in sorted_runs(batches, ["shingle", "block_i", "block_j"]):
                key, root, size, own, i, j = (rows.column(c).to_numpy() for c in ("key", "root", "size", "block_own", "block_i", "block_j"))
                rest = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(key)) - 1  # rows of its run that come later
                live, step = np.flatnonzero(rest), 0
                while len(live):
                    step += 1
                    live = live[rest[live] >= step]
                    x, y = live, live + step
                    # two of one chunk meet in all its blocks, and count in its own alone
                    near = (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9) & ((own[x] != own[y]) | (i[x] == j[x])) & ((key[x] ^ key[y]).view(np.uint64) % np.uint64(parts) == part)
                    if near.any():
                        x, y = x[near], y[near]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key[x], size[x], key[y], size[y])], names=["key", "size", "c_key", "c_size"])

        return run

    made = save(texts.mapInArrow(tidied(heads), "of long, size long, head binary, mark binary"))
    entry = "shingle long, key long, size long"
    slim = made.select("of", "size", "head")
    parts = [save(slim.mapInArrow(tidied(entries(None)), entry).dropDuplicates(["shingle", "key"]))]
    for k in range(SLICES):
        parts.append(save(slim.mapInArrow(tidied(entries(k)), entry).repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(tidied(_shared_entries), entry)))
    marks = save(made.select(F.col("of").alias("key"), "mark").dropDuplicates(["key"]))
    drop(made)
    found = reduce(DataFrame.union, parts)
    rooted = found.join(roots, found["key"] == roots["node"], "left").select("shingle", "key", F.coalesce("root", "key").alias("root"), "size")
    rows = save(_live(rooted))
    drop(*parts)
    counts = rows.groupBy("shingle").count()
    pairs = counts.where(F.col("count") <= WIDE).agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    wide = save(counts.where(F.col("count") > WIDE))
    narrow = rows.join(wide, "shingle", "left_anti")
    least, found = _least_shared(F.least("size", "c_size"), F.greatest("size", "c_size"), similarity), []
    for k in range(n := _passes(pairs, 64 * share.rows)):  # a pair is some 24 bytes
        met = in_blocks(narrow, ["shingle"], "key", chunk).mapInArrow(tidied(meet(k, n)), "key long, size long, c_key long, c_size long")
        met = met.select(F.least("key", "c_key").alias("a"), F.greatest("key", "c_key").alias("b"), least.alias("need"))
        found.append(save(met.groupBy("a", "b", "need").count().where("count >= need").select("a", "b")))  # whole for pairs that share no wide shingle; the others are all found there
    dealt = wide.agg(F.sum(F.col("count") * F.ceil(F.col("count") / F.lit(chunk)))).first()[0]
    for k in range(n := _passes(dealt, 8 * share.rows) if dealt else 0):  # a mark is 128 bytes at least
        some = in_blocks(rows.join(wide, "shingle", "left_semi"), ["shingle"], "key", chunk, marks, part=(k, n))
        found.append(save(some.mapInArrow(tidied(_marked(similarity)), "a long, b long")))
    maybe = reduce(DataFrame.union, found)
    places = connected_components(maybe)
    drop(rows, marks, *found)
    asked = _asked(places, roots)
    places = connected_components(_sifted(asked, texts, share, similarity, words, chunk))
    drop(asked)
    asked = _asked(places, roots)
    links = _compared(asked, texts, share, similarity, words, chunk)
    drop(asked)
    return links


def _asked(places: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, place, root) of the texts of components, saved."""
    placed = places.select(F.col("node").alias("key"), F.col("root").alias("place")).union(places.select("root", "root").distinct())
    return save(placed.join(roots, placed["key"] == roots["node"], "left").select("key", "place", F.coalesce("root", "key").alias("root")))


def _shared_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by shingle and key, once each, those whose shingle has several keys; no more than a batch and a row is held."""
    was, live = None, False  # the row that awaits its successor, and whether its shingle had another key before
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if was is None else [was, batch])
        shingle, key = rows.column("shingle").to_numpy(), rows.column("key").to_numpy()
        same = shingle[1:] == shingle[:-1]
        once = np.flatnonzero(np.concatenate([[True], ~same | (key[1:] != key[:-1])]))
        same = shingle[once[1:]] == shingle[once[:-1]]
        before = np.concatenate([[live], same])
        keep = before | np.concatenate([same, [False]])
        was, live = rows.slice(int(once[-1]), 1).combine_chunks().to_batches()[0], bool(before[-1])
        yield from rows.take(pa.array(once[:-1][keep[:-1]])).to_batches()
    if live:
        yield was


def _live(rows: DataFrame) -> DataFrame:
    """The rows of shingles that stand under several roots."""
    shared = rows.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("shingle")
    return rows.join(save(shared), "shingle", "left_semi")
