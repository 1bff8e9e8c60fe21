"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters that occurs in a text with k edits shares m - q + 1 - q k of its q-grams
with the place, and their diagonals (place in the text less place in the item) span k + 1 at
most. Shared q-grams are therefore counted in overlapping bands of diagonals, each 2 (k + 1) wide
and k + 1 from the next, so that any such span lies in one; bands that reach the threshold become
regions, and a banded alignment of the whole item decides. No such occurrence is lost: an item too
short for that threshold to be positive is looked for by shorter q-grams (of m / (k + 1) characters).

Items are the query set: they are taken in blocks of bounded size, each broadcast as an index of
q-grams, against all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tamis.llm._shared import tidied
from tamis.session import ship

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32
PART = 1 << 20  # characters of a text looked at together
BITS = 22
HITS = 1 << 20  # shared q-grams, place by place, that are expanded together

_CLASS: list[np.ndarray] = []


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane: its lower case (where that is one), and whether it is a letter or digit."""
    if not _CLASS:
        low, word = np.arange(65536, dtype=np.uint32), np.zeros(65536, dtype=bool)
        for c in range(65536):
            if not 0xD800 <= c < 0xE000:
                x = chr(c)
                word[c] = x.isalnum()
                y = x.lower()
                if len(y) == 1:
                    low[c] = ord(y)
        _CLASS.extend([low, word])
    return _CLASS[0], _CLASS[1]


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, place of each in ``text``): lower case, runs of other characters as one space, none at the ends."""
    low, word = _classes()
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    small = np.minimum(cp, 65535)
    keep = np.where(cp < 65536, word[small], True)
    out = np.where(keep, np.where(cp < 65536, low[small], cp), SPACE).astype(np.uint32)
    stay = keep.copy()
    stay[1:] |= keep[:-1]
    at = np.flatnonzero(stay)
    if len(at) and not keep[at[-1]]:
        at = at[:-1]
    return out[at], at


def grams(cp: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, by doubling."""
    h, have = cp.astype(np.uint64) + np.uint64(1), 1
    parts: list[tuple[np.ndarray, int]] = []
    left = q
    while True:
        if left & have:
            parts.append((h, have))
            left -= have
        if not left or len(h) <= have:
            break
        with np.errstate(over="ignore"):
            h = h[:-have] * _power(have) + h[have:]
        have *= 2
    n = len(cp) - q + 1
    if n <= 0 or left:
        return np.zeros(0, np.uint64)
    out, at = np.zeros(n, np.uint64), 0
    for part, size in parts:
        with np.errstate(over="ignore"):
            out = out * _power(size) + part[at : at + n]
        at += size
    return out


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def _sieved(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * BASE) >> np.uint64(64 - BITS)


@dataclass
class Index:
    """The q-grams of a block of items, sorted, and each item's length, budget and threshold."""

    ids: list
    items: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    short: list[int]
    hashes: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    q: int

    @classmethod
    def of(cls, rows: list[tuple], q: int, rate: float) -> Index:
        """``rows``: (id, code points), of lengths for which q-grams of that size do (or too short for any). The budget is ``rate`` of an item's characters."""
        made = list(rows)
        size = np.array([len(x) for _, x in made], dtype=np.int64)
        budget = (size * rate).astype(np.int64)
        least = size - q + 1 - q * budget
        hashed = [grams(x, q) for _, x in made]
        owner = np.repeat(np.arange(len(made)), [len(h) for h in hashed])
        place = np.concatenate([np.arange(len(h)) for h in hashed]) if made else np.zeros(0, np.int64)
        flat = np.concatenate(hashed) if made else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        sieve = np.zeros(1 << BITS, dtype=bool)
        sieve[_sieved(flat)] = True
        hashes = np.unique(flat)
        starts = np.append(np.searchsorted(flat[order], hashes), len(flat))
        return cls([i for i, _ in made], [x for _, x in made], budget, least, np.flatnonzero(size < q).tolist(), hashes, starts, owner[order], place[order], sieve, q)


def indexes(rows: list[tuple], q: int, rate: float) -> list[Index]:
    """The items (id, text) by the size of their q-grams: ``q``, or less where an item with its budget of edits might share none so long."""
    by_size: dict[int, list[tuple]] = {}
    for i, text in rows:
        x = normalise(text or "")[0]
        if len(x):
            by_size.setdefault(min(q, max(1, len(x) // (int(len(x) * rate) + 1))) if len(x) >= q else q, []).append((i, x))
    return [Index.of(some, size, rate) for size, some in sorted(by_size.items())]


def align(item: np.ndarray, text: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int] | None:
    """(edits, end) of the best alignment of the whole item within ``text`` on the diagonals low..high; None over the budget.

    The first of the ends with fewest edits counts.
    """
    width = high - low + 1
    big = len(item) + budget + 1
    diagonals = np.arange(low, high + 1)
    row = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, big).astype(np.int64)
    padded = np.concatenate([np.full(max(0, -low), -1, np.int64), text.astype(np.int64), np.full(max(0, high + len(item) - len(text)) + 1, -1, np.int64)])
    shift = max(0, -low) + low
    step = np.arange(width)
    for i, c in enumerate(item.tolist()):
        here = padded[shift + i : shift + i + width]
        ends = diagonals + i + 1  # characters of the text used
        new = row + (here != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(ends < 0) | (ends > len(text))] = big
        new = np.minimum.accumulate(new - step) + step
        new[(ends < 0) | (ends > len(text))] = big
        row = new
        if row.min() > budget:
            return None
    k = int(row.argmin())
    return int(row[k]), int(diagonals[k] + len(item))


def find(text: str, many: list[Index]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each item (by the number of its index and its own) that occurs in the text: (edits, start, end in the text), the fewest edits first, then the first place."""
    cp, at = normalise(text)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    overlap = 2 * max((len(x) for index in many for x in index.items), default=0) + 2
    for lo in range(0, max(1, len(cp)), PART):
        part = cp[lo : lo + PART + overlap]
        for k, index in enumerate(many):
            for item, edits, start, end in _occurrences(part, index):
                raw = (edits, int(at[lo + start]), int(at[lo + end - 1]) + 1)
                if (k, item) not in found or raw < found[k, item]:
                    found[k, item] = raw
        if lo + PART + overlap >= len(cp):
            break
    return found


def _occurrences(cp: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    q = index.q
    for n in index.short:  # too short for a q-gram: as it stands, between spaces
        at = _whole(cp, index.items[n])
        if at >= 0:
            yield n, 0, at, at + len(index.items[n])
    h = grams(cp, q)
    maybe = np.flatnonzero(index.sieve[_sieved(h)])
    if not len(maybe):
        return
    h = h[maybe]
    at = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
    same = index.hashes[at] == h
    maybe, at = maybe[same], at[same]
    if not len(maybe):
        return
    bands, shared = _shared(maybe, at, index)
    owners = bands >> 32
    good = shared >= index.least[owners]
    regions: dict[int, list[list[int]]] = {}
    for n, b in zip(owners[good].tolist(), ((bands[good] & 0xFFFFFFFF) - (1 << 24)).tolist(), strict=True):
        width = int(index.budget[n]) + 1
        low, high = b * width, (b + 2) * width - 1
        spans = regions.setdefault(n, [])
        if spans and low <= spans[-1][1] + 1 and spans[-1][1] - spans[-1][0] < 8 * width:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    for n, spans in regions.items():
        item, budget = index.items[n], int(index.budget[n])
        for low, high in spans:
            base = max(0, low - budget)
            text = cp[base : high + len(item) + budget + 1]
            exact = _whole(text, item, words=False)
            if exact >= 0:
                yield n, 0, base + exact, base + exact + len(item)
                break  # later diagonals begin later
            got = align(item, text, budget, low - budget - base, high + budget - base)
            if got:
                edits, end = got
                start = _start(item, text[:end], edits)
                yield n, edits, base + start, base + end


def _shared(places: np.ndarray, at: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(band, q-grams shared in it), by item and diagonal; ``at`` says which q-gram of the index stands at each place.

    Repetitive texts share many places with repetitive items; so hits are expanded a slice at a
    time, and only counts are held.
    """
    count = index.starts[at + 1] - index.starts[at]
    ends = count.cumsum()
    bands, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, int(ends[-1]), HITS):
        hit = np.arange(lo, min(lo + HITS, int(ends[-1])))
        which = np.searchsorted(ends, hit, side="right")
        row = index.starts[at[which]] + hit - (ends[which] - count[which])
        owner, diagonal = index.owner[row], places[which] - index.place[row]
        band = np.floor_divide(diagonal, index.budget[owner] + 1)
        new, n = _counted(owner, band)
        if not len(bands):
            bands, shared = new, n
            continue
        bands, back = np.unique(np.concatenate([bands, new]), return_inverse=True)
        shared = np.bincount(back, np.concatenate([shared, n]), len(bands)).astype(np.int64)
    return bands, shared


def _counted(owner: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many hits there are of each item and band, a hit counting in its band and the one before."""
    first, low = int(owner.min()), int(band.min()) - 1
    width = int(band.max()) - low + 1
    if (int(owner.max()) - first + 1) * width > 8 * len(owner):  # sparse, as in texts that aren't repetitive
        return np.unique(np.concatenate([(owner << 32) + band + (1 << 24), (owner << 32) + band - 1 + (1 << 24)]), return_counts=True)
    key = (owner - first) * width + (band - low)
    shared = np.bincount(key, minlength=key.max() + 1) + np.append(np.bincount(key - 1, minlength=key.max()), 0)
    some = np.flatnonzero(shared)
    return ((some // width + first) << 32) + some % width + low + (1 << 24), shared[some]


def _start(item: np.ndarray, text: np.ndarray, edits: int) -> int:
    """Where the alignment that ends with ``text`` begins: the same, read backwards."""
    back = align(item[::-1], text[::-1][: len(item) + edits], edits, -edits, edits) if len(text) else None
    used = back[1] if back else min(len(item), len(text))
    return max(0, len(text) - max(1, used))


def _whole(cp: np.ndarray, item: np.ndarray, words: bool = True) -> int:
    """The first place of ``item`` in ``cp`` (between spaces or ends), or -1."""
    data, want = cp.astype("<u4").tobytes(), item.astype("<u4").tobytes()
    at = data.find(want)
    while at >= 0:
        i, j = at // 4, at // 4 + len(item)
        if at % 4 == 0 and (not words or (i == 0 or cp[i - 1] == SPACE) and (j == len(cp) or cp[j] == SPACE)):
            return i
        at = data.find(want, at + 1)
    return -1


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, q: int, rate: float, block_chars: int) -> Iterator[list[Index]]:
    """The items' indexes, block by block; each holds about ``block_chars`` characters at most."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        rows = sorted(map(tuple, items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()), key=repr)
        if rows:
            yield indexes(rows, q, rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.1, block_chars: int = 1 << 22) -> DataFrame:
    """(id, item, n_edits, start, end) for each row of ``docs`` and each item that occurs in its text.

    Compared in lower case, runs of characters that are neither letters nor digits as one space;
    an occurrence is the whole item with at most ``rate`` of its characters in edits (start and
    end count characters of the text as given; of several the one of fewest edits, then the
    first). Null texts and items hold nothing; an item of no letter or digit occurs nowhere, one
    under q characters only as it stands. Repeated ids and items are each reported. Other columns
    aren't read; an empty table on either side gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("n_edits", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    spark, out = docs.sparkSession, None
    texts = docs.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    ship(spark)
    for many in _blocks(benchmark, item_col, item_text, q, rate, block_chars):
        told = spark.sparkContext.broadcast(many)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, n, *hit) for i, t in enumerate(batch.column(1)) for n, hit in find(t.as_py(), told.value).items()]
                if rows:
                    doc, item, edits, start, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([told.value[k].ids[n] for k, n in item], to_arrow_type(schema[1].dataType)), *(pa.array(x, pa.int64()) for x in (edits, start, end))], names=schema.names)

        part = texts.mapInArrow(tidied(run), schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.1, block_chars: int = 1 << 22) -> DataFrame:
    """The rows of ``docs`` (all columns) in whose text no item occurs; rows with null text stay."""
    spark, out = docs.sparkSession, docs
    ship(spark)
    for many in _blocks(benchmark, item_col, item_text, q, rate, block_chars):
        told = spark.sparkContext.broadcast(many)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([not find(t.as_py() or "", told.value) for t in texts], pa.bool_()))

        out = out.mapInArrow(tidied(run), docs.schema)
    return out
