"""Best-fit packing of documents into sequences by bin completion.

Only lengths matter to a packing, and there are ``capacity`` of them at most, so the search runs
over the histogram of lengths (bounded whatever the corpus' size): the plan is a list of runs, a
filling and how many sequences use it. Pieces then find their places by their rank among the
pieces of their length, which is counted in salted groups.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm import tokens
from tamis.llm._shared import give_back, save, tidied
from tamis.session import ship

LOOKED = 1000  # sums looked at for a node's fillings; the first is among them
SLICE = 1 << 20  # bytes of text tokenized at a time; what that took is given back before the next
CACHE = 50_000  # chunks that a worker remembers, as for tokens.CACHE: it stays beside the stages that follow
ROUNDED = 100  # shares of a sequence that the bound rounds lengths to: halves to hundredths
Run = tuple[tuple[int, ...], int]  # the lengths in a sequence, largest first, and how many such sequences


def best_fit(hist: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over a histogram of lengths, in runs of like sequences."""
    by_room: dict[int, list[list]] = {}  # room left: [lengths, number of sequences]
    rooms: list[int] = []

    def put(lengths: tuple, room: int, n: int) -> None:
        if n:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append([lengths, n])

    for size in sorted(hist, reverse=True):
        left = hist[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                put((), capacity, -(-left // (capacity // size)))
                continue
            room = rooms[at]
            groups = by_room[room]
            lengths, n = groups.pop()
            if not groups:
                del by_room[room], rooms[at]
            fit = room // size  # a sequence is the tightest until it is full
            full = min(n, left // fit)
            put(lengths + (size,) * fit, room - fit * size, full)
            left, n = left - full * fit, n - full
            if n and left and left < fit:
                put(lengths + (size,) * left, room - left * size, 1)
                left, n = 0, n - 1
            put(lengths, room, n)
    return [(lengths, n) for groups in by_room.values() for lengths, n in groups if lengths]


class Stock:
    """The lengths left: counts, and which there are as the bits of a number (and backwards), so that sums are looked up in it."""

    def __init__(self, hist: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.count: dict[int, int] = {}
        self.there, self.back = 1, 1 << capacity  # length 0 stands for an empty place
        self.add(hist)

    def add(self, lengths: dict[int, int], sign: int = 1) -> None:
        for size, n in lengths.items():
            now = self.count[size] = self.count.get(size, 0) + sign * n
            bit = 1 << size
            if (now > 0) != bool(self.there & bit):
                self.there ^= bit
                self.back ^= 1 << (self.capacity - size)

    def largest(self, room: int) -> int:
        """The largest length left of ``room`` at most, or 0."""
        return (self.there & ((2 << room) - 1)).bit_length() - 1

    def hist(self) -> dict[int, int]:
        return {k: n for k, n in self.count.items() if n}


def completions(stock: Stock, room: int, start: float = 1.0) -> Iterator[tuple[int, ...]]:
    """Multisets of the lengths left that fit ``room``, least waste first, those of large lengths first; none that another dominates.

    While the room is far larger than any length, the largest ones go in (such a room leaves
    choice enough). Three places are then tried in full, so a filling without waste by three
    lengths or fewer is never missed; what room they leave is completed in the same way. The
    stock is as it was whenever a filling is handed out. ``start`` turns the order of fillings of
    like waste: those of a largest length up to that share of the room come first.
    """
    head: list[int] = []
    while (size := stock.largest(room)) and room >= 4 * size:
        k = min(stock.count[size], room // size - 3)
        head += [size] * k
        stock.add({size: k}, -1)
        room -= k * size
    stock.add(Counter(head))
    seen = set()
    for filling in islice(_threes(stock, room, head, start), LOOKED):
        rest = room - sum(filling)
        while rest:
            more = next(_threes(stock, rest, [*head, *filling]))
            if not more:
                break
            filling = (*filling, *more)
            rest -= sum(more)
        filling = tuple(sorted(filling, reverse=True))
        if filling not in seen and not (rest and _dominated(filling, stock, rest, head)):
            seen.add(filling)
            yield (*head, *filling)


def _threes(stock: Stock, room: int, used: list[int], start: float = 1.0) -> Iterator[tuple[int, ...]]:
    """Fillings of three lengths at most, not counting those ``used``, least waste first, then by the largest length and the next; the empty one last."""
    gone = Counter(used)
    there, back = stock.there, stock.back
    for size, n in gone.items():
        if stock.count[size] == n:
            there, back = there ^ (1 << size), back ^ (1 << (stock.capacity - size))
    left = lambda size: stock.count[size] - gone[size]
    for want in _wants(there, room):
        first = there & ((2 << int(want * start)) - 1)
        for below in (first, there & ((2 << want) - 1) & ~first):
            while below:
                x = below.bit_length() - 1
                if 3 * x < want:
                    break
                below ^= 1 << x
                rest = want - x
                pairs = there & (back >> (stock.capacity - rest)) & ((2 << min(x, rest)) - 1)
                while pairs:
                    y = pairs.bit_length() - 1
                    z = rest - y
                    if y < z:
                        break
                    pairs ^= 1 << y
                    if (x != y or not x or left(x) > 1 + (y == z)) and (y != z or not y or left(y) > 1):
                        yield tuple(v for v in (x, y, z) if v)


def _wants(there: int, room: int) -> Iterator[int]:
    """The room, then what else three lengths can add up to within it (multiplicities aside), largest first."""
    yield room
    sums = there = there & ((1 << room) - 1)
    for _ in range(2):
        sums, one, left = 0, sums, there
        while left:
            low = left & -left
            sums |= one << (low.bit_length() - 1)
            left ^= low
        sums &= (1 << room) - 1
    while sums:
        want = sums.bit_length() - 1
        sums ^= 1 << want
        yield want


def _dominated(filling: tuple[int, ...], stock: Stock, waste: int, used: list[int]) -> bool:
    """Whether a length left over fits in place of a smaller one of the filling."""
    gone = Counter([*used, *filling])
    return any(stock.count.get(size, 0) > gone[size] for small in set(filling) for size in range(small + 1, small + waste + 1))


def dive(hist: dict[int, int], capacity: int, bound: int, way: int = 0) -> list[Run]:
    """One way down the tree: at each node a filling around the largest length left, as often as the lengths allow.

    Way 0 takes the first filling at each node; other ways turn the order of fillings at each node
    by a number that follows from the way and the node. The best-fit packing of what is left is
    an incumbent at every node of which the number is a power of two (from 1 on, so that each
    dive fills some sequences itself); a dive ends when that meets the bound.
    """
    stock, runs, used, node = Stock(hist, capacity), [], 0, 0
    while top := stock.largest(capacity):
        if node and node & (node - 1) == 0:
            rest = best_fit(stock.hist(), capacity)
            if used + sum(n for _, n in rest) <= bound:
                return runs + rest
        stock.add({top: 1}, -1)
        start = zlib.crc32(f"{way}/{node}".encode()) / (1 << 32) if way else 1.0
        filling = (top, *next(completions(stock, capacity - top, start), ()))
        stock.add({top: 1})
        need = Counter(filling)
        times = min(stock.count[k] // n for k, n in need.items())
        stock.add({k: n * times for k, n in need.items()}, -1)
        runs.append((filling, times))
        used += times
        node += 1
    return runs


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences.

    By tokens, for each length k up to half by those that can't share one with k (Martello and
    Toth's second bound), and with lengths rounded to shares 1/k of a sequence, of which k at most
    fit (Fekete and Schepers' dual feasible functions): two lengths over a third fill one, say.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in hist.items():
        count[size] = n
    tokens = (count * np.arange(capacity + 1)).cumsum()
    above = count[::-1].cumsum()[::-1]  # pieces of that length or more
    best = -(-int(tokens[-1]) // capacity)
    for k in [0, *(x for x in hist if 2 * x <= capacity)]:
        large = int(above[capacity - k + 1]) if k else 0
        half = int(above[capacity // 2 + 1]) - large
        middle = int(tokens[capacity - k] - (tokens[k - 1] if k else 0))
        best = max(best, large + half + max(0, -(-(middle - half * capacity) // capacity)))
    sizes = np.arange(capacity + 1)
    for k in range(1, ROUNDED + 1):
        times, over = np.divmod((k + 1) * sizes, capacity)
        best = max(best, -(-int((count * np.where(over, times * capacity, k * sizes)).sum()) // (k * capacity)))
    return best


def bin_completion(hist: dict[int, int], capacity: int, whole: int = 2, dives: int = 40) -> list[Run]:
    """As few sequences as the search finds, by bin completion.

    Depth first over undominated fillings of the largest length left, with best-fit packings (of
    all, and of what nodes leave) as incumbents, until one meets ``lower_bound``. At most
    ``whole`` ways down are tried from the top, and ``dives`` more over parts: all sequences that
    the best packing fills with waste, and some others, are searched anew (``residue``). The
    README has the gaps that this leaves.
    """
    bound = lower_bound(hist, capacity)
    best = best_fit(hist, capacity)
    count = sum(n for _, n in best)
    for way in range(whole):
        runs = dive(hist, capacity, bound, way)
        if sum(n for _, n in runs) < count + (way == 0):
            best, count = runs, sum(n for _, n in runs)
        if count <= bound:
            return best
    share = 1
    for way in range(1, dives + 1):
        fixed, open_ = residue(best, capacity, share, way)
        sub: Counter = Counter()
        for lengths, n in open_:
            for size, each in Counter(lengths).items():
                sub[size] += n * each
        was = sum(n for _, n in open_)
        found = dive(sub, capacity, max(was - (count - bound), lower_bound(sub, capacity)), way)
        if sum(n for _, n in found) < was:
            best = fixed + found
            count = sum(n for _, n in best)
            if count <= bound:
                break
        elif way % 8 == 0 and fixed and share < 16:
            share *= 2
    return best


def residue(runs: list[Run], capacity: int, share: int, way: int) -> tuple[list[Run], list[Run]]:
    """(the runs to keep, those to search again): all sequences with waste, and ``share`` times as many without (32 at least), another choice for each ``way``."""
    full = [r for r in runs if sum(r[0]) == capacity]
    open_ = [r for r in runs if sum(r[0]) < capacity]
    room, fixed = max(32, share * sum(n for _, n in open_)), []
    for _, (lengths, n) in sorted((zlib.crc32(f"{way}/{r[0]}".encode()), r) for r in full):
        taken = min(n, room, max(1, n // 4))
        room -= taken
        if taken:
            open_.append((lengths, taken))
        if taken < n:
            fixed.append((lengths, n - taken))
    return fixed, open_


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """For each run and length in it: ranks of the pieces of that length that go there, and where."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for lengths, n in runs:
        offset = 0
        for size, each in sorted(Counter(lengths).items(), reverse=True):
            rows.append((size, taken[size], each, sequence, offset))
            taken[size] += n * each
            offset += size * each
        sequence += n
    rows.sort()
    made = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": (made[:, 0] << 40) | made[:, 1], "rank": made[:, 1], "each": made[:, 2], "sequence": made[:, 3], "offset": made[:, 4]}


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and the end id, cut every ``capacity`` ids."""
    kind = dict(docs.dtypes)[id_col]

    def cut(own: pa.Array, texts: pa.Array, tokenizer: tokens.WordTokenizer) -> pa.RecordBatch:
        ids, ends = tokens.encode(texts, tokenizer, end_id)
        data = memoryview(ids.astype("<u4", copy=False)).cast("B")
        begins = np.concatenate([[0], ends[:-1]])
        each = -(-(ends - begins) // capacity)
        doc = np.repeat(np.arange(len(own)), each)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        at = piece * capacity
        size = np.minimum(capacity, (ends - begins)[doc] - at)
        lo = begins[doc] + at
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + size).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([own.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.load(tokenizer_path, CACHE)
        for batch in batches:
            for start, n in tokens.slices(batch.column(1), SLICE):
                made = cut(batch.column(0).slice(start, n), batch.column(1).slice(start, n), tokenizer)
                give_back()
                yield made

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def ranked(rows: DataFrame, hist: DataFrame, salted: int) -> DataFrame:
    """``rows`` with ``place``, a number from 0 among the rows of their length, without a gap.

    Lengths of many rows are counted in groups of about ``salted`` rows each; the groups' totals
    (one row a group) are summed in a window.
    """
    salts = hist.select(F.col("length"), F.ceil(F.col("n") / F.lit(salted)).cast("int").alias("salts"))
    dealt = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    totals = save(dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("own", own).join(totals, ["length", "salt"]).withColumn("place", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, salted: int = 50_000) -> DataFrame:
    """Every piece of every document with its place in a sequence of ``capacity`` tokens at most.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset). Null texts count as empty
    (one piece, the end id alone). Repeated and null ids keep all their rows; equal rows take
    places of their own. Ties in length go by id, piece and checksum. Other columns aren't read.
    An empty table gives no rows. The driver sees the histogram of lengths: ``capacity`` rows at most.
    """
    ship(docs.sparkSession)
    rows = save(pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id))
    hist = save(rows.groupBy("length").agg(F.count("*").alias("n")).coalesce(1))
    runs = places(bin_completion({r.length: r.n for r in hist.collect()}, capacity))
    told = docs.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = told.value
        for batch in batches:
            size, place = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            k = np.searchsorted(at["key"], (size << 40) | place, side="right") - 1
            nth = place - at["rank"][k]
            sequence = at["sequence"][k] + nth // at["each"][k]
            offset = at["offset"][k] + (nth % at["each"][k]) * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(rows.dtypes)["id"]
    placed = ranked(rows, hist, salted).select("id", "piece", "start", "length", "ids_crc32", F.col("place").cast("long").alias("place"))
    return placed.mapInArrow(tidied(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
