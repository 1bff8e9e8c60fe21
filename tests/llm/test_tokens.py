"""Token ids, packing and shards: exact round trips and brute force."""

import random
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations, permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.llm import packing, shards, tokens
from tamis.llm._shared import tidied
from tamis.llm.registry import vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def odd_texts(n=3000):
    r = random.Random(4)
    letters = list("abcXYZ'sstrevemlld0129 .,!?-<|>éÉßñ \u0085\u200b\u0301İΣσς中文😀\n\t\x0b\x1c\x1f ½²ªºǅ")
    made = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*made, "<|startoftext|> a<|endoftext|>b", None, "", "don't I'll WE'VE 'ss !'s", "word " * 9000]


def test_ids_are_the_librarys(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    texts = odd_texts()
    ids, ends = tokens.encode(pa.array(texts), tokens.WordTokenizer(vocabulary()), 1)
    start = 0
    for t, end in zip(texts, ends, strict=True):
        assert ids[start:end].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]
        start = end


def test_a_table_is_packed_whole(spark, library):
    rows = [(i, t) for i, t in enumerate(odd_texts(300))] + [(7, "twice"), (7, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("place", F.lit(0))
    got = packing.pack(df, vocabulary(), capacity=512, salted=20).collect()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, k in enumerate(range(0, len(ids), 512)):
            want[(i, p, k, len(ids[k : k + 512]), zlib.crc32(np.array(ids[k : k + 512], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in got)
    assert len(used) <= -(-total // 512) + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, vocabulary()).count() == 0
    assert shards.training_order(df, vocabulary()).count() == 0


def fewest(items, capacity):
    """By trying all orders with next-fit: some order of next-fit is optimal."""
    best = len(items)
    for order in set(permutations(items)):
        bins, room = 0, 0
        for x in order:
            if x > room:
                bins, room = bins + 1, capacity
            room -= x
        best = min(best, bins)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_finds_the_fewest(seed):
    r = random.Random(seed)
    items = [r.randint(1, 20) for _ in range(7)]
    runs = packing.bin_completion(Counter(items), 20)
    assert sum(n for _, n in runs) == fewest(items, 20)


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_length_once(seed):
    r = random.Random(seed)
    hist = Counter(r.choice([r.randint(1, 100), 37, 100]) for _ in range(3000))
    for runs in (packing.best_fit(hist, 100), packing.bin_completion(hist, 100)):
        used = Counter()
        for lengths, n in runs:
            assert sum(lengths) <= 100
            for x in lengths:
                used[x] += n
        assert used == hist


def test_fillings_are_undominated_and_least_waste_comes_first():
    r = random.Random(5)
    for _ in range(200):
        hist = Counter(r.randint(5, 40) for _ in range(r.randint(1, 12)))
        room = r.randint(5, 90)
        stock = packing.Stock(hist, 100)
        found = list(packing.completions(stock, room))
        assert stock.hist() == hist
        assert len(set(found)) == len(found) > 0
        for f in found:
            rest = room - sum(f)
            left = hist - Counter(f)
            assert rest >= 0 and not Counter(f) - hist
            assert not any(x <= rest for x in left)
            assert len(f) > 3 or not any(small < x <= small + rest for small in f for x in left)
        pool = list(hist.elements())
        threes = [t for k in range(4) for t in combinations(pool, k) if sum(t) <= room]
        if room < 4 * max((x for x in pool if x <= room), default=room):
            assert sum(found[0]) >= max(map(sum, threes))
    assert next(packing.completions(packing.Stock({60: 1, 30: 1, 25: 1, 10: 2, 5: 1}, 100), 40)) == (30, 10)


def cut_whole(n, seed, capacity=4096):
    """Lengths that fill n sequences without waste."""
    r, hist = random.Random(seed), Counter()
    for _ in range(n):
        at = [0, *sorted(r.sample(range(1, capacity), r.randint(1, 5))), capacity]
        hist.update(b - a for a, b in zip(at, at[1:], strict=False))
    return hist


@pytest.mark.parametrize("n", [60, 200, 2000])
def test_completion_of_lengths_that_fill_exactly(n):
    hist = cut_whole(n, n)
    assert packing.lower_bound(hist, 4096) == n
    assert sum(k for _, k in packing.bin_completion(hist, 4096)) <= n + 1


def test_completion_beats_best_fit_where_three_share_a_sequence():
    r, hist = random.Random(3), Counter()
    for _ in range(200):
        a = r.randint(1300, 1700)
        b = r.randint(1100, 3096 - a)
        hist.update([a, b, 4096 - a - b])
    assert sum(n for _, n in packing.best_fit(hist, 4096)) >= 215
    assert sum(n for _, n in packing.bin_completion(hist, 4096)) <= 206


def test_a_plan_from_the_search_even_where_best_fit_would_do(monkeypatch):
    asked = []
    find = packing.completions
    monkeypatch.setattr(packing, "completions", lambda *a: (asked.append(a), find(*a))[1])
    hist = {1400: 100, 1: 1500, 4096: 3, 50: 40}
    assert sum(n for _, n in packing.bin_completion(hist, 4096)) == packing.lower_bound(hist, 4096) and asked
    assert packing.bin_completion({}, 4096) == [] and packing.bin_completion({1: 10**7}, 4096)


@pytest.mark.parametrize("seed", range(30))
def test_the_bound_is_one(seed):
    r = random.Random(seed)
    items = [r.randint(1, 20) for _ in range(6)]
    assert packing.lower_bound(Counter(items), 20) <= fewest(items, 20)


def test_the_bound_sees_that_few_large_lengths_share_a_sequence():
    for share in (2, 3, 5, 9):
        assert packing.lower_bound({4096 // (share + 1) + 1: 100 * share, 1: 3}, 4096) == 100
    assert packing.lower_bound({}, 4096) == 0 and packing.lower_bound({1024: 8, 2048: 2}, 4096) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 4097])
def test_the_permutation_is_one(n):
    slots = shards.permute(np.arange(n), n, "k")
    assert sorted(slots.tolist()) == list(range(n))
    assert shards.permute(slots, n, "k", back=True).tolist() == list(range(n))
    assert n < 100 or (slots != shards.permute(np.arange(n), n, "other")).mean() > 0.9


def test_shards_read_back_in_slot_order(spark, library, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(odd_texts(120))] + [(3, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(1))
    ordered = shards.training_order(df, vocabulary(), "run", stride=16, per_shard=10)
    path = str(tmp_path / "shards")
    shards.write_shards(ordered, path, stride=16, per_shard=10)
    table = {r.slot: (r.id, r.piece, bytes(r.ids)) for r in ordered.collect()}
    assert sorted(table) == list(range(len(table)))
    read = list(shards.read_shards(spark, path, 0, 16, ahead=3))
    assert [s for s, _ in read] == list(range(len(table)))
    for slot, data in read:
        ids = np.frombuffer(table[slot][2], "<u2")
        assert data[: len(ids)].tolist() == ids.tolist() and not data[len(ids) :].any()
    assert [s for s, _ in shards.read_shards(spark, path, 17, 16)] == list(range(17, len(table)))
    opened = []
    real = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, p: (opened.append(p), real(self, p))[1])
    last = len(table) - 1
    assert [s for s, _ in shards.read_shards(spark, path, last, 16)] == [last]
    assert len(opened) == 2  # the index and one shard
    pieces = {}
    for doc, piece, ids in table.values():
        pieces.setdefault(doc, {})[piece] = np.frombuffer(ids, "<u2").tolist()
    for i, t in rows:
        if i not in (3, None):
            assert sum((pieces[i][k] for k in sorted(pieces[i])), []) == [*library.encode(t or "", add_special_tokens=False).ids, 1]
    places = {(r.shard, r.byte_offset) for r in shards.digest(ordered, 16, 10).collect()}
    assert places == {(s // 10, s % 10 * 32) for s in table}


def test_the_order_follows_from_documents_and_key_alone(spark, monkeypatch):
    monkeypatch.setattr(shards, "PART", 20)
    rows = [(i % 70, f"text {i} " * (i % 9)) for i in range(90)] + [(None, None), (5, "x"), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda d: [(r.slot, r.id, r.piece, bytes(r.ids)) for r in sorted(shards.training_order(d, vocabulary(), "k", stride=8, per_shard=10).collect(), key=lambda r: r.slot)]
    one = order(df.repartition(1))
    assert one == order(df.repartition(7).orderBy(F.desc("text"))) and [r[0] for r in one] == list(range(len(one)))


def test_the_query_writes_shards_and_reads_its_digest_off_them(spark, tmp_path, monkeypatch):
    from tamis.llm import registry

    rows = [(i, " ".join(f"word{i * k % 97}" for k in range(i * 60))) for i in range(40)] + [(None, None), (3, "again"), (77, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    written, write = [], shards.write_shards
    monkeypatch.setattr(shards, "write_shards", lambda ordered, path, **how: (written.append((ordered, path)), write(ordered, path, **how)))
    got = registry.QUERIES["op8_training_order"](spark, str(tmp_path))
    (ordered, path), = written
    assert sorted(map(repr, got.collect())) == sorted(map(repr, shards.digest(ordered, 2048, 4096).collect()))
    assert [(r.shard, r.first_slot, r.n, len(r.data)) for r in spark.read.parquet(f"{path}/shards").collect()] == [(0, 0, ordered.count(), ordered.count() * 2048 * 2)]
    # of several shards, and with a record whose last id is the padding's
    ordered = shards.training_order(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), "run", stride=16, per_shard=10, end_id=0)
    write(ordered, str(tmp_path / "small"), stride=16, per_shard=10)
    small = shards.digest_shards(spark, str(tmp_path / "small"), stride=16)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, shards.digest(ordered, 16, 10).collect()))
    assert spark.read.parquet(str(tmp_path / "small" / "shards")).count() == -(-ordered.count() // 10)


def test_a_worker_gives_back_what_its_task_no_longer_uses():
    """Python workers stay after a task; what the C library keeps of its memory would count beside later stages."""
    kept = []

    def run(batches):
        held = [np.ones(8000) for _ in range(6000)]  # 64 kB each
        kept.extend(held[::100])  # so that the heap has no end to cut
        del held
        yield from batches

    def resident():
        return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon:")) // 1024

    before = resident()
    list(tidied(run)(iter([])))
    assert resident() - before < 150


def test_forms_of_a_word_are_looked_up_once(library):
    """Case and a stop or comma after it make no new word; only other chunks are taken apart one by one."""
    tokenizer = tokens.WordTokenizer(vocabulary())
    texts = ["Straße straße, STRASSE. straSSE élan Élan, ÉLAN.", "x, x. X, x.. x,. .x ñ, µ. ª İ, ×, ÷. Ÿ ǅ, don't", None, ", . ,. a"]
    seen, chunk = [], tokenizer._chunk
    tokenizer._chunk = lambda word: seen.append(word) or chunk(word)
    ids, ends = tokens.encode(pa.array(texts), tokenizer, None)
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert not {"Straße", "straße,", "STRASSE.", "Élan,", "X,", "ñ,"} & set(seen)
    assert {"straße", "strasse", "élan", "x"} <= set(tokenizer.parts)


@pytest.mark.parametrize("cache", [None, 700])
def test_new_words_are_merged_together(library, monkeypatch, cache):
    """The model is asked for long words and marks alone, and the ids are the library's, ties and all."""
    monkeypatch.setattr(tokens, "AT_ONCE", 500, raising=False)
    r = random.Random(6)
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for letters in ("thenrasiod", "aab", "éüßñçaerÀÿ", "hHeLloO") for _ in range(1500)]
    words += [c * k for c in "asé" for k in range(1, 20)] + ["".join(r.choice("etaoinsr") for _ in range(k)) for k in (15, 16, 17, 40) for _ in range(50)]
    texts = [" ".join(w + r.choice(["", "", ",", ")", "?!", "***", "'", '."', "<|", "_"]) for w in r.sample(words, 2000)) for _ in range(4)]
    tokenizer, asked, seen = tokens.WordTokenizer(vocabulary(), cache), set(), set()
    part, chunk = tokenizer._part, tokenizer._chunk
    tokenizer._part = lambda piece: asked.add(piece) or part(piece)
    tokenizer._chunk = lambda word: seen.add(word) or chunk(word)
    for t in texts * 2:
        ids, _ = tokens.encode(pa.array([t]), tokenizer, None)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(tokenizer.parts) <= 2 * tokenizer.cache
    assert not seen and not {x for x in asked if x.isalpha() and len(x.encode()) <= 16}
    assert {x for x in asked if len(x.encode()) > 16}


def test_tokenizing_takes_little_memory_beside_the_executor():
    """Two workers of an executor tokenize at once; a batch of large texts must not add far more than itself to each."""
    code = """
import random, threading, time
import pyarrow as pa
from tamis.llm import packing
from tamis.llm.registry import vocabulary

def now():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon:")) >> 10

class Docs:
    dtypes = [("doc_id", "bigint")]
    def select(self, *columns):
        return self
    def mapInArrow(self, run, schema):
        return run

r = random.Random(3)
words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) + r.choice(["", "", ".", ";", "-"]) for _ in range(60000)]
texts = pa.array([" ".join(r.choices(words, k=400)) for _ in range(8000)])
packing.F.col = lambda name: name
run = packing.pieces(Docs(), "doc_id", "text", vocabulary(), 4096, 1)
batch = lambda n: pa.RecordBatch.from_arrays([pa.array(range(n)), texts.slice(0, n)], names=["id", "text"])
rows = sum(b.num_rows for b in run(iter([batch(1)])))
before, most = now(), [0]
def watch():
    while True:
        most[0] = max(most[0], now())
        time.sleep(0.005)
threading.Thread(target=watch, daemon=True).start()
rows = sum(b.num_rows for b in run(iter([batch(len(texts))])))
print(texts.nbytes >> 20, rows, most[0] - before)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(packing.__file__).parents[2], capture_output=True, text=True, check=True).stdout
    size, rows, more = map(int, out.split())
    assert size > 15 and rows == 8000 and more < 80, out
