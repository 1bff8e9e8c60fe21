"""Near-duplicate operators against brute force, and their edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tamis.llm import simhash, vectors
from tamis.llm._shared import connected_components

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in WS:
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def texts(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{k}é" for k in range(200)]
    out = []
    for _ in range(n):
        t = [r.choice(words) for _ in range(r.randint(0, 120))]
        out.append(" ".join(t))
        if t and r.random() < 0.5:
            t[r.randrange(len(t))] = "changed"
            out.append("\t".join(t).upper() if r.random() < 0.2 else "  ".join(t))
    return [*out, None, "", " \n ", "one", "One", "a b", "x\x85y \x1c z", "A\u00a0B c d"]


def test_fingerprints_are_those_of_the_definition():
    for t in texts():
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_long_texts_are_hashed_in_slices(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 7)
    t = texts()[3] * 5
    assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize(("bits", "groups", "width"), [(3, 2, 2), (3, 4, 1), (7, 4, 1), (11, 4, 1), (5, 2, 2)])
def test_cells_lose_no_pair(bits, groups, width):
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    for x in a:
        y = x
        for b in r.choice(64, r.integers(0, bits + 1), replace=False):
            y = y ^ (np.uint64(1) << np.uint64(b))
        _, ca = simhash.lattice_cells(np.array([x]), bits, groups, width)
        _, cb = simhash.lattice_cells(np.array([y]), bits, groups, width)
        assert np.intersect1d(ca, cb).size


def test_components_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(2))]
    rows += [(500, rows[3][1]), (500, rows[3][1]), (None, rows[5][1]), (None, "all alone here in the wide world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(7)).withColumn("component_id", F.lit("x"))
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(rows)
    fps = {plain_fingerprint(t) for _, t in rows}
    root = components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    name = {}
    for i, t in rows:
        if i is not None:
            k = root[plain_fingerprint(t)]
            name[k] = min(i, name.get(k, i))
    want = sorted((repr(i), f"{plain_fingerprint(t):016x}", repr(name.get(root[plain_fingerprint(t)]))) for i, t in rows)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want


def test_large_cells_are_compared_in_blocks(spark):
    r = np.random.default_rng(3)
    base = int(r.integers(0, 1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a in range(30) for b in range(20)} | {int(x) for x in r.integers(0, 1 << 62, 50)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {x.node: x.root for x in connected_components(simhash.fingerprint_links(df, 3, chunk=40)).collect()}
    assert {x: roots.get(x, x) for x in fps} == components(fps, lambda a, b: (a ^ b).bit_count() <= 3)


def jaccard(a, b, n=5):
    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    x, y = sets(a), sets(b)
    return 1.0 if not x and not y else len(x & y) / max(1, len(x | y))


def test_near_dedup_keeps_one_of_each_group(spark):
    r = random.Random(9)
    rows, n = [], 0
    for _ in range(12):
        t = [f"v{r.randrange(5000)}" for _ in range(150)]
        for copy in range(r.randint(1, 5)):
            u = list(t)
            for _ in range(copy % 3):
                u[r.randrange(len(u))] = f"z{r.randrange(9)}"
            rows.append((n, " ".join(u)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "short one"), (n + 3, "Short  One"), (3, rows[3][1]), (None, rows[4][1]), (None, "nobody else has these words at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("root", F.lit(1))
    got = simhash.near_dedup(df)
    assert got.columns == df.columns
    kept = got.collect()
    alive = [(i, t) for i, t in rows]
    root = components(range(len(alive)), lambda a, b: jaccard(alive[a][1], alive[b][1]) >= 0.8 and (plain_fingerprint(alive[a][1]) ^ plain_fingerprint(alive[b][1])).bit_count() <= 11)
    want = {}
    for k, (i, t) in enumerate(alive):
        key = (i is None, i if i is not None else 0)
        want[root[k]] = min(want.get(root[k], (key, t)), (key, t), key=lambda x: x[0])
    assert sorted(((x.doc_id is None, x.doc_id or 0) for x in kept)) == sorted(v[0] for v in want.values())


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(df).count() == 0
    assert simhash.near_dedup(df).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_hubs_and_chains(spark):
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (2000, 1999)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 200)} | {k: 1000 for k in range(1001, 1061)} | {2000: 1999}
    assert got == want


def test_vectors_match_brute_force(spark):
    r = np.random.default_rng(11)
    base = r.standard_normal((40, 16))
    rows = []
    for i in range(260):
        v = base[i % 40] + r.standard_normal(16) * (0.0 if i % 5 == 0 else 0.04)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(900, rows[0][1], 0), (900, rows[0][1], 0), (901, [2 * x for x in rows[0][1]], 0), (902, rows[0][1], None), (903, None, 0), (904, [], 0), (905, [0.0] * 16, 0), (906, [float("nan")] * 16, 0), (907, [None] + rows[0][1][1:], 0), (908, rows[0][1][:8], 0), (None, rows[1][1], 1), (909, [1e300] * 16, 0), (910, [1e-300] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    got = vectors.near_vectors(df, chunk=16).collect()
    assert len(got) == len(rows)

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v) / np.abs(v).max()
        return x / np.sqrt((x * x).sum())

    u = [unit(v) for _, v, _ in rows]
    linked = lambda a, b: u[a] is not None and u[b] is not None and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and float(u[a] @ u[b]) >= 0.98
    n = [sum(linked(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    root = components(range(len(rows)), linked)
    name = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            name[root[k]] = min(i, name.get(root[k], i))
    want = sorted((repr(i), n[k], repr(name.get(root[k])), i == name.get(root[k])) for k, (i, _, _) in enumerate(rows))
    assert sorted((repr(x.vec_id), x.n_links, repr(x.component_id), x.kept) for x in got) == want


def test_recall_of_the_tables_near_the_threshold():
    r = np.random.default_rng(1)
    a = r.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = r.standard_normal((2000, 64))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    for n in (0, 1, 5_000, 50_000):
        tables, bits = vectors.layout(n, 0.98)
        assert (vectors.signatures(a, tables, bits) == vectors.signatures(b, tables, bits)).any(axis=1).mean() >= 0.999
    assert vectors.layout(10**9, 0.98)[1] == 34 and vectors.layout(10**9, 0.98)[0] < 160  # more planes, so that buckets stay small


def test_marks_never_bound_too_low():
    r = np.random.default_rng(7)
    for _ in range(300):
        pool = r.integers(0, 1 << 63, 400, dtype=np.uint64)
        x, y = (np.unique(r.choice(pool, r.integers(1, 300))) for _ in range(2))
        a, b = (np.frombuffer(simhash.mark(v), np.uint64) for v in (x, y))
        spare = min(len(x) - np.bitwise_count(a).sum(dtype=int), len(y) - np.bitwise_count(b).sum(dtype=int))
        assert len(np.intersect1d(x, y)) <= np.bitwise_count(a & b).sum(dtype=int) + spare


def test_near_dedup_finds_copies_of_any_distance_in_bits(spark, monkeypatch):
    """Texts with an appended part of a fifth or less, over 11 bits apart: only their Jaccard similarity counts."""
    r = random.Random(4)
    rows, far = [], 0
    for k in range(150):
        t = [f"q{r.randrange(9000)}" for _ in range(60 + k)]
        u = t + [f"y{r.randrange(9000)}" for _ in range((len(t) - 4) // 4 + r.choice([0, 0, 1]))]
        far += jaccard(" ".join(t), " ".join(u)) >= 0.8 and (plain_fingerprint(" ".join(t)) ^ plain_fingerprint(" ".join(u))).bit_count() > 11
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(u))]
    assert far > 5
    rows += [(900 + k, "a footer that all of these texts have in common word for word " * 2 + f"{k} {k + 1} {k + 2}") for k in range(40)]
    rows += [(990, None), (991, " "), (992, "two words"), (993, "Two  words")]
    base = [f"b{r.randrange(9000)}" for _ in range(120)]
    for k in range(50):  # copies of one text, around the threshold, that are mostly not near one another
        t = list(base)
        for at in r.sample(range(120), r.randint(1, 6)):
            t[at] = f"c{k}"
        rows.append((2000 + k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = components([i for i, _ in rows], lambda a, b: jaccard(dict(rows)[a], dict(rows)[b]) >= 0.8)
    for chunk, wide in ((512, 32), (7, 1)):
        monkeypatch.setattr(simhash, "WIDE", wide)
        assert sorted(x.doc_id for x in simhash.near_dedup(df, chunk=chunk).collect()) == sorted(set(root.values()))


def test_texts_with_a_common_passage_cost_their_number_not_its_square(spark):
    """300 texts, all in one shingle and alike enough for their prefixes to pass, but no pair of them of the similarity."""
    r = np.random.default_rng(5)
    shared = np.arange(1, 90, dtype=np.uint64)
    heads = [np.concatenate([shared, r.integers(1 << 20, 1 << 62, 11, dtype=np.uint64)]) for _ in range(300)]
    rows = [(7, k, k, 500, 0, 0, 0, simhash.mark(h)) for k, h in enumerate(heads)]
    df = spark.createDataFrame(rows, "shingle long, key long, root long, size long, block_own int, block_i int, block_j int, mark binary").coalesce(1)
    got = df.mapInArrow(simhash._marked(0.8), "a long, b long").collect()
    assert {frozenset(x) for x in got} == {frozenset((k, 0)) for k in range(1, 300)}


def test_marks_of_long_texts_tell_them_apart():
    """Unrelated sets of any size are bounded far below what sets of the similarity share, and bounds are never too low."""
    r = np.random.default_rng(6)
    sets = [r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (40, 250, 260, 1000, 1030, 4000, 4090, 4100)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], r.integers(0, 1 << 63, len(s) // 10, dtype=np.uint64)]) for s in sets]
    size = np.array([len(s) for s in sets])
    marks = simhash.Marks([simhash.mark(s) for s in sets], size)
    for x in range(len(sets)):
        for y in range(x):
            if min(size[x], size[y]) < 0.8 * max(size[x], size[y]):
                continue
            both, most = len(np.intersect1d(sets[x], sets[y])), marks.most(np.array([x]), np.array([y]))[0]
            assert both <= most <= both + 0.4 * max(size[x], size[y])


def test_near_dedup_shuffles_few_texts(spark):
    """Of texts that no other resembles, hardly any is shuffled, even where no join is broadcast."""
    r = random.Random(8)
    rows = [(k, " ".join(f"{r.getrandbits(256):064x}" for _ in range(300))) for k in range(400)]
    rows += [(2000 + k, rows[k][1] + " more") for k in range(8)] + [(3000, rows[30][1]), (31, rows[31][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        jobs, stages = store.jobsList(None), set()
        for job in (jobs.apply(k) for k in range(jobs.size())):
            ids = job.stageIds()
            stages |= {int(ids.apply(k)) for k in range(ids.size())}
        return {k: store.lastStageAttempt(k).shuffleWriteBytes() for k in stages}

    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = set(written())
        kept = [x.doc_id for x in simhash.near_dedup(df).collect()]
        moved = sum(n for k, n in written().items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert sorted(kept) == list(range(400))
    assert moved < 0.5 * sum(len(t) for _, t in rows)


def test_entries_of_shingles_that_several_texts_share():
    r = np.random.default_rng(11)
    for n in (0, 1, 5, 300):
        for most in (3, 40, 400):
            rows = sorted((int(a), int(b), 9) for a, b in zip(r.integers(0, most, n), r.integers(0, 6, n), strict=True))
            cuts = [0, *sorted(r.integers(0, n + 1, r.integers(0, 40)).tolist()), n]
            batches = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows[lo:hi]], pa.int64()) for c in range(3)], names=["shingle", "key", "size"]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            got = [tuple(x.values()) for b in simhash._shared_entries(iter(batches)) for x in b.to_pylist()]
            once = sorted(set(rows))
            assert got == [x for x in once if sum(y[0] == x[0] for y in once) > 1]


def test_a_sieve_holds_its_keys_and_few_others(spark, monkeypatch):
    ids = spark.range(60_000).select(F.xxhash64("id").alias("key"), "id")
    for n in (0, 1, 5000):
        may = simhash._sieve(ids.where(F.col("id") < n).select("key"))
        through = {x.id for x in ids.where(may("key")).collect()}
        assert through >= set(range(n)) and len(through) < n + 60_000 / 5
    monkeypatch.setattr(simhash, "SIEVED", 10)
    assert simhash._sieve(ids.select("key")) is None
    texts = spark.createDataFrame([(k, f"{'a b c d e f g h ' * 20}{k % 12}") for k in range(24)] + [(99, "x"), (98, None)], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.near_dedup(texts).collect()) == [0, 98, 99]


def test_large_groups_are_dealt_in_passes(spark, monkeypatch):
    """Of 300 texts that may all be alike, some not near one another, no more than their number is dealt at once, and every pair is found."""
    r = random.Random(15)
    base, rows = [f"b{r.randrange(9000)}" for _ in range(120)], []
    for k in range(300):
        t = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3, 5, 6, 7, 8])):
            t[at] = f"c{k}"
        rows.append((k, " ".join(t)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in rows]
    root = components(range(300), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert 20 < len(set(root.values())) < 280
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, repartition = [], type(df).repartition

    def spy(self, *by):
        if "shingles" in self.columns:
            dealt.append(self.count())
        return repartition(self, *by)

    monkeypatch.setattr(type(df), "repartition", spy)
    monkeypatch.setattr(simhash, "DEALT", 16, raising=False)
    assert sorted(x.doc_id for x in simhash.near_dedup(df, chunk=8).collect()) == sorted(set(root.values()))
    assert dealt and max(dealt) <= 300


def test_texts_that_only_may_be_alike_are_parted_before_their_shingles_are_dealt(spark, monkeypatch):
    """Of 300 texts with a passage in common, in one place by their prefixes, only two copies' shingles are dealt."""
    r = random.Random(16)
    shared = " ".join(f"s{r.randrange(9000)}" for _ in range(70))
    rows = [(k, f"{shared} " + " ".join(f"o{r.randrange(10**6)}" for _ in range(30))) for k in range(300)]
    rows.append((300, rows[7][1] + " more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, repartition = [], type(df).repartition

    def spy(self, *by):
        if "shingles" in self.columns:
            dealt.append(self.count())
        return repartition(self, *by)

    monkeypatch.setattr(type(df), "repartition", spy)
    assert sorted(x.doc_id for x in simhash.near_dedup(df, chunk=64).collect()) == list(range(300))
    assert dealt and sum(dealt) <= 10


def test_long_texts_are_dealt_in_passes_by_their_bytes(spark, monkeypatch):
    """Shares count rows and bytes, so that few but long texts go in passes too."""
    rows = [(3, k, k, 0, 0 if k < 20 else k, 0 if k < 20 else k, bytes(8 * (5000 if k < 20 else 5))) for k in range(60)]
    df = spark.createDataFrame(rows, "place long, key long, root long, block_own int, block_i int, block_j int, shingles binary")
    passes = []
    monkeypatch.setattr(simhash, "save", lambda part: passes.append(part) or part)
    simhash._dealt(df, "shingles", simhash._verified(0.8), simhash.Share(1000, 200_000))
    assert len(passes) == 5
    passes.clear()
    simhash._dealt(df, "shingles", simhash._verified(0.8), simhash.Share(7, 10**9))
    assert len(passes) == 9
    simhash._dealt(df.limit(0), "shingles", simhash._verified(0.8), simhash.Share(7, 10))
    texts = spark.createDataFrame([(k, 4000) for k in range(40_000)], "key long, bytes int")
    assert simhash._share(texts) == (10_000, 40_000_000) and simhash._share(texts.limit(0)) == (simhash.DEALT, simhash.DEALT_BYTES)
