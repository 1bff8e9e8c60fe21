"""Operators by hand-made cases: ties, nulls, NaN, empty tables, files and streams."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis import tables
from tamis.functions import images
from tamis.functions import labels as lb
from tamis.operators import agreement, components, decode, dedup, events, metrics, ordered, resample, rules, selection, series, splits, textual
from tamis.sources import scan, sink
from tamis.streaming import stateful


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_components(spark):
    edges = [("b", "a"), ("b", "c"), ("d", "e"), ("x", "x")] + [("hub", f"n{k}") for k in range(50)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "p string, q string")).collect()}
    assert got == {"b": "a", "c": "a", "e": "d", **{f"n{k}": "hub" for k in range(50)}}
    rows = spark.createDataFrame([(1, "r", None), (2, None, "k"), (3, "r", "k"), (4, None, None), (5, "s", None)], "id int, recipe string, kitchen string")
    assert dict(components.group_by_shared_fields(rows, "id", ["recipe", "kitchen"]).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_first_wins_in_order(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, None, "y"), (5, "c", ""), (6, "d", ""), (7, None, "y")], "seq int, k1 string, k2 string")
    assert sorted(r.seq for r in dedup.first_occurrences(rows, "seq", "k1", "k2").collect()) == [1, 4, 5, 6]
    report = {tuple(r) for r in dedup.duplicate_report(rows, "k1", "seq").collect()}
    assert report == {("a", 2, 1)}


def test_near_hashes_lose_no_pair(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    hashes = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 9))) for b in base]
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hashes)], "id long, hi long, lo long")
    for most in (0, 3, 6, 8):
        got = {(x.a, x.b, x.distance) for x in dedup.near_hash_pairs(df, "id", ("hi", "lo"), most).collect()}
        want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(60) for j in range(i + 1, 60) if (hashes[i] ^ hashes[j]).bit_count() <= most}
        assert got == want


def test_ranks_in_two_levels(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.random(), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, k long")
    got = {x.k: (x.nth, x.n) for x in tables.numbered_within(df, "g", ["x"], "nth", "n").collect()}
    for g in ("a", "b", None):
        mine = sorted((x, k) for h, x, k in rows if h == g)
        assert [got[k] for _, k in mine] == [(i, len(mine)) for i in range(len(mine))]
    assert tables.numbered(df.limit(0), ["x"], "nth").count() == 0
    assert sorted(x.nth for x in tables.numbered(df, ["x"], "nth").collect()) == list(range(300))


def test_broken_json_is_cut_in_one_scan():
    want = lambda t: next((c for n in range(t.count(",") + 1, 0, -1) if parses(c := ",".join(t.split(",")[:n]) + "}")), None)

    def parses(t):
        try:
            json.loads(t)
        except ValueError:
            return False
        return True

    for t in ('{"a": 1, "b": [1, 2, {"c": ","', '{"a": "x, y", "b', "{", '{"a": tru, "b": 1, ', '{"a": {"b": 1, "c": 2}, "d": "e\\\\", "f', '{"a": 1, "b": nul, "c": 3, "d"', '{"a": 1'):
        assert lb.longest_object(t) == want(t), t
    began = time.process_time()
    assert lb.longest_object('{"k": 1' + ', "x": "yyyyyyyy"' * 20_000 + ', "z') is not None
    assert time.process_time() - began < 5


def test_appending_both_or_neither(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, creator string")
    path, ledger = str(tmp_path / "events"), str(tmp_path / "ledger")
    sink.append_with_attribution(rows, path, ["creator"], ledger)
    assert spark.read.json(path).count() == 2 and spark.read.json(ledger).columns == ["creator"]
    (tmp_path / "file").write_text("in the way")
    with pytest.raises(Exception):
        sink.append_with_attribution(rows, path, ["creator"], str(tmp_path / "file" / "ledger"))
    assert spark.read.json(path).count() == 2


def test_a_replacement_that_stopped_is_finished(spark, tmp_path):
    rows, path = spark.range(3), str(tmp_path / "t")
    sink.replace(rows, path, "1")
    rows.limit(1).write.parquet(f"{path}.new-2")
    (tmp_path / "t").rename(tmp_path / "t.bak-2")
    assert sink.recover(spark, path) and spark.read.parquet(path).count() == 1 and not sink.recover(spark, path)


def test_a_release_is_whole(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "train", "real", [("image", "m/1.jpg", "aa", 5)], ("web", "s", "u", "c", "CC0"))], "event_id string, split string, source string, media_files array<struct<type string, path string, sha256 string, bytes long>>, provenance struct<provider string, source_id string, url string, creator string, licence string>")
    sink.release(rows, rows.limit(0), str(tmp_path / "r"), beside=events.bundle(rows))
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["events", "licence_manifest", "media_manifest", "source_counts"]
    assert spark.read.json(str(tmp_path / "r" / "media_manifest")).first().path == "m/1.jpg"


def test_times_as_text(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS a, named_struct('b', array(timestamp'2024-01-02 03:04:05.25', null), 'c', 1) AS s, date'2024-05-06' AS d")
    got = sink.iso_times(df).first()
    assert (got.a, got.s.b, got.s.c, got.d) == ("2024-01-02T03:04:05+00:00", ["2024-01-02T03:04:05.250000+00:00", None], 1, "2024-05-06")
    assert one(spark, x=lb.utc_stamp(F.timestamp_seconds(F.lit(0)))).x == "1970-01-01T00:00:00Z"


def test_nan_is_never_accepted(spark):
    d = spark.createDataFrame([(0, 0, float("nan")), (0, 1, 0.9), (1, 0, 0.8), (2, 2, 0.1)], "label int, pred int, conf double")
    m = metrics.gate_metrics(d, [], 0.5).first()
    assert (m.n, m.n_covered, m.coverage, m.under_covered, m.detector_fnr) == (4, 2, 0.5, 0.5, 1.0)
    empty = metrics.gate_metrics(d.limit(0), [], 0.5).first()
    assert empty.n == 0 and empty.coverage is None and empty.under_covered is None


def test_decoding_by_hand(spark):
    p = F.array(*map(F.lit, (0.1, 0.2, 0.4, 0.2, 0.1)))
    s = decode.survival(p)
    r = one(spark, level=decode.rank_level(s), top=decode.argmax_level(p), band=decode.top_two(p), tie=decode.top_two(F.array(*map(F.lit, (0.3, 0.1, 0.3, 0.2, 0.1)))), nan=decode.rank_level(F.array(F.lit(float("nan")), F.lit(0.6))))
    assert r.level == 2 and r.top == 2 and (r.band.lo, r.band.hi) == (1, 2) and (r.tie.lo, r.tie.hi) == (0, 0) and r.nan == 1
    assert not one(spark, v=decode.valid_prediction(F.array(*map(F.lit, (0.1, float("nan"), 0.4, 0.2, 0.1))), F.lit(1))).v
    back = one(spark, p=decode.reconstructed(F.array(*map(F.lit, (2.0, 1.0, -1.0, -2.0))))).p
    assert math.isclose(sum(back), 1.0) and len(back) == 5


def test_kappa_domains_differ(spark):
    t, p = [0, 0, 1, 4, 4, 4, 1], [0, 1, 1, 4, 4, 0, 4]
    k = agreement.coefficients(spark.createDataFrame(list(zip(t, p, strict=True)), "t int, p int")).first()
    assert round(k.quadratic_compressed, 4) == 0.3824 and round(k.quadratic, 4) == 0.4091
    same = agreement.coefficients(spark.createDataFrame([(1, 1), (1, 1)], "t int, p int")).first()
    assert same.agreement == 1.0 and same.kappa is None and same.quadratic is None
    with pytest.raises(Exception, match="degenerate"):
        agreement.kappa_from_matrix(spark.createDataFrame([(1, 1, 3)], "t int, p int, n int")).collect()


def test_levels_must_be_whole(spark):
    got = spark.createDataFrame([(3.0,), (3.5,), (8.0,), (float("nan"),), (None,), (7.0,)], "x double").select(lb.valid_level(F.col("x")).alias("v")).collect()
    assert [r.v for r in got] == [3, None, None, None, None, 7]


def plain_selection(rows, target, most, tie):
    n = len(rows)
    best = None
    for t in sorted({0.0} | {c for _, _, c in rows}):
        ok = [(a, b) for a, b, c in rows if c >= t]
        if not ok or len(ok) / n < 1 - most:
            continue
        under, err, cov = sum(b < a for a, b in ok) / len(ok), sum(a != b for a, b in ok) / len(ok), len(ok) / n
        key = (1, cov, t if tie == "high" else -t, 0, 0) if under <= target else (0, -under, -err, cov, -t)
        if best is None or key > best[0]:
            best = (key, t)
    return best[1]


@pytest.mark.parametrize("tie", ["high", "low"])
def test_threshold_selection_matches_a_full_scan(spark, tie):
    r = random.Random(5)
    for target in (0.02, 0.2):
        rows = [(r.randrange(5), r.randrange(5), r.choice([0.2, 0.5, 0.5001, r.random()])) for _ in range(80)]
        d = spark.createDataFrame(rows, "label int, pred int, conf double").withColumn("seed", F.lit(1))
        assert selection.select_threshold(d, ["seed"], target, 0.4, tie).first().threshold == plain_selection(rows, target, 0.4, tie)


def test_running_totals_cross_their_ranges(spark):
    r = random.Random(1)
    rows = [("a", r.random(), r.randrange(9)) for _ in range(200)] + [("b", 1.0, 3), ("b", 0.0, 2)]
    got = ordered.running_totals(spark.createDataFrame(rows, "k string, c double, m long"), ["k"], "c", ["m"], buckets=7).collect()
    assert len(got) == 202
    for x in got:
        assert x.cum_m == sum(m for k, c, m in rows if k == x.k and c >= x.c)


def test_exact_tests(spark):
    assert math.isclose(one(spark, p=metrics.log_choose_half(F.lit(10.0), F.lit(2).cast("long"))).p, (1 + 10 + 45) / 1024)
    t = spark.createDataFrame([(3, 1, 1, 3), (0, 0, 2, 2)], "a long, b long, c long, d long")
    p = [x.p_value for x in metrics.fisher(t, "a", "b", "c", "d").collect()]
    assert math.isclose(p[0], 34 / 70) and math.isclose(p[1], 1.0)
    big = metrics.fisher(spark.createDataFrame([(900, 1100, 1000, 1000)], "a long, b long, c long, d long"), "a", "b", "c", "d").first().p_value
    lg = math.lgamma
    logp = lambda x: lg(2001) * 2 + lg(1901) + lg(2101) - lg(4001) - lg(x + 1) - lg(2001 - x) - lg(1901 - x) - lg(x + 101)
    assert math.isclose(big, sum(math.exp(logp(x)) for x in range(1901) if logp(x) <= logp(900) + 1e-9), rel_tol=1e-6)


def test_balanced_and_stratified_splits(spark):
    groups = spark.createDataFrame([(f"g{k}", k % 7 + 1, k % 3) for k in range(120)], "g string, n long, label int")
    b = groups.join(splits.balanced_split(groups, "g", "n", "label", {"train": 0.7, "val": 0.15, "test": 0.15}, "s", slack=5), "g").groupBy("label", "split").agg(F.sum("n").alias("n")).collect()
    assert len(b) == 9
    for x in b:
        total = sum(y.n for y in b if y.label == x.label)
        assert x.n <= {"train": 0.7, "val": 0.15, "test": 0.15}[x.split] * total + 12
    s = splits.stratified_split(groups.where("g IN ('g0', 'g3', 'g1')"), "g", "label", "s", 0.2, 0.2).collect()
    assert {x.split for x in s if x.label == 1} == {"train"} and sorted(x.split for x in s if x.label == 0) == ["train", "val"]


def test_rules_take_null_as_absent_or_broken(spark):
    schema = {"properties": {"a": {"enum": ["x"]}, "b": {"minimum": 1, "maximum": 3}, "c": {"properties": {"d": {"minLength": 2}}, "required": ["d"]}, "e": {"uniqueItems": True, "minItems": 1}}, "required": ["a"]}
    rows = spark.createDataFrame([(1, "x", 2.0, ("dd",), [1, 2]), (2, None, float("nan"), ("d",), [1, 1]), (3, "y", None, None, []), (4, "x", 9.0, (None,), None)], "id int, a string, b double, c struct<d:string>, e array<int>")
    got = {(r.id, r.field, r.message) for r in rules.breaches(rows, "id", rules.schema_rules(schema)).collect()}
    assert got == {(2, "a", "required"), (2, "b", "minimum"), (2, "b", "maximum"), (2, "c.d", "minLength"), (2, "e", "uniqueItems"), (3, "a", "enum"), (3, "e", "minItems"), (4, "b", "maximum"), (4, "c.d", "required")}
    assert rules.refuse_test(spark.createDataFrame([("train",)], "split string"), "split") is None
    with pytest.raises(ValueError, match="External_Test"):
        rules.refuse_test(spark.createDataFrame([("External_Test",)], "split string"), "split")


def test_labels_and_values(spark):
    r = one(
        spark,
        lic=lb.licence(F.lit("cc by-sa 4.0"), F.lit("https://x/licenses/by-sa/4.0/"), F.lit("me")),
        sa=lb.is_sharealike(F.lit("by_sa 4.0")),
        none=lb.is_unverified(F.lit(False), F.lit(None).cast("string"), F.lit(False)),
        unv=lb.is_unverified(F.lit(True), F.lit(None).cast("string"), F.lit(False)),
        far=lb.hamming_hex(F.lit("f" * 16), F.lit("0" * 16)),
        iso=F.array(*(lb.iso_datetime(F.lit(x)) for x in ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-13-02T03:04:05Z"))),
        sm=lb.softmax(F.array(F.lit(1000.0), F.lit(1000.0))),
    )
    assert r.lic.allowed and r.lic.canonical == "CC BY-SA 4.0" and r.sa and not r.none and r.unv and r.far == 64
    assert r.iso == [True, False, False] and r.sm == [0.5, 0.5]


def test_series(spark):
    f = spark.createDataFrame([("a", k, v) for k, v in enumerate([1, 9, 1, 9, 9, 9])] + [("b", 0, 9), ("c", 0, 1), ("c", 1, 1)], "v string, frame int, x int")
    assert dict(series.sustained_first(f, "v", "frame", F.col("x") > 5).collect()) == {"a": 3, "b": None, "c": None}
    n = spark.createDataFrame([("a", 5), ("b", 9), ("c", None), ("d", None)], "v string, first int")
    liquid = spark.createDataFrame([("a", 6), ("b", 4), ("c", 0), ("d", None)], "v string, first int")
    got = {r.v: (r.release, r.method) for r in series.release(n, liquid, "v", 8.0).collect()}
    assert got == {"a": (5, "nozzle"), "b": (3, "liquid"), "c": (0, "liquid"), "d": (None, "abstain")}


def test_text_blocks(spark):
    doc = "intro\nstill intro\n\n- one\n- two\n  more\n\n<table><tr>\n<td>kappa</td>\n</table>\nend"
    lines = textual.lines_of(spark.createDataFrame([(1, doc), (2, None)], "id int, text string"), "id", "text")
    p = [(r.first_line, r.n_lines, r.body) for r in ordered.paragraphs(lines, "id", "line_no", "line").orderBy("first_line").collect()]
    assert p[:3] == [(0, 2, "intro still intro"), (3, 1, "- one"), (4, 2, "- two more")]
    t = {r.block: r.text for r in textual.collapsed_tables(lines.where("id = 1"), "id").collect()}
    assert t[7] == "<table><tr> <td>kappa</td> </table>" and t[10] == "end"
    w = one(spark, a=textual.window_hits(F.lit("x" * 300 + " kappa " + "y" * 300 + " draft"), "kappa", "draft"), b=textual.window_hits(F.lit("kappa draft"), "kappa", "draft"), c=textual.window_hits(F.lit("none"), "kappa", "draft"))
    assert (w.a, w.b, w.c) == (True, False, None)


def test_images():
    r = np.random.default_rng(0)
    g = r.random((32, 32))
    m = images._dct(32)
    assert np.allclose(m @ m.T, np.eye(32))
    assert len(images.phash_rows(g)) == 16 and images.phash_rows(g) != images.phash_without_first(g)
    assert images.dhash(np.arange(72.0).reshape(8, 9)) == "f" * 16


def test_image_hash_column(spark):
    d = spark.createDataFrame([(1, [float(k) for k in range(72)]), (2, [1.0]), (3, None)], "id int, px array<double>")
    assert [r.h for r in d.select("id", images.column(images.dhash, 8, 9)("px").alias("h")).orderBy("id").collect()] == ["f" * 16, None, None]


def test_readers(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "x", "n": 1}\n\n[1]\n{"id": "y"\n{"id": "z", "n": 3}\n')
    good, counts = scan.counted(spark, str(path), schema)
    assert [(r.id, r.line_no) for r in good.orderBy("line_no").collect()] == [("x", 1), ("z", 5)] and tuple(counts.first()) == (2, 2)
    with pytest.raises(Exception, match="bad line 3"):
        scan.strict(spark, str(path), schema).collect()
    assert scan.lenient(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    assert scan.tolerant(spark, str(path), schema).where("id IS NOT NULL").count() == 2
    with pytest.raises(ValueError, match="exactly one"):
        scan.store(spark, str(tmp_path), schema)
    (tmp_path / "m.csv").write_text("id,image_path\n1,/abs/a.jpg\n2,rel/b.jpg\n")
    m = scan.manifest(spark, str(tmp_path / "m.csv"), T.StructType([T.StructField("id", T.StringType()), T.StructField("image_path", T.StringType())]), "/base")
    assert [r.image_path for r in m.orderBy("id").collect()] == ["/abs/a.jpg", "/base/rel/b.jpg"]
    with pytest.raises(ValueError, match="lacks"):
        scan.ratings(spark, str(tmp_path / "m.csv"), ("id", "rating"))
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert sorted(r.id for r in scan.ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    (tmp_path / "p.json").write_text(json.dumps({"allowlist": ["CC0 1.0"]}))
    assert scan.licence_policy(spark, str(tmp_path / "p.json")) == ["CC0 1.0"] and scan.licence_policy(spark, str(tmp_path / "q.json")) == []
    np.savez(tmp_path / "z.npz", event_ids=np.array(["a", "b"]), labels=np.array([1, 2]), probabilities=np.full((2, 5), 0.2))
    assert scan.predictions_archive(spark, str(tmp_path / "z.npz"), seed=7).where("seed = 7 AND size(probs) = 5").count() == 2
    (tmp_path / "run_seed17").mkdir()
    (tmp_path / "run_seed17" / "metrics.json").write_text('{\n"id": "k", "n": 4}')
    assert tuple(scan.seed_reports(spark, str(tmp_path / "*_seed*" / "metrics.json"), schema).first()) == ("k", 4, 17)
    assert scan.file_receipt(spark, str(tmp_path / "run_seed17")).first().size == 20
    assert scan.hub_reference("hub:a/b@v1:c/d.npz") == {"owner": "a", "name": "b", "revision": "v1", "file": "c/d.npz"}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", float("nan")), (1, "a", 0.5)], "z int, a string, x double")
    sink.append_ledger(rows, str(tmp_path / "l"))
    sink.append_ledger(rows, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 4 and spark.read.text(str(tmp_path / "l")).first()[0].startswith('{"a":')
    for k in range(2):
        sink.replace(rows.limit(k + 1), str(tmp_path / "t"), f"s{k}")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and spark.read.parquet(str(tmp_path / "t.bak-s1")).count() == 1
    with pytest.raises(ValueError, match="refused"):
        sink.release(rows, rows, str(tmp_path / "r"), ("a",))
    sink.release(rows, rows.limit(0), str(tmp_path / "r"), ("a",))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    sink.report(rows.limit(1), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"z": 2, "a": "b", "x": None}
    assert sink.markdown([{"a": 1.5, "b": None}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1.5000 | n/a |"


def test_events(spark):
    c = spark.createDataFrame([("wiki", "7", "u", "me", "CC0 1.0", 4, float("nan"), None, "h", "s", 5)], "provider string, source_id string, url string, creator string, licence string, level int, confidence double, captured_at string, harvested_at string, sha256 string, bytes int")
    e = events.build_events(c)
    r = e.first()
    import hashlib

    assert r.event_id == "RW_wiki_" + hashlib.sha256(b"wiki\x007").hexdigest()[:20] and r.weak_confidence == 0.0 and r.captured_at == "h"
    assert events.attribution(e).first().creator == "me"


def test_limiter_forgets_and_ignores_refused(spark):
    assert stateful.limit([0, 1, 2, 3, 10.5, 11, 11.5], [], 10, 2)[0] == [True, True, False, False, True, True, False]
    rows = spark.createDataFrame([("a", k, float(t)) for k, t in enumerate([0, 1, 2, 3, 10.5, 11, 11.5])] + [("b", 0, 5.0), (None, 1, 1.0)], "key string, id long, at double")
    got = stateful.limited(rows, 10.0, 2).collect()
    assert [r.accepted for r in sorted((x for x in got if x.key == "a"), key=lambda x: x.id)] == [True, True, False, False, True, True, False] and len(got) == 9


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / "in"
    spark.createDataFrame([("a", k, float(k)) for k in range(4)], "key string, id long, at double").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("key string, id long, at double").parquet(str(source))
    q = stateful.limited_stream(stream, 10.0, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.accepted for r in spark.table("limited").orderBy("id").collect()] == [True, True, False, False]
    for n in range(2):  # the second run is given the same events again
        stateful.quarantine(stream, str(tmp_path / "out"), str(tmp_path / f"q{n}"), "id").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("NOT release_eligible").count() == 4


def test_event_time_windows_on_a_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{m:02d}:00", "x", 1.0) for k, m in enumerate([1, 2, 7, 30, 59])]
    df = spark.createDataFrame(rows, "id int, t string, kind string, value double").select("id", F.col("t").cast("timestamp").alias("ts"), "kind", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stateful.windowed(s, "ts", "kind", "5 minutes", "1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 1, 1, 2]


def test_draws_keep_strata_and_do_not_depend_on_partitions(spark):
    d = spark.createDataFrame([(k, k % 3) for k in range(60)], "id int, s int")
    a = sorted(map(tuple, resample.stratified_draws(d, "s", "id", 3).select("replicate", "id").collect()))
    b = sorted(map(tuple, resample.stratified_draws(d.repartition(7), "s", "id", 3).select("replicate", "id").collect()))
    assert a == b and len(a) == 180


def test_weighted_order_draws_by_weight(spark):
    d = spark.range(4000).withColumn("weight", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0))
    drawn = splits.weighted_order(d, "weight", "s", "id").orderBy("draw_key").limit(400).collect()
    assert 0.68 < np.mean([r.id % 2 == 0 for r in drawn]) < 0.82
    w = splits.sampling_weights(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, label string"), "label")
    assert {(r.id, r.weight) for r in w.collect()} == {(1, 0.5), (2, 0.5), (3, 1.0)}


def test_fisher_on_large_tables_and_far_ones(spark):
    """Steps follow from the spread, not from the square of the rows; one-sided tails, symmetric ties and no rows at all."""
    rows = [(1_250_000, 1_250_000, 2_498_000, 2_502_000), (9, 0, 0, 9), (0, 7, 7, 0), (50, 950, 10, 990), (0, 0, 0, 0), (5, 0, 0, 0), (30_000, 0, 0, 30_000), (12, 18, 40, 21)]
    began = time.time()
    got = [x.p_value for x in metrics.fisher(spark.createDataFrame(rows, "a long, b long, c long, d long").coalesce(1), "a", "b", "c", "d").collect()]
    assert time.time() - began < 30
    lg = math.lgamma
    for (a, b, c, d), p in zip(rows, got, strict=True):
        r, k, n = a + b, a + c, a + b + c + d
        base = lg(r + 1) + lg(n - r + 1) + lg(k + 1) + lg(n - k + 1) - lg(n + 1)
        logp = lambda x: base - lg(x + 1) - lg(r - x + 1) - lg(k - x + 1) - lg(n - r - k + x + 1)  # noqa: B023, E731
        want = sum(math.exp(logp(x)) for x in range(max(0, r + k - n), min(r, k) + 1) if logp(x) <= logp(a) + 1e-9)
        assert math.isclose(p, min(1.0, want), rel_tol=2e-6, abs_tol=1e-300)


def test_missing_files_where_paths_repeat(spark):
    media = spark.createDataFrame([(1, "p", "x", 3), (2, "p", "y", 4), (3, None, "z", 5), (4, None, "z", 5), (5, "q", "w", 1)], "id long, path string, sha256 string, size long")
    files = spark.createDataFrame([(1, "p", "x", 3), (2, "p", "y", 5), (3, None, "z", 5), (5, "q", "v", 1)], "id long, path string, sha256 string, size long")
    assert {tuple(r) for r in rules.missing_files(media, files, ("id", "path")).collect()} == {(2, "p", "size"), (4, None, "missing"), (5, "q", "sha256")}


def test_missing_files_query_on_pages_of_one_url(spark, tmp_path):
    from tamis import plans

    spark.createDataFrame([(k, "u" if k % 2 else None, None if k == 12 else f"h{k}") for k in range(20)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {(k, "missing" if k % 5 == 0 else "size" if k % 5 == 1 else "sha256") for k in range(20) if k % 5 < 3}
    assert {(r.id, r.problem) for r in plans.QUERIES["missing_files"](spark, str(tmp_path)).collect()} == want


def test_near_groups_query_keeps_strangers_apart(spark, tmp_path):
    """Two families whose first hashes happen to be 6 bits apart."""
    from tamis import plans

    families = [(k,) for first in (79881, 208749) for k in range(first, first + 3)]
    spark.createDataFrame(families, "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.id, r.root, r.size) for r in plans.QUERIES["near_groups"](spark, str(tmp_path)).collect()} == {(k, k // 3 * 3, 3) for (k,) in families}
