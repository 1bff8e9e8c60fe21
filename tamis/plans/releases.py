"""Queries on events and releases, yardsticks, protocols, and small dimension products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import events, metrics, resample, selection, splits
from tamis.plans.data import PRED, THRESHOLD, decoded_predictions
from tamis.plans.judges import rounded
from tamis.plans.predictions import AXES, CAND
from tamis.plans.registry import query, table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    c = p.select(F.lit("web").alias("provider"), i.cast("string").alias("source_id"), "url", F.concat(F.lit("c"), (i % 7).cast("string")).alias("creator"), F.lit("CC BY 4.0").alias("licence"), (3 + i % 5).alias("level"), (i % 120 / 100).alias("confidence"), F.when(i % 3 == 0, F.lit("2024-01-01T00:00:00Z")).alias("captured_at"), F.lit("2024-02-02T00:00:00Z").alias("harvested_at"), F.md5("html").alias("sha256"), F.length("html").cast("long").alias("bytes"))
    return events.build_events(c)


EV = "WITH ev AS (SELECT page_id, 'RW_web_' || substr(sha256('web' || chr(0) || page_id), 1, 20) AS event_id, 3 + page_id % 5 AS level, least(0.95, page_id % 120 / 100) AS conf, url, 'c' || page_id % 7 AS creator, 'media/' || page_id || '.jpg' AS path, md5(html) AS sha256 FROM pages)"


@query(EV + " SELECT event_id, level, round(conf, 6) AS confidence, CASE WHEN page_id % 3 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-02-02T00:00:00Z' END AS captured_at, 'RW_web' AS kitchen_id, path, 'c' || page_id % 7 AS creator FROM ev")
def weak_events(spark: SparkSession, sf: str) -> DataFrame:
    m = F.get("media_files", F.lit(0))["path"]
    return rounded(_events(spark, sf).select("event_id", F.col("level_weak").cast("long").alias("level"), F.col("weak_confidence").alias("confidence"), "captured_at", "kitchen_id", m.alias("path"), "provenance.creator"))


@query(EV + " SELECT event_id, 'web' AS provider, page_id::VARCHAR AS source_id, url, creator, 'CC BY 4.0' AS licence, path, sha256 FROM ev")
def attribution_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return events.attribution(_events(spark, sf))


@query(EV + " SELECT event_id, 'rel/' || path AS image_path, CASE WHEN page_id % 10 = 0 THEN 7 ELSE level END AS level, 'train' AS split, 'RW_web/train' AS group_id, 'real_weak' AS source FROM ev")
def release_manifest(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    labels = e.where(F.col("provenance.source_id").cast("long") % 10 == 0).select("event_id", F.lit(7).alias("level"), F.lit(0.5).alias("confidence"))
    out = events.with_path_prefix(events.with_weak_label(e, labels), F.lit("rel"))
    return events.flat_manifest(out, ["kitchen_id", "split"]).withColumn("level", F.col("level").cast("long"))


@query(EV + " SELECT 'real_weak' AS release_source, event_id, path, 'image' AS type, sha256, length(html) AS bytes FROM ev JOIN pages USING (page_id)")
def release_media(spark: SparkSession, sf: str) -> DataFrame:
    return events.bundle(_events(spark, sf))["media_manifest"]


@query("SELECT 'real_weak' AS source, 'train' AS split, count(*) AS n, count(*) AS n_media FROM pages")
def release_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return events.bundle(_events(spark, sf))["source_counts"]


@query("SELECT 'real_weak' AS source, 'web' AS provider, 'CC BY 4.0' AS licence, count(*) AS n FROM pages")
def release_licences(spark: SparkSession, sf: str) -> DataFrame:
    return events.bundle(_events(spark, sf))["licence_manifest"]


@query("SELECT s_suppkey, format('EV-{:04d}', row_number() OVER (ORDER BY s_name)) AS number FROM supplier")
def numbered_specimens(spark: SparkSession, sf: str) -> DataFrame:
    return events.numbered(table(spark, sf, "supplier"), "s_name").select("s_suppkey", "number")


@query("SELECT r_name, n_name, 'dish of ' || n_name || ' in ' || r_name AS prompt FROM region, nation")
def prompt_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = {"n_name": table(spark, sf, "nation").select("n_name"), "r_name": table(spark, sf, "region").select("r_name")}
    return events.prompts(d, "dish of %s in %s").select("r_name", "n_name", "prompt")


@query("SELECT o_orderkey, o_orderstatus <> 'F' AS passed, CASE WHEN o_orderkey % 3 = 0 THEN 'side' WHEN o_orderkey % 3 = 1 THEN 'top' ELSE '' END AS missing FROM orders")
def capture_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.create_map(F.lit("fork"), F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass"), F.lit("syringe"), F.lit("na")).alias("t"), F.array(F.lit("top"), F.lit("side")).alias("want"), F.when(i % 3 == 0, F.array(F.lit("top"))).when(i % 3 == 1, F.array(F.lit("side"))).otherwise(F.array(F.lit("top"), F.lit("side"))).alias("have"))
    return events.capture_outcome(o, "t", "want", "have").select("o_orderkey", "passed", "missing")


@query(PRED + """, tr AS (SELECT 'plain' AS yardstick, vec_id AS event_id, label % 5 AS label FROM embeddings UNION ALL SELECT 'shifted', vec_id, (label + 1) % 5 FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'tiny', vec_id, label % 5 FROM embeddings WHERE vec_id < 10),
j AS (SELECT yardstick, seed, tr.label::DOUBLE AS t, pred::DOUBLE AS p FROM dec JOIN tr USING (event_id)), k AS (SELECT yardstick, seed, 1 - avg((t-p)*(t-p)) / (avg(t*t) + avg(p*p) - 2*avg(t)*avg(p)) AS q FROM j GROUP BY ALL HAVING count(*) >= 20)
SELECT yardstick, 'v1' AS version, count(*) AS n_runs, round(avg(q), 6) AS mean, round(min(q), 6) AS low, round(max(q), 6) AS high FROM k GROUP BY yardstick""")
def yardstick_matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "event_id")
    t = e.select(F.lit("plain").alias("yardstick"), "event_id", (F.col("label") % 5).alias("label"))
    t = t.unionByName(e.where("event_id % 2 = 0").select(F.lit("shifted").alias("yardstick"), "event_id", ((F.col("label") + 1) % 5).alias("label"))).unionByName(e.where("event_id < 10").select(F.lit("tiny").alias("yardstick"), "event_id", (F.col("label") % 5).alias("label")))
    return rounded(metrics.yardsticks(decoded_predictions(spark, sf).select(F.lit("v1").alias("version"), "seed", "event_id", "pred"), t))


@query(PRED + f", q AS (SELECT seed, count(*) FILTER (conf >= {THRESHOLD}) / count(*) AS coverage FROM dec GROUP BY seed), c AS (SELECT 'rank' AS rule, seed, avg((pred = label)::INT) AS acc, avg(abs(pred - label)) AS mae FROM dec GROUP BY seed UNION ALL SELECT 'argmax', seed, avg((argmax = label)::INT), avg(abs(argmax - label)) FROM dec GROUP BY seed) SELECT rule, seed, round(acc, 6) AS accuracy, round(mae, 6) AS mae, round(coverage, 6) AS coverage FROM c JOIN q USING (seed)")
def rule_comparison(spark: SparkSession, sf: str) -> DataFrame:
    d = decoded_predictions(spark, sf)
    rules = F.explode(F.array(F.struct(F.lit("rank").alias("rule"), F.col("pred").alias("level")), F.struct(F.lit("argmax").alias("rule"), F.col("argmax").alias("level"))))
    c = d.select("seed", "label", rules.alias("x")).groupBy("x.rule", "seed").agg(F.avg((F.col("x.level") == F.col("label")).cast("double")).alias("accuracy"), F.avg(F.abs(F.col("x.level") - F.col("label")).cast("double")).alias("mae"))
    return rounded(c.join(metrics.gate_metrics(d, ["seed"], THRESHOLD).select("seed", "coverage"), "seed"))


@query(AXES + """, s AS (SELECT 'provider' AS axis, arg_max({'v': value, 'n': n, 'e': errors}, {'r': error_rate, 'n': n, 'v': value}) AS w, sum(n) AS an, sum(errors) AS ae FROM axt WHERE axis = 'provider'),
t AS (SELECT axis, w.v AS value, w.e AS a, w.n - w.e AS b, (ae - w.e)::BIGINT AS c, (an - w.n - ae + w.e)::BIGINT AS d FROM s), x AS (SELECT t.*, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x FROM t),
p AS (SELECT *, lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) - lgamma(x+1) - lgamma(a+b-x+1) - lgamma(a+c-x+1) - lgamma(d-a+x+1) AS lp, lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1) - lgamma(a+1) - lgamma(b+1) - lgamma(c+1) - lgamma(d+1) AS l0 FROM x)
SELECT axis, value, round(least(1.0, sum(exp(lp)) FILTER (lp <= l0 + 1e-9)), 6) AS p_value FROM p GROUP BY axis, value""")
def worst_group_test(spark: SparkSession, sf: str) -> DataFrame:
    from tamis.plans.predictions import _axes

    w = metrics.worst_group(_axes(spark, sf)).where("axis = 'provider'")
    return rounded(metrics.fisher(w, "errors", "rights", "rest_errors", "rest_rights").select("axis", "value", "p_value"))


FOLDS = PRED + ", fo AS (SELECT dec.*, (row_number() OVER (PARTITION BY seed, label ORDER BY sha256('17|' || event_id), event_id) - 1) % 5 AS fold FROM dec WHERE seed = 0)"


@query(FOLDS + """, cu AS (SELECT f.k AS fold, t.conf AS threshold, count(*) FILTER (d.conf >= t.conf) AS n, count(*) AS nt FROM (SELECT unnest(range(5)) AS k) f JOIN fo t ON t.fold <> f.k JOIN fo d ON d.fold <> f.k GROUP BY f.k, t.event_id, t.conf),
th AS (SELECT fold, max(threshold) AS threshold FROM cu WHERE n >= greatest(1, least(nt, ceil(0.8 * nt - 1e-9))) GROUP BY fold)
SELECT fo.fold, round(th.threshold, 6) AS threshold, count(*) AS n, count(*) FILTER (conf >= th.threshold) AS n_covered, round(avg((pred = label)::INT) FILTER (conf >= th.threshold), 6) AS accuracy_covered FROM fo JOIN th USING (fold) GROUP BY ALL""")
def out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    d = decoded_predictions(spark, sf).where("seed = 0").select("event_id", "label", "pred", "conf")
    d = d.join(splits.fold_of(d, "event_id", "label", "17", 5).select("event_id", "fold"), "event_id")
    rest = d.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("held <> fold")
    th = selection.coverage_thresholds(rest, ["held"], (0.8,)).select(F.col("held").alias("fold"), "threshold")
    m = d.join(F.broadcast(th), "fold").withColumn("ok", F.col("conf") >= F.col("threshold"))
    return rounded(m.groupBy("fold", "threshold").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_covered"), F.avg(F.when(F.col("ok"), (F.col("pred") == F.col("label")).cast("double"))).alias("accuracy_covered")))


@query()
def threshold_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    d = decoded_predictions(spark, sf).where("seed = 0").select("event_id", "label", "pred", "conf")
    drawn = resample.stratified_draws(d, "label", "event_id", 20)
    t = selection.select_threshold(drawn, ["replicate"], target=0.2)
    return rounded(resample.interval(t, [], ["threshold", "coverage"]))


@query(CAND + "SELECT seed, count(*) AS n_candidates, round(avg(n / n_total), 6) AS mean_coverage FROM cu WHERE threshold > 0 GROUP BY seed")
def ladder_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.coverage_ladder(decoded_predictions(spark, sf), ["seed"]).groupBy("seed").agg(F.count("*").alias("n_candidates"), F.avg("coverage").alias("mean_coverage")))


@query(PRED + ", s AS (SELECT seed, label, avg((pred = label)::INT) AS recall, avg(conf) AS conf FROM dec GROUP BY ALL) SELECT seed, " + ", ".join(f"round(max(recall) FILTER (label = {k}), 6) AS recall_{k}, round(max(conf) FILTER (label = {k}), 6) AS conf_{k}" for k in range(5)) + " FROM s GROUP BY seed")
def wide_sweep(spark: SparkSession, sf: str) -> DataFrame:
    d = decoded_predictions(spark, sf).groupBy("seed").pivot("label", [0, 1, 2, 3, 4]).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("recall"), F.avg("conf").alias("conf"))
    return rounded(d.select("seed", *(F.col(f"{k}_{v}").alias(f"{v}_{k}") for k in range(5) for v in ("recall", "conf"))))


@query("SELECT doc_id, lang, source FROM documents WHERE n_chars >= 300")
def ledger_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines to the shared folder and read back by the tolerant reader."""
    import uuid

    from tamis.sources import scan, sink
    from tamis.tables import shared_dir

    path = f"{shared_dir(spark)}/tamis-ledger/{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").where("n_chars >= 300").select("doc_id", "lang", "source")
    sink.append_ledger(rows, path)
    return scan.tolerant(spark, path, rows.schema)
