"""Queries on joins, sets, counts, series and streams' table forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions.labels import on_host, provider_of, value_range
from tamis.operators import audits, ordered, rules, series
from tamis.plans.judges import rounded
from tamis.plans.registry import query, table
from tamis.sources.scan import image_labels
from tamis.streaming import stateful


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def filled_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audits.filled_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL")
def release_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT lang, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality = 0) AS rejected, count(*) AS n, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def accepted_by_group(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rounded(j.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count("*").alias("n"), F.avg(F.col("quality").cast("double")).alias("rate")))


@query("""WITH g AS (SELECT n_nationkey, b.p_brand FROM nation, (SELECT DISTINCT p_brand FROM part) b), s AS (SELECT DISTINCT s_nationkey AS n_nationkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT g.n_nationkey, g.p_brand, 'missing' AS side FROM g LEFT JOIN s USING (n_nationkey, p_brand) WHERE s.p_brand IS NULL""")
def absent_cells(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    grid = t("nation").select("n_nationkey").crossJoin(F.broadcast(t("part").select("p_brand").distinct()))  # two dimensions
    seen = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_nationkey").alias("n_nationkey"), "p_brand").distinct()
    return audits.absent_cells(grid, seen, ["n_nationkey", "p_brand"])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT count(a.id) AS n_a, count(b.id) AS n_b, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS n_both, count(*) FILTER (b.id IS NULL) AS only_a, count(*) FILTER (a.id IS NULL) AS only_b, count(*) FILTER (b.id IS NULL) = 0 AND count(*) FILTER (a.id IS NULL) = 0 AS equal FROM a FULL JOIN b ON a.id = b.id""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    return audits.set_difference(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "id")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5")
def in_every(spark: SparkSession, sf: str) -> DataFrame:
    return audits.in_every(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 5)


@query("SELECT l.doc_id, quality, coalesce(d.lang, 'none') AS lang, CASE WHEN d.source IS NULL OR d.doc_id % 2 = 0 THEN 'embedded' ELSE d.source END AS creator FROM labels l LEFT JOIN documents d USING (doc_id)")
def attribution_fallback(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 1, F.col("source")).alias("creator"))
    return table(spark, sf, "labels").join(d, "doc_id", "left").select("doc_id", "quality", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("creator", F.lit("embedded")).alias("creator"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT d.source, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY 1")
def provenance_of_selected(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT 'rows_' || lang AS name, count(*)::DOUBLE AS v, lang FROM documents GROUP BY lang), p AS (SELECT name, CASE WHEN lang = 'de' THEN v + 1 ELSE v END AS v FROM m WHERE lang <> 'fr' UNION ALL SELECT 'rows_it', 3)
SELECT coalesce(p.name, m.name) AS name, coalesce(p.v, -1) AS published, coalesce(m.v, -1) AS measured, CASE WHEN p.v IS NULL THEN 'unpublished' WHEN m.v IS NULL THEN 'unmeasured' WHEN abs(p.v - m.v) <= 0.0005 THEN 'match' ELSE 'differs' END AS status FROM p FULL JOIN m ON p.name = m.name""")
def reconciled(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("value")).withColumn("name", F.concat(F.lit("rows_"), "lang"))
    p = m.where("lang <> 'fr'").select("name", F.when(F.col("lang") == "de", F.col("value") + 1).otherwise(F.col("value")).alias("value")).unionByName(spark.createDataFrame([("rows_it", 3.0)], "name string, value double"))
    return audits.reconcile(p, m.select("name", "value")).fillna(-1.0, ["published", "measured"])


@query("SELECT count(*) AS n, round(max(abs(a.embedding[1] - b.embedding[1])), 6) AS max_abs, 0::BIGINT AS n_unmatched FROM embeddings a JOIN embeddings b USING (vec_id)")
def largest_difference(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return rounded(audits.largest_difference(e, e.select("vec_id", F.col("embedding")), "vec_id", "embedding").select("n", F.col("max_abs").cast("double").alias("max_abs"), "n_unmatched"))


@query("SELECT count(*) AS n, count(DISTINCT source) AS n_ids, count(*) FILTER (n_chars < 300) AS n_short, count(DISTINCT CASE WHEN n_chars < 300 THEN source END) AS ids_short, count(*) FILTER (lang = 'en') AS n_english, count(DISTINCT CASE WHEN lang = 'en' THEN source END) AS ids_english FROM documents")
def corpus_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    return audits.hygiene(table(spark, sf, "documents"), "source", {"short": F.col("n_chars") < 300, "english": F.col("lang") == "en"})


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1) SELECT c_mktsegment, n, round(mean, 4) AS mean, low, high, round(high - low, 4) AS spread, round(mean - (SELECT mean FROM s WHERE c_mktsegment = 'MACHINERY'), 4) AS delta FROM s""")
def arms_against_reference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audits.summarise_runs(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "MACHINERY"), 4)


@query("SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN l.quality ELSE d.doc_id % 2 END AS quality, coalesce(l.quality <> d.doc_id % 2, false) AS changed FROM documents d LEFT JOIN labels l USING (doc_id)")
def relabelled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return audits.relabelled(d, table(spark, sf, "labels"), "doc_id", "quality")


@query("SELECT l_orderkey, l_linenumber, 'l_tax' AS metric, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def long_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return audits.long_form(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


@query("""WITH s AS (SELECT p_type, arg_max(p_partkey, {'a': p_size, 'b': -p_partkey}) AS largest, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part WHERE p_retailprice > 950 GROUP BY 1) SELECT * FROM s""")
def extremes_over_floor(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_retailprice > 950")
    return p.groupBy("p_type").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("largest"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("""WITH k AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT * FROM k WHERE rank <= 3""")
def top_three(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("""WITH t AS (SELECT 'a' AS tag, doc_id AS id, quality::VARCHAR AS lang FROM labels UNION ALL SELECT 'b', doc_id, lang FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tag) AS n FROM t) SELECT tag, id, lang AS value FROM k WHERE n = 1""")
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "labels").select(F.lit("a").alias("tag"), F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("value"))
    b = table(spark, sf, "documents").select(F.lit("b").alias("tag"), F.col("doc_id").alias("id"), F.col("lang").alias("value"))
    return ordered.first_by(a.unionByName(b), ["id"], [F.col("tag")])


@query("""SELECT image_id, url, array_to_string(list_sort(list(DISTINCT name)), '|') AS labels FROM (SELECT l_orderkey AS image_id, p_type AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.05 AND regexp_matches(lower(p_type), 'pro|eco')) JOIN (SELECT o_orderkey AS image_id, o_orderpriority AS url FROM orders) USING (image_id) GROUP BY ALL""")
def image_labels_join(spark: SparkSession, sf: str) -> DataFrame:
    classes = table(spark, sf, "part").select(F.col("p_partkey").alias("mid"), F.col("p_type").alias("name"))
    labels = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("mid"), F.col("l_discount").alias("confidence"))
    meta = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("url"))
    return image_labels(classes, labels, meta, "pro|eco", 0.05)


FRAMES = "WITH fr AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type FROM events)"


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("video"), (F.row_number().over(w) - 1).alias("frame"), "value", "event_type")


SUST = ", h AS (SELECT video, frame, value > {t} AND lead(value) OVER (PARTITION BY video ORDER BY frame) > {t} AS ok FROM fr)"


@query(FRAMES + SUST.format(t=12.0) + " SELECT video, coalesce(min(frame) FILTER (ok), -1) AS first FROM h GROUP BY video")
def sustained_first(spark: SparkSession, sf: str) -> DataFrame:
    return series.sustained_first(_frames(spark, sf), "video", "frame", F.col("value") > 12.0).fillna(-1, ["first"])


@query(FRAMES + """, h AS (SELECT video, frame, value > 30 AND lead(value) OVER w > 30 AS nz, value < 3 AND lead(value) OVER w < 3 AS lq FROM fr WINDOW w AS (PARTITION BY video ORDER BY frame)), f AS (SELECT video, min(frame) FILTER (nz) AS n, min(frame) FILTER (lq) AS l FROM h GROUP BY video),
r AS (SELECT video, n, l, n IS NOT NULL AND (l IS NULL OR n <= l) AS u FROM f) SELECT video, coalesce(CASE WHEN u THEN n WHEN l IS NOT NULL THEN greatest(l - 1, 0) END, -1) AS release, coalesce(CASE WHEN u THEN n + 5 WHEN l IS NOT NULL THEN greatest(l - 1, 0) + 5 END, -1) AS target, CASE WHEN u THEN 'nozzle' WHEN l IS NOT NULL THEN 'liquid' ELSE 'abstain' END AS method FROM r""")
def release_choice(spark: SparkSession, sf: str) -> DataFrame:
    f = _frames(spark, sf)
    n = series.sustained_first(f, "video", "frame", F.col("value") > 30)
    liquid = series.sustained_first(f, "video", "frame", F.col("value") < 3)
    return series.release(n, liquid, "video", 0.5).fillna(-1, ["release", "target"])


@query(FRAMES + ", n AS (SELECT video, count(*) AS n FROM fr GROUP BY video) SELECT video, n, round(median(value), 6) AS baseline FROM fr JOIN n USING (video) WHERE frame < greatest(2, least(n // 5, 6)) GROUP BY ALL")
def baselines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.baseline(_frames(spark, sf), "video", "frame", "value", 8.0))


@query(FRAMES + " SELECT video, 10::BIGINT AS target, count(*) AS n, round(median(value), 6) AS median, max(value) AS highest FROM fr WHERE frame BETWEEN 9 AND 11 GROUP BY video")
def around_target(spark: SparkSession, sf: str) -> DataFrame:
    f = _frames(spark, sf)
    return rounded(series.around(f, f.select("video").distinct().withColumn("target", F.lit(10).cast("long")), "video", "frame", "value", 1))


@query(FRAMES + " SELECT video, arg_min(event_type, frame) AS first, arg_max(event_type, frame) AS last, count(*) AS n FROM fr GROUP BY video")
def lifecycles(spark: SparkSession, sf: str) -> DataFrame:
    return series.lifecycle(_frames(spark, sf), "video", "frame", "event_type")


@query("""WITH b AS (SELECT event_type AS kind, CASE WHEN user_id % 2 = 0 THEN 'near' ELSE 'far' END AS place, value - 10 AS e, value < 20 AS g FROM events), a AS (SELECT 'kind' AS axis, kind AS bucket, e, g FROM b UNION ALL SELECT 'place', place, e, g FROM b)
SELECT axis, bucket, count(*) AS n, count(*) FILTER (g) AS n_graded, round(avg((NOT g)::INT), 6) AS abstention, round(avg(abs(e)), 6) AS mae_all, round(avg(abs(e)) FILTER (g), 6) AS mae_graded FROM a GROUP BY ALL""")
def bench_buckets(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, "near").otherwise("far").alias("place"), (F.col("value") - 10).alias("error"), (F.col("value") < 20).alias("graded"))
    return rounded(series.bench(e, ["kind", "place"], "error", "graded"))


@query(name="rate_limited")
def rate_limited(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return stateful.limited(e, 3600.0 * 6, 2)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n, max(ts) AS last FROM n GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return series.sessions(table(spark, sf, "events"), "user_id", "ts", 3600)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stateful.windowed(table(spark, sf, "events"), "ts", "event_type", "1 hour"), 4)


@query("""WITH n AS (SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 100)) SELECT user_id, min(event_id) AS event_id FROM n GROUP BY user_id""")
def resumed_intake(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id")
    return stateful.resumed_first_wins(e, e.where("event_id < 100"), "user_id", "event_id")


@query("SELECT 'ids are unique' AS name, count(*) = 0 AS ok, count(*) AS n FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'labels have documents', count(*) = 0, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'texts are long', count(*) = 0, count(*) FROM documents WHERE n_chars < 200")
def invariants(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return rules.assertions(spark, {"ids are unique": d.groupBy("doc_id").count().where("count > 1"), "labels have documents": lab.join(d, "doc_id", "left_anti"), "texts are long": d.where("n_chars < 200")})


@query("""WITH k AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS nth, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_nationkey, s_suppkey FROM k WHERE nth = s_nationkey % n""")
def one_per_nation(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.one_per_level(table(spark, sf, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey")


@query("""WITH m AS (SELECT source, avg(n_chars) AS value FROM documents GROUP BY source) SELECT source, row_number() OVER (ORDER BY value DESC, source) AS rank FROM m""")
def best_to_worst(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.best_first(table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("value")), "value", "source").select("source", "rank")


@query("""WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS q FROM labels WHERE doc_id % 5 <> 0)
SELECT 'only_left' AS "check", count(*) AS n FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT 'only_right', 0 UNION ALL SELECT 'quality_differs', count(*) FROM a JOIN b USING (doc_id) WHERE quality IS DISTINCT FROM q""")
def strict_join(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "labels").select("doc_id", "quality")
    b = a.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("q"))
    return audits.joined_strictly(a, b, "doc_id", {"quality": "q"})


@query("""SELECT event_type, format('{:.3f}-{:.3f}', min(value), max(value)) AS range FROM events GROUP BY event_type""")
def value_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(value_range(F.col("value")).alias("range"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '?' ELSE 'web' END AS provider, '/data/' || page_id || '/work/x' AS path FROM pages""")
def providers_and_paths(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    event = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("EV_"), i)).otherwise(F.concat(F.lit("RW_web_"), i))
    return table(spark, sf, "pages").select("page_id", provider_of(event).alias("provider"), on_host(F.concat(F.lit("/work/"), i, F.lit("/work/x")), "/work/", "/data/").alias("path"))
