"""Queries on duplicates, groups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.labels import event_id, hamming_hex, normalise_prompt, safe_identifier, stable_seed, unit_hash
from tamis.operators import dedup, ordered, splits
from tamis.plans.judges import rounded
from tamis.plans.registry import query, table

#: Hashes of 64 bits that differ little within a family of three documents.
HASHED = """h0 AS (SELECT doc_id, doc_id // 3 AS fam, md5((doc_id // 3)::VARCHAR) AS m FROM documents),
h AS (SELECT doc_id, fam, ('0x' || substr(m, 1, 8))::BIGINT AS hi, xor(('0x' || substr(m, 9, 8))::BIGINT, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 37 ELSE 1285 END) AS lo FROM h0)"""


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    m = F.md5(F.floor(F.col("doc_id") / 3).cast("string"))
    part = lambda at: F.conv(F.substring(m, at, 8), 16, 10).cast("long")
    twist = F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, 37).otherwise(1285).cast("long")
    return table(spark, sf, "documents").select("doc_id", part(1).alias("hi"), part(9).bitwiseXOR(twist).alias("lo"), part(17).alias("hi2"), part(25).bitwiseXOR(twist).alias("lo2"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_texts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_first(table(spark, sf, "documents"), "doc_id", F.col("text")).select("doc_id")


@query("""WITH d AS (SELECT doc_id, md5(text) AS k1, trim(regexp_replace(lower(text), '[^0-9a-z一-鿿]+', ' ', 'g')) AS k2 FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY doc_id) AS r FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN k2 = '' THEN doc_id::VARCHAR || '#' ELSE k2 END ORDER BY doc_id) AS q FROM a WHERE r = 1)
SELECT doc_id, md5(k2) AS prompt_md5 FROM b WHERE q = 1""")
def first_wins_chain(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("k1"), normalise_prompt(F.col("text")).alias("prompt"))
    return dedup.first_occurrences(d, "doc_id", "k1", "prompt").select("doc_id", F.md5("prompt").alias("prompt_md5"))


@query("WITH d AS (SELECT doc_id, md5(text) AS k, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) SELECT k AS text_md5, doc_id, f AS first_line FROM d WHERE doc_id > f")
def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_report(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5")), "text_md5", "doc_id")


@query("WITH " + HASHED + " SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance FROM h a JOIN h b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6")
def near_hash_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_hash_pairs(_hashed(spark, sf), "doc_id", ("hi", "lo"), 6, also=(("hi", "lo"), 8))


@query("WITH " + HASHED + ", p AS (SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS d FROM h a JOIN h b ON a.doc_id < b.doc_id) SELECT b AS id, arg_min(a, {'d': d, 'a': a}) AS nearest, min(d) AS distance FROM p WHERE d <= 8 GROUP BY b")
def nearest_hash(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.nearest_earlier(dedup.near_hash_pairs(_hashed(spark, sf), "doc_id", ("hi", "lo"), 8))


@query("SELECT doc_id AS id, doc_id // 3 * 3 AS root, format('g{:04d}', doc_id // 3) AS group_id, count(*) OVER (PARTITION BY doc_id // 3) AS size FROM documents")
def near_groups(spark: SparkSession, sf: str) -> DataFrame:
    """By two hashes, as one alone brings strangers within 6 bits by chance: from 200 000 documents on in these tables."""
    h = _hashed(spark, sf)
    return dedup.near_groups(h, "doc_id", dedup.near_hash_pairs(h, "doc_id", ("hi", "lo"), 6, also=(("hi2", "lo2"), 8)))


@query("SELECT doc_id, bit_count(xor(('0x' || substr(md5(text), 1, 8))::BIGINT, ('0x' || substr(md5(lang), 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(md5(text), 9, 8))::BIGINT, ('0x' || substr(md5(lang), 9, 8))::BIGINT)) AS distance FROM documents")
def hash_distance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", hamming_hex(F.substring(F.md5("text"), 1, 16), F.substring(F.md5("lang"), 1, 16)).alias("distance"))


@query("""WITH g AS (SELECT md5(text) AS text_md5, count(*) AS n, count(DISTINCT source) AS s, count(DISTINCT lang) AS l FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT text_md5, n, s = 1 AND l = 1 AS identical, array_to_string(list_filter([CASE WHEN s > 1 THEN 'source' END, CASE WHEN l > 1 THEN 'lang' END], lambda x: x IS NOT NULL), '|') AS differing FROM g""")
def duplicate_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.conflicts(table(spark, sf, "documents").withColumn("text_md5", F.md5("text")), "text_md5", ["source", "lang"])


@query("SELECT l_orderkey, max(n) AS observed, count(*) FILTER (l_linenumber <> n) AS n_wrong FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey")
def declared_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.group_sizes(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT source, doc_id, turn FROM d")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.interleave(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE n_chars >= 200) WHERE n <= 5")
def provider_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.capped(table(spark, sf, "documents").where("n_chars >= 200").select("source", "doc_id"), "source", "doc_id", 5)


@query("WITH d AS (SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 2 THEN 'stratum' ELSE 'backfill' END AS picked FROM documents) SELECT * FROM d ORDER BY picked DESC, doc_id LIMIT 12")
def stratum_then_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.top_up(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 2, 12)


SPLIT = """WITH RECURSIVE ev AS (SELECT o_orderkey AS id, o_custkey AS recipe, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey // 70 END AS batch FROM orders),
ed AS (SELECT ev.id, f.first FROM ev JOIN (SELECT recipe, min(id) AS first FROM ev GROUP BY 1) f USING (recipe) UNION SELECT ev.id, f.first FROM ev JOIN (SELECT batch, min(id) AS first FROM ev WHERE batch IS NOT NULL GROUP BY 1) f USING (batch)),
e2 AS (SELECT id AS a, first AS b FROM ed UNION SELECT first, id FROM ed),
cc(id, root) AS (SELECT id, id FROM ev UNION SELECT e2.b, cc.root FROM cc JOIN e2 ON cc.id = e2.a WHERE e2.b > cc.root),
comp AS (SELECT id, min(root) AS component FROM cc GROUP BY id)"""


def _split_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("recipe"), F.when(F.col("o_orderkey") % 7 == 0, F.floor(F.col("o_orderkey") / 70)).alias("batch"))


@query("""WITH ev AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, max((o_orderkey % 97 = 0)::INT) OVER (PARTITION BY o_custkey) AS taint FROM orders),
u AS (SELECT *, (('0x' || substr(sha256('2026|' || component), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0 AS u FROM ev)
SELECT id, component, CASE WHEN u < 0.1 THEN CASE WHEN taint = 1 THEN 'val' ELSE 'external_test' END WHEN u < 0.25 THEN 'val' ELSE 'train' END AS split FROM u""")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.hash_split(_split_events(spark, sf), "id", ["recipe"], "2026", 0.1, 0.15, F.col("id") % 97 == 0)


@query(name="shared_field_split")
def shared_field_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.hash_split(_split_events(spark, sf), "id", ["recipe", "batch"], "2026", 0.1, 0.15)


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS n_splits, array_to_string(list_sort(list(DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END)), '|') AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) > 1")
def split_leaks(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("o_orderkey") % 3 == 0, "test").when(F.col("o_orderkey") % 3 == 1, "train").otherwise("val")
    return splits.leaks(table(spark, sf, "orders").select("o_custkey", split.alias("split")), "o_custkey", "split")


MAJ = "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS p FROM orders GROUP BY ALL), maj AS (SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS r FROM c) WHERE r = 1)"


@query(MAJ + " SELECT o_custkey, o_orderpriority FROM maj")
def majority_labels(spark: SparkSession, sf: str) -> DataFrame:
    return splits.majority_label(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query(MAJ + """, k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7|' || o_custkey), o_custkey) AS nth, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM maj),
t AS (SELECT *, least(greatest(round_even(n * 0.15, 0)::INT, (n >= 3)::INT), greatest(n - 2, 0)) AS nt FROM k), v AS (SELECT *, least(greatest(round_even(n * 0.15, 0)::INT, (n >= 2)::INT), greatest(n - nt - 1, 0)) AS nv FROM t)
SELECT o_custkey, o_orderpriority, CASE WHEN nth <= nt THEN 'test' WHEN nth <= nt + nv THEN 'val' ELSE 'train' END AS split FROM v""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    groups = splits.majority_label(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")
    return splits.stratified_split(groups, "o_custkey", "o_orderpriority", "7", 0.15, 0.15)


@query("SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY sha256('17|' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings")
def folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.fold_of(table(spark, sf, "embeddings"), "vec_id", "label", "17", 5)


@query()
def balanced_split(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("label"))
    return splits.balanced_split(groups, "o_custkey", "n", "label", {"train": 0.7, "val": 0.15, "test": 0.15}, "5")


@query("SELECT vec_id, label, round((CASE WHEN vec_id % 4 = 0 THEN 2.0 ELSE 1.0 END) / count(*) OVER (PARTITION BY label), 6) AS weight FROM embeddings")
def sampling_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = F.when(F.col("vec_id") % 4 == 0, 2.0).otherwise(1.0)
    return rounded(splits.sampling_weights(table(spark, sf, "embeddings").select("vec_id", "label"), "label", w))


@query()
def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    w = splits.sampling_weights(table(spark, sf, "embeddings").select("vec_id", "label"), "label")
    return splits.weighted_order(w, "weight", "3", "vec_id").orderBy("draw_key", "vec_id").limit(50)


@query("""SELECT page_id, 'RW_web_' || substr(sha256('web' || chr(0) || page_id), 1, 20) AS event_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-._')[1:64], ''), 'none') AS safe,
round((('0x' || substr(sha256('9|' || page_id), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0, 9) AS u, ('0x' || substr(sha256('a::' || page_id), 1, 8))::BIGINT & 2147483647 AS seed31 FROM pages""")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    pid = F.col("page_id").cast("string")
    return table(spark, sf, "pages").select("page_id", event_id(F.lit("web"), pid).alias("event_id"), safe_identifier(F.col("url"), "none").alias("safe"), F.round(unit_hash("9", pid), 9).alias("u"), stable_seed(F.lit("a"), pid).alias("seed31"))
