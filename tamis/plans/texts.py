"""Queries on text as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.labels import keyword_family, structural_family
from tamis.operators import ordered, textual
from tamis.plans.registry import query, table

FAMILIES = {"article": ["the", "das", "la"], "link": ["and", "und", "et"], "place": ["from", "von", "dans"]}
#: Lines end at a line feed, a carriage return or both.
ENDED = "replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
LINES = f"WITH l AS (SELECT doc_id, unnest(string_split({ENDED}, chr(10))) AS line, unnest(range(len(string_split({ENDED}, chr(10))))) AS line_no FROM documents)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return textual.lines_of(table(spark, sf, "documents"), "doc_id", "text")


@query(LINES + " SELECT doc_id, line_no, md5(line) AS line_md5 FROM l")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


def _word(words: list[str]) -> str:
    return rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})s?($|[^\p{{L}}\p{{N}}_])')::INT"


@query(f"""SELECT doc_id, CASE WHEN a + b + c = 0 THEN 'uninformative' WHEN a + b + c > 1 THEN 'ambiguous' WHEN a = 1 THEN 'article' WHEN b = 1 THEN 'link' ELSE 'place' END AS family, CASE WHEN contains(lower(text), 'tion') THEN 'ending' WHEN contains(lower(text), 'th') THEN 'digraph' ELSE 'other' END AS structure
FROM (SELECT doc_id, text, {_word(FAMILIES['article'])} AS a, {_word(FAMILIES['link'])} AS b, {_word(FAMILIES['place'])} AS c FROM documents)""")
def keyword_families(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", keyword_family(t, FAMILIES).alias("family"), structural_family(t, [("tion", "ending"), ("th", "digraph")]).alias("structure"))


@query(LINES + ", s AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '^(Th|An)') THEN line[1:2] END AS h FROM l) SELECT doc_id, line_no, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '-') AS section FROM s")
def carried_sections(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.sections(_lines(spark, sf), "doc_id", "line_no", "line", "^(Th|An)").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce("section", F.lit("-")).alias("section"))


@query(LINES + ", m AS (SELECT doc_id, line_no, line, max(regexp_matches(line, 'with')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS k FROM l) SELECT doc_id, line_no, k = 1 AS marked FROM m WHERE regexp_matches(line, 'from')")
def metric_markers(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.near_marker(_lines(spark, sf), "doc_id", "line_no", "line", "from", "with", 2).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "marked")


@query(f"WITH t AS (SELECT doc_id, replace({ENDED}, '. ', chr(10) || chr(10)) AS t FROM documents)," + """ l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS line_no FROM t),
m AS (SELECT *, trim(line) = '' AS blank, coalesce(trim(lag(line) OVER w) = '', true) AS before, regexp_matches(line, '^\\s*([-*+]|[0-9]+\\.)\\s') AS op FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), p AS (SELECT *, sum((NOT blank AND (before OR op))::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS paragraph FROM m)
SELECT doc_id, paragraph, min(line_no) AS first_line, count(*) AS n_lines, md5(string_agg(trim(line), ' ' ORDER BY line_no)) AS body_md5 FROM p WHERE NOT blank GROUP BY doc_id, paragraph""")
def text_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n\n")).alias("text"))
    p = ordered.paragraphs(textual.lines_of(d, "doc_id", "text"), "doc_id", "line_no", "line")
    return p.select("doc_id", "paragraph", F.col("first_line").cast("long").alias("first_line"), "n_lines", F.md5("body").alias("body_md5"))


@query("""WITH t AS (SELECT n_nationkey, n_name, n_regionkey FROM nation) SELECT n_nationkey, 1::BIGINT AS line_no, 'name' AS "column", n_name AS cell FROM t UNION ALL SELECT n_nationkey, 1, 'region', n_regionkey::VARCHAR FROM t""")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    md = F.concat(F.lit("|---|---|\n| "), "n_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" |\nnot a row"))
    lines = textual.lines_of(n.select("n_nationkey", md.alias("md")), "n_nationkey", "md")
    return textual.pipe_table(lines, "n_nationkey", ["name", "region"]).select("n_nationkey", F.col("line_no").cast("long").alias("line_no"), "column", "cell")


@query("""SELECT c_custkey, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer""")
def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    text = F.concat(F.lit("---\nname: "), "c_name", F.lit("\nsegment:  "), "c_mktsegment", F.lit("\n---\nbody: none"))
    return textual.front_matter(c.select("c_custkey", text.alias("text")), "c_custkey", "text")


@query(r"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.;!?]\s+|\n'), lambda x: trim(x)), lambda x: x <> '') AS cl FROM documents) SELECT doc_id, len(cl) AS n_clauses, len(list_filter(cl, lambda x: regexp_matches(x, 'the') AND NOT regexp_matches(x, 'and'))) AS hits FROM c""")
def clause_hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(textual.clauses(F.col("text"))).alias("n_clauses"), textual.hits_outside(F.col("text"), "the", "and").alias("hits"))


@query(r"""SELECT doc_id, contains(lower(regexp_replace(text, '\s+', ' ', 'g')), 'of the-') OR contains(lower(regexp_replace(text, '\s+', ' ', 'g')), 'of the ') OR contains(lower(regexp_replace(text, '\s+', ' ', 'g')), 'of the') AS has FROM documents""")
def phrase_presence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", textual.contains_either(F.col("text"), "of the").alias("has"))


@query(LINES + r" SELECT doc_id, line_no, 'mail' AS pattern FROM l WHERE regexp_matches(line, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') UNION ALL SELECT doc_id, line_no, 'phone' FROM l WHERE regexp_matches(line, '\(\d{3}\) \d{3}-\d{4}')")
def leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    return textual.leak_scan(_lines(spark, sf), {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "phone": r"\(\d{3}\) \d{3}-\d{4}"}).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "pattern")


@query(LINES + " SELECT doc_id, line_no, regexp_matches(line, 'from') AS noted, length(line) + CASE WHEN regexp_matches(line, 'from') THEN 9 ELSE 0 END AS size FROM l")
def annotated_lines(spark: SparkSession, sf: str) -> DataFrame:
    a = textual.annotated(_lines(spark, sf), "from", " [marked]")
    return a.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("line").rlike("from").alias("noted"), F.length("line").cast("long").alias("size"))


@query("SELECT lang, count(*) AS n, count(DISTINCT text) AS exact, count(DISTINCT trim(regexp_replace(lower(text), '[^0-9a-z一-鿿]+', ' ', 'g'))) AS normalised, count(*) FILTER (contains(text, 'the ')) AS with_the FROM documents GROUP BY lang")
def prompt_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from tamis.functions.labels import normalise_prompt

    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("exact"), F.count_distinct(normalise_prompt(F.col("text"))).alias("normalised"), F.count_if(F.col("text").contains("the ")).alias("with_the"))


@query("""SELECT o_orderkey, 'containers|gpu|heartbeat|models|night_summary' AS sections, 2::BIGINT AS n_containers, (o_orderstatus = 'F')::INT::BIGINT + 1 AS n_up, 1::BIGINT AS n_models, o_custkey AS model_bytes,
CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS free_mb, CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE -1 END AS heartbeat_minutes, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '-' END AS last_summary FROM orders""")
def health_reports(spark: SparkSession, sf: str) -> DataFrame:
    o, i = table(spark, sf, "orders"), F.col("o_orderkey")
    even = i % 2 == 0
    report = F.concat_ws(
        "\n",
        F.lit("CONTAINER\tlost\tUp\n# note\n=== SECTION: containers ===\nCONTAINER\ttrain\tExited\nCONTAINER\tother\tUp 2 days"),
        F.concat(F.lit("CONTAINER\ttrain\t"), F.when(F.col("o_orderstatus") == "F", "Up 3 hours").otherwise("Exited (1)")),
        F.concat(F.lit("=== SECTION: models ===\nMODEL\tm\tbad\tx\nMODEL\tm\t"), F.col("o_custkey").cast("string"), F.lit("\tok\n\n=== SECTION: gpu ===")),
        F.concat(F.lit("GPU_MEM\t[1,2"), F.when(i % 3 != 0, F.concat(F.lit(","), i.cast("string"))).otherwise(""), F.lit("]")),
        F.concat(F.lit("=== SECTION: heartbeat ===\nHEARTBEAT\t"), F.when(even, "log\t7").otherwise("none")),
        F.concat(F.lit("=== SECTION: night_summary ===\nNIGHT_SUMMARY\t"), F.when(even, F.col("o_orderpriority")).otherwise("none")),
    )
    lines = textual.lines_of(o.select("o_orderkey", report.alias("report")), "o_orderkey", "report")
    h = textual.health(textual.sectioned(lines, "o_orderkey"), "o_orderkey")
    return h.fillna(-1, ["free_mb", "heartbeat_minutes"]).fillna("-", ["last_summary"])
