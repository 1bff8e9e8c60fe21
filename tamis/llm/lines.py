"""Line dedup by overlapping windows of three lines, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm._shared import fresh, save

BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _solid(lines: Column) -> Column:
    """Positions of the lines that aren't blank."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.btrim(F.get(lines, i), F.lit(BLANK)) != "")


def windows(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, text_hash, nth, window): a row for each window of ``width`` consecutive lines that aren't blank.

    ``nth`` is the first line's number among those lines; ``window`` a 128-bit hash of the lines,
    trimmed at both ends. A row of ``docs`` is named by its id and its text's hash; rows alike in
    both give equal rows here, which are one occurrence.
    """
    here = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.filter(F.transform(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "").alias("solid")).where(F.size("solid") >= width)
    marks = here.select("id", "text_hash", F.transform("solid", lambda x: F.md5(x)).alias("marks"))
    joined = F.transform(F.sequence(F.lit(0), F.size("marks") - width), lambda i: F.unhex(F.md5(F.concat(*(F.get(F.col("marks"), i + k) for k in range(width))))))
    return marks.select("id", "text_hash", F.posexplode(joined).alias("nth", "window"))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, text_hash, removed): the numbers, among lines that aren't blank, of those that go.

    A window's first occurrence is that of the smallest id (nulls last; then text hash, then
    place). Each later one covers its lines, but for lines that its own first occurrence in the
    same text covers; what any later occurrence covers goes.
    """
    seen = save(windows(docs, id_col, text_col, width))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "nth")
    firsts = seen.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("window", "first")
    # saved, so that the join is of two shuffles, of which a window of very many rows can be split
    later = seen.join(save(firsts).hint("merge"), "window").where(~place.eqNullSafe(F.col("first")))
    same = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.text_hash") == F.col("text_hash"))
    start = F.when(same, F.greatest(F.col("nth"), F.col("first.nth") + width)).otherwise(F.col("nth"))
    covered = later.select("id", "text_hash", F.explode(F.sequence(start, F.col("nth") + width - 1)).alias("line"))
    return covered.groupBy("id", "text_hash").agg(F.collect_set("line").alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, lines_col: str | None = None, removed_col: str | None = None) -> DataFrame:
    """``docs`` without the later occurrences of repeated windows of ``width`` lines; every row stays.

    Lines end at a line feed; blank ones (spaces, tabs, carriage returns) take no part and stay.
    Texts of fewer other lines have no window and stay as they are; a text that is covered whole
    becomes empty. Null texts come back null. Rows alike in id and text are one occurrence and
    share its result. Other columns pass through whatever their names; ``lines_col`` and
    ``removed_col`` add the numbers of lines that aren't blank and of those removed. An empty
    table gives no rows.
    """
    own, of_id, of_hash, removed, lines_at, solid_at = fresh(docs, "own", "of_id", "of_hash", "removed", "lines", "solid")
    gone = repeated_lines(docs, id_col, text_col, width).select(F.col("id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("removed").alias(removed))
    text = F.col(text_col)
    here = docs.withColumn(own, F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = here.join(save(gone).hint("merge"), (F.col(own) == F.col(of_hash)) & F.col(id_col).eqNullSafe(F.col(of_id)), "left")
    lines, solid = F.col(lines_at), F.col(solid_at)
    joined = joined.withColumn(lines_at, _lines(text)).withColumn(solid_at, _solid(lines))
    out = F.transform(F.col(removed), lambda k: F.get(solid, k.cast("int")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
    text = F.when(F.col(removed).isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    more = [F.size(solid).cast("long").alias(lines_col)] if lines_col else []
    more += [F.coalesce(F.size(removed), F.lit(0)).cast("long").alias(removed_col)] if removed_col else []
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), *more)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
s AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS nth
  FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w AS (
  SELECT doc_id, nth, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS k
  FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY nth)),
o AS (
  SELECT doc_id, nth, first_value(doc_id) OVER f AS first_doc, first_value(nth) OVER f AS first_nth
  FROM w WHERE k IS NOT NULL WINDOW f AS (PARTITION BY k ORDER BY doc_id, nth)),
c AS (
  SELECT DISTINCT o.doc_id, o.nth + j.j AS nth
  FROM o, (VALUES (0), (1), (2)) AS j(j)
  WHERE (o.doc_id <> o.first_doc OR o.nth <> o.first_nth)
    AND NOT (o.doc_id = o.first_doc AND o.nth + j.j < o.first_nth + 3)),
g AS (SELECT s.doc_id, s.pos FROM s JOIN c ON s.doc_id = c.doc_id AND s.nth = c.nth),
t AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
         count(g.pos) AS n_removed
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
       coalesce(n.n_lines, 0) AS n_lines, t.n_removed
FROM documents d JOIN t ON d.doc_id = t.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
