"""Text as data: lines, blocks, tables, clauses, lints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.ordered import sections


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): split at line feeds and carriage returns, numbered from 0."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\r|\n")).alias("line_no", "line"))


def pipe_table(lines: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, line_no, column, cell) of lines that are table rows with that many cells (the rule line excepted)."""
    cells = F.transform(F.split(F.btrim(F.btrim(F.col("line")), F.lit("|")), r"\|"), lambda c: F.btrim(c))
    rows = lines.where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$")).withColumn("cells", cells).where(F.size("cells") == len(columns))
    return rows.select(id_col, "line_no", F.posexplode("cells").alias("k", "cell")).select(id_col, "line_no", F.element_at(F.array(*map(F.lit, columns)), F.col("k") + 1).alias("column"), "cell")


def front_matter(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, value) of ``key: value`` lines between two ``---`` lines at the top."""
    head = F.regexp_extract(text_col, r"(?s)\A---\n(.*?)\n---", 1)
    pair = docs.select(id_col, F.explode(F.split(head, "\n")).alias("l")).where(F.col("l").rlike(r"^[A-Za-z_][\w-]*\s*:"))
    return pair.select(id_col, F.regexp_extract("l", r"^([\w-]+)\s*:", 1).alias("key"), F.btrim(F.regexp_extract("l", r"^[\w-]+\s*:(.*)$", 1)).alias("value"))


def contains_either(text: Column, phrase: str) -> Column:
    """Whether a phrase occurs with its hyphens as given, as spaces, or left out; white space and case aside."""
    squeezed = F.lower(F.regexp_replace(text, r"\s+", " "))
    p = " ".join(phrase.lower().split())
    return squeezed.contains(p) | squeezed.contains(p.replace("-", " ")) | squeezed.contains(p.replace("-", ""))


def unqualified(blocks: DataFrame, body: str, metric: str, qualifiers: dict[str, str]) -> DataFrame:
    """Blocks that name the metric, with a boolean ``lacks_<name>`` for each qualifier that they don't hold."""
    named = blocks.where(F.col(body).rlike(metric))
    return named.withColumns({f"lacks_{k}": ~F.col(body).rlike(q) for k, q in qualifiers.items()})


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.;!?]\s+|\n"), lambda x: F.btrim(x)), lambda x: x != "")


def hits_outside(text: Column, wanted: str, excluded: str) -> Column:
    """How many clauses hold ``wanted`` and not ``excluded``."""
    return F.size(F.filter(clauses(text), lambda x: x.rlike(wanted) & ~x.rlike(excluded)))


def window_hits(text: Column, wanted: str, excluded: str, reach: int = 160) -> Column:
    """Whether the first ``wanted`` has no ``excluded`` within ``reach`` characters on either side; null without one."""
    at = F.regexp_instr(text, F.lit(wanted))
    near = F.substr(text, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach)) + reach)
    return F.when(at > 0, ~near.rlike(excluded))


def leak_scan(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(all columns, pattern) for each pattern that a line holds."""
    hit = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(k)) for k, p in patterns.items())))
    return lines.withColumn("pattern", F.explode(hit))


def annotated(lines: DataFrame, pattern: str, note: str) -> DataFrame:
    """Lines with the note appended where they match and lack it."""
    add = F.col("line").rlike(pattern) & ~F.col("line").contains(note)
    return lines.select(*(F.when(add, F.concat("line", F.lit(note))).otherwise(F.col("line")).alias(c) if c == "line" else F.col(c) for c in lines.columns))


def collapsed_tables(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, block, text): lines of an HTML table as one, others as they are; depth is a running sum of its tags."""
    from pyspark.sql import Window

    opens, closes = F.regexp_count("line", F.lit("(?i)<table")), F.regexp_count("line", F.lit("(?i)</table>"))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    depth = lines.withColumn("before", F.sum(opens - closes).over(w) - (opens - closes))
    block = depth.withColumn("block", F.max(F.when(F.col("before") <= 0, F.col("line_no"))).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    return block.groupBy(id_col, "block").agg(text.alias("text"))


def sectioned(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, line_no, section, keyword, fields) of a report's lines: tab-separated, under ``=== SECTION: name ===`` headers.

    Empty lines, comments (``#``) and what stands before the first header are left out.
    """
    header = r"^=== SECTION: ([A-Za-z0-9_]+) ===\s*$"
    inside = sections(lines, doc, "line_no", "line", header)
    kept = inside.where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("section").isNotNull() & ~F.col("line").rlike(header))
    parts = F.split("line", "\t")
    return kept.select(doc, "line_no", "section", F.get(parts, F.lit(0)).alias("keyword"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("fields"))


def health(rows: DataFrame, doc: str) -> DataFrame:
    """One row a report of ``sectioned`` lines: containers that are up, models and their bytes, free memory, the heartbeat's age, the last summary.

    Of several lines for a thing the last counts; numbers that aren't whole are null; a heartbeat or summary of ``none`` is null.
    """
    field = lambda k: F.get("fields", F.lit(k))
    line = lambda section, keyword, least: (F.col("section") == section) & (F.col("keyword") == keyword) & (F.size("fields") >= least)
    whole = lambda c: F.when(F.btrim(c).rlike(r"^[+-]?\d+$"), F.btrim(c).try_cast("long"))
    last = lambda when, value: F.max_by(F.when(when, value), F.when(when, F.col("line_no")))
    memory = F.filter(F.split(F.btrim(F.btrim(field(0)), F.lit("[]")), ","), lambda x: x != "")
    told = lambda c: F.when(c != "none", c)
    named = rows.withColumn("name_", F.when(line("containers", "CONTAINER", 2) | line("models", "MODEL", 3), field(0)))
    nth = Window.partitionBy(doc, "section", "keyword", "name_").orderBy(F.col("line_no").desc())
    last_named = F.col("name_").isNotNull() & (F.row_number().over(nth) == 1)
    marked = named.withColumn("newest_", last_named)
    return marked.groupBy(doc).agg(
        F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"),
        F.count_if(F.col("newest_") & (F.col("section") == "containers")).alias("n_containers"),
        F.count_if(F.col("newest_") & (F.col("section") == "containers") & field(1).startswith("Up")).alias("n_up"),
        F.count_if(F.col("newest_") & (F.col("section") == "models")).alias("n_models"),
        F.coalesce(F.sum(F.when(F.col("newest_") & (F.col("section") == "models"), F.coalesce(whole(field(1)), F.lit(0)))), F.lit(0)).alias("model_bytes"),
        last(line("gpu", "GPU_MEM", 1) & (F.size(memory) >= 3), whole(F.get(memory, F.lit(2)))).alias("free_mb"),
        last(line("heartbeat", "HEARTBEAT", 1) & (field(0) != "none"), whole(field(1))).alias("heartbeat_minutes"),
        last(line("night_summary", "NIGHT_SUMMARY", 1), told(field(0))).alias("last_summary"),
    )
