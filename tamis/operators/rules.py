"""Rules that say why a row goes: reject ladders, schema and cross-field checks, gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``ok`` holds for rows that pass; null counts as a breach."""

    field: str
    message: str
    ok: Column


def first_reason(rungs: list[tuple[str, Column]]) -> Column:
    """The name of the first rung whose condition holds; null if none does. Order is part of the meaning."""
    out = F.lit(None).cast("string")
    for name, hit in reversed(rungs):
        out = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(out)
    return out


def ladder(rows: DataFrame, rungs: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reject_reason``, null for accepted rows."""
    return rows.withColumn("reject_reason", first_reason(rungs))


def counted_drops(rows: DataFrame, rungs: list[tuple[str, Column]]) -> DataFrame:
    """(step, reason, n) for every rung in order, zeros too, and the accepted rows last."""
    names = [n for n, _ in rungs] + ["accepted"]
    counts = ladder(rows, rungs).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
    steps = rows.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "step int, reason string")
    return steps.join(counts, "reason", "left").select("step", "reason", F.coalesce("n", F.lit(0)).alias("n"))


def breaches(rows: DataFrame, id_col: str, rules: list[Rule]) -> DataFrame:
    """(id, field, message) for each rule that a row breaks."""
    made = F.array(*(F.when(~F.coalesce(r.ok, F.lit(False)), F.struct(F.lit(r.field).alias("field"), F.lit(r.message).alias("message"))) for r in rules))
    return rows.select(id_col, F.explode(F.array_compact(made)).alias("x")).select(id_col, "x.*")


def schema_rules(schema: dict, at: str = "", column: Column | None = None) -> list[Rule]:
    """Compile a JSON-schema subset into one rule a leaf constraint.

    Knows type, required, properties, const, enum, pattern (a search), minLength, maxLength,
    minimum, maximum, minItems, uniqueItems and format date-time. A const or enum, and a breach of
    type, stand alone for their value. Null is an absent value.
    """
    from tamis.functions.labels import iso_datetime

    out: list[Rule] = []
    for name, spec in schema.get("properties", {}).items():
        field = f"{at}.{name}" if at else name
        c = F.col(name) if column is None else column[name]
        here, absent = c.isNotNull(), c.isNull()
        if name in schema.get("required", ()):
            out.append(Rule(field, "required", here))
        if "const" in spec:
            out.append(Rule(field, "const", absent | (c == F.lit(spec["const"]))))
            continue
        if "enum" in spec:
            out.append(Rule(field, "enum", absent | c.isin(*[x for x in spec["enum"] if x is not None])))
            continue
        checks = {
            "pattern": lambda v, c=c: c.rlike(v),
            "minLength": lambda v, c=c: F.length(c) >= v,
            "maxLength": lambda v, c=c: F.length(c) <= v,
            "minimum": lambda v, c=c: ~F.isnan(c.cast("double")) & (c >= v),
            "maximum": lambda v, c=c: ~F.isnan(c.cast("double")) & (c <= v),
            "minItems": lambda v, c=c: F.size(c) >= v,
            "uniqueItems": lambda v, c=c: F.size(F.array_distinct(c)) == F.size(c) if v else F.lit(True),
            "format": lambda v, c=c: iso_datetime(c) if v == "date-time" else F.lit(True),
        }
        out += [Rule(field, key, absent | make(spec[key])) for key, make in checks.items() if key in spec]
        if "properties" in spec:
            out += [Rule(r.field, r.message, absent | r.ok) for r in schema_rules(spec, field, c)]
    return out


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def missing_files(media: DataFrame, files: DataFrame, key: tuple[str, ...] = ("path",)) -> DataFrame:
    """(id, path, problem) of media whose file is absent, or differs in size or SHA-256 from what is declared.

    ``media``: (id, path, sha256, size); ``files``: (path, sha256, size) as found, one of each ``key``,
    whose columns both have (paths that repeat need more than the path). A null there equals a null.
    """
    f = files.select(*(F.col(c).alias(f"has_{c}") for c in key), F.col("sha256").alias("has_sha"), F.col("size").alias("has_size"), F.lit(True).alias("there"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"has_{c}"))
    j = media.join(f, same, "left")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("size") != F.col("has_size"), "size").when(F.col("sha256") != F.col("has_sha"), "sha256")
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select("id", "path", "problem")


def upload_limits(media: DataFrame, event: str, suffixes: dict[str, tuple[str, ...]], most: int, most_event: int) -> DataFrame:
    """(event, path, problem): a type without its suffix, a file over ``most`` bytes, or an event over ``most_event`` in sum."""
    total = media.groupBy(event).agg(F.sum("bytes").alias("total_"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    fits = F.lit(False)
    for kind, names in suffixes.items():
        fits = fits | ((F.col("type") == kind) & suffix.isin(*names))
    problem = first_reason([("suffix", ~fits), ("file_too_large", F.col("bytes") > most), ("event_too_large", F.col("total_") > most_event)])
    return media.join(total, event).withColumn("problem", problem).where("problem IS NOT NULL").select(event, "path", "problem")


def check_battery(rows: DataFrame, checks: dict[str, Column], audit_only: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``codes`` (of failed checks, joined by |) and ``graded``: no failed check but those for audit only."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items())))
    against = F.array_except(failed, F.array(*map(F.lit, audit_only)).cast("array<string>"))
    return rows.select("*", F.array_join(failed, "|").alias("codes"), (F.size(against) == 0).alias("graded"))


def severity(rungs: list[tuple[str, Column]]) -> Column:
    """The first severity that holds, ``ok`` if none does."""
    return F.coalesce(first_reason(rungs), F.lit("ok"))


def refuse_test(splits: DataFrame, split: str) -> None:
    """Raise if any split's name contains ``test``: nothing may be fitted on it."""
    bad = splits.where(F.lower(split).contains("test")).select(split).limit(1).collect()
    if bad:
        raise ValueError(f"refusing to fit on split {bad[0][0]!r}")


def assertions(spark, checks: dict[str, DataFrame]) -> DataFrame:
    """(name, ok, n): one row a named check; each table holds the rows that would break it."""
    out = None
    for name, bad in checks.items():
        part = bad.agg(F.lit(name).alias("name"), (F.count("*") == 0).alias("ok"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "name string, ok boolean, n long")


def consent_gate(rows: DataFrame, opt_in: Column, attested: Column, level: Column, levels: tuple[int, int] = (3, 7)) -> DataFrame:
    """Adds ``refused``, null where an upload may be read: consent first, then the attestation that nobody is seen, then a whole level in range.

    Only true is consent: null and anything else refuse. Media columns are not read, so a filter on the answer stands before them.
    """
    whole = level.try_cast("int")
    return rows.withColumn("refused", first_reason([
        ("consent_required", ~F.coalesce(opt_in, F.lit(False))),
        ("attestation_required", ~F.coalesce(attested, F.lit(False))),
        ("level_invalid", ~F.coalesce(whole.between(*levels), F.lit(False))),
    ]))
