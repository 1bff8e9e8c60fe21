"""Judges' answers: JSON in free text, checked field by field, accepted only if nothing speaks against it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.labels import LEVELS, iso_datetime

NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def unit_score(answer: Column, path: str) -> Column:
    """struct(value, ok): a JSON number from 0 to 1; booleans, strings, nulls and absent fields aren't."""
    kind = F.schema_of_variant(F.try_variant_get(answer, path, "variant"))
    value = F.try_variant_get(answer, path, "double")
    ok = F.coalesce(kind.rlike(NUMBER) & value.between(0.0, 1.0), F.lit(False))
    return F.struct(F.when(ok, value).alias("value"), ok.alias("ok"))


def verdict(text: Column, level: Column, least_match: float = 0.7, least_quality: float = 0.7, least_cue: float | None = None, need_level: bool = False) -> Column:
    """struct(status, accepted, failures): the object between the first and last brace, judged against the level asked for.

    An answer that isn't such an object, or has a field of the wrong kind, has status ``error`` and
    isn't accepted. Failures are gathered, not the first alone, and joined by |.
    """
    answer = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    kind = lambda p: F.schema_of_variant(F.try_variant_get(answer, p, "variant"))
    match, quality, cue = (unit_score(answer, f"$.{k}") for k in ("descriptor_match_score", "visual_quality_score", "cue_consistency_score"))
    no_cue = F.coalesce(kind("$.cue_consistency_score") == "VOID", F.lit(True))
    seen = F.try_variant_get(answer, "$.observed_level", "double")
    no_level = F.coalesce(kind("$.observed_level") == "VOID", F.lit(True))
    level_ok = no_level | F.coalesce(kind("$.observed_level").rlike(NUMBER) & seen.isin(*map(float, LEVELS)), F.lit(False))
    flag = lambda k: F.try_variant_get(answer, f"$.{k}", "boolean")
    flags_ok = F.coalesce(kind("$.contains_face") == "BOOLEAN", F.lit(False)) & F.coalesce(kind("$.contains_text") == "BOOLEAN", F.lit(False))
    readable = F.coalesce(F.schema_of_variant(answer).startswith("OBJECT"), F.lit(False)) & match["ok"] & quality["ok"] & (no_cue | cue["ok"]) & level_ok & flags_ok
    against = [
        ("match", match["value"] < least_match),
        ("quality", quality["value"] < least_quality),
        *([("cue", no_cue | (cue["value"] < least_cue))] if least_cue is not None else []),
        ("level", ~no_level & (seen != level)),
        *([("no_level", no_level)] if need_level else []),
        ("face", flag("contains_face")),
        ("text", flag("contains_text")),
    ]
    failed = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in against)))
    return F.struct(
        F.when(readable, "ok").otherwise("error").alias("status"),
        (readable & (F.size(failed) == 0)).alias("accepted"),
        F.when(readable, F.array_join(failed, "|")).otherwise("unreadable").alias("failures"),
    )


def metadata_text(value: Column) -> Column:
    """A metadata field's text: tags out, trimmed; empty for null."""
    return F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]+>", " "))


def metadata_date(value: Column) -> Column:
    """The field if it is an ISO date and time with an offset, else null."""
    text = metadata_text(value)
    return F.when(iso_datetime(text), text)


def image_sane(size: Column, width: Column, height: Column, spread: Column, least_bytes: int = 1024, least_side: int = 64, least_spread: float = 2.0) -> Column:
    """What measured properties of an image speak against it: too few bytes, too small a side, too even; null if nothing does."""
    return F.when(F.coalesce(size < least_bytes, F.lit(True)), "bytes").when(F.coalesce(F.least(width, height) < least_side, F.lit(True)), "side").when(F.coalesce(spread < least_spread, F.lit(True)), "even")
