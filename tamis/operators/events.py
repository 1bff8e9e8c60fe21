"""Events built from candidates, and what a release derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import tables
from tamis.functions.labels import clamp_confidence, event_id


def build_events(candidates: DataFrame) -> DataFrame:
    """Nested weak-label events from (provider, source_id, url, creator, licence, level, confidence, captured_at, harvested_at, sha256, bytes).

    The level declared is the weak one, the capture time falls back to the harvest's, and real
    web material is train only.
    """
    provider = F.col("provider")
    return candidates.select(
        event_id(provider, F.col("source_id")).alias("event_id"),
        F.lit("train").alias("split"),
        F.lit("real_weak").alias("source"),
        F.col("level").cast("tinyint").alias("level_declared"),
        F.col("level").cast("tinyint").alias("level_weak"),
        clamp_confidence(F.col("confidence")).alias("weak_confidence"),
        F.coalesce("captured_at", "harvested_at").alias("captured_at"),
        F.concat(F.lit("RW_"), provider).alias("kitchen_id"),
        F.array(F.struct(F.lit("image").alias("type"), F.concat(F.lit("media/"), "source_id", F.lit(".jpg")).alias("path"), F.col("sha256"), F.col("bytes"))).alias("media_files"),
        F.struct("provider", "source_id", "url", "creator", "licence").alias("provenance"),
    )


def attribution(events: DataFrame) -> DataFrame:
    """The flat ledger of an event's provenance: a projection, so it can't disagree with the events."""
    return events.select("event_id", "provenance.*", F.get("media_files", F.lit(0))["path"].alias("path"), F.get("media_files", F.lit(0))["sha256"].alias("sha256"))


def with_weak_label(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events with level and confidence replaced where ``labels`` (event_id, level, confidence) has them."""
    j = events.join(labels.select("event_id", F.col("level").alias("l_"), F.col("confidence").alias("c_")), "event_id", "left")
    return j.withColumns({"level_declared": F.coalesce(F.col("l_").cast("tinyint"), "level_declared"), "level_weak": F.coalesce(F.col("l_").cast("tinyint"), "level_weak"), "weak_confidence": F.coalesce(clamp_confidence(F.col("c_")), "weak_confidence")}).select(*events.columns)


def with_path_prefix(events: DataFrame, prefix: Column) -> DataFrame:
    """Media paths put under a prefix."""
    return events.withColumn("media_files", F.transform("media_files", lambda m: m.withField("path", F.concat(prefix, F.lit("/"), m["path"]))))


def numbered(rows: DataFrame, order: str, pattern: str = "EV-%04d") -> DataFrame:
    """Adds ``number``, the row's place in order (from 1) by the pattern."""
    placed = tables.numbered(rows, [order], "nth_")
    return placed.select(*rows.columns, F.format_string(pattern, F.col("nth_") + 1).alias("number"))


def flat_manifest(events: DataFrame, keys: list[str]) -> DataFrame:
    """(event_id, image_path, level, split, group_id, source): group keys joined by a slash, nulls left out."""
    return events.select("event_id", F.get("media_files", F.lit(0))["path"].alias("image_path"), F.col("level_declared").alias("level"), "split", F.concat_ws("/", *keys).alias("group_id"), "source")


def capture_outcome(rows: DataFrame, outcomes: str, expected: str, captured: str) -> DataFrame:
    """Adds ``passed`` (every applicable test passes, or isn't applicable) and ``missing`` media, joined by |."""
    passed = F.forall(F.map_values(outcomes), lambda x: x.isin("pass", "na"))
    return rows.select("*", passed.alias("passed"), F.array_join(F.array_except(expected, captured), "|").alias("missing"))


def prompts(dimensions: dict[str, DataFrame], template: str) -> DataFrame:
    """The product of small dimension tables (one column each, named as the key), and the template filled in."""
    out = None
    for d in dimensions.values():
        out = d if out is None else out.crossJoin(F.broadcast(d))  # of small dimensions
    return out.withColumn("prompt", F.format_string(template, *dimensions))


def media_manifest(events: DataFrame) -> DataFrame:
    """(release_source, event_id, path, type, sha256, bytes): a row a media file."""
    return events.select(F.col("source").alias("release_source"), "event_id", F.explode("media_files").alias("m")).select("release_source", "event_id", "m.path", "m.type", "m.sha256", "m.bytes")


def source_counts(events: DataFrame) -> DataFrame:
    """(source, split, n, n_media): events and media files of each source and split."""
    return events.groupBy("source", "split").agg(F.count("*").alias("n"), F.sum(F.size("media_files")).cast("long").alias("n_media"))


def licence_counts(events: DataFrame) -> DataFrame:
    """(source, provider, licence, n) of the events' provenance."""
    return events.groupBy("source", F.col("provenance.provider").alias("provider"), F.col("provenance.licence").alias("licence")).agg(F.count("*").alias("n"))


def bundle(events: DataFrame) -> dict[str, DataFrame]:
    """What a release holds beside its events."""
    return {"media_manifest": media_manifest(events), "source_counts": source_counts(events), "licence_manifest": licence_counts(events)}
