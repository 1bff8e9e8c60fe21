"""Readers: strict, lenient and tolerant JSON lines, stores, manifests, ratings, prediction archives."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(columns, file, line_no, bad): every line that isn't blank; ``bad`` marks those that aren't objects of the schema.

    Line numbers hold per file, since each file is read as a whole.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    kept = files.where(F.btrim("line") != "").withColumn("line_no", F.col("at") + 1)
    parsed = kept.withColumn("x", F.from_json("line", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("x").isNull() | F.col("x._bad").isNotNull() | ~F.col("line").rlike(r"^\s*\{")
    return parsed.select(*(F.col(f"x.{f.name}").alias(f.name) for f in schema), "file", "line_no", bad.alias("bad"))


def strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; the first bad one raises with its file and number when read."""
    rows = json_lines(spark, path, schema)
    check = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("bad line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file")))).otherwise(F.lit(True))
    return rows.where(check).drop("bad")


def lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a missing file is an empty table."""
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, bad ones left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def counted(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good lines, one row with n_good and n_bad)."""
    rows = json_lines(spark, path, schema)
    return rows.where("NOT bad").drop("bad"), rows.agg(F.count_if(~F.col("bad")).alias("n_good"), F.count_if("bad").alias("n_bad"))


def store(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The one of events.jsonl, events.parquet and events/ that a folder holds; none or several raise."""
    found = [n for n in ("events.jsonl", "events.parquet", "events") if _exists(spark, f"{folder}/{n}")]
    if len(found) != 1:
        raise ValueError(f"{folder} must hold exactly one event store; found {found or 'none'}")
    return strict(spark, f"{folder}/{found[0]}", schema) if found[0].endswith("jsonl") else spark.read.option("basePath", f"{folder}/{found[0]}").parquet(f"{folder}/{found[0]}")


def manifest(spark: SparkSession, path: str, schema: T.StructType, base: str, path_col: str = "image_path") -> DataFrame:
    """A JSON-lines or CSV manifest, with relative paths put under ``base``."""
    rows = spark.read.schema(schema).option("header", True).csv(path) if path.lower().endswith(".csv") else lenient(spark, path, schema)
    return rows.withColumn(path_col, F.when(F.col(path_col).startswith("/"), F.col(path_col)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.col(path_col))))


def ratings(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV of ratings, all as text; missing columns raise."""
    rows = spark.read.option("header", True).csv(path)
    lacking = sorted(set(required) - set(rows.columns))
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    return rows


def ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): one a line, trimmed, blank ones left out."""
    return spark.read.text(path).select(F.btrim("value").alias("id")).where("id <> ''")


def licence_policy(spark: SparkSession, path: str) -> list[str]:
    """The allowlist of a policy file; a missing file is an empty list."""
    if not _exists(spark, path):
        return []
    return list(json.loads(spark.read.text(path, wholetext=True).first()[0]).get("allowlist", []))


def predictions_archive(spark: SparkSession, path: str, **tags: object) -> DataFrame:
    """(tags, event_id, label, probs) of a NumPy archive with probabilities, labels and event_ids; read by Spark, so any store will do."""
    import io

    import numpy as np

    schema = "event_id string, label int, probs array<double>"

    def run(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"event_id": z["event_ids"].astype(str), "label": z["labels"].astype("int32"), "probs": list(z["probabilities"].astype("float64"))})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
    return rows.select(*(F.lit(v).alias(k) for k, v in tags.items()), "event_id", "label", "probs")


def seed_reports(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """(seed, fields) of the JSON reports at paths like ``*_seed<n>/metrics.json``."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return rows.withColumn("seed", F.regexp_extract(F.input_file_name(), r"_seed(\d+)", 1).cast("int"))


def image_labels(classes: DataFrame, labels: DataFrame, metadata: DataFrame, wanted: str, least: float) -> DataFrame:
    """(image_id, url, labels): three tables joined: classes whose name matches, their confident labels, the images' metadata."""
    mids = classes.where(F.lower("name").rlike(wanted))
    sure = labels.where(F.col("confidence") >= least).join(mids, "mid")
    per = sure.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("labels"))
    return per.join(metadata, "image_id").select("image_id", "url", "labels")


def file_receipt(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of each file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def hub_reference(text: str) -> dict[str, str]:
    """The parts of ``hub:owner/name[@revision][:file]``; anything else raises."""
    import re

    m = re.fullmatch(r"hub:([\w.-]+)/([\w.-]+)(?:@([\w.-]+))?(?::(.+))?", text)
    if not m:
        raise ValueError(f"not a hub reference: {text}")
    return {"owner": m[1], "name": m[2], "revision": m[3] or "main", "file": m[4] or ""}
