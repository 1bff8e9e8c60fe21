"""Writers: ledgers, replaced files, release bundles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.tables import drop, save


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append JSON lines with sorted keys."""
    rows.select(*sorted(rows.columns)).write.mode("append").option("ignoreNullFields", False).json(path)


def append_with_attribution(events: DataFrame, path: str, attribution: list[str], ledger: str) -> None:
    """Append events to ``path`` and their attribution, a projection of them, to ``ledger``: both or neither.

    Both are read from one saved copy, so they can't disagree; what the first append wrote is
    removed again if the second fails.
    """
    made = save(events)
    spark = events.sparkSession
    before = {p: _files(spark, p) for p in (path, ledger)}
    try:
        append_ledger(made, path)
        append_ledger(made.select(*attribution), ledger)
    except Exception:
        for p, had in before.items():
            for name in _files(spark, p) - had:
                _fs(spark, p).delete(_path(spark, name), False)
        raise
    drop(made)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str) -> set[str]:
    fs, at = _fs(spark, path), _path(spark, path)
    return {f.getPath().toString() for f in fs.listStatus(at)} if fs.exists(at) else set()


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a replacement that stopped between its two renames: the newest whole table beside a missing one takes its place."""
    fs = _fs(spark, path)
    if fs.exists(_path(spark, path)):
        return False
    for kind in ("new", "bak"):
        beside = [f.getPath() for f in fs.globStatus(_path(spark, f"{path}.{kind}-*")) or () if kind == "bak" or fs.exists(_path(spark, f"{f.getPath()}/_SUCCESS"))]
        if beside:
            return fs.rename(max(beside, key=str), _path(spark, path))
    return False


def replace(rows: DataFrame, path: str, stamp: str) -> None:
    """Write beside the old table, keep that as a backup, then rename into place. A crash between the renames is mended by ``recover``, here or before reading."""
    spark = rows.sparkSession
    fresh = f"{path}.new-{stamp}"
    rows.write.mode("overwrite").parquet(fresh)
    fs = _fs(spark, path)
    if fs.exists(_path(spark, path)):
        fs.rename(_path(spark, path), _path(spark, f"{path}.bak-{stamp}"))
    fs.rename(_path(spark, fresh), _path(spark, path))


def release(events: DataFrame, errors: DataFrame, path: str, partition_by: tuple[str, ...] = ("split", "source"), beside: dict[str, DataFrame] | None = None) -> None:
    """Write a release only if there isn't an error; else raise with the first few.

    With tables ``beside`` (media manifest, counts, licences: see ``events.bundle``) the release is
    a folder of them and ``events``; it is written beside its place and renamed at the end, so it
    is there whole or not at all.
    """
    bad = errors.limit(5).collect()
    if bad:
        raise ValueError(f"release refused: {[r.asDict() for r in bad]}")
    if not beside:
        events.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
        return
    spark, making = events.sparkSession, f"{path}.making"
    fs = _fs(spark, path)
    fs.delete(_path(spark, making), True)
    events.write.partitionBy(*partition_by).option("compression", "zstd").parquet(f"{making}/events")
    for name, rows in beside.items():
        rows.coalesce(1).write.option("ignoreNullFields", False).json(f"{making}/{name}")
    fs.rename(_path(spark, making), _path(spark, path))


def report(row: DataFrame, path: str) -> None:
    """One JSON object; NaN and infinity become null."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes]
    row.select(*clean).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown(rows: list, columns: list[str]) -> str:
    """A table of a few collected rows."""
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows])


def empty_to_null(rows: DataFrame) -> DataFrame:
    """Maps without entries become null."""
    return rows.select(*(F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("map<") else F.col(c) for c, t in rows.dtypes))


def iso_times(rows: DataFrame) -> DataFrame:
    """Timestamps and dates, also within structs, arrays and maps' values, as ISO text (UTC, a ``T``, microseconds where there are any)."""

    def turned(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            zone = "+00:00" if isinstance(kind, T.TimestampType) else ""
            part = F.date_format(c, ".SSSSSS")
            return F.when(c.isNotNull(), F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == ".000000", "").otherwise(part), F.lit(zone)))
        if isinstance(kind, T.DateType):
            return c.cast("string")
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(turned(c[f.name], f.dataType).alias(f.name) for f in kind)))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: turned(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: turned(v, kind.valueType))
        return c

    return rows.select(*(turned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema))
