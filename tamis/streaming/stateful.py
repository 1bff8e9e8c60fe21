"""Streams: a sliding-window rate limiter, idempotent quarantine intake, resumed first-wins, event-time windows.

The windows are an addition; the limiter, the intake and the resumption are the engine's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

LIMITED = "key string, id long, at double, accepted boolean"


def limit(times: list[float], held: list[float], window: float, most: int) -> tuple[list[bool], list[float]]:
    """Accept each time if under ``most`` were accepted within the ``window`` before it; refused ones don't count."""
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        ok = len(held) < most
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


class RateLimiter(StatefulProcessor):
    """Keeps the accepted times of a key; at most ``most`` of them, however many attempts there are."""

    def __init__(self, window: float, most: int) -> None:
        self.window, self.most = window, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", StructType([StructField("at", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [r[0] for r in self.accepted.get()] if self.accepted.exists() else []
        for part in rows:
            part = part.sort_values(["at", "id"])
            ok, held = limit(part["at"].tolist(), held, self.window, self.most)
            yield pd.DataFrame({"key": key[0], "id": part["id"], "at": part["at"], "accepted": ok})
        if held:
            self.accepted.put([(h,) for h in held])
        else:
            self.accepted.clear()

    def close(self) -> None:
        return


def limited_stream(attempts: DataFrame, window: float, most: int) -> DataFrame:
    """(key, id, at, accepted) of a stream of (key, id, at); needs the RocksDB state store."""
    return attempts.groupBy("key").transformWithStateInPandas(RateLimiter(window, most), LIMITED, "Append", "None")


def limited(attempts: DataFrame, window: float, most: int) -> DataFrame:
    """The same over a table: keys are dealt out and sorted, and each is folded in Arrow batches with what it holds."""
    dealt = attempts.select(F.col("key").cast("string").alias("key"), "id", "at").repartition("key").sortWithinPartitions("key", "at", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for b in batches:
            out = []
            for k, part in b.groupby("key", sort=False, dropna=False):
                held = held if k == key else []
                key = k
                ok, held = limit(part["at"].tolist(), held, window, most)
                out.append(part.assign(accepted=ok))
            if out:
                yield pd.concat(out)

    return dealt.mapInPandas(run, LIMITED)


def quarantine(stream: DataFrame, path: str, checkpoint: str, id_col: str):
    """Append each micro-batch's events that aren't there yet, marked not for release; repeats of a batch change nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fresh = batch.dropDuplicates([id_col])
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            fresh = fresh.join(spark.read.parquet(path).select(id_col), id_col, "left_anti")
        fresh.select(*batch.columns, F.lit(False).alias("release_eligible")).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def resumed_first_wins(candidates: DataFrame, ledger: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key that the ledger doesn't hold yet: a batch carries on from what was written."""
    new = candidates.join(ledger.select(key).distinct(), key, "left_anti")
    return new.groupBy(key).agg(F.min_by(F.struct(*candidates.columns), order).alias("x")).select("x.*")


def windowed(events: DataFrame, ts: str, key: str, size: str, lateness: str | None = None) -> DataFrame:
    """(window_start, key, n, total) of tumbling windows; on a stream ``lateness`` sets the watermark."""
    rows = events.withWatermark(ts, lateness) if lateness else events
    return rows.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def first_within(events: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """A stream's rows, repeats within the watermark left out."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
