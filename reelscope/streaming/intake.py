"""Incremental intake with Structured Streaming. The batch operators are the reference; these are additions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def watch(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def new_assets(stream: DataFrame, time: str = "seen_at", delay: str = "1 hour") -> DataFrame:
    """Assets whose content was not seen within the watermark: known content is passed over, state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


def rolling_bitrate(stream: DataFrame, keys: list[str], time: str = "at", window: str = "10 seconds", slide: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Bits per second over sliding event-time windows. Late samples count until the watermark passes."""
    seconds = F.col("window.end").cast("double") - F.col("window.start").cast("double")
    sums = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, window, slide)).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("samples"))
    return sums.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "samples", (F.col("bytes") * 8 / seconds).alias("bits"))


def quiet_sessions(stream: DataFrame, keys: list[str], threshold: float, time: str = "at", gap: str = "1 second", delay: str = "5 seconds") -> DataFrame:
    """Sessions of quiet samples that lie no further apart than the gap."""
    quiet = stream.where(F.abs("value") < threshold).withWatermark(time, delay)
    out = quiet.groupBy(*keys, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("samples"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "samples")


def resync_stream(stream: DataFrame, key: str) -> DataFrame:
    """key, idx, state of packets as they arrive (key, idx, is_key, ok): a decoder that waits for the next key frame.

    The state of a stream is one flag. Packets of a stream must arrive in order over the batches; within one they are sorted.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lost = state.get[0] if state.exists else False
        rows = pd.concat(list(parts)).sort_values("idx")
        found = []
        for ok, is_key in zip(rows["ok"], rows["is_key"], strict=True):
            if not ok:
                lost = True
                found.append("failed")
            else:
                lost = lost and not is_key
                found.append("lost" if lost else "decoded")
        state.update((bool(lost),))
        yield pd.DataFrame({key: rows[key], "idx": rows["idx"], "state": found})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "idx", "is_key", "ok").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, idx long, state string", "lost boolean", "append", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Rows and batches of the queries of a session so far, by query id; never less than what was told before."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name, p = str(event.progress.id), event.progress
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        self.batches[name] = max(self.batches.get(name, 0), p.batchId + 1)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


@contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[Callable[[], None]]:
    """Jobs started inside belong to a group; the function it gives cancels them, from any thread."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: spark.sparkContext.cancelJobGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
