"""Timestamps: modal step, presentation and decode scans, as-of pairing, A/V sync.

Frames carry stream keys, a unique order column ``idx`` and times in microseconds. Every operator partitions by the stream
keys, so many assets run in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def steps(frames: DataFrame, keys: list[str], time: str = "pts_us", idx: str = "idx") -> DataFrame:
    """Frames with ``previous`` (time of the frame before) and ``delta``."""
    w = Window.partitionBy(*keys).orderBy(idx)
    return frames.withColumn("previous", F.lag(time).over(w)).withColumn("delta", F.col(time) - F.col("previous"))


def modal_delta(frames: DataFrame, keys: list[str], time: str = "pts_us", idx: str = "idx") -> DataFrame:
    """The commonest positive step of each stream, ties to the smallest: keys, modal, support."""
    counts = steps(frames, keys, time, idx).where("delta > 0").groupBy(*keys, "delta").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("delta", F.struct("n", -F.col("delta"))).alias("modal"), F.max("n").alias("support"))


def presentation_scan(frames: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """Anomalies of presentation times: keys, idx, kind, previous, observed, size.

    ``negative`` time; ``non_monotonic`` step below 0; ``overlap`` step of 0; ``gap`` step beyond the modal one by more
    than the tolerance, with that excess as size. One frame may have several.
    """
    rows = steps(frames, keys).join(modal_delta(frames, keys).select(*keys, "modal"), keys, "left")
    kind = lambda name, when, size=None: F.when(when, F.struct(F.lit(name).alias("kind"), (F.lit(None).cast("long") if size is None else size).alias("size")))
    over = F.col("delta") - F.col("modal")
    found = F.array(kind("negative", F.col("pts_us") < 0), kind("non_monotonic", F.col("delta") < 0), kind("overlap", F.col("delta") == 0), kind("gap", over > tolerance_us, over))
    return rows.select(*keys, "idx", "previous", F.col("pts_us").alias("observed"), F.explode(F.array_compact(found)).alias("x")).select(*keys, "idx", "x.kind", "previous", "observed", "x.size")


def decode_scan(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames whose decode time falls behind the one before."""
    rows = steps(frames, keys, "dts_us").where("delta < 0")
    return rows.select(*keys, "idx", F.lit("non_monotonic_dts").alias("kind"), "previous", F.col("dts_us").alias("observed"))


def nearest_after(left: DataFrame, right: DataFrame, keys: list[str], time: str, idx: str) -> DataFrame:
    """For each left row the first right time at or after it, or the last one: a clamped forward as-of join.

    The cursor never goes back: on reordered input a row looks up the running maximum of the times so far. ``left`` gains
    ``key_us`` and ``match_us`` (null without any right row of the same keys). One sort of the union, no range join.
    """
    running = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    probes = left.withColumn("key_us", F.max(time).over(running))
    tagged = probes.select(*keys, F.col("key_us").alias("at"), F.lit(0).alias("side"), F.struct(*probes.columns).alias("row"), F.lit(None).cast("long").alias("mark"))
    marks = right.select(*keys, F.col(time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(tagged.schema["row"].dataType).alias("row"), F.col(time).cast("long").alias("mark"))
    both = tagged.unionByName(marks)
    # Read backwards, the next mark is the last one met: a frame that only grows, so the pass is linear.
    behind = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("next", F.last("mark", ignorenulls=True).over(behind)).withColumn("last", F.max("mark").over(Window.partitionBy(*keys)))
    return both.where("side = 0").select("row.*", F.coalesce("next", "last").alias("match_us"))


def middle(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: of an even number of longs the truncated mean of the middle two. Ranks, no gathered arrays."""
    by = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.row_number().over(by.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(by).alias("_n"))
    two = ranked.where("_r = (_n + 1) div 2 or _r = _n div 2 + 1").groupBy(*keys).agg(F.sum("_v").alias("sum"), F.count(F.lit(1)).alias("of"))
    return two.select(*keys, F.when(F.col("of") == 1, F.col("sum")).otherwise(F.expr("sum div 2")).alias("median"))


def sync_report(video: DataFrame, audio: DataFrame, keys: list[str]) -> DataFrame:
    """keys, initial_us, final_us, drift_us: median offset of each half of the video frames to audio.

    Halves part at n div 2 frames; each half walks the audio from its start. Streams with under two frames on either side
    are not measured and have no row.
    """
    n = video.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    enough = audio.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where("m >= 2").select(*keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("idx")) - 1
    halves = video.join(n, keys).join(enough, keys, "left_semi").withColumn("half", F.when(rank < F.floor(F.col("n") / 2), 0).otherwise(1)).select(*keys, "half", "idx", "pts_us")
    sides = audio.select(*keys, "pts_us").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    matched = nearest_after(halves, sides, [*keys, "half"], "pts_us", "idx").withColumn("residual", F.col("match_us") - F.col("pts_us"))
    medians = middle(matched, [*keys, "half"], "residual").withColumnRenamed("median", "m")
    out = medians.groupBy(*keys).agg(F.max(F.when(F.col("half") == 0, F.col("m"))).alias("initial_us"), F.max(F.when(F.col("half") == 1, F.col("m"))).alias("final_us"))
    return out.withColumn("drift_us", F.col("final_us") - F.col("initial_us"))


def rate_changes(frames: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """Steps in presentation order that differ from the dominant one: keys, pts_us, delta, dominant.

    A step is dominant if at least half of its stream's steps have it (ties to the earliest); without one, and in streams
    of under three frames, nothing is reported. This is the true majority, not a first-come count.
    """
    w = Window.partitionBy(*keys).orderBy("pts_us", "idx")
    rows = frames.withColumn("delta", F.col("pts_us") - F.lag("pts_us").over(w)).where("delta is not null")
    each = rows.groupBy(*keys, "delta").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pts_us", "idx")).alias("seen"))
    best = each.groupBy(*keys).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "seen", "delta")))[0]["delta"].alias("dominant"))
    best = best.where("total >= 2 and 2 * most >= total").select(*keys, "dominant")
    return rows.join(best, keys).where(F.abs(F.col("delta") - F.col("dominant")) > tolerance_us).select(*keys, "pts_us", "delta", "dominant")


def expand_runs(runs: DataFrame, keys: list[str], seq: str, count: str, delta: str) -> DataFrame:
    """Run-length time tables to one row for each sample: keys, idx, dts (ticks). Runs follow ``seq``."""
    before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.where(F.col(count) > 0).withColumn("first", F.coalesce(F.sum(count).over(before), F.lit(0))).withColumn("base", F.coalesce(F.sum(F.col(count) * F.col(delta)).over(before), F.lit(0)))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)))
    return rows.select(*keys, (F.col("first") + F.col("k")).alias("idx"), (F.col("base") + F.col("k") * F.col(delta)).alias("dts"))


def anomalies(frames: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """Both timestamp reports in one: keys, idx, kind, previous, observed, size (null for decode times)."""
    return presentation_scan(frames, keys, tolerance_us).unionByName(decode_scan(frames, keys).withColumn("size", F.lit(None).cast("long")))


def measured_duration(runs: DataFrame, keys: list[str], count: str = "n", delta: str = "delta") -> DataFrame:
    """keys, duration (sum of count times step), step (the common step; null if steps differ)."""
    return runs.groupBy(*keys).agg(F.sum(F.col(count) * F.col(delta)).alias("duration"), F.when(F.min(delta) == F.max(delta), F.min(delta)).alias("step"))


def sync_flags(report: DataFrame, tolerance_us: int) -> DataFrame:
    """``report`` with constant_offset (no drift at all) and drifting (beyond the tolerance, either way)."""
    return report.withColumn("constant_offset", F.col("drift_us") == 0).withColumn("drifting", F.abs("drift_us") > tolerance_us)
