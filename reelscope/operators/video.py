"""Sequences of samples: key-frame groups, repeated runs, bitrate windows, byte positions, near-duplicates, scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gop_segments(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of pictures: keys, gop, first_idx (place of its key frame), length, start_us, end_us.

    Places count frames in order of ``idx`` from 0. The last group reaches to the end of the stream, and ends at its last
    frame's time. Streams without a key frame have none; frames before the first key frame belong to none.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    rows = frames.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("last_us", F.last("pts_us").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = rows.where("is_key")
    at = Window.partitionBy(*keys).orderBy("place")
    return heads.select(
        *keys, (F.row_number().over(at) - 1).cast("long").alias("gop"), F.col("place").cast("long").alias("first_idx"), (F.coalesce(F.lead("place").over(at), F.col("n")) - F.col("place")).alias("length"),
        F.col("pts_us").alias("start_us"), F.coalesce(F.lead("pts_us").over(at), F.col("last_us")).alias("end_us"),
    )


def gop_changes(gops: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Groups whose length differs from the one before by more than the tolerance; the last group is never judged."""
    at = Window.partitionBy(*keys).orderBy("gop")
    rows = gops.withColumn("before", F.lag("length").over(at)).withColumn("after", F.lead("gop").over(at))
    return rows.where((F.abs(F.col("length") - F.col("before")) > tolerance) & F.col("after").isNotNull()).select(*keys, "gop", "first_idx", F.col("before").alias("previous_length"), "length", "start_us")


def gop_summary(gops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gops, shortest, longest, uniform, modal_length (ties to the length seen first)."""
    each = gops.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("n"), F.min("gop").alias("seen"))
    return each.groupBy(*keys).agg(
        F.sum("n").alias("gops"), F.min("length").alias("shortest"), F.max("length").alias("longest"), (F.min("length") == F.max("length")).alias("uniform"),
        F.max_by("length", F.struct("n", -F.col("seen"))).alias("modal_length"),
    )


def islands(rows: DataFrame, keys: list[str], value: str, order: str = "idx") -> DataFrame:
    """Rows with ``island``, a number for each maximal run of equal values (nulls are equal to each other)."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return rows.withColumn("_start", starts.cast("int")).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def repeated_runs(samples: DataFrame, keys: list[str], min_run: int = 2) -> DataFrame:
    """Maximal runs of equal digests: keys, first_idx, last_idx, length, digest, all_key. Runs of one are no repeats."""
    return (
        islands(samples, keys, "digest").groupBy(*keys, "island").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("length"), F.min("digest").alias("digest"), F.bool_and("is_key").alias("all_key"))
        .where(F.col("length") >= max(min_run, 2)).drop("island")
    )


def sliding_bitrate(samples: DataFrame, keys: list[str], window: int, ratio: float) -> DataFrame:
    """Windows of ``window`` samples whose bitrate falls under ``ratio`` of the stream's: keys, idx, start_us, end_us, bits, keyframes, average.

    Bits per second over the span from the first to the last sample, that sample's own duration left out, as for the
    average. Spans of zero or less are skipped; a stream of no more than ``window`` samples has no windows.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    frame = order.rowsBetween(-(window - 1), 0)
    rows = samples.select(
        *keys, "idx", "pts_us", F.row_number().over(order).alias("place"), F.sum("size").over(frame).alias("bytes"),
        F.sum(F.col("is_key").cast("long")).over(frame).alias("keyframes"), F.first("pts_us").over(frame).alias("start_us"),
    )
    rows = rows.join(whole_bitrate(samples, keys), keys).where(F.col("samples") > window).where(F.col("place") >= window)
    span = F.col("pts_us") - F.col("start_us")
    rows = rows.where(span > 0).withColumn("bits", F.col("bytes") * 8e6 / span)
    return rows.where(F.col("bits") < ratio * F.col("average")).select(*keys, "idx", "start_us", F.col("pts_us").alias("end_us"), "bits", "keyframes", "average")


def whole_bitrate(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, samples, average: bits per second from the first sample's time to the last's; null over no span."""
    sums = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum("size").alias("bytes"), F.min_by("pts_us", "idx").alias("a"), F.max_by("pts_us", "idx").alias("b"))
    return sums.select(*keys, "samples", F.when(F.col("b") > F.col("a"), F.col("bytes") * 8e6 / (F.col("b") - F.col("a"))).alias("average"))


def byte_positions(samples: DataFrame, keys: list[str], anchor: int = 0) -> DataFrame:
    """Samples with ``byte_offset``: the anchor plus the sizes of all samples before."""
    before = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("byte_offset", F.lit(anchor) + F.coalesce(F.sum("size").over(before), F.lit(0)))


def position_at(offsets: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """For each offset the sample that begins at or before it, the latest such: a backward as-of join by one sorted union."""
    probes = offsets.select(*keys, F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<byte_offset: bigint, idx: bigint>").alias("mark"))
    marks = positions.select(*keys, F.col("byte_offset").alias("at"), F.lit(0).alias("side"), F.struct(F.col("byte_offset").cast("long").alias("byte_offset"), F.col("idx").cast("long").alias("idx")).alias("mark"))
    back = Window.partitionBy(*keys).orderBy("at", "side", F.col("mark.idx")).rowsBetween(Window.unboundedPreceding, 0)
    found = probes.unionByName(marks).withColumn("hit", F.last("mark", ignorenulls=True).over(back)).where("side = 1")
    return found.select(*keys, F.col("at").alias("offset"), "hit.idx", "hit.byte_offset")


def near_duplicates(frames: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Pairs of frames at most ``window`` places apart with equal hashes: keys, a, b.

    A band join: places fall into buckets as wide as the window, and each frame meets its own bucket and the next, so a
    hash that very many frames share pairs within the band only.
    """
    rows = frames.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("idx")) - 1).withColumn("bucket", F.floor(F.col("place") / window))
    left = rows.select(*keys, "hash", F.col("idx").alias("a"), F.col("place").alias("pa"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = rows.select(*keys, "hash", "bucket", F.col("idx").alias("b"), F.col("place").alias("pb"))
    pairs = left.join(right, [*keys, "hash", "bucket"]).where((F.col("pb") > F.col("pa")) & (F.col("pb") <= F.col("pa") + window))
    return pairs.select(*keys, "a", "b")


def scene_changes(frames: DataFrame, keys: list[str], changed_above: float) -> DataFrame:
    """Mean absolute difference and changed share between consecutive frames: keys, idx, mean_abs, changed.

    ``frames`` has idx and ``values`` (array). Frames whose idx does not follow on are skipped; the scan of a stream ends
    at its first change of size.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = frames.withColumn("before", F.lag("values").over(w)).withColumn("gap", F.col("idx") - F.lag("idx").over(w))
    resized = F.coalesce((F.size("before") != F.size("values")) & (F.col("gap") == 1), F.lit(False)).cast("int")
    rows = rows.withColumn("stopped", F.max(resized).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("stopped = 0 and gap = 1")
    diff = F.zip_with("values", "before", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    rows = rows.withColumn("d", diff)
    total = F.aggregate("d", F.lit(0.0), lambda s, x: s + x)
    moved = F.size(F.filter("d", lambda x: x > changed_above))
    return rows.select(*keys, "idx", (total / F.size("d")).alias("mean_abs"), (moved / F.size("d")).alias("changed"))


def resync(packets: DataFrame, keys: list[str]) -> DataFrame:
    """What a decoder that waits for the next key frame after a failure makes of each packet: keys, idx, state.

    ``packets`` has idx, is_key and ok. A failed packet is ``failed``. After one, packets are ``lost`` until a key frame
    decodes; that one and all others are ``decoded``. A failed key frame keeps the stream lost.
    """
    order = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.max(F.when(~F.col("ok"), F.col("idx"))).over(order)
    healed = F.max(F.when(F.col("ok") & F.col("is_key"), F.col("idx"))).over(order)
    lost = F.coalesce(failed > F.coalesce(healed, F.lit(-1)), F.lit(False))
    return packets.select(*keys, "idx", F.when(~F.col("ok"), "failed").when(lost, "lost").otherwise("decoded").alias("state"))


def lost_intervals(states: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of lost packets: keys, from_idx, skipped."""
    return islands(states, keys, "state").where("state = 'lost'").groupBy(*keys, "island").agg(F.min("idx").alias("from_idx"), F.count(F.lit(1)).alias("skipped")).drop("island")


def unexplained(expected: DataFrame, seen: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Expected packets that were neither seen nor lie in a lost interval: an equi and an interval anti-join."""
    missing = expected.join(seen.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    covered = intervals.select(*keys, F.explode(F.sequence(F.col("from_idx"), F.col("from_idx") + F.col("skipped") - 1)).alias("idx"))
    return missing.join(covered, [*keys, "idx"], "left_anti")


def first_of_kind(streams: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The first stream of a kind of each asset, by stream_index."""
    w = Window.partitionBy(*keys).orderBy("stream_index")
    return streams.where(F.col("kind") == kind).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def recovered_counts(samples: DataFrame, streams: DataFrame, keys: list[str]) -> DataFrame:
    """Streams that declare more packets than were read: keys, declared, recovered, missing. No declared count: no row."""
    got = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("recovered"))
    out = streams.where("packet_count is not null").select(*keys, F.col("packet_count").alias("declared")).join(got, keys, "left").withColumn("recovered", F.coalesce("recovered", F.lit(0)))
    return out.where("declared > recovered").withColumn("missing", F.col("declared") - F.col("recovered"))


def packet_damage(samples: DataFrame, streams: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, idx, declared, recovered, missing: packets without bytes, and streams that lack declared packets."""
    none = F.lit(None).cast("long")
    empty = samples.where("size = 0").select(*keys, F.lit("empty_sample").alias("kind"), F.col("idx").cast("long").alias("idx"), none.alias("declared"), none.alias("recovered"), none.alias("missing"))
    short = recovered_counts(samples, streams, keys).select(*keys, F.lit("declared_over_recovered").alias("kind"), none.alias("idx"), *[F.col(c).cast("long").alias(c) for c in ("declared", "recovered", "missing")])
    return empty.unionByName(short)


def largest_scene(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, mean_abs of the largest change of each stream, ties to the earliest."""
    return changes.groupBy(*keys).agg(F.max("mean_abs").alias("mean_abs"), F.max_by("idx", F.struct("mean_abs", -F.col("idx"))).alias("idx"))


def reorder(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with ``delay_us``, presentation less decode time."""
    return frames.withColumn("delay_us", F.col("pts_us") - F.col("dts_us"))


def reorder_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frames, reordered (frames presented after they are decoded), longest_us (null without frames)."""
    return reorder(frames, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("delay_us") > 0).alias("reordered"), F.max("delay_us").alias("longest_us"))


def zip_streams(streams: DataFrame, infos: DataFrame, keys: list[str], order: str = "stream_index") -> DataFrame:
    """The i-th stream with the i-th info of the same keys; what has no partner is left out."""
    at = lambda df: df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return at(streams).join(at(infos).drop(order), [*keys, "_i"]).drop("_i")
