"""The rule set: parameterised queries over analysis tables that give findings of one schema.

``evaluate`` takes a bundle, a dict of DataFrames by input name. A rule runs only if the bundle has its input: without a
measurement there is no finding. All findings of all assets come from one plan, a union of the rules' projections.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.media import fingerprint, severity_rank, timecode

FINDING = ["asset_id", "rule_id", "severity", "confidence", "summary", "measurements", "stream_index", "start_us", "end_us", "discriminator"]


@dataclass(frozen=True)
class Profile:
    """Thresholds of the rules; the defaults are permissive."""

    name: str = "Default forensic"
    version: int = 1
    gop_tolerance_frames: int = 5
    pts_tolerance_us: int = 2_000
    silence_threshold: float = 0.001
    min_silence_frames: int = 1_000
    min_duplicate_run: int = 2
    clipping_threshold: float = 0.999
    dc_offset_threshold: float = 0.001
    inaudible_lufs: float = -70.0
    loudness_drift_tolerance_lu: float = 2.0
    av_drift_tolerance_ms: float = 20.0
    scene_change_threshold: float = 60.0
    near_duplicate_window: int = 8
    bitrate_window_frames: int = 12
    bitrate_anomaly_ratio: float = 0.5
    #: The drift rule compares milliseconds with this figure; set av_drift_tolerance_ms here for the stricter reading.
    drift_limit: str = "loudness_drift_tolerance_lu"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    confidence: str
    input: str
    rows: Callable[[DataFrame, Profile], DataFrame]
    summary: str
    measures: Callable[[], list[Column]] = field(default=lambda: [])
    stream: str | None = None
    start: str | None = None
    end: str | None = None
    label: str | None = None


def _all(df: DataFrame, p: Profile) -> DataFrame:
    return df


def _kind(*kinds: str):
    return lambda df, p: df.where(F.col("kind").isin(*kinds))


def _m(name: str, column: str):
    return F.concat(F.lit(f"{name} "), F.col(column).cast("string"))


RULES = [
    Rule("VIDEO.BITRATE_DROP", "WARNING", "HIGH", "bitrate", _all, "Bitrate falls well below the average of the stream", lambda: [_m("bits_per_second", "bits")], "stream_index", "start_us", "end_us", "idx"),
    Rule("CONTAINER.TRUNCATED_MEDIA", "CRITICAL", "HIGH", "damage", lambda d, p: d.where("is_missing_data"), "Media data is missing", lambda: [_m("offset", "offset")], None, "at_us", None, "offset"),
    Rule("CONTAINER.STRUCTURAL_DEFECT", "WARNING", "MEDIUM", "damage", lambda d, p: d.where("not is_missing_data"), "The container structure is damaged", lambda: [_m("offset", "offset")], None, None, None, "offset"),
    Rule("CONTAINER.UNREADABLE_PACKET", "SIGNIFICANT", "HIGH", "packet_damage", lambda d, p: d.withColumn("place", F.concat_ws(" ", "kind", "idx")), "Packets cannot be read", lambda: [_m("kind", "kind")], "stream_index", None, None, "place"),
    Rule("VIDEO.DECODE_FAILURE", "SIGNIFICANT", "HIGH", "decode_damage", lambda d, p: d.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("asset_id"))), "Frames fail to decode", lambda: [_m("failures", "total")], "stream_index", None, None, "idx"),
    Rule("VIDEO.GOP_LENGTH_CHANGE", "SIGNIFICANT", "HIGH", "gop_changes", _all, "The length of picture groups changes", lambda: [_m("from", "previous_length"), _m("to", "length")], "stream_index", "start_us", None, "gop"),
    Rule("VIDEO.DUPLICATE_FRAME_RUN", "WARNING", "HIGH", "repeated_runs", lambda d, p: d.where(F.col("length") >= p.min_duplicate_run), "Frames repeat", lambda: [_m("length", "length")], "stream_index", "start_us", None, "first_idx"),
    Rule("TIMING.NON_MONOTONIC_PTS", "SIGNIFICANT", "HIGH", "timestamps", _kind("non_monotonic"), "Presentation times go back", lambda: [_m("observed_us", "observed")], "stream_index", "observed", None, "idx"),
    Rule("TIMING.TIMESTAMP_GAP", "WARNING", "HIGH", "timestamps", _kind("gap"), "Presentation times have a gap", lambda: [_m("gap_us", "size")], "stream_index", None, None, "idx"),
    Rule("TIMING.AV_SYNC_DRIFT", "SIGNIFICANT", "MEDIUM", "sync", lambda d, p: d.where(F.abs("drift_us") / 1000 >= getattr(p, p.drift_limit)), "Audio drifts against video", lambda: [_m("drift_us", "drift_us")]),
    Rule("METADATA.TIMESTAMP_CONFLICT", "WARNING", "HIGH", "metadata_conflicts", _all, "Metadata contradicts itself", lambda: [_m("values", "values")], None, None, None, "key"),
    Rule("METADATA.DECLARED_VS_MEASURED_MISMATCH", "WARNING", "HIGH", "streams", lambda d, p: d.where("abs(duration_us - measured_us) > 100000"), "Declared and measured durations differ", lambda: [_m("declared_us", "duration_us"), _m("measured_us", "measured_us")], "stream_index", None, None, "stream_index"),
    Rule("CONTAINER.NO_USABLE_STREAMS", "SIGNIFICANT", "HIGH", "containers", lambda d, p: d.where("stream_count = 0"), "No stream can be used"),
    Rule("CONTAINER.MALFORMED_STRUCTURE", "WARNING", "HIGH", "containers", lambda d, p: d.where("size(anomalies) > 0"), "The container is malformed", lambda: [F.concat(F.lit("anomalies "), F.size("anomalies").cast("string"))]),
    Rule("AUDIO.CLIPPING", "WARNING", "HIGH", "levels", lambda d, p: d.where(F.col("peak") >= p.clipping_threshold), "Audio reaches full scale", lambda: [_m("peak", "peak")]),
    Rule("AUDIO.DC_OFFSET", "WARNING", "HIGH", "levels", lambda d, p: d.where(F.abs("mean") >= p.dc_offset_threshold), "Audio has a constant offset", lambda: [_m("mean", "mean")]),
    Rule("AUDIO.SILENCE_REGION", "WARNING", "MEDIUM", "silence", lambda d, p: d.where(F.col("length") >= p.min_silence_frames), "Audio is silent", lambda: [_m("length", "length")], None, None, None, "first_slot"),
    Rule("CONTAINER.DECLARED_TRACK_MISMATCH", "SIGNIFICANT", "HIGH", "containers", lambda d, p: d.where("coalesce(declared_next_track_id - 1, declared_track_count) <> stream_count"), "Declared and found tracks differ in number", lambda: [_m("streams", "stream_count")]),
    Rule("CONTAINER.STREAM_DURATION_MISSING", "INFORMATIONAL", "HIGH", "streams", lambda d, p: d.where("duration_us is null"), "A stream declares no duration", lambda: [], "stream_index", None, None, "stream_index"),
    Rule("CONTAINER.STREAM_START_OFFSET", "INFORMATIONAL", "HIGH", "streams", lambda d, p: d.where("start_us > 2000 or abs(edit_us) > 2000"), "A stream starts late", lambda: [_m("start_us", "start_us")], "stream_index", None, None, "stream_index"),
    Rule("CONTAINER.PARSE_ANOMALY", "WARNING", "HIGH", "containers", lambda d, p: d.withColumn("anomaly", F.explode("anomalies")), "Reading the container met an anomaly", lambda: [F.col("anomaly")], None, None, None, "anomaly"),
    Rule("VIDEO.SINGLE_KEYFRAME", "WARNING", "HIGH", "gop_summary", lambda d, p: d.where("gops = 1"), "A stream has one key frame only", lambda: [_m("gops", "gops")], "stream_index", None, None, "stream_index"),
    Rule("VIDEO.ALL_FRAMES_KEYFRAMES", "INFORMATIONAL", "HIGH", "streams", lambda d, p: d.where("kind = 'video' and all_key"), "Every frame is a key frame", lambda: [], "stream_index", None, None, "stream_index"),
    Rule("VIDEO.FRAME_RATE_CHANGE", "INFORMATIONAL", "MEDIUM", "rate_changes", _all, "The frame rate changes", lambda: [_m("delta_us", "delta")], "stream_index", "pts_us", None, "pts_us"),
    Rule("AUDIO.INAUDIBLE", "WARNING", "HIGH", "loudness", lambda d, p: d.where(F.col("lufs") <= p.inaudible_lufs), "Audio is inaudible", lambda: [_m("lufs", "lufs")]),
    Rule("METADATA.MISSING_CREATION_TIME", "INFORMATIONAL", "HIGH", "missing_creation", _all, "No creation time is recorded", lambda: [_m("entries", "entries")]),
    Rule("VIDEO.SCENE_CHANGE", "INFORMATIONAL", "MEDIUM", "scenes", lambda d, p: d.where(F.col("mean_abs") >= p.scene_change_threshold), "The scene changes", lambda: [_m("mean_abs", "mean_abs")], "stream_index", None, None, "idx"),
    Rule("VIDEO.NEAR_DUPLICATE_FRAME", "INFORMATIONAL", "LOW", "near_duplicates", lambda d, p: d.withColumn("_n", F.row_number().over(Window.partitionBy("asset_id").orderBy("a", "b"))).where("_n <= 20"), "Frames look alike", lambda: [_m("other", "b")], "stream_index", None, None, "a"),
    Rule("VIDEO.HDR_METADATA_MISSING", "WARNING", "HIGH", "streams", lambda d, p: d.where("is_hdr and hdr_metadata is null"), "HDR is signalled without its metadata", lambda: [], "stream_index", None, None, "stream_index"),
]


def findings_of(rule: Rule, df: DataFrame, profile: Profile) -> DataFrame:
    rows = rule.rows(df, profile)
    time = lambda c: F.col(c).cast("long") if c else F.lit(None).cast("long")
    confidence = F.lit(rule.confidence)
    if rule.id == "VIDEO.DUPLICATE_FRAME_RUN":  # equal payloads prove equal pictures only if all are key frames
        confidence = F.when(F.col("all_key"), "HIGH").otherwise("MEDIUM")
    return rows.select(
        F.col("asset_id").cast("string").alias("asset_id"), F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), confidence.alias("confidence"), F.lit(rule.summary).alias("summary"),
        F.array(*rule.measures()).cast("array<string>").alias("measurements"),
        (F.col(rule.stream).cast("int") if rule.stream and rule.stream in rows.columns else F.lit(None).cast("int")).alias("stream_index"),
        time(rule.start).alias("start_us"), time(rule.end).alias("end_us"), (F.col(rule.label).cast("string") if rule.label else F.lit("")).alias("discriminator"),
    )


def evaluate(bundle: dict[str, DataFrame], profile: Profile = Profile(), rules: list[Rule] | None = None) -> DataFrame:
    """Findings of all rules whose inputs the bundle has, with ``id`` and ``severity_rank``.

    An id is a hash of rule, asset, time and what tells the finding apart; should several agree in all, the n-th (in order
    of their other columns) has its number hashed in.
    """
    parts = [findings_of(r, bundle[r.input], profile) for r in (rules or RULES) if r.input in bundle]
    if not parts:
        raise ValueError("the bundle has no input of any rule")
    found = reduce(DataFrame.unionByName, parts)
    base = fingerprint(F.col("rule_id"), F.col("asset_id"), F.coalesce(timecode(F.col("start_us")), F.lit("")), F.col("discriminator"), F.coalesce(F.col("stream_index"), F.lit(-1)))
    found = found.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy("_base").orderBy(F.array_join("measurements", ";"), "end_us")) - 1
    found = found.withColumn("_n", n)
    return found.withColumn("id", F.substring(F.when(F.col("_n") == 0, F.col("_base")).otherwise(fingerprint(F.col("_base"), F.col("_n"))), 1, 32)).withColumn("severity_rank", severity_rank(F.col("severity"))).drop("_base", "_n")


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first, then rule, start (null as 0) and id."""
    return findings.orderBy("severity_rank", "rule_id", F.coalesce("start_us", F.lit(0)), "id")


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("findings"), n("CRITICAL").alias("critical"), n("SIGNIFICANT").alias("significant"), n("WARNING").alias("warning"), n("INFORMATIONAL").alias("informational"), F.min("severity_rank").alias("worst_rank"))
