"""Delivery profiles: requirements against measured facts, verdicts, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.functions.media import codec_family, container_family, fingerprint

KINDS = ("video_codec", "audio_codec", "resolution", "frame_rate", "audio_channels", "audio_sample_rate", "max_av_offset_ms", "container")
#: A profile in JSON: name, version and requirements.
PROFILE_SCHEMA = """name string, version int, requirements array<struct<id: string, kind: string, any_of: array<string>, width: int, height: int,
fps: double, tolerance: double, channels: int, sample_rate: int, limit_ms: double>>"""


def load_profiles(spark, path: str) -> DataFrame:
    """name, version and a row for each requirement of the profiles in JSON files."""
    found = spark.read.schema(PROFILE_SCHEMA).option("multiLine", True).json(path)
    return found.select("name", "version", F.explode("requirements").alias("r")).select("name", "version", "r.*")


def check(facts: DataFrame, requirements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, kind, expected, observed, outcome for each requirement of each asset.

    ``facts`` has nullable video_codec, audio_codec, width, height, fps, channels, sample_rate, av_offset_ms, container. What
    was not measured (null, or 0 channels or Hz) is UNDETERMINED, as is a codec of no known family on either side.
    Requirements are a handful of rows of a profile, and are broadcast; at most 10,000 are allowed.
    """
    few = requirements.limit(10_001)
    if few.count() > 10_000:
        raise ValueError("a profile has at most 10,000 requirements")
    rows = facts.crossJoin(F.broadcast(few.withColumnsRenamed({"width": "r_width", "height": "r_height", "fps": "r_fps", "channels": "r_channels", "sample_rate": "r_sample_rate"})))

    def met(known: Column, ok: Column) -> Column:
        return F.when(~F.coalesce(known, F.lit(False)), "UNDETERMINED").when(F.coalesce(ok, F.lit(False)), "MET").otherwise("NOT_MET")

    wanted = F.array_compact(F.transform("any_of", codec_family))

    def codec(c: str) -> Column:
        family = codec_family(F.col(c))
        return met(family.isNotNull() & (F.size(wanted) > 0), F.array_contains(wanted, F.coalesce(family, F.lit(""))))

    kind = F.col("kind")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    outcome = (
        F.when(kind == "video_codec", codec("video_codec")).when(kind == "audio_codec", codec("audio_codec"))
        .when(kind == "resolution", met(F.col("width").isNotNull() & F.col("height").isNotNull(), (F.col("width") == F.col("r_width")) & (F.col("height") == F.col("r_height"))))
        .when(kind == "frame_rate", met(F.col("fps").isNotNull(), F.abs(F.col("fps") - F.col("r_fps")) <= F.coalesce("tolerance", F.lit(0.0))))
        .when(kind == "audio_channels", met(positive("channels").isNotNull(), F.col("channels") == F.col("r_channels")))
        .when(kind == "audio_sample_rate", met(positive("sample_rate").isNotNull(), F.col("sample_rate") == F.col("r_sample_rate")))
        .when(kind == "max_av_offset_ms", met(F.col("av_offset_ms").isNotNull(), F.abs("av_offset_ms") <= F.col("limit_ms")))
        .when(kind == "container", met(F.col("container").isNotNull(), F.array_contains(F.transform("any_of", container_family), container_family(F.col("container")))))
        .otherwise("UNDETERMINED")
    )
    expected = (
        F.when(kind.isin("video_codec", "audio_codec", "container"), F.array_join("any_of", " or ")).when(kind == "resolution", F.concat_ws("x", "r_width", "r_height"))
        .when(kind == "frame_rate", F.col("r_fps").cast("string")).when(kind == "audio_channels", F.col("r_channels").cast("string"))
        .when(kind == "audio_sample_rate", F.col("r_sample_rate").cast("string")).when(kind == "max_av_offset_ms", F.col("limit_ms").cast("string"))
    )
    observed = (
        F.when(kind == "video_codec", F.col("video_codec")).when(kind == "audio_codec", F.col("audio_codec")).when(kind == "container", F.col("container"))
        .when(kind == "resolution", F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", "width", "height")))
        .when(kind == "frame_rate", F.col("fps").cast("string")).when(kind == "audio_channels", F.col("channels").cast("string"))
        .when(kind == "audio_sample_rate", F.col("sample_rate").cast("string")).when(kind == "max_av_offset_ms", F.col("av_offset_ms").cast("string"))
    )
    return rows.select(*keys, "id", "kind", expected.alias("expected"), observed.alias("observed"), outcome.alias("outcome"))


def verdicts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, not_met, undetermined, verdict: what is not met or not determined blocks delivery."""
    out = checks.groupBy(*keys).agg(F.count_if(F.col("outcome") == "NOT_MET").alias("not_met"), F.count_if(F.col("outcome") == "UNDETERMINED").alias("undetermined"))
    return out.withColumn("verdict", F.when(F.col("not_met") + F.col("undetermined") > 0, "FAIL").otherwise("PASS"))


#: Verdicts from best to worst.
RANKS = ("PASS", "PASS_WITH_WARNINGS", "FAIL")


def finding_verdicts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Critical and significant findings fail, warnings pass with warnings."""
    s = F.col("severity")
    return findings.groupBy(*keys).agg(F.when(F.bool_or(s.isin("CRITICAL", "SIGNIFICANT")), "FAIL").when(F.bool_or(s == "WARNING"), "PASS_WITH_WARNINGS").otherwise("PASS").alias("verdict"))


def combine(all_verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The worst verdict of each key."""
    order = F.array(*[F.lit(x) for x in RANKS])
    return all_verdicts.groupBy(*keys).agg(F.element_at(order, F.max(F.array_position(order, F.col("verdict"))).cast("int")).alias("verdict"))


def profile_fingerprint(requirements: DataFrame) -> DataFrame:
    """name, version, fingerprint: SHA-256 over the requirements in a canonical order."""
    text = fingerprint(*[F.col(c) if c != "any_of" else F.array_join("any_of", ",") for c in ("id", "kind", "any_of", "width", "height", "fps", "tolerance", "channels", "sample_rate", "limit_ms")])
    return requirements.groupBy("name", "version").agg(fingerprint(F.col("name"), F.col("version"), F.array_join(F.array_sort(F.collect_list(text)), "\n")).alias("fingerprint"))
