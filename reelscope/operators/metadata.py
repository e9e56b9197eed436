"""Metadata trees: conflicts between scopes, differences of two trees, encoder marks, missing creation times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks that name an encoder, in lower case. Fixed values.
ENCODERS = [
    ("lavf", "FFmpeg (libavformat)"),
    ("lavc", "FFmpeg (libavcodec)"),
    ("ffmpeg", "FFmpeg"),
    ("x264", "x264"),
    ("x265", "x265"),
    ("vlc", "VLC"),
    ("handbrake", "HandBrake"),
    ("mencoder", "MEncoder"),
    ("nvenc", "NVIDIA NVENC"),
    ("qsv", "Intel Quick Sync"),
    ("amf", "AMD AMF"),
]
CREATION_KEYS = ("creation_time", "date", "datetime", "created")


def conflicts(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in two scopes or more with two values or more: keys, key, entries, scopes, values."""
    out = entries.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("scope").alias("scopes"), F.countDistinct("value").alias("values"))
    return out.where("entries >= 2 and scopes >= 2 and values >= 2")


def difference(left: DataFrame, right: DataFrame, on: list[str], value: str = "value", order: str = "idx") -> DataFrame:
    """Null-safe full outer comparison by ``on``: on, left_value, right_value, verdict. Of a repeated key the first entry counts."""

    def first(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*on).orderBy(order)
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*[F.col(c).alias(f"_{name}_{c}") for c in on], F.col(value).alias(f"{name}_value"), F.lit(True).alias(f"_{name}"))

    a, b = first(left, "left"), first(right, "right")
    both = a.join(b, [F.col(f"_left_{c}").eqNullSafe(F.col(f"_right_{c}")) for c in on], "full_outer")
    verdict = F.when(F.col("_right").isNull(), "only_left").when(F.col("_left").isNull(), "only_right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "equal").otherwise("different")
    return both.select(*[F.when(F.col("_left"), F.col(f"_left_{c}")).otherwise(F.col(f"_right_{c}")).alias(c) for c in on], "left_value", "right_value", verdict.alias("verdict"))


def encoder_marks(entries: DataFrame, keys: list[str], value: str = "value", all_intra: DataFrame | None = None) -> DataFrame:
    """Distinct signs of an encoder: keys, encoder, observation, evidence, confidence.

    Only entries whose key ends in ``too`` declare an encoder; the whole value is the observation, and a title that names
    a tool is none. ``all_intra`` lists the keys of assets whose every sample is a key frame: a configuration, not a tool.
    """
    needles = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(e).alias("encoder")) for n, e in ENCODERS])
    low = F.lower(F.col(value))
    hits = F.filter(needles, lambda x: F.contains(low, x["needle"]))
    out = entries.where(F.col("key").endswith("too")).select(*keys, F.explode(hits).alias("x"), F.col(value).alias("observation"))
    out = out.select(*keys, "x.encoder", "observation", F.lit("declared_tag").alias("evidence"), F.lit("LOW").alias("confidence"))
    if all_intra is not None:
        every = (F.lit(x).alias(c) for c, x in (("encoder", "all-intra encoding"), ("observation", "every sample in the track is a sync sample"), ("evidence", "structure"), ("confidence", "MEDIUM")))
        out = out.unionByName(all_intra.select(*keys, *every))
    return out.distinct()


def lookup(entries: DataFrame, key: str | None = None, scope: str | None = None, track: int | None = None) -> DataFrame:
    """Entries of a key, a scope or a track, in order of scope, track, key and value."""
    for column, wanted in (("key", key), ("scope", scope), ("track_index", track)):
        if wanted is not None:
            entries = entries.where(F.col(column) == wanted)
    return entries.orderBy("scope", *(["track_index"] if "track_index" in entries.columns else []), "key", "value")


def missing_creation(entries: DataFrame, keys: list[str], names: tuple[str, ...] = CREATION_KEYS) -> DataFrame:
    """Trees with entries, none of them a creation time: keys, entries."""
    out = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.max(F.lower("key").isin(*names).cast("int")).alias("found"))
    return out.where("found = 0").select(*keys, "entries")
