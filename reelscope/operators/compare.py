"""Comparison of two inspections: paired streams, field verdicts, tolerances, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict(left: Column, right: Column) -> Column:
    """equal, different, only_left, only_right, or not_comparable where neither side was measured."""
    return (
        F.when(left.isNull() & right.isNull(), "not_comparable").when(right.isNull(), "only_left").when(left.isNull(), "only_right")
        .when(left == right, "equal").otherwise("different")
    )


def within(left: Column, right: Column, tolerance: float) -> Column:
    """agree, diverge, or which side was not measured (left where neither was)."""
    return F.when(left.isNull(), "unmeasured_left").when(right.isNull(), "unmeasured_right").when(F.abs(left - right) <= tolerance, "agree").otherwise("diverge")


def pair_streams(left: DataFrame, right: DataFrame, keys: list[str], kind: str, order: str) -> DataFrame:
    """The i-th stream of each kind on the left with the i-th on the right: keys, kind, ordinal, left_<order>, right_<order>, matched."""

    def numbered(df: DataFrame, side: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(order)) - 1
        return df.select(*keys, F.col(kind).alias("kind"), n.alias("ordinal"), F.col(order).alias(f"{side}_{order}"))

    both = numbered(left, "left").join(numbered(right, "right"), [*keys, "kind", "ordinal"], "full_outer")
    return both.withColumn("matched", F.col(f"left_{order}").isNotNull() & F.col(f"right_{order}").isNotNull())


def field_diff(pairs: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """A row for each field of each pair: keys, axis, field, left, right (as text), verdict. Columns are left_<f> and right_<f>; ``fields`` gives their axes."""
    rows = [F.struct(F.lit(axis).alias("axis"), F.lit(f).alias("field"), F.col(f"left_{f}").cast("string").alias("left"), F.col(f"right_{f}").cast("string").alias("right")) for f, axis in fields.items()]
    out = pairs.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")
    return out.withColumn("verdict", verdict(F.col("left"), F.col("right")))


def axis_groups(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, differing, uncomparable; axes without either are dropped."""
    differs = F.col("verdict").isin("different", "only_left", "only_right")
    out = fields.groupBy(*keys, "axis").agg(F.count_if(differs).alias("differing"), F.count_if(F.col("verdict") == "not_comparable").alias("uncomparable"))
    return out.where("differing > 0 or uncomparable > 0")


def overall(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outcome: DIFFERENT if any field differs, else INCOMPLETE if any could not be compared, else EQUIVALENT."""
    differs = F.bool_or(F.col("verdict").isin("different", "only_left", "only_right"))
    return fields.groupBy(*keys).agg(F.when(differs, "DIFFERENT").when(F.bool_or(F.col("verdict") == "not_comparable"), "INCOMPLETE").otherwise("EQUIVALENT").alias("outcome"))


def same_layout(left: DataFrame, right: DataFrame, keys: list[str], kind: str, order: str) -> DataFrame:
    """keys, same: whether both sides have the same kinds of streams in the same order."""
    side = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind]).alias(name))
    both = side(left, "a").join(side(right, "b"), keys, "full_outer")
    return both.select(*keys, F.col("a").eqNullSafe(F.col("b")).alias("same"))


#: Axes of a comparison in report order. Fixed order.
AXES = ("container", "stream_layout", "codec", "video_format", "colour", "audio_format", "timing", "metadata", "scene_structure", "silence", "loudness")
#: Columns of a stream that are compared, by axis.
STREAM_FIELDS = {"codec": "codec", "width": "video_format", "height": "video_format", "primaries": "colour", "transfer": "colour", "channels": "audio_format", "sample_rate": "audio_format", "bit_depth": "audio_format", "duration_us": "timing", "measured_us": "timing", "start_us": "timing"}


def difference_order(fields: DataFrame) -> DataFrame:
    """By axis in report order, then field; an axis that is not listed comes last."""
    place = F.array_position(F.array(*[F.lit(a) for a in AXES]), F.col("axis"))
    return fields.withColumn("axis_order", F.when(place == 0, len(AXES)).otherwise(place - 1).cast("int")).orderBy("axis_order", "field")


def measured_differences(fields: DataFrame) -> DataFrame:
    """Fields that were measured on both sides and disagree."""
    return fields.where("verdict = 'different'")


def unstable_axes(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis: the axes on which two analyses of one file disagree. Axes nobody measured are no sign of that."""
    return measured_differences(fields).select(*keys, "axis").distinct()


def loudness_of(measurements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lufs: only integrated loudness by BS.1770 is compared; another quantity in LU counts as not measured."""
    return measurements.where("method = 'ITU-R BS.1770-4'").groupBy(*keys).agg(F.min("value").alias("lufs"))


def whole_file(left: DataFrame, right: DataFrame, keys: list[str], column: str, axis: str, field: str, tolerance: float) -> DataFrame:
    """keys, axis, field, left, right, verdict of one number for each file, equal within a tolerance."""
    both = left.select(*keys, F.col(column).alias("l")).join(right.select(*keys, F.col(column).alias("r")), keys, "full_outer")
    told = F.when(F.col("l").isNull() | F.col("r").isNull(), "not_comparable").when(F.abs(F.col("l") - F.col("r")) <= tolerance, "equal").otherwise("different")
    return both.select(*keys, F.lit(axis).alias("axis"), F.lit(field).alias("field"), F.col("l").cast("string").alias("left"), F.col("r").cast("string").alias("right"), told.alias("verdict"))


def compare_files(left: dict[str, DataFrame], right: dict[str, DataFrame], keys: list[str], loudness_lu: float = 0.5, scene_changes: float = 1.0) -> DataFrame:
    """keys, axis, field, left, right, verdict of every property of two analyses with the same keys.

    A side is a dict of streams, metadata (key, value, idx), scenes and silence (keys and ``n``, how many) and
    measurements (value, method). A table that either side lacks is not compared. Streams pair by kind and order; a stream
    without a partner differs in layout.
    """
    out = []
    have = lambda name: name in left and name in right
    if have("streams"):
        fields = {f: a for f, a in STREAM_FIELDS.items() if f in left["streams"].columns and f in right["streams"].columns}
        side = lambda df, s: df.select(*keys, F.col("stream_index").alias(f"{s}_stream_index"), *[F.col(f).alias(f"{s}_{f}") for f in fields])
        pairs = pair_streams(left["streams"], right["streams"], keys, "kind", "stream_index")
        matched = pairs.where("matched").join(side(left["streams"], "left"), [*keys, "left_stream_index"]).join(side(right["streams"], "right"), [*keys, "right_stream_index"])
        rows = field_diff(matched, [*keys, "kind", "ordinal"], fields)
        out.append(rows.select(*keys, "axis", F.concat_ws(" ", "kind", "ordinal", "field").alias("field"), "left", "right", "verdict"))
        alike = same_layout(left["streams"], right["streams"], keys, "kind", "stream_index")
        none = F.lit(None).cast("string")
        out.append(alike.select(*keys, F.lit("stream_layout").alias("axis"), F.lit("stream_layout").alias("field"), none.alias("left"), none.alias("right"), F.when(F.col("same"), "equal").otherwise("different").alias("verdict")))
    if have("metadata"):
        from reelscope.operators.metadata import difference

        rows = difference(left["metadata"], right["metadata"], [*keys, "key"])
        out.append(rows.select(*keys, F.lit("metadata").alias("axis"), F.col("key").alias("field"), F.col("left_value").alias("left"), F.col("right_value").alias("right"), "verdict"))
    if have("scenes"):
        out.append(whole_file(left["scenes"], right["scenes"], keys, "n", "scene_structure", "scene_changes", scene_changes))
    if have("silence"):
        out.append(whole_file(left["silence"], right["silence"], keys, "n", "silence", "silent_regions", 0))
    if have("measurements"):
        out.append(whole_file(loudness_of(left["measurements"], keys), loudness_of(right["measurements"], keys), keys, "lufs", "loudness", "integrated_loudness", loudness_lu))
    if not out:
        raise ValueError("the two sides share no table")
    return reduce(DataFrame.unionByName, out)


def integrity(now: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state of (keys, size, sha256) against what was recorded: intact, hash_mismatch, modified where the size
    differs, or unverifiable where either side has no digest."""
    then = recorded.select(*keys, F.col("size").alias("_size"), F.col("sha256").alias("_sha256"))
    out = now.join(then, keys, "left")
    known = F.col("sha256").isNotNull() & F.col("_sha256").isNotNull()
    state = F.when(~known, "unverifiable").when(~F.col("size").eqNullSafe(F.col("_size")), "modified").when(F.col("sha256") == F.col("_sha256"), "intact").otherwise("hash_mismatch")
    return out.select(*keys, state.alias("state"))
