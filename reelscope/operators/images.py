"""Luma planes: frame differences and the 64-bit block hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frame_diff(pairs: DataFrame, keys: list[str], changed_above: float) -> DataFrame:
    """keys, mean_abs, changed (share above the bound), largest, identical, of two arrays ``a`` and ``b``; null where sizes differ."""
    rows = pairs.where(F.size("a") == F.size("b")).withColumn("d", F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    n = F.size("d")
    return rows.select(
        *keys, (F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / n).alias("mean_abs"), (F.size(F.filter("d", lambda x: x > changed_above)) / n).alias("changed"),
        F.array_max("d").alias("largest"), (F.array_max("d") == 0).alias("identical"),
    )


def bit_hash(values: str, threshold: Column) -> Column:
    """64-bit hash: bit (i mod 64) is set where value i exceeds the threshold."""
    return F.aggregate(
        F.filter(F.transform(values, lambda x, i: F.when(x.cast("double") > threshold, i)), lambda i: i.isNotNull()),
        F.lit(0).cast("long"),
        lambda h, i: h.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)))),
    )


def block_hash(planes: DataFrame, keys: list[str], grid: int = 8) -> DataFrame:
    """Perceptual hash of ``luma`` (binary, ``width`` x ``height``): means of ``grid`` x ``grid`` blocks against the mean of all.

    Blocks are counted row by row, the last of each way takes the rest; block means divide down. Planes smaller than the
    grid, or shorter than they should be, have a null hash.
    """

    def one(width, height, luma) -> int | None:
        if luma is None or min(width, height) < grid or len(luma) < width * height:
            return None
        pixels = np.frombuffer(luma, dtype=np.uint8, count=width * height).reshape(height, width).astype(np.int64)
        rows, columns = (np.arange(grid) * (n // grid) for n in (height, width))
        sums = np.add.reduceat(np.add.reduceat(pixels, rows, axis=0), columns, axis=1)
        means = sums // np.outer(np.diff(np.append(rows, height)), np.diff(np.append(columns, width)))
        bits = np.flatnonzero((means > means.sum() // grid**2).ravel()) % 64
        found = int(np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0)))
        return found - (1 << 64) if found >> 63 else found

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(int(w), int(h), x) for w, h, x in zip(part["width"], part["height"], part["luma"], strict=True)]
            yield part[keys].assign(hash=pd.array(found, dtype="Int64"))

    schema = T.StructType([*(planes.schema[k] for k in keys), T.StructField("hash", T.LongType())])
    return planes.select(*keys, "width", "height", "luma").mapInPandas(run, schema)


def levels_of(planes: DataFrame, luma: str = "luma") -> DataFrame:
    """``planes`` with ``values``, the bytes of a binary column as numbers from 0 to 255."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(values=[None if x is None else np.frombuffer(x, dtype=np.uint8).astype(np.int16) for x in part[luma]])

    return planes.mapInPandas(run, T.StructType([*planes.schema.fields, T.StructField("values", T.ArrayType(T.ShortType()))]))


#: How far each planar format halves its chroma: (across, down).
PLANAR = {"yuv420p": (2, 2), "yuv422p": (2, 1), "yuv444p": (1, 1)}


def to_rgb(pictures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rgb (binary), matrix, error, from rows of format, width, height and data.

    Formats: the planar ones of ``PLANAR`` (BT.601 studio swing in 8.8 fixed point, clamped), rgb24, bgr24 and gray8. A
    picture without pixels, with too few bytes or in another format has an error and no colours; nothing is guessed.
    """

    def one(form, width, height, data) -> tuple:
        if not width or not height or width < 0 or height < 0:
            return None, None, "empty frame"
        n = width * height
        if form in PLANAR:
            across, down = PLANAR[form]
            chroma = n // (across * down)
            need = n + 2 * chroma
        else:
            need = {"rgb24": 3 * n, "bgr24": 3 * n, "gray8": n}.get(form)
        if need is None:
            return None, None, "unsupported format"
        if data is None or len(data) < need:
            return None, None, "plane size mismatch"
        raw = np.frombuffer(data, dtype=np.uint8, count=need)
        if form == "rgb24":
            return raw.tobytes(), "none (already RGB)", None
        if form == "bgr24":
            return raw.reshape(n, 3)[:, ::-1].tobytes(), "none (already RGB)", None
        if form == "gray8":
            return np.repeat(raw, 3).tobytes(), "none (gray)", None
        y = raw[:n].reshape(height, width).astype(np.int32)
        wide = max(1, width // across)
        place = np.minimum(np.arange(height) // down, max(0, chroma // wide - 1))[:, None] * wide + np.minimum(np.arange(width) // across, wide - 1)[None, :]
        u, v = (raw[n + i * chroma : n + (i + 1) * chroma].astype(np.int32)[np.minimum(place, chroma - 1)] - 128 if chroma else np.zeros_like(y) for i in (0, 1))
        base = 298 * (y - 16) + 128
        rgb = np.stack([base + 409 * v, base - 100 * u - 208 * v, base + 516 * u], axis=2) >> 8
        return np.clip(rgb, 0, 255).astype(np.uint8).tobytes(), "BT.601", None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(f, int(w or 0), int(h or 0), x) for f, w, h, x in zip(part["format"], part["width"], part["height"], part["data"], strict=True)]
            yield part[keys].assign(**{c: [x[i] for x in found] for i, c in enumerate(("rgb", "matrix", "error"))})

    schema = T.StructType([*(pictures.schema[k] for k in keys), T.StructField("rgb", T.BinaryType()), T.StructField("matrix", T.StringType()), T.StructField("error", T.StringType())])
    return pictures.select(*keys, "format", "width", "height", "data").mapInPandas(run, schema)


def pixel_at(rgb: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    """(r, g, b) of one pixel; null outside the picture, or where the buffer is shorter than its dimensions ask."""
    inside = (width > 0) & (height > 0) & (x >= 0) & (y >= 0) & (x < width) & (y < height) & (F.octet_length(rgb) >= width * height * 3)
    byte = lambda i: F.conv(F.hex(F.substring(rgb, ((y * width + x) * 3 + i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when(inside, F.struct(byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b")))
