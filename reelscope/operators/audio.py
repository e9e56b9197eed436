"""Audio: level statistics, silence, envelopes, histograms, gated loudness, loudness range, spectra.

PCM is one row for each slot: stream keys, ``slot`` (place among interleaved values) and ``value``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.media import dbfs
from reelscope.operators.video import islands

ABSOLUTE_GATE, RELATIVE_GATE = -70.0, -10.0
#: K-weighting at 48 kHz, (b0, b1, b2, a1, a2) of both stages. Fixed values of ITU-R BS.1770-4.
STAGE_1 = (1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585)
STAGE_2 = (1.0, -2.0, 1.0, -1.99004745483398, 0.99007225036621)
RATE = 48_000
#: Block of the loudness range.
SHORT_TERM_MS = 3_000


def level_stats(pcm: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """keys, peak, rms, mean, slots, peak_dbfs, rms_dbfs (null for silence). Slots of all channels count alike.

    With an ``order`` the mean is added up along it, at the price of a sort: its last bit then does not hang on how rows
    are dealt out, and neither does a text that it is rounded to.
    """
    mean = F.avg("value")
    if order is not None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        pcm = pcm.withColumn("_sum", F.sum("value").over(w)).withColumn("_place", F.row_number().over(w))
        mean = F.max_by("_sum", "_place") / F.nullif(F.count("value"), F.lit(0))
    out = pcm.groupBy(*keys).agg(F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), mean.alias("mean"), F.count("value").alias("slots"))
    return out.withColumn("peak_dbfs", dbfs(F.col("peak"))).withColumn("rms_dbfs", dbfs(F.col("rms")))


def silence_regions(pcm: DataFrame, keys: list[str], threshold: float, least: int) -> DataFrame:
    """Maximal runs of ``|value| < threshold`` of at least ``least`` slots: keys, first_slot, last_slot, length."""
    quiet = pcm.withColumn("quiet", F.abs("value") < threshold)
    runs = islands(quiet, keys, "quiet", "slot").where("quiet").groupBy(*keys, "island")
    return runs.agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("island")


def silence_totals(regions: DataFrame, keys: list[str]) -> DataFrame:
    return regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("regions"), F.sum("length").alias("silent_slots"))


def waveform(pcm: DataFrame, keys: list[str], columns: int) -> DataFrame:
    """Envelope: the slots of a stream in ``columns`` equal columns: keys, column, low, high, rms. Non-finite values are skipped."""
    n = pcm.groupBy(*keys).agg(F.greatest(F.ceil(F.count(F.lit(1)) / columns), F.lit(1)).alias("size"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("slot")) - 1
    rows = pcm.withColumn("place", place).join(n, keys).withColumn("column", F.floor(F.col("place") / F.col("size")))
    rows = rows.where("not isnan(value) and abs(value) < double('infinity')")
    return rows.groupBy(*keys, "column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def histogram(levels: DataFrame, keys: list[str], value: str = "level") -> DataFrame:
    """All 256 bins of 8-bit levels: keys, level, n."""
    counts = levels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    bins = levels.select(*keys).distinct().withColumn(value, F.explode(F.sequence(F.lit(0), F.lit(255))))
    return bins.join(counts, [*keys, value], "left").select(*keys, value, F.coalesce("n", F.lit(0)).alias("n"))


def histogram_summary(bins: DataFrame, keys: list[str], value: str = "level") -> DataFrame:
    """keys, black (share at 2 or below), white (share at 253 or above), lowest and highest level seen, peak_level (ties to the lowest)."""
    n = F.sum("n")
    return bins.groupBy(*keys).agg(
        (F.sum(F.when(F.col(value) <= 2, F.col("n")).otherwise(0)) / n).alias("black"), (F.sum(F.when(F.col(value) >= 253, F.col("n")).otherwise(0)) / n).alias("white"),
        F.min(F.when(F.col("n") > 0, F.col(value))).alias("lowest"), F.max(F.when(F.col("n") > 0, F.col(value))).alias("highest"), F.max_by(value, F.struct("n", -F.col(value))).alias("peak_level"),
    )


def integrated_loudness(blocks: DataFrame, keys: list[str], order: str = "loudness") -> DataFrame:
    """keys, lufs, blocks: mean of block loudness in the log domain, behind an absolute gate and one 10 LU under the mean of what passes it.

    ``blocks`` has ``loudness``. This mean of levels is not that of BS.1770, which averages power. If no block passes the
    absolute gate, the loudness is that gate, from no block; if none passes the relative one, the mean that set it.
    Both means are added up block by block along ``order``: a block on the relative gate itself is kept or not by the last
    bit of the sum, which must not hang on how rows are dealt out.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    growing, whole = (w.rowsBetween(Window.unboundedPreceding, end) for end in (0, Window.unboundedFollowing))
    mean = lambda c, total: F.last(total).over(whole) / F.nullif(F.count(c).over(whole), F.lit(0))
    rows = blocks.withColumn("_loud", F.when(F.col("loudness") > ABSOLUTE_GATE, F.col("loudness")))
    rows = rows.withColumn("_sum", F.sum("_loud").over(growing)).withColumn("_mean", mean("_loud", "_sum"))
    rows = rows.withColumn("_kept", F.when(F.col("_loud") > F.col("_mean") + RELATIVE_GATE, F.col("_loud"))).withColumn("_sum", F.sum("_kept").over(growing)).withColumn("_lufs", mean("_kept", "_sum"))
    out = rows.groupBy(*keys).agg(F.max("_lufs").alias("lufs"), F.max("_mean").alias("mean"), F.count("_kept").alias("n"), F.count("_loud").alias("loud"))
    return out.select(*keys, F.coalesce("lufs", "mean", F.lit(ABSOLUTE_GATE)).alias("lufs"), F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("loud")).alias("blocks"))


def loudness_range(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lra: 95th less 10th percentile (linear interpolation) of the block loudness above the absolute gate.

    ``blocks`` are of 3 seconds (``loudness_blocks(streams, SHORT_TERM_MS)``, or 30 hops): a shorter stream has none, and no row.
    """
    p = lambda q: F.expr(f"percentile(loudness, {q})")
    return blocks.where(F.col("loudness") > ABSOLUTE_GATE).groupBy(*keys).agg(F.greatest(p(0.95) - p(0.10), F.lit(0.0)).alias("lra"))


def block_spans(streams: DataFrame, keys: list[str], slots: str, block: int, hop: int) -> DataFrame:
    """Blocks that fit a stream: keys, block, first_slot. A stream shorter than a block has none."""
    fits = streams.where(F.col(slots) >= block)
    return fits.select(*keys, F.posexplode(F.sequence(F.lit(0).cast("long"), (F.col(slots) - block).cast("long"), F.lit(hop).cast("long"))).alias("block", "first_slot"))


def _biquad(x: np.ndarray, c: tuple[float, ...]) -> np.ndarray:
    """A direct-form filter from rest."""
    y = np.zeros_like(x)
    x1 = x2 = y1 = y2 = 0.0
    for i, now in enumerate(x):
        y[i] = c[0] * now + c[1] * x1 + c[2] * x2 - c[3] * y1 - c[4] * y2
        x2, x1, y2, y1 = x1, now, y1, y[i]
    return y


@lru_cache(maxsize=4)
def _response(size: int) -> np.ndarray:
    """Spectrum of what both filters answer to an impulse, long enough for a block: from rest, filtering is its convolution."""
    impulse = np.zeros(size)
    impulse[0] = 1.0
    return np.fft.rfft(_biquad(_biquad(impulse, STAGE_1), STAGE_2), 2 * size)


#: Blocks that are filtered at once.
_AT_ONCE = 32


def weighted_loudness(blocks: np.ndarray) -> np.ndarray:
    """K-weighted loudness of blocks (block, channel, frame); the filters start from rest in each, channels weigh alike."""
    size = blocks.shape[2]
    power = np.zeros(len(blocks))
    for at in range(0, len(blocks), _AT_ONCE):
        x = np.fft.rfft(blocks[at : at + _AT_ONCE].astype(float), 2 * size, axis=2) * _response(size)
        power[at : at + _AT_ONCE] = (np.fft.irfft(x, 2 * size, axis=2)[:, :, :size] ** 2).sum(axis=(1, 2)) / size
    # What is left of digital silence is rounding of the transform.
    peak = np.abs(blocks).max(axis=(1, 2), initial=0.0)
    return np.where(peak > 0, -0.691 + 10 * np.log10(np.maximum(power, 1e-300)), ABSOLUTE_GATE)


def block_loudness(samples: np.ndarray, channels: int, block_ms: int = 400) -> np.ndarray:
    """``weighted_loudness`` of blocks with 75 % overlap over interleaved samples."""
    frames = samples.reshape(-1, channels)
    size = RATE * block_ms // 1000
    hop = size // 4
    if len(frames) < size:
        return np.zeros(0)
    every = np.lib.stride_tricks.sliding_window_view(frames, size, axis=0)[::hop]  # block, channel, frame: a view
    return np.concatenate([weighted_loudness(every[at : at + _AT_ONCE]) for at in range(0, len(every), _AT_ONCE)])


def chunk_levels(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``level_stats`` from rows of ``pcm`` (array), without a row for each slot."""
    total = lambda f: F.aggregate("pcm", F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    parts = chunks.where(F.size("pcm") > 0).select(*keys, F.array_max(F.transform("pcm", lambda x: F.abs(x.cast("double")))).alias("p"), total(lambda x: x).alias("s"), total(lambda x: x * x).alias("q"), F.size("pcm").cast("long").alias("n"))
    out = parts.groupBy(*keys).agg(F.max("p").alias("peak"), F.sqrt(F.sum("q") / F.sum("n")).alias("rms"), (F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("slots"))
    return out.withColumn("peak_dbfs", dbfs(F.col("peak"))).withColumn("rms_dbfs", dbfs(F.col("rms")))


def slots_of(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slot, value: a row for each value of rows of first_slot and ``pcm``."""
    return chunks.select(*keys, "first_slot", F.posexplode("pcm").alias("i", "value")).select(*keys, (F.col("first_slot") + F.col("i")).alias("slot"), "value")


def hops(chunks: DataFrame, ms: int = 100) -> DataFrame:
    """asset_id, channels, hop, pcm: whole hops of 48 kHz audio, cut from chunks wherever these begin and end.

    Other rates are left out: the weighting is defined for 48 kHz alone.
    """
    rows = chunks.where((F.col("sample_rate") == RATE) & (F.col("channels") > 0) & (F.size("pcm") > 0))
    size = (F.lit(RATE * ms // 1000) * F.col("channels")).cast("long")
    rows = rows.withColumn("size", size).withColumn("hop", F.explode(F.expr("sequence(first_slot div size, (first_slot + size(pcm) - 1) div size)")))
    begin = F.greatest(F.col("hop") * F.col("size") - F.col("first_slot"), F.lit(0))
    end = F.least((F.col("hop") + 1) * F.col("size") - F.col("first_slot"), F.size("pcm").cast("long"))
    pieces = rows.select("asset_id", "channels", "size", "hop", (F.col("first_slot") + begin).alias("at"), F.slice("pcm", begin.cast("int") + 1, (end - begin).cast("int")).alias("pcm"))
    whole = pieces.groupBy("asset_id", "channels", "size", "hop").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "pcm"))), lambda x: x["pcm"])).alias("pcm"))
    return whole.where(F.size("pcm") == F.col("size")).select("asset_id", "channels", "hop", "pcm")


def hop_loudness(pieces: DataFrame, count: int = 4) -> DataFrame:
    """asset_id, block, loudness of each ``count`` consecutive hops: the overlapping blocks of a stream, block by block."""
    w = Window.partitionBy("asset_id").orderBy("hop")
    rows = pieces.withColumn("block_pcm", F.flatten(F.array("pcm", *[F.lead("pcm", i).over(w) for i in range(1, count)]))).withColumn("last", F.lead("hop", count - 1).over(w))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            value = [float(weighted_loudness(np.asarray(x, dtype=np.float32).reshape(-1, int(c)).T[None])[0]) for x, c in zip(part["block_pcm"], part["channels"], strict=True)]
            yield part[["asset_id", "hop"]].assign(loudness=value).rename(columns={"hop": "block"})

    rows = rows.where(F.col("last") == F.col("hop") + count - 1).select("asset_id", "channels", "hop", "block_pcm")
    return rows.mapInPandas(run, "asset_id string, block long, loudness double")


def loudness_blocks(streams: DataFrame, block_ms: int = 400) -> DataFrame:
    """asset_id, block, loudness and reason, from rows of asset_id, sample_rate, channels and ``pcm`` (array of float).

    Streams at another rate than 48 kHz, or shorter than a block, are not measured: one row with the reason and nulls.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                why = "unsupported_rate" if r.sample_rate != RATE else "too_short" if len(r.pcm) < r.channels * RATE * block_ms // 1000 else None
                found = np.zeros(0) if why else block_loudness(np.asarray(r.pcm), int(r.channels), block_ms)
                if why:
                    yield pd.DataFrame({"asset_id": [r.asset_id], "block": [None], "loudness": [None], "reason": [why]})
                else:
                    yield pd.DataFrame({"asset_id": r.asset_id, "block": np.arange(len(found)), "loudness": found, "reason": None})

    return streams.select("asset_id", "sample_rate", "channels", "pcm").mapInPandas(run, "asset_id string, block long, loudness double, reason string")


def spectrum(streams: DataFrame, frame: int = 2048) -> DataFrame:
    """asset_id, peak_hz, centroid_hz, flatness, low_ratio (to 200 Hz), high_ratio (from 5 kHz), frames; Hann windows with half overlap.

    The power of all frames is summed for each bin; DC is left out of the peak. Mono mix of all channels. Streams shorter
    than a frame are not measured, and have a row of nulls with 0 frames.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / (frame - 1))
        for part in parts:
            for r in part.itertuples():
                x = np.asarray(r.pcm, dtype=np.float32).reshape(-1, int(r.channels)).mean(axis=1)
                row = {"asset_id": r.asset_id, "peak_hz": None, "centroid_hz": None, "flatness": None, "low_ratio": None, "high_ratio": None, "frames": 0}
                if len(x) >= frame:
                    starts = range(0, len(x) - frame + 1, frame // 2)
                    power = np.zeros(frame // 2 + 1)
                    for s in starts:
                        a = np.abs(np.fft.rfft(x[s : s + frame] * window)) * 2 / frame
                        a[1:] *= 2
                        power += a**2
                    hz = np.arange(len(power)) * r.sample_rate / frame
                    total = power.sum()
                    row |= {"frames": len(starts), "peak_hz": float(hz[1 + power[1:].argmax()])}
                    if total > 0:
                        row |= {"centroid_hz": float((hz * power).sum() / total), "flatness": float(np.exp(np.log(power + 1e-20).mean()) / power.mean()), "low_ratio": float(power[hz <= 200].sum() / total), "high_ratio": float(power[hz >= 5000].sum() / total)}
                yield pd.DataFrame([row])

    return streams.select("asset_id", "sample_rate", "channels", "pcm").mapInPandas(run, "asset_id string, peak_hz double, centroid_hz double, flatness double, low_ratio double, high_ratio double, frames long")
