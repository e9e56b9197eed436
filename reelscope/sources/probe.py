"""Scans of folders of media files, and format detection by signature."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.sources.ranged import digest, opened

#: File name extensions that are looked at. Fixed values.
EXTENSIONS = ("mp4", "m4v", "mov", "3gp", "mkv", "webm", "avi", "wav", "aiff", "aif", "flac", "ogg", "m4a", "mpg")
#: Extensions that agree with a format.
AGREES = {"iso_bmff": ("mp4", "m4v", "mov", "3gp", "m4a"), "matroska": ("mkv", "webm"), "wav": ("wav",), "aiff": ("aiff", "aif"), "ogg": ("ogg",), "flac": ("flac",)}


def detect(head: Column) -> Column:
    """Format of a file's first bytes: iso_bmff, matroska, wav, aiff, ogg, flac or unknown."""
    at = lambda start, size: F.hex(F.substring(head, start, size))
    text = lambda s: s.encode().hex().upper()
    size = F.octet_length(head)
    return (
        F.when((size >= 12) & (at(5, 4) == text("ftyp")), "iso_bmff").when(at(1, 4) == "1A45DFA3", "matroska")
        .when((size >= 12) & (at(1, 4) == text("RIFF")) & (at(9, 4) == text("WAVE")), "wav").when((size >= 12) & (at(1, 4) == text("FORM")) & (at(9, 4) == text("AIFF")), "aiff")
        .when(at(1, 4) == text("OggS"), "ogg").when(at(1, 4) == text("fLaC"), "flac").otherwise("unknown")
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def extension_matches(path: Column, kind: Column) -> Column:
    out = F.lit(False)
    for name, found in AGREES.items():
        out = F.when(kind == name, extension(path).isin(*found)).otherwise(out)
    return out


def _listed(spark: SparkSession, path: str, skip: tuple[str, ...]) -> DataFrame:
    """path, length and time of the files below a folder that have a media extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    files = files.where(extension(F.col("path")).isin(*EXTENSIONS))
    for name in skip:
        files = files.where(~F.contains("path", F.lit(f"/{name}/")))
    return files


def heads(files: DataFrame, size: int = 16) -> DataFrame:
    """path, length and ``head``, the first bytes of each file, fetched by a ranged read. A file that cannot be opened has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for path in part["path"]:
                try:
                    with opened(path) as file:
                        found.append(file.read(size))
                except OSError:
                    found.append(None)
            yield part.assign(head=found)

    return files.select("path", "length").mapInPandas(run, "path string, length long, head binary")


def scan(spark: SparkSession, path: str, skip: tuple[str, ...] = ("cache",)) -> DataFrame:
    """path, size, format of the media files below a folder, by path; unknown formats and folders named in ``skip`` (add
    that of the case) are passed over."""
    found = heads(_listed(spark, path, skip)).select("path", F.col("length").alias("size"), detect(F.col("head")).alias("format"))
    return found.where("format <> 'unknown'").orderBy("path")


def acquire(spark: SparkSession, path: str, skip: tuple[str, ...] = ("cache",)) -> DataFrame:
    """path, size, sha256, blake3 (null: no library), modified_us, complete of every media file below a folder.

    Files are hashed a megabyte at a time. ``complete`` says that as many bytes were read as the folder lists: a file that
    grows or shrinks meanwhile is not acquired. A file that cannot be read has a null digest.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, length, modified in part.itertuples(index=False):
                try:
                    size, sha256 = digest(path)
                except OSError:
                    size, sha256 = -1, None
                rows.append((path, length, sha256, None, modified, size == length))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256", "blake3", "modified_us", "complete"])

    files = _listed(spark, path, skip).select("path", "length", F.unix_micros("modificationTime").alias("modified_us"))
    return files.mapInPandas(run, "path string, size long, sha256 string, blake3 string, modified_us long, complete boolean")
