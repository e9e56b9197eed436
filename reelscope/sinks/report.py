"""Report bundles: JSON, CSV and HTML files with a manifest of sizes and SHA-256 digests."""

from __future__ import annotations

import hashlib
import html
import json
import os
import re
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.functions.media import safe_path, severity_rank, timecode
from reelscope.sources.ranged import digest

DISCLAIMER = "Findings are measurements, not conclusions."


def findings_table(findings: DataFrame) -> DataFrame:
    """Findings as text columns: measurements joined by ``; ``, times as timecodes, nulls empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return findings.select("asset_id", "rule_id", "severity", "confidence", "summary", F.array_join("measurements", "; ").alias("measurements"), text(F.col("stream_index").cast("string")).alias("stream"), text(timecode(F.col("start_us"))).alias("start"), text(timecode(F.col("end_us"))).alias("end"), "id")


def measurement_rows(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each measurement: keys, value, method. The method is what follows the last `` (`` of a text that ends in ``)``, else empty."""
    m = F.col("m")
    pattern = r"(?s)^(.*) \((.*)\)$"
    split = m.rlike(pattern)
    return findings.select(*keys, F.explode("measurements").alias("m")).select(*keys, F.when(split, F.regexp_extract(m, pattern, 1)).otherwise(m).alias("value"), F.when(split, F.regexp_extract(m, pattern, 2)).otherwise("").alias("method"))


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts with headers, quoted as RFC 4180 asks."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def render_html(title: str, sections: dict[str, DataFrame], most: int = 10_000) -> str:
    """A page with a table for each section, of up to ``most`` rows: a report for people, rendered on the driver.

    Where rows have a severity the gravest are shown. A section that is longer says how many rows it has.
    """
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        if "severity" in df.columns:
            df = df.orderBy(severity_rank(F.col("severity")))
        rows = df.limit(most + 1).collect()
        note = f"<p>{most} of {df.count()} rows shown</p>" if len(rows) > most else ""
        rows = rows[:most]
        out.append(f"<h2>{html.escape(name)}</h2>{note}<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows]
        out.append("</table>")
    return "".join(out) + f"<p>{html.escape(DISCLAIMER)}</p></body></html>"


def render_json(title: str, sections: dict[str, DataFrame]) -> str:
    """The whole report: every row of every section."""
    rows = lambda df: [r.asDict(True) for r in df.toLocalIterator()]
    return json.dumps({"title": title, "disclaimer": DISCLAIMER} | {k: rows(df) for k, df in sections.items()}, indent=2, default=str, sort_keys=True)


def bundle(files: dict[str, bytes]) -> list[dict[str, object]]:
    """The manifest of a bundle: name, size and sha256 of each file, by name."""
    return [{"name": k, "size": len(v), "sha256": hashlib.sha256(v).hexdigest()} for k, v in sorted(files.items())]


def asset_hashes(assets: DataFrame) -> DataFrame:
    """name, source_path, sha256, blake3, size_bytes as text, nulls empty: the rows of asset-hashes.csv."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return assets.select("name", "source_path", text("sha256"), text("blake3"), text("size_bytes"))


def note_rows(notes: DataFrame) -> DataFrame:
    """subject_kind, subject_id, body: the rows of notes.csv. A note on the whole case has no subject; the body is verbatim."""
    text = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    return notes.select(text("subject_kind", "subject_kind"), text("subject_id", "subject_id"), F.col("text").alias("body"))


def store_evidence(rows: DataFrame, path: str) -> DataFrame:
    """Write ``content`` under ``name`` (made safe) below a local or mounted folder, read it again, and return name, size,
    sha256, verified. Each task writes aside and renames, so a task that runs again leaves one whole file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, content in zip(part["safe"], part["content"], strict=True):
                at = os.path.join(path, name)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                aside = f"{at}.{secrets.token_hex(8)}.part"
                with open(aside, "wb") as file:
                    file.write(content)
                os.replace(aside, at)
                with open(at, "rb") as file:
                    again = file.read()
                out.append((name, len(again), hashlib.sha256(again).hexdigest(), again == bytes(content)))
            yield pd.DataFrame(out, columns=["name", "size", "sha256", "verified"])

    return rows.where("content is not null").select(safe_path(F.col("name")).alias("safe"), "content").mapInPandas(run, "name string, size long, sha256 string, verified boolean")


def verify_evidence(recorded: DataFrame, path: str) -> DataFrame:
    """Re-read evidence files and compare: name, size, sha256, verified. Recorded files that are gone are not verified.

    ``name`` is a path below the folder, so files of one name in two folders are told apart. Digests are taken a megabyte
    at a time; where a size is recorded it must agree too.
    """
    spark = recorded.sparkSession
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    root = re.sub("^file:/*", "/", path).rstrip("/") + "/"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, n, digest(p)[1]) for p, n in part.itertuples(index=False)], columns=["path", "now_size", "now"])

    now = listed.mapInPandas(run, "path string, now_size long, now string")
    now = now.withColumn("name", F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit(root), F.lit(""))).drop("path")
    if "size" not in recorded.columns:
        recorded = recorded.withColumn("size", F.lit(None).cast("long"))
    good = (F.col("now") == F.col("sha256")) & (F.col("size").isNull() | (F.col("size") == F.col("now_size")))
    return recorded.join(now, "name", "left").select("name", "size", "sha256", F.coalesce(good, F.lit(False)).alias("verified"))
