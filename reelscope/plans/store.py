"""The case store: Parquet tables, their insert rules, and queries over them.

Plain Parquet has no transactions: an insert appends files, and what a primary key or upsert would do is done by
anti-joins and ranked unions before the write. ``CaseStore`` keeps one folder for each table.
"""

from __future__ import annotations

import json
import secrets
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelscope.functions.media import contains_ascii, fingerprint, severity_rank

SCHEMA_VERSION = 6
TABLES = {
    "cases": "id string, name string, description string",
    "assets": "id string, case_id string, path string, size bigint, sha256 string, role string",
    "analyses": "id string, case_id string, asset_id string, status string, started_at bigint, profile string, fingerprint string, writer_schema_version int",
    "streams": "asset_id string, stream_index int, kind string, codec string",
    "findings": "analysis_id string, id string, rule_id string, severity string, summary string, payload string",
    "finding_reviews": "id bigint, finding_id string, status string, note string, at bigint",
    "evidence": "id string, analysis_id string, kind string, path string, sha256 string, payload string",
    "rule_results": "analysis_id string, rule_id string, outcome string",
    "reports": "id string, case_id string, sha256 string, at bigint",
    "notes": "id bigint, case_id string, subject_kind string, subject_id string, text string",
    "timeline_entries": "analysis_id string, position bigint, id string, time_us bigint, source string, payload string",
}
KEYS = {"cases": ["id"], "assets": ["case_id", "sha256"], "analyses": ["id"], "streams": ["asset_id", "stream_index"], "findings": ["analysis_id", "id"], "evidence": ["id"], "rule_results": ["analysis_id", "rule_id"], "reports": ["id"], "timeline_entries": ["analysis_id", "position"]}


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last writer wins: new rows replace stored ones of the same key; among new ones the last by ``order``."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, ["_new", order]).drop("_new")


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows, and the first new row of each key that is not stored yet."""
    added = first_of_each(new, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")
    return stored.unionByName(added)


def retention(rows: DataFrame, keys: list[str], run: str, kept: str) -> DataFrame:
    """keys, runs, missing, state: no_runs, complete, or partial where some run kept no timeline."""
    out = rows.groupBy(*keys).agg(F.count(run).alias("runs"), F.count_if(F.col(run).isNotNull() & F.col(kept).isNull()).alias("missing"))
    return out.withColumn("state", F.when(F.col("runs") == 0, "no_runs").when(F.col("missing") == 0, "complete").otherwise("partial"))


def search(findings: DataFrame, assets: DataFrame, evidence: DataFrame, term: str | None, least: str | None = None, limit: int | None = 200) -> DataFrame:
    """arm, id, title, rank: hits in three arms, severe first, at most ``limit``.

    The severity bound holds for findings alone; assets and evidence always pass, with the lowest rank. A blank term finds nothing.
    """

    def arm(df: DataFrame, name: str, rank) -> DataFrame:
        hit = contains_ascii(F.col("title"), term) | contains_ascii(F.col("detail"), term)
        return df.where(hit).select(F.lit(name).alias("arm"), "id", "title", rank.alias("rank"))

    rank = severity_rank(F.col("severity"))
    if least is not None:
        findings = findings.where(rank <= severity_rank(F.lit(least)))
    out = reduce(DataFrame.unionByName, [arm(findings, "finding", rank), arm(assets, "asset", F.lit(3)), arm(evidence, "evidence", F.lit(3))])
    return out if limit is None else out.orderBy("rank", "id", "arm").limit(limit)


def truncated(found: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The first ``limit`` hits, and whether there are more: one row beyond them is looked at, not all that match."""
    ordered = found.orderBy("rank", "id", "arm")
    return ordered.limit(limit), len(ordered.limit(limit + 1).select("rank").collect()) > limit


def lookup(assets: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, id: the asset with that id, else with exactly that name, else with that name without case if there is but one.

    Of several exact matches the smallest id counts.
    """
    by_id = asked.join(assets, F.col("asked") == F.col("id")).select("asked", "id", F.lit(1).alias("rank"))
    exact = asked.join(assets, F.col("asked") == F.col("name")).select("asked", "id", F.lit(2).alias("rank"))
    loose = asked.join(assets, F.lower("asked") == F.lower("name")).groupBy("asked").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("asked", "id", F.lit(3).alias("rank"))
    best = by_id.unionByName(exact).unionByName(loose).groupBy("asked").agg(F.min(F.struct("rank", "id")).alias("x"))
    return asked.join(best, "asked", "left").select("asked", F.col("x.id").alias("id"))


def referenced(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence whose id some finding lists."""
    return evidence.join(findings.select(F.explode("evidence").alias("id")).distinct(), "id", "left_semi")


def link_frames(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """id, evidence_id: the frame evidence of video findings, by asset and frame; findings without a frame have none."""
    video = findings.where(F.col("rule_id").startswith("VIDEO.") & F.col("frame_index").isNotNull())
    return video.join(evidence, ["asset_id", "frame_index"]).select("id", "evidence_id")


def designated_reference(assets: DataFrame) -> DataFrame:
    """case_id, reference_id, sha256, state: the one asset with the role; ``absent`` or ``ambiguous`` otherwise."""
    marked = F.col("role") == "reference"
    out = assets.groupBy("case_id").agg(F.count_if(marked).alias("n"), F.min(F.when(marked, F.struct("id", "sha256"))).alias("x"))
    one = F.col("n") == 1
    return out.select("case_id", F.when(one, F.col("x.id")).alias("reference_id"), F.when(one, F.col("x.sha256")).alias("sha256"), F.when(F.col("n") == 0, "absent").when(one, "designated").otherwise("ambiguous").alias("state"))


def check_reference(reference: DataFrame, now: DataFrame) -> DataFrame:
    """``designated_reference`` against the digests at hand (id, sha256): state ``changed`` where the file is another by now."""
    at = now.select(F.col("id").alias("reference_id"), F.col("sha256").alias("_now"))
    out = reference.join(at, "reference_id", "left")
    changed = (F.col("state") == "designated") & ~F.col("_now").eqNullSafe(F.col("sha256"))
    return out.select("case_id", "reference_id", "sha256", F.when(changed, "changed").otherwise(F.col("state")).alias("state"))


def propagate_reviews(cached_findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Cached findings with the status and note of the last review of each; one without a review keeps its own."""
    last = latest(reviews, ["finding_id"], ["id"]).select("finding_id", F.col("status").alias("_status"), F.col("note").alias("_note"))
    out = cached_findings.join(last, cached_findings["id"] == last["finding_id"], "left").drop("finding_id")
    return out.withColumn("status", F.coalesce("_status", "status")).withColumn("note", F.coalesce("_note", "note")).drop("_status", "_note")


def to_payload(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``payload``, the other columns as one JSON object."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("payload"))


def from_payload(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``payload`` beside the others; rows whose payload is null or cannot be read are passed over."""
    bad = "_unread"
    parsed = F.from_json("payload", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = df.where("payload is not null").withColumn("_p", parsed).where(f"_p is not null and _p.{bad} is null")
    return rows.select(*[c for c in df.columns if c != "payload"], "_p.*").drop(bad)


def stored_timeline(entries: DataFrame, analyses: DataFrame) -> DataFrame:
    """Timeline entries in stored order: when their analysis began, its id, position, id."""
    began = analyses.select(F.col("id").alias("analysis_id"), "started_at")
    return entries.join(began, "analysis_id").orderBy("started_at", "analysis_id", "position", "id")


def cache_key(version: str, sha256: str, profile: str, rule_ids: list[str]) -> str:
    return ":".join([version, sha256, profile, "\n".join(sorted(rule_ids))])


def cached(assets: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Assets with a usable cache entry: all parts of the key agree, and the payload parses."""
    return assets.join(cache.where(F.col("payload").isNotNull()), keys, "left_semi")


def analysis_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(F.col("asset_id"), F.col("profile"), F.col("writer_schema_version")))


_LAST = [0]


def next_id() -> int:
    """An id above all that this process gave before: microseconds of the clock and 10 bits by chance, so that two writers
    need not read each other's rows and do not clash."""
    _LAST[0] = max(_LAST[0] + 1, time.time_ns() // 1000 << 10 | secrets.randbits(10))
    return _LAST[0]


class CaseStore:
    """Tables of one or more cases as Parquet folders under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table; empty if nothing was ever inserted."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append the rows whose keys are not stored; tables without a key take all."""
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows = rows.select(*columns)
        if name in KEYS:
            rows = rows.dropDuplicates(KEYS[name]).join(self.table(name).select(*KEYS[name]), KEYS[name], "left_anti").select(*columns)
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def review(self, finding_id: str, status: str, note: str, at: int) -> None:
        """Append a review; the finding must exist."""
        if not self.table("findings").where(F.col("id") == finding_id).take(1):
            raise ValueError(f"no finding {finding_id}")
        self.insert("finding_reviews", self.spark.createDataFrame([(next_id(), finding_id, status, note, at)], TABLES["finding_reviews"]))

    def note(self, case_id: str, text: str, subject_kind: str | None = None, subject_id: str | None = None) -> None:
        """Add a note; a subject needs both kind and id."""
        if (subject_kind is None) != (subject_id is None):
            raise ValueError("a subject needs both kind and id")
        self.insert("notes", self.spark.createDataFrame([(next_id(), case_id, subject_kind, subject_id, text)], TABLES["notes"]))

    def reviewed_findings(self) -> DataFrame:
        """Findings with the status and note of their last review."""
        last = latest(self.table("finding_reviews"), ["finding_id"], ["id"]).select("finding_id", "status", "note")
        found = self.table("findings")
        return found.join(last, found["id"] == last["finding_id"], "left").drop("finding_id").withColumn("status", F.coalesce("status", F.lit("NEW")))

    def in_case(self, name: str, case_id: str) -> DataFrame:
        """Rows of findings, evidence or timeline_entries that belong to a case's analyses."""
        ids = self.table("analyses").where(F.col("case_id") == case_id).select(F.col("id").alias("analysis_id"))
        return self.table(name).join(ids, "analysis_id", "left_semi")

    def only_case(self) -> str | None:
        """The id of the only case; None if there is none, or more than one."""
        found = self.table("cases").select("id").limit(2).collect()
        return found[0].id if len(found) == 1 else None

    def count(self, name: str) -> int:
        if name not in TABLES:
            raise ValueError(f"no table {name}")
        return self.table(name).count()

    def assets_in_case(self, case_id: str) -> DataFrame:
        return self.table("assets").where(F.col("case_id") == case_id).orderBy("id")

    def reviews_of(self, finding_id: str) -> DataFrame:
        """Reviews of a finding in the order they were made."""
        return self.table("finding_reviews").where(F.col("finding_id") == finding_id).orderBy("id")

    def notes_of(self, case_id: str | None = None, subject_kind: str | None = None, subject_id: str | None = None) -> DataFrame:
        """Notes of a case, a subject or both, in the order they were made."""
        out = self.table("notes")
        for column, wanted in (("case_id", case_id), ("subject_kind", subject_kind), ("subject_id", subject_id)):
            if wanted is not None:
                out = out.where(F.col(column) == wanted)
        return out.orderBy("id")

    def load_report(self, case_id: str) -> dict[str, DataFrame]:
        """What a report of a case shows: assets, the last analysis of each, its findings with their reviews, evidence
        that some finding may name, timeline and notes. Earlier analyses are left out."""
        runs = self.table("analyses").where(F.col("case_id") == case_id)
        last = latest(runs, ["asset_id"], ["started_at", "id"])
        ids = last.select(F.col("id").alias("analysis_id"))
        of = lambda df: df.join(ids, "analysis_id", "left_semi")
        return {
            "case": self.table("cases").where(F.col("id") == case_id), "assets": self.assets_in_case(case_id), "analyses": last.orderBy("asset_id"),
            "findings": of(self.reviewed_findings()).orderBy(severity_rank(F.col("severity")), "rule_id", "id"), "evidence": of(self.table("evidence")).orderBy("id"),
            "timeline": stored_timeline(of(self.table("timeline_entries")), last), "notes": self.notes_of(case_id),
        }


class Cache:
    """Analyses by a key of four parts, one file each: written aside and renamed, so that no reader meets half an entry.

    Files go through Hadoop's file systems, so the folder may be on storage that all share.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, key: str, end: str = ""):
        import hashlib

        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{hashlib.sha256(key.encode()).hexdigest()}.json{end}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def put(self, version: str, sha256: str, profile: str, rule_ids: list[str], payload: dict) -> None:
        key = cache_key(version, sha256, profile, rule_ids)
        files, part = self._at(key, f".{secrets.token_hex(8)}.part")
        out = files.create(part, True)
        out.write(bytearray(json.dumps({"key": key, "payload": payload}, sort_keys=True).encode()))
        out.close()
        _, at = self._at(key)
        if files.exists(at):
            files.delete(at, False)
        files.rename(part, at)

    def get(self, version: str, sha256: str, profile: str, rule_ids: list[str]) -> dict | None:
        """The payload; None if there is no entry. One that cannot be read, or is of another key, is deleted."""
        key = cache_key(version, sha256, profile, rule_ids)
        files, at = self._at(key)
        if not files.exists(at):
            return None
        raw = self.spark.read.text(at.toString(), wholetext=True).first()
        try:
            found = json.loads(raw[0])
            if found["key"] == key:
                return found["payload"]
        except (ValueError, KeyError, TypeError):
            pass
        files.delete(at, False)
        return None


#: A case's manifest, and cached analyses, as JSON.
MANIFEST_SCHEMA = "id string, name string, description string, schema_version int, assets array<struct<id: string, path: string, size: bigint, sha256: string>>"


def load_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row for each manifest below a folder; what cannot be read is passed over."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("id is not null")
