"""Registered queries of the media operators, each bound to the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelscope.functions import media as M
from reelscope.operators import audio, compare, delivery, images, metadata, timing, video
from reelscope.plans import adapters as A
from reelscope.plans import rules, store, views

S = ["stream"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


# timing


@query
def pts_scan(spark, d):
    return timing.presentation_scan(A.frames(spark, d), S, A.DAY * 30)


@query
def dts_scan(spark, d):
    return timing.decode_scan(A.frames(spark, d), S)


@query
def modal_delta(spark, d):
    return timing.modal_delta(A.frames(spark, d), S)


@query
def frame_rate_changes(spark, d):
    rows = A.read(spark, d, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("idx"))
    step = F.row_number().over(Window.partitionBy("stream").orderBy("idx")).cast("long")
    rows = rows.select("stream", "idx", (step * 40_000 + F.when(step % 97 == 0, 7_000).otherwise(0)).alias("pts_us"))
    return timing.rate_changes(rows, S, 2_000)


@query
def av_sync(spark, d):
    e = A.read(spark, d, "events").select((F.col("user_id") % 64).alias("asset"), F.col("event_id").alias("idx"), M.micros("ts").alias("pts_us"), "event_type")
    side = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    return timing.nearest_after(side("view"), side("click"), ["asset"], "pts_us", "idx").select("asset", "idx", "pts_us", "key_us", "match_us")


@query
def av_sync_report(spark, d):
    e = A.read(spark, d, "events").select((F.col("user_id") % 16).alias("asset"), F.col("event_id").alias("idx"), M.micros("ts").alias("pts_us"), "event_type")
    return timing.sync_report(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["asset"])


@query
def sample_times(spark, d):
    runs = A.read(spark, d, "orders").select(F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 5).alias("n"), (F.col("o_custkey") % 7 * 100 + 40).alias("delta"))
    return timing.expand_runs(runs, S, "seq", "n", "delta")


@query
def measured_duration(spark, d):
    runs = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("stream"), F.col("l_quantity").cast("long").alias("n"), F.col("l_linenumber").cast("long").alias("delta"))
    return timing.measured_duration(runs, S)


# video


@query
def gop_segments(spark, d):
    return video.gop_segments(A.frames(spark, d), S)


@query
def gop_changes(spark, d):
    return video.gop_changes(video.gop_segments(A.frames(spark, d), S), S, 2)


@query
def gop_summary(spark, d):
    return video.gop_summary(video.gop_segments(A.frames(spark, d), S), S)


@query
def repeated_runs(spark, d):
    rows = A.read(spark, d, "events").select((F.col("user_id") % 4).alias("stream"), F.col("event_id").alias("idx"), F.col("event_type").alias("digest"), (F.col("event_id") % 3 == 0).alias("is_key"))
    return video.repeated_runs(rows, S)


@query
def sliding_bitrate(spark, d):
    out = video.sliding_bitrate(A.samples(spark, d), S, 12, 0.8)
    return out.select("stream", "idx", "start_us", "end_us", F.round("bits", 6).alias("bits"), "keyframes")


@query
def whole_bitrate(spark, d):
    return video.whole_bitrate(A.samples(spark, d), S).select("stream", "samples", F.round("average", 6).alias("average"))


@query
def byte_positions(spark, d):
    return video.byte_positions(A.samples(spark, d), S, 48).select("stream", "idx", "size", "byte_offset")


@query
def offset_asof(spark, d):
    at = video.byte_positions(A.samples(spark, d), S, 48)
    probes = A.read(spark, d, "events").select(F.col("event_type").alias("stream"), (F.col("event_id") * 977).alias("offset"))
    return video.position_at(probes, at, S)


@query
def near_duplicate_frames(spark, d):
    rows = A.read(spark, d, "events").select((F.col("user_id") % 4).alias("stream"), F.col("event_id").alias("idx"), (F.floor("value") % 32).alias("hash"))
    return video.near_duplicates(rows, S, 8)


@query
def scene_changes(spark, d):
    out = video.scene_changes(A.planes(spark, d), S, 0.25)
    return out.select("stream", "idx", F.round("mean_abs", 6).alias("mean_abs"), F.round("changed", 6).alias("changed"))


@query
def largest_scene_change(spark, d):
    out = video.scene_changes(A.planes(spark, d), S, 0.25).withColumn("mean_abs", F.round("mean_abs", 6))
    return video.largest_scene(out, S)


@query
def decode_resync(spark, d):
    rows = A.read(spark, d, "events").select((F.col("user_id") % 4).alias("stream"), F.col("event_id").alias("idx"), (F.col("event_id") % 9 == 0).alias("is_key"), (F.floor("value") % 11 != 0).alias("ok"))
    return video.resync(rows, S)


@query
def lost_intervals(spark, d):
    return video.lost_intervals(decode_resync(spark, d), S)


@query
def unexplained_packets(spark, d):
    states = decode_resync(spark, d)
    expected = A.read(spark, d, "events").select((F.col("user_id") % 4).alias("stream"), F.col("event_id").alias("idx"))
    lost = video.lost_intervals(states, S).where("skipped >= 2").select("stream", "from_idx", F.lit(2).alias("skipped"))
    return video.unexplained(expected, states.where("state = 'decoded'"), lost, S)


@query
def bit_hashes(spark, d):
    return A.read(spark, d, "embeddings").select("vec_id", images.bit_hash("embedding", F.lit(0.0)).alias("hash"))


@query
def hamming_distance(spark, d):
    h = bit_hashes(spark, d)
    pairs = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("other")), "vec_id")
    return pairs.select("vec_id", M.hamming(F.col("hash"), F.col("other")).alias("distance"))


@query
def frame_diff(spark, d):
    e = A.read(spark, d, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    out = images.frame_diff(pairs, ["vec_id"], 0.2)
    return out.select("vec_id", F.round("mean_abs", 6).alias("mean_abs"), F.round("changed", 6).alias("changed"), F.round("largest", 6).alias("largest"), "identical")


# audio


@query
def level_stats(spark, d):
    out = audio.level_stats(A.pcm(spark, d), S)
    return out.select("stream", "slots", *[F.round(c, 6).alias(c) for c in ("peak", "rms", "mean", "peak_dbfs", "rms_dbfs")])


@query
def silence_regions(spark, d):
    return audio.silence_regions(A.pcm(spark, d), S, 0.1, 2)


@query
def silence_totals(spark, d):
    return audio.silence_totals(silence_regions(spark, d), S)


@query
def waveform(spark, d):
    out = audio.waveform(A.pcm(spark, d), S, 8)
    return out.select("stream", "column", *[F.round(c, 6).alias(c) for c in ("low", "high", "rms")])


def _levels(spark, d):
    return A.read(spark, d, "events").select(F.col("event_type").alias("stream"), F.least(F.floor(F.col("value")), F.lit(255)).cast("int").alias("level"))


@query
def level_histogram(spark, d):
    return audio.histogram(_levels(spark, d), S).select("stream", F.col("level").cast("long").alias("level"), "n")


@query
def histogram_summary(spark, d):
    out = audio.histogram_summary(audio.histogram(_levels(spark, d), S), S)
    return out.select("stream", F.round("black", 6).alias("black"), F.round("white", 6).alias("white"), *[F.col(c).cast("long").alias(c) for c in ("lowest", "highest", "peak_level")])


def _blocks(spark, d):
    level = F.when(F.col("user_id") % 7 == 0, F.lit(-80.0)).otherwise(F.col("value") / 3 - 100)
    return A.read(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("block"), level.alias("loudness"))


@query
def loudness_gate(spark, d):
    return audio.integrated_loudness(_blocks(spark, d), S, "block").select("stream", F.round("lufs", 6).alias("lufs"), "blocks")


@query
def loudness_range(spark, d):
    return audio.loudness_range(_blocks(spark, d), S).select("stream", F.round("lra", 6).alias("lra"))


@query
def block_spans(spark, d):
    n = A.read(spark, d, "events").groupBy(F.col("user_id").alias("stream")).agg((F.count(F.lit(1)) * 100).alias("slots"))
    return audio.block_spans(n, S, "slots", 1000, 250).select("stream", F.col("block").cast("long").alias("block"), "first_slot")


# assets and metadata


@query
def content_hash(spark, d):
    return A.read(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query
def integrity(spark, d):
    """Recorded hashes and sizes against the texts at hand."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 3 == 0, F.reverse("text")).otherwise(F.col("text"))
    then = A.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.sha2(text.cast("binary"), 256)).alias("sha256"), F.octet_length(text).cast("long").alias("size"))
    return compare.integrity(content_hash(spark, d), then, ["doc_id"])


@query
def asset_dedupe(spark, d):
    return store.first_of_each(A.read(spark, d, "documents").select(F.lit("case-1").alias("case_id"), F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), ["case_id", "sha256"], "id").select("id", "sha256")


@query
def metadata_conflicts(spark, d):
    return metadata.conflicts(A.metadata(spark, d), ["asset"])


@query
def metadata_diff(spark, d):
    m = A.metadata(spark, d)
    return metadata.difference(m.where("scope = 'container'"), m.where("scope = 'track'"), ["asset", "key"])


@query
def missing_creation(spark, d):
    return metadata.missing_creation(A.metadata(spark, d), ["asset"], ("de",))


@query
def encoder_marks(spark, d):
    key = F.element_at(F.array(*[F.lit(x) for x in ("\u00a9too", "too", "\u00a9nam", "comment")]), (F.col("doc_id") % 4 + 1).cast("int"))
    value = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Lavf58 "), F.col("source"))).when(F.col("doc_id") % 5 == 0, F.lit("x264 - core; HandBrake")).otherwise(F.col("source"))
    docs = A.read(spark, d, "documents")
    return metadata.encoder_marks(docs.select("doc_id", key.alias("key"), value.alias("value")), ["doc_id"], all_intra=docs.where("doc_id % 11 = 0").select("doc_id"))


@query
def codec_families(spark, d):
    names = F.element_at(F.array(*[F.lit(x) for x in ("avc1", "HEVC", " mp4a", "sowt", "vp09", "zzz", ".mp3", "Apch")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return A.read(spark, d, "part").select("p_partkey", names.alias("name")).select("p_partkey", "name", M.codec_family(F.col("name")).alias("family"))


# comparison


def _pairing(spark, d):
    o = A.read(spark, d, "orders").select(F.col("o_custkey"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("index"), "o_totalprice", "o_orderpriority")
    asset = F.floor(F.col("o_custkey") / 2).alias("asset")
    return o.where("o_custkey % 2 = 0").select(asset, "*"), o.where("o_custkey % 2 = 1").select(asset, "*")


@query
def stream_pairing(spark, d):
    left, right = _pairing(spark, d)
    return compare.pair_streams(left, right, ["asset"], "kind", "index").select("asset", "kind", F.col("ordinal").cast("long").alias("ordinal"), "left_index", "right_index", "matched")


@query
def field_diff(spark, d):
    left, right = _pairing(spark, d)
    pairs = compare.pair_streams(left, right, ["asset"], "kind", "index")
    side = lambda df, s: df.select(F.col("index").alias(f"{s}_index"), F.col("o_orderpriority").alias(f"{s}_priority"), F.floor("o_totalprice").alias(f"{s}_price"))
    pairs = pairs.join(side(left, "left"), "left_index", "left").join(side(right, "right"), "right_index", "left")
    return compare.field_diff(pairs, ["asset", "kind", "ordinal"], {"priority": "codec", "price": "timing"}).select("asset", "kind", F.col("ordinal").cast("long").alias("ordinal"), "axis", "field", "left", "right", "verdict")


@query
def axis_groups(spark, d):
    return compare.axis_groups(field_diff(spark, d), ["asset"])


@query
def comparison_outcome(spark, d):
    return compare.overall(field_diff(spark, d), ["asset"])


@query
def same_layout(spark, d):
    left, right = _pairing(spark, d)
    return compare.same_layout(left, right, ["asset"], "kind", "index")


@query
def within_tolerance(spark, d):
    c = A.read(spark, d, "customer").select((F.col("c_custkey") % 100).alias("k"), "c_acctbal")
    s = A.read(spark, d, "supplier").select((F.col("s_suppkey") % 150).alias("k"), "s_acctbal")
    both = c.groupBy("k").agg(F.max("c_acctbal").alias("l")).join(s.groupBy("k").agg(F.max("s_acctbal").alias("r")), "k", "full_outer")
    return both.select("k", compare.within(F.col("l"), F.col("r"), 500.0).alias("verdict"))


@query
def packet_counts(spark, d):
    declared = A.read(spark, d, "orders").select(F.col("o_orderkey").alias("stream"), (F.col("o_orderkey") % 8).alias("packet_count"))
    return video.recovered_counts(A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("stream")), declared, S)


# delivery

_REQUIREMENTS = "id string, kind string, any_of array<string>, width int, height int, fps double, tolerance double, channels int, sample_rate int, limit_ms double"


def _checks(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("avc1", "hev1", "zzz", "ap4h")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    facts = A.read(spark, d, "part").select(
        "p_partkey", name.alias("video_codec"), F.lit(None).cast("string").alias("audio_codec"), (F.col("p_size") * 40).alias("width"), F.lit(1080).alias("height"), (F.col("p_size") / 2).alias("fps"),
        (F.col("p_partkey") % 3).cast("int").alias("channels"), F.lit(48000).alias("sample_rate"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double")).alias("av_offset_ms"), F.lit("MP4").alias("container"),
    )
    need = spark.createDataFrame(
        [
            ("r1", "video_codec", ["h264", "hevc"], None, None, None, None, None, None, None), ("r2", "resolution", None, 800, 1080, None, None, None, None, None), ("r3", "frame_rate", None, None, None, 12.5, 5.0, None, None, None),
            ("r4", "audio_channels", None, None, None, None, None, 2, None, None), ("r5", "audio_sample_rate", None, None, None, None, None, None, 48000, None), ("r6", "max_av_offset_ms", None, None, None, None, None, None, None, 30.0),
            ("r7", "container", ["mov", "mp4"], None, None, None, None, None, None, None), ("r8", "audio_codec", ["aac"], None, None, None, None, None, None, None),
        ],
        _REQUIREMENTS,
    )
    return delivery.check(facts, need, ["p_partkey"])


@query
def delivery_checks(spark, d):
    return _checks(spark, d).select("p_partkey", "id", "kind", "outcome")


@query
def delivery_verdicts(spark, d):
    return delivery.verdicts(_checks(spark, d).where("id not in ('r8', 'r6')"), ["p_partkey"])


# findings


def _findings(spark, d):
    f = A.frames(spark, d).withColumnRenamed("stream", "asset_id").withColumn("stream_index", F.lit(0))
    keys = ["asset_id", "stream_index"]
    gops = video.gop_segments(f, keys)
    e = A.pcm(spark, d).withColumnRenamed("stream", "asset_id").withColumn("value", F.col("value") * 1.0)
    bundle = {
        "timestamps": timing.presentation_scan(f, keys, A.DAY * 30),
        "gop_changes": video.gop_changes(gops, keys, rules.Profile().gop_tolerance_frames),
        "gop_summary": video.gop_summary(gops, keys),
        "levels": audio.level_stats(e, ["asset_id"], "slot").select("asset_id", "peak", (F.round(F.col("mean") * 1e6) / 1e6).alias("mean")),
    }
    return rules.evaluate(bundle)


@query
def rule_findings(spark, d):
    out = rules.ordered(_findings(spark, d))
    return out.select("asset_id", "rule_id", "severity", "confidence", "start_us", "discriminator", F.col("severity_rank").cast("long").alias("severity_rank"))


@query
def severity_counts(spark, d):
    out = rules.severity_counts(_findings(spark, d), ["asset_id"])
    return out.select("asset_id", *[F.col(c).cast("long").alias(c) for c in ("findings", "critical", "significant", "warning", "informational", "worst_rank")])


@query
def finding_verdicts(spark, d):
    return delivery.finding_verdicts(_findings(spark, d), ["asset_id"])


@query
def combined_verdicts(spark, d):
    a = delivery.finding_verdicts(_findings(spark, d), ["asset_id"])
    b = delivery.verdicts(_checks(spark, d).where("id in ('r3', 'r5', 'r7')").withColumn("asset_id", F.col("p_partkey").cast("string")), ["asset_id"]).select("asset_id", "verdict")
    return delivery.combine(a.unionByName(b), ["asset_id"])


@query
def dashboard(spark, d):
    return views.dashboard(_findings(spark, d).withColumn("status", F.when(F.length("asset_id") % 2 == 0, "NEW").otherwise("CONFIRMED")))


@query
def batch_summary(spark, d):
    return views.batch_summary(_batch(spark, d))


def _batch(spark, d):
    counts = rules.severity_counts(_findings(spark, d), ["asset_id"])
    files = A.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("asset_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 11 == 0, "FAILED").when(F.col("c_custkey") % 13 == 0, "SKIPPED").otherwise("ANALYSED").alias("status"))
    return files.join(counts.select("asset_id", "findings", "worst_rank"), "asset_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


@query
def batch_order(spark, d):
    return views.batch_order(_batch(spark, d), "severity").select("asset_id", "name", "status", "findings", F.col("worst_rank").cast("long").alias("worst_rank"))


# store and search


def _store(spark, d):
    findings = A.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("Finding for "), "c_name").alias("title"), F.col("c_mktsegment").alias("detail"), F.element_at(F.array(*[F.lit(s) for s in M.SEVERITIES]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("severity"))
    assets = A.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("detail"))
    evidence = A.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.lit("evidence").alias("detail"))
    return findings, assets, evidence


@query
def case_search(spark, d):
    return store.search(*_store(spark, d), term="1", least="WARNING", limit=200).select("arm", "id", "title", F.col("rank").cast("long").alias("rank"))


@query
def search_total(spark, d):
    return store.search(*_store(spark, d), term="NAME#0000", least=None, limit=None).agg(F.count(F.lit(1)).alias("total"))


@query
def asset_lookup(spark, d):
    assets = A.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    asked = A.read(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.upper("p_name")).alias("asked")).distinct()
    return store.lookup(assets, asked)


@query
def latest_analysis(spark, d):
    runs = A.read(spark, d, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("id"), M.micros("o_orderdate").alias("started_us"), "o_orderstatus")
    return store.latest(runs, ["asset"], ["started_us", "id"])


@query
def upsert(spark, d):
    o = A.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), "o_orderstatus")
    return store.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["id"], "version")


@query
def insert_ignore(spark, d):
    o = A.read(spark, d, "orders").select(F.col("o_custkey").alias("analysis"), F.col("o_orderpriority").alias("rule"), F.col("o_orderkey").alias("n"))
    return store.insert_ignore(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["analysis", "rule"], "n").select("analysis", "rule", "n")


@query
def timeline_retention(spark, d):
    o = A.read(spark, d, "customer").join(A.read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return store.retention(o.select(F.col("c_custkey").alias("asset"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("kept")), ["asset"], "o_orderkey", "kept")


# timeline and navigation


def _timeline(spark, d):
    e = A.read(spark, d, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 17 != 0, M.micros("ts")).alias("time_us"), F.col("event_id").cast("string").alias("reference"), F.col("event_type").alias("summary"))
    o = A.read(spark, d, "orders").select(F.lit("finding").alias("source"), M.micros("o_orderdate").alias("time_us"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("reference"), F.col("o_orderpriority").alias("summary"))
    return views.timeline(e.unionByName(o))


@query
def timeline(spark, d):
    return _timeline(spark, d).select("time_us", F.col("source_rank").cast("long").alias("source_rank"), "source", "reference", "summary")


@query
def timeline_layers(spark, d):
    return views.layers(_timeline(spark, d))


@query
def nearest_mark(spark, d):
    e = A.read(spark, d, "events").select((F.col("user_id") % 16).alias("asset"), F.col("event_id").alias("probe"), M.micros("ts").alias("at_us"), "event_type")
    marks = e.where("event_type = 'purchase'").select("asset", F.col("at_us").alias("mark_us"))
    return views.nearest_mark(e.where("event_type <> 'purchase'"), marks, ["asset"], 600_000_000)


@query
def frame_navigation(spark, d):
    out = views.navigation(A.samples(spark, d), S, 1_000_000)
    return out.select("stream", "idx", "next_key", "previous_key", "second_forward", "second_back")


# scalar functions and sinks


@query
def timecodes(spark, d):
    return A.read(spark, d, "events").select("event_id", M.timecode((F.col("event_id") - 5000) * 7_654_321).alias("timecode"))


@query
def tick_conversion(spark, d):
    return A.read(spark, d, "orders").select("o_orderkey", M.ticks_to_micros((F.col("o_orderkey") - 7000) * 123_457, F.lit(90_000)).alias("us"))


@query
def saturating(spark, d):
    big = F.lit(2**63 - 10)
    return A.read(spark, d, "orders").select("o_orderkey", M.saturating_add(big, F.col("o_orderkey") % 20).alias("up"), M.saturating_subtract(-big, F.col("o_orderkey") % 20).alias("down"))


@query
def trimmed_floats(spark, d):
    return A.read(spark, d, "events").select("event_id", M.trim_float(F.round(F.col("value"), 2)).alias("text"))


@query
def rational_equality(spark, d):
    return A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", M.same_rational(F.col("l_quantity").cast("long"), F.lit(2), F.col("l_linenumber").cast("long") * 3, F.lit(1)).alias("same")).groupBy("l_linenumber").agg(F.count_if("same").alias("same")).select(F.col("l_linenumber").cast("long").alias("l_linenumber"), "same")


@query
def profile_slugs(spark, d):
    return A.read(spark, d, "part").select("p_partkey", M.slug(F.col("p_type"), F.col("p_size")).alias("slug"))


@query
def fingerprints(spark, d):
    return A.read(spark, d, "part").select("p_partkey", M.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("fingerprint"))


@query
def measurement_rows(spark, d):
    from reelscope.sinks.report import measurement_rows as rows

    m = A.read(spark, d, "events").select("event_id", F.array(F.concat(F.col("event_id").cast("string"), F.lit(" LUFS (BS (1770) 4)")), F.col("event_type")).alias("measurements"))
    return rows(m, ["event_id"])


@query
def findings_csv(spark, d):
    from reelscope.sinks.report import findings_table

    return findings_table(_findings(spark, d)).select("asset_id", "rule_id", "severity", "measurements", "start")


@query
def file_names(spark, d):
    return A.read(spark, d, "pages").select("page_id", M.file_name(F.col("url")).alias("name"), M.html_escape(F.col("html")).alias("escaped"))


@query
def format_probe(spark, d):
    from reelscope.sources.probe import detect

    head = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("0000001C6674797069736F6D", "1A45DFA301000000", "524946460000000057415645", "464F524D0000001041494646", "4F67675300020000", "664C614300000022", "0001")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return A.read(spark, d, "part").select("p_partkey", detect(head).alias("format"))


@query
def severity_rollup(spark, d):
    """Findings by severity and rule, with subtotals."""
    return _findings(spark, d).rollup("severity", "rule_id").agg(F.count(F.lit(1)).alias("findings"))


@query
def yuv_pixels(spark, d):
    at = lambda k: (F.col("p_partkey") * k % 256).cast("int")
    return A.read(spark, d, "part").select("p_partkey", M.yuv_to_rgb(at(7), at(31), at(101)).alias("x")).select("p_partkey", *[F.col(f"x.{c}").cast("long").alias(c) for c in "rgb"])


@query
def safe_paths(spark, d):
    return A.read(spark, d, "part").select("p_partkey", M.safe_path(F.concat(F.lit("../"), "p_name", F.lit("\\..x...y./"), "p_type", F.lit("/.."))).alias("path"))


@query
def measurement_texts(spark, d):
    return A.read(spark, d, "events").select("event_id", M.measurement_text(F.round(F.col("value"), 0), "LUFS", "BS.1770-4").alias("text"))


@query
def frame_dimensions(spark, d):
    text = F.concat((F.col("p_size") * 16).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise("by"), F.lit("1080"))
    return A.read(spark, d, "part").select("p_partkey", M.dimensions(text).alias("x")).select("p_partkey", F.col("x.width").cast("long").alias("width"), F.col("x.height").cast("long").alias("height"))


@query
def referenced_evidence(spark, d):
    evidence = A.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    findings = A.read(spark, d, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 997, F.col("o_custkey") % 50).alias("evidence"))
    return store.referenced(evidence, findings)


@query
def evidence_links(spark, d):
    findings = A.read(spark, d, "events").select(F.col("user_id").cast("string").alias("asset_id"), F.concat(F.lit("VIDEO."), F.upper("event_type")).alias("rule_id"), F.when(F.col("event_id") % 3 == 0, F.floor("value")).alias("frame_index"), F.col("event_id").alias("id"))
    evidence = A.read(spark, d, "customer").select((F.col("c_custkey") % 15).cast("string").alias("asset_id"), F.floor(F.col("c_custkey") / 15).alias("frame_index"), F.col("c_custkey").alias("evidence_id"))
    return store.link_frames(findings, evidence)


@query
def against_reference(spark, d):
    a = A.read(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 45 == 0, "reference").alias("role"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return store.designated_reference(a)


# further views, comparisons and scalar functions


@query
def packet_damage(spark, d):
    declared = A.read(spark, d, "orders").select(F.col("o_orderkey").alias("stream"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 8).alias("packet_count"))
    got = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("idx"), (F.col("l_quantity").cast("long") % 10).alias("size"))
    return video.packet_damage(got, declared, S)


@query
def first_streams(spark, d):
    rows = A.read(spark, d, "events").select(F.col("user_id").alias("asset"), F.col("event_type").alias("kind"), F.col("event_id").alias("stream_index"))
    return video.first_of_kind(rows, ["asset"], "view").select("asset", "stream_index")


@query
def timeline_placement(spark, d):
    return views.placement(_timeline(spark, d))


@query
def metadata_lookup(spark, d):
    return metadata.lookup(A.metadata(spark, d), key="de", scope="track").select("asset", "scope", "key", "value", "idx")


@query
def shown_sizes(spark, d):
    cropped = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 16)
    size = M.shown_size(cropped, F.when(F.col("p_partkey") % 2 == 0, F.lit(1080)), F.lit(1920), F.lit(1088))
    aspect = M.pixel_aspect(F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")), F.col("p_partkey") % 5)
    return A.read(spark, d, "part").select("p_partkey", size.alias("x"), F.round(aspect, 6).alias("aspect"), M.channel_count(F.when(F.col("p_partkey") % 2 == 0, F.lit(2))).alias("channels")).select("p_partkey", F.col("x.width").cast("long").alias("width"), F.col("x.height").cast("long").alias("height"), "aspect", F.col("channels").cast("long").alias("channels"))


@query
def finding_ranges(spark, d):
    x = M.finding_range(F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 1000), F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 2000))
    return A.read(spark, d, "events").select("event_id", x.alias("x")).select("event_id", "x.first", "x.last")


@query
def frame_infos(spark, d):
    o = A.read(spark, d, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("stream_index"), "o_orderstatus", "o_orderpriority")
    infos = o.where("o_orderstatus = 'O'").select("asset", "stream_index", F.col("o_orderpriority").alias("info"))
    return video.zip_streams(o.where("o_orderstatus = 'F'").select("asset", "stream_index"), infos, ["asset"])


@query
def nearest_frame(spark, d):
    e = A.read(spark, d, "events").select((F.col("user_id") % 16).alias("asset"), F.col("event_id"), M.micros("ts").alias("us"), "event_type")
    return views.nearest_frame(e.where("event_type = 'purchase'").select("asset", F.col("event_id").alias("probe"), F.col("us").alias("at_us")), e.where("event_type = 'view'").select("asset", F.col("event_id").alias("idx"), F.col("us").alias("pts_us")), ["asset"])


@query
def timeline_duration(spark, d):
    rows = A.read(spark, d, "orders").select(F.col("o_custkey").alias("asset"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 40_000).alias("measured_us"))
    return views.timeline_duration(rows, ["asset"])


@query
def unstable_axes(spark, d):
    return compare.unstable_axes(field_diff(spark, d), ["asset"])


@query
def difference_order(spark, d):
    fields = field_diff(spark, d).withColumn("axis", F.when(F.col("ordinal") % 3 == 0, "other").otherwise(F.col("axis")))
    return compare.difference_order(fields).select("asset", "kind", "ordinal", "axis", F.col("axis_order").cast("long").alias("axis_order"), "field", "verdict")


def _decoded(spark, d):
    key = F.col("o_orderkey")
    return A.read(spark, d, "orders").select(F.col("o_custkey").alias("stream"), key.alias("idx"), (key * 40_000 + key % 3 * 50_000).alias("pts_us"), (key * 40_000 + 60_000).alias("dts_us"))


@query
def reorder_delays(spark, d):
    return video.reorder(_decoded(spark, d), S).select("stream", "idx", "delay_us")


@query
def reorder_summary(spark, d):
    return video.reorder_summary(_decoded(spark, d), S)


@query
def timestamp_anomalies(spark, d):
    return timing.anomalies(A.frames(spark, d), S, A.DAY * 30)


@query
def sync_flags(spark, d):
    rows = A.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 - 2).alias("initial_us"), ((F.col("o_orderkey") % 9 - 4) * 1000).alias("drift_us"))
    return timing.sync_flags(rows, 2000)


@query
def chunk_levels(spark, d):
    chunks = A.read(spark, d, "embeddings").select((F.col("vec_id") % 8).alias("stream"), F.col("embedding").alias("pcm"))
    return audio.chunk_levels(chunks, S).select("stream", "slots", *[F.round(c, 6).alias(c) for c in ("peak", "rms", "mean")])


@query
def short_digests(spark, d):
    return content_hash(spark, d).select("doc_id", M.short_digest(F.col("sha256")).alias("digest"))


@query
def audio_sniff(spark, d):
    head = F.element_at(F.array(*[F.lit(x) for x in ("RIFF1234WAVEfmt ", "RIFF1234AVI fmt ", "OggS1234OpusHead", "OggS1234 vorbis", "OggS12345678", "fLaC1234", "ID3")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return A.read(spark, d, "part").select("p_partkey", M.sniff_audio(head.cast("binary")).alias("codec"))


@query
def ycbcr_pixels(spark, d):
    at = lambda k: (F.col("p_partkey") * k % 256).cast("int")
    return A.read(spark, d, "part").select("p_partkey", M.rgb_to_ycbcr(at(7), at(31), at(101)).alias("x")).select("p_partkey", *[F.col(f"x.{c}").cast("long").alias(c) for c in ("y", "cb", "cr")])


@query
def payload_rows(spark, d):
    payload = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).when(F.col("event_id") % 11 != 0, F.col("props"))
    return store.from_payload(A.read(spark, d, "events").select("event_id", payload.alias("payload")), "k long")


@query
def unix_seconds(spark, d):
    return A.read(spark, d, "events").select("event_id", M.unix_seconds("ts").alias("at"))


@query
def timeline_lines(spark, d):
    t = _timeline(spark, d).withColumn("time_us", F.when(F.col("time_us").isNotNull(), F.lit(1_500_000).cast("long")))
    return t.select("reference", M.describe_entry(F.col("time_us"), F.col("source"), F.col("summary")).alias("line"))


@query
def batch_verdict(spark, d):
    status = F.when(F.col("c_custkey") % 11 == 0, "FAIL").when(F.col("c_custkey") % 13 == 0, "SKIPPED").when(F.col("c_custkey") % 17 == 0, "UNREADABLE").otherwise("PASS")
    return views.batch_verdict(A.read(spark, d, "customer").select(status.alias("status")))


@query
def stored_timeline(spark, d):
    runs = A.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 7).alias("started_at"))
    entries = A.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("analysis_id"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").cast("string").alias("id"))
    at = Window.orderBy("started_at", "analysis_id", "position", "id")
    return store.stored_timeline(entries, runs).where("started_at = 3").withColumn("place", F.row_number().over(at).cast("long")).select("place", "started_at", "analysis_id", "position", "id")


@query
def reduced_rationals(spark, d):
    x = M.reduced(F.col("l_orderkey") * 6 - 9000, F.col("l_linenumber").cast("long") * 4 - 8)
    return A.read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), x.alias("x")).distinct().select("l_orderkey", "line", "x.num", "x.den")


@query
def micros_as_ticks(spark, d):
    return A.read(spark, d, "orders").select("o_orderkey", M.micros_to_ticks((F.col("o_orderkey") - 7000) * 1_234_567, F.lit(90_000)).alias("ticks"))


@query
def container_names(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("MP4", "isobmff", "3g2", "mkv", "WebM", "wav", "AVI")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return A.read(spark, d, "part").select("p_partkey", M.container_family(name).alias("family"), M.pdf_escape(F.concat(F.lit("(a\\b) "), F.col("p_name"))).alias("pdf"))


@query
def checked_reference(spark, d):
    now = A.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("sha256"))
    assets = A.read(spark, d, "documents").select((F.col("doc_id") % 100).alias("case_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 900 < 100, "reference").alias("role"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return store.check_reference(store.designated_reference(assets), now)


@query
def propagated_reviews(spark, d):
    cached = A.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("NEW").alias("status"), F.lit(None).cast("string").alias("note"))
    reviews = A.read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("finding_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"))
    return store.propagate_reviews(cached, reviews)


@query
def asset_hash_rows(spark, d):
    from reelscope.sinks.report import asset_hashes

    rows = content_hash(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("name"), F.concat(F.lit("/in/"), "doc_id").alias("source_path"), F.when(F.col("doc_id") % 3 != 0, F.col("sha256")).alias("sha256"), F.lit(None).cast("string").alias("blake3"), F.col("size").alias("size_bytes"))
    return asset_hashes(rows)


def _everything(spark, d):
    """Every input of every rule, as a projection of the parts: a third to a tenth of the rows give a finding each."""
    k, n, c = F.col("p_partkey"), F.col("p_size"), lambda x: F.lit(x).cast("long")
    p = A.read(spark, d, "part").select("p_partkey", "p_size", k.cast("string").alias("asset_id"), F.lit(0).alias("stream_index"))
    t = lambda *columns: p.select("asset_id", "stream_index", *columns)
    some = lambda m: p.where(k % m == 0)
    return {
        "bitrate": some(7).select("asset_id", "stream_index", n.alias("idx"), c(5).alias("start_us"), c(9).alias("end_us"), (n * 1.0).alias("bits")),
        "damage": t(n.alias("offset"), (k % 4 == 0).alias("is_missing_data"), (k * 10).alias("at_us")).where("offset < 20"),
        "packet_damage": some(9).select("asset_id", "stream_index", F.lit("empty_sample").alias("kind"), n.alias("idx")), "decode_damage": some(8).select("asset_id", "stream_index", n.alias("idx")),
        "gop_changes": some(6).select("asset_id", "stream_index", c(1).alias("gop"), c(12).alias("previous_length"), n.alias("length"), k.alias("start_us")),
        "repeated_runs": t(c(3).alias("first_idx"), (k % 5).alias("length"), (k % 2 == 0).alias("all_key"), c(40_000).alias("start_us")),
        "timestamps": t(F.element_at(F.array(*[F.lit(x) for x in ("negative", "non_monotonic", "overlap", "gap")]), (k % 4 + 1).cast("int")).alias("kind"), k.alias("idx"), n.alias("observed"), n.alias("size")),
        "sync": p.select("asset_id", ((n - 25) * 200).alias("drift_us")), "metadata_conflicts": some(11).select("asset_id", F.lit("title").alias("key"), c(2).alias("values")),
        "streams": t(F.when(k % 5 == 0, F.lit("audio")).otherwise("video").alias("kind"), F.when(k % 13 != 0, n * 20_000).alias("duration_us"), c(500_000).alias("measured_us"), F.when(k % 17 == 0, c(5000)).otherwise(c(0)).alias("start_us"), F.when(k % 19 == 0, c(-9000)).alias("edit_us"), (k % 3 == 0).alias("all_key"), (k % 7 == 0).alias("is_hdr"), F.when(k % 2 == 0, F.lit("mdcv")).alias("hdr_metadata")),
        "containers": p.select("asset_id", (k % 4).alias("stream_count"), c(2).alias("declared_track_count"), F.when(k % 3 == 0, k % 6).alias("declared_next_track_id"), F.when(k % 10 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("anomalies")),
        "levels": p.select("asset_id", (n / 50).alias("peak"), (F.when(k % 9 == 0, n / 1000).otherwise(0.0)).alias("mean")), "silence": p.select("asset_id", c(7).alias("first_slot"), (n * 50).alias("length")),
        "gop_summary": t((k % 4).alias("gops")), "rate_changes": some(12).select("asset_id", "stream_index", n.alias("delta"), k.alias("pts_us")), "loudness": p.select("asset_id", (-n * 2.0).alias("lufs")),
        "missing_creation": some(14).select("asset_id", c(3).alias("entries")), "scenes": t(n.alias("idx"), (n * 2.0).alias("mean_abs")), "near_duplicates": some(15).select("asset_id", "stream_index", n.alias("a"), (n + 1).alias("b")),
    }


@query
def every_rule(spark, d):
    """How many findings each of the rules gives, and the severities."""
    return rules.evaluate(_everything(spark, d)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("id").alias("ids"), F.count("start_us").alias("timed"))


@query
def finding_ids(spark, d):
    """Ids and the place in the order of findings without a time."""
    only = [r for r in rules.RULES if r.id in ("CONTAINER.NO_USABLE_STREAMS", "AUDIO.INAUDIBLE")]
    found = rules.evaluate(_everything(spark, d), rules=only)
    at = Window.orderBy("severity_rank", "rule_id", F.coalesce("start_us", F.lit(0)), "id")
    return rules.ordered(found).withColumn("place", F.row_number().over(at).cast("long")).select("place", "asset_id", "rule_id", "id")
