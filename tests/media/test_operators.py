"""Properties of the sequence operators on random input, against small sequential models."""

from __future__ import annotations

import random

import numpy as np
import pytest

from reelscope.functions import media as M
from reelscope.operators import audio, images, timing, video
from reelscope.plans import store, views
from reelscope.sinks import report

S = ["stream"]


@pytest.fixture(scope="module")
def tracks():
    rng = random.Random(4)
    rows = []
    for stream in range(25):
        for idx in range(rng.randint(0, 40)):
            rows.append((stream, idx, rng.randint(-2_000_000, 2_000_000), rng.random() < 0.2, rng.choice("abcd"), rng.randint(0, 99), rng.random() < 0.8))
    return rows


@pytest.fixture(scope="module")
def frames(spark, tracks):
    return spark.createDataFrame(tracks, "stream long, idx long, pts_us long, is_key boolean, digest string, size long, ok boolean").cache()


def by_stream(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_groups_of_pictures_cover_each_stream_from_its_first_key(frames, tracks):
    gops = by_stream([tuple(r) for r in video.gop_segments(frames, S).orderBy("stream", "gop").collect()])
    for stream, rows in by_stream(tracks).items():
        keys = [i for i, r in enumerate(rows) if r[3]]
        mine = gops.get(stream, [])
        assert [g[2] for g in mine] == keys
        if mine:
            assert sum(g[3] for g in mine) == len(rows) - keys[0]
            assert all(a[2] + a[3] == b[2] for a, b in zip(mine, mine[1:], strict=False))


def test_every_repeated_run_is_found_once(frames, tracks):
    got = sorted((r.stream, r.first_idx, r.last_idx) for r in video.repeated_runs(frames, S).collect())
    expected = []
    for stream, rows in by_stream(tracks).items():
        i = 0
        while i < len(rows):
            j = i
            while j + 1 < len(rows) and rows[j + 1][4] == rows[i][4]:
                j += 1
            if j > i:
                expected.append((stream, i, j))
            i = j + 1
    assert got == sorted(expected)


def test_resync_follows_the_sequential_decoder(frames, tracks):
    got = {(r.stream, r.idx): r.state for r in video.resync(frames, S).collect()}
    for stream, rows in by_stream(tracks).items():
        lost = False
        for r in rows:
            if not r[6]:
                lost, state = True, "failed"
            elif lost and not r[3]:
                state = "lost"
            else:
                lost, state = False, "decoded"
            assert got[stream, r[1]] == state


def test_forward_pairing_follows_the_cursor(spark, frames, tracks):
    rng = random.Random(8)
    audio_rows = [(s, rng.randint(-2_000_000, 2_000_000)) for s in range(0, 25, 2) for _ in range(6)]
    got = {(r.stream, r.idx): r.match_us for r in timing.nearest_after(frames, spark.createDataFrame(audio_rows, "stream long, pts_us long"), S, "pts_us", "idx").collect()}
    for stream, rows in by_stream(tracks).items():
        marks = sorted(t for s, t in audio_rows if s == stream)
        at = 0
        for r in rows:
            while marks and at < len(marks) - 1 and marks[at] < r[2]:
                at += 1
            assert got[stream, r[1]] == (marks[at] if marks else None)


def test_regular_tracks_have_no_anomalies_and_negatives_are_exact(spark, frames, tracks):
    regular = spark.createDataFrame([(1, i, i * 40_000) for i in range(50)], "stream long, idx long, pts_us long")
    assert timing.presentation_scan(regular, S, 2_000).count() == 0
    got = timing.presentation_scan(frames, S, 2_000).where("kind = 'negative'").count()
    assert got == sum(r[2] < 0 for r in tracks)


def test_near_duplicates_stay_within_the_band(frames, tracks):
    got = sorted((r.stream, r.a, r.b) for r in video.near_duplicates(frames.withColumnRenamed("digest", "hash"), S, 5).collect())
    expected = sorted((s, a[1], b[1]) for s, rows in by_stream(tracks).items() for i, a in enumerate(rows) for b in rows[i + 1 : i + 6] if a[4] == b[4])
    assert got == expected


def test_scene_scan_stops_at_a_change_of_size(spark):
    rows = [(1, 0, [0.0, 0.0]), (1, 1, [10.0, 0.0]), (1, 3, [0.0, 0.0]), (1, 4, [1.0, 1.0]), (1, 5, [1.0]), (1, 6, [2.0])]
    out = video.scene_changes(spark.createDataFrame(rows, "stream long, idx long, values array<double>"), S, 5)
    assert sorted((r.idx, r.mean_abs, r.changed) for r in out.collect()) == [(1, 5.0, 0.5), (4, 1.0, 0.0)]


def test_rate_changes_need_a_true_majority(spark):
    rows = [(1, i, i * 40_000) for i in range(10)] + [(1, 10, 9 * 40_000 + 90_000)] + [(2, 0, 0), (2, 1, 10), (2, 2, 30), (2, 3, 60)]
    out = timing.rate_changes(spark.createDataFrame(rows, "stream long, idx long, pts_us long"), S, 2_000).collect()
    assert [(r.stream, r.delta, r.dominant) for r in out] == [(1, 90_000, 40_000)]


def test_loudness_of_tones(spark):
    t = np.arange(48_000) / 48_000
    tone = np.sin(2 * np.pi * 997 * t)
    assert audio.block_loudness(tone, 1).mean() == pytest.approx(-3.01, abs=0.1)  # full-scale sine
    slow = audio._biquad(audio._biquad(tone[:19_200], audio.STAGE_1), audio.STAGE_2)  # the filters sample by sample
    assert audio.block_loudness(tone, 1)[0] == pytest.approx(-0.691 + 10 * np.log10((slow**2).mean()), abs=1e-9)
    assert audio.block_loudness(tone * 0.1, 1).mean() == pytest.approx(-23.01, abs=0.1)
    rows = [("tone", 48_000, 1, tone.tolist()), ("short", 48_000, 1, [0.0] * 100), ("slow", 44_100, 1, tone.tolist()), ("silent", 48_000, 2, [0.0] * 48_000)]
    df = spark.createDataFrame(rows, "asset_id string, sample_rate int, channels int, pcm array<float>")
    blocks = audio.loudness_blocks(df).cache()
    assert {r.asset_id: r.reason for r in blocks.where("reason is not null").collect()} == {"short": "too_short", "slow": "unsupported_rate"}
    out = {r.asset_id: r.lufs for r in audio.integrated_loudness(blocks.where("reason is null"), ["asset_id"]).collect()}
    assert out["tone"] == pytest.approx(-3.01, abs=0.1) and out["silent"] == -70
    spectrum = {r.asset_id: r for r in audio.spectrum(df).collect()}
    assert abs(spectrum["tone"].peak_hz - 997) < 24 and spectrum["short"].frames == 0 and spectrum["tone"].low_ratio < 0.01


def test_block_hash(spark):
    bright = bytes(200 if (i % 16) < 8 else 10 for i in range(256))
    out = images.block_hash(spark.createDataFrame([(1, 16, 16, bytearray(bright)), (2, 4, 4, bytearray(16))], "id long, width int, height int, luma binary"), ["id"])
    got = {r.id: r.hash for r in out.collect()}
    assert got[1] == int("0f" * 8, 16) and got[2] is None


def test_time_functions(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        M.timecode(F.lit(-3_723_004_999)).alias("a"), M.timecode(F.lit(360_000_000_000)).alias("b"), M.ticks_to_micros(F.lit(2**62), F.lit(1)).alias("c"), M.ticks_to_micros(F.lit(-7), F.lit(3_000_000)).alias("d"), M.trim_float(F.lit(2.50)).alias("e"), M.trim_float(F.lit(100.0)).alias("f"),
        M.saturating_subtract(F.lit(-(2**63)), F.lit(1)).alias("g"), M.contains_ascii(F.lit("100% Pure_x"), "% pURE_").alias("h"), M.contains_ascii(F.lit("x"), "  ").alias("i"),
    ).first()
    assert tuple(row) == ("-01:02:03.004", "100:00:00.000", 2**63 - 1, -2, "2.5", "100", -(2**63), True, False)


def test_case_store(spark, tmp_path):
    s = store.CaseStore(spark, str(tmp_path))
    assert s.only_case() is None
    s.insert("cases", spark.createDataFrame([("c1", "one", None), ("c1", "again", None)], store.TABLES["cases"]))
    assert s.only_case() == "c1" and s.count("cases") == 1
    asset = lambda i, sha: (i, "c1", "p", 1, sha, None)
    s.insert("assets", spark.createDataFrame([asset("a", "x"), asset("b", "y")], store.TABLES["assets"]))
    s.insert("assets", spark.createDataFrame([asset("z", "x"), asset("d", "w")], store.TABLES["assets"]))
    assert sorted(r.id for r in s.table("assets").collect()) == ["a", "b", "d"]
    s.insert("analyses", spark.createDataFrame([("n1", "c1", "a", "done", 5, "p", "f", 6)], store.TABLES["analyses"]))
    s.insert("findings", spark.createDataFrame([("n1", "f1", "R", "WARNING", "s", "{}")], store.TABLES["findings"]))
    s.review("f1", "CONFIRMED", "yes", 1)
    s.review("f1", "DISMISSED", "no", 2)
    assert [r.status for r in s.reviewed_findings().collect()] == ["DISMISSED"] and s.in_case("findings", "c1").count() == 1
    with pytest.raises(ValueError):
        s.review("nope", "NEW", "", 3)
    with pytest.raises(ValueError):
        s.note("c1", "text", "finding", None)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("<b>", None)], "name string, value string")
    page = report.render_html("T & U", {"Rows": df})
    assert "&lt;b&gt;" in page and "T &amp; U" in page and report.DISCLAIMER in page
    assert '"disclaimer"' in report.render_json("t", {"rows": df})
    assert report.bundle({"b": b"2", "a": b""})[0]["name"] == "a"
    report.write_csv(spark.createDataFrame([('say "hi", all',)], "t string"), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert '"say ""hi"", all"' in text
    (tmp_path / "evidence").mkdir()
    (tmp_path / "evidence" / "e1").write_bytes(b"proof")
    import hashlib

    rows = [("e1", hashlib.sha256(b"proof").hexdigest()), ("e2", "0")]
    got = report.verify_evidence(spark.createDataFrame(rows, "name string, sha256 string"), str(tmp_path / "evidence"))
    assert {r.name: r.verified for r in got.collect()} == {"e1": True, "e2": False}


def test_jump_targets(spark):
    rows = [(["e"], 1, 0, "x"), ([], 1, 0, "x"), ([], None, 0, "x"), ([], None, None, "x"), ([], None, None, None)]
    out = views.jump_target(spark.createDataFrame(rows, "evidence array<string>, frame_index int, stream_index int, id string"))
    assert [r.target for r in out.collect()] == ["evidence", "frame", "stream", "findings", "nowhere"]


def test_streams_of_samples(spark, tmp_path):
    from reelscope.streaming import intake

    rows = [(f"{i}", f"h{i % 3}", f"2024-01-01 00:00:{i:02d}") for i in range(9)]
    df = spark.createDataFrame(rows, "id string, sha256 string, t string").selectExpr("id", "sha256", "cast(t as timestamp) as seen_at", "cast(t as timestamp) as at", "10L as size", "0.0 as value", "1 as k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: intake.watch(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " "))
    for name, stream, n in (("new_assets", intake.new_assets(src()), 3), ("bits", intake.rolling_bitrate(src(), ["k"]), None), ("quiet", intake.quiet_sessions(src(), ["k"], 0.1), None)):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        if n is not None:
            assert spark.table(name).count() == n


def test_reports_lose_no_rows_in_silence(spark):
    import json

    df = spark.range(10_050).selectExpr("id", "IF(id = 10049, 'CRITICAL', 'WARNING') AS severity")
    found = json.loads(report.render_json("t", {"findings": df}))["findings"]
    assert sorted(r["id"] for r in found) == list(range(10_050))
    page = report.render_html("t", {"findings": df}, most=3)
    assert "3 of 10050 rows shown" in page and page.index("10049") < page.index("WARNING") and page.count("<tr>") == 4
    assert "rows shown" not in report.render_html("t", {"findings": df.limit(3)}, most=3)


def test_loudness_by_hops_equals_that_of_whole_streams(spark):
    rng = np.random.default_rng(1)
    pcm = (rng.normal(size=2 * 60_000) * 0.1).astype(np.float32)
    rows, at = [], 0
    for n in (10_000, 2, 47_998, 30_000, 32_000):
        rows.append(("a", 2, 48_000, at, pcm[at : at + n].tolist()))
        at += n
    rows.append(("slow", 1, 44_100, 0, [0.1] * 44_100))
    chunks = spark.createDataFrame(rows, "asset_id string, channels int, sample_rate int, first_slot long, pcm array<float>")
    got = {r.block: r.loudness for r in audio.hop_loudness(audio.hops(chunks)).collect()}
    whole = audio.block_loudness(pcm, 2)
    assert len(got) == len(whole) == 9 and [got[i] for i in range(9)] == pytest.approx(list(whole), abs=1e-9)
    levels = audio.chunk_levels(chunks, ["asset_id"]).where("asset_id = 'a'").first()
    assert levels.peak == pytest.approx(float(np.abs(pcm).max())) and levels.slots == len(pcm) and levels.mean == pytest.approx(float(pcm.mean()), abs=1e-7)
    assert sorted(r.slot for r in audio.slots_of(chunks.where("asset_id = 'a'"), ["asset_id"]).collect()) == list(range(len(pcm)))


def test_gates_of_loudness(spark):
    rows = [("silent", -70.0), ("silent", -80.0), ("loud", -20.0), ("loud", -22.0), ("loud", -50.0), ("loud", -90.0)]
    out = {r.k: (r.lufs, r.blocks) for r in audio.integrated_loudness(spark.createDataFrame(rows, "k string, loudness double"), ["k"]).collect()}
    assert out == {"silent": (-70.0, 0), "loud": (-21.0, 2)}


def test_colours(spark):
    from pyspark.sql import functions as F

    y, u, v = bytes([16, 81, 145, 235]), bytes([90]), bytes([240])
    rows = [
        ("p420", "yuv420p", 2, 2, y + u + v), ("p422", "yuv422p", 2, 2, y + u * 2 + v * 2), ("p444", "yuv444p", 2, 2, y + u * 4 + v * 4), ("rgb", "rgb24", 1, 2, b"abcdef"), ("bgr", "bgr24", 1, 2, b"abcdef"),
        ("gray", "gray8", 2, 1, b"az"), ("none", "yuv420p", 0, 2, y), ("cut", "yuv420p", 2, 2, y), ("odd", "nv12", 2, 2, y), ("null", "rgb24", 1, 1, None),
    ]
    got = {r.id: r for r in images.to_rgb(spark.createDataFrame([(a, b, c, d, None if e is None else bytearray(e)) for a, b, c, d, e in rows], "id string, format string, width int, height int, data binary"), ["id"]).collect()}

    def pixel(luma):
        c, d, e = 298 * (luma - 16), 90 - 128, 240 - 128
        return [min(max((x + 128) >> 8, 0), 255) for x in (c + 409 * e, c - 100 * d - 208 * e, c + 516 * d)]

    expected = bytes(sum((pixel(x) for x in y), []))
    assert bytes(got["p420"].rgb) == bytes(got["p422"].rgb) == bytes(got["p444"].rgb) == expected and got["p420"].matrix == "BT.601"
    assert bytes(got["rgb"].rgb) == b"abcdef" and bytes(got["bgr"].rgb) == b"cbafed" and bytes(got["gray"].rgb) == b"aaazzz"
    assert [got[k].error for k in ("none", "cut", "odd", "null")] == ["empty frame", "plane size mismatch", "unsupported format", "plane size mismatch"]
    at = lambda x, y: images.pixel_at(F.lit(bytearray(b"abcdef")), F.lit(1), F.lit(2), F.lit(x), F.lit(y))
    row = spark.range(1).select(at(0, 1).alias("a"), at(1, 0).alias("b"), images.pixel_at(F.lit(bytearray(b"abc")), F.lit(1), F.lit(2), F.lit(0), F.lit(0)).alias("c")).first()
    assert tuple(row.a) == (100, 101, 102) and row.b is None and row.c is None


def test_whole_files_are_compared(spark):
    from reelscope.operators import compare

    def side(width, title, scenes, lufs, method="ITU-R BS.1770-4"):
        return {
            "streams": spark.createDataFrame([("p", 0, "video", "avc1", width), ("p", 1, "audio", "mp4a", None)], "pair string, stream_index int, kind string, codec string, width int"),
            "metadata": spark.createDataFrame([("p", "title", title, 0)], "pair string, key string, value string, idx int"), "scenes": spark.createDataFrame([("p", scenes)], "pair string, n long"),
            "measurements": spark.createDataFrame([("p", lufs, method)], "pair string, value double, method string"),
        }

    def told(a, b):
        out = compare.compare_files(a, b, ["pair"])
        rows = {(r.axis, r.field): r.verdict for r in out.collect()}
        return rows, {r.axis for r in compare.unstable_axes(out, ["pair"]).collect()}, compare.overall(out, ["pair"]).first().outcome

    rows, axes, outcome = told(side(640, "a", 3, -23.0), side(640, "a", 4, -23.4))
    assert axes == set() and outcome == "INCOMPLETE" and rows["scene_structure", "scene_changes"] == rows["loudness", "integrated_loudness"] == rows["stream_layout", "stream_layout"] == "equal"
    rows, axes, outcome = told(side(640, "a", 3, -23.0), side(320, "b", 5, -23.0, "EBU R128 LRA"))
    assert axes == {"video_format", "metadata", "scene_structure"} and outcome == "DIFFERENT" and rows["loudness", "integrated_loudness"] == "not_comparable"
    with pytest.raises(ValueError):
        compare.compare_files({}, side(1, "a", 1, 0.0), ["pair"])


def test_reads_of_the_case_store(spark, tmp_path):
    s = store.CaseStore(spark, str(tmp_path / "case"))
    s.insert("cases", spark.createDataFrame([("c1", "one", None)], store.TABLES["cases"]))
    s.insert("assets", spark.createDataFrame([("a", "c1", "p", 1, "x", None), ("b", "c1", "q", 1, "y", None)], store.TABLES["assets"]))
    s.insert("analyses", spark.createDataFrame([("n1", "c1", "a", "done", 5, "p", "f", 6), ("n2", "c1", "a", "done", 9, "p", "f", 6)], store.TABLES["analyses"]))
    s.insert("findings", spark.createDataFrame([("n1", "f1", "R", "WARNING", "s", "{}"), ("n2", "f2", "R", "WARNING", "s", "{}"), ("n2", "f3", "R", "CRITICAL", "s", "{}")], store.TABLES["findings"]))
    s.insert("timeline_entries", spark.createDataFrame([("n2", 1, "t1", None, "finding", "{}"), ("n2", 0, "t2", 5, "finding", "{}"), ("n1", 0, "t3", 5, "finding", "{}")], store.TABLES["timeline_entries"]))
    s.note("c1", "on the case")
    s.note("c1", "on f2", "finding", "f2")
    s.review("f2", "CONFIRMED", "first", 1)
    s.review("f2", "DISMISSED", "second", 2)
    assert [r.note for r in s.reviews_of("f2").collect()] == ["first", "second"] and [r.text for r in s.notes_of("c1").collect()] == ["on the case", "on f2"]
    assert [r.text for r in s.notes_of(subject_kind="finding", subject_id="f2").collect()] == ["on f2"]
    report_ = s.load_report("c1")
    assert [r.id for r in report_["findings"].collect()] == ["f3", "f2"] and [r.id for r in report_["timeline"].collect()] == ["t2", "t1"]
    assert [r.id for r in report_["analyses"].collect()] == ["n2"] and [r.id for r in report_["assets"].collect()] == ["a", "b"]
    hits = spark.createDataFrame([("finding", str(i), "t", 0) for i in range(5)], "arm string, id string, title string, rank int")
    assert [store.truncated(hits, n)[1] for n in (4, 5, 6)] == [True, False, False] and store.truncated(hits, 2)[0].count() == 2
    payload = store.to_payload(spark.createDataFrame([(1, 2, "x")], "id long, n long, t string"), ["id"])
    assert tuple(store.from_payload(payload, "n long, t string").first()) == (1, 2, "x")
    cache = store.Cache(spark, str(tmp_path / "cache"))
    assert cache.get("1", "sha", "p", ["b", "a"]) is None
    cache.put("1", "sha", "p", ["b", "a"], {"x": 1})
    cache.put("1", "sha", "p", ["a", "b"], {"x": 2})
    assert cache.get("1", "sha", "p", ["b", "a"]) == {"x": 2} and cache.get("2", "sha", "p", ["a", "b"]) is None
    entry = next((tmp_path / "cache").glob("*.json"))
    entry.write_text("{half")
    (entry.parent / f".{entry.name}.crc").unlink(missing_ok=True)
    assert cache.get("1", "sha", "p", ["a", "b"]) is None and not entry.exists()
    (tmp_path / "m.json").write_text('{"id": "c1", "name": "one", "schema_version": 6, "assets": [{"id": "a", "size": 3}]}')
    assert store.load_manifests(spark, str(tmp_path / "m.json")).first().assets[0].size == 3


def test_evidence_is_told_apart_by_folder(spark, tmp_path):
    import hashlib

    rows = [("one/frame.png", bytearray(b"first")), ("two/frame.png", bytearray(b"second")), ("../up.png", bytearray(b"third"))]
    kept = report.store_evidence(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path)).collect()
    assert {(r.name, r.verified) for r in kept} == {("one/frame.png", True), ("two/frame.png", True), ("up.png", True)}
    (tmp_path / "up.png").write_bytes(b"thirst")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    recorded = [("one/frame.png", 5, sha(b"first")), ("two/frame.png", 6, sha(b"first")), ("up.png", 6, sha(b"third")), ("gone.png", 1, sha(b"")), ("one/frame.png", 9, sha(b"first"))]
    got = report.verify_evidence(spark.createDataFrame(recorded, "name string, size long, sha256 string"), str(tmp_path)).collect()
    assert {(r.name, r.size, r.verified) for r in got} == {("one/frame.png", 5, True), ("two/frame.png", 6, False), ("up.png", 6, False), ("gone.png", 1, False), ("one/frame.png", 9, False)}
    assert [tuple(r) for r in report.note_rows(spark.createDataFrame([(None, None, "a\nb"), ("finding", "f", "c")], "subject_kind string, subject_id string, text string")).collect()] == [("", "", "a\nb"), ("finding", "f", "c")]


def test_a_stream_of_packets_resyncs_over_batches(spark, tmp_path):
    from reelscope.streaming import intake

    seen = [(1, i, i % 4 == 0, i not in (2, 8)) for i in range(12)] + [(2, i, i == 0, i != 3) for i in range(6)]
    schema = "k long, idx long, is_key boolean, ok boolean"
    progress = intake.Progress()
    spark.streams.addListener(progress)
    q = intake.resync_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k") if (tmp_path / "in").mkdir() is None else None
    q = q.writeStream.format("memory").queryName("resynced").outputMode("append").start()
    for part in (seen[:6] + seen[12:15], seen[6:12] + seen[15:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    spark.streams.removeListener(progress)
    got = {(r.k, r.idx): r.state for r in spark.table("resynced").collect()}
    expected = {(r.k, r.idx): r.state for r in video.resync(spark.createDataFrame(seen, schema), ["k"]).collect()}
    assert got == expected and "lost" in got.values()
    with intake.cancellable(spark, "probe") as cancel:
        cancel()
        assert spark.range(3).count() == 3


def test_a_step_of_a_second_lands_on_the_first_frame_ahead_and_the_last_behind(spark):
    """Three frames share each time; which of them counts does not hang on the order of rows."""
    rows = [(0, i, i // 3 * 400_000, i % 7 == 0) for i in range(60)]
    got = views.navigation(spark.createDataFrame(random.Random(8).sample(rows, len(rows)), "stream long, idx long, pts_us long, is_key boolean"), S, 1_000_000).collect()
    for r in got:
        assert r.second_forward == min((i for _, i, at, _ in rows if at >= r.pts_us + 1_000_000), default=None)
        assert r.second_back == max((i for _, i, at, _ in rows if at <= r.pts_us - 1_000_000), default=None)
