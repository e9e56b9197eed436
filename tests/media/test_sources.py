"""Byte fixtures through the readers, frames and rules."""

from __future__ import annotations

import hashlib
import math
import random
import struct

import pytest

from reelscope.plans import rules
from reelscope.sources import media, probe


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def rle(kind, rows, form):
    return full(kind, struct.pack(">I", len(rows)), *[struct.pack(form, *r) for r in rows])


#: Where the media data of a fixture begins.
DATA = 1 << 16


def track(handler=b"vide", timescale=25_000, stts=((100, 1000),), declared=None, sync=(1, 13, 25), ctts=None, tag=None, edit=None, colour=b"", codec=None, shape=(640, 360), sizes=None, place=0):
    n = sum(c for c, _ in stts)
    declared = sum(c * d for c, d in stts) if declared is None else declared
    entry = box(codec or b"avc1", b"\0" * 24, struct.pack(">HH", *shape), b"\0" * 50, colour) if handler == b"vide" else box(codec or b"mp4a", b"\0" * 16, struct.pack(">HHHHI", 2, 16, 0, 0, 48_000 << 16))
    sizes = sizes or [100 + i % 7 for i in range(n)]
    stbl = [full(b"stsd", struct.pack(">I", 1), entry), rle(b"stts", stts, ">II"), full(b"stsz", struct.pack(">II", 0, n), *[struct.pack(">I", x) for x in sizes])]
    stbl += [rle(b"stsc", [(1, 3, 1), (2, n, 1)], ">III"), rle(b"stco", [(DATA + place,), (DATA + place + sum(sizes[:3]),)], ">I")]
    if sync is not None:
        stbl.append(rle(b"stss", [(x,) for x in sync], ">I"))
    if ctts:
        stbl.append(rle(b"ctts", ctts, ">Ii"))
    parts = [full(b"tkhd", struct.pack(">III", 0, 0, 1), b"\0" * 60), box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, timescale, declared), b"\0" * 4), full(b"hdlr", b"\0\0\0\0", handler, b"\0" * 12), box(b"minf", box(b"stbl", *stbl)))]
    if edit is not None:
        parts.append(box(b"edts", full(b"elst", struct.pack(">I", 1), struct.pack(">Iihh", edit, 0, 1, 0))))
    if tag:
        parts.append(box(b"udta", box(b"\xa9cmt", struct.pack(">HH", len(tag), 0), tag)))
    return box(b"trak", *parts)


def mp4(*tracks, next_id=None, extra=b"", tag=None, data=None):
    mvhd = full(b"mvhd", b"\0" * 92, struct.pack(">I", len(tracks) + 1 if next_id is None else next_id))
    udta = box(b"udta", box(b"\xa9cmt", struct.pack(">HH", len(tag), 0), tag)) if tag else b""
    head = box(b"ftyp", b"isom", b"\0" * 8) + box(b"moov", mvhd, *tracks, udta) + extra
    return head + box(b"free", b"\0" * (DATA - 16 - len(head))) + box(b"mdat", random.Random(5).randbytes(1 << 15) if data is None else data)


def picture(level, noise=0):
    """A 16 x 16 picture of planar 4:2:0, half dark and half of the level."""
    return bytes([10] * 128 + [level] * (128 - noise) + [level + 1] * noise) + b"\x80" * 128


def wav(values, rate=48_000, channels=1, bits=16):
    raw = b"".join(struct.pack("<h", v) for v in values)
    step = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * step, step, bits) + b"data" + struct.pack("<I", len(raw)) + raw


def ebml(key: int, body: bytes) -> bytes:
    head = key.to_bytes((key.bit_length() + 7) // 8, "big")
    return head + struct.pack(">Q", len(body) | 1 << 56) + body


def webm(times=(0, 40, 80, 120), keys=(True, False, False, True)):
    entry = ebml(media.ENTRY, ebml(media.NUMBER, b"\x01") + ebml(media.TYPE, b"\x01") + ebml(media.CODEC, b"V_VP9"))
    blocks = b"".join(ebml(media.SIMPLE, b"\x81" + struct.pack(">hB", t, 0x80 if k else 0) + b"data") for t, k in zip(times, keys, strict=True))
    info = ebml(media.INFO, ebml(media.SCALE, (1_000_000).to_bytes(3, "big")) + ebml(media.DURATION, struct.pack(">d", 160.0)))
    return ebml(0x1A45DFA3, b"") + ebml(media.SEGMENT, info + ebml(media.TRACKS, entry) + ebml(media.CLUSTER, ebml(media.CLOCK, b"\0") + blocks))


FILES = {
    "clean.mp4": mp4(track(tag=b"shot"), track(b"soun", 48_000, ((187, 1024),), sync=None, place=12_000), extra=b""),
    "wrong.mp4": mp4(track(declared=999_000), next_id=9),
    "gap.mp4": mp4(track(stts=((30, 1000), (1, 9000), (30, 1000)))),
    "reordered.mp4": mp4(track(stts=((4, 1000),), ctts=((1, 0), (1, 2000), (1, -1000), (1, -1000)))),
    "tags.mp4": mp4(track(tag=b"one"), tag=b"two"),
    "late.mp4": mp4(track(edit=25_000)),
    "keys.mp4": mp4(track(sync=None)),
    "single.mp4": mp4(track(sync=(1,))),
    "nomoov.mp4": box(b"ftyp", b"isom", b"\0" * 8),
    "empty.mp4": mp4(),
    "cut.mp4": mp4(track())[:-400][:60] + struct.pack(">I4s", 5000, b"free"),
    "bad.mp4": box(b"ftyp", b"isom", b"\0" * 8) + struct.pack(">I4s", 5, b"free"),
    "hdr.mp4": mp4(track(colour=box(b"colr", b"nclx", struct.pack(">HHHB", 9, 16, 9, 0)))),
    "mastered.mp4": mp4(track(colour=box(b"colr", b"nclx", struct.pack(">HHHB", 9, 16, 9, 0)) + box(b"mdcv", b"\0" * 24))),
    # uncompressed pictures: two alike, a change of scene, a run of equal ones, one that is cut short
    "raw.mp4": mp4(track(stts=((8, 1000),), codec=b"I420", shape=(16, 16), sync=(1, 5), sizes=[384] * 7 + [100]), data=b"".join([picture(90), picture(90, 40), picture(250), *[picture(60)] * 2, picture(30), picture(200), b"\0" * 100])),
    "short.mp4": mp4(track(), data=b"y" * 1000),
    "drift.mp4": mp4(track(stts=((100, 1000),)), track(b"soun", 48_000, ((101, 1925),), sync=None)),
    "rates.mp4": mp4(track(stts=((60, 1000), (10, 2000)))),
    "drop.mp4": mp4(track(sizes=[200] * 50 + [4] * 20 + [200] * 30)),
    "gops.mp4": mp4(track(sync=(1, 13, 25, 60, 72))),
    "unknown.mp4": mp4(track(declared=0)),
    "loud.wav": wav([32767 if i % 100 < 50 else -32767 for i in range(48_000)]),
    "bias.wav": wav([3000] * 48_000),
    "tone.wav": wav([int(8000 * math.sin(2 * math.pi * 440 * i / 48_000)) for i in range(96_000)]),
    "quiet.wav": wav([0] * 48_000),
    "gap.wav": wav([int(8000 * math.sin(2 * math.pi * 440 * i / 48_000)) if not 24_000 <= i < 30_000 else 0 for i in range(72_000)]),
    "clip.webm": webm(),
    "nokey.webm": webm(keys=(False,) * 4),
    "back.webm": webm(times=(0, 80, 40, 120)),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("intake")
    for name, data in FILES.items():
        (folder / name).write_bytes(data)
    (folder / "cache").mkdir()
    (folder / "cache" / "old.mp4").write_bytes(FILES["clean.mp4"])
    (folder / "notes.txt").write_text("no media")
    out = media.read_media(spark, str(folder)).where("path not like '%/cache/%'").cache()
    return str(folder), out


def named(df):
    return df.withColumn("asset_id", media.F.element_at(media.F.split("asset_id", "/"), -1))


@pytest.fixture(scope="module")
def findings(found):
    got: dict[str, set[str]] = {}
    for r in named(rules.evaluate(media.analyse(found[1]))).collect():
        got.setdefault(r.rule_id, set()).add(r.asset_id)
    return got


def test_scan_and_acquire(spark, found):
    rows = probe.scan(spark, found[0]).collect()
    assert len(rows) == len(FILES) and {r["format"] for r in rows} == {"iso_bmff", "matroska", "wav"}
    assert [r.path for r in rows] == sorted(r.path for r in rows)
    got = {r.path.rsplit("/", 1)[1]: r for r in probe.acquire(spark, found[0]).collect()}
    assert set(got) == set(FILES) and all(r.complete and r.blake3 is None and r.sha256 == hashlib.sha256(FILES[n]).hexdigest() and r.size == len(FILES[n]) for n, r in got.items())


def test_streams(found):
    rows = {(r.asset_id, r.stream_index): r for r in named(media.streams(found[1])).collect()}
    v, a = rows["clean.mp4", 0], rows["clean.mp4", 1]
    assert (v.kind, v.codec, v.width, v.height, v.duration_us, v.measured_us) == ("video", "avc1", 640, 360, 4_000_000, 4_000_000)
    assert (a.kind, a.codec, a.channels, a.sample_rate, a.all_key) == ("audio", "mp4a", 2, 48_000, True)
    assert rows["late.mp4", 0].edit_us == 1_000_000 and rows["clip.webm", 0].codec == "V_VP9" and rows["clip.webm", 0].duration_us == 160_000


def test_frames(found):
    rows = sorted((r for r in named(media.frames(found[1])).where("asset_id in ('reordered.mp4', 'clip.webm')").collect()), key=lambda r: (r.asset_id, r.idx))
    assert [r.pts_us for r in rows if r.asset_id == "reordered.mp4"] == [0, 120_000, 40_000, 80_000]
    assert [r.dts_us for r in rows if r.asset_id == "clip.webm"] == [0, 40_000, 80_000, 120_000]
    assert [r.is_key for r in rows if r.asset_id == "clip.webm"] == [True, False, False, True]
    n = {r.asset_id: r["count"] for r in named(media.frames(found[1])).where("kind = 'video'").groupBy("asset_id").count().collect()}
    assert n["clean.mp4"] == 100 and n["gap.mp4"] == 61


def test_rules_fire_on_their_fixtures_only(findings):
    got = findings
    assert "wrong.mp4" in got["METADATA.DECLARED_VS_MEASURED_MISMATCH"] and "clean.mp4" not in got["METADATA.DECLARED_VS_MEASURED_MISMATCH"]
    assert got["CONTAINER.DECLARED_TRACK_MISMATCH"] == {"wrong.mp4"}
    assert "gap.mp4" in got["TIMING.TIMESTAMP_GAP"] and "clean.mp4" not in got["TIMING.TIMESTAMP_GAP"]
    assert got["TIMING.NON_MONOTONIC_PTS"] == {"reordered.mp4", "back.webm"}
    assert got["METADATA.TIMESTAMP_CONFLICT"] == {"tags.mp4"}
    assert got["VIDEO.HDR_METADATA_MISSING"] == {"hdr.mp4"}
    assert got["CONTAINER.STREAM_START_OFFSET"] == {"late.mp4"}
    assert got["VIDEO.ALL_FRAMES_KEYFRAMES"] == {"keys.mp4"}
    assert "single.mp4" in got["VIDEO.SINGLE_KEYFRAME"] and "clean.mp4" not in got["VIDEO.SINGLE_KEYFRAME"]
    assert {"nomoov.mp4", "empty.mp4"} <= got["CONTAINER.NO_USABLE_STREAMS"]
    assert got["CONTAINER.TRUNCATED_MEDIA"] >= {"cut.mp4"} and got["CONTAINER.STRUCTURAL_DEFECT"] == {"bad.mp4"}
    assert "nokey.webm" in got["CONTAINER.PARSE_ANOMALY"]


def test_every_rule_fires_from_files(findings):
    got = findings
    assert got["VIDEO.DECODE_FAILURE"] == {"raw.mp4"} and got["VIDEO.SCENE_CHANGE"] == {"raw.mp4"} and got["VIDEO.NEAR_DUPLICATE_FRAME"] == {"raw.mp4"}
    assert got["VIDEO.DUPLICATE_FRAME_RUN"] >= {"raw.mp4"} and "clean.mp4" not in got["VIDEO.DUPLICATE_FRAME_RUN"]
    assert got["CONTAINER.UNREADABLE_PACKET"] >= {"short.mp4"} and "clean.mp4" not in got["CONTAINER.UNREADABLE_PACKET"]
    assert got["AUDIO.CLIPPING"] == {"loud.wav"} and got["AUDIO.DC_OFFSET"] == {"bias.wav"}
    assert got["AUDIO.SILENCE_REGION"] == {"gap.wav", "quiet.wav"} and got["AUDIO.INAUDIBLE"] == {"quiet.wav"}
    assert got["TIMING.AV_SYNC_DRIFT"] >= {"drift.mp4"} and "clean.mp4" not in got["TIMING.AV_SYNC_DRIFT"]
    assert got["VIDEO.FRAME_RATE_CHANGE"] >= {"rates.mp4"} and got["VIDEO.BITRATE_DROP"] >= {"drop.mp4"}
    assert got["VIDEO.GOP_LENGTH_CHANGE"] >= {"gops.mp4"} and got["CONTAINER.STREAM_DURATION_MISSING"] >= {"unknown.mp4"}
    assert got["METADATA.MISSING_CREATION_TIME"] >= {"tags.mp4"} and got["CONTAINER.MALFORMED_STRUCTURE"] >= {"nomoov.mp4"}
    assert set(got) == {r.id for r in rules.RULES}
    assert not [rule for rule, assets in got.items() if "clean.mp4" in assets and rule != "METADATA.MISSING_CREATION_TIME"]
    assert not [rule for rule, assets in got.items() if "tone.wav" in assets and rule != "VIDEO.ALL_FRAMES_KEYFRAMES"]


def test_packets_are_read_where_they_lie(found):
    rows = named(media.packets(found[1], ("I420",))).where("asset_id in ('raw.mp4', 'short.mp4', 'clip.webm', 'tone.wav')").collect()
    by = {(r.asset_id, r.idx): r for r in rows}
    whole = FILES["raw.mp4"]
    for i in range(8):
        r = by["raw.mp4", i]
        raw = whole[r.offset : r.offset + r.size]
        assert raw == (picture(90), picture(90, 40), picture(250), picture(60), picture(60), picture(30), picture(200), b"\0" * 100)[i] and r.digest == hashlib.sha256(raw).hexdigest() and r.data == raw
    assert [i for n, i in by if n == "short.mp4"] == list(range(9))  # 1,000 bytes hold nine samples and a part of the tenth
    assert by["clip.webm", 0].digest == hashlib.sha256(b"data").hexdigest() and by["clip.webm", 0].data is None
    assert sum(r.size for n, r in ((n, r) for (n, _), r in by.items()) if n == "tone.wav") == 192_000


def test_damage_has_the_time_of_the_sample_it_hits(spark, tmp_path):
    cut = mp4(track(stts=((50, 1000),)), data=b"z" * 5000) + struct.pack(">I4s", 9000, b"free")
    broken = bytearray(cut)
    (tmp_path / "late.mp4").write_bytes(bytes(broken))
    seen = media.inspect(spark.createDataFrame([("p", len(cut))], "path string, length long").select(media.F.lit(f"{tmp_path}/late.mp4").alias("path"), "length"))
    moved = seen.withColumn("damage", media.F.expr(f"array(named_struct('kind', 'truncated', 'offset', {DATA}L + 250, 'detail', ''), named_struct('kind', 'truncated', 'offset', 3L, 'detail', ''))"))
    got = {r.offset: r.at_us for r in media.placed_damage(moved, media.frames(moved)).collect()}
    assert got == {DATA + 250: 80_000, 3: None}


def test_files_beyond_two_gigabytes(spark, tmp_path):
    whole = mp4(track(tag=b"far"))
    path = tmp_path / "big.mp4"
    with open(path, "wb") as f:
        f.write(whole)
        f.write(struct.pack(">I4sQ", 1, b"free", (3 << 30)))
        f.truncate(len(whole) + (3 << 30))
    row = media.read_media(spark, str(tmp_path)).first()
    assert row.format == "iso_bmff" and len(row.tracks) == 1 and not row.anomalies
    assert [(r.format, r.size) for r in probe.scan(spark, str(tmp_path)).collect()] == [("iso_bmff", len(whole) + (3 << 30))]
    assert probe.acquire(spark, str(tmp_path)).first().complete


def test_arbitrary_bytes_never_fail(spark):
    rng = random.Random(1)
    whole = FILES["clean.mp4"]
    rows = [(f"{i}", len(d), d) for i, d in enumerate([b"", b"\0" * 9, *[whole[: rng.randrange(len(whole))] for _ in range(40)], *[webm()[: rng.randrange(60)] for _ in range(10)], *[bytes(rng.randrange(256) for _ in range(80)) for _ in range(30)]])]
    for k in range(60):
        d = bytearray(whole)
        for _ in range(8):
            d[rng.randrange(len(d))] = rng.randrange(256)
        rows.append((f"m{k}", len(d), bytes(d)))
    out = media.inspect(spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "path string, length long, content binary")).collect()
    assert len(out) == len(rows)
    for r in out:
        size = next(b for a, b, _ in rows if a == r.path)
        assert all(0 <= d.offset <= size for d in r.damage)


def test_wav(spark):
    import io
    import wave

    def sound(width: int) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((2, width, 48_000, 2, "NONE", ""))
            half = (1 << 8 * width - 2) if width > 1 else 192
            w.writeframes(half.to_bytes(width, "little") * 4)
        return out.getvalue()

    rows = [(str(w), bytearray(sound(w))) for w in (1, 2, 3, 4)] + [("bad", bytearray(b"RIFF"))]
    got = {r.asset_id: r for r in media.decode_wav(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert all(got[str(w)].pcm == pytest.approx([0.5] * 4) and got[str(w)].channels == 2 for w in (1, 2, 3, 4))
    assert got["bad"].pcm is None and got["bad"].reason
