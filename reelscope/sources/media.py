"""Media files as tables: a reader of ISO-BMFF (MP4), Matroska and WAV structure, one row of nested arrays for each file.

Parsing bytes is not relational, so it runs in ``mapInPandas`` over the listed files; a file that cannot be read gives a
row with ``anomalies``, never a failed task. Only the pages that a reader looks at are fetched, so a file may be of any
size. What follows (times, key frames, damage, packets) is relational again.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelscope.sources.ranged import FileBytes
from reelscope.sources.ranged import at as at_

#: Most samples of a track whose tables are expanded; a parameter of ``inspect``.
MAX_SAMPLES = 8_000_000
#: Samples that one task reads at once, and audio frames in a packet of a WAV file.
PART, WAV_PACKET = 4096, 48_000
#: Codes of a colour box by name, and those that mean high dynamic range. Fixed values; several codes share a transfer name.
PRIMARIES = {1: "BT.709", 4: "BT.470M", 5: "BT.470BG", 6: "SMPTE 170M", 7: "SMPTE 240M", 8: "film (generic)", 9: "BT.2020", 10: "SMPTE ST 428", 11: "SMPTE ST 431 (DCI P3)", 12: "SMPTE ST 432 (DCI P3 D65)", 22: "EBU Tech. 3213"}
TRANSFERS = {1: "BT.709", 4: "BT.470M (gamma 2.2)", 5: "BT.470BG (gamma 2.8)", 6: "SMPTE 170M", 7: "SMPTE 240M", 8: "linear", 9: "logarithmic (100:1 range)", 10: "BT.2020 10-bit", 11: "BT.2020 12-bit", 12: "PQ (SMPTE ST 2084)", 13: "SMPTE ST 428", 14: "HLG (ARIB STD-B67)", 15: "PQ (SMPTE ST 2084)", 16: "PQ (SMPTE ST 2084)", 17: "reserved", 18: "HLG (ARIB STD-B67)"}
HDR_PRIMARIES, HDR_TRANSFERS = {9}, {12, 14, 15, 16, 18}
TRACK = "struct<primaries: string, transfer: string, is_hdr: boolean, hdr_metadata: string, stream_index: int, track_id: bigint, kind: string, codec: string, timescale: bigint, declared_duration: bigint, edit_offset: bigint, width: int, height: int, channels: int, sample_rate: bigint, bit_depth: int, stts: array<struct<n: bigint, delta: bigint>>, ctts: array<struct<n: bigint, delta: bigint>>, stss: array<bigint>, sizes: array<bigint>, offsets: array<bigint>>"
INSPECTION = f"path string, format string, next_track_id bigint, tracks array<{TRACK}>, metadata array<struct<scope: string, track_index: int, key: string, value: string>>, damage array<struct<kind: string, offset: bigint, detail: string>>, anomalies array<string>"


def boxes(data, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of body, end) of each box in a range; stops where the structure breaks."""
    at = start
    while at + 8 <= end:
        size, kind = at_(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            size = at_(">Q", data, at + 8)[0]
            head = 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def find(data, start: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """Range of the first box along a path."""
    for kind, a, b in boxes(data, start, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else find(data, a, b, *path[1:])
    return None


def scan_damage(data) -> list[dict]:
    """Top-level walk: impossible sizes, types that are not printable, a box cut off by the end, bytes that follow. Stops at ``mdat``."""
    out, at = [], 0
    while at < len(data):
        if at + 8 > len(data):
            out.append({"kind": "trailing", "offset": at, "detail": f"{len(data) - at} bytes"})
            break
        size, kind = at_(">I4s", data, at)
        if not all(32 <= c < 127 for c in kind):
            out.append({"kind": "nonprintable_type", "offset": at, "detail": "".join(chr(c) if 32 <= c < 127 else f"\\x{c:02x}" for c in kind)})
            break
        if 2 <= size <= 7:
            out.append({"kind": "impossible_size", "offset": at, "detail": str(size)})
            break
        if size == 1:
            if at + 16 > len(data):
                out.append({"kind": "truncated", "offset": at, "detail": "length field"})
                break
            size = at_(">Q", data, at + 8)[0]
            if size < 16:
                out.append({"kind": "impossible_size", "offset": at, "detail": str(size)})
                break
        if size == 0:
            break
        if at + size > len(data):
            out.append({"kind": "truncated", "offset": at, "detail": f"{at + size - len(data)} bytes missing from {kind.decode()}"})
            break
        if kind == b"mdat":
            break
        at += size
    return out


def _full(data, span: tuple[int, int] | None, entry: str, count_at: int = 4, most: int = MAX_SAMPLES) -> list[tuple]:
    """Entries of a full box with a 32-bit count; what lies beyond the box is left out."""
    if span is None or span[1] - span[0] < count_at + 4:
        return []
    n = at_(">I", data, span[0] + count_at)[0]
    size = struct.calcsize(">" + entry)
    n = min(n, (span[1] - span[0] - count_at - 4) // size, most)
    first = span[0] + count_at + 4
    return list(struct.iter_unpack(">" + entry, data[first : first + n * size]))


def _offsets(sizes: list[int], chunks: list[int], runs: list[tuple]) -> list[int]:
    """Where each sample begins: chunks hold the samples that the runs (first chunk, samples, description) deal them."""
    out: list[int] = []
    for i, (first, each, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)
        for c in range(max(first, 1) - 1, min(last, len(chunks))):
            place = chunks[c]
            for _ in range(each):
                if len(out) == len(sizes):
                    return out
                out.append(place)
                place += sizes[len(out) - 1]
    return out


def _track(data, a: int, b: int, index: int, most: int) -> dict:
    out = dict.fromkeys(("kind", "codec", "declared_duration", "edit_offset", "width", "height", "channels", "sample_rate", "bit_depth"))
    out |= {"primaries": None, "transfer": None, "is_hdr": False, "hdr_metadata": None}
    out |= {"stream_index": index, "track_id": 0, "timescale": 0, "stts": [], "ctts": [], "stss": None, "sizes": [], "offsets": []}
    if t := find(data, a, b, b"tkhd"):
        wide = data[t[0]] == 1
        out["track_id"] = at_(">I", data, t[0] + (20 if wide else 12))[0]
    if m := find(data, a, b, b"mdia", b"mdhd"):
        if data[m[0]] == 1:
            out["timescale"], out["declared_duration"] = at_(">IQ", data, m[0] + 20)
        else:
            out["timescale"], out["declared_duration"] = at_(">II", data, m[0] + 12)
    if h := find(data, a, b, b"mdia", b"hdlr"):
        kind = data[h[0] + 8 : h[0] + 12]
        out["kind"] = {b"vide": "video", b"soun": "audio"}.get(kind, "other")
    if e := find(data, a, b, b"edts", b"elst"):
        wide = data[e[0]] == 1
        rows = _full(data, e, "Qqhh" if wide else "Iihh")
        out["edit_offset"] = rows[0][0] if rows else None
    base = (b"mdia", b"minf", b"stbl")
    if s := find(data, a, b, *base, b"stsd"):
        if s[1] - s[0] >= 16:
            out["codec"] = data[s[0] + 12 : s[0] + 16].decode("latin-1")
        body = s[0] + 16
        if out["kind"] == "video" and s[1] - body >= 28:
            out["width"], out["height"] = at_(">HH", data, body + 24)
            out |= _colour(data, body + 78, s[1])  # boxes follow the fixed part of the entry
        if out["kind"] == "audio" and s[1] - body >= 28:
            out["channels"], out["bit_depth"] = at_(">HH", data, body + 16)
            out["sample_rate"] = at_(">I", data, body + 24)[0] >> 16
    out["stts"] = [{"n": n, "delta": d} for n, d in _full(data, find(data, a, b, *base, b"stts"), "II", most=most)]
    out["ctts"] = [{"n": n, "delta": d} for n, d in _full(data, find(data, a, b, *base, b"ctts"), "Ii", most=most)]
    if (k := find(data, a, b, *base, b"stss")) is not None:
        out["stss"] = [n - 1 for (n,) in _full(data, k, "I", most=most) if n]
    if z := find(data, a, b, *base, b"stsz"):
        fixed, n = at_(">II", data, z[0] + 4)
        out["sizes"] = [fixed] * min(n, most) if fixed else [x for (x,) in _full(data, z, "I", 8, most)]
    chunks = _full(data, find(data, a, b, *base, b"stco"), "I", most=most) or _full(data, find(data, a, b, *base, b"co64"), "Q", most=most)
    out["offsets"] = _offsets(out["sizes"], [x for (x,) in chunks], _full(data, find(data, a, b, *base, b"stsc"), "III", most=most))
    return out


def _colour(data, a: int, b: int) -> dict:
    """Names of the colour box, whether they mean high dynamic range, and its mastering metadata as text."""
    out: dict = {}
    if (c := find(data, a, b, b"colr")) and data[c[0] : c[0] + 4] in (b"nclx", b"nclc") and c[1] - c[0] >= 8:
        primaries, transfer = at_(">HH", data, c[0] + 4)
        out = {"primaries": PRIMARIES.get(primaries, "unspecified"), "transfer": TRANSFERS.get(transfer, "unspecified"), "is_hdr": primaries in HDR_PRIMARIES or transfer in HDR_TRANSFERS}
    found = [f"{kind.decode()} {e - s} bytes" for kind, s, e in boxes(data, a, b) if kind in (b"mdcv", b"clli")]
    return out | ({"hdr_metadata": ", ".join(found)} if found else {})


_ATOMS = {b"\xa9nam": "©nam", b"\xa9too": "©too", b"\xa9cmt": "©cmt"}


def _atoms(data, a: int, b: int, scope: str, index: int | None) -> list[dict]:
    span = find(data, a, b, b"udta")
    out = []
    for kind, s, e in boxes(data, *span) if span else ():
        if kind in _ATOMS and e - s >= 4:
            n = at_(">H", data, s)[0]
            out.append({"scope": scope, "track_index": index, "key": _ATOMS[kind], "value": data[s + 4 : min(e, s + 4 + n)].decode("utf-8", "replace")})
    return out


def inspect_mp4(data, most: int = MAX_SAMPLES) -> dict:
    out = {"next_track_id": None, "tracks": [], "metadata": [], "damage": scan_damage(data), "anomalies": []}
    moov = find(data, 0, len(data), b"moov")
    if moov is None:
        out["anomalies"].append("no moov box")
        return out
    if m := find(data, *moov, b"mvhd"):
        n = at_(">I", data, m[1] - 4)[0]
        out["next_track_id"] = n or None
    out["metadata"] += _atoms(data, *moov, "container", None)
    for kind, a, b in boxes(data, *moov):
        if kind == b"trak":
            try:
                out["tracks"].append(_track(data, a, b, len(out["tracks"]), most))
            except struct.error as e:
                out["anomalies"].append(f"track {len(out['tracks'])}: {e}")
            out["metadata"] += _atoms(data, a, b, "track", len(out["tracks"]) - 1)
    return out


def varint(data, at: int, keep_mark: bool = False) -> tuple[int, int] | None:
    """(value, length) of an EBML number; with its length mark for element ids."""
    if at >= len(data) or not data[at]:
        return None
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        return None
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep_mark else value & ((1 << 7 * n) - 1)), n


def elements(data, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end) of each EBML element in a range; an unknown size reaches to the end."""
    at = start
    while at < end:
        key = varint(data, at, True)
        size = key and varint(data, at + key[1])
        if not size:
            return
        body = at + key[1] + size[1]
        last = end if size[0] == (1 << 7 * size[1]) - 1 else min(end, body + size[0])
        yield key[0], body, last
        at = last


#: EBML element ids. Fixed values of the Matroska specification.
SEGMENT, INFO, SCALE, DURATION, TRACKS, ENTRY, NUMBER, TYPE, CODEC, CLUSTER, CLOCK, SIMPLE, GROUP, BLOCK, VIDEO, WIDTH, HEIGHT = (
    0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xE0, 0xB0, 0xBA,
)


def inspect_matroska(data, most: int = MAX_SAMPLES) -> dict:
    out = {"next_track_id": None, "tracks": [], "metadata": [], "damage": [], "anomalies": []}
    segment = next(((a, b) for k, a, b in elements(data, 0, len(data)) if k == SEGMENT), None)
    if segment is None:
        out["anomalies"].append("no segment")
        return out
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    scale, duration, by_number, times, sizes, keys, places = 1_000_000, None, {}, {}, {}, {}, {}
    for kind, a, b in elements(data, *segment):
        if kind == INFO:
            for k, s, e in elements(data, a, b):
                if k == SCALE:
                    scale = number(s, e)
                elif k == DURATION and e - s in (4, 8):
                    duration = struct.unpack(">f" if e - s == 4 else ">d", data[s:e])[0]
        elif kind == TRACKS:
            for k, s, e in elements(data, a, b):
                if k == ENTRY:
                    f = {x: (p, q) for x, p, q in elements(data, s, e)}
                    index = len(out["tracks"])
                    if NUMBER in f:
                        by_number[number(*f[NUMBER])] = index
                    kind_ = {1: "video", 2: "audio"}.get(number(*f[TYPE]) if TYPE in f else 0, "other")
                    inner = {x: (p, q) for x, p, q in elements(data, *f[VIDEO])} if VIDEO in f else {}
                    wide, high = (number(*inner[x]) if x in inner else None for x in (WIDTH, HEIGHT))
                    codec = data[slice(*f[CODEC])].decode("latin-1") if CODEC in f else None
                    out["tracks"].append({"stream_index": index, "track_id": number(*f[NUMBER]) if NUMBER in f else 0, "kind": kind_, "codec": codec, "timescale": 1_000_000, "declared_duration": None, "edit_offset": None, "width": wide, "height": high, "channels": None, "sample_rate": None, "bit_depth": None, "primaries": None, "transfer": None, "is_hdr": False, "hdr_metadata": None, "stts": [], "ctts": [], "stss": [], "sizes": [], "offsets": []})
        elif kind == CLUSTER:
            clock = 0
            for k, s, e in elements(data, a, b):
                if k == CLOCK:
                    clock = number(s, e)
                blocks = [(s, e, None)] if k == SIMPLE else [(p, q, any(x == 0xFB for x, _, _ in elements(data, s, e))) for x, p, q in elements(data, s, e) if x == BLOCK] if k == GROUP else []
                for p, q, predicted in blocks:
                    track = varint(data, p)
                    if track is None or p + track[1] + 3 > q:
                        out["anomalies"].append(f"block at {p} is cut off")
                        continue
                    at = p + track[1]
                    index = by_number.get(track[0])
                    if index is None:
                        out["anomalies"].append(f"block of unknown track {track[0]}")
                        continue
                    if len(sizes.get(index, ())) >= most:
                        continue
                    places.setdefault(index, []).append(at + 3)
                    times.setdefault(index, []).append((clock + at_(">h", data, at)[0]) * scale // 1000)
                    sizes.setdefault(index, []).append(q - at - 3)
                    keys.setdefault(index, []).append(bool(data[at + 2] & 0x80) if predicted is None else not predicted)
    for t in out["tracks"]:
        i = t["stream_index"]
        ts = times.get(i, [])
        t["sizes"], t["offsets"] = sizes.get(i, []), places.get(i, [])
        t["stts"] = [{"n": 1, "delta": y - x} for x, y in zip(ts, ts[1:], strict=False)] + [{"n": 1, "delta": 0}] * bool(ts)
        t["stss"] = [n for n, key in enumerate(keys.get(i, [])) if key]
        t["declared_duration"] = None if duration is None else int(duration * scale / 1000)
        if t["kind"] == "video" and ts and not t["stss"]:
            out["anomalies"].append(f"track {i} has no key frame")
    return out


def inspect_wav(data, most: int = MAX_SAMPLES) -> dict:
    """A WAV file as one track whose packets are ``WAV_PACKET`` frames each; its codec names the number format."""
    out = {"next_track_id": None, "tracks": [], "metadata": [], "damage": [], "anomalies": []}
    place, layout, body = 12, None, None
    while place + 8 <= len(data) and body is None:
        kind, size = at_("<4sI", data, place)
        if kind == b"fmt " and size >= 16:
            layout = at_("<HHIIHH", data, place + 8)
        elif kind == b"data":
            body = place + 8, min(size, len(data) - place - 8)
            if size > body[1]:
                out["damage"].append({"kind": "truncated", "offset": place, "detail": f"{size - body[1]} bytes missing from data"})
        place += 8 + size + size % 2
    if layout is None or body is None or not layout[1] or not layout[2]:
        out["anomalies"].append("no format or no data chunk")
        return out
    form, channels, rate, _, step, bits = layout
    codec = {(1, 8): "pcm_u8", (1, 16): "pcm_s16le", (1, 24): "pcm_s24le", (1, 32): "pcm_s32le", (3, 32): "pcm_f32le"}.get((form, bits), f"wav_{form}_{bits}")
    step = step or channels * bits // 8 or 1
    n = body[1] // step
    sizes = [min(WAV_PACKET, n - first) * step for first in range(0, n, WAV_PACKET)][:most]
    out["tracks"].append({
        "stream_index": 0, "track_id": 1, "kind": "audio", "codec": codec, "timescale": rate, "declared_duration": n, "edit_offset": None, "width": None, "height": None, "channels": channels, "sample_rate": rate, "bit_depth": bits,
        "primaries": None, "transfer": None, "is_hdr": False, "hdr_metadata": None, "stts": [{"n": 1, "delta": x // step} for x in sizes], "ctts": [], "stss": None, "sizes": sizes, "offsets": [body[0] + i * WAV_PACKET * step for i in range(len(sizes))],
    })
    return out


def inspect(files: DataFrame, most_samples: int = MAX_SAMPLES) -> DataFrame:
    """Structure of each file of rows of path and length, in the schema ``INSPECTION``.

    Rows may bring ``content``; without it, a file is opened by its path and read where the reader looks.
    """
    given = "content" in files.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, path in enumerate(part["path"]):
                row = {"path": path, "format": "unknown", "next_track_id": None, "tracks": [], "metadata": [], "damage": [], "anomalies": []}
                try:
                    data = part["content"].iloc[i] if given else FileBytes(path)
                    head = data[0:12]
                    if head[4:8] == b"ftyp":
                        row |= {"format": "iso_bmff"} | inspect_mp4(data, most_samples)
                    elif head[:4] == b"\x1a\x45\xdf\xa3":
                        row |= {"format": "matroska"} | inspect_matroska(data, most_samples)
                    elif head[:4] == b"RIFF" and head[8:] == b"WAVE":
                        row |= {"format": "wav"} | inspect_wav(data, most_samples)
                    else:
                        row["anomalies"] = ["format is not known"]
                    if not given:
                        data.close()
                except Exception as e:  # bad bytes are a finding, not an error
                    row["anomalies"] = [*row["anomalies"], f"{type(e).__name__}: {e}"]
                rows.append(row)
            yield pd.DataFrame(rows)

    return files.select("path", "length", *(["content"] if given else [])).mapInPandas(run, INSPECTION)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Inspections of the media files below a folder. Files are listed by Spark and opened by the tasks, never read whole."""
    from reelscope.sources.probe import EXTENSIONS, extension

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return inspect(files.where(extension(F.col("path")).isin(*EXTENSIONS)))


#: Codecs of uncompressed media that are decoded: numpy type and divisor of audio, planar 4:2:0 video.
PCM = {"pcm_u8": ("u1", 128), "pcm_s16le": ("<i2", 1 << 15), "sowt": ("<i2", 1 << 15), "twos": (">i2", 1 << 15), "pcm_s24le": ("<i3", 1 << 23), "in24": (">i3", 1 << 23), "pcm_s32le": ("<i4", 1 << 31), "in32": (">i4", 1 << 31), "pcm_f32le": ("<f4", 1), "fl32": (">f4", 1)}
RAW_VIDEO = ("I420", "i420", "IYUV", "yv12", "V_UNCOMPRESSED")


def packets(inspections: DataFrame, data_of: tuple[str, ...] = ()) -> DataFrame:
    """asset_id, stream_index, idx, offset, size, digest (SHA-256 of the packet's bytes) and data (of the codecs in ``data_of``).

    A track is read up to the first packet that lies beyond the end of the file, and what was recovered before it is
    kept. Tables of samples are cut into parts of ``PART``, so that many tasks read a large file.
    """
    t = inspections.select("path", F.explode("tracks").alias("t")).where("size(t.offsets) > 0")
    t = t.select("path", "t.stream_index", F.col("t.codec").isin(*data_of).alias("wanted"), "t.offsets", "t.sizes", F.explode(F.expr(f"sequence(0, size(t.offsets) - 1, {PART})")).alias("first"))
    parts = t.select("path", "stream_index", "wanted", "first", F.slice("offsets", F.col("first") + 1, PART).alias("offsets"), F.slice("sizes", F.col("first") + 1, PART).alias("sizes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                data = FileBytes(r.path)
                rows = []
                for i, (place, size) in enumerate(zip(r.offsets, r.sizes, strict=False)):
                    inside = place + size <= len(data)
                    raw = data[int(place) : int(place + size)] if inside else b""
                    rows.append((r.path, r.stream_index, r.first + i, place, size, hashlib.sha256(raw).hexdigest() if inside else None, raw if inside and r.wanted else None))
                data.close()
                yield pd.DataFrame(rows, columns=["asset_id", "stream_index", "idx", "offset", "size", "digest", "data"])

    kind = "asset_id string, stream_index int, idx long, offset long, size long, digest string, data binary"
    found = parts.repartition("path", "stream_index", "first").mapInPandas(run, kind)
    lost = F.min(F.when(F.col("digest").isNull(), F.col("idx"))).over(Window.partitionBy("asset_id", "stream_index").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("lost", lost).where("lost is null").drop("lost")


def pcm_chunks(found: DataFrame, tracks: DataFrame) -> DataFrame:
    """asset_id, stream_index, sample_rate, channels, idx, first_slot, pcm: the packets of uncompressed audio as floats of -1 to 1.

    ``found`` is ``packets`` with data, ``tracks`` is ``streams``. Slots count interleaved values from the start of a stream.
    """
    keys = ["asset_id", "stream_index"]
    audio = tracks.where(F.col("codec").isin(*PCM) & (F.col("kind") == "audio")).select(*keys, "codec", "channels", "sample_rate")
    rows = found.where("data is not null").join(audio, keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = []
            for codec, raw in zip(part["codec"], part["data"], strict=True):
                form, unit = PCM[codec]
                if form[-1] == "3":  # three bytes a value
                    b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
                    low, mid, high = b.T if form[0] == "<" else b.T[::-1]
                    x = ((low << 8 | mid << 16 | high << 24) >> 8).astype(np.float32)
                else:
                    width = np.dtype(form).itemsize
                    x = np.frombuffer(raw[: len(raw) // width * width], form).astype(np.float32)
                values.append((x / unit - (1 if form == "u1" else 0)).astype(np.float32))
            yield part.drop(columns=["codec", "data"]).assign(n=[len(x) for x in values], pcm=values)

    out = rows.select(*keys, "codec", "channels", "sample_rate", "idx", "data").mapInPandas(run, "asset_id string, stream_index int, channels int, sample_rate long, idx long, n long, pcm array<float>")
    before = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).drop("n")


def raw_pictures(found: DataFrame, tracks: DataFrame) -> DataFrame:
    """asset_id, stream_index, idx, width, height, ok, luma: the packets of uncompressed planar 4:2:0 video.

    A packet that is too short for its picture is a failure to decode: ok is false and luma null.
    """
    keys = ["asset_id", "stream_index"]
    video = tracks.where(F.col("codec").isin(*RAW_VIDEO) & (F.col("kind") == "video")).select(*keys, "width", "height")
    pixels = F.col("width") * F.col("height")
    ok = (pixels > 0) & (F.octet_length("data") >= pixels + 2 * F.floor(pixels / 4))
    rows = found.where("data is not null").join(video, keys).withColumn("ok", F.coalesce(ok, F.lit(False)))
    return rows.select(*keys, "idx", "width", "height", "ok", F.when(F.col("ok"), F.substring("data", F.lit(1), pixels)).alias("luma"))


def frames(inspections: DataFrame) -> DataFrame:
    """asset_id, stream_index, kind, idx, dts_us, pts_us, is_key, size: a row for each sample, from the run-length tables.

    Decode times are running sums of the steps; presentation adds the composition offset; without a sync table every
    sample is a key frame. All tables of a track meet by (asset, stream, idx): work grows with the samples, however the
    runs fall.
    """
    from reelscope.operators.timing import expand_runs

    keys = ["asset_id", "stream_index"]
    t = inspections.select(F.col("path").alias("asset_id"), F.explode("tracks").alias("t")).where("t.timescale > 0").select("asset_id", "t.*")
    runs = lambda c: t.select(*keys, F.posexplode(c).alias("seq", "r")).select(*keys, "seq", F.col("r.n").alias("n"), F.col("r.delta").alias("delta"))
    steps = expand_runs(runs("stts"), keys, "seq", "n", "delta").withColumnRenamed("dts", "ticks")
    # A run of equal offsets is a run of its own length; its value is not summed.
    offsets = runs("ctts").withColumn("offset", F.col("delta")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    offsets = offsets.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "k")).cast("long") - 1).select(*keys, "idx", "offset")
    sizes = t.select(*keys, F.posexplode("sizes").alias("idx", "size")).withColumn("idx", F.col("idx").cast("long"))
    sync = t.select(*keys, F.explode("stss").alias("idx"), F.lit(True).alias("sync"))
    rows = steps.join(offsets, [*keys, "idx"], "left").join(sizes, [*keys, "idx"], "left").join(sync, [*keys, "idx"], "left")
    rows = rows.join(t.select(*keys, "kind", "timescale", F.col("stss").isNull().alias("every")), keys)
    us = lambda c: F.floor(c * 1_000_000 / F.col("timescale")).cast("long")
    ticks = F.col("ticks") + F.coalesce("offset", F.lit(0))
    return rows.select(*keys, "kind", "idx", us(F.col("ticks")).alias("dts_us"), us(ticks).alias("pts_us"), (F.col("every") | F.coalesce("sync", F.lit(False))).alias("is_key"), "size")


def damage(inspections: DataFrame) -> DataFrame:
    """asset_id, kind, offset, is_missing_data, detail."""
    return inspections.select(F.col("path").alias("asset_id"), F.explode("damage").alias("d")).select("asset_id", "d.kind", "d.offset", (F.col("d.kind") == "truncated").alias("is_missing_data"), "d.detail")


def streams(inspections: DataFrame) -> DataFrame:
    """asset_id, stream_index, kind, codec, duration_us (declared), measured_us, edit_us, start_us, width, height, channels, sample_rate, bit_depth, packet_count (declared samples), all_key, colour."""
    t = inspections.select(F.col("path").alias("asset_id"), F.explode("tracks").alias("t"))
    us = lambda c: F.when(F.col("t.timescale") > 0, F.floor(c * 1_000_000 / F.col("t.timescale")).cast("long"))
    total = F.aggregate("t.stts", F.lit(0).cast("long"), lambda s, r: s + r["n"] * r["delta"])
    return t.select(
        "asset_id", "t.stream_index", "t.kind", "t.codec", us(F.when(F.col("t.declared_duration") > 0, F.col("t.declared_duration"))).alias("duration_us"), us(total).alias("measured_us"), us(F.col("t.edit_offset")).alias("edit_us"), F.lit(0).cast("long").alias("start_us"),
        "t.width", "t.height", "t.channels", "t.sample_rate", "t.bit_depth", F.size("t.sizes").cast("long").alias("packet_count"), F.col("t.stss").isNull().alias("all_key"), "t.primaries", "t.transfer", "t.is_hdr", "t.hdr_metadata",
    )


def containers(inspections: DataFrame) -> DataFrame:
    n = F.size("tracks")
    return inspections.select(F.col("path").alias("asset_id"), "format", n.alias("stream_count"), n.alias("declared_track_count"), F.col("next_track_id").alias("declared_next_track_id"), "anomalies")


def analyse(inspections: DataFrame, profile=None, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """The bundle of analysis tables that the rules take, of all files at once.

    ``found`` is ``packets(inspections, (*PCM, *RAW_VIDEO))``, best as a stored table: it is read by several tables of the
    bundle. Without it packets are read once and kept on the executors' disks. Compressed audio and video are not
    decoded: those streams have no levels, pictures or decode failures, and the rules on them stay silent.
    """
    from reelscope.operators import audio, images, metadata, timing, video
    from reelscope.plans.rules import Profile

    profile = profile or Profile()
    keys = ["asset_id", "stream_index"]
    if found is None:
        found = packets(inspections, (*PCM, *RAW_VIDEO)).persist(StorageLevel.DISK_ONLY)
    tracks = streams(inspections)
    every = frames(inspections)
    timed = every.where("kind = 'video'")
    gops = video.gop_segments(timed, keys)
    tags = inspections.select(F.col("path").alias("asset_id"), F.explode("metadata").alias("m")).select("asset_id", "m.*")
    runs = video.repeated_runs(timed.join(found.select(*keys, "idx", "digest"), [*keys, "idx"]).where("size > 0"), keys)
    pcm = pcm_chunks(found, video.first_of_kind(tracks, ["asset_id"], "audio"))
    pictures = raw_pictures(found, tracks)
    hashes = images.block_hash(pictures.where("ok"), [*keys, "idx"]).where("hash is not null")
    planes = images.levels_of(pictures.where("ok").select(*keys, "idx", "luma")).drop("luma")
    return {
        "containers": containers(inspections), "streams": tracks, "damage": placed_damage(inspections, every),
        "packet_damage": video.packet_damage(found, tracks, keys), "decode_damage": pictures.where("not ok").select(*keys, "idx"),
        "timestamps": timing.anomalies(timed, keys, profile.pts_tolerance_us), "gop_changes": video.gop_changes(gops, keys, profile.gop_tolerance_frames), "gop_summary": video.gop_summary(gops, keys),
        "repeated_runs": runs.join(timed.select(*keys, F.col("idx").alias("first_idx"), F.col("pts_us").alias("start_us")), [*keys, "first_idx"]),
        "bitrate": video.sliding_bitrate(timed, keys, profile.bitrate_window_frames, profile.bitrate_anomaly_ratio), "rate_changes": timing.rate_changes(every, keys, profile.pts_tolerance_us),
        "metadata_conflicts": metadata.conflicts(tags, ["asset_id"]), "missing_creation": metadata.missing_creation(tags, ["asset_id"]),
        "sync": timing.sync_report(timed.select("asset_id", "idx", "pts_us"), every.where("kind = 'audio'").select("asset_id", "idx", "pts_us"), ["asset_id"]),
        "levels": audio.chunk_levels(pcm, ["asset_id"]), "silence": audio.silence_regions(audio.slots_of(pcm, ["asset_id"]), ["asset_id"], profile.silence_threshold, profile.min_silence_frames),
        "loudness": audio.integrated_loudness(audio.hop_loudness(audio.hops(pcm)), ["asset_id"], "block"),
        "scenes": video.scene_changes(planes, keys, 16), "near_duplicates": video.near_duplicates(hashes, keys, profile.near_duplicate_window),
    }


def placed_damage(inspections: DataFrame, every: DataFrame) -> DataFrame:
    """``damage`` with at_us: the time of the latest sample that begins at or before the damaged byte, of the stream that has it.

    Sample tables say where samples lie, so the place is exact; damage before any sample, or in a file without tables,
    has no time.
    """
    t = inspections.select(F.col("path").alias("asset_id"), F.explode("tracks").alias("t")).select("asset_id", "t.stream_index", F.posexplode("t.offsets").alias("idx", "byte_offset"))
    bad = damage(inspections)
    at = t.join(bad.select("asset_id").distinct(), "asset_id", "left_semi").withColumn("idx", F.col("idx").cast("long"))
    at = at.join(every.select("asset_id", "stream_index", "idx", "pts_us"), ["asset_id", "stream_index", "idx"]).groupBy("asset_id", "byte_offset").agg(F.min("pts_us").alias("at_us"))
    w = Window.partitionBy("asset_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    marks = at.select("asset_id", F.col("byte_offset").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(bad.select(F.struct(*bad.columns)).schema[0].dataType).alias("row"), "at_us")
    both = marks.unionByName(bad.select("asset_id", F.col("offset").alias("at"), F.lit(1).alias("side"), F.struct(*bad.columns).alias("row"), F.lit(None).cast("long").alias("at_us")))
    return both.withColumn("at_us", F.last("at_us", ignorenulls=True).over(w)).where("side = 1").select("row.*", "at_us")


def decode_wav(files: DataFrame) -> DataFrame:
    """asset_id, sample_rate, channels, pcm (interleaved, -1 to 1) and reason, from ``binaryFile`` rows of PCM WAV.

    What is no such file has a reason and nulls: not measured. One value holds a whole file; ``pcm_chunks`` does not.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["path"], part["content"], strict=True):
                row = {"asset_id": path, "sample_rate": None, "channels": None, "pcm": None, "reason": None}
                try:
                    track = inspect_wav(data)["tracks"][0]
                    form, unit = PCM[track["codec"]]
                    raw = data[track["offsets"][0] : track["offsets"][-1] + track["sizes"][-1]]
                    if form[-1] == "3":
                        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
                        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / unit
                    else:
                        x = np.frombuffer(raw, form).astype(np.float32) / unit - (1 if form == "u1" else 0)
                    row |= {"sample_rate": track["sample_rate"], "channels": track["channels"], "pcm": x.tolist()}
                except Exception as e:  # bad bytes are not measured
                    row["reason"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["asset_id", "sample_rate", "channels", "pcm", "reason"])

    return files.select("path", "content").mapInPandas(run, "asset_id string, sample_rate int, channels int, pcm array<float>, reason string")
