"""Column functions over media times, rational rates, hashes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)
#: Severities, most severe first. Fixed order.
SEVERITIES = ("CRITICAL", "SIGNIFICANT", "WARNING", "INFORMATIONAL")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def ticks_to_micros(ticks: Column, per_second: Column) -> Column:
    """Ticks of a timebase as microseconds: exact, truncating towards zero, saturating at the 64-bit bounds."""
    wide = ticks.cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    sign = F.when(wide < 0, -1).otherwise(1)
    whole = F.floor(F.abs(wide.cast("decimal(38,0)")) / per_second.cast("decimal(20,0)")) * sign
    whole = whole.cast("decimal(38,0)")
    return F.when(whole > LONG_MAX, F.lit(LONG_MAX)).when(whole < LONG_MIN, F.lit(LONG_MIN)).otherwise(whole.cast("long"))


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b), F.when(a.isNull() | b.isNull(), F.lit(None).cast("long")).when(b < 0, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN)))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.when(a.isNull() | b.isNull(), F.lit(None).cast("long")).when(b > 0, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN)))


def timecode(us: Column) -> Column:
    """[-]HH:MM:SS.mmm of media-relative microseconds, truncated to milliseconds; hours may exceed 24."""
    ms = F.floor(F.abs(us) / 1000).cast("long")
    part = lambda size, of: F.pmod(F.floor(ms / size).cast("long"), F.lit(of))
    text = F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1_000, 60), F.pmod(ms, F.lit(1000)))
    return F.when(us.isNotNull(), F.concat(F.when(us < 0, F.lit("-")).otherwise(F.lit("")), text))


def trim_float(x: Column) -> Column:
    """Up to three decimals, without trailing zeros; whole numbers bare."""
    return F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")


def slug(name: Column, version: Column) -> Column:
    """Lower case, one hyphen for each other character, then the version: ``default-forensic v1``."""
    return F.concat(F.regexp_replace(F.lower(name), "[^a-z0-9]", "-"), F.lit(" v"), version.cast("string"))


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def dbfs(amplitude: Column) -> Column:
    return F.when(amplitude > 0, 20 * F.log10(amplitude))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def same_rational(an: Column, ad: Column, bn: Column, bd: Column) -> Column:
    """Equality of two fractions by cross-multiplication, exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return wide(an) * wide(bd) == wide(bn) * wide(ad)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over parts joined by the unit separator; null parts count as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def contains_ascii(text: Column, term: str | None) -> Column:
    """Whether a text contains a term, letters A-Z without case. No term matches all, a blank one nothing."""
    if term is None:
        return F.lit(True)
    if not term.strip():
        return F.lit(False)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.contains(F.translate(text, upper, lower), F.lit(term.translate(str.maketrans(upper, lower)))), F.lit(False))


#: Names of a codec, by family. Fixed values.
CODEC_FAMILIES = {
    "h264": ["h264", "avc", "avc1", "avc3", "x264"],
    "h265": ["h265", "hevc", "hvc1", "hev1"],
    "av1": ["av1", "av01"],
    "vp9": ["vp9", "vp09"],
    "mpeg2video": ["mpeg2video", "mpeg-2", "mpv2"],
    "prores": ["prores", "apch", "apcn", "apcs", "apco", "ap4h", "ap4x"],
    "dnxhd": ["dnxhd", "avdn"],
    "aac": ["aac", "mp4a", "aacp"],
    "pcm": ["pcm", "sowt", "twos", "lpcm", "in24", "in32", "fl32", "fl64", "ulaw"],
    "opus": ["opus"],
    "vorbis": ["vorbis"],
    "flac": ["flac"],
    "mp3": ["mp3", ".mp3"],
    "alac": ["alac"],
}


def codec_family(name: Column) -> Column:
    """Family of a codec name, null if unknown."""
    out = F.lit(None).cast("string")
    low = F.lower(F.trim(name))
    for family, names in CODEC_FAMILIES.items():
        out = F.when(low.isin(names), family).otherwise(out)
    return out


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.601 integer luma."""
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def _channel(x: Column) -> Column:
    return F.greatest(F.least(F.shiftright(x, 8), F.lit(255)), F.lit(0))


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    """Studio-swing BT.601 to 8-bit RGB in 8.8 fixed point, clamped."""
    base, u, v = 298 * (y - 16) + 128, u - 128, v - 128
    return F.struct(_channel(base + 409 * v).alias("r"), _channel(base - 100 * u - 208 * v).alias("g"), _channel(base + 516 * u).alias("b"))


def safe_path(path: Column, most: int = 64) -> Column:
    """A relative path that stays inside a folder: other characters become ``_``, runs of dots one, and those at the ends of a part go; at most ``most`` characters for a part."""
    part = lambda p: F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "[^A-Za-z0-9._-]", "_"), r"\.+", "."), r"^\.|\.$", ""), 1, most)
    joined = F.array_join(F.filter(F.transform(F.split(path, r"[/\\\\]"), part), lambda p: p != ""), "/")
    return F.when(joined == "", "artifact").otherwise(joined)


def escape_type(kind: Column) -> Column:
    """A four-byte box type as text, bytes that are not printable ASCII as ``\\xNN``."""
    at = lambda i: F.hex(F.substring(kind, i, 1))
    one = lambda h: F.when(h.between("20", "7E"), F.decode(F.unhex(h), "US-ASCII")).otherwise(F.concat(F.lit("\\x"), F.lower(h)))
    return F.concat(*[one(at(i)) for i in range(1, 5)])


def measurement_text(value: Column, unit: str, citation: str) -> Column:
    """``-23.0 LUFS (citation)``: one decimal, the unit, and how it was measured."""
    return F.concat(F.format_string("%.1f", value), F.lit(f" {unit} ({citation})"))


def dimensions(text: Column) -> Column:
    """(width, height) of ``WxH``; null where either is no number."""
    wide, high = (F.regexp_extract(text, r"^(\d{1,9})[xX](\d{1,9})$", i) for i in (1, 2))
    return F.when(wide != "", F.struct(wide.cast("int").alias("width"), high.cast("int").alias("height")))


def micros_to_ticks(us: Column, per_second: Column) -> Column:
    """Microseconds as ticks of a timebase: exact, truncating towards zero, saturating at the 64-bit bounds."""
    wide = us.cast("decimal(19,0)") * per_second.cast("decimal(18,0)")
    whole = (F.floor(F.abs(wide) / F.lit(1_000_000).cast("decimal(7,0)")) * F.when(wide < 0, -1).otherwise(1)).cast("decimal(38,0)")
    return F.when(whole > LONG_MAX, F.lit(LONG_MAX)).when(whole < LONG_MIN, F.lit(LONG_MIN)).otherwise(whole.cast("long"))


def reduced(n: Column, d: Column) -> Column:
    """(num, den) of a fraction in lowest terms, den positive; null over zero. Euclid's steps are at most 92 for longs."""
    pair = F.struct(F.abs(n).cast("long").alias("a"), F.abs(d).cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["a"], s["b"])).alias("b"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step, lambda s: s["a"])
    sign = F.when(d < 0, -1).otherwise(1)
    whole = lambda x: (x.cast("decimal(19,0)") / gcd).cast("long") * sign
    return F.when(d != 0, F.struct(whole(n).alias("num"), whole(d).alias("den")))


def rational_value(n: Column, d: Column) -> Column:
    """A fraction as a double; null over zero."""
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def short_digest(digest: Column, size: int = 12) -> Column:
    """The first characters of a digest, for display beside the whole."""
    return F.substring(digest, 1, size)


def sniff_audio(head: Column) -> Column:
    """Codec of an audio file by its first 256 bytes: wav, Opus, vorbis, ogg, fLaC or unknown."""
    text = F.hex(F.substring(head, 1, 256))
    has = lambda s: F.expr("0 = 1") if not s else F.instr(text, s.encode().hex().upper()) % 2 == 1
    starts = lambda s: text.startswith(s.encode().hex().upper())
    wave = starts("RIFF") & (F.substring(text, 17, 8) == "WAVE".encode().hex().upper())
    ogg = F.when(has("OpusHead"), "Opus").when(has("vorbis"), "vorbis").otherwise("ogg")
    return F.when(wave, "wav").when(starts("OggS"), ogg).when(starts("fLaC"), "fLaC").otherwise("unknown")


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> Column:
    """BT.709 full-range luma and chroma in 16.16 fixed point, clamped to a byte."""
    byte = lambda x: F.greatest(F.least(F.shiftright(x, 16), F.lit(255)), F.lit(0))
    return F.struct(
        byte(19595 * r + 38470 * g + 7471 * b + 32768).alias("y"), byte(-11056 * r - 21712 * g + 32768 * b + 8388608).alias("cb"), byte(32768 * r - 27440 * g - 5328 * b + 8388608).alias("cr")
    )


def pdf_escape(text: Column) -> Column:
    """Text inside a PDF string: backslash and parentheses are escaped."""
    for raw in ("\\", "(", ")"):
        text = F.replace(text, F.lit(raw), F.lit("\\" + raw))
    return text


#: Names that stand for a container format. Fixed values.
CONTAINER_NAMES = {"iso_bmff": ("iso_bmff", "isobmff", "mp4", "m4v", "mov", "3gp", "3g2"), "matroska": ("matroska", "mkv", "webm")}


def container_family(name: Column) -> Column:
    """The format a container name stands for; a name of none is itself, in lower case."""
    low = F.lower(name)
    out = low
    for family, names in CONTAINER_NAMES.items():
        out = F.when(low.isin(*names), family).otherwise(out)
    return out


def shown_size(display_width: Column, display_height: Column, coded_width: Column, coded_height: Column) -> Column:
    """(width, height) a picture is shown at: the display size, each side falling back to the coded one."""
    return F.struct(F.coalesce(display_width, coded_width).alias("width"), F.coalesce(display_height, coded_height).alias("height"))


def pixel_aspect(num: Column, den: Column) -> Column:
    """Aspect of a pixel as a double; square where nothing, or nothing over zero, is declared."""
    return F.coalesce(rational_value(num, den), F.lit(1.0))


def channel_count(channels: Column) -> Column:
    return F.coalesce(channels, F.lit(0))


def finding_range(start_us: Column, end_us: Column) -> Column:
    """(first, last) microsecond of a finding: from 0 where it has no start, to its start where it has no end."""
    first = F.coalesce(start_us, F.lit(0).cast("long"))
    return F.struct(first.alias("first"), F.coalesce(end_us, first).alias("last"))


def unix_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.floor(micros(ts) / 1_000_000).cast("long")


def describe_packet_damage(kind: Column, stream: Column, idx: Column, time_us: Column, declared: Column, recovered: Column, missing: Column) -> Column:
    """One line for a damaged packet or a stream that lacks packets."""
    empty = F.format_string("sample %s of stream %s at %s holds no bytes", idx.cast("string"), stream.cast("string"), F.coalesce(timecode(time_us), F.lit("an unknown time")))
    short = F.format_string("stream %s declares %s samples, %s were read, %s are missing", *[c.cast("string") for c in (stream, declared, recovered, missing)])
    return F.when(kind == "empty_sample", empty).otherwise(short)


def describe_entry(time_us: Column, source: Column, summary: Column) -> Column:
    """One line of a timeline: its time, or where it would stand, its source and what it says."""
    return F.format_string("%s [%s] %s", F.coalesce(timecode(time_us), F.lit("unplaced")), source, summary)
