"""DuckDB SQL for the registered queries of the media operators, written independently of them."""

from __future__ import annotations

DAY30 = 86_400_000_000 * 30
FRAMES = "fr AS (SELECT o_custkey AS stream, o_orderkey AS idx, epoch_us(o_orderdate) AS pts_us, o_orderpriority = '1-URGENT' AS is_key FROM orders)"
SAMPLES = "sa AS (SELECT event_type AS stream, event_id AS idx, epoch_us(ts) AS pts_us, CAST(round(value * 100) AS BIGINT) AS size, event_id % 12 = 0 AS is_key, event_type FROM events)"
STEPS = "st AS (SELECT *, lag(pts_us) OVER w AS previous, pts_us - lag(pts_us) OVER w AS delta FROM fr WINDOW w AS (PARTITION BY stream ORDER BY idx))"
MODAL = """mo AS (SELECT stream, delta AS modal, n AS support FROM (SELECT stream, delta, count(*) AS n, row_number() OVER (PARTITION BY stream ORDER BY count(*) DESC, delta) AS r
FROM st WHERE delta > 0 GROUP BY stream, delta) WHERE r = 1)"""
SCAN = f"""scan AS (
SELECT stream, idx, 'negative' AS kind, previous, pts_us AS observed, CAST(NULL AS BIGINT) AS size FROM st WHERE pts_us < 0
UNION ALL SELECT stream, idx, 'non_monotonic', previous, pts_us, NULL FROM st WHERE delta < 0
UNION ALL SELECT stream, idx, 'overlap', previous, pts_us, NULL FROM st WHERE delta = 0
UNION ALL SELECT st.stream, idx, 'gap', previous, pts_us, delta - modal FROM st JOIN mo ON st.stream = mo.stream WHERE delta - modal > {DAY30})"""
GOPS = """pl AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY stream) AS n,
last_value(pts_us) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_us FROM fr),
gops AS (SELECT stream, row_number() OVER w - 1 AS gop, place AS first_idx, coalesce(lead(place) OVER w, n) - place AS length, pts_us AS start_us,
coalesce(lead(pts_us) OVER w, last_us) AS end_us FROM pl WHERE is_key WINDOW w AS (PARTITION BY stream ORDER BY place))"""
GOP_CHANGES = """gc AS (SELECT stream, gop, first_idx, before AS previous_length, length, start_us FROM (
SELECT *, lag(length) OVER w AS before, lead(gop) OVER w AS after FROM gops WINDOW w AS (PARTITION BY stream ORDER BY gop)) WHERE after IS NOT NULL AND abs(length - before) > {tol})"""
GOP_SUMMARY = """gs AS (SELECT stream, CAST(sum(n) AS BIGINT) AS gops, min(length) AS shortest, max(length) AS longest, min(length) = max(length) AS uniform,
arg_max(length, n * 1000000 - seen) AS modal_length FROM (SELECT stream, length, count(*) AS n, min(gop) AS seen FROM gops GROUP BY stream, length) GROUP BY stream)"""
SIL = """q AS (SELECT user_id AS stream, event_id AS slot, abs(value / 500) < 0.1 AS quiet FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY slot) - row_number() OVER (PARTITION BY stream, quiet ORDER BY slot) AS grp FROM q),
sil AS (SELECT stream, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS length FROM g WHERE quiet GROUP BY stream, grp HAVING count(*) >= 2)"""
POS = "bp AS (SELECT stream, idx, size, CAST(48 + coalesce(sum(size) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM sa)"
SCENES = """e AS (SELECT vec_id % 8 AS stream, vec_id // 8 AS idx, embedding AS v FROM embeddings),
pr AS (SELECT a.stream, a.idx, a.v AS v, b.v AS w FROM e a JOIN e b ON a.stream = b.stream AND a.idx = b.idx + 1),
un AS (SELECT stream, idx, abs(CAST(unnest(v) AS DOUBLE) - CAST(unnest(w) AS DOUBLE)) AS d FROM pr),
sc AS (SELECT stream, idx, round(avg(d), 6) AS mean_abs, round(avg(CASE WHEN d > 0.25 THEN 1.0 ELSE 0.0 END), 6) AS changed FROM un GROUP BY stream, idx)"""
RESYNC = """pk AS (SELECT user_id % 4 AS stream, event_id AS idx, event_id % 9 = 0 AS is_key, CAST(floor(value) AS BIGINT) % 11 <> 0 AS ok FROM events),
ns AS (SELECT *, max(CASE WHEN NOT ok THEN idx END) OVER w AS failed, max(CASE WHEN ok AND is_key THEN idx END) OVER w AS healed FROM pk WINDOW w AS (PARTITION BY stream ORDER BY idx)),
rs AS (SELECT stream, idx, CASE WHEN NOT ok THEN 'failed' WHEN failed > coalesce(healed, -1) THEN 'lost' ELSE 'decoded' END AS state FROM ns)"""
LOST = """li AS (SELECT stream, min(idx) AS from_idx, count(*) AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY idx) - row_number() OVER (PARTITION BY stream, state ORDER BY idx) AS g FROM rs)
WHERE state = 'lost' GROUP BY stream, g)"""
HASH = "h AS (SELECT vec_id, CAST(sum(CASE WHEN x > 0 THEN CASE WHEN i = 64 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (i - 1)) END ELSE 0 END) AS BIGINT) AS hash FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id)"
META = "m AS (SELECT doc_id % 150 AS asset, CASE WHEN (doc_id // 150) % 2 = 0 THEN 'container' ELSE 'track' END AS scope, lang AS key, CAST(n_chars // 1000 AS VARCHAR) AS value, doc_id AS idx FROM documents)"
PAIRS = """l AS (SELECT o_custkey // 2 AS asset, o_orderstatus AS kind, row_number() OVER (PARTITION BY o_custkey // 2, o_orderstatus ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey AS left_index, o_orderpriority AS lp, CAST(floor(o_totalprice) AS BIGINT) AS lt FROM orders WHERE o_custkey % 2 = 0),
r AS (SELECT o_custkey // 2 AS asset, o_orderstatus AS kind, row_number() OVER (PARTITION BY o_custkey // 2, o_orderstatus ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey AS right_index, o_orderpriority AS rp, CAST(floor(o_totalprice) AS BIGINT) AS rt FROM orders WHERE o_custkey % 2 = 1),
p AS (SELECT coalesce(l.asset, r.asset) AS asset, coalesce(l.kind, r.kind) AS kind, coalesce(l.ordinal, r.ordinal) AS ordinal, left_index, right_index, lp, rp, lt, rt FROM l FULL JOIN r ON l.asset = r.asset AND l.kind = r.kind AND l.ordinal = r.ordinal)"""
VERDICT = "CASE WHEN \"left\" IS NULL AND \"right\" IS NULL THEN 'not_comparable' WHEN \"right\" IS NULL THEN 'only_left' WHEN \"left\" IS NULL THEN 'only_right' WHEN \"left\" = \"right\" THEN 'equal' ELSE 'different' END"
FIELDS = f"""f AS (SELECT *, {VERDICT} AS verdict FROM (SELECT asset, kind, ordinal, 'codec' AS axis, 'priority' AS field, lp AS "left", rp AS "right" FROM p
UNION ALL SELECT asset, kind, ordinal, 'timing', 'price', CAST(lt AS VARCHAR), CAST(rt AS VARCHAR) FROM p))"""
FINDINGS = f"""{FRAMES}, {STEPS}, {MODAL}, {SCAN}, {GOPS}, {GOP_CHANGES.format(tol=5)}, {GOP_SUMMARY},
lv AS (SELECT user_id, max(abs(value / 500)) AS peak, round(avg(value / 500), 6) AS mean FROM events GROUP BY user_id),
fi AS (
SELECT CAST(stream AS VARCHAR) AS asset_id, 'TIMING.NON_MONOTONIC_PTS' AS rule_id, 'SIGNIFICANT' AS severity, 'HIGH' AS confidence, observed AS start_us, CAST(idx AS VARCHAR) AS discriminator FROM scan WHERE kind = 'non_monotonic'
UNION ALL SELECT CAST(stream AS VARCHAR), 'TIMING.TIMESTAMP_GAP', 'WARNING', 'HIGH', NULL, CAST(idx AS VARCHAR) FROM scan WHERE kind = 'gap'
UNION ALL SELECT CAST(stream AS VARCHAR), 'VIDEO.GOP_LENGTH_CHANGE', 'SIGNIFICANT', 'HIGH', start_us, CAST(gop AS VARCHAR) FROM gc
UNION ALL SELECT CAST(stream AS VARCHAR), 'VIDEO.SINGLE_KEYFRAME', 'WARNING', 'HIGH', NULL, '0' FROM gs WHERE gops = 1
UNION ALL SELECT CAST(user_id AS VARCHAR), 'AUDIO.CLIPPING', 'WARNING', 'HIGH', NULL, '' FROM lv WHERE peak >= 0.999
UNION ALL SELECT CAST(user_id AS VARCHAR), 'AUDIO.DC_OFFSET', 'WARNING', 'HIGH', NULL, '' FROM lv WHERE abs(mean) >= 0.001),
fn AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'SIGNIFICANT' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END AS severity_rank FROM fi)"""
COUNTS = """ct AS (SELECT asset_id, count(*) AS findings, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'SIGNIFICANT') AS significant, count(*) FILTER (severity = 'WARNING') AS warning,
count(*) FILTER (severity = 'INFORMATIONAL') AS informational, CAST(min(severity_rank) AS BIGINT) AS worst_rank FROM fn GROUP BY asset_id)"""
FVERDICT = "CASE WHEN bool_or(severity IN ('CRITICAL', 'SIGNIFICANT')) THEN 'FAIL' WHEN bool_or(severity = 'WARNING') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END"
CHECKS = """fa AS (SELECT p_partkey, ['avc1', 'hev1', 'zzz', 'ap4h'][p_partkey % 4 + 1] AS codec, p_size * 40 AS width, p_size / 2.0 AS fps, p_partkey % 3 AS channels, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS av FROM part),
ck AS (SELECT p_partkey, 'r1' AS id, 'video_codec' AS kind, CASE codec WHEN 'zzz' THEN 'UNDETERMINED' WHEN 'ap4h' THEN 'NOT_MET' ELSE 'MET' END AS outcome FROM fa
UNION ALL SELECT p_partkey, 'r2', 'resolution', CASE WHEN width = 800 THEN 'MET' ELSE 'NOT_MET' END FROM fa
UNION ALL SELECT p_partkey, 'r3', 'frame_rate', CASE WHEN abs(fps - 12.5) <= 5 THEN 'MET' ELSE 'NOT_MET' END FROM fa
UNION ALL SELECT p_partkey, 'r4', 'audio_channels', CASE channels WHEN 0 THEN 'UNDETERMINED' WHEN 2 THEN 'MET' ELSE 'NOT_MET' END FROM fa
UNION ALL SELECT p_partkey, 'r5', 'audio_sample_rate', 'MET' FROM fa
UNION ALL SELECT p_partkey, 'r6', 'max_av_offset_ms', CASE WHEN av IS NULL THEN 'UNDETERMINED' WHEN av <= 30 THEN 'MET' ELSE 'NOT_MET' END FROM fa
UNION ALL SELECT p_partkey, 'r7', 'container', 'MET' FROM fa UNION ALL SELECT p_partkey, 'r8', 'audio_codec', 'UNDETERMINED' FROM fa)"""
BATCH = f"""{FINDINGS}, {COUNTS}, ba AS (SELECT CAST(c_custkey AS VARCHAR) AS asset_id, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN 'FAILED' WHEN c_custkey % 13 = 0 THEN 'SKIPPED' ELSE 'ANALYSED' END AS status,
coalesce(findings, 0) AS findings, worst_rank FROM customer LEFT JOIN ct ON ct.asset_id = CAST(c_custkey AS VARCHAR))"""
TIMELINE = """tl AS (SELECT event_type AS source, CASE WHEN event_id % 17 <> 0 THEN epoch_us(ts) END AS time_us, CAST(event_id AS VARCHAR) AS reference, event_type AS summary FROM events
UNION ALL SELECT 'finding', epoch_us(o_orderdate), 'o' || o_orderkey, o_orderpriority FROM orders),
tr AS (SELECT *, CAST(CASE source WHEN 'metadata' THEN 0 WHEN 'packet' THEN 1 WHEN 'frame' THEN 2 WHEN 'finding' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS BIGINT) AS source_rank FROM tl)"""
SYNC = """ev AS (SELECT user_id % 16 AS asset, event_id AS idx, epoch_us(ts) AS pts_us, event_type FROM events),
vi AS (SELECT asset, idx, pts_us, row_number() OVER (PARTITION BY asset ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY asset) AS n FROM ev WHERE event_type = 'view'),
au AS (SELECT asset, pts_us AS a_us, count(*) OVER (PARTITION BY asset) AS m, max(pts_us) OVER (PARTITION BY asset) AS last_us FROM ev WHERE event_type = 'click'),
al AS (SELECT DISTINCT asset, m, last_us FROM au),
ha AS (SELECT vi.*, CASE WHEN place < n // 2 THEN 0 ELSE 1 END AS half, last_us FROM vi JOIN al ON vi.asset = al.asset WHERE n >= 2 AND m >= 2),
ru AS (SELECT *, max(pts_us) OVER (PARTITION BY asset, half ORDER BY idx) AS key_us FROM ha),
ma AS (SELECT ru.asset, half, idx, coalesce(min(a_us), any_value(ru.last_us)) - any_value(pts_us) AS residual FROM ru LEFT JOIN au ON ru.asset = au.asset AND a_us >= key_us GROUP BY ru.asset, half, idx),
rk AS (SELECT *, row_number() OVER (PARTITION BY asset, half ORDER BY residual) - 1 AS i, count(*) OVER (PARTITION BY asset, half) AS k FROM ma),
me AS (SELECT asset, half, CASE WHEN any_value(k) % 2 = 1 THEN sum(residual) ELSE sum(residual) // 2 END AS med FROM rk WHERE (k % 2 = 1 AND i = k // 2) OR (k % 2 = 0 AND i IN (k // 2 - 1, k // 2)) GROUP BY asset, half)"""

_SQL = {
    "pts_scan": f"WITH {FRAMES}, {STEPS}, {MODAL}, {SCAN} SELECT * FROM scan",
    "dts_scan": f"WITH {FRAMES}, {STEPS} SELECT stream, idx, 'non_monotonic_dts' AS kind, previous, pts_us AS observed FROM st WHERE delta < 0",
    "modal_delta": f"WITH {FRAMES}, {STEPS}, {MODAL} SELECT * FROM mo",
    "frame_rate_changes": """WITH e AS (SELECT event_type AS stream, event_id AS idx, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step FROM events),
t AS (SELECT stream, idx, step * 40000 + CASE WHEN step % 97 = 0 THEN 7000 ELSE 0 END AS pts_us FROM e),
d AS (SELECT *, pts_us - lag(pts_us) OVER (PARTITION BY stream ORDER BY pts_us, idx) AS delta FROM t)
SELECT stream, pts_us, delta, CAST(40000 AS BIGINT) AS dominant FROM d WHERE abs(delta - 40000) > 2000""",
    "av_sync": """WITH v AS (SELECT user_id % 64 AS asset, event_id AS idx, epoch_us(ts) AS pts_us, max(epoch_us(ts)) OVER (PARTITION BY user_id % 64 ORDER BY event_id) AS key_us FROM events WHERE event_type = 'view'),
a AS (SELECT DISTINCT user_id % 64 AS asset, epoch_us(ts) AS a_us FROM events WHERE event_type = 'click'), m AS (SELECT asset, max(a_us) AS last_us FROM a GROUP BY asset),
n AS (SELECT v.*, a.a_us FROM v ASOF LEFT JOIN a ON v.asset = a.asset AND v.key_us <= a.a_us)
SELECT n.asset, idx, pts_us, key_us, coalesce(a_us, last_us) AS match_us FROM n LEFT JOIN m ON m.asset = n.asset""",
    "av_sync_report": f"""WITH {SYNC} SELECT asset, CAST(max(CASE WHEN half = 0 THEN med END) AS BIGINT) AS initial_us, CAST(max(CASE WHEN half = 1 THEN med END) AS BIGINT) AS final_us,
CAST(max(CASE WHEN half = 1 THEN med END) - max(CASE WHEN half = 0 THEN med END) AS BIGINT) AS drift_us FROM me GROUP BY asset""",
    "sample_times": """WITH x AS (SELECT o_custkey AS stream, o_orderkey AS seq, o_custkey % 7 * 100 + 40 AS delta, unnest(range(o_orderkey % 5)) AS k FROM orders)
SELECT stream, row_number() OVER w - 1 AS idx, CAST(coalesce(sum(delta) OVER (PARTITION BY stream ORDER BY seq, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts FROM x WINDOW w AS (PARTITION BY stream ORDER BY seq, k)""",
    "measured_duration": """SELECT l_orderkey AS stream, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS duration, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN CAST(min(l_linenumber) AS BIGINT) END AS step FROM lineitem GROUP BY l_orderkey""",
    "gop_segments": f"WITH {FRAMES}, {GOPS} SELECT * FROM gops",
    "gop_changes": f"WITH {FRAMES}, {GOPS}, {GOP_CHANGES.format(tol=2)} SELECT * FROM gc",
    "gop_summary": f"WITH {FRAMES}, {GOPS}, {GOP_SUMMARY} SELECT * FROM gs",
    "repeated_runs": """WITH e AS (SELECT user_id % 4 AS stream, event_id AS idx, event_type AS digest, event_id % 3 = 0 AS is_key FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY idx) - row_number() OVER (PARTITION BY stream, digest ORDER BY idx) AS grp FROM e)
SELECT stream, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS length, digest, bool_and(is_key) AS all_key FROM g GROUP BY stream, digest, grp HAVING count(*) >= 2""",
    "sliding_bitrate": f"""WITH {SAMPLES}, wb AS (SELECT stream, count(*) AS n, sum(size) * 8e6 / (arg_max(pts_us, idx) - arg_min(pts_us, idx)) AS average FROM sa GROUP BY stream),
w AS (SELECT *, row_number() OVER o AS place, sum(size) OVER f AS bytes, sum(is_key::INT) OVER f AS keyframes, first_value(pts_us) OVER f AS start_us FROM sa
WINDOW o AS (PARTITION BY stream ORDER BY idx), f AS (PARTITION BY stream ORDER BY idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT w.stream, idx, start_us, pts_us AS end_us, round(bytes * 8e6 / (pts_us - start_us), 6) AS bits, CAST(keyframes AS BIGINT) AS keyframes FROM w JOIN wb ON w.stream = wb.stream
WHERE n > 12 AND place >= 12 AND pts_us > start_us AND bytes * 8e6 / (pts_us - start_us) < 0.8 * average""",
    "whole_bitrate": f"WITH {SAMPLES} SELECT stream, count(*) AS samples, round(sum(size) * 8e6 / (arg_max(pts_us, idx) - arg_min(pts_us, idx)), 6) AS average FROM sa GROUP BY stream",
    "byte_positions": f"WITH {SAMPLES}, {POS} SELECT * FROM bp",
    "offset_asof": f"""WITH {SAMPLES}, {POS}, pb AS (SELECT event_type AS stream, event_id * 977 AS "offset" FROM events),
b1 AS (SELECT stream, byte_offset, max(idx) AS idx FROM bp GROUP BY stream, byte_offset)
SELECT pb.stream, pb."offset", b1.idx, b1.byte_offset FROM pb ASOF LEFT JOIN b1 ON pb.stream = b1.stream AND pb."offset" >= b1.byte_offset""",
    "near_duplicate_frames": """WITH e AS (SELECT user_id % 4 AS stream, event_id AS idx, CAST(floor(value) AS BIGINT) % 32 AS hash, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS place FROM events)
SELECT x.stream, x.idx AS a, y.idx AS b FROM e x JOIN e y ON x.stream = y.stream AND x.hash = y.hash AND y.place > x.place AND y.place <= x.place + 8""",
    "scene_changes": f"WITH {SCENES} SELECT * FROM sc",
    "largest_scene_change": f"WITH {SCENES} SELECT stream, mean_abs, idx FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY mean_abs DESC, idx) AS r FROM sc) WHERE r = 1",
    "decode_resync": f"WITH {RESYNC} SELECT * FROM rs",
    "lost_intervals": f"WITH {RESYNC}, {LOST} SELECT * FROM li",
    "unexplained_packets": f"""WITH {RESYNC}, {LOST} SELECT stream, idx FROM pk WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.stream = pk.stream AND rs.idx = pk.idx AND state = 'decoded')
AND NOT EXISTS (SELECT 1 FROM li WHERE skipped >= 2 AND li.stream = pk.stream AND pk.idx BETWEEN from_idx AND from_idx + 1)""",
    "bit_hashes": f"WITH {HASH} SELECT * FROM h",
    "hamming_distance": f"WITH {HASH} SELECT a.vec_id, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1",
    "frame_diff": """WITH u AS (SELECT a.vec_id, abs(CAST(unnest(a.embedding) AS DOUBLE) - CAST(unnest(b.embedding) AS DOUBLE)) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(avg(d), 6) AS mean_abs, round(avg(CASE WHEN d > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS changed, round(max(d), 6) AS largest, max(d) = 0 AS identical FROM u GROUP BY vec_id""",
    "level_stats": """SELECT user_id AS stream, count(*) AS slots, round(max(abs(value / 500)), 6) AS peak, round(sqrt(avg(value / 500 * (value / 500))), 6) AS rms, round(avg(value / 500), 6) AS mean,
round(20 * log10(nullif(max(abs(value / 500)), 0)), 6) AS peak_dbfs, round(20 * log10(nullif(sqrt(avg(value / 500 * (value / 500))), 0)), 6) AS rms_dbfs FROM events GROUP BY user_id""",
    "silence_regions": f"WITH {SIL} SELECT * FROM sil",
    "silence_totals": f"WITH {SIL} SELECT stream, count(*) AS regions, CAST(sum(length) AS BIGINT) AS silent_slots FROM sil GROUP BY stream",
    "waveform": """WITH p AS (SELECT user_id AS stream, value / 500 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT stream, CAST(place // greatest(CAST(ceil(n / 8.0) AS BIGINT), 1) AS BIGINT) AS "column", round(min(v), 6) AS low, round(max(v), 6) AS high, round(sqrt(avg(v * v)), 6) AS rms FROM p GROUP BY ALL""",
    "level_histogram": """WITH l AS (SELECT event_type AS stream, least(CAST(floor(value) AS BIGINT), 255) AS level FROM events),
b AS (SELECT stream, unnest(range(256)) AS level FROM (SELECT DISTINCT stream FROM l))
SELECT b.stream, b.level, count(l.level) AS n FROM b LEFT JOIN l ON l.stream = b.stream AND l.level = b.level GROUP BY ALL""",
    "histogram_summary": """WITH l AS (SELECT event_type AS stream, least(CAST(floor(value) AS BIGINT), 255) AS level FROM events), c AS (SELECT stream, level, count(*) AS n FROM l GROUP BY ALL)
SELECT stream, round(sum(CASE WHEN level <= 2 THEN n ELSE 0 END) / sum(n), 6) AS black, round(sum(CASE WHEN level >= 253 THEN n ELSE 0 END) / sum(n), 6) AS white,
min(level) AS lowest, max(level) AS highest, arg_max(level, n * 1000 - level) AS peak_level FROM c GROUP BY stream""",
    "loudness_gate": """WITH b AS (SELECT user_id AS stream, CASE WHEN user_id % 7 = 0 THEN -80.0 ELSE value / 3 - 100 END AS x FROM events),
l AS (SELECT stream, list(x) FILTER (x > -70) AS xs FROM b GROUP BY stream), g AS (SELECT stream, coalesce(xs, []) AS xs, list_avg(xs) AS mean FROM l),
k AS (SELECT stream, xs, mean, list_filter(xs, lambda x: x > mean - 10) AS ys FROM g)
SELECT stream, round(CASE WHEN len(xs) = 0 THEN -70 WHEN len(ys) = 0 THEN mean ELSE list_avg(ys) END, 6) AS lufs, CAST(CASE WHEN len(ys) = 0 THEN len(xs) ELSE len(ys) END AS BIGINT) AS blocks FROM k""",
    "loudness_range": """SELECT user_id AS stream, round(greatest(quantile_cont(CAST(value / 3 - 100 AS DOUBLE), 0.95) - quantile_cont(CAST(value / 3 - 100 AS DOUBLE), 0.10), 0), 6) AS lra FROM events WHERE value / 3 - 100 > -70 AND user_id % 7 <> 0 GROUP BY user_id""",
    "block_spans": """WITH n AS (SELECT user_id AS stream, count(*) * 100 AS slots FROM events GROUP BY user_id)
SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY s) - 1 AS block, s AS first_slot FROM (SELECT stream, unnest(range(0, slots - 1000 + 1, 250)) AS s FROM n WHERE slots >= 1000)""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents",
    "integrity": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR text IS NULL THEN 'unverifiable' WHEN doc_id % 5 = 0 THEN 'modified' WHEN doc_id % 3 = 0 AND reverse(text) <> text THEN 'hash_mismatch' ELSE 'intact' END AS state FROM documents""",
    "asset_dedupe": "SELECT min(doc_id) AS id, sha256(text) AS sha256 FROM documents GROUP BY text",
    "metadata_conflicts": f"WITH {META} SELECT asset, key, count(*) AS entries, count(DISTINCT scope) AS scopes, count(DISTINCT value) AS \"values\" FROM m GROUP BY asset, key HAVING count(DISTINCT scope) >= 2 AND count(DISTINCT value) >= 2",
    "metadata_diff": f"""WITH {META}, a AS (SELECT asset, key, arg_min(value, idx) AS v FROM m WHERE scope = 'container' GROUP BY ALL), b AS (SELECT asset, key, arg_min(value, idx) AS v FROM m WHERE scope = 'track' GROUP BY ALL)
SELECT coalesce(a.asset, b.asset) AS asset, coalesce(a.key, b.key) AS key, a.v AS left_value, b.v AS right_value, CASE WHEN b.asset IS NULL THEN 'only_left' WHEN a.asset IS NULL THEN 'only_right' WHEN a.v = b.v THEN 'equal' ELSE 'different' END AS verdict
FROM a FULL JOIN b ON a.asset = b.asset AND a.key = b.key""",
    "missing_creation": f"WITH {META} SELECT asset, count(*) AS entries FROM m GROUP BY asset HAVING NOT bool_or(lower(key) = 'de')",
    "encoder_marks": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Lavf58 ' || source WHEN doc_id % 5 = 0 THEN 'x264 - core; HandBrake' ELSE source END AS value FROM documents WHERE doc_id % 4 IN (0, 1)),
e AS (SELECT doc_id, unnest(CASE WHEN value LIKE 'Lavf%' THEN ['FFmpeg (libavformat)'] WHEN value LIKE 'x264%' THEN ['x264', 'HandBrake'] ELSE [] END) AS encoder, value AS observation FROM t)
SELECT DISTINCT doc_id, encoder, observation, 'declared_tag' AS evidence, 'LOW' AS confidence FROM e
UNION ALL SELECT doc_id, 'all-intra encoding', 'every sample in the track is a sync sample', 'structure', 'MEDIUM' FROM documents WHERE doc_id % 11 = 0""",
    "codec_families": """WITH c AS (SELECT p_partkey, ['avc1', 'HEVC', ' mp4a', 'sowt', 'vp09', 'zzz', '.mp3', 'Apch'][p_partkey % 8 + 1] AS name FROM part)
SELECT p_partkey, name, CASE lower(trim(name)) WHEN 'avc1' THEN 'h264' WHEN 'hevc' THEN 'h265' WHEN 'mp4a' THEN 'aac' WHEN 'sowt' THEN 'pcm' WHEN 'vp09' THEN 'vp9' WHEN '.mp3' THEN 'mp3' WHEN 'apch' THEN 'prores' END AS family FROM c""",
    "stream_pairing": f"WITH {PAIRS} SELECT asset, kind, ordinal, left_index, right_index, left_index IS NOT NULL AND right_index IS NOT NULL AS matched FROM p",
    "field_diff": f"WITH {PAIRS}, {FIELDS} SELECT * FROM f",
    "axis_groups": f"""WITH {PAIRS}, {FIELDS} SELECT asset, axis, count(*) FILTER (verdict IN ('different', 'only_left', 'only_right')) AS differing, count(*) FILTER (verdict = 'not_comparable') AS uncomparable FROM f GROUP BY asset, axis
HAVING count(*) FILTER (verdict <> 'equal') > 0""",
    "comparison_outcome": f"WITH {PAIRS}, {FIELDS} SELECT asset, CASE WHEN bool_or(verdict IN ('different', 'only_left', 'only_right')) THEN 'DIFFERENT' WHEN bool_or(verdict = 'not_comparable') THEN 'INCOMPLETE' ELSE 'EQUIVALENT' END AS outcome FROM f GROUP BY asset",
    "same_layout": """WITH a AS (SELECT o_custkey // 2 AS asset, list(o_orderstatus ORDER BY o_orderkey) AS l FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey // 2 AS asset, list(o_orderstatus ORDER BY o_orderkey) AS l FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.asset, b.asset) AS asset, a.l IS NOT DISTINCT FROM b.l AS same FROM a FULL JOIN b ON a.asset = b.asset""",
    "within_tolerance": """WITH a AS (SELECT c_custkey % 100 AS k, max(c_acctbal) AS l FROM customer GROUP BY 1), b AS (SELECT s_suppkey % 150 AS k, max(s_acctbal) AS r FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN l IS NULL THEN 'unmeasured_left' WHEN r IS NULL THEN 'unmeasured_right' WHEN abs(l - r) <= 500 THEN 'agree' ELSE 'diverge' END AS verdict FROM a FULL JOIN b ON a.k = b.k""",
    "packet_counts": """WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS stream, o_orderkey % 8 AS declared, coalesce(n, 0) AS recovered, o_orderkey % 8 - coalesce(n, 0) AS missing FROM orders LEFT JOIN g ON l_orderkey = o_orderkey WHERE o_orderkey % 8 > coalesce(n, 0)""",
    "delivery_checks": f"WITH {CHECKS} SELECT * FROM ck",
    "delivery_verdicts": f"""WITH {CHECKS} SELECT p_partkey, count(*) FILTER (outcome = 'NOT_MET') AS not_met, count(*) FILTER (outcome = 'UNDETERMINED') AS undetermined, CASE WHEN bool_and(outcome = 'MET') THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ck WHERE id NOT IN ('r8', 'r6') GROUP BY p_partkey""",
    "rule_findings": f"WITH {FINDINGS} SELECT asset_id, rule_id, severity, confidence, start_us, discriminator, CAST(severity_rank AS BIGINT) AS severity_rank FROM fn",
    "severity_counts": f"WITH {FINDINGS}, {COUNTS} SELECT * FROM ct",
    "finding_verdicts": f"WITH {FINDINGS} SELECT asset_id, {FVERDICT} AS verdict FROM fn GROUP BY asset_id",
    "combined_verdicts": f"""WITH {FINDINGS}, {CHECKS}, v AS (SELECT asset_id, {FVERDICT} AS verdict FROM fn GROUP BY asset_id UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE WHEN bool_and(outcome = 'MET') THEN 'PASS' ELSE 'FAIL' END FROM ck WHERE id IN ('r3', 'r5', 'r7') GROUP BY p_partkey)
SELECT asset_id, CASE max(CASE verdict WHEN 'PASS' THEN 0 WHEN 'FAIL' THEN 2 ELSE 1 END) WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS_WITH_WARNINGS' ELSE 'FAIL' END AS verdict FROM v GROUP BY asset_id""",
    "dashboard": f"""WITH {FINDINGS}, d AS (SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'SIGNIFICANT') AS significant, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFORMATIONAL') AS informational,
count(*) FILTER (length(asset_id) % 2 = 0) AS awaiting_review, count(*) FILTER (length(asset_id) % 2 = 1) AS reviewed FROM fn) SELECT *, CASE WHEN critical + significant + awaiting_review > 0 THEN 'REVIEW REQUIRED' ELSE 'COMPLETE' END AS review_status FROM d""",
    "batch_summary": f"WITH {BATCH} SELECT status, count(*) AS files, CAST(sum(findings) AS BIGINT) AS findings, ['CRITICAL', 'SIGNIFICANT', 'WARNING', 'INFORMATIONAL'][min(worst_rank) + 1] AS worst_severity FROM ba GROUP BY status",
    "batch_order": f"WITH {BATCH} SELECT * FROM ba",
    "case_search": """WITH s AS (SELECT 'finding' AS arm, CAST(c_custkey AS VARCHAR) AS id, 'Finding for ' || c_name AS title, c_mktsegment AS detail, c_custkey % 4 AS rank FROM customer WHERE c_custkey % 4 <= 2
UNION ALL SELECT 'asset', CAST(p_partkey AS VARCHAR), p_name, p_type, 3 FROM part UNION ALL SELECT 'evidence', CAST(s_suppkey AS VARCHAR), s_name, 'evidence', 3 FROM supplier)
SELECT arm, id, title, CAST(rank AS BIGINT) AS rank FROM s WHERE contains(lower(title), '1') OR contains(lower(detail), '1') ORDER BY rank, id, arm LIMIT 200""",
    "search_total": """SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM customer WHERE contains(lower('Finding for ' || c_name), 'name#0000') OR contains(lower(c_mktsegment), 'name#0000')
UNION ALL SELECT count(*) FROM part WHERE contains(lower(p_name), 'name#0000') OR contains(lower(p_type), 'name#0000') UNION ALL SELECT count(*) FROM supplier WHERE contains(lower(s_name), 'name#0000'))""",
    "asset_lookup": """WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part), q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE upper(p_name) END AS asked FROM part),
x AS (SELECT name, min(id) AS id FROM a GROUP BY name), l AS (SELECT lower(name) AS name, min(id) AS id FROM a GROUP BY lower(name) HAVING count(*) = 1)
SELECT asked, coalesce(a.id, x.id, l.id) AS id FROM q LEFT JOIN a ON a.id = asked LEFT JOIN x ON x.name = asked LEFT JOIN l ON l.name = lower(asked)""",
    "latest_analysis": """SELECT asset, id, started_us, o_orderstatus FROM (SELECT o_custkey AS asset, o_orderkey AS id, epoch_us(o_orderdate) AS started_us, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
    "upsert": """SELECT id, version, o_orderstatus FROM (SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2 DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
    "insert_ignore": """WITH s AS (SELECT o_custkey AS analysis, o_orderpriority AS rule, o_orderkey AS n FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT o_custkey AS analysis, o_orderpriority AS rule, min(o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
SELECT * FROM s UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.analysis = t.analysis AND s.rule = t.rule)""",
    "timeline_retention": """SELECT asset, runs, missing, CASE WHEN runs = 0 THEN 'no_runs' WHEN missing = 0 THEN 'complete' ELSE 'partial' END AS state FROM (SELECT c_custkey AS asset, count(o_orderkey) AS runs, count(*) FILTER (o_orderstatus = 'P') AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""",
    "timeline": f"WITH {TIMELINE} SELECT time_us, source_rank, source, reference, summary FROM tr",
    "timeline_layers": f"WITH {TIMELINE} SELECT CASE WHEN source = 'error' THEN 'error' ELSE 'finding' END AS layer, count(time_us) AS entries, min(time_us) AS first_us, max(time_us) AS last_us, count(*) FILTER (time_us IS NULL) AS unplaced FROM tr GROUP BY 1",
    "nearest_mark": """WITH k AS (SELECT DISTINCT user_id % 16 AS asset, epoch_us(ts) AS m FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id % 16 AS asset, event_id AS probe, epoch_us(ts) AS at_us FROM events WHERE event_type <> 'purchase'),
b AS (SELECT p.*, k.m AS b FROM p ASOF LEFT JOIN k ON p.asset = k.asset AND p.at_us >= k.m), a AS (SELECT b.*, k.m AS a FROM b ASOF LEFT JOIN k ON b.asset = k.asset AND b.at_us <= k.m),
c AS (SELECT asset, probe, at_us, CASE WHEN b IS NULL OR a - at_us < at_us - b THEN a ELSE b END AS m FROM a) SELECT asset, probe, at_us, CASE WHEN abs(m - at_us) <= 600000000 THEN m END AS mark_us FROM c""",
    "frame_navigation": f"""WITH {SAMPLES}, n AS (SELECT stream, idx, pts_us, min(CASE WHEN is_key THEN idx END) OVER (PARTITION BY stream ORDER BY pts_us, idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_key,
max(CASE WHEN is_key THEN idx END) OVER (PARTITION BY stream ORDER BY pts_us, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_key FROM sa),
f AS (SELECT n.*, s.idx AS second_forward FROM n ASOF LEFT JOIN sa s ON n.stream = s.stream AND n.pts_us + 1000000 <= s.pts_us)
SELECT f.stream, f.idx, next_key, previous_key, second_forward, s.idx AS second_back FROM f ASOF LEFT JOIN sa s ON f.stream = s.stream AND f.pts_us - 1000000 >= s.pts_us""",
    "timecodes": """WITH t AS (SELECT event_id, (event_id - 5000) * 7654321 AS us FROM events), m AS (SELECT event_id, us, abs(us) // 1000 AS ms FROM t)
SELECT event_id, CASE WHEN us < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS timecode FROM m""",
    "tick_conversion": "SELECT o_orderkey, CAST(CAST(o_orderkey - 7000 AS HUGEINT) * 123457 * 1000000 // 90000 AS BIGINT) AS us FROM orders",
    "saturating": """SELECT o_orderkey, CAST(least(9223372036854775798::HUGEINT + o_orderkey % 20, 9223372036854775807) AS BIGINT) AS up, CAST(greatest(-9223372036854775798::HUGEINT - o_orderkey % 20, -9223372036854775808::HUGEINT) AS BIGINT) AS down FROM orders""",
    "trimmed_floats": r"SELECT event_id, regexp_replace(printf('%.3f', round(value, 2)), '\.?0+$', '') AS text FROM events",
    "rational_equality": "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) FILTER (CAST(l_quantity AS BIGINT) = 6 * l_linenumber) AS same FROM lineitem GROUP BY 1",
    "profile_slugs": "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '-', 'g') || ' v' || p_size AS slug FROM part",
    "fingerprints": "SELECT p_partkey, sha256(p_name || chr(31) || p_brand || chr(31) || p_size) AS fingerprint FROM part",
    "measurement_rows": "SELECT event_id, event_id || ' LUFS (BS (1770) 4)' AS value, '' AS method FROM events WHERE false UNION ALL SELECT event_id, event_id || ' LUFS (BS', '1770) 4' FROM events UNION ALL SELECT event_id, event_type, '' FROM events",
    "findings_csv": f"""WITH {FINDINGS}, ms AS (
SELECT CAST(stream AS VARCHAR) AS a, 'TIMING.NON_MONOTONIC_PTS' AS r, CAST(idx AS VARCHAR) AS d, 'observed_us ' || observed AS m FROM scan WHERE kind = 'non_monotonic'
UNION ALL SELECT CAST(stream AS VARCHAR), 'TIMING.TIMESTAMP_GAP', CAST(idx AS VARCHAR), 'gap_us ' || size FROM scan WHERE kind = 'gap'
UNION ALL SELECT CAST(stream AS VARCHAR), 'VIDEO.GOP_LENGTH_CHANGE', CAST(gop AS VARCHAR), 'from ' || previous_length || '; to ' || length FROM gc
UNION ALL SELECT CAST(stream AS VARCHAR), 'VIDEO.SINGLE_KEYFRAME', '0', 'gops ' || gops FROM gs WHERE gops = 1
UNION ALL SELECT CAST(user_id AS VARCHAR), 'AUDIO.CLIPPING', '', 'peak ' || peak FROM lv UNION ALL SELECT CAST(user_id AS VARCHAR), 'AUDIO.DC_OFFSET', '', 'mean ' || mean FROM lv)
SELECT asset_id, rule_id, severity, m AS measurements, CASE WHEN start_us IS NULL THEN '' ELSE printf('%02d:%02d:%02d.%03d', start_us // 3600000000, start_us // 60000000 % 60, start_us // 1000000 % 60, start_us // 1000 % 1000) END AS start
FROM fn JOIN ms ON a = asset_id AND r = rule_id AND d = discriminator""",
    "file_names": """SELECT page_id, list_last(string_split(url, '/')) AS name, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""",
    "format_probe": "SELECT p_partkey, ['iso_bmff', 'matroska', 'wav', 'aiff', 'ogg', 'flac', 'unknown'][p_partkey % 7 + 1] AS format FROM part",
    "yuv_pixels": """WITH c AS (SELECT p_partkey, 298 * (p_partkey * 7 % 256 - 16) + 128 AS base, p_partkey * 31 % 256 - 128 AS u, p_partkey * 101 % 256 - 128 AS v FROM part)
SELECT p_partkey, CAST(greatest(0, least(255, floor((base + 409 * v) / 256.0))) AS BIGINT) AS r, CAST(greatest(0, least(255, floor((base - 100 * u - 208 * v) / 256.0))) AS BIGINT) AS g, CAST(greatest(0, least(255, floor((base + 516 * u) / 256.0))) AS BIGINT) AS b FROM c""",
    "safe_paths": """SELECT p_partkey, left(regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g'), 64) || '/x.y/' || left(regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g'), 64) AS path FROM part""",
    "measurement_texts": "SELECT event_id, printf('%.1f', round(value, 0)) || ' LUFS (BS.1770-4)' AS text FROM events",
    "frame_dimensions": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size * 16 AS BIGINT) END AS width, CASE WHEN p_partkey % 3 = 0 THEN CAST(1080 AS BIGINT) END AS height FROM part",
    "referenced_evidence": "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT o_orderkey % 997 FROM orders) OR s_suppkey IN (SELECT o_custkey % 50 FROM orders)",
    "evidence_links": "SELECT event_id AS id, c_custkey AS evidence_id FROM events JOIN customer ON user_id = c_custkey % 15 AND CAST(floor(value) AS BIGINT) = c_custkey // 15 WHERE event_id % 3 = 0",
    "against_reference": """SELECT source AS case_id, CASE WHEN count(*) FILTER (doc_id % 45 = 0) = 1 THEN min(doc_id) FILTER (doc_id % 45 = 0) END AS reference_id, CASE WHEN count(*) FILTER (doc_id % 45 = 0) = 1 THEN min(sha256(text)) FILTER (doc_id % 45 = 0) END AS sha256,
CASE count(*) FILTER (doc_id % 45 = 0) WHEN 0 THEN 'absent' WHEN 1 THEN 'designated' ELSE 'ambiguous' END AS state FROM documents GROUP BY source""",
    "severity_rollup": f"WITH {FINDINGS} SELECT severity, rule_id, count(*) AS findings FROM fn GROUP BY ROLLUP (severity, rule_id)",
    "packet_damage": """SELECT l_orderkey AS stream, 'empty_sample' AS kind, CAST(l_linenumber AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS declared, CAST(NULL AS BIGINT) AS recovered, CAST(NULL AS BIGINT) AS missing FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 10 = 0
UNION ALL SELECT o_orderkey, 'declared_over_recovered', NULL, o_orderkey % 8, n, o_orderkey % 8 - n FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 GROUP BY o_orderkey) WHERE n < o_orderkey % 8""",
    "first_streams": "SELECT user_id AS asset, min(event_id) AS stream_index FROM events WHERE event_type = 'view' GROUP BY user_id",
    "timeline_placement": f"WITH {TIMELINE} SELECT source, count(*) AS entries, count(time_us) AS placed, count(*) - count(time_us) AS unplaced, count(time_us) AS measured FROM tl GROUP BY source",
    "metadata_lookup": f"WITH {META} SELECT asset, scope, key, value, idx FROM m WHERE key = 'de' AND scope = 'track'",
    "shown_sizes": """SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size * 16 ELSE 1920 END AS BIGINT) AS width, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1080 ELSE 1088 END AS BIGINT) AS height,
round(CASE WHEN p_partkey % 4 = 0 OR p_partkey % 5 = 0 THEN 1.0 ELSE CAST(p_size AS DOUBLE) / (p_partkey % 5) END, 6) AS aspect, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS channels FROM part""",
    "finding_ranges": """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id * 1000 ELSE 0 END AS "first", CASE WHEN event_id % 2 = 0 THEN event_id * 2000 WHEN event_id % 3 <> 0 THEN event_id * 1000 ELSE 0 END AS "last" FROM events""",
    "frame_infos": """WITH f AS (SELECT o_custkey AS asset, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus = 'F'),
o AS (SELECT o_custkey AS asset, o_orderpriority AS info, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus = 'O')
SELECT f.asset, o_orderkey AS stream_index, info FROM f JOIN o ON f.asset = o.asset AND f.i = o.i""",
    "nearest_frame": """WITH e AS (SELECT user_id % 16 AS asset, event_id, epoch_us(ts) AS us, event_type FROM events), p AS (SELECT asset, event_id AS probe, us AS at_us FROM e WHERE event_type = 'purchase'),
f AS (SELECT asset, us, min(event_id) AS idx FROM e WHERE event_type = 'view' GROUP BY ALL),
c AS (SELECT p.*, f.idx, p.at_us - f.us AS far FROM p ASOF LEFT JOIN f ON p.asset = f.asset AND p.at_us >= f.us UNION ALL SELECT p.*, f.idx, f.us - p.at_us FROM p ASOF LEFT JOIN f ON p.asset = f.asset AND p.at_us <= f.us)
SELECT asset, probe, at_us, idx FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY far NULLS LAST, idx) AS r FROM c) WHERE r = 1""",
    "timeline_duration": "SELECT o_custkey AS asset, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 40000 END) AS duration_us FROM orders GROUP BY o_custkey",
    "unstable_axes": f"WITH {PAIRS}, {FIELDS} SELECT DISTINCT asset, axis FROM f WHERE verdict = 'different'",
    "difference_order": f"""WITH {PAIRS}, {FIELDS} SELECT asset, kind, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN ordinal % 3 = 0 THEN 'other' ELSE axis END AS axis,
CAST(CASE WHEN ordinal % 3 = 0 THEN 11 WHEN axis = 'codec' THEN 2 ELSE 6 END AS BIGINT) AS axis_order, field, verdict FROM f""",
    "reorder_delays": "SELECT o_custkey AS stream, o_orderkey AS idx, o_orderkey % 3 * 50000 - 60000 AS delay_us FROM orders",
    "reorder_summary": "SELECT o_custkey AS stream, count(*) AS frames, count(*) FILTER (o_orderkey % 3 = 2) AS reordered, max(o_orderkey % 3) * 50000 - 60000 AS longest_us FROM orders GROUP BY o_custkey",
    "timestamp_anomalies": f"WITH {FRAMES}, {STEPS}, {MODAL}, {SCAN} SELECT * FROM scan UNION ALL SELECT stream, idx, 'non_monotonic_dts', previous, pts_us, NULL FROM st WHERE delta < 0",
    "sync_flags": "SELECT o_orderkey, o_orderkey % 5 - 2 AS initial_us, (o_orderkey % 9 - 4) * 1000 AS drift_us, o_orderkey % 9 = 4 AS constant_offset, o_orderkey % 9 NOT IN (2, 3, 4, 5, 6) AS drifting FROM orders",
    "chunk_levels": """WITH u AS (SELECT vec_id % 8 AS stream, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT stream, count(*) AS slots, round(max(abs(v)), 6) AS peak, round(sqrt(avg(v * v)), 6) AS rms, round(avg(v), 6) AS mean FROM u GROUP BY stream""",
    "short_digests": "SELECT doc_id, left(sha256(text), 12) AS digest FROM documents",
    "audio_sniff": "SELECT p_partkey, ['wav', 'unknown', 'Opus', 'vorbis', 'ogg', 'fLaC', 'unknown'][p_partkey % 7 + 1] AS codec FROM part",
    "ycbcr_pixels": """WITH p AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 31 % 256 AS g, p_partkey * 101 % 256 AS b FROM part)
SELECT p_partkey, least(greatest((19595 * r + 38470 * g + 7471 * b + 32768) >> 16, 0), 255) AS y, CAST(least(greatest(floor((-11056 * r - 21712 * g + 32768 * b + 8388608) / 65536), 0), 255) AS BIGINT) AS cb,
CAST(least(greatest(floor((32768 * r - 27440 * g - 5328 * b + 8388608) / 65536), 0), 255) AS BIGINT) AS cr FROM p""",
    "payload_rows": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0 AND event_id % 11 <> 0",
    "unix_seconds": "SELECT event_id, epoch_us(ts) // 1000000 AS at FROM events",
    "timeline_lines": f"WITH {TIMELINE} SELECT reference, CASE WHEN time_us IS NULL THEN 'unplaced' ELSE '00:00:01.500' END || ' [' || source || '] ' || summary AS line FROM tl",
    "batch_verdict": "SELECT count(*) AS files, bool_and(c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0) AS all_passed, bool_and(c_custkey % 11 = 0 OR (c_custkey % 13 <> 0 AND c_custkey % 17 <> 0)) AS examined_everything, count(*) FILTER (c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0) AS blocking FROM customer",
    "stored_timeline": """SELECT row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR), o_orderkey) AS place, CAST(3 AS BIGINT) AS started_at, CAST(o_custkey AS VARCHAR) AS analysis_id, o_orderkey AS position, CAST(o_orderkey AS VARCHAR) AS id
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 7 = 3""",
    "reduced_rationals": """WITH x AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_orderkey * 6 - 9000 AS n, CAST(l_linenumber AS BIGINT) * 4 - 8 AS d FROM lineitem)
SELECT l_orderkey, line, CASE WHEN d <> 0 THEN n // gcd(n, d) * sign(d) END AS num, CASE WHEN d <> 0 THEN abs(d) // gcd(n, d) END AS den FROM x""",
    "micros_as_ticks": "SELECT o_orderkey, CAST(trunc((o_orderkey - 7000)::HUGEINT * 1234567 * 90000 / 1000000::DECIMAL(38,0)) AS BIGINT) AS ticks FROM orders",
    "container_names": r"""SELECT p_partkey, ['iso_bmff', 'iso_bmff', 'iso_bmff', 'matroska', 'matroska', 'wav', 'avi'][p_partkey % 7 + 1] AS family, '\(a\\b\) ' || p_name AS pdf FROM part""",
    "checked_reference": """WITH a AS (SELECT doc_id % 100 AS case_id, count(*) FILTER (doc_id % 900 < 100) AS n, min(doc_id) FILTER (doc_id % 900 < 100) AS id FROM documents GROUP BY ALL)
SELECT a.case_id, CASE WHEN n = 1 THEN id END AS reference_id, CASE WHEN n = 1 THEN sha256(text) END AS sha256, CASE WHEN n = 0 THEN 'absent' WHEN n > 1 THEN 'ambiguous' WHEN id % 2 = 0 THEN 'changed' ELSE 'designated' END AS state FROM a LEFT JOIN documents ON doc_id = id""",
    "propagated_reviews": """WITH r AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS note FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)
SELECT c_custkey AS id, coalesce(r.status, 'NEW') AS status, r.note FROM customer LEFT JOIN r ON o_custkey = c_custkey""",
    "asset_hash_rows": "SELECT 'd' || doc_id AS name, '/in/' || doc_id AS source_path, CASE WHEN doc_id % 3 <> 0 THEN coalesce(sha256(text), '') ELSE '' END AS sha256, '' AS blake3, coalesce(CAST(strlen(text) AS VARCHAR), '') AS size_bytes FROM documents",
    "every_rule": """WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part), r AS (
SELECT 'VIDEO.BITRATE_DROP' AS rule_id, 'WARNING' AS severity, 1 AS timed FROM p WHERE k % 7 = 0
UNION ALL SELECT 'CONTAINER.TRUNCATED_MEDIA', 'CRITICAL', 1 FROM p WHERE n < 20 AND k % 4 = 0 UNION ALL SELECT 'CONTAINER.STRUCTURAL_DEFECT', 'WARNING', NULL FROM p WHERE n < 20 AND k % 4 <> 0
UNION ALL SELECT 'CONTAINER.UNREADABLE_PACKET', 'SIGNIFICANT', NULL FROM p WHERE k % 9 = 0 UNION ALL SELECT 'VIDEO.DECODE_FAILURE', 'SIGNIFICANT', NULL FROM p WHERE k % 8 = 0
UNION ALL SELECT 'VIDEO.GOP_LENGTH_CHANGE', 'SIGNIFICANT', 1 FROM p WHERE k % 6 = 0 UNION ALL SELECT 'VIDEO.DUPLICATE_FRAME_RUN', 'WARNING', 1 FROM p WHERE k % 5 >= 2
UNION ALL SELECT 'TIMING.NON_MONOTONIC_PTS', 'SIGNIFICANT', 1 FROM p WHERE k % 4 = 1 UNION ALL SELECT 'TIMING.TIMESTAMP_GAP', 'WARNING', NULL FROM p WHERE k % 4 = 3
UNION ALL SELECT 'TIMING.AV_SYNC_DRIFT', 'SIGNIFICANT', NULL FROM p WHERE abs(n - 25) * 200 >= 2000 UNION ALL SELECT 'METADATA.TIMESTAMP_CONFLICT', 'WARNING', NULL FROM p WHERE k % 11 = 0
UNION ALL SELECT 'METADATA.DECLARED_VS_MEASURED_MISMATCH', 'WARNING', NULL FROM p WHERE k % 13 <> 0 AND abs(n * 20000 - 500000) > 100000 UNION ALL SELECT 'CONTAINER.NO_USABLE_STREAMS', 'SIGNIFICANT', NULL FROM p WHERE k % 4 = 0
UNION ALL SELECT 'CONTAINER.MALFORMED_STRUCTURE', 'WARNING', NULL FROM p WHERE k % 10 = 0 UNION ALL SELECT 'AUDIO.CLIPPING', 'WARNING', NULL FROM p WHERE n / 50.0 >= 0.999
UNION ALL SELECT 'AUDIO.DC_OFFSET', 'WARNING', NULL FROM p WHERE k % 9 = 0 AND n >= 1 UNION ALL SELECT 'AUDIO.SILENCE_REGION', 'WARNING', NULL FROM p WHERE n * 50 >= 1000
UNION ALL SELECT 'CONTAINER.DECLARED_TRACK_MISMATCH', 'SIGNIFICANT', NULL FROM p WHERE CASE WHEN k % 3 = 0 THEN k % 6 - 1 ELSE 2 END <> k % 4 UNION ALL SELECT 'CONTAINER.STREAM_DURATION_MISSING', 'INFORMATIONAL', NULL FROM p WHERE k % 13 = 0
UNION ALL SELECT 'CONTAINER.STREAM_START_OFFSET', 'INFORMATIONAL', NULL FROM p WHERE k % 17 = 0 OR k % 19 = 0 UNION ALL SELECT 'CONTAINER.PARSE_ANOMALY', 'WARNING', NULL FROM p, (VALUES (1), (2)) WHERE k % 10 = 0
UNION ALL SELECT 'VIDEO.SINGLE_KEYFRAME', 'WARNING', NULL FROM p WHERE k % 4 = 1 UNION ALL SELECT 'VIDEO.ALL_FRAMES_KEYFRAMES', 'INFORMATIONAL', NULL FROM p WHERE k % 5 <> 0 AND k % 3 = 0
UNION ALL SELECT 'VIDEO.FRAME_RATE_CHANGE', 'INFORMATIONAL', 1 FROM p WHERE k % 12 = 0 UNION ALL SELECT 'AUDIO.INAUDIBLE', 'WARNING', NULL FROM p WHERE n >= 35 UNION ALL SELECT 'METADATA.MISSING_CREATION_TIME', 'INFORMATIONAL', NULL FROM p WHERE k % 14 = 0
UNION ALL SELECT 'VIDEO.SCENE_CHANGE', 'INFORMATIONAL', NULL FROM p WHERE n >= 30 UNION ALL SELECT 'VIDEO.NEAR_DUPLICATE_FRAME', 'INFORMATIONAL', NULL FROM p WHERE k % 15 = 0 UNION ALL SELECT 'VIDEO.HDR_METADATA_MISSING', 'WARNING', NULL FROM p WHERE k % 7 = 0 AND k % 2 <> 0)
SELECT rule_id, severity, count(*) AS findings, count(*) AS ids, count(timed) AS timed FROM r GROUP BY ALL""",
    "finding_ids": """WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS asset_id, 'CONTAINER.NO_USABLE_STREAMS' AS rule_id, 1 AS rank FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'AUDIO.INAUDIBLE', 2 FROM part WHERE p_size >= 35),
i AS (SELECT *, left(sha256(rule_id || chr(31) || asset_id || chr(31) || chr(31) || chr(31) || '-1'), 32) AS id FROM f)
SELECT row_number() OVER (ORDER BY rank, rule_id, id) AS place, asset_id, rule_id, id FROM i""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
