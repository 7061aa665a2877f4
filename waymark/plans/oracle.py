"""The same questions as DuckDB SQL: common table expressions from the mapped observations to the state machine, as a recursive query."""

from __future__ import annotations

from waymark.sources.mapped import MAPPED_SQL

SOURCE = "driver"


def dist(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a, b = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lon2} - {lon1}) / 2)"
    h = f"({a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b})"
    return f"(2 * 6371008.8 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h}))))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    d = f"radians({lon2} - {lon1})"
    deg = f"degrees(atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d})))"
    return f"(CASE WHEN {deg} < 0 THEN {deg} + 360 ELSE {deg} END)"


def sid(prefix: str, *parts: str) -> str:
    joined = " || ".join(f"chr(0) || {p}" for p in parts)
    return f"('{prefix}:' || substr(sha256({joined}), 1, 24))"


def text_time(us: str) -> str:
    """RFC 3339 with the fraction's trailing zeros left out."""
    return f"(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z')"


def fix(p: str = "") -> str:
    return sid("fix", f"{p}id", text_time(f"{p}t_us"), f"printf('%.9f', {p}lat)", f"printf('%.9f', {p}lon)", f"coalesce(printf('%.3f', {p}ha), 'missing')")


def geohash(lat: str, lon: str) -> str:
    """Eight characters: twenty bits of each coordinate, in turn from the longitude's first."""
    x, y = f"CAST(floor(({lon} + 180) / 360 * 1048576) AS BIGINT)", f"CAST(floor(({lat} + 90) / 180 * 1048576) AS BIGINT)"
    bit = f"CASE WHEN b % 2 = 0 THEN ({x} >> (19 - b // 2)) & 1 ELSE ({y} >> (19 - b // 2)) & 1 END"
    return f"list_aggregate(list_transform(range(0, 8), lambda k: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + list_sum(list_transform(range(5 * k, 5 * k + 5), lambda b: ({bit}) << (4 - b % 5))) AS INT), 1)), 'string_agg', '')"


STATE = "CASE WHEN p_ha IS NOT NULL AND ha IS NOT NULL THEN 'both_known' WHEN ha IS NOT NULL THEN 'previous_missing' WHEN p_ha IS NOT NULL THEN 'current_missing' ELSE 'both_missing' END"
SUPPORT = "CASE WHEN {k} > 0 AND {m} > 0 THEN 'mixed' WHEN {k} > 0 THEN 'all_known' WHEN {m} > 0 THEN 'all_missing' ELSE 'none' END"


def support(known: str, missing: str) -> str:
    return SUPPORT.format(k=known, m=missing)


STEPS_SQL = f"""
c AS (SELECT *, row_number() OVER i AS rk, count(*) OVER w AS sample_count,
        max({dist("blat", "blon", "lat", "lon")}) OVER w AS scatter
      FROM (SELECT *, first_value(lat) OVER i AS blat, first_value(lon) OVER i AS blon FROM m WINDOW i AS (PARTITION BY id, t_us ORDER BY ha NULLS LAST, lat, lon, source_row))
      WINDOW i AS (PARTITION BY id, t_us ORDER BY ha NULLS LAST, lat, lon, source_row), w AS (PARTITION BY id, t_us)),
n AS (SELECT id, t_us, source_row, lat, lon, ha, sample_count, CASE WHEN sample_count > 1 THEN scatter ELSE 0.0 END AS scatter FROM c WHERE rk = 1),
l AS (SELECT *, row_number() OVER o AS idx, lag(t_us) OVER o AS p_us, lag(lat) OVER o AS p_lat, lag(lon) OVER o AS p_lon, lag(ha) OVER o AS p_ha FROM n WINDOW o AS (PARTITION BY id ORDER BY t_us)),
d AS (SELECT *, CASE WHEN idx = 1 THEN 0.0 ELSE (t_us - p_us) / 1000000.0::DOUBLE END AS dt, CASE WHEN idx = 1 THEN 0.0 ELSE {dist("p_lat", "p_lon", "lat", "lon")} END AS raw, CASE WHEN idx = 1 THEN 'initial' ELSE {STATE} END AS state FROM l),
f AS (SELECT *, CASE WHEN idx = 1 THEN 0.0 ELSE greatest(0.0, raw - coalesce(p_ha, 0) - coalesce(ha, 0)) END AS eff FROM d),
g AS (SELECT *, CASE WHEN dt > 0 THEN eff / dt ELSE 0.0 END AS speed FROM f),
h AS (SELECT *, idx > 1 AND dt > 7200 AS is_gap, idx > 1 AND (eff > 50000 OR (dt > 0 AND speed > 50)) AS is_disc,
        CASE WHEN eff > 50000 AND dt > 0 AND speed > 50 THEN 'jump_and_speed' WHEN eff > 50000 THEN 'jump_only' WHEN dt > 0 AND speed > 50 THEN 'speed_only' ELSE 'unknown' END AS reason FROM g),
s AS (SELECT *, CAST(sum(CAST(is_gap OR is_disc AS INT)) OVER o AS BIGINT) AS run, CAST(1 + sum(CAST(is_disc AS INT)) OVER o AS BIGINT) AS seg,
        CASE WHEN idx = 1 THEN 'initial' WHEN is_gap OR is_disc THEN 'continuity_break' WHEN eff <= 100 THEN 'within_deadband' ELSE 'movement' END AS movement_state,
        CASE WHEN idx = 1 OR is_gap OR dt <= 0 THEN 'unknown' WHEN eff <= 8000 AND speed <= 6 THEN 'walk-compatible' ELSE 'non-walk-compatible' END AS speed_class,
        {sid("trk", f"'{SOURCE}'", "id")} AS track_id, 'device:' || id AS subject, lead(is_gap) OVER (PARTITION BY id ORDER BY idx) AS n_gap, lead(is_disc) OVER (PARTITION BY id ORDER BY idx) AS n_disc,
        CASE WHEN dt <= 0 THEN 'non_positive' WHEN dt < 1 THEN 'lt_1s' WHEN dt < 5 THEN '1_5s' WHEN dt < 30 THEN '5_30s' WHEN dt < 60 THEN '30_60s' WHEN dt < 300 THEN '1_5m' WHEN dt < 1800 THEN '5_30m' WHEN dt < 7200 THEN '30m_2h' ELSE 'ge_2h' END AS dt_band,
        CASE WHEN eff < 5 THEN 'lt_5m' WHEN eff < 50 THEN '5_50m' WHEN eff < 500 THEN '50_500m' WHEN eff < 5000 THEN '500m_5km' ELSE 'ge_5km' END AS distance_band
      FROM h WINDOW o AS (PARTITION BY id ORDER BY idx))"""

_NEAR = f"greatest(0.0, {dist('a_lat', 'a_lon', 's.lat', 's.lon')} - coalesce(a_ha, 0) - coalesce(s.ha, 0)) <= 100"

FOLD_SQL = f"""
x(id, run, idx, phase, a_lat, a_lon, a_ha, reason, no, last_idx, cand_us, pend_no, pend_idx, decision, member_no, opens_no, from_no, depart_idx, closes_no, started) AS (
  SELECT id, run, idx, 'seeking', lat, lon, ha, CASE WHEN run = 0 THEN 'dataset_start' ELSE 'continuity_reset' END, 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS BIGINT),
         CASE WHEN run = 0 THEN 'dataset_start' ELSE 'continuity_break' END, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS BIGINT), CAST(NULL AS INT), false
  FROM s WHERE idx = 1 OR is_gap OR is_disc
  UNION ALL
  SELECT id, run, idx,
    CASE WHEN phase = 'seeking' THEN CASE WHEN near THEN 'present' ELSE 'seeking' END WHEN leaves THEN 'seeking' ELSE 'present' END,
    CASE WHEN re_anchors THEN lat ELSE a_lat END, CASE WHEN re_anchors THEN lon ELSE a_lon END, CASE WHEN re_anchors THEN ha ELSE a_ha END,
    CASE WHEN leaves THEN 'movement_arrival' WHEN phase = 'seeking' AND NOT near THEN CASE WHEN pend_no IS NOT NULL THEN 'movement_arrival' ELSE 'candidate_presence' END ELSE reason END,
    CASE WHEN phase = 'seeking' AND near THEN no + 1 ELSE no END,
    CASE WHEN near THEN idx ELSE last_idx END,
    CASE WHEN phase = 'present' AND NOT near AND NOT leaves AND (cand_us IS NULL OR expired) THEN t_us WHEN phase = 'present' AND NOT near AND NOT leaves THEN cand_us END,
    CASE WHEN leaves THEN no WHEN phase = 'seeking' AND near THEN NULL ELSE pend_no END,
    CASE WHEN leaves THEN last_idx WHEN phase = 'seeking' AND near THEN NULL ELSE pend_idx END,
    CASE WHEN phase = 'seeking' AND NOT near THEN 'presence_candidate_reanchored'
         WHEN phase = 'seeking' AND reason = 'movement_arrival' AND pend_no IS NOT NULL THEN 'presence_confirmed_arrival_transition'
         WHEN phase = 'seeking' AND reason IN ('movement_arrival', 'candidate_presence') THEN 'presence_confirmed_enter_suppressed'
         WHEN phase = 'seeking' THEN 'presence_confirmed_' || reason
         WHEN near AND cand_us IS NOT NULL THEN 'departure_candidate_returned_inside' WHEN near THEN 'presence_inside'
         WHEN leaves THEN 'departure_confirmed' WHEN cand_us IS NULL THEN 'departure_candidate_started' ELSE 'departure_candidate_window_expired_restart' END,
    CASE WHEN near THEN CASE WHEN phase = 'seeking' THEN no + 1 ELSE no END END,
    CASE WHEN phase = 'seeking' AND near THEN no + 1 END,
    CASE WHEN phase = 'seeking' AND near AND reason = 'movement_arrival' THEN pend_no END,
    CASE WHEN phase = 'seeking' AND near AND reason = 'movement_arrival' THEN pend_idx END,
    CASE WHEN leaves THEN no END,
    phase = 'present' AND NOT near AND NOT leaves AND (cand_us IS NULL OR expired)
  FROM (SELECT *, phase = 'present' AND NOT near AND cand_us IS NOT NULL AND NOT expired AS leaves, (phase = 'seeking' AND NOT near) OR (phase = 'present' AND NOT near AND cand_us IS NOT NULL AND NOT expired) AS re_anchors
        FROM (SELECT s.id, s.run, s.idx, s.t_us, s.lat, s.lon, s.ha, x.phase, x.a_lat, x.a_lon, x.a_ha, x.reason, x.no, x.last_idx, x.cand_us, x.pend_no, x.pend_idx,
                {_NEAR} AS near, coalesce((s.t_us - x.cand_us) / 1000000.0::DOUBLE > 900, false) AS expired
              FROM x JOIN s ON s.id = x.id AND s.run = x.run AND s.idx = x.idx + 1))),
z AS (SELECT s.*, x.decision, x.phase, x.cand_us, x.pend_no, coalesce(x.member_no, lead(x.opens_no) OVER r) AS member_no, x.opens_no, x.from_no, x.depart_idx, x.started, x.reason AS start_reason, x.no AS cur_no,
        CASE WHEN x.closes_no IS NOT NULL THEN x.closes_no WHEN x.phase = 'present' AND lead(x.idx) OVER r IS NULL THEN x.no END AS closes_no,
        CASE WHEN x.closes_no IS NOT NULL THEN 'confirmed_movement' WHEN x.phase = 'present' AND lead(x.idx) OVER r IS NULL THEN CASE WHEN n_disc THEN 'discontinuity' WHEN n_gap THEN 'gap' ELSE 'dataset_end' END END AS end_reason,
        lead(x.idx) OVER r IS NULL AS run_ends
      FROM x JOIN s USING (id, run, idx) WINDOW r AS (PARTITION BY s.id, s.run ORDER BY s.idx))"""

PRESENCE_SQL = f"""
pc AS (SELECT id, run, member_no AS no, avg(cos(radians(lat)) * cos(radians(lon))) AS cx, avg(cos(radians(lat)) * sin(radians(lon))) AS cy, avg(sin(radians(lat))) AS cz FROM z WHERE member_no IS NOT NULL GROUP BY ALL),
pl AS (SELECT id, run, no, degrees(atan2(cz, sqrt(cx * cx + cy * cy))) AS clat, degrees(atan2(cy, cx)) AS clon FROM pc),
pm AS (SELECT z.id, z.run, no, any_value(clat) AS clat, any_value(clon) AS clon, any_value(track_id) AS track_id, any_value(subject) AS subject, any_value(seg) AS seg, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n,
         max({dist("clat", "clon", "lat", "lon")}) AS scatter, median(ha) AS median_ha, min(ha) AS min_ha, max(ha) AS max_ha, count(ha) AS known, max(CASE WHEN opens_no IS NOT NULL THEN start_reason END) AS start_reason, bool_or(from_no IS NOT NULL) AS entered
       FROM z JOIN pl ON z.id = pl.id AND z.run = pl.run AND z.member_no = pl.no GROUP BY z.id, z.run, no),
pe AS (SELECT id, run, closes_no AS no, end_reason FROM z WHERE closes_no IS NOT NULL),
p AS (SELECT pm.*, pe.end_reason, a.t_us AS a_us, e.t_us AS e_us, (e.t_us - a.t_us) / 1000000.0::DOUBLE AS duration, n - known AS missing, CASE WHEN (e.t_us - a.t_us) / 1000000.0::DOUBLE >= 900 THEN 'dwell' ELSE 'stay' END AS kind,
        {sid("prs", "pm.track_id", fix("a."))} AS presence_id, {sid("seg", "pm.track_id", "CAST(pm.seg AS VARCHAR)")} AS segment_id, a.lat AS a_lat, a.lon AS a_lon, a.ha AS a_ha, e.lat AS e_lat, e.lon AS e_lon, e.ha AS e_ha, {fix("a.")} AS a_fix, {text_time("a.t_us")} AS a_text, {text_time("e.t_us")} AS e_text
      FROM pm JOIN pe USING (id, run, no) JOIN z a ON a.id = pm.id AND a.idx = pm.first_idx JOIN z e ON e.id = pm.id AND e.idx = pm.last_idx),
t AS (SELECT q.id, q.run, o.no AS from_no, d.no, o.presence_id AS origin_id, d.presence_id AS destination_id, d.track_id, d.segment_id, o.e_us AS depart_us, d.a_us AS arrive_us, o.clat AS o_lat, o.clon AS o_lon, d.a_lat AS d_lat, d.a_lon AS d_lon,
        o.known AS o_known, o.missing AS o_missing, d.known AS d_known, d.missing AS d_missing, d.first_idx - q.depart_idx + 1 AS n,
        (SELECT sum(raw) FROM s WHERE s.id = q.id AND s.idx > q.depart_idx AND s.idx <= d.first_idx) AS path, (SELECT count(ha) FROM s WHERE s.id = q.id AND s.idx >= q.depart_idx AND s.idx <= d.first_idx) AS known,
        {sid("trn", "d.track_id", "o.presence_id", "d.presence_id")} AS transition_id
      FROM z q JOIN p o ON o.id = q.id AND o.run = q.run AND o.no = q.from_no JOIN p d ON d.id = q.id AND d.run = q.run AND d.no = q.opens_no WHERE q.from_no IS NOT NULL)"""

EVENTS_SQL = f"""
v AS (
  SELECT id, 'START' AS event_type, t_us, 0 AS rank, {sid("evt", f"'{SOURCE}'", "subject", "'START'", text_time("t_us"), "track_id")} AS event_id, lat, lon, CAST(NULL AS DOUBLE) AS magnitude, '' AS presence_id, seg, CAST(NULL AS BIGINT) AS end_us, track_id, CAST(ha IS NOT NULL AS INT) AS known, CAST(ha IS NULL AS INT) AS missing FROM s WHERE idx = 1
  UNION ALL SELECT id, 'END', t_us, 6, {sid("evt", f"'{SOURCE}'", "subject", "'END'", text_time("t_us"), "track_id")}, lat, lon, NULL, '', seg, NULL, track_id, CAST(ha IS NOT NULL AS INT), CAST(ha IS NULL AS INT) FROM s WHERE n_gap IS NULL
  UNION ALL SELECT c.id, 'GAP', c.t_us, 4, {sid("evt", f"'{SOURCE}'", "c.subject", "'GAP'", text_time("c.t_us"), fix("b."), fix("c."))}, c.lat, c.lon, c.dt, '', c.seg, NULL, c.track_id, CAST(b.ha IS NOT NULL AS INT) + CAST(c.ha IS NOT NULL AS INT), CAST(b.ha IS NULL AS INT) + CAST(c.ha IS NULL AS INT) FROM s c JOIN s b ON b.id = c.id AND b.idx = c.idx - 1 WHERE c.is_gap
  UNION ALL SELECT c.id, 'DISCONTINUITY', c.t_us, 5, {sid("evt", f"'{SOURCE}'", "c.subject", "'DISCONTINUITY'", text_time("c.t_us"), fix("b."), fix("c."))}, c.lat, c.lon, c.raw, '', c.seg, NULL, c.track_id, CAST(b.ha IS NOT NULL AS INT) + CAST(c.ha IS NOT NULL AS INT), CAST(b.ha IS NULL AS INT) + CAST(c.ha IS NULL AS INT) FROM s c JOIN s b ON b.id = c.id AND b.idx = c.idx - 1 WHERE c.is_disc
  UNION ALL SELECT id, upper(kind), a_us, 2, {sid("evt", f"'{SOURCE}'", "subject", "upper(kind)", "a_text", "e_text", "presence_id")}, clat, clon, duration, presence_id, seg, e_us, track_id, known, missing FROM p
  UNION ALL SELECT id, 'ENTER', a_us, 1, {sid("evt", f"'{SOURCE}'", "subject", "'ENTER'", "a_text", "segment_id", "a_fix")}, a_lat, a_lon, NULL, presence_id, seg, NULL, track_id, CAST(a_ha IS NOT NULL AS INT), CAST(a_ha IS NULL AS INT) FROM p WHERE entered
  UNION ALL SELECT id, 'LEAVE', e_us, 3, {sid("evt", f"'{SOURCE}'", "subject", "'LEAVE'", "e_text", "presence_id")}, e_lat, e_lon, NULL, presence_id, seg, NULL, track_id, CAST(e_ha IS NOT NULL AS INT), CAST(e_ha IS NULL AS INT) FROM p WHERE end_reason = 'confirmed_movement'),
ev AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t_us, rank, event_id) AS seq, {sid("seg", "track_id", "CAST(seg AS VARCHAR)")} AS segment_id FROM v)"""


def steps(select: str) -> str:
    return f"WITH {MAPPED_SQL.strip()},{STEPS_SQL}\n{select}"


def folded(select: str) -> str:
    return f"WITH RECURSIVE {MAPPED_SQL.strip()},{STEPS_SQL},{FOLD_SQL}\n{select}"


def presence(select: str) -> str:
    return f"WITH RECURSIVE {MAPPED_SQL.strip()},{STEPS_SQL},{FOLD_SQL},{PRESENCE_SQL}\n{select}"


def events(select: str) -> str:
    return f"WITH RECURSIVE {MAPPED_SQL.strip()},{STEPS_SQL},{FOLD_SQL},{PRESENCE_SQL},{EVENTS_SQL}\n{select}"
