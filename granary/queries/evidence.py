"""Behaviour-evidence queries on frames made from events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.core import rules as r
from granary.core.numbers import ORACLE_RINT, py_round, safe_ratio
from granary.operators import narratives
from granary.operators import temporal as t
from granary.operators import windows as w
from granary.sources.events import VISIBILITY, active_frames, legacy_frames

R = ORACLE_RINT


def _layer(source: str, layer: dict[str, str], keep: str = "*") -> str:
    return f"SELECT {keep}, {', '.join(f'{v} AS {k}' for k, v in layer.items())} FROM {source}"


def _layers(name: str, source: str, layers: list[dict[str, str]]) -> dict[str, str]:
    out = {}
    for k, layer in enumerate(layers):
        target = name if k == len(layers) - 1 else f"{name}_{k}"
        out[target] = _layer(source, layer)
        source = target
    return out


def _count(counts: dict[str, str]) -> str:
    return ", ".join(f"coalesce(count_if({v}), 0)::bigint AS {k}" for k, v in counts.items())


def _mode(name: str, source: str, keys: str, value: str, order: str, out: str) -> dict[str, str]:
    return {
        f"{name}_n": f"SELECT {keys}, {value}, count(*) AS c, min({order}) AS o FROM {source} GROUP BY ALL",
        name: f"SELECT {keys}, {value} AS {out} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, o) AS nth FROM {name}_n) WHERE nth = 1",
    }


def _islands(source: str, change: str, keys: str, order: str) -> str:
    return f"SELECT *, sum(chg) OVER (PARTITION BY {keys} ORDER BY {order}) AS island FROM (SELECT *, CASE WHEN {change} THEN 1 ELSE 0 END AS chg FROM {source})"


def _longest(source: str, order: str, flags: dict[str, str]) -> str:
    """Longest runs by row numbers: in a run the number among all rows less that among flagged ones stays the same."""
    parts = [f"SELECT person, '{n}' AS k, max(c) AS c FROM (SELECT person, count(*) AS c FROM (SELECT person, row_number() OVER (PARTITION BY person ORDER BY {order}) - row_number() OVER (PARTITION BY person, coalesce({f}, false) ORDER BY {order}) AS g, coalesce({f}, false) AS f FROM {source}) WHERE f GROUP BY person, g) GROUP BY person" for n, f in flags.items()]
    cols = ", ".join(f"coalesce(max(CASE WHEN k = '{n}' THEN c END), 0) AS {n}" for n in flags)
    return f"SELECT p.person, {cols} FROM (SELECT DISTINCT person FROM {source}) p LEFT JOIN ({' UNION ALL '.join(parts)}) x USING (person) GROUP BY p.person"


med = lambda c: py_round(f"quantile_cont({c}, 0.5)", 3, R)
STABLE_1 = "device_visible AND quality_usable AND coalesce(global_motion <= t_global, true) AND (face_context OR hand_near)"
OBSERVABLE = f"device_level IN {r.MEDIUM_UP} AND (mesh_level IN {r.MEDIUM_UP} OR face_level IN {r.MEDIUM_UP})"
SIX = [f"({i} * (n - 1) / 11.0)" for i in range(12)]

CTES: dict[str, str] = {
    "ev": "SELECT user_id AS person, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, count(*) OVER (PARTITION BY user_id) AS n, event_id, ts, event_type, value, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events",
    "vis": _layer("ev", VISIBILITY),
    "fr": f"SELECT person, ord, n, ord // 12 AS clip, {r.position('ord', 'n', 'single')} AS position, k >= 5 AS quality_usable, device_visible, hand_visible, hand_visible AND k % 2 = 0 AS hand_near, face_visible, face_visible AND device_visible AS face_context, cast(k AS double) AS global_motion, value AS near_motion, value / 1000 AS hand_motion, k / 1000 AS pose_motion FROM vis",
    "md": f"SELECT person, {med('global_motion')} AS g, {med('near_motion')} AS d, {med('hand_motion')} AS h, {med('pose_motion')} AS p FROM fr GROUP BY person",
    "th": "SELECT person, greatest(g * 1.8::double, g + 4.0, 8.0::double) AS t_global, greatest(d * 1.8::double, d + 4.0, 8.0::double) AS t_near, greatest(h * 1.8::double, h + 0.03::double, 0.06::double) AS t_hand, greatest(p * 1.8::double, p + 0.02::double, 0.04::double) AS t_pose FROM md",
    "fj": "SELECT * FROM fr JOIN th USING (person)",
    **_layers("fg", "fj", r.FRAME_FLAGS),
    "fs": f"SELECT *, {r.FRAME_STATE} AS own_state FROM fg",
    "ac": "SELECT person, clip, ord, CASE WHEN ord - lag(ord) OVER (PARTITION BY person, clip ORDER BY ord) - 1 <= 1 THEN 0 ELSE 1 END AS fresh FROM fs WHERE active",
    "rn": "SELECT person, clip, ord, sum(fresh) OVER (PARTITION BY person, clip ORDER BY ord) AS run FROM ac",
    "rp": "SELECT person, ord FROM (SELECT *, count(*) OVER (PARTITION BY person, clip, run) AS c FROM rn) WHERE c >= 3",
    "pt": "SELECT fs.*, rp.ord IS NOT NULL AS repetitive, CASE WHEN rp.ord IS NOT NULL THEN 'repetitive_operation' ELSE own_state END AS state FROM fs LEFT JOIN rp ON fs.person = rp.person AND fs.ord = rp.ord",
    "ei": _islands("pt", "lag(state) OVER o IS DISTINCT FROM state OR lag(clip) OVER o IS DISTINCT FROM clip", "person", "ord").replace("FROM pt)", "FROM pt WINDOW o AS (PARTITION BY person ORDER BY ord))"),
    "e0": f"SELECT person, island, min(state) AS state, min(clip) AS clip, min(ord) AS start, max(ord) AS \"end\", count(*) AS n_points, CASE WHEN bool_or(position = 'single') THEN 'single' ELSE concat_ws('_to_', CASE WHEN bool_or(position = 'early') THEN 'early' END, CASE WHEN bool_or(position = 'middle') THEN 'middle' END, CASE WHEN bool_or(position = 'late') THEN 'late' END) END AS position, {_count(t.COUNTED)} FROM ei GROUP BY person, island",
    "ep": f"SELECT *, {r.EPISODE_SCORE} AS score, {r.EPISODE_CONFIDENCE} AS confidence, {r.EPISODE_SUPPORT} AS support, {r.episode_duration('n_points')} AS duration, {r.SELECTION_REASON} AS reason FROM e0",
    "s0": f"SELECT *, state IN {r.BACKGROUND} AS bg, count(*) OVER (PARTITION BY person) AS total, count_if(state NOT IN {r.BACKGROUND}) OVER (PARTITION BY person) AS fore FROM ep",
    "s1": "SELECT *, row_number() OVER (PARTITION BY person, bg AND fore > 0 ORDER BY score DESC, start) AS rk FROM s0",
    "s2": "SELECT * FROM s1 WHERE total <= 9 OR CASE WHEN bg AND fore > 0 THEN rk <= least(2, greatest(0, 9 - fore)) ELSE rk <= 9 END",
    "sel": "SELECT *, row_number() OVER o AS step, CASE WHEN lag(state) OVER o IS NULL THEN 'sequence_start' WHEN lag(state) OVER o = state THEN 'state_continues' ELSE lag(state) OVER o || '_to_' || state END AS transition FROM s2 WINDOW o AS (PARTITION BY person ORDER BY start)",
    "q0": f"SELECT person, {safe_ratio('count_if(quality_usable)', 'count(*)', R)} AS valid_ratio, {safe_ratio('count_if(device_visible)', 'count(*)', R)} AS device_ratio FROM fg GROUP BY person",
    "q1": _longest("fg", "ord", {"longest_stable": STABLE_1}),
    "ql": f"SELECT *, {r.FRAME_QUALITY('valid_ratio')} AS quality, {r.count_bin('longest_stable')} AS longest_stable_bin FROM q0 JOIN q1 USING (person)",
    "s3": "SELECT person, sum(n_points)::bigint AS n, count(*) AS n_episodes, " + ", ".join(f"sum(n_{k})::bigint AS p_{k}" for k in ("stable", "active", "direct", "repetitive", "confounded", "unconfounded", "visible_only")) + ", " + _count({
        "e_stable": "state = 'passive_screen_engagement'", "e_active": "state IN ('active_hand_device_operation', 'repetitive_operation')", "e_repetitive": "state = 'repetitive_operation'",
        "e_confounded": "state = 'confounded_device_region_activity'", "e_indirect": "state = 'indirect_device_region_activity'", "e_device_only": "state = 'device_visible_only'",
    }) + " FROM ep GROUP BY person",
    "sq": "SELECT * FROM s3 JOIN ql USING (person)",
    "ss": f"SELECT *, {r.SIGNAL_STRENGTH} AS signal, {r.MAIN_PATTERN} AS pattern FROM sq",
    "bk": "SELECT *, CASE WHEN state IN ('active_hand_device_operation', 'repetitive_operation') THEN 'risk' WHEN state = 'passive_screen_engagement' THEN 'engagement' ELSE 'background' END AS bucket FROM sel",
    "ph": "SELECT person, " + ", ".join(f"count_if(bucket = '{b}' AND contains(position, '{p}'))::bigint AS {b}_{p}" for b in ("risk", "engagement", "background") for p in ("early", "middle", "late")) + " FROM bk GROUP BY person",
    "tr0": "SELECT *, " + ", ".join(f"{' + '.join(f'(({b}_{p} > 0)::int)' for p in ('early', 'middle', 'late'))} AS {b}_phases" for b in ("risk", "engagement")) + " FROM ss JOIN ph USING (person)",
    "tr1": _layer("tr0", {k: " ".join(["CASE", *(f"WHEN {c} THEN {v}" for c, v in s), "ELSE 0 END"]) for k, s in r.TRACE_PARTS.items()}),
    "tr2": f"SELECT *, greatest(0, least(10, {' + '.join(r.TRACE_PARTS)})) AS trace_score FROM tr1",
    "tr3": f"SELECT *, {r.TRACE_STRENGTH} AS strength FROM tr2",
    "tr": f"SELECT *, {r.ORDINARY_USE} AS ordinary FROM tr3",
    # windows
    "fa": "SELECT person, ord, ord // 6 + 1 AS win, device_visible, hand_visible, face_visible, face_visible AND k % 5 <> 0 AS mesh_visible, CASE WHEN NOT hand_visible THEN 'none' WHEN k % 3 = 0 THEN 'lower_frame' WHEN k % 3 = 1 THEN 'middle_frame' ELSE 'upper_frame' END AS hand_region, CASE WHEN k < 20 THEN 'low' ELSE 'sufficient' END AS lighting, CASE WHEN k >= 95 THEN 'low' ELSE 'sufficient' END AS blur, CASE WHEN face_visible AND k % 5 <> 0 THEN 0.1::double + (k % 20) / 100 END AS eye_openness, face_visible AND k % 7 = 0 AS face_close, face_visible AND k % 11 = 0 AS several_faces, CASE WHEN ord % 6 > 0 THEN value / 1000 END AS local_motion, CASE WHEN ord % 6 > 0 THEN k / 1000 END AS global_motion FROM vis",
    "wc": "SELECT person, max(win) AS n FROM fa GROUP BY person",
    "wi": "SELECT person, n, i FROM wc, range(12) g(i) WHERE i < n",
    "wp": f"SELECT person, (CASE WHEN n <= 12 THEN i ELSE {R.format('i * (n - 1) / 11.0::double')}::bigint END) + 1 AS win, i + 1 AS window_order, {r.position('i', 'least(n, 12)')} AS position FROM wi",
    "cw": "SELECT * FROM fa JOIN wp USING (person, win)",
    "w0": "SELECT person, win, min(window_order) AS window_order, min(position) AS position, count(*) AS n_frames, " + ", ".join(f"{safe_ratio(f'count_if({x}_visible)', 'count(*)', R)} AS {x}_ratio" for x in ("device", "face", "mesh", "hand")) + f", coalesce(max(local_motion), 0) AS local_peak, coalesce(max(global_motion), 0) AS global_peak, coalesce(count_if(local_motion >= 0.035::double), 0)::bigint AS local_bursts, coalesce(count_if(global_motion >= 0.05::double), 0)::bigint AS global_bursts, coalesce(max(greatest(local_motion - global_motion * 0.6::double, CASE WHEN local_motion IS NOT NULL THEN 0::double END)), 0) AS localized_peak, coalesce(count_if(local_motion IS NOT NULL AND greatest(local_motion - global_motion * 0.6::double, 0) >= {w.LOCALIZED_THRESHOLD!r}::double), 0)::bigint AS localized_bursts, coalesce(count_if(hand_region IN ('lower_frame', 'middle_frame')), 0)::bigint AS near_hands, coalesce(count_if(hand_region = 'lower_frame'), 0)::bigint AS lower_hands, count(eye_openness) AS n_eyes, coalesce(count_if(coalesce(eye_openness < 0.2::double, false)), 0)::bigint AS n_closed, {py_round('avg(eye_openness)', 6, R)} AS mean_eyes, coalesce(count_if(face_close), 0)::bigint AS n_close_faces, coalesce(count_if(several_faces), 0)::bigint AS n_several, coalesce(count_if(face_visible), 0)::bigint AS n_faces FROM cw GROUP BY person, win",
    **_mode("wl", "cw", "person, win", "lighting", "ord", "lighting"),
    **_mode("wb", "cw", "person, win", "blur", "ord", "blur"),
    "ax": "SELECT v.person, ord // 6 + 1 AS win, ord, unnest([CASE WHEN k % 4 = 0 THEN 'brow' END, CASE WHEN k % 3 = 0 THEN 'jaw' END, CASE WHEN k % 2 = 0 THEN 'lid' END, CASE WHEN k % 5 = 1 THEN 'lip' END]) AS action FROM vis v WHERE face_visible AND k % 5 <> 0",
    "ay": "SELECT person, win, action, count(*) AS hits, min(ord) AS o FROM ax WHERE action IS NOT NULL GROUP BY ALL",
    "az": "SELECT *, row_number() OVER (PARTITION BY person, win ORDER BY hits DESC, o, action) AS nth FROM ay",
    "an": "SELECT person, win, count(*) AS n FROM fa GROUP BY ALL",
    "aq": "SELECT az.person, az.win, count(*) AS n_codes FROM az JOIN an ON az.person = an.person AND az.win = an.win WHERE nth <= 3 AND hits >= greatest(1, n // 3) GROUP BY ALL",
    "w1": "SELECT w0.*, lighting, blur, coalesce(n_codes, 0) AS n_codes FROM w0 JOIN wl USING (person, win) JOIN wb USING (person, win) LEFT JOIN aq USING (person, win)",
    **_layers("wv0", "w1", [
        {f"{x}_level": r.ratio_bin(f"{x}_ratio") for x in ("device", "face", "mesh", "hand")}
        | {"local_level": r.motion_level("local_peak", "cast(0.035 as double)"), "global_level": r.motion_level("global_peak", "cast(0.05 as double)"), "blink": r.BLINK_WINDOW, "eye_level": r.eye_openness("mean_eyes"), "posture_state": "CASE WHEN n_faces = 0 THEN 'not_computed' WHEN n_close_faces > 0 THEN 'close_to_screen' ELSE 'visible_not_close' END", "several": "n_several > 0"},
        {"status": r.STATUS_V0, "region_level": f"CASE WHEN device_level IN {r.MEDIUM_UP} THEN local_level ELSE 'not_reliable' END", "base_confidence": r.BASE_CONFIDENCE, "gaze": r.GAZE_V0, "stable_screen": r.STABLE_V0},
        {"intensity": r.INTENSITY("local_level", "local_bursts"), "motion_pattern": r.MOTION_PATTERN("local_level", "local_bursts"), "confidence": r.CONFIDENCE_V0},
    ]),
    "c0": "SELECT person, win, window_order, position, n_frames, device_level, face_level, mesh_level, hand_level, lighting, blur, blink, eye_level, posture_state, several, local_level AS raw_local_level, global_level AS raw_global_level, local_bursts AS raw_local_bursts, global_bursts AS raw_global_bursts, confidence AS confidence_v0, n_codes, localized_peak, localized_bursts, near_hands, lower_hands FROM wv0",
    **_layers("wv2", "c0", [
        {"localized_level": r.motion_level("localized_peak", f"cast({w.LOCALIZED_THRESHOLD!r} as double)"), "near_level": r.ratio_bin("cast(near_hands as double) / n_frames")},
        {"dominance": r.DOMINANCE, "status": r.STATUS_V2, "region_level": r.REGION_V2},
        {"effective": r.EFFECTIVE, "global_level": r.EFFECTIVE, "local_level": "localized_level", "local_bursts": "localized_bursts"},
        {"stable_screen": r.STABLE_V2, "intensity": r.INTENSITY("localized_level", "localized_bursts"), "motion_pattern": r.MOTION_PATTERN("localized_level", "localized_bursts")},
        {"gaze": r.GAZE_V2, "confidence": r.CONFIDENCE_V2},
    ]),
    **_layers("st0", "wv2", r.STATES),
    "st": f"SELECT *, {r.ENGAGEMENT_SCORE} AS engagement_score FROM st0",
    "si": _islands("st", "lag(state) OVER o IS DISTINCT FROM state", "person", "window_order").replace("FROM st)", "FROM st WINDOW o AS (PARTITION BY person ORDER BY window_order))"),
    "be0": "SELECT person, island, min(state) AS state, count(*) AS n_windows, min(window_order) AS start, max(window_order) AS \"end\" FROM si GROUP BY person, island",
    **_mode("bec", "si", "person, island", "state_confidence", "window_order", "confidence"),
    "be": "SELECT *, printf('episode_%d_%02d', n_windows, start) AS episode_id FROM be0 JOIN bec USING (person, island)",
    "ts0": "SELECT *, count(*) OVER (PARTITION BY person) AS total, row_number() OVER (PARTITION BY person ORDER BY window_order) AS nth FROM st",
    "ts1": "SELECT person, count(*) AS n_windows, max(engagement_score) AS top_score, avg(CASE WHEN nth <= greatest(1, total // 3) THEN engagement_score END) AS early_mean, avg(CASE WHEN nth > total - greatest(1, total // 3) THEN engagement_score END) AS late_mean, count(DISTINCT concat_ws('|', state, observability, device_context, engagement, rhythm, posture, orientation, eyes, global_level, dominance)) AS n_signatures, " + _count({"n_confirmed": r.CONFIRMED, "n_possible": r.POSSIBLE, "n_passive": r.PASSIVE, "n_weak": r.WEAK, "n_stable": "device_context = 'stable_device_context'", "n_close": "posture LIKE 'close%'", "n_limited": "state = 'quality_limited_unobservable'", "n_engaged": "engagement_score >= 2"}) + " FROM ts0 GROUP BY person",
    "ts2": _longest("st", "window_order", {"longest_passive": r.PASSIVE, "longest_confirmed": r.CONFIRMED}),
    "ts3": "SELECT person, max(n_windows) AS longest_repeated FROM be0 GROUP BY person",
    **_mode("ts4", "st", "person", "state", "window_order", "session_state"),
    "ts5": "SELECT * FROM ts1 JOIN ts2 USING (person) JOIN ts3 USING (person) JOIN ts4 USING (person)",
    "ts": f"SELECT *, {r.TRAJECTORY} AS trajectory, {r.PATTERN} AS interaction_pattern FROM ts5",
    "dt": " UNION ALL ".join(f"SELECT person, '{n}' AS detector, '{role}' AS role, {s} AS strength, cast({k} AS bigint) AS n_windows FROM ts WHERE {c}" for n, role, c, s, k in r.DETECTORS),
    # events
    "x0": " UNION ALL ".join(f"SELECT person, window_order, confidence, '{n}' AS trigger, {p} AS priority FROM wv0 WHERE {c}" for n, p, c in r.EVENTS_V0),
    "x1": "SELECT *, row_number() OVER (PARTITION BY person, window_order ORDER BY priority) AS nth FROM x0",
    "x2": "SELECT *, row_number() OVER (PARTITION BY person ORDER BY priority, window_order) AS rk FROM x1 WHERE nth = 1 OR trigger = 'quality_drop'",
    "xv0": f"SELECT person, window_order, trigger, printf('Event_%02d', row_number() OVER (PARTITION BY person ORDER BY window_order, priority)) AS event_id, {r.EVIDENCE_ROLE} AS role FROM x2 WHERE rk <= 8",
    "y0": _layer("wv2", r.SCORES_V1),
    "y1": " UNION ALL ".join(f"SELECT person, window_order, confidence, '{n}' AS trigger, {p} AS priority, {s} AS score FROM y0 WHERE {c}" for n, p, c, s in r.EVENTS_V1),
    "ys": f"SELECT *, {r.SCORE_STRENGTH} AS strength, CASE {r.SCORE_STRENGTH} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS sp FROM y1",
    "y2": "SELECT *, row_number() OVER (PARTITION BY person, window_order ORDER BY sp, priority) AS nth FROM ys",
    "y3": "SELECT *, row_number() OVER (PARTITION BY person ORDER BY sp, priority, window_order) AS rk FROM y2 WHERE nth = 1",
    "yb": "SELECT *, row_number() OVER (PARTITION BY person ORDER BY sp, priority, window_order) AS rk, least(6, (SELECT count(DISTINCT window_order) FROM ys z WHERE z.person = y2.person)) AS chosen, (SELECT count(*) FROM y2 z WHERE z.person = y2.person AND z.nth = 1 AND (z.sp, z.priority, z.window_order) <= (y2.sp, y2.priority, y2.window_order)) AS place FROM y2",
    "xb1": "SELECT person, window_order, trigger, strength FROM yb WHERE CASE WHEN chosen < 5 THEN rk <= 5 ELSE nth = 1 AND place <= 6 END",
    "xv1": f"SELECT person, window_order, trigger, strength, printf('Event_%02d', row_number() OVER (PARTITION BY person ORDER BY window_order)) AS event_id, {r.EVIDENCE_ROLE} AS role FROM y3 WHERE rk <= 6",
}


def _interaction(source: str, first: bool) -> dict[str, str]:
    often = "local_bursts >= 2"
    counts = {"n_confirmed": f"status = 'detected' AND {often}", "n_possible": f"status IN ('detected', 'possible') AND {often}", "n_region": f"status IN ('not_reliable', 'device_region_motion_only') AND region_level IN {r.ACTIVE} AND {often}", "n_strong": f"status IN ('detected', 'possible') AND {often} AND (confidence = 'high' OR hand_level IN {r.MEDIUM_UP})"}
    k = source[-1]
    return {f"ia{k}_0": f"SELECT person, {_count(counts)} FROM {source} GROUP BY person", f"ia{k}": f"SELECT *, {r.INTENSITY_V1 if first else r.INTENSITY_V2} AS intensity, {r.REPETITION_V1 if first else r.REPETITION_V2} AS repetition FROM ia{k}_0"}


def _session(source: str) -> dict[str, str]:
    k = source[-1]
    counts = {
        "n_high": "global_level = 'high'", "n_active": f"global_level IN {r.ACTIVE}", "n_observable": OBSERVABLE, "n_observable_active": f"{OBSERVABLE} AND global_level IN {r.ACTIVE}", "n_observable_high": f"{OBSERVABLE} AND global_level = 'high'", "n_gaze": f"{OBSERVABLE} AND gaze",
        "n_values": "blink <> 'not_computed'", "n_closed": "blink = 'elevated_eye_closure'", "n_reduced": "blink = 'reduced_eye_openness'", "n_posture": "posture_state <> 'not_computed'", "n_close": "posture_state = 'close_to_screen'", "n_several": "several",
    }
    est = "orientation_v0 = 'estimated_from_visible_face_and_device'"
    return {
        f"se{k}_0": f"SELECT person, count(*) AS n_windows, {_count(counts)} FROM {source} GROUP BY person", f"se{k}_1": _longest(source, "window_order", {"longest_gaze": "gaze"}),
        f"se{k}_2": f"SELECT *, {r.CONFOUNDING(R)} AS confounding, {r.ORIENTATION_STATUS('n_observable_active', 0.5, R)} AS orientation_v0, {r.ORIENTATION_STATUS('n_observable_high', 0.75, R)} AS orientation_v1, {r.BLINK_V0} AS blink_v0, {r.BLINK_V1(R)} AS blink_v1, {r.POSTURE_TREND} AS posture_trend, {r.count_level('(n_closed + n_reduced)')} AS closure_level FROM se{k}_0 JOIN se{k}_1 USING (person)",
        f"se{k}_3": f"SELECT *, CASE WHEN {est} THEN {safe_ratio('n_gaze', 'n_observable', R)} END AS gaze_ratio, CASE WHEN {est} THEN longest_gaze * 5 END AS gaze_minutes FROM se{k}_2",
        f"se{k}": f"SELECT *, CASE WHEN {est} THEN {r.ratio_bin('gaze_ratio')} END AS gaze_bin, {r.continuous_duration('gaze_minutes')} AS gaze_duration FROM se{k}_3",
    }


CTES |= _interaction("wv0", True) | _interaction("wv2", False) | _session("wv0") | _session("wv2")
CTES |= {
    "ne0": "SELECT p.person, orientation_v1, confounding, n_confirmed, n_strong, any_stable, hand_share, coalesce(n_events, 0) AS n_events, coalesce(n_strong_events, 0) AS n_strong_events FROM se2 p JOIN ia2 USING (person) JOIN (SELECT person, bool_or(stable_screen) AS any_stable, count_if(hand_level <> 'none') / count(*) AS hand_share FROM wv2 GROUP BY person) USING (person) LEFT JOIN (SELECT person, count(*) AS n_events, count_if(strength = 'high') AS n_strong_events FROM xv1 GROUP BY person) USING (person)",
    "ne": f"SELECT person, concat_ws(';', CASE WHEN n_events = 0 THEN 'no_event_windows_passed_v1_thresholds' END, CASE WHEN n_confirmed = 0 THEN 'no_confirmed_hand_device_interaction_proxy' END, CASE WHEN n_strong = 0 THEN 'no_strong_repetitive_operation_proxy' END, CASE WHEN orientation_v1 <> 'estimated_from_visible_face_and_device' THEN 'no_reliable_sustained_screen_orientation_proxy' END, CASE WHEN hand_share < 0.5 THEN 'hand_visibility_limits_touch_interaction_evidence' END, CASE WHEN confounding IN {r.ACTIVE} THEN 'global_motion_limits_behavior_interpretation' END, CASE WHEN NOT any_stable THEN 'no_stable_screen_context_window_observed' END) AS negatives, CASE WHEN n_events = 0 THEN 'no_selected_behavior_events' WHEN n_strong_events = 0 AND n_confirmed = 0 AND orientation_v1 <> 'estimated_from_visible_face_and_device' THEN 'weak_or_confounded_proxy_evidence' WHEN confounding IN {r.ACTIVE} THEN 'behavior_proxy_present_but_motion_confounded' WHEN n_strong_events >= 2 THEN 'multiple_stronger_proxy_events' ELSE 'limited_proxy_evidence' END AS balance FROM ne0",
}


_s = {k: "'" + v.replace("'", "''") + "'" for k, v in narratives.SENTENCES.items()}
_pick = lambda column, table: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items() if k) + f" ELSE '{table['']}' END"
_swift = "trigger IN ('device_interaction_evidence', 'device_region_motion_proxy') AND motion_pattern"
CTES |= {
    "en0": "SELECT xv0.person, xv0.window_order, trigger, status, motion_pattern, device_level, posture_state, global_level, local_level, local_bursts, gaze, mesh_level, eye_level, blink, n_codes, global_level IN ('elevated', 'high') AS broad, device_level IN ('medium', 'high', 'very_high') AS seen FROM xv0 JOIN wv0 ON wv0.person = xv0.person AND wv0.window_order = xv0.window_order",
    "en": f"SELECT person, window_order, trigger, CASE status WHEN 'detected' THEN CASE WHEN {_swift} = 'rapid_repetitive_local_motion' THEN {_s['detected_rapid']} ELSE {_s['detected']} END WHEN 'possible' THEN CASE WHEN {_swift} = 'rapid_repetitive_local_motion' THEN {_s['possible_rapid']} ELSE {_s['possible']} END "
    f"ELSE CASE WHEN status = 'not_reliable' AND seen THEN CASE WHEN {_swift} = 'rapid_repetitive_local_motion' THEN {_s['region_rapid']} WHEN {_swift} = 'intermittent_local_motion' THEN {_s['region_intermittent']} ELSE {_s['region']} END ELSE CASE trigger WHEN 'stable_screen_context' THEN {_s['stable_screen_context']} WHEN 'sustained_screen_oriented_proxy' THEN {_s['sustained_screen_oriented_proxy']} WHEN 'motion_confounding' THEN {_s['motion_confounding']} WHEN 'quality_drop' THEN {_s['quality_drop']} ELSE {_s['no_interaction']} END END END AS interaction, "
    f"CASE posture_state WHEN 'close_to_screen' THEN CASE WHEN broad THEN {_s['close_moving']} ELSE {_s['close']} END WHEN 'visible_not_close' THEN {_s['not_close']} ELSE {_s['no_posture']} END AS posture, CASE WHEN gaze THEN {_s['screen']} WHEN seen THEN {_s['screen_unsure']} ELSE {_s['no_screen']} END AS screen_orientation, "
    f"CASE WHEN local_level = 'high' AND local_bursts >= 2 THEN CASE WHEN broad THEN {_s['motion_both']} ELSE {_s['motion_bursts']} END WHEN local_level IN ('elevated', 'high') THEN {_s['motion_local']} WHEN broad THEN {_s['motion_global']} ELSE {_s['no_motion']} END AS motion_context, "
    f"CASE WHEN mesh_level = 'none' THEN {_s['no_face']} ELSE {_pick('eye_level', narratives.EYES)} || '; ' || {_pick('blink', narratives.BLINKS)} || '; ' || CASE WHEN n_codes > 0 THEN '{narratives.ACTIONS[0]}' ELSE '{narratives.ACTIONS[1]}' END || '.' END AS facial_cues FROM en0",
}


def sql(final: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items()) + "\n" + final


# name: (table maker, columns, SQL table); columns named a=b are b in SQL
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _frames(s, d):
    return legacy_frames(_events(s, d))


def _v0(s, d):
    return w.window_summary(active_frames(_events(s, d)))


def _v2(s, d):
    return w.calibrated(_v0(s, d))


def _states(s, d):
    return w.window_states(_v2(s, d))


W0 = "person window window_order position n_frames"
SPECS: dict[str, tuple] = {
    "frame_adapter": (_frames, "person ord n clip position quality_usable device_visible hand_visible hand_near face_visible face_context global_motion near_motion hand_motion pose_motion", "fr"),
    "adaptive_thresholds": (lambda s, d: t.thresholds(_frames(s, d)), "person t_global t_near t_hand t_pose", "th"),
    "frame_flags": (lambda s, d: t.flags(_frames(s, d)), "person ord global_burst region_activity hand_burst direct posture confounded unconfounded active stable", "fg"),
    "frame_states": (lambda s, d: t.flags(_frames(s, d)), "person ord state=own_state", "fs"),
    "repetitive_runs": (lambda s, d: t.points(_frames(s, d)), "person clip ord active repetitive state", "pt"),
    "episode_candidates": (lambda s, d: t.episodes(_frames(s, d)), "person state clip start end n_points position", "ep"),
    "episode_metrics": (lambda s, d: t.episodes(_frames(s, d)), "person start " + " ".join(t.COUNTED) + " score confidence support duration", "ep"),
    "episode_selection": (lambda s, d: t.selected_episodes(t.episodes(_frames(s, d))), "person step start state transition reason", "sel"),
    "sequence_summary": (lambda s, d: t.sequence_summary(_frames(s, d)), "person n n_episodes p_stable p_active p_direct p_repetitive p_confounded p_unconfounded p_visible_only e_stable e_active e_repetitive e_confounded e_indirect e_device_only valid_ratio quality signal pattern", "ss"),
    "signal_strength": (lambda s, d: t.sequence_summary(_frames(s, d)), "person quality signal", "ss"),
    "main_pattern": (lambda s, d: t.sequence_summary(_frames(s, d)), "person pattern", "ss"),
    "frame_quality": (lambda s, d: t.quality(_frames(s, d)), "person valid_ratio device_ratio longest_stable quality longest_stable_bin", "ql"),
    "phase_counts": (lambda s, d: t.phase_counts(t.selected_episodes(t.episodes(_frames(s, d)))), "person " + " ".join(f"{b}_{p}" for b in ("risk", "engagement", "background") for p in ("early", "middle", "late")), "ph"),
    "trace_score": (lambda s, d: t.trace_summary(_frames(s, d)), "person " + " ".join(r.TRACE_PARTS) + " trace_score strength ordinary", "tr"),
    "window_summary": (lambda s, d: _v0(s, d), f"{W0} device_ratio face_ratio hand_ratio mesh_ratio device_level face_level mesh_level hand_level lighting blur local_level global_level local_bursts global_bursts blink eye_level posture_state", "wv0"),
    "interaction_status_v0": (lambda s, d: _v0(s, d), "person window status intensity motion_pattern region_level", "wv0"),
    "event_confidence": (lambda s, d: _v0(s, d), "person window base_confidence confidence gaze stable_screen", "wv0"),
    "localized_motion": (lambda s, d: _v2(s, d), "person window localized_level localized_bursts near_level near_hands lower_hands", "wv2"),
    "motion_dominance": (lambda s, d: _v2(s, d), "person window dominance effective", "wv2"),
    "interaction_status_v2": (lambda s, d: _v2(s, d), "person window status region_level intensity motion_pattern stable_screen gaze confidence", "wv2"),
    "window_states": (_states, "person window_order state observability device_context engagement rhythm posture orientation eyes state_confidence engagement_score", "st"),
    "behavior_episodes": (lambda s, d: w.behavior_episodes(_states(s, d)), "person episode_id state n_windows start end confidence", "be"),
    "state_signatures": (lambda s, d: w.temporal_summary(_states(s, d)), "person n_windows n_signatures", "ts"),
    "longest_streaks": (lambda s, d: w.temporal_summary(_states(s, d)), "person longest_passive longest_confirmed longest_repeated", "ts"),
    "trajectory": (lambda s, d: w.temporal_summary(_states(s, d)), "person top_score early_mean late_mean n_engaged trajectory", "ts"),
    "interaction_pattern": (lambda s, d: w.temporal_summary(_states(s, d)), "person n_confirmed n_possible n_passive n_weak n_stable n_close n_limited interaction_pattern", "ts"),
    "dominant_state_first_seen": (lambda s, d: w.temporal_summary(_states(s, d)), "person session_state", "ts"),
    "episode_detectors": (lambda s, d: w.episode_detectors(w.temporal_summary(_states(s, d))), "person detector role strength n_windows", "dt"),
    "events_v0": (lambda s, d: w.events_v0(_v0(s, d)), "person window_order trigger event_id role", "xv0"),
    "events_v1_scores": (lambda s, d: w.event_scores(_v2(s, d)).withColumn("score", F.expr(py_round("score", 4))), f"person window_order trigger strength score={py_round('score', 4, R)}", "ys"),
    "events_v1_selected": (lambda s, d: w.events_v1(_v2(s, d)), "person window_order trigger strength event_id role", "xv1"),
    "events_v1_backfilled": (lambda s, d: w.events_v1(_v2(s, d), least=5), "person window_order trigger strength", "xb1"),
    "event_narratives": (lambda s, d: narratives.event_narratives(w.events_v0(_v0(s, d)).select("person", "window_order", "trigger"), _v0(s, d)), "person window_order trigger interaction posture screen_orientation motion_context facial_cues", "en"),
    "interaction_summary_v1": (lambda s, d: w.interaction_summary(_v0(s, d), 1), "person n_confirmed n_possible n_region n_strong intensity repetition", "ia0"),
    "interaction_summary_v2": (lambda s, d: w.interaction_summary(_v2(s, d), 2), "person n_confirmed n_possible n_region n_strong intensity repetition", "ia2"),
    "motion_confounding": (lambda s, d: w.session_summary(_v2(s, d)), "person n_windows n_high n_active confounding", "se2"),
    "orientation_summary": (lambda s, d: w.session_summary(_v0(s, d)), "person n_observable orientation_v0 orientation_v1 gaze_ratio gaze_bin gaze_minutes gaze_duration", "se0"),
    "blink_summary": (lambda s, d: w.session_summary(_v0(s, d)), "person n_values n_closed n_reduced blink_v0 blink_v1 closure_level", "se0"),
    "posture_trend": (lambda s, d: w.session_summary(_v0(s, d)), "person n_posture n_close n_several posture_trend", "se0"),
    "negative_evidence": (lambda s, d: w.negative_evidence(_v2(s, d), w.events_v1(_v2(s, d))), "person negatives balance", "ne"),
}


def _query(make, columns: str):
    names = [c.split("=")[0] for c in columns.split(" ") if c]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(spark, sf_dir).select(*names)
        return df.select(*[F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])

    return run


def _oracle(columns: str, table: str) -> str:
    parts = columns.split(" ")
    out = []
    for k, c in enumerate(parts):
        name, eq, value = c.partition("=")
        if eq:
            return sql(f"SELECT {', '.join(out)}, {' '.join([value, *parts[k + 1 :]])} AS {name} FROM {table}")
        out.append('win::bigint AS "window"' if c == "window" else '"end"' if c == "end" else c)
    return sql(f"SELECT {', '.join(out)} FROM {table}")


QUERIES = {}
ORACLE = {}
for _name, (_make, _columns, _table) in SPECS.items():
    _head = _columns.split("=")[0] if "=" in _columns else _columns
    QUERIES[_name] = _query(_make, _head)
    ORACLE[_name] = _oracle(_columns, _table)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to frames, adaptive thresholds, states, runs, episodes and one summary for each person."""
    return QUERIES["sequence_summary"](spark, sf_dir)
