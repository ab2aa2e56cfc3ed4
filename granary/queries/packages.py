"""Queries over evidence records, payload probes and legacy features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.core import rules as r
from granary.core.numbers import ORACLE_RINT, py_round, safe_ratio
from granary.operators import package, temporal, windows
from granary.plans import extractors
from granary.queries.evidence import STABLE_1, sql
from granary.sources.events import active_frames, legacy_frames
from granary.sources.files import json_probe

R = ORACLE_RINT


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


def _records(s, d):
    return extractors.build("windows_v2")(_events(s, d))


def evidence_fact_counts(s, d):
    f = F.col("evidence.facts")
    return _records(s, d).select("sample_id", *[F.size(f[k]).cast("long").alias(f"n_{k}") for k in ("positive", "weak", "counter", "limits", "auxiliary")], F.array_join(f["positive"], " ").alias("positive"), F.array_join(f["counter"], " ").alias("counter"))


def evidence_package(s, d):
    df = package.validation_errors(_records(s, d))
    g = F.col("evidence.global_features")
    return df.select("sample_id", F.size("errors").cast("long").alias("n_errors"), F.col("evidence.session_metadata.session_id").alias("session_id"), F.col("evidence.session_metadata.duration_bin").alias("duration_bin"), F.col("evidence.session_metadata.n_events").cast("long").alias("n_events"), g["interaction_intensity"].alias("intensity"), g["trajectory"].alias("trajectory"), g["session_state"].alias("session_state"), F.col("evidence.quality_summary.sufficiency").alias("sufficiency"))


def offline_scores(s, d):
    df = package.scored(_records(s, d).withColumn("messages", package.messages()))
    return df.select("sample_id", F.get_json_object("response", "$.risk_level").alias("level"), F.size("messages").cast("long").alias("n_messages"), "error")


def payload_probe(s, d):
    text = F.expr("CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ',', props, ']') WHEN 2 THEN '[]' WHEN 3 THEN '{broken' WHEN 4 THEN '\"\"' END")
    df = json_probe(_events(s, d).withColumn("payload", text), "payload", ("k",))
    return df.select("event_id", "status", "kind", F.col("records").cast("long").alias("records"), F.col("fields").cast("long").alias("fields"), "empty", F.array_join("keys", ",").alias("keys"), F.size("sensitive_keys").cast("long").alias("n_sensitive"), "sha256")


def events_legacy_quota(s, d):
    return temporal.legacy_events(legacy_frames(_events(s, d))).select("person", "ord", "kind", F.col("rank").cast("long").alias("rank"))


def legacy_frame_features(s, d):
    df = temporal.flags(legacy_frames(_events(s, d))).withColumn("stable_1", F.expr(STABLE_1))
    share = lambda c: F.expr(safe_ratio(f"count_if({c})", "count(1)"))
    df = df.groupBy("person").agg(*[share(c).alias(k) for k, c in LEGACY_SHARES.items()], *[F.count_if(F.expr(c)).alias(k) for k, c in LEGACY_COUNTS.items()], F.expr(py_round("avg(global_motion)", 3)).alias("mean_motion"))
    return df.withColumns({"stable_bin": F.expr(r.legacy_ratio_bin("stable_ratio")), "region_bin": F.expr(r.activity_ratio_bin("region_ratio")), "repetition_bin": F.expr(r.count_bin("n_repetition")), "motion_bin": F.expr(r.level_bin("mean_motion", "4.0", "12.0", "24.0"))})


LEGACY_SHARES = {"valid_ratio": "quality_usable", "device_ratio": "device_visible", "hand_ratio": "hand_visible", "near_ratio": "hand_near", "face_ratio": "face_visible", "stable_ratio": "stable_1", "active_ratio": "hand_near OR region_activity", "region_ratio": "region_activity"}
LEGACY_COUNTS = {"n_repetition": "hand_near AND hand_burst", "n_region": "region_activity", "n_posture": "posture"}


def trace_levels(s, d):
    cols = ("device_observability", "stable_burden", "active_density", "direct_density", "repetition_density", "visible_only_context", "confounding_level", "phase_consistency")
    return temporal.trace_summary(legacy_frames(_events(s, d))).select("person", *cols)


def evidence_roles(s, d):
    w = windows.calibrated(windows.window_summary(active_frames(_events(s, d))))
    return windows.events_v1(w).groupBy("role", "trigger").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "evidence_fact_counts": evidence_fact_counts, "evidence_package": evidence_package, "offline_scores": offline_scores, "payload_probe": payload_probe, "events_legacy_quota": events_legacy_quota,
    "legacy_frame_features": legacy_frame_features, "trace_levels": trace_levels, "evidence_roles": evidence_roles,
}

_det = lambda role: f"(SELECT string_agg(detector || ' held over ' || n_windows || ' windows (' || strength || ').', ' ' ORDER BY detector) FROM dt WHERE dt.person = ts.person AND role = '{role}')"
_ndet = lambda role: f"(SELECT count(*) FROM dt WHERE dt.person = ts.person AND role = '{role}')"
_nev = lambda t: f"(SELECT count(*) FROM xv1 WHERE xv1.person = ts.person AND trigger = '{t}')"
KIND = "CASE WHEN hand_near AND hand_burst THEN 'hand_device_interaction_burst' WHEN hand_near OR region_activity THEN 'device_region_motion_burst' WHEN posture THEN 'posture_or_context_motion_burst' WHEN global_burst THEN 'global_motion_burst' END"
ALIAS = "('ANON_' || upper(left(sha256('granary:' || {}::varchar), 10)))"
ORACLE = {
    "evidence_fact_counts": sql(
        f"SELECT {ALIAS.format('person')} AS sample_id, (n_confirmed > 0)::bigint + ({_nev('device_interaction_evidence')} > 0)::bigint + {_ndet('strong_behavior_evidence')} AS n_positive, (n_possible > 0)::bigint + (n_passive > 0)::bigint + (n_weak > 0)::bigint + {_ndet('weak_proxy_evidence')} AS n_weak, (n_confirmed = 0)::bigint + {_ndet('counter_evidence')} AS n_counter, (n_limited > 0)::bigint + ({_nev('quality_drop')} > 0)::bigint AS n_limits, (n_close > 0)::bigint + ({_nev('facial_au_trend')} > 0)::bigint + ({_nev('blink_rate_change')} > 0)::bigint AS n_auxiliary, "
        f"concat_ws(' ', CASE WHEN n_confirmed > 0 THEN 'Hand and device moved together in ' || n_confirmed || ' windows.' END, CASE WHEN {_nev('device_interaction_evidence')} > 0 THEN {_nev('device_interaction_evidence')} || ' selected events show interaction.' END, {_det('strong_behavior_evidence')}) AS positive, concat_ws(' ', CASE WHEN n_confirmed = 0 THEN 'No window confirms interaction.' END, {_det('counter_evidence')}) AS counter FROM ts"
    ),
    "evidence_package": sql(
        f"SELECT {ALIAS.format('ts.person')} AS sample_id, 0::bigint AS n_errors, {ALIAS.format('ts.person')} AS session_id, {r.duration_minutes('(ts.n_windows * 300)')} AS duration_bin, {_nev('device_interaction_evidence').replace(chr(39) + 'device_interaction_evidence' + chr(39), 'trigger')} AS n_events, intensity, trajectory, session_state, {r.sufficiency('ts.n_windows', '(cast(ts.n_windows - n_limited as double) / ts.n_windows)')} AS sufficiency FROM ts JOIN ia2 ON ia2.person = ts.person"
    ),
    "offline_scores": sql(f"SELECT {ALIAS.format('person')} AS sample_id, CASE intensity WHEN 'high' THEN 'moderate_risk' WHEN 'elevated' THEN 'mild_risk' ELSE 'no_observed_risk' END AS level, 2::bigint AS n_messages, NULL::varchar AS error FROM ia2"),
    "payload_probe": """WITH p AS (SELECT event_id, props, event_id % 6 AS m, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '[' || props || ',' || props || ']' WHEN 2 THEN '[]' WHEN 3 THEN '{broken' WHEN 4 THEN '""' END AS payload FROM events)
SELECT event_id, CASE WHEN m = 5 THEN 'missing' WHEN m = 3 THEN 'invalid_json' ELSE 'ok' END AS status, CASE WHEN m = 0 THEN 'object' WHEN m IN (1, 2) THEN 'list' WHEN m = 4 THEN 'scalar' END AS kind, CASE WHEN m IN (1, 2) THEN json_array_length(CASE WHEN m IN (1, 2) THEN payload ELSE '[]' END)::bigint END AS records, CASE WHEN m = 0 THEN len(json_keys(props)) END AS fields,
  CASE m WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true WHEN 4 THEN true END AS empty, CASE WHEN m IN (0, 1) THEN array_to_string(list_sort(json_keys(props)), ',') ELSE '' END AS keys, CASE WHEN m IN (0, 1) THEN 1 ELSE 0 END::bigint AS n_sensitive, sha256(payload) AS sha256 FROM p""",
    "events_legacy_quota": sql(
        f"SELECT person, ord, kind, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, ord) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY person, kind ORDER BY score DESC, ord) AS nth FROM (SELECT person, ord, kind, CASE kind WHEN 'hand_device_interaction_burst' THEN hand_motion * 100 WHEN 'device_region_motion_burst' THEN CASE WHEN coalesce(near_motion, 0) = 0 THEN t_near ELSE near_motion END WHEN 'posture_or_context_motion_burst' THEN pose_motion * 100 + global_motion ELSE global_motion END AS score FROM (SELECT *, {KIND} AS kind FROM fg) WHERE kind IS NOT NULL "
        f"UNION ALL SELECT person, count(*), 'stable_screen_engagement_proxy', count_if({STABLE_1})::double FROM fg GROUP BY person HAVING count_if({STABLE_1}) > 0)) WHERE nth <= CASE kind WHEN 'hand_device_interaction_burst' THEN 4 WHEN 'device_region_motion_burst' THEN 5 WHEN 'stable_screen_engagement_proxy' THEN 1 ELSE 2 END) WHERE rk <= 8"
    ),
    "legacy_frame_features": sql(
        f"SELECT *, {r.legacy_ratio_bin('stable_ratio')} AS stable_bin, {r.activity_ratio_bin('region_ratio')} AS region_bin, {r.count_bin('n_repetition')} AS repetition_bin, {r.level_bin('mean_motion', '4.0', '12.0', '24.0')} AS motion_bin FROM (SELECT person, {', '.join(f'{safe_ratio(f"count_if({c})", "count(*)", R)} AS {k}' for k, c in (LEGACY_SHARES | {'stable_ratio': STABLE_1}).items())}, {', '.join(f'coalesce(count_if({c}), 0)::bigint AS {k}' for k, c in LEGACY_COUNTS.items())}, {py_round('avg(global_motion)', 3, R)} AS mean_motion FROM fg GROUP BY person)"
    ),
    "trace_levels": sql(f"SELECT person, {r.share_level('device_ratio')} AS device_observability, {r.share_level('(p_stable / n)')} AS stable_burden, {r.activity_level('(p_active / n)')} AS active_density, {r.point_level('p_direct')} AS direct_density, {r.point_level('p_repetitive')} AS repetition_density, {r.share_level('(p_visible_only / n)')} AS visible_only_context, {r.activity_level('(p_confounded / n)')} AS confounding_level, {r.phase_level('risk_phases')} AS phase_consistency FROM tr"),
    "evidence_roles": sql("SELECT role, trigger, count(*) AS n FROM xv1 GROUP BY ALL"),
}
