"""Bins and decision tables as SQL expressions over column names.

Cut-points and vocabularies are fixed values.
"""

from __future__ import annotations

from granary.core.numbers import SPARK_RINT, case, labels, py_round, safe_ratio, text

MEDIUM_UP = "('medium', 'high', 'very_high')"
HIGH_UP = "('high', 'very_high')"
LOW_UP = "('low', 'medium', 'high', 'very_high')"
ACTIVE = "('elevated', 'high')"
POOR = "('low', 'very_low')"
BURSTS_REPEATED = 2
LOCAL_THRESHOLD, GLOBAL_THRESHOLD = 0.035, 0.05

# bins
ratio_bin = lambda x: labels(x, [(">= 0.9", "very_high"), (">= 0.75", "high"), (">= 0.5", "medium"), ("> 0", "low")], "none")
legacy_ratio_bin = lambda x: labels(x, [("<= 0", "none"), ("< 0.25", "low"), ("< 0.6", "medium"), ("< 0.85", "high")], "very_high", "unknown")
count_level = lambda x: labels(x, [(">= 5", "high"), (">= 2", "medium"), ("= 1", "low")], "none")
count_bin = lambda x: labels(x, [("<= 0", "none"), ("<= 2", "low"), ("<= 6", "medium")], "high")
activity_ratio_bin = lambda x: labels(x, [("<= 0", "none"), ("< 0.05", "low"), ("< 0.15", "medium"), ("< 0.3", "high")], "very_high", "unknown")
level_bin = lambda x, low, medium, high: labels(x, [(f"< {low}", "low"), (f"< {medium}", "medium"), (f"< {high}", "high")], "elevated", "unknown")
motion_level = lambda x, t: labels(x, [(f">= {t} * 2", "high"), (f">= {t}", "elevated"), ("> 0", "low")], "none")
lighting = lambda x: case((f"{x} BETWEEN 45 AND 220", "'sufficient'"), (f"{x} BETWEEN 25 AND 240", "'low'"), default="'very_low'")
blur = lambda x: labels(x, [(">= 80", "sufficient"), (">= 30", "low")], "very_low")
clip_duration = lambda x: labels(x, [("< 10", "<10s"), ("< 30", "10-30s"), ("< 90", "30-90s")], ">=90s", "unknown")
duration_minutes = lambda s: labels(f"{s} / 60.0", [("<= 0", "unknown"), ("< 5", "<5min"), ("< 10", "5-10min"), ("< 20", "10-20min"), ("< 30", "20-30min"), ("< 45", "30-45min")], ">=45min", "unknown")
coarse_minutes = lambda s, rint=SPARK_RINT: case((f"{s} > 0", f"cast({rint.format(f'{s} / 60.0 / 5.0')} * 5 as bigint)"))
continuous_duration = lambda m: labels(m, [("<= 0", "none"), ("< 5", "short"), ("< 15", "medium")], "long", "not_computed")
resolution = lambda w, h: case((f"coalesce({w}, 0) = 0 OR coalesce({h}, 0) = 0", "'unknown'"), (f"{w} * {h} < 640 * 480", "'below_vga'"), (f"{w} * {h} < 1280 * 720", "'vga_to_720p'"), (f"{w} * {h} < 1920 * 1080", "'720p_to_1080p'"), default="'1080p_or_above'")
fps = lambda x: case((f"coalesce({x}, 0) <= 0", "'unknown'"), (f"{x} < 15", "'<15fps'"), (f"{x} < 24", "'15-24fps'"), (f"{x} <= 30", "'24-30fps'"), default="'>30fps'")
size_mb = lambda x: labels(x, [("< 5", "<5MB"), ("< 20", "5-20MB"), ("< 50", "20-50MB")], ">=50MB", "unknown")
face_size = lambda x: labels(x, [(">= 0.18", "very_close"), (">= 0.08", "close"), (">= 0.03", "visible")], "small")
eye_openness = lambda x: labels(x, [("< 0.18", "low"), ("< 0.23", "reduced")], "open", "not_computed")
audit_count = lambda x: labels(x, [("= 0", "0"), ("= 1", "1"), ("<= 3", "2-3"), ("<= 5", "4-5"), ("<= 10", "6-10"), ("<= 30", "11-30"), ("<= 60", "31-60")], "61+")
audit_seconds = lambda x: labels(x, [("<= 0", "0"), ("< 30", "<30s"), ("< 60", "30-60s"), ("< 180", "1-3min"), ("< 300", "3-5min"), ("< 600", "5-10min"), ("< 1800", "10-30min")], "30min+", "unknown")
audit_ratio = lambda x: labels(x, [("< 0.25", "<25%"), ("< 0.5", "25-50%"), ("< 0.75", "50-75%"), ("< 0.9", "75-90%")], "90-100%", "unknown")
audit_bpm = lambda x: labels(x, [("< 60", "<60"), ("< 80", "60-79"), ("< 100", "80-99"), ("< 120", "100-119")], "120+", "unknown")
share_range = lambda x: labels(x, [("<= 0", "0%"), ("< 0.05", "<5%"), ("< 0.25", "5-25%"), ("< 0.6", "25-60%"), ("< 0.85", "60-85%")], "85-100%", "unknown")
episode_duration = lambda x: labels(x, [("<= 0", "none"), ("<= 2", "very_short"), ("<= 6", "short"), ("<= 18", "medium")], "long")
share_level = lambda x: labels(x, [("<= 0", "none"), ("< 0.1", "very_low"), ("< 0.25", "low"), ("< 0.5", "medium"), ("< 0.75", "high")], "very_high", "unknown")
activity_level = lambda x: labels(x, [("<= 0", "none"), ("< 0.03", "very_low"), ("< 0.08", "low"), ("< 0.16", "medium")], "high", "unknown")
point_level = lambda x: labels(x, [("<= 0", "none"), ("<= 2", "low"), ("<= 6", "medium")], "high")
phase_level = lambda x: labels(x, [("<= 0", "none"), ("= 1", "single_phase"), ("= 2", "multi_phase")], "all_phases")
sufficiency = lambda n, ratio: case((f"{n} = 0", "'insufficient_no_readable_video'"), (f"{ratio} >= 0.8", "'adequate_for_frame_proxy_analysis'"), (f"{ratio} >= 0.5", "'partial_for_frame_proxy_analysis'"), default="'low_for_frame_proxy_analysis'")


def position(index: str, total: str, alone: str = "global") -> str:
    """Third of a sequence in which the 0-based index lies."""
    return case((f"{total} <= 1", text(alone)), (f"cast({index} as double) / ({total} - 1) < cast(1 as double) / 3", "'early'"), (f"cast({index} as double) / ({total} - 1) < cast(2 as double) / 3", "'middle'"), default="'late'")


# legacy frames
FRAME_FLAGS = [
    {
        "global_burst": "coalesce(global_motion >= t_global, false)",
        "region_activity": "device_visible AND coalesce(near_motion >= t_near, false)",
        "hand_burst": "coalesce(hand_motion >= t_hand, false)",
        "pose_burst": "coalesce(pose_motion >= t_pose, false)",
    },
    {
        "direct": "quality_usable AND device_visible AND hand_near AND hand_burst",
        "posture": "pose_burst AND global_burst",
        "confounded": "region_activity AND global_burst",
        "unconfounded": "region_activity AND NOT global_burst",
    },
    {"active": "direct OR (quality_usable AND hand_near AND unconfounded)"},
    {"stable": "device_visible AND quality_usable AND NOT global_burst AND NOT active AND (face_context OR hand_near)"},
]
FRAME_STATE = case(
    ("NOT quality_usable", "'insufficient_quality'"),
    ("NOT device_visible AND (posture OR global_burst)", "'posture_or_context_motion'"),
    ("NOT device_visible", "'no_device_observed'"),
    ("active", "'active_hand_device_operation'"),
    ("confounded", "'confounded_device_region_activity'"),
    ("unconfounded", "'indirect_device_region_activity'"),
    ("stable", "'passive_screen_engagement'"),
    default="'device_visible_only'",
)
BACKGROUND = "('device_visible_only', 'no_device_observed', 'insufficient_quality', 'transition_or_uncertain')"
STATE_PRIORITY = {
    "repetitive_operation": 90, "active_hand_device_operation": 80, "passive_screen_engagement": 70, "indirect_device_region_activity": 55, "confounded_device_region_activity": 45,
    "device_visible_only": 40, "posture_or_context_motion": 30, "no_device_observed": 20, "insufficient_quality": 10, "transition_or_uncertain": 0,
}
EPISODE_SCORE = case(*((f"state = {text(s)}", str(p)) for s, p in STATE_PRIORITY.items()), default="0") + " + n_points * cast(0.3 as double) + n_stable * cast(0.5 as double) + n_active * cast(1.0 as double) + n_repetitive * cast(1.5 as double) + n_confounded * cast(0.4 as double)"
EPISODE_CONFIDENCE = case(
    ("n_usable < 0.5 * n_points", "'low'"),
    ("state IN ('confounded_device_region_activity', 'transition_or_uncertain', 'insufficient_quality')", "'low'"),
    ("state IN ('active_hand_device_operation', 'repetitive_operation') AND (n_direct >= 3 OR n_active >= 4)", "'medium'"),
    ("state IN ('active_hand_device_operation', 'repetitive_operation')", "'low'"),
    ("state = 'passive_screen_engagement' AND n_stable < 3", "'low'"),
    default="'medium'",
)
EPISODE_SUPPORT = case(
    ("state = 'repetitive_operation' AND n_repetitive >= 3", "'strong_operation_proxy'"),
    ("state = 'active_hand_device_operation' AND n_active >= 0.5 * n_points", "'moderate_operation_proxy'"),
    ("state = 'passive_screen_engagement' AND n_stable >= 0.5 * n_points", "'moderate_engagement_proxy'"),
    ("state = 'confounded_device_region_activity' AND n_confounded > 0", "'counter_evidence_or_confounder'"),
    ("state = 'indirect_device_region_activity'", "'weak_indirect_activity_proxy'"),
    (f"state IN {BACKGROUND}", "'background_or_absence_context'"),
    default="'weak_or_uncertain_proxy'",
)
SELECTION_REASON = case(
    ("state IN ('active_hand_device_operation', 'repetitive_operation')", "'selected_as_direct_or_repetitive_operation_episode'"),
    ("state = 'passive_screen_engagement'", "'selected_as_stable_screen_engagement_episode'"),
    ("state = 'confounded_device_region_activity'", "'selected_as_motion_confounder_episode'"),
    ("state = 'indirect_device_region_activity'", "'selected_as_indirect_device_activity_episode'"),
    default="'selected_as_background_or_quality_context_episode'",
)
FRAME_QUALITY = lambda ratio: case((f"{ratio} >= 0.7", "'usable_behavior_frame_quality'"), (f"{ratio} >= 0.4", "'partial_behavior_frame_quality'"), default="'low_behavior_frame_quality'")
HEAVY = "(p_confounded / n >= 0.2 OR e_confounded >= 3)"
SIGNAL_STRENGTH = case(
    ("quality <> 'usable_behavior_frame_quality'", "'insufficient_video_proxy_signal'"),
    (f"p_stable / n >= 0.4 AND p_active / n >= 0.12 AND e_repetitive >= 1 AND p_repetitive >= 3 AND NOT {HEAVY}", "'strong_video_proxy_signal'"),
    (f"p_stable / n >= 0.3 AND (p_active / n >= 0.08 OR p_direct >= 6) AND e_active >= 1 AND NOT {HEAVY}", "'moderate_video_proxy_signal'"),
    ("e_stable >= 1 AND e_active >= 1 AND p_active >= 4 AND e_confounded <= 2", "'mild_video_proxy_signal'"),
    ("p_stable / n >= 0.15 AND e_stable >= 1", "'mild_video_proxy_signal'"),
    ("e_indirect >= 2 AND e_confounded <= 1", "'mild_video_proxy_signal'"),
    default="'weak_video_proxy_signal'",
)
MAIN_PATTERN = case(
    ("p_confounded / n >= 0.25", "'motion_confounded_device_region_activity'"),
    ("p_repetitive >= 3", "'repetitive_operation_observed'"),
    ("p_active / n >= 0.08", "'active_operation_observed'"),
    ("p_stable / n >= 0.3", "'passive_screen_engagement_dominant'"),
    ("p_stable > 0 OR p_active > 0", "'limited_engagement_proxy_observed'"),
    ("p_visible_only > 0", "'device_visible_without_engagement'"),
    default="'insufficient_observable_device_use'",
)
# trace scores: (part, ((condition, points), ...))
TRACE_PARTS = {
    "s_stable": (("p_stable / n >= 0.5", 2), ("p_stable / n >= 0.25", 1)),
    "s_active": (("p_active / n >= 0.14", 2), ("p_active / n >= 0.06", 1)),
    "s_direct": (("p_direct >= 8", 2), ("p_direct >= 3", 1)),
    "s_repetitive": (("p_repetitive >= 7", 2), ("p_repetitive >= 3", 1)),
    "s_phases": (("risk_phases >= 3", 2), ("risk_phases >= 2", 1)),
    "s_coverage": (("engagement_phases >= 3", 1),),
    "s_longest": (("longest_stable_bin = 'high'", 1),),
    "s_confounding": (("p_confounded / n >= 0.18", -2), ("p_confounded / n >= 0.1", -1)),
}
TRACE_STRENGTH = case(
    ("quality = 'low_behavior_frame_quality' OR n < 40", "'insufficient_observability'"),
    ("trace_score >= 7", "'strong_risk_pattern'"),
    ("trace_score >= 4", "'moderate_risk_pattern'"),
    ("trace_score >= 2", "'mild_risk_pattern'"),
    default="'no_clear_risk_pattern'",
)
ORDINARY_USE = case(
    ("strength = 'insufficient_observability'", "'insufficient_observability'"),
    ("strength IN ('moderate_risk_pattern', 'strong_risk_pattern')", "'risk_pattern_observed'"),
    ("device_ratio >= 0.2 AND p_active / n < 0.05 AND p_repetitive = 0 AND p_stable / n < 0.35", "'ordinary_or_low_intensity_device_use'"),
    ("p_visible_only / n >= 0.25 AND p_active / n < 0.06 AND p_repetitive = 0", "'device_visible_without_risk_pattern'"),
    ("p_confounded / n >= 0.1 AND p_active / n < 0.08", "'motion_confounded_low_certainty_use'"),
    default="'limited_risk_pattern_evidence'",
)

# windows, first generation
STATUS_V0 = case(
    (f"device_level NOT IN {MEDIUM_UP} OR local_level NOT IN {ACTIVE}", "'not_observed'"),
    (f"hand_level IN {MEDIUM_UP}", "'detected'"),
    ("hand_level = 'low'", "'possible'"),
    default="'not_reliable'",
)
INTENSITY = lambda local, bursts: case(
    ("status NOT IN ('detected', 'possible')", "'none'"),
    (f"hand_level IN {MEDIUM_UP} AND ({local} = 'high' OR {bursts} >= 2)", "'high'"),
    (f"hand_level IN {LOW_UP} AND ({local} IN {ACTIVE} OR {bursts} >= 1)", "'elevated'"),
    (f"device_level IN {HIGH_UP} AND ({local} = 'high' OR {bursts} >= 2)", "'high'"),
    (f"device_level IN {MEDIUM_UP} AND ({local} IN {ACTIVE} OR {bursts} >= 1)", "'elevated'"),
    (f"{local} IN ('low', 'elevated')", "'low'"),
    default="'none'",
)
MOTION_PATTERN = lambda local, bursts: case((f"{local} = 'high' AND {bursts} >= 2", "'rapid_repetitive_local_motion'"), (f"{local} IN {ACTIVE}", "'intermittent_local_motion'"), (f"{local} = 'low'", "'low_local_motion'"), default="'no_clear_local_motion'")
BASE_CONFIDENCE = case(
    (f"device_level IN {HIGH_UP} AND lighting = 'sufficient' AND blur = 'sufficient'", "'high'"),
    ("lighting IN ('sufficient', 'low') AND blur IN ('sufficient', 'low')", "'medium'"),
    default="'low'",
)
CONFIDENCE_V0 = case(("base_confidence = 'high' AND (status = 'not_reliable' OR (status = 'possible' AND hand_level = 'low'))", "'medium'"), default="base_confidence")
GAZE_V0 = f"device_level IN {MEDIUM_UP} AND face_level IN {MEDIUM_UP} AND global_level <> 'high'"
STABLE_V0 = f"device_level IN {HIGH_UP} AND global_level IN ('none', 'low')"
BLINK_WINDOW = case(("n_eyes = 0", "'not_computed'"), ("n_closed >= 0.35 * n_frames", "'elevated_eye_closure'"), ("mean_eyes < 0.23", "'reduced_eye_openness'"), default="'stable'")

# windows, second generation
DOMINANCE = case(
    (f"localized_level IN {ACTIVE} AND localized_bursts >= 2 AND raw_global_level IN {ACTIVE}", "'localized_motion_present_with_broad_motion'"),
    (f"localized_level IN {ACTIVE} AND localized_bursts >= 2", "'localized_lower_frame_motion'"),
    (f"raw_global_level IN {ACTIVE} AND raw_global_bursts >= greatest(2, raw_local_bursts)", "'broad_frame_motion_dominant'"),
    ("raw_local_bursts > 0 OR raw_global_bursts > 0", "'low_or_mixed_motion'"),
    default="'no_clear_motion'",
)
EFFECTIVE = case(("dominance = 'broad_frame_motion_dominant'", "'high'"), ("dominance = 'localized_motion_present_with_broad_motion'", "'elevated'"), ("dominance = 'low_or_mixed_motion'", "'low'"), default="'none'")
STATUS_V2 = case(
    (f"device_level NOT IN {MEDIUM_UP} OR localized_level NOT IN {ACTIVE}", "'not_observed'"),
    (f"hand_level IN {MEDIUM_UP} AND near_hands > 0 AND localized_bursts >= 2", "'detected'"),
    (f"hand_level IN {LOW_UP} AND near_hands > 0 AND (localized_bursts >= 2 OR lower_hands > 0)", "'possible'"),
    default="'device_region_motion_only'",
)
REGION_V2 = case((f"device_level NOT IN {MEDIUM_UP}", "'not_reliable'"), (f"localized_level IN {ACTIVE}", "localized_level"), default="'none'")
STABLE_V2 = f"face_level IN {MEDIUM_UP} AND device_level IN {HIGH_UP} AND lighting NOT IN {POOR} AND blur NOT IN {POOR} AND effective <> 'high'"
GAZE_V2 = f"stable_screen AND (effective <> 'elevated' OR mesh_level IN {HIGH_UP})"
CONFIDENCE_V2 = case((f"lighting IN {POOR} OR blur IN {POOR}", "'low'"), ("status = 'detected'", "'high'"), ("status = 'possible' OR stable_screen", "'medium'"), default="confidence_v0")

# window states
STATES = [
    {
        "observability": case(
            ("n_frames <= 0", "'unusable_no_readable_frames'"),
            (f"(lighting IN {POOR} OR blur IN {POOR}) AND face_level = 'none' AND device_level = 'none'", "'poor_visual_quality'"),
            ("face_level = 'none' AND device_level = 'none'", "'limited_no_face_or_device_context'"),
            (f"lighting IN {POOR} OR blur IN {POOR}", "'partial_quality_limited'"),
            default="'usable_proxy_window'",
        ),
        "device_context": case(("device_level = 'none'", "'device_not_observed'"), ("stable_screen", "'stable_device_context'"), (f"device_level IN {HIGH_UP}", "'device_visible_unstable_context'"), default="'partial_device_context'"),
        "rhythm": case(
            ("localized_bursts >= 4 AND status IN ('detected', 'possible')", "'sustained_repetitive_interaction_proxy'"),
            ("localized_bursts >= 2 AND status IN ('detected', 'possible')", "'repeated_local_bursts_near_device'"),
            (f"localized_bursts >= 2 AND status = 'device_region_motion_only' AND region_level IN {ACTIVE}", "'device_region_repeated_motion_without_confirmed_hand'"),
            ("localized_bursts = 1", "'isolated_local_motion'"),
            default="'no_repeated_motion_proxy'",
        ),
        "posture": case((f"posture_state = 'close_to_screen' AND effective IN {ACTIVE}", "'close_to_screen_motion_confounded'"), ("posture_state = 'close_to_screen'", "'close_to_screen_proxy'"), ("posture_state IN ('mostly_upright', 'visible_not_close')", "'visible_not_close_proxy'"), default="'posture_not_reliably_estimable'"),
        "orientation": case(("gaze", "'sustained_screen_orientation_proxy'"), ("stable_screen", "'stable_screen_context_without_gaze_claim'"), (f"effective IN {ACTIVE}", "'screen_orientation_motion_confounded'"), ("device_level <> 'none'", "'device_visible_orientation_not_estimated'"), default="'screen_orientation_not_observable'"),
        "eyes": case(("mesh_level = 'none'", "'not_estimable_no_facemesh'"), ("blink IN ('elevated_eye_closure', 'reduced_eye_openness') AND eye_level IN ('low', 'very_low')", "'repeated_low_eye_openness_proxy'"), ("blink IN ('elevated_eye_closure', 'reduced_eye_openness')", "'weak_eye_openness_change_proxy'"), default="'no_eye_fatigue_proxy_observed'"),
    },
    {
        "engagement": case(
            ("observability IN ('unusable_no_readable_frames', 'poor_visual_quality', 'limited_no_face_or_device_context')", "'not_reliably_observable'"),
            ("status = 'detected'", "'confirmed_hand_device_interaction_proxy'"),
            ("status = 'possible'", "'possible_hand_device_interaction_proxy'"),
            ("gaze OR stable_screen", "'passive_screen_oriented_proxy'"),
            ("device_context <> 'device_not_observed'", "'device_visible_no_confirmed_interaction'"),
            default="'no_device_engagement_observed'",
        ),
        "state_confidence": case(("observability IN ('unusable_no_readable_frames', 'poor_visual_quality', 'limited_no_face_or_device_context')", "'low'"), ("confidence = 'high' AND effective <> 'high'", "'high'"), ("confidence IN ('medium', 'high')", "'medium'"), default="'low'"),
    },
    {
        "state": case(
            ("observability IN ('unusable_no_readable_frames', 'poor_visual_quality')", "'quality_limited_unobservable'"),
            ("engagement LIKE 'confirmed%' AND rhythm IN ('sustained_repetitive_interaction_proxy', 'repeated_local_bursts_near_device')", "'confirmed_repetitive_interaction_proxy'"),
            ("engagement LIKE 'confirmed%'", "'confirmed_interaction_proxy'"),
            ("engagement LIKE 'possible%' AND rhythm = 'repeated_local_bursts_near_device'", "'possible_repeated_interaction_proxy'"),
            ("engagement LIKE 'possible%'", "'possible_interaction_proxy'"),
            ("engagement = 'passive_screen_oriented_proxy' AND posture LIKE 'close%'", "'close_posture_passive_screen_proxy'"),
            ("engagement = 'passive_screen_oriented_proxy'", "'passive_screen_oriented_proxy'"),
            ("rhythm LIKE 'device_region%'", "'weak_device_region_motion_proxy'"),
            ("device_context <> 'device_not_observed'", "'device_visible_no_confirmed_engagement'"),
            default="'no_relevant_device_behavior_observed'",
        )
    },
]
ENGAGEMENT_SCORE = case(
    ("state = 'confirmed_repetitive_interaction_proxy'", "4"),
    ("state IN ('confirmed_interaction_proxy', 'possible_repeated_interaction_proxy')", "3"),
    ("state IN ('possible_interaction_proxy', 'close_posture_passive_screen_proxy', 'passive_screen_oriented_proxy')", "2"),
    ("state IN ('weak_device_region_motion_proxy', 'device_visible_no_confirmed_engagement')", "1"),
    default="0",
)
CONFIRMED = "state IN ('confirmed_interaction_proxy', 'confirmed_repetitive_interaction_proxy')"
POSSIBLE = "state IN ('possible_interaction_proxy', 'possible_repeated_interaction_proxy')"
PASSIVE = "state IN ('passive_screen_oriented_proxy', 'close_posture_passive_screen_proxy')"
WEAK = "state = 'weak_device_region_motion_proxy'"
TRAJECTORY = case(
    ("top_score = 0", "'no_observed_engagement_signal'"),
    ("late_mean - early_mean >= 1", "'increasing_proxy_engagement'"),
    ("early_mean - late_mean >= 1", "'decreasing_proxy_engagement'"),
    ("n_engaged >= 2", "'intermittent_proxy_engagement'"),
    default="'sparse_or_low_proxy_engagement'",
)
PATTERN = case(
    ("n_confirmed >= 3", "'multi_window_confirmed_interaction_pattern'"),
    ("n_confirmed >= 1 AND n_possible >= 1", "'mixed_confirmed_and_possible_interaction_pattern'"),
    ("n_possible >= 2", "'multi_window_possible_interaction_pattern'"),
    ("n_passive >= 2", "'multi_window_passive_screen_orientation_pattern'"),
    ("n_weak >= 2", "'weak_device_region_motion_pattern'"),
    default="'no_consistent_interaction_pattern'",
)
# episode-level detectors: name, role, condition, strength, window count
DETECTORS = [
    ("confirmed_interaction_episode", "strong_behavior_evidence", "n_confirmed >= 2 OR (n_confirmed >= 1 AND n_possible >= 1)", "CASE WHEN n_confirmed >= 2 THEN 'high' ELSE 'medium' END", "n_confirmed + n_possible"),
    ("sustained_passive_viewing_episode", "behavior_context", "n_passive >= 3 OR longest_passive >= 2 OR n_stable >= 3", "CASE WHEN longest_passive >= 2 OR n_passive >= 3 THEN 'medium' ELSE 'low' END", "n_passive"),
    ("sustained_close_posture_episode", "weak_proxy_evidence", "n_close >= greatest(3, floor(n_windows / 2))", "CASE WHEN n_close >= 6 THEN 'medium' ELSE 'low' END", "n_close"),
    ("possible_interaction_episode", "weak_proxy_evidence", "n_possible >= 2 AND n_confirmed = 0", "'low'", "n_possible"),
    ("negative_behavior_evidence", "counter_evidence", "n_windows >= 4 AND n_confirmed = 0 AND longest_confirmed = 0 AND n_passive <= 1 AND longest_passive <= 1 AND n_limited < floor(n_windows / 2)", "'medium'", "n_windows"),
]

# events: trigger, priority, condition
EVENTS_V0 = [
    ("device_interaction_evidence", 0, "status IN ('detected', 'possible')"),
    ("device_region_motion_proxy", 1, f"status = 'not_reliable' AND region_level IN {ACTIVE}"),
    ("sustained_screen_oriented_proxy", 2, "gaze"),
    ("blink_rate_change", 3, "blink <> 'not_computed'"),
    ("facial_au_trend", 4, "n_codes > 0"),
    ("stable_screen_context", 5, "stable_screen"),
    ("quality_drop", 6, "lighting = 'low' OR blur = 'low'"),
    ("motion_confounding", 7, f"global_level IN {ACTIVE}"),
]
_bonus = lambda col, table: case(*((f"{col} = '{k}'", f"cast({v} as double)") for k, v in table.items()), default="cast(0 as double)")
VISIBILITY = {"very_high": 0.9, "high": 0.7, "medium": 0.4, "low": 0.1}
HAND = {"very_high": 1.0, "high": 0.9, "medium": 0.7, "low": 0.25}
CONFIDENCE_BONUS = _bonus("confidence", {"high": 0.4, "medium": 0.15})
PENALTY = _bonus("global_level", {"high": 0.8, "elevated": 0.4})
BURST_BONUS = case(("local_bursts >= 4", "cast(1.2 as double)"), ("local_bursts >= 3", "cast(0.9 as double)"), ("local_bursts >= 2", "cast(0.6 as double)"), ("local_bursts = 1", "cast(0.2 as double)"), default="cast(0 as double)")
_d = lambda v: f"cast({v} as double)"
SCORES_V1 = {
    "score_interaction": case(("status IN ('detected', 'possible')", f"CASE WHEN status = 'detected' THEN {_d(2.8)} ELSE {_d(1.8)} END + {_bonus('device_level', VISIBILITY)} + {_bonus('hand_level', HAND)} + {BURST_BONUS} + {CONFIDENCE_BONUS} - {PENALTY}"), default=_d(0)),
    "score_region": case((f"region_level IN {ACTIVE} AND device_level IN {HIGH_UP}", f"{_d(1.3)} + {_bonus('device_level', VISIBILITY)} + {BURST_BONUS} + {CONFIDENCE_BONUS} - {PENALTY} * {_d(1.5)}"), default=_d(0)),
    "score_screen": case(("stable_screen OR gaze", f"{_d(1.8)} + {_bonus('device_level', VISIBILITY)} + {_bonus('face_level', VISIBILITY)} + CASE WHEN gaze THEN {_d(0.8)} ELSE {_d(0)} END - {PENALTY}"), default=_d(0)),
    "score_blink": case((f"blink IN ('elevated_eye_closure', 'reduced_eye_openness') AND mesh_level IN {HIGH_UP}", f"{_d(1.4)} + CASE WHEN eye_level = 'low' THEN {_d(0.8)} ELSE {_d(0)} END + {_bonus('mesh_level', VISIBILITY)} + {CONFIDENCE_BONUS} - {PENALTY} * {_d(0.5)}"), default=_d(0)),
    "score_facial": case((f"n_codes > 0 AND mesh_level IN {HIGH_UP}", f"{_d(1.2)} + {_d(0.4)} * least(n_codes, 3) + {_bonus('mesh_level', VISIBILITY)} + {CONFIDENCE_BONUS} - {PENALTY} * {_d(0.5)}"), default=_d(0)),
    "score_quality": f"CASE WHEN lighting IN {POOR} THEN {_d(1.5)} ELSE {_d(0)} END + CASE WHEN blur IN {POOR} THEN {_d(1.5)} ELSE {_d(0)} END + CASE WHEN face_level = 'none' AND device_level = 'none' THEN {_d(0.8)} ELSE {_d(0)} END",
}
EVENTS_V1 = [
    ("device_interaction_evidence", 0, "status IN ('detected', 'possible') AND score_interaction >= 3.4", "score_interaction"),
    ("device_region_motion_proxy", 1, "status = 'not_reliable' AND score_region >= 3.8", "score_region"),
    ("sustained_screen_oriented_proxy", 2, "gaze AND score_screen >= 3.2", "score_screen"),
    ("stable_screen_context", 5, "NOT (gaze AND score_screen >= 3.2) AND stable_screen AND score_screen >= 3.0", "score_screen"),
    ("blink_rate_change", 3, "score_blink >= 2.8", "score_blink"),
    ("facial_au_trend", 4, "score_facial >= 2.8", "score_facial"),
    ("quality_drop", 6, "score_quality >= 2.5", "score_quality"),
]
SCORE_STRENGTH = labels("score", [(">= 4.5", "high"), (">= 3.2", "medium")], "low")
EVIDENCE_ROLE = case(
    ("trigger = 'device_interaction_evidence' AND confidence IN ('medium', 'high')", "'strong_behavior_evidence'"),
    ("trigger = 'device_interaction_evidence'", "'weak_proxy_evidence'"),
    ("trigger = 'sustained_screen_oriented_proxy'", "'behavior_context'"),
    ("trigger = 'quality_drop'", "'quality_limitation'"),
    ("trigger IN ('device_region_motion_proxy', 'stable_screen_context')", "'weak_proxy_evidence'"),
    default="'auxiliary_context'",
)
# session summaries over counts of windows
INTENSITY_V1 = case(("n_confirmed >= 2 OR n_strong >= 3", "'high'"), ("n_possible >= 2 OR n_confirmed >= 1", "'elevated'"), ("n_possible >= 1 OR n_region >= 2", "'low'"), default="'none'")
REPETITION_V1 = case(("n_strong >= 4 OR (n_confirmed >= 2 AND n_possible >= 3)", "'high'"), ("n_strong >= 2 OR n_confirmed >= 1 OR n_possible >= 2", "'medium'"), ("n_possible >= 1 OR n_region >= 2", "'low'"), default="'none'")
INTENSITY_V2 = case(("n_confirmed >= 2", "'high'"), ("n_confirmed = 1 OR n_possible >= 2", "'elevated'"), ("n_possible = 1 OR n_region >= 2", "'low'"), default="'none'")
REPETITION_V2 = case(("n_confirmed >= 2", "'high'"), ("n_confirmed = 1 OR n_possible >= 2", "'medium'"), ("n_possible = 1 OR n_region >= 2", "'low'"), default="'none'")
CONFOUNDING = lambda rint: case((f"{safe_ratio('n_high', 'n_windows', rint)} >= 0.75", "'high'"), (f"{safe_ratio('n_active', 'n_windows', rint)} >= 0.4", "'elevated'"), ("n_active > 0", "'low'"), default="'none'")
BLINK_V0 = case(("n_values = 0", "'not_computed'"), ("n_closed >= greatest(2, floor(n_values / 3))", "'frequent_eye_closure'"), ("n_reduced >= greatest(2, floor(n_values / 3))", "'frequent_reduced_eye_openness'"), default="'mostly_stable'")
BLINK_V1 = lambda rint: case(("n_values = 0", "'not_computed'"), (f"n_closed >= greatest(3, {rint.format('n_values * cast(0.4 as double)')})", "'frequent_eye_closure'"), (f"n_reduced >= greatest(3, {rint.format('n_values * cast(0.4 as double)')})", "'frequent_reduced_eye_openness'"), ("n_closed + n_reduced > 0", "'occasional_eye_openness_change'"), default="'mostly_stable'")
ORIENTATION_STATUS = lambda bad, share, rint: case(("n_observable = 0", "'insufficient_face_or_device_visibility'"), (f"{safe_ratio(bad, 'n_observable', rint)} >= {share}", "'motion_confounded'"), default="'estimated_from_visible_face_and_device'")
POSTURE_TREND = case(("n_posture = 0", "'not_computed'"), ("n_close >= greatest(2, floor(n_windows / 2))", "'frequent_close_to_screen'"), default="'mostly_visible_not_close'")

# labels
RISK_LABELS = ("no_observed_risk", "mild_risk", "moderate_risk", "high_risk", "insufficient_evidence")
LABEL_OF = case(("quality = 1 AND toxic = 0", "'no_observed_risk'"), ("quality = 0 AND toxic = 0", "'mild_risk'"), ("quality = 1 AND toxic = 1", "'moderate_risk'"), ("quality = 0 AND toxic = 1", "'high_risk'"))
ROUND3, ROUND4 = (lambda x, rint=SPARK_RINT: py_round(x, 3, rint)), (lambda x, rint=SPARK_RINT: py_round(x, 4, rint))
