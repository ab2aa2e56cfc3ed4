"""Decision tables at their cut-points, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from granary.core import rules
from granary.core.numbers import SPARK_RINT


def results(spark, expression, rows):
    """What an expression gives on rows, in their order."""
    df = spark.createDataFrame([{**r, "_at": k} for k, r in enumerate(rows)])
    return [r.x for r in df.withColumn("x", F.expr(expression)).orderBy("_at").collect()]


@pytest.mark.parametrize(
    ("device", "hand", "local", "want"),
    [
        ("low", "high", "high", "not_observed"), ("medium", "high", "low", "not_observed"), ("medium", "medium", "elevated", "detected"), ("very_high", "very_high", "high", "detected"), ("high", "low", "high", "possible"),
        ("high", "none", "elevated", "not_reliable"), ("none", "none", "none", "not_observed"),
    ],
)
def test_status(spark, device, hand, local, want):
    assert results(spark, rules.STATUS_V0, [{"device_level": device, "hand_level": hand, "local_level": local}]) == [want]


def test_motion_patterns(spark):
    rows = [("high", 2), ("high", 1), ("elevated", 9), ("low", 0), ("none", 5)]
    assert results(spark, rules.MOTION_PATTERN("l", "b"), [{"l": a, "b": b} for a, b in rows]) == ["rapid_repetitive_local_motion", "intermittent_local_motion", "intermittent_local_motion", "low_local_motion", "no_clear_local_motion"]


def trace(**change):
    return {"n": 100, "p_stable": 0, "p_active": 0, "p_direct": 0, "p_repetitive": 0, "risk_phases": 0, "engagement_phases": 0, "longest_stable_bin": "low", "p_confounded": 0, "p_visible_only": 0, "device_ratio": 0.0, "quality": "usable_behavior_frame_quality", "trace_score": 0, "strength": "x"} | change


PARTS = {
    "s_stable": [(("p_stable", 24), 0), (("p_stable", 25), 1), (("p_stable", 49), 1), (("p_stable", 50), 2)], "s_active": [(("p_active", 5), 0), (("p_active", 6), 1), (("p_active", 13), 1), (("p_active", 14), 2)],
    "s_direct": [(("p_direct", 2), 0), (("p_direct", 3), 1), (("p_direct", 7), 1), (("p_direct", 8), 2)], "s_repetitive": [(("p_repetitive", 2), 0), (("p_repetitive", 3), 1), (("p_repetitive", 6), 1), (("p_repetitive", 7), 2)],
    "s_phases": [(("risk_phases", 1), 0), (("risk_phases", 2), 1), (("risk_phases", 3), 2)], "s_coverage": [(("engagement_phases", 2), 0), (("engagement_phases", 3), 1)], "s_longest": [(("longest_stable_bin", "medium"), 0), (("longest_stable_bin", "high"), 1)],
    "s_confounding": [(("p_confounded", 9), 0), (("p_confounded", 10), -1), (("p_confounded", 17), -1), (("p_confounded", 18), -2)],
}


@pytest.mark.parametrize("part", PARTS)
def test_parts_of_the_trace_score(spark, part):
    expression = " ".join(["CASE", *(f"WHEN {c} THEN {v}" for c, v in rules.TRACE_PARTS[part]), "ELSE 0 END"])
    assert results(spark, expression, [trace(**{k: v}) for (k, v), _ in PARTS[part]]) == [want for _, want in PARTS[part]]


def test_trace_strength_and_ordinary_use(spark):
    rows = [({"trace_score": s}, w) for s, w in ((1, "no_clear_risk_pattern"), (2, "mild_risk_pattern"), (3, "mild_risk_pattern"), (4, "moderate_risk_pattern"), (6, "moderate_risk_pattern"), (7, "strong_risk_pattern"))]
    rows += [({"trace_score": 9, "n": 39}, "insufficient_observability"), ({"trace_score": 9, "n": 40}, "strong_risk_pattern"), ({"trace_score": 9, "quality": "low_behavior_frame_quality"}, "insufficient_observability")]
    assert results(spark, rules.TRACE_STRENGTH, [trace(**c) for c, _ in rows]) == [w for _, w in rows]
    uses = [
        ({"strength": "insufficient_observability", "device_ratio": 0.9}, "insufficient_observability"), ({"strength": "moderate_risk_pattern"}, "risk_pattern_observed"), ({"strength": "strong_risk_pattern"}, "risk_pattern_observed"),
        ({"device_ratio": 0.2, "p_active": 4, "p_stable": 34}, "ordinary_or_low_intensity_device_use"), ({"device_ratio": 0.2, "p_active": 5, "p_visible_only": 25}, "device_visible_without_risk_pattern"),
        ({"device_ratio": 0.19, "p_active": 5, "p_visible_only": 24, "p_confounded": 10}, "motion_confounded_low_certainty_use"), ({"p_active": 8, "p_confounded": 30}, "limited_risk_pattern_evidence"), ({"p_repetitive": 1, "device_ratio": 0.9}, "limited_risk_pattern_evidence"),
    ]
    assert results(spark, rules.ORDINARY_USE, [trace(**c) for c, _ in uses]) == [w for _, w in uses]


def counts(confirmed=0, possible=0, region=0, strong=0):
    return {"n_confirmed": confirmed, "n_possible": possible, "n_region": region, "n_strong": strong}


def test_intensity_and_repetition_of_both_generations(spark):
    rows = [counts(), counts(region=1), counts(region=2), counts(possible=1), counts(possible=2), counts(confirmed=1, possible=1), counts(confirmed=2, possible=2), counts(strong=2, possible=2), counts(strong=3, possible=3), counts(strong=4, possible=4), counts(confirmed=2, possible=3)]
    assert results(spark, rules.INTENSITY_V1, rows) == ["none", "none", "low", "low", "elevated", "elevated", "high", "elevated", "high", "high", "high"]
    assert results(spark, rules.REPETITION_V1, rows) == ["none", "none", "low", "low", "medium", "medium", "medium", "medium", "medium", "high", "high"]
    assert results(spark, rules.INTENSITY_V2, rows)[:7] == ["none", "none", "low", "low", "elevated", "elevated", "high"]


def test_session_readings(spark):
    rows = [{"n_high": h, "n_active": a, "n_windows": 8} for h, a in ((6, 8), (5, 8), (0, 4), (0, 3), (0, 1), (0, 0))]
    assert results(spark, rules.CONFOUNDING(SPARK_RINT), rows) == ["high", "elevated", "elevated", "low", "low", "none"]
    blinks = [{"n_values": n, "n_closed": c, "n_reduced": r} for n, c, r in ((0, 0, 0), (6, 2, 0), (9, 2, 3), (9, 2, 2), (3, 1, 1))]
    assert results(spark, rules.BLINK_V0, blinks) == ["not_computed", "frequent_eye_closure", "frequent_reduced_eye_openness", "mostly_stable", "mostly_stable"]
    postures = [{"n_posture": p, "n_close": c, "n_windows": w} for p, c, w in ((0, 0, 4), (3, 2, 5), (3, 1, 2), (9, 4, 9), (9, 3, 9))]
    assert results(spark, rules.POSTURE_TREND, postures) == ["not_computed", "frequent_close_to_screen", "mostly_visible_not_close", "frequent_close_to_screen", "mostly_visible_not_close"]


def test_roles_of_events(spark):
    rows = [("device_interaction_evidence", "high", "strong_behavior_evidence"), ("device_interaction_evidence", "low", "weak_proxy_evidence"), ("sustained_screen_oriented_proxy", "low", "behavior_context"), ("quality_drop", "high", "quality_limitation"), ("device_region_motion_proxy", "high", "weak_proxy_evidence"), ("stable_screen_context", "high", "weak_proxy_evidence"), ("facial_au_trend", "high", "auxiliary_context"), ("blink_rate_change", "high", "auxiliary_context")]
    assert results(spark, rules.EVIDENCE_ROLE, [{"trigger": t, "confidence": c} for t, c, _ in rows]) == [w for _, _, w in rows]
