import json


import pytest
from pyspark.sql import functions as F

from granary.core import rules
from granary.operators import motion, reports
from granary.operators.sampling import spread_indices
from granary.operators.temporal import CONFIG
from granary.plans import listeners
from granary.sources import files


def test_config_takes_known_fields_and_their_types(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"motion_factor": 2, "run_gap": 3.0, "odd": 1, "max_steps": None}))
    got = reports.config_from(spark, str(tmp_path / "c.json"), CONFIG)
    assert (got.motion_factor, got.run_gap, got.max_steps, got.hand_min) == (2.0, 3, CONFIG.max_steps, CONFIG.hand_min)
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError, match="no JSON object"):
        reports.config_from(spark, str(tmp_path / "d.json"), CONFIG)


def test_dotted_paths_and_discovered_columns(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', named_struct('b', 2), 'm', map('x', 5)) AS e, map('p', 1, 'q', 2) AS c UNION ALL SELECT 2, named_struct('a', named_struct('b', 3), 'm', map('y', 6)), map('r', 4)")
    rows = reports.wide(df, "id", {"b": "e.a.b", "x": "e.m.x", "no": "e.z.b", "deep": "e.a.b.c"}, {"c_": "c"}).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "2", "5", None, None, 1, 2, 0), (2, "3", None, None, None, 0, 0, 4)] and rows[0].__fields__[5:] == ["c_p", "c_q", "c_r"]


def test_hidden_missing_items_and_sums_of_maps(spark):
    df = spark.createDataFrame([(["a", "app_name_input", "b"], {"x": 1}), ([], {"x": 2, "y": 5})], "m array<string>, c map<string,int>")
    assert [r.v for r in df.select(reports.visible_missing(F.col("m")).alias("v")).collect()] == [["a", "b"], []]
    assert {r.key: r.n for r in reports.summed_counts(df, "c").collect()} == {"x": 3, "y": 5}


def test_targets_stay_apart_and_unknown_levels_are_not_available(spark):
    df = spark.createDataFrame([("mild_risk", "sheet", "clips", True), ("odd", "sheet", "clips", None), (None, None, None, None)], "level string, source string, method string, tie boolean")
    got = [tuple(r.t) for r in df.select(reports.target_label(df, "level", "source", "method", "tie").alias("t")).collect()]
    assert got == [(True, "mild_risk", "sheet", "clips", True), (False, None, "sheet", "clips", False), (False, None, None, None, False)]


def test_labels_return_to_their_clips_in_order(spark):
    df = spark.sql("SELECT 1 AS person, array(named_struct('session_uid', 's1', 'clip_count', 2, 'clips', array(named_struct('clip', 1, 'clip_uid', 'a'), named_struct('clip', 0, 'clip_uid', 'b'))), named_struct('session_uid', 's0', 'clip_count', 1, 'clips', array(named_struct('clip', 5, 'clip_uid', 'c')))) AS sessions")
    row = reports.labels_in_sessions(df, spark.createDataFrame([("b", "x"), ("c", "y")], "clip_uid string, label string")).first()
    assert [(s.session_uid, s.clip_count, [(c.clip_uid, c.label) for c in s.clips]) for s in row.sessions] == [("s1", 2, [("a", None), ("b", "x")]), ("s0", 1, [("c", "y")])]


def test_distances_and_bins_at_their_cut_points(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (13.0, 14.0), (None, 1.0)], "x double, y double")
    box = motion.distance_to_box(F.col("x"), F.col("y"), F.lit(3.0), F.lit(4.0), F.lit(10.0), F.lit(10.0))
    assert [r.d for r in df.select(box.alias("d")).collect()] == [5.0, 0.0, 5.0, None]
    assert spark.range(1).select(motion.euclid(F.lit(2.0), F.lit(3.0), F.lit(6.0)).alias("e")).first().e == 7.0
    sizes = {(640, 479): "below_vga", (640, 480): "vga_to_720p", (1280, 720): "720p_to_1080p", (1920, 1080): "1080p_or_above", (0, 5): "unknown", (None, 5): "unknown"}
    df = spark.createDataFrame(list(sizes), "w int, h int")
    assert [r.b for r in df.select(F.expr(rules.resolution("w", "h")).alias("b")).collect()] == list(sizes.values())
    rates = {None: "unknown", 0.0: "unknown", 14.9: "<15fps", 15.0: "15-24fps", 24.0: "24-30fps", 30.0: "24-30fps", 30.1: ">30fps"}
    df = spark.createDataFrame([(x,) for x in rates], "x double")
    assert [r.b for r in df.select(F.expr(rules.fps("x")).alias("b")).collect()] == list(rates.values())


def test_spread_indices_are_distinct_and_reach_both_ends(spark):
    for n, k in ((10, 4), (3, 9), (1, 5), (0, 3), (7, 1), (5, 0)):
        want = sorted({round(i * (n - 1) / max(k - 1, 1)) for i in range(k)}) if n > 0 and k > 0 else []
        assert spark.range(1).select(spread_indices(F.lit(n), k).alias("x")).first().x == want



WINDOW = {
    "n_codes": 3, "mesh_level": "high", "confidence": "high", "global_level": "none", "status": "not_reliable", "region_level": "high", "device_level": "high", "hand_level": "none", "local_bursts": 4, "stable_screen": False, "gaze": False,
    "face_level": "high", "blink": "stable", "eye_level": "typical", "lighting": "sufficient", "blur": "sufficient", "person": 1, "window_order": 1,
}
CASES = [
    ("score_facial", {}, 1.2 + 1.2 + 0.7 + 0.4), ("score_facial", {"n_codes": 5, "mesh_level": "very_high", "global_level": "high"}, 1.2 + 1.2 + 0.9 + 0.4 - 0.4), ("score_facial", {"n_codes": 0}, 0.0), ("score_facial", {"mesh_level": "medium"}, 0.0),
    ("score_interaction", {"status": "detected", "hand_level": "very_high"}, 2.8 + 0.7 + 1.0 + 1.2 + 0.4), ("score_interaction", {"status": "possible", "hand_level": "low", "local_bursts": 1, "confidence": "low", "global_level": "elevated"}, 1.8 + 0.7 + 0.25 + 0.2 - 0.4), ("score_interaction", {}, 0.0),
    ("score_region", {}, 1.3 + 0.7 + 1.2 + 0.4), ("score_region", {"local_bursts": 2, "global_level": "high"}, 1.3 + 0.7 + 0.6 + 0.4 - 1.2), ("score_region", {"device_level": "medium"}, 0.0),
    ("score_screen", {"gaze": True}, 1.8 + 0.7 + 0.7 + 0.8), ("score_screen", {"stable_screen": True, "global_level": "elevated"}, 1.8 + 0.7 + 0.7 - 0.4), ("score_screen", {}, 0.0),
    ("score_blink", {"blink": "elevated_eye_closure", "eye_level": "low"}, 1.4 + 0.8 + 0.7 + 0.4), ("score_blink", {"blink": "reduced_eye_openness", "confidence": "medium", "global_level": "high"}, 1.4 + 0.7 + 0.15 - 0.4), ("score_blink", {}, 0.0),
    ("score_quality", {"lighting": "low", "blur": "very_low", "face_level": "none", "device_level": "none"}, 3.8), ("score_quality", {"blur": "low"}, 1.5), ("score_quality", {}, 0.0),
]


def test_scores_of_windows_by_hand(spark):
    rows = [{**WINDOW, **change} for _, change, _ in CASES]
    df = spark.createDataFrame(rows, "n_codes int, mesh_level string, confidence string, global_level string, status string, region_level string, device_level string, hand_level string, local_bursts int, stable_screen boolean, gaze boolean, face_level string, blink string, eye_level string, lighting string, blur string, person int, window_order int").coalesce(1)
    got = df.select(*[F.expr(v).alias(k) for k, v in rules.SCORES_V1.items()]).collect()
    for row, (name, _, want) in zip(got, CASES, strict=True):
        assert row[name] == pytest.approx(want), name


def test_triggers_of_windows_by_hand(spark):
    rows = {
        "device_interaction_evidence": {"status": "possible"}, "device_region_motion_proxy": {}, "sustained_screen_oriented_proxy": {"gaze": True}, "blink_rate_change": {"blink": "stable"}, "facial_au_trend": {"n_codes": 1},
        "stable_screen_context": {"stable_screen": True}, "quality_drop": {"blur": "low"}, "motion_confounding": {"global_level": "elevated"},
    }
    plain = {**WINDOW, "n_codes": 0, "blink": "not_computed", "region_level": "low"}
    assert [t for t, _, _ in rules.EVENTS_V0] == sorted((t for t, _, _ in rules.EVENTS_V0), key=lambda t: dict((a, b) for a, b, _ in rules.EVENTS_V0)[t])
    for name, change in rows.items():
        row = {**plain, **change, **({"region_level": "elevated"} if name == "device_region_motion_proxy" else {})}
        df = spark.createDataFrame([row])
        fired = [t for t, _, c in rules.EVENTS_V0 if df.select(F.expr(c).alias("x")).first().x]
        assert fired == [name]


def test_listeners_hear_what_their_rules_say(spark):
    plain = {**WINDOW, "n_codes": 0, "blink": "not_computed", "region_level": "low"}
    df = spark.createDataFrame([plain, {**plain, "window_order": 2, "blur": "low", "n_codes": 2}, {**plain, "person": 2, "gaze": True}])
    got = {(r.person, r.window_order, r.trigger) for r in listeners.heard(df).collect()}
    assert got == {(1, 2, "quality_drop"), (1, 2, "facial_au_trend"), (2, 1, "sustained_screen_oriented_proxy")}
    own = listeners.RuleListener("own", 9, "late AND gaze")
    context = spark.createDataFrame([(1, True), (2, True)], "person long, late boolean")
    assert [r.person for r in listeners.heard(df, [own], context).collect()] == [2]
    with pytest.raises(ValueError, match="one name"):
        listeners.heard(df, [own, own])


def test_scans_of_roots_stop_at_segments(spark, tmp_path):
    for root, names in (("a", ["b1/p1_VID_2024_01_02_03_04_05_007", "b1/p1_VID_2024_01_02_03_04_05_007/p9_VID_2024_01_02_03_04_05_001", "p2_VID_2024_01_02_03_04_05_001"]), ("b", ["x/p1_VID_2024_01_02_03_04_05_003", "x/p_1_VID_odd"])):
        for n in names:
            (tmp_path / root / n).mkdir(parents=True, exist_ok=True)
            (tmp_path / root / n / "usage.json").write_text("[]")
    found, summary = files.scan_roots(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert [(r.person_raw, r.clip_index) for r in found.collect()] == [("p1", 3), ("p1", 7), ("p2", 1)]
    assert sorted(tuple(r)[1:] for r in summary.collect()) == [(1, 1, 1, 1), (2, 2, 2, 0)]
