"""Coverage windows, their calibration, states, episodes, events and session summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.core import rules
from granary.core.islands import mode_in_order, modes_in_order, run_lengths, with_islands
from granary.core.numbers import SPARK_RINT, py_round
from granary.operators.sampling import even_indices



def by_person():
    return Window.partitionBy("person")

KEYS = ["person", "window"]
LOCALIZED_THRESHOLD = 0.035 * 0.45
MOST_WINDOWS = 12


def covered_windows(frames: DataFrame, most: int = MOST_WINDOWS) -> DataFrame:
    """Frames of at most `most` evenly spaced windows of each person, with window_order from 1 and its position."""
    windows = frames.groupBy("person").agg(F.max("window").alias("n"))
    chosen = windows.select("person", F.posexplode(even_indices(F.col("n"), most)).alias("at", "index"), "n")
    chosen = chosen.select("person", (F.col("index") + 1).alias("window"), (F.col("at") + 1).cast("long").alias("window_order"), F.expr(rules.position("at", f"least(n, {most})")).alias("position"))
    return frames.join(chosen, KEYS)


def window_summary(frames: DataFrame) -> DataFrame:
    """First-generation summary of each window: visibility, quality, motion, status, intensity, confidence."""
    df = covered_windows(frames)
    base = df.groupBy(*KEYS).agg(
        F.first("window_order").alias("window_order"), F.first("position").alias("position"), F.count(F.lit(1)).alias("n_frames"),
        *[(F.count_if(f"{x}_visible") / F.count(F.lit(1))).alias(f"{x}_share") for x in ("device", "face", "mesh", "hand")],
        F.coalesce(F.max("local_motion"), F.lit(0.0)).alias("local_peak"), F.coalesce(F.max("global_motion"), F.lit(0.0)).alias("global_peak"),
        F.count_if(F.col("local_motion") >= rules.LOCAL_THRESHOLD).alias("local_bursts"), F.count_if(F.col("global_motion") >= rules.GLOBAL_THRESHOLD).alias("global_bursts"),
        F.coalesce(F.max(F.greatest(F.col("local_motion") - F.col("global_motion") * 0.6, F.lit(0.0))), F.lit(0.0)).alias("localized_peak"),
        F.count_if(F.greatest(F.col("local_motion") - F.col("global_motion") * 0.6, F.lit(0.0)) >= LOCALIZED_THRESHOLD).alias("localized_bursts"),
        F.count_if(F.col("hand_region").isin("lower_frame", "middle_frame")).alias("near_hands"), F.count_if(F.col("hand_region") == "lower_frame").alias("lower_hands"),
        F.count("eye_openness").alias("n_eyes"), F.count_if("eye_closed").alias("n_closed"), F.avg("eye_openness").alias("eyes_share"),
        F.count_if("face_close").alias("n_close_faces"), F.count_if("several_faces").alias("n_several"), F.count_if("face_visible").alias("n_faces"),
        *[mode_in_order(F.col("ord"), F.col(q)).alias(q) for q in ("lighting", "blur")],
        F.array_sort(F.flatten(F.collect_list(F.transform("actions", lambda a: F.struct(F.col("ord").alias("o"), a.alias("a")))))).alias("_actions"),
    )
    # of the actions of a window's few frames, the three most frequent that a third of the frames hold
    seen = F.slice(F.sort_array(modes_in_order(F.transform("_actions", lambda x: x["a"])), asc=False), 1, 3)
    base = base.withColumn("n_codes", F.size(F.filter(seen, lambda x: x["n"] >= F.greatest(F.lit(1), F.floor(F.col("n_frames") / 3))))).drop("_actions")
    layers = [
        {f"{x}_ratio": py_round(f"{x}_share", 3) for x in ("device", "face", "mesh", "hand")} | {"mean_eyes": py_round("eyes_share", 6)},
        {f"{x}_level": rules.ratio_bin(f"{x}_ratio") for x in ("device", "face", "mesh", "hand")}
        | {"local_level": rules.motion_level("local_peak", "cast(0.035 as double)"), "global_level": rules.motion_level("global_peak", "cast(0.05 as double)"), "blink": rules.BLINK_WINDOW, "eye_level": rules.eye_openness("mean_eyes")}
        | {"posture_state": "CASE WHEN n_faces = 0 THEN 'not_computed' WHEN n_close_faces > 0 THEN 'close_to_screen' ELSE 'visible_not_close' END", "several": "n_several > 0"},
        {"status": rules.STATUS_V0, "region_level": f"CASE WHEN device_level IN {rules.MEDIUM_UP} THEN local_level ELSE 'not_reliable' END", "base_confidence": rules.BASE_CONFIDENCE, "gaze": rules.GAZE_V0, "stable_screen": rules.STABLE_V0},
        {"intensity": rules.INTENSITY("local_level", "local_bursts"), "motion_pattern": rules.MOTION_PATTERN("local_level", "local_bursts"), "confidence": rules.CONFIDENCE_V0},
    ]
    return _layered(base, layers)


def _layered(df: DataFrame, layers: list[dict[str, str]]) -> DataFrame:
    """One projection for each layer, so that no generated method grows too long."""
    for layer in layers:
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return df


def calibrated(windows: DataFrame) -> DataFrame:
    """Second-generation windows: motion local to the lower frame decides, broad motion counts as confounding."""
    df = windows.withColumnsRenamed({"local_level": "raw_local_level", "global_level": "raw_global_level", "local_bursts": "raw_local_bursts", "global_bursts": "raw_global_bursts", "confidence": "confidence_v0"})
    layers = [
        {"localized_level": rules.motion_level("localized_peak", f"cast({LOCALIZED_THRESHOLD!r} as double)"), "near_level": rules.ratio_bin("cast(near_hands as double) / n_frames")},
        {"dominance": rules.DOMINANCE, "status": rules.STATUS_V2, "region_level": rules.REGION_V2},
        {"effective": rules.EFFECTIVE, "global_level": rules.EFFECTIVE, "local_level": "localized_level", "local_bursts": "localized_bursts"},
        {"stable_screen": rules.STABLE_V2, "intensity": rules.INTENSITY("localized_level", "localized_bursts"), "motion_pattern": rules.MOTION_PATTERN("localized_level", "localized_bursts")},
        {"gaze": rules.GAZE_V2, "confidence": rules.CONFIDENCE_V2},
    ]
    return _layered(df, layers)


def window_states(windows: DataFrame) -> DataFrame:
    """Component states, dominant state and engagement score of each calibrated window."""
    return _layered(windows, rules.STATES).withColumn("engagement_score", F.expr(rules.ENGAGEMENT_SCORE))


def behavior_episodes(states: DataFrame) -> DataFrame:
    """Islands of equal dominant state: extent, id and modal confidence."""
    df = with_islands(states, ["person"], "window_order", ["state"])
    eps = df.groupBy("person", "island").agg(F.first("state").alias("state"), F.count(F.lit(1)).alias("n_windows"), F.min("window_order").alias("start"), F.max("window_order").alias("end"), mode_in_order(F.col("window_order"), F.col("state_confidence")).alias("confidence"))
    return eps.withColumn("episode_id", F.format_string("episode_%d_%02d", "n_windows", "start"))


def temporal_summary(states: DataFrame) -> DataFrame:
    """One row for each person: counts, streaks, trajectory, interaction pattern and session state."""
    w = by_person()
    thirds = F.greatest(F.lit(1), F.floor(F.col("total") / 3))
    ranked = states.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("nth", F.row_number().over(Window.partitionBy("person").orderBy("window_order")))
    ranked = run_lengths(ranked, ["person"], "window_order", {"longest_passive": F.expr(rules.PASSIVE), "longest_confirmed": F.expr(rules.CONFIRMED)})
    ranked = with_islands(ranked, ["person"], "window_order", ["state"]).withColumn("longest_repeated", F.count(F.lit(1)).over(Window.partitionBy("person", "island")))
    score = F.col("engagement_score")
    counts = {"n_confirmed": rules.CONFIRMED, "n_possible": rules.POSSIBLE, "n_passive": rules.PASSIVE, "n_weak": rules.WEAK, "n_stable": "device_context = 'stable_device_context'", "n_close": "posture LIKE 'close%'", "n_limited": "state = 'quality_limited_unobservable'", "n_engaged": "engagement_score >= 2"}
    df = ranked.groupBy("person").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max(score).alias("top_score"), F.avg(F.when(F.col("nth") <= thirds, score)).alias("early_mean"), F.avg(F.when(F.col("nth") > F.col("total") - thirds, score)).alias("late_mean"),
        F.size(F.collect_set(F.struct("state", "observability", "device_context", "engagement", "rhythm", "posture", "orientation", "eyes", "global_level", "dominance"))).cast("long").alias("n_signatures"),
        *[F.count_if(F.expr(v)).alias(k) for k, v in counts.items()], *[F.max(x).alias(x) for x in ("longest_passive", "longest_confirmed", "longest_repeated")], mode_in_order(F.col("window_order"), F.col("state")).alias("session_state"),
    )
    return df.withColumns({"trajectory": F.expr(rules.TRAJECTORY), "interaction_pattern": F.expr(rules.PATTERN)})


def episode_detectors(summary: DataFrame) -> DataFrame:
    """Rows (person, detector, role, strength, n_windows) for each detector whose condition holds."""
    found = [F.when(F.expr(cond), F.struct(F.lit(name).alias("detector"), F.lit(role).alias("role"), F.expr(strength).alias("strength"), F.expr(n).cast("long").alias("n"))) for name, role, cond, strength, n in rules.DETECTORS]
    return summary.select("person", F.inline(F.array_compact(F.array(*found))).alias("detector", "role", "strength", "n_windows"))


def events_v0(windows: DataFrame, most: int = 8) -> DataFrame:
    """For each window its first trigger by priority, and quality_drop besides; the first `most` of a person."""
    found = [F.when(F.expr(c), F.struct(F.lit(t).alias("trigger"), F.lit(p).alias("priority"))) for t, p, c in rules.EVENTS_V0]
    df = windows.select("person", "window_order", "confidence", F.inline(F.array_compact(F.array(*found))))
    df = df.withColumn("nth", F.row_number().over(Window.partitionBy("person", "window_order").orderBy("priority"))).filter("nth = 1 OR trigger = 'quality_drop'")
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("person").orderBy("priority", "window_order"))).filter(F.col("rank") <= most)
    return _numbered(df).withColumn("role", F.expr(rules.EVIDENCE_ROLE))


def event_scores(windows: DataFrame) -> DataFrame:
    """Scored candidates of each window that reach their trigger's least score."""
    df = windows.withColumns({k: F.expr(v) for k, v in rules.SCORES_V1.items()})
    found = [F.when(F.expr(c), F.struct(F.lit(t).alias("trigger"), F.lit(p).alias("priority"), F.col(s).alias("score"))) for t, p, c, s in rules.EVENTS_V1]
    return df.select("person", "window_order", "confidence", F.inline(F.array_compact(F.array(*found)))).withColumn("strength", F.expr(rules.SCORE_STRENGTH))


def events_v1(windows: DataFrame, most: int = 6, least: int = 0) -> DataFrame:
    """The best scored candidate of each window by strength, priority and order; the first `most` of a person.

    Where these are fewer than `least`, the first of all candidates instead, several of a window among them, up to
    the lesser of both numbers.
    """
    strength = F.expr("CASE strength WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END")
    order = [strength, F.col("priority"), F.col("window_order")]
    df = event_scores(windows).withColumn("nth", F.row_number().over(Window.partitionBy("person", "window_order").orderBy(*order)))
    if not least:
        df = df.filter("nth = 1")
    first = Window.partitionBy("person").orderBy(*order)
    df = df.withColumn("rank", F.row_number().over(first)).withColumn("own", F.count_if(F.col("nth") == 1).over(first)).withColumn("windows", F.count_if(F.col("nth") == 1).over(Window.partitionBy("person")))
    few = F.least(F.col("windows"), F.lit(most)) < least
    df = df.filter(F.when(few, F.col("rank") <= min(most, least)).otherwise((F.col("nth") == 1) & (F.col("own") <= most))).drop("own", "windows")
    return _numbered(df).withColumn("role", F.expr(rules.EVIDENCE_ROLE))


def _numbered(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("person").orderBy("window_order", "priority")
    return events.withColumn("event_id", F.format_string("Event_%02d", F.row_number().over(w)))


def _interaction_counts() -> dict[str, str]:
    often = f"local_bursts >= {rules.BURSTS_REPEATED}"
    return {
        "n_confirmed": f"status = 'detected' AND {often}", "n_possible": f"status IN ('detected', 'possible') AND {often}",
        "n_region": f"status IN ('not_reliable', 'device_region_motion_only') AND region_level IN {rules.ACTIVE} AND {often}",
        "n_strong": f"status IN ('detected', 'possible') AND {often} AND (confidence = 'high' OR hand_level IN {rules.MEDIUM_UP})",
    }


def _session_counts() -> dict[str, str]:
    observable = f"device_level IN {rules.MEDIUM_UP} AND (mesh_level IN {rules.MEDIUM_UP} OR face_level IN {rules.MEDIUM_UP})"
    return {
        "n_high": "global_level = 'high'", "n_active": f"global_level IN {rules.ACTIVE}", "n_observable": observable, "n_observable_active": f"{observable} AND global_level IN {rules.ACTIVE}",
        "n_observable_high": f"{observable} AND global_level = 'high'", "n_gaze": f"{observable} AND gaze", "n_values": "blink <> 'not_computed'", "n_closed": "blink = 'elevated_eye_closure'", "n_reduced": "blink = 'reduced_eye_openness'",
        "n_posture": "posture_state <> 'not_computed'", "n_close": "posture_state = 'close_to_screen'", "n_several": "several",
    }


def _counted(counts: dict[str, str]) -> list[Column]:
    return [F.count_if(F.expr(v)).alias(k) for k, v in counts.items()]


def interaction_summary(windows: DataFrame, generation: int) -> DataFrame:
    """Counts of confirmed, possible, strong and region-only windows of each person, and what they amount to."""
    df = windows.groupBy("person").agg(*_counted(_interaction_counts()))
    first = generation < 2
    return df.withColumns({"intensity": F.expr(rules.INTENSITY_V1 if first else rules.INTENSITY_V2), "repetition": F.expr(rules.REPETITION_V1 if first else rules.REPETITION_V2)})


def session_summary(windows: DataFrame) -> DataFrame:
    """Confounding, orientation, blink and posture readings of each person, by the rules of both generations."""
    df = run_lengths(windows, ["person"], "window_order", {"longest_gaze": F.col("gaze")})
    df = df.groupBy("person").agg(F.count(F.lit(1)).alias("n_windows"), *_counted(_session_counts()), F.max("longest_gaze").alias("longest_gaze"))
    df = df.withColumns(
        {
            "confounding": F.expr(rules.CONFOUNDING(SPARK_RINT)), "orientation_v0": F.expr(rules.ORIENTATION_STATUS("n_observable_active", 0.5, SPARK_RINT)), "orientation_v1": F.expr(rules.ORIENTATION_STATUS("n_observable_high", 0.75, SPARK_RINT)),
            "blink_v0": F.expr(rules.BLINK_V0), "blink_v1": F.expr(rules.BLINK_V1(SPARK_RINT)), "posture_trend": F.expr(rules.POSTURE_TREND), "closure_level": F.expr(rules.count_level("(n_closed + n_reduced)")),
        }
    )
    estimated = F.col("orientation_v0") == "estimated_from_visible_face_and_device"
    df = df.withColumn("_gaze", F.col("n_gaze") / F.nullif(F.col("n_observable"), F.lit(0))).withColumn("gaze_ratio", F.when(estimated, F.expr(py_round("_gaze", 3)))).withColumn("gaze_minutes", F.when(estimated, F.col("longest_gaze") * 5))
    return df.withColumns({"gaze_bin": F.when(estimated, F.expr(rules.ratio_bin("gaze_ratio"))), "gaze_duration": F.expr(rules.continuous_duration("gaze_minutes"))})


def negative_evidence(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Sorted tokens of what was not observed for each person, and the balance of evidence."""
    hands = (F.count_if(F.col("hand_level") != "none") / F.count(F.lit(1))).alias("_hands")
    df = windows.groupBy("person").agg(F.count(F.lit(1)).alias("n_windows"), *_counted(_session_counts()), *_counted(_interaction_counts()), F.bool_or("stable_screen").alias("any_stable"), hands)
    df = df.withColumns({"confounding": F.expr(rules.CONFOUNDING(SPARK_RINT)), "orientation_v1": F.expr(rules.ORIENTATION_STATUS("n_observable_high", 0.75, SPARK_RINT)), "hand_share": F.expr(py_round("_hands", 3))})
    picked = events.groupBy("person").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("strength") == "high").alias("n_strong_events"))
    df = df.withColumn("hand_observability", F.expr(rules.ratio_bin("hand_share"))).join(picked, "person", "left").fillna(0, ["n_events", "n_strong_events"])
    tokens = [
        ("n_events = 0", "no_event_windows_passed_v1_thresholds"), ("n_confirmed = 0", "no_confirmed_hand_device_interaction_proxy"), ("n_strong = 0", "no_strong_repetitive_operation_proxy"),
        ("orientation_v1 <> 'estimated_from_visible_face_and_device'", "no_reliable_sustained_screen_orientation_proxy"), ("hand_observability IN ('none', 'low')", "hand_visibility_limits_touch_interaction_evidence"), (f"confounding IN {rules.ACTIVE}", "global_motion_limits_behavior_interpretation"), ("NOT any_stable", "no_stable_screen_context_window_observed"),
    ]
    found: Column = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(t)) for c, t in tokens]))
    balance = F.expr(
        f"CASE WHEN n_events = 0 THEN 'no_selected_behavior_events' WHEN n_strong_events = 0 AND n_confirmed = 0 AND orientation_v1 <> 'estimated_from_visible_face_and_device' THEN 'weak_or_confounded_proxy_evidence' "
        f"WHEN confounding IN {rules.ACTIVE} THEN 'behavior_proxy_present_but_motion_confounded' WHEN n_strong_events >= 2 THEN 'multiple_stronger_proxy_events' ELSE 'limited_proxy_evidence' END"
    )
    return df.select("person", F.array_join(found, ";").alias("negatives"), F.size(found).cast("long").alias("n_negatives"), balance.alias("balance"))
