"""Ranked extracts of states and episodes, first-generation calibration, action proxies and video quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.core import rules
from granary.core.numbers import case, labels, py_round, text

#: Dominant states from the most to the least telling.
STATE_ORDER = (
    "confirmed_repetitive_interaction_proxy", "confirmed_interaction_proxy", "possible_repeated_interaction_proxy", "possible_interaction_proxy", "close_posture_passive_screen_proxy",
    "passive_screen_oriented_proxy", "weak_device_region_motion_proxy", "quality_limited_unobservable", "device_visible_no_confirmed_engagement", "no_relevant_device_behavior_observed",
)
ROLE_ORDER = ("strong_behavior_evidence", "behavior_context", "counter_evidence", "weak_proxy_evidence", "quality_limitation", "auxiliary_context")
STATE_RANK = case(*((f"state = {text(s)}", str(k)) for k, s in enumerate(STATE_ORDER)), default="99")
ROLE_RANK = case(*((f"role = {text(s)}", str(k)) for k, s in enumerate(ROLE_ORDER)), default="99")
STRENGTH_RANK = case(("strength = 'high'", "0"), ("strength = 'medium'", "1"), ("strength = 'low'", "2"), default="99")

CONTINUITY = case(("stable_bin IN ('high', 'very_high') OR longest_bin = 'high'", "'strong'"), ("stable_bin = 'medium' OR longest_bin = 'medium'", "'moderate'"), default="'limited'")
DIRECTNESS = case(
    ("active_bin IN ('high', 'very_high') OR repetition_bin = 'high'", "'strong_direct_or_repetitive_proxy'"), ("active_bin = 'medium' OR repetition_bin = 'medium'", "'moderate_direct_proxy'"),
    ("region_density IN ('high', 'very_high')", "'indirect_device_region_activity_only'"), ("region_density = 'medium'", "'limited_indirect_activity'"), default="'limited_direct_interaction_evidence'",
)
CONFOUNDER = case(("posture_bin = 'high' OR motion_bin = 'high'", "'high_potential_confounding'"), ("posture_bin = 'medium' OR motion_bin IN ('elevated', 'medium')", "'moderate_potential_confounding'"), default="'low_or_unclear_confounding'")
ABSENCE = case(
    ("repetition_bin IN ('none', 'low') AND active_bin IN ('none', 'low') AND stable_bin IN ('none', 'low')", "'no_clear_sustained_or_repetitive_proxy_observed'"),
    ("repetition_bin IN ('none', 'low') AND active_bin IN ('none', 'low')", "'no_clear_repetitive_operation_proxy_observed'"), default="'limited_absence_evidence'",
)
_MEDIUM = "('medium', 'high', 'very_high')"
_CONTINUES = f"(stable_bin IN {_MEDIUM} OR longest_bin IN ('medium', 'high'))"
_CLEAR = "confounder <> 'high_potential_confounding'"
SIGNAL = case(
    ("quality <> 'usable_behavior_frame_quality'", "'insufficient_video_proxy_signal'"),
    (f"device_bin NOT IN {_MEDIUM}", "'weak_video_proxy_signal'"),
    (f"{_CONTINUES} AND active_bin IN {_MEDIUM} AND repetition_bin IN ('medium', 'high') AND {_CLEAR}", "'strong_video_proxy_signal'"),
    (f"{_CONTINUES} AND (active_bin IN {_MEDIUM} OR repetition_bin IN ('medium', 'high')) AND {_CLEAR}", "'moderate_video_proxy_signal'"),
    (f"region_density IN {_MEDIUM} OR {_CONTINUES} OR active_bin IN {_MEDIUM}", "'mild_video_proxy_signal'"),
    default="'weak_video_proxy_signal'",
)
CALIBRATION = [
    {
        "stable_bin": rules.legacy_ratio_bin("stable_ratio"), "active_bin": rules.legacy_ratio_bin("active_ratio"), "device_bin": rules.legacy_ratio_bin("device_ratio"), "repetition_bin": rules.count_bin("n_repetition"), "posture_bin": rules.count_bin("n_posture"),
        "region_density": rules.activity_ratio_bin("region_ratio"), "motion_bin": rules.level_bin("mean_motion", "4.0", "12.0", "24.0"), "longest_bin": rules.count_bin("longest_stable"),
    },
    {"continuity": CONTINUITY, "directness": DIRECTNESS, "confounder": CONFOUNDER, "absence": ABSENCE},
    {"calibrated_signal": SIGNAL},
]
QUALITY = labels("readable_ratio", [(">= 0.9", "usable"), (">= 0.5", "partial"), ("> 0", "file_level")], "low")


def ranked(df: DataFrame, order: list, most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each person in an order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("person").orderBy(*order))).filter(F.col(name) <= most)


def important_windows(states: DataFrame, most: int = 6) -> DataFrame:
    """A person's most telling windows: by state, then by time."""
    return ranked(states, [F.expr(STATE_RANK), F.col("window_order")], most)


def important_episodes(episodes: DataFrame, most: int = 6) -> DataFrame:
    """A person's longest episodes, the earlier first."""
    return ranked(episodes, [F.desc("n_windows"), F.col("start")], most)


def ranked_detectors(detectors: DataFrame, most: int = 8) -> DataFrame:
    """A person's detectors by role, strength, number of windows and name."""
    return ranked(detectors, [F.expr(ROLE_RANK), F.expr(STRENGTH_RANK), F.desc("n_windows"), F.col("detector")], most)


def calibrated_features(features: DataFrame) -> DataFrame:
    """First-generation features with continuity, directness, confounding, absence and signal strength."""
    for layer in CALIBRATION:
        features = features.withColumns({k: F.expr(v) for k, v in layer.items()})
    return features


def measurements(features: DataFrame, ratios: list[str], n: str = "n") -> DataFrame:
    """Hits, percentage and range of each ratio of a person's features, one row for each."""
    each = [F.struct(F.lit(x).alias("measure"), F.col(x).alias("ratio")) for x in ratios]
    df = features.select("person", F.col(n).alias("n"), F.inline(F.array(*each)))
    rint = lambda x: F.rint(x).cast("long")
    return df.select("person", "measure", rint(F.col("ratio") * F.col("n")).alias("hits"), F.concat(rint(F.col("ratio") * 100).cast("string"), F.lit("%")).alias("percent"), F.expr(rules.share_range("ratio")).alias("range"))


def action_proxies(frames: DataFrame, most: int = 3) -> DataFrame:
    """The `most` most frequent actions of each window, first seen first among equals, held by a third of its frames."""
    sizes = frames.groupBy("person", "window").agg(F.count(F.lit(1)).alias("n"))
    counted = frames.select("person", "window", "ord", F.explode("actions").alias("action")).groupBy("person", "window", "action").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("ord", "action")).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("person", "window").orderBy(F.desc("hits"), "_first"))
    return counted.withColumn("nth", nth).filter(F.col("nth") <= most).join(sizes, ["person", "window"]).filter(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("n") / 3))).select("person", "window", "action", "hits")


def video_quality(clips: DataFrame) -> DataFrame:
    """Readable share, sizes and grade of each person's videos; a clip without a duration is not readable."""
    mb = F.expr(py_round("size_bytes / 1048576.0", 2))
    df = clips.filter("video_available").withColumn("mb", mb).withColumn("bin", F.expr(rules.size_mb("mb"))).withColumn("time", F.expr(rules.clip_duration("seconds")))
    df = df.groupBy("person").agg(F.count(F.lit(1)).alias("n_videos"), F.count("seconds").alias("n_readable"), F.sum("size_bytes").alias("total_bytes"), F.count_if(F.col("bin") == "<5MB").alias("n_small"), F.count_if(F.col("time") == ">=90s").alias("n_long"))
    df = df.withColumn("_share", F.col("n_readable") / F.col("n_videos")).withColumn("readable_ratio", F.expr(py_round("_share", 3))).drop("_share")
    return df.withColumn("grade", F.expr(QUALITY))
