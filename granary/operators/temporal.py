"""Frame states, episodes and their summaries: the temporal generation of behaviour evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.core import rules
from granary.core.islands import gap_tolerant_runs, with_islands
from granary.core.numbers import py_round


def by_person():
    return Window.partitionBy("person")


@dataclass(frozen=True)
class TemporalConfig:
    motion_factor: float = 1.8
    motion_delta: float = 4.0
    motion_min: float = 8.0
    hand_min: float = 0.06
    pose_min: float = 0.04
    run_least: int = 3
    run_gap: int = 1
    max_steps: int = 9
    max_background: int = 2


CONFIG = TemporalConfig()


MEASURES = ("global_motion", "near_motion", "hand_motion", "pose_motion")
STABLE = "device_visible AND quality_usable AND coalesce(global_motion <= t_global, true) AND (face_context OR hand_near)"


def _thresholds(c: TemporalConfig) -> dict[str, Column]:
    """Thresholds from the rounded medians m_<measure>; the minimum where these are null."""
    absolute = lambda b: F.coalesce(F.greatest(b * c.motion_factor, b + c.motion_delta, F.lit(c.motion_min)), F.lit(c.motion_min))
    relative = lambda b, least: F.coalesce(F.greatest(b * 1.8, b + least / 2, F.lit(least)), F.lit(least))
    return {"t_global": absolute(F.col("m_global_motion")), "t_near": absolute(F.col("m_near_motion")), "t_hand": relative(F.col("m_hand_motion"), c.hand_min), "t_pose": relative(F.col("m_pose_motion"), c.pose_min)}


def thresholds(frames: DataFrame, c: TemporalConfig = CONFIG) -> DataFrame:
    """Each person's motion thresholds from the medians of their own frames."""
    medians = frames.groupBy("person").agg(*[F.percentile(x, 0.5).alias(x) for x in MEASURES])
    medians = medians.select("person", *[F.expr(py_round(x, 3)).alias(f"m_{x}") for x in MEASURES])
    return medians.select("person", *[v.alias(k) for k, v in _thresholds(c).items()])


def flags(frames: DataFrame, c: TemporalConfig = CONFIG) -> DataFrame:
    """Frames with the flags that their person's thresholds give, and the state of each frame alone.

    Medians are taken over the person's window, in which frames lie already, so frames are read once.
    """
    df = frames.withColumns({f"m_{x}": F.percentile(x, 0.5).over(by_person()) for x in MEASURES})
    df = df.withColumns({f"m_{x}": F.expr(py_round(f"m_{x}", 3)) for x in MEASURES})
    df = df.withColumns(_thresholds(c)).drop(*[f"m_{x}" for x in MEASURES])
    for layer in rules.FRAME_FLAGS:
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return df.withColumn("state", F.expr(rules.FRAME_STATE))


def points(frames: DataFrame, c: TemporalConfig = CONFIG) -> DataFrame:
    """Flagged frames; active ones in gap-tolerant runs within a clip are repetitive_operation."""
    df = gap_tolerant_runs(flags(frames, c), ["person", "clip"], "ord", F.col("active"), c.run_gap, c.run_least, "repetitive")
    return df.withColumn("state", F.when(F.col("repetitive"), "repetitive_operation").otherwise(F.col("state")))


COUNTED = {
    "n_usable": "quality_usable", "n_device": "device_visible", "n_stable": "stable", "n_active": "active", "n_direct": "direct", "n_repetitive": "repetitive",
    "n_indirect": "unconfounded AND NOT active", "n_unconfounded": "unconfounded", "n_confounded": "confounded", "n_posture": "posture", "n_near": "hand_near",
    "n_visible_only": "device_visible AND NOT stable AND NOT active AND NOT region_activity",
}


def episodes(frames: DataFrame, c: TemporalConfig = CONFIG) -> DataFrame:
    """Islands of equal state within a clip, with counts of flags, positions, score, confidence and support.

    longest_stable is the longest stable run of the first generation that touches the episode.
    """
    df = with_islands(points(frames, c), ["person"], "ord", ["state", "clip"])
    df = df.withColumn("_stable", F.expr(STABLE)).withColumn("_since", F.sum((~F.col("_stable")).cast("long")).over(by_person().orderBy("ord")))
    df = df.withColumn("_run", F.sum(F.col("_stable").cast("long")).over(Window.partitionBy("person", "_since")))
    counts = [F.count_if(F.expr(v)).alias(k) for k, v in COUNTED.items()]
    order = F.array(*map(F.lit, ("early", "middle", "late")))
    spread = F.array_join(F.array_intersect(order, F.collect_set("position")), "_to_")
    seen = F.when(spread == "", F.min_by("position", "ord")).otherwise(spread)
    df = df.groupBy("person", "island").agg(F.first("state").alias("state"), F.min("clip").alias("clip"), F.min("ord").alias("start"), F.max("ord").alias("end"), F.count(F.lit(1)).alias("n_points"), seen.alias("position"), F.max("_run").alias("longest_stable"), *counts)
    extra = {"score": rules.EPISODE_SCORE, "confidence": rules.EPISODE_CONFIDENCE, "support": rules.EPISODE_SUPPORT, "duration": rules.episode_duration("n_points"), "reason": rules.SELECTION_REASON}
    return df.withColumns({k: F.expr(v) for k, v in extra.items()})


def with_choice(eps: DataFrame, c: TemporalConfig = CONFIG) -> DataFrame:
    """Episodes with chosen: at most max_steps of each person.

    All, if there are no more. Else those of foreground states by score, then at most max_background others by score;
    without foreground states, all by score. Ties go to the earlier episode.
    """
    background = F.expr(f"state IN {rules.BACKGROUND}")
    df = eps.withColumn("_all", F.count(F.lit(1)).over(by_person())).withColumn("_keys", F.count_if(~background).over(by_person()))
    behind = background & (F.col("_keys") > 0)
    df = df.withColumn("_behind", behind).withColumn("_rank", F.row_number().over(Window.partitionBy("person", "_behind").orderBy(F.desc("score"), "start")))
    free = F.least(F.lit(c.max_background), F.greatest(F.lit(0), c.max_steps - F.col("_keys")))
    chosen = (F.col("_all") <= c.max_steps) | F.when(F.col("_behind"), F.col("_rank") <= free).otherwise(F.col("_rank") <= c.max_steps)
    return df.withColumn("chosen", chosen).drop("_all", "_keys", "_behind", "_rank")


def selected_episodes(eps: DataFrame, c: TemporalConfig = CONFIG) -> DataFrame:
    """The chosen episodes of each person, with step, step_id and transition, in order of time."""
    w = Window.partitionBy("person").orderBy("start")
    df = with_choice(eps, c).filter("chosen").drop("chosen").withColumn("step", F.row_number().over(w)).withColumn("_before", F.lag("state").over(w))
    transition = F.when(F.col("_before").isNull(), "sequence_start").when(F.col("_before") == F.col("state"), "state_continues").otherwise(F.concat_ws("_to_", "_before", "state"))
    return df.withColumn("transition", transition).withColumn("step_id", F.format_string("episode_%02d", "step")).drop("_before")


def _quality(usable: Column, device: Column, n: Column, longest: Column) -> list[Column]:
    return [(usable / n).alias("_valid"), (device / n).alias("_device"), longest.alias("longest_stable")]


def _graded(df: DataFrame) -> DataFrame:
    df = df.withColumns({"valid_ratio": F.expr(py_round("_valid", 3)), "device_ratio": F.expr(py_round("_device", 3))}).drop("_valid", "_device")
    return df.withColumns({"quality": F.expr(rules.FRAME_QUALITY("valid_ratio")), "longest_stable_bin": F.expr(rules.count_bin("longest_stable"))})


def quality(frames: DataFrame, c: TemporalConfig = CONFIG) -> DataFrame:
    """Share of usable frames of each person, its grade and the bin of the longest stable run of the first generation."""
    eps = episodes(frames, c)
    return _graded(eps.groupBy("person").agg(*_quality(F.sum("n_usable"), F.sum("n_device"), F.sum("n_points"), F.max("longest_stable"))))


def _in_phase(bucket: str, phase: str) -> Column:
    own = F.expr("CASE WHEN state IN ('active_hand_device_operation', 'repetitive_operation') THEN 'risk' WHEN state = 'passive_screen_engagement' THEN 'engagement' ELSE 'background' END")
    return (own == bucket) & F.col("position").contains(phase)


BUCKETS, PHASES = ("risk", "engagement", "background"), ("early", "middle", "late")


def summed_episodes(eps: DataFrame, *more: Column) -> DataFrame:
    """One row for each person from its episodes: points and episodes by kind, quality, signal strength and main pattern."""
    sums = [F.sum(f"n_{k}").alias(f"p_{k}") for k in ("stable", "active", "direct", "repetitive", "confounded", "unconfounded", "visible_only")]
    kinds = {
        "e_stable": "state = 'passive_screen_engagement'", "e_active": "state IN ('active_hand_device_operation', 'repetitive_operation')", "e_repetitive": "state = 'repetitive_operation'",
        "e_confounded": "state = 'confounded_device_region_activity'", "e_indirect": "state = 'indirect_device_region_activity'", "e_device_only": "state = 'device_visible_only'",
    }
    graded = _quality(F.sum("n_usable"), F.sum("n_device"), F.sum("n_points"), F.max("longest_stable"))
    df = _graded(eps.groupBy("person").agg(F.sum("n_points").alias("n"), F.count(F.lit(1)).alias("n_episodes"), *sums, *[F.count_if(F.expr(v)).alias(k) for k, v in kinds.items()], *graded, *more))
    return df.withColumns({"signal": F.expr(rules.SIGNAL_STRENGTH), "pattern": F.expr(rules.MAIN_PATTERN)})


def sequence_summary(frames: DataFrame, c: TemporalConfig = CONFIG) -> DataFrame:
    """One row for each person: points and episodes by kind, quality, signal strength and main pattern."""
    return summed_episodes(episodes(frames, c))


def phase_counts(selected: DataFrame) -> DataFrame:
    """Steps of each person by bucket (risk, engagement, background) and phase."""
    return selected.groupBy("person").agg(*[F.count_if(_in_phase(b, p)).alias(f"{b}_{p}") for b in BUCKETS for p in PHASES])


def trace_summary(frames: DataFrame, c: TemporalConfig = CONFIG) -> DataFrame:
    """The sequence summary with phase counts, the parts of the trace score, the score from 0 to 10, and its readings."""
    phases = [F.count_if(F.col("chosen") & _in_phase(b, p)).alias(f"{b}_{p}") for b in BUCKETS for p in PHASES]
    covered = lambda b: sum(((F.col(f"{b}_{p}") > 0).cast("int") for p in PHASES), F.lit(0))
    df = summed_episodes(with_choice(episodes(frames, c), c), *phases)
    return with_trace_score(df.withColumns({"risk_phases": covered("risk"), "engagement_phases": covered("engagement")}))


def with_trace_score(summary: DataFrame) -> DataFrame:
    """Stored summaries with the trace score and its readings, without going back to frames."""
    parts = {k: F.expr(" ".join(["CASE", *(f"WHEN {c} THEN {v}" for c, v in steps), "ELSE 0 END"])) for k, steps in rules.TRACE_PARTS.items()}
    df = summary.withColumns(parts).withColumn("trace_score", F.greatest(F.lit(0), F.least(F.lit(10), sum((F.col(k) for k in parts), F.lit(0)))))
    df = df.withColumn("strength", F.expr(rules.TRACE_STRENGTH)).withColumn("ordinary", F.expr(rules.ORDINARY_USE))
    levels = {
        "device_observability": rules.share_level("device_ratio"), "stable_burden": rules.share_level("p_stable / n"), "active_density": rules.activity_level("p_active / n"), "direct_density": rules.point_level("p_direct"),
        "repetition_density": rules.point_level("p_repetitive"), "visible_only_context": rules.share_level("p_visible_only / n"), "confounding_level": rules.activity_level("p_confounded / n"), "phase_consistency": rules.phase_level("risk_phases"),
    }
    return df.withColumns({k: F.expr(v) for k, v in levels.items()})


def legacy_events(frames: DataFrame, c: TemporalConfig = CONFIG, most: int = 8) -> DataFrame:
    """Bursts and the stable stretch of each person by score, with a quota for each type and `most` in all.

    Frame bursts exclude each other in the order hand, device region, posture, global. Ties go to the earlier frame.
    """
    df = flags(frames, c).withColumn("stable_1", F.expr(STABLE))
    kind = F.expr(
        "CASE WHEN hand_near AND hand_burst THEN 'hand_device_interaction_burst' WHEN hand_near OR region_activity THEN 'device_region_motion_burst' "
        "WHEN posture THEN 'posture_or_context_motion_burst' WHEN global_burst THEN 'global_motion_burst' END"
    )
    near = F.when(F.coalesce(F.col("near_motion"), F.lit(0.0)) == 0, F.col("t_near")).otherwise(F.col("near_motion"))
    score = F.expr("CASE kind WHEN 'hand_device_interaction_burst' THEN hand_motion * 100 WHEN 'device_region_motion_burst' THEN near WHEN 'posture_or_context_motion_burst' THEN pose_motion * 100 + global_motion ELSE global_motion END")
    bursts = df.withColumns({"kind": kind, "near": near}).filter("kind IS NOT NULL").withColumn("score", score).select("person", "ord", "kind", "position", "score")
    steady = df.groupBy("person").agg(F.count_if("stable_1").alias("s"), F.count(F.lit(1)).alias("ord")).filter("s > 0")
    steady = steady.select("person", "ord", F.lit("stable_screen_engagement_proxy").alias("kind"), F.lit("global").alias("position"), F.col("s").cast("double").alias("score"))
    quota = F.expr("CASE kind WHEN 'hand_device_interaction_burst' THEN 4 WHEN 'device_region_motion_burst' THEN 5 WHEN 'stable_screen_engagement_proxy' THEN 1 ELSE 2 END")
    return quota_topk(bursts.unionByName(steady), ["person"], "kind", quota, [F.desc("score"), F.col("ord")], most)


def quota_topk(df: DataFrame, keys: list[str], kind: str, quota: Column, order: list, most: int, name: str = "rank") -> DataFrame:
    """The first rows in order of each key, at most quota of a kind and most in all."""
    within = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))).filter(F.col("_nth") <= quota)
    return within.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most).drop("_nth")
