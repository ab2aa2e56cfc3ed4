"""Queries over ranked extracts and first-generation calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.core import rules as r
from granary.core.numbers import ORACLE_RINT, py_round, safe_ratio
from granary.operators import readings, temporal, windows
from granary.queries.evidence import STABLE_1, _layers
from granary.queries.evidence import CTES as EVIDENCE
from granary.queries.packages import LEGACY_COUNTS, LEGACY_SHARES, legacy_frame_features
from granary.queries.records import CTES as RECORDS
from granary.sources.events import active_frames, legacy_frames
from granary.sources.records import clips

R = ORACLE_RINT


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


def _states(s, d):
    return windows.window_states(windows.calibrated(windows.window_summary(active_frames(_events(s, d)))))


def important_windows(s, d):
    return readings.important_windows(_states(s, d)).select("person", F.col("rank").cast("long").alias("rank"), "window_order", "state")


def important_episodes(s, d):
    return readings.important_episodes(windows.behavior_episodes(_states(s, d))).select("person", F.col("rank").cast("long").alias("rank"), "episode_id", "state", "n_windows")


def detector_ranking(s, d):
    return readings.ranked_detectors(windows.episode_detectors(windows.temporal_summary(_states(s, d)))).select("person", F.col("rank").cast("long").alias("rank"), "detector", "role", "strength")


def _features(s, d):
    frames = legacy_frames(_events(s, d))
    counts = frames.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    return legacy_frame_features(s, d).drop("stable_bin", "region_bin", "repetition_bin", "motion_bin").join(temporal.quality(frames).select("person", "quality", "longest_stable"), "person").join(counts, "person")


def legacy_calibration(s, d):
    return readings.calibrated_features(_features(s, d)).select("person", "continuity", "directness", "confounder", "absence", "calibrated_signal")


RATIOS = ["device_ratio", "stable_ratio", "hand_ratio", "near_ratio", "active_ratio", "region_ratio"]


def coarse_measurements(s, d):
    return readings.measurements(_features(s, d), RATIOS)


def action_proxies(s, d):
    return readings.action_proxies(active_frames(_events(s, d)))


def video_quality(s, d):
    return readings.video_quality(clips(_events(s, d)))


QUERIES = {
    "important_windows": important_windows, "important_episodes": important_episodes, "detector_ranking": detector_ranking, "legacy_calibration": legacy_calibration, "coarse_measurements": coarse_measurements,
    "action_proxies": action_proxies, "video_quality": video_quality,
}

shares = ", ".join(f"{safe_ratio(f'count_if({c})', 'count(*)', R)} AS {k}" for k, c in (LEGACY_SHARES | {"stable_ratio": STABLE_1}).items() if k != "device_ratio")
counts = ", ".join(f"coalesce(count_if({c}), 0)::bigint AS {k}" for k, c in LEGACY_COUNTS.items())
ALL = EVIDENCE | {k: v for k, v in RECORDS.items() if k in ("c0", "cl")} | {"c0": EVIDENCE["c0"]}
ALL |= {
    "lf0": f"SELECT person, count(*) AS n, {shares}, {counts}, {py_round('avg(global_motion)', 3, R)} AS mean_motion FROM fg GROUP BY person",
    "lf1": "SELECT * FROM (SELECT * EXCLUDE (valid_ratio) FROM lf0) JOIN ql USING (person)",
    **_layers("lf", "lf1", readings.CALIBRATION),
    "mm": " UNION ALL ".join(f"SELECT person, n, '{x}' AS measure, {x} AS ratio FROM lf1" for x in RATIOS),
    "cc0": RECORDS["c0"],
    "cc": RECORDS["cl"].replace("FROM c0", "FROM cc0"),
    "vq0": f"SELECT *, {py_round('size_bytes / 1048576.0::double', 2, R)} AS mb FROM cc WHERE video_available",
    "vq1": f"SELECT person, count(*) AS n_videos, count(seconds) AS n_readable, sum(size_bytes)::bigint AS total_bytes, count_if({r.size_mb('mb')} = '<5MB')::bigint AS n_small, coalesce(count_if({r.clip_duration('seconds')} = '>=90s'), 0)::bigint AS n_long, {safe_ratio('count(seconds)', 'count(*)', R)} AS readable_ratio FROM vq0 GROUP BY person",
}


def sql(final: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ALL.items()) + "\n" + final


def _top(source: str, order: str, most: int, columns: str) -> str:
    return sql(f"SELECT person, rk AS rank, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY {order}) AS rk FROM {source}) WHERE rk <= {most}")


ORACLE = {
    "important_windows": _top("st", f"{readings.STATE_RANK}, window_order", 6, "window_order, state"),
    "important_episodes": _top("be", "n_windows DESC, start", 6, "episode_id, state, n_windows"),
    "detector_ranking": _top("dt", f"{readings.ROLE_RANK}, {readings.STRENGTH_RANK}, n_windows DESC, detector", 8, "detector, role, strength"),
    "legacy_calibration": sql("SELECT person, continuity, directness, confounder, absence, calibrated_signal FROM lf"),
    "coarse_measurements": sql(f"SELECT person, measure, {R.format('ratio * n')}::bigint AS hits, {R.format('ratio * 100')}::bigint || '%' AS percent, {r.share_range('ratio')} AS \"range\" FROM mm"),
    "action_proxies": sql('SELECT az.person, az.win AS "window", action, hits FROM az JOIN an ON az.person = an.person AND az.win = an.win WHERE nth <= 3 AND hits >= greatest(1, n // 3)'),
    "video_quality": sql(f"SELECT *, {readings.QUALITY} AS grade FROM vq1"),
}
