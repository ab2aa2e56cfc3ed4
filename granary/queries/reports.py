"""Report and motion queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.core.numbers import ORACLE_RINT, py_round
from granary.operators import motion, reports, sampling, windows
from granary.operators.manifest import person_manifest
from granary.operators.temporal import trace_summary
from granary.queries.evidence import CTES
from granary.queries.records import CTES as RECORDS
from granary.sources.events import active_frames, legacy_frames, ordered_events
from granary.sources.records import clips

R = ORACLE_RINT


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


def _clips(s, d):
    return clips(_events(s, d))


def _states(s, d):
    return windows.window_states(windows.calibrated(windows.window_summary(active_frames(_events(s, d)))))


def frame_differences(s, d):
    df = motion.differences(ordered_events(_events(s, d)), ["person"], "ord", ["value", "k"])
    return df.select("person", "ord", F.expr(py_round("d_value", 4)).alias("d_value"), F.col("d_k").cast("long").alias("d_k"))


def point_displacement(s, d):
    df = ordered_events(_events(s, d)).select("person", "ord", F.floor(F.col("ord") / 12).alias("clip"), F.when(F.col("k") % 7 != 0, F.col("value")).alias("x"), F.col("k").cast("double").alias("y"), F.lit(640.0).alias("w"), F.lit(480.0).alias("h"))
    df = motion.displacement(df, ["person", "clip"], "ord", "x", "y", "w", "h")
    box = motion.distance_to_box(F.col("x"), F.col("y"), F.lit(100.0), F.lit(20.0), F.lit(300.0), F.lit(60.0))
    return df.select("person", "ord", F.expr(py_round("displacement", 4)).alias("displacement"), box.alias("far")).withColumn("far", F.expr(py_round("far", 3)))


def spread_sampling(s, d):
    df = ordered_events(_events(s, d)).select("person", "n").distinct()
    return df.select("person", F.posexplode(sampling.spread_indices(F.col("n"), 30)).alias("at", "index")).select("person", F.col("at").cast("long").alias("at"), "index")


def video_histograms(s, d):
    sized = _clips(s, d).withColumns({"width": (F.col("clip") % 5) * 480, "height": (F.col("clip") % 4) * 360, "fps": (F.col("n_frames") * 3 - 3).cast("double")})
    return reports.video_histograms(sized)


def metadata_fallback(s, d):
    sized = _clips(s, d).withColumns({"width": (F.col("clip") % 5) * 480, "height": (F.col("clip") % 4) * 360, "fps": (F.col("n_frames") * 3 - 3).cast("double")})
    return reports.metadata_fallback(sized, 5)


def nested_clip_labels(s, d):
    c = _clips(s, d).withColumns({"session_uid": F.concat_ws("_s", F.col("person"), F.floor(F.col("clip") / 4)), "clip_uid": F.concat_ws("_c", F.col("person"), F.col("clip"))})
    labelled = c.filter("clip % 3 = 0").select("clip_uid", F.concat(F.lit("label"), F.col("clip") % 2).alias("label"))
    nested = reports.labels_in_sessions(person_manifest(c), labelled)
    return nested.select("person", F.size("sessions").cast("long").alias("n_sessions"), F.to_json(F.flatten(F.transform("sessions", lambda x: F.transform(x["clips"], lambda k: F.coalesce(k["label"], F.lit("-")))))).alias("labels"))


def questionnaire_fields(s, d):
    df = _events(s, d).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"性别": 1, "IP": "x", "k": 2, "班级": '), F.col("event_id"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit("[1]")).alias("payload"))
    return reports.questionnaire_audit(df, "payload").select("event_id", "n_fields", "signature", "digest", "categories")


def wide_samples(s, d):
    e = ordered_events(_events(s, d))
    kinds = e.groupBy("person", "event_type").agg(F.count(F.lit(1)).alias("c")).groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias("kinds"))
    record = e.groupBy("person").agg(F.max("n").alias("n"), F.max("k").alias("k")).join(kinds, "person").select("person", F.struct(F.struct("n").alias("session"), F.struct(F.struct("k").alias("top")).alias("state")).alias("evidence"), "kinds")
    return reports.wide(record, "person", {"n": "evidence.session.n", "top_k": "evidence.state.top.k", "absent": "evidence.state.none.k"}, {"n_": "kinds"}).withColumn("absent", F.coalesce("absent", F.lit("-")))


QUERIES = {
    "frame_differences": frame_differences, "point_displacement": point_displacement, "spread_sampling": spread_sampling, "video_histograms": video_histograms, "metadata_fallback": metadata_fallback, "nested_clip_labels": nested_clip_labels,
    "questionnaire_fields": questionnaire_fields, "wide_samples": wide_samples,
    "state_value_counts": lambda s, d: reports.state_values(_states(s, d)), "common_signatures": lambda s, d: reports.common_signatures(_states(s, d)),
    "policy_counts": lambda s, d: reports.policy_counts(windows.events_v0(windows.window_summary(active_frames(_events(s, d))))),
    "auxiliary_report": lambda s, d: reports.auxiliary_report(_clips(s, d)), "co_presence": lambda s, d: reports.co_presence(_clips(s, d)),
    "trace_indicators": lambda s, d: reports.trace_indicators(trace_summary(legacy_frames(_events(s, d)))),
}

ALL = CTES | {"cc0": RECORDS["c0"], "cc": RECORDS["cl"].replace("FROM c0", "FROM cc0")}
ALL |= {
    "mp": "SELECT *, clip % 5 * 480 AS w, clip % 4 * 360 AS h, n_frames * 3 - 3 AS f, count(*) OVER (PARTITION BY person) AS n, row_number() OVER (PARTITION BY person ORDER BY clip) - 1 AS nth FROM cc",
    "mq": f"SELECT *, CASE WHEN NOT video_available OR seconds IS NULL THEN 'unknown' WHEN seconds < 10 THEN '<10s' WHEN seconds < 30 THEN '10-30s' WHEN seconds < 90 THEN '30-90s' ELSE '>=90s' END AS durations, CASE WHEN NOT video_available OR w * h = 0 THEN 'unknown' WHEN w * h < 307200 THEN 'below_vga' WHEN w * h < 921600 THEN 'vga_to_720p' WHEN w * h < 2073600 THEN '720p_to_1080p' ELSE '1080p_or_above' END AS resolutions, CASE WHEN NOT video_available OR f <= 0 THEN 'unknown' WHEN f < 15 THEN '<15fps' WHEN f < 24 THEN '15-24fps' WHEN f <= 30 THEN '24-30fps' ELSE '>30fps' END AS rates FROM mp WHERE n <= 5 OR nth IN ({R.format('0 * (n - 1) / 4.0::double')}, {R.format('1 * (n - 1) / 4.0::double')}, {R.format('2 * (n - 1) / 4.0::double')}, {R.format('3 * (n - 1) / 4.0::double')}, {R.format('4 * (n - 1) / 4.0::double')})",
}


def sql(final: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ALL.items()) + "\n" + final


_components = ("state", "observability", "device_context", "engagement", "rhythm", "posture", "orientation", "eyes", "dominance")
_aux = lambda m: f"SELECT '{m}' AS modality, count(*) AS n_clips, count(*) FILTER ({m}_available) AS n_available, count(*) FILTER ({m}_available AND NOT coalesce({m}_empty, false)) AS n_usable, count(DISTINCT person) FILTER ({m}_available AND NOT coalesce({m}_empty, false)) AS n_persons FROM cc"
_list = lambda *rules: "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in rules) + ")"
_risk = _list(
    ("stable_engagement_is_high", "s >= 0.5"), ("stable_engagement_with_operation", "s < 0.5 AND s >= 0.25 AND (a >= 0.06 OR p_direct + p_repetitive > 0)"), ("active_operation", "a >= 0.06"), ("direct_operation", "p_direct >= 1"),
    ("repetitive_operation", "p_repetitive >= 1"), ("operation_in_several_phases", "risk_phases > 1"), ("engagement_in_all_phases", "engagement_phases = 3 AND (s >= 0.35 OR risk_phases >= 1)"), ("long_stable_run", "longest_stable > 6"),
)
ORACLE = {
    "frame_differences": sql(f"SELECT person, ord, {py_round('abs(value - lag(value) OVER o)', 4, R)} AS d_value, abs(k - lag(k) OVER o)::bigint AS d_k FROM ev WINDOW o AS (PARTITION BY person ORDER BY ord)"),
    "point_displacement": sql(f"SELECT person, ord, {py_round('sqrt((x - px) * (x - px) + (y - py) * (y - py)) / 640.0::double', 4, R)} AS displacement, {py_round('sqrt(dx * dx + dy * dy)', 3, R)} AS far FROM (SELECT *, lag(x) OVER c AS px, lag(y) OVER c AS py, CASE WHEN x < 100 THEN 100 - x WHEN x > 300 THEN x - 300 WHEN x IS NOT NULL THEN 0::double END AS dx, CASE WHEN y < 20 THEN 20 - y WHEN y > 60 THEN y - 60 ELSE 0::double END AS dy FROM (SELECT person, ord, ord // 12 AS clip, CASE WHEN k % 7 <> 0 THEN value END AS x, k::double AS y FROM ev) WINDOW c AS (PARTITION BY person, clip ORDER BY ord))"),
    "spread_sampling": sql(f"SELECT person, row_number() OVER (PARTITION BY person ORDER BY i) - 1 AS at, i AS index FROM (SELECT DISTINCT person, {R.format('g * (n - 1) / 29.0::double')}::bigint AS i FROM (SELECT DISTINCT person, n FROM ev), range(30) r(g))"),
    "video_histograms": sql(f"SELECT * FROM (WITH v AS (SELECT *, clip % 5 * 480 AS w, clip % 4 * 360 AS h, n_frames * 3 - 3 AS f, {py_round('size_bytes / 1048576.0::double', 2, R)} AS mb FROM cc) SELECT 'size' AS measure, CASE WHEN mb < 5 THEN '<5MB' WHEN mb < 20 THEN '5-20MB' WHEN mb < 50 THEN '20-50MB' ELSE '>=50MB' END AS bin, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'duration', CASE WHEN seconds IS NULL THEN 'unknown' WHEN seconds < 10 THEN '<10s' WHEN seconds < 30 THEN '10-30s' WHEN seconds < 90 THEN '30-90s' ELSE '>=90s' END, count(*) FROM v GROUP BY ALL UNION ALL SELECT 'resolution', CASE WHEN w * h = 0 THEN 'unknown' WHEN w * h < 307200 THEN 'below_vga' WHEN w * h < 921600 THEN 'vga_to_720p' WHEN w * h < 2073600 THEN '720p_to_1080p' ELSE '1080p_or_above' END, count(*) FROM v GROUP BY ALL UNION ALL SELECT 'fps', CASE WHEN f <= 0 THEN 'unknown' WHEN f < 15 THEN '<15fps' WHEN f < 24 THEN '15-24fps' WHEN f <= 30 THEN '24-30fps' ELSE '>30fps' END, count(*) FROM v GROUP BY ALL)"),
    "metadata_fallback": sql(
        "SELECT f.*, CASE WHEN there_ratio >= 0.9 THEN 'very_high' WHEN there_ratio >= 0.75 THEN 'high' WHEN there_ratio >= 0.5 THEN 'medium' WHEN there_ratio > 0 THEN 'low' ELSE 'none' END AS there, CASE WHEN readable_ratio >= 0.9 THEN 'very_high' WHEN readable_ratio >= 0.75 THEN 'high' WHEN readable_ratio >= 0.5 THEN 'medium' WHEN readable_ratio > 0 THEN 'low' ELSE 'none' END AS readable, 'behavior_frame_analysis_unavailable' AS overall FROM ("
        f"SELECT q.person, any_value(n) AS n_videos, count(*) AS n_chosen, {py_round('count(*) FILTER (video_available) / count(*)', 3, R)} AS there_ratio, {py_round('count(*) FILTER (video_available AND seconds IS NOT NULL) / count(*)', 3, R)} AS readable_ratio, "
        + ", ".join(f"(SELECT string_agg(b || '=' || c, ';' ORDER BY b) FROM (SELECT {k} AS b, count(*) AS c FROM mq z WHERE z.person = q.person GROUP BY ALL)) AS {k}" for k in ("durations", "resolutions", "rates"))
        + " FROM mq q GROUP BY q.person) f"
    ),
    "nested_clip_labels": sql("SELECT person, count(DISTINCT clip // 4) AS n_sessions, to_json(list(CASE WHEN clip % 3 = 0 THEN 'label' || (clip % 2) ELSE '-' END ORDER BY (person || '_s' || (clip // 4)), clip)) AS labels FROM cc GROUP BY person"),
    "questionnaire_fields": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 1 END::bigint AS n_fields, left(sha256(CASE WHEN event_id % 3 = 0 THEN '[\"IP\",\"k\",\"性别\",\"班级\"]' ELSE '[\"k\"]' END), 16) AS signature, left(sha256(CASE WHEN event_id % 3 = 0 THEN '{\"性别\": 1, \"IP\": \"x\", \"k\": 2, \"班级\": ' || event_id || '}' ELSE props END), 16) AS digest, CASE WHEN event_id % 3 = 0 THEN 'collection_metadata;demographic_fields;school_or_class_context' ELSE '' END AS categories FROM events WHERE event_id % 3 < 2",
    "wide_samples": sql("SELECT person, max(n)::varchar AS n, max(k)::varchar AS top_k, '-' AS absent, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'view') AS n_view FROM ev GROUP BY person"),
    "state_value_counts": sql(" UNION ALL ".join(f"SELECT '{c}' AS component, {c}::varchar AS value, count(*) AS n FROM st GROUP BY ALL" for c in _components)),
    "common_signatures": sql("SELECT state || '|' || " + " || '|' || ".join(f"'{c}=' || coalesce({c}::varchar, 'None')" for c in sorted(_components[1:])) + " AS signature, count(*) AS n FROM st GROUP BY ALL ORDER BY n DESC, signature LIMIT 20"),
    "policy_counts": sql("SELECT role, trigger, count(*) AS n, count(*) FILTER (role IN ('strong_behavior_evidence', 'behavior_context')) AS n_kept, count(*) FILTER (role NOT IN ('strong_behavior_evidence', 'behavior_context')) AS n_suppressed FROM xv0 GROUP BY ALL"),
    "auxiliary_report": sql(f"SELECT *, {py_round('n_available / n_clips', 4, R)} AS coverage, CASE WHEN n_available > 0 THEN {py_round('n_usable / n_available', 4, R)} ELSE 0 END AS usable_share FROM ({' UNION ALL '.join(map(_aux, ('usage', 'heart', 'questionnaire')))})"),
    "co_presence": sql("SELECT concat_ws('+', CASE WHEN video_available THEN 'video' END, CASE WHEN usage_available THEN 'usage' END, CASE WHEN heart_available THEN 'heart' END, CASE WHEN questionnaire_available THEN 'questionnaire' END) AS modalities, count(*) AS n FROM cc GROUP BY ALL"),
    "trace_indicators": sql(f"SELECT person, CASE WHEN risk = '' THEN 'no_clear_risk_indicator' ELSE risk END AS risk, ordinary, counter FROM (SELECT person, {_risk} AS risk, "
        + _list(("stable_engagement_alone_is_no_risk", "NOT (s >= 0.5 OR (s >= 0.25 AND (a >= 0.06 OR p_direct + p_repetitive > 0)))"), ("operation_is_rare", "a > 0 AND a < 0.06"), ("engagement_without_operation", "engagement_phases = 3 AND s < 0.35 AND risk_phases = 0"), ("device_visible_only", "v >= 0.2"), ("low_intensity", "a < 0.06 AND p_repetitive = 0")) + " AS ordinary, "
        + _list(("no_repetition", "p_repetitive = 0"), ("no_direct_operation", "p_direct = 0"), ("no_pattern_across_phases", "risk_phases < 2"), ("confounded", "c >= 0.1"), ("no_points", "n = 0"), ("device_hardly_visible", "device_ratio < 0.05")) + " AS counter FROM (SELECT *, p_stable / n AS s, p_active / n AS a, p_confounded / n AS c, p_visible_only / n AS v FROM tr))"),
}
