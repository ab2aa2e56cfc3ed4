"""Reports over records: state space, detector policy, wide sample rows, auxiliary payloads, nested labels."""

from __future__ import annotations

import json
from dataclasses import fields, replace
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.core import rules
from granary.core.numbers import py_round
from granary.operators.evaluation import LEVELS
from granary.operators.sampling import even_indices

#: What is missing by design and not told to a model.
HIDDEN_MISSING = (
    "exact_touch_events", "direct_gaze_estimation", "validated_affect_or_fatigue_labels", "screen_content_ocr", "high_dimensional_pose_or_face_mesh", "questionnaire_input", "exact_heart_rate_input", "app_name_input",
)
#: Parts of questionnaire keys and the category that each tells of.
KEY_CATEGORIES = {
    "collection_metadata": ("ip", "来源", "提交答卷时间", "所用时间"), "respondent_identifier": ("编号", "序号"), "school_or_class_context": ("学校", "校区", "班", "年级"),
    "demographic_fields": ("民族", "性别", "年龄"), "location_or_use_context": ("在哪里", "地址", "位置"),
}
COMPONENTS = ("observability", "device_context", "engagement", "rhythm", "posture", "orientation", "eyes", "dominance")
Config = TypeVar("Config")


def config_from(spark: SparkSession, path: str, default: Config) -> Config:
    """default with what a JSON object at path says of its fields; keys that it does not have are ignored."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    said = json.loads(text)
    if not isinstance(said, dict):
        raise ValueError(f"{path} holds no JSON object")
    return replace(default, **{f.name: type(getattr(default, f.name))(said[f.name]) for f in fields(default) if said.get(f.name) is not None})


def visible_missing(items: Column) -> Column:
    """What is missing, in order, without what is hidden by design."""
    return F.filter(items, lambda x: ~x.isin(*HIDDEN_MISSING))


def state_values(states: DataFrame) -> DataFrame:
    """Rows (component, value, n): how often each component of window states has each value, the state itself included."""
    each = [F.struct(F.lit(c).alias("component"), F.col(c).cast("string").alias("value")) for c in ("state", *COMPONENTS)]
    return states.select(F.inline(F.array(*each))).groupBy("component", "value").agg(F.count(F.lit(1)).alias("n"))


def common_signatures(states: DataFrame, most: int = 20) -> DataFrame:
    """The `most` most frequent full window states, as state|component=value|…, ties by name."""
    signature = F.concat_ws("|", "state", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in sorted(COMPONENTS)])
    return states.groupBy(signature.alias("signature")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature").limit(most)


def summed_counts(records: DataFrame, column: str) -> DataFrame:
    """Rows (key, n): the sums of a column of count maps."""
    return records.select(F.explode(column).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("n"))


def dotted(schema: StructType, path: str) -> Column:
    """The value at a dotted path of nested structs and maps, as text; null where the path leads nowhere."""
    here, kind = None, schema
    for part in path.split("."):
        if isinstance(kind, StructType):
            if part not in kind.names:
                return F.lit(None).cast("string")
            here = F.col(f"`{part}`") if here is None else here[part]
            kind = kind[part].dataType
        elif kind.typeName() == "map" and here is not None:
            here, kind = F.try_element_at(here, F.lit(part)), kind.valueType
        else:
            return F.lit(None).cast("string")
    return here.cast("string")


def wide(records: DataFrame, id_col: str, paths: dict[str, str], counts: dict[str, str] | None = None) -> DataFrame:
    """One row for each record: the values at dotted paths, and a column for each key that a map of counts has in any.

    counts names map columns by the prefix of their columns. The sorted union of keys is found by one small job; a
    record that lacks a key has 0.
    """
    found = []
    for prefix, column in (counts or {}).items():
        keys = sorted(r[0] for r in records.select(F.explode(F.map_keys(column)).alias("k")).distinct().collect())
        found += [F.coalesce(F.try_element_at(column, F.lit(k)), F.lit(0)).cast("long").alias(f"{prefix}{k}") for k in keys]
    return records.select(id_col, *[dotted(records.schema, p).alias(name) for name, p in paths.items()], *found)


def labels_in_sessions(people: DataFrame, labelled: DataFrame) -> DataFrame:
    """Nested persons (person, sessions of clips with clip_uid) with each clip's label (clip_uid, label) inside it.

    Clips are taken out, joined and nested again in their order; a clip without a label has null.
    """
    flat = people.select("person", F.posexplode("sessions").alias("_s", "session")).select("person", "_s", "session.session_uid", F.posexplode("session.clips").alias("_c", "clip"))
    flat = flat.withColumn("clip_uid", F.col("clip.clip_uid")).join(labelled.select("clip_uid", "label"), "clip_uid", "left")
    sessions = flat.groupBy("person", "_s", "session_uid").agg(F.array_sort(F.collect_list(F.struct("_c", F.struct("clip.*", "label").alias("clip")))).alias("_clips"))
    nested = F.struct("_s", F.struct("session_uid", F.size("_clips").alias("clip_count"), F.transform("_clips", lambda x: x["clip"]).alias("clips")).alias("session"))
    return sessions.groupBy("person").agg(F.array_sort(F.collect_list(nested)).alias("_all")).select("person", F.transform("_all", lambda x: x["session"]).alias("sessions"))


def target_label(record: DataFrame, level: str, source: str, method: str, ties: str) -> Column:
    """What is known of a record's label, kept apart from what a model sees."""
    known = F.coalesce(F.col(level).isin(LEVELS), F.lit(False))
    return F.struct(known.alias("available"), F.when(known, F.col(level)).alias("risk_level"), F.col(source).alias("label_source"), F.col(method).alias("match_method"), F.coalesce(F.col(ties), F.lit(False)).alias("has_tie"))


def key_signature(keys: Column) -> Column:
    """Sixteen hexadecimal digits of the digest of a payload's keys in order, written as a JSON list."""
    return F.substring(F.sha2(F.to_json(F.array_sort(keys)), 256), 1, 16)


def key_categories(keys: Column) -> Column:
    """The categories that a payload's keys tell of, in order."""
    tells = lambda parts: F.exists(keys, lambda k: F.lower(k).rlike("|".join(parts)))
    return F.array_compact(F.array(*[F.when(tells(KEY_CATEGORIES[c]), F.lit(c)) for c in sorted(KEY_CATEGORIES)]))


def questionnaire_audit(payloads: DataFrame, column: str) -> DataFrame:
    """Of payloads that are JSON objects: number of fields and its bin, key signature, payload digest and categories."""
    df = payloads.withColumn("_keys", F.json_object_keys(column)).filter(F.col("_keys").isNotNull()).withColumn("n_fields", F.size("_keys").cast("long"))
    return df.withColumns({"fields_bin": F.expr(rules.audit_count("n_fields")), "signature": key_signature(F.col("_keys")), "digest": F.substring(F.sha2(F.col(column), 256), 1, 16), "categories": F.array_join(key_categories(F.col("_keys")), ";")}).drop("_keys")


def auxiliary_report(clips: DataFrame, modalities: tuple[str, ...] = ("usage", "heart", "questionnaire")) -> DataFrame:
    """For each modality: clips, how many have a file, how many of these are not empty, both as shares, and persons.

    Holds counts and shares only, nothing of a payload.
    """
    each = [F.struct(F.lit(m).alias("modality"), F.col(f"{m}_available").alias("here"), (F.col(f"{m}_available") & ~F.coalesce(F.col(f"{m}_empty"), F.lit(False))).alias("full")) for m in modalities]
    long = clips.select("person", F.inline(F.array(*each))).withColumns({"here": F.coalesce("here", F.lit(False)), "full": F.coalesce("full", F.lit(False))})
    df = long.groupBy("modality").agg(F.count(F.lit(1)).alias("n_clips"), F.count_if("here").alias("n_available"), F.count_if("full").alias("n_usable"), F.count_distinct(F.when(F.col("full"), F.col("person"))).alias("n_persons"))
    return df.withColumns({"_a": F.col("n_available") / F.col("n_clips"), "_u": F.when(F.col("n_available") > 0, F.col("n_usable") / F.col("n_available")).otherwise(0.0)}).withColumns({"coverage": F.expr(py_round("_a", 4)), "usable_share": F.expr(py_round("_u", 4))}).drop("_a", "_u")


def co_presence(clips: DataFrame, modalities: tuple[str, ...] = ("video", "usage", "heart", "questionnaire")) -> DataFrame:
    """How many clips have which modalities together."""
    here = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{m}_available"), F.lit(m)) for m in modalities])), "+")
    return clips.groupBy(here.alias("modalities")).agg(F.count(F.lit(1)).alias("n"))


def video_histograms(videos: DataFrame) -> DataFrame:
    """Rows (measure, bin, n) of size, duration, resolution and frame rate of videos (size_bytes, seconds, width, height, fps)."""
    bins = {"size": rules.size_mb(py_round("size_bytes / 1048576.0", 2)), "duration": rules.clip_duration("seconds"), "resolution": rules.resolution("width", "height"), "fps": rules.fps("fps")}
    each = [F.struct(F.lit(k).alias("measure"), F.expr(v).alias("bin")) for k, v in bins.items()]
    return videos.select(F.inline(F.array(*each))).groupBy("measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def metadata_fallback(clips: DataFrame, most: int = 16) -> DataFrame:
    """What a person's videos tell where no frame can be analysed: counts and bins of up to `most` evenly chosen ones.

    clips: person, clip, video_available, seconds, width, height, fps. The shares are of the chosen videos: those whose
    file is there and those whose header is readable (seconds known).
    """
    order = Window.partitionBy("person")
    df = clips.withColumn("_n", F.count(F.lit(1)).over(order)).withColumn("_at", F.row_number().over(order.orderBy("clip")) - 1)
    df = df.filter(F.array_contains(even_indices(F.col("_n"), most), F.col("_at").cast("long")))
    bins = {"durations": rules.clip_duration("seconds"), "resolutions": rules.resolution("width", "height"), "rates": rules.fps("fps")}
    df = df.withColumns({k: F.when(F.col("video_available"), F.expr(v)).otherwise("unknown") for k, v in bins.items()})
    listed = [mode_counts(F.collect_list(k)).alias(k) for k in bins]
    readable = F.col("video_available") & F.col("seconds").isNotNull()
    df = df.groupBy("person").agg(F.first("_n").alias("n_videos"), F.count(F.lit(1)).alias("n_chosen"), (F.count_if("video_available") / F.count(F.lit(1))).alias("_there"), (F.count_if(readable) / F.count(F.lit(1))).alias("_readable"), *listed)
    df = df.withColumns({"there_ratio": F.expr(py_round("_there", 3)), "readable_ratio": F.expr(py_round("_readable", 3))}).drop("_there", "_readable")
    return df.withColumns({"there": F.expr(rules.ratio_bin("there_ratio")), "readable": F.expr(rules.ratio_bin("readable_ratio")), "overall": F.lit("behavior_frame_analysis_unavailable")})


def mode_counts(values: Column) -> Column:
    """Counts of the values of a short array as value=n;… by value."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.concat_ws("=", v, F.size(F.filter(values, lambda x: x == v)).cast("string"))), ";")


def policy_counts(events: DataFrame) -> DataFrame:
    """Events by role, and whether the policy keeps them as behaviour events or only as context."""
    kept = F.col("role").isin("strong_behavior_evidence", "behavior_context")
    return events.groupBy("role", "trigger").agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_suppressed"))


def trace_indicators(trace: DataFrame) -> DataFrame:
    """Tokens for each person: what speaks for a risky trace of use, for ordinary use, and against either."""
    risk = [
        ("stable_share >= 0.5", "stable_engagement_is_high"), ("stable_share >= 0.25 AND stable_share < 0.5 AND (active_share >= 0.06 OR p_direct > 0 OR p_repetitive > 0)", "stable_engagement_with_operation"),
        ("active_share >= 0.06", "active_operation"), ("p_direct > 0", "direct_operation"), ("p_repetitive > 0", "repetitive_operation"), ("risk_phases >= 2", "operation_in_several_phases"),
        ("engagement_phases >= 3 AND (stable_share >= 0.35 OR risk_phases > 0)", "engagement_in_all_phases"), ("longest_stable_bin = 'high'", "long_stable_run"),
    ]
    ordinary = [
        ("stable_share < 0.25 OR (stable_share < 0.5 AND active_share < 0.06 AND p_direct = 0 AND p_repetitive = 0)", "stable_engagement_alone_is_no_risk"), ("active_share > 0 AND active_share < 0.06", "operation_is_rare"),
        ("engagement_phases >= 3 AND NOT (stable_share >= 0.35 OR risk_phases > 0)", "engagement_without_operation"), ("visible_only_share >= 0.2", "device_visible_only"), ("active_share < 0.06 AND p_repetitive = 0", "low_intensity"),
    ]
    counter = [("p_repetitive = 0", "no_repetition"), ("p_direct = 0", "no_direct_operation"), ("risk_phases <= 1", "no_pattern_across_phases"), ("confounded_share >= 0.1", "confounded"), ("n <= 0", "no_points"), ("device_ratio < 0.05", "device_hardly_visible")]
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    df = trace.withColumns({"stable_share": share("p_stable"), "active_share": share("p_active"), "confounded_share": share("p_confounded"), "visible_only_share": share("p_visible_only")})
    tokens = lambda table: F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(t)) for c, t in table])), ";")
    return df.select("person", F.coalesce(F.nullif(tokens(risk), F.lit("")), F.lit("no_clear_risk_indicator")).alias("risk"), tokens(ordinary).alias("ordinary"), tokens(counter).alias("counter"))
