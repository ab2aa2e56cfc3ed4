"""Frame tables made from the event stream of the star schema.

A user's events in order of time stand for sampled frames: twelve to a clip, six to a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.core.rules import position


def ordered_events(events: DataFrame) -> DataFrame:
    """person, ord (from 0), n (the person's events), event_type, value and k (from props), with event_id and ts."""
    by_person = Window.partitionBy("user_id")
    return events.select(
        F.col("user_id").alias("person"),
        (F.row_number().over(by_person.orderBy("ts", "event_id")) - 1).cast("long").alias("ord"),
        F.count(F.lit(1)).over(by_person).alias("n"),
        "event_id",
        "ts",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


VISIBILITY = {
    "device_visible": "event_type <> 'signup'",
    "hand_visible": "event_type IN ('click', 'purchase')",
    "face_visible": "event_type IN ('view', 'click', 'purchase') AND k % 3 <> 0",
}


def legacy_frames(events: DataFrame) -> DataFrame:
    """Frames with visibility flags and four motion measures, in clips of twelve."""
    df = ordered_events(events).withColumns({k: F.expr(v) for k, v in VISIBILITY.items()})
    return df.select(
        "person", "ord", "n", F.floor(F.col("ord") / 12).alias("clip"), F.expr(position("ord", "n", "single")).alias("position"),
        F.expr("k >= 5").alias("quality_usable"), "device_visible", "hand_visible", F.expr("hand_visible AND k % 2 = 0").alias("hand_near"), "face_visible",
        F.expr("face_visible AND device_visible").alias("face_context"), F.col("k").cast("double").alias("global_motion"), F.col("value").alias("near_motion"),
        (F.col("value") / 1000).alias("hand_motion"), (F.col("k") / 1000).alias("pose_motion"),
    )


def active_frames(events: DataFrame) -> DataFrame:
    """Frames in windows of six; motion is null on the first frame of a window, actions of the face where its mesh is not seen."""
    df = ordered_events(events).withColumns({k: F.expr(v) for k, v in VISIBILITY.items()})
    moving = F.col("ord") % 6 > 0
    mesh = F.expr("face_visible AND k % 5 <> 0")
    eyes = F.when(mesh, 0.1 + (F.col("k") % 20) / 100)
    region = F.expr("CASE WHEN NOT hand_visible THEN 'none' WHEN k % 3 = 0 THEN 'lower_frame' WHEN k % 3 = 1 THEN 'middle_frame' ELSE 'upper_frame' END")
    actions = F.array_compact(F.array(F.when(F.col("k") % 4 == 0, "brow"), F.when(F.col("k") % 3 == 0, "jaw"), F.when(F.col("k") % 2 == 0, "lid"), F.when(F.col("k") % 5 == 1, "lip")))
    return df.select(
        "person", "ord", (F.floor(F.col("ord") / 6) + 1).alias("window"), "device_visible", "hand_visible", "face_visible", mesh.alias("mesh_visible"), region.alias("hand_region"),
        F.when(F.col("k") < 20, "low").otherwise("sufficient").alias("lighting"), F.when(F.col("k") >= 95, "low").otherwise("sufficient").alias("blur"),
        eyes.alias("eye_openness"), F.coalesce(eyes < 0.2, F.lit(False)).alias("eye_closed"), F.expr("face_visible AND k % 7 = 0").alias("face_close"), F.expr("face_visible AND k % 11 = 0").alias("several_faces"),
        F.when(moving, F.col("value") / 1000).alias("local_motion"), F.when(moving, F.col("k") / 1000).alias("global_motion"), F.when(mesh, actions).alias("actions"),
    )
