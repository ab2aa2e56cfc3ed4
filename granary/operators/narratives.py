"""Sentences about the windows of selected events, and phrases for levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.core.numbers import case, text
from granary.core.rules import ACTIVE, MEDIUM_UP

#: How often a level of visibility or motion was seen, in words.
LEVEL_PHRASES = {
    "very_high": "seen in almost every window", "high": "seen in most windows", "medium": "seen in part of the windows", "low": "seen in few windows",
    "none": "never seen", "not_computed": "not known", "motion_confounded": "blurred by movement of the whole frame", "not_reliably_estimable": "not known",
}
SENTENCES = {
    "detected_rapid": "Hands and a device were in view while the lower frame moved in quick, repeated bursts: evidence of repeated touch input. Neither its kind nor its place nor what the screen showed is kept.",
    "detected": "Hands and a device were in view while the lower frame moved: evidence that the hands used the device. Where they touched is not kept.",
    "possible_rapid": "Hands were hardly in view, but a device was, and the lower frame moved in quick, repeated bursts: repeated touch input is possible, not shown.",
    "possible": "Hands were hardly in view, but something moved near a device: use of the device is possible, and less certain for want of sight of the hands.",
    "region_rapid": "A device was in view and the lower frame moved in quick, repeated bursts, but no hands confirm touch input: activity of the device's region only.",
    "region_intermittent": "A device was in view and the lower frame moved now and then, but hands were seen too little to confirm touch input.",
    "region": "A device was in view, but hands and motion do not show whether it was used.",
    "stable_screen_context": "A device stayed in view while the frame was calm: a setting for viewing, not for input.",
    "sustained_screen_oriented_proxy": "Face and device were in view together and calm: the person was turned to the screen. Where the eyes looked is not measured.",
    "motion_confounding": "The whole frame moved, so motion in its lower part may come from the posture or the camera.",
    "quality_drop": "This window stands here because the picture was poor; what it shows of behaviour is to be read with care.",
    "no_interaction": "Hands, device and motion in this window show no use of the device.",
    "close_moving": "The face filled much of the frame, as close to a screen, but the frame moved as a whole, so the posture is uncertain.",
    "close": "The face filled much of the frame, as close to a screen.",
    "not_close": "The face was in view and not close to the screen.",
    "no_posture": "The face was seen too little to tell the posture.",
    "no_face": "The mesh of the face was seen too seldom to read it.",
    "screen": "Face and device were in view together, calm enough to take the person as turned to the screen.",
    "screen_unsure": "A device was in view, but face or motion do not allow to tell whether the person was turned to it.",
    "no_screen": "Whether the person was turned to a screen cannot be told.",
    "motion_both": "The lower frame moved in repeated bursts while the whole frame moved too, which blurs what the bursts mean.",
    "motion_bursts": "The lower frame moved in repeated bursts near the device.",
    "motion_local": "The lower frame moved more near the device, without a pattern that tells a kind of touch.",
    "motion_global": "The whole frame moved, so local motion is to be read with care.",
    "no_motion": "No burst of local motion stands out.",
}
EYES = {"typical": "the eyes were open as usual", "reduced": "the eyes were open less than usual", "low": "the eyes were hardly open", "": "how far the eyes were open cannot be told"}
BLINKS = {"elevated_eye_closure": "more samples showed closed eyes", "reduced_eye_openness": "samples showed the eyes less open", "stable": "no change of eye closure stands out", "": "blinking was not measured"}
ACTIONS = ("actions of the face stand out", "no action of the face stands out")
ACTION_LABELS = {"AU4_proxy": "Lowered brow (like AU4)", "AU25_proxy": "Parted lips (like AU25)"}

_own = "trigger IN ('device_interaction_evidence', 'device_region_motion_proxy')"
_rapid, _intermittent = f"({_own} AND motion_pattern = 'rapid_repetitive_local_motion')", f"({_own} AND motion_pattern = 'intermittent_local_motion')"
_said = lambda *rules, default: case(*((c, text(SENTENCES[k])) for c, k in rules), default=text(SENTENCES[default]))
_region = f"status = 'not_reliable' AND device_level IN {MEDIUM_UP}"
NARRATIVES = {
    "interaction": _said(
        (f"status = 'detected' AND {_rapid}", "detected_rapid"), ("status = 'detected'", "detected"), (f"status = 'possible' AND {_rapid}", "possible_rapid"), ("status = 'possible'", "possible"),
        (f"{_region} AND {_rapid}", "region_rapid"), (f"{_region} AND {_intermittent}", "region_intermittent"), (_region, "region"),
        *((f"trigger = '{t}'", t) for t in ("stable_screen_context", "sustained_screen_oriented_proxy", "motion_confounding", "quality_drop")), default="no_interaction",
    ),
    "posture": _said((f"posture_state = 'close_to_screen' AND global_level IN {ACTIVE}", "close_moving"), ("posture_state = 'close_to_screen'", "close"), ("posture_state = 'visible_not_close'", "not_close"), default="no_posture"),
    "screen_orientation": _said(("gaze", "screen"), (f"device_level IN {MEDIUM_UP}", "screen_unsure"), default="no_screen"),
    "motion_context": _said(
        (f"local_level = 'high' AND local_bursts >= 2 AND global_level IN {ACTIVE}", "motion_both"), ("local_level = 'high' AND local_bursts >= 2", "motion_bursts"),
        (f"local_level IN {ACTIVE}", "motion_local"), (f"global_level IN {ACTIVE}", "motion_global"), default="no_motion",
    ),
}


def _named(column: str, table: dict[str, str]) -> str:
    return case(*((f"{column} = {text(k)}", text(v)) for k, v in table.items() if k), default=text(table[""]))


NARRATIVES["facial_cues"] = case(
    ("mesh_level NOT IN ('low', 'medium', 'high', 'very_high')", text(SENTENCES["no_face"])),
    default=f"concat({_named('eye_level', EYES)}, '; ', {_named('blink', BLINKS)}, '; ', CASE WHEN n_codes > 0 THEN {text(ACTIONS[0])} ELSE {text(ACTIONS[1])} END, '.')",
)


def level_phrase(level: Column) -> Column:
    """What a level says about the sampled windows; other values as they are, null as None."""
    known = F.create_map(*[F.lit(x) for pair in LEVEL_PHRASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, level), level, F.lit("None"))


def action_narrative(code: Column, label: Column, intensity: Column) -> Column:
    """A facial action, by its known name, else its label, with its intensity."""
    known = F.create_map(*[F.lit(x) for pair in ACTION_LABELS.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(known, code), label, code, F.lit("unknown_proxy")), F.lit(", "), F.coalesce(intensity, F.lit("unknown")), F.lit(" intensity"))


def event_narratives(events: DataFrame, windows: DataFrame) -> DataFrame:
    """events (person, window_order, trigger) with the sentences of their windows: interaction, posture, facial cues,
    screen orientation and motion context."""
    read = [c for c in ("status", "motion_pattern", "device_level", "posture_state", "global_level", "local_level", "local_bursts", "gaze", "mesh_level", "eye_level", "blink", "n_codes")]
    df = events.join(windows.select("person", "window_order", *read), ["person", "window_order"])
    return df.select(*events.columns, *[F.expr(v).alias(k) for k, v in NARRATIVES.items()])
