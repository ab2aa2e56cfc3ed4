"""Evidence facts, packages for a text-only model, their validation, messages and an offline scorer."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.core import rules
from granary.operators.audits import MUST_BE_FALSE, pseudonym

VERSION = "granary_evidence.v1"
#: Sections of a package and the fields that each must have.
SECTIONS = {
    "session_metadata": ("session_id", "duration_bin", "n_windows", "n_events"),
    "global_features": ("interaction_intensity", "repetition", "confounding", "orientation", "blink", "posture_trend", "trajectory"),
    "quality_summary": ("sufficiency", "confounding"),
    "privacy": MUST_BE_FALSE,
}
RULES = (
    "Judge by this text alone.",
    "Weigh the role of each fact, how many windows hold it, how long it lasts and how well it was seen.",
    "Where key behaviour could not be seen, lower the confidence and consider insufficient_evidence.",
    "Name supporting and limiting evidence, what is missing, and whether a person should review. This is screening, not diagnosis.",
)


def fact_lists(summary: DataFrame, detectors: DataFrame, events: DataFrame) -> DataFrame:
    """Five lists of sentences for each person: positive, weak, counter, limits and auxiliary, from counts of states and events."""
    fired = detectors.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("detector", "role", "strength", "n_windows"))).alias("fired"))
    strong = events.groupBy("person").agg(F.count_if(F.col("trigger") == "device_interaction_evidence").alias("n_interaction_events"), F.count_if(F.col("trigger") == "quality_drop").alias("n_quality_events"), F.count_if(F.col("trigger") == "facial_au_trend").alias("n_face_events"), F.count_if(F.col("trigger") == "blink_rate_change").alias("n_blink_events"))
    df = summary.join(fired, "person", "left").join(strong, "person", "left").fillna(0, ["n_interaction_events", "n_quality_events", "n_face_events", "n_blink_events"])
    when = lambda cond, text, *cols: F.when(F.expr(cond), F.format_string(text, *map(F.col, cols)))
    by_role = lambda role: F.transform(F.filter(F.coalesce("fired", F.array().cast("array<struct<detector:string,role:string,strength:string,n_windows:bigint>>")), lambda d: d["role"] == role), lambda d: F.format_string("%s held over %d windows (%s).", d["detector"], d["n_windows"], d["strength"]))
    lists = {
        "positive": F.concat(F.array_compact(F.array(when("n_confirmed > 0", "Hand and device moved together in %d windows.", "n_confirmed"), when("n_interaction_events > 0", "%d selected events show interaction.", "n_interaction_events"))), by_role("strong_behavior_evidence")),
        "weak": F.concat(F.array_compact(F.array(when("n_possible > 0", "Interaction was possible in %d windows.", "n_possible"), when("n_passive > 0", "The screen was faced in %d windows.", "n_passive"), when("n_weak > 0", "Only the device region moved in %d windows.", "n_weak"))), by_role("weak_proxy_evidence")),
        "counter": F.concat(F.array_compact(F.array(when("n_confirmed = 0", "No window confirms interaction."))), by_role("counter_evidence")),
        "limits": F.array_compact(F.array(when("n_limited > 0", "%d windows could not be judged.", "n_limited"), when("n_quality_events > 0", "%d selected events are drops in quality.", "n_quality_events"))),
        "auxiliary": F.array_compact(F.array(when("n_close > 0", "The face was close to the screen in %d windows.", "n_close"), when("n_face_events > 0", "%d selected events show actions of the face.", "n_face_events"), when("n_blink_events > 0", "%d selected events show a change of blinking.", "n_blink_events"))),
    }
    return df.select("person", *[c.alias(n) for n, c in lists.items()])


def evidence_records(session: DataFrame, interaction: DataFrame, summary: DataFrame, facts: DataFrame, events: DataFrame, targets: DataFrame | None = None, salt: str = "granary") -> DataFrame:
    """One nested public record for each person; the target label, where known, stays beside it, never inside.

    Persons go by a salted pseudonym, in sample_id and in the record; who is to publish records chooses a secret salt.
    """
    alias = lambda: pseudonym(F.lit(salt), F.col("person").cast("string"))
    picked = events.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("window_order", "trigger", "event_id"))).alias("events"))
    df = session.join(interaction.select("person", "intensity", "repetition"), "person").join(summary.select("person", "trajectory", "interaction_pattern", "session_state", "n_limited"), "person").join(facts, "person").join(picked, "person", "left")
    none = F.lit(False)
    evidence = F.struct(
        F.lit(VERSION).alias("schema_version"),
        F.struct(alias().alias("session_id"), F.expr(rules.duration_minutes("n_windows * 300")).alias("duration_bin"), F.col("n_windows").alias("n_windows"), F.coalesce(F.size("events"), F.lit(0)).alias("n_events")).alias("session_metadata"),
        F.struct(F.col("intensity").alias("interaction_intensity"), "repetition", "confounding", F.col("orientation_v1").alias("orientation"), F.col("blink_v1").alias("blink"), "posture_trend", "trajectory", "interaction_pattern", "session_state").alias("global_features"),
        F.coalesce("events", F.array().cast("array<struct<window_order:bigint,trigger:string,event_id:string>>")).alias("events"),
        F.struct(F.expr(rules.sufficiency("n_windows", "(cast(n_windows - n_limited as double) / n_windows)")).alias("sufficiency"), "confounding").alias("quality_summary"),
        F.struct("positive", "weak", "counter", "limits", "auxiliary").alias("facts"),
        F.struct(*[none.alias(f) for f in SECTIONS["privacy"]]).alias("privacy"),
    )
    df = df.select(alias().alias("sample_id"), evidence.alias("evidence"))
    if targets is None:
        return df
    known = targets.select(alias().alias("sample_id"), F.struct(F.col("majority").alias("risk_level"), F.col("majority").isNotNull().alias("available")).alias("target_label"))
    return df.join(known, "sample_id", "left")


def validation_errors(df: DataFrame, column: str = "evidence") -> DataFrame:
    """df with errors: what the record's schema lacks or has too much, and flags that are not false."""
    fields = {f.name: f for f in df.schema[column].dataType.fields}
    fixed = [f"missing section {s}" for s in SECTIONS if s not in fields]
    fixed += [f"missing field {s}.{f}" for s, names in SECTIONS.items() if s in fields for f in names if f not in fields[s].dataType.names]
    fixed += [f"unknown section {s}" for s in fields if s not in {*SECTIONS, "schema_version", "events", "facts"}]
    checks = [F.when(F.col(f"{column}.schema_version").eqNullSafe(F.lit(VERSION)), None).otherwise("wrong schema_version")] if "schema_version" in fields else [F.lit("missing schema_version")]
    if "privacy" in fields:
        checks += [F.when(~F.coalesce(~F.col(f"{column}.privacy.{f}"), F.lit(False)), f"privacy flag {f} is not false") for f in SECTIONS["privacy"] if f in fields["privacy"].dataType.names]
    return df.withColumn("errors", F.array_compact(F.array(*map(F.lit, fixed), *checks)))


def text_evidence(column: str = "evidence") -> Column:
    """The record as deterministic JSON text, nulls included."""
    return F.to_json(F.col(column), {"ignoreNullFields": "false"})


def messages(column: str = "evidence") -> Column:
    """System and user messages; only the public record goes into them."""
    system = " ".join(["You screen digital device use from privacy-filtered text.", *RULES])
    ask = 'Answer with one JSON object: {"risk_level": one of ' + ", ".join(rules.RISK_LABELS) + ', "confidence": low, medium or high}.'
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.concat(text_evidence(column), F.lit("\n" + ask))))


def offline_answer(text: str) -> str:
    """A deterministic stand-in for a model: reads the interaction intensity out of the text."""
    level = "moderate_risk" if '"interaction_intensity":"high"' in text else "mild_risk" if '"interaction_intensity":"elevated"' in text else "no_observed_risk"
    return '{"risk_level": "%s", "confidence": "low"}' % level


#: Fixed: parts of error texts after which a call is worth another try.
RETRYABLE = ("http 429", "rate limit", "connection reset", "remote end closed connection", "timed out", "timeout", "temporarily unavailable", "connection aborted")


def retryable(error: Exception) -> bool:
    return any(part in str(error).lower() for part in RETRYABLE)


def budget_parameter(model: str, asked: str = "auto") -> str:
    """The name under which a model takes its token budget."""
    if asked != "auto":
        return asked
    return "max_completion_tokens" if "gpt-5" in model.lower() or re.search(r"(^|[/_-])o[134](?:-|$)", model.lower()) else "max_tokens"


def answered(text: str, answer: Callable[[str], str], max_retries: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """Response, error and attempts of one call; after the k-th retryable failure k times `wait` seconds pass."""
    for attempt in range(1, max_retries + 2):
        try:
            return answer(text), None, attempt
        except Exception as e:
            if attempt > max_retries or not retryable(e):
                return None, str(e), attempt
            sleep(wait * attempt)
    raise AssertionError


def scored(df: DataFrame, messages_col: str = "messages", answer: Callable[[str], str] = offline_answer, max_retries: int = 2, wait: float = 2.0, at_once: int = 8) -> DataFrame:
    """df with response, error and attempts of a scorer, `at_once` calls of a batch side by side; errors that pass are
    tried again."""

    @F.pandas_udf("response string, error string, attempts int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for texts in batches:
                yield pd.DataFrame(list(pool.map(lambda t: answered(t, answer, max_retries, wait), texts)), columns=["response", "error", "attempts"])

    return df.withColumn("_a", run(F.element_at(messages_col, -1)["content"])).select(*df.columns, "_a.response", "_a.error", "_a.attempts")
