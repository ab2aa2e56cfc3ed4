"""Prediction logs, metrics and diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.core.numbers import py_round
from granary.core.rules import RISK_LABELS

LEVELS = list(RISK_LABELS)


def latest(log: DataFrame, key: str = "sample_id", order: str = "seq") -> DataFrame:
    """The last entry of each sample."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def pending(samples: DataFrame, log: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples without a valid prediction free of error in the log."""
    done = log.filter(F.col("error").isNull() & F.col("predicted").isin(LEVELS)).select(key).distinct()
    return samples.join(done, key, "left_anti")


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("target").isin(LEVELS) & F.col("predicted").isin(LEVELS))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts for every pair of the five labels, zeros included."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in LEVELS for b in LEVELS], "target string, predicted string")
    counts = valid(rows).groupBy("target", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(F.broadcast(counts), ["target", "predicted"], "left").fillna(0, ["n"])  # 25 rows at most


def label_metrics(rows: DataFrame, rounded: bool = True) -> DataFrame:
    """Precision, recall, F1 and support of each label."""
    cells = confusion(rows)
    by_target = cells.groupBy(F.col("target").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    by_prediction = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    df = by_target.join(by_prediction, "label").withColumns({"precision": share(F.col("tp"), F.col("called")), "recall": share(F.col("tp"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    df = df.withColumn("f1", share(2 * p * r, p + r))
    return df.withColumns({c: F.expr(py_round(c, 4)) for c in ("precision", "recall", "f1")}) if rounded else df


def overall(rows: DataFrame) -> DataFrame:
    """One row: valid predictions, accuracy, macro F1 over labels that occur, and the gain over the majority label."""
    m = label_metrics(rows, rounded=False)
    total, right = F.sum("support"), F.sum("tp")
    df = m.agg(total.alias("n_valid"), (right / total).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"), (F.max("support") / total).alias("majority_accuracy"))
    df = df.withColumn("gain", F.col("accuracy") - F.col("majority_accuracy")).fillna(0.0)
    return df.select("n_valid", *[F.expr(py_round(c, 4)).alias(c) for c in ("accuracy", "macro_f1", "majority_accuracy")], F.expr(f"CASE WHEN gain < 0 THEN -{py_round('-gain', 4)} ELSE {py_round('gain', 4)} END").alias("gain"))


def unpivoted(rows: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """Rows (keep..., field, value) for each field; null values read <missing>."""
    each = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("<missing>")).alias("value")) for f in fields]
    return rows.select(*keep, F.inline(F.array(*each)))


def _counter(df: DataFrame, column: str, name: str) -> DataFrame:
    """Counts by value of a column for each field and value as value=n;…; null reads None."""
    summed = df.groupBy("field", "value", F.coalesce(column, F.lit("None")).alias("_k")).agg(F.sum("_n").alias("_n"))
    return summed.groupBy("field", "value").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "_k", F.col("_n").cast("string")))), ";").alias(name))


def crosstab(rows: DataFrame, fields: list[str]) -> DataFrame:
    """For each field and value: rows, counts of targets and of predictions, valid predictions, accuracy and the first
    ten sample ids.

    Rows are counted by field, value, target and prediction before they are shuffled, and all else comes from these
    counts; of ids each task passes on ten for a value at most.
    """
    long = unpivoted(rows, fields, ["sample_id", "target", "predicted"])
    cells = long.groupBy("field", "value", "target", "predicted").agg(F.count(F.lit(1)).alias("_n"))
    ok = F.coalesce(F.col("target").isin(LEVELS) & F.col("predicted").isin(LEVELS), F.lit(False))
    held = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    counts = cells.groupBy("field", "value").agg(F.sum("_n").alias("n"), held(ok).alias("n_valid"), held(ok & (F.col("target") == F.col("predicted"))).alias("n_right"))
    first = long.select("field", "value", "sample_id").withColumn("_nth", F.row_number().over(Window.partitionBy("field", "value").orderBy("sample_id"))).filter("_nth <= 10")
    ids = first.groupBy("field", "value").agg(F.array_sort(F.collect_list("sample_id")).alias("_ids"))
    df = counts.join(ids, ["field", "value"]).join(_counter(cells, "target", "targets"), ["field", "value"]).join(_counter(cells, "predicted", "predictions"), ["field", "value"])
    return df.select("field", "value", "n", "targets", "predictions", "n_valid", F.when(F.col("n_valid") > 0, F.expr(py_round("n_right / nullif(n_valid, 0)", 4))).alias("accuracy"), F.array_join("_ids", ";").alias("preview"))


def distribution(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Counts of each value of each field."""
    return unpivoted(rows, fields, []).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def error_patterns(rows: DataFrame, fields: list[str]) -> DataFrame:
    """For each wrong pair `target -> predicted`: how many, and the counts of the fields' values."""
    wrong = valid(rows).filter("target <> predicted").withColumn("pattern", F.concat_ws(" -> ", "target", "predicted"))
    long = unpivoted(wrong, fields, ["pattern"]).groupBy("pattern", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    return long.join(wrong.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_errors")), "pattern")


def means_by_label(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Count, mean, least and greatest value of each feature by label."""
    each = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]
    long = rows.select(label, F.inline(F.array(*each))).filter("v IS NOT NULL")
    out = {"mean": "avg(v)", "least": "min(v)", "most": "max(v)"}
    return long.groupBy(label, "feature").agg(F.count(F.lit(1)).alias("n"), *[F.expr(py_round(v, 4)).alias(k) for k, v in out.items()])


def directions(means: DataFrame, label: str = "label") -> DataFrame:
    """Whether a feature's means rise or fall along the risk labels."""
    rank: Column = F.array_position(F.array(*map(F.lit, LEVELS[:4])), F.col(label))
    w = Window.partitionBy("feature").orderBy("_rank")
    df = means.withColumn("_rank", rank).filter("_rank > 0").withColumn("_step", F.col("mean") - F.lag("mean").over(w))
    df = df.groupBy("feature").agg(F.count(F.lit(1)).alias("n_labels"), F.every(F.coalesce(F.col("_step") >= 0, F.lit(True))).alias("_up"), F.every(F.coalesce(F.col("_step") <= 0, F.lit(True))).alias("_down"))
    direction = F.when(F.col("n_labels") < 2, "insufficient_labels").when(F.col("_up") & F.col("_down"), "flat_or_tied").when(F.col("_up"), "monotonic_increasing_with_label").when(F.col("_down"), "monotonic_decreasing_with_label").otherwise("mixed_or_non_monotonic")
    return df.select("feature", "n_labels", direction.alias("direction"))


def discordance(rows: DataFrame) -> DataFrame:
    """Samples whose label and video evidence disagree, with the sorted names of the rules."""
    found = F.array_compact(
        F.array(
            F.when((F.col("label") == "no_observed_risk") & (F.col("trace_score") >= 4), "no_label_but_trace_score_moderate_or_high"),
            F.when((F.col("label") == "no_observed_risk") & ((F.col("p_active") >= 4) | (F.col("p_direct") >= 3) | (F.col("p_repetitive") >= 3)), "no_label_but_active_or_repetitive_video_signal"),
            F.when(F.col("label").isin("moderate_risk", "high_risk") & (F.col("trace_score") <= 1), "risk_label_but_trace_score_low"),
            F.when(F.col("label").isin("moderate_risk", "high_risk") & (F.col("p_active") == 0) & (F.col("p_repetitive") == 0) & (F.col("p_stable") < 20), "risk_label_but_low_video_behavior_signal"),
        )
    )
    return rows.withColumn("flags", F.array_join(found, ";")).filter("flags <> ''")


def salvaged_json(df: DataFrame, column: str = "response") -> DataFrame:
    """df with level and problem of a model's answer: fenced or surrounded JSON objects are found, all else is an error."""
    bare = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^\s+|\s+$", ""))
    bare = F.when(bare.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", ""))).otherwise(bare)
    whole = F.try_parse_json(bare).isNotNull()
    body = F.when(whole, bare).otherwise(F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    level = F.get_json_object(body, "$.risk_level")
    problem = (
        F.when(body == "", "no_json_object_found").when(F.try_parse_json(body).isNull(), "json_decode_error").when(~body.startswith("{"), "json_response_not_object")
        .when(~F.coalesce(level.isin(LEVELS), F.lit(False)), F.concat(F.lit("invalid_risk_level:"), F.coalesce(level, F.lit("None"))))
    )
    return df.withColumns({"level": level, "problem": problem})
