"""Manifest, label, audit and evaluation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.core import rules as r
from granary.core.numbers import ORACLE_RINT, py_round
from granary.operators import audits, evaluation, labels, manifest, sampling
from granary.operators.temporal import trace_summary
from granary.queries.evidence import CTES as EVIDENCE
from granary.sources.events import legacy_frames, ordered_events
from granary.sources.records import clips, daily_payloads, label_sheet, prediction_log

R = ORACLE_RINT
LEVELS = "('no_observed_risk', 'mild_risk', 'moderate_risk', 'high_risk', 'insufficient_evidence')"
FIELDS = ["source", "lang", "length_bin"]

PLANTED = "CASE page_id % 4 WHEN 0 THEN ' /home/u/x' WHEN 1 THEN ' 000001_VID_2024_05_06_07 1_VID_2024_05_06_07 clip_03.mp4 clip_4.mp4x' WHEN 2 THEN ' a.PNG b.jpg c.gif d.jpgx' ELSE ' see data/raw/x.json, metadata/y' END"
#: Typed anew for the SQL, in its own quoting.
LEAKS = {
    "raw_data_path": r'''data/[^\s"'']+|/home/|\\\\''', "video_directory_id": r"\b[0-9]{6}_VID_[0-9]{4}_[0-9]{2}_[0-9]{2}_", "raw_clip_filename": r"\bclip_[0-9]+[.]mp4\b", "image_filename": r"(?i)[.](png|jpg|jpeg|bmp)\b",
}

CTES = {
    "ev": EVIDENCE["ev"],
    "c0": "SELECT person, ord // 12 AS clip, count(*) AS n_frames, sum(round_even(value * 100, 0)::bigint)::bigint AS size_bytes, sum(k)::bigint AS k, min(ts) AS ts FROM ev GROUP BY 1, 2",
    "cl": "SELECT person, clip, printf('%06d_VID_%s_%03d', person, strftime(ts, '%Y_%m_%d_%H_%M_%S'), clip) AS name, n_frames, size_bytes, CASE WHEN k % 7 <> 0 THEN k::double END AS seconds, k % 5 <> 4 AS video_available, size_bytes % 11 = 0 AS video_empty, k % 3 <> 0 AS usage_available, CASE WHEN k % 4 <> 0 THEN k % 6 = 1 END AS usage_empty, n_frames AS usage_records, k % 4 <> 1 AS heart_available, k % 8 = 2 AS heart_empty, k % 6 <> 5 AS questionnaire_available, clip % 3 = 0 AS questionnaire_empty, sha256(person::varchar || '-' || (CASE WHEN person % 3 = 0 THEN clip % 2 ELSE 0 END)::varchar) AS questionnaire_sha FROM c0",
    "sg": "SELECT name, split_part(name, '_', 1) AS person_raw, left(name, length(name) - length(split_part(name, '_', -1)) - 1) AS session_key, concat_ws('-', split_part(name, '_', 3), split_part(name, '_', 4), split_part(name, '_', 5)) AS captured_on, concat_ws(':', split_part(name, '_', 6), split_part(name, '_', 7), split_part(name, '_', 8)) AS captured_at, split_part(name, '_', 9) AS clip_raw, split_part(name, '_', 9)::bigint AS clip_index FROM cl",
    "u0": "SELECT *, dense_rank() OVER (ORDER BY person_raw) AS p, min(name) OVER (PARTITION BY person_raw, session_key) AS f, row_number() OVER (PARTITION BY person_raw ORDER BY name) AS c FROM sg",
    "u1": "SELECT *, dense_rank() OVER (PARTITION BY person_raw ORDER BY f) AS s FROM u0",
    "sh": "SELECT person * 1000 + clip * 3 + vote + 2 AS row_index, CASE WHEN person % 4 <> 0 THEN '/videos/' || name || '/clip.mp4' END AS video_path, CASE WHEN vote = 1 THEN concat_ws(' ', printf('archive/%06d_VID_2000_01_01_00_00_00_%03d', person, clip), CASE WHEN person % 4 <> 0 THEN name END) END AS plot_path, CASE WHEN person % 4 = 0 THEN person END AS participant, CASE (size_bytes + vote * n_frames) % 4 WHEN 0 THEN 'no_observed_risk' WHEN 1 THEN 'mild_risk' WHEN 2 THEN 'moderate_risk' ELSE 'high_risk' END AS risk_level FROM cl, range(3) v(vote) WHERE clip % 2 = 0",
    "ti": "SELECT DISTINCT row_index, risk_level, unnest(regexp_extract_all(concat_ws(' ', video_path, plot_path), '([0-9A-Za-z]+_VID_\\d{4}_\\d{2}_\\d{2}_\\d{2}_\\d{2}_\\d{2}_\\d+)', 1)) AS token FROM sh",
    "ml": "SELECT person, clip, name, row_index, risk_level FROM cl LEFT JOIN ti ON name = token",
    "po": "SELECT DISTINCT person, row_index, risk_level, 'clip_matches' AS method FROM ml WHERE row_index IS NOT NULL",
    "pl": "SELECT * FROM po UNION ALL SELECT participant, row_index, risk_level, 'person_fallback' FROM sh WHERE participant IS NOT NULL AND participant NOT IN (SELECT person FROM po)",
    "mv": "SELECT person, method, risk_level, count(*) AS n FROM pl GROUP BY ALL",
    "mr": "SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, risk_level DESC) AS k, lead(n) OVER (PARTITION BY person ORDER BY n DESC, risk_level DESC) AS n2 FROM mv",
    "pd": f"SELECT d.doc_id AS sample_id, d.doc_id * 3 + attempt AS seq, {r.LABEL_OF} AS target, (['no_observed_risk', 'mild_risk', 'moderate_risk', 'high_risk', 'insufficient_evidence', 'severe'])[(n_chars + attempt * 7 + d.doc_id) % 6 + 1] AS predicted, CASE WHEN (d.doc_id + attempt) % 5 = 0 THEN 'timeout' END AS error, source, lang, {r.labels('n_chars', [('< 500', 'short'), ('< 2000', 'medium')], 'long')} AS length_bin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, range(3) a(attempt) WHERE attempt <= d.doc_id % 3",
    "lt": "SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY seq DESC) = 1",
    "vd": f"SELECT * FROM lt WHERE target IN {LEVELS} AND predicted IN {LEVELS}",
    "lv": "SELECT unnest(['no_observed_risk', 'mild_risk', 'moderate_risk', 'high_risk', 'insufficient_evidence']) AS label",
    "cf": "SELECT a.label AS target, b.label AS predicted, count(v.sample_id) AS n FROM lv a CROSS JOIN lv b LEFT JOIN vd v ON v.target = a.label AND v.predicted = b.label GROUP BY ALL",
    "lm0": "SELECT label, (SELECT count(*) FROM vd WHERE target = label) AS support, (SELECT count(*) FROM vd WHERE target = label AND predicted = label) AS tp, (SELECT count(*) FROM vd WHERE predicted = label) AS called FROM lv",
    "lm1": "SELECT *, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS p0, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r0 FROM lm0",
    "lm": "SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0 FROM lm1",
    "ov": "SELECT sum(support)::bigint AS n_valid, sum(tp) / sum(support) AS a, avg(CASE WHEN support > 0 THEN f0 END) AS m, max(support) / sum(support) AS j FROM lm",
    "fv": "SELECT sample_id, target, predicted, unnest(['source', 'lang', 'length_bin']) AS field, unnest([source, lang, length_bin]) AS value FROM lt",
    "ct": f"SELECT *, target IN {LEVELS} AND predicted IN {LEVELS} IS TRUE AS ok, row_number() OVER (PARTITION BY field, value ORDER BY sample_id) AS nth FROM fv",
    "hr": "SELECT person, epoch_ms(ts) AS t, CASE WHEN k % 10 <> 0 THEN value END AS bpm, round_even(value * 100, 0)::bigint AS u FROM ev",
    "hd": "SELECT person, t - lag(t) OVER (PARTITION BY person ORDER BY t) AS d FROM hr",
    "hm": "SELECT person, median(d) AS m FROM hd WHERE d > 0 GROUP BY person",
    "h0": "SELECT person, count(*) AS n, count(bpm) / count(*) AS ratio, CASE WHEN count(*) >= 2 THEN max(t) - min(t) END AS span, CASE WHEN count(bpm) > 0 THEN sum(round_even(bpm * 100, 0)::bigint) / count(bpm) / 100 END AS mean_bpm FROM hr GROUP BY person",
    "h1": "SELECT h0.*, CASE WHEN span <= 0 THEN 0 WHEN coalesce(m, span) > 100 THEN span / 1000 ELSE span END AS seconds FROM h0 LEFT JOIN hm USING (person)",
    "us": "SELECT person, count(*) AS n, sum(u) AS total, CASE WHEN sum(u) > 0 THEN max(u) / sum(u) END AS share FROM hr GROUP BY person",
    "oq": "SELECT row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c, event_type, value FROM events",
    "jr": """SELECT conv_id, turn, role, CASE turn % 6 WHEN 0 THEN '{"risk_level": "mild_risk", "turn": ' || turn || '}' WHEN 1 THEN '```json\n{"risk_level": "high_risk"}\n```' WHEN 2 THEN 'Result: {"risk_level": "severe"} as asked' WHEN 3 THEN 'no object here' WHEN 4 THEN '' ELSE '{broken' END AS response FROM conversations""",
}


def sql(final: str, more: dict[str, str] | None = None) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in {**CTES, **(more or {})}.items()) + "\n" + final


def _t(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


events, documents, label_table, pages, conversations = map(_t, ("events", "documents", "labels", "pages", "conversations"))


def _clips(s, d):
    return clips(events(s, d))


def _latest(s, d):
    return evaluation.latest(prediction_log(documents(s, d), label_table(s, d)))


def segment_parse(s: SparkSession, d: str) -> DataFrame:
    return manifest.parse_segments(_clips(s, d)).select("name", "person_raw", "session_key", "captured_on", "captured_at", "clip_raw", F.col("clip_index").cast("long").alias("clip_index"))


def uid_assignment(s, d):
    return manifest.with_uids(manifest.parse_segments(_clips(s, d))).select("name", "person_uid", "session_uid", "clip_uid")


def person_rollup(s, d):
    df = manifest.with_uids(manifest.parse_segments(_clips(s, d)))
    flat = manifest.flatten_clips(manifest.person_manifest(df))
    return flat.groupBy("person").agg(F.count_distinct("session_uid").alias("n_sessions"), F.count(F.lit(1)).alias("n_clips"), F.min("name").alias("first_name"), F.max("clip_uid").alias("last_uid"))


def timeline(s, d):
    df = sampling.with_start_offset(_clips(s, d), ["person"], "clip", "seconds")
    return df.select("person", "clip", "seconds", "start_offset", sampling.relative_period(F.col("start_offset"), F.col("seconds")).alias("period"))


def relative_position(s, d):
    return ordered_events(events(s, d)).select("person", "ord", F.expr(r.position("ord", "n")).alias("position"), F.expr(r.position("ord", "n", "single")).alias("position_old"))


def coverage_even_sample(s, d):
    n = ordered_events(events(s, d)).groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    return n.select("person", F.posexplode(sampling.even_indices(F.col("n"), 12)).alias("nth", "index")).select("person", F.col("nth").cast("long").alias("nth"), "index")


def frame_index_sample(s, d):
    n = ordered_events(events(s, d)).groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    return n.select("person", F.posexplode(sampling.frame_indices(F.col("n"), 6)).alias("nth", "index")).select("person", F.col("nth").cast("long").alias("nth"), "index")


def _matched(s, d):
    e = events(s, d)
    return labels.clip_labels(clips(e), label_sheet(e), ["video_path", "plot_path"])


def label_token_join(s, d):
    return _matched(s, d).select("person", "clip", "row_index", "risk_level")


def _person_labels(s, d):
    e = events(s, d)
    return labels.person_labels(clips(e).select("person").distinct(), _matched(s, d), label_sheet(e))


def label_majority(s, d):
    return labels.majority(_person_labels(s, d), ["person"])


def label_fallback(s, d):
    return _person_labels(s, d).groupBy("person", "method").agg(F.count(F.lit(1)).alias("n_rows"))


def clip_label_coverage(s, d):
    return labels.coverage(_matched(s, d))


def descriptive_stats(s, d):
    return audits.descriptive(events(s, d), ["event_type"], "value")


def heart_rate_audit(s, d):
    return audits.heart_rate(daily_payloads(events(s, d)).select("person", F.col("heart").alias("items")))


def usage_audit(s, d):
    return audits.usage(daily_payloads(events(s, d)).select("person", F.col("used").alias("items")))


def privacy_patterns(s, d):
    planted = F.expr(f"concat(html, {PLANTED})")
    return audits.blocked_text(pages(s, d).withColumn("html", planted), "page_id", "html").select("page_id", "pattern", F.col("n").cast("long").alias("n"))


def privacy_flags(s, d):
    df = documents(s, d).select("doc_id", (F.col("doc_id") % 3 == 0).alias("has_path"), F.when(F.col("doc_id") % 5 != 0, F.lit(False)).alias("has_name"), F.lit(False).alias("has_image"))
    return audits.flag_violations(df, "doc_id", ["has_path", "has_name", "has_image"])


def risk_label_mapping(s, d):
    said = label_table(s, d).select("doc_id", F.expr("CASE toxic WHEN 0 THEN ' 否' WHEN 1 THEN '是 ' END").alias("concern"), F.expr("CASE doc_id % 5 WHEN 0 THEN '轻度' WHEN 1 THEN '中度' WHEN 2 THEN ' 重度' WHEN 3 THEN '' END").alias("grade"))
    return said.select("doc_id", labels.risk_level(F.col("concern"), F.col("grade")).alias("risk_level"))


def session_pseudonym(s, d):
    return _clips(s, d).select("name", audits.pseudonym(F.lit("salt"), F.col("name")).alias("alias"))


def resume_antijoin(s, d):
    docs = documents(s, d).select(F.col("doc_id").alias("sample_id"))
    return evaluation.pending(docs, prediction_log(documents(s, d), label_table(s, d)))


def alignment(s, d):
    df = trace_summary(legacy_frames(events(s, d)))
    label = F.expr("CASE person % 4 WHEN 0 THEN 'no_observed_risk' WHEN 1 THEN 'mild_risk' WHEN 2 THEN 'moderate_risk' ELSE 'high_risk' END")
    return df.withColumn("label", label)


FEATURES = ["trace_score", "p_active", "p_direct", "p_stable", "n"]


def alignment_means(s, d):
    return evaluation.means_by_label(alignment(s, d), FEATURES)


def alignment_direction(s, d):
    return evaluation.directions(alignment_means(s, d))


def discordance(s, d):
    return evaluation.discordance(alignment(s, d)).select("person", "label", "flags")


def json_salvage(s, d):
    response = F.expr("CASE turn % 6 WHEN 0 THEN concat('{\"risk_level\": \"mild_risk\", \"turn\": ', turn, '}') WHEN 1 THEN '```json\\n{\"risk_level\": \"high_risk\"}\\n```' WHEN 2 THEN 'Result: {\"risk_level\": \"severe\"} as asked' WHEN 3 THEN 'no object here' WHEN 4 THEN '' ELSE '{broken' END")
    return evaluation.salvaged_json(conversations(s, d).withColumn("response", response)).select("conv_id", "turn", "level", "problem")


def chat_messages(s, d):
    df = conversations(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size")))).alias("m"))
    return df.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["role"]), ">").alias("roles"), F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x["size"]).alias("n_chars"))


def merge_plan(s, d):
    c = _clips(s, d).select(F.col("name").alias("path"), "size_bytes", "clip", "person")
    source = c.filter("clip % 3 <> 0").select("path", F.col("size_bytes").alias("size"))
    target = c.filter("clip % 3 <> 1").select("path", F.when(F.col("person") % 2 == 0, F.col("size_bytes")).otherwise(F.col("size_bytes") + 1).alias("size"))
    return manifest.merge_plan(source, target)


BINS = {
    "ratio": (r.ratio_bin, "value / 490"), "old_ratio": (r.legacy_ratio_bin, "value / 490"), "activity": (r.activity_ratio_bin, "value / 490"), "shares": (r.share_level, "value / 490"), "range": (r.share_range, "value / 490"), "density": (r.activity_level, "value / 490"),
    "counts": (r.count_level, "k"), "old_counts": (r.count_bin, "k"), "points": (r.point_level, "k"), "audit_n": (r.audit_count, "k"), "episode": (r.episode_duration, "k"), "light": (r.lighting, "value"), "sharp": (r.blur, "value"), "clip_time": (r.clip_duration, "value"), "minutes": (r.duration_minutes, "(value * 10)"),
    "continuous": (r.continuous_duration, "k"), "megabytes": (r.size_mb, "value"), "face": (r.face_size, "value / 490"), "eyes": (r.eye_openness, "value / 490"), "seconds": (r.audit_seconds, "value * 5"), "share": (r.audit_ratio, "value / 490"), "bpm": (r.audit_bpm, "value"),
}


def bins(s, d):
    df = ordered_events(events(s, d))
    return df.select("event_id", *[F.expr(f("(" + x + ")")).alias(k) for k, (f, x) in BINS.items()], F.expr(r.coarse_minutes("(value * 10)")).alias("coarse"), F.expr(r.motion_level("value", "100")).alias("motion"), F.expr(r.level_bin("value", "4.0", "12.0", "24.0")).alias("level"))


def rounding(s, d):
    df = ordered_events(events(s, d))
    return df.select("event_id", *[F.expr(py_round(f"(k / 80.0D)" if n == 3 else "(value / 490)", n)).alias(f"r{n}") for n in (2, 3, 4)])



QUERIES = {
    "segment_parse": segment_parse, "uid_assignment": uid_assignment, "person_rollup": person_rollup, "modality_completeness": lambda s, d: manifest.completeness(_clips(s, d)), "questionnaire_consistency": lambda s, d: manifest.questionnaire_consistency(_clips(s, d)),
    "data_quality": lambda s, d: manifest.data_quality(_clips(s, d)), "timeline_offsets": timeline, "relative_position": relative_position, "coverage_even_sample": coverage_even_sample, "frame_index_sample": frame_index_sample,
    "label_token_join": label_token_join, "label_majority": label_majority, "label_fallback": label_fallback, "clip_label_coverage": clip_label_coverage, "descriptive_stats": descriptive_stats, "heart_rate_audit": heart_rate_audit, "usage_audit": usage_audit,
    "payload_reuse": lambda s, d: audits.payload_reuse(_clips(s, d), "questionnaire_sha"), "privacy_patterns": privacy_patterns, "privacy_flags": privacy_flags, "session_pseudonym": session_pseudonym, "risk_label_mapping": risk_label_mapping,
    "latest_prediction": lambda s, d: _latest(s, d).select("sample_id", "seq", "target", "predicted", "error"), "resume_antijoin": resume_antijoin, "confusion_dense": lambda s, d: evaluation.confusion(_latest(s, d)),
    "label_metrics": lambda s, d: evaluation.label_metrics(_latest(s, d)), "macro_f1": lambda s, d: evaluation.overall(_latest(s, d)).select("n_valid", "accuracy", "macro_f1"), "majority_baseline": lambda s, d: evaluation.overall(_latest(s, d)).select("n_valid", "majority_accuracy", "gain"),
    "feature_crosstab": lambda s, d: evaluation.crosstab(_latest(s, d), FIELDS), "feature_distribution": lambda s, d: evaluation.distribution(_latest(s, d), FIELDS), "error_patterns": lambda s, d: evaluation.error_patterns(_latest(s, d), FIELDS),
    "alignment_means": alignment_means, "alignment_direction": alignment_direction, "discordance": discordance, "json_salvage": json_salvage, "chat_messages": chat_messages, "merge_plan": merge_plan, "bins": bins, "py_rounding": rounding,
}

full = lambda m: f"coalesce(count_if({m}_available AND NOT coalesce({m}_empty, false)), 0)::bigint"
EVEN = f"CASE WHEN n <= 12 THEN i ELSE {R.format('i * (n - 1) / 11.0::double')}::bigint END"
ALIGN = {k: v for k, v in EVIDENCE.items()} | {"al": "SELECT *, CASE person % 4 WHEN 0 THEN 'no_observed_risk' WHEN 1 THEN 'mild_risk' WHEN 2 THEN 'moderate_risk' ELSE 'high_risk' END AS label FROM tr"}
ALIGN |= {"am0": " UNION ALL ".join(f"SELECT label, '{f}' AS feature, {f}::double AS v FROM al" for f in FEATURES), "am": f"SELECT label, feature, count(*) AS n, {py_round('avg(v)', 4, R)} AS mean, {py_round('min(v)', 4, R)} AS least, {py_round('max(v)', 4, R)} AS most FROM am0 GROUP BY label, feature"}
ALIGN |= {"ad": "SELECT feature, mean - lag(mean) OVER (PARTITION BY feature ORDER BY list_position(['no_observed_risk', 'mild_risk', 'moderate_risk', 'high_risk'], label)) AS step FROM am"}


def _align(final: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ALIGN.items()) + "\n" + final


def _signed(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN -{py_round(f'-({x})', 4, R)} ELSE {py_round(x, 4, R)} END"


_show = lambda x: f"printf('%02d:%02d', {x} // 60, {x} % 60)"
_half = lambda x: f"({R.format(f'({x}) / 30')} * 30)::bigint"
ORACLE = {
    "segment_parse": sql("SELECT * FROM sg"),
    "uid_assignment": sql("SELECT name, printf('internal_p%06d', p) AS person_uid, printf('internal_p%06d_s%04d', p, s) AS session_uid, printf('internal_p%06d_c%06d', p, c) AS clip_uid FROM u1"),
    "person_rollup": sql("SELECT person_raw::bigint AS person, count(DISTINCT session_key) AS n_sessions, count(*) AS n_clips, min(name) AS first_name, max(printf('internal_p%06d_c%06d', p, c)) AS last_uid FROM u1 GROUP BY 1"),
    "modality_completeness": sql(f"SELECT person, count(*) AS n_clips, count_if(video_available)::bigint AS n_video, coalesce(sum(CASE WHEN usage_available THEN usage_records END), 0)::bigint AS n_usage_records, {full('usage')} AS n_usage, {full('heart')} AS n_heart, {full('questionnaire')} > 0 AS has_questionnaire FROM cl GROUP BY person"),
    "questionnaire_consistency": sql("SELECT person, nullif(count(DISTINCT CASE WHEN questionnaire_available THEN questionnaire_sha END), 0) AS n_payloads, CASE WHEN count_if(questionnaire_available) > 0 THEN count(DISTINCT CASE WHEN questionnaire_available THEN questionnaire_sha END) <= 1 END AS same, coalesce(count_if(questionnaire_available AND NOT questionnaire_empty), 0)::bigint AS n_full, coalesce(count_if(questionnaire_available AND questionnaire_empty), 0)::bigint AS n_empty, (list(questionnaire_sha ORDER BY questionnaire_empty, clip) FILTER (WHERE questionnaire_available))[1] AS representative FROM cl GROUP BY person"),
    "data_quality": sql(" UNION ALL ".join(f"SELECT '{m}' AS modality, count(*) AS n_clips, coalesce(count_if(NOT {m}_available), 0)::bigint AS n_missing, coalesce(count_if({m}_available AND coalesce({m}_empty, false)), 0)::bigint AS n_empty FROM cl" for m in manifest.MODALITIES)),
    "timeline_offsets": sql(f"SELECT person, clip, seconds, start_offset, CASE WHEN seconds IS NOT NULL THEN {_show(_half('start_offset'))} || ' - ' || {_show(_half('start_offset + seconds'))} END AS period FROM (SELECT *, coalesce(sum(coalesce(seconds, 0)) OVER (PARTITION BY person ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_offset FROM cl)"),
    "relative_position": sql(f"SELECT person, ord, {r.position('ord', 'n')} AS position, {r.position('ord', 'n', 'single')} AS position_old FROM ev"),
    "coverage_even_sample": sql(f'SELECT person, i AS nth, {EVEN} AS "index" FROM (SELECT DISTINCT person, n FROM ev), range(12) g(i) WHERE i < n'),
    "frame_index_sample": sql(f"SELECT person, i AS nth, least(n - 1, {R.format('floor(n * 0.1::double) + i * ((greatest(floor(n * 0.1::double), floor(n * 0.9::double)) - floor(n * 0.1::double)) / 5)')})::bigint AS \"index\" FROM (SELECT DISTINCT person, n FROM ev), range(6) g(i)"),
    "label_token_join": sql("SELECT person, clip, row_index, risk_level FROM ml"),
    "label_majority": sql("SELECT a.person, t.n_rows, coalesce(a.n = a.n2, false) AS has_tie, CASE WHEN a.n = a.n2 THEN 'insufficient_evidence' ELSE a.risk_level END AS majority, t.counts FROM mr a JOIN (SELECT person, sum(n)::bigint AS n_rows, string_agg(risk_level || '=' || n, ';' ORDER BY risk_level) AS counts FROM mv GROUP BY person) t USING (person) WHERE a.k = 1"),
    "label_fallback": sql("SELECT person, method, count(*) AS n_rows FROM pl GROUP BY ALL"),
    "clip_label_coverage": sql("SELECT person, count(DISTINCT clip) AS n_clips, count(DISTINCT CASE WHEN row_index IS NOT NULL THEN clip END) AS n_labeled FROM ml GROUP BY person"),
    "descriptive_stats": sql(f"SELECT event_type, max(c) AS n, min(value) AS least, {', '.join(f'max(CASE WHEN i = {R.format(f"(c - 1) * {p}::double")}::bigint THEN value END) AS {k}' for k, p in (('p25', 0.25), ('p75', 0.75), ('p90', 0.9)))}, max(value) AS most, {py_round('quantile_cont(value, 0.5)', 3, R)} AS median, {py_round('avg(value)', 3, R)} AS mean FROM oq GROUP BY event_type"),
    "heart_rate_audit": sql(f"SELECT person, n, {r.audit_count('n')} AS n_bin, {r.audit_ratio('ratio')} AS ratio_bin, {r.audit_seconds('seconds')} AS span_bin, {r.audit_bpm('mean_bpm')} AS bpm_bin, n >= 10 AND ratio >= 0.8::double AS usable FROM h1"),
    "usage_audit": sql(f"SELECT person, n, {r.audit_count('n')} AS n_bin, {r.audit_seconds('(CASE WHEN total > 86400 THEN total / 1000 ELSE total END)')} AS total_bin, {r.audit_ratio('share')} AS share_bin, total IS NOT NULL AS usable FROM us"),
    "payload_reuse": sql(f"SELECT {r.audit_count('n')} AS reuse, count(*) AS n_payloads, sum(n)::bigint AS n_rows FROM (SELECT questionnaire_sha, count(*) AS n FROM cl GROUP BY 1) GROUP BY 1"),
    "privacy_patterns": " UNION ALL ".join(f"SELECT page_id, '{k}' AS pattern, len(regexp_extract_all(concat(html, {PLANTED}), '{p}')) AS n FROM pages WHERE len(regexp_extract_all(concat(html, {PLANTED}), '{p}')) > 0" for k, p in LEAKS.items()),
    "privacy_flags": "SELECT doc_id, (doc_id % 5 = 0)::bigint + (doc_id % 3 = 0)::bigint AS n, concat_ws(';', CASE WHEN doc_id % 5 = 0 THEN 'has_name' END, CASE WHEN doc_id % 3 = 0 THEN 'has_path' END) AS violations FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0",
    "risk_label_mapping": "SELECT doc_id, CASE WHEN toxic = 0 THEN 'no_observed_risk' WHEN toxic = 1 AND doc_id % 5 = 0 THEN 'mild_risk' WHEN toxic = 1 AND doc_id % 5 = 1 THEN 'moderate_risk' WHEN toxic = 1 AND doc_id % 5 = 2 THEN 'high_risk' ELSE 'insufficient_evidence' END AS risk_level FROM labels",
    "session_pseudonym": sql("SELECT name, 'ANON_' || upper(left(sha256('salt:' || name), 10)) AS alias FROM cl"),
    "latest_prediction": sql("SELECT sample_id, seq, target, predicted, error FROM lt"),
    "resume_antijoin": sql(f"SELECT doc_id AS sample_id FROM documents WHERE doc_id NOT IN (SELECT sample_id FROM pd WHERE error IS NULL AND predicted IN {LEVELS})"),
    "confusion_dense": sql("SELECT * FROM cf"),
    "label_metrics": sql(f"SELECT label, support, tp, called, {py_round('p0', 4, R)} AS precision, {py_round('r0', 4, R)} AS recall, {py_round('f0', 4, R)} AS f1 FROM lm"),
    "macro_f1": sql(f"SELECT n_valid, {py_round('a', 4, R)} AS accuracy, {py_round('m', 4, R)} AS macro_f1 FROM ov"),
    "majority_baseline": sql(f"SELECT n_valid, {py_round('j', 4, R)} AS majority_accuracy, {_signed('(a - j)')} AS gain FROM ov"),
    "feature_crosstab": sql(f"SELECT field, value, count(*) AS n, coalesce(count_if(ok), 0)::bigint AS n_valid, CASE WHEN count_if(ok) > 0 THEN {py_round('count_if(ok AND target = predicted) / count_if(ok)', 4, R)} END AS accuracy, string_agg(CASE WHEN nth <= 10 THEN sample_id::varchar END, ';' ORDER BY sample_id) AS preview, (SELECT string_agg(k || '=' || c, ';' ORDER BY k || '=' || c) FROM (SELECT coalesce(target, 'None') AS k, count(*) AS c FROM fv WHERE fv.field = ct.field AND fv.value = ct.value GROUP BY 1)) AS targets, (SELECT string_agg(k || '=' || c, ';' ORDER BY k || '=' || c) FROM (SELECT coalesce(predicted, 'None') AS k, count(*) AS c FROM fv WHERE fv.field = ct.field AND fv.value = ct.value GROUP BY 1)) AS predictions FROM ct GROUP BY field, value"),
    "feature_distribution": sql("SELECT field, value, count(*) AS n FROM fv GROUP BY ALL"),
    "error_patterns": sql(f"SELECT target || ' -> ' || predicted AS pattern, field, value, count(*) AS n, (SELECT count(*) FROM vd WHERE vd.target = fv.target AND vd.predicted = fv.predicted) AS n_errors FROM fv WHERE target IN {LEVELS} AND predicted IN {LEVELS} AND target <> predicted GROUP BY target, predicted, field, value"),
    "alignment_means": _align("SELECT * FROM am"),
    "alignment_direction": _align("SELECT feature, count(*) AS n_labels, CASE WHEN count(*) < 2 THEN 'insufficient_labels' WHEN bool_and(coalesce(step >= 0, true)) AND bool_and(coalesce(step <= 0, true)) THEN 'flat_or_tied' WHEN bool_and(coalesce(step >= 0, true)) THEN 'monotonic_increasing_with_label' WHEN bool_and(coalesce(step <= 0, true)) THEN 'monotonic_decreasing_with_label' ELSE 'mixed_or_non_monotonic' END AS direction FROM ad GROUP BY feature"),
    "discordance": _align("SELECT * FROM (SELECT person, label, concat_ws(';', CASE WHEN label = 'no_observed_risk' AND trace_score >= 4 THEN 'no_label_but_trace_score_moderate_or_high' END, CASE WHEN label = 'no_observed_risk' AND (p_active >= 4 OR p_direct >= 3 OR p_repetitive >= 3) THEN 'no_label_but_active_or_repetitive_video_signal' END, CASE WHEN label IN ('moderate_risk', 'high_risk') AND trace_score <= 1 THEN 'risk_label_but_trace_score_low' END, CASE WHEN label IN ('moderate_risk', 'high_risk') AND p_active = 0 AND p_repetitive = 0 AND p_stable < 20 THEN 'risk_label_but_low_video_behavior_signal' END) AS flags FROM al) WHERE flags <> ''"),
    "json_salvage": "SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'mild_risk' WHEN 1 THEN 'high_risk' WHEN 2 THEN 'severe' END AS level, CASE turn % 6 WHEN 2 THEN 'invalid_risk_level:severe' WHEN 3 THEN 'no_json_object_found' WHEN 4 THEN 'no_json_object_found' WHEN 5 THEN 'no_json_object_found' END AS problem FROM conversations",
    "chat_messages": "SELECT conv_id, count(*) AS n_messages, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::bigint AS n_chars FROM conversations GROUP BY conv_id",
    "merge_plan": sql("SELECT coalesce(a.name, b.name) AS path, a.size_bytes AS source_size, b.size AS target_size, CASE WHEN b.name IS NULL THEN 'add' WHEN a.name IS NULL THEN 'keep' WHEN a.size_bytes = b.size THEN 'duplicate' ELSE 'conflict' END AS action FROM (SELECT * FROM cl WHERE clip % 3 <> 0) a FULL JOIN (SELECT name, CASE WHEN person % 2 = 0 THEN size_bytes ELSE size_bytes + 1 END AS size FROM cl WHERE clip % 3 <> 1) b ON a.name = b.name"),
    "bins": sql(f"SELECT event_id, {', '.join(f'{f("(" + x + ")")} AS {k}' for k, (f, x) in BINS.items())}, {r.coarse_minutes('(value * 10)', R)} AS coarse, {r.motion_level('value', '100')} AS motion, {r.level_bin('value', '4.0', '12.0', '24.0')} AS level FROM ev"),
    "py_rounding": sql(f"SELECT event_id, {', '.join(f'{py_round("(k / 80.0::double)" if n == 3 else "(value / 490)", n, R)} AS r{n}' for n in (2, 3, 4))} FROM ev"),
}
