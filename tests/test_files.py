import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.operators import audits, labels, manifest, narratives, package
from granary.operators.audits import MUST_BE_FALSE
from granary.plans import extractors
from granary.sources import files, sinks
from granary.streaming.runs import OUT, closed_runs


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def mp4(seconds=90, scale=1000, width=640, height=480):
    mvhd = box(b"mvhd", b"\0" * 12 + struct.pack(">II", scale, seconds * scale) + b"\0" * 80)
    tkhd = box(b"tkhd", b"\0" * 76 + struct.pack(">II", width << 16, height << 16))
    return box(b"ftyp", b"isom") + box(b"moov", mvhd + box(b"trak", tkhd))


def workbook():
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>level</t></is></c></row>'
    rows = '<row r="2"><c r="A2"><v>7</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>8</v></c></row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>person</t></si><si><r><t>mi</t></r><r><t>ld</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="x"><sheetData>{head}{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_video_headers():
    assert files.video_header(mp4()) == (True, 90.0, 640, 480)
    assert files.video_header(b"") == (False, None, None, None) and files.video_header(b"junk" * 50)[0] is False
    assert files.video_header(mp4()[:40])[0] is False


def test_listing_segments_videos_and_sheets(spark, tmp_path):
    good = tmp_path / "root" / "batch" / "p1_VID_2024_01_02_03_04_05_007"
    good.mkdir(parents=True)
    (good / "clip_007.mp4").write_bytes(mp4())
    (good / "usage.json").write_text("[]")
    bad = tmp_path / "root" / "batch" / "p_1_VID_x"
    bad.mkdir()
    (bad / "a.txt").write_text("x")
    skipped = tmp_path / "root" / "manifests" / "p1_VID_2024_01_02_03_04_05_008"
    skipped.mkdir(parents=True)
    (skipped / "usage.json").write_text("[]")
    listed = files.list_files(spark, str(tmp_path / "root"))
    found, invalid = files.segments(listed)
    row = found.first()
    assert found.count() == 1 and (row.person_raw, row.clip_index, row.usage_bytes, row.heart_bytes, row.videos[0].file) == ("p1", 7, 2, None, "clip_007.mp4")
    assert [r.folder for r in invalid.collect()] == ["p_1_VID_x"]
    video = files.probe_videos(spark, str(tmp_path / "root")).first()
    assert (video.readable, video.seconds, video.width) == (True, 90.0, 640)
    (tmp_path / "labels.xlsx").write_bytes(workbook())
    rows = files.read_sheet(spark, str(tmp_path / "labels.xlsx"), ["person", "level", "none"]).collect()
    assert [tuple(r) for r in rows] == [("7", "mild", None, "2"), ("8", "", None, "3")]


def test_jsonl_reads_writes_and_names_bad_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("é", None)], "sample_id string, n long")
    sinks.write_jsonl(df, f"{tmp_path}/x")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_jsonl(df, f"{tmp_path}/x")
    sinks.append_jsonl(df, f"{tmp_path}/x")
    assert files.read_jsonl(spark, f"{tmp_path}/x", df.schema).count() == 4
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{oops\n')
    assert [r.line for r in files.bad_lines(spark, str(tmp_path / "bad.jsonl")).collect()] == [3]
    sinks.write_csv(df, f"{tmp_path}/c", ["n", "absent", "sample_id"])
    back = spark.read.csv(f"{tmp_path}/c", header=True)
    assert back.columns == ["n", "absent", "sample_id"] and {tuple(r) for r in back.collect()} == {("1", None, "a"), (None, None, "é")}
    sinks.write_report(df.filter("n = 1"), f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"sample_id": "a", "n": 1}
    assert sinks.markdown_table(df.filter("n = 1")) == "| sample_id | n |\n| --- | --- |\n| a | 1 |"
    sinks.write_texts(df.select("sample_id", F.lit("t").alias("text")), f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").filter("sample_id = 'a'").first().value == "t"


def test_path_fallback_and_merge_plan(spark):
    have = spark.createDataFrame([("/new/a", 1), ("/old/b", 2)], "path string, length int")
    want = spark.createDataFrame([("/old/a",), ("/old/b",), ("/old/c",)], "path string")
    assert {r.path: r.found for r in files.resolved_paths(want, have, "/old/", "/new/").collect()} == {"/old/a": "/new/a", "/old/b": "/old/b", "/old/c": None}
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "path string, size int")
    b = spark.createDataFrame([("y", 2), ("z", 4), ("w", 5)], "path string, size int")
    assert {r.path: r.action for r in manifest.merge_plan(a, b).collect()} == {"x": "add", "y": "duplicate", "z": "conflict", "w": "keep"}


def test_registry_and_validation(spark):
    assert "windows_v2" in extractors.available()
    with pytest.raises(KeyError, match="known: manifest_only"):
        extractors.build("nothing")
    with pytest.raises(ValueError, match="twice"):
        extractors.extractor("trace")(lambda e: e)
    df = spark.sql("SELECT named_struct('schema_version', 'v0', 'surplus', 1, 'quality_summary', named_struct('sufficiency', 'x'), 'privacy', named_struct('raw_video_included', true, 'raw_images_included', false, 'exact_timestamps_included', cast(null as boolean), 'raw_paths_included', false)) AS evidence")
    assert sorted(package.validation_errors(df).first().errors) == sorted([
        "missing section session_metadata", "missing section global_features", "missing field quality_summary.confounding", "unknown section surplus", "wrong schema_version", "privacy flag raw_video_included is not false", "privacy flag exact_timestamps_included is not false",
        *(f"missing field privacy.{f}" for f in MUST_BE_FALSE if f not in ("raw_video_included", "raw_images_included", "exact_timestamps_included", "raw_paths_included")),
    ])


def test_leaks_are_found_by_each_pattern(spark):
    cases = {
        "see data/raw/x.json": "raw_data_path", "metadata/x": "raw_data_path", "in /home/u": "raw_data_path", "a \\\\ share": "raw_data_path", "data/": None, "at /mnt/x": None, "000001_VID_2024_01_02_03": "video_directory_id", "1000001_VID_2024_01_02_03": None,
        "clip_12.mp4": "raw_clip_filename", "clip_1.mp4x": None, "xclip_1.mp4": None, "a.JPG": "image_filename", "b.jpeg!": "image_filename", "c.gif": None, "d.pngs": None, "": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {(r.i, r.pattern) for r in audits.blocked_text(df, "i", "t").collect()}
    assert got == {(i, p) for i, p in enumerate(cases.values()) if p}
    assert len(MUST_BE_FALSE) == 13


def test_segment_tokens_and_risk_levels(spark):
    df = spark.createDataFrame([(1, "/v/P-01_VID_2024_01_02_03_04_05_6/x.mp4 b\\x.y_VID_2024_01_02_03_04_05_7")], "row_index int, p string")
    assert sorted(r.token for r in labels.token_index(df, ["p"]).collect()) == ["P-01_VID_2024_01_02_03_04_05_6", "x.y_VID_2024_01_02_03_04_05_7"]
    rows = [("否", "重度", "no_observed_risk"), (" 是 ", "轻度", "mild_risk"), ("是", "中度\n", "moderate_risk"), ("是", "重度", "high_risk"), ("是", "", "insufficient_evidence"), (None, "轻度", "insufficient_evidence"), ("是", None, "insufficient_evidence")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r.got == r.want for r in df.select("want", labels.risk_level(F.col("a"), F.col("b")).alias("got")).collect())


def test_scorer_tries_passing_errors_again():
    seen, slept = [], []

    def answer(text):
        seen.append(text)
        if len(seen) < 3:
            raise RuntimeError("HTTP 429: slow down")
        return "ok"

    assert package.answered("x", answer, 2, 1.5, slept.append) == ("ok", None, 3) and slept == [1.5, 3.0]
    seen.clear()
    assert package.answered("x", answer, 1, 1.0, slept.append) == (None, "HTTP 429: slow down", 2)
    assert package.answered("x", lambda t: 1 / 0, 5, 1.0)[2] == 1
    assert package.budget_parameter("gpt-5-mini") == package.budget_parameter("x/o3-y") == "max_completion_tokens" and package.budget_parameter("m") == "max_tokens"


def test_phrases(spark):
    row = spark.range(1).select(*[narratives.level_phrase(F.lit(x)).alias(str(k)) for k, x in enumerate(("high", "odd", None))], narratives.action_narrative(F.lit("AU4_proxy"), F.lit("x"), F.lit("low")).alias("a"), narratives.action_narrative(F.lit("q"), F.lit("y"), F.lit(None).cast("string")).alias("b")).first()
    assert tuple(row) == ("seen in most windows", "odd", "None", "Lowered brow (like AU4), low intensity", "y, unknown intensity")


def test_messages_hold_no_label(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = extractors.build("windows_v2")(events).withColumn("target_label", F.lit("high-risk-target"))
    row = df.select(package.messages().alias("m")).first()
    assert [m.role for m in row.m] == ["system", "user"] and "high-risk-target" not in row.m[1].content and json.loads(row.m[1].content.split("\n")[0])["schema_version"] == package.VERSION


def test_stream_of_states_gives_the_closed_runs_of_the_batch(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, "c"), (1, 3, "b"), (2, 1, "d"), (1, 4, "a")]
    schema = "person long, ord long, state string"
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = closed_runs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("closed_runs").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert OUT.startswith("person") and sorted(tuple(r) for r in spark.table("closed_runs").collect()) == [(1, "a", 0, 1, 2), (1, "b", 2, 3, 2), (2, "c", 0, 0, 1)]


def test_idle_persons_runs_are_closed_and_forgotten(spark, tmp_path):
    schema = "person long, ord long, state string, at timestamp"
    rows = [[(1, 0, "a", "2024-01-01 00:00:00"), (2, 0, "b", "2024-01-01 00:00:00")], [(2, 1, "b", "2024-01-01 05:00:00")], [(2, 2, "c", "2024-01-01 05:01:00")]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "person long, ord long, state string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = closed_runs(stream, "at", "1 minute", 600_000).writeStream.format("memory").queryName("idle_runs").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted(tuple(r) for r in spark.table("idle_runs").collect())
    assert (1, "a", 0, 0, 1) in found
