"""Listings, JSONL, workbooks and video headers."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.operators.manifest import parse_segments

SKIPPED = ("manifests", "$RECYCLE.BIN", "System Volume Information")
KNOWN_FILES = {"usage": "usage.json", "heart": "heartRate.json", "questionnaire": "questionnaire.json", "heart_plot": "heartRate.png", "questionnaire_image": "questionnaire_list.png"}


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a schema; blank lines do not count, a bad line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line) of lines that are not JSON; lines count from 1 within a file, which one task reads."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return whole.filter((F.trim("text") != "") & F.try_parse_json("text").isNull()).select("path", (F.col("line") + 1).alias("line"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below root: path, length, and the names of file, folder and the folder above; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    named = files.withColumns({"file": F.element_at(parts, -1), "folder": F.element_at(parts, -2), "above": F.element_at(parts, -3)})
    return named.filter(~F.exists(parts, lambda p: p.isin(*SKIPPED)))


def segments(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segment folders with what files they hold, and the names of folders that are none."""
    parsed = parse_segments(files, "folder")
    known = [F.max(F.when(F.col("file") == n, F.col("length"))).alias(f"{k}_bytes") for k, n in KNOWN_FILES.items()]
    videos = F.array_sort(F.collect_list(F.when(F.lower("file").endswith(".mp4"), F.struct("file", "length", "path")))).alias("videos")
    good = parsed.filter("valid").groupBy("folder", "above", "person_raw", "session_key", "captured_on", "captured_at", "clip_raw", "clip_index").agg(videos, *known)
    return good, parsed.filter("NOT valid").select("folder").distinct()


def segment_files(spark: SparkSession, root: str) -> DataFrame:
    """Files directly in segment folders below root, with the root; nothing deeper than the first segment folder of a
    path counts, so a segment within a segment is not one."""
    files = list_files(spark, root)
    below = F.split(F.regexp_replace("path", ".*" + re.escape(root.rstrip("/")) + "/", ""), "/")
    first = F.array_position(F.transform(below, lambda p: p.rlike("_VID_")), True)
    return files.filter((first == 0) | (first == F.size(below) - 1)).withColumn("root", F.lit(root))


def scan_roots(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Segments of all roots in order of person, session, clip and root, and one row for each root: persons, sessions,
    clips, and folders that are no segments."""
    found, invalid = [], []
    for root in roots:
        good, bad = segments(segment_files(spark, root))
        found.append(good.withColumn("root", F.lit(root)))
        invalid.append(bad.withColumn("root", F.lit(root)))
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    everything, strange = union(found), union(invalid)
    sums = everything.groupBy("root").agg(F.count_distinct("person_raw").alias("n_persons"), F.count_distinct("session_key").alias("n_sessions"), F.count(F.lit(1)).alias("n_clips"))
    summary = sums.join(strange.groupBy("root").agg(F.count(F.lit(1)).alias("n_invalid")), "root", "full_outer").fillna(0)
    return everything.orderBy("person_raw", "session_key", "clip_index", "root"), summary


def resolved_paths(wanted: DataFrame, files: DataFrame, old: str, new: str) -> DataFrame:
    """wanted (path) with found: the listed file at the path, else at the path with its prefix replaced, else null."""
    have = files.select(F.col("path").alias("found")).distinct()
    swapped = F.when(F.col("path").startswith(old), F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1)))).otherwise(F.col("path"))
    direct = wanted.join(have.withColumnRenamed("found", "_a"), F.col("path") == F.col("_a"), "left").withColumn("_swapped", swapped)
    return direct.join(have.withColumnRenamed("found", "_b"), F.col("_swapped") == F.col("_b"), "left").withColumn("found", F.coalesce("_a", "_b")).drop("_a", "_b", "_swapped")


def json_probe(df: DataFrame, column: str, sensitive: tuple[str, ...] = ("name", "phone", "email", "address", "id")) -> DataFrame:
    """df with what a JSON text holds: status, kind, records, fields, empty, keys, sensitive_keys, sha256.

    Lists count their items and show the keys of the first object; objects show their keys; "" and null are empty.
    """
    text = F.col(column)
    value = F.try_parse_json(text)
    kind = F.when(text.isNull(), None).when(value.isNull(), None).when(text.rlike(r"^\s*\["), "list").when(text.rlike(r"^\s*\{"), "object").otherwise("scalar")
    first = F.when(F.col("kind") == "list", F.get_json_object(text, "$[0]")).when(F.col("kind") == "object", text)
    keys = F.coalesce(F.array_sort(F.json_object_keys("_first")), F.array().cast("array<string>"))
    df = df.withColumns({"status": F.when(text.isNull(), "missing").when(value.isNull(), "invalid_json").otherwise("ok"), "kind": kind}).withColumn("_first", first).withColumn("keys", keys)
    records = F.when(F.col("kind") == "list", F.json_array_length(text))
    fields = F.when(F.col("kind") == "object", F.size("keys"))
    empty = F.when(F.col("kind") == "list", records == 0).when(F.col("kind") == "object", fields == 0).when(F.col("kind") == "scalar", F.trim(text).isin('""', "null"))
    hits = F.filter("keys", lambda k: F.lower(k).isin(*sensitive))
    return df.withColumns({"records": records, "fields": fields, "empty": empty, "sensitive_keys": hits, "sha256": F.sha2(text, 256)}).drop("_first")


def sheet_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of a workbook's first sheet as text under its header row, with _label_row_index from 2; short rows are padded."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        root = ElementTree.fromstring(z.read(sheets[0]))
    rows: list[list[str]] = []
    for row in (e for e in root.iter() if tag(e) == "row"):
        cells: dict[int, str] = {}
        for c in (e for e in row if tag(e) == "c"):
            letters = re.match("[A-Z]+", c.get("r", "")) or re.match("", "")
            at = 0
            for ch in letters[0]:
                at = at * 26 + ord(ch) - 64
            at = at - 1 if letters[0] else len(cells)
            value = next((e.text or "" for e in c if tag(e) == "v"), "")
            if c.get("t") == "s":
                value = shared[int(value)] if value else ""
            elif c.get("t") == "inlineStr":
                value = "".join(e.text or "" for e in c.iter() if tag(e) == "t")
            cells[at] = value
        rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    if not rows:
        return []
    head = rows[0]
    return [{**{h: (r + [""] * len(head))[k] for k, h in enumerate(head) if h}, "_label_row_index": str(k)} for k, r in enumerate(rows[1:], 2)]


def read_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of the first sheet of workbooks, all text, with _label_row_index; a missing column is null."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_label_row_index"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = sheet_rows(content)
                yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in [*columns, "_label_row_index"]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf"}


def video_header(content: bytes) -> tuple[bool, float | None, int | None, int | None]:
    """Readable, seconds, width and height from the boxes of an MP4 file."""
    return read_boxes(lambda at, n: content[at : at + n], len(content))


def read_boxes(read: Callable[[int, int], bytes], length: int) -> tuple[bool, float | None, int | None, int | None]:
    """The same from read(place, bytes), of which only the heads of boxes and the two header boxes are asked for."""
    seconds, width, height, seen = None, 0, 0, False
    todo = [(0, length, 0)]
    while todo:
        at, end, depth = todo.pop()
        while at + 8 <= end:
            top = read(at, 16)
            if len(top) < 8:
                break
            size, kind = struct.unpack_from(">I4s", top, 0)
            head = 8
            if size == 1 and at + 16 <= end and len(top) == 16:
                size, head = struct.unpack_from(">Q", top, 8)[0], 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                break
            seen = seen or kind in (b"ftyp", b"moov")
            body, stop = at + head, at + size
            if kind in CONTAINERS and depth < 8:
                todo.append((body, stop, depth + 1))
            elif kind == b"mvhd" and stop - body >= 20:
                data = read(body, 32)
                long = data[0] == 1
                if len(data) >= (32 if long else 20):
                    scale, units = struct.unpack_from(">IQ" if long else ">II", data, 20 if long else 12)
                    seconds = units / scale if scale else None
            elif kind == b"tkhd" and stop - body >= 8:
                w, h = (x >> 16 for x in struct.unpack(">II", read(stop - 8, 8)))
                if w * h > width * height:
                    width, height = w, h
            at = stop
    return seen and seconds is not None, seconds, width or None, height or None


def probe_videos(spark: SparkSession, path: str) -> DataFrame:
    """path, length, readable, seconds, width and height of video files; of each only the heads of its boxes are read.

    Files are opened by their URI (local, HDFS and object stores that pyarrow knows); one that cannot be is not readable.
    """

    def header(uri: str, length: int) -> tuple[bool, float | None, int | None, int | None]:
        try:
            store, name = pyarrow.fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])
            with store.open_input_file(name) as f:
                return read_boxes(lambda at, n: (f.seek(at), f.read(n))[1], length)
        except (OSError, pyarrow.ArrowException):
            return False, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, n, *header(unquote(p), n)) for p, n in zip(b["path"], b["length"], strict=True)], columns=["path", "length", "readable", "seconds", "width", "height"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mp4").load(path)
    return files.select("path", "length").mapInPandas(run, "path string, length long, readable boolean, seconds double, width int, height int")
