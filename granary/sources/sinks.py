"""Writers of records, texts, reports and tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing target fails unless overwrite is asked for."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def write_texts(df: DataFrame, path: str, id_col: str = "sample_id", text_col: str = "text") -> None:
    """A folder of text for each record."""
    df.select(id_col, F.col(text_col).alias("value")).write.mode("overwrite").partitionBy(id_col).text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns asked for in order, missing ones and nulls blank, with a header."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("emptyValue", "").csv(path, header=True, nullValue="")


def write_report(df: DataFrame, path: str) -> None:
    """The one row of a report, as indented JSON on the driver."""
    row = df.first()
    Path(path).write_text(json.dumps(row.asDict(True) if row else {}, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report of few rows as a Markdown table; more than `most` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
