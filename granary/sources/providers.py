"""Where sampled frames come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.sampling import frame_indices


class FrameProvider(Protocol):
    """Measures the sampled frames of clips (person, clip, path, n_frames)."""

    def frames(self, clips: DataFrame) -> DataFrame: ...


class TableProvider:
    """Frames measured before, kept in a table with person and clip."""

    def __init__(self, measured: DataFrame):
        self.measured = measured

    def frames(self, clips: DataFrame) -> DataFrame:
        return self.measured.join(clips.select("person", "clip"), ["person", "clip"], "left_semi")


class DecodingProvider:
    """Frames measured by a decoder that is passed in.

    decode(path, indices) yields one mapping for each frame; which frames, is settled before any file is opened. A
    decoder that fails leaves a row with its error instead of frames.
    """

    def __init__(self, decode: Callable[[str, list[int]], Iterator[dict]], schema: str, samples: int = 6):
        self.decode, self.schema, self.samples = decode, schema, samples

    def frames(self, clips: DataFrame) -> DataFrame:
        decode, names = self.decode, [f.split()[0] for f in self.schema.split(",")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for person, clip, path, wanted in zip(b["person"], b["clip"], b["path"], b["indices"], strict=True):
                    try:
                        rows += [{"person": person, "clip": clip, "frame": int(i), "error": None, **x} for i, x in zip(wanted, decode(path, [int(i) for i in wanted]), strict=False)]
                    except Exception as e:
                        rows.append({"person": person, "clip": clip, "frame": None, "error": f"{type(e).__name__}: {e}"})
                yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ["person", "clip", "frame", "error", *names]})

        chosen = clips.select("person", "clip", "path", frame_indices(F.col("n_frames"), self.samples).alias("indices"))
        return chosen.mapInPandas(run, f"person long, clip long, frame long, error string, {self.schema}")
