"""Text helpers: slugs, display names and compact maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_slug(text: Column, default: str = "dataset") -> Column:
    """Lower case, runs of anything but letters and digits as one `_`, none at the ends; default where nothing is left."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def tag_slug(text: Column, default: str = "untagged") -> Column:
    """Runs of anything but letters, digits, `_`, `.` and `-` as one `_`; none of `._-` at the ends."""
    slug = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def display_name(token: Column) -> Column:
    """Every part between `_` with a capital."""
    return F.replace(F.initcap(F.replace(token, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))


def compact_map(counts: Column) -> Column:
    """A map as `k=v;…` by rising key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ";")


def json_values(json: Column) -> Column:
    """The text of a JSON value with escapes resolved, for searches over all of its strings."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(json, r"\\/", "/"), r"\\\\", r"\\"), r'\\"', '"')
