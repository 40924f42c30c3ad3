"""Column-name normalisation (B1)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Quality-flag columns added by cleaning; excluded from scoring and metrics.
QUALITY_FLAG_COLUMNS = ("has_nulls", "invalid_date_parse", "type_conversion_issue")


def normalize_name(value) -> str:
    """strip, lower, runs of characters outside [a-z0-9] -> '_', trim '_'."""
    text = str(value).strip().lower()
    text = re.sub(r"[^a-z0-9]+", "_", text).strip("_")
    if not text:
        raise ValueError("Normalized name cannot be empty.")
    return text


def normalized_names(columns: list[str]) -> dict[str, str]:
    """Map raw -> normalised names; raise when two raw names collide."""
    mapping = {c: normalize_name(c) for c in columns}
    seen: dict[str, str] = {}
    for raw, new in mapping.items():
        if new in seen:
            raise ValueError(
                f"Column names {seen[new]!r} and {raw!r} both normalise to {new!r}")
        seen[new] = raw
    return mapping


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its normalised name (a metadata-only projection)."""
    mapping = normalized_names(df.columns)
    return df.toDF(*[mapping[c] for c in df.columns])
