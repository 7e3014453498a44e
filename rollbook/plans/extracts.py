"""Narrow extracts for the dashboard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from rollbook.operators import headers, hygiene
from rollbook.operators.columns import DASHBOARD_PREFIXES, select_prefixes
from rollbook.sources.files import load_snapshot, save_snapshot

# The columns of a tracker extract.
TRACKER_COLUMNS = ("region", "start_date", "end_date", "age", "sex", "complete_sessions")


def _saved(df: DataFrame, path: str | None) -> DataFrame:
    if path is None:
        return df
    save_snapshot(df, path)
    return load_snapshot(df.sparkSession, path)


def dashboard_extract(
    df: DataFrame,
    renames: Mapping[str, str],
    key: str = "kp_type",
    prefixes: Sequence[str] = DASHBOARD_PREFIXES,
    rules: Sequence[tuple[str, str]] = headers.EXPORT_RULES,
    path: str | None = None,
) -> DataFrame:
    """Repair headers, drop rows with a blank key, keep the dashboard columns; save if asked."""
    register = headers.rename_columns(headers.repair_names(df, rules), renames)
    return _saved(select_prefixes(hygiene.keep_nonblank(register, key), prefixes), path)


def tracker_extract(
    df: DataFrame,
    renames: Mapping[str, str] = headers.TRACKER_RENAMES,
    columns: Sequence[str] = TRACKER_COLUMNS,
    path: str | None = None,
) -> DataFrame:
    """Repair headers, rename, keep the six tracker columns; save if asked."""
    tracker = headers.rename_columns(headers.repair_names(df, headers.TRACKER_RULES), renames)
    return _saved(tracker.select(*columns), path)
