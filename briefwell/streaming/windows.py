"""Windows over event time; the same code serves tables and streams (give streams a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData


def with_watermark(stream: DataFrame, when: str, late: str = "15 days") -> DataFrame:
    """Late rows are scored lower rather than dropped, so the watermark is longer than the 14 days after which items are stale."""
    return stream.withWatermark(when, late)


def tumbling(rows: DataFrame, when: str, width: str, keys: list[str]) -> GroupedData:
    return rows.groupBy(F.window(when, width), *keys)


def sessions(rows: DataFrame, when: str, gap: str, keys: list[str]) -> GroupedData:
    return rows.groupBy(F.session_window(when, gap), *keys)
