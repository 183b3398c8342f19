"""Streams of events: windowed totals with late data, and running totals that carry a value from row to row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_totals(events: DataFrame, time: str, key: str, value: str, width: str, lateness: str) -> DataFrame:
    """Count and sum by tumbling window and key; rows later than `lateness` are dropped, so state stays bounded."""
    late = events.withWatermark(time, lateness)
    return late.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def running_totals(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each row with its key's running count and total so far (a sum statement with BY, over a stream).

    State is two numbers for each key. Rows of one micro-batch are taken in `order`; a missing value adds 0.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{value}` double, n long, total double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        x = rows[value].astype("float64").fillna(0.0)
        rows["n"] = range(n + 1, n + len(rows) + 1)
        rows["total"] = x.cumsum() + total
        state.update((n + len(rows), total + float(x.sum())))
        yield rows[[key, order, value, "n", "total"]]

    narrow = events.select(key, order, F.col(value).cast("double").alias(value))
    return narrow.groupBy(key).applyInPandasWithState(step, out, "n long, total double", "append", GroupStateTimeout.NoTimeout)
