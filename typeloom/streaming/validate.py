"""Validation of streams: the row predicates of a class run on a stream as they do on a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.operators import validate
from typeloom.plans.catalog import Catalog


def violations(stream: DataFrame, catalog: Catalog, cls: str, keys: Sequence[str]) -> DataFrame:
    """keys, slot, constraint of each broken constraint; stateless."""
    return validate.violations(stream, catalog, cls, keys)


def windowed_report(stream: DataFrame, catalog: Catalog, cls: str, event_time: str, window: str, late: str) -> DataFrame:
    """window_start, slot, constraint, n_invalid by event-time window; rows later than ``late`` are left out."""
    found = violations(stream.withWatermark(event_time, late), catalog, cls, [event_time])
    counted = found.groupBy(F.window(event_time, window), "slot", "constraint").agg(F.count(F.lit(1)).alias("n_invalid"))
    return counted.select(F.col("window.start").alias("window_start"), "slot", "constraint", "n_invalid")


def unique_rows(stream: DataFrame, keys: Sequence[str], event_time: str, late: str) -> DataFrame:
    """Rows whose key did not occur within the watermark; the state holds no key for longer."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))


def orphans(stream: DataFrame, reference: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows of a stream whose reference names no row of a table."""
    return validate.orphans(stream, reference, parents, key)


def duplicates(stream: DataFrame, keys: Sequence[str], order: Sequence[str], event_time: str | None = None, late: str = "0 seconds", keep_seconds: int | None = None) -> DataFrame:
    """The rows whose key an earlier row of the stream has, each once and whole: every later row of a key breaks its uniqueness.

    Among rows that arrive together the first by ``order`` is the earlier one. A key with a null is no key. The state is
    a time a key. With ``event_time`` and ``keep_seconds``, a key is forgotten once the watermark, ``late`` behind the
    latest row, is that long after its last row, and rows older than the watermark are left out; without them keys are
    kept for good and no duplicate is missed.
    """
    forget = event_time is not None and keep_seconds is not None
    if forget:
        stream = stream.withWatermark(event_time, late)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    by = list(order)

    def later(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, latest = None, state.get[0] if state.exists else 0
        # a key whose time is over may still wait for its timeout
        known = state.exists and not (forget and latest + 1000 * keep_seconds <= state.getCurrentWatermarkMs())
        for rows in batches:
            if forget:
                latest = max(latest, int(rows[event_time].max().timestamp() * 1000))
            if not known:
                rows = rows if first is None else pd.concat([first, rows])
                # most keys come sorted, and many with one row; each step of pandas counts where keys are many
                if len(rows) > 1 and not (len(by) == 1 and rows[by[0]].is_monotonic_increasing):
                    rows = rows.sort_values(by, kind="stable")
                first, rows = rows.iloc[:1], rows.iloc[1:]
            if len(rows):
                yield rows
        state.update((latest,))
        if forget:
            state.setTimeoutTimestamp(max(latest + 1000 * keep_seconds, state.getCurrentWatermarkMs() + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.filter(whole).groupBy(*keys).applyInPandasWithState(later, schema, "latest long", "append", "EventTimeTimeout" if forget else "NoTimeout")
