"""Structured Streaming forms of the stateful operators; each has a batch twin."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from lodestar.operators.machines import Machine
from lodestar.operators.tracking import Track, Tracker

#: Idle time after which a key's state goes.
IDLE_MS = 15_000


def announced(events: DataFrame, keys: list[str], at: str, order: str, seconds: float) -> DataFrame:
    """The events that a per-key cooldown lets through; state: the time of the last announced one."""
    schema = events.schema

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(parts).sort_values([at, order])
        keep = []
        for now in rows[at]:
            fire = last is None or now - last >= seconds
            last = now if fire else last
            keep.append(fire)
        if last is not None:
            state.update((float(last),))
        yield rows[keep]

    return events.groupBy(*keys).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def scanned(events: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Callable[[], Machine], at: str, late: str = "1 minute", idle_ms: int = IDLE_MS) -> DataFrame:
    """``events`` with the columns that a machine of each key adds; state: what the machine holds, as JSON.

    Rows of a micro-batch are taken by ``order``; batches must come in that
    order. ``at`` is the event time: rows later than ``late`` are dropped, and a
    key that was idle for more than ``idle_ms`` of it starts anew, however the
    rows are dealt to batches. Null keys are keys.
    """
    added = events.sparkSession.createDataFrame([], machine().adds).schema
    schema = events.schema
    # pandas would make floats of whole numbers with nulls: they travel as strings
    whole = {f.name for f in schema.fields if isinstance(f.dataType, IntegralType)}
    passed = StructType([StructField(f.name, StringType()) if f.name in whole else f for f in schema.fields])

    def value(name: str, x: Any) -> Any:
        return None if pd.isna(x) else int(x) if name in whole else x

    def ordered(column: pd.Series) -> pd.Series:
        told = [value(column.name, x) for x in column]
        least = min((x for x in told if x is not None), default=0)
        return pd.Series([(x is not None, least if x is None else x) for x in told], index=column.index)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, last = machine(), None
        if state.exists:
            last, held = json.loads(state.get[0])
            now.resume(held)
        rows = pd.concat([p for p in parts if len(p)]).sort_values(list(order), kind="stable", key=ordered)
        out = []
        for ms, values in zip((round(x.timestamp() * 1000) for x in rows[at]), zip(*([value(c, x) for x in rows[c]] for c in now.reads), strict=True), strict=True):
            if last is not None and ms - last > idle_ms:
                now = machine()
            last = ms if last is None else max(last, ms)
            out.append(now.step(*values))
        state.update((json.dumps([last, now.held]),))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms + 1)
        for i, one in enumerate(added.fields):
            rows[one.name] = pd.Series([x[i] for x in out], index=rows.index, dtype=object)
        yield rows

    texts = events.withWatermark(at, late).withColumns({c: F.col(c).cast("string") for c in whole})
    done = texts.groupBy(*keys).applyInPandasWithState(run, StructType([*passed.fields, *added.fields]), "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return done.withColumns({c: F.col(c).cast(schema[c].dataType) for c in whole})


def coalesced(updates: DataFrame, stream: str, at: str, order: Sequence[str], tick: str, late: str = "1 minute") -> DataFrame:
    """The last update of each stream in each closed tick."""
    from lodestar.operators import machines

    return machines.coalesced(updates.withWatermark(at, late), stream, at, order, tick)


def _packed(tracker: Tracker) -> tuple[int, list[float]]:
    flat: list[float] = []
    for t in tracker.tracks:
        flat += [float(t.id), float(t.hits), float(t.missed), float(t.age), *map(float, t.box), *map(float, t.velocity)]
    return tracker.last_id, flat


def _unpacked(last_id: int, flat: list[float]) -> Tracker:
    tracker = Tracker(last_id=last_id)
    for i in range(0, len(flat), 10):
        number, hits, missed, age, *rest = flat[i : i + 10]
        tracker.tracks.append(Track(int(number), np.array(rest[:4]), np.array(rest[4:]), int(hits), int(missed), int(age)))
    return tracker


def tracked(boxes: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, frame, id, track_id, hits, stable); state: the tracks of a key. Frames must arrive whole and in order; an idle key's tracks go."""
    types = dict(boxes.dtypes)

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = _unpacked(*state.get) if state.exists else Tracker()
        out: list[tuple[Any, ...]] = []
        for number, part in pd.concat(parts).sort_values([frame, "id"]).groupby(frame, sort=True):
            for box_id, (track, hits, stable) in zip(part["id"], tracker.step(part[["x1", "y1", "x2", "y2"]].to_numpy(float)), strict=True):
                out.append((group[0], number, box_id, track, hits, stable))
        state.update(_packed(tracker))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(out, columns=[key, frame, "id", "track_id", "hits", "stable"])

    output = f"{key} {types[key]}, {frame} {types[frame]}, id {types['id']}, track_id int, hits int, stable boolean"
    return boxes.select(key, frame, "id", "x1", "y1", "x2", "y2").groupBy(key).applyInPandasWithState(run, output, "last_id int, flat array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(events: DataFrame, key: str, at: str, idle: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """(key, session_start, session_end, n_events): event-time sessions that close after an idle gap."""
    grouped = events.withWatermark(at, late).groupBy(key, F.session_window(at, idle).alias("s"))
    return grouped.agg(F.count("*").alias("n_events")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def windowed_counts(events: DataFrame, key: str, at: str, width: str, slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """(key, window_start, n): tumbling or sliding event-time counts."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(key, window.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def deduplicated(events: DataFrame, keys: list[str], at: str, late: str = "1 minute") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def latest_to(events: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str):
    """Writes, for each micro-batch, the latest event of each key: intermediate ones are conflated away."""
    from lodestar.operators.tracking import latest

    def put(batch: DataFrame, number: int) -> None:
        latest(batch, keys, [F.col(c) for c in order]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
