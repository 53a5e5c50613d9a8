"""Robots in event time: output at fixed ticks, with or without events, and goals joined with the pose they were set at.

Both are keyed state with event-time timers. Rows wait in a list until the watermark has passed them, so the order in which
they arrive doesn't matter; what waits is bounded by the lateness allowed. Rows of one robot at one time go by kind, then by
their values. Rows that come after their time was settled are left out; so are rows without robot or time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shared import shared_dir

TICK_EVENT = "robot long, at timestamp, kind string, x double, y double, ori double, speed double"  # kind: pose, goal or odometry
TICK = "robot long, at timestamp, mode string, new_goal boolean, goal_x double, goal_y double, distance double, speed double"
GOAL = "robot long, at timestamp, route_id long, x double, y double"
POSE = "robot long, at timestamp, x double, y double"
ASKED = "route_id long, robot long, at timestamp, start_x double, start_y double, goal_x double, goal_y double"
WAITING = "ms long, kind string, x double, y double, ori double, speed double"
BLANK = (None, None, None, None, None, None, 0.0, None, None)
KEPT = "px double, py double, po double, gx double, gy double, go double, speed double, last long, ticked long"


def _order(row: tuple) -> tuple:
    return tuple((v is not None, v) for v in row)


def _times(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """Input as (ms, values...), with None for what is missing."""
    out = []
    for part in rows:
        out += zip(part["ms"].tolist(), *([None if v is None or v != v else v for v in part[c].tolist()] for c in columns), strict=True)
    return out


def _stamp(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms", tz="UTC")


class _Ticks(StatefulProcessor):
    """Ticks at multiples of ``step`` ms, from a robot's first event until ``idle`` ms without one."""

    def __init__(self, step: int, idle: int, tolerance: float) -> None:
        self.step, self.idle, self.tolerance = step, idle, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.kept = handle.getValueState("kept", KEPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for r in _times(rows, ["kind", "x", "y", "ori", "speed"]) if r[0] > timerValues.getCurrentWatermarkInMs()]
        if new:
            self.waiting.appendList(new)
            self._next(min(r[0] for r in new))
        yield pd.DataFrame(columns=["robot", "at", "mode", "new_goal", "goal_x", "goal_y", "distance", "speed"])

    def _next(self, ms: int) -> None:
        """A timer at the first tick from ``ms`` on; one that is set for the same time stays one."""
        self.handle.registerTimer(-(-ms // self.step) * self.step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, tick = timerValues.getCurrentWatermarkInMs(), 0
        px, py, po, gx, gy, go, speed, last, ticked = tuple(self.kept.get()) if self.kept.exists() else BLANK
        waiting = sorted(self.waiting.get(), key=_order)
        if ticked is not None:
            tick = ticked + self.step  # ticks go on from the last, whichever timer rang
        elif waiting:
            tick = -(-waiting[0][0] // self.step) * self.step
        out, i, asleep = [], 0, False
        while tick <= now:
            if last is not None and tick - last > self.idle and (i == len(waiting) or waiting[i][0] > tick):
                px = py = po = gx = gy = go = last = None  # asleep: its next event starts afresh
                speed = 0.0
                if i == len(waiting):
                    asleep = True
                    break
                tick = -(-waiting[i][0] // self.step) * self.step
                continue
            fresh = False
            while i < len(waiting) and waiting[i][0] <= tick:
                ms, kind, x, y, ori, v = waiting[i]
                i, last = i + 1, ms
                if kind == "goal":
                    gx, gy, go, fresh = x, y, ori or 0.0, True
                else:
                    px, py, po = x, y, ori or 0.0
                    speed = v if kind == "odometry" and v is not None else speed
            if last is None:  # a timer that rang for rows already taken
                break
            ready = None not in (px, py, gx, gy)
            far = math.dist((px, py, po), (gx, gy, go)) if ready else None
            mode = "wait" if not ready else "reached" if far < self.tolerance else "drive"
            out.append((key[0], _stamp(tick), mode, fresh, gx if ready else None, gy if ready else None, far, speed))
            if mode == "reached":
                gx = gy = go = None
            ticked, tick = tick, tick + self.step
        left = waiting[i:]
        if asleep or last is None:
            self.kept.clear()
        else:
            self.kept.update((px, py, po, gx, gy, go, speed, last, ticked))
            self.handle.registerTimer(tick)
        if i:
            self.waiting.put(left) if left else self.waiting.clear()
        if left and (asleep or last is None):
            self._next(left[0][0])
        yield pd.DataFrame(out, columns=["robot", "at", "mode", "new_goal", "goal_x", "goal_y", "distance", "speed"])

    def close(self) -> None:
        pass


def _keyed(df: DataFrame) -> DataFrame:
    """With times in whole milliseconds, as timers have them; a later fraction counts to the next."""
    return df.filter("robot IS NOT NULL AND at IS NOT NULL").withColumn("ms", F.ceil(F.unix_micros("at") / 1000).cast("long"))


def ticks(events: DataFrame, *, hz: float = 10.0, idle: float = 5.0, tolerance: float = 1.0, late: str = "1 second") -> DataFrame:
    """TICK rows of a stream of TICK_EVENT: each robot's state at every multiple of 1/hz seconds, up to the watermark.

    A tick has all events up to its time. mode: wait (without pose or goal), drive, or reached (nearer than tolerance, heading
    included), after which the goal is gone. new_goal: a goal came since the last tick, so what was learned on the way to the one
    before no longer counts. A robot without an event for ``idle`` seconds has no ticks and no state until its next event.
    """
    step = max(1, round(1000 / hz))
    rows = _keyed(events.withWatermark("at", late))
    return rows.groupBy("robot").transformWithStateInPandas(_Ticks(step, round(1000 * idle), tolerance), TICK, "append", "EventTime")


HELD = pa.schema([("robot", pa.int64()), ("ms", pa.int64()), ("kind", pa.string()), ("route_id", pa.string()), ("x", pa.float64()), ("y", pa.float64())])
GROUPS = 1024  # of robots: what a key's step holds is its group's rows of the batch


def _to_bytes(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, HELD) as w:
        w.write_table(pa.Table.from_pandas(rows, HELD, preserve_index=False))
    return out.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _AsOf(StatefulProcessor):
    """Goals wait for the watermark; then the latest pose not after them is known.

    A key is a group of robots: a batch's rows of it are one state entry, and one timer serves all its goals, so calls to the
    store grow with batches and groups, not with robots, rows or goals.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[HELD.names]
        new = new[(new["kind"] == "pose") | (new["ms"] > timerValues.getCurrentWatermarkInMs())]
        if len(new):
            self.waiting.appendValue((_to_bytes(new),))
            self.handle.registerTimer(int(new["ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All goals up to the watermark, whichever timer rang."""
        now, held = timerValues.getCurrentWatermarkInMs(), list(self.waiting.get())
        if not held:  # an earlier timer left nothing
            return
        # of a robot's poses at one time the last in this order counts
        rows = pd.concat([_from_bytes(bytes(r[0])) for r in held]).sort_values(["ms", "x", "y"], na_position="first")
        settled = rows["ms"] <= now
        due, poses = rows[settled & (rows["kind"] == "goal")], rows[settled & (rows["kind"] == "pose")]
        # no pose is needed but those after the watermark, and the last before
        left = pd.concat([rows[~settled], poses.drop_duplicates("robot", keep="last")])
        if not len(left):
            self.waiting.clear()
        elif len(held) > 1 or len(left) < len(rows):
            self.waiting.put([(_to_bytes(left),)])
        if not settled.all():
            self.handle.registerTimer(int(rows["ms"][~settled].min()))
        if len(due):
            out = pd.merge_asof(due, poses[["robot", "ms", "x", "y"]].rename(columns={"x": "start_x", "y": "start_y"}), on="ms", by="robot")
            yield pd.DataFrame({"route_id": pd.array([None if r is None else int(r) for r in out["route_id"]], "Int64"), "robot": out["robot"], "at": pd.to_datetime(out["ms"], unit="ms", utc=True), "start_x": out["start_x"], "start_y": out["start_y"], "goal_x": out["x"], "goal_y": out["y"]})

    def close(self) -> None:
        pass


def goals_with_poses(goals: DataFrame, poses: DataFrame, *, late: str = "1 second", groups: int = GROUPS) -> DataFrame:
    """ASKED rows of two streams, GOAL and POSE: each goal once, with its robot's latest pose at or before its time.

    The start is null where no pose is known. A robot's last pose stays in state until a later one is settled. Robots are
    dealt to ``groups``, which are the keys; their number stays as it is for as long as a checkpoint is used.
    """
    # route_id as text: pandas would make floats of numbers with gaps
    both = goals.selectExpr("robot", "at", "'goal' kind", "cast(route_id as string) route_id", "x", "y").union(poses.selectExpr("robot", "at", "'pose' kind", "cast(null as string) route_id", "x", "y"))
    dealt = _keyed(both.withWatermark("at", late)).withColumn("group", F.pmod(F.xxhash64("robot"), F.lit(groups)))
    return dealt.groupBy("group").transformWithStateInPandas(_AsOf(), ASKED, "append", "EventTime")


PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """What ``stream`` gives for all that is there now, as a table at ``path``; a later call with the same folders goes on.

    Both folders are made below the shared folder unless given. Timers need the RocksDB state store: it is set for this run alone.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    path, before = path or f"{base}/out", spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint or f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(path)
