"""Ticks and as-of goals, batch by batch, against a plain walk over all rows in order of time."""

import math
from datetime import UTC, datetime

import numpy as np
import pytest

from waymark.streaming import ticks

T0 = 1_700_000_000_000


def stamp(ms):
    return datetime.fromtimestamp((T0 + ms) / 1000, UTC)


def ms_of(at):
    return round(at.timestamp() * 1000) - T0


def feed(spark, folder, batches, schema):
    """A stream that takes one batch of rows a trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(folder)


def walk(events, step, idle, tolerance, until):
    """Every tick by looking at each time in turn: (robot, ms, mode, new_goal, distance, speed)."""
    out = []
    for robot in sorted({e[0] for e in events}):
        own = sorted(e[1:] for e in events if e[0] == robot)
        pose = goal = last = None
        speed, i = 0.0, 0
        for t in range(-(-own[0][0] // step) * step, until + 1, step):
            fresh = False
            if last is not None and t - last > idle and not (i < len(own) and own[i][0] <= t):
                pose = goal = last = None
                speed = 0.0
            while i < len(own) and own[i][0] <= t:
                last, kind, x, y, ori, v = own[i]
                i += 1
                if kind == "goal":
                    goal, fresh = (x, y, ori), True
                else:
                    pose = (x, y, ori)
                    speed = v if kind == "odometry" else speed
            if last is None:
                continue
            far = math.dist(pose, goal) if pose and goal else None
            mode = "wait" if far is None else "reached" if far < tolerance else "drive"
            out.append((robot, t, mode, fresh, far, speed))
            goal = None if mode == "reached" else goal
    return out


def some_events(seed, n=60, span=6000):
    rng = np.random.default_rng(seed)
    kinds = rng.choice(["pose", "goal", "odometry"], n, p=[0.5, 0.2, 0.3]).tolist()
    at = sorted(rng.integers(0, span, n).tolist())
    return [(int(rng.integers(1, 4)), t, k, *map(float, rng.integers(0, 4, 2)), 0.0, float(rng.integers(0, 9))) for t, k in zip(at, kinds, strict=True)]


@pytest.mark.parametrize("parts", [1, 3])
def test_ticks_equal_a_walk(spark, tmp_path, parts):
    events = some_events(parts)
    events = [e for e in events if not (e[0] == 2 and 1000 < e[1] < 4500)]  # robot 2 falls asleep
    mixed = [events[i] for i in np.random.default_rng(1).permutation(len(events))] if parts == 1 else events
    size = -(-len(mixed) // parts)
    batches = [[(e[0], stamp(e[1]), *e[2:]) for e in mixed[k : k + size]] for k in range(0, len(mixed), size)]
    stream = feed(spark, str(tmp_path / "in"), batches, ticks.TICK_EVENT)
    got = ticks.settled(ticks.ticks(stream, hz=10, idle=1.5, tolerance=1.5, late="0 seconds")).collect()
    got = sorted((r["robot"], ms_of(r["at"]), r["mode"], r["new_goal"], r["distance"], r["speed"]) for r in got)
    want = walk(events, 100, 1500, 1.5, max(e[1] for e in events))
    assert got == want and {g[2] for g in got} == {"wait", "drive", "reached"}
    assert len(got) > len({(g[0], e[1] // 100) for g in got for e in events if e[0] == g[0]})  # more ticks than events asked for


def test_late_rows_and_rows_without_robot_or_time_are_left_out(spark, tmp_path):
    first = [(1, stamp(0), "pose", 0.0, 0.0, 0.0, None), (None, stamp(0), "pose", 1.0, 1.0, 0.0, None), (1, None, "pose", 9.0, 9.0, 0.0, None), (2, stamp(3000), "pose", 0.0, 0.0, 0.0, None)]
    second = [(1, stamp(500), "goal", 0.0, 9.0, 0.0, None), (2, stamp(4000), "goal", 3.0, 4.0, None, None)]
    stream = feed(spark, str(tmp_path / "in"), [first, second], ticks.TICK_EVENT)
    got = ticks.settled(ticks.ticks(stream, hz=2, idle=10, late="1 second")).collect()
    one = [r for r in got if r["robot"] == 1]
    assert [ms_of(r["at"]) for r in sorted(one, key=lambda r: r["at"])] == list(range(0, 3001, 500)) and {r["mode"] for r in one} == {"wait"}
    assert {r["robot"] for r in got} == {1, 2}


def test_goals_meet_the_pose_of_their_time(spark, tmp_path):
    poses = [[(1, stamp(100), 1.0, 0.0), (1, stamp(900), 2.0, 0.0)], [(1, stamp(2000), 3.0, 0.0), (3, stamp(5000), 0.0, 0.0)]]
    goals = [[(1, stamp(950), 7, 5.0, 5.0), (1, stamp(50), 8, 6.0, 6.0), (2, stamp(400), 9, 1.0, 1.0)], [(1, stamp(2000), 10, 4.0, 4.0), (1, stamp(4000), 11, 4.0, 5.0)]]
    p, g = feed(spark, str(tmp_path / "p"), poses, ticks.POSE), feed(spark, str(tmp_path / "g"), goals, ticks.GOAL)
    got = {r["route_id"]: (r["robot"], ms_of(r["at"]), r["start_x"], r["goal_x"], r["goal_y"]) for r in ticks.settled(ticks.goals_with_poses(g, p, late="0 seconds")).collect()}
    assert got == {7: (1, 950, 2.0, 5.0, 5.0), 8: (1, 50, None, 6.0, 6.0), 9: (2, 400, None, 1.0, 1.0), 10: (1, 2000, 3.0, 4.0, 4.0), 11: (1, 4000, 3.0, 4.0, 5.0)}


class Store:
    """A list state that counts what is asked of it."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def _call(self, rows):
        self.rows, self.calls = rows, self.calls + 1

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def appendList(self, rows):
        self._call(self.rows + list(rows))

    def appendValue(self, row):
        self._call([*self.rows, row])

    def put(self, rows):
        self._call(list(rows))

    def clear(self):
        self._call([])


def test_calls_to_the_store_do_not_grow_with_goals():
    """One timer answers all goals of a batch, however many robots and goals there are; what is left is what later goals need."""
    from types import SimpleNamespace

    import pandas as pd

    stores, timers, counts, starts = {}, set(), [], []
    for goals in (3, 300):
        stores.clear()
        handle = SimpleNamespace(getListState=lambda n, _: stores.setdefault(n, Store()), registerTimer=timers.add)
        step = ticks._AsOf()
        step.init(handle)
        rows = pd.DataFrame([(r, 10 * i + 1 + (k == "pose"), k, str(i) if k == "goal" else None, float(i), float(i)) for r in (1, 2) for i in range(goals) for k in ("goal", "pose")], columns=["robot", "ms", "kind", "route_id", "x", "y"])
        clock = lambda t: SimpleNamespace(getCurrentWatermarkInMs=lambda: t)
        list(step.handleInputRows((1,), iter([rows]), clock(0)))
        n = len(timers)
        out, now = [], 10 * goals - 15  # the last goal of each robot waits
        while timers and min(timers) <= now:
            due = min(timers)
            timers.remove(due)
            out += list(step.handleExpiredTimer((1,), clock(now), SimpleNamespace(getExpiryTimeInMs=lambda t=due: t)))
        got = pd.concat(out)
        assert len(got) == 2 * (goals - 1) and timers == {10 * goals - 9}
        starts.append({(r.robot, r.route_id): r.start_x for r in got.itertuples() if r.route_id})
        assert all(x == route - 1 for (_, route), x in starts[-1].items()) and got[got["route_id"] == 0]["start_x"].isna().all()
        counts.append((n, sum(s.calls for s in stores.values())))
        timers.clear()
    assert counts[0] == counts[1]
