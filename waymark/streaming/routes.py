"""Route requests as a stream, and per-robot navigation state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import pixel_to_world, route_vectors, upsample, world_to_pixel
from ..operators.build import find_routes, routes

REQUEST = "route_id long, map_id long, start_id int, goal_id int"


def serve_routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, checkpoint: str):
    """Answer a stream of REQUEST rows: each micro-batch is one routed batch, appended as Parquet.

    Every request is answered once under its route_id; found is false, and path null, where there is no route.
    """

    def answer(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        routes(batch, nodes, edges).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENT = "robot long, ts double, kind string, x double, y double, ori double, speed double"  # kind: pose, goal or odometry
STATUS = "robot long, ts double, mode string, goal_x double, goal_y double, distance double, speed double"


def navigate(events: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Per-robot state over EVENT rows: latest pose, speed and goal; a goal within tolerance is reached and cleared.

    Position and orientation both count, at every event (poses and odometry alike). A new goal replaces the old one; a
    clock that goes back resets pose, speed and goal. mode: wait, drive, reached or reset.
    """

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pose, speed, goal = (-1e300, None, 0.0, None)
        if state.exists:
            last, px, py, po, gx, gy, go, speed, has_pose, has_goal = state.get
            pose, goal = (px, py, po) if has_pose else None, (gx, gy, go) if has_goal else None
        rows = []
        for r in pd.concat(list(parts)).sort_values("ts", kind="stable").itertuples():
            if r.ts < last:
                pose, goal, speed = None, None, 0.0
                rows.append((key[0], r.ts, "reset", None, None, None, speed))
            last = r.ts
            if r.kind == "goal":
                goal = (r.x, r.y, r.ori)
            else:
                pose = (r.x, r.y, r.ori)
                speed = float(r.speed) if r.kind == "odometry" and r.speed == r.speed and r.speed is not None else speed
            if pose is None or goal is None:
                rows.append((key[0], r.ts, "wait", None, None, None, speed))
                continue
            d = math.dist(pose, goal)
            rows.append((key[0], r.ts, "reached" if d < tolerance else "drive", goal[0], goal[1], d, speed))
            goal = goal if d >= tolerance else None
        state.update((last, *(pose or (0.0, 0.0, 0.0)), *(goal or (0.0, 0.0, 0.0)), speed, pose is not None, goal is not None))
        yield pd.DataFrame(rows, columns=["robot", "ts", "mode", "goal_x", "goal_y", "distance", "speed"])

    kept = "last double, px double, py double, po double, gx double, gy double, go double, speed double, has_pose boolean, has_goal boolean"
    return events.groupBy("robot").applyInPandasWithState(run, STATUS, kept, "append", GroupStateTimeout.NoTimeout)


POINTS_REQUEST = "route_id long, map_id long, start_x double, start_y double, goal_x double, goal_y double"
# The messages of answers.
FOUND, NOT_FOUND = "Path generated successfully", "Failed to generate path"


def answer_points(requests: DataFrame, blocked: DataFrame, nodes: DataFrame, edges: DataFrame, frames: DataFrame, *, shortcut: float = 0.0) -> DataFrame:
    """route_id, success, message and path (world points, null where there is none) for POINTS_REQUEST rows.

    ``frames(map_id, height, resolution, x_offset, y_offset, rotation)`` place the maps in the world; the points of a
    request are its own start and goal with the nodes between them.
    """
    f = frames.select(F.col("map_id").cast("long").alias("map_id"), "height", "resolution", "x_offset", (F.col("y_offset") + F.col("height") * F.col("resolution")).alias("y_shift"), "rotation")
    known = requests.join(f, "map_id", "left")
    at = lambda end: world_to_pixel(F.col(f"{end}_x"), F.col(f"{end}_y"), F.col("resolution"), F.col("x_offset"), F.col("y_shift"), F.col("rotation"))
    pixels = known.withColumn("s", at("start")).withColumn("g", at("goal"))
    short = F.hypot(F.col("goal_x") - F.col("start_x"), F.col("goal_y") - F.col("start_y")) < shortcut  # in the world, whatever the map's resolution
    asked = pixels.filter("height IS NOT NULL").select("route_id", "map_id", short.alias("short"), F.col("s.row").alias("r0"), F.col("s.col").alias("c0"), F.col("g.row").alias("r1"), F.col("g.col").alias("c1"))
    found = find_routes(asked, blocked, nodes, edges, shortcut=shortcut).select("route_id", "found", "points")
    out = known.join(found, "route_id", "left")
    turned = lambda p: pixel_to_world(p["row"], p["col"], F.col("resolution"), F.col("x_offset"), F.col("y_shift"), F.col("rotation"))
    end = lambda k: F.array(F.struct(F.col(f"{k}_x").alias("x"), F.col(f"{k}_y").alias("y"), F.lit(0.0).alias("z")))
    inner = F.transform(F.slice("points", F.lit(2), F.greatest(F.size("points") - 2, F.lit(0))), turned)
    ok = F.coalesce("found", F.lit(False))
    return out.select("route_id", ok.alias("success"), F.when(ok, FOUND).otherwise(NOT_FOUND).alias("message"), F.when(ok, F.concat(end("start"), inner, end("goal"))).alias("path"))


def serve_points(requests: DataFrame, blocked: DataFrame, nodes: DataFrame, edges: DataFrame, frames: DataFrame, path: str, checkpoint: str, *, shortcut: float = 0.0):
    """Answer a stream of POINTS_REQUEST rows by ``answer_points``, one folder a micro-batch, each request once."""

    def answer(batch: DataFrame, number: int) -> None:
        answer_points(batch, blocked, nodes, edges, frames, shortcut=shortcut).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_robot_frame(x, y, robot_x, robot_y, heading):
    """struct(x, y): a world point as the robot sees it, x ahead and y to its left. Columns."""
    dx, dy = x - robot_x, y - robot_y
    return F.struct((dx * F.cos(heading) + dy * F.sin(heading)).alias("x"), (dy * F.cos(heading) - dx * F.sin(heading)).alias("y"))


def mapless_paths(goals: DataFrame, step: float = 1.0) -> DataFrame:
    """(robot, points): without a map, the straight way to each goal in the robot's frame, a point a metre.

    ``goals(robot, x, y, heading, goal_x, goal_y)``: pose and goal in the world.
    """
    g = goals.withColumn("g", to_robot_frame(F.col("goal_x"), F.col("goal_y"), F.col("x"), F.col("y"), F.col("heading")))
    return g.select("robot", upsample(F.lit(0.0), F.lit(0.0), F.col("g.x"), F.col("g.y"), F.lit(float(step))).alias("points"))


def robot_paths(paths: DataFrame) -> DataFrame:
    """paths(route_id, points, x, y, heading) with the points in the robot's frame, for ``planned_inputs``."""
    return paths.withColumn("points", F.transform("points", lambda p: to_robot_frame(p["x"], p["y"], F.col("x"), F.col("y"), F.col("heading"))))


def dispatch(robots: DataFrame) -> DataFrame:
    """Adds mode to robots(goal_x, mapless): wait without a goal, else mapless or map."""
    return robots.withColumn("mode", F.when(F.col("goal_x").isNull(), "wait").when(F.col("mapless"), "mapless").otherwise("map"))


def markers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, kind, points): a point list of all nodes, and a line list with two points an edge, in world metres."""
    at = lambda k: nodes.select("map_id", F.col("node_id").alias(k), F.struct("x", "y", F.lit(0.0).alias("z")).alias(f"{k}_p"))
    points = nodes.groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("node_id", F.struct("x", "y", F.lit(0.0).alias("z")).alias("p")))).alias("a"))
    points = points.select("map_id", F.lit("points").alias("kind"), F.transform("a", lambda v: v["p"]).alias("points"))
    lines = edges.join(at("src"), ["map_id", "src"]).join(at("dst"), ["map_id", "dst"]).groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "src_p", "dst_p"))).alias("a"))
    return points.union(lines.select("map_id", F.lit("lines").alias("kind"), F.flatten(F.transform("a", lambda v: F.array(v["src_p"], v["dst_p"]))).alias("points")))


@dataclass(frozen=True)
class Parameters:
    """What a navigator runs with; the defaults stand where a setting is not given."""

    tick_hz: float = 10.0
    tolerance: float = 1.0
    mapless: bool = False
    frame: str = "map"
    vectors: int = 11

    @classmethod
    def from_settings(cls, settings: dict[str, object]) -> Parameters:
        unknown = set(settings) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return cls(**settings)


def in_frame(requests: DataFrame, frame: str = "map") -> DataFrame:
    """Requests (start_frame, goal_frame, cancelled) a planner takes up: both ends in its frame, and not cancelled."""
    return requests.filter((F.col("start_frame") == frame) & (F.col("goal_frame") == frame) & ~F.coalesce("cancelled", F.lit(False)))


def planned_inputs(paths: DataFrame, count: int = 11) -> DataFrame:
    """(route_id, vectors): policy input rows from paths(route_id, points array<struct<x, y>>)."""
    return paths.select("route_id", F.when(F.size("points") > 0, route_vectors(F.col("points"), count)).alias("vectors"))


def model_type(path: str) -> str | None:
    """onnx or jit by extension; None for others."""
    return "onnx" if path.endswith(".onnx") else "jit" if path.endswith((".jit", ".pt")) else None
