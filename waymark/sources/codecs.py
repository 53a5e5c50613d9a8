"""Graph and image codecs: GML, GeoJSON and PNG."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bulky


def to_gml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, content): one GML text for a map; lists are repeated keys. World places to four decimals: the nodes' x, y
    where they have them, else those of a map of 5 cm a pixel at the origin."""
    place = (F.col("x"), F.col("y")) if "x" in nodes.columns else (F.col("col") * 0.05, -F.col("row") * 0.05)
    n = nodes.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("node_id", F.format_string('  node [\n    id %d\n    label "%d"\n    pixel %d\n    pixel %d\n    world %s\n    world %s\n    world 0.0\n  ]', "node_id", "node_id", "row", "col", *[v.cast("decimal(12,4)").cast("string") for v in place]).alias("t")))).alias("n"))
    e = edges.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", F.format_string('  edge [\n    source %d\n    target %d\n    weight %s\n    edge_type "%s"\n  ]', "src", "dst", F.col("weight").cast("decimal(12,4)").cast("string"), "edge_type").alias("t")))).alias("e"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), "\n")
    out = bulky(n).join(e, "map_id", "left")
    return out.select("map_id", F.concat(F.lit("graph [\n"), text("n"), F.lit("\n"), F.coalesce(text("e"), F.lit("")), F.lit("\n]\n")).alias("content"))


def parse_gml_nodes(files: DataFrame) -> DataFrame:
    """Nodes of GML texts(map_id, content) that have an id, x and y: map_id, node_id, row, col, x, y."""
    parts = files.select("map_id", F.explode(F.expr(r"regexp_extract_all(content, '(?s)node \\[(.*?)\\]', 1)")).alias("t"))
    many = lambda k: F.expr(rf"regexp_extract_all(t, '\\b{k} ([-0-9.]+)', 1)")
    got = parts.select("map_id", F.expr(r"try_cast(regexp_extract(t, '\\bid ([0-9]+)', 1) as int)").alias("node_id"), many("world").alias("world"), many("pixel").alias("pixel"))
    return got.filter(F.col("node_id").isNotNull() & (F.size("world") >= 2)).select("map_id", "node_id", F.get("pixel", F.lit(0)).cast("int").alias("row"), F.get("pixel", F.lit(1)).cast("int").alias("col"), F.get("world", F.lit(0)).cast("double").alias("x"), F.get("world", F.lit(1)).cast("double").alias("y"))


def parse_gml_edges(files: DataFrame) -> DataFrame:
    """Edges of GML texts with a source and a target; weight and edge_type may lack."""
    parts = files.select("map_id", F.explode(F.expr(r"regexp_extract_all(content, '(?s)edge \\[(.*?)\\]', 1)")).alias("t"))
    one = lambda k, p: F.nullif(F.regexp_extract("t", rf"\b{k} {p}", 1), F.lit(""))
    got = parts.select("map_id", one("source", "([0-9]+)").cast("int").alias("src"), one("target", "([0-9]+)").cast("int").alias("dst"), one("weight", "([-0-9.]+)").cast("double").alias("weight"), one("edge_type", '"([^"]*)"').alias("edge_type"))
    return got.filter("src IS NOT NULL AND dst IS NOT NULL")


def to_geojson(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, id, feature JSON): a Point for a node, two MultiLineStrings for an edge with known ends.

    Points are the nodes' world places x, y where they have them, else column and negative row.
    """
    xy = F.array("x", "y") if "x" in nodes.columns else F.array(F.col("col").cast("double"), -F.col("row").cast("double"))
    # nodes and edges as rows of one table: windows within a map name an edge's ends, so that dealt maps meet no exchange
    none = F.lit(None)
    n = nodes.select("map_id", F.lit(0).alias("kind"), F.col("node_id").cast("long").alias("src"), F.col("node_id").cast("long").alias("dst"), xy.alias("xy"))
    rows = n.union(edges.select("map_id", F.lit(1), F.col("src").cast("long"), F.col("dst").cast("long"), none.cast("array<double>")))
    for end in ("src", "dst"):
        rows = rows.withColumn(f"{end}_xy", F.first("xy", ignorenulls=True).over(Window.partitionBy("map_id", end).orderBy("kind"))).filter(F.col(f"{end}_xy").isNotNull())
    of_map = Window.partitionBy("map_id").orderBy("kind", "src", "dst").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("map_id", "kind", "src", "dst", "src_xy", "dst_xy", F.sum(1 - F.col("kind")).over(of_map).alias("n"), F.sum("kind").over(of_map).alias("k"))
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("src").alias("id"), F.lit("map").alias("frame")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.col("src_xy").alias("coordinates")).alias("geometry")))

    def line(way: int, a: str, b: str):
        id_ = (F.col("n") + 2 * (F.col("k") - 1) + way).alias("id")
        shown = F.struct(F.lit("Feature").alias("type"), F.struct(id_, F.col(a).alias("startid"), F.col(b).alias("endid")).alias("properties"), F.struct(F.lit("MultiLineString").alias("type"), F.array(F.array(f"{a}_xy", f"{b}_xy")).alias("coordinates")).alias("geometry"))
        return F.struct(id_, F.to_json(shown).alias("feature"))

    features = F.when(F.col("kind") == 0, F.array(F.struct(F.col("src").alias("id"), point.alias("feature")))).otherwise(F.array(line(0, "src", "dst"), line(1, "dst", "src")))
    return rows.select("map_id", F.explode(features).alias("f")).select("map_id", "f.id", "f.feature")


def geojson_rows(features: DataFrame) -> DataFrame:
    """Features read back: map_id, id, type, frame (empty for lines), ends (-1 for points), and the geometry's first and last point."""
    got = lambda path: F.get_json_object("feature", path)
    line = got("$.geometry.type") == "MultiLineString"
    at = lambda a, b: F.when(line, got(f"$.geometry.coordinates[0][{a}][{b}]")).otherwise(got(f"$.geometry.coordinates[{b}]")).cast("double")
    return features.select("map_id", "id", got("$.geometry.type").alias("type"), *[F.coalesce(got(f"$.properties.{k}").cast("int"), F.lit(-1)).alias(k) for k in ("startid", "endid")], F.coalesce(got("$.properties.frame"), F.lit("")).alias("frame"), *[at(i, j).alias(f"{'xy'[j]}{i}") for i in (0, 1) for j in (0, 1)])


def geojson_counts(features: DataFrame) -> DataFrame:
    kind = F.get_json_object("feature", "$.geometry.type")
    return features.groupBy("map_id").agg(F.sum((kind == "Point").cast("long")).alias("points"), F.sum((kind == "MultiLineString").cast("long")).alias("lines"), F.max("id").alias("last_id"))


HEAD = '{"type":"FeatureCollection","name":"graph","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}},'
DATE = "EEE MMM dd hh:mm:ss a z yyyy"


def empty_collection() -> str:
    """The text of a collection without features."""
    return HEAD + f'"date_generated":"{datetime.now().astimezone().strftime("%a %b %d %I:%M:%S %p %Z %Y")}","features":[]}}'


def feature_collection(features: DataFrame) -> DataFrame:
    """(map_id, content): one FeatureCollection for a map."""
    parts = features.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("id", "feature"))).alias("f"))
    return parts.select("map_id", F.concat(F.lit(HEAD + '"date_generated":"'), F.date_format(F.current_timestamp(), DATE), F.lit('","features":['), F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}")).alias("content"))


# --- PNG ----------------------------------------------------------------------------------------------------------


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit grey, RGB or RGBA image; other values are clipped to bytes."""
    a = np.clip(image, 0, 255).astype(np.uint8)
    if a.ndim == 2:
        a = a[:, :, None]
    kind = {1: 0, 3: 2, 4: 6}.get(a.shape[2])
    if kind is None:
        raise ValueError("an image has 1, 3 or 4 channels")
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """A non-interlaced PNG of 8 or 16 bits as (height, width, channels); 16 bits keep the high byte."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("Invalid image.")
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or lace:
        raise ValueError("Invalid image.")
    bpp = channels * depth // 8
    image = png_rows(zlib.decompress(body), h, w * bpp, bpp).reshape(h, w, bpp)
    return image[:, :, ::2] if depth == 16 else image


def png_rows(raw: bytes, height: int, width: int, bpp: int) -> np.ndarray:
    """(height, width) bytes of a PNG's rows with their filters undone; bpp is the bytes of a pixel."""
    rows, out, prev = np.frombuffer(raw, np.uint8).reshape(height, 1 + width), np.zeros((height, width), np.uint8), np.zeros(width, np.int64)
    for r in range(height):
        f, line = int(rows[r, 0]), rows[r, 1:].astype(np.int64)
        if f == 2:
            line = line + prev
        elif f == 1:  # sums along each byte of the pixels
            full = np.zeros(-(-width // bpp) * bpp, np.int64)
            full[:width] = line
            line = np.cumsum(full.reshape(-1, bpp), axis=0).ravel()[:width]
        elif f in (3, 4):
            for i in range(len(line)):
                a, b, c = (int(line[i - bpp]), int(prev[i]), int(prev[i - bpp])) if i >= bpp else (0, int(prev[i]), 0)
                p = (a + b) // 2 if f == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[i] = (line[i] + p) & 255
        elif f:
            raise ValueError("Invalid image.")
        prev = line & 255
        out[r] = prev
    return out


def grey(image: np.ndarray) -> np.ndarray:
    """Grey raster of a decoded image."""
    if image.shape[2] <= 2:
        return image[:, :, 0]
    return np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
