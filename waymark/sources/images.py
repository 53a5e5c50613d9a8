"""Map images as a source and sink: files to rasters with null on failure, uploads and URIs with a service's errors.

Decoded here: PNG of any colour type and depth (not interlaced), and the portable grey and colour maps (PGM, PPM). Files
are read by Spark's ``binaryFile`` source and decoded in Arrow batches, so any store that Spark reads will do.
"""

from __future__ import annotations

import mimetypes
import re
import struct
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .codecs import encode_png, png_rows

RASTER = "path string, height int, width int, channels int, pixels binary"
# The messages of failed decoding and loading.
NOT_8_BIT, INVALID, EMPTY, NO_IMAGE, NO_SOURCE, NO_THRESHOLD = "Map image must be 8-bit.", "Invalid image.", "Empty image.", "Map must be an image file.", "Map file or URI is not provided.", "Occupancy threshold is not provided for occupancy map."
FETCH_SECONDS = 10


def _samples(data: bytes) -> tuple[np.ndarray, int, np.ndarray | None]:
    """(height, width, channels) as stored, bits of a sample, and the palette if there is one."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] in (b"P5", b"P6", b"P2", b"P3"):
        return _portable(data)
    raise ValueError(INVALID)


def _png(data: bytes) -> tuple[np.ndarray, int, np.ndarray | None]:
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if (kind in (b"IHDR", b"PLTE", b"IDAT") and at + 12 + n > len(data)) or (kind == b"IHDR" and n != 13) or (kind == b"PLTE" and n % 3):
            raise ValueError(INVALID)
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[6]:
        raise ValueError(INVALID)
    w, h, depth, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (1, 2, 4, 8, 16) or (colour == 3) != (palette is not None and colour == 3):
        raise ValueError(INVALID)
    try:
        rows = png_rows(zlib.decompress(b"".join(body)), h, -(-w * channels * depth // 8), max(1, channels * depth // 8))
    except (zlib.error, ValueError) as e:
        raise ValueError(INVALID) from e
    if depth == 16:
        return rows.view(">u2").reshape(h, w, channels).astype(np.uint16), 16, None
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, : w * channels]
    out = rows.reshape(h, w, channels)
    if colour == 3:
        if int(out.max(initial=0)) >= len(palette):
            raise ValueError(INVALID)
        return out, 8, palette
    return (out * (255 // ((1 << depth) - 1)) if depth < 8 else out).astype(np.uint8), 8, None


def _portable(data: bytes) -> tuple[np.ndarray, int, np.ndarray | None]:
    m = re.match(rb"P([2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not m:
        raise ValueError(INVALID)
    w, h, most = (int(m[i]) for i in (2, 3, 4))
    channels = 3 if m[1] in (b"3", b"6") else 1
    if not 0 < most < 65_536:
        raise ValueError(INVALID)
    kind = ">u2" if most > 255 else np.uint8
    try:
        values = np.frombuffer(data, kind, h * w * channels, m.end()) if m[1] in (b"5", b"6") else np.array(data[m.end() :].split()[: h * w * channels], int)
        out = values.reshape(h, w, channels).astype(np.int64)
    except ValueError as e:
        raise ValueError(INVALID) from e
    if most > 255:
        return (out * 65_535 // most).astype(np.uint16), 16, None
    return (out if most == 255 else out * 255 // most).astype(np.uint8), 8, None


def _rgb(samples: np.ndarray, palette: np.ndarray | None) -> np.ndarray:
    if palette is not None:
        return palette[samples[:, :, 0]]
    return samples[:, :, :3] if samples.shape[2] >= 3 else np.repeat(samples[:, :, :1], 3, axis=2)


def _grey(samples: np.ndarray, palette: np.ndarray | None) -> np.ndarray:
    if palette is None and samples.shape[2] <= 2:
        return samples[:, :, 0]
    r, g, b = (_rgb(samples, palette)[:, :, k].astype(np.uint32) for k in range(3))
    return ((r * 19_595 + g * 38_470 + b * 7_471 + 0x8000) >> 16).astype(np.uint8)


def decode_grayscale(data: bytes | None) -> np.ndarray:
    """Image bytes as (height, width) bytes of grey; an error for more than 8 bits, or what is no image."""
    if not data:
        raise ValueError(EMPTY)
    samples, depth, palette = _samples(bytes(data))
    if depth > 8:
        raise ValueError(NOT_8_BIT)
    return _grey(samples, palette)


def grayscale(data: bytes) -> np.ndarray | None:
    """As a file is read: 16 bits keep the high byte, and None stands for whatever can't be decoded."""
    try:
        samples, depth, palette = _samples(bytes(data))
    except ValueError:
        return None
    return _grey((samples >> 8).astype(np.uint8) if depth > 8 else samples, palette)


def rgb(data: bytes) -> np.ndarray | None:
    """(height, width, 3), or None."""
    try:
        samples, depth, palette = _samples(bytes(data))
    except ValueError:
        return None
    return _rgb((samples >> 8).astype(np.uint8) if depth > 8 else samples, palette)


def rasters(files: DataFrame, decode: Callable[[bytes], np.ndarray | None] = grayscale) -> DataFrame:
    """RASTER rows of files(path, content): nulls where the content can't be decoded."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_py()
                image = decode(raw) if raw else None
                rows.append((path, None, None, None, None) if image is None else (path, *image.shape[:2], 1 if image.ndim == 2 else image.shape[2], np.ascontiguousarray(image).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["path", "height", "width", "channels", "pixels"])

    return files.select("path", "content").mapInArrow(run, RASTER)


def read_grayscale(spark: SparkSession, *paths: str) -> DataFrame:
    """The images at paths (files, folders or patterns) as grey rasters, a row each."""
    return rasters(spark.read.format("binaryFile").load(list(paths)))


def read_rgb(spark: SparkSession, *paths: str) -> DataFrame:
    return rasters(spark.read.format("binaryFile").load(list(paths)), rgb)


def raster_cells(images: DataFrame) -> DataFrame:
    """cells(path, row, col, value) of grey RASTER rows; what wasn't decoded has none."""

    def run(batches):
        for b in batches:
            for path, h, w, _, pixels in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if pixels is not None:
                    for r in range(0, h, max(1, 1_000_000 // max(1, w))):
                        some = np.frombuffer(pixels, np.uint8).reshape(h, w)[r : r + max(1, 1_000_000 // max(1, w))]
                        rr, cc = np.indices(some.shape)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * some.size), pa.array((rr.ravel() + r).astype(np.int32)), pa.array(cc.ravel().astype(np.int32)), pa.array(some.ravel().astype(np.int32))], ["path", "row", "col", "value"])

    return images.mapInArrow(run, "path string, row int, col int, value int")


def png_files(packed: DataFrame) -> DataFrame:
    """(path, content): packed maps (``operators.packed``) as grey PNGs, 0 on walls and 255 elsewhere; path is the map's id."""

    def run(batches):
        for b in batches:
            out = []
            for h, w, walls in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                image = np.full(h * w, 255, np.uint8)
                image[walls.values.to_numpy()] = 0
                out.append(encode_png(image.reshape(h, w)))
            yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in b.column(0).to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    return packed.select("map_id", "height", "width", "walls").mapInArrow(run, "path string, content binary")


def write_image(path: str, image: np.ndarray) -> bool:
    """Write a PNG: grey, RGB or RGBA by shape, other values clipped to bytes. False for other shapes or a failed write."""
    try:
        data = encode_png(np.asarray(image))
    except ValueError:
        return False
    try:
        with open(path, "wb") as f:
            f.write(data)
    except OSError:
        return False
    return True


# --- uploads and URIs ---------------------------------------------------------------------------------------------


class BadRequest(ValueError):
    """What a service answers with status 400."""


def from_upload(data: bytes, content_type: str | None, filename: str | None) -> bytes:
    """An upload's bytes, if its type, or else its name, says image."""
    kind = content_type or ""
    if not kind.startswith("image/"):
        kind = mimetypes.guess_type(filename or "")[0] or ""
    if not kind.startswith("image/"):
        raise BadRequest(NO_IMAGE)
    return data


def _fetch(uri: str) -> tuple[bytes, str]:
    with urllib.request.urlopen(uri, timeout=FETCH_SECONDS) as answer:
        return answer.read(), answer.headers.get("content-type") or ""


def from_uri(uri: str, fetch: Callable[[str], tuple[bytes, str]] = _fetch) -> bytes:
    """The bytes at a URI, if the answer's type, or without one the URI's ending, says image."""
    try:
        data, kind = fetch(uri)
    except (OSError, urllib.error.URLError, ValueError) as e:
        raise BadRequest(f"Failed to load map URI: {e}") from e
    kind = kind.split(";")[0].strip().lower() or mimetypes.guess_type(uri)[0] or ""
    if not kind.startswith("image/"):
        raise BadRequest(NO_IMAGE)
    return data


def load(upload: tuple[bytes, str | None, str | None] | None, uri: str | None, fetch: Callable[[str], tuple[bytes, str]] = _fetch) -> bytes:
    """Of an upload (bytes, type, name) and a URI, the upload wins; with neither the request is bad."""
    if upload is not None:
        return from_upload(*upload)
    if uri:
        return from_uri(uri, fetch)
    raise BadRequest(NO_SOURCE)


def decode_map(data: bytes, threshold: int | None) -> np.ndarray:
    """A map's grey raster; no threshold, no bytes and undecodable bytes are bad requests."""
    if threshold is None:
        raise BadRequest(NO_THRESHOLD)
    try:
        return decode_grayscale(data)
    except ValueError as e:
        raise BadRequest(str(e)) from e
