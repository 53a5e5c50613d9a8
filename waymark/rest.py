"""The service over HTTP, by the standard library alone: routes under /v1, forms and JSON, and a client."""

from __future__ import annotations

import argparse
import json
import logging
import urllib.error
import urllib.request
import uuid
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .manager import MapManager, Service

VERSION = "/v1"
LEVELS = ("debug", "info", "warning", "error", "critical")
log = logging.getLogger("waymark.rest")


def log_level(name: str) -> int:
    """A level's number by its name, in either case."""
    if name.lower() not in LEVELS:
        raise ValueError(f"unknown log level: {name}")
    return getattr(logging, name.upper())


def parse_form(content_type: str, body: bytes) -> tuple[dict[str, str], tuple[bytes, str | None, str | None] | None]:
    """(fields, upload as (bytes, type, name)) of a multipart or URL-encoded form."""
    if content_type.startswith("multipart/form-data"):
        message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
        fields, upload = {}, None
        for part in message.iter_parts():
            name, data = part.get_param("name", header="content-disposition"), part.get_payload(decode=True) or b""
            if name == "map_file":
                upload = (data, part.get_content_type() if part["content-type"] else None, part.get_filename())
            elif name:
                fields[name] = data.decode()
        return fields, upload
    return {k: v[-1] for k, v in parse_qs(body.decode(), keep_blank_values=True).items()}, None


class Handler(BaseHTTPRequestHandler):
    service: Service

    def _send(self, status: int, body: object) -> None:
        data, kind = (body, "image/png") if isinstance(body, bytes) else (json.dumps(body).encode(), "application/json")
        self.send_response(status)
        self.send_header("content-type", kind)
        self.send_header("content-length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _answer(self, make) -> None:
        try:
            self._send(*make())
        except (KeyError, TypeError, ValueError) as e:
            self._send(422, {"detail": f"unreadable request: {e}"})
        except Exception as e:
            log.exception("request failed")
            self._send(500, {"detail": str(e)})

    def log_message(self, form: str, *args) -> None:
        log.info(form, *args)

    def do_GET(self) -> None:  # noqa: N802
        url = urlsplit(self.path)
        asked = parse_qs(url.query)
        ask = {
            f"{VERSION}/health": self.service.health,
            f"{VERSION}/graph": lambda: self.service.graph(asked["map_id"][0]),
            f"{VERSION}/graph/visualize": lambda: self.service.visualize(asked["map_id"][0]),
        }.get(url.path)
        self._answer(ask or (lambda: (404, {"detail": "Not Found"})))

    def do_POST(self) -> None:  # noqa: N802
        path, body = urlsplit(self.path).path, self.rfile.read(int(self.headers.get("content-length") or 0))
        point = lambda p: (float(p["x"]), float(p["y"]))

        def routed():
            q = json.loads(body)
            status, found = self.service.route(q["map_id"], point(q["start"]), point(q["goal"]))
            return status, [{"x": p[0], "y": p[1], "z": p[2] if len(p) > 2 else 0.0} for p in found] if status == 200 else found

        def nearest():
            q = json.loads(body)
            return self.service.nearest_nodes(q["map_id"], [point(p) for p in q["points"]])

        ask = {
            f"{VERSION}/graph/generate": lambda: self.service.generate_form(*parse_form(self.headers.get("content-type") or "", body)),
            f"{VERSION}/graph/nearest_nodes": nearest,
            f"{VERSION}/graph/route": routed,
        }.get(path)
        self._answer(ask or (lambda: (404, {"detail": "Not Found"})))


def server(host: str = "0.0.0.0", port: int = 8000, folder: str | None = None) -> ThreadingHTTPServer:
    """A server to be started by ``serve_forever``."""
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"service": Service(MapManager(folder=folder))}))


class Client:
    """Calls to a running server; answers are (status, body)."""

    def __init__(self, base: str, timeout: float = 30) -> None:
        self.base, self.timeout = base.rstrip("/") + VERSION, timeout

    def _call(self, path: str, data: bytes | None = None, kind: str = "application/json") -> tuple[int, object]:
        request = urllib.request.Request(self.base + path, data, {"content-type": kind} if data is not None else {})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as a:
                status, body, kind = a.status, a.read(), a.headers.get_content_type()
        except urllib.error.HTTPError as e:
            status, body, kind = e.code, e.read(), e.headers.get_content_type()
        return status, json.loads(body) if kind == "application/json" else body

    def health(self):
        return self._call("/health")

    def generate(self, image: bytes | None = None, filename: str = "map.png", **fields):
        mark = uuid.uuid4().hex
        parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
        if image is not None:
            parts.append(f'--{mark}\r\nContent-Disposition: form-data; name="map_file"; filename="{filename}"\r\nContent-Type: image/png\r\n\r\n'.encode() + image + b"\r\n")
        return self._call("/graph/generate", b"".join(parts) + f"--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}")

    def graph(self, map_id: str):
        return self._call(f"/graph?map_id={urllib.request.quote(map_id)}")

    def visualize(self, map_id: str):
        return self._call(f"/graph/visualize?map_id={urllib.request.quote(map_id)}")

    def nearest_nodes(self, map_id: str, points: list[tuple[float, float]]):
        return self._call("/graph/nearest_nodes", json.dumps({"map_id": map_id, "points": [{"x": x, "y": y, "z": 0.0} for x, y in points]}).encode())

    def route(self, map_id: str, start: tuple[float, float], goal: tuple[float, float]):
        point = lambda p: {"x": p[0], "y": p[1], "z": 0.0}
        return self._call("/graph/route", json.dumps({"map_id": map_id, "start": point(start), "goal": point(goal)}).encode())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Serve maps over HTTP.")
    parser.add_argument("--host", default="0.0.0.0")
    parser.add_argument("--port", type=int, default=8000)
    parser.add_argument("--log-level", default="info", choices=LEVELS)
    parser.add_argument("--folder", help="where pictures are kept")
    a = parser.parse_args(argv)
    logging.basicConfig(level=log_level(a.log_level), format="%(asctime)s %(levelname)s %(name)s %(filename)s:%(lineno)d %(message)s")
    with server(a.host, a.port, a.folder) as s:
        s.serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
