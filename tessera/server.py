"""The service over HTTP: health, models, sources, assets and chat completions.

Requests map to ``Engine``; what is slow runs as Spark jobs under a tag, which a timeout or a client that
goes away cancels.  One thread a connection; ``Engine.gate`` bounds how many of them work.
"""

from __future__ import annotations

import json
import mimetypes
import select
import socket
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException

from tessera import service

#: Seconds between two looks at whether a client is still there.
WATCH = 0.5
#: Failures and the codes that tell of them, the first that fits; a missing index or mirror is not the client's.
STATUSES = [(service.Busy, 503), (TimeoutError, 504), (FileNotFoundError, 503), (AnalysisException, 503), (ValueError, 400), (KeyError, 400), (TypeError, 400), (AttributeError, 400)]


class App:
    """What the routes answer from."""

    def __init__(self, engine: service.Engine, mirror_root: str):
        self.engine, self.mirror_root = engine, mirror_root

    def warm_up(self) -> None:
        self.engine.load()

    def source(self, name: str) -> str | None:
        return service.source_text(self.engine.spark, self.mirror_root, name)

    def asset(self, name: str) -> bytes | None:
        path = service.asset_file(self.engine.spark, self.mirror_root, name)
        if path is None:
            return None
        row = self.engine.spark.read.format("binaryFile").load(path).select("content").first()
        return None if row is None else bytes(row["content"])

    def complete(self, request: dict, tag: str) -> dict:
        return self.engine.complete(request, tag)

    def query(self, request: dict, tag: str) -> dict:
        return self.engine.query(request, self.engine.timeout, tag)

    def cancel(self, tag: str) -> None:
        self.engine.spark.interruptTag(tag)


class Handler(BaseHTTPRequestHandler):
    app: App
    protocol_version = "HTTP/1.1"

    def log_message(self, *_: object) -> None:
        """Requests are not logged here."""

    def send(self, status: int, body: bytes, kind: str = "application/json", **headers: str) -> None:
        self.begun = True
        self.send_response(status)
        for name, value in {"Content-Type": kind, "Content-Length": str(len(body)), **headers}.items():
            self.send_header(name.replace("_", "-"), value)
        self.end_headers()
        self.wfile.write(body)

    def say(self, status: int, payload: dict, **headers: str) -> None:
        self.send(status, json.dumps(payload, ensure_ascii=False).encode(), **headers)

    def fail(self, status: int, message: str, **headers: str) -> None:
        self.say(status, {"error": {"message": message, "code": status}}, **headers)

    @contextmanager
    def told(self) -> Iterator[None]:
        """Every failure becomes a response, unless one has begun."""
        self.begun = False
        try:
            yield
        except ConnectionError:
            self.close_connection = True
        except Exception as failed:  # noqa: BLE001
            for kind, status in STATUSES:
                if isinstance(failed, kind):
                    break
            else:
                status = 500
            if self.begun:
                self.close_connection = True
                return
            more = {"Retry_After": str(failed.retry_after)} if isinstance(failed, service.Busy) else {}
            self.fail(status, f"bad request: {failed}" if status == 400 else str(failed).split("\n")[0] or type(failed).__name__, **more)

    def do_GET(self) -> None:
        with self.told():
            self.get()

    def do_POST(self) -> None:
        with self.told():
            self.post()

    def get(self) -> None:
        path = urlsplit(self.path).path
        if path == "/health":
            self.say(200, service.health() | {"admission": self.app.engine.gate.snapshot()})
        elif path == "/v1/models":
            self.say(200, service.models())
        elif path.startswith("/v1/sources/"):
            text = self.app.source(f"data/processed/{unquote(path.removeprefix('/v1/sources/'))}")
            self.fail(404, "no such source") if text is None else self.send(200, text.encode(), "text/markdown; charset=utf-8")
        elif path.startswith("/v1/assets/"):
            name = unquote(path.removeprefix("/v1/assets/"))
            data = self.app.asset(name)
            self.fail(404, "no such asset") if data is None else self.send(200, data, mimetypes.guess_type(name)[0] or "application/octet-stream")
        else:
            self.fail(404, "no such route")

    def post(self) -> None:
        size = self.headers.get("Content-Length") or "0"
        body = self.rfile.read(int(size)) if size.isdigit() else b""
        route = urlsplit(self.path).path
        if route not in ("/v1/chat/completions", "/v1/query"):
            self.fail(404, "no such route")
            return
        request = json.loads(body)
        if not isinstance(request, dict):
            raise ValueError("a request must be an object")
        tag = f"chat-{id(self)}-{threading.get_ident()}"
        if route == "/v1/query":
            if not isinstance(request.get("question"), str) or not request["question"].strip():
                raise ValueError("question must be a text")
            with self.watched(tag):
                made = self.app.query(request, tag)
            self.say(200, made)
        elif request.get("stream"):
            self.stream(request, tag)
        else:
            with self.watched(tag):
                made = self.app.complete(request, tag)
            self.say(200, made)

    def stream(self, request: dict, tag: str) -> None:
        """Events while the answer is being made: a status at once, the text when it is there."""
        service.last_message(request)  # what is wrong with a request is told before the stream begins
        self.app.engine.gate.check()
        with self.watched(tag):
            self.begun = True
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Connection", "close")
            self.end_headers()
            self.wfile.write(service.status_frame("searching").encode())
            self.wfile.flush()
            self.close_connection = True
            try:
                made = self.app.complete(request, tag)
            except (service.Busy, TimeoutError, ValueError, KeyError) as failed:
                self.wfile.write((service.frame({"error": {"message": str(failed)}}) + service.frame("[DONE]")).encode())
                return
            for event in service.stream(made["choices"][0]["message"]["content"]):
                self.wfile.write(event.encode())

    @contextmanager
    def watched(self, tag: str) -> Iterator[None]:
        """Cancel the jobs under ``tag`` if the client closes the connection meanwhile."""
        done = threading.Event()

        def watch() -> None:
            while not done.wait(WATCH):
                readable, _, _ = select.select([self.connection], [], [], 0)
                if readable and not self.connection.recv(1, socket.MSG_PEEK):
                    self.app.cancel(tag)
                    return

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            done.set()
            watcher.join()


def make_server(app: App, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is not running yet; port 0 takes a free one."""
    return ThreadingHTTPServer((host, port), type("Routes", (Handler,), {"app": app}))
