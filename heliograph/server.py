"""HTTP face of an engine: health, status, context, synonyms, capture, recall, code search."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.api import Engine, query_param

#: Bytes of a request's body at most.
LARGEST = 16 << 20
EVENT = "session string, kind string, body string, ts long, branch string, ref_path string, ref_line_start int, ref_line_end int"


class BadRequest(ValueError):
    pass


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.orderBy("position").select(F.to_json(F.struct("*"))).collect()]


class App:
    """Requests as calls: (method, target, body) to (status, content type, text). One write at a time."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.writing = engine, threading.Lock()

    def __call__(self, method: str, target: str, body: bytes = b"") -> tuple[int, str, str]:
        url = urlsplit(target)
        handler = getattr(self, f"_{method.lower()}_{url.path.strip('/').replace('/', '_')}", None) if url.path.strip("/") else None
        if handler is None:
            return self._json(404, {"error": "not found"})
        try:
            if method == "GET":
                return handler(url.query)
            given = json.loads(body or b"{}")
            if not isinstance(given, dict):
                raise BadRequest("the body is not an object")
            return handler(given)
        except (BadRequest, json.JSONDecodeError, UnicodeDecodeError, KeyError) as e:
            return self._json(400, {"error": str(e)})

    @staticmethod
    def _json(status: int, value: object) -> tuple[int, str, str]:
        return status, "application/json", json.dumps(value, ensure_ascii=False, default=str)

    def _get_health(self, query: str):
        return self._json(200, {"ok": True})

    def _get_status(self, query: str):
        return self._json(200, self.engine.status())

    def _get_context(self, query: str):
        budget = query_param(query, "budget") or "1000"
        if not budget.isdigit():
            raise BadRequest("budget is not a number")
        return 200, "text/markdown; charset=utf-8", self.engine.context(query_param(query, "query") or "", int(budget))

    def _get_syn(self, query: str):
        return self._json(200, [r.asDict() for r in self.engine.store.read("synonyms").orderBy("term", "expansion").collect()])

    def _post_syn(self, given: dict):
        try:
            with self.writing:
                return self._json(200, self.engine.synonyms(given["op"], given["term"], given.get("expansion")))
        except ValueError as e:
            raise BadRequest(str(e)) from e

    def _post_capture(self, given: dict):
        if not str(given.get("body", "")).strip():
            raise BadRequest("there is no body")
        row = {"session": "", "kind": "other", "ts": self.engine.now()} | given
        names = [f.split()[0] for f in EVENT.split(", ")]
        with self.writing:
            n = self.engine.capture(self.engine.spark.createDataFrame([tuple(row.get(c) for c in names)], EVENT))
        return self._json(200, {"stored": True} if n else {"stored": False, "reason": "duplicate"})

    def _post_recall(self, given: dict):
        return self._json(200, _rows(self.engine.recall(given["query"], int(given.get("limit", 10)))))

    def _post_code_search(self, given: dict):
        found, warnings = self.engine.code_search(given["query"], int(given.get("limit", 10)), scope=given.get("scope", "all"), path=given.get("path"), cwd=given.get("cwd"))
        return self._json(200, {"results": _rows(found), "warnings": warnings})


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound but not yet running (``serve_forever``)."""
    app = App(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            if length > LARGEST:
                status, kind, text = 413, "application/json", '{"error": "too large"}'
            else:
                status, kind, text = app(self.command, self.path, self.rfile.read(length))
            raw = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
