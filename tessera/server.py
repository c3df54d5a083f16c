"""A small HTTP service over the answer pipeline, on the standard library alone.

GET /health, GET /v1/info, POST /v1/query, POST /v1/calibrate. Errors come as
{"error": {"code", "message"}, "request_id"}. A query sees one policy from
beginning to end, however often it is replaced meanwhile.
"""

from __future__ import annotations

import hmac
import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from .operators.calibrate import Policy, _strict
from .plans import pipeline

# fixed values: limits of a query
MOST_CHARS, MOST_CONTEXT, MOST_RESULTS = 2000, 10, 50


@dataclass
class Settings:
    max_concurrency: int = 4
    slot_timeout: float = 30.0
    token: str | None = None

    def __post_init__(self):
        if self.max_concurrency < 1:
            raise ValueError("max_concurrency must be at least 1")


class Fault(Exception):
    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code = status, code


class Service:
    """The pipeline over one corpus, with a policy that can be swapped while questions run."""

    def __init__(self, chunks: DataFrame, policy: Policy | None = None, calibrate: Callable[..., Policy] | None = None, settings: Settings | None = None):
        self.chunks, self.policy, self.settings = chunks.persist(), policy, settings or Settings()
        self._calibrate = calibrate
        self._calibrated_at: str | None = None
        self._slots = threading.BoundedSemaphore(self.settings.max_concurrency)
        self._busy = threading.Lock()

    def info(self) -> dict:
        policy = self.policy
        return {"chunks": self.chunks.count(), "policy": policy and policy.summary() | {"calibrated_at": self._calibrated_at}, "max_concurrency": self.settings.max_concurrency}

    def query(self, body: dict) -> dict:
        allowed = {"query", "k_ctx", "top_k", "include_scores", "use_gate", "forced"}
        if extra := set(body) - allowed:
            raise Fault(422, "invalid_request", f"unknown fields: {sorted(extra)}")
        text, k, top = body.get("query"), body.get("k_ctx", 3), body.get("top_k", 10)
        if not isinstance(text, str) or not text.strip() or len(text) > MOST_CHARS:
            raise Fault(422, "invalid_request", f"query must be 1 to {MOST_CHARS} characters and not blank")
        for name, value, most in (("k_ctx", k, MOST_CONTEXT), ("top_k", top, MOST_RESULTS)):
            if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= most:
                raise Fault(422, "invalid_request", f"{name} must be 1 to {most}")
        policy = self.policy if body.get("use_gate", True) else None
        if not self._slots.acquire(timeout=self.settings.slot_timeout):
            raise Fault(429, "busy", "all readers are busy")
        try:
            spark = self.chunks.sparkSession
            row = pipeline.answer(self.chunks, spark.createDataFrame([(0, text)], "query_id long, text string"), policy, k, top, bool(body.get("forced", False))).first().asDict()
        finally:
            self._slots.release()
        row.pop("query_id")
        out = {k: row.pop(k) for k in ("answer", "abstained", "stage", "confidence", "citations", "evidence_quotes", "grounded", "reason")}
        out["gate"] = policy and policy.summary()
        if body.get("include_scores", False):
            out["features"] = row
        return _strict(out)

    def calibrate(self, body: dict, token: str | None) -> dict:
        if not self.settings.token:
            raise Fault(403, "disabled", "calibration needs a token on the server")
        if not token or not hmac.compare_digest(token, self.settings.token):
            raise Fault(401, "unauthorized", "wrong token")
        if self._calibrate is None:
            raise Fault(403, "disabled", "no evaluation set is configured")
        method, alpha, delta = body.get("method", "erm"), body.get("alpha", 0.2), body.get("delta", 0.1)
        if set(body) - {"method", "alpha", "delta", "seed"} or method not in ("erm", "ltt") or not all(isinstance(x, int | float) and 0 < x < 1 for x in (alpha, delta)):
            raise Fault(422, "invalid_request", "method must be erm or ltt, alpha and delta between 0 and 1")
        if not self._busy.acquire(blocking=False):
            raise Fault(409, "in_progress", "a calibration is running")
        try:
            policy = self._calibrate(method=method, alpha=alpha, delta=delta, seed=body.get("seed", 0))
            self.policy, self._calibrated_at = policy, datetime.now(UTC).isoformat()
            return policy.summary()
        finally:
            self._busy.release()


def handler(service: Service | None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("X-Request-ID", self.name)
            self.end_headers()
            self.wfile.write(data)

        def _run(self, work: Callable[[], dict]) -> None:
            self.name = self.headers.get("X-Request-ID") or uuid.uuid4().hex
            try:
                self._send(200, work())
            except Fault as e:
                self._send(e.status, {"error": {"code": e.code, "message": str(e)}, "request_id": self.name})
            except Exception:  # the client learns no internals
                self._send(500, {"error": {"code": "internal", "message": "internal error"}, "request_id": self.name})

        def _body(self) -> dict:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError as e:
                raise Fault(422, "invalid_request", "the body must be JSON") from e
            if not isinstance(body, dict):
                raise Fault(422, "invalid_request", "the body must be an object")
            return body

        def _ready(self) -> Service:
            if service is None:
                raise Fault(503, "not_ready", "no index is loaded")
            return service

        def do_GET(self):  # noqa: N802
            def work() -> dict:
                if self.path == "/health":
                    self._ready()
                    return {"status": "ok"}
                if self.path == "/v1/info":
                    return self._ready().info()
                raise Fault(404, "not_found", "no such path")

            self._run(work)

        def do_POST(self):  # noqa: N802
            def work() -> dict:
                if self.path == "/v1/query":
                    return self._ready().query(self._body())
                if self.path == "/v1/calibrate":
                    token = (self.headers.get("Authorization") or "").removeprefix("Bearer ").strip()
                    return self._ready().calibrate(self._body(), token or None)
                raise Fault(404, "not_found", "no such path")

            self._run(work)

        def log_message(self, *args):
            pass

    return Handler


def serve(service: Service | None, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound but doesn't run yet; call serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(service))
