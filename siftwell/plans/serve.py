"""The search over HTTP: POST /search, GET /healthz, GET /metrics. Every request is a search of its own on one session."""

from __future__ import annotations

import json
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftwell.operators import observe
from siftwell.plans.search import SearchSpec, search


class Service(ThreadingHTTPServer):
    """Answers with the defaults of a server where a request gives no value of its own."""

    def __init__(self, spark: SparkSession, defaults: dict, address: tuple[str, int] = ("127.0.0.1", 0)):
        super().__init__(address, Handler)
        self.spark, self.defaults = spark, defaults
        self.stage_ms: Counter[tuple[str, int]] = Counter()
        """How often a stage took so many milliseconds: what the metrics are made of. Bounded by stages and whole seconds."""
        self.lock = Lock()

    def find(self, request: dict) -> dict:
        known = SearchSpec.from_request({"symbol": "-", **self.defaults})
        summary = search(self.spark, SearchSpec.from_request({"symbol": "", **request}, known) if request.get("symbol") else SearchSpec(""))
        with self.lock:
            for stage, ms in summary.stage_ms.items():
                self.stage_ms[stage, min(ms, 1000) if ms < 1000 else ms // 1000 * 1000] += 1
        return {"summary": json.loads(summary.to_json())}

    def metrics(self) -> str:
        with self.lock:
            rows = [(s, float(ms), n) for (s, ms), n in self.stage_ms.items()]
        if not rows:
            return ""
        runs = self.spark.createDataFrame(rows, "stage string, ms double, n int").select("stage", "ms", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
        return "\n".join(r.line for r in observe.exposition(runs, "stage", "ms", "stages_total", "stage_latency_ms").orderBy("line_no").collect()) + "\n"


class Handler(BaseHTTPRequestHandler):
    server: Service

    def _answer(self, status: int, body: str, kind: str = "application/json") -> None:
        raw = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self) -> None:
        if self.path == "/healthz":
            self._answer(200, json.dumps({"status": "ok"}))
        elif self.path == "/metrics":
            self._answer(200, self.server.metrics(), "text/plain; version=0.0.4")
        else:
            self._answer(404, json.dumps({"error": "not found"}))

    def do_POST(self) -> None:
        if self.path != "/search":
            self._answer(404, json.dumps({"error": "not found"}))
            return
        try:
            request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            if not isinstance(request, dict):
                raise ValueError("a request is an object")
            self._answer(200, json.dumps(self.server.find(request)))
        except ValueError as e:
            self._answer(400, json.dumps({"error": str(e)}))

    def log_message(self, *args) -> None:
        """Requests are logged by the search itself."""
