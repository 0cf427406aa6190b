"""Source search over HTTP: GET /search?q=&source=&n=, /sources and /health, as JSON.

Each request is a thread; the session's FAIR pools keep a long search from holding up short ones.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from lattice.tools import Engine

DEFAULT_PORT = 8002


def answer(engine: Engine, target: str) -> tuple[int, dict]:
    """Status and body for a request's path and query."""
    url = urlsplit(target)
    asked = dict(parse_qsl(url.query))
    if url.path == "/health":
        listed = engine.source_list()
        return 200, {"status": "ok", "total": sum(s["total"] for s in listed), "sources": len(listed)}
    if url.path == "/sources":
        return 200, {"sources": engine.source_list()}
    if url.path != "/search":
        return 404, {"error": "not found"}
    query, source = asked.get("q", ""), asked.get("source")
    count = asked.get("n", "5")
    if not query:
        return 400, {"error": "missing q param"}
    if not count.isdigit():
        return 400, {"error": "n must be a number"}
    if source is not None and source not in (known := [s["source"] for s in engine.source_list()]):
        return 400, {"error": f"unknown source: {source}", "available": known}
    return 200, {"results": engine.source_search(query, int(count), source), "query": query, "source": source}


def server(engine: Engine, port: int = DEFAULT_PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            engine.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "search")
            status, body = answer(engine, self.path)
            raw = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args: object) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)
