"""Serving the tools: JSON lines on standard input and output, and a small HTTP interface."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import TextIO

from quillon.models.offline import Models
from quillon.operators import answer
from quillon.operators.store import Store

PAGE = "<!doctype html><title>quillon</title><form onsubmit=\"fetch('/api/ask',{method:'POST',body:JSON.stringify({question:q.value})}).then(r=>r.json()).then(a=>o.textContent=a.answer);return false\"><input id=q size=60><button>Ask</button></form><pre id=o></pre>"


def tools(store: Store, models: Models) -> dict[str, Callable[..., object]]:
    """The six tools by name."""
    return {
        "search_memories": lambda **k: answer.search_memories(store, models, **k),
        "answer_question": lambda question: answer.answer_question(store, models, question),
        "get_profile": lambda section=None: answer.get_profile(store, section),
        "query_timeline": lambda **k: answer.query_timeline(store, **k),
        "get_person": lambda name: answer.get_person(store, models, name),
        "list_people": lambda: answer.list_people(store),
    }


def serve_tools(store: Store, models: Models, lines: TextIO, out: TextIO) -> None:
    """One JSON request a line, ``{"tool": …, "arguments": {…}}``; one JSON reply a line."""
    known = tools(store, models)
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            reply = {"result": known[request["tool"]](**request.get("arguments", {}))}
        except Exception as e:  # a bad request must not end the server
            reply = {"error": f"{type(e).__name__}: {e}"}
        out.write(json.dumps(reply, default=str, ensure_ascii=False) + "\n")
        out.flush()


def handler(store: Store, models: Models) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: object, kind: str = "application/json") -> None:
            data = body.encode() if isinstance(body, str) else json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/":
                self._send(200, PAGE, "text/html")
            elif self.path.startswith("/api/fact/"):
                row = answer.fact_by_prefix(store, self.path.removeprefix("/api/fact/"))
                self._send(200, row) if row else self._send(404, {"detail": "no such fact"})
            else:
                self._send(404, {"detail": "not found"})

        def do_POST(self) -> None:
            if self.path != "/api/ask":
                self._send(404, {"detail": "not found"})
                return
            try:
                question = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))["question"]
            except (ValueError, KeyError, TypeError):
                self._send(422, {"detail": "question is required"})
                return
            self._send(200, answer.answer_question(store, models, question))

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve_http(store: Store, models: Models, port: int) -> None:
    HTTPServer(("127.0.0.1", port), handler(store, models)).serve_forever()
