"""HTTP service: POST / runs the validation of a JSON body {"config": {...}}, POST /test returns its body."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from concord.plans.spec import ValidationSpec
from concord.runner import Runner
from concord.sources.reports import PRINTED_ROWS, with_status


def answer(runner: Runner, body: dict) -> list[dict]:
    """Report rows of a validation; a report of very many rows isn't sent."""
    spec = ValidationSpec.from_dict(body.get("config", body))
    rows = with_status(runner.report(spec), spec.filter_status).limit(PRINTED_ROWS + 1).collect()
    if len(rows) > PRINTED_ROWS:
        raise ValueError(f"the report has over {PRINTED_ROWS} rows: write it to a table instead")
    return [r.asDict(recursive=True) for r in rows]


def server(runner: Runner, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            text = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(text or b"{}")
                status, out = 200, body if self.path == "/test" else answer(runner, body)
            except Exception as e:
                status, out = 400 if isinstance(e, ValueError | KeyError) else 500, {"error": f"{type(e).__name__}: {e}"}
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(runner: Runner, port: int, host: str = "127.0.0.1") -> None:
    """Answer requests of this machine until stopped; give ``host`` only where others may run queries as this session's user."""
    with server(runner, port, host) as http:
        http.serve_forever()
