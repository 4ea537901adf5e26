"""A local service that answers as the remote ones do, and breaks where it is told to."""

from __future__ import annotations

import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse


@contextmanager
def service(answer):
    """``answer(path, query)`` gives what is sent as JSON, or a status to fail with. Yields the address and the queries asked."""
    asked: list[tuple[str, dict]] = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            query = {k: v[0] for k, v in parse_qs(at.query).items()}
            asked.append((at.path, query))
            told = answer(at.path, query)
            self.send_response(told if isinstance(told, int) else 200)
            self.end_headers()
            if not isinstance(told, int):
                self.wfile.write(json.dumps(told).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", asked
    finally:
        server.shutdown()
