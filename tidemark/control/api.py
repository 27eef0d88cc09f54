"""The configuration over HTTP: GET and POST /config, for holders of an account's key in X-API-Key."""

from __future__ import annotations

import json
import threading
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidemark.control import accounts
from tidemark.control.config import Config, merged, problems

MOST_BYTES = 1 << 20


class ConfigServer:
    """Holds a configuration; changed is called with the new one after each accepted POST of overrides."""

    def __init__(self, config: Config, known: dict[str, str], address: str = "localhost", port: int = 0, changed=lambda config: None):
        self.config, self.known, self.changed = config, known, changed
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self, code: int, body: dict) -> None:
                data = json.dumps(body).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def _refused(self) -> bool:
                if accounts.owner(outer.known, self.headers.get("X-API-Key", "")) is None:
                    self._answer(401, {"error": "a valid X-API-Key is needed"})
                    return True
                if self.path != "/config":
                    self._answer(404, {"error": "no such path"})
                    return True
                return False

            def do_GET(self) -> None:
                if not self._refused():
                    self._answer(200, asdict(outer.config))

            def do_POST(self) -> None:
                if self._refused():
                    return
                n = int(self.headers.get("Content-Length") or 0)
                if n > MOST_BYTES:
                    self._answer(413, {"error": "too long"})
                    return
                try:
                    new = merged(outer.config, json.loads(self.rfile.read(n) or b"{}"))
                    wrong = [p for p in problems(new) if "must be" in p]
                    if wrong:
                        raise ValueError("; ".join(wrong))
                except (ValueError, TypeError, AttributeError) as e:
                    self._answer(400, {"error": str(e)})
                    return
                outer.config = new
                outer.changed(new)
                self._answer(200, asdict(new))

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((address, port), Handler)

    @property
    def port(self) -> int:
        return self.server.server_address[1]

    def start(self) -> None:
        threading.Thread(target=self.server.serve_forever, name="config", daemon=True).start()

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()
