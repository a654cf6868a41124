"""JSON over HTTP: GET /health and GET /symbol/{name}."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer

from symloom.index import SymbolIndex, dependency_dto, impl_dto, reference_dto, symbol_dto
from symloom.operators import lookups, resolve


def strip_query_and_fragment(url: str) -> str:
    return url.partition("#")[0].partition("?")[0]


def percent_decode(text: str, plus_is_space: bool = False) -> str:
    """Decode %XX; escapes that are not valid stay as they are."""
    data, out, i = text.encode("utf-8", "surrogateescape"), bytearray(), 0
    while i < len(data):
        pair = data[i + 1 : i + 3]
        if data[i] == 0x25 and len(pair) == 2 and all(chr(b) in "0123456789abcdefABCDEF" for b in pair):
            out.append(int(pair, 16))
            i += 3
        else:
            out.append(0x20 if plus_is_space and data[i] == 0x2B else data[i])
            i += 1
    return out.decode("utf-8", "replace")


def symbol_payload(index: SymbolIndex, name: str) -> dict:
    """Five arrays without an envelope: references by name, callers by the definition where that is unique. Unknown names give empty arrays."""
    definition = index.definition_rows(name)
    modules = {d["module_path"] for d in definition}
    meant = next(iter(modules)) if len(modules) == 1 else None
    rows = lambda df: [r.asDict() for r in df.collect()]
    g = index.graph
    return {
        "definition": [symbol_dto(r) for r in definition],
        "references": [reference_dto(r) for r in rows(lookups.references(g, name))],
        "implementations": [impl_dto(r) for r in rows(lookups.implementations(g, name))],
        "dependencies": [dependency_dto(r) for r in index.dependencies(name)],
        "callers": [reference_dto(r) for r in rows(resolve.callers_of(g, name, meant))],
    }


def respond(index: SymbolIndex, method: str, url: str, auto_index: bool) -> tuple[int, dict]:
    if method != "GET":
        return 405, {"error": "method not allowed"}
    path = strip_query_and_fragment(url)
    if path == "/health":
        return 200, {"status": "ok"}
    if path.startswith("/symbol/"):
        name = percent_decode(path.removeprefix("/symbol/"))
        if not name:
            return 400, {"error": "missing symbol name"}
        if auto_index:
            index.auto_index()
        index.refresh()
        return 200, symbol_payload(index, name)
    return 404, {"error": "not found"}


def server(index: SymbolIndex, address: tuple[str, int], auto_index: bool) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _handle(self) -> None:
            try:
                status, payload = respond(index, self.command, self.path, auto_index)
            except Exception as e:  # a request always gets an answer
                print(f"api request error: {e}", file=sys.stderr)
                status, payload = 500, {"error": str(e)}
            body = json.dumps(payload, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = _handle

        def log_message(self, *args) -> None:
            pass

    return HTTPServer(address, Handler)
