"""A tool server: JSON-RPC 2.0 over standard input and output.

Messages come one per line or with Content-Length headers; answers go in the
form of the message. The handshake is answered before the index is opened.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any, BinaryIO

from symloom import __version__
from symloom.errors import ProtocolError, SymloomError
from symloom.index import SymbolIndex, dependency_dto, impl_dto, reference_dto, symbol_dto

SERVER_NAME = "symloom"
# Fixed values of the protocol.
DEFAULT_VERSION = "2024-11-05"
VERSIONS = ["2025-11-25", "2025-06-18", "2025-03-26", "2024-11-05"]
PARSE_ERROR, METHOD_NOT_FOUND, SERVER_ERROR, INTERNAL_ERROR = -32700, -32601, -32000, -32603
LINES, HEADERS = "lines", "headers"

_TRUST = (
    " The answer is JSON with results, confidence (high, medium or low), resolution_tier (0 for an empty miss) and notes."
    " With low confidence, or notes about ambiguity, give a module or a qualified name such as crate::mcp::serve, or search the text."
    " No results with 'No matching symbols found.' is a confident miss."
)
_NAME = {"type": "string", "description": "Symbol name, or a qualified name such as crate::mcp::serve; case matters"}
_MODULE = {"type": "string", "description": "Module that defines the symbol, where several share the name"}


def _schema(required: str, **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": [required]}


_QUERY, _BY_NAME = _schema("name", name=_NAME, module=_MODULE), _schema("name", name=_NAME)
_QUERIES: dict[str, tuple[str, dict, Callable[[dict], dict]]] = {
    "definition": ("Where a symbol is defined.", _QUERY, symbol_dto),
    "references": ("Where a symbol is referred to.", _QUERY, reference_dto),
    "callers": ("Where a function or symbol is called or used, by the imports of each file.", _QUERY, reference_dto),
    "implementations": ("Types that implement a trait.", _BY_NAME, impl_dto),
    "dependencies": ("Modules and files that a module, file or symbol depends on.", _BY_NAME, dependency_dto),
    "impact": ("Symbols that a change may reach, through others too: candidates to verify.", _QUERY, symbol_dto),
}


def tools() -> list[dict]:
    hints = {"readOnlyHint": True, "destructiveHint": False, "idempotentHint": True}
    out = [{"name": n, "description": text + _TRUST, "inputSchema": schema, "annotations": hints} for n, (text, schema, _) in _QUERIES.items()]
    path = {"type": "string", "description": "Folder of the source tree"}
    return [*out, {"name": "index", "description": "Index a source tree (writes the index).", "inputSchema": _schema("path", path=path)}]


def encode(form: str, body: bytes) -> bytes:
    if form == LINES:
        return body + b"\n"
    return f"Content-Length: {len(body)}\r\nContent-Type: application/json\r\n\r\n".encode() + body


def read_message(stream: BinaryIO) -> tuple[str, bytes] | None:
    """(form, body) of the next message; None at the end of the stream."""
    line = stream.readline()
    if not line:
        return None
    text = line.rstrip(b"\r\n")
    if text.startswith(b"{"):
        return LINES, text
    length = None
    while text:
        if text.startswith(b"Content-Length:"):
            try:
                length = int(text.removeprefix(b"Content-Length:"))
            except ValueError as e:
                raise ProtocolError(f"invalid Content-Length: {text.decode(errors='replace')}") from e
        line = stream.readline()
        if not line:
            return None
        text = line.rstrip(b"\r\n")
    if length is None:
        # A blank line before the headers.
        while (line := stream.readline()).rstrip(b"\r\n"):
            if line.startswith(b"Content-Length:"):
                length = int(line.removeprefix(b"Content-Length:"))
        if length is None:
            if not line:
                return None
            raise ProtocolError("missing Content-Length header")
    body = stream.read(length)
    return (HEADERS, body) if len(body) == length else None


def failure(number: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


class ToolServer:
    def __init__(self, open_index: Callable[[], SymbolIndex], auto_index: bool = False):
        self._open, self._index, self.auto_index = open_index, None, auto_index

    @property
    def index(self) -> SymbolIndex:
        if self._index is None:
            self._index = self._open()
        return self._index

    def handle(self, message: Any) -> dict | None:
        """The answer to one message; None for notifications, which get none."""
        method = message.get("method") if isinstance(message, dict) else None
        if not isinstance(method, str):
            raise ProtocolError("missing method")
        if "id" not in message:
            return None
        number, params = message["id"], message.get("params") or {}
        fixed = {"ping": {}, "tools/list": {"tools": tools()}, "resources/list": {"resources": []}, "resources/templates/list": {"resourceTemplates": []}, "prompts/list": {"prompts": []}}
        if method == "initialize":
            result = self._handshake(params)
        elif method in fixed:
            result = fixed[method]
        elif method == "tools/call":
            try:
                result = self._call(params)
            except Exception as e:  # an error of a tool is an answer too
                return failure(number, SERVER_ERROR, str(e))
        else:
            return failure(number, METHOD_NOT_FOUND, f"Method not found: {method}")
        return {"jsonrpc": "2.0", "id": number, "result": result}

    @staticmethod
    def _handshake(params: dict) -> dict:
        asked = params.get("protocolVersion")
        asked = asked if isinstance(asked, str) else DEFAULT_VERSION
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": SERVER_NAME, "version": __version__}}

    def _call(self, params: dict) -> dict:
        name, arguments = params.get("name"), params.get("arguments") or {}
        if not isinstance(name, str):
            raise ProtocolError("tools/call missing name")

        def required(key: str) -> str:
            if not isinstance(value := arguments.get(key), str):
                raise ProtocolError(f"missing required argument: {key}")
            return value

        if name == "index":
            payload = self.index.index_path(required("path")).as_dict()
        elif name in _QUERIES:
            if self.auto_index:
                stats = self.index.auto_index()
                if stats.changed():
                    print(f"{SERVER_NAME}: auto-indexed {stats.indexed} file(s) (skipped {stats.skipped}, removed {stats.removed}, errors {stats.errors}).", file=sys.stderr)
            self.index.refresh()
            query = getattr(self.index, f"{name}_with_meta")
            module = arguments.get("module")
            more = (module,) if isinstance(module, str) and module and "module" in _QUERIES[name][1]["properties"] else ()
            payload = query(required("name"), *more).map_results(_QUERIES[name][2]).as_dict()
        else:
            raise ProtocolError(f"unknown tool: {name}")
        return {"content": [{"type": "text", "text": json.dumps(payload, ensure_ascii=False, separators=(",", ":"))}]}

    def serve(self, source: BinaryIO, sink: BinaryIO) -> None:
        """Answer messages until the input ends."""
        while True:
            try:
                got = read_message(source)
            except SymloomError as e:
                print(f"mcp: read error: {e}", file=sys.stderr)
                return
            if got is None:
                return
            form, body = got
            try:
                message = json.loads(body)
            except ValueError as e:
                answer = failure(None, PARSE_ERROR, f"Parse error: {e}")
            else:
                try:
                    answer = self.handle(message)
                except ProtocolError as e:
                    answer = failure(message.get("id") if isinstance(message, dict) else None, INTERNAL_ERROR, str(e))
            if answer is not None:
                sink.write(encode(form, json.dumps(answer, ensure_ascii=False, separators=(",", ":")).encode()))
                sink.flush()
