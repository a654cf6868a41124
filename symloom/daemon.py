"""A control server that keeps one streaming query for each registered project."""

from __future__ import annotations

import http.client
import json
import os
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from symloom.errors import WatchError
from symloom.http_api import percent_decode
from symloom.locate import home, project_index, registered_roots, registry_file
from symloom.streaming.watch import watch

PORT = 7646


class Projects:
    """The projects being watched; the registry file follows every change."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.queries: dict[str, StreamingQuery] = {}

    def restore(self) -> None:
        """Start what the registry lists, as far as it still exists."""
        for root in registered_roots():
            if root.is_dir():
                try:
                    self.start(root)
                except Exception as e:  # the others are still started
                    print(f"daemon: failed to restore {root}: {e}", file=sys.stderr)

    def start(self, root: Path) -> str:
        """The id of the project's query; one that runs is kept."""
        key = str(root.resolve(strict=True))
        query = self.queries.get(key)
        if query is None or not query.isActive:
            query = self.queries[key] = watch(self.spark, key, str(project_index(Path(key))))
        self.save()
        return str(query.id)

    def stop(self, path: str) -> str:
        key = str(Path(path).resolve())
        if query := self.queries.pop(key, None):
            query.stop()
        self.save()
        return key

    def active(self) -> list[dict[str, str]]:
        self.queries = {k: q for k, q in self.queries.items() if q.isActive}
        self.save()
        return [{"path": k, "query": str(q.id)} for k, q in sorted(self.queries.items())]

    def save(self) -> None:
        home().mkdir(parents=True, exist_ok=True)
        new = registry_file().with_suffix(".new")
        new.write_text(json.dumps({"projects": [{"path": k, "query": str(q.id)} for k, q in sorted(self.queries.items())]}))
        os.replace(new, registry_file())


def dispatch(projects: Projects, method: str, url: str, body: str) -> tuple[int, dict]:
    path, _, query = url.partition("?")
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok", "daemon": True}
    if (method, path) == ("GET", "/status"):
        return 200, {"daemon": True, "pid": os.getpid(), "projects": projects.active()}
    if (method, path) == ("POST", "/watch"):
        root = json.loads(body).get("path")
        if not isinstance(root, str):
            raise WatchError("missing path")
        number = projects.start(Path(root))
        return 200, {"ok": True, "path": str(Path(root).resolve()), "query": number}
    if (method, path) == ("DELETE", "/watch"):
        given = dict(p.split("=", 1) for p in query.split("&") if "=" in p).get("path")
        if given is None:
            raise WatchError("missing path query")
        return 200, {"ok": True, "path": projects.stop(percent_decode(given, plus_is_space=True))}
    return 404, {"error": "not found"}


def server(projects: Projects, port: int) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _handle(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            try:
                status, payload = dispatch(projects, self.command, self.path, body)
            except Exception as e:  # a request always gets an answer
                status, payload = 500, {"error": str(e)}
            data = json.dumps(payload).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = do_PUT = _handle

        def log_message(self, *args) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


def _pid_file() -> Path:
    return home() / "daemon.pid"


def _port_file() -> Path:
    return home() / "daemon.port"


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def run_daemon(spark: SparkSession, port: int = PORT) -> None:
    """Serve until interrupted; only one daemon runs for a home folder."""
    home().mkdir(parents=True, exist_ok=True)
    try:
        other = int(_pid_file().read_text())
    except (OSError, ValueError):
        other = 0
    if other and other != os.getpid() and _alive(other):
        raise WatchError(f"the daemon already runs (pid {other})")
    _pid_file().write_text(f"{os.getpid()}\n")
    projects = Projects(spark)
    projects.restore()
    with server(projects, port) as listening:
        _port_file().write_text(f"{listening.server_address[1]}\n")
        print(f"daemon listening on http://127.0.0.1:{listening.server_address[1]}", file=sys.stderr)
        try:
            listening.serve_forever()
        finally:
            _pid_file().unlink(missing_ok=True)


def request(method: str, path: str, body: str | None = None) -> tuple[int, dict]:
    """One request to the daemon."""
    try:
        port = int(_port_file().read_text())
    except (OSError, ValueError):
        port = PORT
    connection = http.client.HTTPConnection("127.0.0.1", port, timeout=120)
    try:
        connection.request(method, path, body, {"Content-Type": "application/json"})
        answer = connection.getresponse()
        return answer.status, json.loads(answer.read() or b"{}")
    except OSError as e:
        raise WatchError("the daemon is not running; start it with: python -m symloom.cli daemon") from e
    finally:
        connection.close()


def start_project(root: Path) -> dict:
    status, answer = request("POST", "/watch", json.dumps({"path": str(root.resolve())}))
    if status != 200:
        raise WatchError(f"the daemon rejected the project ({status}): {answer.get('error')}")
    return answer


def stop_project(root: Path) -> dict:
    status, answer = request("DELETE", f"/watch?path={quote(str(root.resolve()))}")
    if status != 200:
        raise WatchError(f"the daemon failed to stop the project ({status}): {answer.get('error')}")
    return answer


def daemon_status() -> dict:
    return request("GET", "/status")[1]
