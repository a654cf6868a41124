"""Command line, HTTP, tool server, daemon, index discovery and the watch."""

import io
import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from symloom import cli, daemon, http_api, locate
from symloom.errors import ProtocolError
from symloom.index import SymbolIndex
from symloom.mcp import ToolServer, encode, read_message, tools
from symloom.streaming.watch import TreeReader, difference, reindex_on_change, watch

FILES = {"a.py": "from b import helper\n\ndef caller():\n    helper()\n", "b.py": "def helper():\n    pass\n"}


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    for name, text in FILES.items():
        (root / name).write_text(text)
    return root


def opened(spark, root):
    return SymbolIndex.open(spark, str(locate.project_index(root)), root=str(root))


def test_cli(spark, project, capsys):
    run = lambda *a: cli.run(list(a), spark, project)
    run("index", ".")
    assert capsys.readouterr().out == "Indexed 2 file(s) (skipped 0, removed 0, errors 0).\n"
    run("--no-auto-index", "definition", "helper")
    assert capsys.readouterr().out == "b.py:1:5\tfunction\thelper\n"
    run("--no-auto-index", "references", "b::helper")
    assert capsys.readouterr().out == "a.py:4:5\thelper\n"
    run("--no-auto-index", "dependencies", "a")
    assert capsys.readouterr().out == "b\tb.py\n"
    run("--no-auto-index", "impact", "nothing")
    got = capsys.readouterr()
    assert (got.out, got.err.strip().splitlines()[-1]) == ("", "No impact found for nothing")
    (project / "c.py").write_text("def late():\n    pass\n")
    run("--json", "definition", "late")
    got = capsys.readouterr()
    assert json.loads(got.out) == {"results": [{"name": "late", "kind": "function", "file": "c.py", "start_line": 1, "start_col": 5, "module_path": "c"}], "confidence": "high", "resolution_tier": 2, "notes": []}
    assert "auto-indexed 1 file(s) (skipped 2, removed 0, errors 0)." in got.err


def test_cli_commands_are_complete():
    names = cli.parser()._subparsers._group_actions[0].choices
    assert set(names) == {"index", "definition", "references", "callers", "watch", "daemon", "start", "stop", "status", "implementations", "dependencies", "impact", "serve", "mcp"}


def fetch(port, path, method="GET", body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", body, method=method)) as answer:
            return answer.status, json.loads(answer.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(spark, project):
    index = opened(spark, project)
    index.auto_index()
    listening = http_api.server(index, ("127.0.0.1", 0), auto_index=False)
    threading.Thread(target=listening.serve_forever, daemon=True).start()
    try:
        port = listening.server_address[1]
        assert fetch(port, "/health?x=1#y") == (200, {"status": "ok"})
        status, found = fetch(port, "/symbol/hel%70er?q")
        assert status == 200 and [d["file"] for d in found["definition"]] == ["b.py"] and [c["container"] for c in found["callers"]] == ["a::caller"]
        assert fetch(port, "/symbol/unknown") == (200, {"definition": [], "references": [], "implementations": [], "dependencies": [], "callers": []})
        assert fetch(port, "/symbol/") == (400, {"error": "missing symbol name"})
        assert fetch(port, "/else") == (404, {"error": "not found"})
        assert fetch(port, "/health", "POST", b"{}") == (405, {"error": "method not allowed"})
    finally:
        listening.shutdown()


def test_percent_decoding():
    assert http_api.percent_decode("a%20b+%zz%4") == "a b+%zz%4"
    assert http_api.percent_decode("a+b%2B%C3%A9", plus_is_space=True) == "a b+é"


def asked(server, *messages, form="lines"):
    sink = io.BytesIO()
    server.serve(io.BytesIO(b"".join(encode(form, m if isinstance(m, bytes) else json.dumps(m).encode()) for m in messages)), sink)
    source, out = io.BytesIO(sink.getvalue()), []
    while got := read_message(source):
        assert got[0] == form
        out.append(json.loads(got[1]))
    return out


@pytest.mark.parametrize("form", ["lines", "headers"])
def test_handshake_needs_no_index(form):
    def never():
        raise AssertionError("the index was opened")

    got = asked(
        ToolServer(never),
        {"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-06-18"}}, {"id": 2, "method": "initialize", "params": {"protocolVersion": "1999"}}, {"method": "notifications/initialized"},
        {"id": 3, "method": "ping"}, {"id": 4, "method": "tools/list"}, {"id": 5, "method": "resources/list"}, {"id": 6, "method": "nope"}, {"id": 7}, b"{broken", form=form,
    )
    assert [g.get("id") for g in got] == [1, 2, 3, 4, 5, 6, 7, None]
    assert got[0]["result"]["protocolVersion"] == "2025-06-18" and got[1]["result"]["protocolVersion"] == "2025-11-25"
    assert got[2]["result"] == {} and len(got[3]["result"]["tools"]) == 7 == len(tools()) and got[4]["result"] == {"resources": []}
    assert [g["error"]["code"] for g in got[5:]] == [-32601, -32603, -32700]


def test_tools(spark, project):
    server = ToolServer(lambda: opened(spark, project), auto_index=True)

    def call(tool, /, **arguments):
        answer = server.handle({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})
        return answer["error"] if "error" in answer else json.loads(answer["result"]["content"][0]["text"])

    assert [r["file"] for r in call("definition", name="helper")["results"]] == ["b.py"]
    assert call("callers", name="helper", module="b")["confidence"] == "high"
    assert call("implementations", name="T")["notes"][0].startswith("No implementations found")
    assert call("index", path=str(project)) == {"indexed": 0, "skipped": 2, "removed": 0, "errors": 0}
    assert call("definition") == {"code": -32000, "message": "missing required argument: name"}
    assert call("zzz")["message"] == "unknown tool: zzz"


def test_bad_headers():
    with pytest.raises(ProtocolError):
        read_message(io.BytesIO(b"Content-Length: x\r\n\r\n"))
    assert read_message(io.BytesIO(b"\r\nContent-Length: 2\r\n\r\n{}")) == ("headers", b"{}")
    assert read_message(io.BytesIO(b"")) is None


def test_index_discovery(tmp_path, monkeypatch):
    monkeypatch.setenv("SYMLOOM_HOME", str(tmp_path / "home"))
    monkeypatch.delenv("SYMLOOM_INDEX", raising=False)

    def made(root):
        folder = locate.project_index(root)
        folder.mkdir(parents=True)
        (folder / "_CURRENT").write_text("{}")
        return folder

    def register(*roots):
        (tmp_path / "home").mkdir(exist_ok=True)
        (tmp_path / "home/projects.json").write_text(json.dumps({"projects": [{"path": str(r)} for r in roots]}))

    deep = tmp_path / "one/sub/deep"
    deep.mkdir(parents=True)
    assert locate.resolve_index(deep) == locate.project_index(deep)
    two = made(tmp_path / "two")
    register(tmp_path / "two")
    assert locate.resolve_index(deep) == two, "the only registered project"
    three = made(tmp_path / "three")
    register(tmp_path / "two", tmp_path / "three")
    assert locate.resolve_index(deep) == locate.project_index(deep), "never guess among several"
    one = made(tmp_path / "one")
    assert locate.resolve_index(deep) == one, "the nearest above"
    assert locate.index_root(three) == tmp_path / "three"
    monkeypatch.setenv("SYMLOOM_INDEX", "/named")
    assert str(locate.resolve_index(deep)) == "/named"


def test_reader_reports_changes(project):
    reader = TreeReader(str(project), ["py"], 0.01)
    rows, first = reader.read(reader.initialOffset())
    assert list(rows) == [("a.py", "create"), ("b.py", "create")] and first == {"batch": 1}
    rows, same = reader.read(first)
    assert list(rows) == [] and same == first
    (project / "a.py").unlink()
    (project / "b.py").write_text("x = 1\n")
    (project / "n.txt").write_text("not a source file")
    rows, second = reader.read(first)
    assert list(rows) == [("a.py", "remove"), ("b.py", "modify")]
    assert list(reader.readBetweenOffsets(first, second)) == [("a.py", "remove"), ("b.py", "modify")]
    reader.commit(second)
    assert list(reader.readBetweenOffsets(first, second)) == [("b.py", "create")]
    assert difference({"a": 1}, {"a": 1}) == []


def wait_for(condition, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(0.3)
    return False


def test_watch_follows_changes(spark, project):
    folder = str(locate.project_index(project))
    assert reindex_on_change(spark, str(project), folder).indexed == 2
    passes = []
    query = watch(spark, str(project), folder, on_pass=passes.append)
    try:
        assert wait_for(lambda: len(passes) >= 1)
        (project / "c.py").write_text("def fresh():\n    pass\n")
        (project / "a.py").unlink()
        assert wait_for(lambda: any(s.indexed for s in passes)), query.exception()
        assert wait_for(lambda: len(opened(spark, project).definition("fresh")) == 1)
        assert wait_for(lambda: opened(spark, project).definition("caller") == [])
    finally:
        query.stop()


def test_daemon(spark, project, tmp_path, monkeypatch):
    monkeypatch.setenv("SYMLOOM_HOME", str(tmp_path / "home"))
    projects = daemon.Projects(spark)
    listening = daemon.server(projects, 0)
    (tmp_path / "home").mkdir()
    (tmp_path / "home/daemon.port").write_text(str(listening.server_address[1]))
    threading.Thread(target=listening.serve_forever, daemon=True).start()
    try:
        assert daemon.request("GET", "/health") == (200, {"status": "ok", "daemon": True})
        number = daemon.start_project(project)["query"]
        assert daemon.start_project(project)["query"] == number, "a query that runs is kept"
        assert [p["path"] for p in daemon.daemon_status()["projects"]] == [str(project)] and locate.registered_roots() == [project]
        assert len(opened(spark, project).definition("helper")) == 1
        assert daemon.stop_project(project) == {"ok": True, "path": str(project)}
        assert daemon.daemon_status()["projects"] == [] == locate.registered_roots()
        assert daemon.request("POST", "/watch", "{}")[0] == 500 and daemon.request("GET", "/x")[0] == 404
    finally:
        listening.shutdown()
        for q in projects.queries.values():
            q.stop()
