"""Commands: python -m symloom.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from symloom import daemon, http_api
from symloom.errors import SymloomError
from symloom.index import SymbolIndex, dependency_dto, impl_dto, reference_dto, symbol_dto
from symloom.locate import index_root, project_index, resolve_index
from symloom.mcp import ToolServer
from symloom.sources.ingest import IndexStats
from symloom.streaming.watch import watch

API_PORT = 7645


def _place(r: dict[str, Any]) -> str:
    return f"{r['path']}:{r['start_line']}:{r['start_col']}"


def _dependency(r: dict[str, Any]) -> str:
    return r["module_path"] if r["file"] is None else f"{r['module_path']}\t{r['file']}"


#: Of each query: the JSON form of a row, its line of text, and how a miss is put.
_FORMS: dict[str, tuple[Callable, Callable, str]] = {
    "definition": (symbol_dto, lambda r: f"{_place(r)}\t{r['kind']}\t{r['name']}", "No definition found for"),
    "references": (reference_dto, lambda r: f"{_place(r)}\t{r['name']}", "No references found for"),
    "callers": (reference_dto, lambda r: f"{_place(r)}\t{r['name']}", "No callers found for"),
    "implementations": (impl_dto, lambda r: f"{_place(r)}\t{r['type_name']}", "No implementations found for"),
    "dependencies": (dependency_dto, _dependency, "No dependencies found for"),
    "impact": (symbol_dto, lambda r: f"{_place(r)}\t{r['kind']}\t{r['name']}", "No impact found for"),
}


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="symloom")
    main.add_argument("--no-auto-index", action="store_true", help="query the index as it is")
    main.add_argument("--json", action="store_true", help="print results with confidence, tier and notes")
    commands = main.add_subparsers(dest="command", required=True)
    for name in ("index", "watch", "start"):
        commands.add_parser(name).add_argument("path", nargs="?", default=".")
    for name in _FORMS:
        commands.add_parser(name).add_argument("name")
    commands.add_parser("serve").add_argument("--port", type=int, default=API_PORT)
    commands.add_parser("daemon").add_argument("--port", type=int, default=daemon.PORT)
    for name in ("stop", "status", "mcp"):
        commands.add_parser(name)
    return main


def session() -> SparkSession:
    builder = SparkSession.builder.appName("symloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if not os.environ.get("MASTER") and not os.environ.get("SPARK_REMOTE"):
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _report(stats: IndexStats, prefix: str = "Indexed") -> str:
    return f"{prefix} {stats.indexed} file(s) (skipped {stats.skipped}, removed {stats.removed}, errors {stats.errors})."


def run_query(index: SymbolIndex, query: str, name: str, as_json: bool, auto_index: bool) -> None:
    if auto_index and (stats := index.auto_index()).changed():
        print(_report(stats, "symloom: auto-indexed"), file=sys.stderr)
    dto, line, miss = _FORMS[query]
    result = getattr(index, f"{query}_with_meta")(name)
    if as_json:
        print(json.dumps(result.map_results(dto).as_dict(), indent=2, ensure_ascii=False))
        return
    if not result.results:
        print(f"{miss} {name}", file=sys.stderr)
    for r in result.results:
        print(line(r))


def run(arguments: list[str], spark: SparkSession | None = None, cwd: Path | None = None) -> int:
    given, cwd = parser().parse_args(arguments), cwd or Path.cwd()
    make = lambda: spark or session()
    own, auto = project_index(cwd), not given.no_auto_index
    command = given.command
    if command in ("start", "stop", "status"):
        answer = daemon.start_project(cwd / given.path) if command == "start" else daemon.stop_project(cwd) if command == "stop" else daemon.daemon_status()
        print(json.dumps(answer))
    elif command == "index":
        print(_report(SymbolIndex.open(make(), str(own)).index_path(str(cwd / given.path))))
    elif command == "watch":
        watch(make(), str(cwd / given.path), str(own), on_pass=lambda s: print(_report(s), file=sys.stderr)).awaitTermination()
    elif command == "daemon":
        daemon.run_daemon(make(), given.port)
    elif command == "mcp":
        folder = resolve_index(cwd)
        ToolServer(lambda: SymbolIndex.open(make(), str(folder), root=str(index_root(folder))), auto).serve(sys.stdin.buffer, sys.stdout.buffer)
    else:
        index = SymbolIndex.open(make(), str(own), root=str(cwd))
        if command == "serve":
            if auto:
                index.auto_index()
            with http_api.server(index, ("127.0.0.1", given.port), auto) as listening:
                print(f"Serving JSON on http://127.0.0.1:{listening.server_address[1]}", file=sys.stderr)
                listening.serve_forever()
        else:
            run_query(index, command, given.name, given.json, auto)
    return 0


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except SymloomError as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(1)
    except KeyboardInterrupt:
        sys.exit(130)


if __name__ == "__main__":
    main()
