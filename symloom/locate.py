"""Which index a command means."""

from __future__ import annotations

import json
import os
from pathlib import Path

ENV_INDEX = "SYMLOOM_INDEX"
ENV_HOME = "SYMLOOM_HOME"
INDEX_DIR = ".symloom"
INDEX_NAME = "index"
POINTER = "_CURRENT"


def home() -> Path:
    """The folder of the daemon's files."""
    return Path(os.environ.get(ENV_HOME) or Path.home() / INDEX_DIR)


def registry_file() -> Path:
    return home() / "projects.json"


def registered_roots() -> list[Path]:
    try:
        found = json.loads(registry_file().read_text())
    except (OSError, ValueError):
        return []
    return [Path(p["path"]) for p in found.get("projects", []) if "path" in p]


def project_index(root: Path) -> Path:
    return root / INDEX_DIR / INDEX_NAME


def _is_index(folder: Path) -> bool:
    return (folder / POINTER).is_file()


def resolve_index(cwd: Path) -> Path:
    """The index named in the environment; else the nearest one at or above ``cwd``; else a registered project's.

    Of registered projects the innermost one around ``cwd`` counts, or the only
    one that has an index; several unrelated ones are never guessed among. The
    last resort is the index of ``cwd``, which may not exist yet.
    """
    if named := os.environ.get(ENV_INDEX):
        return Path(named)
    for folder in (cwd, *cwd.parents):
        if _is_index(project_index(folder)):
            return project_index(folder)
    here = cwd.resolve()
    roots = [r.resolve() for r in registered_roots()]
    indexed = [r for r in roots if _is_index(project_index(r))]
    around = [r for r in indexed if here.is_relative_to(r)]
    if around:
        return project_index(max(around, key=lambda r: len(str(r))))
    return project_index(indexed[0] if len(indexed) == 1 else cwd)


def index_root(folder: Path) -> Path:
    """The project that owns an index folder."""
    return folder.parent.parent
