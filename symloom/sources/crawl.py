"""Source files below a root, with the rules of ignore files applied.

Hidden files and folders are left out, and what ``.gitignore`` and ``.ignore``
files exclude, whether or not there is a repository. The driver lists the
folders, local ones directly and others by Hadoop's file systems, and never
enters ignored ones; the executors read the contents.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE_FILES = (".gitignore", ".ignore")
CONTENT = "path string, content binary"


def _class(glob: str, start: int) -> tuple[str, int] | None:
    """The regular expression of the bracket expression at ``start`` and where it ends; None if it has no end.

    A ``]`` in first place stands for itself, a range that runs backwards is
    empty, and no class matches a slash.
    """
    i = start + 1
    negated = glob.startswith(("!", "^"), i)
    i = first = i + negated
    points: list[tuple[str, bool]] = []  # characters, and whether each came by itself and is no escape
    while i < len(glob) and (glob[i] != "]" or i == first):
        if glob[i] == "\\" and i + 1 < len(glob):
            points.append((glob[i + 1], False))
            i += 2
        else:
            points.append((glob[i], True))
            i += 1
    if i >= len(glob):
        return None
    members, k = "", 0
    while k < len(points):
        if k + 2 < len(points) and points[k + 1] == ("-", True):
            low, high = points[k][0], points[k + 2][0]
            members += f"{re.escape(low)}-{re.escape(high)}" if low <= high else ""
            k += 3
        else:
            members += re.escape(points[k][0])
            k += 1
    if negated:
        return f"[^/{members}]", i + 1
    return (f"(?!/)[{members}]" if members else "(?!)"), i + 1


@lru_cache(maxsize=4096)
def _pattern(glob: str) -> re.Pattern:
    """The regular expression of one ignore pattern without its slashes at the ends."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (found := _class(glob, i)):
            out, i = out + found[0], found[1]
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out, re.S)


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file in ``folder`` (root-relative, '' for the root)."""

    folder: str
    glob: str
    keeps: bool
    folders_only: bool
    anchored: bool

    @classmethod
    def parse(cls, folder: str, line: str) -> Rule | None:
        line = line.rstrip("\n\r")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            return None
        keeps = line.startswith("!")
        line = line[1:] if keeps else line
        folders_only = line.endswith("/")
        line = line.rstrip("/") if folders_only else line
        anchored = "/" in line
        return cls(folder, line.lstrip("/"), keeps, folders_only, anchored) if line.strip("/") else None

    def matches(self, path: str, is_folder: bool) -> bool:
        if self.folders_only and not is_folder:
            return False
        if self.folder:
            if not path.startswith(self.folder + "/"):
                return False
            path = path[len(self.folder) + 1 :]
        return _pattern(self.glob).fullmatch(path if self.anchored else path.rpartition("/")[2]) is not None


def ignored(path: str, is_folder: bool, rules: list[Rule]) -> bool:
    """Whether the last rule that matches excludes the path; hidden names are excluded unless a rule keeps them."""
    for rule in reversed(rules):
        if rule.matches(path, is_folder):
            return not rule.keeps
    return path.rpartition("/")[2].startswith(".")


def parse_rules(folder: str, text: str) -> list[Rule]:
    return [r for line in text.splitlines() if (r := Rule.parse(folder, line))]


class _LocalTree:
    def __init__(self, root: str):
        self.root = root

    def entries(self, folder: str) -> list[tuple[str, bool, bool]]:
        """(name, is a folder, is a file), without following links."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as listed:
                return [(e.name, e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)) for e in listed]
        except OSError:
            return []

    def text(self, path: str) -> str:
        with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
            return f.read()


class _HadoopTree:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def entries(self, folder: str) -> list[tuple[str, bool, bool]]:
        return [(s.getPath().getName(), s.isDirectory(), s.isFile()) for s in self.fs.listStatus(self._path(folder))]

    def text(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def _walk(tree: _LocalTree | _HadoopTree, wanted: set[str], folder: str, rules: list[Rule]) -> Iterator[str]:
    entries = sorted(tree.entries(folder))
    inside = f"{folder}/" if folder else ""
    files = {name for name, _, is_file in entries if is_file}
    for name in IGNORE_FILES:
        if name in files:
            rules = rules + parse_rules(folder, tree.text(inside + name))
    for name, is_folder, is_file in entries:
        path = inside + name
        if is_folder and not ignored(path, True, rules):
            yield from _walk(tree, wanted, path, rules)
        elif is_file and "." in name.lstrip(".") and name.rpartition(".")[2] in wanted and not ignored(path, False, rules):
            yield path


def walk(root: str, extensions: list[str]) -> Iterator[str]:
    """Root-relative paths of a local tree's source files, folder by folder in the order of the names."""
    yield from _walk(_LocalTree(root), set(extensions), "", [])


def is_local(root: str) -> bool:
    return "://" not in root and not root.startswith("file:")


def scan(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, content) of every source file below ``root``; the paths are relative to it."""
    if is_local(root):
        base = os.path.realpath(root)
        found = [(p,) for p in walk(base, extensions)]
        if not found:
            return spark.createDataFrame([], CONTENT)
        files = spark.createDataFrame(found, "path string").repartition(min(len(found), max(spark.sparkContext.defaultParallelism, len(found) // 2000)))
        return files.mapInArrow(_reader(base), CONTENT)
    return _scan_remote(spark, root.rstrip("/"), extensions)


def _reader(base: str):
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            for k in range(0, len(paths), 64):
                part = paths[k : k + 64]
                content = []
                for p in part:
                    try:
                        with open(os.path.join(base, p), "rb") as f:
                            content.append(f.read())
                    except OSError:
                        content.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(content, pa.binary())], ["path", "content"])

    return read


def _scan_remote(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    found = list(_walk(_HadoopTree(spark, root), set(extensions), "", []))
    if not found:
        return spark.createDataFrame([], CONTENT)
    prefix = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() + "/"
    files = spark.read.format("binaryFile").load([f"{root}/{p}" for p in found])
    start = F.instr(F.col("path"), prefix)
    return files.select(F.substring(F.col("path"), start + F.lit(len(prefix)), F.length("path")).alias("path"), "content")
