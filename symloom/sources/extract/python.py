"""Python, by the standard library's parser."""

from __future__ import annotations

import ast
import re

from symloom.errors import ParseError
from symloom.sources.extract.paths import container, without_extension
from symloom.sources.extract.registry import Facts, Language

_DEFINED = re.compile(rb"(?:async\s+)?(?:def|class)[\s\\]+")
_CONSTANT = re.compile(r"(?=.*[A-Z])[A-Z0-9_]+")


def module_of(path: str) -> str:
    return without_extension(path).replace("/", ".")


def _relative(from_file: str, level: int, module: str) -> str:
    """A ``from`` module with ``level`` dots, from the importing file's package."""
    if not level:
        return module
    parts = [p for p in module_of(from_file).split(".") if p]
    parts = parts[: max(0, len(parts) - level)]
    return ".".join([*parts, module] if module else parts)


class _Scanner(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.path, self.module, self.facts = path, module_of(path), Facts()
        self.lines = text.encode("utf-8", "surrogatepass").splitlines(keepends=True)
        self.scope: list[str] = []
        self.file_key = path.replace("\\", "/")

    def _refer(self, name: str, line: int, column: int, kind: str) -> None:
        self.facts.refs.append((name, line, column + 1, kind, container(self.file_key, self.module, self.scope)))

    def _define(self, node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, kind: str) -> None:
        for decorator in node.decorator_list:
            self.visit(decorator)
        line, column = node.lineno, node.col_offset
        if m := _DEFINED.match(self.lines[line - 1], column):
            column = m.end()
        self.facts.symbols.append((node.name, kind, line, column + 1, self.module))
        self.scope.append(node.name)
        for field, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if field != "decorator_list" and isinstance(child, ast.AST):
                    self.visit(child)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._define(node, "function")

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._define(node, "function")

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "struct")

    def _constants(self, targets: list[ast.expr]) -> None:
        for t in targets:
            if not self.scope and isinstance(t, ast.Name) and _CONSTANT.fullmatch(t.id):
                self.facts.symbols.append((t.id, "const", t.lineno, t.col_offset + 1, self.module))

    def visit_Assign(self, node: ast.Assign) -> None:
        self._constants(node.targets)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._constants([node.target])
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self._constants([node.target])
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self._refer(f.id, f.lineno, f.col_offset, "call")
        elif isinstance(f, ast.Attribute):
            self._refer(f.attr, f.end_lineno or f.lineno, (f.end_col_offset or 0) - len(f.attr.encode()), "method")
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.facts.imports += [(a.name, a.asname) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module == "__future__" and not node.level:
            return
        module = _relative(self.path, node.level, node.module or "")
        self.facts.imports += [(f"{module}::{a.name}", a.asname) for a in node.names]


def extract(path: str, text: str) -> Facts:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ParseError(f"failed to parse {path}: {e}") from e
    scanner = _Scanner(path, text)
    scanner.visit(tree)
    return scanner.facts


PYTHON = Language("python", ("py", "pyi"), extract)
