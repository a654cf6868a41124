"""Modules named after files."""

from __future__ import annotations


def without_extension(path: str) -> str:
    """``path`` with ``/`` separators and without its last extension."""
    folder, slash, name = path.replace("\\", "/").rpartition("/")
    stem, dot, _ = name.rpartition(".")
    return folder + slash + (stem if dot and stem else name)


def resolve_relative(from_file: str, specifier: str) -> str:
    """A ``./`` or ``../`` specifier as the module of the file it names; all others as they are.

    What follows ``::`` is kept.
    """
    path, mark, rest = specifier.partition("::")
    if path.startswith(("./", "../")):
        parts = from_file.replace("\\", "/").split("/")[:-1]
        for part in path.split("/"):
            if part == "..":
                parts = parts[:-1]
            elif part not in ("", "."):
                parts.append(part)
        path = without_extension("/".join(parts))
    return path + mark + rest


def container(file_key: str, module: str, scope: list[str]) -> str:
    """The enclosing scope's qualified name, or the file where there is none."""
    return "::".join([module, *scope] if module else scope) if scope else file_key
