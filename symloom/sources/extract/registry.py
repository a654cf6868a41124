"""Languages and which of them claims a file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Facts:
    """What one file says. Lines and columns count from 1, columns in bytes."""

    #: (name, kind, line, column, module)
    symbols: list[tuple[str, str, int, int, str]] = field(default_factory=list)
    #: (name, line, column, kind, container)
    refs: list[tuple[str, int, int, str, str]] = field(default_factory=list)
    #: (module path, alias or None)
    imports: list[tuple[str, str | None]] = field(default_factory=list)
    #: (type, trait or None, line, column)
    impls: list[tuple[str, str | None, int, int]] = field(default_factory=list)


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    #: Takes the root-relative path and the text; raises ParseError if the text cannot be read.
    extract: Callable[[str, str], Facts]


class Registry:
    """Languages in the order of registration; the first that claims an extension gets its files."""

    def __init__(self, languages: tuple[Language, ...] = ()):
        self.languages = list(languages)

    def register(self, language: Language) -> Registry:
        self.languages.append(language)
        return self

    def extensions(self) -> list[str]:
        return list(dict.fromkeys(e for language in self.languages for e in language.extensions))

    def for_extension(self, extension: str) -> Language | None:
        return next((x for x in self.languages if extension in x.extensions), None)


def default_registry() -> Registry:
    from symloom.sources.extract import go, python, rust, script

    return Registry((rust.RUST, script.TYPESCRIPT, script.TSX, script.JAVASCRIPT, script.JSX, python.PYTHON, go.GO))
