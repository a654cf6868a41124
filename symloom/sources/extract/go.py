"""Go."""

from __future__ import annotations

from symloom.sources.extract.paths import container, without_extension
from symloom.sources.extract.registry import Facts, Language
from symloom.sources.extract.tokens import PUNCTUATION, STRING, WORD, Source, closing

_NO_CALL = {"func", "if", "for", "switch", "select", "return", "go", "defer", "range", "case", "map", "chan", "interface", "struct", "type", "var", "const", "import", "package", "else"}


class _Scanner:
    def __init__(self, path: str, text: str):
        self.source, self.facts = Source(text, "go"), Facts()
        self.tokens, self.file_key = self.source.tokens, path.replace("\\", "/")
        t = self.tokens
        package = next((t[i + 1].text for i in range(len(t) - 1) if t[i].text == "package" and t[i].fresh and t[i + 1].kind == WORD), "")
        self.module = without_extension(path) if package in ("", "main") else self.source.name(package)
        #: Token ranges inside interface bodies, and each function's (name, first, last).
        self.silent: list[tuple[int, int]] = []
        self.named: set[int] = set()

    def _symbol(self, i: int, kind: str) -> None:
        self.named.add(i)
        self.facts.symbols.append((self.source.name(self.tokens[i].text), kind, *self.source.place(self.tokens[i].start), self.module))

    def _text(self, i: int) -> str:
        return self.tokens[i].text if i < len(self.tokens) else ""

    def _line_end(self, i: int) -> int:
        """The last token of a declaration without a body: brackets are skipped, a fresh line ends it."""
        j = i
        while j + 1 < len(self.tokens) and not (self.tokens[j + 1].fresh and j >= i):
            j = closing(self.tokens, j + 1) if self._text(j + 1) in ("(", "[", "{") else j + 1
        return min(j, len(self.tokens) - 1)

    def run(self) -> Facts:
        scopes = self._declarations()
        self._references(scopes)
        return self.facts

    def _declarations(self) -> dict[int, tuple[str, int]]:
        t, scopes, i = self.tokens, {}, 0
        while i < len(t):
            word = t[i].text if t[i].kind == WORD else ""
            if word == "func" and t[i].fresh:
                at = closing(t, i + 1) + 1 if self._text(i + 1) == "(" else i + 1
                if at < len(t) and t[at].kind == WORD:
                    self._symbol(at, "function")
                    scopes[i] = (self.source.name(t[at].text), self._line_end(at))
            elif word in ("type", "const", "import") and (t[i].fresh or self._text(i - 1) in (";", "{")):
                i = self._specs(word, i + 1)
                continue
            elif word == "interface" and self._text(i + 1) == "{":
                self.silent.append((i, closing(t, i + 1)))
            i += 1
        return scopes

    def _specs(self, word: str, i: int) -> int:
        t = self.tokens
        spec = {"type": self._type, "const": self._const, "import": self._import}[word]
        if self._text(i) != "(":
            spec(i)
            return i
        end, first = closing(t, i), i + 1
        starts = [k for k in range(first, min(end, len(t))) if (t[k].fresh or k == first or self._text(k - 1) == ";") and self._depth_is_flat(first, k)]
        for k in starts:
            spec(k)
        return i + 1

    def _depth_is_flat(self, first: int, k: int) -> bool:
        depth = 0
        for j in range(first, k):
            if self.tokens[j].kind == PUNCTUATION:
                depth += (self.tokens[j].text in "([{") - (self.tokens[j].text in ")]}")
        return depth == 0

    def _type(self, i: int) -> None:
        t = self.tokens
        if i >= len(t) or t[i].kind != WORD:
            return
        at = i + 1
        if self._text(at) == "[" and self._text(at + 1) not in ("]",) and t[at + 1].kind == WORD and self._text(closing(t, at) + 1) not in ("", "\n"):
            after = closing(t, at) + 1
            if not (after < len(t) and t[after].fresh):
                at = after if self._text(at + 2) != "]" else at
        kind = {"struct": "struct", "interface": "trait"}.get(self._text(at), "type")
        self._symbol(i, kind)

    def _const(self, i: int) -> None:
        t, at = self.tokens, i
        while at < len(t) and t[at].kind == WORD:
            self._symbol(at, "const")
            if self._text(at + 1) != ",":
                return
            at += 2

    def _import(self, i: int) -> None:
        t = self.tokens
        if i >= len(t):
            return
        if t[i].kind == STRING:
            self.facts.imports.append((self.source.name(t[i].text.strip('"`')), None))
        elif i + 1 < len(t) and t[i + 1].kind == STRING:
            self.facts.imports.append((self.source.name(t[i + 1].text.strip('"`')), self.source.name(t[i].text)))

    def _references(self, scopes: dict[int, tuple[str, int]]) -> None:
        t, scope = self.tokens, []
        silent = {k for a, b in self.silent for k in range(a, b + 1)}
        for i, token in enumerate(t):
            while scope and i > scope[-1][1]:
                scope.pop()
            if i in scopes:
                scope.append(scopes[i])
            if token.kind != WORD or self._text(i + 1) != "(" or token.text in _NO_CALL or i in self.named or i in silent:
                continue
            kind = "method" if self._text(i - 1) == "." and i else "call"
            names = [name for name, _ in scope]
            self.facts.refs.append((self.source.name(token.text), *self.source.place(token.start), kind, container(self.file_key, self.module, names)))


def extract(path: str, text: str) -> Facts:
    return _Scanner(path, text).run()


GO = Language("go", ("go",), extract)
