"""TypeScript and JavaScript, with or without JSX."""

from __future__ import annotations

from functools import partial

from symloom.sources.extract.paths import container, resolve_relative, without_extension
from symloom.sources.extract.registry import Facts, Language
from symloom.sources.extract.tokens import PUNCTUATION, STRING, TEMPLATE, WORD, Source, Token, closing

_NO_CALL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "super", "import", "this", "typeof", "await", "yield", "void", "delete", "in", "of", "instanceof", "new", "case", "throw", "do", "else", "async", "keyof", "extends"}
_BEFORE_VALUE = {"=", "(", ",", "[", "?", "&&", "||", "??", "return", "=>", "...", "!", "==", "===", "!=", "!==", "+", "default", "yield", "await", "in", "of", "typeof", "case"}
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "*"}
_STATEMENT = {"export", "default", "async", "declare", "abstract", ";", "{", "}", "else"}


class _Scanner:
    def __init__(self, path: str, text: str, typed: bool):
        self.source, self.facts, self.typed, self.path = Source(text, "script"), Facts(), typed, path
        self.tokens: list[Token] = self.source.tokens
        self.module, self.file_key = without_extension(path), path.replace("\\", "/")
        #: First token of a scope -> (name, last token); tokens that name something; class and object bodies.
        self.scopes: dict[int, tuple[str, int]] = {}
        self.named: set[int] = set()
        self.bodies: dict[int, str] = {}

    def _text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def _is_word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == WORD and not self.tokens[i].text.startswith("#")

    def _symbol(self, i: int, kind: str) -> str:
        self.named.add(i)
        name = self.source.name(self.tokens[i].text)
        self.facts.symbols.append((name, kind, *self.source.place(self.tokens[i].start), self.module))
        return name

    def _statement(self, i: int) -> bool:
        """Whether a declaration can start at ``i``."""
        return i == 0 or self.tokens[i].fresh and self._text(i - 1) not in _BEFORE_VALUE or self._text(i - 1) in _STATEMENT or self._text(i - 1) == ")" and self.tokens[i].fresh

    def _angles(self, i: int) -> int:
        """After the type parameters or arguments at ``i``; ``i`` itself if they are none."""
        depth, j = 0, i
        while j < len(self.tokens):
            text = self.tokens[j].text
            if text == "<":
                depth += 1
            elif text == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif text in ("(", "[", "{"):
                j = closing(self.tokens, j)
            elif text in (";", ")", "]", "}", "&&", "||") or self.tokens[j].kind == "number":
                return i
            j += 1
        return i

    def _body(self, i: int) -> int:
        """The opening brace of the body that follows the parameters from ``i`` on; -1 if there is none."""
        i = self._angles(i) if self._text(i) == "<" else i
        if self._text(i) != "(":
            return -1
        j = closing(self.tokens, i) + 1
        if self._text(j) == ":":
            j = self._skip_type(j + 1)
        return j if self._text(j) == "{" else -1

    def _skip_type(self, j: int) -> int:
        """After a type annotation that a body, or nothing, follows."""
        value = True
        while j < len(self.tokens):
            text = self.tokens[j].text
            if text == "{":
                if not value:
                    return j
                j, value = closing(self.tokens, j) + 1, False
            elif text in ("(", "["):
                j, value = closing(self.tokens, j) + 1, False
            elif text == "<":
                k = self._angles(j)
                j, value = (k, False) if k > j else (j + 1, True)
            elif text in (";", "}", ")", ",") or (text == "=" and not value):
                return j
            elif text in ("|", "&", "=>", "is", "extends", "keyof", "typeof", "infer", "readonly", "?", ":", "."):
                j, value = j + 1, True
            elif self.tokens[j].kind in (WORD, STRING, "number", TEMPLATE):
                if not value:
                    return j
                j, value = j + 1, False
            else:
                return j
        return j

    def run(self) -> Facts:
        self._declarations()
        self._references()
        return self.facts

    def _declarations(self) -> None:
        t, i = self.tokens, 0
        while i < len(t):
            text, word = t[i].text, t[i].kind == WORD
            dotted = self._text(i - 1) in (".", "?.")
            if word and not dotted:
                if text == "function" and self._statement(i):
                    self._function(i)
                elif text == "class":
                    self._class(i)
                elif text in ("interface", "enum", "type") and self.typed and self._is_word(i + 1) and not t[i + 1].fresh and (self._statement(i) or self._text(i - 1) == "const"):
                    self._typed_declaration(i, text)
                elif text == "import" and self._text(i + 1) not in ("(", "."):
                    self._import(i)
                elif self._is_word(i) and self._text(i + 1) == "=" and not self.typed:
                    self._bound(i)
            if text == "=" and self._text(i - 1) in ("}", "]") and not self.typed:
                self._require(i + 1, None)
            if text == "{" and t[i].kind == PUNCTUATION and i not in self.bodies and self._is_object(i):
                self.bodies[i] = "object"
            if text == "{" and i in self.bodies:
                self._methods(i)
            i += 1

    def _is_object(self, i: int) -> bool:
        before = self._text(i - 1)
        if before == ":":
            return self._text(i - 2) not in ("default",) and self._text(i - 3) != "case"
        return before in _BEFORE_VALUE and before not in ("=>", "in", "of", "case") and i > 0

    def _function(self, i: int) -> None:
        at = i + 2 if self._text(i + 1) == "*" else i + 1
        if self._is_word(at) and (body := self._body(at + 1)) >= 0:
            self.scopes[at] = (self._symbol(at, "function"), closing(self.tokens, body))
        elif self._is_word(at):
            self.named.add(at)  # a signature

    def _class(self, i: int) -> None:
        j = i + 1
        if self._is_word(j) and self._text(j) not in ("extends", "implements") and self._statement(i):
            name = j
        else:
            name = -1
            j = i
        while j + 1 < len(self.tokens) and self._text(j + 1) != "{":
            j = closing(self.tokens, j + 1) if self._text(j + 1) == "(" else j + 1
        if j + 1 < len(self.tokens):
            self.bodies[j + 1] = "class"
            if name >= 0:
                self.scopes[name] = (self._symbol(name, "struct"), closing(self.tokens, j + 1))

    def _typed_declaration(self, i: int, text: str) -> None:
        after = self._text(i + 2)
        if text == "type" and after not in ("=", "<") or text != "type" and after not in ("{", "<", "extends"):
            return
        self._symbol(i + 1, {"interface": "trait", "enum": "enum", "type": "type"}[text])
        if text == "interface":
            j = i + 2
            while j < len(self.tokens) and self._text(j) != "{":
                j += 1
            self.bodies[j] = "interface"

    def _methods(self, i: int) -> None:
        """Methods directly in a class or object body."""
        end, j = closing(self.tokens, i), i + 1
        while j < end:
            if self._text(j) == "@":  # a decorator
                j += 2
                while self._text(j) == ".":
                    j += 2
                j = closing(self.tokens, j) + 1 if self._text(j) == "(" else j
                continue
            while self._text(j) in _MODIFIERS and self._text(j + 1) not in ("(", "=", ";", ":", ",", "<", "?"):
                j += 1
            if self._is_word(j) and self._text(j + 1) in ("(", "<"):
                body = self._body(j + 1)
                if body >= 0 and self.bodies[i] != "interface":
                    self.scopes[j] = (self._symbol(j, "function"), closing(self.tokens, body))
                    j = closing(self.tokens, body) + 1
                    continue
                if body < 0:
                    self.named.add(j)
            separators = (";", ",") if self.bodies[i] != "object" else (",",)
            while j < end and self._text(j) not in separators:
                if self._text(j) in ("(", "[", "{"):
                    j = closing(self.tokens, j)
                j += 1
                if j < end and self.bodies[i] != "object" and self.tokens[j].fresh and self._text(j) not in (".", "?.", "?", "=", ":", "|", "&", ")", "]") and self._text(j - 1) not in _BEFORE_VALUE:
                    break
            else:
                j += 1
            if j < end and self._text(j) in separators:
                j += 1

    def _bound(self, i: int) -> None:
        """``x = () => ...`` and ``x = function ...`` in a declaration, and ``x = require(...)``."""
        if not self._declared(i):
            return
        j = i + 2
        self._require(j, self.source.name(self.tokens[i].text))
        j += self._text(j) == "async" and self._text(j + 1) != "=>"
        if self._text(j) == "function":
            k = j + 1 + (self._text(j + 1) == "*")
            k += self._is_word(k)
            body = self._body(k)
            end = closing(self.tokens, body) if body >= 0 else k
        else:
            if self._text(j) == "(":
                k = closing(self.tokens, j) + 1
            elif self._is_word(j):
                k = j + 1
            else:
                return
            if self._text(k) != "=>":
                return
            end = closing(self.tokens, k + 1) if self._text(k + 1) == "{" else self._expression_end(k + 1)
        self.scopes[i] = (self._symbol(i, "function"), end)

    def _declared(self, i: int) -> bool:
        """Whether ``i`` is a name that const, let or var declares."""
        j = i - 1
        while j >= 0:
            text = self._text(j)
            if text in ("const", "let", "var"):
                return True
            if text != ",":
                return False
            j -= 1
            depth = 0
            while j >= 0:
                text = self._text(j)
                depth += (text in (")", "]", "}")) - (text in ("(", "[", "{"))
                if depth < 0 or depth == 0 and text in (";", "const", "let", "var", ","):
                    break
                j -= 1
            if depth < 0:
                return False
        return False

    def _require(self, j: int, alias: str | None) -> None:
        if self._text(j) == "require" and self._text(j + 1) == "(":
            inside = range(j + 2, closing(self.tokens, j + 1))
            if path := next((self.tokens[k].text for k in inside if self.tokens[k].kind == STRING), None):
                self._imported(path.strip("'\"`"), alias)

    def _expression_end(self, j: int) -> int:
        """The last token of an arrow's expression."""
        start = j
        while j < len(self.tokens):
            text = self.tokens[j].text
            if text in ("(", "[", "{"):
                j = closing(self.tokens, j)
            elif text in (";", ",", ")", "]", "}"):
                return j - 1
            j += 1
            if j < len(self.tokens) and j > start and self.tokens[j].fresh and self.tokens[j].kind == WORD and self._text(j - 1) not in _BEFORE_VALUE:
                return j - 1
        return len(self.tokens) - 1

    def _imported(self, path: str, alias: str | None) -> None:
        self.facts.imports.append((resolve_relative(self.path, self.source.name(path)), alias))

    def _import(self, i: int) -> None:
        t, j = self.tokens, i + 1
        while j < len(t) and t[j].kind != STRING and self._text(j) not in (";", "=", "("):
            j += 1
        if j >= len(t) or t[j].kind != STRING:
            return
        source = t[j].text.strip("'\"`")
        if j == i + 1:
            self._imported(source, None)
            return
        k = i + 1
        if self._text(k) == "type" and self._text(k + 1) not in ("from", ","):
            k += 1
        while k < j:
            if self._text(k) == "*" and self._text(k + 1) == "as":
                self._imported(source, self.source.name(self._text(k + 2)))
                k += 3
            elif self._text(k) == "{":
                end = closing(t, k)
                self._specifiers(source, k + 1, end)
                k = end + 1
            else:
                if self._is_word(k) and self._text(k) != "from":
                    self._imported(source, self.source.name(self._text(k)))
                k += 1
        self.named.update(range(i, j + 1))

    def _specifiers(self, source: str, k: int, end: int) -> None:
        while k < end:
            words = []
            while k < end and self._text(k) != ",":
                words.append(self.source.name(self._text(k)).strip("'\""))
                k += 1
            if len(words) > 1 and words[0] == "type" and words[1] != "as":
                words = words[1:]
            if words:
                self._imported(f"{source}::{words[0]}", words[2] if len(words) == 3 and words[1] == "as" else None)
            k += 1

    def _references(self) -> None:
        t, scope = self.tokens, []
        for i, token in enumerate(t):
            while scope and i > scope[-1][1]:
                scope.pop()
            if i in self.scopes:
                scope.append(self.scopes[i])
            if token.kind != WORD or i in self.named or token.text in _NO_CALL or token.text.startswith("#"):
                continue
            if self._text(i - 1) == "function" or self._text(i - 1) == "*" and self._text(i - 2) == "function":
                continue  # the name of a function expression
            made = self._constructed(i)
            if not self._called(i, made) or (made and self.typed):
                continue
            kind = "method" if self._text(i - 1) in (".", "?.") else "call"
            names = [name for name, _ in scope]
            self.facts.refs.append((self.source.name(token.text), *self.source.place(token.start), kind, container(self.file_key, self.module, names)))

    def _called(self, i: int, made: bool) -> bool:
        after = self._text(i + 1)
        if after == "(" or (after == "?." and self._text(i + 2) == "("):
            return True
        if after == "<" and self.typed and (end := self._angles(i + 1)) > i + 1:
            return self._text(end) == "("
        if i + 1 < len(self.tokens) and self.tokens[i + 1].kind == TEMPLATE and not self.tokens[i + 1].fresh:
            return True
        return made and after not in (".", "?.")

    def _constructed(self, i: int) -> bool:
        """Whether ``i`` ends the constructor of a new-expression."""
        while self._text(i - 1) in (".", "?.") and self._is_word(i - 2):
            i -= 2
        return self._text(i - 1) == "new"


def extract(path: str, text: str, typed: bool) -> Facts:
    scanner = _Scanner(path, text, typed)
    return scanner.run()


TYPESCRIPT = Language("typescript", ("ts", "mts", "cts"), partial(extract, typed=True))
TSX = Language("tsx", ("tsx",), partial(extract, typed=True))
JAVASCRIPT = Language("javascript", ("js", "mjs", "cjs"), partial(extract, typed=False))
JSX = Language("jsx", ("jsx",), partial(extract, typed=False))
