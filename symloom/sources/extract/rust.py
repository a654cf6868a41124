"""Rust.

Types are found by place: after a colon, an arrow, ``as`` or ``impl``, in angle
brackets, in the fields of structs and variants, and before the braces of a
struct expression. Macro arguments are token trees, in which nothing is named.
"""

from __future__ import annotations

from symloom.sources.extract.registry import Facts, Language
from symloom.sources.extract.tokens import PUNCTUATION, WORD, Source, Token, closing

_KEYWORDS = {
    "as", "async", "await", "break", "const", "continue", "crate", "dyn", "else", "enum", "extern", "false", "fn", "for", "if", "impl", "in", "let", "loop",
    "match", "mod", "move", "mut", "pub", "ref", "return", "self", "static", "struct", "super", "trait", "true", "type", "unsafe", "use", "where", "while",
}
_PRIMITIVE = {"u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64", "u128", "i128", "isize", "usize", "f32", "f64", "bool", "str", "char"}
_ITEM_BEFORE = {"", "{", "}", ";", "]", "pub", "unsafe", "default", "async", "const", "extern", ")"}
_NO_STRUCT_BEFORE = {"struct", "enum", "trait", "union", "mod", "impl", "for", "if", "while", "match", "in", "fn", "->"}


def file_modules(path: str) -> list[str]:
    """Module segments of a file: from the first ``src`` folder on, without lib.rs, main.rs and mod.rs."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    if "src" in parts:
        parts = parts[parts.index("src") + 1 :]
    if not parts:
        return []
    *folders, name = parts
    if name in ("lib.rs", "main.rs", "mod.rs"):
        return folders
    stem, dot, _ = name.rpartition(".")
    return [*folders, stem if dot and stem else name]


class _Scanner:
    def __init__(self, path: str, text: str):
        self.source, self.facts = Source(text, "rust"), Facts()
        self.tokens: list[Token] = self.source.tokens
        self.path_modules, self.file_key = file_modules(path), path.replace("\\", "/")
        self.modules: list[tuple[str, int]] = []
        self.scopes: list[tuple[str, int]] = []
        self.patterns = self._patterns()
        self.seen_types: set[int] = set()

    def _text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def _word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == WORD

    def _name(self, i: int) -> str:
        return self.source.name(self.tokens[i].text)

    def _module(self) -> str:
        return "::".join(["crate", *self.path_modules, *(name for name, _ in self.modules)])

    def _container(self) -> str:
        parts = [*self.path_modules, *(name for name, _ in self.scopes)]
        return "::".join(["crate", *parts]) if parts else self.file_key

    def _symbol(self, i: int, kind: str) -> None:
        self.facts.symbols.append((self._name(i), kind, *self.source.place(self.tokens[i].start), self._module()))

    def _refer(self, i: int, kind: str) -> None:
        self.facts.refs.append((self._name(i), *self.source.place(self.tokens[i].start), kind, self._container()))

    def _patterns(self) -> set[int]:
        """Tokens of match-arm and let patterns, where a name before parentheses is no call."""
        t, marked, stack = self.tokens, set(), []
        start = 0
        for i, token in enumerate(t):
            text = token.text if token.kind == PUNCTUATION else ""
            if text in ("{", "(", "["):
                stack.append(start)
                start = i + 1
            elif text in ("}", ")", "]"):
                start = stack.pop() if stack else 0
                if text == "}":
                    start = i + 1
            elif text in (",", ";"):
                start = i + 1
            elif text == "=>":
                guard = next((k for k in range(start, i) if t[k].text == "if"), i)
                marked.update(range(start, guard))
                start = i + 1
            elif token.text == "let" and token.kind == WORD:
                k = i + 1
                while k < len(t) and self._text(k) not in ("=", ";", ":", "{"):
                    k = closing(t, k) if self._text(k) in ("(", "[") else k
                    k += 1
                marked.update(range(i + 1, k))
        return marked

    def run(self) -> Facts:
        i = 0
        while i < len(self.tokens):
            while self.modules and i > self.modules[-1][1]:
                self.modules.pop()
            while self.scopes and i > self.scopes[-1][1]:
                self.scopes.pop()
            i = self._token(i)
        return self.facts

    def _token(self, i: int) -> int:
        """Handle one token; the next one to look at."""
        t, text = self.tokens, self._text(i)
        if text == "#" and (self._text(i + 1) == "[" or self._text(i + 1) == "!" and self._text(i + 2) == "["):
            return closing(t, i + 1 + (self._text(i + 1) == "!")) + 1
        if t[i].kind == PUNCTUATION:
            return self._punctuation(i)
        if t[i].kind != WORD:
            return i + 1
        named = self._word(i + 1) and self._text(i + 1) not in _KEYWORDS
        if text == "use" and self._text(i - 1) in _ITEM_BEFORE:
            return self._use(i + 1)
        if text == "mod" and named:
            self._symbol(i + 1, "module")
            if self._text(i + 2) == "{":
                end = closing(t, i + 2)
                self.modules.append((self._name(i + 1), end))
                self.scopes.append((self._name(i + 1), end))
            else:
                self.scopes.append((self._name(i + 1), i + 1))
            return i + 2
        if text == "fn" and named:
            return self._function(i + 1)
        if text in ("struct", "enum", "trait", "union") and named and (text != "union" or self._text(i + 2) in ("{", "<")):
            if text != "union":
                self._symbol(i + 1, text)
            return self._definition(i + 1, text)
        if text == "type" and named:
            return self._generics(i + 2)
        if text == "const" and self._word(i + 1) and self._text(i + 2) == ":" and self._text(i - 1) not in ("<", ",", "*"):
            self._symbol(i + 1, "const")
            return i + 2
        if text == "impl" and self._text(i - 1) in _ITEM_BEFORE:
            return self._impl(i)
        if text in ("as", "dyn", "impl"):
            return self._bounds(i + 1)
        if text == "macro_rules" and self._text(i + 1) == "!":
            return closing(t, i + 3) + 1 if self._word(i + 2) else i + 2
        if text in _KEYWORDS - {"self", "crate", "super"}:
            return i + 1
        return self._use_of_name(i)

    def _use_of_name(self, i: int) -> int:
        t, before, after = self.tokens, self._text(i - 1), self._text(i + 1)
        if after == "!" and self._text(i + 2) in ("(", "[", "{") and before != ".":
            self._refer(i, "macro")
            return closing(t, i + 2) + 1
        if self._text(i) in ("self", "crate", "super"):
            return i + 1
        if after == "(" and i not in self.patterns:
            self._refer(i, "method" if before == "." else "path" if before == "::" else "call")
        elif after == "{" and self._struct_expression(i):
            self._refer(i, "type")
            self._fields(i + 1)
        return i + 1

    def _struct_expression(self, i: int) -> bool:
        if not self._text(i)[:1].isupper():
            return False
        k = i
        while self._text(k - 1) == "::" and self._word(k - 2):
            k -= 2
        if self._text(k - 1) in _NO_STRUCT_BEFORE:
            return False
        first = self._text(i + 2)
        return first in ("}", "..") or self._word(i + 2) and self._text(i + 3) in (":", ",", "}") or (first in ("ref", "mut"))

    def _fields(self, brace: int) -> None:
        """The colons of a struct expression or pattern introduce values, not types."""
        end, k = closing(self.tokens, brace), brace + 1
        while k < end:
            if self._text(k) == ":":
                self.seen_types.add(k)
            k = closing(self.tokens, k) + 1 if self._text(k) in ("(", "[", "{") else k + 1

    def _punctuation(self, i: int) -> int:
        text = self._text(i)
        if text == "->":
            return self._type(i + 1)
        if text == ":" and i not in self.seen_types and self.tokens[i - 1].kind != "lifetime":
            return self._bounds(i + 1)
        if text == "::" and self._text(i + 1) == "<":
            return self._arguments(i + 1)
        return i + 1

    def _function(self, name: int) -> int:
        """A definition if a body follows, else a signature."""
        t, k = self.tokens, name + 1
        while k < len(t) and self._text(k) not in ("{", ";"):
            k = closing(t, k) + 1 if self._text(k) in ("(", "[") else k + 1
        if self._text(k) == "{":
            self._symbol(name, "function")
            self.scopes.append((self._name(name), closing(t, k)))
        return self._generics(name + 1)

    def _generics(self, i: int) -> int:
        """Type parameters: their names define, their bounds and defaults use types."""
        if self._text(i) != "<":
            return i
        k, depth = i + 1, 1
        while k < len(self.tokens) and depth:
            text = self._text(k)
            if text == ">":
                depth -= 1
                k += 1
            elif text in (":", "=") and self.tokens[k - 1].kind != "lifetime":
                k = self._bounds(k + 1)
            else:
                k += 1
        return k

    def _definition(self, name: int, kind: str) -> int:
        """The head of a struct, enum, union or trait; tuple fields hold types."""
        k = self._generics(name + 1)
        if kind == "trait" and self._text(k) == ":":
            return self._bounds(k + 1)
        if kind == "struct" and self._text(k) == "(":
            self._tuple_types(k)
            return closing(self.tokens, k) + 1
        if kind == "enum":
            while k < len(self.tokens) and self._text(k) not in ("{", ";"):
                k += 1
            end = closing(self.tokens, k)
            j = k + 1
            while j < end:
                if self._text(j) == "#" and self._text(j + 1) == "[":
                    j = closing(self.tokens, j + 1)
                elif self._text(j) == "(":
                    self._tuple_types(j)
                    j = closing(self.tokens, j)
                elif self._text(j) == "{":
                    last = closing(self.tokens, j)
                    while j < last:
                        j = self._bounds(j + 1) if self._text(j) == ":" else j + 1
                j += 1
            return end + 1
        return k

    def _tuple_types(self, paren: int) -> None:
        k, end = paren + 1, closing(self.tokens, paren)
        while k < end:
            if self._text(k) == "#" and self._text(k + 1) == "[":
                k = closing(self.tokens, k + 1) + 1
            elif self._text(k) == "pub":
                k = closing(self.tokens, k + 1) + 1 if self._text(k + 1) == "(" else k + 1
            else:
                k = max(self._bounds(k), k + 1)

    def _impl(self, i: int) -> int:
        t, k = self.tokens, i + 1
        if self._text(k) == "<":
            k = self._generics(k)
        head, split, depth = k, -1, 0
        while k < len(t) and not (depth == 0 and self._text(k) in ("{", "where", ";")):
            text = self._text(k)
            depth += (text == "<") - (text == ">")
            if text in ("(", "["):
                k = closing(t, k)
            elif text == "for" and depth == 0 and self._text(k + 1) != "<":
                split = k
            k += 1
        first = split + 1 if split >= 0 else head
        trait = None
        if split >= 0:
            start = head + (self._text(head) == "!")
            trait = self.source.name(self.source.data[t[start].start : t[split - 1].start + len(t[split - 1].text)])
        if first == k - 1 and self._word(first) and self._text(first) not in _PRIMITIVE:
            self._symbol(first, "impl")
            self.facts.impls.append((self._name(first), trait, *self.source.place(t[i].start)))
        j = head
        while j < k:
            j = max(self._type(j), j + 1)
        return k

    def _bounds(self, i: int) -> int:
        """Types joined by ``+``."""
        k = self._type(i)
        while self._text(k) == "+" or self._text(k) == "?":
            k = self._type(k + 1)
        return k

    def _type(self, i: int) -> int:
        """Refer to the names of the type at ``i``; the token after it."""
        t = self.tokens
        while self._text(i) in ("&", "&&", "mut", "dyn", "impl", "*", "const", "?", "unsafe", "!") or i < len(t) and t[i].kind == "lifetime":
            i += 1
        text = self._text(i)
        if text == "for" and self._text(i + 1) == "<":
            return self._type(self._generics(i + 1))
        if text in ("(", "["):
            end, k = closing(t, i), i + 1
            while k < end:
                if self._text(k) == ";":
                    break
                k = max(self._bounds(k), k + 1)
            return end + 1
        if text in ("fn", "extern"):
            k = i + 1
            while k < len(t) and self._text(k) != "(":
                k += 1
            end, j = closing(t, k), k + 1
            while j < end:
                j = max(self._bounds(j), j + 1)
            return self._type(end + 2) if self._text(end + 1) == "->" else end + 1
        if text == "<":  # a qualified path
            k = self._arguments(i)
            return self._type(k + 1) if self._text(k) == "::" else k
        if not self._word(i) or text in _KEYWORDS - {"self", "crate", "super"}:
            return i
        while self._text(i + 1) == "::" and self._word(i + 2):
            i += 2
        name = self._text(i)
        if name not in _PRIMITIVE and name not in ("self", "crate", "super", "_"):
            self._refer(i, "type")
        k = i + 1
        if self._text(k) == "::" and self._text(k + 1) == "<":
            k += 1
        if self._text(k) == "<":
            k = self._arguments(k)
        elif self._text(k) == "(" and name in ("Fn", "FnMut", "FnOnce"):
            end, j = closing(t, k), k + 1
            while j < end:
                j = max(self._bounds(j), j + 1)
            k = self._type(end + 2) if self._text(end + 1) == "->" else end + 1
        if self._text(k) == "::" and self._word(k + 1):
            return self._type(k + 1)
        return k

    def _arguments(self, i: int) -> int:
        """Types in angle brackets."""
        k = i + 1
        while k < len(self.tokens) and self._text(k) not in (">", ";"):
            if self._text(k) == "{":
                k = closing(self.tokens, k) + 1
            elif self._word(k) and self._text(k + 1) == "=":
                k += 2
            elif self._text(k) == "as":
                k = self._type(k + 1)
            else:
                k = max(self._bounds(k), k + 1)
        return k + 1

    def _use(self, i: int) -> int:
        end = i
        while end < len(self.tokens) and self._text(end) != ";":
            end += 1
        self._expand(i, end, "")
        return end + 1

    def _expand(self, i: int, end: int, prefix: str) -> None:
        """One tree of a use declaration between ``i`` and ``end``."""
        join = lambda a, b: f"{a}::{b}" if a and b else a or b
        words = []
        if self._text(i) == "::":
            i += 1
        while i < end:
            text = self._text(i)
            if text == "{":
                own = join(prefix, "::".join(words))
                close, k, start = closing(self.tokens, i), i + 1, i + 1
                while k <= close:
                    if self._text(k) in (",",) or k == close:
                        if k > start:
                            self._expand(start, k, own)
                        start = k + 1
                    k = closing(self.tokens, k) + 1 if self._text(k) == "{" and k < close else k + 1
                return
            if text == "as":
                self.facts.imports.append((join(prefix, "::".join(words)), self._name(i + 1)))
                return
            if text != "::":
                words.append(self.source.name(text))
            i += 1
        if words == ["self"] and prefix:
            self.facts.imports.append((prefix, None))
        elif words and words != ["self"]:
            self.facts.imports.append((join(prefix, "::".join(words)), None))


def extract(path: str, text: str) -> Facts:
    return _Scanner(path, text).run()


RUST = Language("rust", ("rs",), extract)
