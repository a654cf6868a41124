"""A lexer for languages with C-like comments, strings and braces.

Texts are lexed as bytes that stand for themselves (Latin-1), so that offsets
are byte offsets; names are decoded when facts are made.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

WORD, STRING, TEMPLATE, NUMBER, PUNCTUATION = "word", "string", "template", "number", "punctuation"


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    #: True if a line break stands before it.
    fresh: bool


_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|$)"
_NAME = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_NUMBER = r"[0-9][\w.]*?(?=[^\w.]|\.\.|\.[A-Za-z_]|$)|[0-9]\w*"
_QUOTED = r'"(?:[^"\\\n]|\\.)*"'

_GO = re.compile(rf"(?P<skip>{_COMMENT}|[ \t\r\f\v]+)|(?P<line>\n)|(?P<string>`[^`]*`|{_QUOTED}|'(?:[^'\\\n]|\\.)+')|(?P<word>{_NAME})|(?P<number>{_NUMBER})|(?P<punctuation>:=|<-|\.\.\.|.)", re.S)
_SCRIPT = re.compile(rf"(?P<skip>{_COMMENT}|[ \t\r\f\v]+)|(?P<line>\n)|(?P<string>{_QUOTED}|'(?:[^'\\\n]|\\.)*')|(?P<word>#?{_NAME})|(?P<number>{_NUMBER})|(?P<punctuation>=>|\?\.(?![0-9])|\.\.\.|\?\?|&&|\|\||[=!]==?|[-+*/%]=|\+\+|--|.)", re.S)
_RUST = re.compile(
    r"(?P<skip>//[^\n]*|[ \t\r\f\v]+)|(?P<line>\n)|(?P<block>/\*)|(?P<raw>(?:br|cr|r)(?P<hashes>#*)\")"
    r"|(?P<string>[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:[^ux]|x[0-9a-fA-F]{2}|u\{[^}]*\}))(?:[\x80-\xbf]*)')"
    rf"|(?P<lifetime>'{_NAME})|(?P<word>(?:r\#)?{_NAME})|(?P<number>{_NUMBER})|(?P<punctuation>::|->|=>|\.\.=?|&&|\|\||==|!=|<=|>=|.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "yield", "await"}


class Source:
    """The tokens of a text, and places and names in it."""

    def __init__(self, text: str, language: str):
        self.data = text.encode("utf-8", "surrogatepass").decode("latin-1")
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.data))]
        self.tokens = {"go": self._plain, "script": self._script, "rust": self._rust}[language]()

    def place(self, start: int) -> tuple[int, int]:
        line = bisect_right(self.lines, start)
        return line, start - self.lines[line - 1] + 1

    @staticmethod
    def name(text: str) -> str:
        return text.encode("latin-1").decode("utf-8", "replace")

    def _plain(self) -> list[Token]:
        out, fresh = [], True
        for m in _GO.finditer(self.data):
            if m.lastgroup == "line" or (m.lastgroup == "skip" and "\n" in m.group()):
                fresh = True
            elif m.lastgroup != "skip":
                out.append(Token(m.lastgroup, m.group(), m.start(), fresh))
                fresh = False
        return out

    def _script(self) -> list[Token]:
        out: list[Token] = []
        at, fresh, depths, depth = 0, True, [], 0
        data, size = self.data, len(self.data)
        while at < size:
            char = data[at]
            if char == "`" or (char == "}" and depths and depths[-1] == depth):
                if char == "}":
                    depths.pop()
                at = self._template(at + 1, out, at, char, fresh)
                if data[at - 2 : at] == "${":
                    depths.append(depth)
                fresh = False
                continue
            if char == "/" and (m := _REGEX.match(data, at)) and self._regex_fits(out):
                out.append(Token(STRING, m.group(), at, fresh))
                at, fresh = m.end(), False
                continue
            m = _SCRIPT.match(data, at)
            at = m.end()
            if m.lastgroup == "line" or (m.lastgroup == "skip" and "\n" in m.group()):
                fresh = True
            elif m.lastgroup != "skip":
                depth += {"{": 1, "}": -1}.get(m.group(), 0)
                out.append(Token(m.lastgroup, m.group(), m.start(), fresh))
                fresh = False
        return out

    @staticmethod
    def _regex_fits(out: list[Token]) -> bool:
        if not out:
            return True
        last = out[-1]
        if last.kind == WORD:
            return last.text in _BEFORE_REGEX
        return last.kind == PUNCTUATION and last.text not in (")", "]", "}", "<", "++", "--")

    def _template(self, at: int, out: list[Token], start: int, opener: str, fresh: bool) -> int:
        """Read template text up to its end or the next ``${``; parentheses stand for the substitution in the token list."""
        out.append(Token(TEMPLATE, "", start, fresh) if opener == "`" else Token(PUNCTUATION, ")", start, False))
        data = self.data
        while at < len(data):
            if data[at] == "\\":
                at += 2
            elif data[at] == "`":
                return at + 1
            elif data.startswith("${", at):
                out.append(Token(PUNCTUATION, "(", at, False))
                return at + 2
            else:
                at += 1
        return at

    def _rust(self) -> list[Token]:
        out, at, fresh, data = [], 0, True, self.data
        while at < len(data):
            m = _RUST.match(data, at)
            kind, end = m.lastgroup, m.end()
            if kind == "block":
                end = self._rust_comment(at)
                fresh = True
            elif kind == "line":
                fresh = True
            elif m.group("raw"):
                close = data.find('"' + m.group("hashes"), end)
                end = len(data) if close < 0 else close + 1 + len(m.group("hashes"))
                out.append(Token(STRING, "", at, fresh))
                fresh = False
            elif kind != "skip":
                out.append(Token(kind, m.group(), at, fresh))
                fresh = False
            at = end
        return out

    def _rust_comment(self, at: int) -> int:
        depth, end = 0, at
        for m in re.compile(r"/\*|\*/").finditer(self.data, at):
            depth += 1 if m.group() == "/*" else -1
            end = m.end()
            if not depth:
                return end
        return len(self.data)


_CLOSERS = {"(": ")", "[": "]", "{": "}"}


def closing(tokens: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at ``at`` (the number of tokens if there is none)."""
    stack = []
    for i in range(at, len(tokens)):
        text = tokens[i].text if tokens[i].kind == PUNCTUATION else ""
        if text in _CLOSERS:
            stack.append(_CLOSERS[text])
        elif stack and text == stack[-1]:
            stack.pop()
            if not stack:
                return i
    return len(tokens)
