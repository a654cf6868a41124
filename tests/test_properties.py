"""Properties that hold for any input."""

import io
from urllib.parse import quote

from hypothesis import example, given, settings
from hypothesis import strategies as st

from symloom.functions.names import split_qualified, symbol_target
from symloom.http_api import percent_decode
from symloom.mcp import encode, read_message
from symloom.operators.envelope import HIGH, LOW, QueryResult, confidence, resolution_tier
from symloom.sources.crawl import Rule, ignored, parse_rules
from symloom.sources.extract import default_registry
from symloom.sources.extract.paths import resolve_relative, without_extension

PIECES = st.sampled_from(["fn ", "func ", "class ", "impl ", "for ", "import ", "use ", "const ", "type ", "function ", "x", "É", "(", ")", "{", "}", "[", "]", "<", ">", "::", ":", ";", ",", ".", "=", "=>", "->", "`", "${", "'", '"', "/*", "*/", "//", "\n", " ", "#", "r#\"", "\\", "/", "new ", "match ", "let ", "async ", "*", "|", "&", "0", "😀"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=60), st.sampled_from(["rs", "ts", "jsx", "go"]))
def test_scanners_read_anything_and_name_what_is_there(pieces, extension):
    text = "".join(pieces)
    facts = default_registry().for_extension(extension).extract(f"src/a.{extension}", text)
    lines = text.encode().split(b"\n")
    for name, _, line, column, _ in facts.symbols:
        assert lines[line - 1][column - 1 :].startswith(name.encode())
    for name, line, column, *_ in facts.refs:
        assert lines[line - 1][column - 1 :].startswith(name.encode())


@given(st.lists(st.sampled_from(["a", "b", "..", "."]), min_size=1, max_size=6))
def test_relative_modules_have_no_dots(parts):
    got = resolve_relative("x/y/z.ts", "./" + "/".join(parts))
    assert not {".", ".."} & set(got.split("/"))


@given(st.text(alphabet="ab/.:", max_size=12))
def test_names_split_at_the_last_separator(name):
    split = split_qualified(name)
    assert split is None or ("::".join(split) == name and all(split))
    assert symbol_target(name, "m")[0] == "m" and without_extension("q/" + name).startswith("q/")


@given(st.text(max_size=30))
def test_percent_decoding_undoes_quoting(text):
    text = text.encode("utf-8", "replace").decode()
    assert percent_decode(quote(text, safe="")) == text


@given(st.lists(st.dictionaries(st.text(max_size=5), st.integers(), max_size=3).map(lambda d: str(d).replace("\n", " ").encode()), max_size=5), st.sampled_from(["lines", "headers"]))
def test_messages_round_trip(bodies, form):
    source = io.BytesIO(b"".join(encode(form, b) for b in bodies))
    assert [read_message(source) for _ in bodies] == [(form, b) for b in bodies] and read_message(source) is None


@given(st.lists(st.integers(1, 3), max_size=6), st.booleans(), st.booleans())
def test_envelopes(tiers, several, empty):
    result = QueryResult.of([] if empty else [{}], tiers, several)
    assert result.resolution_tier == resolution_tier(tiers)
    assert result.confidence == (HIGH if empty else confidence(tiers, several))
    assert result.notes or (not empty and result.confidence != LOW)


@example("[!]", "a")
@example("[z-a]", "b")
@example("[[]", "[")
@example("[a-]", "-")
@example("[^", "a")
@example("[\\", "a")
@example("[&&a||~~--b]", "&")
@given(st.text(alphabet="ab*?/![]\\.-^&", max_size=8), st.text(alphabet="ab/.", min_size=1, max_size=8))
def test_ignore_patterns_read_anything(line, path):
    ignored(path, False, parse_rules("", line))


def test_last_rule_wins():
    rules = parse_rules("", "*.rs\n!keep.rs\n")
    assert ignored("x.rs", False, rules) and not ignored("d/keep.rs", False, rules)
    assert Rule.parse("", "# no") is None and Rule.parse("", "   ") is None


def test_bracket_expressions():
    """Which of some characters each expression matches; one without an end stands for itself."""
    every = "abc-[]&~"
    cases = {"[!a]": "bc-[]&~", "[^a]": "bc-[]&~", "[z-a]": "", "[a-]": "a-", "[]a]": "a]", "[!]a]": "bc-[&~", "[[]": "[", "[a-c]": "abc", "[\\]]": "]", "[a\\-c]": "ac-", "[&&~]": "&~", "[!]": "", "[!z-a]": every}
    for glob, matched in cases.items():
        assert "".join(c for c in every if ignored(c, False, parse_rules("", glob))) == matched, glob
    assert ignored("[!]", False, parse_rules("", "[!]")) and ignored("[ab", False, parse_rules("", "[ab"))
    assert not ignored("a/b", False, parse_rules("", "a[!x]b"))
