"""Facts of small sources in each language."""

import pytest

from symloom.errors import ParseError
from symloom.sources.extract import Facts, Language, Registry, default_registry
from symloom.sources.extract.paths import resolve_relative, without_extension
from symloom.sources.extract.rust import file_modules


def facts(path, text):
    return default_registry().for_extension(path.rpartition(".")[2]).extract(path, text)


def kinds(f):
    return {s[0]: s[1] for s in f.symbols}


def uses(f):
    return {(r[0], r[3]) for r in f.refs}


RUST = """use std::fmt;
use shop::{stock, price as cost, tax::{self, rules::*}};

pub struct Ledger;
pub trait Audit {}
impl Audit for Ledger {}
impl Ledger {
    fn total(&self) {}
}
impl<T> fmt::Display for Page<T> where T: Clone {}
mod books {
    pub fn close(book: Ledger) {
        let sums: Totals = unimplemented!();
        book.total();
        settle();
        shop::stock::count();
        turbo::<u8>();
        assert!(unseen());
        match x { Some(y) if valid(y) => post(y), _ => Entry { a: 1 }.save() };
    }
}
fn settle() -> Vec<Line> { r#"fn decoy() {}"#; 'a'; /* fn no() { /* nested */ } */ b'x' }
const LIMIT: usize = 3;
trait Sig { fn only(&self); fn body(&self) {} }
enum Kind { A(Payload), B { c: Field } }
static NOT: u8 = 0;
macro_rules! m { () => { fn inside() {} } }
"""


def test_rust():
    f = facts("src/lib.rs", RUST)
    found = {(s[0], s[1]): s for s in f.symbols}
    assert found[("Ledger", "struct")][2:] == (4, 12, "crate")
    assert found[("Ledger", "impl")][2] in (6, 7)
    assert found[("close", "function")][2:] == (12, 12, "crate::books")
    assert set(kinds(f)) == {"Ledger", "Audit", "total", "books", "close", "settle", "LIMIT", "Sig", "body", "Kind"}
    assert f.imports == [("std::fmt", None), ("shop::stock", None), ("shop::price", "cost"), ("shop::tax", None), ("shop::tax::rules::*", None)]
    assert f.impls == [("Ledger", "Audit", 6, 1), ("Ledger", None, 7, 1)]
    used = {("unimplemented", "macro"), ("total", "method"), ("settle", "call"), ("count", "path"), ("assert", "macro"), ("valid", "call"), ("post", "call"), ("save", "method")}
    types = {"Totals", "Line", "Vec", "Payload", "Field", "Entry", "Clone", "Display", "Ledger", "Audit", "Page", "T"}
    assert used | {(t, "type") for t in types} == uses(f)
    assert next(r for r in f.refs if r[0] == "settle")[4] == "crate::books::close"
    assert not any(r[0] == "Ledger" and r[1] == 4 for r in f.refs), "a definition's name is no use of it"


@pytest.mark.parametrize(("path", "module"), [("src/mcp/mod.rs", ["mcp"]), ("src/mcp/wire.rs", ["mcp", "wire"]), ("src/lib.rs", []), ("x/src/mcp/mod.rs", ["mcp"]), ("main.rs", []), ("a/b.rs", ["a", "b"])])
def test_rust_modules(path, module):
    assert file_modules(path) == module


def test_rust_container_of_a_file_module():
    f = facts("src/mcp/mod.rs", "fn serve() { read_message(); }\n")
    assert f.refs == [("read_message", 1, 14, "call", "crate::mcp::serve")]


TYPESCRIPT = """import { slug as s, type Tag } from './text';
import Shelf, * as all from './shelf';
import '../setup';

export interface Store {
  find(id: string): Item;
}
export type ItemId = string;
export enum Size { Small }
export abstract class Catalog<T> extends Base {
  private cache = new Map();
  list(): void {
    s();
    this.reload();
  }
  abstract sig(): void;
  async reload<T>(a: { b: string }): Promise<void> { await pull<T>(1); }
  #secret() { this.#secret(); }
}
export function open(): { a: string } { return maybe?.run(); }
function over(a: string): void;
const arrow = () => { inner(`x ${tagged(1)} y`); };
// function comment() {}
const note = "export function decoy(): void {}", re = /call(it)/g;
"""


def test_typescript():
    f = facts("src/app/catalog.ts", TYPESCRIPT)
    assert kinds(f) == {"Store": "trait", "ItemId": "type", "Size": "enum", "Catalog": "struct", "list": "function", "reload": "function", "open": "function"}
    assert {x[4] for x in f.symbols} == {"src/app/catalog"}
    assert f.imports == [("src/app/text::slug", "s"), ("src/app/text::Tag", None), ("src/app/shelf", "Shelf"), ("src/app/shelf", "all"), ("src/setup", None)]
    assert uses(f) == {("s", "call"), ("reload", "method"), ("pull", "call"), ("run", "method"), ("inner", "call"), ("tagged", "call")}
    assert next(r for r in f.refs if r[0] == "s")[4] == "src/app/catalog::Catalog::list"


JAVASCRIPT = """import { slug as s } from './text';
import './setup';
const os = require('os'), { a } = require("../q");

export class Catalog {
  list() { s(); new Shelf(); new all.Thing; }
  static async *pages() {}
}
export default function open() {}
const boot = async (x) => {
  open();
};
let short = x => go(x), n = 3;
var named = function other() { deep(); };
const o = { meth() { z(); }, key: 1 };
const el = <div onClick={() => click()}>it's text</div>;
after();
"""


def test_javascript():
    f = facts("src/app/catalog.js", JAVASCRIPT)
    assert kinds(f) == {"Catalog": "struct", "list": "function", "pages": "function", "open": "function", "boot": "function", "short": "function", "named": "function", "meth": "function"}
    assert f.imports == [("src/app/text::slug", "s"), ("src/app/setup", None), ("os", "os"), ("src/q", None)]
    assert {("Shelf", "call"), ("Thing", "method"), ("s", "call"), ("open", "call"), ("go", "call"), ("deep", "call"), ("z", "call"), ("click", "call"), ("after", "call"), ("require", "call")} == uses(f)
    where = {r[0]: r[4] for r in f.refs}
    assert where["go"].endswith("::short") and where["deep"].endswith("::named") and where["after"] == "src/app/catalog.js"


PYTHON = '''import json, re as regex
from __future__ import annotations
from .text import slug as s
from ..core import base
from . import sibling
from math import *

PAGE_SIZE = 3
Mixed = 1
TYPED: int = 2
if True:
    NESTED = 1

class Catalog(Base()):
    CLASS_LEVEL = 1
    @decorate(1)
    async def list(self, x=default()):
        s(); self.reload()
        return f"{shown(1)}"

def boot():
    \"\"\"def decoy(): pass\"\"\"
    é = créer()
'''


def test_python():
    f = facts("pkg/app/catalog.py", PYTHON)
    assert {x[:2] for x in f.symbols} == {("PAGE_SIZE", "const"), ("TYPED", "const"), ("NESTED", "const"), ("Catalog", "struct"), ("list", "function"), ("boot", "function")}
    assert next(x for x in f.symbols if x[0] == "list")[2:] == (17, 15, "pkg.app.catalog")
    assert f.imports == [("json", None), ("re", "regex"), ("pkg.app.text::slug", "s"), ("pkg.core::base", None), ("pkg.app::sibling", None), ("math::*", None)]
    where = {r[0]: r[1:] for r in f.refs}
    assert where["decorate"][3] == "pkg.app.catalog::Catalog" and where["default"][3] == "pkg.app.catalog::Catalog::list" == where["shown"][3]
    assert where["reload"][2] == "method" and where["créer"][:2] == (23, 10)
    with pytest.raises(ParseError):
        facts("x.py", "def (")


GO = """package stock

import (
\t"os"
\tt "text"
\t_ "side/effect"
)
import . "dots"

type Store interface {
\tFind(id string) Item
}
type Item struct{ Label string }
type (
\tAlias = Other
\tBox[T any] struct{}
\tID int
)
const Limit, Two = 3, 4
const (
\tA = iota
\tB
)

func Open() {}
func (i *Item) Sell() error {
\tOpen()
\tt.Print("func decoy() {}")
\tgo func() { inner() }()
\treturn `raw
func no() {}`
}
"""


def test_go():
    f = facts("stock/item.go", GO)
    assert kinds(f) == {"Store": "trait", "Item": "struct", "Alias": "type", "Box": "struct", "ID": "type", "Limit": "const", "Two": "const", "A": "const", "B": "const", "Open": "function", "Sell": "function"}
    assert f.imports == [("os", None), ("text", "t"), ("side/effect", "_"), ("dots", ".")]
    assert {(r[0], r[3], r[4]) for r in f.refs} == {("Open", "call", "stock::Sell"), ("Print", "method", "stock::Sell"), ("inner", "call", "stock::Sell")}
    assert facts("cmd/x/main.go", "package main\n\nfunc main() {}\n").symbols == [("main", "function", 3, 6, "cmd/x/main")]


def test_paths():
    service = "src/auth/service.ts"
    assert resolve_relative(service, "./util") == "src/auth/util"
    assert resolve_relative(service, "../api/token::Token") == "src/api/token::Token"
    assert resolve_relative(service, "lodash") == "lodash"
    assert without_extension("a.b/c") == "a.b/c" and without_extension("a/.env") == "a/.env"


def test_first_registration_wins():
    toy = Language("toy", ("toy", "py"), lambda path, text: Facts(symbols=[(x.split()[1], "toy", 1, 1, "toy") for x in text.splitlines()]))
    registry = Registry((toy,)).register(default_registry().for_extension("py"))
    assert registry.for_extension("py") is toy and registry.for_extension("zz") is None
    assert registry.extensions() == ["toy", "py", "pyi"]
    assert toy.extract("a.toy", "symbol Widget").symbols == [("Widget", "toy", 1, 1, "toy")]


@pytest.mark.parametrize("extension", ["rs", "ts", "tsx", "js", "jsx", "go"])
@pytest.mark.parametrize("text", ["", "{", "}", "(", "`", "'", '"', "/*", "fn", "func", "class", "impl", "import", "use a::{", "${", "type", "const", "<", "=>", "match {", "enum A {"])
def test_broken_sources_do_not_fail(extension, text):
    facts(f"a.{extension}", text)
    facts(f"a.{extension}", (text + " x(") * 3)
