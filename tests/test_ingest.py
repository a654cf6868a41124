"""Crawling, incremental passes, snapshots and the accuracy corpus."""

import json

import pytest

from symloom.errors import UnsupportedSchema
from symloom.index import SymbolIndex
from symloom.operators.accuracy import scores
from symloom.sources.crawl import walk
from symloom.sources.extract import Facts, Language, Registry
from symloom.sources.store import Store

EXTENSIONS = ["rs", "py", "ts", "js", "jsx", "go"]


def write(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def counts(stats):
    return (stats.indexed, stats.skipped, stats.removed, stats.errors)


def test_walk_follows_ignore_files(tmp_path):
    write(
        tmp_path,
        {
            ".gitignore": "target/\n*.gen.rs\n!keep.gen.rs\n/only_root.rs\n# comment\ndoc/**/x.rs\n[ab].py\n",
            "a.rs": "", "b.txt": "", "x.gen.rs": "", "keep.gen.rs": "", "only_root.rs": "", "sub/only_root.rs": "", "target/t.rs": "", ".hidden.rs": "", ".git/h.rs": "",
            "doc/x.rs": "", "doc/p/q/x.rs": "", "doc/y.rs": "", "a.py": "", "c.py": "", "sub/.ignore": "z.rs\n", "sub/z.rs": "", "z.rs": "", "a-b/x.rs": "", "a/x.rs": "",
        },
    )
    assert list(walk(str(tmp_path), EXTENSIONS)) == ["a/x.rs", "a-b/x.rs", "a.rs", "c.py", "doc/y.rs", "keep.gen.rs", "sub/only_root.rs", "z.rs"]


def test_incremental_passes(spark, tmp_path):
    root, folder = tmp_path / "src", str(tmp_path / "index")
    write(root, {"a.py": "def f():\n    g()\n", "b.py": "def g():\n    pass\n", "skip.txt": "x"})
    index = SymbolIndex.open(spark, folder)
    assert counts(index.index_path(str(root))) == (2, 0, 0, 0)
    assert [c["path"] for c in index.callers("g")] == ["a.py"]
    old = index.graph
    assert counts(index.index_path(str(root))) == (0, 2, 0, 0)
    write(root, {"b.py": "def g():\n    pass\n\ndef fresh():\n    pass\n"})
    assert counts(index.index_path(str(root))) == (1, 1, 0, 0)
    assert [d["start_line"] for d in index.definition("fresh")] == [4] and len(index.definition("g")) == 1
    (root / "a.py").unlink()
    assert counts(index.index_path(str(root))) == (0, 1, 1, 0)
    assert index.references("g") == [] and index.definition("f") == []
    assert {r.name for r in old.symbols.collect()} == {"f", "g"}, "an open snapshot stays as it was"
    write(root, {"b.py": "def g(:\n"})
    assert counts(index.index_path(str(root))) == (0, 0, 0, 1)
    assert len(index.definition("fresh")) == 1, "what was indexed of a failed file stays"
    write(root, {"b.py": b"\xff\xfe", "c.py": "def c():\n    pass\n"})
    assert counts(index.index_path(str(root))) == (1, 0, 0, 1)


def test_incremental_equals_rebuild_and_compaction(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    monkeypatch.setattr("symloom.sources.store.MAX_SEGMENTS", 2)
    index = SymbolIndex.open(spark, str(tmp_path / "index"))
    for k in range(4):
        write(root, {f"m{k}.py": f"def f{k}():\n    f0()\n", "m0.py": f"def f0():\n    pass\n\nV{k} = 1\nK{k} = 2\n"})
        index.index_path(str(root))
    rebuilt = SymbolIndex.open(spark, str(tmp_path / "again"))
    rebuilt.index_path(str(root))
    for t in ("files", "symbols", "refs", "imports", "impls"):
        assert sorted(map(str, index.graph.table(t).collect())) == sorted(map(str, rebuilt.graph.table(t).collect()))
    store = Store(spark, str(tmp_path / "index"))
    store.vacuum()
    assert len(list((tmp_path / "index").glob("seg-*"))) == len(json.loads((tmp_path / "index/_CURRENT").read_text())["segments"]) <= 2
    assert len(SymbolIndex.open(spark, str(tmp_path / "index")).definition("f3")) == 1


def test_newer_index_is_rejected_and_left_alone(spark, tmp_path):
    (tmp_path / "_CURRENT").write_text('{"schema_version": 99, "segments": []}')
    with pytest.raises(UnsupportedSchema):
        _ = SymbolIndex.open(spark, str(tmp_path)).graph
    assert "99" in (tmp_path / "_CURRENT").read_text()


def test_older_index_is_filled(spark, tmp_path):
    index = SymbolIndex.open(spark, str(tmp_path / "i"))
    write(tmp_path / "src", {"a.py": "def f():\n    f()\n"})
    index.index_path(str(tmp_path / "src"))
    segment = next((tmp_path / "i").glob("seg-*"))
    index.graph.refs.drop("kind", "container").write.parquet(str(tmp_path / "old"))
    for p in (segment / "refs").iterdir():
        p.unlink()
    for p in (tmp_path / "old").iterdir():
        p.rename(segment / "refs" / p.name)
    (tmp_path / "i/._CURRENT.crc").unlink(missing_ok=True)
    (tmp_path / "i/_CURRENT").write_text(json.dumps({"schema_version": 1, "segments": [segment.name]}))
    assert tuple(SymbolIndex.open(spark, str(tmp_path / "i")).graph.refs.first())[-2:] == ("call", "")


def test_empty_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    index = SymbolIndex.open(spark, str(tmp_path / "index"))
    assert counts(index.index_path(str(tmp_path / "src"))) == (0, 0, 0, 0)
    assert index.definition("x") == []


def test_custom_language(spark, tmp_path):
    toy = Language("toy", ("toy",), lambda path, text: Facts(symbols=[(x.split()[1], "toy", i + 1, 8, "toy") for i, x in enumerate(text.splitlines())]))
    write(tmp_path / "src", {"a.toy": "symbol Widget\nsymbol Gadget\n", "b.py": "def f(): pass\n"})
    index = SymbolIndex.open(spark, str(tmp_path / "index"), Registry((toy,)))
    assert counts(index.index_path(str(tmp_path / "src"))) == (1, 0, 0, 0)
    assert [(d["kind"], d["start_line"]) for d in index.definition("Gadget")] == [("toy", 2)]


def test_remote_scan_agrees_with_the_local_walk(spark, tmp_path):
    from symloom.sources.crawl import scan

    write(tmp_path, {".gitignore": "skip/\n", "a.py": "A", "d/b.rs": "B", "skip/c.py": "C", ".hid/d.py": "D", "e.txt": "E"})
    local = sorted((r.path, bytes(r.content)) for r in scan(spark, str(tmp_path), EXTENSIONS).collect())
    remote = sorted((r.path, bytes(r.content)) for r in scan(spark, f"file://{tmp_path}", EXTENSIONS).collect())
    assert local == remote == [("a.py", b"A"), ("d/b.rs", b"B")]


CORPUS = {
    "rs/src/till.rs": "/* struct Drawer is described here: fn ring_up() {} */\nuse crate::coin::Coin;\n\n#[derive(Debug)]\npub struct Drawer(Vec<Coin>);\n\nfn ring_up(d: &Drawer) -> u32 {\n    d.0.len() as u32 // ring_up(\n}\n",
    "ts/desk.ts": "// class Desk in a comment\nimport { stamp } from './stamp';\nexport default class Desk { seal() { stamp(`class Desk {}`); } }\nenum Shelf { Top }\n",
    "js/stamp.js": "const text = 'function stamp() {}';\nexport const stamp = (ink) => ink + text;\nstamp(1);\n",
    "js/Panel.jsx": "import { stamp } from './stamp';\n\nexport function Panel() { return <p title=\"function Panel\">{stamp('x')}</p>; }\n",
    "py/till.py": '"""class Drawer: documented."""\n\ndef ring_up(drawer):\n    return len(drawer)\n\nNOTE = "def ring_up(x):"\n',
    "go/till.go": "package till\n\n// type Drawer struct\ntype Drawer struct{ coins []int }\n\nfunc RingUp(d Drawer) int { return len(d.coins) }\n",
}
GOLD = [
    ("Drawer", "rs/src/till.rs", 5), ("Drawer", "go/till.go", 4), ("ring_up", "rs/src/till.rs", 7), ("ring_up", "py/till.py", 3), ("Desk", "ts/desk.ts", 3), ("Shelf", "ts/desk.ts", 4),
    ("stamp", "js/stamp.js", 2), ("Panel", "js/Panel.jsx", 3), ("RingUp", "go/till.go", 6), ("NOTE", "py/till.py", 6),
]


def test_definitions_of_the_decoy_corpus(spark, tmp_path):
    write(tmp_path / "src", CORPUS)
    index = SymbolIndex.open(spark, str(tmp_path / "index"))
    assert counts(index.index_path(str(tmp_path / "src"))) == (6, 0, 0, 0)
    gold = spark.createDataFrame([("all", *g) for g in GOLD], "corpus string, name string, file string, line int")
    found = index.graph.symbols.join(gold.select("name").distinct(), "name", "left_semi").filter("kind <> 'impl'").selectExpr("'all' AS corpus", "name", "path AS file", "start_line AS line")
    assert tuple(scores(found, gold, ["corpus"], ["name", "file", "line"]).first()) == ("all", 10, 0, 0, 1.0, 1.0, 1.0)
    assert [c["path"] for c in index.callers("stamp")] == ["js/Panel.jsx", "js/stamp.js", "ts/desk.ts"]
