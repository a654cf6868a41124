"""Resolution, dependencies, impact and envelopes on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from symloom.errors import UnsupportedSchema
from symloom.index import SymbolIndex
from symloom.operators import dependencies, impact, lookups, resolve, target
from symloom.operators.accuracy import scores
from symloom.operators.envelope import NOTE_EMPTY, NOTE_FALLBACK, QueryResult, confidence, definition_envelopes, reference_envelopes, resolution_tier
from symloom.schema import TABLES, from_frames

S = "name string, module_path string, path string, start_line int, start_col int, kind string"
R = "name string, path string, start_line int, container string"
I = "path string, module_path string, alias string"  # noqa: E741


def graph(spark, symbols=(), refs=(), imports=(), impls=(), files=None):
    """symbols: (module::name, path, line); refs: (name, path, line, container); imports: (path, module, alias)."""
    rows = [(q.rpartition("::")[2], q.rpartition("::")[0], p, n, 1, "function") for q, p, n in symbols]
    paths = sorted({r[2] for r in rows} | {r[1] for r in refs} | {i[0] for i in imports}) if files is None else files
    return SymbolIndex.from_frames(
        spark,
        files=spark.createDataFrame([(p, "h") for p in paths], "path string, content_hash string"),
        symbols=spark.createDataFrame(rows, S),
        refs=spark.createDataFrame(list(refs), R),
        imports=spark.createDataFrame(list(imports), I),
        impls=spark.createDataFrame(list(impls), TABLES["impls"]),
    )


def two_helpers(spark, imports=()):
    return graph(
        spark,
        [("crate::a::helper", "src/a.rs", 2), ("crate::b::helper", "src/b.rs", 2), ("crate::d::other", "src/d.rs", 1)],
        [("helper", "src/c.rs", 10, "main"), ("helper", "src/d.rs", 4, "other")],
        [("src/c.rs", "crate::a::helper", None), *imports],
    )


def ranked(index, name, place):
    keys = index.spark.createDataFrame([(name, place)], "name string, from_place string")
    rows = resolve.ranked_matches(index.graph, keys).orderBy("rank").collect()
    top = resolve.top_matches(index.graph, keys).collect()
    assert [(r.module_path, r.tier) for r in rows[:1]] == [(r.module_path, r.tier) for r in top]
    return [r.module_path for r in rows]


def test_two_helpers(spark):
    index = two_helpers(spark, [("src/e.rs", "crate::b::helper", "helper")])
    assert ranked(index, "helper", "src/c.rs") == ["crate::a", "crate::b"]
    assert ranked(index, "helper", "crate::b") == ["crate::b", "crate::a"]
    assert ranked(index, "helper", "crate::d") == ["crate::a", "crate::b"]
    assert ranked(index, "helper", "src/e.rs") == ["crate::b", "crate::a"]
    assert ranked(index, "absent", "src/e.rs") == []
    assert [r.path for r in resolve.callers_of(index.graph, "helper", None).collect()] == ["src/c.rs", "src/d.rs"]
    assert [r.path for r in resolve.callers_of(index.graph, "helper", "crate::a").collect()] == ["src/c.rs"]
    assert index.definition("crate::z::helper") == []


def test_paths_rank_by_component(spark):
    index = graph(spark, [("m::f", "a-b/x.rs", 1), ("n::f", "a/x.rs", 1)])
    assert ranked(index, "f", "q.rs") == ["n", "m"]
    assert [d["path"] for d in index.definition("f")] == ["a-b/x.rs", "a/x.rs"]


def deps_index(spark):
    return graph(
        spark,
        [("crate::a::g", "src/a.rs", 3), ("crate::b::f", "src/b.rs", 1), ("crate::c::h", "src/c.rs", 1), ("crate::leaf::alone", "src/leaf.rs", 1)],
        [("f", "src/a.rs", 4, "crate::a::g")],
        [("src/a.rs", "crate::b", None), ("src/a.rs", "crate::b", "bb"), ("src/a.rs", "crate::c", None), ("src/a.rs", "std::io::Read", None)],
    )


def test_dependencies(spark):
    index = deps_index(spark)
    want = [("crate::b", "src/b.rs"), ("crate::c", "src/c.rs"), ("std::io::Read", None)]
    for name in ("crate::a", "g", "src/a.rs"):
        got = index.dependencies_with_meta(name)
        assert [(d["module_path"], d["file"]) for d in got.results] == want
        assert (got.confidence, got.resolution_tier, got.notes) == ("high", 1, [])
    assert index.dependencies_with_meta("crate::leaf").notes == ["Target resolved to 1 file(s) but no import/cross-file dependencies were recorded."]
    assert index.dependencies_with_meta("nothing").notes == ["No indexed files found for target `nothing`."]


def test_module_may_depend_on_itself(spark):
    index = graph(spark, [("m::f", "a.rs", 1), ("m::g", "b.rs", 1)], [("g", "a.rs", 2, "m::f")])
    assert [(d["module_path"], d["file"]) for d in index.dependencies("f")] == [("m", "b.rs")]


def test_longest_prefix(spark):
    index = graph(spark, [("a::b::f", "z.rs", 1), ("a::b::g", "y.rs", 1), ("a::h", "x.rs", 1)], imports=[("q.rs", m, None) for m in ("a::b::c::d", "a::b", "a::x", "zz::y", "a")])
    got = {r.import_path: (r.dep_module, r.dep_file) for r in dependencies.import_modules(index.graph).collect()}
    assert got == {"a::b::c::d": ("a::b", "y.rs"), "a::b": ("a::b", "y.rs"), "a::x": ("a", "x.rs"), "zz::y": ("zz::y", None), "a": ("a", "x.rs")}


def names(rows):
    return [r["name"] for r in rows]


def test_impact_chain_cycle_and_seeds(spark):
    chain = graph(spark, [(f"crate::{n}", "src/lib.rs", i) for i, n in enumerate(["a", "b", "c", "lonely"])], [("a", "src/lib.rs", 9, "crate::b"), ("b", "src/lib.rs", 9, "crate::c")])
    got = chain.impact_with_meta("a")
    assert names(got.results) == ["b", "c"] and (got.confidence, got.resolution_tier) == ("medium", 2)
    assert got.notes == ["Impact is a candidate blast radius and may over-approximate; verify before edits."]
    assert chain.impact("lonely") == [] and chain.impact_with_meta("lonely").notes == [NOTE_EMPTY]
    assert chain.impact_with_meta("crate::zz::a").notes == ["No definition for `a` in module `crate::zz`."]
    cycle = graph(spark, [(f"crate::{n}", "src/lib.rs", i) for i, n in enumerate("xyz")], [(a, "src/lib.rs", 9, f"crate::{b}") for a, b in ("xy", "yz", "zx", "yx", "xx")])
    assert names(cycle.impact("x")) == ["y", "z"] == names(cycle.impact("x"))
    seeds = graph(
        spark,
        [("crate::api::serve", "src/api.rs", 1), ("crate::mcp::serve", "src/mcp.rs", 1), ("crate::boot", "src/main.rs", 1)],
        [("serve", "src/main.rs", 2, "crate::boot")],
        [("src/main.rs", "crate::mcp::serve", None)],
    )
    assert names(seeds.impact("serve", "crate::mcp")) == ["boot"] and seeds.impact("crate::api::serve") == []
    assert seeds.impact_with_meta("serve").confidence == "low" and seeds.impact_with_meta("serve").resolution_tier == "mixed"


def test_impact_drops_path_like_containers_unless_structural(spark):
    index = graph(spark, [("src/a::f", "src/a.ts", 1), ("src/a::login", "src/a.ts", 2)], [("f", "src/a.ts", 3, "src/a::Auth::login")])
    assert index.impact("f") == []
    assert names(index.impact_with_meta("f", structural=True).results) == ["login"]


def test_impact_of_undefined_name(spark):
    index = graph(spark, [("m::g", "a.rs", 1)], [("f", "a.rs", 2, "m::g")])
    assert index.impact_of_name("f") == [] and index.impact("f") == []


def test_targets(spark):
    index = graph(spark, [("crate::mcp::serve", "src/mcp/mod.rs", 1)])
    for t in ("crate::mcp", "src/mcp/mod.rs", "serve"):
        asked = spark.createDataFrame([(t,)], "target string")
        assert [r.path for r in target.target_files(index.graph, asked).collect()] == ["src/mcp/mod.rs"]
        assert [r.preferred_module for r in target.preferred_modules(index.graph, asked).collect()] == ["crate::mcp"]


def test_implementations(spark):
    index = graph(spark, impls=[("B", "Storage", "b.rs", 14, 1), ("A", "Storage", "a.rs", 10, 1), ("A", None, "a.rs", 18, 1)])
    got = index.implementations_with_meta("Storage")
    assert [r["type_name"] for r in got.results] == ["A", "B"] and (got.confidence, got.resolution_tier) == ("high", 2)
    assert index.implementations_with_meta("Nope").notes[0].startswith("No implementations found")


@pytest.mark.parametrize(("tiers", "several", "level", "tier"), [([1, 2], False, "high", "mixed"), ([3, 3], False, "low", 3), ([1, 3], False, "medium", "mixed"), ([1, 2], True, "medium", "mixed"), ([], False, "low", 0), ([2], False, "high", 2)])
def test_confidence(tiers, several, level, tier):
    assert confidence(tiers, several) == level and resolution_tier(tiers) == tier


def test_empty_and_fallback_notes():
    miss = QueryResult.of([], [], False)
    assert (miss.confidence, miss.resolution_tier, miss.notes) == ("high", 0, [NOTE_EMPTY])
    assert QueryResult.of([{}], [3], False).notes == [NOTE_FALLBACK]
    assert QueryResult.of([{"a": 1}], [1], False).map_results(lambda r: r["a"]).results == [1]


def test_references_and_callers_of_an_undefined_name_differ(spark):
    index = graph(spark, refs=[("ghost", "a.rs", 1, "m")])
    r, c = index.references_with_meta("ghost"), index.callers_with_meta("ghost")
    assert (r.confidence, r.resolution_tier, r.notes) == ("high", 2, [])
    assert (c.confidence, c.resolution_tier, c.notes) == ("low", 3, [NOTE_FALLBACK])


def test_point_and_bulk_envelopes_agree(spark):
    index = two_helpers(spark)
    for bulk, point in ((definition_envelopes(index.graph), index.definition_with_meta), (reference_envelopes(index.graph), index.references_with_meta), (reference_envelopes(index.graph, True), index.callers_with_meta)):
        for r in bulk.collect():
            one = point(r.name)
            assert (r.n_results, r.confidence, r.resolution_tier, list(r.notes)) == (len(one.results), one.confidence, str(one.resolution_tier), [n for n in one.notes if n]), r.name


def test_module_argument_wins_over_qualified_name(spark):
    index = two_helpers(spark)
    assert [d["module_path"] for d in index.definition("crate::b::helper", "crate::a")] == ["crate::a"]
    got = index.definition_with_meta("helper")
    assert got.confidence == "low" and got.notes[0].startswith("Found 2 definitions for `helper`;")


# The tiers again, as plain loops over their definitions.


def segments(p):
    return p, p.rsplit("/", 1)[-1], p.rsplit("::", 1)[-1]


def looks_like_path(p):
    stem, dot, _ = p.rpartition("/")[2].rpartition(".")
    return "/" in p or "\\" in p or bool(dot and stem)


def model_rank(symbols, imports, name, place):
    out = []
    for q, p, line in symbols:
        module, _, n = q.rpartition("::")
        if n != name:
            continue
        tier = 3
        if module == place or looks_like_path(place) and any(s[1] == place and s[0].rpartition("::")[0] == module for s in symbols):
            tier = 2
        for f, m, alias in imports:
            prefix, _, last = m.rpartition("::")
            if f == place and alias in (None, name) and (m == q or module in segments(m) or last == name and module in segments(prefix)):
                tier = 1
        out.append((tier, p.split("/"), line, module))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_resolution_matches_model(spark, seed):
    r = random.Random(seed)
    modules = ["", "a", "a::b", "b", "x/y", "x/y::b", "a::b::c"]
    files = ["src/a.rs", "src-b/a.rs", "z.rs", "x/y.ts"]
    symbols = sorted({(f"{m}::{n}" if m else n, r.choice(files), r.randrange(5)) for m in modules for n in "fgb" if r.random() < 0.6})
    imports = [(r.choice(files), r.choice([*modules[1:], "a::f", "b::g", "x/y::f", "q/a", "q/a::g", "f"]), r.choice([None, None, "f", "g", "h"])) for _ in range(14)]
    places = [*files, *modules[1:], "none.rs"]
    index = graph(spark, symbols, imports=imports)
    keys = spark.createDataFrame([(n, p) for n in "fgbh" for p in places], "name string, from_place string")
    got = {}
    for row in resolve.ranked_matches(index.graph, keys).orderBy("rank").collect():
        got.setdefault((row.name, row.from_place), []).append((row.tier, row.path.split("/"), row.start_line, row.module_path))
    top = {(t.name, t.from_place): (t.tier, t.path.split("/"), t.start_line, t.module_path, t.n_candidates) for t in resolve.top_matches(index.graph, keys).collect()}
    for n in "fgbh":
        for p in places:
            want = model_rank(symbols, imports, n, p)
            assert got.get((n, p), []) == want, (n, p)
            assert top.get((n, p)) == ((*want[0], len(want)) if want else None)


@pytest.mark.parametrize("seed", range(3))
def test_closure_matches_model(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(18)}
    seeds = {(f"s{k}", r.randrange(12)) for k in range(4) for _ in range(2)}
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "callee_id string, container string")
    got = {(x.seed, int(x.container)) for x in impact.closure(frame, spark.createDataFrame([(s, str(i)) for s, i in seeds], "seed string, id string")).collect()}
    want = set()
    for s in {s for s, _ in seeds}:
        start = {i for t, i in seeds if t == s}
        seen = set(start)
        todo = list(start)
        while todo:
            a = todo.pop()
            for x, b in edges:
                if x == a and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(s, i) for i in seen - start}
    assert got == want


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_closure_of_all_equals_the_walk(spark, seed, monkeypatch):
    for name in ("SHARE_ROWS", "BLOCK_ROWS", "COLOUR_STEPS"):
        monkeypatch.setattr(impact, name, 3)
    r = random.Random(seed)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(40)} | {(100 + k, 100 + (k + 1) % 9) for k in range(9)} | {(5, 103), (200, 200)}
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "callee_id string, container string")
    seeds = spark.createDataFrame([(f"s{k}", str(r.choice([r.randrange(30), 100 + r.randrange(9), 200, 999]))) for k in range(20) for _ in range(1 + k % 3)], "seed string, id string")
    got, want = impact.closure_of_all(frame, seeds), impact.closure(frame, seeds)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    nothing = impact.closure_of_all(frame, seeds.filter("id = '999'"))
    assert nothing.isEmpty() and impact.closure_of_all(frame.limit(0), seeds).isEmpty()


def test_closure_of_all_follows_components_not_their_members(spark):
    edges = spark.createDataFrame([(str(k), str((k * f + 1) % 300)) for k in range(300) for f in (1, 7)], "callee_id string, container string")
    seeds = spark.createDataFrame([(f"s{k}", str(k)) for k in range(300)], "seed string, id string")
    assert impact._reach(edges, seeds).walked.count() == 1
    assert impact.closure_of_all(edges, seeds).count() == 300 * 299


def one_component(spark, n, classes=1):
    """Each of n seeds reaches all of n members but its own."""
    numbers = spark.range(n).withColumn("n", F.col("id"))
    seeds = numbers.select((F.col("n") % classes).alias("class"), F.concat(F.lit("sym_"), "n").alias("seed"), F.array("n").alias("own"))
    members = numbers.select(F.lit(0).cast("long").alias("component"), "n", F.concat(F.lit("crate::m::sym_"), "n").alias("container"))
    return impact._Reach(seeds, spark.range(classes).select(F.col("id").alias("class"), F.lit(0).cast("long").alias("component")), members)


def test_expanded_rows_are_whole_whatever_the_shares_and_bands(spark, monkeypatch):
    for name in ("BLOCK_ROWS", "CROSS_SEEDS", "CROSS_MEMBERS"):
        monkeypatch.setattr(impact, name, 3)
    reach = one_component(spark, 20, classes=2)
    got = sorted(map(tuple, impact._expand(reach, reach.members).collect()))
    assert got == sorted((f"sym_{a}", f"crate::m::sym_{b}") for a in range(20) for b in range(20) if a != b)


def test_expanded_rows_are_small_when_written(spark, tmp_path):
    n = 2_000
    reach = one_component(spark, n)
    impact._expand(reach, reach.members).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n * (n - 1)
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) / (n * (n - 1)) < 0.5, "bytes a row"


@pytest.mark.parametrize("structural", [False, True])
def test_impact_of_all_equals_impact(spark, structural):
    symbols = [("m::a", "src/m.rs", 1), ("m::b", "src/m.rs", 2), ("m::c", "src/m.rs", 3), ("k::b", "src/k.rs", 1), ("k::only", "src/k.rs", 9), ("m::b", "src/m.rs", 2)]
    refs = [("a", "src/m.rs", 5, "m::b"), ("a", "src/m.rs", 6, "b"), ("b", "src/m.rs", 7, "m::c"), ("c", "src/m.rs", 8, "m::a"), ("only", "src/k.rs", 9, "k::b"), ("c", "src/m.rs", 9, "m::T::b"), ("only", "src/k.rs", 9, "b")]
    g = graph(spark, symbols, refs).graph
    kinds = g.symbols.withColumn("kind", F.when(F.monotonically_increasing_id() % 2 == 0, "function").otherwise("struct"))
    g = from_frames(spark, files=g.files, symbols=kinds, refs=g.refs, imports=g.imports, impls=g.impls)
    seeds = impact.seeds_of_definitions(g.symbols)
    got, want = impact.impact_of_all(g, seeds, structural=structural), impact.impact(g, seeds, structural=structural)
    assert got.columns == want.columns and not want.isEmpty()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_accuracy_scores(spark):
    frame = lambda rows: spark.createDataFrame(rows, "method string, file string, line int")
    found, gold = frame([("m", "a", 1), ("m", "a", 2), ("m", "a", 2)]), frame([("m", "a", 1), ("m", "b", 1), ("n", "b", 1)])
    got = {r["method"]: tuple(r)[1:] for r in scores(found, gold, ["method"], ["file", "line"]).collect()}
    assert got == {"m": (1, 1, 1, 0.5, 0.5, 0.5), "n": (0, 0, 1, 1.0, 0.0, 0.0)}


def test_lookups(spark):
    index = deps_index(spark)
    assert [tuple(r) for r in lookups.imports_of_file(index.graph, "src/a.rs").collect()] == [("crate::b", None), ("crate::b", "bb"), ("crate::c", None), ("std::io::Read", None)]
    assert lookups.file_is_indexed(index.graph, "src/a.rs") and not lookups.file_is_indexed(index.graph, "x")


def test_older_schema_is_filled_and_unknown_kinds_are_calls(spark):
    refs = spark.createDataFrame([("f", "a.rs", 1, 1)], "name string, path string, start_line int, start_col int")
    g = from_frames(spark, refs=refs)
    assert tuple(g.refs.first()) == ("f", "a.rs", 1, 1, "call", "")
    odd = refs.withColumn("kind", F.lit("odd"))
    assert from_frames(spark, refs=odd).refs.first().kind == "call"
    assert str(UnsupportedSchema(99, 2)) == "the index has schema version 99; this version reads up to 2"


def test_plans_have_no_nested_loops(spark):
    index = two_helpers(spark)
    keys = index.graph.refs.selectExpr("name", "path as from_place")
    for df in (resolve.ranked_matches(index.graph, keys), resolve.top_matches(index.graph, keys), dependencies.dependencies(index.graph, lookups.module_files(index.graph).withColumnRenamed("module_path", "target"))):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_results_do_not_depend_on_partitions(spark):
    index = two_helpers(spark)
    keys = index.graph.refs.selectExpr("name", "path as from_place")
    first = sorted(resolve.top_matches(index.graph, keys).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(resolve.top_matches(index.graph, keys).collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
