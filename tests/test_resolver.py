"""The resolver's truth table, from hand-made symbols and from real source text."""

import pytest

from quillgraph.operators import graph, resolve, store
from quillgraph.sources import reports, scan, walk

CASES = {
    "named": ({"A.ts": 'import { foo } from "./X"\nexport function caller() { foo(); }', "X.ts": "export function foo() {}"}, {("caller", "foo", "Imports", 1.0), ("caller", "foo", "Calls", 0.9)}),
    "namespace": ({"A.ts": 'import * as X from "./Y"\nexport function caller() { X.bar(); }', "Y.ts": "export function bar() {}"}, {("caller", "bar", "Calls", 0.9)}),
    "renamed": ({"A.ts": 'import { foo as bar } from "./X"\nexport function caller() { bar(); }', "X.ts": "export function foo() {}"}, {("caller", "foo", "Imports", 1.0)}),
    "default": ({"A.ts": 'import X from "./Y"\nexport function caller() { X(); }', "Y.ts": "export default function foo() {}"}, set()),
    "extends": ({"A.ts": 'import { Base } from "./B"\nclass Derived extends Base {}', "B.ts": "export class Base {}"}, {("Derived", "Base", "Imports", 1.0), ("Derived", "Base", "Extends", 0.9)}),
    "same file": ({"A.ts": "function foo(){}\nfunction bar(){ foo(); }"}, {("bar", "foo", "Calls", 1.0)}),
    "unknown": ({"A.ts": "export function caller() { nonexistent(); }"}, set()),
    "unique": ({"A.ts": "function caller() { far(); }", "deep/B.ts": "export function far() {}"}, {("caller", "far", "Calls", 0.7)}),
}


def tables(spark, files):
    df = spark.createDataFrame([(p, t, "typescript") for p, t in files.items()], "path string, content string, lang string")
    found = graph.cut(scan.extract(df))
    from quillgraph.operators import ranking

    return ranking.number_rows(scan.symbols_of(found), ["path", "byte", "name"]), scan.captures_of(found)


@pytest.mark.parametrize("case", CASES)
def test_truth_table(spark, case):
    files, want = CASES[case]
    s, c = tables(spark, files)
    edges, _, attempts = resolve.build_edges(s, c)
    names = {r["id"]: r["name"] for r in s.collect()}
    assert {(names[e["from_id"]], names[e["to_id"]], e["kind"], e["confidence"]) for e in edges.collect()} == want
    if case == "unknown":
        assert resolve.edge_stats(attempts).first()["unresolved"] >= 1


def test_aliases_resolve_renamed_and_default(spark):
    files = {"A.ts": 'import { foo as bar } from "./X"\nimport D from "./Y"\nexport function caller() { bar(); D(); }', "X.ts": "export function foo() {}", "Y.ts": "export default function main() {}"}
    s, c = tables(spark, files)
    edges, aliases, _ = resolve.build_edges(s, c, use_aliases=True)
    names = {r["id"]: r["name"] for r in s.collect()}
    assert {(names[e["to_id"]], e["confidence"]) for e in edges.where("kind = 'Calls'").collect()} == {("foo", 0.9), ("main", 0.9)}
    assert {(r["alias"], r["target_member"]) for r in aliases.collect()} == {("bar", "foo"), ("D", "default")}


def test_script_scanner():
    text = (
        "import type { T } from './t'\nexport interface Shape<T> extends Base<T>, ns.Other { area(): number }\n"
        "type A = { a: string } |\n  null;\nenum Color { Red }\nconst x = 1, { a, b } = o, f = (n: number) => { return `v ${foo(n)} }`; };\n"
        "export class D<T> extends P<T> implements Shape<T> {\n  field = /re\"g[/]ex/.test('a');\n  constructor() { super(); this.run(); }\n"
        "  async run<U>(): Promise<{ a: number }> {\n    Y.bar(); new W(1); new ns.G(); deep.er.call();\n    if (x) { h(); }\n  }\n  get v(): number { return 1 }\n}\n"
        "// function no() {}\nexport async function g(a: { b: number }) { q?.(); }\n"
    )
    found = scan.scan_script(text)
    symbols = {(r["kind"], r["name"]): (r["start_line"], r["end_line"]) for r in found if r["what"] == "symbol"}
    assert symbols == {
        ("interface_declaration", "Shape"): (2, 2), ("type_alias_declaration", "A"): (3, 4), ("enum_declaration", "Color"): (5, 5), ("lexical_declaration", "x"): (6, 6), ("lexical_declaration", "f"): (6, 6),
        ("class_declaration", "D"): (7, 15), ("method_definition", "constructor"): (9, 9), ("method_definition", "run"): (10, 13), ("method_definition", "v"): (14, 14), ("function_declaration", "g"): (17, 17),
    }
    calls = [(r["name"], r["qualifier"]) for r in found if r["what"] == "call"]
    assert sorted(calls, key=str) == sorted([("foo", None), ("test", None), ("run", None), ("bar", "Y"), ("W", None), ("G", "ns"), ("call", None), ("h", None)], key=str)
    assert [(r["what"], r["name"]) for r in found if r["what"] in ("extends", "implements")] == [("extends", "Base"), ("extends", "P"), ("implements", "Shape")]
    assert [(r["name"], r["source"], r["variant"]) for r in found if r["what"] == "import"] == [("T", "./t", 1)]


def test_python_scanner():
    found = scan.scan_python('"""d"""\n@deco\nasync def fetch_data(x):\n    return hello()\nclass Greeter(Base):\n    def hi(self):\n        self.x.go()\n    def bye(self): pass\n')
    assert {r["name"] for r in found if r["what"] == "symbol"} == {"fetch_data", "Greeter", "hi", "bye"}
    assert next(r["start_line"] for r in found if r["name"] == "fetch_data") == 3
    assert scan.scan_python("def broken(:") == []


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a b.ts").write_text("import x from './lib.js'\nexport * from './deep'\n// import n from './no'\n")
    (tmp_path / "src" / "lib.ts").write_text("const y = require('./deep/index')\n")
    (tmp_path / "src" / "deep").mkdir()
    (tmp_path / "src" / "deep" / "index.tsx").write_text("export function tsOnlyFn() {}")
    (tmp_path / "src" / "skip_me.ts").write_text("x")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "src" / "p.py").write_text("def py_only_fn(): pass\n")
    (tmp_path / "node_modules" / "z.ts").write_text("export function no() {}")
    (tmp_path / ".gitignore").write_text("skip_*\n!kept\n")
    files = walk.read_tree(spark, str(tmp_path)).withColumn("lang", walk.language_of(graph.F.col("path")))
    assert {(r["path"], r["lang"]) for r in files.collect()} == {("src/a b.ts", "typescript"), ("src/lib.ts", "typescript"), ("src/deep/index.tsx", "typescript"), ("src/p.py", "python"), ("node_modules/z.ts", None)}
    g = walk.script_graph(files.where("lang = 'typescript'"))
    assert {tuple(r) for r in g.collect()} == {("src/a b.ts", "src/lib.ts"), ("src/a b.ts", "src/deep/index.tsx"), ("src/lib.ts", "src/deep/index.tsx")}


def test_store(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "st"))
    assert st.table("symbols").count() == 0
    st.add_edges(spark.createDataFrame([(1, 2, "Calls", 0.7), (1, 2, "Calls", 0.9)], "from_id long, to_id long, kind string, confidence double"))
    st.add_edges(spark.createDataFrame([(1, 2, "Calls", 1.0), (2, 3, "Imports", 1.0)], "from_id long, to_id long, kind string, confidence double"))
    assert {tuple(r) for r in st.table("edges").collect()} == {(1, 2, "Calls", 0.9), (2, 3, "Imports", 1.0)}
    rows = "file string, alias string, target_file string, target_member string"
    st.add_aliases(spark.createDataFrame([("a", "X", "y", None), ("a", "X", "y", None)], rows))
    assert st.table("alias_decls").collect()[0]["target_member"] is None and st.table("alias_decls").count() == 1
    empty = spark.createDataFrame([], st.table("symbols").schema)
    assert not st.replace_unless_empty(empty, st.table("edges"), st.table("alias_decls"))
    assert st.table("edges").count() == 2 and not store.needs_reindex(st.table("edges"), st.table("alias_decls"))
    st.clear("alias_decls")
    assert st.table("alias_decls").count() == 0 and store.needs_reindex(st.table("edges"), st.table("alias_decls"))


def test_reports(spark, tmp_path):
    (tmp_path / "dsm.txt").write_text("## Files (level | path)\n  3 | a/b.ts\n 0 | c.ts\n## Edges\na/b.ts -> c.ts (level_diff: -3)\nx -> c.ts\n")
    levels, edges = reports.read_matrix(spark, str(tmp_path / "dsm.txt"))
    assert {tuple(r) for r in levels.collect()} == {("a/b.ts", 3), ("c.ts", 0)}
    assert [tuple(r) for r in edges.collect()] == [("a/b.ts", "c.ts")]
    (tmp_path / "h.txt").write_text("Quality Signal: 6872\nmodularity: -0.25 max depth: 4\ngod_files: 2")
    h = reports.read_health(spark, str(tmp_path / "h.txt")).first()
    assert (h["quality_signal"], h["modularity"], h["max_depth"], h["god_file_count"], h["equality"]) == (6872.0, -0.25, 4.0, 2.0, None)
    (tmp_path / "q.json").write_text('[{"id": "A1", "axis": 1, "query": "q", "expected_paths": ["p"]}]')
    assert reports.read_queries(spark, str(tmp_path / "q.json")).first()["negative"] is False
