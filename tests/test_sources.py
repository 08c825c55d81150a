"""Files, extraction and streams."""

import json

import pytest
from pyspark.sql import functions as F

from knotwork.functions.text import file_node_id, normalize_symbol, sanitize_id
from knotwork.operators import extract, syntax
from knotwork.plans.snippets import source_files
from knotwork.sources import files
from knotwork.streaming import changes


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def test_names(spark):
    assert column(spark, ["Élève-1 x.y", "a_b-c"], sanitize_id) == ["Élève-1_x_y", "a_b-c"]
    assert column(spark, ["app/service.py", "service.py", "a/b/c.tar.gz"], file_node_id) == ["app_service", "service", "b_c_tar"]
    assert column(spark, ['"UserService"', "'MyClass'", "  Hash ,", "DONTCASE"], normalize_symbol) == ["userservice", "myclass", "hash", "dontcase"]


def test_extract(spark):
    nodes, edges = extract.extract(source_files(spark))
    by = {(r.id, r.type) for r in nodes.collect()}
    assert {("app_service", "file"), ("service_Ledger", "class"), ("service_fetch_row", "function"), ("service_main", "function"), ("App_handleClick", "function"), ("models_Élève", "class")} <= by
    assert any(t == "rationale" and i.startswith("service_users_are_cached") for i, t in by)
    found = {(r.source, r.target, r.relation) for r in edges.collect()}
    assert {("app_service", "os", "imports"), ("app_service", "pathlib", "imports_from"), ("service_svc", "service_stop", "calls"), ("service_Ledger", "service_Mixin_Core", "inherits"), ("src_service", "HashMap", "imports"), ("service_Ledger", "Store", "implements")} <= found
    assert not any(i == "service_init" or i == "Main_main" for i, _ in by)
    assert [r.error for r in extract.errors(source_files(spark)).collect()] == ["No extractor for .xyz files yet"]
    assert nodes.where("source_file = 'empty.py'").count() == 1
    assert nodes.where("source_file = 'tail.py' and type = 'class'").count() == 1
    level = {r.label: json.loads(r.metadata)["level"] for r in nodes.where("source_file = 'docs/guide.md' and metadata is not null").collect()}
    assert level == {"Guide": 1, "Set up": 2, "Deeper still": 3}
    g = extract.to_graph(source_files(spark))
    assert g.nodes.count() == g.nodes.select("id").distinct().count()


def test_extract_handles_nulls_and_no_files(spark):
    odd = spark.createDataFrame([("a.py", None), (None, "class X:"), ("b", "x")], "path string, content string")
    nodes, edges = extract.extract(odd)
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"] and edges.count() == 0
    nodes, edges = extract.extract(odd.where("false"))
    assert nodes.count() == 0 and edges.count() == 0


def test_syntax(spark):
    more = spark.createDataFrame([("bad.py", "def (:", 99), ("big.py", "class Far: pass\n", 2_000_000_000)], "path string, content string, ord bigint")
    nodes, edges = extract.extract_by_syntax(source_files(spark).unionByName(more))
    by = {(r.id, r.type) for r in nodes.collect()}
    assert {("tail_Tail", "class"), ("app_service", "file"), ("service_Ledger", "class"), ("bad", "file"), ("big_Far", "class"), ("guide_Guide", "class"), ("Settings_package", "class")} <= by
    assert {("service_Ledger", "service_Core", "inherits"), ("app_service", "service_fetch_row", "contains")} <= {(r.source, r.target, r.relation) for r in edges.collect()}
    g = extract.to_graph(source_files(spark).unionByName(more))
    assert g.nodes.count() == g.nodes.select("id").distinct().count() and g.nodes.where("ord is null").count() == 0


def declared(path, text):
    rows = syntax.parse(path, text, "s", "F")
    return {(r[2], r[3]) for r in rows if r[0] == "node"}, {(r[5], r[4]) for r in rows if r[0] == "edge" and r[5] not in ("contains", "rationale_for")}


def test_syntax_by_language():
    java = 'import java.util.List;\n/* class Not {} */\nclass Ledger extends base.Store {\n  // NOTE: keep\n  String s = "class Fake {";\n  <T> List<T>\n  rows(int id,\n    Map<String, List<T>> m) throws E { if (x) { go(); } return new Bar() { }; }\n}\ninterface I {}\nenum K { A }\n'
    assert declared("a.java", java) == ({("keep", "rationale"), ("Ledger", "class"), ("rows", "function"), ("I", "interface"), ("K", "enum")}, {("imports", "List"), ("inherits", "s_Store")})
    c = '#include "my/x.h"\nstruct user { int a; };\nint get(int a);\nstatic int *\nput(int a,\n char *b)\n{ for (;;) { } return foo(a); }\n'
    assert declared("b.c", c)[0] == {("user", "class"), ("get", "function"), ("put", "function")}
    assert declared("c.hpp", "class A : public B, private ns::C { public: A(int x) : y(x) { } void run() const { } };") == ({("A", "class"), ("run", "function")}, {("inherits", "s_B"), ("inherits", "s_C")})
    assert declared("e.rb", 'require "json"\nclass A < Base\n  # TODO: it\n  def self.make!; end\nend\n') == ({("A", "class"), ("it", "rationale"), ("make!", "function")}, {("imports", "json"), ("inherits", "s_Base")})
    go = 'import (\n  "net/http"\n  f "fmt"\n)\nimport "os"\ntype A struct {\n}\ntype S interface {\n}\nfunc (s *A) Get(\n id int) {\n}\nfunc init() {}\n'
    assert declared("f.go", go) == ({("A", "class"), ("S", "interface"), ("Get", "function")}, {("imports", x) for x in ("http", "fmt", "os")})
    ts = "import { a } from './x/util'\nabstract class App<T> extends React.Component<T> {\n  render(): void { if (a) { } }\n}\nconst go = async (e) => { }\ninterface Shape {}\nenum Q {A}\n"
    assert declared("g.ts", ts) == ({("App", "class"), ("render", "function"), ("go", "function"), ("Shape", "interface"), ("Q", "enum")}, {("imports", "util"), ("inherits", "s_Component")})
    rust = "use std::collections::{HashMap, HashSet};\npub struct S<'a> { x: &'a str }\ntrait T { fn x(&self); }\nfn main() {}\nfn long(\n a: u8,\n) {}\n"
    assert declared("i.rs", rust) == ({("S", "class"), ("T", "interface"), ("x", "function"), ("long", "function")}, {("imports", "HashMap"), ("imports", "HashSet")})
    python = "class A(B.C, object):\n  async def f(self,\n     x): pass\n# NOTE: hi\ndef main(): pass\n"
    assert declared("y.py", python) == ({("A", "class"), ("f", "function"), ("hi", "rationale")}, {("inherits", "s_C")})
    assert syntax.parse("z.py", "def (:", "s", "F")[0][0] == "error" and syntax.parse("z.py", "", "s", "F") == []
    assert len(syntax.EXTENSIONS) == len(set(syntax.EXTENSIONS)) and len(syntax.GRAMMARS) == 26


def test_scan(spark, tmp_path):
    root = tmp_path / "project"
    for name, text in {"a.py": "import os\n", "node_modules/x/y.js": "x", ".hidden.py": "x", "deep/b.rs": "fn a", "Makefile": "all:", "img.png": "p", "x.unknown": "?", ".env": "A=1"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "big.py").write_bytes(b"x" * 3_000_000)
    found = {r.path: (r.language, r.category) for r in files.scan(spark, str(root), 1).collect()}
    assert found == {"a.py": ("Python", "Code"), "deep/b.rs": ("Rust", "Code"), "Makefile": ("Manifest", "Manifest"), "img.png": ("Image", "Image")}
    text = {r.path: r.content for r in files.read(spark, str(root), 1).collect()}
    assert text == {"a.py": "import os\n", "deep/b.rs": "fn a"}
    assert files.primary_language(files.scan(spark, str(root), 1)).first().language == "Python"
    assert {r.category: r.n for r in files.by_category(files.scan(spark, str(root), 1)).collect()} == {"Code": 2, "Manifest": 1, "Image": 1}


@pytest.mark.parametrize("name", ["app/build/app", "it's", "proj(1)+x", "a b%20c#d", "[x]{y}*"])
def test_scan_of_odd_folders(spark, tmp_path, name):
    root = tmp_path / name
    (root / "pkg").mkdir(parents=True)
    (root / "build").mkdir()
    (root / "pkg/__init__.py").write_text("x = 1\n")
    (root / "pkg/a b+c%41.py").write_bytes("caf\xe9".encode("latin-1"))
    (root / "build/out.py").write_text("no")
    (root / "loop").symlink_to(root)
    assert {r.path: r.content for r in files.read(spark, str(root)).collect()} == {"pkg/__init__.py": "x = 1\n", "pkg/a b+c%41.py": "caf\xe9"}
    assert sorted(r.path for r in files.scan(spark, root.as_uri()).collect()) == ["pkg/__init__.py", "pkg/a b+c%41.py"]
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(root / "absent"))


def test_manifests(spark, tmp_path):
    (tmp_path / "Cargo.toml").write_text('[dependencies]\nserde = "1"\ntokio = { version = "2", features = [] }\n[dev-dependencies]\nx = "1"\n')
    (tmp_path / "pyproject.toml").write_text('[project]\ndependencies = ["numpy>=1.2", "pandas [all]"]\n')
    (tmp_path / "go.mod").write_text("module m\nrequire (\n  // a comment\n  a.org/b v1\n)\nrequire c.org/d v2\n")
    (tmp_path / "package.json").write_text('{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}')
    rows = {(r.name, r.version) for r in files.manifest_dependencies(spark, str(tmp_path)).collect()}
    assert rows == {("serde", "1"), ("tokio", "2"), ("numpy", None), ("pandas", None), ("a.org/b", "v1"), ("c.org/d", "v2"), ("a", "1"), ("b", "2")}
    (tmp_path / "package.json").write_text("{broken")
    assert files.manifest_dependencies(spark, str(tmp_path / "none")).count() == 0
    assert files.manifest_dependencies(spark, str(tmp_path)).where("manifest = 'package.json'").count() == 0


def test_watched(spark):
    assert column(spark, ["main.rs", "app.py", "component.tsx", "image.png", "video.mp4"], changes.is_watchable) == [True, True, True, False, False]


def test_stream_keeps_up(spark, tmp_path):
    inbox, store = tmp_path / "in", changes.Store(spark, str(tmp_path / "store"))
    inbox.mkdir()

    def send(name, *rows):
        (inbox / name).write_text("".join(json.dumps({"path": p, "content": c, "deleted": d, "ts": t}) + "\n" for p, c, d, t in rows))
        q = changes.keep_up(changes.read(spark, str(inbox)), store, str(tmp_path / "check"), None)
        q.awaitTermination()
        g = store.graph()
        return {r.label for r in g.nodes.where("type <> 'file'").collect()}, g.edges.count()

    assert send("1.json", ("a.py", "class A:\n", False, "2024-01-01T00:00:00Z"), ("b.py", "class B:\n", False, "2024-01-01T00:00:00Z")) == ({"A", "B"}, 2)
    # One file changes twice, one goes, one comes again unchanged.
    assert send("2.json", ("a.py", "class A1:\n", False, "2024-01-01T01:00:00Z"), ("a.py", "class A2:\n", False, "2024-01-01T02:00:00Z"), ("b.py", None, True, "2024-01-01T01:00:00Z")) == ({"A2"}, 1)
    assert send("3.json", ("a.py", "class A2:\n", False, "2024-01-02T00:00:00Z")) == ({"A2"}, 1)
    assert store.version() == 2
    store.apply(spark.createDataFrame([("z.py", "class Z:", False, None)], changes.CHANGES), 1)  # a batch that was applied before
    assert {r.path for r in store.manifest().collect()} == {"a.py"}


def test_store_is_a_build_after_every_batch(spark, tmp_path):
    store = changes.Store(spark, str(tmp_path / "store"))
    there: dict = {}
    batches = [
        [("a.py", "class A:\ndef f(): \n"), ("b.py", "class A:\n"), ("c.md", "# One\n# One\n"), ("x.png", "no")], [("a.py", "class B:\n"), ("b.py", None)], [("b.py", "class A:\n"), ("c.md", "# One\n# One\n")], [("d.py", None)],
    ]

    def look(g):
        return sorted(tuple(r) for r in g.nodes.drop("community_id").collect()), sorted(tuple(r) for r in g.edges.collect())

    for k, batch in enumerate(batches):
        rows = [(p, c, c is None, None) for p, c in batch]
        store.apply(spark.createDataFrame(rows, changes.CHANGES), k)
        for p, c in batch:
            if c is None:
                there.pop(p, None)
            elif p != "x.png":
                there[p] = c
        whole = extract.to_graph(spark.createDataFrame(sorted(there.items()), "path string, content string"), by_syntax=False)
        assert look(store.graph()) == look(whole)
        # What a batch writes is what it changed: the third and the fourth bring one file and none.
        assert spark.read.parquet(f"{tmp_path}/store/b-{k}/touched").count() == (3, 2, 1, 0)[k]
    before = look(store.graph())
    store.compact()
    assert look(store.graph()) == before and store.folders() == {3: "c-3"} and store.version() == 3
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")) == ["c-3", "done-3", "whole-3"]
    store.apply(spark.createDataFrame([("a.py", None, True, None)], changes.CHANGES), 4)
    assert {r.path for r in store.manifest().collect()} == {"b.py", "c.md"}


def test_watching_a_folder(spark, tmp_path):
    root, store = tmp_path / "src", changes.Store(spark, str(tmp_path / "store"))
    root.mkdir()
    (root / "a.py").write_text("class A:\n")
    (root / "b.py").write_text("class B:\n")
    assert changes.look(store, str(root)) and not changes.look(store, str(root))
    (root / "a.py").write_text("class A2:\n")
    (root / "b.py").unlink()
    assert changes.look(store, str(root))
    assert {r.label for r in store.graph().nodes.where("type = 'class'").collect()} == {"A2"}
