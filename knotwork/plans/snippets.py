"""Extraction over small sources in many languages, with the same in SQL.

The tables of a folder hold no source code, so these queries bring their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from ..sources import files
from ..storage import new_path

SNIPPETS: dict[str, str] = {
    "app/service.py": "import os, sys as system\nfrom pathlib import Path\n\nclass Ledger(Base, object, Mixin.Core):\n    def fetch_row(self, k: int) -> dict:\n        # NOTE: users are cached for an hour\n        return self.store.get(k)\n\nasync def main():\n    svc.run(); svc.stop()\n",
    "app/models.py": "class Base:\n    pass\nclass Élève(Base):\n    def nom(self): return self.x\n  import indented\nimport json as j\n# TODO: split this\n",
    "src/service.rs": "use std::collections::HashMap;\nuse crate::db;\nmod inner;\npub mod outer;\npub struct Ledger {\n}\npub enum Kind { A }\npub trait Store {}\nimpl Store for Ledger {\n  pub async fn fetch_row(&self) {}\n  pub fn put<T>(&self) {}\n}\n// NOTE: keep the lock short\n",
    "web/App.js": "import React from 'react'\nimport { useState } from \"react\"\nexport { helper } from './util'\nexport class App {\n  render() {}\n}\nexport async function load(x) {}\nconst handleClick = async (e) => { }\n",
    "web/types.ts": "export interface Shape { }\nabstract class Base {}\nexport class Circle {}\nfunction area(s) {}\n",
    "pkg/service.go": "package pkg\nimport \"net/http\"\nimport f \"fmt\"\ntype Ledger struct {\n}\ntype Store interface {\n}\nfunc (s *Ledger) FetchRow(id int) {\n}\nfunc init() {\n}\nfunc helper() {}\n",
    "lib/Main.kt": "import kotlin.io.path\ndata class User(val n: String)\nobject Cache\nfun load(x: Int) {}\nfun main() {}\n",
    "lib/query.lua": "local m = require 'a.b'\nfunction greet(name)\nend\n",
    "conf/Settings.toml": "[package]\nname = 'x'\n[tool.lint]\n  [indented]\n",
    "docs/guide.md": "# Guide\n\n## Set up\nSee [the site](https://example.org/a) and [[Other Page]].\r\n### Deeper still\nno heading # here\n",
    "notes/paper.pdf": "%PDF-1.4\nIntroduction to Graphs\nChapter One: Getting Started\nstream\nendobj\nPage 1\nlower case\n",
    "misc/data.xyz": "class Nothing:\n",
    "empty.py": "",
    "tail.py": "class Tail: pass",
}


def source_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c, k) for k, (p, c) in enumerate(SNIPPETS.items())], "path string, content string, ord bigint")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


VALUES = "snippets(path, content) AS (VALUES " + ", ".join(f"({_quoted(p)}, {_quoted(c)})" for p, c in SNIPPETS.items()) + ")"
#: Lines with their number; a file's parent and stem give its names.
LINES = r"""
WITH {values},
files AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, regexp_extract(path, '([^/]+)/[^/]*$', 1) AS parent, lower(regexp_extract(path, '\.([^./]*)$', 1)) AS ext FROM snippets),
named AS (SELECT *, CASE WHEN parent = '' THEN stem ELSE parent || '_' || stem END AS file_id FROM files),
lines AS (SELECT path, stem, file_id, ext, n, rtrim(parts[n], chr(13)) AS line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT *, string_split(content, chr(10)) AS parts FROM named)))
""".format(values=VALUES)


def _sql(body: str) -> str:
    return LINES + body


def _word(pattern: str) -> str:
    return pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''")


def _matches(ext: str, pattern: str, group: int = 1) -> str:
    return f"(SELECT *, unnest(regexp_extract_all(line, '{_word(pattern)}', {group})) AS g FROM lines WHERE ext IN ({', '.join(map(_quoted, ext.split()))}))"


def _node(ext: str, pattern: str, kind: str, skip: str = "", id_: str = "stem || '_' || g") -> str:
    where = f" WHERE g NOT IN ({skip})" if skip else ""
    return f"SELECT path, {id_} AS id, g AS label, '{kind}' AS type, 'L' || n AS loc FROM {_matches(ext, pattern)}{where}"


CLEAN = r"regexp_replace({}, '[^\p{{L}}\p{{N}}_-]', '_', 'g')"


def _edge(ext: str, pattern: str, relation: str, context: str, group: int = 1, target: str = "g", source: str = "file_id", where: str = "true", weight: str = "1.0") -> str:
    return f"SELECT path, {source} AS source, {target} AS target, '{relation}' AS relation, {context} AS context, {weight}::DOUBLE AS weight FROM {_matches(ext, pattern, group)} WHERE {where}"


def _nodes(rules: dict, language: str, paths: list[str], pick: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, _: str) -> DataFrame:
        chosen = {k: rules[k] for k in pick}
        n, _e = extract.extract_with(source_files(spark).where(F.col("path").isin(*paths)), chosen, language)
        return n.where("source_location is not null").select(F.col("source_file").alias("path"), "id", "label", "type", F.col("source_location").alias("loc"))

    return run


def _edges(rules: dict, language: str, paths: list[str], pick: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, _: str) -> DataFrame:
        chosen = {k: rules[k] for k in pick}
        _n, e = extract.extract_with(source_files(spark).where(F.col("path").isin(*paths)), chosen, language)
        return e.select(F.col("source_file").alias("path"), "source", "target", "relation", "context", "weight")

    return run


def _of(*exts: str) -> list[str]:
    return [p for p in SNIPPETS if p.rsplit(".", 1)[-1] in exts]


def _dispatch(spark: SparkSession, _: str) -> DataFrame:
    return extract.file_nodes(source_files(spark)).select("id", F.col("source_file").alias("path"), "language", "type")


def _classified(spark: SparkSession, _: str) -> DataFrame:
    return files.classify(source_files(spark).select("path").unionByName(spark.createDataFrame([("A.PY",), ("x/Cargo.toml",), ("setup.py",), ("x.unknown",), ("img/a.PNG",)], "path string")))


_TEXT = r"regexp_extract(g, '\[([^\]]+)\]', 1)"
PY, RS, JS, GO, GEN = "py", "rs", "js ts", "go", "kt lua"
_IMPORT = r"^(?:from\s+(\S+)\s+)?import\s+(.+)$"

#: Sources whose declarations span lines, or stand in comments and strings where they are none.
STRUCTURED: dict[str, str] = {
    "app/Till.java": 'import java.util.List;\n/* class Not {} */\nclass Till extends base.Store {\n  // NOTE: keep\n  String s = "class Fake {";\n  <T> List<T>\n  rows(int id,\n    Map<String, List<T>> m) throws E { if (x) { go(); } return new Bar() { }; }\n}\ninterface Shelf {}\nenum Coin { A }\n',
    "lib/heap.c": '#include "my/x.h"\nstruct heap { int a; };\nint peek(int a);\nstatic int *\npush(int a,\n char *b)\n{ for (;;) { } return foo(a); }\n',
    "lib/Grid.hpp": "class Grid : public Base, private ns::Cell { public: Grid(int x) : y(x) { } void run() const { } };\n",
    "app/shop.rb": 'require "json"\nclass Shop < Base\n  # TODO: it\n  def self.make!; end\nend\n',
    "net/dial.go": 'import (\n  "net/http"\n  f "fmt"\n)\ntype Dial struct {\n}\ntype Line interface {\n}\nfunc (s *Dial) Ring(\n id int) {\n}\nfunc init() {}\n',
    "web/Board.ts": "import { a } from './x/util'\nabstract class Board<T> extends React.Component<T> {\n  draw(): void { if (a) { } }\n}\nconst go = async (e) => { }\nenum Hue {A}\n",
    "src/node.rs": "use std::collections::{HashMap, HashSet};\npub struct Node<'a> { x: &'a str }\ntrait Walk { fn step(&self); }\nfn long(\n a: u8,\n) {}\n",
    "app/job.py": "class Job(base.Task, object):\n  async def run(self,\n     x): pass\n# WHY: hi\ndef main(): pass\n",
}
_STRUCTURE = "Till Till class 3,Till keep rationale 4,Till rows function 7,Till Shelf interface 10,Till Coin enum 11,heap heap class 2,heap peek function 3,heap push function 5,Grid Grid class 1,Grid run function 1,shop Shop class 2,shop it rationale 3,shop make! function 4,dial Dial class 5,dial Line interface 7,dial Ring function 9,Board Board class 2,Board draw function 3,Board go function 5,Board Hue enum 6,node Node class 2,node Walk interface 3,node step function 3,node long function 4,job Job class 1,job run function 2,job hi rationale 4"
_LINKS = "app_Till imports List 1,Till_Till inherits Till_Store 3,lib_heap imports h 1,Grid_Grid inherits Grid_Base 1,Grid_Grid inherits Grid_Cell 1,app_shop imports json 1,shop_Shop inherits shop_Base 2,net_dial imports http 2,net_dial imports fmt 3,web_Board imports util 1,Board_Board inherits Board_Component 2,src_node imports HashMap 1,src_node imports HashSet 1,job_Job inherits job_Task 1"


def _values(rows: str, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r.split(" "))) + ")" for r in rows.split(",")) + f") x({columns})"


def _structured(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return extract.extract_by_syntax(spark.createDataFrame([(p, c, k) for k, (p, c) in enumerate(STRUCTURED.items())], "path string, content string, ord bigint"))


def _structured_nodes(spark: SparkSession, _: str) -> DataFrame:
    return _structured(spark)[0].where("source_location is not null").select("id", "label", "type", F.col("source_location").alias("loc"))


def _structured_edges(spark: SparkSession, _: str) -> DataFrame:
    return _structured(spark)[1].where("relation in ('imports', 'inherits')").select("source", "relation", "target", F.col("source_location").alias("loc"))


MANIFESTS: dict[str, str] = {
    "Cargo.toml": '[dependencies]\nserde = "1"\ntokio = { version = "2" }\n', "pyproject.toml": '[project]\ndependencies = ["numpy>=1.2", "pandas [all]"]\n', "go.mod": "module m\nrequire (\n  // a comment\n  a.org/b v1\n)\n", "package.json": '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}',
}
MORE = MANIFESTS | {"pkg/__init__.py": "x = 1\n", "img/a.PNG": "x"}
LEFT_OUT = {"build/out.py": "x", "node_modules/m/i.js": "x", ".hidden.py": "x"}


def _tree(spark: SparkSession) -> str:
    """The snippets, manifests and what is to be left out, written as a folder of files."""
    root = new_path(spark, "tree-")
    system, base = files.open_folder(root)
    for path, content in (SNIPPETS | MORE | LEFT_OUT).items():
        system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{base}/{path}") as f:
            f.write(content.encode())
    return root


def _scanned(spark: SparkSession, _: str) -> DataFrame:
    return files.scan(spark, _tree(spark)).select("path", "language", "category", "length")


def _read(spark: SparkSession, _: str) -> DataFrame:
    return files.read(spark, _tree(spark)).select("path", "content", "language")


def _counted(spark: SparkSession, _: str) -> DataFrame:
    found = files.scan(spark, _tree(spark))
    return files.by_category(found).select("category", "n").unionByName(files.primary_language(found).select(F.concat(F.lit("primary: "), "language").alias("category"), "n"))


def _dependencies(spark: SparkSession, _: str) -> DataFrame:
    return files.manifest_dependencies(spark, _tree(spark))


_KINDS = "SELECT path, language, category, octet_length(encode(content)) AS length, content FROM (SELECT path, content, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM snippets UNION ALL SELECT 'pkg/__init__.py', 'x = 1' || chr(10), 'py' UNION ALL SELECT 'img/a.PNG', 'x', 'PNG') JOIN (VALUES ('py', 'Python', 'Code'), ('rs', 'Rust', 'Code'), ('js', 'JavaScript', 'Code'), ('ts', 'TypeScript', 'Code'), ('go', 'Go', 'Code'), ('kt', 'Kotlin', 'Code'), ('lua', 'Lua', 'Code'), ('toml', 'TOML', 'Config'), ('md', 'Markdown', 'Document'), ('pdf', 'PDF', 'Paper'), ('PNG', 'Image', 'Image')) k(ext, language, category) USING (ext)"
_MANIFESTS = "SELECT path, 'Manifest', 'Manifest', n FROM (VALUES " + ", ".join(f"('{p}', {len(c)})" for p, c in MANIFESTS.items()) + ") m(path, n)"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "extract_py_class": (_nodes(extract.PYTHON, "Python", _of("py"), ("class",)), _sql(_node(PY, r"class\s+(\w+)(?:\([^)]*\))?\s*:", "class"))),
    "extract_py_def": (_nodes(extract.PYTHON, "Python", _of("py"), ("def",)), _sql(_node(PY, r"(?:async\s+)?def\s+(\w+)\s*\(.*?\)\s*(?:->\s*\S+)?\s*:", "function"))),
    "extract_py_bases": (_edges(extract.PYTHON, "Python", _of("py"), ("bases",)), _sql(
        rf"SELECT path, stem || '_' || c AS source, stem || '_' || {CLEAN.format('b')} AS target, 'inherits' AS relation, 'class_inheritance' AS context, 1.0::DOUBLE AS weight FROM (SELECT path, stem, regexp_extract(g, '^class\s+([\p{{L}}\p{{N}}_]+)', 1) AS c, trim(unnest(string_split(regexp_extract(g, '\(([^)]*)\)', 1), ','))) AS b FROM {_matches(PY, r'(class\s+\w+(?:\([^)]*\))?\s*:)')}) WHERE b NOT IN ('', 'object')"
    )),
    "extract_py_import": (_edges(extract.PYTHON, "Python", _of("py"), ("import",)), _sql(
        f"SELECT path, file_id AS source, {CLEAN.format('m')} AS target, 'imports_from' AS relation, 'import' AS context, 1.0::DOUBLE AS weight FROM (SELECT *, regexp_extract(line, '{_IMPORT}', 1) AS m FROM lines WHERE ext = 'py') WHERE m <> '' "
        f"UNION ALL SELECT path, file_id, {CLEAN.format('i')}, 'imports', 'import', 1.0 FROM (SELECT *, trim(regexp_replace(trim(unnest(string_split(regexp_extract(line, '{_IMPORT}', 2), ','))), ' as .*$', '')) AS i FROM lines WHERE ext = 'py' AND regexp_extract(line, '{_IMPORT}', 1) = '') WHERE i NOT IN ('', '*')"
    )),
    "extract_py_calls": (_edges(extract.PYTHON, "Python", _of("py"), ("call",)), _sql(
        rf"SELECT path, stem || '_' || regexp_extract(g, '^([\p{{L}}\p{{N}}_]+)\.', 1) AS source, stem || '_' || regexp_extract(g, '\.([\p{{L}}\p{{N}}_]+)', 1) AS target, 'calls' AS relation, 'method_call' AS context, 0.7::DOUBLE AS weight FROM {_matches(PY, r'(\w+\.\w+)\s*\(')}"
    )),
    "extract_rationale": (_nodes(extract.PYTHON, "Python", _of("py"), ("rationale",)), _sql(
        f"SELECT path, stem || '_' || {CLEAN.format('g[1:30]')} || '_rationale_' || n AS id, g[1:80] AS label, 'rationale' AS type, 'L' || n AS loc FROM {_matches(PY, r'#\s*(?:NOTE|IMPORTANT|HACK|WHY|RATIONALE|TODO|FIXME):\s*(.+)')}"
    )),
    "extract_rust": (_nodes(extract.RUST, "Rust", _of("rs"), ("type", "fn", "rationale")), _sql(
        f"SELECT path, stem || '_' || g AS id, g AS label, CASE WHEN trim(line) LIKE 'pub enum%' THEN 'enum' WHEN trim(line) LIKE 'pub trait%' THEN 'interface' ELSE 'class' END AS type, 'L' || n AS loc FROM {_matches(RS, r'pub\s+(?:struct|enum|trait|impl)\s+(\w+)')} "
        f"UNION ALL {_node(RS, r'pub\s+(?:async\s+)?fn\s+(\w+)\s*[<(]', 'function')} UNION ALL SELECT path, stem || '_rationale_' || n, g, 'rationale', 'L' || n FROM {_matches(RS, r'//\s*(?:NOTE|TODO):\s*(.+)')}"
    )),
    "extract_rust_edges": (_edges(extract.RUST, "Rust", _of("rs"), ("mod", "use", "impl")), _sql(
        f"{_edge(RS, r'^(?:pub\s+)?mod\s+(\w+)', 'contains', _quoted('module'))} UNION ALL {_edge(RS, r'use\s+(.+?);', 'imports', _quoted('use'), target="regexp_extract(g, '([^:]*)$', 1)")} "
        f"UNION ALL SELECT path, stem || '_' || regexp_extract(g, 'for\\s+(.*)$', 1), regexp_extract(g, '^(\\S+)', 1), 'implements', 'impl_trait', 1.0 FROM {_matches(RS, r'impl\s+(\w+\s+for\s+\w+)')}"
    )),
    "extract_js": (
        _nodes(extract.TYPESCRIPT, "TypeScript", _of("js", "ts"), ("class", "function", "arrow", "interface")), _sql(
            f"{_node(JS, r'class\s+(\w+)', 'class')} UNION ALL {_node(JS, r'function\s+(\w+)\s*\(', 'function')} UNION ALL {_node(JS, r'(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>', 'function')} UNION ALL {_node(JS, r'interface\s+(\w+)', 'interface')}"
        )),
    "extract_js_edges": (_edges(extract.JAVASCRIPT, "JavaScript", _of("js"), ("import", "reexport")), _sql(
        _edge("js", r"""import\s+(?:\{[^}]*\}|\w+)\s+from\s+['"]([^'"]+)['"]""", "imports_from", "'import'", target=CLEAN.format("g")) + " UNION ALL " + _edge("js", r"""export\s+\{[^}]*\}\s+from\s+['"]([^'"]+)['"]""", "re_exports", "'re-export'", target=CLEAN.format("g"))
    )),
    "extract_go": (_nodes(extract.GO, "Go", _of("go"), ("struct", "interface", "func")), _sql(
        f"{_node(GO, r'type\s+(\w+)\s+struct\s*\{', 'class')} UNION ALL {_node(GO, r'type\s+(\w+)\s+interface\s*\{', 'interface')} UNION ALL {_node(GO, r'func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(', 'function', _quoted('init'))}"
    )),
    "extract_go_imports": (_edges(extract.GO, "Go", _of("go"), ("import",)), _sql(_edge(GO, r'import\s+(?:\w+\s+)?"([^"]+)"', "imports", "'import'", target="regexp_extract(g, '([^/]*)$', 1)"))),
    "extract_generic": (_nodes(extract.GENERIC, "Kotlin", _of("kt", "lua"), ("class", "function")), _sql(
        f"{_node(GEN, r'(?:class|struct|object|data\s+class)\s+(\w+)', 'class')} UNION ALL {_node(GEN, r'(?:fun|fn|func|function|def|sub)\s+(\w+)\s*\(', 'function', _quoted('main'))}"
    )),
    "extract_toml": (_nodes(extract.TOML, "TOML", _of("toml"), ("section",)), _sql(_node("toml", r"^\[(.+?)\]", "class", id_="stem || '_' || replace(g, '.', '_')"))),
    "extract_markdown": (_nodes(extract.MARKDOWN, "Markdown", _of("md"), ("heading",)), _sql(
        rf"SELECT path, stem || '_' || {CLEAN.format('t')} AS id, t AS label, CASE WHEN h = '#' THEN 'class' ELSE 'function' END AS type, 'L' || n AS loc FROM (SELECT *, regexp_extract(line, '^(#{{1,6}})\s+(.+)', 1) AS h, trim(regexp_extract(line, '^(#{{1,6}})\s+(.+)', 2)) AS t FROM lines WHERE ext = 'md') WHERE h <> ''"
    )),
    "extract_markdown_links": (_edges(extract.MARKDOWN, "Markdown", _of("md"), ("link", "wikilink")), _sql(
        rf"SELECT path, file_id AS source, {CLEAN.format(_TEXT)} AS target, 'references' AS relation, regexp_extract(g, '\(([^)]+)\)', 1) AS context, 0.5::DOUBLE AS weight FROM {_matches('md', r'(\[[^\]]+\]\([^)]+\))')} UNION ALL "
        + _edge("md", r"\[\[([^\]]+)\]\]", "references", "'wikilink'", target=CLEAN.format("g"), weight="0.7")
    )),
    "extract_headings": (_nodes(extract.PDF, "PDF", _of("pdf"), ("heading",)), _sql(
        f"SELECT path, {CLEAN.format('stem || $$_$$ || g')} AS id, g AS label, 'document' AS type, 'L' || n AS loc FROM {_matches('pdf', r'^([A-Z][A-Za-z0-9\s\-:]{3,80})$')} WHERE octet_length(encode(g)) > 5 AND NOT contains(g, 'Page') AND NOT contains(g, 'stream') AND NOT contains(g, 'endobj')"
    )),
    "extract_dispatch": (_dispatch, _sql(
        "SELECT file_id AS id, path, coalesce(language, 'unknown (' || ext || ')') AS language, CASE WHEN ext = 'pdf' THEN 'document' ELSE 'file' END AS type FROM named LEFT JOIN (VALUES ('py', 'Python'), ('rs', 'Rust'), ('js', 'JavaScript'), ('ts', 'TypeScript'), ('go', 'Go'), ('kt', 'Kotlin'), ('lua', 'Lua'), ('toml', 'TOML'), ('md', 'Markdown'), ('pdf', 'PDF')) k(ext, language) USING (ext)"
    )),
    "extract_syntax": (_structured_nodes, "SELECT CASE WHEN type = 'rationale' THEN stem || '_rationale_' || line ELSE stem || '_' || replace(name, '!', '_') END AS id, name AS label, type, 'L' || line AS loc FROM " + _values(_STRUCTURE, "stem, name, type, line")),
    "extract_syntax_links": (_structured_edges, "SELECT source, relation, target, 'L' || line AS loc FROM " + _values(_LINKS, "source, relation, target, line")),
    "scan_files": (_scanned, _sql(f"SELECT path, language, category, length FROM ({_KINDS}) UNION ALL {_MANIFESTS}")),
    "read_files": (_read, _sql(f"SELECT path, content, language FROM ({_KINDS}) WHERE category = 'Code'")),
    "files_by_category": (_counted, _sql(f"SELECT category, count(*) AS n FROM ({_KINDS}) GROUP BY 1 UNION ALL SELECT 'Manifest', 4 UNION ALL (SELECT 'primary: ' || language, count(*) AS n FROM ({_KINDS}) WHERE category = 'Code' GROUP BY language ORDER BY n DESC, language LIMIT 1)")),
    "manifest_dependencies": (_dependencies, "SELECT name, version, manifest FROM (VALUES ('serde', '1', 'Cargo.toml'), ('tokio', '2', 'Cargo.toml'), ('numpy', NULL, 'pyproject.toml'), ('pandas', NULL, 'pyproject.toml'), ('a.org/b', 'v1', 'go.mod'), ('a', '1', 'package.json'), ('b', '2', 'package.json')) d(name, version, manifest)"),
    "classify_files": (_classified, _sql(
        "SELECT path, CASE WHEN m THEN 'Manifest' ELSE language END AS language, CASE WHEN m THEN 'Manifest' ELSE category END AS category FROM (SELECT path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext, regexp_extract(path, '([^/]*)$', 1) IN ('Cargo.toml', 'setup.py') AS m FROM (SELECT path FROM snippets UNION ALL SELECT unnest(['A.PY', 'x/Cargo.toml', 'setup.py', 'x.unknown', 'img/a.PNG']))) "
        "LEFT JOIN (VALUES ('py', 'Python', 'Code'), ('rs', 'Rust', 'Code'), ('js', 'JavaScript', 'Code'), ('ts', 'TypeScript', 'Code'), ('go', 'Go', 'Code'), ('kt', 'Kotlin', 'Code'), ('lua', 'Lua', 'Code'), ('toml', 'TOML', 'Config'), ('md', 'Markdown', 'Document'), ('pdf', 'PDF', 'Paper'), ('png', 'Image', 'Image')) k(ext, language, category) USING (ext) WHERE m OR language IS NOT NULL"
    )),
}
