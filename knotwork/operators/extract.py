"""Extraction of nodes and edges from source text by patterns, line by line.

A language is a list of rules. All rules of a language run over a line in one projection, so each file is read and split
once, and everything stays in the JVM. Input is files(path, content) and, where order matters, ord.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, file_node_id, file_stem, last_segment, sanitize_id
from ..model import Graph
from ..storage import table

NODE = "struct<id:string,label:string,type:string,metadata:string>"
EDGE = "struct<source:string,target:string,relation:string,context:string,confidence:string,weight:double>"
MARKS = "NOTE|IMPORTANT|HACK|WHY|RATIONALE|TODO|FIXME"
#: ord is a file's number, then a line's, then the place of what was found in it.
PARTS_PER_LINE = 10**6
LINES_PER_FILE = 10**11


@dataclass(frozen=True)
class Context:
    """What a rule knows of the line that it matched."""

    stem: Column
    file_id: Column
    line: Column
    number: Column


Build = Callable[[list[Column], Context], tuple[list[Column], list[Column]]]


@dataclass(frozen=True)
class Rule:
    """A pattern, how many groups of it are used, and what nodes and edges a match makes; null ones are left out.

    lists: its edges come as arrays, as for the names in one import.
    """

    pattern: str
    groups: int
    build: Build
    first_only: bool = False
    lists: bool = False


def node(id_: Column, label: Column, type_: str | Column, metadata: Column | None = None, when: Column | None = None) -> Column:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    made = F.struct(id_.alias("id"), label.alias("label"), kind.alias("type"), (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"))
    return made if when is None else F.when(when, made)


def edge(source: Column, target: Column, relation: str, context: str | Column, confidence: str = "EXTRACTED", weight: float = 1.0, when: Column | None = None) -> Column:
    about = F.lit(context) if isinstance(context, str) else context
    made = F.struct(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), about.alias("context"), F.lit(confidence).alias("confidence"), F.lit(weight).alias("weight"))
    return made if when is None else F.when(when, made)


def _named(c: Context, name: Column) -> Column:
    return F.concat(c.stem, F.lit("_"), name)


def declares(type_: str | Callable[[Context], Column], context: str, skip: tuple[str, ...] = ()) -> Build:
    """A node stem_name in the file."""

    def build(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
        keep = ~g[0].isin(*skip) if skip else None
        id_ = _named(c, g[0])
        return [node(id_, g[0], type_ if isinstance(type_, str) else type_(c), when=keep)], [edge(c.file_id, id_, "contains", context, when=keep)]

    return build


def refers(group: int, relation: str, context: str, last_of: str = "", skip: tuple[str, ...] = ()) -> Build:
    """An edge from the file to a name; with last_of, to what follows the last of these characters."""

    def build(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
        name = F.trim(g[group])
        keep = (name != "") & ~name.isin(*skip) if skip else name != ""
        target = last_segment(F.regexp_replace(name, f"[{last_of}]+$", ""), last_of) if last_of else name
        return [], [edge(c.file_id, sanitize_id(F.trim(target)), relation, context, when=keep)]

    return build


def remark(with_text: bool) -> Build:
    """A rationale node for the file, named by line, with_text also by its first 30 characters."""

    def build(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
        about = F.concat(F.lit("_"), sanitize_id(F.substring(g[0], 1, 30))) if with_text else F.lit("")
        id_ = F.concat(c.stem, about, F.lit("_rationale_"), c.number.cast("string"))
        return [node(id_, F.substring(g[0], 1, 80), "rationale")], [edge(id_, c.file_id, "rationale_for", "rationale")]

    return build


def _python_class(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
    id_ = _named(c, g[0])
    return [node(id_, g[0], "class")], [edge(c.file_id, id_, "contains", "class_definition")]


def _python_bases(g: list[Column], c: Context) -> tuple[list[Column], list[Column | list]]:
    bases = F.filter(F.transform(F.split(g[1], ","), lambda b: F.trim(b)), lambda b: (b != "") & (b != "object"))
    return [], [F.transform(bases, lambda b: edge(_named(c, g[0]), _named(c, sanitize_id(b)), "inherits", "class_inheritance"))]


def _python_import(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
    names = F.filter(F.transform(F.split(g[1], ","), lambda n: F.trim(F.regexp_replace(F.trim(n), r" as .*$", ""))), lambda n: (n != "") & (n != "*"))
    whole = F.array(edge(c.file_id, sanitize_id(g[0]), "imports_from", "import"))
    each = F.transform(names, lambda n: edge(c.file_id, sanitize_id(n), "imports", "import"))
    return [], [F.when(g[0] != "", whole).otherwise(each)]


def _python_call(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
    return [], [edge(_named(c, g[0]), _named(c, g[1]), "calls", "method_call", "INFERRED", 0.7)]


def _rust_kind(c: Context) -> Column:
    line = F.trim(c.line)
    return F.when(line.startswith("pub enum"), "enum").when(line.startswith("pub trait"), "interface").otherwise("class")


def _rust_impl(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
    return [], [edge(_named(c, g[1]), sanitize_id(g[0]), "implements", "impl_trait", when=g[0] != "")]


def _section(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
    id_ = _named(c, F.translate(g[0], ".", "_"))
    return [node(id_, g[0], "class")], [edge(c.file_id, id_, "contains", "section")]


def _heading(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
    level, title = F.length(g[0]), F.trim(g[1])
    id_ = _named(c, sanitize_id(title))
    meta = F.to_json(F.struct(level.alias("level")))
    return [node(id_, title, F.when(level == 1, "class").otherwise("function"), meta)], [edge(c.file_id, id_, "contains", "heading")]


def _link(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
    return [], [edge(c.file_id, sanitize_id(g[0]), "references", g[1], weight=0.5)]


def _wikilink(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
    return [], [edge(c.file_id, sanitize_id(g[0]), "references", "wikilink", weight=0.7)]


def _pdf_heading(g: list[Column], c: Context) -> tuple[list[Column], list[Column]]:
    title = F.trim(g[0])
    keep = (F.octet_length(title) > 5) & ~title.contains("Page") & ~title.contains("stream") & ~title.contains("endobj")
    id_ = sanitize_id(_named(c, F.translate(title, " ", "_")))
    return [node(id_, title, "document", when=keep)], [edge(c.file_id, id_, "contains", "section", when=keep)]


PYTHON = {
    "class": Rule(r"class\s+(\w+)(?:\(([^)]*)\))?\s*:", 1, _python_class),
    "bases": Rule(r"class\s+(\w+)(?:\(([^)]*)\))?\s*:", 2, _python_bases, lists=True),
    "def": Rule(r"(?:async\s+)?def\s+(\w+)\s*\(.*?\)\s*(?:->\s*\S+)?\s*:", 1, declares("function", "function_definition")),
    "import": Rule(r"^(?:from\s+(\S+)\s+)?import\s+(.+)$", 2, _python_import, lists=True),
    "call": Rule(r"(\w+)\.(\w+)\s*\(", 2, _python_call),
    "rationale": Rule(rf"#\s*(?:{MARKS}):\s*(.+)", 1, remark(True)),
}
RUST = {
    "type": Rule(r"pub\s+(?:struct|enum|trait|impl)\s+(\w+)", 1, declares(_rust_kind, "struct_definition")),
    "fn": Rule(r"pub\s+(?:async\s+)?fn\s+(\w+)\s*[<(]", 1, declares("function", "function_definition")),
    "mod": Rule(r"^(?:pub\s+)?mod\s+(\w+)", 1, refers(0, "contains", "module")),
    "use": Rule(r"use\s+(.+?);", 1, refers(0, "imports", "use", ":")),
    "impl": Rule(r"impl\s+(?:(\w+)\s+for\s+)?(\w+)", 2, _rust_impl),
    "rationale": Rule(rf"//\s*(?:{MARKS}):\s*(.+)", 1, remark(False)),
}
JAVASCRIPT = {
    "class": Rule(r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", 1, declares("class", "class")),
    "function": Rule(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", 1, declares("function", "function")),
    "arrow": Rule(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", 1, declares("function", "arrow_function")),
    "import": Rule(r"""import\s+(?:\{[^}]*\}|\w+)\s+from\s+['"]([^'"]+)['"]""", 1, refers(0, "imports_from", "import")),
    "reexport": Rule(r"""export\s+\{[^}]*\}\s+from\s+['"]([^'"]+)['"]""", 1, refers(0, "re_exports", "re-export")),
}
TYPESCRIPT = JAVASCRIPT | {"interface": Rule(r"(?:export\s+)?interface\s+(\w+)", 1, declares("interface", "interface"))}
GO = {
    "struct": Rule(r"type\s+(\w+)\s+struct\s*\{", 1, declares("class", "struct")),
    "interface": Rule(r"type\s+(\w+)\s+interface\s*\{", 1, declares("interface", "interface")),
    "func": Rule(r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(", 1, declares("function", "function", ("init",))),
    "import": Rule(r'import\s+(?:\w+\s+)?"([^"]+)"', 1, refers(0, "imports", "import", "/")),
}
GENERIC = {
    "class": Rule(r"(?:class|struct|object|data\s+class)\s+(\w+)", 1, declares("class", "class")),
    "function": Rule(r"(?:fun|fn|func|function|def|sub)\s+(\w+)\s*\(", 1, declares("function", "function", ("main",))),
    "import": Rule(r"(?:import|require|using|#include|open)\s+(.+?)(?:;|$)", 1, refers(0, "imports", "import", r"./:\\;", ("*",))),
}
TOML = {"section": Rule(r"^\[(.+?)\]", 1, _section, True)}
MARKDOWN = {
    "heading": Rule(r"^(#{1,6})\s+(.+)", 2, _heading, True),
    "link": Rule(r"\[([^\]]+)\]\(([^)]+)\)", 2, _link),
    "wikilink": Rule(r"\[\[([^\]]+)\]\]", 1, _wikilink),
}
PDF = {"heading": Rule(r"^([A-Z][A-Za-z0-9\s\-:]{3,80})$", 1, _pdf_heading, True)}

#: language of nodes, rules and extensions.
LANGUAGES: list[tuple[str, dict[str, Rule], tuple[str, ...]]] = [
    ("Python", PYTHON, ("py", "pyi")), ("Rust", RUST, ("rs",)), ("JavaScript", JAVASCRIPT, ("js", "jsx", "cjs", "mjs")),
    ("TypeScript", TYPESCRIPT, ("ts", "tsx", "mts", "cts")), ("Go", GO, ("go",)), ("TOML", TOML, ("toml",)), ("Markdown", MARKDOWN, ("md", "mdx")), ("PDF", PDF, ("pdf",)),
    *((name, GENERIC, tuple(exts.split())) for name, exts in {
        "Kotlin": "kt kts", "Lua": "lua", "Dart": "dart", "SQL": "sql", "R": "r", "Erlang": "erl", "Vue": "vue", "Apex": "cls trigger", "Blade": "blade", "Razor": "cshtml razor",
        "Pascal": "pas pp", "DreamMaker": "dm dme", "Groovy": "groovy gvy gy gsh", "Svelte": "svelte", "Astro": "astro", "PowerShell": "ps1 psm1 psd1", "Fortran": "f f90 f95 f03 f08",
        "Objective-C": "m mm", "Java": "java", "C": "c h", "C++": "cpp cc cxx hpp hh", "C#": "cs", "PHP": "php", "Ruby": "rb", "Swift": "swift", "Scala": "scala sc", "Zig": "zig",
        "Elixir": "ex exs", "Haskell": "hs", "OCaml": "ml mli", "Bash": "sh bash zsh", "Julia": "jl", "Solidity": "sol", "Verilog": "v sv", "Terraform": "tf hcl",
    }.items()),
]


def _files(files: DataFrame) -> DataFrame:
    # Files without a number come in the order of a hash of their paths.
    order = F.col("ord").cast("decimal(20,0)") if "ord" in files.columns else F.xxhash64("path").cast("decimal(20,0)") + F.lit(Decimal(2**63))
    path = F.col("path")
    return files.where("path is not null").select(
        "path", F.coalesce("content", F.lit("")).alias("content"), (order.cast("decimal(20,0)") * F.lit(Decimal(LINES_PER_FILE * PARTS_PER_LINE))).cast("decimal(38,0)").alias("base"),
        file_node_id(path).alias("file_id"), F.coalesce(F.nullif(file_stem(path), F.lit("")), F.lit("unknown")).alias("stem"), extension(path).alias("ext"),
    )


def lines(files: DataFrame) -> DataFrame:
    """files with a row for each line (number from 1); the end of the last line is not a line."""
    whole = F.regexp_replace("content", r"\r?\n$", "")
    text = files.where("content <> ''").withColumn("__parts", F.split(whole, r"\r?\n"))
    kept = [c for c in files.columns if c != "content"]
    return text.select(*kept, F.posexplode("__parts").alias("at", "line")).withColumn("number", F.col("at") + 1).drop("at")


def _part(rule: Rule, c: Context, side: int, k: int) -> Callable[[Column], Column]:
    """From a match to what the rule makes of it: its k-th node (side 0) or edge (side 1)."""
    return lambda m: rule.build([m[f"g{g}"] for g in range(rule.groups)], c)[side][k]


def _found(rules: dict[str, Rule]) -> tuple[Column, Column]:
    """Arrays of the nodes and of the edges that the rules find in a line, in the rules' order."""
    c = Context(F.col("stem"), F.col("file_id"), F.col("line"), F.col("number"))
    nodes: list[Column] = [F.array().cast(f"array<{NODE}>")]
    edges: list[Column] = [F.array().cast(f"array<{EDGE}>")]
    for rule in rules.values():
        pattern = F.lit("(?U)" + rule.pattern)
        every = [F.regexp_extract_all("line", pattern, F.lit(k + 1)) for k in range(rule.groups)]
        if rule.first_only:
            every = [F.slice(x, 1, 1) for x in every]
        zipped = F.arrays_zip(*(x.alias(f"g{k}") for k, x in enumerate(every)))
        sample_nodes, sample_edges = rule.build([F.lit("") for _ in range(rule.groups)], c)
        nodes += [F.transform(zipped, _part(rule, c, 0, k)).cast(f"array<{NODE}>") for k in range(len(sample_nodes))]
        for k in range(len(sample_edges)):
            made = F.transform(zipped, _part(rule, c, 1, k))
            edges.append((F.flatten(made) if rule.lists else made).cast(f"array<{EDGE}>"))
    drop = lambda x: F.filter(F.concat(*x), lambda s: s.isNotNull())
    return drop(nodes), drop(edges)


def _own(f: DataFrame) -> DataFrame:
    """A node for each file."""
    meta = F.when(F.col("file_type") == "document", F.to_json(F.struct(F.octet_length("content").cast("bigint").alias("file_size_bytes"), F.lit("PDF").alias("format"))))
    return f.select(F.col("file_id").alias("id"), F.col("path").alias("label"), F.col("file_type").alias("type"), F.col("path").alias("source_file"), F.lit(None).cast("string").alias("source_location"), meta.alias("metadata"), "language", F.col("base").alias("ord"))


def _extract(files: DataFrame, groups: list[tuple[Column | None, dict[str, Rule]]], language: Column, file_type: Column) -> tuple[DataFrame, DataFrame]:
    """What the rules of the first group whose condition holds find in each file. Files are read and matched once, into a
    table of what was found, from which nodes and edges are taken."""
    f = _files(files).withColumns({"language": language, "file_type": file_type})
    found = lines(f)
    chosen = None
    for c, rules in groups:
        sides = F.arrays_zip(*(x.alias(n) for n, x in zip(("n", "e"), _found(rules), strict=True)))
        chosen = F.when(c if c is not None else F.lit(True), sides) if chosen is None else chosen.when(c, sides)
    where = F.concat(F.lit("L"), F.col("number").cast("string"))
    parts = found.select("path", "language", "base", "number", where.alias("loc"), F.posexplode(chosen).alias("k", "x"))
    at = (F.col("base") + F.col("number").cast("decimal(11,0)") * F.lit(Decimal(PARTS_PER_LINE)) + F.col("k")).cast("decimal(38,0)")
    parts = table(parts.select("path", "language", "loc", at.alias("ord"), "x.n", "x.e"))
    n = parts.where("n is not null").select(F.col("n.id").alias("id"), F.col("n.label").alias("label"), F.col("n.type").alias("type"), F.col("path").alias("source_file"), F.col("loc").alias("source_location"), F.col("n.metadata").alias("metadata"), "language", "ord")
    e = parts.where("e is not null").select("e.*", F.col("path").alias("source_file"), F.col("loc").alias("source_location"), "ord")
    return _own(f).unionByName(n), e


def extract_with(files: DataFrame, rules: dict[str, Rule], language: str, file_type: str = "file") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that the rules find in files, each file's own node included; nothing is deduplicated."""
    return _extract(files, [(None, rules)], F.lit(language), F.lit(file_type))


def _languages() -> tuple[Column, list[tuple[Column, dict[str, Rule]]]]:
    """The language of a file by its extension, and which rules are for it."""
    members: dict[int, tuple[dict[str, Rule], list[str]]] = {}
    names = []
    ext = F.col("ext")
    for name, rules, exts in LANGUAGES:
        members.setdefault(id(rules), (rules, []))[1].extend(exts)
        names.append(F.when(ext.isin(*exts), F.lit(name)))
    return F.coalesce(*names, F.concat(F.lit("unknown ("), ext, F.lit(")"))), [(ext.isin(*exts), rules) for rules, exts in members.values()]


def _file_type() -> Column:
    return F.when(F.col("ext") == "pdf", "document").otherwise("file")


def file_nodes(files: DataFrame) -> DataFrame:
    """The node of each file alone; a file of an unknown extension has the language `unknown (ext)`."""
    return _own(_files(files).withColumns({"language": _languages()[0], "file_type": _file_type()}))


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files by extension; a file of an unknown one is a lone node, its language `unknown (ext)`."""
    language, groups = _languages()
    return _extract(files, groups, language, _file_type())


def extract_by_syntax(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as extract's, where languages with a syntax (syntax.GRAMMARS) are taken apart by it, over lines and
    without what stands in comments and strings; other files go by patterns."""
    from . import syntax

    structural = extension(F.col("path")).isin(*syntax.EXTENSIONS)
    nodes, edges = extract(files.where(~F.coalesce(structural, F.lit(False))))
    found = table(syntax.found(_files(files.where(structural)).withColumns({"language": _languages()[0]})))
    at = (F.col("base") + F.col("place")).cast("decimal(38,0)").alias("ord")
    where = F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location")
    none = F.lit(None).cast("string")
    n = found.where("kind = 'node'").select("id", "label", "type", F.col("path").alias("source_file"), where, none.alias("metadata"), "language", at)
    e = found.where("kind = 'edge'").select(F.col("id").alias("source"), "target", "relation", "context", F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"), F.col("path").alias("source_file"), where, at)
    return nodes.unionByName(file_nodes(files.where(structural))).unionByName(n), edges.unionByName(e)


def errors(files: DataFrame) -> DataFrame:
    """(path, error) of files that no extractor knows."""
    known = [e for _, _, exts in LANGUAGES for e in exts]
    ext = extension(F.col("path"))
    return files.where(~ext.isin(*known)).select("path", F.concat(F.lit("No extractor for ."), ext, F.lit(" files yet")).alias("error"))


def to_graph(files: DataFrame, project: str = ".", by_syntax: bool = True) -> Graph:
    """The graph of files: by syntax where there is one, or all by patterns."""
    from .build import build_graph

    return build_graph(*(extract_by_syntax if by_syntax else extract)(files), project)
