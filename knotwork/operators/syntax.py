"""Structure of source text: declarations, bases, imports and remarks, over lines and apart from comments and strings.

Python is parsed; other languages are told apart into comments, strings and code first, and declarations are then matched in
the code alone, whatever lines they span. A language is a row of GRAMMARS.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship

RESULT = "path string, language string, base decimal(38,0), place bigint, kind string, id string, label string, type string, target string, relation string, context string, line bigint"
REMARK = re.compile(r"(?:NOTE|TODO|FIXME|HACK|WHY|RATIONALE|IMPORTANT):\s*(.*)", re.S)
#: Words that stand before a parenthesis without being a function's name.
WORDS = frozenset("if for while switch catch return new throw sizeof typeof await yield else do try lock using fixed foreach when match in and or not super this elif with assert delete case until unless".split())
SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
HASH = r"#[^\n]*"
DOUBLE = r'"(?:\\.|[^"\\])*"'
SINGLE = r"'(?:\\.|[^'\\])*'"
#: A character between quotes; elsewhere a quote begins a lifetime or a type variable.
CHARACTER = r"'(?:\\[^'\n]*|[^'\\\n])'"
BACKTICK = r"`(?:\\.|[^`\\])*`"
ARGUMENTS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
#: A name with arguments and a body, as in the languages of C's family.
BODY = rf"(?<![\w.])(\w+)\s*(?:<[^<>(){{}};]*>)?\s*{ARGUMENTS}[\s\w<>\[\],.?&*:@-]*?\{{"
PROTOTYPE = rf"(?<=[\w>*&\]])[\s*&]+(\w+)\s*{ARGUMENTS}\s*(?:const\s*)?;"


@dataclass(frozen=True)
class Grammar:
    """Patterns by what they declare: the first group is the name, the second, if any, the bases."""

    extensions: str
    comments: str = SLASHES
    strings: str = DOUBLE + "|" + CHARACTER
    classes: tuple[str, ...] = ()
    interfaces: tuple[str, ...] = ()
    enums: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    skip: frozenset[str] = field(default=frozenset())


_C = {"functions": (BODY, PROTOTYPE), "imports": (r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]",)}
_BASES = r"(?:\s*<[^<>{]*>)?(?:\s*:\s*([\w\s.,:<>]+?))?\s*(?=\{)"
_EXTENDS = r"(?:\s*<[^<>{]*>)?(?:\s*\([^()]*\))?(?:\s+extends\s+([\w.\\]+))?"
_SCRIPT = {
    "strings": "|".join((DOUBLE, SINGLE, BACKTICK)), "classes": (r"\bclass\s+(\w+)" + _EXTENDS,),
    "functions": (r"\bfunction\b\s*\*?\s*(\w+)", r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=;\n]+)?=", rf"^[ \t]*(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*\*?(\w+)\s*(?:<[^<>()]*>)?{ARGUMENTS}\s*(?::[^{{}};=]+)?\{{"),
    "imports": (r"^[ \t]*import\b[^;'\"\n]*['\"]([^'\"]+)['\"]", r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]"),
}
GRAMMARS: dict[str, Grammar] = {
    "Python": Grammar("py pyi"),
    "Rust": Grammar("rs", classes=(r"\b(?:struct|union)\s+(\w+)",), interfaces=(r"\btrait\s+(\w+)",), enums=(r"\benum\s+(\w+)",), functions=(r"\bfn\s+(\w+)",), imports=(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);",)),
    "JavaScript": Grammar("js jsx cjs mjs", **_SCRIPT),
    "TypeScript": Grammar("ts tsx mts cts", interfaces=(r"\binterface\s+(\w+)",), enums=(r"\benum\s+(\w+)",), **_SCRIPT),
    "Go": Grammar("go", strings="|".join((DOUBLE, CHARACTER, BACKTICK)), classes=(r"\btype\s+(\w+)\s+(?!interface\b)",), interfaces=(r"\btype\s+(\w+)\s+interface\b",), functions=(r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)",), imports=(r"^[ \t]*import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"", r"^[ \t]*(?:(?!import\b)[\w.]+[ \t]+)?\"([^\"\n]+)\"[ \t]*$")),
    "Java": Grammar("java", classes=(r"\b(?:class|record)\s+(\w+)" + _EXTENDS,), interfaces=(r"(?<!@)\binterface\s+(\w+)",), enums=(r"\benum\s+(\w+)",), functions=(BODY, PROTOTYPE), imports=(r"^[ \t]*import\s+(?:static\s+)?([^;]+);",)),
    "C": Grammar("c h", classes=(r"\bstruct\s+(\w+)\s*(?=\{)",), enums=(r"\benum\s+(\w+)\s*(?=\{)",), **_C),
    "C++": Grammar("cpp cc cxx hpp hh", classes=(r"\b(?:class|struct)\s+(\w+)(?:\s+final)?" + _BASES,), enums=(r"\benum\s+(?:class\s+|struct\s+)?(\w+)[^;{]*(?=\{)",), **_C),
    "C#": Grammar("cs", classes=(r"\b(?:class|struct|record)\s+(\w+)" + _BASES,), interfaces=(r"\binterface\s+(\w+)",), enums=(r"\benum\s+(\w+)",), functions=(BODY, PROTOTYPE), imports=(r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;",)),
    "Swift": Grammar("swift", strings=DOUBLE, classes=(r"\b(?:class|struct|actor)\s+(\w+)" + _BASES,), interfaces=(r"\bprotocol\s+(\w+)",), enums=(r"\benum\s+(\w+)",), functions=(r"\bfunc\s+(\w+)",), imports=(r"^[ \t]*import\s+([\w.]+)",)),
    "Scala": Grammar("scala sc", classes=(r"\b(?:class|object)\s+(\w+)" + _EXTENDS,), interfaces=(r"\btrait\s+(\w+)",), enums=(r"\benum\s+(\w+)",), functions=(r"\bdef\s+(\w+)",), imports=(r"^[ \t]*import\s+([\w.]+)",)),
    "Ruby": Grammar("rb", comments=HASH, strings=DOUBLE + "|" + SINGLE, classes=(r"^[ \t]*(?:class|module)\s+(?:\w+::)*(\w+)(?:\s*<\s*([\w:]+))?",), functions=(r"\bdef\s+(?:self\.)?(\w+[?!=]?)",), imports=(r"^[ \t]*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",)),
    "PHP": Grammar("php", comments=SLASHES + "|" + r"#(?!\[)[^\n]*", strings=DOUBLE + "|" + SINGLE, classes=(r"\b(?:class|trait)\s+(\w+)" + _EXTENDS,), interfaces=(r"\binterface\s+(\w+)",), enums=(r"\benum\s+(\w+)",), functions=(r"\bfunction\s+&?(\w+)",), imports=(r"^[ \t]*use\s+([^;({]+);",)),
    "Haskell": Grammar("hs", comments=r"--[^\n]*|\{-.*?(?:-\}|\Z)", classes=(r"^(?:data|newtype)\s+(\w+)",), interfaces=(r"^class\s+(?:[^=\n]*=>\s*)?(\w+)",), functions=(r"^([a-z_][\w']*)\s*::",), imports=(r"^import\s+(?:qualified\s+)?([\w.]+)",)),
    "Julia": Grammar("jl", comments=r"#=.*?(?:=#|\Z)|" + HASH, classes=(r"\b(?:struct|abstract\s+type|primitive\s+type)\s+(\w+)",), functions=(r"\b(?:function|macro)\s+(?:\w+\.)*(\w+!?)",), imports=(r"^[ \t]*(?:using|import)\s+([\w.]+)",)),
    "Bash": Grammar("sh bash zsh", comments=r"(?<![\w$\{])#[^\n]*", strings=DOUBLE + "|'[^']*'", functions=(r"^[ \t]*(?:function\s+)?([\w-]+)\s*\(\s*\)\s*\{", r"^[ \t]*function\s+([\w-]+)\s*\{"), imports=(r"^[ \t]*(?:source|\.)\s+([^\s;]+)",)),
    "Terraform": Grammar("tf hcl", comments=HASH + "|" + SLASHES, strings=r"(?!)", classes=(r"^[ \t]*(?:resource|data)\s+\"[^\"]*\"\s+\"([^\"]+)\"", r"^[ \t]*(?:variable|provider)\s+\"([^\"]+)\""), functions=(r"^[ \t]*(?:module|output)\s+\"([^\"]+)\"",)),
    "Elixir": Grammar("ex exs", comments=HASH, strings=r'"""' + r".*?" + r'"""|' + DOUBLE, classes=(r"^[ \t]*defmodule\s+([\w.]+)",), interfaces=(r"^[ \t]*defprotocol\s+([\w.]+)",), functions=(r"^[ \t]*def(?:p|macro|macrop)?\s+(\w+[?!]?)",), imports=(r"^[ \t]*(?:alias|import|require|use)\s+([\w.]+)",)),
    "Zig": Grammar("zig", comments=r"//[^\n]*", classes=(r"\bconst\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union)\b",), enums=(r"\bconst\s+(\w+)\s*=\s*enum\b",), functions=(r"\bfn\s+(\w+)",), imports=(r"@import\(\"([^\"]+)\"\)",)),
    "OCaml": Grammar("ml mli", comments=r"\(\*.*?(?:\*\)|\Z)", classes=(r"\bmodule\s+(?!type\b)(\w+)",), interfaces=(r"\bmodule\s+type\s+(\w+)",), enums=(r"^[ \t]*type\s+(?:[^=\n]*?\s)?(\w+)\s*=\s*\|?",), functions=(r"\blet\s+(?:rec\s+)?([a-z_]\w*)", r"^[ \t]*val\s+(\w+)"), imports=(r"\bopen\s+([\w.]+)",)),
    "CSS": Grammar("css", comments=r"/\*.*?(?:\*/|\Z)", strings=DOUBLE + "|" + SINGLE, classes=(r"[.#]([A-Za-z_][\w-]*)(?=[^{};]*\{)",), functions=(r"@keyframes\s+([\w-]+)",), imports=(r"@import\s+(?:url\()?['\"]([^'\"]+)['\"]",)),
    "HTML": Grammar("html htm", comments=r"<!--.*?(?:-->|\Z)", strings=r"(?!)", classes=(r"<(?!script\b|style\b)([A-Za-z][\w-]*)",), functions=(r"<(script|style)\b",)),
    "JSON": Grammar("json", comments=r"(?!)", strings=r"(?!)", classes=(r"\"([^\"\n]{1,99})\"\s*:\s*[\[{]",)),
    "YAML": Grammar("yaml yml", comments=r"(?:^|(?<=\s))#[^\n]*", strings=r"(?!)", classes=(r"^[ \t-]*([\w.-]{1,99}):[ \t]*$",)),
    "Solidity": Grammar("sol", strings=DOUBLE + "|" + SINGLE, classes=(r"\b(?:contract|library)\s+(\w+)(?:\s+is\s+([\w\s,.]+?))?\s*(?=\{)",), interfaces=(r"\binterface\s+(\w+)",), enums=(r"\benum\s+(\w+)",), functions=(r"\bfunction\s+(\w+)", r"\b(constructor|fallback|receive)\s*\("), imports=(r"^[ \t]*import\b[^;'\"]*['\"]([^'\"]+)['\"]",)),
    "Verilog": Grammar("v sv", strings=DOUBLE, classes=(r"\bmodule\s+(\w+)",), interfaces=(r"\binterface\s+(\w+)",), functions=(r"\b(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:\s]+?\s)?(\w+)\s*[(;]",), imports=(r"`include\s+\"([^\"]+)\"", r"^[ \t]*import\s+(\w+)::")),
}
EXTENSIONS = tuple(e for g in GRAMMARS.values() for e in g.extensions.split())
_BY_EXTENSION = {e: g for g in GRAMMARS.values() for e in g.extensions.split()}


def _clean(name: str) -> str:
    return re.sub(r"[^\w-]", "_", name)


def _last(name: str) -> str:
    """What follows the last of . / : and \\, without quotes, braces and what an alias says."""
    name = re.sub(r"\s+as\s+\w+\s*$", "", name.strip()).strip("\"'<>{}; \t\n")
    return next((s.strip(" {}*,") for s in reversed(re.split(r"[./:\\]", name)) if s.strip(" {}*,")), "")


class Found:
    """What one file has, in order of place; ids of functions come once."""

    def __init__(self, stem: str, file_id: str):
        self.stem, self.file_id, self.rows, self.ids = stem, file_id, [], set()

    def node(self, name: str, kind: str, line: int, context: str) -> str | None:
        id_ = _clean(f"{self.stem}_{name}")
        if kind == "function" and (name in ("init", "main", "") or id_ in self.ids):
            return None
        self.ids.add(id_)
        self.rows += [("node", id_, name, kind, None, None, None, line), ("edge", self.file_id, None, None, id_, "contains", context, line)]
        return id_

    def base(self, id_: str, name: str, line: int, context: str) -> None:
        name = _last(name)
        if name and name != "object":
            self.rows.append(("edge", id_, None, None, _clean(f"{self.stem}_{name}"), "inherits", context, line))

    def imports(self, name: str, line: int) -> None:
        if "{" in name:
            for each in name[name.index("{") :].strip("{}; \n").split(","):
                self.imports(each, line)
        elif name := _last(name):
            self.rows.append(("edge", self.file_id, None, None, _clean(name), "imports", "import", line))

    def remark(self, text: str, line: int) -> None:
        if (m := REMARK.match(text.strip())) and m[1].strip():
            id_ = _clean(f"{self.stem}_rationale_{line}")
            self.rows += [("node", id_, m[1].strip()[:80], "rationale", None, None, None, line), ("edge", id_, None, None, self.file_id, "rationale_for", "rationale", line)]


def _python(text: str, found: Found) -> None:
    for x in sorted((x for x in ast.walk(ast.parse(text)) if hasattr(x, "lineno")), key=lambda x: (x.lineno, x.col_offset)):
        if isinstance(x, ast.ClassDef):
            id_ = found.node(x.name, "class", x.lineno, "class_definition")
            for b in x.bases:
                found.base(id_, ast.unparse(b), x.lineno, "inheritance")
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            found.node(x.name, "function", x.lineno, "function_definition")
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            found.remark(t.string.lstrip("#"), t.start[0])


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _called(code: str, at: int) -> bool:
    """Whether the name there is called or constructed, not declared: it follows such a word, a comma or a colon."""
    before = re.search(r"(\w+|[^\w\s]|)\s*$", code[max(0, at - 80) : at])[1]
    return before in WORDS or before == "," or (before == ":" and not re.search(r"::\s*$", code[max(0, at - 80) : at]))


def _structure(text: str, g: Grammar, found: Found) -> None:
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    code, spoken, at = [], [], 0
    for m in re.finditer(f"(?P<comment>{g.comments})|(?:{g.strings})", text, re.S | re.M):
        code.append(text[at : m.start()])
        spoken.append(text[at : m.start()])
        code.append(_blank(m[0]))
        spoken.append(_blank(m[0]) if m["comment"] else m[0])
        if m["comment"]:
            found.remark(re.sub(r"^(?://+!?|/\*+|#+=?|--+|\{-|\(\*|<!--)|(?:\*+/|-\}|\*\)|-->|=#)$", "", m[0]), line(m.start()))
        at = m.end()
    code, spoken = "".join(code) + text[at:], "".join(spoken) + text[at:]
    parts = []
    for kind, patterns in (("class", g.classes), ("interface", g.interfaces), ("enum", g.enums), ("function", g.functions)):
        parts += [(m.start(1), kind, m) for p in patterns for m in re.finditer(p, code, re.M)]
    # Where a name is declared in two ways, the first kind counts.
    taken = set()
    for start, kind, m in sorted(parts, key=lambda x: (x[0], ("class", "interface", "enum", "function").index(x[1]))):
        if start in taken or (kind == "function" and (m[1] in WORDS or _called(code, start))):
            continue
        taken.add(start)
        id_ = found.node(m[1], kind, line(start), f"{kind}_declaration")
        if id_ and kind == "class" and m.re.groups > 1 and m[2]:
            for b in m[2].split(","):
                found.base(id_, re.sub(r"<.*", "", b).split()[-1] if b.split() else "", line(start), "extends")
    for p in g.imports:
        for m in re.finditer(p, spoken, re.M):
            if not (p.endswith("$") and "(" not in spoken[: m.start()]):  # a line of a group
                found.imports(m[1], line(m.start()))


def parse(path: str, content: str, stem: str, file_id: str) -> list[tuple]:
    """Rows (kind, id, label, type, target, relation, context, line) of one file; kind error where it can't be parsed."""
    found = Found(stem, file_id)
    g = _BY_EXTENSION[path.rsplit(".", 1)[-1].lower()]
    try:
        if g is GRAMMARS["Python"]:
            _python(content, found)
        else:
            _structure(content, g, found)
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
        found.rows.append(("error", None, str(e), None, None, None, None, None))
    return found.rows


def found(files: DataFrame) -> DataFrame:
    """What files (path, content, stem, file_id, language, base) of GRAMMARS have: rows of kind node and edge, or error; place
    numbers them within their file."""
    ship(files.sparkSession)

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in re.split(r",(?! ?0\))", RESULT)]
        for b in stream:
            rows = [(path, language, base, k, *row) for path, content, stem, file_id, language, base in b.itertuples(index=False) for k, row in enumerate(parse(path, content, stem, file_id))]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content", "stem", "file_id", "language", "base").mapInPandas(run, RESULT)
