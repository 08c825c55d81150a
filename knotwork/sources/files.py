"""Source trees as DataFrames: scanning, classification, package manifests."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..session import ship
from ..storage import table

NOISE = (
    ".git", ".hg", ".svn", ".venv", "venv", "node_modules", "target", "dist", "build", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", ".idea", ".vscode", ".next", "vendor", "coverage",
)
KEPT_HIDDEN = (".graphignore", ".env")
BY_NAME = (
    "Cargo.toml", "package.json", "pyproject.toml", "setup.py", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "Makefile", "CMakeLists.txt", "meson.build", "Dockerfile",
)
_CODE = {
    "Rust": "rs", "Python": "py pyi", "JavaScript": "js jsx cjs", "TypeScript": "ts tsx mts", "Go": "go", "Java": "java", "Kotlin": "kt kts", "Swift": "swift", "Ruby": "rb", "PHP": "php",
    "C": "c h", "C++": "cpp cc hpp", "C#": "cs", "Scala": "scala", "Lua": "lua", "Dart": "dart", "Zig": "zig", "Elixir": "ex exs", "Erlang": "erl", "Haskell": "hs", "OCaml": "ml", "F#": "fs",
    "Vue": "vue", "Svelte": "svelte", "Astro": "astro", "SQL": "sql", "Terraform": "tf hcl", "Bash": "sh bash zsh", "PowerShell": "ps1 psm1", "Julia": "jl", "R": "r", "Objective-C": "m",
    "Objective-C++": "mm", "Solidity": "sol", "Apex": "cls trigger", "Verilog": "v", "SystemVerilog": "sv", "VHDL": "vhd", "Pascal": "p pas", "Fortran": "f90 f95", "DreamMaker": "dm",
}
_OTHER = {
    "Document": {"Markdown": "md mdx", "reStructuredText": "rst", "Text": "txt", "AsciiDoc": "adoc", "Org": "org"},
    "Config": {"JSON": "json", "YAML": "yaml yml", "TOML": "toml", "XML": "xml", "INI": "ini cfg conf", "Env": "env"},
    "Paper": {"PDF": "pdf"},
    "Image": {"Image": "png jpg jpeg gif svg webp ico"},
    "Media": {"Media": "mp4 mov avi wmv mp3 wav ogg webm"},
}
#: (extension, language, category)
KINDS: list[tuple[str, str, str]] = [(e, lang, "Code") for lang, exts in _CODE.items() for e in exts.split()] + [
    (e, lang, category) for category, langs in _OTHER.items() for lang, exts in langs.items() for e in exts.split()
]
MAX_MB = 10


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def classify(paths: DataFrame) -> DataFrame:
    """paths with language and category: by full name if it is a manifest's, otherwise by extension; others go.

    The table of extensions is fixed and small, so it is broadcast.
    """
    spark = paths.sparkSession
    kinds = F.broadcast(spark.createDataFrame(KINDS, "__ext string, __language string, __category string"))
    known = paths.withColumn("__e", extension(F.col("path"))).join(kinds, F.col("__e") == F.col("__ext"), "left")
    manifest = file_name(F.col("path")).isin(*BY_NAME)
    return known.select(
        *(paths[c] for c in paths.columns), F.when(manifest, "Manifest").otherwise(F.col("__language")).alias("language"), F.when(manifest, "Manifest").otherwise(F.col("__category")).alias("category")
    ).where("language is not null")


def is_noise(path: Column) -> Column:
    """Whether some folder of the path is one that builds and tools make."""
    return path.rlike("(^|/)(" + "|".join(n.replace(".", r"\.") for n in NOISE) + ")/")


def open_folder(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, given by path or URI, and the folder's path there."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", root):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


LISTED = "path string, folder boolean, length bigint, modificationTime timestamp"


def _list(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From folders (path relative to root) to what is in them. Links to folders are not followed."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(root)
        local = isinstance(system, fs.LocalFileSystem)
        for b in stream:
            rows = []
            for folder in b["path"]:
                at = f"{base.rstrip('/')}/{folder}".rstrip("/") or "/"
                for f in system.get_file_info(fs.FileSelector(at, allow_not_found=bool(folder))):
                    if f.type == fs.FileType.NotFound or (f.type == fs.FileType.Directory and local and os.path.islink(f.path)):
                        continue
                    rows.append((f"{folder}/{f.base_name}".lstrip("/"), f.type == fs.FileType.Directory, f.size or 0, f.mtime))
            yield pd.DataFrame(rows, columns=["path", "folder", "length", "modificationTime"])

    return run


def _found(spark: SparkSession, root: str, max_mb: int) -> DataFrame:
    """(path, length, modificationTime) of the files below root that count, as a written table.

    Folders are listed a level at a time by all machines, and noise folders are never entered. root may be a path or a URI, and
    names are what they are: no pattern, quoting or coding applies to them.
    """
    ship(spark)
    system, base = open_folder(root)
    if system.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = table(level.mapInPandas(_list(root), LISTED))
        levels.append(listed)
        level = listed.where("folder").select("path").where(~is_noise(F.concat("path", F.lit("/"))))
        if level.isEmpty():
            break
        level = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = file_name(F.col("path"))
    hidden = name.startswith(".") & ~name.isin(*KEPT_HIDDEN)
    return reduce(DataFrame.unionByName, levels).where(~F.col("folder") & ~hidden & (F.col("length") <= max_mb * 1024 * 1024)).drop("folder")


def scan(spark: SparkSession, root: str, max_mb: int = MAX_MB) -> DataFrame:
    """(path, length, modificationTime, language, category) of the files below root, path relative to it.

    Files in noise folders below root, hidden ones and those over max_mb are left out, as are unknown kinds. Contents are not
    read.
    """
    return classify(_found(spark, root, max_mb))


def _text(content: bytes) -> str:
    """UTF-8, or where it is not, Latin-1, in which every byte is a character."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def read(spark: SparkSession, root: str, max_mb: int = MAX_MB, categories: tuple[str, ...] = ("Code",)) -> DataFrame:
    """files(path, content, language) of the categories, path relative to root; only their contents are read, once each. A
    file that goes meanwhile is left out."""
    chosen = scan(spark, root, max_mb).where(F.col("category").isin(*categories)).select("path", "language")

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(root)
        for b in stream:
            for k in range(0, len(b), 64):
                rows = []
                for path, language in b[k : k + 64].itertuples(index=False):
                    try:
                        with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                            rows.append((path, _text(f.read()), language))
                    except FileNotFoundError:
                        continue
                yield pd.DataFrame(rows, columns=["path", "content", "language"])

    return chosen.mapInPandas(run, "path string, content string, language string")


def by_category(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def primary_language(files: DataFrame) -> DataFrame:
    """The commonest language of code files; ties by name."""
    return files.where("category = 'Code'").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(1)


_DEPS = "name string, version string, manifest string"


def _cargo(text: str) -> list[tuple[str, str | None, str]]:
    deps = tomllib.loads(text).get("dependencies", {})
    return [(k, v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None, "Cargo.toml") for k, v in deps.items()]


def _pyproject(text: str) -> list[tuple[str, str | None, str]]:
    out = []
    for d in tomllib.loads(text).get("project", {}).get("dependencies", []):
        end = next((k for k, c in enumerate(d) if c in " =><~^![;"), len(d))
        out.append((d[:end], None, "pyproject.toml"))
    return out


def _go_mod(text: str) -> list[tuple[str, str | None, str]]:
    out, inside = [], False
    for line in (x.strip() for x in text.splitlines()):
        if line.startswith("require ("):
            inside = True
        elif inside and line.startswith(")"):
            inside = False
        elif (inside or line.startswith("require ")) and line and not line.startswith("//"):
            parts = line.removeprefix("require ").split()
            out.append((parts[0], parts[1] if len(parts) > 1 else None, "go.mod"))
    return out


def _package_json(text: str) -> list[tuple[str, str | None, str]]:
    d = json.loads(text)
    return [(k, v if isinstance(v, str) else None, "package.json") for part in ("dependencies", "devDependencies", "peerDependencies") for k, v in (d.get(part) or {}).items()]


_MANIFESTS = {"Cargo.toml": _cargo, "pyproject.toml": _pyproject, "go.mod": _go_mod, "package.json": _package_json}


def manifest_dependencies(spark: SparkSession, root: str) -> DataFrame:
    """(name, version, manifest) of the four manifests in root itself, of any file system; unreadable ones give nothing.
    Comments in go.mod are not dependencies."""
    rows: list[tuple[str, str | None, str]] = []
    system, base = open_folder(root)
    for name, parse in _MANIFESTS.items():
        try:
            with system.open_input_stream(f"{base.rstrip('/')}/{name}") as f:
                rows += parse(f.read().decode("utf-8"))
        except (OSError, ValueError, AttributeError, TypeError):
            continue
    return spark.createDataFrame(rows, _DEPS)
