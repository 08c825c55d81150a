"""Identifiers and symbols. Patterns spell out Unicode classes, so they mean the same in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_id(s: Column) -> Column:
    """Everything but letters, numbers, _ and - becomes _."""
    return F.regexp_replace(s, r"[^\p{L}\p{N}_-]", "_")


def file_stem(path: Column) -> Column:
    """The file's name without its last extension; a name that only begins with a dot keeps it."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def file_node_id(path: Column) -> Column:
    """parent_stem, or stem where there is no parent folder."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return sanitize_id(F.when(parent.isin("", ".", ".."), file_stem(path)).otherwise(F.concat(parent, F.lit("_"), file_stem(path))))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def normalize_symbol(s: Column) -> Column:
    """Without surrounding space, quotes, commas and semicolons; in lower case."""
    return F.lower(F.trim(F.btrim(F.trim(s), F.lit("\"',;"))))


def last_segment(s: Column, separators: str) -> Column:
    """What follows the last of the separators, a regex class."""
    return F.regexp_extract(s, f"([^{separators}]*)$", 1)
