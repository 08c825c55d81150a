"""License notices in texts, up to some edits.

A notice with at most k edits holds at least one of its k + 1 pieces unchanged (the pigeonhole principle). An automaton
finds all pieces of all notices in one pass; where one is found, bounded-error matching of the regex library verifies the
notice around it and reports its span.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import share

NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL": "licensed under the GNU Lesser General Public License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "subject to the terms of the Mozilla Public License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: A notice may have an edit for every so many of its characters.
CHARS_PER_EDIT = 12
RESULT = "doc_id bigint, license string, start bigint, end bigint, edits bigint, matched string"


def edits_allowed(notice: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return len(notice) // chars_per_edit


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """The notice cut into k + 1 pieces of nearly equal length, with their places."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def folded(text: str) -> str:
    """text in lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Scanner:
    def __init__(self, notices: Mapping[str, str], chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for name, text in sorted(notices.items()):
            low = folded(text or "")
            if not low.strip():
                continue
            k = edits_allowed(low, chars_per_edit)
            fuzzy = regex.compile(f"(?b)(?:{regex.escape(low, literal_spaces=True)}){{e<={k}}}")
            for at, piece in pieces(low, k):
                seeds.setdefault(piece, []).append((len(self.notices), at))
            self.notices.append((name, len(low), k, fuzzy))
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        if seeds:
            self.seeds.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(license, start, end, edits) of the notices in text; of overlapping ones the closest stays."""
        if not self.notices:
            return []
        low = folded(text)
        starts: dict[int, set[int]] = {}
        for last, (length, where) in self.seeds.iter(low):
            for notice, at in where:
                starts.setdefault(notice, set()).add(last + 1 - length - at)
        found = set()
        for notice, places in starts.items():
            name, length, k, fuzzy = self.notices[notice]
            for at in sorted(places):
                m = fuzzy.search(low, max(0, at - k), min(len(low), at + length + k))
                if m:
                    found.add((sum(m.fuzzy_counts), m.start() - m.end(), name, m.start(), m.end()))
        kept: list[tuple[str, int, int, int]] = []
        for edits, _, name, start, end in sorted(found):
            if all(end <= s or start >= e for _, s, e, _ in kept):
                kept.append((name, start, end, edits))
        return sorted(kept, key=lambda x: (x[1], x[0]))


def scan_licenses(docs: DataFrame, notices: Mapping[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(doc_id, license, start, end, edits, matched) of each notice in each text, in characters from 0; end is exclusive.

    A notice counts with at most an edit for every chars_per_edit of its characters, whatever its case. Of spans that
    overlap, the one of fewest edits stays, then the longest, then the first by name. Null and empty texts have none;
    repeated rows are scanned each; rows without doc_id come with a null one. Other columns are not looked at. A notice that
    is null or blank is looked for nowhere; without notices nothing is found.
    """
    shared = share(docs.sparkSession, dict(NOTICES if notices is None else notices))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, chars_per_edit)
        for b in stream:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    rows += [(i, name, start, end, edits, t[start:end]) for name, start, end, edits in scanner.scan(t)]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], ["doc_id", "license", "start", "end", "edits", "matched"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, RESULT)
