"""Unified diffs: touched paths and ranges of added lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "\\": 92, '"': 34}
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_QUOTED = re.compile(r'\\([0-7]{3})|\\([abtnvfr\\"])|([^\\"])')


class DiffError(ValueError):
    """A diff that is truncated, combined, or leads out of its project."""


def file_name(raw: str) -> str:
    """A header's file name: quoted names are unescaped, a time stamp after a tab is cut off."""
    if not raw.startswith('"'):
        return raw.split("\t", 1)[0]
    out, at = bytearray(), 1
    while at < len(raw) and raw[at] != '"':
        m = _QUOTED.match(raw, at)
        if not m or (m[1] and int(m[1], 8) > 255):
            raise DiffError("bad escape in a file name")
        out += bytes([int(m[1], 8)]) if m[1] else bytes([_ESCAPES[m[2]]]) if m[2] else m[3].encode()
        at = m.end()
    if at >= len(raw):
        raise DiffError("unterminated file name")
    try:
        return out.decode()
    except UnicodeDecodeError as e:
        raise DiffError("file name is not UTF-8") from e


def inside(path: str) -> str:
    """The path, if it stays inside the project."""
    parts = path.replace("\\", "/").split("/")
    if not path or path[0] in "/\\" or ".." in parts or any(c in path for c in "\n\r\0") or parts[0].endswith(":"):
        raise DiffError(f"path leaves the project: {path!r}")
    return path


def parse_diff(text: str) -> tuple[set[str], dict[str, list[list[int]]]]:
    """Touched paths, and of each new path the ranges of added lines.

    Only hunk bodies tell what was added: a hunk's header also spans its context.
    """
    paths: set[str] = set()
    added: dict[str, list[list[int]]] = {}
    old = new = None
    left_old = left_new = line = 0
    for row in text.splitlines():
        if row.startswith("\\ No newline"):
            continue
        if left_old or left_new:
            mark = row[:1]
            left_old -= mark in (" ", "-")
            left_new -= mark in (" ", "+")
            if mark not in (" ", "+", "-") or left_old < 0 or left_new < 0:
                raise DiffError("truncated or broken hunk")
            if mark == "+" and new:
                ranges = added.setdefault(new, [])
                if ranges and ranges[-1][1] + 1 == line:
                    ranges[-1][1] = line
                else:
                    ranges.append([line, line])
            line += mark != "-"
        elif row.startswith(("diff --cc ", "diff --combined ")):
            raise DiffError("combined diff")
        elif row.startswith("diff --git "):
            old = new = None
        elif row.startswith(("--- ", "+++ ")):
            name = file_name(row[4:])
            name = None if name == "/dev/null" else inside(name.removeprefix("a/" if row[0] == "-" else "b/"))
            if row[0] == "-":
                old, new = name, None
            else:
                new = name
                if new or old:
                    paths.add(new or old)
        elif row.startswith(("rename to ", "copy to ")):
            new = inside(file_name(row.split(" to ", 1)[1]))
            paths.add(new)
        elif row.startswith("@@"):
            m = _HUNK.match(row)
            if not m or not (old or new):
                raise DiffError("bad hunk header")
            left_old, left_new, line = int(m[2] or 1), int(m[4] or 1), int(m[3])
            if left_new and not line:
                raise DiffError("hunk starts at line 0")
    if left_old or left_new:
        raise DiffError("truncated hunk")
    return paths, added


def diff_ranges(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, start_line, end_line of each diff; a path without added lines has null lines, a bad diff an error instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                try:
                    paths, added = parse_diff(t or "")
                except DiffError as e:
                    rows.append((k, None, None, None, str(e)))
                    continue
                for p in sorted(paths | set(added)):
                    rows += [(k, p, *r, None) for r in added.get(p, [])] or [(k, p, None, None, None)]
            yield pd.DataFrame(rows, columns=[key, "path", "start_line", "end_line", "error"]).astype({"start_line": "Int64", "end_line": "Int64"})

    return diffs.select(key, text).mapInPandas(run, f"`{key}` {diffs.schema[key].dataType.simpleString()}, path string, start_line bigint, end_line bigint, error string")
