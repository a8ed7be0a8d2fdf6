"""Path, name and subject functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Layers by any lower-case path segment (the first that matches counts), their colours and their ranks.
LAYERS = {
    "Interface": ["api", "cli", "controller", "controllers", "handler", "handlers", "http", "route", "routes", "ui", "web"],
    "Application": ["app", "application", "command", "commands", "service", "services", "use_case", "use_cases", "workflow", "workflows"],
    "Domain": ["core", "domain", "entity", "entities", "model", "models"],
    "Infrastructure": ["adapter", "adapters", "database", "db", "file", "fs", "infra", "infrastructure", "io", "persistence", "repository", "storage"],
    "Tests": ["spec", "specs", "test", "tests"],
}
LAYER_COLORS = {"Entrypoint": "#dcdcaa", "Interface": "#569cd6", "Application": "#d7ba7d", "Domain": "#4ec9b0", "Infrastructure": "#c586c0", "Tests": "#9cdcfe"}
OTHER_COLOR = "#808080"
LAYER_RANKS = {"Interface": 4, "Application": 3, "Infrastructure": 3, "Domain": 2}
# Words of a subject that speak of a defect (history) or of an outcome.
DEFECT_WORDS = ["bug", "bugs", "bugfix", "fix", "fixes", "fixed", "defect", "defects", "regression", "regressions", "panic", "crash"]
OUTCOME_WORDS = {
    "defect": ["bug", "bugfix", "defect", "fix", "fixed", "panic", "crash", "regression"],
    "revert": ["revert", "rollback"],
    "security": ["security", "vulnerability"],
}
SECURITY_PREFIXES = ["cve-", "rustsec-"]
# Words that token normalisation keeps, and the pattern of a token (other characters are none).
KEYWORDS = ["fn", "let", "pub", "struct", "enum", "impl", "if", "match", "for", "while", "loop", "use", "mod", "return", "Self", "self"]
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|::|->|=>|==|!=|<=|>=|&&|\|\||[{}()\[\];,.:+\-*/%&|^!<>=?]"

FNV_PRIME, FNV_BASIS, FNV_BASIS_ARTIFACT = 1099511628211, 0xCBF29CE484222325, 1469598103934665603


def _texts(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, words))


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def is_defect_subject(subject: Column) -> Column:
    return F.arrays_overlap(words(subject), _texts(DEFECT_WORDS))


def outcome_kinds(subject: Column) -> Column:
    """Array of defect, revert and security, in this order."""
    own, low = words(subject), F.lower(subject)
    advisory = F.lit(False)
    for prefix in SECURITY_PREFIXES:
        advisory = advisory | low.contains(prefix)
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(own, _texts(w)) | (advisory if kind == "security" else F.lit(False)), F.lit(kind)) for kind, w in OUTCOME_WORDS.items())))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_to(path: Column, root: str) -> Column:
    """The path below root; other paths as they are."""
    root = root.rstrip("/") + "/"
    return F.when(slashes(path).startswith(root), F.substring(slashes(path), len(root) + 1, 1 << 30)).otherwise(slashes(path))


def segments(path: Column) -> Column:
    return F.split(F.lower(slashes(path)), r"/|::")


def layer(path: Column) -> Column:
    """The first layer, in the order of LAYERS, with a needle among the path's segments."""
    own, found = segments(path), None
    for name, needles in LAYERS.items():
        hit = F.arrays_overlap(own, _texts(needles))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.when(path.isNotNull(), "Unclassified")


def module_layer(module_key: Column, is_entrypoint: Column) -> Column:
    """The layer of a module by its readable key; entrypoints are a layer of their own."""
    return F.when(F.coalesce(is_entrypoint, F.lit(False)), "Entrypoint").otherwise(layer(module_key))


def layer_color(name: Column) -> Column:
    colors = F.create_map(*(F.lit(x) for pair in LAYER_COLORS.items() for x in pair))
    return F.coalesce(F.try_element_at(colors, name), F.lit(OTHER_COLOR))


def layer_rank(name: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in LAYER_RANKS.items() for x in pair))
    return F.try_element_at(ranks, name)


def module_key(path: Column) -> Column:
    """module::path of a source file below its src root: without .rs, mod and the root itself."""
    inner = F.regexp_replace(F.regexp_replace(slashes(path), r"^(?:.*/)?src/", ""), r"\.rs$", "")
    return F.array_join(F.filter(F.split(inner, "/"), lambda s: (s != "mod") & (s != "")), "::")


def path_module_key(path: Column) -> Column:
    """The simpler rule for repository-relative paths: what follows src/, without .rs and a last mod; elsewhere the file's stem."""
    path = slashes(path)
    inner = F.regexp_replace(F.regexp_replace(F.substring(path, 5, 1 << 30), r"(\.rs)+$", ""), r"(/mod)+$", "")
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.when(path.startswith("src/"), F.replace(inner, F.lit("/"), F.lit("::"))).otherwise(stem)


def is_test_path(path: Column) -> Column:
    path = slashes(path)
    return path.startswith("tests/") | path.contains("/tests/") | path.startswith("benches/") | path.startswith("examples/") | path.rlike(r"(^|/)(tests?\.rs|[^/]*_tests\.rs)$")


def is_test_module(module: Column) -> Column:
    return F.exists(F.split(module, "::"), lambda s: s.isin("test", "tests") | s.endswith("_tests"))


def test_kind(path: Column) -> Column:
    path = slashes(path)
    return F.when(path.startswith("tests/"), "integration").when(path.startswith("benches/"), "benchmark").when(path.startswith("examples/"), "example").when(path.startswith("src/bin/"), "binary").when(path.isNotNull(), "inline")


def matches_pattern(path: Column, pattern: Column) -> Column:
    """Exact, or a ``prefix/**`` pattern that covers everything below prefix. A null path matches nothing."""
    prefix = F.regexp_replace(pattern, r"\*\*$", "")
    return F.coalesce((path == pattern) | (pattern.endswith("/**") & path.startswith(prefix)), F.lit(False))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a module glob: * is one segment, ** any number."""
    parts, out = pattern.split("::"), ""
    for i, p in enumerate(parts):
        if p == "**":
            out += r"(?:(?:^|::)[^:]+)*" if i else r"(?:[^:]+(?:::(?=.)|$))*"
            continue
        piece = "[^:]+" if p == "*" else "".join("\\" + c if not c.isalnum() and c != "_" else c for c in p)
        out += ("" if not i or (i == 1 and parts[0] == "**") else "::") + piece
    return f"^{out}$"


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_")


def title(name: Column, stop: Iterable[str] = ("test", "should", "when")) -> Column:
    """"Checks ...": up to seven words of an identifier without stop words; "behavior" if none is left."""
    own = F.filter(F.split(name, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(list(stop)))
    useful = F.when(F.size(own) > 0, F.array_join(F.slice(own, 1, 7), " ")).otherwise("behavior")
    return F.when(name.isNotNull(), F.concat(F.lit("Checks "), useful, F.lit(".")))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def anchor(line: Column) -> Column:
    """A line with white space collapsed, by which findings survive moves."""
    return F.trim(F.regexp_replace(line, r"(?U)\s+", " "))


def version_triple(version: Column) -> Column:
    """major, minor, patch as a struct, which orders as versions do; null without a number in front. Other parts that are no numbers are 0.

    What follows a dash or blank doesn't count; "rustc " may stand in front.
    """
    parts = F.split(F.get(F.split(F.regexp_replace(F.trim(version), "^rustc ", ""), "[- ]"), F.lit(0)), r"\.")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    rest = lambda i: F.coalesce(part(i), F.lit(0).cast("bigint"))
    return F.when(part(0) >= 0, F.struct(part(0).alias("major"), rest(1).alias("minor"), rest(2).alias("patch")))


def raw_tokens(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(f"({TOKEN})"), F.lit(1))


def normal_token(token: Column) -> Column:
    """Identifiers become ID and digits LIT; keywords and punctuation stay."""
    return F.when(token.isin(KEYWORDS), token).when(token.rlike(r"^[0-9]+$"), "LIT").when(token.rlike(r"^[A-Za-z_]"), "ID").otherwise(token)


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1) of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), start, end - start + 1), "\n")


def tail_lines(text: Column, n: int) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


def fnv1a64(basis: int = FNV_BASIS):
    """Arrow UDF: FNV-1a 64 of a text's bytes as 16 hex digits. Null stays null."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        data = [t.encode() for t in texts[known]]
        lengths = np.array([len(d) for d in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        starts = np.cumsum(lengths) - lengths
        h = np.full(len(data), basis, np.uint64)
        for k in range(int(lengths.max(initial=0))):  # byte k of all texts at once
            own = np.flatnonzero(lengths > k)
            h[own] = (h[own] ^ flat[starts[own] + k]) * np.uint64(FNV_PRIME)
        out = np.full(len(texts), None, object)
        out[known] = [f"{x:016x}" for x in h.tolist()]
        return pd.Series(out)

    return run


def percent_decode(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def percent_encode(text: Column) -> Column:
    """A path as part of a file URI: all but letters, digits and - . _ ~ / becomes %XX of its UTF-8 bytes."""
    form = F.url_encode(text)  # form encoding: + for a blank, and - . _ * kept
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        form = F.replace(form, F.lit(a), F.lit(b))
    return form


def file_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), percent_encode(slashes(path)))


def uri_path(uri: Column) -> Column:
    """The path of a file URI; null for other schemes."""
    return F.when(uri.startswith("file://"), percent_decode(F.substring(uri, 8, 1 << 30)))


def utf16_to_byte(line: Column, column: Column) -> Column:
    """Byte offset in UTF-8 of a column counted in UTF-16 units; null beyond the line or inside a pair of units."""
    units = F.transform(F.split(line, ""), lambda c: F.struct(c.alias("c"), F.when(F.octet_length(c) == 4, 2).otherwise(1).alias("u"), F.octet_length(c).alias("b")))
    start = F.struct(F.lit(0).alias("u"), F.lit(0).alias("b"), F.when(column == 0, 0).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        u, b = acc["u"] + x["u"], acc["b"] + x["b"]
        return F.struct(u.alias("u"), b.alias("b"), F.coalesce(acc["hit"], F.when(u == column, b)).alias("hit"))

    return F.when(line.isNotNull(), F.aggregate(F.filter(units, lambda x: x["c"] != ""), start, step)["hit"])


def identifier_at(line: Column, column: Column) -> Column:
    """The identifier that begins at a zero-based column of code points, if one does."""
    return F.nullif(F.regexp_extract(F.substring(line, column + 1, F.length(line)), r"^[A-Za-z_][A-Za-z0-9_]*", 0), F.lit(""))


def within_budget(text: Column, most_bytes: int = 65_536, most_tokens: int = 128) -> Column:
    """Whether a text is small enough to be parsed as one item: bytes, and words and signs."""
    return (F.octet_length(text) <= most_bytes) & (F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))) <= most_tokens)


def finding_level(disposition: Column, severity: Column) -> Column:
    """error, warning or note; a known disposition goes before the severity."""
    by_disposition = F.when(disposition == "block", "error").when(disposition == "warn", "warning").when(disposition.isin("review", "info"), "note")
    return F.coalesce(by_disposition, F.when(severity.isin("error", "warning"), severity), F.lit("note"))


def compiler_rule(code: Column) -> Column:
    """Rule id of a compiler's diagnostic code; clippy lints have a namespace of their own."""
    dashed = F.replace(code, F.lit("_"), F.lit("-"))
    return F.when(code.startswith("clippy::"), F.concat(F.lit("rust.clippy."), F.substring(dashed, 9, 1 << 30))).when(code.isNotNull(), F.concat(F.lit("rust.compiler."), F.lower(dashed))).otherwise("rust.compiler.diagnostic")
