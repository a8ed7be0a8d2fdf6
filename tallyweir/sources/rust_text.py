"""Facts that the lines of Rust sources give away without a parser.

For files that no parser could read (or when none is at hand): functions from the line
that opens them to the closing brace at the same indentation, and pressure counts of
keywords and operators in between. Strings and comments are not told apart, so the
counts are estimates; rows say so by backend "text". All in built-in expressions, a file
a row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEYWORDS, raw_tokens

# How a function opens and closes, and the words and signs that count.
OPENS = r"^[ \t]*(pub(\([a-z]+\))? )?(const )?(async )?(unsafe )?fn [A-Za-z_]"
NAME = r"fn ([A-Za-z_][A-Za-z0-9_]*)"
CLOSES = r"^[ \t]*\}[ \t\r]*$"
BRANCH = r"(^|[^.A-Za-z0-9_])(if|match|for|while|loop)\b"
EXIT = r"\?|\breturn\b|\bbreak\b|\bcontinue\b"
BOTH = r"&&|\|\|"
ASSERT = r"\b(debug_)?assert(_eq|_ne)?!"


def _indent(line: Column) -> Column:
    return F.regexp_extract(line, r"^[ \t]*", 0)


def depth_of(line: Column) -> Column:
    """Indentation in steps: a tab, or four blanks."""
    lead = _indent(line)
    tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
    return tabs + F.floor((F.length(lead) - tabs) / 4).cast("int")


def occurrences(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def functions_of(files: DataFrame, file: str, text: str) -> DataFrame:
    """Functions of each file: file, qualified_name, start_line, end_line, the pressure counts, complexities and assertions.

    A function without a closing brace at its indentation has no row; null texts have
    none. Functions inside functions count for both.
    """
    lines = F.transform(F.split(text, "\n"), lambda c, i: F.struct((i + 1).cast("bigint").alias("l"), c.alias("c"), _indent(c).alias("d")))
    held = files.filter(F.col(text).isNotNull()).select(F.col(file), lines.alias("_lines"))
    held = held.select(file, "_lines", F.filter("_lines", lambda x: x["c"].rlike(CLOSES)).alias("_ends"))
    opened = held.select(file, "_lines", "_ends", F.explode(F.filter("_lines", lambda x: x["c"].rlike(OPENS))).alias("_o"))
    end = F.get(F.filter("_ends", lambda e: (e["l"] > F.col("_o.l")) & (e["d"] == F.col("_o.d"))), F.lit(0))["l"]
    own = opened.withColumn("end_line", end).filter(F.col("end_line").isNotNull())
    start = F.col("_o.l")
    own = own.select(file, F.regexp_extract("_o.c", NAME, 1).alias("qualified_name"), start.alias("start_line"), "end_line", depth_of(F.col("_o.c")).alias("_base"), F.slice("_lines", start.cast("int"), (F.col("end_line") - start + 1).cast("int")).alias("_body"))
    inner = F.filter("_body", lambda x: F.trim(F.regexp_replace(x["c"], r"[\t\r]", " ")) != "")
    own = own.withColumn("_body", F.transform(inner, lambda x: F.struct(x["c"].alias("c"), F.greatest(depth_of(x["c"]) - F.col("_base") - 1, F.lit(0)).alias("n"), occurrences(x["c"], BRANCH).alias("b"))))
    total = lambda f: F.aggregate("_body", F.lit(0).cast("bigint"), lambda acc, x: acc + f(x))
    return own.select(
        file, "qualified_name", "start_line", "end_line", F.size("_body").cast("bigint").alias("source_line_count"),
        total(lambda x: x["b"]).alias("branch_pressure"), total(lambda x: occurrences(x["c"], EXIT) + occurrences(x["c"], BOTH)).alias("path_pressure"),
        F.coalesce(F.array_max(F.transform("_body", lambda x: x["n"])), F.lit(0)).cast("bigint").alias("max_nesting_depth"),
        (1 + total(lambda x: x["b"] + occurrences(x["c"], BOTH))).alias("cyclomatic_complexity"), total(lambda x: x["b"] * (1 + x["n"])).alias("cognitive_complexity"),
        total(lambda x: occurrences(x["c"], ASSERT)).alias("assertion_count"),
    )


def functions_sql(source: str, file: str, text: str) -> str:
    """The same functions as SQL, as common table expressions that end in ``rfn``."""
    quoted = {k: v.replace("'", "''") for k, v in {"opens": OPENS, "closes": CLOSES, "branch": BRANCH, "exit": EXIT, "both": BOTH, "name": NAME, "assert": ASSERT}.items()}
    lead = "regexp_extract(c, '^[ \\t]*', 0)"
    depth = f"(length({lead}) - length(replace({lead}, chr(9), '')) + (length(replace({lead}, chr(9), '')) // 4))"
    hits = lambda p: f"len(regexp_extract_all(c, '{p}'))"
    return f"""
rl as (select {file}, unnest(string_split({text}, chr(10))) c, unnest(range(1, len(string_split({text}, chr(10))) + 1)) l from {source} where {text} is not null),
rm as (select *, {lead} d, {depth} n, regexp_matches(c, '{quoted["opens"]}') op, regexp_matches(c, '{quoted["closes"]}') cl, trim(replace(replace(c, chr(9), ' '), chr(13), ' ')) <> '' nb, {hits(quoted["branch"])} b, {hits(quoted["exit"])} x, {hits(quoted["both"])} a, {hits(quoted["assert"])} t from rl),
ro as (select o.{file}, o.l start_line, min(e.l) end_line, any_value(o.n) base, regexp_extract(any_value(o.c), '{quoted["name"]}', 1) qualified_name from rm o join rm e on e.{file} = o.{file} and e.l > o.l and e.d = o.d and e.cl where o.op group by 1, 2),
rfn as (select ro.{file}, qualified_name, start_line::bigint start_line, end_line::bigint end_line, count(*)::bigint source_line_count, sum(b)::bigint branch_pressure, sum(x + a)::bigint path_pressure, max(greatest(n - base - 1, 0))::bigint max_nesting_depth, (1 + sum(b + a))::bigint cyclomatic_complexity, sum(b * (1 + greatest(n - base - 1, 0)))::bigint cognitive_complexity, sum(t)::bigint assertion_count
  from ro join rm on rm.{file} = ro.{file} and l between start_line and end_line and nb group by ro.{file}, qualified_name, start_line, end_line)"""


def halstead_counts(files: DataFrame, file: str, text: str) -> DataFrame:
    """Distinct and total operators (keywords and signs) and operands (names and numbers) of each file, by its tokens alone."""
    tokens = files.filter(F.col(text).isNotNull()).select(F.col(file), F.explode(raw_tokens(F.col(text))).alias("t"))
    each = tokens.groupBy(file, "t").agg(F.count("*").alias("n"))
    operand = F.col("t").rlike(r"^[A-Za-z_\p{Nd}]") & ~F.col("t").isin(KEYWORDS)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy(file).agg(F.count_if(~operand).alias("operators"), F.count_if(operand).alias("operands"), n(~operand).alias("total_operators"), n(operand).alias("total_operands"))
