"""Joins that the built-in ones don't have, rewritten as equi joins.

Prefixes, suffixes and range bins are exploded on the side whose rows have few of
them; what is left is a hash or sort-merge join that Spark can partition, broadcast
after its own size check, or split where a key is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(pairs: Sequence[tuple[str, str]]) -> Column:
    on = F.lit(True)
    for a, b in pairs:
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def coalesced_key_join(left: DataFrame, metrics: DataFrame, keys: Sequence[str], metric_key: str, value: str, name: str) -> DataFrame:
    """The metric of the first of several candidate keys that has one.

    A left equi join for each key, coalesced; not a join on a disjunction, which would
    be a nested loop. ``metrics`` is reduced to one row a key (its greatest value), so
    rows of ``left`` are neither lost nor multiplied. A null key finds nothing.
    """
    unique = metrics.filter(F.col(metric_key).isNotNull()).groupBy(F.col(metric_key).alias("_mk")).agg(F.max(value).alias("_mv"))
    found, columns = left, []
    for i, key in enumerate(keys):
        own = unique.select(F.col("_mk").alias(f"_mk{i}"), F.col("_mv").alias(f"_mv{i}"))
        found = found.join(own, F.col(key) == F.col(f"_mk{i}"), "left")
        columns.append(F.col(f"_mv{i}"))
    return found.select(*left.columns, F.coalesce(*columns).alias(name))


def metric_or_default(value: Column, artifact_available: Column, default: float = 0.0) -> Column:
    """Null if the artifact is missing; the default if it is there but has no row for this key."""
    return F.when(artifact_available, F.coalesce(value, F.lit(default)))


def prefixes(path: Column, separator: str) -> Column:
    """All prefixes of a path at the separator, itself included."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def suffixes(path: Column, separator: str) -> Column:
    """All suffixes of a path at the separator, itself included."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), separator))


def longest_prefix_join(left: DataFrame, path: str, candidates: DataFrame, candidate: str, separator: str = "::", name: str = "matched", proper: bool = False, unless_prefix_of: str | None = None) -> DataFrame:
    """For each row the longest candidate that is a prefix of its path, or null.

    ``proper`` leaves out the path itself (nearest ancestor). Candidates that are a
    prefix of the path in ``unless_prefix_of`` are left out (a module's own ancestors).
    Only the distinct paths explode into their prefixes; they are matched by an equi
    join and folded with a partial maximum, so a popular prefix isn't collected, and no
    other column of left is moved more than once. A null path matches nothing.
    """
    keys = [path, *([unless_prefix_of] if unless_prefix_of and unless_prefix_of != path else [])]
    own = left.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
    tried = own.select("*", F.explode(prefixes(F.col("_k0"), separator)).alias("_p"))
    if proper:
        tried = tried.filter(F.col("_p") != F.col("_k0"))
    if unless_prefix_of:
        not_in = F.col(f"_k{len(keys) - 1}")
        tried = tried.filter(~F.coalesce((not_in == F.col("_p")) | not_in.startswith(F.concat("_p", F.lit(separator))), F.lit(False)))
    known = candidates.filter(F.col(candidate).isNotNull()).select(F.col(candidate).alias("_c")).distinct()
    best = tried.join(known, F.col("_p") == F.col("_c")).groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.max_by("_c", F.length("_c")).alias("_best"))
    on = null_safe([(k, f"_k{i}") for i, k in enumerate(keys)])
    return left.join(best, on, "left").select(*left.columns, F.col("_best").alias(name))


def suffix_semi_join(left: DataFrame, path: str, labels: DataFrame, label: str, separator: str = "::") -> DataFrame:
    """Rows whose path is a label or ends with separator + label; each once."""
    own = left.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(suffixes(F.col("_path"), separator)).alias("_s"))
    hit = own.join(labels.select(F.col(label).alias("_l")).distinct(), F.col("_s") == F.col("_l"), "left_semi").select("_path").distinct()
    return left.join(hit, F.col(path) == F.col("_path"), "left_semi")


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.when(lo <= hi, F.sequence(F.floor(lo / width), F.floor(hi / width)))


def range_join(points: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str, equal: Sequence[tuple[str, str]], width: int, how: str = "inner") -> DataFrame:
    """Points inside [lo, hi] of ranges with equal keys, both ends included.

    Ranges explode into bins of ``width``; a point is in one bin, so the join is an equi
    join on (keys, bin) and a long list of points under one key is spread over its bins.
    With how="left_semi" a point counts once however many ranges hold it; "left" keeps
    ranges... use range_counts for that. Column names of the two sides must differ.
    """
    binned = ranges.withColumn("_rb", F.explode(_bins(F.col(lo), F.col(hi), width)))
    on = (F.floor(F.col(point) / width) == F.col("_rb")) & (F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))
    for p, r in equal:
        on = on & (F.col(p) == F.col(r))
    return points.join(binned, on, how).drop("_rb")


def range_counts(ranges: DataFrame, key: Sequence[str], lo: str, hi: str, points: DataFrame, point: str, hit: Column, equal: Sequence[tuple[str, str]], width: int) -> DataFrame:
    """Ranges with n_points and n_hits of the points inside; ranges without points stay, with 0."""
    inside = range_join(points.withColumn("_hit", hit), point, ranges, lo, hi, [(p, r) for p, r in equal], width)
    counted = inside.groupBy(*key).agg(F.count("*").alias("n_points"), F.count_if("_hit").alias("n_hits"))
    renamed = counted.withColumnsRenamed({k: f"_k_{k}" for k in key})
    return ranges.join(renamed, null_safe([(k, f"_k_{k}") for k in key]), "left").drop(*(f"_k_{k}" for k in key)).fillna(0, ["n_points", "n_hits"])


def contained_semi_join(spans: DataFrame, s: str, e: str, ranges: DataFrame, lo: str, hi: str, equal: Sequence[tuple[str, str]], width: int) -> DataFrame:
    """Spans that lie inside a range with equal keys, each once."""
    binned = ranges.withColumn("_rb", F.explode(_bins(F.col(lo), F.col(hi), width)))
    on = (F.floor(F.col(s) / width) == F.col("_rb")) & (F.col(s) >= F.col(lo)) & (F.col(e) <= F.col(hi))
    for a, b in equal:
        on = on & (F.col(a) == F.col(b))
    return spans.join(binned, on, "left_semi")


def exactly_one(left: DataFrame, key: str, right: DataFrame, right_key: str, value: str) -> DataFrame:
    """left with n_matches, resolution (unresolved, resolved, ambiguous) and the value if it is resolved."""
    counted = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_rk")).agg(F.count("*").alias("n_matches"), F.min(value).alias("_v"))
    joined = left.join(counted, F.col(key) == F.col("_rk"), "left").drop("_rk").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    state = F.when(F.col("n_matches") == 0, "unresolved").when(F.col("n_matches") == 1, "resolved").otherwise("ambiguous")
    return joined.withColumn("resolution", state).withColumn(value, F.when(F.col("n_matches") == 1, F.col("_v"))).drop("_v")


def first_match(left: DataFrame, row_key: Sequence[str], candidate_keys: Sequence[Column], right: DataFrame, right_key: str, value: str, name: str) -> DataFrame:
    """The value of the first of several candidate keys that is in ``right``; of equal keys there the least value.

    ``row_key`` identifies a row of left. Candidates explode with their priority and
    are matched in one equi join.
    """
    known = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_rk")).agg(F.min(value).alias("_rv"))
    tried = left.select(*row_key, F.posexplode(F.array(*(c.cast("string") for c in candidate_keys))).alias("_at", "_try"))
    best = tried.join(known, F.col("_try") == F.col("_rk").cast("string")).groupBy(*row_key).agg(F.min_by("_rv", "_at").alias(name))
    return left.join(best.withColumnsRenamed({k: f"_k_{k}" for k in row_key}), null_safe([(k, f"_k_{k}") for k in row_key]), "left").drop(*(f"_k_{k}" for k in row_key))


def guarded_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows of left joined to right where the key is unique there, and the rows that abstain.

    A key that is missing or ambiguous in right joins to nothing; those rows come out
    second, with ``reason`` unresolved or ambiguous. Both parts together are left.
    """
    keys = [r for _, r in pairs]
    n = right.groupBy(*(F.col(k).alias(f"_n_{k}") for k in keys)).agg(F.count("*").alias("_n"))
    on = F.lit(True)
    for a, b in pairs:
        on = on & (F.col(a) == F.col(f"_n_{b}"))
    marked = left.join(n, on, "left").drop(*(f"_n_{k}" for k in keys))
    match = F.lit(True)
    for a, b in pairs:
        match = match & (F.col(a) == F.col(b))
    joined = marked.filter(F.col("_n") == 1).drop("_n").join(right, match)
    abstained = marked.filter(F.col("_n").isNull() | (F.col("_n") > 1)).withColumn("reason", F.when(F.col("_n").isNull(), "unresolved").otherwise("ambiguous")).drop("_n")
    return joined, abstained


def full_outer_compare(current: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """key, current, baseline of both tables; one of them is null where a key is missing."""
    a = current.select(F.col(key).alias("_a"), F.col(value).alias("current"))
    b = baseline.select(F.col(key).alias("_b"), F.col(value).alias("baseline"))
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), "current", "baseline")


def baseline_deltas(current: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of current with baseline (0 if new), delta, is_new and direction; rows of the baseline alone are dropped."""
    b = baseline.select(F.col(key).alias("_b"), F.col(value).alias("_v"))
    joined = current.select(F.col(key), F.col(value).alias("current")).join(b, F.col(key) == F.col("_b"), "left")
    delta = F.col("current") - F.coalesce("_v", F.lit(0.0))
    direction = F.when(F.col("_b").isNull(), "new").when(delta > 0, "regressed").when(delta < 0, "improved").otherwise("unchanged")
    return joined.select(key, "current", F.coalesce("_v", F.lit(0.0)).alias("baseline"), delta.alias("delta"), F.col("_b").isNull().alias("is_new"), direction.alias("direction"))


def interval_direction(est: tuple[Column, Column, Column], base: tuple[Column, Column, Column], comparable: Column) -> Column:
    """regressed, improved or within_noise by intervals (estimate, low, high) that don't overlap; else incomparable."""
    ok = comparable & est[1].isNotNull() & est[2].isNotNull() & base[1].isNotNull() & base[2].isNotNull()
    return F.when(~F.coalesce(ok, F.lit(False)), "incomparable").when(est[1] > base[2], "regressed").when(est[2] < base[1], "improved").otherwise("within_noise")


def valid_interval(estimate: Column, low: Column, high: Column, level: Column, samples: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce((samples >= 3) & finite(estimate) & finite(low) & finite(high) & (low <= estimate) & (estimate <= high) & (level > 0) & (level < 1), F.lit(False))


def by_owner(types: DataFrame, impls: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """types with the methods, impl blocks and distinct files of the impls that name them by the compiler's own ids.

    ``keys`` pairs columns of types and impls (context and definition id). A type
    without impls has zeros, as its inventory is complete.
    """
    per = impls.groupBy(*(F.col(i).alias(f"_o_{i}") for _, i in keys)).agg(F.sum("method_count").alias("method_count"), F.count("*").alias("impl_block_count"), F.countDistinct("path").alias("impl_file_count"))
    joined = types.join(per, null_safe([(t, f"_o_{i}") for t, i in keys]), "left").drop(*(f"_o_{i}" for _, i in keys))
    return joined.fillna(0, ["method_count", "impl_block_count", "impl_file_count"])


def rule_edges(edges: DataFrame, rules: Sequence[dict], context: Sequence[str] = ()) -> DataFrame:
    """Violations of dependency rules: id, level, from, allow and deny globs over src and dst.

    With ``context`` columns (a compilation profile) each context's edges are judged by themselves.

    A deny glob wins; with an allow list everything else is denied. Rules come from a
    configuration, so there are few: they become one expression over the edges, and
    neither a join nor a shuffle is needed.
    """
    from ..functions.text import glob_regex

    found = []
    for rule in rules:
        if rule.get("level") == "off":
            continue
        any_of = lambda c, globs: F.coalesce(*[F.when(F.col(c).rlike(glob_regex(g)), F.lit(True)) for g in globs], F.lit(False)) if globs else F.lit(False)
        denied, allowed = any_of("dst", rule.get("deny", [])), any_of("dst", rule.get("allow", []))
        reason = F.when(denied, "denied").when(F.lit(bool(rule.get("allow"))) & ~allowed, "not_allowed")
        found.append(F.when(any_of("src", rule["from"]) & reason.isNotNull(), F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(rule["level"]).alias("level"), reason.alias("reason"))))
    if not found:
        return edges.select(*context, "src", "dst").withColumns({"rule_id": F.lit(""), "level": F.lit(""), "reason": F.lit("")}).limit(0)
    return edges.select(*context, "src", "dst", F.explode(F.array_compact(F.array(*found))).alias("_v")).select(*context, "src", "dst", "_v.*")
