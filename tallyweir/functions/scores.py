"""Risk scores as column expressions; a null input makes a null score.

The weights, free allowances and caps below are fixed values of the risk model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import Value, at_least, at_most, capped_sum, clamp, col, minus_floor, over_free, round2, total, weighted

# Band thresholds and entrypoint allowances.
FUNCTION_BANDS = (19.15, 32.98, 80.08)
MODULE_BANDS = (67.30, 95.51, 139.94)
TOTAL_BANDS = (712.99, 838.64, 1028.20)
ENTRYPOINT_OUTBOUND, ENTRYPOINT_VIOLATIONS = 8, 2


def function_score(branch: Value, path: Value, nesting: Value, lines: Value) -> Column:
    """Hotspot score of a function, to two decimals."""
    size = at_most(0.25 * minus_floor(col(lines), 20), 20.0)
    return round2(1.12 * (3.7 * col(branch) + 2.0 * minus_floor(col(path), 1) + 3.0 * minus_floor(col(nesting), 2) + size))


def module_score(largest: Value, p95: Value, mean: Value, lines: Value) -> Column:
    """Hotspot score of a module from its functions' scores and its nonblank lines."""
    return 0.55 * col(largest) + 0.25 * col(p95) + 0.10 * col(mean) + 0.5 * at_most(col(lines) / 10.0, 20.0)


def crap(complexity: Value, coverage: Value) -> Column:
    """CC^2 * (1 - cov)^3 + CC to two decimals, cov as a fraction clamped to [0, 1]."""
    gap = 1.0 - clamp(col(coverage).cast("double"), 0.0, 1.0)
    return round2(col(complexity).cast("double") * col(complexity) * gap * gap * gap + col(complexity))


def maintainability(complexity: Value, lines: Value, api: Value, outbound: Value, inbound: Value) -> Column:
    out = weighted(outbound, 4.0, 35.0)
    return capped_sum([col(complexity).cast("double"), weighted(lines, 0.12, 70), weighted(api, 2.5, 30), out, at_most(col(inbound).cast("double"), at_least(35.0 - out, 0.0))], 400)


def change(churn: Value, commits: Value, contributors: Value, defects: Value, has_tests: Column) -> Column:
    untested = F.when(has_tests, 0.0).when(has_tests.isNotNull(), 90.0)
    return capped_sum([at_most(col(churn).cast("double") / 12.0, 160.0), weighted(commits, 2.5, 100), weighted(contributors, 14, 80), weighted(defects, 18, 90), untested], 520)


def correctness(failed: Value, unknown: Value, skipped: Value, tests: Value, coverage: Value, run_status: Column) -> Column:
    """run_status: passed, failed or compile_failed. A null coverage is no evidence, not an unknown."""
    failed, coverage = col(failed), col(coverage)
    any_failed = F.when(failed > 0, 140.0).when(failed.isNotNull(), 0.0)
    run = F.when(run_status == "compile_failed", 180.0).when((run_status == "failed") & (failed == 0), 140.0).when(run_status.isNotNull(), 0.0)
    low = F.when(coverage.isNull(), 0.0).otherwise(at_most(1.5 * minus_floor(F.lit(70.0), coverage), 105.0))
    none = F.when((col(tests) == 0) & (F.coalesce(coverage, F.lit(0.0)) <= 0), 90.0).when(col(tests).isNotNull(), 0.0)
    return capped_sum([any_failed, weighted(failed, 45, 120), weighted(unknown, 4, 80), weighted(skipped, 10, 40), run, low, none], 470)


def architecture(outbound: Value, inbound: Value, violations: Value, in_cycle: Column, lines: Value) -> Column:
    cycle = F.when(in_cycle, 110.0).when(in_cycle.isNotNull(), 0.0)
    large = F.when(col(lines) >= 250, 60.0).when(col(lines).isNotNull(), 0.0)
    return capped_sum([weighted(outbound, 10, 120), weighted(inbound, 8, 120), weighted(violations, 32, 120), cycle, large], 530)


def entrypoint_allowance(value: Value, is_entrypoint: Column, allowance: int) -> Column:
    return F.when(is_entrypoint, minus_floor(col(value), allowance)).otherwise(col(value))


def locality_risk(outbound: Value, inbound: Value, is_entrypoint: Column) -> Column:
    free = F.when(is_entrypoint, 8).otherwise(5)
    return round2(at_most(3.0 * minus_floor(col(outbound), free) + 0.75 * minus_floor(col(inbound), 12), 100.0))


def leverage_pressure(outbound: Value, inbound: Value, is_entrypoint: Column) -> Column:
    weight = F.when(is_entrypoint, 1.5).otherwise(3.0)
    return round2(100.0 - clamp(68.0 + 2.5 * col(inbound) - weight * col(outbound), 0.0, 100.0))


def reuse(inbound: Value) -> Column:
    return weighted(inbound, 10.0, 100.0)


def quality(maintainability_: Column, locality: Column, leverage: Column) -> Column:
    return round2(total([maintainability_, locality, leverage]))


def type_risk(fields: Value, variants: Value, payload: Value, methods: Value, span: Value, files: Value, blocks: Value) -> Column:
    """Structural pressure of a type, 0..100."""
    spread = at_most(4.5 * minus_floor(col(files), 2) + 1.2 * minus_floor(col(blocks), 4), 24.0)
    terms = [over_free(fields, 8, 2.5, 35), over_free(variants, 8, 1.8, 28), over_free(payload, 10, 1.4, 18), over_free(methods, 12, 0.85, 32), over_free(span, 30, 0.35, 12), spread]
    return round2(clamp(total(terms), 0.0, 100.0))


def type_signals(fields: Value, is_tuple: Column, variants: Value, payload: Value, methods: Value, files: Value, blocks: Value, span: Value) -> Column:
    """Names of the limits that a type exceeds."""
    wide = col(fields) >= F.when(is_tuple, 8).otherwise(16)
    named = [("wide-fields", wide), ("many-variants", col(variants) >= 12), ("large-payload", col(payload) >= 12), ("many-methods", col(methods) >= 20), ("scattered-files", col(files) >= 4), ("many-blocks", col(blocks) >= 6), ("long-declaration", col(span) >= 45)]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named)))


def function_signals(branch: Value, nesting: Value, lines: Value) -> Column:
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in (("branch pressure", col(branch) >= 8), ("deep nesting", col(nesting) >= 4), ("long function", col(lines) >= 60)))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("stable")))


def halstead(n1: Value, n2: Value, big_n1: Value, big_n2: Value) -> Column:
    """volume, difficulty and effort from distinct and total operators (1) and operands (2).

    An empty vocabulary has volume 0; without operands difficulty and effort are null.
    """
    n1, n2, big_n1, big_n2 = (col(v).cast("double") for v in (n1, n2, big_n1, big_n2))
    vocabulary = n1 + n2
    volume = F.when(vocabulary > 0, (big_n1 + big_n2) * F.log2(F.when(vocabulary > 0, vocabulary))).when(vocabulary.isNotNull(), 0.0)
    difficulty = F.when(n2 > 0, (n1 / 2.0) * (big_n2 / F.when(n2 > 0, n2)))
    return F.struct(volume.alias("volume"), difficulty.alias("difficulty"), (difficulty * volume).alias("effort"))


# Weight of each kind of escape hatch; raw-memory API calls are counted but carry none.
ESCAPE_WEIGHTS = {
    "unsafe_block": 10, "unsafe_fn": 10, "unsafe_impl": 10, "unsafe_trait": 10, "extern_block": 8, "extern_fn": 7, "mutable_static": 14, "union": 12,
    "raw_borrow": 6, "inline_asm": 14, "transmute": 12, "maybe_uninit": 5, "deref": 4, "deref_mut": 5, "glob_import": 2, "container_ref_return": 3,
    "layout_repr": 5, "linkage": 8, "clippy_suppression": 3, "lint_suppression": 2, "raw_memory_api": 0,
}


def escape_score(counts: Column) -> Column:
    """Weighted sum over a map of kind to count; lint suppressions don't count beside clippy ones."""
    n = lambda kind: F.coalesce(F.try_element_at(counts, F.lit(kind)), F.lit(0))
    terms = [F.when(n("clippy_suppression") > 0, 0).otherwise(n(k)) * w if k == "lint_suppression" else n(k) * w for k, w in ESCAPE_WEIGHTS.items()]
    return F.when(counts.isNotNull(), total(terms))
