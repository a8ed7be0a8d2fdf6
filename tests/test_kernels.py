"""Golden values and edge cases of the relational kernels."""

from __future__ import annotations

import hashlib
import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.functions import scores as S
from tallyweir.functions import text as X
from tallyweir.functions.numeric import at_least, at_most, band, bucket_count, capped_sum, clamp, delta_percent, minus_floor, over_free, percent, ratio, round2
from tallyweir.operators import clones, evidence, joins, ranking, sets, stats, windows
from tallyweir.operators import graph as G
from tallyweir.sources.rust_text import functions_of

from .conftest import same


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x,expected", [(1.005, 1.0), (0.285, 0.28), (2.675, 2.68), (-1.005, -1.0), (None, None), (160.004, 160.0)])
def test_round2(spark, x, expected):
    assert value(spark, round2(F.lit(x).cast("double"))) == expected


def test_null_is_not_zero(spark):
    null = F.lit(None).cast("double")
    for c in (at_most(null, 5.0), at_least(null, 5.0), clamp(null, 0.0, 1.0), minus_floor(null, 1), over_free(null, 8, 1, 5), capped_sum([F.lit(1.0), null], 9), band(null, 1, 2, 3), bucket_count(null), S.crap(F.lit(3), null), S.function_score(null, F.lit(1), F.lit(1), F.lit(1)), S.type_risk(*[F.lit(1.0)] * 6, null)):
        assert value(spark, c) is None
    assert value(spark, percent(1, 0, 0.0)) == 0 and value(spark, percent(1, 0, 100.0)) == 100 and value(spark, percent(0, 0, None)) is None
    assert value(spark, ratio(1, 0)) is None and value(spark, delta_percent(1, 0)) is None


def test_scores(spark):
    assert value(spark, S.crap(F.lit(5), F.lit(2.0))) == 5.0 and value(spark, S.crap(F.lit(5), F.lit(0.0))) == 30.0
    h = value(spark, S.halstead(F.lit(10), F.lit(9), F.lit(23), F.lit(15)))
    assert (h["volume"], h["difficulty"], h["effort"]) == (pytest.approx(161.42124551085624), pytest.approx(8.333333333333334), pytest.approx(1345.177045923802))
    empty = value(spark, S.halstead(*[F.lit(0)] * 4))
    assert (empty["volume"], empty["difficulty"], empty["effort"]) == (0.0, None, None)
    entry, plain = (value(spark, S.locality_risk(F.lit(10), F.lit(0), F.lit(e))) for e in (True, False))
    assert entry == 6.0 and plain == 15.0
    assert value(spark, S.leverage_pressure(F.lit(0), F.lit(0), F.lit(False))) == 32.0
    counts = F.create_map(F.lit("lint_suppression"), F.lit(5), F.lit("clippy_suppression"), F.lit(1), F.lit("raw_memory_api"), F.lit(9))
    assert value(spark, S.escape_score(counts)) == 3
    one = F.lit(1)
    assert value(spark, S.correctness(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(None).cast("double"), F.lit("passed"))) == 90.0
    assert value(spark, S.correctness(one, F.lit(0), F.lit(0), one, F.lit(50.0), F.lit("failed"))) == 140 + 45 + 30
    assert value(spark, S.architecture(one, one, one, F.lit(True), F.lit(250))) == 10 + 8 + 32 + 110 + 60
    assert [value(spark, bucket_count(F.lit(n))) for n in (0, 1, 3, 4, 8)] == ["0", "1", "2-3", "4-7", "8+"]


def test_subjects_and_paths(spark):
    assert [value(spark, X.is_defect_subject(F.lit(s))) for s in ("fix parser crash", "refresh fixture snapshots", "prefix command output")] == [True, False, False]
    assert value(spark, X.outcome_kinds(F.lit("Revert the fix of CVE-2024-1"))) == ["defect", "revert", "security"]
    assert [value(spark, X.layer(F.lit(p))) for p in ("src/API/core.rs", "a::domain::db", "x/tests/y.rs", "misc/tests.rs")] == ["Interface", "Domain", "Tests", "Unclassified"]
    assert value(spark, X.module_key(F.lit("crates/a/src/b/mod.rs"))) == "b" and [value(spark, X.path_module_key(F.lit(p))) for p in ("src\\a\\b.rs", "src/a/mod.rs", "crates/a/src/b.rs", ".x")] == ["a::b", "a", "b", ".x"]
    assert [value(spark, X.matches_pattern(F.lit(p), F.lit("a/**"))) for p in ("a/b", "a", "ab/c")] == [True, False, False]
    assert value(spark, X.matches_pattern(F.lit(None).cast("string"), F.lit("a/**"))) is False
    triples = [value(spark, X.version_triple(F.lit(v)))for v in ("rustc 1.10.2-nightly (x)", "1.9", "x")]
    assert triples[0] > triples[1] and triples[2] is None
    assert value(spark, X.anchor(F.lit("  a \t b　c "))) == "a b c"
    assert spark.createDataFrame([("a",), ("",), (None,)], "t string").select(X.fnv1a64()("t").alias("h")).collect()[0]["h"] == "af63dc4c8601ec8c"
    assert value(spark, X.title(F.lit("test_it_should_parse_an_empty_list_of_names"))) == "Checks it parse an empty list of names." and value(spark, X.title(F.lit("test"))) == "Checks behavior."
    assert value(spark, X.snippet(F.lit("a\nb\nc"), F.lit(2), F.lit(3))) == "b\nc" and value(spark, X.tail_lines(F.lit("a\nb\nc"), 2)) == "b\nc"


@pytest.mark.parametrize("pattern,text,hit", [("a::*", "a::b", True), ("a::*", "a::b::c", False), ("a::**", "a", True), ("**::x", "x", True), ("**::x", "a::b::x", True), ("a::**::z", "a::z", True), ("a::**::z", "a::bz", False), ("a.b", "axb", False)])
def test_globs(spark, pattern, text, hit):
    assert value(spark, F.lit(text).rlike(X.glob_regex(pattern))) is hit


@pytest.mark.parametrize("parts", [1, 7, None])
def test_percentiles_against_brute_force(spark, parts):
    rng = random.Random(parts or 0)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, float("nan"), 1.0, 2.0, rng.random() * 100])) for _ in range(900)] + [("two", 1.0), ("two", 2.0), ("none", None)]
    groups = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(k, []).append(v)
    qs = (0.0, 0.5, 0.75, 0.9, 0.99, 1.0)
    expected = [(k, len(v), *(sorted(v)[math.ceil((len(v) - 1) * q)] for q in qs)) for k, v in groups.items()]
    names = [f"q{i}" for i in range(len(qs))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    same(stats.exact_percentiles(df, ["k"], "v", qs, names, parts), expected, ["k", "n_values", *names])
    assert [e for e in expected if e[0] == "two"][0][3] == 2.0
    assert stats.exact_percentiles(df.limit(0), ["k"], "v", qs, names).count() == 0


def test_confusion_and_flakiness(spark):
    cases = [("r", True, True), ("r", False, False), ("r", True, None), ("r", False, None), ("r", False, True)]
    same(stats.confusion(spark.createDataFrame(cases, "rule string, e boolean, o boolean"), ["rule"], "e", "o"), [("r", 5, 1, 1, 1, 1, 2, 0.5, 0.5, 0.6, 0.4)], ["rule", "labels", "tp", "fp", "fn", "tn", "abstained", "precision", "recall", "coverage", "abstention"])
    runs = spark.createDataFrame([("a", 0, "ok"), ("a", 1, "FAILED"), ("b", 0, "ignored")], "t string, iteration int, status string")
    same(stats.flakiness(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), runs, ["t"], 3), [("a", 50.0, 1, True), ("b", None, 2, False), ("c", None, 3, False)], ["t", "failure_rate", "missing", "flaky"])


def test_concentration_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("m", "bob"), ("m", "al"), ("m", "ale"), ("m", None), ("n", "z")], "m string, a string")
    same(stats.concentration(df, ["m"], "a"), [("m", 3.0, 3, "al", 1 / 3, 1 / 3, math.log2(3)), ("n", 1.0, 1, "z", 1.0, 1.0, 0.0)], ["m", "total", "n_members", "primary", "primary_share", "hhi", "entropy"])


def test_joins(spark):
    left = spark.createDataFrame([("a::b::c",), ("a",), ("x::y",), (None,)], "p string")
    known = spark.createDataFrame([("a",), ("a::b",), ("x::y",), (None,)], "c string")
    same(joins.longest_prefix_join(left, "p", known, "c"), [("a::b::c", "a::b"), ("a", "a"), ("x::y", "x::y"), (None, None)], ["p", "matched"])
    same(joins.longest_prefix_join(left, "p", known, "c", proper=True), [("a::b::c", "a::b"), ("a", None), ("x::y", None), (None, None)], ["p", "matched"])
    same(joins.suffix_semi_join(left, "p", spark.createDataFrame([("c",), ("b::c",), ("y",)], "l string"), "l"), [("a::b::c",), ("x::y",)], ["p"])
    same(joins.exactly_one(left, "p", spark.createDataFrame([("a", 1), ("a", 2), ("x::y", 3)], "k string, v int"), "k", "v"), [("a::b::c", 0, "unresolved", None), ("a", 2, "ambiguous", None), ("x::y", 1, "resolved", 3), (None, 0, "unresolved", None)], ["p", "n_matches", "resolution", "v"])
    metrics = spark.createDataFrame([("k1", 1.0), ("k2", 2.0), (None, 9.0)], "mk string, mv double")
    rows = spark.createDataFrame([("k1", "k2"), ("no", "k2"), (None, None)], "a string, b string")
    same(joins.coalesced_key_join(rows, metrics, ["a", "b"], "mk", "mv", "m"), [("k1", "k2", 1.0), ("no", "k2", 2.0), (None, None, None)], ["a", "b", "m"])
    same(joins.first_match(rows.withColumn("i", F.monotonically_increasing_id()), ["i"], [F.col("a"), F.col("b")], metrics, "mk", "mv", "m"), [("k1", 1.0), ("no", 2.0), (None, None)], ["a", "m"])


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_range_joins_against_brute_force(spark, width):
    rng = random.Random(width)
    ranges = [(i, rng.choice("ab"), lo := rng.randint(-50, 50), lo + rng.randint(-2, 30)) for i in range(40)]
    points = [(j, rng.choice("abc"), rng.randint(-60, 90)) for j in range(150)]
    r, p = spark.createDataFrame(ranges, "i int, rk string, lo bigint, hi bigint"), spark.createDataFrame(points, "j int, pk string, x bigint")
    inside = [(j, i) for j, pk, x in points for i, rk, lo, hi in ranges if pk == rk and lo <= x <= hi]
    same(joins.range_join(p, "x", r, "lo", "hi", [("pk", "rk")], width), inside, ["j", "i"])
    same(joins.range_join(p, "x", r, "lo", "hi", [("pk", "rk")], width, "left_semi"), [(j,) for j in {j for j, _ in inside}], ["j"])
    odd = dict((j, x % 2 == 1) for j, _, x in points)
    same(joins.range_counts(r, ["i"], "lo", "hi", p, "x", F.col("x") % 2 != 0, [("pk", "rk")], width), [(i, sum(b == i for _, b in inside), sum(b == i and odd[j] for j, b in inside)) for i, *_ in ranges], ["i", "n_points", "n_hits"])
    spans = p.withColumn("e", F.col("x") + 5)
    same(joins.contained_semi_join(spans, "x", "e", r, "lo", "hi", [("pk", "rk")], width), [(j,) for j, pk, x in points if any(pk == rk and lo <= x and x + 5 <= hi for _, rk, lo, hi in ranges)], ["j"])


def test_windows(spark):
    rng = random.Random(4)
    rows = [("f", i, rng.choice([None, None, f"h{i}"])) for i in range(60)] + [(None, 3, "x"), (None, 9, None)]
    df = spark.createDataFrame(rows, "f string, n bigint, h string").repartition(3)
    last, expected, count, numbers = {}, [], {}, []
    for f, i, h in rows:
        last[f], count[f] = h or last.get(f), count.get(f, 0) + bool(h)
        expected.append((f, i, last[f]))
        numbers.append((f, i, count[f]))
    for block in (1, 7, 1000):
        same(windows.carry_forward(df, ["f"], "n", "h", "c", block), expected, ["f", "n", "c"])
        same(windows.group_numbers(df, ["f"], "n", F.col("h").isNotNull(), "g", block), numbers, ["f", "n", "g"])
    xs = [*range(8185, 8200), 1, 2, 2, 5, None, 16384]
    same(windows.islands(spark.createDataFrame([("a", x) for x in xs], "k string, x bigint"), ["k"], "x"), [("a", 1, 2, 2), ("a", 5, 5, 1), ("a", 8185, 8199, 15), ("a", 16384, 16384, 1)], ["k", "first", "last", "n"])
    end = F.lit("2025-03-01").cast("timestamp")
    at = lambda s: value(spark, windows.two_windows(F.lit(s).cast("timestamp"), end, "10 days"))
    assert [at(s) for s in ("2025-03-01", "2025-02-19 00:00:01", "2025-02-19", "2025-02-09", "2025-03-02")] == ["recent", "recent", "previous", None, None]
    assert windows.greedy_disjoint([(1, 3), (2, 5), (3, 4), (4, 6)]) == [True, False, False, True]
    same(windows.non_overlapping(spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("a", 4, 6), (None, 1, 2), (None, 2, 3)], "k string, s int, e int"), ["k"], "s", "e"), [("a", 1, 3), ("a", 4, 6), (None, 1, 2)], ["k", "s", "e"])
    assert value(spark, windows.adjacent_changes(F.array(*map(F.lit, "aabba")))) == 2


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize("limit", [0, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_graph_rounds_and_task_agree_with_brute_force(spark, limit, seed):
    rng = random.Random(seed)
    names = [f"v{i:02d}" for i in range(24)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(26)] + [("s", "s"), ("p", "q"), (None, "q")]
    reach = {(a, b) for a, b in pairs if a}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    same(G.cycle_members(edges(spark, pairs), limit), [(v,) for v in {a for a, b in reach if a == b}], ["vertex"])
    group = {v: v for p in pairs if p[0] for v in p}
    for _ in group:
        for a, b in pairs:
            if a:
                group[a] = group[b] = min(group[a], group[b])
    same(G.components(edges(spark, pairs), limit), list(group.items()), ["vertex", "component"])


def test_graph_edges(spark):
    e = edges(spark, [("domain", "service"), ("service", "domain"), ("domain", "service"), ("api", "domain"), ("domain", "domain")])
    same(G.cycle_members(e), [("domain",), ("service",)], ["vertex"])
    same(G.degrees(spark.createDataFrame([("domain",), ("api",), ("lone",)], "v string"), "v", e), [("domain", 1, 2), ("api", 1, 0), ("lone", 0, 0)], ["v", "outbound", "inbound"])
    same(G.layer_violations(e), [("domain", "service")], ["src", "dst"])
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "n string, p string")
    assert G.tree_check(nodes, "n", "p").first()["is_tree"] and not G.tree_check(nodes.union(spark.createDataFrame([("x", "gone")], "n string, p string")), "n", "p").first()["is_tree"]
    for f in (G.cycle_members, G.components):
        assert f(edges(spark, [])).count() == 0
    rules = [{"id": "r", "level": "error", "from": ["a*"], "deny": ["domain"]}, {"id": "s", "level": "error", "from": ["domain"], "allow": ["domain"]}]
    same(joins.rule_edges(e.distinct(), rules), [("domain", "service", "s", "not_allowed")], ["src", "dst", "rule_id", "reason"])


def test_sets_and_ranking(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["x", "y", "y", None], ["y", "z"]))
    same(sets.snapshot_sets(a, b, "k"), [("x", "introduced"), ("y", "inherited"), ("z", "resolved")], ["k", "disposition"])
    rows = [("g", f"m{i:03d}", rng) for i, rng in enumerate([5.0, None, 5.0, 9.0, 1.0] * 20)]
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
    for parts in (7, None):
        found = ranking.ranked(spark.createDataFrame(rows, "g string, m string, s double").repartition(4), ["g"], "s", "m", "position", parts)
        same(found, [(m, i, 100) for i, (_, m, _) in enumerate(order)], ["m", "position", "n"])
    two = spark.createDataFrame([("p", 0, 2, True), ("p", 1, 2, False), ("q", 0, 1, True)], "g string, position bigint, n bigint, hit boolean")
    same(ranking.ranking_metrics(two, ["g"], "hit"), [("p", 0.5, 1.0, 100.0, 2.0), ("q", 1.0, 1.0, 100.0, 1.0)], ["g", "precision_at_top", "recall_at_top", "mean_percentile_rank", "quarter_lift"])


def test_evidence(spark):
    empty, lit = F.array().cast("array<string>"), lambda *x: F.array(*map(F.lit, x))
    c = value(spark, evidence.confidence(F.lit(2), F.lit(2), empty, empty))
    assert c["complete"] and not c["partial"]
    c = value(spark, evidence.mark_partial(evidence.mark_partial(evidence.confidence(F.lit(2), F.lit(2), empty, empty), F.lit("r")), F.lit("r")))
    assert c["partial"] and not c["complete"] and c["missing_input"] == ["r"]
    f = lambda *a: value(spark, evidence.freshness(*map(F.lit, a)))
    assert [f("a", "a", True, True), f("a", "b", True, True), f("a", "b", True, False)] == ["current", "stale", "incomplete"]
    now = F.lit(datetime(2025, 1, 2)).cast("timestamp")
    assert value(spark, evidence.age_hours(F.lit(datetime(2025, 1, 1, 22, 1)).cast("timestamp"), now)) == 1
    assert value(spark, evidence.age_hours(F.lit(datetime(2025, 1, 2, 1)).cast("timestamp"), now)) is None
    assert value(spark, evidence.expired(F.lit(datetime(2025, 1, 1)).cast("timestamp"), now, 24)) is False
    assert [value(spark, evidence.waiver_expired(F.lit(e).cast("string"), F.lit(date(2025, 1, 1)))) for e in ("2025-01-01", "2024-12-31", "soon", None)] == [False, True, True, True]
    assert value(spark, sets.comparison_state(F.lit(True), F.lit(True), F.lit(False))) == "incomparable" and lit("a") is not None


def test_clones(spark):
    line = "let a = foo ( 1 , b ) + c ;"
    text = "\n".join(["fn x ( ) {"] + [line] * 12 + ["}"])
    files = spark.createDataFrame([("f1", text), ("f2", text.replace("foo", "bar").replace("1", "22")), ("f3", "short"), ("f4", None)], "f string, t string")
    found = clones.window_groups(clones.file_windows(files, "f", "t"), "f")
    assert found.count() > 0 and found.filter("n_files = 2").count() > 0
    picked = clones.disjoint_instances(clones.file_windows(files, "f", "t"), "f").collect()
    for a in picked:
        for b in picked:
            assert a is b or (a["window_hash"], a["f"]) != (b["window_hash"], b["f"]) or a["last_line"] < b["first_line"] or b["last_line"] < a["first_line"]
    lines = clones.with_line_counts(spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("b", 1, 2)], "f string, first_line bigint, last_line bigint"), "f", spark.createDataFrame([("a", "x();\n\t \n#[y]\nz();\n"), ("b", "pub struct A {\n  n: u8,\r\n}")], "f string, t string"), "t")
    same(lines, [("a", 1, [1, 3], True), ("a", 2, [3, 4], True), ("b", 1, [1, 2], False)], ["f", "first_line", "nonblank", "code"])
    same(clones.duplicated_lines(lines, "f"), [("a", 3), ("b", 2)], ["f", "n_lines"])


def test_an_existing_group_absorbs_the_next_in_key_order():
    """In key order 1-3, 7-9, 4-6: the last is absorbed by the first group it meets, and 7-9 stays."""
    kept, s, e = clones.absorb(np.array([[1, 7, 4], [11, 17, 14]]), np.array([[3, 9, 6], [13, 19, 16]]))
    assert (kept.tolist(), s.tolist(), e.tolist()) == ([0, 1], [[1, 7], [11, 17]], [[6, 9], [16, 19]])


def coalesced(texts: dict[str, str]) -> set:
    """Token clones one after another: windows by key, disjoint instances, the first group that overlaps place by place absorbs."""
    windows: dict[str, list] = {}
    for f, text in texts.items():
        tokens, lines = clones.normal_tokens(text)
        for k in range(len(tokens) - 49):
            if lines[k + 49] - lines[k] >= 2:
                windows.setdefault("|".join(tokens[k : k + 50]), []).append((f, lines[k], lines[k + 49]))
    groups: list[tuple[str, list]] = []
    for key in sorted(windows):
        picked, last = [], {}
        for f, s, e in sorted(windows[key]):
            if s > last.get(f, 0):
                last[f] = e
                picked.append([f, s, e])
        if len(picked) < 2:
            continue
        for _, old in groups:
            if len(old) == len(picked) and all(a[0] == b[0] and a[1] <= b[2] + 1 and b[1] <= a[2] + 1 for a, b in zip(old, picked)):
                for a, b in zip(old, picked):
                    a[1], a[2] = min(a[1], b[1]), max(a[2], b[2])
                break
        else:
            groups.append((key, picked))
    return {(hashlib.md5(key.encode()).hexdigest(), *i) for key, instances in groups for i in instances}


def test_coalescing_against_one_after_another(spark):
    rng = random.Random(4)
    parts = ["\n".join(f"let v{rng.randint(0, 3)} = f{i} ( {rng.randint(0, 9)} , x ) + {'y' * (rng.random() < 0.5)} ;" for _ in range(14)) for i in range(3)]
    license = "\n".join("// a b c d e f g h ; i , j" for _ in range(12))
    texts = {f"f{k}": "\n".join([license, *([] if k % 2 else ["", "gap ;"]), *(rng.choice(parts) for _ in range(3))]) for k in range(6)}
    files = spark.createDataFrame(list(texts.items()), "f string, t string")
    instances = clones.disjoint_instances(clones.file_windows(files, "f", "t"), "f")
    expected = coalesced(texts)
    assert len(expected) > 20
    same(clones.coalesce_groups(instances, "f", files, "t"), sorted(expected), ["group_id", "f", "first_line", "last_line"])


def test_clones_lie_in_functions_and_blank_lines_do_not_count(spark):
    body = "\n".join(["    let a = foo ( 1 , b ) + c ;", ""] * 12)
    outside = "\n".join("use a :: b :: { c , d } ;" for _ in range(12))
    files = spark.createDataFrame([(f, f"{outside}\npub fn {f}(x: u8) -> u8 {{\n{body}\n}}\n") for f in ("one", "two")], "f string, t string")
    spans = functions_of(files, "f", "t")
    same(spans, [("one", "one", 13, 38, 14, 0, 0), ("two", "two", 13, 38, 14, 0, 0)], ["f", "qualified_name", "start_line", "end_line", "source_line_count", "branch_pressure", "max_nesting_depth"])
    inside = clones.within_functions(clones.file_windows(files, "f", "t"), "f", spans)
    assert inside.filter("first_line < 13 or last_line > 38").count() == 0
    rows, instances = clones.clone_rows(clones.coalesce_groups(clones.disjoint_instances(inside, "f"), "f", files, "t"), "f", files, "t")
    assert rows.filter("file_count = 2").count() > 0
    summary = clones.clone_summary(rows, instances, "f", files, "t").first().asDict()
    assert summary["source_nonblank_line_count"] == 52 and 0 < summary["duplicated_line_count"] <= 28
    assert summary["duplication_percent"] == round(100 * summary["duplicated_line_count"] / 52, 2)
