"""Joins, sets and graphs as queries over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import delta_percent, percent, round2
from ..functions.scores import crap
from ..functions.text import last_segment, module_key, module_layer
from ..operators import graph as G
from ..operators import joins as J
from ..operators.sets import snapshot_sets
from ..operators.stats import association, concentration, exact_sum
from ..operators.windows import two_windows
from ..tables import last_delivery, load
from .measures import _COMMITS_SQL, _R2, _commits, _modules

_OWN_SQL = "own as (select * from (select *, row_number() over (partition by module_id order by scanned_at desc nulls last) rn from file_facts where module_id is not null) where rn = 1)"


def coalesced_key_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn of each module by its id, else by its readable key."""
    churn = _commits(spark, sf_dir).select(F.explode("modules").alias("k"), "churn").groupBy("k").agg(F.sum("churn").cast("double").alias("v"))
    readable = churn.withColumn("k", F.array_join(F.slice(F.split("k", "::"), 3, 100), "::")).groupBy("k").agg(F.max("v").alias("v"))
    return J.coalesced_key_join(_modules(spark, sf_dir).select("module_id", "module_key"), churn.unionByName(readable), ["module_id", "module_key"], "k", "v", "churn")


def range_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a customer's orders (30 days from the order) with the customer's items shipped inside: n, hits, and the score of risk that follows."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("lo")).withColumn("hi", F.col("lo") + 30)
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", F.unix_date(F.to_date("l_shipdate")).cast("bigint").alias("day"), (F.col("l_quantity") > 25).alias("covered"))
    points = items.join(orders.select(F.col("o_orderkey").alias("_o"), F.col("cust").alias("p_cust")), F.col("l_orderkey") == F.col("_o")).select("p_cust", "day", "covered")
    found = J.range_counts(orders, ["o_orderkey"], "lo", "hi", points, "day", F.col("covered"), [("p_cust", "cust")], 32)
    covered = percent(F.col("n_hits"), F.col("n_points"), None)
    return found.select("o_orderkey", "n_points", "n_hits", round2(covered).alias("coverage"), round2(crap(F.col("n_points") + 1, F.coalesce(covered / 100, F.lit(0.0)))).alias("crap"))


def changed_range_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items shipped on changed days of their supplier; overlapping ranges count an item once."""
    ranges = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("r_supp"), F.explode(F.array(*(F.lit(x).cast("bigint") for x in (9000, 9100, 9150)))).alias("r_lo")).withColumn("r_hi", F.col("r_lo") + 80 + F.col("r_supp") % 40)
    items = load(spark, sf_dir, "lineitem").select("l_suppkey", F.unix_date(F.to_date("l_shipdate")).cast("bigint").alias("day"), "l_quantity")
    hit = J.range_join(items, "day", ranges, "r_lo", "r_hi", [("l_suppkey", "r_supp")], 64, "left_semi")
    return hit.groupBy("l_suppkey").agg(F.count("*").alias("n_items"), F.count_if(F.col("l_quantity") > 25).alias("n_covered"))


def interval_containment(spans: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose days from first to last shipment lie inside a window of their priority."""
    spark = spans
    shipped = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.unix_date(F.to_date("l_shipdate"))).cast("bigint").alias("s"), F.max(F.unix_date(F.to_date("l_shipdate"))).cast("bigint").alias("e"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    windows = orders.groupBy(F.col("o_orderpriority").alias("w_priority")).agg((F.min("s") + 100).alias("w_lo"), (F.max("e") - 400).alias("w_hi"))
    return J.contained_semi_join(orders, "s", "e", windows, "w_lo", "w_hi", [("o_orderpriority", "w_priority")], 256).groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.sum(F.col("e") - F.col("s")).cast("bigint").alias("span"))


def _half(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    orders = load(spark, sf_dir, "orders").filter((F.year("o_orderdate") >= 1996) if late else (F.year("o_orderdate") < 1996))
    return orders.groupBy("o_custkey").agg(exact_sum(F.col("o_totalprice"), 2).alias("v"), F.count("*").alias("n"))


def baseline_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of two periods by customer, compared by intervals of 20 per cent; a side with under 3 samples has none."""
    side = lambda late: _half(spark, sf_dir, late).select("o_custkey", F.struct("v", "n").alias("r"))
    both = J.full_outer_compare(side(True), side(False), "o_custkey", "r")
    span = lambda s: (F.col(f"{s}.v"), F.when(F.col(f"{s}.n") >= 3, F.col(f"{s}.v") * 0.8), F.when(F.col(f"{s}.n") >= 3, F.col(f"{s}.v") * 1.2))
    return both.select("o_custkey", F.col("current.v").alias("current"), F.col("baseline.v").alias("baseline"), round2(delta_percent(F.col("current.v"), F.col("baseline.v"))).alias("delta_percent"), J.interval_direction(span("current"), span("baseline"), F.lit(True)).alias("direction"))


def score_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas against a baseline in which some customers are missing."""
    found = J.baseline_deltas(_half(spark, sf_dir, True), _half(spark, sf_dir, False), "o_custkey", "v")
    return found.withColumn("delta", round2(F.col("delta")))


def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest known module that a scope's module lies in, with proper ancestors alone."""
    scopes = load(spark, sf_dir, "lexical").select("module_key").distinct()
    return J.longest_prefix_join(scopes, "module_key", _modules(spark, sf_dir), "module_id", name="ancestor", proper=True)


def suffix_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that a short label names: the label is the id or its end."""
    own = _modules(spark, sf_dir)
    labels = own.filter(F.col("function_count") >= 10).select(last_segment(F.col("module_id")).alias("label"))
    return J.suffix_semi_join(own.select("module_id"), "module_id", labels, "label")


def first_match_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key of a file under which a commit count is known: id, readable key, key by path, package."""
    counts = _commits(spark, sf_dir).select(F.explode("modules").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    tails = counts.select(F.element_at(F.split("k", "::"), 1).alias("k"), "n").groupBy("k").agg(F.min("n").alias("n"))
    own = _modules(spark, sf_dir).select("module_id", "module_key", "path", "package_name")
    found = J.first_match(own, ["module_id"], [F.col("module_id"), F.col("module_key"), module_key(F.col("path")), F.col("package_name")], counts.unionByName(tails), "k", "n", "commits")
    return found.select("module_id", "commits")


def exactly_one_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable keys that name one module, several or none."""
    own = _modules(spark, sf_dir)
    selectors = own.select(F.col("module_key").alias("selector")).distinct()
    return J.exactly_one(selectors, "selector", own, "module_key", "module_id")


def guarded_impls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes joined to the module of their readable name only where it is unique; the others abstain with a reason."""
    own = _modules(spark, sf_dir).select(F.col("project_key").alias("t_project"), F.col("module_key").alias("t_key"), F.col("module_id").alias("t_module"))
    scopes = load(spark, sf_dir, "lexical").select("project_key", F.array_join(F.slice(F.split("module_key", "::"), 3, 100), "::").alias("readable"), "module_key")
    joined, abstained = J.guarded_join(scopes, own, [("project_key", "t_project"), ("readable", "t_key")])
    both = joined.select(F.lit("joined").alias("outcome"), (F.col("t_module") == F.col("module_key")).alias("same")).unionByName(abstained.select(F.col("reason").alias("outcome"), F.lit(None).cast("boolean").alias("same")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"))


MOST_MODULES = 50


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that are no merges with modules, by window of 90 days before the repository's head: recent or previous; ``large`` beyond 50 modules."""
    own = _commits(spark, sf_dir).filter(~F.coalesce("is_merge", F.lit(False)) & (F.size("modules") > 0))
    end = own.groupBy("repo_key").agg(F.max("committed_at").alias("head")).withColumnRenamed("repo_key", "_r")
    placed = own.join(end, F.col("repo_key") == F.col("_r")).withColumn("window", two_windows(F.col("committed_at"), F.col("head"), "90 days"))
    return placed.filter(F.col("window").isNotNull()).withColumn("large", F.size("modules") > MOST_MODULES)


def cochange_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of modules in commits of the last 90 days: support, conditional rates, lift, and whether either depends on the other.

    Commits of more than 50 modules are left out, which bounds a commit's pairs;
    maintenance_windows counts them. Merges don't count.
    """
    recent = _windows(spark, sf_dir).filter((F.col("window") == "recent") & ~F.col("large")).select("repo_key", F.array_sort("modules").alias("m"))
    n = recent.groupBy(F.col("repo_key").alias("_n_repo")).agg(F.count("*").alias("eligible"))
    single = recent.select("repo_key", F.explode("m").alias("a")).groupBy("repo_key", "a").agg(F.count("*").alias("n"))
    pair = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = recent.filter(F.size("m") > 1).select("repo_key", F.explode(pair).alias("p")).groupBy("repo_key", "p.a", "p.b").agg(F.count("*").alias("n_ab")).filter("n_ab >= 2")
    a = single.withColumnsRenamed({"repo_key": "_ra", "a": "_a", "n": "n_a"})
    b = single.withColumnsRenamed({"repo_key": "_rb", "a": "_b", "n": "n_b"})
    joined = pairs.join(a, (F.col("repo_key") == F.col("_ra")) & (F.col("a") == F.col("_a"))).join(b, (F.col("repo_key") == F.col("_rb")) & (F.col("b") == F.col("_b"))).join(n, F.col("repo_key") == F.col("_n_repo"))
    either = _module_edges(spark, sf_dir).select(F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi")).distinct()
    joined = joined.join(either, (F.col("a") == F.col("_lo")) & (F.col("b") == F.col("_hi")), "left")
    return joined.select("repo_key", F.col("a").alias("module_a"), F.col("b").alias("module_b"), "n_ab", *association(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("eligible")), F.col("_lo").isNotNull().alias("observed_static_dependency"))


def maintenance_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of each repository and window: eligible, excluded as large, and modules a commit."""
    n = F.when(~F.col("large"), F.size("modules"))
    return _windows(spark, sf_dir).groupBy("repo_key", "window").agg(F.count(n).alias("eligible_commits"), F.count_if("large").alias("excluded_large_commits"), round2(F.avg(n)).alias("mean_modules"), F.median(n).alias("median_modules"), F.max(n).cast("bigint").alias("max_modules"))


def previous_owner_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary author of each module in the previous window, and whether and when the recent one saw them last."""
    own = _windows(spark, sf_dir).filter(~F.col("large") & F.col("author").isNotNull())
    touched = own.filter(F.col("window") == "previous").select("repo_key", "author", F.explode("modules").alias("module_id"))
    primary = concentration(touched, ["repo_key", "module_id"], "author").select("repo_key", "module_id", F.col("primary").alias("previous_primary_author"))
    seen = own.filter(F.col("window") == "recent").groupBy(F.col("repo_key").alias("_r"), F.col("author").alias("_a")).agg(F.max("committed_at").alias("last_recent_commit"))
    joined = primary.join(seen, (F.col("repo_key") == F.col("_r")) & (F.col("previous_primary_author") == F.col("_a")), "left")
    return joined.select("repo_key", "module_id", "previous_primary_author", F.col("_a").isNotNull().alias("observed_recently"), "last_recent_commit")


def two_window_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of each author in two adjacent windows of 30 days before the repository's head, and when they were last seen."""
    own = _commits(spark, sf_dir).filter(F.col("author").isNotNull())
    end = own.groupBy("repo_key").agg(F.max("committed_at").alias("head")).withColumnRenamed("repo_key", "_r")
    window = two_windows(F.col("committed_at"), F.col("head"), "30 days")
    return own.join(end, F.col("repo_key") == F.col("_r")).groupBy("repo_key", "author").agg(F.count_if(window == "recent").alias("recent"), F.count_if(window == "previous").alias("previous"), F.max("committed_at").alias("last_seen"))


def snapshot_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of two days as findings of two snapshots."""
    day = lambda d: load(spark, sf_dir, "events").filter(F.dayofmonth("ts") == d).select("user_id")
    return snapshot_sets(day(20), day(10), "user_id")


def _module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module to module, by scopes whose parent lies in another module."""
    scopes = last_delivery(load(spark, sf_dir, "lexical").filter(F.col("id").isNotNull() & F.col("module_key").isNotNull()).select("id", "parent_id", "module_key", "captured_at"), ["id"], "captured_at")
    parents = scopes.select(F.col("id").alias("_p"), F.col("module_key").alias("dst"))
    return scopes.join(parents, F.trim("parent_id") == F.col("_p")).filter(F.col("module_key") != F.col("dst")).select(F.col("module_key").alias("src"), "dst").distinct()


_EDGES_SQL = """
sc as (select id, trim(parent_id) parent, module_key from (select *, row_number() over (partition by id order by captured_at desc nulls last) rn from lexical where id is not null and module_key is not null) where rn = 1),
ed as (select distinct a.module_key src, b.module_key dst from sc a join sc b on a.parent = b.id where a.module_key <> b.module_key)"""


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _module_edges(spark, sf_dir)


def module_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.degrees(_modules(spark, sf_dir).select("module_id"), "module_id", _module_edges(spark, sf_dir))
    return found.select("module_id", F.col("outbound").cast("bigint").alias("outbound"), F.col("inbound").cast("bigint").alias("inbound"))


def module_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycle_members(_module_edges(spark, sf_dir))


def module_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(_module_edges(spark, sf_dir))


def module_components_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module_components by rounds of joins, as graphs of more than TASK_EDGES edges are solved."""
    return G.components(_module_edges(spark, sf_dir), task_edges=0)


def nation_cycles_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation_cycles by rounds of joins, as graphs of more than TASK_EDGES edges are solved."""
    return G.cycle_members(_trade(spark, sf_dir), task_edges=0)


def nation_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in cycles of trade from customer to supplier."""
    return G.cycle_members(_trade(spark, sf_dir))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from the nation of a customer to that of a supplier."""
    o, c, i, s = (load(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "supplier"))
    trade = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return trade.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.layer_violations(_module_edges(spark, sf_dir))


def module_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _modules(spark, sf_dir)
    return own.groupBy(module_layer(F.col("module_key"), F.col("is_entrypoint")).alias("layer")).agg(F.count("*").alias("n_modules"))


def scope_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the regions and nations, as parents and children, form one tree."""
    region = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("parent"))
    nation = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    world = spark.createDataFrame([("world", None)], "node string, parent string")
    return G.tree_check(world.unionByName(region).unionByName(nation), "node", "parent")


RULES = [
    {"id": "no-core-to-lib", "level": "error", "from": ["**::main::**"], "deny": ["*::*::lib"]},
    {"id": "lib-stays-home", "level": "warning", "from": ["*::*::lib"], "allow": ["*::*::lib", "*::*::lib::**"]},
    {"id": "off", "level": "off", "from": ["**"], "deny": ["**"]},
]


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.rule_edges(_module_edges(spark, sf_dir), RULES)


QUERIES = {f.__name__: f for f in (
    coalesced_key_metric, range_join_coverage, changed_range_semi, interval_containment, baseline_full_outer, score_deltas, longest_prefix_match, suffix_label_match, first_match_priority, exactly_one_resolution,
    guarded_impls, cochange_windows, maintenance_windows, previous_owner_activity, two_window_activity, snapshot_dispositions, module_edges, module_degrees, module_cycles, module_components, module_components_distributed, nation_cycles, nation_cycles_distributed, layer_violations, module_layers, scope_trees, rule_violations,
)}

_DAY = lambda c: f"({c}::date - date '1970-01-01')"
_HALF_SQL = """
cur as (select o_custkey, sum(o_totalprice::decimal(30,2))::double v, count(*) n from orders where year(o_orderdate) >= 1996 group by 1),
bas as (select o_custkey, sum(o_totalprice::decimal(30,2))::double v, count(*) n from orders where year(o_orderdate) < 1996 group by 1)"""
_LAYER_SQL = lambda c: f"""case when list_has_any(regexp_split_to_array(lower({c}), '/|::'), ['api','cli','controller','controllers','handler','handlers','http','route','routes','ui','web']) then 'Interface'
  when list_has_any(regexp_split_to_array(lower({c}), '/|::'), ['app','application','command','commands','service','services','use_case','use_cases','workflow','workflows']) then 'Application'
  when list_has_any(regexp_split_to_array(lower({c}), '/|::'), ['core','domain','entity','entities','model','models']) then 'Domain'
  when list_has_any(regexp_split_to_array(lower({c}), '/|::'), ['adapter','adapters','database','db','file','fs','infra','infrastructure','io','persistence','repository','storage']) then 'Infrastructure'
  when list_has_any(regexp_split_to_array(lower({c}), '/|::'), ['spec','specs','test','tests']) then 'Tests' else 'Unclassified' end"""  # noqa: E731
_WINDOWS_SQL = """
wc as (select * from cm where not coalesce(is_merge, false) and len(modules) > 0), wh as (select repo_key, max(committed_at) head from wc group by 1),
wi as (select wc.*, case when committed_at > head - interval 90 days then 'recent' else 'previous' end win from wc join wh on wh.repo_key = wc.repo_key where committed_at > head - interval 180 days)"""
_REACH_SQL = "reach as (select src, dst from e union select r.src, e.dst from reach r join e on r.dst = e.src)"
SQL = {
    "coalesced_key_metric": f"""
with {_COMMITS_SQL}, {_OWN_SQL}, ch as (select k, sum(churn)::double v from (select unnest(modules) k, churn from cm) group by 1),
m as (select k, max(v) v from (select k, v from ch union all select array_to_string(list_slice(string_split(k, '::'), 3, 100), '::'), v from ch) group by 1)
select module_id, module_key, coalesce(a.v, b.v) churn from own left join m a on a.k = module_id left join m b on b.k = module_key""",
    "range_join_coverage": f"""
with o as (select o_orderkey, o_custkey, {_DAY('o_orderdate')} lo, {_DAY('o_orderdate')} + 30 hi from orders), p as (select o_custkey c, {_DAY('l_shipdate')} d, l_quantity > 25 h from lineitem join orders on o_orderkey = l_orderkey),
g as (select o_orderkey, count(c) n_points, count(*) filter (where h) n_hits from o left join p on c = o_custkey and d between lo and hi group by 1)
select *, {_R2('100.0::double * n_hits / nullif(n_points, 0)')} coverage, {_R2('(n_points + 1)::double * (n_points + 1) * pow(1 - coalesce(n_hits::double / nullif(n_points, 0), 0), 3) + n_points + 1')} crap from g""",
    "changed_range_semi": f"""
with r as (select s_suppkey s, unnest([9000, 9100, 9150]) lo from supplier)
select l_suppkey, count(*) n_items, count(*) filter (where l_quantity > 25) n_covered from lineitem where exists (select 1 from r where s = l_suppkey and {_DAY('l_shipdate')} between lo and lo + 80 + s % 40) group by 1""",
    "interval_containment": f"""
with o as (select o_orderkey, o_orderpriority, min({_DAY('l_shipdate')}) s, max({_DAY('l_shipdate')}) e from orders join lineitem on l_orderkey = o_orderkey group by all), w as (select o_orderpriority p, min(s) + 100 lo, max(e) - 400 hi from o group by 1)
select o_orderpriority, count(*) n_orders, sum(e - s)::bigint span from o join w on p = o_orderpriority where lo <= s and e <= hi group by 1""",
    "baseline_full_outer": f"""
with {_HALF_SQL}, j as (select coalesce(c.o_custkey, b.o_custkey) o_custkey, c.v cv, c.n cn, b.v bv, b.n bn from cur c full outer join bas b on c.o_custkey = b.o_custkey)
select o_custkey, cv "current", bv baseline, {_R2('100.0::double * (cv - bv) / nullif(bv, 0)')} delta_percent,
  case when cn >= 3 and bn >= 3 then case when cv * 0.8::double > bv * 1.2::double then 'regressed' when cv * 1.2::double < bv * 0.8::double then 'improved' else 'within_noise' end else 'incomparable' end direction from j""",
    "score_deltas": f"""
with {_HALF_SQL} select c.o_custkey, c.v "current", coalesce(b.v, 0.0::double) baseline, {_R2('c.v - coalesce(b.v, 0)')} delta, b.o_custkey is null is_new,
  case when b.o_custkey is null then 'new' when c.v - b.v > 0 then 'regressed' when c.v - b.v < 0 then 'improved' else 'unchanged' end direction from cur c left join bas b on c.o_custkey = b.o_custkey""",
    "longest_prefix_match": f"""
with {_OWN_SQL}, s as (select distinct module_key from lexical) select module_key, (select arg_max(module_id, length(module_id)) from own where starts_with(s.module_key, module_id || '::')) ancestor from s""",
    "suffix_label_match": f"""
with {_OWN_SQL}, l as (select distinct list_last(string_split(module_id, '::')) as lb from own where function_count >= 10) select module_id from own where exists (select 1 from l where module_id = lb or module_id like '%::' || lb)""",
    "first_match_priority": f"""
with {_COMMITS_SQL}, {_OWN_SQL}, c as (select k, count(*) n from (select unnest(modules) k from cm) group by 1), t as (select k, min(n) n from (select k, n from c union all select string_split(k, '::')[1], n from c) group by 1),
j as (select module_id, module_id k1, module_key k2, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(path, '^(.*/)?src/', ''), '\\.rs$', ''), '/'), lambda s: s <> 'mod' and s <> ''), '::') k3, package_name k4 from own)
select module_id, coalesce(a.n, b.n, c3.n, d.n) commits from j left join t a on a.k = k1 left join t b on b.k = k2 left join t c3 on c3.k = k3 left join t d on d.k = k4""",
    "exactly_one_resolution": f"""
with {_OWN_SQL} select module_key selector, count(*) n_matches, case when count(*) = 1 then 'resolved' else 'ambiguous' end resolution, case when count(*) = 1 then min(module_id) end module_id from own where module_key is not null group by 1
union all select distinct null, 0, 'unresolved', null from own where module_key is null""",
    "guarded_impls": f"""
with {_OWN_SQL}, k as (select project_key, module_key, count(*) n, min(module_id) id from own group by all),
s as (select project_key, module_key mk, array_to_string(list_slice(string_split(module_key, '::'), 3, 100), '::') readable from lexical),
j as (select case when n = 1 then 'joined' when n > 1 then 'ambiguous' else 'unresolved' end outcome, n = 1 and id = mk same from s left join k on k.project_key = s.project_key and k.module_key = readable)
select outcome, count(*) n, count(*) filter (where same) n_same from j group by 1""",
    "cochange_windows": f"""
with {_COMMITS_SQL}, {_WINDOWS_SQL}, {_EDGES_SQL}, r as (select hash, repo_key, modules from wi where win = 'recent' and len(modules) <= 50),
i as (select hash, repo_key, unnest(modules) m from r), s as (select repo_key, m, count(*) n from i group by all), n as (select repo_key, count(*) e from r group by 1),
p as (select a.repo_key, a.m ma, b.m mb, count(*) n_ab from i a join i b on a.hash = b.hash and a.m < b.m group by all having count(*) >= 2)
select p.repo_key, ma module_a, mb module_b, n_ab, {_R2('100.0::double * n_ab / e')} support, {_R2('100.0::double * n_ab / sa.n')} b_given_a, {_R2('100.0::double * n_ab / sb.n')} a_given_b, {_R2('n_ab::double * e / (sa.n::double * sb.n)')} lift,
  exists (select 1 from ed where (src = ma and dst = mb) or (src = mb and dst = ma)) observed_static_dependency
  from p join s sa on sa.repo_key = p.repo_key and sa.m = ma join s sb on sb.repo_key = p.repo_key and sb.m = mb join n on n.repo_key = p.repo_key""",
    "maintenance_windows": f"""
with {_COMMITS_SQL}, {_WINDOWS_SQL}, k as (select *, case when len(modules) <= 50 then len(modules) end n from wi)
select repo_key, win "window", count(n) eligible_commits, count(*) filter (where n is null) excluded_large_commits, {_R2('avg(n)')} mean_modules, median(n)::double median_modules, max(n)::bigint max_modules from k group by all""",
    "previous_owner_activity": f"""
with {_COMMITS_SQL}, {_WINDOWS_SQL}, o as (select * from wi where len(modules) <= 50 and author is not null),
e as (select repo_key, module_id, author, count(*) n from (select repo_key, unnest(modules) module_id, author from o where win = 'previous') group by all),
p as (select repo_key, module_id, author from (select *, row_number() over (partition by repo_key, module_id order by n desc, author) r from e) where r = 1), s as (select repo_key, author, max(committed_at) t from o where win = 'recent' group by all)
select p.repo_key, module_id, p.author previous_primary_author, t is not null observed_recently, t last_recent_commit from p left join s on s.repo_key = p.repo_key and s.author = p.author""",
    "two_window_activity": f"""
with {_COMMITS_SQL}, c as (select * from cm where author is not null), h as (select repo_key, max(committed_at) head from c group by 1)
select c.repo_key, author, count(*) filter (where committed_at > head - interval 30 days) recent, count(*) filter (where committed_at <= head - interval 30 days and committed_at > head - interval 60 days) previous, max(committed_at) last_seen from c join h on h.repo_key = c.repo_key group by all""",
    "snapshot_dispositions": """
with c as (select distinct user_id from events where day(ts) = 20 and user_id is not null), b as (select distinct user_id from events where day(ts) = 10 and user_id is not null)
select coalesce(c.user_id, b.user_id) user_id, case when c.user_id is null then 'resolved' when b.user_id is null then 'introduced' else 'inherited' end disposition from c full outer join b on c.user_id = b.user_id""",
    "module_edges": f"with {_EDGES_SQL} select * from ed",
    "module_degrees": f"with {_OWN_SQL}, {_EDGES_SQL} select module_id, (select count(*) from ed where src = module_id)::bigint outbound, (select count(*) from ed where dst = module_id)::bigint inbound from own",
    "module_cycles": f"with recursive {_EDGES_SQL}, e as (select * from ed), {_REACH_SQL} select distinct src vertex from reach where src = dst",
    "module_components": f"with recursive {_EDGES_SQL}, e as (select src, dst from ed union select dst, src from ed), {_REACH_SQL} select src vertex, least(src, min(dst)) component from reach group by 1",
    "nation_cycles": f"""
with recursive e as (select distinct c_nationkey src, s_nationkey dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey), {_REACH_SQL}
select distinct src::varchar vertex from reach where src = dst""",
    "layer_violations": f"""
with {_EDGES_SQL}, l as (select src, dst, {_LAYER_SQL('src')} src_layer, {_LAYER_SQL('dst')} dst_layer from ed), r as (select unnest(['Interface', 'Application', 'Infrastructure', 'Domain']) n, unnest([4, 3, 3, 2]) k)
select src, dst, src_layer, dst_layer from l join r a on a.n = src_layer join r b on b.n = dst_layer where a.k < b.k""",
    "module_layers": f"with {_OWN_SQL} select case when is_entrypoint then 'Entrypoint' when module_key is not null then {_LAYER_SQL('module_key')} end layer, count(*) n_modules from own group by 1",
    "scope_trees": "select 1::bigint n_roots, 0::bigint n_dangling, 0::bigint n_looping, not exists (select 1 from nation where n_regionkey not in (select r_regionkey from region)) is_tree",
    "rule_violations": f"""
with {_EDGES_SQL}
select src, dst, 'no-core-to-lib' rule_id, 'error' "level", 'denied' reason from ed where regexp_matches(src, '(^|::)main(::|$)') and len(string_split(dst, '::')) = 3 and dst like '%::lib'
union all select src, dst, 'lib-stays-home', 'warning', 'not_allowed' from ed where len(string_split(src, '::')) = 3 and src like '%::lib' and string_split(dst, '::')[3] is distinct from 'lib'""",
}
SQL["module_components_distributed"], SQL["nation_cycles_distributed"] = SQL["module_components"], SQL["nation_cycles"]
