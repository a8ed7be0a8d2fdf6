"""What changed between consecutive full snapshots (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import last_delivery, load

NULL_TOKEN = "\x00null"
BLOCK = 4096


def canonical_hash(values: Sequence[Column]) -> Column:
    """64-bit hash of values made comparable: null is unlike any value, numbers keep two decimals."""
    return F.xxhash64(F.concat_ws("\x01", *(F.coalesce(v.cast("string"), F.lit(NULL_TOKEN)) for v in values)))


def two_decimals(value: Column) -> Column:
    """Rounded half up on the decimal expansion; -0.0 counts as 0.0."""
    return F.round(value.cast("double"), 2) + F.lit(0.0)


def with_neighbours(headers: DataFrame, scope: Sequence[str], seq: str, block: int = BLOCK) -> DataFrame:
    """Add prev_seq and next_seq, the nearest lower and higher ``seq`` of the scope.

    ``seq`` is a bigint and (scope, seq) is unique. The window runs over blocks of
    ``block`` numbers; only one row a block (its ends) enters a window over the whole
    scope, so a scope that holds a third of all headers is still sorted by many tasks.
    """
    headers = headers.withColumn("_block", F.floor(F.col(seq) / block))
    ends = headers.groupBy(*scope, "_block").agg(F.min(seq).alias("_lo"), F.max(seq).alias("_hi"))
    over = Window.partitionBy(*scope).orderBy("_block")
    ends = ends.select(*(F.col(c).alias(f"_e_{c}") for c in scope), F.col("_block").alias("_e_block"), F.lag("_hi").over(over).alias("_before"), F.lead("_lo").over(over).alias("_after"))
    inside = Window.partitionBy(*scope, "_block").orderBy(seq)
    found = headers.select("*", F.lag(seq).over(inside).alias("_lag"), F.lead(seq).over(inside).alias("_lead"))
    same = F.col("_block") == F.col("_e_block")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    return (
        found.join(ends, same, "left")
        .withColumn("prev_seq", F.coalesce("_lag", "_before"))
        .withColumn("next_seq", F.coalesce("_lead", "_after"))
        .drop("_block", "_e_block", "_before", "_after", "_lag", "_lead", *(f"_e_{c}" for c in scope))
    )


def diff_records(records: DataFrame, scope: Sequence[str], seq: str, key: str, row_hash: str) -> DataFrame:
    """Full outer join of each snapshot's records with those of the snapshot before.

    ``records`` has scope, seq, key, row_hash, prev_seq and next_seq (see
    with_neighbours) and one row per (scope, seq, key). A record meets its successor
    under (scope, the later snapshot's number, key): a side that is missing makes an
    addition or a removal, unequal hashes make a change. Returns scope, seq, key and
    change_kind; a snapshot without predecessor gives nothing. The join key holds the
    record's key, so a scope with a third of all rows is spread over all tasks.
    """
    later = records.filter(F.col("prev_seq").isNotNull()).select(*scope, F.col(seq), F.col(key), F.col(row_hash).alias("_new"))
    earlier = records.filter(F.col("next_seq").isNotNull()).select(*(F.col(c).alias(f"_p_{c}") for c in scope), F.col("next_seq").alias("_p_seq"), F.col(key).alias("_p_key"), F.col(row_hash).alias("_old"))
    same = (F.col(seq) == F.col("_p_seq")) & F.col(key).eqNullSafe(F.col("_p_key"))
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    joined = later.join(earlier, same, "full_outer").withColumn("change_kind", kind).filter(F.col("change_kind").isNotNull())
    left = F.col("_new").isNotNull()
    return joined.select(*(F.when(left, F.col(c)).otherwise(F.col(f"_p_{c}")).alias(c) for c in scope), F.coalesce(seq, "_p_seq").alias(seq), F.when(left, F.col(key)).otherwise(F.col("_p_key")).alias(key), "change_kind")


def _key(*parts: str):
    return lambda r: F.concat_ws("/", *(F.coalesce(r[p], F.lit("")) for p in parts))


#: Of each section of a policy report: its records' key and the values that are compared.
SECTIONS = {
    "score_deltas": (_key("module"), lambda r: [two_decimals(r["baseline_score"]), two_decimals(r["current_score"])]),
    "evidence_deltas": (_key("metric", "benchmark"), lambda r: [two_decimals(r["baseline_value"]), two_decimals(r["current_value"]), r["status"]]),
    "regressions": (_key("metric", "subject"), lambda r: [two_decimals(r["delta"])]),
}


def policy_changes(snapshots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Records added, removed or changed between a project's consecutive policy snapshots.

    Deliveries of one (project_key, snapshot_no) collapse to the last. A null section
    was not evaluated and is passed over; an empty one has no records. Null elements
    are no records; null key parts count as empty text; repeats of a record within a
    section count once (of unequal repeats, the one with the greatest hash). Rows
    without snapshot_no are no snapshot; a null project is a project of its own.
    Columns besides those of the report are ignored.
    """
    project = F.coalesce("project_key", F.lit(NULL_TOKEN))  # plain equality keeps the partitioning by (project, snapshot_no)

    def slim(section: str) -> Column:
        """Sorted (record_key, row_hash) of a section, the greatest hash of each key; null stays null."""
        key, values = SECTIONS[section]
        records = F.filter(F.col(section), lambda r: r.isNotNull())
        rows = F.array_sort(F.transform(records, lambda r: F.struct(key(r).alias("record_key"), canonical_hash(values(r)).alias("row_hash"))))
        last = lambda a: F.filter(a, lambda x, i: ~x["record_key"].eqNullSafe(F.get(a, i + 1)["record_key"]))
        return F.get(F.transform(F.array(rows), last), F.lit(0))

    rows = snapshots.filter(F.col("snapshot_no").isNotNull()).select(project.alias("project_key"), "snapshot_no", "delivered_at", *(slim(s).alias(s) for s in SECTIONS)).withColumn("_hash", F.xxhash64(*SECTIONS))
    delivered = ["project_key", "snapshot_no"]
    reports = last_delivery(rows, delivered, "delivered_at", ["_hash"])
    present = F.array_compact(F.array(*(F.when(F.col(s).isNotNull(), F.lit(s)) for s in SECTIONS)))
    headers = last_delivery(rows.select(*delivered, "delivered_at", "_hash", present.alias("present")), delivered, "delivered_at", ["_hash"])
    linked = with_neighbours(headers.select(*delivered, F.explode("present").alias("section")), ["project_key", "section"], "snapshot_no", block)
    ends = linked.groupBy(*delivered).agg(*(F.max(F.when(F.col("section") == s, F.struct("prev_seq", "next_seq"))).alias(f"_{s}") for s in SECTIONS))
    sections = F.array(*(F.struct(F.lit(s).alias("section"), F.col(f"_{s}.prev_seq").alias("prev_seq"), F.col(f"_{s}.next_seq").alias("next_seq"), F.col(s).alias("records")) for s in SECTIONS))
    records = reports.join(ends, delivered).select(*delivered, F.explode(sections).alias("s")).select(*delivered, "s.section", "s.prev_seq", "s.next_seq", F.explode("s.records").alias("r")).select(*delivered, "section", "prev_seq", "next_seq", "r.record_key", "r.row_hash")
    found = diff_records(records, ["project_key", "section"], "snapshot_no", "record_key", "row_hash")
    return found.select(F.nullif("project_key", F.lit(NULL_TOKEN)).alias("project_key"), "snapshot_no", "section", "record_key", "change_kind")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_changes(load(spark, sf_dir, "policy_snapshots"))


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes a project, section and kind: the size of each delta feed."""
    return p1_found(spark, sf_dir).groupBy("project_key", "section", "change_kind").agg(F.count("*").alias("n_records"), F.countDistinct("snapshot_no").alias("n_snapshots"))


_FOUND_SQL = """
with w as (
  select * from (select *, row_number() over (partition by project_key, snapshot_no order by delivered_at desc nulls last) rn from policy_snapshots where snapshot_no is not null) where rn = 1
), sec as (
  select project_key, snapshot_no, 'score_deltas' section, list_transform(list_filter(score_deltas, lambda r: r is not null), lambda r: {{'k': coalesce(r.module, ''), 'v': concat(coalesce((round(r.baseline_score, 2) + 0.0)::varchar, '~'), '|', coalesce((round(r.current_score, 2) + 0.0)::varchar, '~'))}}) rs from w where score_deltas is not null
  union all
  select project_key, snapshot_no, 'evidence_deltas', list_transform(list_filter(evidence_deltas, lambda r: r is not null), lambda r: {{'k': concat(coalesce(r.metric, ''), '/', coalesce(r.benchmark, '')), 'v': concat(coalesce((round(r.baseline_value, 2) + 0.0)::varchar, '~'), '|', coalesce((round(r.current_value, 2) + 0.0)::varchar, '~'), '|', coalesce(r.status, '~'))}}) from w where evidence_deltas is not null
  union all
  select project_key, snapshot_no, 'regressions', list_transform(list_filter(regressions, lambda r: r is not null), lambda r: {{'k': concat(coalesce(r.metric, ''), '/', coalesce(r.subject, '')), 'v': coalesce((round(r.delta, 2) + 0.0)::varchar, '~')}}) from w where regressions is not null
), nav as (
  select project_key, section, snapshot_no, rs, lag(snapshot_no) over q prev_no, lead(snapshot_no) over q next_no from sec window q as (partition by project_key, section order by snapshot_no)
), rec as (
  select distinct project_key, section, snapshot_no, prev_no, next_no, r.k k, r.v v from (select project_key, section, snapshot_no, prev_no, next_no, unnest(rs) r from nav)
), found as (
  select coalesce(n.project_key, o.project_key) project_key, coalesce(n.snapshot_no, o.next_no) snapshot_no, coalesce(n.section, o.section) section, coalesce(n.k, o.k) record_key,
         case when o.k is null then 'added' when n.k is null then 'removed' when n.v <> o.v then 'changed' end change_kind
  from (select * from rec where prev_no is not null) n
  full outer join (select * from rec where next_no is not null) o on n.project_key = o.project_key and n.section = o.section and n.snapshot_no = o.next_no and n.k = o.k
)
select {columns} from found where change_kind is not null {tail}
"""

QUERIES = {"p1_found": p1_found, "p1_change_counts": p1_change_counts}
SQL = {
    "p1_found": _FOUND_SQL.format(columns="project_key, snapshot_no, section, record_key, change_kind", tail=""),
    "p1_change_counts": _FOUND_SQL.format(columns="project_key, section, change_kind, count(*)::bigint n_records, count(distinct snapshot_no)::bigint n_snapshots", tail="group by project_key, section, change_kind"),
}
