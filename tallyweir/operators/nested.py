"""Deeply nested semi-structured records to flat tables (problem 4).

``shred`` turns JSON texts into columns: for each leaf path that is asked for, the
sequence of repetition levels, of definition levels and of the values that are there.
``assemble`` takes the stripes of one or more repeated groups and rebuilds a table of
each, with the ordinals of all its ancestors, from the level sequences alone; it
touches no other stripe. A table asks ``shred`` for its own stripes only, so leaves
that nothing reads are never made.

Levels: a path with n repeated groups has repetition levels 0..n. Of group i,
definition level 2i-1 says that an element is there, 2i that it is an object (not
null); 2n+1 says that the leaf has a value.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import last_delivery, load


@dataclass(frozen=True)
class Group:
    """A repeated group: its leaves (name, type), its inner groups, and how to find its list in the parent object."""

    name: str
    leaves: tuple[tuple[str, str], ...]
    groups: tuple[Group, ...] = ()
    find: Callable[[object], object] | None = None


@dataclass(frozen=True)
class Stripe:
    """The level sequences of one leaf path."""

    path: str
    group: str
    depth: int
    leaf: str
    kind: str


def stripes(groups: Sequence[Group], prefix: str = "", depth: int = 0) -> list[Stripe]:
    found = []
    for g in groups:
        path = f"{prefix}{g.name}"
        found += [Stripe(f"{path}/{leaf}", path, depth + 1, leaf, kind) for leaf, kind in g.leaves]
        found += stripes(g.groups, f"{path}/", depth + 1)
    return found


@lru_cache(4096)
def plain(name: str) -> str:
    """Spellings of a field that are the same: rule_id, ruleId, Rule-ID."""
    return name.replace("_", "").replace("-", "").lower()


def fields(obj: object) -> dict[str, object]:
    """The fields of an object by plain name; of two spellings the first that isn't null."""
    found: dict[str, object] = {}
    if isinstance(obj, dict):
        for k, v in obj.items():
            k = plain(k)
            if found.get(k) is None:
                found[k] = v
    return found


def as_list(value: object) -> list:
    """A list as it is, a single object as a list of one, anything else as no list."""
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def text_of(value: object) -> str | None:
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text if text.isprintable() else text.encode("utf-8", "replace").decode()


class _Column:
    """The stripe of one leaf over all records of a batch: levels and values, and where each record ends."""

    __slots__ = ("r", "d", "v", "levels", "values")

    def __init__(self) -> None:
        self.r: list[int] = []
        self.d: list[int] = []
        self.v: list[str] = []
        self.levels, self.values = [0], [0]


class _Node:
    """A group with the stripes that are asked for in it and below it; groups without any are left out."""

    __slots__ = ("name", "find", "leaves", "below", "inner", "depth")

    def __init__(self, group: Group, prefix: str, depth: int, columns: dict[str, _Column]):
        path = f"{prefix}{group.name}"
        self.name, self.find, self.depth = plain(group.name), group.find, depth
        self.leaves = [(plain(leaf), columns[f"{path}/{leaf}"]) for leaf, _ in group.leaves if f"{path}/{leaf}" in columns]
        self.inner = [n for n in (_Node(g, f"{path}/", depth + 1, columns) for g in group.groups) if n.below]
        self.below = [c for _, c in self.leaves] + [c for n in self.inner for c in n.below]

    def absent(self, r: int, d: int) -> None:
        """No list or object: one entry in every stripe below, which says how far the path is defined."""
        for c in self.below:
            c.r.append(r)
            c.d.append(d)

    def put(self, elements: list, r: int) -> None:
        depth = self.depth
        if not elements:
            self.absent(r, 2 * depth - 2)
            return
        for element in elements:
            if not isinstance(element, dict):
                self.absent(r, 2 * depth - 1)
            else:
                own = fields(element)
                for leaf, c in self.leaves:
                    value = text_of(own.get(leaf))
                    c.r.append(r)
                    if value is None:
                        c.d.append(2 * depth)
                    else:
                        c.d.append(2 * depth + 1)
                        c.v.append(value)
                for node in self.inner:
                    node.put(as_list(node.find(own) if node.find else own.get(node.name)), r)
            r = depth


def _parse(text: str | None) -> object:
    """The JSON value of a text; a JSON string that holds JSON is opened. None if broken."""
    for _ in range(4):
        if not isinstance(text, str):
            break
        try:
            text = json.loads(text)
        except (ValueError, RecursionError):
            return None
    return None if isinstance(text, str) else text


def shred(df: DataFrame, ids: Sequence[str], text: str, groups: Sequence[Group], root: Callable[[object], list], paths: Sequence[str] | None = None) -> DataFrame:
    """One row a record: ids, and of each leaf path (or those in ``paths``) a struct of r, d and v.

    ``root`` takes the parsed JSON and gives the list of the one outermost group.
    Null, empty and broken texts give stripes without elements. Runs without a shuffle;
    memory is that of one batch of records.
    """
    found = [s.path for s in stripes(groups) if paths is None or s.path in paths]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids] + [f"`{p}` struct<r: array<tinyint>, d: array<tinyint>, v: array<string>>" for p in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {p: _Column() for p in found}
            top = _Node(groups[0], "", 1, columns)
            for value in batch.column(text).to_pylist():
                top.put(root(_parse(value)), 0)
                for c in top.below:
                    c.levels.append(len(c.d))
                    c.values.append(len(c.v))
            arrays = [batch.column(c) for c in ids]
            for c in columns.values():
                at, ends = pa.array(c.levels, pa.int32()), pa.array(c.values, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(c.r, pa.int8())), pa.ListArray.from_arrays(at, pa.array(c.d, pa.int8())), pa.ListArray.from_arrays(ends, pa.array(c.v, pa.string()))]
                arrays.append(pa.StructArray.from_arrays(lists, names=["r", "d", "v"]))
            yield pa.RecordBatch.from_arrays(arrays, names=[*ids, *columns])

    return df.select(*ids, text).mapInArrow(run, schema)


def ordinals(r: np.ndarray, level: int) -> np.ndarray:
    """Zero-based place at ``level`` of each entry of a stripe, from its repetition levels."""
    place = np.cumsum(r <= level)
    return place - np.maximum.accumulate(np.where(r < level, place, 0))


def needed(groups: Sequence[Group], targets: Sequence[str], leaves: Sequence[str]) -> list[Stripe]:
    """The stripes that ``assemble`` reads for these groups and leaves: at least one a group, for its levels."""
    used = []
    for t in targets:
        own = [s for s in stripes(groups) if s.group == t]
        used += [s for s in own if s.leaf in leaves] or own[:1]
    return used


def assemble(shredded: DataFrame, ids: Sequence[str], groups: Sequence[Group], targets: Sequence[str], leaves: Sequence[str]) -> DataFrame:
    """Rows of the objects of the target groups: ids, group, ord_1.. (null below the group's depth) and leaves (text).

    A leaf that a group doesn't have is null. Elements that are null or no objects keep
    their place but give no row.
    """
    used = needed(groups, targets, leaves)
    deepest = max(s.depth for s in used)
    schema = ", ".join([f"`{c}` {shredded.schema[c].dataType.simpleString()}" for c in ids] + ["`group` string"] + [f"ord_{i} bigint" for i in range(1, deepest + 1)] + [f"`{leaf}` string" for leaf in leaves])
    names = [*ids, "group", *(f"ord_{i}" for i in range(1, deepest + 1)), *leaves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target in targets:
                own = [s for s in used if s.group == target]
                depth = own[0].depth
                first = batch.column(own[0].path)
                r = first.field("r").flatten().to_numpy(zero_copy_only=False)
                d = first.field("d").flatten().to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(d >= 2 * depth)
                if not len(rows):
                    continue
                record = (np.cumsum(r == 0) - 1)[rows]
                columns = [batch.column(c).take(pa.array(record)) for c in ids] + [pa.array([target] * len(rows), pa.string())]
                for level in range(1, deepest + 1):
                    columns.append(pa.array(ordinals(r, level)[rows], pa.int64()) if level <= depth else pa.nulls(len(rows), pa.int64()))
                at = {s.leaf: s for s in own}
                for leaf in leaves:
                    if leaf not in at:
                        columns.append(pa.nulls(len(rows), pa.string()))
                        continue
                    stripe = batch.column(at[leaf].path)
                    there = stripe.field("d").flatten().to_numpy(zero_copy_only=False) == 2 * depth + 1
                    index = np.where(there, np.cumsum(there) - 1, 0)[rows]
                    columns.append(stripe.field("v").flatten().take(pa.array(index, mask=~there[rows])))
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    return shredded.select(*ids, *(f"`{s.path}`" for s in used)).mapInArrow(run, schema)


def typed(rows: DataFrame, group: Sequence[tuple[str, str]]) -> DataFrame:
    """Leaves cast to their types; a value that isn't of the type is null."""
    return rows.select(*(c for c in rows.columns if c not in dict(group)), *(F.col(n).try_cast(t).alias(n) if t != "string" else F.col(n) for n, t in group))


def _commands(check: dict[str, object]) -> object:
    """The commands of a check's evidence: its list, or itself if it is one command's outcome."""
    evidence = check.get("evidence")
    if isinstance(evidence, dict):
        own = fields(evidence)
        if "commands" in own or "requestedruns" in own:
            return own.get("commands")
        return [evidence] if evidence else []
    return evidence


REPORT = (
    Group(
        "checks",
        (("rule_id", "string"), ("status", "string"), ("severity", "string"), ("title", "string"), ("tool_version", "string"), ("metrics", "string")),
        (
            Group(
                "diagnostics",
                (("rule_id", "string"), ("severity", "string"), ("message", "string"), ("path", "string"), ("line", "bigint"), ("column", "bigint"), ("rendered", "string"), ("spans", "string")),
                (Group("children", (("level", "string"), ("message", "string"), ("spans", "string"))),),
            ),
            Group("commands", (("target", "string"), ("phase", "string"), ("iteration", "bigint"), ("status", "string"), ("duration_ms", "bigint"), ("exit_code", "bigint"), ("argv", "string"), ("limits", "string"), ("command", "string")), find=_commands),
        ),
    ),
)


def report_checks(value: object) -> list:
    """The list of check objects in any of a report's outer forms."""
    if isinstance(value, dict):
        own = fields(value)
        for wrapper in ("checks", "data"):
            if wrapper in own:
                inner = own[wrapper]
                inner = _parse(inner) if isinstance(inner, str) else inner
                return report_checks(inner) if isinstance(inner, dict) else as_list(inner)
        return [value] if value else []
    return as_list(value)


def shred_reports(practices: DataFrame, paths: Sequence[str] | None = None) -> DataFrame:
    """The stripes (or those in ``paths``) of each report's last delivery, by report_id.

    Deliveries without report_id are no report. If the last one is broken, null or
    empty, the report has no rows, whatever came before it.
    """
    last = last_delivery(practices.filter(F.col("report_id").isNotNull()).select("report_id", "received_at", "checks"), ["report_id"], "received_at")
    return shred(last, ["report_id"], "checks", REPORT, report_checks, paths)


def _assembled(practices: DataFrame, targets: Sequence[str], leaves: Sequence[str]) -> DataFrame:
    paths = [s.path for s in needed(REPORT, targets, leaves)]
    return assemble(shred_reports(practices, paths), ["report_id"], REPORT, targets, leaves)


def report_table(practices: DataFrame, target: str) -> DataFrame:
    """A flat table of one repeated group, with typed leaves and the places of its ancestors."""
    leaves = [(s.leaf, s.kind) for s in stripes(REPORT) if s.group == target]
    rows = _assembled(practices, [target], [n for n, _ in leaves])
    names = {"checks": ["check_no"], "checks/diagnostics": ["check_no", "diagnostic_no"], "checks/diagnostics/children": ["check_no", "diagnostic_no", "child_no"], "checks/commands": ["check_no", "command_no"]}[target]
    for i, name in enumerate(names, 1):
        rows = rows.withColumnRenamed(f"ord_{i}", name)
    return typed(rows.drop("group"), leaves)


def report_items(practices: DataFrame) -> DataFrame:
    """Diagnostics, children and commands with their places and labels."""
    branch = {"checks/diagnostics": "diagnostic", "checks/diagnostics/children": "child", "checks/commands": "command"}
    rows = _assembled(practices, list(branch), ["rule_id", "level", "target"])
    names = F.create_map(*(F.lit(x) for pair in branch.items() for x in pair))
    return rows.select(
        "report_id",
        F.col("ord_1").alias("check_no"),
        names[F.col("group")].alias("branch"),
        F.col("ord_2").alias("item_no"),
        F.coalesce("ord_3", F.lit(-1)).cast("bigint").alias("sub_no"),
        F.coalesce("rule_id", "level", "target", F.lit("")).alias("label"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_items(load(spark, sf_dir, "practices"))


def _table(target: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report_table(load(spark, sf_dir, "practices"), target)


_CHECKS_SQL = """
with d as (
  select report_id, checks from (select *, row_number() over (partition by report_id order by received_at desc nulls last) rn from practices where report_id is not null) where rn = 1
), a as (select report_id, case when json_valid(checks) then checks::json end j from d),
b as (select report_id, case when json_type(j) = 'VARCHAR' then case when json_valid(j ->> '$') then (j ->> '$')::json end else j end j from a),
c as (select report_id, case when json_type(j) = 'OBJECT' and json_exists(j, '$.data') then j -> 'data' else j end j from b),
e as (select report_id, case when json_type(j) = 'OBJECT' and json_exists(j, '$.checks') then j -> 'checks' when j::varchar = '{}' then null else j end j from c),
f as (select report_id, case json_type(j) when 'ARRAY' then j when 'OBJECT' then json_array(j) end j from e),
chk as (select report_id, unnest(from_json(j, '["json"]')) c, unnest(range(json_array_length(j)::bigint)) check_no from f where j is not null),
obj as (select * from chk where json_type(c) = 'OBJECT'),
dl as (select report_id, check_no, case json_type(c -> 'diagnostics') when 'ARRAY' then c -> 'diagnostics' when 'OBJECT' then json_array(c -> 'diagnostics') end j from obj),
di as (select report_id, check_no, unnest(from_json(j, '["json"]')) x, unnest(range(json_array_length(j)::bigint)) item_no from dl where j is not null),
dx as (select * from di where json_type(x) = 'OBJECT'),
cl as (select report_id, check_no, item_no, case json_type(x -> 'children') when 'ARRAY' then x -> 'children' when 'OBJECT' then json_array(x -> 'children') end j from dx),
ci as (select report_id, check_no, item_no, unnest(from_json(j, '["json"]')) x, unnest(range(json_array_length(j)::bigint)) sub_no from cl where j is not null),
el as (select report_id, check_no, c -> 'evidence' v from obj where json_type(c -> 'evidence') = 'OBJECT' and (c -> 'evidence')::varchar <> '{}'),
em as (select report_id, check_no, case when json_exists(v, '$.commands') or json_exists(v, '$.requested_runs') then case json_type(v -> 'commands') when 'ARRAY' then v -> 'commands' when 'OBJECT' then json_array(v -> 'commands') end else json_array(v) end j from el),
mi as (select report_id, check_no, unnest(from_json(j, '["json"]')) x, unnest(range(json_array_length(j)::bigint)) item_no from em where j is not null)
"""
SQL = {
    "p4_found": _CHECKS_SQL + """
select report_id, check_no, 'diagnostic' branch, item_no, -1::bigint sub_no, coalesce(x ->> 'rule_id', x ->> 'ruleId', '') as label from dx
union all select report_id, check_no, 'child', item_no, sub_no, coalesce(x ->> 'level', '') from ci where json_type(x) = 'OBJECT'
union all select report_id, check_no, 'command', item_no, -1::bigint, coalesce(x ->> 'target', '') from mi where json_type(x) = 'OBJECT'
""",
}


def _field(obj: str, name: str, kind: str) -> str:
    """A leaf in SQL: either spelling, JSON values minified, other types cast if they can be."""
    camel = "".join(p.capitalize() if i else p for i, p in enumerate(name.split("_")))
    one = lambda k: f"case when json_type({obj} -> '{k}') in ('OBJECT', 'ARRAY') then json({obj} -> '{k}')::varchar else {obj} ->> '{k}' end"
    value = f"coalesce({one(name)}, {one(camel)})" if camel != name else one(name)
    return f'{value} as "{name}"' if kind == "string" else f'try_cast({value} as {kind}) as "{name}"'


def _table_sql(source: str, obj: str, places: str, group: str) -> str:
    leaves = ", ".join(_field(obj, s.leaf, s.kind) for s in stripes(REPORT) if s.group == group)
    return f"{_CHECKS_SQL} select report_id, {places}, {leaves} from {source} where json_type({obj}) = 'OBJECT'"


SQL |= {
    "p4_checks": _table_sql("obj", "c", "check_no", "checks"),
    "p4_diagnostics": _table_sql("dx", "x", "check_no, item_no diagnostic_no", "checks/diagnostics"),
    "p4_children": _table_sql("ci", "x", "check_no, item_no diagnostic_no, sub_no child_no", "checks/diagnostics/children"),
    "p4_commands": _table_sql("mi", "x", "check_no, item_no command_no", "checks/commands"),
}
QUERIES = {
    "p4_found": p4_found,
    "p4_checks": _table("checks"),
    "p4_diagnostics": _table("checks/diagnostics"),
    "p4_children": _table("checks/diagnostics/children"),
    "p4_commands": _table("checks/commands"),
}
