"""Parent-child links to full hierarchies (problem 3).

The links form a functional graph: each id has at most one parent. A weighted
disjoint-set forest resolves the links inside one partition, with each member's
offset to its local root. Roots whose parent lies in another partition make a
contracted table of links with weights, usually far smaller, which is partitioned
more coarsely and resolved again; this repeats until nothing points outside. The
results then travel back down, adding offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from ..tables import last_delivery, load

#: Links that one task resolves at once. About 0.3 kB of memory each.
TASK_LINKS = 200_000

ROOT, CYCLE, EXIT = 0, 1, 2


def _forest(to: np.ndarray, weight: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, offsets and kinds of the local forest by pointer jumping.

    ``to`` is the index of the parent in the partition, -1 if there is none here;
    ``outside`` tells whether such a node has a parent elsewhere. A cycle is cut at
    its least index, which becomes its end.
    """
    n = len(to)
    here = np.arange(n)
    linked = to >= 0
    jump = np.where(linked, to, here)
    low = here.copy()
    # The image of enough jumps holds the local roots and the cycles' members alone.
    for _ in range(max(1, int(n).bit_length())):
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    ends = np.zeros(n, dtype=bool)
    ends[jump] = True
    on_cycle = ends & linked
    cut = on_cycle & (low == here)
    link = np.where(linked & ~cut, to, here)
    offset = np.where(link == here, 0, weight).astype(np.int64)
    while True:
        further = link[link]
        if np.array_equal(further, link):
            break
        offset = offset + offset[link]
        link = further
    kind = np.where(outside, EXIT, np.where(cut, CYCLE, ROOT))[link]
    return link, offset, kind


def _resolve_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not (batches := [b for b in batches if b.num_rows]):
        return
    table = pa.Table.from_batches(batches)
    ids, tos = table.column("id").combine_chunks(), table.column("to").combine_chunks()
    at = pc.index_in(tos, value_set=ids)
    to = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    has = tos.is_valid().to_numpy(zero_copy_only=False)
    link, offset, kind = _forest(to, table.column("weight").to_numpy(), has & (to < 0))
    take = pa.array(link)
    ext = tos.take(take)
    out = pa.table({
        "id": ids,
        "end": ids.take(take),
        "steps": pa.array(offset),
        "kind": pa.array(kind.astype(np.int32)),
        "ext": pc.if_else(pa.array(kind == EXIT), ext, pa.scalar(None, ext.type)),
        "ext_weight": table.column("weight").combine_chunks().take(take),
    })
    yield from out.to_batches(max_chunksize=100_000)


_LOCAL = "id string, `end` string, steps bigint, kind int, ext string, ext_weight bigint"


def _local(links: DataFrame, parts: int, name: str) -> DataFrame:
    if parts == 1:
        return links.coalesce(1).mapInArrow(_resolve_local, _LOCAL)
    return written(links.repartitionByRange(parts, "id").mapInArrow(_resolve_local, _LOCAL), name)


def _jump_all(nodes: DataFrame, n: int) -> DataFrame:
    """Ends of links whose ids have no locality: every link jumps over the one it points to.

    Each round doubles the reach, so ``n`` links end within log2(n) rounds; what is
    still open then runs in a cycle.
    """
    links = nodes.withColumn("open", F.col("to").isNotNull())
    for _ in range(n.bit_length() + 1):
        on = links.select(F.col("id").alias("_at"), F.col("to").alias("_to"), F.col("weight").alias("_w"))
        further = F.col("_to").isNotNull()
        links = written(
            links.join(on, F.col("to") == F.col("_at"), "left").select("id", F.coalesce("_to", "to").alias("to"), F.when(further, F.col("weight") + F.col("_w")).otherwise(F.col("weight")).alias("weight"), further.alias("open")),
            "jumped",
        )
        if not links.filter("open").limit(1).count():
            break
    return links.select("id", F.coalesce("to", "id").alias("end"), F.when(F.col("to").isNull(), 0).otherwise(F.col("weight")).cast("bigint").alias("steps"), F.when(F.col("open"), CYCLE).otherwise(ROOT).alias("kind"))


def resolve(links: DataFrame, task_links: int = TASK_LINKS, stored: bool = False) -> DataFrame:
    """For each id the end of its chain: id, end, steps, state (rooted, dangling or looping).

    ``links`` has id (unique, not null), parent (null: none). A looping chain runs into
    a cycle; its end is one member of that cycle, at which it was cut. Links are written
    first unless they are ``stored`` already.
    """
    level = links.select("id", F.col("parent").alias("to"), F.lit(1).cast("bigint").alias("weight"))
    rows = level if stored else written(level, "links")
    return _resolve(rows, rows.count(), task_links).select("id", "end", "steps", F.when(F.col("kind") == CYCLE, "looping").when(F.col("kind") == EXIT, "dangling").otherwise("rooted").alias("state"))


def _resolve(level: DataFrame, n: int, task_links: int) -> DataFrame:
    """id, end, steps, kind; EXIT now means that the parent of the end is nowhere."""
    parts = max(1, -(-n // task_links))
    local = _local(level, parts, "forest")
    if parts == 1:
        return local.select("id", "end", "steps", "kind")
    exits = local.filter((F.col("kind") == EXIT) & (F.col("steps") == 0)).select("id", "ext", "ext_weight")
    target = local.select(F.col("id").alias("_id"), F.col("end").alias("_end"), F.col("steps").alias("_steps"), F.col("kind").alias("_kind"))
    outer = written(
        exits.join(target, F.col("ext") == F.col("_id"), "left").select(
            "id",
            # The parent's local end, over which the chain goes on; none if the parent is nowhere.
            F.col("_end").alias("to"),
            (F.col("ext_weight") + F.coalesce("_steps", F.lit(0))).alias("weight"),
            "_kind",
        ),
        "contracted",
    )
    m = outer.count()
    ends = outer.filter(F.col("to").isNotNull() & (F.col("_kind") != EXIT)).select(F.col("to").alias("id"), F.lit(None).cast("string").alias("to"), F.lit(1).cast("bigint").alias("weight"), F.col("_kind").alias("mark")).distinct()
    nodes = outer.select("id", "to", "weight").unionByName(ends.drop("mark"))
    above = _jump_all(nodes, m) if m > 0.5 * n else _resolve(nodes, m, task_links)
    marks = ends.select(F.col("id").alias("_m_id"), "mark")
    lost = outer.filter(F.col("to").isNull()).select(F.col("id").alias("_m_id"), F.lit(EXIT).alias("mark"))
    # The kind of an end is what it was where it became an end.
    above = above.join(marks.unionByName(lost), F.col("end") == F.col("_m_id"), "left").select(F.col("id").alias("_a_id"), F.col("end").alias("_a_end"), F.col("steps").alias("_a_steps"), F.coalesce("mark", "kind").alias("_a_kind"))
    exit_ = F.col("kind") == EXIT
    return (
        local.join(above, exit_ & (F.col("end") == F.col("_a_id")), "left")
        .select(
            "id",
            F.when(exit_, F.col("_a_end")).otherwise(F.col("end")).alias("end"),
            F.when(exit_, F.col("steps") + F.col("_a_steps")).otherwise(F.col("steps")).alias("steps"),
            F.when(exit_, F.col("_a_kind")).otherwise(F.col("kind")).alias("kind"),
        )
    )


def cycle_members(links: DataFrame) -> DataFrame:
    """id and cycle_id (the least id of its cycle) of the ids that lie on cycles.

    ``links`` holds only chains that run into cycles. The image of f^(2^k) shrinks to
    the cycles' members as k grows; once squaring leaves its size alone, it is them.
    """
    jump = written(links.select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("low")), "jump")
    size = jump.select("to").distinct().count()
    while True:
        on = jump.select(F.col("id").alias("_at"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        jump = written(jump.join(on, F.col("to") == F.col("_at")).select("id", F.col("_to").alias("to"), F.least("low", "_low").alias("low")), "jump")
        image = jump.select("to").distinct()
        again = image.count()
        if again == size:
            break
        size = again
    # On a cycle, 2^k >= its length holds once the image is stable for one more round, or else low still moves.
    members = written(jump.join(image.select(F.col("to").alias("_m")), F.col("id") == F.col("_m"), "left_semi"), "members")
    while True:
        on = members.select(F.col("id").alias("_at"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        wider = written(members.join(on, F.col("to") == F.col("_at")).select("id", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")), "members")
        moved = wider.filter("moved").limit(1).count()
        members = wider.drop("moved")
        if not moved:
            return members.select("id", F.col("low").alias("cycle_id"))


def clean_links(scopes: DataFrame) -> DataFrame:
    """id and parent of the last capture of each scope; blank parents are none.

    Rows with a null id are no scope. Blanks around a parent don't count.
    """
    last = last_delivery(scopes.filter(F.col("id").isNotNull()).select("id", "parent_id", "captured_at"), ["id"], "captured_at")
    parent = F.regexp_replace("parent_id", r"(?U)^\s+|\s+$", "")
    return last.select("id", F.when(parent != "", parent).alias("parent"))


def _states(scopes: DataFrame, task_links: int) -> tuple[DataFrame, DataFrame]:
    """The cleaned links, and id, end (the first scope of the cycle for looping chains), root_id, depth, state."""
    links = written(clean_links(scopes), "scopes")
    found = written(resolve(links, task_links, stored=True), "ends")
    calm = found.filter(F.col("state") != "looping").select("id", "end", F.col("end").alias("root_id"), F.col("steps").alias("depth"), "state")
    looping = found.filter(F.col("state") == "looping")
    if not looping.limit(1).count():
        return links, calm
    loops = written(links.join(looping.select("id"), "id", "left_semi"), "loops")
    members = cycle_members(loops)
    # With the members made roots, the rest of these chains are trees that hang on them.
    hung = loops.join(members.select(F.col("id").alias("_m"), "cycle_id"), F.col("id") == F.col("_m"), "left")
    hung = written(hung.select("id", F.when(F.col("_m").isNull(), F.col("parent")).alias("parent"), "cycle_id"), "hung")
    trees = resolve(hung, task_links, stored=True)
    named = hung.filter(F.col("cycle_id").isNotNull()).select(F.col("id").alias("_m"), "cycle_id")
    looped = trees.join(named, F.col("end") == F.col("_m")).select("id", "end", F.col("cycle_id").alias("root_id"), F.col("steps").alias("depth"), F.when(F.col("steps") == 0, "cyclic").otherwise("trapped").alias("state"))
    return links, calm.unionByName(looped)


def scope_states(scopes: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """id, root_id, depth and state of every scope.

    state: rooted, dangling (the end's parent isn't in the table), cyclic, or trapped
    (the chain runs into a cycle). root_id is the chain's end, or the least id of the
    cycle; depth counts the steps to the end, or to the first scope of the cycle. A
    scope that is its own parent is a cycle of one.
    """
    return _states(scopes, task_links)[1].select("id", "root_id", F.col("depth").cast("bigint").alias("depth"), "state")


def scope_paths(scopes: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """scope_states with ``path``, from the chain's end (or first cycle scope) down to the scope.

    Paths are made where the links are: a range of ids is walked from its local roots
    down, and what lies above a local root is found in the contracted links, each of
    which carries the piece of path that it stands for.
    """
    return _paths(scopes, task_links)[1]


def _walk_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, the local root, the root's parent elsewhere, and the labels from the local root down to each node; in depth-first order."""
    if not (batches := [b for b in batches if b.num_rows]):
        return
    table = pa.Table.from_batches(batches)
    ids, tos, labels = (table.column(c).combine_chunks() for c in ("id", "to", "label"))
    to = pc.index_in(tos, value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(to, kind="stable")
    starts = np.searchsorted(to[order], np.arange(len(to) + 1)).tolist()
    below, at, names = order.tolist(), labels.offsets.to_numpy().tolist(), labels.values
    flat, ends, rows, roots, here = [], [0], [], [], []

    def give() -> pa.RecordBatch:
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(flat, pa.int64())))
        own, root = pa.array(rows, pa.int64()), pa.array(roots, pa.int64())
        return pa.RecordBatch.from_arrays([ids.take(own), ids.take(root), tos.take(root), path], names=["id", "end", "ext", "path"])

    for top in np.flatnonzero(to < 0).tolist():
        stack = [(top, 0)]
        while stack:
            node, length = stack.pop()
            del here[length:]
            here.extend(range(at[node], at[node + 1]))
            flat.extend(here)
            ends.append(len(flat))
            rows.append(node)
            roots.append(top)
            stack.extend((x, len(here)) for x in below[starts[node] : starts[node + 1]])
            if len(flat) > WALKED:
                yield give()
                flat, ends, rows, roots = [], [0], [], []
    if rows:
        yield give()


#: Labels that a task gives out at once.
WALKED = 500_000


def _label_paths(level: DataFrame, n: int, task_links: int) -> DataFrame:
    """id and path of links (id, to, label) without cycles: the path of ``to``, if there is one, and the node's own label."""
    parts = max(1, -(-n // task_links))
    walk = "id string, `end` string, ext string, path array<string>"
    if parts == 1:
        return level.coalesce(1).mapInArrow(_walk_local, walk).select("id", "path")
    local = written(level.repartitionByRange(parts, "id").mapInArrow(_walk_local, walk), "walked")
    away = local.filter(F.col("ext").isNotNull())
    exits = away.filter(F.col("id") == F.col("end")).select("id", "ext")
    target = local.select(F.col("id").alias("_id"), F.col("end").alias("to"), F.col("path").alias("label"), F.col("ext").isNull().alias("_ends"))
    outer = written(exits.join(target, F.col("ext") == F.col("_id")).select("id", "to", "label", "_ends"), "contracted")
    tops = outer.filter("_ends").select(F.col("to").alias("id"), F.lit(None).cast("string").alias("to"), F.array().cast("array<string>").alias("label")).distinct()
    nodes = outer.select("id", "to", "label").unionByName(tops)
    # Ranges of ids without locality hold few chains; then the contracted links jump instead, as in resolve.
    m = nodes.count()
    above = (_jump_paths(nodes, m) if m > 0.5 * n else _label_paths(nodes, m, task_links)).select(F.col("id").alias("_a"), F.col("path").alias("_above"))
    below = away.join(above, F.col("end") == F.col("_a")).select("id", F.concat("_above", "path").alias("path"))
    return local.filter(F.col("ext").isNull()).select("id", "path").unionByName(below)


def _jump_paths(nodes: DataFrame, n: int) -> DataFrame:
    """What _label_paths returns, by links that jump over the one they point to, so that each round doubles their labels' reach."""
    links = nodes
    for _ in range(n.bit_length() + 1):
        on = links.select(F.col("id").alias("_at"), F.col("to").alias("_to"), F.col("label").alias("_label"))
        links = written(links.join(on, F.col("to") == F.col("_at"), "left").select("id", F.col("_to").alias("to"), F.concat(F.coalesce("_label", F.array().cast("array<string>")), "label").alias("label")), "jumped")
        if not links.filter(F.col("to").isNotNull()).limit(1).count():
            break
    return links.select("id", F.col("label").alias("path"))


def _paths(scopes: DataFrame, task_links: int) -> tuple[DataFrame, DataFrame]:
    """The cleaned links, and what scope_paths returns."""
    links, states = _states(scopes, task_links)
    states = written(states, "states")
    step = states.join(links, "id").select("id", F.when(F.col("depth") > 0, F.col("parent")).alias("to"), F.array("id").alias("label"))
    paths = _label_paths(step, states.count(), task_links)
    return links, states.join(paths, "id").select("id", "root_id", F.col("depth").cast("bigint").alias("depth"), "state", "path")


def scope_descendants(paths: DataFrame) -> DataFrame:
    """One row for each scope and each scope below it on its path: id, descendant_id, distance.

    Rows, not lists: a root may have a third of all scopes below it. A path ends at the
    first scope of a cycle; what lies round the cycle is added by all_descendants.
    """
    above = paths.select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("_at", "id"))
    return above.filter(F.col("_at") < F.col("depth")).select("id", "descendant_id", (F.col("depth") - F.col("_at")).cast("bigint").alias("distance"))


def all_descendants(scopes: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """One row for each scope and each other scope below it: id, descendant_id, distance.

    The members of a cycle are below each other, and a trapped scope is below all of
    them; the distance is the number of steps up, round the cycle where need be. No
    scope counts as below itself.
    """
    links, paths = _paths(scopes, task_links)
    paths = written(paths, "paths")
    below = scope_descendants(paths)
    members = paths.filter(F.col("state") == "cyclic").select("id", "root_id")
    if not members.limit(1).count():
        return below
    # Cut at its least id, a cycle is a chain, whose depths are the places round it.
    cut = written(members.join(links, "id").select("id", F.when(F.col("id") != F.col("root_id"), F.col("parent")).alias("parent")), "cut")
    place = written(resolve(cut, task_links, stored=True).select(F.col("id").alias("_m"), F.col("end").alias("_cycle"), F.col("steps").alias("_place")), "places")
    length = place.groupBy(F.col("_cycle").alias("_l_cycle")).agg(F.count("*").alias("_length"))
    looping = paths.filter(F.col("state").isin("cyclic", "trapped")).select(F.col("id").alias("descendant_id"), "depth", F.element_at("path", 1).alias("_entry"))
    at = place.select(F.col("_m").alias("_e"), F.col("_cycle").alias("_e_cycle"), F.col("_place").alias("_e_place"))
    entered = looping.join(at, F.col("_entry") == F.col("_e")).join(length, F.col("_e_cycle") == F.col("_l_cycle"))
    round_ = entered.join(place, F.col("_e_cycle") == F.col("_cycle")).filter(F.col("_m") != F.col("_entry"))
    return below.unionByName(round_.select(F.col("_m").alias("id"), "descendant_id", (F.col("depth") + F.pmod(F.col("_e_place") - F.col("_place"), F.col("_length"))).cast("bigint").alias("distance")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_states(load(spark, sf_dir, "lexical"))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scope_paths(load(spark, sf_dir, "lexical"))
    return found.withColumn("path", F.concat_ws(" > ", "path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_descendants(load(spark, sf_dir, "lexical"))


_LINKS_SQL = """
links as (
  select id, nullif(trim(parent_id), '') parent from (select *, row_number() over (partition by id order by captured_at desc nulls last) rn from lexical where id is not null) where rn = 1
)"""
_WALK_SQL = f"""
with recursive {_LINKS_SQL}, walk as (
  select id, id at_id, 0 d, parent next, [id] path from links
  union all
  select w.id, l.id, d + 1, l.parent, list_prepend(l.id, w.path) from walk w join links l on l.id = w.next where not list_contains(w.path, l.id)
), tail as (
  select id, path, d, at_id, next from (select *, row_number() over (partition by id order by d desc) rn from walk) where rn = 1
), looped as (
  select t.id, t.path, list_slice(t.path, 1, list_position(t.path, t.next)) cyc, t.next from tail t where t.next is not null and list_contains(t.path, t.next)
), flat as (
  select t.id, t.at_id root_id, t.d depth, case when t.next is null then 'rooted' else 'dangling' end state, t.path from tail t where t.next is null or not list_contains(t.path, t.next)
  union all
  select id, list_min(cyc), len(path) - len(cyc), case when len(path) = len(cyc) then 'cyclic' else 'trapped' end, list_slice(path, len(cyc), len(path)) from looped
)
"""

QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants}
SQL = {
    "p3_found": _WALK_SQL + "select id, root_id, depth::bigint depth, state from flat",
    "p3_paths": _WALK_SQL + "select id, root_id, depth::bigint depth, state, array_to_string(path, ' > ') path from flat",
    # Up from every scope, once round the cycle it runs into, and never to itself.
    "p3_descendants": f"""
with recursive {_LINKS_SQL}, up as (
  select p.id, l.id descendant_id, 1 d, p.parent next, [p.id] seen from links l join links p on p.id = l.parent where p.id <> l.id
  union all
  select p.id, u.descendant_id, u.d + 1, p.parent, list_append(u.seen, p.id) from up u join links p on p.id = u.next where p.id <> u.descendant_id and not list_contains(u.seen, p.id)
) select id, descendant_id, d::bigint distance from up""",
}
