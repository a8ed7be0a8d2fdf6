"""Degrees, cycles, components and layers of directed graphs given as (src, dst) rows.

Small graphs (up to TASK_EDGES edges, counted first) are solved by one task in memory
of a known bound; larger ones by rounds of joins over written tables. Both ways give
the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import layer, layer_rank
from ..storage import written
from .hierarchy import resolve

TASK_EDGES = 500_000


def _edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()


def degrees(vertices: DataFrame, vertex: str, edges: DataFrame) -> DataFrame:
    """Each vertex with outbound and inbound: distinct neighbours, itself left out."""
    own = _edges(edges).filter("src <> dst")
    ends = own.select(F.col("src").alias("_v"), F.lit(1).alias("_o"), F.lit(0).alias("_i")).unionByName(own.select(F.col("dst").alias("_v"), F.lit(0).alias("_o"), F.lit(1).alias("_i")))
    n = ends.groupBy("_v").agg(F.sum("_o").alias("outbound"), F.sum("_i").alias("inbound"))
    return vertices.join(n, F.col(vertex).cast("string") == F.col("_v"), "left").drop("_v").fillna(0, ["outbound", "inbound"])


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def edge_provenance(edges: DataFrame, source: str) -> DataFrame:
    """One row an edge, with the sorted distinct sources that vouch for it."""
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.collect_set(source)).alias("sources"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray, np.ndarray]:
    if not (batches := [b for b in batches if b.num_rows]):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    table = pa.Table.from_batches(batches)
    names, at = np.unique(np.concatenate([table.column(c).to_numpy(zero_copy_only=False).astype(object) for c in ("src", "dst")]), return_inverse=True)
    return names.tolist(), at[: table.num_rows], at[table.num_rows :]


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Component numbers by one depth-first walk with an explicit stack."""
    order = np.argsort(src, kind="stable")
    targets, starts = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, part, stack, count, parts = [-1] * n, [0] * n, [-1] * n, [], 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        walk = [(root, starts[root])]
        while walk:
            v, at = walk.pop()
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            for at in range(at, starts[v + 1]):
                w = targets[at]
                if index[w] < 0:
                    walk += [(v, at), (w, starts[w])]
                    break
                if part[w] < 0:
                    low[v] = min(low[v], low[w])
            else:
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        part[w] = parts
                        if w == v:
                            break
                    parts += 1
    return np.array(part, np.int64)


def _members_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, src, dst = _numbered(batches)
    if names:
        part = strong_components(len(names), src, dst)
        on = np.bincount(part)[part] > 1
        on[src[src == dst]] = True
        yield pa.RecordBatch.from_arrays([pa.array([n for n, hit in zip(names, on) if hit], pa.string())], names=["vertex"])


def cycle_members(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """vertex: those that reach themselves, self loops included."""
    own = written(_edges(edges), "edges")
    if own.limit(task_edges + 1).count() <= task_edges:
        return own.coalesce(1).mapInArrow(_members_in_task, "vertex string")
    found = own.filter("src = dst").select(F.col("src").alias("vertex"))
    rest = written(own.filter("src <> dst"), "edges")
    n = rest.count()
    while n:
        # Vertices without way in or out lie on no cycle.
        while True:
            inner = rest.join(rest.select(F.col("dst").alias("_d")).distinct(), F.col("src") == F.col("_d"), "left_semi")
            inner = written(inner.join(rest.select(F.col("src").alias("_s")).distinct(), F.col("dst") == F.col("_s"), "left_semi"), "edges")
            m = inner.count()
            rest, same, n = inner, m == n, m
            if same:
                break
        if not n:
            break
        # Each vertex takes the greatest name that reaches it; those reached by their own colour backwards are a strong component.
        color = written(rest.select(F.col("src").alias("vertex")).distinct().withColumn("color", F.col("vertex")), "colors")
        while True:
            pushed = rest.join(color, F.col("src") == F.col("vertex")).groupBy("dst").agg(F.max("color").alias("_c"))
            wider = written(color.join(pushed, F.col("vertex") == F.col("dst"), "left").select("vertex", F.greatest("color", F.coalesce("_c", "color")).alias("color"), (F.col("_c") > F.col("color")).alias("moved")), "colors")
            moved = wider.filter("moved").limit(1).count()
            color = wider.drop("moved")
            if not moved:
                break
        within = rest.join(color.withColumnsRenamed({"vertex": "_sv", "color": "_sc"}), F.col("src") == F.col("_sv")).join(color.withColumnsRenamed({"vertex": "_dv", "color": "_dc"}), F.col("dst") == F.col("_dv")).filter("_sc = _dc").select("src", "dst", F.col("_sc").alias("color"))
        within = written(within, "within")
        reached = written(color.filter("vertex = color"), "reached")
        front = reached
        while True:
            back = within.join(front.select(F.col("vertex").alias("_f")), F.col("dst") == F.col("_f")).select(F.col("src").alias("vertex"), "color").distinct()
            front = written(back.join(reached.select(F.col("vertex").alias("_r")), F.col("vertex") == F.col("_r"), "left_anti"), "front")
            if not front.limit(1).count():
                break
            reached = reached.unionByName(front)
        reached = written(reached, "reached")
        large = reached.groupBy("color").agg(F.count("*").alias("_n")).filter("_n > 1").select("color")
        found = found.unionByName(reached.join(large, "color", "left_semi").select("vertex"))
        gone = reached.select(F.col("vertex").alias("_g"))
        rest = written(rest.join(gone, F.col("src") == F.col("_g"), "left_anti").join(gone, F.col("dst") == F.col("_g"), "left_anti"), "edges")
        n = rest.count()
    return found.distinct()


def _components_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, src, dst = _numbered(batches)
    low = np.arange(len(names))
    while True:
        before = low.copy()
        np.minimum.at(low, src, low[dst])
        np.minimum.at(low, dst, low[src])
        low = low[low]
        if np.array_equal(before, low):
            break
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([names[i] for i in low], pa.string())], names=["vertex", "component"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """vertex and component (its least vertex) of the undirected graph.

    Large graphs: alternating large-star and small-star rounds; minima are aggregated
    and joined back, so a vertex with very many neighbours is not collected.
    """
    own = written(_edges(edges), "edges")
    if own.limit(task_edges + 1).count() <= task_edges:
        return own.coalesce(1).mapInArrow(_components_in_task, "vertex string, component string")
    vertices = own.select(F.col("src").alias("vertex")).unionByName(own.select(F.col("dst").alias("vertex"))).distinct()
    links = written(own.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "_u")
        large = written(both.join(least, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        joined = large.join(least, F.col("u") == F.col("_u"))
        links = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    return vertices.join(links, F.col("vertex") == F.col("u"), "left").select("vertex", F.coalesce("v", "vertex").alias("component"))


def connected_pairs(members: DataFrame, keys: list[str], component: str = "component") -> DataFrame:
    """Components and connected pairs, sum of k(k-1)/2, of each group."""
    sizes = members.groupBy(*keys, component).agg(F.count("*").alias("_k"))
    return sizes.groupBy(*keys).agg(F.count("*").alias("n_components"), F.sum((F.col("_k") * (F.col("_k") - 1) / 2).cast("bigint")).alias("n_pairs"))


def layer_violations(edges: DataFrame) -> DataFrame:
    """Edges from a lower to a higher layer: src, dst, src_layer, dst_layer. Tests and unclassified modules have no rank."""
    named = _edges(edges).withColumns({"src_layer": layer(F.col("src")), "dst_layer": layer(F.col("dst"))})
    return named.filter(layer_rank(F.col("src_layer")) < layer_rank(F.col("dst_layer")))


def tree_check(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """One row: n_roots, n_dangling, n_looping and whether the nodes form one tree."""
    ends = resolve(nodes.select(F.col(node).cast("string").alias("id"), F.col(parent).cast("string").alias("parent")))
    own = ends.agg(F.count_if((F.col("state") == "rooted") & (F.col("steps") == 0)).alias("n_roots"), F.count_if((F.col("state") == "dangling") & (F.col("steps") == 0)).alias("n_dangling"), F.count_if(F.col("state") == "looping").alias("n_looping"))
    return own.withColumn("is_tree", (F.col("n_roots") == 1) & (F.col("n_dangling") == 0) & (F.col("n_looping") == 0))
