from __future__ import annotations

import random
from datetime import datetime

import pytest

from tallyweir.operators.hierarchy import resolve, scope_descendants, scope_paths, scope_states

from .conftest import same

SCHEMA = "id string, parent_id string, captured_at timestamp, depth string, `end` string"
T = datetime(2025, 1, 1)


def table(spark, links, more=()):
    return spark.createDataFrame([(i, p, T, "clash", "clash") for i, p in links] + list(more), SCHEMA)


def brute(links: dict) -> dict:
    out = {}
    for x in links:
        path = [x]
        while (p := links[path[-1]]) is not None and p in links and p not in path:
            path.append(p)
        p = links[path[-1]]
        if p is None or p not in links:
            out[x] = (path[-1], len(path) - 1, "rooted" if p is None else "dangling")
        else:
            cycle = path[path.index(p) :]
            out[x] = (min(cycle), path.index(p), "cyclic" if path.index(p) == 0 else "trapped")
    return out


def random_links(n: int, seed: int) -> dict:
    rng = random.Random(seed)
    names = [f"n{i:04d}" for i in range(n)]
    links = {x: rng.choice(names) for x in names}
    for x in rng.sample(names, n // 10):
        links[x] = None
    for x in rng.sample(names, n // 20):
        links[x] = "nowhere"
    chain = names[: n // 2]
    for a, b in zip(chain, chain[1:]):
        links[b] = a
    links[chain[0]] = rng.choice([None, chain[5], chain[0], "gone"])
    return links


@pytest.mark.parametrize("task_links", [10, 70, 10_000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, task_links, seed):
    links = random_links(160, seed)
    found = {r["id"]: (r["root_id"], r["depth"], r["state"]) for r in scope_states(table(spark, links.items()), task_links).collect()}
    assert found == brute(links)


@pytest.mark.parametrize("task_links", [20, 1000])
def test_one_long_chain_and_one_large_cycle(spark, task_links):
    order = [f"c{i:03d}" for i in range(150)]
    random.Random(5).shuffle(order)
    links = dict(zip(order[1:], order[:-1])) | {order[0]: None}
    ring = [f"r{i:03d}" for i in range(90)]
    random.Random(6).shuffle(ring)
    links |= dict(zip(ring, [*ring[1:], ring[0]])) | {"tail": ring[3], "tail2": "tail"}
    found = {r["id"]: (r["root_id"], r["depth"], r["state"]) for r in scope_states(table(spark, links.items()), task_links).collect()}
    assert found == brute(links)


def test_blanks_captures_and_self_parent(spark):
    more = [("b", "a", datetime(2024, 1, 1), None, None), ("b", "gone", datetime(2025, 2, 1), None, None), (None, "a", T, None, None)]
    same(
        scope_states(table(spark, [("a", "  "), ("b", None), ("b", None), ("c", " a "), ("s", "s"), ("t", "s\t")], more)),
        [("a", "a", 0, "rooted"), ("b", "b", 0, "dangling"), ("c", "a", 1, "rooted"), ("s", "s", 0, "cyclic"), ("t", "s", 1, "trapped")],
        ["id", "root_id", "depth", "state"],
    )


def test_empty(spark):
    assert scope_states(table(spark, [])).count() == 0
    assert scope_paths(table(spark, [])).count() == 0


def test_paths_and_descendants(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("w", "z")]
    paths = scope_paths(table(spark, links), 3)
    same(
        paths,
        [("a", ["a"]), ("b", ["a", "b"]), ("c", ["a", "b", "c"]), ("d", ["a", "b", "d"]), ("x", ["x"]), ("y", ["y"]), ("z", ["x", "z"]), ("w", ["x", "z", "w"])],
        ["id", "path"],
    )
    same(scope_descendants(paths), [("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 2), ("b", "d", 1), ("x", "z", 1), ("x", "w", 2), ("z", "w", 1)], ["id", "descendant_id", "distance"])


def test_resolve_does_not_depend_on_row_order(spark):
    links = random_links(60, 9)
    df = spark.createDataFrame(list(links.items()), "id string, parent string")
    one = sorted(map(tuple, resolve(df, 7).filter("state <> 'looping'").collect()))
    two = sorted(map(tuple, resolve(df.repartition(3).orderBy("parent"), 1000).filter("state <> 'looping'").collect()))
    assert one == two
