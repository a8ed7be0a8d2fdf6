"""How often items appear together, and how much more often than chance (problem 2).

Heavy-light decomposition. Baskets are dealt into blocks of one scope and bounded
size. In a block the heavy items (frequent in their scope) are rows of a dense bit
matrix, and a pair of them is counted by the popcount of two rows; pairs of rare items
are counted by hashing; a rare item meets the heavy ones by probing the heavy lists of
the baskets in its posting list. Blocks give counts, not pairs of rows, so what is
shuffled is bounded by the distinct pairs of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from ..tables import last_delivery, load

#: Baskets of a block.
BLOCK = 65_536
#: An item is heavy if it is in at least a basket of so many, and in HEAVY_LEAST baskets.
HEAVY_SHARE = 256
HEAVY_LEAST = 32
#: Rare pairs that a block counts at once.
CHUNK = 4_000_000
#: Join keys at most over which the rows of a scope are spread when they are dealt.
SPREAD = 1024


def _count(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in parts])
    found, where = np.unique(codes, return_inverse=True)
    return found, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(found)).astype(np.int64)


class _HashCount:
    """Counts of codes, folded whenever CHUNK of them are waiting."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(np.unique(codes, return_counts=True))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > CHUNK:
            self.parts, self.waiting = [_count(self.parts)], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _count(self.parts) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for all i, one after another."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def heavy_pairs(basket: np.ndarray, item: np.ndarray, n_baskets: int, n_heavy: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, counts) of pairs of heavy items i < j, by popcounts of a bit matrix."""
    bits = np.zeros((n_heavy, -(-n_baskets // 64) * 8), np.uint8)
    np.bitwise_or.at(bits, (item, basket >> 3), (1 << (basket & 7)).astype(np.uint8))
    rows = bits.view(np.uint64)
    for i in range(n_heavy - 1):
        counts = np.bitwise_count(rows[i + 1 :] & rows[i]).sum(1, dtype=np.int64)
        js = np.flatnonzero(counts)
        yield i, js + i + 1, counts[js]


def block_pairs(offsets: np.ndarray, item: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items a < b and in how many baskets of the block they are together.

    ``offsets`` and ``item`` list the distinct items (numbers, rising within a basket)
    of each basket; ``heavy`` tells of each item number whether it is heavy.
    """
    n_items, n_baskets = len(heavy), len(offsets) - 1
    basket = np.repeat(np.arange(n_baskets), np.diff(offsets))
    is_heavy = heavy[item]
    count = _HashCount()

    heavy_ids = np.flatnonzero(heavy)
    place = np.cumsum(heavy) - 1
    h_item, h_basket = item[is_heavy], basket[is_heavy]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i, js, counts in heavy_pairs(h_basket, place[h_item], n_baskets, len(heavy_ids)):
        out.append((heavy_ids[i] * n_items + heavy_ids[js], counts))

    l_item, l_basket = item[~is_heavy], basket[~is_heavy]
    # Mixed: each place of a rare item's posting list probes the heavy list of that basket.
    per_basket = np.bincount(h_basket, minlength=n_baskets)
    starts = np.cumsum(per_basket) - per_basket
    step = max(1, CHUNK // max(1, int(per_basket.max(initial=0))))
    for at in range(0, len(l_item), step):
        own, where = l_item[at : at + step], l_basket[at : at + step]
        other = _spread(h_item, starts[where], per_basket[where])
        own = np.repeat(own, per_basket[where])
        count.add(np.minimum(own, other) * n_items + np.maximum(own, other))

    # Rare pairs: every place of a basket's rare list meets the places after it.
    per_basket = np.bincount(l_basket, minlength=n_baskets)
    ends = np.cumsum(per_basket)[l_basket]
    here = np.arange(len(l_item))
    after = ends - here - 1
    reach = np.cumsum(after)
    at = 0
    while at < len(l_item):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + CHUNK, side="right")))
        own = np.repeat(l_item[at:to], after[at:to])
        if len(own):
            count.add(own * n_items + _spread(l_item, here[at:to] + 1, after[at:to]))
        at = to
    found, n = count.total()
    codes = np.concatenate([*(c for c, _ in out), found])
    counts = np.concatenate([*(c for _, c in out), n])
    return codes // n_items, codes % n_items, counts


_PAIRS = "scope string, item_a string, item_b string, n_ab bigint, n_a bigint, n_b bigint, n_baskets bigint"


def _pair_block(baskets: pa.Table, stats: pa.Table) -> pa.Table:
    stats = stats.sort_by("item")
    items = stats.column("item").combine_chunks()
    lists = baskets.column("items").combine_chunks()
    number = pc.index_in(lists.flatten(), value_set=items).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    known = ~np.isnan(number) if number.dtype.kind == "f" else np.ones(len(number), bool)
    number, owner = number[known].astype(np.int64), owner[known]
    order = np.lexsort((number, owner))
    number, owner = number[order], owner[order]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lists)))])
    if not len(items) or not len(number):
        a = b = n = np.empty(0, np.int64)
    else:
        a, b, n = block_pairs(offsets, number, stats.column("heavy").to_numpy(zero_copy_only=False).astype(bool))
    each = stats.column("n").combine_chunks()
    ia, ib = pa.array(a), pa.array(b)
    return pa.table({
        "scope": stats.column("scope").combine_chunks().take(ia), "item_a": items.take(ia), "item_b": items.take(ib), "n_ab": pa.array(n, pa.int64()),
        "n_a": each.take(ia), "n_b": each.take(ib), "n_baskets": stats.column("n_baskets").combine_chunks().take(ia),
    })


def pair_counts(baskets: DataFrame, scope: str, items: str, least_together: int = 1, least_lift: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Pairs of items of one scope: scope, item_a < item_b, n_ab, n_a, n_b, n_baskets, lift.

    ``items`` is an array; nulls and repeats in it don't count, and a row without items
    is no basket. A null scope is a scope of its own. lift = n_ab * n_baskets / (n_a * n_b).
    Pairs below ``least_together`` or ``least_lift`` are left out; items that can't be
    in such a pair (fewer baskets than ``least_together``, or more than
    n_baskets / least_lift) are dropped before pairing, which loses no pair.

    Skew: a hot scope is dealt into blocks of about ``block`` baskets, and statistics of
    an item are shuffled once a block, not once a basket. At most HEAVY_SHARE times the
    mean basket's size items of a scope are heavy, which bounds the bit matrix.
    """
    rows = baskets.select(F.coalesce(F.col(scope), F.lit("\x00")).alias("scope"), F.array_distinct(F.array_compact(items)).alias("items")).filter(F.size("items") > 0)
    rows = written(rows.withColumn("draw", F.xxhash64(F.monotonically_increasing_id())), "baskets")
    scopes = rows.groupBy("scope").agg(F.count("*").alias("n_baskets"))
    # Only scopes of more than a block are dealt; those are few, and each is listed once for every block of it.
    large = scopes.filter(F.col("n_baskets") > block).select(F.col("scope").alias("_s"), F.ceil(F.col("n_baskets") / block).alias("_n"))
    most = large.agg(F.max("_n")).first()[0] or 1
    dealt = rows.withColumn("block", F.lit(0))
    if most > 1:
        # A hot scope's rows meet its line under as many join keys as it has blocks (up to SPREAD), so no task gets them all.
        spread = min(most, SPREAD)
        listed = large.select("_s", "_n", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_d"))
        own = (F.col("scope") == F.col("_s")) & (F.pmod(F.shiftright("draw", 20), F.lit(spread)) == F.col("_d"))
        dealt = rows.join(listed, own, "left").withColumn("block", F.coalesce(F.pmod("draw", F.col("_n")), F.lit(0)))
    dealt = written(dealt.select("scope", F.col("block").cast("int").alias("block"), "items"), "dealt")
    local = written(dealt.select("scope", "block", F.explode("items").alias("item")).groupBy("scope", "block", "item").agg(F.count("*").alias("n_here")), "items")
    total = local.groupBy("scope", "item").agg(F.sum("n_here").alias("n")).join(scopes, "scope")
    total = total.filter((F.col("n") >= least_together) & (F.col("n") * least_lift <= F.col("n_baskets")))
    total = total.withColumn("heavy", (F.col("n") >= HEAVY_LEAST) & (F.col("n") * HEAVY_SHARE >= F.col("n_baskets")))
    stats = local.select("scope", "block", "item").join(total, ["scope", "item"])
    pairs = dealt.groupBy("scope", "block").cogroup(stats.groupBy("scope", "block")).applyInArrow(_pair_block, _PAIRS)
    whole = pairs.groupBy("scope", "item_a", "item_b").agg(F.sum("n_ab").alias("n_ab"), *(F.max(c).alias(c) for c in ("n_a", "n_b", "n_baskets")))
    # Products as decimals: they leave the range of bigint before they leave that of the data.
    wide = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    kept = whole.filter((F.col("n_ab") >= least_together) & (wide("n_ab", "n_baskets").cast("double") >= F.lit(float(least_lift)) * wide("n_a", "n_b").cast("double")))
    lift = F.col("n_ab").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return kept.select(F.nullif("scope", F.lit("\x00")).alias(scope), "item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", lift.alias("lift"))


def clean_modules(modules: str) -> Column:
    """A commit's modules without surrounding blanks, empty names, nulls and repeats."""
    return F.array_distinct(F.filter(F.transform(modules, lambda m: F.regexp_replace(m, r"(?U)^\s+|\s+$", "")), lambda m: m.isNotNull() & (m != "")))


def commits(history: DataFrame) -> DataFrame:
    """The last delivery of each commit: hash (lower case), repo_key, modules (cleaned), cochange_count.

    Deliveries without a hash belong to no commit.
    """
    named = history.filter(F.col("hash").isNotNull()).select(F.lower(F.trim("hash")).alias("hash"), "repo_key", "modules", "cochange_count", "ingested_at")
    last = last_delivery(named, ["hash"], "ingested_at")
    return last.select("hash", "repo_key", F.coalesce(clean_modules("modules"), F.array().cast("array<string>")).alias("modules"), "cochange_count")


def p2_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of modules that any commit has together."""
    found = pair_counts(commits(load(spark, sf_dir, "history")), "repo_key", "modules")
    return found.withColumnsRenamed({"item_a": "module_a", "item_b": "module_b"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pair_counts(commits(load(spark, sf_dir, "history")), "repo_key", "modules", least_together=6, least_lift=4.0)
    return found.select("repo_key", F.col("item_a").alias("module_a"), F.col("item_b").alias("module_b"))


def p2_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each commit, the cochange_count it has and the number of modules that each of its modules changed with."""
    own = commits(load(spark, sf_dir, "history"))
    return own.select("hash", "repo_key", F.col("cochange_count").alias("given"), F.greatest(F.size("modules") - 1, F.lit(0)).cast("bigint").alias("expected"))


_COMMITS_SQL = """
with c as (
  select hash, repo_key, cochange_count, coalesce(list_distinct(list_filter(list_transform(modules, lambda m: trim(m)), lambda m: m is not null and m <> '')), []) ms
  from (select lower(trim(hash)) hash, repo_key, modules, cochange_count, row_number() over (partition by lower(trim(hash)) order by ingested_at desc nulls last) rn from history where hash is not null) where rn = 1
)"""
_PAIRS_SQL = _COMMITS_SQL + """, n as (select repo_key, count(*) n_baskets from c where len(ms) > 0 group by 1),
i as (select hash, repo_key, unnest(ms) m from c),
s as (select repo_key, m, count(*) k from i group by all),
p as (select a.repo_key, a.m module_a, b.m module_b, count(*) n_ab from i a join i b on a.hash = b.hash and a.m < b.m group by all),
l as (select p.repo_key, module_a, module_b, n_ab, sa.k n_a, sb.k n_b, n_baskets, n_ab::double * n_baskets / (sa.k::double * sb.k) lift
  from p join s sa on sa.repo_key = p.repo_key and sa.m = module_a join s sb on sb.repo_key = p.repo_key and sb.m = module_b join n on n.repo_key = p.repo_key)
"""  # fmt: skip

QUERIES = {"p2_found": p2_found, "p2_lift": p2_lift, "p2_cochange": p2_cochange}
SQL = {
    "p2_found": _PAIRS_SQL + "select repo_key, module_a, module_b from l where n_ab >= 6 and n_ab * n_baskets >= 4 * n_a * n_b",
    "p2_lift": _PAIRS_SQL + "select * from l",
    "p2_cochange": _COMMITS_SQL + "select hash, repo_key, cochange_count given, greatest(len(ms) - 1, 0)::bigint expected from c",
}
