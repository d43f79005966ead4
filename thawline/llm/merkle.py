"""Merkle manifest of a dataset: a tree of hashes a group of rows, and one over the groups' roots.

H is the lower-case hex SHA-256 of its inputs one after another, digests as hex text. Rows become leaves, which are placed
within their group by a sort over the cluster (ranges are counted, so that no group is in one task). Trees grow by
lag and lead windows: a level's siblings are columns at fixed offsets, 1 to ``arity - 1`` nodes before and after,
masked by the node's slot in its run and by the run's length; the row of a run's first child hashes the parent. Windows are
over blocks of ``arity ** LEVELS`` leaves, each one exchange for ``LEVELS`` levels; a block's topmost node is a leaf of
the next tier, which has a row for each block only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thawline.llm.common import materialize, shuffle_parts, spread

#: Levels that one exchange serves.
LEVELS = 4


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """H of values: each its UTF-8 bytes' count, a colon and itself, or ``-`` for null. Numbers count as decimal text."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _ceil(n: Column, by: int) -> Column:
    return F.floor((n + (by - 1)) / by)


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with tree (the group's place among the groups, null first), pos (the row's in its group, from 0) and n (rows of the group).

    The sort is by range of group, ``order`` and the row's place in its partition, so that equal rows are spread too.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    sorted_rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    sorted_rows = materialize(sorted_rows.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sorted")
    runs = sorted_rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))  # a row a range, and one a group
    runs = materialize(runs, "runs")
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = runs.withColumns({"_before": before, "n": F.sum("_rows").over(of_group)}).drop("_rows")
    groups = numbered(runs.select(group).distinct(), group)
    same = lambda a, b, *more: [F.col(f"{a}.{group}").eqNullSafe(F.col(f"{b}.{group}")), *[F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in more]]
    counted = counted.alias("a").join(groups.alias("b"), same("a", "b")).select("a.*", "b.tree")
    counted = materialize(counted, "counted")
    out = sorted_rows.alias("a").join(counted.alias("b"), same("a", "b", "_part"))
    return out.select("a.*", "b.tree", (F.col("a._at") - F.col("b._first") + F.col("b._before")).alias("pos"), "b.n").drop("_part", "_at")


def numbered(groups: DataFrame, group: str) -> DataFrame:
    """Distinct ``group`` values with their place in order (tree), null first: sorted by range, ranges counted."""
    key = F.col(group).asc_nulls_first()
    rows = groups.repartitionByRange(shuffle_parts(groups.sparkSession), key).sortWithinPartitions(key)
    rows = materialize(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "groups")
    sizes = rows.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))  # a row a range
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.withColumn("_before", before), "_part").select(group, (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree"))


def tier(nodes: DataFrame, arity: int, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (tree, pos, n, node) with block, path (before, after: siblings' digests by level) and up, the node ``levels`` above."""
    size = arity**levels
    in_block = Window.partitionBy("tree", "block").orderBy("pos")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes.withColumns({"block": F.floor(F.col("pos") / size), "up": F.col("node")})
    for level in range(levels):
        step = arity**level
        own, many = F.floor(F.col("pos") / step), _ceil(F.col("n"), step) > 1
        slot = own % arity
        run = F.least(F.lit(arity), _ceil(F.col("n"), step) - (own - slot))
        lags = {f"_b{d}": F.lag("up", d * step).over(in_block) for d in range(1, arity)}
        leads = {f"_a{d}": F.lead("up", d * step).over(in_block) for d in range(1, arity)}
        rows = rows.withColumns(lags | leads)
        before = F.concat_ws("", *[F.when(slot >= d, F.col(f"_b{d}")) for d in reversed(range(1, arity))])
        after = F.concat_ws("", *[F.when(slot + d < run, F.col(f"_a{d}")) for d in range(1, arity)])
        first = F.col("pos") % step == 0  # the row that stands for its node of this level
        parent = F.when(F.col("pos") % (step * arity) == 0, F.when(many, digest(F.col("up"), after)).otherwise(F.col("up")))
        rows = rows.withColumns({f"_s{level}": F.when(first & many, F.struct(before.alias("before"), after.alias("after"))), "_up": parent}).drop(*lags, *leads)
        held = {"up": F.last("_up", True).over(so_far)} | ({f"_s{level}": F.last(f"_s{level}", True).over(so_far)} if level else {})
        rows = rows.withColumns(held).drop("_up")
    siblings = [f"_s{level}" for level in range(levels)]
    return rows.withColumn("path", F.array_compact(F.array(*siblings))).drop(*siblings)


def grown(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, pos, n, node and others) with root, their tree's, and path, all siblings from the leaf up."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    size, tiers = arity**LEVELS, [nodes]
    while most > 1:
        rows = tier(tiers[-1].select("tree", "pos", "n", "node"), arity)
        rows = rows.where(F.col("pos") % size == 0).select("tree", F.col("block").alias("pos"), _ceil(F.col("n"), size).alias("n"), F.col("up").alias("node"))
        tiers.append(materialize(rows, "tier"))
        most = -(-most // size)
    above = tiers.pop().withColumns({"root": F.col("node"), "path": F.array().cast("array<struct<before:string,after:string>>")})
    for rows in reversed(tiers):
        above = above.select("tree", F.col("pos").alias("block"), "root", F.col("path").alias("_above"))
        above = tier(rows, arity).join(above, ["tree", "block"]).withColumn("path", F.concat("path", "_above")).drop("_above", "block", "up")
    return above


def fold(first: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, first, lambda h, s: digest(s["before"], h, s["after"]))


def siblings(path: Column) -> Column:
    """Digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(
    rows: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "lang",
    arity: int = 8,
    changed: Column | None = None,
) -> DataFrame:
    """(``key``, ``group``, leaf, subroot, root, path, changed_leaf): a row each of ``rows``.

    A leaf is H of ``columns``. Within a group leaves ascend by key (null first); while there are several nodes, each
    ``arity`` consecutive ones, of the last run fewer, become their H. What remains is the group's subroot, a lone leaf
    itself. Subroots, ordered by group (null first, by bytes), give the root likewise. path holds the siblings of each level, from
    the leaf to the root: ``fold(leaf, path)`` is the root. Rows that share group and key are leaves of their own,
    ordered by digest; repeated rows are equal leaves. ``changed``: the leaf of a row's later state, or null, returned as changed_leaf.
    Other columns are left out; an empty table gives an empty result.
    """
    values = [F.col(c) for c in columns]
    picked = spread(rows).select(F.col(key).alias("key"), F.col(group).alias("group"), leaf(values).alias("leaf"), (changed if changed is not None else F.lit(None).cast("string")).alias("changed_leaf"))
    leaves = placed(picked, "group", ["key", "leaf"]).withColumnRenamed("leaf", "node")
    subroots = grown(leaves.select("tree", "pos", "n", "node"), arity).where("pos = 0").select(F.col("tree").alias("pos"), F.col("root").alias("node"))
    subroots = materialize(subroots, "subroots")
    n = subroots.count()
    tops = grown(subroots.withColumns({"tree": F.lit(0).cast("long"), "n": F.lit(n).cast("long")}), arity)
    tops = materialize(tops.select(F.col("pos").alias("tree"), F.col("node").alias("subroot"), F.col("root"), F.col("path").alias("_above")), "tops")
    out = grown(leaves, arity).drop("root").join(tops, "tree")
    return out.select(F.col("key").alias(key), F.col("group").alias(group), F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "_above").alias("path"), "changed_leaf")
