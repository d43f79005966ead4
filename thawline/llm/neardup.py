"""Near duplicates among vectors of one label: spherical k-means cells, blocked cosine products, one kept a group.

Equal vectors of a label count once, with their number. Labels of more than ``cell`` vectors are cut into cells by
spherical k-means, fitted on a bounded sample; each vector is at home in the cell of its nearest centre. A pair of
cosine ``least`` lies within a chord of sqrt(2 - 2 least), so a vector nearer than that to the plane between its own
and another cell's centre is also a guest of that other cell (of the two cells the one of smaller number, so that a pair
meets once): no pair is lost to the cells' borders. A cell's members are dealt to chunks of ``block`` vectors, and every
two chunks meet in one task, whose matrix products give, for each vector, the number of its links and one member of its
group in that task; pairs themselves are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thawline.llm.common import materialize, spread
from thawline.llm.components import components

#: Rows of a product computed at once.
TILE = 512


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows to unit length; scaled by their greatest component first, which no square can then drown or burst."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` centres or fewer of unit rows: the first is row 0, each next one the row least like those taken; then Lloyd's rounds."""
    taken, best = [0], x @ x[0]
    while len(taken) < min(k, len(x)):
        nxt = int(best.argmin())
        if best[nxt] > 1 - 1e-9:
            break
        taken.append(nxt)
        best = np.maximum(best, x @ x[nxt])
    centres = x[taken]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        moved = np.where(length > 1e-9, sums / np.maximum(length, 1e-300), centres)
        if np.abs(moved - centres).max() < 1e-6:
            break
        centres = moved
    return centres


def fit_cells(distinct: DataFrame, cell: int, most_cells: int, per_cell: int) -> dict[tuple, np.ndarray]:
    """Centres of each (label, dim) of more than ``cell`` vectors; at most ``most_cells`` in all, where that leaves each such label two.

    Fitted in one task a label, on about ``per_cell`` vectors a centre drawn by hash; centres are what the driver holds.
    """
    sizes = distinct.groupBy("label", "dim").count().where(F.col("count") > cell)
    large = sizes.orderBy(F.desc("count"), "label", "dim").limit(most_cells // 2).collect()  # other labels are one cell each, in chunks
    wanted = {(r["label"], r["dim"]): -(-r["count"] // cell) for r in large}
    scale = min(1.0, most_cells / max(1, sum(wanted.values())))
    wanted = {key: max(2, int(k * scale)) for key, k in wanted.items()}
    if not wanted:
        return {}
    share = {(r["label"], r["dim"]): min(1.0, per_cell * wanted[r["label"], r["dim"]] / r["count"]) for r in large}
    spark = distinct.sparkSession
    label = distinct.schema["label"].dataType.simpleString()
    plan = spark.createDataFrame([(a, d, wanted[a, d], float(share[a, d])) for a, d in wanted], f"label {label}, dim int, k int, share double")
    drawn = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.col("share") * float(1 << 30)

    def fit(key, t):
        x = unit(matrix(t.column("v").combine_chunks()))
        centres = spherical_kmeans(x, t.column("k")[0].as_py())
        return pa.table({"label": pa.array([key[0].as_py()] * len(centres), t.schema.field("label").type), "dim": pa.array([key[1].as_py()] * len(centres), pa.int32()), "c": pa.array(list(centres), pa.list_(pa.float64()))})

    found = distinct.join(F.broadcast(plan), ["label", "dim"]).where(drawn).select("label", "dim", "k", "v").groupBy("label", "dim").applyInArrow(fit, f"label {label}, dim int, c array<double>").collect()
    out: dict[tuple, list] = {}
    for r in found:
        out.setdefault((r["label"], r["dim"]), []).append(r["c"])
    return {key: np.array(c) for key, c in out.items()}


def members(distinct: DataFrame, centres: dict[tuple, np.ndarray], least: float) -> DataFrame:
    """(label, dim, cell, home, node, m, v): each vector at home in one cell, and the guest of those that a partner may be at home in."""
    spark = distinct.sparkSession
    chord = np.sqrt(2 - 2 * least) + 1e-9
    held = spark.sparkContext.broadcast(centres)

    def assign(batches):
        names = ["label", "dim", "cell", "home", "node", "m", "v"]
        for batch in batches:
            t = pa.Table.from_batches([batch])
            label, dim = t.column("label").to_pylist(), t.column("dim").to_numpy()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(label, dim.tolist(), strict=True)):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                rows = batch.take(pa.array(at))
                c = held.value.get(key)
                row, cell, home = np.arange(len(at)), np.zeros(len(at), np.int32), np.ones(len(at), bool)
                if c is not None:
                    x = unit(matrix(rows.column(rows.schema.get_field_index("v"))))
                    like = x @ c.T
                    own = like.argmax(1)
                    apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-300))
                    away = (like[row, own][:, None] - like) / apart[own]  # from the plane between two centres
                    guest = (away <= chord) & (np.arange(len(c)) < own[:, None])
                    g_row, g_cell = np.nonzero(guest)
                    row, cell = np.concatenate((row, g_row)), np.concatenate((own, g_cell)).astype(np.int32)
                    home = np.arange(len(row)) < len(at)
                for a in range(0, len(row), 10_000):
                    part = rows.take(pa.array(row[a : a + 10_000]))
                    get = lambda n: part.column(part.schema.get_field_index(n))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([get("label"), get("dim"), pa.array(cell[a : a + 10_000]), pa.array(home[a : a + 10_000]), get("node"), get("m"), get("v")], names=names)

    label = distinct.schema["label"].dataType.simpleString()
    v = distinct.schema["v"].dataType.simpleString()
    return distinct.select("label", "dim", "node", "m", "v").mapInArrow(assign, f"label {label}, dim int, cell int, home boolean, node long, m long, v {v}")


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return x @ y.T >= least


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each one's group, by its links."""
    root = np.arange(n)
    if not pairs:
        return root
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return root
        root = new


def compare(x: np.ndarray, home: np.ndarray, m: np.ndarray, chunk: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each unit row, counted by the partner's ``m``, and its group's least row.

    Rows of two chunks meet across them; of one chunk, each pair of rows. Two guests don't meet. Of a row's links to
    one chunk's group one is kept: a row is tied to the first row that it links with in a tile, and rows of a tile
    that share a link are tied by it.
    """
    n = len(x)
    count, ties = np.zeros(n, np.int64), []
    left, right = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk == chunk.max())
    one = chunk.min() == chunk.max()
    for a in range(0, len(left), TILE):
        i = left[a : a + TILE]
        for b in range(a if one else 0, len(right), TILE):
            j = right[b : b + TILE]
            near = _linked(x[i], x[j], least) & (home[i][:, None] | home[j])
            if one and a == b:
                near &= np.arange(len(i))[:, None] < np.arange(len(j))
            if not near.any():
                continue
            count[i] += near @ m[j]
            count[j] += m[i] @ near
            r, c = near.any(1).nonzero()[0], near.any(0).nonzero()[0]
            ties.append((i[r], j[near[r].argmax(1)]))
            ties.append((i[near[:, c].argmax(0)], j[c]))
            local = _roots(len(i) + len(j), [(near.nonzero()[0], near.nonzero()[1] + len(i))])
            both = np.concatenate((i, j))
            ties.append((both, both[local]))
    return count, _roots(n, ties)


def links(placed: DataFrame, least: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, n) links counted, and (a, b) ties that hold each group together."""
    keys = ["label", "dim", "cell"]
    sizes = placed.groupBy(*keys).count().where(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("chunks"))
    dealt = placed.join(sizes, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.withColumn("other", meets).withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")}).drop("other", "chunks")

    def solve(key, t):
        get = lambda c: t.column(c).combine_chunks()
        node, m, chunk = (get(c).to_numpy() for c in ("node", "m", "chunk"))
        if len(node) < 2 or (key[-2].as_py() != key[-1].as_py() and chunk.min() == chunk.max()):  # none to meet
            none = pa.array([], pa.int64())
            return pa.table({"node": none, "n": none, "root": none})
        order = np.argsort(node, kind="stable")
        x = unit(matrix(get("v")))[order]
        count, root = compare(x, get("home").to_numpy(zero_copy_only=False)[order], m[order], chunk[order], least)
        at = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
        node = node[order]
        return pa.table({"node": pa.array(node[at]), "n": pa.array(count[at]), "root": pa.array(node[root[at]])})

    found = materialize(dealt.groupBy(*keys, "one", "two").applyInArrow(solve, "node long, n long, root long"), "links")
    return found.groupBy("node").agg(F.sum("n").alias("n")), found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, all components numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def near_duplicates(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.98,
    cell: int = 1024,
    block: int = 4096,
    most_cells: int = 1024,
    per_cell: int = 32,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row each of ``rows``.

    Two vectors link when their labels are equal and not null, they have the same length, and their cosine in double precision is
    ``least`` or more. n_links counts the other rows linked directly; component_id is the least vec_id reachable by links, its
    own included; kept tells whether that is its own. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do those without label. Repeated rows link with each other; rows that share a vec_id
    count as rows of their own. Rows without vec_id count as links, but name no component unless all of its rows are
    such; these are kept. Other columns are left out, whatever their names; an empty table gives an empty result.
    The result is exact whatever the cells; ``most_cells`` and ``per_cell`` bound what is sampled to fit them, ``block``
    what a task holds.
    """
    v = F.col(vector)
    plain = rows.select(F.col(vec_id).alias("vec_id"), F.when(usable(v) & F.col(label).isNotNull(), v).alias("v"), F.col(label).alias("label"))
    plain = spread(plain)
    groups = plain.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("m"), F.min("vec_id").alias("first"))
    distinct = materialize(groups.select("label", F.size("v").alias("dim"), "v", "m", "first", F.monotonically_increasing_id().alias("node")), "vectors")
    placed = materialize(members(distinct, fit_cells(distinct, cell, most_cells, per_cell), least), "members")
    counts, ties = links(placed, least, block)
    group_of = components(ties).select("node", "component")
    known = distinct.select("label", "v", "m", "first", "node").join(counts, "node", "left").join(group_of, "node", "left")
    known = materialize(known.withColumn("component", F.coalesce("component", "node")), "known")
    firsts = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(firsts, "component").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    known = materialize(known, "known")
    out = plain.where("v is not null").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")  # many equal rows: split by AQE
    alone = plain.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("vec_id", vec_id)
