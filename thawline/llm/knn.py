"""Exact top-k by inner product: a Voronoi kNN join.

Inner products become distances: with M the greatest norm, x gets one more component sqrt(M^2 - |x|^2) and a query a
zero, so that the nearest are those of greatest product. Pivots are vectors drawn by hash of their ids. Queries and
data fall into the cells of their nearest pivots. From each cell's summary (radius, least distances to its pivot)
comes a bound on the k-th neighbour's distance for all queries of a cell. Neighbouring query cells form groups of about
``query_block`` queries; a vector goes once to each group with a cell whose bound it can meet, and to no other. What a
group gets is solved in chunks of about ``data_block`` vectors, and the best of all chunks are ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thawline.llm.common import materialize

LONG = np.iinfo(np.int64)


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as long (the nearest long, if beyond); null for vectors that take no part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` components, shorter ones padded by zeros."""
    flat, size = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Between rows of (x, extra) and pivots."""
    y = np.column_stack((x.astype(np.float64), extra))
    sq = (y * y).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * y @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)


def best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best rows but its own; ties to smaller ids. Scores beyond a long are the nearest long."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    top = _largest(queries) * _largest(data) * max(data.shape[1], 1)
    exact = object if top > LONG.max else np.int64 if top >= 1 << 53 else np.float64
    columns, out = data.astype(exact).T, []
    for a in range(0, len(queries), 128):
        scores = queries[a : a + 128].astype(exact) @ columns
        scores = (np.clip(scores, LONG.min, LONG.max) if exact is object else scores).astype(np.int64)
        for q, row in zip(query_ids[a : a + 128], scores, strict=True):
            own = np.searchsorted(ids, [q, q + 1])
            at = np.concatenate((np.arange(own[0]), np.arange(own[1], len(ids)))) if own[1] > own[0] else np.arange(len(ids))
            s = row[at]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                keep = s >= least
                at, s = at[keep], s[keep]
            first = np.lexsort((at, -s.astype(object) if exact is object else -s))[:k]
            out.append((np.full(len(first), q), ids[at[first]], s[first]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def _groups(pivots: np.ndarray, cells: np.ndarray, sizes: dict[int, int], block: int) -> tuple[np.ndarray, list[int]]:
    """Group of each of ``cells``, neighbours together, of about ``block`` queries; and the blocks of each group.

    From the first cell on, the nearest cell left comes next. A cell of more queries is a group alone, in several blocks.
    """
    group, blocks, filled = np.zeros(len(cells), np.int64), [], block
    left, at = list(range(len(cells))), 0
    while left:
        left.remove(at)
        n = sizes[int(cells[at])]
        if filled + n > block:
            blocks.append(-(-n // block))
            filled = 0
        group[at], filled = len(blocks) - 1, filled + n
        if left:
            at = left[int(((pivots[cells[left]] - pivots[cells[at]]) ** 2).sum(1).argmin())]
    return group, blocks


def top_k(
    data: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    pivots: int | None = None,
    query_block: int = 16384,
    data_block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest integer inner product for each query.

    Components become floor(scale * x), of either end of the longs where they lie beyond; so do scores. Every row but
    the query's own is a candidate; fewer than k give as many rows. Ties go to the smaller vec_id. Vectors that are
    null, hold null or non-finite components or lack an id take no part. A shorter vector counts as padded by zeros, an
    empty one as zero. Rows that share a vec_id are one vector, the least of them. Other columns are left out; an empty
    table gives an empty result. ``pivots`` (default: one for 2,000 rows, 16 to 1,024) bounds what the driver holds:
    their vectors, and k + 1 distances of each.
    """
    sent = replicas(data, is_query, k, vec_id, vector, scale, pivots, query_block, data_block)
    if sent is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asks, spread, dim = sent

    def solve(key, left, right):
        get = lambda t, c: t.column(c).combine_chunks()
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        found = best(_matrix(get(left, "v"), dim), get(left, "id").to_numpy(), _matrix(get(right, "v"), dim), get(right, "id").to_numpy(), k)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    keys = ["group", "block", "chunk"]
    found = asks.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def replicas(
    data: DataFrame, is_query: Column, k: int, vec_id: str, vector: str, scale: float, pivots: int | None, query_block: int, data_block: int
) -> tuple[DataFrame, DataFrame, int] | None:
    """Queries and vectors (id, v, group, block, chunk) as they are sent, and the vectors' length; None without queries."""
    spark: SparkSession = data.sparkSession
    rows = data.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and v is not null")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dim, norm = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not n:
        return None
    m = min(n, pivots or min(1024, max(16, n // 2000)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(m).select("v").collect()  # bounded by pivots
    p = np.zeros((len(drawn), dim))
    for i, r in enumerate(drawn):
        p[i, : len(r["v"])] = r["v"]
    p = np.unique(p, axis=0)
    p = np.column_stack((p, np.sqrt(np.maximum(norm - (p * p).sum(1), 0))))

    def lift(v: np.ndarray) -> np.ndarray:
        f = v.astype(np.float64)
        return np.sqrt(np.maximum(norm - (f * f).sum(1), 0))

    def assign(batches):
        for batch in batches:
            v, asks = _matrix(batch.column(1), dim), batch.column(2).to_numpy(zero_copy_only=False)
            for cells, kind, rows in ((lift(v), False, np.arange(len(v))), (np.zeros(len(v)), True, np.flatnonzero(asks))):
                d = _distances(v[rows], cells[rows], p)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(rows)), cell]), pa.array([kind] * len(rows), pa.bool_())],
                    names=["id", "cell", "away", "asks"],
                )

    assigned = materialize(rows.mapInArrow(assign, "id long, cell int, away double, asks boolean"), "cells")
    sizes = assigned.groupBy("asks", "cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()
    order = Window.partitionBy("cell").orderBy("away")
    near = assigned.where("not asks").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("cell", "away").collect()
    asked = {r["cell"]: r for r in sizes if r["asks"]}
    if not asked:
        return None
    between = _distances(p[:, :-1], p[:, -1], p)
    slack = 1e-6 * (1 + norm**0.5)
    near_cell, near_away = np.array([r["cell"] for r in near]), np.array([r["away"] for r in near])
    cells = np.array(sorted(asked), np.int64)
    reach = np.zeros(len(cells))
    for x, i in enumerate(cells):
        bounds = asked[i]["high"] + between[i, near_cell] + near_away
        reach[x] = np.partition(bounds, k)[k] if len(bounds) > k else np.inf
    high, low = (np.array([asked[i][c] for i in cells]) for c in ("high", "low"))
    group, blocks = _groups(p, cells, {c: r["n"] for c, r in asked.items()}, query_block)
    of_group = (group[:, None] == np.arange(len(blocks))).astype(np.float32)
    chunks = -(-n // data_block)

    def replicate(batches):
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            for a in range(0, len(v), 4096):
                w = v[a : a + 4096]
                d = _distances(w, lift(w), p)
                own = d.argmin(1)
                to = d[:, cells]
                least = np.maximum(to - high, low - to)
                gap = between[own][:, cells]
                plane = np.divide(to**2 - (d[np.arange(len(w)), own] ** 2)[:, None], 2 * gap, out=np.zeros_like(to), where=gap > 0)
                row, col = np.nonzero((np.maximum(least, plane) <= reach + slack).astype(np.float32) @ of_group)
                for b in range(0, len(row), 20_000):
                    r = pa.array(row[b : b + 20_000] + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(r), batch.column(1).take(r), pa.array(col[b : b + 20_000], pa.int32())], names=["id", "v", "group"])

    numbers = lambda x: F.array(*[F.lit(int(i)) for i in x])
    many = F.get(numbers(blocks), F.col("group"))
    spread = rows.select("id", "v").mapInArrow(replicate, "id long, v array<long>, group int")
    spread = spread.withColumns({"chunk": F.pmod(F.xxhash64("id"), F.lit(chunks)), "block": F.explode(F.sequence(F.lit(0), many - 1))})
    group_of = np.zeros(len(p), np.int64)
    group_of[cells] = group
    asks = assigned.where("asks").select("id", F.get(numbers(group_of), F.col("cell")).alias("group")).join(rows.where("asks").select("id", "v"), "id")
    asks = asks.withColumns({"block": F.pmod(F.xxhash64("id"), many).cast("int"), "chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))})
    return asks, spread, dim
