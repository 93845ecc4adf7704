"""Exact top-k inner-product search with cover trees over queries and data.

Vectors are dealt to cells by their nearest center, and large cells to blocks of
bounded size.  A query goes only to the cells whose center and covering radius
allow a score as good as the kth it already has; that comes from a first pass
over the cell of its best center.  In a task a block's cover tree is built once,
the queries that reached it come in batches, and both trees are descended
together: a pair of nodes is left out when even the best score their covering
radii allow is below the worst kth score of the node's queries.  Pairs that are
left are multiplied in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.store import written

LEAF = 48
CHILDREN = 64
TILE = 1 << 20  # pairs multiplied at once
TALL = 512  # queries in such a tile
NONE = np.iinfo(np.int64).min


class CoverTree:
    """Nodes over the rows of a matrix; each covers a slice of ``order`` within its radius of a row of its own.

    A node's children are a net of its rows: centers are taken farthest first
    until every row is within half the node's radius of one (or there are
    ``CHILDREN``, or one for ``LEAF`` rows); the node's own center is the first
    child's.  Unless ``whole``, children are made when they are first asked for.
    """

    def __init__(self, points: np.ndarray, whole: bool = True):
        self.points = points
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, float, list[int]]] = []  # lo, hi, center, radius, children
        self.made: list[bool] = []
        self._node(0, len(points), 0, float(self._far(points, 0).max()))
        me = 0
        while whole and me < len(self.nodes):
            self.children(me)
            me += 1

    def _node(self, lo: int, hi: int, center: int, radius: float) -> int:
        self.nodes.append((lo, hi, center, radius, []))
        self.made.append(False)
        return len(self.nodes) - 1

    def _far(self, points: np.ndarray, center: int) -> np.ndarray:
        away = points - self.points[center]
        return np.sqrt(np.einsum("ij,ij->i", away, away))

    def children(self, me: int) -> list[int]:
        lo, hi, center, radius, kids = self.nodes[me]
        if self.made[me]:
            return kids
        self.made[me] = True
        if hi - lo <= LEAF or radius == 0:
            return kids
        rows = self.order[lo:hi]
        points = self.points[rows]
        near = self._far(points, center)
        centers, mine = [center], np.zeros(hi - lo, np.int64)
        while near.max() > radius / 2 and len(centers) < min(CHILDREN, -(-(hi - lo) // LEAF)):
            new = int(rows[near.argmax()])
            far = self._far(points, new)
            closer = far < near
            mine[closer], near = len(centers), np.minimum(near, far)
            centers.append(new)
        by = np.argsort(mine, kind="stable")
        self.order[lo:hi], near = rows[by], near[by]
        ends = np.cumsum(np.bincount(mine, minlength=len(centers))).tolist()
        for c, a, b in zip(centers, [0, *ends[:-1]], ends, strict=True):
            if a < b:
                kids.append(self._node(lo + a, lo + b, c, float(near[a:b].max())))
        return kids


class Best:
    """The k best of what each query was shown; ``worst`` is a score that a better one has to reach, ``NONE`` where any will do."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.worst = k, np.where(floor > NONE, floor, NONE).astype(np.int64)
        self.held = [(np.zeros(0, np.int64),) * 3]
        self.new, self.most = 0, max(1 << 16, 2 * k * len(floor))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((rows, scores, ids))
        self.new += len(rows)
        if self.new > self.most:
            self.sort()

    def sort(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, score, id) of what is kept, by row and place."""
        rows, scores, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        at = np.lexsort((ids, ~scores, rows))  # ~x falls as x grows and cannot overflow
        rows, scores, ids = rows[at], scores[at], ids[at]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows)))
        kept = place < self.k
        rows, place, scores, ids = rows[kept], place[kept], scores[kept], ids[kept]
        self.held, self.new = [(rows, scores, ids)], 0
        last = place == self.k - 1
        self.worst[rows[last]] = np.maximum(self.worst[rows[last]], scores[last])
        return rows, place, scores, ids


def dual_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, floor: np.ndarray, k: int, tree: CoverTree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best points (its own id left out), ``NONE`` where there are fewer.

    Scores below a query's ``floor`` are missing.  Rows are integers.  No
    partial sum of a product exceeds the product of the norms, so below 2**24
    float32 makes no rounding, below 2**53 float64; others are multiplied as
    integers.

    A pair of nodes of up to ``TILE`` pairs of rows is multiplied.  Of a larger
    one both nodes' children are held against each other: where at least half of
    the pairs of rows is left out, or no worst score is known yet, the rest goes
    on, best bound first; otherwise the pair is multiplied, in tiles.
    """
    q, p = CoverTree(queries.astype(np.float64), whole=False), tree or CoverTree(points.astype(np.float64), whole=False)
    norm_q, norm_p = np.sqrt((q.points**2).sum(1)), np.sqrt((p.points**2).sum(1))
    largest = float(norm_q.max(initial=0)) * float(norm_p.max(initial=0))
    kind = np.float32 if largest < 2**24 * 0.999 else np.float64 if largest < 2**53 * 0.999 else np.int64
    lowest = NONE if kind is np.int64 else -np.inf
    q_rows, p_rows = queries.astype(kind), points.astype(kind)
    slack = 1.0 + largest * 1e-10
    best = Best(k, floor)
    by = np.argsort(ids, kind="stable")
    first, last = np.searchsorted(ids[by], query_ids, "left"), np.searchsorted(ids[by], query_ids, "right")
    own_q = np.repeat(np.arange(len(queries)), last - first)
    own_p = by[np.arange(len(own_q)) - np.repeat(np.cumsum(last - first) - last, last - first)]

    def bounds(a: list[int], b: list[int]) -> np.ndarray:
        ca, cb = [q.nodes[x][2] for x in a], [p.nodes[x][2] for x in b]
        ra, rb = np.array([q.nodes[x][3] for x in a])[:, None], np.array([p.nodes[x][3] for x in b])[None, :]
        return q.points[ca] @ p.points[cb].T + norm_q[ca][:, None] * rb + norm_p[cb][None, :] * ra + ra * rb

    def multiply(rows: np.ndarray, columns: np.ndarray) -> None:
        wide = TILE // min(len(rows), TALL)
        at_q, at_p = np.full(len(queries), -1), np.full(len(points), -1)
        for left in range(0, len(columns), wide):
            c = columns[left : left + wide]
            turned = p_rows[c].T
            at_p[:], at_p[c] = -1, np.arange(len(c))
            for top in range(0, len(rows), TALL):
                r = rows[top : top + TALL]
                score = q_rows[r] @ turned
                at_q[:], at_q[r] = -1, np.arange(len(r))
                i, j = at_q[own_q], at_p[own_p]
                here = (i >= 0) & (j >= 0)
                score[i[here], j[here]] = lowest
                hit = score >= np.maximum(best.worst[r], NONE + 1).astype(kind)[:, None]
                if np.count_nonzero(hit) > 4 * k * len(r):
                    many = np.flatnonzero(hit.sum(1) > 4 * k)
                    kth = np.partition(score[many], -k, axis=1)[:, -k]
                    hit[many] = score[many] >= kth[:, None]
                    best.worst[r[many]] = kth.astype(np.int64)
                i, j = np.divmod(np.flatnonzero(hit), len(c))
                best.add(r[i], score[i, j].astype(np.int64), ids[c[j]])

    todo = [(float(bounds([0], [0])[0, 0]), 0, 0)]
    while todo:
        most, a, b = todo.pop()
        lo, hi = q.nodes[a][:2]
        rows, columns = q.order[lo:hi], p.order[slice(*p.nodes[b][:2])]
        worst = best.worst[rows].min()
        if most + slack < float(worst):
            continue
        if len(rows) * len(columns) > TILE:
            ka, kb = q.children(a) or [a], p.children(b) or [b]
            if (ka, kb) != ([a], [b]):
                most = bounds(ka, kb)
                goes = most + slack >= np.array([float(best.worst[q.order[slice(*q.nodes[x][:2])]].min()) for x in ka])[:, None]
                pairs = np.outer([q.nodes[x][1] - q.nodes[x][0] for x in ka], [p.nodes[x][1] - p.nodes[x][0] for x in kb])
                if worst == NONE or 2 * pairs[goes].sum() <= pairs.sum():
                    todo += sorted((float(most[i, j]), ka[i], kb[j]) for i, j in zip(*np.nonzero(goes), strict=True))
                    continue
        multiply(rows, columns)
    rows, place, scores, found = best.sort()
    top, other = np.full((len(queries), k), NONE, np.int64), np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
    top[rows, place], other[rows, place] = scores, found
    return top, other


@dataclass
class Cells:
    """Centers (one matrix for each vector length) and, once measured, each cell's blocks, its first block's number and its covering radius.

    A cell's number is its center's row; a length without centers has one cell,
    of unbounded radius.
    """

    centers: dict[int, np.ndarray]
    blocks: dict[tuple[int, int], int]
    first: dict[tuple[int, int], int]
    radius: dict[tuple[int, int], float]

    def far(self, v: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the centers of their length."""
        c = self.centers[v.shape[1]]
        return (v**2).sum(1)[:, None] - 2 * (v @ c.T) + (c**2).sum(1)[None, :]

    def bounds(self, v: np.ndarray, numbers: list[int]) -> np.ndarray:
        """The best score each cell's radius allows each query, rounding allowed for."""
        size = v.shape[1]
        if size not in self.centers:
            return np.full((len(v), len(numbers)), np.inf)
        c = self.centers[size][numbers]
        norm, r = np.sqrt((v**2).sum(1))[:, None], np.array([self.radius[size, x] for x in numbers])[None, :]
        reach = np.sqrt((c**2).sum(1))[None, :] + r
        return v @ c.T + norm * r + norm * reach * 1e-9 + 1.0


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length in a list column."""
    v = batch.column(column)
    sizes = np.diff(np.asarray(v.offsets))
    for size in np.unique(sizes).tolist():
        on = np.flatnonzero(sizes == size)
        yield on, np.asarray(v.take(pa.array(on)).flatten()).reshape(len(on), size)


def dealt(vectors: DataFrame, count: int, size: int) -> tuple[DataFrame, Cells]:
    """(vec_id, v, length, cell, block) and the cells of ``vectors``; about ``count`` centers, blocks of about ``size`` rows.

    Centers are distinct vectors of a sample by hash of the id.  What reaches
    the driver has one row for each center or cell.
    """
    spark = vectors.sparkSession
    centers: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64(F.lit(3), "vec_id")).limit(count).collect():
        centers.setdefault(len(r.v), []).append(r.v)
    cells = Cells({n: np.unique(np.array(x, np.float64).reshape(len(x), n), axis=0) for n, x in centers.items()}, {}, {}, {})
    shared = spark.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.inf)
            for on, v in _rows(batch, 1):
                if v.shape[1] in shared.value.centers:
                    v = v.astype(np.float64)
                    cell[on] = shared.value.far(v).argmin(1)
                    away[on] = np.sqrt(((v - shared.value.centers[v.shape[1]][cell[on]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=["vec_id", "v", "cell", "away"])

    placed = written(vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, cell int, away double"), "cells").withColumn("length", F.size("v"))
    for r in placed.groupBy("length", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
        cells.first[r.length, r.cell] = sum(cells.blocks.values())
        cells.blocks[r.length, r.cell] = -(-r.n // size)
        cells.radius[r.length, r.cell] = r.radius
    parts = spark.createDataFrame([(*at, cells.first[at], n) for at, n in cells.blocks.items()] or [(0, 0, 0, 1)], "length int, cell int, first int, parts int")
    out = placed.join(F.broadcast(parts), ["length", "cell"])  # one row for each cell
    return out.select("vec_id", "v", "length", "cell", (F.col("first") + F.pmod(F.xxhash64(F.lit(1), "vec_id"), "parts")).cast("int").alias("block")), cells


def reached(queries: DataFrame, cells: Cells, first: bool) -> DataFrame:
    """(vec_id, v, floor, block): the blocks each query (vec_id, v, floor, seen) goes to.

    The first time that is one block, of the cell whose center scores best.
    Later it is every other block of the cells whose bound is not below the
    query's floor.
    """
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    schema = "vec_id long, v array<long>, floor long, cell int, block int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        numbers: dict[int, list[int]] = {}
        for size, number in sorted(cells.blocks):
            numbers.setdefault(size, []).append(number)
        for batch in batches:
            for on, v in _rows(batch, 1):
                size = v.shape[1]
                own = numbers.get(size, [])
                if not own:
                    continue
                bound = cells.bounds(v.astype(np.float64), own)
                if first:
                    best = (v.astype(np.float64) @ cells.centers[size][own].T).argmax(1) if size in cells.centers else np.zeros(len(on), np.int64)
                    i, j, part = np.arange(len(on)), best, np.zeros(len(on), np.int64)
                else:
                    floor = np.asarray(batch.column(2))[on]
                    i, j = np.nonzero(bound >= np.where(floor == NONE, -np.inf, floor.astype(np.float64))[:, None])
                    parts = np.array([cells.blocks[size, x] for x in own])[j]
                    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    i, j = np.repeat(i, parts), np.repeat(j, parts)
                    done = (np.array(own)[j] == np.asarray(batch.column(3))[on][i]) & (part == 0)
                    i, j, part = i[~done], j[~done], part[~done]
                block = np.array([cells.first[size, x] for x in own])[j] + part
                for lo in range(0, len(i), 8192):
                    rows = pa.array(on[i[lo : lo + 8192]])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(np.array(own, np.int32)[j[lo : lo + 8192]]), pa.array(block[lo : lo + 8192].astype(np.int32))],
                        names=["vec_id", "v", "floor", "cell", "block"],
                    )

    return queries.select("vec_id", "v", "floor", "seen").mapInArrow(run, schema)


def searched(data: DataFrame, asks: DataFrame, k: int, blocks: int, query_parts: int) -> DataFrame:
    """(query_id, vec_id, score): each block's best for each query that reached it, scores below its floor left out.

    A block and a part of its queries meet in a task of their own, since work is
    rows times queries: tasks merged by their bytes would be few and long.  The
    block's rows come first and make its tree; the queries stream by.
    """
    part = F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(query_parts)).cast("int")
    left = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))) if query_parts > 1 else data.withColumn("part", F.lit(0))
    left = left.select("block", "part", F.lit(0).alias("asks"), "vec_id", "v", F.lit(NONE).alias("floor"))
    every = left.unionByName(asks.select("block", part.alias("part"), F.lit(1).alias("asks"), "vec_id", "v", "floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, made = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)] if len(key) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if group != tuple(key[lo, :2]):
                    group, held, made = tuple(key[lo, :2]), [], None
                part = batch.slice(lo, hi - lo)
                v = np.asarray(part.column(4).flatten()).reshape(hi - lo, -1)
                ids = np.asarray(part.column(3))
                if not key[lo, 2]:
                    held.append((ids, v))
                    continue
                if not held:
                    continue
                if made is None:
                    own, points = (np.concatenate(x) for x in zip(*held, strict=True))
                    if len(np.unique(own)) < len(own):
                        _, once = np.unique(np.concatenate([own[:, None], points], 1), axis=0, return_index=True)
                        own, points = own[once], points[once]
                    made = own, points, CoverTree(points.astype(np.float64), whole=False)
                own, points, tree = made
                top, best = dual_search(ids, v, own, points, np.asarray(part.column(5)), k, tree)
                i, j = np.nonzero(top != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(best[i, j]), pa.array(top[i, j])], names=["query_id", "vec_id", "score"])

    order = ["block", "part", "asks"]
    own = (F.col("block") * query_parts + F.col("part")).cast("int")
    return every.repartitionById(max(1, blocks * query_parts), own).sortWithinPartitions(*order).mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 65536, cells: int = 64, least_block: int = 512, most_block: int = 16384, most_cells: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest integer inner product for each query.

    ``vectors`` and ``queries`` have (vec_id long, v array<long>).  Vectors are
    dealt to about ``cells`` cells, or more (up to ``most_cells``) to keep them
    below ``most_block`` rows; a larger cell is several blocks.  Rows of a
    query's own id are left out; ties go to the smaller id; a query with fewer
    candidates gets all.  A row listed twice, id and vector alike, is one row;
    of different vectors under one id the query is the smallest, and each is a
    candidate.  Rows with a null id or null v take no part, vectors of another
    length than the query's are no candidates.  An empty side gives no rows.
    Scores must fit 64 bits.
    """
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    queries = queries.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    n = vectors.count()
    size = min(max(n // cells, least_block), most_block)
    data, found_cells = dealt(vectors, min(max(1, -(-n // size)), most_cells), size)
    asks = written(queries.select("vec_id", "v", F.lit(NONE).alias("floor"), F.lit(-1).alias("seen")), "queries")
    parts = max(1, -(-asks.count() // query_block))
    blocks = sum(found_cells.blocks.values())
    start = reached(asks, found_cells, True)
    seed = written(searched(data, start, k, blocks, parts), "seeds")
    kth = seed.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    later = start.select("vec_id", "v", F.col("cell").alias("seen")).join(kth, "vec_id", "left").withColumn("floor", F.coalesce("kth", F.lit(NONE)))
    found = seed.unionByName(searched(data, reached(later, found_cells, False), k, blocks, parts))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(1024 x) of each component; vectors null or with null or non-finite components are left out."""
    x = F.transform(column, lambda x: x.cast("double"))
    finite = F.forall(x, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vectors.where(F.col(column).isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda x: F.floor(x * 1024)).alias("v"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the ten best rows for each row whose id is divisible by 100."""
    v = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where("vec_id % 100 = 0"))


SQL = """
with x as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings where vec_id is not null and embedding is not null),
v as (select distinct vec_id, list_transform(e, lambda x: cast(floor(1024 * x) as bigint)) e from x
  where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
q as (select vec_id, min(e) e from v where vec_id % 100 = 0 group by vec_id),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) score
  from q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
