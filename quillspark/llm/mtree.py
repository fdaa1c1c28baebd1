"""Exact top-k search with an M-tree: paged metric nodes, covering radii, parent distances, best-first order.

Every node has a routing vector, a covering radius over all entries below it
and the distance to its parent's routing vector; a leaf page holds at most
PAGE entries, each with its distance to the page's routing vector.

The upper levels are fitted on a documented, bounded sample (SAMPLE vectors,
about CELLS leaves); every vector is dealt to the nearest of these leaves,
its cell, and the radii of the upper nodes are those of all vectors dealt below them.  A cell is split
by a hash of the id into parts of about PART entries, so that no task holds
more, however many vectors are alike.  Each part is built once into an M-tree
of its own under the cell's leaf and stored as one row.

A query descends the upper levels to its own cell; the distance of its k-th
neighbour there then bounds which other cells can hold a nearer one.  In every
tree a query takes nodes in the order of their lower bounds from a queue and
stops at the first that can't improve its k-th distance.  The stored parent
distances spare computations: |d(query, parent) - d(child, parent)| - radius is
a lower bound that needs no new distance, and likewise for the entries of a
page.  Queries that are at the same node are computed together.

Distances are Euclidean, in double precision, rounded to 9 decimals; bounds
are widened by far more than rounding can err, so the result is exact.

Defined results
    queries: the rows whose vec_id is divisible by ``every``; all rows are searched.
    ties: the smaller vec_id comes first.  A vector is not its own neighbour, an equal vector of another id is one.
    null vectors, empty ones, and vectors with a null or not finite element: neither query nor neighbour.
    vectors of different lengths: compared only with their like; very long ones whole.
    repeated rows (the same vec_id and vector) count once; one vec_id with several vectors keeps the first in order.
    fewer than k others: as many rows as there are.  Extra columns: ignored.  Empty table: no row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import kernel as K

K_NEAREST = 10
EVERY = 50
FAN = 16
PAGE = 128
PART = 8192
SAMPLE = 16384  # vectors that the upper levels are fitted on
CELLS = 1024  # leaves of the upper levels, were all pages full (a page is a quarter full at least)
BLOCK = 4096  # queries that visit a part together
SLACK = 1e-6  # of the largest norm, 1 at least: far more than the fast distances err
TREE = "part long, tree binary"
FOUND = "vec_id long, neighbour long, distance double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Approximate distances of all rows of a to all of b."""
    s = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(s, 0))


def measured(v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Distance of each row to one vector, by differences: what nodes store is nearer the truth than distances()."""
    return np.sqrt(((v - r) ** 2).sum(1))


def slack(*blocks: np.ndarray) -> float:
    return SLACK * (1 + max((float((b * b).sum(1).max()) for b in blocks if len(b)), default=0.0) ** 0.5)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of a to the same row of b, summed dimension by dimension."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        s += d * d
    return np.round(np.sqrt(s), 9)


@dataclass
class Tree:
    """Nodes in the order of their making, node 0 the root; a node's children are nodes first:last, a leaf's entries are rows first:last of ids, vectors, parent."""

    routing: np.ndarray
    radius: np.ndarray
    above: np.ndarray  # parent node, -1 of the root
    to_parent: np.ndarray  # distance to the parent's routing vector
    leaf: np.ndarray
    first: np.ndarray
    last: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray  # distance of each entry to its page's routing vector

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.leaf)


def promote(v: np.ndarray, fan: int) -> np.ndarray:
    """Indices of up to fan rows, each as far as can be from those before it."""
    got = [int(np.argmax(distances(v, v[:1])[:, 0]))]
    d = distances(v, v[got])[:, 0]
    while len(got) < fan and d.max() > 0:
        got.append(int(np.argmax(d)))
        d = np.minimum(d, distances(v, v[got[-1:]])[:, 0])
    return np.array(got)


def split(v: np.ndarray, fan: int, least: int) -> list[np.ndarray]:
    """Rows by the nearest of the promoted ones; children with fewer than `least` rows join others, equal vectors are cut evenly."""
    p = promote(v, fan)
    home = distances(v, v[p]).argmin(1)
    big = np.flatnonzero(np.bincount(home, minlength=len(p)) >= least)
    if len(big) < 2:  # hardly anything tells the rows apart: along the distance to one of them
        order = np.argsort(distances(v, v[p[:1]])[:, 0], kind="stable")
        return np.array_split(order, min(fan, -(-len(v) // least)))
    home = distances(v, v[p[big]]).argmin(1)
    return [np.flatnonzero(home == c) for c in range(len(big))]


def centre(v: np.ndarray) -> np.ndarray:
    return v[int(np.argmin(distances(v, v.mean(0, keepdims=True))[:, 0]))]


def build(ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fan: int = FAN) -> Tree:
    """Nodes over a page are split into up to fan children, level by level."""
    dim = vectors.shape[1] if vectors.ndim == 2 else 0
    rows = [np.argsort(ids, kind="stable")] if len(ids) else []
    routing, radius, above, to_parent, leaf, first, last = ([] for _ in range(7))
    order: list[np.ndarray] = []
    used = 0
    if rows:
        above.append(-1)
    k = 0
    while k < len(rows):
        mine = rows[k]
        v = vectors[mine]
        r = centre(v)
        routing.append(r)
        radius.append(float(measured(v, r).max()))
        to_parent.append(float(measured(r[None], routing[above[k]])[0]) if above[k] >= 0 else 0.0)
        if len(mine) <= page:
            leaf.append(True)
            first.append(used)
            used += len(mine)
            last.append(used)
            order.append(mine)
        else:
            leaf.append(False)
            first.append(len(rows))
            for part in split(v, fan, max(1, page // 4, len(mine) // (2 * fan))):
                rows.append(mine[part])
                above.append(k)
            last.append(len(rows))
        k += 1
    at = np.concatenate(order) if order else np.zeros(0, np.int64)
    v = vectors[at]
    parent = np.zeros(len(at))
    for k in np.flatnonzero(leaf):
        parent[first[k] : last[k]] = measured(v[first[k] : last[k]], routing[k])
    whole = lambda x: np.array(x, np.int64)
    return Tree(np.array(routing).reshape(len(rows), dim), np.array(radius), whole(above), np.array(to_parent), np.array(leaf, bool), whole(first), whole(last), ids[at], v, parent)


def children(tree: Tree, node: int, q: np.ndarray, d: np.ndarray, kth: np.ndarray, wide: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries, children) distances and lower bounds, inf for what the parent distances rule out without computing a distance."""
    lo, hi = tree.first[node], tree.last[node]
    far = np.abs(d[:, None] - tree.to_parent[None, lo:hi]) - tree.radius[None, lo:hi]
    may = far <= kth[:, None] + wide
    dist, low = np.full(may.shape, np.inf), np.full(may.shape, np.inf)
    some = np.flatnonzero(may.any(0))
    if len(some):
        got = distances(q, tree.routing[lo:hi][some])
        dist[:, some] = got
        low[:, some] = np.where(may[:, some], np.maximum(got - tree.radius[lo:hi][some], 0), np.inf)
    return dist, low


def search(tree: Tree, qid: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), each (queries, k), of the k nearest entries within each query's bound; distance inf fills up."""
    n = len(q)
    best_d, best_i = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    kth = np.full(n, np.inf) if bound is None else bound.astype(float).copy()
    if not len(tree.ids) or not n:
        return best_i, best_d
    wide = slack(q, tree.vectors)
    nodes = len(tree.leaf)
    dist, queue = np.full((n, nodes), np.inf), np.full((n, nodes), np.inf)
    dist[:, 0] = distances(q, tree.routing[:1])[:, 0]
    queue[:, 0] = np.maximum(dist[:, 0] - tree.radius[0], 0)
    live = np.arange(n)
    while len(live):
        node = queue[live].argmin(1)
        go = queue[live, node] <= kth[live] + wide
        go &= np.isfinite(queue[live, node])
        live, node = live[go], node[go]
        if not len(live):
            break
        queue[live, node] = np.inf
        by = np.argsort(node, kind="stable")
        edge = np.flatnonzero(np.diff(node[by], prepend=-1))
        for a, b in zip(edge, np.append(edge[1:], len(by))):
            who, p = live[by[a:b]], int(node[by[a]])
            lo, hi = tree.first[p], tree.last[p]
            if not tree.leaf[p]:
                dist[who, lo:hi], queue[who, lo:hi] = children(tree, p, q[who], dist[who, p], kth[who], wide)
                continue
            gap = np.abs(dist[who, p][:, None] - tree.parent[None, lo:hi])
            may = (gap <= kth[who][:, None] + wide) & (tree.ids[None, lo:hi] != qid[who][:, None])
            some = np.flatnonzero(may.any(0))
            if not len(some):
                continue
            d = np.where(may[:, some], distances(q[who], tree.vectors[lo:hi][some]), np.inf)
            near = kth[who]
            if len(some) > k:  # the page's own k-th nearest bounds it too
                near = np.minimum(near, np.partition(d, k - 1, 1)[:, k - 1])
            r, c = np.nonzero((d <= near[:, None] + wide) & np.isfinite(d))
            if not len(r):
                continue
            true = exact(q[who[r]], tree.vectors[lo + some[c]])
            width = np.bincount(r, minlength=len(who)).max()
            cd, ci = np.full((len(who), k + width), np.inf), np.full((len(who), k + width), np.iinfo(np.int64).max)
            cd[:, :k], ci[:, :k] = best_d[who], np.where(np.isinf(best_d[who]), np.iinfo(np.int64).max, best_i[who])
            col = k + np.arange(len(r)) - np.searchsorted(r, r)
            cd[r, col], ci[r, col] = true, tree.ids[lo + some[c]]
            o = np.lexsort((ci, cd), axis=1)[:, :k]
            nd, ni = np.take_along_axis(cd, o, 1), np.take_along_axis(ci, o, 1)
            best_d[who], best_i[who] = nd, np.where(np.isinf(nd), -1, ni)
            kth[who] = np.minimum(kth[who], nd[:, -1])
    return best_i, best_d


def nearest_leaf(top: Tree, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node of the nearest leaf's routing vector, distances to it and its ancestors up to the root, by depth) of each row."""
    leaves, depth = top.leaves, depths(top)
    node = np.concatenate([leaves[distances(v[a : a + 1024], top.routing[leaves]).argmin(1)] for a in range(0, len(v), 1024)])
    out = np.full((len(v), int(depth.max()) + 1), -1.0)
    at, live = node.copy(), np.arange(len(v))
    while len(live):
        for p in np.unique(at[live]):
            rows = live[at[live] == p]
            out[rows, depth[p]] = measured(v[rows], top.routing[p])
        at[live] = top.above[at[live]]
        live = live[at[live] >= 0]
    return node, out


def depths(top: Tree) -> np.ndarray:
    depth = np.zeros(len(top.leaf), np.int64)
    for k in range(1, len(depth)):  # parents come before their children
        depth[k] = depth[top.above[k]] + 1
    return depth


def reached(top: Tree, q: np.ndarray, kth: np.ndarray, wide: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) pairs that may hold an entry within the query's bound, level by level with the parent distances."""
    out = []
    level = [(0, np.arange(len(q)), distances(q, top.routing[:1])[:, 0])]
    while level:
        below = []
        for node, who, d in level:
            if top.leaf[node]:
                out.append((who, np.full(len(who), node)))
                continue
            dist, low = children(top, node, q[who], d, kth[who], wide)
            for c in range(dist.shape[1]):
                go = np.flatnonzero(low[:, c] <= kth[who] + wide)
                go = go[np.isfinite(low[go, c])]
                if len(go):
                    below.append((int(top.first[node]) + c, who[go], dist[go, c]))
        level = below
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(np.ascontiguousarray(v).ravel()))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    length = np.diff(batch.column("v").offsets.to_numpy())
    for m in np.unique(length).tolist():
        yield m, batch if (length == m).all() else batch.filter(pa.array(length == m))


def fitted(vectors: DataFrame, n: int) -> dict[int, Tree]:
    """The upper levels for each length of vector, on a sample of about SAMPLE vectors by a hash of the id, and one of each length at least."""
    order, need = F.xxhash64("vec_id"), 2.0 * min(n, SAMPLE) / max(n, 1)
    near = vectors if need >= 1 else vectors.filter(F.pmod(order, F.lit(1 << 30)) < int(need * (1 << 30)))
    drawn = [r[0] for r in near.select("v", order.alias("o")).orderBy("o").limit(SAMPLE).collect()]
    drawn += [r[0] for r in vectors.groupBy(F.size("v")).agg(F.min_by("v", "vec_id").alias("v")).select("v").collect()]  # a row for each length
    out = {}
    for m in sorted({len(v) for v in drawn}):
        x = np.unique(np.array([v for v in drawn if len(v) == m], float), axis=0)
        leaves = min(CELLS, max(1, n // PART))
        out[m] = build(np.arange(len(x)), x, max(1, -(-len(x) // leaves)))
    return out


def top_k(table: DataFrame, k: int = K_NEAREST, every: int = EVERY) -> DataFrame:
    """vec_id, rank (from 1), neighbour, distance for each query among the rows of table (vec_id, embedding)."""
    spark = table.sparkSession
    sc = spark.sparkContext
    raw = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    good = raw.filter("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    vectors = K.saved(good.groupBy("vec_id").agg(F.min("v").alias("v")))
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour long, distance double")
    tops = fitted(vectors, n)
    base = dict(zip(tops, np.cumsum([0, *[len(t.leaf) for t in tops.values()]]).tolist()))
    shared = sc.broadcast((tops, base))  # at most SAMPLE vectors

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, at = shared.value
        for batch in batches:
            for m, part in _by_length(batch):
                v = _matrix(part.column("v"), m)
                node, far = nearest_leaf(trees[m], v)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(node + at[m]), _lists(far)], ["vec_id", "v", "cell", "far"])

    dealt = K.saved(vectors.mapInArrow(deal, "vec_id long, v array<double>, cell long, far array<double>"))
    deep = max(int(depths(t).max()) + 1 for t in tops.values())
    # a row for each cell, of which there are at most CELLS for a length
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *[F.max(F.get("far", F.lit(i))).alias(f"f{i}") for i in range(deep)]).collect()
    parts = {r["cell"]: max(1, -(-r["n"] // PART)) for r in sizes}
    for m, t in tops.items():
        depth = depths(t)
        t.radius = np.full(len(t.leaf), -np.inf)
        for r in sizes:
            node = r["cell"] - base[m]
            if 0 <= node < len(t.leaf):
                while node >= 0:
                    t.radius[node] = max(t.radius[node], r[f"f{depth[node]}"])
                    node = t.above[node]
    covered = sc.broadcast((tops, base, parts))

    dealt = dealt.join(F.broadcast(spark.createDataFrame(list(parts.items()), "cell long, parts long")), "cell")
    part_of = (F.col("cell") * (1 << 24) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("part")

    def plant(mine: pa.Table) -> pa.Table:
        v = mine.column("v").combine_chunks()
        ids = mine.column("vec_id").to_numpy()
        tree = build(ids, _matrix(v, len(v[0])))
        return pa.table([mine.column("part").slice(0, 1), pa.array([pickle.dumps(tree, 5)], pa.binary())], ["part", "tree"])

    trees = K.saved(dealt.select("vec_id", "v", part_of).groupBy("part").applyInArrow(plant, TREE))

    def run(visits: DataFrame) -> DataFrame:
        """Visits (part, vec_id, v, kth) searched: units of a part and at most about BLOCK of its queries, so that a part that all queries visit is many tasks."""
        each = visits.groupBy("part").count().select("part", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        numbered = visits.join(each, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        asked = numbered.groupBy("part", "block").agg(F.collect_list(F.struct("vec_id", "v", "kth")).alias("q"))
        units = trees.join(each, "part").select("part", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(asked, ["part", "block"])

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    tree = pickle.loads(batch.column("tree")[i].as_py())
                    q = batch.column("q")[i].values
                    ids, v, kth = q.field("vec_id").to_numpy(), _matrix(q.field("v"), tree.routing.shape[1]), q.field("kth").to_numpy()
                    near, d = search(tree, ids, v, k, kth)
                    r, c = np.nonzero(np.isfinite(d))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(near[r, c]), pa.array(d[r, c])], ["vec_id", "neighbour", "distance"])

        return units.select("tree", "q").mapInArrow(visit, FOUND)

    queries = dealt.filter(F.col("vec_id") % every == 0)
    all_parts = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.col("cell") * (1 << 24) + p)).alias("part")
    first = K.saved(run(queries.select(all_parts, "vec_id", "v", F.lit(float("inf")).alias("kth"))))
    w = Window.partitionBy("vec_id").orderBy("distance", "neighbour")
    first = K.saved(first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
    bounds = first.filter(F.col("rank") == k).select("vec_id", F.col("distance").alias("kth"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_, at, many_ = covered.value
        for batch in batches:
            for m, rows in _by_length(batch):
                top, v = trees_[m], _matrix(rows.column("v"), m)
                kth = rows.column("kth").to_numpy(zero_copy_only=False)
                who, node = reached(top, v, kth, slack(v, top.vectors))
                cell = node + at[m]
                ok = cell != rows.column("cell").to_numpy()[who]
                who, cell = who[ok], cell[ok]
                count = np.array([many_.get(c, 0) for c in cell.tolist()], np.int64)
                who, cell, nth = np.repeat(who, count), np.repeat(cell, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays([pa.array(cell * (1 << 24) + nth), rows.column("vec_id").take(pa.array(who)), rows.column("v").take(pa.array(who)), pa.array(kth[who])], ["part", "vec_id", "v", "kth"])

    routed = queries.join(bounds, "vec_id", "left").select("vec_id", "v", "cell", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
    second = run(K.saved(routed.mapInArrow(route, "part long, vec_id long, v array<double>, kth double")))
    every_found = first.drop("rank").unionByName(second)
    return every_found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour", "distance")


def sql(k: int = K_NEAREST, every: int = EVERY) -> str:
    """The search as DuckDB SQL over embeddings, every query compared with every row."""
    return f"""
with v as (select vec_id, min(embedding::double[]) as v from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by vec_id),
d as (select a.vec_id, b.vec_id as neighbour, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) as distance
  from v a join v b on a.vec_id % {every} = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
r as (select *, row_number() over (partition by vec_id order by distance, neighbour)::int as rank from d)
select vec_id, rank, neighbour, distance from r where rank <= {k}"""
