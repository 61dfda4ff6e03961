"""Exact top-k by inner product with a paged M-tree and best-first search.

Components are taken as floor(1024 * x). Inner products become distances by one more coordinate, sqrt(M - |x|^2) with M the
greatest squared length: the squared distance to a query is |q|^2 + M - 2 q.x, so nearest is highest. Vectors go to the
nearest of a bounded number of routing objects; those of one routing object fill pages of bounded size, dealt by hash, so
a vector that very many rows share only fills more pages. A page is an M-tree of its own: nodes with a routing object, a
covering radius and the distance to the parent's routing object, and leaves of distinct vectors with theirs.

A query first searches one page of its nearest routing object, which bounds the distance of its k-th answer. It then goes to
all pages that the bound doesn't rule out. A page is searched for a block of queries at once: nodes are taken nearest bound
first, queries leave a node that the triangle inequality rules out from stored distances, and those left score a leaf together. Scores are whole numbers throughout; radii have a margin
for rounding. Every row but rows with the query's own vec_id is a candidate, and ties go to the smaller vec_id.

Edge cases: null and empty vectors, those with null or non-finite components, and rows without vec_id take no part; vectors are
compared with those of their own length only; a query id that occurs twice counts once, with its least vector; rows that
repeat are candidates each; a component so large that scores might not fit 64 bits (in 64 components, one over 370,727)
counts as the greatest for which all fit; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import map_rows, stored

SCALE = 1024
PAGE_ROWS, LEAF_ROWS, FANOUT = 4096, 64, 16
#: Routing objects at most, and the bounded sample that they are chosen from.
ROUTERS, SAMPLE = 256, 4096
#: Queries that are searched together.
QUERY_ROWS = 512
NONE = np.iinfo(np.int64).min


def greatest(dim: int) -> int:
    """The greatest size of a component for which the inner product of any two vectors fits 64 bits."""
    return math.isqrt((2**63 - 1) // dim)


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dim, the components as packed 64-bit integers, and the squared length; only rows that take part."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = batch.column(0).to_pylist(), []
        for i, x in zip(ids, batch.column(1).to_pylist()):
            if i is None or not x or None in x:
                continue
            v = np.array(x, np.float64)
            if np.isfinite(v).all():
                v = np.clip(np.floor(SCALE * v), -greatest(len(v)), greatest(len(v))).astype(np.int64)
                out.append((i, len(v), v.tobytes(), int((v * v).sum())))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["vec_id", "dim", "vec", "norm"])

    return map_rows(df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")), run, "vec_id long, dim int, vec binary, norm long", rows=2048)


class Space:
    """Distances of one dimension's vectors, given the greatest squared length."""

    def __init__(self, most: int):
        self.most = most
        self.margin = 1e-6 * (1.0 + np.sqrt(float(most)))

    def extra(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, float(self.most) - norms.astype(np.float64)))

    def dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products of rows of a with b."""
        if self.most < 2**52:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows a to one stored vector b."""
        na, nb = (a.astype(np.float64) ** 2).sum(-1), (b.astype(np.float64) ** 2).sum()
        d = self.extra(na) - self.extra(nb)
        return np.sqrt(np.maximum(0.0, na + nb - 2 * (a.astype(np.float64) @ b.astype(np.float64)) + d * d))

    def to_queries(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Distances to queries of these squared lengths, from the inner products with them."""
        return np.sqrt(np.maximum(0.0, lengths + float(self.most) - 2.0 * scores))

    def to_query(self, scores: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Distances to a query, which lies at nought in the further coordinate, from the inner products."""
        return np.sqrt(np.maximum(0.0, float((query * query).sum()) + float(self.most) - 2.0 * scores))


@dataclass
class Node:
    """Routing object (row of the page's distinct vectors), covering radius, distance to the parent's, and what is below."""

    at: int
    radius: float
    up: float
    children: list | None
    rows: np.ndarray | None
    to_centre: np.ndarray | None


class Page:
    """An M-tree over the distinct vectors of a page; each vector has its ids in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: Space):
        self.space = space
        self.vectors, place = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, place.ravel()))
        self.ids = np.split(ids[order], np.cumsum(np.bincount(place.ravel()))[:-1])
        self.root = self._build(np.arange(len(self.vectors)), 0, 0.0)

    def _build(self, rows: np.ndarray, centre: int, up: float) -> Node:
        distance = self.space.between(self.vectors[rows], self.vectors[centre])
        radius = float(distance.max()) + self.space.margin
        if len(rows) <= LEAF_ROWS:
            return Node(centre, radius, up, None, rows, distance)
        chosen = [int(np.argmax(distance))]
        near = np.full(len(rows), np.inf)
        owner = np.zeros(len(rows), np.int64)
        while len(chosen) <= FANOUT:  # farthest first
            d = self.space.between(self.vectors[rows], self.vectors[rows[chosen[-1]]])
            closer = d < near
            owner[closer], near[closer] = len(chosen) - 1, d[closer]
            following = int(np.argmax(near))
            if near[following] <= 0:
                break
            chosen.append(following)
        children = []
        for i, pick in enumerate(chosen):
            part = rows[owner == i]
            if len(part) == len(rows):  # all at one place but for rounding
                return Node(centre, radius, up, None, rows, distance)
            if len(part):
                children.append(self._build(part, int(rows[pick]), float(distance[pick])))
        return Node(centre, radius, up, children, None, None)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and vec_ids (rows of k, by rank; NONE where there are fewer) of the best within each query's bound.

        Nodes are taken nearest bound first; each is left by the queries whose bound rules it out, and a leaf is scored at
        once for those that are left."""
        space, margin = self.space, self.space.margin
        bounds = bounds.astype(np.float64).copy()
        scores, ids = np.full((len(queries), k), NONE), np.full((len(queries), k), NONE)
        lengths = (queries.astype(np.float64) ** 2).sum(axis=1)
        away = space.to_queries(space.dots(queries, self.vectors[self.root.at]), lengths)
        queue, n = [(0.0, 0, self.root, np.arange(len(queries)), away)], 1
        while queue:
            _, _, node, who, away = heapq.heappop(queue)
            stay = away - node.radius <= bounds[who] + margin
            who, away = who[stay], away[stay]
            if not len(who):
                continue
            if node.children is not None:
                for child in node.children:
                    near = np.abs(away - child.up) - child.radius <= bounds[who] + margin
                    if not near.any():
                        continue
                    some = who[near]
                    to = space.to_queries(space.dots(queries[some], self.vectors[child.at]), lengths[some])
                    least = np.maximum(0.0, to - child.radius)
                    if (least <= bounds[some] + margin).any():
                        heapq.heappush(queue, (float(least.min()), n, child, some, to))
                        n += 1
                continue
            close = np.abs(away[:, None] - node.to_centre[None]) <= bounds[who][:, None] + 2 * margin
            used = close.any(axis=0)
            if not used.any():
                continue
            rows = node.rows[used]
            # Of the ids of a vector only the least can be wanted, and one more as a query's own counts for nothing.
            held = [self.ids[row][: k + 1] for row in rows]
            spread = np.repeat(np.arange(len(rows)), [len(x) for x in held])
            names = np.concatenate(held)
            found = space.dots(queries[who], self.vectors[rows].T)[:, spread]
            named = np.broadcast_to(names, found.shape)
            found = np.where(named == own[who][:, None], NONE, found)
            every, of = np.concatenate([scores[who], found], axis=1), np.concatenate([ids[who], named], axis=1)
            # Highest scores first, then the least id; ~ turns the order round without overflow.
            best = np.lexsort((of, ~every), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(every, best, axis=1), np.take_along_axis(of, best, axis=1)
            full = who[scores[who, k - 1] != NONE]
            bounds[full] = np.minimum(bounds[full], space.to_queries(scores[full, k - 1], lengths[full]))
        return scores, ids


def _routers(vecs: DataFrame) -> dict[int, tuple[Space, np.ndarray]]:
    """For each dimension its space and routing objects, chosen farthest first from a bounded sample."""
    sizes = {r.dim: (r.n, r.most) for r in vecs.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).collect()}
    out = {}
    for dim, (n, most) in sizes.items():
        space = Space(most)
        sample = vecs.where(F.col("dim") == dim).orderBy(F.xxhash64("vec"), "vec_id").limit(SAMPLE).select("vec").collect()
        rows = np.unique(np.stack([np.frombuffer(r.vec, np.int64) for r in sample]), axis=0)
        want = min(ROUTERS, max(1, -(-n // PAGE_ROWS)), len(rows))
        chosen, near = [0], np.full(len(rows), np.inf)
        while len(chosen) < want:
            near = np.minimum(near, space.between(rows, rows[chosen[-1]]))
            chosen.append(int(np.argmax(near)))
        out[dim] = (space, rows[chosen])
    return out


def build_index(vecs: DataFrame, routers: dict[int, tuple[Space, np.ndarray]]) -> DataFrame:
    """The pages: dim, router, part, radius about the routing object, and the tree."""

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, dims = (batch.column(i).to_numpy() for i in (0, 1))
        vec = batch.column(2).to_pylist()
        router, away = np.zeros(len(ids), np.int32), np.zeros(len(ids))
        for dim in np.unique(dims).tolist():
            space, pivots = routers[dim]
            at = np.flatnonzero(dims == dim)
            rows = np.frombuffer(b"".join(vec[i] for i in at), np.int64).reshape(-1, dim)
            all_d = np.stack([space.between(rows, p) for p in pivots])
            router[at], away[at] = all_d.argmin(0), all_d.min(0)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(router), pa.array(away)], names=["vec_id", "dim", "vec", "router", "away"])

    placed = stored(map_rows(vecs.select("vec_id", "dim", "vec"), assign, "vec_id long, dim int, vec binary, router int, away double", rows=2048))
    counts = placed.groupBy("dim", "router").agg(F.ceil(F.count(F.lit(1)) / PAGE_ROWS).alias("parts"))
    dealt = placed.join(F.broadcast(counts), ["dim", "router"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), F.col("parts")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        dim, router, part = (group.column(c)[0].as_py() for c in ("dim", "router", "part"))
        space, _ = routers[dim]
        rows = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.int64).reshape(-1, dim)
        page = Page(group.column("vec_id").to_numpy(), rows, space)
        radius = float(group.column("away").to_numpy().max()) + space.margin
        return pa.table({"dim": pa.array([dim], pa.int32()), "router": pa.array([router], pa.int32()), "part": pa.array([part], pa.int32()), "radius": [radius], "tree": pa.array([pickle.dumps(page)], pa.binary())})

    # vec_id alone would leave rows that repeat in one page; a page of these holds one distinct vector.
    return stored(dealt.groupBy("dim", "router", "part").applyInArrow(build, "dim int, router int, part int, radius double, tree binary"))


def _visit(pages: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """Search each page for the queries sent to it: query_id, vec_id and score."""

    def search(page: pa.Table, sent: pa.Table) -> pa.Table:
        out = []
        if page.num_rows and sent.num_rows:
            tree = pickle.loads(page.column("tree")[0].as_py())
            for start in range(0, sent.num_rows, QUERY_ROWS):
                part = sent.slice(start, QUERY_ROWS)
                own, bounds = (part.column(c).to_numpy() for c in ("query_id", "bound"))
                scores, ids = tree.search(own, np.stack([np.frombuffer(v, np.int64) for v in part.column("vec").to_pylist()]), k, bounds)
                real = scores != NONE
                out.append((np.repeat(own, real.sum(axis=1)), ids[real], scores[real]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), columns)})

    keys = ("dim", "router", "part")
    return pages.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query row its k best rows of df: query_id, rank, vec_id, score."""
    vecs = stored(quantised(df, key, vector))
    routers = _routers(vecs)
    pages = build_index(vecs, routers)
    radii = {(r.dim, r.router): (r.radius, r.parts) for r in pages.groupBy("dim", "router").agg(F.max("radius").alias("radius"), (F.max("part") + 1).alias("parts")).collect()}
    asked = quantised(queries, key, vector).groupBy("vec_id").agg(F.min(F.struct("dim", "vec")).alias("q"))
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), "q.dim", "q.vec"))
    route_fields = "dim int, router int, part int, query_id long, vec binary, bound double"

    def route(home: bool):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for query, dim, vec, *score in zip(*columns):
                if dim not in routers:
                    continue
                space, pivots = routers[dim]
                q = np.frombuffer(vec, np.int64)
                away = space.to_query(space.dots(pivots, q), q)
                if home:
                    out.append((dim, int(away.argmin()), 0, query, vec, np.inf))
                    continue
                bound = np.inf if score[0] is None else float(space.to_query(np.array([score[0]]), q)[0])
                for router, d in enumerate(away.tolist()):
                    radius, parts = radii.get((dim, router), (0.0, 0))
                    if d - radius <= bound + space.margin:
                        out += [(dim, router, part, query, vec, bound) for part in range(parts) if part or router != int(away.argmin())]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["dim", "router", "part", "query_id", "vec", "bound"])

        return run

    first = stored(_best(_visit(pages, map_rows(asked, route(True), route_fields), k), k).drop("rank"))
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst"))
    rest = map_rows(asked.join(bounds, "query_id", "left").select("query_id", "dim", "vec", "worst"), route(False), route_fields)
    return _best(first.union(_visit(pages, rest, k)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
