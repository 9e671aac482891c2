"""Exact top-k search by inner product with two cover trees.

Queries and data are dealt into blocks of bounded size, and each block of
queries meets each block of data in a task. Both have a cover tree: a node has
a row as its centre and a level l; its descendants lie within 2^l of the
centre, and the centres of its children, the node's own among them, lie more
than half of that apart. The two trees go down together. The product of no
query below one node with any vector below the other exceeds a bound that the
two centres and radii give; if that is under the worst k-th score that the
queries of the group have so far, the pair of nodes is dropped, whole. Where
two leaves meet, each query has its own bound. What is left is multiplied out
in whole numbers.

Each pair of blocks gives its own best k a query, so only those meet for the
final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TOP = 10
QUERY_EVERY = 100
SCALE = 1024
#: Queries in a block and rows in a data block, about.
QUERY_BLOCK, DATA_BLOCK = 8_192, 8_192
#: Rows of one cover tree at most: where all rows lie apart from each other, building takes the square of it.
TREE_ROWS = 2_048
LEAF = 24
#: Rows multiplied between two looks at the worst score.
AT_ONCE = 256
#: Products of values under this stay whole in floating point.
_EXACT = 1 << 53


@dataclass
class Node:
    """``rows`` are the indices of all descendants; a node without children is a leaf.

    ``level`` bounds the distance of descendants by ``2**level``; ``radius`` is
    the greatest that occurs. ``below`` has the children's centres, radii and norms.
    """

    at: int
    level: float
    radius: float
    norm: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)
    below: tuple[np.ndarray, ...] = ()
    worst: float = -np.inf


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node | None:
    """A cover tree over the rows of ``points``.

    The children of a node of level l are a greedy net of level l - 1: the
    node's centre, then whatever row lies farthest from all centres, until none
    lies beyond 2^(l-1). Each row goes to its nearest centre. Levels at which a
    node would have itself as its only child are passed over; copies of one
    point make a single leaf.
    """
    if not len(points):
        return None
    squares = (points**2).sum(1)
    norms = np.sqrt(squares)

    def away(own: np.ndarray, rows: np.ndarray, centre: int) -> np.ndarray:
        out = np.maximum(squares[rows] - 2 * (own @ points[centre]) + squares[centre], 0)
        small = np.flatnonzero(out < 1e-6 * squares[centre])  # differences of large squares: measured directly
        out[small] = ((own[small] - points[centre]) ** 2).sum(1)
        return np.sqrt(out)

    def node(rows: np.ndarray, centre: int, far: np.ndarray) -> tuple[Node, np.ndarray]:
        radius = float(far.max())
        return Node(centre, float(np.ceil(np.log2(radius))) if radius else -np.inf, radius, float(norms[centre]), rows), far

    every = np.arange(len(points))
    root, far = node(every, 0, away(points, every, 0))
    todo = [(root, far)]
    while todo:
        at, near = todo.pop()
        if len(at.rows) <= leaf or at.radius == 0:
            continue
        reach, near, own = 2.0 ** (at.level - 1), near.copy(), points[at.rows]
        centres, owner = [at.at], np.zeros(len(near), int)
        while near.max() > reach:
            centres.append(int(at.rows[near.argmax()]))
            d = away(own, at.rows, centres[-1])
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centres) - 1
        made = [node(at.rows[owner == i], c, near[owner == i]) for i, c in enumerate(centres)]
        at.children = [child for child, _ in made]
        at.below = tuple(np.array([getattr(c, name) for c in at.children]) for name in ("at", "radius", "norm"))
        todo += made
    return root


class Search:
    """Best ``k`` of the data for each query, ties to the smaller id.

    ``multiplied`` counts the products made, those for bounds included,
    ``possible`` those of all pairs.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int = TOP):
        self.queries, self.ids, self.k = queries, query_ids, k
        self.points = queries.astype(float)
        self.lengths = np.sqrt((self.points**2).sum(1))
        self.tree = cover_tree(self.points)
        self.best = np.full((len(queries), k), np.iinfo(np.int64).min)
        self.which = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.multiplied = self.possible = 0

    def add(self, data: np.ndarray, data_ids: np.ndarray) -> None:
        """Search some more rows."""
        for at in range(0, len(data), TREE_ROWS):
            self.data, self.data_ids = data[at : at + TREE_ROWS], data_ids[at : at + TREE_ROWS]
            self.against = self.data.astype(float)
            largest = max(np.abs(self.queries).max(initial=0), 1), max(np.abs(self.data).max(initial=0), 1)
            self.whole = float(largest[0]) * float(largest[1]) * data.shape[1] < _EXACT
            self.possible += len(self.queries) * len(self.data)
            tree = cover_tree(self.against)
            if self.tree is not None and tree is not None:
                self._down(self.tree, tree)  # what is known of other rows holds here, too

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, data ids and scores."""
        rows, cols = np.nonzero(self.which != np.iinfo(np.int64).max)
        return rows, self.which[rows, cols], self.best[rows, cols]

    def _bounds(self, q: Node, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """No product of a query below ``q`` with a vector of those groups is greater."""
        self.multiplied += len(centres)
        top = self.against[centres] @ self.points[q.at] + q.radius * norms + radii * q.norm + q.radius * radii
        return top + 1e-9 * (np.abs(top) + 1)  # rounding must not drop a pair

    def _down(self, q: Node, d: Node) -> None:
        """Search below two nodes whose bound has been looked at."""
        if q.children and (not d.children or q.radius >= d.radius / 2):
            at = np.array([d.at]), np.array([d.radius]), np.array([d.norm])
            for c in q.children:
                if self._bounds(c, *at)[0] >= c.worst:
                    self._down(c, d)
            q.worst = min(c.worst for c in q.children)
            return
        if not d.children:
            self._multiply(q, d.rows)
            return
        bounds = self._bounds(q, *d.below)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] >= q.worst]
        leaves = order if q.children else order[[not d.children[i].children for i in order]]
        if not q.children:  # leaves in turn, some at a time, until none can reach the worst score
            at = 0
            while at < len(leaves) and bounds[leaves[at]] >= q.worst:
                some, n = [], 0
                while at < len(leaves) and n < AT_ONCE:
                    some.append(d.children[leaves[at]].rows)
                    n, at = n + len(some[-1]), at + 1
                self._multiply(q, np.concatenate(some))
        for i in order:
            c = d.children[i]
            if (q.children or c.children) and bounds[i] >= q.worst:
                self._down(q, c)

    def _multiply(self, q: Node, rows: np.ndarray) -> None:
        self.multiplied += len(q.rows) * len(rows)
        a, b = self.queries[q.rows], self.data[rows]
        score = np.rint(self.points[q.rows] @ self.against[rows].T).astype(np.int64) if self.whole else a @ b.T
        ids = self.data_ids[rows]
        for mine, at in zip(score, q.rows.tolist(), strict=True):
            use = (mine >= self.best[at, -1]) & (ids != self.ids[at])  # each query has its own bound
            if use.any():
                both, names = np.concatenate([self.best[at], mine[use]]), np.concatenate([self.which[at], ids[use]])
                order = np.lexsort((names, ~both))[: self.k]
                self.best[at], self.which[at] = both[order], names[order]
        low = self.best[q.rows, -1].min()
        q.worst = float(low) if low > np.iinfo(np.int64).min else -np.inf


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v``: components as floor(1024 x); vectors with a null or non-finite one are left out."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(usable & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def search(embeddings: DataFrame, k: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best for each row whose vec_id is divisible by ``every``.

    Candidates are all rows but those with the query's own id. Fewer than ``k``
    candidates give fewer rows. A vec_id that repeats is a candidate with each
    of its rows, and as a query it ranks for its smallest vector.
    Rows with a null id and vectors that are null, empty, or hold null or
    non-finite components take no part; nor do vectors of a different length
    than the query. Extra columns are ignored; an empty table gives an empty
    result.
    """
    rows = materialise(whole_vectors(embeddings).where(F.size("v") > 0), "vectors")
    queries = materialise(rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    parts, blocks = rows.count() // DATA_BLOCK + 1, queries.count() // QUERY_BLOCK + 1
    # rows are dealt by their place in the written table, so repeats of an id don't meet in one block
    data = rows.select("vec_id", "v", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("part")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select("vec_id", "v", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int").alias("block")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def vectors(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Ids and vectors of each length."""
        t = t.combine_chunks()
        if not t.num_rows:
            return
        ids, lists = t.column("vec_id").to_numpy(), t.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        widths = np.diff(offsets)
        for w in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == w)
            yield w, ids[mine], flat[offsets[mine][:, None] + np.arange(w)]

    def meet(key: tuple, some: pa.Table, few: pa.Table) -> pa.Table:
        wide = {w: (ids, v) for w, ids, v in vectors(some)}
        out: list[tuple] = []
        for w, ids, v in vectors(few):
            if w in wide:
                search = Search(v, ids, k)
                search.add(wide[w][1], wide[w][0])
                q, vec, score = search.found()
                out.append((ids[q], vec, score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols), strict=True)))

    found = data.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same search, by comparing each query with each row.
ORACLE = f"""
WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NOT NULL]) = len(embedding) AND len([x for x in embedding if isfinite(x)]) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
