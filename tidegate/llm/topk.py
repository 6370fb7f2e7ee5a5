"""Exact top-k search by inner product over integer vectors.

Each shard of vectors (of bounded size) gets a ball tree. A block of queries goes down a tree together: a node is entered
only by those queries whose upper bound there, q.c + |q| * r, reaches their current k-th score, children with the larger
bounds first. The k-th scores start from the scores within the query block, which are rows of the table too, and are kept
from one shard of a task to the next. Doubles hold inner products exactly up to 2**53; where a shard's may be larger, they
only choose the pairs that could matter, by bounds on their error, and these are scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegate.llm.shared import Stash, bounded_batches
from tidegate.llm.words import returned

LEAF = 64
#: Queries that are held by each task at a time, and vectors in a tree.
BLOCK = 8192
SHARD = 1 << 14
_PAIRS = 1 << 20
_EXACT = 2.0**52
_MOST = (1 << 63) - 1


def _vectors(ids: pa.Array, lists: pa.Array, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, floor(scale * x) as float64 matrix) of the usable rows, by dimension."""
    if isinstance(lists, pa.ChunkedArray):
        lists, ids = lists.combine_chunks(), ids.combine_chunks()
    sizes = np.array([-1 if n is None else n for n in lists.value_lengths().to_pylist()], dtype=np.int64)
    flat = lists.flatten()
    values = np.floor(scale * flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    known = ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero((sizes == dim) & known)
        matrix = values[starts[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            yield dim, number[rows[fine]], matrix[fine]


class _Ball:
    __slots__ = ("centre", "children", "radius", "rows", "size")

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        own = x[rows]
        self.centre = own.mean(axis=0)
        gaps = own - self.centre
        self.radius = float(np.sqrt((gaps * gaps).sum(axis=1).max()))
        self.size = float(np.sqrt((self.centre * self.centre).sum()))
        self.children: list[_Ball] = []
        self.rows = rows
        if len(rows) > LEAF:
            far = gaps[np.argmax((gaps * gaps).sum(axis=1))]
            order = np.argpartition(own @ far, len(rows) // 2)
            self.children = [_Ball(x, rows[order[: len(rows) // 2]]), _Ball(x, rows[order[len(rows) // 2 :]])]
            self.rows = rows[:0]


class _Search:
    """The best pairs of one block of queries so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.kth = kth.astype(np.float64)
        self.large = False
        self.scored = 0  # pairs whose score was computed
        self.best = np.full((len(ids), k), -np.inf)
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def _bound(self, ball: _Ball, active: np.ndarray) -> np.ndarray:
        near, far = self.q[active] @ ball.centre, self.norm[active] * ball.radius
        high = near + far + 1e-9 * (np.abs(near) + far + self.norm[active] * ball.size) + 1e-3  # rounding must not prune
        return np.where(np.isnan(high), np.inf, high)

    def visit(self, ball: _Ball, ids: np.ndarray, x: np.ndarray, active: np.ndarray, high: np.ndarray) -> None:
        active = active[high >= self.kth[active]]
        if not len(active):
            return
        if ball.children:
            bounds = [self._bound(c, active) for c in ball.children]
            for i in np.argsort([-b.sum() for b in bounds]):
                self.visit(ball.children[i], ids, x, active, bounds[i])
            return
        self.scored += len(active) * len(ball.rows)
        (self.offer_large if self.large else self.offer)(ids[ball.rows], x[ball.rows], active)

    def _raise_kth(self, scores: np.ndarray, active: np.ndarray) -> None:
        both = np.concatenate([self.best[active], scores], axis=1)
        self.best[active] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self.kth[active] = np.maximum(self.kth[active], self.best[active].min(axis=1))

    def _take(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.pairs.append((queries, ids, scores))
        self.count += len(queries)
        if self.count > _PAIRS:
            self.shrink()

    def offer(self, ids: np.ndarray, x: np.ndarray, active: np.ndarray) -> None:
        scores = np.where(self.ids[active][:, None] == ids[None, :], -np.inf, self.q[active] @ x.T)
        self._raise_kth(scores, active)
        a, b = np.nonzero((scores >= self.kth[active][:, None]) & (scores > -np.inf))
        self._take(active[a], ids[b], scores[a, b])

    def offer_large(self, ids: np.ndarray, x: np.ndarray, active: np.ndarray) -> None:
        """As ``offer``, with an interval in place of each score until it is known that it could matter."""
        with np.errstate(over="ignore", invalid="ignore"):
            near = self.q[active] @ x.T
            error = self.norm[active][:, None] * np.sqrt((x * x).sum(axis=1))[None, :] * ((x.shape[1] + 4) * 2.0**-51) + 1.0
            own = self.ids[active][:, None] == ids[None, :]
            self._raise_kth(np.where(own, -np.inf, np.nan_to_num(near - error, nan=-np.inf, neginf=-np.inf, posinf=-np.inf)), active)
            a, b = np.nonzero(~(near + error < self.kth[active][:, None]) & ~own)  # also where the sum is no number
        whole = lambda m: np.array([int(v) for v in m.ravel().tolist()], dtype=object).reshape(m.shape)
        rows, columns = whole(self.q[active]), whole(x)
        scores = np.array([int((rows[i] * columns[j]).sum()) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=object)
        self._take(active[a], ids[b], scores)

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At most k pairs of each query, ties to smaller ids."""
        q, v, s = (np.concatenate([p[i] for p in self.pairs]) if self.pairs else np.zeros(0, np.int64) for i in range(3))
        if s.dtype == object:
            order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(s[i]), v[i])), dtype=np.int64)
        else:
            order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < self.k
        self.pairs, self.count = [(q[keep], v[keep], s[keep])], int(keep.sum())
        return self.pairs[0]

    def shard(self, ids: np.ndarray, x: np.ndarray) -> None:
        everyone = np.arange(len(self.ids))
        with np.errstate(over="ignore", invalid="ignore"):
            self.large = not np.abs(x).max(initial=0) * np.abs(self.q).max(initial=0) * max(1, x.shape[1]) < _EXACT
            root = _Ball(x, np.arange(len(ids)))
            self.visit(root, ids, x, everyone, self._bound(root, everyone))


@returned
def _search(batches: Iterator[pa.RecordBatch], blocks: dict, k: int, scale: float) -> Iterator[pa.RecordBatch]:
    searches = {dim: _Search(ids, q, kth, k) for dim, (ids, q, kth) in blocks.items()}
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {dim: [] for dim in searches}

    def searched(dim: int) -> None:
        if held[dim]:
            searches[dim].shard(np.concatenate([i for i, _ in held[dim]]), np.concatenate([x for _, x in held[dim]]))
            held[dim] = []

    for batch in batches:
        for dim, ids, x in _vectors(batch.column(0), batch.column(1), scale):
            if dim in searches:
                held[dim].append((ids, x))
                if sum(len(i) for i, _ in held[dim]) * max(1, dim / 64) >= SHARD:
                    searched(dim)
    for dim, search in searches.items():
        searched(dim)
        q, v, s = search.shrink()
        s = np.array([max(-_MOST - 1, min(_MOST, int(n))) for n in s.tolist()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(search.ids[q.astype(np.int64)].astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s)], ["query_id", "vec_id", "score"])


def _first_kth(ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th score: the k-th among the other queries, less what doubles could miss."""
    out = np.full(len(ids), -np.inf)
    if len(ids) > k:
        for i in range(0, len(ids), 256):
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.nan_to_num(q[i : i + 256] @ q.T, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
            scores[np.arange(len(scores)), i + np.arange(len(scores))] = -np.inf
            out[i : i + 256] = np.partition(scores, len(ids) - k, axis=1)[:, -k]
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((q * q).sum(axis=1))
            if np.abs(q).max(initial=0) ** 2 * max(1, q.shape[1]) >= _EXACT:
                out -= np.nan_to_num(norm * norm.max() * ((q.shape[1] + 4) * 2.0**-51) + 1.0, nan=np.inf, posinf=np.inf)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of ``vectors`` with the largest inner products,
    ties to smaller ids; rows with the query's own id are never its results.

    Components become floor(scale * x). Vectors that are null, hold null or non-finite components (also after scaling), or
    have a null id take no part; vectors of other dimensions than a query's are not its candidates. ``queries`` must be
    rows of ``vectors``; of repeated query ids the smallest usable vector counts, while repeated candidate rows count
    each. Scores are exact; one beyond 64 bits comes as the limit of these, and such scores are ties. Queries are handled
    in blocks of BLOCK, of which one at a time is held by the driver and by tasks.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    table = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null and v is not null")
    usable = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float("inf")))
    asked = asked.where(usable).groupBy("vec_id").agg(F.min("v").alias("v"))
    count = asked.count()
    blocks = max(1, -(-count * 5 // (BLOCK * 4)))  # of hashed ids, so with some room
    found, stash = None, Stash(spark) if blocks > 1 else None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = own.orderBy("vec_id").toArrow()
        held = {dim: (ids, q, _first_kth(ids, q, k)) for dim, ids, q in _vectors(rows.column(0), rows.column(1), scale)} if rows.num_rows else {}
        part = table.mapInArrow(partial(_search, blocks=held, k=k, scale=scale), "query_id long, vec_id long, score long")
        part = stash.keep(part, "found") if stash else part  # so that the next block takes this one's place
        found = part if found is None else found.unionByName(part)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
