"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound for blocks of queries.

Rows are dealt to shards by a hash of vec_id, about SHARD_ROWS each, and queries to blocks of about
QUERY_BLOCK; a task holds one shard and one block. A shard's tree halves its rows along the line
through two far rows; a node bounds the inner product with query q by q . centre + |q| radius. Each
query visits leaves in the order of that bound (tightened by the bounds above) and stops when the
bound is under its k-th best score.

The k-th score is shared: every query first searches one home shard, and the score found there is
where its search of all other shards starts. Bounds are padded, and only leaves whose bound is
strictly under the k-th score are left out, so ties are never lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytable.functions.storage import written

SHARD_ROWS = 8_192
QUERY_BLOCK = 1_024
LEAF_ROWS = 128
SCALE = 64
_NONE = np.iinfo(np.int64).min + 1


@dataclass
class BallTree:
    """Leaves as ranges of ``order``; every node's centre, radius and parent; ``leaf`` holds the leaf nodes."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @staticmethod
    def built(rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
        order = np.arange(len(rows))
        centre, radius, parent, leaf, begin, end = [], [], [], [], [], []
        todo = [(0, len(rows), -1)]
        while todo:
            a, b, up = todo.pop()
            x = rows[order[a:b]]
            middle = x.mean(axis=0)
            far = np.sqrt(((x - middle) ** 2).sum(axis=1))
            node = len(centre)
            centre.append(middle)
            radius.append(far.max() if len(far) else 0.0)
            parent.append(up)
            one = x[np.argmax(far)]
            line = x[np.argmax(((x - one) ** 2).sum(axis=1))] - one
            if b - a <= leaf_rows or not line.any():  # small, or all rows equal
                leaf.append(node)
                begin.append(a)
                end.append(b)
                continue
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(x @ line, half)]
            todo += [(a, a + half, node), (a + half, b, node)]
        return BallTree(order, np.array(centre), np.array(radius), np.array(parent), np.array(leaf), np.array(begin), np.array(end))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with any row of each leaf."""
        size = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        reach = queries @ self.centre.T + size * self.radius
        # sums of large products that cancel are off by their own size
        reach += 1e-9 * size * (np.sqrt((self.centre ** 2).sum(axis=1)) + self.radius) + 1e-3
        for node in range(1, len(self.parent)):  # parents come before their children
            reach[:, node] = np.minimum(reach[:, node], reach[:, self.parent[node]])
        return reach[:, self.leaf]


def _best(scores: np.ndarray, place: np.ndarray, k: int, top: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then by place (smaller first)."""
    if scores.shape[1] <= k:
        return scores, place
    if top < (1 << 62) // max(n, 1) - 1:  # score and place fit into one number
        key = np.where(scores == _NONE, _NONE, scores * n + (n - 1 - place))
        at = np.argpartition(key, -k, axis=1)[:, -k:]
    else:
        at = np.lexsort((place, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(place, at, 1)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _reach(x: np.ndarray) -> int:
    """The largest sum of the sizes of a row's components."""
    return max((sum(map(abs, row)) for row in x.tolist()), default=0)


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the shard among each query's k best that reach ``floor``: place of the query, vec_id, score."""
    by_id = np.argsort(ids, kind="stable")
    ids, rows = ids[by_id], rows[by_id]
    # no score of these rows is larger; Python's whole numbers do not run over
    top = rows.shape[1] * _largest(rows) * _largest(queries)
    if top >= 1 << 62:
        # exact bound: largest sums of sizes instead of the number of components times the largest product
        top = min(_reach(rows) * _largest(queries), _reach(queries) * _largest(rows))
    if top >= 1 << 62:
        raise OverflowError(f"inner products of up to {top} may not fit a long")
    kind = np.float64 if top < 1 << 52 else np.int64
    x, q = rows.astype(np.float64), queries.astype(np.float64)
    tree = BallTree.built(x)
    bound = tree.bounds(q)
    visit = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((len(q), k), _NONE, dtype=np.int64)
    place = np.zeros((len(q), k), dtype=np.int64)
    exact_rows, exact_q = rows.astype(kind), queries.astype(kind)
    for r in range(bound.shape[1]):
        kth = np.maximum(score.min(axis=1), floor)
        next_leaf = visit[:, r]
        going = np.flatnonzero(bound[np.arange(len(q)), next_leaf] >= kth)
        if not len(going):
            break  # bounds only fall from here on
        going = going[np.argsort(next_leaf[going], kind="stable")]
        cuts = np.flatnonzero(np.diff(next_leaf[going])) + 1
        for some in np.split(going, cuts):
            at = next_leaf[some[0]]
            member = tree.order[tree.begin[at]:tree.end[at]]
            s = (exact_q[some] @ exact_rows[member].T).astype(np.int64)
            s[query_ids[some][:, None] == ids[member][None, :]] = _NONE
            both = np.concatenate([score[some], s], axis=1)
            where = np.concatenate([place[some], np.broadcast_to(member, s.shape)], axis=1)
            score[some], place[some] = _best(both, where, k, top, len(ids))
    of, col = np.nonzero((score != _NONE) & (score >= floor[:, None]))
    return of, ids[place[of, col]], score[of, col]


def _task(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

        def matrix(t: pa.Table, name: str) -> np.ndarray:
            return t.column(name).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        query_ids = queries.column("q_vec_id").to_numpy()
        of, found, score = search(rows.column("vec_id").to_numpy(), matrix(rows, "v"), query_ids, matrix(queries, "q_v"), queries.column("q_floor").to_numpy(), k)
        return pa.table({"query_id": query_ids[of], "vec_id": found, "score": score})
    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim, v (floor of SCALE times each component) of the vectors that take part.

    Null and empty vectors, vectors with a null or non-finite component, and rows without an id take
    no part. A component whose SCALE fold no long holds is an error.
    """
    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * SCALE)
        held = F.abs(x.cast("double")) < float(1 << 63) / SCALE
        return F.when(held, y).otherwise(F.raise_error(F.concat(F.lit("component too large for a score that a long holds: "), x.cast("string"))).cast("long"))

    v = F.transform(F.col(vector_col), whole)
    fine = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter((F.size(vector_col) > 0) & fine)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dim"), F.transform(v, lambda x: x.cast("long")).alias("v"))


def top_k(rows: DataFrame, queries: DataFrame, k: int, *, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest inner product for each query, ties to smaller vec_id.

    ``rows`` and ``queries`` come from ``quantised``; only vectors of equal length meet, and rows
    with the query's id do not count. Fewer than k rows: all of them. A repeated query id gives one
    answer if its vectors are equal; repeated row ids are separate candidates.
    """
    # only (dim, number of rows) comes to the driver
    n = rows.groupBy("dim").agg(F.count("*").alias("n"))
    q = queries.groupBy("dim").agg(F.count("*").alias("m"))
    plan = n.join(q, "dim").select("dim", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("m") / query_block).cast("int").alias("blocks"))
    plan = written(plan, "search-plan")
    # one row per length of vector: as good as constant, but its size is left to the optimizer
    dealt = rows.join(plan, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "shard", "block", "vec_id", "v")
    asked = queries.dropDuplicates(["vec_id", "v"]).join(plan, "dim").withColumns({
        "block": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"), "home": F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("shards")).cast("int")})
    keys = ["dim", "shard", "block"]
    schema = "query_id long, vec_id long, score long"
    first = asked.select("dim", F.col("home").alias("shard"), "block", "vec_id", "v", F.lit(int(_NONE)).alias("floor"))

    def searched(some: DataFrame) -> DataFrame:
        some = some.select(*[F.col(c).alias(f"q_{c}") for c in some.columns])
        return dealt.groupBy(*keys).cogroup(some.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(_task(k), schema)

    near = written(searched(first), "search-home")
    # the k-th score of the home shard, where it has as many rows
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
    rest = asked.join(kth.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(int(_NONE))))
    rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).filter("shard != home").select(*keys, "vec_id", "v", "floor")
    far = searched(rest)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
