"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks. In each block every dimension has its list sorted by value. A query goes down the lists of its
non-zero components, from the end that the component's sign favours and as deep as its size demands; it scores the rows that
it meets for the first time by random access, and stops when no row that it hasn't met can reach its kth result: the bound
is the sum of the query's components times the values at the depths reached. A query first meets one block. Its kth result
there is a floor for all others, which skip it where the bound of the whole block is below that. Blocks' results are merged
by rank. Each query meets each block once, as packed blocks of rows.

How much is saved depends on the data: where components are large in few dimensions, searches stop after a small share of
the rows; where all directions are alike and results score far below the query itself, nearly every row is met before the
bound falls below the kth result. The results are the same.

Null vectors, and vectors that hold a null or non-finite component, take no part; vectors are compared with those of the same
length. Ties go to the smaller id. A repeated id is compared as any other row, but never with itself, and its rows' results
are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, written

#: Of a query that has no floor.
NO_FLOOR = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, v: the vector's components as floor(scale * x); rows that cannot take part are left out."""
    x = F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    bad = F.exists(F.col(vec_col), lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


PACKED = "blk long, dim long, ids binary, vecs binary, floors binary"


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (blk, id, v, floor) to one row a block, task and vector length."""
    for b in batches:
        blk, ids, floor = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
        off = b.column(2).offsets.to_numpy().astype(np.int64)
        flat = b.column(2).values.to_numpy().astype(np.int64)
        size = np.diff(off)
        rows = [(int(k), int(d), np.flatnonzero((blk == k) & (size == d))) for k in np.unique(blk) for d in np.unique(size[blk == k])]
        out = [{"blk": k, "dim": d, "ids": ids[at].astype(np.int64).tobytes(), "vecs": flat[(off[at][:, None] + np.arange(d)).ravel()].tobytes(), "floors": floor[at].astype(np.int64).tobytes()} for k, d, at in rows]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("blk", pa.int64()), ("dim", pa.int64()), *((c, pa.binary()) for c in ("ids", "vecs", "floors"))]))


class Lists:
    """A block's vectors with, for each dimension, their order by value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by], x[by]
        self.most = int(np.abs(self.x).max(initial=0))
        self.order = np.argsort(self.x, axis=0, kind="stable").T.astype(np.int32) if len(ids) else np.zeros((x.shape[1], 0), np.int32)
        # the same lists by row: a row's place in each
        self.place = np.empty(self.x.shape, np.int32)
        np.put_along_axis(self.place, self.order.T, np.arange(len(ids), dtype=np.int32)[:, None], 0)
        self.as32, self.as64 = None, None

    def matrix(self, bound: int):
        """The narrowest copy in which sums up to bound are exact."""
        if bound < 2**24:
            if self.as32 is None:
                self.as32 = self.x.astype(np.float32)
            return self.as32
        if bound < 2**53:
            if self.as64 is None:
                self.as64 = self.x.astype(np.float64)
            return self.as64
        return self.x.astype(object)

    def top(self, me: int, q: np.ndarray, k: int, floor: int = NO_FLOOR) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k best (ties to the smaller id) that reach the floor, and how many rows were scored."""
        n, dims = self.x.shape
        lists = np.flatnonzero(q)
        if not n or not len(lists):  # all scores are 0
            ids = self.ids[self.ids != me][:k] if floor <= 0 else self.ids[:0]
            return ids, np.zeros(len(ids), np.int64), 0
        m = self.matrix(int(np.abs(q).max()) * self.most * dims)
        qq = q.astype(m.dtype)
        up, weight = q[lists] > 0, np.abs(q[lists]) / np.abs(q).max()
        seen, rows, scores, best = np.zeros(n, bool), [], [], np.zeros(0, m.dtype)
        depth, reach, left, need = np.zeros(len(lists), np.int64), max(8, k), n, floor
        at = np.where(up, self.order[lists, n - 1], self.order[lists, 0])
        while left:
            if (m[at, lists] * qq[lists]).sum() < need:
                break
            to = np.minimum(n, np.ceil(reach * weight).astype(np.int64))
            if left * len(lists) < (to - depth).sum():  # few are left: which of them lie above the new depths
                new = np.flatnonzero(~seen)
                at = self.place[new][:, lists]
                new = new[np.where(up, at >= n - to, at < to).any(1)]
                seen[new] = True
            else:
                met = np.concatenate([self.order[d, n - b : n - a] if high else self.order[d, a:b] for d, high, a, b in zip(lists.tolist(), up.tolist(), depth.tolist(), to.tolist(), strict=True)])
                before = seen.copy()
                seen[met] = True
                new = np.flatnonzero(seen & ~before)
            left -= len(new)
            new = new[self.ids[new] != me]
            rows.append(new)
            scores.append(m[new] @ qq)
            best = np.concatenate([best, scores[-1]])
            if len(best) >= k:
                best = np.sort(best)[-k:] if m.dtype == object else np.partition(best, len(best) - k)[-k:]
                need = max(floor, int(min(best)))
            depth, reach = to, reach * 3
            at = np.where(up, self.order[lists, n - depth], self.order[lists, depth - 1])
        if not rows:
            return self.ids[:0], np.zeros(0, np.int64), 0
        rows, scores = np.concatenate(rows), np.concatenate(scores)
        ok = scores >= need
        ids, s = self.ids[rows[ok]], np.array([int(v) for v in scores[ok]], np.int64)
        by = np.lexsort((ids, -s))[:k]
        return ids[by], s[by], len(rows)


def search(lists: Lists, ids: np.ndarray, vecs: np.ndarray, floors: np.ndarray, k: int) -> pa.Table:
    """query_id, vec_id, score of what each query finds in a block."""
    out = []
    for me, q, floor in zip(ids, vecs, floors, strict=True):
        found, scores, _ = lists.top(int(me), q, k, int(floor))
        out.append((np.full(len(found), me, np.int64), found, scores))
    return pa.table([np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(3)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a predicate over the id column named ``id``."""
    rows = quantised(vectors, id_col, vec_col, scale)
    blocks = max(1, -(-vectors.count() // block_rows))
    home = lambda *seed: F.pmod(F.xxhash64("id", *seed), F.lit(blocks)).cast("long")
    dealt = rows.select(home().alias("blk"), "id", "v", F.lit(NO_FLOOR).alias("floor"))
    shards = dealt.repartition(blocks, "blk").sortWithinPartitions("blk").mapInArrow(pack, PACKED)
    asked = rows.where(is_query).select(home(F.lit(7)).alias("blk"), "id", "v")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[1].as_py()

        def joined(t: pa.Table, name: str) -> np.ndarray:
            return np.frombuffer(b"".join(x.as_py() for x in t.column(name)), np.int64)

        ids, queries = joined(left, "ids"), joined(right, "ids")
        got = search(Lists(ids, joined(left, "vecs").reshape(len(ids), dim)), queries, joined(right, "vecs").reshape(len(queries), dim), joined(right, "floors"), k)
        give_back()
        return got

    def met(queries: DataFrame) -> DataFrame:
        return shards.groupBy("blk", "dim").cogroup(queries.groupBy("blk", "dim")).applyInArrow(run, "query_id long, vec_id long, score long")

    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    first = written(met(asked.withColumn("floor", F.lit(NO_FLOOR)).repartition(blocks, "blk").mapInArrow(pack, PACKED)), "nearest")
    floors = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    again = asked.join(floors, "id", "left").select("blk", "id", "v", F.coalesce("floor", F.lit(NO_FLOOR)).alias("floor")).repartition(blocks, "blk").mapInArrow(pack, PACKED)
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda x: x != F.col("blk"))
    near = first.unionByName(met(again.select(F.explode(others).alias("blk"), "dim", "ids", "vecs", "floors")))
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
