"""Repulsion of t-SNE by cells of a quadtree, as joins; no task holds all points.

Points of the plane fall into square cells on ``levels`` levels. A cell is summed up by its mass, its centre of mass and its second
moments, for all levels at once. A point meets a cell on the coarsest level on which the two aren't near (more than ``apart`` cells
lie between the point's own and it): those are the children of the cells near the point's parent that aren't near the point itself, a
fixed list of offsets, so the meeting is an equi-join on level and place, of cells with cells. On the finest level the near cells
are met as well, whatever they hold: its cells are narrower than the kernel, which is smooth, so a cell stands for its points there too, and
a cell that holds a third of them costs no more than another. Its own cell is met without the point itself.

Each meeting is the second-order expansion of the kernels 1 / (1 + r^2) and 1 / (1 + r^2)^2 around the cell's centre of mass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .distance import block_pairs, matrix, summed


def levels_for(width: float, finest: float, least: int = 3, most: int = 20) -> int:
    """So many that cells of the last level are at most ``finest`` wide."""
    return int(np.clip(np.ceil(np.log2(max(width, 1e-12) / finest)), least, most))


def cells_of(y: DataFrame, low: tuple[float, float], width: float, levels: int) -> DataFrame:
    """level, cx, cy, n, sums (of x, y, xx, xy, yy, around the cell's middle): the finest level from the points, the others from it."""
    at = lambda k: F.get("y", F.lit(k))
    place = lambda k: F.least(F.floor((at(k) - low[k]) / width * 2**levels), F.lit(2**levels - 1)).cast("long")
    own = y.select(place(0).alias("cx"), place(1).alias("cy"), at(0).alias("a"), at(1).alias("b"))
    finest = own.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in (("a", F.col("a")), ("b", F.col("b")), ("aa", F.col("a") * F.col("a")), ("ab", F.col("a") * F.col("b")), ("bb", F.col("b") * F.col("b")))])
    finest = written(finest, "finest")
    up = finest.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels)))).withColumns({c: F.expr(f"shiftright({c}, {levels} - level)") for c in ("cx", "cy")})
    sums = up.groupBy("level", "cx", "cy").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "ab", "bb")])
    a, b = F.col("a") / F.col("n"), F.col("b") / F.col("n")
    return sums.select("level", "cx", "cy", "n", a.alias("ma"), b.alias("mb"), (F.col("aa") / F.col("n") - a * a).alias("saa"), (F.col("ab") / F.col("n") - a * b).alias("sab"), (F.col("bb") / F.col("n") - b * b).alias("sbb"))


def offsets(apart: int, last: bool) -> list[tuple[int, int, int, int]]:
    """Of a cell with parities (px, py) on its level: px, py and where the cells that it meets lie."""
    reach, out = 2 * apart + 1, []
    for px in (0, 1):
        for py in (0, 1):
            xs, ys = ([d for d in range(-reach - 1, reach + 2) if abs((p + d) // 2) <= apart] for p in (px, py))
            out += [(px, py, dx, dy) for dx in xs for dy in ys if last or max(abs(dx), abs(dy)) > apart]
    return out


def meet(y: np.ndarray, own: np.ndarray, cell: dict[str, np.ndarray]) -> np.ndarray:
    """Rows (z, fx, fy): what points y (m, 2) get from cells, summed over them; own: is it the point's own cell, by cell."""
    out = np.zeros((len(y), 3))
    for k in range(len(own)):
        n, m = cell["n"][k], np.array([cell["ma"][k], cell["mb"][k]])
        s = np.array([[cell["saa"][k], cell["sab"][k]], [cell["sab"][k], cell["sbb"][k]]])
        each, at, spread = np.full(len(y), float(n)), np.broadcast_to(m, y.shape), np.broadcast_to(s, (len(y), 2, 2))
        if own[k]:  # without the point itself
            if n < 2:
                continue
            each = each - 1
            at = (n * m - y) / (n - 1)
            second = n * (s + np.outer(m, m)) - y[:, :, None] * y[:, None, :]
            spread = second / (n - 1) - at[:, :, None] * at[:, None, :]
        d = y - at
        r2 = (d * d).sum(1)
        w = 1 / (1 + r2)
        trace, along = spread[:, 0, 0] + spread[:, 1, 1], np.einsum("ki,kij,kj->k", d, spread, d)
        # half the second moments times the second derivatives of w, and of w^2 d
        out[:, 0] += each * (w + 4 * w**3 * along - w**2 * trace)
        turned = np.einsum("kij,kj->ki", spread, d)
        out[:, 1:] += each[:, None] * (d * (w**2 + 12 * w**4 * along - 2 * w**3 * trace)[:, None] - 4 * (w**3)[:, None] * turned)
    return out


def repulsion(y: DataFrame, finest: float = 0.125, apart: int = 2) -> DataFrame:
    """id, z (the sum of 1 / (1 + r^2) over all other points) and f (that of (y - y') / (1 + r^2)^2), of points (id, y) in the plane.
    By the defaults, the error of f is below a hundredth of its mean length, and of z below a thousandth."""
    ends = y.agg(*[g(F.get("y", F.lit(k))).alias(f"{n}{k}") for k in (0, 1) for n, g in (("lo", F.min), ("hi", F.max))]).first()
    if ends.lo0 is None:
        return y.select("id", F.lit(0.0).alias("z"), F.array(F.lit(0.0), F.lit(0.0)).alias("f"))
    low, width = (ends.lo0, ends.lo1), max(ends.hi0 - ends.lo0, ends.hi1 - ends.lo1, 1e-9)
    levels = levels_for(width, finest)
    cells = written(cells_of(y, low, width, levels), "cells")
    which = y.sparkSession.createDataFrame([(last, *o) for last in (False, True) for o in offsets(apart, last)], "last boolean, px long, py long, dx long, dy long")
    mine = cells.select("level", F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("level") == levels).alias("last"), (F.col("cx") % 2).alias("px"), (F.col("cy") % 2).alias("py")).where("level > 1 OR last")
    asked = mine.join(F.broadcast(which), ["last", "px", "py"]).select("level", "x", "y", (F.col("x") + F.col("dx")).alias("cx"), (F.col("y") + F.col("dy")).alias("cy"))  # the offsets are a fixed list
    names = ["cx", "cy", "n", "ma", "mb", "saa", "sab", "sbb"]
    lists = asked.join(cells, ["level", "cx", "cy"]).groupBy("level", "x", "y").agg(*[F.collect_list(c).alias(c) for c in names])  # as long as the list of offsets
    # on its way down a finest cell collects what the cells above it meet
    down = lists.withColumn("to", F.lit(levels) - F.col("level"))
    at = lambda k: F.get("y", F.lit(k))
    place = lambda k: F.least(F.floor((at(k) - low[k]) / width * 2**levels), F.lit(2**levels - 1)).cast("long")
    points = y.select("id", "y", place(0).alias("px"), place(1).alias("py")).withColumn("level", F.explode(F.sequence(F.lit(min(2, levels)), F.lit(levels))))
    points = points.withColumns({c: F.expr(f"shiftright({c}, {levels} - level)") for c in ("px", "py")})
    joined = points.join(down.withColumnRenamed("x", "px").withColumnRenamed("y", "py").drop("to"), ["level", "px", "py"]).select("id", "y", "level", "px", "py", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            xy, key = matrix(t["y"]), np.stack([t[c].to_numpy() for c in ("level", "px", "py")], 1)
            _, first, group = np.unique(key, axis=0, return_index=True, return_inverse=True)
            out = np.zeros((t.num_rows, 3))
            for g, at_ in enumerate(first.tolist()):
                rows = np.flatnonzero(group.ravel() == g)
                cell = {c: np.array(t[c][at_].as_py()) for c in names}
                own = (cell["cx"] == key[at_, 1]) & (cell["cy"] == key[at_, 2])
                out[rows] = meet(xy[rows], own, cell)
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), *(pa.array(out[:, k]) for k in range(3))], names=["id", "z", "fx", "fy"])

    parts = joined.mapInArrow(run, "id long, z double, fx double, fy double")
    return parts.groupBy("id").agg(F.sum("z").alias("z"), F.array(F.sum("fx"), F.sum("fy")).alias("f"))


def repulsion_of_pairs(y: DataFrame) -> DataFrame:
    """What ``repulsion`` approximates, by all pairs; a pair of blocks sends a row a point, and a task holds one tile of distances."""

    def emit(j, i, d2, yj, yi):
        w = 1 / (1 + d2)
        if np.isin(j, i).any():
            w[j[:, None] == i] = 0
        z = w.sum(1)
        w *= w
        f = w.sum(1)[:, None] * yj - w @ yi
        return pa.table({"id": j, "z": z, "fx": f[:, 0], "fy": f[:, 1]})

    both = y.select("id", F.col("y").alias("x"), "y")
    parts = block_pairs(both, both, ["x"], emit, "id long, z double, fx double, fy double", carried=("y",), fold=summed("id", "z", "fx", "fy"))
    return parts.groupBy("id").agg(F.sum("z").alias("z"), F.array(F.sum("fx"), F.sum("fy")).alias("f"))


def tsne_gradient(y: DataFrame, p: DataFrame, finest: float = 0.125) -> DataFrame:
    """id, g: the gradient of the divergence of t-SNE. p: similarities j, i, p in both directions, of sum 1; those left out are 0."""
    far = written(repulsion(y, finest), "repulsion")
    total = far.agg(F.sum("z")).first()[0] or 1.0
    at = lambda c, k: F.get(c, F.lit(k))
    ends = p.where("j <> i").join(y.select(F.col("id").alias("j"), F.col("y").alias("a")), "j").join(y.select(F.col("id").alias("i"), F.col("y").alias("b")), "i")
    pull = F.col("p") / (1 + (at("a", 0) - at("b", 0)) ** 2 + (at("a", 1) - at("b", 1)) ** 2)
    near = ends.groupBy(F.col("j").alias("id")).agg(*[F.sum(pull * (at("a", k) - at("b", k))).alias(f"a{k}") for k in (0, 1)])
    return far.join(near, "id", "left").select("id", F.array(*[4 * (F.coalesce(f"a{k}", F.lit(0.0)) - at("f", k) / total) for k in (0, 1)]).alias("g"))


def tsne_steps(y: DataFrame, p: DataFrame, steps: int, rate: float, momentum: float = 0.5, finest: float = 0.125) -> DataFrame:
    """id, y after some steps of gradient descent with momentum; each step's points are written, so any executor may be lost."""
    now = y.select("id", "y", F.array(F.lit(0.0), F.lit(0.0)).alias("v"))
    for k in range(steps):
        g = tsne_gradient(now, p, finest)
        v = F.zip_with("v", "g", lambda a, b: momentum * a - rate * b)
        now = written(now.join(g, "id").select("id", "y", v.alias("v")).select("id", F.zip_with("y", "v", lambda a, b: a + b).alias("y"), "v"), f"step-{k}")
    return now.select("id", "y")
