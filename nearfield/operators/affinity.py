"""Similarities of points to their neighbours, entropy equalization and divergences.

h is half the squared distance. Entries with h <= 1e-64 (a point itself, exact duplicates) get the log similarity -746,
so they weigh nothing. All are columns of one source j, so one shuffle by j serves minimum, sum and entropy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .distance import RANKED, beside_all, block_pairs, closely, summed

NEGLIGIBLE = 1e-64
LOG_ZERO = -746.0
#: Half a squared distance at which nothing weighs anything.
FAR = 1e300
#: Floors below which a similarity's logarithm is not taken.
FLOOR_WIDE, FLOOR_NARROW = 3e-324, 8e-46


def half_squared(dist: DataFrame) -> DataFrame:
    return dist.select("j", "i", (0.5 * F.col("d2")).alias("h"))


def _normalized(rows: DataFrame, log_sim: Column) -> DataFrame:
    w = Window.partitionBy("j")
    s = rows.withColumn("l", log_sim).withColumn("z", F.sum(F.exp("l")).over(w))
    return s.select("j", "i", "h", (F.exp("l") / F.col("z")).alias("p"), (F.col("l") - F.log("z")).alias("lp"))


def softmax(h: DataFrame, precision: Column | float) -> DataFrame:
    """j, i, h, p, lp; precision: a number or a column of h (one value for each j)."""
    px = precision if isinstance(precision, Column) else F.lit(float(precision))
    none = F.abs("h") <= NEGLIGIBLE
    least = F.min(F.when(~none, F.col("h"))).over(Window.partitionBy("j"))
    return _normalized(h.withColumn("least", least), F.when(none, LOG_ZERO).otherwise(-px * (F.col("h") - F.col("least"))))


def student(h: DataFrame, precision: Column | float, dof: float = 1.0, mvr: float = 1.0) -> DataFrame:
    """Heavy-tailed similarities; only the point itself is left out."""
    px = precision if isinstance(precision, Column) else F.lit(float(precision))
    t = h.withColumn("t", F.log1p(F.lit(2.0 / dof) * px * F.col("h")))
    least = F.min(F.when(F.col("i") != F.col("j"), F.col("t"))).over(Window.partitionBy("j"))
    return _normalized(t.withColumn("least", least), F.when(F.col("i") == F.col("j"), LOG_ZERO).otherwise(F.lit(-(dof + mvr) / 2) * (F.col("t") - F.col("least"))))


def multiscale(h: DataFrame, precisions: list[float], weights: list[float] | None = None, floor: float = FLOOR_WIDE) -> DataFrame:
    """The (weighted) mean of softmaxes. All scales share one pass: the sums over j are taken side by side."""
    w = Window.partitionBy("j")
    weights = weights or [1 / len(precisions)] * len(precisions)
    none = F.abs("h") <= NEGLIGIBLE
    rows = h.withColumn("least", F.min(F.when(~none, F.col("h"))).over(w))
    rows = rows.select("*", *[F.exp(F.when(none, LOG_ZERO).otherwise(-F.lit(float(p)) * (F.col("h") - F.col("least")))).alias(f"s{k}") for k, p in enumerate(precisions)])
    p = sum(F.lit(wt) * F.col(f"s{k}") / F.sum(f"s{k}").over(w) for k, wt in enumerate(weights))
    return rows.select("j", "i", "h", p.alias("p")).withColumn("lp", F.log(F.greatest(F.lit(floor), F.col("p"))))


def entropy(sim: DataFrame) -> DataFrame:
    return sim.groupBy("j").agg((-F.sum(F.col("p") * F.col("lp"))).alias("entropy"))


def symmetrized(sim: DataFrame, n: int) -> DataFrame:
    """i, j, p: (P + transposed P) / 2N; sums to 1."""
    both = sim.select("j", "i", "p").unionByName(sim.select(F.col("i").alias("j"), F.col("j").alias("i"), "p"))
    return both.groupBy("j", "i").agg((F.sum("p") * (0.5 / n)).alias("p"))


def kl(p: DataFrame, q: DataFrame, eps: float = 2.2e-16) -> DataFrame:
    """One row: sum p (ln(p + eps) - ln q) over pairs of different points; q has lq."""
    return p.where("i <> j").join(q.select("j", "i", "lq"), ["j", "i"]).agg(F.sum(F.col("p") * (F.log(F.col("p") + eps) - F.col("lq"))).alias("kl"))


def softmax_sums(points: DataFrame, precision: float, kernel: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """id, least, z, u, s of each source j: the least h = d2 / 2 that isn't negligible, and over all others the sums of e =
    exp(-precision * (h - least)), of e * (h - least), and of the kernel of squared distances in y (0 if none is given). Each pair
    of blocks sends one row a source, taken from the least of that block; what is summed is moved to the least of all."""

    def sums(j, i, dx, dy=None):
        h = dx / 2
        none = h <= NEGLIGIBLE if h.min(initial=np.inf) <= NEGLIGIBLE else None  # few tiles hold copies
        least = (h if none is None else np.where(none, np.inf, h)).min(1, initial=np.inf)
        over = h - np.where(np.isfinite(least), least, 0)[:, None]
        e = np.exp(-precision * over)
        if none is not None:
            over[none] = e[none] = 0
        s = np.zeros(len(j)) if kernel is None else (kernel(dy) * (j[:, None] != i[None, :])).sum(1)
        return pa.table({"id": j, "lowest": least, "z": e.sum(1), "u": np.einsum("ab,ab->a", e, over), "s": s})

    def fold(t):
        ids, at = np.unique(t["id"].to_numpy(), return_inverse=True)
        low, z, u, s = (t[c].to_numpy() for c in ("lowest", "z", "u", "s"))
        least = np.full(len(ids), np.inf)
        np.minimum.at(least, at, low)
        up = np.where(np.isfinite(low), low, 0) - np.where(np.isfinite(low), least[at], 0)
        moved, add = np.exp(-precision * up), lambda v: np.bincount(at, v, len(ids))
        return pa.table({"id": ids, "lowest": least, "z": add(z * moved), "u": add((u + z * up) * moved), "s": add(s)})

    parts = block_pairs(points, points, ["x"] if kernel is None else ["x", "y"], sums, "id long, lowest double, z double, u double, s double", fold=fold, apart=closely)
    parts = parts.withColumn("lowest", F.when(F.col("lowest") < float("inf"), F.col("lowest")))
    parts = parts.withColumn("least", F.min("lowest").over(Window.partitionBy("id")))
    up = F.coalesce(F.col("lowest") - F.col("least"), F.lit(0.0))
    moved = F.exp(-precision * up)
    total = parts.groupBy("id").agg(F.coalesce(F.min("least"), F.lit(0.0)).alias("least"), F.sum(F.col("z") * moved).alias("z"), F.sum((F.col("u") + F.col("z") * up) * moved).alias("u"), F.sum("s").alias("s"))
    return total.select("id", "least", "z", "u", "s")


def entropy_of_points(points: DataFrame, precision: float) -> DataFrame:
    """j, entropy: what entropy gives of the softmax of halved squared distances, without a row a pair (null: no other point)."""
    z = F.col("z")
    return softmax_sums(points, precision).select(F.col("id").alias("j"), F.when(z > 0, F.log(z) + precision * F.col("u") / z).alias("entropy"))


def one_way(h: np.ndarray, least: np.ndarray, z: np.ndarray, precision: float) -> tuple[np.ndarray, np.ndarray]:
    """Softmax and its logarithm of halved squared distances, by the sums of their sources (in shapes that meet h's)."""
    lp = (precision * least - np.log(z)) - precision * h
    if h.min(initial=np.inf) <= NEGLIGIBLE:
        lp = np.where(h <= NEGLIGIBLE, LOG_ZERO - np.log(z), lp)
    return np.exp(lp), lp


def both_ways(dx: np.ndarray, of_j: np.ndarray, of_i: np.ndarray, precision: float, n: int) -> np.ndarray:
    """The symmetrized softmax; of_j, of_i: least and z of both ends."""
    h = dx / 2
    return (one_way(h, of_j[:, :1], of_j[:, 1:2], precision)[0] + one_way(h, of_i[:, 0], of_i[:, 1], precision)[0]) / (2 * n)


def symmetrized_of_points(points: DataFrame, precision: float) -> DataFrame:
    """j, i, p of pairs with j < i: what symmetrized gives of the softmax of points (id, x). Pairs are made where they leave."""
    per = written(softmax_sums(points, precision), "sums")
    n = max(1, per.count())

    def emit(j, i, dx, of_j, of_i):
        a, b = np.nonzero(j[:, None] < i)
        return pa.table({"j": j[a], "i": i[b], "p": both_ways(dx, of_j, of_i, precision, n)[a, b]})

    points = points.select("id", "x").join(per.select("id", F.array("least", "z").alias("about")), "id")
    return block_pairs(points, points, ["x"], emit, "j long, i long, p double", carried=("about",), apart=closely)


def multiscale_of_points(points: DataFrame, precisions: list[float], weights: list[float] | None = None, floor: float = FLOOR_WIDE) -> DataFrame:
    """j, i, p, lp of different points: what multiscale gives of points (id, x). Pairs are made where they leave."""
    weights, per = weights or [1 / len(precisions)] * len(precisions), None
    for k, precision in enumerate(precisions):
        sums = softmax_sums(points, precision).select("id", *(["least"] if k == 0 else []), F.col("z").alias(f"z{k}"))
        per = sums if per is None else per.join(sums, "id")
    per = written(per, "sums").select("id", F.array("least", *[f"z{k}" for k in range(len(precisions))]).alias("about"))

    def emit(j, i, dx, of_j, of_i):  # noqa: ARG001
        h = dx / 2
        over, p = h - of_j[:, :1], np.zeros_like(h)
        with np.errstate(all="ignore"):  # of copies of one point alone
            for k, (precision, weight) in enumerate(zip(precisions, weights, strict=True)):
                p += weight * np.exp(-precision * over) / of_j[:, k + 1 : k + 2]
        p[h <= NEGLIGIBLE] = 0
        a, b = np.nonzero(j[:, None] != i)
        p = p[a, b]
        return pa.table({"j": j[a], "i": i[b], "p": p, "lp": np.log(np.maximum(floor, p))})

    both = points.select("id", "x").join(per, "id")
    return block_pairs(both, both, ["x"], emit, "j long, i long, p double, lp double", carried=("about",), apart=closely)


def divergences_of_points(points: DataFrame, px: float, py: float, kappa: float, beta: float, alpha: float) -> DataFrame:
    """j, div: what divergences gives of the softmax of x at precision px and that of y at py, for points (id, x, y). Sources' sums
    and divergences are both made by pairs of blocks; a row a source leaves them."""
    sums = lambda c, p, k: softmax_sums(points.select("id", F.col(c).alias("x")), p).select("id", F.col("least").alias(f"l{k}"), F.col("z").alias(f"z{k}"))
    per = written(sums("x", px, 1).join(sums("y", py, 2), "id"), "sums").select("id", F.array("l1", "z1", "l2", "z2").alias("about"))
    pointwise = compile(divergence(kappa, beta, alpha)[1], "divergence", "eval")  # plain arithmetic, in SQL and in Python
    known = {"exp": np.exp, "ln": np.log, "abs": np.abs, "greatest": np.maximum}

    def emit(j, i, dx, dy, of_j, of_i):  # noqa: ARG001
        with np.errstate(all="ignore"):  # of a point and itself
            p, lp = one_way(dx / 2, of_j[:, :1], of_j[:, 1:2], px)
            q, lq = one_way(dy / 2, of_j[:, 2:3], of_j[:, 3:], py)
            div = eval(pointwise, {"__builtins__": {}}, {**known, "p": p, "lp": lp, "q": q, "lq": lq})
        if not np.isin(j, i).any():
            return pa.table({"j": j, "div": div.sum(1)})
        other = j[:, None] != i
        some = other.any(1)
        return pa.table({"j": j[some], "div": np.where(other, div, 0).sum(1)[some]})

    both = points.select("id", "x", "y").join(per, "id")
    return block_pairs(both, both, ["x", "y"], emit, "j long, div double", carried=("about",), fold=summed("j", "div"), apart=closely).groupBy("j").agg(F.sum("div").alias("div"))


def joint_terms(points: DataFrame, precision: float, dof: float = 1.0, eps: float = 2.2e-16) -> DataFrame:
    """id, kl, g of points (id, x, y): each source's part of what kl gives of the symmetrized softmax of x (at one precision) and the
    student_joint of y, and what gradient gives of them. Sources' sums and terms are both made by pairs of blocks; no pair is
    shuffled."""
    tail = (dof + 1) / 2
    per = written(softmax_sums(points, precision, lambda dy: (1 + dy / dof) ** -tail), "sums")
    total = per.agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")).first()
    n, z = max(1, total.n), total.s or 1.0
    dims = points.agg(F.max(F.size("y"))).first()[0] or 0
    names = [f"g{k}" for k in range(dims)]

    def terms(j, i, dx, dy, yj, of_j, yi, of_i):
        other, p, a = j[:, None] != i, both_ways(dx, of_j, of_i, precision, n), 1 + dy / dof
        s = a**-tail
        kl_ = p * (np.log(p + eps) + tail * np.log(a) + math.log(z))
        w = np.where(other, (p - s / z) * s * (4.0 / dof), 0)
        return pa.table({"id": j, "kl": np.where(other, kl_, 0).sum(1), **{g: (w * (yj[:, k, None] - yi[None, :, k])).sum(1) for k, g in enumerate(names)}})

    points = points.select("id", "x", "y").join(per.select("id", F.array("least", "z").alias("about")), "id")
    spec = ", ".join(["id long, kl double", *(f"{g} double" for g in names)])
    parts = block_pairs(points, points, ["x", "y"], terms, spec, carried=("y", "about"), fold=summed("id", "kl", *names), apart=closely)
    return parts.groupBy("id").agg(F.sum("kl").alias("kl"), F.array(*[F.sum(g) for g in names]).alias("g"))


def kl_of_points(points: DataFrame, precision: float, dof: float = 1.0, eps: float = 2.2e-16) -> DataFrame:
    """One row, kl: what kl gives of the symmetrized softmax of x (at one precision) and the student_joint of y, for points (id,
    x, y)."""
    return joint_terms(points, precision, dof, eps).agg(F.sum("kl").alias("kl"))


def student_joint(dist: DataFrame, dof: float = 1.0) -> DataFrame:
    """j, i, s, q, lq: the embedding's kernel, normalized over all pairs; the total is one number."""
    a = dist.where("i <> j").select("j", "i", (1 + F.col("d2") / dof).alias("a")).withColumn("s", F.pow("a", F.lit(-(dof + 1) / 2)))
    total = a.agg(F.sum("s").alias("z"))
    return a.join(F.broadcast(total)).select("j", "i", "s", (F.col("s") / F.col("z")).alias("q"), (F.lit(-(1 + dof) / 2) * F.log("a") - F.log("z")).alias("lq"))


def gradient(p: DataFrame, q: DataFrame, y: DataFrame, dof: float = 1.0, exaggeration: float = 1.0) -> DataFrame:
    """id, g array<double>: 4 sum_i (EE p - q) s (y_j - y_i) / dof, without the step's scaling."""
    w = p.join(q, ["j", "i"]).select("j", "i", ((exaggeration * F.col("p") - F.col("q")) * F.col("s") * (4.0 / dof)).alias("w"))
    at = w.join(y.select(F.col("id").alias("j"), F.col("y").alias("yj")), "j").join(y.select(F.col("id").alias("i"), F.col("y").alias("yi")), "i")
    parts = at.select("j", "w", F.posexplode(F.zip_with("yj", "yi", lambda a, b: a - b)).alias("d", "v"))
    return parts.groupBy("j", "d").agg(F.sum(F.col("w") * F.col("v")).alias("g")).groupBy(F.col("j").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "g"))), lambda s: s["g"]).alias("g"))


# Entropy equalization: each column's Newton iteration runs on its own, but all stop together, at the first iteration where
# every column is within the tolerance. So each column's path is computed in its task, the stop is one aggregate, and the
# precision is read off the path there.


def _entropy_step(h: np.ndarray, none: np.ndarray, px: float, kind: str, dof: float, mvr: float):
    if kind == "softmax":
        l = -px * (h - h[~none].min(initial=np.inf))  # noqa: E741
        slope_of = h
    else:
        t = np.log1p(2 / dof * px * h)
        l = -(dof + mvr) / 2 * (t - t[~none].min(initial=np.inf))  # noqa: E741
        slope_of = (dof + mvr) / dof * h / (1 + 2 / dof * px * h)
    l = np.where(none, LOG_ZERO, l)  # noqa: E741
    s = np.exp(l)
    z = s.sum()
    p, lp = s / z, l - np.log(z)
    return -(p * lp).sum(), (p * (1 + lp) * (slope_of - (p * slope_of).sum())).sum()


def equalize(h: DataFrame, perplexity: float, iterations: int = 100, start: DataFrame | None = None, kind: str = "softmax", dof: float = 1.0, mvr: float = 1.0, scaled_start: bool = True) -> DataFrame:
    """j, px, entropy, reached: whether the entropy is the target's within a thousandth; of columns that can't reach it (fewer
    neighbours than the perplexity, tails too heavy) the last of the iterations is returned. start: j, px to begin with (default:
    from the distances; scaled_start keeps the first guess positive)."""
    target = math.log(abs(perplexity))
    rows = h.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("c")).select("j", F.transform("c", lambda s: s["i"]).alias("is"), F.transform("c", lambda s: s["h"]).alias("hs"))
    rows = rows.join(start.select("j", F.col("px").alias("px0")), "j", "left") if start is not None else rows.withColumn("px0", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for j, ids, hs, px in zip(*(b.column(c).to_pylist() for c in ("j", "is", "hs", "px0")), strict=True):
                h_, ids = np.array(hs), np.array(ids)
                none = np.abs(h_) <= NEGLIGIBLE if kind == "softmax" else ids == j
                if px is None:
                    n, least = len(h_), h_[~none].min(initial=np.inf)
                    px = 10 / h_.max(initial=1e-300) if kind == "student" else 1 / ((n / (n - 1) if scaled_start and n > 1 else 1) * h_.mean() - least) if np.isfinite(least) else 1.0
                path = []
                for _ in range(iterations):
                    e, slope = _entropy_step(h_, none, px, kind, dof, mvr)
                    path.append((px, e))
                    if abs(e - target) < 1e-13 or slope == 0:
                        break
                    px -= max(-px / 2, min(px / 2, (e - target) / slope))
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[x for x, _ in p] for p in paths], pa.list_(pa.float64())), pa.array([[e for _, e in p] for p in paths], pa.list_(pa.float64()))], names=["j", "pxs", "es"])

    paths = written(rows.mapInArrow(run, "j long, pxs array<double>, es array<double>"), "paths")
    return stopped(paths, target, iterations)


def stopped(paths: DataFrame, target: float, iterations: int) -> DataFrame:
    """j, px, entropy, reached, read off the paths (j, pxs, es) where all columns are within the tolerance."""
    at = lambda c: F.get(c, F.least(F.col("t"), F.size(c) - 1))
    far = paths.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).groupBy("t").agg(F.max(F.abs(at("es") - target)).alias("worst"))
    stop = far.where(F.col("worst") < 1e-3 * abs(target)).agg(F.min("t").alias("t")).first().t
    t = F.lit(iterations - 1 if stop is None else stop)
    pick = lambda c: F.get(c, F.least(t, F.size(c) - 1))
    return paths.select("j", pick("pxs").alias("px"), pick("es").alias("entropy"), (F.abs(pick("es") - target) < 1e-3 * abs(target)).alias("reached"))


def equalize_points(points: DataFrame, perplexity: float, iterations: int = 100, kind: str = "softmax", dof: float = 1.0, mvr: float = 1.0, start: DataFrame | None = None, cells: int = 1_000_000) -> DataFrame:
    """What equalize gives of the halved squared distances of points (id, x), without a table of them: the task that makes a source's
    distances goes through its steps, and its path leaves it. A path ends where steps do no more than rounding does."""
    target, given = math.log(abs(perplexity)), start is not None
    points = points.select("id", "x")
    if given:
        points = points.join(start.select(F.col("j").alias("id"), F.array("px").alias("px0")), "id")

    def emit(j, i, own, x):
        h = np.empty((len(j), len(i)))
        for k in range(0, len(i), RANKED):
            h[:, k : k + RANKED] = closely(own[0], x[0][k : k + RANKED].astype(float))
        h /= 2
        none = h <= NEGLIGIBLE if kind == "softmax" else j[:, None] == i
        n, mean, top = h.shape[1], h.mean(1), h.max(1)
        least = np.where(none, np.inf, h).min(1)
        low = np.where(np.isfinite(least), least, 0)
        if given:
            px = own[1][:, 0].copy()
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                px = 10 / np.maximum(top, 1e-300) if kind == "student" else 1 / ((n / (n - 1) if n > 1 else 1) * mean - least)
            px = np.where(np.isfinite(least), px, 1.0)
        over = h - low[:, None]
        if kind == "softmax":
            over[none] = FAR
        pxs, es, on, before = [[] for _ in j], [[] for _ in j], np.arange(len(j)), np.full(len(j), np.inf)
        for _ in range(iterations):
            v, q, base = (over, none, low) if len(on) == len(j) else (over[on], none[on], low[on])
            some = px[on]
            if kind == "softmax":  # of l = -px v: entropy log z + px u / z, slope -px (w / z - (u / z)²)
                e = np.exp(v * -some[:, None])
                z = e.sum(1)
                e *= v
                u, w = e.sum(1), np.einsum("ab,ab->a", e, v)
                with np.errstate(divide="ignore", invalid="ignore"):
                    entropies, slope = np.log(z) + some * u / z, -some * (w / z - (u / z) ** 2)
                none_left = z == 0  # copies of one point alone: all weigh the same
                entropies, slope = np.where(none_left, math.log(max(n, 1)), entropies), np.where(none_left, 0.0, slope)
            else:
                scaled = (2 / dof * some)[:, None] * (v + base[:, None])
                l = -(dof + mvr) / 2 * (np.log1p(scaled) - np.log1p(2 / dof * some * base)[:, None])  # noqa: E741
                l[q] = LOG_ZERO
                g = (dof + mvr) / dof * (v + base[:, None]) / (1 + scaled)
                e = np.exp(l)
                z, a, m = e.sum(1), np.einsum("ab,ab->a", e, l), np.einsum("ab,ab->a", e, g)
                e *= l
                with np.errstate(divide="ignore", invalid="ignore"):
                    entropies, slope = np.log(z) - a / z, np.einsum("ab,ab->a", e, g) / z - m / z * (a / z)
                entropies, slope = np.where(z > 0, entropies, 0.0), np.where(z > 0, slope, 0.0)
            off = entropies - target
            for r, at, entropy_ in zip(on, some, entropies, strict=True):
                pxs[r].append(at)
                es[r].append(entropy_)
            rests = (np.abs(off) < 1e-13) | (slope == 0) | ((np.abs(off) < 1e-9) & (np.abs(off) >= before[on] / 2))
            before[on] = np.abs(off)
            px[on] = some - np.clip(off / np.where(slope == 0, np.inf, slope), -some / 2, some / 2)
            on = on[~rests]
            if not len(on):
                break
        return pa.table({"j": j, "pxs": pa.array(pxs, pa.list_(pa.float64())), "es": pa.array(es, pa.list_(pa.float64()))})

    paths = beside_all(points, None, ["x", "px0"] if given else ["x"], emit, "j long, pxs array<double>, es array<double>", cells=cells)
    return stopped(written(paths, "paths"), target, iterations)


def levels(n: int, perplexity: float, power: float = 1.0) -> list[float]:
    """Perplexities of the scales, coarse to fine."""
    p = max(2.0, abs(perplexity))
    count = max(1, round(math.log2(n / p) / power))
    return [p * (2**power) ** k for k in range(count - 1, -1, -1)]


def multi_equalize(h: DataFrame, n: int, perplexity: float, multi: bool = True, power: float = 1.0, kind: str = "softmax", dof: float = 1.0, mvr: float = 1.0) -> DataFrame:
    """scale (1: the coarsest), perplexity, j, px, entropy, reached; each scale starts from the one before, and from the third on from its last ratio."""
    return _by_levels(lambda p, start: equalize(h, p, start=start, kind=kind, dof=dof, mvr=mvr), n, perplexity, multi, power)


def multi_equalize_points(points: DataFrame, perplexity: float, multi: bool = True, power: float = 1.0, kind: str = "softmax", dof: float = 1.0, mvr: float = 1.0) -> DataFrame:
    """The same of points (id, x), without a table of their distances."""
    return _by_levels(lambda p, start: written(equalize_points(points, p, kind=kind, dof=dof, mvr=mvr, start=start), "level"), points.count(), perplexity, multi, power)


def _by_levels(make: Callable[[float, DataFrame | None], DataFrame], n: int, perplexity: float, multi: bool, power: float) -> DataFrame:
    out, before, start = None, None, None
    for k, p in enumerate(levels(n, perplexity, power) if multi else [max(2.0, abs(perplexity))]):
        got = make(p, start)
        rows = got.select(F.lit(k + 1).alias("scale"), F.lit(float(p)).alias("perplexity"), "j", "px", "entropy", "reached")
        out = rows if out is None else out.unionByName(rows)
        if before is not None and k >= 2:
            start = got.select("j", "px").join(before.select("j", F.col("px").alias("b")), "j").select("j", (F.col("px") * F.col("px") / F.col("b")).alias("px"))
        else:
            start = got.select("j", "px")
        before = got.select("j", "px")
    return out


def intrinsic_dimension(prec: DataFrame) -> DataFrame:
    """One row: small, mid and large of 2 / (log2 px of the next finer scale - log2 px), by means over points."""
    nxt = F.lead("px").over(Window.partitionBy("j").orderBy("scale"))
    dy = prec.withColumn("dy", 2 / (F.log2(nxt) - F.log2("px"))).where("dy is not null").groupBy("scale").agg(F.avg("dy").alias("dy"))
    return dy.agg(F.max(F.struct("scale", "dy"))["dy"].alias("small"), F.max("dy").alias("mid"), F.min(F.struct("scale", "dy"))["dy"].alias("large"))


def approximately(u: float, v: float, e: float = 1e-2) -> bool:
    return abs(u - v) < e


def divergence(kappa: float, beta: float, alpha: float) -> tuple[str, str]:
    """Name and SQL of the pointwise divergence of similarities p, q with logarithms lp, lq (columns of the embedding: q).

    The mixtures of alpha-beta divergences of the literature: b_(a,b)(u, v) with the limits at 0, taken both ways with weights
    1 - k and k (type 1), or of each to their mixture z (type 2, 0 < k < 1); a = b is a squared difference of powers.
    """
    k, b, a = abs(kappa), beta, alpha
    power = lambda c, l: l[1:] if c == 1 and l in ("lp", "lq") else f"exp({c:.17g} * {l})"  # noqa: E731, E741

    def one_way(u: str, v: str, a: float, b: float) -> str:
        """From u to v, both given as logarithms."""
        if b == 0:
            return f"({power(a, v)} - {power(a, u)} + {a:.17g} * {power(a, u)} * ({u} - {v})) / {a * a:.17g}"
        if a == 0:
            return f"({power(b, u)} - {power(b, v)} + {b:.17g} * {power(b, v)} * ({v} - {u})) / {b * b:.17g}"
        if a == -b:
            return f"({a:.17g} * ({v} - {u}) + {power(a, f'({u} - {v})')} - 1) / {a * a:.17g}"
        return f"({a:.17g} * {power(a + b, u)} + {b:.17g} * {power(a + b, v)} - {a + b:.17g} * {power(a, u)} * {power(b, v)}) / {a * b * (a + b):.17g}"

    if approximately(a, b):
        if approximately(a, 0):
            return "E0 sym", "(lq - lp) * (lq - lp) / 2"
        if approximately(a, 0.5):
            return "E.5 sym", "2 * abs(p - q)"
        if approximately(a, 1):
            return "E1 sym", "(q - p) * (q - p) / 2"
        return "Ea sym", f"({power(a, 'lq')} - {power(a, 'lp')}) * ({power(a, 'lq')} - {power(a, 'lp')}) / {2 * a * a:.17g}"
    zero_b, zero_a, opposite = approximately(b, 0), approximately(a, 0), approximately(a, -b)
    if 0 < kappa < 1:
        mixed = f"({1 - k:.17g} * {power(a, 'lq')} + {k:.17g} * {power(a, 'lp')})"
        lz = f"(ln(greatest(3e-324, {mixed})) / {a:.17g})"
        ends = lambda f: f"({1 / k:.17g} * {f('lq')} + {1 / (1 - k):.17g} * {f('lp')} - {1 / k / (1 - k):.17g} * {f(lz)})"
        if zero_b:
            return ("JS1 t2" if approximately(a, 1) else "JSa t2"), f"{ends(lambda x: f'{power(a, x)} * {x}')} / {a:.17g}"
        if opposite:
            return "ISa t2", f"({1 / k / (1 - k):.17g} * {lz} - {1 / k:.17g} * lq - {1 / (1 - k):.17g} * lp) / {a:.17g}"
        return "AB t2", f"{ends(lambda x: power(a + b, x))} / {b * (a + b):.17g}"
    if zero_b:
        b, name = 0.0, "gKL1 t1" if approximately(a, 1) else "gKLa t1"
    elif zero_a:
        a, name = 0.0, "gLK1 t1" if approximately(b, 1) else "gLKb t1"
    else:
        name = "ISa t1" if opposite else "AB t1"
        b = -a if opposite else b
    ways = [f"{w:.17g} * ({one_way(u, v, a, b)})" for w, u, v in ((1 - k, "lp", "lq"), (k, "lq", "lp")) if w]  # one of no weight isn't worked out
    return name, " + ".join(ways)


#: One choice of (kappa, beta, alpha) for each branch.
BRANCHES = {
    "e0": (0.0, 0.0, 0.0), "hellinger": (0.0, 0.5, 0.5), "e1": (0.0, 1.0, 1.0), "ea": (0.0, 0.25, 0.25),
    "js1_t2": (0.5, 0.0, 1.0), "jsa_t2": (0.5, 0.0, 0.5), "isa_t2": (0.3, -0.5, 0.5), "ab_t2": (0.3, 0.25, 0.5),
    "gkl1_t1": (0.0, 0.0, 1.0), "gkla_t1": (-0.25, 0.0, 0.5), "glk1_t1": (0.0, 1.0, 0.0), "glkb_t1": (-0.25, 0.5, 0.0),
    "isa_t1": (-0.25, -0.5, 0.5), "ab_t1": (-0.25, 0.25, 0.5),
}


def divergences(p: DataFrame, q: DataFrame, kappa: float, beta: float, alpha: float) -> DataFrame:
    """j, div: the divergence summed over each column's pairs."""
    both = p.where("i <> j").select("j", "i", "p", "lp").join(q.select("j", "i", F.col("p").alias("q"), F.col("lp").alias("lq")), ["j", "i"])
    return both.groupBy("j").agg(F.sum(F.expr(divergence(kappa, beta, alpha)[1])).alias("div"))
