"""Path tables that are kept up when links are added, in place of being made anew.

A path over a new link u -> v is a path to u, the link and a path from v. So a round joins the links with the paths that end in u and
those that begin in v, keeps what is shorter than what the table has, and replaces those pairs alone. Paths over several links come
from further rounds, in which one of the two parts must have changed in the round before; rounds end when nothing gets shorter. Pairs whose
paths stay as they are never join anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

PATHS = ["j", "i", "d", "hops", "pred"]
#: Sums of the same edges in another order differ by less than this share; such lengths are equal.
SAME = 1e-12


def better(a: str, b: str):
    """Is path a shorter than b, or as long with fewer hops, or those with the smaller vertex before the end?"""
    near = F.abs(F.col(f"{a}.d") - F.col(f"{b}.d")) <= SAME * F.greatest(F.col(f"{a}.d"), F.col(f"{b}.d"))
    fewer = (F.col(f"{a}.hops") < F.col(f"{b}.hops")) | ((F.col(f"{a}.hops") == F.col(f"{b}.hops")) & (F.col(f"{a}.pred") < F.col(f"{b}.pred")))
    return F.col(b).isNull() | F.when(near, fewer).otherwise(F.col(f"{a}.d") < F.col(f"{b}.d"))


def with_links(paths: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """paths (j, i, d, hops, pred of all reachable pairs) with links (j, i, d; one direction each) added, and how many rows were
    put in or replaced, each time counted."""
    kept = paths.select(*PATHS)
    added = written(links.where("j <> i").groupBy(F.col("j").alias("u"), F.col("i").alias("v")).agg(F.min("d").alias("w")), "new-links")
    at_ends = added.select(F.col("u").alias("p")).unionByName(added.select(F.col("v").alias("p"))).distinct()
    still = at_ends.select(F.col("p").alias("j"), F.col("p").alias("i"), F.lit(0.0).alias("d"), F.lit(0).alias("hops"), F.col("p").alias("pred"))
    fresh, touched, turn = None, 0, 0
    while True:
        every = kept.unionByName(still)

        def over(to_u: DataFrame, from_v: DataFrame) -> DataFrame:
            into = to_u.select("j", F.col("i").alias("u"), F.col("d").alias("d1"), F.col("hops").alias("h1"))
            out_of = from_v.select(F.col("j").alias("v"), "i", F.col("d").alias("d2"), F.col("hops").alias("h2"), F.col("pred").alias("p2"))
            met = added.join(into, "u").join(out_of, "v").where("j <> i")
            return met.select("j", "i", (F.col("d1") + F.col("w") + F.col("d2")).alias("d"), (F.col("h1") + 1 + F.col("h2")).cast("int").alias("hops"), F.when(F.col("h2") > 0, F.col("p2")).otherwise(F.col("u")).alias("pred"))

        made = over(every, every) if fresh is None else over(fresh, every).unionByName(over(every, fresh))
        best = made.groupBy("j", "i").agg(F.min(F.struct("d", "hops", "pred")).alias("new"))
        old = kept.select("j", "i", F.struct("d", "hops", "pred").alias("old"))
        turn += 1
        fresh = written(best.join(old, ["j", "i"], "left").where(better("new", "old")).select("j", "i", "new.*"), f"shorter-{turn}")
        n = fresh.count()
        if not n:
            return kept, touched
        touched += n
        kept = written(kept.join(fresh.select("j", "i"), ["j", "i"], "left_anti").unionByName(fresh), f"paths-{turn}")


def connected_paths(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Edges with the nearest links of components added until one is left, the table of their shortest paths, kept up from round
    to round, and how many of its rows that touched."""
    from .cells import nearest_links
    from .graph import components, shortest_paths

    paths, touched = written(shortest_paths(edges), "paths-0"), 0
    while True:
        of = written(components(points, edges), "components")
        if of.select("component").distinct().limit(2).count() <= 1:
            return edges, paths, touched
        link = nearest_links(points, of).select("j", "i", "d")
        link = written(link.unionByName(link.select(F.col("i").alias("j"), F.col("j").alias("i"), "d")).distinct(), "links")
        paths, n = with_links(paths, link)
        edges, touched = written(edges.select("j", "i", "d").unionByName(link).distinct(), "linked"), touched + n
