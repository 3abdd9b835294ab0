"""Comparison of embeddings over a grid of perplexities, starts and repetitions, and the scores of all of them.

Methods: 'random' (t-SNE from random points, another seed in each repetition), 'pca' (from two principal components, of another
spread in each), 'coarse_to_fine' and 'multi_scale', which have no chance in them and are run once for each perplexity, or once.
Runs of t-SNE are groups of one job for each perplexity and go in parallel. Above ``most`` points t-SNE takes near pairs only,
whose similarities are made once for each perplexity, and the two methods that keep all pairs of a run in its task are left out.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from . import embed, linalg, tree
from .quality import LANDMARKS, over_samples, scores, summary

PERPLEXITIES = (5, 25, 125)
#: Norms of the principal components that t-SNE starts from, by repetition.
SPREADS = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
COLUMNS = ["method", "perplexity", "sample", "id", "y", "kl", "seconds"]


def starts(points: DataFrame, repetitions: int) -> DataFrame:
    """method, sample, id, y."""
    plane, made = written(linalg.pca(points, 2), "plane"), []
    for k in range(repetitions):
        made.append(linalg.random_init(points, seed=k).select(F.lit("random").alias("method"), F.lit(k + 1).alias("sample"), "id", "y"))
        made.append(linalg.scaled(plane, SPREADS[k % len(SPREADS)]).select(F.lit("pca").alias("method"), F.lit(k + 1).alias("sample"), "id", "y"))
    return written(reduce(DataFrame.unionByName, made), "starts")


def grid(points: DataFrame, perplexities: tuple[float, ...] = PERPLEXITIES, repetitions: int = 5, iterations: int = 1000, most: int = LANDMARKS) -> DataFrame:
    """method, perplexity (null: the method has none), sample, id, y, kl, seconds (of the job that made the run, with all others of
    the same job; a run's own share of a busy cluster is no figure of its own). points: id, x."""
    points = written(linalg.center(points).select("id", "x"), "points")
    start, many, made = starts(points, repetitions), points.count() > most, []

    def keep(run: DataFrame, method, perplexity: float | None, sample) -> None:
        began = time.time()
        table = written(run.select(method.alias("method"), F.lit(perplexity).cast("double").alias("perplexity"), sample.cast("int").alias("sample"), "id", "y", "kl"), "runs")
        made.append(table.withColumn("seconds", F.lit(time.time() - began)))

    nodes = None if many else tree.tree(embed.reduced(points), "kd")
    for perplexity in perplexities:
        if many:
            pairs = written(embed.near_similarities(points, perplexity), "near")
            for r in start.select("method", "sample").distinct().orderBy("method", "sample").collect():
                one = start.where((F.col("method") == r.method) & (F.col("sample") == r["sample"]))
                keep(embed.tsne_large(points, perplexity, iterations, start=one, pairs=pairs), F.lit(r.method), perplexity, F.lit(r["sample"]))
        else:
            named = start.select(F.concat_ws(":", "method", "sample").alias("run"), "id", "y")
            keep(embed.tsne(points, perplexity, iterations, start=named), F.split_part("run", F.lit(":"), F.lit(1)), perplexity, F.split_part("run", F.lit(":"), F.lit(2)))
            keep(embed.coarse_to_fine(points, *nodes, perplexity, iterations), F.lit("coarse_to_fine"), perplexity, F.lit(1))
    if not many:
        keep(embed.multi_scale(points), F.lit("multi_scale"), None, F.lit(1))
    return reduce(DataFrame.unionByName, made).select(*COLUMNS)


def named(runs: DataFrame) -> DataFrame:
    """method with the perplexity in its name, as scores take it: 'random/25', 'multi_scale'."""
    return runs.withColumn("method", F.concat_ws("/", "method", F.col("perplexity").cast("long").cast("string")))


def compare(points: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curves over samples (view, method, K, mean, least, largest; methods as in ``named``) and method, samples, and of the areas
    q_auc, b_auc, r_auc and of k_avg the mean and standard deviation (0 of one sample)."""
    every = written(scores(points.select(F.lit("points").alias("view"), "id", "x"), named(runs)), "curves")
    each = summary(every, ["method", "sample"])
    measures = ("q_auc", "b_auc", "r_auc", "k_avg")
    return over_samples(every), each.groupBy("method").agg(F.count(F.lit(1)).alias("samples"), *[g for c in measures for g in (F.avg(c).alias(c), F.stddev_pop(c).alias(f"{c}_sd"))])
