"""Queries of the operators that leave no group, node or table of pairs to one task. Where they give what an operator of ``queries`` gives,
their twins are the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import distance as D
from ..operators import graph as G
from ..operators import linalg as L
from ..operators import neighbors as A
from ..operators import quadtree as B
from ..operators import select as R
from ..operators import spectral as W
from ..operators import tree as T
from ..operators import upkeep as U
from ..sources import matrices
from ..sources import points as S
from .lineage import place, written
from .queries import COMPONENTS, DEPTH, MEMBERS, PAIRS, POINTS, STATS, load, query, r6, tree_sql

NEAR = 6


@query()
def approx_knn(spark, sf_dir):
    """No SQL states an approximation: tests hold it against the exact graph, and approx_knn_recall counts."""
    return A.approx_knn(load(spark, sf_dir), NEAR).select("j", "i", r6("d", "d"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {POINTS} SELECT count(*) * {NEAR} AS asked, true AS enough FROM p WHERE id % 20 = 0")
def approx_knn_recall(spark, sf_dir):
    """Of the exact neighbours of every twentieth point, are nine tenths found?"""
    p = load(spark, sf_dir)
    told = A.recall(A.approx_knn(p, NEAR), p, p.where("id % 20 = 0"), NEAR)
    return told.select("asked", (F.col("found") >= 0.9 * F.col("asked")).alias("enough"))


@query(f"WITH {PAIRS} SELECT j, i, round(sqrt(d2), 6) AS d FROM d WHERE sqrt(d2) <= 1.2 AND j <> i")
def eps_graph_pruned(spark, sf_dir):
    return C.radius_join(load(spark, sf_dir), 1.2).select("j", "i", r6("d", "d"))


def parts(spark, sf_dir):
    """Two-dimensional points with many ties."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("price", F.col("p_retailprice") / 20)
    return S.from_columns(rows, "p_partkey", ["p_size", "price"])


PART_PAIRS = "q AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS u, p_retailprice / 20 AS w FROM part), e AS (SELECT a.id AS j, b.id AS i, sqrt((a.u - b.u) * (a.u - b.u) + (a.w - b.w) * (a.w - b.w)) AS d FROM q a JOIN q b ON abs(a.u - b.u) <= 1 AND a.id <> b.id)"


@query(f"WITH {PART_PAIRS} SELECT j, i, round(d, 6) AS d FROM e WHERE d <= 1")
def eps_graph_parts(spark, sf_dir):
    return C.radius_join(parts(spark, sf_dir), 1.0).select("j", "i", r6("d", "d"))


@query("SELECT count(*) * (count(*) - 1) // 2 AS pairs, true AS pruned FROM part")
def eps_graph_work(spark, sf_dir):
    """Is at most a tenth of all pairs of parts worked out?"""
    return C.radius_work(parts(spark, sf_dir), 1.0, 128, 16).select("pairs", (10 * F.col("compared") <= F.col("pairs")).alias("pruned"))


@query(f"""{COMPONENTS}, l AS (SELECT a.component AS cj, b.component AS ci, sqrt(d2) AS d, j, i FROM d JOIN f a ON a.id = j JOIN f b ON b.id = i WHERE a.component <> b.component)
    SELECT cj, ci, j, i, round(d, 6) AS d FROM l QUALIFY row_number() OVER (PARTITION BY cj ORDER BY l.d, ci, j, i) = 1""")
def component_links_pruned(spark, sf_dir):
    p = load(spark, sf_dir)
    of = written(G.components(p, D.knn_graph(p, 1)), "components")
    return C.nearest_links(p, of).select("cj", "ci", "j", "i", r6("d", "d"))


@query(tree_sql("kd", MEMBERS))
def kd_tree_levels(spark, sf_dir):
    """All levels split by distributed selection."""
    return T.tree(load(spark, sf_dir), "kd", DEPTH, task_rows=1)[0]


@query(tree_sql("vp", STATS.replace(", CAST(any_value(w) AS INTEGER) AS split_dim", ""), farthest=(0, 2, 4)))
def vp_tree_levels_stats(spark, sf_dir):
    nodes = T.tree(load(spark, sf_dir), "vp", DEPTH, farthest_levels=(0, 2, 4), task_rows=1)[1]
    return nodes.select("level", "node", "n", "center_id", "vp_id", *[r6(c, c) for c in ("q1", "med", "q3", "maxd")])


@query("""WITH l AS (SELECT ascii(l_returnflag) AS node, l_extendedprice AS v, l_orderkey * 8 + l_linenumber AS id FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY v, id) AS rank, count(*) OVER (PARTITION BY node) AS n FROM l)
    SELECT CAST(node AS BIGINT) AS node, rank, v, id FROM r WHERE rank IN (1, n // 4 + 1, n // 2 + 1, n)""")
def ranked_values(spark, sf_dir):
    """Order statistics of the prices of lineitem by return flag: three groups that each hold much of the table."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.ascii("l_returnflag").cast("long").alias("node"), F.col("l_extendedprice").cast("double").alias("v"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    quarter = lambda k: F.floor(F.col("n") / k) + 1
    ranks = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).select("node", F.explode(F.array(F.lit(1).cast("long"), quarter(4), quarter(2), F.col("n"))).alias("rank"))
    return R.order_statistics(rows, ranks)


LENGTHS = f"WITH {POINTS}, m AS (SELECT list(a ORDER BY d) AS m FROM (SELECT d, avg(v) AS a FROM (SELECT generate_subscripts(x, 1) AS d, unnest(x) AS v FROM p) GROUP BY d)) SELECT id, round(list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS length2 FROM p, m"


def lengths(y):
    return y.select("id", r6(F.aggregate("y", F.lit(0.0), lambda a, c: a + c * c), "length2"))


@query(LENGTHS)
def pcoa_blocks(spark, sf_dir):
    """At full rank a point lies as far from 0 as it did from the centre."""
    return lengths(W.scaled_points(load(spark, sf_dir), 64))


@query(LENGTHS)
def pca_wide(spark, sf_dir):
    return lengths(W.leading_components(load(spark, sf_dir), 64))


@query(f"WITH {POINTS} SELECT id, CAST(len(x) AS INTEGER) AS dims, round(list_sum(x), 6) AS total, round(x[64], 6) + 0.0 AS last FROM p")
def source_matrix(spark, sf_dir):
    """The points as matrix files (the id in the first column), and read again by splits of rows."""
    path = place(spark, "matrix")
    p = load(matrices.register(spark), sf_dir).select(F.concat(F.array(F.col("id").cast("double")), "x").alias("x"))
    p.write.format("matrix").option("file_rows", 4096).mode("append").save(path)
    x = F.slice("x", 2, 1 << 20)
    rows = spark.read.format("matrix").option("split_bytes", 1 << 20).load(path).select(F.get("x", F.lit(0)).cast("long").alias("id"), x.alias("x"))
    return rows.select("id", F.size("x").alias("dims"), r6(F.aggregate("x", F.lit(0.0), lambda a, c: a + c), "total"), r6(F.get("x", F.lit(63)), "last"))


@query()
def paths_kept_up(spark, sf_dir):
    """Shortest paths of the two nearest neighbours' graph while its components are linked. Unrolled SQL would grow with the
    paths' hops; tests hold the table against one made anew."""
    p = load(spark, sf_dir)
    paths = U.connected_paths(p, D.undirected(D.knn_graph(p, 2)))[1]
    return paths.select("j", "i", r6("d", "d"), F.col("hops").cast("long").alias("hops"), "pred")


@query(f"WITH {POINTS} SELECT count(*) AS n, true AS sums_near, true AS forces_near FROM p")
def repulsion_by_cells(spark, sf_dir):
    """Of two principal components, blown up: are sums within a thousandth and forces within a hundredth of those of all pairs?"""
    y = written(L.pca(load(spark, sf_dir), 2).select("id", F.transform("y", lambda c: 40 * c).alias("y")), "plane")

    exact = B.repulsion_of_pairs(y).select("id", "z", F.get("f", F.lit(0)).alias("fx"), F.get("f", F.lit(1)).alias("fy"))
    got = B.repulsion(y).select("id", F.col("z").alias("gz"), "f").join(exact, "id")
    off = F.sqrt((F.get("f", F.lit(0)) - F.col("fx")) ** 2 + (F.get("f", F.lit(1)) - F.col("fy")) ** 2)
    return got.agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("gz") / F.col("z") - 1)) < 1e-3).alias("sums_near"), (F.max(off) < 0.01 * F.avg(F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2))).alias("forces_near"))
