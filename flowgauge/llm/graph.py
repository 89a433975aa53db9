"""Connected components of a large graph by alternating stars."""

from pyspark.sql import functions as F

from flowgauge.session import stored


def _both_ways(edges):
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))


def _large_star(edges):
    """Hang every larger neighbour of a node on the smallest of its neighbourhood."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return (around.filter("v > u").join(least, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())


def _small_star(edges):
    """Hang a node and its smaller neighbours on the smallest of them. Edges here
    already point from the larger node ``a`` to the smaller ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def _sign(edges):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges):
    """(node, root) for every node that has an edge; root is the smallest node it can
    reach. ``edges`` has long columns a and b. Rounds grow with the logarithm of the
    longest path; each writes its edges, at most as many as nodes and edges before."""
    edges = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = _sign(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        before, sign = sign, _sign(edges)
        if before == sign:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b"), F.col("b")).distinct())
