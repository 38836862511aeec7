"""Density-based clusters of points by a grid: no pairs within a dense cell, and none of two dense cells but along their seam."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .ranges import written

#: Pairs of two parts of cells up to which their points are compared one by one; larger parts are halved first.
FEW = 4096


def _distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, ((p - q) * (p - q) for p, q in zip(a, b, strict=True)))


def dbscan(points: DataFrame, id_col: str, coords: list[str], eps: float, least: int) -> DataFrame:
    """id, core and cluster (the least id of its core points, null for noise) of every point.

    A core point has `least` points or more within eps, itself counted; core points within eps of each other are of one
    cluster. A point that is none belongs to the cluster of the smallest id that has a core point within eps.

    Cells have a diagonal of eps, so that points of one cell are near each other: in a cell of `least` points or more (a
    dense one) all are core, of one cluster, and make one node however many there are. Only points of other cells, fewer
    than `least` in each, are compared with the points of the cells around. Whether two dense cells touch is decided by
    bounding boxes of their parts, which are halved where boxes do not decide, until few points are left to compare.
    Points without an id or with a coordinate that is null or not finite are left out; ids are unique. One to three coordinates.
    """
    dims = len(coords)
    if not 1 <= dims <= 3:
        raise ValueError("one to three coordinates")
    side, reach = eps / dims**0.5 * (1 - 1e-9), 2
    names = [f"x{i}" for i in range(dims)]
    finite = reduce(lambda a, b: a & b, (F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in coords))
    rows = points.where(F.col(id_col).isNotNull() & finite).select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(n) for c, n in zip(coords, names, strict=True)))
    part = lambda level: F.array(*(F.floor(F.col(n) / (side / 2**level)) for n in names))
    placed = written(rows.withColumn("cell", part(0)), "points")
    cells = written(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("node")), "point-cells")
    dense = cells.where(F.col("n") >= least).select("cell", "node")
    sparse = written(placed.join(cells.where(F.col("n") < least).select("cell"), "cell"), "sparse-points")

    # Every sparse point beside the cells around it, and the points there.
    steps = F.array(*(F.lit(k).cast("bigint") for k in range(-reach, reach + 1)))
    around = lambda df: reduce(lambda d, i: d.withColumn(f"o{i}", F.explode(steps)), range(dims), df).withColumn("other", F.array(*(F.col("cell")[i] + F.col(f"o{i}") for i in range(dims)))).drop(*(f"o{i}" for i in range(dims)))
    asked = around(sparse.select("id", "cell", *names)).select(F.col("id").alias("p"), F.col("other").alias("cell"), *(F.col(n).alias(f"p_{n}") for n in names))
    near = _distance([F.col(f"p_{n}") for n in names], [F.col(n) for n in names]) <= eps * eps
    in_dense = placed.join(asked.join(dense, "cell"), "cell").where(near).groupBy("p", "node").agg(F.count("*").alias("n"))
    in_dense = written(in_dense, "near-dense")  # a row for each sparse point and dense cell near it
    in_sparse = written(sparse.join(asked, "cell").where(near).select("p", "id"), "near-sparse")  # fewer than `least` in each cell around
    counts = in_dense.select("p", "n").unionByName(in_sparse.select("p", F.lit(1).cast("bigint").alias("n"))).groupBy("p").agg(F.sum("n").alias("n"))
    core = written(counts.where(F.col("n") >= least).select("p"), "core-points")

    mates = in_sparse.join(core, "p").join(core.withColumnRenamed("p", "id"), "id").select(F.col("p").alias("a"), F.col("id").alias("b"))
    touching = in_dense.join(core, "p").select(F.col("p").alias("a"), F.col("node").alias("b"))
    edges = mates.unionByName(touching).unionByName(_touching(placed, dense, around, part, names, eps)).unionByName(core.select(F.col("p").alias("a"), F.col("p").alias("b"))).unionByName(dense.select(F.col("node").alias("a"), F.col("node").alias("b")))
    # A node's name is a core point of its cluster, so the least name is the least core id of nodes; a cell's is its least id.
    of = written(components(edges), "clusters")
    by_dense = placed.join(dense, "cell").select("id", F.lit(True).alias("core"), "node")
    by_core = core.select(F.col("p").alias("id"), F.lit(True).alias("core"), F.col("p").alias("node"))
    held = by_dense.unionByName(by_core).join(of, "node").select("id", "core", F.col("component").alias("cluster"))
    others = sparse.select(F.col("id").alias("p")).join(core, "p", "left_anti")
    cores_near = in_dense.select("p", "node").unionByName(in_sparse.join(core.withColumnRenamed("p", "id"), "id").select("p", F.col("id").alias("node")))
    borders = others.join(cores_near, "p", "left").join(of, "node", "left").groupBy(F.col("p").alias("id")).agg(F.min("component").alias("cluster"))
    return held.unionByName(borders.select("id", F.lit(False).alias("core"), "cluster"))


def _touching(placed: DataFrame, dense: DataFrame, around: object, part: object, names: list[str], eps: float) -> DataFrame:
    """Pairs (a, b) of nodes of dense cells that have two points within eps."""
    spark = placed.sparkSession
    pairs = around(dense).join(dense.select(F.col("cell").alias("other"), F.col("node").alias("b")), "other").where(F.col("node") < F.col("b")).select(F.col("node").alias("a"), "b", F.col("cell").alias("part_a"), F.col("other").alias("part_b"))
    pairs = written(pairs, "dense-pairs")
    kind = pairs.schema["a"].dataType.simpleString()
    points, linked, level = placed.join(dense, "cell").drop("id", "cell"), spark.createDataFrame([], f"a {kind}, b {kind}"), 0
    while not pairs.isEmpty():
        # Only cells that are still asked for; parts are named by their place in the finer grid, and by the part they are in.
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        held = points.join(nodes, "node", "left_semi").withColumns({"up": part(level), "part": part(level + 1)})
        boxes = written(held.groupBy("node", "up", "part").agg(F.count("*").alias("n"), *(f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max)))), "boxes")
        side = lambda k: boxes.select(F.col("node").alias(k), F.col("up").alias(f"part_{k}"), F.col("part").alias(f"in_{k}"), F.col("n").alias(f"n_{k}"), *(F.col(f"{e}_{n}").alias(f"{e}_{n}_{k}") for n in names for e in ("lo", "hi")))  # noqa: B023, E731
        both = pairs.join(side("a"), ["a", "part_a"]).join(side("b"), ["b", "part_b"])
        at = lambda e, n, k: F.col(f"{e}_{n}_{k}")
        gap = [F.greatest(F.lit(0.0), at("lo", n, "a") - at("hi", n, "b"), at("lo", n, "b") - at("hi", n, "a")) for n in names]
        span = [F.greatest(at("hi", n, "a") - at("lo", n, "b"), at("hi", n, "b") - at("lo", n, "a")) for n in names]
        square = lambda v: reduce(lambda x, y: x + y, (c * c for c in v))
        told = both.select("a", "b", F.col("in_a").alias("part_a"), F.col("in_b").alias("part_b"), (square(gap) <= eps * eps).alias("may"), (square(span) <= eps * eps).alias("must"), (F.col("n_a") * F.col("n_b")).alias("work"))
        told = written(told.where("may"), "box-pairs")
        sure = told.where("must").select("a", "b").distinct()
        open_pairs = told.join(sure, ["a", "b"], "left_anti")
        few = open_pairs.where(F.col("work") <= FEW)
        fine = lambda k: held.select(F.col("node").alias(k), F.col("part").alias(f"part_{k}"), *(F.col(n).alias(f"{n}_{k}") for n in names))  # noqa: B023, E731
        met = few.join(fine("a"), ["a", "part_a"]).join(fine("b"), ["b", "part_b"])
        close = met.where(_distance([F.col(f"{n}_a") for n in names], [F.col(f"{n}_b") for n in names]) <= eps * eps).select("a", "b").distinct()
        found = written(sure.unionByName(close).distinct(), "touching")
        linked = linked.unionByName(found)
        pairs = written(open_pairs.where(F.col("work") > FEW).join(found, ["a", "b"], "left_anti").select("a", "b", "part_a", "part_b"), "dense-pairs")
        level += 1
    return linked
