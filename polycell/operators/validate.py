"""Checks of a mesh: co-spherical vertices, nearest generators, closed edges, comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..plans.boundary import Boundary, mirror_rows


def _sites(nodes: DataFrame, boundary: Boundary | None) -> DataFrame:
    """(cell or null, id, coords): generators, and of each cell its mirror images."""
    sites = nodes.select(F.lit(None).cast("long").alias("cell"), "id", "coords")
    if boundary is not None and boundary.planes:
        sites = sites.union(mirror_rows(nodes, boundary).select("cell", (-1 - F.col("plane")).cast("long"), "coords"))
    return sites


def vertex_variance(nodes: DataFrame, vertices: DataFrame, boundary: Boundary | None = None) -> DataFrame:
    """(sigma, variance): variance of squared distances to the vertex's generators over their squared mean; mirrors are those of its smallest generator."""
    rows = vertices.select("sigma", "position", F.explode("sigma").alias("id"), F.array_min(F.filter("sigma", lambda s: s >= 0)).alias("owner"))
    s = _sites(nodes, boundary)
    plain = rows.filter("id >= 0").join(s.filter("cell is null").select("id", "coords"), "id")
    out = plain.select("sigma", "position", "coords")
    if boundary is not None and boundary.planes:
        walls = rows.filter("id < 0").join(s.filter("cell is not null").select(F.col("cell").alias("owner"), "id", "coords"), ["owner", "id"])
        out = out.union(walls.select("sigma", "position", "coords"))
    d2 = out.withColumn("d2", vec.squared_distance("position", "coords"))
    return d2.groupBy("sigma").agg((F.var_pop("d2") / F.pow(F.avg("d2"), F.lit(2.0))).alias("variance"))


def max_projection(nodes: DataFrame, rays: DataFrame) -> DataFrame:
    """(rid, value): the largest projection of a signature's generators on a direction; rays: (rid, sigma, direction)."""
    rows = rays.select("rid", "direction", F.explode("sigma").alias("id")).join(nodes.select("id", "coords"), "id")
    return rows.groupBy("rid").agg(F.max(vec.dot("direction", "coords")).alias("value"))


def wrong_vertices(nodes: DataFrame, vertices: DataFrame, max_variance: float = 1e-20, tol: float = 1e-9, boundary: Boundary | None = None) -> DataFrame:
    """(sigma, reason) of vertices that aren't co-spherical, that a generator is nearer to, or that leave one out."""
    v = vertex_variance(nodes, vertices, boundary).filter(F.col("variance") > max_variance).select("sigma", F.lit("variance").alias("reason"))
    own = nodes.select(F.col("id").alias("g"), F.col("coords").alias("x"))
    r = vertices.withColumn("g", F.array_min(F.filter("sigma", lambda s: s >= 0))).join(own, "g").withColumn("r", vec.distance("position", "x")).drop("x")
    pairs = r.join(F.broadcast(nodes.select("id", "coords")) if nodes.limit(20_001).count() <= 20_000 else nodes.select("id", "coords"), ~F.expr("array_contains(sigma, id)") & (vec.distance("position", "coords") <= F.col("r") + tol))
    return v.union(pairs.select("sigma", F.when(vec.distance("position", "coords") < F.col("r") - tol, "nearer").otherwise("missing").alias("reason")).distinct())


def wrong_cells(nodes: DataFrame, vertices: DataFrame, infinite_edges: DataFrame, dim: int, cells: DataFrame, boundary: Boundary | None = None, **kind) -> DataFrame:
    """(cell, what) of the given cells (id): wrong vertices and edges that aren't closed."""
    own = vertices.select("sigma", "position", F.explode("sigma").alias("id")).join(cells.select("id"), "id", "left_semi").select("sigma", "position").dropDuplicates(["sigma"])
    wrong = wrong_vertices(nodes, own, boundary=boundary, **kind).select(F.explode("sigma").alias("id"), "reason").join(cells.select("id"), "id", "left_semi")
    ends = open_edges(vertices, infinite_edges, dim, cells).select(F.col("cell").alias("id"), F.lit("edge").alias("reason"))
    return wrong.union(ends).distinct().select(F.col("id").alias("cell"), F.col("reason").alias("what"))


def flat_vertices(nodes: DataFrame, vertices: DataFrame, boundary: Boundary | None = None) -> DataFrame:
    """(sigma, rank): vertices whose generators don't span the space; planes count by their normals."""
    d = nodes.select(F.max(F.size("coords"))).first()[0]
    rows = vertices.select("sigma", F.explode("sigma").alias("id"))
    own = rows.filter("id >= 0").join(nodes.select("id", "coords"), "id").select("sigma", F.lit(False).alias("plane"), F.col("coords").alias("x"))
    if boundary is not None and boundary.planes:
        p = boundary.frame(nodes.sparkSession).select((-1 - F.col("plane")).cast("long").alias("id"), F.col("normal").alias("x"))
        own = own.unionByName(rows.filter("id < 0").join(F.broadcast(p), "id").select("sigma", F.lit(True).alias("plane"), "x"))
    first = own.filter("not plane").groupBy("sigma").agg(F.min("x").alias("o"))
    span = own.join(first, "sigma").select("sigma", F.when(F.col("plane"), F.col("x")).otherwise(vec.sub("x", "o")).alias("v")).groupBy("sigma").agg(F.collect_list("v").alias("vs"))

    @F.arrow_udf("int")
    def rank(vs: pa.Array) -> pa.Array:
        return pa.array([int(np.linalg.matrix_rank(np.array(v), tol=1e-9)) for v in vs.to_pylist()], pa.int32())

    return span.select("sigma", rank("vs").alias("rank")).filter(F.col("rank") < d)


def open_edges(vertices: DataFrame, infinite_edges: DataFrame, dim: int, cells: DataFrame | None = None) -> DataFrame:
    """(cell, edge, ends): edges of cells, in general position, that don't have two ends, of which an unbounded edge may be one.

    An edge is dim generators of a vertex with dim + 1; degenerate vertices are
    closed by the full signatures that they share with others.
    """
    ordinary = F.filter("sigma", lambda s: s >= 0)
    drop_one = F.transform("sigma", lambda s: F.array_remove("sigma", s))
    v = vertices.filter(F.size("sigma") == dim + 1)
    ends = v.select("sigma", F.explode(drop_one).alias("edge")).groupBy("edge").agg(F.count_distinct("sigma").alias("ends"))
    rays = infinite_edges.select(F.col("sigma").alias("edge")).distinct().withColumn("ray", F.lit(1))
    # The other end may be a degenerate vertex, whose signature holds the edge's.
    wide = vertices.filter(F.size("sigma") > dim + 1).select(F.col("sigma").alias("wide"))
    out = ends.join(rays, "edge", "left").withColumn("ends", F.col("ends") + F.coalesce("ray", F.lit(0))).filter("ends <> 2 and exists(edge, s -> s >= 0)")
    first = wide.select(F.explode("wide").alias("least"), "wide")
    held = out.withColumn("least", F.array_max("edge")).join(first, "least").filter("size(array_except(edge, wide)) = 0").groupBy("edge").agg(F.count_distinct("wide").alias("more"))
    out = out.join(held, "edge", "left").withColumn("ends", F.col("ends") + F.coalesce("more", F.lit(0))).filter("ends <> 2")
    out = out.select(F.explode(F.filter("edge", lambda s: s >= 0)).alias("cell"), "edge", "ends")
    return out if cells is None else out.join(cells.select(F.col("id").alias("cell")), "cell", "left_semi")


def is_complete(vertices: DataFrame, infinite_edges: DataFrame, dim: int) -> bool:
    return open_edges(vertices, infinite_edges, dim).isEmpty()


def compare(a: DataFrame, b: DataFrame, tol: float = 1e-9) -> DataFrame:
    """One row: vertices missing on either side, and sum, mean and maximum of position differences."""
    rows = a.select("sigma", F.col("position").alias("p")).join(b.select("sigma", F.col("position").alias("q")), "sigma", "full_outer")
    gap = F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), vec.distance("p", "q"))
    return rows.withColumn("gap", gap).agg(
        F.count_if(F.col("q").isNull()).alias("missing_right"),
        F.count_if(F.col("p").isNull()).alias("missing_left"),
        F.count_if(F.col("gap") > tol).alias("moved"),
        F.coalesce(F.sum("gap"), F.lit(0.0)).alias("sum_gap"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"),
    )


def compare_meshes(a, b, tol: float = 1e-9) -> DataFrame:
    """One row on two meshes (nodes, vertices): dimensions and numbers of nodes and vertices, nodes missing on either side or moved, and what compare() says of the vertices."""
    size = lambda m, side: m.nodes.agg(F.count(F.lit(1)).alias(f"nodes_{side}"), F.max(F.size("coords")).alias(f"dim_{side}")).crossJoin(m.vertices.agg(F.count(F.lit(1)).alias(f"vertices_{side}")))  # noqa: E731  one row each
    n = a.nodes.select("id", F.col("coords").alias("p")).join(b.nodes.select("id", F.col("coords").alias("q")), "id", "full_outer")
    gap = F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), F.when(F.size("p") == F.size("q"), vec.distance("p", "q")).otherwise(float("inf")))
    n = n.agg(F.count_if(F.col("q").isNull()).alias("nodes_missing_right"), F.count_if(F.col("p").isNull()).alias("nodes_missing_left"), F.count_if(gap > tol).alias("nodes_moved"))
    return size(a, "left").crossJoin(size(b, "right")).crossJoin(n).crossJoin(compare(a.vertices, b.vertices, tol))
