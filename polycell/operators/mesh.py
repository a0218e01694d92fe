"""Relations of a mesh: incidence, adjacency, neighbours, filters, numbering, comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def incidence(vertices: DataFrame) -> DataFrame:
    """(cell, sigma, position, owner): a row per vertex and ordinary generator; owner marks the smallest one."""
    ordinary = F.filter("sigma", lambda s: s >= 0)
    return vertices.select(F.explode(ordinary).alias("cell"), "sigma", "position", F.array_min(ordinary).alias("least")).select("cell", "sigma", "position", (F.col("cell") == F.col("least")).alias("owner"))


def cell_vertices(vertices: DataFrame, cell: int, which: str = "both") -> DataFrame:
    """Vertices of a cell: those it owns (primary), those it doesn't (secondary), or both."""
    rows = incidence(vertices).filter(F.col("cell") == cell)
    return (rows if which == "both" else rows.filter("owner" if which == "primary" else "not owner")).select("sigma", "position")


def contains_vertex(vertices: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those signatures that are vertices; they may be in any order."""
    return signatures.withColumn("sigma", F.array_sort(F.array_distinct("sigma"))).join(vertices.select("sigma"), "sigma", "left_semi")


def adjacency(vertices: DataFrame) -> DataFrame:
    """(cell, adjacent): cells that share a vertex."""
    ordinary = F.filter("sigma", lambda s: s >= 0)
    pairs = vertices.select(F.explode(ordinary).alias("cell"), ordinary.alias("o")).select("cell", F.explode("o").alias("adjacent"))
    return pairs.filter("cell <> adjacent").distinct()


def _span(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches))  # what two cells share
    points = np.array([p for p, ray in zip(t["p"].to_pylist(), t["ray"].to_pylist(), strict=True) if not ray])
    rays = [p for p, ray in zip(t["p"].to_pylist(), t["ray"].to_pylist(), strict=True) if ray]
    scale = np.abs(points - points[0]).max() if len(points) > 1 else 1.0
    span = np.concatenate([(points - points[0]) / (scale or 1.0), np.array(rays).reshape(-1, points.shape[1])])
    rank = int(np.linalg.matrix_rank(span, tol=1e-7)) if len(span) else 0
    yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()]), pa.array([keys[1].as_py()]), pa.array([rank], pa.int32())], ["cell", "neighbour", "rank"])


def neighbours(vertices: DataFrame, dim: int, infinite_edges: DataFrame | None = None, facet_rank: int | None = None) -> DataFrame:
    """(cell, neighbour): pairs that share a facet; boundary planes count as neighbours -1 - plane.

    A pair with a vertex in general position shares a facet. The others do if what
    they share, vertices and unbounded edges, spans dim - 1 dimensions.
    """
    need = dim - 1 if facet_rank is None else facet_rank
    plain = dim + 1

    def pairs(rows: DataFrame, ray: bool, point: str) -> DataFrame:
        cells = F.filter("sigma", lambda s: s >= 0)
        out = rows.select(F.explode(cells).alias("cell"), "sigma", F.col(point).alias("p")).select("cell", F.explode("sigma").alias("neighbour"), F.size("sigma").alias("m"), "p")
        return out.filter("cell <> neighbour").withColumn("ray", F.lit(ray))

    shared = pairs(vertices, False, "position")
    if infinite_edges is not None:
        # An unbounded edge adds its start, too: a facet may have no other vertex of its own.
        shared = shared.unionByName(pairs(infinite_edges, True, "direction").withColumn("m", F.lit(plain + 1))).unionByName(pairs(infinite_edges, False, "origin").withColumn("m", F.lit(plain + 1)))
    sure = shared.groupBy("cell", "neighbour").agg(F.min("m").alias("m"))
    general = sure.filter(F.col("m") == plain).select("cell", "neighbour") if facet_rank is None else None
    open_ = sure.filter(F.col("m") != plain) if facet_rank is None else sure
    rest = shared.join(open_.select("cell", "neighbour"), ["cell", "neighbour"], "left_semi").filter("cell < neighbour or neighbour < 0")
    ranks = rest.select("cell", "neighbour", "p", "ray").groupBy("cell", "neighbour").applyInArrow(_span, "cell long, neighbour long, rank int").filter(F.col("rank") == need).select("cell", "neighbour")
    ranks = ranks.union(ranks.filter("neighbour >= 0").select(F.col("neighbour").alias("cell"), F.col("cell").alias("neighbour")))
    return ranks if general is None else general.union(ranks)


def with_occurrence(rows: DataFrame, *order: str) -> DataFrame:
    """Adds the occurrence number of a repeated neighbour."""
    w = W.partitionBy("cell", "neighbour").orderBy(*(order or ("neighbour",)))
    return rows.withColumn("occurrence", F.row_number().over(w) - 1)


def reciprocal(interfaces: DataFrame) -> DataFrame:
    """Each interface (cell, neighbour, shift, area) with the other side's, (neighbour, cell, -shift), as other_area: null for walls."""
    back = interfaces.select(F.col("cell").alias("n"), F.col("neighbour").alias("c"), F.transform("shift", lambda s: -s).alias("s"), F.col("area").alias("other_area"))
    same = (F.col("cell") == F.col("c")) & (F.col("neighbour") == F.col("n")) & F.col("shift").eqNullSafe(F.col("s"))
    return interfaces.join(back, same, "left").drop("c", "n", "s")


# -- filters -------------------------------------------------------------------------------------


def erase_nodes_if(nodes: DataFrame, vertices: DataFrame, infinite_edges: DataFrame, condition: Column):
    """(nodes, vertices, infinite edges, erased ids): without the nodes that meet the condition and all that touches them."""
    gone = nodes.filter(condition).select("id")
    kept = nodes.join(gone, "id", "left_anti")

    def without(rows: DataFrame) -> DataFrame:
        hit = rows.select("sigma", F.explode("sigma").alias("id")).join(gone, "id", "left_semi").select("sigma").distinct()
        return rows.join(hit, "sigma", "left_anti")

    return kept, without(vertices), without(infinite_edges), public_ids(nodes).join(gone, "id", "left_semi").select("public_id")


def erase_vertices_if(vertices: DataFrame, condition: Column) -> DataFrame:
    return vertices.filter(~condition)


def filtered(nodes: DataFrame, vertices: DataFrame, infinite_edges: DataFrame, keep_node: Column, keep_vertex: Column):
    """Nodes and vertices that are kept, both decided on the old tables; node losses cascade."""
    n, v, e, _ = erase_nodes_if(nodes, vertices, infinite_edges, ~keep_node)
    return n, v.join(vertices.filter(keep_vertex).select("sigma"), "sigma", "left_semi"), e


# -- numbering and views -------------------------------------------------------------------------


def _dense(nodes: DataFrame, *order) -> DataFrame:
    """Adds a dense number by the given order: rows are counted per range and numbered within it."""
    spark = nodes.sparkSession
    at = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).persist()
    counts = {r["__p"]: r["count"] for r in at.groupBy("__p").count().collect()}  # a row per range
    base, pairs = 0, []
    for p in sorted(counts):
        pairs += [F.lit(p), F.lit(base).cast("long")]
        base += counts[p]
    if not pairs:
        return nodes.withColumn("n", F.lit(0).cast("long"))
    own = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    return at.withColumn("n", own + F.element_at(F.create_map(*pairs), F.col("__p"))).drop("__p")


def public_ids(nodes: DataFrame) -> DataFrame:
    """(id, public_id): dense numbers in the order of the stable ids."""
    return _dense(nodes.select("id"), "id").select("id", F.col("n").alias("public_id"))


def visible_first(nodes: DataFrame) -> DataFrame:
    """(id, place): visible nodes first, each part in the order of ids."""
    return _dense(nodes.select("id", (F.col("kind") != "visible").alias("later")), "later", "id").select("id", F.col("n").alias("place"))


def owners(nodes: DataFrame) -> DataFrame:
    """(id, owner): references to the visible node they are a copy of."""
    return nodes.select("id", F.coalesce("ref_id", "id").alias("owner"))


def renumbered(vertices: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vertices with sigma under a mapping (id, to); planes keep their names; sigma is sorted again."""
    rows = vertices.withColumn("__v", F.xxhash64("sigma")).select("__v", "position", F.explode("sigma").alias("id"))
    rows = rows.join(mapping.select("id", "to"), "id", "left").withColumn("to", F.coalesce("to", "id"))
    return rows.groupBy("__v", "position").agg(F.array_sort(F.collect_list("to")).alias("sigma")).select("sigma", "position")


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """The mapping (id, to) that applies ``first`` and then ``second``."""
    return first.select("id", F.col("to").alias("m")).join(second.select(F.col("id").alias("m"), "to"), "m").select("id", "to")


def inverted(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("to").alias("id"), F.col("id").alias("to"))


def swapped(mapping: DataFrame, a: int, b: int) -> DataFrame:
    """The mapping with the images of two places exchanged."""
    return mapping.withColumn("id", F.when(F.col("id") == a, b).when(F.col("id") == b, a).otherwise(F.col("id")))
