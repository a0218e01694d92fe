"""Insertion and removal of generators without a new build.

Refining drops the vertices that a new generator reaches, ties included, and builds
the new cells only: every new vertex belongs to a new cell, and a co-spherical new
generator makes its vertex appear again with the longer signature. Unbounded edges
of the affected cells are built anew. Removing drops what touches a removed
generator and rebuilds the cells around it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..plans.boundary import Boundary
from .construct import BROADCAST_NODES, cell_rows, infinite_edges, vertices
from .state import settled

TIE = 1e-10


@dataclass
class Mesh:
    nodes: DataFrame
    vertices: DataFrame
    infinite_edges: DataFrame
    boundary: Boundary | None = None
    held: DataFrame | None = None  # the cached rows behind vertices and edges


@dataclass
class Report:
    """Counts, as DataFrames of one row each are cheap to ask for but not always wanted."""

    appended: DataFrame
    affected: DataFrame
    invalidated: DataFrame
    new_vertices: DataFrame


def build(nodes: DataFrame, boundary: Boundary | None = None, strategy: str = "auto") -> Mesh:
    rows = cell_rows(nodes, boundary, strategy=strategy).persist()
    return Mesh(nodes, vertices(rows), infinite_edges(rows), boundary, rows)


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("sigma").alias("id")).filter("id >= 0").distinct()


def reached(vertices: DataFrame, new: DataFrame) -> DataFrame:
    """Those rows (position, r, ...) that a new generator is as near to as r, within a tolerance."""
    if new.limit(BROADCAST_NODES + 1).count() > BROADCAST_NODES:
        return vertices.join(new.select(F.col("coords").alias("y")), vec.distance("position", "y") <= F.col("r") + TIE, "left_semi")
    # The change set is the small side of a transaction.
    got = new.select("coords").toArrow()["coords"].combine_chunks()
    if not len(got):
        return vertices.limit(0)
    shared = vertices.sparkSession.sparkContext.broadcast(got.flatten().to_numpy().reshape(len(got), -1))

    def test(batches):
        y = shared.value
        for b in batches:
            x = b.column("position").flatten().to_numpy().reshape(b.num_rows, -1)
            near = np.full(len(x), np.inf)
            for s in range(0, len(y), 256):
                part = np.zeros((len(x), len(y[s : s + 256])))
                for k in range(x.shape[1]):
                    part += (x[:, k, None] - y[None, s : s + 256, k]) ** 2
                near = np.minimum(near, part.min(axis=1)) if part.size else near
            yield b.filter(pa.array(np.sqrt(near) <= b.column("r").to_numpy() + TIE))

    return vertices.mapInArrow(test, vertices.schema)


def invalidated(mesh: Mesh, new: DataFrame) -> DataFrame:
    """Vertices that a new generator is as near to as their own, within a tolerance."""
    own = mesh.nodes.select(F.col("id").alias("g"), F.col("coords").alias("x"))
    v = mesh.vertices.withColumn("g", F.element_at(F.filter("sigma", lambda s: s >= 0), 1)).join(own, "g").withColumn("r", vec.distance("position", "x"))
    return reached(v.select("sigma", "position", "r"), new).select("sigma", "position")


def refine(mesh: Mesh, new: DataFrame) -> tuple[Mesh, Report]:
    gone = settled(invalidated(mesh, new))
    nodes = settled(mesh.nodes.unionByName(new.select(*mesh.nodes.columns)))
    rows = settled(cell_rows(nodes, mesh.boundary, new.select("id"), all_of=True))
    made = vertices(rows).dropDuplicates(["sigma"])
    near = _ids(vertices(rows)).union(_ids(gone)).union(_ids(infinite_edges(rows))).distinct()
    # An unbounded edge may end or move without a vertex that says so: its cells are asked again.
    open_cells = _ids(mesh.infinite_edges)
    redo = cell_rows(nodes, mesh.boundary, open_cells, all_of=True)
    edges = settled(infinite_edges(redo).unionByName(infinite_edges(rows)).dropDuplicates(["sigma"]))
    kept = mesh.vertices.join(gone.select("sigma"), "sigma", "left_anti")
    out = settled(kept.unionByName(made).dropDuplicates(["sigma"]))
    old = settled(near.join(new.select("id"), "id", "left_anti"))
    return Mesh(nodes, out, edges, mesh.boundary), Report(new.select("id"), old, gone, made)


def remove(mesh: Mesh, ids: DataFrame) -> tuple[Mesh, Report]:
    gone = settled(ids.select("id"))
    nodes = settled(mesh.nodes.join(gone, "id", "left_anti"))

    def touching(rows: DataFrame) -> DataFrame:
        return rows.select("sigma", F.explode("sigma").alias("id")).join(gone, "id", "left_semi").select("sigma").distinct()

    hit, hit_edges = touching(mesh.vertices), touching(mesh.infinite_edges)
    lost = settled(mesh.vertices.join(hit, "sigma", "left_semi"))
    affected = settled(_ids(lost).union(_ids(mesh.infinite_edges.join(hit_edges, "sigma", "left_semi"))).distinct().join(gone, "id", "left_anti"))
    rows = settled(cell_rows(nodes, mesh.boundary, affected, all_of=True))
    made = vertices(rows).dropDuplicates(["sigma"])
    out = settled(mesh.vertices.join(hit, "sigma", "left_anti").unionByName(made).dropDuplicates(["sigma"]))
    edges = settled(mesh.infinite_edges.join(hit_edges, "sigma", "left_anti").unionByName(infinite_edges(rows)).dropDuplicates(["sigma"]))
    return Mesh(nodes, out, edges, mesh.boundary), Report(gone, affected, lost, made.join(mesh.vertices, "sigma", "left_anti"))


def affected_cells(old: DataFrame, new_vertices: DataFrame) -> DataFrame:
    """Old generators that appear in new vertices."""
    return old.select("id").join(_ids(new_vertices), "id", "left_semi")


def dirty(*sets: DataFrame) -> DataFrame:
    """Union of change sets (id)."""
    out = sets[0].select("id")
    for s in sets[1:]:
        out = out.union(s.select("id"))
    return out.distinct()
