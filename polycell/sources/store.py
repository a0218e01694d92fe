"""Meshes and results as Parquet tables, in versions.

A version is a folder with a table for each part and is there as a whole once its
mark is written, so a writer that dies leaves no half of one. Readers take the
latest marked version, or one by name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.boundary import Boundary, Plane

_MARK = "_COMPLETE"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions in a folder."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
    marked = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(_fs(spark, f"{path}/{n}/{_MARK}")[1])]
    return sorted(int(n[1:]) for n in marked)


def write(spark: SparkSession, path: str, version: int, parts: dict[str, DataFrame], notes: dict | None = None) -> None:
    """Writes a version; one that isn't complete is written anew, a complete one is left as it is."""
    if version in versions(spark, path):
        return
    root = f"{path}/v{version}"
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    spark.createDataFrame([(json.dumps(notes or {}),)], "notes string").coalesce(1).write.mode("overwrite").json(f"{root}/notes")
    fs, mark = _fs(spark, f"{root}/{_MARK}")
    fs.create(mark, True).close()


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[str, DataFrame], dict]:
    """(version, tables, notes) of the latest version, or of one."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no complete version in {path}")
    version = known[-1] if version is None else version
    fs, root = _fs(spark, f"{path}/v{version}")
    names = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()]
    tables = {n: spark.read.parquet(f"{path}/v{version}/{n}") for n in names if n != "notes"}
    return version, tables, json.loads(spark.read.json(f"{path}/v{version}/notes").first()["notes"])


def drop_before(spark: SparkSession, path: str, version: int) -> None:
    """Deletes complete versions before one."""
    for v in versions(spark, path):
        if v < version:
            fs, at = _fs(spark, f"{path}/v{v}")
            fs.delete(at, True)


def boundary_notes(boundary: Boundary | None) -> dict | None:
    return None if boundary is None else {"dim": boundary.dim, "planes": [[p.base.tolist(), p.normal.tolist(), p.cond, p.partner] for p in boundary.planes]}


def boundary_of(notes: dict | None) -> Boundary | None:
    import numpy as np

    return None if notes is None else Boundary(notes["dim"], [Plane(np.array(b), np.array(n), c, q) for b, n, c, q in notes["planes"]])


def write_mesh(mesh, path: str, version: int) -> None:
    """Nodes, vertices, unbounded edges and neighbours of a mesh."""
    spark = mesh.nodes.sparkSession
    parts = {"nodes": mesh.nodes, "vertices": mesh.vertices.dropDuplicates(["sigma"]), "infinite_edges": mesh.infinite_edges, "neighbours": mesh.neighbours()}
    write(spark, path, version, parts, {"boundary": boundary_notes(mesh.boundary)})


def read_mesh(spark: SparkSession, path: str, version: int | None = None):
    """(version, mesh)."""
    from ..api import VoronoiMesh
    from ..operators.incremental import Mesh

    version, t, notes = read(spark, path, version)
    mesh = VoronoiMesh(t["nodes"], boundary_of(notes["boundary"]))
    mesh.state = Mesh(t["nodes"], t["vertices"], t["infinite_edges"], mesh.boundary)
    mesh.version, mesh._near = 1, t["neighbours"]
    return version, mesh


def write_integral(integral, path: str, version: int) -> None:
    """Records of cells and interfaces, as the storage options keep them."""
    cells, interfaces = integral.kept()
    write(cells.sparkSession, path, version, {"cells": cells, "interfaces": interfaces})


def read_integral(spark: SparkSession, path: str, owner, version: int | None = None):
    """(version, integral) of a mesh; columns that weren't kept are null. It counts as of the mesh's present version."""
    from ..api import Integral

    version, t, _ = read(spark, path, version)
    values = "array<double>"
    full = lambda df, kinds: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    out = Integral(owner)
    out.cells = full(t["cells"], {"cell": "long", "volume": "double", "bulk": values})
    out.interfaces = full(t["interfaces"], {"cell": "long", "neighbour": "long", "area": "double", "integral": values})
    out.version = owner.version
    return version, out


def retarget(old: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Stored interfaces under a new neighbour list: values stay where the pair is still there, others are null."""
    return neighbours.join(old, ["cell", "neighbour"], "left")
